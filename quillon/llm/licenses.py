"""License scans: base phrases, and a fuzzy search for short notices.

A text's words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z became a-z; they are joined by
single spaces.  Base phrases are counted at every place where their words stand in a row.
A notice may be misspelt: it is found with up to `edits` character edits.  Cut into edits + 1
seeds, at least one seed of such a copy is intact (pigeonhole), so an automaton over all seeds
locates the candidates in one pass, and the regex library verifies the bounded edits in a window
around each and gives the span, which begins and ends with whole words.  Words that tell notices apart must
be intact.

Defined results: null and empty texts have no words, null first_word and last_word, empty labels
and score 0; repeated rows and ties are scanned each; very long texts are read whole; other columns aren't
touched; score is 1 for an exact place and falls by
edits / (allowed edits + 1).
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small, text_of

# Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


@dataclass(frozen=True)
class Notice:
    label: str
    text: str
    edits: int
    intact: tuple[str, ...] = ()


# Short notices of widely used licences, as their words.
NOTICES = (
    Notice("apache", "licensed under the apache license version 2 0", 4),
    Notice("apache", "you may obtain a copy of the license at http www apache org licenses license 2 0", 6),
    Notice("mit", "released under the mit license", 2, ("mit",)),
    Notice("mit", "licensed under the mit license", 2, ("mit",)),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy", 7),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification", 7),
    Notice("mpl", "subject to the terms of the mozilla public license", 4, ("mozilla",)),
    Notice("gpl", "licensed under the gnu general public license", 4, ("general",)),
    Notice("gpl", "under the terms of the gnu general public license", 4, ("general",)),
    Notice("lgpl", "gnu lesser general public license", 3, ("lesser",)),
    Notice("agpl", "gnu affero general public license", 3, ("affero",)),
    Notice("cc-by", "creative commons attribution 4 0 international", 4, ("attribution",)),
    Notice("cc-by-nc", "licensed under cc by nc 4 0", 2, ("cc", "by", "nc")),
    Notice("cc-by-sa", "licensed under cc by sa 4 0", 2, ("cc", "by", "sa")),
    Notice("cc-by-nd", "licensed under cc by nd 4 0", 2, ("cc", "by", "nd")),
    Notice("cc0", "dedicated to the public domain under cc0", 3, ("cc0",)),
    Notice("unlicense", "this is free and unencumbered software released into the public domain", 6),
    Notice("reserved", "all rights reserved", 2),
)

_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_state: dict = {}


def words_of(text: str) -> tuple[int, str]:
    """The number of words, and the words with one space before, between and after them."""
    words = text.encode("utf-8").translate(_WORD_BYTES).split()
    return len(words), f" {b' '.join(words).decode('utf-8', 'replace')} "


def seeds(notice: Notice) -> list[tuple[int, str]]:
    """edits + 1 parts of nearly one length, each with its place."""
    n, parts = len(notice.text), notice.edits + 1
    cuts = [n * i // parts for i in range(parts + 1)]
    return [(a, notice.text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Scanner:
    def __init__(self, notices: tuple[Notice, ...] = NOTICES, base: dict[str, str] = BASE):
        import ahocorasick
        import regex

        self.notices, self.base = notices, base
        self.patterns = [regex.compile(f"(?b)(?<= )(?:{regex.escape(x.text, special_only=True)}){{e<={x.edits}}}(?= )") for x in notices]
        found: dict[str, list[tuple[int, int]]] = {}
        for k, x in enumerate(notices):
            for at, seed in seeds(x):
                found.setdefault(seed, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for seed, uses in found.items():
            self.automaton.add_word(seed, (len(seed), uses))
        if found:
            self.automaton.make_automaton()

    def exact(self, norm: str) -> list[tuple[str, int, int]]:
        out = []
        for phrase, label in self.base.items():
            at = norm.find(f" {phrase} ")
            while at >= 0:
                out.append((label, at + 1, at + 1 + len(phrase)))
                at = norm.find(f" {phrase} ", at + 1)
        return out

    def fuzzy(self, norm: str) -> list[tuple[str, int, int, int, int]]:
        """(label, start, end, edits, allowed edits) in characters of norm, the first of those that overlap."""
        if not self.notices:
            return []
        tried: set[tuple[int, int]] = set()
        done: dict[int, int] = {}
        out = []
        for end, (length, uses) in self.automaton.iter(norm):
            for k, at in uses:
                x = self.notices[k]
                lo = end + 1 - length - at
                if lo < done.get(k, -1) or (k, lo) in tried:
                    continue
                tried.add((k, lo))
                m = self.patterns[k].search(norm, max(0, lo - x.edits), lo + len(x.text) + x.edits + 1)
                if m and all(w in m.group().split() for w in x.intact):
                    out.append((x.label, m.start(), m.end(), sum(m.fuzzy_counts), x.edits))
                    done[k] = m.end()
        return out

    def scan(self, text: str) -> dict:
        n, norm = words_of(text)
        base, fuzzy = self.exact(norm), self.fuzzy(norm)
        spaces: list[int] = []
        if base or fuzzy:
            at = norm.find(" ")
            while at >= 0:
                spaces.append(at)
                at = norm.find(" ", at + 1)
        word = lambda at: bisect.bisect_right(spaces, at) - 1
        firsts = [word(a) for _, a, _ in base]
        spans = [{"label": b, "start": word(a), "end": word(e - 1) + 1, "edits": 0} for b, a, e in base]
        spans += [{"label": b, "start": word(a), "end": word(e - 1) + 1, "edits": k} for b, a, e, k, _ in fuzzy]
        return {
            "n_words": n, "n_base": len(base), "first_word": min(firsts, default=None), "last_word": max(firsts, default=None),
            "base_labels": ",".join(sorted({b for b, _, _ in base})), "labels": ",".join(sorted({s["label"] for s in spans})),
            "score": max([0.0, *(1.0 for _ in base[:1]), *(1 - k / (most + 1) for *_, k, most in fuzzy)]), "spans": spans,
        }


def license_scan(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES, base: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans (in words)."""
    base = BASE if base is None else base
    span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())]))
    kind = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", span)])

    def run(batches):
        key = (notices, tuple(base.items()))
        if key not in _state:
            _state[key] = Scanner(notices, base)
        scan = _state[key].scan
        for batch in small(batches):
            rows = [{"doc_id": d} | scan(t) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema=kind)

    return text_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,end:long,edits:int>>")
