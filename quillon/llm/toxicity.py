"""Toxicity by a weighted finite-state grammar over clauses.

A clause's words are read by a lexicon and five transducers (`transducers.Transducer`), one for
insults, threats, targets, negations and reported speech:

* the lexicon reads a word and writes its class; an insulting word has an arc that costs its negative
  weight, and one that lets it pass as any other word;
* insult: turns an insult into a hit;
* threat: turns a threat into a hit if the clause has a target, before it or after;
* target: hits in a clause with a target cost `AIMED` less;
* negation: hits in the `SCOPE` words after a negation cost `NEGATED` more;
* reported speech: hits after a reporting word cost `REPORTED` more.

The five are composed once into a grammar, which is composed with each clause; the clause's weight is the
negative cost of the shortest path in the tropical semiring.  A hit that costs more than it gains is passed over
by that path, so no weight is negative.  What a text scores is a logistic function of what its matched
clauses weigh, in all and for each hundred words: isolated words outside of clauses with a hit count nothing.

The insult transducer's lexicon is learned from labelled rows: words and word beginnings (3 to 7
letters) that are far more common in toxic texts, each seen beside several different neighbours, so
that a passage that is merely copied doesn't enter.  They become arcs of the lexicon beside those of the
fixed words.  At most about `SAMPLE` labelled documents are read for that, chosen by a hash of their doc_id,
and at most `LEXICON` entries are kept (documented bounds).  The logistic function is fitted on the same
sample.  Threats, targets, negations and reporting words are fixed lists; their effects stay as stated.
A clause ends with a sentence or a line, however long that is.

Defined results: null and empty texts have no clause and get the score of a text without matches;
without labels, or with labels of one kind, the lexicon is the fixed one and the default
coefficients hold; repeated rows are scored alike.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import checkpointed, kept_rows, small
from .transducers import Transducer, compose, numbered, shortest

SAMPLE = 20_000
LEXICON = 400
LEAST_TOXIC = 12
LEAST_CONTEXTS = 8
ODDS = 2.5
#: So often at most does a word of one text count when the lexicon is learned.
REPEATS = 3
#: Lengths of the word beginnings that are tried.
STEMS = range(3, 8)
PREDICT = 0.7

# Word classes of the grammar.
INSULTS = ("idiot", "moron", "stupid", "loser", "scum", "worthless", "pathetic", "disgusting")
THREATS = ("kill", "murder", "hurt", "destroy", "strangle", "stab", "shoot", "beat")
TARGETS = ("you", "your", "yours", "you're", "u", "he", "she", "they", "them", "him", "her", "these", "those", "tu", "vous", "du", "dich", "ihr", "usted", "ustedes")
NEGATIONS = ("not", "never", "no", "isn't", "aren't", "wasn't", "don't", "doesn't", "didn't", "without", "nicht", "kein", "pas", "jamais", "nunca")
REPORTING = ("said", "says", "called", "calls", "quoted", "wrote", "claimed", "alleged", "reported", "quote")

#: What the transducers add to the cost of a hit.
INSULTING, THREATENING, AIMED, NEGATED, REPORTED = -2.0, -2.0, -0.5, 1.0, 0.8
#: So many words after a negation are negated.
SCOPE = 3

_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_END = re.compile(r"[.!?;\n]")
INSULT, THREAT, TARGET, NEGATION, REPORT, HIT, OTHER = CLASSES = ("insult", "threat", "target", "negation", "report", "hit", "other")


def _passing(states, but: dict[int, set[str]] | None = None) -> Transducer:
    """A transducer that writes what it reads, with but[state] left to be added."""
    t = Transducer()
    for s in states:
        for c in CLASSES:
            if c not in (but or {}).get(s, ()):
                t.arc(s, c, c, 0.0, s)
    return t


def insult_transducer() -> Transducer:
    t = _passing([0], {0: {INSULT}})
    t.finals = {0: 0.0}
    t.arc(0, INSULT, HIT, 0.0, 0)
    return t


def threat_transducer(cost: float = THREATENING) -> Transducer:
    """State 0: no threat counted; 1: counted, a target must follow; 2: there is a target."""
    t = _passing([0, 1, 2], {0: {THREAT}, 1: {THREAT, TARGET}, 2: {THREAT}})
    t.finals = {0: 0.0, 2: 0.0}
    for s in (0, 1, 2):
        t.arc(s, THREAT, OTHER, 0.0, s)
        t.arc(s, THREAT, HIT, cost, max(s, 1))
    t.arc(0, TARGET, TARGET, 0.0, 2)
    t.arc(1, TARGET, TARGET, 0.0, 2)
    return t


def target_transducer(cost: float = AIMED) -> Transducer:
    """State 0: hits count as they are; 1: they count more, a target must follow; 2: there is a target."""
    t = _passing([0, 1, 2], {1: {HIT, TARGET}, 2: {HIT}})
    t.finals = {0: 0.0, 2: 0.0}
    t.arc(0, HIT, HIT, cost, 1)
    t.arc(1, HIT, HIT, cost, 1)
    t.arc(2, HIT, HIT, cost, 2)
    t.arc(0, TARGET, TARGET, 0.0, 2)
    t.arc(1, TARGET, TARGET, 0.0, 2)
    return t


def negation_transducer(cost: float = NEGATED, scope: int = SCOPE) -> Transducer:
    """The state is how many more words are negated."""
    t = Transducer(finals=dict.fromkeys(range(scope + 1), 0.0))
    for s in range(scope + 1):
        for c in CLASSES:
            t.arc(s, c, c, cost if c == HIT and s else 0.0, scope if c == NEGATION else max(s - 1, 0))
    return t


def report_transducer(cost: float = REPORTED) -> Transducer:
    t = Transducer(finals={0: 0.0, 1: 0.0})
    for s in (0, 1):
        for c in CLASSES:
            t.arc(s, c, c, cost if c == HIT and s else 0.0, 1 if c == REPORT else s)
    return t


def composed() -> Transducer:
    """The five in one: classes of words to classes of words, some of which are hits."""
    return numbered(reduce(compose, (insult_transducer(), threat_transducer(), target_transducer(), negation_transducer(), report_transducer())))


GRAMMAR = composed()
_FIXED = {w: c for c, those in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTING)) for w in those}


class OfWords:
    """The lexicon composed with the grammar, arc by arc as a clause asks for them: reads words, writes classes."""

    start = GRAMMAR.start

    def __init__(self, grammar: Grammar):
        self.words = grammar

    def leaving(self, state, word: str) -> list[tuple[str, float, int]]:
        return [(written, cost + more, to) for c, cost in self.words.classes(word) for written, more, to in GRAMMAR.leaving(state, c)]

    def ending(self, state) -> float:
        return GRAMMAR.ending(state)


@dataclass
class Grammar:
    """words and stems: weights of insulting words, and of word beginnings of a length in STEMS."""

    words: dict[str, float] = field(default_factory=lambda: dict.fromkeys(INSULTS, -INSULTING))
    stems: dict[str, float] = field(default_factory=dict)
    coefficients: list[float] = field(default_factory=lambda: [-4.0, 0.7, 1.6])

    def __post_init__(self):
        parts = [re.escape(w) + r"(?![^\W\d_])" for w in sorted({*self.words, *THREATS})] + [re.escape(s) for s in sorted(self.stems)]
        self.find = re.compile(r"(?<![^\W\d_])(?:" + "|".join(parts) + ")")

    def weight(self, word: str) -> float:
        return max(self.words.get(word, 0.0), *(self.stems.get(word[:k], 0.0) for k in STEMS)) if self.stems else self.words.get(word, 0.0)

    def classes(self, word: str) -> list[tuple[str, float]]:
        """The lexicon's arcs: classes that a word can have, with their costs."""
        own = [(_FIXED.get(word, OTHER), 0.0)]
        w = self.weight(word)
        return [(INSULT, -w), *own] if w else own

    def clause(self, words: list[str]) -> float:
        """The weight of a clause: of words without a class, no more than SCOPE in a row make a difference."""
        kept, plain = [], 0
        for w in words:
            plain = 0 if w in _FIXED or self.weight(w) else plain + 1
            if plain <= SCOPE:
                kept.append(w)
        return max(0.0, -shortest(OfWords(self), kept)[0])

    def clauses(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the clauses that match."""
        low, out, done = text.lower(), [], 0
        for m in self.find.finditer(low):
            if m.start() < done:
                continue
            a = done
            for e in _END.finditer(low, a, m.start()):
                a = e.end()
            stop = _END.search(low, m.end())
            b = stop.start() if stop else len(low)
            weight = self.clause(_WORD.findall(low[a:b]))
            if weight:
                out.append((a, b, weight))
            done = b
        return out

    def features(self, text: str, found: list[tuple[int, int, float]]) -> tuple[float, float]:
        """The weight of the matched clauses, and the same for each hundred words of the text, as logarithms."""
        total = sum(w for *_, w in found)
        return math.log1p(total), math.log1p(100 * total / max(len(text.split()), 1))

    def score(self, text: str, found: list[tuple[int, int, float]]) -> float:
        bias, *slopes = self.coefficients
        z = bias + sum(a * b for a, b in zip(slopes, self.features(text, found), strict=True))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(3)) == 1


def _count(batches):
    """Of each word and word beginning: how often it stands in toxic texts and in all."""
    kind = pa.schema([("entry", pa.string()), ("stem", pa.bool_()), ("toxic", pa.int64()), ("all", pa.int64())])
    for b in small(batches):
        words: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            words[toxic].update({w: min(n, REPEATS) for w, n in Counter(_WORD.findall(text.lower())).items()})
        found: dict[tuple[str, bool], list[int]] = {}
        for toxic, counts in words.items():
            for w, n in counts.items():
                for key in [(w, False), *((w[:k], True) for k in STEMS if len(w) > k)]:
                    s = found.setdefault(key, [0, 0])
                    s[0] += n * toxic
                    s[1] += n
            s = found.setdefault(("", False), [0, 0])
            s[0] += toxic * counts.total()
            s[1] += counts.total()
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found]), pa.array([s for _, s in found]), pa.array([v[0] for v in found.values()], pa.int64()), pa.array([v[1] for v in found.values()], pa.int64())], schema=kind)


def _neighbours(entries: list[tuple[str, bool, float]]):
    words, stems = {e for e, s, _ in entries if not s}, {e for e, s, _ in entries if s}

    def run(batches):
        kind = pa.schema([("entry", pa.string()), ("stem", pa.bool_()), ("beside", pa.string())])
        for b in small(batches):
            out = set()
            for text in b.column(0).to_pylist():
                found = _WORD.findall(text.lower())
                for i, w in enumerate(found):
                    beside = f"{found[i - 1] if i else ''} {found[i + 1] if i + 1 < len(found) else ''}"
                    if w in words:
                        out.add((w, False, beside))
                    out |= {(w[:n], True, beside) for n in STEMS if len(w) > n and w[:n] in stems}
            rows = sorted(out)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind.field(k).type) for k in range(3)], schema=kind)

    return run


def _features(grammar: Grammar):
    def run(batches):
        kind = pa.schema([("a", pa.float64()), ("b", pa.float64()), ("toxic", pa.int32())])
        for b in small(batches):
            found = [grammar.features(t, grammar.clauses(t)) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.float64()), b.column(1)], schema=kind)

    return run


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> list[float]:
    """Coefficients (the first is the bias) by Newton's method with a little ridge."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w.tolist()


def learn(docs: DataFrame, labels: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Grammar:
    """A grammar from labelled rows; usable, a condition on `doc_id`, leaves out those held out."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.filter(usable) if usable is not None else known
    n = known.count()
    if not n:
        return Grammar()
    share = int(min(1.0, SAMPLE / n) * (1 << 30))
    known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share)
    # About SAMPLE rows at most: labels are sent to the texts, and the texts are written once for three passes.
    sample = checkpointed(texts.join(F.broadcast(known), "doc_id").select("text", "toxic"))
    counts = sample.mapInArrow(_count, "entry string, stem boolean, toxic long, all long").groupBy("entry", "stem").agg(F.sum("toxic").alias("t"), F.sum("all").alias("n"))
    counts = checkpointed(counts.filter((F.col("t") >= LEAST_TOXIC) | (F.col("entry") == "")))
    total = counts.filter("entry = ''").first()
    if not total or not total["t"] or total["t"] == total["n"]:
        return Grammar()
    odds = F.log((F.col("t") + 0.5) / (total["t"] + 1.0)) - F.log((F.col("n") - F.col("t") + 0.5) / (total["n"] - total["t"] + 1.0))
    top = counts.filter((F.col("entry") != "") & (F.length("entry") > 2)).withColumn("odds", odds).filter(F.col("odds") >= ODDS)
    top = top.withColumn("gain", F.col("odds") * F.col("t")).orderBy(F.desc("gain"), "stem", F.desc(F.length("entry")), "entry").limit(4 * LEXICON).collect()
    if not top:
        return Grammar()
    entries = [(r["entry"], r["stem"], r["odds"]) for r in top]
    beside = sample.filter("toxic = 1").mapInArrow(_neighbours(entries), "entry string, stem boolean, beside string").distinct().groupBy("entry", "stem").agg(F.count(F.lit(1)).alias("n"))
    various = {(r["entry"], r["stem"]) for r in beside.filter(F.col("n") >= LEAST_CONTEXTS).collect()}  # 4 x LEXICON rows at most
    words: dict[str, float] = dict.fromkeys(INSULTS, -INSULTING)
    stems: dict[str, float] = {}
    for e, stem, w in entries:  # from the strongest on: what overlaps a stronger entry adds nothing
        if (e, stem) not in various or len(words) + len(stems) >= LEXICON + len(INSULTS) or any(e.startswith(x) and (stem or e != x) for x in stems):
            continue
        if stem and any(x.startswith(e) for x in (*stems, *words) if x not in INSULTS):
            continue
        (stems if stem else words)[e] = min(w, 6.0)
    grammar = Grammar(words=words, stems=stems)
    fitted = sample.mapInArrow(_features(grammar), "a double, b double, toxic int").collect()  # about SAMPLE rows at most
    y = np.array([r["toxic"] for r in fitted], dtype=float)
    grammar.coefficients = logistic(np.array([[r["a"], r["b"]] for r in fitted]), y)
    return grammar


def score(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted, clauses (start, end, weight of each that matched, in characters)."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("weight", pa.float64())]))
    kind = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32()), ("clauses", span)])
    shared = docs.sparkSession.sparkContext.broadcast(grammar)  # LEXICON entries at most

    def run(batches):
        g = shared.value
        for b in small(batches):
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = g.clauses(text)
                s = g.score(text, found)
                rows.append({"doc_id": doc, "score": s, "predicted": int(s >= PREDICT), "clauses": [{"start": a, "end": e, "weight": w} for a, e, w in found]})
            yield pa.RecordBatch.from_pylist(rows, schema=kind)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int, clauses array<struct<start:long,end:long,weight:double>>")


def keep_clean(docs: DataFrame, grammar: Grammar, text_col: str = "text") -> DataFrame:
    """docs without the rows predicted to be toxic; all columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def make_test():
        g = shared.value
        return lambda text: g.score(text or "", g.clauses(text or "")) < PREDICT

    return kept_rows(docs, text_col, make_test)
