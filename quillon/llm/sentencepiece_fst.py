"""SentencePiece encoding and decoding as a weighted finite-state transducer.

A model file is compiled into three transducers, each with numbered states and arcs by symbol:

* `Normaliser`: bytes to bytes, the model's own map of characters (its double array is read arc by arc, the
  longest match is rewritten, other characters pass), white space to `▁`, the dummy prefix;
* `Pieces`: characters to pieces, a trie whose final states write a piece and return to the start;
* the byte fallback: a character that no piece begins with, to its UTF-8 byte pieces (or the unknown piece).

Composed with an input they form a lattice (`lattice`): arcs from place to place with a piece and its cost.
The encoding is the lattice's shortest path in the tropical semiring (`path`).

For a unigram model the arc costs are the pieces' negative log probabilities.  A BPE model's
scores are merge ranks, and its encoding isn't the path of the least rank sum.  It is the only path
on which each piece, and each pair of neighbouring pieces, is what the merges make of its
characters.  The lattice is therefore composed with a pair automaton, whose state is the last piece and whose arcs
cost 0 for such pairs and infinity for others; so the shortest path is exactly the library's encoding.  Each prefix
of an input has one finite path, so the search keeps one state a place.

No piece holds `▁` after another character, so the lattice of a text is a chain of lattices,
cut before each run of `▁`; a worker remembers the best paths of up to `CACHE` of them.

Defined results: null and empty texts have no ids; repeated rows are encoded each; literal `▁`
is a space to the model, so it is decoded as one; a character map is applied before (decoding can't undo it).
"""

from __future__ import annotations

import array
import math
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small, text_of

CACHE = 1_000_000
SPACE = "▁"
#: Longer segments are not remembered.
LONG = 64
#: Arcs of the pair automaton that are remembered; others are made again.
PAIRS = 1_000_000
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER, BYTE, UNUSED = 1, 2, 3, 4, 6, 5
_SEGMENT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_state: dict = {}


def _fields(data: bytes):
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        x = shift = 0
        while True:
            b = data[at]
            at += 1
            x |= (b & 127) << shift
            shift += 7
            if b < 128:
                return x

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            value = data[at : at + n]
            at += n
        yield key >> 3, value


def normaliser_of(spec: bytes) -> Normaliser:
    """From a model's normaliser message."""
    x = dict(_fields(spec))
    return Normaliser(x.get(2, b""), bool(x.get(3, 1)), bool(x.get(4, 1)), bool(x.get(5, 1)))


class Best(dict):
    """The ids of the best paths of segments."""

    def __init__(self, transducer):
        self.transducer = transducer

    def __missing__(self, segment: str) -> bytes:
        ids = self.transducer.emitted(segment)
        if len(self) < CACHE and len(segment) <= LONG:
            self[segment] = ids
        return ids


class Normaliser:
    """Text to what pieces are made of."""

    def __init__(self, charsmap: bytes = b"", prefix: bool = True, squeeze: bool = False, escape: bool = True):
        self.prefix, self.squeeze, self.escape = prefix, squeeze, escape
        n = int.from_bytes(charsmap[:4], "little")
        self.units = np.frombuffer(charsmap[4 : 4 + n], "<u4").tolist()
        self.written = charsmap[4 + n :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """How many bytes from a place on the longest match has, and what is written for it."""
        units, found = self.units, None
        jump = lambda unit: (unit >> 10) << ((unit & (1 << 9)) >> 6)
        state = jump(units[0])
        for k in range(at, len(data)):
            state ^= data[k]
            if state >= len(units) or units[state] & ((1 << 31) | 0xFF) != data[k]:
                break
            unit = units[state]
            state ^= jump(unit)
            if unit >> 8 & 1:
                start = units[state] & ((1 << 31) - 1)
                found = k + 1 - at, self.written[start : self.written.index(b"\0", start)]
        return found

    def mapped(self, text: str) -> str:
        if not self.units or text.isascii() and not any(ord(c) < 32 or ord(c) == 127 for c in text):
            return text
        data, out, at = text.encode("utf-8"), [], 0
        while at < len(data):
            found = self.longest(data, at)
            if found:
                out.append(found[1])
                at += found[0]
            else:
                width = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
                out.append(data[at : at + width])
                at += width
        return b"".join(out).decode("utf-8", "replace")

    def normalised(self, text: str) -> str:
        text = self.mapped(text)
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return ((" " if self.prefix else "") + text).replace(" ", SPACE) if self.escape else text


class Pieces:
    """The trie: a state is what was read since the start, so an arc leads on if its end is one of the states; written[state] is the piece that ends there."""

    def __init__(self, ids: dict[str, int]):
        self.states = {p[:n] for p in ids for n in range(1, len(p) + 1)}
        self.written = ids


class Transducer:
    def __init__(self, path: str):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.bpe, self.normaliser = False, Normaliser()
        with open(path, "rb") as f:
            for number, value in _fields(f.read()):
                if number == 1:
                    x = dict(_fields(value))
                    self.pieces.append(x[1].decode("utf-8"))
                    self.scores.append(struct.unpack("<f", x.get(2, b"\0\0\0\0"))[0])
                    self.kinds.append(x.get(3, NORMAL))
                elif number == 2:
                    self.bpe = dict(_fields(value)).get(3, 1) == 2
                elif number == 3:
                    self.normaliser = normaliser_of(value)
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k in (NORMAL, USER)}
        self.unk = self.kinds.index(UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.trie = Pieces(self.ids)
        self.worst = min(self.scores) - 10.0
        self.spelled = [bytes([int(p[3:5], 16)]) if k == BYTE else " ⁇ ".encode() if k == UNKNOWN else b"" if k == CONTROL else p.replace(SPACE, " ").encode() for p, k in zip(self.pieces, self.kinds, strict=True)]
        self.best = Best(self)
        self.pairs: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """What the merges make of a few characters: best score first, then leftmost."""
        parts = list(text)
        while len(parts) > 1:
            best, at = -math.inf, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and self.scores[k] > best:
                    best, at = self.scores[k], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, a: str, b: str) -> bool:
        """The pair automaton: whether its arc from piece a to piece b is finite ("" starts)."""
        found = self.pairs.get((a, b))
        if found is None:
            found = self.merged(a + b) == ([a, b] if a else [b]) and (not a or self.follows("", b))
            if len(self.pairs) < PAIRS:
                self.pairs[a, b] = found
        return found

    def lattice(self, text: str, j: int) -> list[tuple[int, str, float]]:
        """The arcs that leave place j of the input composed with the pieces: (place, piece or lone character, cost)."""
        out = []
        for i in range(j + 1, len(text) + 1):
            state = text[j:i]
            if state not in self.trie.states:
                break
            k = self.trie.written.get(state)
            if k is not None:
                out.append((i, state, -self.scores[k]))
        if not out or out[0][0] > j + 1:
            out.insert(0, (j + 1, text[j], -self.worst))  # the byte fallback
        return out

    def path(self, text: str) -> list[str]:
        """The pieces (or lone characters) of the shortest path through the lattice of a segment."""
        n = len(text)
        back: list[str | None] = [""] + [None] * n
        if self.bpe:
            self._finite(text, back)
        else:
            cost = [0.0] + [math.inf] * n
            for j in range(n):
                for i, piece, c in self.lattice(text, j):
                    if cost[j] + c < cost[i]:
                        back[i], cost[i] = piece, cost[j] + c
        out, i = [], n
        while i:
            out.append(back[i])
            i -= len(back[i])
        return out[::-1]

    def _finite(self, text: str, back: list[str | None]) -> None:
        """The lattice composed with the pair automaton, arc by arc as the search comes to each place: arcs of cost 0 alone, and the first that reaches a place is the only one."""
        n, known, states, written = len(text), self.pairs.get, self.trie.states, self.trie.written
        for j in range(n):
            before = back[j]
            if before is None:
                continue
            for i in range(j + 1, n + 1):
                piece = text[j:i]
                if piece not in states and i > j + 1:
                    break
                if back[i] is None and (piece in written or i == j + 1):  # a lone character without a piece is the byte fallback's
                    finite = known((before, piece))
                    if self.follows(before, piece) if finite is None else finite:
                        back[i] = piece

    def emitted(self, segment: str) -> bytes:
        """The ids of a segment as little-endian 32-bit integers, with the byte fallback for what no piece covers."""
        ids = []
        for piece in self.path(segment):
            k = self.ids.get(piece)
            if k is not None:
                ids.append(k)
            elif self.bytes:
                ids += [self.bytes[b] for b in piece.encode("utf-8")]
            else:
                ids.append(self.unk)
        return array.array("I", ids).tobytes()

    def encode(self, text: str) -> bytes:
        text = self.normaliser.normalised(text)
        if not text:
            return b""
        if SPACE * 2 in text or "\0" in text:
            segments = _SEGMENT.findall(text)
        else:
            segments = text.replace(SPACE, "\0" + SPACE).split("\0")[not text.find(SPACE) :]
        return b"".join(map(self.best.__getitem__, segments))

    def decode(self, ids) -> str:
        """The inverted transducer: pieces to characters, runs of byte pieces to UTF-8."""
        text = b"".join(map(self.spelled.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.normaliser.prefix and text.startswith(" ") else text


def transducer(path: str) -> Transducer:
    if path not in _state:
        _state[path] = Transducer(path)
    return _state[path]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids."""
    kind = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        t = transducer(model_path)
        for b in small(batches):
            found = [np.frombuffer(t.encode(x), "<i4") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind.field(1).type)], schema=kind)

    return text_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text; null ids are no ids."""
    kind = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        t = transducer(model_path)
        for b in small(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t.decode(x or ()) for x in b.column(1).to_pylist()], pa.string())], schema=kind)

    return encoded.select(encoded[id_col].cast("long").alias("doc_id"), encoded[ids_col].cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_ids, ids_crc32, n_decoded (characters of the decoded text), same (as the text)."""
    kind = pa.schema([("doc_id", pa.int64()), ("n_ids", pa.int64()), ("ids_crc32", pa.int64()), ("n_decoded", pa.int64()), ("same", pa.bool_())])

    def run(batches):
        t = transducer(model_path)
        for b in small(batches):
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = t.encode(text)
                back = t.decode(np.frombuffer(ids, "<i4").tolist())
                rows.append({"doc_id": doc, "n_ids": len(ids) // 4, "ids_crc32": zlib.crc32(ids), "n_decoded": len(back), "same": back == text.replace(SPACE, " ")})
            yield pa.RecordBatch.from_pylist(rows, schema=kind)

    return text_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, n_decoded long, same boolean")
