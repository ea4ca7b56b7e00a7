"""Best-fit packing of documents into token sequences, by vector best-fit on counts of sizes.

`token_pieces` turns each document into token ids (and an end id) and cuts only those longer than
a sequence, into full pieces after a first one that may be shorter.  `pack` gives every piece a
sequence and an offset.  Pieces of one size are interchangeable, so the choice of bins needs only
the number of pieces of each size: at most `limit` rows reach the driver, whatever the input.  Sizes
are placed from large to small.  Bins in one state (tokens, documents and attention cost used)
are handled together; of the states in which a piece fits under every one of the three capacities, it
goes to the one with the least weighted norm of what then remains.  The plan is a list of rank
intervals of each size; pieces find theirs by their rank, which is counted per size and shard.

Capacities: tokens `limit`; documents `max_docs`; attention cost, the sum of squared lengths,
`max_cost`.  By default the last two bind no sooner than the first, as the fewest sequences are wanted: a sequence
with fewer documents or less attention than its tokens allow would leave tokens empty.  All three count in
the norm, so among bins of equal tokens the one whose other capacities are used most is filled first.

Ids are those of the tokenizers library; where a vocabulary's ids follow its merges, a faster encoder built
from the same file makes them, which tests compare with the library.

Defined results: null text counts as empty, an empty document is the end id alone; repeated rows
are packed each; an empty table gives no rows; a null doc_id stays null.
"""

from __future__ import annotations

import array
import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import checkpointed, small, text_of

LIMIT = 1024
#: Entries that a worker's cache of parts and their ids can hold; parts seen later are encoded again.
CACHE = 600_000
#: Longer parts are left to the library that has no quadratic case.
LONG_PART = 200
_FAR_SPACE = re.compile(r"\s\s\s|\s\s\Z")
_state: dict = {}


def ranks(path: str) -> dict[bytes, int] | None:
    """Bytes and ids of a byte-level vocabulary, or None if its ids don't follow its merges."""
    model = json.loads(open(path, encoding="utf-8").read())["model"]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if merged != sorted(merged):
        return None
    return {bytes(back[c] for c in token): i for token, i in model["vocab"].items()}


class Parts(dict):
    """Ids of parts of texts, as bytes."""

    def __init__(self, encode, whole):
        self.encode, self.whole = encode, whole

    def __missing__(self, part: str) -> bytes:
        if len(part) > LONG_PART:
            return self.whole(part)
        ids = array.array("I", self.encode(part)).tobytes()
        if len(self) < CACHE:
            self[part] = ids
        return ids


class Encoder:
    """Ids of whole texts as little-endian 32-bit integers.

    The vocabulary's pre-tokens never reach over a space that follows no white space and precedes
    none, so a text is cut before each of its spaces and the parts are looked up; a text with
    longer runs of white space, a special token or a zero byte is encoded in one piece.  Where the
    ids follow the merges, a faster encoder that is built from the same file serves new parts.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        known = ranks(path)
        plain = {b: i for b, i in known.items() if b.decode("utf-8", "replace") not in self.special} if known else None
        fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=plain, special_tokens={}).encode_ordinary if plain else None
        self.parts = Parts(fast or (lambda x: self.tokenizer.encode(x, add_special_tokens=False).ids), self.whole)

    def whole(self, text: str) -> bytes:
        return array.array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def ids(self, text: str) -> bytes:
        if "\0" in text or any(x in text for x in self.special) or _FAR_SPACE.search(text):
            return self.whole(text)
        return b"".join(map(self.parts.__getitem__, text.replace(" ", "\0 ").split("\0")))


def encoder(path: str) -> Encoder:
    if path not in _state:
        _state[path] = Encoder(path)
    return _state[path]


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 2, limit: int = LIMIT, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and the ids themselves if asked for."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        enc = encoder(tokenizer_path)
        for batch in small(batches):
            out: dict[str, list] = {k: [] for k in kind.names}
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = enc.ids(text) + end
                n = len(ids) // 4
                first = n % limit or limit
                for piece, start in enumerate([0, *range(first, n, limit)]):
                    own = ids[4 * start : 4 * (start + limit if piece else first)]
                    row = (doc, piece, start, len(own) // 4, zlib.crc32(own), *([np.frombuffer(own, "<u4").tolist()] * with_ids))
                    for k, v in zip(out, row, strict=True):
                        out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=kind)

    kind = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.list_(pa.int64()))] * with_ids)])
    return text_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids)


def best_fit(counts: dict[int, int], limit: int = LIMIT, max_docs: int | None = None, max_cost: int | None = None, weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3)) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """The plan for so many pieces of each size, and its number of bins.

    A row (size, rank_lo, rank_hi, bin_lo, each, offset) sends the pieces of a size with ranks from
    rank_lo on to the bins from bin_lo on, `each` to a bin, the first of them at offset.
    """
    max_docs, max_cost = max_docs or limit, max_cost or limit * limit
    caps, w = np.array([limit, max_docs, max_cost], dtype=float), np.array(weights)
    left = np.zeros((0, 3))  # what remains in the bins of each group
    lo, hi = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    plan, bins = [], 0
    for size in sorted((s for s, n in counts.items() if n > 0), reverse=True):
        if size > limit or size * size > max_cost:
            raise ValueError(f"a piece of {size} tokens fits no empty sequence")
        need = np.array([size, 1, size * size], dtype=float)
        rank, n = 0, counts[size]
        while rank < n:
            fits = np.flatnonzero((left >= need).all(axis=1))
            if len(fits):
                k = fits[np.argmin((((left[fits] - need) / caps) ** 2 * w).sum(axis=1))]
                state, first, m = left[k], int(lo[k]), int(hi[k] - lo[k])
            else:
                k, state, first, m = None, caps.copy(), bins, n - rank
            each = int(min(state // need))
            whole = min(m, (n - rank) // each)
            parts = [(whole, each)] if whole else []
            if whole < m and (n - rank) - whole * each:
                parts.append((1, (n - rank) - whole * each))
            for count, items in parts:
                plan.append((size, rank, rank + count * items, first, items, int(limit - state[0])))
                rest = state - items * need
                if rest.min() > 0:
                    left, lo, hi = np.vstack([left, rest]), np.append(lo, first), np.append(hi, first + count)
                rank, first = rank + count * items, first + count
            if k is None:
                bins = first
            elif first < hi[k]:
                lo[k] = first
            else:
                left, lo, hi = np.delete(left, k, 0), np.delete(lo, k), np.delete(hi, k)
    return plan, bins


def pack(pieces: DataFrame, limit: int = LIMIT, max_docs: int | None = None, max_cost: int | None = None, order: tuple[str, ...] = ("doc_id", "piece", "ids_crc32")) -> DataFrame:
    """pieces (with a column length; written once, as two passes read it) with sequence_id and offset."""
    spark = pieces.sparkSession
    shards = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    items = checkpointed(pieces).withColumn("__shard", F.pmod(F.xxhash64(*order), F.lit(shards)).cast("int"))
    per = items.groupBy("length", "__shard").agg(F.count(F.lit(1)).alias("__n"))
    counts = {r["length"]: r["n"] for r in per.groupBy("length").agg(F.sum("__n").alias("n")).collect()}  # limit rows at most
    plan, _ = best_fit(counts, limit, max_docs, max_cost)
    steps = spark.createDataFrame(plan, "length long, __lo long, __hi long, __bin long, __each long, __at long")
    before = per.select("length", "__shard", (F.sum("__n").over(Window.partitionBy("length").orderBy("__shard")) - F.col("__n")).alias("__before"))
    ranked = items.withColumn("__rank", F.row_number().over(Window.partitionBy("length", "__shard").orderBy(*order)) - 1)
    ranked = ranked.join(before, ["length", "__shard"])  # both are already dealt by these keys
    ranked = ranked.withColumn("__rank", F.col("__rank") + F.col("__before")).drop("__before", "__shard")
    here = (F.col("__rank") >= F.col("__lo")) & (F.col("__rank") < F.col("__hi"))
    placed = ranked.join(F.broadcast(steps.withColumnRenamed("length", "__length")), (F.col("length") == F.col("__length")) & here)
    nth = F.col("__rank") - F.col("__lo")
    return placed.select(*pieces.columns, (F.col("__bin") + F.floor(nth / F.col("__each"))).alias("sequence_id"), (F.col("__at") + F.pmod(nth, F.col("__each")) * F.col("length")).alias("offset"))
