"""SimHash near-dedup with a byte-position inverted index and count filtering.

A fingerprint has 64 bits: bit k is 1 if it is set in over half of the XXH64 values (seed 42) of a
text's word shingles.  Two fingerprints that differ in at most `BITS` = 3 bits differ in at most
three of their eight bytes, so they share at least `MINIMUM` = five positional bytes; that is the guaranteed
minimum of the count filter.  A posting is a set of positions with a fingerprint's bytes there.  `FOURS` are
sets of four positions of which every five positions hold one, so each pair that can pass the filter meets in
one of their lists; `FIVES` are all sets of five.  Only distinct fingerprints are indexed.  Pairs that meet have
their shared positional bytes tallied, those that reach the minimum are verified bit by bit.

Lists of over `LONG_LIST` fingerprints are never paired.  Their members move to the lists of five positions, where
each pair that counts meets again; what is in lists that are long even there is linked through common
neighbours, in a number of rows that is a multiple of the members' (`_through_neighbours`): all pairs of such a
group are neither needed nor made.  No link is lost in any of the three, whatever the sizes.

Linked fingerprints form components by alternating large-star and small-star steps, each cut off
by a checkpoint, until a step leaves the edges as they were.

Defined results: null and empty texts have the fingerprint zero and are linked like any other; a
text with fewer words than a shingle has one shingle, all its words; rows with one doc_id count as
one node; a null doc_id is never the smallest id of a component that has another.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import checkpointed, small, text_of, to_members

BITS = 3
MINIMUM = 8 - BITS
LONG_LIST = 64
#: Bytes of text whose shingles are hashed at a time.
BLOCK = 1 << 20


def shingle_hashes(text: str, size: int):
    """Arrays of the XXH64 values of the text's word shingles, block by block."""
    from xxhash import xxh64_intdigest as xxh64

    data, at, carry, some = text.encode("utf-8").lower(), 0, [], False
    while at < len(data):
        end = at + BLOCK
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        words = carry + data[at:end].split()
        at = end
        if len(words) >= size:
            norm, some = b" ".join(words), True
            ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
            starts = (np.append(-1, ends[:-1]) + 1)[: len(words) - size + 1].tolist()
            yield np.array([xxh64(norm[a:b], 42) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)], dtype=np.uint64)
        carry = words[-(size - 1) :] if len(words) >= size and size > 1 else words if len(words) < size else []
    if not some and carry:
        yield np.array([xxh64(b" ".join(carry), 42)], dtype=np.uint64)


def fingerprint(text: str, size: int) -> int:
    """The signed 64-bit fingerprint of a text."""
    ones, n = np.zeros(64, dtype=np.int64), 0
    for h in shingle_hashes(text, size):
        for at in range(0, len(h), 1 << 14):
            part = h[at : at + (1 << 14)]
            ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (64 bits as a long)."""
    kind = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for b in small(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t, size) for t in b.column(1).to_pylist()], pa.int64())], schema=kind)

    return text_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def covering(size: int, of: int) -> list[tuple[int, ...]]:
    """Sets of `size` of the eight positions such that any `of` positions hold one of them; greedy, the first best one each time."""
    left, out = set(combinations(range(8), of)), []
    while left:
        best = max(combinations(range(8), size), key=lambda c: sum(set(c) <= set(x) for x in left))
        out.append(best)
        left = {x for x in left if not set(best) <= set(x)}
    return out


FOURS, FIVES = covering(4, MINIMUM), covering(5, MINIMUM)


def _mask(positions) -> int:
    m = sum(0xFF << (8 * k) for k in positions)
    return m - (1 << 64) if m >= 1 << 63 else m


def _met(prints: DataFrame, sets: list[tuple[int, ...]], bits: int, long_list: int) -> tuple[DataFrame, DataFrame]:
    """The verified pairs a < b of short lists, and the distinct members of long ones."""
    masks = F.array(*[F.struct(F.lit(i).cast("byte").alias("slot"), F.lit(_mask(t)).alias("mask")) for i, t in enumerate(sets)])
    postings = prints.select("fp", F.explode(masks).alias("m")).select("m.slot", F.col("fp").bitwiseAND(F.col("m.mask")).alias("key"), "fp")
    sizes = postings.groupBy("slot", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = checkpointed(postings.join(sizes, ["slot", "key"]))
    short = shared.filter(F.col("n") <= long_list).drop("n")
    x = F.col("fp").bitwiseXOR(F.col("fp2"))
    tally = reduce(lambda a, b: a + b, [(x.bitwiseAND(F.lit(_mask([k]))) == 0).cast("int") for k in range(8)])
    met = short.join(short.withColumnRenamed("fp", "fp2"), ["slot", "key"]).filter((F.col("fp") < F.col("fp2")) & (tally >= 8 - bits))
    return met.filter(F.bit_count(x) <= bits).select(F.col("fp").alias("a"), F.col("fp2").alias("b")).distinct(), shared.filter(F.col("n") > long_list).select("fp").distinct()


def links(prints: DataFrame, bits: int = BITS, long_list: int = LONG_LIST) -> DataFrame:
    """Pairs a < b of the distinct fingerprints in prints (column fp) that differ in at most `bits` <= 3 bits.

    They have the components of all such pairs; all of them that share a short list are there.
    """
    if bits > BITS:
        raise ValueError("the postings guarantee pairs of up to three different bits")
    pairs, crowded = _met(prints, FOURS, bits, long_list)
    if crowded.take(1):
        finer, crowded = _met(checkpointed(crowded), FIVES, bits, long_list)
        pairs = pairs.unionByName(finer)
        if crowded.take(1):
            pairs = pairs.unionByName(_through_neighbours(checkpointed(crowded), bits))
    return pairs.distinct()


def _flipped(name: str, most: int) -> Column:
    """SQL: the 64-bit numbers within `most` <= 2 bits of column `name`."""
    one = f"transform(sequence(0, 63), i -> {name} ^ shiftleft(1L, i))"
    two = f"flatten(transform(sequence(0, 62), i -> transform(sequence(i + 1, 63), j -> {name} ^ shiftleft(1L, i) ^ shiftleft(1L, j))))"
    return F.expr(f"concat({', '.join([f'array({name})', one, two][: most + 1])})")


def _through_neighbours(prints: DataFrame, bits: int) -> DataFrame:
    """True links with the components of all links between prints, without all pairs.

    Let v be any number within half of `bits` of some prints: these are links of one another, and the
    smallest stands for them.  If two prints are linked, one of them has such a v which the other reaches with the rest
    of the bits, so it's enough to link whatever reaches v with the one that stands for it.
    """
    near = bits // 2
    at = lambda most: prints.select("fp", F.explode(_flipped("fp", most)).alias("v"))
    centres = at(near).groupBy("v").agg(F.min("fp").alias("centre"))
    linked = at(bits - near).join(centres, "v").filter("fp <> centre")
    return linked.select(F.least("fp", "centre").alias("a"), F.greatest("fp", "centre").alias("b")).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for edges (a, b) between longs: every node gets the smallest node it reaches."""
    now, before = checkpointed(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()), None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        nearer = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        last, now = now, checkpointed(nearer.filter("u <> v").distinct())
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first())
        if state == before and now.join(last, ["u", "v"], "left_semi").count() == state[0]:
            roots = now.select(F.col("v").alias("node")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.withColumn("root", F.col("node")))
        before = state
    raise RuntimeError("components did not settle")


def near_components(docs: DataFrame, size: int = 3, bits: int = BITS, long_list: int = LONG_LIST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, fp, component_id."""
    prints = checkpointed(fingerprints(docs, size, id_col, text_col))
    classes = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("size")))
    roots = components(links(classes.select("fp"), bits, long_list))
    own = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "low", "size", F.coalesce("root", "fp").alias("root"))
    best = own.groupBy("root").agg(F.min("low").alias("component_id"))
    labels = checkpointed(own.join(best, "root").select("fp", "size", "component_id"))
    return to_members(prints, labels, "fp", "size").select("doc_id", "fp", "component_id")
