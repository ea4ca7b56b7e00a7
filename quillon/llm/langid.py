"""Language identification by error-correcting output codes.

Each language has a codeword of bits; one binary classifier per bit predicts it from character
n-grams; loss-weighted decoding adds, over the bits, what each codeword loses by a bit's margin,
weighted by how reliable that bit was in training, and chooses the codeword that loses least.  A
small lead over the second one marks a text as ambiguous.

Up to `EXHAUSTIVE` languages get the exhaustive code (all bipartitions); more get the rows of a
Hadamard matrix, so any two codewords differ in half of the bits.  A classifier's weights are
smoothed log odds of hashed 2- to 4-byte n-grams of the lower-cased letters; its margin is their
mean over the whole text, scaled by a fit on the sample.

Training takes about `PER_LANGUAGE` distinct texts of each of the `LANGUAGES` most frequent languages (documented
bounds), chosen by a hash of the text, so that a text counts once however often it was copied; of a
longer text it takes a window of `TRAIN_CHARS` characters, placed by the hash.  A language with any text has one in
the sample.  Everything learned is a table of fixed size.  Prediction reads whole texts.

Defined results: null texts and texts without a letter are `und` with score 0; where nothing can
be learned, all are `und`; one learned language is predicted for all other texts; ties go to the
language that sorts first.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import kept_rows, small

PER_LANGUAGE = 400
TRAIN_CHARS = 20_000
LANGUAGES = 256
BUCKETS = 1 << 16
EXHAUSTIVE = 5
AMBIGUOUS = 0.2
#: Bytes of text that are turned into n-grams at a time.
BLOCK = 1 << 18

_LETTER = re.compile(r"[^\W\d_]")
#: ASCII bytes other than letters become spaces.
_KEEP = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def grams(text: str):
    """Arrays of hashed n-grams, block by block; blocks overlap by nothing but a few lost n-grams' worth of bytes."""
    data = b" " + b" ".join(text.lower().encode("utf-8").translate(_KEEP).split()) + b" "
    for at in range(0, len(data), BLOCK):
        b = np.frombuffer(data[at : at + BLOCK + 3], dtype=np.uint8).astype(np.uint32)
        two = b[:-1] | b[1:] << np.uint32(8)
        three = two[:-1] | b[2:] << np.uint32(16)
        four = three[:-1] | b[3:] << np.uint32(24)
        for k, codes in enumerate((two, three, four)):
            yield ((codes + np.uint32(0x9E3779B9 * (k + 1) & 0xFFFFFFFF)) * np.uint32(2654435761)) >> np.uint32(16)


def codebook(n: int) -> np.ndarray:
    """n codewords of -1 and 1."""
    if n <= EXHAUSTIVE:
        bits = [[1 if not i or (k >> (n - 1 - i)) & 1 else -1 for i in range(n)] for k in range((1 << (n - 1)) - 1)]
        return np.array(bits, dtype=np.float32).reshape(-1, n).T
    size = 1
    while size < n:
        size *= 2
    size = max(size, 16)
    h = np.array([[1.0]], dtype=np.float32)
    while len(h) < size:
        h = np.block([[h, h], [h, -h]])
    return h[:n, 1:]


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits
    bias: np.ndarray
    trust: np.ndarray

    def margins(self, text: str) -> np.ndarray:
        total, n = np.zeros(self.code.shape[1]), 0
        for g in grams(text):
            total += self.weights[g].sum(axis=0, dtype=np.float64)
            n += len(g)
        return total / max(n, 1) - self.bias

    def losses(self, text: str) -> np.ndarray:
        m = np.clip(self.margins(text), -30, 30)
        return (self.trust * np.log1p(np.exp(-self.code * m))).sum(axis=1) / max(self.trust.sum(), 1e-9)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not self.langs or not text or not _LETTER.search(text):
            return "und", 0.0, True
        if len(self.langs) == 1:
            return self.langs[0], 1.0, False
        loss = self.losses(text)
        share = np.exp(-4 * (loss - loss.min()))
        best = int(np.argmin(loss))
        lead = float(np.partition(loss, 1)[1] - loss[best])
        return self.langs[best], float(1 / share.sum()), lead < AMBIGUOUS


def fit(sample: list[tuple[str, str]]) -> Model:
    """A model from (language, text); the same for the same sample in any order."""
    sample = sorted(sample)
    langs = sorted({lang for lang, _ in sample})
    code = codebook(len(langs)) if len(langs) > 1 else np.ones((len(langs), 1), dtype=np.float32)
    counts = np.zeros((len(langs), BUCKETS))
    per = []
    for lang, text in sample:
        c = np.zeros(BUCKETS, dtype=np.float32)
        for g in grams(text):
            c += np.bincount(g, minlength=BUCKETS)
        per.append((langs.index(lang), (ids := np.flatnonzero(c)), c[ids]))
        counts[langs.index(lang)] += c / max(c.sum(), 1)
    counts /= np.maximum(counts.sum(axis=1, keepdims=True), 1e-9)
    bits = code.shape[1]
    smooth = 1.0 / BUCKETS
    weights = np.zeros((BUCKETS, bits), dtype=np.float32)
    for k in range(bits):
        pos, neg = code[:, k] > 0, code[:, k] < 0
        if pos.any() and neg.any():
            weights[:, k] = np.log((counts[pos].mean(axis=0) + smooth) / (counts[neg].mean(axis=0) + smooth))
    if len(langs) < 2:
        return Model(langs, code, weights, np.zeros(bits), np.ones(bits))
    margin = np.array([(c @ weights[ids]) / max(c.sum(), 1) for _, ids, c in per])
    truth = code[[i for i, *_ in per]]
    bias, scale, trust = np.zeros(bits), np.ones(bits), np.ones(bits)
    for k in range(bits):
        m, y = margin[:, k], truth[:, k]
        # The cut that errs least on the sample, midway between neighbours; then a scale that puts a typical margin at 4.
        order = np.argsort(m, kind="stable")
        ym, mm = y[order], m[order]
        errs = np.concatenate([[np.sum(ym < 0)], np.sum(ym < 0) + np.cumsum(ym)])
        best = np.flatnonzero(errs == errs.min())
        at = int(best[len(best) // 2])
        bias[k] = (mm[max(at - 1, 0)] + mm[min(at, len(mm) - 1)]) / 2
        right = (m - bias[k]) * y
        scale[k] = 4 / max(float(np.median(np.abs(m - bias[k]))), 1e-6)
        trust[k] = max(1 - 2 * float(np.mean(right <= 0)), 0.01)
    return Model(langs, code, (weights * scale).astype(np.float32), bias * scale, trust)


def crc_of(doc_id: Column) -> Column:
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8"))


def training_rows(docs: DataFrame, usable: Column, per_language: int = PER_LANGUAGE, lang_col: str = "lang", text_col: str = "text") -> list[tuple[str, str]]:
    """About per_language (language, window of a distinct text) of each language, by a hash of the text."""
    rows = docs.filter(usable).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).withColumn("h", F.pmod(F.xxhash64("text"), F.lit(1 << 30)))
    known = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("h", 0.02).alias("texts"), F.min("h").alias("low"))
    sizes = known.orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not sizes:
        return []
    # A hash below the share is in the sample; the smallest of a language always is.
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], max(float(min(1.0, per_language / max(r["texts"], 1))) * (1 << 30), r["low"] + 0.5))])
    start = F.when(F.length("text") > TRAIN_CHARS, F.pmod(F.col("h"), F.length("text") - TRAIN_CHARS + 1)).otherwise(0).cast("int") + 1
    chosen = rows.filter(F.col("h") < F.element_at(share, F.col("lang"))).select("lang", "h", F.substring(F.col("text"), start, F.lit(TRAIN_CHARS)).alias("text"))
    return [(r["lang"], r["text"]) for r in chosen.groupBy("lang", "h").agg(F.max("text").alias("text")).select("lang", "text").collect()]


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, ambiguous."""
    kind = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x bits numbers, a fixed size

    def run(batches):
        m = shared.value
        for b in small(batches):
            found = [m.predict(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([f[k] for f in found], kind.field(k + 1).type) for k in range(3))], schema=kind)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(crc_of(doc_id), F.lit(5)) == 0, F.lit(True))


def train(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", per_language: int = PER_LANGUAGE) -> Model:
    return fit(training_rows(docs, ~held_out(F.col(id_col)), per_language, lang_col, text_col))


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs without the rows of no language (`und`); all columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make_test():
        m = shared.value
        return lambda text: m.predict(text)[0] != "und"

    return kept_rows(docs, text_col, make_test)
