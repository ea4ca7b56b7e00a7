"""Optional services: OCR, section boundaries, rewriting.

None is needed: without one, detectors and the rules of the reflow stand in.  A provider is a function
on one document's text that may fail; it runs in Arrow batches with retries, and a failure is a row.
"""

from __future__ import annotations

import random
import re
import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.segments import CODE, TABLE

Provider = Callable[[str], str]


class Retry(Exception):
    """Raised by a provider for what may pass: rate limits, timeouts, server errors."""


def with_retries(provider: Provider, text: str, tries: int = 3, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, str | None]:
    """(reply, error): waits double from try to try, with up to half as much again at random."""
    for k in range(tries):
        try:
            return provider(text), None
        except Retry as e:
            error = f"retry: {e}"
            if k + 1 < tries:
                sleep(wait * 2**k * (1 + random.random() / 2))
        except Exception as e:  # a provider's failure is the document's, not the job's
            return None, f"{type(e).__name__}: {e}"
    return None, error


def ask(docs: DataFrame, provider: Provider, id_col: str = "doc_id", text_col: str = "text", tries: int = 3, wait: float = 1.0) -> DataFrame:
    """doc_id, reply, error."""
    kind = pa.schema([("doc_id", pa.int64()), ("reply", pa.string()), ("error", pa.string())])

    def run(batches):
        for b in batches:
            got = [with_retries(provider, t, tries, wait) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r for r, _ in got], pa.string()), pa.array([e for _, e in got], pa.string())], schema=kind)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, "doc_id long, reply string, error string")


#: What a rewriter never sees: tables and code.
_KEPT = re.compile("(" + "|".join(p.replace("(?m)", "") for p in (TABLE, CODE)) + ")", re.M)


def passages(text: str, target: int) -> list[str]:
    """Whole paragraphs, greedily filled to target words."""
    out: list[list[str]] = [[]]
    n = 0
    for p in text.split("\n\n"):
        k = len(p.split())
        if out[-1] and n + k > target:
            out.append([])
            n = 0
        out[-1].append(p)
        n += k
    return ["\n\n".join(x) for x in out]


def _rewritten(text: str, provider: Provider, target: int, least_words: int, tries: int, wait: float) -> str:
    def one(part: str) -> str:
        body = part.strip("\n")
        if not body.strip() or len(body.split()) < least_words:
            return part
        reply, _ = with_retries(provider, body, tries, wait)
        n = len(body.split())
        kept = reply is not None and 0.98 <= len(reply.split()) / max(n, 1) <= 1.02
        return part.replace(body, reply, 1) if kept else part

    plain = lambda x: "\n\n".join(map(one, passages(x, target if not least_words else 1)))
    parts = _KEPT.split(text)
    return "".join(x if k % 2 else plain(x) for k, x in enumerate(parts) if x is not None)


def rewritten(df: DataFrame, provider: Provider, text_col: str, out_col: str, target: int = 2500, least_words: int = 0, tries: int = 3, wait: float = 1.0) -> DataFrame:
    """df with a column of rewritten texts; tables and code are kept, and so is a passage whose rewrite fails or has other words by number.

    Passages are of about target words, or with least_words single paragraphs of so many words at least.  A row stays where
    it is: nothing is joined or shuffled.
    """
    at = df.columns.index(text_col)
    schema = df.withColumn(out_col, F.lit(None).cast("string")).schema

    def run(batches):
        for b in batches:
            new = [None if t is None else _rewritten(t, provider, target, least_words, tries, wait) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(new, pa.string())], names=[*b.schema.names, out_col])

    return df.mapInArrow(run, schema)


def retry_failed(docs: DataFrame, replies: DataFrame, provider: Provider, id_col: str = "doc_id", text_col: str = "text", tries: int = 3, wait: float = 1.0) -> DataFrame:
    """replies with the failed rows asked again; a document's failure is its own row's."""
    failed = replies.filter(F.col("error").isNotNull()).select(F.col("doc_id").alias("__id"))
    again = ask(docs.join(failed, docs[id_col].cast("long") == failed["__id"], "left_semi"), provider, id_col, text_col, tries, wait)
    return replies.filter(F.col("error").isNull()).unionByName(again)
