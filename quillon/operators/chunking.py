"""Cutting documents into chunks and joining them again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.lines import count_words, let, split_lines, trim_all

CHUNK = "struct<id:int,content:string,start_line:int,end_line:int,overlap:string>"
PAGE_BREAK = "\n\n---\n\n"


def _line_ends(text: Column) -> Column:
    return F.size(split_lines(text))


def word_chunks(text: Column, target: int = 2500, overlap: int = 200) -> Column:
    """Chunks of whole paragraphs, greedily filled to target words; a longer paragraph is a chunk of its own.

    overlap: trailing paragraphs of the chunk before, of so many words at least, as context only.
    """
    paragraphs = F.transform(F.split(text, "\n\n", -1), lambda p: F.struct(p.alias("p"), count_words(p).alias("n")))
    groups = "array<array<struct<p:string,n:int>>>"
    none = F.array().cast("array<struct<p:string,n:int>>")
    zero = F.struct(none.alias("now"), F.lit(0).alias("n"), F.array().cast(groups).alias("out"))

    def step(acc, p):
        flush = (acc["n"] + p["n"] > target) & (F.size(acc["now"]) > 0)
        fresh = F.struct(F.array(p).alias("now"), p["n"].alias("n"), F.concat(acc["out"], F.array(acc["now"]).cast(groups)).alias("out"))
        return F.when(flush, fresh).otherwise(F.struct(F.concat(acc["now"], F.array(p)).alias("now"), (acc["n"] + p["n"]).alias("n"), acc["out"].alias("out")))

    groups_ = F.aggregate(paragraphs, zero, step, lambda acc: F.when(F.size(acc["now"]) > 0, F.concat(acc["out"], F.array(acc["now"]).cast(groups))).otherwise(acc["out"]))

    def tail(group):
        zero_ = F.struct(none.alias("kept"), F.lit(0).alias("n"))
        take = lambda acc, p: F.when(acc["n"] >= overlap, acc).otherwise(F.struct(F.concat(F.array(p), acc["kept"]).alias("kept"), (acc["n"] + p["n"]).alias("n")))
        return F.aggregate(F.reverse(group), zero_, take, lambda acc: F.array_join(F.transform(acc["kept"], lambda p: p["p"]), "\n\n"))

    content = lambda group: F.array_join(F.transform(group, lambda p: p["p"]), "\n\n")

    def placed(groups, texts):
        sizes = F.transform(texts, _line_ends)
        before = lambda lines, i: F.aggregate(F.slice(lines, 1, i), F.lit(0), lambda acc, n: acc + n + 1)
        chunk = lambda lines, t, i: F.struct(
            i.alias("id"), t.alias("content"), before(lines, i).alias("start_line"), (before(lines, i) + F.get(lines, i) - 1).alias("end_line"), F.when(i > 0, tail(F.get(groups, i - 1))).alias("overlap")
        )
        return let(lambda lines: F.transform(texts, lambda t, i: chunk(lines, t, i)), sizes)

    made = let(lambda gs: let(lambda ts: placed(gs, ts), F.transform(gs, content)), groups_)
    whole = F.array(F.struct(F.lit(0).alias("id"), text.alias("content"), F.lit(0).alias("start_line"), (_line_ends(text) - 1).alias("end_line"), F.lit(None).cast("string").alias("overlap")))
    return F.when(count_words(text) <= target, whole).otherwise(made)


def merge_chunks(contents: Column) -> Column:
    """Chunks joined by blank lines; blank chunks after the first are skipped."""

    def join(acc, c):
        gap = F.when(acc.endswith("\n\n"), "").when(acc.endswith("\n"), "\n").otherwise("\n\n")
        return F.when(trim_all(c) == "", acc).otherwise(F.concat(acc, gap, c))

    rest = F.slice(contents, 2, F.greatest(F.size(contents) - 1, F.lit(0)))
    return F.when(F.size(contents) == 0, F.lit("")).otherwise(F.aggregate(rest, F.get(contents, 0), join))


def line_cuts(lines: Column, target: int, snap: int, least: int) -> Column:
    """Structs (s, e) of chunks of about target lines, e not included: cut after a blank line near by (forward first), a short rest taken in."""
    cuts = "array<struct<s:int,e:int>>"

    def cut(blanks: Column, n: Column) -> Column:
        def end(start: Column) -> Column:
            plain = F.least(start + target, n)
            low = F.greatest(plain - snap, start)
            after = F.array_position(F.slice(blanks, plain + 1, F.least(F.lit(snap), n - plain)), True)
            before = F.array_position(F.reverse(F.slice(blanks, low + 1, plain - low)), True)
            return F.when(n - plain < least, n).when(after > 0, plain + after).when(before > 0, plain - before + 1).otherwise(plain).cast("int")

        def step(acc, _):
            more = let(lambda e: F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("s"), e.alias("e")))).alias("out")), end(acc["at"]))
            return F.when(acc["at"] >= n, acc).otherwise(more)

        most = F.ceil(n / max(target - snap, 1)).cast("int")
        return F.aggregate(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), F.struct(F.lit(0).alias("at"), F.array().cast(cuts).alias("out")), step, lambda acc: acc["out"])

    return let(cut, F.transform(lines, lambda x: trim_all(x) == ""), F.size(lines))


def line_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", target: int = 2500, overlap: int = 60, snap: int = 50) -> DataFrame:
    """Rows (doc_id, chunk_id, content, start_line, end_line, context): about target lines each; context is what stands before the chunk."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), split_lines(F.coalesce(F.col(text_col), F.lit(""))).alias("lines"))
    rows = rows.select("doc_id", "lines", F.posexplode_outer(line_cuts(F.col("lines"), target, snap, max(100, target // 5))).alias("chunk_id", "c"))
    s, e = F.col("c.s"), F.col("c.e")
    part = lambda a, b: F.array_join(F.slice("lines", a + 1, b - a), "\n")
    low = F.greatest(s - overlap, F.lit(0))
    return rows.select("doc_id", "chunk_id", part(s, e).alias("content"), s.alias("start_line"), (e - 1).alias("end_line"), F.when(F.col("chunk_id") > 0, part(low, s)).alias("context"))


def split_pages(text: Column) -> Column:
    """Structs (index, markdown)."""
    return F.transform(F.split(text, PAGE_BREAK, -1), lambda p, i: F.struct(i.alias("index"), p.alias("markdown")))


def join_pages(pages: Column) -> Column:
    return F.array_join(F.transform(pages, lambda p: p["markdown"]), PAGE_BREAK)


