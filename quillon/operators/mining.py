"""What a document repeats: running headers and footers, and the style of its numbers and notes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed
from ..functions.lines import let, trim, trim_line


def line_view(docs: DataFrame, id_col: str = "doc_id", lines_col: str = "lines") -> DataFrame:
    """doc_id, line_no, line, trimmed, n_lines.

    The outer form, as for the inner one Spark would infer a filter on the array and evaluate what
    makes it once more for that, further below.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.size(lines_col).alias("n_lines"), F.posexplode_outer(lines_col).alias("line_no", "line")).filter(F.col("line_no").isNotNull())
    return rows.select("doc_id", "line_no", "line", trim(F.col("line")).alias("trimmed"), "n_lines")


def line_frequencies(view: DataFrame) -> DataFrame:
    """doc_id, trimmed, n, first_line, last_line of the lines that aren't blank."""
    return view.filter("trimmed <> ''").groupBy("doc_id", "trimmed").agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))


def could_run(line: Column) -> Column:
    """Whether a trimmed line may be a running header or footer."""
    low = F.lower(line)
    return F.length(line).between(3, 80) & ~line.rlike(r"^[#\-*]") & (~line.contains(".") | (F.length(line) <= 50)) & ~low.startswith("chapter") & ~low.startswith("part ")


def running_lines(docs: DataFrame, id_col: str = "doc_id", lines_col: str = "lines", least: int = 3) -> DataFrame:
    """doc_id, line, kind (header or footer), n, first_line: lines that return at even distances.

    Of documents of over 50 lines: at least three times, over 30 percent of the document or more, each gap
    between 0.3 and 2.5 times the (whole) mean gap.  One shuffle by document and line.
    """
    view = line_view(docs, id_col, lines_col).filter((F.col("trimmed") != "") & could_run(F.col("trimmed")))
    w = Window.partitionBy("doc_id", "trimmed").orderBy("line_no")
    gaps = view.withColumn("gap", F.col("line_no") - F.lag("line_no").over(w))
    found = gaps.groupBy("doc_id", "trimmed").agg(
        F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.max("n_lines").alias("n_lines"), F.min("gap").alias("low"), F.max("gap").alias("high"), F.sum("gap").alias("total")
    )
    mean = F.floor(F.col("total") / (F.col("n") - 1))
    even = (F.col("low") >= mean * 0.3) & (F.col("high") <= mean * 2.5)
    found = found.filter((F.col("n_lines") > 50) & (F.col("n") >= least) & ((F.col("last_line") - F.col("first_line")) / F.col("n_lines") >= 0.3) & even)
    line = F.col("trimmed")
    capitals = (line == F.upper(line)) & line.contains(" ")
    header = capitals & ((F.length(line) > 10) | ~line.contains(" & "))
    return found.select("doc_id", line.alias("line"), F.when(header, "header").otherwise("footer").alias("kind"), "n", "first_line")


def running_in(lines: Column, least: int = 3) -> Column:
    """The texts of a document's running lines, found within the row by the rules of `running_lines`.

    Lines are sorted by text and place; those whose text returns often enough are read in that order.
    """
    return let(lambda x: F.when(F.size(x) > 50, _running_in(x, least)).otherwise(F.array().cast("array<string>")), lines)


def _running_in(lines: Column, least: int) -> Column:
    short = F.filter(F.transform(lines, lambda x, i: F.struct(trim_line(x).alias("t"), i.alias("i"))), lambda m: F.length(m["t"]).between(3, 80))
    return let(lambda m: _even_runs(m, F.size(lines), least), let(lambda m: _often(m, least), F.array_sort(short)))


def _often(sorted_: Column, least: int) -> Column:
    """Of sorted structs (t, i) those whose t occurs at least so often."""
    starts = F.filter(F.transform(sorted_, lambda m, k: F.when(F.get(sorted_, k + (least - 1))["t"] == m["t"], m["t"])), lambda t: t.isNotNull())
    return let(lambda texts: F.filter(sorted_, lambda m: F.array_contains(texts, m["t"]) & could_run(m["t"])), F.array_distinct(starts))


def _even_runs(rows: Column, n_lines: Column, least: int) -> Column:
    none = F.lit(None).cast("int")
    fields = ("first", "last", "low", "high")
    zero = F.struct(F.lit(None).cast("string").alias("t"), F.lit(0).alias("n"), *[none.alias(f) for f in fields], F.array().cast("array<string>").alias("out"))

    def closed(acc):
        mean = F.floor((acc["last"] - acc["first"]) / F.greatest(acc["n"] - 1, F.lit(1)))
        even = (acc["low"] >= mean * 0.3) & (acc["high"] <= mean * 2.5) & ((acc["last"] - acc["first"]) / n_lines >= 0.3)
        return F.when((acc["n"] >= least) & even, F.concat(acc["out"], F.array(acc["t"]))).otherwise(acc["out"])

    def step(acc, m):
        gap = m["i"] - acc["last"]
        more = F.struct(acc["t"].alias("t"), (acc["n"] + 1).alias("n"), acc["first"].alias("first"), m["i"].alias("last"), F.least(acc["low"], gap).alias("low"), F.greatest(acc["high"], gap).alias("high"), acc["out"].alias("out"))
        new = F.struct(m["t"].alias("t"), F.lit(1).alias("n"), m["i"].alias("first"), m["i"].alias("last"), none.alias("low"), none.alias("high"), closed(acc).alias("out"))
        return F.when(acc["t"] == m["t"], more).otherwise(new)

    return F.aggregate(rows, zero, step, closed)


def without_running(lines: Column) -> Column:
    """lines without their running lines, compared as text."""
    return let(lambda x: let(lambda r: F.when(F.size(r) > 0, F.filter(x, lambda line: ~F.array_contains(r, trim(line)))).otherwise(x), running_in(x)), lines)


def drop_running(docs: DataFrame, id_col: str = "doc_id", lines_col: str = "lines") -> DataFrame:
    """docs without their running lines, in the same column; each row is a document of its own, and nothing is shuffled."""
    return docs.withColumn(lines_col, without_running(F.col(lines_col)))


def _holding(pattern: str):
    return lambda x: x.rlike(pattern)


def _votes(kind: str) -> tuple[int, float, float]:
    return {"page_number": (3, 20.0, 0.95), "citation": (2, 30.0, 0.9), "footnote": (2, 20.0, 0.85)}[kind]


def pattern_vote(text: Column, lines: Column, kind: str) -> Column:
    """A struct (name, pattern, n, confidence, samples) of the pattern found most often, null if too rare; on a tie the first one named."""
    least, scale, most = _votes(kind)
    structs = []
    for k, (name, p) in enumerate(fixed.VOTES[kind]):
        if kind == "page_number":
            hits = F.filter(F.transform(lines, trim), _holding(p))
        else:
            hits = F.regexp_extract_all(text, F.lit(f"({p})"), F.lit(0))
        structs.append(F.struct(F.size(hits).alias("n"), F.lit(-k).alias("order"), F.lit(name).alias("name"), F.lit(p).alias("pattern"), F.slice(hits, 1, 5).alias("samples")))
    best = F.array_max(F.array(*structs))
    return F.when(best["n"] >= least, F.struct(best["name"].alias("name"), best["pattern"].alias("pattern"), best["n"].alias("n"), F.least(best["n"] / scale, F.lit(most)).alias("confidence"), best["samples"].alias("samples")))


def hit_rate(samples: Column, pattern: str) -> Column:
    """The share of samples that hold a match; 0 without samples."""
    return F.when(F.size(samples) > 0, F.size(F.filter(samples, lambda s: s.rlike(pattern))) / F.size(samples)).otherwise(0.0)


def index_islands(view: DataFrame, entry: str = fixed.INDEX_ENTRY) -> DataFrame:
    """doc_id, start_line, n of each run of entries; blank lines are passed over, other lines end a run."""
    kind = F.when(F.col("trimmed") == "", 0).when(F.col("line").rlike(entry), 1).otherwise(2)
    w = Window.partitionBy("doc_id").orderBy("line_no")
    marked = view.withColumn("k", kind).withColumn("island", F.sum((F.col("k") == 2).cast("int")).over(w))
    return marked.filter("k = 1").groupBy("doc_id", "island").agg(F.min("line_no").alias("start_line"), F.count(F.lit(1)).alias("n")).drop("island")


def longest_island(islands: DataFrame) -> DataFrame:
    """Of each document the first of its longest runs."""
    return islands.groupBy("doc_id").agg(F.max_by(F.struct("start_line", "n"), F.struct(F.col("n"), -F.col("start_line"))).alias("b")).select("doc_id", "b.start_line", "b.n")


def words_mean(values: list[Column]) -> Column:
    """The mean of what is known among values, null if nothing is."""
    known = F.filter(F.array(*[v.cast("double") for v in values]), lambda v: v.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda acc, v: acc + v) / F.size(known))


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)
