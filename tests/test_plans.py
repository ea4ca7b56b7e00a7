"""The cleaning plan with proposals, rewriters and limits; character rules against plain Python."""

import random
import re
import unicodedata
from functools import reduce

import pytest
from pyspark.sql import functions as F

from quillon.functions import chars, citations, fixed
from quillon.operators import chunking, mining, services, validation
from quillon.plans import cleaning
from quillon.plans.config import Settings, preset
from quillon.sources import providers

OFF = {k: False for k in ("extract_metadata", "page_numbers", "headers_footers", "front_matter", "table_of_contents", "back_matter", "index", "auxiliary_lists", "citations", "footnotes", "characters", "reflow", "paragraph_length", "structure")}
BODY = [f"Body line number {k} of the story without an end" for k in range(140)]


def only(**on):
    return Settings(**(OFF | on))


def cleaned(spark, text, settings, **columns):
    d = spark.createDataFrame([(1, text)], "doc_id long, text string").withColumns(columns)
    return cleaning.clean(d, settings).first()


def mapped(spark, f, values):
    """f over an array column of strings."""
    rows = spark.createDataFrame(list(enumerate(values)), "k int, t string").select("k", f(F.col("t")).alias("r")).collect()
    return [r["r"] for r in sorted(rows, key=lambda r: r["k"])]


def span(start, end, confidence=0.9):
    return F.struct(F.lit(start).cast("int").alias("start"), F.lit(end).cast("int").alias("end"), F.lit(confidence).alias("confidence"))


LISTS = ["LIST OF FIGURES", *[f"Figure {k} A ..... {k}" for k in range(1, 7)], ""]


@pytest.mark.parametrize(
    ("proposal", "gone"),
    [
        ((0, 6, 0.9), True),  # holds
        ((0, 6, 0.3), True),  # too unsure: the detectors find the list
        ((60, 90, 0.9), True),  # too late: so they do
        ((8, 14, 0.9), True),  # body lines fail the check of content: so they do
    ],
)
def test_proposed_lists(spark, proposal, gone):
    text = "\n".join([*LISTS, "# Chapter 1", *BODY])
    out = cleaned(spark, text, only(auxiliary_lists=True), lists_proposal=F.array(span(*proposal)))
    assert ("Figure 3 A" not in out["text"]) == gone and "Body line number 3 " in out["text"]


def test_proposed_notes_come_before_detected_ones(spark):
    text = "\n".join([*BODY, "# NOTES", *[f"{k}. A note" for k in range(1, 9)]])
    held = cleaned(spark, text, only(footnotes=True), notes_proposal=F.array(span(140, 146)))
    assert "6. A note" not in held["text"] and "8. A note" in held["text"]
    refused = cleaned(spark, text, only(footnotes=True), notes_proposal=F.array(span(0, 120)))
    assert "8. A note" not in refused["text"] and "Body line number 3 " in refused["text"]


def test_notes_count_in_the_audit_of_their_step(spark):
    text = "\n".join([*BODY[:10], "# NOTES", *[f"{k}. A note" for k in range(1, 30)]])
    out = cleaned(spark, text, only(footnotes=True))
    step = next(a for a in out["audit"] if a["step"] == 11)
    assert step["changes"] == 30 and step["lines"] == 10 and step["anomaly"].startswith("critical")


def test_every_step_has_an_audit_row(spark):
    for name in ("default", "training", "minimal", "scholarly"):
        out = cleaned(spark, "\n".join(BODY), preset(name))
        assert [a["step"] for a in out["audit"]] == list(preset(name).enabled())


def test_metadata_reply(spark):
    reply = F.lit('Here: {"title": "Known", "author": "A. Writer", "isbn": "1"}')
    out = cleaned(spark, "\n".join(BODY), only(extract_metadata=True, structure=True), metadata_reply=reply)["text"]
    assert out.startswith("# KNOWN (A. WRITER)") and "isbn: 1" in out
    assert cleaned(spark, "\n".join(BODY), only(extract_metadata=True, structure=True), metadata_reply=F.lit("none"))["text"].startswith("# DOCUMENT 1")


def test_kinds_of_content_rule_out_steps(spark):
    text = "a verse of it\nand one more\n\nfollowed by\nplain text here."
    joined, kept = cleaned(spark, text, only(reflow=True))["text"], cleaned(spark, text, only(reflow=True, by_content=True))["text"]
    assert "followed by plain text here." in joined and kept == text


def test_rewriter(spark):
    text = "one line\nand another\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n\n```\ncode here\n```\n\nlast words"
    upper = lambda t: t.upper().replace("\n", " ")
    d = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in cleaning.clean(d, only(reflow=True), rewriter=upper).collect()}
    assert got[1] == "ONE LINE AND ANOTHER\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n\n```\ncode here\n```\n\nLAST WORDS" and got[2] == got[3] == ""
    assert cleaning.clean(d, only(reflow=True), rewriter=lambda t: "gone").first()["text"] == text  # other words: left as it was

    def broken(t):
        raise ValueError("no service")

    assert cleaning.clean(d, only(paragraph_length=True, max_paragraph_words=2), rewriter=broken).first()["text"] == text


def test_passages_and_retries(spark):
    assert providers.passages("a b\n\nc d\n\ne", 3) == ["a b", "c d\n\ne"] and "\n\n".join(providers.passages("x\n\n\n\ny", 1)) == "x\n\n\n\ny"
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    replies = spark.createDataFrame([(1, "A", None), (2, None, "retry: later")], "doc_id long, reply string, error string")
    again = {r["doc_id"]: (r["reply"], r["error"]) for r in providers.retry_failed(docs, replies, str.upper).collect()}
    assert again == {1: ("A", None), 2: ("B", None)}


def test_events_are_recorded(spark, tmp_path):
    out = spark.createDataFrame([(1, "t", 5, 0.5), (2, None, 0, None)], "doc_id long, text string, original_words int, confidence double")
    for _ in range(2):
        services.recorded(services.events_of(out, F.lit("2026-01-01 00:00:00").cast("timestamp")), str(tmp_path / "events"))
    rows = spark.read.parquet(str(tmp_path / "events")).collect()
    assert len(rows) == 8 and {r["event_type"] for r in rows} == {"cleaningStarted", "cleaningCompleted", "cleaningFailed"}


def test_running_lines_within_the_row_equal_those_of_the_table(spark):
    r = random.Random(4)
    docs = []
    for k in range(40):
        lines = [f"own line {k} {j}" for j in range(r.randint(30, 120))]
        for title, every in (("THE GREAT BOOK", r.randint(4, 12)), ("A. Writer", r.randint(3, 50)), ("# Heading", 7)):
            lines = [x for j, line in enumerate(lines) for x in ([f" {title}", line] if j % every == k % 3 else [line])]
        for _ in range(r.randint(0, 4)):
            lines.insert(r.randrange(len(lines)), "STRAY LINE")
        docs.append((k, lines))
    d = spark.createDataFrame(docs, "doc_id long, lines array<string>")
    want = {k: set() for k, _ in docs}
    for row in mining.running_lines(d).collect():
        want[row["doc_id"]].add(row["line"])
    got = {row["doc_id"]: set(row["r"]) for row in d.select("doc_id", mining.running_in(F.col("lines")).alias("r")).collect()}
    assert got == want and any(want.values())
    left = {row["doc_id"]: row["lines"] for row in mining.drop_running(d).collect()}
    assert all(left[k] == [x for x in lines if x.strip() not in want[k]] for k, lines in docs)


def test_line_chunks_against_plain_cuts(spark):
    r = random.Random(6)
    texts = ["\n".join(r.choice(["", "x", "some words"]) if r.random() < 0.5 else "y" for _ in range(r.randint(1, 700))) for _ in range(25)] + ["", "\n" * 300, None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for x in chunking.line_chunks(rows, target=60, overlap=7, snap=9).collect():
        got.setdefault(x["doc_id"], []).append((x["chunk_id"], x["start_line"], x["end_line"], x["content"], x["context"]))
    for k, t in enumerate(texts):
        lines, want, start = (t or "").split("\n"), [], 0
        while start < len(lines):
            end = min(start + 60, len(lines))
            if len(lines) - end < 100:
                end = len(lines)
            else:
                near = [*range(end, min(end + 9, len(lines))), *range(end - 1, max(end - 9, start) - 1, -1)]
                end = next((j + 1 for j in near if not lines[j].strip()), end)
            want.append((len(want), start, end - 1, "\n".join(lines[start:end]), "\n".join(lines[max(0, start - 7) : start]) if want else None))
            start = end
        assert sorted(got[k]) == want


def test_ocr_digits_against_a_reading_from_left_to_right(spark):
    number = lambda c: unicodedata.category(c)[0] == "N"

    def plain(t):
        out, made = list(t), False
        for i, c in enumerate(t):
            before, after = t[i - 1 : i] if i else "", t[i + 1 : i + 2]
            follows = not after or after in "O.," or number(after) or after.isspace() or unicodedata.category(after)[0] == "P"
            made = c == "O" and follows and (bool(before) and (number(before) or before in ".,") or made)
            out[i] = "0" if made else c
        t, out = "".join(out), []
        for i, c in enumerate(t):
            before, after = t[i - 1 : i] if i else "", t[i + 1 : i + 2]
            digit = lambda x: bool(x) and number(x)
            inside = bool(before) and (digit(before) or before in ".,") and bool(after) and (digit(after) or after in ".,")
            out.append("1" if c == "l" and (inside or digit(after) and (not before or before.isspace())) else c)
        return "".join(out)

    r = random.Random(5)
    values = ["".join(r.choice("OOll15., a;-") for _ in range(r.randint(0, 12))) for _ in range(600)]
    assert mapped(spark, chars.fix_ocr_digits, values) == [plain(v) for v in values]


def test_dashes_against_plain_rules(spark):
    remnants = ((r"—\s+-", "—"), ("—-", "—"), (r"-\s+—", "—"), ("-—", "—"), ("——", "—"), (r"—\s+—", "—"), ("— - ", "— "), (" - —", " —"))

    def plain(line):
        if line.strip() in ("---", "***", "___") or not re.search("[-–—―‒‑]|  ", line):
            return line
        x = line
        for group in (remnants, (("--", "—"), ("―", "—"), (r"(?<=\S)—", " —"), (r"—(?=\S)", "— "), (" – ", " — "), ("[‒‑]", "-"), ("  +", " ")), remnants):
            for p, to in group:
                x = re.sub(p, to, x)
        return x

    r = random.Random(8)
    values = ["".join(r.choice("ab -–—―‒‑*_ ") for _ in range(r.randint(0, 9))) for _ in range(400)]
    assert mapped(spark, lambda t: chars.normalize_dashes(F.array(t))[0], values) == [plain(v) for v in values]


def test_footnote_markers_against_plain_rules(spark):
    def plain(t):
        n = 0
        for p in fixed.FOOTNOTE_MARKERS:
            t, k = re.subn(p, "", t)
            n += k
        return re.sub("  +", " ", t) if n else t, n

    r = random.Random(9)
    values = ["".join(r.choice(["word", "abc", "²", "[12]", "^(3)", "*", "†", "^a", " ", " ", ".", ";", "x"]) for _ in range(r.randint(0, 9))) for _ in range(400)]
    got = mapped(spark, lambda t: citations.remove_footnote_markers(t), values)
    assert [(x["text"], x["n"]) for x in got] == [plain(v) for v in values]


def test_composed_patterns_accept_and_reject(spark):
    """Examples that hold whatever the patterns are put together from."""
    cited = ["(Smith, 2020)", "(Smith & Jones, 2019, pp. 3-4)", "(Smith et al., 2018)", "(Smith, 2018; Jones, 2019)", "(ibid., p. 5)"]
    plain = ["(text)", "(see below)", "value (3.14)", "a (b, c)"]
    found = mapped(spark, lambda t: citations.remove_citations(F.concat(F.lit("so "), t, F.lit(" end")))["text"], cited + plain)
    assert found[: len(cited)] == ["so end"] * len(cited) and all(p in f for p, f in zip(plain, found[len(cited) :], strict=True))


def test_reasons_in_order(spark):
    """The stated cases of the checks of place, one by one."""
    from quillon.plans.queries_sections import CASES

    rows = spark.createDataFrame([(k, *c[:4]) for k, c in enumerate(CASES)], "k int, section string, s int, e int, c double")
    got = rows.select("k", validation.boundary_reason(F.col("section"), F.col("s"), F.col("e"), F.col("c"), F.lit(500)).alias("r")).orderBy("k").collect()
    assert [r["r"] for r in got] == [c[4] for c in CASES]


def test_region_classes(spark):
    kinds = [*services.FRONT_REGIONS, *services.CORE_REGIONS, *services.BACK_REGIONS, "codeBlock"]
    assert mapped(spark, services.region_class, kinds) == ["front"] * 13 + ["core"] * 4 + ["back"] * 10 + ["other"]


@pytest.mark.parametrize("slots", [1, 3, 64])
def test_unique_names(spark, slots):
    from quillon.sources.exports import unique_names

    r = random.Random(3)
    rows = [(k, r.choice(["Untitled.md", "Untitled.md", "a.b.txt", "plain", f"own{k}.md"])) for k in range(300)]
    seen: dict = {}
    want = {}
    for k, name in rows:
        n = seen[name] = seen.get(name, -1) + 1
        stem, dot, end = name.rpartition(".") if "." in name else (name, "", "")
        want[k] = name if not n else f"{stem}-{n}{dot}{end}"
    d = spark.createDataFrame(rows, "seq long, filename string")
    got = {x["seq"]: x["filename"] for x in unique_names(d, slots=slots).collect()}
    assert got == want and unique_names(d.limit(0)).count() == 0


def test_export_batch(spark, tmp_path):
    from quillon.plans.queries_session import _exportable
    from quillon.sources.exports import export_batch

    d = _exportable(spark, "/root/testdata/sf0.001")
    left = export_batch(d, str(tmp_path / "out"), ("markdown", "json")).collect()
    written = spark.read.parquet(str(tmp_path / "out"))
    assert {x["reason"] for x in left} == {"status failed"} and len(left) + written.filter("format = 'json'").count() == d.count()


def test_latest_events_are_limited_before_the_shuffle(spark):
    from quillon.operators.sessions import latest_per

    events = spark.range(1000).selectExpr("id AS event_id", "id % 3 AS user_id", "id AS ts")
    plan = latest_per(events, "user_id", 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan


def test_plans_shuffle_nothing(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = cleaning.clean(docs, preset("training"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_optional_subpackage():
    import __spark_entry__ as entry

    assert entry._optional("quillon.missing.queries") is None and entry._optional("quillon.plans.registry") is not None


def test_kept_patterns_are_fresh_to_the_fraction_of_a_second(spark, tmp_path):
    """3600.8 s are over an hour though whole seconds differ by 3600; null patterns are none; of ties the first event counts."""
    duckdb = pytest.importorskip("duckdb")
    from quillon.plans.queries_services import QUERIES, SQL

    rows = "(1, 7, '2024-03-01 11:00:00.1', 'view'), (2, 8, '2024-03-01 11:00:00.9', 'click'), (3, 9, '2024-03-01 11:30:00', 'signup'), (4, 9, '2024-03-01 11:40:00', NULL), (5, 10, '2024-03-01 12:00:00.9', 'b'), (6, 10, '2024-03-01 12:00:00.9', 'c'), (7, 11, '2024-03-01 09:00:00', 'x')"
    spark.sql(f"SELECT CAST(a AS LONG) AS event_id, CAST(b AS LONG) AS user_id, CAST(c AS TIMESTAMP_NTZ) AS ts, d AS event_type FROM VALUES {rows} AS t(a, b, c, d)").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
        wanted = sorted(db.execute(SQL["pattern_cache"]).fetchall())
    got = QUERIES["pattern_cache"](spark, str(tmp_path)).select("user_id", "patterns", "from_cache").collect()
    assert sorted(map(tuple, got)) == wanted
    assert wanted[:2] == [(7, "detected", False), (8, "click", True)]


def test_a_change_between_protected_passages_is_in_the_plan_once(spark):
    from quillon.functions.segments import TRIGGER, protecting, shield

    calls = []

    def change(x):
        calls.append(1)
        return F.upper(x)

    column = protecting(F.col("t"), shield(), change, TRIGGER)
    assert len(calls) == 1
    texts = ["plain", "", None, "a `b` c", "where α is E² so\nx", "`", "| a | b |\n| --- | --- |\nx"]
    d = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", column.alias("r"))
    assert [r["r"] for r in sorted(d.collect(), key=lambda r: r["k"])] == ["PLAIN", "", None, "A `b` C", "where α is E² SO\nX", "`", "| a | b |\n| --- | --- |\nX"]


def test_shortcuts_find_what_the_patterns_find(spark):
    from quillon.functions.lines import NEWLINES, count_words, ends_in, split_lines
    from quillon.operators.structure import reflow, reflowed

    rng = random.Random(3)
    texts = ["", *["".join(rng.choices("aOl1.,!'( )[]ibdct²  \r\n\x0b\tα", k=rng.randrange(1, 40))) for _ in range(800)]]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    pairs = {
        "words": (count_words(t), F.regexp_count(t, F.lit(r"[^\s\u0085\p{Z}]+"))),
        "ends": (ends_in(t, ".!'"), t.rlike("[.!']$")),
        "lines": (split_lines(t), F.split(t, NEWLINES, -1)),
        "zeros": (t.rlike(r"O(?<=[\p{N}.,]O)"), t.rlike(r"[\p{N}.,]O")),
        "ones": (t.rlike(r"l[\p{N}.,](?<=[\p{N}.,\s]l.)"), t.rlike(r"[\p{N}.,\s]l[\p{N}.,]")),
        "citations": (citations.without_citations(t), citations.remove_citations(t)["text"]),
        "orphans": (citations.clean_orphans(t), reduce(lambda c, p: F.regexp_replace(c, p[0], p[1]), (*fixed.ORPHANS, ("  +", " ")), t)),
        "reflow": (reflowed(t), reflow(t)["text"]),
    }
    wrong = d.select(*[F.count_if(~a.eqNullSafe(b)).alias(k) for k, (a, b) in pairs.items()]).first().asDict()
    assert not any(wrong.values()), wrong


def test_repeated_lines_are_worked_on_once(spark):
    from quillon.functions.lines import FEW_LINES, once_each

    repeated, short, long = ["a", "b", "", "a"] * 5, ["a", "a", "b"], [str(k % (FEW_LINES + 1)) for k in range(3 * FEW_LINES)]
    d = spark.createDataFrame([(0, repeated), (1, short), (2, long), (3, []), (4, None)], "k int, x array<string>")
    drawn = [r["r"] for r in d.select("k", once_each(F.col("x"), lambda line: F.concat(line, F.lit("|"), F.rand(1).cast("string"))).alias("r")).orderBy("k").collect()]
    assert [x and [v.split("|")[0] for v in x] for x in drawn] == [repeated, short, long, [], None]
    assert len(set(drawn[0])) == 3 and len(set(drawn[1])) == 3 and len(set(drawn[2])) == len(long)


def test_line_by_line_equals_the_whole_text(spark):
    from quillon.functions.lines import count_words, count_words_in, has_other_ends, join_lines, kept, relined, split_lines, trim, trim_all, trim_line, trim_text
    from quillon.functions.markdown import count_semantic_words, count_semantic_words_in
    from quillon.functions.segments import CODE, TRIGGER, protecting, shield
    from quillon.operators.boundaries import _first_of
    from quillon.operators.removal import matches_any
    from quillon.operators.structure import content_flags

    rng = random.Random(5)
    pieces = ["a word", "O1", "1O", "l2", ".l,", "—", " -", "--", "- ", "  ", "―", "\u2011", " – ", "xiv", "12", "ﬁ", "â€œ", "Ã©", "\u200b", "“", "´", "(", ")", " ", "\t", "\u00a0", "#", "# x", "Ω", "Theorem", "def "]
    marks = ["*", "**", "_", "__", "`", "[", "](", "![", "|", "²", "***", "\r", "\u0085"]
    texts = ["", "\n", "—\n—", "(\n)", "( \n\n)", "*** <!-- END", "*a*", "a*b*c", "**a\nb**", "— x —"]
    for k in range(900):
        own = ["".join(rng.choices(pieces + marks * (k % 3 == 0), k=rng.randrange(0, 5))) for _ in range(rng.randrange(1, 5))]
        texts.append("\n".join(rng.choices(own, k=rng.choice((1, 4, 20)))))
    t, x = F.col("t"), split_lines(F.col("t"))

    def chain(t):
        t = chars.fix_ocr_digits(reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), [*sorted(fixed.MOJIBAKE.items(), key=lambda p: (-len(p[0]), p[0])), *fixed.LIGATURES.items(), *((c, "") for c in fixed.INVISIBLE)], t))
        t = chars.normalize_quotes(join_lines(chars.remove_decorative_dashes(chars.normalize_dashes(split_lines(t)))))
        t = F.translate(F.regexp_replace(emphasis(t), r"!\[.*?\]\(.*?\)", ""), "[]", "()")
        t = F.replace(F.replace(t, F.lit("\\*"), F.lit("")), F.lit("_"), F.lit(""))
        return F.regexp_replace(F.regexp_replace(t, "  +", " "), r"\(\s*\)", "")

    def emphasis(t):
        pairs = (r"\*\*([^*]+)\*\*", "$1"), (r"__([^_]+)__", "$1"), (r"(?<![*\n])\*([^*\n]+)\*(?!\*)", "$1"), (r"(?<![_\n])_([^_\n]+)_(?!_)", "$1")
        return reduce(lambda c, p: F.regexp_replace(c, *p), pairs, t)

    cleaned_ = protecting(t, shield(code=False), lambda p: protecting(p, CODE, chain, "`"), TRIGGER)
    within = F.filter(F.transform(x, lambda v, i: F.struct(i.alias("i"), F.when((i >= 1) & (i < 9) & v.contains("a"), F.length(v)).alias("k"))), lambda m: m["k"].isNotNull())
    pairs = {
        "ends": (has_other_ends(t), t.rlike(r"[\x0B-\r\u0085\u2028\u2029]")),
        "trimmed": (F.transform(x, trim_line), F.transform(x, trim)),
        "trimmed text": (trim_text(t), trim_all(t)),
        "emphasis": (chars.remove_emphasis(t), emphasis(t)),
        "characters": (chars.clean_characters(t), protecting(t, CODE, chain, "`")),
        "character lines": (chars.clean_character_lines(x, shield(code=False), TRIGGER), relined(F.when(has_other_ends(t), F.lit(None)).otherwise(cleaned_))),
        "words": (count_words_in(x), count_words(t)),
        "semantic words": (count_semantic_words_in(x, join_lines(x), count_words(t)), count_semantic_words(t)),
        "flags": (content_flags(join_lines(F.array_distinct(x))), content_flags(t)),
        "kept": (kept(x, lambda v: ~matches_any(v, fixed.PAGE_NUMBERS)), F.filter(x, lambda v: ~matches_any(v, fixed.PAGE_NUMBERS))),
        "first of": (_first_of(x, F.lit(1), F.lit(9), lambda v: F.when(v.contains("a"), F.length(v)), "int"), within),
    }
    d = spark.createDataFrame([(v,) for v in texts], "t string")
    for name, (a, b) in pairs.items():
        rows = [(r["t"], r["a"], r["b"]) for r in d.select("t", a.alias("a"), b.alias("b")).collect()]
        wrong = [r for r in rows if r[1] != r[2] and not (name == "character lines" and r[2] is None)]
        assert not wrong, (name, wrong[:3])
