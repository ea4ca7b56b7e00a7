"""The document engine: stated cases, invariants and registered queries."""

import re
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from quillon.functions import chars, citations, markdown, metadata, replies
from quillon.functions.lines import count_words, excerpt, join_lines, sample_thirds, split_lines
from quillon.operators import boundaries, chunking, metrics, mining, removal, structure, validation
from quillon.plans import cleaning, registry
from quillon.plans.config import PRESETS, Settings, for_children, preset

SMALL = "/root/testdata/sf0.001"


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("r")).first()["r"]


def doc(*parts):
    out = []
    for p in parts:
        out += p if isinstance(p, list) else [p]
    return out


BODY = [f"Body line number {k} of the story without an end" for k in range(140)]


def detect(spark, f, lines):
    return spark.createDataFrame([(lines,)], "lines array<string>").select(f(F.col("lines")).alias("r")).first()["r"]


def test_line_ends_and_words(spark):
    assert one(spark, F.size(split_lines(F.col("t"))), t="a\r\nb") == 3
    assert one(spark, count_words(F.col("t")), t=" a b \t c\n") == 3
    assert one(spark, sample_thirds(F.col("t"), 9), t="abcdefghijklmnop").startswith("abc\n\n[...]")
    assert one(spark, excerpt(split_lines(F.col("t")), 0, 1), t="abc\nd") == "abc\n"


def test_ranges(spark):
    lines = [str(k) for k in range(10)]
    d = spark.createDataFrame([(lines, [(2, 3), (5, 50), (-1, 2)])], "l array<string>, r array<struct<start:int,end:int>>")
    r = d.select(removal.remove_ranges_report(F.col("l"), F.col("r")).alias("r")).first()["r"]
    assert r["lines"] == ["0", "1", "4"] and r["removed"] == 7 and [x["reason"] for x in r["rejected"]] == ["negative_start"]
    assert detect(spark, lambda x: removal.remove_range(x, F.lit(20), F.lit(30)), lines) == lines


def test_page_numbers(spark):
    lines = ["42", "- 42 -", "Page 7", "xvii", "did", "A sentence.", "", "[3]", "12 of 30"]
    assert detect(spark, removal.drop_matching, lines) == ["A sentence.", ""]
    assert detect(spark, lambda x: removal.drop_matching(x, removal.strict_page_numbers()), lines) == ["did", "A sentence.", ""]


@pytest.mark.parametrize("t", ["cafÃ© ﬁne​ “q” ‘s’", "plain", ""])
def test_repairs_are_idempotent(spark, t):
    for f in (chars.fix_mojibake, chars.expand_ligatures, chars.remove_invisible, chars.normalize_quotes):
        once = one(spark, f(F.col("t")), t=t)
        assert one(spark, f(F.col("t")), t=once) == once


def test_code_survives_cleaning(spark):
    t = "text [a] *b* and `x = a[0]`\n```py\ny = '“' -- [1]\n```\nend"
    out = one(spark, chars.clean_characters(F.col("t")), t=t)
    assert "`x = a[0]`" in out and "y = '“' -- [1]" in out and "(a) b" in out


def test_citations_keep_bibliography_and_numbers(spark):
    t = "It is so (Smith, 2020).\nValue 3.14 (Jones, 2019, p. 4) holds\nSmith, J. (2020). A long title. Press."
    out = one(spark, citations.remove_citations(F.col("t"))["text"], t=t)
    assert "(Smith, 2020)" not in out and "3.14" in out and out.endswith("Smith, J. (2020). A long title. Press.")


def test_detectors(spark):
    refs = [f"[{k}] A reference" for k in range(57)]
    assert detect(spark, boundaries.back_matter, doc(BODY, "# NOTES", refs))["line"] == 140
    entries = [f"term, {k}" for k in range(30)]
    assert detect(spark, boundaries.index_start, doc(BODY[:100], "# INDEX", "A", entries))["line"] == 100
    assert detect(spark, boundaries.index_start, doc(BODY[:100], entries))["line"] == 100
    front = ["A Title", "© 2024 House", "All rights reserved", "ISBN: 978", "", "# Chapter 1"]
    assert detect(spark, boundaries.front_matter_end, doc(front, BODY))["line"] == 4
    toc = ["## TABLE OF CONTENTS", *[f"Chapter {k}  ..... {k}" for k in range(1, 5)], ""]
    assert detect(spark, boundaries.toc_start, doc(toc, "# Chapter 1", BODY))["line"] == 0
    lists = ["LIST OF FIGURES", *[f"Figure {k} A ..... {k}" for k in range(1, 7)], "", "# Chapter 1"]
    found = detect(spark, boundaries.auxiliary_lists, doc(lists, BODY))
    assert [(x["type"], x["start"], x["end"], x["entries"]) for x in found] == [("List of Figures", 0, 6, 6)]
    abbreviations = ["ABC - Alpha Beta", "DEF - Delta Echo", "GHI - Golf Hotel", "text here"]
    assert [x["entries"] for x in detect(spark, boundaries.headerless_lists, doc(abbreviations, BODY[:10]))] == [3]
    assert [(x["start"], x["end"]) for x in detect(spark, boundaries.notes_sections, ["a", "# NOTES", "1. x", "# INDEX", "b"])] == [(1, 2)]


@pytest.mark.parametrize("f", [boundaries.back_matter, boundaries.index_start, boundaries.front_matter_end, boundaries.toc_start])
def test_detectors_need_fifty_lines(spark, f):
    assert detect(spark, f, ["© 2024", "# Chapter 1", "# NOTES", "# INDEX", "## CONTENTS"] * 9) is None
    assert detect(spark, f, [""]) is None


def test_content_checks(spark):
    check = lambda section, lines, **k: detect(spark, lambda x: validation.verify_content(section, x, F.lit(0), **k), lines)
    assert check("auxiliaryLists", ["## LIST OF FIGURES", *[f"Figure {k}: A" for k in range(1, 7)]])["confidence"] > 0.7
    assert not check("auxiliaryLists", ["A long line of narrative prose that goes on and on, well over the hundred characters that make it prose, so it is."] * 8)["valid"]
    assert check("footnotesEndnotes", ["## NOTES", "1. First one", "2. Second one", "3. Third", "4. Fourth", "5. Fifth"])["valid"]
    assert check("backMatter", ["# BIBLIOGRAPHY", "Smith", "Jones", "Miller", "Baker"])["valid"]
    assert check("backMatter", BODY[:20])["reason"] == "no_expected_headers"
    assert check("backMatter", ["the resources are here", *BODY[:9]])["valid"] and not check("backMatter", ["the resources are here", *BODY[:9]], strict_headers=True)["valid"]
    assert check("frontMatter", ["© 2024", "ISBN 1", "a", "b", "c"])["confidence"] == 0.9
    assert check("frontMatter", ["© 2024", "# Chapter 1", "a", "b", "c"])["reason"] == "chapter_content"


def test_chapters_and_assembly(spark):
    lines = ["# Part I", "a", "# Chapter 1: Begin", "b", "```", "# Chapter 2", "```", "## 3. Third", "# Notes"]
    marked = detect(spark, lambda x: structure.mark_chapters(x, "token"), lines)
    assert marked.count("<PART>Part I</PART>") == 1 and "<PART>Part I</PART>\n<CHAPTER>Begin</CHAPTER>" in marked
    assert "<PART>Part I</PART>\n<CHAPTER>Third</CHAPTER>" in marked and not any("Chapter 2</CHAPTER>" in x for x in marked)
    assert detect(spark, lambda x: structure.mark_chapters(x, "none"), lines) == lines
    text = one(spark, structure.assemble(F.col("t"), metadata.blank(F.lit("A: b"), F.lit("W"))), t="body")
    assert text == '# A: B (W)\n\n---\ntitle: "A: b"\nauthor: W\n---\n\n---\n\nbody\n\n---\n\n*** <!-- END OF A: B -->\n'


def test_reflow(spark):
    r = one(spark, structure.reflow(F.col("t")), t="one line that\ngoes on here.\nNext one. Done.\n\nroses are\nred violets\nare blue\nand so")
    assert r["text"] == "one line that goes on here. Next one. Done.\n\nroses are\nred violets\nare blue\nand so" and r["breaks"] == 1


def test_chunks(spark):
    text = "\n\n".join(f"{k} " + "w " * 30 for k in range(12))
    got = one(spark, chunking.word_chunks(F.col("t"), 100, 30), t=text)
    assert len(got) == 4 and [c["id"] for c in got] == [0, 1, 2, 3] and got[1]["start_line"] == got[0]["end_line"] + 2 and got[1]["overlap"]
    assert one(spark, chunking.merge_chunks(F.transform(chunking.word_chunks(F.col("t"), 100, 30), lambda c: c["content"])), t=text) == text
    d = spark.createDataFrame([(1, "\n".join(str(k) for k in range(700)))], "doc_id long, text string")
    parts = chunking.line_chunks(d, target=250).orderBy("chunk_id").collect()
    assert "\n".join(p["content"] for p in parts) == "\n".join(str(k) for k in range(700)) and parts[-1]["end_line"] == 699


def test_running_lines(spark):
    lines = [x for k in range(12) for x in ["THE GREAT BOOK", *[f"line {k} {j}" for j in range(6)]]]
    d = spark.createDataFrame([(1, lines), (2, ["DECOY LINE"] * 5 + [f"x {k}" for k in range(60)])], "doc_id long, lines array<string>")
    got = mining.running_lines(d).collect()
    assert [(r["doc_id"], r["line"], r["kind"], r["n"]) for r in got] == [(1, "THE GREAT BOOK", "header", 12)]
    assert all("THE GREAT BOOK" not in r["lines"] for r in mining.drop_running(d).collect())


def test_replies(spark):
    assert one(spark, replies.content_type(F.col("t"))["error"], t="no json") == "no_json"
    assert one(spark, replies.content_type(F.col("t"))["error"], t='{"confidence": 1}') == "missing contentType"


def test_settings():
    assert Settings().back_matter is False and PRESETS["default"].back_matter is True
    assert PRESETS["minimal"].enabled() == (1, 2, 3, 4, 12, 13, 15, 16) and for_children(PRESETS["default"]).max_paragraph_words == 150


def test_plan(spark):
    front = ["A Title", "© 2024 House", "All rights reserved", "ISBN: 978-1", "", "# Chapter 1"]
    text = "\n".join(doc(front, BODY, "42", "# NOTES", [f"{k}. A note" for k in range(1, 30)]))
    d = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in cleaning.clean(d, preset("training")).collect()}
    assert len(rows) == 3 and "ISBN" not in rows[1]["text"] and "A note" not in rows[1]["text"] and "<END_DOCUMENT>" in rows[1]["text"]
    off = Settings(False, False, False, False, False, False, False, False, False, False, False, False, False, False)
    assert cleaning.clean(d, off).filter("doc_id = 1").first()["text"] == text
    proposed = d.withColumn("front_proposal", F.expr("named_struct('start', cast(null as int), 'end', cast(null as int), 'confidence', 0.9d)"))
    kept = cleaning.clean(proposed, Settings(front_matter=True, reflow=False, structure=False)).filter("doc_id = 1").first()["text"]
    assert "ISBN" in kept


def test_stream(spark, tmp_path):
    from quillon.streaming.cleaning import clean_stream, documents_stream, write_stream

    spark.createDataFrame([(1, "a\n42\nb")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    write_stream(clean_stream(documents_stream(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert "42" not in spark.read.parquet(str(tmp_path / "out")).first()["text"]


def test_providers(spark):
    from quillon.sources.providers import Retry, with_retries

    tries = []

    def flaky(text):
        tries.append(text)
        if len(tries) < 3:
            raise Retry("later")
        return text.upper()

    assert with_retries(flaky, "a", sleep=lambda s: None) == ("A", None) and len(tries) == 3


def test_files(spark, tmp_path):
    from quillon.sources.documents import load_files

    (tmp_path / "a.txt").write_text("héllo", encoding="utf-8")
    (tmp_path / "b.md").write_bytes("x".encode("utf-16"))
    (tmp_path / "c.exe").write_bytes(b"x")
    (tmp_path / "d.txt").write_bytes(b"")
    rows = {r["name"]: (r["text"], r["error"]) for r in load_files(spark, str(tmp_path)).collect()}
    assert rows["a.txt"] == ("héllo", None) and rows["b.md"][0] == "x" and rows["c.exe"][1] == "unsupported_type" and "d.txt" not in rows


def test_other_counts(spark):
    assert one(spark, markdown.count_semantic_words(F.col("t")), t="# A **b** [c d](u)") == 4
    assert one(spark, metrics.compare_texts(F.col("a"), F.col("b"))["passes"], a="x y", b="x y")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "events", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got, want = registry.queries()[name](spark, SMALL), con.sql(registry.oracle_sql()[name])
    plain = lambda x: round(float(x), 6) if isinstance(x, (float, Decimal)) else x
    key = lambda columns, rows: sorted(str([plain(x) for _, x in sorted(zip(columns, r, strict=True))]) for r in rows)
    assert sorted(got.columns) == sorted(want.columns) and key(got.columns, got.collect()) == key(want.columns, want.fetchall())


def test_every_oracle_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries()) and registry.FLAGSHIP in registry.oracle_sql()


def test_join_lines_is_the_inverse(spark):
    assert one(spark, join_lines(split_lines(F.col("t"))), t="a\n\nb\n") == "a\n\nb\n"


def test_whole_auxiliary_lists(spark):
    from quillon.functions import fixed
    from quillon.plans.decorate import decorated

    got = {(r["doc_id"], r["start_line"]): r for r in registry.queries()["auxiliary_lists"](spark, SMALL).collect()}
    seen = 0
    for r in decorated(spark, SMALL).filter("variant = 6").collect():
        x, last, blanks = r["lines"], 5, 0
        for k in range(6, min(105, int(len(x) * 0.4))):
            t = x[k].strip()
            if t.startswith("#") or t.upper().startswith(("CHAPTER ", "PART ", "PROLOGUE", "INTRODUCTION")):
                break
            last, blanks = (k, 0) if t else (last, blanks + 1)
            if blanks == 3:
                break
        entries = sum(any(re.search(p, t) for p in fixed.LIST_ENTRIES) for t in x[6 : last + 1])
        own = got[r["doc_id"], 5]
        assert (own["type"], own["end_line"], own["entries"], own["confidence"]) == ("List of Tables", last, entries, 1.0) and last > 7 and entries >= 5
        seen += 1
    assert seen > 10


def test_whole_export_strip(spark, tmp_path):
    texts = ["## Title\n# not first", "x" * 40 + " **b** and *i* [l](http://a.b) _u_ __w__", "*a*", None, "", "two **lines\nhere** stay"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["stripped"] for r in registry.queries()["export_strip_whole"](spark, str(tmp_path)).collect()}

    def brute(t):
        for p, to in ((r"\A#{1,6}\s*", ""), (r"\*\*(.+?)\*\*", r"\1"), (r"\*(.+?)\*", r"\1"), (r"__(.+?)__", r"\1"), (r"_(.+?)_", r"\1"), (r"\[(.+?)\]\(.+?\)", r"\1")):
            t = re.sub(p, to, t)
        return t

    assert got == {k: t if t is None else brute(t) for k, t in enumerate(texts)} and got[1] == "x" * 40 + " b and i l u w"


def test_whole_text_distance_and_pages(spark, tmp_path):
    from quillon.plans.queries_lines import in_three_pages

    def brute(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1]

    texts = ["a" * 40 + "bcd" * 30, "héllo wörld " * 9, "", None, "abcba"]
    spark.createDataFrame([(k, 0, t) for k, t in enumerate(texts)], "conv_id long, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: (r["distance"], r["longest"]) for r in registry.queries()["text_distance_whole"](spark, str(tmp_path)).collect()}
    assert got == {k: (None, None) if t is None else (brute(t, t[::-1]), len(t)) for k, t in enumerate(texts)}
    lines = [*BODY, "---", "last"]
    pages = detect(spark, lambda x: chunking.split_pages(in_three_pages(x)), lines)
    assert len(pages) == 3 and [x for p in pages for x in p["markdown"].split("\n")] == lines


@pytest.mark.parametrize("name", ["clean_characters", "assembled"])
def test_whole_table(spark, name):
    assert registry.queries()[name](spark, SMALL).count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()
