"""Paragraphs, chapters and parts, markers, existing metadata, kinds of content."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions import fixed
from ..functions.lines import count_words, count_words_in, ends_in, has_any, join_lines, let, trim, trim_all, trim_line, trim_text, with_index
from ..functions.metadata import formatted, title_header
from ..functions.segments import code_ranges, in_any

_CHAPTER = (
    rf"(?iu)^#{{1,2}}\s*Chapter\s+(\d+|[IVXLC]+|{fixed.NUMBER_WORDS}|[A-Z][a-z]+)[\.:\s]?(.*)$",
    r"^#{1,2}\s+(\d{1,3})[\.:\s]+(.+)$",
    r"^#{1,2}\s+([IVXLC]+)[\.:\s]+(.+)$",
    r"^#{1,2}\s+(\d{1,3})\s*$",
)
_PART = r"(?iu)^#{1,2}\s*(Part|Book|Volume)\s+(\d+|[IVXLC]+|One|Two|Three|Four|Five|Six|Seven|Eight|Nine|Ten)[\.:\s]?(.*)$"
HEADING = "array<struct<line:int,title:string>>"

CHAPTER_STYLES = ("none", "html_comments", "markdown_h1", "markdown_h2", "token")
END_STYLES = ("none", "minimal", "simple", "standard", "html_comment", "markdown_hr", "token", "token_with_author")


def _chapter_title(t: Column) -> Column:
    """The title of a chapter heading, null for other lines; the first form that fits counts."""
    plain = trim(F.regexp_replace(t, r"^#+\s*", ""))
    after_colon = trim(F.regexp_extract(plain, r":(.*)$", 1))
    worded = F.when(plain.contains(":") & (after_colon != ""), after_colon).otherwise(plain)
    numbered = trim(F.regexp_replace(t, r"^#+\s*\d+[\.:\s]*", ""))
    numbered = F.when(numbered == "", F.concat(F.lit("Chapter "), F.regexp_extract(t, r"\d+", 0))).otherwise(numbered)
    roman = trim(F.regexp_replace(t, r"^#+\s*[IVXLC]+[\.:\s]*", ""))
    roman = F.when(roman == "", F.concat(F.lit("Chapter "), F.regexp_extract(t, r"[IVXLC]+", 0))).otherwise(roman)
    bare = F.concat(F.lit("Chapter "), trim(F.replace(t, F.lit("#"), F.lit(""))))
    skip = F.lower(t).rlike("|".join(fixed.NOT_CHAPTERS))
    found = F.when(t.rlike(_CHAPTER[0]), worded).when(t.rlike(_CHAPTER[1]), numbered).when(t.rlike(_CHAPTER[2]), roman).when(t.rlike(_CHAPTER[3]), bare)
    return F.when(t.startswith("#") & ~skip, found)


def _headings(lines: Column, title) -> Column:
    found = F.transform(lines, lambda x, i: F.struct(i.alias("line"), F.when(x.contains("#") & trim(x).startswith("#"), title(trim(x))).alias("title")))
    return F.filter(found, lambda h: h["title"].isNotNull())


def chapters(lines: Column) -> Column:
    """Structs (line, title) of the chapter headings."""
    return _headings(lines, _chapter_title)


def parts(lines: Column) -> Column:
    return _headings(lines, lambda t: F.when(t.rlike(_PART), trim(F.regexp_replace(t, r"^#+\s*", ""))))


def chapters_in_parts(chapters_: Column, parts_: Column) -> Column:
    """Chapters with the title of the last part at or before their line (an as-of join within the row)."""
    part_of = lambda ps, c: F.try_element_at(F.filter(ps, lambda p: p["line"] <= c["line"]), F.lit(-1))["title"]
    return let(lambda cs, ps: F.transform(cs, lambda c: F.struct(c["line"].alias("line"), c["title"].alias("title"), part_of(ps, c).alias("part"))), chapters_, parts_)


def chapter_marker(style: str, title: Column, part: Column | None = None) -> Column:
    form = {
        "none": F.lit(""), "html_comments": F.concat(F.lit("<!-- CHAPTER: "), title, F.lit(" -->")), "markdown_h1": F.concat(F.lit("# "), title),
        "markdown_h2": F.concat(F.lit("## "), title), "token": F.concat(F.lit("<CHAPTER>"), title, F.lit("</CHAPTER>")),
    }[style]
    if part is None:
        return form
    both = {
        "none": F.lit(""), "html_comments": F.concat(F.lit("<!-- PART: "), part, F.lit(" | CHAPTER: "), title, F.lit(" -->")), "markdown_h1": F.concat(F.lit("# "), part, F.lit("\n\n## "), title),
        "markdown_h2": F.concat(F.lit("## "), part, F.lit("\n\n### "), title), "token": F.concat(F.lit("<PART>"), part, F.lit("</PART>\n<CHAPTER>"), title, F.lit("</CHAPTER>")),
    }[style]
    return F.when(part.isNull(), form).otherwise(both)


def part_marker(style: str, title: Column) -> Column:
    around = {"none": None, "html_comments": ("<!-- PART: ", " -->"), "markdown_h1": ("# ", ""), "markdown_h2": ("## ", ""), "token": ("<PART>", "</PART>")}[style]
    return F.lit("") if around is None else F.concat(F.lit(around[0]), title, F.lit(around[1]))


def end_marker(style: str, title: Column, author: Column | None = None) -> Column:
    named = F.lit("<END_DOCUMENT>")
    if author is not None:
        named = F.when(F.nullif(author, F.lit("")).isNotNull(), F.concat(F.lit('<END_DOCUMENT author="'), author, F.lit('">'))).otherwise(named)
    return {
        "none": F.lit(""), "minimal": F.lit("***"), "simple": F.lit("[END]"), "standard": F.concat(F.lit("*** <!-- END OF "), F.upper(title), F.lit(" -->")),
        "html_comment": F.concat(F.lit("<!-- END OF DOCUMENT: "), title, F.lit(" -->")), "markdown_hr": F.lit("---"), "token": F.lit("<END_DOCUMENT>"), "token_with_author": named,
    }[style]


def mark_chapters(lines: Column, style: str) -> Column:
    """Lines with a marker and a blank line before each chapter and part that no code block holds.

    Nothing is marked in a document without chapters; a part heading wins over a chapter on its line.
    """
    if style == "none":
        return lines

    def marked(lines, in_parts, parts_, code):
        def line(x, i):
            part = F.get(F.filter(parts_, lambda p: p["line"] == i), 0)
            chapter = F.get(F.filter(in_parts, lambda c: c["line"] == i), 0)
            marker = F.when(part.isNotNull(), part_marker(style, part["title"])).when(chapter.isNotNull(), chapter_marker(style, chapter["title"], chapter["part"]))
            return F.when(x.contains("#") & trim(x).startswith("#") & marker.isNotNull() & ~in_any(code, i), F.array(marker, F.lit(""), x)).otherwise(F.array(x))

        return F.when(F.size(in_parts) > 0, F.flatten(F.transform(lines, line))).otherwise(lines)

    found = lambda x: let(lambda c, p: F.struct(chapters_in_parts(c, p).alias("c"), p.alias("p")), chapters(x), parts(x))
    return let(lambda x: let(lambda f, code: marked(x, f["c"], f["p"], code), found(x), code_ranges(x)), lines)


def assemble(text: Column, meta: Column, metadata_format: str = "yaml", chapter_style: str = "html_comments", end_style: str = "standard") -> Column:
    """Title, metadata, a rule, the marked text, a rule and the end marker."""
    from ..functions.lines import split_lines

    body = join_lines(mark_chapters(split_lines(trim_text(text)), chapter_style))
    end = end_marker(end_style, meta["title"], meta["author"])
    tail = F.when(end == "", F.lit("")).otherwise(F.concat(F.lit("---\n\n"), end, F.lit("\n")))
    return F.concat(title_header(meta["title"], meta["subtitle"], meta["author"]), F.lit("\n\n"), formatted(meta, metadata_format), F.lit("\n\n---\n\n"), body, F.lit("\n\n"), tail)


def assemble_simple(text: Column, meta: Column, metadata_format: str = "yaml") -> Column:
    return F.concat_ws("\n\n", title_header(meta["title"], meta["subtitle"], meta["author"]), formatted(meta, metadata_format), trim_all(text), F.concat(end_marker("standard", meta["title"]), F.lit("\n")))


def is_poetry(paragraph: Column) -> Column:
    """Three lines or more without headings, short on average, of which over 60 percent end no sentence."""
    return let(_is_verse, _filled(paragraph))


def _filled(paragraph: Column) -> Column:
    """The trimmed lines that aren't blank."""
    return F.filter(F.transform(F.split(paragraph, "\n", -1), trim_line), lambda x: x != "")


def _is_verse(lines: Column) -> Column:
    n = F.size(lines)
    total = count_words_in(lines)
    loose = F.size(F.filter(lines, lambda x: ~ends_in(x, ".!?")))
    return (n >= 3) & ~F.exists(lines, lambda x: x.startswith("#")) & (loose / n > 0.6) & (total / n < 12)


def reflow(text: Column) -> Column:
    """A struct (text, breaks): each paragraph's lines joined by spaces but in verse; breaks that ended no sentence are counted."""

    def paragraph(p):
        return let(lambda lines: joined(p, lines), F.filter(F.transform(F.split(p, "\n", -1), trim), lambda x: x != ""))

    def joined(p, lines):
        open_ = F.size(F.filter(F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: ~ends_in(x, ".!?\"'")))
        verse = is_poetry(p)
        return F.struct(F.when(verse, p).otherwise(F.array_join(lines, " ")).alias("text"), F.when(verse, 0).otherwise(open_).alias("n"))

    made = lambda done: F.struct(
        F.array_join(F.transform(done, lambda d: d["text"]), "\n\n").alias("text"), F.aggregate(done, F.lit(0), lambda acc, d: acc + d["n"]).alias("breaks"))
    return let(made, F.transform(F.split(text, "\n\n", -1), paragraph))


def reflowed(text: Column) -> Column:
    """The text that `reflow` makes, without counting breaks."""
    joined = lambda p: let(lambda lines: F.when(_is_verse(lines), p).otherwise(F.array_join(lines, " ")), _filled(p))
    return F.array_join(F.transform(F.split(text, "\n\n", -1), joined), "\n\n")


def count_paragraphs(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\n\n", -1), lambda p: trim_all(p) != ""))


def long_paragraphs(text: Column, most_words: int = 250) -> Column:
    """Structs (i, words) of the paragraphs that a rewriter would split; without one the text stays as it is."""
    found = F.transform(F.split(text, "\n\n", -1), lambda p, i: F.struct(i.alias("i"), count_words(p).alias("words")))
    return F.filter(found, lambda p: p["words"] >= most_words)


def accepted_rewrite(before: Column, after: Column, least: float = 0.98, most: float = 1.02) -> Column:
    """A rewrite if its words number about as many as before, else the text as it was."""
    ratio = count_words(after) / F.greatest(count_words(before), F.lit(1))
    return F.when(after.isNotNull() & (ratio >= least) & (ratio <= most), after).otherwise(before)


def content_flags(text: Column) -> Column:
    """A struct of what kind of content a text shows, and its primary kind."""
    return let(_content_flags, text, F.lower(text))


def _content_flags(text: Column, low: Column) -> Column:
    has = lambda *w: has_any(low, *w)
    code = has("func ", "def ", "class ", "import ", "```")
    math = has("equation", "theorem", "proof") | (text.contains("=") & text.contains("x"))
    academic = has("abstract", "methodology", "bibliography", "et al.")
    dialogue = has('"said', "she said", "he said", "asked,")
    poetry = has("stanza", "verse", "rhyme")
    children = (low.contains("picture") & low.contains("story")) | has("bedtime", "fairy tale")
    primary = F.when(academic, "academic").when(code | math, "technical").when(poetry, "poetry").when(dialogue, "dialogue").when(children, "childrens").otherwise("prose")
    return F.struct(
        poetry.alias("has_poetry"), dialogue.alias("has_dialogue"), code.alias("has_code"), academic.alias("is_academic"), F.lit(False).alias("is_legal"), children.alias("is_childrens"),
        F.lit(False).alias("has_religious_verses"), F.lit(False).alias("has_tabular_data"), math.alias("has_mathematical"), primary.alias("primary_type"), F.lit(0.5).alias("confidence"),
    )


def has_math(text: Column) -> Column:
    return text.rlike("|".join(fixed.MATH_SIGNS))


def has_code(text: Column) -> Column:
    """A fence or a code keyword; ordinary English has some of these words too."""
    return text.rlike("```|" + "|".join(fixed.CODE_WORDS))


def existing_metadata(text: Column) -> Column:
    """The length of a metadata block at the beginning of a trimmed text: one between --- lines, or a title with
    key: value lines below it; 0 if there is none."""
    return let(_metadata_length, text, F.split(text, "\n", -1))


def _metadata_length(text: Column, lines: Column) -> Column:
    chars = lambda last: F.aggregate(F.slice(lines, 1, last + 1), F.lit(0), lambda acc, x: acc + F.length(x) + 1) - 1
    close = F.array_position(F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: trim(x) == "---"), True)
    zero = F.struct(F.lit(0).alias("end"), F.lit(False).alias("done"))
    head = F.filter(with_index(F.slice(lines, 1, 20)), lambda m: m["i"] > 0)

    def step(acc, m):
        t = trim(m["x"])
        to = lambda i, done: F.struct(i.cast("int").alias("end"), F.lit(done).alias("done"))
        return F.when(acc["done"] | (t == ""), acc).when(t == "---", to(m["i"], True)).when(t.contains(":") & ~t.startswith("#"), to(m["i"], False)).otherwise(F.struct(acc["end"].alias("end"), F.lit(True).alias("done")))

    titled = F.aggregate(head, zero, step, lambda acc: acc["end"])
    return F.when(text.startswith("---") & (close > 0), chars(close.cast("int"))).when(text.startswith("# ") & (titled > 0), chars(titled)).otherwise(0)


def strip_metadata(text: Column) -> Column:
    rest = lambda t, n: F.regexp_replace(trim_all(F.substring(t, n + 1, F.length(t))), r"^---\s*\n", "")
    return let(lambda whole, t: let(lambda n: F.when(n > 0, rest(t, n)).otherwise(whole), existing_metadata(t)), text, trim_text(text))
