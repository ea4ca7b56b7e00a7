"""Where sections begin and end, found from headings and the density of entries.

Each detector maps an array of lines to a struct (line, confidence), null where nothing is found, or to
an array of such sections.  All are column expressions: a document is one row and nothing is
shuffled.  Line limits are shares of the number of lines, truncated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from ..functions import fixed
from ..functions.lines import floor_share, has_any, let, once_each, trim, window_of, with_index

LEAST_LINES, LEAST_CONFIDENCE, EVIDENCE_LINES = 50, 0.6, 50
SECTION = "array<struct<type:string,start:int,end:int,confidence:double,entries:int>>"


def _heading(words: dict[float, tuple[str, ...]], weight: float) -> str:
    return rf"^#{{1,3}}\s*(?:{'|'.join(words[weight])})\s*$"


def _weight(line: Column, headings: dict[float, tuple[str, ...]], plain: dict[float, tuple[str, ...]], trimmed: bool) -> Column:
    """The greatest weight of the headings a line is, null if it is none."""
    c = F.lit(None).cast("double")
    for w in sorted({*headings, *plain}):
        tests = []
        if w in headings:
            tests.append(line.rlike(_heading(headings, w)))
        if w in plain:
            tests.append((trim(line) if trimmed else line).rlike(rf"^(?:{'|'.join(plain[w])})$"))
        c = F.when(tests[0] if len(tests) == 1 else tests[0] | tests[1], F.lit(w)).otherwise(c)
    return c


def _found(line: Column, confidence: Column, least: float = LEAST_CONFIDENCE) -> Column:
    return F.when(confidence >= least, F.struct(line.cast("int").alias("line"), confidence.alias("confidence")))


def _bounded(c: Column) -> Column:
    return F.least(F.lit(1.0), c)


def _plus(confidence: Column, count: Column, steps: tuple[tuple[int, float], ...], none: float | None = None) -> Column:
    """confidence raised by the first step that count reaches; multiplied by none if count is 0."""
    c = F.when(count >= steps[0][0], _bounded(confidence + steps[0][1]))
    for least, add in steps[1:]:
        c = c.when(count >= least, _bounded(confidence + add))
    if none is not None:
        c = c.when(count == 0, confidence * none)
    return c.otherwise(confidence)


def _first_of(lines: Column, low: Column, high: Column, kind: Callable[[Column], Column], type_: str) -> Column:
    """Structs (i, k) of the lines from low to before high that have a kind, in order."""
    kinds = once_each(F.slice(lines, low + 1, F.greatest(high - low, F.lit(0))), lambda x: kind(x).cast(type_))
    return F.filter(F.transform(kinds, lambda k, i: F.struct((i + low).alias("i"), k.alias("k"))), lambda m: m["k"].isNotNull())


def _by_order(lines: Column, high: Column, patterns: tuple[tuple[str, float], ...]) -> Column:
    """The line before high that the earliest pattern matches first: a struct (p, i)."""

    def which(x):
        c = F.lit(None).cast("int")
        for k in reversed(range(len(patterns))):
            c = F.when(x.rlike(patterns[k][0]), F.lit(k)).otherwise(c)
        return c

    hits = _first_of(lines, F.lit(0), high, which, "int")
    return F.array_min(F.transform(hits, lambda m: F.struct(m["k"].alias("p"), m["i"].alias("i"))))


def _weight_at(p: Column, patterns: tuple[tuple[str, float], ...]) -> Column:
    return F.element_at(F.array(*[F.lit(w) for _, w in patterns]), p + 1)


def _enough(lines: Column, value: Column) -> Column:
    return F.when(F.size(lines) >= LEAST_LINES, value)


def _longest_run(marks: Column, blanks_break: int | None) -> Column:
    """Of structs (i, k), where k is 0 for a blank line, 1 for an entry and 2 for others: the first longest run
    of entries, as a struct (n, start).  Blank lines are passed over; blanks_break in a row end a run."""
    none = F.lit(None).cast("int")
    zero = F.struct(F.lit(0).alias("n"), none.alias("start"), F.lit(0).alias("best"), none.alias("best_start"), F.lit(0).alias("blanks"))

    def closed(acc):
        better = acc["n"] > acc["best"]
        return F.greatest(acc["n"], acc["best"]), F.when(better, acc["start"]).otherwise(acc["best_start"])

    def step(acc, m):
        best, best_start = closed(acc)
        ended = lambda blanks: F.struct(F.lit(0).alias("n"), none.alias("start"), best.alias("best"), best_start.alias("best_start"), blanks.alias("blanks"))
        entry = F.struct((acc["n"] + 1).alias("n"), F.coalesce(acc["start"], m["i"]).alias("start"), acc["best"].alias("best"), acc["best_start"].alias("best_start"), F.lit(0).alias("blanks"))
        passed = F.struct(acc["n"].alias("n"), acc["start"].alias("start"), acc["best"].alias("best"), acc["best_start"].alias("best_start"), (acc["blanks"] + 1).alias("blanks"))
        blank = passed if blanks_break is None else F.when(acc["blanks"] + 1 >= blanks_break, ended(acc["blanks"] + 1)).otherwise(passed)
        return F.when(m["k"] == 0, blank).when(m["k"] == 1, entry).otherwise(ended(F.lit(0)))

    return F.aggregate(marks, zero, step, lambda acc: F.struct(closed(acc)[0].alias("n"), closed(acc)[1].alias("start")))


def _marks(lines: Column, low: Column, high: Column, entry: Callable[[Column], Column]) -> Column:
    kind = lambda x: F.when(trim(x) == "", 0).when(entry(x), 1).otherwise(2)
    return _first_of(lines, low, high, kind, "int")


def _clusters(lines: Column, high: Column, entry: str, least: int, type_: str, base: float, most: float) -> Column:
    """All runs of at least so many entries, blank lines passed over."""
    marks = _marks(lines, F.lit(0), high, lambda x: trim(x).rlike(entry))
    none = F.lit(None).cast("int")
    zero = F.struct(F.lit(0).alias("n"), none.alias("start"), none.alias("end"), F.array().cast(SECTION).alias("out"))

    def closed(acc):
        one = F.struct(F.lit(type_).alias("type"), acc["start"].alias("start"), acc["end"].alias("end"), F.least(F.lit(most), F.lit(base) + acc["n"] * 0.05).alias("confidence"), acc["n"].alias("entries"))
        return F.when(acc["n"] >= least, F.concat(acc["out"], F.array(one).cast(SECTION))).otherwise(acc["out"])

    def step(acc, m):
        entry_ = F.struct((acc["n"] + 1).alias("n"), F.coalesce(acc["start"], m["i"]).alias("start"), m["i"].alias("end"), acc["out"].alias("out"))
        other = F.struct(F.lit(0).alias("n"), none.alias("start"), none.alias("end"), closed(acc).alias("out"))
        return F.when(m["k"] == 0, acc).when(m["k"] == 1, entry_).otherwise(other)

    return F.aggregate(marks, zero, step, closed)


def _last_before(lines: Column, start: Column, high: Column, stops: Callable[[Column], Column]) -> Column:
    """The last line that isn't blank after start and before the first stop, a third blank line in a row, or high; else start."""
    part = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda m: (m["i"] > start) & (m["i"] < high))
    kinds = F.transform(part, lambda m: F.struct(m["i"].alias("i"), F.when(trim(m["x"]) == "", 0).when(stops(trim(m["x"])), 2).otherwise(1).alias("k")))
    zero = F.struct(start.cast("int").alias("last"), F.lit(0).alias("blanks"), F.lit(False).alias("done"))

    def step(acc, m):
        blank = F.struct(acc["last"].alias("last"), (acc["blanks"] + 1).alias("blanks"), (acc["blanks"] + 1 >= 3).alias("done"))
        line = F.struct(m["i"].alias("last"), F.lit(0).alias("blanks"), F.lit(False).alias("done"))
        stop = F.struct(acc["last"].alias("last"), F.lit(0).alias("blanks"), F.lit(True).alias("done"))
        return F.when(acc["done"], acc).when(m["k"] == 0, blank).when(m["k"] == 1, line).otherwise(stop)

    return F.aggregate(kinds, zero, step, lambda acc: acc["last"])


def _count(lines: Column, test: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(lines, test))


def back_matter(lines: Column) -> Column:
    """The first back-matter heading in the second half; more headings add to the confidence."""
    return let(_back_matter, lines)


def _back_matter(lines: Column) -> Column:
    n = F.size(lines)

    def judged(hits):
        c = _plus(F.get(hits, 0)["k"], F.size(hits), ((3, 0.15), (2, 0.1)))
        c = F.when(F.get(hits, 0)["i"] / n < 0.55, c * 0.9).otherwise(c)
        return F.when(F.size(hits) > 0, _found(F.get(hits, 0)["i"], c))

    return _enough(lines, let(judged, _first_of(lines, floor_share(n, 0.5), n, lambda x: _weight(x, fixed.BACK_HEADINGS, fixed.BACK_PLAIN, True), "double")))


def _is_index_entry(x: Column) -> Column:
    return x.rlike(fixed.INDEX_ENTRY)


def index_start(lines: Column) -> Column:
    """An index heading in the last 30 percent with entries and letters below it, or a run of 30 entries."""
    return let(_index_start, lines)


def _index_start(lines: Column) -> Column:
    n = F.size(lines)
    low = floor_share(n, 0.7)

    def judged(first, weight, entries, letters):
        c = _plus(_plus(weight, entries, ((20, 0.2), (10, 0.15), (5, 0.1))), letters, ((5, 0.1), (1, 0.05)))
        return F.when((weight >= 1.0) | (entries >= 5), _found(first, c))

    def headed(hits):
        first = F.get(hits, 0)["i"]
        below = window_of(lines, first, EVIDENCE_LINES)
        return let(judged, first, F.get(hits, 0)["k"], _count(below, _is_index_entry), _count(below, _holding(fixed.LETTER_DIVIDER)))

    dense = lambda run: F.when(run["n"] >= 30, _found(run["start"], F.least(F.lit(0.8), F.lit(0.5) + run["n"] / 100.0)))
    without = let(dense, _longest_run(_marks(lines, low, n, _is_index_entry), None))
    hits = _first_of(lines, low, n, lambda x: _weight(x, fixed.INDEX_HEADINGS, fixed.INDEX_PLAIN, False), "double")
    return _enough(lines, let(lambda h: F.when(F.size(h) > 0, headed(h)).otherwise(without), hits))


def _holding(pattern: str) -> Callable[[Column], Column]:
    return lambda x: x.rlike(pattern)


def _indicator(x: Column) -> Column:
    """Which kinds of front-matter lines a line is: an array of weights, null for those it isn't."""
    return F.array(*[F.when(x.rlike(f"(?iu){p}"), F.lit(w)) for p, w in fixed.FRONT_INDICATORS])


def indicator_kinds(lines: Column, last: Column) -> Column:
    """How many kinds of front-matter lines occur up to a line."""
    part = F.slice(lines, 1, F.greatest(last + 1, F.lit(0)))
    total = F.lit(0)
    for p, _ in fixed.FRONT_INDICATORS:
        total = total + F.exists(part, _holding(f"(?iu){p}")).cast("int")
    return total


def front_matter_end(lines: Column) -> Column:
    """The line before the main content within the first 30 percent, else the end of the copyright lines."""
    return let(_front_matter_end, lines)


def _front_matter_end(lines: Column) -> Column:
    n = F.size(lines)
    high = floor_share(n, 0.3)

    def by_main(main):
        end = main["i"] - 1
        c = _plus(_weight_at(main["p"], fixed.MAIN_STARTS), indicator_kinds(lines, end), ((3, 0.15), (1, 0.1)))
        return F.when(main.isNotNull() & (end >= 3), F.struct(end.cast("int").alias("line"), c.alias("confidence")))

    def ended(marks, hits, last, stop, following):
        blank = trim(stop["x"]) == ""
        heading = trim(following["x"]).startswith("#") | F.upper(trim(following["x"])).startswith("CHAPTER")
        boundary = F.when(stop.isNull(), last).when(~blank, stop["i"] - 1).when(following.isNull(), last).when(heading, following["i"] - 1).otherwise(stop["i"])
        c = F.when(hits >= 4, 0.85).when(hits >= 3, 0.75).otherwise(0.6)
        c = F.when(F.exists(marks, lambda m: F.array_max(m["w"]) >= 1.0), _bounded(c + 0.1)).otherwise(c)
        return F.when(hits >= 2, F.struct(boundary.cast("int").alias("line"), c.alias("confidence")))

    def by_marks(marks):
        last = F.try_element_at(marks, F.lit(-1))["i"]
        after = F.filter(with_index(lines), lambda m: (m["i"] > last) & (m["i"] < F.least(last + 20, high, n)))
        stop = F.get(F.filter(after, lambda m: (trim(m["x"]) == "") | trim(m["x"]).startswith("#")), 0)
        hits = F.aggregate(marks, F.lit(0), lambda acc, m: acc + F.size(m["w"]))
        following = lambda s: F.get(F.filter(with_index(lines), lambda m: (m["i"] > s["i"]) & (m["i"] < F.least(s["i"] + 5, n)) & (trim(m["x"]) != "")), 0)
        return let(lambda h, e, s: let(lambda f: ended(marks, h, e, s, f), following(s)), hits, last, stop)

    kinds = once_each(F.slice(lines, 1, F.greatest(high, F.lit(0))), lambda x: F.filter(_indicator(x), lambda w: w.isNotNull()))
    marks = F.filter(F.transform(kinds, lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda m: F.size(m["w"]) > 0)
    return _enough(lines, F.coalesce(let(by_main, _by_order(lines, high, fixed.MAIN_STARTS)), let(by_marks, marks)))


def _is_toc_entry(x: Column) -> Column:
    return x.rlike(fixed.TOC_ENTRY) | x.rlike(fixed.PAGED_LINE)


def toc_start(lines: Column) -> Column:
    """A contents heading in the first 30 percent with entries below it, or a run of eight entries."""
    return let(_toc_start, lines)


def _toc_start(lines: Column) -> Column:
    n = F.size(lines)
    high = floor_share(n, 0.3)

    def judged(head, weight, entries):
        c = _plus(weight, entries, ((10, 0.2), (5, 0.15), (3, 0.1)), 0.7)
        return F.struct((head.isNotNull() & ((weight >= 1.0) | (entries >= 3))).alias("ok"), _found(head["i"], c).alias("found"))

    def headed(head):
        below = window_of(lines, head["i"] + 1, EVIDENCE_LINES)
        chapter = F.array_min(F.filter(F.transform(below, lambda x, i: F.when(trim(x).rlike(r"^##? Chapter") | F.upper(trim(x)).startswith("CHAPTER 1"), i)), lambda i: i.isNotNull()))
        entries = _count(F.slice(below, 1, F.coalesce(chapter, F.size(below))), lambda x: (trim(x) != "") & _is_toc_entry(x))
        return let(lambda k: judged(head, _weight_at(head["p"], fixed.TOC_HEADERS), k), entries)

    dense = lambda run: F.when(run["n"] >= 8, _found(run["start"], F.least(F.lit(0.75), F.lit(0.5) + run["n"] / 50.0)))
    without = let(dense, _longest_run(_marks(lines, F.lit(0), high, _is_toc_entry), 3))
    return _enough(lines, let(lambda j: F.when(F.coalesce(j["ok"], F.lit(False)), j["found"]).otherwise(without), let(headed, _by_order(lines, high, fixed.TOC_HEADERS))))


def toc_end(lines: Column, start: Column) -> Column:
    """The last line of a table of contents that begins at start."""

    def stops(t):
        up = F.upper(t)
        opening = up.startswith("CHAPTER ") | up.startswith("PART ") | up.startswith("PROLOGUE") | up.startswith("INTRODUCTION")
        return (t.startswith("# ") & ~F.lower(t).contains("contents")) | (opening & ~t.rlike(r"\s+\d+\s*$"))

    return F.when(start < F.size(lines), _last_before(lines, start, F.least(start + 100, F.size(lines)), stops)).otherwise(start)


def _list_weight(x: Column) -> Column:
    return _weight(x, fixed.LIST_HEADINGS, fixed.LIST_PLAIN, False)


def _is_list_entry(x: Column) -> Column:
    c = x.rlike(f"(?iu){fixed.LIST_ENTRIES[0]}")
    for p in fixed.LIST_ENTRIES[1:]:
        c = c | x.rlike(f"(?iu){p}")
    return c


def list_type(heading: Column) -> Column:
    c = F.lit("Auxiliary List")
    for p, name in reversed(fixed.LIST_TYPES):
        c = F.when(F.upper(heading).rlike(p), name).otherwise(c)
    return c


def list_end(lines: Column, start: Column, high: Column) -> Column:
    def stops(t):
        up = F.upper(t)
        other = (t == up) & (F.length(t) > 3) & (F.length(t) < 50) & ~t.contains(".") & ~t.rlike(r"^\p{N}") & _list_weight(t).isNotNull()
        return t.startswith("#") | other | up.startswith("CHAPTER ") | up.startswith("PART ") | up.startswith("PROLOGUE") | up.startswith("INTRODUCTION")

    return _last_before(lines, start, F.least(start + 100, high, F.size(lines)), stops)


def auxiliary_lists(lines: Column) -> Column:
    """Sections under list headings in the first 40 percent; a heading inside a section already found is no other's."""
    high = floor_share(F.size(lines), 0.4)
    heads = _first_of(lines, F.lit(0), high, _list_weight, "double")

    def section(h):
        end = list_end(lines, h["i"], high)
        entries = _count(window_of(lines, h["i"] + 1, end - h["i"]), _is_list_entry)
        c = _plus(h["k"], entries, ((5, 0.15), (2, 0.1)), 0.7)
        return F.struct(list_type(F.get(lines, h["i"])).alias("type"), h["i"].alias("start"), end.alias("end"), c.alias("confidence"), entries.alias("entries"))

    good = F.filter(F.transform(heads, section), lambda s: s["confidence"] >= LEAST_CONFIDENCE)
    zero = F.struct(F.lit(-1).alias("end"), F.array().cast(SECTION).alias("out"))
    take = lambda acc, s: F.when(s["start"] > acc["end"], F.struct(s["end"].alias("end"), F.concat(acc["out"], F.array(s).cast(SECTION)).alias("out"))).otherwise(acc)
    return F.when(F.size(lines) >= LEAST_LINES, F.aggregate(good, zero, take, lambda acc: acc["out"])).otherwise(F.array().cast(SECTION))


def headerless_lists(lines: Column) -> Column:
    """Runs of abbreviations and of contributors in the first 40 percent, of documents of any length."""
    high = floor_share(F.size(lines), 0.4)
    return F.concat(_clusters(lines, high, fixed.ABBREVIATION, 3, "abbreviations", 0.5, 0.7), _clusters(lines, high, fixed.CONTRIBUTOR, 2, "contributors", 0.55, 0.75))


def notes_sections(lines: Column) -> Column:
    """Structs (start, end) from each notes heading to the line before the next closing heading, or the last line."""
    might = lambda x: has_any(x, "#", "NOTES")
    kind = lambda x: F.when(~might(x), None).when(trim(x).rlike(fixed.NOTES_START), 1).when(trim(x).rlike(fixed.NOTES_END), 2)
    marks = _first_of(lines, F.lit(0), F.size(lines), kind, "int")
    type_ = "array<struct<start:int,end:int>>"
    none = F.lit(None).cast("int")
    zero = F.struct(none.alias("open"), F.array().cast(type_).alias("out"))

    def closed(acc, end):
        return F.when(acc["open"].isNotNull() & (end > acc["open"]), F.concat(acc["out"], F.array(F.struct(acc["open"].alias("start"), end.cast("int").alias("end"))).cast(type_))).otherwise(acc["out"])

    def step(acc, m):
        opened = F.struct(m["i"].alias("open"), acc["out"].alias("out"))
        shut = F.struct(none.alias("open"), closed(acc, m["i"] - 1).alias("out"))
        return F.when((m["k"] == 1) & acc["open"].isNull(), opened).when((m["k"] == 2) & acc["open"].isNotNull(), shut).otherwise(acc)

    return F.aggregate(marks, zero, step, lambda acc: closed(acc, F.size(lines) - 1))


def keyword_boundaries(lines: Column, front_end: Column | None = None, back_start: Column | None = None) -> Column:
    """A struct (front_end, back_start): what is known already, else the last front-matter word before the core
    within the first 202 lines, and the last back-matter word within the last 500."""
    low = lambda x: F.lower(trim(x))
    front = lambda x: low(x).rlike("|".join(fixed.FRONT_WORDS))
    core = lambda x: low(x).rlike(f"^(?:{'|'.join(fixed.CORE_WORDS)})")
    kind = lambda x: F.when(front(x) | core(x), F.struct(front(x).alias("f"), core(x).alias("c")))
    marks = _first_of(lines, F.lit(0), F.lit(202), kind, "struct<f:boolean,c:boolean>")
    none = F.lit(None).cast("int")
    zero = F.struct(none.alias("last"), none.alias("found"))

    def step(acc, m):
        last = F.when(m["k"]["f"], m["i"]).otherwise(acc["last"])
        found = F.when(acc["found"].isNull() & m["k"]["c"] & last.isNotNull(), m["i"] - 1).otherwise(acc["found"])
        return F.struct(last.cast("int").alias("last"), found.cast("int").alias("found"))

    by_front = F.aggregate(marks, zero, step, lambda acc: F.coalesce(acc["found"], acc["last"]))
    n = F.size(lines)
    back = _first_of(lines, F.greatest(n - 500, F.lit(0)), n, lambda x: F.when(low(x).rlike(f"^(?:{'|'.join(fixed.BACK_WORDS)})"), 1), "int")
    by_back = F.try_element_at(back, F.lit(-1))["i"]
    front_end = by_front if front_end is None else F.coalesce(front_end, by_front)
    back_start = by_back if back_start is None else F.coalesce(back_start, by_back)
    enough = n >= 10
    return F.struct(F.when(enough, front_end).alias("front_end"), F.when(enough, back_start).alias("back_start"))


def core_range(front_ends: Column, back_starts: Column, n: Column) -> Column:
    """A struct (start, end) of the main content between front- and back-matter regions."""
    start = F.least(F.coalesce(F.array_max(front_ends), F.lit(0)) + 1, n)
    end = F.greatest(F.coalesce(F.array_min(back_starts), n) - 1, start)
    return F.struct(start.alias("start"), end.alias("end"))


def zone_within(lines: Column, start: Column, end: Column, headers: str, entry: str, reach: int, slack: int) -> Column:
    """A struct (start, end) of the first headed run of entries inside a region, null if there is none."""
    head = F.array_min(F.filter(F.transform(lines, lambda x, i: F.when((i >= start) & (i <= end) & trim(x).rlike(headers), i)), lambda i: i.isNotNull()))
    part = F.filter(with_index(lines), lambda m: (m["i"] > head) & (m["i"] <= F.least(end, head + reach)))
    zero = F.struct(head.alias("last"), F.lit(False).alias("done"))

    def step(acc, m):
        t = trim(m["x"])
        stop = (t != "") & (acc["last"] > head + slack)
        return F.when(acc["done"], acc).when(t.rlike(entry), F.struct(m["i"].alias("last"), F.lit(False).alias("done"))).when(stop, F.struct(acc["last"].alias("last"), F.lit(True).alias("done"))).otherwise(acc)

    last = F.aggregate(part, zero, step, lambda acc: acc["last"])
    return F.when(last > head, F.struct(head.alias("start"), last.alias("end")))


def toc_zone(lines: Column, start: Column, end: Column) -> Column:
    return zone_within(lines, start, end, "|".join(f"(?:{p})" for p, _ in fixed.TOC_HEADERS), fixed.TOC_ENTRY, 200, 0)


def index_zone(lines: Column, start: Column, end: Column) -> Column:
    heads = [_heading(fixed.INDEX_HEADINGS, w) for w in fixed.INDEX_HEADINGS] + [rf"^(?:{'|'.join(fixed.INDEX_PLAIN[0.9])})$"]
    return zone_within(lines, start, end, "|".join(f"(?:{p})" for p in heads), fixed.INDEX_ENTRY, 500, 5)
