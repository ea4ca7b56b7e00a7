"""Documents as ordered arrays of lines, numbered from 0: splitting, counting, slicing."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F

#: Each of these ends a line, so a CR LF pair ends two; the range is line feed, vertical tab, form feed and carriage return.
NEWLINES = r"[\n-\r\u0085\u2028\u2029]"
#: Space separators and the tab.
_BLANKS = "\t \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
_SPACE = r"[\s\u0085\p{Z}]"


def let(body: Callable[..., Column], *values: Column) -> Column:
    """body(*values), with each value evaluated once however often the body uses it.

    A column that a lambda uses would be evaluated for each element; a lambda over an array of one
    struct binds the values instead.
    """
    bound = F.struct(*[v.alias(f"v{k}") for k, v in enumerate(values)])
    return F.get(F.transform(F.array(bound), lambda r: body(*[r[f"v{k}"] for k in range(len(values))])), 0)


def has_any(text: Column, *literals: str) -> Column:
    """Whether one of some literals occurs; bytes are compared, so the text isn't decoded as for a pattern."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(x)) for x in literals])


def beyond_ascii(text: Column) -> Column:
    """Whether a text has other than ASCII characters."""
    return F.octet_length(text) > F.length(text)


def has_other_ends(text: Column) -> Column:
    """Whether a line end other than the line feed occurs."""
    return has_any(text, "\x0b", "\x0c", "\r") | (beyond_ascii(text) & has_any(text, "\u0085", "\u2028", "\u2029"))


def ends_in(text: Column, marks: str) -> Column:
    """What the pattern [marks]$ finds, which also fits before a line end that is the last character."""
    last = reduce(lambda a, b: a | b, [F.endswith(text, F.lit(m)) for m in marks])
    return last | ((text.contains("\n") | has_other_ends(text)) & text.rlike(f"[{marks}]$"))


def split_lines(text: Column) -> Column:
    """Most texts have line feeds only, at which is split without a pattern."""
    return let(lambda t: F.when(has_other_ends(t), F.split(t, NEWLINES, -1)).otherwise(relined(t)), text)


def relined(text: Column) -> Column:
    """The lines of a text that `join_lines` made: no other line ends are in it, and one character is split at without a pattern."""
    return F.split(text, "\n", -1)


def join_lines(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def trim(text: Column) -> Column:
    """Without space separators and tabs at the ends; line ends stay."""
    return F.btrim(text, F.lit(_BLANKS))


def trim_line(line: Column) -> Column:
    """`trim` for a value that is at hand: ASCII lines without blanks at the ends are left as they are."""
    return F.when(_padded(line, " \t"), trim(line)).otherwise(line)


def trim_text(text: Column) -> Column:
    """`trim_all`, as `trim_line`."""
    return let(lambda t: F.when(_padded(t, " \t\n\r\x0b\x0c"), trim_all(t)).otherwise(t), text)


def _padded(text: Column, blanks: str) -> Column:
    return reduce(lambda a, b: a | b, [test(text, F.lit(c)) for c in blanks for test in (F.startswith, F.endswith)]) | beyond_ascii(text)


def trim_all(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANKS + "\n\r\x0b\x0c\u0085\u2028\u2029"))


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"{_SPACE}+", -1), lambda w: w != "")


def count_words(text: Column) -> Column:
    """Visible ASCII is named first, as most characters are, and the rest of the class isn't looked at for them."""
    return F.regexp_count(text, F.lit(r"[!-~[^\s\u0085\p{Z}]]+"))


def count_lines(text: Column) -> Column:
    return F.when(text == "", 0).otherwise(F.size(split_lines(text)))


def count_chars(text: Column) -> Column:
    """Code points."""
    return F.length(text)


def count_changes(before: Column, after: Column) -> Column:
    """Distinct lines that only one of two texts has."""
    a, b = split_lines(before), split_lines(after)
    return F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))


def floor_share(n: Column, share: float) -> Column:
    """A line limit: the share of n, truncated after double multiplication."""
    return (n.cast("double") * F.lit(share)).cast("int")


def with_index(lines: Column) -> Column:
    """Structs (i, x) of lines."""
    return F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x")))


#: Up to so many different lines are looked up by comparison.
FEW_LINES = 256


def once_each(lines: Column, change: Callable[[Column], Column]) -> Column:
    """F.transform(lines, change) for lines that aren't null; where a document repeats few lines, each is changed once.

    With more different lines than `FEW_LINES`, or fewer repetitions, each line is changed where it stands.
    """

    def placed(x, few):
        back = lambda made: F.when(F.size(few) < F.size(x), F.transform(x, lambda line: F.get(made, F.array_position(few, line).cast("int") - 1))).otherwise(made)
        return let(back, F.transform(few, change))

    few = lambda x, u: F.when((F.size(u) <= FEW_LINES) & (F.size(u) * 2 <= F.size(x)), u).otherwise(x)
    return let(lambda x: let(lambda f: placed(x, f), let(lambda u: few(x, u), F.array_distinct(x))), lines)


def kept(lines: Column, test: Callable[[Column], Column]) -> Column:
    """F.filter(lines, test), where each different line is tested once as in `once_each`."""
    return let(lambda x: let(lambda on: F.filter(x, lambda _, i: F.get(on, i)), once_each(x, test)), lines)


def count_words_in(lines: Column, of: Callable[[Column], Column] = count_words) -> Column:
    """The words of joined lines, as line ends are between words."""
    return F.aggregate(once_each(lines, of), F.lit(0), lambda acc, n: acc + n)


def window_of(lines: Column, start: Column, size: Column | int) -> Column:
    """At most size lines from start (from 0) on."""
    size = F.lit(size) if isinstance(size, int) else size
    return F.slice(lines, start.cast("int") + 1, F.greatest(size.cast("int"), F.lit(0)))


def first_chars(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def first_lines(text: Column, n: int) -> Column:
    return join_lines(F.slice(split_lines(text), 1, n))


def sample_pages(text: Column, pages: int = 100, lines_per_page: int = 50) -> Column:
    return first_lines(text, pages * lines_per_page)


def excerpt(lines: Column, start: int, tokens: int, chars_per_token: int = 4) -> Column:
    """Whole lines from start on, each with its line end, until the next would pass the limit."""
    limit = tokens * chars_per_token
    add = lambda acc, x: F.when(
        acc["full"] | (F.length(acc["text"]) + F.length(x) + 1 > limit), F.struct(acc["text"].alias("text"), F.lit(True).alias("full"))
    ).otherwise(F.struct(F.concat(acc["text"], x, F.lit("\n")).alias("text"), F.lit(False).alias("full")))
    rest = F.slice(lines, start + 1, F.greatest(F.size(lines) - start, F.lit(0)))
    return F.aggregate(rest, F.struct(F.lit("").alias("text"), F.lit(False).alias("full")), add, lambda acc: acc["text"])


def sample_thirds(text: Column, limit: int) -> Column:
    """The text, or of a longer one a third of the limit from its beginning, middle and end."""
    third = limit // 3
    n = F.length(text)
    middle = F.substring(text, (F.floor(n / 2) - third // 2 + 1).cast("int"), F.lit(third))
    cut = F.concat_ws("\n\n[...]\n\n", F.substring(text, 1, third), middle, F.right(text, F.lit(third)))
    return F.when(n <= limit, text).otherwise(cut)


def contains(start: Column, end: Column, line: Column) -> Column:
    return (line >= start) & (line <= end)


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return (s1 <= e2) & (s2 <= e1)


def intersection(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """The common range of two, null if there is none."""
    return F.when(overlaps(s1, e1, s2, e2), F.struct(F.greatest(s1, s2).alias("start"), F.least(e1, e2).alias("end")))
