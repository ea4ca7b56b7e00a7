"""HTML extraction by differencing each page against its nearest neighbour by URL.

Pages are dealt by ranges of (host, path, page_id), so a hot host spreads over many tasks, and are
read in that order; the first and last page of a range are sent to the range beside it too, so that
neighbours don't depend on where ranges end.  A page's partner is the one of its two neighbours on the same host whose path
shares the longer beginning (the one before on a tie).  The lines of both are aligned by their
longest common subsequence, and the lines shared are deleted: menus, notices, footers and whatever else
a site repeats.

Differencing has the first word, and structure corrects it in both directions:

* lines inside an element that names itself as the article stay even if a neighbour shares them, as sites
  repeat passages and whole articles;
* lines that no neighbour shares go if they stand in an element that names itself as navigation, header,
  footer, sidebar, advert, form, comment and so on, or outside of the article on a page that marks one;
* should a pair share all lines that aren't in such elements, the pages are copies and these lines stay.

Each row says how many blocks each rule decided: n_article and n_own (kept: in a marked article, or shared with
no neighbour), n_shared (deleted by differencing), n_chrome and n_outside (deleted by structure), n_protected
(those of n_article that differencing would have deleted).

A block's character references are decoded, its white space runs become one space, it is trimmed,
and blocks are joined in page order by two line feeds.

Defined results: null or empty html gives an empty text; a null url has an empty host and path, so
such pages are neighbours of each other; repeated rows are extracted each (a copy is the nearest neighbour of
its copy); of two equally near neighbours the one before counts; very long pages are aligned exactly, in
memory in proportion to their lines; a quote that isn't closed ends with its tag, if no other quote follows; tags that aren't closed
end with their parent; a script or comment that isn't closed reaches to the end.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import small
from .url_filter import split_url

# HTML elements by role.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre search section summary table tbody tfoot thead title tr ul".split())
RAW = frozenset("script style noscript template textarea iframe noembed noframes xmp title".split())
DROPPED = frozenset("nav footer aside form menu dialog button select head svg canvas object audio video map search fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Words in class, id and role that name what isn't main text.
CHROME = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent dialog disqus footer gdpr header login masthead menu menubar modal nav navbar navigation navigations newsletter notice notices overlay pager pagination paywall popup promo promoted promotion related recommended recommendations reply replies respond search share sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription syndication toc toolbar topbar widget widgets complementary contentinfo alert replybox reader".split()
)
ASIDE = frozenset("ad ads advert advertisement comment comments promo related reply sponsored teaser".split())
# Words of CHROME that name parts of an article too; inside of one they count only beside words such as PARTS.
WITHIN = frozenset("banner header notice notices reader related search share sharing skip social toc".split())
PARTS = frozenset("area bar block box buttons container icons inner items links list outer section slot wrap wrapper".split())
ARTICLE, CHROME_LINE, PLAIN = 2, 1, 0
MAIN = re.compile(r"(?:^|[\s_-])(?:article|main|story|post|entry)(?:[-_]?(?:body|content|text))?(?:$|\s)|^content$|articlebody", re.I)

#: A quote counts as one only after an equals sign, as in title=it's it is a character like any other.
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:"[^"]*"|'[^']*')|[^>])*+)>|<[!?][^>]*>""", re.S)
#: What can still match behind the last ">": groups as in _TAG.
_OPEN = re.compile(r"<!--.*\Z()()()", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
_WORDS = re.compile(r"[a-z]+")


def _names(attributes: str) -> dict[str, str]:
    return {k.lower(): html.unescape(v.strip("\"'")) for k, v in _ATTR.findall(attributes)} if "=" in attributes else {}


def _chrome(tag: str, named: dict[str, str], inside: bool) -> bool:
    if tag in DROPPED or tag == "header" and not inside or "hidden" in named or named.get("aria-hidden") == "true":
        return True
    marks = f"{named.get('class', '')} {named.get('id', '')} {named.get('role', '')}".lower()
    if tag in ("body", "html", "main") or not marks.strip():
        return False
    if tag == "article":
        return not ASIDE.isdisjoint(_WORDS.findall(marks))
    if not inside:
        return not CHROME.isdisjoint(_WORDS.findall(marks))
    for mark in marks.split():
        words = set(_WORDS.findall(mark))
        if words & (CHROME - WITHIN) or words & WITHIN - {"header", "reader"} and words <= CHROME | PARTS:
            return True
    return False


def _main(tag: str, named: dict[str, str]) -> bool:
    return tag in ("article", "main") or named.get("role", "").lower() in ("main", "article") or any(MAIN.search(named.get(k, "")) for k in ("class", "id", "itemprop"))


def blocks(page: str) -> list[tuple[str, int]]:
    """(text, kind) of the page's blocks: ARTICLE, CHROME_LINE or PLAIN."""
    out: list[tuple[str, int]] = []
    parts: list[str] = []
    at, stack = 0, []  # open elements that matter: (tag, depth of that tag, kind)
    skip: tuple[str, int] | None = None
    inside = 0

    def flush():
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append((text, CHROME_LINE if skip else ARTICLE if inside else PLAIN))

    end, last = len(page), page.rfind(">")
    while at < end:
        m = _TAG.search(page, at) if at <= last else _OPEN.search(page, at)
        if not m:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        if not m.group(2):
            continue
        closing, tag = m.group(1), m.group(2).lower()
        if skip is not None:
            name, depth = skip
            if tag in BLOCKS or tag in RAW or tag == name:
                flush()
            elif tag in ("br", "td", "th"):
                parts.append(" ")
            if tag in RAW and not closing:
                at = _past(page, tag, at)
            elif tag == name and not m.group(3).endswith("/"):
                depth += -1 if closing else 1
                skip = (name, depth) if depth else None
            elif closing and tag in ("body", "html") or not closing and tag in ("main", "article") and name in ("nav", "header", "head", "form", "menu") or not closing and tag == "body":
                skip = None  # the element wasn't closed
                if tag in ("main", "article"):
                    at = m.start()
            continue
        if tag in RAW and not closing and not m.group(3).endswith("/"):
            if tag not in ("noscript", "textarea", "title", "xmp"):
                flush()
            at = _past(page, tag, at)
            continue
        if tag in BLOCKS:
            flush()
        elif tag in ("br", "td", "th"):
            parts.append(" ")
        if tag in VOID or m.group(3).endswith("/"):
            continue
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    inside -= sum(s[1] for s in stack[k:])
                    del stack[k:]
                    break
            continue
        named = _names(m.group(3))
        if _chrome(tag, named, inside > 0):
            flush()
            skip = (tag, 1)
        elif tag in ("article", "main", "section", "div", "td"):
            main = _main(tag, named)
            stack.append((tag, main))
            inside += main
    flush()
    return out


def _past(page: str, tag: str, at: int) -> int:
    m = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
    return m.end() if m else len(page)


def _lengths(a: list, b: list) -> list[int]:
    """The length of the longest common subsequence of a and each beginning of b, bits of one integer for the row of a table."""
    where: dict = defaultdict(int)
    for j, x in enumerate(b):
        where[x] |= 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        met = row & where[x] if x in where else 0
        row = (row + met | row - met) & full
    bits = bin(row | 1 << len(b))[:2:-1]  # a zero for each place of b that lengthens the subsequence
    out = [0]
    for c in bits[: len(b)]:
        out.append(out[-1] + (c == "0"))
    return out


def _halved(a: list, b: list) -> list[int]:
    """Places in a of a longest common subsequence, in memory in proportion to the lines (Hirschberg)."""
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, k, j, m = todo.pop()
        if i == k or j == m:
            continue
        if k - i == 1:
            if a[i] in b[j:m]:
                found.append(i)
            continue
        mid = (i + k) // 2
        left, right = _lengths(a[i:mid], b[j:m]), _lengths(a[mid:k][::-1], b[j:m][::-1])[::-1]
        cut = max(range(m - j + 1), key=lambda x: left[x] + right[x])
        todo += [(i, mid, j, j + cut), (mid, k, j + cut, m)]
    return found


#: Pairs of equal lines up to which links between them are kept in memory.
PAIRS = 1 << 18


def shared(a: list[str], b: list[str]) -> set[int]:
    """Places in a of a longest common subsequence with b (Hunt and Szymanski, or halving where lines repeat very often)."""
    lo, found = 0, set()
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        found.add(lo)
        lo += 1
    ea, eb = len(a), len(b)
    while ea > lo and eb > lo and a[ea - 1] == b[eb - 1]:
        ea, eb = ea - 1, eb - 1
        found.add(ea)
    where = defaultdict(list)
    for j in range(eb - 1, lo - 1, -1):
        where[b[j]].append(j)
    if sum(len(where.get(x, ())) for x in a[lo:ea]) > PAIRS:
        return found | {lo + i for i in _halved(a[lo:ea], b[lo:eb])}
    ends: list[int] = []
    links: list[tuple] = []
    for i in range(lo, ea):
        for j in where.get(a[i], ()):
            k = bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[k], links[k] = j, link
    link = links[-1] if links else None
    while link:
        found.add(link[0])
        link = link[1]
    return found


KEPT_ARTICLE, KEPT_OWN, SHARED, CHROME_RULE, OUTSIDE = range(5)
COUNTS = ("n_article", "n_own", "n_shared", "n_chrome", "n_outside", "n_protected")


def decided(page: list[tuple[str, int]], partner: list[tuple[str, int]] | None) -> tuple[list[int], int]:
    """The rule that decided each block of a page, given those of its nearest page; how many article blocks are shared."""
    lines = [t for t, _ in page]
    same = shared(lines, [t for t, _ in partner]) if partner else set()
    marked = any(kind == ARTICLE for _, kind in page)
    if partner and not marked:
        body = [k for k, (_, kind) in enumerate(page) if kind != CHROME_LINE]
        if same.issuperset(body) and len(body) == sum(kind != CHROME_LINE for _, kind in partner):
            same -= set(body)  # nothing of its own on either page: copies
    out = []
    for k, (_, kind) in enumerate(page):
        if kind == ARTICLE:
            out.append(KEPT_ARTICLE)
        elif k in same:
            out.append(SHARED)
        elif kind == CHROME_LINE:
            out.append(CHROME_RULE)
        else:
            out.append(OUTSIDE if marked else KEPT_OWN)
    return out, sum(page[k][1] == ARTICLE for k in same)


def main_text(page: list[tuple[str, int]], partner: list[tuple[str, int]] | None) -> str:
    """The page's main text, given its blocks and those of its nearest page."""
    return "\n\n".join(t for (t, _), rule in zip(page, decided(page, partner)[0], strict=True) if rule <= KEPT_OWN)


def _alike(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def with_edges(rows: DataFrame, parts: int) -> DataFrame:
    """rows dealt to ranges of (host, path, page_id), in order, with the edge pages of the ranges beside; own: not such a copy.

    The ranges are found from the keys alone; the driver gets two keys of each.
    """
    key = F.struct("host", "path", "page_id")
    keys = rows.select(key.alias("k")).repartitionByRange(parts, "k").groupBy(F.spark_partition_id().alias("part")).agg(F.min("k").alias("low"), F.max("k").alias("high"))
    ends = [(tuple(r["low"]), tuple(r["high"])) for r in keys.orderBy("part").collect()]
    kind = "struct<host:string,path:string,page_id:bigint>"
    listed = lambda found: F.array(*(F.struct(*map(F.lit, k)) for k in found)).cast(f"array<{kind}>")
    lows, highs = listed(low for low, _ in ends), listed(high for _, high in ends)
    part = F.size(F.filter(lows, lambda low: F.col("__k") >= low)) - 1
    placed = rows.withColumn("__k", key).withColumn("__part", part)
    near = F.array(F.col("__part"), F.when(F.col("__k") == F.get(lows, F.col("__part")), F.col("__part") - 1), F.when(F.col("__k") == F.get(highs, F.col("__part")), F.col("__part") + 1))
    sent = placed.withColumn("__to", F.explode(near)).filter(F.col("__to").between(0, max(len(ends) - 1, 0)))
    dealt = sent.repartitionById(max(len(ends), 1), F.col("__to")).sortWithinPartitions("host", "path", "page_id")
    return dealt.select("page_id", "__url", "html", "host", "path", (F.col("__to") == F.col("__part")).alias("own"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row of pages, and n_article, n_own, n_shared, n_chrome, n_outside, n_protected (blocks)."""
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("__url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    host, path = split_url(F.col("__url"))
    rows = rows.withColumn("host", F.coalesce(host, F.lit(""))).withColumn("path", F.coalesce(path, F.lit("")))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4)
    dealt = with_edges(rows, parts)
    kind = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), *((c, pa.int32()) for c in COUNTS)])

    def run(batches):
        before = now = None  # (page_id, url, host, path, blocks, whether this range owns it)

        def row(p, left, right):
            near = [(_alike(p[3], q[3]), -k, q[4]) for k, q in enumerate((left, right)) if q and q[2] == p[2]]
            rules, protected = decided(p[4], max(near)[2] if near else None)
            text = "\n\n".join(t for (t, _), rule in zip(p[4], rules, strict=True) if rule <= KEPT_OWN)
            counts = [rules.count(k) for k in range(5)] + [protected]
            return {"page_id": p[0], "url": p[1], "text": text, "n_chars": len(text)} | dict(zip(COUNTS, counts, strict=True))

        for b in small(batches):
            out = []
            for page_id, url, source, host, path, own in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                after = (page_id, url, host, path, blocks(source), own)
                if now and now[5]:
                    out.append(row(now, before, after))
                before, now = now, after
            yield pa.RecordBatch.from_pylist(out, schema=kind)
        if now and now[5]:
            yield pa.RecordBatch.from_pylist([row(now, before, None)], schema=kind)

    return dealt.mapInArrow(run, "page_id long, url string, text string, n_chars long, " + ", ".join(f"{c} int" for c in COUNTS))
