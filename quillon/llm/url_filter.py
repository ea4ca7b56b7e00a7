"""URL filters: rules first, gradient-boosted trees on lexical features for the rest.

Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased.  Path: from there up
to `?`, `#` or the end.  A url that is null or has no `://` has an empty host and path.  A rule
fits its host and all subdomains if the url's path starts with the rule's path; of the rules that
fit, the longest (host and path together, then host) wins.

Urls that a rule decides are the labelled ones: block is 1, allow is 0.  Lexical features are cut
into few bins: length, depth, digit ratio, entropy, parameter counts and statistics of the host's
suffix.  Those statistics are how common the suffix is among all urls, and its length; no label enters
a feature, so a suffix whose labelled urls are all of one kind doesn't decide the others.  A suffix
has at least the least share that tells bins apart or is in the lowest bin, so the table of
shares has at most 1 / `SHARES[0]` rows and is exact.  Equal feature vectors are counted by Spark, and the
boosted trees are fitted on those counts (`TRAIN_VECTORS` of the most frequent vectors at most, a
documented bound).  The trees become one arithmetic expression of CASE columns, so scoring stays in
Spark's generated code.  `held_out_accuracy` leaves out whole hosts.

Defined results: with no labelled url, or labels of one kind, the score is that kind's rate
(0.5 without labels), and a score of `THRESHOLD` or more means block; repeated rows are judged
alike, very long ones are read whole; ties between splits go to the first feature and lowest cut;
an empty table gives no rows; other columns pass unread.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

TRAIN_VECTORS = 4000
THRESHOLD = 0.5
#: Cuts between the bins of a suffix's share of all urls; all common suffixes are alike, or their shares would name them.
SHARES = (0.005, 0.02, 0.1)


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path; (?s) so that line breaks inside a url are ordinary characters."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.expr("substring(__url, instr(__url, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def with_rule(df: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    ordered = sorted(rules, key=lambda r: (-len(r.text), -len(r.host), r.text))
    fits = lambda r: ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
    pick = lambda what: reduce(lambda other, r: F.when(fits(r), F.lit(what(r))).otherwise(other), reversed(ordered), F.lit(None).cast("string"))
    return df.withColumn("rule", pick(lambda r: r.text)).withColumn("rule_verdict", pick(lambda r: r.verdict))


def entropy(c: Column) -> Column:
    """Shannon entropy of the characters of c, in bits."""
    n = F.length(c)
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    return F.when(n == 0, 0.0).otherwise(F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, x: acc - _share(c, x) * F.log2(_share(c, x))))


def _share(c: Column, x: Column) -> Column:
    return (F.length(c) - F.length(F.replace(c, x, F.lit("")))) / F.length(c)


def binned(c: Column, cuts: tuple[float, ...]) -> Column:
    return reduce(lambda a, b: a + b, [(c >= F.lit(x)).cast("int") for x in cuts])


def features(df: DataFrame) -> DataFrame:
    """Small integers f0... from __url, host, path and suffix."""
    u = F.coalesce(F.col("__url"), F.lit(""))
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    digits = F.length(F.regexp_replace(u, "[^0-9]", ""))
    columns = {
        "f0": binned(F.length(u), (20, 26, 32, 38, 44, 52, 64, 80, 120)),
        "f1": F.least(F.length(F.regexp_replace("path", "[^/]", "")), F.lit(8)),
        "f2": F.least(F.length(F.regexp_replace("host", r"[^.]", "")), F.lit(6)),
        "f3": binned(digits / F.greatest(F.length(u), F.lit(1)), (0.01, 0.04, 0.07, 0.1, 0.15, 0.25)),
        "f4": binned(entropy(F.col("host")), (2.0, 2.4, 2.7, 3.0, 3.2, 3.4, 3.6, 4.0)),
        "f5": F.when(query == "", 0).otherwise(F.least(F.size(F.split(query, "&")), F.lit(6))),
        "f6": u.contains("#").cast("int"),
        "f7": u.startswith("https://").cast("int"),
        "f8": binned(F.length("path"), (1, 2, 5, 8, 12, 20, 40)),
        "f9": F.col("path").rlike(r"\.[A-Za-z0-9]{1,5}$").cast("int"),
        "f10": F.length(F.regexp_replace("host", "[^-0-9]", "")).cast("int"),
        "f11": F.least(F.length("suffix"), F.lit(8)),
    }
    return df.withColumns({k: F.coalesce(v.cast("int"), F.lit(0)) for k, v in columns.items()})


NAMES = tuple(f"f{i}" for i in range(13))


def boosted(vectors: list[tuple[tuple[int, ...], float, float]], rounds: int = 24, rate: float = 0.3, least: float = 5.0) -> tuple[float, list]:
    """Newton boosting of depth-two trees on (bins, blocked, allowed) counts: the base score and the trees.

    A tree is (feature, cut, left, right), where a side is the same again or a number; bins up to
    the cut go left.  Ties between splits go to the first feature and the lowest cut.
    """
    pos, neg = sum(v[1] for v in vectors), sum(v[2] for v in vectors)
    base = math.log((pos + 1) / (neg + 1))
    score = [base] * len(vectors)
    if not pos or not neg:
        return base, []

    def leaf(g: float, h: float) -> float:
        return rate * g / (h + 1.0)

    def best(rows: list[int], grad: list[float], hess: list[float]):
        g, h = sum(grad[i] for i in rows), sum(hess[i] for i in rows)
        found = (1e-6, None)
        for f in range(len(vectors[0][0])):
            sums: dict[int, list[float]] = {}
            for i in rows:
                s = sums.setdefault(vectors[i][0][f], [0.0, 0.0])
                s[0] += grad[i]
                s[1] += hess[i]
            gl = hl = 0.0
            for cut in sorted(sums)[:-1]:
                gl, hl = gl + sums[cut][0], hl + sums[cut][1]
                if min(hl, h - hl) * 4 >= least:
                    gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                    if gain > found[0] + 1e-9:
                        found = (gain, (f, cut))
        return found[1], g, h

    def grow(rows: list[int], grad: list[float], hess: list[float], depth: int):
        split, g, h = best(rows, grad, hess) if depth else (None, sum(grad[i] for i in rows), sum(hess[i] for i in rows))
        if not split:
            return leaf(g, h)
        f, cut = split
        sides = [i for i in rows if vectors[i][0][f] <= cut], [i for i in rows if vectors[i][0][f] > cut]
        return (f, cut, *(grow(s, grad, hess, depth - 1) for s in sides))

    trees = []
    for _ in range(rounds):
        p = [1 / (1 + math.exp(-s)) for s in score]
        grad = [v[1] * (1 - q) - v[2] * q for v, q in zip(vectors, p, strict=True)]
        hess = [(v[1] + v[2]) * q * (1 - q) for v, q in zip(vectors, p, strict=True)]
        tree = grow(list(range(len(vectors))), grad, hess, 2)
        trees.append(tree)
        score = [s + value(tree, v[0]) for s, v in zip(score, vectors, strict=True)]
    return base, trees


def value(tree, bins: tuple[int, ...]) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if bins[tree[0]] <= tree[1] else tree[3]
    return tree


def _column(tree) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    return F.when(F.col(NAMES[tree[0]]) <= tree[1], _column(tree[2])).otherwise(_column(tree[3]))


@dataclass(frozen=True)
class Model:
    shares: tuple[tuple[str, int], ...]  # suffixes above the lowest bin, and their bins
    base: float
    trees: tuple

    def score(self, bins: tuple[int, ...]) -> float:
        return 1 / (1 + math.exp(-(self.base + sum(value(t, bins) for t in self.trees))))


def prepared(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, rule_verdict, suffix and all features but the last."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("__url"))
    host, path = split_url(F.col("__url"))
    ruled = with_rule(rows.withColumn("host", host).withColumn("path", path), rules)
    ruled = ruled.withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit(""))})
    return features(ruled.withColumn("suffix", F.regexp_extract("host", r"[^.]*$", 0)))


def common_suffixes(rows: DataFrame) -> tuple[tuple[str, int], ...]:
    """The suffixes with a share of SHARES[0] or more (so 1 / SHARES[0] at most) and their bins."""
    counts = rows.groupBy("suffix").agg(F.count(F.lit(1)).alias("n"))
    total = rows.count()
    found = counts.filter(F.col("n") >= F.lit(SHARES[0]) * total).collect()
    return tuple(sorted((r["suffix"], sum(r["n"] >= cut * total for cut in SHARES)) for r in found))


def with_shares(rows: DataFrame, shares: tuple[tuple[str, int], ...]) -> DataFrame:
    bin_ = reduce(lambda other, x: F.when(F.col("suffix") == x[0], F.lit(x[1])).otherwise(other), shares, F.lit(0))
    return rows.withColumn(NAMES[-1], bin_.cast("int"))


def train(rows: DataFrame, labelled: Column, blocked: Column, rounds: int = 24) -> Model:
    """A model from those prepared rows for which labelled holds; blocked is their label."""
    shares = common_suffixes(rows)
    known = with_shares(rows.filter(labelled), shares).groupBy(*NAMES).agg(F.sum(blocked.cast("long")).alias("b"), F.count(F.lit(1)).alias("n"))
    kept = known.orderBy(F.desc("n"), *NAMES).limit(TRAIN_VECTORS).collect()
    base, trees = boosted([(tuple(r[x] for x in NAMES), float(r["b"]), float(r["n"] - r["b"])) for r in kept], rounds)
    return Model(shares, base, tuple(trees))


def scored(rows: DataFrame, model: Model) -> DataFrame:
    z = reduce(lambda a, b: a + b, [_column(t) for t in model.trees], F.lit(float(model.base)))
    return with_shares(rows, model.shares).withColumn("score", 1 / (1 + F.exp(-z)))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[Rule, ...] = RULES, rounds: int = 24) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, score, verdict."""
    rows = prepared(pages, id_col, url_col, rules)
    out = scored(rows, train(rows, F.col("rule").isNotNull(), F.col("rule_verdict") == "block", rounds))
    return out.select("page_id", "host", "path", "rule", "score", F.coalesce("rule_verdict", F.when(F.col("score") >= THRESHOLD, "block").otherwise("allow")).alias("verdict"))


def held_out_accuracy(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[Rule, ...] = RULES, rounds: int = 24, folds: int = 4) -> tuple[int, int, int]:
    """Of rule-labelled urls whose whole hosts (one in folds, by a hash) were left out of training: how many, how many the trees get right, how many the more common label."""
    rows = prepared(pages, id_col, url_col, rules)
    ruled, blocked, out = F.col("rule").isNotNull(), F.col("rule_verdict") == "block", F.pmod(F.xxhash64("host"), F.lit(folds)) == 0
    tested = scored(rows, train(rows, ruled & ~out, blocked, rounds)).filter(ruled & out)
    right = ((F.col("score") >= THRESHOLD) == blocked).cast("long")
    n, got, b = tested.agg(F.count(F.lit(1)), F.coalesce(F.sum(right), F.lit(0)), F.coalesce(F.sum(blocked.cast("long")), F.lit(0))).first()
    return n, got, max(b, n - b)
