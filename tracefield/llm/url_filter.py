"""URL filters: host and path rules, and gradient-boosted trees for all other URLs.

Everything is DataFrame expressions. The trees are grown level by level from
histograms of gradients (sums by node, feature and bin), which Spark
aggregates; only these sums, of a size fixed by the parameters, come to the
driver. A fitted model is one Column expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import discard, save

#: Labelled URLs that the fit takes at most, about (those with the least hash).
SAMPLE = 200_000
TREES, DEPTH, BINS = 10, 3, 16
SHRINK, RIDGE, LEAST = 0.3, 1.0, 5.0

# Rules as (verdict, host and path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Buckets of the hashed suffixes' statistics, and rows that a statistic is drawn to the mean by.
SUFFIXES, DRAWN = 1024, 20
#: Labels of a host that make a suffix.
SUFFIX_LABELS = (1, 2)
# Words that stand in the host names of advertising, gambling, adult and spam sites, and keys of queries by which
# one page has many addresses (lists, orders, sessions, referrers). They label URLs to learn from.
SEED_KEYS = ("page", "p", "start", "offset", "sort", "order", "sid", "sessionid", "phpsessid", "jsessionid", "ref", "referrer", "replytocom", "print")
SEED_WORDS = ("ad", "ads", "adult", "bet", "bets", "casino", "cheap", "click", "loan", "loans", "pills", "poker", "porn", "sex", "spam", "track", "viagra", "win", "xxx")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls. A rule's host fits itself and its subdomains; its path is a prefix."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the last that fits wins
        name, slash, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def features(url: Column) -> dict[str, Column]:
    """Lexical features of a URL; a null one has those of the empty string."""
    u = F.coalesce(url, F.lit(""))
    host, path = host_of(u), path_of(u)
    count = lambda c, what: F.length(F.regexp_replace(c, f"[^{what}]", ""))
    chars = F.filter(F.split(host, ""), lambda c: c != "")
    n = F.greatest(F.size(chars), F.lit(1)).cast("double")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    entropy = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    values = {
        "length": F.length(u),
        "host_length": F.length(host),
        "path_length": F.length(path),
        "depth": F.size(F.filter(F.split(path, "/"), lambda x: x != "")),
        "labels": F.size(F.filter(F.split(host, r"\."), lambda x: x != "")),
        "hyphens": count(host, r"\-"),
        "host_digits": count(host, "0-9"),
        "digit_ratio": count(u, "0-9") / F.greatest(F.length(u), F.lit(1)),
        "entropy": F.round(entropy, 9),
        "parameters": F.when(query == "", F.lit(0)).otherwise(count(query, "&") + 1),
        "longest_label": F.coalesce(F.array_max(F.transform(F.split(host, r"\."), F.length)), F.lit(0)),
    }
    return {k: v.cast("double") for k, v in values.items()}


def suffix_of(host: Column, labels: int) -> Column:
    """The last labels of a host, or all that it has."""
    return F.array_join(F.slice(F.split(host, r"\."), -F.least(F.lit(labels), F.size(F.split(host, r"\."))), labels), ".")


def _suffix_bucket(url: Column, labels: int) -> Column:
    """A hash of the suffix: every suffix has a statistic, rare ones may share theirs."""
    return F.pmod(F.xxhash64(suffix_of(host_of(F.coalesce(url, F.lit(""))), labels)), F.lit(SUFFIXES)).cast("int")


def seed_label(url: Column) -> Column:
    """1 for a host with a seed word among its labels' parts, or a query with a seed key; else 0."""
    u = F.coalesce(url, F.lit(""))
    keys = F.transform(F.split(F.regexp_extract(u, r"\?([^#]*)", 1), "&"), lambda x: F.lower(F.substring_index(x, "=", 1)))
    among = lambda found, seeds: F.arrays_overlap(found, F.array(*(F.lit(w) for w in seeds)))
    return (among(F.split(host_of(u), r"[.\-]"), SEED_WORDS) | among(keys, SEED_KEYS)).cast("int")


@dataclass
class Tree:
    """Splits by node (root 1, children 2n and 2n + 1): (feature, cut); what is not split has a value."""

    splits: dict[int, tuple[str, float]] = field(default_factory=dict)
    values: dict[int, float] = field(default_factory=dict)

    def node(self, x: dict[str, Column], at: int = 1) -> Column:
        if at not in self.splits:
            return F.lit(at)
        name, cut = self.splits[at]
        return F.when(x[name] <= cut, self.node(x, 2 * at)).otherwise(self.node(x, 2 * at + 1))

    def value(self, x: dict[str, Column], at: int = 1) -> Column:
        if at not in self.splits:
            return F.lit(self.values.get(at, 0.0))
        name, cut = self.splits[at]
        return F.when(x[name] <= cut, self.value(x, 2 * at)).otherwise(self.value(x, 2 * at + 1))


@dataclass
class Model:
    prior: float
    suffixes: dict[int, list[float]]  # by number of labels: log-odds by bucket
    trees: list[Tree] = field(default_factory=list)

    def columns(self, url: Column) -> dict[str, Column]:
        x = features(url)
        for n, values in self.suffixes.items():
            x[f"suffix_{n}"] = F.element_at(F.lit(values), _suffix_bucket(url, n) + 1)
        return x

    def margin(self, x: dict[str, Column]) -> Column:
        out = F.lit(self.prior)
        for t in self.trees:
            out = out + t.value(x)
        return out

    def used(self) -> set[str]:
        """Features that some tree splits by."""
        return {name for t in self.trees for name, _ in t.splits.values()}


def _suffix_statistics(rows: DataFrame, rate: float) -> dict[int, list[float]]:
    """Log-odds of each bucket of suffixes over those of all rows, drawn to 0 where there are few rows."""
    out = {}
    for n in SUFFIX_LABELS:
        values = [0.0] * SUFFIXES
        for r in rows.groupBy(_suffix_bucket(F.col("url"), n).alias("b")).agg(F.count("*").alias("n"), F.sum("label").alias("k")).collect():  # SUFFIXES rows at most
            p = (r["k"] + DRAWN * rate) / (r["n"] + DRAWN)
            values[r["b"]] = round(math.log(p / (1 - p)) - math.log(rate / (1 - rate)), 6)
        out[n] = values
    return out


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """Boosted trees for ``labelled`` (url, label 0/1). Rows without a label are left out; without rows, or with one label only, the model is its prior."""
    rows = labelled.filter(F.col("label").isNotNull()).select(F.coalesce("url", F.lit("")).alias("url"), F.col("label").cast("int").alias("label"))
    n = rows.count()
    if n > sample:
        rows = rows.filter(F.pmod(F.xxhash64("url"), F.lit(1 << 20)) < (sample / n) * (1 << 20))
    rows = save(rows, "labelled")
    k = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("k")).first()
    rate = (k["k"] + 0.5) / (k["n"] + 1)
    prior = math.log(rate / (1 - rate))
    if not 0 < k["k"] < k["n"]:
        return Model(prior, {})
    model = Model(prior, _suffix_statistics(rows, rate))
    x = model.columns(F.col("url"))
    names = list(x)
    features_ = save(rows.select("label", *(x[c].alias(c) for c in names)), "features")
    steps = [i / BINS for i in range(1, BINS)]
    found = features_.agg(*(F.percentile_approx(c, steps, 1000).alias(c) for c in names), *(F.min(c).alias(f"min_{c}") for c in names)).first()
    cuts = {c: sorted({found[f"min_{c}"], *found[c]}) for c in names}
    bins = {c: sum(((F.col(c) > v).cast("int") for v in cuts[c]), F.lit(0)) for c in names}
    # Only the distinct rows of bins matter, with their numbers of both labels and the margin so far.
    table = features_.select("label", *(bins[c].cast("tinyint").alias(c) for c in names)).groupBy(*names).agg(F.count("*").alias("n"), F.sum("label").alias("ones"))
    table = save(table.withColumn("margin", F.lit(prior)), "bins")
    discard(rows, features_)
    for _ in range(TREES):
        tree = _grow(table, names)
        at = {c: F.col(c).cast("double") for c in names}
        raised = save(table.withColumn("margin", F.col("margin") + tree.value(at)), "bins")
        discard(table)
        table = raised
        # From bins back to the features' own values.
        model.trees.append(Tree({k: (c, cuts[c][int(b)]) for k, (c, b) in tree.splits.items()}, tree.values))
    discard(table)
    return model


def _grow(table: DataFrame, names: list[str]) -> Tree:
    """One tree over rows of bins (n, ones, margin), a level with each job: a split's sums are those of the nodes below it, too."""
    tree, p = Tree(), 1 / (1 + F.exp(-F.col("margin")))
    rows = table.withColumn("g", F.col("n") * p - F.col("ones")).withColumn("h", F.col("n") * p * (1 - p))
    x = {c: F.col(c).cast("double") for c in names}
    flat = F.explode(F.array(*(F.struct(F.lit(i).alias("f"), F.col(c).cast("int").alias("bin")) for i, c in enumerate(names))))
    for depth in range(DEPTH):
        level = rows.withColumn("node", tree.node(x)).filter(F.col("node") >= 1 << depth).select("node", "g", "h", flat.alias("x"))
        sums: dict[int, dict[int, dict[int, tuple[float, float]]]] = {}
        for r in level.groupBy("node", "x.f", "x.bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():  # nodes * features * bins at most
            sums.setdefault(r["node"], {}).setdefault(r["f"], {})[r["bin"]] = (r["g"], r["h"])
        for node, by in sorted(sums.items()):
            g, h = (sum(v[i] for v in by[0].values()) for i in (0, 1))
            tree.values[node] = _leaf(g, h)
            if best := _best_split(by, g, h):
                f, cut, left_g, left_h = best
                tree.splits[node] = (names[f], cut)
                tree.values[2 * node], tree.values[2 * node + 1] = _leaf(left_g, left_h), _leaf(g - left_g, h - left_h)
        if not any(node >> depth for node in tree.splits):
            break
    return tree


def _leaf(g: float, h: float) -> float:
    return round(-SHRINK * g / (h + RIDGE), 9)


def _best_split(by: dict[int, dict[int, tuple[float, float]]], g: float, h: float) -> tuple[int, float, float, float] | None:
    """The feature, the last bin to the left of the split with the greatest gain, and the sums there; ties go to the first."""
    best, most = None, 1e-6
    for f, bins in sorted(by.items()):
        left_g = left_h = 0.0
        for b in sorted(bins)[:-1]:
            left_g, left_h = left_g + bins[b][0], left_h + bins[b][1]
            right_g, right_h = g - left_g, h - left_h
            if min(left_h, right_h) * 4 < 1e-3:
                continue
            gain = round(left_g**2 / (left_h + RIDGE) + right_g**2 / (right_h + RIDGE) - g**2 / (h + RIDGE), 6)
            if gain > most:
                best, most = (f, float(b), left_g, left_h), gain
    return best


def judge(pages: DataFrame, model: Model, rules=RULES, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule and verdict of every row, and the model's probability that the URL is to be blocked.

    A null URL, or one without ``://``, has an empty host and path, no rule and
    the model's verdict on what there is. Repeated rows each get their row.
    """
    url = F.col("url")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    x = model.columns(url)
    named = pages.select("page_id", url, host_of(url).alias("host"), path_of(url).alias("path"), *(v.alias(f"x_{k}") for k, v in x.items()))
    score = 1 / (1 + F.exp(-model.margin({k: F.col(f"x_{k}") for k in x})))
    own = F.when(score >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return named.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), score.alias("score"))


def filter_urls(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES) -> DataFrame:
    """Fit on ``labelled`` (by default the pages' own URLs, labelled by the seed words of hosts and keys of queries) and judge all pages."""
    if labelled is None:
        labelled = pages.select("url", seed_label(F.col("url")).alias("label"))
    return judge(pages, fit(labelled), rules)
