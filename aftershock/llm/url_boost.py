"""URL verdicts: rules, and gradient-boosted trees over lexical features for the rest."""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aftershock.llm.shared import copies, salt, stored

SALTS = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
# Bins per feature; histograms have trees' nodes x features x bins rows at most.
BINS = 32
FEATURES = ("length", "depth", "digits", "entropy", "params", "suffix_rate", "suffix_size", "top_rate", "top_size")
SUFFIXES = (("suffix", 2), ("top", 1))
# Parts by the hash of the host: a labelled URL learns from the suffix statistics of the other parts.
FOLDS = 5
# Labelled URLs that weigh as much as the overall share in a suffix's rate.
SMOOTHING = 20.0
# Gradients are added up as integers, so that a sum does not depend on the order of its rows.
SCALE = float(2**20)


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self) -> Column:
        host = (F.col("host") == self.host) | F.col("host").endswith(f".{self.host}")
        return host & F.col("path").startswith(self.path)


@dataclass(frozen=True)
class Split:
    feature: str
    below: int


@dataclass(frozen=True)
class Trees:
    """Each tree maps a node to its split (nodes 1, 2-3, 4-7 …) and its leaves to their values."""

    bias: float
    splits: tuple[dict[int, Split], ...]
    leaves: tuple[dict[int, float], ...]

    def margin(self) -> Column:
        total = F.lit(self.bias)
        for splits, leaves in zip(self.splits, self.leaves, strict=True):
            total = total + _value(splits, leaves, 1)
        return total


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for NULL or a text without ``://``."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), F.regexp_extract(url, PARTS, 2)


def rule_columns(rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest fitting rule, NULL where none fits."""
    name = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        name = F.when(rule.fits(), rule.name).otherwise(name)
        verdict = F.when(rule.fits(), rule.verdict).otherwise(verdict)
    return name, verdict


def _bin(value: Column) -> Column:
    return F.least(F.greatest(F.floor(value), F.lit(0)), F.lit(BINS - 1)).cast("int")


def _entropy(text: Column) -> Column:
    """Bits per character, from the runs of the sorted characters."""
    start = F.struct(F.lit("").alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))

    def weight(run: Column) -> Column:
        return F.when(run > 0, run * F.log2(run)).otherwise(0.0)

    def step(state: Column, char: Column) -> Column:
        same = state["last"] == char
        return F.struct(
            char.alias("last"),
            F.when(same, state["run"] + 1.0).otherwise(1.0).alias("run"),
            F.when(same, state["sum"]).otherwise(state["sum"] + weight(state["run"])).alias("sum"),
        )

    inside = F.aggregate(F.array_sort(F.filter(F.split(text, ""), lambda c: c != "")), start, step, lambda s: s["sum"] + weight(s["run"]))
    return F.when(F.length(text) > 0, F.log2(F.length(text)) - inside / F.length(text)).otherwise(0.0)


def lexical(urls: DataFrame, url: str) -> DataFrame:
    """Adds host, path, the binned lexical features and the host's last one and two labels."""
    text = F.coalesce(F.col(url).cast("string"), F.lit(""))
    host, path = url_parts(F.col(url))
    size = F.length(text)
    query = F.regexp_extract(text, r"(?s)\?([^#]*)", 1)
    parameters = F.when(query == "", 0).otherwise(1 + F.length(query) - F.length(F.replace(query, F.lit("&"), F.lit(""))))
    frame = urls.withColumns({"host": host, "path": path})
    steps = F.length("path") - F.length(F.replace(F.col("path"), F.lit("/"), F.lit("")))
    return frame.withColumns(
        {
            "length": _bin(size / 8),
            "depth": _bin(steps),
            "digits": _bin(F.length(F.regexp_replace(text, "[^0-9]", "")) / F.greatest(size, F.lit(1)) * BINS),
            "entropy": _bin(_entropy(text) * 5),
            "params": _bin(parameters),
            **{name: F.substring_index("host", ".", -labels) for name, labels in SUFFIXES},
        }
    )


@dataclass(frozen=True)
class SuffixStatistics:
    """Blocked and all labelled URLs by the last labels of their hosts."""

    tables: dict[str, DataFrame]
    of_others: dict[str, DataFrame]
    share: float

    def add(self, urls: DataFrame, others_only: bool = False) -> DataFrame:
        """Adds share of blocked and number of the labelled URLs under the same last labels, binned.

        A suffix without labelled URLs has the overall share. With ``others_only`` the labels of hosts in
        the URL's own ``fold`` do not count, so that the share does not tell its label. Suffixes
        are joined by ``salt`` as well, so that the URLs of a common one spread.
        """
        fold = ["fold"] if others_only else []
        for name, table in (self.of_others if others_only else self.tables).items():
            urls = urls.join(copies(table, SALTS), [name, *fold, "salt"], "left")
            seen = F.coalesce("seen", F.lit(0))
            rate = (F.coalesce("blocked", F.lit(0)) + SMOOTHING * self.share) / (seen + SMOOTHING)
            urls = urls.withColumns({f"{name}_rate": _bin(rate * BINS), f"{name}_size": _bin(F.log2(seen + 1))})
            urls = urls.drop("blocked", "seen")
        return urls


def suffix_statistics(labelled: DataFrame) -> SuffixStatistics:
    """From rows (suffix, top, fold, n, ones)."""
    n, ones = labelled.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("ones"), F.lit(0))).first()
    sums = (F.sum("ones").alias("blocked"), F.sum("n").alias("seen"))
    tables = {name: stored(labelled.groupBy(name).agg(*sums)) for name, _ in SUFFIXES}
    of_others = {}
    for name, _ in SUFFIXES:
        by_fold = labelled.groupBy(name, "fold").agg(*sums)
        # At most ``FOLDS`` rows for any suffix.
        whole = Window.partitionBy(name)
        of_others[name] = stored(
            by_fold.select(name, "fold", *[(F.sum(c).over(whole) - F.col(c)).alias(c) for c in ("blocked", "seen")])
        )
    return SuffixStatistics(tables, of_others, ones / n if n else 0.5)


def _value(splits: dict[int, Split], leaves: dict[int, float], node: int) -> Column:
    if node not in splits:
        return F.lit(leaves.get(node, 0.0))
    split = splits[node]
    left, right = _value(splits, leaves, 2 * node), _value(splits, leaves, 2 * node + 1)
    return F.when(F.col(split.feature) < split.below, left).otherwise(right)


def _node(splits: dict[int, Split], node: int = 1) -> Column:
    if node not in splits:
        return F.lit(node)
    split = splits[node]
    return F.when(F.col(split.feature) < split.below, _node(splits, 2 * node)).otherwise(_node(splits, 2 * node + 1))


def train(labelled: DataFrame, rounds: int, depth: int, rate: float, ridge: float = 1.0) -> Trees:
    """Boosted trees over the binned features, by Newton steps on log loss.

    ``labelled`` counts all labelled URLs: n, and ones with label 1. They are reduced once to
    rows per combination of bins, and each level of a tree is one aggregation to histograms. Only histograms, of at most nodes x
    features x bins rows, come to the driver, which picks the splits. Sums are of integers
    and ties go to the first feature and bin, so a run can be repeated.
    """
    table = stored(labelled.groupBy(*FEATURES).agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")))
    n, ones = table.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("ones"), F.lit(0))).first()
    trees = Trees(log((ones + 1.0) / (n - ones + 1.0)), (), ())
    for _ in range(rounds if 0 < ones < n else 0):
        splits: dict[int, Split] = {}
        leaves: dict[int, float] = {}
        chance = 1 / (1 + F.exp(-trees.margin()))
        graded = table.withColumns(
            {
                "g": F.round((F.col("ones") - chance * F.col("n")) * SCALE).cast("long"),
                "h": F.round(chance * (1 - chance) * F.col("n") * SCALE).cast("long"),
            }
        )
        for level in range(depth + 1):
            found = _histograms(graded, splits, level)
            for node, (g, h, best) in sorted(found.items()):
                leaves[node] = rate * g / (h + ridge)
                if level < depth and best is not None:
                    splits[node] = best
                    leaves.pop(node)
            if not any(node >= 2**level for node in splits):
                break
        if not splits:
            break
        trees = Trees(trees.bias, (*trees.splits, splits), (*trees.leaves, leaves))
    return trees


def _histograms(graded: DataFrame, splits: dict[int, Split], level: int) -> dict[int, tuple]:
    """Gradient sums and the best split of each node of a level."""
    bins = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(c).alias("bin")) for i, c in enumerate(FEATURES)]))
    rows = graded.select(_node(splits).alias("node"), "g", "h", bins.alias("at")).filter(F.col("node") >= 2**level)
    sums = rows.groupBy("node", "at.f", "at.bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    nodes: dict[int, dict[int, list]] = {}
    for row in sorted(sums.collect()):
        nodes.setdefault(row.node, {}).setdefault(row.f, []).append((row.bin, row.g / SCALE, row.h / SCALE))
    return {node: _best(by_feature) for node, by_feature in nodes.items()}


def _best(by_feature: dict[int, list], ridge: float = 1.0, least: float = 1e-3) -> tuple:
    bins = next(iter(by_feature.values()))
    g, h = sum(x[1] for x in bins), sum(x[2] for x in bins)
    best, gain = None, least
    for feature, bins in sorted(by_feature.items()):
        left_g = left_h = 0.0
        for (_, bin_g, bin_h), (above, _, _) in zip(bins, bins[1:], strict=False):
            left_g, left_h = left_g + bin_g, left_h + bin_h
            right_g, right_h = g - left_g, h - left_h
            won = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - g**2 / (h + ridge)
            if won > gain + 1e-9:
                best, gain = Split(FEATURES[feature], above), won
    return g, h, best


def judge_urls(
    pages: DataFrame,
    rules: list[Rule],
    url: str = "url",
    rounds: int = 12,
    depth: int = 3,
    rate: float = 0.4,
) -> DataFrame:
    """Adds host, path, rule, verdict (``block`` or ``allow``) and score (the trees' chance of block).

    A rule fits its host and all subdomains if the path starts with the rule's; the longest
    wins. The URLs that rules decide are the labels on which the trees are trained, with suffix
    statistics from the other folds of hosts; URLs without a rule get the trees' verdict, ``block`` from a chance of 0.5. Without labels of
    both kinds the share of blocked labels decides.

    NULL, empty or malformed URLs have empty host and path and are judged like others. Equal
    URLs get equal verdicts; an empty table gives an empty one. The five added columns replace
    input columns of the same names; rows travel in a struct, so no other name can clash.
    """
    added = ("host", "path", "rule", "verdict", "score")
    kept = [c for c in pages.columns if c not in added]
    urls = pages.select(F.struct(*[F.col(c) for c in kept]).alias("row"), F.col(url).alias("url"))
    urls = lexical(urls, "url").withColumn("salt", salt(F.col("row"), SALTS))
    name, verdict = rule_columns(rules)
    fold = F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int")
    urls = urls.withColumns({"rule": name, "verdict": verdict, "fold": fold})

    bins = [c for c in FEATURES if not c.startswith(tuple(name for name, _ in SUFFIXES))]
    labelled = urls.filter("rule IS NOT NULL").groupBy(*[name for name, _ in SUFFIXES], "fold", *bins)
    labelled = stored(
        labelled.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("verdict") == "block", 1)).alias("ones"))
    )
    statistics = suffix_statistics(labelled)
    examples = labelled.withColumn("salt", salt(F.struct(*bins), SALTS))
    trees = train(statistics.add(examples, others_only=True), rounds=rounds, depth=depth, rate=rate)

    judged = statistics.add(urls).withColumn("score", 1 / (1 + F.exp(-trees.margin())))
    decided = F.coalesce("verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    columns = [F.col(f"row.{c}").alias(c) for c in kept]
    return judged.select(*columns, "host", "path", "rule", decided.alias("verdict"), "score")
