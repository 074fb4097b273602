"""URL filters: host and path rules first, then gradient-boosted trees on lexical features.

Training, too, is DataFrame work: each level of a tree is one grouped sum of gradients over binned
features (bounded by nodes x features x bins), and the trees become one constant table that a short expression walks, so that
scoring is a projection over the URL column alone, whatever the number of trees.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bins of a feature, trees, levels of a tree, step size, penalty on leaf weights.
BINS, TREES, LEVELS, RATE, PENALTY = 16, 8, 3, 0.6, 1.0
#: Suffixes with statistics of their own: the most frequent ones of the labelled URLs.
SUFFIXES = 100
#: Rules that are folded into one expression.
MAX_RULES = 1_000
SAMPLE_ROWS = 6_000
FEATURES = ("url_length", "host_length", "labels", "depth", "digit_ratio", "host_digit_ratio", "hyphens", "entropy", "parameters", "longest_label", "suffix_rate")


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): the host from the first :// to /, ?, # or the end, A-Z lower-cased; the path from
    there to ?, # or the end. Both empty if url is null or has no ://."""
    url, pattern = F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER), F.regexp_extract(url, pattern, 2)


@dataclass(frozen=True)
class Rule:
    """Fits its host and the host's subdomains, where the path starts with the rule's."""

    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @classmethod
    def of(cls, action: str, text: str) -> Rule:
        host, slash, path = text.partition("/")
        return cls(action, host.translate(str.maketrans(UPPER, LOWER)), slash + path)


def matched(rules: Sequence[Rule], host: Column, path: Column, value: str) -> Column:
    """The named attribute of the longest rule that fits (of equally long ones, the first by name)."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    found: Column | None = None
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.lit(getattr(r, value))) if found is None else found.when(fits, F.lit(getattr(r, value)))
    return F.lit(None).cast("string") if found is None else found


def lexical(url: Column, suffix_rates: dict[str, float] | None = None, base_rate: float = 0.5) -> dict[str, Column]:
    """The features by name; suffix_rate is the smoothed share of blocked URLs with the host's last label."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    host, path = url_parts(url)
    digits = lambda c: F.length(F.regexp_replace(c, "[^0-9]", ""))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    chars = F.split(host, "")
    entropy = F.when(F.length(host) > 0, -F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda s, c: s + F.transform(F.array(F.size(F.filter(chars, lambda x: x == c)) / F.size(chars)), lambda p: p * F.log2(p))[0])).otherwise(0.0)
    rate: Column = F.lit(float(base_rate))
    if suffix_rates:
        known = F.create_map(*[F.lit(x) for name, value in sorted(suffix_rates.items()) for x in (name, float(value))])  # one constant, whatever its size
        rate = F.coalesce(F.try_element_at(known, F.regexp_extract(host, r"([^.]*)$", 1)), rate)
    return {
        "url_length": F.length(url).cast("double"), "host_length": F.length(host).cast("double"), "labels": F.size(F.split(host, r"\.")).cast("double"),
        "depth": (F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))).cast("double"), "digit_ratio": share(digits(url), F.length(url)), "host_digit_ratio": share(digits(host), F.length(host)),
        "hyphens": (F.length(host) - F.length(F.replace(host, F.lit("-"), F.lit("")))).cast("double"), "entropy": entropy,
        "parameters": F.regexp_count(url, F.lit(r"[?&][^=&#]*=")).cast("double"), "longest_label": F.array_max(F.transform(F.split(host, r"\."), lambda x: F.length(x))).cast("double"), "suffix_rate": rate,
    }


class BoostedTrees:
    """trees: nested (feature, bound, left, right) or leaf weights; a value up to the bound goes left."""

    def __init__(self, base: float, trees: list, suffix_rates: dict[str, float], base_rate: float):
        self.base, self.trees, self.suffix_rates, self.base_rate = base, trees, suffix_rates, base_rate

    @staticmethod
    def _table(tree: object) -> tuple[list[int], list[float], list[float]]:
        """A tree as a complete one of LEVELS levels: features and bounds by place (the children of i are 2 i + 1 and 2 i + 2), and leaf weights;
        where a branch is shorter, nothing is above the bound."""
        features, bounds, weights, row = [], [], [], [tree]
        for _ in range(LEVELS):
            below = []
            for node in row:
                name, bound, left, right = node if isinstance(node, tuple) else (FEATURES[0], math.inf, node, node)
                features.append(FEATURES.index(name))
                bounds.append(float(bound))
                below += [left, right]
            row = below
        weights = [float(w) for w in row]
        return features, bounds, weights

    def margin(self, values: dict[str, Column]) -> Column:
        """The sum over all trees: one short expression over a constant table, whatever their number."""
        if not self.trees:
            return F.lit(float(self.base))
        numbers = lambda xs: F.array(*map(F.lit, xs))
        table = F.array(*[F.struct(numbers(f).alias("f"), numbers(b).alias("b"), numbers(w).alias("w")) for f, b, w in map(self._table, self.trees)])
        x = F.array(*[values[k] for k in FEATURES])

        def weight(tree: Column) -> Column:
            place = F.lit(0)
            for _ in range(LEVELS):
                above = F.get(x, F.get(tree["f"], place)) > F.get(tree["b"], place)
                place = place * 2 + 1 + above.cast("int")
            return F.get(tree["w"], place - (2**LEVELS - 1))

        return F.lit(float(self.base)) + F.aggregate(F.transform(table, weight), F.lit(0.0), lambda s, w: s + w)


def labelled_sample(spark: SparkSession, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(url, blocked): a seeded sample for where the caller has no labelled URLs of their own. Ordinary hosts are one or
    two pronounceable words, seldom with a hyphen, their paths a few words; blocked ones show what lexical filters look for in any
    language: random or numbered host labels, words joined by hyphens, chains of sub-domains, bare addresses, deep paths of
    tokens, many parameters. No word of it is a real one, so that only forms are learnt."""
    keys = lambda n: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i)
    draw = lambda i, salt, n: F.pmod(F.xxhash64("id", F.lit(salt), i), F.lit(n)).cast("int")
    of = lambda text, i: F.element_at(F.split(F.lit(text), " "), i + 1)

    def sound(i: Column, salt: str) -> Column:
        return F.concat(F.substring(F.lit("bcdfghjklmnprstvwz"), draw(i, f"{salt}c", 18) + 1, F.lit(1)), F.substring(F.lit("aeiou"), draw(i, f"{salt}v", 5) + 1, F.lit(1)))

    def word(i: Column) -> Column:
        return F.concat(sound(i, "1"), sound(i, "2"), F.when(draw(i, "third", 2) == 0, sound(i, "3")).otherwise(""), F.when(draw(i, "end", 2) == 0, of("n r s l m", draw(i, "last", 5))).otherwise(""))

    def token(i: Column) -> Column:
        return F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat_ws(":", i, "id").cast("binary"), 256))), "[^A-Za-z0-9]", "")

    # words, tokens and numbers are made once for each row, by short expressions over lists
    parts = spark.range(0, rows, 1, 4).select("id", F.transform(keys(32), word).alias("w"), F.transform(keys(16), token).alias("t"), F.transform(keys(64), lambda i: F.xxhash64("id", F.lit("n"), i)).alias("n"))
    used = iter(range(64))

    def pick(n: int) -> Column:
        return F.pmod(F.get("n", F.lit(next(used))), F.lit(n)).cast("int")

    w, maybe = lambda i: F.get("w", F.lit(i)), lambda n, value: F.when(pick(n) == 0, value).otherwise("")
    short = lambda i, least, more: F.substring(F.get("t", F.lit(i)), F.lit(1), least + pick(more))
    good_host = F.concat(maybe(2, F.concat(of("www www www docs wiki shop static portal help m", pick(9)), F.lit("."))), w(0), maybe(3, F.concat(maybe(12, F.lit("-")), w(1))), F.lit("."), of("com com org net edu io de fr es it", pick(10)))
    number = F.substring((100_000 + pick(100_000)).cast("string"), F.lit(2), 1 + pick(5))  # of an article, a page, a product
    steps = F.slice(F.array(F.when(pick(3) == 0, F.substring(w(2), 1, 2)).otherwise(w(2)), F.when(pick(2) == 0, number).otherwise(w(3)), F.concat(w(4), F.lit("-"), w(5)), of("2019 2020 2021 2022", pick(4))), F.lit(1), 1 + pick(4))
    query = F.concat(F.lit("?"), w(6), F.lit("="), F.when(pick(2) == 0, w(7)).otherwise(number), maybe(3, F.concat(F.lit("&"), w(8), F.lit("="), w(7))))
    path = F.concat(F.array_join(steps, "/"), of("  / .htm .pdf", pick(5)), F.when(pick(3) == 0, query).otherwise(maybe(6, F.concat(F.lit("#"), w(7)))))
    chain = F.array_join(F.slice("w", F.lit(10), 2 + pick(3)), "-")
    numbered = F.concat(w(14), pick(9000).cast("string"), maybe(2, F.concat(F.lit("-"), pick(900).cast("string"))))
    below = F.array_join(F.slice(F.transform(F.slice("w", 16, 6), lambda x, i: F.concat(x, F.when(draw(i, "sub", 2) == 0, draw(i, "count", 99).cast("string")).otherwise(""))), F.lit(1), 3 + pick(4)), ".")
    address = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: (1 + draw(i, "ip", 254)).cast("string")), ".")
    deep = F.array_join(F.transform(F.slice("t", F.lit(3), 2 + pick(5)), lambda x, i: F.substring(x, F.lit(1), 6 + draw(i, "deep", 20))), "/")
    pairs = F.transform(F.slice("t", F.lit(9), 3 + pick(5)), lambda x, i: F.concat(F.get("w", i + 24), F.lit("="), F.substring(x, F.lit(1), 4 + draw(i, "pair", 16))))
    many = F.concat(w(23), F.lit("?"), F.array_join(pairs, "&"))
    kind, plain = pick(8), pick(5)
    label = F.when(kind == 0, F.lower(short(0, 12, 10))).when(kind.isin(1, 6, 7), chain).when(kind == 2, numbered).when(kind == 3, below).otherwise(w(15))
    host = F.concat(maybe(4, F.lit("www.")), F.when(kind == 4, address).otherwise(F.concat(label, F.lit("."), of("com com org net top xyz click work biz gq", pick(10)))))
    # where the host itself gives nothing away, the path does
    bad_path = F.when((plain <= 2) & (kind != 5), path).when(plain % 2 == 1, deep).otherwise(many)
    blocked = F.col("id") % 2 == 0
    made = parts.select(blocked.alias("blocked"), of("http https https", pick(3)).alias("scheme"), F.when(blocked, host).otherwise(good_host).alias("host"), F.when(blocked, bad_path).otherwise(path).alias("path"))
    return made.select(F.concat("scheme", F.lit("://"), "host", F.lit("/"), "path").alias("url"), "blocked")


def train(sample: DataFrame) -> BoostedTrees:
    """Boosted trees of labelled (url, blocked) rows by histograms; a null in either doesn't count."""
    sample = stage(sample.where("url is not null and blocked is not null").select("url", F.col("blocked").cast("double").alias("y")), "urls")
    host, _ = url_parts(F.col("url"))
    total = sample.agg(F.count("*").alias("n"), F.sum("y").alias("y")).first()
    if not total.n:
        return BoostedTrees(0.0, [], {}, 0.5)
    base_rate = (total.y + 1) / (total.n + 2)
    by_suffix = sample.groupBy(F.regexp_extract(host, r"([^.]*)$", 1).alias("s")).agg(F.count("*").alias("n"), F.sum("y").alias("y")).orderBy(F.desc("n"), "s").limit(SUFFIXES).collect()
    rates = {r.s: round((r.y + 20 * base_rate) / (r.n + 20), 1) for r in by_suffix}  # in tenths: what differs by chance only is equal
    rows = stage(sample.select("y", *[c.alias(k) for k, c in lexical(F.col("url"), rates, base_rate).items()]), "features")
    at = [i / BINS for i in range(1, BINS)]
    found = rows.select(*[F.percentile_approx(k, at, 1000).alias(k) for k in FEATURES]).first()
    bounds = {k: sorted(set(found[k])) for k in FEATURES}
    bin_of = lambda name: F.size(F.filter(F.array(*map(F.lit, bounds[name])), lambda b: F.col(name) > b))
    binned = F.array(*map(bin_of, FEATURES))
    model = BoostedTrees(math.log(base_rate / (1 - base_rate)), [], rates, base_rate)
    # the labelled rows are bounded: in one partition, a level's sums need no shuffle, and each tree's margins are written once
    rows = stage(rows.select("y", binned.alias("bins"), F.lit(model.base).alias("margin")).coalesce(1), "bins")
    with plain_plans(sample.sparkSession):
        for _ in range(TREES):
            tree, weight = _grown(rows, bounds)
            model.trees.append(tree)
            rows = stage(rows.withColumn("margin", F.col("margin") + weight), "margins")
    return model


@contextmanager
def plain_plans(spark: SparkSession) -> Iterator[None]:
    """Within it, plans aren't compiled or planned again while they run, which takes longer than the few rows of a bounded sample."""
    names = ("spark.sql.codegen.wholeStage", "spark.sql.adaptive.enabled")
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n in names:
            spark.conf.set(n, "false")
        yield
    finally:
        for n, value in before.items():
            spark.conf.set(n, value)


def _grown(rows: DataFrame, bounds: dict[str, list[float]]) -> tuple[object, Column]:
    """The next tree of rows (y, bins, margin), and its weight for a row."""
    p = 1 / (1 + F.exp(-F.col("margin")))
    graded = rows.select("bins", (F.col("y") - p).alias("g"), (p * (1 - p)).alias("h"))
    splits: dict[int, tuple[int, int]] = {}  # node: feature, and the last bin that goes left
    leaves = {1: 0.0}

    def node_of(levels: int) -> Column:
        node: Column = F.lit(1)
        for level in range(levels):
            place = node
            for k in sorted(k for k in splits if k.bit_length() == level + 1):
                f, b = splits[k]
                place = F.when(node == k, 2 * k + (F.get("bins", F.lit(f)) > b).cast("int")).otherwise(place)
            node = place
        return node

    for level in range(LEVELS):
        sums = graded.select(node_of(level).alias("node"), F.posexplode("bins").alias("f", "b"), "g", "h").groupBy("node", "f", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
        grown = False
        for k in {r.node for r in sums if r.node.bit_length() == level + 1}:
            mine = {(r.f, r.b): (r.g, r.h) for r in sums if r.node == k}
            g, h = (sum(v[i] for (f, _), v in mine.items() if f == 0) for i in (0, 1))
            leaves[k], best = RATE * g / (h + PENALTY), (1e-6, None)
            for f, name in enumerate(FEATURES):
                left_g = left_h = 0.0
                for b in range(len(bounds[name])):
                    more_g, more_h = mine.get((f, b), (0.0, 0.0))
                    left_g, left_h = left_g + more_g, left_h + more_h
                    gain = left_g**2 / (left_h + PENALTY) + (g - left_g) ** 2 / (h - left_h + PENALTY) - g**2 / (h + PENALTY)
                    if left_h > 1 and h - left_h > 1 and gain > best[0] + 1e-9:
                        best = (gain, (f, b, RATE * left_g / (left_h + PENALTY), RATE * (g - left_g) / (h - left_h + PENALTY)))
            if best[1]:
                f, b, left, right = best[1]
                splits[k], leaves[2 * k], leaves[2 * k + 1], grown = (f, b), left, right, True
        if not grown:
            break
    nest = lambda k: (FEATURES[splits[k][0]], bounds[FEATURES[splits[k][0]]][splits[k][1]], nest(2 * k), nest(2 * k + 1)) if k in splits else leaves[k]
    weights = F.create_map(*[x for k, v in leaves.items() for x in (F.lit(k), F.lit(float(v)))])
    return nest(1), F.element_at(weights, node_of(LEVELS))


def judge(pages: DataFrame, rules: Sequence[Rule], model: BoostedTrees, keep: Sequence[str] = ("page_id",), url_column: str = "url") -> DataFrame:
    """(keep..., host, path, rule, verdict, score) for each row: verdict is the rule's action, and
    where no rule fits, block if the trees' probability (score) is above one half, else allow.

    Edge cases: a null URL, or one without ://, has empty host and path, fits no rule and is judged by
    the trees like any other; very long URLs are judged whole; repeated rows are kept; an empty
    table stays empty; columns other than keep and the URL are ignored, whatever their names."""
    url = F.col("judged_url")
    rows = pages.select(*[F.col(c).alias(f"kept_{c}") for c in keep], F.col(url_column).cast("string").alias("judged_url"))
    host, path = url_parts(url)
    rows = rows.withColumns({"host": host, "path": path}).withColumns({f"x_{k}": c for k, c in lexical(url, model.suffix_rates, model.base_rate).items()})
    rows = rows.withColumns({"rule": matched(rules, F.col("host"), F.col("path"), "name"), "action": matched(rules, F.col("host"), F.col("path"), "action"), "score": 1 / (1 + F.exp(-model.margin({k: F.col(f"x_{k}") for k in FEATURES})))})
    return rows.select(*[F.col(f"kept_{c}").alias(c) for c in keep], "host", "path", "rule", F.coalesce("action", F.when(F.col("score") > 0.5, "block").otherwise("allow")).alias("verdict"), "score")
