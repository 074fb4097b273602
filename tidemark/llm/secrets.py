"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio.

Everything runs as DataFrame expressions: positions come from the lengths of what lies between the
matches; the two models are bigram tables counted from labelled samples and folded into one array.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The patterns of the base kinds, in their order, with the length that a match must have.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "markov")
ASSIGN_LEAST = 12

#: What the models judge: runs of these characters, of at least so many.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
#: Rows of the labelled sample that are made for training where none is given (half of each label).
SAMPLE_ROWS = 8_000
#: The share of labelled ordinary identifiers that may be taken for random ones.
FALSE_SHARE = 0.001
ASCII = 128

#: Parts of ordinary identifiers.
PARTS = (
    "account address agent alpha amount archive array asset async author backup balance batch before binary block branch bridge buffer bundle cache "
    "callback channel check client cluster column command common compile config connect console container content context control counter create current "
    "custom data default delete deploy detail device digest direct display document domain download driver element email enable engine entity error "
    "event example export extension factory feature field filter final folder format function gateway general global graph group handler header height "
    "history image import index input instance interface internal invoice item journal label language layer layout length library limit list local "
    "location logger machine manager mapping master matrix member memory message method metric middle minimum model module monitor network number object "
    "offset operator option order output owner package packet page panel parameter parent parser partition path pattern payment pipeline pixel platform "
    "player plugin point policy position prefix primary printer priority process product profile project property protocol provider public query random"
).split()


def labelled_sample(spark: SparkSession, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(value, is_random): a seeded sample of random strings (hexadecimal, base 64, upper-case letters
    and digits) and of ordinary identifiers (parts joined by _, -, / or camel case, some numbered)."""
    ids = spark.range(0, rows, 1, 4)
    pick = lambda k, n: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(n)).cast("int")
    digest = F.sha2(F.concat(F.lit("sample:"), F.col("id").cast("string")).cast("binary"), 256)
    second = F.sha2(digest.cast("binary"), 256)
    base64 = F.regexp_replace(F.base64(F.unhex(F.concat(digest, second))), "[=\\s]", "")
    upper = F.upper(F.regexp_replace(base64, "[+/]", ""))
    length = 20 + pick("length", 24)
    random = F.when(pick("kind", 4) == 0, F.concat(digest, second)).when(pick("kind", 4) == 1, upper).otherwise(base64)
    words = F.split(F.lit(" ".join(PARTS)), " ")
    part = lambda k: F.element_at(words, pick(k, len(PARTS)) + 1)
    some = F.slice(F.array(*[part(f"p{i}") for i in range(6)]), 1, 3 + pick("parts", 4))
    camel = F.array_join(F.transform(some, lambda w: F.initcap(w)), "")
    joined = F.when(pick("join", 4) == 0, F.array_join(some, "_")).when(pick("join", 4) == 1, F.array_join(some, "-")).when(pick("join", 4) == 2, F.array_join(some, "/")).otherwise(camel)
    ordinary = F.when(pick("number", 5) == 0, F.concat(joined, pick("n", 1000).cast("string"))).when(pick("number", 5) == 1, F.array_join(some, "")).when(pick("number", 5) == 2, F.upper(joined)).otherwise(joined)
    is_random = F.col("id") % 2 == 0
    return ids.select(F.when(is_random, F.substring(random, F.lit(1), length)).otherwise(ordinary).alias("value"), is_random.alias("is_random"))


def _score(token: Column, table: Column) -> Column:
    """The mean of the bigrams' log-likelihood ratios; the token's characters are taken apart once."""
    codes = F.transform(F.split(token, ""), lambda c: F.ascii(c))
    mean = lambda a: F.aggregate(F.sequence(F.lit(1), F.size(a) - 1), F.lit(0.0), lambda s, i: s + F.element_at(table, F.element_at(a, i) * ASCII + F.element_at(a, i + 1) + 1)) / (F.size(a) - 1)
    return F.element_at(F.transform(F.array(codes), mean), 1)


class MarkovModel:
    """table: SQL text of an array of log-likelihood ratios, by 128 * first + second character code;
    threshold: the least mean ratio of a token that counts as random."""

    def __init__(self, numbers: list[float], threshold: float = 0.0):
        self.numbers, self.threshold = numbers, threshold

    def table(self) -> Column:
        return F.split(F.lit(",".join(f"{x:.3f}".rstrip("0").rstrip(".") for x in self.numbers)), ",").cast("array<double>")

    def score(self, token: Column) -> Column:
        return _score(token, self.table())


def train(sample: DataFrame, smooth: float = 0.5, false_share: float = FALSE_SHARE) -> MarkovModel:
    """The models of labelled (value, is_random) rows; nulls and values under 2 characters don't count.
    Only bigram counts (at most 2 * 128 * 128) reach the driver."""
    sample = sample.where("value is not null and is_random is not null and length(value) > 1")
    chars = sample.select("is_random", F.transform(F.split(F.regexp_replace("value", "[^\\x00-\\x7F]", "?"), ""), lambda c: F.ascii(c)).alias("a"))
    pairs = chars.select("is_random", F.explode(F.arrays_zip(F.slice("a", F.lit(1), F.size("a") - 1).alias("x"), F.slice("a", F.lit(2), F.size("a") - 1).alias("y"))).alias("p"))
    counts: dict = defaultdict(float)
    totals: dict = defaultdict(float)
    for r in pairs.groupBy("is_random", F.col("p.x").alias("x"), F.col("p.y").alias("y")).count().collect():
        counts[r.is_random, r.x, r.y] += r["count"]
        totals[r.is_random, r.x] += r["count"]
    kinds = 68  # characters that tokens are made of
    log_p = lambda label, x, y: math.log((counts[label, x, y] + smooth) / (totals[label, x] + smooth * kinds))
    numbers = [log_p(True, x, y) - log_p(False, x, y) for x in range(ASCII) for y in range(ASCII)]
    model = MarkovModel(numbers)
    top = sample.where("not is_random").select(F.percentile_approx(model.score(F.regexp_replace("value", "[^\\x00-\\x7F]", "?")), 1 - false_share, 10_000).alias("t")).first().t
    model.threshold = max(0.0, top or 0.0)
    return model


#: Matches whose positions are added up together: appending to an array copies it, so long lists grow block by block.
BLOCK = 256


def _spans(text: Column, pattern: str, kept) -> Column:
    """The (start, end) in code points of the pattern's leftmost matches for which kept(i-th row of
    groups) holds: the lengths of matches and of what lies between them add up to positions."""
    whole, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    parts = F.arrays_zip(whole.alias("hit"), between.alias("gap"), *([F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("group")] if pattern == ASSIGN else []))
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def step(state, x):
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        span = F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))
        return F.struct(end.cast("int").alias("at"), F.when(kept(x), F.array_append(state["out"], span)).otherwise(state["out"]).alias("out"))

    def block(state, some):
        inside = F.aggregate(some, F.struct(state["at"].alias("at"), empty.alias("out")), step)
        return F.transform(F.array(inside), lambda i: F.struct(i["at"].alias("at"), F.array_append(state["out"], i["out"]).alias("out")))[0]

    def placed(hits: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(hits) - 1) / BLOCK).cast("int")), lambda b: F.slice(hits, b * BLOCK + 1, F.lit(BLOCK)))
        return F.flatten(F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,end:int>>>").alias("out")), block)["out"])

    hits = F.filter(parts, lambda x: x["hit"].isNotNull())
    return F.when(text.rlike(pattern), F.transform(F.array(hits), placed)[0]).otherwise(empty)


def scan(docs: DataFrame, model: MarkovModel, text_column: str = "text") -> DataFrame:
    """docs with the columns secret_assign, secret_access, secret_hex, secret_markov: arrays of
    (start, end) in code points, end exclusive, leftmost and non-overlapping within a kind.

    secret_markov: tokens whose mean log-likelihood ratio is above the model's threshold and that
    meet no span of the other kinds.

    Edge cases: a null or empty text has no spans; very long texts are scanned whole; ties and repeated rows are rows like any other; an empty
    table stays empty. Columns of docs whose names these four take are replaced."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    docs = docs.drop("secret_assign", "secret_access", "secret_hex", "secret_markov")
    always = lambda x: F.lit(True)
    docs = docs.withColumns({
        "secret_assign": _spans(text, ASSIGN, lambda x: F.length(x["group"]) >= ASSIGN_LEAST),
        "secret_access": _spans(text, ACCESS, always),
        "secret_hex": _spans(text, HEX, always),
        "secret_markov": _spans(text, TOKEN, lambda x: model.score(x["hit"]) > model.threshold),
    })
    base = F.concat("secret_assign", "secret_access", "secret_hex")
    return docs.withColumn("secret_markov", F.filter("secret_markov", lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))))


def described(*kinds: str) -> Column:
    """kind:start:end of all spans of the kinds, by start, then kind, joined by commas."""
    ranked = lambda rank: lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"))
    tagged = [F.transform(f"secret_{k}", ranked(KINDS.index(k))) for k in kinds]
    names = F.array(*[F.lit(k) for k in KINDS])
    each = F.transform(F.array_sort(F.concat(*tagged)), lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(each, ",")


def redact(docs: DataFrame, model: MarkovModel, text_column: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of every kind replaced by the mark in text_column (spans that overlap: by
    one); the columns stay as they are, whatever their names. A null text stays null, an empty one empty, long
    ones are read whole; repeated rows stay; an empty table stays empty."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_column).cast("string").alias("text"))
    found, text = scan(rows, model), F.col("text")
    spans = F.array_sort(F.concat(*[f"secret_{k}" for k in KINDS]))

    def step(state, s):
        gap = F.substring(text, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        fresh = (s["start"] >= state["at"]) | (state["at"] == 0)
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(fresh, F.concat(state["out"], gap, F.lit(mark))).otherwise(state["out"]).alias("out"))

    done = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    clean = F.element_at(F.transform(F.array(done), lambda d: F.concat(d["out"], F.substring(text, d["at"] + 1, F.length(text)))), 1)
    found = found.select("row", F.when(F.size(spans) > 0, clean).otherwise(text).alias("text"))
    return found.select(*[(F.col("text") if c == text_column else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
