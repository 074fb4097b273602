"""Near-duplicate groups by bottom-k sketches of one hash function.

1. One scan makes, for each document, the set of its word shingles, a digest of that set, and the
   sketch: the smallest k of the set's hashes.
2. Documents with equal sets form a class; only one representative of a class goes on.
3. Inverted lists of retained values give candidates. A pair over the threshold shares at least
   `overlap` of the values that both retain (binomial tail below 1e-8), so only a representative's
   rarest values are listed: the prefix that any such partner must meet. Very common values drop out.
4. In a list, each member is first paired with the list's smallest member, its centre. Then members outside
   the list's main component meet one drawn member of it. A list of thousands of copies gives no pairs within itself.
5. What may still link different components is found by what members do not have in common with the centre:
   two sets that differ from it in different ways differ from each other. A pair over the threshold shares so
   many of its differences that it must meet in an inverted list of each one's rarest differences (across()).
   So a family of thousands of texts that are all alike, but below the threshold, gives few pairs.
6. A pair goes on if the sketch of the union estimates enough overlap; the full sets then decide.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WordHashes, components, keyed, restricted, stage, text_slices

#: Turns in which a list's members outside its main component meet one member of it, before they meet all.
ROUNDS = 1
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_HASHES = WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """The sorted distinct 63-bit hashes of the shingles of width words; A-Z are lower-cased first.
    A text with fewer words is one shingle; one without words (or null) has none."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.int64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n = min(width, len(words))
    last = len(words) - n + 1
    out = np.full(last, np.uint64(n))
    with np.errstate(over="ignore"):
        for i in range(n):
            out = _mix(out * _A + h[i : i + last])
    return np.unique(out >> np.uint64(1)).astype(np.int64)


def _scanner(width: int, k: int | None) -> Callable:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            others = [n for n in batch.schema.names if n != "text"]
            for start, texts in text_slices(batch, "text"):
                sets = [shingle_set(t, width) for t in texts]
                kept = [s[:k] for s in sets]
                offsets = np.zeros(len(sets) + 1, np.int32)
                np.cumsum([len(s) for s in kept], out=offsets[1:])
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(n).slice(start, len(sets)) for n in others),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(kept) if kept else [], pa.int64())),
                    ],
                    names=[*others, "class", "n_shingles", "hashes"],
                )

    return scan


def shingle_sets(rows: DataFrame, width: int, k: int | None = None) -> DataFrame:
    """The columns of rows (text among them) without text, and class, n_shingles, hashes: the whole sorted set, or
    its smallest k."""
    columns = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes if n != "text")
    return rows.mapInArrow(_scanner(width, k), f"{columns}, class binary, n_shingles long, hashes array<bigint>")


def certain_overlap(k: int, percent: int, miss: float = 1e-8) -> int:
    """The largest t so that a union's k smallest hashes hold fewer than t shared ones with a
    probability of at most miss, if percent of the union is shared."""
    p, total = percent / 100, 0.0
    for t in range(k + 1):
        total += math.comb(k, t) * p**t * (1 - p) ** (k - t)
        if total > miss:
            return max(1, t)
    return k


def index_lists(classes: DataFrame, percent: int, listed: int) -> DataFrame:
    """(value, rep, n): each representative's rarest retained values that another one retains too."""
    overlap = certain_overlap(listed, percent)
    postings = classes.where("n_shingles > 0").select("rep", "n_shingles", F.explode(F.slice("hashes", 1, listed)).alias("value"))
    # staged, as other short tables below: a join of two plain shuffles lets Spark split a value that very many have
    common = stage(postings.groupBy("value").agg(F.count("*").alias("lists")).where("lists > 1").select(F.col("value").alias("v"), "lists"), "common")
    met = postings.join(common, F.col("value") == F.col("v")).groupBy("rep", "n_shingles").agg(F.array_sort(F.collect_list(F.struct("lists", "value"))).alias("met"))
    kept = F.least("n_shingles", F.lit(listed))
    needed = F.least(F.ceil(F.col("n_shingles") * percent / F.lit(100)), F.lit(overlap))
    # the prefix is the rarest kept - needed + 1 values; those that nobody else retains come first
    prefix = kept - needed + 1 - (kept - F.size("met"))
    met = met.withColumn("prefix", prefix.cast("int")).where("prefix > 0")
    return met.select(F.explode(F.slice("met", F.lit(1), F.col("prefix"))).alias("x"), "rep", F.col("n_shingles").alias("n")).select("x.value", "rep", "n")


def full_sets(ids: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """(rep, n_shingles, hashes): the whole sets of the representatives in ids."""
    return stage(shingle_sets(restricted(rows.select(F.col("key").alias("rep"), "text"), "rep", ids), width).select("rep", "n_shingles", "hashes"), "sets")


def likely(pairs: DataFrame, classes: DataFrame, percent: int, k: int) -> DataFrame:
    """Those of pairs (a, b) whose union's sketch holds enough shared values."""
    least = certain_overlap(k, percent) / k
    short = classes.select("rep", F.col("hashes").alias("h"))
    union = F.slice(F.array_sort(F.array_union("ha", "hb")), 1, k)
    joined = pairs.join(short.toDF("a", "ha"), "a").join(short.toDF("b", "hb"), "b").withColumn("union", union)
    shared = F.size(F.array_intersect(F.col("union"), F.array_intersect("ha", "hb")))
    return stage(joined.where(shared >= F.size("union") * F.lit(least)).select("a", "b"), "likely")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose full sets reach percent."""
    joined = pairs.join(sets.toDF("a", "na", "sa"), "a").join(sets.toDF("b", "nb", "sb"), "b").withColumn("i", F.size(F.array_intersect("sa", "sb")))
    return stage(joined.where(F.col("i") * 100 >= (F.col("na") + F.col("nb") - F.col("i")) * percent).select("a", "b"), "links")


def met_shingles(sets: DataFrame) -> DataFrame:
    """(member, met): how many of a set's shingles another set of the same table holds too."""
    each = sets.select(F.col("rep").alias("member"), F.explode("hashes").alias("h"))
    shared = each.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select(F.col("h").alias("s"))
    return each.join(shared, F.col("h") == F.col("s")).groupBy("member").agg(F.count("*").alias("met"))


def _reachable(percent: int):
    """Whether sets of na and nb shingles, of which ma and mb can be shared, can have percent in common."""
    most = F.least("ma", "mb")
    return most * 100 >= (F.col("na") + F.col("nb") - most) * percent


def _rarest(rows: DataFrame, least: str) -> DataFrame:
    """Of rows with met (differences that another member has too, the rarest first): a row for each of those of which
    any partner must share one, if it shares at least `least` of them; rest: how many follow it, itself included."""
    prefix = F.greatest(F.lit(0), F.size("met") - F.col(least) + 1).cast("int")
    return rows.select("centre", "rep", "comp", "n", "excess", F.size("met").alias("met_n"), F.posexplode(F.slice("met", F.lit(1), prefix)).alias("i", "x")).select("centre", F.col("x.h").alias("h"), "rep", "comp", "n", "excess", (F.col("met_n") - F.col("i")).alias("rest"))


def across(still: DataFrame, met: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members of open lists in different components, every pair that reaches percent among them.

    For a list's centre c and a member x let d(x) be the shingles that only one of the two has, and excess(x) = |d(x)| - q n(x)
    with q = (100 - percent) / (100 + percent), n being the number of shingles. From |x ^ y| = |d(x)| + |d(y)| - 2 |d(x) & d(y)|,
    x and y reach percent exactly if |d(x) & d(y)| >= (excess(x) + excess(y)) / 2. A member that isn't linked
    with c has excess(x) > q n(c), and no set has less than -q n(c); as star pairs have been tested, at least one of x
    and y is such a member, so the bound is above 0. With the least excess on the other side it bounds how many
    differences x must share with any partner, hence which of them (the rarest) can't all be missed."""
    q = lambda p: (100 - p, 100 + p)
    down, up = q(percent)
    rows = still.join(met, still.rep == met.member).drop("member")
    least = stage(rows.groupBy("value").agg(F.min("n").alias("least")), "least-sizes")
    best = F.greatest(F.col("least"), F.ceil(F.col("n") * percent / F.lit(100)))
    hopeful = rows.where("comp <> main").join(least, "value").where(F.col("met") * 100 >= (F.col("n") + best - F.col("met")) * percent)
    lists = stage(hopeful.select(F.col("value").alias("v")).distinct(), "hopeful-lists")
    centres = stage(still.groupBy("value").agg(F.min(F.struct("rep", "comp")).alias("c")).join(lists, F.col("value") == F.col("v")).select("v", "c.*").toDF("v", "centre", "centre_comp"), "centres")
    members = still.join(centres, F.col("value") == F.col("v")).select("centre", "centre_comp", "rep", "comp").distinct()
    of = lambda name, array: sets.select(F.col("rep").alias(name), F.col("hashes").alias(array), F.col("n_shingles").alias(f"n_{name}"))
    both = members.join(of("x", "sx"), F.col("rep") == F.col("x")).join(of("c", "sc"), F.col("centre") == F.col("c"))
    d = F.concat(F.array_except("sx", "sc"), F.array_except("sc", "sx"))
    members = both.select("centre", "rep", "comp", (F.col("comp") != F.col("centre_comp")).alias("out"), F.col("n_x").alias("n"), d.alias("d"))
    members = stage(members.withColumn("excess", F.size("d") * up - F.col("n") * down), "differences")  # times up
    each = members.select("centre", "rep", F.explode("d").alias("h"))
    often = stage(each.groupBy("centre", "h").agg(F.count("*").alias("often")).where("often > 1"), "often")
    order = each.join(often, ["centre", "h"]).groupBy("centre", "rep").agg(F.array_sort(F.collect_list(F.struct("often", "h"))).alias("met"))
    bounds = members.groupBy("centre").agg(F.min(F.when(F.col("out"), F.col("excess"))).alias("least_out"), F.min(F.when(~F.col("out"), F.col("excess"))).alias("least_in")).where("least_out is not null")
    members = members.drop("d").join(order, ["centre", "rep"]).join(bounds, "centre")
    shared = lambda other: F.greatest(F.lit(1), F.ceil((F.col("excess") + F.col(other)) / F.lit(2 * up)))
    members = stage(members.withColumns({"with_out": shared("least_out"), "with_in": shared("least_in")}), "ordered")
    outer, inner = members.where("out"), members.where("not out")
    sides = lambda df, k: stage(df, f"rarest-{k}").select("centre", "h", *[F.col(c).alias(f"{c}_{k}") for c in ("rep", "comp", "n", "excess", "rest")])
    a, b = sides(_rarest(outer, "with_out"), "a"), sides(_rarest(outer, "with_out"), "b")
    a2, b2 = sides(_rarest(outer.where("with_in is not null"), "with_in"), "a"), sides(_rarest(inner, "with_out"), "b")
    fits = (F.col("comp_a") != F.col("comp_b")) & (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent) & (F.least("rest_a", "rest_b") * (2 * up) >= F.col("excess_a") + F.col("excess_b"))
    found = a.join(b, ["centre", "h"]).where((F.col("rep_a") < F.col("rep_b")) & fits).unionByName(a2.join(b2, ["centre", "h"]).where(fits))
    return stage(found.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")).distinct(), "across")


def _open_lists(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """lists with comp (the member's component so far) and main (the list's largest), for those lists
    that hold members of more than one component."""
    placed = stage(lists.join(roots, lists.rep == roots.node, "left").select("value", "rep", "n", F.coalesce("root", "rep").alias("comp")), "placed")
    parts = placed.groupBy("value", "comp").agg(F.count("*").alias("c"))
    several = stage(parts.groupBy("value").agg(F.max(F.struct("c", "comp")).alias("main"), F.count("*").alias("comps")).where("comps > 1").select(F.col("value").alias("v"), F.col("main.comp").alias("main")), "several")
    return stage(placed.join(several, F.col("value") == F.col("v")).select("value", "rep", "n", "comp", "main"), "open")


def _grouped(rows: DataFrame, width: int, percent: int, k: int, listed: int) -> DataFrame:
    """The columns of rows (key, doc_id and text among them; keys distinct and in the order of doc_id) without text, and
    n_shingles, component_id, first: whether the row's key is its group's least."""
    sketches = stage(shingle_sets(rows, width, k), "sketches")
    usable = sketches.where("n_shingles > 0 and doc_id is not null")
    reps = stage(usable.groupBy("class").agg(F.min("key").alias("rep"), F.min("doc_id").alias("rep_id")), "classes")
    classes = stage(usable.join(reps.select("class", "rep"), "class").where("key = rep").select("rep", "n_shingles", "hashes"), "reps")
    lists = stage(index_lists(classes, percent, listed), "lists")

    sizes_fit = (F.least("na", "nb") * 100) >= (F.greatest("na", "nb") * percent)
    first = lists.groupBy("value").agg(F.min(F.struct("rep", "n")).alias("first"), F.count("*").alias("c")).where("c > 1").select(F.col("value").alias("v"), F.col("first.rep").alias("a"), F.col("first.n").alias("na"))
    star = lists.join(stage(first, "firsts"), F.col("value") == F.col("v")).where("rep <> a").select("a", "na", F.col("rep").alias("b"), F.col("n").alias("nb"))
    star = stage(star.where(sizes_fit).select("a", "b").distinct(), "star")
    good = likely(star, classes, percent, k)
    links = confirmed(good, full_sets(good.select(F.explode(F.array("a", "b")).alias("id")).distinct(), rows, width), percent)
    roots = stage(components(links), "roots")
    tested = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    # the sets of all members of lists that are still open, and what of them can be shared at all
    still = _open_lists(lists, roots)
    sets = full_sets(still.select("rep").distinct(), rows, width)
    met = stage(met_shingles(sets), "met")
    for turn in range(ROUNDS):  # one member of the list's main component, another one in each list and turn
        placed = still.join(met, still.rep == met.member)
        outside = placed.where("comp <> main").select(F.col("value").alias("v"), F.col("rep").alias("a"), F.col("n").alias("na"), F.col("met").alias("ma"))
        drawn = placed.where("comp = main").groupBy("value").agg(F.min_by(F.struct(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("met").alias("mb")), F.xxhash64("rep", "value", F.lit(turn))).alias("x")).select("value", "x.*")
        rest = outside.join(stage(drawn, "drawn"), (F.col("v") == F.col("value")) & _reachable(percent)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        rest = stage(rest.join(tested, ["a", "b"], "left_anti"), "rest")
        if rest.isEmpty():
            break
        tested = tested.unionByName(rest)
        more = confirmed(likely(rest, classes, percent, k), sets, percent)
        if not more.isEmpty():
            links = links.unionByName(more)
            roots = stage(components(links), "roots")
            still = _open_lists(still.select("value", "rep", "n"), roots)
    more = confirmed(likely(across(still, met, sets, percent).join(tested, ["a", "b"], "left_anti"), classes, percent, k), sets, percent)
    if not more.isEmpty():
        roots = stage(components(links.unionByName(more)), "roots")

    roots = roots.join(reps.select(F.col("rep").alias("root"), F.col("rep_id").alias("root_id")), "root")
    named = reps.join(roots, reps.rep == roots.node, "left").select("class", F.coalesce("root", "rep").alias("least_key"), F.coalesce("root_id", "rep_id").alias("component_id"))
    others = [n for n in rows.columns if n != "text"]
    grouped = usable.select(*others, "class", "n_shingles").join(named, "class", "left").select(*others, "n_shingles", "component_id", (F.col("key") == F.col("least_key")).alias("first"))
    alone = sketches.where("n_shingles = 0 or doc_id is null").select(*others, "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("first"))
    return grouped.unionByName(alone)


def near_duplicate_groups(docs: DataFrame, width: int = 5, percent: int = 80, k: int = 64, listed: int = 32, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs.

    Two documents are linked if their sets of word shingles have a Jaccard similarity of at least
    percent / 100; component_id is the smallest doc_id that links reach, kept says that it is the
    row's own. No link is lost but with the sketch's stated probability; there is no cap on lists.

    Edge cases: a null, empty or white text has no shingles and stands alone; a null doc_id
    cannot name a group, so its row is linked with nothing: component_id null, kept true. Repeated
    rows appear as often as they came. Rows of one doc_id with different texts are compared with all others
    each by its own text, and may be in different groups.
    An empty table gives an empty table. Other columns are ignored, whatever their names."""
    found = _grouped(keyed(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))), width, percent, k, listed)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, k: int = 64, listed: int = 32) -> DataFrame:
    """docs (doc_id, text and any other columns) with one row of each group of near_duplicate_groups(): that of the
    smallest doc_id (of several texts of it, the first in order). Rows without doc_id or without words stay; rows
    of one doc_id and one text count as one, of which one stays. An empty table gives an empty table."""
    found = _grouped(keyed(docs).withColumn("digest", F.xxhash64("text")), width, percent, k, listed)
    kept = found.where("first and doc_id is not null").select(F.col("doc_id").alias("i"), F.col("digest").alias("d")).distinct()
    same = (docs["doc_id"].cast("long") == kept["i"]) & (F.xxhash64(docs["text"].cast("string")) == kept["d"])
    named = docs.join(kept, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return named.unionByName(docs.where("doc_id is null"))
