"""Mixing sources to target weights by a min-cost flow over membership patterns.

Documents with the same set of sources form a pattern. A pattern's words can be taken again and again,
each pass at a higher cost (convex), up to max_repeats. A flow of least cost routes passes of
patterns to the sources' quotas; it sees only pattern totals, whose number a parameter bounds.
Then each pattern's flow turns into documents: every document gets the whole passes, and seeded
hashes choose who gets one more, exactly to the word, through two histograms, so that no
source is ever sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, stage

#: Bins of each of the two histograms over a document's seeded hash (60 bits).
BINS_BITS = 12
#: Distinct membership patterns that the flow takes; they are the only thing that goes to the driver.
MAX_PATTERNS = 100_000


def word_count(column: str):
    """The number of runs of characters other than ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(F.col(column).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict, weights: Sequence[float], most: float) -> dict:
    """The target of each source: 100 % of all sizes shared by weight, at most `most` times the
    source's size; what is over is shared again by weight among the rest, until none is above.
    Sources are in code point order, null last, and the weights repeat over them."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed, free = float(sum(sizes.values())), {}, list(names)
    while free:
        left, all_weights = total - sum(fixed.values()), sum(weight[s] for s in free)
        share = {s: left * weight[s] / all_weights for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return {**fixed, **share}
        fixed |= {s: float(most * sizes[s]) for s in over}
        free = [s for s in free if s not in fixed]
    return fixed


def route(patterns: dict[tuple, int], quotas: dict, max_repeats: int) -> dict[tuple, int]:
    """Words to take of each pattern, by a min-cost flow: pattern p offers its size at cost r in
    pass r (r = 1 .. max_repeats); its words count for one of its sources. A quota that can't be filled isn't an error.

    All cost lies on the passes, so every augmenting path of the residual graph costs what its last pass does, and
    least-cost paths of one cost are a maximum flow with each pattern open up to that pass. That is max_repeats
    maximum flows, each going on from the one before, by blocking flows over all sources at once."""
    names = list(patterns)
    sources = {s: i for i, s in enumerate(quotas)}
    of_pattern = [[sources[s] for s in p if s in sources] for p in names]
    of_source: list[list[int]] = [[] for _ in sources]
    for p, members in enumerate(of_pattern):
        for s in members:
            of_source[s].append(p)
    flow = [dict.fromkeys(members, 0) for members in of_pattern]
    used, need = [0] * len(names), list(quotas.values())
    for turn in range(1, max_repeats + 1):
        room = [patterns[p] * turn - u for p, u in zip(names, used, strict=True)]
        while True:
            # layers from all sources that want more: source -> its patterns -> sources that hold a pattern's words
            level_s, level_p = {s: 0 for s, n in enumerate(need) if n > 0}, {}
            front, depth, ends = list(level_s), 0, False
            while front and not ends:
                depth += 1
                reached = []
                for s in front:
                    for p in of_source[s]:
                        if p not in level_p:
                            level_p[p] = depth
                            reached.append(p)
                            ends = ends or room[p] > 0
                front = []
                depth += 1
                for p in reached if not ends else ():
                    for s, f in flow[p].items():
                        if f > 0 and s not in level_s:
                            level_s[s] = depth
                            front.append(s)
            if not ends:
                break
            # a blocking flow: paths down the layers, each source and pattern remembering where to go on
            at_s, at_p = [0] * len(sources), [0] * len(names)
            for first in [s for s, x in level_s.items() if x == 0]:
                path: list[int] = [first]  # sources and patterns in turn
                while need[first] > 0 and path:
                    node, source = path[-1], len(path) % 2 == 1
                    steps = of_source[node] if source else of_pattern[node]
                    at, level = (at_s, level_s) if source else (at_p, level_p)
                    if not source and room[node] > 0:
                        amount = min(need[first], room[node], *(flow[path[i]][path[i + 1]] for i in range(1, len(path) - 1, 2)))
                        for i in range(1, len(path), 2):
                            flow[path[i]][path[i - 1]] += amount
                            if i + 1 < len(path):
                                flow[path[i]][path[i + 1]] -= amount
                        room[node] -= amount
                        used[node] += amount
                        need[first] -= amount
                        path = [first]
                        continue
                    while at[node] < len(steps):
                        to = steps[at[node]]
                        below = (level_p if source else level_s).get(to) == level[node] + 1
                        if below and (source or flow[node][to] > 0):
                            path.append(to)
                            break
                        at[node] += 1
                    else:  # nothing below: the node before goes on with its next step
                        path.pop()
                        if path:
                            (at_p if source else at_s)[path[-1]] += 1
    return dict(zip(names, used, strict=True))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_repeats: int = 3, seed: str = "mix", source_column: str = "source", part: bool = True, keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, size, source_size, target, taken) and the columns in keep, for each row of docs.

    source_column holds a source or an array of them. size: words; source_size and target: sums over
    the row's sources. taken: words that the mix takes, repeats counted, at most max_repeats * size.
    With part, the one document of a pattern at the margin is taken in part, so that the
    pattern's words are met exactly; without, it is taken whole if at least half of it is due.

    Edge cases: null text has size 0 and is never taken; a null source (or null or empty array)
    is a source of its own, last in order; repeated rows are rows like any other, rows without doc_id go by their text; ties
    of the hash go by doc_id, then size; an empty table gives an empty table. Other columns are
    ignored, whatever their names."""
    several = dict(docs.dtypes)[source_column].startswith("array")
    names = F.col(source_column).cast("array<string>") if several else F.array(F.col(source_column).cast("string"))
    names = F.when(F.coalesce(F.size(names), F.lit(0)) < 1, F.array(F.lit(None).cast("string"))).otherwise(F.array_sort(F.array_distinct(names)))
    own = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))
    key = F.md5(F.concat_ws(":", F.lit(seed), own).cast("binary"))
    rows = docs.select(*[F.col(c).alias(f"kept_{c}") for c in keep], F.col("doc_id").cast("long").alias("doc_id"), word_count("text").alias("size"), names.alias("sources"), F.conv(F.substring(key, 1, 15), 16, 10).cast("long").alias("u"))
    # words are counted once; the text itself isn't staged unless it is asked for
    rows = stage(rows, "sizes")

    found = rows.groupBy("sources").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    patterns = {tuple(r.sources): r.size for r in found}
    sizes: dict = {}
    for p, size in patterns.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + size
    # a document of several sources counts once in what is shared out
    scale = sum(patterns.values()) / sum(sizes.values()) if sum(sizes.values()) else 1
    want = targets({s: n * scale for s, n in sizes.items()}, weights, max_repeats) if scale != 1 else targets(sizes, weights, max_repeats)
    taken = route({p: n for p, n in patterns.items() if n}, {s: round(t) for s, t in want.items()}, max_repeats)
    plan = [(list(p), sum(sizes[s] for s in p), float(sum(want[s] for s in p)), taken.get(p, 0) // n if n else 0, taken.get(p, 0) % n if n else 0) for p, n in patterns.items()]
    plan = docs.sparkSession.createDataFrame(plan, "p array<string>, source_size long, target double, passes long, rest long")
    rows = rows.join(F.broadcast(plan), F.coalesce(F.to_json("sources"), F.lit("")) == F.coalesce(F.to_json("p"), F.lit(""))).drop("p")
    return chosen(rows, max_repeats, part).select(*[F.col(f"kept_{c}").alias(c) for c in keep if c != "doc_id"], "doc_id", "size", "source_size", "target", "taken")


def chosen(rows: DataFrame, max_repeats: int, part: bool) -> DataFrame:
    """rows with taken: passes for all, and one more pass, in order of (u, doc_id, size), up to rest words.

    Two histograms find the cell of u where the running total meets rest; only rows of that cell
    (about one in 2 ** (2 * BINS_BITS)) are put in order one by one."""
    high, low = F.shiftright("u", 60 - BINS_BITS), F.shiftright("u", 60 - 2 * BINS_BITS)
    rows = rows.withColumn("high", high).withColumn("low", low)
    due = rows.where("rest > 0")

    def crossing(cells: DataFrame, cell: str, base: str) -> DataFrame:
        run = F.sum("w").over(Window.partitionBy("sources").orderBy(cell).rowsBetween(Window.unboundedPreceding, 0))
        cells = cells.withColumn("after", F.col(base) + run)
        return cells.where((F.col("after") >= F.col("rest")) & (F.col("after") - F.col("w") < F.col("rest")))

    first = crossing(due.groupBy("sources", "rest", "high").agg(F.sum("size").alias("w")).withColumn("base", F.lit(0)), "high", "base")
    first = first.select(F.col("sources").alias("s1"), F.col("high").alias("high1"), (F.col("after") - F.col("w")).alias("base"))
    same = lambda a, b: F.to_json(F.struct(F.col(a))) == F.to_json(F.struct(F.col(b).alias(a)))
    inside = due.join(F.broadcast(first), same("sources", "s1") & (F.col("high") == F.col("high1")))
    second = crossing(inside.groupBy("sources", "rest", "base", "low").agg(F.sum("size").alias("w")), "low", "base")
    second = second.select(F.col("sources").alias("s1"), F.col("low").alias("low1"), (F.col("after") - F.col("w")).alias("base"))
    placed = rows.join(F.broadcast(second), same("sources", "s1"), "left").drop("s1")
    at_margin = (F.col("rest") > 0) & (F.col("low") == F.col("low1"))
    order = Window.partitionBy("sources").orderBy("u", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    margin = placed.where(at_margin).withColumn("before", F.col("base") + F.sum("size").over(order) - F.col("size"))
    share = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
    if not part:
        share = F.when(share * 2 >= F.col("size"), F.col("size")).otherwise(0)
    margin = margin.withColumn("more", share).drop("before")
    others = placed.where(~F.coalesce(at_margin, F.lit(False))).withColumn("more", F.when((F.col("rest") > 0) & (F.col("low") < F.col("low1")), F.col("size")).otherwise(0))
    return others.unionByName(margin).withColumn("taken", F.least(F.col("size") * F.col("passes") + F.col("more"), F.col("size") * max_repeats).cast("long"))
