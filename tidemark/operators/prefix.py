"""Running folds over a key's rows in order, without sorting a key in one task.

An associative fold goes by ranges: its value over each range of a key (one aggregation with partial results), the values of the
ranges before carried to each range (one short row a range), and a window within the range. A range is a cell: an integer
column that doesn't fall along the order. Without one, a key is a window of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _sum(a: Column, b: Column) -> Column:
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)


#: name -> (the fold over a window or a range, how the value before a range and the one within it go together). `last` and `list` pass over nulls; the
#: list before a row is as long as the key, so its rows together are quadratic in a key's.
FOLDS: dict[str, tuple[Callable[[Column], Column], Callable[[Column, Column], Column]]] = {
    "sum": (F.sum, _sum),
    "max": (F.max, F.greatest),
    "min": (F.min, F.least),
    "last": (lambda c: F.last(c, ignorenulls=True), lambda before, inside: F.coalesce(inside, before)),
    "list": (F.collect_list, F.concat),
}


def cell_of(column: str, width: int | None) -> Column | None:
    """Cells of a width along an integer column; none without a width."""
    return F.floor(F.col(column) / F.lit(width)) if width else None


def even_cells(df: DataFrame, column: str, n: int = 256) -> Column:
    """Cells of about equally many rows of all keys together along a column, by approximate quantiles: n numbers go to the driver. So
    no cell of a key has more than about 1/n of all rows, but for rows of one value."""
    bounds = df.agg(F.percentile_approx(column, [i / n for i in range(1, n)], 100 * n).alias("b")).first().b or []
    return _place(F.col(column), sorted(set(bounds)), 0)


def _place(x: Column, bounds: list, before: int) -> Column:
    """How many of the sorted bounds x lies above, by halving them; before: bounds that were left behind."""
    if not bounds:
        return F.lit(before)
    half = len(bounds) // 2
    return F.when(x > F.lit(bounds[half]), _place(x, bounds[half + 1 :], before + half + 1)).otherwise(_place(x, bounds[:half], before))


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], values: dict[str, tuple[str, Column | str]], cell: Column | None = None, before: Sequence[str] = ()) -> DataFrame:
    """df with a column for each of values (name: (fold, column)): the fold over the key's rows up to and with this one, or, for those named
    in `before`, up to the one before it. With cells, keys must not be null and `order` must be names of columns for `last` and `list`."""
    upto = lambda w, name: w.rowsBetween(Window.unboundedPreceding, -1 if name in before else 0)
    column = lambda c: F.col(c) if isinstance(c, str) else c
    if cell is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumns({name: FOLDS[fold][0](column(c)).over(upto(w, name)) for name, (fold, c) in values.items()})
    # values are computed once, and folded by name
    rows = df.withColumns({"_cell": cell, **{f"_v_{name}": column(c) for name, (_, c) in values.items()}})
    names = [*keys, "_cell"]
    w = Window.partitionBy(*names).orderBy(*order)

    def whole(name: str, fold: str) -> Column:
        c = F.col(f"_v_{name}")
        if fold == "list":
            return F.transform(F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct(*order, c.alias("_x"))))), lambda x: x["_x"])  # one cell's values
        return F.max_by(c, F.when(c.isNotNull(), F.struct(*order))) if fold == "last" else FOLDS[fold][0](c)

    earlier = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)

    def brought(name: str, fold: str) -> Column:
        c = FOLDS[fold][0](F.col(f"_p_{name}")).over(earlier)
        return F.flatten(c) if fold == "list" else c

    partials = rows.groupBy(*names).agg(*(whole(name, fold).alias(f"_p_{name}") for name, (fold, _) in values.items()))
    carried = partials.select(*names, *(brought(name, fold).alias(f"_c_{name}") for name, (fold, _) in values.items()))
    inside = rows.withColumns({f"_i_{name}": FOLDS[fold][0](F.col(f"_v_{name}")).over(upto(w, name)) for name, (fold, _) in values.items()})
    both = inside.join(carried, names, "left").withColumns({name: FOLDS[fold][1](F.col(f"_c_{name}"), F.col(f"_i_{name}")) for name, (fold, _) in values.items()})
    return both.drop("_cell", *(f"_{x}_{name}" for name in values for x in "vpci"))


def positions(df: DataFrame, order: Sequence[str], cells: int = 256) -> DataFrame:
    """df with `position`: each row's place, from 0, in an order of distinct values whose first column is a number. Rows are counted by cells of
    about equal size and numbered within them, so no task sorts all."""
    counted = running(df, [], order, {"position": ("sum", F.lit(1))}, even_cells(df, order[0], cells))
    return counted.withColumn("position", F.col("position") - 1)
