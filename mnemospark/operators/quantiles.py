"""Exact order statistics of groups of any size: places are found by counting, and only what lies around them is ordered.

A group of up to FEW rows is ordered in one task. In a larger one the range of values is cut into CELLS cells of equal
width; tasks count their own rows by cell, and the sums tell which cell holds a place. Its own least and greatest
value are the next range, until the rows within are few or equal. No round shuffles more than counts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_folder

#: Rows of a group that one task orders; cells of a round; states (groups x places) that are broadcast.
FEW, CELLS, BROADCAST = 1_000_000, 1024, 100_000


def _finite(d: Column) -> Column:
    return F.when(F.abs(d) < float("inf"), d)


def _cell(d: Column, low: Column, high: Column) -> Column:
    """The cell of a value; halves, so that no difference overflows; infinities and NaN have cells of their own."""
    share = (d / 2 - low / 2) / F.nullif(high / 2 - low / 2, F.lit(0.0))
    inside = F.coalesce(F.least(F.floor(share * CELLS), F.lit(CELLS - 1)), F.lit(0))
    return F.when(F.isnan(d), CELLS + 1).when(d == float("inf"), CELLS).when(d == float("-inf"), -1).otherwise(inside).cast("int")


def _near(rows: DataFrame, state: DataFrame, states: int) -> DataFrame:
    """The rows within the range of each state of their group."""
    state = F.broadcast(state) if states <= BROADCAST else state
    return rows.join(state, rows["g"].eqNullSafe(state["of"]) & (rows["v"] >= state["low"]) & (rows["v"] <= state["high"]))


def _ordered(counts: DataFrame, by: list[str], order: str, place: Column) -> DataFrame:
    """The row of counts (c of each value or cell) in which a 0-based place lies, with before: the rows ahead of it."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = counts.withColumn("upto", F.sum("c").over(w))
    return upto.withColumn("before", F.col("upto") - F.col("c")).where((F.col("before") <= place) & (place < F.col("upto")))


def at_places(df: DataFrame, groups: Sequence[str], value: str, places: dict[str, Callable[[Column], Column]], few: int | None = None) -> DataFrame:
    """groups, __n (values that are there) and, under each name, the value at a 0-based place of the sorted values.

    places: by name, a place from the number of values. NaN is the greatest value; nulls are no values, and a group
    without any is not in the result. A null group is a group.
    """
    few = FEW if few is None else few
    spark = df.sparkSession
    kinds = [df.schema[g] for g in groups]
    rows = df.where(F.col(value).isNotNull()).select(F.struct(*[F.col(g).alias(f"g{i}") for i, g in enumerate(groups)], F.lit(1).alias("one")).alias("g"), F.col(value).alias("v"))
    d = F.col("v").cast("double")
    sizes = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.min(_finite(d)).alias("dlow"), F.max(_finite(d)).alias("dhigh"))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), f(F.col("n")).cast("long").alias("place")) for name, f in places.items()]))
    large = sizes.where(F.col("n") > few)
    checkpoint_folder(spark)
    state = large.select(F.col("g").alias("of"), "n", "low", "high", "dlow", "dhigh", F.col("n").alias("left"), wanted.alias("p")).select("of", "n", "low", "high", "dlow", "dhigh", "left", "p.name", "p.place").checkpoint()
    states = state.count()
    parts = []
    if states:
        small = rows.join(F.broadcast(state.select("of").distinct()) if states <= BROADCAST else state.select("of").distinct(), F.col("g").eqNullSafe(F.col("of")), "left_anti")
        done = (F.col("left") <= few) | (F.col("low") == F.col("high"))
        settled = []
        while states:
            settled.append(state.where(done))
            open_ = state.where(~done)
            states = open_.count()
            if not states:
                break
            near = _near(rows, open_, states).withColumn("cell", _cell(d, F.col("dlow"), F.col("dhigh")))
            by = ["of", "name"]
            counts = near.groupBy(*by, "n", "place", "left", "cell").agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("low"), F.max("v").alias("high"), F.min(_finite(d)).alias("dlow"), F.max(_finite(d)).alias("dhigh"))
            chosen = _ordered(counts, by, "cell", F.col("place"))
            # a cell that holds all that was there (values that differ beyond a double) is ordered as it is
            left = F.when(F.col("c") == F.col("left"), few).otherwise(F.col("c"))
            state = chosen.select("of", "n", "low", "high", "dlow", "dhigh", left.cast("long").alias("left"), "name", (F.col("place") - F.col("before")).alias("place")).checkpoint()
        for s in settled:
            parts.append(s.where(F.col("low") == F.col("high")).select("of", "n", "name", F.col("low").alias("v")))
            rest = s.where((F.col("low") < F.col("high")) | F.col("low").isNull())
            counts = _near(rows, rest, BROADCAST).groupBy("of", "name", "n", "place", "v").agg(F.count(F.lit(1)).alias("c"))
            parts.append(_ordered(counts, ["of", "name"], "v", F.col("place")).select("of", "n", "name", "v"))
    else:
        small = rows
    counted = small.groupBy("g", "v").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("g")
    placed = counted.withColumn("upto", F.sum("c").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("n", F.sum("c").over(w))
    out = placed.groupBy(F.col("g").alias("of"), "n").agg(*[F.min(F.when(F.col("upto") > f(F.col("n")), F.col("v"))).alias(name) for name, f in places.items()])
    if parts:
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
        out = out.unionByName(found.groupBy("of", "n").agg(*[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in places]))
    return out.select(*[F.col(f"of.g{i}").alias(k.name) for i, k in enumerate(kinds)], F.col("n").alias("__n"), *places)


def nearest_rank(df: DataFrame, groups: Sequence[str], value: str, quantiles: dict[str, float], few: int | None = None) -> DataFrame:
    """For each group the values at 0-based place min(n - 1, int(n * q)) of the sorted values."""
    place = lambda q: lambda n: F.least(n - 1, F.floor(n * F.lit(q)))
    return at_places(df, groups, value, {name: place(q) for name, q in quantiles.items()}, few).drop("__n")


def interpolated(df: DataFrame, groups: Sequence[str], value: str, quantiles: dict[str, float], few: int | None = None) -> DataFrame:
    """For each group the value at place (n - 1) * q, between the two values beside it, as a double."""
    places = {}
    for name, q in quantiles.items():
        places[f"{name}__below"] = lambda n, q=q: F.floor((n - 1) * F.lit(q))
        places[f"{name}__above"] = lambda n, q=q: F.ceil((n - 1) * F.lit(q))
    got = at_places(df, groups, value, places, few)
    at = lambda q: (F.col("__n") - 1) * F.lit(q) - F.floor((F.col("__n") - 1) * F.lit(q))
    low, high = (lambda name: F.col(f"{name}__below").cast("double")), (lambda name: F.col(f"{name}__above").cast("double"))
    return got.select(*groups, *[F.when(low(name) == high(name), low(name)).otherwise(low(name) + (high(name) - low(name)) * at(q)).alias(name) for name, q in quantiles.items()])
