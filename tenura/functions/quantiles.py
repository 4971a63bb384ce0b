"""Exact quantiles of many distinct values: rows are only ever counted by interval.

An order statistic is searched by refinement. The first scan counts values by sign and power of two; each further one
cuts the interval that holds the wanted rank into CUTS pieces. An interval whose least and greatest value are equal is
the answer. Every count keeps its least and greatest value, so the next cut begins at values that exist. What a task or
the driver holds is CUTS counts for each quantile, whatever the number of rows. Cuts are monotone in the value, so
rounding can't put a value on the wrong side.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

CUTS = 4096


@dataclass
class Search:
    """One order statistic: the value of `rank` among those in [low, high]; `above` is the least value beyond, if any."""

    group: tuple
    rank: int
    low: float
    high: float
    above: float | None

    @property
    def done(self) -> bool:
        return self.low == self.high


def magnitude(x: Column) -> Column:
    """A number that grows with x, the same for all values of a sign between two powers of two."""
    power = lambda v: F.floor(F.least(F.log2(v), F.lit(3000.0))) + 2000
    return F.when(x == 0, 0).when(x > 0, power(x)).otherwise(-power(-x)).cast("long")


def piece(x: Column, low: Column, high: Column) -> Column:
    """Which of CUTS equal pieces of [low, high] has x; halves keep the width of the widest interval finite."""
    return F.floor((x / 2 - low / 2) / (high / 2 - low / 2) * (CUTS - 1)).cast("long")


def tallied(rows: DataFrame, by: list[str], cut: Column) -> DataFrame:
    """(by..., cut, n, low, high, before, above): counts by cut, with how many come before and the least value after."""
    cells = rows.groupBy(*by, cut.alias("cut")).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    order = Window.partitionBy(*by).orderBy("cut")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return cells.withColumns({"before": before, "above": F.lead("low").over(order)})


def exact_quantiles(rows: DataFrame, column: str, qs: list[float], by: list[str] | None = None) -> DataFrame:
    """(by..., values): the quantiles `qs` of each group, interpolated between neighbours as numpy's percentile and SQL's quantile_cont do.

    Nulls and NaN are left out; a group without values has no row. Groups must be few (graces, clusters, one): a row for
    each group and quantile comes to the driver after each of at most a handful of scans.
    """
    by = by or []
    spark = rows.sparkSession
    x = F.col(column).cast("double")
    keyed = rows.select(*by, (x + 0.0).alias("x")).where("x IS NOT NULL AND NOT isnan(x)")
    first = tallied(keyed, by, magnitude(F.col("x"))).withColumn("total", F.sum("n").over(Window.partitionBy(*by)))
    of = lambda r: tuple(r[c] for c in by)
    cells: dict[tuple, list] = {}
    for r in first.collect():  # a row for each group and power of two
        cells.setdefault(of(r), []).append(r)
    asked: dict[tuple, list[tuple[Search, float]]] = {}
    for group, found in cells.items():
        for q in qs:
            place = q * (found[0]["total"] - 1)
            rank = int(place)
            cell = next(c for c in found if c["before"] <= rank < c["before"] + c["n"])
            asked.setdefault(group, []).append((Search(group, rank - cell["before"], cell["low"], cell["high"], cell["above"]), place - rank))
    kinds = [rows.schema[c] for c in by]
    # whether the next value is the same one or `above` depends on how many there are in the last interval
    sizes: dict[int, int] = {id(s): next(c["n"] for c in cells[g] if c["low"] == s.low) for g, some in asked.items() for s, _ in some}
    while left := [s for some in asked.values() for s, _ in some if not s.done]:
        bounds = spark.createDataFrame([(*s.group, i, s.low, s.high) for i, s in enumerate(left)], StructType([*kinds, *StructType.fromDDL("search int, a double, b double")]))
        same = [keyed[c].eqNullSafe(bounds[c]) for c in by]
        within = keyed.join(F.broadcast(bounds), [*same, keyed["x"].between(bounds["a"], bounds["b"])]).select("search", "x", "a", "b")
        counts = tallied(within, ["search"], piece(F.col("x"), F.col("a"), F.col("b")))
        ranks = F.element_at(F.create_map(*(F.lit(v) for i, s in enumerate(left) for v in (i, s.rank))), F.col("search"))
        for r in counts.where((F.col("before") <= ranks) & (ranks < F.col("before") + F.col("n"))).collect():  # one for each search
            s = left[r["search"]]
            s.rank, s.low, s.high, s.above = s.rank - r["before"], r["low"], r["high"], s.above if r["above"] is None else r["above"]
            sizes[id(s)] = r["n"]

    def value(s: Search, part: float) -> float:
        after = s.low if s.rank + 1 < sizes[id(s)] or s.above is None else s.above
        return s.low if part == 0 or after == s.low else s.low + (after - s.low) * part

    out = [(*g, [value(s, part) for s, part in some]) for g, some in asked.items()]
    return spark.createDataFrame(out, StructType([*kinds, StructField("values", ArrayType(DoubleType()))]))
