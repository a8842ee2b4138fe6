"""Exact order statistics by distributed selection, for whole tables and by group.

Equal values of a group are counted first (combined before the shuffle, so a value that most rows hold is one row per
task). Counts by bins, BINS of them over the group's range on a logarithmic scale, tell which bin holds each rank; the bin is
cut into BINS bins again over the values that are there, and only the distinct values of the last bin are sorted, by group
and rank. No task sees all distinct values of a group, and no map grows with them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 4096


def value_counts(rows: DataFrame, value: Column, by: Sequence[str] = ()) -> DataFrame:
    """g (struct of the group's columns), x (double), c: how often each value that is not null stands in its group."""
    group = F.struct(*[F.col(b) for b in by]) if by else F.struct(F.lit(0).alias("all"))
    return rows.select(group.alias("g"), value.cast("double").alias("x")).filter("x is not null").groupBy("g", "x").agg(F.count("*").alias("c"))


def _scale(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def _bin(x: Column, low: Column, high: Column) -> Column:
    """0 to BINS - 1 within the finite range, -1 for minus infinity, BINS and BINS + 1 for infinity and NaN."""
    inside = F.when(high > low, F.least(F.floor((x - low) / (high - low) * BINS), F.lit(BINS - 1))).otherwise(0)
    return F.when(F.isnan(x), BINS + 1).when(x == float("inf"), BINS).when(x == float("-inf"), -1).otherwise(inside).cast("int")


def _hits(bins: DataFrame, targets: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The bin that holds each target's place, and the place within it."""
    upto = F.sum("c").over(Window.partitionBy(*keys).orderBy(name))
    ends = bins.withColumn("upto", upto).withColumn("from", F.col("upto") - F.col("c"))
    return targets.join(ends, keys).filter((F.col("place") >= F.col("from")) & (F.col("place") < F.col("upto"))).withColumn("place", F.col("place") - F.col("from")).drop("c", "from", "upto")


def at_ranks(counts: DataFrame, ranks: Column) -> DataFrame:
    """g, rank, value: the values at the places (from 0, in ascending order) that ranks, an array over n, names for every group."""
    finite = F.when(~F.isnan("x") & (F.abs("x") < float("inf")), _scale(F.col("x")))
    groups = counts.groupBy("g").agg(F.sum("c").alias("n"), F.min(finite).alias("low"), F.max(finite).alias("high"))
    placed = counts.join(groups.select("g", "low", "high"), "g").withColumn("bin", _bin(_scale(F.col("x")), F.col("low"), F.col("high"))).drop("low", "high")
    first = placed.groupBy("g", "bin").agg(F.sum("c").alias("c"), F.min("x").alias("low"), F.max("x").alias("high"))
    targets = groups.select("g", F.explode(F.array_distinct(ranks)).alias("rank")).withColumn("place", F.col("rank"))
    hit = _hits(first, targets, ["g"], "bin")
    inside = placed.join(hit.select("g", "bin", "rank", "low", "high"), ["g", "bin"]).withColumn("part", _bin(F.col("x"), F.col("low"), F.col("high"))).select("g", "rank", "part", "x", "c")
    second = inside.groupBy("g", "rank", "part").agg(F.sum("c").alias("c"))
    hit = _hits(second, hit.select("g", "rank", "place"), ["g", "rank"], "part")
    left = inside.join(hit, ["g", "rank", "part"])
    upto = F.sum("c").over(Window.partitionBy("g", "rank").orderBy("x"))
    return left.withColumn("upto", upto).filter((F.col("place") < F.col("upto")) & (F.col("place") >= F.col("upto") - F.col("c"))).select("g", "rank", F.col("x").alias("value"))


def quantiles(counts: DataFrame, shares: Sequence[float], by: Sequence[str] = (), names: Sequence[str] | None = None) -> DataFrame:
    """The group's columns and a column per share: the quantile, interpolated between its neighbours. Groups without values are not there."""
    names = list(names or [f"q{i}" for i in range(len(shares))])
    at = [F.lit(float(s)) * (F.col("n") - 1) for s in shares]
    ranks = F.array(*[f(a).cast("long") for a in at for f in (F.floor, F.ceil)])
    sizes = counts.groupBy("g").agg(F.sum("c").alias("n"))
    found = at_ranks(counts, ranks).groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("v"))  # two entries per share
    low = lambda a: F.element_at("v", F.floor(a).cast("long"))
    high = lambda a: F.element_at("v", F.ceil(a).cast("long"))
    mixed = [F.when(F.floor(a) == F.ceil(a), low(a)).otherwise((F.ceil(a) - a) * low(a) + (a - F.floor(a)) * high(a)).alias(n) for a, n in zip(at, names)]
    return sizes.join(found, "g").select(*[F.col(f"g.{b}").alias(b) for b in by], *mixed)
