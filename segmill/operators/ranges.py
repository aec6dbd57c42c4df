"""Running sums over large groups without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from segmill.session import materialize

PARTS = 64


def running_before(df: DataFrame, by: list[str], order: str, value: str, name: str, parts: int = PARTS) -> DataFrame:
    """With the sum of `value` over the rows of the group whose `order` is smaller.

    Rows must be distinct in (by, order). A group is cut at its approximate quantiles into ranges; sums
    run within ranges, and the ranges' totals (at most `parts` rows a group) give what lies before.
    """
    if parts < 2:
        raise ValueError("at least two ranges")
    at = F.array(*[F.lit(k / parts) for k in range(1, parts)])
    bounds = df.groupBy(*by).agg(F.percentile_approx(order, at, 16 * parts).alias("_bounds"))
    x = df.join(bounds, by).withColumn("_range", F.size(F.filter("_bounds", lambda b: b <= F.col(order)))).drop("_bounds")
    totals = x.groupBy(*by, "_range").agg(F.sum(value).alias("_sum"))
    before = F.sum("_sum").over(W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    offsets = totals.select(*by, "_range", F.coalesce(before, F.lit(0.0)).alias("_before"))
    within = F.sum(value).over(W.partitionBy(*by, "_range").orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    y = x.withColumn("_within", F.coalesce(within, F.lit(0.0))).join(offsets, [*by, "_range"])
    return y.withColumn(name, F.col("_before") + F.col("_within")).drop("_range", "_within", "_before")


def index_within(df: DataFrame, by: str, order: str, name: str, size: str, parts: int = PARTS) -> DataFrame:
    """With the row's number from 0 within its group, and the group's size; null is a group too.

    For few groups of many rows: a group is cut at its approximate quantiles into ranges, whose bounds and sizes
    (at most `parts` rows a group) are broadcast, and rows meet by range only. The bounds are written once, as
    quantiles that are approximate differ from one computation to the next, and rows are dealt out and counted by them.
    """
    at = F.array(*[F.lit(k / parts) for k in range(1, parts)])
    x = df.withColumn("_by", F.struct(by))  # a struct of null equals itself
    bounds = materialize(x.groupBy("_by").agg(F.percentile_approx(order, at, 16 * parts).alias("_bounds"), F.count(F.lit(1)).alias(size)))
    x = x.join(F.broadcast(bounds), "_by").withColumn("_range", F.size(F.filter("_bounds", lambda b: b <= F.col(order)))).drop("_bounds")
    before = F.sum("_n").over(W.partitionBy("_by").orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    offsets = x.groupBy("_by", "_range").agg(F.count(F.lit(1)).alias("_n")).select("_by", "_range", F.coalesce(before, F.lit(0)).alias("_before"))
    # A number of partitions of its own, as adaptive execution would merge what is small in bytes.
    x = x.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_by", "_range").join(F.broadcast(offsets), ["_by", "_range"])
    own = F.row_number().over(W.partitionBy("_by", "_range").orderBy(order))
    return x.withColumn(name, F.col("_before") + own - 1).drop("_by", "_range", "_before")
