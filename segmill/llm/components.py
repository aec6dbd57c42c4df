"""Connected components of links, by alternating star contraction on DataFrames.

Each round turns the links of a node towards its smallest neighbour, first for the larger
neighbours (large star), then for the smaller ones (small star); the number of rounds grows with the
logarithm of the longest path. Minima are partial aggregates, so a node with very many links is
counted before the shuffle; no list of neighbours is ever gathered. Each round's links are written
to the shared folder, so a lost executor costs no more than the round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmill.session import materialize

ROUNDS = 60


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Links come as (larger, smaller)."""
    low = links.groupBy("a").agg(F.min("b").alias("m"))
    return (
        links.join(low, "a")
        .select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
        .select("x.*")
        .filter("a <> b")
        .distinct()
    )


def components(links: DataFrame) -> DataFrame:
    """(node, component) for all nodes that have a link, from rows (a, b); component is the smallest
    node that can be reached. Links to itself and repeated links change nothing."""
    links = materialize(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    )
    before = None
    for _ in range(ROUNDS):
        # Each star reads a table twice; planned as one they would make four readings and their joins.
        links = materialize(_small_star(materialize(_large_star(links))))
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    roots = links.select(F.col("b").alias("node")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component")))
