"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def _lowest(edges: DataFrame) -> DataFrame:
    """Each node's smallest neighbour or itself; minima are combined before the shuffle."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))


def _are_stars(edges: DataFrame) -> bool:
    """Does every node point at one node that points at none? One pass, sums combined before the shuffle."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionAll(
        edges.select(F.col("v").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up"))
    )
    sums = ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return not sums.agg(F.coalesce(F.max((F.col("down") + F.col("up")) * F.col("down") > 1), F.lit(False))).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); the component is its smallest node.

    Each round rewires neighbours to the smallest node they know of, joins and minima only, and
    writes the edges, until they are stars; rounds grow with the logarithm of a component's size,
    and edges that are stars already need none. A node of very many edges is a skewed join key,
    which adaptive execution splits; none is gathered into a group. Loops, repeated edges and an
    empty table are fine.
    """
    tidy = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    now = materialize(tidy, "components")
    while not _are_stars(now):
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            both.join(_lowest(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        )
        down = large.distinct()
        low = _lowest(down)
        small = (
            down.join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionAll(low.select("u", F.col("m").alias("v")))
            .filter("u <> v")
            .distinct()
        )
        before, now = now, materialize(small, "components")
        release(before)
    # Every node now points at the smallest one of its component.
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
