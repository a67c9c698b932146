"""Connected components by alternating stars (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014).

Each round is two grouped minima with map-side combine and two joins on node ids; a hub with any number of links costs no more than its
links, since the joined side has one row per node. Rounds end when the links are stars, which is found without one more round; between rounds the links are
written to the shared folder, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tripscope.llm.common import written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Relinks each node's larger (or not larger) neighbours to the smallest node it knows; links may repeat."""
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a")))
    lowest = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    joined = both.filter("b > a" if large else "b < a").join(lowest, "a")
    if large:
        relinked = joined.select(F.col("b").alias("x"), F.col("m").alias("y"))
    else:
        relinked = joined.select(F.explode(F.array("b", "a")).alias("x"), F.col("m").alias("y"))
    return relinked.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _are_stars(links: DataFrame) -> bool:
    """Whether each node either is a centre or has one link, to a smaller centre."""
    centre, point = links.select(F.col("a").alias("node"), F.lit(1).alias("centre"), F.lit(0).alias("points")), links.select("b", F.lit(0), F.lit(1))
    roles = centre.union(point).groupBy("node").agg((F.max("centre") + F.sum("points")).alias("roles"))
    return not roles.filter("roles > 1").limit(1).count()


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every node of ``links(a, b)``; the component is its smallest node."""
    now = written(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    while not _are_stars(now):
        now = written(_star(_star(now, True), False).distinct(), "links")
    # The centre of a star is its smallest node.
    return now.select(F.col("b").alias("id"), F.col("a").alias("component")).union(now.select(F.col("a"), F.col("a"))).distinct()
