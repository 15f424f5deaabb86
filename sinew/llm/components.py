"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sinew.llm.frames import stored


def _large_star(links: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the smallest node it sees; of `links` a is the larger end, as in the result."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m"))
    return links.join(least, "b").select("a", F.least("b", "m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the smallest of them; a is the larger end here and in the result."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _are_stars(links: DataFrame) -> bool:
    """Whether every larger end has one link, to a node that is no larger end itself."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(links.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not nodes.where("up > 1 OR up = 1 AND down = 1").agg(F.count("*")).first()[0]


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a, b: any ordered type) that is not its component's smallest.

    Rounds end when all links go to roots. Each half of a round is a query of its own, written to the shared folder: no round repeats
    another one's work, and the driver never holds the plan of a whole round, however many there are. Self links and repeated
    links are allowed; an empty table gives an empty table. A node with very many links only takes part in partial aggregations
    and joins that Spark can split.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = stored(links.distinct(), "links")
    while not _are_stars(links):
        links = stored(_large_star(links), "moved")
        links = stored(_small_star(links), "links")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
