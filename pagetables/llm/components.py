"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetables.llm.common import settled


def _hang_on_least(links: DataFrame, only_smaller: bool) -> DataFrame:
    """Every node hands its neighbours to the least node it knows."""
    if only_smaller:
        seen = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    else:
        seen = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = seen.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    told = seen.join(least, "a")
    if not only_smaller:
        told = told.where("b > a")
    hung = told.select(F.col("b").alias("a"), F.col("least").alias("b"))
    if only_smaller:
        hung = hung.unionByName(least.select("a", F.col("least").alias("b")))
    return hung.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in ``links`` (a, b): root is the least node it reaches.

    A round writes its links to the shared folder.  Rounds grow as the logarithm of the
    longest path; a node's neighbours are never gathered in one row.
    """
    links = settled(links.select("a", "b").where("a <> b").distinct(), "links")
    mark = None
    while True:
        now = links.agg(F.count("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return links.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
        mark = now
        links = settled(_hang_on_least(_hang_on_least(links, False), True), "links")
