"""Connected components of a table of links, by contraction: no node's neighbours are ever gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeglass.llm.common import stage


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` for every node of ``links`` (``a``, ``b``, of one orderable type): the same root for nodes that
    reach each other.

    Each round every node joins its least neighbour, and links become links between those; a star is done after two
    rounds, and the number of nodes at least halves in each round. Links without a, b, or with a = b join nothing.
    """
    links = stage(links.where("a is not null and b is not null").select("a", "b").distinct())
    roots = None
    while True:
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
        if roots is None:
            roots = least
        else:
            known = least.select(F.col("node").alias("root"), F.col("root").alias("next"))
            roots = stage(roots.join(known, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
        a, b = (least.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")) for x in "ab")
        left = links.join(a, "a").join(b, "b").where("root_a != root_b")
        links = stage(left.select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct())
        if links.isEmpty():
            return roots
