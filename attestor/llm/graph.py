"""Connected components by alternating large and small stars (Kiveris et al., 2014), all as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.common import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root for each node of links; root is the smallest node that can be reached.

    Links with a null end and loops are left out. Groups are aggregated before they are shuffled, and joins on a hub are
    such that Spark can split them. Each round is written to the shared folder.
    """
    u, v = F.greatest(a, b), F.least(a, b)
    edges = stored(links.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(u.alias("u"), v.alias("v")).distinct(), "edges")
    while not _flat(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.union(low.select("u", F.col("m").alias("v"))).filter("u != v").distinct(), "edges")
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def _flat(edges: DataFrame) -> bool:
    """Whether each component is a star around its smallest node: no node has two links downwards, and none has links both ways. A round
    leaves such links as they are, so that one more needn't be run to see it."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down + up > 1 and down > 0").isEmpty()


def contracted(comp: DataFrame) -> DataFrame:
    """What components() gave, as links (a, b): with them in the place of the links that it was made of, links that come later take fewer rounds."""
    return comp.filter("node != root").select(F.col("node").alias("a"), F.col("root").alias("b"))
