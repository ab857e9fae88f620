"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.tables import join_counted, stored


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Every node links its larger neighbours to the least of itself and its neighbours."""
    around = _both_ways(edges)
    least = stored(around.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n"), "components")
    return join_counted(around.where("b > a"), least, "a", total=2 * total).select(F.col("b").alias("x"), F.col("m").alias("y"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Every node links itself and its smaller neighbours to the least of them. Edges go from x to a smaller y."""
    least = stored(edges.groupBy("x").agg(F.min("y").alias("m"), F.count(F.lit(1)).alias("n")), "components")
    moved = join_counted(edges, least, "x", total=total).where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y"))
    return least.select("x", F.col("m").alias("y")).unionByName(moved)


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b): component is the least node that can be reached. Self-links and
    repeats do no harm; a node without any link to another doesn't appear. Each round is written to the shared folder,
    and rounds end when one changes nothing, which their number of edges and sum of hashes tell."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).distinct()
    edges = stored(edges, "components")
    before = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return edges.select(F.col("x").alias("node"), F.col("y").alias("component")).unionByName(
                edges.select(F.col("y").alias("node"), F.col("y").alias("component")).distinct()
            )
        before = now
        stars = _large_star(edges.select(F.col("x").alias("a"), F.col("y").alias("b")), now[0])
        edges = stored(_small_star(stored(stars.distinct(), "components"), now[0]).distinct(), "components")
