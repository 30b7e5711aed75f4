"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardwatch.session import remove, stage_at


def _least(edges: DataFrame) -> DataFrame:
    """(node, m): the smallest node that each node hangs onto."""
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node onto the smallest node around it: the smallest it hangs onto, or itself."""
    return edges.join(_least(edges), F.col("b") == F.col("node"), "left").select("a", F.coalesce("m", "b").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours hang onto the smallest of them; the edge to that one stands for the node's own."""
    return edges.join(_least(edges), F.col("a") == F.col("node")).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether no node that hangs onto another has a second edge."""
    ends = F.array(*[F.struct(F.col(c).alias("node"), F.lit(c == "a").alias("hangs")) for c in ("a", "b")])
    found = edges.select(F.explode(ends).alias("e")).select("e.*").groupBy("node").agg(F.bool_or("hangs").alias("hangs"), F.count("*").alias("edges"))
    return found.filter("hangs and edges > 1").count() == 0


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in ``edges`` (a, b); the component is its smallest node.

    Edges run from larger to smaller nodes. Each half of a round writes its
    edges to the shared folder, so that no plan holds more than one join, and
    drops those before; the rounds end when all edges form stars, which
    another round would not change. Null ends and loops are ignored; no edges
    give no rows.
    """
    start = edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, path = stage_at(start, "edges")
    while not _stars(now):
        for star in (_large_star, _small_star):
            old = path
            now, path = stage_at(star(now), "edges")
            remove(edges.sparkSession, old)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
