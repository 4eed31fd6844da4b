"""Connected components of a graph of edges, without collecting any component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakejobs.llm.tables import kept


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); the component is its smallest node.

    Alternates two steps until nothing changes: every node's larger neighbours are tied to the smallest
    node around it, then its smaller ones. Minima are taken per task before they are shuffled, and the
    join of a node with many neighbours is an ordinary join that AQE splits. Paths halve each round.
    """
    links = kept(_ordered(edges))
    seen = _state(links)
    while True:
        links = kept(_small_star(_large_star(links)))
        now = _state(links)
        if now == seen:
            break
        seen = now
    ends = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return ends.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


def _ordered(edges: DataFrame) -> DataFrame:
    """Distinct edges with the larger node first."""
    return edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return _ordered(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    tied = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _ordered(tied.unionByName(least.select("a", F.col("m").alias("b"))))
