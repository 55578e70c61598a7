"""Connected components of a link table, as joins and aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import discard, materialize


def _large_star(links: DataFrame) -> DataFrame:
    """Point every larger neighbour of a node at the least node around it."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Point a node's smaller neighbours, and itself, at the least of them."""
    least = links.groupBy("a").agg(F.min("b").alias("least"))
    return (
        links.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        .union(least.select("a", F.col("least").alias("b")))
        .filter("a <> b")
    )


def connected_components(links: DataFrame, write: Callable[[DataFrame, str], DataFrame] = materialize) -> DataFrame:
    """(node, root) of every node of ``links(a, b)``; the root is the least node of its component.

    Alternates large-star and small-star rounds until the links are stars; each round is
    written to the shared folder, so lineage stays short and a lost executor costs little.
    Nothing is gathered in one place: only two numbers a round reach the driver. The last round's
    table is written by ``write``.
    """
    down = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    written: list[str] = []
    edges, seen = materialize(down, "links", written), None
    while True:
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == seen or not state.n:
            break
        seen, last = state, written[:]
        edges = materialize(_small_star(_large_star(edges).distinct()).distinct(), "links", written)
        discard(links.sparkSession, last)
        written = written[len(last):]
    edges = write(edges, "stars")
    discard(links.sparkSession, written)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
