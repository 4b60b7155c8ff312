"""Connected components of a graph held in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meritgrid.llm.common import remove, stored_at


def _roots(pointers: DataFrame, path: str, rounds: int) -> tuple[DataFrame, str]:
    """Follow pointers to smaller nodes, twice as far each round, until all end at a root."""
    spark = pointers.sparkSession
    for _ in range(rounds):
        ahead = pointers.select(F.col("node").alias("top"), F.col("top").alias("next"))
        jumped = pointers.join(ahead, "top").select(
            "node", F.col("next").alias("top"), (F.col("next") != F.col("top")).alias("moved")
        )
        following, next_path = stored_at(jumped, "cc-pointers")
        moved = following.where("moved").limit(1).count()
        remove(spark, path)
        pointers, path = following.select("node", "top"), next_path
        if not moved:
            return pointers, path
    raise RuntimeError(f"pointers still move after {rounds} rounds")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest node of the component of every node that has an edge: node, component.

    ``edges``: a, b. Each round points every node at its smallest neighbour, follows the pointers to
    their roots and contracts the edges to edges between roots, which soon leaves none. Every table
    is written to the shared folder; the driver only sees whether edges are left.
    """
    spark = edges.sparkSession
    edges, edge_path = stored_at(edges.select("a", "b").where("a <> b").distinct(), "cc-edges")
    labels, label_path = None, None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = both.groupBy("a").agg(F.min("b").alias("b"))
        pointers, path = stored_at(
            nearest.select(F.col("a").alias("node"), F.least("a", "b").alias("top")), "cc-pointers"
        )
        roots, path = _roots(pointers, path, rounds)
        if labels is None:
            labels, label_path = roots.withColumnRenamed("top", "component"), path
        else:
            above = roots.withColumnsRenamed({"node": "component", "top": "above"})
            labels, next_path = stored_at(
                labels.join(above, "component", "left").select(
                    "node", F.coalesce("above", "component").alias("component")
                ),
                "cc-labels",
            )
            remove(spark, label_path)
            label_path = next_path
        first = roots.withColumnsRenamed({"node": "a", "top": "root_a"})
        second = roots.withColumnsRenamed({"node": "b", "top": "root_b"})
        between = edges.join(first, "a").join(second, "b").where("root_a <> root_b")
        contracted, next_path = stored_at(
            between.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct(),
            "cc-edges",
        )
        remove(spark, edge_path)
        if path != label_path:
            remove(spark, path)
        edges, edge_path = contracted, next_path
        if not edges.limit(1).count():
            remove(spark, edge_path)
            return labels
    raise RuntimeError(f"edges are left after {rounds} rounds")
