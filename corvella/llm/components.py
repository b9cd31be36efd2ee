"""Connected components over an edge table, without collecting edges or groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvella.session import materialize


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the least node of every node's component, for edges (a, b) of any direction.

    Alternates two steps until no edge changes (large star and small star): each node hangs its larger neighbours
    on its least neighbour, then its smaller neighbours and itself. An edge lies under its larger node, so a hub, which is
    the least of its neighbours, is aggregated nowhere; where its edges meet what it hangs on, the join has both sides
    shuffled for itself and can be split. Every round is written to the shared folder.
    """
    pairs = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        # large star: for each edge the larger node meets the least neighbour of the smaller, or that itself
        down = materialize(pairs.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), "m"), "edges")
        large = pairs.join(down, pairs["b"] == down["node"], "left").select("a", F.coalesce("m", "b").alias("b")).distinct()
        # small star: for u, neighbours below u and u meet the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        pairs = materialize(small.where("a <> b").distinct(), "edges")
        state = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
