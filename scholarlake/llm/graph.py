"""Connected components by contraction; nothing but row counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarlake.llm.common import materialize, release


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node of its component) for every node of edges (a long, b long).

    In each round every node moves to its least neighbour, or stays if it is less than all of them; moves are followed to
    their ends by doubling (a rising chain of n nodes takes log n joins); edges are redrawn between these ends, the local
    minima, until none are left. Least neighbours are combined before the shuffle; the joins that redraw edges leave a
    node with very many of them to the runtime's splitting of skewed partitions.
    """
    proper = edges.where("a <> b")
    left = materialize(proper.select("a", "b").unionByName(proper.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    moves = []
    while True:
        move = materialize(left.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("to")), "moves")
        while True:
            onward = move.where("to <> node").select(F.col("node").alias("to"), F.col("to").alias("end"))
            further = move.join(onward, "to", "left")
            if further.where("end IS NOT NULL").isEmpty():
                break
            move = materialize(further.select("node", F.coalesce("end", "to").alias("to")), "moves")
        moves.append(move)
        at = lambda end: move.select(F.col("node").alias(end), F.col("to").alias(f"to_{end}"))  # noqa: B023, E731
        redrawn = left.join(at("a"), "a").join(at("b"), "b").where("to_a <> to_b")
        left = materialize(redrawn.select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).distinct(), "edges")
        release(edges.sparkSession)
        if left.isEmpty():
            break
    found = moves[0].select("node", F.col("to").alias("component"))
    for move in moves[1:]:
        step = move.select(F.col("node").alias("component"), "to")
        found = found.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return materialize(found, "components")
