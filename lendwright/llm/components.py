"""Connected components of a link table, by repeated contraction.

Each round every node moves to the neighbour that comes first in a hashed order and the links are
rewritten between the nodes that remain. The order changes per round, so that chains shrink by a constant
share. Links and assignments are written to the shared folder after each round; nothing reaches the
driver but the number of links left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lendwright.session import materialize


def components(links: DataFrame) -> DataFrame:
    """(a, b) links to (node, root): the same root for all nodes of a component. NULL ends link nothing."""
    links = links.select(F.col("a"), F.col("b")).where("a <> b")
    links = materialize(links.union(links.select("b", "a")).distinct(), "links")
    assigned = links.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    turn = 0
    while not links.isEmpty():
        order = F.struct(F.xxhash64(F.col("b"), F.lit(turn)), F.col("b"))
        own = F.struct(F.xxhash64(F.col("a"), F.lit(turn)), F.col("a"))
        first = links.groupBy("a").agg(F.min(order).alias("m"))
        moves = materialize(
            first.select(F.col("a").alias("old"), F.when(F.col("m") < own, F.col("m.b")).otherwise(F.col("a")).alias("new")), "moves"
        )
        ends = moves.select(F.col("old").alias("old_b"), F.col("new").alias("new_b"))
        assigned = materialize(
            assigned.join(moves, F.col("root") == F.col("old"), "left").select(
                "node", F.coalesce("new", "root").alias("root")
            ),
            "assigned",
        )
        links = materialize(
            links.join(moves, F.col("a") == F.col("old"))
            .join(ends, F.col("b") == F.col("old_b"))
            .where("new <> new_b")
            .select(F.col("new").alias("a"), F.col("new_b").alias("b"))
            .distinct(),
            "links",
        )
        turn += 1
    return assigned
