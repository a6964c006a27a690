"""Connected components by contraction: every round maps each node to its smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moundwork.session import written_once


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the same for all nodes of a component) for every node of ``links`` (a, b).

    A round sends a node to the smallest of itself and its neighbours and replaces both ends of every
    link by what they became; links within one node vanish. The images of linked nodes stay linked,
    so a component is never torn, and every round at least halves its nodes. All tables of a round
    are written to the shared folder. Nodes with very many links are only the target of minima, which
    combine before the shuffle, and of joins that can be split.
    """
    links = written_once(links.where("a <> b").select("a", "b").distinct(), "links")
    rounds = []
    while not links.isEmpty():
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        moved = written_once(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select(
            "node", F.least("node", "least").alias("to")), "moved")
        rounds.append(moved)
        left = links.join(moved.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").select("x", "b")
        ends = left.join(moved.select(F.col("node").alias("b"), F.col("to").alias("y")), "b").select("x", "y")
        links = written_once(ends.where("x <> y").select(
            F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    if not rounds:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    # Later rounds are small, so the maps are put together from the last to the first.
    total = rounds[-1]
    for earlier in reversed(rounds[:-1]):
        later = total.select(F.col("node").alias("to"), F.col("to").alias("end"))
        total = earlier.join(later, "to", "left").select("node", F.coalesce("end", "to").alias("to"))
        total = written_once(total, "roots")
    return total.select("node", F.col("to").alias("root"))
