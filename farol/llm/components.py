"""Connected components by alternating stars; links stay distributed, each round is a staged table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farol.llm.common import Stages


def _hook(edges: DataFrame, wide: bool) -> DataFrame:
    """Point the neighbours of every node to its least neighbour: the greater ones (wide), or the lesser ones and itself.

    Least neighbours are pre-aggregated before the shuffle; the join back may be split where a node is hot.
    """
    ends = edges.select("a", "b")
    if wide:
        ends = ends.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        ends = ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = ends.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
    pairs = ends.join(least, "a")
    if wide:
        out = pairs.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        out = pairs.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(
            least.select("a", F.col("low").alias("b")))
    return out.where("a != b").distinct()


def components(edges: DataFrame, stages: Stages, name: str) -> DataFrame:
    """``edges`` (a, b) -> (node, label): every node of an edge with the least node of its component.

    An empty table gives an empty one; loops and repeated edges do no harm.
    """
    current = stages.put(f"{name}-0", edges.where("a != b").select("a", "b").distinct())
    before, turn = None, 0
    while True:
        mark = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == before:
            return current.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
                current.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
        before, turn = tuple(mark), turn + 1
        current = stages.put(f"{name}-{turn}", _hook(_hook(current, True), False))
        stages.drop(f"{name}-{turn - 1}")
