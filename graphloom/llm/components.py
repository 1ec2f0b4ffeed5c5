"""Connected components of a link table by alternating stars, all in shuffles; nothing of it reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from graphloom.llm.common import written


#: Links that a task of a round takes, about.
TASK_LINKS = 100_000


def _star(edges: DataFrame, large: bool, tasks: int) -> DataFrame:
    """Each node's larger (or smaller) neighbours and itself, linked to the least of the node and all its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else both.where("v < u")
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = near.join(least, "u").where("v > u" if large else "true").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        moved = moved.union(least.select("u", F.col("m").alias("v")))
    moved = moved.where("u <> v")
    return (moved if large else moved.distinct()).coalesce(tasks)


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of the links (u, v): the least node it can reach. Nodes without a link are absent.

    Ends when a large and a small star change nothing; the number of rounds grows with the logarithm of the size. A
    round has as many tasks as its links ask for, which are few in late rounds, and no more than shuffle partitions.
    Self-links and repeated links don't matter; nulls are dropped; no links give no rows.
    """
    seen = Observation()
    edges = written(links.select("u", "v").where("u <> v").distinct().observe(seen, F.count(F.lit(1)).alias("n")))
    tasks = 1 + seen.get["n"] // TASK_LINKS
    before = None
    while True:
        seen = Observation()
        mark = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("mark")
        edges = written(_star(_star(edges, True, tasks), False, tasks).observe(seen, F.count(F.lit(1)).alias("n"), mark))
        state = seen.get["n"], seen.get["mark"]
        if not state[0] or state == before:
            break
        before = state
    labels = edges.groupBy("u").agg(F.min("v").alias("label")).withColumnRenamed("u", "node")
    return written(labels.union(labels.select(F.col("label").alias("node"), "label").distinct()).groupBy("node").agg(F.min("label").alias("label")).coalesce(tasks))
