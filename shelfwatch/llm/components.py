"""Connected components of a link table, by alternating large-star and small-star steps.

Each step moves links only; the number of rounds grows with the logarithm of the longest chain. Every
round is written to the shared folder, so a lost executor costs no earlier round. Tasks and files of a round
follow the number of its links, not the session's shuffle partitions: a few links cost a few small files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwatch.llm.common import written

#: Links that a task of a round holds, about.
LINKS_EACH = 100_000


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())


def connected(links: DataFrame) -> DataFrame:
    """(node, root) of every node with a link to another; ``root`` is the smallest node reachable.

    ``links`` has long columns ``a`` and ``b``; direction, repeats and loops do not matter.
    """
    links = written(links.select("a", "b").where("a <> b"), "links")
    state = _state(links)
    while state[0]:
        tasks = 1 + state[0] // LINKS_EACH
        links = written(_small_star(_large_star(links).coalesce(tasks)).coalesce(tasks), "links")
        before, state = state, _state(links)
        if state == before:
            break
    roots = links.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
