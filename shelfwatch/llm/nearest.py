"""Approximate nearest neighbours by inner product: a small-world graph per shard, shard results merged.

Vectors are dealt by a hash of their id into shards of about ``SHARD_ROWS``; each shard's graph is built by one
task and written, vectors and flat neighbour arrays together. Every block of queries meets every
shard, and the best of all shards are merged. How wide a shard is searched is measured there when it is built:
for up to ``TRIAL`` of its rows the answers are held against brute force over the shard. A component that evens out all norms turns the
largest inner product into the smallest distance. Every vector is indexed; nothing is fitted on a sample.

Equal vectors form one class, of which one is indexed: a large group of copies costs one
node, and of each class the smallest ids follow as far as a result can hold them. Scores are computed anew
in double precision on the original vectors.

Vectors that are null, zero, of another length than most, or that hold null or non-finite components
take no part. Rows with a null id are left out. Rows that share an id and vector count once; rows
that share an id only are candidates each. Ties go to the smaller id. Extra columns are not read.
Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwatch.llm.common import written
from shelfwatch.llm.graph_index import GraphIndex

COUNT = 20
SHARD_ROWS = 8_192
QUERY_ROWS = 2_048
#: Widths of the search, the first of which reaches ``RECALL`` for ``TRIAL`` rows of a shard is used there.
WIDTHS = (192, 288, 432, 648, 972, 1458, 2187)
RECALL = 0.96
TRIAL = 128


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) with double components, without what takes no part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long"), v.alias("v")).where("vec_id is not null and v is not null")
    rows = rows.where(finite & F.exists("v", lambda x: x != 0))
    usual = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (usual["d"] if usual else 0))


def _packed(rows: DataFrame, group: str) -> DataFrame:
    """(group, ids, vectors): bounded groups of rows as packed doubles."""

    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("vec_id")
        data = np.stack(part["v"].to_numpy()).astype("<f8")
        return pd.DataFrame({group: [key[0]], "ids": [part["vec_id"].to_numpy("<i8").tobytes()], "vectors": [data.tobytes()]})

    return rows.groupBy(group).applyInPandas(pack, f"{group} int, ids binary, vectors binary")


def fitting_width(graph: GraphIndex, points: np.ndarray, count: int) -> int:
    """The least of ``WIDTHS`` whose answers for evenly chosen rows hold ``RECALL`` of the true ones, else all rows."""
    trial = points[:: max(1, len(points) // TRIAL)][:TRIAL]
    scores = trial @ points.T
    least = np.sort(scores, axis=1)[:, -min(count, len(points))]
    flat = np.column_stack((trial, np.zeros(len(trial)))).astype(np.float32)
    for width in WIDTHS:
        nodes = graph.search(flat, count, width)
        reached = np.take_along_axis(scores, np.maximum(nodes, 0), axis=1) >= least[:, None]
        if ((nodes >= 0) & reached).sum() >= RECALL * len(trial) * min(count, len(points)):
            return width
    return len(points)


def nearest(vectors: DataFrame, is_query: Column, count: int = COUNT, shard_rows: int = SHARD_ROWS, width: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``count`` best candidates found, the query's own row left out."""
    rows = written(usable(vectors).withColumn("is_query", is_query).dropDuplicates(["vec_id", "v"]), "vectors")
    same = Window.partitionBy("v").orderBy("vec_id")
    # The window keeps count + 1 rows of a class in each task before they are shuffled.
    members = written(rows.withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= count + 1), "members")
    classes = members.where("nth = 1").select("vec_id", "v")
    facts = classes.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("top")).first()
    queries = rows.where("is_query")
    shards, blocks = max(1, -(-facts["n"] // shard_rows)), max(1, -(-queries.count() // QUERY_ROWS))
    top = facts["top"] or 0.0

    def index(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for shard, ids, data in zip(*(batch.column(c).to_pylist() for c in ("shard", "ids", "vectors")), strict=True):
                points = np.frombuffer(data, "<f8").reshape(len(ids) // 8, -1)
                rest = np.sqrt(np.maximum(top - (points * points).sum(1), 0))
                graph = GraphIndex.build(np.column_stack((points, rest)).astype(np.float32))
                reach = width or fitting_width(graph, points, count)
                made = ((shard, pa.int32()), (ids, pa.binary()), (data, pa.binary()), (graph.dump(), pa.binary()), (reach, pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in made], names=["shard", "ids", "vectors", "graph", "reach"])

    dealt = classes.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    graphs = written(_packed(dealt, "shard").mapInArrow(index, "shard int, ids binary, vectors binary, graph binary, reach int"), "graphs")
    asked = queries.select("vec_id", "v").withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int"))
    asked = written(_packed(asked, "block").select("block", F.col("ids").alias("query_ids"), F.col("vectors").alias("queries")), "queries")

    def search(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("ids", "vectors", "graph", "reach", "query_ids", "queries")}
                ids, query_ids = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["query_ids"], "<i8")
                points = np.frombuffer(row["vectors"], "<f8").reshape(len(ids), -1)
                wanted = np.frombuffer(row["queries"], "<f8").reshape(len(query_ids), -1)
                flat = np.column_stack((wanted, np.zeros(len(wanted)))).astype(np.float32)
                nodes = GraphIndex.load(row["graph"]).search(flat, count + 1, row["reach"])
                for at in range(0, len(nodes), 512):
                    part = nodes[at : at + 512]
                    place, slot = np.nonzero(part >= 0)
                    node = part[place, slot]
                    score = (points[node] * wanted[at + place]).sum(1)
                    yield pa.RecordBatch.from_arrays([pa.array(query_ids[at + place]), pa.array(ids[node]), pa.array(score)], names=["query_id", "class_id", "score"])

    meet = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    meet = meet.join(graphs, "shard").repartition(min(shards * blocks, 4_096), "shard", "block")
    found = meet.mapInArrow(search, "query_id long, class_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "class_id")
    merged = written(found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= count + 1).drop("r"), "merged")
    # From a class to its members with the smallest ids; the query's own id is no candidate.
    firsts = members.where("nth = 1").select("v", F.col("vec_id").alias("class_id"))
    of_class = members.join(firsts, "v").select("class_id", "vec_id")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    every = merged.join(of_class, "class_id").where("vec_id <> query_id")
    every = every.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= count)
    return every.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
