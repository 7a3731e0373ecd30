"""Packing documents into fixed-length training sequences: first-fit decreasing over a tournament tree.

A document is the ids of its whole text and one end id. Pieces of exactly ``length`` ids fill
sequences alone; the rest of each document, shorter than that, is packed. Rests are dealt at random
(by a hash of id, text and place) into groups of about ``GROUP`` pieces, and each group is packed on
its own: pieces in order of falling length go to the first bin with room, which a tournament tree
over bin capacities finds in log(bins) steps. At most a few bins of a group stay partly empty, so the
padding does not grow with the corpus. No group depends on a document's key, so hot ids or sources
do not matter.

Null and empty texts give one piece, the end id. Rows that share an id are packed as documents of
their own. Equal lengths are ordered by id and place. Texts of any length are cut into as many pieces
as needed. Extra columns are not read. Empty tables give empty results.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwatch.llm.common import batches, partitions_for, text_bytes, written
from shelfwatch.llm.tokens import encoder, vocabulary

LENGTH = 4096
END_ID = 2
#: Pieces that one group holds on average.
GROUP = 8_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, deal long, ids binary"


class TournamentTree:
    """Room left in bins. Each inner node holds the larger room of its two children."""

    def __init__(self, bins: int, capacity: int) -> None:
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def place(self, need: int) -> tuple[int, int]:
        """Put ``need`` into the first bin with room for it: its number and the room it had."""
        room, node = self.room, 1
        while node < self.leaves:
            node *= 2
            if room[node] < need:
                node += 1
        bin_, had = node - self.leaves, room[node]
        room[node] = had - need
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
        return bin_, had


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; ``lengths`` must fall and not exceed ``capacity``."""
    # Two neighbouring bins are never both half empty, so this many bins always do.
    tree = TournamentTree(min(len(lengths), 2 * int(lengths.sum()) // capacity + 2), capacity)
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, need in enumerate(lengths.tolist()):
        bins[i], had = tree.place(need)
        offsets[i] = capacity - had
    return bins, offsets


def pieces(docs: DataFrame, length: int = LENGTH, vocab: str | None = None, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """Rows of ``PIECES``, ``ids`` as little-endian 32-bit numbers: every id of every document in exactly one piece of at most ``length``."""
    path = vocab or vocabulary()

    def cut(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path), np.array([end_id], "<u4").tobytes()
        for batch in batches(source, 2_000_000):
            rows: dict[str, list] = {k.split()[0]: [] for k in PIECES.split(", ")}
            for doc, deal, ids in zip(
                batch.column("doc_id").to_pylist(),
                batch.column("deal").to_pylist(),
                encode(batch.column("text").to_pylist()),
                strict=True,
            ):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, length):
                    part = ids[4 * start : 4 * (start + length)]
                    rows["doc_id"].append(doc)
                    rows["start"].append(start)
                    rows["length"].append(len(part) // 4)
                    rows["ids_crc32"].append(zlib.crc32(part))
                    rows["doc_tokens"].append(total)
                    rows["deal"].append(deal)
                    rows["ids"].append(part if with_ids else None)
            kinds = [pa.int64()] * 6 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True)], list(rows))

    text = docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text"))
    return text.withColumn("deal", F.xxhash64("doc_id", "text")).mapInArrow(cut, PIECES)


def packed(docs: DataFrame, length: int = LENGTH, vocab: str | None = None, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; the offsets of a sequence have no gaps.

    Pieces are written once: their number sets the number of groups.
    """
    spark = docs.sparkSession
    cut = written(pieces(docs, length, vocab, end_id, with_ids), "pieces")
    full = F.col("length") == length
    counts = cut.agg(F.count_if(~full).alias("rest"), F.count(F.lit(1)).alias("all")).first()
    groups = max(1, counts["rest"] // GROUP)
    tasks = min(groups, partitions_for(spark, counts["rest"], 20 * GROUP))
    whole = cut.where(full).select(
        "*",
        # Ids of single-piece sequences are negative, those of packed ones are not.
        (-1 - F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    # The hash of the whole row spreads repeated rows and pieces of one document alike.
    group = F.pmod(F.xxhash64("deal", "start", F.monotonically_increasing_id()), F.lit(groups))
    dealt = cut.where(~full).withColumn("group", group)

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable")
        bins, offsets = first_fit_decreasing(rows["length"].to_numpy(), length)
        return rows.drop(columns="group").assign(sequence_id=key[0] * (1 << 32) + bins, offset=offsets)

    rest = dealt.repartition(tasks, "group").groupBy("group").applyInPandas(pack, f"{PIECES}, sequence_id long, offset long")
    return whole.unionByName(rest).drop("deal")
