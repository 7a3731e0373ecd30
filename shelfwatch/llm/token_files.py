"""Token counts of documents in flat, unindexed token files.

A token file is nothing but 16-bit little-endian ids, each document ended by the end id; the end id
never occurs inside a document. ``export`` writes such files, ``scan`` counts in any such files. The
scan cuts files into blocks of ``BLOCK`` ids, finds the end ids of a block by one vectorised
comparison, and stitches documents that cross blocks by a prefix scan over one row per block: ends
before a block give the running number of its first document, the last end before it gives the ids
that this document already has. Blocks carry counts only, never ids.

A written file holds ``FILE_DOCS`` documents at most; a file read by ``scan`` must fit Spark's
limit for one binary value (2 GB). Ids after the last end of a file are a document that
is not closed: it is counted with ``closed`` false. Empty files have no documents.

Null texts are empty: no ids
but the end. Rows that share an id are documents of their own. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwatch.llm.common import batches, written
from shelfwatch.llm.tokens import vocabulary
from shelfwatch.session import scratch_path

#: Ids of one block.
BLOCK = 1 << 17
#: Documents of one file at most.
FILE_DOCS = 10_000
END_ID = 2

_PROCESSORS: dict[str, sentencepiece.SentencePieceProcessor] = {}


def _processor(path: str) -> sentencepiece.SentencePieceProcessor:
    if path not in _PROCESSORS:
        _PROCESSORS[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _PROCESSORS[path]


def export(docs: DataFrame, folder: str, vocab: str | None = None, end_id: int = END_ID, file_docs: int = FILE_DOCS) -> None:
    """Write token files below ``folder``, documents in the order of ``docs``, without a shuffle."""
    path = vocab or vocabulary("piece_bpe_32k.model")

    def encode(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor = _processor(path)
        for batch in batches(source, 2_000_000):
            found = []
            for ids in processor.encode(batch.column("text").to_pylist(), num_threads=1):
                array = np.array(ids, "<u2")
                if (array == end_id).any():
                    raise ValueError("a text contains the end id")
                found.append(array.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["ids"])

    rows = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(encode, "ids binary")
    # The text writer puts out a value's bytes as they are and then the separator: here, the end id.
    (
        rows.select(F.col("ids").cast("string").alias("value"))
        .write.option("lineSep", end_id.to_bytes(2, "little").decode())
        .option("maxRecordsPerFile", file_docs)
        .text(folder)
    )


def scan(spark: SparkSession, folder: str, end_id: int = END_ID, block: int = BLOCK) -> DataFrame:
    """(path, ordinal, start, n_tokens, closed) of each document; ends are not counted as tokens."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    width = F.lit(2 * block)
    last = F.floor((F.col("length") - 1) / width).cast("int")
    blocks = (
        files.where("length > 0")
        .select("path", "content", F.explode(F.sequence(F.lit(0), last)).alias("block"))
        .select("path", "block", F.substring("content", F.col("block") * width + 1, width).alias("ids"))
    )

    def ends(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            places, sizes = [], []
            for value in batch.column("ids"):
                ids = np.frombuffer(value.as_py(), "<u2")
                places.append(np.flatnonzero(ids == end_id).astype(np.int32))
                sizes.append(len(ids))
            yield pa.RecordBatch.from_arrays(
                [batch.column("path"), batch.column("block"), pa.array(sizes, pa.int32()), pa.array(places, pa.list_(pa.int32()))],
                names=["path", "block", "size", "ends"],
            )

    parts = blocks.mapInArrow(ends, "path string, block int, size int, ends array<int>")
    first = F.col("block").cast("long") * block
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy("path")
    stitched = parts.withColumn("first", first).select(
        "path",
        "first",
        "ends",
        F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).alias("ordinal"),
        F.coalesce(F.max(F.col("first") + F.array_max("ends") + 1).over(before), F.lit(0)).alias("opened"),
        (F.col("first") + F.col("size")).alias("stop"),
        (F.max("first").over(total) == F.col("first")).alias("is_last"),
    )
    # Ends as file offsets; the last block also closes what no end closes, if anything is left.
    places = F.transform("ends", lambda e: e + F.col("first"))
    after = F.coalesce(F.try_element_at(places, F.lit(-1)) + 1, F.col("opened"))
    openings = F.concat(F.array("opened"), F.transform(places, lambda e: e + 1))
    docs = F.zip_with(places, F.slice(openings, F.lit(1), F.size(places)), lambda e, o: F.struct(o.alias("start"), e.alias("stop"), F.lit(True).alias("closed")))
    rest = F.when(
        F.col("is_last") & (after < F.col("stop")),
        F.array(F.struct(after.alias("start"), F.col("stop").alias("stop"), F.lit(False).alias("closed"))),
    ).otherwise(F.array().cast("array<struct<start:bigint,stop:bigint,closed:boolean>>"))
    return stitched.select("path", "ordinal", F.posexplode(F.concat(docs, rest)).alias("nth", "doc")).select(
        "path",
        (F.col("ordinal") + F.col("nth")).cast("long").alias("ordinal"),
        F.col("doc.start").alias("start"),
        (F.col("doc.stop") - F.col("doc.start")).alias("n_tokens"),
        F.col("doc.closed").alias("closed"),
    )


def counts(docs: DataFrame, stored: bool = True, file_docs: int = FILE_DOCS) -> DataFrame:
    """(doc_id, file, ordinal, start, n_tokens): documents exported to token files and counted there.

    A document's file and place follow from its place in ``docs``, which must therefore be a plain
    read of stored files; anything else is written first, with ``stored`` false. Should the files
    hold other numbers of documents than ``docs``, it is an error.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    docs = docs if stored else written(docs, "token-docs")
    folder = scratch_path(docs.sparkSession, "token-files")
    export(docs, folder, file_docs=file_docs)
    # part-<partition>-<unique id>-c<number of the file in this partition>
    part = lambda pattern: F.regexp_extract("path", pattern, 1).cast("long")
    file = part("/part-(\\d+)-") * (1 << 31) + part("-c(\\d+)\\.[^/]*$")
    found = scan(docs.sparkSession, folder).withColumn("file", file)
    place = F.monotonically_increasing_id() % (1 << 33)
    named = docs.select(
        "doc_id",
        (F.spark_partition_id().cast("long") * (1 << 31) + F.floor(place / file_docs)).alias("file"),
        (place % file_docs).alias("ordinal"),
    )
    both = named.join(found, ["file", "ordinal"], "full")
    exact = F.when(F.col("n_tokens").isNotNull() & F.col("closed"), F.col("n_tokens"))
    lost = F.raise_error(F.lit("token files and documents differ")).cast("long")
    return both.select("doc_id", "file", "ordinal", "start", F.coalesce(exact, lost).alias("n_tokens"))
