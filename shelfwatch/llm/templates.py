"""Dropping lines of templates that recur across documents, by a fixed-depth template tree.

A line of at least ``LEAST_TOKENS`` tokens falls through a tree of fixed depth: first its number of
tokens, then its ``LEADING`` first tokens, tokens with a digit read as a variable field. At a leaf
that lines of several different texts reach, a token stays fixed at its place if enough
(text, line) occurrences at this leaf have it there; other places are variable fields. A line's
template is what results. It is made twice, enough being ``texts`` and one more: the first tells values that
two texts share by chance from fields, the second does not take them for fixed. A template is recurring if at
least ``FIXED`` of its places (and ``LEAST_TOKENS``) are fixed and as many different texts as made it hold it.

Lines with too few fixed places, such as rows of numbers, and lines of fewer tokens recur as whole lines only, digits
included, if they have a letter: from ``texts`` different texts on, lines of fewer than ``LEAST_TOKENS`` tokens
from ``short_texts`` on.

Recurring lines are dropped from every text but the first, that
of the smallest document id, and there all lines stay. Equal whole lines have equal templates, and templates made
with ``texts`` are refined ones of the others, so one text keeps a line of each. Copies of one text count as one text and keep
or lose the same lines, so copies of a document remain copies.

The tree is built from counts, not by walking lines one after another: the result does not depend on
the order of lines, frequent lines collapse into one row before tokens are spread out, and no leaf is
gathered anywhere. Only lines that share a leaf with other texts are spread out into tokens.

Null texts count as empty and stay empty; lines without a token are never dropped. Ties in document ids
are settled by a digest of the text. Repeated rows are copies. Extra columns pass through; ``n_lines``
and ``n_dropped`` are replaced. Empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwatch.llm.common import batches, bit_filter, free_names, has_bit, may_be, text_bytes, written

LEAST_TOKENS = 4
LEADING = 3
#: Share of places that must be fixed in a recurring template.
FIXED = 0.7
#: Different texts that make a leaf, a fixed token, a template or a whole line recur.
TEXTS = 2
#: The same for whole lines of fewer than ``LEAST_TOKENS`` tokens.
SHORT_TEXTS = 6
FIELD = b"<*>"
#: Lines, and bytes of text or lines, that a task of the tree's first step holds at once; they change no result.
STEP_ROWS = 16_384
STEP_BYTES = 2_000_000


_DIGIT = re.compile(rb"[0-9]")
_LETTER = re.compile(rb"[A-Za-z\x80-\xff]")
_LINES = "text_key binary, doc_id long, line_no int, leaf long, line_hash long, whole long, line string"


def _key() -> Column:
    return F.unhex(F.md5(F.coalesce("text", F.lit(""))))


def _long(data: bytes) -> int:
    value = xxhash.xxh3_64_intdigest(data)
    return value - (1 << 64) if value >> 63 else value


def _tree_lines(text: bytes) -> Iterator[tuple[int, int, int, int | None, bytes]]:
    """(number, leaf, hash of the masked line, hash of the whole line or None, masked line) of the lines that enter the tree."""
    for number, raw in enumerate(text.split(b"\n")):
        tokens = raw.split()
        letter = _LETTER.search(raw) is not None
        if len(tokens) >= LEAST_TOKENS or tokens and letter:
            line = b" ".join(tokens)
            hashed = whole = _long(line)
            if len(tokens) >= LEAST_TOKENS and _DIGIT.search(raw):
                tokens = [FIELD if _DIGIT.search(t) else t for t in tokens]
                line = b" ".join(tokens)
                hashed = _long(line)
            leaf = _long(b" ".join([b"%d" % len(tokens), *tokens[:LEADING]]))
            yield number, leaf, hashed, whole if letter else None, line


def leaves(docs: DataFrame) -> DataFrame:
    """(text_key, leaf): the leaves that lines of each text reach; a long text may name one more than once."""

    def reached(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, STEP_BYTES):
            keys: list[bytes] = []
            found: list[int] = []
            for key, text in zip(batch.column("text_key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = {leaf for _, leaf, *_ in _tree_lines(text)}
                keys += [key] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.int64())], names=["text_key", "leaf"])

    return docs.select(_key().alias("text_key"), text_bytes().alias("text")).mapInArrow(reached, "text_key binary, leaf long")


def lines(docs: DataFrame, wanted: Broadcast) -> DataFrame:
    """Rows of ``_LINES``: each line at a leaf of the filter ``wanted``, with fields masked and white space evened.

    ``whole`` is a hash of the line without masks, null where no letter is in it. Short lines are not masked.
    """
    names = [c.split()[0] for c in _LINES.split(", ")]
    kinds = [pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
        may = pa.array(has_bit(wanted.value, np.array(columns[names.index("leaf")], np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names).filter(may)

    def parse(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches(source, STEP_BYTES):
            for key, doc, text in zip(*(batch.column(c).to_pylist() for c in ("text_key", "doc_id", "text")), strict=True):
                for line in _tree_lines(text):
                    rows.append((key, doc, *line))
                    size += len(line[-1])
                    if len(rows) >= STEP_ROWS or size >= STEP_BYTES:
                        yield as_batch(rows)
                        rows, size = [], 0
        yield as_batch(rows)

    given = docs.select(_key().alias("text_key"), F.col("doc_id").cast("long"), text_bytes().alias("text"))
    return given.mapInArrow(parse, _LINES)


def _shared(rows: DataFrame, key: str, texts: int) -> DataFrame:
    """Keys that at least ``texts`` different texts have."""
    held = rows.select(key, "text_key").distinct().groupBy(key).agg(F.count(F.lit(1)).alias("texts"))
    return held.where(F.col("texts") >= texts).select(key)


def recurring(docs: DataFrame, texts: int = TEXTS, short_texts: int = SHORT_TEXTS) -> DataFrame:
    """(text_key, line_no) of the lines to drop, each once."""
    # Texts are read twice, so lines alone at their leaf are never written. The few that the filter lets
    # through make no recurring template.
    near = written(lines(docs, bit_filter(_shared(leaves(docs), "leaf", texts), "leaf")), "leaf-lines")
    # One row per different line; a line that most texts hold is summed before the shuffle. Its hash implies its leaf.
    uses = near.select("line_hash", "text_key").distinct().groupBy("line_hash").agg(F.count(F.lit(1)).alias("uses"))
    distinct = near.groupBy("line_hash").agg(F.min("line").alias("line"), F.min("leaf").alias("leaf")).join(uses, "line_hash")
    # A spot is a token at its place of a leaf, as one hash: what is shuffled is two longs and a small number a token.
    tokens = written(
        distinct.select("line_hash", "uses", "leaf", F.posexplode(F.split("line", " ")).alias("place", "token"))
        .select("line_hash", "uses", (F.col("token") == FIELD.decode()).alias("masked"), F.xxhash64("leaf", "place", "token").alias("spot")),
        "tokens",
    )
    fixed = tokens.where("not masked").groupBy("spot").agg(F.sum("uses").alias("support")).where(F.col("support") >= texts)
    kept = tokens.drop("masked").join(fixed, "spot", "left")
    # The one exchange by line carries spots, not the wider states of the sums below.
    level = F.when(F.col("support") > texts, texts + 1).otherwise(texts)
    is_fixed = F.col("support").isNotNull()
    kept = kept.select(
        "line_hash", "uses", F.when(is_fixed, F.col("spot")).alias("spot"), F.when(is_fixed, level).alias("level")
    ).repartition("line_hash")
    # A group is one line. Spots are unique in it, so two sums of their hashes name the template.
    levels = (texts, texts + 1)
    enough = {t: F.col("level") >= t for t in levels}
    parsed = kept.groupBy("line_hash").agg(
        *[
            F.bit_xor(F.when(enough[t], F.xxhash64(F.lit(seed), "spot"))).alias(f"t{t}_{seed}")
            for t in levels for seed in (1, 2)
        ],
        *[F.count(F.when(enough[t], True)).alias(f"fixed{t}") for t in levels],
        F.first("uses").alias("uses"),
        F.count(F.lit(1)).alias("n"),
    )
    long_line = F.col("n") >= LEAST_TOKENS
    strong = {t: long_line & (F.col(f"fixed{t}") >= LEAST_TOKENS) & (F.col(f"fixed{t}") >= FIXED * F.col("n")) for t in levels}
    names = [
        F.when(strong[t], F.struct(F.xxhash64(F.lit(t), "n", f"t{t}_1", f"t{t}_2").alias("template"), F.lit(t).alias("need")))
        for t in levels
    ]
    # What equal whole lines share is in their template already, if that is a strong one.
    need = F.when(long_line, F.lit(texts)).otherwise(F.lit(short_texts))
    whole = F.when(~strong[texts] & (F.col("uses") >= need), need)
    named = parsed.select("line_hash", F.array_compact(F.array(*names)).alias("names"), whole.alias("need"))
    named = near.drop("line").join(named.where("size(names) > 0 or need is not null"), "line_hash")
    as_whole = F.when(F.col("whole").isNotNull() & F.col("need").isNotNull(), F.struct(F.xxhash64(F.lit(0), "leaf", "whole").alias("template"), "need"))
    every_name = F.concat("names", F.array_compact(F.array(as_whole)))
    held = written(named.select("text_key", "doc_id", "line_no", F.inline(every_name)), "templates")
    first = held.groupBy("template").agg(F.min(F.struct("doc_id", "text_key"))["text_key"].alias("first_key"))
    texts_of = held.select("template", "need", "text_key").distinct().groupBy("template", "need").agg(F.count(F.lit(1)).alias("texts"))
    again = texts_of.where("texts >= need").select("template").join(first, "template")
    return held.join(again, "template").where("text_key <> first_key").select("text_key", "line_no").distinct()


def without_recurring(docs: DataFrame, texts: int = TEXTS) -> DataFrame:
    """``docs`` with shortened ``text``, matching ``n_chars`` if there is such a column, ``n_lines`` and ``n_dropped``."""
    plain = docs.drop("n_lines", "n_dropped")
    key, lost, rest_of, hash_, may = free_names(plain, 5)
    gone = recurring(docs, texts).groupBy("text_key").agg(F.collect_list("line_no").alias(lost))
    gone = written(gone, "dropped-lines").withColumnRenamed("text_key", key)
    # Only texts that may lose a line are shuffled to meet their lines; all others pass where they are.
    maybe = may_be(gone.select(F.xxhash64(key).alias("k")), "k")
    keyed = plain.withColumn(key, _key()).withColumn(hash_, F.xxhash64(key)).withColumn(may, maybe(hash_))
    alone = keyed.where(~F.col(may)).withColumn(lost, F.lit(None).cast("array<int>"))
    marked = keyed.where(may).join(gone, key, "left").unionByName(alone)

    @F.pandas_udf("string")
    def rest(source: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts_, gone_ in source:
            yield pd.Series([_rest(t, g) for t, g in zip(texts_, gone_, strict=True)], dtype=object)

    shape = marked.withColumns(
        {
            "n_lines": F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long"),
            "n_dropped": F.coalesce(F.size(lost), F.lit(0)).cast("long"),
            # Texts that lose nothing do not leave the JVM.
            rest_of: rest(F.when(F.col(lost).isNotNull(), F.col("text")), lost),
        }
    ).withColumn("text", F.when(F.col(lost).isNull(), F.col("text")).otherwise(F.col(rest_of)))
    if "n_chars" in plain.columns:
        length = F.char_length("text").cast(plain.schema["n_chars"].dataType)
        shape = shape.withColumn("n_chars", F.when(F.col("n_dropped") > 0, length).otherwise(F.col("n_chars")))
    return shape.select(*plain.columns, "n_lines", "n_dropped")


def _rest(text: str | None, gone: Iterable[int] | None) -> str | None:
    if text is None or gone is None:
        return None
    dropped = set(gone)
    return "\n".join(line for i, line in enumerate(text.split("\n")) if i not in dropped)
