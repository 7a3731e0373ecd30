"""Repeated passages of words by seed and extend: winnowed anchors are joined, matches extended both ways, and what reaches the least length is removed.

Of every window of ``LEAST`` words the smallest hash of ``SEED`` consecutive words inside is its anchor, so equal
windows share an anchor at the same place, and one anchor in a text stands for a run of neighbouring windows.
Anchors that occur once in the corpus match nothing. The others are extended: the words from
the first to the last window of an anchor's run are its context. Occurrences with the same context match as far as
the run reaches on both sides. Where an anchor has several contexts, each context is held against all others of
the anchor by every way of sharing the missing words out between left and right; the outermost shared ones
give how far the longest matches reach. Touching and overlapping matches of a text join to maximal repeats.

No pairs of occurrences are made: contexts are counted once however often they occur, and rows grow with the
number of words. Texts with equal words and white space are one text, whose copies are known to repeat each other. Anchor
and window hashes are compared together, 128 bits; contexts are 128 bits with their anchor.

Words are parted by ASCII white space and compared unchanged. Null and empty texts have no words. Repeated rows
are copies of each other, so all of them lose their repeats. Null ids are kept. Extra columns are not read. Empty tables give
empty results. A text of any length is read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwatch.llm.common import WordHashes, batches, maybe_in, text_bytes, written

#: Words of the shortest repeat.
LEAST = 35
#: Words of an anchor.
SEED = 12
#: Bits of a filter of text ids: some for each id, within bounds (128 kB to 64 MB).
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 29

_BASE = 0xD6E8FEB86659FD93  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPAN = "array<struct<start:int,stop:int>>"

_hashes: WordHashes | None = None


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


def smallest_places(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the first smallest value of every ``width`` consecutive ones."""
    place, reach = np.arange(len(values)), 1

    def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.where(values[right] < values[left], right, left)

    while 2 * reach <= width:
        place, reach = joined(place[:-reach], place[reach:]), 2 * reach
    rest = width - reach
    return joined(place[: len(place) - rest], place[rest:]) if rest else place


class Seeds:
    """Anchors of a batch of texts (lists of words) and hashes of any run of words in them."""

    def __init__(self, texts: list[list[bytes]], least: int, seed: int) -> None:
        global _hashes
        _hashes = _hashes or WordHashes()
        counts = np.array([len(t) for t in texts], np.int64)
        begins = np.cumsum(counts) - counts
        hashed = _hashes([w for t in texts for w in t])
        size = len(hashed)
        powers = np.full(max(size, 1), _BASE, np.uint64)
        powers[0] = 1
        back = np.full(max(size, 1), _INVERSE, np.uint64)
        back[0] = 1
        self.back = np.cumprod(back)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashed * np.cumprod(powers)[:size])))
        windows = np.maximum(0, counts - least + 1)
        starts = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows - begins, windows)
        if not len(starts):
            self.text = self.first = self.last = np.zeros(0, np.int64)
            self.anchor = self.context = np.zeros(0, np.uint64)
            return
        grams = hashed[: size - seed + 1]
        for i in range(1, seed):
            grams = grams * np.uint64(_BASE) + hashed[i : size - seed + 1 + i]
        grams = _mixed(grams)
        place = smallest_places(grams, least - seed + 1)[starts]
        # Places never fall, so the windows of one anchor follow each other.
        new = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        self.first, self.last = starts[new], starts[np.append(new[1:], len(starts)) - 1]
        place = place[new]
        self.anchor = grams[place]
        shape = (place - self.first) * 4096 + (self.last - self.first)
        self.context = _mixed(self.words(self.first, self.last + least) + shape.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.text = np.searchsorted(begins, self.first, side="right") - 1
        # Texts without words begin where the next one does.
        self.begins = begins

    def words(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hashes of the words from ``start`` to before ``stop``, wherever they are."""
        return (self.sums[stop] - self.sums[start]) * self.back[start]


def texts_once(docs: DataFrame) -> DataFrame:
    """(tid, text_key, text, copies) of every different text, written."""
    keyed = docs.select(text_key().alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))
    once = keyed.groupBy("text_key").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    return written(once.select(F.monotonically_increasing_id().alias("tid"), "text_key", "text", "copies"), "texts")


def text_key() -> Column:
    return F.unhex(F.md5(F.coalesce("text", F.lit(""))))


def _arrow(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v.view(np.int64) if v.dtype == np.uint64 else v) for v in columns.values()], list(columns))


def anchors(texts: DataFrame, least: int = LEAST, seed: int = SEED) -> DataFrame:
    """(anchor, context, tid, first, last): every anchor, and the starts of the first and last window it stands for."""

    def scan(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, 4_000_000):
            found = Seeds([t.split() for t in batch.column("text").to_pylist()], least, seed)
            if len(found.first):
                tid, begin = batch.column("tid").to_numpy()[found.text], found.begins[found.text]
                first, last = ((v - begin).astype(np.int32) for v in (found.first, found.last))
                yield _arrow({"anchor": found.anchor, "context": found.context, "tid": tid, "first": first, "last": last})

    return texts.select("tid", text_bytes().alias("text")).mapInArrow(scan, "anchor long, context long, tid long, first int, last int")


def _windows(texts: DataFrame, contexts: DataFrame, least: int, seed: int) -> DataFrame:
    """(anchor, context, n, nth, window): hashes of every window of ``contexts`` (anchor, context, n, tid)."""
    wanted = contexts.groupBy("tid").agg(F.collect_list(F.struct("anchor", "context", "n")).alias("wanted"))
    near = _among(texts.select("tid", text_bytes().alias("text")), wanted).join(wanted, "tid")

    def scan(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, 4_000_000):
            found = Seeds([t.split() for t in batch.column("text").to_pylist()], least, seed)
            lists = batch.column("wanted")
            owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            parts = lists.flatten()
            anchor, context, n = (parts.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            # Of several occurrences in the text the first one stands for the context.
            key = lambda text, a, c: _mixed(_mixed(a.view(np.uint64)) + text.astype(np.uint64)) + c.view(np.uint64)
            have = key(found.text, found.anchor, found.context)
            order = np.argsort(have, kind="stable")
            at = order[np.searchsorted(have[order], key(owner, anchor, context))]
            runs = found.last[at] - found.first[at] + 1
            nth = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
            start = np.repeat(found.first[at], runs) + nth
            columns = {k: np.repeat(v, runs) for k, v in (("anchor", anchor), ("context", context), ("n", n))}
            yield _arrow({**columns, "nth": nth.astype(np.int32), "window": _mixed(found.words(start, start + least))})

    return near.mapInArrow(scan, "anchor long, context long, n long, nth int, window long")


def _among(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """Texts that may be among ``ids``; spares the others the shuffle of the join that follows."""
    bits = LEAST_BITS
    while bits < MOST_BITS and bits < BITS_EACH * ids.count():
        bits *= 2
    return maybe_in(texts, "tid", ids.select("tid"), bits)


def repeats(texts: DataFrame, least: int = LEAST, seed: int = SEED) -> DataFrame:
    """(tid, start, stop) of words that repeated windows cover; matches of neighbouring anchors overlap."""
    if not 0 < seed <= least or least - seed >= 4096:
        raise ValueError("an anchor is shorter than the least repeat, by under 4096 words")
    seeds = written(anchors(texts, least, seed), "anchors")
    shared = seeds.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), (F.min("context") < F.max("context")).alias("mixed"))
    # Written tables on both sides of a join: the rows of a hot key can be split between tasks.
    shared = written(shared.where("n > 1").select("anchor", "mixed"), "shared-anchors")
    found = written(seeds.join(shared, "anchor"), "seeds")
    mixed = found.where("mixed")
    contexts = written(mixed.groupBy("anchor", "context").agg(F.count(F.lit(1)).alias("n"), F.min("tid").alias("tid")), "contexts")
    windows = written(_windows(texts, contexts, least, seed), "windows")
    twice = written(windows.groupBy("anchor", "window").agg(F.sum("n").alias("total")).where("total > 1").drop("total"), "shared-windows")
    reach = windows.where("n = 1").join(twice, ["anchor", "window"]).groupBy("anchor", "context").agg(F.min("nth").alias("low"), F.max("nth").alias("high"))
    # A context that occurs twice matches over all its windows.
    whole = contexts.where("n > 1").select("anchor", "context", F.lit(None).cast("int").alias("low"), F.lit(None).cast("int").alias("high"))
    reach = written(reach.unionByName(whole), "reach")
    edges = mixed.join(reach, ["anchor", "context"]).select("tid", (F.col("first") + F.coalesce("low", F.lit(0))).alias("start"), F.coalesce(F.col("first") + F.col("high"), F.col("last")).alias("last"))
    inner = found.where("not mixed").select("tid", F.col("first").alias("start"), "last")
    return inner.unionByName(edges).select("tid", "start", (F.col("last") + least).alias("stop"))


def merged(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping and touching spans joined, in order."""
    order = np.argsort(starts, kind="stable")
    starts, stops = starts[order], np.maximum.accumulate(stops[order])
    new = np.append(True, starts[1:] > stops[:-1])
    return starts[new], stops[np.append(np.flatnonzero(new)[1:], len(starts)) - 1]


def deduplicated(docs: DataFrame, least: int = LEAST, seed: int = SEED, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept_sha256, kept) per document.

    ``spans`` are the maximal repeats as word numbers, ``kept`` the words left, joined by one space (null unless ``with_text``).
    """
    texts = texts_once(docs)
    spans = repeats(texts, least, seed).groupBy("tid").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    spans = written(spans, "spans")
    nothing = F.lit(None).cast(_SPAN)
    plain = texts.where("copies = 1").select("tid", "text_key", "text")
    # Texts with copies lose all windows, whatever else they share.
    settled = texts.where("copies > 1").select("tid", "text_key", "text", nothing.alias("spans"), F.lit(True).alias("whole"))
    touched = _among(plain, spans).join(spans, "tid").select(*plain.columns, "spans", F.lit(False).alias("whole"))
    untouched = plain.join(spans.select("tid"), "tid", "left_anti").select(*plain.columns, nothing.alias("spans"), F.lit(False).alias("whole"))
    given = settled.unionByName(touched).unionByName(untouched).select("text_key", F.col("text").cast("binary").alias("text"), "spans", "whole")
    schema = f"text_key binary, n_words long, n_removed long, spans {_SPAN}, kept_sha256 string, kept string"

    def remove(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, 8_000_000):
            rows: list[tuple] = []
            for text, own, whole in zip(batch.column("text").to_pylist(), batch.column("spans"), batch.column("whole").to_pylist(), strict=True):
                words = text.split()
                start, stop = np.zeros(0, np.int64), np.zeros(0, np.int64)
                if whole and len(words) >= least:
                    start, stop = np.array([0]), np.array([len(words)])
                elif own.is_valid:
                    start, stop = merged(*(own.values.field(i).to_numpy() for i in (0, 1)))
                bounds = [0, *np.stack((start, stop), 1).ravel().tolist(), len(words)]
                left = b" ".join([w for i in range(0, len(bounds), 2) for w in words[bounds[i] : bounds[i + 1]]])
                places = [{"start": i, "stop": j} for i, j in zip(start.tolist(), stop.tolist(), strict=True)]
                rows.append((len(words), int((stop - start).sum()), places, hashlib.sha256(left).hexdigest(), left if with_text else None))
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])), pa.string()]
            kept = pa.array(columns[4], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("text_key"), *(pa.array(c, k) for c, k in zip(columns[:4], kinds, strict=True)), kept],
                names=["text_key", "n_words", "n_removed", "spans", "kept_sha256", "kept"],
            )

    results = written(given.mapInArrow(remove, schema), "results")
    return docs.select(F.col("doc_id").cast("long"), text_key().alias("text_key")).join(results, "text_key").drop("text_key")
