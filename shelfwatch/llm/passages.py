"""Removing repeated passages: bytes covered by a ``SPAN``-byte string that starts in an earlier document too.

Earlier means a smaller document id. Candidates come from content-defined anchors: the smallest hash of
``GRAM`` bytes in every stretch of ``SPAN`` bytes, so equal strings have the same anchor, at the same
place. Anchors of one text only are left out. Around every other one the bytes of the strings whose anchor it is
are cut out, equal cuts are counted once with their smallest id, and all cuts of an anchor meet in one shard, unless
they have more than ``SHARD_BYTES``: the strings of such cuts are grouped by their digests, whatever their anchor. In a shard the suffixes
of the shard's cuts are ordered by induced sorting with spilling queues (see ``suffixes``); neighbours that agree in
``SPAN`` bytes are one string, whose smallest document id goes back to its cuts and from there to documents.

Ids are whole numbers; rows that share an id never remove each other's bytes. A null id counts as
larger than all others. Null texts count as empty. Copies of a whole text are settled by a digest and take no part
in the search. Extra columns are not read. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwatch.llm.common import arrow_rows, batches, bit_filter, bit_test, filter_bits, has_bit, maybe_in, shuffles_dropped, written
from shelfwatch.llm.suffixes import sevens, sorted_suffixes

SPAN = 50
GRAM = 20
#: Starts of strings that can share one anchor.
REACH = SPAN - GRAM + 1
#: Bytes of cuts that a task sorts together, whole anchors at a time; twice as many at most.
SHARD_BYTES = 1_000_000
LAST_ID = (1 << 63) - 1
#: Bytes of texts whose anchors are searched at once: keeps the working set in a core's cache.
STEP_BYTES = 64_000
#: Texts that a task of the search hands to Python at once.
STEP_ROWS = 1000
#: Anchors that a task of the search holds before it hands them on, and that one part of them has about.
HELD_ANCHORS = 500_000
PART_ANCHORS = 250_000
#: Bits of an anchor.
ANCHOR_BITS = 48
#: Cuts that a task remembers, so as not to give their bytes again; bounds its memory, changes no result.
MEMO_CUTS = 100_000

def _mixed(data: np.ndarray) -> np.ndarray:
    """A 32-bit hash of each run of ``GRAM`` bytes, five words of four; which of them are smallest decides, not what they are."""
    four = np.ndarray(len(data) - 3, "<u4", data, strides=(1,)) * np.uint32(0x9E3779B1)
    eight = four[:-4] * np.uint32(0x85EBCA77) + four[4:]
    sixteen = eight[:-8] * np.uint32(0xC2B2AE3D) + eight[8:]
    value = sixteen[:-4] * np.uint32(0x27D4EB2F) + four[16:]
    value ^= value >> np.uint32(15)
    value *= np.uint32(0x2C1B3C6D)
    return value


def _names(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A 48-bit hash of the ``GRAM`` bytes from each place."""
    words = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    value = np.zeros(len(places), np.uint64)
    for at in (*range(0, GRAM - 7, 8), GRAM - 8):
        value = (value + words[places + at]) * np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(31)
        value *= np.uint64(0xBF58476D1CE4E5B9)
        value ^= value >> np.uint64(29)
    return (value >> np.uint64(16)).view(np.int64)


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last start of its strings, and 48-bit hash of each anchor.

    Every string of ``SPAN`` bytes of a text is one anchor's alone: that of the smallest hash in it, the
    leftmost of equal ones. So the strings of a text are parted among its anchors.
    """
    found = [(np.zeros(0, np.int64),) * 4]
    begun, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= STEP_BYTES or i + 1 == len(texts):
            row, *rest = _anchors_joined(texts[begun : i + 1])
            found.append((row + begun, *rest))
            begun, size = i + 1, 0
    return tuple(np.concatenate(part) for part in zip(*found, strict=True))


def _anchors_joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``anchors`` of texts laid end to end; what reaches over an end is left out."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < SPAN:
        return (np.zeros(0, np.int64),) * 4
    ends = np.cumsum([len(t) for t in texts])
    # Hash and place in one number: the least of a stretch is its smallest hash, the leftmost of equal ones.
    least = _smallest(_mixed(data).astype(np.uint64) << np.uint64(32) | np.arange(len(data) - GRAM + 1, dtype=np.uint64), REACH)
    over = np.uint64(np.iinfo(np.uint64).max)
    least[_before(ends, SPAN, len(least))] = over
    first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    last = np.append(first[1:], len(least)) - 1
    held = least[first]
    whole = held != over
    first, last, places = first[whole], last[whole], (held[whole] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    row = np.searchsorted(ends, first, side="right")
    opened = np.append(0, ends[:-1])[row]
    return row, first - opened, last - opened, _names(data, places)


def _smallest(values: np.ndarray, size: int) -> np.ndarray:
    """Smallest of each run of ``size`` values."""
    length = 1
    while 2 * length <= size:
        values = np.minimum(values[:-length], values[length:])
        length *= 2
    return np.minimum(values[: len(values) - (size - length)], values[size - length :]) if length < size else values


def _before(ends: np.ndarray, size: int, limit: int) -> np.ndarray:
    """Starts below ``limit`` of runs of ``size`` bytes that reach over one of ``ends``."""
    starts = (ends[:, None] - np.arange(1, size)).ravel()
    return starts[(starts >= 0) & (starts < limit)]


def _named(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit("")).cast("binary")
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))
    return docs.select(F.col("doc_id").cast("long"), id_.alias("id"), text.alias("text"), F.unhex(F.md5(text)).alias("digest")).withColumn("key", F.xxhash64("id", "digest"))


def _without(source: Iterable[pa.RecordBatch], but: Broadcast | None) -> Iterator[pa.RecordBatch]:
    """Rows whose ``key`` has no bit in ``but``."""
    for batch in source:
        yield batch if but is None else batch.filter(pa.array(~has_bit(but.value, batch.column("key").to_numpy())))


def _anchor_rows(texts: DataFrame, but: Broadcast | None = None, parts: int = 0) -> DataFrame:
    """(anchor, id) of each text and each of its anchors, once; texts whose key has a bit in ``but`` are left out.

    With ``parts`` instead (part, anchors, low, span): the anchors of many texts by ranges of anchors, each once with its
    smallest id and the distance to its largest, packed as ``_planes``.
    """

    def mark(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(_without(source, but), 2_000_000):
            row, _, _, hashes = anchors(batch.column("text").to_pylist())
            order = np.lexsort((hashes, row))
            row, hashes = row[order], hashes[order]
            new = np.append(True, (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1]))[: len(row)]
            ids = batch.column("id").to_numpy()[row[new]]
            yield pa.RecordBatch.from_arrays([pa.array(hashes[new], pa.int64()), pa.array(ids, pa.int64())], names=["anchor", "id"])

    def pack(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = np.array([-(-(part << ANCHOR_BITS) // parts) for part in range(parts + 1)], np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches(_without(source, but), 2_000_000):
            row, _, _, hashes = anchors(batch.column("text").to_pylist())
            held.append((hashes, batch.column("id").to_numpy()[row]))
            if sum(len(part[0]) for part in held) >= HELD_ANCHORS:
                yield packed(held, bounds)
                held = []
        if held:
            yield packed(held, bounds)

    def packed(held: list[tuple[np.ndarray, np.ndarray]], bounds: np.ndarray) -> pa.RecordBatch:
        values, ids = (np.concatenate(part) for part in zip(*held, strict=True))
        values, low, top = _extremes(values, ids, ids)
        edges = np.searchsorted(values, bounds)
        used = np.flatnonzero(edges[1:] > edges[:-1])
        rows = [[_planes(column[edges[i] : edges[i + 1]]) for i in used.tolist()] for column in (values, low, top - low)]
        return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *(pa.array(r, pa.binary()) for r in rows)], names=["part", "anchors", "low", "span"])

    if parts:
        return texts.select("id", "key", "text").mapInArrow(pack, "part int, anchors binary, low binary, span binary")
    return texts.select("id", "key", "text").mapInArrow(mark, "anchor long, id long")


def _extremes(values: np.ndarray, low: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each value once, in order, with the least of its ``low`` and the largest of its ``top``."""
    if not len(values):
        return values, low, top
    order = np.argsort(values)
    values = values[order]
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    return values[first], np.minimum.reduceat(low[order], first), np.maximum.reduceat(top[order], first)


def _planes(values: np.ndarray) -> bytes:
    """Longs as all their lowest bytes, then all their next ones and so on: bytes that hardly differ compress well."""
    return values.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _longs(planes: list[bytes]) -> np.ndarray:
    """What ``_planes`` packed, one after the other."""
    return np.concatenate([np.ascontiguousarray(np.frombuffer(p, np.uint8).reshape(8, -1).T).view("<i8").ravel() for p in planes])


def _shared(packed: DataFrame) -> DataFrame:
    """(anchor) of packed ``_anchor_rows`` that texts of different ids have."""

    def settle(held: list[tuple[bytes, bytes, bytes]]) -> pa.RecordBatch:
        values, low, span = (_longs(column) for column in zip(*held, strict=True))
        values, low, top = _extremes(values, low, low + span)
        return pa.RecordBatch.from_arrays([pa.array(values[low < top], pa.int64())], names=["anchor"])

    def meet(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, bytes, bytes]] = []
        open_part = None
        for batch in source:
            for part, *columns in zip(*(batch.column(c).to_pylist() for c in ("part", "anchors", "low", "span")), strict=True):
                if part != open_part and held:
                    yield settle(held)
                    held = []
                open_part = part
                held.append(tuple(columns))
        if held:
            yield settle(held)

    return packed.repartition("part").sortWithinPartitions("part").mapInArrow(meet, "anchor long")


def _cuts(texts: DataFrame, shared: Broadcast, but: Broadcast | None = None) -> DataFrame:
    """(anchor, start, id, key, name, cut): the strings of the anchors whose bit is in ``shared``; ``but`` as above.

    ``cut`` holds them from its first to its last ``SPAN`` bytes, ``start`` is where it begins in its text. A task leaves
    out the bytes of cuts that it gave before for a smaller id and for some other one: the rest tells the smallest
    id of a cut, and whether there is a larger one.
    """

    def cut(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        given: dict[int, tuple[int, int]] = {}
        for batch in batches(_without(source, but), 1_000_000):
            texts = batch.column("text").to_pylist()
            row, first, last, hashes = anchors(texts)
            near = np.flatnonzero(has_bit(table, hashes))
            row, first, last, hashes = row[near], first[near], last[near], hashes[near]
            cuts = [texts[r][a:b] for r, a, b in zip(row.tolist(), first.tolist(), (last + SPAN).tolist(), strict=True)]
            names = [xxhash.xxh3_64_intdigest(c) - (1 << 63) for c in cuts]
            ids, keys = (batch.column(c).to_numpy()[row] for c in ("id", "key"))
            if len(given) > MEMO_CUTS:
                given.clear()
            for i, (name, id_) in enumerate(zip(names, ids.tolist(), strict=True)):
                low, top = given.get(name, (id_, id_))
                if name in given and id_ >= low and (low < top or id_ == low):
                    cuts[i] = None
                else:
                    given[name] = min(low, id_), max(top, id_)
            columns = [pa.array(hashes), pa.array(first), pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(names, pa.int64()), pa.array(cuts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["anchor", "start", "id", "key", "name", "cut"])

    schema = "anchor long, start long, id long, key long, name long, cut binary"
    return texts.select("id", "key", "text").mapInArrow(cut, schema)


def _owners(cuts: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(anchor, name, from, to, owner): strings of a cut, by first and last start, and their smallest document id.

    Anchors of more than ``shard_bytes`` are few: each has a share of all bytes. Their sizes are added up exactly only
    where those of many anchors together reach that.
    """
    given = cuts.where("cut is not null")
    sizes = given.select("anchor", F.octet_length("cut").cast("long").alias("n"))
    cells = 1 << max(16, (8 * (2 * SPAN) * cuts.count() // shard_bytes).bit_length())
    sums = sizes.groupBy(F.pmod("anchor", F.lit(cells)).alias("cell")).agg(F.sum("n").alias("size"))
    large = written(sums.where(F.col("size") > shard_bytes).select("cell"), "hot-cells")
    if large.isEmpty():
        return _sorted_owners(given, shard_bytes)
    close = sizes.withColumn("cell", F.pmod("anchor", F.lit(cells))).join(F.broadcast(large), "cell", "left_semi")
    hot = close.groupBy("anchor").agg(F.sum("n").alias("size")).where(F.col("size") > shard_bytes).select("anchor")
    hot = F.broadcast(written(hot, "hot-anchors"))
    return _sorted_owners(given.join(hot, "anchor", "left_anti"), shard_bytes).unionByName(_string_owners(given.join(hot, "anchor", "left_semi")))


def _string_owners(given: DataFrame) -> DataFrame:
    """``_owners`` without sorting: one row per string of a cut, grouped by its 128-bit digest."""

    def spread(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, 300_000, "cut"):
            row, offset, digest = [], [], []
            for i, cut in enumerate(batch.column("cut").to_pylist()):
                for at in range(len(cut) - SPAN + 1):
                    row.append(i)
                    offset.append(at)
                    digest.append(xxhash.xxh3_128_digest(cut[at : at + SPAN]))
            held = [batch.column(c).take(pa.array(row, pa.int64())) for c in ("anchor", "name", "least", "most")]
            yield pa.RecordBatch.from_arrays(
                [*held, pa.array(offset, pa.int32()), pa.array(digest, pa.binary())], names=["anchor", "name", "least", "most", "first", "digest"]
            )

    # Summed by task before each shuffle; a string that most cuts hold is a row per task.
    distinct = given.groupBy("anchor", "name", "cut").agg(F.min("id").alias("least"), F.max("id").alias("most"))
    strings = written(distinct.mapInArrow(spread, "anchor long, name long, least long, most long, first int, digest binary"), "strings")
    held = strings.groupBy("digest").agg(F.min("least").alias("owner"), F.max("most").alias("top"))
    # Written, so that the join sits on two plain shuffles and a hot string's part can be split.
    owner = written(held.where("owner < top").drop("top"), "string-owners")
    found = strings.join(owner, "digest").where("most > owner")
    return found.select("anchor", "name", "first", F.col("first").alias("last"), "owner")


def _sorted_owners(given: DataFrame, shard_bytes: int) -> DataFrame:
    """``_owners`` by sorting the suffixes of whole anchors; none has more than ``shard_bytes``."""

    def settle(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        # The filter lets anchors of one text through too.
        anchor, smallest, most = (rows.column(c).to_numpy() for c in ("anchor", "least", "most"))
        first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        several = np.minimum.reduceat(smallest, first) < np.maximum.reduceat(most, first)
        if not several.any():
            return
        rows = rows.filter(pa.array(np.repeat(several, np.diff(np.append(first, len(anchor))))))
        cuts = pa.concat_arrays([chunk.cast(pa.binary()) for chunk in rows.column("cut").chunks])
        bounds = np.frombuffer(cuts.buffers()[1], np.int32)[cuts.offset : cuts.offset + len(cuts) + 1].astype(np.int64)
        sizes = np.diff(bounds)
        closed = np.cumsum(sizes + 1)
        opened = closed - sizes - 1
        symbols = np.zeros(int(closed[-1]), np.uint16)
        inside = np.ones(len(symbols), bool)
        inside[closed - 1] = False
        symbols[inside] = np.frombuffer(cuts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]].astype(np.uint16) + 1
        anchor, name, smallest, most = (rows.column(c).to_numpy() for c in ("anchor", "name", "least", "most"))
        cut_at = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes + 1)
        # Starts of whole strings.
        asked = np.arange(len(symbols)) <= np.repeat(closed - 1 - SPAN, sizes + 1)
        order = sorted_suffixes(symbols, SPAN, wanted=asked)
        order = order[asked[order]]
        if not len(order):
            return
        packed = sevens(symbols)
        same = np.arange(1, len(order))
        for at in (*range(0, SPAN - 7, 7), SPAN - 7):  # neighbours that agree so far
            same = same[packed[order[same] + at] == packed[order[same - 1] + at]]
        first = np.ones(len(order), bool)
        first[same] = False
        least = np.minimum.reduceat(smallest[cut_at[order]], np.flatnonzero(first))
        owners = np.zeros(len(symbols), np.int64)
        owners[order] = least[np.cumsum(first) - 1]
        place = np.flatnonzero(asked)
        owner = owners[place]
        new = np.append(True, (place[1:] != place[:-1] + 1) | (owner[1:] != owner[:-1]))
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(new)) - 1
        row = cut_at[place[at]]
        keep = most[row] > owner[at]  # some holder of the cut comes later
        at, last, row = at[keep], last[keep], row[keep]
        columns = [anchor[row], name[row], (place[at] - opened[row]).astype(np.int32), (place[last] - opened[row]).astype(np.int32), owner[at]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "name", "first", "last", "owner"])

    def sort(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, previous = 0, None
        for batch in source:
            if not batch.num_rows:
                continue
            anchor = batch.column("anchor").to_numpy()
            opens = np.flatnonzero(np.append(anchor[0] != previous, anchor[1:] != anchor[:-1]))
            sizes = pc.binary_length(batch.column("cut")).to_numpy().astype(np.int64)
            before, begun = np.cumsum(sizes) - sizes, 0  # bytes of the batch before each row, first row not settled
            while len(full := opens[(opens >= begun) & (size + before[opens] >= shard_bytes)]):
                held.append(batch.slice(begun, int(full[0]) - begun))
                yield from settle(pa.Table.from_batches(held))
                held, begun, size = [], int(full[0]), -int(before[full[0]])
            held.append(batch.slice(begun))
            size, previous = size + int(sizes.sum()), anchor[-1]
        if held:
            yield from settle(pa.Table.from_batches(held))

    # Tasks gave few rows of a cut each, so one shuffle serves the counting and the shards.
    distinct = given.repartition("anchor").groupBy("anchor", "name", "cut").agg(F.min("id").alias("least"), F.max("id").alias("most"))
    shards = distinct.sortWithinPartitions("anchor")
    return shards.mapInArrow(sort, "anchor long, name long, first int, last int, owner long")


class Copies:
    """Tells later copies of whole texts apart by keys alone, so that texts need no shuffle for it.

    ``likely`` holds of every later copy, and of few other rows. Of those others ``doubt`` holds, and of few
    later copies. Rows with both are settled by an exact join, whatever their number.
    """

    def __init__(self, named: DataFrame) -> None:
        sized = named.select("id", "key", "digest", F.octet_length("text").cast("long").alias("n"))
        names = written(sized.withColumn("d", F.xxhash64("digest")), "names")
        least = names.groupBy("digest", "d").agg(F.min("id").alias("least"), F.max("id").alias("most"))
        #: Bytes of all texts.
        self.size = names.agg(F.sum("n")).first()[0] or 0
        copied = written(least.where("least < most").drop("most"), "copies")
        found = maybe_in(names, "d", copied.select("d")).join(copied.drop("d"), "digest").where("id > least")
        self.later = written(found.select("key", "n").distinct(), "later")
        #: No text without a bit here is a later copy.
        self.bits = bit_filter(self.later.select("key"), "key")
        self._likely = bit_test(self.bits)
        wrong = names.select("key").where(self._likely("key")).join(self.later.select("key"), "key", "left_anti")
        self.doubts = bit_filter(written(wrong, "not-later"), "key")
        self._doubt = bit_test(self.doubts)

    def marked(self, named: DataFrame) -> DataFrame:
        """``named`` with ``state``: 0 no later copy, 1 a later copy, 2 to be settled."""
        tests = named.withColumn("likely", self._likely("key")).withColumn("doubt", self._doubt("key"))
        state = F.when(~F.col("likely"), 0).when(~F.col("doubt"), 1).otherwise(2)
        return tests.withColumn("state", state).drop("likely", "doubt")

    def unsettled(self) -> DataFrame:
        """(key, n) of later copies in state 2."""
        return self.later.where(self._doubt("key"))


def spans(named: DataFrame, copies: Copies) -> DataFrame:
    """(key, ranges) of texts that lose bytes, without copies in state 1; ranges ``a`` to ``b`` may overlap."""
    marked = copies.marked(named).select("id", "key", "text", "state")
    # The few texts in state 2 are stored, so that no task of the search has a second Python worker.
    settled = marked.where("state = 2").join(copies.unsettled().select("key"), "key", "left_anti").drop("state")
    settled = written(settled, "settled")
    with arrow_rows(named.sparkSession, STEP_ROWS):
        # The other texts, state 0, are told apart where they are searched.
        parts = -(-2 * copies.size // ((REACH + 1) * PART_ANCHORS)) or 1
        rows = _anchor_rows(named, copies.bits, parts).unionByName(_anchor_rows(settled, None, parts))
        # Stored, so that the filter has bits for their number: what a full one lets through is cut and shuffled in vain.
        both = written(_shared(rows), "shared-anchors")
        shared = bit_filter(both, "anchor", filter_bits(both.count()))
        cuts = written(_cuts(named, shared, copies.bits).unionByName(_cuts(settled, shared)), "cuts")
        shared.unpersist()
    found = written(_owners(cuts), "owners")
    # Most shared cuts lose bytes, so a filter by name would spare little.
    lost = cuts.drop("cut").join(found, ["anchor", "name"]).where("id > owner")
    span = F.struct((F.col("start") + F.col("first")).alias("a"), (F.col("start") + F.col("last") + SPAN).alias("b"))
    whole = copies.unsettled().where(F.col("n") >= SPAN).select("key", F.struct(F.lit(0).cast("long").alias("a"), F.col("n").alias("b")).alias("span"))
    return lost.select("key", span.alias("span")).unionByName(whole).groupBy("key").agg(F.collect_list("span").alias("ranges"))


RESULTS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts end to end, and where each begins and the last ends."""
    texts = texts.cast(pa.binary())
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    return data, bounds - bounds[0]


def _results(docs: pa.Array, sizes: np.ndarray, n_spans: np.ndarray, data: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
    """``RESULTS`` and ``kept`` of texts of ``sizes`` bytes, of which ``data`` from each of ``bounds`` to the next remains."""
    view, ends = memoryview(np.ascontiguousarray(data)), bounds.tolist()
    sums = [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)]
    kept = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(view)])
    columns = [docs, pa.array(sizes), pa.array(sizes - np.diff(bounds)), pa.array(n_spans.astype(np.int64)), pa.array(sums, pa.string()), kept]
    return pa.RecordBatch.from_arrays(columns, names=[*(c.split()[0] for c in RESULTS.split(", ")), "kept"])


def _removed(docs: pa.Array, texts: pa.Array, ranges: pa.Array) -> pa.RecordBatch:
    """``RESULTS`` of texts without the bytes of their ranges; a null or empty list removes nothing."""
    data, bounds = _joined(texts)
    lengths = ranges.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    spans, opened = ranges.flatten(), np.repeat(bounds[:-1], lengths)
    gone = np.zeros(len(data) + 1, np.int32)
    for field, change in (("a", np.add), ("b", np.subtract)):
        change.at(gone, opened + spans.field(field).to_numpy(zero_copy_only=False), 1)
    lost = np.cumsum(gone[:-1], dtype=np.int32) > 0
    starts = lost.copy()
    starts[1:] &= ~lost[:-1]
    first = bounds[:-1][bounds[:-1] < bounds[1:]]
    starts[first] = lost[first]
    before = lambda flags: np.append(0, np.cumsum(flags, dtype=np.int32))[bounds]
    return _results(docs, np.diff(bounds), np.diff(before(starts)), data[~lost], before(~lost))


def _whole(docs: pa.Array, texts: pa.Array, copies: np.ndarray) -> pa.RecordBatch:
    """``RESULTS`` of texts that stay as they are, but for ``copies`` of at least ``SPAN`` bytes, which go whole."""
    data, bounds = _joined(texts)
    sizes = np.diff(bounds)
    gone = copies & (sizes >= SPAN)
    kept = data[~np.repeat(gone, sizes)] if gone.any() else data
    return _results(docs, sizes, gone, kept, np.append(0, np.cumsum(np.where(gone, 0, sizes))))


def deduplicated(docs: DataFrame, with_kept: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) per document; ``kept`` is what remains, as bytes.

    Without ``with_kept`` these bytes are hashed as well, but not handed on.
    """
    named = _named(docs)
    with shuffles_dropped(docs.sparkSession):
        copies = Copies(named)
        ranges = written(spans(named, copies), "ranges")
    # Only texts that may lose some of their bytes are shuffled; the others are told apart where their bytes are
    # counted, so that no task has a second Python worker.
    losing, likely, doubts = bit_filter(ranges.select("key"), "key"), copies.bits, copies.doubts

    def sides(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which rows are settled as later copies, and which may have ranges."""
        copy = has_bit(likely.value, keys) & ~has_bit(doubts.value, keys)
        return copy, ~copy & has_bit(losing.value, keys)

    @F.pandas_udf("boolean")
    def maybe(key: pd.Series) -> pd.Series:
        return pd.Series(sides(key.to_numpy(np.int64))[1])

    def asked_for(found: pa.RecordBatch) -> pa.RecordBatch:
        return found if with_kept else found.drop_columns(["kept"])

    def remove(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, 1_000_000):
            yield asked_for(_removed(*(batch.column(c) for c in ("doc_id", "text", "ranges"))))

    def whole(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, 1_000_000):
            copy, apart = sides(batch.column("key").to_numpy())
            rows = pa.array(np.flatnonzero(~apart))
            if len(rows):
                yield asked_for(_whole(batch.column("doc_id").take(rows), batch.column("text").take(rows), copy[~apart]))

    asked = named.select("doc_id", "key", "text")
    # As a deterministic one the test would be made on the ranges too.
    lossy = asked.where(maybe.asNondeterministic()("key")).join(ranges, "key", "left").select("doc_id", "text", "ranges")
    schema = RESULTS + ", kept binary" * with_kept
    return asked.mapInArrow(whole, schema).unionByName(lossy.mapInArrow(remove, schema))
