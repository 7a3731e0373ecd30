"""Near-duplicate documents by min-max hashing, with links confirmed on whole shingle sets.

Of every permutation both the smallest and the largest value are kept, so ``PERMUTATIONS`` hash
evaluations per shingle give twice as many signature values. ``BANDS`` bands of ``ROWS`` values
propose pairs: at the threshold of 0.75 a pair shares no band with a probability of 3e-8, at 0.8 of 9e-12. Proposed pairs are confirmed by the exact Jaccard
similarity of their sets of 64-bit shingle hashes.

Documents with equal sets form one class and only classes are compared. In turns, every class is held against one hub: of
the hubs of its bands, one for each, the one that shares most bands with it and is of another component (one
confirmed link per member is enough to join it). A band's hub is the class whose bands hold most classes, so of a group of near
copies the one closest to all others; every turn has other hubs. A turn costs at most one pair a class.
What still shares a band across components is paired by an exact filter: similar sets share one of
their rarest shingles. So large groups cost a number of pairs that grows with their size, and no link
between components is lost.

Words are lower-cased for A-Z only and parted by ASCII white space; shingles are five words, a
shorter document is one shingle, a document without words has none and stays alone. Null texts have
no words. Repeated rows are copies. A null id takes part in links, and is ignored when a component's
smallest id is chosen; of a component of null ids only, the text of the smallest digest is kept. Extra columns are not read. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwatch.llm.common import WordHashes, batches, dense, free_names, may_be, maybe_in, text_bytes, written
from shelfwatch.llm.components import connected

SHINGLE = 5
SIMILAR = 75  # percent
PERMUTATIONS = 160
ROWS = 5
BANDS = 2 * PERMUTATIONS // ROWS
#: Turns in which classes are held against hubs, at most; before the last one they end where under one pair in ``FEW`` is
#: confirmed. All that is left goes through the exact filter, so neither changes a result.
TURNS, FEW = 4, 10
#: Shingles hashed at once: keeps the working set in a core's cache.
STEP = 1024
#: Counters of the shingle frequencies that order prefixes (8 MB).
FREQUENCY_CELLS = 1 << 20

_P = np.uint64(0x9E3779B97F4A7C15)
_RANDOM = np.random.RandomState(20240229)
_FACTOR = (_RANDOM.randint(0, 1 << 31, PERMUTATIONS).astype(np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_SHIFT = _RANDOM.randint(0, 1 << 32, PERMUTATIONS, dtype=np.uint64).astype(np.uint32)[:, None]
_BAND_SEED = _RANDOM.randint(0, 1 << 63, BANDS, dtype=np.uint64)

_hashes: WordHashes | None = None


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a UTF-8 text."""
    global _hashes
    _hashes = _hashes or WordHashes()
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b"\n".join(words), 1)], np.uint64)
    hashed = _hashes(words)
    count = len(words) - SHINGLE + 1
    value = hashed[:count]
    for i in range(1, SHINGLE):
        value = value * _P + hashed[i : i + count]
    return np.unique(_mixed(value))


def signature(values: np.ndarray) -> np.ndarray:
    """Smallest, then largest value under each permutation."""
    small = values.astype(np.uint32)
    low = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    high = np.zeros(PERMUTATIONS, np.uint32)
    for at in range(0, len(small), STEP):
        spread = _FACTOR * small[at : at + STEP]
        spread += _SHIFT
        np.minimum(low, spread.min(1), out=low)
        np.maximum(high, spread.max(1), out=high)
    return np.concatenate((low, high))


def _bands(signatures: np.ndarray) -> np.ndarray:
    parts = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    value = np.broadcast_to(_BAND_SEED, parts.shape[:2])
    for row in range(ROWS):
        value = _mixed(value * _P + parts[:, :, row])
    return value.view(np.int64)


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_shingles, digest, bands) per document; digest and bands are null without words."""

    def sign(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, 4_000_000):
            sets = [shingles(text) for text in batch.column("text").to_pylist()]
            digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            filled = [signature(s) for s in sets if len(s)]
            rows = iter(_bands(np.stack(filled)) if filled else ())
            bands = [next(rows) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_key"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                ],
                names=["doc_id", "text_key", "n_shingles", "digest", "bands"],
            )

    given = docs.select(F.col("doc_id").cast("long"), text_key().alias("text_key"), text_bytes().alias("text"))
    return given.mapInArrow(sign, "doc_id long, text_key binary, n_shingles long, digest binary, bands array<long>")


def text_key() -> Column:
    return F.unhex(F.md5(F.coalesce("text", F.lit(""))))


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cid, text) of the classes ``wanted`` (cid, doc_id, text_key); texts pack tighter than their sets."""
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id")
    near = maybe_in(docs.select(id_, "text"), "id", wanted.select(id_))
    keyed = near.withColumn("text_key", text_key()).join(wanted.select("cid", id_, "text_key"), ["id", "text_key"])
    return keyed.select("cid", text_bytes().alias("text")).dropDuplicates(["cid"])


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose whole shingle sets are similar enough."""
    of_a = maybe_in(texts, "cid", pairs.select(F.col("a").alias("cid"))).select(F.col("cid").alias("a"), F.col("text").alias("of_a"))
    of_b = maybe_in(texts, "cid", pairs.select(F.col("b").alias("cid"))).select(F.col("cid").alias("b"), F.col("text").alias("of_b"))

    def compare(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, of_hub = None, None  # rows come sorted by b
        for batch in batches(source, 8_000_000, "of_a"):
            good = []
            for b, x, y in zip(batch.column("b").to_pylist(), batch.column("of_a"), batch.column("of_b"), strict=True):
                if b != hub:
                    hub, of_hub = b, shingles(y.as_py())
                x = shingles(x.as_py())
                both = len(np.intersect1d(x, of_hub, assume_unique=True))
                good.append(100 * both >= SIMILAR * (len(x) + len(of_hub) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.join(of_a, "a").join(of_b, "b").select("a", "b", "of_a", "of_b").mapInArrow(compare, "a long, b long")


def _alike(n: str, m: str) -> Column:
    """Sizes that allow the wanted similarity."""
    return 100 * F.least(n, m) >= SIMILAR * F.greatest(n, m)


def _still_apart(near: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (band, cid, n, weight, root) of bands that hold classes of several components; ``roots`` (node, root) of linked classes."""
    rooted = near.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    several = rooted.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("top")).where("low < top")
    return written(rooted.join(several.select("band"), "band"), "bands")


def _hub_pairs(apart: DataFrame, tried: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b): each class of ``apart`` (band, cid, n, weight, root) and that hub of another component which shares most bands with it.

    A band's hub is its class of the largest weight that was no hub in the pairs ``tried``; none of those comes again.
    """
    free = apart
    if tried is not None:
        free = apart.join(tried.select(F.col("b").alias("cid")).distinct(), "cid", "left_anti")
    hubs = free.groupBy("band").agg(F.max(F.struct("weight", "cid", "n", "root")).alias("hub"))
    hubs = hubs.select("band", F.col("hub.cid").alias("b"), F.col("hub.n").alias("m"), F.col("hub.root").alias("other"))
    met = apart.join(hubs, "band").where((F.col("root") != F.col("other")) & _alike("n", "m"))
    met = met.groupBy(F.col("cid").alias("a"), "b").agg(F.count(F.lit(1)).alias("shared"))
    if tried is not None:
        both = tried.select("a", "b").union(tried.select(F.col("b").alias("a"), F.col("a").alias("b")))
        met = met.join(both, ["a", "b"], "left_anti")
    return met.groupBy("a").agg(F.max(F.struct("shared", "b"))["b"].alias("b"))


def linked(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signatures of documents, classes (cid, doc_id, text_key, digest, n), links (a, b) with the components of all confirmed ones."""
    signatures = written(signed(docs), "signatures")
    least = F.min(F.struct("doc_id", "text_key"))
    classes = written(
        signatures.where("digest is not null")
        .groupBy("digest", F.col("n_shingles").alias("n"))
        .agg(least.alias("first"), F.min("doc_id").alias("least_id"), F.min("text_key").alias("least_key"))
        .select("digest", "n", "first.doc_id", "first.text_key", "least_id", "least_key", F.monotonically_increasing_id().alias("cid")),
        "classes",
    )
    one = signatures.select("digest", "text_key", F.col("doc_id").alias("id"), "bands").join(
        classes, ["digest", "text_key"]
    )
    bands = one.where(F.col("id").eqNullSafe(F.col("doc_id"))).select("cid", "n", F.explode("bands").alias("band"))
    shared = bands.groupBy("band").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    held = written(maybe_in(bands, "band", shared.select("band")).join(shared, "band"), "shared-bands")
    # The weight of a class counts the classes in its bands: of a group of near copies it is largest next to their common original.
    weights = held.groupBy("cid").agg(F.sum("held").alias("weight"))
    near = written(held.drop("held").join(weights, "cid"), "bands")
    wanted = classes.join(near.select("cid").distinct(), "cid")
    texts = written(_texts(docs, wanted), "class-texts")

    # Each turn holds a class against one hub of another component. Turns that link hardly any end this.
    pairs = written(_hub_pairs(near.withColumn("root", F.col("cid"))), "pairs")
    found, tried = written(_confirmed(pairs, texts), "confirmed"), pairs
    roots = connected(found)
    for _ in range(1, TURNS):
        pairs = written(_hub_pairs(_still_apart(near, roots), tried), "pairs")
        found, tried = written(_confirmed(pairs, texts), "confirmed"), tried.union(pairs)
        roots = connected(_as_links(roots).union(found))
        if found.count() * FEW <= pairs.count():
            break

    # Whatever is still apart goes through an exact filter on its sets.
    apart = _still_apart(near, roots).groupBy("cid").agg(F.first("root").alias("root"))
    rest = written(_prefix_pairs(texts, written(apart, "apart")), "pairs")
    return signatures, classes, written(_as_links(roots).union(_confirmed(rest, texts)), "confirmed")


def _as_links(roots: DataFrame) -> DataFrame:
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b")).where("a <> b")


def _prefix_pairs(texts: DataFrame, apart: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components of ``apart`` (cid, root) that may be similar: none is missed.

    In any fixed order of all shingles, similar sets share one among their first quarters. The order
    here is from rare to frequent, so groups that share long passages without being similar make no pairs.
    A pair comes from the first shingle it shares: all others it shares lie behind that one in both sets, so where
    too few are left there the row is no candidate. Frequencies are counted in ``FREQUENCY_CELLS`` cells; a coarse count changes the order only.
    """
    held = written(maybe_in(texts, "cid", apart.select("cid")).join(apart, "cid"), "apart-texts")

    def tally(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(FREQUENCY_CELLS, np.int64)
        for batch in batches(source, 4_000_000):
            for text in batch.column("text").to_pylist():
                np.add.at(cells, (shingles(text) % np.uint64(FREQUENCY_CELLS)).astype(np.int64), 1)
        used = np.flatnonzero(cells)
        for at in range(0, len(used), 100_000):
            part = used[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(cells[part])], names=["cell", "n"])

    counts = held.select("text").mapInArrow(tally, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("value"))
    table = dense(counts, FREQUENCY_CELLS)
    frequency = texts.sparkSession.sparkContext.broadcast(table)

    def prefixes(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, 4_000_000):
            for cid, root, text in zip(*(batch.column(c).to_pylist() for c in ("cid", "root", "text")), strict=True):
                own = shingles(text)
                often = frequency.value[(own % np.uint64(FREQUENCY_CELLS)).astype(np.int64)]
                length = len(own) - -(-SIMILAR * len(own) // 100) + 1
                first = own[np.lexsort((own, often))[:length]].view(np.int64)
                columns = [np.full(length, x, np.int64) for x in (cid, root, len(own))]
                left = len(own) - np.arange(length)  # this shingle and those behind it
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*columns, left, first)], names=["cid", "root", "n", "left", "shingle"])

    rows = written(held.mapInArrow(prefixes, "cid long, root long, n long, left long, shingle long"), "prefixes")
    other = rows.select("shingle", F.col("cid").alias("b"), F.col("n").alias("m"), F.col("root").alias("other"), F.col("left").alias("rest"))
    pairs = rows.withColumnRenamed("cid", "a").join(other, "shingle")
    enough = (100 + SIMILAR) * F.least("left", "rest") >= SIMILAR * (F.col("n") + F.col("m"))
    return pairs.where((F.col("a") < F.col("b")) & (F.col("root") != F.col("other")) & _alike("n", "m") & enough).select("a", "b").distinct()


def grouped(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, kept) per document."""
    signatures, classes, links = linked(docs)
    rooted = classes.join(connected(links).withColumnRenamed("node", "cid"), "cid", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "cid"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"), F.min("least_key").alias("component_key"))
    named = rooted.join(least, "root").select("digest", "component_id", "component_key")
    plain = signatures.select("doc_id", "text_key", "n_shingles", "digest")
    # Documents without words have no class: kept out of the join, where they would share one key.
    alone = plain.where("digest is null").withColumns({"component_id": F.col("doc_id"), "component_key": F.col("text_key")})
    rows = plain.where("digest is not null").join(named, "digest").unionByName(alone)
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("component_id").isNotNull() | (F.col("text_key") == F.col("component_key")))
    return rows.select("doc_id", "text_key", "n_shingles", "component_id", kept.alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id. Of equal rows one stays."""
    decided = written(grouped(docs).groupBy("doc_id", "text_key").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("rows")), "decisions")
    hashed = lambda id_, key: F.xxhash64(F.coalesce(id_.cast("long"), F.lit(0)), key)
    # Only rows that may be dropped or repeated meet their decision; all others pass where they are.
    touched = decided.where("not kept or rows > 1").select(hashed(F.col("doc_id"), F.col("text_key")).alias("k"))
    maybe = may_be(touched, "k")
    # Names that no column of the input has, in either case of letters.
    key, hash_, may, id_, same_key = free_names(docs, 5)
    keyed = docs.withColumn(key, text_key()).withColumn(hash_, hashed(F.col("doc_id"), F.col(key)))
    marked = keyed.withColumn(may, maybe(hash_))
    kept = decided.where("kept").select(F.col("doc_id").alias(id_), F.col("text_key").alias(same_key))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.col(key) == F.col(same_key))
    once = marked.where(F.col(may)).join(kept, same).dropDuplicates([id_, same_key])
    return marked.where(~F.col(may)).select(*docs.columns).unionByName(once.select(*docs.columns))
