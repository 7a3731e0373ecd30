"""The search for repeated passages: strings parted among anchors, packed anchors, filters by the number of keys."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from shelfwatch.llm import common, passages


def random_texts(seed, count, size, letters=26):
    random = np.random.RandomState(seed)
    return [bytes(random.randint(97, 97 + letters, size, np.uint8)) for _ in range(count)]


def brute_force(texts):
    seen, out = set(), {}
    for i, data in texts:
        own = [data[j : j + 50] for j in range(len(data) - 49)]
        lost = np.zeros(len(data), bool)
        for j, s in enumerate(own):
            if s in seen:
                lost[j : j + 50] = True
        seen.update(own)
        out[i] = int(lost.sum()), hashlib.sha256(bytes(np.frombuffer(data, np.uint8)[~lost])).hexdigest()
    return out


def test_every_string_has_one_anchor_that_its_bytes_decide():
    for letters in (1, 2, 3, 26):
        texts = [t for k, size in enumerate((0, 49, 50, 51, 90, 400, 1500)) for t in random_texts(10 * letters + k, 2, size, letters)]
        texts.append(random_texts(5, 1, 70)[0] + texts[-1][200:700])
        owner, parted = {}, set()
        for row, first, last, value in zip(*(part.tolist() for part in passages.anchors(texts)), strict=True):
            for start in range(first, last + 1):
                assert (row, start) not in parted
                parted.add((row, start))
                assert owner.setdefault(texts[row][start : start + 50], value) == value
        assert parted == {(i, j) for i, t in enumerate(texts) for j in range(len(t) - 49)}


def test_packed_anchors_are_shared_by_the_same_texts(spark):
    parts = random_texts(2, 30, 300)
    texts = [(i - 15, parts[i] + parts[(i * 7) % 30][:200] + b" " * (i % 3 * 40)) for i in range(30)]
    rows = [(i, t.decode()) for i, t in texts] + [(None, parts[3].decode()), (1 << 62, parts[4].decode()), (-(1 << 62), parts[4].decode() * 2)]
    named = passages._named(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    plain = passages._anchor_rows(named).groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("top")).where("low < top")
    expected = {r["anchor"] for r in plain.collect()}
    for count in (1, 3, 50):
        packed = passages._anchor_rows(named, None, count)
        assert {r["part"] for r in packed.select("part").collect()} <= set(range(count))
        found = [r["anchor"] for r in passages._shared(packed).collect()]
        assert len(found) == len(set(found)) and set(found) == expected and expected


def test_filter_has_bits_for_its_keys():
    for keys in (0, 1, 1_000_000, 2_843_973, 12_000_000):
        bits = common.filter_bits(keys)
        assert bits & (bits - 1) == 0 and bits >= max(common.FILTER_BITS, 32 * keys)
    # Shared anchors of about 6 GB of documents.
    assert 1 - np.exp(-33_000_000 / common.filter_bits(33_000_000)) < 0.07
    assert common.filter_bits(1 << 40) == common.MOST_FILTER_BITS


def test_search_cuts_few_anchors_of_one_text(spark, monkeypatch):
    """Far more shared anchors than a filter of the least size has bits."""
    monkeypatch.setattr(common, "FILTER_BITS", 1 << 8)
    held, filters = [], []
    make, owners = passages.bit_filter, passages._owners
    monkeypatch.setattr(passages, "bit_filter", lambda keys, column, *bits: filters.append((column, bits)) or make(keys, column, *(bits or (1 << 8,))))
    monkeypatch.setattr(passages, "_owners", lambda cuts, *more: held.append(cuts) or owners(cuts, *more))
    shared, own = random_texts(3, 12, 900), random_texts(4, 24, 2500)
    texts = [(i, own[i] + shared[i % 12]) for i in range(24)]
    found = passages.deduplicated(spark.createDataFrame([(i, t.decode()) for i, t in texts], "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in found} == brute_force(texts)
    anchors = held[0].groupBy("anchor").agg(F.countDistinct("id").alias("n")).collect()
    both = sum(r["n"] > 1 for r in anchors)
    assert both > 1 << 8 and len(anchors) - both < 0.2 * both


def test_kept_bytes_are_handed_on_only_when_asked_for(spark):
    texts = [(i, t) for i, t in enumerate([*random_texts(6, 3, 400), b"", b"short", random_texts(6, 3, 400)[1][50:300], b"short"])]
    docs = spark.createDataFrame([(i, t.decode()) for i, t in texts], "doc_id long, text string").coalesce(1)
    rows = passages.deduplicated(docs).collect()
    bare = passages.deduplicated(docs, with_kept=False)
    assert "kept" not in bare.columns
    assert sorted(tuple(r) for r in bare.collect()) == sorted(tuple(r)[:5] for r in rows)
    assert {r["doc_id"]: hashlib.sha256(r["kept"]).hexdigest() for r in rows} == {i: s for i, (_, s) in brute_force(texts).items()}


def test_removal_equals_bytes_one_by_one():
    random = np.random.RandomState(7)
    texts = [*random_texts(8, 5, 300), b"", b"x", *random_texts(9, 2, 1000)]
    ranges = []
    for t in texts:
        pairs = np.sort(random.randint(0, len(t) + 1, (random.randint(0, 6), 2)), axis=1).tolist()
        ranges.append([{"a": a, "b": b} for a, b in pairs] if len(t) % 2 == 0 else None)
    kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
    columns = [pa.array(list(range(len(texts)))), pa.array(texts, pa.binary()), pa.array(ranges, kind)]
    for at, n in ((0, len(texts)), (2, 5)):
        found = passages._removed(*(c.slice(at, n) for c in columns)).to_pylist()
        for r, t, part in zip(found, texts[at : at + n], ranges[at : at + n], strict=True):
            lost = np.zeros(len(t), bool)
            for p in part or ():
                lost[p["a"] : p["b"]] = True
            kept = bytes(np.frombuffer(t, np.uint8)[~lost])
            spans = int((lost & ~np.append(False, lost[:-1])).sum()) if len(t) else 0
            assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept"], r["kept_sha256"]) == (len(t), lost.sum(), spans, kept, hashlib.sha256(kept).hexdigest())


def test_steps_delete_their_shuffles(spark, tmp_path):
    """Between the steps of the search no shuffle is held, and the session's own setting comes back."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    held = tracker.shuffleStatuses().size()
    with common.shuffles_dropped(spark):
        spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().write.parquet(str(tmp_path / "t"))
    assert tracker.shuffleStatuses().size() <= held and spark.conf.get(name) == before
    assert spark.read.parquet(str(tmp_path / "t")).count() == 7
