"""Seed and extend against every window of every text."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from shelfwatch.llm import catalog, repeats

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def brute_force(texts, least=35):
    split = [WORD.findall(t or "") for t in texts]
    counts = Counter(tuple(own[i : i + least]) for own in split for i in range(len(own) - least + 1))
    rows = []
    for own in split:
        lost = np.zeros(len(own), bool)
        for i in range(len(own) - least + 1):
            if counts[tuple(own[i : i + least])] > 1:
                lost[i : i + least] = True
        kept = " ".join(w for w, gone in zip(own, lost, strict=True) if not gone)
        rows.append((len(own), int(lost.sum()), hashlib.sha256(kept.encode()).hexdigest()))
    return rows


def results(df):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect()}


def test_query_equals_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    found = results(catalog.QUERIES["op13_repeated_words"](spark, data))
    expected = dict(zip([r["doc_id"] for r in docs], brute_force([r["text"] for r in docs]), strict=True))
    assert found == expected and any(0 < r[1] < r[0] for r in expected.values())


@pytest.mark.parametrize("least, seed", [(5, 2), (4, 4), (6, 1)])
def test_texts_of_few_different_words(spark, least, seed):
    """Hundreds of matches per anchor, of other texts and of the same one, on either side only."""
    random = np.random.RandomState(least)
    texts = [" ".join(map(str, random.randint(0, 3, random.randint(0, 60)))) for _ in range(40)]
    texts += ["7 " * 50, texts[3], "", None, "1 2"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert results(repeats.deduplicated(docs, least, seed)) == dict(enumerate(brute_force(texts, least)))


def test_edges_of_passages(spark):
    """Matches end a few words after, or before, an anchor, each with another text."""
    word = lambda kind, n: [f"{kind}{i}" for i in range(n)]
    passage = word("p", 60)
    texts = [
        [*word("a", 30), *passage, *word("b", 9)],
        [*word("c", 3), *passage[:40]],
        [*passage[22:], *word("d", 40)],
        [*word("e", 50), *passage[10:44], "x"],  # 34 words: too short
        [*word("f", 5), *passage[:35], *word("g", 5), *passage[25:]],
        word("a", 34),
    ]
    texts = ["\n".join(t) for t in texts]
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in enumerate(texts)], "doc_id long, text string, kept string, n_words int")
    found = repeats.deduplicated(docs, with_text=True)
    assert results(found) == dict(enumerate(brute_force(texts)))
    first = found.where("doc_id = 0").first()
    assert [(s["start"], s["stop"]) for s in first["spans"]] == [(30, 90)]
    assert first["kept"].split() == [*word("a", 30), *word("b", 9)]


def test_null_ids_repeated_rows_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(None, text), (None, text), (3, text + " more"), (4, "w1"), (4, "w1"), (5, None)], "doc_id long, text string")
    found = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in repeats.deduplicated(docs).collect())
    assert found == [(0, 40, 40), (0, 40, 40), (3, 41, 40), (4, 1, 0), (4, 1, 0), (5, 0, 0)]
    assert repeats.deduplicated(docs.limit(0)).collect() == []


def test_smallest_places():
    values = np.random.RandomState(2).randint(0, 5, 200)
    for width in (1, 2, 3, 7, 8, 24):
        found = repeats.smallest_places(values, width)
        assert found.tolist() == [i + int(values[i : i + width].argmin()) for i in range(200 - width + 1)]


def test_merged_spans():
    start, stop = repeats.merged(np.array([7, 0, 2, 12, 9]), np.array([9, 5, 3, 13, 10]))
    assert (start.tolist(), stop.tolist()) == ([0, 7, 12], [5, 10, 13])
