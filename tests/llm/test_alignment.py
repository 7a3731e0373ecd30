"""Alignment of two vocabularies against whole-text encoding and plain set operations."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from shelfwatch.llm import alignment, catalog
from shelfwatch.llm.tokens import vocabulary

ODD = [
    "",
    None,
    " ",
    "  two  spaces ",
    "end \n next\n\n\nthird\t\ttab  x  ",
    "<|endoftext|> a<s></s><unk> <0x41>",
    "é ́x 日本語 ﬁ ａ́ ‍👩‍👧 naïve",
    "=" * 300 + " " + "-" * 41 + "▁x",
    "a" * 5000,
    "0123456789 " * 40,
    "\x00\x01 \x1c b",
]


def brute_force(texts):
    """Rows of the contract from whole-text encoding, without segments, memo or division."""
    tokenizer = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    processor = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    alphabet = alignment.byte_alphabet()
    held, counts = [], Counter()
    for text in texts:
        a = b = []
        if text:
            a = tokenizer.encode(" " + text, add_special_tokens=False).ids
            b = processor.encode(text)
            of_a = [bytes(alphabet[c] for c in tokenizer.id_to_token(i)) for i in a]
            of_b = [bytes([int(processor.id_to_piece(i)[3:5], 16)]) if processor.is_byte(i) else processor.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if not b"".join(of_a) == b"".join(of_b) == b" " + text.encode():
                a = b = []
        groups, links = [], Counter()
        if a:
            a_ends, b_ends = np.cumsum([len(x) for x in of_a]).tolist(), np.cumsum([len(x) for x in of_b]).tolist()
            for cut in sorted(set(a_ends) & set(b_ends)):
                done_a, done_b = (sum(len(g[k]) for g in groups[-1:]) and groups[-1][k + 2] if groups else 0 for k in (0, 1))
                end_a, end_b = a_ends.index(cut) + 1, b_ends.index(cut) + 1
                groups.append((a[done_a:end_a], b[done_b:end_b], end_a, end_b))
            for x, y, *_ in groups:
                links.update((i, j) for i in x for j in y)
        counts.update(links.keys())
        held.append((a, b, groups, links))
    best = defaultdict(int)
    for (i, _), n in counts.items():
        best[i] = max(best[i], n)
    rows = []
    for a, b, groups, links in held:
        line = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y, *_ in groups)
        n_best = sum(n for (i, j), n in links.items() if counts[i, j] == best[i])
        total = sum(n * counts[pair] for pair, n in links.items())
        digest = hashlib.sha256(line.encode()).hexdigest() if a else ""
        rows.append((len(a), len(b), len(groups), sum(links.values()), n_best, total, digest))
    return rows


def results(df):
    return {r[0]: tuple(r)[1:] for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()}


def test_query_equals_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    found = results(catalog.QUERIES["op11_aligned_tokens"](spark, data))
    assert found == dict(zip([r["doc_id"] for r in docs], brute_force([r["text"] for r in docs]), strict=True))


@pytest.mark.parametrize("hot_pairs", [0, 40, 1 << 19])
def test_odd_texts(spark, hot_pairs):
    """Rare pairs are joined: the result is the same whatever the broadcast holds."""
    texts = [*ODD, "plain words here", "plain words here", *ODD[3:5]]
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_a long")
    found = results(alignment.links(docs, hot_pairs=hot_pairs))
    assert found == dict(enumerate(brute_force(texts)))
    assert found[0] == found[1] == (0, 0, 0, 0, 0, 0, "")


def test_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "x y"), (None, "x y")], "doc_id long, text string")
    assert [r["n_groups"] for r in alignment.links(docs).collect()] == [2, 2]
    assert alignment.links(docs.limit(0)).collect() == []


def test_division_finds_every_shared_cut():
    random = np.random.RandomState(1)
    for _ in range(60):
        parts, starts, at, count = [], [], 0, 0
        for _ in range(random.randint(1, 6)):
            size, share = random.randint(1, 300), random.choice([0.02, 0.3, 0.9])
            a, b = (np.flatnonzero(random.rand(size) < share) + 1 for _ in range(2))
            parts.append((np.unique(np.append(a, size)) + at, np.unique(np.append(b, size)) + at))
            starts.append(count)
            at, count = at + size, count + len(parts[-1][0])
        a, b = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        last_a, last_b = alignment.divided(a, b, np.array(starts))
        common = np.intersect1d(a, b)
        assert a[last_a].tolist() == common.tolist() == b[last_b].tolist()


def test_groups_beyond_a_written_product(monkeypatch):
    run = alignment.aligner(vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    whole = run(ODD[3:5] + ["=" * 300])
    monkeypatch.setattr(alignment, "PRODUCT", 0)
    assert run(ODD[3:5] + ["=" * 300]) == whole
