"""Corpus operators against brute force on whole small tables and on awkward rows."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfwatch.llm import (
    catalog,
    components,
    language_model,
    mixing,
    near_duplicates,
    nearest,
    packing,
    passages,
    quality,
    secrets,
    suffixes,
    templates,
    token_files,
    tokens,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rule string, token string, `copy` long"
WORD = re.compile(r"[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


@pytest.fixture(scope="module")
def corpus(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def run(spark, data):
    held = {}

    def rows(name):
        if name not in held:
            held[name] = catalog.QUERIES[name](spark, data).collect()
        return held[name]

    return rows


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    """Nulls in every column, empty, long and repeated texts, repeated ids, columns with clashing names."""
    long_text = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
    passage = " ".join(f"Passage{i}" for i in range(60))
    rows = [
        (1, "", "en", "a", 0, "r", "t", 1),
        (2, None, None, None, None, None, None, None),
        (3, long_text, "en", "a", 9, "r", "t", 1),
        (4, long_text, "en", "a", 9, "r", "t", 1),
        (4, long_text, "en", "a", 9, "r", "t", 1),
        (5, f"before one\n{passage}\nafter", "de", "b", 3, None, "t", 2),
        (6, f"other start\n{passage}\nend éß", "de", "b", 3, None, "t", 2),
        (7, f"third start\n{passage}\nstop", "de", "b", 3, None, "t", 2),
        (None, "one two three", "en", None, 1, "r", None, 1),
        (None, " \t\n", None, "c", 1, "r", None, 1),
        (8, "password = abcdefghijkl ü 0123456789abcdef0", "en", "c", 1, "r", "t", 1),
    ]
    path = str(tmp_path_factory.mktemp("awkward") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty") / "documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


OPERATORS = {
    "language model": lambda d: language_model.scored(d),
    "near duplicates": lambda d: near_duplicates.grouped(d),
    "quality": lambda d: quality.judged(d),
    "mixing": lambda d: mixing.mixed(d),
    "passages": lambda d: passages.deduplicated(d),
    "secrets": lambda d: secrets.found(d),
    "token files": lambda d: token_files.counts(d),
    "templates": lambda d: templates.without_recurring(d),
    "packing": lambda d: packing.packed(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows(awkward, name):
    found = OPERATORS[name](awkward).collect()
    if name == "mixing":
        assert {r["doc_id"] for r in found} <= {r["doc_id"] for r in awkward.collect()}
    elif name == "packing":
        assert sum(r["start"] == 0 for r in found) == awkward.count()
    else:
        assert len(found) == awkward.count()


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(empty, name):
    assert OPERATORS[name](empty).collect() == []


def test_language_model_base_and_gain(run, corpus):
    rows = run("op1_language_model")
    split = {i: [*words(t), "\n"] for i, t in corpus.items()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in corpus}
    counts = Counter(w for i, ws in split.items() if not held[i] for w in ws)
    whole, room = sum(counts.values()), math.log10(sum(counts.values()) + 0.5 * (len(counts) + 1))
    for r in rows:
        own = split[r["doc_id"]]
        base = sum(math.log10(counts[w] + 0.5) - room for w in own)
        assert r["base_score"] == pytest.approx(base, abs=1e-6)
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held[r["doc_id"]], len(own), whole)
        assert r["n_known"] == sum(w in counts for w in own)
    unseen = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in unseen) > sum(r["base_score"] for r in unseen)


def test_class_probabilities_sum_to_one():
    random = np.random.RandomState(0)
    weights = random.normal(size=(language_model.TABLES, language_model.FEATURES, language_model.CLASSES)).astype(np.float32)
    bias = random.normal(size=language_model.CLASSES).astype(np.float32)
    rows = random.randint(0, language_model.FEATURES, (5, language_model.TABLES))
    total = sum(np.exp(language_model.log_class(weights, bias, rows, np.full(5, k))) for k in range(language_model.CLASSES))
    assert total == pytest.approx(np.ones(5), abs=1e-4)


def test_token_probabilities_sum_to_one_and_follow_the_history():
    random = np.random.RandomState(0)
    known = sorted({f"{random.randint(10**6)}{end}".encode() for end in ("ab", "cd", "ef") for _ in range(300)})
    lexicon = language_model.Lexicon(known)
    classes = np.array([lexicon.class_of(w) for w in known])
    masses, other = 1 / np.arange(1, len(known) + 1), np.full(language_model.CLASSES, 0.5)
    tree = language_model.Tree(classes, masses, other)
    shape = (language_model.TABLES, language_model.TOKEN_FEATURES, language_model.WAYS)

    def inside(weights, before):
        """Probability inside its class of every known token and of one unseen token per class, after ``before``."""
        unseen = {lexicon.class_of(w): w for w in (b"unseenab", b"unseencd", b"unseenef")}
        seen = language_model.Histories(lexicon, [[before, w] for w in [*known, *unseen.values()]])
        token, node, digit, rows = seen.choices(tree, slice(None))
        logs = np.bincount(token, language_model.log_class(weights, tree.bias[node], rows, digit), len(seen.entries))
        return np.exp(logs[1::2]), seen.entries["class"][1::2]

    learnt = random.normal(size=shape).astype(np.float32)
    for weights in (np.zeros(shape, np.float32), learnt):
        chance, of = inside(weights, b"one")
        for k in set(of[of >= language_model.SINGLE].tolist()):
            assert chance[of == k].sum() == pytest.approx(1, abs=1e-4)
    untrained, of = inside(np.zeros(shape, np.float32), b"one")
    mass = np.append(masses, np.full(len(of) - len(masses), 0.5))
    in_class = of >= language_model.SINGLE
    share = mass / np.bincount(of, mass)[of]
    assert untrained[in_class] == pytest.approx(share[in_class], rel=1e-3)
    assert not np.allclose(chance[in_class], inside(learnt, b"two")[0][in_class], rtol=0.1)


def test_history_tells_tokens_of_a_class_apart(spark):
    left, right = [f"left{i}" for i in range(30)], [f"right{i}same" for i in range(30)]
    fill = " ".join(f"fill{i} fill{i}" for i in range(30))  # the most frequent tokens, which are classes of their own
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 1][:60]
    free = [i for i in range(5000) if zlib.crc32(str(i).encode()) % 5 != 1][:1200]
    probes = [(held[2 * i + off], f"{left[i]} {right[(i + 7 * off) % 30]}") for i in range(30) for off in (0, 1)]
    given = [(i, f"{left[n % 30]} {right[n % 30]} {fill}") for n, i in enumerate(free)]
    docs = spark.createDataFrame(given + probes, "doc_id long, text string")
    score = {r["doc_id"]: r["score"] for r in language_model.scored(docs).collect()}
    gained = [score[held[2 * i]] - score[held[2 * i + 1]] for i in range(30)]
    assert np.mean(gained) > 0.3  # by counts alone, or by classes, both are about as likely


def components_of(corpus):
    sets = {}
    for i, text in corpus.items():
        own = words(text)
        sets[i] = {tuple(own[j : j + 5]) for j in range(len(own) - 4)} if len(own) >= 5 else ({tuple(own)} if own else set())
    shared, holders = Counter(), defaultdict(list)
    for i, own in sets.items():
        for s in own:
            shared.update((j, i) for j in holders[s])
            holders[s].append(i)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, j), both in shared.items():
        if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
            low, high = sorted((find(i), find(j)))
            root[high] = low
    return sets, {i: find(i) for i in sets}


def test_training_sends_changes_once_and_equals_plain_steps(spark, monkeypatch):
    """Few changes of a block are added up in one shuffle; a step moves each row by the sum of its gradients."""
    random = np.random.RandomState(2)
    weights = random.normal(size=(language_model.TABLES, 64, 5)).astype(np.float32)
    bias, classes = np.zeros(5, np.float32), random.randint(0, 5, 3000)
    rows = random.randint(0, 60, (3000, language_model.TABLES)) ** 2 // 60
    scores = bias + sum(weights[t][rows[:, t]].astype(float) for t in range(language_model.TABLES))
    gradient = np.eye(5)[classes] - np.exp(scores) / np.exp(scores).sum(1, keepdims=True)
    expected, count = weights.astype(float), np.zeros((language_model.TABLES, 64), np.int64)
    for t in range(language_model.TABLES):
        np.add.at(count[t], rows[:, t], 1)
        total = np.zeros((64, 5))
        np.add.at(total, rows[:, t], gradient)
        expected[t] += total * (language_model.RATE / (count[t] + language_model.CALM))[:, None]
    met = np.zeros_like(count)
    language_model.step(weights, bias, rows, classes, met)
    assert (met == count).all() and np.abs(weights - expected).max() < 1e-4

    keys, group = [], type(spark.range(1)).groupBy
    monkeypatch.setattr(type(spark.range(1)), "groupBy", lambda self, *by: keys.append(tuple(map(str, by))) or group(self, *by))
    docs = spark.createDataFrame([(i, f"some words of text {i % 7}") for i in range(40)], "doc_id long, text string")
    assert language_model.scored(docs).count() == 40
    assert ("block",) in keys and ("block", "salt") not in keys


def test_near_duplicates_equal_brute_force(run, corpus):
    sets, root = components_of(corpus)
    for r in run("op2_minhash_dedup"):
        i = r["doc_id"]
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[i]), root[i], root[i] == i)


def test_near_copies_without_a_common_hub(spark):
    """A chain: each text is like the next, the ends are not alike."""
    base = [f"w{i}" for i in range(400)]
    texts = []
    for step in range(6):
        own = list(base)
        own[: 20 * step] = [f"v{i}" for i in range(20 * step)]
        texts.append((10 + step, " ".join(own)))
    docs = spark.createDataFrame([*texts, (99, "something else entirely is here now")], "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in near_duplicates.grouped(docs).collect()}
    _, root = components_of(dict((i, t) for i, t in docs.collect()))
    assert found == root


def test_near_duplicates_ignore_null_ids(spark):
    text = lambda letter, last: " ".join([*(f"{letter}{i}" for i in range(80)), last])
    rows = [(None, text("a", "x")), (5, text("a", "x")), (7, text("a", "x")), (9, text("a", "y")), (None, text("b", "x")), (None, text("b", "y"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [(r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates.grouped(docs).collect()]
    assert sorted(r for r in found if r[0]) == [(5, 5, True), (7, 5, False), (9, 5, False)]
    assert sorted(r[1:] for r in found if not r[0] and r[1]) == [(5, False)]
    assert sorted(r[1:] for r in found if not r[1]) == [(None, False), (None, True)]
    assert [r["doc_id"] for r in near_duplicates.one_of_each(docs).orderBy("doc_id").collect()] == [None, 5]


def test_prefix_pairs_miss_no_similar_pair_and_few_are_made(spark):
    """A family whose members share over half of their text: similar pairs all come up, hardly any other does."""
    random = np.random.RandomState(8)
    core = [f"c{i}" for i in range(120)]
    texts = [" ".join([*core, *(f"t{n}x{i}" for i in range(random.randint(10, 90)))]) for n in range(60)]
    texts += [t + " one more word" for t in texts[:5]]
    held = spark.createDataFrame([(i, t.encode()) for i, t in enumerate(texts)], "cid long, text binary")
    apart = spark.createDataFrame([(i, i) for i in range(len(texts))], "cid long, root long")
    found = {tuple(r) for r in near_duplicates._prefix_pairs(held, apart).collect()}
    sets = [set(near_duplicates.shingles(t.encode()).tolist()) for t in texts]
    alike = {(i, j) for j in range(len(sets)) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    assert alike and alike <= found
    assert len(found) < 0.5 * len(texts) * (len(texts) - 1) / 2


def test_family_of_half_similar_members_makes_few_pairs(spark, monkeypatch):
    """About half of all pairs are similar: hubs join the family, and hardly a pair is left to the exact filter."""
    random = np.random.RandomState(4)
    texts = []
    for n in range(150):
        own = [f"w{i}" for i in range(200)]
        for at in random.choice(200, 3, False):
            own[at] = f"x{n}y{at}"
        texts.append((n, " ".join(own)))
    made = []
    exact = near_duplicates._prefix_pairs
    monkeypatch.setattr(near_duplicates, "_prefix_pairs", lambda *given: made.append(exact(*given).cache()) or made[-1])
    found = {r["doc_id"]: r["component_id"] for r in near_duplicates.grouped(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    sets, root = components_of(dict(texts))
    alike = sum(100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) for j in range(150) for i in range(j))
    assert 0.25 < alike / (150 * 149 / 2) < 0.75
    assert found == root
    assert made[0].count() < len(texts)


def test_family_around_an_original_makes_few_pairs(spark, monkeypatch):
    """Copies are like their original, hardly any like each other: the original becomes the hub, whatever the order of ids."""
    random = np.random.RandomState(5)
    base = [f"w{i}" for i in range(200)]
    texts = [(150, " ".join(base))]
    for n in range(150):
        own = list(base)
        for at in random.choice(200, 5, False):
            own[at] = f"x{n}y{at}"
        texts.append((n, " ".join(own)))
    made = []
    exact = near_duplicates._prefix_pairs
    monkeypatch.setattr(near_duplicates, "_prefix_pairs", lambda *given: made.append(exact(*given).cache()) or made[-1])
    found = {r["doc_id"]: r["component_id"] for r in near_duplicates.grouped(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    sets, root = components_of(dict(texts))
    alike = sum(100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) for j in range(150) for i in range(j))
    assert alike < 0.1 * 150 * 149 / 2
    assert found == root
    assert made[0].count() < len(texts) / 2


def test_one_of_each_keeps_columns_of_any_name(spark):
    rows = [(1, "a b c d e f", "keep", 7), (2, "a b c d e f", "other", 8), (3, "x y z", None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __key string, HELPER_0 int")
    found = near_duplicates.one_of_each(docs)
    assert found.columns == docs.columns
    assert sorted(tuple(r) for r in found.collect()) == [rows[0], rows[2]]


def test_large_star_small_star(spark):
    links = spark.createDataFrame([(9, 8), (8, 7), (7, 6), (6, 5), (1, 2), (2, 1), (3, 3)], "a long, b long")
    assert {tuple(r) for r in components.connected(links).collect()} == {(9, 5), (8, 5), (7, 5), (6, 5), (5, 5), (1, 1), (2, 1)}


def test_rounds_of_few_links_have_few_tasks(spark, monkeypatch):
    """Tasks and files of a round follow its links, not the session's shuffle partitions."""
    tasks, write = [], components.written
    monkeypatch.setattr(components, "written", lambda df, label: tasks.append(df.rdd.getNumPartitions()) or write(df, label))
    links = spark.createDataFrame([(i, i + 1) for i in range(20)], "a long, b long").coalesce(1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = {tuple(r) for r in components.connected(links).collect()}
        monkeypatch.setattr(components, "LINKS_EACH", 7)
        assert {tuple(r) for r in components.connected(links).collect()} == found == {(i, 0) for i in range(21)}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert tasks[:2] == [1, 1] and max(tasks) == 3


def test_quality_measures(run, corpus):
    for r in run("op3_quality_rules"):
        text = corpus[r["doc_id"]]
        own = WORD.findall(text)
        windows = Counter(tuple(own[i : i + 8]) for i in range(len(own) - 7))
        inside = {i + k for i in range(len(own) - 7) if windows[tuple(own[i : i + 8])] > 1 for k in range(8)}
        lines = [line for line in text.split("\n") if WORD.search(line)]
        assert (r["n_words"], r["word_chars"]) == (len(own), sum(map(len, own)))
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in text)
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), len(inside))
        failed = len(own) < 20 or 100 * len(inside) > 30 * len(own)
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_mixing_reaches_weights(spark):
    docs = spark.createDataFrame([(i, "x" * 9, "hot" if i < 3000 else "cold") for i in range(4000)], "doc_id long, text string, source string")
    counts = dict(mixing.mixed(docs, {"hot": 1.0, "cold": 3.0}).groupBy("source").count().collect())
    assert counts["cold"] == pytest.approx(3000, rel=0.1) and counts["hot"] == pytest.approx(1000, rel=0.12)
    many = dict(mixing.mixed(docs.where("doc_id > 2995"), {"hot": 500.0, "cold": 1.0}).groupBy("source").count().collect())
    assert many["hot"] == pytest.approx(1002, rel=0.15)  # four documents, 250 times each


def test_poisson_thresholds(spark):
    means = [0.1, 1.0, 20.0, 64.0]
    rows = spark.createDataFrame([(m,) for m in means], "m double").select("m", mixing._thresholds(F.col("m")).alias("upto"))
    for r in rows.collect():
        expected = np.cumsum([math.exp(-r["m"] + k * math.log(r["m"]) - math.lgamma(k + 1)) for k in range(len(r["upto"]))])
        assert r["upto"] == pytest.approx(expected, abs=1e-12) and 1 - r["upto"][-1] < 1e-12


def test_passages_equal_brute_force(run, corpus):
    found = {r["doc_id"]: r for r in run("op5_repeated_passages")}
    seen = set()
    for i in sorted(corpus):
        data = corpus[i].encode()
        own = [data[j : j + 50] for j in range(len(data) - 49)]
        lost = np.zeros(len(data), bool)
        for j, s in enumerate(own):
            if s in seen:
                lost[j : j + 50] = True
        seen.update(own)
        kept = bytes(np.frombuffer(data, np.uint8)[~lost])
        r = found[i]
        assert (r["n_bytes"], r["n_removed"], r["kept_sha256"]) == (len(data), lost.sum(), hashlib.sha256(kept).hexdigest())
        assert r["n_spans"] == (lost & ~np.append(False, lost[:-1])).sum() if len(data) else r["n_spans"] == 0


def test_search_for_anchors_takes_one_python_worker_a_task(spark, monkeypatch):
    """Two copies, of which the later takes no part, and a text that shares a passage with them."""
    passage = " ".join(f"passage{i}" for i in range(20))
    rows = [(1, f"one {passage} end"), (2, f"one {passage} end"), (3, f"other {passage}")]
    plans = []
    search = passages._anchor_rows
    monkeypatch.setattr(passages, "_anchor_rows", lambda *given: plans.append(search(*given)) or plans[-1])
    found = passages.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert "ArrowEvalPython" not in plans[0]._jdf.queryExecution().optimizedPlan().toString()
    whole, shared = len(rows[0][1]), len(passage) + 1  # with the space before it
    assert sorted((r["doc_id"], r["n_removed"], r["n_spans"]) for r in found) == [(1, 0, 0), (2, whole, 1), (3, shared, 1)]


def test_search_for_anchors_has_small_batches_and_stored_settled_texts(spark, monkeypatch):
    """Both parts of the search have one Python worker a task and bounded batches; the session's own bound comes back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, plans, bounds = spark.conf.get(name), [], []
    search = passages._anchor_rows
    monkeypatch.setattr(passages, "_anchor_rows", lambda *given: bounds.append(int(spark.conf.get(name))) or plans.append(search(*given)) or plans[-1])
    passage = " ".join(f"passage{i}" for i in range(20))
    rows = [(i, f"{i} {passage}") for i in range(9)]
    found = {r["doc_id"]: r["n_removed"] for r in passages.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {i: 0 if i == 0 else len(passage) + 1 for i in range(9)}
    assert len(plans) == 2 and not any("ArrowEvalPython" in p._jdf.queryExecution().optimizedPlan().toString() for p in plans)
    assert max(bounds) <= passages.STEP_ROWS and spark.conf.get(name) == before


def test_removal_takes_one_python_worker_a_task(spark):
    """Rows that stay as they are and later copies are told apart where their bytes are counted."""
    passage = " ".join(f"passage{i}" for i in range(20))
    rows = [(1, f"one {passage} end"), (2, f"one {passage} end"), (3, f"other {passage}"), (4, "short"), (5, "short"), (6, None)]
    found = passages.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert (plan.count("ArrowEvalPython"), plan.count("MapInArrow")) == (1, 2)
    whole, shared = len(rows[0][1]), len(passage) + 1
    expected = [(1, 0, 0), (2, whole, 1), (3, shared, 1), (4, 0, 0), (5, 0, 0), (6, 0, 0)]
    assert sorted((r["doc_id"], r["n_removed"], r["n_spans"]) for r in found.collect()) == expected


def test_anchor_of_many_surroundings_is_not_sorted_in_one_task(spark):
    random = np.random.RandomState(5)
    phrase = b"the same twenty bytes"
    around = lambda n: bytes(random.randint(97, 123, n, np.uint8))
    shared = around(40)
    texts = [(i, (around(60) + b" " * 60 + phrase + around(60) + (shared + phrase + shared if i % 10 == 0 else b"")).decode()) for i in range(200)]
    named = passages._named(spark.createDataFrame([*texts, (200, texts[7][1] + "x")], "doc_id long, text string"))
    rows = passages._anchor_rows(named).groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("top")).where("low < top")
    cuts = passages._cuts(named, passages.bit_filter(rows.select("anchor"), "anchor")).cache()

    holders = cuts.select("anchor", "name", "key", "start", "id").collect()

    def lost(owners):
        by_cut = defaultdict(list)
        for r in owners.collect():
            by_cut[r["anchor"], r["name"]].append(r)
        return {(h["key"], h["start"] + at) for h in holders for r in by_cut[h["anchor"], h["name"]] if h["id"] > r["owner"] for at in range(r["first"], r["last"] + 1)}

    sizes = cuts.where("cut is not null").groupBy("anchor").agg(F.sum(F.octet_length("cut")).alias("n")).collect()
    assert min(r["n"] for r in sizes) <= 2_000 < max(r["n"] for r in sizes)
    whole = lost(passages._owners(cuts))
    assert whole and lost(passages._owners(cuts, shard_bytes=2_000)) == whole
    assert lost(passages._string_owners(cuts.where("cut is not null"))) == whole


def test_induced_sorting():
    random = np.random.RandomState(3)
    for _ in range(60):
        parts = [random.randint(1, 4, random.randint(1, 30)) for _ in range(random.randint(1, 12))]
        text = np.concatenate([np.append(p, 0) for p in parts]).astype(np.uint16)
        data = text.astype(np.uint8).tobytes()
        order = suffixes.sorted_suffixes(text, 50, limit=200)
        assert sorted(order) == [i for i, c in enumerate(data) if c]
        found = [data[p : data.index(b"\0", p)] for p in order]
        assert found == sorted(found)


def test_induced_sorting_of_wanted_suffixes():
    """The first suffixes of each string come in the same order as among all, and most others are left out."""
    random = np.random.RandomState(4)
    kept = []
    for _ in range(60):
        parts = [random.randint(1, 4, random.randint(1, 60)) for _ in range(random.randint(1, 12))]
        text = np.concatenate([np.append(p, 0) for p in parts]).astype(np.uint16)
        wanted = np.concatenate([np.arange(len(p) + 1) < min(len(p), random.randint(0, 10)) for p in parts])
        data = text.astype(np.uint8).tobytes()
        order = suffixes.sorted_suffixes(text, 61, limit=200, wanted=wanted)
        assert len(set(order.tolist())) == len(order) and set(np.flatnonzero(wanted)) <= set(order.tolist())
        found = [data[p : data.index(b"\0", p)] for p in order]
        assert found == sorted(found)
        kept.append(len(order) / (text > 0).sum())
    assert np.mean(kept) < 0.6


def test_nearest_recall_and_scores(spark, data, run):
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()}
    ids = np.array(sorted(vectors))
    whole = np.stack([vectors[i] for i in ids])
    found = defaultdict(list)
    for r in sorted(run("op6_nearest_neighbours"), key=lambda r: r["rank"]):
        found[r["query_id"]].append(r["vec_id"])
        assert r["score"] == pytest.approx(float(vectors[r["query_id"]] @ vectors[r["vec_id"]]), abs=1e-12)
    hits = 0
    for q, own in found.items():
        scores = whole @ vectors[q]
        best = [i for i in ids[np.lexsort((ids, -scores))] if i != q][:20]
        hits += len(set(best) & set(own))
        assert len(own) == 20
    assert hits >= 0.9 * 20 * len(found) and len(found) == sum(i % 20 == 0 for i in vectors)


def test_nearest_leaves_out_unusable_vectors(spark):
    good = [(i, [float(i % 7), 1.0]) for i in range(1, 60)]
    bad = [(100, None), (120, [0.0, 0.0]), (140, [None, 1.0]), (160, [float("nan"), 1.0]), (180, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    found = nearest.nearest(spark.createDataFrame([*good, *bad], "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    assert {r["query_id"] for r in found} == {20, 40}
    own = [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == 20]
    score = lambda i: (i % 7) * (20 % 7) + 1
    assert own == sorted((i for i, _ in good if i != 20), key=lambda i: (-score(i), i))[:20]
    assert nearest.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).count() == 0


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def test_secrets_equal_plain_patterns(run, corpus):
    for r in run("op7_secret_scan"):
        text = corpus[r["doc_id"]]
        spans = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
        spans += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        spans += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
        assert r["base_sha256"] == hashlib.sha256(",".join(s for *_, s in sorted(spans)).encode()).hexdigest()
        assert r["n_hex"] == sum(k == 1 + 1 for _, k, _ in spans)


def test_checksums_decide():
    body = b"z" * 30
    good = b"x ghp_" + body + secrets.crc_digits(body) + b" y"
    scan = secrets.Scanner()
    assert scan(good) == [("github", 2, 42)]
    assert scan(good.replace(b"ghp_z", b"ghp_y")) == []
    assert scan("ü token = abcdefghijkl".encode()) == [("assign", 2, 22)]


def test_token_counts(run, corpus):
    processor = token_files._processor(tokens.vocabulary("piece_bpe_32k.model"))
    for r in run("op8_token_counts"):
        assert r["n_tokens"] == len(processor.encode(corpus[r["doc_id"]]))


def test_scan_stitches_blocks_and_open_ends(spark, tmp_path):
    ids = np.array([5, 2, 2, 7, 8, 9, 10, 11, 2, 4], "<u2")
    (tmp_path / "one.bin").write_bytes(ids.tobytes())
    (tmp_path / "none.bin").write_bytes(b"")
    for block in (1, 2, 3, 64):
        found = token_files.scan(spark, str(tmp_path), block=block).orderBy("ordinal").collect()
        assert [(r["ordinal"], r["start"], r["n_tokens"], r["closed"]) for r in found] == [(0, 0, 1, True), (1, 2, 0, True), (2, 3, 5, True), (3, 9, 1, False)]


def test_templates_drop_recurring_lines(spark):
    rows = [(i, f"own line number of text {'abcdefgh'[i]} here alone\nuser name{i} logged in from host h{i}\nshort line", 1) for i in range(5)]
    docs = spark.createDataFrame([*rows, (9, rows[0][1], 1)], "doc_id long, text string, n_chars long")
    found = {r["doc_id"]: r for r in templates.without_recurring(docs).collect()}
    assert found[0]["text"] == rows[0][1] == found[9]["text"]  # the first text keeps its lines, and so does its copy
    for i in range(1, 5):
        assert "logged in" not in found[i]["text"] and "short line" in found[i]["text"]
        assert found[i]["n_chars"] == len(found[i]["text"])


def kept_lines(corpus, short_texts=6):
    """Whole lines and templates counted in plain dictionaries: what op9 leaves of each text."""
    first_id = {}
    for i, text in sorted(corpus.items()):
        first_id.setdefault(text, i)
    found, lines_at, support = [], defaultdict(lambda: defaultdict(set)), defaultdict(Counter)
    for text in first_id:
        for number, raw in enumerate(text.split("\n")):
            own = tuple(raw.encode().split())
            letter = re.search(rb"[A-Za-z\x80-\xff]", raw.encode())
            if len(own) >= 4 or own and letter:
                masked = tuple(b"<*>" if len(own) >= 4 and re.search(rb"[0-9]", w) else w for w in own)
                leaf = (len(own), masked[:3])
                lines_at[leaf][masked].add(text)
                found.append((text, number, leaf, masked, own if letter else None))
    for leaf, held in lines_at.items():
        for masked, texts in held.items():
            support[leaf].update({(p, w): len(texts) for p, w in enumerate(masked) if w != b"<*>"})
    holders, places = defaultdict(set), defaultdict(set)
    for text, number, leaf, masked, own in found:
        names = []
        for level in (2, 3):
            fixed = frozenset((p, w) for p, w in enumerate(masked) if support[leaf][p, w] >= level)
            if len(masked) >= 4 and len(fixed) >= max(4, 0.7 * len(masked)):
                names.append((level, leaf, fixed))
        if own:
            names.append((2 if len(own) >= 4 else short_texts, "whole", own))
        for name in names:
            holders[name].add(text)
            places[name].add((text, number))
    gone = defaultdict(set)
    for name, texts in holders.items():
        if len(texts) >= name[0]:
            stays = min(texts, key=first_id.get)
            for text, number in places[name]:
                if text != stays:
                    gone[text].add(number)
    return {i: "\n".join(x for n, x in enumerate(text.split("\n")) if n not in gone[text]) for i, text in corpus.items()}


def test_line_dedup_equals_brute_force(run, corpus):
    left = kept_lines(corpus)
    for r in run("op9_line_dedup"):
        i = r["doc_id"]
        assert (r["text"] or "") == left[i]
        assert r["n_lines"] == corpus[i].count("\n") + 1
        assert r["n_dropped"] == r["n_lines"] - (left[i].count("\n") + 1 if left[i] or r["n_dropped"] < r["n_lines"] else 0)


def test_whole_lines_recur(spark):
    passage = " ".join(f"{w}word" for w in "abcdefghijklmnopqrstuvwxyz" * 2)
    numbers = "Tel 030 1234 5678 90"
    rows = [(i, f"{'abcdefgh'[i] * 5}\nLes.\n{i}{i}\n12\n}}\nmine {i} 1 2 3" + (f"\n{passage}\n{numbers}" if i > 5 else "")) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["text"] for r in templates.without_recurring(docs).collect()}
    assert found == kept_lines(dict(rows))
    assert all(("Les." in found[i]) == (i == 0) for i in range(8))  # one word, eight texts
    assert passage in found[6] and passage not in found[7]  # a long line of two texts
    assert numbers in found[6] and numbers not in found[7]  # hardly anything fixed, but the same line
    assert all(f"mine {i} 1 2 3" in found[i] and "\n12\n}" in found[i] for i in range(8))  # only fields in common; no letter


def test_encoder_equals_tokenizer(corpus):
    whole = Tokenizer.from_file(tokens.vocabulary())
    texts = [*list(corpus.values())[:60], "don't  it's <|endoftext|>a", "", "é ́x ΑΣ\x1cfoo 1234abc,.!", "<|startoftext|> \x01 x\x01y"]
    for text, ids in zip(texts, tokens.encoder(tokens.vocabulary())([t.encode() for t in texts]), strict=True):
        assert whole.encode(text, add_special_tokens=False).ids == np.frombuffer(ids, "<u4").tolist()


def test_plain_words_spare_the_tokenizer_its_pattern(monkeypatch):
    """Words of lower-case letters up to U+00FF go to the model alone and have the tokenizer's ids."""
    encode, whole = tokens.WordEncoder(tokens.vocabulary()), Tokenizer.from_file(tokens.vocabulary())
    asked, general = [], encode._encode
    monkeypatch.setattr(encode, "_encode", lambda text: asked.append(text) or general(text))
    every = "".join(map(chr, [*range(97, 123), *range(0xDF, 0x100)])).replace("÷", "")
    words = [*every, every, *(every[i : i + 7] for i in range(0, 50, 3)), "straße", "ciónñ", "ÿÀx", "a÷b", "xª", "é́x", "ǆa"]
    found = encode([" ".join(words).encode()])[0]
    assert np.frombuffer(found, "<u4").tolist() == whole.encode(" ".join(words), add_special_tokens=False).ids
    assert b" ".join(asked).split() and not any("straße".encode() in text or b"abc" in text for text in asked)


def test_packing_places_every_id_once(run, corpus):
    whole = Tokenizer.from_file(tokens.vocabulary())
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in run("op10_pack_sequences"):
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for i, text in corpus.items():
        ids = np.array([*whole.encode(text, add_special_tokens=False).ids, 2], "<u4")
        parts = sorted(by_doc[i], key=lambda r: r["start"])
        at = 0
        for r in parts:
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
    used = sum(r["length"] for rows in by_doc.values() for r in rows)
    assert used >= 0.97 * 4096 * len(by_sequence)


def test_first_fit_decreasing():
    bins, offsets = packing.first_fit_decreasing(np.array([7, 6, 5, 4, 3, 2, 1]), 10)
    assert bins.tolist() == [0, 1, 2, 1, 0, 2, 2] and offsets.tolist() == [0, 0, 0, 6, 7, 5, 7]


def test_pipeline_keeps_one_of_each_and_packs(spark, data):
    import corpus_pipeline

    docs = corpus_pipeline.documents(spark, data)
    columns = docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "minhash near-dedup", "mix sources", "pack"]
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        before, kept = kept, stage(spark, kept, data).cache()
        assert kept.columns == columns
        assert {r[0] for r in kept.select("doc_id").collect()} <= {r[0] for r in before.select("doc_id").collect()}
    _, root = components_of({r["doc_id"]: r["text"] or "" for r in before.collect()})
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(root.values()))
    packed = corpus_pipeline.run(spark, data)
    assert packed.where("length < 1 or length > 4096").count() == 0 and packed.count() > 0
