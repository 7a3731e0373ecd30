"""Scoring texts by a hashed maximum-entropy model with class-factored softmax.

The probability of a token is that of its class given the history, times that of the token in its
class given the history. Classes: the ``SINGLE`` most frequent training tokens stand alone, all others are dealt by
their endings. The class layer is a log-linear model over hashed features of the history: the last word (bigram),
the word before it (skip), and the last three classes (n-gram). The token layer factors each class
again, by frequency, into softmaxes of at most ``WAYS`` outcomes (``Tree``); each is a log-linear model over the last
word, the word before it and both together, hashed with the place in the tree. Without learnt weights it
equals the smoothed counts, which keep room for one unseen token in a class; with any
weights, probabilities of all known tokens and of one unseen token per class sum to one.

Training: each round sends the weights of both layers to all tasks; a task makes gradient steps on its share of that round's
training documents, mini-batch by mini-batch in sparse numpy arithmetic, and returns the change; changes
are summed in Spark, each feature row's weighted by how often a task met it, and averaged. Rounds split the training documents by a hash, so every
one is used once. Weights have a fixed size (``WEIGHT_BYTES``), which bounds broadcasts and collects.

Counts of all training tokens stay a table. Only tokens above a frequency that at most
``DICTIONARY`` tokens reach are sent to tasks and have a place of their own in a tree; the others of a class share one leaf,
inside which their counts decide, and occurrences of them are joined with that table.

Null texts are empty: one end token. Repeated rows are scored, and learned from, each on its own. A
null id is not held out. Extra columns are not read. Empty tables give empty results; without
training documents every count is zero and all classes are equally likely.
"""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwatch.llm.common import batches, text_bytes, written

SINGLE = 24
CLASSES = 48
#: Rows of each of the three feature tables.
FEATURES = 1 << 12
TABLES = 3
#: Outcomes of a softmax inside a class, and those of them that are tokens where a place has more tokens than that.
WAYS = 16
ALONE = 8
#: Rows of each of the three feature tables of the token layer.
TOKEN_FEATURES = 1 << 15
WEIGHT_BYTES = TABLES * (FEATURES * CLASSES + TOKEN_FEATURES * WAYS) * 4
ROUNDS = 4
RATE = 0.4
#: Added to a row's count in a mini-batch, so that rare rows move less.
CALM = 10.0
#: The same for the token layer, whose rows are met less often.
TOKEN_RATE = 0.7
TOKEN_CALM = 10.0
#: Parts in which a layer's changes are added up.
BLOCKS = 48
#: Bound of a weight: three of them and a bias stay within single precision's exponents.
LARGEST = 20.0
MINI_BATCH = 32_768
DICTIONARY = 150_000
#: Words in a worker's memo before it starts anew.
MEMO_WORDS = 600_000
#: Rows whose scores are computed at once.
CACHED_ROWS = 2048
#: Changes of a block that one group adds up.
ADDED = 16
#: Stands for the end of a text; no word holds white space.
END = b"\n"

#: What is no part of a word's ending.
MARKS = b".,;:!?"

_ENTRY = np.dtype([("hash", "<u4"), ("index", "<i4"), ("class", "<u4")])
_START = struct.pack("<IiI", 0, -1, CLASSES)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 1, F.lit(False))


def tokens(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def counted(texts: DataFrame) -> DataFrame:
    """(token, c) over all rows of ``texts``; tasks sum before the shuffle in bounded tables."""

    def count(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()

        def rows() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["token", "c"]
            )
            found.clear()
            return made

        for batch in batches(source):
            for text in batch.column("text").to_pylist():
                found.update(tokens(text))
            if len(found) > MEMO_WORDS:
                yield rows()
        yield rows()

    return texts.mapInArrow(count, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


class Lexicon:
    """Hash, dictionary place and class of tokens, the same in every task."""

    def __init__(self, frequent: list[bytes]) -> None:
        self.places = {token: i for i, token in enumerate(frequent)}
        self.memo: dict[bytes, bytes] = {}
        #: Classes of endings; there are at most as many as pairs of bytes.
        self.endings: dict[bytes, int] = {}

    def class_of(self, token: bytes) -> int:
        place = self.places.get(token, -1)
        if 0 <= place < SINGLE:
            return place
        return SINGLE + xxhash.xxh3_64_intdigest(token.rstrip(MARKS)[-2:]) % (CLASSES - SINGLE)

    def _learn(self, words: list[bytes]) -> None:
        """Entries of words not met before, all at once."""
        made = np.empty(len(words), _ENTRY)
        made["hash"] = list(map(xxhash.xxh32_intdigest, words))
        made["index"] = [self.places.get(w, -1) for w in words]
        endings, known = [w.rstrip(MARKS)[-2:] for w in words], self.endings
        for ending in set(endings).difference(known):
            known[ending] = SINGLE + xxhash.xxh3_64_intdigest(ending) % (CLASSES - SINGLE)
        made["class"] = list(map(known.__getitem__, endings))
        alone = (made["index"] >= 0) & (made["index"] < SINGLE)
        made["class"][alone] = made["index"][alone]
        packed, size = made.tobytes(), _ENTRY.itemsize
        self.memo.update(zip(words, [packed[i : i + size] for i in range(0, len(packed), size)], strict=True))

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        self.memo[b""] = _START  # stands before the start of a text
        found = list(map(self.memo.get, words))
        if None in found:
            missing = [i for i, entry in enumerate(found) if entry is None]
            self._learn(list({words[i] for i in missing}))
            memo = self.memo
            for i in missing:
                found[i] = memo[words[i]]
        return np.frombuffer(b"".join(found), _ENTRY)


class Tree:
    """Places of tokens inside their classes: softmaxes of at most ``WAYS`` outcomes, one below the other.

    Leaf ``i`` is the dictionary's token ``i``, leaf ``size + k`` all other tokens of class ``k``. A place with more leaves
    than ``WAYS`` has its ``ALONE`` heaviest leaves as outcomes; the rest is cut into groups of about equal mass.
    ``bias`` holds the logarithm of each outcome's mass, so that untrained softmaxes give the masses' shares.
    """

    def __init__(self, classes: np.ndarray, masses: np.ndarray, other: np.ndarray) -> None:
        """``masses`` and ``classes`` of the dictionary's tokens, ``other``: mass of each class's other leaf."""
        self.size = len(classes)
        mass = np.concatenate((masses, other)).astype(np.float64)
        belongs = np.concatenate((classes, np.arange(CLASSES))).astype(np.int64)
        heaviest = np.lexsort((np.arange(len(mass)), -mass))
        # A class of one token has nothing to choose from, and no unseen token either.
        todo = [heaviest[belongs[heaviest] == k] for k in range(SINGLE, CLASSES)]
        todo, bias, steps = [leaves for leaves in todo if len(leaves) > 1], [], []
        for leaves in todo:  # grows below
            outcomes = [leaves[i : i + 1] for i in range(len(leaves) if len(leaves) <= WAYS else ALONE)]
            if len(leaves) > WAYS:
                rest = leaves[ALONE:]
                upto = np.cumsum(mass[rest])
                group = np.minimum((upto - mass[rest] / 2) * ((WAYS - ALONE) / upto[-1]), WAYS - ALONE - 1).astype(np.int64)
                outcomes += [rest[group == g] for g in range(WAYS - ALONE) if (group == g).any()]
            todo += [held for held in outcomes if len(held) > 1]
            row = np.full(WAYS, -np.inf, np.float32)
            row[: len(outcomes)] = [np.log(mass[held].sum()) for held in outcomes]
            steps += [(held, len(bias), digit) for digit, held in enumerate(outcomes)]
            bias.append(row - row.max())
        self.bias = np.array(bias, np.float32).reshape(-1, WAYS)
        leaf = np.concatenate([held for held, _, _ in steps] or [np.zeros(0, np.int64)])
        order = np.argsort(leaf, kind="stable")  # places are numbered from the top down
        counts = [len(held) for held, _, _ in steps]
        self.node = np.repeat(np.array([n for _, n, _ in steps], np.int32), counts)[order]
        self.digit = np.repeat(np.array([d for _, _, d in steps], np.int32), counts)[order]
        self.length = np.bincount(leaf, minlength=len(mass))
        self.start = np.cumsum(self.length) - self.length

    def __call__(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(token's number, place, outcome) for every choice on the way to each token."""
        leaf = np.where(entries["index"] < 0, self.size + entries["class"].astype(np.int64), entries["index"])
        length = self.length[leaf]
        token = np.repeat(np.arange(len(leaf)), length)
        at = np.arange(len(token)) + np.repeat(self.start[leaf] - (np.cumsum(length) - length), length)
        return token, self.node[at], self.digit[at]


class Histories:
    """Tokens of texts with what stands before them."""

    def __init__(self, lexicon: Lexicon, texts: list[list[bytes]]) -> None:
        words: list[bytes] = []
        for text in texts:
            words += (b"", b"", b"")
            words += text
        every = lexicon(words)
        at = np.flatnonzero(every["class"] < CLASSES)
        self.entries = every[at]
        self.words, self.at = words, at
        hashes, classes = every["hash"].copy(), every["class"].copy()
        self.last, self.before = hashes[at - 1], hashes[at - 2]
        gram = (classes[at - 1] * np.uint32(2654435761) + classes[at - 2] * np.uint32(40503) + classes[at - 3]) * np.uint32(2246822519)
        mask, shift = np.uint32(FEATURES - 1), np.uint32(15)
        #: (tokens, TABLES) feature rows of the class layer.
        self.rows = np.column_stack((self.last & mask, self.before & mask, (gram ^ (gram >> shift)) & mask)).astype(np.int64)

    def choices(self, tree: Tree, part: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(token's number, place, outcome, feature rows of the token layer) on the ways to the tokens of ``part``."""
        token, node, digit = tree(self.entries[part])
        last, before = self.last[part][token], self.before[part][token]
        place = (node.astype(np.uint32) + np.uint32(1)) * np.uint32(2654435761)
        both = (last ^ (before * np.uint32(3266489917) + np.uint32(374761393))) * np.uint32(668265263)
        shift = np.uint32(33 - TOKEN_FEATURES.bit_length())
        rows = [((key ^ place) * np.uint32(2246822519) ^ (place >> np.uint32(16))) * np.uint32(3266489917) >> shift for key in (last, before, both)]
        return token, node, digit, np.column_stack(rows).astype(np.int64)


def class_scores(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Unnormalised logarithms of all classes for each row of features; ``LARGEST`` keeps their powers finite."""
    scores = np.take(weights[0], rows[:, 0], axis=0)
    part = np.empty_like(scores)
    for table in range(1, TABLES):
        np.take(weights[table], rows[:, table], axis=0, out=part, mode="clip")
        scores += part
    scores += bias
    return scores


def log_class(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Natural logarithm of the given class's probability for each row of features."""
    found = np.empty(len(rows), np.result_type(weights, bias))
    for part in _parts(len(rows)):
        scores = class_scores(weights, bias if bias.ndim == 1 else bias[part], rows[part])
        own = scores[np.arange(len(scores)), classes[part]]
        found[part] = own - np.log(np.exp(scores, out=scores).sum(1))
    return found


def _parts(size: int) -> Iterator[slice]:
    """Rows at a time that stay in a core's cache."""
    for at in range(0, size, CACHED_ROWS):
        yield slice(at, min(at + CACHED_ROWS, size))


_ROOM: dict[int, np.ndarray] = {}


def _room(slot: int, shape: tuple[int, int], kind: type = np.float32) -> np.ndarray:
    """Memory of this worker for a mini-batch's intermediate values, used again for the next: new pages cost more than the sums."""
    size = shape[0] * shape[1]
    if slot not in _ROOM or len(_ROOM[slot]) < size:
        _ROOM[slot] = np.empty(size, kind)
    return _ROOM[slot][:size].reshape(shape)


def step(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray, classes: np.ndarray, met: np.ndarray | None = None, rate: float = RATE, calm: float = CALM) -> None:
    """One mini-batch of gradient ascent on the log-likelihood, in place; ``met`` counts the uses of rows."""
    if not len(rows):
        return
    features, outcomes = weights.shape[1:]
    # An outcome's numbers lie side by side, as counting bins wants them.
    gradient = _room(0, (outcomes, len(rows)), np.float64)
    for part in _parts(len(rows)):
        scores = class_scores(weights, bias if bias.ndim == 1 else bias[part], rows[part])
        np.exp(scores, out=scores)
        scores *= (-1 / scores.sum(1))[:, None]
        scores[np.arange(len(scores)), classes[part]] += 1
        gradient[:, part] = scores.T
    total = _room(1, (outcomes, features))
    for table in range(TABLES):
        row = np.ascontiguousarray(rows[:, table])
        count = np.bincount(row, minlength=features)
        for outcome, values in enumerate(gradient):
            total[outcome] = np.bincount(row, values, features)
        # Rows that were not met have a total of zero.
        moved = total.T * (rate / (count + calm)).astype(np.float32)[:, None]
        moved += weights[table]
        np.clip(moved, -LARGEST, LARGEST, out=weights[table])
        if met is not None:
            met[table] += count


def untrained() -> list[np.ndarray]:
    """Weights of the class layer and of the token layer."""
    return [np.zeros((TABLES, FEATURES, CLASSES), np.float32), np.zeros((TABLES, TOKEN_FEATURES, WAYS), np.float32)]


def learn(weights: list[np.ndarray], met: list[np.ndarray], seen: Histories, bias: np.ndarray, tree: Tree) -> None:
    """Gradient steps of both layers over the tokens of ``seen``, in place."""
    classes = seen.entries["class"]
    for at in range(0, len(classes), MINI_BATCH):
        part = slice(at, at + MINI_BATCH)
        step(weights[0], bias, seen.rows[part], classes[part], met[0])
        _, node, digit, rows = seen.choices(tree, part)
        step(weights[1], tree.bias[node], rows, digit, met[1], TOKEN_RATE, TOKEN_CALM)


def blocks_of(layer: int) -> tuple[int, int]:
    """Rows of features and numbers a row in a block of a layer's changes; the last number is how often the row was met."""
    return (TABLES * FEATURES // BLOCKS, CLASSES + 1) if layer == 0 else (TABLES * TOKEN_FEATURES // BLOCKS, WAYS + 1)


def trained(texts: DataFrame, lexicon: Callable[[], Lexicon], bias: np.ndarray, tree: Callable[[], Tree], rounds: int = ROUNDS) -> list[np.ndarray]:
    """Weights of both layers. ``texts`` has ``text`` (bytes) and ``round`` (0 to rounds - 1)."""
    weights, context = untrained(), texts.sparkSession.sparkContext
    # A round has a part of every partition; together they make as many tasks as partitions of that size need.
    given = texts.rdd.getNumPartitions()
    tasks = max(1, min(given, context.defaultParallelism), -(-given // rounds))
    for turn in range(rounds):
        sent = context.broadcast(weights)

        def work(source: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            words, own = lexicon(), [w.copy() for w in sent.value]
            met = [np.zeros(w.shape[:2], np.int64) for w in own]
            for batch in batches(source, 2_000_000):
                if batch.num_rows:
                    learn(own, met, Histories(words, [tokens(text) for text in batch.column("text").to_pylist()]), bias, tree())
            blocks, changes = [], []
            for layer, (new, old, times) in enumerate(zip(own, sent.value, met, strict=True)):
                times = times.reshape(-1, 1).astype(np.float32)
                change = np.hstack(((new - old).reshape(len(times), -1) * times, times))
                for i, block in enumerate(np.split(change, BLOCKS)):
                    if block[:, -1].any():
                        blocks.append(layer * BLOCKS + i)
                        changes.append(block.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(changes, pa.binary())], names=["block", "change"])

        def add(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            total = 0.0
            for change in part["change"]:
                total = total + np.frombuffer(change, np.float32).astype(np.float64)
            return pd.DataFrame({"block": [key[0]], "change": [total.astype(np.float32).tobytes()]})

        schema = "block int, change binary"
        changes = texts.where(F.col("round") == turn).select("text").coalesce(tasks).mapInArrow(work, schema)
        if tasks > ADDED:  # two levels, so that no group grows with the number of tasks alone
            salted = changes.withColumn("salt", F.pmod(F.xxhash64("change"), F.lit(-(-tasks // ADDED))).cast("int"))
            changes = salted.groupBy("block", "salt").applyInPandas(add, schema)
        found = changes.groupBy("block").applyInPandas(add, schema).toPandas()
        weights = [w.copy() for w in weights]
        for block, change in zip(found["block"], found["change"], strict=True):
            layer, i = divmod(int(block), BLOCKS)
            size, width = blocks_of(layer)
            total = np.frombuffer(change, np.float32).reshape(size, width)
            weights[layer].reshape(-1, width - 1)[i * size : (i + 1) * size] += total[:, :-1] / np.maximum(total[:, -1:], 1)
        sent.unpersist()
    return weights


def scored(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``."""
    spark = docs.sparkSession
    given = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), text_bytes().alias("text"))
    training = given.where(~F.col("held_out"))
    table = written(counted(training.select("text")), "token-counts")
    # A frequency that at most DICTIONARY tokens reach, from counts per step of the logarithm.
    steps = table.groupBy(F.floor(F.log2("c") * 64).cast("int").alias("s")).count().orderBy(F.desc("s")).toPandas()
    reach = steps["s"][steps["count"].cumsum() <= DICTIONARY].min() if len(steps) else 0
    reach = 0 if pd.isna(reach) else int(reach)
    top = table.where(F.floor(F.log2("c") * 64) >= reach).limit(DICTIONARY).toPandas().sort_values(["c", "token"], ascending=[False, True])
    frequent = spark.sparkContext.broadcast([bytes(t) for t in top["token"]])

    held: dict[str, Lexicon] = {}

    def lexicon() -> Lexicon:
        if "it" not in held:
            held["it"] = Lexicon(frequent.value)
        return held["it"]

    @F.pandas_udf("int")
    def class_of(token: pd.Series) -> pd.Series:
        return token.map(lexicon().class_of)

    sizes = table.groupBy(class_of("token").alias("k")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).toPandas()
    n, v = np.zeros(CLASSES), np.zeros(CLASSES)
    n[sizes["k"]], v[sizes["k"]] = sizes["n"], sizes["v"]
    bias = np.log((n + 0.5) / (n + 0.5).sum()).astype(np.float32)
    whole, different = int(n.sum()), int(v.sum())
    whole_log = float(np.log10(whole + 0.5 * (different + 1)))
    times = top["c"].to_numpy(np.float64)
    counts = np.log10(times + 0.5)
    # What a class holds besides the dictionary: its other tokens and room for one unseen.
    classes = np.array([lexicon().class_of(token) for token in frequent.value], np.int64)
    other = n - np.bincount(classes, times, CLASSES) + 0.5 * (v - np.bincount(classes, minlength=CLASSES) + 1)
    in_other = np.log10(other)
    planted = spark.sparkContext.broadcast(Tree(classes, times + 0.5, other))
    held.clear()  # closures are sent to tasks without it

    turn = F.pmod(F.xxhash64("text"), F.lit(ROUNDS))
    weights = trained(training.select("text", turn.alias("round")), lexicon, bias, lambda: planted.value)
    sent = spark.sparkContext.broadcast((weights, counts))

    def score(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, tree, (own, logs) = lexicon(), planted.value, sent.value
        logs = np.append(logs, 0.0)  # where -1 points to
        for batch in batches(source, 1_000_000):
            texts = [tokens(text) for text in batch.column("text").to_pylist()]
            if not texts:
                continue
            seen = Histories(words, texts)
            index, of, model = seen.entries["index"], seen.entries["class"], np.empty(len(seen.entries))
            for at in range(0, len(of), MINI_BATCH):
                part = slice(at, at + MINI_BATCH)
                model[part] = log_class(own[0], bias, seen.rows[part], of[part])
                token, node, digit, rows = seen.choices(tree, part)
                model[part] += np.bincount(token, log_class(own[1], tree.bias[node], rows, digit), len(of[part]))
            model /= np.log(10)
            model -= np.where(index < 0, in_other[of], 0.0)
            n_tokens = np.array([len(t) for t in texts])
            first = np.cumsum(n_tokens) - n_tokens
            at = np.flatnonzero(index < 0)
            rare = [seen.words[i] for i in seen.at[at].tolist()]
            upto = np.searchsorted(at, np.append(first, len(index))).tolist()
            found = [Counter(rare[a:b]) for a, b in zip(upto[:-1], upto[1:], strict=True)]
            made = [
                pa.array(n_tokens, pa.int64()),
                pa.array(np.add.reduceat(index >= 0, first, dtype=np.int64), pa.int64()),
                pa.array(np.add.reduceat(logs[index], first) - n_tokens * whole_log, pa.float64()),
                pa.array(np.add.reduceat(model, first), pa.float64()),
                pa.array([list(c) for c in found], pa.list_(pa.binary())),
                pa.array([list(c.values()) for c in found], pa.list_(pa.int32())),
            ]
            names = ["doc_id", "held_out", "n_tokens", "frequent", "base", "score", "rare", "times"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *made], names=names)

    schema = "doc_id long, held_out boolean, n_tokens long, frequent long, base double, score double, rare array<binary>, times array<int>"
    parts = written(given.mapInArrow(score, schema).withColumn("row", F.monotonically_increasing_id()), "scores")
    # What the dictionary lacks: each text's tokens meet the table of counts once.
    asked = parts.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("token"), "x.times")
    log = F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5))
    added = (
        asked.join(table, "token", "left")
        .groupBy("row")
        .agg(F.sum(F.col("times") * log).alias("add"), F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("known"))
    )
    whole_rows = parts.drop("rare", "times").join(added, "row", "left")
    more = F.coalesce("add", F.lit(0.0))
    return whole_rows.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("frequent") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(whole).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )
