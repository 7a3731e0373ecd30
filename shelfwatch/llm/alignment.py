"""Tokens of two vocabularies aligned over the same bytes: shared cuts, groups, links and their counts.

Each text is encoded twice. An interval of tokens whose ends both vocabularies share is divided at a common
end near its middle, found by bisecting the other side's ends, and both halves are divided in turn; an
interval without a common end inside is a group. All intervals of a batch of texts are divided at once, one
level after the other, and where the middle is no common end, rings of doubling width around it are
tried, so a level costs a few array operations.

A link is a pair of token occurrences of one group. A pair of ids counts the documents that hold it linked.
Counts are added up by Spark; the ``HOT_PAIRS`` most frequent pairs (a bounded broadcast) meet the texts' pairs
in place, all rarer ones by a join.

Side A reads a space and the text with a byte-level vocabulary, side B the text with a piece vocabulary that puts the
space itself. Strings of special tokens are plain text. Null and empty texts, and texts whose bytes one of
the sides does not give back, have no tokens: zeros and an empty digest. Repeated rows are documents of their own. Null ids are kept.
Extra columns are not read. Empty tables give empty results. Texts of any length are aligned whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfwatch.llm.common import batches, text_bytes, written
from shelfwatch.llm.tokens import vocabulary

#: Segments kept in a worker's memo before it starts anew; bounds its memory, changes no result.
MEMO_SEGMENTS = 300_000
#: Pairs of ids whose counts every task gets (8 MB); all others are joined.
HOT_PAIRS = 1 << 19
#: Pairs of ids counted at once in a task.
COUNT_STEP = 4_000_000
#: Products of a group's two sides up to this size are written out; larger groups go by their distinct ids.
PRODUCT = 1 << 12

ALIGNED = "doc_id long, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"

#: Neither vocabulary has an entry across these places: a single space before a visible ASCII sign or a letter.
_CUT = re.compile(r"(?<! )(?= [!-~\w])")


def byte_alphabet() -> dict[str, int]:
    """The printable character that a byte-level vocabulary writes for each byte, reversed."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def byte_side(path: str) -> tuple[list[bytes], Callable[[str], np.ndarray]]:
    """Bytes of each id, and ids of a text (special tokens' strings as plain text)."""
    tokenizer, alphabet = Tokenizer.from_file(path), byte_alphabet()
    tokenizer.encode_special_tokens = True
    pieces = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size())]
    table = [bytes(alphabet[c] for c in p) if all(c in alphabet for c in p) else p.encode() for p in pieces]
    return table, lambda text: np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)


def piece_side(path: str) -> tuple[list[bytes], Callable[[str], np.ndarray]]:
    """Bytes of each id, and ids of a text that starts with a space, which the vocabulary puts itself."""
    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    size = processor.vocab_size()
    pieces = [processor.id_to_piece(i) for i in range(size)]
    if any(re.search("[^▁]▁", p) for p in pieces):
        raise ValueError("the vocabulary has pieces across spaces")
    table = [bytes([int(p[3:5], 16)]) if processor.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    return table, lambda text: np.array(processor.encode(text[1:]), np.int64)


class Side:
    """Ids of segments in one vocabulary: all met so far in one pool, each by its place in it."""

    def __init__(self, table: list[bytes], encode: Callable[[str], np.ndarray]) -> None:
        self.table, self.encode = table, encode
        self.sizes = np.array([len(t) for t in table], np.int64)
        self.forget()

    def forget(self) -> None:
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0
        #: Per segment: first place in the pool and number of ids, none where they do not give back its bytes.
        self.first, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _keep(self, ids: np.ndarray, counts: np.ndarray) -> None:
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool[: self.used], np.zeros(self.used + 2 * len(ids), np.int32)))
        self.pool[self.used : self.used + len(ids)] = ids
        self.first = np.concatenate((self.first, self.used + np.cumsum(counts) - counts))
        self.count = np.concatenate((self.count, counts))
        self.used += len(ids)

    def learn(self, segments: list[str], sizes: np.ndarray) -> None:
        """Add segments, none of them empty, of ``sizes`` bytes: many are encoded at once."""
        whole, stops = "".join(segments), np.cumsum(sizes)
        ids = self.encode(whole)
        ends = np.cumsum(self.sizes[ids])
        cuts = np.searchsorted(ends, stops)
        joined = b"".join(map(self.table.__getitem__, ids.tolist()))
        if joined == whole.encode() and (ends[cuts] == stops).all():
            self._keep(ids, np.diff(cuts, prepend=-1))
            return
        for s in segments:  # some segment's bytes are changed: each on its own
            ids = self.encode(s)
            same = b"".join(map(self.table.__getitem__, ids.tolist())) == s.encode()
            self._keep(ids if same else ids[:0], np.array([len(ids) if same else 0]))

    def ids(self, places: np.ndarray) -> np.ndarray:
        """Ids of segments in turn."""
        return self.pool[_ragged(self.first[places], self.count[places])].astype(np.int64)


def divided(a_ends: np.ndarray, b_ends: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Last tokens of every group: indices into ``a_ends`` and, of the same group, into ``b_ends``.

    Both arrays rise strictly. ``starts`` are the first A tokens of the texts, whose ends both sides share.
    """
    low = starts.astype(np.int64)
    high = np.append(low[1:], len(a_ends))  # a text's tokens are low .. high - 1, the last one ends at a shared cut
    last_a = [high - 1]
    low, high = low[high - low > 1], high[high - low > 1]
    while len(low):
        middle = (low + high - 2) // 2
        ends = a_ends[middle]
        cut = np.where(b_ends[np.searchsorted(b_ends, ends)] == ends, middle, -1)
        open_, inner, outer = np.flatnonzero((cut < 0) & (high - low > 2)), 0, 1
        while len(open_):
            # The ring of ends more than `inner` and at most `outer` away from the middle.
            lo, hi, mid = low[open_], high[open_] - 2, middle[open_]
            left = np.maximum(mid - outer, lo), mid - inner - 1
            right = mid + inner + 1, np.minimum(mid + outer, hi)
            firsts = np.concatenate((left[0], right[0]))
            counts = np.maximum(0, np.concatenate((left[1], right[1])) - firsts + 1)
            total = np.cumsum(counts)
            owner = np.repeat(np.arange(len(counts)), counts)
            tried = np.arange(len(owner)) - np.repeat(total - counts, counts) + firsts[owner]
            ends = a_ends[tried]
            common = b_ends[np.searchsorted(b_ends, ends)] == ends
            tried, owner = tried[common], owner[common] % len(open_)
            # Of the common ends the nearest wins, of two equally near ones the left.
            nearest = np.lexsort((tried, np.abs(tried - mid[owner]), owner))
            owner, tried = owner[nearest], tried[nearest]
            first = np.append(True, owner[1:] != owner[:-1])[: len(owner)]
            cut[open_[owner[first]]] = tried[first]
            more = (cut[open_] < 0) & ((mid - outer > lo) | (mid + outer < hi))
            open_, inner, outer = open_[more], outer, 2 * outer + 1
        found = cut >= 0
        low, high, cut = low[found], high[found], cut[found]
        last_a.append(cut)
        # Halves side by side: intervals stay in order, so neighbouring searches share memory.
        low, high = np.stack((low, cut + 1), 1).ravel(), np.stack((cut + 1, high), 1).ravel()
        low, high = low[high - low > 1], high[high - low > 1]
    last_a = np.sort(np.concatenate(last_a))
    return last_a, np.searchsorted(b_ends, a_ends[last_a])


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``start, start + 1, ...`` for each start, as many as its count."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts - starts, counts)


class Aligner:
    """Alignment of batches of texts in one worker."""

    def __init__(self, a_path: str, b_path: str) -> None:
        self.a, self.b = Side(*byte_side(a_path)), Side(*piece_side(b_path))
        self.places: dict[str, int] = {}
        self.width, self.b_size = max(len(self.a.table), len(self.b.table)), len(self.b.table)
        #: Numbers followed by a comma, a bar or a semicolon, filled up with zero bytes.
        self.words = np.array([f"{i}{mark}".encode() for mark in ",|;" for i in range(self.width)])

    def _places(self, segments: list[str]) -> np.ndarray:
        """Places of segments; those not met before are learnt on both sides."""
        if len(self.places) > MEMO_SEGMENTS:
            self.places = {}
            self.a.forget()
            self.b.forget()
        found = list(map(self.places.get, segments))
        if None in found:
            new = list({s for s, at in zip(segments, found, strict=True) if at is None})
            self.places.update(zip(new, range(len(self.places), len(self.places) + len(new)), strict=True))
            for at in range(0, len(new), 2_000):
                part = new[at : at + 2_000]
                sizes = np.array([len(s.encode()) for s in part])
                self.a.learn(part, sizes)
                self.b.learn(part, sizes)
            found = list(map(self.places.__getitem__, segments))
        return np.array(found, np.int64)

    def __call__(self, texts: list[str]) -> list[tuple]:
        """(n_a, n_b, n_groups, n_links, digest, pairs, times) of each text; pairs as ``a * b_size + b``."""
        out: list[tuple] = [(0, 0, 0, 0, "", b"", b"")] * len(texts)
        segments = [list(filter(None, _CUT.split(" " + t))) if t else [] for t in texts]
        places = self._places(list(chain.from_iterable(segments)))
        owner = np.repeat(np.arange(len(texts)), [len(own) for own in segments])
        changed = np.zeros(len(texts), bool)
        changed[owner[(self.a.count[places] == 0) | (self.b.count[places] == 0)]] = True
        places, owner = places[~changed[owner]], owner[~changed[owner]]
        good, owner = np.unique(owner, return_inverse=True)
        if not len(good):
            return out
        a, b = self.a.ids(places), self.b.ids(places)
        a_counts, b_counts = (np.bincount(owner, weights=side.count[places]).astype(np.int64) for side in (self.a, self.b))
        a_starts = np.cumsum(a_counts) - a_counts
        last_a, last_b = divided(np.cumsum(self.a.sizes[a]), np.cumsum(self.b.sizes[b]), a_starts)
        first_a, first_b = np.append(0, last_a[:-1] + 1), np.append(0, last_b[:-1] + 1)
        n_a, n_b = last_a - first_a + 1, last_b - first_b + 1
        text = np.searchsorted(a_starts, first_a, side="right") - 1
        groups = np.bincount(text, minlength=len(good))
        links = np.bincount(text, weights=(n_a * n_b).astype(float), minlength=len(good)).astype(np.int64)
        spelled = self._spelled(a, b, n_a, n_b)
        text_words = np.append(0, np.cumsum(a_counts + b_counts))
        keys, times = self._pairs(a, b, first_a, first_b, n_a, n_b, text)
        bounds = np.searchsorted(keys >> 32, np.arange(len(good) + 1))
        pairs, times = (keys & 0xFFFFFFFF).astype("<u4"), times.astype("<u4")
        for k, i in enumerate(good.tolist()):
            own = slice(bounds[k], bounds[k + 1])
            line = spelled[text_words[k] : text_words[k + 1]].tobytes().translate(None, b"\0")
            digest = hashlib.sha256(line[:-1]).hexdigest()  # nothing follows the last number of a text
            out[i] = (int(a_counts[k]), int(b_counts[k]), int(groups[k]), int(links[k]), digest, pairs[own].tobytes(), times[own].tobytes())
        return out

    def _spelled(self, a, b, n_a, n_b) -> np.ndarray:
        """Every number with its separator, group by group: A's, then B's."""
        before = np.cumsum(n_a + n_b) - n_a - n_b
        order = np.empty(len(a) + len(b), np.int64)
        order[_ragged(before, n_a)] = a
        order[_ragged(before + n_a, n_b)] = b
        order[before + n_a - 1] += self.width
        order[before + n_a + n_b - 1] += 2 * self.width
        return self.words[order]

    def _pairs(self, a, b, first_a, first_b, n_a, n_b, text) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct ``text << 32 | pair`` and how often each is linked."""
        plain = n_a * n_b <= PRODUCT
        rows = np.repeat(first_a[plain], n_a[plain]), np.repeat(n_b[plain], n_a[plain]), np.repeat(first_b[plain], n_a[plain])
        left = np.repeat(a[_ragged(first_a[plain], n_a[plain])], rows[1])
        right = b[_ragged(rows[2], rows[1])]
        owner = np.repeat(np.repeat(text[plain], n_a[plain]), rows[1])
        keys, times = np.unique((owner << 32) | (left * self.b_size + right), return_counts=True)
        parts = [(keys, times)]
        for g in np.flatnonzero(~plain).tolist():
            x, of_x = np.unique(a[first_a[g] : first_a[g] + n_a[g]], return_counts=True)
            y, of_y = np.unique(b[first_b[g] : first_b[g] + n_b[g]], return_counts=True)
            own = (x[:, None] * self.b_size + y[None, :]).ravel()
            parts.append(((text[g] << 32) | own, (of_x[:, None] * of_y[None, :]).ravel()))
        if len(parts) == 1:
            return keys, times
        keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        summed = np.zeros(len(keys), np.int64)
        np.add.at(summed, at, np.concatenate([t for _, t in parts]))
        return keys, summed


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """This worker's aligner, kept from task to task."""
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
    return _ALIGNERS[a_path, b_path]


def aligned(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """Rows of ``ALIGNED``: each text's groups, its distinct linked pairs and how often it has each."""
    a_path = a_path or vocabulary("byte_bpe_50k.json")
    b_path = b_path or vocabulary("piece_bpe_32k.model")

    def align(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = aligner(a_path, b_path)
        if len(run.a.table) * len(run.b.table) > 1 << 32:
            raise ValueError("the vocabularies are too large for pairs of 32 bits")
        for batch in batches(source, 1_500_000):
            rows = run([t.decode("utf-8", "replace") for t in batch.column("text").to_pylist()])
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names=[part.split()[0] for part in ALIGNED.split(", ")],
            )

    given = docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row"), text_bytes().alias("text"))
    return given.mapInArrow(align, ALIGNED)


def pair_counts(rows: DataFrame, b_size: int) -> DataFrame:
    """(pair, n, best): documents that hold a pair linked; ``best`` if no pair of its A id has more."""

    def count(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flushed() -> Iterator[pa.RecordBatch]:
            pair, n = np.unique(np.concatenate(held), return_counts=True)
            for at in range(0, len(pair), 500_000):
                yield pa.RecordBatch.from_arrays([pa.array(pair[at : at + 500_000].astype(np.int64)), pa.array(n[at : at + 500_000])], names=["pair", "n"])

        for batch in source:
            for value in batch.column("pairs"):
                held.append(np.frombuffer(value.as_py(), "<u4"))
                size += len(held[-1])
                if size >= COUNT_STEP:
                    yield from flushed()
                    held, size = [], 0
        if held:
            yield from flushed()

    counts = rows.where("n_links > 0").select("pairs").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = written(counts, "pair-counts")
    a = F.floor(F.col("pair") / b_size)
    most = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    return written(counts.withColumn("a", a).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")


def _hot(pairs: DataFrame, limit: int = HOT_PAIRS) -> tuple[int, np.ndarray, np.ndarray]:
    """(least count, pairs, counts * 2 + best) of the most frequent pairs, ``limit`` at most."""
    # Counts fall into cells a sixteenth of a doubling wide, so the least count follows from a few hundred sums.
    cell = F.floor(F.log2("n") * 16)
    sizes = pairs.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("least")).orderBy(F.desc("cell")).collect()
    least, room = (1 << 62), limit
    for row in sizes:
        room -= row["rows"]
        if room < 0:
            break
        least = row["least"]

    def pack(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            value = batch.column("n").to_numpy() * 2 + batch.column("best").to_numpy(zero_copy_only=False)
            data = batch.column("pair").to_numpy().astype("<i8").tobytes(), value.astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.binary()) for d in data], names=["pair", "value"])

    parts = pairs.where(F.col("n") >= least).mapInArrow(pack, "pair binary, value binary").collect()
    pair, value = (np.frombuffer(b"".join(p[name] for p in parts), "<i8") for name in ("pair", "value"))
    order = np.argsort(pair)
    return least, pair[order], value[order]


def links(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per document."""
    rows = written(aligned(docs, a_path, b_path), "aligned")
    b_size = sentencepiece.SentencePieceProcessor(model_file=b_path or vocabulary("piece_bpe_32k.model")).vocab_size()
    pairs = pair_counts(rows, b_size)
    least, hot, values = _hot(pairs, hot_pairs)
    shared = docs.sparkSession.sparkContext.broadcast((hot, values))
    own = [part.split()[0] for part in ALIGNED.split(", ")][:7]

    def look_up(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, values = shared.value
        for batch in source:
            best, total, rare, rare_times = [], [], [], []
            for pairs, times in zip(batch.column("pairs"), batch.column("times"), strict=True):
                pairs, times = np.frombuffer(pairs.as_py(), "<u4").astype(np.int64), np.frombuffer(times.as_py(), "<u4").astype(np.int64)
                at = np.minimum(np.searchsorted(hot, pairs), max(0, len(hot) - 1))
                known = hot[at] == pairs if len(hot) else np.zeros(len(pairs), bool)
                value = values[at[known]] if len(hot) else np.zeros(0, np.int64)
                best.append(int((times[known] * (value & 1)).sum()))
                total.append(int((times[known] * (value >> 1)).sum()))
                rare.append(pairs[~known])
                rare_times.append(times[~known])
            kinds = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in own), pa.array(best, pa.int64()), pa.array(total, pa.int64()), pa.array(rare, kinds), pa.array(rare_times, kinds)],
                names=[*own, "best", "total", "rare", "rare_times"],
            )

    schema = ", ".join(ALIGNED.split(", ")[:7]) + ", best long, total long, rare array<long>, rare_times array<long>"
    known = written(rows.mapInArrow(look_up, schema), "known-links")
    each = known.select("row", F.explode(F.arrays_zip("rare", "rare_times")).alias("r")).select("row", F.col("r.rare").alias("pair"), F.col("r.rare_times").alias("times"))
    counted = each.join(pairs.where(F.col("n") < least), "pair")
    more = counted.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more"))
    zero = lambda name: F.coalesce(F.col(name), F.lit(0))
    return known.drop("rare", "rare_times").join(more, "row", "left").select(
        "doc_id",
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        (F.col("best") + zero("more_best")).alias("n_best"),
        (F.col("total") + zero("more")).alias("count_sum"),
        "groups_sha256",
    )
