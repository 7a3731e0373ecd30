"""Secrets in texts: keyword automaton, anchored patterns at its hits, embedded checksums.

One Aho-Corasick pass over the lower-cased bytes of a text finds the keywords of all kinds; a pattern
is tried only where its keyword starts. Hexadecimal runs have no keyword: their prefilter looks at
every fourth byte, of which a run of 16 must hold four in a row. Kinds with structure are checked after the match: tokens
that end in a CRC-32 of their body must carry the right one, web tokens must open with a decodable
header, key blocks must hold base64 and a matching end line.

Patterns are case-sensitive but for the assignment keywords. Per kind, matches are leftmost and do
not overlap; a match that fails its length or checksum is dropped after it has taken its place.
Different kinds may overlap. Offsets are code points, the end is exclusive.

Null texts count as empty: no spans. Texts of any length are searched whole, in time that grows with their length:
a run of token characters is read once, however many of its places look like the start of a token. Every row is judged on
its own, so repeated rows repeat. Extra columns are not read. Empty tables give empty results.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwatch.llm.common import batches, text_bytes

#: Kinds in the order in which spans with equal starts are listed.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "key_block")
BASE = KINDS[:3]
LEAST_HEX = 16

#: Kind -> keywords in lower case. Fixed values of public token formats.
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "jwt": ("eyj",),
    "key_block": ("-----begin ",),
}
PATTERNS = {
    "assign": re.compile(
        rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE
    ),
    "access": re.compile(rb"AKIA[A-Z0-9]+"),
    "hex": re.compile(rb"[0-9a-f]+"),
    "github": re.compile(rb"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9_])"),
    "npm": re.compile(rb"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9_])"),
    "jwt": re.compile(rb"(eyJ[A-Za-z0-9_-]++)\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]+"),
    "key_block": re.compile(rb"-----BEGIN ([A-Z ]*)PRIVATE KEY-----([A-Za-z0-9+/=\s]+)-----END \1PRIVATE KEY-----"),
}
#: What a web token's header runs through. Where one hit in a run finds no token, later hits in it find none either.
TOKEN_RUN = re.compile(rb"[A-Za-z0-9_-]+")
_BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True


def crc_digits(body: bytes) -> bytes:
    """Six base-62 digits of the CRC-32 of ``body``, as token formats embed it."""
    value, digits = zlib.crc32(body), []
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits.append(_BASE62[digit])
    return bytes(reversed(digits))


def _checksum(match: re.Match[bytes]) -> bool:
    return crc_digits(match[1]) == match[2]


def _header(match: re.Match[bytes]) -> bool:
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(match[1] + b"=" * (-len(match[1]) % 4)))
    except (ValueError, TypeError):
        return False


def _block(match: re.Match[bytes]) -> bool:
    try:
        return len(base64.b64decode(b"".join(match[2].split()), validate=True)) > 0
    except binascii.Error:
        return False


VALID = {
    "assign": lambda m: len(m[2]) >= 12,
    "access": lambda m: len(m[0]) >= 18,
    "github": _checksum,
    "npm": _checksum,
    "jwt": _header,
    "key_block": _block,
}


def _automaton() -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for word in words:
            made.add_word(word, (kind, len(word)))
    made.make_automaton()
    return made


def _hex_runs(text: bytes) -> Iterator[tuple[int, int]]:
    is_hex = _HEX[np.frombuffer(text, np.uint8)[::4]]
    run = is_hex[:-3] & is_hex[1:-2] & is_hex[2:-1] & is_hex[3:] if len(is_hex) > 3 else is_hex[:0]
    end = 0
    for at in (4 * np.flatnonzero(run)).tolist():
        if at >= end:
            # Four samples may still be parts of several runs: the pattern decides from the first on.
            start = at
            while start > end and _HEX[text[start - 1]]:
                start -= 1
            end = PATTERNS["hex"].match(text, start).end()
            if end - start >= LEAST_HEX:
                yield start, end


class Scanner:
    """Spans (kind, start, end) of one UTF-8 text at a time."""

    def __init__(self) -> None:
        self.keywords = _automaton()

    def __call__(self, text: bytes) -> list[tuple[str, int, int]]:
        spans = [("hex", *run) for run in _hex_runs(text)]
        taken = dict.fromkeys(KINDS, 0)
        # Latin-1 keeps one character per byte, so places are byte offsets. Hits come by their ends.
        hits = sorted((end + 1 - size, kind) for end, (kind, size) in self.keywords.iter(text.lower().decode("latin-1")))
        for start, kind in hits:
            if start < taken[kind]:
                continue
            if match := PATTERNS[kind].match(text, start):
                taken[kind] = match.end()
                if VALID[kind](match):
                    spans.append((kind, start, match.end()))
            elif kind == "jwt" and (run := TOKEN_RUN.match(text, start)):
                taken[kind] = run.end()
        if spans and not text.isascii():
            # Offsets in code points: bytes that start one, counted up to each place.
            starts = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
            place = lambda at: int(starts[at - 1]) if at else 0
            spans = [(kind, place(start), place(end)) for kind, start, end in spans]
        return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: Iterable[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def found(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, counts of the base kinds, digest of base spans, all spans."""

    def scan(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches(source):
            spans = [scanner(text.as_py()) for text in batch.column("text")]
            base = [[s for s in row if s[0] in BASE] for row in spans]
            counts = [pa.array([sum(s[0] == kind for s in row) for row in base], pa.int64()) for kind in BASE]
            digests = [hashlib.sha256(joined(row).encode()).hexdigest() for row in base]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *counts, pa.array(digests, pa.string()), pa.array(map(joined, spans), pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text")).mapInArrow(scan, schema)
