"""Texts and columns that operators must take as they come: long runs of token characters, helper-like names."""

from __future__ import annotations

import base64
import time

from pyspark.sql import functions as F

from shelfwatch.llm import templates
from shelfwatch.llm.secrets import PATTERNS, VALID, Scanner


def test_long_runs_take_linear_time():
    scan = Scanner()
    for text in (b"eyJ" * 350_000, b"eyJ." * 260_000, b"eyJa.eyJ" * 130_000, b"token" * 200_000, b"password   " * 90_000, b"AKIA" * 260_000):
        start = time.monotonic()
        scan(text)
        assert time.monotonic() - start < 4, text[:8]


def test_web_tokens_equal_the_plain_pattern():
    header = base64.urlsafe_b64encode(b'{"alg":"HS256"}').rstrip(b"=")
    parts = [header, b"eyJ", b"eyJx", b".", b" ", b"eyJhIjoxfQ", b"sig-_9", b"..", b"eyJ.eyJ.eyJ"]
    scan = Scanner()
    for seed in range(3000):
        text = b"".join(parts[(seed * 7919 >> shift) % len(parts)] for shift in range(0, 14))
        expected = [("jwt", m.start(), m.end()) for m in PATTERNS["jwt"].finditer(text) if VALID["jwt"](m)]
        assert [s for s in scan(text) if s[0] == "jwt"] == expected, text


def test_line_dedup_keeps_columns_of_any_name(spark):
    shared = "one line that several of these documents hold in common"
    docs = spark.createDataFrame([(i, f"{shared}\nown words of document {i} alone") for i in range(8)], "doc_id long, text string")
    docs = docs.withColumns({"__key": F.lit("keep"), "__gone": F.lit(3), "__rest": F.lit("mine"), "helper_0": F.lit(4)})
    found = templates.without_recurring(docs).collect()
    assert {tuple(r)[2:6] for r in found} == {("keep", 3, "mine", 4)}
    assert sum(shared in r["text"] for r in found) == 1
