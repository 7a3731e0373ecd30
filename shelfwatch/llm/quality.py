"""Quality rules with thresholds learned per language and source (native expressions only).

Each document gets integer measures. Every measure is put on an integer grid, and the counts per
(language, source, measure, grid cell) are a quantile sketch: cells are fixed, so sketches of any
parts merge by adding counts, partial sums happen before the shuffle, and a group never holds more
rows per measure than the grid has cells, whatever share of the documents it has. Cells are single values up to
255 and 128 to each doubling above, so no value is too large for the grid.

A limit is an upper quantile of the group plus ``reach`` times its distance from the median, mirrored below for
the word length. Each quantile is drawn towards that of the language, and the language's towards that of all
documents, with the weight of ``SHRINK`` documents, so that small groups follow their language by degrees. A
``least`` distance from the median keeps groups without spread from rejecting documents that hardly differ.

Null texts count as empty. Null languages and sources are groups of their own. Repeated rows are
judged alike, each on its own. Extra columns are passed through; ``judged`` replaces columns named like a measure or
verdict, ``kept_documents`` returns all columns as they came. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from shelfwatch.llm.common import SPACE, free_names, let, written

#: Words of a window when repeats are looked for.
WINDOW = 8
#: Base rules.
LEAST_WORDS, REPEATED_PERCENT = 20, 30
#: Documents with the language's quantiles that every group is mixed with.
SHRINK = 200
#: Measure -> (numerator, denominator, grid units, upper quantile in thousandths, reach, least distance, two-sided).
RULES = {
    "symbols": ("n_symbols", "word_chars", 1000, 950, 1, 20, False),
    "dup_lines": ("n_dup_lines", "n_lines", 1000, 995, 0, 100, False),
    "repeats": ("n_repeat_words", "n_words", 1000, 995, 0, 80, False),
    "word_length": ("word_chars", "n_words", 10, 950, 2, 10, True),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _words(text: Column) -> Column:
    inner = F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, f"[{SPACE}]+"))


def _pairs(values: Column, step: int) -> Column:
    """Hash of each value with the one ``step`` places later; as long as both exist."""
    return let(
        values,
        lambda v: F.zip_with(
            F.slice(v, F.lit(1), F.greatest(F.size(v) - step, F.lit(0))),
            F.slice(v, F.lit(step + 1), F.greatest(F.size(v) - step, F.lit(0))),
            lambda a, b: F.xxhash64(a, b),
        ),
    )


def _repeated(hashes: Column) -> Column:
    """Words inside windows whose hash occurs twice or more, from the hash of each window."""

    def covered(places: Column) -> Column:
        after = F.slice(places, F.lit(2), F.size(places))
        gaps = F.zip_with(places, after, lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap)

    def places(ordered: Column) -> Column:
        twice = F.filter(
            ordered,
            lambda w, i: F.coalesce(F.get(ordered, i - 1)["h"] == w["h"], F.lit(False))
            | F.coalesce(F.get(ordered, i + 1)["h"] == w["h"], F.lit(False)),
        )
        return F.array_sort(F.transform(twice, lambda w: w["i"]))

    entries = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    found = let(F.sort_array(entries), lambda ordered: let(places(ordered), covered))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(found)


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` plus ``MEASURES`` as long columns. Windows are compared by 64-bit hashes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(f"[^{SPACE}]"))
    plain = docs.drop(*MEASURES)
    word_list, line_list = free_names(plain, 2)
    df = plain.withColumns({word_list: _words(text), line_list: lines})
    hashes = F.transform(word_list, lambda w: F.xxhash64(w))
    for step in (1, 2, 4):
        hashes = _pairs(hashes, step)
    counts = {
        "n_words": F.size(word_list),
        "word_chars": F.char_length(F.array_join(word_list, "")),
        "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")),
        "n_lines": F.size(line_list),
        "n_dup_lines": F.size(line_list) - F.size(F.array_distinct(line_list)),
        "n_repeat_words": let(hashes, _repeated),
    }
    return df.withColumns({k: v.cast("long") for k, v in counts.items()}).drop(word_list, line_list)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words")
    )


def _value(rule: str) -> Column:
    """The measure in grid units, rounded down."""
    top, bottom, scale, *_ = RULES[rule]
    return F.expr(f"{top} * {scale} div greatest({bottom}, 1)")


def _cell(value: Column) -> Column:
    """Grid cell of a value: itself below 256, then 128 cells to each doubling."""
    shift = F.greatest(F.length(F.bin(value)) - 8, F.lit(0))
    return (shift * 128 + F.call_function("shiftright", value, shift)).cast("int")


def _largest(cell: Column) -> Column:
    """Largest value of a cell."""
    shift = F.greatest(F.floor(cell / 128) - 1, F.lit(0)).cast("int")
    return F.call_function("shiftleft", (cell - shift * 128 + 1).cast("long"), shift) - 1


def sketches(measures: DataFrame) -> DataFrame:
    """Counts per (lang, source, rule, cell) over documents that pass the base rules."""
    entries = F.array(*[F.struct(F.lit(r).alias("rule"), _cell(_value(r)).alias("cell")) for r in RULES])
    return (
        measures.where(~base_failed())
        .select("lang", "source", F.inline(entries))
        .groupBy("lang", "source", "rule", "cell")
        .agg(F.count(F.lit(1)).alias("docs"))
    )


def limits(sketch: DataFrame) -> DataFrame:
    """One row per (lang, source, rule): ``low`` and ``high`` in grid units, and ``at_least`` where the least distance decided."""
    merged = sketch.rollup("rule", "cell", "lang", "source").agg(
        F.sum("docs").alias("docs"), F.grouping_id().alias("level")
    )
    merged = merged.where(F.col("level").isin(0, 1, 3))
    group = Window.partitionBy("level", "lang", "source", "rule")
    ranked = merged.withColumns(
        {
            "total": F.sum("docs").over(group),
            "upto": F.sum("docs").over(group.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)),
        }
    )
    by_rule = lambda place: F.create_map(*[F.lit(x) for r, v in RULES.items() for x in (r, v[place])])[F.col("rule")]
    quantile = lambda share: _largest(F.min(F.when(1000 * F.col("upto") >= share * F.col("total"), F.col("cell"))))
    ranked = ranked.withColumn("share", by_rule(3))
    found = ranked.groupBy("level", "lang", "source", "rule").agg(
        F.max("total").alias("n"),
        F.struct(
            quantile(1000 - F.col("share")).alias("low"), quantile(F.lit(500)).alias("mid"), quantile(F.col("share")).alias("high")
        ).alias("q"),
    )
    own = found.where("level = 0").select("lang", "source", "rule", "n", "q")
    of_lang = found.where("level = 1").select(F.col("lang").alias("l"), F.col("rule").alias("lr"), F.col("n").alias("ln"), F.col("q").alias("lq"))
    of_all = found.where("level = 3").select(F.col("rule").alias("ar"), F.col("q").alias("aq")).limit(len(RULES))  # one row per rule
    joined = own.join(of_lang, F.col("lang").eqNullSafe(F.col("l")) & (F.col("rule") == F.col("lr"))).join(
        F.broadcast(of_all), F.col("rule") == F.col("ar")
    )

    def drawn(part: str) -> Column:
        lang = F.col("ln") * F.col(f"lq.{part}") + SHRINK * F.col(f"aq.{part}")
        lang = F.floor(lang / (F.col("ln") + SHRINK))
        return F.floor((F.col("n") * F.col(f"q.{part}") + SHRINK * lang) / (F.col("n") + SHRINK))

    reach, least = by_rule(4), by_rule(5)
    smooth = joined.select("lang", "source", "rule", *[drawn(part).alias(part) for part in ("low", "mid", "high")])
    above = F.col("high") + reach * (F.col("high") - F.col("mid")) - F.col("mid")
    below = F.col("mid") - F.col("low") + reach * (F.col("mid") - F.col("low"))
    return smooth.select(
        "lang",
        "source",
        "rule",
        (F.col("mid") - F.greatest(below, least)).alias("low"),
        (F.col("mid") + F.greatest(above, least)).alias("high"),
        (above <= least).alias("at_least"),
    )


def judged(docs: DataFrame) -> DataFrame:
    """``docs`` plus measures, ``base_failed`` and ``kept``.

    The measures are written once, because limits and filter both need them. The joined
    limits have one row per (language, source); adaptive execution splits a hot source.
    """
    plain = docs.drop("base_failed", "kept", *MEASURES)
    lang, source, *bounds = free_names(plain, 2 + len(RULES))
    measures = written(measured(plain), "quality")
    per_group = limits(sketches(measures)).groupBy(F.col("lang").alias(lang), F.col("source").alias(source)).agg(
        *[F.max(F.when(F.col("rule") == r, F.struct("low", "high"))).alias(b) for r, b in zip(RULES, bounds, strict=True)]
    )
    within = F.lit(True)
    for (rule, (*_, two_sided)), bound in zip(RULES.items(), bounds, strict=True):
        value = _value(rule)
        within = within & (value <= F.col(bound)["high"]) & ((value >= F.col(bound)["low"]) if two_sided else F.lit(True))
    joined = measures.join(
        per_group, F.col("lang").eqNullSafe(F.col(lang)) & F.col("source").eqNullSafe(F.col(source)), "left"
    )
    return joined.select(
        *plain.columns,
        *MEASURES,
        base_failed().alias("base_failed"),
        (~base_failed() & F.coalesce(within, F.lit(True))).alias("kept"),
    )


def kept_documents(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` that the rules keep, with their columns unchanged."""
    clashing = [c for c in docs.columns if c.lower() in (*MEASURES, "base_failed", "kept")]
    aside = dict(zip(clashing, free_names(docs, len(clashing)), strict=True))
    good = judged(docs.withColumnsRenamed(aside)).where("kept")
    return good.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])
