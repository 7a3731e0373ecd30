"""Mixing sources to target weights by Poisson replication (native expressions only).

A source with mass ``m`` (characters, plus one per document for its end mark) out of ``M`` and
weight ``w`` out of ``W`` is repeated at the rate ``M * w / (W * m)``. A document's number of copies
is the inverse of the Poisson distribution with that mean at a uniform number hashed from its id, so
a rerun, or a lost executor, gives the same copies. Copies are exploded and sorted globally by a
hashed key. Weights are ``floor(1000 * mass ** temperature)`` or given numbers per source.

The thresholds of the distribution are made once per source, an array whose length grows with the
square root of the rate only: rates above ``RATE_PART`` are drawn as sums of equal parts.

A null source is a source of its own. A null id is hashed by its text. Repeated rows get equal
numbers of copies, each. Empty texts have mass one. Extra columns pass through; columns called
``n_copies``, ``copy`` or ``shuffle_key`` are replaced. Empty tables give empty results.

Drawn rows are written once, so neither join nor draw is repeated for the sample of the global sort, and their
place in the written files is the last sort key: any number of equal rows spreads over many partitions.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwatch.llm.common import free_names, written

#: Largest mean that one inversion handles.
RATE_PART = 64
#: Sources up to this number are broadcast (under 3 kB each); more are joined by a shuffle.
BROADCAST_SOURCES = 5_000
SEED = "mix-1"


def _hashed(*parts: Column) -> Column:
    """48 bits of a hash of the parts."""
    digest = F.md5(F.concat_ws("|", F.lit(SEED), *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")


def _uniform(*parts: Column) -> Column:
    return (_hashed(*parts) + F.lit(0.5)) / F.lit(float(2**48))


def _thresholds(mean: Column) -> Column:
    """P(X <= k) of the Poisson distribution for k from 0 to where the rest is below 1e-20."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 20).cast("int")
    first = F.exp(-mean)
    start = F.struct(first.alias("p"), first.alias("total"), F.array(first).alias("upto"))

    def add(state: Column, k: Column) -> Column:
        p = state["p"] * mean / k
        total = state["total"] + p
        return F.struct(p.alias("p"), total.alias("total"), F.concat(state["upto"], F.array(total)).alias("upto"))

    return F.aggregate(F.sequence(F.lit(1), last), start, add, lambda s: s["upto"])


def rates(
    docs: DataFrame, weights: Mapping[str | None, float] | None = None, temperature: float = 0.5
) -> DataFrame:
    """One row per source: ``source``, ``rate``, ``parts`` and the thresholds of one part.

    With ``weights``, sources that it does not name get weight zero and so no copies.
    """
    mass = F.char_length(F.coalesce("text", F.lit(""))).cast("long") + 1
    per_source = docs.groupBy("source").agg(F.sum(mass).alias("mass"))
    if weights is None:
        weight = F.floor(1000 * F.pow(F.col("mass").cast("double"), F.lit(temperature))).cast("long")
    else:
        weight = F.lit(0)
        for source, value in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(source)), F.lit(round(1000 * value))).otherwise(weight)
    per_source = per_source.withColumn("weight", weight.cast("long"))
    totals = per_source.agg(F.sum("mass").alias("m"), F.sum("weight").alias("w")).first()
    whole, all_weights = totals["m"] or 0, totals["w"] or 1
    rate = F.lit(float(whole)) * F.col("weight") / (F.lit(float(all_weights)) * F.col("mass"))
    parts = F.greatest(F.ceil(F.col("rate") / RATE_PART), F.lit(1)).cast("int")
    return (
        per_source.withColumn("rate", rate)
        .withColumn("parts", parts)
        .select("source", "rate", "parts", _thresholds(F.col("rate") / F.col("parts")).alias("upto"))
    )


def mixed(
    docs: DataFrame, weights: Mapping[str | None, float] | None = None, temperature: float = 0.5
) -> DataFrame:
    """Copies of ``docs`` in shuffled order, with ``n_copies``, ``copy`` (from 1) and ``shuffle_key``."""
    plain = docs.drop("n_copies", "copy", "shuffle_key")
    source, parts, upto, key, place = free_names(plain, 5)
    per_source = rates(docs, weights, temperature).select(
        F.col("source").alias(source), F.col("parts").alias(parts), F.col("upto").alias(upto)
    )
    if per_source.select(source).limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        per_source = F.broadcast(per_source)
    identity = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))
    drawn = F.transform(
        F.sequence(F.lit(1), F.col(parts)),
        lambda part: F.size(F.filter(upto, lambda share: share < _uniform(F.lit("count"), part, F.col(key)))),
    )
    counted = (
        plain.withColumn(key, identity)
        .join(per_source, F.col("source").eqNullSafe(F.col(source)))
        .withColumn("n_copies", F.aggregate(drawn, F.lit(0), lambda total, n: total + n).cast("long"))
        .where("n_copies > 0")
        .drop(source, parts, upto)
    )
    placed = written(counted, "drawn").withColumn(place, F.monotonically_increasing_id())
    copies = placed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n_copies")))
    keyed = copies.withColumn("shuffle_key", _hashed(F.lit("order"), F.col(key), F.col("copy")))
    ordered = keyed.orderBy("shuffle_key", "doc_id", "copy", place)
    return ordered.select(*plain.columns, "n_copies", "copy", "shuffle_key")
