"""Mixing sources to target weights by Poisson replication.

The target weights give each source a mean repetition rate: its share of the output rows over
its own rows.  A document's number of copies inverts the Poisson distribution of that mean at a
uniform number hashed from (seed, document id), so a retried task, another partitioning
or another engine draws the same count.  Copies are exploded and
shuffled globally: partition and order come from a hash of (seed, id, copy).

Scale: one aggregate by source with a map-side combine and one shuffle of the output.  The per-source table has a row
for each source; it is broadcast only below ``BROADCAST_SOURCES`` rows, beyond that it is joined.  A source with a third of all rows is
only a join key of a broadcast or of a join that AQE splits; the output is dealt by document.

Nulls, ties, repeats: NULL is a source of its own; a NULL doc_id draws from the text 'null'; rows that repeat an id
draw the same count.  Sources without a weight get ``other`` (0 drops them); an empty table stays empty.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rand import uniform
from .common import packed

SEED = "mix-1"
BROADCAST_SOURCES = 100_000
SERIES = 32                 # from here on the logarithm of a factorial is taken from Stirling's series
TEMPERATURE = 0.5


def tempered_weights(docs: DataFrame, temperature: float = TEMPERATURE, source_col: str = "source") -> DataFrame:
    """(source, weight): rows of the source to the power ``temperature``."""
    return docs.groupBy(F.col(source_col).cast("string").alias("source")).agg(
        F.pow(F.count(F.lit(1)).cast("double"), F.lit(temperature)).alias("weight"))


def rates(docs: DataFrame, weights: DataFrame, source_col: str = "source", total: int | None = None,
          other: float = 0.0) -> DataFrame:
    """(source, n, rate): mean repetitions so that the sources' expected rows are in proportion to the
    weights and add up to ``total`` (the number of documents if None).  Weights below 0 or NULL count as 0."""
    counted = docs.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.count(F.lit(1)).alias("n"))
    w = weights.select(F.col("source").cast("string").alias("w_source"),
                       F.greatest(F.col("weight").cast("double"), F.lit(0.0)).alias("weight"))
    joined = counted.join(w, F.col("source").eqNullSafe(F.col("w_source")), "left").select(
        "source", "n", F.coalesce("weight", F.lit(float(other))).alias("weight"))
    whole = joined.agg(F.sum("n").alias("rows"), F.sum("weight").alias("weights")).first()
    rows, sum_w = (total if total is not None else whole["rows"]) or 0, whole["weights"] or 0.0
    rate = F.col("weight") / F.lit(sum_w) * F.lit(float(rows)) / F.col("n") if sum_w else F.lit(0.0)
    return joined.select("source", "n", rate.alias("rate"))


def _log_factorial(k: Column) -> Column:
    """ln k! of a whole number; the series is exact to double precision from ``SERIES`` on."""
    x = F.greatest(k, F.lit(1)).cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * F.pow(x, 3.0)) + 1 / (1260 * F.pow(x, 5.0))
    table = F.array(*[F.lit(math.lgamma(i + 1.0)) for i in range(SERIES)])
    return F.when(k < SERIES, F.element_at(table, F.least(k, F.lit(SERIES - 1)).cast("int") + 1)).otherwise(series)


def poisson_steps(rate: Column) -> tuple[Column, Column]:
    """(first, steps): P(K <= first), P(K <= first + 1), ... as an array, from below which to beyond which the rest is below
    double precision.  Its length follows the square root of the rate; logarithms keep large rates from underflow."""
    spread = F.lit(12.0) * F.sqrt(rate) + F.lit(30.0)
    first = F.greatest(F.floor(rate - spread), F.lit(0)).cast("bigint")
    terms = F.transform(F.sequence(first, F.ceil(rate + spread).cast("bigint")),
                        lambda k: F.exp(k.cast("double") * F.log(rate) - rate - _log_factorial(k)))
    sums = F.aggregate(terms, F.struct(F.array().cast("array<double>").alias("all"), F.lit(0.0).alias("last")),
                       lambda a, x: F.struct(F.concat(a["all"], F.array(a["last"] + x)).alias("all"), (a["last"] + x).alias("last")))["all"]
    some = rate > 0
    return F.when(some, first).otherwise(F.lit(0).cast("bigint")), F.when(some, sums).otherwise(F.array(F.lit(1.0)))


def mix(docs: DataFrame, weights: DataFrame, total: int | None = None, seed: str = SEED, id_col: str = "doc_id",
        source_col: str = "source", other: float = 0.0) -> DataFrame:
    """The copies: columns _row (all columns of the document), copy (1, 2, ...) and place (its random key),
    in global random order within and across partitions."""
    first, steps = poisson_steps(F.col("rate"))
    steps = rates(docs, weights, source_col, total, other).select(F.col("source").alias("r_source"), first.alias("first"), steps.alias("steps"))
    small = steps.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    # the uniform number is drawn before the join, once per document
    rows = packed(docs, key=key, u=uniform(seed, key, F.lit(1)), source=F.col(source_col).cast("string"))
    drawn = rows.join(F.broadcast(steps) if small else steps, F.col("source").eqNullSafe(F.col("r_source")))
    below = F.size(F.filter("steps", lambda c: c <= F.col("u")))
    # nothing lies below the first step but what no double can tell from 0
    copies = F.when(below > 0, (F.col("first") + below).cast("int")).otherwise(F.col("first").cast("int"))
    out = drawn.withColumn("copies", copies).filter("copies > 0").select(
        "_row", "key", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    out = out.select("_row", "copy", F.md5(F.concat_ws("|", F.lit(seed + "-place"), "key", F.col("copy").cast("string"))).alias("place"))
    return out.repartition("place").sortWithinPartitions("place")


def mixed_rows(docs: DataFrame, weights: DataFrame, **kw) -> DataFrame:
    """The mixed corpus with the documents' own columns."""
    return mix(docs, weights, **kw).select("_row.*")
