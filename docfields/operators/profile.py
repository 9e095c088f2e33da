"""Profiles of columns and of extraction results: counts, quantiles, histograms, rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as N


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """(column, n) of non-null values; ``top`` keeps the most frequent, ties by value."""
    out = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return out.orderBy(F.desc("n"), column).limit(top) if top else out


def distinct_count(df: DataFrame, *columns: str, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(*[count(c).alias(f"n_{c}") for c in columns])


def missing_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n_missing, share): one pass, then the single row is turned."""
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull() | (F.col(c).cast("string") == "")).alias(c) for c in columns])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_missing"), F.round(F.try_divide(F.col(c).cast("double"), F.col("_n")), 6).alias("share")) for c in columns])
    return one.select(F.inline(cells))


def describe(df: DataFrame, column: str, scale: int = 4) -> DataFrame:
    """count, mean, sample deviation, minimum, quartiles (linear between neighbours), maximum."""
    c = F.col(column).cast("double")
    q = F.percentile(c, [0.25, 0.5, 0.75])
    return df.agg(
        F.count(c).alias("n"), F.round(F.avg(c), scale).alias("mean"), F.round(F.stddev_samp(c), scale).alias("std"), F.round(F.min(c), scale).alias("min"),
        F.round(q[0], scale).alias("q25"), F.round(q[1], scale).alias("q50"), F.round(q[2], scale).alias("q75"), F.round(F.max(c), scale).alias("max"),
    )


def histogram(df: DataFrame, column: Column, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n): equal bins from 1; the last one includes its upper border, values outside are dropped."""
    width = (high - low) / bins
    b = F.least(F.floor((column - low) / width) + 1, F.lit(bins)).cast("long")
    return df.where((column >= low) & (column <= high)).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def word_frequencies(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    words = df.select(F.explode(F.filter(F.split(F.lower(column), r"(?U)\s+"), lambda t: t != "")).alias("word"))
    return value_counts(words, "word", top)


def presence_rates(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(field, present, rate): how often each field is neither null nor empty."""
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(N.present(f)).alias(f) for f in fields])
    return one.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("present"), F.round(F.try_divide(F.col(f).cast("double"), F.col("_n")), 6).alias("rate")) for f in fields])))


def batch_summary(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Totals of a processed batch in one row: rows, successes, failures, and the fields found."""
    ok = F.col("status") == "success"
    return df.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("successful"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("failed"),
        *[F.count_if(ok & N.present(f)).alias(f"with_{f}") for f in fields],
    )


def rescaled_confidence(df: DataFrame, column: str) -> DataFrame:
    """All confidences; if any is above 1.5 they are percentages and divided by 100."""
    top = df.agg(F.max(column).alias("_top"))  # one row
    scaled = F.when(F.col("_top") > 1.5, F.col(column) / 100.0).otherwise(F.col(column).cast("double"))
    return df.join(F.broadcast(top)).withColumn("confidence", scaled).drop("_top")


def group_rates(df: DataFrame, group: str, flags: Sequence[str]) -> DataFrame:
    """Rows, sum and percentage (two places) of boolean columns by group."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for f in flags:
        aggs += [F.count_if(f).alias(f), F.round(F.count_if(f) * 100.0 / F.count(F.lit(1)), 2).alias(f"{f}_pct")]
    return df.groupBy(group).agg(*aggs)
