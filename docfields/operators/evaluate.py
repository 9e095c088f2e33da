"""Scoring predicted fields against ground truth: one unpivot, one aggregation, whatever the number of fields."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as N

#: Gives a field's normalizer, a function from column to column; fields of one kind share one function.
Normalizer = Callable[[str], Callable[[Column], Column]]


def ratio(a: Column, b: Column) -> Column:
    """``a / b`` to six places; null for a zero denominator."""
    return F.round(F.try_divide(a.cast("double"), b.cast("double")), 6)


def f1(precision: Column, recall: Column) -> Column:
    return F.round(F.try_divide(2 * precision * recall, precision + recall), 6)


def with_columns_for(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Fields that ``df`` lacks become null columns, so they are scored as never predicted."""
    return df.withColumns({f: F.lit(None).cast("string") for f in fields if f not in df.columns}) if set(fields) - set(df.columns) else df


def restricted(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Both sides cut down to the keys that both have (semi-joins on text keys)."""
    a, b = (d.withColumn(key, F.col(key).cast("string")) for d in (left, right))
    return a.join(b.select(key).distinct(), key, "left_semi"), b.join(a.select(key).distinct(), key, "left_semi")


def paired(truth: DataFrame, pred: DataFrame, key: str, fields: Sequence[str], how: str = "inner") -> DataFrame:
    """Truth and prediction side by side: ``<field>_gt`` and ``<field>_pred`` for every field."""
    t = with_columns_for(truth, fields).select(F.col(key).cast("string").alias(key), *[F.col(f).alias(f"{f}_gt") for f in fields])
    p = with_columns_for(pred, fields).select(F.col(key).cast("string").alias(key), *[F.col(f).alias(f"{f}_pred") for f in fields])
    return t.join(p, key, how)


def normalized(cells: DataFrame, fields: Sequence[str], normalize: Normalizer, *columns: str) -> DataFrame:
    """``columns`` of (field, ...) rows in normal form: one branch for each kind of field, not for each field."""
    kinds: dict[Callable, list[str]] = {}
    for f in fields:
        kinds.setdefault(normalize(f), []).append(f)

    def value(c: str) -> Column:
        out = F.lit(None)
        for function, members in kinds.items():
            out = F.when(F.col("field").isin(members), function(F.col(c))).otherwise(out)
        return out

    return cells.withColumns({c: value(c) for c in columns})


def long_form(pairs: DataFrame, fields: Sequence[str], normalize: Normalizer, key: str) -> DataFrame:
    """(key, field, gt, pred): one row per record and field, values in normal form."""
    cells = [F.struct(F.lit(f).alias("field"), F.col(f"{f}_gt").cast("string").alias("gt"), F.col(f"{f}_pred").cast("string").alias("pred")) for f in fields]
    return normalized(pairs.select(key, F.inline(F.array(*cells))), fields, normalize, "gt", "pred")


def counts(cells: DataFrame) -> DataFrame:
    return cells.groupBy("field").agg(
        F.count("gt").alias("ground_truth_count"),
        F.count("pred").alias("predicted_count"),
        F.count_if(F.col("gt") == F.col("pred")).alias("correct"),
        F.count(F.lit(1)).alias("rows"),
    )


def exact_match(truth: DataFrame, pred: DataFrame, key: str, fields: Sequence[str] = N.FIELDS, normalize: Normalizer = N.normalizer, restrict: bool = True) -> DataFrame:
    """Per field: counts, accuracy (= recall), precision, F1; null where a denominator is zero."""
    pairs = paired(truth, pred, key, fields, "inner" if restrict else "full_outer")
    c = counts(long_form(pairs, fields, normalize, key))
    precision, recall = ratio(F.col("correct"), F.col("predicted_count")), ratio(F.col("correct"), F.col("ground_truth_count"))
    return c.select(
        "field", "ground_truth_count", "predicted_count", "correct",
        recall.alias("accuracy"), precision.alias("precision"), recall.alias("recall"), f1(precision, recall).alias("f1"),
    )


def overall_micro(metrics: DataFrame) -> DataFrame:
    """One row from the summed counts of all fields."""
    s = metrics.agg(*[F.sum(c).alias(c) for c in ("ground_truth_count", "predicted_count", "correct")])
    precision, recall = ratio(F.col("correct"), F.col("predicted_count")), ratio(F.col("correct"), F.col("ground_truth_count"))
    return s.select("ground_truth_count", "predicted_count", "correct", recall.alias("accuracy"), precision.alias("precision"), recall.alias("recall"), f1(precision, recall).alias("f1"))


def overall_macro(metrics: DataFrame) -> DataFrame:
    """One row of the plain means of the fields' ratios, from exact decimals so the order of rows does not matter."""
    return metrics.agg(*[F.round(F.avg(F.col(c).cast("decimal(12,6)")).cast("double"), 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


def zonal(truth: DataFrame, pred: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """True and false positives and misses per field; zero instead of null for empty denominators."""
    cells = long_form(paired(truth, pred, key, fields), fields, N.zonal_normalizer, key)
    match = F.coalesce(F.col("gt") == F.col("pred"), F.lit(False))
    c = cells.groupBy("field").agg(
        F.count_if(match).alias("tp"),
        F.count_if(F.col("pred").isNotNull() & ~match).alias("fp"),
        F.count_if(F.col("gt").isNotNull() & ~match).alias("fn"),
        F.count("gt").alias("support"),
    )
    zero = F.lit(0.0)
    precision = F.coalesce(ratio(F.col("tp"), F.col("tp") + F.col("fp")), zero)
    recall = F.coalesce(ratio(F.col("tp"), F.col("tp") + F.col("fn")), zero)
    return c.select(
        "field", "tp", "fp", "fn", "support",
        F.coalesce(ratio(F.col("tp"), F.col("support")), zero).alias("accuracy"),
        precision.alias("precision"), recall.alias("recall"), F.coalesce(f1(precision, recall), zero).alias("f1"),
    )


def by_rows(truth: DataFrame, pred: DataFrame, key: str, fields: Sequence[str], restrict: bool = True) -> DataFrame:
    """Accuracy over all joined rows, keys in canonical form."""
    canon = lambda d: d.withColumn(key, N.file_key(key))
    pairs = paired(canon(truth), canon(pred), key, fields, "inner" if restrict else "full_outer")
    c = counts(long_form(pairs, fields, N.normalizer, key))
    return c.select("field", "rows", "ground_truth_count", "predicted_count", "correct", ratio(F.col("correct"), F.col("rows")).alias("accuracy"))


def gaps(truth: DataFrame, pred: DataFrame, key: str, fields: Sequence[str], examples: int = 8) -> DataFrame:
    """Where predictions are missing or differ, with the first keys (in key order) that miss."""
    cells = long_form(paired(truth, pred, key, fields), fields, N.normalizer, key)
    missing = F.col("gt").isNotNull() & F.col("pred").isNull()
    totals = cells.groupBy("field").agg(
        F.count("gt").alias("gt_nonempty"),
        F.count_if(missing).alias("pred_missing_given_gt"),
        F.count_if(F.col("gt") != F.col("pred")).alias("mismatch_given_both"),
    )
    from pyspark.sql import Window as W

    first = cells.where(missing).withColumn("r", F.row_number().over(W.partitionBy("field").orderBy(key))).where(F.col("r") <= examples)
    first = first.groupBy("field").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", key))), lambda x: x[key]), ",").alias("sample_keys"))
    return totals.join(first, "field", "left").withColumn("sample_keys", F.coalesce("sample_keys", F.lit("")))


def money_mismatches(truth: DataFrame, pred: DataFrame, key: str) -> DataFrame:
    """Records in which any of the money fields is not equal on both sides."""
    pairs = paired(truth, pred, key, N.MONEY_FIELDS)
    cells = long_form(pairs, N.MONEY_FIELDS, N.normalizer, key)
    wrong = cells.groupBy(key).agg(F.count_if(~F.coalesce(F.col("gt") == F.col("pred"), F.lit(False))).cast("int").alias("n_wrong")).where("n_wrong > 0")
    return pairs.join(wrong, key).select(key, "n_wrong", *[F.coalesce(f"{f}_pred", F.lit("")).alias(f"{f}_pred") for f in N.MONEY_FIELDS])


def outcomes(metrics: DataFrame) -> DataFrame:
    """Correct, incorrect and missing counts of :func:`exact_match`."""
    return metrics.select(
        "field", "correct",
        F.greatest(F.col("predicted_count") - F.col("correct"), F.lit(0)).alias("incorrect"),
        F.greatest(F.col("ground_truth_count") - F.col("predicted_count"), F.lit(0)).alias("missing"),
    )


def numeric_error(truth: DataFrame, pred: DataFrame, key: str, fields: Sequence[str] = N.MONEY_FIELDS) -> DataFrame:
    """Mean absolute and mean absolute percentage error over records with both values."""
    cells = long_form(paired(truth, pred, key, fields), fields, lambda f: N.money, key).where("gt is not null and pred is not null")
    error = F.abs(F.col("pred") - F.col("gt"))
    share = (error * 100 / F.abs(F.col("gt"))).cast("decimal(24,8)")
    return cells.groupBy("field").agg(
        F.count(F.lit(1)).alias("n"),
        F.round((F.sum(error) / F.count(F.lit(1))).cast("double"), 4).alias("mae"),
        F.round((F.sum(F.when(F.col("gt") != 0, share)) / F.count_if(F.col("gt") != 0)).cast("double"), 4).alias("mape"),
    )


def record_match(truth: DataFrame, pred: DataFrame, key: str, fields: Sequence[str] = N.FIELDS) -> DataFrame:
    """Share of records in which every field is equal (two missing values count as equal)."""
    cells = long_form(paired(truth, pred, key, fields), fields, N.normalizer, key)
    records = cells.groupBy(key).agg(F.every(F.col("gt").eqNullSafe(F.col("pred"))).alias("same"))
    return records.agg(F.count(F.lit(1)).alias("records"), F.count_if("same").alias("exact")).withColumn("share", ratio(F.col("exact"), F.col("records")))


def tolerant(truth: DataFrame, pred: DataFrame, key: str, fields: Sequence[str] = ("invoice_number", "invoice_date", "total_amount")) -> DataFrame:
    """Training metrics: equality with the totals' tolerance, accuracy over all records, and the share that parsed at all."""
    pairs = paired(truth, pred, key, fields)
    parsed = reduce(lambda a, b: a | b, [F.col(f"{f}_pred").isNotNull() for f in fields])
    raw = [F.struct(F.lit(f).alias("field"), F.col(f"{f}_gt").alias("gt"), F.col(f"{f}_pred").alias("pred")) for f in fields]
    cells = normalized(pairs.withColumn("parsed", parsed).select("parsed", F.inline(F.array(*raw))), fields, N.training_normalizer, "gt", "pred")
    c = cells.withColumn("ok", N.tolerant_equal(F.col("field"), F.col("pred"), F.col("gt"))).groupBy("field").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("parsed").alias("parsed"), F.count("gt").alias("n_gt"), F.count("pred").alias("n_pred"), F.count_if("ok").alias("correct")
    )
    return c.select("field", "n", ratio(F.col("parsed"), F.col("n")).alias("parse_rate"), ratio(F.col("correct"), F.col("n")).alias("accuracy"), ratio(F.col("correct"), F.col("n_pred")).alias("precision"), ratio(F.col("correct"), F.col("n_gt")).alias("recall"))


def alignment(truth: DataFrame, pages: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """How often a true value stands verbatim in its page's text (``pages(key, page)``)."""
    both = truth.join(pages, key)
    cells = [F.struct(F.lit(f).alias("field"), F.col(f).alias("gt"), F.contains(F.col("page"), F.col(f)).alias("found")) for f in fields]
    c = both.select(F.inline(F.array(*cells))).groupBy("field").agg(F.count("gt").alias("total_gt"), F.count_if("found").alias("matched"))
    return c.withColumn("percent", F.round(F.try_divide(F.col("matched") * 100.0, F.col("total_gt")), 4))


def spans_f1(truth: DataFrame, pred: DataFrame, key: str) -> DataFrame:
    """Entity F1 of (key, start, end, field) spans: an entity counts if all of it agrees."""
    on = [key, "start", "end", "field"]
    t, p = truth.select(*on).distinct(), pred.select(*on).distinct()
    n = t.groupBy("field").agg(F.count(F.lit(1)).alias("truth"))
    m = p.groupBy("field").agg(F.count(F.lit(1)).alias("predicted"))
    hit = t.intersect(p).groupBy("field").agg(F.count(F.lit(1)).alias("correct"))
    out = n.join(m, "field", "full_outer").join(hit, "field", "left").na.fill(0)
    return out.withColumn("f1", F.round(F.try_divide(F.col("correct") * 2.0, F.col("truth") + F.col("predicted")), 6))
