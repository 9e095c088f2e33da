"""Every registered query of the document operators, each with the SQL that DuckDB runs for it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import normalize as N
from ..operators import etl, evaluate, extract, generative, layout, parties, profile, weaklabel
from .fixtures import ctes, european, frame, plain

WIDTH, HEIGHT = 1000, 1400
ZONAL_FIELDS = (*N.FIELDS, "due_date")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its oracle."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


# ------------------------------------------------------------------ SQL for the oracle


def q_text(c: str) -> str:
    s = f"lower(trim(regexp_replace({c}, '\\s+', ' ', 'g')))"
    return f"CASE WHEN {s} NOT IN ('', 'nan', 'none') THEN {s} END"


def q_number(s: str) -> str:
    return f"CASE WHEN regexp_matches({s}, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)$') THEN TRY_CAST({s} AS DECIMAL(18,2)) END"


def q_money(c: str) -> str:
    s = f"replace(trim({c}), ' ', '')"
    last = lambda ch: f"strpos(reverse({s}), '{ch}')"
    swapped = f"replace(replace({s}, '.', ''), ',', '.')"
    chosen = (
        f"CASE WHEN {last(',')} > 0 AND {last('.')} > 0 THEN CASE WHEN {last(',')} < {last('.')} THEN {swapped} ELSE replace({s}, ',', '') END "
        f"WHEN {last(',')} > 0 THEN {swapped} ELSE {s} END"
    )
    return q_number(f"({chosen})")


def q_date(c: str) -> str:
    """Dates as the fixtures write them: ISO or month/day/year."""
    return (
        f"CASE WHEN regexp_matches({c}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN {c} "
        f"WHEN regexp_matches({c}, '^[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}$') THEN substr({c}, 7, 4) || '-' || substr({c}, 1, 2) || '-' || substr({c}, 4, 2) END"
    )


def q_value(field: str, c: str) -> str:
    if field in N.MONEY_FIELDS:
        return f"CAST({q_money(c)} AS VARCHAR)"
    return q_date(c) if field in N.DATE_FIELDS else q_text(c)


def q_ratio(a: str, b: str) -> str:
    return f"round(CASE WHEN {b} = 0 THEN NULL ELSE CAST({a} AS DOUBLE) / {b} END, 6)"


def q_f1(p: str, r: str) -> str:
    return f"round(CASE WHEN {p} + {r} = 0 THEN NULL ELSE 2 * {p} * {r} / ({p} + {r}) END, 6)"


def q_cells(fields=N.FIELDS, value=q_value, how: str = "JOIN") -> str:
    """One row for each record and field, from truth t and predictions p on the canonical file key."""
    rows = " UNION ALL ".join(f"SELECT key, '{f}' AS field, {value(f, f'{f}_gt')} AS gt, {value(f, f'{f}_pred')} AS pred FROM pairs" for f in fields)
    columns = ", ".join(f"t.{f} AS {f}_gt, p.{f} AS {f}_pred" for f in fields if f != "due_date")
    due = ", CAST(NULL AS VARCHAR) AS due_date_gt, CAST(NULL AS VARCHAR) AS due_date_pred" if "due_date" in fields else ""
    return (
        ctes("truth", "predictions")
        + f", pairs AS (SELECT coalesce(t.file_key, p.file_key) AS key, {columns}{due} FROM (SELECT *, replace(file_name, '.jpg', '') AS file_key FROM truth) t "
        + f"{how} (SELECT *, replace(replace(file_name, 'processed_', ''), '.jpg', '') AS file_key FROM predictions) p ON t.file_key = p.file_key), cells AS ({rows}) "
    )


EXACT = "SELECT field, count(gt) AS ground_truth_count, count(pred) AS predicted_count, count(*) FILTER (gt = pred) AS correct FROM cells GROUP BY field"
METRICS = (
    f"SELECT *, {q_f1('precision', 'recall')} AS f1 FROM (SELECT *, {q_ratio('correct', 'ground_truth_count')} AS accuracy, "
    f"{q_ratio('correct', 'predicted_count')} AS precision, {q_ratio('correct', 'ground_truth_count')} AS recall FROM ({EXACT}) e) m"
)


def truth_and_predictions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    key = lambda d: d.withColumn("key", N.file_key("file_name"))
    return key(frame(spark, sf_dir, "truth")), key(frame(spark, sf_dir, "predictions"))


# ------------------------------------------------------------------------ evaluation


@query(q_cells() + METRICS)
def eval_exact_match(spark, sf_dir):
    return evaluate.exact_match(*truth_and_predictions(spark, sf_dir), "key")


@query(q_cells() + f"SELECT *, {q_f1('precision', 'recall')} AS f1 FROM (SELECT *, {q_ratio('correct', 'ground_truth_count')} AS accuracy, {q_ratio('correct', 'predicted_count')} AS precision, {q_ratio('correct', 'ground_truth_count')} AS recall FROM (SELECT CAST(sum(ground_truth_count) AS BIGINT) AS ground_truth_count, CAST(sum(predicted_count) AS BIGINT) AS predicted_count, CAST(sum(correct) AS BIGINT) AS correct FROM ({EXACT}) e) s) m")
def eval_overall_micro(spark, sf_dir):
    return evaluate.overall_micro(evaluate.exact_match(*truth_and_predictions(spark, sf_dir), "key"))


@query(q_cells() + "SELECT " + ", ".join(f"round(CAST(sum(CAST({c} AS DECIMAL(12,6))) AS DOUBLE) / count({c}), 6) AS {c}" for c in ("accuracy", "precision", "recall", "f1")) + f" FROM ({METRICS}) x")
def eval_overall_macro(spark, sf_dir):
    return evaluate.overall_macro(evaluate.exact_match(*truth_and_predictions(spark, sf_dir), "key"))


def q_zonal_value(field: str, c: str) -> str:
    if field in N.MONEY_FIELDS:
        return q_value(field, f"regexp_replace({c}, '[^0-9,.\\-]', '', 'g')")
    if field in N.DATE_FIELDS:
        return q_date(c)
    s = f"lower(trim(regexp_replace({c}, '\\s+', ' ', 'g')))"
    return f"CASE WHEN {s} <> '' THEN regexp_replace({s}, '[^\\w\\s\\-]', '', 'g') END"


@query(
    q_cells(ZONAL_FIELDS, q_zonal_value)
    + "SELECT field, tp, fp, fn, support, round(CASE WHEN support = 0 THEN 0 ELSE CAST(tp AS DOUBLE) / support END, 6) AS accuracy, precision, recall, "
    "round(CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END, 6) AS f1 FROM ("
    "SELECT *, round(CASE WHEN tp + fp = 0 THEN 0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END, 6) AS recall FROM ("
    "SELECT field, count(*) FILTER (gt = pred) AS tp, count(*) FILTER (pred IS NOT NULL AND (gt = pred) IS NOT TRUE) AS fp, count(*) FILTER (gt IS NOT NULL AND (gt = pred) IS NOT TRUE) AS fn, count(gt) AS support FROM cells GROUP BY field) c) d"
)
def eval_zonal(spark, sf_dir):
    return evaluate.zonal(*truth_and_predictions(spark, sf_dir), "key", ZONAL_FIELDS)


@query(q_cells(generative.CANONICAL, how="FULL JOIN") + f"SELECT field, count(*) AS rows, count(gt) AS ground_truth_count, count(pred) AS predicted_count, count(*) FILTER (gt = pred) AS correct, {q_ratio('count(*) FILTER (gt = pred)', 'count(*)')} AS accuracy FROM cells GROUP BY field")
def eval_rowcount_accuracy(spark, sf_dir):
    t, p = truth_and_predictions(spark, sf_dir)
    return evaluate.by_rows(t.withColumn("key", F.col("file_name")), p.withColumn("key", F.col("file_name")), "key", generative.CANONICAL, restrict=False)


@query(q_cells() + "SELECT field, count(gt) AS gt_nonempty, count(*) FILTER (gt IS NOT NULL AND pred IS NULL) AS pred_missing_given_gt, count(*) FILTER (gt <> pred) AS mismatch_given_both, coalesce(array_to_string(list_sort(list(key) FILTER (gt IS NOT NULL AND pred IS NULL))[1:8], ','), '') AS sample_keys FROM cells GROUP BY field")
def eval_gap_summary(spark, sf_dir):
    return evaluate.gaps(*truth_and_predictions(spark, sf_dir), "key", N.FIELDS)


@query(
    q_cells(N.MONEY_FIELDS)
    + "SELECT key, n_wrong, tax_pred, net_worth_pred, total_amount_pred FROM (SELECT key, CAST(count(*) FILTER ((gt = pred) IS NOT TRUE) AS INT) AS n_wrong FROM cells GROUP BY key) c "
    "JOIN (SELECT key, coalesce(tax_pred, '') AS tax_pred, coalesce(net_worth_pred, '') AS net_worth_pred, coalesce(total_amount_pred, '') AS total_amount_pred FROM pairs) p USING (key) WHERE n_wrong > 0"
)
def eval_money_mismatch(spark, sf_dir):
    return evaluate.money_mismatches(*truth_and_predictions(spark, sf_dir), "key")


@query(q_cells() + f"SELECT field, correct, greatest(predicted_count - correct, 0) AS incorrect, greatest(ground_truth_count - predicted_count, 0) AS missing FROM ({EXACT}) e")
def eval_outcomes(spark, sf_dir):
    return evaluate.outcomes(evaluate.exact_match(*truth_and_predictions(spark, sf_dir), "key"))


@query(
    q_cells(N.MONEY_FIELDS, lambda f, c: q_money(c))
    + "SELECT field, count(*) AS n, round(CAST(sum(abs(pred - gt)) AS DOUBLE) / count(*), 4) AS mae, "
    "round(sum(CASE WHEN gt <> 0 THEN CAST(abs(pred - gt) AS DOUBLE) * 100 / CAST(abs(gt) AS DOUBLE) END) / count(*) FILTER (gt <> 0), 4) AS mape FROM cells WHERE gt IS NOT NULL AND pred IS NOT NULL GROUP BY field"
)
def eval_numeric_error(spark, sf_dir):
    return evaluate.numeric_error(*truth_and_predictions(spark, sf_dir), "key")


@query(q_cells() + f"SELECT count(*) AS records, count(*) FILTER (same) AS exact, {q_ratio('count(*) FILTER (same)', 'count(*)')} AS share FROM (SELECT key, bool_and(gt IS NOT DISTINCT FROM pred) AS same FROM cells GROUP BY key) r")
def eval_record_match(spark, sf_dir):
    return evaluate.record_match(*truth_and_predictions(spark, sf_dir), "key")


def q_training_value(field: str, c: str) -> str:
    s = f"CASE WHEN lower(trim({c})) NOT IN ('', 'nan', 'none') THEN trim({c}) END"
    if field == "total_amount":
        return f"CAST({q_number(f'''replace(replace({s}, '$', ''), ',', '')''')} AS VARCHAR)"
    return q_date(f"({s})") if field == "invoice_date" else f"regexp_replace({s}, '[^0-9]+', '', 'g')"


@query(
    q_cells(generative.CANONICAL, q_training_value)
    + f"SELECT field, count(*) AS n, {q_ratio('(SELECT count(*) FROM pairs WHERE invoice_number_pred IS NOT NULL OR invoice_date_pred IS NOT NULL OR total_amount_pred IS NOT NULL)', 'count(*)')} AS parse_rate, "
    f"{q_ratio('count(*) FILTER (ok)', 'count(*)')} AS accuracy, {q_ratio('count(*) FILTER (ok)', 'count(pred)')} AS precision, {q_ratio('count(*) FILTER (ok)', 'count(gt)')} AS recall FROM ("
    "SELECT *, CASE WHEN field = 'total_amount' THEN abs(CAST(pred AS DECIMAL(18,2)) - CAST(gt AS DECIMAL(18,2))) <= greatest(0.01, abs(CAST(gt AS DECIMAL(18,2))) * 0.01) ELSE pred = gt END AS ok FROM cells) c GROUP BY field"
)
def eval_tolerant(spark, sf_dir):
    return evaluate.tolerant(*truth_and_predictions(spark, sf_dir), "key")


ALIGNED = ("invoice_number", "invoice_date", "seller_name", "client_name", "tax")


@query(
    ctes("truth", "words") + ", page AS (SELECT key, string_agg(text, ' ' ORDER BY word_idx) AS page FROM words GROUP BY key), cells AS ("
    + " UNION ALL ".join(f"SELECT '{f}' AS field, {f} AS gt, contains(page, {f}) AS found FROM truth JOIN page USING (key)" for f in ALIGNED)
    + ") SELECT field, count(gt) AS total_gt, count(*) FILTER (found) AS matched, round(count(*) FILTER (found) * 100.0 / count(gt), 4) AS percent FROM cells GROUP BY field"
)
def ocr_alignment(spark, sf_dir):
    w = frame(spark, sf_dir, "words")
    page = w.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "text"))), lambda x: x["text"]), " ").alias("page"))
    return evaluate.alignment(frame(spark, sf_dir, "truth"), page, "key", ALIGNED)


# ----------------------------------------------------------------------- normalizers


def formatted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts in the spellings that pages and models use."""
    return spark.sql(FORMATS, invoices=frame(spark, sf_dir, "invoices"))


FORMATS = f"""
SELECT key, CASE key % 6 WHEN 0 THEN {european('total_cents')} WHEN 1 THEN {plain('total_cents')} WHEN 2 THEN replace({european('total_cents')}, ' ', '.')
  WHEN 3 THEN '$' || {plain('total_cents')} WHEN 4 THEN '(' || {european('total_cents')} || ')' ELSE replace(replace({european('total_cents')}, ',', '.'), ' ', ',') END AS amount,
  CASE key % 3 WHEN 0 THEN '  ' || upper(seller_name) || ' ' WHEN 1 THEN replace(seller_name, ' ', '   ') ELSE CASE WHEN key % 5 = 0 THEN 'NaN' ELSE seller_name END END AS name,
  CASE key % 4 WHEN 0 THEN invoice_date WHEN 1 THEN substr(invoice_date, 6, 2) || '/' || substr(invoice_date, 9, 2) || '/' || substr(invoice_date, 1, 4) WHEN 2 THEN 'soon' ELSE NULL END AS day,
  '/Scans/Batch 1/PROCESSED_' || file_name AS path
FROM {{invoices}}
"""
WITH_FORMATS = ctes("invoices") + ", formatted AS (" + FORMATS.format(invoices="invoices") + ") "


@query(WITH_FORMATS + f"SELECT key, CAST({q_money('amount')} AS DOUBLE) AS money FROM formatted")
def norm_money(spark, sf_dir):
    return formatted(spark, sf_dir).select("key", N.money("amount").cast("double").alias("money"))


@query(WITH_FORMATS + f"SELECT key, CAST(CASE WHEN s LIKE '(%)' THEN -({q_money('s[2:-2]')}) ELSE {q_money('s')} END AS DOUBLE) AS money FROM (SELECT key, replace(replace(amount, ' ', ''), '$', '') AS s FROM formatted) f")
def norm_money_signed(spark, sf_dir):
    return formatted(spark, sf_dir).select("key", N.money_signed("amount").cast("double").alias("money"))


@query(WITH_FORMATS + "SELECT key, CAST(total_cents AS DOUBLE) / 100 AS amount FROM invoices")
def norm_amount_ocr(spark, sf_dir):
    confused = F.translate(F.concat(F.lit("Amt: "), F.col("amount"), F.lit(" EUR")), "015", "OIS")
    plain_amounts = spark.sql(f"SELECT key, {european('total_cents')} AS amount FROM {{invoices}}", invoices=frame(spark, sf_dir, "invoices"))
    return plain_amounts.select("key", N.amount_from_scan(confused).cast("double").alias("amount"))


@query(WITH_FORMATS + f"SELECT key, {q_text('name')} AS name FROM formatted")
def norm_text(spark, sf_dir):
    return formatted(spark, sf_dir).select("key", N.text("name").alias("name"))


@query(WITH_FORMATS + f"SELECT key, {q_date('day')} AS day FROM formatted")
def norm_date(spark, sf_dir):
    return formatted(spark, sf_dir).select("key", N.iso_date("day").alias("day"))


@query(WITH_FORMATS + "SELECT key, regexp_replace(trim(regexp_replace(name, '\\s+', ' ', 'g')), '\\s*,\\s*', ', ', 'g') AS company FROM formatted")
def norm_company(spark, sf_dir):
    return formatted(spark, sf_dir).select("key", N.company("name").alias("company"))


@query(WITH_FORMATS + "SELECT key, 'inv-' || CAST(key AS VARCHAR) AS file_key FROM formatted")
def file_key(spark, sf_dir):
    return formatted(spark, sf_dir).select("key", N.file_key("path").alias("file_key"))


@query(WITH_FORMATS + f"SELECT key, {q_zonal_value('tax', 'amount')} AS money, {q_zonal_value('seller_name', 'name')} AS name FROM formatted")
def norm_zonal(spark, sf_dir):
    return formatted(spark, sf_dir).select("key", N.money_zonal("amount").cast("string").alias("money"), N.text_zonal("name").alias("name"))


@query(WITH_FORMATS + "SELECT key, CASE WHEN contains(amount, '$') THEN '$' ELSE 'unknown' END AS currency FROM formatted")
def currency_detect(spark, sf_dir):
    return formatted(spark, sf_dir).select("key", N.currency("amount").alias("currency"))


# ------------------------------------------------------------------------------- ETL


CLEAN = (
    ctes("raw", "invoices")
    + """, first AS (SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY batch_csv, row_idx) AS r FROM raw),
one AS (SELECT f.key, f.file_name, f.batch_csv, f.json_data LIKE '{"invoice": {%' AS ok, i.* EXCLUDE (key, file_name) FROM first f JOIN invoices i USING (key) WHERE r = 1),
typed AS (SELECT key, file_name, batch_csv, CASE WHEN ok THEN client_name END AS client_name, CASE WHEN ok THEN seller_name END AS seller_name,
  CASE WHEN ok THEN invoice_number END AS invoice_number, CASE WHEN ok THEN invoice_date END AS invoice_date,
  CASE WHEN ok THEN CAST(total_cents AS DOUBLE) / 100 END AS total,
  CASE WHEN NOT ok THEN NULL WHEN key % 5 = 0 THEN total_cents / 100.0 - (total_cents / 100.0) / 1.1 WHEN key % 103 = 0 THEN NULL ELSE CAST(tax_cents AS DOUBLE) / 100 END AS tax FROM one) """
)


@query(CLEAN + "SELECT key, batch_csv, client_name, seller_name, invoice_number, invoice_date, round(tax, 2) AS tax, total AS total_amount, round(total - tax, 2) AS net_worth FROM typed")
def etl_clean_invoices(spark, sf_dir):
    c = etl.clean(frame(spark, sf_dir, "raw"))
    return c.select("key", "batch_csv", "client_name", "seller_name", "invoice_number", "invoice_date", "tax", "total_amount", "net_worth")


@query(ctes("raw", "invoices") + "SELECT r.key, CAST(round(total_cents / 100.0 - (total_cents / 100.0) / 1.1, 2) AS DOUBLE) AS tax FROM invoices r WHERE r.key % 5 = 0 AND r.key % 101 <> 0")
def etl_tax_percent(spark, sf_dir):
    rows = etl.parsed(frame(spark, sf_dir, "raw").where("row_idx < 1000000000")).where(F.contains("tax", F.lit("%")))
    return rows.select("key", F.round(N.tax_value("tax", N.etl_number("total_amount")), 2).alias("tax"))


@query(CLEAN + "SELECT batch_csv, count(*) AS n, count(*) FILTER (ok) AS parsed FROM one GROUP BY batch_csv")
def etl_dedupe_first(spark, sf_dir):
    one = etl.first_per_key(frame(spark, sf_dir, "raw"), "file_name", "batch_csv", "row_idx")
    return one.groupBy("batch_csv").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("json_data").startswith('{"invoice": {')).alias("parsed"))


@query(ctes("raw") + "SELECT batch_csv, count(*) AS n, count(DISTINCT file_name) AS files, CAST(0 AS BIGINT) AS with_note FROM raw WHERE batch_csv <> 'batch1_2.csv' GROUP BY batch_csv UNION ALL SELECT batch_csv, count(*), count(DISTINCT file_name), count(*) FROM raw WHERE batch_csv = 'batch1_2.csv' GROUP BY batch_csv")
def etl_union_batches(spark, sf_dir):
    raw = frame(spark, sf_dir, "raw")
    batches = [raw.where(F.col("batch_csv") == f"batch1_{k}.csv") for k in (1, 2, 3)]
    batches[1] = batches[1].withColumn("note", F.lit("rescan"))
    return etl.union_batches(*batches).groupBy("batch_csv").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file_name").alias("files"), F.count("note").alias("with_note"))


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS k, count(*) AS n FROM events GROUP BY 1, 2")
def etl_json_props(spark, sf_dir):
    e = frame(spark, sf_dir, "events").withColumn("p", F.from_json("props", "struct<k: bigint>"))
    return e.groupBy("event_type", (F.col("p.k") % 10).alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query(ctes("truth", "manifest") + "SELECT t.key, processed_file, status, total_amount FROM truth t JOIN manifest m ON t.file_name = m.original_file WHERE status = 'success'")
def join_manifest_inner(spark, sf_dir):
    return etl.with_manifest(frame(spark, sf_dir, "truth"), etl.usable(frame(spark, sf_dir, "manifest"))).select("key", "processed_file", "status", "total_amount")


@query(ctes("truth", "predictions") + f"SELECT t.key, t.total_amount AS total_amount_gt, coalesce(p.total_amount, '') AS total_amount, ({q_money('p.total_amount')} = {q_money('t.total_amount')}) IS TRUE AS same FROM truth t LEFT JOIN predictions p ON t.key = p.key")
def join_debug_left(spark, sf_dir):
    t = frame(spark, sf_dir, "truth").select("key", F.col("total_amount").alias("total_amount_gt"))
    p = frame(spark, sf_dir, "predictions").select("key", "total_amount")
    same = F.coalesce(N.money("total_amount") == N.money("total_amount_gt"), F.lit(False))
    return t.join(p, "key", "left").select("key", "total_amount_gt", F.coalesce("total_amount", F.lit("")).alias("total_amount"), same.alias("same"))


@query(ctes("predictions", "manifest") + "SELECT coalesce(replace(replace(p.file_name, 'processed_', ''), '.jpg', ''), replace(m.original_file, '.jpg', '')) AS file_key, p.file_name IS NOT NULL AS predicted, m.original_file IS NOT NULL AS listed FROM predictions p FULL JOIN manifest m ON replace(p.file_name, 'processed_', '') = m.original_file")
def join_outer(spark, sf_dir):
    p = frame(spark, sf_dir, "predictions").select(N.file_key("file_name").alias("file_key"), F.lit(True).alias("predicted"))
    m = frame(spark, sf_dir, "manifest").select(N.file_key("original_file").alias("file_key"), F.lit(True).alias("listed"))
    return p.join(m, "file_key", "full_outer").na.fill(False)


@query(ctes("truth", "predictions") + "SELECT (SELECT count(*) FROM truth WHERE key IN (SELECT key FROM predictions)) AS truth_rows, (SELECT count(*) FROM predictions WHERE key IN (SELECT key FROM truth)) AS pred_rows, (SELECT count(*) FROM (SELECT key FROM truth INTERSECT SELECT key FROM predictions) i) AS common")
def join_semi_overlap(spark, sf_dir):
    t, p = frame(spark, sf_dir, "truth"), frame(spark, sf_dir, "predictions")
    a, b = evaluate.restricted(t, p, "key")
    n = lambda d, name: d.agg(F.count(F.lit(1)).alias(name))
    return n(a, "truth_rows").join(n(b, "pred_rows")).join(n(t.select("key").intersect(p.select("key")), "common"))


@query(ctes("truth", "manifest") + "SELECT key, file_name FROM truth WHERE file_name NOT IN (SELECT original_file FROM manifest WHERE status = 'success')")
def skipped_anti(spark, sf_dir):
    return etl.skipped(frame(spark, sf_dir, "truth"), frame(spark, sf_dir, "manifest")).select("key", "file_name")


# ------------------------------------------------------------------- profiles and splits


@query(ctes("truth") + "SELECT seller_name, count(*) AS n FROM truth GROUP BY seller_name")
def vendor_counts(spark, sf_dir):
    return profile.value_counts(frame(spark, sf_dir, "truth"), "seller_name")


@query(ctes("truth") + "SELECT seller_name, count(*) AS n FROM truth GROUP BY seller_name ORDER BY n DESC, seller_name LIMIT 20")
def vendor_top20(spark, sf_dir):
    return profile.value_counts(frame(spark, sf_dir, "truth"), "seller_name", 20)


@query(ctes("truth") + "SELECT count(DISTINCT seller_name) AS n_seller_name, count(DISTINCT client_name) AS n_client_name FROM truth")
def distinct_vendors(spark, sf_dir):
    return profile.distinct_count(frame(spark, sf_dir, "truth"), "seller_name", "client_name")


@query(ctes("predictions") + " UNION ALL ".join(f'SELECT \'{f}\' AS "column", count(*) FILTER ({f} IS NULL OR {f} = \'\') AS n_missing, round(CAST(count(*) FILTER ({f} IS NULL OR {f} = \'\') AS DOUBLE) / count(*), 6) AS share FROM predictions' for f in N.FIELDS))
def missing_counts(spark, sf_dir):
    return profile.missing_counts(frame(spark, sf_dir, "predictions"), N.FIELDS)


@query("SELECT count(l_quantity) AS n, round(avg(l_quantity), 4) AS mean, round(stddev_samp(l_quantity), 4) AS std, round(min(l_quantity), 4) AS min, round(quantile_cont(l_quantity, 0.25), 4) AS q25, round(quantile_cont(l_quantity, 0.5), 4) AS q50, round(quantile_cont(l_quantity, 0.75), 4) AS q75, round(max(l_quantity), 4) AS max FROM lineitem")
def describe_totals(spark, sf_dir):
    return profile.describe(frame(spark, sf_dir, "lineitem"), "l_quantity")


@query("SELECT least(CAST(floor((n_chars - 0) / 500.0) AS BIGINT) + 1, 40) AS bin, count(*) AS n FROM documents WHERE n_chars BETWEEN 0 AND 20000 GROUP BY 1")
def hist_totals(spark, sf_dir):
    return profile.histogram(frame(spark, sf_dir, "documents"), F.col("n_chars"), 0.0, 20000.0, 40)


@query("SELECT doc_id, CAST(len([t FOR t IN regexp_split_to_array(text, '\\s+') IF t <> '']) AS INT) AS n_tokens, CAST(length(text) AS INT) AS n_chars FROM documents")
def token_counts(spark, sf_dir):
    return frame(spark, sf_dir, "documents").select("doc_id", N.token_count("text").alias("n_tokens"), F.length("text").alias("n_chars"))


@query("SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '\\s+')) AS word FROM documents) w WHERE word <> '' GROUP BY word ORDER BY n DESC, word LIMIT 200")
def word_freq(spark, sf_dir):
    return profile.word_frequencies(frame(spark, sf_dir, "documents"), "text", 200)


@query(ctes("truth") + "SELECT CAST(length(invoice_number) AS INT) AS digits, count(*) AS n FROM truth GROUP BY 1")
def number_length(spark, sf_dir):
    return frame(spark, sf_dir, "truth").groupBy(F.length("invoice_number").alias("digits")).agg(F.count(F.lit(1)).alias("n"))


@query(ctes("predictions") + " UNION ALL ".join(f"SELECT '{f}' AS field, count(*) FILTER ({f} <> '') AS present, round(CAST(count(*) FILTER ({f} <> '') AS DOUBLE) / count(*), 6) AS rate FROM predictions" for f in N.FIELDS))
def extraction_rates(spark, sf_dir):
    return profile.presence_rates(frame(spark, sf_dir, "predictions"), N.FIELDS)


@query(ctes("predictions", "manifest") + "SELECT count(*) AS total, count(*) FILTER (status = 'success') AS successful, count(*) FILTER (status <> 'success') AS failed, " + ", ".join(f"count(*) FILTER (status = 'success' AND {f} <> '') AS with_{f}" for f in N.FIELDS) + " FROM manifest m LEFT JOIN predictions p ON m.processed_file = p.file_name")
def batch_summary(spark, sf_dir):
    m, p = frame(spark, sf_dir, "manifest"), frame(spark, sf_dir, "predictions")
    return profile.batch_summary(m.select("processed_file", "status").join(p, F.col("processed_file") == F.col("file_name"), "left"), N.FIELDS)


@query(ctes("words") + "SELECT CAST(floor(conf / 10.0) AS INT) AS decile, count(*) AS n, round(CAST(sum(conf) AS DOUBLE) / 100, 2) AS total FROM words GROUP BY 1")
def confidence_rescaled(spark, sf_dir):
    w = profile.rescaled_confidence(frame(spark, sf_dir, "words"), "conf")
    return w.groupBy(F.floor(F.col("conf") / 10).cast("int").alias("decile")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("confidence").cast("decimal(12,4)")).cast("double"), 2).alias("total"))


def q_bucket(key: str) -> str:
    return f"((({key}) * 2654435761) % 1000003) % 1000"


@query(ctes("truth") + f"SELECT CASE WHEN {q_bucket('key')} < 800 THEN 'train' ELSE 'test' END AS part, count(*) AS n, CAST(sum(key) AS BIGINT) AS keys FROM truth GROUP BY 1")
def split_hash(spark, sf_dir):
    return etl.split(frame(spark, sf_dir, "truth"), F.col("key")).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("key").alias("keys"))


@query(ctes("truth") + f"SELECT seller_name, CASE WHEN {q_bucket('length(seller_name) * 31 + ascii(seller_name)')} < 700 THEN 'train' ELSE 'test' END AS part, count(*) AS n FROM truth GROUP BY 1, 2")
def split_vendor(spark, sf_dir):
    key = F.length("seller_name") * 31 + F.ascii("seller_name")
    return etl.split(frame(spark, sf_dir, "truth"), key, 700).groupBy("seller_name", "part").agg(F.count(F.lit(1)).alias("n"))


@query(ctes("truth") + f"SELECT key, seller_name FROM truth ORDER BY {q_bucket('key')}, key LIMIT 100")
def sample_fixed_n(spark, sf_dir):
    return etl.sample_n(frame(spark, sf_dir, "truth"), "key", 100).select("key", "seller_name")


@query(ctes("truth") + "SELECT seller_name, key, row FROM (SELECT seller_name, key, row_number() OVER (PARTITION BY seller_name ORDER BY key) AS row FROM truth) t WHERE row <= 3")
def head_per_group(spark, sf_dir):
    return etl.head_per_group(frame(spark, sf_dir, "truth"), "seller_name", ["key"], 3).select("seller_name", "key", "row")


@query(ctes("truth", "predictions") + "SELECT t.key, coalesce(p.seller_name, t.seller_name) AS name FROM truth t LEFT JOIN (SELECT key, max(seller_name) AS seller_name FROM predictions GROUP BY key) p ON p.key = t.key")
def lookup_join(spark, sf_dir):
    """A dictionary lookup as a left join: one value for each key, the truth where there is none."""
    found = frame(spark, sf_dir, "predictions").groupBy("key").agg(F.max("seller_name").alias("_name"))
    return frame(spark, sf_dir, "truth").join(found, "key", "left").select("key", F.coalesce("_name", "seller_name").alias("name"))


@query(ctes("words") + "SELECT key, round(CAST(max(x + w) AS DOUBLE) / max(y + h), 6) AS ratio FROM words GROUP BY key")
def aspect_ratios(spark, sf_dir):
    size = frame(spark, sf_dir, "words").groupBy("key").agg(F.max(F.col("x") + F.col("w")).alias("width"), F.max(F.col("y") + F.col("h")).alias("height"))
    return size.select("key", F.round(N.aspect_ratio("width", "height"), 6).alias("ratio"))


@query(ctes("truth", "predictions") + f"SELECT field, count(*) AS n, count(*) FILTER (matched) AS matched, round(count(*) FILTER (matched) * 100.0 / count(*), 2) AS matched_pct FROM (SELECT field, (gt = pred) IS TRUE AS matched FROM (SELECT 'tax' AS field, {q_money('t.tax')} AS gt, {q_money('p.tax')} AS pred FROM truth t JOIN predictions p ON t.key = p.key UNION ALL SELECT 'total_amount', {q_money('t.total_amount')}, {q_money('p.total_amount')} FROM truth t JOIN predictions p ON t.key = p.key) c) m GROUP BY field")
def match_rates(spark, sf_dir):
    t, p = truth_and_predictions(spark, sf_dir)
    fields = ("tax", "total_amount")
    cells = evaluate.long_form(evaluate.paired(t, p, "key", fields), fields, N.normalizer, "key")
    return profile.group_rates(cells.withColumn("matched", F.coalesce(F.col("gt") == F.col("pred"), F.lit(False))), "field", ["matched"])


VENDOR = "length(seller_name) * 31 + ascii(seller_name)"


@query(ctes("truth") + f"SELECT part, count(*) AS n, count(DISTINCT seller_name) AS sellers FROM (SELECT seller_name, CASE WHEN {q_bucket(VENDOR)} < 700 THEN 'train' WHEN {q_bucket(VENDOR)} < 850 THEN 'validation' ELSE 'test' END AS part FROM truth) t GROUP BY part")
def split_vendor_three(spark, sf_dir):
    t = etl.split_parts(frame(spark, sf_dir, "truth"), F.expr(VENDOR))
    return t.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("seller_name").alias("sellers"))


@query(ctes("truth") + f"SELECT key, seller_name FROM truth WHERE {q_bucket('key')} < 100")
def sample_by_fraction(spark, sf_dir):
    return etl.sample_fraction(frame(spark, sf_dir, "truth"), "key", 100).select("key", "seller_name")


@query(ctes("truth") + "SELECT key, CASE WHEN key % 3 = 0 AND key % 2 = 0 THEN NULL ELSE seller_name END AS seller_name, invoice_date FROM truth")
def alias_rename(spark, sf_dir):
    own, other = F.when(F.col("key") % 3 != 0, F.col("seller_name")), F.when(F.col("key") % 2 != 0, F.col("seller_name"))
    raw = frame(spark, sf_dir, "truth").select("key", own.alias("seller_name"), other.alias("vendor_name"), F.col("invoice_date").alias("date"))
    return etl.rename_aliases(raw, {"vendor_name": "seller_name", "date": "invoice_date"}).select("key", "seller_name", "invoice_date")


@query(ctes("truth") + "SELECT key, round(2.0 * (length(seller_name) - 1) / (2 * length(seller_name) - 1), 6) AS cut, round(2.0 * length(seller_name) / (2 * length(seller_name) + 2), 6) AS grown, CASE WHEN seller_name = client_name THEN 1.0 END AS same FROM truth")
def similarity_ratio(spark, sf_dir):
    ratio = N.lcs_ratio_udf()
    t = frame(spark, sf_dir, "truth").withColumn("less", F.expr("left(seller_name, length(seller_name) - 1)")).withColumn("more", F.concat(F.lit("#"), "seller_name", F.lit("#")))
    t = t.select("key", "seller_name", "client_name", ratio("seller_name", "less").alias("cut"), ratio("seller_name", "more").alias("grown"), ratio("seller_name", "client_name").alias("same"))
    return t.select("key", F.round("cut", 6).alias("cut"), F.round("grown", 6).alias("grown"), F.when(F.col("seller_name") == F.col("client_name"), F.col("same")).alias("same"))
