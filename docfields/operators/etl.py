"""Ground-truth ETL: raw batches to typed invoices, manifests, joins, splits and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import normalize as N

PAYLOAD = (
    "struct<invoice: struct<client_name: string, seller_name: string, invoice_number: string, invoice_date: string, due_date: string>, "
    "subtotal: struct<tax: string, total: string>>"
)


def first_per_key(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of every key in the given order (the order must be total to be reproducible)."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def parsed(raw: DataFrame, column: str = "json_data") -> DataFrame:
    """The payload's fields as columns; text that is no JSON gives nulls."""
    j = raw.withColumn("_j", F.from_json(column, PAYLOAD))
    return j.select(*[c for c in raw.columns if c != column], "_j.invoice.*", F.col("_j.subtotal.tax").alias("tax"), F.col("_j.subtotal.total").alias("total_amount"))


def clean(raw: DataFrame, key: str = "file_name", order: tuple[str, ...] = ("batch_csv", "row_idx")) -> DataFrame:
    """One typed invoice per file: text trimmed, ISO dates, numbers, tax from a rate if given as one, net worth derived."""
    one = parsed(first_per_key(raw, key, *order))
    total = N.etl_number("total_amount")
    tax = N.tax_value("tax", total)
    text = {c: F.nullif(N.trimmed(c), F.lit("")) for c in ("client_name", "seller_name", "invoice_number")}
    return (
        one.withColumns(text)
        .withColumns({c: N.iso_date(c) for c in ("invoice_date", "due_date")})
        .withColumns({"net_worth": F.round(total - tax, 2), "tax": F.round(tax, 2), "total_amount": F.round(total, 2)})
    )


def union_batches(*batches: DataFrame) -> DataFrame:
    """Rows of all batches by column name; columns a batch lacks are null."""
    out = batches[0]
    for b in batches[1:]:
        out = out.unionByName(b, allowMissingColumns=True)
    return out


def with_manifest(truth: DataFrame, manifest: DataFrame, how: str = "inner") -> DataFrame:
    """Truth joined to its processed images by the original file's name."""
    return truth.join(manifest.drop("key"), truth["file_name"] == manifest["original_file"], how)


def usable(manifest: DataFrame) -> DataFrame:
    return manifest.where((F.col("status") == "success") & F.col("processed_path").isNotNull())


def skipped(truth: DataFrame, manifest: DataFrame) -> DataFrame:
    """Truth rows without a usable image."""
    ok = usable(manifest).select(F.col("original_file").alias("file_name"))
    return truth.join(ok, "file_name", "left_anti")


def hash_bucket(key: Column, buckets: int = 1000) -> Column:
    """A fixed pseudo-random bucket from integer arithmetic, the same on every engine and partitioning."""
    return F.pmod(key.cast("long") * F.lit(2654435761), F.lit(1_000_003)) % buckets


def split(df: DataFrame, key: Column, train: int = 800) -> DataFrame:
    """Adds ``part``: train or test by the key's bucket of a thousand."""
    return df.withColumn("part", F.when(hash_bucket(key) < train, "train").otherwise("test"))


def split_parts(df: DataFrame, key: Column, parts: tuple[tuple[str, int], ...] = (("train", 700), ("validation", 850), ("test", 1000))) -> DataFrame:
    """Adds ``part`` by the key's bucket of a thousand; a part's number is its first bucket beyond."""
    part = F.lit(None).cast("string")
    for name, beyond in reversed(parts):
        part = F.when(hash_bucket(key) < beyond, name).otherwise(part)
    return df.withColumn("part", part)


def sample_fraction(df: DataFrame, key: str, thousandths: int) -> DataFrame:
    """The rows of the first ``thousandths`` buckets: about that share, the same ones on every run."""
    return df.where(hash_bucket(F.col(key)) < thousandths)


def rename_aliases(df: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Columns under their canonical names; an alias fills what its canonical column lacks, and goes."""
    for alias, name in aliases.items():
        if alias in df.columns:
            value = F.coalesce(F.col(name), F.col(alias)) if name in df.columns else F.col(alias)
            df = df.withColumn(name, value).drop(alias)
    return df


def sample_n(df: DataFrame, key: str, n: int) -> DataFrame:
    """Exactly ``n`` rows, those of the smallest bucket, then key."""
    return df.withColumn("_b", hash_bucket(F.col(key))).orderBy("_b", key).limit(n).drop("_b")


def head_per_group(df: DataFrame, group: str, order: list, n: int) -> DataFrame:
    """The first ``n`` rows of every group."""
    return df.withColumn("row", F.row_number().over(W.partitionBy(group).orderBy(*order)).cast("long")).where(F.col("row") <= n)
