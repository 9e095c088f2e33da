"""Structured target text, generated text and generated JSON: building, salvaging, reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as N
from .extract import first_match

CANONICAL = ("invoice_number", "invoice_date", "total_amount")
# Names under which generators write a field, in the order in which they are tried.
ALIASES = {
    "invoice_number": ("invoice_number", "inv_no", "no", "id"),
    "invoice_date": ("invoice_date", "date", "issue_date"),
    "seller_name": ("seller_name", "vendor_name", "supplier_name"),
    "client_name": ("client_name", "buyer_name", "customer_name"),
    "tax": ("tax", "vat", "vat_amount"),
    "net_worth": ("net_worth", "subtotal", "sub_total", "net_amount"),
    "total_amount": ("total_amount", "total", "grand_total", "gross_worth"),
}
NESTED = ("invoice", "header", "summary", "total", "subtotal")
ITEM_KEYS = ("line_items", "items", "menu", "products", "table")
TEXT_PATTERNS = {
    "invoice_number": (r"(?:invoice\s*no\.?|invoice\s*number|no\.?)\s*[:#]?\s*([A-Za-z0-9\-\/]+)",),
    "invoice_date": (r"(?:invoice\s*date|date\s*of\s*issue|issue\s*date|date)\s*[:#]?\s*([0-9]{1,2}[\/\-.][0-9]{1,2}[\/\-.][0-9]{2,4})",),
    "total_amount": (r"(?:total\s*amount|grand\s*total|total)\s*[:#]?\s*\$?([0-9,]+(?:\.[0-9]{2})?)",),
}


def placeholder(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("NULL"))


def training_field(field: str, c: Column | str) -> Column:
    """A field as it is written into training targets."""
    s = N.not_null_text(c)
    if field in N.MONEY_FIELDS:
        return N.money_signed(s).cast("string")
    return N.iso_date(s) if field == "invoice_date" else F.lower(F.regexp_replace(s, r"(?U)\s+", " "))


def target_text(date: Column, amount: Column, number: Column) -> Column:
    return F.concat(F.lit("<s_invoice>[inv_dt]="), placeholder(date), F.lit(" | [amt]="), placeholder(amount), F.lit(" | [inv_no]="), placeholder(number), F.lit("</s>"))


def parse_target(text: Column) -> dict[str, Column]:
    """Number, date and total of structured text: ``[key]=value`` parts (the last of a key counts), then fallbacks."""
    raw = N.trimmed(F.lower(F.regexp_replace(text, r"<.*?>", "")))
    pair = r"\[\s*([a-z_]+)\s*\]\s*=\s*([^|]+)"
    keys, values = F.regexp_extract_all(raw, F.lit(pair), 1), F.regexp_extract_all(raw, F.lit(pair), 2)
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))

    def last(*names: str) -> Column:
        own = F.filter(pairs, lambda p: p["k"].isin(*names))
        return N.trimmed(F.try_element_at(own, F.lit(-1))["v"])

    def fallback(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(raw, pattern, 1), F.lit(""))

    return {
        "invoice_number": F.coalesce(last("inv_no", "intv_no"), fallback(r"\b(\d{6,})\b")),
        "invoice_date": F.coalesce(last("inv_dt"), fallback(r"(\d{4}-\d{2}-\d{2})")),
        "total_amount": F.coalesce(last("amt"), fallback(r"(\d+(?:\.\d{2})?)")),
    }


def without_task_token(text: Column) -> Column:
    """Generated text without end and padding marks and without its leading ``<task>``."""
    clean = N.trimmed(F.replace(F.replace(text, F.lit("<pad>"), F.lit("")), F.lit("</s>"), F.lit("")))
    return N.trimmed(F.regexp_replace(clean, r"^<[^>]+>", ""))


def token_map(text: Column) -> Column:
    """``<s_key>value</s_key>`` marks as a map; null without any. Of a repeated key the last one counts."""
    pattern = F.lit(r"(?s)<s_([^>/]+)>(.*?)</s_\1>")
    keys, values = F.regexp_extract_all(text, pattern, 1), F.transform(F.regexp_extract_all(text, pattern, 2), N.trimmed)
    last = F.filter(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda p: p["k"].isNotNull())
    entries = F.transform(last, lambda p: F.struct(p["k"], p["v"]))
    distinct = F.array_distinct(keys)
    newest = F.transform(distinct, lambda k: F.element_at(F.filter(entries, lambda e: e["k"] == k), -1))
    return F.when(F.size(keys) > 0, F.map_from_entries(newest))


def parsed_text(text: Column) -> Column:
    """Generated text as a map: marks, else JSON, else the text itself under ``raw_text``."""
    body = without_task_token(text)
    return F.coalesce(token_map(body), as_map(salvaged(body)), F.create_map(F.lit("raw_text"), body))


def result_rows(df: DataFrame, key: str, text: str, most: int = 250) -> DataFrame:
    """What the sink of generated results holds: the first characters of the text and the parsed keys, sorted."""
    parsed = parsed_text(F.col(text))
    return df.select(key, F.substring(F.col(text), 1, most).alias("raw_sequence"), F.array_join(F.array_sort(F.map_keys(parsed)), ",").alias("parsed_keys"))


def salvaged(text: Column) -> Column:
    """The outermost ``{...}`` of a text, closing commas and stray quotes after a brace removed; null without one."""
    body = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    body = F.regexp_replace(F.regexp_replace(body, r",\s*\}", "}"), r"\}\"+", "}")
    return F.nullif(body, F.lit(""))


def as_map(text: Column) -> Column:
    """A JSON object as a map of texts; single quotes are tried as double ones."""
    kind = "map<string, string>"
    return N.let(text, lambda t: F.coalesce(F.from_json(t, kind), F.from_json(F.translate(t, "'", '"'), kind)))


def nested(top: Column, keys: tuple[str, ...]) -> list[Column]:
    """The objects under the given keys as maps; null where there is none."""
    return [F.when(F.try_element_at(top, F.lit(k)).startswith("{"), F.from_json(F.try_element_at(top, F.lit(k)), "map<string, string>")) for k in keys]


def json_fields(text: Column) -> Column:
    """Struct of the canonical fields of generated JSON: top level first, then the usual nested objects; aliases in order."""

    def lookup(sources: Column, field: str) -> Column:
        values = F.flatten(F.transform(sources, lambda src: F.array(*[F.try_element_at(src, F.lit(a)) for a in ALIASES[field]])))
        # an object under an alias is a source, not a value
        return F.get(F.filter(values, lambda v: v.isNotNull() & (v != "") & ~v.startswith("{")), F.lit(0))

    def fields(sources: Column) -> Column:
        number, date, total = (lookup(sources, f) for f in CANONICAL)
        return F.struct(
            number.alias("invoice_number"), N.let(date, lambda d: F.coalesce(N.iso_date(d), d)).alias("invoice_date"),
            N.let(total, lambda t: F.coalesce(N.money(t).cast("string"), t)).alias("total_amount"),
        )

    top = as_map(salvaged(without_task_token(text)))
    return N.let(top, lambda t: N.let(F.array(t, *nested(t, NESTED)), fields))


def flattened(text: Column) -> Column:
    """Struct of all fields from the one nested object of highest priority (invoice, header, summary, else the top level)."""

    def fields(src: Column) -> Column:
        values = {f: F.coalesce(*[F.nullif(F.try_element_at(src, F.lit(a)), F.lit("")) for a in ALIASES[f]]) for f in N.FIELDS}
        return F.struct(*[training_field(f, v).alias(f) for f, v in values.items()])

    return N.let(as_map(without_task_token(text)), lambda top: N.let(F.coalesce(*nested(top, NESTED[:3]), top), fields))


def json_line_items(df: DataFrame, column: str, key: str) -> DataFrame:
    """(key, source, pos, item): elements of the first list among the usual names."""
    top = as_map(salvaged(F.col(column)))
    lists = [F.when(F.try_element_at(top, F.lit(k)).startswith("["), F.struct(F.lit(k).alias("source"), F.from_json(F.try_element_at(top, F.lit(k)), "array<string>").alias("items"))) for k in ITEM_KEYS]
    rows = df.select(key, F.coalesce(*lists).alias("l")).where("l is not null")
    return rows.select(key, F.col("l.source").alias("source"), F.posexplode("l.items").alias("pos", "item"))


def text_fields(text: Column) -> dict[str, Column]:
    """Canonical fields by label patterns; values under three characters and numbers without digits are refused."""

    def value(found: Column, test, shape) -> Column:
        return N.let(found, lambda v: F.when((F.length(v) >= 3) & test(v), shape(v)))

    out = {}
    for f in CANONICAL:
        test, shape = {
            "invoice_number": (lambda v: v.rlike(r"\d"), lambda v: v),
            "invoice_date": (lambda v: F.lit(True), lambda v: F.coalesce(N.iso_date(v), v)),
            "total_amount": (lambda v: v.rlike(r"^[0-9,]+(\.[0-9]{2})?$"), lambda v: F.coalesce(N.money(v).cast("string"), v)),
        }[f]
        out[f] = value(first_match(text, TEXT_PATTERNS[f]), test, shape)
    return out


def degenerate(text: Column) -> Column:
    """Fewer than five words, under a quarter of them different, or one word six times in a row."""
    low = F.lower(text)
    tokens = F.regexp_extract_all(low, F.lit(r"(?U)(\w+)"), 1)
    n = F.size(tokens)
    few = n < 5
    same = F.try_divide(F.size(F.array_distinct(tokens)).cast("double"), n.cast("double")) < 0.25
    # possessive word and separator: a run is followed without trying shorter words
    loop = low.rlike(r"(?U)(\b\w++\b)(?:\s++\1\b){5,}+") | low.rlike(r"(?U)(\b\w++\b)(?:\s++\1){5,}")
    return F.coalesce(few | same | loop, F.lit(True))


def training_frame(truth: DataFrame, image: str, order: str, augment: int = 1, fraction: float | None = None) -> DataFrame:
    """(image_path, target_text, loss_weight, source_idx, augment_id): one row per image and augmentation.

    The weight is 1 + 0.15 for each of number, date and the three amounts that is present.
    ``fraction`` samples images by hash of their order key.
    """
    rows = truth.where(N.present(N.trimmed(image)))
    if fraction is not None:
        rows = rows.where(F.pmod(F.xxhash64(order), F.lit(1_000_000)) < int(fraction * 1_000_000))
    value = {f: training_field(f, f) for f in ("invoice_number", "invoice_date", "net_worth", "tax", "total_amount")}
    present = sum((F.when(N.present(v), 1).otherwise(0) for v in value.values()), F.lit(0))
    return rows.select(
        F.col(image).alias("image_path"),
        target_text(value["invoice_date"], value["total_amount"], value["invoice_number"]).alias("target_text"),
        F.round(F.lit(1.0) + present * 0.15, 6).alias("loss_weight"),
        F.col(order).alias("source_idx"),
        F.explode(F.sequence(F.lit(0), F.lit(max(1, augment) - 1))).alias("augment_id"),
    )
