"""Scalar normalizers as ``Column -> Column`` builders: text, money, dates, keys, names, geometry.

Several parsers of money exist because their callers mean different things by a comma; they
are kept apart on purpose and never unified.  Money is a ``decimal(18,2)`` column; missing or
unparsable values are SQL NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .similarity import indel_ratio

MONEY = "decimal(18,2)"
MONEY_FIELDS = ("tax", "net_worth", "total_amount")
DATE_FIELDS = ("invoice_date", "due_date")
FIELDS = ("invoice_number", "invoice_date", "seller_name", "client_name", "tax", "net_worth", "total_amount")
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"
CURRENCIES = ("$", "€", "£", "¥", "₹")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once; keeps deep expressions from growing with every use of a part."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def trimmed(c: Column | str) -> Column:
    """Without white space of any kind at both ends (``trim`` removes spaces only)."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def squeezed(c: Column | str) -> Column:
    """Runs of white space become one space, ends are trimmed."""
    return F.btrim(F.regexp_replace(col(c), r"(?U)\s+", " "))


def present(c: Column | str) -> Column:
    """Neither null nor empty."""
    return F.coalesce(col(c) != "", F.lit(False))


def text(c: Column | str) -> Column:
    """Lower case, one space between words; empty, ``nan`` and ``none`` are missing."""
    return let(F.lower(squeezed(c)), lambda s: F.when(~s.isin("", "nan", "none"), s))


def number(c: Column) -> Column:
    """Plain decimal notation only, rounded to cents."""
    return let(c, lambda s: F.when(s.rlike(NUMBER), s.try_cast(MONEY)))


def rightmost_decimal(s: Column, lone_comma: Column, lone_dots: Column) -> Column:
    """With both separators the rightmost is the decimal one; otherwise the given readings apply."""
    comma, dot = F.instr(F.reverse(s), ","), F.instr(F.reverse(s), ".")
    return (
        F.when((comma > 0) & (dot > 0) & (comma < dot), F.translate(s, ",.", "."))
        .when((comma > 0) & (dot > 0), F.translate(s, ",", ""))
        .when(comma > 0, lone_comma)
        .otherwise(lone_dots)
    )


def money(c: Column | str) -> Column:
    """Shared parser: spaces dropped; a lone comma is always the decimal separator."""
    return let(F.translate(trimmed(c), " ", ""), lambda s: number(rightmost_decimal(s, F.translate(s, ",.", "."), s)))


def money_signed(c: Column | str) -> Column:
    """Training parser: also drops currency signs and codes; parentheses are negative."""
    s = F.regexp_replace(F.translate(trimmed(c), " $€£", ""), "USD|EUR|GBP", "")

    def value(t: Column) -> Column:
        return number(rightmost_decimal(t, F.translate(t, ",.", "."), t))

    return let(s, lambda t: F.when(t.rlike(r"^\(.*\)$"), -value(F.regexp_replace(t, r"^\(|\)$", ""))).otherwise(value(t)).cast(MONEY))


def cents_comma(s: Column) -> Column:
    """Reading of a token: a lone comma is decimal only before two closing digits; the last of several dots is."""
    lone = F.when(s.rlike(r",[0-9]{2}$"), F.translate(s, ",.", ".")).otherwise(F.translate(s, ",", ""))
    dots = F.when(F.length(F.regexp_replace(s, r"[^.]", "")) > 1, F.concat(F.replace(F.regexp_extract(s, r"^(.*)\.[^.]*$", 1), F.lit("."), F.lit("")), F.lit("."), F.element_at(F.split(s, r"\."), -1))).otherwise(s)
    return rightmost_decimal(s, lone, dots)


# Letters that scanners confuse with digits, and the shape of an amount.
CONFUSED = ("OoIlS", "00115")
AMOUNT = r"-?(?:[0-9]{1,3}(?:[.,\s][0-9]{3})+[.,][0-9]{2}|[0-9]+[.,][0-9]{2}|[0-9]{3,})"


def amount_from_scan(c: Column | str) -> Column:
    """Last amount in scanned text, after undoing confusions of letters and digits."""
    s = F.translate(col(c), *CONFUSED)
    s = squeezed(F.regexp_replace(s, r"[^0-9,.\-\s]", ""))
    found = F.regexp_extract_all(s, F.lit(f"({AMOUNT})"), 1)
    parsed = F.transform(found, lambda t: let(F.translate(t, " ", ""), lambda u: number(cents_comma(u))))
    return F.try_element_at(F.filter(parsed, lambda v: v.isNotNull()), F.lit(-1))


def money_zonal(c: Column | str) -> Column:
    """Evaluation parser of the zonal path: everything but digits, separators and minus is dropped."""
    return let(F.regexp_replace(col(c), r"[^0-9,.\-]", ""), lambda s: number(cents_comma(s)))


def text_zonal(c: Column | str) -> Column:
    """Lower case without punctuation; word characters, white space and hyphens stay."""
    return let(F.lower(squeezed(c)), lambda s: F.when(s != "", F.regexp_replace(s, r"(?U)[^\w\s\-]", "")))


def iso_date(c: Column | str) -> Column:
    """``yyyy-MM-dd`` text of ISO dates and of month-first (else day-first) dates with / - or . between."""
    pattern = r"^([0-9]{1,2})[/.\-]([0-9]{1,2})[/.\-]([0-9]{4}|[0-9]{2})$"

    def parsed(s: Column) -> Column:
        iso = F.regexp_extract(s, r"^([0-9]{4}-[0-9]{1,2}-[0-9]{1,2})(?:[T ].*)?$", 1)
        one, two, year = (F.regexp_extract(s, pattern, k) for k in (1, 2, 3))
        year = F.when(F.length(year) == 2, F.concat(F.when(year < "69", "20").otherwise("19"), year)).otherwise(year)
        first = one.try_cast("int") <= 12
        parts = F.when(s.rlike(pattern), F.concat_ws("-", year, F.when(first, one).otherwise(two), F.when(first, two).otherwise(one)))
        return F.coalesce(F.nullif(iso, F.lit("")), parts).try_cast("date").cast("string")

    return let(trimmed(c), parsed)


def invoice_digits(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"[^0-9]+", "")


def not_null_text(c: Column | str) -> Column:
    return let(trimmed(c), lambda s: F.when(~F.lower(s).isin("", "nan", "none"), s))


def training_total(c: Column) -> Column:
    return number(F.btrim(F.translate(not_null_text(c), "$,", ""))).cast("string")


def training_number(c: Column) -> Column:
    return invoice_digits(not_null_text(c))


def money_text(c: Column | str) -> Column:
    return money(c).cast("string")


def money_zonal_text(c: Column | str) -> Column:
    return money_zonal(c).cast("string")


def training_normalizer(field: str):
    """How the training metrics read a field."""
    return {"total_amount": training_total, "invoice_date": iso_date, "invoice_number": training_number}.get(field, text)


def tolerant_equal(field: Column, pred: Column, ref: Column) -> Column:
    """Equal normal forms; totals may differ by a hundredth of the reference or by 0.01."""
    p, r = pred.try_cast(MONEY), ref.try_cast(MONEY)
    near = F.abs(p - r) <= F.greatest(F.lit(0.01), F.abs(r) * 0.01)
    return F.coalesce(F.when(field == "total_amount", near).otherwise(pred == ref), F.lit(False))


def normalizer(field: str):
    """How evaluation reads a field: money to cents, ISO dates, squeezed lower-case text."""
    if field in MONEY_FIELDS:
        return money_text
    return iso_date if field in DATE_FIELDS else text


def zonal_normalizer(field: str):
    if field in MONEY_FIELDS:
        return money_zonal_text
    return iso_date if field in DATE_FIELDS else text_zonal


def field_value(field: str, c: Column | str) -> Column:
    return normalizer(field)(c)


def token_value(field: str, c: Column | str) -> Column:
    """A page word as it is compared with a field's value; never null."""
    s = trimmed(c)
    if field in MONEY_FIELDS:
        plain = F.translate(s, "".join(CURRENCIES), "")
        return F.coalesce(money(plain).cast("string"), F.regexp_replace(plain, r"[^0-9.,\-]", ""))
    if field == "invoice_date":
        return F.coalesce(iso_date(s), F.lower(s))
    if field == "invoice_number":
        return F.lower(F.regexp_replace(s, r"[^A-Za-z0-9\-]", ""))
    return F.coalesce(text(s), F.lit(""))


def value_tokens(field: str, c: Column | str) -> Column:
    """The words that a field's value should appear as; empty if there is none."""
    if field in MONEY_FIELDS or field == "invoice_date":
        one = field_value(field, c)
    elif field == "invoice_number":
        one = F.nullif(F.lower(F.regexp_replace(col(c), r"[^A-Za-z0-9\-]", "")), F.lit(""))
    else:
        return F.coalesce(F.split(text(c), " "), F.array().cast("array<string>"))
    return F.when(one.isNotNull(), F.array(one)).otherwise(F.array().cast("array<string>"))


def company(c: Column | str) -> Column:
    """One space between words, comma and space between parts."""
    return F.nullif(F.regexp_replace(squeezed(c), r"\s*,\s*", ", "), F.lit(""))


def money_spaces(c: Column | str) -> Column:
    """No-break, narrow, thin and figure spaces become plain spaces."""
    return F.translate(col(c), "\u00a0\u202f\u2009\u2007", "    ")


def alnum(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(col(c)), r"[^a-z0-9]", "")


def file_key(c: Column | str) -> Column:
    """Lower-case base name without ``processed_`` and without its last extension."""
    name = F.element_at(F.split(F.lower(trimmed(c)), "/"), -1)
    name = F.regexp_replace(name, r"^processed_", "")
    return F.when(name.rlike(r"^\.[^.]*$"), name).otherwise(F.regexp_replace(name, r"\.[^.]*$", ""))


def currency(c: Column | str) -> Column:
    """The first of the known signs, in their fixed order, that the text contains."""
    out = F.when(col(c).isNull(), F.lit(None).cast("string"))
    for sign in CURRENCIES:
        out = out.when(F.contains(col(c), F.lit(sign)), F.lit(sign))
    return out.otherwise(F.lit("unknown"))


def token_count(c: Column | str) -> Column:
    return F.size(F.filter(F.split(col(c), r"(?U)\s+"), lambda t: t != ""))


def aspect_ratio(width: Column | str, height: Column | str) -> Column:
    return F.try_divide(col(width).cast("double"), col(height).cast("double"))


def tolerance_label(total: Column) -> Column:
    """Tolerance of weak money labels."""
    return F.greatest(F.lit(0.05), F.abs(total) * 0.01)


def tolerance_heuristic(total: Column) -> Column:
    """Tolerance of tax + net = total on scanned pages."""
    return F.greatest(total.cast("double") * 0.015, F.lit(1.0))


def tolerance_layout(total: Column) -> Column:
    """Tolerance of tax + net = total in the layout resolver."""
    return F.greatest(F.lit(0.03), F.abs(total) * 0.01)


def box_1000(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Corner box scaled to 0..1000 (half-even rounding), zeros for a page without size."""

    def scaled(v: Column, size: Column) -> Column:
        return F.when((width <= 0) | (height <= 0), F.lit(0)).otherwise(F.least(F.greatest(F.bround(F.try_divide(v * 1000.0, size), 0), F.lit(0)), F.lit(1000)).cast("int"))

    return F.array(scaled(x, width), scaled(y, height), scaled(x + w, width), scaled(y + h, height))


def y_center(y: Column, h: Column) -> Column:
    return y + h / 2.0


def x_center(x: Column, w: Column, width: Column) -> Column:
    return (x + w / 2.0) / F.greatest(width, F.lit(1))


def tax_value(tax: Column | str, total: Column | str) -> Column:
    """``r%`` is the tax contained in the total at that rate, anything else a plain number."""
    rate = F.regexp_extract(col(tax), r"^\s*([0-9.]+)\s*%\s*$", 1).try_cast("double")
    total = col(total).cast("double")
    contained = total - F.try_divide(total, 1 + rate / 100)
    return F.when(F.contains(col(tax), F.lit("%")), contained).otherwise(etl_number(tax))


def etl_number(c: Column | str) -> Column:
    """Ground-truth clean-up: every comma is a dot, spaces and dollars go; what is no number then is missing."""
    s = F.nullif(F.translate(trimmed(c), ", $", "."), F.lit(""))
    return F.when(s.rlike(NUMBER), s.try_cast("double"))


def lcs_ratio_udf():
    """Pandas UDF: 2 * LCS / (len(a) + len(b)), the normalized indel similarity; 1 for two empty texts."""
    import pandas as pd

    def ratio(a, b):
        known: dict[tuple[str, str], float] = {}
        for pair in zip(a.fillna(""), b.fillna("")):
            if pair not in known:
                known[pair] = indel_ratio(*pair)
        return pd.Series([known[pair] for pair in zip(a.fillna(""), b.fillna(""))], dtype="float64")

    ratio.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(ratio, "double")
