"""Unit vectors of the scalar normalizers."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docfields.functions import normalize as N
from docfields.functions.similarity import indel_ratio, lcs_length


def values(spark, build, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r["v"] for r in df.select("i", build(F.col("x")).alias("v")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("build", "cases"),
    [
        (N.money_text, {"1 140,24": "1140.24", "1,140.24": "1140.24", "103,66": "103.66", "1,234": "1.23", "1,234,567": None, "1.140,24": "1140.24", "abc": None, "": None, "1_000": None, "1d": None}),
        (lambda c: N.money_signed(c).cast("string"), {"(1 140,24)": "-1140.24", "$ 5": "5.00", "12,5 EUR": "12.50", "USD 7.00": "7.00"}),
        (lambda c: N.amount_from_scan(c).cast("string"), {"I23,4S": "123.45", "7 237,02": "7237.02", "1,234.56 then 99.10": "99.10", "1.234.567,89": "1234567.89", "no": None, "1234": "1234.00"}),
        (N.money_zonal_text, {"$1,234": "1234.00", "1.234.56": "1234.56", "12,50 €": "12.50", "": None}),
        (N.text, {"  A \t B ": "a b", "None": None, "NaN": None, "": None, "É x": "é x"}),
        (N.iso_date, {"12/20/2014": "2014-12-20", "12-20-14": "2014-12-20", "20/12/2014": "2014-12-20", "2014-12-20": "2014-12-20", "2/30/2014": None, "soon": None, "1.2.1999": "1999-01-02"}),
        (N.company, {" A ,B": "A, B", "  ": None}),
        (N.file_key, {"/x/Processed_Inv-1.JPG": "inv-1", "a.b.png": "a.b", ".hidden": ".hidden"}),
        (N.currency, {"€ 5 $": "$", "¥": "¥", "5": "unknown"}),
        (N.text_zonal, {"A. B-c!": "a b-c"}),
    ],
)
def test_vectors(spark, build, cases):
    assert dict(zip(cases, values(spark, build, list(cases)))) == cases


def test_tax_rate_is_contained_in_total(spark):
    df = spark.createDataFrame([("10%", 110.0), ("12,5", 100.0), ("n/a", 1.0)], "t string, total double")
    got = [r[0] for r in df.select(F.round(N.tax_value("t", F.col("total")), 2)).collect()]
    assert got == [10.0, 12.5, None]


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
def test_lcs_against_table(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            row[j], last = (last + 1 if x == y else max(row[j], row[j - 1])), row[j]
    assert lcs_length(a, b) == row[-1]
    assert 0.0 <= indel_ratio(a, b) <= 1.0
