"""Pages built and searched by Python against the expressions and SQL that they follow."""

import os

import pytest
from pyspark.sql import functions as F

from docfields.functions import normalize as N
from docfields.operators import layout, parties, weaklabel

TABLES = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables here")
def test_built_pages_hold_the_derived_words(spark):
    from docfields.plans import fixtures, whole_pages

    fields = tuple(f for f in whole_pages.KINDS if f != "label")
    pages = whole_pages.pages(spark, TABLES, fields, truth=True)
    got, want = pages.select("key", F.inline("ws")).select("key", *fields), fixtures.frame(spark, TABLES, "words").select("key", *fields)
    assert got.schema.simpleString() == want.schema.simpleString()
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    got, want = pages.select(F.inline("truth")), fixtures.frame(spark, TABLES, "truth").select(*whole_pages.TRUTH)
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_built_pages_of_gaps_repeats_and_single_rows(spark, tmp_path):
    """Orders twice or not at all, lines with nulls, a null key, many lines: as the SQL has them."""
    from docfields.plans import fixtures, whole_pages

    line = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    rows = [(1, 5, 7, 1, 3.0, 1234567.89, 0.05, 0.08), (1, None, 7, 1, 3.0, None, 0.05, 0.08), (2, 5, None, 2, None, 10.0, None, None), (None, 1, 2, 3, 4.0, 5.0, 0.1, 0.0), (3, 9, 9, 1, 1.0, 99.995, 0.5, 0.07)]
    rows += [(4, k, k, k, 1.0, 100.0 * k, 0.01, 0.02) for k in range(1, 700)]
    spark.createDataFrame([(*r, "N", "O", None) for r in rows], line).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    orders = [(1, 3), (1, 4), (3, 22), (4, None), (5, 1), (None, 2)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").withColumn("o_orderdate", F.lit("2020-03-04").cast("timestamp")).write.parquet(f"{tmp_path}/orders.parquet")
    fields = tuple(f for f in whole_pages.KINDS if f != "label")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = whole_pages.pages(spark, str(tmp_path), fields).select("key", F.inline("ws")).select("key", *fields).toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = fixtures.frame(spark, str(tmp_path), "words").select("key", *fields).toPandas()
    assert sorted(map(repr, got.itertuples(index=False))) == sorted(map(repr, want.itertuples(index=False)))


def test_words_read_as_expressions_read_them(spark):
    from docfields.functions import words as S

    texts = ["", " ", " None", "NaN", " A  b\x85", "1 140,24", "1,140.24", "+.5", "1.005", "-2,345", "1.2.3", "12345678901234567890", "9999999999999999.99", "Tran, Hurst and Sons 12 Lake Street", ":-a, ", "١٢ x", "\x1c7\x1c", "a,\n", "Ltd. (b)"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    want = df.select("t", N.text("t").alias("text"), N.trimmed("t").alias("trimmed"), (N.money("t") * 100).cast("long").alias("cents"), N.alnum("t").alias("alnum"), parties.strip_marks(F.col("t")).alias("bare"), parties.name_score("t").alias("score")).collect()
    for r in want:
        assert (S.text(r.t), S.trimmed(r.t), S.cents(r.t), S.alnum(r.t), S.strip_marks(r.t), S.name_score(r.t, parties.BAD)) == tuple(r)[1:], repr(r.t)


def test_a_page_is_resolved_in_one_pass_without_shuffling_its_words(spark):
    """Spans may come as a table or from the words' labels; both ways each tier gives what it gives alone."""
    rows = []
    for key, (label, names) in enumerate([("B-SELLER_NAME", ["Tran-Kim", "Hurst"]), ("O", ["Mendoza", "Sons"]), ("I-SELLER_NAME", ["Andrade", "Fuller"])]):
        texts = ["Seller:", "Client:", *names, "and", "Rodgers", "ITEMS", "Tax"]
        xs = [5, 55, 5, 55, 60, 66, 5, 20]
        rows += [(key, i, t, x, 10, 10 * i, label if i == 2 else "O") for i, (t, x) in enumerate(zip(texts, xs))]
    words = spark.createDataFrame(rows, "key long, word_idx long, text string, x int, w int, y int, label string")
    by_label = parties.resolve(layout.paged(words), None, 100)
    by_table = parties.resolve(words.drop("label"), weaklabel.spans_of_labels(words), 100)
    got = sorted(map(tuple, by_label.collect()))
    assert got == sorted(map(tuple, by_table.collect()))
    assert [r[2] == "entity" for r in got] == [True, False, False] and got[1][2] == "anchor_strict"
    plan = parties.resolve(layout.paged(words), None, 100)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan and plan.count("Exchange") <= 1


def test_labels_read_as_expressions_read_them(spark):
    from docfields.functions import words as S

    texts = ["", "$ 1 140,24", "€-0", "12/20/2014", "20-12-14", "2014-2-30", "2014-02-03T1", "13.13.2014", "No-7!", " Tran  Inc ", "none", "-5,5", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for f in N.FIELDS:
        for r in df.select("t", N.token_value(f, F.col("t")).alias("word"), N.value_tokens(f, "t").alias("value")).collect():
            assert (S.token_value(f, r.t), list(S.value_tokens(f, r.t))) == (r.word, r.value), (f, r.t)


def test_labels_and_tables_come_from_pages_and_from_words(spark):
    """Pages that hold their true values, and words beside a table of these, give the same; neither shuffles words twice."""
    from docfields.operators import extract

    rows = [("Invoice", 5, 10), ("7788", 30, 12), ("Seller:", 5, 40), ("Tran-Kim", 5, 60), ("Hurst", 60, 61), ("Total", 5, 90), ("1", 20, 91), ("036,58", 40, 90), ("103,66", 60, 92), ("1", 70, 90), ("140,24", 80, 91)]
    words = spark.createDataFrame([(1, i, t, x, y, 8 * len(t), 16) for i, (t, x, y) in enumerate(rows)], "key long, word_idx long, text string, x int, y int, w int, h int")
    values = ("7788", None, "Tran-Kim Hurst", "Nobody", "103.66", "1036.58", "1140.24")
    truth = spark.createDataFrame([(1, *values)], "key long, " + ", ".join(f"{f} string" for f in N.FIELDS))
    held = layout.paged(words).join(truth.select("key", F.array(F.struct(*N.FIELDS)).alias("truth")), "key")
    one, two = weaklabel.weak_labels(held).collect(), weaklabel.weak_labels(words, layout.lines_greedy(words), truth).collect()
    assert one == two and len(one) == 1
    assert one[0]["spans"] == {"invoice_number": [1, 2], "seller_name": [3, 5], "tax": [8, 9], "net_worth": [6, 8], "total_amount": [9, 11]}
    assert one[0]["labels"][3:5] == ["B-SELLER_NAME", "I-SELLER_NAME"]
    lined = extract.line_items(layout.lines_greedy(words)).collect()
    assert sorted(lined) == sorted(extract.line_items(layout.paged(words)).collect()) and {r["raw_text"] for r in lined} >= {"Invoice 7788", "Total 1 036,58 103,66 1 140,24"}
    assert layout.distinct_places(words.union(words.withColumn("word_idx", F.col("word_idx") + 50))).collect() == [(1, len(rows))]


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables here")
@pytest.mark.parametrize("name", ["name_longest", "name_candidates_top5"])
def test_names_are_searched_where_pages_are_built(spark, name):
    """Words do not pass through Spark between building and search, and equal windows are searched once."""
    import __spark_entry__ as entry

    plan = entry.queries()[name](spark, TABLES)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange") == 1


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables here")
def test_unread_pages_give_what_built_pages_give(spark):
    from docfields.plans import whole_pages
    from docfields.plans.pages import NAMED, WIDTH

    got, want = (parties.candidates(p, ("client",), "right", WIDTH, most=20) for p in (whole_pages.unread_pages(spark, TABLES), whole_pages.pages(spark, TABLES, NAMED)))
    assert got.schema == want.schema and got.exceptAll(want).count() == want.exceptAll(got).count() == 0 < want.count()


def test_candidates_of_equal_windows_and_of_two_anchors():
    """A window met again is not searched again; spans that two anchors reach count once, at the smaller distance."""
    page = ["Client:", "Tran,", "Hurst", "and", "Kim", "Tax"]
    parties.window_candidates.cache_clear()
    one = parties.page_candidates(page, range(6), [0.75] * 6, ("client",), "right")
    two = parties.page_candidates(["x", *page, "y"], range(8), [0.75] * 8, ("client",), "right")
    assert parties.window_candidates.cache_info().misses == 1 and one[0][3:] == (1, 5, "Tran, Hurst and Kim")
    assert [(*c[:3], c[3] + 1, c[4] + 1, c[5]) for c in one] == two
    both = parties.page_candidates(["Client:", None, *page], range(8), [0.75] * 8, ("client",), "right")
    places = [c[3:] for c in both]
    assert len(places) == len(set(places)) and (0, 3, 7) in [(c[1], *c[3:5]) for c in both]
    assert parties.page_candidates(page, range(6), [0.75] * 6, ("client",), "right", most=2) == one[:2]


ODD = ("", " ", "Items", "SELLER:", "client", "total", "1", "036", "579,11", " Summary\n", "6", "x1", None, "10%", "1 036", "Kim", "and", "Hood-Kim")


def odd_pages(n):
    import random

    draw = random.Random(7)
    for _ in range(n):
        size = draw.randrange(1, 40)
        yield [draw.choice(ODD[:12] if draw.random() < 0.5 else ODD) for _ in range(size)], [draw.randrange(0, 1000, 50) for _ in range(size)], sorted(draw.randrange(0, 900, 9) for _ in range(size))


def test_pages_whose_places_are_a_range_give_the_same():
    for texts, xs, ys in odd_pages(300):
        ids, hs, ws = list(range(len(texts))), [16] * len(texts), [8 * len(t or "") for t in texts]
        lines = layout.page_lines(ys, xs, ids, hs)
        assert [v + 1 for v in lines] == layout.page_lines([*ys, None], [*xs, 0], [*ids, -1], [*hs, None])[:-1]  # a word without y is the first line
        both = range(len(texts)), ids
        one, two = (weaklabel.page_amounts(texts, xs, own, lines, True) for own in both)
        assert one == two
        centres = [parties.center(x, w, 1000) for x, w in zip(xs, ws)]
        for find in (parties.page_inline_pair, lambda *a: parties.page_nearest_after_anchor(*a, "client", 4.0), lambda *a: parties.page_nearest_after_anchor(*a, "seller", 4.0, nearest=True)):
            assert find(texts, both[0], centres) == find(texts, ids, centres)


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables here")
@pytest.mark.parametrize("name", ["weak_labels", "money_line_pages", "money_split_tokens", "line_items_table", "party_resolve", "resolution_source_status"])
def test_words_do_not_pass_through_spark(spark, name):
    from docfields.plans import catalogue, pages  # noqa: F401

    plan = catalogue.QUERIES[name](spark, TABLES)._jdf.queryExecution().analyzed().toString()
    assert "ws#" not in plan and "MapInArrow" in plan


def test_an_amount_of_the_money_line_is_not_searched(spark, monkeypatch):
    texts = "Seller: Kim 10% 6 579,11 657,91 7 237,02".split()
    truth = {"invoice_number": None, "invoice_date": None, "seller_name": "Kim", "client_name": None, "tax": "657.91", "net_worth": "6579.11", "total_amount": "7237.02"}
    searched = []
    monkeypatch.setattr(weaklabel, "most_similar", lambda hay, needle, *_: searched.append(needle))
    spans = weaklabel.page_spans_of_truth(texts, [60 * i for i in range(8)], range(8), ([0] * 8,), [truth])
    assert spans == [("seller_name", 1, 2), ("tax", 5, 6), ("net_worth", 3, 5), ("total_amount", 6, 8)]
    assert not [n for n in searched if n]
