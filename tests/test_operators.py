"""Operators on small hand-made pages, and their invariants."""

from decimal import Decimal

from pyspark.sql import functions as F

from docfields.operators import etl, evaluate, extract, generative, layout, parties, weaklabel
from docfields.sources import files
from docfields.streaming import pages as stream_pages

WORDS = "key long, word_idx long, text string, x int, y int, w int, h int, conf int"


def page(spark, words):
    return spark.createDataFrame([(1, i, t, x, y, 8 * len(t), 16, 90) for i, (t, x, y) in enumerate(words)], WORDS)


def test_greedy_lines_compare_with_the_first_word(spark):
    words = page(spark, [("a", 0, 10), ("b", 10, 14), ("c", 20, 19), ("d", 30, 24), ("e", 40, 40)]).withColumn("h", F.lit(8))
    got = [(r["text"], r["line_id"]) for r in layout.lines_greedy(words).orderBy("word_idx").collect()]
    assert got == [("a", 0), ("b", 0), ("c", 1), ("d", 1), ("e", 2)]


def test_mean_lines_follow_their_centre(spark):
    words = page(spark, [("a", 0, 10), ("b", 10, 16), ("c", 20, 20), ("d", 5, 60)])
    got = {r["text"]: r["line_id"] for r in layout.lines_running_mean(words).collect()}
    assert got["a"] == got["b"] == got["c"] != got["d"]


def test_pages_give_what_their_words_give(spark):
    rows = [("SUMMARY", 0, 10), ("1", 5, 40), ("036", 20, 41), ("579,11", 60, 40), ("5", 5, 70), ("100,00", 20, 72), ("5", 5, 70), ("12.50", 90, 41), ("Client:", 0, 90), ("Fuller-Johnson", 70, 91), (" 7 ", 5, 99)]
    words = page(spark, rows).unionByName(page(spark, rows[::-1]).withColumn("key", F.lit(2).cast("long")))
    whole = layout.paged(words)
    same = lambda a, b: sorted(map(str, a.select(*sorted(a.columns)).collect())) == sorted(map(str, b.select(*sorted(a.columns)).collect()))
    assert same(layout.unpaged(whole), words)
    assert same(layout.unpaged(layout.deduped(whole)), layout.deduped(words)) and layout.deduped(words).count() == 20
    assert same(layout.lines_greedy(whole), layout.lines_greedy(words)) and same(layout.lines_running_mean(whole), layout.lines_running_mean(words))
    assert same(weaklabel.split_money(layout.lined_pages(whole)), weaklabel.split_money(layout.lines_greedy(words)))
    assert same(weaklabel.money_ngrams(whole), weaklabel.money_ngrams(words))
    assert {(str(r["amount"]), r["pos"]) for r in weaklabel.money_ngrams(words).where("key = 1").collect()} >= {("1036579.11", 1), ("36579.11", 2), ("12.50", 7), ("7.00", 10)}
    assert same(parties.candidates(whole, ("client",), "right", 100), parties.candidates(words, ("client",), "right", 100))


def test_derived_words_are_shuffled_and_ranked_nowhere(spark, tmp_path):
    from docfields.plans import fixtures

    line = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate date"
    spark.createDataFrame([(k, 2, 3, n, 1.0, 10.0, 0.0, 0.1, "A", "F", None) for k in (1, 1, 2) for n in (1, 2)], line).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.sql("select 1L as o_orderkey, 5L as o_custkey, date'2020-01-02' as o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    words = fixtures.frame(spark, str(tmp_path), "words")
    texts = {r["key"]: r["t"] for r in words.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("word_idx", "text"))).alias("t")).collect()}
    assert [w[0] for w in texts[1]] == list(range(len(texts[1]))) and texts[1][0][1] == "Invoice" and texts[2][0][1] == "1."
    assert len(texts[2]) == 2 * 11
    plan = words.groupBy("key").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Window" not in plan


def test_a_written_table_leaves_no_shuffle_behind(spark, tmp_path):
    from docfields.llm import common

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    seen, df = [], spark.range(10).repartition(3, "id")
    real = df.sparkSession.conf.set
    before = spark.conf.get(name)
    spark.conf.set = lambda k, v: (seen.append((k, v)), real(k, v))
    try:
        assert common.materialize(df, "t").count() == 10
    finally:
        del spark.conf.set
    assert (name, "true") in seen and spark.conf.get(name) == before


def test_triplet_of_a_spaced_row(spark):
    df = spark.createDataFrame([("10% 6 579,11 657,91 7 237,02",), ("1036,58 103,66 1140,24",), ("5,00",), ("3,00 9,00",), ("0,00 7,00",)], "t string")
    got = [r["s"] and tuple(r["s"]) for r in df.select(extract.assign_summary(extract.money_tokens(F.col("t"))).alias("s")).collect()]
    d = Decimal
    assert got[0] == (d("657.91"), d("6579.11"), d("7237.02"))
    assert got[1] == (d("103.66"), d("1036.58"), d("1140.24"))
    assert got[2] is None
    assert got[3] == (d("3.00"), None, d("9.00"))
    assert got[4] == (d("0.00"), d("7.00"), d("7.00"))


def test_totals_are_searched_among_all_amounts(spark):
    # one amount a line, so only all together can add up: exactly in the middle (400 + 1700), then nearly
    apart = [1000 * 3**k for k in range(3, 14)]
    pages = [[11, 12, 400, 1700, 2100, 80000, *apart, 14, 16, 17], [n * n * 1009 + 70000 for n in range(2, 22)][::-1]]
    rows = [(key, line, f"{n},00") for key, own in enumerate(pages) for line, n in enumerate(own)]
    got = {r["key"]: r for r in extract.totals(spark.createDataFrame(rows, "key long, line_id int, text string")).collect()}

    def best(own):
        own = sorted({100 * n for n in own})
        fits = [(abs(a + b - c), -c, -b, a) for c in own for a in own for b in own if a <= b and abs(a + b - c) / 100 <= max(c / 100 * 0.015, 1.0)]
        err, c, b, a = min(fits)
        return a / 100, -b / 100, -c / 100

    for key, own in enumerate(pages):
        assert got[key]["path"] == "fallback_all_amounts"
        assert tuple(float(got[key][c]) for c in ("tax", "net_worth", "total_amount")) == best(own)


def test_the_end_of_a_spaced_amount_is_no_zero(spark):
    df = spark.createDataFrame([("62 500,01 5 000,00 67 500,01",), ("5 100,00 20,00 120,00",), ("0,00 1 000 000,00 1 000 000,00",)], "t string")
    got = [tuple(r["s"]) for r in df.select(extract.assign_summary(extract.money_tokens(F.col("t"))).alias("s")).collect()]
    d = Decimal
    assert got[0] == (d("5000.00"), d("62500.01"), d("67500.01"))
    assert got[1] == (d("20.00"), d("100.00"), d("120.00"))
    assert got[2] == (d("0.00"), d("1000000.00"), d("1000000.00"))


def test_the_money_line_may_hold_millions(spark):
    words = page(spark, [(t, 60 * i, 10) for i, t in enumerate("10% 1 036 579,11 96 657,91 1 133 237,02".split())]).withColumn("line_id", F.lit(0))
    truth = spark.createDataFrame([(1, "96657.91", "1036579.11", "1133237.02")], "key long, tax string, net_worth string, total_amount string")
    got = {(r["field"], r["start"], r["end"]) for r in weaklabel.line_money_spans(words, truth).collect()}
    assert got == {("net_worth", 1, 4), ("tax", 4, 6), ("total_amount", 6, 9)}


def test_party_names_are_cut_at_the_second_firm(spark):
    df = spark.createDataFrame([("Tran, Hurst and Rodgers Stephenson Inc 12",), ("Mendoza and Sons Fuller, Martin and Hays",), ("Acme Inc",)], "t string")
    assert [r[0] for r in df.select(parties.cut_seller("t")).collect()] == ["Tran, Hurst and Rodgers", "Mendoza and Sons", "Acme"]


def test_tail_is_expanded_to_the_left(spark):
    df = spark.createDataFrame([(["by", "Hood,", "Andrade", "and", "Kim", "x"], "Andrade and Kim"), (["a"], "b")], "ws array<string>, t string")
    assert [r[0] for r in df.select(parties.expand_tail(F.col("ws"), F.col("t"))).collect()] == ["Hood, Andrade and Kim", "b"]


def test_labels_and_spans_round_trip(spark):
    words = page(spark, [(t, 10 * i, 10) for i, t in enumerate("a b c d e".split())])
    spans = spark.createDataFrame([(1, "tax", 1, 3), (1, "client_name", 2, 4), (1, "total_amount", 4, 5)], "key long, field string, start long, end long")
    labelled = weaklabel.labels_of_spans(words, spans, ["client_name", "tax", "total_amount"])
    back = {(r["field"], r["start"], r["end"]) for r in weaklabel.spans_of_labels(labelled).collect()}
    assert back == {("client_name", 2, 4), ("total_amount", 4, 5)}


def test_orphans_are_dropped(spark):
    rows = [(1, i, w, lab) for i, (w, lab) in enumerate([("a", "I-TAX"), ("b", "B-TAX"), ("c", "I-TAX"), ("d", "I-NET_WORTH"), ("e", "I-TAX")])]
    df = spark.createDataFrame(rows, "key long, word_idx long, text string, label string")
    assert [(r["field"], r["text"]) for r in weaklabel.spans_of_labels(df).collect()] == [("tax", "b c")]


def similar(spark, rows):
    kind = "key long, field string, hay array<string>, needle array<string>, least double, ranges array<struct<first:int,stop:int>>, guided boolean"
    return {r["key"]: (r["start"], r["end"]) for r in weaklabel.similar_spans(spark.createDataFrame(rows, kind)).collect()}


def test_similar_spans_against_every_window(spark):
    import random

    from docfields.functions.similarity import indel_ratio

    rng, rows, want = random.Random(3), [], {}
    lexicon = "andrade kim kin and sons vat total fuller inc a".split()
    for key in range(120):
        hay, needle = ([rng.choice(lexicon) for _ in range(rng.randint(0, 14))] for _ in range(2))
        needle = needle[:4]
        ranges = [(0, len(hay))] if key % 2 else [(f, min(len(hay), f + 6)) for f in sorted(rng.sample(range(15), 2)) if f < len(hay)]
        least, guided = rng.choice([0.5, 0.7, 0.92]), key % 3 == 0
        rows.append((key, "f", hay, needle, least, ranges, guided))
        found = [
            (-indel_ratio(" ".join(needle), " ".join(hay[s : s + n])), i, n, s)
            for i, (lo, hi) in enumerate(ranges) for n in range(max(1, len(needle) - 2), len(needle) + 3) for s in range(lo, hi - n + 1)
            if needle and not (guided and set(hay[s : s + n]) & set(weaklabel.REJECT))
        ]
        if found and -min(found)[0] >= least:
            _, _, n, s = min(found)
            want[key] = (s, s + n)
    assert similar(spark, rows) == want and len(want) > 20


def test_assigned_spans_never_overlap(spark):
    rows = [(1, [(2, "b", 3, 6), (1, "a", 0, 4), (3, "b", 4, 6), (4, "a", 8, 9)])]
    got = spark.createDataFrame(rows, "key long, c array<struct<order:int,field:string,start:bigint,end:bigint>>").select(weaklabel.assigned(F.col("c"))).first()[0]
    assert [(x["field"], x["start"]) for x in got] == [("a", 0), ("b", 4)]


def test_aliases_parts_and_label_map(spark, tmp_path):
    df = spark.createDataFrame([(1, "v", None, "2020-01-01"), (2, "w", "s", None)], "key long, vendor_name string, seller_name string, date string")
    got = etl.rename_aliases(df, {"vendor_name": "seller_name", "date": "invoice_date"})
    assert got.columns == ["key", "seller_name", "invoice_date"] and [r["seller_name"] for r in got.orderBy("key").collect()] == ["v", "s"]
    labels = spark.createDataFrame([("I-TAX",), ("O",), ("B-TAX",), ("O",)], "label string")
    files.write_label_map(labels, str(tmp_path))
    assert {r["label"]: r["id"] for r in files.read_label_map(spark, str(tmp_path)).collect()} == {"O": 0, "B-TAX": 1, "I-TAX": 2}


def test_generated_text_is_parsed_by_marks_then_json(spark, tmp_path):
    df = spark.createDataFrame([(1, "<s_inv><s_tax>5</s_tax><s_tax>6</s_tax></s>"), (2, '<t>{"a": "x",}'), (3, "plain")], "key long, t string")
    got = {r["key"]: r["m"] for r in df.select("key", generative.parsed_text(F.col("t")).alias("m")).collect()}
    assert got == {1: {"tax": "6"}, 2: {"a": "x"}, 3: {"raw_text": "plain"}}
    files.write_generated(generative.result_rows(df, "key", "t"), df, str(tmp_path))
    back = files.read_csv(spark, f"{tmp_path}/donut_invoice_results", "key long, raw_sequence string, parsed_keys string")
    assert {r["parsed_keys"] for r in back.collect()} == {"tax", "a", "raw_text"}


def test_metrics_stay_in_range_and_count_missing_columns(spark):
    truth = spark.createDataFrame([("a", "1", "2,00"), ("b", "2", "3,00")], "key string, invoice_number string, tax string")
    pred = spark.createDataFrame([("a", "1"), ("b", "9")], "key string, invoice_number string")
    got = {r["field"]: r for r in evaluate.exact_match(truth, pred, "key", ("invoice_number", "tax")).collect()}
    assert got["invoice_number"]["accuracy"] == 0.5 and got["invoice_number"]["f1"] == 0.5
    assert got["tax"]["predicted_count"] == 0 and got["tax"]["precision"] is None


def test_degenerate_texts(spark):
    cases = {"a b c": True, "one two three four five": False, "go " * 8 + "one two three four five six seven": True, " ".join("ab" for _ in range(30)): True}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert [r[0] for r in df.select(generative.degenerate(F.col("t"))).collect()] == list(cases.values())


def test_batches_and_sinks(spark, tmp_path):
    (tmp_path / "batch1_1.csv").write_text('File Name,Json Data,OCRed Text\na.jpg,"{""invoice"": {}}","two\nlines"\n')
    raw = files.read_batches(spark, str(tmp_path))
    assert [(r["file_name"], r["batch_csv"], r["ocr_text"]) for r in raw.collect()] == [("a.jpg", "batch1_1.csv", "two\nlines")]
    try:
        files.read_batches(spark, str(tmp_path), "none.csv")
        raise AssertionError
    except FileNotFoundError:
        pass
    files.write_jsonl(raw, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_stream_gives_the_batch_result(spark, tmp_path):
    words = page(spark, [("a", 0, 10), ("b", 10, 12), ("c", 0, 60)])
    words.write.parquet(str(tmp_path / "in"))
    plan = lambda df: layout.line_texts(layout.lines_greedy(df))
    q = stream_pages.extract_stream(spark, str(tmp_path / "in"), WORDS, plan, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    got = {r["text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r["text"] for r in plan(words).collect()} == {"a b", "c"}
