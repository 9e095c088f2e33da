"""Registered queries against their oracle on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from docfields.plans import catalogue

SF = "/root/testdata/sf0.001"
CHECKED = [
    "eval_exact_match", "eval_zonal", "eval_gap_summary", "eval_numeric_error", "eval_tolerant", "etl_clean_invoices", "join_outer", "describe_totals",
    "split_vendor_three", "sample_by_fraction", "alias_rename", "similarity_ratio", "name_candidates_top5", "name_longest", "fuzzy_windows", "anchor_windows",
    "gen_mark_fields", "gen_result_rows", "label_ids", "words_lines_greedy", "words_regions", "totals_cascade", "line_items_table", "name_candidates_top20", "bio_labels", "vote_labels", "gen_json_fields", "gen_degenerate", "train_frame",
]


def plain(df):
    df = df[sorted(df.columns)]
    rows = [tuple(None if v is None or v != v else round(v, 6) if isinstance(v, float) else str(v) for v in row) for row in df.itertuples(index=False)]
    return sorted(rows, key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", CHECKED)
def test_against_oracle(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    want = con.execute(catalogue.ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(catalogue.QUERIES) > 70
