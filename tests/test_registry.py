"""A few registered queries against their SQL at the smallest scale; tools/check_oracles.py runs all of them."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = ["c06_rank_tags", "c10_threshold_summary", "e06_bias_overall_by_threshold", "e10_paired_log2fc", "h07_joint_rank", "d12_unify_to_targets", "g09_region_kmers_full", "i07_topbias"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 200


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in "documents part lineitem orders supplier".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name]).fetchdf()
    got = entry.queries()[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    key = lambda d: sorted(map(repr, d[cols].astype(object).itertuples(index=False, name=None)))
    assert cols == sorted(got.columns) and len(got) == len(want) > 0
    norm = lambda d: d[cols].map(lambda v: float(v) if not isinstance(v, str) and v is not None else v)
    assert key(norm(got)) == key(norm(want))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
