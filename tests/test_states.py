"""Merged fact states against the direct aggregation, and what a further cutoff reads."""

import pytest
from pyspark.sql import functions as F

from ebbflow.operators import features as FE
from ebbflow.operators import states as ST
from ebbflow.sources.buckets import bucketed_stage
from tests.test_features import TXN_SCHEMA

ROWS = [("a", 1, 10, 30, 100, 100, 1, 20170101, 20170131, 0),
        ("a", 2, 11, 30, 100, 90, 0, 20170228, 20170303, 0),
        ("a", 3, 10, 30, 0, 0, 1, 20170228, 19700101, 1),    # same day, higher id
        ("a", 4, None, 30, None, 100, 1, 20170301, 20170331, 0),
        ("a", 4, None, 30, None, 100, 1, 20170301, 20170331, 0),   # a repeated row counts twice
        ("b", 5, 10, 30, 0, 0, 1, 20170110, 20170209, 0),
        ("b", 6, 10, 30, 0, 0, 1, None, 20170209, 0),
        (None, 7, 12, 30, 10, 10, 1, 20170315, 20170209, 0)]


def _rows(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)


def _months(txn):
    return ST.partial_states(ST.with_month(txn), ["msno", "month"])


@pytest.mark.parametrize("cutoff", [20161231, 20170101, 20170131, 20170227, 20170228, 20170301, 20170314, 20170315, 20170331])
def test_any_cutoff_equals_the_direct_aggregation(spark, cutoff):
    txn = spark.createDataFrame(ROWS, TXN_SCHEMA)
    direct = FE.transaction_aggregates(txn, cutoff)
    merged = ST.aggregates(ST.state_at(_months(txn), cutoff, txn))
    assert sorted(merged.columns) == sorted(direct.columns)
    assert _rows(merged) == _rows(direct)


def test_a_state_goes_on_with_later_rows_only(spark):
    txn = spark.createDataFrame(ROWS, TXN_SCHEMA)
    state = ST.state_at(_months(txn), 20170131)
    later = txn.where(F.col("transaction_date").between(20170201, 20170331))
    assert _rows(ST.aggregates(ST.advance(state, later))) == _rows(FE.transaction_aggregates(txn, 20170331))


def test_empty_fact_clashing_columns_and_a_missing_edge(spark):
    empty = spark.createDataFrame([], TXN_SCHEMA)
    assert ST.aggregates(ST.state_at(_months(empty), 20170115, empty)).count() == 0
    extra = spark.createDataFrame(ROWS, TXN_SCHEMA).withColumn("month", F.lit(1)).withColumn("latest", F.lit("x"))
    assert _rows(ST.aggregates(ST.state_at(_months(extra), 20170228))) == \
        _rows(FE.transaction_aggregates(extra, 20170228))
    with pytest.raises(ValueError, match="20170115"):
        ST.state_at(_months(empty), 20170115)


def test_edge_months():
    assert ST.edge_month(20000229) is None and ST.edge_month(20010131) is None
    assert ST.edge_month(20000228) == (20000201, 20000228)


def test_second_cutoff_reads_no_fact_outside_its_edge_month(spark, chain_small):
    chain_small.monthly_states()  # written
    for cutoff in (20000731, 20010131):
        files = chain_small.state_at(cutoff).inputFiles()
        assert files and all("/monthly_states/" in f for f in files)
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")  # pushed filters in full
    try:
        plan = chain_small.state_at(20001215)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(o_orderdate,2000-12-01" in plan and "LessThan(o_orderdate,2000-12-16" in plan
    assert "LessThan(month,200012)" in plan
    direct = FE.transaction_aggregates(chain_small.transactions(), 20001215)
    assert _rows(ST.aggregates(chain_small.state_at(20001215))) == _rows(direct)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_modeling_dataset_on_bucketed_stages_has_no_exchange(spark, chain_small):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables too large to broadcast
    try:
        ds = chain_small.dataset_from_states()
        assert "Exchange" not in _plan(ds) and "SortMergeJoin" in _plan(ds)
        assert "Exchange" in _plan(chain_small.build_dataset())
        assert _rows(ds) == _rows(chain_small.build_dataset())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_new_session_declares_the_committed_buckets_again(spark, tmp_path):
    txn = spark.createDataFrame(ROWS, TXN_SCHEMA)
    first = bucketed_stage(spark, "months", lambda: _months(txn), root=str(tmp_path))
    expected = _rows(first)
    table = first.inputFiles() and [t.name for t in spark.catalog.listTables() if t.name.startswith("stage_")]
    for name in table:
        if spark.sql(f"DESCRIBE FORMATTED {name}").where(F.col("data_type").contains(str(tmp_path))).count():
            spark.sql(f"DROP TABLE {name}")  # forgets the entry, as the end of a session does; files stay

    def never():
        raise AssertionError("a committed stage was built again")

    again = bucketed_stage(spark, "months", never, root=str(tmp_path))
    assert _rows(again) == expected
    assert "Exchange" not in _plan(ST.merge_states(again.drop("month"), ["msno"]))


def test_empty_table_in_buckets(spark, tmp_path):
    empty = spark.createDataFrame([], TXN_SCHEMA)
    assert bucketed_stage(spark, "empty", lambda: empty, root=str(tmp_path)).count() == 0
    assert bucketed_stage(spark, "empty", lambda: empty, root=str(tmp_path)).columns == empty.columns
