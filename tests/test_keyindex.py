"""Key-ordered stage (row groups read for one key) and posting lists against the scan."""

import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from ebbflow.functions.expr import id_search
from ebbflow.operators import keyindex as KI
from ebbflow.sources.stages import run_stage

KEYS = ["C+12/=", "c+12/x", "C+120/=", "AAAA", "aaa", "ab", "", None, "50%_a", "50%_a", "ÄÖÜß-öäü", "x" * 5000 + "yzw", "C+3/="]


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def _rows_scanned(df):
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().get("numOutputRows").get().value() for i in range(leaves.size()))


@pytest.fixture(scope="module")
def index(spark):
    table = spark.createDataFrame([(k, i, "p") for i, k in enumerate(KEYS)], "msno string, n int, gram string")
    lists = KI.postings(table, keep=["n", "gram"]).persist()  # a kept column of a clashing kind of name
    return table, lists, KI.posting_counts(lists).persist()


@pytest.mark.parametrize("needle", ["C+12", "c+1", "/=", "", "a", "AAA", "aaaa", "50%_", "%_a", "äöü", "ÖÜ", "xyz", "yzw", "x" * 4000,
                                    "nothing", "C+12/=", "12/=C+1"])
def test_search_equals_the_scan(index, needle):
    table, lists, counts = index
    scan = table.where(id_search("msno", needle)).select("msno", "n", "gram")
    assert _rows(KI.search(table, lists, counts, needle)) == _rows(scan)


def test_search_reads_one_list_without_a_shuffle(spark, index, tmp_path):
    table, lists, _ = index
    stored = run_stage(spark, "postings", lambda: lists, root=str(tmp_path))
    counts = run_stage(spark, "counts", lambda: KI.posting_counts(stored), root=str(tmp_path))
    found = KI.search(table, stored, counts, "c+120")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "EqualTo(_gram," in plan
    assert [r["msno"] for r in found.collect()] == ["C+120/="]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "msno string, n int")
    lists = KI.postings(empty, keep=["n"])
    for needle in ("C+12", "C"):
        assert KI.search(empty, lists, KI.posting_counts(lists), needle).count() == 0


def test_one_key_reads_one_row_group(spark, tmp_path):
    n, root = 60000, str(tmp_path)
    table = spark.range(n).select(F.format_string("K%08d", F.col("id") * 7 % n).alias("msno"), F.md5(F.col("id").cast("string")).alias("v"))
    stage = run_stage(spark, "by_key", lambda: KI.key_ordered(table), root=root, options=KI.bloom_options("msno", 65536))
    groups = []
    for f in glob.glob(f"{root}/by_key/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        groups += [(g.column(0).statistics.min, g.column(0).statistics.max, g.num_rows)
                   for g in map(meta.row_group, range(meta.num_row_groups))]
    key = "K00031415"
    holding = [rows for low, high, rows in groups if low <= key <= high]
    assert len(groups) > 8 and len(holding) == 1
    found = stage.where(F.col("msno") == key)
    assert [r["msno"] for r in found.collect()] == [key]
    assert 0 < _rows_scanned(found) <= holding[0] < n / 8
    # inside the bounds of a row group but in none: the bloom filter leaves no row group to read
    assert _rows_scanned(stage.where(F.col("msno") == key + "x")) == 0
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
