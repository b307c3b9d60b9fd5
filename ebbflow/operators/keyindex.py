"""Layouts for the two searches on a key: the exact one (B32) and the literal substring.

*Exact key.*  ``key_ordered`` lays a table out in ranges of the key; written with ``bloom_options`` its row groups
carry bounds and a bloom filter, so an equality on the key, pushed to the reader, reads one row group.

*Substring.*  ``postings`` holds a row for each table row and distinct trigram of its lower-cased key, in the order of
the trigrams.  Any trigram of a needle is in every key that holds the needle, so the shortest of its lists, checked
exactly on the key that stands in the row, is the whole answer; intersecting more lists would read more rows for the
same result.  List lengths are a table of their own (``posting_counts``), so a search reads a handful of counts and one
list, and shuffles nothing.  A list is ranges of rows, not an array: one that most keys share takes several files.
Needles below three letters are answered by the scan.

A null key matches nothing, repeated rows come back as often as they are there, an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbflow.functions.expr import id_search

GRAM = 3


def bloom_options(key: str, row_group_bytes: int = 16 << 20) -> dict[str, str]:
    """Parquet options: a bloom filter on the key and row groups small enough to read for one row."""
    return {f"parquet.bloom.filter.enabled#{key}": "true", "parquet.block.size": str(row_group_bytes)}


def key_ordered(df: DataFrame, key: str = "msno") -> DataFrame:
    return df.repartitionByRange(key).sortWithinPartitions(key)


def postings(df: DataFrame, key: str = "msno", keep: list[str] | None = None) -> DataFrame:
    """(gram, key, kept columns), ordered by gram and key."""
    low = F.lower(F.col(key))
    grams = F.when(F.length(low) >= GRAM, F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.length(low) - (GRAM - 1)), lambda i: low.substr(i, F.lit(GRAM)))))
    rows = df.select(F.explode(grams).alias("_gram"), key, *(keep or []))
    return rows.repartitionByRange("_gram", key).sortWithinPartitions("_gram", key)


def posting_counts(lists: DataFrame) -> DataFrame:
    """Length of each list, ordered by gram."""
    return lists.groupBy("_gram").agg(F.count(F.lit(1)).alias("n")).repartitionByRange("_gram").sortWithinPartitions("_gram")


def search(table: DataFrame, lists: DataFrame, counts: DataFrame, needle: str, key: str = "msno") -> DataFrame:
    """The rows whose key holds the needle, in either case, with the columns that the lists keep."""
    columns = [c for c in lists.columns if c != "_gram"]
    low = needle.lower()  # as the exact check has it
    grams = sorted({low[i:i + GRAM] for i in range(len(low) - GRAM + 1)})
    if not grams:
        return table.where(id_search(F.col(key), needle)).select(*columns)
    known = counts.where(F.col("_gram").isin(grams)).collect()  # a row for each trigram of the needle at most
    if len(known) < len(grams):
        return lists.where(F.lit(False)).select(*columns)
    shortest = min(known, key=lambda r: (r["n"], r["_gram"]))["_gram"]
    return lists.where((F.col("_gram") == shortest) & id_search(F.col(key), needle)).select(*columns)
