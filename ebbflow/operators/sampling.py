"""Deterministic exact-size sample.

Each row gets a hash uniform of its key; the sample is the n rows with the
smallest uniforms (ties by key).  A pre-filter ``u < t`` with t set 10 standard
deviations above n/N keeps the top-k input tiny on large tables; if the filter
ever keeps fewer than n rows, the unfiltered top-k is used, so the result is the
same exact sample either way."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbflow.functions.expr import hash_uniform


def exact_sample(df: DataFrame, n: int, key: str = "msno", salt: str = "sample") -> DataFrame:
    u = hash_uniform(F.col(key), F.lit(salt))
    withu = df.withColumn("_u", u)
    total = df.count()
    if total <= n:
        return df
    t = min(1.0, (n + 10 * math.sqrt(n) + 100) / total)
    cand = withu.where(F.col("_u") < F.lit(t))
    if t < 1.0 and cand.count() < n:
        cand = withu
    return cand.orderBy("_u", key).limit(n).drop("_u")


def stratified_sample(df: DataFrame, n: int, label: str = "is_churn", key: str = "msno",
                      salt: str = "strat") -> DataFrame:
    """H1 (capped stratified sample): exactly round(n * n_c / N) rows of each
    class c (largest-remainder rounding so the sizes sum to n), each class an
    exact hash sample.  Class counts are a fixed-size result (one row per class)."""
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    total = sum(counts.values())
    if total <= n:
        return df
    raw = {c: n * k / total for c, k in counts.items()}
    take = {c: int(math.floor(v)) for c, v in raw.items()}
    for c in sorted(raw, key=lambda c: (-(raw[c] - take[c]), str(c)))[: n - sum(take.values())]:
        take[c] += 1
    parts = [exact_sample(df.where(F.col(label) == F.lit(c)), k, key, salt) for c, k in sorted(take.items(), key=lambda kv: str(kv[0]))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
