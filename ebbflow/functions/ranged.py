"""Running sums and exact quantiles over ranges, for groups of any size.

Rows are range-partitioned on (group, value) and written to a reliable checkpoint once, so
the sampled bounds stay fixed.  A window inside each (range, group) gives the running sum,
and per-(range, group) totals - a table of about as many rows as ranges and groups - give
what lies before the range and the group's whole.  No task holds more than a range, no
group is dealt to one task, and there is one path for every size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbflow.session import ensure_checkpoint_dir

ROWS_PER_RANGE = 200_000


def _same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Null-safe equi-join that keeps the left keys."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def running_sums(df: DataFrame, by: list[str], order: list[Column], cols: list[str],
                 rows_per_range: int | None = None) -> DataFrame:
    """``df`` with ``cum_<c>`` (sum over the group's rows up to this one, which it includes) and
    ``all_<c>`` (sum over the group) for each of ``cols``.  Within a group ``order`` must not tie."""
    ensure_checkpoint_dir(df.sparkSession)
    held = df.persist()
    try:
        parts = max(1, -(-held.count() // (rows_per_range or ROWS_PER_RANGE)))
        ranged = held.repartitionByRange(parts, *[F.col(b) for b in by], *order) if by or order else held
        ranged = ranged.withColumn("_range", F.spark_partition_id()).checkpoint(eager=True)
    finally:
        held.unpersist()
    keys = ["_range", *by]
    totals = ranged.groupBy(*keys).agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_off_{c}") for c in cols],
        *[F.sum(f"_t_{c}").over(group).alias(f"all_{c}") for c in cols])
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.select("*", *[F.sum(c).over(inside).alias(f"_in_{c}") for c in cols])
    out = _same(out, offsets, keys)
    return out.select(*df.columns, *[(F.col(f"_in_{c}") + F.col(f"_off_{c}")).alias(f"cum_{c}") for c in cols],
                      *[f"all_{c}" for c in cols])


def quantiles(df: DataFrame, by: list[str], specs: dict[str, tuple[Column | str, float | list[float]]],
              rows_per_range: int | None = None) -> DataFrame:
    """One row per group: for each alias the linearly interpolated quantile(s) of a column over its
    non-null values (a list of probabilities gives an array).  Values are collapsed to (group,
    column, value, count) in the tasks before anything is shuffled."""
    names = list(specs)
    values = [F.col(x) if isinstance(x, str) else x for x, _ in specs.values()]
    entries = F.array(*[F.struct(F.lit(k).alias("q"), v.cast("double").alias("v")) for k, v in enumerate(values)])
    long = df.select(*by, F.explode(entries).alias("_e")).select(*by, F.col("_e.q").alias("_q"), F.col("_e.v").alias("_v"))
    counted = long.where(F.col("_v").isNotNull()).groupBy(*by, "_q", "_v").agg(F.count(F.lit(1)).alias("_n"))
    cum = running_sums(counted, [*by, "_q"], [F.col("_v")], ["_n"], rows_per_range)
    picks, parts = [], []
    for k, (name, (_, probs)) in enumerate(zip(names, specs.values())):
        for j, p in enumerate(probs if isinstance(probs, list) else [probs]):
            place = F.lit(float(p)) * (F.col("all__n") - 1)
            for side, rank in (("lo", F.floor(place)), ("hi", F.ceil(place))):
                here = (F.col("_q") == k) & (F.col("cum__n") - F.col("_n") <= rank) & (rank < F.col("cum__n"))
                picks.append(F.max(F.when(here, F.col("_v"))).alias(f"_{side}_{k}_{j}"))
            picks.append(F.max(F.when(F.col("_q") == k, place - F.floor(place))).alias(f"_f_{k}_{j}"))
        one = [_between(F.col(f"_lo_{k}_{j}"), F.col(f"_hi_{k}_{j}"), F.col(f"_f_{k}_{j}"))
               for j in range(len(probs) if isinstance(probs, list) else 1)]
        parts.append((F.array(*one) if isinstance(probs, list) else one[0]).alias(name))
    return cum.groupBy(*by).agg(*picks).select(*by, *parts)


def _between(lo: Column, hi: Column, share: Column) -> Column:
    """Linear interpolation that is exact inside a block of ties and never leaves [lo, hi]."""
    return F.when((share == 0) | (lo == hi), lo).otherwise(F.least(hi, lo + share * (hi - lo)))


def with_quantiles(agg: DataFrame, df: DataFrame, by: list[str], specs: dict) -> DataFrame:
    """``agg`` (a row per group) with the quantile columns of ``df`` beside it."""
    return _same(agg, quantiles(df, by, specs), by, "left")


def quantile_row(df: DataFrame, specs: dict):
    """The quantiles of a whole frame as one driver-side row (scalars)."""
    return quantiles(df, [], specs).first()
