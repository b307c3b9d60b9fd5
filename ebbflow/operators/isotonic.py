"""Isotonic regression over score ranges.

The fit pools adjacent violators.  Distinct scores (x, n, positives) are dealt into ranges of
about ``rows_per_range`` and each range is pooled in its task; what can still violate are the
borders.  Each round then moves the borders by half a range and pools again, until the first
block of every range lies above the last block of the one before - the whole sequence is then
monotone, and a monotone sequence of pools of adjacent violators is the fit.  Blocks only ever
shrink in number, no task holds more than a range and nothing but the number of blocks comes to
the driver, so scores of a real model, which are nearly all distinct, may be fitted as they are.

A fit is a table of blocks.  It is applied by placing scores and block ends on one ordered line
(again in ranges, with the ends before and after each range beside it): a score inside a block has
its value, one between two blocks is interpolated linearly, one outside has the nearest value.

Defined results: rows with a null score or label are not fitted; a null score has no value; a fit
to no rows has no block and gives no values.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbflow.session import ensure_checkpoint_dir

ROWS_PER_RANGE = 200_000
BLOCK = "seat long, lo double, hi double, n double, pos double"


@dataclass(frozen=True)
class IsotonicFit:
    blocks: DataFrame       # lo, hi, fit: pooled score intervals, disjoint and ascending
    rounds: int
    rows_per_range: int


def pool(n: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """First places of the pools of adjacent violators of sorted blocks."""
    first: list[int] = []
    size: list[float] = []
    hits: list[float] = []
    for k, (a, b) in enumerate(zip(n.tolist(), pos.tolist())):
        at = k
        while first and hits[-1] * a >= b * size[-1]:      # rates in cross products: sums of whole numbers stay exact
            at = first.pop()
            a += size.pop()
            b += hits.pop()
        first.append(at)
        size.append(a)
        hits.append(b)
    return np.array(first, np.int64)


def _pooled(ordered: DataFrame) -> DataFrame:
    """Blocks pooled inside each partition, whose rows are sorted by (seat, lo); a seat is a range."""

    def done(held):
        t = pa.Table.from_batches(held)
        lo, hi, n, pos = (t.column(c).to_numpy() for c in ("lo", "hi", "n", "pos"))
        first = pool(n, pos)
        last = np.append(first[1:], len(n)) - 1
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(first), t.column("seat")[0].as_py())), pa.array(lo[first]), pa.array(hi[last]),
             pa.array(np.add.reduceat(n, first)), pa.array(np.add.reduceat(pos, first))], ["seat", "lo", "hi", "n", "pos"])

    def run(batches):
        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            seat = batch.column("seat").to_numpy()
            cuts = np.flatnonzero(seat[1:] != seat[:-1]) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(seat)]):
                if held and held[0].column("seat")[0].as_py() != seat[a]:
                    yield done(held)
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield done(held)

    return ordered.select("seat", "lo", "hi", "n", "pos").mapInArrow(run, BLOCK)


def _moves(blocks: DataFrame) -> bool:
    """Whether some range starts below the end of the range before it: one row a range."""
    rate = F.col("pos") / F.col("n")
    ends = blocks.groupBy("seat").agg(F.min_by(rate, "lo").alias("first"), F.max_by(rate, "lo").alias("last"))
    before = F.lag("last").over(Window.orderBy("seat"))
    return not ends.select((F.col("first") <= before).alias("down")).filter("down").isEmpty()


def fit(scores: DataFrame, rows_per_range: int | None = None) -> IsotonicFit:
    """The isotonic fit to distinct scores (x, n, pos)."""
    ensure_checkpoint_dir(scores.sparkSession)
    per = rows_per_range or ROWS_PER_RANGE
    known = scores.filter(F.col("x").isNotNull() & (F.col("n") > 0))
    state = known.select(F.lit(0).cast("long").alias("seat"), F.col("x").alias("lo"), F.col("x").alias("hi"), "n", "pos").checkpoint()
    count, rounds, shifted = state.count(), 0, False
    while count:
        ranges = max(1, -(-count // per))
        if not shifted:
            dealt = state.repartitionByRange(ranges, "lo").withColumn("seat", F.spark_partition_id().cast("long")).sortWithinPartitions("lo")
        else:       # the second half of each range goes with the first half of the next
            inside = Window.partitionBy("seat").orderBy("lo")
            size = F.count(F.lit(1)).over(Window.partitionBy("seat"))
            half = (2 * F.row_number().over(inside) > size).cast("long")
            dealt = state.withColumn("seat", F.col("seat") + half).repartition(ranges + 1, "seat").sortWithinPartitions("seat", "lo")
        state = _pooled(dealt).checkpoint()
        after, rounds = state.count(), rounds + 1
        if not _moves(state):
            break
        # halves move as long as that pools something; else the ranges are dealt anew, and wider
        if shifted and after == count:
            per *= 2
        shifted = after > count // 2 and (after < count or not shifted)
        count = after
    return IsotonicFit(state.select("lo", "hi", (F.col("pos") / F.col("n")).alias("fit")), rounds, rows_per_range or ROWS_PER_RANGE)


def values(model: IsotonicFit, scores: DataFrame) -> DataFrame:
    """(x, fit) for each distinct non-null ``x`` of ``scores``."""
    ends = model.blocks.select(F.explode(F.array(F.struct(F.col("lo").alias("x"), "fit"), F.struct(F.col("hi").alias("x"), "fit"))).alias("e"))
    ends = ends.select("e.x", "e.fit").distinct()
    asked = scores.select("x").filter("x IS NOT NULL").distinct().select("x", F.lit(None).cast("double").alias("fit"))
    line = ends.withColumn("asked", F.lit(False)).unionByName(asked.withColumn("asked", F.lit(True)))
    line = line.groupBy("x").agg(F.max("fit").alias("fit"), F.max("asked").alias("asked")).persist()
    try:
        ranges = max(1, -(-line.count() // model.rows_per_range))
        line = line.repartitionByRange(ranges, "x").withColumn("seat", F.spark_partition_id()).checkpoint()
    finally:
        line.unpersist()
    knot = F.when(F.col("fit").isNotNull(), F.struct("x", "fit"))
    # the knots before and after each range: a row a range
    edge = line.groupBy("seat").agg(F.min(knot).alias("first"), F.max(knot).alias("last"))
    whole = Window.orderBy("seat")
    edge = edge.select("seat", F.last("last", True).over(whole.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
                       F.first("first", True).over(whole.rowsBetween(1, Window.unboundedFollowing)).alias("after"))
    inside = Window.partitionBy("seat").orderBy("x")
    # from the other end: a frame that begins at the row and has no end is read anew for each row
    back = Window.partitionBy("seat").orderBy(F.col("x").desc())
    near = line.withColumn("l", F.last(knot, True).over(inside.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "r", F.last(knot, True).over(back.rowsBetween(Window.unboundedPreceding, 0))).filter("asked").join(edge, "seat")
    left, right = F.coalesce("l", "before"), F.coalesce("r", "after")
    share = (F.col("x") - left["x"]) / (right["x"] - left["x"])
    fit_ = F.when(left.isNull(), right["fit"]).when(right.isNull() | (left["x"] == right["x"]), left["fit"]).otherwise(
        left["fit"] + share * (right["fit"] - left["fit"]))
    return near.select("x", fit_.alias("fit"))


def apply(model: IsotonicFit, df: DataFrame, score: str, out: str) -> DataFrame:
    """``df`` with the fitted value of a score column."""
    x = F.col(score).cast("double")
    found = values(model, df.select(x.alias("x"))).select(F.col("x").alias("_iso_x"), F.col("fit").alias(out))
    return df.join(found, x == F.col("_iso_x"), "left").drop("_iso_x")
