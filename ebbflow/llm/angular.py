"""Hard negatives by angular triangle filtering.

Every row keeps its angles to a few reference directions.  For an anchor and a row the triangle
inequality on the sphere bounds their angle by |x - y| and min(x + y, 2 pi - x - y) for the angles
x, y to any reference; the tightest bounds over all references give an interval of the cosine, and
with the norms an interval of the score, widened against rounding.  Only where that interval meets
what an anchor still looks for are integer scores computed:

1. positives: scores that reach the anchor's worst best row of its label;
2. negatives: for each positive the window from ``low`` to ``high`` percent of its score, whose
   lower end rises to the worst of the best rows found in it.

Bounds are taken first for runs of rows (ranges of their angles), then for rows.  Rows are sorted
by their nearest reference, so that runs are narrow where the vectors are clustered.

The stated anchors are dealt into groups of a bounded size and the rows into parts; a task reads
the anchors of a group and then the part's rows in a stream, so neither a label nor a source is
ever one task.  The references are chosen from a bounded sample of ``sample`` rows (least hashes),
farthest first; they decide what is skipped, never the result.

Defined results: rows without vec_id or label, null vectors and vectors that hold null or
non-finite components take no part; an anchor meets rows of its own length and of another vec_id
only; repeated anchor rows count once, repeated other rows each count; ties go to the smaller
vec_id; an anchor without positives gives nothing; other columns are ignored; an empty table
gives an empty result.  Scores are exact while a hundredfold score fits a long.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbflow.llm.common import shuffle_parts, stored


@dataclass(frozen=True)
class MiningRules:
    positives: int = 5
    negatives: int = 10
    low: int = 30               # percent of the positive's score
    high: int = 90
    references: int = 8
    sample: int = 4096          # rows that the references are chosen from
    anchor_group: int = 4096    # anchors of a task (about)
    part_rows: int = 1 << 20    # most rows of a part (about)
    least_rows: int = 4096      # no more parts than that many rows need
    run: int = 256              # rows and anchors bounded together


def taking_part(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v): the rows that take part, with floor(256 x)."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(False))
    return vectors.filter(ok).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                                     F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("v"))


def _units(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows (zero rows stay zero) and norms."""
    x = v.astype(np.float64)
    norm = np.sqrt((x * x).sum(axis=1))
    return x / np.where(norm > 0, norm, 1.0)[:, None], norm


def references(rows: DataFrame, rules: MiningRules) -> dict[int, np.ndarray]:
    """Reference directions for each vector length met in the sample: farthest first."""
    by_dim: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("vec_id", "v")).limit(rules.sample).select("v").collect():
        by_dim.setdefault(len(r.v), []).append(r.v)
    out = {}
    for dim, own in by_dim.items():
        u, norm = _units(np.array(own, np.int64).reshape(len(own), dim))
        u = u[norm > 0]
        if not len(u):
            continue
        picked = [int((u @ u.mean(axis=0)).argmax())]
        nearest = u @ u[picked[0]]
        while len(picked) < min(rules.references, len(u)):
            picked.append(int(np.abs(nearest).argmin()))
            nearest = np.where(np.abs(u @ u[picked[-1]]) > np.abs(nearest), u @ u[picked[-1]], nearest)
        out[dim] = u[picked]
    return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def with_angles(rows: DataFrame, refs: dict[int, np.ndarray], rules: MiningRules) -> DataFrame:
    """rows (.., v) with dim, norm, near (nearest reference) and angles."""
    names = [c for c in rows.columns if c != "v"]

    def run(batches):
        for batch in batches:
            size = np.diff(batch.column("v").offsets.to_numpy())
            for dim in np.unique(size):
                own = batch.filter(pa.array(size == dim))
                u, norm = _units(_matrix(own.column("v"), int(dim)))
                known = refs.get(int(dim), np.zeros((0, int(dim))))
                angle = np.full((len(u), rules.references), np.pi / 2)     # a zero vector or reference bounds nothing
                angle[:, :len(known)] = np.arccos(np.clip(u @ known.T, -1, 1))
                off = pa.array(np.arange(0, angle.size + 1, rules.references, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*(own.column(c) for c in names), own.column("v"), pa.array(np.full(len(u), dim, np.int32)), pa.array(norm),
                     pa.array(angle.argmin(axis=1).astype(np.int32)), pa.array(angle.min(axis=1)), pa.ListArray.from_arrays(off, pa.array(angle.ravel()))],
                    [*names, "v", "dim", "norm", "near", "least", "angles"])

    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes if c != "v")
    return rows.mapInArrow(run, f"{kinds}, v array<long>, dim int, norm double, near int, least double, angles array<double>")


SLACK = 1e-6    # of an angle: arccos loses half the digits at its ends


def cosines(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, known: int) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest cosine of anchors with angles ``x`` (n, refs) to rows whose angles lie in
    ``lo`` .. ``hi`` (m, refs)."""
    near, far = np.zeros((len(x), len(lo))), np.full((len(x), len(lo)), np.pi)
    for j in range(known):
        a, b = x[:, j, None] - hi[None, :, j], lo[None, :, j] - x[:, j, None]
        np.maximum(near, np.maximum(a, b), out=near)
        s, t = x[:, j, None] + lo[None, :, j], x[:, j, None] + hi[None, :, j]
        most = np.where(t <= np.pi, t, np.where(s >= np.pi, 2 * np.pi - s, np.pi))
        np.minimum(far, most, out=far)
    return np.cos(np.minimum(far + SLACK, np.pi)), np.cos(np.maximum(near - SLACK, 0))


def score_bounds(low: np.ndarray, high: np.ndarray, a: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores for cosines in low .. high, anchor norms ``a`` and row norms in least .. most, widened
    by more than the rounding of the norms, the cosines and the products."""
    small, large = a[:, None] * least[None, :], a[:, None] * most[None, :]
    slack = large * 1e-9 + 1
    return np.where(low < 0, low * large, low * small) - slack, np.where(high < 0, high * small, high * large) + slack


class Wanted:
    """What each anchor still looks for: ``k`` best rows in a window of scores, a row per window."""

    def __init__(self, owner: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int, n: int):
        self.hi, self.k = hi, k
        self.floor = lo.copy()                      # rises to the worst of k rows found
        self.rows: list[list[tuple[int, int]]] = [[] for _ in owner]
        self.off = np.searchsorted(owner, np.arange(n + 1)).tolist()    # owners ascend

    def windows(self, a: int) -> range:
        return range(self.off[a], self.off[a + 1])

    def meets(self, anchors: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Whether the intervals (anchors x rows) meet any window of their anchor."""
        out = np.zeros(lo.shape, bool)
        for i, a in enumerate(anchors):
            for w in self.windows(a):
                out[i] |= (hi[i] >= self.floor[w]) & (lo[i] <= self.hi[w])
        return out

    def offer(self, a: int, scores: np.ndarray, ids: np.ndarray) -> None:
        for w in self.windows(a):
            use = np.flatnonzero((scores >= self.floor[w]) & (scores <= self.hi[w]))
            if not len(use):
                continue
            if len(use) > self.k:                   # the k best with all ties of the last
                edge = np.partition(scores[use], len(use) - self.k)[len(use) - self.k]
                use = use[scores[use] >= edge]
            row = self.rows[w] + [(-int(s), int(i)) for s, i in zip(scores[use], ids[use])]
            row.sort()
            self.rows[w] = row[:self.k]
            if len(row) >= self.k:
                self.floor[w] = max(self.floor[w], -self.rows[w][-1][0])


def scan(anchors: dict, rows: dict, wanted: Wanted, same: bool, known: int, run: int) -> tuple[int, int]:
    """Offer to the anchors every row that may matter; (integer scores computed, pairs)."""
    scored = 0
    n, m = len(anchors["id"]), len(rows["id"])
    top = float(np.abs(anchors["v"]).max(initial=0)) * float(np.abs(rows["v"]).max(initial=0)) * max(1, rows["v"].shape[1])
    kind = np.float64 if top < 2 ** 53 else np.int64
    for at in range(0, m, run):
        part = {k: x[at:at + run] for k, x in rows.items()}
        lo, hi = part["angles"].min(axis=0)[None], part["angles"].max(axis=0)[None]
        low, high = cosines(anchors["angles"], lo, hi, known)
        low, high = score_bounds(low, high, anchors["norm"], part["norm"].min()[None], part["norm"].max()[None])
        every = np.flatnonzero(wanted.meets(np.arange(n), low, high)[:, 0])
        for k in range(0, len(every), run):
            use = every[k:k + run]
            low, high = cosines(anchors["angles"][use], part["angles"], part["angles"], known)
            low, high = score_bounds(low, high, anchors["norm"][use], part["norm"], part["norm"])
            mask = (anchors["label"][use, None] == part["label"][None, :]) == same
            mask &= anchors["id"][use, None] != part["id"][None, :]
            mask &= wanted.meets(use, low, high)
            cols = np.flatnonzero(mask.any(axis=0))
            lines = np.flatnonzero(mask.any(axis=1))
            if not len(cols):
                continue
            score = anchors["v"][use[lines]].astype(kind) @ part["v"][cols].astype(kind).T
            mask = mask[np.ix_(lines, cols)]
            scored += int(mask.sum())
            for i, line in enumerate(lines):
                own = np.flatnonzero(mask[i])
                wanted.offer(int(use[line]), score[i, own].astype(np.int64), part["id"][cols[own]])
    return scored, n * m


def _columns(batch: pa.RecordBatch, dim: int, refs: int) -> dict:
    return {"id": batch.column("vec_id").to_numpy(), "label": batch.column("label").to_numpy(), "norm": batch.column("norm").to_numpy(),
            "v": _matrix(batch.column("v"), dim), "angles": _matrix(batch.column("angles"), refs), "aid": batch.column("aid").to_numpy(zero_copy_only=False)}


FOUND = "aid long, anchor_id long, slot int, vec_id long, score long"
FOUND_COLUMNS = ["aid", "anchor_id", "slot", "vec_id", "score"]


def _search(anchors: DataFrame, rows: DataFrame, refs: dict, same: bool, k: int, n_groups: int, n_parts: int, rules: MiningRules) -> DataFrame:
    """The k best rows of each window of each anchor, by part."""
    known = {dim: len(r) for dim, r in refs.items()}
    columns = ["vec_id", "label", "v", "norm", "angles", "dim", "aid", "lo", "hi", "near", "least"]
    none = F.lit(None).cast("array<long>")
    left = anchors.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1)))).select("group", "part", F.lit(0).alias("kind"), *columns)
    right = rows.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1)))).select(
        "group", F.pmod(F.xxhash64("row"), F.lit(n_parts)).cast("int").alias("part"),
        F.lit(1).alias("kind"), *columns[:6], F.lit(0).cast("long").alias("aid"), none.alias("lo"), none.alias("hi"), "near", "least")
    dealt = left.unionByName(right).repartition(n_groups * n_parts, "group", "part").sortWithinPartitions("group", "part", "dim", "kind", "near", "least", "vec_id")

    def run(batches):
        here, held, state = None, [], None

        def done():
            own, wanted = state
            lines = [(own["aid"][a], own["id"][a], slot, i, -s) for a in range(len(own["id"]))
                     for slot, w in enumerate(wanted.windows(a)) for s, i in wanted.rows[w]]
            if lines:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*lines), kinds)], FOUND_COLUMNS)

        for batch in batches:
            marks = np.stack([batch.column(c).to_numpy() for c in ("group", "part", "dim", "kind")])
            cuts = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                if a == b:
                    continue
                own, (group, part, dim, kind) = batch.slice(a, b - a), marks[:, a].tolist()
                if (group, part, dim) != here:
                    if state:
                        yield from done()
                    here, held, state = (group, part, dim), [], None
                if kind == 0:
                    held.append(own)
                    continue
                if not held:
                    continue                # rows of a length no anchor has
                if state is None:
                    table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    lists = table.column("lo")
                    owner = np.repeat(np.arange(len(table)), np.diff(lists.offsets.to_numpy()))
                    wanted = Wanted(owner, lists.flatten().to_numpy(), table.column("hi").flatten().to_numpy(), k, len(table))
                    state = _columns(table, dim, rules.references), wanted
                scan(state[0], _columns(own, dim, rules.references), state[1], same, known.get(dim, 0), rules.run)
        if state:
            yield from done()

    return dealt.mapInArrow(run, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("aid", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, anchors: DataFrame, rules: MiningRules = MiningRules()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the anchor rows
    ``anchors``, against all rows of ``vectors``."""
    spark = vectors.sparkSession
    rows = taking_part(vectors)
    refs = references(rows, rules)
    rows = stored(with_angles(rows, refs, rules).withColumn("row", F.monotonically_increasing_id()), "angles")
    asked = taking_part(anchors).distinct().withColumn("aid", F.monotonically_increasing_id())
    asked = stored(with_angles(asked, refs, rules), "anchors")
    n_groups = max(1, math.ceil(asked.count() / rules.anchor_group))
    n_rows = rows.count()
    n_parts = min(math.ceil(2 * shuffle_parts(spark) / n_groups), math.ceil(n_rows / rules.least_rows))
    n_parts = max(n_parts, math.ceil(n_rows / rules.part_rows), 1)
    asked = asked.withColumn("group", F.pmod(F.xxhash64("aid"), F.lit(n_groups)).cast("int"))
    ends = F.lit(-(1 << 62)), F.lit(1 << 62)
    open_ = asked.withColumn("lo", F.array(ends[0])).withColumn("hi", F.array(ends[1]))
    found = stored(_search(open_, rows, refs, True, rules.positives, n_groups, n_parts, rules), "positives")
    positives = _best(found, rules.positives).groupBy("aid").agg(
        F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("positives"))
    positives = stored(positives, "anchor-positives")
    # in whole numbers: low % of the positive's score rounded up, high % rounded down
    lo = F.expr(f"transform(positives, p -> -((({-rules.low}) * p.score - pmod(({-rules.low}) * p.score, 100)) div 100))")
    hi = F.expr(f"transform(positives, p -> (({rules.high}) * p.score - pmod(({rules.high}) * p.score, 100)) div 100)")
    windows = asked.join(positives, "aid").withColumn("lo", lo).withColumn("hi", hi)
    negatives = _best(stored(_search(windows, rows, refs, False, rules.negatives, n_groups, n_parts, rules), "negatives"), rules.negatives)
    named = negatives.join(positives, "aid").withColumn("p", F.get("positives", F.col("slot")))
    return named.select("anchor_id", F.col("p.vec_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
                        F.col("vec_id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"))

