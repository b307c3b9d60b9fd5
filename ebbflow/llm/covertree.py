"""Exact top-k inner products by dual-tree search over cover trees.

Rows are indexed once, in blocks of at most ``block`` vectors, each with a cover tree
(centres are points, a level's covering radius is the parent's divided by ``base``).  The
stated queries are taken in chunks of a fixed size, also with cover trees, and every chunk
visits every block.  A pair of nodes is left out if no point of the data node can reach the
worst k-th score of the query group: <a, b> <= <ca, cb> + |ca| rb + |cb| ra + ra rb.  A task
keeps k candidates for a query, and a window over these partial lists picks the result.

Defined results: vectors that are null or hold a null or non-finite component, and rows
without vec_id, take no part; a query meets candidates of its own length only; repeated
candidate rows each count; repeated equal query rows count once; ties go to the smaller
vec_id; other columns are ignored; an empty table gives an empty result.  Scores are exact
while they fit a long.
"""

from __future__ import annotations

import math
import pickle
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbflow.llm.common import scratch_dir, stored


@dataclass(frozen=True)
class TreeRules:
    k: int = 5
    block: int = 2048         # vectors of an index block
    query_block: int = 1024   # queries of a query tree
    query_chunk: int = 8192   # queries at the driver and in a broadcast at once
    leaf: int = 96
    base: float = 1.3


class CoverTree:
    """Nodes in arrays: centre (row of the points), covering radius, first and last point of the
    reordered points, first and last child (0, 0: a leaf)."""

    def __init__(self, points: np.ndarray, rules: TreeRules):
        x = points.astype(np.float64)
        self.order = np.arange(len(x))
        centre, radius, first, last, child = [0], [0.0], [0], [len(x)], [(0, 0)]
        queue = [0]
        while queue:
            node = queue.pop()
            a, b = first[node], last[node]
            own = self.order[a:b]
            dist = np.sqrt(((x[own] - x[centre[node]]) ** 2).sum(axis=1))
            radius[node] = float(dist.max()) if len(own) else 0.0
            if b - a <= rules.leaf or radius[node] == 0:
                continue
            cover = radius[node] / rules.base
            groups, centres = [], []
            left = own
            away = dist
            pick = centre[node]              # the centre is its own child, then the farthest point left
            while len(left):
                d = np.sqrt(((x[left] - x[pick]) ** 2).sum(axis=1))
                near = d <= cover
                groups.append(left[near])
                centres.append(pick)
                away = np.minimum(away, d)[~near]
                left = left[~near]
                if len(left):
                    pick = int(left[int(away.argmax())])
            child[node] = (len(centre), len(centre) + len(groups))
            at = a
            for g, c in zip(groups, centres):
                self.order[at:at + len(g)] = g
                queue.append(len(centre))
                centre.append(c)
                radius.append(0.0)
                first.append(at)
                last.append(at + len(g))
                child.append((0, 0))
                at += len(g)
        self.centre, self.radius = np.array(centre), np.array(radius)
        self.first, self.last, self.child = first, last, child
        self.centres = x[self.centre]
        self.norm = np.sqrt((self.centres ** 2).sum(axis=1))


class Best:
    """The k best candidates so far of each query of a group."""

    def __init__(self, n: int, k: int):
        self.rows: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        self.worst = np.full(n, -np.inf)
        self.k = k

    def offer(self, q: int, scores, ids) -> None:
        row = self.rows[q] + [(-int(s), int(i)) for s, i in zip(scores, ids)]
        row.sort()
        self.rows[q] = row[:self.k]
        if len(row) >= self.k:
            self.worst[q] = -self.rows[q][-1][0]


def search(qt: CoverTree, qv: np.ndarray, qid: np.ndarray, dt: CoverTree, dv: np.ndarray, did: np.ndarray, best: Best) -> int:
    """Offer every candidate of the data tree that may matter to the queries of the query tree;
    the number of scores computed."""
    bound = (qt.centres @ dt.centres.T + qt.norm[:, None] * dt.radius[None, :] + qt.radius[:, None] * dt.norm[None, :]
             + qt.radius[:, None] * dt.radius[None, :])
    bound += np.abs(bound) * 1e-9 + 1e-3     # rounding of the bounds themselves
    # 64-bit integers where a score may not fit a double's 53 bits
    top = float(np.abs(qv).max(initial=0)) * float(np.abs(dv).max(initial=0)) * max(1, qv.shape[1])
    kind = np.float64 if top < 2 ** 53 else np.int64
    q, d = qv[qt.order].astype(kind), dv[dt.order].astype(kind)
    q_ids, d_ids = qid[qt.order], did[dt.order]
    stack, scored = [(0, 0)], 0
    while stack:
        a, b = stack.pop()
        group = qt.order[qt.first[a]:qt.last[a]]
        if bound[a, b] < best.worst[group].min():
            continue
        (qa, qb), (da, db) = qt.child[a], dt.child[b]
        if qa == qb and da == db:
            lo, hi = dt.first[b], dt.last[b]
            score = q[qt.first[a]:qt.last[a]] @ d[lo:hi].T
            scored += score.size
            own = q_ids[qt.first[a]:qt.last[a], None] == d_ids[None, lo:hi]
            good = (score >= best.worst[group][:, None]) & ~own
            for r in np.flatnonzero(good.any(axis=1)):
                use = np.flatnonzero(good[r])
                best.offer(int(group[r]), score[r, use], d_ids[lo + use])
        elif da == db or (qa != qb and qt.radius[a] >= dt.radius[b]):
            stack += [(c, b) for c in range(qa, qb)]
        else:                                # the most promising child is looked at first
            stack += [(a, da + int(c)) for c in np.argsort(bound[a, da:db], kind="stable")]
    return scored


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): floor(256 x) of the vectors that take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad
    return vectors.filter(ok).select(
        F.col("vec_id").cast("long"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("v"))


def _matrices(batch: pa.RecordBatch):
    """(ids, matrix) for each vector length in the batch."""
    ids, col = batch.column("vec_id").to_numpy(), batch.column("v")
    off = col.offsets.to_numpy().astype(np.int64)
    flat = col.values.to_numpy(zero_copy_only=False)
    size = np.diff(off)
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        yield ids[rows], flat[(off[rows][:, None] + np.arange(n)[None, :])].astype(np.int64).reshape(len(rows), n)


def index(vectors: DataFrame, rules: TreeRules = TreeRules()) -> DataFrame:
    """(dim, block): pickled (tree, vectors, ids) of at most ``rules.block`` rows; every row is in one."""

    def run(batches):
        held: dict[int, list] = {}

        def block(parts):
            ids, v = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            raw = pickle.dumps((CoverTree(v, rules), v, ids), protocol=5)
            return pa.RecordBatch.from_arrays([pa.array([v.shape[1]], pa.int32()), pa.array([raw], pa.binary())], ["dim", "block"])

        for batch in batches:
            for ids, v in _matrices(batch):
                for k in range(0, len(ids), rules.block):
                    parts = held.setdefault(v.shape[1], [])
                    room = rules.block - sum(len(p[0]) for p in parts)
                    take = slice(k, k + rules.block)
                    parts.append((ids[take][:room], v[take][:room]))
                    if sum(len(p[0]) for p in parts) == rules.block:
                        yield block(parts)
                        held[v.shape[1]] = [(ids[take][room:], v[take][room:])]
        for parts in held.values():
            if sum(len(p[0]) for p in parts):
                yield block(parts)

    return quantised(vectors).mapInArrow(run, "dim int, block binary")


PARTIAL = "chunk int, q int, query_id long, vec_id long, score long"


def top_k(vectors: DataFrame, queries: DataFrame, rules: TreeRules = TreeRules()) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of each query row."""
    spark = vectors.sparkSession
    blocks = stored(index(vectors, rules), "vector-index")
    asked = stored(quantised(queries).distinct(), "vector-queries")
    n_chunks = max(1, math.ceil(asked.count() / rules.query_chunk))
    path = f"{scratch_dir(spark).rstrip('/')}/llm/top-k-{uuid.uuid4().hex}"
    for chunk in range(n_chunks):
        rows = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(n_chunks)) == chunk).collect()  # about query_chunk
        by_dim: dict[int, list] = {}
        for r in rows:
            by_dim.setdefault(len(r.v), []).append((r.vec_id, r.v))
        trees, at = {}, 0
        for dim, own in by_dim.items():
            for k in range(0, len(own), rules.query_block):
                part = own[k:k + rules.query_block]
                v = np.array([x[1] for x in part], np.int64).reshape(len(part), dim)
                trees.setdefault(dim, []).append((CoverTree(v, rules), v, np.array([x[0] for x in part], np.int64), at))
                at += len(part)
        shared = spark.sparkContext.broadcast(trees)

        def run(batches, chunk=chunk, shared=shared):
            best: dict[int, Best] = {}
            for batch in batches:
                for dim, raw in zip(batch.column("dim").to_pylist(), batch.column("block")):
                    tree, v, ids = pickle.loads(raw.as_buffer())
                    for qt, qv, qid, base in shared.value.get(dim, ()):
                        search(qt, qv, qid, tree, v, ids, best.setdefault(base, Best(len(qid), rules.k)))
            out = []
            for own in shared.value.values():
                for _, _, qid, base in own:
                    for q, row in enumerate(best[base].rows if base in best else ()):
                        out += [(chunk, base + q, int(qid[q]), i, -s) for s, i in row]
            if out:
                c = list(zip(*out))
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, kinds)], ["chunk", "q", "query_id", "vec_id", "score"])

        blocks.mapInArrow(run, PARTIAL).write.mode("append").parquet(path)
    partial = spark.read.schema(PARTIAL).parquet(path)
    order = Window.partitionBy("chunk", "q").orderBy(F.desc("score"), "vec_id")
    ranked = partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= rules.k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
