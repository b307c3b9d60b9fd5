"""Boosted trees on a binned matrix, many models at a time (H8, H9).

The training frame is binned once (edges at exact quantiles, at most ``BINS`` bins a slot) and kept as blocks:
one row holds the bin codes of up to ``BLOCK_ROWS`` customers, their labels and the margins of every model.
All models grow in step.  A pass is one Spark job: each block routes its rows down the trees grown so far and
adds up gradients by (model, open node, slot, bin); the sums of a node meet in one group of the shuffle, which
finds its best cut.  Only the cuts reach the driver (a row for each open node), so neither the passes nor the
driver grow with the rows, and a further model costs no further pass.

Trees grow best first: the open node with the largest gain is cut next, until ``leaves`` is reached.  Nodes that
can still be among the cuts left are measured ahead, so a tree takes about as many passes as it is deep; what was
measured and not reached is thrown away, so the tree is that of one cut at a time.  Without a limit of leaves
this is growth by level.

Up to ``TASK_ROWS`` rows a pass costs little more than starting its job, so there the trees of a model are grown in
one task over all its blocks, in one job for all models (:func:`grow_here`).  The trees are the same.

Gradients are whole multiples of 2**-20, so sums are exact: the trees do not depend on partitions, order or lost
executors.  Every sibling of a pass is summed from its rows; in a task the larger is the exact difference.

Null features are imputed before (:class:`ebbflow.operators.ml.Preprocessor`).  A table without rows or with one
class gives trees of a single leaf.  Rows with a null label are left out of the fit.  Equal gains go to the
smaller slot, then the smaller bin; between nodes to the one nearer the root, then further left.
"""

from __future__ import annotations

import math
import random
import time
from collections.abc import Iterator
from dataclasses import dataclass, field, fields, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbflow import config as C
from ebbflow.functions.ranged import running_sums
from ebbflow.operators.forest import numeric_edges

BINS = 32
BLOCK_ROWS = 16_384
UNIT = float(1 << 20)  # gradients are rounded to 1 / UNIT
MIN_GAIN = 1e-9
TASK_ROWS = 131_072  # rows of a task in a pass
COUNT_BIT = 38
KEPT_TREES = 16  # trees a block walks again in each pass before its margins are written anew

BLOCK_SCHEMA = "n int, first int, models int, codes binary, label binary, mark binary, margins binary"
SUM_SCHEMA = "model int, node int, sums binary"
CUT_SCHEMA = "model int, node int, gain double, slot int, bin int, g long, h long, lg long, lh long"


@dataclass(frozen=True)
class BoostRules:
    """One model.  ``min_hess`` is a least sum of second derivatives in a child, ``min_rows`` a least number of
    rows; ``subsample`` and ``colsample`` are drawn anew for each tree; ``exclude`` names source features.
    ``residual`` is the rule of MLlib's GBTClassifier: trees are fitted to the residuals of its log loss (margins count
    twice), a leaf is their weighted mean, the first tree is fitted to the labels -1 and 1 and counts whole."""

    trees: int = 100
    lr: float = 0.1
    depth: int = 6
    leaves: int | None = None
    min_hess: float = 1.0
    min_rows: int = 1
    subsample: float = 1.0
    colsample: float = 1.0
    l2: float = 1.0
    exclude: tuple = ()
    seed: int = C.SEED
    residual: bool = False

    def of_tree(self, tree: int) -> "BoostRules":
        return replace(self, lr=1.0) if self.residual and tree == 0 else self


@dataclass
class Node:
    """A node by its heap number (root 1, children 2k and 2k + 1) with its sums in units."""

    key: int
    g: int = 0
    h: int = 0
    cut: tuple | None = None  # (gain, slot, bin, lg, lh) once measured; gain 0: no cut
    grown: bool = False  # its children exist


@dataclass
class Growth:
    """A tree while it grows."""

    rules: BoostRules
    nodes: dict = field(default_factory=lambda: {1: Node(1)})

    def _final(self, node: Node) -> bool:
        """Whether the node cannot be cut, whatever its rows are."""
        return node.key.bit_length() > self.rules.depth or (node.key > 1 and node.h < 2 * self.rules.min_hess * UNIT)

    def _grow(self, node: Node) -> list[Node]:
        if not node.grown:
            _, _, _, lg, lh = node.cut
            self.nodes[2 * node.key] = Node(2 * node.key, lg, lh)
            self.nodes[2 * node.key + 1] = Node(2 * node.key + 1, node.g - lg, node.h - lh)
            node.grown = True
        return [self.nodes[2 * node.key], self.nodes[2 * node.key + 1]]

    def walk(self) -> tuple[list[int], list[int]]:
        """Cuts in best-first order as far as they are known, and the nodes to measure next (none: done).
        Nodes not yet measured are passed over as if they had no gain: what they gain can only take cuts away
        from the known nodes, so no node is reached later that was not reached here."""
        left = (self.rules.leaves or 1 << self.rules.depth) - 1
        edge, cuts, asked = [self.nodes[1]], [], []
        while left > 0:
            asked += [n.key for n in edge if n.cut is None and not self._final(n)]
            edge = [n for n in edge if n.cut and n.cut[0] > 0]
            if not edge:
                break
            best = min(edge, key=lambda n: (-n.cut[0], n.key))
            edge.remove(best)
            edge += self._grow(best)
            cuts.append(best.key)
            left -= 1
        return cuts, asked

    def routes(self, keys=None) -> dict:
        """node -> (slot, bin) of the nodes that send their rows on."""
        return {k: n.cut[1:3] for k, n in self.nodes.items() if n.grown and (keys is None or k in keys)}

    def finished(self, cuts: list[int]) -> "Tree":
        ends = {1} | {c for k in cuts for c in (2 * k, 2 * k + 1)}
        r = self.rules
        return Tree(self.routes(set(cuts)), {k: leaf_value(self.nodes[k], r) for k in ends - set(cuts)})


@dataclass(frozen=True)
class Tree:
    routes: dict  # node -> (slot, bin): codes up to the bin go left
    values: dict  # leaf -> margin

    def packed(self) -> "PackedTree":
        size = max([*self.routes, *self.values], default=1) + 1
        slot, cut, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.zeros(size)
        for k, (s, b) in self.routes.items():
            slot[k], cut[k] = s, b
        for k, v in self.values.items():
            value[k] = v
        return PackedTree(slot, cut, value)


@dataclass(frozen=True)
class PackedTree:
    """A tree as arrays over heap numbers, as it is sent to tasks (cut -1: rows stay)."""

    slot: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def margins(self, codes: np.ndarray) -> np.ndarray:
        return self.value[walk_down(codes, self.slot, self.cut)]


def leaf_value(node: Node, r: BoostRules) -> float:
    den = node.h / UNIT + r.l2
    return -r.lr * (node.g / UNIT) / den if den > 0 else 0.0


def route(codes: np.ndarray, routes: dict) -> np.ndarray:
    """The node at which each row (a column of ``codes``) ends."""
    p = Tree(routes, {}).packed()
    return walk_down(codes, p.slot, p.cut)


def walk_down(codes: np.ndarray, slot: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The node at which each row ends, all rows a level at a time; at an end no code is above the cut."""
    inner, n = np.flatnonzero(cut >= 0), codes.shape[1]
    at = np.ones(n, np.int64)
    if not inner.size or not n:
        return at
    size = 2 * int(inner[-1]) + 2
    down, above, base = np.arange(size), np.full(size, 255, np.int16), np.zeros(size, np.int64)
    down[inner], above[inner], base[inner] = 2 * inner, cut[inner], slot[inner].astype(np.int64) * n
    rows, flat = np.arange(n), codes.reshape(-1)
    for _ in range(int(inner[-1]).bit_length()):
        at = down.take(at) + (flat.take(base.take(at) + rows) > above.take(at))
    return at


def drawn_slots(r: BoostRules, allowed: np.ndarray, tree: int) -> np.ndarray:
    """The slots a tree may cut."""
    if r.colsample >= 1:
        return allowed
    rng = np.random.default_rng([r.seed, tree])
    take = max(1, int(round(r.colsample * allowed.size)))
    return np.sort(rng.choice(allowed, take, replace=False))


def drawn_rows(r: BoostRules, mark: np.ndarray, tree: int) -> np.ndarray:
    """Which rows are in a tree's sample, by a hash of the row's mark."""
    seed = (r.seed * 1_000_003 + tree + 1) * 0x9E3779B97F4A7C15 % (1 << 64)
    x = mark + np.uint64(seed)
    for shift, mul in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(mul)
    x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)) * 2.0 ** -53 < r.subsample


def gradients(margin: np.ndarray, label: np.ndarray, pos_weight: float, r: BoostRules, tree: int) -> tuple[np.ndarray, np.ndarray]:
    """Logistic first and second derivatives in whole units (as floats: exact below 2**53); of ``residual`` rules the
    negative residuals and the weights."""
    w = np.where(label > 0, pos_weight, 1.0)
    if r.residual:
        sign = np.where(label > 0, 1.0, -1.0)
        rest = 4.0 * sign / (1.0 + np.exp(2.0 * sign * margin)) if tree else sign
        return np.rint(-w * rest * UNIT), np.rint(w * UNIT)
    p = 1.0 / (1.0 + np.exp(-margin))
    return np.rint(w * (p - label) * UNIT), np.rint(w * p * (1 - p) * UNIT)


def best_cut(sums: np.ndarray, starts: np.ndarray, slots: np.ndarray, r: BoostRules):
    """Best cut of one node from its (3, bins) sums of gradient, second derivative and rows.  ``starts`` are the
    first bins of the slots.  Returns (gain, slot, bin, g, h, lg, lh)."""
    first = int(slots[0])
    g, h, n = (int(v) for v in sums[:, starts[first]:starts[first + 1]].sum(axis=1))
    ends = starts[1:] - 1  # nothing lies right of a slot's last bin
    can = np.zeros(sums.shape[1], bool)
    for s in slots:
        can[starts[s]:ends[s]] = True
    before = np.concatenate([np.zeros((3, 1), np.int64), np.cumsum(sums, axis=1)], axis=1)
    lg, lh, ln = before[:, 1:] - np.repeat(before[:, starts[:-1]], np.diff(starts), axis=1)
    ok = (can & (lh >= r.min_hess * UNIT) & (h - lh >= r.min_hess * UNIT) & (ln >= max(1, r.min_rows))
          & (n - ln >= max(1, r.min_rows)))
    gain = np.where(ok, _score(lg, lh, r.l2) + _score(g - lg, h - lh, r.l2) - _score(g, h, r.l2), 0.0)
    at = int(gain.argmax())
    if gain[at] <= MIN_GAIN:
        return 0.0, 0, 0, g, h, 0, 0
    s = int(np.searchsorted(starts, at, "right")) - 1
    return float(gain[at]), s, at - int(starts[s]), g, h, int(lg[at]), int(lh[at])


def _score(g, h, l2):
    return (np.asarray(g) / UNIT) ** 2 / np.maximum(np.asarray(h) / UNIT + l2, 1e-12)


def slot_edges(encoded: DataFrame, bins: int = BINS) -> list[np.ndarray]:
    """Edges of each vector slot at the exact quantiles of its values; at most ``bins`` rows a slot come back."""
    long = encoded.select(F.posexplode(vector_to_array("features")).alias("_s", "_v"))
    cum = running_sums(long.groupBy("_s", "_v").agg(F.count(F.lit(1)).alias("_n")), ["_s"], [F.col("_v")], ["_n"])
    part = F.ceil(F.col("cum__n") * bins / F.col("all__n"))
    rows = cum.groupBy("_s", part.alias("_p")).agg(F.max("_v").alias("e")).select("_s", "e").collect()
    out: dict = {}
    for r in rows:
        out.setdefault(r["_s"], []).append(r["e"])
    return [np.unique(out.get(s, []))[:-1] for s in range(max(out, default=-1) + 1)]


def to_codes(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """(rows, slots) values -> (slots, rows) codes: the number of edges below a value."""
    return np.stack([np.searchsorted(e, values[:, s], "left") for s, e in enumerate(edges)]).astype(np.uint8)


def block_partitions(spark, n_rows: int, n_slots: int) -> int:
    """Partitions of the blocks: a code is a byte, so a pass over ``TASK_ROWS`` rows costs about what starting its
    job does, and up to there one task grows a model's trees without one.  More rows go to every core in equal waves."""
    from ebbflow.operators import ml as ML
    cores = max(1, spark.sparkContext.defaultParallelism)
    if spark.conf.get("ebbflow.ml.partitionBytes", None):
        return ML.training_partitions(spark, n_rows, n_slots)
    return 1 if n_rows <= TASK_ROWS else -(-n_rows // (TASK_ROWS * cores)) * cores


class _Blocks:
    """The binned training rows as a DataFrame of blocks, each with the margins of a run of models.  A frame of
    few partitions is dealt out by runs of models as well (``groups`` copies of the codes), so that all cores work."""

    def __init__(self, encoded: DataFrame, edges, n_models: int, parts: int):
        rows = encoded.where(F.col("label").isNotNull()).select(
            vector_to_array("features").alias("v"), F.col("label").cast("double").alias("y"), F.col("mark"))
        self.cores = encoded.sparkSession.sparkContext.defaultParallelism
        groups = max(1, min(n_models, self.cores // parts))
        runs = [(int(x[0]), len(x)) for x in np.array_split(np.arange(n_models), groups)]

        def pack(batches):
            for b in batches:
                for at in range(0, b.num_rows, BLOCK_ROWS):
                    t = b.slice(at, BLOCK_ROWS)
                    n = t.num_rows
                    v = t.column("v").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
                    same = dict(n=n, codes=to_codes(v, edges).tobytes(),
                                label=t.column("y").to_numpy(zero_copy_only=False).astype(np.float64).tobytes(),
                                mark=t.column("mark").to_numpy(zero_copy_only=False).astype(np.int64).tobytes())
                    for first, k in runs:
                        yield pa.RecordBatch.from_pylist([dict(same, first=first, models=k, margins=bytes(8 * n * k))],
                                                         schema=BLOCK_ARROW)
        packed = rows.repartition(parts).mapInArrow(pack, BLOCK_SCHEMA)
        self.single = parts == 1  # all rows of a model are in one partition
        if groups > 1:
            packed = packed.repartitionByRange(groups, "first") if self.single else packed.repartition(parts * groups)
        self.frame = packed.persist(StorageLevel.MEMORY_AND_DISK)
        self.n_slots = len(edges)

    def advance(self, pending: list[list[PackedTree]]) -> None:
        """Adds trees to the margins and cuts the lineage in the shared folder."""
        n_slots = self.n_slots

        def add(batches):
            for b in batches:
                for r in b.to_pylist():
                    codes, m = _codes(r, n_slots), _margins(r)
                    for k in range(r["models"]):
                        for t in pending[r["first"] + k]:
                            m[k] += t.margins(codes)
                    yield pa.RecordBatch.from_pylist([dict(r, margins=m.tobytes())], schema=BLOCK_ARROW)
        old = self.frame
        self.frame = old.mapInArrow(add, BLOCK_SCHEMA).checkpoint(eager=True).persist(StorageLevel.MEMORY_AND_DISK)
        old.unpersist()


def _codes(r, n_slots):
    return np.frombuffer(r["codes"], np.uint8).reshape(n_slots, r["n"])


def _margins(r):
    return np.frombuffer(r["margins"], np.float64).reshape(r["models"], r["n"]).copy()


def one_hot_sets(names: list[tuple[str, str]], edges) -> list[list[int]]:
    """Slots counted together: the dummies of one source feature, of which a row has one at most (two bins each;
    a dummy without an edge never varies).  Every other slot is alone."""
    sets: dict = {}
    for s, (name, source) in enumerate(names):
        sets.setdefault(source if name.startswith("cat__") and len(edges[s]) == 1 else (s,), []).append(s)
    return list(sets.values())


def _add_sums(got, codes, here, g, h, sets, starts) -> None:
    """Adds a block's rows to the (node, 3, bin) sums, one set of slots at a time; ``here`` is the place of a row's
    node.  The first bin of a dummy is what its others leave of the node's whole: sums are whole numbers, so the
    difference is exact.  Second derivatives and rows are counted in one number where both fit into its 53 bits."""
    whole, n_nodes = None, len(got)
    packed = len(h) < 1 << 53 - COUNT_BIT and h.sum() < 1 << COUNT_BIT
    hn = h + float(1 << COUNT_BIT) if packed else h
    for slots in sets:
        if len(slots) == 1:
            code, wide = codes[slots[0]], int(starts[slots[0] + 1] - starts[slots[0]])
        else:
            code, wide = np.zeros(codes.shape[1], np.int16), len(slots) + 1
            for i, s in enumerate(slots, 1):
                code += codes[s] * np.int16(i)
        cell, size = here * wide + code, n_nodes * wide
        sums = [np.bincount(cell, v, size).astype(np.int64).reshape(-1, wide) for v in (g, hn)]
        if packed:
            sums[1:] = [sums[1] & (1 << COUNT_BIT) - 1, sums[1] >> COUNT_BIT]
        else:
            sums.append(np.bincount(cell, minlength=size).reshape(-1, wide))
        if len(slots) == 1:
            to = slice(int(starts[slots[0]]), int(starts[slots[0] + 1]))
            for k in range(3):
                got[:, k, to] += sums[k]
            continue
        if whole is None:
            whole = [v.sum(axis=1) for v in sums]
        at = starts[np.array(slots)]
        for k in range(3):
            got[:, k, at] += whole[k][:, None] - sums[k][:, 1:]
            got[:, k, at + 1] += sums[k][:, 1:]


def _measure(blocks: _Blocks, asks: dict, pending, starts: np.ndarray, pos_weight: float, one_hot: list) -> list:
    """One pass.  ``asks``: model -> (rules, tree number, slots, routes, open nodes)."""
    sets = {m: [k for k in ([s for s in one if s in drawn] for one in one_hot) if k]
            for m, drawn in ((m, set(a[2].tolist())) for m, a in asks.items())}
    n_slots, total = blocks.n_slots, int(starts[-1])

    def sums(batches):
        acc = {}
        for b in batches:
            for r in b.to_pylist():
                codes, margins = _codes(r, n_slots), _margins(r)
                label, mark = np.frombuffer(r["label"]), np.frombuffer(r["mark"], np.uint64)
                for m in range(r["first"], r["first"] + r["models"]):
                    if m not in asks:
                        continue
                    rules, tree, _, routes, nodes = asks[m]
                    margin = margins[m - r["first"]]
                    for t in pending[m]:
                        margin += t.margins(codes)
                    g, h = gradients(margin, label, pos_weight, rules, tree)
                    at = route(codes, routes)
                    place = np.full(max(int(at.max(initial=1)), max(nodes)) + 1, -1, np.int64)
                    place[nodes] = np.arange(len(nodes))
                    here = place[at]
                    on = here >= 0
                    if rules.subsample < 1:
                        on &= drawn_rows(rules, mark, tree)
                    some = np.count_nonzero(on)
                    if not some:
                        continue
                    # a last place takes the rows that do not count; where they are many they are left out
                    got = acc.setdefault(m, np.zeros((len(nodes) + 1, 3, total), np.int64))
                    if 3 * some > on.size:
                        _add_sums(got, codes, np.where(on, here, len(nodes)), g, h, sets[m], starts)
                    else:
                        on = np.flatnonzero(on)
                        _add_sums(got, codes[:, on], here[on], g[on], h[on], sets[m], starts)
        for m, got in acc.items():
            nodes = asks[m][4]
            yield pa.RecordBatch.from_arrays(
                [pa.array([m] * len(nodes), pa.int32()), pa.array(nodes, pa.int32()),
                 pa.array([got[i].tobytes() for i in range(len(nodes))], pa.binary())], ["model", "node", "sums"])

    def cuts(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, node = (k.as_py() for k in key)
        whole = np.zeros((3, total), np.int64)
        for b in batches:
            for part in b.column("sums"):
                whole += np.frombuffer(part.as_buffer(), np.int64).reshape(3, total)
        rules, _, slots, _, _ = asks[m]
        gain, s, at, g, h, lg, lh = best_cut(whole, starts, slots, rules)
        yield pa.RecordBatch.from_pylist([dict(model=m, node=node, gain=gain, slot=s, bin=at, g=g, h=h, lg=lg, lh=lh)],
                                         schema=CUT_ARROW)

    wide = min(blocks.cores, sum(len(a[4]) for a in asks.values()))
    return (blocks.frame.mapInArrow(sums, SUM_SCHEMA).repartition(wide, "model", "node").groupBy("model", "node")
            .applyInArrow(cuts, CUT_SCHEMA).collect())


def merged_codes(codes: np.ndarray, one_hot: list) -> np.ndarray:
    """A row of codes for each set of slots counted together: the slot's own, or the place of the dummy that is set
    (from one; zero: none)."""
    out = np.zeros((len(one_hot), codes.shape[1]), np.uint8 if max(map(len, one_hot)) < 256 else np.uint16)
    for k, slots in enumerate(one_hot):
        if len(slots) == 1:
            out[k] = codes[slots[0]]
        else:
            for i, s in enumerate(slots, 1):
                out[k] += codes[s].astype(out.dtype) * out.dtype.type(i)
    return out


def _node_sums(merged, rows, g, h, sets, starts) -> np.ndarray:
    """(3, bins) sums of one node's rows over the sets ``(place, slots)`` (see :func:`_add_sums`)."""
    got, own_g, own_h = np.zeros((3, int(starts[-1])), np.int64), g[rows], h[rows]
    whole = np.array([own_g.sum(), own_h.sum(), rows.size], np.float64).astype(np.int64)
    packed = rows.size < 1 << 53 - COUNT_BIT and own_h.sum() < 1 << COUNT_BIT
    hn = own_h + float(1 << COUNT_BIT) if packed else own_h
    for k, slots in sets:
        wide = int(starts[slots[0] + 1] - starts[slots[0]]) if len(slots) == 1 else len(slots) + 1
        if wide == 1:
            got[:, starts[slots[0]]] = whole
            continue
        code = merged[k].take(rows).astype(np.intp)
        sums = [np.bincount(code, v, wide).astype(np.int64) for v in (own_g, hn)]
        if packed:
            sums[1:] = [sums[1] & (1 << COUNT_BIT) - 1, sums[1] >> COUNT_BIT]
        else:
            sums.append(np.bincount(code, minlength=wide))
        sums = np.stack(sums)
        if len(slots) == 1:
            got[:, starts[slots[0]]:starts[slots[0] + 1]] = sums
        else:
            at = starts[np.array(slots)]
            got[:, at] = whole[:, None] - sums[:, 1:]
            got[:, at + 1] = sums[:, 1:]
    return got


def grow_here(merged: np.ndarray, label: np.ndarray, mark: np.ndarray, r: BoostRules, allowed: np.ndarray, starts: np.ndarray,
              pos_weight: float, one_hot: list) -> Iterator["Tree"]:
    """All trees of one model over rows that are at hand: best first, one cut at a time.  A node keeps its rows in the
    tree's sample and the others, so margins follow from its leaves; of two siblings the smaller is summed."""
    place = {s: (k, i if len(slots) > 1 else 0) for k, slots in enumerate(one_hot) for i, s in enumerate(slots, 1)}
    margin, every = np.zeros(label.size), np.arange(label.size)
    for tree in range(r.trees):
        slots = drawn_slots(r, allowed, tree)
        drawn = set(slots.tolist())
        sets = [(k, one) for k, one in enumerate(one_hot) if any(s in drawn for s in one)]
        g, h = gradients(margin, label, pos_weight, r, tree)
        growth, left = Growth(r.of_tree(tree)), (r.leaves or 1 << r.depth) - 1
        root, cuts = growth.nodes[1], []
        rows, sums, edge = {1: (every, every[:0])}, {}, []
        if r.subsample < 1:
            on = drawn_rows(r, mark, tree)
            rows[1] = (np.flatnonzero(on), np.flatnonzero(~on))

        def measured(node: Node, whole: np.ndarray) -> None:
            gain, s, at, g_, h_, lg, lh = best_cut(whole, starts, slots, r)
            node.cut = (gain, s, at, lg, lh)
            if node.key == 1:
                node.g, node.h = g_, h_
            if gain > 0:
                sums[node.key] = whole
                edge.append(node)

        if left > 0 and not growth._final(root) and rows[1][0].size:
            measured(root, _node_sums(merged, rows[1][0], g, h, sets, starts))
        while left > 0 and edge:
            best = min(edge, key=lambda n: (-n.cut[0], n.key))
            edge.remove(best)
            children = growth._grow(best)
            (k, dummy), cut = place[best.cut[1]], best.cut[2]
            parts = []
            for own in rows.pop(best.key):
                code = merged[k].take(own)
                right = code == dummy if dummy else code > cut
                parts.append((own[~right], own[right]))
            for side, child in enumerate(children):
                rows[child.key] = tuple(p[side] for p in parts)
            cuts.append(best.key)
            left -= 1
            whole = sums.pop(best.key)
            asked = [c for c in children if not growth._final(c)] if left > 0 else []
            if asked:
                small, large = sorted(children, key=lambda c: rows[c.key][0].size)
                found = {small.key: _node_sums(merged, rows[small.key][0], g, h, sets, starts)}
                found[large.key] = whole - found[small.key]
                for c in asked:
                    measured(c, found[c.key])
        done = growth.finished(cuts)
        for key, own in rows.items():
            for some in own:
                margin[some] += done.values[key]
        yield done


def _grow_in_tasks(blocks: _Blocks, rules: list[BoostRules], allowed: list, starts: np.ndarray, pos_weight: float,
                   one_hot: list) -> list[list["Tree"]]:
    """Every model in one job, a task for each run of models (``blocks.single``: it has all rows of its models)."""
    n_slots = blocks.n_slots

    def grow(batches):
        held: dict = {}
        for b in batches:
            for r in b.to_pylist():
                held.setdefault((r["first"], r["models"]), []).append(
                    (merged_codes(_codes(r, n_slots), one_hot), np.frombuffer(r["label"]), np.frombuffer(r["mark"], np.uint64)))
        for (first, models), parts in held.items():
            merged, label, mark = (np.concatenate(x, axis=-1) for x in zip(*parts))
            for m in range(first, first + models):
                for t, tree in enumerate(grow_here(merged, label, mark, rules[m], allowed[m], starts, pos_weight, one_hot)):
                    nodes, leaves = list(tree.routes), list(tree.values)
                    yield pa.RecordBatch.from_pylist([dict(
                        model=m, tree=t, node=nodes, slot=[tree.routes[k][0] for k in nodes], bin=[tree.routes[k][1] for k in nodes],
                        leaf=leaves, value=[tree.values[k] for k in leaves])], schema=TREE_ARROW)
    empty = [[Growth(r.of_tree(t)).finished([]) for t in range(r.trees)] for r in rules]  # as they stay where no row has a label
    for t in blocks.frame.mapInArrow(grow, TREE_SCHEMA).collect():
        empty[t["model"]][t["tree"]] = Tree(dict(zip(t["node"], zip(t["slot"], t["bin"]))), dict(zip(t["leaf"], t["value"])))
    return empty


BLOCK_ARROW = pa.schema([("n", pa.int32()), ("first", pa.int32()), ("models", pa.int32()), ("codes", pa.binary()),
                         ("label", pa.binary()), ("mark", pa.binary()), ("margins", pa.binary())])
CUT_ARROW = pa.schema([("model", pa.int32()), ("node", pa.int32()), ("gain", pa.float64()), ("slot", pa.int32()),
                       ("bin", pa.int32()), ("g", pa.int64()), ("h", pa.int64()), ("lg", pa.int64()), ("lh", pa.int64())])
TREE_SCHEMA = "model int, tree int, node array<int>, slot array<int>, bin array<int>, leaf array<int>, value array<double>"
TREE_ARROW = pa.schema([("model", pa.int32()), ("tree", pa.int32()), ("node", pa.list_(pa.int32())), ("slot", pa.list_(pa.int32())),
                        ("bin", pa.list_(pa.int32())), ("leaf", pa.list_(pa.int32())), ("value", pa.list_(pa.float64()))])


@dataclass
class BoostedModel:
    rules: BoostRules
    pre: object
    edges: list
    trees: list
    train_rows: int = 0
    fit_seconds: float = 0.0
    passes: int = 0

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        scored = score_all([self], df, "_scores")
        return scored.select(*df.columns, F.col("_scores")[0].alias(out))


def score_all(models: list[BoostedModel], df: DataFrame, out: str = "scores") -> DataFrame:
    """``df`` with an array of every model's score; the rows are encoded and binned once."""
    edges, forests = models[0].edges, [[t.packed() for t in m.trees] for m in models]
    steep = np.array([[2.0 if m.rules.residual else 1.0] for m in models])

    @F.pandas_udf("array<double>")
    def scores(v):
        if not len(v):
            return v
        codes = to_codes(np.stack(v.to_numpy()), edges)
        margins = np.stack([sum((t.margins(codes) for t in trees), np.zeros(codes.shape[1])) for trees in forests])
        return type(v)(list((1.0 / (1.0 + np.exp(-margins * steep))).T))
    enc = models[0].pre.transform(df)
    return enc.select(*df.columns, scores(vector_to_array("features")).alias(out))


def _grow_by_passes(blocks: _Blocks, rules: list[BoostRules], allowed: list, starts: np.ndarray, pos_weight: float,
                    one_hot: list) -> tuple[list[list[Tree]], int]:
    """Every model in shared passes over blocks in many tasks; the trees and the number of passes."""
    trees: list[list[Tree]] = [[] for _ in rules]
    pending: list[list[PackedTree]] = [[] for _ in rules]
    growing = {m: Growth(r.of_tree(0)) for m, r in enumerate(rules) if r.trees > 0}
    slots = {m: drawn_slots(r, allowed[m], 0) for m, r in enumerate(rules)}
    passes = 0
    try:
        while growing:
            asks = {}
            for m in list(growing):
                r, tree = rules[m], growing[m]
                cuts, nodes = tree.walk()
                if not nodes:  # the tree is done; the next one opens in the same pass
                    done = tree.finished(cuts)
                    trees[m].append(done)
                    pending[m].append(done.packed())
                    if len(trees[m]) == r.trees:
                        del growing[m]
                        continue
                    tree = growing[m] = Growth(r.of_tree(len(trees[m])))
                    slots[m] = drawn_slots(r, allowed[m], len(trees[m]))
                    nodes = [1]
                asks[m] = (r, len(trees[m]), slots[m], tree.routes(), nodes)
            if not asks:
                break
            if max(map(len, pending)) >= KEPT_TREES:
                blocks.advance(pending)
                pending = [[] for _ in rules]
            found = {(c["model"], c["node"]): c for c in _measure(blocks, asks, pending, starts, pos_weight, one_hot)}
            passes += 1
            for m, (_, _, _, _, nodes) in asks.items():
                for k in nodes:
                    node, c = growing[m].nodes[k], found.get((m, k))
                    node.cut = (c["gain"], c["slot"], c["bin"], c["lg"], c["lh"]) if c else (0.0, 0, 0, 0, 0)
                    if c and k == 1:
                        node.g, node.h = c["g"], c["h"]
    finally:
        blocks.frame.unpersist()
    return trees, passes


def fit_boosted(train: DataFrame, rules: list[BoostRules], label: str = "is_churn", key: str | Column = "msno",
                pre=None, every_value: bool = False) -> list[BoostedModel]:
    """Fits every model of ``rules`` over the same binned rows: in tasks of their own, or in shared passes.  With
    ``every_value`` slots of few values keep them all, as in MLlib (dummies of rare categories too)."""
    from ebbflow.operators import ml as ML
    t0 = time.time()
    pre = pre or ML.Preprocessor().fit(train)
    n, pos = ML.class_counts(train.where(F.col(label).isNotNull()), label)
    pos_weight = (n - pos) / pos if pos else 1.0
    encoded = pre.transform(train.withColumn("label", F.col(label).cast("double"))).select(
        "features", "label", F.xxhash64(F.col(key) if isinstance(key, str) else key).alias("mark"))
    names = pre.encoded_names()
    if every_value:
        n_numeric = sum(name.startswith("num__") for name, _ in names)
        edges = [*numeric_edges(encoded, n_numeric, BINS), *[np.zeros(1)] * (len(names) - n_numeric)]
    else:
        edges = slot_edges(encoded)
    edges += [np.array([])] * (len(names) - len(edges))
    starts = np.concatenate([[0], np.cumsum([len(e) + 1 for e in edges])]).astype(np.int64)
    allowed = [np.array([i for i, (_, src) in enumerate(names) if src not in r.exclude], np.int64) for r in rules]
    blocks = _Blocks(encoded, edges, len(rules), block_partitions(train.sparkSession, n, len(names)))
    one_hot = one_hot_sets(names, edges)
    if blocks.single:
        try:
            trees = _grow_in_tasks(blocks, rules, allowed, starts, pos_weight, one_hot)
        finally:
            blocks.frame.unpersist()
        passes = 1
    else:
        trees, passes = _grow_by_passes(blocks, rules, allowed, starts, pos_weight, one_hot)
    took = time.time() - t0
    return [BoostedModel(r, pre, edges, t, n, took, passes) for r, t in zip(rules, trees)]


# Search space of the boosted-tree random search.
PARAM_DIST = {
    "depth": [3, 4, 5, 6, 8],
    "lr": [0.01, 0.03, 0.05, 0.1, 0.2],
    "trees": [100, 200, 300],
    "min_hess": [1.0, 3.0, 5.0, 10.0],
    "subsample": [0.6, 0.8, 1.0],
    "colsample": [0.6, 0.8, 1.0],
}


def draws(n_iter: int, param_dist: dict, seed: int) -> list[dict]:
    """Seeded draws from the parameter lists, each combination once (at most as many as there are)."""
    rng, keys, out = random.Random(seed), list(param_dist), []
    while len(out) < min(n_iter, math.prod(len(v) for v in param_dist.values())):
        d = {k: rng.choice(param_dist[k]) for k in keys}
        if d not in out:
            out.append(d)
    return out


def random_search(train: DataFrame, feature_sets: dict, n_iter: int = 15, seed: int = C.SEED, label: str = "is_churn",
                  param_dist: dict | None = None) -> list[dict]:
    """H9: the same draws for each feature set (name -> excluded features), fitted on one class-stratified part of
    ``train`` in shared passes and compared by ROC-AUC on the rest, which is scored once for all.  Returns a dict a
    candidate: feature_set, draw, the parameters, roc_auc, best (first of the highest ROC-AUC in its set)."""
    from ebbflow.operators import ml as ML
    from ebbflow.operators.curves import ranking_metrics
    drawn = draws(n_iter, param_dist or PARAM_DIST, seed)
    found = [dict(feature_set=name, draw=i, **d) for name in feature_sets for i, d in enumerate(drawn)]
    rules = [BoostRules(**drawn[c["draw"]], exclude=tuple(feature_sets[c["feature_set"]]), seed=seed) for c in found]
    split = ML.stratified_split(train, 0.8, salt="search", label=label).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        models = fit_boosted(split.where(F.col("split") == "train"), rules, label)
        scored = score_all(models, split.where(F.col("split") == "test"), "_scores").select(
            label, F.posexplode("_scores").alias("model", "score"))
        auc = {r["model"]: r["roc_auc"] for r in ranking_metrics(scored, "score", label, None, ["model"]).collect()}
    finally:
        split.unpersist()
    for k, c in enumerate(found):
        c["roc_auc"] = auc.get(k)
    for name in feature_sets:
        own = [c for c in found if c["feature_set"] == name]
        top = max((c["roc_auc"] for c in own if c["roc_auc"] is not None), default=None)
        first = next(c for c in own if c["roc_auc"] == top)
        for c in own:
            c["best"] = c is first
    return found


def tuned_models(train: DataFrame, found: list[dict], feature_sets: dict, seed: int = C.SEED,
                 label: str = "is_churn") -> dict[str, BoostedModel]:
    """The best candidate of each feature set, fitted on all of ``train`` (one run of shared passes)."""
    best = [c for c in found if c["best"]]
    names = [f.name for f in fields(BoostRules)]
    rules = [BoostRules(**{k: v for k, v in c.items() if k in names}, exclude=tuple(feature_sets[c["feature_set"]]), seed=seed)
             for c in best]
    return dict(zip([c["feature_set"] for c in best], fit_boosted(train, rules, label)))
