"""Embedding near-duplicates by epsilon grid order.

Two unit vectors have a cosine of ``least`` or more if they are at most eps = sqrt(2 - 2 least)
apart.  Equal vectors become one member with a copy count.  Members are projected on leading
principal directions and put in the lexicographic order of their grid cells; the order is dealt
into ranges and cut into blocks, each with the box of its projections.  A sequence interval is a
run of blocks; a pair of intervals whose boxes are over eps apart is skipped, any other pair is
joined half by half.  Down to blocks this recursion is one equi-join of the interval table a
level, below that it goes on in the tasks, on rows.  What is left is compared by its cosines.

Members of a pair of block groups are compared in one task; each unordered pair is met in one
pair of groups alone, so links need not be emitted as pairs: a task gives its members' link
counts and the root of their local tree, and the trees are joined to components.

The directions come from a bounded sample of ``sample`` members (least hashes).  They decide
which pairs are skipped early, never which are found: projections of any orthonormal set
shorten distances.

Defined results: a vector that is null, zero or empty or holds null or non-finite components, and
one without a partner, has no links and names its own component; vectors of different lengths do
not link; copies and repeated rows link to each other; a component is named by its least vec_id
(null if it has none), and a row without vec_id is never the kept one; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbflow.llm.common import shuffle_parts, sorted_groups, stored
from ebbflow.llm.components import Forest, components


@dataclass(frozen=True)
class GridRules:
    least: float = 0.95
    directions: int = 8         # leading principal directions
    cells: int = 4              # grid cells an eps
    sample: int = 4096          # members that the directions are fitted on
    block_bytes: int = 1 << 18  # vectors of a block
    group_bits: int = 3         # 8 blocks are compared with 8 in a task
    fan_bits: int = 4           # intervals of an interval
    leaf: int = 128             # rows of the last intervals

    @property
    def eps(self) -> float:
        return math.sqrt(max(0.0, 2 - 2 * self.least))


def valid(column: str = "embedding"):
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(column).isNotNull() & ~F.coalesce(bad, F.lit(False)) & F.exists(column, lambda x: x != 0)


def _packed(df: DataFrame) -> tuple[DataFrame, np.dtype]:
    """The embedding as float32 if it is one, else float64."""
    kind = df.schema["embedding"].dataType
    narrow = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    return df if narrow else df.withColumn("embedding", F.col("embedding").cast("array<double>")), np.dtype(np.float32 if narrow else np.float64)


def rows_of(column: pa.Array) -> np.ndarray:
    """A matrix of a list column whose lists have one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one, in double precision and without overflow."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def directions(members: DataFrame, rules: GridRules) -> dict[int, np.ndarray]:
    """For each vector length met in the sample, its leading principal directions as columns."""
    rows = members.orderBy(F.xxhash64("embedding"), "member").limit(rules.sample).select("embedding").collect()
    by_dim: dict[int, list] = {}
    for r in rows:
        by_dim.setdefault(len(r.embedding), []).append(r.embedding)
    out = {}
    for dim, own in by_dim.items():
        u = unit(np.array(own, np.float64))
        out[dim] = np.linalg.svd(u - u.mean(axis=0), full_matrices=False)[2][:rules.directions].T
    return out


def project(u: np.ndarray, basis: dict[int, np.ndarray], rules: GridRules) -> np.ndarray:
    """Coordinates on the directions; for a length without any, on the first axes."""
    b = basis.get(u.shape[1])
    p = u[:, :rules.directions] if b is None else u @ b
    return np.pad(p, ((0, 0), (0, rules.directions - p.shape[1])))


def by_length(batch: pa.RecordBatch):
    """Parts of a batch whose vectors have one length."""
    size = np.diff(batch.column("embedding").offsets.to_numpy())
    for n in np.unique(size):
        yield int(n), batch.filter(pa.array(size == n))


def members_of(vectors: DataFrame) -> DataFrame:
    """member, embedding, copies, first_id of each distinct vector that can link."""
    own = vectors.filter(valid()).groupBy("embedding").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first_id"))
    return stored(own.withColumn("member", F.monotonically_increasing_id()), "vectors")


def blocks_of(members: DataFrame, basis: dict, kind: np.dtype, rules: GridRules) -> DataFrame:
    """part, seq, dim, members, copies, raw and the box lo0.., hi0..: blocks in epsilon grid order."""
    width = rules.eps / rules.cells or 1.0
    box = [f"{side}{k}" for side in ("lo", "hi") for k in range(rules.directions)]

    def keys(batches):
        for batch in batches:
            for dim, own in by_length(batch):
                cell = np.floor(project(unit(rows_of(own.column("embedding"))), basis, rules) / width)
                cell = (np.clip(cell, -32000, 32000) + 32768).astype(">u2")
                head = int(dim).to_bytes(4, "big")
                cells = pa.array([head + row.tobytes() for row in cell], pa.binary())
                yield pa.RecordBatch.from_arrays([cells, *(own.column(c) for c in ("member", "copies", "embedding"))], ["cell", "member", "copies", "embedding"])

    def cut(batches):
        held, rows, seq, dim = [], 0, 0, None

        def block():
            table = pa.Table.from_batches(held)
            raw = np.concatenate([rows_of(b.column("embedding")) for b in held]).astype(kind)
            p = project(unit(raw), basis, rules)
            ends = [pa.array([float(x)]) for x in (*p.min(axis=0), *p.max(axis=0))]
            lists = [pa.array([table.column(c).to_numpy()]) for c in ("member", "copies")]
            return pa.RecordBatch.from_arrays(
                [pa.array([seq], pa.int32()), pa.array([dim], pa.int32()), *lists, pa.array([raw.tobytes()], pa.binary()), *ends],
                ["seq", "dim", "members", "copies", "raw", *box])

        for batch in batches:
            for own_dim, own in sorted(by_length(batch), key=lambda x: x[0]):   # the order is by length first
                while own.num_rows:
                    room = max(64, rules.block_bytes // (kind.itemsize * max(1, own_dim)))
                    if held and (own_dim != dim or rows >= room):
                        yield block()
                        held, rows, seq = [], 0, seq + 1
                    dim = own_dim
                    part = own.slice(0, room - rows)
                    held.append(part)
                    rows += part.num_rows
                    own = own.slice(part.num_rows)
        if held:
            yield block()

    element = "float" if kind == np.float32 else "double"
    keyed = members.select("embedding", "member", "copies").mapInArrow(keys, f"cell binary, member long, copies long, embedding array<{element}>")
    ordered = keyed.repartitionByRange(shuffle_parts(members.sparkSession), "cell", "member").sortWithinPartitions("cell", "member")
    made = ordered.mapInArrow(cut, "seq int, dim int, members array<long>, copies array<long>, raw binary, " + ", ".join(f"{c} double" for c in box))
    return made.withColumn("part", F.spark_partition_id())


def _apart(rules: GridRules, left: str, right: str):
    """Squared distance of two boxes, as a lower bound."""
    gaps = [F.greatest(F.lit(0.0), F.col(f"{left}.lo{k}") - F.col(f"{right}.hi{k}"), F.col(f"{right}.lo{k}") - F.col(f"{left}.hi{k}"))
            for k in range(rules.directions)]
    total = gaps[0] * gaps[0]
    for g in gaps[1:]:
        total = total + g * g
    return total


def near_blocks(blocks: DataFrame, rules: GridRules) -> DataFrame:
    """Pairs (a <= b) of blocks that are not provably over eps apart, by recursion over intervals:
    at each level the pairs left are joined to the intervals below either side."""
    ends = [F.min(f"lo{k}").alias(f"lo{k}") for k in range(rules.directions)] + [F.max(f"hi{k}").alias(f"hi{k}") for k in range(rules.directions)]
    top = blocks.agg(F.max("ord")).first()[0] or 0
    shift = 0
    while top >> shift:
        shift += rules.fan_bits
    pairs = blocks.sparkSession.range(1).select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    limit = rules.eps ** 2 + 1e-9
    while shift:
        shift -= rules.fan_bits
        level = blocks.groupBy("dim", F.shiftright("ord", shift).alias("node")).agg(*ends) if shift else blocks.withColumn("node", F.col("ord"))
        level = level.select("node", "dim", F.shiftright("node", rules.fan_bits).alias("up"),
                             F.struct(*[f"{s}{k}" for s in ("lo", "hi") for k in range(rules.directions)]).alias("box"))
        left = level.select(F.col("up").alias("a"), F.col("node").alias("la"), F.col("dim").alias("da"), F.col("box").alias("x"))
        right = level.select(F.col("up").alias("b"), F.col("node").alias("lb"), F.col("dim").alias("db"), F.col("box").alias("y"))
        near = pairs.join(left, "a").join(right, "b").filter((F.col("la") <= F.col("lb")) & (F.col("da") == F.col("db")))
        pairs = near.filter(_apart(rules, "x", "y") <= limit).select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct()
    return pairs


def linked(u: np.ndarray, v: np.ndarray, least: float) -> np.ndarray:
    """Matrix of the pairs of unit rows with a cosine of ``least`` or more.  Single precision leaves
    out what its error bound allows; a rounding tie of the double sum is summed exactly."""
    slack = (u.shape[1] + 8) * 2.0 ** -22
    if not (u.astype(np.float32) @ v.astype(np.float32).T >= least - slack).any():
        return np.zeros((len(u), len(v)), bool)
    s = u @ v.T
    out = s >= least
    for i, j in zip(*np.nonzero(np.abs(s - least) < 1e-13)):
        out[i, j] = math.fsum((u[i] * v[j]).tolist()) >= least
    return out


class Joiner:
    """Recursion over sequence intervals of the rows of two block groups."""

    def __init__(self, u: np.ndarray, p: np.ndarray, copies: np.ndarray, rules: GridRules):
        self.u, self.p, self.rules, self.copies = u, p, rules, copies
        self.links = np.zeros(len(u), np.int64)
        self.forest = Forest(len(u))
        self.limit = rules.eps ** 2 + 1e-9
        self.boxes: dict = {}
        self.compared = 0

    def box(self, a: int, b: int):
        if (a, b) not in self.boxes:
            self.boxes[a, b] = self.p[a:b].min(axis=0), self.p[a:b].max(axis=0)
        return self.boxes[a, b]

    def join(self, a: tuple[int, int], b: tuple[int, int]) -> None:
        """All links between two intervals, equal or apart."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            (lo, hi), (lo2, hi2) = self.box(*a), self.box(*b)
            gap = np.maximum(0, np.maximum(lo - hi2, lo2 - hi))
            if gap @ gap > self.limit:
                continue
            na, nb = a[1] - a[0], b[1] - b[0]
            if max(na, nb) <= self.rules.leaf:
                self.compare(a, b)
                continue
            ma, mb = a[0] + na // 2, b[0] + nb // 2
            if a == b:
                stack += [((a[0], ma), (a[0], ma)), ((a[0], ma), (ma, a[1])), ((ma, a[1]), (ma, a[1]))]
            elif na >= nb:
                stack += [((a[0], ma), b), ((ma, a[1]), b)]
            else:
                stack += [(a, (b[0], mb)), (a, (mb, b[1]))]

    def compare(self, a: tuple[int, int], b: tuple[int, int]) -> None:
        rows, cols = np.arange(*a), np.arange(*b)
        self.compared += len(rows) * len(cols)
        link = linked(self.u[rows], self.u[cols], self.rules.least)
        if a == b:
            np.fill_diagonal(link, False)
        if not link.any():
            return
        self.links[rows] += link @ self.copies[cols]
        if a != b:
            self.links[cols] += self.copies[rows] @ link
        self.forest.join(link, rows, cols)


def _compare(rows: DataFrame, basis: dict, kind: np.dtype, rules: GridRules) -> DataFrame:
    """member, root, links for the members with links of each pair of block groups."""

    def run(batches):
        for group in sorted_groups(batches, "pair"):
            group = group.take(pa.array(np.argsort(group.column("ord").to_numpy(), kind="stable")))
            side, dims = group.column("ord").to_numpy() >> rules.group_bits, group.column("dim").to_numpy()
            lo, hi = side.min(), group.column("other")[0].as_py()
            size = [len(x) for x in group.column("members")]
            off = np.append(0, np.cumsum(size))
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                raw = np.concatenate([np.frombuffer(group.column("raw")[int(k)].as_buffer(), kind).reshape(size[k], dim) for k in own])
                at = np.concatenate([np.arange(off[k], off[k + 1]) for k in own])
                copies = group.column("copies").flatten().to_numpy()[at]
                member = group.column("members").flatten().to_numpy()[at]
                u = unit(raw)
                join = Joiner(u, project(u, basis, rules), copies, rules)
                n_left = int(sum(size[k] for k in own if side[k] == lo))
                if lo == hi:
                    join.join((0, len(u)), (0, len(u)))
                elif 0 < n_left < len(u):
                    join.join((0, n_left), (n_left, len(u)))
                use = np.flatnonzero(join.links)
                if len(use):
                    root = join.forest.roots(use)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(member[use]), pa.array(member[root]), pa.array(join.links[use])], ["member", "root", "links"])

    parts = rows.repartition("pair").sortWithinPartitions("pair")
    return parts.mapInArrow(run, "member long, root long, links long")


@dataclass
class Found:
    members: DataFrame  # member, embedding, copies, first_id
    classes: DataFrame  # member, first_id, root, n_links


def join(vectors: DataFrame, rules: GridRules = GridRules()) -> Found:
    """The whole join; see the module's text."""
    spark = vectors.sparkSession
    vectors, kind = _packed(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"))
    members = members_of(vectors)
    basis = directions(members, rules)
    blocks = stored(blocks_of(members, basis, kind, rules), "grid-blocks")
    # a group of blocks does not pass the end of a range
    bits = max(int(blocks.agg(F.max("seq")).first()[0] or 0).bit_length(), rules.group_bits)
    blocks = blocks.withColumn("ord", F.shiftleft(F.col("part").cast("long"), bits) + F.col("seq"))
    pairs = near_blocks(blocks.drop("members", "copies", "raw"), rules)
    pair = F.struct(F.shiftright("a", rules.group_bits).alias("low"), F.shiftright("b", rules.group_bits).alias("other"))
    needed = pairs.withColumn("pair", pair).select("pair", F.explode(F.array("a", "b")).alias("ord")).distinct()
    key = F.concat(F.hex("pair.low"), F.lit("-"), F.hex("pair.other"))
    rows = needed.select(key.alias("pair"), F.col("pair.other").alias("other"), "ord").join(
        blocks.select("ord", "dim", "members", "copies", "raw"), "ord")
    found = stored(_compare(rows, basis, kind, rules), "grid-links")
    edges = found.filter("member <> root").select(F.col("member").alias("u"), F.col("root").alias("v")).distinct()
    roots = components(edges).withColumnRenamed("node", "member")
    links = found.groupBy("member").agg(F.sum("links").alias("found"))
    classes = members.select("member", "first_id", "copies").join(roots, "member", "left").join(links, "member", "left").select(
        "member", "first_id", F.coalesce("root", "member").alias("root"), (F.coalesce("found", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return Found(members, classes)


def near_duplicates(vectors: DataFrame, rules: GridRules = GridRules()) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row per vector."""
    found = join(vectors, rules)
    named = found.classes.groupBy("root").agg(F.min("first_id").alias("component"))
    per_member = found.classes.join(named, "root").select("member", "n_links", "component")
    known = found.members.select("member", "embedding").join(per_member, "member").drop("member")
    rows, _ = _packed(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"))
    # two keys: the hash deals the rows, the vector itself decides
    rows = rows.withColumn("h", F.xxhash64("embedding")).join(known.withColumn("h", F.xxhash64("embedding")), ["h", "embedding"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                       F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
