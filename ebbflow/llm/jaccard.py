"""N-gram Jaccard self-join by chosen paths.

A text is the set of its five-word shingles (a text of one to four words has one shingle,
all its words).  Equal sets are one member with a copy count.  In each run a set picks
the shingles whose hash, seeded by the path so far, lies below ``width / size``, and goes
down the path of every pick; after two picks the paths are buckets.  Buckets over
``bucket_limit`` are split by further picks, unless most of their members share so many large
buckets that picks would not part them (``dense_buckets``).  Runs repeat until a pair of the target
similarity shares a bucket with the target probability, also if all its buckets are split.  Inside a bucket all pairs are
compared exactly on their sets; a pair that shares several buckets counts in the least one
alone, so links need not be emitted as pairs: each bucket gives its members' link counts
and a spanning forest, and the forests are joined to classes.

Buckets that stay large hold families of near copies, whose members share many of them.  Large
buckets with a common member make one family, and a member is in one family at most; all pairs of
a family are compared once, blocks of members against blocks, and no bucket answers for them again.
So a member costs a row a block of its family, however many buckets it shares with it.

Defined results: a null, empty or wordless text has no shingles, no links and a class of
its own; rows with equal shingle sets (copies, repeated rows) link to each other; a class
is named by its least doc_id (null if it has none); other columns are ignored; an empty
table gives an empty result.  Whole texts count; no bucket, partner or candidate is capped.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbflow.llm.common import SpanHash, U64, mix64, ngram_hash, shuffle_parts, sorted_groups, stored, text_slices, word_spans
from ebbflow.llm.components import Forest, components

NO_ID = (1 << 63) - 1  # order of a null doc_id: last


@dataclass(frozen=True)
class JoinRules:
    similarity: float = 0.8
    words: int = 5
    width: float = 2.0           # picks a level (expected)
    target_recall: float = 0.999
    bucket_limit: int = 1024
    block_shingles: int = 1 << 21
    family_block: int = 4096     # members of a block of a family
    tile: int = 512              # members compared at once inside blocks
    max_level: int = 4
    dense_share: float = 0.75    # members near the centre that make a large bucket dense

    @property
    def runs(self) -> int:
        """Repeats after which a pair at the threshold shares a two-pick path with the target probability."""
        return self.runs_for(2)

    def runs_for(self, picks: int) -> int:
        """The same for paths of ``picks`` picks."""
        mean, p = self.similarity * self.width, 1.0
        for _ in range(picks):
            p = 1 - math.exp(-mean * p)
        return math.ceil(math.log(1 - self.target_recall) / math.log(1 - p))


def shingle_sets(data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and their offsets."""
    ws, we, woff = word_spans(data, off)
    h = SpanHash(data, seed=11)(ws, we)
    grams = ngram_hash(h, n)
    count = np.diff(woff)
    doc = np.repeat(np.arange(len(count)), np.maximum(count - n + 1, 0))
    at = np.arange(len(doc)) - np.repeat(np.cumsum(np.maximum(count - n + 1, 0)) - np.maximum(count - n + 1, 0), np.maximum(count - n + 1, 0))
    values = grams[woff[doc] + at] if len(doc) else np.zeros(0, U64)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        own = np.array([ngram_hash(h[woff[d]:woff[d + 1]], int(count[d]))[0] for d in short], U64)
        doc, values = np.concatenate([doc, short]), np.concatenate([values, own])
    order = np.lexsort((values, doc))
    doc, values = doc[order], values[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (values[1:] != values[:-1])
    doc, values = doc[new], values[new]
    return values, np.searchsorted(doc, np.arange(len(count) + 1))


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of all ranges in a row, and the number of the range each belongs to."""
    which = np.repeat(np.arange(len(starts)), lengths)
    return np.arange(len(which)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + starts[which], which


def extend(values: np.ndarray, soff: np.ndarray, doc: np.ndarray, path: np.ndarray, width: float):
    """(doc, longer path) for every pick below each (doc, path)."""
    at, which = _ranges(soff[doc], soff[doc + 1] - soff[doc])
    size = np.diff(soff)[doc]
    below = (np.minimum(width / np.maximum(size, 1), 1.0) * float(1 << 53)).astype(U64)
    picked = (mix64(values[at] ^ path[which]) >> U64(11)) < below[which]
    at, which = at[picked], which[picked]
    return doc[which], mix64(path[which] * U64(3) + mix64(values[at]))


def run_seeds(rules: JoinRules) -> np.ndarray:
    """A seed for each run; as many as the longest paths need, for any bucket may be split."""
    return mix64(np.arange(1, rules.runs_for(max(2, rules.max_level)) + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))


def set_key(values: np.ndarray, soff: np.ndarray) -> list[bytes]:
    """A 128-bit name for each set."""
    pad = np.append(values, U64(0))
    with np.errstate(over="ignore"):
        total, other = np.concatenate([[U64(0)], np.cumsum(mix64(pad + U64(17)))]), np.concatenate([[U64(0)], np.cumsum(mix64(pad ^ U64(0xABCDEF)))])
    a, b = total[soff[1:]] - total[soff[:-1]], other[soff[1:]] - other[soff[:-1]]
    raw = np.stack([mix64(a + np.diff(soff).astype(U64)), b], axis=1).astype(">u8").tobytes()
    return [raw[k:k + 16] for k in range(0, len(raw), 16)]


SKETCH = "doc_id long, mark long, key binary, size long, paths array<long>"


def sketches(docs: DataFrame, rules: JoinRules) -> DataFrame:
    """Set name, size and bucket paths of each document; ``mark`` hashes the text."""

    def run(batches):
        seeds = run_seeds(rules)
        for batch in batches:
            for i, j, data, off in text_slices(batch, "text", 1 << 20):
                values, soff = shingle_sets(data, off, rules.words)
                n = np.arange(j - i)
                doc, path = extend(values, soff, np.tile(n, len(seeds)), np.repeat(seeds, j - i), rules.width)
                doc, path = extend(values, soff, doc, path, rules.width)
                order = np.argsort(doc, kind="stable")
                poff = np.searchsorted(doc[order], np.arange(j - i + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), batch.column("mark").slice(i, j - i),
                     pa.array(set_key(values, soff), pa.binary()), pa.array(np.diff(soff), pa.int64()),
                     pa.ListArray.from_arrays(pa.array(poff), pa.array(path[order].view(np.int64)))],
                    ["doc_id", "mark", "key", "size", "paths"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("mark"), "text").mapInArrow(run, SKETCH)


def _sets(docs: DataFrame, wanted: DataFrame, rules: JoinRules) -> DataFrame:
    """(key, shingles) of the wanted members, from one document of each."""

    def run(batches):
        for batch in batches:
            for i, j, data, off in text_slices(batch, "text", 1 << 20):
                values, soff = shingle_sets(data, off, rules.words)
                raw = values.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").slice(i, j - i),
                     pa.array([raw[8 * a:8 * b] for a, b in zip(soff[:-1], soff[1:])], pa.binary())], ["key", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("text_mark"), "text")
    picked = wanted.join(texts, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("text_mark"))).select("key", "text")
    return picked.mapInArrow(run, "key binary, shingles binary").dropDuplicates(["key"])


def _deeper(rows: DataFrame, rules: JoinRules) -> DataFrame:
    """Paths of rows (bucket, key, size, shingles), one pick longer."""

    def run(batches):
        for big in batches:
            for k in range(0, big.num_rows, 512):
                batch = big.slice(k, 512)
                values, soff = _packed(batch.column("shingles"))
                doc, path = extend(values, soff, np.arange(batch.num_rows), batch.column("bucket").to_numpy().view(U64), rules.width)
                take = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(path.view(np.int64)), batch.column("key").take(take), batch.column("size").take(take)], ["bucket", "key", "size"])

    return rows.select("bucket", "key", "size", "shingles").mapInArrow(run, "bucket long, key binary, size long")


def _packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a column of packed 64-bit arrays."""
    _, off, data = column.buffers()
    o = np.frombuffer(off, np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    values = np.frombuffer(data, np.uint8)[o[0]:o[-1]].copy().view(U64) if len(column) and data is not None else np.zeros(0, U64)
    return values, (o - o[0]) // 8


def _counted(rows: DataFrame) -> DataFrame:
    """Rows of the buckets that hold two members or more, with the bucket's members and shingles."""
    live = rows.groupBy("bucket").agg(F.count("*").alias("members"), F.sum("size").alias("shingle_sum")).filter("members > 1")
    return rows.join(live, "bucket")


def _overlaps(values: np.ndarray, soff: np.ndarray) -> np.ndarray:
    """Matrix of intersection sizes of the sets."""
    m = len(soff) - 1
    uniq, inverse, count = np.unique(values, return_inverse=True, return_counts=True)
    doc = np.repeat(np.arange(m), np.diff(soff))
    shared = count[inverse] > 1
    everywhere = int((count == m).sum())
    shared &= count[inverse] < m              # what all hold is a constant
    column = np.cumsum((count > 1) & (count < m)) - 1
    col, doc = column[inverse[shared]], doc[shared]
    out = np.full((m, m), everywhere, np.float32)
    width = int(col.max()) + 1 if len(col) else 0
    order = np.argsort(col, kind="stable")
    col, doc = col[order], doc[order]
    for a in range(0, width, 4096):
        lo, hi = np.searchsorted(col, [a, a + 4096])
        x = np.zeros((m, min(4096, width - a)), np.float32)
        x[doc[lo:hi], col[lo:hi] - a] = 1
        out += x @ x.T
    return out


def _pair_mask(bucket: int, lists: pa.Array, family: pa.Array) -> np.ndarray:
    """Pairs (upper triangle) that this bucket answers for: no lesser bucket and no family holds both."""
    m = len(lists)
    off, data = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(m), np.diff(off))
    flat = data[off[0]:off[-1]]
    lesser = flat < bucket
    flat, doc = flat[lesser], doc[lesser]
    mask = np.triu(np.ones((m, m), bool), 1)
    known, name = family.is_valid().to_numpy(zero_copy_only=False), pc.fill_null(family, 0).to_numpy()
    if known.any():
        mask &= ~(known[:, None] & known[None, :] & (name[:, None] == name[None, :]))
    if len(flat):
        uniq, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
        many = count[inverse] > 1
        if many.any():
            col, doc = inverse[many], doc[many]
            col = np.unique(col, return_inverse=True)[1]
            order = np.argsort(col, kind="stable")
            col, doc = col[order], doc[order]
            for k in range(0, int(col[-1]) + 1, 4096):      # in strips: a wide matrix would fill a worker
                lo, hi = np.searchsorted(col, [k, k + 4096])
                x = np.zeros((m, 4096), np.float32)
                x[doc[lo:hi], col[lo:hi] - k] = 1
                mask &= (x @ x.T) == 0
    return mask


def _needed(rows: DataFrame) -> DataFrame:
    """The rows (bucket, key, buckets, family, copies) that take part in a pair their bucket answers for."""
    columns = ["bucket", "key", "buckets", "family", "copies"]

    def run(batches):
        for group in sorted_groups(batches, "bucket"):
            mask = _pair_mask(group.column("bucket")[0].as_py(), group.column("buckets"), group.column("family"))
            use = mask.any(axis=0) | mask.any(axis=1)
            if use.any():
                yield group.filter(pa.array(use)).select(columns)

    schema = "bucket long, key binary, buckets array<long>, family long, copies long"
    return rows.repartition("bucket").sortWithinPartitions("bucket").select(*columns).mapInArrow(run, schema)


LINKED = "key binary, root binary, links long"


def _permille(rules: JoinRules) -> int:
    """The similarity in thousandths: overlap / union >= similarity in whole numbers."""
    return round(rules.similarity * 1000)


def _linked(rows: DataFrame, rules: JoinRules) -> DataFrame:
    """For the members of each bucket: links found (other documents), and the root of their local tree."""

    def run(batches):
        for group in sorted_groups(batches, "bucket"):
            mask = _pair_mask(group.column("bucket")[0].as_py(), group.column("buckets"), group.column("family"))
            values, soff = _packed(group.column("shingles"))
            size = np.diff(soff)
            both = _overlaps(values, soff)
            union = size[:, None] + size[None, :] - both
            link = mask & (both * 1000 >= _permille(rules) * union)
            if not link.any():
                continue
            link |= link.T
            copies = group.column("copies").to_numpy()
            label = np.arange(len(size))
            while True:                       # least member reachable
                new = np.minimum(label, np.where(link, label[None, :], len(size)).min(axis=1))
                new = np.minimum(new, new[new])
                if (new == label).all():
                    break
                label = new
            use = np.flatnonzero(link.any(axis=1))
            keys = group.column("key")
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(use)), keys.take(pa.array(label[use])), pa.array((link @ copies)[use], pa.int64())], ["key", "root", "links"])

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, LINKED)


def dense_buckets(big: DataFrame, rules: JoinRules) -> DataFrame:
    """The large buckets of (bucket, key) that further picks would not thin out, for they hold near copies:
    most members share large buckets with the member that has most of them, one a run or more.  Sets with
    half their shingles in common do so; a pick more of each multiplies their common buckets by one or more."""
    lists = big.groupBy("key").agg(F.collect_set("bucket").alias("among"))
    listed = big.select("bucket", "key").join(lists, "key")
    centres = listed.groupBy("bucket").agg(F.max_by("among", F.struct(F.size("among"), "key")).alias("centre"))
    near = F.size(F.array_intersect("among", "centre")) >= len(run_seeds(rules))
    shares = listed.join(centres, "bucket").groupBy("bucket").agg(F.avg(near.cast("int")).alias("near"))
    return shares.filter(F.col("near") >= rules.dense_share).select("bucket")


def families(big: DataFrame) -> DataFrame:
    """(key, family) of the members of large buckets (bucket, key): buckets with a common member are one family."""
    least = stored(big.groupBy("key").agg(F.min("bucket").alias("least")), "least-buckets")
    edges = big.join(least, "key").filter("bucket <> least").select(F.col("bucket").alias("u"), F.col("least").alias("v")).distinct()
    roots = components(edges)
    return least.join(roots, F.col("least") == F.col("node"), "left").select("key", F.coalesce("root", "least").alias("family"))


def _cross(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Intersection sizes of the sets of one side with those of the other."""
    (va, oa), (vb, ob) = left, right
    shared = np.intersect1d(np.unique(va), np.unique(vb), assume_unique=True)
    out = np.zeros((len(oa) - 1, len(ob) - 1), np.float32)
    sides = []
    for values, off in (left, right):
        at = np.searchsorted(shared, values)
        hit = np.flatnonzero(shared[np.minimum(at, len(shared) - 1)] == values) if len(shared) else np.zeros(0, np.int64)
        order = np.argsort(at[hit], kind="stable")
        sides.append((at[hit][order], np.repeat(np.arange(len(off) - 1), np.diff(off))[hit][order], len(off) - 1))
    for k in range(0, len(shared), 4096):
        x = []
        for col, doc, m in sides:
            lo, hi = np.searchsorted(col, [k, k + 4096])
            dense = np.zeros((m, min(4096, len(shared) - k)), np.float32)
            dense[doc[lo:hi], col[lo:hi] - k] = 1
            x.append(dense)
        out += x[0] @ x[1].T
    return out


def _family_linked(rows: DataFrame, rules: JoinRules) -> DataFrame:
    """The same as ``_linked`` for pairs of blocks (group, a, b) of a family, tile by tile."""

    def run(batches):
        for group in sorted_groups(batches, "group"):
            a, b = group.column("a")[0].as_py(), group.column("b")[0].as_py()
            group = group.take(pa.array(np.argsort(group.column("side").to_numpy(), kind="stable")))
            side, keys, copies = group.column("side").to_numpy(), group.column("key"), group.column("copies").to_numpy()
            values, soff = _packed(group.column("shingles"))
            middle = int(np.searchsorted(side, b)) if a != b else 0      # rows of b
            forest, links = Forest(len(side)), np.zeros(len(side), np.int64)
            tiles = lambda lo, hi: [(k, min(k + rules.tile, hi)) for k in range(lo, hi, rules.tile)]
            part = lambda t: (values[soff[t[0]]:soff[t[1]]], soff[t[0]:t[1] + 1] - soff[t[0]])
            left, right = tiles(0, middle if a != b else len(side)), tiles(middle, len(side))
            for s in left:
                for t in right:
                    if a == b and t < s:
                        continue
                    both = _cross(part(s), part(t))
                    union = np.diff(soff[s[0]:s[1] + 1])[:, None] + np.diff(soff[t[0]:t[1] + 1])[None, :] - both
                    link = both * 1000 >= _permille(rules) * union
                    if s == t:
                        np.fill_diagonal(link, False)
                    if not link.any():
                        continue
                    x, y = np.arange(*s), np.arange(*t)
                    links[x] += link @ copies[y]
                    if s != t:
                        links[y] += copies[x] @ link
                    forest.join(link, x, y)
            use = np.flatnonzero(links)
            if len(use):
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(use)), keys.take(pa.array(forest.roots(use))), pa.array(links[use])],
                                                 ["key", "root", "links"])

    return rows.repartition("group").sortWithinPartitions("group").mapInArrow(run, LINKED)


def _family_rows(member: DataFrame, reps: DataFrame, rules: JoinRules) -> DataFrame:
    """(group, a, b, side, key, copies): each member once for each block of its family."""
    sized = member.join(reps.select("key", "size", "copies"), "key")
    blocks = sized.groupBy("family").agg(F.ceil(F.greatest(
        F.count("*") / rules.family_block, F.sum("size") / rules.block_shingles)).cast("int").alias("blocks"))
    placed = sized.join(blocks, "family").withColumn("side", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.withColumn("a", F.least("side", "other")).withColumn("b", F.greatest("side", "other"))
    return placed.select(F.concat_ws("-", "family", "a", "b").alias("group"), "a", "b", "side", "key", "copies")


@dataclass
class Join:
    sketch: DataFrame   # doc_id, mark, key, size, paths: a row per document
    classes: DataFrame  # key, doc_id (least), copies, root, n_links: a row per distinct set


def join(docs: DataFrame, rules: JoinRules = JoinRules()) -> Join:
    """The whole join; see the module's text."""
    spark = docs.sparkSession
    sketch = stored(sketches(docs, rules), "sketches")
    reps = sketch.filter("size > 0").groupBy("key").agg(
        F.min(F.struct("doc_id", "mark")).alias("one"), F.count("*").alias("copies"), F.min("doc_id").alias("first_id"),
        F.first("size").alias("size"), F.first("paths").alias("paths"))
    reps = stored(reps.select("key", "one.doc_id", "one.mark", "first_id", "copies", "size", "paths"), "sets")
    rows = stored(_counted(reps.select(F.explode("paths").alias("bucket"), "key", "size").distinct()), "paths")
    sets = stored(_sets(docs, reps.join(rows.select("key").distinct(), "key", "left_semi").select("key", "doc_id", "mark"), rules), "shingles")
    over, families_of = F.col("members") > rules.bucket_limit, []
    for _ in range(2, rules.max_level):
        big = rows.filter(over)
        if big.isEmpty():
            break
        dense = dense_buckets(big, rules).withColumn("dense", F.lit(True))
        big = stored(big.join(F.broadcast(dense), "bucket", "left"), "large-buckets")
        families_of.append(big.filter("dense").select("bucket", "key"))
        split = _counted(_deeper(big.filter("dense IS NULL").select("bucket", "key", "size").join(sets, "key"), rules).distinct())
        rows = stored(rows.filter(~over).unionByName(split.select(rows.columns)), "paths")
    large = over | (F.col("shingle_sum") > rules.block_shingles)
    families_of.append(rows.filter(large).select("bucket", "key"))
    member = stored(families(reduce(DataFrame.unionByName, families_of)), "families")
    rows = rows.filter(~large)
    lists = rows.groupBy("key").agg(F.collect_set("bucket").alias("buckets"))
    listed = lists.join(reps.select("key", "copies"), "key").join(member, "key", "left")
    needed = _needed(rows.select("bucket", "key").join(listed, "key"))
    found = _linked(needed.join(sets, "key"), rules)
    found = stored(found.unionByName(_family_linked(_family_rows(member, reps, rules).join(sets, "key"), rules)), "links")
    roots = components(found.select(F.col("key").alias("u"), F.col("root").alias("v")).distinct())
    links = found.groupBy("key").agg(F.sum("links").alias("found"))
    classes = reps.select("key", "first_id", "copies").join(roots.withColumnRenamed("node", "key"), "key", "left").join(links, "key", "left")
    classes = classes.select("key", "first_id", "copies", F.coalesce("root", "key").alias("root"),
                             (F.coalesce("found", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return Join(sketch, classes)


def near_duplicates(docs: DataFrame, rules: JoinRules = JoinRules()) -> DataFrame:
    """doc_id, class_id (least doc_id of its class), n_links (other documents at the similarity
    or more), n_shingles: a row per document."""
    found = join(docs, rules)
    named = found.classes.groupBy("root").agg(F.min("first_id").alias("class_id"))
    per_set = found.classes.select("key", "root", "n_links").join(named, "root").select("key", "class_id", "n_links")
    return found.sketch.select("doc_id", "key", "size").join(per_set, "key", "left").select(
        "doc_id", F.when(F.col("size") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("size").alias("n_shingles"))


def keep_one_of_each(docs: DataFrame, rules: JoinRules = JoinRules()) -> DataFrame:
    """``docs`` with one document of each class: the least doc_id (null last), then the least
    text hash.  Texts without a shingle all stay."""
    found = join(docs, rules)
    place = F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("ord"), "mark")
    members = found.sketch.filter("size > 0").select("key", place.alias("place")).join(found.classes.select("key", "root"), "key")
    keepers = members.groupBy("root").agg(F.min("place").alias("kept"))
    # a class of one row keeps it; the others tell which rows go
    gone = members.join(keepers, "root").filter("place != kept").select("place.ord", "place.mark").distinct()
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("ord"), F.xxhash64("text").alias("mark"))
    rows = rows.join(gone, ["ord", "mark"], "left_anti")
    twice = members.groupBy("place").count().filter("count > 1").select("place.ord", "place.mark")
    if not twice.isEmpty():  # rows equal in doc_id and text: one stays
        twice = stored(twice, "repeated-rows")
        rows = rows.join(twice, ["ord", "mark"], "left_anti").unionByName(
            rows.join(twice, ["ord", "mark"], "left_semi").dropDuplicates(["ord", "mark"]))
    return rows.select("row.*")
