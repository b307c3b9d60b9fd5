"""Best-fit packing of token sequences by a configuration linear program.

1. Every document is tokenised and cut into pieces (one Python map); the pieces are
   written once, numbered inside their task by length.
2. The length histogram (at most ``capacity`` rows) goes to the driver.  The
   configuration LP (least number of sequences covering the histogram) is solved by
   multiplicative weights: a price for each length, a knapsack dynamic program for the
   dearest configurations at these prices, prices of what they cover reduced.
3. The fractional solution is rounded down; what remains is packed best-fit, a whole
   configuration at a time, as often as the counts allow.
4. Pieces of a length are interchangeable, so a piece's place follows from its rank
   among its length: task counts are prefix-summed in Spark (a window over task x length
   totals, not over pieces) and a table of placements, whose size depends on the
   histogram alone, is looked up in a map.

Defined results: a null or empty text is one piece holding the end id; repeated rows and
null ids are packed like any other; other columns are ignored; an empty table gives an
empty result.  Nothing is dropped; only documents beyond the capacity are cut.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbflow.llm.common import stored, text_slices
from ebbflow.llm.vocab import word_ids


@dataclass(frozen=True)
class PackRules:
    capacity: int = 4096
    end_id: int = 1
    epsilon: float = 0.08   # step of the multiplicative weights
    rounds: int = 60        # pricing rounds at most
    columns: int = 64       # configurations taken from one pricing table at most
    slack: float = 0.1      # how far below the dearest configuration they may be
    gap: float = 0.002      # stop when the fractional cover is this near the area bound


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def pieces(docs: DataFrame, tokenizer_path: str, rules: PackRules = PackRules()) -> DataFrame:
    """One row per piece; ``part`` and ``nth`` number the pieces of a length inside a task."""
    names = [f.split()[0] for f in PIECES.split(", ")]

    def run(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        seen = np.zeros(rules.capacity + 1, np.int64)
        end = np.array([rules.end_id], "<u4").tobytes()
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for i, j, data, off in text_slices(batch, "text"):
                rows = []
                encoded, at = word_ids(tokenizer_path).encode(data, off)
                encoded, at = encoded.astype("<u4").tobytes(), (4 * at).tolist()
                for d, a, b in zip(range(i, j), at[:-1], at[1:]):
                    own = encoded[a:b] + end
                    total = len(own) // 4
                    for k, start in enumerate(range(0, total, rules.capacity)):
                        length = min(rules.capacity, total - start)
                        crc = zlib.crc32(own[4 * start:4 * (start + length)])
                        rows.append((ids[d], k, start, length, crc, part, int(seen[length])))
                        seen[length] += 1
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int32() if n in ("piece", "part") else pa.int64()) for n, c in zip(names, cols)], names)
        word_ids(tokenizer_path).forget()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


# ------------------------------------------------------------------ the program
def knapsack(lengths: np.ndarray, value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack dynamic program: the greatest value that fits each capacity, and
    the length taken last there (0: none)."""
    worth = np.full(capacity + 1, -np.inf)
    worth[lengths] = value
    best, take = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        gain = worth[1:c + 1] + best[c - 1::-1]
        b = int(gain.argmax())
        if gain[b] > best[c - 1]:
            best[c], take[c] = gain[b], b + 1
        else:
            best[c] = best[c - 1]
    return best, take


def trace(best: np.ndarray, take: np.ndarray, c: int, index: np.ndarray, counts: np.ndarray, first: int) -> np.ndarray:
    """The configuration behind capacity ``c`` plus one piece of length number ``first``, no
    length oftener than it occurs."""
    out = np.zeros(len(counts), np.int64)
    out[first] = 1
    while c > 0 and best[c] > 0:
        if take[c]:
            out[index[take[c]]] += 1
            c -= int(take[c])
        else:
            c -= 1
    return np.minimum(out, counts)


def fill(lengths: np.ndarray, left: np.ndarray, config: np.ndarray, capacity: int) -> np.ndarray:
    """Best fit: the longest lengths still open go into the room the configuration leaves."""
    config = config.copy()
    room = capacity - int(config @ lengths)
    spare = np.flatnonzero(left > config)
    sizes = lengths[spare]
    k = int(np.searchsorted(sizes, room, "right")) - 1
    while k >= 0:
        at = spare[k]
        n = min(room // int(sizes[k]), int(left[at] - config[at]))
        config[at] += n
        room -= n * int(sizes[k])
        k = min(k - 1, int(np.searchsorted(sizes, room, "right")) - 1)
    return config


def plan(lengths: np.ndarray, counts: np.ndarray, rules: PackRules = PackRules()) -> list[tuple[int, np.ndarray]]:
    """(times, configuration) list that uses up the histogram exactly."""
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    if not len(lengths):
        return []
    area = int(lengths @ counts) / rules.capacity
    covered = np.zeros(len(lengths))       # share of each length's count
    used: dict[bytes, float] = {}
    total = 0.0
    index = np.zeros(rules.capacity + 1, np.int64)
    index[lengths] = np.arange(len(lengths))
    for _ in range(rules.rounds):
        weight = np.exp(-(covered - covered.min()) / rules.epsilon) / counts
        best, take = knapsack(lengths, weight, rules.capacity)
        # one table prices a configuration for each length; those of the least covered lengths
        # are taken if they are worth nearly as much as the dearest
        for k in np.argsort(covered, kind="stable")[:rules.columns]:
            rest = rules.capacity - int(lengths[k])
            if weight[k] + best[rest] < (1 - rules.slack) * best[-1]:
                continue
            config = fill(lengths, counts, trace(best, take, rest, index, counts, k), rules.capacity)
            hit = np.flatnonzero(config)
            # as far as the length that it covers fastest moves by epsilon
            step = float((rules.epsilon * counts[hit] / config[hit]).min())
            covered[hit] += step * config[hit] / counts[hit]
            key = config.tobytes()
            used[key] = used.get(key, 0.0) + step
            total += step
        if covered.min() >= 1.0 and total / covered.min() <= area * (1 + rules.gap) + 1:
            break
    scale = 1.0 / max(covered.min(), 1.0) if covered.min() > 0 else 1.0
    left, out = counts.copy(), []

    def put(config: np.ndarray, times: int):
        nonlocal left
        left = left - times * config
        out.append((times, config))

    for key, x in sorted(used.items(), key=lambda kv: -kv[1]):
        config = np.frombuffer(key, np.int64)
        hit = config > 0
        times = int(min(np.floor(x * scale), (left[hit] // config[hit]).min()))
        if times > 0 and int(config @ lengths) >= rules.capacity * (1 - rules.gap):
            put(config, times)
    while left.any():
        k = int(np.flatnonzero(left)[-1])
        config = np.zeros(len(lengths), np.int64)
        config[k] = 1
        config = fill(lengths, left, config, rules.capacity)
        hit = config > 0
        put(config, int((left[hit] // config[hit]).min()))
    return out


def placements(lengths: np.ndarray, chosen: list[tuple[int, np.ndarray]]) -> dict[str, np.ndarray]:
    """For runs of ranks of a length: first rank, copies a sequence, first sequence, first offset."""
    rows, rank, sequence = [], np.zeros(len(lengths), np.int64), 0
    for times, config in chosen:
        offset = 0
        for k in np.flatnonzero(config)[::-1]:
            rows.append((int(lengths[k]), int(rank[k]), int(config[k]), sequence, offset))
            rank[k] += times * config[k]
            offset += int(config[k] * lengths[k])
        sequence += times
    rows.sort()
    a = np.array(rows, np.int64).reshape(-1, 5)
    return {"length": a[:, 0], "rank": a[:, 1], "copies": a[:, 2], "sequence": a[:, 3], "offset": a[:, 4]}


RESULT = ("doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer_path: str, rules: PackRules = PackRules()) -> DataFrame:
    """Every piece with its sequence and its offset there."""
    spark = docs.sparkSession
    cut = stored(pieces(docs, tokenizer_path, rules), "pieces")
    totals = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = totals.groupBy("length").agg(F.sum("n").alias("n")).orderBy("length").collect()  # <= capacity rows
    lengths = np.array([r.length for r in histogram], np.int64)
    where = placements(lengths, plan(lengths, np.array([r.n for r in histogram], np.int64), rules))
    shared = spark.sparkContext.broadcast(where)
    # ranks before a task: over task x length totals
    before = totals.select(
        "part", "length",
        (F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).alias("before"))
    ranked = cut.join(before, ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.coalesce("before", F.lit(0)) + F.col("nth")).alias("rank"))
    names = [f.split()[0] for f in RESULT.split(", ")]

    def place(batches):
        w = shared.value
        # one sorted key for (length, rank): ranks of a length follow each other
        base = {int(x): k for k, x in reversed(list(enumerate(w["length"])))}
        ends = {int(x): k + 1 for k, x in enumerate(w["length"])}
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            row = np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            uniq, first = np.unique(length[order], return_index=True)
            for x, a, b in zip(uniq, first, [*first[1:], len(length)]):
                own = order[a:b]
                lo, hi = base[int(x)], ends[int(x)]
                row[own] = lo + np.searchsorted(w["rank"][lo:hi], rank[own], "right") - 1
            local = rank - w["rank"][row]
            sequence = w["sequence"][row] + local // w["copies"][row]
            offset = w["offset"][row] + (local % w["copies"][row]) * length
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in range(5)] + [pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names)

    return ranked.mapInArrow(place, RESULT)
