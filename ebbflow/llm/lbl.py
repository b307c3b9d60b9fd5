"""LM scoring: an add-one unigram base and a log-bilinear neural model.

Tokens are the lower-cased words of a text and one end.  The model works on classes: the
``n_words`` most frequent words and the end are classes of their own, rarer words fall into
``n_rare`` classes by their last two bytes.  A context vector r[c] and a target vector q[w]
give the score of class w after class c, r[c] . q[w] + b[w]; it is trained by noise-contrastive
estimation (noise: the class frequencies, its expectation taken over all classes) on the class
transitions of the whole training part, and normalised exactly by one batched matrix product
over all contexts.  Inside a rare class a word has its add-one share.  Everything is learned
from counts over all training texts; what the driver holds (classes x classes, the ``n_head``
most frequent words) has a fixed size.  Words beyond ``n_head`` get their counts by a join.

Defined results: a null or empty text is its end token alone; rows with a null id are training
rows; repeated rows are scored (and counted) one by one; other columns are ignored; an empty
table gives an empty result, and without training texts both models are uniform.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbflow.llm.common import slices, stored, text_buffers


@dataclass(frozen=True)
class LblRules:
    """Parameters of the model; all bounds are on the model, none on the input."""

    n_words: int = 2000       # classes of single words
    n_rare: int = 47          # classes of rarer words
    n_head: int = 131_072     # at most so many of the most frequent words are known to every task
    dim: int = 16
    noise: int = 8            # noise samples a token
    steps: int = 60
    rate: float = 0.05
    flush_words: int = 200_000

    @property
    def end(self) -> int:
        return self.n_words

    @property
    def classes(self) -> int:
        return self.n_words + 1 + self.n_rare

    def rare(self, word: bytes) -> int:
        return self.n_words + 1 + zlib.crc32(word[-2:]) % self.n_rare


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _words(batch: pa.RecordBatch):
    """(first row, words of each row) for slices of a batch."""
    data, off = text_buffers(batch.column("text"))
    raw = _LOWER[data].tobytes()
    for i, j in slices(off):
        yield i, [raw[off[d]:off[d + 1]].split() for d in range(i, j)]


def word_counts(train: DataFrame, rules: LblRules) -> DataFrame:
    """(word, class if rare, count) over all training texts; counted in the tasks first."""

    def rows(counts: Counter) -> pa.RecordBatch:
        words = list(counts)
        return pa.RecordBatch.from_arrays(
            [pa.array(words, pa.binary()).cast(pa.string()), pa.array([rules.rare(w) for w in words], pa.int32()),
             pa.array(counts.values(), pa.int64())], ["word", "rare", "n"])

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for _, texts in _words(batch):
                for words in texts:
                    counts.update(words)
                if len(counts) > rules.flush_words:
                    yield rows(counts)
                    counts = Counter()
        yield rows(counts)

    return train.select("text").mapInArrow(run, "word string, rare int, n long").groupBy("word", "rare").agg(F.sum("n").alias("n"))


@dataclass
class Head:
    """The most frequent words with their counts, most frequent first."""

    words: list
    counts: np.ndarray


def frequent(counts: DataFrame, rules: LblRules) -> Head:
    """The words above the least count that leaves at most ``n_head`` of them.  Only a histogram of
    counts by sixteenths of a power of two and those words reach the driver."""
    step = F.floor(F.log2("n") * 16)
    steps = sorted(((r.step, r["count"]) for r in counts.groupBy(step.alias("step")).count().collect()), reverse=True)
    least, taken = None, 0
    for k, n in steps:
        if taken + n > rules.n_head:
            break
        least, taken = k, taken + n
    rows = counts.filter(F.lit(False) if least is None else step >= least).select("word", "n").toArrow()
    n = rows.column("n").to_numpy().astype(np.int64)
    words = rows.column("word").cast(pa.binary()).to_pylist()
    order = sorted(range(len(words)), key=lambda k: (-n[k], words[k]))
    return Head([words[k] for k in order], n[order])


TOKENS = ("row long, doc_id long, held_out boolean, n_tokens long, n_known long, known_log double, rare_log double, "
          "classes binary, word string, n long")


def tokenised(docs: DataFrame, head, rules: LblRules) -> DataFrame:
    """A row per document (class ids, sums over the words that ``head`` holds) and, with ``word``
    set, a row per document and word beyond it.  ``row`` ties them together."""
    names = [f.split()[0] for f in TOKENS.split(", ")]

    def run(batches):
        from pyspark import TaskContext
        row = TaskContext.get().partitionId() << 40
        at = {w: k for k, w in enumerate(head.value.words)}
        own = np.array([k if k < rules.n_words else rules.rare(w) for k, w in enumerate(head.value.words)] + [-1], np.int32)
        logs = np.append(np.log10(head.value.counts + 1.0), 0.0)
        for batch in batches:
            for first, texts in _words(batch):
                n = np.array([len(t) for t in texts])
                flat = [w for t in texts for w in t]
                k = np.fromiter(map(at.get, flat, [-1] * len(flat)), np.int64, len(flat))
                classes = own[k]
                beyond = np.flatnonzero(k < 0)
                doc = np.repeat(np.arange(len(n)), n)
                classes[beyond] = [rules.rare(flat[x]) for x in beyond]
                tail = Counter(zip(doc[beyond].tolist(), [flat[x] for x in beyond]))
                known_log = np.bincount(doc, logs[k], len(n))
                rare_log = np.bincount(doc, logs[k] * (k >= rules.n_words), len(n))
                known = np.bincount(doc, k >= 0, len(n)).astype(np.int64)
                ends = np.cumsum(n)
                packed = classes.astype("<u2")
                rows = row + np.arange(len(n))
                cols = [
                    pa.array(rows, pa.int64()), batch.column("doc_id").slice(first, len(n)),
                    batch.column("held_out").slice(first, len(n)), pa.array(n + 1, pa.int64()), pa.array(known),
                    pa.array(known_log), pa.array(rare_log),
                    pa.array([packed[e - m:e].tobytes() for e, m in zip(ends, n)], pa.binary()),
                    pa.nulls(len(n), pa.string()), pa.nulls(len(n), pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names)
                if tail:
                    m = len(tail)
                    empty = [pa.nulls(m, t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row + d for d, _ in tail], pa.int64()), *empty,
                         pa.array([w for _, w in tail], pa.binary()).cast(pa.string()), pa.array(tail.values(), pa.int64())], names)
                row += len(n)

    return docs.select(F.col("doc_id").cast("long"), "held_out", "text").mapInArrow(run, TOKENS)


def transitions(tokens: DataFrame, rules: LblRules) -> np.ndarray:
    """classes x classes counts of (class before, class); the end stands before the first word.
    Sparse per task, summed by blocks of contexts, at most classes ** 2 numbers in all."""
    size, step = rules.classes, 32

    def count(batches):
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            for c in batch.column("classes"):
                x = np.frombuffer(c.as_buffer(), "<u2").astype(np.int64)
                pair = np.append(x, rules.end)
                pair[1:] += x * size
                pair[0] += rules.end * size
                np.add.at(total, pair, 1)
        for b in range(0, size, step):
            part = total[b * size:(b + step) * size]
            if part.any():
                at = np.flatnonzero(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b], pa.int32()), pa.array([0], pa.int32()), pa.array([at.astype("<u4").tobytes()], pa.binary()),
                     pa.array([part[at].tobytes()], pa.binary())], ["block", "salt", "at", "n"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(step * size, np.int64)
        for a, n in zip(table.column("at"), table.column("n")):
            total[np.frombuffer(a.as_buffer(), "<u4")] += np.frombuffer(n.as_buffer(), np.int64)
        at = np.flatnonzero(total)
        return pa.table({"block": table.column("block").slice(0, 1), "salt": table.column("salt").slice(0, 1),
                         "at": pa.array([at.astype("<u4").tobytes()], pa.binary()), "n": pa.array([total[at].tobytes()], pa.binary())})

    schema = "block int, salt int, at binary, n binary"
    parts = tokens.select("classes").mapInArrow(count, schema)
    salted = parts.withColumn("salt", (F.spark_partition_id() / F.lit(64)).cast("int"))
    some = salted.groupBy("block", "salt").applyInArrow(add, schema)
    out = np.zeros((size, size), np.int64)
    for r in some.groupBy("block").applyInArrow(add, schema).collect():
        flat = out[r.block:r.block + step].reshape(-1)
        flat[np.frombuffer(r.at, "<u4")] = np.frombuffer(r.n, np.int64)
        out[r.block:r.block + step] = flat.reshape(-1, size)
    return out


@dataclass
class LogBilinear:
    context: np.ndarray
    target: np.ndarray
    bias: np.ndarray

    def log10_table(self) -> np.ndarray:
        """Normalised log10 P(class | class before) for all pairs, by batched matrix products."""
        out = np.empty((len(self.context), len(self.target)), np.float32)
        for k in range(0, len(out), 256):
            s = self.context[k:k + 256] @ self.target.T + self.bias
            top = s.max(axis=1, keepdims=True)
            out[k:k + 256] = (s - top - np.log(np.exp(s - top).sum(axis=1, keepdims=True))) / math.log(10)
        return out


def train(counts: np.ndarray, rules: LblRules) -> LogBilinear:
    """Noise-contrastive estimation on transition counts, full gradients, Adam."""
    size = len(counts)
    rng = np.random.default_rng(7)
    unigram = (counts.sum(axis=0) + 1.0) / (counts.sum() + size)
    noise = np.log(rules.noise * unigram).astype(np.float32)
    p = [rng.normal(0, 0.1, (size, rules.dim)).astype(np.float32), rng.normal(0, 0.1, (size, rules.dim)).astype(np.float32),
         np.log(unigram).astype(np.float32)]
    m, v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    seen = counts.sum(axis=1)
    # contexts weigh by the root of their counts, so that rare ones learn too
    scale = (1.0 / np.sqrt(np.maximum(seen, 1.0)) / max(np.sqrt(seen).sum(), 1.0)).astype(np.float32)
    spread = (rules.noise * unigram).astype(np.float32)
    for t in range(1, rules.steps + 1):
        grad = [np.zeros_like(x) for x in p]
        for k in range(0, size, 256):
            r = p[0][k:k + 256]
            delta = r @ p[1].T + (p[2] - noise)
            truth = 1.0 / (1.0 + np.exp(-np.clip(delta, -30, 30)))
            own = counts[k:k + 256].astype(np.float32)
            d = (own * (1 - truth) - seen[k:k + 256, None].astype(np.float32) * spread * truth) * scale[k:k + 256, None]
            grad[0][k:k + 256] = d @ p[1]
            grad[1] += d.T @ r
            grad[2] += d.sum(axis=0)
        for x, g, a, b in zip(p, grad, m, v):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            x += rules.rate * (a / (1 - 0.9 ** t)) / (np.sqrt(b / (1 - 0.99 ** t)) + 1e-8)
    return LogBilinear(*p)


SCHEMA = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score(docs: DataFrame, held_out, rules: LblRules = LblRules()) -> DataFrame:
    """Base and model score of every document; rows where ``held_out`` is false are learned from."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id"), held_out.alias("held_out"), "text")
    counts = stored(word_counts(docs.filter("not held_out"), rules), "word-counts")
    head = frequent(counts, rules)
    by_class = {r.rare: (r.n, r.v) for r in counts.groupBy("rare").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    ends = docs.filter("not held_out").count()
    total = sum(n for n, _ in by_class.values()) + ends
    distinct = sum(v for _, v in by_class.values()) + (ends > 0)
    single = [(rules.rare(w), int(n)) for w, n in zip(head.words[:rules.n_words], head.counts[:rules.n_words])]
    share = np.zeros(rules.classes)  # log10 of what a rare word's count + 1 is divided by
    for k in range(rules.n_words + 1, rules.classes):
        n, v = by_class.get(k, (0, 0))
        share[k] = math.log10(n - sum(x for c, x in single if c == k) + v - sum(c == k for c, _ in single) + 1)

    tokens = stored(tokenised(docs, spark.sparkContext.broadcast(head), rules), "tokens")
    whole = tokens.filter("word is null")
    model = train(transitions(whole.filter("not held_out"), rules), rules)
    shared = spark.sparkContext.broadcast((model, share))
    base_unit = math.log10(total + distinct + 1)
    end_log = math.log10(ends + 1)

    def run(batches):
        net, cost = shared.value
        table = net.log10_table()
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for d, c in enumerate(batch.column("classes")):
                x = np.frombuffer(c.as_buffer(), "<u2").astype(np.int64)
                out[d] = table[np.append(rules.end, x), np.append(x, rules.end)].sum(dtype=np.float64) - cost[x].sum()
            keep = [batch.column(k) for k in range(7)]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(out)], ["row", "doc_id", "held_out", "n_tokens", "n_known", "known_log", "rare_log", "model"])

    scored = whole.select("row", "doc_id", "held_out", "n_tokens", "n_known", "known_log", "rare_log", "classes").mapInArrow(
        run, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, known_log double, rare_log double, model double")
    # words beyond the head: their counts by a join, their sums back to the document
    tail = tokens.filter("word is not null").select("row", "word", F.col("n").alias("times"))
    sums = tail.join(counts.select("word", "n"), "word").groupBy("row").agg(
        F.sum("times").alias("tail_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("tail_log"))
    tail_log = F.coalesce("tail_log", F.lit(0.0))
    has_end = 1 if ends else 0
    return scored.join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("tail_known", F.lit(0)) + has_end).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("known_log") + tail_log + end_log - F.col("n_tokens") * base_unit).alias("base_score"),
        (F.col("model") + F.col("rare_log") + tail_log).alias("score"))
