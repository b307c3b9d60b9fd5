"""Language identification by error-correcting output codes over byte n-grams.

Each language has a codeword of +1 / -1 bits.  For every bit a binary n-gram classifier
(naive Bayes log ratios over hashed byte n-grams, the languages of a side weighted alike)
says on which side a text lies; the codeword with the least logistic loss over the bits'
margins wins.  The n-gram counts cover all labelled training texts: one map with a count
vector for each language and partition, summed in two rounds, so that what reaches the
driver is languages x buckets whatever the input.

Defined results: a null text or one without a letter is ``und`` with score 0; repeated
rows are judged one by one; other columns are ignored; without any labelled training
text every text is ``und``; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbflow.llm.common import text_slices

UNKNOWN = "und"


@dataclass(frozen=True)
class CodeRules:
    """Parameters of the model."""

    bucket_bits: int = 15      # n-gram buckets: 2 ** bits
    orders: tuple = (3, 4)     # byte n-gram lengths
    exhaustive_up_to: int = 6  # languages with the exhaustive code; more get a random dense one
    smoothing: float = 0.5
    clip: float = 4.0          # largest weight of an n-gram
    sharpness: float = 8.0     # scale of the mean margins in the loss
    ambiguous_below: float = 0.6
    slice_bytes: int = 1 << 19


@dataclass
class LanguageCode:
    languages: list = field(default_factory=list)
    code: np.ndarray | None = None     # languages x bits, +1 / -1
    weights: np.ndarray | None = None  # buckets x bits
    rules: CodeRules = field(default_factory=CodeRules)


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 32
_FOLD[65:91] += 32


def _buckets(data: np.ndarray, rules: CodeRules):
    """(order, bucket of the n-gram starting at each byte) for each order."""
    x = _FOLD[data].astype(np.uint32)
    shift = np.uint32(32 - rules.bucket_bits)
    for n in rules.orders:
        m = len(x) - n + 1
        if m <= 0:
            yield n, np.zeros(0, np.uint32)
            continue
        h = np.zeros(m, np.uint32)
        for k in range(n):
            h *= np.uint32(257)
            h += x[k:k + m]
        h *= np.uint32(2654435761)
        h ^= h >> np.uint32(15)
        h *= np.uint32(2246822519)
        yield n, h >> shift


def code_matrix(n: int, rules: CodeRules) -> np.ndarray:
    """Codewords of n languages: the exhaustive code for few, else random dense columns."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= rules.exhaustive_up_to:
        bits = np.arange(1, 2 ** (n - 1))
        first = np.ones((1, len(bits)), np.int8)
        rest = [np.where(bits >> k & 1, -1, 1) for k in range(n - 1)]
        return np.vstack([first, *rest]).astype(np.int8)
    rng = np.random.default_rng(20240607)
    cols, want = [], math.ceil(10 * math.log2(n))
    while len(cols) < want:
        c = rng.permutation(np.where(np.arange(n) < n // 2, 1, -1))
        cols.append(c * c[0])
    return np.array(cols, np.int8).T


def ngram_counts(labelled: DataFrame, rules: CodeRules) -> dict[str, np.ndarray]:
    """Bucket counts of each language over all rows of ``labelled`` (text, lang)."""
    size = 1 << rules.bucket_bits

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for i, j, data, off in text_slices(batch, "text"):
                grams = list(_buckets(data, rules))
                for d in range(j - i):
                    s = sums.setdefault(langs[i + d], np.zeros(size, np.int64))
                    for n, h in grams:
                        if off[d + 1] - off[d] >= n:
                            s += np.bincount(h[off[d]:off[d + 1] - n + 1], minlength=size)
        for lang, s in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang]), pa.array([s.tobytes()], pa.binary())], ["lang", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(size, np.int64)
        for c in table.column("counts"):
            total += np.frombuffer(c.as_py(), np.int64)
        return pa.table({"lang": table.column("lang").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    parts = labelled.select("text", "lang").mapInArrow(count, "lang string, counts binary")
    salted = parts.withColumn("salt", (F.spark_partition_id() / F.lit(256)).cast("int"))
    some = salted.groupBy("lang", "salt").applyInArrow(add, "lang string, counts binary")
    return {r.lang: np.frombuffer(r.counts, np.int64) for r in some.groupBy("lang").applyInArrow(add, "lang string, counts binary").collect()}


def fit(labelled: DataFrame, rules: CodeRules = CodeRules()) -> LanguageCode:
    """The code and the bit classifiers, from rows with ``text`` and ``lang`` (null ones are left out)."""
    counts = ngram_counts(labelled.filter("text is not null and lang is not null"), rules)
    languages = sorted(counts)
    if not languages:
        return LanguageCode(rules=rules)
    n = np.array([counts[x] for x in languages], np.float64) + rules.smoothing
    p = n / n.sum(axis=1, keepdims=True)
    code = code_matrix(len(languages), rules)
    weights = np.zeros((p.shape[1], code.shape[1]), np.float32)
    for b in range(code.shape[1]):
        one, other = code[:, b] > 0, code[:, b] < 0
        if one.any() and other.any():
            weights[:, b] = np.clip(np.log(p[one].mean(axis=0) / p[other].mean(axis=0)), -rules.clip, rules.clip)
    return LanguageCode(languages, code, weights, rules)


def decode(margins: np.ndarray, model: LanguageCode):
    """(best language index, score, second-best share) of each row of mean margins."""
    z = margins * model.rules.sharpness
    loss = np.zeros((len(z), len(model.languages)))
    for k, word in enumerate(model.code):
        weight = np.abs(z) / np.maximum(np.abs(z).sum(axis=1, keepdims=True), 1e-9)  # surer bits count for more
        loss[:, k] = (np.logaddexp(0, -z * word) * (0.5 / z.shape[1] + weight)).sum(axis=1)
    like = np.exp(-(loss - loss.min(axis=1, keepdims=True)) * 2)
    like /= like.sum(axis=1, keepdims=True)
    best = loss.argmin(axis=1)
    return best, like[np.arange(len(z)), best], loss


SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean"


def _predict(batch: pa.RecordBatch, model: LanguageCode):
    """(language, score, ambiguous) lists of a batch."""
    lang, score, unsure = [], [], []
    column = batch.column("text")
    for i, j, data, off in text_slices(batch, "text", model.rules.slice_bytes):
        texts = column.slice(i, j - i).to_pylist()
        known = [bool(t) and bool(model.languages) and any(map(str.isalpha, t)) for t in texts]
        if not any(known):
            lang += [UNKNOWN] * (j - i)
            score += [0.0] * (j - i)
            unsure += [False] * (j - i)
            continue
        total = np.zeros((j - i, model.code.shape[1]))
        count = np.zeros(j - i)
        for n, h in _buckets(data, model.rules):
            sums = np.zeros((len(h) + 1, total.shape[1]))
            np.cumsum(model.weights[h], axis=0, out=sums[1:])
            a = np.minimum(off[:-1], len(h))
            e = np.maximum(a, np.minimum(off[1:] - n + 1, len(h)))
            total += sums[e] - sums[a]
            count += e - a
        best, share, _ = decode(total / np.maximum(count, 1)[:, None], model)
        for d in range(j - i):
            lang.append(model.languages[best[d]] if known[d] else UNKNOWN)
            score.append(float(share[d]) if known[d] else 0.0)
            unsure.append(bool(known[d] and share[d] < model.rules.ambiguous_below))
    return lang, score, unsure


def predict(docs: DataFrame, model: LanguageCode, held_out) -> DataFrame:
    """One row per document; ``held_out`` is a boolean column expression over ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x bits, a fixed size

    def run(batches):
        m = shared.value
        for batch in batches:
            lang, score, unsure = _predict(batch, m)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()),
                 pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())],
                [f.split()[0] for f in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), held_out.alias("held_out"), "text").mapInArrow(run, SCHEMA)


def keep_identified(docs: DataFrame, model: LanguageCode) -> DataFrame:
    """``docs`` without the rows that language ID rejects: texts without a language (null, or
    without a letter) and ambiguous ones, whose prediction scores below ``ambiguous_below``.  Where
    no language was learned, texts with a letter stay."""

    def run(batches):
        for batch in batches:
            if not shared.value.languages:
                yield batch.filter(pa.array([bool(t) and any(map(str.isalpha, t)) for t in batch.column("text").to_pylist()], pa.bool_()))
                continue
            lang, _, unsure = _predict(batch, shared.value)
            yield batch.filter(pa.array([x != UNKNOWN and not u for x, u in zip(lang, unsure)], pa.bool_()))

    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(run, docs.schema)
