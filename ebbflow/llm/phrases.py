"""Phrase collocations by top-order marginalisation.

Every word occurrence opens one window of up to ``longest`` words of its piece; a window that
the piece's end cuts short is padded.  Only these longest windows are counted, and a ROLLUP
over their lead columns sums them to the counts of every shorter prefix, which are the counts
of all phrases (an occurrence of a phrase is the prefix of exactly one window).  The ROLLUP's
level of the language alone is the number of words.

Passes before it count hashes of words and word pairs, then of triples of frequent pairs.  A
phrase of ``least`` occurrences holds no part with fewer, so a window ends where one begins; the
sums that can matter stay exact.  The parts that reach ``least`` are known to the tasks by a
bitmap of at most ``2 ** bitmap_bits`` bits: where it is too small for a corpus, windows are cut
less often and results stay the same.

Words are 64-bit ids of (language, word); the dictionary of frequent words shows whether two
of them share an id, and then all is done again with another seed.

Defined results: a null text is empty, a null language is ``und`` (one with the literal);
repeated rows count each time, other columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbflow.llm.common import U64, SpanHash, mix64, shuffle_parts, stored, text_slices

_PIECE_END = np.zeros(256, bool)
_PIECE_END[[ord(c) for c in ".,;:!?"] + list(range(0x0A, 0x0E))] = True
_WORD_END = _PIECE_END.copy()
_WORD_END[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass(frozen=True)
class PhraseRules:
    least: int = 30             # occurrences of a candidate
    longest: int = 4            # words of a candidate
    scale: int = 2_000_000
    cover_percent: int = 80     # a longer phrase this frequent replaces the candidates inside it
    top: int = 2000             # phrases reported for each language
    bitmap_bits: int = 27       # largest bitmap (2 ** 27 bits are 16 MB)


class Words:
    """Ids of the words of a slice, and whether the next word stands in the same piece."""

    def __init__(self, data: np.ndarray, off: np.ndarray, lang: np.ndarray, seed: int):
        self.data = data = _LOWER[data]
        ink = ~_WORD_END[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[off] = True
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:], after[:-1] = ink[:-1], ink[1:]
        self.starts = np.flatnonzero(ink & (~before | edge[:-1]))
        self.ends = np.flatnonzero(ink & (~after | edge[1:])) + 1
        self.doc = np.searchsorted(off, self.starts, "right") - 1
        self.id = mix64(SpanHash(data, seed)(self.starts, self.ends) ^ lang[self.doc])
        self.id = np.maximum(self.id & ~U64(1), U64(2))     # even: a word, odd: a longer phrase, 0: a pad
        piece = np.cumsum(_PIECE_END[data])[self.starts] if len(data) else np.zeros(0, np.int64)
        self.joined = np.zeros(len(self.id), bool)
        self.joined[:-1] = (piece[1:] == piece[:-1]) & (self.doc[1:] == self.doc[:-1])

    def parts(self, sizes: int, bitmap: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each size up to ``sizes``: the hash of the words from each place on, and whether they
        stand in one piece and all their shorter parts are in the bitmap."""
        n = len(self.id)
        out = [(self.id, np.ones(n, bool))]
        for m in range(1, sizes):
            gram, open_ = out[-1]
            known = open_ if bitmap is None else open_ & _has(bitmap, gram)
            longer, goes = np.zeros(n, U64), np.zeros(n, bool)
            if n > m:
                longer[:n - m] = mix64(gram[:n - m] * U64(0xD6E8FEB86659FD93) + self.id[m:]) | U64(1)
                goes[:n - 1] = known[:-1] & known[1:]
                goes &= self.joined
            out.append((longer, goes))
        return out

    def text(self, at: np.ndarray) -> list[str]:
        raw = self.data.tobytes()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(self.starts[at], self.ends[at])]


def _languages(column: pa.Array, seed: int) -> tuple[list[str], np.ndarray]:
    names = [x if x is not None else "und" for x in column.to_pylist()]
    known = {x: int.from_bytes(_digest(x, seed), "little") for x in set(names)}
    return names, np.array([known[x] for x in names], U64)


def _digest(text: str, seed: int) -> bytes:
    return blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8, salt=seed.to_bytes(8, "little")).digest()


def _slices(batches, seed: int):
    for batch in batches:
        names, lang = _languages(batch.column("lang"), seed)
        for i, j, data, off in text_slices(batch, "text"):
            yield names[i:j], Words(data, off, lang[i:j], seed)


class Counted:
    """Equal columns of a task counted together, over many slices and in bounded memory."""

    def __init__(self, height: int, limit: int = 1 << 20):
        self.limit = limit
        self.table, self.n = np.zeros((height, 0), U64), np.zeros(0, np.int64)

    def _merged(self, table: np.ndarray, n: np.ndarray):
        order = np.argsort(table[0]) if len(table) == 1 else np.lexsort(table[::-1])
        table = table[:, order]
        first = np.flatnonzero(np.append(True, (table[:, 1:] != table[:, :-1]).any(axis=0))[:table.shape[1]])
        return table[:, first], np.add.reduceat(n[order], first) if len(first) else n[:0]

    def add(self, table: np.ndarray):
        """Count the columns of ``table``; yields what is given away, where it gets too much."""
        own, n = self._merged(table, np.ones(table.shape[1], np.int64))
        self.table, self.n = np.concatenate([self.table, own], axis=1), np.concatenate([self.n, n])
        if len(self.n) > 2 * self.limit:
            self.table, self.n = self._merged(self.table, self.n)
            if 2 * len(self.n) > 3 * self.limit:
                yield from self.rest()

    def rest(self):
        if len(self.n):
            table, n = self._merged(self.table, self.n)
            self.table, self.n = table[:, :0], n[:0]
            for k in range(0, len(n), 1 << 17):
                yield table[:, k:k + (1 << 17)], n[k:k + (1 << 17)]


def _frequent(docs: DataFrame, sizes: range, bitmap, rules: PhraseRules, seed: int) -> DataFrame:
    """Hashes of the phrases of these sizes with ``least`` occurrences or more."""

    def run(batches):
        held = Counted(1)
        for _, w in _slices(batches, seed):
            parts = w.parts(sizes[-1], bitmap and bitmap.value)[sizes[0] - 1:]
            for gram, n in held.add(np.concatenate([g[goes] for g, goes in parts])[None]):
                yield pa.RecordBatch.from_arrays([pa.array(gram[0].view(np.int64)), pa.array(n)], ["gram", "n"])
        for gram, n in held.rest():
            yield pa.RecordBatch.from_arrays([pa.array(gram[0].view(np.int64)), pa.array(n)], ["gram", "n"])

    counted = docs.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= rules.least)


def _bitmap(frequent: DataFrame, rules: PhraseRules) -> np.ndarray:
    """The hashes as bits: collected as distinct bytes of a bitmap whose size is bounded."""
    bits = min(rules.bitmap_bits, max(16, int(frequent.count() * 32).bit_length()))
    place = F.shiftrightunsigned("gram", 64 - bits)
    bytes_ = frequent.select(place.alias("bit")).groupBy(F.shiftright("bit", 15).alias("page")).agg(
        F.collect_set((F.col("bit") % 32768).cast("int")).alias("bits"))

    def run(batches):                       # a page of 4 KB for each 32,768 bits
        for batch in batches:
            pages = []
            for own in batch.column("bits"):
                flags = np.zeros(32768, np.uint8)
                flags[own.values.to_numpy()] = 1
                pages.append(np.packbits(flags).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("page"), pa.array(pages, pa.binary())], ["page", "raw"])

    out = np.zeros(max(1, (1 << bits) >> 15) * 4096, np.uint8)
    for row in bytes_.mapInArrow(run, "page long, raw binary").toLocalIterator():
        out[row.page * 4096:(row.page + 1) * 4096] = np.frombuffer(row.raw, np.uint8)
    return out


def _has(bitmap: np.ndarray, gram: np.ndarray) -> np.ndarray:
    bits = (len(bitmap) * 8).bit_length() - 1
    place = (gram >> U64(64 - bits)).astype(np.int64)
    return (bitmap[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1).astype(bool)


def _windows(docs: DataFrame, bitmap, rules: PhraseRules, seed: int) -> DataFrame:
    """Counted longest windows (lang, w1.., n), and a row (lang, w1, word) for each frequent word of a task."""
    columns = [f"w{k + 1}" for k in range(rules.longest)]

    def batch_of(langs, table, count, words=None):
        own = [pa.array(langs, pa.string()), *(pa.array(t.view(np.int64)) for t in table), pa.array(count.astype(np.int64))]
        return pa.RecordBatch.from_arrays([*own, pa.array(words, pa.string()) if words else pa.nulls(len(count), pa.string())],
                                          ["lang", *columns, "n", "word"])

    def run(batches):
        flags, seen, tongue = bitmap.value, np.zeros(0, U64), {}
        held, alone = Counted(1 + rules.longest, 1 << 19), Counter()

        def windows(found):
            for table, n in found:
                yield batch_of([names_of[x] for x in table[0].tolist()], table[1:], n)

        names_of: list[str] = []
        for names, w in _slices(batches, seed):
            for name in names:
                if name not in tongue:
                    tongue[name] = len(names_of)
                    names_of.append(name)
            lang = np.array([tongue[x] for x in names], U64)
            *parts, (_, last) = w.parts(rules.longest, flags)
            parts = [(goes & _has(flags, gram)) for gram, goes in parts] + [last]
            alive = parts[0]
            # rare words count for their language alone
            for name, count in zip(names, np.bincount(w.doc[~alive], minlength=len(names)).tolist()):
                alone[name] += count
            open_ = np.flatnonzero(alive)
            table = np.zeros((1 + rules.longest, len(open_)), U64)
            table[0] = lang[w.doc[open_]]
            for k in range(rules.longest):
                goes = parts[k][open_]      # the first k + 1 words may be frequent
                table[k + 1, goes] = w.id[open_[goes] + k]
            yield from windows(held.add(table))
            ids, at = np.unique(w.id[alive], return_index=True)
            fresh = ~np.isin(ids, seen)
            ids, at = ids[fresh], np.flatnonzero(alive)[at[fresh]]
            seen = np.union1d(seen, ids)
            if len(ids):
                table = np.zeros((rules.longest, len(ids)), U64)
                table[0] = ids
                yield batch_of([names[d] for d in w.doc[at]], table, np.zeros(len(ids)), w.text(at))
        yield from windows(held.rest())
        if alone:
            yield batch_of(list(alone), np.zeros((rules.longest, len(alone)), U64), np.array(list(alone.values())))

    return docs.mapInArrow(run, "lang string, " + ", ".join(f"{c} long" for c in columns) + ", n long, word string")


def counted(docs: DataFrame, rules: PhraseRules) -> tuple[DataFrame, DataFrame]:
    """(lang, gram, f) of every phrase of 1 to ``longest`` words with ``least`` occurrences and, with an
    empty gram, of all words; and (id, word) of the frequent words."""
    spark = docs.sparkSession
    docs = docs.select("text", F.col("lang").cast("string").alias("lang"))
    for seed in range(1, 9):
        frequent = stored(_frequent(docs, range(1, 3), None, rules, seed), "frequent-grams")
        bitmap = spark.sparkContext.broadcast(_bitmap(frequent, rules))
        for size in range(3, rules.longest):
            frequent = frequent.union(stored(_frequent(docs, range(size, size + 1), bitmap, rules, seed), "frequent-grams"))
            bitmap = spark.sparkContext.broadcast(_bitmap(frequent, rules))
        rows = stored(_windows(docs, bitmap, rules, seed), "windows")
        words = rows.filter("word IS NOT NULL").groupBy(F.col("w1").alias("id")).agg(
            F.min(F.struct("lang", "word")).alias("one"), F.max(F.struct("lang", "word")).alias("other"))
        words = stored(words.select("id", "one.word", (F.col("one") != F.col("other")).alias("clash")), "words")
        if words.filter("clash").isEmpty():
            break
    else:
        raise RuntimeError("words share ids under every seed")
    columns = [f"w{k + 1}" for k in range(rules.longest)]
    sums = rows.filter("word IS NULL").rollup("lang", *columns).agg(F.sum("n").alias("f"), F.grouping_id().alias("gid"))
    # a row of level m has its last m columns rolled up; the word before them must be a word, not a pad
    ends = F.coalesce(*columns[::-1])
    whole = F.col("gid") == (1 << rules.longest) - 1
    part = (F.col("gid") < (1 << rules.longest) - 1) & (ends != 0) & (F.col("f") >= rules.least)
    gram = F.filter(F.array(*columns), lambda x: x.isNotNull())
    grams = sums.filter(whole | part).select("lang", gram.alias("gram"), "f")
    return stored(grams, "phrases"), words.select("id", "word")


def candidates(grams: DataFrame, rules: PhraseRules) -> DataFrame:
    """lang, gram, a, l, r, score of the phrases of two words or more that no longer phrase covers."""
    phrases = grams.filter(F.size("gram") >= 2).select("lang", "gram", F.col("f").alias("a"))
    counts = grams.filter(F.size("gram") >= 1)
    cut = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("gram") - 1))).select(
        "lang", "gram", "a", "k", F.expr("slice(gram, 1, k)").alias("first"), F.expr("slice(gram, k + 1, size(gram) - k)").alias("rest"))
    cut = cut.join(counts.select(F.col("gram").alias("first"), F.col("f").alias("l")), "first")
    cut = cut.join(counts.select(F.col("gram").alias("rest"), F.col("f").alias("r")), "rest")
    exact = f"(CAST({rules.scale} AS DECIMAL(8,0)) * CAST(a AS DECIMAL(19,0))) div (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))"
    cut = cut.withColumn("score", F.expr(exact).cast("long"))
    scored = cut.groupBy("lang", "gram", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = phrases.filter(F.size("gram") >= 3).withColumn("m", F.explode(F.expr("sequence(2, size(gram) - 1)")))
    inner = inner.withColumn("at", F.explode(F.expr("sequence(1, size(gram) - m + 1)")))
    longer = inner.groupBy(F.expr("slice(gram, at, m)").alias("gram")).agg(F.max("a").alias("longer"))
    both = scored.join(longer, "gram", "left")
    share = F.col("longer").cast("decimal(19,0)") * 100 >= F.col("a").cast("decimal(19,0)") * rules.cover_percent
    both = both.filter(~F.coalesce(share, F.lit(False)))
    return both.select("lang", "gram", "a", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, rules: PhraseRules = PhraseRules()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language."""
    grams, words = counted(docs, rules)
    found = stored(candidates(grams, rules), "candidates")
    spelled = found.select("gram", F.posexplode("gram").alias("at", "id")).join(words, "id").groupBy("gram").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    rows = found.join(spelled, "gram").withColumn("salt", F.pmod(F.xxhash64("gram"), F.lit(shuffle_parts(docs.sparkSession))))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    first = F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))   # a language is never sorted in one task
    rows = rows.withColumn("place", first).filter(F.col("place") <= rules.top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= rules.top)
    total = grams.filter(F.size("gram") == 0).select("lang", F.col("f").alias("n"))
    return rows.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
