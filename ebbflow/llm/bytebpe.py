"""Byte-level BPE with a public rank file, in length-bucketed padded numpy matrices.

Texts are split by the public pattern; each distinct match is encoded once per cache
life.  Matches of like length form the rows of a padded matrix of token ids.  In every
round each row finds its least pair rank (a hashed pair table), merges the leftmost pair
of that rank and closes the gap; rows without a mergeable pair leave the matrix.  Where
no merge can bring up a pair of lower rank, the further pairs of the same rank that do
not overlap are merged in the same round, which gives the same ids in fewer rounds.

Defined results: a null or empty text has no tokens (digests of the empty string);
repeated rows are encoded one by one; other columns are ignored; an empty table gives an
empty result.  Whole texts are encoded, also single matches of any length.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbflow.llm.common import U64
from ebbflow.llm.vocab import ranks

NONE = np.int64(1) << 40  # rank of a pair that does not merge


class PairTable:
    """Open-addressing hash table (left id, right id) -> merged id."""

    def __init__(self, vocab: dict[bytes, int]):
        pairs: dict[int, int] = {}
        for token, rank in vocab.items():
            for k in range(1, len(token)):
                a, b = vocab.get(token[:k]), vocab.get(token[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        keys = np.array(list(pairs), np.int64)
        values = np.array(list(pairs.values()), np.int64)
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.mask = (1 << self.bits) - 1
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int64)
        todo = np.arange(len(keys))
        slot = self._slot(keys)
        while len(todo):                       # all at once: the first to a free slot wins, others move on
            free = self.keys[slot[todo]] < 0
            self.keys[slot[todo[free]]] = keys[todo[free]]
            placed = self.keys[slot[todo]] == keys[todo]
            self.values[slot[todo[placed]]] = values[todo[placed]]
            todo = todo[~placed]
            slot[todo] = (slot[todo] + 1) & self.mask
        # the least rank of any pair in which a token takes part: a merge into it cannot bring up less
        low = np.full(max(vocab.values()) + 1, NONE, np.int64)
        np.minimum.at(low, keys >> 32, values)
        np.minimum.at(low, keys & 0xFFFFFFFF, values)
        self.steady = low > np.arange(len(low))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        h = keys.astype(U64) * U64(0x9E3779B97F4A7C15)
        return (h >> U64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        slot = self._slot(keys.ravel())
        flat, out = keys.ravel(), np.full(keys.size, NONE, np.int64)
        todo = np.arange(keys.size)
        while len(todo):
            found = self.keys[slot[todo]]
            hit = found == flat[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
            slot[todo] = (slot[todo] + 1) & self.mask
        return out.reshape(keys.shape)


class ByteBPE:
    def __init__(self, vocab: dict[bytes, int], pattern: str, cache_entries: int = 400_000):
        import regex
        self.vocab = vocab
        self.split = regex.compile(pattern).findall
        self.pairs = PairTable(vocab)
        self.single = np.array([vocab[bytes([b])] for b in range(256)], np.int64)
        self.token = {i: t for t, i in vocab.items()}
        self.cache: dict[str, str] = {}
        self.limit = cache_entries

    def _merge(self, m: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
        """Merged rows of a padded matrix (-1 beyond each row's length)."""
        done: list = [None] * len(m)
        row = np.arange(len(m))
        while len(m):
            width = m.shape[1]
            if width > 1:
                rank = np.where(np.arange(1, width) < n[:, None], self.pairs(np.maximum(m[:, :-1], 0), np.maximum(m[:, 1:], 0)), NONE)
                least = rank.min(axis=1)
            else:
                least = np.full(len(m), NONE)
            ended = least == NONE
            for r in np.flatnonzero(ended):
                done[row[r]] = m[r, :n[r]]
            if ended.all():
                break
            keep = ~ended
            m, n, row, rank, least = m[keep], n[keep], row[keep], rank[keep], least[keep]
            at = rank == least[:, None]
            # positions since the last break in each run of candidates; every second one merges
            pos = np.arange(width - 1)
            since = pos - np.maximum.accumulate(np.where(at, -1, pos), axis=1)
            at &= (since & 1) == 1
            first = np.zeros_like(at)
            first[np.arange(len(m)), at.argmax(axis=1)] = True
            at = np.where(self.pairs.steady[least][:, None], at, first)
            # write the merged ids, drop the right halves, close the gaps
            m[:, :-1][at] = np.broadcast_to(least[:, None], at.shape)[at]
            stay = np.arange(width) < n[:, None]
            stay[:, 1:] &= ~at
            n = stay.sum(axis=1)
            out = np.full((len(m), int(n.max())), -1, np.int64)
            out[np.arange(out.shape[1]) < n[:, None]] = m[stay]
            m = out
        return done

    def _encode_new(self, words: list[str]) -> None:
        by_size: dict[int, list] = {}
        for w in words:
            b = w.encode()
            whole = self.vocab.get(b)
            if whole is not None:
                self.cache[w] = str(whole)
            else:
                by_size.setdefault(max(3, (len(b) - 1).bit_length()), []).append((w, b))
        for bits, group in by_size.items():
            rows = max(1, (1 << 18) >> bits)  # a quarter million cells at a time
            for k in range(0, len(group), rows):
                part = group[k:k + rows]
                n = np.array([len(b) for _, b in part])
                m = np.full((len(part), int(n.max())), -1, np.int64)
                m[np.arange(m.shape[1]) < n[:, None]] = self.single[np.frombuffer(b"".join(b for _, b in part), np.uint8)]
                for (w, _), ids in zip(part, self._merge(m, n)):
                    self.cache[w] = ",".join(map(str, ids.tolist()))

    def encode(self, texts: list[str]) -> list[str]:
        """Decimal ids of each text, comma-joined."""
        words = [self.split(t) for t in texts]
        if len(self.cache) > self.limit:
            self.cache.clear()
        new = set().union(*words).difference(self.cache) if words else ()
        if new:
            self._encode_new(list(new))
        cache = self.cache
        return [",".join([cache[w] for w in ws]) for ws in words]

    def decode(self, ids: list[int]) -> bytes:
        token = self.token
        return b"".join([token[i] for i in ids])


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> ByteBPE:
    return ByteBPE(ranks(path), pattern)


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Token count and digests of every text; ``with_ids`` adds the ids and the decoded text."""
    schema = SCHEMA + (", ids array<int>, decoded string" if with_ids else "")

    def run(batches):
        bpe = codec(path, pattern)
        for big in batches:
            for k in range(0, big.num_rows, 256):
                batch = big.slice(k, 256)
                joined = bpe.encode([t or "" for t in batch.column("text").to_pylist()])
                ids = [list(map(int, x.split(","))) if x else [] for x in joined]
                back = [bpe.decode(x) for x in ids]
                cols = [
                    batch.column("doc_id"), pa.array(map(len, ids), pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in joined]),
                    pa.array([hashlib.sha256(x).hexdigest() for x in back])]
                if with_ids:
                    cols += [pa.array(ids, pa.list_(pa.int32())), pa.array([b.decode() for b in back])]
                yield pa.RecordBatch.from_arrays(cols, [f.split()[0] for f in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
