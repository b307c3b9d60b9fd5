"""Public vocabulary files: loaded in the worker from a path parameter, cached per process."""

from __future__ import annotations

import array
import base64
import os
import unicodedata
from functools import lru_cache

import numpy as np

from ebbflow.llm.common import SpanHash, word_spans


def public_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}

_MARKS = ".,;:!?)]}\"*#$%&|"
_IS_MARK, _IS_LETTER = np.zeros(256, bool), np.zeros(256, bool)
_IS_MARK[list(_MARKS.encode())] = True
_IS_LETTER[[*range(65, 91), *range(97, 123)]] = True


class WordIds:
    """Token ids of a text as little-endian unsigned 32-bit bytes, by whitespace-separated
    chunk.  The tokenizer drops white space and never joins tokens across it, so a text's
    ids are its chunks' ids in a row.  A chunk that is a run of letters and then ASCII marks
    is two pre-tokens, of which the first is lower-cased: its parts are units of their own, so
    ``Word``, ``word,`` and ``word.`` cost one encoding.  Caches are emptied when full."""

    def __init__(self, path: str, unit_entries: int = 300_000, part_entries: int = 150_000):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.units: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {"": b""}
        self.limits = unit_entries, part_entries  # about 200 bytes an entry

    def _split(self, chunk: bytes) -> tuple[str, str]:
        text = chunk.decode()
        head = text.rstrip(_MARKS)
        if head.isalpha() and "\u03a3" not in head and "\u0130" not in head and (
                head.isascii() or unicodedata.is_normalized("NFC", head)):
            return head.lower(), text[len(head):]
        return text, ""

    def _encode_singly(self, parts: list[str]) -> None:
        for k in range(0, len(parts), 4096):
            some = parts[k:k + 4096]
            for part, e in zip(some, self.tokenizer.encode_batch(some, add_special_tokens=False)):
                self.parts[part] = array.array("I", e.ids).tobytes()

    def _encode_runs(self, runs: list[str]) -> list[bytes]:
        """Ids of lower-case runs of letters, one pre-token each: encoded many in a row with blanks
        between, and the tokenizer tells which pre-token each id is of."""
        out: list[bytes] = []
        for k in range(0, len(runs), 512):
            some = runs[k:k + 512]
            e = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            word = np.array(e.word_ids, np.int64)
            if len(word) and int(word[-1]) + 1 == len(some):
                raw, off = np.array(e.ids, "<u4").tobytes(), (4 * np.searchsorted(word, np.arange(len(some) + 1))).tolist()
                out += [raw[a:b] for a, b in zip(off[:-1], off[1:])]
            else:                       # a run that the tokenizer cuts
                out += [array.array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch(some, add_special_tokens=False)]
        return out

    def _encode_parts(self, parts: list[str]) -> None:
        runs, others = [], []
        for p in parts:
            plain = p.isalpha() and (p.isascii() or unicodedata.is_normalized("NFC", p)) and p == p.lower()
            (runs if plain else others).append(p)
        self.parts.update(zip(runs, self._encode_runs(runs)))
        self._encode_singly(others)

    def _ids(self, units: list[bytes], plain: list[bool]) -> list[bytes]:
        """Ids of distinct units; a plain one is a lower-case run of ASCII letters."""
        if len(self.units) > self.limits[0]:
            self.units.clear()
        if len(self.parts) > self.limits[1]:
            self.parts = {"": b""}
        known = self.units
        new = [(u, p) for u, p in zip(units, plain) if u not in known]
        runs = [u for u, p in new if p]
        known.update(zip(runs, self._encode_runs([u.decode() for u in runs])))
        rest = [u for u, p in new if not p]
        if rest:
            pairs = [self._split(u) for u in rest]
            self._encode_parts(list({p for pair in pairs for p in pair if p not in self.parts}))
            known.update(zip(rest, [self.parts[x] + self.parts[y] for x, y in pairs]))
        return [known[u] for u in units]

    def _spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """Units of the words: (data with the plain units in lower case, starts, ends, plain, units of each word)."""
        place = np.arange(1, len(data) + 1)
        place[_IS_MARK[data]] = 0
        head = np.maximum(np.maximum.accumulate(place)[ends - 1], starts)
        letters = np.append(0, np.cumsum(_IS_LETTER[data]))
        plain = (letters[head] - letters[starts] == head - starts) & (head > starts)
        head = np.where(plain, head, ends)
        n = 1 + (head < ends)
        at = np.cumsum(n) - n
        unit_starts, unit_ends, unit_plain = np.empty(int(n.sum()), np.int64), np.empty(int(n.sum()), np.int64), np.zeros(int(n.sum()), bool)
        unit_starts[at], unit_ends[at], unit_plain[at] = starts, head, plain
        two = n == 2
        unit_starts[at[two] + 1], unit_ends[at[two] + 1] = head[two], ends[two]
        step = np.zeros(len(data) + 1, np.int8)
        step[starts[plain]] += 1
        step[head[plain]] -= 1
        lower = data + ((np.cumsum(step[:-1], dtype=np.int8) > 0) & (data >= 65) & (data <= 90)) * np.uint8(32)
        return lower, unit_starts, unit_ends, unit_plain, n

    def forget(self) -> None:
        """Give the caches back: a worker outlives its task and goes on to other stages."""
        self.units, self.parts = {}, {"": b""}

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts of a slice in a row, and where each text's begin.  Each distinct unit of
        the slice (by two 64-bit hashes) is looked up once."""
        starts, ends, first_word = word_spans(data, off)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        data, starts, ends, plain, n = self._spans(data, starts, ends)
        first_word = np.append(0, np.cumsum(n))[first_word]
        a, b = SpanHash(data, 5)(starts, ends), SpanHash(data, 6)(starts, ends)
        order = np.argsort(a)
        a, b, kind = a[order], b[order], plain[order]
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (kind[1:] != kind[:-1]))
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        pick, raw = order[new], data.tobytes()
        ids = self._ids([raw[x:y] for x, y in zip(starts[pick].tolist(), ends[pick].tolist())], plain[pick].tolist())
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, at = np.frombuffer(b"".join(ids), "<u4"), (np.cumsum(size) - size)[which]
        size = size[which]
        end = np.cumsum(size)
        out = flat[np.arange(int(end[-1])) + np.repeat(at - (end - size), size)]
        return out, np.append(0, end)[first_word]


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    return WordIds(path)
