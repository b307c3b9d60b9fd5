"""Secret scan: fixed patterns, and a password guess-cost search over values that
stand in a credential context.

The guess cost of a value is the least log10 number of guesses over all ways to cut
it into dictionary words, dates, repeats, keyboard walks or counting runs, and
brute-force spans (dynamic programming over cut points); the dictionary is the common
credential words and then the words of the public vocabularies, by rank.  A value whose cost
reaches ``min_cost`` is reported as kind ``guess`` unless a fixed pattern already covers it.
A quoted value goes up to its closing quote (not past an empty line); one without quotes ends
at white space, a quote or one of ``<>,;|``.

Defined results: a null or empty text has no spans and the digest of the empty
string; repeated rows are scanned one by one; other columns are ignored; an empty
table gives an empty result.  Whole texts are scanned; offsets are code points.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbflow.llm.vocab import public_path, ranks

ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "guess")

#: words that announce a credential; a value follows after ``:``, ``=``, ``=>`` or "is"
CONTEXT_WORDS = ("passphrase", "passcode", "password", "passwd", "pwd", "credential", "secret", "token", "auth",
                 "api key", "api-key", "api_key", "apikey", "access key", "access_key", "private key", "private_key",
                 "client_key", "login key", "bearer")
_SPACE = r"[\s\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_QUOTED = "|".join(rf"{q}((?:[^{q}\\\n]|\\[^\n]|\\?\n(?![ \t\r]*\n))++){q}" for q in "\"'`")
#: the value is the one group that took part: between double, single or back quotes, or bare
CONTEXT = re.compile(
    r"(?i:" + "|".join(map(re.escape, sorted(CONTEXT_WORDS, key=len, reverse=True))) + r")s?[\"'`]?"
    rf"(?:{_SPACE}*+(?:=>|:=|[:=]){_SPACE}*+|{_SPACE}++(?i:is){_SPACE}++|(?<=[Bb][Ee][Aa][Rr][Ee][Rr]){_SPACE}++)"
    rf"(?:{_QUOTED}|[\"'`]?([^\s\"'`<>,;|]+))", re.ASCII)

COMMON_WORDS = (
    "password pass word admin user root guest login welcome hello letmein master secret token key test demo example "
    "sample default change changeme please enter your the and for with that this from have not are was love dragon "
    "monkey shadow sunshine princess football baseball superman batman iloveyou trust access system server public "
    "private none null true false string value name email here required must should never always expired invalid "
    "reset forgot summer winter spring autumn january february march april june july august september october "
    "november december monday tuesday wednesday thursday friday saturday sunday"
).split()
KEY_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz", "qwertzuiop", "azertyuiop")


@dataclass(frozen=True)
class GuessRules:
    """Parameters of the guess-cost search."""

    min_cost: float = 12.0  # log10 guesses from which a value counts as a secret
    min_length: int = 8
    max_part: int = 32      # longest dictionary, date, repeat or walk segment; brute-force spans have no bound


def _public_words() -> list[str]:
    """Whole words of three letters or more of the public vocabularies, commonest first."""
    found = [(k, t.decode("utf-8", "ignore")[1:]) for t, k in ranks(public_path("byte_bpe_multi_50k.tiktoken")).items() if t[:1] == b" "]
    for name, mark in (("byte_bpe_50k.json", "\u0120"), ("word_bpe_49k.json", "</w>")):
        with open(public_path(name), encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        found += [(k, t.replace(mark, "")) for t, k in vocab.items() if mark in t and t.isascii() or t[:1] == mark]
    return [w.lower() for _, w in sorted(found) if len(w) >= 3 and w.isalpha()]


_RANK = {w: math.log10(i + 2) for i, w in enumerate(dict.fromkeys(COMMON_WORDS + _public_words()))}
_LONGEST = max(map(len, _RANK))
_LEET = str.maketrans("@4310$57", "aaeiosst")
_DATE = re.compile(
    r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])(?:[-/._]?(?:0[1-9]|[12]\d|3[01]))?)?"
    r"|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d")
_NEXT = {(a, b) for row in KEY_ROWS for r in (row, row[::-1]) for a, b in zip(r, r[1:])}


def _pool(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


_POOL_BITS = [math.log10(sum(n for k, n in enumerate((10, 26, 26, 33)) if m >> k & 1) or 1) for m in range(16)]


def guess_cost(value: str, max_part: int = GuessRules.max_part) -> float:
    """Least log10 guesses over the segmentations of ``value``."""
    n = len(value)
    low = value.lower()
    plain = low.translate(_LEET)
    pools = 0
    for c in set(value) - {" "}:
        pools |= 1 << _pool(c)
    per_char = _POOL_BITS[pools]
    best = [0.0] + [math.inf] * n
    for i in range(n):
        cut = best[i] + (0.3 if i else 0.0)  # each further segment costs a factor of two
        # brute-force spans extend by a character at a time, so one step is enough
        step = best[i] + per_char
        if step < best[i + 1]:
            best[i + 1] = step
        if value[i] == " " and cut < best[i + 1]:
            best[i + 1] = cut               # a space between words is no guess of its own
        for j in range(i + 3, min(n, i + _LONGEST) + 1):
            cost = _RANK.get(low[i:j])
            if cost is None and (cost := _RANK.get(plain[i:j])) is not None:
                cost += 0.5
            if cost is not None and cut + cost + 0.3 < best[j]:
                best[j] = cut + cost + 0.3  # capitals and the like: a factor of two
        m = _DATE.match(value, i)
        if m and cut + 4.6 < best[m.end()]:
            best[m.end()] = cut + 4.6       # days of 110 years
        end = min(n, i + max_part)
        j = i + 1                           # walks and counting runs
        while j < end and (low[j - 1], low[j]) in _NEXT:
            j += 1
            if j - i >= 3 and cut + 2.2 + math.log10(j - i) < best[j]:
                best[j] = cut + 2.2 + math.log10(j - i)
        for unit in (1, 2, 3, 4):           # repeats of a short unit
            j = i + unit
            while j < end and value[j] == value[j - unit]:
                j += 1
                if j - i >= 2 * unit and j - i >= 3 and (c := cut + unit * per_char + math.log10(j - i)) < best[j]:
                    best[j] = c
    return best[n]


def scan(text: str, rules: GuessRules = GuessRules()) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of every secret, in order."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if any(w in low for w in CONTEXT_WORDS):
        base = list(found)
        for m in CONTEXT.finditer(text):
            k = m.lastindex
            value = m[k].rstrip(".!?)]}") if k == 4 else m[k]
            s, e = m.start(k), m.start(k) + len(value)
            if len(value) < rules.min_length or any(a <= s and e <= b for a, _, b in base):
                continue
            if guess_cost(value, rules.max_part) >= rules.min_cost:
                found.append((s, 3, e))
    found.sort()
    return found


def _join(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long"


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column("text").to_pylist()]


def secret_spans(docs: DataFrame, rules: GuessRules = GuessRules()) -> DataFrame:
    """Counts, digest and spans of each document's secrets."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batches):
        for big in batches:
            for k in range(0, big.num_rows, 512):
                batch = big.slice(k, 512)
                rows = [scan(t, rules) for t in _texts(batch)]
                n = [[sum(x[1] == kind for x in r) for r in rows] for kind in range(4)]
                base = [hashlib.sha256(_join(x for x in r if x[1] < 3).encode()).hexdigest() for r in rows]
                ints = [pa.array(x, pa.int64()) for x in n]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), *ints[:3], pa.array(base, pa.string()),
                     pa.array([_join(r) for r in rows], pa.string()), ints[3]], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def redact(text: str, spans, mark: str = "[secret]") -> str:
    """``text`` with every run of overlapping spans replaced by ``mark``."""
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:]


def redact_secrets(docs: DataFrame, rules: GuessRules = GuessRules()) -> DataFrame:
    """``docs`` with the secrets in ``text`` replaced; all rows and columns stay (``n_chars``,
    if there, counts the new text).  A null text stays null."""

    def run(batches):
        for big in batches:
            at = big.schema.get_field_index("text")
            for k in range(0, big.num_rows, 512):
                batch = big.slice(k, 512)
                old = batch.column(at).to_pylist()
                new = [t if not t or not (s := scan(t, rules)) else redact(t, s) for t in old]
                cols = [pa.array(new, big.schema.field(at).type) if c == at else batch.column(c)
                        for c in range(batch.num_columns)]
                yield pa.RecordBatch.from_arrays(cols, schema=big.schema)

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.char_length("text").cast(kind)))
    return out.select(docs.columns)
