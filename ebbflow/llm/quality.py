"""Line-first quality rules.

Every line is judged by three rules (punctuation, navigation, boilerplate); the
lines that fail are removed, and a document that loses too much text with them is
rejected.  Corpus-free: one map over the documents, no shuffle.

Defined results: a null or empty text has no words, no lines and fails the base
rule; repeated rows are judged one by one; other columns of the input are ignored;
an empty table gives an empty result.  Texts are judged whole, whatever their length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbflow.llm.common import SpanHash, group_sum, mix64, ngram_hash, owners, text_slices, word_spans, U64

SYMBOLS = b"#*$%&|<>"
TERMINAL = b".!?:;)\"'"
#: last bytes of the multi-byte closers: ellipsis, right quotes, guillemet, ideographic full stop
TERMINAL_WIDE = tuple(c.encode() for c in "…”’»。！？")
SEPARATORS = b"|>/\\~"
PHRASES = (
    b"all rights reserved", b"licensed under", b"released under", b"this work is licensed", b"terms of use",
    b"terms of service", b"privacy policy", b"cookie policy", b"uses cookies", b"enable javascript", b"click here",
    b"sign up", b"sign in", b"log in", b"subscribe to", b"share this", b"read more", b"lorem ipsum", b"powered by",
    b"skip to content",
)


@dataclass(frozen=True)
class LineRules:
    """Parameters of the line rules."""

    max_marks_per_word: float = 0.75  # punctuation marks and symbols a word
    marks_from_words: int = 5         # shorter lines are not judged by the marks rule
    words_per_stop: int = 40          # prose has a stop or comma at least once in so many words
    open_words: int = 15              # an unfinished line of so many words passes if its stops are those of prose
    max_stutter: float = 0.5          # share of words equal to the one before, in lines judged by the marks rule
    min_separators: int = 2           # free-standing separators that make a navigation line
    boilerplate_words: int = 25       # a phrase condemns a line of at most so many words
    max_loss: float = 0.5             # share of the words a kept document may lose
    min_words: int = 20
    max_repeat: int = 30              # percent of words in repeated 8-word windows


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MARK = np.zeros(256, bool)
_MARK[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_STOP = np.isin(np.arange(256), list(b".,!?;:"))
_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_ENDS = np.isin(np.arange(256), list(TERMINAL))
_SEP = np.isin(np.arange(256), list(SEPARATORS))

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_lines long, n_lines_removed long, n_words_kept long"
)


def _lines(data: np.ndarray, off: np.ndarray):
    """Starts and ends of the \\n-split lines and their offsets by document (a document has one line at least)."""
    cuts = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([off[:-1], cuts + 1]), kind="stable")
    ends = np.sort(np.concatenate([off[1:], cuts]), kind="stable")
    n_doc = np.searchsorted(cuts, off[1:]) - np.searchsorted(cuts, off[:-1]) + 1
    return starts, ends, np.concatenate([[0], np.cumsum(n_doc)])


def judge(data: np.ndarray, off: np.ndarray, rules: LineRules):
    """Counts, verdicts and the per-line removal mask for one slice of texts."""
    n = len(off) - 1
    ws, we, woff = word_spans(data, off)
    ink = np.zeros(len(data) + 1, np.int8)
    ink[ws] += 1
    np.subtract.at(ink, we, 1)
    in_word = np.cumsum(ink[:-1], dtype=np.int8).astype(bool) if len(data) else np.zeros(0, bool)
    # word spans may touch across documents: the +1 and -1 cancel there, which is what is wanted
    lead = (data & 0xC0) != 0x80
    n_words = np.diff(woff)
    word_chars = group_sum(in_word & lead, off)
    n_symbols = group_sum(_SYMBOL[data], off)
    spans = SpanHash(data)

    ls, le, loff = _lines(data, off)
    l_doc = owners(loff)
    l_woff = np.searchsorted(ws, np.concatenate([ls, [len(data)]]))
    l_words = np.searchsorted(ws, le) - np.searchsorted(ws, ls)
    inked = np.flatnonzero(l_words > 0)
    key = mix64(spans(ls[inked], le[inked]) + l_doc[inked].astype(U64) * U64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    dup = np.zeros(len(inked), bool)
    dup[order[1:]] = key[order[1:]] == key[order[:-1]]
    n_dup_lines = np.bincount(l_doc[inked][dup], minlength=n)

    w_doc = owners(woff)
    w_hash = spans(ws, we)
    g = ngram_hash(mix64(w_hash + w_doc.astype(U64) * U64(0xA24BAED4963EE407)), 8)
    whole = w_doc[:len(g)] == w_doc[7:] if len(g) else np.zeros(0, bool)
    g, at = g[whole], np.flatnonzero(whole)
    order = np.argsort(g, kind="stable")
    same = np.zeros(len(g) + 1, bool)
    if len(g):
        same[1:-1] = g[order[1:]] == g[order[:-1]]
    twice = np.zeros(len(g), bool)
    twice[order] = same[1:] | same[:-1]
    step = np.zeros(len(ws) + 8, np.int64)
    step[at[twice]] += 1
    step[at[twice] + 8] -= 1
    n_repeat_words = group_sum(np.cumsum(step)[:len(ws)] > 0, woff)

    # ---- line rules, on the lines that hold a word
    s, e, words = ls[inked], le[inked], l_words[inked]
    w_last = np.searchsorted(ws, e) - 1
    last = we[w_last] - 1                      # last inked byte of the line
    ends_well = _ENDS[data[last]]
    for c in TERMINAL_WIDE:
        t = np.frombuffer(c, np.uint8)
        at_c = np.maximum(last - len(t) + 1, 0)
        ends_well |= np.all([data[np.minimum(at_c + k, len(data) - 1)] == t[k] for k in range(len(t))], axis=0)
    mark_sum = np.concatenate([[0], np.cumsum(_MARK[data])])
    marks = mark_sum[e] - mark_sum[s]
    stop_sum = np.concatenate([[0], np.cumsum(_STOP[data])])
    few_stops = (stop_sum[e] - stop_sum[s]) * rules.words_per_stop < words
    sep_word = _SEP[data[ws]] & (we - ws == 1) if len(ws) else np.zeros(0, bool)
    sep_sum = np.concatenate([[0], np.cumsum(sep_word)])
    seps = sep_sum[np.searchsorted(ws, e)] - sep_sum[np.searchsorted(ws, s)]
    same_sum = np.concatenate([[0, 0], np.cumsum(w_hash[1:] == w_hash[:-1])])[:len(ws) + 1]
    first = w_last - words + 1
    stutter = (words >= rules.marks_from_words) & (same_sum[w_last + 1] - same_sum[first + 1] > rules.max_stutter * words)
    open_end = ~ends_well & (few_stops | (words < rules.open_words))
    monotone = few_stops & (words > rules.words_per_stop)
    punctuation = open_end | monotone | stutter | ((words >= rules.marks_from_words) & (marks > rules.max_marks_per_word * words))
    navigation = seps >= rules.min_separators
    boilerplate = np.zeros(len(inked), bool)
    low = _LOWER[data].tobytes()
    for phrase in PHRASES:
        k = low.find(phrase)
        while k >= 0:
            line = int(np.searchsorted(s, k, "right")) - 1
            if line >= 0 and k + len(phrase) <= e[line] and words[line] <= rules.boilerplate_words:
                boilerplate[line] = True
            k = low.find(phrase, k + 1)
    failed = punctuation | navigation | boilerplate
    lost = np.bincount(l_doc[inked], weights=words * failed, minlength=n).astype(np.int64)
    base_failed = (n_words < rules.min_words) | (100 * n_repeat_words > rules.max_repeat * n_words)
    kept = ~base_failed & (lost <= rules.max_loss * n_words)
    out = {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines,
        "n_repeat_words": n_repeat_words, "base_failed": base_failed, "kept": kept, "n_lines": np.diff(loff),
        "n_lines_removed": np.bincount(l_doc[inked][failed], minlength=n), "n_words_kept": n_words - lost,
    }
    removed = np.zeros(len(ls), bool)
    removed[inked[failed]] = True
    return out, (ls, le, loff, removed)


def _cleaned(data: np.ndarray, lines) -> list[str]:
    ls, le, loff, removed = lines
    raw = data.tobytes()
    return [
        b"\n".join(raw[ls[k]:le[k]] for k in range(loff[d], loff[d + 1]) if not removed[k]).decode("utf-8", "replace")
        for d in range(len(loff) - 1)
    ]


def line_quality(docs: DataFrame, rules: LineRules = LineRules(), with_text: bool = False) -> DataFrame:
    """Counts and verdicts of every document; ``with_text`` adds ``clean_text``, the text
    without the lines that failed (for kept and rejected documents alike)."""
    schema = SCHEMA + (", clean_text string" if with_text else "")
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for i, j, data, off in text_slices(batch, "text"):
                out, lines = judge(data, off, rules)
                cols = [ids.slice(i, j - i)] + [
                    pa.array(out[c], pa.bool_() if out[c].dtype == bool else pa.int64()) for c in names[1:len(out) + 1]]
                if with_text:
                    cols.append(pa.array(_cleaned(data, lines), pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
