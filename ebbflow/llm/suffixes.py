"""Suffix arrays of one shard by induced sorting, and classes of equal strings from them.

A shard has a bounded size (parameter of its caller).  Over bytes the induction runs bucket by
bucket in numpy; the recursion, whose alphabet is the names of the leftmost smaller substrings,
runs on plain lists a third as long or less."""

from __future__ import annotations

import numpy as np


def induced_sort(s: list[int], k: int) -> list[int]:
    """Suffix array of ``s`` (symbols 0 .. k-1, the last one 0 and nowhere else)."""
    n = len(s)
    if n == 1:
        return [0]
    smaller = bytearray(n)                  # 1: the suffix is less than the next one
    smaller[n - 1] = 1
    for i in range(n - 2, -1, -1):
        a, b = s[i], s[i + 1]
        if a < b or (a == b and smaller[i + 1]):
            smaller[i] = 1
    size = [0] * k
    for c in s:
        size[c] += 1
    heads, tails, at = [0] * k, [0] * k, 0
    for c in range(k):
        heads[c] = at
        at += size[c]
        tails[c] = at
    lms = [i for i in range(1, n) if smaller[i] and not smaller[i - 1]]

    def induce(order: list[int]) -> list[int]:
        sa = [-1] * n
        tail = tails[:]
        for i in reversed(order):
            c = s[i]
            tail[c] -= 1
            sa[tail[c]] = i
        head = heads[:]
        for i in sa:                        # grows while it is read: larger suffixes from left to right
            if i > 0 and not smaller[i - 1]:
                c = s[i - 1]
                sa[head[c]] = i - 1
                head[c] += 1
        tail = tails[:]
        for x in range(n - 1, -1, -1):
            i = sa[x]
            if i > 0 and smaller[i - 1]:
                c = s[i - 1]
                tail[c] -= 1
                sa[tail[c]] = i - 1
        return sa

    end = dict(zip(lms, lms[1:] + [n - 1]))
    by_part = [i for i in induce(lms) if i in end]
    name, last, names = -1, None, {}
    for i in by_part:
        part = s[i:end[i] + 1]
        if part != last:
            name += 1
            last = part
        names[i] = name
    if name + 1 < len(lms):
        by_part = [lms[x] for x in induced_sort([names[i] for i in lms], name + 1)]
    return induce(by_part)


def _spread(place: np.ndarray, sa: np.ndarray, items: np.ndarray, symbols: np.ndarray, step: int) -> None:
    """Put items, in their order, at the next places of their symbols' buckets (step 1: from the
    heads on; -1: from the tails down)."""
    order = np.argsort(symbols, kind="stable")
    sym = symbols[order]
    count = np.bincount(sym, minlength=256)
    rank = np.arange(len(sym)) - (np.cumsum(count) - count)[sym]
    sa[(place[sym] + rank) if step > 0 else (place[sym] - 1 - rank)] = items[order]
    place += step * count


def suffix_array(raw: bytes) -> np.ndarray:
    """Suffix array of bytes whose last is 0 and nowhere else 0."""
    s = np.frombuffer(raw, np.uint8)
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    # a suffix is smaller than the next one if the first symbol that differs is
    differs = np.append(s[:-1] != s[1:], True)
    up = np.append(s[:-1] < s[1:], True)
    at = np.flatnonzero(differs)
    smaller = up[at[np.searchsorted(at, np.arange(n))]]
    is_lms = np.zeros(n, bool)
    is_lms[1:] = smaller[1:] & ~smaller[:-1]
    lms = np.flatnonzero(is_lms)
    count = np.bincount(s, minlength=256)
    tails = np.cumsum(count)
    heads = tails - count
    larger_in = np.bincount(s[~smaller], minlength=256)
    used = np.flatnonzero(count)

    def induce(order: np.ndarray) -> np.ndarray:
        sa = np.full(n, -1, np.int64)
        place = tails.copy()
        _spread(place, sa, order[::-1], s[order[::-1]], -1)
        place = heads.copy()
        for c in used:
            lo = heads[c]
            while lo < place[c]:            # what stands in the bucket so far, then what that has added
                hi = place[c]
                _larger(sa[lo:hi], sa, place)
                lo = hi
            _larger(sa[heads[c] + larger_in[c]:tails[c]], sa, place)
        place = tails.copy()
        for c in used[::-1]:
            hi = tails[c]
            bottom = heads[c] + larger_in[c]
            while hi > max(place[c], bottom):
                lo = place[c]
                _smaller(sa[lo:hi][::-1], sa, place)
                hi = lo
            _smaller(sa[heads[c]:bottom][::-1], sa, place)
        sa[0] = n - 1
        return sa

    def _larger(block, sa, place):
        p = block[block > 0] - 1
        p = p[~smaller[p]]
        if len(p):
            _spread(place, sa, p, s[p], 1)

    def _smaller(block, sa, place):
        p = block[block > 0] - 1
        p = p[smaller[p]]
        if len(p):
            _spread(place, sa, p, s[p], -1)

    sa = induce(lms)
    by_part = sa[is_lms[sa]]
    end = np.zeros(n, np.int64)
    end[lms] = np.append(lms[1:], n - 1)
    length = end[by_part] - by_part + 1
    equal = np.zeros(len(by_part), bool)
    maybe = np.flatnonzero(length[1:] == length[:-1]) + 1
    equal[maybe] = _same(raw, by_part[maybe], by_part[maybe - 1], length[maybe])
    names = np.cumsum(~equal) - 1
    if names[-1] + 1 < len(lms):
        name_at = np.zeros(n, np.int64)
        name_at[by_part] = names
        by_part = lms[np.array(induced_sort(name_at[lms].tolist(), int(names[-1]) + 1))]
    return induce(by_part)


def _same(raw: bytes, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether ``length`` bytes from a and from b are equal, eight at a time."""
    words = np.ndarray(len(raw), "<u8", raw + bytes(8), strides=(1,))
    out = np.ones(len(a), bool)
    todo = np.arange(len(a))
    done = np.zeros(len(a), np.int64)
    while len(todo):
        left = length[todo] - done[todo]
        diff = words[a[todo] + done[todo]] ^ words[b[todo] + done[todo]]
        short = np.maximum(0, 8 - left).astype(np.uint64) * np.uint64(8)
        ok = (diff << short) == 0           # little-endian: later bytes are the high ones
        out[todo[~ok]] = False
        done[todo] += 8
        todo = todo[ok & (left > 8)]
    return out


def reaches(raw: bytes, sa: np.ndarray, length: int) -> np.ndarray:
    """For each position in text order (the permuted prefixes): whether it shares ``length`` bytes
    with the suffix before it in the array."""
    n = len(sa)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    out = np.zeros(n, bool)
    at = np.flatnonzero((before >= 0) & (np.maximum(before, np.arange(n)) + length <= n))
    out[at] = _same(raw, at, before[at], np.full(len(at), length))
    return out


#: byte b of a text becomes symbol b + 2 (UTF-8 has no bytes above 0xF4); 1 separates, 0 ends
_SHIFT = bytes(min(b + 2, 255) for b in range(256))


def repeated_starts(strings: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (string number, first offset, count) of the starts at which ``length`` bytes stand that
    also start earlier in the same or an earlier string."""
    s = b"\x01".join(x.translate(_SHIFT) for x in strings) + b"\x00"
    order = suffix_array(s)
    sizes = np.array([len(x) for x in strings], np.int64)
    base = np.cumsum(sizes + 1) - (sizes + 1)
    group = np.cumsum(~reaches(s, order, length)[order]) - 1
    first = np.full(int(group[-1]) + 1, len(s))
    np.minimum.at(first, group, order)
    again = np.zeros(len(s), bool)
    again[order[first[group] != order]] = True
    at = np.flatnonzero(again)
    which = np.searchsorted(base, at, "right") - 1
    offset = at - base[which]
    valid = offset + length <= sizes[which]
    at, which, offset = at[valid], which[valid], offset[valid]
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1] + 1
    starts = np.flatnonzero(new)
    return which[starts], offset[starts], np.diff(np.append(starts, len(at)))
