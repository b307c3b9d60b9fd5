"""Phrase collocations, the epsilon grid join and hard negatives against brute force, with nulls,
ties, repeated rows, empty tables and clashing columns."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from ebbflow.llm import angular, epsilongrid, phrases

# ------------------------------------------------------------------ 11 phrases


def brute_phrases(rows, least=30, longest=4, top=2000):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        lowered = re.sub(r"[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", lowered):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    f[lang, tuple(words[i:i + m])] += 1
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = []
    for (lang, g), a in cand.items():
        score, k, left, right = min((2_000_000 * a // (f[lang, g[:k]] + f[lang, g[k:]]), k, f[lang, g[:k]], f[lang, g[k:]]) for k in range(1, len(g)))
        inside = (b for (l2, h), b in cand.items() if l2 == lang and len(h) > len(g) and any(h[i:i + len(g)] == g for i in range(len(h) - len(g) + 1)))
        if not any(100 * b >= 80 * a for b in inside):
            out.append((lang, " ".join(g), a, left, right, n[lang], score))
    best = []
    for lang in {x[0] for x in out}:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        best += [(x[0], k + 1, *x[1:]) for k, x in enumerate(own[:top])]
    return sorted(best)


def phrase_rows():
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(40)] + ["Größe", "日本語", "A", "a"]
    rows = [(str(rng.choice(["en", "de", ""])) or None, " ".join(rng.choice(words, 60, p=rng.dirichlet(np.full(len(words), .3))))) for _ in range(60)]
    rows += [("en", "one two three four, ONE two three four! one\ttwo three  four\x0bone two"), ("und", "red green. red green"), (None, "red green")] * 12
    return rows + [("en", None), (None, None), ("en", ""), ("fr", "  \t\n"), ("en", "loop " * 5000), ("en", "x" * 50_000)]


def test_phrases_equal_brute_force(spark):
    rows = phrase_rows()
    df = spark.createDataFrame([(k, t, lang, 7, "x", 1) for k, (lang, t) in enumerate(rows)],
                               "doc_id long, text string, lang string, n int, word string, w1 int").repartition(5)
    for rules in (phrases.PhraseRules(), phrases.PhraseRules(least=3, top=10)):
        got = sorted(tuple(r) for r in phrases.collocations(df, rules).collect())
        assert got == brute_phrases(rows, rules.least, top=rules.top) and got
    assert phrases.collocations(df.limit(0)).collect() == []
    assert phrases.collocations(spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string")).collect() == []


def test_counts_per_task_are_bounded():
    held, rng = phrases.Counted(2, limit=50), np.random.default_rng(1)
    columns, parts = [], []
    for _ in range(30):
        table = rng.integers(0, 30, (2, 40)).astype(np.uint64)
        columns += list(map(tuple, table.T.tolist()))
        parts += list(held.add(table))
        assert len(held.n) <= 100
    total = Counter()
    for table, n in [*parts, *held.rest()]:
        for c, x in zip(map(tuple, table.T.tolist()), n.tolist()):
            total[c] += x
    assert total == Counter(columns)


# ------------------------------------------------------------------ 12 epsilon grid


def brute_components(rows, least=0.95):
    def ok(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
    units = [np.array(v, float) / np.linalg.norm(v) if ok(v) else None for _, v in rows]
    links = [[j for j in range(len(rows)) if j != i and units[i] is not None and units[j] is not None
              and len(units[i]) == len(units[j]) and units[i] @ units[j] >= least] for i in range(len(rows))]
    out = []
    for i, (name, _) in enumerate(rows):
        reach, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in reach:
                    reach.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in reach if rows[j][0] is not None]
        least_id = min(ids) if ids else None
        out.append((name, len(links[i]), least_id, name is not None and name == least_id))
    return sorted(out, key=str)


def vector_rows(dim=12, n=160, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    rows = [(int(k), [float(np.float32(x)) for x in centres[k % 12] * rng.uniform(.5, 3) + rng.normal(size=dim) * rng.choice([.05, .25, 1])]) for k in range(n)]
    rows += [(1000 + k, rows[3][1]) for k in range(30)]                                     # copies
    rows += [(2000, None), (2001, [0.0] * dim), (2002, [None] * dim), (2003, [float("nan")] * dim), (2004, [float("inf")] + [1.0] * (dim - 1))]
    rows += [(2005, []), (2006, [1.0, 2.0]), (2007, [2.0, 4.0]), (None, rows[5][1]), (None, [9.0, -1.0]), (5, rows[5][1]), (-4, rows[7][1])]
    return rows


@pytest.mark.parametrize("kind", ["float", "double"])
def test_grid_join_equals_brute_force(spark, kind):
    rows = vector_rows()
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], f"vec_id long, embedding array<{kind}>, member int, copies int").repartition(3)
    for rules in (epsilongrid.GridRules(), epsilongrid.GridRules(block_bytes=1, leaf=8, group_bits=0, fan_bits=1, directions=3)):
        got = sorted((tuple(r) for r in epsilongrid.near_duplicates(df, rules).collect()), key=str)
        assert got == brute_components(rows)
    assert epsilongrid.near_duplicates(df.limit(0)).collect() == []


def test_grid_join_skips_distant_intervals():
    rules, rng = epsilongrid.GridRules(), np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    u = epsilongrid.unit(np.repeat(centres, 200, axis=0) + rng.normal(size=(8000, 16)) * .02)
    p = epsilongrid.project(u, {16: np.linalg.svd(u, full_matrices=False)[2][:8].T}, rules)
    order = np.lexsort(np.floor(p / (rules.eps / rules.cells)).T[::-1])
    join = epsilongrid.Joiner(u[order], p[order], np.ones(8000, np.int64), rules)
    join.join((0, 8000), (0, 8000))
    assert (join.links >= 199).all()
    assert join.compared < 0.25 * 8000 * 8000 / 2


# ------------------------------------------------------------------ 13 hard negatives


def brute_negatives(rows, anchors, rules=angular.MiningRules()):
    def ok(r):
        return None not in r and all(x is not None and math.isfinite(x) for x in r[2])
    live = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows if ok((i, lab, v))]
    out = []
    for i, lab, v in {(i, lab, tuple(v)) for i, lab, v in live if i in anchors}:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, lab2) for j, lab2, w in live if j != i and len(w) == len(v))
        for ps, p, _ in [x for x in scored if x[2] == lab][:rules.positives]:
            fit = [(s, j) for s, j, lab2 in scored if lab2 != lab and rules.low * -ps <= 100 * -s <= rules.high * -ps]
            out += [(i, p, k + 1, j, -ps, -s) for k, (s, j) in enumerate(fit[:rules.negatives])]
    return sorted(out)


def labelled_rows():
    rng = np.random.default_rng(8)
    rows = [(k, int(rng.integers(0, 3)), v) for k, v in vector_rows(seed=9) if k is not None and 0 <= k < 2000 and v]
    rows += [(3000, None, [1.0] * 12), (3001, 1, None), (None, 1, [1.0] * 12), (3002, 1, [float("nan")] * 12), (3003, 1, [None] * 12),
             (3004, 1, [0.0] * 12), (3005, 2, [0.0] * 12), (3006, 0, []), (3007, 1, [2.0, 1.0]), (3008, 2, [1.5, 1.0]), (3009, 1, [2.0, 2.0])]
    return rows + [(10, rows[10][1], rows[10][2])] * 2        # a repeated anchor row


def test_hard_negatives_equal_brute_force(spark):
    rows = labelled_rows()
    df = spark.createDataFrame([(i, lab, v, 0, 0, 1.0) for i, lab, v in rows],
                               "vec_id long, label int, embedding array<float>, part int, kind int, norm double").repartition(4)
    anchors = [0, 10, 20, 30, 40, 3004, 3007, 1001]
    for rules in (angular.MiningRules(), angular.MiningRules(anchor_group=3, least_rows=20, run=4, references=3, positives=2, negatives=3, low=-50)):
        got = sorted(tuple(r) for r in angular.mine(df, df.filter(df.vec_id.isin(anchors)), rules).collect())
        assert got == brute_negatives(rows, anchors, rules) and got
    assert angular.mine(df.limit(0), df.limit(0)).collect() == []
    assert angular.mine(df, df.filter("vec_id = 999999")).collect() == []


def test_angles_skip_clustered_rows():
    rng, rules = np.random.default_rng(4), angular.MiningRules()
    centres = rng.normal(size=(8, 32))
    v = np.floor(256 * (np.repeat(centres, 500, axis=0) + rng.normal(size=(4000, 32)) * .03)).astype(np.int64)
    u, norm = angular._units(v)
    angles = np.arccos(np.clip(u @ angular._units(centres)[0].T, -1, 1))
    rows = {"id": np.arange(4000), "label": np.repeat(np.arange(8), 500) % 2, "v": v, "norm": norm, "angles": angles}
    own = {k: x[::400] for k, x in rows.items()}
    wanted = angular.Wanted(np.arange(10), np.full(10, -(1 << 62)), np.full(10, 1 << 62), 5, 10)
    scored, pairs = angular.scan(own, rows, wanted, True, 8, rules.run)
    assert scored < 0.35 * pairs
    for a in range(10):
        score = v @ own["v"][a]
        ok = np.flatnonzero((rows["label"] == own["label"][a]) & (rows["id"] != own["id"][a]))
        best = ok[np.lexsort((ok, -score[ok]))][:5]
        assert [i for _, i in wanted.rows[a]] == best.tolist()


def test_bounds_hold():
    rng = np.random.default_rng(6)
    v = rng.normal(size=(300, 5)) * 1000
    u, norm = angular._units(v)
    angles = np.arccos(np.clip(u @ u[:6].T, -1, 1))
    low, high = angular.cosines(angles, angles, angles, 6)
    low, high = angular.score_bounds(low, high, norm, norm, norm)
    score = v @ v.T
    assert (low <= score).all() and (score <= high).all() and ((high - low) < 2 * np.outer(norm, norm)).mean() > .5


# ------------------------------------------------------------------ 10 families of near copies


def test_family_rows_are_linear(spark):
    """One family of near copies: a constant number of rows a member at three sizes, all links found."""
    from ebbflow.llm import jaccard
    words = [f"w{k}" for k in range(120)]
    for m in (500, 1000, 2000):
        rows = [(k, " ".join(words[:k % 120] + [f"x{k}"] + words[k % 120 + 1:])) for k in range(m)]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        rules = jaccard.JoinRules(bucket_limit=100, family_block=4096, tile=128)
        got = jaccard.near_duplicates(df, rules).collect()
        assert {r.class_id for r in got} == {0} and {r.n_links for r in got} == {m - 1}
        big = spark.createDataFrame([(b, bytes([k % 256, k // 256])) for k in range(m) for b in range(7)], "bucket long, key binary")
        member = jaccard.families(big)
        assert member.select("family").distinct().count() == 1 and member.count() == m
        reps = member.select("key").selectExpr("key", "cast(120 as long) size", "cast(1 as long) copies")
        assert jaccard._family_rows(member, reps, rules).count() == m


def test_families_equal_brute_force(spark):
    """Large buckets at a small limit, overlapping families, copies and blocks of a few members."""
    from ebbflow.llm import jaccard
    rng = np.random.default_rng(7)
    texts = []
    for f in range(4):
        base = [f"f{f}w{k}" for k in range(60)]
        for k in range(40):
            own = list(base)
            for at in rng.integers(0, 60, rng.integers(0, 3)):
                own[at] = f"n{rng.integers(0, 9)}"
            texts.append(" ".join(own + ["tail"] * int(rng.integers(0, 4))))
    rows = [(k, t) for k, t in enumerate(texts)] + [(1000 + k, t) for k, t in enumerate(texts[:20])]
    sets = [frozenset(tuple(t.split()[i:i + 5]) for i in range(max(1, len(t.split()) - 4))) for _, t in rows]
    links = [sum(1000 * len(a & b) >= 800 * len(a | b) for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    rules = jaccard.JoinRules(bucket_limit=8, family_block=16, tile=8, target_recall=1 - 1e-7)
    got = {r.doc_id: r.n_links for r in jaccard.near_duplicates(df, rules).collect()}
    assert [got[i] for i, _ in rows] == links


def test_near_copies_are_not_split(spark, monkeypatch):
    """Buckets of near copies go to their family whole: further picks would make rows and part nobody.
    Buckets of a passage that else different texts share are split as before."""
    from ebbflow.llm import jaccard
    made = []

    def deeper(rows, rules, real=jaccard._deeper):
        out = real(rows, rules).cache()
        made.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "_deeper", deeper)
    words = [f"w{k}" for k in range(120)]
    near = [(k, " ".join(words[:k % 120] + [f"x{k}"] + words[k % 120 + 1:])) for k in range(300)]
    rules = jaccard.JoinRules(bucket_limit=100)
    got = jaccard.near_duplicates(spark.createDataFrame(near, "doc_id long, text string"), rules).collect()
    assert {(r.class_id, r.n_links) for r in got} == {(0, 299)}
    assert sum(made) <= 2 * len(near)           # a few buckets at most
    mixed = [(b, bytes([k])) for k in range(200) for b in range(20)] + [(99, bytes([k, 1])) for k in range(200)]
    big = spark.createDataFrame(mixed, "bucket long, key binary")
    assert {r.bucket for r in jaccard.dense_buckets(big, rules).collect()} == set(range(20))
