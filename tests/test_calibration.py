"""Calibrators against small numpy references."""

import numpy as np
import pytest

from ebbflow.operators import calibration as CA


def pava(x, y):
    xs = np.unique(x)
    sums = np.array([y[x == v].sum() for v in xs], float)
    cnts = np.array([(x == v).sum() for v in xs], float)
    blocks = [[s, c, [i]] for i, (s, c) in enumerate(zip(sums, cnts))]
    out = []
    for b in blocks:
        out.append(b)
        while len(out) > 1 and out[-2][0] / out[-2][1] > out[-1][0] / out[-1][1]:
            s, c, idx = out.pop()
            out[-1][0] += s
            out[-1][1] += c
            out[-1][2] += idx
    fit = np.empty(len(xs))
    for s, c, idx in out:
        fit[idx] = s / c
    return xs, fit


def test_isotonic_matches_pava_and_clips(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.random(400), 2)
    y = (rng.random(400) < x).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "s double, is_churn int")
    model = CA.fit_isotonic(df, "s")
    xs, fit = pava(x, y)
    probe = spark.createDataFrame([(float(v),) for v in list(xs) + [-1.0, 2.0]], "s double")
    got = {r["s"]: r["p"] for r in CA.apply_isotonic(model, probe, "s", "p").collect()}
    for v, f in zip(xs, fit):
        assert got[float(v)] == pytest.approx(f, abs=1e-12)
    assert got[-1.0] == pytest.approx(fit[0]) and got[2.0] == pytest.approx(fit[-1])


def test_platt_newton_matches_numpy(spark):
    rng = np.random.default_rng(9)
    x = np.round(rng.random(500), 2)
    y = (rng.random(500) < 0.2 + 0.5 * x).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "s double, is_churn int")
    w, b = CA.fit_platt(df, "s")
    # numpy Newton on the same objective: sum log-loss + w^2 / 2
    ww = bb = 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(ww * x + bb)))
        g = np.array([((p - y) * x).sum() + ww, (p - y).sum()])
        h = p * (1 - p)
        H = np.array([[(h * x * x).sum() + 1, (h * x).sum()], [(h * x).sum(), h.sum()]])
        ww, bb = np.array([ww, bb]) - np.linalg.solve(H, g)
    assert w == pytest.approx(ww, abs=1e-9) and b == pytest.approx(bb, abs=1e-9)


def test_calibrated_probabilities_in_unit_interval(chain_small):
    c = chain_small.calibrated()
    r = c.agg({"calibrated_probability": "min"}).first()[0], c.agg({"calibrated_probability": "max"}).first()[0]
    assert 0.0 <= r[0] <= r[1] <= 1.0


def test_degenerate_scores_are_an_error(spark):
    from ebbflow.operators import calibration as CA
    one = spark.createDataFrame([(1, 1.0)] * 5, "is_churn int, s double")
    with pytest.raises(CA.CalibrationError):
        CA.fit_platt(one, "s")


@pytest.mark.parametrize("shape", ["rising", "falling", "mixed", "flat"])
def test_isotonic_in_ranges_equals_the_pooled_fit(spark, shape):
    """Nearly all scores distinct and ranges far smaller than the pools: borders must settle."""
    rng = np.random.default_rng(11)
    x = rng.random(1500)
    p = {"rising": x, "falling": 1 - x, "mixed": .5 + .4 * np.sin(9 * x), "flat": np.full(1500, .3)}[shape]
    y = (rng.random(1500) < p).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)] + [(None, 1)], "s double, is_churn int")
    xs, fit = pava(x, y)
    for per in (40, 100_000):
        model = CA.fit_isotonic(df, "s", rows_per_range=per)
        got = {r["s"]: r["p"] for r in CA.apply_isotonic(model, df, "s", "p").collect()}
        assert got.pop(None) is None
        assert np.allclose([got[float(v)] for v in xs], fit, atol=1e-12)
        assert (model.rounds == 1) == (per == 100_000) or shape == "rising"
        step = np.interp(probe := rng.random(50), xs, fit)
        one = CA.apply_isotonic(model, spark.createDataFrame([(float(v),) for v in probe], "s double"), "s", "p").collect()
        assert np.allclose([r["p"] for r in sorted(one, key=lambda r: r["s"])], step[np.argsort(probe)], atol=1e-9)


def test_isotonic_without_rows(spark):
    none = spark.createDataFrame([], "s double, is_churn int")
    model = CA.fit_isotonic(none, "s")
    assert [r["p"] for r in CA.apply_isotonic(model, spark.createDataFrame([(.5,), (None,)], "s double"), "s", "p").collect()] == [None, None]


def test_quantile_edges_are_exact_inside_ties(spark):
    from ebbflow.functions.ranged import quantile_row
    v = 0.19311888359140536
    df = spark.createDataFrame([(0.1,)] * 30 + [(v,)] * 311 + [(0.7,)] * 20, "x double")
    probs = [k / 100 for k in range(1, 100)]
    got = quantile_row(df, {"q": ("x", probs)})["q"]
    values = sorted([0.1] * 30 + [v] * 311 + [0.7] * 20)
    for p, g in zip(probs, got):
        lo, hi = values[int(np.floor(p * 360))], values[int(np.ceil(p * 360))]
        assert g == lo if lo == hi else lo <= g <= hi


def test_newton_steps_take_tasks_by_the_blocks(spark):
    rng = np.random.default_rng(11)
    df = spark.createDataFrame([(float(a), float(c), int(b)) for a, c, b in zip(
        np.round(rng.random(300), 2), np.round(rng.random(300), 2), rng.random(300) < 0.4)], "score double, other double, is_churn int")
    spark.sparkContext.setJobGroup("newton", "steps")
    try:
        (w, b), _ = CA.fit_platt_many(df, ["score", "other"])
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    status = spark.sparkContext.statusTracker()
    last = sorted(status.getJobIdsForGroup("newton"))[-2:]      # the last step: its sums in the tasks, then theirs
    ran = [status.getStageInfo(s) for j in last for s in status.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in ran if s is not None and s.numCompletedTasks) == 1   # two columns of a hundred blocks at most
    rows = df.collect()
    x, y = np.array([r[0] for r in rows]), np.array([r[2] for r in rows])
    p = 1 / (1 + np.exp(-(w * x + b)))
    assert abs(((p - y) * x).sum() + w) < 1e-8 and abs((p - y).sum()) < 1e-8


def test_isotonic_values_read_no_frame_anew_for_each_row(spark):
    """A frame from the row to the end of its range took 38 s for 24,000 scores; the next block end is found from behind."""
    from ebbflow.operators import isotonic
    rows = [(k / 40, 1.0, float(k % 7 < k / 6)) for k in range(40)]
    model = isotonic.fit(spark.createDataFrame(rows, "x double, n double, pos double"))
    asked = spark.createDataFrame([(k / 97 - 0.1,) for k in range(120)] + [(None,)], "x double")
    found = isotonic.values(model, asked)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    per_range = [w for w in plan.splitlines() if w.lstrip(" +-:").startswith("Window") and "windowspecdefinition(seat#" in w]
    assert any("unboundedpreceding$(), currentrow$()" in w for w in per_range)
    inside = [w for w in per_range if "x#" in w.split("windowspecdefinition(seat#")[1]]
    assert inside and not any("currentrow$(), unboundedfollowing$()" in w for w in inside)
    blocks = sorted((r["lo"], r["hi"], r["fit"]) for r in model.blocks.collect())
    xs = [e for lo, hi, _ in blocks for e in (lo, hi)]
    ys = [f for _, _, f in blocks for _ in (0, 1)]
    got = {r["x"]: r["fit"] for r in found.collect()}
    assert len(got) == 120
    for x, y in got.items():
        assert abs(y - float(np.interp(x, xs, ys))) < 1e-12
