import math
import random

import numpy as np
import pytest

from millrace.operators import percentiles as pc

PROBS = [0.0, 0.05, 0.5, 0.9, 1.0]


def sample(n, seed=1):
    rnd = random.Random(seed)
    pick = lambda: rnd.choice([rnd.gauss(0, 1), rnd.expovariate(0.01), 0.0, -0.0, 7.5, -rnd.random() * 1e-300, 1e308 * rnd.choice([-1, 1]), rnd.random() * 1e9, None, math.nan, math.inf, -math.inf])
    return [(rnd.choice(["x", "y", None, "n", "v", "many words"]), rnd.choice(["p", None]), pick()) for _ in range(n)]


def brute(data, key, probs):
    groups = {}
    for r in data:
        if r[2] is not None and math.isfinite(r[2]):
            groups.setdefault(key(r), []).append(r[2])
    out = {}
    for k, v in groups.items():
        v.sort()
        for p in probs:
            at = p * (len(v) - 1)
            lo, hi = v[math.floor(at)], v[math.ceil(at)]
            out[k, p] = (len(v), lo + (hi - lo) * (at - math.floor(at)))
    return out


def close(a, b):
    return a == b or math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-300)


@pytest.mark.parametrize(("n", "few", "broadcast"), [(0, 0, 10), (1, 0, 10), (3, 0, 10), (900, 0, 1000), (900, 1000, 1000), (900, 1000, 0)])
def test_exact_against_brute_force(spark, n, few, broadcast, monkeypatch):
    monkeypatch.setattr(pc, "FEW", few)
    monkeypatch.setattr(pc, "BROADCAST", broadcast)
    data = sample(n)
    df = spark.createDataFrame(data, "g string, p string, x double")
    got = pc.percentiles([df.where("x > 0 or g = 'x'"), df.where("not (x > 0 or g = 'x') or x is null or g is null and x <= 0")], [["g"], ["g", "p"], []], "x", PROBS).collect()
    want = {("g", k, None, p): v for (k, p), v in brute(data, lambda r: r[0], PROBS).items()}
    want |= {("g+p", *k, p): v for (k, p), v in brute(data, lambda r: (r[0], r[1]), PROBS).items()}
    want |= {("all", None, None, p): v for (_, p), v in brute(data, lambda r: 0, PROBS).items()}
    have = {(r["grouping"], r["g"], r["p_key"], r["p"]): (r["n_values"], r["value"]) for r in got}
    assert len(got) == len(have) and have.keys() == want.keys()
    for k, (n_values, v) in want.items():
        assert have[k][0] == n_values and (close(have[k][1], v) or not math.isfinite(v)), k


def test_states_of_slices_combine(spark):
    data = [(str(i % 3), None, abs(x)) for i, x in enumerate(np.random.default_rng(5).lognormal(1, 2, 3000).tolist())]
    df = spark.createDataFrame(data, "g string, p string, x double")
    slices = [df.where("x < 1"), df.where("x >= 1 and x < 9"), df.where("x >= 9")]
    whole = pc.merge(*[pc.state(s, [["g"]], "x") for s in slices])
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, pc.state(df, [["g"]], "x").collect()))
    want = brute(data, lambda r: r[0], PROBS)
    for r in pc.bounds(whole, [["g"]], PROBS).collect():
        v = want[r.g, r.p][1]
        assert r.lower - 1e-12 <= v <= r.upper + 1e-12 and r.upper - r.lower <= v * 16 / pc.GRID / v ** (1 / 16) + 1e-12
    exact = pc.percentiles(slices, [["g"]], "x", PROBS, states=[pc.state(s, [["g"]], "x") for s in slices]).collect()
    assert all(close(r["value"], want[r.g, r.p][1]) for r in exact) and len(exact) == 15


def test_bad_percentile(spark):
    with pytest.raises(ValueError):
        pc.percentiles([spark.createDataFrame([], "g string, x double")], [["g"]], "x", [1.5])


def test_slices_combine_for_all_groupings(spark, small, monkeypatch):
    from compare import same
    from millrace.plans import training

    passed = []
    real = pc.percentiles
    monkeypatch.setattr(training.percentiles, "percentiles", lambda *a, **k: passed.append(k.get("states")) or real(*a, **k))
    ok, why = same(training.p2_slices_all(spark, small), training.SQL["p2_slices_all"], small)
    assert ok, why
    assert passed[0] and len(passed[0]) == 2


def test_tolerance_and_its_bound(spark, monkeypatch):
    monkeypatch.setattr(pc, "FEW", 0)
    data = [("a", None, float(x)) for x in np.random.default_rng(6).lognormal(3, 1, 5000)] + [("a\x1fb", "n", 1.0), (None, None, math.inf)]
    df = spark.createDataFrame(data, "g string, p string, x double")
    want = brute(data, lambda r: r[0], PROBS)
    for tolerance in (0.0, 0.5):
        got = pc.percentiles([df], [["g"]], "x", PROBS, tolerance=tolerance).collect()
        assert {r.g for r in got} == {"a", "a\x1fb"}, "keys stay apart whatever they hold"
        assert all(abs(r["value"] - want[r.g, r.p][1]) <= r.error_bound + 1e-9 and r.error_bound <= tolerance / 2 for r in got)
    assert any(r.error_bound > 0 for r in got)
    every = pc.percentiles([df], [["g"]], "x", [1.0], infinite=True).collect()
    assert {r.g: r["value"] for r in every}[None] == math.inf
