"""Brownian passes against a dense covariance solution, rates and movements by hand."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from cladewise.operators import brownian, deep

NODES = "tree_id long, node string, parent string, branch_length double"


def _nodes(spark, edges):
    return deep.named(deep.node_rows(spark.createDataFrame([(1, *e) for e in edges], NODES)))


def _values(spark, values, trait="x"):
    return spark.createDataFrame([(1, k, trait, v) for k, v in values.items()], "tree_id long, name string, trait string, value double")


def _random_tree(rng, tips, most):
    edges, open_, count = [("r", None, None)], ["r"], 1
    while count < tips:
        parent = open_.pop(rng.randrange(len(open_)))
        kids = rng.randrange(2, most + 1)
        for _ in range(kids):
            name = f"n{len(edges)}"
            edges.append((name, parent, rng.uniform(0.1, 3)))
            open_.append(name)
        count += kids - 1
    return edges, open_


def _dense(edges, values):
    """Root mean, and values and variances of nodes given all tips, by the covariance of the tips."""
    parent = {n: (p, b) for n, p, b in edges}

    def path(n):
        out = {}
        while parent[n][0] is not None:
            out[n] = parent[n][1]
            n = parent[n][0]
        return out

    shared = lambda a, b: sum(path(a)[k] for k in path(a).keys() & path(b).keys())
    tips = sorted(values)
    y = np.array([values[t] for t in tips])
    c = np.array([[shared(a, b) for b in tips] for a in tips])
    w = np.linalg.inv(c)
    one = np.ones(len(tips))
    total = one @ w @ one
    mean = one @ w @ y / total
    rate = (y - mean) @ w @ (y - mean) / (len(tips) - 1)
    out = {}
    for n in parent:
        k = np.array([shared(n, t) for t in tips])
        gap = 1 - k @ w @ one
        out[n] = (mean + k @ w @ (y - mean), rate * (shared(n, n) - k @ w @ k + gap**2 / total))
    return out


@pytest.mark.parametrize("seed,most", [(1, 2), (2, 2), (3, 4)])
def test_conditional_values_equal_the_dense_solution(spark, seed, most):
    rng = random.Random(seed)
    edges, tips = _random_tree(rng, 14, most)
    values = {t: 1000 + rng.gauss(0, 2) for t in tips}
    got = {r.name: r for r in brownian.ancestral_values(_nodes(spark, edges), _values(spark, values)).collect()}
    want = _dense(edges, values)
    assert set(got) == {e[0] for e in edges}
    for name, r in got.items():
        assert r.conditional == pytest.approx(want[name][0], rel=1e-10)
        assert r.conditional_variance == pytest.approx(want[name][1], rel=1e-6, abs=1e-10)
    assert got["r"].estimate == pytest.approx(want["r"][0], rel=1e-10)


def test_local_values_by_hand(spark):
    # ((a:1,b:3)n:2,c:4)r
    edges = [("r", None, None), ("n", "r", 2.0), ("a", "n", 1.0), ("b", "n", 3.0), ("c", "r", 4.0)]
    got = {r.name: r for r in brownian.ancestral_values(_nodes(spark, edges), _values(spark, {"a": 0.0, "b": 8.0, "c": 10.0})).collect()}
    assert got["n"].estimate == pytest.approx(2.0) and got["n"].variance == pytest.approx(4.0)
    # n sends 2 + 3/4
    assert got["r"].estimate == pytest.approx((2 * 4 + 10 * 2.75) / 6.75) and got["r"].variance == pytest.approx(6.75)
    width = 2 * brownian.NORMAL_95 * 2
    assert got["n"].confidence == pytest.approx(1 - width / 10) and got["n"].unstable and got["a"].confidence == 1 and not got["a"].unstable
    assert got["n"].upper - got["n"].lower == pytest.approx(width)


def test_missing_tips_repeated_values_and_short_branches(spark):
    edges = [("r", None, None), ("n", "r", 2.0), ("a", "n", 0.0), ("b", "n", 3.0), ("m", "r", 1.0), ("c", "m", 1.0), ("d", "m", None)]
    values = spark.createDataFrame([(1, "a", "x", 5.0), (1, "b", "x", 9.0), (1, "b", "x", 7.0), (1, "c", "x", None), (1, "z", "x", 3.0), (2, "a", "x", 1.0)], "tree_id long, name string, trait string, value double")
    got = {r.name: r for r in brownian.ancestral_values(_nodes(spark, edges), values).collect()}
    assert set(got) == {"r", "n", "a", "b"} and got["b"].estimate == 7
    assert got["n"].estimate == pytest.approx(5) and got["r"].estimate == pytest.approx(5)
    none = brownian.ancestral_values(_nodes(spark, edges), values.where("false"))
    assert none.collect() == [] and brownian.rate_intervals(_nodes(spark, edges), none).collect() == []
    alone = brownian.ancestral_values(_nodes(spark, [("t", None, None)]), _values(spark, {"t": 2.0})).collect()
    assert [(r.name, r.estimate, r.is_tip) for r in alone] == [("t", 2.0, True)]


def test_comb_of_a_dozen_levels(spark):
    edges = [("n0", None, None)] + [(f"n{i}", f"n{i - 1}", 1.0) for i in range(1, 12)] + [(f"t{i}", f"n{i}", 2.0) for i in range(12)]
    values = {f"t{i}": float(i * i) for i in range(12)}
    got = {r.name: r for r in brownian.ancestral_values(_nodes(spark, edges), _values(spark, values)).collect()}
    want = _dense(edges, values)
    assert all(r.conditional == pytest.approx(want[n][0], rel=1e-9) for n, r in got.items())


def test_rates_by_hand(spark):
    # squared changes: n 4 over depth 0 to 2, a 4 and b 36 over 2 to 4, c 64 over 0 to 4, if the root were 0 and n 2
    edges = [("r", None, None), ("n", "r", 2.0), ("a", "n", 2.0), ("b", "n", 2.0), ("c", "r", 4.0)]
    found = spark.createDataFrame([(1, n, "x", n in "abc", v) for n, v in {"r": 0.0, "n": 2.0, "a": 0.0, "b": 8.0, "c": 8.0}.items()], "tree_id long, name string, trait string, is_tip boolean, estimate double")
    rows = brownian.rate_intervals(_nodes(spark, edges), found, 2)
    got = [(r.interval, r.branches, r.length, r.change, r.rate) for r in rows.orderBy("interval").collect()]
    assert got == [(1, 2, 4.0, 36.0, 9.0), (2, 3, 6.0, 72.0, 12.0)]
    assert sum(r.share for r in rows.collect()) == pytest.approx(1)
    t = brownian.rate_trend(rows).first()
    assert (t.earliest, t.latest, t.peak, t.trough) == (9.0, 12.0, 2, 1) and t.slope == pytest.approx(1.5) and t.trend == "acceleration"
    assert t.normalised_slope == pytest.approx(1.5 * 4 / (108 / 10))
    with pytest.raises(ValueError):
        brownian.rate_intervals(_nodes(spark, edges), found, 1)


def test_movements_by_hand(spark):
    edges = [("r", None, None)] + [(f"t{i}", "r", 1.0) for i in range(5)] + [("far", "r", 1.0), ("jump", "r", 0.0)]
    places = {"r": (0.0, 0.0), "far": (0.0, 90.0), "jump": (1.0, 0.0)} | {f"t{i}": (0.0, 1.0) for i in range(5)}
    frame = spark.createDataFrame([(1, n, n != "r", *p, 1.0, 0.0) for n, p in places.items()], "tree_id long, name string, is_tip boolean, latitude double, longitude double, confidence double, radial_error_km double")
    got = {r.name: r for r in brownian.movements(_nodes(spark, edges), frame).collect()}
    degree = brownian.EARTH_KM * math.pi / 180
    assert got["t0"].km == pytest.approx(degree, abs=1e-6) and got["far"].km == pytest.approx(90 * degree, abs=1e-6)
    assert {n: r.flags for n, r in got.items()} == {f"t{i}": "" for i in range(5)} | {"far": "distance_outlier,rate_outlier", "jump": "zero_length_jump"}
    assert got["jump"].km_per_unit is None


def test_group_median(spark):
    rng = random.Random(9)
    rows = [(t, rng.choice([None, 1.0, 2.0, 5.5, rng.random()])) for t in range(4) for _ in range(t * 3 + 1)]
    rows += [(9, None)]
    got = {r.tree_id: r.m for r in brownian.group_median(spark.createDataFrame(rows, "tree_id long, v double"), "v", "m").collect()}
    want = {t: float(np.median(v)) for t in range(4) if (v := [x for k, x in rows if k == t and x is not None])}
    assert got == pytest.approx(want)
