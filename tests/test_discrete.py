"""Discrete characters and least squares against closed forms and brute force."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest

from cladewise.plans import discrete, forest, joining, leastsquares, sampling
from cladewise.plans.comparative import mk_log_likelihood
from cladewise.sources.newick import dump, parse


def tree(n, seed):
    return sampling.coalescent([f"t{i}" for i in range(n)], 1.0, random.Random(seed))


def test_expm():
    q = discrete.generator("er", 2, np.array([0.3]))
    assert discrete.expm(q, 2.0)[0, 0] == pytest.approx((1 + math.exp(-1.2)) / 2)
    assert discrete.expm(discrete.generator("ard", 3, np.arange(1.0, 7.0)), 50.0).sum(axis=1) == pytest.approx(np.ones(3))


def test_likelihood_by_summing_over_histories():
    t, q = tree(4, 2), discrete.generator("ard", 2, np.array([0.4, 0.9]))
    states = {"t0": 0, "t1": 1, "t2": 1, "t3": 0}
    inner = [n for n in t.walk() if n.children]
    total = 0.0
    for choice in itertools.product((0, 1), repeat=len(inner)):
        of = {id(n): s for n, s in zip(inner, choice, strict=True)}
        p = 0.5
        for n in inner:
            for c in n.children:
                p *= discrete.expm(q, c.length)[of[id(n)], of[id(c)] if c.children else states[c.name]]
        total += p
    assert discrete.log_likelihood(t, states, q) == pytest.approx(math.log(total))
    root = next(v for a, n, v in discrete.marginal_states(t, states, q) if n == 4)
    part, _, _ = discrete.conditionals(t, states, q)
    assert root == pytest.approx(part[id(t)] / part[id(t)].sum())


def test_equal_rates_agree_with_the_closed_form():
    t = tree(6, 3)
    states = {f"t{i}": i % 3 for i in range(6)}
    assert discrete.log_likelihood(t, states, discrete.generator("er", 3, np.array([0.7]))) == pytest.approx(mk_log_likelihood(t, states, 3, 0.7))


def test_richer_models_fit_no_worse():
    t = tree(8, 4)
    states = {f"t{i}": int(i > 2) for i in range(8)}
    er, ard = discrete.fit(t, states, 2, "er")[1], discrete.fit(t, states, 2, "ard")[1]
    assert ard >= er - 1e-4


def test_stochastic_maps_fill_the_tree():
    t = tree(5, 5)
    states = {f"t{i}": i % 2 for i in range(5)}
    dwell, changes = discrete.stochastic_map(t, states, discrete.generator("er", 2, np.array([0.8])), random.Random(1))
    assert dwell.sum() == pytest.approx(sum(n.length or 0.0 for n in t.walk() if n is not t)) and changes.sum() >= 1 and np.diag(changes).sum() == 0


def test_least_squares_recover_lengths():
    t = parse("((A:1,B:2):1.5,C:3,(D:1,E:1):0.5);")
    want = joining.patristic(t)
    names = list("ABCDE")
    d = np.zeros((5, 5))
    for (a, b), x in want.items():
        d[names.index(a), names.index(b)] = d[names.index(b), names.index(a)] = x
    for options in ({}, {"power": 2.0}, {"positive": True}):
        rss, length = leastsquares.fit(t, names, d, **options)
        assert rss == pytest.approx(0, abs=1e-12) and length == pytest.approx(10)
    # on additive distances the balanced score is the length of the tree
    assert leastsquares.balanced_minimum_evolution(t, names, d) == pytest.approx(10)


def test_nonnegative():
    a, b = np.array([[1.0, 1.0], [1.0, -1.0]]), np.array([1.0, 3.0])
    assert leastsquares.nonnegative(a, b) == pytest.approx([2.0, 0.0])


def test_trees_together_equal_trees_alone():
    rng = random.Random(7)
    given = []
    for i in range(12):
        t = tree(3 + i % 4, i)
        states = {f"t{j}": rng.randrange(3) if j > 2 else j for j in range(2 + i % 4)}  # the last tip has no state
        given.append((t, states))
    star = parse("(t0:0.1,t1:0.2,t2:0.3,(t3:0,t4:0.5):0.1,t5:40);"), {"t0": 0, "t1": 1, "t2": 2, "t4": 1, "t5": 0}
    some = forest.Forest([*given, star], 3)
    rates = np.array([[rng.uniform(0.01, 30) for _ in some.trees] for _ in range(6)])
    q = forest.generators("ard", 3, rates)
    want = [discrete.log_likelihood(t, s, discrete.generator("ard", 3, r)) for (t, s), r in zip(some.trees, rates.T, strict=True)]
    assert some.log_likelihood(q) == pytest.approx(want, abs=1e-10)
    assert some.log_likelihood(q, True).tolist() == want
    rate, lnl = forest.common_rate(some)
    alone = [discrete.fit(t, s, 3) for t, s in some.trees]
    assert rate.tolist() == [m[0, 1] for m, _ in alone] and lnl.tolist() == [x for _, x in alone]
    for kind in ("sym", "ard"):
        assert forest.fits(some, kind, rate, lnl).tolist() == [discrete.fit(t, s, 3, kind)[1] for t, s in some.trees]
    zero = parse("(a:0,b:0);"), {"a": 0, "b": 1}
    assert forest.Forest([zero], 2).log_likelihood(forest.generators("er", 2, np.ones((1, 1)))).tolist() == [-math.inf] == [discrete.log_likelihood(*zero, discrete.generator("er", 2, np.ones(1)))]


def test_chunks_hold_every_tree_once():
    given = [(tree(6, i), {}) for i in range(300)] + [(tree(900, 1), {})] + [(tree(6, 2), {})]
    got = list(forest.chunks(given))
    assert [i for own in got for i in own] == list(range(302)) and [300] in got and max(map(len, got)) > 50


def test_maps_equal_maps_drawn_one_by_one(spark):
    rng = random.Random(8)
    trees = {i: tree(5, i) for i in range(6)}
    states = {i: {f"t{j}": "ab"[rng.randrange(2)] if j > 1 else "ab"[j] for j in range(5)} for i in trees}
    frame = spark.createDataFrame([(i, dump(t)) for i, t in trees.items()], "tree_id long, newick string")
    rows = spark.createDataFrame([(i, t, s) for i, own in states.items() for t, s in own.items()], "tree_id long, taxon string, state string")
    got = {(r.tree_id, r.state): (r.mean_time, r.mean_gains) for r in discrete.maps(frame, rows, 3).collect()}
    for i in trees:
        t, s = parse(dump(trees[i])), {n: "ab".index(x) for n, x in states[i].items()}
        q, _ = discrete.fit(t, s, 2)
        draws, drawn = random.Random(1_000_003 + i), []
        for _ in range(3):
            drawn.append(discrete.stochastic_map(t, s, q, draws))
        for j, n in enumerate("ab"):
            assert got[i, n] == pytest.approx((sum(d[j] for d, _ in drawn) / 3, sum(c[:, j].sum() for _, c in drawn) / 3), abs=1e-6)
