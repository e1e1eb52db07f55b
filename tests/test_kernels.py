"""Kernels against hand-worked values and invariants."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cladewise.functions import special
from cladewise.plans import comparative as pc
from cladewise.plans import joining, likelihood, parsimony, sampling
from cladewise.sources.newick import NewickError, Node, dump, node_rows, parse


def test_newick_canonical():
    assert dump(parse("((D:0.3,C:0.4):1e0,(B,'A b':2)x:3)r:5;")) == "(('A b':2,B)x:3,(C:0.4,D:0.3):1)r;"


@pytest.mark.parametrize("text", ["", "(A,B", "(A,B))", "(A,B);(C);", "(A:x,B);", "A,B;", "('A,B);", "[x(A,B);"])
def test_newick_errors(text):
    with pytest.raises(NewickError):
        parse(text)


def _random_tree(n: int, seed: int) -> Node:
    return sampling.coalescent([f"t{i}" for i in range(n)], 1.0, random.Random(seed))


@settings(max_examples=25, deadline=None)
@given(st.integers(2, 12), st.integers(0, 10_000))
def test_newick_roundtrip_and_intervals(n, seed):
    tree = _random_tree(n, seed)
    text = dump(tree)
    assert dump(parse(text)) == text
    rows = node_rows(parse(text))
    tips = sorted(r["name"] for r in rows if r["is_tip"])
    root = rows[0]
    assert tips == sorted(r["name"] for r in rows if root["pre"] <= r["pre"] <= root["post"] and r["is_tip"])
    assert all(rows[r["parent_id"] - 1]["pre"] < r["pre"] <= r["post"] <= rows[r["parent_id"] - 1]["post"] for r in rows if r["parent_id"])


@settings(max_examples=20, deadline=None)
@given(st.integers(4, 9), st.integers(0, 10_000))
def test_joining_recovers_additive_and_ultrametric(n, seed):
    tree = _random_tree(n, seed)
    want = joining.patristic(tree)
    names = sorted({x for p in want for x in p})
    d = np.zeros((n, n))
    for (a, b), x in want.items():
        i, j = names.index(a), names.index(b)
        d[i, j] = d[j, i] = x
    for method in joining.METHODS:  # coalescent trees are ultrametric, so all methods find the distances
        got = joining.patristic(joining.build(names, d, method))
        assert all(got[p] == pytest.approx(x, abs=1e-6) for p, x in want.items()), method


def test_linkage_ties_take_largest_key():
    d = np.array([[0, 1, 2, 2], [1, 0, 2, 2], [2, 2, 0, 1], [2, 2, 1, 0]], float)
    assert joining.linkage(list("ABCD"), d)[1][0][0] == "C|D"
    assert joining._pick(d + np.eye(4) * 9, [("A",), ("B",), ("C",), ("D",)], largest=False) == (0, 1)


def _brute_steps(tree: Node, states: dict[str, str]) -> int:
    inner = [n for n in tree.walk() if n.children]
    letters = sorted(set(states.values()))
    best = 10**9
    for choice in itertools.product(letters, repeat=len(inner)):
        of = {id(n): s for n, s in zip(inner, choice, strict=True)}
        best = min(best, sum((of[id(c)] if c.children else states[c.name]) != of[id(n)] for n in inner for c in n.children))
    return best


@settings(max_examples=30, deadline=None)
@given(st.integers(3, 6), st.integers(0, 10_000))
def test_parsimony_against_all_histories(n, seed):
    tree = _random_tree(n, seed)
    rng = random.Random(seed)
    states = {f"t{i}": rng.choice("abc") for i in range(n)}
    want = _brute_steps(tree, states)
    letters = sorted(set(states.values()))
    assert parsimony.fitch(tree, states)[0] == want
    cost = 1.0 - np.eye(len(letters))
    assert parsimony.sankoff(tree, states, cost, letters)[0] == want
    binary = {k: "1" if v == "a" else "0" for k, v in states.items()}
    gains, losses = parsimony.dollo(tree, binary)
    assert gains + losses >= parsimony.fitch(tree, binary)[0] and parsimony.camin_sokal(tree, binary) >= parsimony.fitch(tree, binary)[0]
    for fast in (True, False):
        history = parsimony.transformation(tree, states, accelerated=fast)
        assert len(history) == 2 * n - 1


def test_likelihood_two_taxa_closed_form():
    tree = parse("(A:0.1,B:0.2);")
    codes = np.array([[0, 0, 1], [0, 1, 1]])
    pi = np.full(4, 0.25)
    got = likelihood.log_likelihoods(tree, likelihood.Process(likelihood.rate_matrix("jc69", pi), pi), codes, ["A", "B"])
    e = math.exp(-4 / 3 * 0.3)
    same, other = 0.25 * (0.25 + 0.75 * e), 0.25 * (0.25 - 0.25 * e)
    assert got == pytest.approx([math.log(same), math.log(other), math.log(same)])


def test_rows_of_transition_matrices_sum_to_one():
    pi = np.array([0.1, 0.2, 0.3, 0.4])
    for model in ("jc69", "k80", "f81", "hky85", "gtr"):
        base = np.full(4, 0.25) if model in ("jc69", "k80") else pi
        p = likelihood.Process(likelihood.rate_matrix(model, base, 3.0, (1, 2, 3, 4, 5, 6)), base)
        assert p.p(0.7).sum(axis=1) == pytest.approx(np.ones(4))
        assert base @ p.p(5.0) == pytest.approx(base)


def test_special_functions():
    assert special.regularised_incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248)
    assert special.regularised_lower_gamma(1, 2) == pytest.approx(1 - math.exp(-2))
    assert special.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert special.student_t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05)
    assert special.discrete_gamma(0.5, 4).mean() == pytest.approx(1)
    assert special.golden_section(lambda x: -((x - 2) ** 2), 0, 5)[0] == pytest.approx(2, abs=1e-6)


def test_comparative_agree_with_dense_algebra():
    tree = _random_tree(8, 3)
    names, v = pc.covariance(tree)
    x = sampling.brownian(tree, 1.0, np.random.default_rng(1))
    values = np.array([x[n] for n in names])
    rate = np.mean(np.square(pc.contrasts(tree, x)))
    fit = pc.gls(np.ones((8, 1)), values, v)
    assert rate == pytest.approx(fit["quad"] / 7)  # squared contrasts are the generalised sum of squares
    root = next(m for a, n, m, _ in pc.ancestral_states(tree, x) if n == 8)
    assert root == pytest.approx(fit["beta"][0])
    assert pc.blombergs_k(values, np.eye(8)) == pytest.approx(1.0)


def test_mk_two_tips():
    tree = parse("(A:1,B:1);")
    t, r = 2.0, 0.3
    same = (1 + math.exp(-2 * r * t)) / 2
    assert pc.mk_log_likelihood(tree, {"A": 0, "B": 0}, 2, r) == pytest.approx(math.log(0.5 * same))


def test_sampler_finds_the_mean():
    got = sampling.metropolis_hastings(lambda m: -((m - 3) ** 2) / 2, 0.0, 2.0, 4000, 5)
    assert np.mean([v for _, v, _, _ in got[500:]]) == pytest.approx(3, abs=0.2)
    assert got == sampling.metropolis_hastings(lambda m: -((m - 3) ** 2) / 2, 0.0, 2.0, 4000, 5)


def test_birth_death_has_the_tips_it_should():
    for seed in range(10):
        tree = sampling.birth_death(7, 1.0, 0.5, random.Random(seed))
        tips = [n for n in tree.walk() if not n.children]
        assert len(tips) == 7 and all(len(n.children) != 1 for n in tree.walk())
