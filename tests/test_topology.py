"""Topology, reconciliation, dating and priors: invariants and hand-worked values."""

from __future__ import annotations

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cladewise.plans import joining, parsimony, reconcile, sampling, topology
from cladewise.sources.newick import dump, parse


def tree(n, seed):
    return sampling.coalescent([f"t{i}" for i in range(n)], 1.0, random.Random(seed))


@settings(max_examples=25, deadline=None)
@given(st.integers(3, 9), st.integers(0, 9999))
def test_rerooting_keeps_paths(n, seed):
    t = tree(n, seed)
    want = joining.patristic(t)
    for new in (topology.reroot_at_midpoint(t), topology.unroot(t), topology.ladderize(t), topology.reroot_on_outgroup(t, ["t0"])):
        got = joining.patristic(new)
        assert set(got) == set(want) and all(got[k] == pytest.approx(v) for k, v in want.items())


@settings(max_examples=15, deadline=None)
@given(st.integers(3, 7), st.integers(0, 9999))
def test_moves(n, seed):
    t = tree(n, seed)
    nni = {topology.signature(x) for x in topology.nni_neighbors(t)}
    spr = {topology.signature(x) for x in topology.spr_neighbors(t)}
    assert len(nni) == 2 * (n - 2) and nni <= spr and topology.signature(t) not in spr
    assert all(sorted(topology.tips(x)) == sorted(topology.tips(t)) for x in topology.spr_neighbors(t))


def test_tbr_holds_spr():
    t = tree(5, 1)
    assert {topology.signature(x) for x in topology.spr_neighbors(t)} <= {topology.signature(x) for x in topology.tbr_neighbors(t)}


def test_prune_and_collapse():
    t = parse("((A:1,B:2):1,(C:1,(D:1,E:1):0.01):3);")
    assert dump(topology.keep_tips(t, ["A", "D", "E"])) == "(A:2,(D:1,E:1):3.01);"
    assert dump(topology.collapse_short(t, 0.1)) == "((A:1,B:2):1,(C:1,D:1.01,E:1.01):3);"


def test_extended_consensus():
    t, blocked = topology.extended_consensus(list("ABCD"), {"A|B": 3, "B|C": 2, "C|D": 1}, 5)
    assert dump(t) == "((A,B),(C,D));" and blocked == [("B|C", "A|B")]


def test_agreement_and_quartets():
    a, b = parse("(((A,B),C),(D,E));"), parse("(((A,B),E),(D,C));")
    assert len(topology.agreement_subtree([a, b])) == 4 - 1
    same, other, none = topology.quartet_agreement(a, b)
    assert same + other + none == 5 and topology.quartet_agreement(a, a) == (5, 0, 0)


def test_compare_branch_score():
    c = topology.compare(parse("((A:1,B:1):1,(C:1,D:1):1);"), parse("((A:1,B:3):1,(C:1,D:1):1);"))
    assert (c["distance"], c["branch_score"]) == (0, pytest.approx(2.0))
    assert topology.compare(parse("((A,B),(C,D));"), parse("((A,C),(B,D));"))["branch_score"] is None


@settings(max_examples=15, deadline=None)
@given(st.integers(3, 7), st.integers(0, 9999))
def test_reconciliation_of_a_tree_with_itself(n, seed):
    t = tree(n, seed)
    assert reconcile.deep_coalescences(t, t) == 0
    assert reconcile.duplications_losses(t, t) == (0, 0)
    assert reconcile.transfer_cost(t, t) == 0


def test_reconciliation_of_two():
    gene, species = parse("((A,C),B);"), parse("((A,B),C);")
    assert reconcile.deep_coalescences(gene, species) == 1
    d, losses = reconcile.duplications_losses(gene, species)
    assert (d, losses) == (1, 3)
    assert reconcile.transfer_cost(gene, species) <= 2 * d + losses


def test_calibrations():
    t = parse("((A,B),C);")
    rows = {c: (lo, hi, bad) for c, lo, hi, bad in reconcile.calibration_bounds(t, [(frozenset("AB"), 5, 9), (frozenset("AC"), 0, 4)])}
    assert rows["A|B"] == (5, 4, True) and rows["A|B|C"][0] == 5


def test_dates():
    rate, root, rss = reconcile.least_squares_dates(parse("(A:1,(B:1,C:2):1);"), {"A": 2001.0, "B": 2002.0, "C": 2003.0})
    assert (rate, root, rss) == (pytest.approx(1), pytest.approx(2000), pytest.approx(0, abs=1e-9))


def test_priors():
    assert reconcile.topology_log_prior(4) == pytest.approx(-math.log(15))
    assert reconcile.log_density("gamma", 1.0, 1.0, 2.0) == pytest.approx(reconcile.log_density("exponential", 1.0, 2.0))
    t = parse("((A:1,B:1):1,C:2);")
    assert reconcile.coalescent_log_prior(t, 2.0) == pytest.approx(-math.log(2) - 3 / 2 - math.log(2) - 1 / 2)


def test_searches():
    states = {"A": "0", "B": "1", "C": "0", "D": "1", "E": "1"}
    score = lambda t: parsimony.fitch(t, {n: states[n] for n in topology.tips(t)})[0]
    start = topology.random_bifurcating(list("ABCDE"), 3)
    found, steps = topology.hill_climb(start, score)
    assert 1 <= steps == score(found) <= score(start)
    assert score(topology.stepwise_addition(list("ABCDE"), score)) == 1


def test_number_of_topologies():
    seen = {topology.signature(topology.random_bifurcating(list("ABCD"), s)) for s in range(400)}
    assert len(seen) == round(math.exp(-reconcile.topology_log_prior(4)))
