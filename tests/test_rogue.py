"""Leaving out one taxon against a recomputation from scratch."""

from __future__ import annotations

import itertools
import random

import pytest

from cladewise.operators.rogue import drop_one_taxon

CLADE, TREE, TAXON = "tree_id long, clade string", "tree_id long", "taxon string"


def random_tree(tips, rng, most):
    """Clades of a random rooted tree; ``most`` children a node."""
    nodes, out = [frozenset([t]) for t in tips], set()
    while len(nodes) > 1:
        take = rng.sample(nodes, min(len(nodes), rng.randint(2, most)))
        up = frozenset().union(*take)
        nodes = [n for n in nodes if n not in take] + [up]
        out.add(up)
    return frozenset(c for c in out if 1 < len(c) < len(tips))


def figures(trees, n, threshold):
    counts = {}
    for c in itertools.chain.from_iterable(trees):
        counts[c] = counts.get(c, 0) + 1
    sure = [100 * k / len(trees) for k in counts.values() if k / len(trees) >= threshold]
    far = [len(a ^ b) / (len(a) + len(b)) if a or b else 0.0 for a, b in itertools.combinations(trees, 2)]
    shapes = {t: trees.count(t) for t in trees}
    return len(sure) / max(n - 2, 1), sum(sure) / len(sure) if sure else 0.0, sum(far) / len(far) if far else 0.0, len(shapes), max(shapes.values()) / len(trees)


def without(tree, x, n):
    return frozenset(d for d in (c - {x} for c in tree) if 1 < len(d) < n - 1)


def frames(spark, trees, tips):
    rows = [(i, "|".join(sorted(c))) for i, t in enumerate(trees) for c in t]
    return spark.createDataFrame(rows + rows[:3], CLADE), spark.createDataFrame([(i,) for i in range(len(trees))] * 2, TREE), spark.createDataFrame([(x,) for x in tips], TAXON)


@pytest.mark.parametrize("n, count, most, threshold, seed", [(5, 12, 2, 0.5, 1), (7, 25, 4, 0.4, 2), (4, 30, 4, 0.3, 3), (9, 6, 9, 0.2, 4), (6, 40, 3, 0.1, 5)])
def test_equals_recomputation(spark, n, count, most, threshold, seed):
    rng = random.Random(seed)
    tips = [f"t{i}" for i in range(n)]
    trees = [random_tree(tips, rng, most) for _ in range(count)]
    trees += trees[: count // 3]
    got = drop_one_taxon(*frames(spark, trees, tips), threshold).collect()
    names = ("resolution", "support", "distance", "topologies", "dominant")
    want = {}
    for x in tips:
        before, after = figures(trees, n, threshold), figures([without(t, x, n) for t in trees], n - 1, threshold)
        want[x] = (before, after)
    assert {r.taxon for r in got} == set(tips)
    for r in got:
        assert [r[f"baseline_{k}"] for k in names] == pytest.approx(want[r.taxon][0], abs=2e-9)
        assert [r[f"pruned_{k}"] for k in names] == pytest.approx(want[r.taxon][1], abs=2e-9)
        assert r.distance_gain == pytest.approx(r.baseline_distance - r.pruned_distance, abs=2e-9)
    order = sorted(got, key=lambda r: (-r.resolution_gain, -r.support_gain, -r.distance_gain, r.pruned_distance, r.taxon))
    assert [r.rank for r in order] == list(range(1, n + 1))


def test_a_wandering_taxon_comes_first(spark):
    """Four trees agree on ((a,b),(c,d)) but r sits somewhere else in each: without it all clades are in all trees."""
    trees = [{"a|r", "a|b|r", "c|d"}, {"b|r", "a|b|r", "c|d"}, {"c|r", "c|d|r", "a|b"}, {"d|r", "c|d|r", "a|b"}]
    clades = spark.createDataFrame([(i, c) for i, t in enumerate(trees) for c in t], CLADE)
    lengths = spark.createDataFrame([("r", 1.0), ("r", 2.0), ("a", 3.0)], "taxon string, branch_length double")
    rows = drop_one_taxon(clades, spark.createDataFrame([(i,) for i in range(4)], TREE), spark.createDataFrame([(x,) for x in "abcdr"], TAXON), 0.6, lengths).collect()
    first = min(rows, key=lambda r: r.rank)
    assert (first.taxon, first.pruned_resolution, first.pruned_support, first.pruned_distance, first.pruned_topologies, first.pruned_dominant) == ("r", 1.0, 100.0, 0.0, 1, 1.0)
    # no clade is in more than half of the trees; four pairs of trees share one clade of three, one pair each two or none
    assert (first.baseline_resolution, first.baseline_support, first.baseline_topologies, first.baseline_dominant) == (0.0, 0.0, 4, 0.25)
    assert {r.taxon: r.mean_branch_length for r in rows} == {"r": 1.5, "a": 3.0, "b": None, "c": None, "d": None}


def test_edges(spark):
    none = spark.createDataFrame([], CLADE)
    taxa = spark.createDataFrame([(x,) for x in "abcd"] + [(None,), ("a",)], TAXON)
    assert drop_one_taxon(none, spark.createDataFrame([], TREE), taxa).count() == 0
    assert drop_one_taxon(none, spark.createDataFrame([], TREE), taxa.limit(0)).count() == 0
    stars = drop_one_taxon(spark.createDataFrame([(None, "a|b"), (1, None)], CLADE), spark.createDataFrame([(1,), (None,)], TREE), taxa).collect()
    assert sorted(r.taxon for r in stars) == list("abcd")
    assert {(r.pruned_resolution, r.pruned_support, r.pruned_distance, r.pruned_topologies, r.pruned_dominant) for r in stars} == {(0.0, 0.0, 0.0, 1, 1.0)}
    with pytest.raises(ValueError):
        drop_one_taxon(none, spark.createDataFrame([], TREE), taxa.where("taxon < 'd'"))
    with pytest.raises(ValueError):
        drop_one_taxon(none, spark.createDataFrame([], TREE), taxa, 0.0)
