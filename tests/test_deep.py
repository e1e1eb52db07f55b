"""Trees from plain edges, passes over levels, structure and date randomisation against plain walks."""

from __future__ import annotations

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from cladewise import frames as fr
from cladewise.operators import deep
from cladewise.operators import trees as tree

SCHEMA = "tree_id long, node long, parent long, branch_length double"


def random_edges(tree_id, n, reach, rng):
    """Parents among the last ``reach`` nodes: a small reach makes a deep tree."""
    names = rng.sample(range(10 * n), n)
    return [(tree_id, names[0], None, None)] + [(tree_id, names[i], names[max(0, i - rng.randint(1, reach))], rng.randint(0, 8) / 4) for i in range(1, n)]


def walk(edges):
    kids, out, at = {}, {}, 0
    for t, v, p, b in edges:
        kids.setdefault((t, p), []).append((v, b or 0.0))
    for t in {e[0] for e in edges}:
        stack = [(v, 0, 0.0, None) for v, _ in sorted(kids[(t, None)], reverse=True)]
        at, order = 0, []
        while stack:
            v, level, dist, _ = stack.pop()
            at += 1
            order.append(v)
            out[(t, v)] = [level, dist, at, at, (t, v) not in kids]
            stack += [(c, level + 1, dist + b, v) for c, b in sorted(kids.get((t, v), []), reverse=True)]
        parent = {e[1]: e[2] for e in edges if e[0] == t}
        for v in reversed(order):
            if parent[v] is not None:
                up = out[(t, parent[v])]
                up[3] = max(up[3], out[(t, v)][3])
    return out


def test_node_rows_match_a_walk(spark):
    rng = random.Random(1)
    edges = random_edges(1, 1500, 1, rng) + random_edges(2, 700, 700, rng) + random_edges(3, 400, 5, rng) + [(4, 9, None, 1.0)] + [(5, 1, None, None)] + [(5, i, 1, 1.0) for i in range(2, 300)]
    want = walk(edges)
    assert max(x[0] for x in want.values()) > 1000
    rng.shuffle(edges)
    rows = deep.node_rows(spark.createDataFrame(edges, SCHEMA)).collect()
    got = {(r.tree_id, r.node): [r.level, r.root_dist, r.pre, r.post, r.is_tip] for r in rows}
    assert len(rows) == len(edges) and got == want


def test_loops_lost_parents_and_forests(spark):
    rows = [(1, 1, None, 0.0), (1, 2, 1, 1.0), (1, 3, 4, 1.0), (1, 4, 3, 1.0), (1, 5, 4, 1.0), (1, 6, 99, 1.0), (1, 7, 6, -1.0), (1, 8, None, 0.0), (1, 2, 8, 5.0), (None, 1, None, None)]
    edges = spark.createDataFrame(rows, SCHEMA)
    got = {r.node: r for r in deep.node_rows(edges.where("tree_id = 1")).collect()}
    assert {v for v in got if got[v].pre is None} == {3, 4, 5, 6, 7}
    assert [(got[v].pre, got[v].post, got[v].level) for v in (1, 2, 8)] == [(1, 2, 0), (2, 2, 1), (3, 3, 0)]
    assert sorted((r.node, r.problem) for r in deep.edge_problems(edges).collect()) == [(2, "duplicate_node"), (6, "unknown_parent"), (7, "negative_length")]
    assert deep.node_rows(edges.where("false")).count() == 0


def test_other_operators_run_over_them(spark):
    nodes = fr.frame(spark, "/root/testdata/sf0.001", fr.NODES).where("tree_id < 20").cache()
    plain = nodes.select("tree_id", F.col("name").alias("node"), "parent", "branch_length")
    # the frame's own order of siblings, as names that sort like it
    order = nodes.select("tree_id", "name", F.format_string("%06d", "pre").alias("at"))
    named = plain.join(order.select("tree_id", F.col("name").alias("node"), F.col("at").alias("a")), ["tree_id", "node"]).join(order.select("tree_id", F.col("name").alias("parent"), F.col("at").alias("b")), ["tree_id", "parent"], "left")
    made = deep.node_rows(named.select("tree_id", F.col("a").alias("node"), F.col("b").alias("parent"), "branch_length"))
    back = deep.named(made).join(order.select("tree_id", F.col("at").alias("name"), F.col("name").alias("own")), ["tree_id", "name"])
    assert sorted(back.select("tree_id", "own", "pre", "post", "level", "root_dist").collect()) == sorted(nodes.select("tree_id", "name", "pre", "post", "level", "root_dist").collect())
    for f in (tree.inspect, tree.shape, tree.ultrametricity):
        assert sorted(map(str, f(deep.named(made)).collect())) == sorted(map(str, f(nodes).collect()))


def brute_sankoff(edges, states, costs):
    """The least total over all assignments of states to inner nodes."""
    parent = {v: p for _, v, p, _ in edges}
    inner = [v for v in parent if v in set(parent.values())]
    best = math.inf
    for pick in itertools.product(sorted(costs), repeat=len(inner)):
        at = states | dict(zip(inner, pick))
        best = min(best, sum(costs[at[p]][at[v]] for v, p in parent.items() if p is not None))
    return best


def test_sankoff_equals_all_assignments(spark):
    rng = random.Random(4)
    costs = {"a": {"a": 0, "b": 1, "c": 4}, "b": {"a": 2, "b": 0, "c": 1}, "c": {"a": 3, "b": 1, "c": 0}}
    edges, states = [], []
    for t in range(25):
        e = random_edges(t, rng.randint(2, 12), rng.randint(1, 4), rng)
        inside = {p for _, _, p, _ in e}
        edges += e
        states += [(t, v, k, rng.choice("abc")) for k in ("x", "y") for _, v, _, _ in e if v not in inside]
    nodes = deep.named(deep.node_rows(spark.createDataFrame(edges, SCHEMA)))
    found = deep.sankoff(nodes, spark.createDataFrame(states, "tree_id long, name long, character string, state string"), costs)
    got = {(r.tree_id, r.character): r.cost for r in deep.sankoff_scores(found).collect()}
    want = {(t, k): brute_sankoff([e for e in edges if e[0] == t], {v: s for u, v, c, s in states if u == t and c == k}, costs) for t in range(25) for k in "xy"}
    assert got == want
    weighted = deep.sankoff_scores(found, spark.createDataFrame([("x", 2.0)], "character string, weight double")).collect()
    assert all(r.weighted_cost == r.cost * (2 if r.character == "x" else 1) for r in weighted)
    assert all(("," in r.optimal_states) == r.tie for r in found.collect())


def shuffled(edges, rng):
    """The same trees with children in another order: nodes renamed, tips keep their labels."""
    new = {}
    for t, v, _, _ in edges:
        new[(t, v)] = rng.random()
    return [(t, new[(t, v)], new.get((t, p)), b, v) for t, v, p, b in edges]


def labelled(spark, rows):
    made = deep.node_rows(spark.createDataFrame([r[:4] for r in rows], "tree_id long, node double, parent double, branch_length double"))
    labels = spark.createDataFrame([(r[0], r[1], str(r[4])) for r in rows], "tree_id long, node double, name string")
    return made.join(labels, ["tree_id", "node"]).drop("node")


def test_structure_ignores_the_order_of_children(spark):
    rng = random.Random(5)
    edges = [e for t in range(8) for e in random_edges(t, 30, 6, rng)]
    a, b = labelled(spark, shuffled(edges, rng)), labelled(spark, shuffled(edges, rng))
    assert all(r.equivalent for r in deep.compare_structure(a, b).collect())
    s = {r.tree_id: r.signature for r in deep.signatures(a, lengths=True).collect()}
    assert s == {r.tree_id: r.signature for r in deep.signatures(b, lengths=True).collect()} and len(set(s.values())) == 8
    other = b.withColumn("branch_length", F.when((F.col("tree_id") == 1) & F.col("is_tip"), F.col("branch_length") + 0.5).otherwise(F.col("branch_length")))
    other = other.withColumn("name", F.when((F.col("tree_id") == 2) & ~F.col("is_tip"), F.concat("name", F.lit("x"))).when((F.col("tree_id") == 3) & F.col("is_tip"), F.concat("name", F.lit("y"))).otherwise(F.col("name")))
    other = other.where("tree_id <> 4")
    got = {r.tree_id: r.reason for r in deep.compare_structure(a, other).collect()}
    assert got == {0: None, 1: "branch lengths differ", 2: "root label differs", 3: "tip labels differ", 4: "tree missing", 5: None, 6: None, 7: None}
    assert deep.compare_structure(a, other, tolerance=1.0).where("tree_id = 1").first().equivalent
    row = deep.compare_sets(a, other).first()
    assert (row.expected_trees, row.observed_trees, row.equivalent_pairs, row.first_different) == (8, 7, 4, 1)


def test_unrooted_splits_meet_whatever_the_root(spark):
    one = [(1, 0.0, None, None, "r"), (1, 1.0, 0.0, 1.0, "A"), (1, 2.0, 0.0, 1.0, "B"), (1, 3.0, 0.0, 1.0, "i"), (1, 4.0, 3.0, 1.0, "C"), (1, 5.0, 3.0, 1.0, "D")]
    two = [(1, 0.0, None, None, "r"), (1, 1.0, 0.0, 1.0, "C"), (1, 2.0, 0.0, 1.0, "D"), (1, 3.0, 0.0, 1.0, "i"), (1, 4.0, 3.0, 1.0, "A"), (1, 5.0, 3.0, 1.0, "B")]
    a, b = labelled(spark, one), labelled(spark, two)
    assert deep.compare_structure(a, b, rooted=False).first().equivalent
    assert deep.compare_structure(a, b, rooted=True).first().reason == "clades or splits differ"


def test_date_randomization(spark):
    rng = random.Random(6)
    rows = [(t, f"t{i}", float(i), (3.0 * i + rng.random() if t == 1 else rng.random())) for t in (1, 2) for i in range(30)] + [(3, "a", 1.0, 2.0)]
    tips = spark.createDataFrame(rows, "tree_id long, tip string, date double, distance double")
    got = {r.tree_id: r for r in deep.date_randomization(tips, 99).collect()}
    assert set(got) == {1, 2} and got[1].p_value == 0.01 and got[1].at_or_above == 0 and got[2].p_value > 0.01
    again = {r.tree_id: r for r in deep.date_randomization(tips.repartition(7, "date"), 99).collect()}
    assert again == got and got[1].null_most < got[1].r2
    with pytest.raises(ValueError):
        deep.date_randomization(tips, 1)


def test_date_randomization_sends_no_table_to_all_tasks(spark, tmp_path):
    rng = random.Random(5)
    rows = [(t, f"x{i:02d}", float(rng.randrange(9)), float(rng.randrange(50))) for t in range(20) for i in range(rng.randrange(1, 9))]
    spark.createDataFrame(rows, "tree_id long, tip string, date double, distance double").write.parquet(str(tmp_path / "tips"))
    tips = spark.read.parquet(str(tmp_path / "tips"))
    got = deep.date_randomization(tips, 3)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r.tree_id for r in got.collect()} == {r.tree_id for r in tips.groupBy("tree_id").agg(F.regr_r2("distance", "date").alias("r")).where("r is not null").collect()}
