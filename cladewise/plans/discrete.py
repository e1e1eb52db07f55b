"""Discrete characters on trees: Mk models, marginal states, stochastic maps and correlated traits."""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladewise.functions.special import chi2_tail, golden_section
from cladewise.plans import forest
from cladewise.plans.comparative import _grouped
from cladewise.sources.newick import Node, parse


def expm(q: np.ndarray, t: float) -> np.ndarray:
    """exp(Q t) by scaling and squaring of a Taylor series."""
    a = q * t
    squarings = max(0, math.ceil(math.log2(max(np.abs(a).sum(axis=1).max(), 1e-300))) + 4)
    a = a / 2**squarings
    out, term = np.eye(len(q)), np.eye(len(q))
    for k in range(1, 13):
        term = term @ a / k
        out = out + term
    for _ in range(squarings):
        out = out @ out
    return np.clip(out, 0, None)


def generator(kind: str, k: int, rates: np.ndarray) -> np.ndarray:
    """Rate matrix: er (one rate), sym (one per pair), ard (one per ordered pair), ordered (neighbours only)."""
    q = np.zeros((k, k))
    if kind == "er":
        q[:] = rates[0]
    elif kind == "sym":
        q[np.triu_indices(k, 1)] = rates
        q = q + q.T
    elif kind == "ard":
        q[~np.eye(k, dtype=bool)] = rates
    elif kind == "ordered":
        for i in range(k - 1):
            q[i, i + 1] = q[i + 1, i] = rates[0]
    else:
        raise ValueError(f"unknown model {kind}")
    np.fill_diagonal(q, 0)
    np.fill_diagonal(q, -q.sum(axis=1))
    return q


def parameters(kind: str, k: int) -> int:
    return {"er": 1, "ordered": 1, "sym": k * (k - 1) // 2, "ard": k * (k - 1)}[kind]


def conditionals(tree: Node, states: dict[str, int], q: np.ndarray) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray], float]:
    """(scaled conditional likelihoods, transition matrices) by node, and the summed log scale; -1 is an unknown state."""
    k = len(q)
    part: dict[int, np.ndarray] = {}
    p: dict[int, np.ndarray] = {}
    scale = 0.0
    for node in tree.walk(post=True):
        if not node.children:
            s = states.get(node.name, -1)
            v = np.ones(k) if s < 0 else np.eye(k)[s]
        else:
            v = np.ones(k)
            for c in node.children:
                p[id(c)] = expm(q, max(c.length or 0.0, 0.0))
                v = v * (p[id(c)] @ part[id(c)])
            total = v.sum()
            if total <= 0:
                return part, p, -math.inf
            scale += math.log(total)
            v = v / total
        part[id(node)] = v
    return part, p, scale


def log_likelihood(tree: Node, states: dict[str, int], q: np.ndarray, prior: np.ndarray | None = None) -> float:
    part, _, scale = conditionals(tree, states, q)
    if scale == -math.inf:
        return scale
    prior = np.full(len(q), 1 / len(q)) if prior is None else prior
    return scale + math.log(float(prior @ part[id(tree)]))


def fit(tree: Node, states: dict[str, int], k: int, kind: str = "er", sweeps: int = 4) -> tuple[np.ndarray, float]:
    """(Q, log likelihood): golden section on each rate in turn, kept where it improves."""
    n = parameters(kind, k)
    rates, best = np.full(n, 0.5), -math.inf
    if n > 1:  # from the best common rate, so a richer model fits no worse
        common, best = fit(tree, states, k, "er")
        rates = np.full(n, common[0, 1])
    for _ in range(1 if n == 1 else sweeps):
        before = best
        for i in range(n):
            def value(x: float, i: int = i) -> float:
                r = rates.copy()
                r[i] = math.exp(x)
                return log_likelihood(tree, states, generator(kind, k, r))

            x, found = golden_section(value, math.log(1e-4), math.log(50), 1e-4, 60)
            if found > best:
                rates[i], best = math.exp(x), found
        if best - before < 1e-6:
            break
    return generator(kind, k, rates), best


def marginal_states(tree: Node, states: dict[str, int], q: np.ndarray, prior: np.ndarray | None = None) -> list[tuple[str, int, np.ndarray]]:
    """(first tip, tips, probabilities) of each inner node."""
    k = len(q)
    part, p, _ = conditionals(tree, states, q)
    prior = np.full(k, 1 / k) if prior is None else prior
    label: dict[int, tuple[str, int]] = {}
    for node in tree.walk(post=True):
        label[id(node)] = (node.name, 1) if not node.children else (min(label[id(c)][0] for c in node.children), sum(label[id(c)][1] for c in node.children))
    above = {id(tree): prior}
    out = []
    for node in tree.walk():
        if not node.children:
            continue
        v = above[id(node)] * part[id(node)]
        out.append((*label[id(node)], v / v.sum()))
        messages = [p[id(c)] @ part[id(c)] for c in node.children]
        for i, c in enumerate(node.children):
            rest = above[id(node)].copy()
            for j, m in enumerate(messages):
                if j != i:
                    rest = rest * m
            up = rest @ p[id(c)]
            above[id(c)] = up / up.sum()
    return out


def _history(branches: list[tuple[int, int, float]], root: list[float], weights: dict[int, list[list[float]]], q: list[list[float]], rng: random.Random, tries: int) -> tuple[list[float], list[list[int]]]:
    """One history drawn along (parent, child, length) of branches, parents first.

    ``root`` are the root's cumulative weights, ``weights`` those of each child by the state of its parent.
    """
    k = len(q)
    every = range(k)
    moves = [list(itertools.accumulate(max(x, 0.0) for x in row)) for row in q]
    drawn = {branches[0][0] if branches else 0: rng.choices(every, cum_weights=root)[0]}
    dwell, changes = [0.0] * k, [[0] * k for _ in every]
    for parent, child, length in branches:
        start = drawn[parent]
        end = drawn[child] = rng.choices(every, cum_weights=weights[child][start])[0]
        for _ in range(tries):
            s, left, own_d, own_c = start, length, [0.0] * k, []
            while (exit_rate := -q[s][s]) > 0:
                wait = rng.expovariate(exit_rate)
                if wait >= left:
                    break
                own_d[s] += wait
                left -= wait
                nxt = rng.choices(every, cum_weights=moves[s])[0]
                own_c.append((s, nxt))
                s = nxt
            own_d[s] += left
            if s == end:
                for i in every:
                    dwell[i] += own_d[i]
                for a, b in own_c:
                    changes[a][b] += 1
                break
        else:  # too unlikely to be met by chance: one change in the middle
            dwell[start] += length / 2
            dwell[end] += length / 2
            changes[start][end] += start != end
    return dwell, changes


def stochastic_map(tree: Node, states: dict[str, int], q: np.ndarray, rng: random.Random, tries: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """(time in each state, changes from row to column) of one history drawn given the tips."""
    part, p, _ = conditionals(tree, states, q)
    branches = [(id(node), id(c), max(c.length or 0.0, 0.0)) for node in tree.walk() for c in node.children]
    weights = {c: np.cumsum(p[c] * part[c], axis=1).tolist() for _, c, _ in branches}
    dwell, changes = _history(branches, np.cumsum(part[id(tree)]).tolist(), weights, q.tolist(), rng, tries)
    return np.array(dwell), np.array(changes, float)


def _together(trees: DataFrame, rows: DataFrame, schema: str, f: Callable[[list[tuple]], Iterator[tuple]]) -> DataFrame:
    """Rows that ``f`` yields for lists of (tree_id, tree, {column: values}): trees of a batch are fitted together."""
    columns, own = [c.split()[0] for c in schema.split(", ")], [c for c in rows.columns if c != "tree_id"]
    with_rows = trees.join(rows.groupBy("tree_id").agg(F.collect_list(F.struct(*own)).alias("rows")).hint("merge"), "tree_id").select("tree_id", "newick", *(F.col(f"rows.{c}").alias(c) for c in own))
    # few bytes, much work: a number of partitions of its own, which adaptive execution does not merge
    with_rows = with_rows.repartition(4 * trees.sparkSession.sparkContext.defaultParallelism, "tree_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            given = [(i, parse(text), dict(zip(own, data, strict=True))) for i, text, *data in batch[["tree_id", "newick", *own]].itertuples(index=False, name=None)]
            yield pd.DataFrame(list(f(given)), columns=columns)

    return with_rows.mapInPandas(run, schema)


def _forests(given: list[tuple]) -> Iterator[tuple[list, list[list[str]], forest.Forest]]:
    """(tree_ids, names of states, forest) of trees with at least two states, those with as many states together."""
    by: dict[int, list[tuple]] = {}
    for tree_id, tree, data in given:
        names = sorted(set(data["state"]))
        if len(names) > 1:
            at = {x: i for i, x in enumerate(names)}
            by.setdefault(len(names), []).append((tree_id, names, (tree, {t: at[x] for t, x in zip(data["taxon"], data["state"], strict=True)})))
    for k, own in by.items():
        for part in forest.chunks([x[2] for x in own]):
            some = [own[i] for i in part]
            yield [x[0] for x in some], [x[1] for x in some], forest.Forest([x[2] for x in some], k)


def model_fits(trees: DataFrame, states: DataFrame, kinds: tuple[str, ...] = ("er", "sym", "ard")) -> DataFrame:
    """(tree_id, model, lnl, k, n), ready for ranking, from (tree_id, taxon, state)."""

    def every(given):
        for ids, _, some in _forests(given):
            rate, lnl = forest.common_rate(some)
            for kind in kinds:
                found = lnl if parameters(kind, some.k) == 1 and kind != "ordered" else forest.fits(some, kind, rate, lnl)
                yield from ((i, kind, round(float(x), 4), parameters(kind, some.k), len(s)) for i, x, (_, s) in zip(ids, found, some.trees, strict=True))

    return _together(trees, states, "tree_id long, model string, lnl double, k int, n int", every)


def ancestral(trees: DataFrame, states: DataFrame) -> DataFrame:
    """(tree_id, node, tips, state, probability) under the fitted equal-rates model."""

    def one(tree_id, tree, data):
        names = sorted(set(data["state"]))
        if len(names) < 2:
            return []
        s = {t: names.index(x) for t, x in zip(data["taxon"], data["state"], strict=True)}
        q, _ = fit(tree, s, len(names))
        return [(tree_id, f"{a}+{n}", n, names[i], round(float(x), 4)) for a, n, v in marginal_states(tree, s, q) for i, x in enumerate(v)]

    return _grouped(trees, states, "tree_id long, node string, tips int, state string, probability double", one)


def maps(trees: DataFrame, states: DataFrame, replicates: int = 20, seed: int = 1) -> DataFrame:
    """(tree_id, state, mean_time, mean_gains) over stochastic maps."""

    def every(given):
        for ids, names, some in _forests(given):
            rate, _ = forest.common_rate(some)
            q = forest.generators("er", some.k, rate[None])
            part, p, _ = some.same_conditionals(q)
            weights = np.cumsum((p * part).transpose(2, 0, 1), axis=2).tolist()
            root = np.cumsum(part[:, some.root], axis=0).T.tolist()
            first = 0
            for i, (tree_id, (tree, _)) in enumerate(zip(ids, some.trees, strict=True)):
                at = {id(node): first + j for j, node in enumerate(some.nodes[i])}
                first += len(at)
                branches = [(at[id(node)], at[id(c)], max(c.length or 0.0, 0.0)) for node in tree.walk() for c in node.children]
                own = {c: weights[c] for _, c, _ in branches}
                rng = random.Random(seed * 1_000_003 + int(tree_id))
                got = [_history(branches, root[i], own, q[:, :, i].tolist(), rng, 2000) for _ in range(replicates)]
                for s, name in enumerate(names[i]):
                    yield tree_id, name, round(sum(d[s] for d, _ in got) / replicates, 6), round(sum(row[s] for _, c in got for row in c) / replicates, 6)

    return _together(trees, states, "tree_id long, state string, mean_time double, mean_gains double", every)


def correlated(trees: DataFrame, traits: DataFrame) -> DataFrame:
    """Two binary traits (tree_id, taxon, x, y): likelihood ratio of dependent against independent change."""
    # from state (x, y) only one trait changes at a time
    moves = [(a, b) for a in range(4) for b in range(4) if bin(a ^ b).count("1") == 1]

    def every(given):
        own = []
        for tree_id, tree, data in given:
            x, y = ({t: int(v) for t, v in zip(data["taxon"], data[c], strict=True)} for c in ("x", "y"))
            if len(set(x.values())) > 1 and len(set(y.values())) > 1:
                own.append((tree_id, tree, x, y))
        for part in forest.chunks([(t, x) for _, t, x, _ in own]):
            some = [own[i] for i in part]
            alone = [forest.Forest([(t, (x, y)[i]) for _, t, x, y in some], 2) for i in (0, 1)]
            apart = sum(forest.fits(f, "ard", *forest.common_rate(f)) for f in alone)
            best = forest.dependent(forest.Forest([(t, {n: 2 * x[n] + y[n] for n in x}) for _, t, x, y in some], 4), moves)
            for (tree_id, *_), a, b in zip(some, apart.tolist(), best.tolist(), strict=True):
                lr = max(0.0, 2 * (b - a))
                yield tree_id, round(a, 4), round(b, 4), round(lr, 4), round(chi2_tail(lr, 4), 6)

    return _together(trees, traits, "tree_id long, independent double, dependent double, ratio double, p_value double", every)


def state_transitions(marginals: DataFrame) -> DataFrame:
    """The most probable state of each node, with its certainty class."""
    best = marginals.groupBy("tree_id", "node", "tips").agg(F.max(F.struct("probability", "state")).alias("b"))
    return best.select("tree_id", "node", "tips", F.col("b.state").alias("state"), F.when(F.col("b.probability") >= 0.95, "certain").when(F.col("b.probability") >= 0.7, "likely").otherwise("ambiguous").alias("certainty"))
