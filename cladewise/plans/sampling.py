"""Simulation and Markov chain Monte Carlo; one replicate or chain per group, each with its own seed."""

from __future__ import annotations

import math
import random
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from cladewise.plans.likelihood import BASES, Process, rate_matrix
from cladewise.sources.newick import Node, dump, parse


def birth_death(n: int, birth: float, death: float, rng: random.Random, retries: int = 128) -> Node:
    """A tree of ``n`` extant tips: exponential waits, extinct lineages pruned; starts anew if all die."""
    for _ in range(retries):
        root = Node(length=0.0)
        alive = [root]
        while alive and len(alive) < n:
            wait = rng.expovariate((birth + death) * len(alive))
            for x in alive:
                x.length = (x.length or 0.0) + wait
            at = alive.pop(rng.randrange(len(alive)))
            if rng.random() < birth / (birth + death):
                at.children = [Node(length=0.0), Node(length=0.0)]
                alive += at.children
            else:
                at.name = "extinct"
        if len(alive) == n:
            wait = rng.expovariate((birth + death) * n)
            for i, x in enumerate(alive):
                x.length = (x.length or 0.0) + wait
                x.name = f"t{i + 1}"
            return _without_extinct(root)
    raise RuntimeError("every attempt died out")


def _without_extinct(root: Node) -> Node:
    for node in root.walk(post=True):
        kept = []
        for c in node.children:
            if not c.children and c.name in ("extinct", ""):
                continue
            if len(c.children) == 1:
                only = c.children[0]
                only.length = (only.length or 0.0) + (c.length or 0.0)
                c = only
            kept.append(c)
        node.children = kept
    while len(root.children) == 1:
        root = root.children[0]
    return root


def coalescent(names: list[str], population: float, rng: random.Random) -> Node:
    """Kingman's coalescent."""
    nodes = [Node(x, 0.0) for x in names]
    age = {id(x): 0.0 for x in nodes}
    now = 0.0
    while len(nodes) > 1:
        k = len(nodes)
        now += rng.expovariate(k * (k - 1) / 2 / population)
        a = nodes.pop(rng.randrange(len(nodes)))
        b = nodes.pop(rng.randrange(len(nodes)))
        a.length, b.length = now - age[id(a)], now - age[id(b)]
        up = Node("", 0.0, [a, b])
        age[id(up)] = now
        nodes.append(up)
    return nodes[0]


def brownian(tree: Node, rate: float, rng: np.random.Generator, *, alpha: float = 0.0, root: float = 0.0) -> dict[str, float]:
    """Trait values of the tips; with ``alpha``, an Ornstein-Uhlenbeck process around the root value."""
    value = {id(tree): root}
    out = {}
    for node in tree.walk():
        for c in node.children:
            t = max(c.length or 0.0, 0.0)
            if alpha:
                mean = root + (value[id(node)] - root) * math.exp(-alpha * t)
                sd = math.sqrt(rate * (1 - math.exp(-2 * alpha * t)) / (2 * alpha))
            else:
                mean, sd = value[id(node)], math.sqrt(rate * t)
            value[id(c)] = mean + sd * rng.standard_normal()
        if not node.children:
            out[node.name] = value[id(node)]
    return out


def discrete_history(tree: Node, q: np.ndarray, rng: random.Random, root: int = 0) -> tuple[dict[str, int], int]:
    """Tip states and the number of changes of a chain run along every branch."""
    state = {id(tree): root}
    changes = 0
    out = {}
    for node in tree.walk():
        for c in node.children:
            s, left = state[id(node)], max(c.length or 0.0, 0.0)
            while (exit_rate := -q[s, s]) > 0:
                wait = rng.expovariate(exit_rate)
                if wait > left:
                    break
                left -= wait
                s = rng.choices([k for k in range(len(q)) if k != s], [q[s, k] for k in range(len(q)) if k != s])[0]
                changes += 1
            state[id(c)] = s
        if not node.children:
            out[node.name] = state[id(node)]
    return out, changes


def dna(tree: Node, sites: int, process: Process, rng: np.random.Generator) -> dict[str, str]:
    state = {id(tree): rng.choice(4, sites, p=process.pi)}
    out = {}
    for node in tree.walk():
        for c in node.children:
            p = process.p(max(c.length or 0.0, 0.0)).cumsum(axis=1)
            state[id(c)] = (rng.random(sites)[:, None] > p[state[id(node)]] / p[state[id(node)], -1:]).sum(axis=1).clip(0, 3)
        if not node.children:
            out[node.name] = "".join(BASES[k] for k in state[id(node)])
    return out


def metropolis_hastings(log_posterior: Callable[[float], float], start: float, scale: float, steps: int, seed: int, every: int = 1) -> list[tuple[int, float, float, bool]]:
    """(step, value, log posterior, accepted): accepts if the log ratio is 0 or more, else if ln U does not exceed it."""
    rng = random.Random(seed)
    x, score, out = start, log_posterior(start), []
    for step in range(1, steps + 1):
        y = x + rng.gauss(0, scale)
        other = log_posterior(y)
        ratio = other - score
        accepted = math.isfinite(other) and (ratio >= 0 or math.log(1 - rng.random()) <= ratio)
        if accepted:
            x, score = y, other
        if step % every == 0:
            out.append((step, x, score, accepted))
    return out


def mean_chains(data: DataFrame, steps: int = 200, seed: int = 1) -> DataFrame:
    """A chain for the mean of each group (chain, value), normal with the group's own deviation, prior N(0, 100^2).

    The data enter through their count, mean and deviation, which Spark adds up; a task runs
    the chain from those three numbers.
    """
    from pyspark.sql import functions as F

    stats = data.groupBy("chain").agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.coalesce(F.stddev_samp("value"), F.lit(1.0)).alias("s"))

    def run(rows):
        for batch in rows:
            out = []
            for chain, n, m, s in batch.itertuples(index=False):
                s = s or 1.0
                post = lambda mu, n=n, m=m, s=s: -n * (mu - m) ** 2 / (2 * s * s) - mu * mu / 2e4
                got = metropolis_hastings(post, 0.0, 2.4 * s / math.sqrt(max(n, 1)), steps, seed + int(chain))
                out += [(chain, i, v, lp, a) for i, v, lp, a in got]
            yield pd.DataFrame(out, columns=["chain", "iteration", "value", "log_posterior", "accepted"])

    return stats.mapInPandas(run, "chain long, iteration int, value double, log_posterior double, accepted boolean")


def simulate_traits(trees: DataFrame, rate: float = 1.0, alpha: float = 0.0, seed: int = 1) -> DataFrame:
    """(tree_id, taxon, value) along each tree (tree_id, newick)."""

    def run(batches):
        for batch in batches:
            rows = []
            for tree_id, text in zip(batch["tree_id"], batch["newick"], strict=True):
                got = brownian(parse(text), rate, np.random.default_rng([seed, int(tree_id)]), alpha=alpha)
                rows += [(tree_id, t, round(v, 9)) for t, v in sorted(got.items())]
            yield pd.DataFrame(rows, columns=["tree_id", "taxon", "value"])

    return trees.select("tree_id", "newick").mapInPandas(run, "tree_id long, taxon string, value double")


def simulate_dna(trees: DataFrame, sites: int = 100, model: str = "jc69", seed: int = 1) -> DataFrame:
    """(aln_id, taxon, seq) along each tree (tree_id, newick)."""

    def run(batches):
        pi = np.full(4, 0.25)
        process = Process(rate_matrix(model, pi), pi)
        for batch in batches:
            rows = []
            for tree_id, text in zip(batch["tree_id"], batch["newick"], strict=True):
                rows += [(tree_id, t, s) for t, s in sorted(dna(parse(text), sites, process, np.random.default_rng([seed, int(tree_id)])).items())]
            yield pd.DataFrame(rows, columns=["aln_id", "taxon", "seq"])

    return trees.select("tree_id", "newick").mapInPandas(run, "aln_id long, taxon string, seq string")


def simulate_trees(seeds: DataFrame, birth: float = 1.0, death: float = 0.2) -> DataFrame:
    """(tree_id, tips, newick): a birth-death tree with ``tips`` extant tips for each row (tree_id, tips)."""

    def run(batches):
        for batch in batches:
            out = [(i, n, dump(birth_death(int(n), birth, death, random.Random(int(i))))) for i, n in zip(batch["tree_id"], batch["tips"], strict=True)]
            yield pd.DataFrame(out, columns=["tree_id", "tips", "newick"])

    return seeds.select("tree_id", "tips").mapInPandas(run, "tree_id long, tips int, newick string")


def simulate_histories(trees: DataFrame, states: int = 3, rate: float = 0.5, seed: int = 1) -> DataFrame:
    """(tree_id, taxon, state, changes) of a symmetric chain along each tree."""

    def run(batches):
        q = np.full((states, states), rate)
        np.fill_diagonal(q, -rate * (states - 1))
        for batch in batches:
            rows = []
            for tree_id, text in zip(batch["tree_id"], batch["newick"], strict=True):
                tips, changes = discrete_history(parse(text), q, random.Random(seed * 1_000_003 + int(tree_id)))
                rows += [(tree_id, t, s, changes) for t, s in sorted(tips.items())]
            yield pd.DataFrame(rows, columns=["tree_id", "taxon", "state", "changes"])

    return trees.select("tree_id", "newick").mapInPandas(run, "tree_id long, taxon string, state int, changes int")
