"""Gene trees in species trees, dating, priors, and geography on trees."""

from __future__ import annotations

import math

import numpy as np

from cladewise.plans.topology import parents
from cladewise.sources.newick import Node


def _below(tree: Node) -> dict[int, frozenset[str]]:
    out: dict[int, frozenset[str]] = {}
    for node in tree.walk(post=True):
        out[id(node)] = frozenset([node.name]) if not node.children else frozenset().union(*(out[id(c)] for c in node.children))
    return out


def lca_map(gene: Node, species: Node, of: dict[str, str] | None = None) -> dict[int, Node]:
    """The smallest species clade that holds the species of each gene node."""
    of = of or {}
    s_below = _below(species)
    order = list(species.walk(post=True))
    out: dict[int, Node] = {}
    for node, names in ((n, frozenset(of.get(x, x) for x in b)) for n, b in ((n, _below(gene)[id(n)]) for n in gene.walk())):
        out[id(node)] = min((s for s in order if names <= s_below[id(s)]), key=lambda s: len(s_below[id(s)]))
    return out


def deep_coalescences(gene: Node, species: Node, of: dict[str, str] | None = None) -> int:
    """Extra gene lineages over all species branches."""
    at = lca_map(gene, species, of)
    up_g, up_s = parents(gene), parents(species)
    lineages: dict[int, int] = {}
    for node in gene.walk():
        if id(node) not in up_g:
            continue
        stop = at[id(up_g[id(node)])]
        here = at[id(node)]
        while here is not stop and id(here) in up_s:  # the lineage leaves this branch at its top
            lineages[id(here)] = lineages.get(id(here), 0) + 1
            here = up_s[id(here)]
    return sum(max(0, k - 1) for k in lineages.values())


def duplications_losses(gene: Node, species: Node, of: dict[str, str] | None = None) -> tuple[int, int]:
    """(duplications, losses) of the reconciliation by smallest clades."""
    at = lca_map(gene, species, of)
    depth = {id(species): 0}
    for node in species.walk():
        for c in node.children:
            depth[id(c)] = depth[id(node)] + 1
    duplications = losses = 0
    for node in gene.walk():
        if not node.children:
            continue
        here = at[id(node)]
        twice = any(at[id(c)] is here for c in node.children)
        duplications += twice
        for c in node.children:
            steps = depth[id(at[id(c)])] - depth[id(here)]
            losses += steps if twice else max(0, steps - 1)
    return duplications, losses


def transfer_cost(gene: Node, species: Node, of: dict[str, str] | None = None, *, duplication: float = 2.0, loss: float = 1.0, transfer: float = 3.0) -> float:
    """Least cost of an undated reconciliation with duplications, losses and transfers."""
    of = of or {}
    order = list(species.walk(post=True))
    index = {id(s): i for i, s in enumerate(order)}
    up = parents(species)
    n = len(order)
    child = [[index[id(c)] for c in s.children] for s in order]
    ancestor = np.zeros((n, n), bool)  # [i, j]: i is j or above it
    for j, s in enumerate(order):
        while True:
            ancestor[index[id(s)], j] = True
            if id(s) not in up:
                break
            s = up[id(s)]
    apart = ~(ancestor | ancestor.T)

    def settle(c: np.ndarray) -> np.ndarray:
        """With losses: a lineage may pass to one child while the other loses it."""
        c = c.copy()
        for i in range(n):  # children come first
            for k in child[i]:
                c[i] = min(c[i], c[k] + loss * (len(child[i]) - 1))
        return c

    cost: dict[int, np.ndarray] = {}
    for node in gene.walk(post=True):
        if not node.children:
            c = np.full(n, np.inf)
            c[next(index[id(s)] for s in order if not s.children and s.name == of.get(node.name, node.name))] = 0
        else:
            left = cost.pop(id(node.children[0]))
            for other in node.children[1:]:
                right = cost.pop(id(other))
                c = left + right + duplication
                for i in range(n):
                    for a in child[i]:
                        for b in child[i]:
                            if a != b:
                                c[i] = min(c[i], left[a] + right[b] + loss * (len(child[i]) - 2))
                    far_r = right[apart[i]].min() if apart[i].any() else np.inf
                    far_l = left[apart[i]].min() if apart[i].any() else np.inf
                    c[i] = min(c[i], left[i] + far_r + transfer, right[i] + far_l + transfer)
                left = settle(c)
            c = left
        cost[id(node)] = settle(c)
    return float(cost[id(gene)].min())


# Dating


def calibration_bounds(tree: Node, calibrations: list[tuple[frozenset[str], float, float]]) -> list[tuple[str, float, float, bool]]:
    """(clade, least, most, contradiction) of inner nodes, with bounds passed up and down the tree."""
    below = _below(tree)
    inner = [n for n in tree.walk() if n.children]
    low, high = {id(n): 0.0 for n in inner}, {id(n): math.inf for n in inner}
    for names, a, b in calibrations:
        node = min((n for n in inner if names <= below[id(n)]), key=lambda n: len(below[id(n)]))
        low[id(node)], high[id(node)] = max(low[id(node)], a), min(high[id(node)], b)
    for node in reversed(inner):
        for c in node.children:
            if c.children:
                low[id(node)] = max(low[id(node)], low[id(c)])
    for node in inner:
        for c in node.children:
            if c.children:
                high[id(c)] = min(high[id(c)], high[id(node)])
    return [("|".join(sorted(below[id(n)])), low[id(n)], high[id(n)], low[id(n)] > high[id(n)]) for n in inner]


def least_squares_dates(tree: Node, dates: dict[str, float]) -> tuple[float, float, float]:
    """(rate, root date, residual sum of squares) of root-to-tip distance on date."""
    dist: dict[int, float] = {id(tree): 0.0}
    x, y = [], []
    for node in tree.walk():
        for c in node.children:
            dist[id(c)] = dist[id(node)] + (c.length or 0.0)
        if not node.children and node.name in dates:
            x.append(dates[node.name])
            y.append(dist[id(node)])
    xs, ys = np.array(x), np.array(y)
    sxx = ((xs - xs.mean()) ** 2).sum()
    rate = float(((xs - xs.mean()) * (ys - ys.mean())).sum() / sxx) if sxx > 0 else 0.0
    icept = ys.mean() - rate * xs.mean()
    return rate, float(-icept / rate) if rate else math.nan, float(((ys - icept - rate * xs) ** 2).sum())


# Priors on trees and parameters


def node_ages(tree: Node) -> list[float]:
    """Ages of inner nodes, oldest first, from the largest root-to-tip distance."""
    dist = {id(tree): 0.0}
    for node in tree.walk():
        for c in node.children:
            dist[id(c)] = dist[id(node)] + (c.length or 0.0)
    height = max(dist.values())
    return sorted((height - dist[id(n)] for n in tree.walk() if n.children), reverse=True)


def yule_log_prior(tree: Node, birth: float) -> float:
    """Density of the waiting times between branchings, conditioned on the root."""
    ages = node_ages(tree)
    gaps = [a - b for a, b in zip(ages, [*ages[1:], 0.0], strict=True)]
    return sum(math.log(birth * k) - birth * k * g for k, g in zip(range(2, len(ages) + 1), gaps, strict=False)) - birth * (len(ages) + 1) * gaps[-1]


def coalescent_log_prior(tree: Node, population: float) -> float:
    """Kingman's coalescent with one population size."""
    ages = sorted(node_ages(tree))
    n, last, out = len(ages) + 1, 0.0, 0.0
    for age in ages:
        pairs = n * (n - 1) / 2
        out += -math.log(population) - pairs * (age - last) / population
        n, last = n - 1, age
    return out


def topology_log_prior(n: int) -> float:
    """All rooted labelled binary topologies alike."""
    return -sum(math.log(k) for k in range(3, 2 * n - 2, 2))


def log_density(kind: str, x: float, a: float, b: float = 1.0) -> float:
    """Exponential (rate), gamma (shape, rate), lognormal (mean, deviation), normal, or uniform (from, to)."""
    if kind == "exponential":
        return math.log(a) - a * x if x >= 0 else -math.inf
    if kind == "gamma":
        return a * math.log(b) - math.lgamma(a) + (a - 1) * math.log(x) - b * x if x > 0 else -math.inf
    if kind == "lognormal":
        return -math.log(x * b * math.sqrt(2 * math.pi)) - (math.log(x) - a) ** 2 / (2 * b * b) if x > 0 else -math.inf
    if kind == "normal":
        return -math.log(b * math.sqrt(2 * math.pi)) - (x - a) ** 2 / (2 * b * b)
    if kind == "uniform":
        return -math.log(b - a) if a <= x <= b else -math.inf
    raise ValueError(f"unknown density {kind}")


def branch_length_log_prior(tree: Node, kind: str, a: float, b: float = 1.0) -> float:
    return sum(log_density(kind, n.length or 0.0, a, b) for n in tree.walk() if n is not tree)


def relaxed_clock_log_prior(rates: list[float], mean: float, deviation: float) -> float:
    return sum(log_density("lognormal", r, mean, deviation) for r in rates)
