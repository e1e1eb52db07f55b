"""Branch lengths of fixed topologies by least squares, and balanced minimum evolution."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from cladewise.plans.joining import build, impute_mean, square
from cladewise.plans.topology import nni_neighbors, unroot
from cladewise.sources.newick import Node, parse


def design(tree: Node) -> tuple[list[tuple[str, str]], np.ndarray, list[Node]]:
    """(pairs of tips, pairs x branches incidence of the path between them, branches)."""
    edges = [n for n in tree.walk() if n is not tree]
    names = sorted(n.name for n in tree.walk() if not n.children)
    under = np.array([[x in {t.name for t in e.walk() if not t.children} for x in names] for e in edges])
    pairs = list(itertools.combinations(range(len(names)), 2))
    a = np.array([[under[e, i] != under[e, j] for e in range(len(edges))] for i, j in pairs], float)
    return [(names[i], names[j]) for i, j in pairs], a, edges


def nonnegative(a: np.ndarray, b: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Active-set least squares with x >= 0."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    for _ in range(rounds):
        gradient = a.T @ (b - a @ x)
        if passive.all() or gradient[~passive].max(initial=0) <= 1e-10:
            break
        passive[np.where(~passive, gradient, -np.inf).argmax()] = True
        while True:
            z = np.zeros(n)
            z[passive] = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            if z[passive].min() > 0:
                x = z
                break
            low = passive & (z <= 0)
            step = (x[low] / (x[low] - z[low] + 1e-300)).min()
            x = x + step * (z - x)
            passive &= x > 1e-12
            if not passive.any():
                break
    return x


def fit(tree: Node, names: list[str], d: np.ndarray, *, power: float = 0.0, positive: bool = False) -> tuple[float, float]:
    """(weighted residual sum of squares, total length) with weights 1 / d^power; sets the branch lengths."""
    at = {x: i for i, x in enumerate(names)}
    pairs, a, edges = design(tree)
    y = np.array([d[at[i], at[j]] for i, j in pairs])
    w = np.sqrt(1 / np.maximum(y, 1e-9) ** power) if power else np.ones(len(y))
    x = nonnegative(a * w[:, None], y * w) if positive else np.linalg.lstsq(a * w[:, None], y * w, rcond=None)[0]
    for e, v in zip(edges, x, strict=True):
        e.length = float(v)
    r = (y - a @ x) * w
    return float(r @ r), float(x.sum())


def balanced_minimum_evolution(tree: Node, names: list[str], d: np.ndarray) -> float:
    """Sum over pairs of d times 2^-(inner nodes between them), on the unrooted tree."""
    t = unroot(tree)
    at = {x: i for i, x in enumerate(names)}
    total = 0.0
    below: dict[int, list[tuple[str, int]]] = {}
    for node in t.walk(post=True):
        if not node.children:
            below[id(node)] = [(node.name, 0)]
            continue
        seen: list[tuple[str, int]] = []
        for c in node.children:
            mine = [(n, k + (1 if c.children else 0)) for n, k in below.pop(id(c))]
            for x, k in seen:
                for y, m in mine:
                    total += d[at[x], at[y]] * 0.5 ** (k + m + 1)
            seen += mine
        below[id(node)] = seen
    return round(total, 12)


def fits(distances: DataFrame) -> DataFrame:
    """(aln_id, method, rss, length) of OLS, Fitch-Margoliash and non-negative fits on the joined tree, and its balanced score."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        names, d = square(rows)
        d = impute_mean(d)
        tree = build(names, d, "nj")
        aln = int(rows["aln_id"].iloc[0])
        out = [(aln, m, *(round(v, 9) for v in fit(tree, names, d, **k))) for m, k in (("ols", {}), ("fitch_margoliash", {"power": 2.0}), ("nonnegative", {"positive": True}))]
        out.append((aln, "balanced", None, round(balanced_minimum_evolution(tree, names, d), 9)))
        return pd.DataFrame(out, columns=["aln_id", "method", "rss", "length"])

    return distances.groupBy("aln_id").applyInPandas(run, "aln_id long, method string, rss double, length double")


def search(distances: DataFrame, steps: int = 20) -> DataFrame:
    """(aln_id, start, score, steps): balanced minimum evolution by interchanges from the clustering tree."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        names, d = square(rows)
        d = impute_mean(d)
        tree = build(names, d, "upgma")
        start = now = balanced_minimum_evolution(tree, names, d)
        taken = 0
        for _ in range(steps):
            options = [(balanced_minimum_evolution(t, names, d), i, t) for i, t in enumerate(nni_neighbors(tree))]
            if not options or min(options)[0] >= now - 1e-12:
                break
            now, _, tree = min(options, key=lambda o: o[:2])
            taken += 1
        return pd.DataFrame({"aln_id": [int(rows["aln_id"].iloc[0])], "start": [start], "score": [now], "steps": [taken]})

    return distances.groupBy("aln_id").applyInPandas(run, "aln_id long, start double, score double, steps int")


def influence(distances: DataFrame, method: str = "nj") -> DataFrame:
    """(aln_id, taxon, rss, change): residuals without each taxon in turn."""

    def rss(names: list[str], d: np.ndarray) -> float:
        return fit(parse_like(build(names, d, method)), names, d)[0]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        names, d = square(rows)
        d = impute_mean(d)
        whole = rss(names, d)
        out = []
        for i, n in enumerate(names):
            keep = [j for j in range(len(names)) if j != i]
            less = rss([names[j] for j in keep], d[np.ix_(keep, keep)])
            out.append((int(rows["aln_id"].iloc[0]), n, round(less, 9), round(less - whole, 9)))
        return pd.DataFrame(out, columns=["aln_id", "taxon", "rss", "change"])

    return distances.groupBy("aln_id").applyInPandas(run, "aln_id long, taxon string, rss double, change double")


def parse_like(tree: Node) -> Node:
    from cladewise.sources.newick import dump

    return parse(dump(tree))
