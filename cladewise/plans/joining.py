"""Trees from distance tables, one table per group."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from cladewise.sources.newick import Node, dump

TIE = 1e-12


def square(rows: pd.DataFrame) -> tuple[list[str], np.ndarray]:
    """Names in order and the symmetric matrix of a (left, right, distance) table."""
    names = sorted(set(rows["left"]) | set(rows["right"]))
    at = {x: i for i, x in enumerate(names)}
    d = np.zeros((len(names), len(names)))
    i, j = rows["left"].map(at).to_numpy(), rows["right"].map(at).to_numpy()
    d[i, j] = d[j, i] = rows["distance"].to_numpy(float)
    return names, d


def impute_mean(d: np.ndarray) -> np.ndarray:
    """Undefined distances, in order of the pairs, become the mean of those defined by then."""
    d = d.copy()
    n = len(d)
    for i in range(n):
        for j in range(i + 1, n):
            if np.isnan(d[i, j]):
                known = d[np.triu_indices(n, 1)]
                known = known[~np.isnan(known)]
                d[i, j] = d[j, i] = known.mean() if len(known) else 0.0
    return d


def _pick(score: np.ndarray, keys: list[tuple[str, ...]], largest: bool) -> tuple[int, int]:
    """The pair with the least score; ties by the smallest (or largest) keys."""
    best = score[np.triu_indices(len(score), 1)].min()
    ties = [(keys[i], keys[j], i, j) if keys[i] < keys[j] else (keys[j], keys[i], j, i) for i in range(len(score)) for j in range(i + 1, len(score)) if score[i, j] <= best + TIE]
    chosen = max(ties) if largest else min(ties)
    return chosen[2], chosen[3]


def neighbor_joining(names: list[str], d: np.ndarray, *, weighted: bool = False) -> Node:
    """Neighbor joining; ``weighted`` reduces by the variances of BIONJ."""
    d, v = d.astype(float).copy(), d.astype(float).copy()
    nodes = [Node(x) for x in names]
    keys = [(x,) for x in names]
    made = 0
    clip = lambda x: 0.0 if abs(x) <= TIE else float(x)
    while len(nodes) > 3:
        n = len(nodes)
        r = d.sum(axis=1)
        q = (n - 2) * d - r[:, None] - r[None, :]
        i, j = _pick(q, keys, largest=False)
        li = d[i, j] / 2 + (r[i] - r[j]) / (2 * (n - 2))
        lj = d[i, j] - li
        rest = [k for k in range(n) if k not in (i, j)]
        share = 0.5
        if weighted and v[i, j] > 0:
            share = float(np.clip(0.5 + (v[j, rest] - v[i, rest]).sum() / (2 * (n - 2) * v[i, j]), 0, 1))
        if weighted:
            new = share * (d[i, rest] - li) + (1 - share) * (d[j, rest] - lj)
            new_v = share * v[i, rest] + (1 - share) * v[j, rest] - share * (1 - share) * v[i, j]
        else:
            new, new_v = (d[i, rest] + d[j, rest] - d[i, j]) / 2, v[i, rest]
        made += 1
        parent = Node(f"Inner{made}", children=[nodes[i], nodes[j]])
        nodes[i].length, nodes[j].length = clip(li), clip(lj)
        key = tuple(sorted(keys[i] + keys[j]))
        size = len(rest) + 1
        for old, fresh, store in ((d, new, "d"), (v, new_v, "v")):
            m = np.zeros((size, size))
            m[:-1, :-1] = old[np.ix_(rest, rest)]
            m[-1, :-1] = m[:-1, -1] = fresh
            if store == "d":
                d = m
            else:
                v = m
        nodes, keys = [nodes[k] for k in rest] + [parent], [keys[k] for k in rest] + [key]
    if len(nodes) == 3:
        for a, b, c in ((0, 1, 2), (1, 0, 2), (2, 0, 1)):
            nodes[a].length = clip((d[a, b] + d[a, c] - d[b, c]) / 2)
    elif len(nodes) == 2:
        nodes[0].length = nodes[1].length = d[0, 1] / 2
    return Node("root", children=nodes) if len(nodes) > 1 else nodes[0]


def linkage(names: list[str], d: np.ndarray, method: str = "upgma") -> tuple[Node, list[tuple[str, float, int]]]:
    """Agglomerative tree (upgma, wpgma, single, complete) and its merges (members, height, size)."""
    d = d.astype(float).copy()
    nodes, keys, heights = [Node(x) for x in names], [(x,) for x in names], [0.0] * len(names)
    merges = []
    while len(nodes) > 1:
        i, j = _pick(d, keys, largest=True)
        height = d[i, j] / 2
        nodes[i].length, nodes[j].length = height - heights[i], height - heights[j]
        rest = [k for k in range(len(nodes)) if k not in (i, j)]
        a, b = len(keys[i]), len(keys[j])
        update: dict[str, Callable[[], np.ndarray]] = {
            "upgma": lambda i=i, j=j, a=a, b=b, rest=rest: (a * d[i, rest] + b * d[j, rest]) / (a + b),
            "wpgma": lambda i=i, j=j, rest=rest: (d[i, rest] + d[j, rest]) / 2,
            "single": lambda i=i, j=j, rest=rest: np.minimum(d[i, rest], d[j, rest]),
            "complete": lambda i=i, j=j, rest=rest: np.maximum(d[i, rest], d[j, rest]),
        }
        new = update[method]()
        m = np.zeros((len(rest) + 1, len(rest) + 1))
        m[:-1, :-1] = d[np.ix_(rest, rest)]
        m[-1, :-1] = m[:-1, -1] = new
        key = tuple(sorted(keys[i] + keys[j]))
        parent = Node("", children=[nodes[i], nodes[j]])
        merges.append(("|".join(key), height, len(key)))
        d, nodes, keys, heights = m, [nodes[k] for k in rest] + [parent], [keys[k] for k in rest] + [key], [heights[k] for k in rest] + [height]
    return nodes[0], merges


METHODS = ("nj", "bionj", "upgma", "wpgma", "single", "complete")


def build(names: list[str], d: np.ndarray, method: str) -> Node:
    if method in ("nj", "bionj"):
        return neighbor_joining(names, d, weighted=method == "bionj")
    return linkage(names, d, method)[0]


def trees(distances: DataFrame, method: str = "nj") -> DataFrame:
    """(aln_id, newick, length) of each table; undefined distances are imputed by the mean."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        names, d = square(rows)
        tree = build(names, impute_mean(d), method)
        return pd.DataFrame({"aln_id": [rows["aln_id"].iloc[0]], "newick": [dump(tree)], "length": [round(sum(n.length or 0.0 for n in tree.walk()), 6)]})

    return distances.groupBy("aln_id").applyInPandas(run, "aln_id long, newick string, length double")


def merges(distances: DataFrame, method: str = "upgma") -> DataFrame:
    """(aln_id, step, members, height, size) of each merge."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        names, d = square(rows)
        _, got = linkage(names, impute_mean(d), method)
        return pd.DataFrame([(rows["aln_id"].iloc[0], i + 1, m, round(h, 9), s) for i, (m, h, s) in enumerate(got)], columns=["aln_id", "step", "members", "height", "size"])

    return distances.groupBy("aln_id").applyInPandas(run, "aln_id long, step int, members string, height double, size int")


def patristic(tree: Node) -> dict[tuple[str, str], float]:
    """Path lengths between all tips."""
    out: dict[tuple[str, str], float] = {}
    below: dict[int, list[tuple[str, float]]] = {}
    for node in tree.walk(post=True):
        if not node.children:
            below[id(node)] = [(node.name, 0.0)]
            continue
        seen: list[tuple[str, float]] = []
        for child in node.children:
            mine = [(n, x + (child.length or 0.0)) for n, x in below.pop(id(child))]
            for a, x in seen:
                for b, y in mine:
                    out[min(a, b), max(a, b)] = x + y
            seen += mine
        below[id(node)] = seen
    return out


def residuals(distances: DataFrame, method: str = "nj") -> DataFrame:
    """Observed less patristic distance: root mean square and the worst pair of each table."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        names, d = square(rows)
        d = impute_mean(d)
        fitted = patristic(build(names, d, method))
        at = {x: i for i, x in enumerate(names)}
        gaps = [(abs(d[at[a], at[b]] - x), f"{a}|{b}") for (a, b), x in fitted.items()]
        rss = sum(g * g for g, _ in gaps)
        worst = max(gaps, key=lambda g: (round(g[0], 9), g[1])) if gaps else (0.0, "")
        return pd.DataFrame({"aln_id": [rows["aln_id"].iloc[0]], "rss": [round(rss, 9)], "rmse": [round((rss / max(1, len(gaps))) ** 0.5, 9)], "worst_pair": [worst[1]]})

    return distances.groupBy("aln_id").applyInPandas(run, "aln_id long, rss double, rmse double, worst_pair string")


def bootstrap(sites: DataFrame, replicates: int = 10, method: str = "nj", seed: int = 1) -> DataFrame:
    """Support of each clade over trees of resampled columns; a replicate is a task's unit of work."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        wide = rows.pivot_table(index="taxon", columns="site", values="residue", aggfunc="first").sort_index()
        names, letters = list(wide.index), wide.to_numpy()
        codes = np.vectorize({"A": 0, "C": 1, "G": 2, "T": 3}.get, otypes=[float])(letters, np.nan)
        aln = int(rows["aln_id"].iloc[0])
        counts: dict[str, int] = {}
        for k in range(replicates):
            rng = np.random.default_rng([seed, aln, k])
            c = codes[:, rng.integers(0, codes.shape[1], codes.shape[1])]
            ok = ~np.isnan(c)
            n = (ok[:, None] & ok[None]).sum(axis=2)
            diff = ((c[:, None] != c[None]) & ok[:, None] & ok[None]).sum(axis=2)
            d = np.where(n > 0, diff / np.maximum(n, 1), np.nan)
            for clade in clades(build(names, impute_mean(d), method)):
                counts[clade] = counts.get(clade, 0) + 1
        return pd.DataFrame([(aln, c, n, n / replicates) for c, n in sorted(counts.items())], columns=["aln_id", "clade", "trees", "support"])

    return sites.groupBy("aln_id").applyInPandas(run, "aln_id long, clade string, trees int, support double")


def clades(tree: Node) -> Iterable[str]:
    """Informative rooted clades, as sorted tips joined by '|'."""
    total = sum(1 for n in tree.walk() if not n.children)
    below: dict[int, list[str]] = {}
    for node in tree.walk(post=True):
        below[id(node)] = [node.name] if not node.children else sorted(x for c in node.children for x in below[id(c)])
        if node.children and 1 < len(below[id(node)]) < total:
            yield "|".join(below[id(node)])
