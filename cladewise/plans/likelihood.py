"""Substitution models and likelihoods of alignments on trees, one alignment per group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladewise.functions.special import discrete_gamma, golden_section
from cladewise.plans.joining import build, impute_mean, square
from cladewise.sources.newick import Node, parse

BASES = "ACGT"


def rate_matrix(model: str, pi: np.ndarray, kappa: float = 2.0, rates: tuple[float, ...] = (1.0,) * 6) -> np.ndarray:
    """Q of JC69, K80, F81, HKY85 or GTR (rates AC, AG, AT, CG, CT, GT), scaled to one substitution per unit."""
    if model in ("jc69", "k80"):
        pi = np.full(4, 0.25)
    s = np.ones((4, 4))
    if model in ("k80", "hky85"):
        s[0, 2] = s[2, 0] = s[1, 3] = s[3, 1] = kappa
    elif model == "gtr":
        for (i, j), r in zip(((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)), rates, strict=True):
            s[i, j] = s[j, i] = r
    q = s * pi[None, :]
    np.fill_diagonal(q, 0)
    np.fill_diagonal(q, -q.sum(axis=1))
    return q / -(pi * np.diag(q)).sum()


class Process:
    """Transition probabilities of a reversible Q through its eigenvalues."""

    def __init__(self, q: np.ndarray, pi: np.ndarray) -> None:
        root = np.sqrt(pi)
        values, vectors = np.linalg.eigh((q * root[:, None] / root[None, :] + (q * root[:, None] / root[None, :]).T) / 2)
        self.values, self.left, self.right, self.pi = values, vectors / root[:, None], vectors.T * root[None, :], pi

    def p(self, t: float) -> np.ndarray:
        return np.clip((self.left * np.exp(self.values * t)[None, :]) @ self.right, 0, None)


def tip_vectors(pattern: str, names: list[str]) -> dict[str, np.ndarray]:
    """Known bases are unit vectors, anything else allows all."""
    return {n: np.eye(4)[BASES.index(c)] if c in BASES else np.ones(4) for n, c in zip(names, pattern, strict=True)}


def log_likelihoods(tree: Node, process: Process, columns: np.ndarray, names: list[str], rates: np.ndarray | None = None) -> np.ndarray:
    """log likelihood of each pattern (taxa x patterns of base codes, -1 unknown), by pruning with scaling."""
    rates = np.ones(1) if rates is None else rates
    at = {n: i for i, n in enumerate(names)}
    unit = np.vstack([np.eye(4), np.ones(4)])
    logs = []
    for rate in rates:
        part: dict[int, np.ndarray] = {}
        scale = np.zeros(columns.shape[1])
        for node in tree.walk(post=True):
            if not node.children:
                part[id(node)] = unit[columns[at[node.name]]]
                continue
            value = np.ones((columns.shape[1], 4))
            for child in node.children:
                value *= part.pop(id(child)) @ process.p(max(child.length or 0.0, 0.0) * rate).T
            total = value.sum(axis=1)
            with np.errstate(divide="ignore"):
                scale += np.log(total)
            part[id(node)] = value / np.where(total > 0, total, 1)[:, None]
        with np.errstate(divide="ignore"):
            logs.append(np.log(part[id(tree)] @ process.pi) + scale)
    return np.logaddexp.reduce(np.array(logs), axis=0) - np.log(len(rates))


def _patterns(rows: pd.DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(taxa, distinct columns of base codes, weights)."""
    wide = rows.pivot_table(index="taxon", columns="site", values="residue", aggfunc="first").sort_index()
    codes = np.vectorize(lambda c: BASES.find(str(c).upper()), otypes=[int])(wide.to_numpy())
    columns, weights = np.unique(codes, axis=1, return_counts=True)
    return list(wide.index), columns, weights


def p_distances(codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    ok = codes >= 0
    n = ((ok[:, None] & ok[None]) * weights).sum(axis=2)
    diff = ((codes[:, None] != codes[None]) & ok[:, None] & ok[None]) * weights
    return np.where(n > 0, diff.sum(axis=2) / np.maximum(n, 1), np.nan)


def frequencies(codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    counts = np.array([((codes == k) * weights).sum() for k in range(4)], float) + 1e-9
    return counts / counts.sum()


MODELS = {"jc69": 0, "k80": 1, "f81": 3, "hky85": 4}


def fit_models(sites: DataFrame, models: tuple[str, ...] = tuple(MODELS), categories: int = 1, alpha: float = 1.0) -> DataFrame:
    """(aln_id, model, lnl, k, n, kappa, newick): likelihood of each model on the neighbor-joining tree.

    Kappa is optimised by golden section; frequencies are observed ones. ``categories`` above
    1 adds discrete gamma rates of shape ``alpha``.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        names, columns, weights = _patterns(rows)
        d = impute_mean(p_distances(columns, weights))
        jc = np.where(d < 0.74, -0.75 * np.log(1 - np.minimum(d, 0.74) * 4 / 3), 3.0)
        np.fill_diagonal(jc, 0)
        tree = build(names, jc, "nj")
        pi = frequencies(columns, weights)
        rates = discrete_gamma(alpha, categories) if categories > 1 else None
        out = []
        for model in models:
            base = np.full(4, 0.25) if model in ("jc69", "k80") else pi
            value = lambda kappa, model=model, base=base: float((log_likelihoods(tree, Process(rate_matrix(model, base, kappa), base), columns, names, rates) * weights).sum())
            kappa, best = golden_section(value, 0.1, 20.0, 1e-4, 60) if model in ("k80", "hky85") else (None, value(1.0))
            out.append((int(rows["aln_id"].iloc[0]), model, round(best, 6), MODELS[model] + 2 * len(names) - 3, int(weights.sum()), kappa))
        return pd.DataFrame(out, columns=["aln_id", "model", "lnl", "k", "n", "kappa"])

    return sites.groupBy("aln_id").applyInPandas(run, "aln_id long, model string, lnl double, k int, n int, kappa double")


def site_likelihoods(sites: DataFrame, trees: DataFrame, model: str = "jc69") -> DataFrame:
    """(aln_id, site, lnl) of each site on the given tree (aln_id, newick)."""

    def run(key: tuple, rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or own.empty:
            return pd.DataFrame({"aln_id": [], "site": [], "lnl": []})
        wide = rows.pivot_table(index="taxon", columns="site", values="residue", aggfunc="first").sort_index()
        codes = np.vectorize(lambda c: BASES.find(str(c).upper()), otypes=[int])(wide.to_numpy())
        pi = np.full(4, 0.25) if model in ("jc69", "k80") else frequencies(codes, np.ones(codes.shape[1]))
        lnl = log_likelihoods(parse(own["newick"].iloc[0]), Process(rate_matrix(model, pi), pi), codes, list(wide.index))
        return pd.DataFrame({"aln_id": key[0], "site": wide.columns.astype(int), "lnl": np.round(lnl, 6)})

    return sites.groupBy("aln_id").cogroup(trees.groupBy("aln_id")).applyInPandas(run, "aln_id long, site int, lnl double")


def two_taxon_jc69(distances: DataFrame) -> DataFrame:
    """Closed-form JC69 log likelihood of each pair at its own distance, in one plan."""
    n, p = F.col("comparable_sites"), F.col("distance")
    same = F.when(p < 1, (1 - p) * n * F.log(0.25 * F.greatest(1 - p, F.lit(1e-300)))).otherwise(0.0)
    differ = F.when(p > 0, p * n * F.log(F.greatest(p, F.lit(1e-300)) / 12)).otherwise(0.0)
    return distances.where("left < right and comparable_sites > 0 and distance < 0.75").select("aln_id", "left", "right", F.round(same + differ, 6).alias("lnl"))


def pairwise_tree(rows: pd.DataFrame) -> Node:
    names, d = square(rows)
    return build(names, impute_mean(d), "nj")
