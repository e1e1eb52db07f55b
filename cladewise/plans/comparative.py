"""Comparative methods on trees and traits, one tree per group."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from cladewise.functions.special import chi2_tail, golden_section, student_t_two_sided
from cladewise.sources.newick import Node, parse


def covariance(tree: Node) -> tuple[list[str], np.ndarray]:
    """Tip names and shared root-to-ancestor path lengths."""
    depth: dict[int, float] = {id(tree): 0.0}
    for node in tree.walk():
        for c in node.children:
            depth[id(c)] = depth[id(node)] + (c.length or 0.0)
    tips = [n for n in tree.walk() if not n.children]
    at = {id(t): i for i, t in enumerate(tips)}
    v = np.zeros((len(tips), len(tips)))
    below: dict[int, list[int]] = {}
    for node in tree.walk(post=True):
        if not node.children:
            i = at[id(node)]
            below[id(node)], v[i, i] = [i], depth[id(node)]
            continue
        groups = [below.pop(id(c)) for c in node.children]
        for k, g in enumerate(groups):
            for h in groups[k + 1 :]:
                v[np.ix_(g, h)] = v[np.ix_(h, g)] = depth[id(node)]
        below[id(node)] = [i for g in groups for i in g]
    return [t.name for t in tips], v


def lambda_transform(v: np.ndarray, value: float) -> np.ndarray:
    return v * value + np.diag(np.diag(v)) * (1 - value)


def ou_covariance(v: np.ndarray, alpha: float) -> np.ndarray:
    """Conditional on the root: exp(-alpha * path) * (1 - exp(-2 alpha * shared)) / 2 alpha."""
    d = np.diag(v)
    path = d[:, None] + d[None, :] - 2 * v
    return np.exp(-alpha * path) * (1 - np.exp(-2 * alpha * v)) / (2 * alpha)


def contrasts(tree: Node, x: dict[str, float]) -> list[float]:
    """Signed independent contrasts, children in order; polytomies are resolved from the left with length 0."""
    value: dict[int, tuple[float, float]] = {}
    out: list[float] = []
    for node in tree.walk(post=True):
        own = node.length or 0.0
        if not node.children:
            value[id(node)] = (x[node.name], own)
            continue
        a, va = value.pop(id(node.children[0]))
        for c in node.children[1:]:
            b, vb = value.pop(id(c))
            total = va + vb
            out.append((a - b) / math.sqrt(total) if total > 0 else 0.0)
            a, va = ((a * vb + b * va) / total, va * vb / total) if total > 0 else ((a + b) / 2, 0.0)
        value[id(node)] = (a, va + own)
    return out


def gls(x: np.ndarray, y: np.ndarray, v: np.ndarray) -> dict:
    """Generalised least squares: coefficients, errors, residuals, maximum-likelihood variance and log likelihood."""
    inverse = np.linalg.inv(v)
    xtv = x.T @ inverse
    cov = np.linalg.inv(xtv @ x)
    beta = cov @ xtv @ y
    r = y - x @ beta
    quad = float(r @ inverse @ r)
    n, k = x.shape
    s2 = quad / (n - k)
    ml = max(quad / n, 1e-12)
    _, logdet = np.linalg.slogdet(v)
    lnl = -0.5 * (n * math.log(2 * math.pi * ml) + logdet + n)
    return {"beta": beta, "se": np.sqrt(np.maximum(np.diag(cov) * s2, 0)), "residuals": r, "sigma2": ml, "lnl": lnl, "quad": quad, "df": n - k}


def blombergs_k(x: np.ndarray, v: np.ndarray) -> float:
    n = len(x)
    inverse = np.linalg.inv(v)
    mean = inverse.sum(axis=0) @ x / inverse.sum()
    r = x - mean
    mse0, mse = float(r @ r) / (n - 1), float(r @ inverse @ r) / (n - 1)
    return (mse0 / mse) / ((np.trace(v) - n / inverse.sum()) / (n - 1))


def pagels_lambda(x: np.ndarray, v: np.ndarray) -> tuple[float, float]:
    """(lambda, lnl) by a grid of 0.05, then 0.005 around its first maximum."""
    one = np.ones((len(x), 1))
    value = lambda a: gls(one, x, lambda_transform(v, a))["lnl"]

    def best(grid: list[float]) -> tuple[float, float]:
        scored = [(value(a), a) for a in grid]
        top = max(s for s, _ in scored)
        return next((a, s) for s, a in scored if s == top)

    coarse, _ = best([round(0.05 * k, 3) for k in range(21)])
    return best([round(coarse - 0.05 + 0.005 * k, 3) for k in range(21) if 0 <= round(coarse - 0.05 + 0.005 * k, 3) <= 1])


def continuous_modes(x: np.ndarray, v: np.ndarray) -> list[tuple[str, float, int, float]]:
    """(model, lnl, parameters, parameter) of Brownian motion, Ornstein-Uhlenbeck, early burst, lambda and white noise."""
    one = np.ones((len(x), 1))
    height = float(np.diag(v).max())
    fit = lambda c: gls(one, x, c)["lnl"]
    burst = lambda a: (1 - np.exp(-a * v)) / a
    alpha, ou = golden_section(lambda a: fit(ou_covariance(v, a)), 1e-3 / height, 20 / height, 1e-5, 60)
    rate, eb = golden_section(lambda a: fit(burst(a)), 1e-4 / height, 5 / height, 1e-5, 60)
    lam, pl = pagels_lambda(x, v)
    return [("brownian", fit(v), 2, 0.0), ("ornstein_uhlenbeck", ou, 3, alpha), ("early_burst", eb, 3, rate), ("lambda", pl, 3, lam), ("white", fit(np.eye(len(x))), 2, 0.0)]


def ancestral_states(tree: Node, x: dict[str, float]) -> list[tuple[str, int, float, float]]:
    """(first tip, tips, estimate, variance) of each internal node under Brownian motion, by message passing."""
    up: dict[int, tuple[float, float]] = {}
    order = list(tree.walk(post=True))
    label: dict[int, tuple[str, int]] = {}
    for node in order:
        if not node.children:
            up[id(node)], label[id(node)] = (x[node.name], 0.0), (node.name, 1)
            continue
        w = [(up[id(c)][0], 1 / max(up[id(c)][1] + (c.length or 0.0), 1e-12)) for c in node.children]
        total = sum(b for _, b in w)
        up[id(node)] = (sum(a * b for a, b in w) / total, 1 / total)
        label[id(node)] = (min(label[id(c)][0] for c in node.children), sum(label[id(c)][1] for c in node.children))
    full: dict[int, tuple[float, float]] = {id(tree): up[id(tree)]}
    out = []
    for node in tree.walk():
        if not node.children:
            continue
        mean, var = full[id(node)]
        out.append((*label[id(node)], mean, var))
        for c in node.children:
            if not c.children:
                continue
            length = max(c.length or 0.0, 1e-12)
            down_p = 1 / var - 1 / (up[id(c)][1] + length)  # the parent without this child
            down_m = (mean / var - up[id(c)][0] / (up[id(c)][1] + length)) / down_p if down_p > 1e-12 else 0.0
            a, pa = (up[id(c)][0], 1 / max(up[id(c)][1], 1e-12))
            pb = 1 / (1 / down_p + length) if down_p > 1e-12 else 0.0
            full[id(c)] = ((a * pa + down_m * pb) / (pa + pb), 1 / (pa + pb))
    return out


def mk_log_likelihood(tree: Node, states: dict[str, int], k: int, rate: float) -> float:
    """Equal-rates Mk with an equal root prior."""
    same = lambda t: (1 + (k - 1) * math.exp(-k * rate * t)) / k
    part: dict[int, np.ndarray] = {}
    scale = 0.0
    for node in tree.walk(post=True):
        if not node.children:
            v = np.zeros(k)
            v[states[node.name]] = 1
        else:
            v = np.ones(k)
            for c in node.children:
                s = same(c.length or 0.0)
                below = part.pop(id(c))
                o = (1 - s) / (k - 1)
                v = v * (o * below.sum() + (s - o) * below)
            scale += math.log(v.sum()) if v.sum() > 0 else -math.inf
            v = v / v.sum() if v.sum() > 0 else v
        part[id(node)] = v
    return scale + math.log(part[id(tree)].mean()) + 0.0


def _grouped(trees: DataFrame, rows: DataFrame, schema: str, f) -> DataFrame:
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(key: tuple, own: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        out = f(key[0], parse(own["newick"].iloc[0]), data) if len(own) and len(data) else []
        return pd.DataFrame(out, columns=columns)

    return trees.groupBy("tree_id").cogroup(rows.groupBy("tree_id")).applyInPandas(run, schema)


def signal(trees: DataFrame, traits: DataFrame) -> DataFrame:
    """Blomberg's K, Pagel's lambda and its likelihood-ratio test against 0, from (tree_id, taxon, value)."""

    def one(tree_id, tree, data):
        names, v = covariance(tree)
        x = data.set_index("taxon")["value"].reindex(names).to_numpy(float)
        lam, lnl = pagels_lambda(x, v)
        null = gls(np.ones((len(x), 1)), x, lambda_transform(v, 0.0))["lnl"]
        return [(tree_id, len(x), round(blombergs_k(x, v), 6), lam, round(lnl, 6), round(chi2_tail(2 * max(0.0, lnl - null), 1), 6))]

    return _grouped(trees, traits, "tree_id long, n int, k double, lambda double, lnl double, p_value double", one)


def independent_contrasts(trees: DataFrame, traits: DataFrame) -> DataFrame:
    def one(tree_id, tree, data):
        return [(tree_id, i + 1, round(c, 9)) for i, c in enumerate(contrasts(tree, dict(zip(data["taxon"], data["value"], strict=True))))]

    return _grouped(trees, traits, "tree_id long, number int, contrast double", one)


def modes(trees: DataFrame, traits: DataFrame) -> DataFrame:
    """(tree_id, model, lnl, k, n, parameter), ready for ranking."""

    def one(tree_id, tree, data):
        names, v = covariance(tree)
        x = data.set_index("taxon")["value"].reindex(names).to_numpy(float)
        return [(tree_id, m, round(lnl, 6), k, len(x), p) for m, lnl, k, p in continuous_modes(x, v)]

    return _grouped(trees, traits, "tree_id long, model string, lnl double, k int, n int, parameter double", one)


def pgls(trees: DataFrame, rows: DataFrame, response: str, predictors: list[str], value: float = 1.0) -> DataFrame:
    """Coefficients with errors and two-sided t tests, under Brownian covariance with a fixed lambda."""

    def one(tree_id, tree, data):
        names, v = covariance(tree)
        d = data.set_index("taxon").reindex(names)
        x = np.column_stack([np.ones(len(d)), *(d[p].to_numpy(float) for p in predictors)])
        fit = gls(x, d[response].to_numpy(float), lambda_transform(v, value))
        y = d[response].to_numpy(float)
        r2 = 1 - float(fit["residuals"] @ fit["residuals"]) / float(((y - y.mean()) ** 2).sum())
        t = fit["beta"] / np.where(fit["se"] > 0, fit["se"], np.nan)
        return [(tree_id, term, round(float(b), 9), round(float(s), 9), round(student_t_two_sided(float(tt), fit["df"]), 9), round(fit["lnl"], 6), round(r2, 6)) for term, b, s, tt in zip(["(intercept)", *predictors], fit["beta"], fit["se"], t, strict=True)]

    return _grouped(trees, rows, "tree_id long, term string, estimate double, error double, p_value double, lnl double, r2 double", one)


def reconstruct(trees: DataFrame, traits: DataFrame) -> DataFrame:
    """Brownian ancestral states with variances scaled by the maximum-likelihood rate."""

    def one(tree_id, tree, data):
        x = dict(zip(data["taxon"], data["value"].astype(float), strict=True))
        rate = float(np.mean(np.square(contrasts(tree, x))))
        return [(tree_id, f"{a}+{n}", n, round(m, 6), round(v * rate, 6)) for a, n, m, v in ancestral_states(tree, x)]

    return _grouped(trees, traits, "tree_id long, node string, tips int, estimate double, variance double", one)


def fit_mk(trees: DataFrame, states: DataFrame) -> DataFrame:
    """Equal-rates Mk by golden section, from (tree_id, taxon, state): rate and log likelihood."""

    def one(tree_id, tree, data):
        names = sorted(set(data["state"]))
        if len(names) < 2:
            return [(tree_id, len(names), None, 0.0)]
        s = {t: names.index(x) for t, x in zip(data["taxon"], data["state"], strict=True)}
        rate, lnl = golden_section(lambda r: mk_log_likelihood(tree, s, len(names), r), 1e-4, 10.0, 1e-5, 60)
        return [(tree_id, len(names), round(rate, 4), round(lnl, 4))]

    return _grouped(trees, states, "tree_id long, states int, rate double, lnl double", one)
