"""Parsimony scores of characters on trees, one tree (with its characters) per group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from cladewise.sources.newick import Node, parse


def fitch(tree: Node, states: dict[str, str]) -> tuple[int, set[str]]:
    """Steps and root states; children of a polytomy are folded from left to right."""
    sets: dict[int, set[str]] = {}
    steps = 0
    for node in tree.walk(post=True):
        if not node.children:
            sets[id(node)] = {states[node.name]}
            continue
        have = sets.pop(id(node.children[0]))
        for child in node.children[1:]:
            other = sets.pop(id(child))
            if have & other:
                have = have & other
            else:
                have = have | other
                steps += 1
        sets[id(node)] = have
    return steps, sets[id(tree)]


def sankoff(tree: Node, states: dict[str, str], cost: np.ndarray, names: list[str]) -> tuple[float, list[str]]:
    """Least cost and optimal root states under a cost matrix (from row to column)."""
    at = {s: i for i, s in enumerate(names)}
    value: dict[int, np.ndarray] = {}
    for node in tree.walk(post=True):
        if not node.children:
            v = np.full(len(names), np.inf)
            v[at[states[node.name]]] = 0
        else:
            v = sum((cost + value.pop(id(c))[None, :]).min(axis=1) for c in node.children)
        value[id(node)] = v
    best = float(value[id(tree)].min())
    return best, [s for s, x in zip(names, value[id(tree)], strict=True) if x <= best + 1e-12]


def wagner(tree: Node, states: dict[str, str]) -> float:
    """Ordered states: the cost is the difference of their ranks."""
    names = sorted(set(states.values()), key=lambda s: (len(s), s))
    rank = np.arange(len(names))
    return sankoff(tree, states, np.abs(rank[:, None] - rank[None, :]).astype(float), names)[0]


def dollo(tree: Node, states: dict[str, str]) -> tuple[int, int]:
    """(gains, losses) with one gain at the common ancestor of the derived tips (state '1')."""
    derived: dict[int, int] = {}
    for node in tree.walk(post=True):
        derived[id(node)] = int(states[node.name] == "1") if not node.children else sum(derived[id(c)] for c in node.children)
    total = derived[id(tree)]
    if not total:
        return 0, 0
    at = tree
    while nxt := next((c for c in at.children if derived[id(c)] == total), None):
        at = nxt
    losses, stack = 0, [at]
    while stack:
        node = stack.pop()
        for c in node.children:
            if derived[id(c)]:
                stack.append(c)
            else:
                losses += 1
    return 1, losses


def camin_sokal(tree: Node, states: dict[str, str]) -> int:
    """Gains when 0 to 1 cannot be undone: a node is derived only if all tips below are."""
    value: dict[int, bool] = {}
    gains = 0
    for node in tree.walk(post=True):
        if not node.children:
            value[id(node)] = states[node.name] == "1"
        else:
            below = [value[id(c)] for c in node.children]
            value[id(node)] = all(below)
            if not all(below):
                gains += sum(below)
    return gains + int(value[id(tree)])


def transformation(tree: Node, states: dict[str, str], *, accelerated: bool) -> list[tuple[str, str]]:
    """(node, state) of one most parsimonious history; changes as near the root (or the tips) as they can be.

    Nodes are named by their first tip and number of tips.
    """
    down: dict[int, set[str]] = {}
    label: dict[int, tuple[str, int]] = {}
    for node in tree.walk(post=True):
        if not node.children:
            down[id(node)], label[id(node)] = {states[node.name]}, (node.name, 1)
            continue
        have = down[id(node.children[0])]
        for c in node.children[1:]:
            have = have & down[id(c)] or have | down[id(c)]
        down[id(node)] = have
        label[id(node)] = (min(label[id(c)][0] for c in node.children), sum(label[id(c)][1] for c in node.children))
    chosen: dict[int, str] = {id(tree): min(down[id(tree)])}
    out = []
    for node in tree.walk():
        mine = chosen[id(node)]
        out.append((f"{label[id(node)][0]}+{label[id(node)][1]}", mine))
        for c in node.children:
            options = down[id(c)]
            stay = mine in options
            if accelerated and c.children and not stay:
                chosen[id(c)] = min(options)
            elif stay:
                chosen[id(c)] = mine
            else:
                held = [o for o in sorted(options)]
                chosen[id(c)] = held[0] if accelerated else held[-1]
    return out


def scores(trees: DataFrame, states: DataFrame) -> DataFrame:
    """(tree_id, character, fitch, wagner, gains, losses, camin_sokal) from (tree_id, newick) and (tree_id, character, taxon, state).

    The last three read states '0' and '1' and are null for others.
    """

    def run(key: tuple, own: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own) and len(rows):
            tree = parse(own["newick"].iloc[0])
            for character, group in rows.groupby("character"):
                s = dict(zip(group["taxon"], group["state"], strict=True))
                binary = set(s.values()) <= {"0", "1"}
                gains, losses = dollo(tree, s) if binary else (None, None)
                out.append((key[0], character, fitch(tree, s)[0], wagner(tree, s), gains, losses, camin_sokal(tree, s) if binary else None))
        return pd.DataFrame(out, columns=["tree_id", "character", "fitch", "wagner", "gains", "losses", "camin_sokal"])

    return trees.groupBy("tree_id").cogroup(states.groupBy("tree_id")).applyInPandas(run, "tree_id long, character string, fitch int, wagner double, gains int, losses int, camin_sokal int")
