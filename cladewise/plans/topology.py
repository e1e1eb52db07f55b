"""Changes of tree topology: rooting, ordering, rearrangement moves, and consensus and agreement of trees."""

from __future__ import annotations

import copy
import itertools
import random
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from cladewise.plans.joining import clades, patristic
from cladewise.sources.newick import Node, dump, parse


def tips(tree: Node) -> list[str]:
    return [n.name for n in tree.walk() if not n.children]


def parents(tree: Node) -> dict[int, Node]:
    return {id(c): n for n in tree.walk() for c in n.children}


def _suppress(tree: Node) -> Node:
    """Without unary nodes; their lengths add up."""
    for node in tree.walk(post=True):
        for i, c in enumerate(node.children):
            while len(c.children) == 1:
                only = c.children[0]
                only.length = None if only.length is None and c.length is None else (only.length or 0.0) + (c.length or 0.0)
                c = only
            node.children[i] = c
    while len(tree.children) == 1 and tree.children[0].children:
        tree = tree.children[0]
    tree.length = None
    return tree


def keep_tips(tree: Node, keep: Iterable[str]) -> Node:
    """Pruned to some tips; order of children as it was."""
    keep = set(keep)
    tree = copy.deepcopy(tree)
    for node in tree.walk(post=True):
        node.children = [c for c in node.children if (c.children or c.name in keep) and not getattr(c, "gone", False)]
        if not node.children and node.name not in keep:
            node.gone = True
    return _suppress(tree)


def reroot_at_edge(tree: Node, below: Node, fraction: float = 0.5) -> Node:
    """Rooted on the edge above ``below``, at a fraction of its length from it."""
    up = parents(tree)
    length = below.length or 0.0
    path, node = [], below
    while id(node) in up:
        path.append(node)
        node = up[id(node)]
    root = Node("", None, [])
    child, side_length = below, (1 - fraction) * length
    parent = up[id(below)]
    parent.children = [c for c in parent.children if c is not child]
    below.length = fraction * length
    root.children = [below, parent]
    carry = parent.length
    parent.length = side_length
    node = parent
    while id(node) in up:
        above = up[id(node)]
        above.children = [c for c in above.children if c is not node]
        node.children.append(above)
        carry, above.length = above.length, carry
        node = above
    return _suppress(root)


def reroot_on_outgroup(tree: Node, outgroup: Iterable[str]) -> Node:
    """Rooted on the edge above the outgroup, which must be one clade of the unrooted tree."""
    want = set(outgroup)
    tree = copy.deepcopy(tree)
    everything = set(tips(tree))
    for node in tree.walk(post=True):
        if node is tree:
            continue
        have = {n.name for n in node.walk() if not n.children}
        if have == want or have == everything - want:
            return reroot_at_edge(tree, node)
    raise ValueError("the outgroup is not one clade")


def reroot_at_midpoint(tree: Node) -> Node:
    """Rooted in the middle of the longest path between two tips; the first in order of names."""
    far = patristic(tree)
    (a, b), length = min(far.items(), key=lambda x: (-round(x[1], 12), x[0]))
    tree = copy.deepcopy(tree)
    up = parents(tree)
    leaf = {n.name: n for n in tree.walk() if not n.children}

    def climb(node: Node) -> list[Node]:
        out = [node]
        while id(out[-1]) in up:
            out.append(up[id(out[-1])])
        return out

    shared = {id(n) for n in climb(leaf[a])} & {id(n) for n in climb(leaf[b])}
    for start in (a, b):
        gone = 0.0
        for node in climb(leaf[start]):
            if id(node) in shared:
                break
            step = node.length or 0.0
            if gone + step >= length / 2 - 1e-12:
                return reroot_at_edge(tree, node, (length / 2 - gone) / step if step > 0 else 0.5)
            gone += step
    return tree


def unroot(tree: Node) -> Node:
    """A root with two children becomes one with three."""
    tree = copy.deepcopy(tree)
    if len(tree.children) == 2:
        a, b = tree.children
        inner, other = (a, b) if a.children else (b, a)
        if inner.children:
            other.length = (other.length or 0.0) + (inner.length or 0.0)
            tree.children = [*inner.children, other]
    return tree


def ladderize(tree: Node, *, largest_last: bool = True) -> Node:
    tree = copy.deepcopy(tree)
    size: dict[int, tuple[int, str]] = {}
    for node in tree.walk(post=True):
        size[id(node)] = (sum(size[id(c)][0] for c in node.children) or 1, min((size[id(c)][1] for c in node.children), default=node.name))
        node.children.sort(key=lambda c: size[id(c)], reverse=not largest_last)
    return tree


def collapse_short(tree: Node, threshold: float) -> Node:
    """Inner edges shorter than the threshold become polytomies; their lengths go to the children."""
    tree = copy.deepcopy(tree)
    for node in tree.walk(post=True):
        out = []
        for c in node.children:
            if c.children and (c.length or 0.0) < threshold:
                for g in c.children:
                    g.length = (g.length or 0.0) + (c.length or 0.0)
                out += c.children
            else:
                out.append(c)
        node.children = out
    return tree


def signature(tree: Node) -> tuple[str, ...]:
    """The rooted topology: its informative clades, sorted."""
    return tuple(sorted(clades(tree)))


def _unique(start: Node, candidates: Iterator[Node]) -> Iterator[Node]:
    seen = {signature(start)}
    for tree in candidates:
        if (key := signature(tree)) not in seen:
            seen.add(key)
            yield tree


def nni_neighbors(tree: Node) -> Iterator[Node]:
    """Rooted nearest-neighbour interchanges: two for each inner edge of a binary tree."""

    def moves() -> Iterator[Node]:
        inner = [i for i, n in enumerate(tree.walk()) if n.children and n is not tree]
        for index in inner:
            for pick in (0, 1):
                new = copy.deepcopy(tree)
                nodes = list(new.walk())
                node = nodes[index]
                up = parents(new)[id(node)]
                sister = next(c for c in up.children if c is not node)
                a = node.children[pick]
                up.children[up.children.index(sister)] = a
                node.children[pick] = sister
                yield new

    yield from _unique(tree, moves())


def spr_neighbors(tree: Node) -> Iterator[Node]:
    """Rooted prune and regraft: every subtree on every other edge, and above the root."""

    def moves() -> Iterator[Node]:
        count = len(list(tree.walk()))
        for cut in range(1, count):
            for graft in range(count):
                new = copy.deepcopy(tree)
                nodes = list(new.walk())
                moving, target = nodes[cut], nodes[graft]
                if any(n is target for n in moving.walk()):
                    continue
                up = parents(new)
                old = up[id(moving)]
                if target is old:
                    continue
                old.children.remove(moving)
                joint = Node("", (target.length or 0.0) / 2 if target.length is not None else None, [target, moving])
                if id(target) in up:
                    above = up[id(target)]
                    above.children[above.children.index(target)] = joint
                    target.length = joint.length
                    root = new
                else:
                    root, joint.length, target.length = joint, None, 0.0
                yield _suppress(root)

    yield from _unique(tree, moves())


def tbr_neighbors(tree: Node) -> Iterator[Node]:
    """Bisection and reconnection: the cut subtree may be rerooted before it is grafted."""

    def moves() -> Iterator[Node]:
        yield from spr_neighbors(tree)
        nodes = list(tree.walk())
        for cut in range(1, len(nodes)):
            part = nodes[cut]
            inside = [n for n in part.walk() if n is not part]
            if len([n for n in part.walk() if not n.children]) < 3:
                continue
            for k in range(len(inside)):
                rerooted = copy.deepcopy(part)
                rerooted = reroot_at_edge(rerooted, [n for n in rerooted.walk()][1:][k])
                base = copy.deepcopy(tree)
                spot = list(base.walk())[cut]
                spot.children, spot.name = rerooted.children, rerooted.name
                yield base
                yield from spr_neighbors(base) if len(nodes) <= 11 else ()

    yield from _unique(tree, moves())


FAMILIES: dict[str, Callable[[Node], Iterator[Node]]] = {"nni": nni_neighbors, "spr": spr_neighbors, "tbr": tbr_neighbors}


def neighborhoods(trees: DataFrame, families: tuple[str, ...] = ("nni", "spr")) -> DataFrame:
    """(tree_id, family, neighbors): different topologies one move away; a tree is a task's unit of work."""

    def run(batches):
        for batch in batches:
            rows = [(i, f, sum(1 for _ in FAMILIES[f](parse(t)))) for i, t in zip(batch["tree_id"], batch["newick"], strict=True) for f in families]
            yield pd.DataFrame(rows, columns=["tree_id", "family", "neighbors"])

    return trees.select("tree_id", "newick").mapInPandas(run, "tree_id long, family string, neighbors int")


def transformed(trees: DataFrame, change: Callable[[Node], Node]) -> DataFrame:
    """(tree_id, newick) after ``change``."""

    def run(batches):
        for batch in batches:
            yield pd.DataFrame({"tree_id": batch["tree_id"], "newick": [dump(change(parse(t))) for t in batch["newick"]]})

    return trees.select("tree_id", "newick").mapInPandas(run, "tree_id long, newick string")


def compatible(a: set[str], b: set[str]) -> bool:
    return not a & b or a <= b or b <= a


def tree_of_clades(names: list[str], groups: Iterable[set[str]]) -> Node:
    """The tree with exactly these clades, which must be compatible."""
    root = Node("", None, [])
    made: list[tuple[set[str], Node]] = [(set(names), root)]
    for g in sorted({frozenset(g) for g in groups}, key=lambda g: (-len(g), sorted(g))):
        home = min((m for m in made if g < m[0]), key=lambda m: len(m[0]), default=None)
        if home is not None:
            node = Node("", None, [])
            home[1].children.append(node)
            made.append((set(g), node))
    for n in names:
        home = min((m for m in made if n in m[0]), key=lambda m: len(m[0]))
        home[1].children.append(Node(n))
    return root


def extended_consensus(names: list[str], counts: dict[str, int], total: int, threshold: float = 0.5) -> tuple[Node, list[tuple[str, str]]]:
    """Clades at or above the threshold, then others by falling count unless they conflict; also what blocked each rejected one."""
    kept: list[set[str]] = []
    blocked = []
    for clade, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
        group = set(clade.split("|"))
        against = next((k for k in kept if not compatible(group, k)), None)
        if against is None:
            kept.append(group)
        elif n / total < threshold:
            blocked.append((clade, "|".join(sorted(against))))
    return tree_of_clades(names, kept), blocked


def agreement_subtree(trees: list[Node]) -> list[str]:
    """The largest set of tips on which all trees have one topology; the first in order of names."""
    names = sorted(set.intersection(*(set(tips(t)) for t in trees)))
    for size in range(len(names), 2, -1):
        for chosen in itertools.combinations(names, size):
            if len({signature(keep_tips(t, chosen)) for t in trees}) == 1:
                return list(chosen)
    return names[:2]


def quartets(tree: Node) -> dict[tuple[str, ...], str]:
    """The split of each set of four tips as 'ab|cd', '' where unresolved."""
    names = sorted(tips(tree))
    groups = [set(c.split("|")) for c in clades(tree)]
    out = {}
    for four in itertools.combinations(names, 4):
        found = ""
        for a, b in ((0, 1), (0, 2), (0, 3)):
            pair = {four[a], four[b]}
            rest = set(four) - pair
            if any((pair <= g and not rest & g) or (rest <= g and not pair & g) for g in groups):
                found = f"{four[a]},{four[b]}|{','.join(sorted(rest))}"
        out[four] = found
    return out


def quartet_agreement(left: Node, right: Node) -> tuple[int, int, int]:
    """(agreeing, conflicting, unresolved) quartets of the shared tips."""
    a, b = quartets(left), quartets(right)
    same = sum(bool(a[k]) and a[k] == b.get(k) for k in a)
    none = sum(not a[k] or not b.get(k) for k in a)
    return same, len(a) - same - none, none


def stepwise_addition(names: list[str], score: Callable[[Node], float]) -> Node:
    """Adds tips in order, each on the edge with the best (lowest) score; ties to the first edge."""
    tree = Node("", None, [Node(names[0]), Node(names[1])])
    for name in names[2:]:
        options = []
        for i in range(len(list(tree.walk()))):
            new = copy.deepcopy(tree)
            nodes = list(new.walk())
            target, up = nodes[i], parents(new)
            joint = Node("", None, [target, Node(name)])
            if id(target) in up:
                above = up[id(target)]
                above.children[above.children.index(target)] = joint
            else:
                new = joint
            options.append((score(new), i, new))
        tree = min(options, key=lambda o: (o[0], o[1]))[2]
    return tree


def hill_climb(tree: Node, score: Callable[[Node], float], steps: int = 50) -> tuple[Node, float]:
    """Best interchange while one lowers the score."""
    now = score(tree)
    for _ in range(steps):
        best = min(((score(t), i, t) for i, t in enumerate(nni_neighbors(tree))), key=lambda x: x[:2], default=None)
        if best is None or best[0] >= now - 1e-12:
            break
        now, tree = best[0], best[2]
    return tree, now


def random_bifurcating(names: list[str], seed: int) -> Node:
    rng = random.Random(seed)
    nodes = [Node(n) for n in names]
    while len(nodes) > 1:
        a = nodes.pop(rng.randrange(len(nodes)))
        b = nodes.pop(rng.randrange(len(nodes)))
        nodes.append(Node("", None, [a, b]))
    return nodes[0]


def compare(left: Node, right: Node) -> dict[str, float | None]:
    """Robinson-Foulds distance, branch score and shared clades of two trees on their shared tips."""
    shared = sorted(set(tips(left)) & set(tips(right)))
    a, b = keep_tips(left, shared), keep_tips(right, shared)
    ca, cb = set(clades(a)), set(clades(b))
    la, lb = split_lengths(a), split_lengths(b)
    missing = any(v is None for v in (*la.values(), *lb.values()))
    score = None if missing else sum((lb.get(k, 0.0) - la.get(k, 0.0)) ** 2 for k in set(la) | set(lb)) ** 0.5
    total = len(ca) + len(cb)
    distance = total - 2 * len(ca & cb)
    return {"shared_tips": len(shared), "distance": distance, "normalised": distance / total if total else 0.0, "branch_score": score}


def split_lengths(tree: Node) -> dict[tuple[str, ...], float | None]:
    """Length of each unrooted split, pendant edges too; the two edges at a binary root are one."""
    everything = sorted(tips(tree))
    out: dict[tuple[str, ...], float | None] = {}
    for node in tree.walk():
        if node is tree:
            continue
        side = tuple(sorted(n.name for n in node.walk() if not n.children))
        other = tuple(x for x in everything if x not in set(side))
        key = min((len(side), side), (len(other), other))[1]
        if key in out:
            out[key] = None if out[key] is None or node.length is None else out[key] + node.length
        else:
            out[key] = node.length
    return out
