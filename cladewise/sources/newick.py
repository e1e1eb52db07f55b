"""Newick text to node rows and back."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Node:
    name: str = ""
    length: float | None = None
    children: list[Node] = field(default_factory=list)

    def walk(self, *, post: bool = False) -> Iterator[Node]:
        """All nodes, parents first (or last), without recursion."""
        stack: list[tuple[Node, bool]] = [(self, False)]
        while stack:
            node, seen = stack.pop()
            if not post:
                yield node
                stack.extend((c, False) for c in reversed(node.children))
            elif seen or not node.children:
                yield node
            else:
                stack.append((node, True))
                stack.extend((c, False) for c in reversed(node.children))


class NewickError(ValueError):
    """The text is not one tree."""


def _tokens(text: str) -> Iterator[tuple[str, str]]:
    i, n = 0, len(text)
    while i < n:
        c = text[i]
        if c.isspace():
            i += 1
        elif c == "[":
            depth, j = 1, i + 1
            while j < n and depth:
                depth += (text[j] == "[") - (text[j] == "]")
                j += 1
            if depth:
                raise NewickError("a comment does not end")
            i = j
        elif c in "(),:;":
            yield c, c
            i += 1
        elif c == "'":
            j, out = i + 1, []
            while True:
                if j >= n:
                    raise NewickError("a quoted label does not end")
                if text[j] == "'":
                    if j + 1 < n and text[j + 1] == "'":
                        out.append("'")
                        j += 2
                        continue
                    break
                out.append(text[j])
                j += 1
            yield "label", "".join(out)
            i = j + 1
        else:
            j = i
            while j < n and text[j] not in "(),:;[" and not text[j].isspace():
                j += 1
            yield "label", text[i:j]
            i = j


def parse(text: str) -> Node:
    """One tree; :class:`NewickError` for anything else."""
    root = Node()
    at, path, after_colon, ended, closed = root, [], False, False, False
    for kind, value in _tokens(text):
        if ended:
            raise NewickError("text after the tree")
        if kind == "(":
            if at.children or at.name or closed:
                raise NewickError("an opening bracket after a label")
            child = Node()
            at.children.append(child)
            path.append(at)
            at = child
        elif kind == ",":
            if not path:
                raise NewickError("a comma outside brackets")
            at = Node()
            path[-1].children.append(at)
            closed = False
        elif kind == ")":
            if not path:
                raise NewickError("a bracket too many")
            at = path.pop()
            closed = True
        elif kind == ":":
            after_colon = True
        elif kind == ";":
            ended = True
        elif after_colon:
            try:
                at.length = float(value)
            except ValueError as error:
                raise NewickError(f"not a length: {value}") from error
            after_colon = False
        elif at.name:
            raise NewickError("two labels on one node")
        else:
            at.name = value
    if path:
        raise NewickError("brackets do not close")
    if not root.children and not root.name:
        raise NewickError("no tree")
    return root


def _label(name: str) -> str:
    if name and any(c in "()[]{}/\\,;:=*'\"`+-<> \t\n" for c in name):
        return "'" + name.replace("'", "''") + "'"
    return name


def dump(root: Node) -> str:
    """Canonical text: children by smallest tip and size, lengths to 15 digits, no length on the root."""
    text: dict[int, str] = {}
    key: dict[int, tuple[str, int]] = {}
    for node in root.walk(post=True):
        kids = sorted(node.children, key=lambda c: key[id(c)])
        key[id(node)] = (min((key[id(c)][0] for c in kids), default=node.name), sum(key[id(c)][1] for c in kids) or 1)
        body = f"({','.join(text[id(c)] for c in kids)})" if kids else ""
        length = "" if node is root or node.length is None else f":{node.length:.15g}"
        text[id(node)] = body + _label(node.name) + length
    return text[id(root)] + ";"


def node_rows(root: Node) -> list[dict]:
    """Rows of the nodes frame: preorder intervals, levels and distances from the root."""
    rows: list[dict] = []
    stack: list[tuple[Node, int | None, int, float]] = [(root, None, 0, 0.0)]
    index: dict[int, int] = {}
    order = 0
    while stack:
        node, parent, level, dist = stack.pop()
        order += 1
        index[id(node)] = order
        here = dist + (node.length or 0.0) if parent is not None else 0.0
        rows.append({"node_id": order, "parent_id": parent, "name": node.name, "is_tip": not node.children, "branch_length": node.length, "pre": order, "post": order, "level": level, "root_dist": here})
        stack.extend((c, order, level + 1, here) for c in reversed(node.children))
    for row in reversed(rows):
        if row["parent_id"]:
            up = rows[row["parent_id"] - 1]
            up["post"] = max(up["post"], row["post"])
    return rows


NODE_SCHEMA = "tree_id string, error string, node_id long, parent_id long, name string, is_tip boolean, branch_length double, pre long, post long, level int, root_dist double"


def parse_trees(trees: DataFrame) -> DataFrame:
    """(tree_id, newick) to node rows; a text that is no tree gives one row with its ``error``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in NODE_SCHEMA.split(", ")]
        for batch in batches:
            rows = []
            for tree_id, text in zip(batch["tree_id"], batch["newick"], strict=True):
                try:
                    rows += [{"tree_id": str(tree_id), "error": None, **r} for r in node_rows(parse(text or ""))]
                except NewickError as error:
                    rows.append({"tree_id": str(tree_id), "error": str(error)})
            yield pd.DataFrame(rows, columns=columns).astype({"node_id": "Int64", "parent_id": "Int64", "pre": "Int64", "post": "Int64", "level": "Int32", "is_tip": "boolean", "tree_id": object, "error": object, "name": object})

    return trees.select(F.col("tree_id").cast("string").alias("tree_id"), "newick").mapInPandas(run, NODE_SCHEMA)


def read_tree_set(spark: SparkSession, path: str) -> DataFrame:
    """(tree_id, newick) of all ';'-terminated records, numbered by file and place in it."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", ";")).alias("i", "record"))
    rows = files.where(F.trim(F.regexp_replace("record", r"\s+", " ")) != "")
    return rows.select(F.concat_ws("#", "file", F.col("i") + 1).alias("tree_id"), F.concat(F.trim(F.regexp_replace("record", r"\s*\n\s*", "")), F.lit(";")).alias("newick"))


def dump_trees(nodes: DataFrame) -> DataFrame:
    """Node rows (tree_id, node_id, parent_id, name, branch_length) to (tree_id, newick)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        made = {r.node_id: Node(r.name_ or "", None if pd.isna(r.branch_length) else float(r.branch_length)) for r in rows.rename(columns={"name": "name_"}).itertuples()}
        root = None
        for r in rows.sort_values("node_id").itertuples():
            if pd.isna(r.parent_id):
                root = made[r.node_id]
            else:
                made[r.parent_id].children.append(made[r.node_id])
        return pd.DataFrame({"tree_id": [str(rows["tree_id"].iloc[0])], "newick": [dump(root)]})

    return nodes.select("tree_id", "node_id", "parent_id", "name", "branch_length").groupBy("tree_id").applyInPandas(run, "tree_id string, newick string")
