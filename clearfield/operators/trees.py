"""MIN/MAX expression trees over general halfspaces: simplification, keys, text forms, JSON, evaluation.

A tree is nested tuples: an int is a leaf (the number of a plane), (op, child, ...) with op "MIN" or "MAX" a node.
MIN is union, MAX is intersection of the sets where the value is <= 0. Trees are metadata of one frame;
clusters and points stay tables.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .meet import meet

Tree = int | tuple
MOST_DEPTH = 128


def simplify(tree: Tree) -> Tree:
    """The same set with nested equal operations flattened, children sorted, repeats dropped, single children unwrapped.

    Runs to a fixed point. Only for hard values: smoothing weighs repeats, so its trees must not be touched.
    """
    while True:
        smaller = _simplify_once(tree)
        if smaller == tree:
            return tree
        tree = smaller


def _simplify_once(tree: Tree) -> Tree:
    if isinstance(tree, int):
        return tree
    op, *children = tree
    flat: list[Tree] = []
    for c in map(_simplify_once, children):
        flat += c[1:] if isinstance(c, tuple) and c[0] == op else [c]
    unique = {structural_key(c): c for c in flat}
    kept = [unique[k] for k in sorted(unique)]
    return kept[0] if len(kept) == 1 else (op, *kept)


def structural_key(tree: Tree) -> str:
    """Text that is equal for equal trees."""
    return f"L{tree}" if isinstance(tree, int) else f"{tree[0]}({','.join(map(structural_key, tree[1:]))})"


def depth(tree: Tree) -> int:
    return 1 if isinstance(tree, int) else 1 + max(map(depth, tree[1:]))


def leaf_references(tree: Tree) -> int:
    return 1 if isinstance(tree, int) else sum(map(leaf_references, tree[1:]))


def serialize(tree: Tree) -> list[tuple[int, str, int, list[int]]]:
    """Rows (node_id, op, leaf_id, children), children before parents, root last, equal subtrees once."""
    rows: list[tuple[int, str, int, list[int]]] = []
    known: dict[str, int] = {}

    def go(t: Tree) -> int:
        key = structural_key(t)
        if key not in known:
            children = [] if isinstance(t, int) else [go(c) for c in t[1:]]
            rows.append((len(rows), "LEAF" if isinstance(t, int) else t[0], t if isinstance(t, int) else -1, children))
            known[key] = len(rows) - 1
        return known[key]

    go(tree)
    return rows


def restore(rows: list[tuple[int, str, int, list[int]]]) -> Tree:
    """Tree of serialized rows. Ids must be unique, children known, every row used, depth at most MOST_DEPTH."""
    by = {r[0]: r for r in rows}
    if len(by) != len(rows) or not rows:
        raise ValueError("node ids must be unique")
    used: set[int] = set()

    def go(i: int, level: int) -> Tree:
        if level > MOST_DEPTH:
            raise ValueError("too deep, or not acyclic")
        if i not in by:
            raise ValueError(f"unknown node {i}")
        used.add(i)
        _, op, leaf, children = by[i]
        if op == "LEAF":
            return leaf
        if op not in ("MIN", "MAX") or not children:
            raise ValueError(f"bad node {i}")
        return (op, *(go(c, level + 1) for c in children))

    tree = go(rows[-1][0], 1)
    if len(used) != len(rows):
        raise ValueError("some nodes are not reachable from the root")
    return tree


def to_json(tree: Tree, planes: list[tuple[float, float, float, float]]) -> str:
    """JSON of a tree and its planes (nx, ny, nz, offset)."""
    nodes = [{"id": i, "op": op, "leaf": leaf, "children": children} for i, op, leaf, children in serialize(tree)]
    leaves = [{"id": i, "normal": list(p[:3]), "offset": p[3]} for i, p in enumerate(planes)]
    return json.dumps({"leaves": leaves, "nodes": nodes, "root": nodes[-1]["id"]})


def from_json(text: str) -> tuple[Tree, list[tuple[float, float, float, float]]]:
    """Inverse of to_json, with its checks."""
    data = json.loads(text)
    rows = [(n["id"], n["op"], n["leaf"], n["children"]) for n in data["nodes"]]
    rows.sort(key=lambda r: r[0] == data["root"])
    planes = [(*leaf["normal"], leaf["offset"]) for leaf in sorted(data["leaves"], key=lambda x: x["id"])]
    return restore(rows), planes


#: Rows (node_id, op, leaf_id, children) of a shared graph, children before parents, root last.
Shared = list[tuple[int, str, int, list[int]]]


def shared_json(text: str) -> tuple[Shared, list[tuple[float, float, float, float]]]:
    """The shared graph of to_json without writing it out as a tree, with the checks of restore, and its planes."""
    data = json.loads(text)
    by = {n["id"]: n for n in data["nodes"]}
    if len(by) != len(data["nodes"]) or not by or data["root"] not in by:
        raise ValueError("node ids must be unique and the root one of them")
    planes = [(*leaf["normal"], leaf["offset"]) for leaf in sorted(data["leaves"], key=lambda x: x["id"])]
    order: list[int] = []
    state: dict[int, int] = {}
    stack = [data["root"]]
    while stack:
        i = stack[-1]
        if i not in by:
            raise ValueError(f"unknown node {i}")
        n = by[i]
        if state.get(i) is None:
            state[i] = 0
            if (n["op"] == "LEAF" and not 0 <= n["leaf"] < len(planes)) or (n["op"] != "LEAF" and (n["op"] not in ("MIN", "MAX") or not n["children"])):
                raise ValueError(f"bad node {i}")
            for c in n["children"]:
                if state.get(c) == 0:
                    raise ValueError("not acyclic")
                if c not in state:
                    stack.append(c)
        else:
            stack.pop()
            if state[i] == 0:
                state[i] = 1
                order.append(i)
    if len(order) != len(by):
        raise ValueError("some nodes are not reachable from the root")
    return [(i, by[i]["op"], by[i]["leaf"], by[i]["children"]) for i in order], planes


def boolean_text(tree: Tree) -> str:
    """Set expression with | for union and & for intersection."""
    if isinstance(tree, int):
        return f"H{tree}"
    return "(" + (" | " if tree[0] == "MIN" else " & ").join(map(boolean_text, tree[1:])) + ")"


def scalar_text(tree: Tree) -> str:
    """Function expression with min and max."""
    return f"h{tree}(p)" if isinstance(tree, int) else f"{tree[0].lower()}({', '.join(map(scalar_text, tree[1:]))})"


def dot_text(tree: Tree) -> str:
    """Graphviz text of the shared graph."""
    lines = ["digraph tree {"]
    for i, op, leaf, children in serialize(tree):
        lines.append(f'  n{i} [label="{f"H{leaf}" if op == "LEAF" else op}"];')
        lines += [f"  n{i} -> n{c};" for c in children]
    return "\n".join([*lines, "}"]) + "\n"


def values(tree: Tree, planes: list[tuple[float, float, float, float]], x: np.ndarray) -> np.ndarray:
    """Values of a tree at points (n, 3): inside where they are at most 0."""
    work: list[np.ndarray] = []
    for _, op, leaf, children in serialize(tree):
        if op == "LEAF":
            a, b, c, d = planes[leaf]
            work.append(a * x[:, 0] + b * x[:, 1] + c * x[:, 2] - d)
        else:
            f = np.minimum.reduce if op == "MIN" else np.maximum.reduce
            work.append(f([work[k] for k in children]))
    return work[-1]


def evaluate_json(points: DataFrame, texts: DataFrame) -> DataFrame:
    """points, all columns, with q of the tree in their frame's JSON text (frame_id, json); a text that fails its checks is an error."""

    def compute(pts: pd.DataFrame, side: tuple[Shared, list[tuple[float, float, float, float]]]) -> dict[str, np.ndarray]:
        return {"q": shared_values(pts[["x", "y", "z"]].to_numpy(), *side)}

    sides = texts.select("frame_id", F.encode("json", "UTF-8").alias("side"))
    return meet(points, sides, lambda side: shared_json(side.decode()), compute, "q double", weight=lambda side: len(side[0]))


def shared_values(x: np.ndarray, rows: Shared, planes: list[tuple[float, float, float, float]]) -> np.ndarray:
    """Values of a shared graph at points (n, 3)."""
    work: dict[int, np.ndarray] = {}
    for i, op, leaf, children in rows:
        if op == "LEAF":
            a, b, c, d = planes[leaf]
            work[i] = a * x[:, 0] + b * x[:, 1] + c * x[:, 2] - d
        else:
            work[i] = (np.minimum if op == "MIN" else np.maximum).reduce([work[k] for k in children])
    return work[rows[-1][0]]


def cluster_tree(planes: DataFrame) -> DataFrame:
    """One row a frame with the tree of its clusters, MIN over cells of MAX of their planes, simplified, as JSON.

    planes: rows (frame_id, cell_id, axis, sign, coord, offset). Equal planes are one leaf.
    """
    leaf = F.dense_rank().over(Window.partitionBy("frame_id").orderBy("axis", "sign", "coord")) - 1
    rows = planes.withColumn("leaf", leaf)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        found = frame.drop_duplicates("leaf").sort_values("leaf")
        normals = [tuple(s if k == a else 0.0 for k in range(3)) for a, s in zip(found["axis"], found["sign"], strict=True)]
        known = [(*map(float, n), float(o)) for n, o in zip(normals, found["offset"], strict=True)]
        cells = [("MAX", *map(int, g["leaf"])) for _, g in frame.groupby("cell_id")]
        raw = ("MIN", *cells) if len(cells) > 1 else cells[0]
        small = simplify(raw)
        return pd.DataFrame(
            {"frame_id": [frame["frame_id"].iloc[0]], "cells": [len(cells)], "leaves": [len(known)], "references": [leaf_references(small)], "depth": [depth(small)], "nodes": [len(serialize(small))], "tree": [to_json(small, known)]}
        )

    return rows.groupBy("frame_id").applyInPandas(run, "frame_id long, cells long, leaves long, references long, depth long, nodes long, tree string")


def dedupe_planes(planes: DataFrame, tolerance: float) -> DataFrame:
    """planes (frame_id, plane_id, nx, ny, nz, offset) with leaf_id: the first earlier plane that is the same within tolerance.

    First match wins in order of plane_id, so the result depends on that order: a kernel over one frame's
    planes. Unit normals count as equal from a cosine of 1 - 1e-12.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("plane_id")
        kept: list[int] = []
        n, d = frame[["nx", "ny", "nz"]].to_numpy(), frame["offset"].to_numpy()
        leaf = np.empty(len(frame), np.int64)
        for i in range(len(frame)):
            k = np.array(kept, dtype=np.int64)
            same = np.flatnonzero((n[k] @ n[i] >= 1 - 1e-12) & (np.abs(d[k] - d[i]) <= tolerance)) if kept else ()
            if len(same):
                leaf[i] = leaf[kept[same[0]]]
            else:
                leaf[i] = len(kept)
                kept.append(i)
        return frame.assign(leaf_id=leaf)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in planes.schema.fields)
    return planes.groupBy("frame_id").applyInPandas(run, fields + ", leaf_id long")
