"""Isolation forests, one per class, built and scored by Spark tasks.

Each tree is grown by one task from its own sample of at most ``psi`` rows, so
a group never exceeds that bound.  A forest is ``trees x 2 psi`` nodes at most
and is broadcast for scoring in Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.operators import ordering as O
from quillmark.sources.session import bounded, materialize

NODE_SCHEMA = (
    "class int, tree int, node int, feature int, split double, left int, right int, depth_score double"
)


# Upper bound of the broadcast node table (about 40 bytes a node).
MAX_NODES = 5_000_000
# Rows that walk down all trees side by side.
BLOCK_ROWS = 256
# Upper bound of the broadcast (key, class, tree) assignment.
MAX_SAMPLE_ROWS = 1_000_000


def _mean_path(n: float) -> float:
    """Average path length of an unsuccessful search among ``n`` points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes of one tree: (feature, split, left, right, path length at a leaf)."""
    nodes: list[tuple] = [None]
    todo = [(0, x, 0)]
    while todo:
        slot, rows, depth = todo.pop()
        low, high = rows.min(axis=0), rows.max(axis=0)
        varying = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or not len(varying):
            nodes[slot] = (-1, 0.0, -1, -1, depth + _mean_path(len(rows)))
            continue
        f = int(rng.choice(varying))
        cut = float(rng.uniform(low[f], high[f]))
        goes_left = rows[:, f] <= cut
        left, right = len(nodes), len(nodes) + 1
        nodes += [None, None]
        nodes[slot] = (f, cut, left, right, 0.0)
        todo += [(left, rows[goes_left], depth + 1), (right, rows[~goes_left], depth + 1)]
    return nodes


def tree_samples(df: DataFrame, label: str, key: str, trees: int, psi: int, seed: int) -> DataFrame:
    """Which rows each (class, tree) sample holds, without replacement inside a tree.

    A round is a seeded permutation of a class cut into samples of ``psi``; as
    many rounds are used as the trees need.  A large class needs one round and
    only its lowest hashes are touched, a small one is re-dealt in each round,
    so about ``trees x psi`` keys per class are shuffled in either case.  The
    features stay where they are: the result is ``key, class, tree, psi``.
    """
    known = df.where(F.col(label).isNotNull()).select(key, F.col(label).cast("int").alias("class"))
    counts = {r["class"]: r["count"] for r in known.groupBy("class").count().collect()}

    def per_class(value: Callable[[int], int]) -> Column:
        out = F.lit(0)
        for k, n in counts.items():
            out = F.when(F.col("class") == k, F.lit(value(n))).otherwise(out)
        return out

    def per_round(n: int) -> int:
        return min(trees, max(1, n // min(psi, n)))

    near = materialize(O.take_lowest(known, ["class"], key, trees * psi, seed), "near")
    dealt = near.withColumns({
        "psi": per_class(lambda n: min(psi, n)),
        "_cuts": per_class(per_round),
        "_round": F.explode(F.sequence(F.lit(0), per_class(lambda n: math.ceil(trees / per_round(n)) - 1))),
    }).withColumn("_deal", F.concat_ws("|", F.col(key).cast("string"), F.col("_round").cast("string")))
    ranked = O.hash_rank(dealt, ["class", "_round"], "_deal", seed, "_rank")
    cut = F.floor((F.col("_rank") - 1) / F.col("psi"))
    return (
        ranked.where(cut < F.col("_cuts"))
        .withColumn("tree", (F.col("_round") * F.col("_cuts") + cut).cast("int"))
        .where(F.col("tree") < trees)
        .select(key, "class", "tree", "psi")
    )


def fit(
    df: DataFrame, columns: Sequence[str], label: str = "label", key: str = "id",
    trees: int = 400, psi: int = 256, seed: int = 123456,
    prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> DataFrame:
    """A forest per class as a table of nodes.

    ``prepare`` turns raw columns into those the trees are grown on; it sees
    the sampled rows only.
    """
    columns = list(columns)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        k, t = int(pdf["class"].iloc[0]), int(pdf["tree"].iloc[0])
        pdf = pdf.sort_values(key)  # arrival order differs between runs
        x = pdf[columns].to_numpy(dtype=float)
        limit = math.ceil(math.log2(max(int(pdf["psi"].iloc[0]), 2)))
        nodes = _grow(x, np.random.default_rng([seed, k, t]), limit)
        out = pd.DataFrame(nodes, columns=["feature", "split", "left", "right", "depth_score"])
        out.insert(0, "node", range(len(out)))
        out.insert(0, "tree", t)
        out.insert(0, "class", k)
        return out

    # The assignment is a few thousand keys per tree, so the table of features
    # is filtered map-side and only sampled rows reach the tree builders.
    samples, _ = bounded(tree_samples(df, label, key, trees, psi, seed), MAX_SAMPLE_ROWS)
    rows = prepare(df.select(key, *columns).join(samples, key))
    return rows.groupBy("class", "tree").applyInPandas(build, NODE_SCHEMA)


def score(df: DataFrame, forest: DataFrame, columns: Sequence[str], psi: dict[int, int], names: dict[int, str]) -> DataFrame:
    """Append one decision value per class forest (higher is more normal).

    ``psi`` is the sample size each forest was grown with.  All trees of a class
    lie side by side level by level, and a block of rows walks down all of them
    at once.  At most ``MAX_NODES`` nodes are broadcast
    in one piece; a larger forest travels in several, whose paths add up.
    """
    columns = list(columns)
    per_tree = forest.groupBy("class", "tree").agg(F.count(F.lit(1)).alias("n")).orderBy("class", "tree").collect()
    pieces: list[list[tuple[int, int]]] = [[]]
    held = 0
    for r in per_tree:
        if held and held + r["n"] > MAX_NODES:
            pieces.append([])
            held = 0
        pieces[-1].append((int(r["class"]), int(r["tree"])))
        held += r["n"]
    classes = sorted({int(r["class"]) for r in per_tree})
    trees = {k: sum(int(r["class"]) == k for r in per_tree) for k in classes}
    paths: dict[int, list[Column]] = {k: [] for k in classes}
    scored = df
    for i, piece in enumerate(pieces):
        inside = sorted({k for k, _ in piece})
        # (class, tree) pairs are in order, so a piece is a range of them
        pair = F.struct("class", "tree")
        low, high = (F.struct(F.lit(k).alias("class"), F.lit(t).alias("tree")) for k, t in (piece[0], piece[-1]))
        nodes = forest.where((pair >= low) & (pair <= high)).toPandas().sort_values(["class", "tree", "node"])
        packed = {k: _stack(nodes[nodes["class"] == k]) for k in inside}
        walk = _walker(df, packed, {k: sum(c == k for c, _ in piece) for k in inside}, columns)
        scored = scored.withColumn(f"_f{i}", walk(F.struct(*columns)))
        for k in inside:
            paths[k].append(F.col(f"_f{i}.p{k}"))
    norm = {k: _mean_path(psi[k]) or 1.0 for k in classes}
    mean = {k: reduce(lambda a, b: a + b, paths[k]) / F.lit(float(trees[k])) for k in classes}
    return scored.select(*df.columns, *[(F.lit(0.5) - F.pow(F.lit(2.0), -mean[k] / F.lit(norm[k]))).alias(names[k]) for k in classes])


def _stack(nodes: pd.DataFrame) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """All trees of a class level by level: features and cuts of the ``trees x 2^level`` places, then the leaf values.

    A leaf above the lowest level leads to itself on both sides.  No tree is
    deeper than ``log2(psi)``, so a level has at most ``trees x 2 psi`` places.
    """
    size = nodes.groupby("tree", sort=True).size().to_numpy()
    roots = np.cumsum(size) - size
    shift = np.repeat(roots, size)
    own = np.arange(len(nodes))
    feature = nodes["feature"].to_numpy()
    left = np.where(feature < 0, own, nodes["left"].to_numpy() + shift)
    right = np.where(feature < 0, own, nodes["right"].to_numpy() + shift)
    split, levels, at = nodes["split"].to_numpy(), [], roots[:, None]
    while (feature[at] >= 0).any():
        levels.append((np.maximum(feature[at], 0).ravel().astype(np.intp), split[at].ravel()))
        at = np.stack([left[at], right[at]], axis=2).reshape(len(roots), -1)
    return levels, nodes["depth_score"].to_numpy()[at].ravel()


def _path_sums(x: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]], leaf: np.ndarray, trees: int) -> np.ndarray:
    """Summed leaf values of each row; BLOCK_ROWS rows go down all trees at once, a level at a time."""
    total = np.empty(len(x))
    tree = np.arange(trees)
    for a in range(0, len(x), BLOCK_ROWS):
        block = np.ascontiguousarray(x[a : a + BLOCK_ROWS])
        row = np.arange(len(block))[:, None] * block.shape[1]
        at = np.broadcast_to(tree, (len(block), trees))
        for feature, cut in levels:
            # a missing value is not below the cut
            goes_right = ~(block.ravel().take(feature.take(at) + row) <= cut.take(at))
            at = 2 * at + goes_right
        total[a : a + BLOCK_ROWS] = leaf.take(at).sum(axis=1)
    return total


def _walker(df: DataFrame, packed: dict[int, tuple], trees: dict[int, int], columns: list[str]):
    """Arrow UDF: summed path length of each row in the trees of each class."""
    shared = df.sparkSession.sparkContext.broadcast(packed)

    @F.pandas_udf(", ".join(f"p{k} double" for k in sorted(packed)))
    def walk(batch: pd.DataFrame) -> pd.DataFrame:
        x = batch[columns].to_numpy(dtype=float)
        return pd.DataFrame({f"p{k}": _path_sums(x, levels, leaf, trees[k]) for k, (levels, leaf) in sorted(shared.value.items())})

    return walk
