"""Random trees on a training table of bounded size: rows travel in bins, every task grows whole trees."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.operators import rounds

# Bytes of the training rows in bins (one a column and one for the label), which every task holds.
MOST_BYTES = 1 << 26
# Forests of at most so many leaves are left to Spark ML, whose nodes on the driver are few then.
FEW_LEAVES = 10_000
# Spark ML's number of bins; a cell of a histogram is named by a byte.
BINS = 32
# Most classes that a label tells apart.
MOST_CLASSES = 100
# Trees that a task grows and that travel as one packed block.
BLOCK = 25
# Rows that are counted, and rows that walk down, at once.
CHUNK = 1 << 16
SCORED_ROWS = 1 << 12

CODEC = "zstd"


@dataclass(frozen=True)
class Rows:
    """Training rows in bins (rows by columns), their classes and the weight of every class."""

    bins: np.ndarray
    y: np.ndarray
    weights: np.ndarray


def fits(rows: int, columns: Sequence[str], trees: int, depth: int, min_rows: int) -> bool:
    """Whether a forest is grown here: larger than a few leaves, on a table that a task can hold."""
    return trees * min(2**depth, rows // max(1, min_rows)) > FEW_LEAVES and rows * (len(columns) + 1) <= MOST_BYTES


def class_weights(stored: DataFrame) -> np.ndarray:
    """Balanced weight of every class 0, 1, ... of the column ``y``: rows / (classes x rows of the class)."""
    sizes = {r["y"]: r["n"] for r in stored.groupBy("y").agg(F.count(F.lit(1)).alias("n")).limit(MOST_CLASSES + 1).collect()}
    if not sizes:
        raise ValueError("no labelled row to fit on")
    if any(not 0 <= k < MOST_CLASSES or k != int(k) for k in sizes):
        raise ValueError("a label is no class number")
    weights = np.zeros(max(2, int(max(sizes)) + 1))
    for k, n in sizes.items():
        weights[int(k)] = sum(sizes.values()) / (len(sizes) * n)
    return weights


def in_bins(stored: DataFrame, columns: Sequence[str], n: int, draw: str) -> tuple[Rows, list[np.ndarray]]:
    """The ``n`` stored rows (``y``, ``columns`` and a number of [0, 1) to draw by) in bins, with the cut points.

    Cut points follow Spark ML's rule, on a sample of the rows.  Rows reach the
    driver as a byte a column.
    """
    weights = class_weights(stored)
    sample = stored.where(F.col(draw) < max(BINS * BINS, rounds.CUT_ROWS) / n).select("y", *columns).toArrow()
    x = rounds.features(sample.columns[1:])
    weight = weights[sample.column(0).to_numpy().astype(np.int64)]
    cuts = [rounds.cuts_of(v, min(BINS, n), weight) for v in x]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                y = batch.column(0).to_numpy().astype(np.uint8)
                found = [np.searchsorted(c, v, "left").astype(np.uint8) for c, v in zip(cuts, rounds.features(batch.columns[1:]), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([np.stack([y, *found], axis=1).tobytes()], pa.binary())], names=["packed"])

    packed = stored.select("y", *columns).mapInArrow(pack, "packed binary").toArrow().column(0)
    whole = np.concatenate([np.frombuffer(p.as_buffer(), np.uint8) for p in packed]).reshape(-1, len(columns) + 1)
    return Rows(np.ascontiguousarray(whole[:, 1:]), np.ascontiguousarray(whole[:, 0]), weights), cuts


def _best(counts: np.ndarray, weights: np.ndarray, min_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best cut of each node by weighted Gini impurity: what remains pure on both sides, its bin, and the rows left of it.

    ``counts`` are nodes by bins by classes.
    """
    left_rows = np.cumsum(counts[..., 0], axis=1)
    lefts = [left_rows]
    for k in range(1, counts.shape[2]):
        lefts.append(np.cumsum(counts[..., k], axis=1))
        left_rows = left_rows + lefts[-1]
    right_rows = left_rows[:, -1:] - left_rows
    left_weight, left_pure, right_weight, right_pure = (np.zeros(left_rows.shape) for _ in range(4))
    for w, rows in zip(weights, lefts, strict=True):
        if w:
            here = rows * w
            there = rows[:, -1:] * w - here
            left_weight += here
            right_weight += there
            left_pure += here * here
            right_pure += there * there
    usable = (left_rows >= max(1, min_rows)) & (right_rows >= max(1, min_rows))
    pure = np.where(usable, left_pure / np.where(usable, left_weight, 1.0) + right_pure / np.where(usable, right_weight, 1.0), -1.0)
    bin_ = pure.argmax(axis=1)
    every = np.arange(len(bin_))
    return pure[every, bin_], bin_, np.stack([rows[every, bin_] for rows in lefts], axis=1)


def tree(rows: Rows, number: int, depth: int, min_rows: int, drawn: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Grow one tree level by level on all rows; returns its cells and P(class 1) of its leaves as a complete heap.

    A cell is column x (BINS - 1) + bin of an inner node; ``width x (BINS - 1)``
    sends every row left.  Counts are whole numbers, so a tree does not depend
    on the order of the rows.  As in Spark ML, sister leaves of the same class
    become one.
    """
    n, width = rows.bins.shape
    classes, weights = len(rows.weights), rows.weights
    flat, y = rows.bins.ravel(), rows.y
    # where the bins of a row begin, the row's node, its class
    begins, slot = np.arange(0, n * width, width), np.zeros(n, np.int64)
    nodes, totals = np.array([0]), np.bincount(y, minlength=classes)[None, :]
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # nodes, cells (-1: leaf), class counts
    for level in range(depth + 1):
        cells = np.full(len(nodes), -1)
        levels.append((nodes, cells, totals))
        open_ = np.flatnonzero((totals.sum(axis=1) >= 2 * max(1, min_rows)) & ((totals > 0).sum(axis=1) > 1)) if level < depth else np.empty(0, np.int64)
        if not len(open_):
            break
        if len(open_) < len(nodes):
            place = np.full(len(nodes), -1)
            place[open_] = np.arange(len(open_))
            slot = place[slot]
            stays = slot >= 0
            begins, slot, y = begins[stays], slot[stays], y[stays]
        columns = np.sort(np.random.default_rng([seed, number, level]).random((len(open_), width)).argsort(axis=1)[:, :drawn], axis=1).T.copy()
        size = len(open_) * BINS * classes
        counts = np.zeros((drawn, size), np.int64)
        for at in range(0, len(slot), CHUNK):
            some, of = begins[at : at + CHUNK], slot[at : at + CHUNK]
            first = of * (BINS * classes)
            first += y[at : at + CHUNK]
            for j in range(drawn):
                cell = columns[j].take(of)
                cell += some
                cell = np.multiply(flat.take(cell), classes, dtype=np.int64)
                cell += first
                counts[j] += np.bincount(cell, minlength=size)
        pure, column, cut, left = np.full(len(open_), -1.0), np.zeros(len(open_), np.int64), np.zeros(len(open_), np.int64), np.zeros((len(open_), classes), np.int64)
        for j in range(drawn):
            found, bin_, rows_left = _best(counts[j].reshape(len(open_), BINS, classes), weights, min_rows)
            better = found > pure
            pure[better], column[better], cut[better], left[better] = found[better], columns[j, better], bin_[better], rows_left[better]
        weighted = totals[open_] * weights
        base = (weighted**2).sum(axis=1) / weighted.sum(axis=1)
        split = pure > base * (1 + 1e-12)
        if not split.any():
            break
        cells[open_[split]] = column[split] * (BINS - 1) + cut[split]
        parents = nodes[open_[split]]
        nodes = np.stack([2 * parents, 2 * parents + 1], axis=1).ravel()
        totals = np.stack([left[split], totals[open_[split]] - left[split]], axis=1).reshape(-1, classes)
        if level + 1 < depth:
            to = np.full(len(open_), -1)
            to[split] = 2 * np.arange(split.sum())
            stays, moved = np.empty(len(slot), bool), np.empty(len(slot), np.int64)
            for at in range(0, len(slot), CHUNK):
                of = slot[at : at + CHUNK]
                goes = to.take(of)
                stays[at : at + CHUNK] = goes >= 0
                goes += flat.take(column.take(of) + begins[at : at + CHUNK]) > cut.take(of)
                moved[at : at + CHUNK] = goes
            begins, slot, y = begins[stays], moved[stays], y[stays]
    return _complete(_pruned(levels, weights), weights, width * (BINS - 1))


def _pruned(levels: list, weights: np.ndarray) -> list:
    """Sister leaves of the same class become one leaf, from the deepest level up."""
    levels = list(levels)
    for level in range(len(levels) - 2, -1, -1):
        (nodes, cells, totals), (below, cells_below, totals_below) = levels[level], levels[level + 1]
        called = (totals_below * weights).argmax(axis=1)
        leaf = cells_below < 0
        # children lie in pairs, in the order of the parents that are split
        merged = leaf[::2] & leaf[1::2] & (called[::2] == called[1::2])
        inner = np.flatnonzero(cells >= 0)
        cells = cells.copy()
        cells[inner[merged]] = -1
        stays = np.repeat(~merged, 2)
        levels[level], levels[level + 1] = (nodes, cells, totals), (below[stays], cells_below[stays], totals_below[stays])
    return [part for part in levels if len(part[0])]


def _complete(levels: list, weights: np.ndarray, never: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells and leaves as a complete heap: below a leaf everything goes left."""
    depth = len(levels) - 1
    heap, value = np.full(2**depth - 1, never), np.zeros(2**depth)
    for level, (nodes, cells, totals) in enumerate(levels):
        inner = cells >= 0
        if level < depth:
            heap[2**level - 1 + nodes[inner]] = cells[inner]
        weighted = totals[~inner] * weights
        value[nodes[~inner] << (depth - level)] = weighted[:, 1] / weighted.sum(axis=1)
    return heap.astype("<u4" if never >= 1 << 16 else "<u2"), value.astype("<f4")


def grow(spark, rows: Rows, trees: int, depth: int, min_rows: int, drawn: int, seed: int) -> list[tuple[list[int], int, bytes]]:
    """All trees in packed blocks: the depths of its trees, its bytes, and these compressed.

    The rows in bins are broadcast, every task grows BLOCK trees, and only
    finished blocks reach the driver, whose size the settings bound.
    """
    shared = spark.sparkContext.broadcast(rows)

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.column(0).to_pylist():
                grown = [tree(shared.value, t, depth, min_rows, drawn, seed) for t in range(b * BLOCK, min(trees, (b + 1) * BLOCK))]
                raw = b"".join(part.tobytes() for pair in grown for part in pair)
                depths = [(len(value)).bit_length() - 1 for _, value in grown]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b], pa.int64()), pa.array([depths], pa.list_(pa.int32())), pa.array([len(raw)], pa.int64()), pa.array([pa.compress(raw, CODEC, asbytes=True)], pa.binary())],
                    names=["block", "depths", "size", "packed"])

    blocks = -(-trees // BLOCK)
    found = spark.range(0, blocks, 1, blocks).mapInArrow(block, "block long, depths array<int>, size long, packed binary").toArrow().sort_by("block")
    shared.unpersist()
    return [(r["depths"], r["size"], r["packed"]) for r in found.drop_columns("block").to_pylist()]


class Forest:
    """The mean of all trees.  Blocks are unpacked one after the other, so a worker holds the packed forest and one block."""

    def __init__(self, spark, blocks: list, cuts: list[np.ndarray], columns: Sequence[str]) -> None:
        self.columns, self.cuts = list(columns), cuts
        self.trees = sum(len(depths) for depths, _, _ in blocks)
        self.shared = spark.sparkContext.broadcast(blocks)

    def score(self, df: DataFrame, out: str) -> DataFrame:
        shared, cuts, trees = self.shared, self.cuts, self.trees

        @F.pandas_udf("double")
        def probability(*columns: pd.Series) -> pd.Series:
            x = rounds.features(columns)
            return pd.Series(totals(x, shared.value, cuts) / trees)

        return df.select(*df.columns, probability(*[F.col(c).cast("double") for c in self.columns]).alias(out))


def totals(x: np.ndarray, blocks: list, cuts: list[np.ndarray]) -> np.ndarray:
    """Sum over all trees of the leaf that each column of ``x`` (features by rows) ends in."""
    n, width = x.shape[1], len(cuts)
    never = width * (BINS - 1)
    kind = np.dtype("<u4" if never >= 1 << 16 else "<u2")
    total, parts = np.zeros(n), []
    for at in range(0, n, SCORED_ROWS):
        some = x[:, at : at + SCORED_ROWS]
        # whether a row goes right at a cell
        right = np.zeros((never + 1, some.shape[1]), np.uint8)
        for c, (points, v) in enumerate(zip(cuts, some, strict=True)):
            right[c * (BINS - 1) : c * (BINS - 1) + len(points)] = v > points[:, None]
        parts.append((at, right.ravel(), np.arange(some.shape[1])))
    for depths, size, packed in blocks if n else ():
        raw, offset, grown = pa.decompress(packed, size, CODEC, asbytes=True), 0, []
        for depth in depths:
            cells = np.frombuffer(raw, kind, 2**depth - 1, offset).astype(np.int64)
            offset += cells.size * kind.itemsize
            grown.append((depth, cells, np.frombuffer(raw, "<f4", 2**depth, offset)))
            offset += grown[-1][2].nbytes
        for at, right, own in parts:
            for depth, cells, value in grown:
                first = cells * len(own)
                node = np.zeros(len(own), np.int64)
                for level in range(depth):
                    goes = first[2**level - 1 : 2 ** (level + 1) - 1][node]
                    goes += own
                    node <<= 1
                    node += right[goes]
                total[at : at + len(own)] += value[node]
    return total
