"""Exact search for the highest inner products, pruned by segment statistics from coarse to fine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmark.llm.base import materialize, small_batches

TOP = 5
#: Components are turned into floor(SCALE * x).
SCALE = 256.0
#: Sums of products of whole numbers are exact in doubles below this; beyond it they are added up as Python integers.
EXACT = 2.0**52
#: Rows of a candidate block and of a query block; blocks that one task walks through in a row.
BLOCK_ROWS = 2048
QUERY_ROWS = 4096
GROUP_BLOCKS = 4
#: Segments per resolution, coarse to fine.
SEGMENTS = (1, 4, 16)


def _pack(dims: int):
    """Rows of one block -> one row with ids and an (n, dims) table of whole numbers."""

    def run(table: pa.Table) -> pa.Table:
        ids = np.sort(table["vec_id"].to_numpy())
        order = np.argsort(table["vec_id"].to_numpy(), kind="stable")
        vectors = np.zeros((len(ids), dims))
        for i, v in enumerate(table["vector"].to_pylist()):
            vectors[i, : len(v)] = np.floor(SCALE * np.asarray(v, float))
        return pa.table({
            "block": table["block"].slice(0, 1), "ids": pa.array([ids.astype("<i8").tobytes()], pa.binary()),
            "vectors": pa.array([vectors[order].astype("<f8").tobytes()], pa.binary()),
        })

    return run


def segment_table(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of equal segments, each times the square root of the segment's length.

    For two such rows a and b, |a - b|^2 is a lower bound of the squared
    distance of the vectors and a . b an upper bound of their inner product (in
    a segment of m components, the parts around the means have an inner product
    of at most m times the product of the deviations).  Finer segments never
    loosen the bound.
    """
    edges = np.unique(np.linspace(0, x.shape[1], segments + 1).astype(int))
    out = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        part = x[:, a:b]
        mean = part.mean(axis=1)
        spread = np.sqrt(np.maximum((part**2).mean(axis=1) - mean**2, 0.0))
        out += [mean * np.sqrt(b - a), spread * np.sqrt(b - a)]
    return np.stack(out, axis=1) if out else np.zeros((len(x), 1))


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows of whole numbers, exactly; a ValueError if one does not fit 64 bits."""
    with np.errstate(over="ignore", invalid="ignore"):
        scores = np.einsum("ij,ij->i", a, b)
        # the norms bound every partial sum
        sure = np.sqrt((a**2).sum(axis=1)) * np.sqrt((b**2).sum(axis=1)) < EXACT
    out = np.zeros(len(a), np.int64)
    out[sure] = scores[sure].astype(np.int64)
    for i in np.flatnonzero(~sure).tolist():
        both = np.flatnonzero((a[i] != 0) & (b[i] != 0))
        score = sum(int(x) * int(y) for x, y in zip(a[i, both].tolist(), b[i, both].tolist(), strict=True))
        if not -(2**63) < score < 2**63:
            raise ValueError("an inner product does not fit 64 bits")
        out[i] = score
    return out


class Best:
    """The best scores so far of every query of a block; ties go to the smaller id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, top: int) -> None:
        self.ids, self.vectors, self.top = ids, vectors, top
        self.scores = np.full((len(ids), top), np.iinfo(np.int64).min)
        self.found = np.full((len(ids), top), np.iinfo(np.int64).max)
        with np.errstate(over="ignore", invalid="ignore"):
            self.square = (vectors**2).sum(axis=1)
            self.levels = [segment_table(vectors, s) for s in SEGMENTS]

    def survivors(self, vectors: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a query and a candidate whose bound reaches the floor; a bound beyond doubles excludes nothing."""
        square = (vectors**2).sum(axis=1)
        # what rounding may add to a bound
        slack = 1e-9 * (1.0 + np.sqrt(self.square)[:, None] * np.sqrt(square)[None, :])
        alive = np.ones((len(self.ids), len(vectors)), bool)
        columns = np.arange(len(vectors))
        for level, segments in zip(self.levels, SEGMENTS, strict=True):
            table = segment_table(vectors[columns], segments)
            nearest = np.maximum((level**2).sum(axis=1)[:, None] + (table**2).sum(axis=1)[None, :] - 2 * level @ table.T, 0.0)
            most = (self.square[:, None] + square[columns][None, :] - nearest) / 2
            # rounding of the squares, which may dwarf the product, counts as well
            spare = slack[:, columns] + 1e-12 * (self.square[:, None] + square[columns][None, :])
            alive[:, columns] &= ~(most + spare < floor[:, None])
            columns = np.flatnonzero(alive.any(axis=0))
            if len(columns) == 0:
                break
        return np.nonzero(alive)

    def offer(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        floor = np.where(self.found[:, -1] == np.iinfo(np.int64).max, -np.inf, self.scores[:, -1])
        with np.errstate(over="ignore", invalid="ignore"):
            rows, places = self.survivors(vectors, floor)
            other = ids[places] != self.ids[rows]
            rows, places = rows[other], places[other]
            if len(rows) == 0:
                return
            largest = np.sqrt(self.square.max()) * np.sqrt((vectors**2).sum(axis=1).max())
            if largest < EXACT and len(rows) * 3 > len(self.ids) * len(vectors):
                scores = (self.vectors @ vectors.T)[rows, places].astype(np.int64)
            else:
                scores = np.concatenate([
                    inner_products(self.vectors[rows[a : a + 65536]], vectors[places[a : a + 65536]]) for a in range(0, len(rows), 65536)
                ])
        better = scores >= floor[rows]
        rows, places, scores = rows[better], places[better], scores[better]
        if len(rows) == 0:
            return
        keep = np.unique(rows)
        old = np.repeat(keep, self.top)
        rows, names = np.concatenate([old, rows]), np.concatenate([self.found[keep].ravel(), ids[places]])
        scores = np.concatenate([self.scores[keep].ravel(), scores])
        order = np.lexsort((names, ~scores, rows))
        rows, names, scores = rows[order], names[order], scores[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        best = rank < self.top
        self.scores[rows[best], rank[best]] = scores[best]
        self.found[rows[best], rank[best]] = names[best]

    def result(self) -> pa.RecordBatch:
        real = self.found < np.iinfo(np.int64).max
        query = np.repeat(self.ids, self.top).reshape(self.scores.shape)
        return pa.RecordBatch.from_arrays(
            [pa.array(query[real], pa.int64()), pa.array(self.found[real], pa.int64()), pa.array(self.scores[real], pa.int64())],
            names=["query_id", "vec_id", "score"],
        )


def _search(dims: int, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best = None, None
        for batch in batches:
            for i in range(batch.num_rows):  # one row is a block of candidates and a block of queries
                key = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
                if key != now:
                    if best is not None:
                        yield best.result()
                    best = Best(np.frombuffer(batch.column(4)[i].as_buffer(), "<i8"), np.frombuffer(batch.column(5)[i].as_buffer(), "<f8").reshape(-1, dims), top)
                    now = key
                best.offer(np.frombuffer(batch.column(2)[i].as_buffer(), "<i8"), np.frombuffer(batch.column(3)[i].as_buffer(), "<f8").reshape(-1, dims))
        if best is not None:
            yield best.result()

    return run


def top_k(vectors: DataFrame, is_query: Column, top: int = TOP, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``top`` highest inner products of every query with all other rows: ``query_id, rank, vec_id, score``.

    Components count as floor(256 x).  Rows are packed into blocks of bounded
    size; every query block meets every candidate block.  A task walks through a
    few candidate blocks and keeps the best scores of its queries; a candidate
    whose lower-bound distance (hence upper-bound score) by segment means and
    deviations can't reach the last of them is dropped, first by one segment,
    then by 4, then by 16, and only survivors are multiplied out.  Scores are
    exact whole numbers whatever the size of the components; one that a long
    can't hold raises an error.

    Ties: the smaller id first.  Rows with a null id, a null vector or a null or
    non-finite component take no part.  Shorter vectors count as filled up with
    zeros.  Rows that repeat an id do not find each other; a
    repeated query is asked once.  Fewer rows than ``top`` give fewer ranks, an empty table none; extra columns are ignored.
    """
    small_batches(vectors)
    x = F.col(vector)
    fine = F.col(key).isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    rows = vectors.where(fine).select(F.col(key).cast("long").alias("vec_id"), x.cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    n, asked, dims = rows.agg(F.count("*"), F.count_if("asks"), F.max(F.size("vector"))).first()
    dims = max(int(dims or 0), 1)
    blocks, query_blocks = -(-n // BLOCK_ROWS) or 1, -(-asked // QUERY_ROWS) or 1
    groups = -(-blocks // GROUP_BLOCKS)

    def packed(part: DataFrame, count: int, name: str) -> DataFrame:
        dealt = part.select("vec_id", "vector", F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int").alias("block"))
        return materialize(dealt.groupBy("block").applyInArrow(_pack(dims), "block int, ids binary, vectors binary"), name)

    queries = rows.where("asks").groupBy("vec_id").agg(F.min("vector").alias("vector"))
    candidates = packed(rows, blocks, "candidates").select(
        (F.col("block") % groups).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("block"), "ids", "vectors")
    asking = packed(queries, query_blocks, "queries").select(
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"), "block", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    met = candidates.join(asking.hint("merge"), ["block", "part"]).select("block", "part", "ids", "vectors", "q_ids", "q_vectors")
    found = met.mapInArrow(_search(dims, top), "query_id long, vec_id long, score long")
    by_score = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "vec_id", "score")
