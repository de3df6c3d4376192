"""Exact ranks, running totals and order statistics without a one-task window.

A ranking over a group that holds a third of the table cannot live in a single
window partition.  Each function here first splits the order into ranges, ranks
inside a range, and adds the size of all earlier ranges.  Results are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.sources.session import bounded, materialize

# Largest table that is pulled to the driver and broadcast (rows).
SMALL = 200_000
# Rows that one task may rank in one window.
RANGE_ROWS = 2_000_000
# Rows that a quantile grid draws its cut points from (on average), and cells between two landmarks.
CUT_SAMPLE = 100_000
CELLS = 8


def hash_key(key: str, seed: int) -> Column:
    """Deterministic pseudo-random order: md5 of the key and the seed."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed))))


def attach(df: DataFrame, table: DataFrame, on: Sequence[str], values: Sequence[str], how: str = "left") -> DataFrame:
    """Null-safe equi-join that keeps ``df``'s columns and adds ``values``."""
    renamed = table.select(*[F.col(c).alias(f"_r_{c}") for c in on], *values)
    condition = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on])
    return df.join(renamed, condition, how).drop(*[f"_r_{c}" for c in on])


def _ranged(df: DataFrame, by: Sequence[str], key: str, seed: int) -> tuple[DataFrame, DataFrame, bool]:
    """``df`` with hash ``_h`` and range ``_b``; the size ``_n`` of every range; if those are few.

    The leading hex digits of the hash cut each group into 4096 even ranges, so
    a hot group spreads over the cluster.  When a range would still be too long
    for one task, more digits are used.
    """
    marked = df.withColumn("_h", hash_key(key, seed))
    digits = 3
    while True:
        ranged = marked.withColumn("_b", F.substring("_h", 1, digits))
        sizes, small = bounded(ranged.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n")), SMALL)
        longest = sizes.agg(F.max("_n")).first()[0] or 0
        if longest <= RANGE_ROWS or digits >= 8:
            return ranged, sizes, small
        digits += math.ceil(math.log(longest / RANGE_ROWS, 16))


def hash_rank(df: DataFrame, by: Sequence[str], key: str, seed: int = 42, out: str = "rank") -> DataFrame:
    """Exact 1-based rank of every row inside its group, in hash order.

    One pass sizes the hash ranges, a second ranks inside them; the rows are
    shuffled once, by group and range.
    """
    ranged, sizes, small = _ranged(df, by, key, seed)
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    # one offset per range: as few rows as the sizes that were just checked
    offsets = F.broadcast(offsets) if small else offsets
    local = Window.partitionBy(*by, "_b").orderBy("_h", key)
    ranked = ranged.withColumn("_local", F.row_number().over(local))
    placed = attach(ranked, offsets, [*by, "_b"], ["_off"])
    return placed.withColumn(out, F.col("_off") + F.col("_local")).drop("_h", "_b", "_off", "_local")


def boundaries(df: DataFrame, by: Sequence[str], key: str, quota: int | DataFrame, seed: int = 42) -> DataFrame:
    """Where the ``quota`` lowest hashes of each group end: one row ``<by>, last_h, last_key`` per group.

    ``quota`` is one number, or a table of the group columns plus ``quota``; a
    group without one has no row.  ``df`` needs the group columns and the key
    only.  Range sizes tell in which hash range a group reaches its quota, and
    only that range is ranked.
    """
    marked, sizes, _ = _ranged(df.select(*by, key), by, key, seed)
    upto = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    sizes = sizes.withColumn("_upto", F.sum("_n").over(upto))
    if isinstance(quota, int):
        sizes = sizes.withColumn("_quota", F.lit(quota).cast("bigint"))
    else:
        sizes = attach(sizes, quota.withColumnRenamed("quota", "_quota"), by, ["_quota"], "inner")
    # A range is kept whole while the group's running size stays within its
    # quota; the first range that passes the quota is cut inside.
    room = F.col("_quota") - (F.col("_upto") - F.col("_n"))
    taken = sizes.where(room > 0).withColumn("_room", F.least(room, F.col("_n")))
    edges = taken.groupBy(*by).agg(F.max("_b").alias("_last"), F.max_by("_room", "_b").alias("_room"))
    edges, small = bounded(edges, SMALL)
    if not by:
        edge = edges.first()
        last, room = (edge["_last"], edge["_room"]) if edge else (None, None)
        near = marked.where(F.col("_b") == F.lit(last)).withColumn("_room", F.lit(room))
    elif small:
        near = attach(marked, edges, by, ["_last", "_room"], "inner").where(F.col("_b") == F.col("_last"))
    else:
        # too many groups to broadcast: the range is part of the join key, so a hot group brings one of its ranges
        near = attach(marked, edges.withColumn("_b", F.col("_last")), [*by, "_b"], ["_last", "_room"], "inner")
    local = Window.partitionBy(*by, "_b").orderBy("_h", key)
    cut = near.withColumn("_local", F.row_number().over(local)).where(F.col("_local") == F.col("_room"))
    return cut.select(*by, F.col("_h").alias("last_h"), F.col(key).alias("last_key"))


def upto_boundary(last: DataFrame, by: Sequence[str], key: str, seed: int) -> Column:
    """Whether a row of a table without groups lies within its boundary (one row, as literals)."""
    row = last.first()
    if row is None:
        return F.lit(False)
    return _within(key, seed, F.lit(row["last_h"]), F.lit(row["last_key"]))


def _within(key: str, seed: int, last_h: Column, last_key: Column) -> Column:
    h = hash_key(key, seed)
    return (h < last_h) | ((h == last_h) & (F.col(key) <= last_key))


def take_lowest(df: DataFrame, by: Sequence[str], key: str, quota: int | DataFrame, seed: int = 42) -> DataFrame:
    """Exactly ``quota`` rows per group (all of a smaller group), lowest hashes first.

    The boundary of each group comes from the group columns and the key alone;
    the rows themselves are read once and filtered map-side, without a shuffle,
    as long as the boundaries are few enough to broadcast.  Keys are unique.
    """
    last, small = bounded(boundaries(df, by, key, quota, seed), SMALL)
    if small and not by:
        return df.where(upto_boundary(last, by, key, seed))
    kept = attach(df, last, by, ["last_h", "last_key"], "inner")
    return kept.where(_within(key, seed, F.col("last_h"), F.col("last_key"))).select(*df.columns)


def _lower_bounds(bounds: str, value: Column, size: int) -> Column:
    """How many of the ascending ``bounds`` (at most ``size``) lie below ``value``, by halving steps."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(size.bit_length()))])
    # a step beyond the last bound reads null and isn't taken
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(bounds, at + step - 1) < value, at + step).otherwise(at))


def running_totals(
    counts: DataFrame, by: Sequence[str], value: str, weights: Sequence[str], ranges: int | None = None
) -> DataFrame:
    """Inclusive running sums of ``weights`` in ``value`` order inside each group.

    ``counts`` holds one row per distinct value.  Adds ``cum_<weight>``.  Small
    groups use one window; otherwise approximate quantiles cut every group into
    value ranges (any cut is correct, the quantiles only keep them even).
    """
    spark = counts.sparkSession
    if ranges is None:
        # as many ranges as keep each within what one task may rank
        longest = counts.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0
        ranges = max(2, min(256, int(spark.conf.get("spark.sql.shuffle.partitions", "200"))), 2 * math.ceil(longest / RANGE_ROWS))
    probs = [i / ranges for i in range(1, ranges)]
    cut_rows = counts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"),
        F.percentile_approx(value, probs, max(1000, 10 * ranges)).alias("_bounds"),
    )
    cut_rows, small = bounded(cut_rows, SMALL // ranges)
    if small and not cut_rows.where(F.col("_n") > SMALL).take(1):
        w = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
        return counts.withColumns({f"cum_{c}": F.sum(c).over(w) for c in weights})

    if by:
        cut = attach(counts, cut_rows, by, ["_bounds"])
    else:
        cut = counts.withColumn("_bounds", F.array(*[F.lit(b) for b in cut_rows.first()["_bounds"]]))
    cut = cut.withColumn("_range", _lower_bounds("_bounds", F.col(value), ranges)).drop("_bounds")
    totals = cut.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_t_{c}") for c in weights])
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by,
        "_range",
        *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in weights],
    )
    offsets, _ = bounded(offsets, SMALL)
    local = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    summed = cut.withColumns({f"_s_{c}": F.sum(c).over(local) for c in weights})
    placed = attach(summed, offsets, [*by, "_range"], [f"_o_{c}" for c in weights])
    return placed.withColumns(
        {f"cum_{c}": F.col(f"_s_{c}") + F.col(f"_o_{c}") for c in weights}
    ).drop("_range", *[f"_s_{c}" for c in weights], *[f"_o_{c}" for c in weights])


def nth_value(df: DataFrame, column: str, n: int, descending: bool = False, limit: int = 1_000_000):
    """The ``n``-th value in order (1-based, duplicates counted), exactly.

    Approximate quantiles bracket the answer and one count per round narrows the
    bracket by about four orders of magnitude, until it is small enough to sort.
    """
    values = df.select(F.col(column).alias("v")).where(F.col("v").isNotNull())
    size = values.count()
    if not 1 <= n <= size:
        raise ValueError(f"n must lie in 1..{size}")
    rank = size - n + 1 if descending else n  # ascending rank among ``values``
    while size > limit:
        p, slack = rank / size, 2e-4
        low, high = values.agg(
            F.percentile_approx("v", [max(0.0, p - slack), min(1.0, p + slack)], 10_000)
        ).first()[0]
        v = F.col("v")
        parts = [v < low, v == low, (v > low) & (v < high), (v == high) & (v > low), v > high]
        counts = values.agg(*[F.count_if(part) for part in parts]).first()
        for i, (part, count) in enumerate(zip(parts, counts)):
            if rank <= count:
                break
            rank -= count
        if i == 1:
            return low
        if i == 3:
            return high
        values, size = values.where(part), count
    return values.orderBy("v").limit(rank).agg(F.max("v")).first()[0]


def _cell(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Cell of each number: ``2 i + 1`` is the i-th cut itself, ``2 i`` lies between it and the cut before."""
    at = np.searchsorted(cuts, x)
    return 2 * at + (cuts[np.minimum(at, len(cuts) - 1)] == x)


def _numbers(batch: pa.RecordBatch, j: int) -> np.ndarray:
    x = batch.column(j).to_numpy(zero_copy_only=False).astype(float)
    return x[~np.isnan(x)]


def _cell_sizes(shared):
    """Numbers in every cell of every column, counted over a whole task before they are handed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = [np.zeros(2 * len(cuts) + 1, np.int64) for cuts in shared.value]
        for batch in batches:
            for j, cuts in enumerate(shared.value):
                if len(cuts):
                    sizes[j] += np.bincount(_cell(_numbers(batch, j), cuts), minlength=len(sizes[j]))
                else:
                    sizes[j] += len(_numbers(batch, j))
        for j, size in enumerate(sizes):
            used = np.flatnonzero(size)
            columns = [pa.array(np.full(len(used), j), pa.int32()), pa.array(used, pa.int32()), pa.array(size[used], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["feature", "cell", "c"])

    return run


def _cell_content(shared):
    """The distinct numbers of a batch that lie in one of the cells asked for, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j, (cuts, asked) in enumerate(shared.value):
                if not asked.any():
                    continue
                x, c = np.unique(_numbers(batch, j), return_counts=True)
                cell = _cell(x, cuts) if len(cuts) else np.zeros(len(x), np.int64)
                kept = asked[cell]
                columns = [pa.array(np.full(kept.sum(), j), pa.int32()), pa.array(cell[kept], pa.int32()), pa.array(x[kept]), pa.array(c[kept], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["feature", "cell", "value", "c"])

    return run


def _cuts(values: DataFrame, n: int) -> list[np.ndarray]:
    """Distinct cut points of every column, about ``CELLS`` between two landmarks, from a bounded sample of rows."""
    rows = values.count()
    drawn = values if rows <= CUT_SAMPLE else values.sample(CUT_SAMPLE / rows, seed=1)
    table, out = drawn.toArrow(), []
    for j in range(len(values.columns)):
        x = table.column(j).to_numpy().astype(float)
        x = np.sort(x[~np.isnan(x)])
        out.append(np.unique(x[np.linspace(0, len(x) - 1, min(len(x), CELLS * n)).astype(int)]) if len(x) else x)
    return out


def quantile_grid(df: DataFrame, columns: Sequence[str], n: int = 1000) -> DataFrame:
    """``n`` (two or more) evenly spaced quantiles per column, linear interpolation, exact.

    Returns ``feature, k, value`` with ``k`` from 0 to ``n - 1``; nulls and NaNs
    are left out, and so is a column without any number.

    The columns are stored once, as doubles.  Cut points from a sample of about
    ``CUT_SAMPLE`` rows divide every column into cells; each task counts its
    numbers by cell, and the exact sizes tell in which cell every landmark lies.
    A landmark on a cut is known by then.  Of the other numbers only those in a
    landmark's cell are shuffled, one part in ``CELLS`` or so.  The sample decides
    how even the cells are, never the result; a cell that came out too long for
    one task is ranked in ranges.  The driver sees ``columns x n`` rows.
    """
    spark = df.sparkSession
    values = materialize(df.select(*[F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(columns)]), "columns")
    cuts = _cuts(values, n)
    counted = values.mapInArrow(_cell_sizes(spark.sparkContext.broadcast(cuts)), "feature int, cell int, c long")
    sizes = [np.zeros(2 * len(c) + 1, np.int64) for c in cuts]
    for j, cell, c in counted.groupBy("feature", "cell").agg(F.sum("c")).collect():
        sizes[j][cell] = c

    # Grid point k sits at (total - 1) * k / (n - 1) and needs the numbers at its floor and ceiling.
    ends, asked, ranks, longest = [np.cumsum(size) for size in sizes], [], [], 0
    found: dict[tuple[int, int], float] = {}
    for j, (size, end) in enumerate(zip(sizes, ends, strict=True)):
        asked.append(np.zeros(len(size), bool))
        if not end[-1]:
            continue
        floors = {(int(end[-1]) - 1) * k // (n - 1) for k in range(n)}
        places = np.array(sorted(floors | {min(p + 1, int(end[-1]) - 1) for p in floors}))
        cells = np.searchsorted(end, places, side="right")
        for place, cell in zip(places.tolist(), cells.tolist(), strict=True):
            if cell % 2:
                found[j, place] = float(cuts[j][cell // 2])
            else:
                asked[j][cell] = True
                ranks.append((j, cell, place, place - int(end[cell] - size[cell])))
        longest = max(longest, int(size[asked[j]].max(initial=0)))
    if ranks:
        content = values.mapInArrow(
            _cell_content(spark.sparkContext.broadcast(list(zip(cuts, asked, strict=True)))), "feature int, cell int, value double, c long"
        ).groupBy("feature", "cell", "value").agg(F.sum("c").alias("c"))
        if longest <= RANGE_ROWS:
            upto = Window.partitionBy("feature", "cell").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
            placed = content.withColumn("cum_c", F.sum("c").over(upto))
        else:
            placed = running_totals(materialize(content, "cells"), ["feature", "cell"], "value", ["c"])
        # at most two places a landmark, whatever the size of the table
        wanted = spark.createDataFrame(ranks, "feature int, cell int, place long, rank long").groupBy("feature", "cell").agg(
            F.collect_list(F.struct("place", "rank")).alias("wanted")
        )
        hit = F.filter("wanted", lambda w: (w["rank"] >= F.col("cum_c") - F.col("c")) & (w["rank"] < F.col("cum_c")))
        hits = placed.join(F.broadcast(wanted), ["feature", "cell"]).select("feature", "value", F.explode(hit).alias("w"))
        for j, value, place in hits.select("feature", "value", "w.place").collect():
            found[j, place] = value

    out = []
    for j, name in enumerate(columns):
        last = int(ends[j][-1]) - 1
        for k in range(n if last >= 0 else 0):
            place, rest = divmod(last * k, n - 1)
            low = found[j, place]
            high = found[j, place + 1] if rest else low
            out.append((name, k, low if low == high else low + (high - low) * (rest / (n - 1))))
    return spark.createDataFrame(out, "feature string, k long, value double")
