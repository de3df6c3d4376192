"""Corpus profile: inventory, frequency tables, length statistics, densities."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.operators import ordering as O

INVENTORY_SCHEMA = "file string, status string, n_rows bigint, n_columns int, column string, dtype string"


def inventory(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """One row per file and column; a file that cannot be read gives a status row."""
    rows = []
    for path in paths:
        name = path.rstrip("/").rsplit("/", 1)[-1]
        if name.endswith(".parquet"):
            reader = spark.read.parquet
        elif name.endswith(".csv"):
            reader = lambda p: spark.read.csv(p, header=True)
        else:
            rows.append((name, "unsupported", None, None, None, None))
            continue
        try:
            df = reader(path)
            n = df.count()
            rows += [(name, "ok", n, len(df.columns), c, t) for c, t in df.dtypes]
        except Exception as error:  # noqa: BLE001 - reported per file, like a missing one
            missing = "PATH_NOT_FOUND" in str(error)
            rows.append((name, "missing" if missing else "error", None, None, None, None))
    return spark.createDataFrame(rows, INVENTORY_SCHEMA)


def frequency(df: DataFrame, column: str, top: int | None = None, digits: int = 2) -> DataFrame:
    """Counts and percentages per value, nulls kept, most frequent first.

    With ``top`` only the leading rows are kept and ``n_more`` tells how many
    values are not shown; equal counts are ordered by value.
    """
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count")).scalar()
    out = counts.select(
        "value", "count", F.round(F.col("count") * 100.0 / total, digits).alias("percentage")
    )
    order = [F.desc("count"), F.asc_nulls_first("value")]
    if top is None:
        return out.orderBy(*order)
    n_values = counts.agg(F.count(F.lit(1))).scalar()
    return out.withColumn("n_more", F.greatest(n_values - top, F.lit(0))).orderBy(*order).limit(top)


def share(df: DataFrame, column: str, digits: int = 4) -> DataFrame:
    """Group sizes and their share of the table."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("len"))
    total = counts.agg(F.sum("len")).scalar()
    return counts.withColumn("percentage", F.round(F.col("len") / total, digits))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, sample deviation, minimum, exact quartiles and maximum per column."""
    entries = F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns
    ]))
    moments = df.select(entries.alias("e")).groupBy(F.col("e.feature").alias("feature")).agg(
        F.count("e.x").alias("count"), F.avg("e.x").alias("mean"), F.stddev_samp("e.x").alias("std")
    )
    names = ["min", "p25", "p50", "p75", "max"]
    grid = O.quantile_grid(df, columns, len(names))
    quartiles = grid.groupBy("feature").agg(*[
        F.max(F.when(F.col("k") == k, F.col("value"))).alias(name) for k, name in enumerate(names)
    ])
    return moments.join(quartiles, "feature")


def argmax_row(df: DataFrame, column: str, key: str = "id") -> DataFrame:
    """The single row with the largest value; ties go to the smallest key."""
    best = F.max_by(F.struct(*df.columns), F.struct(F.col(column), -F.col(key)))
    return df.agg(best.alias("r")).select("r.*")


def _range(df: DataFrame, x: str) -> tuple[int, float, float, float]:
    value = F.col(x).cast("double")
    return df.agg(F.count(value), F.min(value), F.max(value), F.stddev_samp(value)).first()


def auto_bins(df: DataFrame, x: str) -> int:
    """Bin count from the narrower of the Freedman-Diaconis and Sturges widths."""
    n, low, high, _ = _range(df, x)
    if not n or low == high:
        return 1
    q = {r["k"]: r["value"] for r in O.quantile_grid(df, [x], 5).collect()}
    width = (high - low) / (math.log2(n) + 1)
    spread = 2 * (q[3] - q[1]) / n ** (1 / 3)
    return max(1, math.ceil((high - low) / (min(width, spread) if spread > 0 else width)))


def histogram(df: DataFrame, x: str, by: Sequence[str] = (), bins: int | None = None, width: float | None = None) -> DataFrame:
    """Counts per bin (and per group of ``by``); empty bins are left out.

    ``width`` fixes the bin width from the minimum; ``width=1`` is the discrete
    form.  Otherwise the range is cut into ``bins`` equal bins, the last closed.
    """
    n, low, high, _ = _range(df, x)
    value = F.col(x).cast("double")
    if n == 0:
        low = high = 0.0
    if width is None:
        bins = bins or auto_bins(df, x)
        width = (high - low) / bins or 1.0
        index = F.least(F.floor((value - low) / width), F.lit(bins - 1))
    else:
        index = F.floor((value - low) / width)
    return (
        df.where(value.isNotNull())
        .groupBy(*by, index.cast("bigint").alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"))
        .withColumn("bin_start", F.lit(float(low)) + F.col("bin") * F.lit(float(width)))
    )


# Cells per bandwidth of a density, most cells over all, and bandwidths after which a value no longer counts.
CELLS_PER_BANDWIDTH = 64
MOST_CELLS = 1 << 20
REACH = 8


def density(df: DataFrame, x: str, points: int = 200) -> DataFrame:
    """Gaussian kernel density on an even grid between the extremes (Scott bandwidth).

    Values are gathered in cells of a small part of the bandwidth, with their
    first moments around the middle of the cell (one row a cell leaves a task,
    however many different values there are).  A cell adds to the grid points
    within ``REACH`` bandwidths only, as the Taylor series of the kernel in
    these moments.  With a cell of h / 64 a value is at most d = h / 128 from
    the middle and the series is off by less than d^4 / 8 of a kernel, 5e-10;
    what lies beyond the reach would add less than 2e-14.
    """
    n, low, high, std = _range(df, x)
    if not n or n < 2 or not std:
        return df.sparkSession.createDataFrame([], "k int, x double, density double")
    h = std * n ** -0.2
    step = (high - low) / (points - 1)
    width = max(h / CELLS_PER_BANDWIDTH, (high - low) / MOST_CELLS)
    values = df.select(F.col(x).cast("double").alias("v")).where("v is not null")
    values = values.withColumn("cell", F.floor((F.col("v") - low) / width))
    middle = F.lit(low) + (F.col("cell") + 0.5) * width
    d = (F.col("v") - middle) / h
    cells = values.groupBy("cell").agg(F.count(F.lit(1)).alias("m0"), F.sum(d).alias("m1"), F.sum(d * d).alias("m2"), F.sum(d * d * d).alias("m3"))
    first = F.greatest(F.lit(0), F.ceil((middle - REACH * h - low) / step).cast("int"))
    last = F.least(F.lit(points - 1), F.floor((middle + REACH * h - low) / step).cast("int"))
    near = cells.withColumns({"first": first, "last": last}).where("first <= last").withColumn("k", F.explode(F.sequence("first", "last")))
    z = (F.lit(low) + F.col("k") * F.lit(step) - middle) / h
    series = F.col("m0") + z * F.col("m1") + (z * z - 1) / 2 * F.col("m2") + (z * z * z - 3 * z) / 6 * F.col("m3")
    scale = 1.0 / (n * h * math.sqrt(2 * math.pi))
    sums = near.groupBy(F.col("k").alias("at")).agg((F.sum(F.exp(z * z * -0.5) * series) * scale).alias("density"))
    grid = df.sparkSession.range(points).select(F.col("id").cast("int").alias("k"))
    return grid.join(sums, F.col("k") == F.col("at"), "left").select(
        "k", (F.lit(low) + F.col("k") * F.lit(step)).alias("x"), F.coalesce("density", F.lit(0.0)).alias("density"))

