"""Column statistics used ahead of a model: scaling, weights, null columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_counts(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Nulls and NaNs per column, all columns in one aggregation."""
    row = df.agg(*[
        F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias(c) for c in columns
    ]).first()
    return row.asDict()


def complete_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns without a null or NaN, in their given order."""
    missing = null_counts(df, columns)
    return [c for c in columns if missing[c] == 0]


def fit_scaler(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column; a constant column scales by 1."""
    row = df.agg(*[
        f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))
    ]).first()
    return {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in columns}


def scale(df: DataFrame, params: dict[str, tuple[float, float]], suffix: str = "") -> DataFrame:
    return df.withColumns({
        c + suffix: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in params.items()
    })


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weight per class: rows / (classes x rows of the class)."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    classes = counts.agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("weight", total / (classes * F.col("n")).cast("double"))


def with_class_weight(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """Attach the balanced weight as a literal lookup (one entry per class)."""
    weights = {r[label]: r["weight"] for r in class_weights(df, label).collect()}
    value = F.lit(None).cast("double")
    for k, w in weights.items():
        value = F.when(F.col(label) == k, F.lit(w)).otherwise(value)
    return df.withColumn(out, value)


def minmax_inverted(df: DataFrame, columns: Sequence[str], bounds: dict[str, tuple[float, float]] | None = None) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """``1 - (x - min) / (max - min)``; a constant column becomes 0.

    Bounds come from the scored set itself unless those of an earlier set are
    passed in.  They are returned so that later batches can share them.
    """
    if bounds is None:
        row = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))]).first()
        bounds = {c: (row[f"lo_{c}"], row[f"hi_{c}"]) for c in columns}
    scaled = {}
    for c, (lo, hi) in bounds.items():
        scaled[c] = F.lit(0.0) if lo is None or lo == hi else 1.0 - (F.col(c) - F.lit(lo)) / F.lit(hi - lo)
    return df.withColumns(scaled), bounds
