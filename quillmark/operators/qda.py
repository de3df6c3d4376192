"""Quadratic discriminant analysis from class statistics, as column expressions.

Fitting is one grouped aggregation (count, means, sample covariances) and the
inverse of one small matrix per class on the driver; scoring is arithmetic on
the columns: no UDF, no vectors.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pairs(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(1, k + 1) for j in range(i + 1, k + 1)]


def class_statistics(df: DataFrame, x: Sequence[str], label: str = "label") -> DataFrame:
    """Per class: ``n``, ``mean_i``, ``var_i`` and ``cov_i_j`` (samples) of any number of columns, counted from 1."""
    return (
        df.where(F.col(label).isNotNull())
        .groupBy(F.col(label).alias("label"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            *[F.avg(c).alias(f"mean_{i}") for i, c in enumerate(x, 1)],
            *[F.var_samp(c).alias(f"var_{i}") for i, c in enumerate(x, 1)],
            *[F.covar_samp(x[i - 1], x[j - 1]).alias(f"cov_{i}_{j}") for i, j in _pairs(len(x))],
        )
    )


def fit(df: DataFrame, x: Sequence[str], label: str = "label") -> DataFrame:
    """Class statistics with prior and determinant, one row per class."""
    stats = class_statistics(df, x, label)
    total = stats.agg(F.sum("n")).scalar()
    k = len(x)

    def entry(i: int, j: int) -> Column:
        return F.col(f"var_{i}") if i == j else F.col(f"cov_{min(i, j)}_{max(i, j)}")

    def det(rows: tuple[int, ...], columns: tuple[int, ...]) -> Column:
        if len(rows) == 1:
            return entry(rows[0], columns[0])
        terms = [entry(rows[0], c) * det(rows[1:], columns[:n] + columns[n + 1 :]) * (-1) ** n for n, c in enumerate(columns)]
        return reduce(lambda a, b: a + b, terms)

    every = tuple(range(1, k + 1))
    if k <= 3:
        return stats.withColumns({"prior": F.col("n") / total, "det": det(every, every)})
    # wider matrices: one small row per class through the driver
    rows = [r.asDict() for r in stats.withColumn("prior", F.col("n") / total).collect()]
    for r in rows:
        r["det"] = float(np.linalg.det(_matrix(r, k)))
    schema = stats.withColumn("prior", F.lit(0.0)).withColumn("det", F.lit(0.0)).schema
    return df.sparkSession.createDataFrame([tuple(r[f.name] for f in schema) for r in rows], schema)


def _matrix(p: dict, k: int) -> np.ndarray:
    """The covariance matrix of a class; undefined entries become NaN."""
    number = lambda v: math.nan if v is None else float(v)
    out = np.diag([number(p[f"var_{i}"]) for i in range(1, k + 1)])
    for i, j in _pairs(k):
        out[i - 1, j - 1] = out[j - 1, i - 1] = number(p[f"cov_{i}_{j}"])
    return out


def probability(params: dict[int, dict], x: Sequence[Column]) -> Column:
    """P(class 1) from fitted parameters of classes 0 and 1."""

    def decision(p: dict) -> Column:
        gap = [c - F.lit(p[f"mean_{i}"]) for i, c in enumerate(x, 1)]
        inverse = np.linalg.inv(_matrix(p, len(x)))
        terms = [
            gap[i] * gap[j] * F.lit(float(inverse[i, j]) * (1 if i == j else 2))
            for i in range(len(x)) for j in range(i, len(x))
        ]
        distance = reduce(lambda a, b: a + b, terms)
        return F.log(F.lit(p["prior"])) - 0.5 * F.log(F.lit(p["det"])) - 0.5 * distance

    gap = decision(params[0]) - decision(params[1])
    # exp overflows past 709; such a gap is already certain
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.least(gap, F.lit(700.0))))


def _collect(params: DataFrame) -> dict[int, dict]:
    rows = {int(r["label"]): r.asDict() for r in params.collect()}
    for k in (0, 1):
        if k not in rows:
            raise ValueError(f"class {k} has no rows")
        if not rows[k]["det"] or not rows[k]["det"] > 0:
            raise ValueError(f"the covariance of class {k} is singular")
    return rows


def score(df: DataFrame, params: DataFrame, x: Sequence[str], out: str = "probability") -> DataFrame:
    """Append P(class 1); the parameters are two rows and become literals."""
    return df.withColumn(out, probability(_collect(params), [F.col(c) for c in x]))


def surface(df: DataFrame, params: DataFrame, x: Sequence[str], points: int = 100, pad: float = 0.1) -> DataFrame:
    """P(class 1) on an even ``points x points`` grid around the data range."""
    a, b = x
    lo_a, hi_a, lo_b, hi_b = df.agg(F.min(a), F.max(a), F.min(b), F.max(b)).first()
    spark = df.sparkSession
    step_a = (hi_a - lo_a + 2 * pad) / (points - 1)
    step_b = (hi_b - lo_b + 2 * pad) / (points - 1)
    cells = spark.range(points * points).select(
        (F.col("id") % points).cast("int").alias("i"), F.floor(F.col("id") / points).cast("int").alias("j")
    )
    grid = cells.withColumns({
        a: F.lit(lo_a - pad) + F.col("i") * F.lit(step_a),
        b: F.lit(lo_b - pad) + F.col("j") * F.lit(step_b),
    })
    return score(grid, params, x)
