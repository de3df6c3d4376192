"""Scaled, class-balanced logistic regression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.operators import scaling
from quillmark.operators.trees import Scorer, _probability, assemble


# Name of the constant column that stands for the intercept.
CONSTANT = "_constant"


def _moments(known: DataFrame, columns: Sequence[str], label: str) -> tuple[dict[str, tuple[float, float]], dict[int, int]]:
    """Mean and population deviation of every column, and the rows of every class, from one pass."""
    rows = known.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{m}_{c}") for c in columns for m, f in (("m", F.avg), ("v", F.var_pop))]).collect()
    sizes = {r[label]: r["n"] for r in rows}
    total, scaler = sum(sizes.values()), {}
    for c in columns:
        mean = sum(r["n"] * r[f"m_{c}"] for r in rows) / total
        spread = sum(r["n"] * (r[f"v_{c}"] + (r[f"m_{c}"] - mean) ** 2) for r in rows) / total
        scaler[c] = (mean, spread**0.5 or 1.0)
    return scaler, sizes


def fit_logistic(
    train: DataFrame, columns: Sequence[str], label: str = "label", c: float = 1.0, max_iter: int = 1000, tol: float = 1e-6,
) -> Scorer:
    """L2-penalised logistic regression on columns scaled to unit population deviation, classes weighed equally.

    ``c`` weighs the summed loss against the penalty; Spark minimises the mean
    loss, hence ``regParam = 1 / (c * summed weight)``, and balanced weights add
    up to the rows.  The intercept is the weight of a constant column and is
    penalised like the others.  Spark ML gives columns without variance no
    weight, so every other row (by a hash of its content) enters with all signs
    and its label turned around, which leaves its loss as it is.
    """
    known = train.where(F.col(label).isNotNull())
    params, sizes = _moments(known, columns, label)
    total = sum(sizes.values())
    weight = F.lit(None).cast("double")
    for k, n in sizes.items():
        weight = F.when(F.col(label) == k, F.lit(total / (len(sizes) * n))).otherwise(weight)
    data = scaling.scale(known.select(F.col(label).cast("double").alias(label), weight.alias("weight"), *columns), params)
    turned = F.pmod(F.xxhash64(*columns), F.lit(2)) == 0
    sign = F.when(turned, -1.0).otherwise(1.0)
    data = data.select(F.when(turned, 1.0 - F.col(label)).otherwise(F.col(label)).alias(label), "weight", *[(F.col(x) * sign).alias(x) for x in columns], sign.alias(CONSTANT))
    model = LogisticRegression(
        featuresCol="_x", labelCol=label, probabilityCol="_p", weightCol="weight", maxIter=max_iter, tol=tol, fitIntercept=False,
        regParam=1.0 / (c * total), elasticNetParam=0.0, standardization=False,
    ).fit(assemble(data, [*columns, CONSTANT]).select(label, "weight", "_x"))
    inner = [f"_s_{x}" for x in columns]

    def score(df: DataFrame, out: str) -> DataFrame:
        scaled = scaling.scale(df.withColumns({f"_s_{x}": F.col(x) for x in columns} | {CONSTANT: F.lit(1.0)}),
                               {f"_s_{x}": params[x] for x in columns})
        return _probability(model, scaled, [*inner, CONSTANT], out).drop(*inner, CONSTANT)

    return score
