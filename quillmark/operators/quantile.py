"""Quantile transform to a uniform distribution."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.operators import ordering as O


def fit(df: DataFrame, columns: Sequence[str], n: int = 1000) -> dict[str, list[float]]:
    """Quantile landmarks per column, at most ``n`` and never more than rows.

    The result has ``columns x n`` numbers whatever the size of the table.  A
    column without any value can't be fitted and raises.
    """
    n = max(2, min(n, df.count()))
    grid: dict[str, list[float]] = {c: [0.0] * n for c in columns}
    seen = set()
    for row in O.quantile_grid(df, columns, n).collect():
        grid[row["feature"]][row["k"]] = row["value"]
        seen.add(row["feature"])
    if empty := [c for c in columns if c not in seen]:
        raise ValueError(f"no value to fit in {', '.join(empty)}")
    return {c: list(np.maximum.accumulate(v)) for c, v in grid.items()}


def transform(df: DataFrame, grid: dict[str, list[float]]) -> DataFrame:
    """Replace each fitted column by its position in the landmarks, in [0, 1].

    Repeated landmarks make the position ambiguous; the mean of the lowest and
    highest position is taken.  One Arrow UDF handles all columns of a batch.
    """
    columns = list(grid)
    shared = df.sparkSession.sparkContext.broadcast({c: np.asarray(v, float) for c, v in grid.items()})
    schema = T.StructType([T.StructField(c, T.DoubleType()) for c in columns])

    @F.pandas_udf(schema)
    def place(batch: pd.DataFrame) -> pd.DataFrame:
        out = {}
        for c in columns:
            marks = shared.value[c]
            steps = np.linspace(0.0, 1.0, len(marks))
            x = batch[c].to_numpy(dtype=float)
            rising = np.interp(x, marks, steps)
            falling = np.interp(-x, -marks[::-1], -steps[::-1])
            y = 0.5 * (rising - falling)
            y[x == marks[-1]] = 1.0
            y[x == marks[0]] = 0.0
            out[c] = np.where(np.isnan(x), np.nan, y)
        return pd.DataFrame(out)

    packed = df.withColumn("_q", place(F.struct(*columns)))
    return packed.select(*[
        F.col(f"_q.{c}").alias(c) if c in grid else F.col(c) for c in df.columns
    ])
