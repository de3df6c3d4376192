"""From scores to labels: fixed thresholds and the n best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.operators import ordering as O


def exceeds(score: Column, threshold: Column) -> Column:
    """``score > threshold`` as floating point has it: false for NaN, which Spark sorts above every number."""
    return ~F.isnan(score.cast("double")) & (score > threshold)


def at(df: DataFrame, score: str, threshold: float, out: str = "label") -> DataFrame:
    """Label 1 strictly above the threshold; 0 for NaN, null for a null score."""
    return df.withColumn(out, exceeds(F.col(score), F.lit(threshold)).cast("int"))


def top_threshold(df: DataFrame, score: str, n: int) -> float:
    """The n-th highest score; past either end a value beyond every score."""
    df = df.where(~F.isnan(F.col(score).cast("double")))
    size, low, high = df.agg(F.count(score), F.min(score), F.max(score)).first()
    if n <= 0:
        return float(high) + 1.0
    if n >= size:
        return float(low) - 1.0
    return float(O.nth_value(df, score, n, descending=True))


def top_n(
    df: DataFrame, score: str, n: int, ties: str = "drop", key: str = "id", seed: int = 123456, out: str = "label"
) -> DataFrame:
    """Label about ``n`` rows positive.

    ``ties='drop'`` labels rows strictly above the n-th score, so at most
    ``n - 1`` rows when ``n`` is inside the table.  ``ties='fill'`` adds rows
    that equal the threshold, in seeded hash order, until exactly ``n`` are
    positive.
    """
    cut = top_threshold(df, score, n)
    above = exceeds(F.col(score), F.lit(cut))
    if ties == "drop":
        return df.withColumn(out, above.cast("int"))
    if ties != "fill":
        raise ValueError("ties must be 'drop' or 'fill'")
    equal = F.col(score) == F.lit(cut)
    missing = n - (df.agg(F.count_if(above)).first()[0] or 0)
    if n <= 0 or missing <= 0:
        return df.withColumn(out, above.cast("int"))
    # the tied rows of the lowest hashes fill up: their boundary is one (hash, key), found on the keys alone
    last = O.boundaries(df.where(equal).select(key), [], key, missing, seed)
    inside = O.upto_boundary(last, [], key, seed)
    return df.withColumn(out, F.when(equal, inside).otherwise(above).cast("int"))
