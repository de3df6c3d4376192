"""Rebalancing and splitting: exact sizes, seeded, independent of row order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.operators import ordering as O


def per_group(df: DataFrame, by: Sequence[str], n: int = 12_000, key: str = "id", seed: int = 42) -> DataFrame:
    """Random undersampling to ``min(group size, n)`` rows per group."""
    return O.take_lowest(df, by, key, n, seed)


def fraction(
    df: DataFrame, where: Column, target: int, by: Sequence[str], key: str = "id", seed: int = 42
) -> DataFrame:
    """Shrink the rows matching ``where`` to about ``target``, keeping group shares.

    Every group of the matching part keeps ``round(size * target / total)`` rows
    (half to even); all other rows, null conditions included, pass through.
    """
    chosen, others = df.where(where), df.where(~F.coalesce(where, F.lit(False)))
    sizes = chosen.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    if total == 0:
        return others
    if target > total:
        raise ValueError(f"target {target} exceeds the {total} matching rows")
    quotas = sizes.select(*by, F.bround(F.col("n") * F.lit(target / total)).cast("bigint").alias("quota"))
    kept = O.take_lowest(chosen, by, key, quotas.where("quota > 0"), seed)
    return kept.unionByName(others)


def folds(df: DataFrame, label: str = "label", k: int = 5, key: str = "id", seed: int = 42) -> DataFrame:
    """Stratified ``fold`` number 0..k-1; class counts of two folds differ by at most one."""
    return O.hash_rank(df, [label], key, seed, "_rank").withColumn(
        "fold", ((F.col("_rank") - 1) % k).cast("int")
    ).drop("_rank")


def shuffle(df: DataFrame, key: str = "id", seed: int = 42) -> DataFrame:
    """All rows in seeded pseudo-random order (a distributed range sort)."""
    return df.orderBy(O.hash_key(key, seed), key)


def shuffle_position(df: DataFrame, key: str = "id", seed: int = 42) -> DataFrame:
    """The 1-based ``position`` each row takes in :func:`shuffle`."""
    return O.hash_rank(df, [], key, seed, "position")


def sample_rows(df: DataFrame, n: int, key: str = "id", seed: int = 42) -> DataFrame:
    """``n`` rows for a quick look, fixed by the seed (all rows of a smaller table)."""
    return O.take_lowest(df, [], key, n, seed)


def head(df: DataFrame, n: int, key: str = "id") -> DataFrame:
    """The ``n`` rows with the smallest key; a null key comes last.

    The cut value comes from an order statistic over the key alone, so the rows
    themselves are only filtered, never sorted or sent to one task.  Of rows
    that share the cut key (or have none, where those must fill up), just as
    many as are missing are taken.
    """
    if n <= 0:
        return df.limit(0)
    rows, known = df.agg(F.count(F.lit(1)), F.count(key)).first()
    if rows <= n:
        return df
    if known <= n:
        return df.where(F.col(key).isNotNull()).unionByName(df.where(F.col(key).isNull()).limit(n - known))
    cut = O.nth_value(df, key, n)
    below, equal = df.agg(F.count_if(F.col(key) < F.lit(cut)), F.count_if(F.col(key) == F.lit(cut))).first()
    if below + equal == n:
        return df.where(F.col(key) <= F.lit(cut))
    return df.where(F.col(key) < F.lit(cut)).unionByName(df.where(F.col(key) == F.lit(cut)).limit(n - below))


def of_class(df: DataFrame, k: int, label: str = "label") -> DataFrame:
    """Rows of one class; rows without a label belong to none."""
    return df.where(F.col(label) == k)
