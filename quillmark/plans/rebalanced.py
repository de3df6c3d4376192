"""Rebalanced training with out-of-fold scores, calibration and late fusion."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from quillmark.functions.features import STYLE19
from quillmark.operators import ensembles, metrics, sampling, trees
from quillmark.operators.trees import BOOST_PRESETS, BoostParams


def rebalance(train: DataFrame, by: Sequence[str] = ("language", "label"), n: int = 12_000, key: str = "id", seed: int = 42) -> DataFrame:
    return sampling.per_group(train, list(by), n, key, seed)


@dataclass
class CrossValidated:
    oof: DataFrame
    scored: list[DataFrame]
    threshold: float


def fit(
    train: DataFrame, val: DataFrame, others: Sequence[DataFrame] = (), columns: Sequence[str] = STYLE19,
    params: BoostParams = BOOST_PRESETS["depth5"], k: int = 5, key: str = "id", label: str = "label", seed: int = 42,
) -> CrossValidated:
    """k boosted models; the threshold is calibrated on the averaged ``val`` scores.

    ``scored`` holds ``val`` followed by ``others``, each with a ``score`` column.
    """
    def one(a, b, cols):
        return trees.fit_boosted(a, b, cols, params, label)

    oof, scored = ensembles.cross_validate(train, [val, *others], columns, one, k, key, label, seed)
    best = metrics.best(metrics.sweep(scored[0], ["score"], metrics.FINE, label)).first()
    return CrossValidated(oof, scored, best["threshold"])
