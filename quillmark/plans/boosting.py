"""Boosted-tree classification of a corpus: features, fit, thresholds, export."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions.features import BASE9, add_features
from quillmark.operators import linear, metrics, selection, trees
from quillmark.operators.concurrent import side_by_side
from quillmark.operators.trees import BOOST_PRESETS, BoostParams, Scorer
from quillmark.sources.session import materialize, spread

# Thresholds used for export, per model.
EXPORT_THRESHOLDS = {"lgbm": 0.95, "cat": 0.97, "xgb": 0.98, "extratrees": 0.7, "lr": 0.8}
BOOSTED_MODELS = {"lgbm": "depth3", "cat": "depth6_wait100", "xgb": "depth5_wait100"}


def extract(df: DataFrame, columns: Sequence[str] = BASE9, key: str = "id") -> DataFrame:
    """Feature table of one split, computed once and stored without the text."""
    return materialize(add_features(spread(df, key), columns), "features")


@dataclass
class Comparison:
    """Scorers of several models, fitted on the same feature table."""

    scorers: dict[str, Scorer]

    def score(self, df: DataFrame) -> DataFrame:
        """One probability column per model, side by side (no join)."""
        for name, scorer in self.scorers.items():
            df = scorer(df, name)
        return df

    def best_thresholds(self, scored: DataFrame, label: str = "label", cuts=metrics.COARSE) -> DataFrame:
        return metrics.best(metrics.sweep(scored, list(self.scorers), cuts, label))

    def export(self, scored: DataFrame, key: str = "id") -> dict[str, DataFrame]:
        """``ID, label`` per model at its export threshold."""
        return {
            m: selection.at(scored.select(F.col(key).alias("ID"), m), m, EXPORT_THRESHOLDS[m]).drop(m)
            for m in self.scorers
        }


def compare(
    train: DataFrame, val: DataFrame, columns: Sequence[str] = BASE9, models: Sequence[str] = ("lgbm", "cat", "xgb", "extratrees", "lr"),
    label: str = "label", rounds: int | None = None, forest_trees: int = 5000,
    presets: Mapping[str, BoostParams] = BOOST_PRESETS,
) -> Comparison:
    """Fit the named models side by side; ``rounds`` shortens the boosted ones."""

    def fitted(name: str) -> Scorer:
        if name in BOOSTED_MODELS:
            params = presets[BOOSTED_MODELS[name]]
            return trees.fit_boosted(train, val, columns, params.scaled(rounds) if rounds else params, label)
        if name == "extratrees":
            return trees.fit_forest(train, columns, label, forest_trees)
        if name == "lr":
            return linear.fit_logistic(train, columns, label)
        raise ValueError(f"unknown model {name}")

    return Comparison(dict(zip(models, side_by_side(train.sparkSession, [lambda m=m: fitted(m) for m in models]), strict=True)))
