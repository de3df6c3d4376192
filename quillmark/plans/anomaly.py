"""Two-forest anomaly scores with a quadratic discriminant on top."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from quillmark.functions.features import SET36
from quillmark.operators import iforest, qda, quantile, scaling, selection
from quillmark.sources.session import materialize

PAIR = {0: "human_anomaly", 1: "machine_anomaly"}


@dataclass
class AnomalyModel:
    """Quantile landmarks, one forest per class and the discriminant."""

    columns: Sequence[str]
    grid: dict
    forest: DataFrame
    psi: dict[int, int]
    params: DataFrame | None = None
    bounds: dict = field(default_factory=dict)

    def pair(self, df: DataFrame, fixed_bounds: bool = False) -> DataFrame:
        """Append both anomaly scores in [0, 1].

        The scaling bounds come from ``df`` itself, so a score depends on the set
        it was computed with; ``fixed_bounds`` reuses those of the train rows.
        """
        kept = [c for c in df.columns if c not in self.columns]
        uniform = quantile.transform(df, self.grid)
        raw = iforest.score(uniform, self.forest, self.columns, self.psi, PAIR)
        # Scored once: the bounds and every later step read the stored scores.
        raw = materialize(raw.select(*kept, *PAIR.values()), "pair")
        scaled, bounds = scaling.minmax_inverted(raw, list(PAIR.values()), self.bounds if fixed_bounds else None)
        if not self.bounds:
            self.bounds = bounds
        return scaled

    def probability(self, df: DataFrame, fixed_bounds: bool = False) -> DataFrame:
        return qda.score(self.pair(df, fixed_bounds), self.params, list(PAIR.values()))

    def label_top(self, df: DataFrame, n: int = 109_921, ties: str = "drop", key: str = "id") -> DataFrame:
        """Predicted labels with about ``n`` positives."""
        scored = materialize(self.probability(df), "scored")
        return selection.top_n(scored, "probability", n, ties, key)


def fit(
    train: DataFrame, columns: Sequence[str] = SET36, label: str = "label", key: str = "id",
    trees: int = 400, psi: int = 256, quantiles: int = 1000, seed: int = 123456,
) -> AnomalyModel:
    """Fit on a stored feature table with ``key``, ``label`` and ``columns``."""
    columns = list(columns)
    known = train.where(f"{label} is not null").select(key, label, *columns)
    grid = quantile.fit(known, columns, quantiles)
    # only the sampled rows are transformed
    grown = iforest.fit(known, columns, label, key, trees, psi, seed, lambda rows: quantile.transform(rows, grid))
    forest = materialize(grown, "forest")
    sizes = {int(r[label]): min(psi, r["count"]) for r in known.groupBy(label).count().collect()}
    model = AnomalyModel(columns, grid, forest, sizes)
    scored = model.pair(known)
    model.params = materialize(qda.fit(scored, list(PAIR.values()), label), "qda")
    return model
