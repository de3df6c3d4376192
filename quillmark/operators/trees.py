"""Boosted trees and tree ensembles on Spark ML, scored as plain columns."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.operators import metrics as M
from quillmark.operators import forest, rounds, scaling
from quillmark.operators.concurrent import side_by_side
from quillmark.sources.session import materialize

# Spark ML models of at most so many rounds are fitted whole, and early stopping picks the round afterwards.  Longer ones
# begin with FIRST_ROUNDS, and each next fit has twice as many.
WHOLE_ROUNDS = 512
FIRST_ROUNDS = 128
# Rows that walk down a tree together, few enough for a core's cache.
SCORED_ROWS = 2048
# Rows of one partition of a training table.
LAYOUT_ROWS = 100_000
# Random trees of one fit: every task of a fit receives all nodes that its trees have so far.
TREES_AT_ONCE = 200

# Appends P(class 1) of every row as a double column: score(df, out).
Scorer = Callable[[DataFrame, str], DataFrame]


@dataclass(frozen=True)
class BoostParams:
    """Settings of a boosted model.

    ``rounds`` and ``wait`` are the full-size values; ``scaled`` shortens a
    preset for small clusters without touching anything else.
    """

    rounds: int = 500
    rate: float = 0.05
    depth: int = 3
    row_share: float = 0.8
    column_share: float = 0.7
    wait: int | None = 50
    min_rows: int = 20
    seed: int = 42
    threshold: float = 0.5
    bins: int = 255
    # what early stopping watches: macro_f1, f1 (of class 1) or log_loss
    watch: str = "macro_f1"

    def scaled(self, rounds: int, wait: int | None = None) -> BoostParams:
        return replace(self, rounds=rounds, wait=wait if wait is not None else self.wait)


# The five boosted set-ups.
BOOST_PRESETS = {
    "depth3": BoostParams(),
    "depth5": BoostParams(depth=5),
    "depth6_wait100": BoostParams(rounds=5000, depth=6, column_share=1.0, row_share=1.0, wait=100, min_rows=1, watch="f1"),
    "depth5_wait100": BoostParams(rounds=5000, depth=5, wait=100, min_rows=1, watch="log_loss"),
    "stacking": BoostParams(depth=5, column_share=0.6, wait=None, min_rows=50, seed=123456),
}


def assemble(df: DataFrame, columns: Sequence[str], out: str = "_x") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=out, handleInvalid="error").transform(df)


def _probability(model, df: DataFrame, columns: Sequence[str], out: str) -> DataFrame:
    scored = model.transform(assemble(df, columns))
    return scored.select(*df.columns, vector_to_array("_p").getItem(1).alias(out))


def trees_of(model: GBTClassificationModel) -> rounds.Trees:
    """The trees of a Spark ML model, read from their printed form."""
    depth = max(tree.depth for tree in model.trees)
    inner = 2**depth - 1
    feature, cut, value = np.zeros((len(model.trees), inner), np.int32), np.full((len(model.trees), inner), np.inf), np.zeros((len(model.trees), inner + 1))
    for i, (tree, weight) in enumerate(zip(model.trees, model.treeWeights, strict=True)):
        # nodes are printed in preorder; a leaf above the last level sends its rows left
        todo, leaves = [0], 0
        for f, c, v in re.findall(r"If \(feature (\d+) <= (\S+)\)|Predict: (\S+)", tree.toDebugString):
            at = todo.pop()
            if f:
                feature[i, at], cut[i, at] = int(f), float(c)
                todo += [2 * at + 2, 2 * at + 1]
                continue
            while at < inner:
                at = 2 * at + 1
            value[i, at - inner] = float(v) * weight
            leaves += 1
        if todo or leaves != (tree.numNodes + 1) // 2:
            raise ValueError("the printed tree does not hold one value per leaf")
    return rounds.Trees(feature, cut, value)


class StagedBoost:
    """A boosted model whose score can stop after any number of rounds.

    Rows walk down the trees inside Arrow batches; what is broadcast are the
    trees, bounded by the settings.
    """

    def __init__(self, trees: rounds.Trees, columns: Sequence[str], model: GBTClassificationModel | None = None):
        self.columns, self.trees, self.model = list(columns), trees, model
        self.rounds = len(trees.value)

    def by_round(self, df: DataFrame, label: str = "label", threshold: float = 0.5) -> DataFrame:
        """Macro scores, ``f1`` and ``log_loss`` after each round; every batch leaves as one small table."""
        shared = df.sparkSession.sparkContext.broadcast(self.trees)

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            grown = shared.value
            for pdf in batches:
                if not len(pdf):
                    continue
                y = pdf["y"].to_numpy() == 1
                x = rounds.features([pdf[c] for c in pdf.columns[1:]])
                margin, cells = np.zeros(len(y)), []
                for tree in range(len(grown.value)):
                    margin += grown.walk(x, tree)
                    called = 1.0 / (1.0 + np.exp(-2.0 * margin)) > threshold
                    loss = np.logaddexp(0.0, np.where(y, -2.0, 2.0) * margin)
                    cells.append((tree + 1, (called & y).sum(), (called & ~y).sum(), (~called & y).sum(), (~called & ~y).sum(), loss.sum()))
                yield pd.DataFrame(cells, columns=["round", "tp", "fp", "fn", "tn", "loss"])

        known = df.where(F.col(label).isNotNull()).select(F.col(label).alias("y"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(self.columns)])
        cells = known.mapInPandas(count, "round int, tp bigint, fp bigint, fn bigint, tn bigint, loss double")
        summed = cells.groupBy("round").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn", "loss")])
        rows = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
        f1 = F.coalesce(2.0 * F.col("tp") / F.nullif(2.0 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0.0)), F.lit(0.0))
        return M.with_macro(summed.withColumns({"f1": f1, "log_loss": F.col("loss") / rows}).drop("loss"))

    def best_round(
        self, df: DataFrame, wait: int | None, label: str = "label", threshold: float = 0.5, watch: str = "macro_f1"
    ) -> tuple[int, bool]:
        """First best round, giving up after ``wait`` rounds without a gain; whether it gave up."""
        history = self.by_round(df, label, threshold).select("round", watch).orderBy("round").collect()
        sign = -1.0 if watch == "log_loss" else 1.0
        best, at = None, self.rounds
        for row in history:
            if best is None or sign * row[watch] > best:
                best, at = sign * row[watch], row["round"]
            elif wait is not None and row["round"] - at >= wait:
                return at, True
        return at, False

    def score(self, df: DataFrame, out: str, rounds_used: int | None = None) -> DataFrame:
        used = rounds_used or self.rounds
        shared = df.sparkSession.sparkContext.broadcast(self.trees)

        @F.pandas_udf("double")
        def probability(*columns: pd.Series) -> pd.Series:
            x = rounds.features(columns)
            parts = [shared.value.margin(np.ascontiguousarray(x[:, i : i + SCORED_ROWS]), used) for i in range(0, x.shape[1], SCORED_ROWS)]
            return pd.Series(1.0 / (1.0 + np.exp(-2.0 * np.concatenate([np.zeros(0), *parts]))))

        return df.select(*df.columns, probability(*[F.col(c).cast("double") for c in self.columns]).alias(out))


def boosted_model(
    train: DataFrame, columns: Sequence[str], params: BoostParams = BOOST_PRESETS["depth3"], label: str = "label"
) -> StagedBoost:
    """Fit all rounds by Spark ML, a chain of small jobs.  Columns are drawn per node, leaves are not regularised.

    Spark ML draws its row samples and bins partition by partition.  The rows
    are therefore dealt by a hash of their content, in a number of partitions
    that depends on the rows alone, and sorted: the same rows give the same
    model on any cluster and from any layout.
    """
    gbt = GBTClassifier(
        featuresCol="_x", labelCol=label, maxIter=params.rounds, stepSize=params.rate,
        maxDepth=params.depth, subsamplingRate=params.row_share, maxBins=params.bins,
        featureSubsetStrategy=str(params.column_share) if params.column_share < 1 else "all",
        minInstancesPerNode=params.min_rows, seed=params.seed,
    )
    known = train.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias(label), *columns)
    dealt = known.repartition(4 + known.count() // LAYOUT_ROWS, F.xxhash64(label, *columns)).sortWithinPartitions(*columns, label)
    model = gbt.fit(assemble(dealt, columns).select(label, "_x"))
    return StagedBoost(trees_of(model), columns, model)


def fit_until(
    train: DataFrame, val: DataFrame | None, columns: Sequence[str], params: BoostParams, label: str = "label"
) -> tuple[StagedBoost, int | None]:
    """Fit no more rounds than early stopping needs: the model and the round to stop at.

    A fit of few rounds is a prefix of a longer one, so the round to stop at is
    the same whether or not later rounds exist.  Tables of at most
    ``rounds.most_rows`` rows are fitted by ``rounds.grow``: the same trees
    (variance gain, columns drawn per node, no regularised leaves) with other
    draws of rows and columns, in one job and every round once.

    Larger tables are spread over many tasks by Spark ML.  Up to WHOLE_ROUNDS
    every round is fitted once.  Beyond that the rounds are doubled until the
    watched metric has not improved for ``wait`` rounds or all are fitted; Spark
    ML can't continue a model, so that costs up to four times the rounds up to
    the stop.
    """
    if params.wait is None:
        val = None
    rows = rounds.table(train, val, columns, label)
    if rows.count() <= rounds.most_rows(columns):
        grown, stop = rounds.grow(rows, params)
        return StagedBoost(grown, columns), stop if val is None or stop is not None else params.rounds
    if val is None:
        return boosted_model(train, columns, params, label), None
    size = params.rounds if params.rounds <= WHOLE_ROUNDS else min(params.rounds, max(FIRST_ROUNDS, params.wait + 1))
    while True:
        model = boosted_model(train, columns, replace(params, rounds=size), label)
        stop, gave_up = model.best_round(val, params.wait, label, params.threshold, params.watch)
        if gave_up or size >= params.rounds:
            return model, stop
        size = min(params.rounds, 2 * size)


def fit_boosted(
    train: DataFrame, val: DataFrame | None, columns: Sequence[str],
    params: BoostParams = BOOST_PRESETS["depth3"], label: str = "label",
) -> Scorer:
    """Boosted trees; with a validation set the score stops at its best round by ``params.watch``."""
    model, stop = fit_until(train, val, columns, params, label)
    return lambda df, out: model.score(df, out, stop)


def fit_forest(
    train: DataFrame, columns: Sequence[str], label: str = "label", trees: int = 5000, depth: int = 12,
    min_rows: int = 5, seed: int = 42,
) -> Scorer:
    """Unbagged random trees with balanced class weights.

    Cut points are searched, not drawn at random.  The rows are dealt by a hash
    of their content, sorted and stored once.  Forests that ``forest.fits`` are
    grown by ``operators/forest.py``: Spark ML's trees with other draws of
    columns, a task a block of trees, and neither rows nor nodes as objects on
    the driver.  Others, smaller or larger, are fitted by Spark ML in parts of
    at most TREES_AT_ONCE trees side by side, whose nodes the driver holds.  A
    score is the mean of all trees.
    """
    known = train.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("y"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    n, names = known.count(), [f"x{i}" for i in range(len(columns))]
    if forest.fits(n, columns, trees, depth, min_rows):
        dealt = known.repartition(4 + n // LAYOUT_ROWS, F.xxhash64("y", *names)).sortWithinPartitions(*names, "y")
        stored = materialize(dealt.withColumn("draw", F.rand(seed)), "forest_rows")
        held, cuts = forest.in_bins(stored, names, n, "draw")
        drawn = math.ceil(math.sqrt(len(columns)))
        return forest.Forest(train.sparkSession, forest.grow(train.sparkSession, held, trees, depth, min_rows, drawn, seed), cuts, columns).score
    return spark_forest(train, columns, label, trees, depth, min_rows, seed)


def spark_forest(train: DataFrame, columns: Sequence[str], label: str, trees: int, depth: int, min_rows: int, seed: int, share: str = "sqrt") -> Scorer:
    """The forest fitted by Spark ML; a fit uses more than the few tasks of a small file and doesn't weigh the rows again."""
    data = scaling.with_class_weight(train.where(F.col(label).isNotNull()), label).select(F.col(label).cast("double").alias(label), "weight", *columns)
    stored = materialize(data.repartition(4 + data.count() // LAYOUT_ROWS, F.xxhash64(label, *columns)), "forest_rows")
    dealt = assemble(stored, columns).select(label, "weight", "_x")

    def part(number: int, size: int) -> RandomForestClassificationModel:
        return RandomForestClassifier(
            featuresCol="_x", labelCol=label, probabilityCol=f"_p{number}", rawPredictionCol="", predictionCol="", weightCol="weight", numTrees=size,
            maxDepth=depth, minInstancesPerNode=min_rows, featureSubsetStrategy=share, bootstrap=False, seed=seed + number,
        ).fit(dealt)

    sizes = [min(TREES_AT_ONCE, trees - at) for at in range(0, trees, TREES_AT_ONCE)]
    models = side_by_side(train.sparkSession, [lambda i=i, n=n: part(i, n) for i, n in enumerate(sizes)])

    def score(df: DataFrame, out: str) -> DataFrame:
        scored = reduce(lambda d, m: m.transform(d), models, assemble(df, columns))
        votes = [vector_to_array(f"_p{i}").getItem(1) * (n / trees) for i, n in enumerate(sizes)]
        return scored.select(*df.columns, reduce(lambda a, b: a + b, votes).alias(out))

    return score
