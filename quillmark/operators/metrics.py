"""Evaluation of binary predictions: confusion, macro scores, AUC, threshold sweeps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.operators import ordering as O
from quillmark.operators.selection import exceeds
from quillmark.sources.session import materialize


def _safe(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / F.when(den > 0, den)).otherwise(F.lit(0.0))


def cell_counts(df: DataFrame, label: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, tn in one pass with map-side partial sums."""
    y, p = F.col(label), F.col(pred)
    return df.groupBy(*by).agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 0) & (p == 0)).alias("tn"),
    )


def confusion(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """The full 2 x 2 table; combinations that never occur count 0."""
    cells = F.inline(F.array(*[
        F.struct(F.lit(y).alias("label"), F.lit(p).alias("pred"), F.col(c).alias("count"))
        for y, p, c in [(0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp")]
    ]))
    return cell_counts(df, label, pred).select(cells)


def _class_columns() -> dict[str, Column]:
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    return {
        "p1": _safe(tp, tp + fp), "r1": _safe(tp, tp + fn), "f1": _safe(2 * tp, 2 * tp + fp + fn),
        "p0": _safe(tn, tn + fn), "r0": _safe(tn, tn + fp), "f0": _safe(2 * tn, 2 * tn + fp + fn),
        "s1": tp + fn, "s0": tn + fp, "n": tp + fp + fn + tn,
        # a class counts towards the macro mean once it is seen as label or prediction
        "c1": (tp + fp + fn > 0).cast("double"), "c0": (tn + fp + fn > 0).cast("double"),
    }


def _macro(kind: str) -> Column:
    seen = F.col("c0") + F.col("c1")
    return _safe(F.col(f"{kind}0") * F.col("c0") + F.col(f"{kind}1") * F.col("c1"), seen)


def with_macro(cells: DataFrame) -> DataFrame:
    """Append accuracy and macro precision, recall and F1 to tp/fp/fn/tn rows."""
    base = cells.columns
    wide = cells.withColumns(_class_columns())
    return wide.select(
        *base,
        _safe(F.col("tp").cast("double") + F.col("tn"), F.col("n")).alias("accuracy"),
        _macro("p").alias("macro_precision"),
        _macro("r").alias("macro_recall"),
        _macro("f").alias("macro_f1"),
    )


def macro(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    return with_macro(cell_counts(df, label, pred)).drop("tp", "fp", "fn", "tn")


def report(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """Per-class rows, accuracy, and macro and support-weighted means."""
    wide = cell_counts(df, label, pred).withColumns(_class_columns())
    c = F.col

    def row(name: str, p: Column, r: Column, f: Column, s: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"),
            f.alias("f1"), s.cast("bigint").alias("support"),
        )

    def weighted(kind: str) -> Column:
        return _safe(c(f"{kind}0") * c("s0") + c(f"{kind}1") * c("s1"), c("n"))

    accuracy = _safe(c("tp").cast("double") + c("tn"), c("n"))
    return wide.select(F.inline(F.array(
        row("0", c("p0"), c("r0"), c("f0"), c("s0")),
        row("1", c("p1"), c("r1"), c("f1"), c("s1")),
        row("accuracy", accuracy, accuracy, accuracy, c("n")),
        row("macro avg", _macro("p"), _macro("r"), _macro("f"), c("n")),
        row("weighted avg", weighted("p"), weighted("r"), weighted("f"), c("n")),
    )))


def auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Exact area under the ROC curve; tied scores share their average rank.

    Rows without a score are left out, as in ``sweep``; a NaN score is no
    position in an order and raises.
    """
    if not df.where(F.isnan(F.col(score).cast("double")) & F.col(label).isNotNull()).isEmpty():
        raise ValueError(f"{score} holds NaN")
    counts = (
        df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
        .groupBy(F.col(score).alias("s"))
        .agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    )
    placed = O.running_totals(materialize(counts, "scores"), [], "s", ["neg"])
    wins = F.col("pos") * (F.col("cum_neg") - F.col("neg") * 0.5)
    sums = placed.agg(F.sum(wins).alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return sums.select(
        F.when((F.col("p") > 0) & (F.col("n") > 0),
               F.col("u") / F.nullif(F.col("p").cast("double") * F.col("n"), F.lit(0.0))).alias("auc")
    )


def metric_table(df: DataFrame, label: str = "label", pred: str = "pred", score: str = "score") -> DataFrame:
    """``Metric, Value`` rows: acc, macro precision, recall and F1, auc."""
    wide = macro(df, label, pred).withColumn("auc", auc(df, label, score).scalar())
    names = [("acc", "accuracy"), ("precision (Macro)", "macro_precision"),
             ("recall (Macro)", "macro_recall"), ("f1 (Macro)", "macro_f1"), ("auc", "auc")]
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("Metric"), F.col(c).alias("Value")) for n, c in names
    ])))


def thresholds(start: int, stop: int, step: int = 1, scale: int = 100) -> list[float]:
    """Exact decimal thresholds ``start/scale .. (stop-1)/scale``."""
    return [t / scale for t in range(start, stop, step)]


FINE = thresholds(10, 90)
COARSE = thresholds(10, 99, 5)


def sweep(df: DataFrame, scores: Sequence[str], cuts: Sequence[float], label: str = "label") -> DataFrame:
    """Macro scores of every model at every threshold, ``score > threshold``.

    One pass places each score between two thresholds and counts labels per
    place; the confusion counts of all thresholds are suffix sums over that
    table of at most ``models x (thresholds + 1)`` rows.
    """
    cuts = sorted(cuts)
    grid = F.array(*[F.lit(float(t)) for t in cuts])
    models = F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), F.col(m).cast("double").alias("score")) for m in scores
    ]))
    places = (
        df.where(F.col(label).isNotNull())
        .select(F.col(label).alias("y"), models.alias("m"))
        .where(F.col("m.score").isNotNull())
        .groupBy(F.col("m.model").alias("model"),
                 F.size(F.filter(grid, lambda t: exceeds(F.col("m.score"), t))).alias("place"))
        .agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    )
    # A score at ``place`` is called positive by exactly the first ``place`` thresholds.
    table = places.select(
        "model", "place", "pos", "neg",
        F.posexplode(grid).alias("j", "threshold"),
    )
    hit = F.col("j") < F.col("place")
    cells = table.groupBy("model", "threshold").agg(
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(hit, F.lit(0)).otherwise(F.col("pos"))).alias("fn"),
        F.sum(F.when(hit, F.lit(0)).otherwise(F.col("neg"))).alias("tn"),
    )
    return with_macro(cells)


def best(swept: DataFrame, metric: str = "macro_f1") -> DataFrame:
    """Highest metric per model; the smallest threshold wins ties."""
    first = F.max_by(F.struct("threshold", metric), F.struct(F.col(metric), -F.col("threshold")))
    return swept.groupBy("model").agg(first.alias("b")).select("model", "b.*")


def better_of_two(
    df: DataFrame, score: str, calibrated: float, fixed: float = 0.97, label: str = "label"
) -> DataFrame:
    """Macro F1 at both thresholds; the fixed one is chosen only if strictly better."""
    swept = sweep(df, [score], sorted({calibrated, fixed}), label)
    # The preferred threshold sorts first among equal scores.
    rank = F.row_number().over(
        Window.partitionBy("model").orderBy(F.desc("macro_f1"), F.col("threshold") == F.lit(fixed))
    )
    return swept.select("threshold", "accuracy", "macro_f1", (rank == 1).alias("chosen"))


def prediction_share(df: DataFrame, pred: str = "pred") -> DataFrame:
    """Percentage of each predicted class."""
    counts = df.groupBy(F.col(pred).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select("label", (F.col("n") * 100.0 / total).alias("percentage"))
