"""Evaluation, selection, scaling and discriminant against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.operators import metrics as M
from quillmark.operators import ordering as O
from quillmark.operators import qda, quantile, scaling, selection


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    label = rng.integers(0, 2, 400)
    score = np.clip(np.round(0.3 * label + rng.random(400) * 0.7, 2), 0, 1)
    return [(int(i), int(y), float(s)) for i, (y, s) in enumerate(zip(label, score))]


@pytest.fixture(scope="module")
def scored(spark, data):
    return spark.createDataFrame(data, "id long, label int, score double").repartition(4)


def _cells(data, t):
    tp = sum(y == 1 and s > t for _, y, s in data)
    fp = sum(y == 0 and s > t for _, y, s in data)
    fn = sum(y == 1 and s <= t for _, y, s in data)
    return tp, fp, fn, len(data) - tp - fp - fn


def _macro_f1(tp, fp, fn, tn):
    return (2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2


def test_sweep_and_best(scored, data):
    rows = M.sweep(scored, ["score"], M.FINE).collect()
    assert len(rows) == 80
    for r in rows:
        tp, fp, fn, tn = _cells(data, r["threshold"])
        assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (tp, fp, fn, tn)
    top = max(sorted(M.FINE), key=lambda t: _macro_f1(*_cells(data, t)))
    best = M.best(M.sweep(scored, ["score"], M.FINE)).first()
    assert best["threshold"] == top
    assert best["macro_f1"] == pytest.approx(_macro_f1(*_cells(data, top)))
    positives = [r["tp"] + r["fp"] for r in sorted(rows, key=lambda r: r["threshold"])]
    assert positives == sorted(positives, reverse=True)


@pytest.mark.parametrize("small", [200_000, 3])
def test_auc(scored, data, monkeypatch, small):
    monkeypatch.setattr(O, "SMALL", small)
    pos = [s for _, y, s in data if y == 1]
    neg = [s for _, y, s in data if y == 0]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert M.auc(scored).first()["auc"] == pytest.approx(wins / len(pos) / len(neg))
    assert M.auc(scored.where("label = 1")).first()["auc"] is None


def test_confusion_and_report(spark, scored, data):
    pred = selection.at(scored, "score", 0.5, "pred")
    tp, fp, fn, tn = _cells(data, 0.5)
    cells = {(r["label"], r["pred"]): r["count"] for r in M.confusion(pred).collect()}
    assert cells == {(1, 1): tp, (0, 1): fp, (1, 0): fn, (0, 0): tn}
    report = {r["class"]: r for r in M.report(pred).collect()}
    assert report["1"]["precision"] == pytest.approx(tp / (tp + fp))
    assert report["0"]["recall"] == pytest.approx(tn / (tn + fp))
    assert report["macro avg"]["f1"] == pytest.approx(_macro_f1(tp, fp, fn, tn))
    assert report["weighted avg"]["recall"] == pytest.approx((tp + tn) / len(data))
    # an absent class does not enter the macro mean
    one = spark.createDataFrame([(1, 1)], "label int, pred int")
    assert M.macro(one).first()["macro_f1"] == 1.0
    empty = M.confusion(one.limit(0)).collect()
    assert sum(r["count"] for r in empty) == 0 and len(empty) == 4


def test_fixed_threshold_needs_a_strict_gain(spark):
    df = spark.createDataFrame([(1, 0.99), (0, 0.2)], "label int, score double")
    chosen = M.better_of_two(df, "score", 0.5, 0.97).where("chosen").first()
    assert chosen["threshold"] == 0.5
    df = spark.createDataFrame([(1, 0.99), (0, 0.6)], "label int, score double")
    assert M.better_of_two(df, "score", 0.5, 0.97).where("chosen").first()["threshold"] == 0.97


def test_top_n(scored, data):
    order = sorted((s for _, _, s in data), reverse=True)
    df = scored.drop("label")
    for n in (1, 50, 200):
        cut = order[n - 1]
        assert selection.top_threshold(df, "score", n) == cut
        drop = selection.top_n(df, "score", n).agg(F.sum("label")).first()[0]
        assert drop == sum(s > cut for s in order) <= n - 1 or n == 1
        fill = selection.top_n(df, "score", n, ties="fill")
        assert fill.agg(F.sum("label")).first()[0] == n and fill.count() == len(data)
    assert selection.top_n(df, "score", 0).agg(F.sum("label")).first()[0] == 0
    assert selection.top_n(df, "score", 0, ties="fill").agg(F.sum("label")).first()[0] == 0
    assert selection.top_n(df, "score", 10**6).agg(F.sum("label")).first()[0] == len(data)
    with pytest.raises(ValueError):
        selection.top_n(df, "score", 5, ties="other")


def test_scaling(spark):
    df = spark.createDataFrame(
        [(1.0, 2.0, None, float("nan")), (3.0, 2.0, 1.0, 0.0), (8.0, 2.0, 1.0, 1.0)], "a double, b double, c double, d double")
    assert scaling.complete_columns(df, ["a", "b", "c", "d"]) == ["a", "b"]
    params = scaling.fit_scaler(df, ["a", "b"])
    out = scaling.scale(df, params).collect()
    assert [r["a"] for r in out] == pytest.approx(list((np.array([1, 3, 8]) - 4) / np.std([1, 3, 8])))
    assert [r["b"] for r in out] == [0.0, 0.0, 0.0]
    inverted, bounds = scaling.minmax_inverted(df, ["a", "b"])
    assert [r["a"] for r in inverted.collect()] == pytest.approx([1, 5 / 7, 0])
    assert [r["b"] for r in inverted.collect()] == [0.0] * 3
    again, _ = scaling.minmax_inverted(df.where("a > 1"), ["a"], {"a": bounds["a"]})
    assert [r["a"] for r in again.collect()] == pytest.approx([5 / 7, 0])
    labels = spark.createDataFrame([(0,), (0,), (0,), (1,), (None,)], "label int")
    weights = {r["label"]: r["weight"] for r in scaling.class_weights(labels).collect()}
    assert weights == {0: pytest.approx(4 / 6), 1: 2.0}
    assert scaling.with_class_weight(labels).where("weight is null").count() == 1


def test_qda_matches_closed_form(spark):
    rng = np.random.default_rng(3)
    a = rng.multivariate_normal([0, 0], [[1, 0.3], [0.3, 2]], 200)
    b = rng.multivariate_normal([1, 2], [[2, -0.5], [-0.5, 1]], 300)
    rows = [(float(x), float(y), 0) for x, y in a] + [(float(x), float(y), 1) for x, y in b]
    df = spark.createDataFrame(rows, "x double, y double, label int")
    params = qda.fit(df, ["x", "y"])

    def decision(points, sample, share):
        cov = np.cov(sample.T)
        d = points - sample.mean(0)
        return math.log(share) - 0.5 * math.log(np.linalg.det(cov)) - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)

    points = np.vstack([a, b])
    gap = decision(points, a, 0.4) - decision(points, b, 0.6)
    expected = sorted(zip(points[:, 0], 1 / (1 + np.exp(gap))))
    got = sorted((r["x"], r["probability"]) for r in qda.score(df, params, ["x", "y"]).collect())
    assert [p for _, p in got] == pytest.approx([p for _, p in expected], abs=1e-9)
    grid = qda.surface(df, params, ["x", "y"], points=20)
    assert grid.count() == 400
    assert grid.agg(F.min("x")).first()[0] == pytest.approx(points[:, 0].min() - 0.1)
    far = spark.createDataFrame([(1e6, 1e6)], "x double, y double")
    assert 0.0 <= qda.score(far, params, ["x", "y"]).first()["probability"] <= 1.0
    with pytest.raises(ValueError):
        qda.score(df, qda.fit(df.withColumn("y", F.lit(1.0)), ["x", "y"]), ["x", "y"])


def test_quantile_transform(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.exponential(size=300), 1)
    df = spark.createDataFrame([(i, float(v), 5.0) for i, v in enumerate(x)], "id long, x double, c double")
    grid = quantile.fit(df, ["x", "c"], 1000)
    assert len(grid["x"]) == 300
    # rounding removes the float noise of the positions, so equal landmarks are equal
    marks, steps = np.round(np.quantile(x, np.linspace(0, 1, 300)), 9), np.linspace(0, 1, 300)
    expected = 0.5 * (np.interp(x, marks, steps) - np.interp(-x, -marks[::-1], -steps[::-1]))
    expected[x == x.max()] = 1
    expected[x == x.min()] = 0
    out = quantile.transform(df, grid).orderBy("id").collect()
    assert [r["x"] for r in out] == pytest.approx(list(expected), abs=1e-9)
    assert {r["c"] for r in out} == {0.0}
    beyond = spark.createDataFrame([(1, -5.0, 0.0), (2, 99.0, 9.0)], "id long, x double, c double")
    assert [r["x"] for r in quantile.transform(beyond, grid).orderBy("id").collect()] == [0.0, 1.0]


def test_missing_scores(spark):
    nan = float("nan")
    df = spark.createDataFrame([(0, nan), (1, 0.9), (0, 0.2), (1, None)], "label int, score double")
    row = M.sweep(df, ["score"], [0.5]).first()
    assert (row["tp"], row["fp"], row["fn"], row["tn"]) == (1, 0, 0, 2)
    assert [r["pred"] for r in selection.at(df, "score", 0.5, "pred").collect()] == [0, 1, 0, None]
    with pytest.raises(ValueError):
        M.auc(df)
    assert M.auc(df.where("not isnan(score) or score is null")).first()["auc"] == 1.0


def test_a_column_without_values_is_not_fitted(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, b double")
    with pytest.raises(ValueError, match="b"):
        quantile.fit(df, ["a", "b"], 10)


def test_qda_of_three_and_four_columns(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(200, 4)) @ rng.normal(size=(4, 4))
    y = (rng.random(200) < 0.4).astype(int)
    x[y == 1] += 0.7
    df = spark.createDataFrame([(int(k), *map(float, v)) for k, v in zip(y, x, strict=True)], "label int, a double, b double, c double, d double")
    for columns in (["a"], ["a", "b", "c"], ["a", "b", "c", "d"]):
        k = len(columns)
        logs = []
        for c in (0, 1):
            own = x[y == c][:, :k]
            cov = np.atleast_2d(np.cov(own.T))
            gap = x[:, :k] - own.mean(axis=0)
            logs.append(math.log((y == c).mean()) - 0.5 * np.log(np.linalg.det(cov)) - 0.5 * np.einsum("ij,jk,ik->i", gap, np.linalg.inv(cov), gap))
        expected = 1 / (1 + np.exp(logs[0] - logs[1]))
        got = [r["probability"] for r in qda.score(df, qda.fit(df, columns), columns).collect()]
        assert got == pytest.approx(list(expected), abs=1e-9)


def test_density_equals_direct_sum(spark):
    """Cells with moments against the sum over all values; far outliers leave grid points that nothing reaches."""
    import math

    from quillmark.operators import profile

    values = [math.sin(i * 12.9898) * 3 + (i % 7) for i in range(700)] + [400.0, -250.0]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    got = {r.k: (r.x, r.density) for r in profile.density(df, "v", 120).collect()}
    n, low, high = len(values), min(values), max(values)
    mean = sum(values) / n
    h = math.sqrt(sum((v - mean) ** 2 for v in values) / (n - 1)) * n**-0.2
    assert sorted(got) == list(range(120))
    for k, (x, p) in got.items():
        assert x == pytest.approx(low + k * (high - low) / 119)
        direct = sum(math.exp(-0.5 * ((x - v) / h) ** 2) for v in values) / (n * h * math.sqrt(2 * math.pi))
        assert p == pytest.approx(direct, abs=1e-9 / h)
