"""Model operators on small synthetic tables."""

from dataclasses import replace

import numpy as np
import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from quillmark.functions import arrays
from quillmark.operators import ensembles, iforest, metrics, trees
from quillmark.operators.linear import fit_logistic
from quillmark.plans import anomaly, boosting, catalog, rebalanced

COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(600):
        y = int(rng.random() < 0.35)
        x = rng.normal(size=3) + np.array([1.5, -1.0, 0.0]) * y
        rows.append((i, "L%d" % (i % 2), y, *map(float, x)))
    return spark.createDataFrame(rows, "id long, language string, label int, a double, b double, c double").repartition(4).cache()


@pytest.fixture(scope="module")
def parts(table):
    return table.where("id < 400"), table.where("id >= 400")


def _auc(df, score):
    return metrics.auc(df, "label", score).first()["auc"]


def test_boosted_stages(parts):
    train, val = parts
    params = trees.BoostParams(rounds=12, wait=4, row_share=1.0, column_share=1.0, min_rows=1)
    model = trees.boosted_model(train, COLUMNS, params)
    history = {r["round"]: r for r in model.by_round(val).collect()}
    assert sorted(history) == list(range(1, 13))
    # the staged score of all rounds equals the model's own probability
    own = trees._probability(model.model.copy().setProbabilityCol("_p"), val, COLUMNS, "p")
    both = model.score(own, "q")
    assert both.agg(F.max(F.abs(F.col("p") - F.col("q")))).first()[0] < 1e-9
    for t in (1, 12):
        pred = model.score(val, "s", t).withColumn("pred", (F.col("s") > 0.5).cast("int"))
        assert metrics.macro(pred).first()["macro_f1"] == pytest.approx(history[t]["macro_f1"])
    best, gave_up = model.best_round(val, None)
    assert not gave_up and history[best]["macro_f1"] == max(h["macro_f1"] for h in history.values())
    assert model.best_round(val, 1)[0] <= best
    lowest = model.best_round(val, None, watch="log_loss")[0]
    assert history[lowest]["log_loss"] == min(h["log_loss"] for h in history.values())
    for r in history.values():
        assert r["f1"] == pytest.approx(2 * r["tp"] / (2 * r["tp"] + r["fp"] + r["fn"]))
    scored = trees.fit_boosted(train, val, COLUMNS, params)(val, "s")
    assert _auc(scored, "s") > 0.8
    assert scored.columns == [*val.columns, "s"]


def test_boosting_stops_while_fitting(parts):
    train, val = parts
    model, stop = trees.fit_until(train, val, COLUMNS, trees.BoostParams(rounds=5000, wait=10, depth=2, min_rows=5))
    assert stop <= model.rounds - 10 and model.rounds < 1000
    full, all_rounds = trees.fit_until(train, None, COLUMNS, trees.BoostParams(rounds=3, wait=10))
    assert full.rounds == 3 and all_rounds is None


def test_boosting_does_not_depend_on_partitions(parts):
    train, val = parts
    params = trees.BoostParams(rounds=5, wait=None, row_share=0.7, column_share=0.7, min_rows=3)
    scores = []
    for k in (2, 7):
        scored = trees.fit_boosted(train.repartition(k), None, COLUMNS, params)(val, "s")
        scores.append({r["id"]: r["s"] for r in scored.collect()})
    assert scores[0].keys() == scores[1].keys()
    assert max(abs(scores[0][i] - scores[1][i]) for i in scores[0]) < 1e-9


def test_forest_in_several_pieces(spark, monkeypatch):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(i, i % 2, *map(float, rng.normal(size=3))) for i in range(300)], "id long, label int, a double, b double, c double")
    forest = iforest.fit(df, COLUMNS, trees=12, psi=32).cache()
    whole = {r["id"]: (r["h"], r["m"]) for r in iforest.score(df, forest, COLUMNS, {0: 32, 1: 32}, {0: "h", 1: "m"}).collect()}
    monkeypatch.setattr(iforest, "MAX_NODES", 150)
    pieces = {r["id"]: (r["h"], r["m"]) for r in iforest.score(df, forest, COLUMNS, {0: 32, 1: 32}, {0: "h", 1: "m"}).collect()}
    assert whole.keys() == pieces.keys()
    assert all(whole[i] == pytest.approx(pieces[i]) for i in whole)


def test_forest_and_logistic(parts):
    train, val = parts
    assert _auc(trees.fit_forest(train, COLUMNS, trees=20)(val, "s"), "s") > 0.8
    scored = fit_logistic(train, COLUMNS)(val, "s")
    assert _auc(scored, "s") > 0.85
    # scaling inside the model: units do not matter
    moved = [d.withColumn("a", F.col("a") * 1000 + 7) for d in (train, val)]
    other = {r["id"]: r["s"] for r in fit_logistic(moved[0], COLUMNS)(moved[1], "s").collect()}
    for r in scored.collect():
        assert r["s"] == pytest.approx(other[r["id"]], abs=1e-4)


def test_comparison(parts):
    train, val = parts
    fitted = boosting.compare(train, val, COLUMNS, models=("lgbm", "lr"), rounds=5)
    scored = fitted.score(val)
    assert {r["model"] for r in fitted.best_thresholds(scored).collect()} == {"lgbm", "lr"}
    exported = fitted.export(scored)
    assert exported["lr"].columns == ["ID", "label"] and exported["lr"].count() == val.count()
    with pytest.raises(ValueError):
        boosting.compare(train, val, COLUMNS, models=("nope",))


def test_cross_validation(parts):
    train, val = parts
    fitted = rebalanced.fit(rebalanced.rebalance(train, n=60), val, [], COLUMNS, trees.BoostParams(rounds=4, wait=4), k=3)
    assert fitted.oof.count() == rebalanced.rebalance(train, n=60).count() == fitted.oof.select("id").distinct().count()
    assert _auc(fitted.scored[0], "score") > 0.75
    assert fitted.threshold in metrics.FINE


def test_stacking_and_fusion(parts):
    train, val = parts
    boost = lambda a, _, cols: trees.fit_boosted(a, None, cols, trees.BoostParams(rounds=3, wait=None))
    oof, test = ensembles.stack_views(train, val, {"u": ["a"], "v": ["b", "c"], "w": []}, boost, k=3)
    assert oof.count() == train.count() and {"score_u", "score_v"} <= set(oof.columns)
    assert _auc(test, "probability") > 0.75
    fused = ensembles.fuse(train.withColumn("m", F.col("a") * 2), val.withColumn("m", F.col("a") * 2), COLUMNS, ["m"])
    assert _auc(fused, "fused") > 0.85


def test_ablation_and_search(parts):
    train, val = parts
    out = {r["dropped"]: r["macro_f1"] for r in ensembles.ablation(train, val, COLUMNS, lambda a, _, c: fit_logistic(a, c)).collect()}
    assert set(out) == set(COLUMNS) and out["a"] < out["c"]
    found = ensembles.random_search(train, val, COLUMNS, trees.BoostParams(rounds=2, wait=None), draws=2)
    scores = [r["macro_f1"] for r in found.collect()]
    assert len(scores) == 2 and scores == sorted(scores, reverse=True)


def test_model_queries_run_full_settings(spark, monkeypatch):
    """What each registered query asks for; the fits themselves are short here."""
    boosted, forests = [], []
    fit_until, fit_forest = trees.fit_until, trees.fit_forest

    def short_boost(train, val, columns, params, label="label"):
        boosted.append((params.rounds, params.wait if val is not None else None))
        return fit_until(train, None, columns, replace(params, rounds=1), label)

    def short_forest(train, columns, label="label", trees=5000, **more):
        forests.append(trees)
        return fit_forest(train, columns, label, 2, **more)

    monkeypatch.setattr(trees, "fit_until", short_boost)
    monkeypatch.setattr(trees, "fit_forest", short_forest)
    expected = {
        "rf_extratrees": ([], [5000]),
        "model_comparison": ([(500, 50), (5000, 100), (5000, 100)], [5000]),
        "cv_oof": ([(500, 50)] * 5, []),
        "stack_views": ([(500, None)] * 18, []),
        "late_fusion": ([(500, None)], []),
        "random_search": ([(5000, 100)] * 10, []),
    }
    for name, asked in expected.items():
        boosted.clear(), forests.clear()
        catalog.QUERIES[name](spark, SF_DIR)
        assert (boosted, forests) == asked, name


def test_isolation_forest(spark):
    rng = np.random.default_rng(5)
    rows = [(i, i % 2, *map(float, rng.normal(size=3))) for i in range(700)]
    rows += [(1000 + i, i % 2, 9.0 + i, -9.0, 9.0) for i in range(6)]
    df = spark.createDataFrame(rows, "id long, label int, a double, b double, c double").repartition(5)
    samples = iforest.tree_samples(df, "label", "id", 12, 64, 1)
    sizes = samples.groupBy("class", "tree").agg(F.count("*").alias("n"), F.countDistinct("id").alias("d")).collect()
    assert len(sizes) == 24 and all(r["n"] == r["d"] == 64 for r in sizes)
    forest = iforest.fit(df, COLUMNS, trees=40, psi=64)
    again = iforest.fit(df.repartition(2), COLUMNS, trees=40, psi=64)
    assert sorted(forest.collect()) == sorted(again.collect())
    scored = iforest.score(df, forest, COLUMNS, {0: 64, 1: 64}, {0: "h", 1: "m"})
    worst = [r["id"] for r in scored.orderBy("h").limit(6).collect()]
    assert all(i >= 1000 for i in worst)
    assert scored.agg(F.min("h"), F.max("m")).first()[0] >= -0.5


def test_samples_of_a_tiny_class(spark):
    df = spark.createDataFrame([(i, 0, float(i)) for i in range(10)], "id long, label int, a double")
    sizes = iforest.tree_samples(df, "label", "id", 5, 256, 1).groupBy("tree").count().collect()
    assert [r["count"] for r in sizes] == [10] * 5


def test_anomaly_plan(table, parts):
    train, val = parts
    model = anomaly.fit(train, COLUMNS, trees=30, psi=64, quantiles=100)
    pair = model.pair(val)
    low, high = pair.agg(F.min("human_anomaly"), F.max("human_anomaly")).first()
    assert (low, high) == (0.0, 1.0)
    assert _auc(model.probability(val), "probability") > 0.6
    fixed = model.pair(val.limit(3), fixed_bounds=True)
    assert fixed.count() == 3
    labelled = model.label_top(val.drop("label"), 50, ties="fill")
    assert labelled.agg(F.sum("label")).first()[0] == 50


def test_head_tail_and_softmax(spark):
    sizes = [0, 1, 7, 8, 9, 30]
    df = spark.createDataFrame([(n, list(range(1, n + 1))) for n in sizes], "n int, ids array<int>")
    window, mask = arrays.head_tail(F.col("ids"), 8, -1)
    for r in df.select("n", window.alias("w"), mask.alias("m")).collect():
        ids = list(range(1, r["n"] + 1))
        real = ids[:4] + ids[-4:] if r["n"] > 8 else ids
        assert r["w"] == real + [-1] * (8 - len(real))
        assert r["m"] == [1] * len(real) + [0] * (8 - len(real))
    logits = [[0.0, 0.0], [1000.0, -1000.0], [-3.0, 2.0]]
    df = spark.createDataFrame([(x,) for x in logits], "x array<double>")
    for r in df.select("x", arrays.softmax(F.col("x")).alias("p")).collect():
        e = np.exp(np.array(r["x"]) - max(r["x"]))
        assert r["p"] == pytest.approx(list(e / e.sum()))
    picks = [r["i"] for r in df.select(arrays.argmax(F.col("x")).alias("i")).collect()]
    assert picks == [int(np.argmax(x)) for x in logits]


def test_side_by_side_keeps_order_and_raises(spark):
    from quillmark.operators.concurrent import side_by_side

    spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)
    tasks = [lambda i=i: spark.range(i).count() for i in (5, 3, 8, 1, 4)]
    assert side_by_side(spark, tasks, 3) == [5, 3, 8, 1, 4] == side_by_side(spark, tasks, 1)
    assert side_by_side(spark, []) == []
    with pytest.raises(ZeroDivisionError):
        side_by_side(spark, [lambda: 1, lambda: 1 // 0, lambda: 2], 2)
    assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None


def test_side_by_side_begins_in_order(spark, monkeypatch):
    import time

    from quillmark.operators.concurrent import side_by_side

    kind, began = type(spark.sparkContext), []
    put = kind.setLocalProperty

    def late_first(context, key, value):
        if value == "side-by-side-0":
            time.sleep(0.3)
        put(context, key, value)

    monkeypatch.setattr(kind, "setLocalProperty", late_first)
    side_by_side(spark, [lambda i=i: began.append(i) for i in range(4)], 4)
    assert began == [0, 1, 2, 3]


def test_concurrent_search_equals_one_by_one(spark, monkeypatch):
    from quillmark.operators import concurrent, ensembles, trees

    rows = [(i, float(i % 7), float(i % 5), int((i % 7) + (i * i % 11) > 7)) for i in range(240)]
    df = spark.createDataFrame(rows, "id long, a double, b double, label int")
    train, val = df.where("id % 3 > 0"), df.where("id % 3 = 0")
    base = trees.BoostParams(rounds=4, wait=2, min_rows=2)
    both = []
    for at_once in (4, 1):
        monkeypatch.setattr(ensembles, "side_by_side", lambda s, t, n=at_once: concurrent.side_by_side(s, t, n))
        found = ensembles.random_search(train, val, ["a", "b"], base, draws=4)
        fit = lambda a, _, cols: trees.fit_boosted(a, None, cols, base)
        _, test = ensembles.stack_views(train, val.drop("label"), {"x": ["a"], "y": ["a", "b"]}, fit, k=2)
        both.append((sorted(map(tuple, found.collect())), sorted(map(tuple, test.collect()))))
    assert both[0] == both[1] and both[0][1]


def test_random_trees_are_fitted_in_parts(parts, monkeypatch):
    """No fit carries more than TREES_AT_ONCE trees, all trees are there, and their mean is the score."""
    train, val = parts
    fitted, classifier = [], trees.RandomForestClassifier

    class Recorded(classifier):
        def fit(self, data):
            fitted.append((self.getNumTrees(), self.getSeed(), data.rdd.getNumPartitions()))
            return super().fit(data)

    monkeypatch.setattr(trees, "RandomForestClassifier", Recorded)
    monkeypatch.setattr(trees, "TREES_AT_ONCE", 8)
    scored = trees.fit_forest(train.coalesce(1), COLUMNS, trees=20)(val, "s")
    assert sorted(n for n, _, _ in fitted) == [4, 8, 8] and len({seed for _, seed, _ in fitted}) == 3
    assert min(p for _, _, p in fitted) > 1
    assert scored.columns == [*val.columns, "s"] and _auc(scored, "s") > 0.8
    low, high = scored.agg(F.min("s"), F.max("s")).first()
    assert 0.0 <= low < 0.3 and 0.7 < high <= 1.0


def test_walk_down_all_trees_a_level_at_a_time():
    """Places of a level lie side by side; sums are those of walking each tree alone, missing values go right."""
    import pandas as pd

    rng = np.random.default_rng(3)
    grown = [iforest._grow(rng.normal(size=(40, 3)), np.random.default_rng(t), 6) for t in range(5)] + [[(-1, 0.0, -1, -1, 2.5)]]
    rows = [(t, i, *node) for t, nodes in enumerate(grown) for i, node in enumerate(nodes)]
    levels, leaf = iforest._stack(pd.DataFrame(rows, columns=["tree", "node", "feature", "split", "left", "right", "depth_score"]))
    assert [len(f) for f, _ in levels] == [6 * 2**k for k in range(len(levels))] and len(levels) <= 6
    x = rng.normal(size=(600, 3))
    x[::7, 1] = np.nan

    def alone(row, nodes):
        at = 0
        while nodes[at][0] >= 0:
            at = nodes[at][2] if row[nodes[at][0]] <= nodes[at][1] else nodes[at][3]
        return nodes[at][4]

    expected = [sum(alone(row, nodes) for nodes in grown) for row in x]
    assert iforest._path_sums(x, levels, leaf, 6) == pytest.approx(expected)
