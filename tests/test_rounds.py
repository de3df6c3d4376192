"""Boosting rounds in one job against Spark ML's chain of jobs."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.operators import rounds, trees

COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def parts(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(900):
        y = int(rng.random() < 0.4)
        rows.append((i, y, *map(float, rng.normal(size=3) + np.array([1.0, -0.7, 0.2]) * y)))
    rows += [(2000 + i, None, 0.0, 0.0, 0.0) for i in range(5)]
    df = spark.createDataFrame(rows, "id long, label int, a double, b double, c double").repartition(3).cache()
    return df.where("id % 3 > 0"), df.where("id % 3 = 0")


def _same(a, b):
    assert (a.feature == b.feature).all() and a.value == pytest.approx(b.value, abs=1e-9)
    assert (np.isinf(a.cut) == np.isinf(b.cut)).all() and (a.cut[np.isfinite(a.cut)] == b.cut[np.isfinite(b.cut)]).all()


def test_trees_are_those_of_spark_ml(parts):
    train, _ = parts
    params = trees.BoostParams(rounds=12, rate=0.1, row_share=1.0, column_share=1.0, wait=None)
    _same(trees.fit_until(train, None, COLUMNS, params)[0].trees, trees.boosted_model(train, COLUMNS, params).trees)
    few = replace(params, bins=16, depth=4)
    _same(trees.fit_until(train, None, COLUMNS, few)[0].trees, trees.boosted_model(train, COLUMNS, few).trees)


def test_a_round_is_no_spark_job_and_none_is_fitted_twice(parts, monkeypatch):
    """5,000 rounds end ``wait`` rounds after the best one; before, they were fitted in doubled lengths by Spark ML."""
    train, val = parts
    monkeypatch.setattr(trees, "boosted_model", lambda *a: pytest.fail("a chain of jobs"))
    params = trees.BoostParams(rounds=5000, wait=25, min_rows=5)
    for watch in ("macro_f1", "f1", "log_loss"):
        model, stop = trees.fit_until(train, val, COLUMNS, replace(params, watch=watch))
        assert model.rounds == stop + 25 and model.best_round(val, 25, watch=watch) == (stop, True)
    # rounds do not depend on what comes after them
    short, _ = trees.fit_until(train, None, COLUMNS, replace(params, rounds=7))
    assert (short.trees.value == model.trees.value[:7]).all()


def test_larger_tables_go_to_spark_ml(parts, monkeypatch):
    train, val = parts
    asked, fit = [], trees.boosted_model
    monkeypatch.setattr(rounds, "MOST_ROWS", 100)
    monkeypatch.setattr(trees, "FIRST_ROUNDS", 4)
    monkeypatch.setattr(trees, "WHOLE_ROUNDS", 3)
    monkeypatch.setattr(trees, "boosted_model", lambda t, c, p, label: asked.append(p.rounds) or fit(t, c, p, label))
    model, stop = trees.fit_until(train, val, COLUMNS, trees.BoostParams(rounds=6, wait=6, depth=2))
    assert asked == [6] and model.rounds == 6 and 1 <= stop <= 6
    assert trees.fit_until(train, None, COLUMNS, trees.BoostParams(rounds=2, wait=6, depth=2))[1] is None


def test_repeated_rows_order_and_odd_input(spark, parts):
    train, val = parts
    params = trees.BoostParams(rounds=6, row_share=0.6, column_share=0.6, wait=None, min_rows=2)
    twice = train.unionByName(train)
    one = trees.fit_until(twice.repartition(5), None, COLUMNS, params)[0].trees
    other = trees.fit_until(twice.orderBy(F.desc("id")), None, COLUMNS, params)[0].trees
    assert all((getattr(one, k) == getattr(other, k)).all() for k in ("feature", "cut", "value"))
    constant = train.withColumn("a", F.lit(1.0)).withColumn("b", F.lit(0.0)).withColumn("c", F.lit(2.0))
    scored = trees.fit_boosted(constant, None, COLUMNS, params)(val, "s")
    assert scored.columns == [*val.columns, "s"] and scored.select("s").distinct().count() == 1
    for bad, message in ((train.withColumn("a", F.lit(None).cast("double")), "null"), (train.withColumn("label", F.lit(2)), "label"), (train.where("false"), "no labelled row")):
        with pytest.raises(Exception, match=message):
            trees.fit_until(bad, None, COLUMNS, params)
    with pytest.raises(Exception, match="null"):
        trees.fit_boosted(train, None, COLUMNS, params)(val.withColumn("b", F.lit(float("nan"))), "s").collect()


def test_narrow_tables_of_six_gigabytes_are_not_a_chain_of_jobs(parts, monkeypatch):
    """1.2 million labelled rows of 9 columns; before, 500,000 rows were the bound whatever the columns."""
    assert rounds.most_rows(["x"] * 9) >= 1_200_000 and rounds.most_rows(["x"] * 30) == 500_000
    train, _ = parts
    monkeypatch.setattr(trees, "boosted_model", lambda *a: pytest.fail("a chain of jobs"))
    monkeypatch.setattr(rounds, "MOST_ROWS", train.where("label is not null").count())
    trees.fit_until(train, None, COLUMNS, trees.BoostParams(rounds=1))
    with pytest.raises(pytest.fail.Exception):
        wide = [f"{c}{i}" for c in COLUMNS for i in range(4)]
        trees.fit_until(train.select("label", *[F.col(w[0]).alias(w) for w in wide]), None, wide, trees.BoostParams(rounds=1))


def test_rows_walk_in_chunks(parts, monkeypatch):
    train, val = parts
    params = trees.BoostParams(rounds=8, wait=8, min_rows=2, depth=5)
    whole = trees.fit_until(train, val, COLUMNS, params)[0].trees
    monkeypatch.setattr(rounds, "CHUNK", 7)
    rows = rounds.table(train, val, COLUMNS).toArrow()
    held = rounds._Rows(iter(rows.to_batches(100)), params)
    for number in range(8):
        feature, cut, value = (np.frombuffer(b, kind) for b, kind in zip(rounds._complete(*held.tree(number)), ("<i4", "<f8", "<f8"), strict=True))
        assert (feature == whole.feature[number]).all() and (cut == whole.cut[number]).all() and value == pytest.approx(whole.value[number])
        known = whole.margin(np.array([rows.column(f"x{i}").to_numpy() for i in range(3)]), number + 1)
        assert sorted(held.margin) == pytest.approx(sorted(known))
