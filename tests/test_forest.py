"""Random trees grown in packed blocks against Spark ML's."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.operators import forest, trees

COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(2500):
        y = int(rng.random() < 0.3)
        a, b, c = map(float, rng.normal(size=3) + np.array([1.0, -0.7, 0.2]) * y)
        rows.append((i, y, a, round(b, 1), c))
    rows += [(9000 + i, None, 0.0, 0.0, 0.0) for i in range(5)]
    return spark.createDataFrame(rows, "id long, label int, a double, b double, c double").repartition(3).cache()


@pytest.fixture(autouse=True)
def of_any_size(monkeypatch):
    monkeypatch.setattr(forest, "FEW_LEAVES", -1)


def _scores(scorer, df):
    return np.array([r["s"] for r in scorer(df, "s").orderBy("id").select("s").collect()])


def test_trees_are_those_of_spark_ml(table, monkeypatch):
    """With all columns drawn nothing is random; before, every node of every tree was an object on the driver."""
    for columns, depth in ((["a"], 12), (COLUMNS, 6)):
        expected = _scores(trees.spark_forest(table, columns, "label", 1, depth, 5, 42, "all"), table)
        monkeypatch.setattr(trees.math, "ceil", lambda _, n=len(columns): n)
        monkeypatch.setattr(trees, "RandomForestClassifier", None)
        assert _scores(trees.fit_forest(table, columns, trees=1, depth=depth), table) == pytest.approx(expected, abs=1e-6)
        assert len(set(expected)) > 4
        monkeypatch.undo()
        monkeypatch.setattr(forest, "FEW_LEAVES", -1)


def test_all_trees_are_grown_apart_and_their_mean_is_the_score(table, monkeypatch):
    kept, grow = [], forest.grow
    monkeypatch.setattr(trees, "RandomForestClassifier", None)
    monkeypatch.setattr(forest, "grow", lambda *a: kept.append(grow(*a)) or kept[-1])
    whole = _scores(trees.fit_forest(table, COLUMNS, trees=2 * forest.BLOCK + 10), table)
    blocks = kept[0]
    assert [len(depths) for depths, _, _ in blocks] == [forest.BLOCK, forest.BLOCK, 10]
    assert len({packed for _, _, packed in blocks}) == 3 and max(max(depths) for depths, _, _ in blocks) <= 12
    y = np.array([r["label"] for r in table.orderBy("id").collect() if r["label"] is not None])
    assert whole[: len(y)][y == 1].mean() > whole[: len(y)][y == 0].mean() + 0.3 and 0.0 <= whole.min() < whole.max() <= 1.0
    # neither the layout of the rows nor the number of trees changes a tree
    again = _scores(trees.fit_forest(table.orderBy(F.desc("id")).coalesce(1), COLUMNS, trees=2 * forest.BLOCK + 10), table)
    assert (again == whole).all() and kept[1] == blocks
    trees.fit_forest(table, COLUMNS, trees=forest.BLOCK)
    assert kept[2] == blocks[:1]


def test_repeated_rows_other_classes_and_odd_input(spark, table):
    known = table.where("label is not null")
    twice = known.unionByName(known)
    assert _scores(trees.fit_forest(twice, ["a"], trees=1, min_rows=10), table) == pytest.approx(_scores(trees.fit_forest(known, ["a"], trees=1), table))
    three = known.withColumn("label", F.when(F.col("id") % 10 == 0, 2).otherwise(F.col("label")))
    expected = _scores(trees.spark_forest(three, ["a"], "label", 1, 5, 5, 42), table)
    assert _scores(trees.fit_forest(three, ["a"], trees=1, depth=5), table) == pytest.approx(expected, abs=1e-6)
    constant = known.withColumns({c: F.lit(1.0) for c in COLUMNS})
    assert _scores(trees.fit_forest(constant, COLUMNS, trees=3), table) == pytest.approx(np.full(2505, 0.5))
    for bad, message in ((known.withColumn("a", F.lit(None).cast("double")), "null"), (known.withColumn("label", F.lit(0.5)), "class")):
        with pytest.raises(Exception, match=message):
            trees.fit_forest(bad, COLUMNS, trees=1)
    scorer = trees.fit_forest(known, COLUMNS, trees=2)
    assert scorer(table.where("false"), "s").collect() == []
    with pytest.raises(Exception, match="null"):
        scorer(table.withColumn("b", F.lit(float("nan"))), "s").collect()


def test_full_forests_are_not_spark_ml_s(spark, monkeypatch):
    """5,000 trees on a few hundred rows already filled the driver."""
    monkeypatch.undo()
    assert forest.fits(320, COLUMNS, 5000, 12, 5) and forest.fits(960_000, ["x"] * 9, 5000, 12, 5)
    assert not forest.fits(320, COLUMNS, 20, 12, 5) and not forest.fits(10**9, COLUMNS, 5000, 12, 5)


def test_tables_beyond_the_bound_go_to_spark_ml(table, monkeypatch):
    monkeypatch.setattr(forest, "MOST_BYTES", 100)
    monkeypatch.setattr(forest, "grow", lambda *a: pytest.fail("grown in bins"))
    assert 0.0 <= _scores(trees.fit_forest(table, COLUMNS, trees=2, depth=3), table).min()
