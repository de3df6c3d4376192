"""Ranks, running totals and order statistics against plain numpy."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.operators import ordering as O
from quillmark.operators import profile, sampling


@pytest.fixture(scope="module")
def skewed(spark):
    """Three groups, one holding most rows, one null."""
    rows = [(i, "hot" if i % 10 else ("b" if i % 20 else None)) for i in range(3000)]
    return spark.createDataFrame(rows, "id long, g string").repartition(5)


def _hash(i, seed=42):
    return hashlib.md5(f"{i}{seed}".encode()).hexdigest()


def _groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["g"], []).append(r["id"])
    return {g: sorted(ids, key=_hash) for g, ids in out.items()}


@pytest.mark.parametrize("small", [200_000, 5])
def test_hash_rank(skewed, monkeypatch, small):
    monkeypatch.setattr(O, "SMALL", small)
    expected = {i: n for ids in _groups(skewed).values() for n, i in enumerate(ids, 1)}
    assert {r["id"]: r["rank"] for r in O.hash_rank(skewed, ["g"], "id").collect()} == expected


def test_long_ranges_are_cut_finer(skewed, monkeypatch):
    monkeypatch.setattr(O, "RANGE_ROWS", 2)
    ranged, sizes, _ = O._ranged(skewed, ["g"], "id", 42)
    assert len(ranged.first()["_b"]) > 3 and sizes.agg(F.max("_n")).first()[0] <= 2
    expected = {i: n for ids in _groups(skewed).values() for n, i in enumerate(ids, 1)}
    assert {r["id"]: r["rank"] for r in O.hash_rank(skewed, ["g"], "id").collect()} == expected


@pytest.mark.parametrize("small", [200_000, 1])
@pytest.mark.parametrize("n", [1, 17, 150, 5000])
def test_take_lowest(skewed, monkeypatch, n, small):
    monkeypatch.setattr(O, "SMALL", small)
    expected = {i for ids in _groups(skewed).values() for i in ids[:n]}
    got = [r["id"] for r in O.take_lowest(skewed, ["g"], "id", n).collect()]
    assert len(got) == len(expected) and set(got) == expected


def test_sampling(skewed):
    groups = _groups(skewed)
    assert sampling.per_group(skewed, ["g"], 100).count() == sum(min(100, len(v)) for v in groups.values())
    labelled = skewed.withColumn("label", (F.col("id") % 3 == 0).cast("int"))
    small = sampling.fraction(labelled, F.col("g") == "hot", 900, ["label"])
    assert small.where("g is null").count() == len(groups[None])
    assert abs(small.where("g = 'hot'").count() - 900) <= 1
    with pytest.raises(ValueError):
        sampling.fraction(labelled, F.col("g") == "hot", 10_000, ["label"])
    folds = sampling.folds(labelled).groupBy("label", "fold").count().collect()
    for k in (0, 1):
        sizes = [r["count"] for r in folds if r["label"] == k]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    assert [r["id"] for r in sampling.head(skewed, 7).orderBy("id").collect()] == list(range(7))
    assert sampling.head(skewed, 0).count() == 0 and sampling.head(skewed, 9999).count() == 3000
    order = [r["id"] for r in sampling.shuffle(skewed).collect()]
    assert order == sorted(range(3000), key=_hash)
    assert sampling.sample_rows(skewed, 12).count() == 12


@pytest.mark.parametrize("small", [200_000, 40])
def test_running_totals(spark, monkeypatch, small):
    monkeypatch.setattr(O, "SMALL", small)
    rng = np.random.default_rng(1)
    counts = [(g, float(v), int(rng.integers(1, 9))) for g in "ab" for v in np.unique(rng.normal(size=300))]
    df = spark.createDataFrame(counts, "g string, v double, c long").repartition(7)
    got = {(r["g"], r["v"]): r["cum_c"] for r in O.running_totals(df, ["g"], "v", ["c"]).collect()}
    for g in "ab":
        total = 0
        for _, v, c in sorted(x for x in counts if x[0] == g):
            total += c
            assert got[g, v] == total
    one = O.running_totals(df.where("g = 'a'").drop("g"), [], "v", ["c"])
    assert one.agg(F.max("cum_c")).first()[0] == sum(c for g, _, c in counts if g == "a")


@pytest.mark.parametrize("small", [200_000, 40])
@pytest.mark.parametrize("n", [2, 5, 100, 1000])
def test_quantile_grid(spark, monkeypatch, n, small):
    monkeypatch.setattr(O, "SMALL", small)
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=400), rng.integers(0, 6, 400).astype(float)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)] + [(None, float("nan"))], "x double, y double")
    grid = O.quantile_grid(df, ["x", "y"], n).collect()
    for name, data in (("x", x), ("y", y)):
        ours = [r["value"] for r in sorted((r for r in grid if r["feature"] == name), key=lambda r: r["k"])]
        assert ours == pytest.approx(list(np.quantile(data, np.linspace(0, 1, n))))


@pytest.mark.parametrize("bounds", [[], [3.0], [1.0, 2.0], [1.0, 1.0, 2.0, 5.0, 5.0, 5.0, 9.0], [float(i // 3) for i in range(64)]])
def test_lower_bounds(spark, bounds):
    values = [-1.0, 0.0, 1.0, 1.5, 2.0, 5.0, 9.0, 20.5, 100.0, float("nan"), None]
    df = spark.createDataFrame([(v, bounds) for v in values], "v double, b array<double>")
    got = [r[0] for r in df.select(O._lower_bounds("b", F.col("v"), max(1, len(bounds)))).collect()]
    inf = float("inf")
    assert got == [0 if v is None else sum(b < (inf if v != v else v) for b in bounds) for v in values]


@pytest.mark.parametrize(("sample", "ranged"), [(100_000, 2_000_000), (15, 2_000_000), (15, 20)])
def test_quantile_grid_does_not_depend_on_its_cuts(spark, monkeypatch, sample, ranged):
    monkeypatch.setattr(O, "CUT_SAMPLE", sample)
    monkeypatch.setattr(O, "RANGE_ROWS", ranged)
    monkeypatch.setattr(O, "SMALL", 10)
    rng = np.random.default_rng(5)
    data = {
        "even": rng.normal(size=600), "tied": rng.integers(0, 3, 600) * 1.0, "one": np.full(600, 7.0),
        "hot": np.where(rng.random(600) < 0.4, 0.25, rng.exponential(size=600)), "rare": np.where(np.arange(600) == 311, 2.0, np.nan),
        "none": np.full(600, np.nan),
    }
    rows = [tuple(None if v != v and i % 2 else float(v) for v in row) for i, row in enumerate(zip(*data.values()))]
    grid = O.quantile_grid(spark.createDataFrame(rows, ", ".join(f"{c} double" for c in data)).repartition(5), list(data), 11)
    assert grid.dtypes == [("feature", "string"), ("k", "bigint"), ("value", "double")]
    got = {(r["feature"], r["k"]): r["value"] for r in grid.collect()}
    assert {c for c, _ in got} == set(data) - {"none"}
    for c in set(data) - {"none"}:
        x = data[c][~np.isnan(data[c])]
        assert [got[c, k] for k in range(11)] == pytest.approx(list(np.quantile(x, np.linspace(0, 1, 11))), rel=1e-12)


def test_quantile_grid_shuffles_the_cells_of_landmarks_only(spark):
    x = np.random.default_rng(6).permutation(20_000) * 1.0
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    cuts = O._cuts(df, 5)
    asked = np.zeros(2 * len(cuts[0]) + 1, bool)
    asked[2 * len(cuts[0]) // 2] = True
    kept = df.mapInArrow(O._cell_content(spark.sparkContext.broadcast([(cuts[0], asked)])), "feature int, cell int, value double, c long")
    assert 0 < kept.count() <= 2 * 20_000 / (5 * O.CELLS)


def test_quantile_grid_of_an_empty_table(spark):
    assert O.quantile_grid(spark.createDataFrame([], "x double"), ["x"], 5).count() == 0


def test_quantile_grid_with_infinities(spark):
    df = spark.createDataFrame([(v,) for v in (float("-inf"), 1.0, 2.0, float("inf"), float("inf"))], "x double")
    assert [r["value"] for r in O.quantile_grid(df, ["x"], 5).orderBy("k").collect()] == [float("-inf"), 1.0, 2.0, float("inf"), float("inf")]


def test_quantile_grid_of_one_row(spark):
    grid = O.quantile_grid(spark.createDataFrame([(3.0,)], "x double"), ["x"], 5).collect()
    assert [(r["k"], r["value"]) for r in sorted(grid)] == [(k, 3.0) for k in range(5)]


@pytest.mark.parametrize("data", [
    list(range(500)), [1.0] * 250 + [2.0] * 250, [0.5] * 499 + [0.1], [float(i % 3) for i in range(500)],
])
@pytest.mark.parametrize("n", [1, 2, 250, 251, 499, 500])
def test_nth_value(spark, data, n):
    df = spark.createDataFrame([(float(v),) for v in data], "v double")
    assert O.nth_value(df, "v", n, limit=10) == sorted(data)[n - 1]
    assert O.nth_value(df, "v", n, descending=True) == sorted(data, reverse=True)[n - 1]


def test_describe_and_argmax(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([5, 1, 9, 9, 2])], "id long, x double")
    r = profile.describe(df, ["x"]).first()
    assert (r["count"], r["min"], r["p25"], r["p50"], r["p75"], r["max"]) == (5, 1, 2, 5, 9, 9)
    assert r["std"] == pytest.approx(np.std([5, 1, 9, 9, 2], ddof=1))
    assert profile.argmax_row(df, "x").first()["id"] == 2
    assert sum(b["count"] for b in profile.histogram(df, "x").collect()) == 5
    assert profile.histogram(df.where("x > 100"), "x", bins=3).count() == 0
    assert profile.density(df.where("x = 9"), "x").count() == 0


def test_sampling_reads_the_rows_once(spark, tmp_path):
    """The boundary comes from narrow columns; the wide rows are scanned once and not shuffled."""
    rows = [(i, f"g{i % 3}", f"text {i}") for i in range(400)]
    spark.createDataFrame(rows, "id long, g string, text string").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    kept = sampling.per_group(df, ["g"], 50)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("text#") and sum("FileScan" in line and "text" in line for line in plan.splitlines()) == 1
    assert "Exchange hashpartitioning" not in plan
    assert {r["g"]: r["count"] for r in kept.groupBy("g").count().collect()} == {"g0": 50, "g1": 50, "g2": 50}
    assert sampling.sample_rows(df, 70).count() == 70


def test_head_is_exact_on_repeated_and_missing_keys(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "d"), (None, "e"), (None, "f")], "id int, v string")
    assert [r["id"] for r in sampling.head(df, 1).collect()] == [1]
    assert sorted(r["id"] for r in sampling.head(df, 4).collect()) == [1, 1, 1, 2]
    assert sorted((r["id"] or 9) for r in sampling.head(df, 5).collect()) == [1, 1, 1, 2, 9]
    assert sampling.head(df, 6).count() == sampling.head(df, 99).count() == 6
