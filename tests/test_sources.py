"""Sources, caches, sinks, scratch space and the incremental extraction."""

import glob

import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from quillmark.functions.features import add_features
from quillmark.operators import profile
from quillmark.sources import corpus, session
from quillmark.streaming.extract import extract_stream


def test_entry(spark):
    out = entry_module.entry(spark)
    assert out.count() > 0 and "avg_line_len" in out.columns
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_split_and_submission(spark, tmp_path):
    path = str(tmp_path / "test.parquet")
    spark.createDataFrame([(1, "x")], "ID long, code string").write.parquet(path)
    df = corpus.read_split(spark, path)
    assert set(df.columns) == {"ID", "code", "generator", "language", "label"}
    assert df.first()["label"] is None
    out = str(tmp_path / "out")
    corpus.write_submission(spark.createDataFrame([(1, 0), (2, 1)], "ID long, label int"), out)
    assert sorted(map(tuple, corpus.read_submission(spark, out).collect())) == [(1, 0), (2, 1)]
    assert open(glob.glob(out + "/part-*.csv")[0]).readline().strip() == "ID,label"


def test_cache(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(len(calls))

    path = str(tmp_path / "cache")
    assert corpus.cached(spark, path, "1", build).count() == 1
    assert corpus.cached(spark, path, "1", build).count() == 1 and len(calls) == 1
    assert corpus.cached(spark, path, "2", build).count() == 2
    assert corpus.cached(spark, path, "1", build, refresh=True).count() == 3
    (tmp_path / "cache" / "version=9").mkdir()
    assert corpus.cached(spark, path, "9", build).count() == 4


def test_inventory(spark, tmp_path):
    (tmp_path / "s.csv").write_text("ID,label\n1,0\n2,1\n")
    (tmp_path / "bad.parquet").write_text("not parquet")
    rows = profile.inventory(spark, [str(tmp_path / n) for n in ("s.csv", "bad.parquet", "none.parquet", "x.txt")]).collect()
    by_file = {}
    for r in rows:
        by_file.setdefault(r["file"], []).append(r)
    assert [r["column"] for r in by_file["s.csv"]] == ["ID", "label"] and by_file["s.csv"][0]["n_rows"] == 2
    assert by_file["bad.parquet"][0]["status"] == "error"
    assert by_file["none.parquet"][0]["status"] == "missing"
    assert by_file["x.txt"][0]["status"] == "unsupported"


def test_scratch(spark, monkeypatch):
    assert session.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    df = session.materialize(spark.range(5).withColumn("x", F.col("id") * 2))
    assert sorted(r["x"] for r in df.collect()) == [0, 2, 4, 6, 8]
    table, small = session.bounded(spark.range(10), 5)
    assert not small and table.count() == 10
    assert session.bounded(spark.range(3), 5)[1]
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert session.spread(docs, "doc_id").count() == docs.count()


def test_frequency(spark):
    df = spark.createDataFrame([(None,), ("a",), ("a",), ("b",), ("c",)], "v string")
    rows = profile.frequency(df, "v").collect()
    assert [(r["value"], r["count"], r["percentage"]) for r in rows] == [("a", 2, 40.0), (None, 1, 20.0), ("b", 1, 20.0), ("c", 1, 20.0)]
    top = profile.frequency(df, "v", top=2).collect()
    assert len(top) == 2 and top[0]["n_more"] == 2


def test_incremental_extraction(spark, tmp_path):
    source, target, state = (str(tmp_path / d) for d in ("in", "out", "state"))
    schema = "id long, code string"
    first = spark.createDataFrame([(1, "a = 1\n"), (2, None)], schema)
    second = spark.createDataFrame([(3, "# x y\n  z")], schema)
    seen = []
    for batch in (first, second):
        batch.write.mode("append").parquet(source)
        extract_stream(spark, source, target, state, schema, preset="LAYOUT47").awaitTermination(120)
        seen.append(spark.read.parquet(target).count())
    assert seen == [2, 3]
    expected = add_features(first.unionByName(second), preset="LAYOUT47")
    assert sorted(map(tuple, spark.read.parquet(target).collect())) == sorted(map(tuple, expected.collect()))


def test_cluster_needs_a_shared_folder(spark):
    class Context:
        master = "yarn"

    class Conf:
        def get(self, *_):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError):
        session.shared_dir(Session())


def test_cache_that_lost_a_part_is_built_anew(spark, tmp_path):
    path, calls = str(tmp_path / "cache"), []

    def build():
        calls.append(1)
        return spark.range(40).repartition(4)

    assert corpus.cached(spark, path, "1", build).count() == 40
    assert corpus.cached(spark, path, "1", build).count() == 40 and len(calls) == 1
    import os

    os.remove(glob.glob(f"{path}/version=1/part-*.parquet")[0])
    assert corpus.cached(spark, path, "1", build).count() == 40 and len(calls) == 2
    os.remove(f"{path}/version=1/_SUCCESS")
    assert corpus.cached(spark, path, "1", build).count() == 40 and len(calls) == 3


def test_close_removes_what_a_run_left(spark):
    import os

    stored = session.materialize(spark.range(5), "closing")
    assert stored.count() == 5 and os.path.isdir(session.run_dir(spark))
    session.close(spark)
    assert not os.path.exists(session.run_dir(spark))
    assert session.materialize(spark.range(3)).count() == 3


def test_caches_follow_the_content(spark, tmp_path):
    """Tables replaced by others of the same counts and sums are read anew."""
    from quillmark.plans import catalog

    for text, chars in (("a b c d", (5, 7)), ("e;f;g;h", (7, 5))):
        docs = [(i, text, "en", "s", n) for i, n in enumerate(chars)]
        spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int").write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
        scores = {r.id: r.score for r in catalog.QUERIES["score_cache"](spark, str(tmp_path)).collect()}
        assert scores == {i: n / 1000 for i, n in enumerate(chars)}
        cached = sorted(catalog.QUERIES["feature_cache"](spark, str(tmp_path)).collect())
        assert cached == sorted(catalog.QUERIES["feat_base9"](spark, str(tmp_path)).collect())
