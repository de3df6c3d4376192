"""The registered queries: checking SQL, and the pipeline stage by stage."""

import duckdb
import pytest
from conftest import SF_DIR, TABLES

import corpus_pipeline
from quillmark.llm import base, bpe, jaccard, mixing, quality, queries


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    yield con
    con.close()


def _key(row):
    return tuple((v is not None, "" if v is None else str(v)) for v in row)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, db, name):
    df = queries.QUERIES[name](spark, SF_DIR)
    expected = db.sql(queries.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(expected.columns)
    index = [expected.columns.index(c) for c in columns]
    ours = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=_key)
    theirs = sorted((tuple(r[i] for i in index) for r in expected.fetchall()), key=_key)
    assert len(ours) == len(theirs) > 0
    for a, b in zip(ours, theirs, strict=True):
        assert a == pytest.approx(b) if any(isinstance(v, float) for v in a) else a == b


def test_one_query_per_operator():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES)
    assert numbers == list(range(1, 14))


def test_pipeline_applies_every_decision(spark):
    """Each stage is checked against its operator on what the stage before kept."""
    docs = base.read(spark, SF_DIR, "documents")
    seen = [docs.cache()]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], SF_DIR).cache())
    for df in seen[1:-1]:
        assert df.columns == docs.columns
    model = quality.fit(seen[0], base.read(spark, SF_DIR, "labels"))
    good = {r.doc_id for r in quality.score(seen[0], model).where("keep").collect()}
    assert {r.doc_id for r in seen[1].collect()} == good and 0 < len(good) < docs.count()
    before = {r.doc_id: r.text for r in seen[1].collect()}
    for r in seen[2].collect():
        assert r.n_chars == len(r.text) and set(r.text.split("\n")) <= set(before[r.doc_id].split("\n"))
    groups = jaccard.jaccard_components(seen[2])
    assert sorted(r.doc_id for r in seen[3].collect()) == sorted({r.component_id for r in groups.collect()})
    copies = {r.doc_id: r.copies if r.size else 1 for r in mixing.mix(seen[3]).collect()}
    got = {r["doc_id"]: r["count"] for r in seen[4].groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in copies.items() if v > 0}
    ids = {(r.doc_id, r.n_tokens) for r in bpe.encode(seen[4].select("doc_id", "text"), queries.VOCABULARY).collect()}
    assert {(r.doc_id, r.n_tokens) for r in seen[5].collect()} == ids
    assert seen[5].count() == seen[4].count()


def test_pipeline_of_an_empty_table(spark):
    docs = base.read(spark, SF_DIR, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = base.materialize(stage(spark, docs, SF_DIR))
    assert docs.count() == 0
