"""Top-k search, language identification and the quality classifier."""

import math
import random
import sys
from pathlib import Path

import numpy as np
import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import helpers as H  # noqa: E402

from quillmark.llm import base, langid, quality, topk  # noqa: E402


def nearest(rows, ask, top=5):
    """query -> best (id, score), all pairs."""
    fine = [(i, v) for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(v) for _, v in fine), default=0)
    table = {i: [math.floor(256 * c) for c in v] + [0] * (width - len(v)) for i, v in fine}
    out = []
    for q in table:
        if ask(q):
            scores = sorted((-sum(a * b for a, b in zip(table[q], v, strict=True)), i) for i, v in table.items() if i != q)
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:top], 1)]
    return sorted(out)


def rows_of(df):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect())


@pytest.mark.parametrize("blocks", [(2048, 4096, 4), (16, 5, 2)])
def test_top_k_matches_all_pairs(spark, monkeypatch, blocks):
    for name, value in zip(("BLOCK_ROWS", "QUERY_ROWS", "GROUP_BLOCKS"), blocks, strict=True):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(5, 19))
    data = [(int(i), [float(x) for x in centers[i % 5] + rng.normal(size=19) * 0.3]) for i in range(300)]
    data += [(1000 + i, data[i][1]) for i in range(20)]  # ties
    data += [(2000, None), (None, data[0][1]), (2050, [1.0, None]), (2100, [float("nan")] * 19), (2150, [float("inf")] * 19), (2200, [0.5, -0.25]), (2250, [])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).withColumn("block", F.lit(1)).repartition(7)
    assert rows_of(topk.top_k(df, F.col("vec_id") % 50 == 0)) == nearest(data, lambda i: i % 50 == 0)


def test_top_k_of_given_vectors(spark):
    df = base.read(spark, SF_DIR, "embeddings")
    data = [(r.vec_id, r.embedding) for r in df.collect()]
    assert rows_of(topk.top_k(df, F.col("vec_id") % 50 == 0)) == nearest(data, lambda i: i % 50 == 0)


def test_top_k_of_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk.top_k(spark.createDataFrame([], schema), F.lit(True)).count() == 0
    two = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (1, [2.0])], schema)
    assert rows_of(topk.top_k(two, F.col("vec_id") == 0)) == [(0, 1, 1, 131072), (0, 2, 1, 131072)]


@pytest.mark.parametrize("scale", [1.0, 3e4, 1e7, 1e9])
def test_top_k_of_large_components(spark, scale):
    """Whole numbers beyond 2^31 and products beyond 2^53 keep their order and their last digit."""
    rng = np.random.default_rng(int(scale))
    few = 3 if scale > 1e8 else 9
    data = [(int(i), [float(x) for x in rng.normal(size=few) * (scale / 1e5 if scale > 1e8 else scale / 10)]) for i in range(120)]
    data += [(200, [1.0, 1.0]), (201, [2e7, 1.0]), (202, [3e7, 1.0]), (203, [4e7, 1.0]), (250, [0.0, scale]), (260, [1e-3] * few)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(3)
    assert rows_of(topk.top_k(df, F.col("vec_id") % 50 == 0)) == nearest(data, lambda i: i % 50 == 0)


def test_top_k_refuses_what_a_long_cannot_hold(spark):
    with pytest.raises(ValueError):
        topk.inner_products(np.array([[2.0**40]]), np.array([[2.0**40]]))
    assert topk.inner_products(np.array([[2.0**70, 0.0, 5.0]]), np.array([[0.0, 2.0**70, 3.0]])).tolist() == [15]


def test_tags_are_cut_in_one_pass():
    import re
    import time

    rng = random.Random(2)
    for _ in range(300):
        t = "".join(rng.choice("<>ab ") for _ in range(rng.randint(0, 30)))
        assert langid.without_tags(t) == re.sub(r"(?s)<[^>]*>", " ", t)
    start = time.perf_counter()
    assert langid.visible_text("<" * 1_000_000) == "<" * 1_000_000
    langid.visible_text("a<b>" * 300_000)
    langid.visible_text("<script" * 100_000 + "<!--" * 100_000)
    assert time.perf_counter() - start < 3


def test_bounds_hold_and_tighten():
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(30, 37)), rng.normal(size=(40, 37))
    exact = ((a[:, None] - b[None]) ** 2).sum(axis=2)
    lower = []
    for segments in topk.SEGMENTS:
        x, y = topk.segment_table(a, segments), topk.segment_table(b, segments)
        lower.append(((x[:, None] - y[None]) ** 2).sum(axis=2))
        assert (lower[-1] <= exact + 1e-9).all()
    assert lower[0].mean() < lower[1].mean() < lower[2].mean()


# ---- language -----------------------------------------------------------------------------------------------------

WORDS = {"en": "the of and house river with morning", "de": "der und haus fluss mit morgen zwischen", "fr": "le et maison avec matin entre dans"}


def sentence(rng, lang, k):
    return " ".join(rng.choice(WORDS[lang].split()) for _ in range(k))


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(1)
    rows = [(i, sentence(rng, lang, 60), lang) for i, lang in enumerate(list(WORDS) * 30)]
    rows += [(999, None, "en"), (998, "text", None)]
    return langid.fit_text(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_text_alone_on_held_out_documents(spark):
    docs = base.read(spark, SF_DIR, "documents").where("lang is not null and length(text) > 40")
    fitted = langid.fit_text(docs.where("doc_id % 2 = 0"))
    rest = docs.where("doc_id % 2 = 1").select("doc_id", "lang", "text").collect()
    right = sum(fitted.languages[int(np.argmax(fitted.evidence(r.text)))] == r.lang for r in rest)
    assert right >= 0.95 * len(rest)


def test_rare_language_is_in_the_model(spark):
    rng = random.Random(4)
    docs = [(i, sentence(rng, ("en", "de")[i % 50 == 0], 8), ("en", "de")[i % 50 == 0]) for i in range(10_000)]
    docs += [(10_000, sentence(rng, "fr", 60), "fr"), (10_001, None, "xx")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    fitted = [langid.fit_text(df.repartition(n), sample=90) for n in (2, 7)]
    assert fitted[0].languages == ("de", "en", "fr")
    assert np.array_equal(fitted[0].log_p, fitted[1].log_p)
    assert langid.fit_text(df, sample=1).languages == ("de", "en", "fr")
    page = spark.createDataFrame([(1, "https://h.org/", f"<p>{sentence(rng, 'fr', 40)}</p>")], "page_id long, url string, html string")
    assert langid.identify(page, fitted[0]).first().lang == "fr"


def test_evidence_is_fused(spark, model):
    rng = random.Random(2)
    pages = []
    for i in range(60):
        lang = ("en", "de")[i % 2]
        host = {"en": "a.site.org", "de": "b.site.de"}[lang]
        pages.append((i, f"https://{host}/x/{i}", f'<html lang="{lang}"><script>le et maison le</script><p>{sentence(rng, lang, 40)}</p></html>'))
    pages += [
        (100, "https://b.site.de/", ""), (101, None, None), (102, "https://c.new.de/", f"<html><p>{sentence(rng, 'fr', 50)}</p>"),
        (103, "https://a.site.org/", "<html lang=en-GB><p>4711</p></html>"), (104, "x", None), (104, "x", None),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("lang", F.lit("zz")).withColumn("posterior", F.lit(0))
    got = {r.page_id: r for r in langid.identify(df, model).collect()}
    assert langid.identify(df, model).count() == len(pages)
    assert all(got[i].lang == ("en", "de")[i % 2] for i in range(60))
    assert got[100].lang == "de"  # no text: host and suffix decide
    assert got[102].lang == "fr"  # text outweighs the suffix
    assert (got[103].lang, got[103].declared) == ("en", "en")
    assert got[101].declared is None and all(0 < r.confidence <= 1 for r in got.values())


def test_declared_language_settles_a_short_text(spark, model):
    pages = [(i, f"https://h{i}.org/", f'<html lang="fr"><p>{sentence(random.Random(i), "fr", 40)}</p>') for i in range(30)]
    pages += [(100 + i, f"https://g{i}.org/", f'<html lang="en"><p>{sentence(random.Random(i), "en", 40)}</p>') for i in range(90)]
    pages += [(900, "https://new.org/", '<html lang="fr">1</html>'), (901, "https://newer.org/", "<html>1</html>")]
    got = {r.page_id: r.lang for r in langid.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), model).collect()}
    assert (got[900], got[901]) == ("fr", "en")


def test_language_of_nothing(spark, model):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert langid.identify(none, model).count() == 0
    unfitted = langid.fit_text(spark.createDataFrame([], "doc_id long, text string, lang string"))
    one = spark.createDataFrame([(1, "u", "<html lang=en>")], "page_id long, url string, html string")
    assert [tuple(r) for r in langid.identify(one, unfitted).collect()] == [(1, None, None, None, "en")]


def test_markup_and_addresses(spark):
    assert langid.visible_text("<p>a &amp; b<script>x</script><!-- y --> c<style>z").split() == ["a", "&", "b", "c"]
    df = spark.createDataFrame([("https://u@Blog.A.co.uk:80/x",), ("nohost",), (None,)], "url string")
    parts = langid.address(F.col("url"))
    got = [tuple(r) for r in df.select(parts["host"], parts["domain"], parts["suffix"]).collect()]
    assert got == [("blog.a.co.uk", "co.uk", "uk"), ("", "", ""), ("", "", "")]


# ---- quality ------------------------------------------------------------------------------------------------------


def test_quality_on_held_out_documents(spark):
    sf = SF_DIR if SF_DIR.endswith("0.1") else "/root/testdata/sf0.1"
    docs, labels = base.read(spark, sf, "documents").select("doc_id", "text"), base.read(spark, sf, "labels")
    fitted = quality.fit(docs, labels.where("doc_id % 3 <> 0"))
    assert fitted.thresholds[0] < fitted.thresholds[1]
    held_out = quality.score(docs.where("doc_id % 3 = 0").join(quality.grades(labels), "doc_id"), fitted)
    rate = {r.grade: r.rate for r in held_out.groupBy("grade").agg(F.avg(F.col("keep").cast("int")).alias("rate")).collect()}
    assert rate[2] > 0.97 and rate[0] < 0.12 and rate[1] < 0.08
    means = {r.grade: r.e for r in held_out.groupBy("grade").agg(F.avg("expected_grade").alias("e")).collect()}
    assert means[0] < means[1] < means[2]


def test_quality_fit_does_not_depend_on_partitions(spark):
    docs = base.read(spark, SF_DIR, "documents").select("doc_id", "text")
    labels = base.read(spark, SF_DIR, "labels")
    a, b = (quality.fit(docs.repartition(k), labels.repartition(k), epochs=20) for k in (2, 5))
    assert np.array_equal(a.words, b.words) and np.array_equal(a.thresholds, b.thresholds)


def test_quality_of_messy_rows(spark):
    docs = H.messy(spark).withColumn("keep", F.lit("old")).withColumn("grade", F.lit(9))
    labels = spark.createDataFrame([(-20, 1, 0), (-13, 0, None), (-13, 1, 1), (None, 1, 1), (8, None, 0), (8, None, None), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    assert {(r.doc_id, r.grade) for r in quality.grades(labels).collect()} == {(-20, 2), (-13, 0), (9999, 2)}
    scored = quality.score(docs, quality.fit(docs, labels, epochs=5))
    assert scored.count() == len(H.messy_rows()) and scored.columns[-3:] == ["expected_grade", "p_good", "keep"]
    assert scored.where("p_good is null or p_good < 0 or p_good > 1 or expected_grade > 2").count() == 0
    unlabelled = quality.fit(docs, labels.limit(0))
    assert quality.score(docs, unlabelled).where("not keep").count() == 0
    assert quality.score(docs.limit(0), unlabelled).count() == 0


def test_sample_is_bounded_and_balanced(spark):
    docs = spark.createDataFrame([(i, f"w{i} x") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 > 0), int(i % 7 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    counts = {r["grade"]: r["count"] for r in quality.training_rows(docs, labels, 60).groupBy("grade").count().collect()}
    assert counts == {0: 20, 1: 20, 2: 20}
