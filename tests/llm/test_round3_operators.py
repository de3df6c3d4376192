"""Toxicity, collocations and the Merkle manifest against plain versions and planted cases."""

import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import helpers
import numpy as np
import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from quillmark.llm import base, collocations, merkle, queries, toxicity


# ---------------------------------------------------------------- collocations
def plain_collocations(rows, support, top=collocations.TOP, share=100):
    counts = defaultdict(lambda: defaultdict(int))
    for lang, text in rows:
        text = helpers.lower_ascii(text or "")
        for c in ".,;:!?\x0b\x0c\r":
            text = text.replace(c, "\n")
        for piece in text.replace("\t", " ").split("\n"):
            w = [x for x in piece.split(" ") if x]
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    counts["und" if lang is None else lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        candidates = {p: c for p, c in f.items() if len(p) > 1 and c >= support}
        covered = {
            p[i : i + k] for p, c in candidates.items() for k in range(2, len(p)) for i in range(len(p) - k + 1)
            if 100 * c >= share * f[p[i : i + k]]
        }
        scored = []
        for p, a in candidates.items():
            if p not in covered:
                s, cut = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-s, -a, " ".join(p).encode(), f[p[:cut]], f[p[cut:]]))
        out += [(lang, i + 1, p.decode(), -a, left, r, n, -s) for i, (s, a, p, left, r) in enumerate(sorted(scored)[:top])]
    return sorted(out)


@pytest.mark.parametrize("support,top", [(2, 2000), (3, 5)])
def test_collocations_equal_plain_counting(spark, support, top):
    df = helpers.messy(spark)
    got = sorted(map(tuple, collocations.collocations(df, support, top).collect()))
    assert got == plain_collocations([(r.lang, r.text) for r in df.collect()], support, top) and got


def test_small_shards_change_nothing(spark, monkeypatch):
    df = helpers.messy(spark)
    whole = sorted(map(tuple, collocations.collocations(df, 4).collect()))
    monkeypatch.setattr(collocations, "SHARD_WORDS", 300)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(map(tuple, collocations.collocations(df.repartition(9), 4).collect())) == whole and whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("support", [2, 3, 40])
def test_phrases_level_by_level(spark, monkeypatch, support):
    """Where shards would report all they hold; before, they did."""
    df = helpers.messy(spark)
    expected = plain_collocations([(r.lang, r.text) for r in df.collect()], support)
    monkeypatch.setattr(collocations, "_local_supports", lambda *_: pytest.fail("shards report all their phrases"))
    monkeypatch.setattr(collocations, "SHARD_WORDS", 100)
    monkeypatch.setattr(collocations, "PIECE_WORDS", 16)
    monkeypatch.setattr(collocations, "LEAST_LOCAL", support)
    assert sorted(map(tuple, collocations.collocations(df.repartition(5), support).collect())) == expected
    # a map whose bits are all set rules nothing out and changes nothing
    monkeypatch.setattr(collocations, "_bitmap", lambda _: b"\xff" * (1 << (collocations.MAP_BITS - 3)))
    assert sorted(map(tuple, collocations.collocations(df, support).collect())) == expected


def test_words_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(collocations.xxhash, "xxh64_intdigest", lambda *_: 7)
    known = collocations.Dictionary(["en", "de", "en"], ["a", "b", "b"])
    part = collocations.Part("en", 9)
    part.add("b c a")
    part.close()
    found = known.numbers(part)
    assert [known.word(n) if n >= 0 else None for n in found.tolist()] == [b"b", None, b"a"]
    assert known.langs[known.own[found[0]]] == "en"


def test_scores_beyond_64_bits(spark):
    phrases = spark.createDataFrame([("en", "a b", 2, 3 * 10**12), ("en", "a", 1, 4 * 10**12), ("en", "b", 1, 5 * 10**12)], "lang string, phrase string, k int, f long")
    totals = spark.createDataFrame([("en", 10**16 + 1)], "lang string, n long")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(collocations, "frequent_phrases", lambda *_: (phrases, totals))
        (row,) = collocations.collocations(phrases).collect()
    assert row.score == 1000 * 3 * 10**12 * (10**16 + 1) // (20 * 10**24)


def test_collocations_of_nothing(spark):
    empty = helpers.messy(spark).limit(0)
    assert collocations.collocations(empty).collect() == []
    assert collocations.collocations(spark.createDataFrame([(None, None), ("", "en")], "text string, lang string")).collect() == []


# --------------------------------------------------------------------- merkle
def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_leaf(r, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)))


def plain_tree(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def plain_path(levels, i):
    out = []
    for level in levels[:-1]:
        s = i - i % 3
        out.append(("".join(level[s:i]), "".join(level[i + 1 : s + 3])))
        i //= 3
    return out


def plain_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        text = r.text
        if r.doc_id is not None and text is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0:
            text = text.replace("\n", "")
        groups[r.source].append((r.doc_id is not None, r.doc_id or 0, plain_leaf(r, r.text), plain_leaf(r, text), r.doc_id))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names}
    top = plain_tree([trees[s][-1][0] for s in names])
    root, out = top[-1][0], []
    for j, s in enumerate(names):
        for i, (_, _, leaf, start, doc_id) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            way = plain_path(trees[s], i) + plain_path(top, j)
            for left, right in way:
                start = h(left + start + right)
            out.append((doc_id, leaf, trees[s][-1][0], root, h("".join(a + b for a, b in way)), start, start == root))
    return sorted(out, key=str)


def tables(spark):
    yield helpers.messy(spark)
    yield spark.createDataFrame([(5, None, None, None, None)], helpers.SCHEMA)
    # two rounds of slot arrays in a hot group, sparse and negative ids, null and repeated ids with other texts
    yield spark.range(-1500, 4500).selectExpr(
        "case when id % 500 = 7 then null when id % 400 = 9 then 11 else id * 98765 end as doc_id",
        "case when id % 3 <> 0 then 'hot' when id % 31 = 0 then null else concat('s', id % 5) end as source",
        "cast(null as string) as lang", "id as n_chars", "case when id % 9 = 0 then null else concat('a\n', id % 700) end as text")


def test_manifest_equals_plain_version(spark):
    for df in tables(spark):
        assert sorted(map(tuple, merkle.tamper_check(df).collect()), key=str) == plain_manifest(df.collect())


def test_manifest_of_many_groups(spark, monkeypatch):
    df = spark.range(300).selectExpr("id as doc_id", "concat('s', id % 120) as source", "'en' as lang", "1L as n_chars", "'x\n' as text")
    monkeypatch.setattr(merkle, "BROADCAST_GROUPS", 10)
    monkeypatch.setattr(merkle, "RANGE_GROUPS", 30)
    assert sorted(map(tuple, merkle.tamper_check(df).collect()), key=str) == plain_manifest(df.collect())


def test_manifest_of_nothing_and_general_columns(spark):
    assert merkle.tamper_check(helpers.messy(spark).limit(0)).collect() == []
    df = spark.range(10).select(F.col("id").alias("k"), (F.col("id") % 2).alias("g"), F.lit("v").alias("path"))
    rows = merkle.manifest(df, "k", "g", ["k", "path"])
    assert rows.columns == ["k", "g", "leaf", "subroot", "root", "path"]
    good = rows.where(merkle.fold(F.col("leaf"), F.col("path")) == F.col("root"))
    assert good.count() == 10


# ------------------------------------------------------------------- toxicity
@pytest.fixture(scope="module")
def decoder(spark):
    words = "idiot stupid moron the of and clown tree house green hello apple letter little table after water paper never other summer".split()
    rng = random.Random(4)
    text = " ".join(rng.choice(words) for _ in range(4000))
    return toxicity.Decoder(toxicity.costs(toxicity.count_symbols([text])))


def test_symbol_counts_and_costs():
    texts = ["Idiot, the é-x", "", "a"]
    counts = defaultdict(int)
    letters = ["idiot", "the", "e", "x", "a"]
    stream = "".join("..." + w for w in letters) + "."
    for i in range(len(stream) - 3):
        code = 0
        for c in stream[i : i + 4]:
            code = code * 27 + (0 if c == "." else ord(c) - 96)
        counts[code] += 1
    got = toxicity.count_symbols(texts)
    assert {int(i): int(got[i]) for i in np.flatnonzero(got)} == dict(counts)
    assert np.allclose(np.exp(-toxicity.costs(got)).sum(axis=1), 1.0)


@pytest.mark.parametrize("hidden,word", [
    ("1d10t", "idiot"), ("i.d.i.o.t", "idiot"), ("IDIOT!!", "idiot"), ("idiooooot", "idiot"), ("st*pid", "stupid"), ("m0r0n", "moron"),
    ("cl0wn$", None), ("ｉｄｉｏｔ", "idiot"), ("hello", "hello"), ("lettér", "letter"), ("\"idiot\"", "idiot"),
])
def test_restored_tokens(decoder, hidden, word):
    got = decoder.restore(f"the {hidden} of")
    assert got[0] == "the" and got[-1] == "of" and (word is None or got[1:-1] == [word])


def test_spelled_words(decoder):
    assert decoder.restore("the i d i o t of") == ["the", "idiot", "of"]
    assert decoder.restore("s-t-u-p-i-d") == ["stupid"]
    assert decoder.restore("中文 идиот 12 !!") == ["中文", "идиот", "12"]
    assert decoder.restore("") == []


def test_viterbi_equals_all_readings(decoder):
    """The cheapest of all readings, listed one by one."""
    def all_costs(token):
        runs = [(k, len(list(g))) for k, g in itertools.groupby(token)]
        best = None
        for choice in itertools.product(*(decoder._options(c, n, False) for c, n in runs)):
            total, at = sum(p for _, p in choice), 0
            for letters, _ in choice:
                if letters == " ":
                    total, at = (total + decoder.cost[at][0], 0) if at else (total, 0)
                else:
                    for c in letters:
                        total += decoder.cost[at][ord(c) - 96]
                        at = (at * 27 + ord(c) - 96) % 27**3
            total += decoder.cost[at][0] if at else 0
            read = (total, "".join(x for x, _ in choice))
            best = read if best is None else min(best, read)
        return best[1].split()

    for token in ("1d10t", "st00p1d", "a.b", "mo-ron", "tt1!", "l3tt3r", "cl0*n"):
        assert decoder.viterbi(token).split() == all_costs(token), token


def test_held_out_rows_teach_nothing(spark):
    docs, labels = base.read(spark, SF_DIR, "documents"), base.read(spark, SF_DIR, "labels")
    model = toxicity.fit(docs, labels)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.fit(docs, flipped)
    assert model.weights == again.weights and model.intercept == again.intercept


def test_scores_on_held_out_documents(spark):
    sf = SF_DIR.replace("sf0.001", "sf0.01")
    scored = queries.QUERIES["op11_toxicity"](spark, sf)
    assert scored.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = scored.join(base.read(spark, sf, "labels"), "doc_id", "left").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    unseen = [r for r in rows if r.held_out and r.toxic is not None]
    clean = [r for r in unseen if r.toxic == 0]
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean)
    ranks = {id(r): i for i, r in enumerate(sorted(unseen, key=lambda r: r.score))}
    toxic = [r for r in unseen if r.toxic == 1]
    auc = (sum(ranks[id(r)] for r in toxic) - len(toxic) * (len(toxic) - 1) / 2) / (len(toxic) * len(clean))
    assert auc > 0.8


def test_hidden_insults_are_caught(spark):
    clean = [f"the green tree of house {i} and the apple after water {i * 7}" for i in range(300)]
    # one insult a document: where two always come together, neither has to carry the verdict alone
    rows = [(i, f"{t} {('idiot', 'moron')[i % 2]} near" if i % 3 == 0 else f"{t} near", i % 3 == 0) for i, t in enumerate(clean)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, None, int(x)) for i, _, x in rows], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    new = spark.createDataFrame(
        [(1, "the tree 1d10t house"), (2, "the m.o.r.o.n tree"), (3, "tree i d i o t"), (4, "the green tree"), (5, None), (6, ""), (7, "tree " * 200_000)],
        "doc_id long, text string")
    got = {r.doc_id: r.predicted for r in toxicity.score(new, model).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 0, 5: 0, 6: 0, 7: 0}


def test_toxicity_edges(spark):
    df = helpers.messy(spark)
    labels = spark.createDataFrame([(None, 1, 1), (8, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, labels)
    out = toxicity.score(df.withColumn("score", F.lit(3)).withColumn("predicted", F.lit("x")), model)
    assert out.count() == df.count() and set(df.columns) < set(out.columns)
    assert {r.predicted for r in out.collect()} == {0}
    assert toxicity.score(df.limit(0), model).collect() == []
    assert toxicity.fit(df.limit(0), labels).weights == {}
    shown = toxicity.restored(df, model.cost).where("text is null or text = ''").collect()
    assert {r.restored for r in shown} == {""}
