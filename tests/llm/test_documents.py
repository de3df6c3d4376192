"""The document operators against slow versions, on messy and empty tables."""

import sys
import tracemalloc
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
import helpers as H  # noqa: E402

from quillmark.llm import base, bpe, jaccard, lines, mixing, pretoken, simhash, suffixes, tokenfile  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return H.messy(spark).cache()


@pytest.fixture(scope="module")
def rows():
    return sorted({(r[0], r[1]) for r in H.messy_rows()}, key=lambda r: r[0])


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def empty(spark):
    return spark.createDataFrame([], H.SCHEMA)


# ---- line dedup ---------------------------------------------------------------------------------------------------


def test_line_dedup_matches_all_runs(docs, rows):
    expected = H.cut_lines(rows, lines.MIN_WORDS)
    got = lines.dedup_lines(docs).collect()
    assert len(got) == len(H.messy_rows())
    assert {r.doc_id: r.text or "" for r in got} == expected
    assert all(r.n_chars == len(r.text or "") for r in got)
    assert sum(r.n_removed for r in got) > 0


def test_line_dedup_extends_both_ways_over_short_lines(spark):
    run = ["one two three four five six", "x", "seven eight nine ten eleven twelve"]
    data = [(1, "\n".join(["a b c", *run, "d"])), (2, "\n".join(["q", *run, "r s"])), (3, "\n".join([run[0], run[2]])), (4, run[0])]
    got = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {1: data[0][1], 2: "q\nr s", 3: data[2][1], 4: run[0]}


def test_line_dedup_within_a_document_and_empty(spark):
    line = "a line of rather more than ten words that comes twice here"
    got = lines.dedup_lines(spark.createDataFrame([(1, f"{line}\n\n{line}\nend"), (None, line), (2, None)], "doc_id long, text string"))
    assert {r.doc_id: r.text for r in got.collect()} == {None: line, 1: "\nend", 2: None}
    assert {r.doc_id: r.n_removed for r in got.collect()}[None] == 0
    assert lines.dedup_lines(empty(spark)).count() == 0


# ---- repeated strings ---------------------------------------------------------------------------------------------


def test_repeated_strings_match_brute_force(docs, rows):
    got = suffixes.remove_repeats(docs).select("*", F.sha2("kept", 256).alias("s")).collect()
    assert len(got) == len(H.messy_rows())
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.s) for r in got} == H.repeats(rows)


@pytest.mark.parametrize("seed", range(3))
def test_repeated_strings_on_tangled_texts(spark, seed, monkeypatch):
    import random

    rng = random.Random(seed)
    stems = ["".join(rng.choice("abé😀 \n") for _ in range(300)) for _ in range(4)] + ["a" * 400, "ab" * 200]
    data = []
    for i in range(50):
        text = ""
        for _ in range(rng.randint(0, 4)):
            stem, at = rng.choice(stems), rng.randint(0, 250)
            text += stem[at : at + rng.randint(50, 250)] + rng.choice(["", "x", "yz"])
        data.append((i, text))
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.s) for r in suffixes.remove_repeats(df).select("*", F.sha2("kept", 256).alias("s")).collect()}
    assert got == H.repeats(data)


def test_contexts_do_not_depend_on_pieces():
    raw = np.random.default_rng(1).integers(97, 100, 4000).astype(np.uint8)
    whole = suffixes.contexts(raw)
    assert (whole["first"][0], whole["last"][-1]) == (0, len(raw) - suffixes.LENGTH)
    assert np.array_equal(whole["first"][1:], whole["last"][:-1] + 1)


def test_anchors_travel_in_few_words():
    """A shuffled row has five columns at most; only high bits of the anchor's hash, and what copies don't need, are lost."""
    rng = np.random.default_rng(6)
    n = 200
    copy = rng.random(n) < 0.5
    c = {k: rng.integers(-(1 << 63), 1 << 63, n) for k in ("anchor", "context", "cores")} | {"doc": rng.integers(-9, 1 << 62, n)}
    c |= {"first": rng.integers(0, 1 << 31, n), "lead": rng.integers(0, suffixes.LENGTH - suffixes.ANCHOR + 1, n)}
    c["last"] = c["first"] + np.where(copy, rng.integers(0, 1 << 31, n), rng.integers(0, suffixes.WINDOW, n))
    packed = suffixes._pack_anchors(c, copy)
    assert packed.num_columns == 5 and len(suffixes._ANCHORS.split(",")) == 5 and len(suffixes._SAMPLES.split(",")) == 4
    got = suffixes._unpack_anchors(packed)
    assert got.schema.names == [*suffixes._ROW, "copy"] and got.column("copy").to_pylist() == copy.tolist()
    for k in ("context", "doc", "first", "last"):
        assert got.column(k).to_pylist() == c[k].tolist(), k
    for k in ("cores", "lead"):
        assert got.column(k).to_pylist() == np.where(copy, 0, c[k]).tolist(), k
    assert got.column("anchor").to_pylist() == (c["anchor"] % (1 << 40)).tolist()


def test_sorted_runs_survive_batch_borders():
    """The streaming steps give the same rows however the batches are cut."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    n = 300
    rows = {k: rng.integers(0, m, n) for k, m in (("anchor", 6), ("context", 5), ("doc", 9), ("first", 50))}
    order = np.lexsort((rows["first"], rows["doc"], rows["context"], rows["anchor"]))
    rows = {k: v[order] for k, v in rows.items()} | {"last": np.arange(n), "lead": np.ones(n, int), "cores": np.ones(n, int)}
    batch = pa.RecordBatch.from_arrays([*map(pa.array, rows.values()), pa.array(np.arange(n) >= n - 40)], names=[*rows, "copy"])

    def result(cuts):
        parts = [batch.slice(a, b - a) for a, b in zip([0, *cuts], [*cuts, n], strict=True)]
        return sorted(map(str, pa.Table.from_batches(list(suffixes._copies_and_rivals(iter(parts)))).to_pylist()))

    whole = result([])
    assert whole and all(result(sorted(rng.choice(n, k, replace=False))) == whole for k in (1, 5, 40, 150))


def test_repeated_strings_on_repeated_and_missing_keys(spark):
    text = "".join(chr(97 + i % 26) * (1 + i % 3) for i in range(120))
    data = [(1, text), (1, text), (1, text + "!"), (None, text), (2, None), (2, "")]
    got = suffixes.remove_repeats(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_removed > 0) for r in got) == [(0, False), (1, True), (1, True), (1, True), (2, False), (2, False)]
    assert suffixes.remove_repeats(empty(spark)).count() == 0


# ---- BPE and token files ------------------------------------------------------------------------------------------


def test_pieces_are_the_librarys(library):
    import random

    rng = random.Random(1)
    alphabet = " \n\t'sdtrevml  aZ9é½€中😀 ́!-_|\x85\xa0Ᲊ՘࢏"
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))
        assert pretoken.split(text) == [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]


def test_ids_are_the_librarys(docs, library):
    for most in (0, 50, bpe.LEXICON_WORDS):
        got = bpe.decode(bpe.encode(docs.drop("ids"), PATH, most=most), PATH).collect()
        assert len(got) == len(H.messy_rows())
        for r in got:
            ids = library.encode(r.text or "", add_special_tokens=False).ids
            assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids)
            assert r.decoded == library.decode(ids, skip_special_tokens=False) == (r.text or "")


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 900, "the" * 400, " " * 700, "é" * 300, "!?" * 99 + "==" * 50])
def test_long_words_merge_exactly(library, text):
    vocabulary = bpe.Vocabulary.parse(open(PATH, encoding="utf-8").read())
    assert [i for w in pretoken.split(text) for i in vocabulary.merge(w.encode())] == library.encode(text, add_special_tokens=False).ids


def test_lexicon_is_minimal_and_exact():
    vocabulary = bpe.Vocabulary.parse(open(PATH, encoding="utf-8").read())
    words = [a + b for a in (b" walk", b" talk", b" jump", b"x") for b in (b"", b"s", b"ed", b"ing")]
    lexicon = bpe.Lexicon.memory_map(bpe.compile_lexicon(words, vocabulary).dump())
    numbers = lexicon.look_up([*words, b" wal", b"", b" walkings", b"zzz"])
    assert numbers.tolist()[-4:] == [-1] * 4
    assert sorted(numbers.tolist()[:-4]) == list(range(len(words)))
    for word, k in zip(words, numbers.tolist(), strict=False):
        assert lexicon.ids[lexicon.starts[k] : lexicon.starts[k + 1]].tolist() == vocabulary.merge(word)
    # stems end in one shared state with the endings s, ed, ing: far fewer states than prefixes
    assert len(lexicon.accepts) < 25
    assert bpe.compile_lexicon([], vocabulary).look_up([b"a"]).tolist() == [-1]


def test_encoding_an_empty_table(spark):
    assert bpe.decode(bpe.encode(empty(spark), PATH), PATH).count() == 0


def test_packing_round_trips():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1000):
        values = (rng.integers(0, 1 << 32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        control, data = tokenfile.pack(values)
        assert len(control) == (n + 3) // 4
        assert np.array_equal(tokenfile.unpack(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n), values)


def test_packing_holds_few_bytes_an_id():
    rng = np.random.default_rng(0)
    counts = rng.integers(1, 2000, 300)
    values = np.minimum(rng.pareto(0.6, counts.sum()) * 20, 50_256).astype(np.uint32)
    peaks = []
    tracemalloc.start()
    packed = tokenfile.pack_all(values, counts)
    peaks.append(tracemalloc.get_traced_memory()[1])
    control, data = (np.frombuffer(b"".join(x), np.uint8) for x in zip(*packed, strict=True))
    tracemalloc.reset_peak()
    held = tracemalloc.get_traced_memory()[0]
    assert np.array_equal(tokenfile.unpack_all(control, data, counts), values)
    peaks.append(tracemalloc.get_traced_memory()[1] - held)
    tracemalloc.stop()
    assert max(peaks) < 32 * len(values)


def test_packing_of_several_runs_and_widths():
    rng = np.random.default_rng(1)
    for largest in (0, 0xFF, 0x100, 0xFFFF, 0x10000, 0xFFFFFF, 0x1000000, 0xFFFFFFFF):
        counts = np.array([0, 5, 1, 0, 0, 7, 4, 3, 2, 0])
        values = np.append(rng.integers(0, largest, counts.sum() - 1, endpoint=True), largest).astype(np.uint32)
        packed = tokenfile.pack_all(values, counts)
        parts = np.split(values, np.cumsum(counts)[:-1])
        assert packed == [tokenfile.pack(part) for part in parts]
        control, data = (np.frombuffer(b"".join(x), np.uint8) for x in zip(*packed, strict=True))
        assert len(data) == sum(max(1, (int(v).bit_length() + 7) // 8) for v in values)
        assert np.array_equal(tokenfile.unpack_all(control, data, counts), values)


def test_words_are_spelled_in_the_letters_of_the_vocabulary():
    for point in [*range(0x250), 0x2028, 0x1F600]:
        for word in (chr(point), " " + chr(point), chr(point) + " b"):
            assert tokenfile._spelled(word) == "".join(tokenfile._SPELLING[b] for b in word.encode("utf-8"))


def test_token_file_reads_back(spark, docs, rows, library, monkeypatch):
    monkeypatch.setattr(tokenfile, "RUN_ROWS", 10)
    monkeypatch.setattr(tokenfile, "BLOCK_IDS", 500)
    got = tokenfile.round_trip(docs, PATH).collect()
    texts = sorted(((r[0], r[1]) for r in H.messy_rows()), key=lambda r: r[0])
    start, expected = 0, []
    for i, text in texts:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, tokenfile.END_ID], "<u4").tobytes()
        expected.append((i, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    assert sorted((r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in got) == expected
    assert tokenfile.round_trip(empty(spark), PATH).count() == 0


# ---- mixing -------------------------------------------------------------------------------------------------------


def waterfill(sizes, weights, total, most):
    target, open_sources = {}, set(sizes)
    while True:
        left = total - sum(target.values())
        scale = sum(weights[s] for s in open_sources)
        over = {s for s in open_sources if left * weights[s] / scale > most * sizes[s]} if scale else set()
        if not over:
            return target | {s: left * weights[s] / scale for s in open_sources}
        target |= {s: most * sizes[s] for s in over}
        open_sources -= over


def test_mix_meets_targets(docs):
    data = H.messy_rows()
    sizes: dict = {}
    for r in data:
        sizes[r[3]] = sizes.get(r[3], 0) + len(H.words(r[1]))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = waterfill(sizes, {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values()), 2)
    got = mixing.mix(docs.drop("size")).collect()
    assert len(got) == len(data)
    by_target: dict = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        by_target.setdefault((r.source_size, round(r.target, 6)), []).append(r.taken)
    expected = sorted((sizes[s], round(t)) for s, t in target.items())
    assert sorted((s, sum(v)) for (s, _), v in by_target.items()) == expected


def test_mix_does_not_depend_on_partitions(docs):
    runs = [sorted((r.doc_id, r.size, r.taken) for r in mixing.mix(docs.drop("size").repartition(k)).collect()) for k in (1, 7)]
    assert runs[0] == runs[1]


def test_inclusion_follows_document_weights(spark):
    data = [(i, "w " * 10, "only") for i in range(4000)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    favour = F.when(F.col("doc_id") % 4 == 0, 3.0).otherwise(1.0)
    got = mixing.mix(df, share=0.25, favour=favour).groupBy((F.col("doc_id") % 4 == 0).alias("favoured")).agg(F.avg(F.col("taken") / F.col("size")).alias("rate"), F.sum("taken").alias("words")).collect()
    rate = {r.favoured: r.rate for r in got}
    assert sum(r.words for r in got) == 10_000
    assert rate[True] == pytest.approx(0.5, abs=0.03) and rate[False] == pytest.approx(1 / 6, abs=0.02)


def test_mix_of_nothing(spark):
    assert mixing.mix(empty(spark)).count() == 0
    none = spark.createDataFrame([(1, None, None, None, 0), (2, "", "a", "s", 0)], H.SCHEMA)
    assert [(r.size, r.taken) for r in mixing.mix(none).collect()] == [(0, 0), (0, 0)]
    assert mixing.mixed_documents(none).count() == 2


# ---- fingerprints -------------------------------------------------------------------------------------------------


def test_fingerprints_and_edited_texts(docs, monkeypatch):
    monkeypatch.setattr(simhash, "RUN_ROWS", 9)
    got = simhash.edit_check(docs).collect()
    data = sorted(((r[0], r[1] or "") for r in H.messy_rows()))
    assert len(got) == len(data)
    expected = []
    for k, (i, text) in enumerate(data):
        following, quarter = data[(k + 1) % len(data)][1], len(text) // 4
        edited = text[: len(text) - quarter] + following[:quarter]
        expected.append((i, len(text), H.sha(edited.encode())))
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == sorted(expected)
    prints = {r.doc_id: r.fingerprint for r in got}
    texts = dict(data)
    for a in texts:
        for b in texts:
            if texts[a] == texts[b]:
                assert prints[a] == prints[b]
    long = [r for r in got if r.n_chars > 300]
    assert np.mean([r.near_edited for r in long]) > np.mean([r.near_next for r in long]) + 0.1
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_votes_match_a_plain_count(spark):
    hashes = np.random.default_rng(3).integers(-(1 << 63), (1 << 63) - 1, 37).tolist()
    df = spark.createDataFrame([(1, hashes), (2, []), (3, hashes[:1])], "k long, terms array<long>")
    got = {r.k: r.fingerprint for r in simhash.fingerprints(df, ["k"]).collect()}
    bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert got == {1: bits - (1 << 64) if bits >> 63 else bits, 2: 0, 3: hashes[0]}


def test_block_tables_find_everything_within_the_radius(spark):
    rng = np.random.default_rng(4)
    some = rng.integers(-(1 << 63), (1 << 63) - 1, 40)
    flips = [int(x) ^ sum(1 << int(b) for b in rng.choice(63, int(k), replace=False)) for x in some for k in rng.integers(0, 6, 4)]
    every = sorted({*some.tolist(), *flips})
    df = spark.createDataFrame([(x,) for x in [*every, every[0]]], "fingerprint long")
    asked = spark.createDataFrame([(int(x),) for x in some], "fingerprint long")
    got = sorted((r.query, r.fingerprint, r.distance) for r in simhash.within_radius(asked, df).collect())
    expected = sorted((int(q), f, d) for q in set(some.tolist()) for f in every if (d := bin((q ^ f) & ((1 << 64) - 1)).count("1")) <= simhash.RADIUS)
    assert got == expected


def test_fingerprints_of_few_rows(spark):
    assert simhash.edit_check(empty(spark)).count() == 0
    one = simhash.edit_check(spark.createDataFrame([(None, "abcdefgh")], "doc_id long, text string")).first()
    assert (one.doc_id, one.n_chars, one.edited_sha256, one.near_next) == (None, 8, H.sha(b"abcdefab"), 1.0)


# ---- Jaccard join -------------------------------------------------------------------------------------------------


def test_components_match_all_pairs(docs, rows):
    got = jaccard.jaccard_components(docs).collect()
    assert len(got) == len(H.messy_rows())
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == H.components(rows)


@pytest.mark.parametrize(("common", "paired", "block"), [(2, 0, 7), (12, 0, 500), (12, 32, 256)])
def test_components_of_a_large_near_copy_group(spark, monkeypatch, common, paired, block):
    import random

    for name, value in (("COMMON", common), ("PAIRED", paired), ("BLOCK", block)):
        monkeypatch.setattr(jaccard, name, value)
    rng = random.Random(common)
    stem = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    data = []
    for i in range(120):
        words = list(stem)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        data.append((i, " ".join(words[: rng.randint(90, 120)])))
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()}
    expected = H.components(data)
    assert got == expected and 1 < len({c for _, c in expected.values()}) < 120


def test_a_large_component_is_not_joined_with_itself(spark):
    group = [(1, i, 100, 0, 0) for i in range(3000)] + [(1, 5000, 100, 5000, 0), (1, -7, 100, -7, 0), (1, 6000, 10, 6000, 0)]
    few = spark.createDataFrame(group, "token long, node long, n long, c long, top long")
    pairs = jaccard._open_pairs(few, 80)
    got = sorted(map(tuple, pairs.collect()))
    assert got == sorted([(i, 5000) for i in range(3000)] + [(-7, i) for i in range(3000)] + [(-7, 5000)])
    # the side that is joined with the group holds the strangers alone
    assert sorted(r.node for r in jaccard._strangers(few).collect()) == [-7, 5000, 6000]


def test_prefixes_meet_in_every_order():
    from quillmark.llm.shingles import similar

    rng = np.random.default_rng(5)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 62, rng.integers(1, 60)).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.93], rng.integers(0, 1 << 62, rng.integers(0, 6)).astype(np.uint64)]))
        if len(b) and similar(a, b):
            common = np.sort(rng.choice(a, len(a) // 2, replace=False))
            for order in (0, *jaccard.MORE_ORDERS):
                assert np.intersect1d(jaccard.ordered_prefix(a, common, order), jaccard.ordered_prefix(b, common, order)).size


def test_token_runs_survive_batch_borders():
    import pyarrow as pa

    rng = np.random.default_rng(6)
    n = 400
    token = np.sort(rng.integers(0, 150, n))
    rows = [token, np.arange(n), rng.integers(1, 9, n)]
    batch = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], names=["token", "node", "n"])
    expected = [(t, i, rows[2][i], np.flatnonzero(token == t)[0], rows[2][np.flatnonzero(token == t)[0]]) for i, t in enumerate(token) if (token == t).sum() > 1]
    for k in (0, 1, 7, 60, 250):
        cuts = sorted(rng.choice(n, k, replace=False))
        parts = [batch.slice(a, b - a) for a, b in zip([0, *cuts], [*cuts, n], strict=True)]
        got = [tuple(r.values()) for b in jaccard._runs(iter(parts)) for r in b.to_pylist()]
        assert sorted(got) == sorted(tuple(map(int, x)) for x in expected)


def test_jaccard_of_nothing_and_one_of_each(spark, docs, rows):
    assert jaccard.jaccard_components(empty(spark)).count() == 0
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in H.components(rows).values()})


@pytest.mark.parametrize("partitions", [1, 7])
def test_one_of_each_keeps_texts_that_share_a_key(spark, partitions):
    words = [[f"t{t}w{i}" for i in range(60)] for t in range(8)]
    near = words[0][:-1] + ["other"]
    data = [(None, " ".join(words[t])) for t in (1, 2, 3)]  # three texts without a key, two of them like no other
    data += [(1, " ".join(words[0])), (5, " ".join(near)), (5, " ".join(words[4])), (6, " ".join(words[5])), (6, " ".join(words[6]))]
    data += [(9, " ".join(words[3])), (7, ""), (7, " ".join(words[7])), (None, ""), (None, None)]
    data += [data[0], data[6]]
    for order in (data, data[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string").repartition(partitions)
        got = [(r.doc_id, r.text or "") for r in jaccard.one_of_each(df).collect()]
        lost = {(None, data[2][1]), (5, " ".join(near))}  # near copies of 9 and of 1
        assert len(got) == len(set(got)) and set(got) == {(k, t or "") for k, t in data} - lost


def test_connected_components(spark):
    edges = [(5, 4), (4, 3), (9, 8), (3, 1), (7, 7), (None, 2), (20, 21), (21, 22), (22, 23), (23, 24), (24, 25), (25, 26)]
    got = {r.node: r.component for r in base.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {1: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8} | {k: 20 for k in range(20, 27)}
    assert base.components(spark.createDataFrame([], "src long, dst long")).count() == 0
