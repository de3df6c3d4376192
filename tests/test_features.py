"""Edge snippets with values worked out by hand from the feature rules."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmark.functions import features as Q
from quillmark.functions import text as X

CASES = [
    ("", {"n_lines": 1, "n_tokens": 1, "duplicate_line_ratio": 1.0, "entropy": 0, "line_count": 2, "char_count": 1,
          "empty_ratio": 1, "max_consec_empty": 1, "empty_gap_mean": 0, "lag1_autocorr": 0}),
    (None, {"n_lines": 1, "code_len": 0, "duplicate_line_ratio": 1.0}),
    ("a\n", {"n_lines": 2, "avg_line_len": 0.5, "line_len_p25": 0.25, "line_len_iqr": 0.5, "entropy": 1}),
    ("x = 1 # c\r\n\t y", {"n_single_comments": 1, "text_comment_ratio": 1, "max_indent": 2, "avg_indent": 1,
                           "max_line_len": 10, "tab_ratio": 1 / 14}),
    ("\n\n\nx\n\n", {"empty_gap_mean": 3, "empty_gap_std": 0, "max_consec_empty": 3, "n_lines": 6}),
    ("\nx\n\n\ny\n", {"empty_gap_mean": 1.5, "empty_gap_std": 0.5, "max_consec_empty": 2}),
    ("é_1 ½ ² 😀a b", {"n_tokens": 5, "code_len": 12, "avg_id_len": 1.5, "single_char_ratio": 0.75}),
    ("nai\u0308ve \u200d x", {"n_tokens": 3}),
    ("#\n# \n//http://a #b", {"n_single_comments": 3, "text_comment_ratio": 1, "comment_ratio": 1}),
    ("/* a\nb */ '''q''' \"\"\"r\"\"\"", {"n_single_comments": 0, "text_comment_ratio": 1}),
    ("/* x = 1; // y */", {"n_single_comments": 1, "text_comment_ratio": 0.5}),
    ("# motif x", {"text_comment_ratio": 0}),
    ("a + b+c == d", {"operator_spacing_ratio": 1 / 5, "logic_density": 1 / 13}),
    ("def f(x: int) -> str:\n    return x", {"type_hint_density": 1.5, "func_def_density": 0.5, "keyword_ratio": 3 / 7,
                                              "max_nesting_depth": 1, "exact_indent_ratio": 1, "most_common_delta_ratio": 1}),
    ("a b a b a b", {"bigram_repetition_ratio": 1, "token_unique_ratio": 1 / 3, "token_entropy": 1}),
    ("a b c a b", {"bigram_repetition_ratio": 1 / 3}),
    ("x\nx\nx \n", {"duplicate_line_ratio": 2 / 3, "trailing_whitespace_ratio": 1 / 5}),
    ("aa\nb\naa\nb", {"lag1_autocorr": -1, "std_line_len": 0.5}),
    ("ab\ncd\nef", {"lag1_autocorr": 0, "line_len_variance": 0}),
    ("fooBar foo_bar fooBarBaz", {"camel_case_density": 2 / 25, "snake_case_density": 1 / 25}),
    ("(({[", {"n_open_paren": 2, "n_open_brace": 1, "total_bracket_imbalance": 4, "brace_balance": 1}),
    ("\u3000a", {"avg_indent": 1, "indentation_variance": 0}),
    ("if ①②: x12 345", {"avg_id_len": 3}),
    ("a\n  b\n    c", {"indent_delta_entropy": 0, "avg_indent": 2}),
    ("a\n  b\nc\n    d", {"indent_delta_entropy": pytest.approx(0.9182958), "most_common_delta_ratio": pytest.approx(2 / 3)}),
    ("int_ " + "x" * 16, {"long_id_ratio": 0.5}),
    ("import a\nfrom b", {"import_density": 1, "n_colons": 0}),
    ("a;b:\nc;", {"n_semicolons": 1, "n_colons": 0.5}),
    ("* a b\n# c", {"avg_comment_words": 1.5, "max_comment_words": 2, "comment_ratio": 1}),
]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(CASES)], "id long, code string")
    return {r["id"]: r for r in Q.add_features(df, Q.FEATURES).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_snippets(rows, i):
    for name, expected in CASES[i][1].items():
        assert rows[i][name] == pytest.approx(expected), (CASES[i][0], name)


def test_presets_and_masks(spark):
    assert [len(Q.PRESETS[p]) for p in ("BASE9", "LAYOUT47", "MASK38", "SET36", "SET35", "STYLE19")] == [9, 47, 38, 36, 35, 19]
    assert all(f in Q.FEATURES for names in Q.PRESETS.values() for f in names)
    df = spark.createDataFrame([(1, "x")], "id long, code string")
    out = Q.add_features(df, ["tab_ratio", "nope", "n_lines", "tab_ratio"])
    assert out.columns == ["id", "tab_ratio", "n_lines"]
    assert Q.add_features(df, ["n_lines"], keep_text=True).columns == ["id", "code", "n_lines"]
    assert Q.view_columns(Q.VIEWS, ["avg_line_len"]) == {"structure": ["avg_line_len"]}
    assert Q.feature_columns(out) == ["tab_ratio", "n_lines"]


def test_whitespace_matches_unicode():
    assert set(X.WHITESPACE) == {chr(i) for i in range(0x110000) if chr(i).isspace()}


def test_extraction_does_not_shuffle(spark):
    df = spark.createDataFrame([(1, "x")], "id long, code string")
    plan = Q.add_features(df, Q.FEATURES)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def _counts(items):
    out = {}
    for x in items:
        out[x] = out.get(x, 0) + 1
    return out


@settings(max_examples=2, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab_é# /*\n\t;=('😀1²", max_size=40), min_size=60, max_size=60))
def test_properties(spark, texts):
    import math

    df = spark.createDataFrame(list(enumerate(texts)), "id long, code string")
    wide = Q.add_features(df, Q.FEATURES)
    again = {r["id"]: r for r in Q.add_features(df.repartition(3, F.rand(1)), Q.FEATURES).collect()}
    ratios = [f for f in Q.FEATURES if f.endswith("_ratio") and f not in ("operator_spacing_ratio",)]
    for r in wide.collect():
        assert r == again[r["id"]]
        code = texts[r["id"]]
        for f in ratios:
            assert 0.0 <= r[f] <= 1.0, (f, code)
        assert r["entropy"] <= math.log2(max(len(set(code)), 1)) + 1e-9
        n = len(code)
        assert r["entropy"] == pytest.approx(-sum(c / n * math.log2(c / n) for c in _counts(code).values()) if n else 0, abs=1e-9)
        assert r["n_lines"] == code.count("\n") + 1
        lead = [len(x) - len(x.lstrip()) for x in code.split("\n") if x.strip()]
        assert r["max_indent"] == max(lead, default=0)


def test_long_documents_stay_linear(spark):
    import time

    texts = ["x" + "\n" * 200_000, "a" * 300_000, " " * 300_000 + "x", "ab " * 100_000, "/" * 200_000, '"' * 200_001]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, code string")
    start = time.time()
    rows = {r["id"]: r for r in Q.add_features(df, Q.FEATURES).collect()}
    assert time.time() - start < 90
    assert rows[0]["max_consec_empty"] == 200_000 and rows[0]["empty_gap_mean"] == 0
    assert rows[1]["n_tokens"] == 1 and rows[1]["entropy"] == 0
    assert rows[2]["max_indent"] == 300_000
    assert rows[3]["bigram_repetition_ratio"] == 1 and rows[3]["token_entropy"] == 0
    assert rows[4]["n_single_comments"] == 1


def test_most_characters_are_counted_without_sorting(spark):
    """Only what the frequent characters leave over is sorted; the counts are those of every character."""
    from collections import Counter

    from quillmark.functions import arrays

    english = "the quick brown fox jumps over a lazy dog and tells every other dog of the town about it"
    assert sum(c in arrays.COMMON_CHARS for c in english) > 0.9 * len(english)
    texts = ["", " ", "eee", "\n\n\t", "zzz$$(a.b)\\^[", english, "\U0001f600é\U0001f600 ", "Q|Q\x00"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", arrays.char_counts(F.col("t")).alias("n")).collect()
    for r in rows:
        assert sorted(r["n"]) == sorted(Counter(r["t"]).values()), r["t"]


def test_frequent_characters_are_counted_by_bytes(spark):
    """What is left of a text is not walked once more for each frequent character; wide characters count once."""
    from collections import Counter

    from quillmark.functions import arrays

    assert arrays.COMMON_CHARS.isascii()
    texts = ["", None, "zebra tr\u00e9\u00e9e", "\U0001f600a\u4e2d\u4e2d b\U0001f600\U0001f600", "e" * 70_000 + "\u3fff\u4000"]
    counted = spark.createDataFrame([(t,) for t in texts], "t string").select("t", arrays.char_counts(F.col("t")).alias("n"))
    assert "octet_length" in counted._jdf.queryExecution().toString()
    for r in counted.collect():
        if r["t"]:
            found = Counter(r["t"])
            assert r["n"] == [found[c] for c in [*arrays.COMMON_CHARS, *sorted(set(found) - set(arrays.COMMON_CHARS))] if c in found]
