"""Document features as a graph of column expressions.

Every entry of :data:`BASES` and :data:`FEATURES` names the columns it reads.
``add_features`` takes the requested names, pulls in what they depend on and
emits one projection per dependency level, so shared work (lines, tokens,
sorted characters) is computed once per document and nothing unused is built.
The whole extraction is a chain of projections: map-only, no shuffle, no UDF.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions import arrays as A
from quillmark.functions import text as X

# ---------------------------------------------------------------- fixed values
KEYWORDS = (
    "if", "else", "for", "while", "return", "def", "class", "function", "var", "let", "const", "int", "string",
    "import", "from", "include", "using", "new", "public", "private", "static", "void", "true", "false", "null",
    "try", "catch", "throw", "switch", "case", "break", "continue",
)
FUNCTION_WORDS = ("def", "function", "void", "func", "fn", "sub", "proc")
IMPORT_WORDS = ("import", "from", "include", "require", "using", "use", "extern")
COMMENT_PREFIXES = ["//", "#", "/*", "*"]
OPERATOR_CLASS = r"[+\-*/%=<>!&|^~]"
CODE_COMMENT_WORDS = ("def", "class", "for", "while", "if", "elif", "return", "import", "from")
CODE_COMMENT_SIGNS = r"[={}()\[\];]"
BLOCK_COMMENTS = "/\\*.*?\\*/|\"\"\".*?\"\"\"|'''.*?'''"
COMMENT_OPENERS = "//|#|/\\*|\"\"\"|'''"
LOGIC_OPERATORS = r"&&|\|\||==|!=|>=|<="
TYPE_HINTS = rf":{X.WS}*+{X.WORD}++|<{X.WORD}++>|->{X.WS}*+{X.WORD}++"

BASE9 = [
    "avg_line_len", "std_line_len", "avg_indent", "std_indent", "max_indent",
    "empty_gap_std", "empty_gap_mean", "n_single_comments", "text_comment_ratio",
]
LAYOUT47 = [
    "n_lines", "avg_line_len", "std_line_len", "max_line_len", "avg_indent", "std_indent",
    "max_indent", "space_ratio", "tab_ratio", "n_open_paren", "n_close_paren", "n_open_brace",
    "n_close_brace", "keyword_ratio", "comment_ratio", "empty_ratio", "entropy",
    "token_unique_ratio", "avg_id_len", "n_semicolons", "n_colons", "code_len", "n_tokens",
    "unique_tokens", "max_nesting_depth", "single_char_ratio", "operator_spacing_ratio",
    "line_len_variance", "avg_comment_words", "max_comment_words", "func_def_density",
    "long_id_ratio", "duplicate_line_ratio", "max_consec_empty", "bigram_repetition_ratio",
    "import_density", "total_bracket_imbalance", "line_len_p25", "line_len_iqr",
    "indent_delta_entropy", "most_common_delta_ratio", "empty_gap_std", "empty_gap_mean",
    "id_len_std", "lag1_autocorr", "exact_indent_ratio", "type_hint_density",
]
_DENSITY_ONLY = {
    "n_open_paren", "n_close_paren", "n_open_brace", "n_close_brace", "n_semicolons",
    "n_colons", "import_density", "exact_indent_ratio", "type_hint_density",
}
MASK38 = [f for f in LAYOUT47 if f not in _DENSITY_ONLY]
SET36 = [f for f in MASK38 if f not in {"max_line_len", "total_bracket_imbalance"}]
SET35 = [f for f in MASK38 if f not in {"n_lines", "code_len", "n_tokens"}]
STYLE19 = [
    "line_count", "char_count", "avg_line_length", "max_line_length", "line_length_std",
    "blank_line_ratio", "trailing_whitespace_ratio", "indentation_variance",
    "camel_case_density", "snake_case_density", "alphanumeric_ratio", "operator_density",
    "logic_density", "comment_density", "brace_balance", "paren_balance", "bracket_balance",
    "char_entropy", "token_entropy",
]
PRESETS = {
    "BASE9": BASE9, "LAYOUT47": LAYOUT47, "MASK38": MASK38,
    "SET36": SET36, "SET35": SET35, "STYLE19": STYLE19,
}
VIEWS = {
    "structure": ["avg_line_len", "std_line_len"],
    "indent_style": ["avg_indent", "std_indent", "max_indent", "empty_gap_std", "empty_gap_mean"],
}
INACTIVE_VIEWS = {
    "vocab_syntax": ["keyword_ratio", "comment_ratio", "unique_tokens", "single_char_ratio"],
}



def _starting(chars: str, alternatives: str) -> str:
    """The same alternatives behind a look-ahead for their first characters.

    Most positions are then rejected by one class test instead of one attempt
    per alternative.
    """
    return f"(?=[{chars}])(?:{alternatives})"


_CODE_COMMENT = (
    f"{CODE_COMMENT_SIGNS}|"
    + _starting("cdefirw", f"else:|(?:{'|'.join(CODE_COMMENT_WORDS)}){X.WS}")
)
# Signs that any feature counts one by one, kept in order; everything else is
# cut away first so that the single counts run over a short string.
_SIGNS = r"\t(){}\[\];:+\-*/%=<>!&|^~"

Builder = Callable[..., Column]
BASES: dict[str, tuple[list[str], Builder]] = {}
FEATURES: dict[str, tuple[list[str], Builder]] = {}


def _base(name: str, *deps: str):
    def register(fn: Builder) -> Builder:
        BASES[name] = (list(deps), fn)
        return fn

    return register


def _feature(name: str, deps: Sequence[str], fn: Builder) -> None:
    FEATURES[name] = (list(deps), fn)


def _size(a: Column) -> Column:
    return F.size(a).cast("double")


def _count_in(tokens: Column, vocabulary: Iterable[str]) -> Column:
    values = list(vocabulary)
    return _size(F.filter(tokens, lambda t: t.isin(values)))


# ---------------------------------------------------------------- shared bases
@_base("lines", "code")
def _lines(code):
    return F.split(code, "\n")


@_base("lens", "lines")
def _lens(lines):
    return F.transform(lines, lambda l: F.length(l).cast("double"))


@_base("bodies", "lines")
def _bodies(lines):
    # length left after removing leading whitespace: 0 means a blank line
    return F.transform(lines, lambda l: F.length(X.lstrip(l)).cast("double"))


@_base("n", "lines")
def _n(lines):
    return _size(lines)


@_base("len_sum", "lens")
def _len_sum(lens):
    return A.total(lens)


@_base("len_sq", "lens")
def _len_sq(lens):
    return A.total_sq(lens)


@_base("sorted_lens", "lens")
def _sorted_lens(lens):
    return F.sort_array(lens)


@_base("margins", "lens", "bodies")
def _margins(lens, bodies):
    # indentation of every line, blank ones included
    return F.zip_with(lens, bodies, lambda a, b: a - b)


@_base("indents", "lens", "bodies")
def _indents(lens, bodies):
    # indentation of the lines that hold text; -1 marks blank lines
    marked = F.zip_with(lens, bodies, lambda a, b: F.when(b > 0, a - b).otherwise(F.lit(-1.0)))
    return F.filter(marked, lambda x: x >= 0)


@_base("n_text_lines", "indents")
def _n_text_lines(indents):
    return _size(indents)


@_base("indent_sum", "indents")
def _indent_sum(indents):
    return A.total(indents)


@_base("indent_sq", "indents")
def _indent_sq(indents):
    return A.total_sq(indents)


@_base("blank_flags", "bodies")
def _blank_flags(bodies):
    # one character per line turns runs of blank lines into a text problem
    return F.array_join(F.transform(bodies, lambda b: F.when(b > 0, "0").otherwise("1")), "")


@_base("gaps", "blank_flags")
def _gaps(flags):
    # a run that reaches the end of the text is not a gap; the look-behind and
    # the possessive quantifier keep the scan linear on such a run
    runs = F.regexp_extract_all(flags, F.lit("(?<!1)(1++)0"), F.lit(1))
    return F.transform(runs, lambda r: F.length(r).cast("double"))


@_base("gap_n", "gaps")
def _gap_n(gaps):
    return _size(gaps)


@_base("gap_sum", "gaps")
def _gap_sum(gaps):
    return A.total(gaps)


@_base("gap_sq", "gaps")
def _gap_sq(gaps):
    return A.total_sq(gaps)


@_base("text_lines", "lines")
def _text_lines(lines):
    return F.filter(F.transform(lines, X.rstrip), lambda l: l != "")


@_base("steps", "margins", "n")
def _steps(margins, n):
    return A.steps(margins, n)


@_base("sorted_steps", "steps")
def _sorted_steps(s):
    return F.sort_array(s)


@_base("step_starts", "sorted_steps")
def _step_starts(s):
    return A.run_starts(s)


@_base("step_counts", "step_starts", "n")
def _step_counts(starts, n):
    return A.run_lengths(starts, n - 1)


@_base("comment_lines", "lines")
def _comment_lines(lines):
    def opens(s):
        hit = F.startswith(s, F.lit(COMMENT_PREFIXES[0]))
        for prefix in COMMENT_PREFIXES[1:]:
            hit = hit | F.startswith(s, F.lit(prefix))
        return hit

    return F.filter(F.transform(lines, X.strip), opens)


@_base("comment_words", "comment_lines")
def _comment_words(comment_lines):
    return F.transform(comment_lines, lambda c: X.n_matches(c, f"{X.WORD}+"))


@_base("tokens", "code")
def _tokens(code):
    return X.words(F.lower(code))


@_base("token_n", "tokens")
def _token_n(tokens):
    return _size(tokens)


@_base("distinct_n", "tokens")
def _distinct_n(tokens):
    return _size(F.array_distinct(tokens))


@_base("id_lens", "tokens")
def _id_lens(tokens):
    # Only a token that starts below "a" or beyond ASCII can be all digits, so
    # the regular expression is skipped for nearly every token.
    def all_digits(t):
        return ((t < "a") | (t > "~")) & t.rlike(f"^{X.DIGITS}+$")

    names = F.filter(tokens, lambda t: ~t.isin(*KEYWORDS) & ~all_digits(t))
    return F.transform(names, lambda t: F.length(t).cast("double"))


@_base("id_n", "id_lens")
def _id_n(id_lens):
    return _size(id_lens)


@_base("id_sum", "id_lens")
def _id_sum(id_lens):
    return A.total(id_lens)


@_base("id_sq", "id_lens")
def _id_sq(id_lens):
    return A.total_sq(id_lens)


@_base("sorted_pairs", "tokens")
def _sorted_pairs(tokens):
    m = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.sort_array(
        F.transform(
            F.slice(tokens, F.lit(1), m),
            lambda t, i: F.concat(t, F.lit(" "), F.get(tokens, i + 1)),
        )
    )


@_base("pair_starts", "sorted_pairs")
def _pair_starts(s):
    return A.run_starts(s)


@_base("pair_counts", "pair_starts", "sorted_pairs")
def _pair_counts(starts, pairs):
    return A.run_lengths(starts, _size(pairs))


@_base("sorted_cased", "code")
def _sorted_cased(code):
    return F.sort_array(X.words(code))


@_base("cased_starts", "sorted_cased")
def _cased_starts(s):
    return A.run_starts(s)


@_base("cased_counts", "cased_starts", "sorted_cased")
def _cased_counts(starts, tokens):
    return A.run_lengths(starts, _size(tokens))


@_base("char_counts", "code")
def _char_counts(code):
    return A.char_counts(code)


@_base("chars", "code")
def _chars(code):
    return F.length(code).cast("double")


@_base("signs", "code")
def _signs(code):
    return F.regexp_replace(code, f"[^{_SIGNS}]+", "")


@_base("operators", "signs")
def _operators(signs):
    return X.n_in_class(signs, r"[\t(){}\[\];:]+")


@_base("line_comments", "code")
def _line_comments(code):
    # (?d): only a newline ends the comment, not \r or the Unicode separators
    return F.regexp_extract_all(code, F.lit("(?d)(?=[/#])(?://|#)(.*)"), F.lit(1))


@_base("block_comments", "code")
def _block_comments(code):
    return F.regexp_extract_all(code, F.lit("(?s)" + _starting("/\"'", BLOCK_COMMENTS)), F.lit(0))


@_base("comment_bodies", "line_comments", "block_comments")
def _comment_bodies(line_comments, block_comments):
    def inner(b):
        width = F.when(F.startswith(b, F.lit("/*")), F.lit(2)).otherwise(F.lit(3))
        return X.strip(F.substr(b, width + 1, F.length(b) - width * 2))

    both = F.concat(F.transform(line_comments, X.strip), F.transform(block_comments, inner))
    return F.filter(both, lambda c: c != "")


@_base("prose_comments", "comment_bodies")
def _prose_comments(bodies):
    return _size(F.filter(bodies, lambda c: ~c.rlike(_CODE_COMMENT)))


@_base("tab_indents", "lines", "bodies")
def _tab_indents(lines, bodies):
    # spaces and tabs only, which is narrower than the other indentation
    marked = F.zip_with(
        lines,
        bodies,
        lambda l, b: F.when(
            b > 0, (F.length(l) - F.length(F.ltrim(l, F.lit(" \t")))).cast("double")
        ).otherwise(F.lit(-1.0)),
    )
    return F.filter(marked, lambda x: x >= 0)


@_base("tab_indent_sum", "tab_indents")
def _tab_indent_sum(a):
    return A.total(a)


@_base("tab_indent_sq", "tab_indents")
def _tab_indent_sq(a):
    return A.total_sq(a)


@_base("lag_product", "lens", "n")
def _lag_product(lens, n):
    return A.neighbour_product(lens, n)


# ------------------------------------------------------ layout and lexical set
_LINE_SUMS = ["n", "len_sum", "len_sq"]
_INDENT_SUMS = ["n_text_lines", "indent_sum", "indent_sq"]
_GAP_SUMS = ["gap_n", "gap_sum", "gap_sq"]


def _max0(a: Column) -> Column:
    return F.coalesce(F.array_max(a), F.lit(0.0))


def _blank_count(flags: Column) -> Column:
    return X.n_char(flags, "1")


def _imbalance(signs: Column) -> Column:
    pairs = [("(", ")"), ("{", "}"), ("[", "]")]
    parts = [F.abs(X.n_char(signs, o) - X.n_char(signs, c)) for o, c in pairs]
    return parts[0] + parts[1] + parts[2]


def _self_correlation(lens, n, s1, s2, sxy):
    first, last = F.get(lens, F.lit(0)), F.element_at(lens, -1)
    m = n - 1.0
    sx, sy = s1 - last, s1 - first
    vx = m * (s2 - last * last) - sx * sx
    vy = m * (s2 - first * first) - sy * sy
    usable = (n > 2) & (vx > 0) & (vy > 0)
    spread = F.when(usable, F.sqrt(vx) * F.sqrt(vy)).otherwise(F.lit(1.0))
    return F.when(usable, (m * sxy - sx * sy) / spread).otherwise(F.lit(0.0))


_feature("n_lines", ["n"], lambda n: n)
_feature("avg_line_len", ["n", "len_sum"], A.mean_of)
_feature("std_line_len", _LINE_SUMS, A.std_of)
_feature("line_len_variance", _LINE_SUMS, A.var_of)
_feature("max_line_len", ["lens"], F.array_max)
_feature("avg_indent", ["n_text_lines", "indent_sum"], A.mean_of)
_feature("std_indent", _INDENT_SUMS, A.std_of)
_feature("max_indent", ["indents"], _max0)
_feature("max_nesting_depth", ["indents"], lambda a: F.floor(_max0(a) / 4).cast("double"))
_feature("space_ratio", ["code", "chars"], lambda c, n: X.n_char(c, " ") / F.greatest(n, F.lit(1.0)))
_feature("tab_ratio", ["signs", "chars"], lambda c, n: X.n_char(c, "\t") / F.greatest(n, F.lit(1.0)))
_feature("n_open_paren", ["signs"], lambda c: X.n_char(c, "("))
_feature("n_close_paren", ["signs"], lambda c: X.n_char(c, ")"))
_feature("n_open_brace", ["signs"], lambda c: X.n_char(c, "{"))
_feature("n_close_brace", ["signs"], lambda c: X.n_char(c, "}"))
_feature("total_bracket_imbalance", ["signs"], _imbalance)
_feature("n_tokens", ["token_n"], lambda n: F.greatest(n, F.lit(1.0)))
_feature("unique_tokens", ["distinct_n"], lambda n: n)
_feature("token_unique_ratio", ["distinct_n", "token_n"], A.ratio)
_feature("keyword_ratio", ["tokens", "token_n"], lambda t, n: A.ratio(_count_in(t, KEYWORDS), n))
_feature("func_def_density", ["tokens", "n"], lambda t, n: _count_in(t, FUNCTION_WORDS) / n)
_feature("import_density", ["tokens", "n"], lambda t, n: _count_in(t, IMPORT_WORDS) / n)
_feature("avg_id_len", ["id_n", "id_sum"], A.mean_of)
_feature("id_len_std", ["id_n", "id_sum", "id_sq"], A.std_of)
_feature("single_char_ratio", ["id_lens", "id_n"],
         lambda a, n: A.ratio(_size(F.filter(a, lambda x: x == 1)), n))
_feature("long_id_ratio", ["id_lens", "id_n"],
         lambda a, n: A.ratio(_size(F.filter(a, lambda x: x > 15)), n))
_feature("bigram_repetition_ratio", ["pair_counts"],
         lambda a: A.ratio(_size(F.filter(a, lambda x: x > 1)), _size(a)))
_feature("comment_ratio", ["comment_lines", "n"], lambda a, n: _size(a) / n)
_feature("avg_comment_words", ["comment_words"], lambda a: A.ratio(A.total(a), _size(a)))
_feature("max_comment_words", ["comment_words"], _max0)
_feature("empty_ratio", ["blank_flags", "n"], lambda f, n: _blank_count(f) / n)
_feature("max_consec_empty", ["blank_flags"], lambda f: _max0(F.transform(
    F.regexp_extract_all(f, F.lit("1+"), F.lit(0)), lambda r: F.length(r).cast("double"))))
_feature("empty_gap_mean", ["gap_n", "gap_sum"], A.mean_of)
_feature("empty_gap_std", _GAP_SUMS, A.std_of)
_feature("entropy", ["char_counts", "chars"], A.entropy)
_feature("n_semicolons", ["signs", "n"], lambda c, n: X.n_char(c, ";") / n)
_feature("n_colons", ["signs", "n"], lambda c, n: X.n_char(c, ":") / n)
_feature("code_len", ["chars"], lambda n: n)
_feature("operator_spacing_ratio", ["code", "operators"],
         lambda c, n: X.n_matches(c, f"{X.WS}{OPERATOR_CLASS}{X.WS}") / (n + 1))
_feature("duplicate_line_ratio", ["text_lines"], lambda a: (
    F.greatest(_size(a), F.lit(1.0)) - _size(F.array_distinct(a))) / F.greatest(_size(a), F.lit(1.0)))
_feature("line_len_p25", ["sorted_lens", "n"], lambda a, n: A.percentile_sorted(a, n, 0.25))
_feature("line_len_iqr", ["sorted_lens", "n"],
         lambda a, n: A.percentile_sorted(a, n, 0.75) - A.percentile_sorted(a, n, 0.25))
_feature("indent_delta_entropy", ["step_counts", "n"], lambda a, n: A.entropy(a, n - 1))
_feature("most_common_delta_ratio", ["step_counts", "n"], lambda a, n: A.ratio(_max0(a), n - 1))
_feature("exact_indent_ratio", ["margins", "n"],
         lambda a, n: _size(F.filter(a, lambda x: x % 4 == 0)) / n)
_feature("lag1_autocorr", ["lens", "n", "len_sum", "len_sq", "lag_product"], _self_correlation)
_feature("type_hint_density", ["code", "n"], lambda c, n: X.n_matches(c, _starting(":<\\-", TYPE_HINTS)) / n)

# ------------------------------------------------------------ comment heuristics
_feature("n_single_comments", ["line_comments"], _size)
_feature("text_comment_ratio", ["prose_comments", "comment_bodies"],
         lambda prose, bodies: A.ratio(prose, _size(bodies)))

# ------------------------------------------------------------------- style set
_feature("line_count", ["n"], lambda n: n + 1)
_feature("char_count", ["chars"], lambda n: n + 1)
_feature("avg_line_length", ["chars", "n"], lambda c, n: (c + 1) / (n + 1))
_feature("max_line_length", ["lens"], F.array_max)
_feature("line_length_std", _LINE_SUMS, A.std_of)
_feature("blank_line_ratio", ["blank_flags", "n"], lambda f, n: _blank_count(f) / (n + 1))
_feature("trailing_whitespace_ratio", ["lines", "bodies", "n"], lambda l, b, n: _size(F.filter(
    F.zip_with(l, b, lambda x, y: (y > 0) & F.right(x, F.lit(1)).isin(" ", "\t")), lambda x: x)) / (n + 1))
_feature("indentation_variance", ["n_text_lines", "tab_indent_sum", "tab_indent_sq"], A.var_of)
# The look-behind only skips starts inside a lower-case run, which can never be
# the leftmost match; it keeps the scan linear on long runs.
_feature("camel_case_density", ["code", "chars"],
         lambda c, n: X.n_matches(c, "(?<![a-z])[a-z]++[A-Z][a-z]++") / (n + 1))
_feature("snake_case_density", ["code", "chars"],
         lambda c, n: X.n_matches(c, "(?<![a-z])[a-z]++_[a-z]++") / (n + 1))
_feature("alphanumeric_ratio", ["code", "chars"],
         lambda c, n: X.n_in_class(c, r"[^\p{L}\p{N}]+") / (n + 1))
_feature("operator_density", ["signs", "chars"],
         lambda c, n: X.n_in_class(c, r"[^+\-*/%=><]+") / (n + 1))
_feature("logic_density", ["code", "chars"], lambda c, n: X.n_matches(c, _starting("&|=!<>", LOGIC_OPERATORS)) / (n + 1))
_feature("comment_density", ["code", "n"], lambda c, n: X.n_matches(c, _starting("/#\"'", COMMENT_OPENERS)) / (n + 1))
_feature("brace_balance", ["signs"], lambda c: F.abs(X.n_char(c, "{") - X.n_char(c, "}")))
_feature("paren_balance", ["signs"], lambda c: F.abs(X.n_char(c, "(") - X.n_char(c, ")")))
_feature("bracket_balance", ["signs"], lambda c: F.abs(X.n_char(c, "[") - X.n_char(c, "]")))
_feature("char_entropy", ["char_counts", "chars"], A.entropy)
_feature("token_entropy", ["cased_counts", "sorted_cased"], lambda a, t: A.entropy(a, _size(t)))


def select_names(names: Iterable[str]) -> list[str]:
    """Known feature names in the order asked for; unknown ones are skipped."""
    seen: dict[str, None] = {}
    for name in names:
        if name in FEATURES:
            seen.setdefault(name)
    return list(seen)


def add_features(
    df: DataFrame,
    names: Iterable[str] | None = None,
    preset: str = "BASE9",
    text: str = "code",
    keep_text: bool = False,
) -> DataFrame:
    """Append one double column per feature.

    ``names`` is an ordered mask; without it the named ``preset`` applies.
    A null text counts as empty.  The text column is dropped unless
    ``keep_text`` is set, so wide text never travels with the features.
    """
    wanted = select_names(PRESETS[preset] if names is None else names)
    mark = "_q_"

    needed: set[str] = set()
    pending = [d for f in wanted for d in FEATURES[f][0]]
    while pending:
        name = pending.pop()
        if name != "code" and name not in needed:
            needed.add(name)
            pending.extend(BASES[name][0])

    def depth(name: str) -> int:
        return 0 if name == "code" else 1 + max(depth(d) for d in BASES[name][0])

    def build(deps: list[str], fn: Builder) -> Column:
        return fn(*[F.col(mark + d) for d in deps])

    carried = [c for c in df.columns if c not in wanted and (keep_text or c != text)]
    out = df.withColumn(mark + "code", F.coalesce(F.col(text), F.lit("")))
    for level in sorted({depth(b) for b in needed}):
        out = out.withColumns(
            {mark + b: build(*BASES[b]) for b in sorted(needed) if depth(b) == level}
        )
    return out.select(
        *[F.col(c) for c in carried],
        *[build(*FEATURES[f]).cast("double").alias(f) for f in wanted],
    )


def align_columns(frames: Sequence[DataFrame], columns: Sequence[str], keep: Sequence[str]) -> list[DataFrame]:
    """Project several frames to the same surviving feature columns."""
    return [f.select(*[k for k in keep if k in f.columns], *columns) for f in frames]


def feature_columns(df: DataFrame, metadata: Sequence[str] = ("ID", "id", "code", "generator", "label", "language")) -> list[str]:
    """All columns but the metadata ones."""
    return [c for c in df.columns if c not in metadata]


def view_columns(views: dict[str, list[str]], available: Iterable[str]) -> dict[str, list[str]]:
    """Views restricted to surviving columns; views left empty are dropped."""
    alive = set(available)
    cut = {v: [c for c in cols if c in alive] for v, cols in views.items()}
    return {v: cols for v, cols in cut.items() if cols}
