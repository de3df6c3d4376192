"""Checking SQL for DuckDB, written independently of the Spark expressions.

Documents are unnested into lines, tokens and characters and aggregated by
relational operators, where the Spark side works inside one row.
"""

from __future__ import annotations

from quillmark.functions import features as Q
from quillmark.functions import text as X
from quillmark.plans.tables import CODE_SQL

WS = r"[\t-\r\x{1c}-\x{20}\x{85}\p{Z}]"
W = r"[\p{L}\p{N}_]"
CHARS = X.WHITESPACE  # as a literal inside trim()

CORPUS = f"""corpus as (
  select doc_id as id, lang as language, source as generator, n_chars, coalesce({CODE_SQL}, '') as code
  from documents)"""

BASE = f"""with {CORPUS},
labelled as (select c.*, l.quality as label from corpus c left join labels l on l.doc_id = c.id),
ln as (
  select id, generate_subscripts(string_split(code, chr(10)), 1) as pos, unnest(string_split(code, chr(10))) as l
  from corpus),
li as (
  select id, pos, l, length(l) as len, length(ltrim(l, '{CHARS}')) as body,
    length(l) - length(ltrim(l, '{CHARS}')) as ind, trim(l, '{CHARS}') as s, rtrim(l, '{CHARS}') as r
  from ln),
nl as (select id, count(*) as n from li group by id),
tl as (select id, regexp_extract_all(lower(code), '{W}+') as ts from corpus),
tk as (select id, generate_subscripts(ts, 1) as pos, unnest(ts) as t from tl),
runs as (
  select id, g, count(*) as k, max(pos) as last from (
    select id, pos, pos - row_number() over (partition by id order by pos) as g from li where body = 0)
  group by id, g),
scored as (
  select c.id, (c.n_chars % 1000)::double / 1000 as score, (c.n_chars * 7 % 500)::double / 500 as score_b,
    (c.id * 37 % 200)::double / 200 as score_c, l.quality as label
  from corpus c join labels l on l.doc_id = c.id)
"""


def _in(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _count(ch: str) -> str:
    return f"(length(code) - length(replace(code, '{ch}', '')))"


IDS = f"""ids as (
  select id, length(t) as k from tk
  where t not in {_in(Q.KEYWORDS)} and not regexp_full_match(t, '{X.DIGITS}+'))"""

# key -> (features, CTEs, body); the body yields id and the features
FEATURE_SQL: dict[str, tuple[list[str], str, str]] = {
    "feat_lines": (
        ["n_lines", "avg_line_len", "std_line_len", "max_line_len", "line_len_variance"], "",
        """select id, count(*)::double as n_lines, avg(len) as avg_line_len, stddev_pop(len) as std_line_len,
             max(len)::double as max_line_len, var_pop(len) as line_len_variance from li group by id"""),
    "feat_indent": (
        ["avg_indent", "std_indent", "max_indent", "max_nesting_depth", "exact_indent_ratio"], "",
        """select id, coalesce(avg(ind) filter (body > 0), 0) as avg_indent,
             coalesce(stddev_pop(ind) filter (body > 0), 0) as std_indent,
             coalesce(max(ind) filter (body > 0), 0)::double as max_indent,
             (coalesce(max(ind) filter (body > 0), 0) // 4)::double as max_nesting_depth,
             (count(*) filter (ind % 4 = 0))::double / count(*) as exact_indent_ratio from li group by id"""),
    "feat_gaps": (
        ["max_consec_empty", "empty_gap_mean", "empty_gap_std"], "",
        """select nl.id, coalesce(max(k), 0)::double as max_consec_empty,
             coalesce(avg(k) filter (last < n), 0) as empty_gap_mean,
             coalesce(stddev_pop(k) filter (last < n), 0) as empty_gap_std
           from nl left join runs on runs.id = nl.id group by nl.id"""),
    "feat_whitespace": (
        ["space_ratio", "tab_ratio", "empty_ratio", "code_len"], "",
        f"""select c.id, {_count(' ')}::double / greatest(length(code), 1) as space_ratio,
             {_count(chr(9))}::double / greatest(length(code), 1) as tab_ratio,
             e.r as empty_ratio, length(code)::double as code_len
           from corpus c join (select id, (count(*) filter (body = 0))::double / count(*) as r from li group by id) e
             on e.id = c.id"""),
    "feat_brackets": (
        ["n_open_paren", "n_close_paren", "n_open_brace", "n_close_brace", "total_bracket_imbalance"], "",
        f"""select id, {_count('(')}::double as n_open_paren, {_count(')')}::double as n_close_paren,
             {_count('{')}::double as n_open_brace, {_count('}')}::double as n_close_brace,
             (abs({_count('(')} - {_count(')')}) + abs({_count('{')} - {_count('}')})
              + abs({_count('[')} - {_count(']')}))::double as total_bracket_imbalance from corpus"""),
    "feat_tokens": (
        ["n_tokens", "unique_tokens", "token_unique_ratio", "keyword_ratio", "func_def_density", "import_density"],
        f"""tc as (select id, count(*) as n, count(distinct t) as u,
              count(*) filter (t in {_in(Q.KEYWORDS)}) as kw, count(*) filter (t in {_in(Q.FUNCTION_WORDS)}) as fn,
              count(*) filter (t in {_in(Q.IMPORT_WORDS)}) as im from tk group by id)""",
        """select nl.id, greatest(coalesce(tc.n, 0), 1)::double as n_tokens, coalesce(u, 0)::double as unique_tokens,
             coalesce(u::double / tc.n, 0) as token_unique_ratio, coalesce(kw::double / tc.n, 0) as keyword_ratio,
             coalesce(fn, 0)::double / nl.n as func_def_density, coalesce(im, 0)::double / nl.n as import_density
           from nl left join tc on tc.id = nl.id"""),
    "feat_identifiers": (
        ["avg_id_len", "id_len_std", "single_char_ratio", "long_id_ratio"], IDS,
        """select nl.id, coalesce(avg(k), 0) as avg_id_len, coalesce(stddev_pop(k), 0) as id_len_std,
             coalesce((count(*) filter (k = 1))::double / nullif(count(k), 0), 0) as single_char_ratio,
             coalesce((count(*) filter (k > 15))::double / nullif(count(k), 0), 0) as long_id_ratio
           from nl left join ids on ids.id = nl.id group by nl.id"""),
    "feat_operators": (
        ["operator_spacing_ratio", "n_semicolons", "n_colons"], "",
        f"""select c.id,
             len(regexp_extract_all(code, '{WS}{Q.OPERATOR_CLASS}{WS}'))::double
               / (len(regexp_extract_all(code, '{Q.OPERATOR_CLASS}')) + 1) as operator_spacing_ratio,
             {_count(';')}::double / n as n_semicolons, {_count(':')}::double / n as n_colons
           from corpus c join nl on nl.id = c.id"""),
    "feat_comment_lines": (
        ["comment_ratio", "avg_comment_words", "max_comment_words"],
        rf"""cl as (select id, len(regexp_extract_all(s, '{W}+')) as k from li
              where regexp_matches(s, '^(//|#|/\*|\*)'))""",
        """select nl.id, count(k)::double / any_value(n) as comment_ratio, coalesce(avg(k), 0) as avg_comment_words,
             coalesce(max(k), 0)::double as max_comment_words
           from nl left join cl on cl.id = nl.id group by nl.id"""),
    "feat_percentiles": (
        ["line_len_p25", "line_len_iqr"], "",
        """select id, quantile_cont(len, 0.25)::double as line_len_p25,
             (quantile_cont(len, 0.75) - quantile_cont(len, 0.25))::double as line_len_iqr from li group by id"""),
    "feat_line_autocorr": (
        ["lag1_autocorr"],
        "pr as (select id, len::double as x, lead(len::double) over (partition by id order by pos) as y from li)",
        """select id, case when count(*) > 2 and var_pop(x) filter (y is not null) > 0 and var_pop(y) > 0
             then corr(x, y) filter (y is not null) else 0 end as lag1_autocorr from pr group by id"""),
    "feat_indent_delta": (
        ["indent_delta_entropy", "most_common_delta_ratio"],
        """dl as (select id, abs(ind - lag(ind) over (partition by id order by pos)) as d from li),
           dc as (select id, d, count(*)::double as c from dl where d is not null group by id, d)""",
        """select nl.id, coalesce(log2(sum(c)) - sum(c * log2(c)) / sum(c), 0) as indent_delta_entropy,
             coalesce(max(c) / sum(c), 0) as most_common_delta_ratio
           from nl left join dc on dc.id = nl.id group by nl.id"""),
    "feat_dup_lines": (
        ["duplicate_line_ratio"], "",
        """select id, (greatest(count(*) filter (body > 0), 1) - count(distinct r) filter (body > 0))::double
             / greatest(count(*) filter (body > 0), 1) as duplicate_line_ratio from li group by id"""),
    "feat_bigrams": (
        ["bigram_repetition_ratio"],
        """bg as (select id, t as a, lead(t) over (partition by id order by pos) as b from tk),
           bc as (select id, a, b, count(*) as c from bg where b is not null group by id, a, b)""",
        """select nl.id, coalesce((count(*) filter (c > 1))::double / nullif(count(c), 0), 0) as bigram_repetition_ratio
           from nl left join bc on bc.id = nl.id group by nl.id"""),
    "feat_char_entropy": (
        ["entropy"],
        """ch as (select id, unnest(regexp_extract_all(code, '(?s).')) as x from corpus),
           cc as (select id, x, count(*)::double as c from ch group by id, x)""",
        """select nl.id, coalesce(log2(sum(c)) - sum(c * log2(c)) / sum(c), 0) as entropy
           from nl left join cc on cc.id = nl.id group by nl.id"""),
    "feat_type_hints": (
        ["type_hint_density"], "",
        f"""select c.id, len(regexp_extract_all(code, ':{WS}*{W}+|<{W}+>|->{WS}*{W}+'))::double / n as type_hint_density
           from corpus c join nl on nl.id = c.id"""),
    "feat_comment_text_ratio": (
        ["n_single_comments", "text_comment_ratio"],
        f"""raw as (
             select id, unnest(regexp_extract_all(code, '(?://|#)(.*)', 1)) as c, 1 as single from corpus
             union all
             select id, case when b like '/*%' then substr(b, 3, length(b) - 4) else substr(b, 4, length(b) - 6) end, 0
             from (select id, unnest(regexp_extract_all(code, '(?s)/\\*.*?\\*/|""\".*?""\"|''''''.*?''''''')) as b from corpus)),
           judged as (
             select id, single, trim(c, '{CHARS}') as c,
               regexp_matches(trim(c, '{CHARS}'), '{Q.CODE_COMMENT_SIGNS}|else:|(?:{"|".join(Q.CODE_COMMENT_WORDS)}){WS}') as is_code
             from raw)""",
        """select nl.id, coalesce(sum(single), 0)::double as n_single_comments,
             coalesce((count(*) filter (c <> '' and not is_code))::double / nullif(count(*) filter (c <> ''), 0), 0) as text_comment_ratio
           from nl left join judged on judged.id = nl.id group by nl.id"""),
    "feat_token_entropy": (
        ["token_entropy"],
        f"""ct as (select id, unnest(regexp_extract_all(code, '{W}+')) as t from corpus),
           cn as (select id, t, count(*)::double as c from ct group by id, t)""",
        """select nl.id, coalesce(log2(sum(c)) - sum(c * log2(c)) / sum(c), 0) as token_entropy
           from nl left join cn on cn.id = nl.id group by nl.id"""),
    "feat_style_counts": (
        ["line_count", "char_count", "avg_line_length", "max_line_length", "line_length_std", "blank_line_ratio",
         "trailing_whitespace_ratio", "indentation_variance"],
        "",
        """select li.id, count(*)::double + 1 as line_count, any_value(length(code))::double + 1 as char_count,
             (any_value(length(code))::double + 1) / (count(*) + 1) as avg_line_length, max(len)::double as max_line_length,
             stddev_pop(len) as line_length_std,
             (count(*) filter (body = 0))::double / (count(*) + 1) as blank_line_ratio,
             (count(*) filter (body > 0 and (l like '% ' or l like concat('%', chr(9)))))::double / (count(*) + 1) as trailing_whitespace_ratio,
             coalesce(var_pop(len - length(ltrim(l, concat(' ', chr(9))))) filter (body > 0), 0) as indentation_variance
           from li join corpus c on c.id = li.id group by li.id"""),
    "feat_style_symbols": (
        ["camel_case_density", "snake_case_density", "alphanumeric_ratio", "operator_density", "logic_density",
         "comment_density", "brace_balance", "paren_balance", "bracket_balance"],
        "",
        rf"""select c.id,
             len(regexp_extract_all(code, '[a-z]+[A-Z][a-z]+'))::double / (length(code) + 1) as camel_case_density,
             len(regexp_extract_all(code, '[a-z]+_[a-z]+'))::double / (length(code) + 1) as snake_case_density,
             len(regexp_extract_all(code, '[\p{{L}}\p{{N}}]'))::double / (length(code) + 1) as alphanumeric_ratio,
             len(regexp_extract_all(code, '[+\-*/%=><]'))::double / (length(code) + 1) as operator_density,
             len(regexp_extract_all(code, '&&|\|\||==|!=|>=|<='))::double / (length(code) + 1) as logic_density,
             len(regexp_extract_all(code, '//|#|/\*|""\"|'''''''))::double / (n + 1) as comment_density,
             abs({_count('{')} - {_count('}')})::double as brace_balance,
             abs({_count('(')} - {_count(')')})::double as paren_balance,
             abs({_count('[')} - {_count(']')})::double as bracket_balance
           from corpus c join nl on nl.id = c.id"""),
}

# Sums of logarithms, deviations and correlations agree to many digits but not
# bit by bit; they are rounded on both sides, everything else is compared as is.
ROUNDED = {
    "std_line_len", "line_len_variance", "std_indent", "empty_gap_std", "id_len_std", "entropy", "char_entropy",
    "token_entropy", "indent_delta_entropy", "lag1_autocorr", "line_length_std", "indentation_variance",
}


def shown(name: str) -> str:
    return f"round({name}, 6) + 0.0 as {name}" if name in ROUNDED else name


def feature_sql(key: str) -> str:
    names, ctes, body = FEATURE_SQL[key]
    extra = f",\n{ctes}" if ctes else ""
    return f"{BASE}{extra},\nout as ({body})\nselect id, {', '.join(shown(n) for n in names)} from out"


def wide_sql(names: list[str], tail: str = "") -> str:
    """Join the feature groups that cover ``names``; ``tail`` replaces the final select."""
    owner = {f: k for k, (fs, _, _) in FEATURE_SQL.items() for f in fs}
    owner["char_entropy"] = "feat_char_entropy"
    keys = sorted({owner[n] for n in names})
    parts = [FEATURE_SQL[k][1] for k in keys if FEATURE_SQL[k][1]]
    parts += [f"g_{k} as ({FEATURE_SQL[k][2]})" for k in keys]
    source = "entropy as char_entropy" if "char_entropy" in names else None
    columns = ", ".join(source if n == "char_entropy" else f"g_{owner[n]}.{n}" for n in names)
    joins = " ".join(f"join g_{k} on g_{k}.id = labelled.id" for k in keys)
    wide = f"wide as (select labelled.id, language, label, {columns} from labelled {joins})"
    final = tail or f"select id, {', '.join(shown(n) for n in names)} from wide"
    return f"{BASE},\n" + ",\n".join([*parts, wide]) + f"\n{final}"
