"""Named queries over the driver's tables, with checking SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import arrays, text
from quillmark.functions import features as Q
from quillmark.operators import ensembles, metrics, ordering, profile, qda, quantile, sampling, scaling, selection, trees
from quillmark.operators.linear import fit_logistic
from quillmark.plans import anomaly, boosting, oracles, rebalanced
from quillmark.plans import tables as D
from quillmark.sources import corpus as C
from quillmark.sources.session import materialize, shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def _rounded(names: Sequence[str]) -> list:
    return [F.round(F.col(n), 6).alias(n) if n in oracles.ROUNDED else F.col(n) for n in names]


# ------------------------------------------------------------------- features
def _feature_query(names: Sequence[str]) -> Query:
    return lambda spark, sf: Q.add_features(D.code(spark, sf), names).select("id", *_rounded(names))


for _key, (_names, _, _) in oracles.FEATURE_SQL.items():
    QUERIES[_key] = _feature_query(_names)
    ORACLES[_key] = oracles.feature_sql(_key)

for _key, _preset in [
    ("feat_base9", "BASE9"), ("feat_layout47", "LAYOUT47"), ("feat_mask38", "MASK38"),
    ("feat_set36", "SET36"), ("feat_set35", "SET35"), ("feat_style19", "STYLE19"),
]:
    QUERIES[_key] = _feature_query(Q.PRESETS[_preset])
    ORACLES[_key] = oracles.wide_sql(Q.PRESETS[_preset])


def _named(names: Sequence[str], spark: SparkSession, sf: str) -> DataFrame:
    return Q.add_features(D.code(spark, sf), names)


@query(
    "feature_means",
    oracles.wide_sql(
        Q.BASE9,
        "select language, label, count(*) as n, "
        + ", ".join(f"round(avg({f}), 6) as {f}" for f in Q.BASE9)
        + " from wide group by language, label",
    ),
)
def feature_means(spark: SparkSession, sf: str) -> DataFrame:
    """Mean feature values per language and label: the flagship query."""
    docs = D.spread(D.table(spark, sf, "documents").select("doc_id", "lang", "text"), "doc_id")
    docs = docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("language"), F.expr(D.CODE_SQL).alias("code"))
    wide = D.with_labels(Q.add_features(docs, Q.BASE9), spark, sf)
    return wide.groupBy("language", "label").agg(
        F.count(F.lit(1)).alias("n"), *[F.round(F.avg(f), 6).alias(f) for f in Q.BASE9]
    )


def _digest(df: DataFrame, *columns: str) -> str:
    """Version of what a cached table is built from: count, sum and xor of a hash of every row."""
    h = F.xxhash64(*columns)
    return "-".join(str(v) for v in df.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(20,0)")), F.bit_xor(h)).first())


def _cached_base(spark: SparkSession, sf: str) -> DataFrame:
    version = _digest(D.table(spark, sf, "documents"), "doc_id", "text")
    path = f"{shared_dir(spark)}/quillmark/feature-cache/{sf.strip('/').replace('/', '-').replace(':', '')}"
    return C.cached(spark, path, f"base9-3-{version}", lambda: _named(Q.BASE9, spark, sf))


@query("feature_cache", oracles.wide_sql(Q.BASE9))
def feature_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Feature table computed once per version; the second call reads what the first one stored."""
    _cached_base(spark, sf)
    return _cached_base(spark, sf).select("id", *_rounded(Q.BASE9))


@query("score_cache", oracles.BASE + " select id, score, score_b, score_c from scored")
def score_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Model scores kept by version, as the anomaly pair is."""
    path = f"{shared_dir(spark)}/quillmark/score-cache/{sf.strip('/').replace('/', '-').replace(':', '')}"
    documents, labels = D.table(spark, sf, "documents"), D.table(spark, sf, "labels")
    version = f"scores-2-{_digest(documents, 'doc_id', 'n_chars')}-{_digest(labels, 'doc_id', 'quality')}"
    build = lambda: D.scores(spark, sf).drop("label")
    C.cached(spark, path, version, build)
    return C.cached(spark, path, version, build)


@query("read_split", "select doc_id, text, n_chars, null::varchar as code, null::varchar as generator, null::varchar as language, null::int as label, lang, source from documents")
def read_split(spark: SparkSession, sf: str) -> DataFrame:
    """A split that lacks the corpus columns reads with nulls in them."""
    return C.read_split(spark, f"{sf}/documents.parquet")


@query("feature_views", oracles.wide_sql([c for v in Q.VIEWS.values() for c in v]))
def feature_views(spark: SparkSession, sf: str) -> DataFrame:
    """Named views cut to the columns that survive the null check."""
    names = [c for v in Q.VIEWS.values() for c in v]
    table = materialize(_named([*names, *Q.INACTIVE_VIEWS["vocab_syntax"]], spark, sf), "views")
    alive = scaling.complete_columns(table, Q.feature_columns(table))
    views = Q.view_columns(Q.VIEWS, alive)
    return table.select("id", *_rounded([c for v in views.values() for c in v]))


# -------------------------------------------------------------------- profile
_INVENTORY = ["documents", "labels", "embeddings", "conversations", "pages", "benchmark"]


@query(
    "inventory_columns",
    "with n as (" + " union all ".join(f"select '{t}' as t, count(*) as n from {t}" for t in _INVENTORY) + ") "
    "select concat(t, '.parquet') as file, 'ok' as status, n as n_rows, "
    "(count(*) over (partition by t))::int as n_columns, column_name as column, "
    "case data_type when 'BIGINT' then 'bigint' when 'INTEGER' then 'int' when 'VARCHAR' then 'string' "
    "when 'FLOAT[]' then 'array<float>' else data_type end as dtype "
    "from duckdb_columns() join n on n.t = table_name "
    "union all select 'absent.parquet', 'missing', null, null, null, null "
    "union all select 'notes.txt', 'unsupported', null, null, null, null",
)
def inventory_columns(spark: SparkSession, sf: str) -> DataFrame:
    paths = [f"{sf}/{t}.parquet" for t in _INVENTORY] + [f"{sf}/absent.parquet", f"{sf}/notes.txt"]
    return profile.inventory(spark, paths)


def _labelled_meta(spark: SparkSession, sf: str) -> DataFrame:
    return D.with_labels(D.corpus(spark, sf).select("id", "language", "generator"), spark, sf)


def _freq_sql(column: str, tail: str = "") -> str:
    return (
        f"{oracles.BASE} select {column} as value, count(*) as count, "
        f"round(count(*) * 100.0::double / sum(count(*)) over (), 2) as percentage{tail}"
    )


@query("dist_label", _freq_sql("label") + " from labelled group by label")
def dist_label(spark: SparkSession, sf: str) -> DataFrame:
    return profile.frequency(_labelled_meta(spark, sf), "label")


@query("dist_language", _freq_sql("language") + " from corpus group by language")
def dist_language(spark: SparkSession, sf: str) -> DataFrame:
    return profile.frequency(D.corpus(spark, sf), "language")


@query(
    "dist_generator_top10",
    _freq_sql("generator", ", greatest(count(*) over () - 10, 0) as n_more")
    + " from corpus group by generator order by count desc, value limit 10",
)
def dist_generator_top10(spark: SparkSession, sf: str) -> DataFrame:
    return profile.frequency(D.corpus(spark, sf), "generator", top=10)


@query(
    "label_share",
    f"{oracles.BASE} select label, count(*) as len, round(count(*)::double / sum(count(*)) over (), 4) as percentage "
    "from labelled where label is not null group by label",
)
def label_share(spark: SparkSession, sf: str) -> DataFrame:
    return profile.share(_labelled_meta(spark, sf).where("label is not null"), "label")


@query(
    "label_share_in_language",
    f"{oracles.BASE} select label as value, count(*) as count, "
    "round(count(*) * 100.0::double / sum(count(*)) over (), 2) as percentage from labelled "
    "where language = 'en' group by label",
)
def label_share_in_language(spark: SparkSession, sf: str) -> DataFrame:
    return profile.frequency(_labelled_meta(spark, sf).where("language = 'en'"), "label")


def _lengths(spark: SparkSession, sf: str) -> DataFrame:
    """line_count and len of every document; two counts, no arrays."""
    return D.code(spark, sf).select(
        "id",
        (text.n_char(F.col("code"), "\n") + 1).cast("bigint").alias("line_count"),
        F.length("code").cast("bigint").alias("len"),
    )


_LENGTHS_SQL = (
    f"{oracles.BASE}, lens as (select id, (length(code) - length(replace(code, chr(10), '')) + 1)::bigint as line_count, "
    "length(code)::bigint as len, label from labelled)"
)


@query(
    "describe_length",
    _LENGTHS_SQL
    + ", u as (select 'len' as feature, len::double as x from lens union all select 'line_count', line_count from lens) "
    "select feature, count(*) as count, round(avg(x), 6) as mean, round(stddev_samp(x), 6) as std, min(x) as min, "
    "round(quantile_cont(x, 0.25), 6) as p25, round(quantile_cont(x, 0.5), 6) as p50, "
    "round(quantile_cont(x, 0.75), 6) as p75, max(x) as max from u group by feature",
)
def describe_length(spark: SparkSession, sf: str) -> DataFrame:
    out = profile.describe(_lengths(spark, sf), ["len", "line_count"])
    return out.select(
        "feature", "count", *[F.round(c, 6).alias(c) for c in ("mean", "std")], "min",
        *[F.round(c, 6).alias(c) for c in ("p25", "p50", "p75")], "max",
    )


@query("longest_doc", _LENGTHS_SQL + " select lens.id, len, label, code from lens join corpus using (id) order by len desc, id limit 1")
def longest_doc(spark: SparkSession, sf: str) -> DataFrame:
    docs = D.code(spark, sf).withColumn("len", F.length("code").cast("bigint"))
    return D.with_labels(profile.argmax_row(docs, "len"), spark, sf).select("id", "len", "label", "code")


def _hist_sql(x: str, width: int, by: str = "") -> str:
    keep = f"{by}, " if by else ""
    return (
        _LENGTHS_SQL + f", m as (select min({x}) as lo from lens), b as (select *, (({x} - lo) // {width})::bigint as bin from lens, m) "
        f"select {keep}bin, count(*) as count, any_value(lo + bin * {width})::double as bin_start from b group by {keep}bin"
    )


@query("hist_length", _hist_sql("len", 250))
def hist_length(spark: SparkSession, sf: str) -> DataFrame:
    return profile.histogram(_lengths(spark, sf), "len", width=250)


@query("hist_line_count", _hist_sql("line_count", 1))
def hist_line_count(spark: SparkSession, sf: str) -> DataFrame:
    return profile.histogram(_lengths(spark, sf), "line_count", width=1)


@query("hist_length_auto", _LENGTHS_SQL + """,
  s as (select min(len) as lo, max(len) as hi, count(*) as n, quantile_cont(len, 0.75) - quantile_cont(len, 0.25) as iqr from lens),
  b as (select *, greatest(1, ceil((hi - lo) / least((hi - lo) / (log2(n) + 1), 2 * iqr / n ** (1.0::double / 3))))::bigint as bins from s)
  select least(floor((len - lo) / ((hi - lo)::double / bins)), bins - 1)::bigint as bin, count(*) as count,
    round(min(lo + least(floor((len - lo) / ((hi - lo)::double / bins)), bins - 1) * ((hi - lo)::double / bins)), 6) as bin_start
  from lens, b group by bin""")
def hist_length_auto(spark: SparkSession, sf: str) -> DataFrame:
    return profile.histogram(_lengths(spark, sf), "len").withColumn("bin_start", F.round("bin_start", 6))


@query("hist2d_length_label", _hist_sql("len", 500, "label"))
def hist2d_length_label(spark: SparkSession, sf: str) -> DataFrame:
    return profile.histogram(D.with_labels(_lengths(spark, sf), spark, sf), "len", by=["label"], width=500)


@query("hist2d_lines_label", _hist_sql("line_count", 1, "label"))
def hist2d_lines_label(spark: SparkSession, sf: str) -> DataFrame:
    return profile.histogram(D.with_labels(_lengths(spark, sf), spark, sf), "line_count", by=["label"], width=1)


@query(
    "density_length",
    _LENGTHS_SQL + """,
  s as (select min(len)::double as lo, max(len)::double as hi, count(*)::double as n,
          stddev_samp(len) * count(*) ** (-0.2::double) as h from lens),
  g as (select k::int as k, lo + (hi - lo) * k / 199 as x from range(200) t(k), s)
  select k, round(x, 6) as x, round(sum(exp(-0.5 * ((x - len) / h) ** 2)) / any_value(n * h * sqrt(2 * pi())) * 1000, 9) as density
  from g, lens, s group by k, x""",
)
def density_length(spark: SparkSession, sf: str) -> DataFrame:
    out = profile.density(_lengths(spark, sf), "len", 200)
    return out.select("k", F.round("x", 6).alias("x"), F.round(F.col("density") * 1000, 9).alias("density"))


# ------------------------------------------------------------------- sampling
_HASH = "md5(concat(cast(id as varchar), '42'))"


@query(
    "undersample_group",
    f"{oracles.BASE} select id, language, label from (select id, language, label, row_number() over "
    f"(partition by language, label order by {_HASH}, id) as r from labelled) where r <= 20",
)
def undersample_group(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.per_group(_labelled_meta(spark, sf), ["language", "label"], 20).select("id", "language", "label")


@query(
    "downsample_language",
    f"""{oracles.BASE}, q as (
      select label, round_even(count(*) * (100.0::double / sum(count(*)) over ()), 0)::bigint as quota
      from labelled where language = 'en' group by label),
    r as (select id, language, label, row_number() over (partition by label order by {_HASH}, id) as r
      from labelled where language = 'en')
    select id, language, r.label from r join q on q.label is not distinct from r.label where r <= quota
    union all select id, language, label from labelled where language <> 'en'""",
)
def downsample_language(spark: SparkSession, sf: str) -> DataFrame:
    meta = _labelled_meta(spark, sf).select("id", "language", "label")
    return sampling.fraction(meta, F.col("language") == "en", 100, ["label"])


@query(
    "stratified_folds",
    f"{oracles.BASE} select id, label, ((row_number() over (partition by label order by {_HASH}, id) - 1) % 5)::int as fold "
    "from labelled where label is not null",
)
def stratified_folds(spark: SparkSession, sf: str) -> DataFrame:
    known = _labelled_meta(spark, sf).select("id", "label").where("label is not null")
    return sampling.folds(known).select("id", "label", "fold")


@query("shuffle_order", f"{oracles.BASE} select id, row_number() over (order by {_HASH}, id) as position from corpus")
def shuffle_order(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.shuffle_position(D.corpus(spark, sf).select("id"))


@query("head_slice", f"{oracles.BASE} select id, language, generator from corpus order by id limit 350")
def head_slice(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.head(D.corpus(spark, sf).select("id", "language", "generator"), 350)


@query("sample_rows", f"{oracles.BASE} select id, language from corpus order by {_HASH}, id limit 100")
def sample_rows(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.sample_rows(D.corpus(spark, sf).select("id", "language"), 100)


# -------------------------------------------------------------------- metrics
def _pred(spark: SparkSession, sf: str) -> DataFrame:
    return selection.at(D.scores(spark, sf), "score", 0.5, "pred")


_CELLS = """, pr as (select *, (score > 0.5)::int as pred from scored),
  c as (select count(*) filter (label = 1 and pred = 1)::double as tp, count(*) filter (label = 0 and pred = 1)::double as fp,
          count(*) filter (label = 1 and pred = 0)::double as fn, count(*) filter (label = 0 and pred = 0)::double as tn from pr),
  k as (select *, tp / nullif(tp + fp, 0) as p1, tp / nullif(tp + fn, 0) as r1, 2 * tp / nullif(2 * tp + fp + fn, 0) as f1,
          tn / nullif(tn + fn, 0) as p0, tn / nullif(tn + fp, 0) as r0, 2 * tn / nullif(2 * tn + fp + fn, 0) as f0,
          tp + fn as s1, tn + fp as s0, tp + fp + fn + tn as n from c)"""
_AUC = """, rk as (select label, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0::double as r from scored),
  au as (select (sum(r) filter (label = 1) - count(*) filter (label = 1) * (count(*) filter (label = 1) + 1) / 2.0::double)
           / (count(*) filter (label = 1)::double * count(*) filter (label = 0)) as auc from rk)"""


@query("confusion", oracles.BASE + """, pr as (select *, (score > 0.5)::int as pred from scored)
  select y::int as label, p::int as pred, count(id) as count from range(2) a(y) cross join range(2) b(p)
  left join pr on pr.label = y and pr.pred = p group by y, p""")
def confusion(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion(_pred(spark, sf))


@query("class_report", oracles.BASE + _CELLS + """
  select class, round(p, 6) as precision, round(r, 6) as recall, round(f, 6) as f1, s::bigint as support from (
    select '0' as class, p0 as p, r0 as r, f0 as f, s0 as s from k union all select '1', p1, r1, f1, s1 from k
    union all select 'accuracy', (tp + tn) / n, (tp + tn) / n, (tp + tn) / n, n from k
    union all select 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n from k
    union all select 'weighted avg', (p0 * s0 + p1 * s1) / n, (r0 * s0 + r1 * s1) / n, (f0 * s0 + f1 * s1) / n, n from k)""")
def class_report(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.report(_pred(spark, sf))
    return out.select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("macro_prf", oracles.BASE + _CELLS + """ select round((tp + tn) / n, 6) as accuracy, round((p0 + p1) / 2, 6) as macro_precision,
  round((r0 + r1) / 2, 6) as macro_recall, round((f0 + f1) / 2, 6) as macro_f1 from k""")
def macro_prf(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.macro(_pred(spark, sf))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("roc_auc", oracles.BASE + _AUC + " select round(auc, 6) as auc from au")
def roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.auc(D.scores(spark, sf)).select(F.round("auc", 6).alias("auc"))


@query("metric_table", oracles.BASE + _CELLS + _AUC + """
  select m as "Metric", round(v, 6) as "Value" from (select 'acc' as m, (tp + tn) / n as v from k
    union all select 'precision (Macro)', (p0 + p1) / 2 from k union all select 'recall (Macro)', (r0 + r1) / 2 from k
    union all select 'f1 (Macro)', (f0 + f1) / 2 from k union all select 'auc', auc from au)""")
def metric_table(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.metric_table(_pred(spark, sf)).withColumn("Value", F.round("Value", 6))


def _sweep_sql(models: Sequence[str], cuts: str) -> str:
    union = " union all ".join(f"select '{m}' as model, {m} as score, label from scored" for m in models)
    return oracles.BASE + f""", long as ({union}), th as (select k::double / 100 as threshold from range({cuts}) t(k)),
    c as (select model, threshold, count(*) filter (label = 1 and score > threshold)::double as tp,
            count(*) filter (label = 0 and score > threshold)::double as fp,
            count(*) filter (label = 1 and score <= threshold)::double as fn,
            count(*) filter (label = 0 and score <= threshold)::double as tn from long, th group by model, threshold),
    sw as (select model, threshold, tp::bigint as tp, fp::bigint as fp, fn::bigint as fn, tn::bigint as tn,
             round((2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2, 6) as macro_f1 from c)"""


@query("threshold_sweep", _sweep_sql(["score"], "10, 90") + " select threshold, tp, fp, fn, tn, macro_f1 from sw")
def threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.sweep(D.scores(spark, sf), ["score"], metrics.FINE)
    return out.select("threshold", "tp", "fp", "fn", "tn", F.round("macro_f1", 6).alias("macro_f1"))


@query("threshold_sweep_nan", oracles.BASE + """, t as (select k / 100.0::double as threshold from range(10, 90) r(k)),
  sn as (select label, case when id % 7 = 0 then null else score end as score from scored)
  select threshold, count(*) filter (label = 1 and coalesce(score, -1) > threshold) as tp, count(*) filter (label = 0 and coalesce(score, -1) > threshold) as fp,
    count(*) filter (label = 1 and coalesce(score, -1) <= threshold) as fn, count(*) filter (label = 0 and coalesce(score, -1) <= threshold) as tn
  from sn, t group by threshold""")
def threshold_sweep_nan(spark: SparkSession, sf: str) -> DataFrame:
    """A NaN score is above no threshold."""
    planted = D.scores(spark, sf).withColumn("score", F.when(F.col("id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("score")))
    return metrics.sweep(planted, ["score"], metrics.FINE).select("threshold", "tp", "fp", "fn", "tn")


@query("best_threshold", _sweep_sql(["score"], "10, 90") + " select threshold, macro_f1 from sw order by macro_f1 desc, threshold limit 1")
def best_threshold(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.best(metrics.sweep(D.scores(spark, sf), ["score"], metrics.FINE))
    return out.select("threshold", F.round("macro_f1", 6).alias("macro_f1"))


_MODELS = ["score", "score_b", "score_c"]


@query("multi_model_sweep", _sweep_sql(_MODELS, "10, 99, 5")
       + " select model, threshold, macro_f1 from sw qualify row_number() over (partition by model order by macro_f1 desc, threshold) = 1")
def multi_model_sweep(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.best(metrics.sweep(D.scores(spark, sf), _MODELS, metrics.COARSE))
    return out.select("model", "threshold", F.round("macro_f1", 6).alias("macro_f1"))


@query("two_threshold_choice", _sweep_sql(["score"], "10, 98") + """,
  b as (select threshold from sw where threshold < 0.9 order by macro_f1 desc, threshold limit 1),
  f as (select s.threshold, s.macro_f1 from sw s where s.threshold = 0.97 or s.threshold = (select threshold from b))
  select threshold, macro_f1, threshold = (case when (select macro_f1 from f where threshold = 0.97) >
    (select macro_f1 from f where threshold <> 0.97) then 0.97 else (select threshold from b) end) as chosen from f""")
def two_threshold_choice(spark: SparkSession, sf: str) -> DataFrame:
    scored = D.scores(spark, sf)
    calibrated = metrics.best(metrics.sweep(scored, ["score"], metrics.FINE)).first()["threshold"]
    out = metrics.better_of_two(scored, "score", calibrated)
    return out.select("threshold", F.round("macro_f1", 6).alias("macro_f1"), "chosen")


@query("prediction_share", oracles.BASE + """ select (score > 0.95)::int as label,
  round(count(*) * 100.0::double / sum(count(*)) over (), 6) as percentage from scored group by 1""")
def prediction_share(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.prediction_share(selection.at(D.scores(spark, sf), "score", 0.95, "pred"))
    return out.withColumn("percentage", F.round("percentage", 6))


# ------------------------------------------------------------------ selection
_NTH = oracles.BASE + """, cut as (select coalesce(
    (select score from scored where (select count(*) from scored) > 100 order by score desc limit 1 offset 99),
    (select min(score) - 1 from scored)) as c)"""


@query("topn_threshold", _NTH + " select c as threshold from cut")
def topn_threshold(spark: SparkSession, sf: str) -> DataFrame:
    cut = selection.top_threshold(D.scores(spark, sf), "score", 100)
    return spark.range(1).select(F.lit(cut).alias("threshold"))


@query("topn_labels", _NTH + " select id, (score > c)::int as label from scored, cut")
def topn_labels(spark: SparkSession, sf: str) -> DataFrame:
    return selection.top_n(D.scores(spark, sf).drop("label"), "score", 100).select("id", "label")


@query("topn_labels_fill", _NTH + """ select id, (score > c or (score = c and row_number() over
  (partition by score = c order by md5(concat(cast(id as varchar), '123456')), id)
  <= 100 - (select count(*) from scored, cut where score > c)))::int as label from scored, cut""")
def topn_labels_fill(spark: SparkSession, sf: str) -> DataFrame:
    return selection.top_n(D.scores(spark, sf).drop("label"), "score", 100, ties="fill").select("id", "label")


@query("submission_csv", oracles.BASE + """ select id as "ID", (score > 0.95)::int as label from scored""")
def submission_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions written as CSV and read back with the submission schema."""
    labelled = selection.at(D.scores(spark, sf).drop("label"), "score", 0.95)
    path = f"{shared_dir(spark)}/quillmark/submission/{sf.strip('/').replace('/', '-')}"
    C.write_submission(labelled, path, key="id")
    return C.read_submission(spark, path)


# ---------------------------------------------------------- scaling and grids
_NARROW = ["avg_line_len", "space_ratio", "n_semicolons"]


def _narrow(spark: SparkSession, sf: str) -> DataFrame:
    return _named(_NARROW, spark, sf)


_NARROW_SQL = oracles.wide_sql(_NARROW, "__TAIL__").replace("__TAIL__", "")


@query("standardize", _NARROW_SQL + "select id, " + ", ".join(
    f"round(({c} - avg({c}) over ()) / stddev_pop({c}) over (), 6) + 0.0 as {c}" for c in _NARROW) + " from wide")
def standardize(spark: SparkSession, sf: str) -> DataFrame:
    df = materialize(_narrow(spark, sf), "narrow")
    out = scaling.scale(df, scaling.fit_scaler(df, _NARROW))
    return out.select("id", *[F.round(c, 6).alias(c) for c in _NARROW])


@query("class_weights", oracles.BASE + """ select label, count(*) as n, sum(count(*)) over ()::double / (2 * count(*)) as weight
  from labelled where label is not null group by label""")
def class_weights(spark: SparkSession, sf: str) -> DataFrame:
    return scaling.class_weights(_labelled_meta(spark, sf))


@query("minmax_inverted", _NARROW_SQL + "select id, " + ", ".join(
    f"round(1 - ({c} - min({c}) over ()) / (max({c}) over () - min({c}) over ()), 6) as {c}" for c in _NARROW) + " from wide")
def minmax_inverted(spark: SparkSession, sf: str) -> DataFrame:
    df = materialize(_narrow(spark, sf), "narrow")
    out, _ = scaling.minmax_inverted(df, _NARROW)
    return out.select("id", *[F.round(c, 6).alias(c) for c in _NARROW])


_PLANTED = ["log_score", "toxic"]


@query("drop_nan_columns", oracles.wide_sql(Q.SET36, "__TAIL__").replace("__TAIL__", "").rstrip() + """,
  pl as (select w.*, case when c.n_chars % 1000 > 0 then ln(c.n_chars % 1000) end as log_score, l.toxic::double as toxic
    from wide w join corpus c on c.id = w.id left join labels l on l.doc_id = w.id),
  u as (""" + " union all ".join(
    f"select '{c}' as feature, count(*) filter ({c} is null or isnan({c}::double)) as n, count(*) filter (id % 2 = 0) as even_rows from pl"
    for c in [*Q.SET36, *_PLANTED]) + ") select * from u where n = 0")
def drop_nan_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Columns without nulls or NaNs of the feature set and two planted ones, to which both halves are then aligned."""
    base = D.corpus(spark, sf).select("id", "n_chars")
    labels = D.table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").cast("double").alias("toxic"))
    score = F.col("n_chars") % 1000
    planted = base.join(labels, "id", "left").withColumn("log_score", F.when(score > 0, F.log(score)).otherwise(F.lit(float("nan"))))
    wide = materialize(_named(Q.SET36, spark, sf).join(planted.drop("n_chars"), "id"), "planted")
    missing = scaling.null_counts(wide, [*Q.SET36, *_PLANTED])
    alive = [c for c, n in missing.items() if n == 0]
    even, odd = Q.align_columns([wide.where("id % 2 = 0"), wide.where("id % 2 <> 0")], alive, ["id"])
    assert even.columns == odd.columns == ["id", *alive]
    rows = even.count()
    return spark.createDataFrame([(c, missing[c], rows) for c in alive], "feature string, n bigint, even_rows bigint")


@query("quantile_grid", _NARROW_SQL + ", long as (" + " union all ".join(
    f"select '{c}' as feature, {c} as x from wide" for c in _NARROW) + """),
  p as (select k from range(1000) t(k)),
  o as (select feature, x, row_number() over (partition by feature order by x) - 1 as i, count(*) over (partition by feature) as n from long),
  h as (select distinct feature, k, (n - 1) * k::double / 999 as h, ((n - 1) * k) // 999 as lo from o, p)
  select h.feature, h.k::int as k, round(a.x + (b.x - a.x) * (h.h - floor(h.h)), 6) as value
  from h join o a on a.feature = h.feature and a.i = h.lo
  join o b on b.feature = h.feature and b.i = least(h.lo + 1, b.n - 1)""")
def quantile_grid(spark: SparkSession, sf: str) -> DataFrame:
    df = materialize(_narrow(spark, sf), "narrow")
    out = ordering.quantile_grid(df, _NARROW, 1000)
    return out.select("feature", F.col("k").cast("int").alias("k"), F.round("value", 6).alias("value"))


_POSITION = """, o_{c} as (select {c} as x, row_number() over (order by {c}) - 1 as i, count(*) over () as n from wide),
  l_{c} as (select k, m, (n - 1) * k::double / (m - 1) as h, ((n - 1) * k) // (m - 1) as lo, n
    from range(1000) t(k), (select count(*) as n, least(count(*), 1000) as m from wide) where k < m),
  g_{c} as (select min(k) as k0, max(k) as k1, max(m) as m, v from (
    select k, m, a.x + (b.x - a.x) * (h - floor(h)) as v from l_{c} l join o_{c} a on a.i = l.lo join o_{c} b on b.i = least(l.lo + 1, l.n - 1)) group by v),
  n_{c} as (select *, lead(v) over (order by v) as v2, lead(k0) over (order by v) as k2, max(v) over () as top, min(v) over () as bottom from g_{c}),
  p_{c} as (select w.id, round(case when w.{c} = g.bottom then 0 when w.{c} = g.top then 1
      when w.{c} = g.v then (g.k0 + g.k1) / 2.0::double / (g.m - 1)
      else (g.k1 + (g.k2 - g.k1) * (w.{c} - g.v) / (g.v2 - g.v)) / (g.m - 1) end, 6) as {c}
    from wide w asof join n_{c} g on w.{c} >= g.v)"""


@query("quantile_transform", _NARROW_SQL.rstrip() + "".join(_POSITION.format(c=c) for c in _NARROW)
       + " select id, " + ", ".join(_NARROW) + " from " + " join ".join(
           [f"p_{_NARROW[0]}"] + [f"p_{c} using (id)" for c in _NARROW[1:]]))
def quantile_transform(spark: SparkSession, sf: str) -> DataFrame:
    df = materialize(_narrow(spark, sf), "narrow")
    out = quantile.transform(df, quantile.fit(df, _NARROW))
    return out.select("id", *[F.round(c, 6).alias(c) for c in _NARROW])


# ------------------------------------------------------------------------ QDA
_XY = ["avg_line_len", "space_ratio"]
_QDA_SQL = oracles.wide_sql(_XY, "__TAIL__").replace("__TAIL__", "").rstrip() + """,
  st as (select label, count(*) as n, avg(avg_line_len) as mean_1, avg(space_ratio) as mean_2, var_samp(avg_line_len) as var_1,
      var_samp(space_ratio) as var_2, covar_samp(avg_line_len, space_ratio) as cov from wide where label is not null group by label),
  fit as (select *, n / sum(n) over () as prior, var_1 * var_2 - cov * cov as det from st),
  a as (select * from fit where label = 0), b as (select * from fit where label = 1)"""


def _qda_probability(x: str, y: str) -> str:
    def side(t: str) -> str:
        return (f"(ln({t}.prior) - 0.5 * ln({t}.det) - 0.5 * (({x} - {t}.mean_1) ** 2 * {t}.var_2 - 2 * {t}.cov * ({x} - {t}.mean_1)"
                f" * ({y} - {t}.mean_2) + ({y} - {t}.mean_2) ** 2 * {t}.var_1) / {t}.det)")
    return f"round(1 / (1 + exp(least({side('a')} - {side('b')}, 700))), 6)"


def _xy(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(D.with_labels(_named(_XY, spark, sf), spark, sf), "xy")


@query("qda_fit", _QDA_SQL + " select label, n, " + ", ".join(
    f"round({c}, 6) as {c}" for c in ("mean_1", "mean_2", "var_1", "var_2", "cov", "prior", "det")) + " from fit")
def qda_fit(spark: SparkSession, sf: str) -> DataFrame:
    labelled = D.with_labels(_named(_XY, spark, sf), spark, sf)
    out = qda.fit(labelled, _XY).withColumnRenamed("cov_1_2", "cov")
    return out.select("label", "n", *[F.round(c, 6).alias(c) for c in ("mean_1", "mean_2", "var_1", "var_2", "cov", "prior", "det")])


@query("qda_score", _QDA_SQL + f" select wide.id, {_qda_probability('avg_line_len', 'space_ratio')} as probability from wide, a, b")
def qda_score(spark: SparkSession, sf: str) -> DataFrame:
    df = _xy(spark, sf)
    return qda.score(df, qda.fit(df, _XY), _XY).select("id", F.round("probability", 6).alias("probability"))


_XYZ = ["avg_line_len", "space_ratio", "max_line_len"]
_XYZ_STATS = "count(*) as n, " + ", ".join(
    [f"avg({c}) as m{i}, var_samp({c}) as s{i}{i}" for i, c in enumerate(_XYZ, 1)]
    + [f"covar_samp({_XYZ[i - 1]}, {_XYZ[j - 1]}) as s{i}{j}" for i, j in ((1, 2), (1, 3), (2, 3))])
# determinant and adjugate of the 3 x 3 covariance matrix
_XYZ_SOLVED = """*, s11 * (s22 * s33 - s23 * s23) - s12 * (s12 * s33 - s13 * s23) + s13 * (s12 * s23 - s13 * s22) as det,
    s22 * s33 - s23 * s23 as a11, s13 * s23 - s12 * s33 as a12, s12 * s23 - s13 * s22 as a13,
    s11 * s33 - s13 * s13 as a22, s12 * s13 - s11 * s23 as a23, s11 * s22 - s12 * s12 as a33"""


def _xyz_probability() -> str:
    def side(t: str) -> str:
        d = [f"({c} - {t}.m{i})" for i, c in enumerate(_XYZ, 1)]
        square = " + ".join(f"{1 if i == j else 2} * {t}.a{i + 1}{j + 1} * {d[i]} * {d[j]}" for i in range(3) for j in range(i, 3))
        return f"(ln({t}.prior) - 0.5 * ln({t}.det) - 0.5 * ({square}) / {t}.det)"
    return f"round(1 / (1 + exp(least({side('a')} - {side('b')}, 700))), 5)"


_XYZ_SQL = oracles.wide_sql(_XYZ, "__TAIL__").replace("__TAIL__", "").rstrip()


@query("qda_score3", _XYZ_SQL + f""", st as (select label, {_XYZ_STATS} from wide where label is not null group by label),
  fit as (select {_XYZ_SOLVED}, n / sum(n) over () as prior from st)
  select wide.id, {_xyz_probability()} as probability from wide, fit a, fit b where a.label = 0 and b.label = 1""")
def qda_score3(spark: SparkSession, sf: str) -> DataFrame:
    """The discriminant on three columns."""
    df = materialize(D.with_labels(_named(_XYZ, spark, sf), spark, sf), "xyz")
    return qda.score(df, qda.fit(df, _XYZ), _XYZ).select("id", F.round("probability", 5).alias("probability"))


def _fit_qda(train: DataFrame, _held_out: DataFrame | None, columns: Sequence[str]):
    """A closed-form model for the ensemble operators: a discriminant on the given columns."""
    params = qda.fit(train, columns)
    return lambda df, out: qda.score(df, params, list(columns), out)


_FOLDS = f"""fo as (select id, ((row_number() over (partition by label order by {_HASH}, id) - 1) % 5)::int as fold
    from wide where label is not null)"""


@query("cv_qda", _XYZ_SQL + f""", {_FOLDS},
  st as (select f.k, w.label, {_XYZ_STATS} from wide w join fo using (id) join range(5) f(k) on fo.fold <> f.k group by f.k, w.label),
  fit as (select {_XYZ_SOLVED}, n / sum(n) over (partition by k) as prior from st),
  sc as (select w.id, w.label, fo.fold, a.k, {_xyz_probability().replace('round(', '(').replace(', 5)', ')')} as p
    from wide w left join fo using (id), fit a join fit b on a.k = b.k where a.label = 0 and b.label = 1)
  select id, label, fold, round(p, 5) as score from sc where fold = k
  union all select id, label, null, round(avg(p), 5) from sc where label is null group by id, label""")
def cv_qda(spark: SparkSession, sf: str) -> DataFrame:
    """Five folds with a closed-form model: out-of-fold scores of labelled rows, fold averages of the others."""
    df = materialize(D.with_labels(_named(_XYZ, spark, sf), spark, sf), "xyz")
    oof, (others,) = ensembles.cross_validate(df, [df.where("label is null")], _XYZ, _fit_qda)
    parts = oof.unionByName(others.withColumn("fold", F.lit(None).cast("int")))
    return parts.select("id", "label", "fold", F.round("score", 5).alias("score"))


@query("ablation_qda", _XYZ_SQL + f""", {_FOLDS}, w as (select wide.*, fold from wide join fo using (id)),
  pairs as (""" + " union all ".join(
    f"select '{dropped}' as dropped, id, label, fold, {x} as x, {y} as y from w"
    for dropped, x, y in ((_XYZ[0], _XYZ[1], _XYZ[2]), (_XYZ[1], _XYZ[0], _XYZ[2]), (_XYZ[2], _XYZ[0], _XYZ[1]))) + f"""),
  st as (select dropped, label, count(*) as n, avg(x) as mean_1, avg(y) as mean_2, var_samp(x) as var_1, var_samp(y) as var_2,
      covar_samp(x, y) as cov from pairs where fold > 0 group by dropped, label),
  fit as (select *, n / sum(n) over (partition by dropped) as prior, var_1 * var_2 - cov * cov as det from st),
  pr as (select v.dropped, v.label, ({_qda_probability('x', 'y')} > 0.5)::int as pred from pairs v
    join fit a on a.dropped = v.dropped and a.label = 0 join fit b on b.dropped = v.dropped and b.label = 1 where v.fold = 0),
  c as (select dropped, count(*) filter (label = 1 and pred = 1)::double as tp, count(*) filter (label = 0 and pred = 1)::double as fp,
      count(*) filter (label = 1 and pred = 0)::double as fn, count(*) filter (label = 0 and pred = 0)::double as tn from pr group by dropped)
  select dropped, round((coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0)) / 2, 5) as macro_f1 from c""")
def ablation_qda(spark: SparkSession, sf: str) -> DataFrame:
    """Each of three columns left out in turn, with a closed-form model."""
    df = materialize(D.with_labels(_named(_XYZ, spark, sf), spark, sf), "xyz")
    train, val, _ = _splits(df)
    return ensembles.ablation(train, val, _XYZ, _fit_qda).withColumn("macro_f1", F.round("macro_f1", 5))


@query("joined_scores", oracles.BASE + """ select coalesce(a.id, b.id) as id, first_model, second_model, round((first_model + second_model) / 2, 6) as fused
  from (select id, score as first_model from scored where id % 3 > 0) a full join (select id, score_b as second_model from scored where id % 5 > 0) b on a.id = b.id""")
def joined_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of two models that each cover a part of the rows, side by side and averaged."""
    scores = D.scores(spark, sf)
    first = scores.where("id % 3 > 0").select("id", "score")
    second = scores.where("id % 5 > 0").select("id", F.col("score_b").alias("score"))
    both = ensembles.join_scores({"first_model": first, "second_model": second})
    return both.withColumn("fused", F.round((F.col("first_model") + F.col("second_model")) / 2, 6))


@query("class_subsets", oracles.BASE + """ select label, count(*) as n, min(id) as first_id, max(id) as last_id, sum(n_chars)::bigint as chars
  from labelled where label in (0, 1) group by label""")
def class_subsets(spark: SparkSession, sf: str) -> DataFrame:
    """Size and extent of the rows of each class, filtered class by class."""
    df = D.with_labels(D.corpus(spark, sf).select("id", "n_chars"), spark, sf)
    parts = [
        sampling.of_class(df, k).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.sum("n_chars").alias("chars"))
        .select(F.lit(k).alias("label"), "n", "first_id", "last_id", "chars") for k in (0, 1)
    ]
    return parts[0].unionByName(parts[1])


_VIEWS_XYZ = {"first": _XYZ[:2], "second": _XYZ[1:]}


@query("stack_qda", _XYZ_SQL + f""", {_FOLDS},
  pairs as (""" + " union all ".join(f"select '{v}' as view, w.id, w.label, fo.fold, {x} as x, {y} as y from wide w left join fo using (id)" for v, (x, y) in _VIEWS_XYZ.items()) + f"""),
  st as (select view, k, label, count(*) as n, avg(x) as mean_1, avg(y) as mean_2, var_samp(x) as var_1, var_samp(y) as var_2, covar_samp(x, y) as cov
    from pairs join range(6) f(k) on label is not null and fold <> k group by all),
  fit as (select *, n / sum(n) over (partition by view, k) as prior, var_1 * var_2 - cov * cov as det from st),
  sc as (select v.view, v.id, v.label, {_qda_probability('x', 'y').replace('round(', '(').replace(', 6)', ')')} as p from pairs v
    join fit a on a.view = v.view and a.label = 0 and a.k = coalesce(v.fold, 5) join fit b on b.view = v.view and b.label = 1 and b.k = a.k),
  side as (select id, label, max(p) filter (view = 'first') as s1, max(p) filter (view = 'second') as s2 from sc group by all),
  top as (select label, count(*) as n, avg(s1) as mean_1, avg(s2) as mean_2, var_samp(s1) as var_1, var_samp(s2) as var_2, covar_samp(s1, s2) as cov
    from side where label is not null group by label),
  last as (select *, n / sum(n) over () as prior, var_1 * var_2 - cov * cov as det from top)
  select id, round(s1, 5) as score_first, round(s2, 5) as score_second, {_qda_probability('s1', 's2').replace(', 6)', ', 5)')} as probability
  from side, (select * from last where label = 0) a, (select * from last where label = 1) b where side.label is null""")
def stack_qda(spark: SparkSession, sf: str) -> DataFrame:
    """Two views with a closed-form model each, stacked: out-of-fold scores below, a discriminant on top."""
    df = materialize(D.with_labels(_named(_XYZ, spark, sf), spark, sf), "xyz")
    _, test = ensembles.stack_views(df.where("label is not null"), df.where("label is null"), _VIEWS_XYZ, _fit_qda, seed=42)
    return test.select("id", *[F.round(c, 5).alias(c) for c in ("score_first", "score_second", "probability")])


_NEWTON = """
  pm as (select avg(avg_line_len) as m1, stddev_pop(avg_line_len) as s1, avg(space_ratio) as m2, stddev_pop(space_ratio) as s2 from wide where label is not null),
  d as (select (avg_line_len - m1) / s1 as x, (space_ratio - m2) / s2 as y, label::double as t, sum(1) over () / (2.0::double * count(*) over (partition by label)) as c
    from wide, pm where label is not null),
  recursive_steps as (
    with recursive it(k, w0, w1, w2) as (
      select 0, 0.0::double, 0.0::double, 0.0::double
      union all
      select k + 1, w0 - (g0 * (d * f - e * e) + g1 * (c * e - b * f) + g2 * (b * e - c * d)) / det,
        w1 - (g0 * (c * e - b * f) + g1 * (a * f - c * c) + g2 * (b * c - a * e)) / det,
        w2 - (g0 * (b * e - c * d) + g1 * (b * c - a * e) + g2 * (a * d - b * b)) / det
      from (select *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) as det from (
        select k, w0, w1, w2, w0 + sum(u) as g0, w1 + sum(u * x) as g1, w2 + sum(u * y) as g2, 1 + sum(h) as a, sum(h * x) as b, sum(h * y) as c,
          1 + sum(h * x * x) as d, sum(h * x * y) as e, 1 + sum(h * y * y) as f
        from (select k, w0, w1, w2, x, y, d.c * (p - t) as u, d.c * p * (1 - p) as h from (
          select it.*, d.*, 1 / (1 + exp(-(w0 + w1 * x + w2 * y))) as p from it, d where k < 20) d)
        group by k, w0, w1, w2)))
    select * from it where k = 20)"""


@query("logreg_two", _QDA_SQL + "," + _NEWTON + """
  select id, round(1 / (1 + exp(-(w0 + w1 * (avg_line_len - m1) / s1 + w2 * (space_ratio - m2) / s2))), 4) as score from wide, pm, recursive_steps""")
def logreg_two(spark: SparkSession, sf: str) -> DataFrame:
    """Scaled, balanced, penalised logistic regression on two columns, checked by Newton steps."""
    df = _xy(spark, sf)
    scored = fit_logistic(df, _XY, tol=1e-12)(df, "score")
    return scored.select("id", F.round("score", 4).alias("score"))


@query("decision_surface", _QDA_SQL + f""",
  e as (select min(avg_line_len) - 0.1 as x0, (max(avg_line_len) - min(avg_line_len) + 0.2) / 99 as dx,
          min(space_ratio) - 0.1 as y0, (max(space_ratio) - min(space_ratio) + 0.2) / 99 as dy from wide),
  g as (select i::int as i, j::int as j, x0 + i * dx as x, y0 + j * dy as y from range(100) s(i), range(100) t(j), e)
  select i, j, {_qda_probability('x', 'y')} as probability from g, a, b""")
def decision_surface(spark: SparkSession, sf: str) -> DataFrame:
    df = _xy(spark, sf)
    grid = qda.surface(df, qda.fit(df, _XY), _XY)
    return grid.select("i", "j", F.round("probability", 6).alias("probability"))


# --------------------------------------------------------------------- arrays
@query("head_tail_tokens", oracles.BASE + f""", ids as (select id, list_transform(regexp_extract_all(code, '{oracles.W}+'), lambda t: length(t)) as a from corpus),
  w as (select id, len(a) as n, case when len(a) > 1024 then list_concat(a[1:512], a[len(a) - 511:])
      else list_concat(a, list_transform(range(1024 - len(a)), lambda i: 0)) end as b from ids)
  select id, md5(array_to_string(b, ',')) as window_md5, len(b)::int as window_size, least(n, 1024)::bigint as n_real from w""")
def head_tail_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Token window of 1024 over token lengths as stand-in ids, and its mask."""
    ids = D.code(spark, sf).select("id", F.transform(text.words(F.col("code")), F.length).alias("a"))
    window, mask = arrays.head_tail(F.col("a"), 1024, 0)
    out = ids.select("id", window.alias("w"), mask.alias("m"))
    return out.select(
        "id",
        F.md5(F.array_join(F.transform("w", lambda x: x.cast("string")), ",")).alias("window_md5"),
        F.size("w").alias("window_size"),
        F.aggregate("m", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_real"),
    )


@query("softmax_pair", """select vec_id, (k - 1)::int as k, round(e / sum(e) over (partition by vec_id), 6) as probability, pred
  from (select vec_id, k, exp(x - m) as e, pred from (
    select vec_id, unnest(v) as x, unnest(range(1, len(v) + 1)) as k, list_max(v) as m, (list_position(v, list_max(v)) - 1)::int as pred
    from (select vec_id, list_transform(embedding, lambda c: c::double * 50) as v from embeddings)))""")
def softmax_pair(spark: SparkSession, sf: str) -> DataFrame:
    """Softmax over each whole array, with its largest component."""
    logits = D.table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda c: c.cast("double") * 50).alias("logits"))
    out = logits.select("vec_id", arrays.argmax(F.col("logits")).alias("pred"), F.posexplode(arrays.softmax(F.col("logits"))).alias("k", "p"))
    return out.select("vec_id", "k", F.round("p", 6).alias("probability"), "pred")


# --------------------------------------------------------------------- models
# All models run with their full settings.  Early stopping ends the boosted
# ones that are given a validation set; Spark ML takes about 0.3 s a round
# whatever the size.
def _model_table(spark: SparkSession, sf: str, names: Sequence[str]) -> DataFrame:
    """Features of every document with its label, computed once and stored."""
    docs = D.spread(D.table(spark, sf, "documents").select("doc_id", "lang", "text"), "doc_id")
    docs = docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("language"), F.expr(D.CODE_SQL).alias("code"))
    return materialize(D.with_labels(Q.add_features(docs, names), spark, sf), "model")


def _splits(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Train and validation parts of the labelled rows; the unlabelled rows are the test set."""
    known = materialize(sampling.folds(df.where("label is not null"), k=5), "split")
    return known.where("fold > 0").drop("fold"), known.where("fold = 0").drop("fold"), df.where("label is null")


def _boosted_query(preset: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = _model_table(spark, sf, Q.BASE9)
        train, val, _ = _splits(df)
        params = trees.BOOST_PRESETS[preset]
        scorer = trees.fit_boosted(train, val, Q.BASE9, params)
        return scorer(df, "score").select("id", "label", "score")

    return run


QUERIES["gbt_depth3"] = _boosted_query("depth3")
QUERIES["gbt_depth5"] = _boosted_query("depth5_wait100")
QUERIES["gbt_depth6"] = _boosted_query("depth6_wait100")


@query("gbt_rounds")
def gbt_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """Macro scores on the validation rows after each boosting round."""
    train, val, _ = _splits(_model_table(spark, sf, Q.BASE9))
    model, _ = trees.fit_until(train, val, Q.BASE9, trees.BOOST_PRESETS["depth3"])
    return model.by_round(val)


@query("rf_extratrees")
def rf_extratrees(spark: SparkSession, sf: str) -> DataFrame:
    df = _model_table(spark, sf, Q.BASE9)
    train, _, _ = _splits(df)
    return trees.fit_forest(train, Q.BASE9)(df, "score").select("id", "label", "score")


@query("logreg_balanced")
def logreg_balanced(spark: SparkSession, sf: str) -> DataFrame:
    df = _model_table(spark, sf, Q.BASE9)
    train, _, _ = _splits(df)
    return fit_logistic(train, Q.BASE9)(df, "score").select("id", "label", "score")


@query("model_comparison")
def model_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Best validation threshold of five models fitted on the same features."""
    train, val, _ = _splits(_model_table(spark, sf, Q.BASE9))
    fitted = boosting.compare(train, val, Q.BASE9)
    return fitted.best_thresholds(materialize(fitted.score(val), "compared"))


@query("cv_oof")
def cv_oof(spark: SparkSession, sf: str) -> DataFrame:
    """Rebalanced training, 5 folds: out-of-fold scores and averaged test scores."""
    df = _model_table(spark, sf, Q.STYLE19)
    train, val, test = _splits(df)
    params = trees.BOOST_PRESETS["depth5"]
    balanced = materialize(rebalanced.rebalance(train, n=400), "balanced")
    fitted = rebalanced.fit(balanced, val, [test], Q.STYLE19, params)
    parts = [("train", fitted.oof), ("validation", fitted.scored[0]), ("test", fitted.scored[1])]
    out = [p.select(F.lit(n).alias("part"), "id", "label", "score") for n, p in parts]
    rows = out[0].unionByName(out[1]).unionByName(out[2])
    return rows.withColumn("pred", (F.col("score") > F.lit(fitted.threshold)).cast("int"))


@query("stack_views")
def stack_views(spark: SparkSession, sf: str) -> DataFrame:
    """All three views, the one that is ready but switched off included."""
    views = {**Q.VIEWS, **Q.INACTIVE_VIEWS}
    df = _model_table(spark, sf, [c for v in views.values() for c in v])
    params = trees.BOOST_PRESETS["stacking"]
    _, test = ensembles.stack_views(
        df.where("label is not null"), df.where("label is null"), views,
        lambda a, _, cols: trees.fit_boosted(a, None, cols, params),
    )
    return test.select("id", "score_structure", "score_indent_style", "score_vocab_syntax", "probability")


@query("late_fusion")
def late_fusion(spark: SparkSession, sf: str) -> DataFrame:
    """Style features, a boosted score and a given model score, fused on the validation rows."""
    df = _model_table(spark, sf, Q.STYLE19)
    given = D.corpus(spark, sf).select("id", ((F.col("n_chars") % 1000) / F.lit(1000.0)).alias("text_score"))
    train, val, _ = _splits(df.join(given, "id"))
    boosted = trees.fit_boosted(train, None, Q.STYLE19, trees.BOOST_PRESETS["depth5"])
    fit_on = materialize(boosted(val, "tree_score"), "fusion")
    apply_to = boosted(df.join(given, "id"), "tree_score")
    fused = ensembles.fuse(fit_on, apply_to, Q.STYLE19, ["tree_score", "text_score"])
    return fused.select("id", "label", "tree_score", "text_score", "fused")


@query("ablation")
def ablation(spark: SparkSession, sf: str) -> DataFrame:
    train, val, _ = _splits(_model_table(spark, sf, Q.BASE9))
    return ensembles.ablation(train, val, Q.BASE9, lambda a, _, cols: fit_logistic(a, cols))


@query("random_search")
def random_search(spark: SparkSession, sf: str) -> DataFrame:
    train, val, _ = _splits(_model_table(spark, sf, Q.BASE9))
    return ensembles.random_search(train, val, Q.BASE9, trees.BoostParams(rounds=5000, wait=100), draws=10)


@query("iforest_pair")
def iforest_pair(spark: SparkSession, sf: str) -> DataFrame:
    df = _model_table(spark, sf, Q.SET36)
    model = anomaly.fit(df, Q.SET36)
    return model.pair(df).select("id", "label", "human_anomaly", "machine_anomaly")


@query("anomaly_classifier")
def anomaly_classifier(spark: SparkSession, sf: str) -> DataFrame:
    """Two forests, discriminant on top, a tenth of the unlabelled rows labelled positive."""
    df = _model_table(spark, sf, Q.SET36)
    model = anomaly.fit(df, Q.SET36)
    test = df.where("label is null").drop("label")
    return model.label_top(test, max(1, test.count() // 10)).select("id", "probability", "label")


@query("anomaly_validation")
def anomaly_validation(spark: SparkSession, sf: str) -> DataFrame:
    """acc, macro scores and AUC of the anomaly classifier at the fixed 0.9 cut."""
    train, val, _ = _splits(_model_table(spark, sf, Q.SET36))
    model = anomaly.fit(train, Q.SET36)
    scored = materialize(model.probability(val), "validation")
    return metrics.metric_table(selection.at(scored, "probability", 0.9, "pred"), score="probability")
