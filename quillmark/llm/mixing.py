"""Mix sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmark.llm.base import WORD, free, materialize, small, whole_text

WEIGHTS = (3.0, 1.0, 2.0)
TOTAL_SHARE = 1.5
MOST_COPIES = 2
SEED = "mix-1"
#: Documents per rank bucket; only the one bucket of a source that is cut gets sorted.
BUCKET_ROWS = 500


def targets(totals: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = TOTAL_SHARE, most: int = MOST_COPIES) -> DataFrame:
    """Target words of each source: ``source, source_size -> ..., target``.

    Sources in code point order (null last) weigh ``weights`` in turn and share
    ``share`` times all words.  No target exceeds ``most`` times its source;
    the excess goes to the others by weight.  Sorted by words per weight, a
    source is filled up exactly when the level of the rest reaches its limit,
    so one sorted pass over the source totals (one row a source) settles it.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    wide = totals.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % n + 1).cast("int")))
    wide = wide.withColumn("limit", F.col("source_size") * F.lit(float(most)))
    by_level = W.orderBy(F.col("limit") / F.col("w"), F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    wide = (
        wide.withColumn("filled", F.sum("limit").over(by_level.rowsBetween(W.unboundedPreceding, -1)))
        .withColumn("open_w", F.sum("w").over(by_level.rowsBetween(W.currentRow, W.unboundedFollowing)))
        .withColumn("all_words", F.sum("source_size").over(everything))
    )
    level = (F.col("all_words") * F.lit(share) - F.coalesce(F.col("filled"), F.lit(0.0))) / F.col("open_w")
    wide = wide.withColumn("level", level).withColumn("full", F.col("limit") / F.col("w") <= F.col("level"))
    wide = wide.withColumn("rest_level", F.max(F.when(~F.col("full"), F.col("level"))).over(everything))
    target = F.when(F.col("full"), F.col("limit")).otherwise(F.least("limit", F.col("w") * F.col("rest_level")))
    return wide.withColumn("target", target).drop("w", "limit", "filled", "open_w", "all_words", "level", "full", "rest_level")


def uniform(key: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) that depends on nothing but the key and the seed."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**52))


def mix(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = TOTAL_SHARE, most: int = MOST_COPIES,
    seed: str = SEED, key: str = "doc_id", text: str = "text", source: str = "source", favour: Column | None = None,
) -> DataFrame:
    """How many words the mix takes of each document.

    Returns ``<key>, size, source_size, target, taken, copies``, one row per row
    of ``docs``.  Each document expects ``target / source_size`` copies (times
    ``favour``, a positive document weight, over its mean by words; the default
    is 1).  Whole copies are certain.  The remainder is the inclusion
    probability p of one more copy: documents are ranked by odds(u) / odds(p)
    with u from a hash of the key (Pareto order sampling), and taken from the
    lowest rank on until the target is met.  So sizes are fixed, reruns agree
    and the number of partitions does not matter.  The document on which the
    target falls counts with the words still missing (``taken``); ``copies``
    rounds ``taken / size`` to whole documents.

    The rank is cut in buckets: word sums of buckets find the bucket that holds
    the cut, and only its documents are sorted, however large the source.

    Null text: size 0, taken 0.  Null source: a source of its own, last.  Rows
    of equal key and size tie and are taken in any order, which gives the same
    rows.  An empty table gives an empty result; other columns are ignored.
    """
    weight = F.lit(1.0) if favour is None else favour.cast("double")
    sized = materialize(
        docs.select(
            F.col(key).alias("key"), F.col(source).cast("string").alias("source"),
            F.regexp_count(whole_text(text), F.lit(WORD)).cast("long").alias("size"),
            uniform(F.col(key), seed).alias("u"), weight.alias("m"),
        ),
        "sizes",
    )
    totals = sized.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("m")).alias("favoured"), F.count("*").alias("n_docs"),
    )
    plan = small(materialize(targets(totals, weights, share, most), "targets"))
    rows = sized.join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "inner").drop("s")

    expected = F.when(
        (F.col("source_size") > 0) & (F.col("favoured") > 0),
        F.least(F.lit(float(most)), F.col("target") / F.col("source_size") * (F.col("m") / (F.col("favoured") / F.col("source_size")))),
    ).otherwise(F.lit(0.0))
    rows = rows.withColumn("expected", expected).withColumn("whole", F.floor("expected")).withColumn("p", F.col("expected") - F.col("whole"))
    # odds(u) / odds(p), squeezed into [0, 1): a document without a remainder ranks last
    rank = F.col("u") * (1 - F.col("p")) / (F.col("u") * (1 - F.col("p")) + F.col("p") * (1 - F.col("u")))
    rows = rows.withColumn("rank", F.when(F.col("p") > 0, rank).otherwise(F.lit(1.0)))
    buckets = F.greatest(F.lit(64), F.ceil(F.col("n_docs") / BUCKET_ROWS))
    rows = rows.withColumn("bucket", F.floor(F.col("rank") * buckets)).withColumn("room", F.when(F.col("whole") < most, F.col("size")).otherwise(F.lit(0)))

    by_source = W.partitionBy("source").orderBy("bucket")
    sums = rows.groupBy("source", "bucket").agg(
        F.sum("room").alias("room"), F.sum(F.col("whole") * F.col("size")).alias("sure"), F.first("target").alias("target"),
    )
    sums = sums.withColumn("open", F.round(F.col("target")).cast("long") - F.sum("sure").over(W.partitionBy("source")))
    sums = sums.withColumn("before", F.sum("room").over(by_source) - F.col("room"))
    cuts = sums.where("before < open").groupBy("source").agg(
        F.max(F.struct("bucket", "before", "open")).alias("cut")).select(F.col("source").alias("s"), "cut.*")
    cuts = small(materialize(cuts.withColumnsRenamed({"bucket": "cut_bucket"}), "cuts"))
    rows = rows.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")

    inside = rows.where("bucket = cut_bucket")
    ahead = F.sum("room").over(W.partitionBy("source").orderBy("rank", "key", "size").rowsBetween(W.unboundedPreceding, -1))
    inside = inside.withColumn("more", F.greatest(F.lit(0), F.least(F.col("room"), F.col("open") - F.col("before") - F.coalesce(ahead, F.lit(0)))))
    outside = rows.where("cut_bucket is null or bucket <> cut_bucket").withColumn(
        "more", F.when(F.col("bucket") < F.col("cut_bucket"), F.col("room")).otherwise(F.lit(0)))
    taken = (F.col("whole") * F.col("size") + F.col("more")).cast("long")
    copies = F.when(F.col("size") > 0, F.floor(taken / F.col("size") + F.lit(0.5))).otherwise(F.lit(0))
    return outside.unionByName(inside).select(
        F.col("key").alias(key), "size", "source_size", F.col("target").cast("double").alias("target"), taken.alias("taken"), copies.cast("int").alias("copies"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix takes them: every row as often as ``copies`` says.

    Documents without a word, which no target can count, stay once.  Rows that
    repeat a key and its text share one decision.
    """
    key, text = options.get("key", "doc_id"), options.get("text", "text")
    of, size, words, copies, copy = (free(docs, name) for name in ("_of", "_size", "_words", "_copies", "_copy"))
    decided = mix(docs, **options).groupBy(F.col(key).alias(of), F.col("size").alias(size)).agg(F.max("copies").alias(copies))
    sized = docs.withColumn(words, F.regexp_count(whole_text(text), F.lit(WORD)).cast("long"))
    kept = sized.join(decided, F.col(key).eqNullSafe(F.col(of)) & (F.col(words) == F.col(size)))
    times = F.when(F.col(words) == 0, F.lit(1)).otherwise(F.col(copies))
    return kept.where(times > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), times))).select(*docs.columns)
