"""What several of the training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.sources.session import bounded, materialize, shared_dir  # noqa: F401

#: A word: a run without space, tab, line feed, vertical tab, form feed or carriage return.
WORD = r"[^\x20\x09-\x0D]+"

#: Largest lookup table that is ever broadcast, in rows of a few numbers each.
BROADCAST_ROWS = 200_000

#: Bytes of an Arrow batch that goes to a Python worker (one row at least).
BATCH_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows, else unchanged (joined by shuffle)."""
    return bounded(df, limit)[0]


def whole_text(text: str = "text") -> Column:
    """The text; a null counts as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def small_batches(df: DataFrame) -> None:
    """Hand texts to Python in Arrow batches of BATCH_BYTES, so that long texts do not pile up in a worker.

    A session setting: it moves memory, not results, and stays set because the
    plan runs after the operator has returned.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def free(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet."""
    while name in df.columns:
        name = f"_{name}"
    return name


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder that the whole cluster shares."""
    return f"{shared_dir(spark).rstrip('/')}/quillmark/{name}-{uuid.uuid4().hex}"


def key_runs(df: DataFrame, key: str, rows_per_run: int, most: int) -> Column:
    """Number of the run that a row's integer key falls into: ascending runs of about ``rows_per_run`` rows.

    Cut at approximate quantiles of the key alone, at most ``most`` runs (they
    get longer beyond that); equal keys are in one run, a null key in the first.
    """
    runs = min(most, max(1, df.count() // rows_per_run))
    shares = [i / runs for i in range(1, runs)]
    cuts = sorted(set(df.agg(F.percentile_approx(key, shares, 20 * runs)).first()[0] or [])) if shares else []
    if not cuts:
        return F.lit(0)
    return F.when(F.col(key).isNull(), 0).otherwise(F.size(F.filter(F.lit(cuts), lambda c: c < F.col(key))))


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Connected components of an edge list: one row (node, component) per node, component = smallest node.

    Every round takes the smallest label of the neighbours (partial minima
    before the shuffle, so a hub costs no more than its edges) and then jumps
    to the label of that label, which halves the remaining distances.  Each
    round is written to the shared folder.  Nulls take part in no edge; no
    edges give an empty table.
    """
    edges = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null and a <> b")
    both = materialize(edges.union(edges.select("b", "a")).distinct(), "edges")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("m"))
        step = labels.join(near, labels.node == near.a).select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        up = step.select(F.col("node").alias("up_node"), F.col("label").alias("up_label"))
        jumped = step.join(up, step.label == up.up_node).select("node", "old", F.least("label", "up_label").alias("label"))
        jumped = materialize(jumped, "labels")
        if jumped.where("label <> old").isEmpty():
            return jumped.select("node", F.col("label").alias("component"))
        labels = jumped.select("node", "label")
