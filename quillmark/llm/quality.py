"""Quality classifier: cumulative-link (ordinal logistic) regression on hashed words."""

from __future__ import annotations

import operator
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmark.llm.base import small_batches, whole_text

#: Grades of the ratings, worst first.
GRADES = ("toxic", "junk", "good")
#: Fixed settings of the production model.
WIDTH = 1 << 18
SAMPLE = 9_000
EPOCHS = 1500
STEP = 0.3
L2 = 1e-4
#: A hashed column takes part if this many training documents of the lowest grade hold it ...
MIN_DOCS = 6
#: ... and it is so many times as frequent there as in the other grades.
LIFT = 8.0
KEEP_AT = 0.5
#: Shares are multiplied by this, so that they learn about as fast as a word.
SHAPE_SCALE = 10.0
SHAPES = 6
STEMS = (4, 5)
PUNCTUATION = ".,;:!?|#$%&*@()[]{}\"'-_/\\<>"
SYMBOLS = "#$%&*@"

Memory = dict[str, tuple[int, ...]]


@dataclass(frozen=True)
class Model:
    """Shared weights and ordered thresholds: P(grade <= k) = sigmoid(threshold[k] - score)."""

    words: np.ndarray
    shapes: np.ndarray
    thresholds: np.ndarray

    def scores(self, columns: list[np.ndarray], shares: np.ndarray) -> np.ndarray:
        return np.array([self.words[c].sum() for c in columns], dtype=float) + shares @ self.shapes

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for every threshold k, one row per score."""
        return _sigmoid(scores[:, None] - self.thresholds[None, :])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def _columns_of(word: str, memory: Memory) -> tuple[int, ...]:
    """Hashed columns of a word and of the beginnings of its bare form."""
    found = memory.get(word)
    if found is None:
        bare = word.strip(PUNCTUATION)
        forms = [word, *(f"^{n}{bare[:n]}" for n in STEMS)]
        found = tuple(zlib.crc32(f.encode("utf-8", "replace")) % WIDTH for f in forms)
        if len(memory) < 100_000:
            memory[word] = found
    return found


def features(text: str, memory: Memory) -> tuple[np.ndarray, list[float]]:
    """Hashed columns (each present or not) and shape shares of one whole text.

    Presence does not grow with the length of a text; the shares are per word:
    repeats of the word before, bars, exclamation marks, symbols, upper-case
    words, and 1 / words.
    """
    words = text.split()
    n = max(len(words), 1)
    columns: set[int] = set()
    for word in set(text.lower().split()):
        columns.update(_columns_of(word, memory))
    shares = [
        sum(map(operator.eq, words, words[1:])) / n, min(text.count("|") / n, 1.0), min(text.count("!") / n, 3.0),
        min(sum(map(text.count, SYMBOLS)) / n, 3.0), sum(map(str.isupper, words)) / n, 1.0 / n,
    ]
    return np.fromiter(columns, np.int32, len(columns)), shares


def grades(labels: DataFrame) -> DataFrame:
    """Graded ratings of labelled documents, ``doc_id, grade``: 0 toxic, 1 junk, 2 good.

    A missing toxic flag counts as 0; rows without quality that are not toxic
    and rows without id are left out; of several labels the lowest grade holds.
    """
    grade = F.when(F.coalesce(F.col("toxic"), F.lit(0)) != 0, 0).when(F.col("quality") == 0, 1).when(F.col("quality").isNotNull(), 2)
    return labels.where("doc_id is not null").groupBy("doc_id").agg(F.min(grade).alias("grade")).where("grade is not null")


def _featurize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    memory: Memory = {}
    for batch in batches:
        both = [features(t, memory) for t in batch["text"]]
        yield pd.DataFrame({
            "grade": batch["grade"].astype("int32"),
            "columns": [np.sort(c).tobytes() for c, _ in both],
            "shares": [np.asarray(s).tobytes() for _, s in both],
        })


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Features of at most ``sample`` labelled documents, at most the same number of each grade.

    The bound is on labelled rows only, all of which are counted.  The pick
    follows a hash of the id, not the partitions: a hash threshold per grade
    leaves about twice the rows wanted and only those narrow rows are ranked.
    """
    small_batches(docs)
    graded = grades(labels)
    each = sample // len(GRADES)
    order = F.xxhash64("doc_id", F.lit(7))
    share = F.lit(1.0)
    for r in graded.groupBy("grade").agg(F.count("*").alias("n")).collect():
        share = F.when(F.col("grade") == r["grade"], F.lit(min(1.0, 2.0 * each / r["n"]))).otherwise(share)
    near = graded.where(F.pmod(order, F.lit(1 << 20)) <= share * (1 << 20))
    picked = near.withColumn("r", F.row_number().over(W.partitionBy("grade").orderBy(order, "doc_id"))).where(F.col("r") <= each)
    ids = F.broadcast(picked.select("doc_id", "grade").limit(sample))
    rows = docs.select("doc_id", whole_text().alias("text")).join(ids, "doc_id").groupBy("doc_id", "grade").agg(F.min("text").alias("text"))
    return rows.select("grade", "text").mapInPandas(_featurize, "grade int, columns binary, shares binary")


def _fit(rows: list, epochs: int, step: float, l2: float) -> Model:
    """Batch gradient steps, scaled per weight, on the ordinal likelihood.

    Only hashed columns that mark the lowest grade get a weight: with presence
    features, columns that occur everywhere would only add noise to long
    documents.  The thresholds are ordered by construction: the first is free
    and the second lies a positive step above.
    """
    rows = sorted(rows, key=lambda r: (r["grade"], bytes(r["columns"]), bytes(r["shares"])))
    y = np.array([r["grade"] for r in rows], dtype=np.int64)
    parts = [np.frombuffer(r["columns"], np.int32) for r in rows]
    owner = np.repeat(np.arange(len(rows)), [len(p) for p in parts])
    cols = np.concatenate(parts).astype(np.int64)
    shares = np.stack([np.frombuffer(r["shares"]) for r in rows]) * SHAPE_SCALE

    low = y == 0
    inside = np.bincount(cols[low[owner]], minlength=WIDTH)
    outside = np.bincount(cols[~low[owner]], minlength=WIDTH)
    lift = ((inside + 0.5) / (low.sum() + 1)) / ((outside + 0.5) / ((~low).sum() + 1))
    chosen = np.flatnonzero((inside >= MIN_DOCS) & (lift >= LIFT))
    place = np.full(WIDTH, -1)
    place[chosen] = np.arange(len(chosen))
    cols = place[cols]
    owner, cols = owner[cols >= 0], cols[cols >= 0]

    weight = (len(y) / (3.0 * np.maximum(np.bincount(y, minlength=3), 1)))[y] ** 0.5
    weight /= weight.sum()
    parameters = [np.zeros(len(chosen)), np.zeros(SHAPES), np.array([-1.0, 0.0])]
    history = [np.full_like(p, 1e-8) for p in parameters]
    for _ in range(epochs):
        words, shapes, free = parameters
        gap = np.exp(free[1])
        s = np.bincount(owner, weights=words[cols], minlength=len(y)) + shares @ shapes
        c0, c1 = _sigmoid(free[0] - s), _sigmoid(free[0] + gap - s)
        p = np.maximum(np.where(y == 0, c0, np.where(y == 1, c1 - c0, 1.0 - c1)), 1e-9)
        d0, d1 = c0 * (1 - c0), c1 * (1 - c1)
        g0 = np.where(y == 0, d0, np.where(y == 1, -d0, 0.0)) / p * weight
        g1 = np.where(y == 1, d1, np.where(y == 2, -d1, 0.0)) / p * weight
        slope = g0 + g1
        steps = (
            np.bincount(cols, weights=slope[owner], minlength=len(chosen)) + l2 * words,
            shares.T @ slope,
            np.array([-slope.sum(), -g1.sum() * gap]),
        )
        for parameter, past, gradient in zip(parameters, history, steps, strict=True):
            past += gradient**2
            parameter -= step * gradient / np.sqrt(past)
    words, shapes, free = parameters
    everywhere = np.zeros(WIDTH)
    everywhere[chosen] = words
    return Model(everywhere, shapes * SHAPE_SCALE, np.array([free[0], free[0] + np.exp(free[1])]))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, epochs: int = EPOCHS, step: float = STEP, l2: float = L2) -> Model:
    """Fit on at most ``sample`` labelled documents; without any, everything counts as good."""
    rows = training_rows(docs, labels, sample).collect()
    if not rows:
        return Model(np.zeros(WIDTH), np.zeros(SHAPES), np.array([-60.0, -59.0]))
    return _fit(rows, epochs, step, l2)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` plus ``expected_grade`` (0 to 2), ``p_good`` = P(grade 2) and ``keep`` = ``p_good >= KEEP_AT``.

    One pass without a shuffle over whole texts; what is broadcast is the model,
    ``WIDTH`` numbers whatever the input.  A null text counts as empty; columns
    of the three names in the input are replaced; an empty table stays empty.
    """
    small_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast((model.words.astype("float32").tobytes(), model.shapes.tolist(), model.thresholds.tolist()))

    @F.pandas_udf("expected_grade double, p_good double")
    def graded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words, shapes, thresholds = shared.value
        own = Model(np.frombuffer(words, np.float32), np.asarray(shapes), np.asarray(thresholds))
        memory: Memory = {}
        for texts in batches:
            both = [features(t, memory) for t in texts]
            shares = np.array([s for _, s in both], dtype=float).reshape(len(both), SHAPES)
            tail = own.tails(own.scores([c for c, _ in both], shares))
            yield pd.DataFrame({"expected_grade": tail.sum(axis=1), "p_good": tail[:, -1]})

    names = [c for c in docs.columns if c not in ("expected_grade", "p_good", "keep", "_graded")]
    out = docs.select(*names, graded(whole_text(text)).alias("_graded"))
    return out.select(*names, "_graded.expected_grade", "_graded.p_good", (F.col("_graded.p_good") >= KEEP_AT).alias("keep"))
