"""Toxicity: hidden words are restored by a noisy channel, then the restored text is scored."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm.base import materialize, small, small_batches, whole_text

#: Letters a to z after the boundary, which is symbol 0; the language model looks back three symbols.
LETTERS = 27
CONTEXTS = LETTERS**3
#: Occurrences that the next shorter context is worth.
BACKOFF = 4.0
#: Costs of the channel, as negative natural logarithms.
LEET_COST = 1.5
WILD_COST = 4.0
DROP_COST = 2.0
BREAK_COST = 1.0
APART_COST = 1.0
SQUEEZE_COST = 5.0
LONG_RUN_COST = 0.5
#: Training documents a class, about (a hash threshold), and words that may carry a weight, at most.
SAMPLE = 9_000
FORMS = 4_096
#: Forms of a restored word: itself, and its beginnings of these lengths.
STEMS = (4, 6)
#: A form that makes up one word in so many (and occurs twice) counts as frequent besides.
RATE = 200
#: A form takes part if so many toxic training documents hold it, and it is so many times as frequent there.
MIN_DOCS = 8
LIFT = 6.0
L2 = 1e-4
FLAG_AT = 0.7
REMEMBERED_WORDS = 200_000

#: Letters that a character may stand for.
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i",
    "α": "a", "ε": "e", "ι": "i", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "ν": "v",
}
SEPARATORS = ".,-_'`~^*\"/\\#%&:;"
EDGES = ".,;:?!\"'`()[]{}<>-_~^*#$%&@|/\\+="

_MARKS = re.compile("[̀-ͯ]+")
_PLAIN = re.compile(r"[^\W\d_]+")
_DOUBLE = re.compile(r"(.)\1")
_RUN = re.compile(r"(.)\1*", re.S)
_LATIN = re.compile("[a-z]")
_SPACED = re.compile(r"(?<!\S)[a-z0-9@$!|](?:[ .\-_*]{1,2}[a-z0-9@$!|]){2,}(?!\S)")
_ASCII = bytes(range(97, 123))
_TO_LETTERS = bytes(c if c in _ASCII else 32 for c in range(256))
_TO_SYMBOL = np.array([c - 96 if c in _ASCII else 0 for c in range(256)], np.uint8)


def plain(text: str) -> str:
    """Lower case, compatibility forms (full width, ligatures) resolved, accents gone."""
    text = text.lower()
    return text if text.isascii() else _MARKS.sub("", unicodedata.normalize("NFKD", text).lower())


def count_symbols(texts: list[str]) -> np.ndarray:
    """How often each of the LETTERS ** 4 runs of four symbols occurs in the words of the texts; words begin after three boundaries."""
    words = b"\n".join(plain(t).encode("ascii", "ignore") for t in texts).translate(_TO_LETTERS).split()
    s = _TO_SYMBOL[np.frombuffer(b"\0\0\0" + b"\0\0\0".join(words) + b"\0", np.uint8)].astype(np.int32)
    if len(s) < 4:
        return np.zeros(LETTERS**4, np.int64)
    return np.bincount(((s[:-3] * LETTERS + s[1:-2]) * LETTERS + s[2:-1]) * LETTERS + s[3:], minlength=LETTERS**4)


def costs(counts: np.ndarray) -> np.ndarray:
    """Negative log probability of a symbol after three others; shorter contexts stand in where longer ones are rare."""
    c4 = counts.reshape([LETTERS] * 4).astype(float)
    # after "x00" a word begins like after "000": boundaries are counted once
    p = (c4.sum(axis=(0, 1, 2)) + 0.5) / (c4.sum() + 0.5 * LETTERS)
    for axes in ((0, 1), (0,), ()):
        c = c4.sum(axis=axes) if axes else c4
        p = (c + BACKOFF * p) / (c.sum(axis=-1, keepdims=True) + BACKOFF)
    return -np.log(p).reshape(CONTEXTS, LETTERS)


class Decoder:
    """Restores tokens under a character language model, each distinct token once."""

    def __init__(self, cost: np.ndarray) -> None:
        self.cost = cost.tolist()
        self.memory: dict[str, tuple[str, ...]] = {}

    def _options(self, char: str, n: int, spaced: bool) -> list[tuple[str, float]]:
        """What a run of ``n`` equal characters may stand for: letters, a boundary (a space), or nothing."""
        if "a" <= char <= "z":
            if n == 1:
                return [(char, 0.0)]
            return [(char, SQUEEZE_COST if n == 2 else LONG_RUN_COST), (char * 2, 0.0 if n == 2 else LONG_RUN_COST)]
        out = [(" ", APART_COST if spaced and char == " " else BREAK_COST)]
        for letter in LOOKS_LIKE.get(char, ""):
            out.append((letter, LEET_COST + (n > 1) * LONG_RUN_COST))
            if n > 1:
                out.append((letter * 2, LEET_COST + LONG_RUN_COST))
        if char in SEPARATORS or char == " ":
            out.append(("", 0.0 if spaced else DROP_COST))
        if char == "*":
            out += [(chr(c), WILD_COST) for c in _ASCII]
        return out

    def viterbi(self, token: str, spaced: bool = False) -> str:
        """The cheapest reading of the lattice of a token: channel costs plus those of the language model.

        One state per context of three symbols, so the work is linear in the
        length, and a state only links to the one before.
        """
        cost = self.cost
        states: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
        for run in _RUN.finditer(token):
            options = self._options(run.group(1), len(run.group()), spaced)
            after: dict[int, tuple[float, tuple | None]] = {}
            for state, (spent, back) in states.items():
                for letters, price in options:
                    total, at = spent + price, state
                    if letters == " ":
                        if at:
                            total, at = total + cost[at][0], 0
                    else:
                        for c in letters:
                            symbol = ord(c) - 96
                            total += cost[at][symbol]
                            at = (at * LETTERS + symbol) % CONTEXTS
                    old = after.get(at)
                    if old is None or total < old[0]:
                        after[at] = (total, (letters, back) if letters else back)
            states = after
        best = min(((total + (cost[at][0] if at else 0.0), at) for at, (total, _) in states.items()))[1]
        back, out = states[best][1], []
        while back is not None:
            out.append(back[0])
            back = back[1]
        return "".join(reversed(out))

    def token(self, token: str) -> tuple[str, ...]:
        """Words that a token stands for."""
        found = self.memory.get(token)
        if found is None:
            bare = token.strip(EDGES)
            if _PLAIN.fullmatch(bare) and not _DOUBLE.search(bare) and bare.isascii() or not _LATIN.search(token):
                found = (bare,) if bare else ()
            else:
                head = token.lstrip(EDGES) if token[0] not in LOOKS_LIKE else token
                tail = head.rstrip(EDGES) if head[-1] not in LOOKS_LIKE or _DOUBLE.fullmatch(head[-2:]) else head
                found = tuple(self.viterbi(tail).split())
            if len(self.memory) >= REMEMBERED_WORDS:
                self.memory = {}
            self.memory[token] = found
        return found

    def spelled(self, text: str) -> str:
        """Plain text in which single characters set apart are read together where the model prefers it."""
        return _SPACED.sub(lambda m: self.viterbi(m.group(), True), plain(text))

    def restore(self, text: str) -> list[str]:
        """Words of the restored text, in order."""
        return [w for t in self.spelled(text).split() for w in self.token(t)]


def forms_of(word: str) -> list[str]:
    return [word, *(f"{word[:n]}-" for n in STEMS if len(word) >= n)]


class Marks:
    """Forms that the tokens of a text stand for, each distinct token worked out once; only ``kept`` ones if given."""

    def __init__(self, cost: np.ndarray, kept: set[str] | None = None) -> None:
        self.decoder = Decoder(cost)
        self.kept = kept
        self.memory: dict[str, list[str]] = {}

    def of(self, text: str) -> set[str]:
        """Forms of the restored words of a text; those that are frequent in it a second time with a plus."""
        tokens = Counter(self.decoder.spelled(text).split())
        counts: Counter[str] = Counter()
        for token, n in tokens.items():
            found = self.memory.get(token)
            if found is None:
                found = [f for w in self.decoder.token(token) for f in forms_of(w) if self.kept is None or f in self.kept]
                if len(self.memory) >= REMEMBERED_WORDS:
                    self.memory = {}
                self.memory[token] = found
            for form in found:
                counts[form] += n
        total = tokens.total()
        return set(counts) | {f"{f}+" for f, n in counts.items() if n > 1 and n * RATE >= total}


@dataclass(frozen=True)
class Model:
    """Costs of the language model, weights of forms (frequent ones end in a plus) and the intercept."""

    cost: np.ndarray
    weights: dict[str, float]
    intercept: float


def fit_language_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Symbol costs from all texts: tasks count, sums by run of symbols are of fixed size whatever the input."""
    small_batches(docs)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(LETTERS**4, np.int64)
        for batch in batches:
            total += count_symbols(batch["text"].tolist())
        used = np.flatnonzero(total)
        yield pd.DataFrame({"run": used.astype(np.int32), "n": total[used]})

    rows = docs.select(whole_text(text).alias("text")).mapInPandas(count, "run int, n long")
    table = rows.groupBy("run").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(LETTERS**4, np.int64)
    counts[table["run"].to_numpy()] = table["n"].to_numpy()
    return costs(counts)


def held_out(key: Column) -> Column:
    """Rows that are never learned from: crc32 of the key as text leaves 1 when divided by 3; a null key is not held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def restored(docs: DataFrame, cost: np.ndarray, text: str = "text", out: str = "restored") -> DataFrame:
    """``docs`` plus the restored text, its words parted by spaces."""
    small_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(cost.astype(np.float32).tobytes())

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decoder = Decoder(np.frombuffer(shared.value, np.float32).reshape(CONTEXTS, LETTERS))
        for batch in batches:
            yield pd.Series([" ".join(decoder.restore(t)) for t in batch], dtype=object)

    return docs.withColumn(out, run(whole_text(text)))


def training_forms(docs: DataFrame, labels: DataFrame, cost: np.ndarray, sample: int = SAMPLE) -> DataFrame:
    """``label, forms`` of about ``sample`` documents of each class at most, held-out rows left out.

    The share of a class that is taken follows from its size, the pick from a
    hash of the id; of several labels of an id the highest holds.  Of texts with
    one label whose least five-word shingle (by hash) is the same, as most near
    copies have it, one is kept: the words of a much copied text say no more
    than those of one document.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max((F.col("toxic") != 0).cast("int")).alias("label"))
    share = F.lit(0.0)
    for r in known.groupBy("label").agg(F.count("*").alias("n")).collect():
        share = F.when(F.col("label") == r["label"], F.lit(min(1.0, sample / r["n"]))).otherwise(share)
    ids = small(known.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20)) < share * (1 << 20)))
    rows = docs.select("doc_id", whole_text().alias("text")).join(ids, "doc_id").select("label", "text")
    shared = docs.sparkSession.sparkContext.broadcast(cost.astype(np.float32).tobytes())

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        marks = Marks(np.frombuffer(shared.value, np.float32).reshape(CONTEXTS, LETTERS))
        for batch in batches:
            least = []
            for t in batch["text"]:
                w = plain(t).split()
                least.append(min(xxhash.xxh64_intdigest(" ".join(w[i : i + 5])) for i in range(max(1, len(w) - 4))) >> 1)
            yield pd.DataFrame({"label": batch["label"], "least": least, "forms": [sorted(marks.of(t)) for t in batch["text"]]})

    small_batches(docs)
    read_rows = rows.mapInPandas(read, "label int, least long, forms array<string>")
    return read_rows.groupBy("label", "least").agg(F.min("forms").alias("forms")).select("label", "forms")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Language model of all texts; weights by logistic regression over forms that mark the toxic training documents.

    Forms are counted over the training rows by grouped aggregation and the
    ``FORMS`` of the most evidence stay.  Without both labels no form has a
    weight and the score is the share of label 1 among the known rows, or 0.
    """
    cost = fit_language_model(docs)
    rows = materialize(training_forms(docs, labels, cost, sample), "toxic")
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return Model(cost, {}, 60.0 if n1 else -60.0)
    counts = rows.select("label", F.explode("forms").alias("form")).groupBy("form").agg(
        F.count_if(F.col("label") == 1).alias("c1"), F.count_if(F.col("label") == 0).alias("c0"))
    p1, p0 = (F.col("c1") + 0.5) / (n1 + 1.0), (F.col("c0") + 0.5) / (n0 + 1.0)
    marking = counts.where((F.col("c1") >= MIN_DOCS) & (p1 >= LIFT * p0))
    evidence = F.col("c1") * F.log(p1 / p0)
    forms = [r["form"] for r in marking.orderBy(evidence.desc(), "form").limit(FORMS).collect()]
    if not forms:
        return Model(cost, {}, float(np.log(n1 / n0)))
    vectors = CountVectorizerModel.from_vocabulary(forms, inputCol="forms", outputCol="x")
    vectors.setBinary(True)
    data = vectors.transform(rows.select(F.col("label").cast("double").alias("label"), "forms")).select("label", "x")
    data = materialize(data, "vectors")
    model = LogisticRegression(featuresCol="x", labelCol="label", regParam=L2, elasticNetParam=0.0, standardization=False, maxIter=200).fit(data)
    return Model(cost, dict(zip(forms, model.coefficients.toArray().tolist(), strict=True)), float(model.intercept))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` plus ``score`` (P(label 1), from the restored words of the whole text) and ``predicted`` (1 from FLAG_AT).

    One pass without a shuffle; broadcast are the language model and at most
    FORMS weights.  A form counts once, or twice where it is frequent, however
    long the text.  Null and empty texts score the intercept; repeated rows
    score alike; columns of the two names are replaced; an empty table stays
    empty.
    """
    small_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast((model.cost.astype(np.float32).tobytes(), model.weights, model.intercept))

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cost, weights, intercept = shared.value
        marks = Marks(np.frombuffer(cost, np.float32).reshape(CONTEXTS, LETTERS), {f.rstrip("+") for f in weights})
        for batch in batches:
            sums = np.array([intercept + sum(sorted(weights.get(f, 0.0) for f in marks.of(t))) for t in batch], dtype=float)
            yield pd.Series(1.0 / (1.0 + np.exp(-np.clip(sums, -60, 60))))

    names = [c for c in docs.columns if c not in ("score", "predicted")]
    scored = docs.select(*names, run(whole_text(text)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= FLAG_AT).cast("int"))
