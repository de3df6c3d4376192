"""Language of web pages: text, declared language, address suffix and host priors, fused by Bayes' rule."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmark.llm.base import materialize, small, small_batches, whole_text

#: Labelled documents that the text model is fitted on, at most, in equal bounds for each language.
SAMPLE = 4_000
#: Languages whose counts a task holds before it passes them on.
HELD = 64
#: Hashed byte 4-grams of the text model, and its smoothing.
BINS = 1 << 16
ADD = 0.5
#: Grams that count in full; the evidence of longer texts is scaled to so many, as neighbours are not independent.
EVIDENCE_GRAMS = 60.0
#: Pages that the smoothed priors of a host, and of a domain, are worth.
HOST_WEIGHT = 8.0
DOMAIN_WEIGHT = 20.0
#: Pages that the smoothing of declared languages and suffixes is worth.
SIGNAL_WEIGHT = 5.0

_HIDDEN = re.compile(r"(?is)<(script|style)\b.*?(?:</\1\s*>|$)|<!--.*?(?:-->|$)")


def without_tags(text: str) -> str:
    """A space in place of every stretch from a ``<`` to the next ``>``, in one pass; a ``<`` that is never closed stays."""
    out, at = [], 0
    while True:
        start = text.find("<", at)
        end = text.find(">", start) if start >= 0 else -1
        if end < 0:
            out.append(text[at:])
            return " ".join(out)
        out.append(text[at:start])
        at = end + 1


def visible_text(page: str) -> str:
    """Text without markup, scripts, styles and comments; entities are resolved."""
    if "<" not in page:
        return entities.unescape(page)
    return entities.unescape(without_tags(_HIDDEN.sub(" ", page)))


def grams(text: str) -> np.ndarray:
    """Hashed byte 4-grams of the lower-case text, runs of white space as one space."""
    raw = np.frombuffer(" ".join(f" {text} ".lower().split()).join("  ").encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    if len(raw) < 4:
        return np.empty(0, np.int64)
    four = raw[:-3] | raw[1:-2] << np.uint32(8) | raw[2:-1] << np.uint32(16) | raw[3:] << np.uint32(24)
    return ((four * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


@dataclass(frozen=True)
class TextModel:
    """Languages in code point order and the log probability of each bin in each (BINS x languages)."""

    languages: tuple[str, ...]
    log_p: np.ndarray

    def evidence(self, text: str) -> np.ndarray:
        """Scaled log likelihood of each language; zeros for a text without grams."""
        g = grams(text)
        if len(g) == 0:
            return np.zeros(len(self.languages))
        return self.log_p[g].mean(axis=0) * min(len(g), EVIDENCE_GRAMS)


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: dict[str, np.ndarray] = {}

    def flush() -> Iterator[pd.DataFrame]:
        for lang, counts in total.items():
            used = np.flatnonzero(counts)
            yield pd.DataFrame({"lang": lang, "bin": used.astype("int32"), "n": counts[used]})
        total.clear()

    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            if lang not in total:
                if len(total) >= HELD:
                    yield from flush()
                total[lang] = np.zeros(BINS, np.int64)
            total[lang] += np.bincount(grams(text), minlength=BINS)
    yield from flush()


def fit_text(docs: DataFrame, sample: int = SAMPLE, text: str = "text", lang: str = "lang", key: str = "doc_id") -> TextModel:
    """Fit on at most ``sample`` labelled documents, at most the same number of each language (one at least).

    Null texts and labels are left out.  All labelled rows are counted, so every
    language among them with a gram is in the model, however rare.  The pick
    follows a hash of key and text, not the partitions: a threshold per language
    leaves about twice the rows wanted, of which hashes alone are ranked; rows
    repeated at the last hash all count.  Grams are counted by tasks and summed
    by language and bin; what comes to the driver is the table of the model,
    BINS numbers a language.
    """
    small_batches(docs)
    span = 1 << 40
    order = F.pmod(F.xxhash64(key, text, F.lit(11)), F.lit(span))
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), order.alias("r"))
    counted = materialize(labelled.groupBy("lang").agg(F.count("*").alias("n"), F.min("r").alias("least")), "languages")
    each = max(1, sample // max(counted.count(), 1))
    near = F.greatest(F.col("least"), (F.least(F.lit(1.0), (2.0 * each + 64.0) / F.col("n")) * span).cast("long"))
    ranked = labelled.join(small(counted), "lang").where(F.col("r") <= near).select("lang", "r")
    ranked = ranked.withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy("r"))).where(F.col("place") <= each)
    last = materialize(ranked.groupBy("lang").agg(F.max("r").alias("last")), "last")
    picked = labelled.join(small(last), "lang").where(F.col("r") <= F.col("last")).select("lang", "text")
    table = picked.mapInPandas(_counts, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()
    languages = tuple(sorted(table["lang"].unique()))
    counts = np.full((BINS, len(languages)), ADD)
    for i, name in enumerate(languages):
        own = table[table["lang"] == name]
        counts[own["bin"].to_numpy(), i] += own["n"].to_numpy()
    return TextModel(languages, np.log(counts / counts.sum(axis=0)))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def address(url: Column) -> dict[str, Column]:
    """Host (lower case, without user and port), its last two labels, and its last one; empty where there is none."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return {"host": host, "domain": F.substring_index(host, ".", -2), "suffix": F.substring_index(host, ".", -1)}


def declared_language(page: Column) -> Column:
    """Primary part of the lang attribute of the html element, lower case; null without one."""
    found = F.lower(F.regexp_extract(F.coalesce(page, F.lit("")), r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,8})", 1))
    return F.when(found != "", found)


def text_evidence(pages: DataFrame, model: TextModel, key: str, url: str, html: str) -> DataFrame:
    """One narrow row a page: its address parts, declared language, text evidence and text-only posterior."""
    small_batches(pages)
    shared = pages.sparkSession.sparkContext.broadcast((model.languages, model.log_p.astype("float32")))

    @F.pandas_udf("evidence array<double>, posterior array<double>")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = TextModel(*shared.value)
        for series in batches:
            e = np.array([own.evidence(visible_text(p)) for p in series], dtype=float).reshape(len(series), len(own.languages))
            yield pd.DataFrame({"evidence": list(e), "posterior": list(_softmax(e)) if len(e) else []})

    parts = address(F.col(url))
    rows = pages.select(F.col(key).alias("key"), *(c.alias(n) for n, c in parts.items()), declared_language(F.col(html)).alias("declared"), read(whole_text(html)).alias("t"))
    return rows.select("key", *parts, "declared", "t.evidence", "t.posterior")


def identify(pages: DataFrame, model: TextModel, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Language of every page: ``<key>, lang, confidence, text_lang, declared``.

    The log posterior adds up four sources.  Text: a hashed byte 4-gram model.
    Declared language and address suffix: how often pages of a language declare
    it or have it, from sums of text-only posteriors by grouped aggregation.
    Host prior: the language shares of the host's other pages, smoothed towards
    its domain's, which are smoothed towards all pages'.  A page's own text is
    taken out of all these sums.

    Sums are partial aggregates.  Tables by host grow with the data and are
    joined by shuffle (a hot host can be split); tables by suffix and declared
    language are broadcast only if they are small.  Ties: the first language in
    code point order.  Null or empty pages have no text evidence and go by the
    priors; a null address shares one empty host.  Extra columns are ignored,
    repeated rows count and get equal answers, an empty table gives no rows.  A
    model without languages answers null.
    """
    languages = model.languages
    if not languages:
        return pages.select(F.col(key), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("text_lang"), declared_language(F.col(html)).alias("declared"))
    k = range(len(languages))
    rows = materialize(text_evidence(pages, model, key, url, html), "evidence")

    def sums(prefix: str) -> list[Column]:
        return [F.sum(F.col("posterior")[i]).alias(f"{prefix}{i}") for i in k]

    total = rows.agg(F.count("*").alias("n"), *sums("t")).first()
    n = max(total["n"], 1)
    share = [((total[f"t{i}"] or 0.0) + 1.0) / (n + len(languages)) for i in k]
    hosts = rows.groupBy("host", "domain").agg(F.count("*").alias("h_n"), *sums("h"))
    domains = hosts.groupBy("domain").agg(F.sum("h_n").alias("d_n"), *(F.sum(f"h{i}").alias(f"d{i}") for i in k))
    hosts = hosts.join(domains, "domain").drop("domain")
    joined = rows.join(hosts.hint("merge"), "host")

    def prior(i: int) -> Column:
        own = F.col("posterior")[i]
        domain = (F.greatest(F.col(f"d{i}") - own, F.lit(0.0)) + DOMAIN_WEIGHT * share[i]) / (F.col("d_n") - 1 + DOMAIN_WEIGHT)
        return (F.greatest(F.col(f"h{i}") - own, F.lit(0.0)) + HOST_WEIGHT * domain) / (F.col("h_n") - 1 + HOST_WEIGHT)

    score = [F.col("evidence")[i] + F.log(prior(i)) for i in k]
    for signal in ("declared", "suffix"):
        table = rows.where(F.col(signal).isNotNull() & (F.col(signal) != "")).groupBy(F.col(signal).alias(f"{signal}_is")).agg(F.count("*").alias(f"{signal}_n"), *sums(signal))
        joined = joined.join(small(materialize(table, signal)), F.col(signal) == F.col(f"{signal}_is"), "left")
        for i in k:
            own = F.col("posterior")[i]
            here = F.greatest(F.col(f"{signal}{i}") - own, F.lit(0.0)) + SIGNAL_WEIGHT * (F.col(f"{signal}_n") / n)
            everywhere = F.greatest(F.lit(total[f"t{i}"] or 0.0) - own, F.lit(0.0)) + SIGNAL_WEIGHT
            score[i] = score[i] + F.coalesce(F.log(here / everywhere), F.lit(0.0))
    joined = joined.select("key", "declared", "posterior", F.array(*score).alias("score"))

    def first_best(values: Column) -> Column:
        return F.element_at(F.lit(list(languages)), F.array_position(values, F.array_max(values)).cast("int"))

    top = F.array_max("score")
    confidence = F.lit(1.0) / F.aggregate("score", F.lit(0.0), lambda a, s: a + F.exp(s - top))
    return joined.select(F.col("key").alias(key), first_best(F.col("score")).alias("lang"), confidence.alias("confidence"), first_best(F.col("posterior")).alias("text_lang"), "declared")
