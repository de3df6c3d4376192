"""Line dedup by winnowing over line hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm.base import WORD, free, let, materialize, whole_text

#: A repeated run of whole lines is deleted from this many words on.
MIN_WORDS = 10


def _lines(text: Column, min_words: int) -> Column:
    """Lines that hold a word: array of (line number, hash, words); ``min_words`` stands for any larger number of words."""
    space = WORD.replace("^", "").rstrip("+")
    many = rf"^{space}*+(?:{WORD}+{space}++){{{min_words - 1}}}[^\x20\x09-\x0D]"

    def words(line: Column) -> Column:
        return F.when(F.rlike(line, F.lit(many)), min_words).otherwise(F.regexp_count(line, F.lit(WORD)))

    every = F.transform(F.split(text, "\n"), lambda line, i: F.struct(i.alias("no"), F.xxhash64(line).alias("h"), words(line).alias("n")))
    return F.filter(every, lambda x: x["n"] > 0)


def _window(lines: Column, i: Column, step: int, min_words: int) -> Column:
    """The shortest run of lines from ``i`` on (backwards for step -1) with ``min_words`` words, or null.

    A line has a word at least, so ``min_words`` lines are always enough.
    """
    at = [F.get(lines, i + step * k) for k in range(min_words)]
    words, run = F.lit(0), F.lit(None).cast("struct<first:int,last:int,content:bigint,mark:struct<h:bigint,no:int>>")
    cases = []
    for k in range(min_words):
        words = words + at[k]["n"]
        hashes = [x["h"] for x in (at[: k + 1] if step > 0 else at[k::-1])]
        ends = (at[0]["no"], at[k]["no"]) if step > 0 else (at[k]["no"], at[0]["no"])
        marks = [F.struct(x["h"].alias("h"), x["no"].alias("no")) for x in at[: k + 1]]
        mark = F.least(*marks) if k else marks[0]
        cases.append((words >= min_words, F.struct(ends[0].alias("first"), ends[1].alias("last"), F.xxhash64(*hashes).alias("content"), mark.alias("mark"))))
    for found, value in reversed(cases):
        run = F.when(found, value).otherwise(run)
    return run


def repeated_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Line numbers to delete: one row ``<key>, text_hash, gone`` per document that has any.

    A window is a shortest run of consecutive lines (lines without words are
    passed over) with ``min_words`` words.  Its fingerprint is the line of the
    smallest hash in it, so two documents that share a run of ``min_words``
    words in whole lines always share a fingerprint.  Fingerprints are joined by
    their hash: only windows whose fingerprint was selected at two places are
    kept.  Around each such place the match is extended both ways: windows that
    start at a line and windows that end at a line cover, together, every run of
    enough words.  A window that also starts earlier (smaller key, then earlier
    line) is deleted; the first one stays.  Everything is judged on the input.

    Hot lines: counts and first places are partial aggregates; the joins back
    have a plain shuffle on both sides, so that adaptive execution can split a
    hot fingerprint.
    """
    lined = docs.select(F.col(key).alias("key"), F.xxhash64(whole_text(text)).alias("text_hash"), _lines(whole_text(text), min_words).alias("lines"))
    size = F.size("lines")
    places = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    forward = F.transform(places, lambda i: _window(F.col("lines"), i, 1, min_words))
    backward = F.transform(places, lambda i: _window(F.col("lines"), i, -1, min_words))
    found = lined.select("key", "text_hash", F.explode(F.array_distinct(F.filter(F.concat(forward, backward), lambda w: w.isNotNull()))).alias("w"))
    windows = materialize(found.select("key", "text_hash", "w.first", "w.last", "w.content", F.col("w.mark.h").alias("mark"), F.col("w.mark.no").alias("at")), "windows")

    selected = windows.select("mark", "key", "text_hash", "at").distinct()
    often = selected.groupBy("mark").agg(F.count("*").alias("n")).where("n > 1").select("mark")
    anchored = materialize(windows.join(often.hint("merge"), "mark", "left_semi").drop("mark", "at"), "anchored")

    place = F.struct("key", "first", "text_hash")
    firsts = anchored.groupBy("content").agg(F.min(place).alias("start"), F.max(place).alias("end")).where("start < end").select("content", "start")
    later = anchored.join(firsts.hint("merge"), "content").where(F.col("start") < place)
    gone = later.groupBy("key", "text_hash").agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    gone = gone.withColumn("gone", F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["first"], r["last"])))))
    return gone.select(F.col("key").alias(key), "text_hash", "gone")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without later repeated runs of lines, plus ``n_lines`` and ``n_removed``.

    Returns the columns of ``docs`` with the text cut (and ``n_chars``, if it is
    there, counted anew), then ``n_lines`` and ``n_removed``.  Lines without a
    word inside a deleted run go with it.  Null text: stays null, no lines.
    Rows that repeat key and text are one document: they get the same text.
    Rows that repeat only the key are told apart by the text.  A null key is
    the smallest.  Extra columns pass through, ``n_lines`` and ``n_removed`` of
    the input excepted.
    """
    plain = docs.drop("n_lines", "n_removed")
    of, own, twin, gone, cut = (free(plain, name) for name in ("_of", "_own", "_twin", "_gone", "_cut"))
    runs = repeated_runs(docs, key, text, min_words).select(F.col(key).alias(of), F.col("text_hash").alias(twin), F.col("gone").alias(gone))
    joined = plain.withColumn(own, F.xxhash64(whole_text(text))).join(runs, (F.col(key).eqNullSafe(F.col(of))) & (F.col(own) == F.col(twin)), "left")
    lines = F.split(F.col(text), "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    shorter = let(lines, lambda every: F.array_join(F.transform(stay, lambda i: F.get(every, i)), "\n"))
    counts = {
        "n_lines": F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(lines)),
        "n_removed": F.when(F.col(gone).isNull(), F.lit(0)).otherwise(F.size(gone)),
        cut: F.when(F.col(gone).isNull(), F.col(text)).otherwise(shorter),
    }
    out = joined.withColumns(counts).withColumn(text, F.col(cut))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length(text), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return out.select(*plain.columns, "n_lines", "n_removed")
