"""Document fingerprints: SimHash of weighted terms and a search by permuted block tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmark.llm.base import WORD, key_runs, let, materialize, whole_text

BITS = 64
#: Words of a term.
TERM = 5
#: Documents are laid out in runs of about this many, by ascending id, to find each one's successor.
RUN_ROWS = 500
MOST_RUNS = 4096
#: Largest Hamming distance that a search reports, and the blocks a fingerprint is cut into for it.
RADIUS = 3
BLOCKS = 6


def term_hashes(text: Column) -> Column:
    """Hashes of all terms of a text, repeats included: runs of TERM words; a shorter text is one term, an empty one none."""

    def terms(words: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(words) - TERM)
        none = F.array().cast("array<bigint>")
        few = F.when(F.size(words) > 0, F.array(F.xxhash64(words))).otherwise(none)
        return F.when(F.size(words) >= TERM, F.transform(starts, lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(TERM))))).otherwise(few)

    hashed = F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))
    return let(hashed, terms)


def fingerprints(texts: DataFrame, keys: list[str], terms: str = "terms") -> DataFrame:
    """``<keys>, times, fingerprint`` (64-bit long): bit b is set if the terms with bit b outweigh those without.

    A term weighs as much as it occurs.  Votes are summed two bits at a time: a
    hash shifted by b and masked to bits 0 and 32 adds to two counters in one
    long, so 32 sums hold all 64 counts (texts of up to 2^31 terms).  Partial
    sums leave a task as one row a document.  No terms: fingerprint 0; ties
    leave the bit unset.  Rows of equal keys add up, and ``times`` counts them.
    """
    pairs = [F.sum(F.shiftrightunsigned(F.col("h"), b).bitwiseAND(0x100000001)).alias(f"v{b}") for b in range(BITS // 2)]
    votes = texts.select(*keys, F.posexplode_outer(terms).alias("pos", "h")).groupBy(*keys).agg(
        F.count("h").alias("n"), F.count_if(F.coalesce(F.col("pos"), F.lit(0)) == 0).alias("times"), *pairs)
    bit = F.lit(0).cast("long")
    for b in range(BITS // 2):
        low, high = F.col(f"v{b}").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(F.col(f"v{b}"), 32)
        bit = bit.bitwiseOR(F.when(low * 2 > F.col("n"), F.lit(1 << b).cast("long")).otherwise(F.lit(0).cast("long")))
        top = 1 << (b + 32)
        bit = bit.bitwiseOR(F.when(high * 2 > F.col("n"), F.lit(top - (1 << 64) if top >= 1 << 63 else top).cast("long")).otherwise(F.lit(0).cast("long")))
    return votes.select(*keys, "times", bit.alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits, 0 to 1."""
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def with_next_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``<key>, text, next_text``: the text of the document next in ascending order of the integer key; after the last, the first's.

    Rows of one key follow each other by text; a null key comes first.  The
    order is cut at quantiles of the key into runs of about ``RUN_ROWS`` rows
    (longer ones beyond ``MOST_RUNS`` runs); each run gets a copy of the first
    row of the run after it, so that a window within the run sees every
    successor and whole texts are shuffled once.
    """
    rows = docs.select(F.col(key).alias("key"), whole_text(text).alias("text"))
    rows = rows.withColumn("run", key_runs(rows, "key", RUN_ROWS, MOST_RUNS))

    # the first key of each run; a null key comes before all others
    heads = rows.groupBy("run").agg(F.min(F.struct(F.col("key").isNotNull().alias("known"), "key")).alias("head")).orderBy("run").collect()
    if not heads:
        return rows.select(F.col("key").alias(key), "text", F.col("text").alias("next_text"))
    key_type = rows.schema["key"].dataType.simpleString()
    goes_to = [(h["head"]["key"], h["run"], heads[i - 1]["run"]) for i, h in enumerate(heads)]
    at = F.broadcast(docs.sparkSession.createDataFrame(goes_to, f"head_key {key_type}, head_run int, to int"))
    copied = rows.join(at, (F.col("run") == F.col("head_run")) & F.col("key").eqNullSafe(F.col("head_key")))
    copied = copied.groupBy("key", "to").agg(F.min("text").alias("text")).select("key", "text", F.col("to").alias("run"), F.lit(True).alias("copy"))
    wide = rows.withColumn("copy", F.lit(False)).unionByName(copied)
    window = W.partitionBy("run").orderBy("copy", F.col("key").asc_nulls_first(), "text")
    return wide.withColumn("next_text", F.lead("text").over(window)).where("not copy").select(F.col("key").alias(key), "text", "next_text")


def edited_text(text: Column, following: Column) -> Column:
    """``text`` whose last floor(n / 4) code points give way to as many from the start of ``following`` (or all of it)."""
    quarter = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - quarter), F.substring(following, F.lit(1), quarter))


def edit_check(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    ``<key>, n_chars, edited_sha256, fingerprint, edited_fingerprint`` (16 hex
    digits), ``near_edited, near_next``, one row per row of ``docs``.  A null
    text counts as empty; rows of equal key follow each other by text; rows that
    repeat key, text and successor count their terms together, which changes no
    bit.  Extra columns are ignored; an empty table gives no rows.
    """
    paired = with_next_text(docs, key, text).withColumnRenamed(key, "key")
    edited = paired.select("key", F.xxhash64("text").alias("own"), F.xxhash64("next_text").alias("next"), "text", edited_text(F.col("text"), F.col("next_text")).alias("edited"))
    kinds = F.array(
        F.struct(F.lit(0).alias("kind"), term_hashes(F.col("text")).alias("terms")),
        F.struct(F.lit(1).alias("kind"), term_hashes(F.col("edited")).alias("terms")),
    )
    facts = ["key", "own", "next", "n_chars", "edited_sha256"]
    rows = edited.select("key", "own", "next", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.inline(kinds))
    prints = fingerprints(rows, [*facts, "kind"])
    prints = materialize(
        prints.groupBy(*facts).agg(
            F.max("times").alias("times"),
            F.max(F.when(F.col("kind") == 0, F.col("fingerprint"))).alias("fingerprint"),
            F.max(F.when(F.col("kind") == 1, F.col("fingerprint"))).alias("edited_fingerprint"),
        ),
        "prints",
    )
    known = prints.groupBy(F.col("own").alias("of")).agg(F.max("fingerprint").alias("next_fingerprint"))
    out = prints.join(known.hint("merge"), F.col("next") == F.col("of")).withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return out.select(
        F.col("key").alias(key), "n_chars", "edited_sha256", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"),
        F.lpad(F.lower(F.hex("edited_fingerprint")), 16, "0").alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def _masks(radius: int, blocks: int) -> list[int]:
    """For every choice of ``blocks - radius`` of the blocks, the bits in them (as a signed long)."""
    edges = [i * BITS // blocks for i in range(blocks + 1)]
    masks = [sum(((1 << (edges[c + 1] - edges[c])) - 1) << edges[c] for c in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def block_tables(prints: DataFrame, fingerprint: str = "fingerprint", radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """``prints`` once per table, with ``table`` and ``block``.

    Cut into ``blocks`` blocks, two fingerprints that differ in at most
    ``radius`` bits agree on ``blocks - radius`` whole blocks.  There is a table
    for every choice of so many: its blocks come first (as a mask) and are what
    is joined on, about half the bits with the default.
    """
    keys = [F.struct(F.lit(i).alias("table"), F.col(fingerprint).bitwiseAND(F.lit(m).cast("long")).alias("block")) for i, m in enumerate(_masks(radius, blocks))]
    return prints.select("*", F.inline(F.array(*keys)))


def within_radius(queries: DataFrame, prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """All distinct fingerprints within ``radius`` bits of each distinct query: ``query, fingerprint, distance``.

    Both sides hold a long column ``fingerprint``; copies meet once and a pair
    that agrees in several tables is kept in the first of them.  A query that
    is among ``prints`` finds itself.  Nulls find nothing.
    """
    distinct = [x.select("fingerprint").where("fingerprint is not null").distinct() for x in (queries, prints)]
    q, p = (block_tables(x, radius=radius, blocks=blocks) for x in distinct)
    pairs = q.withColumnRenamed("fingerprint", "query").join(p, ["table", "block"])
    apart = F.col("query").bitwiseXOR(F.col("fingerprint"))
    first = F.lit(None).cast("int")
    for number, mask in reversed(list(enumerate(_masks(radius, blocks)))):
        first = F.when(apart.bitwiseAND(F.lit(mask).cast("long")) == 0, F.lit(number)).otherwise(first)
    pairs = pairs.withColumn("distance", F.bit_count(apart)).where((F.col("distance") <= radius) & (F.col("table") == first))
    return pairs.select("query", "fingerprint", "distance")
