"""Merkle manifest of a document table: bitmap ranks give leaf places, keyed slot arrays reduce the levels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmark.llm.base import materialize
from quillmark.operators.ordering import attach
from quillmark.sources.session import bounded

#: Children of a node, and levels that one slot array reduces (so it has at most ARITY ** BLOCK_LEVELS slots).
ARITY = 3
BLOCK_LEVELS = 6
BLOCK = ARITY**BLOCK_LEVELS
#: Most groups whose path to the root is broadcast; more are joined by shuffle, spread over SALTS keys a group.
BROADCAST_GROUPS = 20_000
SALTS = 64
#: Groups that one task ranks.
RANGE_GROUPS = 500_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(value: Column) -> Column:
    """Lower-case hexadecimal sha256."""
    return F.sha2(value, 256)


def field(value: Column) -> Column:
    """``-`` for a null, else UTF-8 byte count, colon and value."""
    written = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(written).cast("string"), F.lit(":"), written), F.lit("-"))


def leaf(*values: Column) -> Column:
    return digest(F.concat(*[field(v) for v in values]))


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf digest leads to, given the siblings on its way up."""
    return F.aggregate(path, start, lambda at, p: digest(F.concat(p["left"], at, p["right"])))


def proof(path: Column) -> Column:
    """All siblings of a path, level by level, left to right, in one string."""
    return F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), "")


def places(rows: DataFrame, group: str, key: str, ties: Sequence[str]) -> DataFrame:
    """``rows`` plus ``pos``, the place from 0 in their group by ascending key, and ``total``, the rows of the group.

    No row is sorted.  The keys of a group are the set bits of 64-bit words;
    only words with a bit exist, so sparse keys cost no more than dense ones.
    Popcount directories over 2^10 words, and then three times over 2^16
    entries, say how many rows come before a word; a rank query adds the bits
    below the own one.  No directory window holds more than 2^16 rows, however
    large the group.  Null keys come first.  Words in which a key is null or
    repeated (their popcount is less than their rows) are ranked apart: equal
    rows are counted, not listed, and ordered by key and then by ``ties``,
    strings of even hashes, whose first three characters split them.
    """
    word = F.shiftright(key, 6)
    bit = F.expr(f"shiftleft(1L, cast(`{key}` & 63 as int))")
    words = rows.groupBy(group, word.alias("w0")).agg(F.bit_or(bit).alias("mask"), F.count(F.lit(1)).alias("n"))
    levels = [words.withColumns({"w1": F.shiftright("w0", 10), "w2": F.shiftright("w0", 26), "w3": F.shiftright("w0", 42)})]
    levels[0] = materialize(levels[0], "bitmap")
    for i in (1, 2, 3):
        finer = levels[-1]
        levels.append(finer.groupBy(group, *[f"w{j}" for j in range(i, 4)]).agg(F.sum("n").alias("n")))

    def ahead(partition: list[str], order: str) -> Column:
        return F.coalesce(F.sum("n").over(W.partitionBy(*partition).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))

    directory = levels[3].select(group, "w3", ahead([group], "w3").alias("before"), F.sum("n").over(W.partitionBy(group)).alias("total"))
    for i in (2, 1, 0):
        finer = levels[i].withColumn("ahead", ahead([group, f"w{i + 1}"], f"w{i}"))
        joined = attach(finer, directory, [group, f"w{i + 1}"], ["before", "total"], "inner")
        kept = ["mask", "n"] if i == 0 else []
        directory = joined.select(group, f"w{i}", *kept, (F.col("before") + F.col("ahead")).alias("before"), "total")

    placed = materialize(attach(rows.withColumn("w0", word), directory, [group, "w0"], ["mask", "n", "before", "total"], "inner"), "ranked")
    repeated = F.col("mask").isNull() | (F.col("n") > F.bit_count("mask"))
    below = F.expr(f"mask & ~shiftleft(-1L, cast(`{key}` & 63 as int))")
    once = placed.where(~repeated).select(*rows.columns, (F.col("before") + F.bit_count(below)).alias("pos"), "total")
    if placed.where(repeated).isEmpty():
        return once

    split = F.substring(F.col(ties[0]), 1, 3)
    equal = placed.where(repeated).groupBy(*rows.columns, "w0", "before", "total", split.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    equal = materialize(equal, "repeated")
    parts = equal.groupBy(group, "w0", key, "part").agg(F.sum("n").alias("n"))
    rank = W.partitionBy(group, "w0").orderBy(key, "part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(group, "w0", key, "part", F.coalesce(F.sum("n").over(rank), F.lit(0)).alias("sooner"))
    inner = W.partitionBy(group, "w0", key, "part").orderBy(*ties).rowsBetween(W.unboundedPreceding, -1)
    listed = equal.withColumn("ahead", F.coalesce(F.sum("n").over(inner), F.lit(0)))
    listed = attach(listed, parts, [group, "w0", key, "part"], ["sooner"], "inner")
    again = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))
    listed = listed.withColumn("copy", again)
    pos = F.col("before") + F.col("sooner") + F.col("ahead") + F.col("copy")
    return once.unionByName(listed.select(*rows.columns, pos.alias("pos"), "total"))


def ranked_groups(groups: DataFrame, group: str) -> DataFrame:
    """``groups`` plus ``pos`` and ``total``: their order by value, null first, ranked range by range."""
    total = groups.count()
    ranges = 1 + total // RANGE_GROUPS
    cut = materialize(groups.repartitionByRange(ranges, F.col(group).asc_nulls_first()).withColumn("range", F.spark_partition_id()), "groups")
    sizes = cut.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select(F.col("range").alias("of"), F.coalesce(F.sum("n").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("sooner"))
    own = F.row_number().over(W.partitionBy("range").orderBy(F.col(group).asc_nulls_first())) - 1
    numbered = cut.withColumn("own", own).join(F.broadcast(sizes), F.col("range") == F.col("of"))
    return numbered.select(*groups.columns, (F.col("sooner") + F.col("own")).alias("pos"), F.lit(total).cast("long").alias("total"))


def _height(total: Column) -> Column:
    """Levels that a block reduces: all of them beside other blocks, else as many as leave one node."""
    out = F.lit(BLOCK_LEVELS)
    for k in range(BLOCK_LEVELS - 1, -1, -1):
        out = F.when(total <= ARITY**k, k).otherwise(out)
    return out


def _parents(nodes: Column) -> Column:
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / ARITY).cast("int"))
    return F.transform(runs, lambda i: digest(F.array_join(F.slice(nodes, i * ARITY + 1, ARITY), "")))


def _way(slot: Column, height: Column) -> Column:
    """Siblings, left and right, of the node above ``slot`` on every level of its block."""
    steps = []
    for k in range(BLOCK_LEVELS):
        at = F.floor(slot / ARITY**k).cast("int")
        start = (at - at % ARITY).cast("int")
        left = F.slice(F.col(f"level{k}"), start + 1, at - start)
        right = F.slice(F.col(f"level{k}"), at + 2, start + ARITY - 1 - at)
        steps.append(F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right")))
    return F.slice(F.array(*steps), F.lit(1), height)


def reduce_tree(nodes: DataFrame, group: str, item: Column) -> DataFrame:
    """Slot arrays of ``nodes`` (group, pos, total, digest) with the way from each array to its group's root.

    One row a block: ``group, block, level0..``, ``items`` (by slot), ``height``,
    ``way`` (from the block's node up) and ``top`` (the root of the group).
    Every round turns BLOCK nodes into one, so few rounds reach the root.
    """
    keyed = nodes.select(group, F.floor(F.col("pos") / BLOCK).alias("block"), "total",
                         F.struct((F.col("pos") % BLOCK).cast("int").alias("slot"), F.col("digest"), item.alias("item")).alias("node"))
    blocks = keyed.groupBy(group, "block").agg(F.max("total").alias("total"), F.sort_array(F.collect_list("node")).alias("nodes"))
    blocks = blocks.select(group, "block", "total", _height(F.col("total")).alias("height"),
                           F.transform("nodes", lambda n: n["item"]).alias("items"), F.transform("nodes", lambda n: n["digest"]).alias("level0"))
    for k in range(BLOCK_LEVELS):
        blocks = blocks.withColumn(f"level{k + 1}", F.when(F.col("height") > k, _parents(F.col(f"level{k}"))))
    levels = F.array(*[F.col(f"level{k}") for k in range(BLOCK_LEVELS + 1)])
    blocks = materialize(blocks.withColumn("node", F.get(F.get(levels, F.col("height")), F.lit(0))), "blocks")
    none = F.array().cast("array<struct<left:string,right:string>>")
    if blocks.where("block > 0").isEmpty():
        return blocks.withColumns({"way": none, "top": F.col("node")})
    upper = blocks.select(group, F.col("block").alias("pos"), F.ceil(F.col("total") / BLOCK).alias("total"), F.col("node").alias("digest"))
    above = listed(reduce_tree(upper, group, F.col("pos")), group).select(group, F.col("item").alias("block"), F.col("path").alias("way"), "top")
    return attach(blocks, above, [group, "block"], ["way", "top"], "inner")


def listed(blocks: DataFrame, group: str, *more: str) -> DataFrame:
    """One row a node: ``group, item, path, top`` (the path leads from the node to the top) and more columns of its block."""
    slots = F.transform(F.col("items"), lambda x, i: F.struct(x.alias("item"), F.concat(_way(i, F.col("height")), F.col("way")).alias("path")))
    return blocks.select(group, "top", *more, F.explode(slots).alias("node")).select(group, "node.item", "node.path", "top", *more)


def manifest(
    docs: DataFrame, key: str = "doc_id", group: str = "source", fields: Sequence[str] = FIELDS, carry: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Every row as a leaf of a tree per group, with its path to the root over all groups.

    Returns ``<key>, <group>, leaf, subroot, root, path`` and the ``carry``
    columns (expressions over ``docs``, worked out in the pass that hashes).
    ``path`` lists the siblings of every level as strings of digests left and
    right of the own one: ``fold`` gives the root, ``proof`` one string.

    Texts are read and hashed once and never shuffled; narrow rows are shuffled
    to their rank and to their slot array.  Nulls in any field are written as
    ``-``; null keys come first, rows with equal keys stand in the order of
    their digests, repeated rows are leaves of their own.  A null group is a
    group and comes first.  Very long texts only cost their own hash; an empty
    table has no rows; other columns are ignored.
    """
    carry = dict(carry or {})
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(group).cast("string").alias("g"), leaf(*[F.col(f) for f in fields]).alias("digest"),
                       *[c.alias(f"c_{n}") for n, c in carry.items()])
    rows = materialize(rows, "leaves")
    nodes = places(rows, "g", "k", ["digest", *[f"c_{n}" for n in carry]])
    blocks = materialize(reduce_tree(nodes, "g", F.struct("k", "digest", *[f"c_{n}" for n in carry])), "trees")
    subroots = blocks.where("block = 0").select("g", F.col("top").alias("digest"))
    forest = reduce_tree(ranked_groups(subroots, "g").withColumn("all", F.lit(0)), "all", F.col("g"))
    ends = materialize(listed(forest, "all").select(F.col("item").alias("of"), F.col("path").alias("rest"), F.col("top").alias("root")), "subroots")
    few, small = bounded(ends, BROADCAST_GROUPS)
    salt = F.pmod(F.col("block"), F.lit(SALTS))
    same = F.col("g").eqNullSafe(F.col("of"))
    if small:
        joined = blocks.join(few, same)
    else:
        spread = ends.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = blocks.join(spread, same & (salt == F.col("salt")))
    out = listed(joined, "g", "rest", "root")
    return out.select(
        F.col("item.k").alias(key), F.col("g").alias(group), F.col("item.digest").alias("leaf"), F.col("top").alias("subroot"), "root",
        F.concat("path", "rest").alias("path"), *[F.col(f"item.c_{n}").alias(n) for n in carry],
    )


def tamper_check(docs: DataFrame) -> DataFrame:
    """Manifest of ``docs``, and whether each row still verifies after its line feeds were deleted where 2 divides crc32(doc_id).

    ``doc_id, leaf, subroot, root, proof_sha256`` are of the untampered rows;
    ``folded_root`` is worked out from the tampered leaf and the untampered
    siblings.  A null doc_id has no crc32 and is not tampered with.
    """
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    changed = chosen & F.contains(F.col("text"), F.lit("\n"))
    values = [F.replace(F.col(f), F.lit("\n"), F.lit("")) if f == "text" else F.col(f) for f in FIELDS]
    rows = manifest(docs, carry={"tampered": F.when(changed, leaf(*values))})
    rows = rows.withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("path")))
    return rows.select("doc_id", "leaf", "subroot", "root", digest(proof(F.col("path"))).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
