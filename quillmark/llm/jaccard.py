"""N-gram Jaccard join with several global token orders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm.base import components, free, materialize, small, small_batches, whole_text
from quillmark.llm.shingles import mix, prefix_length, set_key, shingle_set, similar

PERCENT = 80
#: Shingles counted at this many places go last in every order, the commonest ones first to be named ...
COMMON = 12
#: ... and at most so many are named (8 bytes each); any choice keeps the result, it only moves work.
MOST_COMMON = 1 << 20
#: Share of a set, lowest hashes first, that is counted to find the common shingles.
COUNTED = 0.3
#: Orders besides the first one that a candidate must pass before it is verified.
MORE_ORDERS = (1, 2)
#: Hashes that one task gathers before it passes them on, and about how many one reducing task gets.
CHUNK = 1_000_000
#: Shingles of the sets that a task remembers while it verifies pairs.
REMEMBERED = 1_000_000
#: Open pairs for each node of a shingle up to which they are listed; beyond, blocks meet block by block.
PAIRED = 32
#: Nodes of a block at most, and shingles of all its nodes (about, as nodes are dealt by a hash).
BLOCK = 1024
BLOCK_SHINGLES = 400_000


def _counted(percent_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(parts), return_counts=True)
            edges = np.searchsorted(tokens, _bounds(percent_buckets))
            ranges = [(int(a), int(b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            full = [(i, a, b) for i, (a, b) in enumerate(ranges) if b > a]
            repeated = [np.flatnonzero(counts[a:b] > 1).astype(np.uint32) for _, a, b in full]
            return pa.RecordBatch.from_pydict({
                "bucket": pa.array([i for i, _, _ in full], pa.int32()),
                "tokens": pa.array([tokens[a:b].tobytes() for _, a, b in full], pa.binary()),
                "places": pa.array([r.tobytes() for r in repeated], pa.binary()),
                "counts": pa.array([counts[a:b][r].astype(np.uint32).tobytes() for (_, a, b), r in zip(full, repeated, strict=True)], pa.binary()),
            })

        for batch in batches:
            for text in batch.column(0).to_pylist():
                s = shingle_set(text)
                if len(s):
                    parts.append(s[: int(len(s) * COUNTED) + 1])
                    size += len(parts[-1])
            if size >= CHUNK:
                yield flush()
                parts, size = [], 0
        if parts:
            yield flush()

    return run


def _bounds(buckets: int) -> np.ndarray:
    """Edges of equal ranges of 64-bit numbers; the last one takes the rest."""
    edges = np.array([i * ((1 << 64) // buckets) for i in range(buckets)] + [(1 << 64) - 1], dtype=np.uint64)
    return edges


def _add_up(frame):
    import pandas as pd

    tokens = np.concatenate([np.frombuffer(t, np.uint64) for t in frame["tokens"]])
    counts = np.ones(len(tokens), np.int64)
    start = 0
    for t, places, more in zip(frame["tokens"], frame["places"], frame["counts"], strict=True):
        counts[start + np.frombuffer(places, np.uint32).astype(np.int64)] = np.frombuffer(more, np.uint32)
        start += len(t) // 8
    order = np.argsort(tokens, kind="stable")
    tokens, counts = tokens[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.empty(0, int)
    total = np.add.reduceat(counts, first) if len(first) else counts
    common = total >= COMMON
    return pd.DataFrame({"token": tokens[first][common].view(np.int64), "n": total[common]})


def common_shingles(texts: DataFrame) -> np.ndarray:
    """The commonest shingles, ascending: counted over all texts, at most ``MOST_COMMON`` of them.

    Each task sums up its own hashes first and sends them by ranges of the hash,
    so a shingle that is in every document costs one entry per task.
    """
    chars = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(max(16, chars // 6 * COUNTED // CHUNK * 2))
    counted = texts.mapInArrow(_counted(buckets), "bucket int, tokens binary, places binary, counts binary")
    common = materialize(counted.groupBy("bucket").applyInPandas(_add_up, "token long, n long"), "common")
    levels = common.groupBy(F.floor(F.log2("n") * 4).alias("level")).agg(F.count("*").alias("k"), F.min("n").alias("least")).orderBy(F.desc("level")).collect()
    room, least = MOST_COMMON, None
    for row in levels:  # one row per quarter power of two
        room -= row["k"]
        if room < 0:
            break
        least = row["least"]
    if least is None:
        return np.empty(0, np.uint64)
    return np.sort(common.where(F.col("n") >= least).select("token").toArrow()["token"].to_numpy().view(np.uint64))


def ordered_prefix(s: np.ndarray, common: np.ndarray, order: int, percent: int = PERCENT) -> np.ndarray:
    """First shingles of a set in one global order: common ones last, else by a hash of the order's own."""
    if len(s) == 0:
        return s
    place = np.searchsorted(common, s)
    is_common = common[np.minimum(place, len(common) - 1)] == s if len(common) else np.zeros(len(s), bool)
    p = prefix_length(len(s), percent)
    value = s if order == 0 else mix(s, order)
    return s[np.lexsort((value, is_common))[:p]]


def _prefixes(common, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = common.value
        for batch in batches:
            sets = [shingle_set(t) for t in batch.column(1).to_pylist()]
            firsts = [ordered_prefix(s, known, 0, percent) for s in sets]
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in firsts])]).astype(np.int32)
            flat = np.concatenate(firsts) if firsts else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(2), pa.array([set_key(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64))),
                ],
                names=["id", "text_hash", "node", "n", "prefix"],
            )

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by token: pass on those of tokens that several sets hold, each with the token's first set.

    Streams; of a run that goes over several batches only its first row is kept in mind.
    """
    token, first, first_n, shared = None, 0, 0, False
    for batch in batches:
        if batch.num_rows == 0:
            continue
        t = batch.column(0).to_numpy()
        node = batch.column(1).to_numpy()
        n = batch.column(2).to_numpy()
        start = np.concatenate([[token is None or t[0] != token], t[1:] != t[:-1]])
        run = np.cumsum(start) - 1  # -1: goes on from the last batch
        heads = np.flatnonzero(start)
        lengths = np.bincount(run[run >= 0], minlength=len(heads))
        center = np.where(run >= 0, node[heads[np.maximum(run, 0)]] if len(heads) else first, first)
        center_n = np.where(run >= 0, n[heads[np.maximum(run, 0)]] if len(heads) else first_n, first_n)
        keep = np.where(run >= 0, lengths[np.maximum(run, 0)] > 1 if len(heads) else True, True)
        out = [t[keep], node[keep], n[keep], center[keep], center_n[keep]]
        if token is not None and not start[0] and not shared:  # the run's first row was held back
            out = [np.concatenate([[x], y]) for x, y in zip((token, first, first_n, first, first_n), out, strict=True)]
        if len(heads):
            first, first_n, shared = int(node[heads[-1]]), int(n[heads[-1]]), bool(lengths[-1] > 1)
        else:
            shared = True
        token = t[-1]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["token", "node", "n", "center", "center_n"])


class _Sets:
    """Shingle sets of nodes and their first shingles in the further orders, remembered up to a number of shingles."""

    def __init__(self, common: np.ndarray, percent: int) -> None:
        self.common, self.percent = common, percent
        self.memory: dict[int, tuple[np.ndarray, list[np.ndarray]]] = {}
        self.held = 0

    def of(self, node: int, text: str) -> tuple[np.ndarray, list[np.ndarray]]:
        found = self.memory.get(node)
        if found is None:
            s = shingle_set(text)
            found = (s, [np.sort(ordered_prefix(s, self.common, k, self.percent)) for k in MORE_ORDERS])
            while self.memory and self.held + len(s) > REMEMBERED:
                self.held -= len(self.memory.pop(next(iter(self.memory)))[0])
            self.memory[node] = found
            self.held += len(s)
        return found


def _verified(common, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = _Sets(common.value, percent)
        for batch in batches:
            keep = []
            for a, b, text_a, text_b in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                (sa, firsts_a), (sb, firsts_b) = sets.of(a, text_a), sets.of(b, text_b)
                passes = all(len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(firsts_a, firsts_b, strict=True))
                keep.append(passes and similar(sa, sb, percent))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each set on the left shares with each on the right, by products of 0/1 tables of some columns."""
    every = np.concatenate([*left, *right]) if left or right else np.empty(0, np.uint64)
    names, column, times = np.unique(every, return_inverse=True, return_counts=True)
    column = np.where(times[column] > 1, np.cumsum(times > 1)[column] - 1, -1)
    owner = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in [*left, *right]])
    owner, column = owner[column >= 0], column[column >= 0]
    out = np.zeros((len(left), len(right)), np.float32)
    step = 8192
    for start in range(0, int(column.max(initial=-1)) + 1, step):
        inside = (column >= start) & (column < start + step)
        table = np.zeros((len(left) + len(right), step), np.float32)
        table[owner[inside], column[inside] - start] = 1.0
        out += table[: len(left)] @ table[len(left) :].T
    return out.astype(np.int64)


def _block_links(common, percent: int):
    """Links of a block of a shingle's outer nodes to a block of all its nodes; only so many as join what they link."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        sets = _Sets(common.value, percent)
        rows = sorted(zip(*(table[c].to_pylist() for c in ("node", "c", "first", "outer", "left", "text")), strict=True))
        left, right = ([r for r in rows if r[4] == side] for side in (True, False))
        both = [[sets.of(r[0], r[5]) for r in side] for side in (left, right)]
        node, label, first = ([np.array([r[k] for r in side], np.int64) for side in (left, right)] for k in range(3))
        outer = np.array([r[3] for r in right], bool)
        alive = label[0][:, None] != label[1][None, :]
        alive &= (first[0][:, None] != first[1][None, :]) | (first[0] == key[0].as_py())[:, None]
        alive &= ~outer[None, :] | (node[0][:, None] < node[1][None, :])  # two outer nodes meet once
        for k in range(len(MORE_ORDERS)):
            alive &= _common_counts([x[1][k] for x in both[0]], [x[1][k] for x in both[1]]) > 0
        i, j = (np.flatnonzero(alive.any(axis=axis)) for axis in (1, 0))
        shared = _common_counts([both[0][x][0] for x in i], [both[1][x][0] for x in j])
        sizes = [np.array([len(both[side][x][0]) for x in picked], np.int64) for side, picked in ((0, i), (1, j))]
        linked = alive[np.ix_(i, j)] & (100 * shared >= percent * (sizes[0][:, None] + sizes[1][None, :] - shared))
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        out = []
        for x, y in zip(*np.nonzero(linked), strict=True):
            a, b = int(node[0][i[x]]), int(node[1][j[y]])
            if root(a) != root(b):
                parent[root(b)] = root(a)
                out.append((a, b))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return run


def _strangers(few: DataFrame) -> DataFrame:
    """Nodes outside the largest component of their shingle: at most 4 * PAIRED where the open pairs are few."""
    return few.where(F.col("c") != F.col("top"))


def _open_pairs(few: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` of nodes of one shingle in different components.

    Strangers are joined with the whole group, so a large component is never
    joined with itself: what is visited is its nodes times the strangers.
    """
    other = few.select("token", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("c").alias("c_b"))
    once = (F.col("c_b") == F.col("top")) | (F.col("node") < F.col("b"))
    pairs = _strangers(few).join(other, "token").where((F.col("c") != F.col("c_b")) & once & _long_enough(F.col("n"), F.col("n_b"), percent))
    return pairs.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b"))


def _outer(crowded: DataFrame) -> DataFrame:
    """Adds ``first``, the largest crowded shingle of the node, and ``outer``: whether the shingle's inner nodes lack it.

    Inner nodes need not be compared with each other: they are those of the
    largest component, or those whose ``first`` is the same other shingle,
    whichever are more.
    """
    largest = crowded.groupBy("node").agg(F.min(F.struct((-F.col("m")).alias("less"), "token"))["token"].alias("first"))
    placed = crowded.join(largest, "node")
    shares = placed.where("first <> token").groupBy("token", "first").agg(F.count("*").alias("k"))
    most = shares.groupBy("token").agg(F.max(F.struct("k", "first")).alias("most"))
    tops = placed.groupBy("token").agg(F.count_if(F.col("c") == F.col("top")).alias("tops")).join(most, "token", "left")
    by_first = F.coalesce(F.col("most.k") > F.col("tops"), F.lit(False))
    outer = F.when(by_first, F.col("first") != F.col("most.first")).otherwise(F.col("c") != F.col("top"))
    return materialize(placed.join(tops, "token").select("token", "node", "n", "c", "first", outer.alias("outer")), "crowded")


def _long_enough(x: Column, y: Column, percent: int) -> Column:
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


def jaccard_components(docs: DataFrame, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row ``<key>, n_shingles, component_id`` per row of ``docs``: who is linked, directly or not.

    Rows of equal sets are one node.  Nodes whose first shingles (in the first
    global order) meet are candidates if their sizes allow the similarity; they
    must meet in the first shingles of every further order too, and are then
    compared in whole.  Common shingles go last in all orders, which keeps
    shared passages out of the first shingles.

    Two rounds, no pairs of a whole group: first each node is tried against one
    chosen node of every shingle it shares (a star, one pair a row), and what is
    linked becomes a component.  Then the nodes of one shingle that are still in
    different components are tried against each other: pair by pair where they
    are few, else block by block, where a task gets two blocks of at most about
    BLOCK nodes, filters and compares them by products of 0/1 tables and
    passes on the links that join something.  Copies share many such crowded
    shingles: two nodes whose largest crowded shingle is the same one meet there
    alone, so of a shingle's nodes those of the commonest larger shingle, or of
    the largest component, are not compared with each other, and blocks are made
    for the outer nodes against all.  So every two linked nodes end in
    one component, a large group of near copies costs about one comparison a
    member, and no row is written for a pair that is not similar.

    Null text or no words: ``n_shingles`` 0, its own component.  Fewer than five
    words: one shingle.  Repeated rows get equal results; rows that share the key
    but not the text count as two.  A null key is a key of its own; if it is the
    only one of its component, ``component_id`` is null.  Empty table: no rows.
    """
    marked, classes = _classes(docs, percent, key, text)
    least = classes.groupBy("c").agg(F.min("id").alias("component_id"))
    named = classes.join(least, "c").select(F.col("node").alias("of"), "component_id")
    out = marked.join(named, marked.node == named.of, "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), own.alias("component_id"))


def _text_hash(text: str) -> Column:
    """Tells rows that share a key apart by their texts."""
    return F.xxhash64(whole_text(text))


def _first_row() -> Column:
    """The row of the smallest key, then of the smallest text hash; a null key only where there is no other."""
    return F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash"))


def _classes(docs: DataFrame, percent: int, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """All rows ``id, text_hash, node, n, ...``, and one row ``node, id, text_hash, c`` per node that has shingles.

    ``id, text_hash`` is the node's first row and ``c`` its component.
    """
    small_batches(docs)
    source = docs.select(F.col(key).alias("id"), whole_text(text).alias("text"), _text_hash(text).alias("text_hash"))
    spark = docs.sparkSession
    # at most MOST_COMMON hashes, 8 MB, however large the input
    common = spark.sparkContext.broadcast(common_shingles(source.select("text")))
    id_type = source.schema["id"].dataType.simpleString()
    marked = materialize(source.mapInArrow(_prefixes(common, percent), f"id {id_type}, text_hash long, node long, n long, prefix array<long>"), "marked")
    nodes = marked.where("n > 0").groupBy("node").agg(F.min(F.struct("id", "n", "prefix")).alias("x"))
    tokens = nodes.select(F.explode("x.prefix").alias("token"), "node", F.col("x.n").alias("n"))
    # four candidates for the chosen node of a group, by the token's last bits
    tokens = tokens.repartition("token").sortWithinPartitions("token", F.xxhash64("node", F.col("token").bitwiseAND(3)))
    met = materialize(tokens.mapInArrow(_runs, "token long, node long, n long, center long, center_n long"), "met")
    classes = marked.where("n > 0").groupBy("node").agg(_first_row().alias("x")).select("node", "x.id", "x.text_hash")

    def texts_of(wanted: DataFrame) -> DataFrame:
        """One text of every wanted node: that of its first row, found by key and text hash, as keys may repeat."""
        wanted = wanted.distinct().join(classes, "node").select("node", F.col("id").alias("wanted_id"), F.col("text_hash").alias("wanted_hash"))
        wanted = small(materialize(wanted, "wanted"))
        texts = source.join(wanted, F.col("id").eqNullSafe(F.col("wanted_id")) & (F.col("text_hash") == F.col("wanted_hash")))
        return materialize(texts.groupBy("node").agg(F.min("text").alias("text")), "texts")

    def verify(pairs: DataFrame) -> DataFrame:
        texts = texts_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")))
        both = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        both = both.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        return materialize(both.select("a", "b", "text_a", "text_b").mapInArrow(_verified(common, percent), "a long, b long"), "links")

    star = met.where((F.col("node") != F.col("center")) & _long_enough(F.col("n"), F.col("center_n"), percent))
    tried = materialize(star.select(F.least("node", "center").alias("a"), F.greatest("node", "center").alias("b")).distinct(), "tried")
    links = verify(tried)
    labels = components(links, "a", "b")

    placed = met.join(labels, "node", "left").select("token", "node", "n", F.coalesce("component", "node").alias("c"))
    parts = placed.groupBy("token", "c").agg(F.count("*").alias("k"))
    open_tokens = parts.groupBy("token").agg(F.sum("k").alias("m"), F.sum(F.col("k") * F.col("k")).alias("same"), F.count("*").alias("parts"), F.max(F.struct("k", "c"))["c"].alias("top"))
    # pairs of different components against nodes: few if a few nodes face one large component
    open_tokens = open_tokens.where("parts > 1").select("token", "m", "top", ((F.col("m") * F.col("m") - F.col("same")) <= F.col("m") * (2 * PAIRED)).alias("few"))
    rest = materialize(placed.join(open_tokens, "token"), "rest")
    pairs = _open_pairs(rest.where("few"), percent)
    pairs = materialize(pairs.distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
    more = [verify(pairs)] if not pairs.isEmpty() else []
    crowded = rest.where("not few")
    if not crowded.isEmpty():
        placed = _outer(crowded)
        blocks = [F.ceil(F.greatest(F.sum(chosen) / BLOCK, F.sum(chosen * F.col("n")) / BLOCK_SHINGLES)).cast("int") for chosen in (F.col("outer").cast("int"), F.lit(1))]
        dealt = placed.join(placed.groupBy("token").agg(blocks[0].alias("lefts"), blocks[1].alias("rights")).where("lefts > 0"), "token")
        sides = []
        for is_left, own, other in ((True, "lefts", "rights"), (False, "rights", "lefts")):
            at = F.pmod(F.xxhash64("node"), F.col(own)).cast("int").alias("own")
            met_by = F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("other")
            side = dealt.where("outer") if is_left else dealt
            side = side.select("token", "node", "c", "first", "outer", F.lit(is_left).alias("left"), at, met_by)
            sides.append(side.withColumnsRenamed({"own": "i", "other": "j"} if is_left else {"own": "j", "other": "i"}))
        dealt = sides[0].unionByName(sides[1]).join(texts_of(placed.select("node")), "node")
        more.append(materialize(dealt.groupBy("token", "i", "j").applyInArrow(_block_links(common, percent), "a long, b long"), "links"))
    for found in more:
        links = links.union(found)
    if any(not found.isEmpty() for found in more):
        labels = components(links, "a", "b")

    return marked, classes.join(labels, "node", "left").select("node", "id", "text_hash", F.coalesce("component", "node").alias("c"))


def one_of_each(docs: DataFrame, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of every component: that of the smallest key, then of the smallest text hash.

    A document is a key with a text: rows that share the key but not the text
    count as two, with a null key too.  Documents without words all stay.  Of
    rows that share both, any one stays.
    """
    of, of_hash, own_hash = free(docs, "_of"), free(docs, "_of_hash"), free(docs, "_hash")
    marked, classes = _classes(docs, percent, key, text)
    first = classes.groupBy("c").agg(_first_row().alias("x")).select("x.id", "x.text_hash")
    kept = first.union(marked.where("n = 0").select("id", "text_hash").distinct()).toDF(of, of_hash)
    hashed = docs.withColumn(own_hash, _text_hash(text))
    same = F.col(key).eqNullSafe(F.col(of)) & (F.col(own_hash) == F.col(of_hash))
    return hashed.join(kept, same, "left_semi").dropDuplicates([key, own_hash]).drop(own_hash)
