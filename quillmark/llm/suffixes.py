"""Removal of repeated byte strings by difference-cover suffix sorting of the stretches that may repeat."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmark.llm.base import key_runs, materialize, small, small_batches, whole_text

#: Bytes of a string that may occur only once.
LENGTH = 100
#: Bytes of an anchor; every string of LENGTH bytes holds the anchor with the least hash in it.
ANCHOR = 24
WINDOW = LENGTH - ANCHOR + 1
#: Strings around an anchor by the bytes they have before it: what all strings of a range have in common is its core.
RANGES = ((0, 18), (19, 37), (38, 56), (57, LENGTH - ANCHOR))
#: Difference cover modulo 3: suffixes at these residues are sampled; any two residues meet in it after a common shift below 3.
COVER = (1, 2)
#: Sampled suffixes are sorted by this many bytes, so that with a shift below 3 they still lie within LENGTH.
SORTED = LENGTH - 2
#: Bytes that are hashed at once, and anchors a task gathers before it passes them on.
PIECE = 1 << 19
CHUNK = 400_000

#: Ranges that are broadcast to the texts, at most.
MOST_RANGES = 1_500_000

_BYTES = np.random.default_rng(20240917).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int) -> np.ndarray:
    out = np.ones(PIECE + 4 * LENGTH, np.uint64)
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Hashed:
    """Hashes of any stretch of a piece in constant time."""

    def __init__(self, raw: np.ndarray) -> None:
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTES[raw] * _UP[: len(raw)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * _DOWN[start])


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` neighbours, by doubling."""
    reach, least = 1, x
    while reach * 2 <= width:
        least = np.minimum(least[: len(least) - reach], least[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def contexts(raw: np.ndarray) -> dict[str, np.ndarray]:
    """Anchors of a text and what surrounds them.

    ``anchor``: hash of the anchor's bytes; ``context``: hash of the bytes that
    the strings choosing this anchor cover; ``first``, ``last``: where those
    strings start; ``lead``: bytes from the first start to the anchor; ``cores``:
    for each of RANGES that has such a string, a 16-bit hash of its core (else 0).
    """
    parts: list[tuple[np.ndarray, ...]] = []
    strings = len(raw) - LENGTH + 1
    for at in range(0, max(strings, 0), PIECE):
        n = min(PIECE, strings - at)
        low = max(0, at - LENGTH)
        piece = raw[low : at + n + LENGTH - 1]
        hashed = Hashed(piece)
        shift = at - low
        starts = np.arange(shift, shift + n + WINDOW - 1)
        g = hashed.of(starts, starts + ANCHOR)
        # high bits of the hash, then the place: the least is one anchor, the leftmost of equals
        least = _sliding_least((g >> np.uint64(20) << np.uint64(20)) | np.arange(len(g), dtype=np.uint64), WINDOW)
        chosen = (least & np.uint64((1 << 20) - 1)).astype(np.int64)
        heads = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
        tails = np.concatenate([heads[1:] - 1, [n - 1]])
        a = chosen[heads] + shift
        cores = np.zeros(len(a), np.uint64)
        for k, (fewest, most) in enumerate(RANGES):
            active = (a - heads - shift >= fewest) & (a - tails - shift <= most)
            core = hashed.of(np.where(active, a - fewest, 0), np.where(active, a - most + LENGTH, 0)) >> np.uint64(48) | np.uint64(1)
            cores |= np.where(active, core, np.uint64(0)) << np.uint64(16 * k)
        whole = hashed.of(heads + shift, tails + shift + LENGTH) + (tails - 2 * heads + a - shift).astype(np.uint64) * np.uint64(_BASE)
        parts.append((g[chosen[heads]], whole, heads + at, tails + at, a - heads - shift, cores))
    names = ("anchor", "context", "first", "last", "lead", "cores")
    if not parts:
        return {k: np.empty(0, np.int64) for k in names}
    return {k: np.concatenate(c).view(np.int64) for k, c in zip(names, zip(*parts, strict=True), strict=True)}


def _later(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Which rows, taken in ``order``, repeat the keys of the row before them."""
    same = np.ones(max(len(order) - 1, 0), bool)
    for k in keys:
        same &= k[order][1:] == k[order][:-1]
    out = np.zeros(len(order), bool)
    out[order[1:]] = same
    return out


_ROW = ("anchor", "context", "doc", "first", "last", "lead", "cores")
# What is shuffled of them.  A row of a shuffle holds a word per column, so ``place`` is the first start (31 bits), the
# starts behind it and, unless it is a copy, the lead (31 bits), and the copy mark.  An anchor's hash is only where
# contexts meet, so 40 bits of it will do.
_ANCHORS = "anchor long, context long, doc long, place long, cores long"
_ANCHOR_BITS = 40
assert max(LENGTH - ANCHOR, WINDOW) < 256


def _pack_anchors(c: dict[str, np.ndarray], copy: np.ndarray) -> pa.RecordBatch:
    more = c["last"] - c["first"]
    place = c["first"] << 32 | np.where(copy, more, c["lead"] << 8 | more) << 1 | copy
    columns = [c["anchor"] & (1 << _ANCHOR_BITS) - 1, c["context"], c["doc"], place, np.where(copy, 0, c["cores"])]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["anchor", "context", "doc", "place", "cores"])


def _unpack_anchors(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows as they were; copies have neither lead nor cores."""
    anchor, context, doc, place, cores = (x.to_numpy() for x in batch.columns)
    copy, first, rest = (place & 1).astype(bool), place >> 32, place >> 1 & (1 << 31) - 1
    columns = [anchor, context, doc, first, first + np.where(copy, rest, rest & 255), np.where(copy, 0, rest >> 8), cores, copy]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=[*_ROW, "copy"])


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts of all texts; those that repeat an earlier one of the same task are marked and need no shuffle."""
    held: list[dict[str, np.ndarray]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        c = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
        copy = _later(np.lexsort((c["first"], c["doc"], c["context"], c["anchor"])), c["anchor"], c["context"])
        # copies next to each other are one range from here on
        goes_on = copy[1:] & copy[:-1] & (c["doc"][1:] == c["doc"][:-1]) & (c["first"][1:] == c["last"][:-1] + 1)
        heads = np.flatnonzero(np.concatenate([[True], ~goes_on]))
        last = c["last"][np.concatenate([heads[1:] - 1, [len(copy) - 1]])]
        return _pack_anchors({k: v[heads] for k, v in c.items()} | {"last": last}, copy[heads])

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            c = contexts(np.frombuffer(text.encode("utf-8", "replace"), np.uint8))
            if len(c["first"]):
                held.append(c | {"doc": np.full(len(c["first"]), doc, np.int64)})
                size += len(c["first"])
        if size >= CHUNK:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


_SPLIT = "doc long, first long, last long, anchor long, lead long, cores long"


def _copies_and_rivals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by anchor, context and place, with those that are known as copies behind them.

    Copies of a whole context come out with a null anchor.  First occurrences
    come out with their anchor if it has another context too.  Only the last
    row is carried from one batch to the next.
    """
    carried: dict[str, np.ndarray] | None = None
    told = False  # the carried row has come out already

    def out(rows: dict[str, np.ndarray], copy: np.ndarray, rival: np.ndarray) -> pa.RecordBatch:
        take = np.concatenate([np.flatnonzero(copy), np.flatnonzero(rival)])
        is_copy = np.arange(len(take)) < copy.sum()
        names = ("doc", "first", "last", "anchor", "lead", "cores")
        return pa.RecordBatch.from_arrays([pa.array(rows[k][take], pa.int64(), mask=is_copy if k == "anchor" else None) for k in names], names=list(names))

    for batch in batches:
        if batch.num_rows == 0:
            continue
        known = batch.column(len(_ROW)).to_numpy(zero_copy_only=False)
        rows = {k: batch.column(i).to_numpy() for i, k in enumerate(_ROW)}
        if known.any():
            yield out(rows, known, np.zeros(len(known), bool))
            rows = {k: v[~known] for k, v in rows.items()}
            if known.all():
                continue
        if carried is not None:
            rows = {k: np.concatenate([carried[k], rows[k]]) for k in _ROW}
        n = len(rows["anchor"])
        same_anchor = rows["anchor"][1:] == rows["anchor"][:-1]
        copy = np.zeros(n, bool)
        copy[1:] = same_anchor & (rows["context"][1:] == rows["context"][:-1])
        # the first row of an anchor is a rival once a second context of the anchor shows up
        group = np.concatenate([[0], np.cumsum(~same_anchor)])
        several = np.zeros(group[-1] + 1, bool)
        several[group[1:][same_anchor & ~copy[1:]]] = True
        if told:
            several[0] = True
        rival = ~copy & several[group]
        last_first = np.flatnonzero((group == group[-1]) & ~copy)[-1]  # the last context of the last anchor
        open_told = bool(several[group[-1]])
        if carried is not None:
            copy[0] = False
            rival[0] &= not told
        yield out(rows, copy, rival)
        carried = {k: rows[k][last_first : last_first + 1] for k in _ROW}
        told = open_told


def _ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All whole numbers of the ranges, ascending, each once."""
    lengths = last - first + 1
    base = np.repeat(first - (np.cumsum(lengths) - lengths), lengths)
    return np.unique(base + np.arange(lengths.sum()))


_SAMPLES = "triple binary, doc long, at long, around long"


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sampled suffixes of the stretches in doubt: SORTED bytes, place, and the bytes around them.

    ``around``: two bytes before, two behind, and a bit for each shift at which a
    string in doubt starts.  A string that starts earlier in the same task, too,
    comes out as found (null triple, last start in place of ``around``) and asks no more.
    """
    held: list[tuple] = []
    size = 0

    def flush() -> pa.RecordBatch:
        text = np.concatenate([h[0] for h in held])
        at = np.concatenate([h[1] for h in held])
        doc = np.concatenate([h[2] for h in held])
        local = np.concatenate([h[3] for h in held])
        mask = np.concatenate([h[4] for h in held])
        rows = np.lib.stride_tricks.sliding_window_view(text, LENGTH + 2)[at]  # from two bytes before
        digest = np.concatenate([h[5] for h in held])
        found_doc, found_at = [], []
        for d in range(3):
            asks = np.flatnonzero(mask >> d & 1)
            two = _two(rows[asks][:, [0, 1, LENGTH, LENGTH + 1]], d)
            later = _later(np.lexsort((local[asks], doc[asks], two, digest[asks])), digest[asks], two)
            mask[asks[later]] &= ~(1 << d)
            found_doc.append(doc[asks[later]])
            found_at.append(local[asks[later]] - d)
        stay = np.flatnonzero(mask)
        fa, fd, end = _joined(np.concatenate(found_at), np.concatenate(found_doc))
        around = (
            rows[stay, 0].astype(np.int64) << 24 | rows[stay, 1].astype(np.int64) << 16
            | rows[stay, LENGTH].astype(np.int64) << 8 | rows[stay, LENGTH + 1].astype(np.int64) | mask[stay] << 32
        )
        body = np.ascontiguousarray(rows[stay, 2 : 2 + SORTED])
        offsets = np.concatenate([np.arange(len(stay) + 1) * SORTED, np.full(len(fd), len(stay) * SORTED)]).astype(np.int32)
        valid = np.packbits(np.arange(len(stay) + len(fd)) < len(stay), bitorder="little")
        triple = pa.Array.from_buffers(pa.binary(), len(stay) + len(fd), [pa.py_buffer(valid.tobytes()), pa.py_buffer(offsets.tobytes()), pa.py_buffer(body.tobytes())])
        return pa.RecordBatch.from_arrays(
            [triple, *(pa.array(np.concatenate(x), pa.int64()) for x in ((doc[stay], fd), (local[stay], fa), (around, end)))],
            names=["triple", "doc", "at", "around"],
        )

    done = 0
    for batch in batches:
        for doc, text, firsts, lasts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
            first, last = np.asarray(firsts, np.int64), np.asarray(lasts, np.int64)
            strings = _ranges(first, last)
            wanted = np.zeros(len(raw) + 3, np.uint8)
            for d in range(3):
                p = strings + d
                wanted[p[np.isin(p % 3, COVER)]] |= 1 << d
            p = np.flatnonzero(wanted)
            padded = np.concatenate([np.zeros(2, np.uint8), raw, np.zeros(2, np.uint8)])
            digest = np.empty(len(p), np.uint64)
            for a in range(0, len(raw), PIECE):
                inside = np.flatnonzero((p >= a) & (p < a + PIECE))
                if len(inside):
                    hashed = Hashed(raw[a : a + PIECE + LENGTH])
                    digest[inside] = hashed.of(p[inside] - a, p[inside] - a + SORTED)
            held.append((padded, p + done, np.full(len(p), doc, np.int64), p, wanted[p].astype(np.int64), digest))
            done += len(padded)
            size += len(p) + len(raw) // 32
            if size >= CHUNK // 4:
                yield flush()
                held, size, done = [], 0, 0
    if held:
        yield flush()


def _two(around: np.ndarray, d: int) -> np.ndarray:
    """The two bytes that a string has besides its sampled suffix after ``d`` bytes."""
    pick = ((2, 3), (1, 2), (0, 1))[d]
    return around[:, pick[0]].astype(np.int64) << 8 | around[:, pick[1]]


def _joined(at: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of strings as ranges of neighbouring starts: first start, document, last start."""
    if len(at) == 0:
        return at, doc, at
    order = np.lexsort((at, doc))
    at, doc = at[order], doc[order]
    head = np.concatenate([[True], (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + 1)])
    start = np.flatnonzero(head)
    return at[start], doc[start], at[np.concatenate([start[1:] - 1, [len(at) - 1]])]


def _adjacent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sampled suffixes in sorted order: name them, merge the others in by their shift, report what starts earlier.

    Suffixes with equal triples are adjacent and get one name.  A string is its
    name at some shift together with the two bytes that are left over; the first
    string of a name, shift and bytes is the earliest and the rest are repeats.
    Streams; of a name that goes over several batches only the bytes seen so far
    are kept (three shifts of at most 65,536 values).
    """
    last: bytes | None = None
    seen: set[int] = set()
    for batch in batches:
        found = batch.filter(pc.is_null(batch.column(0)))
        docs, firsts, ends = ([found.column(i).to_numpy()] for i in (1, 2, 3))
        rows = batch.filter(pc.is_valid(batch.column(0)))
        if rows.num_rows:
            start = np.frombuffer(rows.column(0).buffers()[1], np.int32)[rows.column(0).offset : rows.column(0).offset + rows.num_rows + 1]
            body = np.frombuffer(rows.column(0).buffers()[2], np.uint8)[start[0] : start[-1]].reshape(-1, SORTED)
            name = np.concatenate([[0], np.cumsum((body[1:] != body[:-1]).any(axis=1))])
            doc, at, around = (rows.column(i).to_numpy() for i in (1, 2, 3))
            goes_on = last is not None and body[0].tobytes() == last
            if not goes_on:
                seen = set()
            fresh: set[int] = set()
            for d in range(3):
                asks = np.flatnonzero(around >> (32 + d) & 1)
                two = around[asks] >> (0, 8, 16)[d] & 0xFFFF
                code = two << 2 | d
                repeat = _later(np.lexsort((np.arange(len(asks)), code, name[asks])), name[asks], code)
                if goes_on:
                    early = name[asks] == 0
                    repeat |= early & np.isin(code, np.fromiter(seen, np.int64, len(seen)))
                docs.append(doc[asks[repeat]])
                firsts.append(at[asks[repeat]] - d)
                ends.append(at[asks[repeat]] - d)
                fresh.update(code[name[asks] == name[-1]].tolist())
            seen = fresh | (seen if goes_on and name[-1] == 0 else set())
            last = body[-1].tobytes()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(x), pa.int64()) for x in (docs, firsts, ends)], names=["doc", "first", "last"])


def _light(spots: DataFrame) -> DataFrame:
    """Broadcast the ranges by document if there are few, in documents and in ranges; else they are joined by shuffle."""
    ranges = spots.agg(F.sum(F.size("firsts"))).first()[0] or 0
    return small(spots) if ranges <= MOST_RANGES else spots


def repeated_strings(docs: DataFrame) -> DataFrame:
    """Starts of all strings that also start earlier: ``doc, first, last`` ranges, from ``doc`` (unique long) and ``text``.

    1. Narrow down.  A string of LENGTH bytes chooses the anchor of least hash in
       it, so equal strings choose equal anchors.  Strings whose anchor occurs
       once can't repeat.  If everything that one anchor's strings cover occurs
       earlier as a whole, they all repeat.  Other strings around the anchor can
       only be equal if they share the core of their range, most of their bytes.
    2. What is left in doubt is suffix sorted with the difference cover {1, 2}
       modulo 3: suffixes at sampled places are sorted by SORTED bytes (a triple
       of letters of a third of that; letters this wide end the recursion on
       names at the first level, as no string is longer) and equal neighbours
       share a name.  The suffixes at the other places are merged in by a shift
       to a sampled one, and adjacent prefixes are compared.

    Copies of a context, and of a string, within one task are settled there, so
    no common passage sends more than one row a task to any group.
    """
    cut = docs.select("doc", "text").mapInArrow(_anchors, _ANCHORS)
    copy = F.col("place").bitwiseAND(1)
    dealt = cut.repartition(F.when(copy == 1, F.xxhash64("doc", "place")).otherwise(F.col("anchor")))
    ordered = dealt.sortWithinPartitions(copy, "anchor", "context", "doc", "place")
    split = materialize(ordered.mapInArrow(lambda batches: _copies_and_rivals(map(_unpack_anchors, batches)), _SPLIT), "split", "zstd")
    whole = split.where("anchor is null").select("doc", "first", "last")

    # strings of two contexts can only be equal in a range whose core they share
    at = F.col("first") + F.col("lead")
    ranges = F.array(*[
        F.struct(
            F.xxhash64("anchor", F.lit(k), F.shiftrightunsigned("cores", 16 * k).bitwiseAND(0xFFFF)).alias("core"),
            F.greatest(F.col("first"), at - most).alias("start"), F.least(F.col("last"), at - fewest).alias("end"),
        )
        for k, (fewest, most) in enumerate(RANGES)
    ])
    rivals = split.where("anchor is not null").select("doc", F.inline(ranges)).where("start <= end")
    several = rivals.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core")
    doubt = rivals.join(several.hint("merge"), "core", "left_semi").select("doc", F.col("start").alias("first"), F.col("end").alias("last"))
    spots = doubt.groupBy("doc").agg(F.collect_list(F.struct("first", "last")).alias("x"))
    spots = materialize(spots.select(F.col("doc").alias("d"), F.col("x.first").alias("firsts"), F.col("x.last").alias("lasts")), "doubt")

    texts = docs.join(_light(spots), docs.doc == F.col("d")).select("doc", "text", "firsts", "lasts")
    samples = texts.mapInArrow(_sampled, _SAMPLES)
    dealt = samples.repartition(F.when(F.col("triple").isNull(), F.xxhash64("doc")).otherwise(F.xxhash64("triple")))
    ordered = dealt.sortWithinPartitions("triple", "doc", "at")
    return whole.unionByName(ordered.mapInArrow(_adjacent, "doc long, first long, last long"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Text and ranges of repeated strings -> sizes, spans and what is left."""
    for batch in batches:
        out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
        for text, firsts, lasts in zip(*(batch.column(i).to_pylist() for i in range(1, 4)), strict=True):
            raw = text.encode("utf-8", "replace")
            kept, removed, spans, at = [], 0, 0, 0
            end = 0  # of the span so far
            for first, last in sorted(zip(firsts or [], lasts or [], strict=True)):
                if first > end or spans == 0:
                    kept.append(raw[at:first])
                    spans += 1
                    at = first
                end = max(end, last + LENGTH)
                at = max(at, end)
            kept.append(raw[at:])
            left = b"".join(kept)
            removed = len(raw) - len(left)
            for k, v in zip(out, (len(raw), removed, spans, left), strict=True):
                out[k].append(v)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(out[k], pa.int64()) for k in ("n_bytes", "n_removed", "n_spans")), pa.array(out["kept"], pa.binary())],
            names=["id", "n_bytes", "n_removed", "n_spans", "kept"],
        )


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``<key>, n_bytes, n_removed, n_spans, kept``: every text as UTF-8 without the bytes covered by repeated strings.

    A byte goes if a string of LENGTH bytes over it also starts earlier: at a
    smaller key, or in the same document further left.  Strings never cross
    documents, may overlap, and are judged on the input.  ``n_spans`` counts
    maximal removed runs and ``kept`` holds the bytes that stay.

    Null text: empty.  Rows that repeat key and text are one document and get
    equal results; rows of one key with different texts are ordered by a hash
    of the text; a null key comes first.  Texts below LENGTH bytes stay.  Empty
    table: no rows; extra columns are ignored.
    """
    small_batches(docs)
    rows = docs.select(F.col(key).alias("id"), whole_text(text).alias("text"))
    known, distinct, n = rows.agg(F.count("id"), F.count_distinct("id"), F.count("*")).first()
    if known == distinct == n:
        numbered = rows.select("id", F.col("id").cast("long").alias("doc"), "text")
    else:
        numbered = _numbered(rows)
    found = repeated_strings(numbered.select("doc", "text").distinct() if known != distinct or known != n else numbered)
    spots = found.groupBy("doc").agg(F.collect_list(F.struct("first", "last")).alias("x"))
    spots = materialize(spots.select(F.col("doc").alias("d"), F.col("x.first").alias("firsts"), F.col("x.last").alias("lasts")), "repeats")
    joined = numbered.join(_light(spots), numbered.doc == F.col("d"), "left").select("id", "text", "firsts", "lasts")
    id_type = rows.schema["id"].dataType.simpleString()
    return joined.mapInArrow(_cut, f"id {id_type}, n_bytes long, n_removed long, n_spans long, kept binary").withColumnRenamed("id", key)


def _numbered(rows: DataFrame) -> DataFrame:
    """Documents with a number that follows key and text, for tables whose key repeats or is null."""
    marked = rows.select("id", "text", F.xxhash64("text").alias("h"))
    narrow = marked.select("id", "h").distinct()
    narrow = materialize(narrow.select("id", "h", key_runs(narrow, "id", 1000, 4096).alias("run")), "keys")
    starts = narrow.groupBy("run").agg(F.count("*").alias("n")).select("run", (F.sum("n").over(W.orderBy("run")) - F.col("n")).alias("start"))
    order = W.partitionBy("run").orderBy(F.col("id").asc_nulls_first(), "h")
    placed = narrow.withColumn("r", F.row_number().over(order)).join(F.broadcast(starts), "run")
    placed = placed.select(F.col("id").alias("i"), F.col("h").alias("k"), (F.col("start") + F.col("r")).alias("doc"))
    return marked.join(placed, F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("k"))).select("id", "doc", "text")

