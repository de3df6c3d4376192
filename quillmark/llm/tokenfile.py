"""Token ids in binary files: frequency-ranked ids, byte-aligned, control bytes apart from data bytes."""

from __future__ import annotations

import functools
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillmark.llm.base import key_runs, materialize, scratch, small_batches, whole_text
from quillmark.llm.bpe import CHUNK_CHARS, byte_letters
from quillmark.llm.pretoken import END_OF_TEXT, split

#: Id behind each document.
END_ID = 2
#: Documents of a run (a stretch of ascending ids that one task writes), most runs, and ids of a block.
RUN_ROWS = 1_000
MOST_RUNS = 4096
BLOCK_IDS = 1 << 18
#: Words a worker remembers; twice as many while the older half is fading.
REMEMBERED_WORDS = 500_000

#: Lengths (1 to 4 bytes) of the four values that a control byte stands for, two bits each from the lowest on; a byte each.
LENGTHS = (((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1).astype(np.uint8).view("<u4").ravel()


# ---- the code -----------------------------------------------------------------------------------------------------


def pack_all(values: np.ndarray, counts: np.ndarray) -> list[tuple[bytes, bytes]]:
    """Control bytes and data bytes of each of several runs of unsigned 32-bit values, ``counts`` values each.

    Each value takes as many bytes as it needs; the control bytes of a run are
    filled up with zeros.
    """
    values, counts = np.ascontiguousarray(values, "<u4"), np.asarray(counts, np.int64)
    largest = int(values.max(initial=0))
    width = max(1, (largest.bit_length() + 7) // 8)
    extra = (values > 0xFF).view(np.uint8)
    for limit in (0xFFFF, 0xFFFFFF)[: max(0, width - 2)]:
        extra = extra + (values > limit)
    # only the bytes that the largest value takes are looked at
    size = 4 if width == 3 else width
    used = np.empty((len(values), size), bool)
    used[:, 0] = True
    for k in range(1, size):
        np.greater_equal(extra, k, out=used[:, k])
    data = values.astype(f"<u{size}").view(np.uint8)[used.ravel()].tobytes()
    edges = np.concatenate([[0], np.cumsum(counts)])
    bytes_upto = (edges + np.concatenate([[0], np.cumsum(extra, dtype=np.int64)])[edges]).tolist()
    at = np.concatenate([[0], np.cumsum((counts + 3) // 4)]).tolist()
    padded, edges = np.zeros(at[-1] * 4, np.uint8), edges.tolist()
    for k in range(len(counts)):
        padded[4 * at[k] : 4 * at[k] + edges[k + 1] - edges[k]] = extra[edges[k] : edges[k + 1]]
    fours = padded.view("<u4")
    control = (fours | fours >> 6 | fours >> 12 | fours >> 18).astype(np.uint8).tobytes()
    return [(control[at[k] : at[k + 1]], data[bytes_upto[k] : bytes_upto[k + 1]]) for k in range(len(counts))]


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    return pack_all(values, np.array([len(values)]))[0]


def unpack_all(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All values of several runs: a table look-up turns control bytes into lengths, their running sum into places."""
    counts = np.asarray(counts, np.int64)
    fours = (counts + 3) // 4 * 4
    lengths, ends, filled = LENGTHS[control].view(np.uint8), np.cumsum(fours), fours - counts
    if filled.any():
        real = np.ones(len(lengths), bool)
        for k in range(1, 4):
            real[ends[filled >= k] - k] = False
        lengths = lengths[real]
    places = np.cumsum(lengths, dtype=np.int64) - lengths
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    values = padded[places].astype(np.uint32)
    for k in range(1, int(lengths.max(initial=1))):
        more = np.flatnonzero(lengths > k)
        values[more] |= padded[places[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return values


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    return unpack_all(control, data, np.array([n]))


# ---- encoding -----------------------------------------------------------------------------------------------------


class _Memory(dict):
    """Ids of words; asks the library about a word that is not there."""

    def __init__(self, older: dict[str, bytes], tokenize: Callable, code: str) -> None:
        super().__init__()
        self.older, self.tokenize, self.code = older, tokenize, code

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            ids = [t.id for t in self.tokenize(_spelled(word))]
            found = struct.pack(f"<{len(ids)}{self.code}", *ids)
        self[word] = found
        return found


_SPELLING = {b: letter for letter, b in byte_letters().items()}


def _spelled(word: str) -> str:
    """``word`` in the vocabulary's letters; of the printable ASCII characters only the space has another one."""
    if word.isascii() and word.isprintable():
        return word.replace(" ", _SPELLING[0x20])
    return word.encode("utf-8").decode("latin-1").translate(_SPELLING)


@functools.lru_cache(maxsize=2)
def _library(vocabulary: str) -> tuple[Tokenizer, int]:
    """The tokenizer of a vocabulary file and its largest id; a worker reads it once for all of its tasks."""
    library = Tokenizer.from_str(vocabulary)
    return library, max(library.get_vocab().values())


class LibraryEncoder:
    """Ids by the tokenizers library, whose model sees each distinct piece of text about once in the life of an encoder.

    Merges never cross pieces, so pieces may be encoded one by one; bytes are
    spelled in the vocabulary's letters first, as the library's splitter does.
    """

    def __init__(self, vocabulary: str, end_id: int = END_ID) -> None:
        self.library, last = _library(vocabulary)
        #: Bytes of an id: two where every id fits them.
        self.width = 2 if max(end_id, last) < 1 << 16 else 4
        self.special = self.library.token_to_id(END_OF_TEXT).to_bytes(self.width, "little")
        self.end = end_id.to_bytes(self.width, "little")
        self.memory = self._memory({})

    def _memory(self, older: dict[str, bytes]) -> _Memory:
        return _Memory(older, self.library.model.tokenize, "H" if self.width == 2 else "I")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text and the end id, ``width`` bytes each; words not met for long are forgotten."""
        if len(self.memory) > REMEMBERED_WORDS:
            self.memory.older.clear()
            self.memory = self._memory(dict(self.memory))
        ids, end = self.memory.__getitem__, self.end
        out = []
        for t in texts:
            if END_OF_TEXT in t:
                out.append(self.special.join([b"".join(map(ids, split(part))) for part in t.split(END_OF_TEXT)]) + end)
            else:
                out.append(b"".join([*map(ids, split(t)), end]))
        return out


@functools.lru_cache(maxsize=1)
def _encoder(vocabulary: str, end_id: int) -> LibraryEncoder:
    """The encoder of a worker: the tasks that follow each other in it meet the same frequent words."""
    return LibraryEncoder(vocabulary, end_id)


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    part: list[str] = []
    size = 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= CHUNK_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def _encoded(shared, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value, end_id)
        for batch in batches:
            at = 0
            for texts in _chunks(batch.column(2).to_pylist()):
                ids = encoder.encode(texts)
                n = len(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, n), batch.column(1).slice(at, n), pa.array([len(x) // encoder.width for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    names=["id", "run", "n", "ids"],
                )
                at += n

    return run


def _ids_of(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4")


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        parts = [_ids_of(x, n) for n, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        counts = np.bincount(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
        if len(counts) > len(total):
            total, counts = counts, total
        total[: len(counts)] += counts
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["token", "n"])


def _packed(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_rank = np.frombuffer(shared.value, "<u4")
        rank = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
        rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
        for batch in batches:
            counts = batch.column(2).to_numpy()
            parts = [_ids_of(x, n) for n, x in zip(counts.tolist(), batch.column(3).to_pylist(), strict=True)]
            both = pack_all(rank[np.concatenate(parts)], counts) if parts else []
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([c for c, _ in both], pa.binary()), pa.array([d for _, d in both], pa.binary())],
                names=["id", "run", "n", "control", "data"],
            )

    return run


def _blocks(id_type: pa.DataType):
    """Documents sorted by run and id -> blocks of whole documents; holds one block at a time."""
    fields = [("run", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("ids", pa.list_(id_type)), ("lengths", pa.list_(pa.int64())), ("control", pa.binary()), ("data", pa.binary())]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, before, held, size = None, 0, [], 0

        def block() -> pa.RecordBatch:
            ids, lengths, control, data = zip(*held, strict=True)
            row = {"run": [now], "before": [before], "n_ids": [size], "ids": [list(ids)], "lengths": [list(lengths)], "control": [b"".join(control)], "data": [b"".join(data)]}
            return pa.RecordBatch.from_pydict(row, schema=schema)

        for batch in batches:
            for key, at, n, control, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (at != now or size >= BLOCK_IDS):
                    yield block()
                    before, held, size = (before + size if at == now else 0), [], 0
                elif at != now:
                    before = 0
                now = at
                held.append((key, n, control, data))
                size += n
        if held:
            yield block()

    return run


def write(docs: DataFrame, vocabulary_path: str, path: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> None:
    """Encode every whole text, append ``end_id`` and write the ids below ``path`` in ascending order of the integer key.

    ``path/ranks``: the ids in order of falling frequency (one row of a little-
    endian binary).  ``path/blocks``: rows of whole documents - their run and
    the ids before them in it, document ids, lengths, and the documents' control
    and data bytes, one after the other.  An id is stored as its frequency rank,
    in as few bytes as that needs; two control bits say how many.  Spark's
    writers commit the files, so a lost executor leaves nothing half written.

    Null text: empty, so the end id alone.  Null key: first.  Rows of one key
    follow each other by their ids.  The rank table and the vocabulary are all
    that is broadcast.  Text is encoded once; what is kept of it until the
    ranks are known are two bytes an id (four for larger vocabularies).
    """
    small_batches(docs)
    spark = docs.sparkSession
    with open(vocabulary_path, encoding="utf-8") as file:
        vocabulary = spark.sparkContext.broadcast(file.read())
    rows = docs.select(F.col(key).alias("id"), whole_text(text).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    rows = rows.select("id", key_runs(rows, "id", RUN_ROWS, MOST_RUNS).cast("int").alias("run"), "text")
    encoded = materialize(rows.mapInArrow(_encoded(vocabulary, end_id), f"id {id_type}, run int, n long, ids binary"), "ids")

    counted = encoded.select("n", "ids").mapInArrow(_frequencies, "token long, n long")
    by_rank = [r["token"] for r in counted.groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").collect()]
    ranks = np.array(by_rank, "<u4").tobytes()
    spark.createDataFrame([(bytearray(ranks),)], "ids binary").coalesce(1).write.parquet(f"{path}/ranks")

    packed = encoded.mapInArrow(_packed(spark.sparkContext.broadcast(ranks)), f"id {id_type}, run int, n long, control binary, data binary")
    ordered = packed.repartition("run").sortWithinPartitions("run", F.col("id").asc_nulls_first(), "n", "data")
    blocks = ordered.mapInArrow(_blocks(_arrow(id_type)), f"run int, before long, n_ids long, ids array<{id_type}>, lengths array<long>, control binary, data binary")
    blocks.write.parquet(f"{path}/blocks")


def _arrow(id_type: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16()}[id_type]


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """The documents of the files: ``id, start, n_tokens, ids`` (little-endian unsigned 32-bit ids); start counts from the very first id."""
    blocks = spark.read.parquet(f"{path}/blocks")
    raw = spark.sparkContext.broadcast(bytes(spark.read.parquet(f"{path}/ranks").first()["ids"]))
    runs = blocks.groupBy("run").agg(F.sum("n_ids").alias("total"))
    # at most MOST_RUNS rows
    starts = F.broadcast(runs.select(F.col("run").alias("of"), (F.sum("total").over(W.orderBy("run")) - F.col("total")).alias("run_start")))
    placed = blocks.join(starts, blocks.run == F.col("of")).select((F.col("run_start") + F.col("before")).alias("start"), "ids", "lengths", "control", "data")
    id_type = blocks.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_rank = np.frombuffer(raw.value, "<u4")
        for batch in batches:
            for start, ids, lengths, control, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = np.asarray(lengths, np.int64)
                control, data = np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8)
                tokens = by_rank[unpack_all(control, data, n)].astype("<u4").tobytes()
                ends = (np.cumsum(n) * 4).tolist()
                texts = [tokens[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, _arrow(id_type)), pa.array(start + np.cumsum(n) - n, pa.int64()), pa.array(n, pa.int64()), pa.array(texts, pa.binary())],
                    names=["id", "start", "n_tokens", "ids"],
                )

    return placed.mapInArrow(run, f"id {id_type}, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, vocabulary_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write ``docs`` to fresh files in the shared folder and read them back."""
    spark = docs.sparkSession
    path = scratch(spark, "tokens")
    write(docs, vocabulary_path, path, key, text)
    return read_back(spark, path).withColumnRenamed("id", key)

