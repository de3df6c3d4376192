"""Exact byte-level BPE with a minimal acyclic transducer as lexicon of frequent words."""

from __future__ import annotations

import functools
import heapq
import json
import tempfile
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.base import materialize, small_batches, whole_text
from quillmark.llm.pretoken import END_OF_TEXT, split

#: Most frequent words that the lexicon holds; its size does not grow with the input.
LEXICON_WORDS = 1 << 16
#: Characters that a task encodes at once, and words it counts or remembers before it lets go of them.
CHUNK_CHARS = 1_000_000
COUNTED_WORDS = 200_000
REMEMBERED_WORDS = 250_000
#: Words longer than this use a heap instead of repeated scans.
LONG_WORD = 48


# ---- vocabulary ---------------------------------------------------------------------------------------------------


def byte_letters() -> dict[str, int]:
    """Letter that stands for a byte in the vocabulary file -> byte: printable Latin-1 as itself, the rest from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


@dataclass(frozen=True)
class Vocabulary:
    """Bytes of every id, ids of single bytes, and merges: (left id, right id) -> (rank, id)."""

    pieces: list[bytes]
    single: list[int]
    merges: dict[tuple[int, int], tuple[int, int]]
    end: int

    @staticmethod
    def parse(text: str) -> Vocabulary:
        data = json.loads(text)
        letters = byte_letters()
        ids: dict[str, int] = data["model"]["vocab"]
        special = {t["content"]: t["id"] for t in data["added_tokens"]}
        pieces = [b""] * (max([*ids.values(), *special.values()]) + 1)
        for token, i in ids.items():
            pieces[i] = bytes(letters[c] for c in token)
        for token, i in special.items():
            pieces[i] = token.encode()
        pairs = (m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"])
        merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        single = [0] * 256
        for letter, b in letters.items():
            single[b] = ids[letter]
        return Vocabulary(pieces, single, merges, special[END_OF_TEXT])

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: the lowest-ranked neighbouring pair is merged, the leftmost of equals first."""
        ids = [self.single[b] for b in word]
        if len(ids) > LONG_WORD:
            return self._merge_long(ids)
        merges = self.merges
        none = (1 << 60, 0)
        found = [merges.get(p, none) for p in zip(ids, ids[1:], strict=False)]
        while found:
            best = min(found)
            if best is none:
                break
            i = found.index(best)
            ids[i : i + 2] = [best[1]]
            del found[i]
            if i > 0:
                found[i - 1] = merges.get((ids[i - 1], ids[i]), none)
            if i < len(found):
                found[i] = merges.get((ids[i], ids[i + 1]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a linked list and a heap, so that a word of a million letters stays cheap."""
        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(*self.merges[p], i, *p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.merges]
        heapq.heapify(heap)
        gone = bytearray(n)
        while heap:
            _, new, i, left, right = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j < 0 or ids[i] != left or ids[j] != right:
                continue
            ids[i], gone[j], after[i] = new, 1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (ids[a], ids[b]) in self.merges:
                    heapq.heappush(heap, (*self.merges[ids[a], ids[b]], a, ids[a], ids[b]))
        return [x for x, g in zip(ids, gone, strict=True) if not g]


# ---- lexicon ------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Lexicon:
    """A minimal acyclic automaton whose arcs add up to a word's number, and the ids of word k.

    ``arcs`` holds ``state * 256 + byte`` in ascending order, ``goes`` the next
    state, ``adds`` the number of accepted words that the arc skips; state
    ``s`` accepts if ``accepts[s]``.  Word k has ``ids[starts[k]:starts[k + 1]]``.
    """

    arcs: np.ndarray
    goes: np.ndarray
    adds: np.ndarray
    accepts: np.ndarray
    starts: np.ndarray
    ids: np.ndarray

    KINDS = (np.int64, np.int32, np.int32, np.int8, np.int32, np.int32)

    def look_up(self, words: list[bytes]) -> np.ndarray:
        """Numbers of the words, -1 for those not in the lexicon; all words walk the automaton side by side."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        letters = np.frombuffer(b"".join(words), np.uint8)
        begins = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(words) else lengths
        state, number = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        out = np.full(len(words), -1, np.int64)
        alive = np.arange(len(words)) if len(self.arcs) else np.empty(0, np.int64)
        step = 0
        while len(alive):
            done = lengths[alive] == step
            ended = alive[done]
            ended = ended[self.accepts[state[ended]] == 1]
            out[ended] = number[ended]
            alive = alive[~done]
            wanted = state[alive] * 256 + letters[begins[alive] + step]
            at = np.minimum(np.searchsorted(self.arcs, wanted), len(self.arcs) - 1)
            ok = self.arcs[at] == wanted
            alive, at = alive[ok], at[ok]
            state[alive] = self.goes[at]
            number[alive] += self.adds[at]
            step += 1
        return out

    def dump(self) -> bytes:
        parts = [np.ascontiguousarray(a, k) for a, k in zip(self._arrays(), self.KINDS, strict=True)]
        head = np.array([len(p) for p in parts], np.int64).tobytes()
        return head + b"".join(p.tobytes() + b"\0" * (-p.nbytes % 8) for p in parts)

    def _arrays(self) -> tuple[np.ndarray, ...]:
        return self.arcs, self.goes, self.adds, self.accepts, self.starts, self.ids

    @staticmethod
    def memory_map(raw: bytes) -> Lexicon:
        """Map ``raw`` from a nameless file: read-only pages that the system may drop and the task need not copy."""
        with tempfile.TemporaryFile() as file:
            file.write(raw)
            file.flush()
            whole = np.memmap(file, np.uint8, "r")
        sizes = whole[: 8 * len(Lexicon.KINDS)].view(np.int64)
        arrays, at = [], 8 * len(Lexicon.KINDS)
        for n, kind in zip(sizes.tolist(), Lexicon.KINDS, strict=True):
            length = n * np.dtype(kind).itemsize
            arrays.append(whole[at : at + length].view(kind))
            at += length + -length % 8
        return Lexicon(*arrays)


def compile_lexicon(words: Iterable[bytes], vocabulary: Vocabulary) -> Lexicon:
    """Build the automaton from words in any order: states with equal futures are shared as soon as they are final."""
    ordered = sorted(set(words))
    ids = [vocabulary.merge(w) for w in ordered]
    # a state: [accepts, {byte: state}]; finished states are known by (accepts, arcs)
    known: dict[tuple, int] = {}
    finished: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

    def finish(node: list) -> int:
        signature = (node[0], tuple(node[1].items()))
        number = known.get(signature)
        if number is None:
            number = known[signature] = len(finished)
            finished.append(signature)
        return number

    path: list[list] = [[False, {}]]
    last = b""
    for word in ordered:
        common = 0
        while common < min(len(last), len(word)) and last[common] == word[common]:
            common += 1
        for depth in range(len(last), common, -1):
            path[depth - 1][1][last[depth - 1]] = finish(path.pop())
        for _ in word[common:]:
            path.append([False, {}])
        path[-1][0] = True
        last = word
    for depth in range(len(last), 0, -1):
        path[depth - 1][1][last[depth - 1]] = finish(path.pop())
    root = finish(path[0])

    # futures come before their states, so words below a state add up in one pass; the root, finished last, becomes 0
    below = [0] * len(finished)
    arcs = []
    rename = lambda s: len(finished) - 1 - s
    for s, (accepts, out) in enumerate(finished):
        skipped = int(accepts)
        for byte, target in out:
            arcs.append((rename(s) * 256 + byte, rename(target), skipped))
            skipped += below[target]
        below[s] = skipped
    assert root == len(finished) - 1
    table = np.array(sorted(arcs), dtype=np.int64).reshape(-1, 3)
    accepts = np.array([int(finished[rename(s)][0]) for s in range(len(finished))], np.int8)
    starts = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
    flat = np.array([x for i in ids for x in i], dtype=np.int32)
    return Lexicon(table[:, 0], table[:, 1].astype(np.int32), table[:, 2].astype(np.int32), accepts, starts, flat)


# ---- encoding on Spark --------------------------------------------------------------------------------------------


def _pieces(text: str) -> Iterator[tuple[str, bool]]:
    """Ordinary stretches of a text and the special token between them."""
    parts = text.split(END_OF_TEXT)
    for i, part in enumerate(parts):
        if i:
            yield END_OF_TEXT, True
        if part:
            yield part, False


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[str] = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
        counts.clear()
        return out

    for batch in batches:
        for text in batch.column(0).to_pylist():
            for piece, special in _pieces(text):
                if not special:
                    counts.update(split(piece))
            if len(counts) >= COUNTED_WORDS:
                yield flush()
    if counts:
        yield flush()


def frequent_words(docs: DataFrame, text: str = "text", most: int = LEXICON_WORDS) -> DataFrame:
    """The ``most`` frequent words over all texts, ties by the word; tasks sum up their own words first.

    The number of words at each level of counts tells from which count on a word
    can be among them, so that few more than ``most`` words are sorted and sent,
    however many partitions there are.
    """
    counted = docs.select(whole_text(text).alias("text")).mapInArrow(_count_words, "word string, n long")
    words = materialize(counted.groupBy("word").agg(F.sum("n").alias("n")), "words")
    levels = words.groupBy(F.floor(F.log2("n") * 16).alias("level")).agg(F.count("*").alias("k"), F.min("n").alias("least")).orderBy(F.desc("level")).collect()
    least, found = 0, 0
    for row in levels:  # sixteen rows for each doubling of the count
        least, found = row["least"], found + row["k"]
        if found >= most:
            break
    return words.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(most)


class Encoder:
    """Words to ids in one task: the lexicon first, exact merges for the others, each distinct word once."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon) -> None:
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def learn(self, words: set[str]) -> None:
        if len(self.memory) + len(words) > REMEMBERED_WORDS:
            self.memory, self.older = {}, self.memory
        new = [w for w in words if w not in self.memory]
        self.memory.update((w, self.older[w]) for w in new if w in self.older)
        new = [w for w in new if w not in self.older]
        raw = [w.encode("utf-8") for w in new]
        ids, starts = self.lexicon.ids, self.lexicon.starts
        for word, letters, k in zip(new, raw, self.lexicon.look_up(raw).tolist(), strict=True):
            found = ids[starts[k] : starts[k + 1]] if k >= 0 else np.array(self.vocabulary.merge(letters), np.int32)
            self.memory[word] = found.tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        end = np.array([self.vocabulary.end], np.int32).tobytes()
        out: list[bytes] = []
        cut = [[(split(p), False) if not special else ([], True) for p, special in _pieces(t)] for t in texts]
        distinct: set[str] = set()
        for parts in cut:
            distinct.update(*(words for words, _ in parts))
        self.learn(distinct)
        for parts in cut:
            known = self.memory.__getitem__
            out.append(b"".join(end if special else b"".join(map(known, words)) for words, special in parts))
        return out


@functools.lru_cache(maxsize=2)
def _vocabulary(text: str) -> Vocabulary:
    return Vocabulary.parse(text)


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK_CHARS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode(docs: DataFrame, vocabulary_path: str, text: str = "text", most: int = LEXICON_WORDS) -> DataFrame:
    """``docs`` plus ``ids`` (binary: little-endian unsigned 32-bit) and ``n_tokens``.

    The ids are those of the vocabulary file's own library without added
    special tokens; the end-of-text string in a text is its special token.  A
    null or empty text has no ids.  Two passes over the texts: one counts words
    for the lexicon (at most ``most`` words, the only thing that reaches the
    driver), one encodes without a shuffle.  What is broadcast is the
    vocabulary file and the lexicon, both of fixed size.  Same-named columns of
    the input are replaced; repeated rows give equal rows.
    """
    small_batches(docs)
    with open(vocabulary_path, encoding="utf-8") as file:
        raw = file.read()
    words = [r["word"].encode() for r in frequent_words(docs, text, most).collect()]
    lexicon = compile_lexicon(words, Vocabulary.parse(raw))
    shared = docs.sparkSession.sparkContext.broadcast((raw, lexicon.dump()))
    names = [c for c in docs.columns if c not in ("ids", "n_tokens")]
    plain = docs.select(*names, whole_text(text).alias("_whole"))
    schema = docs.select(*names).schema.add("ids", "binary").add("n_tokens", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, dumped = shared.value
        encoder = Encoder(_vocabulary(vocabulary), Lexicon.memory_map(dumped))
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for a, b in _chunks(texts):
                ids = encoder.encode(texts[a:b])
                counts = pa.array([len(x) // 4 for x in ids], pa.int64())
                columns = [c.slice(a, b - a) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.binary()), counts], names=[*names, "ids", "n_tokens"])

    return plain.mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary_path: str, ids: str = "ids") -> DataFrame:
    """``encoded`` plus ``decoded``, the text of its ids; bytes that are no UTF-8 become U+FFFD, a null stays null."""
    with open(vocabulary_path, encoding="utf-8") as file:
        raw = file.read()
    shared = encoded.sparkSession.sparkContext.broadcast(raw)
    names = [c for c in encoded.columns if c != "decoded"]
    at = names.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = _vocabulary(shared.value).pieces.__getitem__
        for batch in batches:
            texts = [
                None if x is None else b"".join(map(piece, np.frombuffer(x, np.uint32).tolist())).decode("utf-8", "replace")
                for x in batch.column(at).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, "decoded"])

    return encoded.select(*names).mapInArrow(run, encoded.select(*names).schema.add("decoded", "string"))
