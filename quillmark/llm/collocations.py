"""Phrase collocations: SON partitioning finds the phrases, one exact pass counts them, cuts score them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmark.llm.base import materialize, small, small_batches, whole_text

#: Fixed rules: characters that end a piece, and those that part words inside one.
BREAKS = ".,;:!?\n\x0b\x0c\r"
BLANKS = " \t"
NO_LANGUAGE = "und"
#: Production settings: support of a phrase, its longest length, phrases reported for a language.
SUPPORT = 100
LONGEST = 5
TOP = 2000
#: Shards are made so large that the local support is about this ...
LOCAL_SUPPORT = 4
#: ... up to so many words, which a task holds in memory as 32-bit numbers.
SHARD_WORDS = 6_000_000
#: Bits of the map that the union of locally frequent phrases travels as: 8 MB, whatever the input.
MAP_BITS = 26
#: Where shards of that size would report phrases seen so often or less, phrases are counted level by level instead.
LEAST_LOCAL = 2
#: Words of one stored piece of numbered text.
PIECE_WORDS = 1 << 18
#: Batches are tokenised in joined stretches of about so many bytes.
STRETCH = 1 << 20

_CLEAN = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + (BREAKS + BLANKS).encode(),
    b"abcdefghijklmnopqrstuvwxyz" + b"\n" * len(BREAKS) + b" " * len(BLANKS),
)
_BREAK, _BLANK = -1, -2
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)

# accept(length, first place of every distinct phrase, their counts) -> which of them go on
Accept = Callable[[int, np.ndarray, np.ndarray], np.ndarray]


class _Numbers(dict):
    """Words to numbers from 0, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) - 2
        return number


class Part:
    """What a shard holds of one language: numbers of its words, with a mark where a piece ends."""

    def __init__(self, lang: str, total: int) -> None:
        self.lang, self.total = lang, total
        self.numbers = _Numbers({b"\n": _BREAK, b"": _BLANK})
        self.places: list[np.ndarray] = []
        self.n_words = 0
        self.pending: list[bytes] = []
        self.pending_size = 0

    def add(self, text: str) -> None:
        raw = text.encode("utf-8", "replace")
        self.pending.append(raw)
        self.pending_size += len(raw)
        if self.pending_size >= STRETCH:
            self.settle()

    def settle(self) -> None:
        if not self.pending:
            return
        joined = b"\n".join([*self.pending, b""]).translate(_CLEAN).replace(b"\n", b" \n ")
        self.pending, self.pending_size = [], 0
        words = joined.split(b" ")
        found = np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words))
        found = found[found != _BLANK]
        self.n_words += int((found >= 0).sum())
        self.places.append(found)

    def close(self) -> None:
        self.settle()
        self.at = np.concatenate([*self.places, np.array([_BREAK], np.int32)])
        self.places = []
        self.words = list(self.numbers)[2:]
        salt = xxhash.xxh64_intdigest(self.lang.encode("utf-8", "replace"))
        self.hashes = np.fromiter((xxhash.xxh64_intdigest(w, salt) for w in self.words), np.uint64, len(self.words))

    def codes(self, k: int, first: np.ndarray) -> np.ndarray:
        """64-bit hashes of the phrases of ``k`` words that begin at ``first``; the leading MAP_BITS are their place in the map."""
        h = np.full(len(first), k, np.uint64)
        for j in range(k):
            h = (h ^ self.hashes[self.at[first + j]]) * _STEP
            h ^= h >> np.uint64(29)
        return h * _MIX

    def phrases(self, k: int, first: np.ndarray) -> list[str]:
        at = self.at
        return [b" ".join([self.words[at[i + j]] for j in range(k)]).decode("utf-8", "replace") for i in first.tolist()]

    def mine(self, accept: Accept) -> None:
        """All phrases of up to LONGEST words, level by level, both parts one word shorter being accepted.

        A phrase is known by the pair of its two shorter parts, so nothing is
        hashed and counts are exact.
        """
        at = self.at
        place = np.flatnonzero(at >= 0)
        code = at.astype(np.int32)
        for k in range(1, LONGEST + 1):
            if not len(place):
                return
            if k == 1:
                key = at[place].astype(np.int64)
            else:
                key = code[place].astype(np.int64) << 32 | code[place + 1]
            distinct, first, number, counts = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            good = accept(k, place[first], counts)
            code = np.full(len(at), -1, np.int32)
            held = good[number]
            code[place[held]] = number[held]
            place = np.flatnonzero((code[:-1] >= 0) & (code[1:] >= 0))


def _shards(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[Part]:
    """The languages of one shard after the other; a shard ends at ``size`` words and with its task."""
    parts: dict[str, Part] = {}

    def flush() -> Iterator[Part]:
        while parts:
            part = parts.pop(next(iter(parts)))
            part.close()
            yield part

    for batch in batches:
        for lang, total, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if lang not in parts:
                parts[lang] = Part(lang, total)
            parts[lang].add(text)
            if sum(p.n_words for p in parts.values()) >= size:
                yield from flush()
    yield from flush()


def _local_supports(support: int, size: int):
    """Mining pass: phrases that are frequent in a shard at its share of the support.

    A row has the hash of a phrase and by how much its count passes ``least - 1``,
    the most that it could have had unseen; the row without a hash has that number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _shards(batches, size):
            least = max(1, -(-support * part.n_words // part.total))
            codes, over = [np.empty(0, np.int64)], [np.empty(0, np.int64)]

            def accept(k: int, first: np.ndarray, counts: np.ndarray, part=part, least=least, codes=codes, over=over) -> np.ndarray:
                good = counts >= least
                codes.append(part.codes(k, first[good]).view(np.int64))
                over.append(counts[good] - (least - 1))
                return good

            part.mine(accept)
            n = sum(map(len, codes))
            yield pa.RecordBatch.from_arrays([pa.array([part.lang], pa.string()), pa.array([None], pa.int64()), pa.array([least - 1], pa.int64())], names=["lang", "code", "over"])
            yield pa.RecordBatch.from_arrays([pa.array([part.lang] * n, pa.string()), pa.array(np.concatenate(codes)), pa.array(np.concatenate(over))], names=["lang", "code", "over"])

    return run


def _exact_counts(shared, size: int):
    """Counting pass: occurrences of the phrases in the map, shard by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(shared.value, np.uint64)
        for part in _shards(batches, size):
            rows: list[tuple[int, np.ndarray, np.ndarray]] = []

            def accept(k: int, first: np.ndarray, counts: np.ndarray, part=part, rows=rows) -> np.ndarray:
                bits = (part.codes(k, first) >> np.uint64(64 - MAP_BITS)).astype(np.int64)
                good = (bitmap[bits >> 6] >> (bits & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
                rows.append((k, first[good], counts[good]))
                return good

            part.mine(accept)
            for k, first, counts in rows:
                for a in range(0, len(first), 50_000):
                    phrases = part.phrases(k, first[a : a + 50_000])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part.lang] * len(phrases), pa.string()), pa.array(phrases, pa.string()),
                         pa.array(np.full(len(phrases), k, np.int32)), pa.array(counts[a : a + 50_000].astype(np.int64))],
                        names=["lang", "phrase", "k", "f"])

    return run


def _word_counts(size: int):
    """First level: occurrences of every word, shard by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _shards(batches, size):
            counts = np.bincount(part.at[part.at >= 0], minlength=len(part.words))
            for a in range(0, len(part.words), 50_000):
                words = [w.decode("utf-8", "replace") for w in part.words[a : a + 50_000]]
                yield pa.RecordBatch.from_arrays([pa.array([part.lang] * len(words), pa.string()), pa.array(words, pa.string()), pa.array(counts[a : a + 50_000])], names=["lang", "phrase", "f"])

    return run


class Dictionary:
    """Numbers of the frequent words of every language: their places in the order of their hashes."""

    def __init__(self, langs: list[str], words: list[str]) -> None:
        self.langs = sorted(set(langs))
        number = {lang: i for i, lang in enumerate(self.langs)}
        salts = [xxhash.xxh64_intdigest(lang.encode("utf-8", "replace")) for lang in self.langs]
        own = np.array([number[lang] for lang in langs], np.int32)
        raw = [w.encode("utf-8", "replace") for w in words]
        hashes = np.fromiter((xxhash.xxh64_intdigest(w, salts[i]) for i, w in zip(own.tolist(), raw, strict=True)), np.uint64, len(raw))
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.own = hashes[order], own[order]
        self.joined = b"".join([raw[i] for i in order.tolist()])
        self.ends = np.concatenate([[0], np.cumsum([len(raw[i]) for i in order.tolist()], dtype=np.int64)])

    def word(self, number: int) -> bytes:
        return self.joined[self.ends[number] : self.ends[number + 1]]

    def numbers(self, part: Part) -> np.ndarray:
        """The number of each word of ``part``, -1 for one that is not frequent; equal hashes are told apart by the words."""
        out = np.full(len(part.words), -1, np.int32)
        if part.lang not in self.langs or not len(part.words):
            return out
        lang, at = self.langs.index(part.lang), np.searchsorted(self.hashes, part.hashes)
        hits = np.flatnonzero(self.hashes[np.minimum(at, len(self.hashes) - 1)] == part.hashes)
        for i, j in zip(hits.tolist(), at[hits].tolist(), strict=True):
            while j < len(self.hashes) and self.hashes[j] == part.hashes[i]:
                if self.own[j] == lang and self.word(j) == part.words[i]:
                    out[i] = j
                    break
                j += 1
        return out


def _numbered(shared, size: int):
    """Runs of two or more frequent words as their numbers, with -1 behind each run; pieces end with a run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _shards(batches, size):
            ids = np.append(np.append(shared.value.numbers(part), np.int32(-1))[np.maximum(part.at, -1)], np.int32(-1))
            pairs = (ids[:-1] >= 0) & (ids[1:] >= 0)
            kept = np.append(pairs, False)
            kept[1:] |= pairs
            behind = ~kept
            behind[1:] &= kept[:-1]
            behind[0] = False
            ids = np.where(kept, ids, np.int32(-1))[kept | behind]
            stops = np.flatnonzero(ids < 0) + 1
            cuts = np.unique(stops[np.searchsorted(stops, np.arange(PIECE_WORDS, len(ids), PIECE_WORDS))]) if len(ids) else []
            for piece in np.split(ids, cuts):
                if len(piece):
                    yield pa.RecordBatch.from_arrays([pa.array([piece.astype("<i4").tobytes()], pa.binary())], names=["ids"])

    return run


def _number_codes(numbers: list[np.ndarray]) -> np.ndarray:
    """64-bit hashes of phrases given as the numbers of their words; the leading MAP_BITS are their place in a map."""
    h = np.full(len(numbers[0]), len(numbers), np.uint64)
    for n in numbers:
        h = (h ^ n.astype(np.uint64)) * _STEP
        h ^= h >> np.uint64(29)
    return h * _MIX


def _level_counts(k: int, maps: list, size: int):
    """Occurrences of the phrases of ``k`` frequent words whose shorter parts are in the maps of their levels.

    A phrase is its word numbers, two in a 64-bit number, so counts are exact.
    """

    def counted(ids: np.ndarray) -> pa.RecordBatch:
        good = ids >= 0
        for level, shared in enumerate(maps, 2):
            place = np.flatnonzero(good[:-1] & good[1:])
            bits = (_number_codes([ids[place + j] for j in range(level)]) >> np.uint64(64 - MAP_BITS)).astype(np.int64)
            bitmap = np.frombuffer(shared.value, np.uint64)
            good = np.zeros(len(ids), bool)
            good[place[(bitmap[bits >> 6] >> (bits & 63).astype(np.uint64) & np.uint64(1)).astype(bool)]] = True
        place = np.flatnonzero(good[:-1] & good[1:])
        number = ids[place].astype(np.int64)
        for j in range(1, k - 1):
            number = np.unique(number << 32 | ids[place + j], return_inverse=True)[1]
        _, first, counts = np.unique(number << 32 | ids[place + k - 1], return_index=True, return_counts=True)
        words = [ids[place[first] + j].astype(np.int64) for j in range(k)]
        keys = [words[j] << 32 | words[j + 1] if j + 1 < k else words[j] for j in range(0, k, 2)]
        return pa.RecordBatch.from_arrays([*map(pa.array, keys), pa.array(counts.astype(np.int64))], names=[*(f"w{j}" for j in range(len(keys))), "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            for piece in batch.column(0):
                held.append(np.frombuffer(piece.as_buffer(), "<i4"))
                if sum(map(len, held)) >= size:
                    yield counted(np.concatenate(held))
                    held = []
        if held:
            yield counted(np.concatenate(held))

    return run


def _words_of(batch: pa.RecordBatch, k: int) -> list[np.ndarray]:
    keys = [c.to_numpy() for c in batch.columns[: (k + 1) // 2]]
    return [keys[j // 2] >> 32 if j % 2 == 0 and j + 1 < k else keys[j // 2] & 0xFFFFFFFF for j in range(k)]


def _codes_of(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_number_codes(_words_of(batch, k)).view(np.int64))], names=["code"])

    return run


def _spelled(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            numbers = [n.tolist() for n in _words_of(batch, k)]
            phrases = [b" ".join(map(known.word, some)).decode("utf-8", "replace") for some in zip(*numbers, strict=True)]
            langs = [known.langs[known.own[n]] for n in numbers[0]]
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(phrases, pa.string()), pa.array([k] * len(phrases), pa.int32()), batch.column(batch.num_columns - 1)], names=["lang", "phrase", "k", "f"])

    return run


def _bitmap(codes: DataFrame) -> bytes:
    """The map of the leading bits of the column ``code``."""
    bit = F.shiftrightunsigned("code", 64 - MAP_BITS)
    bits = codes.select(bit.alias("bit")).selectExpr("cast(shiftright(bit, 6) as int) as word", "shiftleft(1L, cast(bit & 63 as int)) as mask")
    table = bits.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    bitmap = np.zeros(1 << (MAP_BITS - 6), np.uint64)
    bitmap[table["word"].to_numpy()] = table["mask"].to_numpy().view(np.uint64)
    return bitmap.tobytes()


def _level_by_level(rows: DataFrame, support: int, size: int) -> DataFrame:
    """Exact counts of the frequent phrases, one length after the other over all shards.

    Shards report every phrase whose two shorter parts are frequent in the
    whole, none that one shard alone can't rule out; frequent words are numbered
    and the text is kept as their numbers, so it is tokenised twice only.
    """
    context = rows.sparkSession.sparkContext
    words = rows.mapInArrow(_word_counts(size), "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    words = materialize(words.where(F.col("f") >= support), "words")
    listed = words.select("lang", "phrase").toArrow()
    phrases = words.select("lang", "phrase", F.lit(1).alias("k"), "f")
    if not listed.num_rows:
        return phrases
    shared = context.broadcast(Dictionary(listed["lang"].to_pylist(), listed["phrase"].to_pylist()))
    text = materialize(rows.mapInArrow(_numbered(shared, size), "ids binary"), "numbered", "zstd")
    maps: list = []
    for k in range(2, LONGEST + 1):
        keys = [f"w{j}" for j in range((k + 1) // 2)]
        counted = text.mapInArrow(_level_counts(k, maps, size), ", ".join(f"{c} long" for c in [*keys, "f"]))
        level = materialize(counted.groupBy(*keys).agg(F.sum("f").alias("f")).where(F.col("f") >= support), f"phrases{k}")
        phrases = phrases.unionByName(level.mapInArrow(_spelled(shared, k), "lang string, phrase string, k int, f long"))
        if level.isEmpty():
            break
        if k < LONGEST:
            maps = [*maps, context.broadcast(_bitmap(level.mapInArrow(_codes_of(k), "code long")))]
    return phrases


def word_totals(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, n``: words of every language (null counts as NO_LANGUAGE) that has any."""
    word = r"[^\x20\x09.,;:!?\x0A-\x0D]+"
    sized = docs.select(F.coalesce(F.col(lang), F.lit(NO_LANGUAGE)).alias("lang"), F.regexp_count(whole_text(text), F.lit(word)).cast("long").alias("n"))
    return sized.groupBy("lang").agg(F.sum("n").alias("n")).where("n > 0")


def frequent_phrases(docs: DataFrame, support: int = SUPPORT, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """Exact counts of all phrases of 1 to LONGEST words that occur ``support`` times in a language.

    Returns ``lang, phrase, k, f`` and the word totals ``lang, n``.  Partition
    (SON): a shard is mined whole at the support times its share of the
    language's words; a phrase that is frequent at all is so in some shard.  A
    shard that does not report a phrase holds it less often than its local
    support, so the counts of those that do bound the count of all; what cannot
    reach the support leaves the union.  The union travels as a map of hashed
    bits of fixed size, and a second pass counts every phrase in it exactly.
    Phrases that share a bit or a hash with a candidate are counted as well and
    fall out in the end.

    Shards have ``LOCAL_SUPPORT / support`` of all words, but at most
    SHARD_WORDS; where many small partitions hold less, fewer tasks read them.
    Beyond ``support * SHARD_WORDS / LOCAL_SUPPORT`` words the local support
    falls; where it would be LEAST_LOCAL or less and shards would report nearly
    all their distinct phrases, phrases are counted level by level instead.
    """
    small_batches(docs)
    spark = docs.sparkSession
    totals = materialize(word_totals(docs, text, lang), "totals")
    words = totals.agg(F.sum("n")).first()[0] or 0
    size = min(SHARD_WORDS, max(1, -(-words * LOCAL_SUPPORT // support)))
    parts, wanted = docs.rdd.getNumPartitions(), max(1, words // size, spark.sparkContext.defaultParallelism)
    rows = docs.select(F.coalesce(F.col(lang), F.lit(NO_LANGUAGE)).alias("lang"), whole_text(text).alias("text"))
    rows = rows.coalesce(wanted) if parts > wanted else rows
    rows = rows.join(small(totals), "lang").select("lang", "n", "text")

    if support * size <= LEAST_LOCAL * words:
        return materialize(_level_by_level(rows, support, size), "phrases"), totals
    found = rows.mapInArrow(_local_supports(support, size), "lang string, code long, over long")
    found = materialize(found.groupBy("lang", "code").agg(F.sum("over").alias("over")), "found")
    unseen = found.where("code is null").select(F.col("lang").alias("in"), F.col("over").alias("unseen"))
    union = found.where("code is not null").join(small(unseen), F.col("lang") == F.col("in")).where(F.col("over") + F.col("unseen") >= support)
    shared = spark.sparkContext.broadcast(_bitmap(union))
    counted = rows.mapInArrow(_exact_counts(shared, size), "lang string, phrase string, k int, f long")
    summed = counted.groupBy("lang", "phrase", "k").agg(F.sum("f").alias("f")).where(F.col("f") >= support)
    return materialize(summed, "phrases"), totals


def _joined(words: str, start: str, length: str):
    return F.expr(f"array_join(slice({words}, {start}, {length}), ' ')")


def collocations(
    docs: DataFrame, support: int = SUPPORT, top: int = TOP, share: int = 100, text: str = "text", lang: str = "lang",
) -> DataFrame:
    """The best collocations of every language: ``lang, rank, phrase, a, l, r, n, score``.

    A candidate of 2 to LONGEST words with a = f(phrase) >= ``support`` is
    scored at its weakest cut by floor(1000 * a * n / (l * r)), in whole numbers
    of up to 38 digits; of equal cuts the first holds.  It is dropped if a
    longer candidate holds it with 100 * f(longer) >= ``share`` * a.  Of every
    language the first ``top`` by score, count and phrase (byte order) stay.

    A null text counts as empty, a null language as ``und``; repeated rows
    count; texts of any length are read whole; pieces never reach across rows;
    ties are settled by the phrase; an empty table has no phrases; other columns
    are ignored.
    """
    phrases, totals = frequent_phrases(docs, support, text, lang)
    table = phrases.select(F.col("lang").alias("in"), F.col("phrase").alias("of"), F.col("f").alias("count"))
    long_ones = phrases.where("k >= 2").select("lang", "phrase", "k", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))

    cuts = long_ones.select("lang", "phrase", "a", "k", "w", F.explode(F.expr("sequence(1, k - 1)")).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", _joined("w", "1", "cut").alias("first"), _joined("w", "cut + 1", "k - cut").alias("rest"))
    for side, name in (("first", "l"), ("rest", "r")):
        other = small(table.withColumnRenamed("count", name))
        cuts = cuts.join(other, (F.col("lang") == F.col("in")) & (F.col(side) == F.col("of"))).drop("in", "of", side)
    cuts = cuts.join(small(totals), "lang")
    score = F.expr("(cast(1000 as decimal(20,0)) * a * n) div (cast(l as decimal(20,0)) * r)")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))

    inner = long_ones.where("k >= 3").select("lang", "a", "k", "w", F.explode(F.expr("sequence(2, k - 1)")).alias("size"))
    inner = inner.select("lang", "a", "w", "size", F.explode(F.expr("sequence(1, k - size + 1)")).alias("start"))
    held = inner.groupBy(F.col("lang").alias("in"), _joined("w", "start", "size").alias("of")).agg(F.max("a").alias("longer"))
    kept = scored.join(held, (F.col("lang") == F.col("in")) & (F.col("phrase") == F.col("of")), "left")
    kept = kept.where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))

    order = W.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "best.l", "best.r", "n", "best.score")
