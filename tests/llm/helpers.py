"""Small tables and slow, obvious versions of the operators."""

from __future__ import annotations

import hashlib
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def messy_rows(seed: int = 3, n: int = 80) -> list[tuple]:
    """Documents with nulls, empty and long texts, copies, near copies, shared lines and repeated rows."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéß中😀") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    sentence = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage, long_one = sentence(60), sentence(3000)
    rows = []
    for i in range(n):
        kind = i % 10
        if kind == 0:
            text = None if i % 20 else ""
        elif kind == 1:
            text = sentence(rng.randint(1, 4))
        elif kind == 2 and rows:
            text = rows[rng.randrange(len(rows))][1]
        elif kind == 3 and rows:
            words = (rows[rng.randrange(len(rows))][1] or sentence(80)).split(" ")
            words[rng.randrange(len(words))] = "changed"
            text = " ".join(words)
        elif kind == 4:
            text = sentence(20) + "\n" + passage + "\n" + sentence(15)
        elif kind == 5:
            text = "don't <|endoftext|> stop  \t\n\n x y\x0b!? 12½ " + sentence(10)
        elif kind == 6 and i < 30:
            text = long_one + "\n" + sentence(5)
        else:
            text = "\n".join(sentence(rng.randint(1, 30)) for _ in range(rng.randint(1, 6)))
        rows.append((i * 7 - 20, text, rng.choice(["en", "de", None]), rng.choice(["hot", "hot", "b", "C", None]), len(text or "")))
    rows += [rows[4], rows[8], rows[8]]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; they must not disturb.
CLASHES = ("ids", "size", "run", "node", "key", "h", "copy", "bucket", "n", "terms", "block", "_key", "label", "id", "own", "next")


def messy(spark, seed: int = 3, n: int = 80):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(messy_rows(seed, n), SCHEMA).repartition(4)
    return df.select("*", *(F.lit(i).alias(c) for i, c in enumerate(CLASHES)))


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def lower_ascii(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text: str | None) -> frozenset:
    w = words(lower_ascii(text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def components(rows: list[tuple]) -> dict:
    """doc_id -> (set size, smallest linked doc_id); identical ids need identical texts."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    names = sorted(sets)
    for a in names:
        for b in names:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in names}


def repeats(rows: list[tuple], length: int = 100) -> dict:
    seen, out = set(), {}
    for i, text in sorted(rows):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            piece = raw[p : p + length]
            if piece in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(piece)
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for j, g in enumerate(gone) if g and (j == 0 or not gone[j - 1]))
        out[i] = (len(raw), sum(gone), spans, sha(kept))
    return out


def cut_lines(rows: list[tuple], least: int) -> dict:
    """doc_id -> text without later repeated runs: a line goes if some run of whole lines over it, of enough words, also starts earlier."""
    first: dict[tuple, tuple] = {}
    lined = {}
    for i, text in sorted(rows):
        lines = (text or "").split("\n")
        lined[i] = (lines, [k for k, x in enumerate(lines) if words(x)])
    for i, (lines, real) in lined.items():
        for a in range(len(real)):
            for b in range(a, len(real)):
                run = tuple(lines[k] for k in real[a : b + 1])
                if sum(len(words(x)) for x in run) >= least:
                    first.setdefault(run, (i, real[a]))
    out = {}
    for i, (lines, real) in lined.items():
        gone = set()
        for a in range(len(real)):
            for b in range(a, len(real)):
                run = tuple(lines[k] for k in real[a : b + 1])
                if sum(len(words(x)) for x in run) >= least and first[run] < (i, real[a]):
                    gone.update(range(real[a], real[b] + 1))
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out
