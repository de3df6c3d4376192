"""Statistics over one array per row.

Everything here is evaluated inside the row: a document never leaves its task,
so none of these expressions causes a shuffle however large the table is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def total_sq(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x)


def ratio(num: Column, den: Column, empty: float = 0.0) -> Column:
    """``num / den`` with a fixed value for an empty denominator (ANSI safe)."""
    return F.when(den > 0, num / F.nullif(den, F.lit(0).cast("double"))).otherwise(F.lit(empty))


def mean_of(n: Column, s1: Column) -> Column:
    return ratio(s1, n)


def var_of(n: Column, s1: Column, s2: Column) -> Column:
    """Population variance from exact integer sums held in doubles."""
    return ratio(F.greatest(n * s2 - s1 * s1, F.lit(0.0)), n * n)


def std_of(n: Column, s1: Column, s2: Column) -> Column:
    return F.sqrt(var_of(n, s1, s2))


def at(a: Column, index0: Column) -> Column:
    return F.get(a, index0.cast("int"))


def percentile_sorted(a: Column, n: Column, p: float) -> Column:
    """Linear-interpolation percentile of a sorted, non-empty array."""
    h = (n - 1.0) * p
    low = at(a, F.floor(h))
    high = F.coalesce(at(a, F.floor(h) + 1), low)
    return low + (high - low) * (h - F.floor(h))


def run_starts(ordered: Column) -> Column:
    """Positions at which a sorted array changes value.

    ``ordered`` must be a stored column: the lambda looks at neighbours.
    """
    marks = F.transform(
        ordered,
        lambda x, i: F.when((i == 0) | (x != F.get(ordered, i - 1)), i).otherwise(F.lit(-1)),
    )
    return F.array_remove(marks, -1)


def run_lengths(starts: Column, n: Column) -> Column:
    """Multiplicity of every distinct value, from the run starts of the sorted array.

    Sorting inside the row replaces the per-document frequency table: no
    shuffle and no growing accumulator.
    """
    return F.transform(
        starts,
        lambda s, i: F.coalesce(F.get(starts, i + 1).cast("double"), n) - s,
    )


# The characters that fill most of any text are taken out and counted one after
# the other, the frequent ones first; only what is left is sorted.  Purely a
# shortcut: any text gives the same counts.
COMMON_CHARS = " etaoinsrhldcumpfgwyb"


def char_counts(c: Column) -> Column:
    """Multiplicity of every distinct character of a string."""
    left = F.aggregate(
        F.array(*[F.lit(ch) for ch in COMMON_CHARS]),
        F.array(c),
        lambda acc, ch: F.array_append(acc, F.replace(F.element_at(acc, -1), ch, F.lit(""))),
    )

    def counted(texts: Column) -> Column:
        # the characters taken out are single bytes; a length in bytes is known without walking the text
        lengths = F.transform(texts, lambda t: F.octet_length(t).cast("double"))
        common = F.transform(F.array(lengths), lambda a: F.zip_with(F.slice(a, 1, len(COMMON_CHARS)), F.slice(a, 2, len(COMMON_CHARS)), lambda x, y: x - y))
        joined = F.array_join(F.sort_array(F.split(F.element_at(texts, -1), "")), "")
        runs = F.regexp_extract_all(joined, F.lit(r"(?s)(.)\1*+"), F.lit(0))
        rare = F.transform(runs, lambda r: F.length(r).cast("double"))
        return F.concat(F.filter(F.get(common, F.lit(0)), lambda x: x > 0), rare)

    return F.get(F.transform(F.array(left), counted), F.lit(0))


def entropy(counts: Column, n: Column) -> Column:
    """Shannon entropy in bits from multiplicities that sum to ``n``."""
    weighted = F.aggregate(counts, F.lit(0.0), lambda acc, x: acc + x * F.log2(x))
    safe = F.greatest(n, F.lit(1.0))
    return F.when(n > 0, F.greatest(F.log2(safe) - weighted / safe, F.lit(0.0))).otherwise(F.lit(0.0))


def steps(a: Column, n: Column) -> Column:
    """Absolute differences of neighbours (``a`` is a stored column)."""
    m = F.greatest(n.cast("int") - 1, F.lit(0))
    return F.transform(F.slice(a, F.lit(2), m), lambda y, i: F.abs(y - F.get(a, i)))


def neighbour_product(a: Column, n: Column) -> Column:
    m = F.greatest(n.cast("int") - 1, F.lit(0))
    return total(F.transform(F.slice(a, F.lit(2), m), lambda y, i: y * F.get(a, i)))


def head_tail(ids: Column, length: int, pad: int) -> tuple[Column, Column]:
    """Fixed-length window over a token array and its attention mask.

    Longer arrays keep the first and last ``length / 2`` tokens, shorter ones
    are padded on the right; the mask is 1 on real tokens and 0 on padding.
    """
    half = length // 2
    missing = F.greatest(F.lit(length) - F.size(ids), F.lit(0))
    clipped = F.concat(F.slice(ids, 1, half), F.slice(ids, -half, half))
    padded = F.concat(ids, F.array_repeat(F.lit(pad).cast("int"), missing))
    window = F.when(F.size(ids) > length, clipped).otherwise(padded)
    mask = F.concat(
        F.array_repeat(F.lit(1), F.least(F.size(ids), F.lit(length))),
        F.array_repeat(F.lit(0), missing),
    )
    return window, mask


def softmax(logits: Column) -> Column:
    """Numerically stable softmax of an array column."""
    top = F.array_max(logits)
    denominator = F.aggregate(
        logits,
        F.struct(F.lit(0.0).alias("s"), top.cast("double").alias("top")),
        lambda acc, x: F.struct((acc["s"] + F.exp(x - acc["top"])).alias("s"), acc["top"].alias("top")),
        lambda acc: F.struct(acc["s"].alias("s"), acc["top"].alias("top")),
    )
    # Both scalars travel as array_repeat columns, so neither is recomputed per element.
    n = F.size(logits)
    return F.zip_with(
        logits,
        F.array_repeat(denominator, n),
        lambda x, d: F.exp(x - d["top"]) / d["s"],
    )


def argmax(a: Column) -> Column:
    """0-based position of the largest element; the first one wins ties."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")
