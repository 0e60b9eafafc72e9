"""Adaptive K: how many items of a block are worth keeping.

All of it works on an array column of strings, so a block stays in its row and nothing is shuffled. SimHash, the
bigram curve and leader clustering over long arrays run in one Arrow pass a batch (SimHash alone is also given as a
column expression); the arithmetic around them is column expressions.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hamming radius of a cluster, least gain of a knee, tolerance and factor of the compression test, its least text.
RADIUS, LEAST_GAIN, TOLERANCE, FACTOR, LEAST_TEXT = 3, 0.05, 0.15, 1.2, 200


def simhash(text: Column) -> Column:
    """64-bit SimHash over shingles of four code points of the lower-cased text, as a long of the same bits."""
    t = F.lower(text)
    n = F.length(t)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(n - 3, F.lit(1))), lambda i: F.md5(F.substring(t, i, 4)))
    half = lambda start: F.transform(grams, lambda g: F.conv(F.substring(g, start, 8), 16, 10).cast("long"))

    def votes(halves: Column) -> Column:
        bits = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda b: F.aggregate(halves, F.lit(0), lambda a, x: a + F.when(F.getbit(x, b) == 1, 1).otherwise(-1)))
        return F.aggregate(F.zip_with(bits, F.sequence(F.lit(0), F.lit(31)), lambda v, b: F.when(v > 0, F.pow(F.lit(2.0), b).cast("long")).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a + x)

    return F.shiftleft(votes(half(1)), 32).bitwiseOR(votes(half(9)))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def cluster_count(prints: Column, radius: int = RADIUS) -> Column:
    """Leaders of greedy clustering in order: a fingerprint within the radius of a leader joins it."""
    none = F.expr("cast(array() as array<bigint>)")
    return F.size(F.aggregate(prints, none, lambda acc, x: F.when(F.exists(acc, lambda c: hamming(c, x) <= radius), acc).otherwise(F.array_append(acc, x))))


def bigram_curve(items: Column) -> Column:
    """For each item the number of distinct word bigrams up to it; an item of one word counts the word alone.

    A null item counts as empty. Two sorts of a row's bigrams, so the work grows with n log n: the first place of each
    bigram is the head of its run, and an item's count is the number of first places sorted before its own end.
    """
    words = lambda s: F.filter(F.split(F.lower(F.coalesce(s, F.lit(""))), r"\s+", -1), lambda w: w != "")
    pairs = lambda w: F.when(F.size(w) < 2, F.array(F.concat(F.array_join(w, ""), F.lit("\u0001")))).otherwise(F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws("\u0001", a, b)))
    # arrays are bound by a lambda, so that each is computed once
    bound = lambda value, f: F.get(F.transform(F.array(value), f), 0)
    split = F.transform(items, lambda s: words(s))
    placed = F.flatten(F.transform(split, lambda w, i: F.transform(pairs(w), lambda p: F.struct(p.alias("pair"), i.alias("at")))))
    heads = lambda run: F.filter(run, lambda x, j: (j == 0) | (F.get(run, j - 1)["pair"] != x["pair"]))
    firsts = F.transform(bound(F.sort_array(placed), heads), lambda x: F.struct(x["at"].alias("at"), F.lit(False).alias("end")))
    ends = F.transform(items, lambda s, i: F.struct(i.alias("at"), F.lit(True).alias("end")))
    ranked = F.transform(F.sort_array(F.concat(firsts, ends)), lambda x, j: F.struct(x["end"].alias("end"), (j - x["at"]).alias("seen")))
    return F.transform(F.filter(ranked, lambda x: x["end"]), lambda x: x["seen"])


def knee(curve: Column) -> Column:
    """The knee of a curve, counted from 1; null if there is none or the curve has fewer than three points."""
    # bound once by a lambda, so the curve is computed once however often it is used
    return F.get(F.transform(F.array(curve), _knee_of), 0)


def _knee_of(curve: Column) -> Column:
    n = F.size(curve)
    low, high = F.get(curve, 0), F.try_element_at(curve, F.lit(-1))
    spread = (high - low).cast("double")
    best = F.array_max(F.transform(curve, lambda y, i: F.struct((F.try_divide(y - low, spread) - F.try_divide(i, n - 1)).alias("gain"), (-i).alias("at"))))
    found = F.when(best["gain"] < LEAST_GAIN, F.lit(None).cast("int")).otherwise((1 - best["at"]).cast("int"))
    return F.when(n < 3, F.lit(None).cast("int")).when(F.abs(spread) < 1e-10, F.lit(1)).otherwise(found)


def _fingerprint(text: str) -> int:
    text = text.lower()
    grams = [text[i : i + 4] for i in range(max(len(text) - 3, 1))]
    heads = np.frombuffer(b"".join(hashlib.md5(g.encode("utf-8", "surrogatepass")).digest()[:8] for g in grams), dtype=np.uint8).reshape(-1, 8)
    ones = np.unpackbits(heads, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(grams)).tobytes(), "big")


def _leaders(items: list[str]) -> int:
    leaders: list[int] = []
    met: dict[str, None] = {}
    for item in items:
        if item not in met:
            met[item] = None
            x = _fingerprint(item)
            if all((x ^ c).bit_count() > RADIUS for c in leaders):
                leaders.append(x)
    return len(leaders)


def _knee(items: list[str]) -> int | None:
    seen: set[tuple[str, str]] = set()
    curve = []
    for item in items:
        words = item.lower().split()
        seen.update(zip(words, words[1:]) if len(words) > 1 else [(words[0] if words else "", "")])
        curve.append(len(seen))
    if len(curve) < 3:
        return None
    y = np.array(curve, dtype=float)
    if y[-1] - y[0] < 1e-10:
        return 1
    gain = (y - y[0]) / (y[-1] - y[0]) - np.arange(len(y)) / (len(y) - 1)
    return None if gain.max() < LEAST_GAIN else int(gain.argmax()) + 1


def _units(text: str) -> int:
    return len(text) + sum(c > "\uffff" for c in text)


def _compression_checked(items: list[str], k: int, most: int) -> int:
    if k >= len(items) or k >= most:
        return k
    whole, part = "\n".join(items), "\n".join(items[:k])
    if _units(whole) < LEAST_TEXT:
        return k
    rate = lambda t: len(zlib.compress(t.encode("utf-8", "surrogatepass"))) / _units(t) if t else 1.0
    return min(math.floor(k * FACTOR), most) if abs(rate(whole) - rate(part)) > TOLERANCE else k


def optimal_k_of(items: list[str], bias: float = 1.0, least: int = 1, most: int | None = None) -> int:
    n = len(items)
    most = n if most is None else most
    if n <= 8:
        return n
    unique = _leaders(items)
    if unique <= 3:
        return min(most, max(least, unique))
    found, diversity = _knee(items), unique / n
    share = max(least, math.floor(n * (0.3 + 0.7 * diversity)))
    k = share if found is None else max(found, share) if diversity > 0.7 else found
    k = _compression_checked(items, min(max(least, math.floor(k * bias)), most), most)
    return max(least, min(k, most))


def optimal_k(items: Column, bias: float = 1.0, least: int = 1, most: int | None = None) -> Column:
    """How many of an array's items to keep; null for a null array."""

    @F.pandas_udf("int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if x is None else optimal_k_of(list(x), bias, least, most) for x in batch], dtype="Int32")

    return run(items)
