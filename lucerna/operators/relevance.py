"""Relevance of an item to a context: BM25, hybrid scores and vector similarity, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from lucerna.functions.text import BOUNDARY

#: BM25 constants, the score that counts as 1, the bonus of long terms, token patterns.
K1, MOST, LONG_TERM, LONG_BONUS = 1.5, 10.0, 8, 0.3
UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
TOKEN = rf"{UUID}|{BOUNDARY}\d{{4,}}{BOUNDARY}|[a-zA-Z0-9_]+"
HOST = rf"{BOUNDARY}[a-zA-Z0-9][-a-zA-Z0-9]*\.[a-zA-Z0-9][-a-zA-Z0-9]*(?:\.[a-zA-Z]{{2,}})?{BOUNDARY}"
EMAIL = rf"{BOUNDARY}[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{{2,}}{BOUNDARY}"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def term_frequency(terms: Column) -> Column:
    """A map from term to count."""
    return F.map_from_entries(F.transform(F.array_distinct(terms), lambda t: F.struct(t, F.size(F.filter(terms, lambda x: x == t)))))


def bm25(item: Column, context: Column) -> Column:
    """BM25 of one item against a context in [0, 1]; the length norm cancels as each item is its own corpus."""
    a, b = tokens(item), tokens(context)
    count = lambda terms, t: F.size(F.filter(terms, lambda x: x == t))
    both = F.array_sort(F.array_intersect(b, a))
    score = F.aggregate(both, F.lit(0.0), lambda acc, t: acc + math.log(2.0) * (count(a, t) * (K1 + 1) / (count(a, t) + K1)) * count(b, t))
    base = F.least(F.lit(1.0), score / MOST)
    bonus = F.when(F.exists(both, lambda t: F.length(t) >= LONG_TERM), F.least(F.lit(1.0), base + LONG_BONUS)).otherwise(base)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(bonus)


def alpha(context: Column, base: float = 0.5) -> Column:
    """Weight of BM25: higher the more exact patterns the context has. Counts of ids never exceed one, as in the original."""
    low = F.lower(context)
    least = F.when(context.rlike(UUID), 0.85).when(low.rlike(rf"{BOUNDARY}\d{{4,}}{BOUNDARY}"), 0.65).when(low.rlike(HOST) | low.rlike(EMAIL), 0.6).otherwise(base)
    return F.greatest(F.lit(0.3), F.least(F.lit(0.9), F.greatest(F.lit(base), least)))


def matched_terms(item: Column, context: Column) -> Column:
    """Terms of the context, repeats counted, that the item has too."""
    return F.size(F.filter(tokens(context), lambda t: F.array_contains(tokens(item), t)))


def hybrid(item: Column, context: Column, similarity: Column | None = None, base: float = 0.5) -> Column:
    """BM25 and vector similarity by alpha; without similarity BM25 with a floor for one and a boost for two matches."""
    score = bm25(item, context)
    if similarity is not None:
        a = alpha(context, base)
        return a * score + (1 - a) * similarity
    matched = matched_terms(item, context)
    floored = F.when(matched >= 1, F.greatest(score, F.lit(0.3))).otherwise(score)
    return F.when(matched >= 2, F.least(F.lit(1.0), floored + 0.2)).otherwise(floored)


def cosine(a: Column, b: Column) -> Column:
    """Dot product of unit vectors, within [0, 1]; 0.5 where either is missing."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    return F.when(a.isNull() | b.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot)))
