"""Counterfactual-regularised toxicity classifier.

A logistic model over the presence of words and word beginnings. In each labelled sentence that names a group the
identity terms are swapped for other terms of their group and for nothing, and the squared change of the score is
penalised, so that a neutral mention of a group doesn't raise it. A labelled document without such a sentence gives counterfactuals too: a
seeded group's first term is put into a seeded sentence of it and swapped. Features are counted in Spark over a bounded,
seeded sample of the labelled rows, changes are summed up there by the features that a swap gains and loses; the driver
solves a model of at most MAX_FEATURES weights, and one narrow pass scores every whole text.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lucerna.llm.common import load, stage
from lucerna.llm.decontaminate import FOLD

#: The sample of labelled rows that the classifier is fitted on, in order of a seeded hash of the id.
MAX_LABELLED = 16_000
MAX_FEATURES = 3_000
MIN_DOCUMENTS = 3
MIN_GAIN = 10.0
L2 = 1.0
SWAP_PENALTY = 4.0
THRESHOLD = 0.3
BEGINNINGS = (4, 5, 6)
#: Terms that stand for one another in counterfactual sentences, by group; fixed values.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "transgender", "nonbinary"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "indigenous", "arab"),
    ("gay", "lesbian", "straight", "bisexual", "queer"),
    ("immigrants", "refugees", "citizens", "foreigners"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("femmes", "hommes", "filles", "garçons"),
    ("frauen", "männer", "mädchen", "jungen"),
)
Groups = tuple[tuple[str, ...], ...]
_SENTENCE = re.compile(r"[.!?。！？\n]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


def features_of(word: bytes) -> tuple[bytes, ...]:
    """The word, and its beginnings with a star."""
    return (word, *(word[:k] + b"*" for k in BEGINNINGS if len(word) >= k))


def group_index(groups: Groups) -> dict[bytes, tuple[bytes, ...]]:
    """The group of each term, as words_of writes them."""
    return {t.encode(): tuple(x.encode() for x in group) for group in groups for t in group}


def swapped(words: list[bytes], terms: dict[bytes, tuple[bytes, ...]]) -> list[list[bytes]]:
    """The words with every identity term moved on by 1, 2, ... places in its group, and without them; none if there is no such term.

    Leaving the terms out keeps the terms of a group from gaining weight together.
    """
    found = [w for w in words if w in terms]
    if not found:
        return []
    most = max(len(terms[w]) for w in found)
    return [[w for w in words if w not in terms]] + [[(g := terms[w])[(g.index(w) + k) % len(g)] if w in terms else w for w in words] for k in range(1, most)]


def counterfactuals(text: str | None, groups: Groups, terms: dict[bytes, tuple[bytes, ...]]) -> Iterator[tuple[list[bytes], list[bytes]]]:
    """(sentence, sentence with swapped terms) of a text, as words; of a text without terms, one sentence gets a term first."""
    sentences = [words_of(x) for x in _SENTENCE.split(text or "")]
    named = [x for x in sentences if any(w in terms for w in x)]
    if not named and groups:
        seed = zlib.crc32((text or "").encode("utf-8", "surrogatepass"))
        named = [[*sentences[seed // len(groups) % len(sentences)], groups[seed % len(groups)][0].encode()]]
    for sentence in named:
        for other in swapped(sentence, terms):
            yield sentence, other


class Scorer:
    """Scores word lists by feature weights; remembers the features of words it has met, within a bound."""

    def __init__(self, weights: dict[bytes, float], bias: float, swaps: int = 0):
        self.swaps = swaps  # counterfactual sentences that it was fitted with
        self.index = {f: i for i, f in enumerate(weights)}
        self.weights, self.bias, self.memo = list(weights.values()), bias, {}

    def present(self, words: list[bytes]) -> set[int]:
        out: set[int] = set()
        memo, index = self.memo, self.index
        if len(memo) > 500_000:
            memo.clear()
        for w in set(words):
            got = memo.get(w)
            if got is None:
                got = memo[w] = tuple(index[f] for f in features_of(w) if f in index)
            if got:
                out.update(got)
        return out

    def score(self, words: list[bytes]) -> float:
        z = self.bias + sum(self.weights[i] for i in sorted(self.present(words)))
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def held_out(doc_id: Column, mod: int = 4, rest: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == rest, F.lit(False))


def fit_weights(rows: list[tuple[int, list[int]]], changes: list[tuple[list[int], list[int], int]], n: int, steps: int = 400, penalty: float = SWAP_PENALTY) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the log loss of rows (label, features), L2 / 2 times the squared weights, and penalty
    times the squared score change of each of changes (features gained, features lost, number of such swaps).

    Accelerated gradient descent; the problem is convex.
    """
    y = np.array([r[0] for r in rows], dtype=float)
    lengths = np.array([len(r[1]) for r in rows])
    at, cols = np.repeat(np.arange(len(rows)), lengths), np.array([i for r in rows for i in r[1]], dtype=np.int64)
    changes = [c for c in changes if c[0] or c[1]]
    k = len(changes) if penalty else 0
    swap_at = np.array([i for i, (gained, lost, _) in enumerate(changes) for _ in (*gained, *lost)], dtype=np.int64)
    swap_cols = np.array([c for gained, lost, _ in changes for c in (*gained, *lost)], dtype=np.int64)
    signs = np.array([s for gained, lost, _ in changes for s in (*[1.0] * len(gained), *[-1.0] * len(lost))])
    times = penalty * np.array([float(c[2]) for c in changes])
    prior = (y.sum() + 1) / (len(y) + 10)
    w, bias = np.zeros(n), math.log(prior / (1 - prior))
    # a diagonal bound on the curvature sets the steps
    busy = lengths.astype(float)
    curve = 0.25 * np.bincount(cols, weights=busy[at] + 1, minlength=n) / 1.0 + L2
    if k:
        swaps = np.bincount(swap_at, minlength=k).astype(float)
        curve += 2 * np.bincount(swap_cols, weights=(swaps * times)[swap_at], minlength=n)
    bias_curve = 0.25 * float((busy + 1).sum()) + 1e-9
    v, vb, t = w.copy(), bias, 1.0
    for _ in range(steps):
        z = vb + np.bincount(at, weights=v[cols], minlength=len(y))
        miss = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y
        g = np.bincount(cols, weights=miss[at], minlength=n) + L2 * v
        if k:
            change = np.bincount(swap_at, weights=signs * v[swap_cols], minlength=k)
            g += 2 * np.bincount(swap_cols, weights=signs * (change * times)[swap_at], minlength=n)
        fresh, fresh_bias, u = v - g / curve, vb - miss.sum() / bias_curve, (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, vb = fresh + (t - 1) / u * (fresh - w), fresh_bias + (t - 1) / u * (fresh_bias - bias)
        w, bias, t = fresh, fresh_bias, u
    return w, float(bias)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = MAX_LABELLED, max_features: int = MAX_FEATURES, groups: Groups = IDENTITY_TERMS, penalty: float = SWAP_PENALTY) -> Scorer:
    """Fits on the labelled documents outside the held-out fold, at most max_labelled of them.

    A document labelled twice is toxic if one label says so; null ids and labels are skipped. Without labelled rows
    of both classes the scorer has a bias alone, (positives + 1) / (rows + 10). Features are the max_features that tell the
    classes apart best, from MIN_DOCUMENTS documents and a gain (G statistic) of MIN_GAIN on, and the identity terms of
    groups with their beginnings.
    """
    terms = group_index(groups)
    ids = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).filter("id is not null and y is not null").filter(~held_out(F.col("id")))
    ids = ids.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(max_labelled)
    chosen = stage(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(stage(ids, "op2-ids")), "id").select("text", "y"), "op2-sample")  # max_labelled ids at most

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, toxic, rows, positives = Counter(), Counter(), 0, 0
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1)):
                found = {f for w in set(words_of(text.as_py())) for f in features_of(w)}
                seen.update(found)
                rows += 1
                if y.as_py() == 1:
                    toxic.update(found)
                    positives += 1
        seen[b""], toxic[b""] = rows, positives  # the empty feature counts documents
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64()), pa.array([toxic[f] for f in seen], pa.int64())], names=["feature", "n", "t"])

    counts = stage(chosen.mapInArrow(count, "feature binary, n long, t long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).filter(f"n >= {MIN_DOCUMENTS} or octet_length(feature) = 0"), "op2-counts")
    whole = counts.filter("octet_length(feature) = 0").first()
    rows, positives = (whole.n, whole.t) if whole else (0, 0)
    prior = (positives + 1) / (rows + 10)
    if not 0 < positives < rows:
        return Scorer({}, math.log(prior / (1 - prior)))
    part = lambda k, e: F.when(F.expr(k) > 0, F.expr(f"({k}) * ln(({k}) / ({e}))")).otherwise(0.0)
    gain = 2 * (part("t", f"n * {positives} / {rows}D") + part("n - t", f"n * {rows - positives} / {rows}D") + part(f"{positives} - t", f"({rows} - n) * {positives} / {rows}D") + part(f"{rows - positives} - (n - t)", f"({rows} - n) * {rows - positives} / {rows}D"))
    best = counts.filter("octet_length(feature) > 0").withColumn("gain", gain).filter(F.col("gain") >= MIN_GAIN).orderBy(F.col("gain").desc(), "feature").limit(max_features)
    names = [bytes(r.feature) for r in best.select("feature").collect()]
    names = list(dict.fromkeys([*names, *terms]))
    index = {f: i for i, f in enumerate(names)}

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = Scorer(dict.fromkeys(index, 0.0), 0.0)
        for batch in batches:
            own = [sorted(local.present(words_of(t.as_py()))) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int64()), pa.array(own, pa.list_(pa.int64()))], names=["y", "own"])

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = Scorer(dict.fromkeys(index, 0.0), 0.0)
        for batch in batches:
            seen: Counter = Counter()
            for text in batch.column(0):
                for sentence, other in counterfactuals(text.as_py(), groups, terms):
                    before, after = local.present(sentence), local.present(other)
                    seen[tuple(sorted(after - before)), tuple(sorted(before - after))] += 1
            columns = [pa.array([list(c[k]) for c in seen], pa.list_(pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(list(seen.values()), pa.int64())], names=["gained", "lost", "n"])

    sample = sorted((int(r.y == 1), list(r.own)) for r in chosen.mapInArrow(project, "y long, own array<long>").collect())  # max_labelled rows of ids
    # distinct pairs of terms, and of beginnings that a sentence has besides
    changes = chosen.mapInArrow(change, "gained array<long>, lost array<long>, n long").groupBy("gained", "lost").agg(F.sum("n").alias("n")).collect()
    changes = sorted((list(r.gained), list(r.lost), r.n) for r in changes)
    w, bias = fit_weights(sample, changes, len(names), penalty=penalty)
    return Scorer({f: float(x) for f, x in zip(names, w) if x}, bias, sum(c[2] for c in changes))


def _scored(docs: DataFrame, scorer: Scorer, columns: list[str], text_col: str) -> DataFrame:
    """(row: a struct of the columns, score)."""
    sent = docs.sparkSession.sparkContext.broadcast((dict(zip(scorer.index, scorer.weights)), scorer.bias))  # at most MAX_FEATURES weights
    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")
    inside = columns.index(text_col) if text_col in columns else None  # the text goes to the workers once
    rows = docs.select(row, *[F.col(text_col).alias("text")] * (inside is None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = Scorer(*sent.value)
        for batch in batches:
            texts = batch.column(1) if inside is None else batch.column(0).field(inside)
            scores = [local.score(words_of(t.as_py())) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["row", "score"])

    return rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())]))


def score_documents(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The id of every document with score and predicted. Null and empty texts get the bias's score."""
    return _scored(docs, scorer, [id_col], text_col).select("row.*", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, scorer: Scorer, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs' rows that score below the threshold."""
    return _scored(docs, scorer, docs.columns, text_col).filter(F.col("score") < threshold).select("row.*")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    scored = score_documents(docs, fit(docs, load(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLE_SQL: dict[str, str] = {}
