"""Substring dedup: seeds by winnowed anchors, extended both ways word by word.

Seeds: every window of ``WINDOW`` words takes the least hash of its ``GRAM``-word grams as its anchor (winnowing), so a
passage of WINDOW words in two documents has the same anchor in both. Anchors are joined across documents; those of
one document alone go. Extension: each place of a shared anchor goes to the anchor's shard with the words around it, as
far as its windows reach. There the places of an anchor are told apart by their words, first those of the gram, then
one word more to the right and to the left at a time; two places match in a window if they are still together after
both its left and its right words. Comparisons are of words: a hash only decides what meets. Windows that an earlier
document has as well are kept as runs; a document's runs that overlap make its maximal repeats of at least WINDOW words,
and these are cut.

Both joins are exchanges of packed arrays, a few rows a task and shard. A task settles what it can by itself and asks
the shard of a key only once for each key that it has, so a passage that a third of the documents share costs a shard
one row a task. At the ends of such a passage the words around an anchor differ from document to document; the places of
an anchor that more than ``hot_after`` documents have are therefore dealt out by single windows. The text moves once, by
document, and both later passes read that exchange.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucerna.llm.common import load, release, stage, unstage
from lucerna.llm.minhash import gram_hashes, mixed, word_hashes

WINDOW, GRAM = 13, 5
#: Text for each shard of anchors and of their places; keys, and bytes of words, that a task holds before it sends them.
SHARD_BYTES, PLACE_BYTES, HELD, HELD_BYTES = 32 << 20, 8 << 20, 2_000_000, 16 << 20
#: Anchors of more documents than this, and than a 100,000th of all, are hot. So hot anchors are fewer than 100,000 times
#: the anchors of a mean document, which bounds what the driver sends of them.
HOT_DOCUMENTS, HOT_SHARE = 2_000, 100_000
_EVEN = np.uint64(0xFFFFFFFFFFFFFFFE)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def anchor_keys(anchors: np.ndarray) -> np.ndarray:
    """Even keys of anchors. Anchors are minima, most of them small; their keys spread over all shards."""
    return mixed(anchors) & _EVEN


def window_anchors(hashes: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """The anchor of each window: the least gram hash in it; none if there are fewer words than a window."""
    if len(hashes) < window:
        return np.zeros(0, dtype=np.uint64)
    low, span = gram_hashes(hashes, gram), 1
    most = window - gram + 1
    while span < most:
        step = min(span, most - span)
        low = np.minimum(low[:-step], low[step:])
        span += step
    return low


def removed_words(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A flag a word: whether a range covers it. Overlapping ranges make a maximal repeat."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, np.minimum(starts, n), 1)
    np.add.at(edge, np.minimum(ends, n), -1)
    return np.cumsum(edge[:n]) > 0


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and length of each run of equal sorted keys."""
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, dtype=np.int64)
    return first, np.diff(np.r_[first, len(keys)])


class _Mail:
    """Rows (kind, shard, keys, ids, places, words) of packed arrays: questions to the shard of their key (kind 0) and
    settled rows (kind 1), which need no answer and go along with any shard, another one for each task."""

    def __init__(self, bits: int):
        self.bits, self.rows = bits, []

    def ask(self, keys: np.ndarray, ids: np.ndarray, places: np.ndarray, words: list[bytes] | None = None) -> None:
        """Keys must be sorted; words are the words around each place."""
        cuts = np.searchsorted(keys, np.arange(1, 1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits))
        edges = [0, *cuts.tolist(), len(keys)]
        for shard, (a, b) in enumerate(zip(edges, edges[1:])):
            if b > a:
                self._add(0, shard, keys[a:b], ids[a:b], places[a:b], None if words is None else b" ".join(words[a:b]))

    def settle(self, keys: np.ndarray, ids: np.ndarray, places: np.ndarray) -> None:
        if len(ids):
            self._add(1, TaskContext.get().partitionId() % (1 << self.bits), keys, ids, places, None)

    def _add(self, kind: int, shard: int, keys: np.ndarray, ids: np.ndarray, places: np.ndarray, words: bytes | None) -> None:
        if words is not None:
            words = len(words).to_bytes(8, "little") + pa.compress(words, codec="zstd", asbytes=True)
        self.rows.append((kind, shard, keys.tobytes(), ids.astype(np.int64).tobytes(), places.astype(np.int64).tobytes(), words))

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 4)
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["kind", "shard", "keys", "ids", "places", "words"])


MAIL = "kind int, shard int, keys binary, ids binary, places binary, words binary"


def _opened(table: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Keys, ids, places and the list of all words of a shard's rows of one kind."""
    rows = [r for r in zip(table.column("kind").to_pylist(), *(table.column(c) for c in ("keys", "ids", "places", "words"))) if r[0] == kind]
    join = lambda i, t: np.concatenate([np.zeros(0, dtype=t), *(np.frombuffer(r[i].as_py(), dtype=t) for r in rows)])
    words: list[bytes] = []
    for packed in (r[4].as_py() for r in rows):
        if packed:
            words += pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True).split(b" ")
    return join(1, np.uint64), join(2, np.int64), join(3, np.int64), words


def _by_shard(mail: DataFrame, bits: int) -> DataFrame:
    """Rows of a shard together, as many tasks as shards: what a task holds doesn't grow with the input."""
    return mail.repartition(1 << bits, "shard").groupBy("shard")


def _answers(ids: np.ndarray, values: np.ndarray, bits: int) -> pa.Table:
    """(bucket, ids, values): packed answers for each bucket of documents."""
    bucket = mixed(ids.view(np.uint64)) >> np.uint64(64 - bits)
    order = np.argsort(bucket, kind="stable")
    bucket, ids, values = bucket[order], ids[order], values[order]
    first, length = _groups(bucket)
    cut = lambda x: pa.array([x[a : a + n].tobytes() for a, n in zip(first.tolist(), length.tolist())], pa.binary())
    return pa.table({"bucket": pa.array(bucket[first].astype(np.int32), pa.int32()), "ids": cut(ids), "values": cut(values)})


def _by_document(answers: DataFrame, bits: int) -> DataFrame:
    """(id, found): a row a document with all of its values, 64 bits each, packed, from rows (bucket, ids, values)."""

    def unpack(table: pa.Table) -> pa.Table:
        ids = np.concatenate([np.frombuffer(x.as_py(), dtype=np.int64) for x in table.column("ids")])
        values = np.concatenate([np.frombuffer(x.as_py(), dtype=np.int64) for x in table.column("values")])
        order = np.argsort(ids, kind="stable")
        ids, values = ids[order], values[order]
        first, length = _groups(ids)
        return pa.table({"id": pa.array(ids[first]), "found": pa.array([values[a : a + n].tobytes() for a, n in zip(first.tolist(), length.tolist())], pa.binary())})

    return answers.repartition(1 << bits, "bucket").groupBy("bucket").applyInArrow(unpack, "id long, found binary")


ANSWERS = "bucket int, ids binary, values binary"


def shared_anchors(rows: DataFrame, window: int, gram: int, bits: int, hot_after: int) -> DataFrame:
    """Answers of the anchors that a document of rows (id, text) shares with another; bucket -1 has the hot ones. All are anchor_keys."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mail, anchors, ids, held = _Mail(bits), [], [], 0

        def send() -> pa.RecordBatch:
            nonlocal anchors, ids, held
            keys, docs = np.concatenate([np.zeros(0, dtype=np.uint64), *anchors]), np.concatenate([np.zeros(0, dtype=np.int64), *ids])
            order = np.lexsort((docs, keys))
            keys, docs = keys[order], docs[order]
            first, length = _groups(keys)
            # an anchor of two documents here is shared: its rows are settled, the shard hears of it in one row
            several = docs[first] != docs[first + length - 1]
            mail.ask(keys[first], docs[first], np.where(several, length, 1))
            at = np.repeat(several, length)
            mail.settle(keys[at], docs[at], np.zeros(0))
            anchors, ids, held = [], [], 0
            return mail.batch()

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.unique(anchor_keys(window_anchors(word_hashes(words_of(text.as_py())), window, gram)))
                anchors.append(own)
                ids.append(np.full(len(own), doc, dtype=np.int64))
                held += len(own)
                if held > HELD:
                    yield send()
        if held:
            yield send()

    def answer(table: pa.Table) -> pa.Table:
        keys, ids, counts, _ = _opened(table, 0)
        order = np.lexsort((ids, keys))
        keys, ids, counts = keys[order], ids[order], counts[order]
        first, length = _groups(keys)
        last = first + length - 1
        total = np.add.reduceat(counts, first) if len(first) else counts
        both = (ids[first] != ids[last]) | (np.add.reduceat(counts > 1, first) > 0 if len(first) else np.zeros(0, dtype=bool))
        at = np.repeat(both, length) & (counts == 1)
        known = _opened(table, 1)
        out = _answers(np.concatenate([ids[at], known[1]]), np.concatenate([keys[at], known[0]]), bits)
        hot = keys[first][total > hot_after]
        return pa.concat_tables([out, pa.table({"bucket": pa.array([-1], pa.int32()), "ids": pa.array([b""], pa.binary()), "values": pa.array([hot.tobytes()], pa.binary())})])

    return _by_shard(rows.mapInArrow(scan, MAIL), bits).applyInArrow(answer, ANSWERS)


def places_of(hashes: np.ndarray, wanted: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor key, place, first window, last window) of the leftmost wanted anchors of a text's windows, in order."""
    anchors, grams = window_anchors(hashes, window, gram), gram_hashes(hashes, gram)
    keys = anchor_keys(anchors)
    at = np.flatnonzero(np.isin(keys, wanted))
    if not len(at):
        return keys[:0], at, at, at
    place = at + (grams[at[:, None] + np.arange(window - gram + 1)] == anchors[at][:, None]).argmax(axis=1)
    first, length = _groups(place)
    return keys[at[first]], place[first], at[first], at[first + length - 1]


def extended(ids: np.ndarray, keys: np.ndarray, offset: np.ndarray, more: np.ndarray, words: list[bytes], window: int, gram: int) -> np.ndarray:
    """For each place of a shard, by the window that starts j words behind its first one, whether a smaller id has it.

    words are those around all places, one behind the other: window + more of each, whose anchor starts at offset.
    Places of a key are told apart word by word, to the right and to the left of their gram.
    """
    n, left = len(ids), window - gram
    late = np.zeros((n, left + 1), dtype=bool)
    if not n:
        return late
    numbers: dict[bytes, int] = {}
    flat = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=len(words))
    length = window + more
    column = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length) + np.repeat(left - offset, length)
    grid = np.full((n, left + window), -1, dtype=np.int32)
    grid[np.repeat(np.arange(n), length), column] = flat

    def apart(together: np.ndarray, at: int) -> np.ndarray:
        return np.unique(together * (len(numbers) + 1) + grid[:, at] + 1, return_inverse=True)[1]

    seed = np.unique(keys, return_inverse=True)[1]
    for c in range(left, left + gram):
        seed = apart(seed, c)
    right, before = [seed], seed
    for c in range(left + gram, left + window):
        right.append(apart(right[-1], c))
    for k in range(left + 1):  # windows that start k words before the anchor
        if k:
            before = apart(before, left - k)
        own = np.flatnonzero((k <= offset) & (k >= offset - more))
        same = np.unique(before[own] * n + right[left - k][own], return_inverse=True)[1]
        least = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(least, same, ids[own])
        late[own, offset[own] - k] = ids[own] > least[same]
    return late


def repeated_runs(seeded: DataFrame, hot: np.ndarray, window: int, gram: int, bits: int) -> DataFrame:
    """Answers, for documents of rows (id, text, anchors): runs (first window << 8 | number) of windows that an earlier document has too."""
    sent = seeded.sparkSession.sparkContext.broadcast(np.sort(hot))  # bounded by HOT_SHARE

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mail, size, hot = _Mail(bits), 0, sent.value
        # key, place of the anchor and words: the smallest document and where it has them
        held: dict[tuple[int, int, bytes], tuple[int, list[int]]] = {}
        settled: list[tuple[int, int]] = []

        def put(key: int, offset: int, around: bytes, doc: int, first: int, more: int) -> int:
            found = held.get((key, offset, around))
            if found is None or doc < found[0]:
                settled.extend((found[0], x << 8 | more + 1) for x in (found[1] if found else ()))
                held[key, offset, around] = (doc, [first])
                return 0 if found else len(around) + 16
            if doc == found[0]:
                found[1].append(first)
            else:
                settled.append((doc, first << 8 | more + 1))
            return 16

        def send() -> pa.RecordBatch:
            nonlocal size
            rows = sorted((key, doc, first << 16 | offset << 8 | around.count(b" ") + 1 - window, around) for (key, offset, around), (doc, firsts) in held.items() for first in firsts)
            mail.ask(np.array([r[0] for r in rows], dtype=np.uint64), np.array([r[1] for r in rows], dtype=np.int64), np.array([r[2] for r in rows], dtype=np.int64), [r[3] for r in rows])
            known = np.array(settled, dtype=np.int64).reshape(-1, 2)
            mail.settle(np.zeros(0, dtype=np.uint64), known[:, 0], known[:, 1])
            held.clear()
            settled.clear()
            size = 0
            return mail.batch()

        for batch in batches:
            for doc, text, shared in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                words = words_of(text.as_py())
                hashes = word_hashes(words)
                anchors, places, firsts, lasts = places_of(hashes, np.frombuffer(shared.as_py(), dtype=np.uint64), window, gram)
                if not len(anchors):
                    continue
                whole, end = b" ".join(words), np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
                begin = np.r_[0, end[:-1]].tolist()
                end, dealt = (end - 1).tolist(), np.isin(anchors, hot)
                exact = gram_hashes(hashes, window) if dealt.any() else None
                for key, place, first, last, single in zip(anchors.tolist(), places.tolist(), firsts.tolist(), lasts.tolist(), dealt.tolist()):
                    if not single:
                        size += put(key, place - first, whole[begin[first] : end[last + window - 1]], doc, first, last - first)
                        continue
                    for i in range(first, last + 1):
                        size += put(int(mixed(exact[i] ^ np.uint64(key))), place - i, whole[begin[i] : end[i + window - 1]], doc, i, 0)
                if size > HELD_BYTES:
                    yield send()
        if held:
            yield send()

    def answer(table: pa.Table) -> pa.Table:
        keys, ids, places, words = _opened(table, 0)
        first, offset, more = places >> 16, places >> 8 & 255, places & 255
        edge = np.diff(np.pad(extended(ids, keys, offset, more, words, window, gram).astype(np.int8), ((0, 0), (1, 1))), axis=1)
        (row, start), (_, stop) = np.nonzero(edge == 1), np.nonzero(edge == -1)
        known = _opened(table, 1)
        return _answers(np.concatenate([ids[row], known[1]]), np.concatenate([first[row] + start << 8 | stop - start, known[2]]), bits)

    return _by_shard(seeded.mapInArrow(reach, MAIL), bits).applyInArrow(answer, ANSWERS)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, with_text: bool = False, hot_after: int | None = None) -> DataFrame:
    """One row per document row: id, n_words, n_removed, kept_sha256 (and kept_text if asked for).

    A word goes if a window of consecutive words covers it whose word sequence also starts in a document of a smaller
    id. Null and empty texts have no words. Ids are integers; rows that repeat an id count as one document and lose
    the words that any of them loses at these places; rows without an id neither give nor lose words. Other columns
    are ignored; an empty table gives no rows. Windows have at most 255 words; hot_after changes no result.
    """
    if not gram <= window <= 255:
        raise ValueError("a window has at least the words of a gram and at most 255")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    named = rows.filter("id is not null")
    size, documents = named.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    bits = lambda each: max(2, math.ceil(math.log2(max(1, size / each))))
    if hot_after is None:
        hot_after = max(HOT_DOCUMENTS, documents // HOT_SHARE)
    anchors = stage(shared_anchors(named, window, gram, bits(SHARD_BYTES), hot_after), "op7-anchors")
    hot = np.concatenate([np.zeros(0, dtype=np.uint64), *(np.frombuffer(r[0], dtype=np.uint64) for r in anchors.filter("bucket < 0 and octet_length(values) > 0").select("values").collect())])
    seeds = stage(_by_document(anchors.filter("bucket >= 0"), bits(SHARD_BYTES)), "op7-seeds").withColumnRenamed("found", "anchors")
    unstage(anchors)
    release(df.sparkSession)
    # both joins sort and merge, so they can share one exchange of the texts
    seeded = named.hint("merge").join(seeds.hint("merge"), "id").select("id", "text", "anchors")
    hits = _by_document(repeated_runs(seeded, hot, window, gram, bits(PLACE_BYTES)), bits(PLACE_BYTES)).withColumnRenamed("found", "runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, gone, shas, texts = [], [], [], []
            for text, runs in zip(batch.column(1), batch.column(2)):
                words = words_of(text.as_py())
                n = len(words)
                if runs.is_valid:
                    run = np.frombuffer(runs.as_py(), dtype=np.int64)
                    first = run >> 8
                    flags = removed_words(n, first, first + (run & 255) + (window - 1))
                    words = [w for w, f in zip(words, flags.tolist()) if not f]
                kept = b" ".join(words)
                counts.append(n)
                gone.append(n - len(words))
                shas.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept.decode("utf-8", "surrogatepass") if with_text else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(shas, pa.string()), pa.array(texts, pa.string())], names=["id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    joined = named.hint("merge").join(hits.hint("merge"), "id", "left").select("id", "text", "runs")
    alone = rows.filter("id is null").withColumn("runs", F.lit(None).cast("binary"))
    out = joined.unionByName(alone).mapInArrow(cut, "id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return out.select(F.col("id").cast(df.schema[id_col].dataType).alias(id_col), "n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(load(spark, sf_dir, "documents"))


QUERIES = {"op7_substring_dedup": op7_substring_dedup}
ORACLE_SQL = {
    "op7_substring_dedup": r"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(w[i : i + 12], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT s, min(doc_id) AS low FROM x GROUP BY s),
h AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM x JOIN f USING (s) WHERE doc_id > low),
k AS (SELECT doc_id, count(*) AS n, list(k) AS gone FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)), lambda i: w[i]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
}
