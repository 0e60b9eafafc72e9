"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of ``width`` consecutive words of the benchmark items (a shorter item is one pattern).
Patterns of one length share a block shift table over pairs of words: a block that ends no pattern moves the
search on by its safe distance, a word that no pattern has moves it by the whole length; where the shift is 0, the
bucket of the block, narrowed by the first two words, gives the few patterns to compare directly. Words are numbered,
patterns and tables are sorted arrays, and a worker builds them once for all of its tasks.
"""

from __future__ import annotations

import uuid
from array import array
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lucerna.llm.common import load, stage

WIDTH = 10
#: Benchmark bytes in the tables that a worker holds at once; more items go to further passes over the rows.
SHARD_BYTES = 4 << 20
#: Passes in one plan; each has Python workers and tables of its own.
PASSES = 4
#: Every ASCII character but digits and letters parts words; A-Z become a-z; other bytes belong to words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


class _Table:
    """Patterns of one length as sorted arrays: distinct rows of word numbers, by their last and first two words.

    pairs and shifts are the block shift table, suffix and prefix the keys of a row's last and first block, owners the
    items of row r from first[r] to first[r + 1].
    """

    def __init__(self, m: int, items: list[tuple[int, np.ndarray]]):
        self.m = m
        rows = np.concatenate([np.lib.stride_tricks.sliding_window_view(x, m) for _, x in items])
        owner = np.repeat(np.array([i for i, _ in items], dtype=np.int32), [len(x) - m + 1 for _, x in items])
        by = [m - 2, m - 1, *range(m - 2)] if m > 1 else [0]
        order = np.lexsort([owner, *(rows[:, c] for c in reversed(by))])
        rows, owner = rows[order], owner[order]
        fresh = np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)]
        rows = rows[fresh]
        self.rows, self.owners = array("i", rows.tobytes()), array("i", owner.tobytes())
        self.first = array("q", np.r_[np.flatnonzero(fresh), len(owner)].tobytes())
        if m == 1:
            self.pairs = self.shifts = self.suffix = self.prefix = None
            return
        self.suffix, self.prefix = (array("q", _block(rows[:, c], rows[:, c + 1]).tobytes()) for c in (m - 2, 0))
        pairs = np.concatenate([_block(x[:-1], x[1:]) for _, x in items])
        # a pair that ends at word e of an item is at least so far from the end of a pattern
        shifts = np.concatenate([np.maximum(m - 1 - np.arange(1, len(x)), 0) for _, x in items])
        order = np.lexsort((shifts, pairs))
        pairs, shifts = pairs[order], shifts[order]
        fresh = np.r_[True, pairs[1:] != pairs[:-1]]
        self.pairs, self.shifts = array("q", pairs[fresh].tobytes()), shifts[fresh].astype(np.uint8).tobytes() if m < 256 else shifts[fresh].tolist()

    def search(self, ids: list[int], hits: list[tuple[int, int]], rows: set[int]) -> None:
        """Adds the ranges of the occurrences in a text's word numbers (-1: not of the benchmark) and their rows."""
        m, n = self.m, len(ids)
        i = m - 1
        while i < n:
            last = ids[i]
            if last < 0:
                i += m
                continue
            if m == 1:
                r = bisect_left(self.rows, last)
                if r < len(self.rows) and self.rows[r] == last:
                    hits.append((i, i + 1))
                    rows.add(r)
                i += 1
                continue
            if ids[i - 1] < 0:
                i += m - 1
                continue
            block = ids[i - 1] << 32 | last
            at = bisect_left(self.pairs, block)
            step = self.shifts[at] if at < len(self.pairs) and self.pairs[at] == block else m - 1
            if step:
                i += step
                continue
            start = i - m + 1
            low = bisect_left(self.suffix, block)
            high = bisect_right(self.suffix, block, low)
            if high > low and ids[start] >= 0 and ids[start + 1] >= 0:
                head = ids[start] << 32 | ids[start + 1]
                low = bisect_left(self.prefix, head, low, high)
                window = array("i", ids[start : i + 1])
                for r in range(low, bisect_right(self.prefix, head, low, high)):
                    if self.rows[r * m : (r + 1) * m] == window:
                        hits.append((start, i + 1))
                        rows.add(r)
            i += 1


def _block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.astype(np.int64) << 32 | b.astype(np.int64)


class WuManber:
    """Shift tables and suffix buckets for word patterns, by pattern length. About 15 bytes a byte of patterns."""

    def __init__(self, items: list[tuple[int, str | None]], width: int = WIDTH):
        self.number: dict[bytes, int] = {}
        self.items = [item_id for item_id, _ in items]
        by_length: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
        for i, (_, text) in enumerate(items):
            ids = np.array([self.number.setdefault(w, len(self.number)) for w in words_of(text)], dtype=np.int32)
            if len(ids):
                by_length[min(width, len(ids))].append((i, ids))
        self.tables = [_Table(m, by_length.pop(m)) for m in sorted(by_length)]

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Word ranges [start, end) of all occurrences, and the ids of the items that occur."""
        hits: list[tuple[int, int]] = []
        found: set = set()
        number = self.number.get
        ids = [number(w, -1) for w in words]
        for table in self.tables:
            rows: set[int] = set()
            table.search(ids, hits, rows)
            for r in rows:
                found.update(self.items[i] for i in table.owners[table.first[r] : table.first[r + 1]])
        return hits, found


#: Tables that this worker has built, by the key of their shard; they outlive a task, and the last few stay.
_BUILT: dict[str, WuManber] = {}


def tables_of(key: str, items: list[tuple[int, str | None]], width: int) -> WuManber:
    if key not in _BUILT:
        while len(_BUILT) >= 2:
            del _BUILT[next(iter(_BUILT))]
        _BUILT[key] = WuManber(items, width)
    return _BUILT[key]


def covered(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of ranges, as sorted ranges that don't touch."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(hits):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def shards_of(benchmark: DataFrame, item_col: str, text_col: str, limit: int) -> Iterator[list[tuple[int, str | None]]]:
    """The items in shards of bounded size, an empty one at least. The driver holds one at a time."""
    shard: list[tuple[int, str | None]] = []
    filled, any_yet = 0, False
    for r in benchmark.select(F.col(item_col).alias("i"), F.col(text_col).alias("t")).filter("t is not null").toLocalIterator():
        if filled and filled + len(r.t) > limit:
            yield shard
            shard, filled, any_yet = [], 0, True
        shard.append((r.i, r.t))
        filled += len(r.t)
    if shard or not any_yet:
        yield shard


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, shard_bytes: int = SHARD_BYTES, carry: bool = False) -> DataFrame:
    """One row per document row: id, n_words, n_hit, n_items, items_sha256, contaminated, ranges (hit word ranges), items, and the whole row as the struct row if carry.

    Null and empty texts have no words and are clean; a null benchmark text is skipped; an item without id counts as
    the id 'None'. Repeated rows each get their own result, an empty benchmark hits nothing. Rows never move: each
    shard of patterns is one narrow pass, which hands ranges and items so far to the next. A benchmark may have any
    size: after PASSES shards the rows are written and read back, as each pass has workers of its own.
    """
    spark = docs.sparkSession
    columns = docs.columns if carry else [id_col, text_col]
    whole = F.struct(*[F.col(f"`{c}`") for c in columns])
    at = columns.index(text_col)  # the text goes to the workers once, within the row
    out = docs.select(whole.alias("row"), F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() as array<array<int>>)").alias("ranges"), F.expr("cast(array() as array<string>)").alias("items"))
    full = out.schema
    bare = T.StructType([T.StructField("row", T.StructType([docs.schema[id_col]])), *full.fields[1:]])
    shards = shards_of(benchmark, item_col, item_text_col, shard_bytes)
    shard, k = next(shards), 0
    while shard is not None:
        sent, key, following = spark.sparkContext.broadcast(shard), uuid.uuid4().hex, next(shards, None)  # shard_bytes, or one item
        last = following is None and not carry

        def search(batches: Iterator[pa.RecordBatch], sent=sent, key=key, last=last) -> Iterator[pa.RecordBatch]:
            tables = tables_of(key, sent.value, width)
            for batch in batches:
                row, before, known = batch.column(0), batch.column(2).to_pylist(), batch.column(3).to_pylist()
                texts = row.field(at)
                counts, ranges, items = [], [], []
                for k in range(len(texts)):
                    words = words_of(texts[k].as_py())
                    hits, found = tables.search(words)
                    counts.append(len(words))
                    ranges.append([list(r) for r in covered(hits + [tuple(r) for r in before[k]])])
                    items.append(sorted({*known[k], *map(str, found)}))
                if last:
                    row = pa.StructArray.from_arrays([row.field(0)], names=[id_col])
                yield pa.RecordBatch.from_arrays([row, pa.array(counts, pa.int64()), pa.array(ranges, pa.list_(pa.list_(pa.int32()))), pa.array(items, pa.list_(pa.string()))], names=full.names)

        out = out.mapInArrow(search, bare if last else full)
        shard, k = following, k + 1
        if shard is not None and k % PASSES == 0:
            out = stage(out, f"op9-pass-{k}")
    hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda a, r: a + (r[1] - r[0]))
    return out.select(F.col(f"row.`{id_col}`").alias(id_col), *["row"] * carry, "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("ranges") > 0).alias("contaminated"), "ranges", "items")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs' rows without any benchmark window; options as for find_contamination."""
    return find_contamination(docs, benchmark, carry=True, **options).filter("not contaminated").select("row.*")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")).drop("ranges", "items")


QUERIES = {"op9_decontamination": op9_decontamination}
ORACLE_SQL = {
    "op9_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, m, array_to_string(w[i : i + m - 1], ' ') AS s
       FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM p) WHERE len(w) >= m)),
h AS (SELECT doc_id, i, dw.m, item_id FROM dw JOIN p ON dw.s = p.s AND dw.m = p.m),
c AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS x FROM (SELECT DISTINCT doc_id, i, m FROM h)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
}
