"""Interpolated modified Kneser-Ney models of order 2 and 3, counted in Spark and memory-mapped by the workers that score.

Words are 64-bit hashes; the sorted array of training words numbers them, so a bigram is an exact 64-bit key. Counting
tasks send packed sorted arrays, a few rows a task, to shards of the key space; a shard is merged by one task and
written as a sorted hash array with its counts. Hashed keys spread a frequent word's bigrams over all shards. Types by
context and continuation counts go the same way to dense arrays indexed by word number. Scoring maps the files from
the shared folder: nothing that grows with the corpus is collected or broadcast.

The query scores by order 3. Trigrams are nearly all distinct on text of this kind, so everything of that order is sent
sorted and compressed, and its files keep no more than what can't be derived: a pair of raw count 1 has one word before
it, and a context of raw count 1 one trigram.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucerna.llm.common import load, release, stage, unstage, workspace
from lucerna.llm.minhash import mixed, word_hashes

PIECE_BYTES = 1 << 20
BATCH_TOKENS = 1 << 20
#: Training bytes for each shard of words, bigrams and trigrams.
WORD_BYTES, PAIR_BYTES, TRIGRAM_BYTES = 192 << 20, 64 << 20, 16 << 20
DENSE = 1 << 20
OPEN_MAPS = 8192
END = np.uint64(xxhash.xxh3_64_intdigest(b" "))  # no word has white space
_U = np.uint64
PACKED = "shard int, keys binary, counts binary"


def pieces(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text in lists of bounded size."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    at = 0
    while at < len(raw):
        end = at + PIECE_BYTES
        if end < len(raw):
            while end < len(raw) and raw[end] not in b" \t\n\r\x0b\x0c":
                end += 1
        yield raw[at:end].split()
        at = end


def token_runs(texts: Iterator[tuple[int, str | None]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hashes, document numbers, starts): runs of at most about BATCH_TOKENS tokens, END behind each document.

    starts flags a document's first token. A run may end within a document.
    """
    hashes: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    firsts: list[np.ndarray] = []
    held = 0
    for number, text in texts:
        fresh = True
        lists = pieces(text)
        while True:
            words = next(lists, None)
            h = np.array([END], dtype=np.uint64) if words is None else word_hashes(words)
            if len(h):
                first = np.zeros(len(h), dtype=bool)
                first[0], fresh = fresh, False
                hashes.append(h)
                owners.append(np.full(len(h), number, dtype=np.int64))
                firsts.append(first)
                held += len(h)
            if held >= BATCH_TOKENS:
                yield np.concatenate(hashes), np.concatenate(owners), np.concatenate(firsts)
                hashes, owners, firsts, held = [], [], [], 0
            if words is None:
                break
    if held:
        yield np.concatenate(hashes), np.concatenate(owners), np.concatenate(firsts)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, dtype=np.uint64)
    return summed(keys, np.concatenate([p[1] for p in parts]).astype(np.uint64) if parts else np.zeros(0, dtype=np.uint64))


def packed(keys: np.ndarray, counts: np.ndarray, bits: int) -> pa.RecordBatch:
    """Sorted keys and counts cut at the shards of their top bits, a row each."""
    cuts = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << _U(64 - bits)) if bits else np.zeros(0, dtype=np.int64)
    edges = [0, *cuts.tolist(), len(keys)]
    rows = [(s, keys[a:b].tobytes(), counts[a:b].astype(np.uint32).tobytes()) for s, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["shard", "keys", "counts"])


def _put(folder: str, name: str, *arrays: np.ndarray) -> str:
    """Writes arrays one behind the other; the name carries the attempt, so a retried task never meets a half-written file."""
    fs, root = pa.fs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    path = f"{root}/{name}-{TaskContext.get().taskAttemptId()}.bin"
    with fs.open_output_stream(path) as out:
        for a in arrays:
            out.write(a.tobytes())
    return path


def _unpack(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    parts = [(np.frombuffer(k.as_py(), dtype=np.uint64), np.frombuffer(c.as_py(), dtype=np.uint32)) for k, c in zip(table.column("keys"), table.column("counts"))]
    return merged(parts)


class SortedArrays:
    """Sharded sorted keys with counts, mapped from files."""

    def __init__(self, files: list[tuple[int, str, int]], bits: int):
        self.bits, self.shards, offset = bits, {}, 0
        for shard, path, n in sorted(files):
            keys = np.memmap(path, dtype=np.uint64, mode="r", shape=(n,))
            self.shards[shard] = (keys, np.memmap(path, dtype=np.uint64, mode="r", offset=8 * n, shape=(n,)), offset)
            offset += n
        self.size = offset

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, count) of sorted wanted keys; number -1 and count 0 where a key isn't there."""
        numbers, counts = np.full(len(wanted), -1, dtype=np.int64), np.zeros(len(wanted), dtype=np.int64)
        cuts = np.searchsorted(wanted, np.arange(1, 1 << self.bits, dtype=np.uint64) << _U(64 - self.bits)).tolist() if self.bits else []
        edges = [0, *cuts, len(wanted)]
        for shard, (a, b) in enumerate(zip(edges, edges[1:])):
            if b > a and shard in self.shards:
                keys, values, offset = self.shards[shard]
                at = np.searchsorted(keys, wanted[a:b])
                at[at == len(keys)] = 0
                hit = keys[at] == wanted[a:b]
                numbers[a:b][hit] = at[hit] + offset
                counts[a:b][hit] = values[at[hit]]
        return numbers, counts


def pair_keys(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mixed((context.astype(np.uint64) << _U(32)) | word.astype(np.uint64))


def unmixed(x: np.ndarray) -> np.ndarray:
    """The inverse of mixed."""
    x = x ^ (x >> _U(33))
    x = x * _U(pow(0xC4CEB9FE1A85EC53, -1, 1 << 64))
    x = x ^ (x >> _U(33))
    x = x * _U(pow(0xFF51AFD7ED558CCD, -1, 1 << 64))
    return x ^ (x >> _U(33))


def _bits(size: int, each: int) -> int:
    return max(2, math.ceil(math.log2(max(1, size / each))))


class Coder:
    """Token runs as word numbers and contexts, over mapped words; the start of a document is word number size."""

    def __init__(self, files: list[tuple[int, str, int]], bits: int):
        self.words = SortedArrays(files, bits)
        self.last = -1

    def __call__(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(contexts, words, word counts); -1 for a word that training lacks. Runs must come in order."""
        distinct, back = np.unique(hashes, return_inverse=True)
        numbers, counts = self.words.find(distinct)
        word = numbers[back]
        context = np.r_[self.last, word[:-1]]
        context[first] = self.words.size
        self.last = word[-1]
        return context, word, counts[back]


def discounts(n: list[int]) -> tuple[float, float, float]:
    """D1, D2, D3+ from the numbers of types of counts 1 to 4; absolute 0.5, 1, 1.5 where one of them is missing."""
    if min(n) <= 0:
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), float(k)) for k in (1, 2, 3))


class Model:
    """The files of a trained model, and the few numbers that they share. Pickles small."""

    def __init__(self, words, word_bits, pairs, pair_bits, dense, tokens, documents, pair_d, low_d, types, low_share):
        self.words, self.word_bits, self.pairs, self.pair_bits, self.dense = words, word_bits, pairs, pair_bits, dense
        self.tokens, self.documents, self.pair_d, self.low_d, self.types, self.low_share = tokens, documents, pair_d, low_d, types, low_share

    def open(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """Probabilities over mapped arrays."""

    def __init__(self, m: Model):
        self.m, self.code, self.pairs = m, Coder(m.words, m.word_bits), SortedArrays(m.pairs, m.pair_bits)
        self.size = self.code.words.size
        self.dense = {block: np.memmap(path, dtype=np.uint32, mode="r", shape=(4, n)) for block, path, n in m.dense}

    def _dense(self, numbers: np.ndarray) -> np.ndarray:
        """Continuation count, and types of count 1, 2, 3+ by context, of known numbers (sorted or not): shape (4, n)."""
        out = np.zeros((4, len(numbers)), dtype=np.float64)
        block = numbers // DENSE
        for b in np.unique(block[numbers >= 0]):
            if int(b) in self.dense:
                at = np.flatnonzero(block == b)
                out[:, at] = self.dense[int(b)][:, numbers[at] % DENSE]
        return out

    def run(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 probability, training count) of each token of a run."""
        m = self.m
        context, word, counts = self.code(hashes, first)
        distinct, back = np.unique(word, return_inverse=True)
        cont = self._dense(distinct)[0]
        d = np.select([cont == 0, cont == 1, cont == 2], [0.0, m.low_d[0], m.low_d[1]], m.low_d[2])
        low = ((cont - d) / max(m.types, 1) + m.low_share / (self.size + 1))[back]

        heads, head_back = np.unique(context, return_inverse=True)
        types = self._dense(heads)
        _, head_counts = self._counts(heads)
        total = np.where(heads == self.size, m.documents, head_counts).astype(np.float64)
        known = total > 0
        share = np.where(known, (m.pair_d[0] * types[1] + m.pair_d[1] * types[2] + m.pair_d[2] * types[3]) / np.maximum(total, 1), 1.0)

        both = np.flatnonzero((word >= 0) & known[head_back])
        keys, key_back = np.unique(pair_keys(context[both], word[both]), return_inverse=True)
        c = np.zeros(len(word))
        c[both] = self.pairs.find(keys)[1][key_back]
        off = np.select([c == 0, c == 1, c == 2], [0.0, m.pair_d[0], m.pair_d[1]], m.pair_d[2])
        p = (c - off) / np.maximum(total, 1)[head_back] + share[head_back] * low
        return np.log10(p), counts

    def _counts(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Training counts of word numbers, from the mapped words."""
        counts = np.zeros(len(numbers), dtype=np.int64)
        for _, values, offset in self.code.words.shards.values():
            own = np.flatnonzero((numbers >= offset) & (numbers < offset + len(values)))
            counts[own] = values[numbers[own] - offset]
        return numbers, counts


def _train_words(rows: DataFrame, folder: str, word_bits: int) -> list:
    """Counts the words of rows (text) into files: rows (shard, path, n, total, ends)."""

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, documents = [], 0, 0
        for batch in batches:
            documents += batch.num_rows
            for hashes, _, _ in token_runs((0, t.as_py()) for t in batch.column(0)):
                keys, counts = np.unique(hashes, return_counts=True)
                parts.append((keys, counts.astype(np.uint64)))
                held += len(keys)
                if held > 4 * BATCH_TOKENS:
                    parts = [merged(parts)]
                    if (held := len(parts[0][0])) > 2 * BATCH_TOKENS:
                        yield packed(*parts[0], word_bits)
                        parts, held = [], 0
        if parts:
            yield packed(*merged(parts), word_bits)

    def write_words(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        keys, counts = _unpack(table)
        path = _put(folder, f"words-{shard:05d}", keys, counts)
        return pa.table({"shard": pa.array([shard], pa.int32()), "path": [path], "n": [len(keys)], "total": [int(counts.sum())], "ends": [int(counts[keys == END].sum())]})

    return stage(rows.mapInArrow(count_words, PACKED).groupBy("shard").applyInArrow(write_words, "shard int, path string, n long, total long, ends long"), "op6-words").collect()


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """Counts all rows of docs and writes the model's files to the shared folder, which must be a mounted file system."""
    spark = docs.sparkSession
    folder = workspace(spark, "op6-model")
    if urlparse(folder).scheme not in ("", "file"):
        raise ValueError("workers map the model's files: spark.checkpoint.dir must be on a mounted file system")
    rows = docs.select(F.col(text_col).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    word_bits, pair_bits = _bits(size, WORD_BYTES), _bits(size, PAIR_BYTES)

    words = _train_words(rows, folder, word_bits)
    files = [(r.shard, r.path, r.n) for r in words]
    vocabulary, tokens, documents = sum(r.n for r in words), sum(r.total for r in words), sum(r.ends for r in words)
    if vocabulary >= (1 << 32) - 1:
        raise ValueError("words are numbered with 32 bits")

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Coder(files, word_bits)
        parts, held = [], 0
        for batch in batches:
            for hashes, _, first in token_runs((0, t.as_py()) for t in batch.column(0)):
                context, word, _ = code(hashes, first)
                keys, counts = np.unique(pair_keys(context, word), return_counts=True)
                parts.append((keys, counts.astype(np.uint64)))
                held += len(keys)
                if held > 5 * BATCH_TOKENS:
                    yield packed(*merged(parts), pair_bits)
                    parts, held = [], 0
        if parts:
            yield packed(*merged(parts), pair_bits)

    def write_pairs(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        keys, counts = _unpack(table)
        path = _put(folder, f"pairs-{shard:05d}", keys, counts)
        plain = unmixed(keys)
        context, word = (plain >> _U(32)).astype(np.int64), (plain & _U(0xFFFFFFFF)).astype(np.int64)
        level = np.minimum(counts, 3).astype(np.int64)
        out: dict[str, list] = {"shard": [], "path": [], "n": [], "coded": [], "block": [], "kind": [], "ids": [], "values": []}

        def add(block: int, kind: int, ids: np.ndarray, values: np.ndarray) -> None:
            row = {"shard": shard, "path": None, "n": None, "coded": None, "block": block, "kind": kind, "ids": ids.astype(np.uint32).tobytes(), "values": values.astype(np.uint32).tobytes()}
            for k, v in row.items():
                out[k].append(v)

        for kind, ids in ((0, word), *((k, context[level == k]) for k in (1, 2, 3))):
            distinct, n = np.unique(ids, return_counts=True)
            cuts = np.flatnonzero(np.diff(distinct // DENSE)) + 1
            for i, v in zip(np.split(distinct, cuts), np.split(n, cuts)):
                if len(i):
                    add(int(i[0] // DENSE), kind, i % DENSE, v)
        histogram = [int((counts == k).sum()) for k in (1, 2, 3, 4)]
        for k, v in {"shard": shard, "path": path, "n": len(keys), "coded": histogram, "block": None, "kind": None, "ids": None, "values": None}.items():
            out[k].append(v)
        kinds = {"shard": pa.int32(), "path": pa.string(), "n": pa.int64(), "coded": pa.list_(pa.int64()), "block": pa.int32(), "kind": pa.int32(), "ids": pa.binary(), "values": pa.binary()}
        return pa.table({k: pa.array(v, kinds[k]) for k, v in out.items()})

    made = stage(rows.mapInArrow(count_pairs, PACKED).groupBy("shard").applyInArrow(write_pairs, "shard int, path string, n long, coded array<long>, block int, kind int, ids binary, values binary"), "op6-pairs")
    pairs = made.filter("path is not null").select("shard", "path", "n", "coded").collect()

    def write_dense(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        n = min(DENSE, vocabulary + 1 - block * DENSE)
        dense = np.zeros((4, n), dtype=np.uint32)
        for kind, ids, values in zip(table.column("kind").to_pylist(), table.column("ids"), table.column("values")):
            dense[kind, np.frombuffer(ids.as_py(), dtype=np.uint32)] += np.frombuffer(values.as_py(), dtype=np.uint32)
        path = _put(folder, f"dense-{block:05d}", dense)
        c = dense[0]
        return pa.table({"block": pa.array([block], pa.int32()), "path": [path], "n": [n], "types": [int(c.sum(dtype=np.uint64))], "coded": pa.array([[int((c == k).sum()) for k in (1, 2, 3, 4)] + [int((c >= 3).sum())]], pa.list_(pa.int64()))})

    blocks = stage(made.filter("path is null").select("block", "kind", "ids", "values").groupBy("block").applyInArrow(write_dense, "block int, path string, n long, types long, coded array<long>"), "op6-dense").collect()
    types = sum(r.types for r in blocks)
    low = [sum(r.coded[k] for r in blocks) for k in range(5)]
    pair_d, low_d = discounts([sum(r.coded[k] for r in pairs) for k in range(4)]), discounts(low[:4])
    low_share = (low_d[0] * low[0] + low_d[1] * low[1] + low_d[2] * low[4]) / types if types else 1.0
    return Model(files, word_bits, [(r.shard, r.path, r.n) for r in pairs], pair_bits, [(r.block, r.path, r.n) for r in blocks], tokens, documents, pair_d, low_d, types, low_share)


class TrigramCoder(Coder):
    """Token runs as trigrams: two words of context."""

    def __init__(self, files: list[tuple[int, str, int]], bits: int):
        super().__init__(files, bits)
        self.before = -1

    def trigrams(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(words before the contexts, contexts, words, word counts); a document starts behind two starts."""
        context, word, counts = self(hashes, first)
        before = np.r_[self.before, context[:-1]]
        before[first] = self.words.size
        self.before = context[-1]
        return before, context, word, counts


_ODD = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53


def scrambled(x: np.ndarray, bits: int) -> np.ndarray:
    """A permutation of the numbers of so many bits that spreads them evenly."""
    half, mask = _U((bits + 1) // 2), _U((1 << bits) - 1)
    for odd in _ODD:
        x = x ^ (x >> half)
        x = (x * _U(odd)) & mask
    return x ^ (x >> half)


def unscrambled(x: np.ndarray, bits: int) -> np.ndarray:
    """The inverse of scrambled."""
    half, mask = _U((bits + 1) // 2), _U((1 << bits) - 1)
    for odd in reversed(_ODD):
        x = x ^ (x >> half)
        x = (x * _U(pow(odd, -1, 1 << 64))) & mask
    return x ^ (x >> half)


class Space:
    """Keys of pairs of word numbers: twice the bits of a number, scrambled, cut at the shards of their top bits."""

    def __init__(self, vocabulary: int, bits: int):
        self.each = max(1, vocabulary.bit_length())  # numbers go from 0 to vocabulary, the start of a document
        self.bits = min(bits, 2 * self.each)
        self.rest = 2 * self.each - self.bits

    def keys(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        return scrambled((context.astype(np.uint64) << _U(self.each)) | word.astype(np.uint64), 2 * self.each)

    def numbers(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        plain = unscrambled(keys, 2 * self.each)
        return (plain >> _U(self.each)).astype(np.int64), (plain & _U((1 << self.each) - 1)).astype(np.int64)

    def slices(self, keys: np.ndarray) -> Iterator[tuple[int, slice]]:
        """The parts of sorted keys by shard."""
        edges = [0, *np.searchsorted(keys, np.arange(1, 1 << self.bits, dtype=np.uint64) << _U(self.rest)).tolist(), len(keys)]
        for shard, (a, b) in enumerate(zip(edges, edges[1:])):
            if b > a:
                yield shard, slice(a, b)

    def within(self, keys: np.ndarray) -> np.ndarray:
        return keys & _U((1 << self.rest) - 1)


def squeezed(values: np.ndarray, rising: bool = False) -> bytes:
    """Unsigned numbers, as differences where they rise, by planes of bytes and compressed."""
    steps = np.diff(values, prepend=values.dtype.type(0)) if rising else values
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, values.itemsize).T).tobytes())


def unsqueezed(raw: bytes, kind: type, rising: bool = False) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.uint8).reshape(np.dtype(kind).itemsize, -1)
    steps = np.ascontiguousarray(planes.T).reshape(-1).view(kind)
    return np.cumsum(steps, dtype=kind) if rising else steps


def trigrams_summed(keys: np.ndarray, before: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (pair key, word before it), sorted, with the sums of their counts."""
    distinct, rank = np.unique(keys, return_inverse=True)
    whole = (rank.astype(np.uint64) << _U(32)) | before.astype(np.uint64)
    whole, counts = summed(whole, counts)
    return distinct[(whole >> _U(32)).astype(np.int64)], (whole & _U(0xFFFFFFFF)).astype(np.uint32), counts


def _laid(arrays: list[np.ndarray]) -> list[np.ndarray]:
    """Arrays for a file: their lengths first, each filled up to 8 bytes."""
    out = [np.array([len(a) for a in arrays], dtype=np.uint64)]
    for a in arrays:
        out += [a, np.zeros(-a.nbytes % 8, dtype=np.uint8)]
    return out


def _mapped(path: str, kinds: list[type]) -> list[np.ndarray]:
    """The arrays of a file that _laid lays out, in one map."""
    raw = np.asarray(np.memmap(path, dtype=np.uint8, mode="r"))
    at, out = 8 * len(kinds), []
    for kind, n in zip(kinds, raw[:at].view(np.uint64).tolist()):
        size = n * np.dtype(kind).itemsize
        out.append(raw[at : at + size].view(kind))
        at += size + -size % 8
    return out


def lower_bound(values: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The first place of each range from low to high whose value isn't below the wanted one: binary searches, all at once."""
    low, high = low.copy(), high.copy()
    live = np.flatnonzero(low < high)
    while len(live):
        a, b = low[live], high[live]
        mid = (a + b) >> 1
        less = values[mid] < wanted[live]
        low[live], high[live] = a, b = np.where(less, mid + 1, a), np.where(less, b, mid)
        live = live[a < b]
    return low


class Small:
    """Counts in a byte each; those of 255 and more apart, in 64 bits."""

    KINDS = [np.uint8, np.uint32, np.uint64]

    def __init__(self, low: np.ndarray, places: np.ndarray, values: np.ndarray):
        self.low, self.places, self.values = low, places, values

    @staticmethod
    def arrays(values: np.ndarray) -> list[np.ndarray]:
        places = np.flatnonzero(values >= 255)
        return [np.minimum(values, 255).astype(np.uint8), places.astype(np.uint32), values[places].astype(np.uint64)]

    def take(self, at: np.ndarray) -> np.ndarray:
        out = self.low[at].astype(np.int64)
        big = np.flatnonzero(out == 255)
        if len(big):
            out[big] = self.values[np.searchsorted(self.places, at[big])]
        return out


class Keys:
    """Sorted keys of a shard: an index by their top bits, some 16 keys an entry, and their low bits, 32 at most."""

    KINDS = [np.uint32, np.uint32]

    def __init__(self, index: np.ndarray, low: np.ndarray, rest: int):
        self.index, self.low = index, low
        self.shift = rest - ((len(index) - 1).bit_length() - 1)

    @staticmethod
    def arrays(keys: np.ndarray, rest: int) -> list[np.ndarray]:
        top = min(rest, max(rest - 32, (len(keys) >> 4).bit_length()))
        edges = np.searchsorted(keys >> _U(rest - top), np.arange((1 << top) + 1, dtype=np.uint64))
        return [edges.astype(np.uint32), (keys & _U((1 << (rest - top)) - 1)).astype(np.uint32)]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether it is there) of each key."""
        if not len(self.low):
            return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
        top = (keys >> _U(self.shift)).astype(np.int64)
        wanted, high = (keys & _U((1 << self.shift) - 1)).astype(np.uint32), self.index[top + 1].astype(np.int64)
        at = lower_bound(self.low, self.index[top].astype(np.int64), high, wanted)
        return at, (at < high) & (self.low[np.minimum(at, len(self.low) - 1)] == wanted)


class TrigramShard:
    """Pairs of raw count 1 with the word before them; others with raw counts and, behind each, the words before it."""

    KINDS = [*Keys.KINDS, np.uint32, *Keys.KINDS, *Small.KINDS, np.uint32, np.uint32, *Small.KINDS]

    def __init__(self, path: str, rest: int):
        a = _mapped(path, self.KINDS)
        self.ones, self.one_before = Keys(a[0], a[1], rest), a[2]
        self.keys, self.raw, self.start, self.before, self.counts = Keys(a[3], a[4], rest), Small(*a[5:8]), a[8], a[9], Small(*a[10:13])

    @staticmethod
    def arrays(keys: np.ndarray, before: np.ndarray, counts: np.ndarray, first: np.ndarray, raw: np.ndarray, rest: int) -> list[np.ndarray]:
        """Of sorted trigrams; first marks where their pairs begin, raw has the counts of these."""
        one = raw == 1
        width = np.diff(np.r_[first, len(keys)])
        many = np.repeat(~one, width)
        start = np.r_[0, np.cumsum(width[~one])].astype(np.uint32)
        return [*Keys.arrays(keys[first[one]], rest), before[first[one]], *Keys.arrays(keys[first[~one]], rest), *Small.arrays(raw[~one]), start, before[many], *Small.arrays(counts[many])]

    def find(self, keys: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Raw count, continuation count and trigram count of pairs and the words before them, 0 where there is none: shape (3, n)."""
        out = np.zeros((3, len(keys)), dtype=np.int64)
        at, hit = self.ones.find(keys)
        own = np.flatnonzero(hit)
        out[:2, own] = 1
        out[2, own] = self.one_before[at[own]] == before[own]
        others = np.flatnonzero(~hit)
        at, hit = self.keys.find(keys[others])
        own, at = others[hit], at[hit]
        low, high = self.start[at].astype(np.int64), self.start[at + 1].astype(np.int64)
        out[0, own], out[1, own] = self.raw.take(at), high - low
        spot = lower_bound(self.before, low, high, before[own])
        found = np.flatnonzero(spot < high)
        found = found[self.before[spot[found]] == before[own[found]]]
        out[2, own[found]] = self.counts.take(spot[found])
        return out


class ContextShard:
    """Contexts of raw count 2 and more, with their trigram types of count 1, 2, 3+."""

    KINDS = [*Keys.KINDS, *Small.KINDS * 3]

    def __init__(self, path: str, rest: int):
        a = _mapped(path, self.KINDS)
        self.keys, self.types = Keys(a[0], a[1], rest), [Small(*a[i : i + 3]) for i in (2, 5, 8)]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Types of keys: shape (3, n). A context that isn't here has one trigram, of count 1."""
        at, hit = self.keys.find(keys)
        out = np.zeros((3, len(keys)), dtype=np.int64)
        out[0] = 1
        for k in range(3):
            out[k, hit] = self.types[k].take(at[hit])
        return out


class TrigramModel:
    """The files of a trained model of order 3, and the few numbers that they share. Pickles small."""

    def __init__(self, words, word_bits, shards, contexts, space, dense, tokens, documents, top_d, mid_d, low_d, types, low_share):
        self.words, self.word_bits, self.shards, self.contexts, self.space, self.dense = words, word_bits, shards, contexts, space, dense
        self.tokens, self.documents, self.top_d, self.mid_d, self.low_d, self.types, self.low_share = tokens, documents, top_d, mid_d, low_d, types, low_share

    def open(self) -> TrigramScorer:
        return TrigramScorer(self)


def _off(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.select([counts == 0, counts == 1, counts == 2], [0.0, d[0], d[1]], d[2])


class TrigramScorer:
    """Probabilities over mapped arrays: trigrams by raw counts, pairs and words by continuation counts.

    Files are mapped when first needed, and at most OPEN_MAPS of a kind at a time.
    """

    def __init__(self, m: TrigramModel):
        self.m, self.code, self.last = m, TrigramCoder(m.words, m.word_bits), 0
        self.size = self.code.words.size
        shards, contexts, dense = dict(m.shards), dict(m.contexts), dict(m.dense)
        self.shard = lru_cache(OPEN_MAPS)(lambda s: TrigramShard(shards[s], m.space.rest) if s in shards else None)
        self.context = lru_cache(OPEN_MAPS)(lambda s: ContextShard(contexts[s], m.space.rest) if s in contexts else None)
        self.block = lru_cache(OPEN_MAPS)(lambda b: _dense_block(dense[b]) if b in dense else None)

    def _dense(self, numbers: np.ndarray, kinds: tuple[int, ...]) -> np.ndarray:
        """Rows of the dense arrays: continuation count, pair types of continuation count 1, 2, 3+ by context, their sum."""
        out = np.zeros((len(kinds), len(numbers)), dtype=np.float64)
        block = numbers // DENSE
        for b in np.unique(block[numbers >= 0]).tolist():
            if found := self.block(b):
                at = np.flatnonzero(block == b)
                for row, k in enumerate(kinds):
                    out[row, at] = found[k].take(numbers[at] % DENSE)
        return out

    def run(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 probability, training count) of each token of a run. Runs must come in order."""
        m, space = self.m, self.m.space
        before, context, word, counts = self.code.trigrams(hashes, first)
        distinct, back = np.unique(word, return_inverse=True)
        cont = self._dense(distinct, (0,))[0]
        p = ((cont - _off(cont, m.low_d)) / max(m.types, 1) + m.low_share / (self.size + 1))[back]

        found = np.zeros((3, len(word)), dtype=np.int64)
        at = np.flatnonzero((word >= 0) & (context >= 0))
        keys = space.keys(context[at], word[at])
        order = np.argsort(keys)
        keys, at = keys[order], at[order]
        for shard, part in space.slices(keys):
            if known := self.shard(shard):
                found[:, at[part]] = known.find(space.within(keys[part]), before[at[part]].astype(np.uint32))
        raw, pair_c, trigram_c = found

        heads, back = np.unique(context, return_inverse=True)
        by = self._dense(heads, (1, 2, 3, 4))
        share = np.where(by[3] > 0, (m.mid_d[0] * by[0] + m.mid_d[1] * by[1] + m.mid_d[2] * by[2]) / np.maximum(by[3], 1), 1.0)
        p = (pair_c - _off(pair_c, m.mid_d)) / np.maximum(by[3], 1)[back] + share[back] * p

        total = np.r_[self.last, raw[:-1]]  # a trigram's context is the pair before it
        total[first] = m.documents
        self.last = raw[-1]
        types = np.zeros((3, len(word)), dtype=np.int64)
        types[0, total == 1] = 1
        at = np.flatnonzero(total > 1)
        heads, back = np.unique(space.keys(before[at], context[at]), return_inverse=True)
        by = np.zeros((3, len(heads)), dtype=np.int64)
        for shard, part in space.slices(heads):
            if known := self.context(shard):
                by[:, part] = known.find(space.within(heads[part]))
        types[:, at] = by[:, back]
        at = np.flatnonzero(total > 0)
        share = m.top_d[0] * types[0, at] + m.top_d[1] * types[1, at] + m.top_d[2] * types[2, at]
        p[at] = (trigram_c[at] - _off(trigram_c[at], m.top_d) + share * p[at]) / total[at]
        return np.log10(p), counts


def _dense_block(path: str) -> list[Small]:
    a = _mapped(path, Small.KINDS * 5)
    return [Small(*a[i : i + 3]) for i in range(0, 15, 3)]


def train_trigrams(docs: DataFrame, text_col: str = "text") -> TrigramModel:
    """A model of order 3 over all rows of docs; files as in train.

    Trigrams go to the shard of their last two words, which has their continuation counts and, as each word but an end
    is followed by another, the totals of contexts as raw counts of pairs. Types by context take a second exchange. What
    is sent and staged is sorted and compressed, and shuffle files are let go of as soon as their readers have ended.
    """
    spark = docs.sparkSession
    folder = workspace(spark, "op6-model")
    if urlparse(folder).scheme not in ("", "file"):
        raise ValueError("workers map the model's files: spark.checkpoint.dir must be on a mounted file system")
    rows = docs.select(F.col(text_col).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    word_bits = _bits(size, WORD_BYTES)
    words = _train_words(rows, folder, word_bits)
    release(spark)
    files = [(r.shard, r.path, r.n) for r in words]
    vocabulary, tokens, documents = sum(r.n for r in words), sum(r.total for r in words), sum(r.ends for r in words)
    if vocabulary >= (1 << 32) - 1:
        raise ValueError("words are numbered with 32 bits")
    space = Space(vocabulary, _bits(size, TRIGRAM_BYTES))

    def table_of(out: list[dict], kinds: dict[str, pa.DataType]) -> pa.Table:
        return pa.table({k: pa.array([r.get(k) for r in out], t) for k, t in kinds.items()})

    def joined(table: pa.Table, column: str, kind: type, rising: bool = False) -> np.ndarray:
        return np.concatenate([unsqueezed(x.as_py(), kind, rising) for x in table.column(column)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, parts, held = TrigramCoder(files, word_bits), [], 0

        def send() -> pa.RecordBatch:
            keys, before = (np.concatenate(x) for x in zip(*parts))
            keys, before, counts = trigrams_summed(keys, before, np.ones(len(keys), dtype=np.uint32))
            out = [{"shard": s, "keys": squeezed(keys[x], True), "before": squeezed(before[x]), "counts": squeezed(counts[x].astype(np.uint32))} for s, x in space.slices(keys)]
            return table_of(out, {"shard": pa.int32(), "keys": pa.binary(), "before": pa.binary(), "counts": pa.binary()}).combine_chunks().to_batches()[0]

        for batch in batches:
            for hashes, _, first in token_runs((0, t.as_py()) for t in batch.column(0)):
                before, context, word, _ = code.trigrams(hashes, first)
                parts.append((space.keys(context, word), before.astype(np.uint32)))
                held += len(word)
                if held > 2 * BATCH_TOKENS:
                    yield send()
                    parts, held = [], 0
        if parts:
            yield send()

    made_kinds = {"shard": pa.int32(), "path": pa.string(), "coded": pa.list_(pa.int64()), "block": pa.int32(), "kind": pa.int32(), "ids": pa.binary(), "values": pa.binary(), "keys": pa.binary()}

    def write(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        keys, before, counts = trigrams_summed(joined(table, "keys", np.uint64, True), joined(table, "before", np.uint32), joined(table, "counts", np.uint32).astype(np.uint64))
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        cont, raw = np.diff(np.r_[first, len(keys)]), np.add.reduceat(counts, first)
        path = _put(folder, f"trigrams-{shard:05d}", *_laid(TrigramShard.arrays(space.within(keys), before, counts, first, raw, space.rest)))
        context, word = space.numbers(keys[first])
        histogram = [int((x == k).sum()) for x in (counts, cont) for k in (1, 2, 3, 4)]
        out: list[dict] = [{"shard": shard, "path": path, "coded": histogram}]
        level = np.minimum(cont, 3)
        for kind, ids, values in ((0, word, None), *((k, context[level == k], None) for k in (1, 2, 3)), (4, context, cont)):
            distinct, back = np.unique(ids, return_inverse=True)
            n = np.bincount(back, weights=values, minlength=len(distinct)).astype(np.uint64)
            cuts = np.flatnonzero(np.diff(distinct // DENSE)) + 1
            for i, v in zip(np.split(distinct, cuts), np.split(n, cuts)):
                if len(i):
                    out.append({"block": int(i[0] // DENSE), "kind": kind, "ids": squeezed((i % DENSE).astype(np.uint32), True), "values": squeezed(v)})
        heads, back = np.unique(space.keys(before, np.repeat(context, cont)), return_inverse=True)
        level = np.minimum(counts, 3)
        types = np.stack([np.bincount(back, weights=level == k, minlength=len(heads)).astype(np.uint32) for k in (1, 2, 3)])
        out += [{"shard": s, "keys": squeezed(heads[x], True), "values": squeezed(np.ascontiguousarray(types[:, x]).reshape(-1))} for s, x in space.slices(heads)]
        return table_of(out, made_kinds)

    made = stage(rows.mapInArrow(count, "shard int, keys binary, before binary, counts binary").groupBy("shard").applyInArrow(write, "shard int, path string, coded array<long>, block int, kind int, ids binary, values binary, keys binary"), "op6-trigrams")
    release(spark)
    shards = made.filter("path is not null").select("shard", "path", "coded").collect()

    def write_contexts(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        keys = joined(table, "keys", np.uint64, True)
        types = np.concatenate([unsqueezed(x.as_py(), np.uint32).reshape(3, -1) for x in table.column("values")], axis=1)
        order = np.argsort(keys)
        keys, types = keys[order], types[:, order].astype(np.uint64)
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        keys, types = keys[first], np.add.reduceat(types, first, axis=1)
        many = (types[0] > 1) | (types[1] > 0) | (types[2] > 0)
        arrays = Keys.arrays(space.within(keys[many]), space.rest)
        for row in types:
            arrays += Small.arrays(row[many])
        return pa.table({"shard": pa.array([shard], pa.int32()), "path": [_put(folder, f"contexts-{shard:05d}", *_laid(arrays))]})

    contexts = stage(made.filter("keys is not null").select("shard", "keys", "values").groupBy("shard").applyInArrow(write_contexts, "shard int, path string"), "op6-contexts").collect()
    release(spark)

    def write_dense(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        dense = np.zeros((5, min(DENSE, vocabulary + 1 - block * DENSE)), dtype=np.uint64)
        for kind, ids, values in zip(table.column("kind").to_pylist(), table.column("ids"), table.column("values")):
            dense[kind, unsqueezed(ids.as_py(), np.uint32, True)] += unsqueezed(values.as_py(), np.uint64)
        path = _put(folder, f"dense-{block:05d}", *_laid([a for row in dense for a in Small.arrays(row)]))
        c = dense[0]
        return pa.table({"block": pa.array([block], pa.int32()), "path": [path], "types": [int(c.sum())], "coded": pa.array([[int((c == k).sum()) for k in (1, 2, 3, 4)] + [int((c >= 3).sum())]], pa.list_(pa.int64()))})

    blocks = stage(made.filter("kind is not null").select("block", "kind", "ids", "values").groupBy("block").applyInArrow(write_dense, "block int, path string, types long, coded array<long>"), "op6-dense").collect()
    unstage(made)
    release(spark)
    types = sum(r.types for r in blocks)
    low = [sum(r.coded[k] for r in blocks) for k in range(5)]
    seen = [sum(r.coded[k] for r in shards) for k in range(8)]
    top_d, mid_d, low_d = discounts(seen[:4]), discounts(seen[4:]), discounts(low[:4])
    low_share = (low_d[0] * low[0] + low_d[1] * low[1] + low_d[2] * low[4]) / types if types else 1.0
    return TrigramModel(files, word_bits, [(r.shard, r.path) for r in shards], [(r.shard, r.path) for r in contexts], space, [(r.block, r.path) for r in blocks], tokens, documents, top_d, mid_d, low_d, types, low_share)


def score_texts(docs: DataFrame, model: Model | TrigramModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Tokens are the words and one end; null counts as empty, whose only token is the end. Without training data every
    token has probability 1 / (V + 1) with V = 0, so scores are 0. Rows never move.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    sent = spark.sparkContext.broadcast(model)  # paths and a few numbers for each shard
    n, v = model.tokens, sum(f[2] for f in model.words)
    logs = math.log10(n + 1 * (v + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = sent.value.open()
        for batch in batches:
            rows = batch.num_rows
            tokens, known, base, score = np.zeros(rows, dtype=np.int64), np.zeros(rows, dtype=np.int64), np.zeros(rows), np.zeros(rows)
            for hashes, owner, first in token_runs((i, t.as_py()) for i, t in enumerate(batch.column(1))):
                p, counts = scorer.run(hashes, first)
                tokens += np.bincount(owner, minlength=rows)
                known += np.bincount(owner, weights=counts > 0, minlength=rows).astype(np.int64)
                base += np.bincount(owner, weights=np.log10(counts + 1.0) - logs, minlength=rows)
                score += np.bincount(owner, weights=p, minlength=rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens), pa.array(known), pa.array(base), pa.array(score)], names=["id", "n_tokens", "n_known", "base_score", "score"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_type}, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    scored = score_texts(docs, train_trigrams(docs.filter(~held)))
    return scored.withColumn("held_out", held).drop("perplexity")


QUERIES = {"op6_lm_scoring": op6_lm_scoring}
ORACLE_SQL: dict[str, str] = {}
