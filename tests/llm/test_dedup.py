"""Exact and near dedup, substring dedup and decontamination against brute force and DuckDB."""

import hashlib
import random
import re
from itertools import combinations

import duckdb
import pytest
from pyspark.sql import functions as F

from lucerna.llm import decontaminate, exact_dedup, minhash, registry, substring_dedup
from lucerna.llm.components import connected_components

SF = "/root/testdata/sf0.001"


def frame(spark, texts, extra=False):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return df.withColumn("norm", F.lit("x")).withColumn("keep_id", F.lit(7)).withColumn("id", F.lit(0)).withColumn("row", F.lit(1)) if extra else df


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n in registry.ORACLE_SQL])
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = c.sql(registry.ORACLE_SQL[name]).df()
    got = registry.QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    key = want.columns[0]
    a, b = (x.astype(object).where(x.notna(), None).sort_values(key).values.tolist() for x in (got, want))
    assert [[str(int(v)) if isinstance(v, float) else str(v) for v in r] for r in a] == [[str(int(v)) if isinstance(v, float) else str(v) for v in r] for r in b]


def test_exact_dedup_rows(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MIN_HOT", 3)
    texts = ["a b", "ab", " a\tb ", None, "", " \n", "x", "ab "] + ["hot text"] * 9 + ["hot  text"] + ["y" * 200_000, "y" * 200_000 + "z"]
    df = frame(spark, texts, extra=True)
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(df, partitions=1).collect()}
    norm = lambda t: re.sub("[ \t-\r]", "", t or "")
    for i, t in enumerate(texts):
        same = [j for j, u in enumerate(texts) if norm(u) == norm(t)]
        keep = min(same, key=lambda j: (-len(texts[j] or ""), j))
        assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (keep, len(same), keep == i, hashlib.sha256(norm(t).encode()).hexdigest())
    rows = exact_dedup.drop_exact_duplicates(df.unionByName(df), partitions=1)
    assert rows.columns == df.columns and sorted(r.doc_id for r in rows.collect()) == sorted(i for i, r in got.items() if r.kept)
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0
    none = spark.createDataFrame([(None, "a"), (5, "a"), (None, None)], "doc_id long, text string")
    assert {(r.doc_id, r.keep_id) for r in exact_dedup.exact_dedup(none).collect()} == {(None, 5), (5, 5), (None, None)}


def near_texts(rng):
    words = [f"w{i}" for i in range(4000)]
    texts = [None, "", "one two", "one two", "one  TWO", "three"]
    for _ in range(6):
        base = [rng.choice(words) for _ in range(rng.randrange(60, 200))]
        for _ in range(rng.randrange(5, 25)):
            t = list(base)
            for _ in range(rng.randrange(0, 5)):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t))
    shared = " ".join(rng.choice(words) for _ in range(60))
    texts += [shared + " " + " ".join(rng.choice(words) for _ in range(rng.randrange(20, 90))) for _ in range(40)]
    rng.shuffle(texts)
    return texts


def components_of(texts, percent):
    sets = [set(minhash.shingle_set(t).tolist()) for t in texts]
    low = list(range(len(texts)))

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            a, b = sorted((root(i), root(j)))
            low[b] = a
    return [root(i) for i in range(len(texts))], [len(s) for s in sets]


@pytest.mark.parametrize("seed, percent, bands", [(1, 85, 24), (2, 80, 36)])
def test_near_duplicates_equal_brute_force(spark, seed, percent, bands):
    texts = near_texts(random.Random(seed))
    df = frame(spark, texts, extra=True)
    got = {r.doc_id: r for r in minhash.near_duplicates(df, percent=percent, bands=bands).collect()}
    want, sizes = components_of(texts, percent)
    assert [got[i].component_id for i in range(len(texts))] == want
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    if seed == 2:
        kept = minhash.drop_near_duplicates(df, percent=percent, bands=bands)
        assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_near_duplicates_edges(spark):
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (9, "A  b c d e f"), (11, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, None, True), (4, 4, True), (4, 4, True), (9, 4, False), (11, 11, True)], key=str)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_near_duplicates_of_string_ids(spark):
    texts = near_texts(random.Random(7))[:60]
    name = lambda i: f"doc-{i:03d}"
    df = spark.createDataFrame([(name(i), t) for i, t in enumerate(texts)], "doc_id string, text string")
    want, _ = components_of(texts, 85)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()} == {name(i): name(c) for i, c in enumerate(want)}


def test_estimate_follows_similarity():
    rng = random.Random(5)
    base = [f"w{rng.randrange(9999)}" for _ in range(400)]
    other = base[:360] + [f"v{i}" for i in range(40)]
    a, b = minhash.shingle_set(" ".join(base)), minhash.shingle_set(" ".join(other))
    true = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
    x, y = minhash.packed_bits(minhash.minima(a)), minhash.packed_bits(minhash.minima(b))
    differing = sum(((int(p) ^ int(q)) & (2**64 - 1)).bit_count() for p, q in zip(x, y))
    assert abs(1 - 2 * differing / minhash.HASHES - true) < 0.2


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (7, 7)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}


def brute_removed(texts, window):
    words = [(t or "").split() for t in texts]
    first = {}
    for d, w in enumerate(words):
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), d)
    out = []
    for d, w in enumerate(words):
        gone = {k for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < d for k in range(i, i + window)}
        out.append((len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


@pytest.mark.parametrize("held, hot_after", [(2_000_000, None), (50, 3), (2_000_000, 0)])
def test_substring_dedup_equals_brute_force(spark, monkeypatch, held, hot_after):
    monkeypatch.setattr(substring_dedup, "HELD", held)
    monkeypatch.setattr(substring_dedup, "HELD_BYTES", held)
    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    passages = [[rng.choice(words) for _ in range(rng.randrange(10, 60))] for _ in range(8)]
    texts = [None, "", "few words"]
    for _ in range(60):
        t = []
        for _ in range(rng.randrange(1, 5)):
            p = rng.choice(passages)
            t += [rng.choice(words) for _ in range(rng.randrange(0, 20))] + p[rng.randrange(0, 8) :]
        texts.append(" ".join(t))
    texts += ["a " * 40, "a " * 30, texts[10]]
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(frame(spark, texts, extra=True), with_text=True, hot_after=hot_after).collect()}
    for i, (n, gone, kept) in enumerate(brute_removed(texts, 13)):
        assert (got[i].n_words, got[i].n_removed, got[i].kept_text) == (n, gone, kept), i
        assert got[i].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()


def test_places_are_told_apart_by_words_alone():
    """Where every hash is the same, the words around a place still decide."""
    import numpy as np

    rng = random.Random(3)
    texts = [[rng.choice("ab") for _ in range(9)] for _ in range(200)]
    around = [w for t in texts for w in (x.encode() for x in t)]
    ids, one = np.arange(200) // 2, np.ones(200, dtype=np.int64)
    # windows of 7 words around a gram of 4 at word 2: windows 0, 1 and 2
    late = substring_dedup.extended(ids, np.zeros(200, dtype=np.uint64), 2 * one, 2 * one, around, 7, 4)
    for i, t in enumerate(texts):
        assert late[i].tolist() == [any(ids[k] < ids[i] and texts[k][j : j + 7] == t[j : j + 7] for k in range(200)) for j in range(3)] + [False], i


def test_substring_dedup_edges(spark):
    t = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(None, t), (3, t), (3, t), (8, t)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_removed) for r in substring_dedup.remove_repeats(df).collect()), key=str)
    assert got == sorted([(None, 0), (3, 0), (3, 0), (8, 20)], key=str)
    assert substring_dedup.remove_repeats(df.limit(0)).count() == 0


def brute_hits(text, items, width=10):
    fold = lambda t: re.findall("[^\x00-/:-`{-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    w, hit, found = fold(text), set(), set()
    for item, t in items:
        p = fold(t)
        m = min(width, len(p))
        for i in range(len(p) - m + 1 if m else 0):
            for k in range(len(w) - m + 1):
                if w[k : k + m] == p[i : i + m]:
                    hit |= set(range(k, k + m))
                    found.add(str(item))
    return len(w), len(hit), ",".join(sorted(found))


@pytest.mark.parametrize("shard", [4 << 20, 60])
def test_decontamination_equals_brute_force(spark, shard):
    rng = random.Random(3)
    words = [f"w{i}é" for i in range(12)]
    items = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate([1, 2, 3, 9, 10, 11, 25, 30])] + [(20, None), (21, " ,;"), (22, "The quick, BROWN fox")]
    texts = [None, "", "the QUICK brown. fox jumps"] + [" - ".join(rng.choice(words + ["zz"]) for _ in range(rng.randrange(1, 120))) for _ in range(40)] + [items[6][1].upper(), items[7][1] + " tail " + items[7][1]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = frame(spark, texts, extra=True)
    got = {r.doc_id: r for r in decontaminate.find_contamination(df, bench, shard_bytes=shard).collect()}
    for i, t in enumerate(texts):
        n, hit, ids = brute_hits(t, items)
        r = got[i]
        assert (r.n_words, r.n_hit, r.contaminated, r.items_sha256) == (n, hit, hit > 0, hashlib.sha256(ids.encode()).hexdigest()), i
    clean = decontaminate.drop_contaminated(df, bench, shard_bytes=shard)
    assert clean.columns == df.columns and sorted(r.doc_id for r in clean.collect()) == sorted(i for i in got if not got[i].contaminated)
    assert decontaminate.find_contamination(df, bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.find_contamination(df.limit(0), bench).count() == 0
