import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lucerna.llm import ngram

TEXTS = ["the cat sat on the mat", "the cat ate the rat", "A cat and a dog", "the the the the", "", None, "x y z x y z x y q", "the dog sat on the cat on the mat"]


def brute(train, held):
    """Interpolated modified Kneser-Ney of order 2, by definition."""
    seqs = [[w for w in (t or "").lower().split()] + ["</s>"] for t in train]
    uni, bi, ctx = Counter(), Counter(), Counter()
    for s in seqs:
        uni.update(s)
        for v, w in zip(["<s>", *s], s):
            bi[v, w] += 1
            ctx[v] += 1
    cont = Counter(w for _, w in bi)
    d_of = lambda values: ngram.discounts([sum(c == k for c in values) for k in (1, 2, 3, 4)])
    pd, ld = d_of(list(bi.values())), d_of(list(cont.values()))
    disc = lambda d, c: 0 if c == 0 else d[min(c, 3) - 1]
    types = sum(cont.values())
    share = sum(disc(ld, c) for c in cont.values()) / types
    by = defaultdict(list)
    for (v, _), c in bi.items():
        by[v].append(c)

    def p(v, w):
        low = max(cont[w] - disc(ld, cont[w]), 0) / types + share / (len(uni) + 1)
        if not ctx[v]:
            return low
        gamma = sum(disc(pd, c) for c in by[v]) / ctx[v]
        return max(bi[v, w] - disc(pd, bi[v, w]), 0) / ctx[v] + gamma * low

    out = []
    for t in held:
        s = [w for w in (t or "").lower().split()] + ["</s>"]
        out.append((len(s), sum(uni[w] > 0 for w in s), sum(map(lambda vw: math.log10(p(*vw)), zip(["<s>", *s], s))), sum(math.log10((uni[w] + 1) / (sum(uni.values()) + len(uni) + 1)) for w in s)))
    return out, sum(p("the", w) for w in uni) + p("the", "unseen")


@pytest.mark.parametrize("piece", [1 << 20, 5])
def test_scores_equal_the_definition(spark, monkeypatch, piece):
    monkeypatch.setattr(ngram, "PIECE_BYTES", piece)
    rows = [(i, t) for i, t in enumerate(TEXTS + ["unknown words here", "The mat\tsat", ""])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = ngram.train(df.filter("doc_id < 8"))
    got = {r.doc_id: r for r in ngram.score_texts(df, model).collect()}
    want, mass = brute(TEXTS, [t for _, t in rows])
    assert mass == pytest.approx(1.0)
    for (i, _), (n, known, score, base) in zip(rows, want):
        r = got[i]
        assert (r.n_tokens, r.n_known) == (n, known)
        assert r.score == pytest.approx(score)
        assert r.base_score == pytest.approx(base)


def test_runs_that_end_within_a_document(spark, monkeypatch):
    monkeypatch.setattr(ngram, "BATCH_TOKENS", 3)
    monkeypatch.setattr(ngram, "PIECE_BYTES", 4)
    runs = list(ngram.token_runs(enumerate(["a b c d e f", "", "g"])))
    assert sum(len(h) for h, _, _ in runs) == 10
    assert [int(o) for _, owner, _ in runs for o in owner] == [0] * 7 + [1] + [2] * 2
    assert sum(int(f.sum()) for _, _, f in runs) == 3


def test_no_training_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    got = ngram.score_texts(df, ngram.train(df.limit(0))).collect()
    assert [r.score for r in got] == [0.0, 0.0] and [r.n_tokens for r in got] == [3, 1]
    assert ngram.score_texts(df.limit(0), ngram.train(df)).count() == 0


def test_query_beats_the_base_on_held_out_text(spark):
    out = ngram.op6_lm_scoring(spark, "/root/testdata/sf0.001").toPandas()
    assert list(out.columns) == ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "held_out"]
    assert [zlib.crc32(str(i).encode()) % 7 == 2 for i in out.doc_id] == out.held_out.tolist()
    held = out[out.held_out]
    assert held.score.sum() > held.base_score.sum()


def brute3(train, held):
    """Interpolated modified Kneser-Ney of order 3, by definition."""
    seqs = [[w for w in (t or "").lower().split()] + ["</s>"] for t in train]
    tri = Counter(x for s in seqs for x in zip(["<s>", "<s>", *s], ["<s>", *s], s))
    bi = Counter((v, w) for _, v, w in tri)
    uni = Counter(w for _, w in bi)
    vocabulary = {w for s in seqs for w in s}
    d_of = lambda values: ngram.discounts([sum(c == k for c in values) for k in (1, 2, 3, 4)])
    disc = lambda d, c: 0 if c == 0 else d[min(c, 3) - 1]

    def level(counts, context, key, lower):
        d = d_of(list(counts.values()))
        own = [c for k, c in counts.items() if context(k)]
        return (counts[key] - disc(d, counts[key])) / sum(own) + sum(disc(d, c) for c in own) / sum(own) * lower if own else lower

    def p(u, v, w):
        low = level(uni, lambda k: True, w, 1 / (len(vocabulary) + 1))
        mid = level(bi, lambda k: k[0] == v, (v, w), low)
        return level(tri, lambda k: k[:2] == (u, v), (u, v, w), mid)

    out = []
    for t in held:
        s = [w for w in (t or "").lower().split()] + ["</s>"]
        out.append(sum(math.log10(p(*x)) for x in zip(["<s>", "<s>", *s], ["<s>", *s], s)))
    return out, [sum(p(*c, w) for w in [*vocabulary, "unseen"]) for c in (("<s>", "<s>"), ("on", "the"), ("x", "the"), ("q", "zz"))]


@pytest.mark.parametrize("small", [False, True])
def test_trigram_scores_equal_the_definition(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(ngram, "PIECE_BYTES", 5)
        monkeypatch.setattr(ngram, "BATCH_TOKENS", 3)
    rows = [(i, t) for i, t in enumerate(TEXTS + ["unknown words here", "The mat\tsat on the", "the cat on the unknown mat sat on the cat", ""])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in ngram.score_texts(df, ngram.train_trigrams(df.filter("doc_id < 8"))).collect()}
    want, mass = brute3(TEXTS, [t for _, t in rows])
    assert mass == pytest.approx([1.0] * 4)
    assert [got[i].score for i, _ in rows] == pytest.approx(want)
    assert [r.score for r in ngram.score_texts(df, ngram.train_trigrams(df.limit(0))).collect()] == [0.0] * len(rows)


def test_query_scores_with_two_words_of_context(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    trained = [r.text for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 7 != 2]
    want = {r.doc_id: r.score for r in ngram.score_texts(docs, ngram.train_trigrams(spark.createDataFrame([(t,) for t in trained], "text string"))).collect()}
    got = {r.doc_id: r.score for r in ngram.op6_lm_scoring(spark, sf).collect()}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("vocabulary, bits", [(1, 2), (5, 20), (1_247_806, 4), ((1 << 32) - 2, 24)])
def test_spaces_of_pair_keys_can_be_undone(vocabulary, bits):
    space = ngram.Space(vocabulary, bits)
    rng = np.random.default_rng(1)
    context, word = rng.integers(0, vocabulary + 1, (2, 3000))
    keys = space.keys(context, word)
    assert all((a == b).all() for a, b in zip(space.numbers(keys), (context, word)))
    assert len(np.unique(keys)) == len(set(zip(context.tolist(), word.tolist())))
    keys = np.sort(keys)
    shards = {s: part for s, part in space.slices(keys)}
    assert sum(p.stop - p.start for p in shards.values()) == len(keys)
    for s, part in shards.items():
        assert (keys[part] >> np.uint64(space.rest) == s).all()
        own = np.unique(space.within(keys[part]))
        found, hit = ngram.Keys(*ngram.Keys.arrays(own, space.rest), space.rest).find(own)
        assert hit.all() and (found == np.arange(len(own))).all()
        if space.rest:
            absent = np.setdiff1d(own ^ np.uint64(1), own)
            assert not ngram.Keys(*ngram.Keys.arrays(own, space.rest), space.rest).find(absent)[1].any()


def test_packed_numbers_can_be_undone():
    rng = np.random.default_rng(2)
    for kind in (np.uint32, np.uint64):
        values = rng.integers(0, np.iinfo(kind).max, 1000, dtype=kind)
        assert (ngram.unsqueezed(ngram.squeezed(values), kind) == values).all()
        assert (ngram.unsqueezed(ngram.squeezed(np.sort(values), True), kind, True) == np.sort(values)).all()
        assert len(ngram.unsqueezed(ngram.squeezed(values[:0]), kind)) == 0
    values = np.array([0, 254, 255, 256, 1, 1 << 40], dtype=np.uint64)
    assert (ngram.Small(*ngram.Small.arrays(values)).take(np.array([5, 0, 3, 2, 1, 4, 5])) == values[[5, 0, 3, 2, 1, 4, 5]]).all()


def test_trigrams_with_counts_beyond_a_byte(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(list("abcd"), 40)) for _ in range(60)] + ["a b c"] * 300
    held = ["a b c", "a b d q a", "d c b a", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(held)], "doc_id long, text string")
    model = ngram.train_trigrams(spark.createDataFrame([(t,) for t in texts], "text string"))
    got = {r.doc_id: r.score for r in ngram.score_texts(df, model).collect()}
    assert [got[i] for i in range(len(held))] == pytest.approx(brute3(texts, held)[0])
