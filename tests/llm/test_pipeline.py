"""The pipeline's stages, each against plain Python on its own input."""

import re
from collections import defaultdict

import corpus_pipeline
from lucerna.llm.decontaminate import words_of
from lucerna.llm.mixing import targets_of
from lucerna.llm.toxicity import Scorer, fit
from lucerna.llm.toxicity import words_of as toxic_words
from tests.llm.test_dedup import components_of

SF = "/root/testdata/sf0.001"


def test_every_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.toPandas()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if name != "mixing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = docs.toPandas()
        texts = dict(zip(before.doc_id, before.text))
        if name == "toxicity":
            scorer: Scorer = fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
            want = {i for i, t in texts.items() if scorer.score(toxic_words(t)) < 0.3}
            assert len(want) < len(texts)
        elif name == "exact_dedup":
            best: dict = {}
            for i, t in texts.items():
                key = re.sub("[ \t-\r]", "", t or "")
                best[key] = min(best.get(key, (1, 0)), (-len(t or ""), i))
            want = {i for _, i in best.values()}
        elif name == "near_dedup":
            ids = sorted(texts)
            roots, _ = components_of([texts[i] for i in ids], corpus_pipeline.NEAR_PERCENT)
            want = {ids[r] for r in roots}
            assert len(want) < len(ids)
        elif name == "decontamination":
            windows = defaultdict(set)
            for t in spark.read.parquet(f"{SF}/benchmark.parquet").toPandas().text:
                w = words_of(t)
                m = min(10, len(w))
                windows[m] |= {tuple(w[i : i + m]) for i in range(len(w) - m + 1 if m else 0)}
            hit = lambda w: any(tuple(w[i : i + m]) in p for m, p in windows.items() for i in range(len(w) - m + 1))
            want = {i for i, t in texts.items() if not hit(words_of(t))}
        else:
            size = {i: len((t or "").encode().split()) for i, t in texts.items()}
            by: dict = defaultdict(int)
            for i, s in zip(before.doc_id, before.source):
                by[s] += size[i]
            target = targets_of(by, {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(by))}, sum(by.values()))
            source, took = dict(zip(before.doc_id, before.source)), defaultdict(int)
            for i, n in zip(after.doc_id, after.taken):
                took[source[i]] += n
                assert 0 < n <= 3 * size[i]
            for s in by:
                assert abs(took[s] - target[s]) <= max(size[i] for i in texts if source[i] == s)
            continue
        assert set(after.doc_id) == want and len(after) == len(want), name
        before = after


def test_run_and_edges(spark, tmp_path):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "taken"} <= set(out.columns) and out.count() > 0
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
