"""Fixtures of the compressors, detectors and scorers, one block each."""

import json

import pytest
from pyspark.sql import functions as F

from lucerna.functions import text as T
from lucerna.functions.jsontext import number_text, render
from lucerna.operators import kneedle as K
from lucerna.operators.crush import CrushOptions, crush_arrays
from lucerna.operators.detect import detect
from lucerna.operators.diffs import DiffOptions, compress_diffs, plain_diffs
from lucerna.operators.logs import LogOptions, compress_logs, explode_lines, parse_log
from lucerna.operators.mixed import is_mixed, sections_of
from lucerna.operators.outliers import structural_outliers
from lucerna.operators.prose import compress_prose
from lucerna.operators.relevance import alpha, bm25, hybrid
from lucerna.operators.search import SearchOptions, compress_search


def blocks(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "block_id long, text string")


def results(df):
    return [r.result for r in df.orderBy("block_id").collect()]


def one(spark, column, text="x"):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("r")).first().r


def test_lengths_keys_and_markers(spark):
    assert one(spark, T.utf16_length, "a😀é") == 4
    assert one(spark, T.token_estimate, "abcde") == 2
    key = one(spark, T.content_key, "abc")
    assert len(key) == 24 and key == "ba7816bf8f01cfea414140de"
    assert one(spark, T.marker_keys, "a <<ccr:1>> b <<ccr:2>> <<ccr:3") == ["1", "2"]


@pytest.mark.parametrize(
    "text, want",
    [
        ("id 550e8400-e29b-41d4-a716-446655440000 ok", "id <<UUID>> ok"),
        ("at 2024-01-02T03:04:05Z.", "at <<TIMESTAMP>>."),
        ("at 2024-01-02T03:04:05.123Z", "at <<TIMESTAMP>>"),
        ("on 2024-01-02, fine", "on <<DATE>>, fine"),
        ("0123456789abcdef0123456789ABCDEF", "<<SESSION_ID>>"),
        ("deadbeef", "deadbeef"),
        ("2024-01-02T03:04", "2024-01-02T03:04"),
    ],
)
def test_normaliser(spark, text, want):
    assert one(spark, T.normalize_prompt, text) == want


def test_sql_functions(spark):
    T.register_functions(spark)
    r = spark.sql("select lucerna_token_estimate('abcde') t, lucerna_content_key('abc') k, lucerna_normalize_prompt('on 2024-01-02') n, lucerna_marker_keys('<<ccr:a>>') m").first()
    assert (r.t, r.k, r.n, r.m) == (2, "ba7816bf8f01cfea414140de", "on <<DATE>>", ["a"])


def test_detection(spark):
    cases = [
        (json.dumps([{"a": 1}, {"a": 2}]), "json_array", 1.0),
        ("[1,2,3,4,5]", "json_array", 0.8),
        ("", "text", 0.0),
        ("Only one sentence here.", "text", 0.5),
        ("This is a line. And one more here. Third it is.", "prose", None),
        ("diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,2 +1,2 @@\n-a\n+b\n c", "diff", None),
        ("<!DOCTYPE html><html><head></head><body></body></html>", "html", None),
        ("src/a.ts:1:x\nsrc/b.ts:2:y\nsrc/c.ts:3:z", "search", 1.0),
        ("2024-01-01 10:00:00 ERROR boom\n2024-01-01 10:00:01 INFO ok", "build", None),
        ("def f(x):\n    return x\n\nclass A:\n    pass\nimport os\n", "source_code", None),
        ("[1] trailing", "text", 0.5),
        (None, "text", 0.0),
    ]
    got = detect(blocks(spark, *[c[0] for c in cases])).orderBy("block_id").collect()
    for (text, kind, confidence), r in zip(cases, got):
        assert r.detection.content_type == kind, text
        if confidence is not None:
            assert r.detection.confidence == pytest.approx(confidence)


def test_kneedle(spark):
    for text, want in (("", 0xD41D8CD98F00B204), ("a", 0x0CC175B9C0F1B6A8), ("abc", 0x900150983CD24FB0), ("ABC", 0x900150983CD24FB0)):
        assert one(spark, K.simhash, text) & (2**64 - 1) == want == K._fingerprint(text)
    long = "The quick brown fox jumps over"
    assert one(spark, K.simhash, long) & (2**64 - 1) == K._fingerprint(long)
    arr = lambda items: spark.createDataFrame([(items,)], "a array<string>")
    assert arr(["hello world"]).select(K.bigram_curve(F.col("a"))).first()[0] == [1]
    assert arr(["a b c", "a b", "x", ""]).select(K.bigram_curve(F.col("a"))).first()[0] == [2, 2, 3, 4]
    knee = lambda y: spark.createDataFrame([(y,)], "y array<int>").select(K.knee(F.col("y"))).first()[0]
    assert knee([1, 2]) is None and knee([5, 5, 5, 5]) == 1 and knee(list(range(10))) is None and knee([10, 15, 17, 18, 18, 19, 19, 19, 19, 20]) <= 5
    assert spark.createDataFrame([([0, 0, 1, 255, 0],)], "p array<bigint>").select(K.cluster_count(F.col("p"))).first()[0] == 2
    assert K.optimal_k_of(list("abcdef")) == 6
    assert K.optimal_k_of(["same"] * 50) < 10
    diverse = [f"item {i} of kind {i * 7919 % 101} with word{i * 31} and more{i * 17}" for i in range(50)]
    assert K.optimal_k_of(diverse) > 5 and K.optimal_k_of(diverse * 2, most=20) <= 20
    assert arr(diverse).select(K.optimal_k(F.col("a"))).first()[0] == K.optimal_k_of(diverse)


def outliers(spark, items):
    rows = [(0, i, k, None if v is None else str(v)) for i, x in enumerate(items) if isinstance(x, dict) for k, v in x.items()]
    fields = spark.createDataFrame(rows, "block_id long, item_idx int, key string, value string")
    sizes = spark.createDataFrame([(0, len(items))], "block_id long, items int")
    return sorted(r.item_idx for r in structural_outliers(fields, sizes).collect())


def test_outliers(spark):
    base = [{"id": i, "name": f"n{i}"} for i in range(9)]
    assert outliers(spark, [*base, {"id": 9, "name": "x", "extraField": 1}]) == [9]
    assert outliers(spark, [{"id": i, "name": f"n{i}", "active": True} for i in range(20)]) == []
    assert outliers(spark, [{"a": 1}, {"b": 1}, {"c": 1}, {"d": 1}]) == []
    status = [{"status": "ok"}] * 95 + [{"status": s} for s in ("error", "timeout", "error", "timeout", "fail")]
    assert outliers(spark, status) == [95, 96, 97, 98, 99]
    assert outliers(spark, [{"code": f"VAL_{i}"} for i in range(60)]) == []
    assert len(outliers(spark, [{"level": x} for x in ["INFO"] * 60 + ["WARN"] * 25 + [f"ERR_{i}" for i in range(15)]])) == 15
    assert outliers(spark, [{"k": f"CAT_{i}"} for i in range(50)]) == []
    assert outliers(spark, [{"a": 1}] * 4 + ["s", 42]) == []


def test_crush(spark):
    items = [{"id": i, "name": f"item-{i}", "value": 10 * i} for i in range(50)]
    padded = [{"id": i, "name": f"n{i}", "value": i, "padding": "x" * 40} for i in range(100)]
    texts = [json.dumps(items), '[{"id":1},{"id":2}]', "not json", "[]", '{"a":1}', json.dumps(padded)]
    got = results(crush_arrays(blocks(spark, *texts), store=True))
    kept = json.loads(got[0].split("\n// ")[0])
    assert 2 < len(kept) < 50 and kept[0]["id"] == 0 and kept[-1]["id"] == 49
    assert got[1:5] == texts[1:5]
    key = one(spark, T.content_key, texts[5])
    assert got[5].count(f"<<ccr:{key}>>") == 1
    small = results(crush_arrays(blocks(spark, texts[0]), CrushOptions(max_items=5)))[0]
    assert len(json.loads(small.split("\n// ")[0])) <= 5
    needle = [{"id": i, "name": "needle-in-haystack" if i == 25 else f"thing {i}"} for i in range(50)]
    with_context = blocks(spark, json.dumps(needle)).withColumn("context", F.lit("needle haystack"))
    assert "needle-in-haystack" in results(crush_arrays(with_context, context_col="context"))[0]


def test_json_text():
    assert [number_text(x) for x in (1.0, 1e3, 0.1, 1e21, 1e-7, 0.00001, -2.5)] == ["1", "1000", "0.1", "1e+21", "1e-7", "0.00001", "-2.5"]
    assert number_text(1e-6) == "0.000001"
    assert render({"b": 1, "2": [True, None], "1": "x\n"}) == '{"1":"x\\n","2":[true,null],"b":1}'
    assert render([{"a": []}], 2) == '[\n  {\n    "a": []\n  }\n]'


def make_log(count):
    lines = [f"2024-01-01 00:00:{i % 60:02d} INFO Processing item {i}" for i in range(count)]
    lines += ["2024-01-01 00:01:00 ERROR Failed to process", "Traceback (most recent call last):", '  File "x.py", line 3, in f', "ValueError: bad"]
    lines += [f"2024-01-01 00:02:{i:02d} WARN Deprecated API used for item {i}" for i in range(20)]
    return "\n".join([*lines, "2024-01-01 00:03:00 ERROR Last one", "====", "10 passed, 2 failed, 1 skipped"])


def test_logs(spark):
    text = make_log(200)
    got = results(compress_logs(blocks(spark, text, "short"), LogOptions(max_total_lines=30), store=True))
    lines = got[0].split("\n")
    assert len(lines) <= 50 and "lines omitted" in got[0] and got[1] == "short"
    assert any("Failed to process" in x for x in lines) and any("Last one" in x for x in lines)
    warnings = "\n".join([*(f"INFO start {i}" for i in range(30)), *(f"WARN: Connection timeout for user {i}" for i in range(10))])
    assert results(compress_logs(blocks(spark, warnings)))[0].count("WARN: ") == 1
    assert lines[-1].startswith("[") and "3 ERROR, 20 WARN, 200 INFO" in lines[-1]
    kept = [x for x in lines if not x.startswith("[")]
    whole = text.split("\n")
    assert kept == [x for x in whole if x in set(kept)][: len(kept)]


def test_stack_flags_equal_a_walk(spark):
    import random
    import re

    opens, goes_on = re.compile(r"^\s*Traceback \(most recent call last\)"), re.compile(r'^\s+at\s|^\s+File\s+"')
    rng = random.Random(3)
    texts = ["\n".join(rng.choice(["Traceback (most recent call last)", "", "x", '  File "a"', "  at f", " "]) for _ in range(rng.randrange(1, 70))) for _ in range(60)]
    rows = parse_log(explode_lines(blocks(spark, *texts))).orderBy("block_id", "idx").collect()
    got = [r.is_stack for r in rows]
    want = []
    for t in texts:
        lines, on, n = t.split("\n"), False, 0
        for i, line in enumerate(lines):
            if opens.match(line):
                on, n = True, 0
            want.append(on)
            if on:
                n += 1
                following = next((x for x in lines[i + 1 :] if x.strip()), None)
                if n > 20 or not line.strip() and not (following and goes_on.match(following)):
                    on = False
    assert got == want


def make_search(files, each):
    return "\n".join(f"src/file{f}.ts:{m * 10 + 1}:export function func{f}_{m}() {{ return {m}; }}" for f in range(files) for m in range(each))


def test_search(spark):
    texts = [make_search(1, 50), make_search(10, 20), make_search(30, 3), "C:\\Users\\foo\\bar.ts:42:x", "nothing here\nat all"]
    got = results(compress_search(blocks(spark, *texts), SearchOptions(max_matches_per_file=3)))
    assert "[... 47 more matches in src/file0.ts]" in got[0]
    assert got[0].split("\n")[0].startswith("src/file0.ts:1:") and got[0].split("\n")[2].startswith("src/file0.ts:491:")
    assert got[3] == texts[3] and got[4] == texts[4]
    total = results(compress_search(blocks(spark, texts[1]), SearchOptions(max_total_matches=15)))[0]
    assert sum(x.startswith("src/") for x in total.split("\n")) == 15
    few = results(compress_search(blocks(spark, texts[2]), SearchOptions(max_files=5)))[0]
    assert "[... 25 more files with matches omitted]" in few


def make_diff(hunks, name="f"):
    out = [f"diff --git a/{name}.ts b/{name}.ts", "index 1..2 100644", f"--- a/{name}.ts", f"+++ b/{name}.ts"]
    for h in range(hunks):
        out += [f"@@ -{10 * h},7 +{10 * h},8 @@", " c1", " c2", " c3", f"-old {h}", f"+new {h}", " c4", " c5", " c6", " c7", " c8"]
    return "\n".join([*out, "-- ", "2.40.1"])


def test_diffs(spark):
    many = "\n".join(make_diff(1, f"f{i}") for i in range(15))
    wide = make_diff(3).replace(" c", " a rather long line of context that is worth dropping: c")
    texts = [make_diff(15), wide, "tiny\ndiff", many]
    got = results(compress_diffs(blocks(spark, *texts), DiffOptions(max_context_lines=1, max_hunks_per_file=3, max_files=5), store=True))
    assert got[0].count("@@ -") == 3 and "[... 12 hunks omitted — retrieve with <<ccr:" in got[0]
    assert "[... 3 context lines dropped" in got[1]  # two dropped lines are announced as three
    assert got[2] == texts[2]
    assert got[3].count("diff --git") == 5 and "[... 10 files omitted" in got[3]
    combined = "\n".join(["diff --combined x", "@@@ -1,5 -1,5 +1,7 @@@", *[f" ctx {i} with some more text" for i in range(9)], "- import a", "++import b"])
    assert "@@@" in results(compress_diffs(blocks(spark, combined)))[0]
    plain = lambda text, **options: plain_diffs(spark.createDataFrame([(0, text, "")], "block_id int, text string, hint string"), DiffOptions(**options)).first().result
    assert plain("x\n@@ -1 +1 @@\n a\n b\n+c", max_context_lines=1) == "[... 2 context lines dropped]\n@@ -1 +1 @@\n a\n[... 2 context lines dropped]\n+c"
    two = "--- a/x\n+++ b/x\n@@ -1 +1 @@\n-a\n@@ -9 +9 @@\n+b\n c\nindex 0a..1b\n?\n@@ -1 +1 @@\n\n x\n y\n\\ no newline\n z"
    assert plain(two, max_hunks_per_file=1, max_context_lines=2) == "--- a/x\n+++ b/x\n@@ -1 +1 @@\n-a\n[... 3 context lines dropped]\nindex 0a..1b\n[... 2 context lines dropped]\n@@ -1 +1 @@\n\n x\n[... 2 context lines dropped]\n\\ no newline\n z"


def test_mixed(spark):
    fence = "```ts\nconst a = 1\n```\nsrc/a.ts:1:x\nsrc/b.ts:2:y"
    assert [s[1:] for s in sections_of(fence)] == [("source_code", 0, 2), ("search", 3, 4)]
    assert [s[1] for s in sections_of('{"path": "a]b",\n "x": [1]}')] == ["json_array"]
    assert sections_of("  \n ") == []
    assert [s[1] for s in sections_of("hello\n```\ncode\n```\nbye")] == ["text", "source_code", "text"]
    got = blocks(spark, fence, "One. Two. Three", '{"a":1}\nOne. Two. Three. Four. Five. Six. Seven. Eight').select(is_mixed(F.col("text")).alias("m")).collect()
    assert [r.m for r in got] == [True, False, True]


def test_relevance(spark):
    score = lambda item, context, f=bm25: spark.createDataFrame([(item, context)], "i string, c string").select(f(F.col("i"), F.col("c"))).first()[0]
    assert score("", "x") == 0.0 and score("x", "") == 0.0 and score("apple", "zebra") == 0.0
    assert score("name alice here", "alice") == pytest.approx(0.0693, abs=1e-4)
    uuid = "550e8400-e29b-41d4-a716-446655440000"
    assert score(f"id {uuid}", uuid) > 0.3
    assert score("name alice here", "alice", hybrid) == pytest.approx(0.3)
    assert score("alice bob carol", "alice bob carol", hybrid) >= 0.5
    assert one(spark, alpha, uuid) == 0.85 and one(spark, alpha, "order 12345 and 99999") == 0.65 and one(spark, alpha, "plain words") == 0.5


def test_prose(spark):
    text = " ".join(f"word{i}" for i in range(40))
    keep_even = lambda: lambda words: [float(i % 2 == 0) for i in range(len(words))]
    got = results(compress_prose(blocks(spark, text, "too short"), keep_even))
    assert got[0] == " ".join(f"word{i}" for i in range(0, 40, 2)) and got[1] is None
    assert results(compress_prose(blocks(spark, text))) == [None]


def test_embed_and_token_count(spark):
    from lucerna.operators.embed import embed, token_count
    from lucerna.operators.relevance import cosine

    df = spark.createDataFrame([(1, "aab"), (2, "b"), (3, None), (4, "aab")], "id int, text string")
    model = lambda: lambda texts: [[t.count("a"), t.count("b")] for t in texts]
    got = {r.id: list(r.embedding) for r in embed(df, model, dimensions=2).collect()}
    assert got[1] == got[4] == pytest.approx([2 / 5**0.5, 1 / 5**0.5]) and got[2] == [0.0, 1.0] and got[3] == [0.0, 0.0]
    assert len(embed(df).first().embedding) == 384
    v = spark.createDataFrame([([1.0, 0.0], [0.6, 0.8]), ([1.0, 0.0], [-1.0, 0.0]), (None, [1.0])], "a array<float>, b array<float>")
    assert [round(r.c, 6) for r in v.select(cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [0.6, 0.0, 0.5]
    words = lambda: lambda t: len(t.split()) if "!" not in t else 1 // 0
    t = spark.createDataFrame([("a b c d",), ("wow!!!",)], "t string")
    assert [r.n for r in t.select(token_count(F.col("t"), words).alias("n")).collect()] == [4, 2]
    assert [r.n for r in t.select(token_count(F.col("t")).alias("n")).collect()] == [2, 2]
