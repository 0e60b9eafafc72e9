"""Properties that hold for any block: results never grow, kept lines come from the input in order, keys are stable."""

import json
import pathlib
import random

from pyspark.sql import functions as F

from lucerna.functions.text import content_key
from lucerna.operators.crush import crush_arrays
from lucerna.operators.diffs import compress_diffs
from lucerna.operators.logs import compress_logs
from lucerna.operators.mixed import sections_of
from lucerna.operators.search import compress_search


def random_blocks(seed, lines, n=60):
    rng = random.Random(seed)
    return ["\n".join(rng.choice(lines)(rng) for _ in range(rng.randrange(0, 150))) for _ in range(n)]


LOG = [lambda r: f"INFO step {r.randrange(9)}", lambda r: "", lambda r: f"ERROR code={r.randrange(99)}", lambda r: f"WARN: /a/b{r.randrange(3)}/ 0x{r.randrange(99):x}", lambda r: "Traceback (most recent call last):", lambda r: "==== 3 passed", lambda r: "é" * r.randrange(30)]
GREP = [lambda r: f"src/f{r.randrange(30)}.ts:{r.randrange(500)}:some content {'error' if r.random() < 0.1 else 'x'}", lambda r: f"src/f{r.randrange(9)}.ts-{r.randrange(500)}-context", lambda r: f"{r.randrange(5)}:1:numeric name", lambda r: "no result"]
DIFF = [lambda r: f"diff --git a/{r.randrange(30)} b/x", lambda r: f"@@ -{r.randrange(9)},7 +1,8 @@", lambda r: "+new line", lambda r: "-old line", lambda r: " context that is long enough to be worth dropping", lambda r: " [... odd ] line", lambda r: ""]


def run(spark, compress, texts):
    df = spark.createDataFrame([*enumerate(texts), (len(texts), None)], "block_id long, text string")
    got = {r.block_id: r.result for r in compress(df).collect()}
    assert len(got) == len(texts) + 1 and got[len(texts)] == ""
    return [got[i] for i in range(len(texts))]


def subsequence(small, large):
    rest = iter(large)
    return all(any(x == y for y in rest) for x in small)


def test_logs(spark):
    texts = random_blocks(1, LOG)
    for t, r in zip(texts, run(spark, compress_logs, texts)):
        assert len(r) <= len(t)
        if r != t:
            assert subsequence([x for x in r.split("\n") if not (x.startswith("[") and "lines omitted" in x)], t.split("\n"))


def test_search(spark):
    texts = random_blocks(2, GREP)
    for t, r in zip(texts, run(spark, compress_search, texts)):
        assert len(r) <= len(t) and (r == t or {x for x in r.split("\n") if not x.startswith("[... ")} <= set(t.split("\n")))


def test_diffs(spark):
    texts = random_blocks(3, DIFF)
    for t, r in zip(texts, run(spark, compress_diffs, texts)):
        assert len(r) <= len(t) and (r == t or {x for x in r.split("\n") if not x.startswith("[... ")} <= set(t.split("\n")))


def test_crush(spark):
    rng = random.Random(4)
    texts = [json.dumps([{"id": i, "kind": rng.choice("ab"), **({"rare": 1} if rng.random() < 0.03 else {})} if rng.random() < 0.95 else rng.choice([1, "s", None, [1]]) for i in range(rng.randrange(0, 120))]) for _ in range(60)]
    for t, r in zip(texts, run(spark, crush_arrays, texts)):
        items = [json.dumps(x, sort_keys=True) for x in json.loads(t)]
        kept = [json.dumps(x, sort_keys=True) for x in json.loads(r.split("\n// [")[0])]
        assert set(kept) <= set(items) and (r == t or len(kept) == len(set(kept)))
        if r != t:
            assert {x for x in items if '"rare"' in x and sum('"rare"' in y for y in items) < 0.2 * len(items)} <= set(kept)


def test_sections_cover_the_lines():
    for t in random_blocks(5, [*LOG, *GREP, lambda r: "```", lambda r: '{"a": [1,', lambda r: "2]}"], 200):
        found = sections_of(t)
        assert all(a[3] < b[2] for a, b in zip(found, found[1:]))
        lines = t.split("\n")
        for content, kind, start, end in found:
            if kind != "source_code":
                assert content == "\n".join(lines[start : end + 1])


def test_keys_are_stable(spark):
    df = spark.createDataFrame([("a",), ("a",), ("é😀",), ("",)], "t string").select(content_key(F.col("t")).alias("k"))
    keys = [r.k for r in df.collect()]
    assert keys[0] == keys[1] and len(set(keys)) == 3 and all(len(k) == 24 for k in keys)


def test_the_core_stands_alone():
    root = pathlib.Path(__file__).resolve().parents[1] / "lucerna"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "lucerna.llm" not in p.read_text(), p
