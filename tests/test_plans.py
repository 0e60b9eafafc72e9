"""Pipelines, store, cache and streaming."""

import json

from pyspark.sql import functions as F

from lucerna.operators.mixed import register_split_sections
from lucerna.plans.options import Options, Toggles
from lucerna.plans.pipeline import compress_blocks, compress_messages, compress_parts, live_zone, session_stats, totals
from lucerna.sources.messages import MESSAGES, messages_of, normalize_system, write_log
from lucerna.sources.store import Store, evicted, live, purged, retrieve, upserted
from lucerna.streaming import realtime
from lucerna.streaming.cache import cache_operations, counters, event_windows, running_stats
from tests.test_blocks import make_diff, make_log, make_search

ITEMS = json.dumps([{"id": i, "name": f"item-{i}", "value": i, "desc": f"This is item number {i} with padding text"} for i in range(80)])
PROSE = "This is a sentence. And another one here. " * 40


def test_block_pipeline(spark):
    texts = [ITEMS, make_log(200), make_search(20, 20), make_diff(60), PROSE, "short", "", None, ITEMS]
    df = spark.createDataFrame(list(enumerate(texts)), "block_id long, text string")
    rows = {r.block_id: r for r in compress_blocks(df).collect()}
    assert [rows[i].strategies for i in range(9)] == [["smart_crusher"], ["log_compressor"], ["search_compressor"], ["diff_compressor"], None, None, None, None, ["smart_crusher"]]
    assert all(rows[i].tokens_after < rows[i].tokens_before for i in range(4)) and rows[0].compressed == rows[8].compressed
    off = compress_blocks(df.filter("block_id < 4"), Options(compressors=Toggles.partial(log=True))).collect()
    assert {r.block_id for r in off if r.compressed} == {1}
    mixed = "Intro text.\n" + ITEMS.replace(", {", ",\n{") + "\n" + "\n".join(f"src/a.ts:{i}:export const value{i} = {i}" for i in range(1, 60))
    one = compress_blocks(spark.createDataFrame([(1, mixed)], "block_id long, text string")).first()
    assert one.strategies[0] == "mixed" and "smart_crusher" in one.strategies and one.tokens_after < one.tokens_before


def test_known_blocks(spark):
    from lucerna.functions.text import content_key

    df = spark.createDataFrame([(1, ITEMS), (2, make_log(200))], "block_id long, text string")
    keys = {r.block_id: r.k for r in df.select("block_id", content_key(F.col("text")).alias("k")).collect()}
    skip, cached = spark.createDataFrame([(keys[1],)], "hash string"), spark.createDataFrame([(keys[2], "tiny", "log_compressor")], "hash string, compressed string, strategy string")
    got = {r.block_id: r for r in compress_blocks(df, skip=skip, cached=cached).collect()}
    assert got[1].compressed is None and got[2].compressed == "tiny"
    parts = {r.part_id: r for r in compress_parts(df.withColumnRenamed("block_id", "part_id"), skip=skip, cached=cached).collect()}
    assert parts[1].strategy == "passthrough_skip_cache" and parts[2].text == "tiny" and parts[2].did_compress


def test_part_texts_stay_where_they_are(spark):
    """Behind the written tables no exchange has texts, lines or matches: on large tables those filled the disk."""
    import contextlib
    import io

    texts = [make_log(200), make_search(20, 20), make_diff(60), PROSE, "short", make_log(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "part_id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        done = compress_parts(df)
        with contextlib.redirect_stdout(io.StringIO()) as plan:
            done.explain("formatted")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    nodes = plan.getvalue().split("\n\n")
    moved = [n for n in nodes if "Exchange\nInput" in n]
    assert moved and not [n for n in moved if any(f"{c}#" in n.split("\n")[1] for c in ("text", "content", "raw"))]
    assert [r.strategy for r in done.orderBy("part_id").collect()] == ["log_compressor", "search_compressor", "diff_compressor", "passthrough_revert", "passthrough_small", "log_compressor"]


def test_message_pipeline(spark):
    part = lambda kind, text: (kind, text if kind == "text" else None, ("completed", text) if kind == "tool" else None)
    rows = [(1, 0, "user", [part("text", ITEMS)]), (1, 1, "user", [part("text", "hi")]), (1, 2, "assistant", [part("tool", ITEMS), part("text", PROSE), ("tool", None, ("running", ITEMS))]), (2, 0, "assistant", [part("text", ITEMS)])]
    messages = spark.createDataFrame(rows, MESSAGES)
    done = compress_messages(messages)
    got = {(r.conv_id, r.turn, r.part_no): r for r in done.collect()}
    assert set(got) == {(1, 1, 0), (1, 2, 0), (1, 2, 1)}  # no user message: nothing of conversation 2 is live
    assert [got[k].strategy for k in sorted(got)] == ["passthrough_small", "smart_crusher", "passthrough_revert"]
    assert compress_messages(messages, Options(live_zone_only=False)).count() == 5
    t = totals(done, ["conv_id"]).first()
    assert t.tokens_consumed > t.tokens_saved > 0 and t.strategies == ["smart_crusher"]
    off = compress_messages(messages, Options(compressors=Toggles(smart_crusher=False))).collect()
    assert "passthrough_disabled" in {r.strategy for r in off}
    flat = spark.createDataFrame([(1, 0, "user", "x"), (1, 1, "assistant", "y")], "conv_id long, turn long, role string, text string")
    assert live_zone(flat).count() == 2 and compress_messages(messages_of(flat)).count() == 2


def test_options():
    assert not Options.parse(None).enabled and Options.parse({}).enabled
    o = Options.parse({"min_tokens_to_compress": 50, "compressors": {"log": False}, "compressor_params": {"diff": {"max_files": 2}}})
    assert o.min_tokens_to_compress == 50 and not o.compressors.log and o.compressors.search and o.diff.max_files == 2
    assert not Toggles.partial(log=True).search


def test_stats(spark):
    calls = spark.createDataFrame([("s", 1000, 300, ["a", "b"]), ("s", 500, 100, ["a"]), ("t", 0, 0, [])], "session string, tokens_consumed long, tokens_saved long, strategies array<string>")
    got = {r.session: r for r in session_stats(calls).collect()}
    assert (got["s"].messages_processed, got["s"].tokens_consumed, got["s"].tokens_saved, got["s"].savings_pct) == (2, 1500, 400, 26.67)
    assert got["s"].compressor_hits == {"a": 2, "b": 1} and got["t"].savings_pct == 0 and got["t"].compressor_hits == {}


def test_store(spark, tmp_path):
    entry = lambda *rows: spark.createDataFrame(list(rows), "hash string, payload string, created_at long")
    table = upserted(entry(("a", "old", 1), ("b", "x", 5)), entry(("a", "new", 1), ("c", "", 9)))
    assert {r.hash: r.payload for r in table.collect()} == {"a": "new", "b": "x", "c": ""}
    now = F.lit(305)
    assert {r.hash for r in live(table, now).collect()} == {"c"} and {r.hash for r in purged(table, now).collect()} == {"b", "c"}
    asked = spark.createDataFrame([("b",), ("c",), ("z",)], "hash string")
    got = {r.hash: r for r in retrieve(asked, table, F.lit(100)).collect()}
    assert got["b"].output == "x" and not got["c"].found and "No cached content found for hash z" in got["z"].output
    many = entry(*((f"h{i:03d}", "p", i // 3) for i in range(30)))
    assert evicted(many, 30).count() == 30
    kept = {r.hash for r in evicted(many, 20).collect()}
    assert len(kept) <= 20 and "h029" in kept and "h000" not in kept
    s = Store(spark, str(tmp_path / "store"), capacity=10)
    s.put(entry(*((f"k{i}", f"p{i}", 1000 + i) for i in range(11))), F.lit(1010))
    assert s.size() <= 10
    s.put(entry(("k10", "again", 1020)), F.lit(1020))
    assert s.get(spark.createDataFrame([("k10",)], "hash string"), F.lit(1020)).first().output == "again"
    s.clear()
    assert s.size() == 0


def test_sources(spark, tmp_path):
    r = spark.createDataFrame([(["on 2024-01-02", "x"],)], "system array<string>").select(normalize_system(F.col("system"))).first()[0]
    assert r == ["on <<DATE>>", "x"]
    events = spark.sql("select timestamp'2024-01-02 03:04:05' at, 'hello' message")
    write_log(events, str(tmp_path / "log"))
    assert spark.read.text(str(tmp_path / "log")).first().value.endswith("] hello")
    register_split_sections(spark)
    got = spark.sql("select s.content_type from values ('hello\n```\ncode\n```') as t(x), lateral split_sections(x) s").collect()
    assert [x.content_type for x in got] == ["text", "source_code"]


def test_realtime_stream(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([("a", ITEMS), ("b", "short")], "title string, output string").coalesce(1).write.json(str(source))
    stream = spark.readStream.schema("title string, output string").json(str(source))
    store = Store(spark, str(tmp_path / "store"))
    q = realtime.start(stream, str(tmp_path / "out"), str(tmp_path / "ckpt"), store)
    q.processAllAvailable()
    q.stop()
    got = {r.title: r.output for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert len(got["a"]) < len(ITEMS) and got["b"] == "short" and store.read().first().payload == ITEMS


def test_event_windows_and_running_stats(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    path = str(tmp_path / "ev")
    events.coalesce(1).write.parquet(path)
    q = event_windows(spark.readStream.schema(events.schema).parquet(path)).writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("w").agg(F.sum("n")).first()[0] == events.count()
    calls = str(tmp_path / "calls")
    spark.createDataFrame([("s", 10, 3), ("s", 5, 1)], "session string, tokens_consumed long, tokens_saved long").write.parquet(calls)
    q = running_stats(spark.readStream.schema("session string, tokens_consumed long, tokens_saved long").parquet(calls)).writeStream.format("memory").queryName("r").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert tuple(spark.table("r").first()) == ("s", 2, 15, 4)


def test_cache_stream(spark, tmp_path):
    rows = [("k", 0, "get", None, None, None, 0), ("k", 1, "put", "c", "s", 0.5, 0), ("k", 2, "get", None, None, None, 10), ("k", 3, "move", None, None, None, 20), ("k", 4, "get", None, None, None, 30), ("k", 5, "get", None, None, None, 5000)]
    schema = "hash string, seq long, action string, compressed string, strategy string, ratio double, at_ms long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "ops"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "ops"))
    q = cache_operations(stream, 1000).writeStream.format("memory").queryName("c").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    while not q.status["isDataAvailable"] and q.recentProgress == []:
        q.awaitTermination(1)
    q.awaitTermination(8)
    q.stop()
    got = {r.seq: r.outcome for r in spark.table("c").collect()}
    assert [got[i] for i in (0, 2, 4, 5)] == ["miss", "hit", "skip_hit", "evicted"]
    c = counters(spark.table("c")).first()
    assert (c.cache_hits, c.cache_skip_hits, c.cache_misses, c.cache_evictions) == (1, 1, 2, 1)
