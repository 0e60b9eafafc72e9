"""The pipelines: dispatch by content type, whole blocks with mixed content, message parts, session statistics.

Equal texts are compressed once: blocks are reduced to one row a content key before anything is exploded, and results
join back on the key. Each branch filters its content type first, so a block meets one compressor.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lucerna.functions.text import content_key, savings_percent, token_estimate, utf16_length
from lucerna.operators.crush import crush_arrays
from lucerna.operators.detect import detect
from lucerna.operators.diffs import compress_diffs
from lucerna.operators.logs import compress_logs
from lucerna.operators.mixed import explode_sections, is_mixed
from lucerna.operators.prose import ScorerFactory, compress_prose
from lucerna.operators.search import compress_search
from lucerna.plans.options import Options
from lucerna.sources.staging import release, staged

STRATEGIES = {"json_array": "smart_crusher", "prose": "kompress", "search": "search_compressor", "build": "log_compressor", "diff": "diff_compressor"}
PASS = "passthrough"


def dispatch(typed: DataFrame, options: Options = Options(), scorer: ScorerFactory | None = None, size: Callable[[Column], Column] = utf16_length) -> DataFrame:
    """(block_id, result, strategy) of blocks (block_id, text, content_type); both null where the compressor is off.

    size: by what lines, hits and hunks must get less, or the result is the text. Arrays go by tokens.
    """
    o, on = options, options.compressors
    of = lambda kind: typed.filter(F.col("content_type") == kind).select("block_id", "text")
    named = lambda df, kind: df.select("block_id", "result", F.lit(STRATEGIES[kind]).alias("strategy"))
    off = lambda kind: of(kind).select("block_id", F.lit(None).cast("string").alias("result"), F.lit(None).cast("string").alias("strategy"))
    others = typed.filter(~F.col("content_type").isin(*STRATEGIES)).select("block_id", F.col("text").alias("result"), F.lit(PASS).alias("strategy"))
    branches = [
        named(crush_arrays(of("json_array"), o.crush, o.store), "json_array") if on.smart_crusher else off("json_array"),
        named(compress_search(of("search"), o.search, o.store, size=size), "search") if on.search else off("search"),
        named(compress_logs(of("build"), o.log, o.store, size=size), "build") if on.log else off("build"),
        named(compress_diffs(of("diff"), o.diff, o.store, size=size), "diff") if on.diff else off("diff"),
    ]
    if not on.kompress:
        branches.append(off("prose"))
    elif scorer is None:
        branches.append(of("prose").select("block_id", F.col("text").alias("result"), F.lit(PASS).alias("strategy")))
    else:
        prose = of("prose").join(compress_prose(of("prose"), scorer, o.store), "block_id")
        shorter = F.col("result").isNotNull() if size is utf16_length else size(F.col("result")) < size(F.col("text"))
        branches.append(prose.select("block_id", F.when(shorter, F.col("result")).otherwise(F.col("text")).alias("result"), F.when(shorter, F.lit("kompress")).otherwise(PASS).alias("strategy")))
    for b in branches:
        others = others.unionByName(b)
    return others


def _typed(blocks: DataFrame) -> DataFrame:
    return detect(blocks).withColumn("content_type", F.col("detection.content_type")).drop("detection")


def compress_blocks(blocks: DataFrame, options: Options = Options(), scorer: ScorerFactory | None = None, skip: DataFrame | None = None, cached: DataFrame | None = None, id_col: str = "block_id", text_col: str = "text") -> DataFrame:
    """(block_id, compressed, tokens_before, tokens_after, strategies) of every block; compressed is null where nothing was done.

    Mixed blocks are split, their sections compressed apart, and joined again if that is shorter. skip: (hash) known
    not to shrink; cached: (hash, compressed, strategy) known results. Null and empty texts do nothing.
    """
    rows = blocks.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), content_key(F.coalesce(F.col(text_col), F.lit(""))).alias("block_id"))
    once = rows.filter("text <> ''").dropDuplicates(["block_id"]).select("block_id", "text")
    known = None
    if skip is not None:
        once = once.join(skip.select(F.col("hash").alias("block_id")), "block_id", "left_anti")
    if cached is not None:
        hits = cached.select(F.col("hash").alias("block_id"), F.col("compressed").alias("result"), F.array("strategy").alias("strategies"))
        known = once.join(hits, "block_id").select("block_id", "text", "result", "strategies")
        once = once.join(hits, "block_id", "left_anti")

    once = staged(_typed(once).withColumn("mixed", is_mixed(F.col("text"))), "blocks", by="content_type")
    mixed = once.filter("mixed").select("block_id", "text")
    sections = explode_sections(mixed).withColumn("sid", F.concat_ws(":", "block_id", F.col("section_no").cast("string")))
    sections = staged(sections, "sections", by="content_type")
    plain = F.col("content_type").isin("text", "source_code")
    done = dispatch(sections.filter(~plain).select(F.col("sid").alias("block_id"), F.col("content").alias("text"), "content_type"), options, scorer).withColumnRenamed("block_id", "sid")
    parts = sections.join(done, "sid", "left").withColumn("part", F.coalesce("result", "content"))
    whole = parts.groupBy("block_id").agg(F.sum(utf16_length(F.col("part"))).alias("units"), F.sort_array(F.collect_list(F.struct("section_no", "part", "strategy"))).alias("parts"))
    joined = F.array_join(F.transform("parts", lambda p: p["part"]), "\n")
    names = F.concat(F.array(F.lit("mixed")), F.array_compact(F.transform("parts", lambda p: p["strategy"])))
    whole = mixed.join(whole, "block_id").filter(F.col("units") < utf16_length(F.col("text"))).select("block_id", "text", joined.alias("result"), names.alias("strategies"))

    single = once.filter("not mixed and content_type <> 'text'")
    one = single.select("block_id", "text").join(dispatch(single.select("block_id", "text", "content_type"), options, scorer), "block_id")
    fewer = (F.col("result") != F.col("text")) & (token_estimate(F.col("result")) < token_estimate(F.col("text")))
    one = one.filter(F.col("result").isNotNull() & fewer).select("block_id", "text", "result", F.array("strategy").alias("strategies"))
    found = whole.unionByName(one)
    if known is not None:
        found = found.unionByName(known)
    out = rows.join(found.drop("text"), "block_id", "left")
    return out.select(F.col("id").alias(id_col), F.col("result").alias("compressed"), token_estimate(F.coalesce("text", F.lit(""))).alias("tokens_before"), F.when(F.col("result").isNotNull(), token_estimate(F.col("result"))).alias("tokens_after"), "strategies")


def _settled(content_type: Column, options: Options, scorer: ScorerFactory | None) -> Column:
    """The strategy of blocks that no compressor takes, null for the others: it is known from the type alone."""
    on = options.compressors
    off = [kind for kind, used in (("json_array", on.smart_crusher), ("search", on.search), ("build", on.log), ("diff", on.diff), ("prose", on.kompress)) if not used]
    taken = [kind for kind in STRATEGIES if kind not in off and (kind != "prose" or scorer is not None)]
    return F.when(content_type.isin(off), "passthrough_disabled").when(~content_type.isin(taken), "passthrough_revert")


def compress_parts(parts: DataFrame, options: Options = Options(), scorer: ScorerFactory | None = None, skip: DataFrame | None = None, cached: DataFrame | None = None, id_col: str = "part_id", text_col: str = "text") -> DataFrame:
    """(part_id, text, strategy, tokens_before, tokens_after, did_compress): each part through the gate, then one compressor; never split.

    The parts are written once, by content type; what no compressor takes is read from there and its text never moves.
    Of the others each text moves once, to files dealt by its key, and once more as its result.
    """
    spark = parts.sparkSession
    rows = parts.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("block_id", content_key(F.col("text"))).withColumn("tokens", token_estimate(F.col("text")))
    state = F.when(F.col("tokens") < options.min_tokens_to_compress, "passthrough_small")
    found = F.lit(None).cast("string")
    if skip is not None:
        rows = rows.join(skip.select(F.col("hash").alias("block_id"), F.lit(True).alias("skipped")).distinct(), "block_id", "left")
        state = state.when(F.col("skipped"), "passthrough_skip_cache")
    if cached is not None:
        rows = rows.join(cached.select(F.col("hash").alias("block_id"), F.lit(True).alias("hit"), F.col("compressed").alias("known"), F.col("strategy").alias("known_as")), "block_id", "left")
        state, found = state.when(F.col("hit"), F.coalesce("known_as", F.lit("passthrough_error"))), F.col("known")
    rows = rows.select("id", "text", "block_id", "tokens", state.alias("state"), found.alias("known"))
    # a part that is settled already is judged as an empty one, which is cheap
    rows = detect(rows.withColumn("judged", F.when(F.col("state").isNull(), F.col("text"))), "judged")
    rows = rows.withColumn("state", F.coalesce("state", _settled(F.col("detection.content_type"), options, scorer)))
    rows = rows.withColumn("content_type", F.when(F.col("state").isNull(), F.col("detection.content_type")).otherwise("settled"))
    rows = staged(rows.select("id", "text", "block_id", "tokens", "state", "known", "content_type"), "parts", by="content_type")
    release(spark)

    still = F.col("state").startswith("passthrough_")
    settled = rows.filter("content_type = 'settled'").select("id", "tokens", F.col("state").alias("strategy"), F.when(still, F.col("text")).otherwise(F.col("known")).alias("text"))
    rest = rows.filter("content_type <> 'settled'")
    # dealt by key, so that the lines of a block are grouped, ordered and joined where it is read
    typed = staged(rest.dropDuplicates(["block_id"]).select("block_id", "text", "content_type"), "typed", by="content_type", bucket="block_id")
    release(spark)
    # a result is the text or takes fewer tokens, so the text needn't be joined again
    done = rest.select("id", "block_id", "tokens").join(dispatch(typed, options, scorer, size=token_estimate), "block_id", "left")
    fewer = token_estimate(F.col("result")) < F.col("tokens")
    done = done.select("id", "tokens", F.when(fewer, F.col("strategy")).otherwise("passthrough_revert").alias("strategy"), F.col("result").alias("text"))
    out = settled.unionByName(done)
    did = ~F.col("strategy").startswith("passthrough_")
    # a result that is the text under the plain name counts as reverted above, so did_compress means shorter
    return out.select(F.col("id").alias(id_col), "text", "strategy", F.col("tokens").alias("tokens_before"), F.when(did, token_estimate(F.col("text"))).otherwise(F.col("tokens")).alias("tokens_after"), did.alias("did_compress"))


def live_zone(messages: DataFrame, live_only: bool = True, by: str = "conv_id", order: str = "turn", role: str = "role") -> DataFrame:
    """Messages from the last one of the user on; none of a conversation without one."""
    if not live_only:
        return messages
    last = F.max(F.when(F.col(role) == "user", F.col(order))).over(Window.partitionBy(by))
    return messages.withColumn("__last", last).filter(F.col(order) >= F.col("__last")).drop("__last")


def eligible(part: Column) -> Column:
    """The text of a part that may be compressed: output of a completed tool, or text; null for others."""
    tool = (part["type"] == "tool") & (part["state"]["status"] == "completed")
    text = F.when(tool, part["state"]["output"]).when(part["type"] == "text", part["text"])
    return F.when(text != "", text)


def compress_messages(messages: DataFrame, options: Options = Options(), scorer: ScorerFactory | None = None, skip: DataFrame | None = None, cached: DataFrame | None = None) -> DataFrame:
    """(conv_id, turn, part_no, text, strategy, tokens_before, tokens_after, did_compress) of the eligible parts of live messages (conv_id, turn, role, parts)."""
    live = live_zone(messages, options.live_zone_only)
    parts = live.select("conv_id", "turn", F.posexplode("parts").alias("part_no", "part")).withColumn("text", eligible(F.col("part"))).filter("text is not null").drop("part")
    keyed = parts.withColumn("part_id", F.struct("conv_id", "turn", "part_no"))
    done = compress_parts(keyed.select("part_id", "text"), options, scorer, skip, cached)
    return done.select("part_id.*", "text", "strategy", "tokens_before", "tokens_after", "did_compress")


def totals(done: DataFrame, by: list[str]) -> DataFrame:
    """Tokens consumed and saved, and the strategies that shortened something, by group."""
    saved = F.sum(F.when(F.col("did_compress"), F.col("tokens_before") - F.col("tokens_after")).otherwise(0))
    return done.groupBy(*by).agg(F.sum("tokens_before").alias("tokens_consumed"), saved.alias("tokens_saved"), F.collect_list(F.when(F.col("did_compress"), F.col("strategy"))).alias("strategies"))


def session_stats(calls: DataFrame, by: str = "session") -> DataFrame:
    """(session, messages_processed, tokens_consumed, tokens_saved, savings_pct, compressor_hits) of calls (session, tokens_consumed, tokens_saved, strategies)."""
    sums = calls.groupBy(by).agg(F.count("*").alias("messages_processed"), F.sum("tokens_consumed").alias("tokens_consumed"), F.sum("tokens_saved").alias("tokens_saved"))
    hits = calls.select(by, F.explode("strategies").alias("name")).groupBy(by, "name").agg(F.count("*").alias("n"))
    hits = hits.groupBy(by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "n")))).alias("compressor_hits"))
    out = sums.join(hits, by, "left")
    return out.withColumn("savings_pct", savings_percent(F.col("tokens_consumed"), F.col("tokens_saved"))).withColumn("compressor_hits", F.coalesce("compressor_hits", F.expr("cast(map() as map<string,bigint>)")))
