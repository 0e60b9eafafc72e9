"""JSON arrays: a representative subset of the items, structural outliers kept, rendered back as JSON."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lucerna.functions.jsontext import json_items
from lucerna.functions.text import content_key, marker, token_estimate
from lucerna.operators.kneedle import optimal_k
from lucerna.operators.outliers import structural_outliers
from lucerna.operators.relevance import hybrid
from lucerna.sources.staging import staged


@dataclass(frozen=True)
class CrushOptions:
    min_items_to_analyze: int = 10
    max_items: int = 30
    first_fraction: float = 0.3
    last_fraction: float = 0.15


def even_sample(at: Column, n: Column, budget: Column) -> Column:
    """Whether place at (from 0) of n is taken when every floor(n / budget)-th is, up to budget."""
    step = F.greatest(F.lit(1), F.floor(n / F.greatest(budget, F.lit(1))).cast("int"))
    return (budget > 0) & (at % step == 0) & (F.floor(at / step) < budget)


def choose_items(items: DataFrame, options: CrushOptions = CrushOptions(), context: Column | None = None) -> DataFrame:
    """Items (block_id, item_idx, json, outlier, k) with ord, the place in the output; null for items that go.

    Of the k items that aren't outliers the first and last ones are pinned and the middle is sampled evenly, or taken
    by relevance to a context first. Outliers follow. Equal texts stay once, at their first place.
    """
    o = options
    own = Window.partitionBy("block_id", "outlier")
    rows = items.withColumn("at", F.row_number().over(own.orderBy("item_idx")) - 1).withColumn("m", F.count("*").over(own))
    first = F.ceil(F.col("k") * o.first_fraction).cast("int")
    last = F.ceil(F.col("k") * o.last_fraction).cast("int")
    rows = rows.withColumn("first", first).withColumn("last", last).withColumn("budget", F.col("k") - first - last)
    place = F.when(F.col("outlier"), 3).when(F.col("at") < F.col("first"), 0).when(F.col("at") >= F.col("m") - F.col("last"), 2).otherwise(1)
    rows = rows.withColumn("part", place)
    middle = Window.partitionBy("block_id", "part")
    rows = rows.withColumn("mid", F.row_number().over(middle.orderBy("item_idx")) - 1).withColumn("mids", F.count("*").over(middle))
    if context is None:
        take, order = even_sample(F.col("mid"), F.col("mids"), F.col("budget")), F.col("mid")
    else:
        rows = rows.withColumn("score", hybrid(F.col("json"), context))
        rows = rows.withColumn("hit", F.col("score") > 0)
        scored = Window.partitionBy("block_id", "part", "hit")
        rows = rows.withColumn("by_score", F.row_number().over(scored.orderBy(F.col("score").desc(), "item_idx")) - 1).withColumn("in_order", F.row_number().over(scored.orderBy("item_idx")) - 1)
        hits = F.sum(F.col("hit").cast("int")).over(middle)
        rows = rows.withColumn("hits", hits)
        rest = F.greatest(F.col("budget") - F.col("hits"), F.lit(0))
        take = F.when(F.col("hit"), F.col("by_score") < F.col("budget")).otherwise(even_sample(F.col("in_order"), F.col("mids") - F.col("hits"), rest))
        order = F.when(F.col("hit"), F.col("by_score")).otherwise(F.col("hits") + F.col("in_order"))
    kept = rows.filter((F.col("part") != 1) | take).withColumn("key", F.struct("part", F.when(F.col("part") == 1, order).otherwise(F.col("at")).cast("int").alias("n")))
    return kept.withColumn("twin", F.row_number().over(Window.partitionBy("block_id", "json").orderBy("key"))).filter("twin = 1").drop("twin", "mid", "mids", "first", "last", "budget", "at", "m")


def crush_arrays(blocks: DataFrame, options: CrushOptions = CrushOptions(), store: bool = False, id_col: str = "block_id", text_col: str = "text", context_col: str | None = None) -> DataFrame:
    """(block_id, result): a subset of each JSON array as indented JSON with a footer of what was left out.

    Texts that aren't JSON arrays, short arrays, and arrays that wouldn't take fewer tokens keep their text.
    """
    context = F.col(context_col) if context_col else F.lit(None).cast("string")
    base = blocks.select(F.col(id_col).alias("block_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), context.alias("context"))
    parsed = base.withColumn("items", json_items(F.col("text"))).filter(F.size("items") >= options.min_items_to_analyze)
    # parsed once: sizes, fields and items read what was written, each its own columns
    parsed = staged(parsed.select("block_id", "context", "items"), "items")
    sizes = parsed.select("block_id", F.size("items").alias("items"))
    items = parsed.select("block_id", "context", F.posexplode("items").alias("item_idx", "item"))
    fields = items.filter("item.is_object").select("block_id", "item_idx", F.explode("item.fields").alias("f")).select("block_id", "item_idx", "f.key", "f.value")
    odd = structural_outliers(fields, sizes).withColumn("outlier", F.lit(True))
    flagged = items.join(odd, ["block_id", "item_idx"], "left").select("block_id", "context", "item_idx", "item.json", "item.pretty", F.coalesce("outlier", F.lit(False)).alias("outlier"))
    plain = F.sort_array(F.collect_list(F.when(~F.col("outlier"), F.struct("item_idx", "json"))))
    ks = flagged.groupBy("block_id").agg(F.transform(plain, lambda x: x["json"]).alias("plain"), F.sum(F.col("outlier").cast("int")).alias("outliers"))
    ks = ks.select("block_id", "outliers", optimal_k(F.col("plain"), 1.0, 1, options.max_items).alias("k"))
    chosen = choose_items(flagged.join(ks, "block_id"), options, F.col("context") if context_col else None)
    joined = chosen.groupBy("block_id").agg(F.first("outliers").alias("outliers"), F.count("*").alias("kept"), F.sort_array(F.collect_list(F.struct("key", "pretty"))).alias("rows"))
    done = joined.join(sizes, "block_id").join(base.select("block_id", "text"), "block_id")
    body = F.concat(F.lit("[\n  "), F.array_join(F.transform("rows", lambda r: r["pretty"]), ",\n  "), F.lit("\n]"))
    note = F.when(F.col("outliers") > 0, F.concat(F.lit(" [K non-outlier items] + ["), F.col("outliers").cast("string"), F.lit(" structural outliers preserved]"))).otherwise("")
    tail = F.concat(F.lit(" — retrieve with "), marker(content_key(F.col("text")))) if store else F.lit("")
    dropped = F.col("items") - F.col("kept")
    result = F.when(dropped > 0, F.concat(body, F.lit("\n// ["), dropped.cast("string"), F.lit(" items omitted"), note, tail, F.lit("]"))).otherwise(body)
    done = done.select("block_id", result.alias("result"))
    fewer = F.col("result").isNotNull() & (token_estimate(F.col("result")) < token_estimate(F.col("text")))
    return base.join(done, "block_id", "left").select("block_id", F.when(fewer, F.col("result")).otherwise(F.col("text")).alias("result"))
