"""Structural outliers of item tables: rare fields and rare values of status-like fields.

Works on the long form (block_id, item_idx, key, value), a row a field of an item, by grouped counts and joins on the
block and the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Shares of common and rare fields, bounds of distinct values, share and size of the head, least items.
COMMON, RARE, LEAST_VALUES, MOST_VALUES, HEAD_SHARE, MOST_HEAD, LEAST_ITEMS = 0.8, 0.2, 2, 50, 0.8, 5, 5
NONE = "__none__"


def field_presence(fields: DataFrame) -> DataFrame:
    """(block_id, key, n): items that have the field."""
    return fields.groupBy("block_id", "key").agg(F.countDistinct("item_idx").alias("n"))


def field_kinds(fields: DataFrame, sizes: DataFrame) -> DataFrame:
    """(block_id, key, n, is_common, is_rare) against all items; sizes has block_id and items."""
    return field_presence(fields).join(sizes, "block_id").select("block_id", "key", "n", (F.col("n") >= F.col("items") * COMMON).alias("is_common"), (F.col("n") < F.col("items") * RARE).alias("is_rare"))


def value_counts(fields: DataFrame) -> DataFrame:
    """(block_id, key, value, n): frequencies, nulls as a value of their own."""
    return fields.groupBy("block_id", "key", F.coalesce("value", F.lit(NONE)).alias("value")).agg(F.count("*").alias("n"))


def status_fields(fields: DataFrame) -> DataFrame:
    """(block_id, key, total) of fields whose distinct values besides null are few, but two at least."""
    counts = fields.groupBy("block_id", "key").agg(F.countDistinct("value").alias("values"), F.count("*").alias("total"))
    return counts.filter(F.col("values").between(LEAST_VALUES, MOST_VALUES)).select("block_id", "key", "total")


def pareto_head(fields: DataFrame) -> DataFrame:
    """(block_id, key, value): the most frequent values that cover HEAD_SHARE of the items; none where it takes over MOST_HEAD."""
    order = Window.partitionBy("block_id", "key").orderBy(F.col("n").desc(), "value")
    counts = value_counts(fields).join(status_fields(fields), ["block_id", "key"])
    running = counts.withColumn("before", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    head = running.filter(F.col("before") < F.ceil(F.col("total") * HEAD_SHARE))
    sized = head.withColumn("k", F.count("*").over(Window.partitionBy("block_id", "key")))
    return sized.filter(F.col("k") <= MOST_HEAD).select("block_id", "key", "value")


def rare_field_items(fields: DataFrame, kinds: DataFrame) -> DataFrame:
    """(block_id, item_idx) of items with a rare field, once for each."""
    return fields.join(kinds.filter("is_rare").select("block_id", "key"), ["block_id", "key"], "left_semi").select("block_id", "item_idx")


def rare_value_items(fields: DataFrame, kinds: DataFrame) -> DataFrame:
    """(block_id, item_idx) of items whose value of a common status-like field is outside the field's head, once for each."""
    common = fields.join(kinds.filter("is_common").select("block_id", "key"), ["block_id", "key"], "left_semi")
    head = pareto_head(common)
    judged = common.join(head.select("block_id", "key").distinct(), ["block_id", "key"], "left_semi").withColumn("value", F.coalesce("value", F.lit(NONE)))
    return judged.join(head, ["block_id", "key", "value"], "left_anti").select("block_id", "item_idx")


def structural_outliers(fields: DataFrame, sizes: DataFrame) -> DataFrame:
    """(block_id, item_idx) of items with a rare field or a rare value of a common status-like field.

    fields: the long form of the object items; sizes: (block_id, items) counts of all items. Blocks of under five
    items have none.
    """
    fields = fields.join(sizes.filter(F.col("items") >= LEAST_ITEMS).select("block_id"), "block_id", "left_semi")
    kinds = field_kinds(fields, sizes)
    return rare_field_items(fields, kinds).unionByName(rare_value_items(fields, kinds)).distinct()
