"""Exact dedup by content sort, with DataFrame functions alone.

The normalised bytes are range-partitioned by sampled splitters and sorted externally, so equal texts end up
adjacent; a window over the sorted rows compares each text with its neighbour in full and keeps one row.
The splitters hold only a fixed-length head of the text and its 64-bit hash, so what the driver samples is bounded.
Groups so frequent that one task would hold too large a share of the rows are folded by a partial aggregate on
the full text instead; there are at most ``4 * partitions`` of them, so their keepers can be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lucerna.llm.common import WHITE_CLASS, load, shuffle_partitions, stage

HEAD = 32
MIN_HOT = 500


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_CLASS + "+", "")


def _decided(df: DataFrame, id_col: str, text_col: str, partitions: int | None, carry: bool) -> tuple[DataFrame, DataFrame | None]:
    """Rows (id, keep_id, group_size, text_sha256, first, and row if carry) of all but the hot groups, and of those.

    first marks the one row of its group that stays; in hot groups it marks all rows equal to that one in id and length.
    """
    spark = df.sparkSession
    parts = partitions or shuffle_partitions(spark)
    row = [F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")] * carry
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), F.length(text).alias("n"), normalised(F.col(text_col)).alias("norm"), *row)
    rows = rows.select("id", "n", "norm", F.xxhash64("norm").alias("h"), *["row"] * carry)

    counted = stage(rows.groupBy("h").agg(F.count("*").alias("c")), "op4-counts")
    total = counted.agg(F.sum("c")).first()[0] or 0
    hot_at = max(MIN_HOT, total // (4 * parts))
    hot = [r.h for r in counted.filter(F.col("c") > hot_at).select("h").collect()]  # at most total / hot_at <= 4 * parts
    is_hot = F.col("h").isin(hot) if hot else F.lit(False)

    cold = rows.filter(~is_hot) if hot else rows
    if carry:  # the text moves once: what it is normalised to is made anew behind the exchange
        cold = cold.select("id", "n", "row", "h", F.substring("norm", 1, HEAD).alias("head")).repartitionByRange(parts, "head", "h").withColumn("norm", normalised(F.col(f"row.`{text_col}`")))
    else:
        cold = cold.withColumn("head", F.substring("norm", 1, HEAD)).repartitionByRange(parts, "head", "h")
    group = Window.partitionBy("head", "h", "norm")
    order = group.orderBy(F.col("n").desc(), F.col("id").asc_nulls_last())
    found = cold.select(
        "id",
        F.first("id").over(order).alias("keep_id"),
        F.count("*").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("group_size"),
        F.sha2("norm", 256).alias("text_sha256"),
        (F.row_number().over(order) == 1).alias("first"),
        *["row"] * carry,
    )
    if not hot:
        return found, None
    same = rows.filter(is_hot)
    rank = F.struct((-F.col("n")).alias("n"), F.col("id").isNull().alias("none"), F.col("id").alias("id"))
    keepers = same.groupBy("norm").agg(F.min(rank).alias("best"), F.count("*").alias("group_size"))
    keepers = keepers.select(F.sha2("norm", 256).alias("text_sha256"), F.col("best.id").alias("keep_id"), (-F.col("best.n")).alias("most"), "group_size")
    # a few rows of fixed width: at most 4 * parts keys are hot
    joined = same.select("id", "n", F.sha2("norm", 256).alias("text_sha256"), *["row"] * carry).join(F.broadcast(keepers), "text_sha256")
    best = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("n") == F.col("most"))
    return found, joined.withColumn("first", best).drop("n", "most")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """One row per input row: the id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without white space. Of equal texts the row with the most code points
    stays, then the one with the smallest id (null ids last). A null text counts as empty, and empty texts form one
    group. Rows that repeat id and text all count in group_size and share the decision. Other columns are ignored,
    an empty table gives no rows.
    """
    found, hot = _decided(df, id_col, text_col, partitions, False)
    found = found if hot is None else found.unionByName(hot)
    kept = F.coalesce(F.col("id").eqNullSafe(F.col("keep_id")), F.lit(False))
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """df's rows, one of each group of equal texts: the one that exact_dedup keeps, and one alone of repeated rows."""
    found, hot = _decided(df, id_col, text_col, partitions, True)
    kept = found.filter("first").select("row")
    if hot is not None:
        kept = kept.unionByName(hot.filter("first").groupBy("text_sha256").agg(F.first("row").alias("row")).select("row"))
    return kept.select("row.*")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(load(spark, sf_dir, "documents"))


QUERIES = {"op4_exact_dedup": op4_exact_dedup}
ORACLE_SQL = {
    "op4_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), g AS (
  SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
}
