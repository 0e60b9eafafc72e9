"""Tool results compressed as they arrive: a micro-batch goes through the block pipeline once, originals to the store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucerna.functions.text import token_estimate
from lucerna.plans.options import Options
from lucerna.plans.pipeline import compress_blocks
from lucerna.sources.store import Store, entries_of


def compress_results(results: DataFrame, options: Options = Options()) -> DataFrame:
    """Results (title, output) with the new output; short ones and those that wouldn't shrink pass."""
    if not (options.enabled and options.real_time):
        return results
    rows = results.withColumn("__id", F.monotonically_increasing_id())
    worth = rows.filter(token_estimate(F.col("output")) >= options.min_tokens_to_compress)
    done = compress_blocks(worth.select("__id", "output"), options, id_col="__id", text_col="output")
    return rows.join(done.select("__id", "compressed"), "__id", "left").withColumn("original", F.col("output")).withColumn("output", F.coalesce("compressed", "output")).drop("__id")


def start(results: DataFrame, out_path: str, checkpoint: str, store: Store | None = None, options: Options = Options()):
    """A query that appends compressed results to out_path; a batch that is run again writes the same folder."""

    def batch(df: DataFrame, epoch: int) -> None:
        df.persist()
        done = compress_results(df, options)
        done.select("title", "output").write.mode("overwrite").parquet(f"{out_path}/batch={epoch}")
        if store is not None and "compressed" in done.columns:
            store.put(entries_of(done.select("compressed", F.col("original").alias("text"))))
        df.unpersist()

    return results.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
