"""Sources and sinks of blocks and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lucerna.functions.text import normalize_prompt

MESSAGES = "conv_id bigint, turn bigint, role string, parts array<struct<type:string,text:string,state:struct<status:string,output:string>>>"


def read_messages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Messages with parts, of a table that has them."""
    return spark.read.format(fmt).schema(MESSAGES).load(path)


def messages_of(flat: DataFrame) -> DataFrame:
    """A flat table (conv_id, turn, role, text) as messages of one text part each."""
    none = F.lit(None).cast("struct<status:string,output:string>")
    return flat.select("conv_id", "turn", "role", F.array(F.struct(F.lit("text").alias("type"), F.col("text"), none.alias("state"))).alias("parts"))


def stream_results(spark: SparkSession, path: str, schema: str = "title string, output string", fmt: str = "json") -> DataFrame:
    """Tool results as they arrive in a folder."""
    return spark.readStream.format(fmt).schema(schema).load(path)


def normalize_system(system: Column) -> Column:
    """An array of prompt texts with volatile tokens replaced."""
    return F.transform(system, normalize_prompt)


def write_log(events: DataFrame, path: str) -> None:
    """Appends events (at timestamp, message) to a text log, a line each."""
    events.select(F.concat(F.lit("["), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit("] "), F.col("message")).alias("value")).write.mode("append").text(path)
