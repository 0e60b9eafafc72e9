"""The training-corpus pipeline: five stages over documents, each written as Parquet and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucerna.llm.common import load, workspace
from lucerna.llm.decontaminate import drop_contaminated
from lucerna.llm.exact_dedup import drop_exact_duplicates
from lucerna.llm.minhash import drop_near_duplicates
from lucerna.llm.mixing import mix
from lucerna.llm.toxicity import drop_toxic, fit

#: Near duplicates share this percentage of their five-word shingles; 36 bands miss such a pair with probability 6e-7.
NEAR_PERCENT, NEAR_BANDS = 80, 36


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, fit(docs, load(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs, percent=NEAR_PERCENT, bands=NEAR_BANDS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, load(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the words taken of each."""
    return mix(docs, F.array("source")).drop("pattern").filter("taken > 0")


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing)]
#: The classifier's scores are beyond SQL; the tests hold the stages against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        path = workspace(spark, f"pipeline-{name}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
