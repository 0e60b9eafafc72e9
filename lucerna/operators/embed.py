"""Vectors and exact token counts from models that the caller brings; both fall back where there is none."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucerna.functions.text import token_estimate

DIMENSIONS = 384


def embed(df: DataFrame, model: Callable[[], Callable[[list[str]], list[list[float]]]] | None = None, text_col: str = "text", out_col: str = "embedding", dimensions: int = DIMENSIONS) -> DataFrame:
    """df with a unit vector for each text. model makes, once a worker, what turns a list of texts into vectors.

    Each distinct text is embedded once. Without a model, and for null texts, the vector is zero.
    """
    zero = F.array_repeat(F.lit(0.0).cast("float"), dimensions)
    if model is None:
        return df.withColumn(out_col, zero)

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vectors = model()
        for batch in batches:
            yield pd.Series([list(map(float, v)) for v in vectors(batch.tolist())], dtype="object")

    once = df.select(F.col(text_col).alias("__text")).filter("__text is not null").distinct().withColumn("__raw", run("__text"))
    norm = F.sqrt(F.aggregate("__raw", F.lit(0.0), lambda a, x: a + x * x))
    unit = F.transform("__raw", lambda x: F.coalesce(F.try_divide(x, norm), F.lit(0.0)).cast("float"))
    once = once.select("__text", unit.alias(out_col))
    return df.join(once, F.col(text_col) == F.col("__text"), "left").drop("__text").withColumn(out_col, F.coalesce(out_col, zero))


def token_count(text: Column, tokenizer: Callable[[], Callable[[str], int]] | None = None) -> Column:
    """Tokens of a text by a tokenizer, made once a worker; without one, and where it fails, the estimate."""
    if tokenizer is None:
        return token_estimate(text)

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = tokenizer()

        def safe(t: str | None) -> int | None:
            try:
                return None if t is None else count(t)
            except Exception:  # any failure of the tokenizer means the estimate
                return None

        for batch in batches:
            yield pd.Series([safe(t) for t in batch], dtype="Int64")

    return F.coalesce(run(text), token_estimate(text))
