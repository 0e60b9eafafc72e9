"""Prose: words kept by a scorer, chunk by chunk. Without a scorer prose passes through unchanged."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucerna.functions.text import content_key
from lucerna.operators.mixed import _SPACE

LEAST_WORDS, CHUNK_WORDS, KEEP_SCORE, NOTE_RATIO = 10, 350, 0.5, 0.8
_GAP = re.compile(f"[{_SPACE}]+")
#: Makes the function that scores the words of a chunk; called once a worker.
ScorerFactory = Callable[[], Callable[[list[str]], list[float]]]


def keep_words(words: list[str], score: Callable[[list[str]], list[float]], target_ratio: float | None = None, chunk_words: int = CHUNK_WORDS) -> list[int]:
    """Places of the kept words: above KEEP_SCORE, or the best share of each chunk (at least one)."""
    kept: list[int] = []
    for start in range(0, len(words), chunk_words):
        scores = score(words[start : start + chunk_words])
        if target_ratio is None:
            kept += [start + i for i, s in enumerate(scores) if s > KEEP_SCORE]
        else:
            best = sorted(range(len(scores)), key=lambda i: -scores[i])[: max(1, int(len(scores) * target_ratio))]
            kept += [start + i for i in best]
    return sorted(kept)


def compress_prose(blocks: DataFrame, scorer: ScorerFactory | None = None, store: bool = False, target_ratio: float | None = None, chunk_words: int = CHUNK_WORDS, id_col: str = "block_id", text_col: str = "text") -> DataFrame:
    """(block_id, result); result is null where nothing was done: no scorer, under ten words, or no word kept."""
    base = blocks.select(F.col(id_col).alias("block_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if scorer is None:
        return base.select("block_id", F.lit(None).cast("string").alias("result"))

    @F.pandas_udf("struct<text:string,kept:int,n:int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        score = scorer()
        for batch in batches:
            rows = []
            for text in batch:
                words = _GAP.split(text)
                kept = [w for i in keep_words(words, score, target_ratio, chunk_words) if (w := words[i])] if len(words) >= LEAST_WORDS else []
                rows.append((" ".join(kept) if kept else None, len(kept), len(words)))
            yield pd.DataFrame(rows, columns=["text", "kept", "n"])

    done = base.withColumn("r", run("text"))
    note = F.concat(F.lit("\n["), F.col("r.n").cast("string"), F.lit(" items compressed to "), F.col("r.kept").cast("string"), F.lit(". Retrieve more: hash="), content_key(F.col("text")), F.lit("]"))
    noted = F.when(F.lit(store) & (F.col("r.kept") / F.col("r.n") < NOTE_RATIO), F.concat(F.col("r.text"), note)).otherwise(F.col("r.text"))
    shrunk = (F.col("r.kept") < F.col("r.n")) & (F.length(noted) < F.length("text"))
    return done.select("block_id", F.when(shrunk, noted).alias("result"))
