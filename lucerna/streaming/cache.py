"""Keyed state with expiry: the skip tier and the result tier as a streaming operator, and running statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lucerna.functions.text import content_key

TTL_MS = 1_800_000
OUTPUT = "hash string, seq long, action string, outcome string, compressed string, strategy string, ratio double"
STATE = "compressed string, strategy string, ratio double, result_ms long, skip_ms long"


def cache_step(ttl_ms: int = TTL_MS, expire: bool = True) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """Per content key: a compressed result and a skip mark, each with its time.

    Rows (hash, seq, action, compressed, strategy, ratio, at_ms) have the actions put, skip, move and get; a get answers
    hit, skip_hit, miss or evicted. An entry is dead ttl_ms after its time, by the rows' own clock; the state of a key
    that nobody asks for goes after as long by the cluster's clock.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        compressed, strategy, ratio, made, skipped = state.get if state.exists else (None,) * 5
        out = []
        for r in pd.concat(list(frames)).sort_values("seq").itertuples():
            answer: tuple = (None, None, None, None)
            if r.action == "put":
                compressed, strategy, ratio, made = r.compressed, r.strategy, float(r.ratio), int(r.at_ms)
            elif r.action in ("skip", "move"):
                skipped = int(r.at_ms)
                made = None if r.action == "move" else made
            elif skipped is not None and r.at_ms - skipped < ttl_ms:
                answer = ("skip_hit", None, None, None)
            else:
                dead = skipped is not None or made is not None and r.at_ms - made >= ttl_ms
                skipped = None
                if made is not None and r.at_ms - made < ttl_ms:
                    answer = ("hit", compressed, strategy, ratio)
                else:
                    made, answer = None, ("evicted" if dead else "miss", None, None, None)
            out.append((key[0], r.seq, r.action, *answer))
        state.update((compressed, strategy, ratio, made, skipped))
        if expire:
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame(out, columns=["hash", "seq", "action", "outcome", "compressed", "strategy", "ratio"])

    return run


def cache_operations(operations: DataFrame, ttl_ms: int = TTL_MS, expire: bool = True) -> DataFrame:
    """Answers to a stream of operations (text or hash, seq, action, compressed, strategy, ratio, at_ms).

    Without expire the state of idle keys stays, and a run over what is there now comes to an end.
    """
    keyed = operations if "hash" in operations.columns else operations.withColumn("hash", content_key(F.col("text"))).drop("text")
    return keyed.groupBy("hash").applyInPandasWithState(cache_step(ttl_ms, expire), OUTPUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if expire else GroupStateTimeout.NoTimeout)


def counters(answers: DataFrame) -> DataFrame:
    """Hits, skip hits, misses and evictions of answered gets."""
    n = lambda *names: F.sum(F.col("outcome").isin(*names).cast("long"))
    return answers.filter("action = 'get'").agg(n("hit").alias("cache_hits"), n("skip_hit").alias("cache_skip_hits"), n("miss", "evicted").alias("cache_misses"), n("evicted").alias("cache_evictions"))


def running_stats(calls: DataFrame) -> DataFrame:
    """Running totals by session of a stream of calls (session, tokens_consumed, tokens_saved)."""
    return calls.groupBy("session").agg(F.count("*").alias("messages_processed"), F.sum("tokens_consumed").alias("tokens_consumed"), F.sum("tokens_saved").alias("tokens_saved"))


def event_windows(events: DataFrame, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Counts and sums of events (ts, event_type, value) in tumbling windows, late rows within the watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")
