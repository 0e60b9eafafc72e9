"""The retrieval store: a table (hash, payload, created_at) with expiry and a capacity, in Parquet.

Puts come as tables. A batch is one compaction: the newest row of each hash stays, expired rows go, and when the table
is full the oldest rows go first. Generations are written whole and switched by name, so a lost job leaves the old one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lucerna.functions.text import content_key, marker_keys
from lucerna.sources.staging import staged

CAPACITY, TTL_SECONDS, EVICT_SHARE = 1000, 300, 0.1
#: Ranges of time that a round of the cut counts.
RANGES = 4096
SCHEMA = "hash string, payload string, created_at long"


def entries_of(blocks: DataFrame, compressed_col: str = "compressed", text_col: str = "text", now: Column | None = None) -> DataFrame:
    """Entries for the originals of blocks that were shortened."""
    at = F.unix_timestamp() if now is None else now
    return blocks.filter(F.col(compressed_col).isNotNull()).select(content_key(F.col(text_col)).alias("hash"), F.col(text_col).alias("payload"), at.cast("long").alias("created_at"))


def live(store: DataFrame, now: Column, ttl: int = TTL_SECONDS) -> DataFrame:
    """Readable entries."""
    return store.filter(F.col("created_at") > now - ttl)


def purged(store: DataFrame, now: Column, ttl: int = TTL_SECONDS) -> DataFrame:
    """Entries that a purge leaves; at the very second of expiry one is neither readable nor purged."""
    return store.filter(F.col("created_at") >= now - ttl)


def upserted(store: DataFrame, fresh: DataFrame) -> DataFrame:
    """The newest row of each hash; of rows of one second those of fresh win."""
    both = store.select("hash", "payload", "created_at", F.lit(0).alias("gen")).unionByName(fresh.select("hash", "payload", "created_at", F.lit(1).alias("gen")))
    best = both.groupBy("hash").agg(F.max_by(F.struct("payload", "created_at"), F.struct("created_at", "gen")).alias("e"))
    return best.select("hash", "e.payload", "e.created_at")


def evicted(store: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """At most capacity entries: a full table first loses a tenth of its capacity, the oldest ones.

    The cut is a second, found from counts by ranges of time that narrow: a round brings at most RANGES rows to the
    driver. Entries after the cut stay unsorted; of those of the cut second the first ones by hash stay.
    """
    seconds = staged(store.groupBy("created_at").agg(F.count("*").alias("n")), "store-seconds")
    total, low, high = seconds.agg(F.sum("n"), F.min("created_at"), F.max("created_at")).first()
    if (total or 0) <= capacity:
        return store
    room = capacity - int(-(-capacity * EVICT_SHARE // 1)) + 1
    while low < high:
        width = -(-(high - low + 1) // RANGES)
        at = F.floor((F.col("created_at") - low) / width).cast("long")
        ranges = seconds.filter(F.col("created_at").between(low, high)).groupBy(at.alias("at")).agg(F.sum("n").alias("n")).collect()
        for at, n in sorted(((r["at"], r["n"]) for r in ranges), reverse=True):
            if n >= room:
                low, high = low + at * width, min(high, low + (at + 1) * width - 1)
                break
            room -= n
    columns = store.select("hash", "payload", "created_at")
    return columns.filter(F.col("created_at") > low).unionByName(columns.filter(F.col("created_at") == low).orderBy("hash").limit(room))


def retrieve(requests: DataFrame, store: DataFrame, now: Column, hash_col: str = "hash", ttl: int = TTL_SECONDS) -> DataFrame:
    """requests with output and found: the payload, or a note that there is none (an empty payload counts as none)."""
    there = live(store, now, ttl).filter("payload <> ''").select(F.col("hash").alias("__hash"), F.col("payload").alias("__payload"))
    out = requests.join(there, F.col(hash_col) == F.col("__hash"), "left")
    missing = F.concat(F.lit("No cached content found for hash "), F.col(hash_col), F.lit(". The entry may have expired (TTL: 5 minutes) or the hash is invalid."))
    return out.withColumn("output", F.coalesce("__payload", missing)).withColumn("found", F.col("__payload").isNotNull()).drop("__hash", "__payload")


def referenced(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """texts exploded to the hashes of their markers."""
    return texts.withColumn("hash", F.explode(marker_keys(F.col(text_col))))


class Store:
    """A store under a path; each generation is a folder, the newest complete one counts."""

    def __init__(self, spark: SparkSession, path: str, capacity: int = CAPACITY, ttl: int = TTL_SECONDS):
        self.spark, self.path, self.capacity, self.ttl = spark, path.rstrip("/"), capacity, ttl
        self._fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _generations(self) -> list[str]:
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not self._fs.exists(root):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(root)]
        done = lambda n: self._fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))
        return sorted(n for n in names if n.startswith("gen-") and done(n))

    def read(self) -> DataFrame:
        names = self._generations()
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{names[-1]}") if names else self.spark.createDataFrame([], SCHEMA)

    def put(self, fresh: DataFrame, now: Column | None = None) -> None:
        now = F.unix_timestamp() if now is None else now
        names = self._generations()
        kept = evicted(upserted(purged(self.read(), now, self.ttl), fresh), self.capacity)
        number = int(names[-1].split("-")[1]) + 1 if names else 0
        kept.write.parquet(f"{self.path}/gen-{number:012d}-{uuid.uuid4().hex[:8]}")
        for old in names[:-1]:  # the one before stays for readers that have it open
            self._fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{old}"), True)

    def get(self, requests: DataFrame, now: Column | None = None) -> DataFrame:
        return retrieve(requests, self.read(), F.unix_timestamp() if now is None else now, ttl=self.ttl)

    def size(self) -> int:
        return self.read().count()

    def clear(self) -> None:
        self._fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path), True)
