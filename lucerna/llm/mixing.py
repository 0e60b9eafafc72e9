"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents may belong to several sources. They are aggregated by membership pattern (the sorted set of their
sources), so the flow network has one node a pattern and one a source, whatever the number of documents: each
repetition of a pattern is an edge of the pattern's size whose cost rises with the repetition (convex), and each
source takes its target. The flow of a pattern becomes whole repetitions of all its documents plus a remainder,
which a seeded order fills: hash buckets are summed first, and only the bucket where the remainder ends is sorted.
"""

from __future__ import annotations

import heapq
import json
from collections import defaultdict
from itertools import cycle

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lucerna.llm.common import WORD_PATTERN, load, stage

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEED = 17
#: Patterns whose totals the driver may hold; a row each, of a few hundred bytes.
MAX_PATTERNS = 50_000
#: Bits of a document's place in the seeded order, and of the buckets that are summed.
PLACE_BITS, BUCKET_BITS = 60, 12


def targets_of(sizes: dict, weights: dict, total: float, cap: float = MAX_REPEATS) -> dict:
    """Shares of total by weight; what exceeds cap times the source's size is reshared by weight among the others."""
    out: dict = {}
    left, active = float(total), dict(weights)
    while active:
        whole = sum(active.values())
        over = [s for s, w in active.items() if left * w / whole > cap * sizes[s]]
        if not over:
            return out | {s: left * w / whole for s, w in active.items()}
        for s in over:
            out[s] = float(cap * sizes[s])
        left -= sum(out[s] for s in over)
        active = {s: w for s, w in active.items() if s not in out}
    return out


def min_cost_flow(patterns: dict[str, tuple[int, tuple]], targets: dict, repeats: int = MAX_REPEATS) -> dict[tuple[str, object], int]:
    """Words that go from each pattern to each source: as many as the targets take, at the least repetition.

    patterns: name -> (size, sources). Successive shortest paths with node potentials on the pattern-source network.
    """
    start, end = ("start",), ("end",)
    graph: dict = defaultdict(list)  # node -> edges [to, room, cost, index of the reverse edge]

    def edge(a, b, room: int, cost: int) -> None:
        graph[a].append([b, room, cost, len(graph[b])])
        graph[b].append([a, 0, -cost, len(graph[a]) - 1])

    for name, (size, sources) in patterns.items():
        for r in range(repeats):
            edge(start, ("p", name), size, r)
        for s in sources:
            edge(("p", name), ("s", s), size * repeats, 0)
    for s, t in targets.items():
        edge(("s", s), end, int(t), 0)
    potential: dict = defaultdict(int)
    while True:
        dist, back, queue, n = {start: 0}, {}, [(0, 0, start)], 0
        while queue:
            d, _, a = heapq.heappop(queue)
            if d > dist[a]:
                continue
            for i, (b, room, cost, _) in enumerate(graph[a]):
                if room > 0 and (step := d + cost + potential[a] - potential[b]) < dist.get(b, 1 << 60):
                    dist[b], back[b] = step, (a, i)
                    heapq.heappush(queue, (step, n := n + 1, b))
        if end not in dist:
            break
        far = max(dist.values())
        for a in graph:
            potential[a] += dist.get(a, far)
        room, b = 1 << 62, end
        while b != start:
            a, i = back[b]
            room, b = min(room, graph[a][i][1]), a
        b = end
        while b != start:
            a, i = back[b]
            graph[a][i][1] -= room
            graph[b][graph[a][i][3]][1] += room
            b = a
    return {(name, s): room for name, (_, sources) in patterns.items() for s in sources if (room := _reverse(graph, name, s)[1])}


def _reverse(graph: dict, name: str, source) -> list:
    """The reverse edge from source to pattern, whose room is the flow."""
    return next(e for e in graph[("s", source)] if e[0] == ("p", name))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN)).cast("long")


def seeded_place(doc_id: Column, seed: int) -> Column:
    """A document's place in the seeded order: the first 60 bits of the MD5 of id and seed."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, PLACE_BITS // 4), 16, 10).cast("long")


def mix(docs: DataFrame, sources: Column, id_col: str = "doc_id", text_col: str = "text", weights: tuple = WEIGHTS, repeats: int = MAX_REPEATS, seed: int = SEED) -> DataFrame:
    """One row per document row: id, pattern, size, source_size, target, taken.

    sources: an array of the document's sources; null elements and a null array count as the source null. Sources by
    code point, null last, weigh weights in turn. source_size and target are sums over the document's sources, size
    counts words (null and empty text: 0), taken counts words with repeats, at most repeats * size. Rows of size 0
    take 0. Repeated rows are separate capacity. Ties of the seeded order fall to id and size, so reruns agree.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    pattern = F.to_json(F.array_sort(F.array_distinct(F.coalesce(sources, F.array(F.lit(None).cast("string"))))))
    rows = docs.select(F.col(id_col).alias("id"), pattern.alias("pattern"), word_count(F.col(text_col)).alias("size"))
    rows = stage(rows.withColumn("h", seeded_place(F.col("id"), seed)), "op1-sizes")

    totals = rows.groupBy("pattern").agg(F.sum("size").alias("size")).limit(MAX_PATTERNS + 1).collect()
    if len(totals) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    patterns = {r.pattern: (r.size, tuple(json.loads(r.pattern)) or (None,)) for r in totals}
    sizes: dict = defaultdict(int)
    for size, members in patterns.values():
        for s in members:
            sizes[s] += size
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = targets_of(sizes, dict(zip(order, cycle(weights))), sum(size for size, _ in patterns.values()), repeats)
    flow: dict = defaultdict(int)
    for (name, _), words in min_cost_flow(patterns, targets, repeats).items():
        flow[name] += words
    plan = [(name, sum(sizes[s] for s in m), float(sum(targets[s] for s in m)), flow[name] // size if size else 0, flow[name] % size if size else 0) for name, (size, m) in patterns.items()]
    plan_type = T.StructType([T.StructField("pattern", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("whole", T.LongType()), T.StructField("rest", T.LongType())])
    planned = F.broadcast(spark.createDataFrame(plan, plan_type))  # at most MAX_PATTERNS rows

    bucket = F.shiftright("h", PLACE_BITS - BUCKET_BITS)
    sums = rows.groupBy("pattern", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = sums.withColumn("before", before).join(planned.select("pattern", "rest"), "pattern").filter("before <= rest and rest < before + words")
    ends = ends.select("pattern", F.col("bucket").alias("end_bucket"), "before")
    decided = rows.withColumn("bucket", bucket).join(planned, "pattern").join(F.broadcast(ends), "pattern", "left")  # ends: a row a pattern
    within = Window.partitionBy("pattern").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    at_end = decided.filter("bucket = end_bucket").withColumn("so_far", F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    at_end = at_end.withColumn("extra", (F.col("so_far") + F.col("size") / 2 <= F.col("rest")).cast("long")).drop("so_far")
    others = decided.filter("end_bucket is null or bucket <> end_bucket").withColumn("extra", F.coalesce(F.col("bucket") < F.col("end_bucket"), F.lit(False)).cast("long"))
    taken = F.col("size") * (F.col("whole") + F.when(F.col("rest") > 0, F.col("extra")).otherwise(0))
    return others.unionByName(at_end).select(F.col("id").alias(id_col), "pattern", "size", "source_size", "target", taken.alias("taken"))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(load(spark, sf_dir, "documents"), F.array("source")).drop("pattern")


QUERIES = {"op1_mix_sources": op1_mix_sources}
ORACLE_SQL = {
    "op1_mix_sources": rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD_PATTERN}')) AS BIGINT) AS size,
  CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':{SEED}'), 1, {PLACE_BITS // 4})) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS size, CAST([5, 2, 1][1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT)] AS DOUBLE) AS w FROM d GROUP BY source),
-- sources in the order in which they reach three times their size; the first k are capped, the others share the rest
o AS (SELECT *, row_number() OVER c AS k, sum(3 * size) OVER c AS capped, sum(w) OVER c AS weight FROM s WINDOW c AS (ORDER BY 3 * size / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
a AS (SELECT (SELECT sum(size) FROM s) AS t, (SELECT sum(w) FROM s) AS w),
l AS (SELECT 0 AS k, a.t AS rest, a.w AS weight FROM a UNION ALL SELECT k, a.t - capped, a.w - weight FROM o, a),
e AS (SELECT l.* FROM l LEFT JOIN o ON o.k = l.k + 1 WHERE o.k IS NULL OR l.rest * o.w / l.weight <= 3 * o.size ORDER BY l.k LIMIT 1),
g AS (SELECT o.source, o.size, CASE WHEN o.k <= e.k THEN 3 * o.size ELSE e.rest * o.w / e.weight END AS target FROM o, e),
f AS (SELECT d.doc_id, d.size, CAST(g.size AS BIGINT) AS source_size, g.target, CAST(floor(g.target) AS BIGINT) AS flow,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN source_size = 0 THEN 0 ELSE size * (flow // source_size + CASE WHEN flow % source_size > 0 AND before + size / 2 <= flow % source_size THEN 1 ELSE 0 END) END AS BIGINT) AS taken FROM f
"""
}
