"""MinHash near-dedup with b-bit signatures.

1. One pass over the texts gives each document its number of distinct word shingles, a digest of the sorted set, the
   low bit of each of 256 minima packed into four longs (b = 1), and a key for each of 24 bands of five minima.
   Documents of equal sets share the digest; only the smallest id of such a class goes on.
2. Band buckets give candidates: each member is paired with the bucket's most connected member, its hub, so a bucket of
   n makes n - 1 pairs. The packed bits give the collision-corrected estimate J = 2 * agreeing / 256 - 1, and pairs
   whose estimate is far below go. The others are compared on full sets of 64-bit shingle hashes. Members that are far
   from their hub stay in the bucket for another round with another hub.
3. Components are formed from confirmed links.
4. Where the members of a hub span components, each member is reduced to its difference D to the hub's set. As
   |x ^ y| = |D_x ^ D_y|, and a member that isn't linked to the hub has a large D, a link between x and y takes a
   number of shared elements of D: a prefix-filtered join on rare shared elements finds all such pairs without pairing
   the members of a group with one another. They are confirmed on full sets like the others.

A pair at similarity 0.85 shares no bucket with probability (1 - 0.85**5)**24 = 8e-7.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lucerna.llm.common import load, stage, unstage
from lucerna.llm.components import connected_components

SHINGLE = 5
HASHES = 256
#: Bands of rows minima; at most HASHES // ROWS bands.
BANDS, ROWS = 24, 5
PERCENT = 85
#: Members of a bucket as similar as NEAR to their hub need no other hub.
NEAR = 0.6
LATER_HUBS = 8
#: Rounds whose pairs are unions before they are written as one table.
FOLDED = 8
#: Pairs of ids (16 bytes each) that are sent to the sets rather than the sets to them, behind a count.
SENT_PAIRS = 500_000
_U = np.uint64
_FACTORS = np.random.default_rng(20240229).integers(1, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = np.random.default_rng(20240301).integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_MIX = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash for each run of k consecutive word hashes."""
    n = len(hashes) - k + 1
    total = np.full(max(n, 0), k, dtype=np.uint64)
    if n > 0:
        for i in range(k):
            # each word is mixed with its place, so equal words in other places differ
            total = mixed(total * _MIX[i % len(_MIX)] + hashes[i : i + n])
    return total


def shingle_set(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles; a text of fewer words is one shingle, one without words none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    return np.unique(gram_hashes(word_hashes(words), min(k, len(words))))


def minima(shingles: np.ndarray) -> np.ndarray:
    """The minimum of each of HASHES hash functions over a set that isn't empty."""
    x = (mixed(shingles) >> _U(32)).astype(np.uint32)
    low = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(x), 1024):
        block = np.multiply.outer(_FACTORS, x[i : i + 1024])
        block += _SHIFTS[:, None]
        np.minimum(low, block.min(axis=1), out=low)
    return low


def packed_bits(low: np.ndarray) -> np.ndarray:
    """The low bit of each mixed minimum, 64 to a long."""
    spread = mixed(low.astype(np.uint64) + _U(1)) & _U(1)
    return np.packbits(spread.astype(np.uint8)).view(np.int64)


def band_keys(low: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = low[: bands * ROWS].astype(np.uint64).reshape(bands, ROWS)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for i in range(ROWS):
        key = mixed(key * _MIX[0] + rows[:, i])
    return key.view(np.int64)


def signatures(df: DataFrame, id_col: str, text_col: str, bands: int = BANDS) -> DataFrame:
    """A row per document: id, n, digest (of the set), bits (array of longs), keys (array of longs); no words: n = 0, the rest null."""
    id_type = df.schema[id_col].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, bits, keys = [], [], [], []
            for text in batch.column(1):
                shingles = shingle_set(text.as_py())
                counts.append(len(shingles))
                if len(shingles):
                    low = minima(shingles)
                    digests.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                    bits.append(packed_bits(low))
                    keys.append(band_keys(low, bands))
                else:
                    digests.append(None)
                    bits.append(None)
                    keys.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(bits, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))], names=["id", "n", "digest", "bits", "keys"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(sign, f"id {id_type}, n long, digest binary, bits array<long>, keys array<long>")


def agreement(a: str, b: str) -> Column:
    """Collision-corrected similarity of two packed signatures: a share of agreeing bits of (1 + J) / 2 is expected."""
    differing = sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(HASHES // 64)), F.lit(0))
    return 1 - 2 * differing / HASHES


def far_from(percent: int) -> float:
    """By the triangle inequality a text that is linked to one as similar as NEAR to a hub is at least this similar to
    the hub; differences to the hub decide about all members above it."""
    return NEAR - (1 - percent / 100)


def plausible(pairs: DataFrame, lean: DataFrame, far: float) -> DataFrame:
    """The candidate pairs (a, b) whose estimate isn't six standard errors below far; lean has id and bits."""
    side = lambda name: lean.select(F.col("id").alias(name), F.col("bits").alias(f"{name}bits"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.filter(agreement("abits", "bbits") >= far - 6 * ((1 - far**2) / HASHES) ** 0.5).select("a", "b")


def full_sets(df: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, shingles) of the documents in ids. Texts are joined by sort and merge at any size: ids grow with the data."""
    id_type = df.schema[id_col].dataType.simpleString()
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).hint("merge").join(ids.hint("merge"), "id", "left_semi").groupBy("id").agg(F.max("text").alias("text"))

    def hash_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())], names=["id", "shingles"])

    return texts.mapInArrow(hash_sets, f"id {id_type}, shingles binary")


def _array(x: pa.Scalar) -> np.ndarray:
    return np.frombuffer(x.as_py(), dtype=np.uint64)


def compared(pairs: DataFrame, sets: DataFrame, differences: bool = False) -> DataFrame:
    """pairs (a, b) with common, an, bn: sizes of intersection and sets; with the array diff of a's and b's other elements, if asked for.

    Only the sets of the pairs move, once for each pair, however many others there are.
    """
    id_type = pairs.schema["a"].dataType.simpleString()
    names = ["a", "b", "common", "an", "bn", *["diff"] * differences]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common, sizes, diffs = [], ([], []), []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = _array(x), _array(y)
                common.append(len(np.intersect1d(p, q, assume_unique=True)))
                sizes[0].append(len(p))
                sizes[1].append(len(q))
                if differences:
                    diffs.append(np.setxor1d(p, q, assume_unique=True).view(np.int64))
            columns = [batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in (common, *sizes))]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(diffs, pa.list_(pa.int64()))] * differences], names=names)

    pairs = stage(pairs, "op5-pairs")
    sent = F.broadcast(pairs) if pairs.count() <= SENT_PAIRS else pairs.hint("merge")
    side = lambda name, as_name: sets.select(F.col("id").alias(name), F.col("shingles").alias(as_name)).join(sent, name)
    both = side("a", "x").hint("merge").join(side("b", "y").hint("merge"), ["a", "b"])
    return both.select("a", "b", "x", "y").mapInArrow(compare, f"a {id_type}, b {id_type}, common long, an long, bn long" + ", diff array<long>" * differences)


def similar(percent: float) -> Column:
    return F.col("common") * 100 >= (F.col("an") + F.col("bn") - F.col("common")) * percent


def star_pairs(buckets: DataFrame, lean: DataFrame, sets: DataFrame, far: float) -> DataFrame:
    """(a: hub, b: member) of every bucket, compared, with similarity far or more; buckets has key, id, weight."""
    rows, found, r = buckets, None, 0
    while True:
        if r == 0:
            hubs = rows.groupBy("key").agg(F.min_by("id", F.struct(-F.col("weight"), "id")).alias("a"))
        else:  # what is left is few texts far from one another: more hubs save rounds
            heaviest = Window.partitionBy("key").orderBy(F.col("weight").desc(), "id")
            hubs = rows.withColumn("at", F.row_number().over(heaviest)).filter(f"at <= {LATER_HUBS}").select("key", F.col("id").alias("a"))
        members = stage(rows.join(hubs, "key").filter("id <> a"), f"op5-members-{r}")
        pairs = members.select("a", F.col("id").alias("b")).distinct()
        checked = stage(compared(plausible(pairs, lean, far), sets).filter(similar(100 * far)), f"op5-checked-{r}")
        found = checked if found is None else found.unionByName(checked)
        near = checked.filter(similar(100 * NEAR)).select("a", F.col("b").alias("id"))
        settled = members.join(near, ["a", "id"], "left_semi").select("key", "id").unionByName(hubs.select("key", F.col("a").alias("id"))).distinct()
        left = rows.join(settled, ["key", "id"], "left_anti")
        if r == 0:
            # a bucket of texts far from one another, around a shared passage, say: deal it out by second shared bands;
            # a link shares none of the 23 others with probability 1e-6
            other = buckets.select("id", F.col("key").alias("other"))
            left = left.join(other, "id").filter("key <> other").select(F.xxhash64("key", "other").alias("key"), "id", "weight")
        if r % FOLDED == FOLDED - 1:
            found = stage(found, f"op5-found-{r}")
        open_keys = left.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
        fresh = stage(left.join(open_keys, "key"), f"op5-left-{r}")
        unstage(members)
        if r:
            unstage(rows)
        rows, r = fresh, r + 1
        if not rows.limit(1).count():
            return found.dropDuplicates(["a", "b"])


def residual_pairs(stars: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members of one hub and of different components that differences to the hub don't rule out."""
    label = lambda name: labels.select(F.col("id").alias(name), F.col("component").alias(f"{name}_component"))
    placed = stars.join(label("a"), "a", "left").join(label("b"), "b", "left")
    # a hub may have a third of all members: its join is cut off here, so that it can be split, and sums are partial ones
    placed = stage(placed.withColumn("a_component", F.coalesce("a_component", "a")).withColumn("b_component", F.coalesce("b_component", "b")), "op5-placed")
    spanning = placed.groupBy("a").agg(F.max(F.col("a_component") != F.col("b_component")).alias("open")).filter("open").select("a")
    placed = stage(placed.join(spanning, "a").select("a", "b", "b_component"), "op5-open")
    ratio = (100 - percent) / (100 + percent)
    linked = similar(percent)
    rows = compared(placed.select("a", "b"), sets, differences=True).withColumn("linked", linked)
    rows = rows.join(placed, ["a", "b"]).select("a", "b", F.col("b_component").alias("component"), "linked", "an", "bn", F.size("diff").alias("d"), "diff")
    rows = stage(rows, "op5-differences")
    elements = rows.select("a", "b", F.explode("diff").alias("e"))
    often = elements.groupBy("a", "e").agg(F.count("*").alias("df")).filter("df > 1")
    ranked = elements.join(often, ["a", "e"]).groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("df", "e"))).alias("es"))
    # a partner that isn't linked to the hub must share more than this with b
    least = F.greatest(F.floor((F.col("d") + (F.col("an") - F.col("bn")) * ratio) / 2 - 1e-9) + 1, F.lit(1))
    full = rows.drop("diff").join(ranked, ["a", "b"]).withColumn("m", F.size("es"))
    full = stage(full.withColumn("prefix", F.slice("es", 1, F.greatest(F.col("m") - least + 1, F.lit(0)).cast("int"))), "op5-ranked")
    cells = lambda name, es: [F.col("b").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("component", "bn", "d", "m")], F.posexplode(f"{es}.e").alias(f"{name}_at", "e")]
    x = full.filter(~F.col("linked")).select("a", *cells("x", "es"))
    y = full.select("a", *cells("y", "prefix"))
    # at the first shared element, what follows in both must still give enough to share
    enough = F.least(F.col("x_m") - F.col("x_at"), F.col("y_m") - F.col("y_at")) * 2 >= F.col("x_d") + F.col("y_d") - (F.col("x_bn") + F.col("y_bn")) * ratio - 1e-6
    met = x.alias("x").join(y.alias("y"), (F.col("x.a") == F.col("y.a")) & (F.col("x.e") == F.col("y.e")) & (F.col("x_component") != F.col("y_component")) & enough)
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, bands: int = BANDS) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept.

    Links join sets with 100 * intersection >= percent * union; component_id is the smallest id reachable. Null and
    empty texts have no shingles, no links, and stand alone. Rows that repeat an id are one document, whose links are
    confirmed on the largest of its texts; rows without an id have no links and a null component_id, and are kept. Other columns
    are ignored; an empty table gives no rows.
    """
    signed = stage(signatures(df, id_col, text_col, bands), "op5-signatures")
    one = signed.filter("n > 0 and id is not null")
    classes = stage(one.groupBy("n", "digest").agg(F.min("id").alias("rep")), "op5-classes")
    reps = one.join(classes.select(F.col("rep").alias("id"), "n", "digest"), ["id", "n", "digest"], "left_semi")

    banded = reps.select("id", F.explode("keys").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    buckets = stage(banded.join(shared, "key"), "op5-buckets")
    rank = buckets.groupBy("id").agg(F.sum("members").alias("weight"))
    weighed = stage(buckets.join(rank, "id").select("key", "id", "weight"), "op5-weighed")
    lean = stage(reps.select("id", "bits").join(rank, "id", "left_semi"), "op5-lean")
    sets = stage(full_sets(df, lean.select("id"), id_col, text_col), "op5-sets")
    stars = stage(star_pairs(weighed, lean, sets, far_from(percent)), "op5-stars")
    links = stage(stars.filter(similar(percent)).select("a", "b"), "op5-links")
    labels = stage(connected_components(links), "op5-labels")
    rest = stage(residual_pairs(stars, labels, sets, percent), "op5-residual")
    if rest.limit(1).count():
        more = compared(rest, sets).filter(similar(percent)).select("a", "b")
        labels = stage(connected_components(links.unionByName(more)), "op5-labels-all")

    # a class takes its representative's component
    known = classes.join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left").select("n", "digest", F.coalesce("component", "rep").alias("component"))
    found = signed.join(known, ["n", "digest"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, bands: int = BANDS) -> DataFrame:
    """df's rows of the documents that near_duplicates keeps, and all rows without an id."""
    kept = near_duplicates(df, id_col, text_col, percent, bands).filter("kept").select(id_col).filter(F.col(id_col).isNotNull()).distinct()
    named = df.filter(F.col(id_col).isNotNull()).hint("merge").join(kept.hint("merge"), id_col, "left_semi")
    return named.select(*df.columns).unionByName(df.filter(F.col(id_col).isNull()))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"))


QUERIES = {"op5_minhash": op5_minhash}
ORACLE_SQL = {
    "op5_minhash": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(array_to_string(w[i : i + least(len(w), 5) - 1], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL) JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * c >= 85 * (na.n + nb.n - c)),
r(id, low) AS (SELECT doc_id, doc_id FROM documents UNION SELECT p.b, r.low FROM r JOIN p ON r.id = p.a),
m AS (SELECT id, min(low) AS low FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.low AS component_id, d.doc_id = m.low AS kept FROM documents d JOIN m ON m.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
}
