"""WARC archives: writing records, and reading them back with segment reassembly.

Pages become gzipped WARC/1.1 records in files in the shared folder; a block over segment_bytes is cut into a first
record and continuation records. Reading parses the files, groups the records of a cut block by origin identifier,
orders them by segment number, verifies the total length, decodes the chunked transfer framing and checks the digest.
Payloads of equal digest are stored once: the largest identifier is the response, the others revisit it.
"""

from __future__ import annotations

import base64
import hashlib
import urllib.parse
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucerna.llm.common import load, shuffle_partitions, stage, workspace

#: Below the usual page, so that most pages are cut and put together again.
SEGMENT_BYTES = 2 << 10
FILE_BYTES = 16 << 20
CHUNK_BYTES = 8 << 10
DATE = "2020-01-01T00:00:00Z"
RECORDS = "origin string, number int, total long, id string, type string, refers string, digest string, bytes long, block binary"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Payload in the chunked transfer framing of HTTP/1.1."""
    parts = []
    for i in range(0, len(payload), size):
        part = payload[i : i + size]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload; raises ValueError where the framing is broken or ends early."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("a chunk has no size line")
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(parts)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is shorter than its size line says")
        parts.append(body[at : at + size])
        at += size + 2


def record(fields: dict[str, str], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + f"Content-Length: {len(block)}\r\n\r\n"
    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
    return squeeze.compress(head.encode() + block + b"\r\n\r\n") + squeeze.flush()


def records_of(name: str, page: str, url: str, payload: bytes, refers: str | None, segment_bytes: int) -> Iterator[bytes]:
    """The records of a page: one, or a first segment and its continuations."""
    fields = {"WARC-Type": "response" if refers is None else "revisit", "WARC-Record-ID": f"<{name}>", "WARC-Date": DATE, "WARC-Target-URI": urllib.parse.quote(url, safe=":/?&=%#+,;@"), "X-Page-ID": page, "WARC-Payload-Digest": f"sha1:{digest_of(payload)}", "Content-Type": "application/http;msgtype=response"}
    if refers is not None:
        fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:page:{refers}>"}
        yield record(fields, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload))
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment_bytes:
        yield record(fields, block)
        return
    yield record(fields | {"WARC-Segment-Number": "1"}, block[:segment_bytes])
    for number, i in enumerate(range(segment_bytes, len(block), segment_bytes), 2):
        last = {"WARC-Segment-Total-Length": str(len(block))} if i + segment_bytes >= len(block) else {}
        yield record({"WARC-Type": "continuation", "WARC-Record-ID": f"<{name}-{number}>", "WARC-Date": DATE, "WARC-Segment-Origin-ID": f"<{name}>", "WARC-Segment-Number": str(number)} | last, block[i : i + segment_bytes])


def write_archives(pages: DataFrame, folder: str, segment_bytes: int = SEGMENT_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes rows (id, url, html, refers) as archives under folder; a row (path, records) per finished file.

    A retried task writes files of new names and only the files of the attempt that counts are listed, so a lost
    executor leaves at most files that nobody reads.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        stem = f"{task.partitionId():06d}-{task.taskAttemptId():08d}"
        files, held, size, n, k = [], [], 0, 0, 0

        def close() -> None:
            nonlocal held, size, n
            if held:
                path = f"{root}/{stem}-{len(files):05d}.warc.gz"
                with fs.open_output_stream(path, compression=None) as out:
                    for x in held:
                        out.write(x)
                files.append((path, n))
            held, size, n = [], 0, 0

        for batch in batches:
            ids, urls, texts, refers = (batch.column(i) for i in range(4))
            for i in range(batch.num_rows):
                k += 1
                payload = (texts[i].as_py() or "").encode("utf-8", "surrogatepass")
                for x in records_of(f"urn:page:{ids[i].as_py()}:{stem}-{k}", str(ids[i].as_py()), urls[i].as_py() or "", payload, refers[i].as_py(), segment_bytes):
                    held.append(x)
                    size += len(x)
                    n += 1
                if size >= file_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in files], pa.string()), pa.array([f[1] for f in files], pa.int64())], names=["path", "records"])

    return pages.mapInArrow(write, "path string, records long")


def members(data: bytes) -> Iterator[bytes]:
    """The gzip members of a file, decompressed. Feeding short pieces keeps what is left over behind a member short."""
    view, at = memoryview(data), 0
    while at < len(view):
        member, parts = zlib.decompressobj(31), []
        while not member.eof:
            if at >= len(view):
                raise ValueError("an archive ends within a record")
            parts.append(member.decompress(view[at : at + 16384]))
            at += 16384
        at = min(at, len(view)) - len(member.unused_data)
        yield b"".join(parts)


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("a record lacks its version line")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length differs from its Content-Length")
    return fields, rest[:size]


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """The records of the files that manifest lists by path, a row each. One file of bounded size is held at a time."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pa.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with fs.open_input_stream(path, compression=None) as f:
                    data, rows = f.read(), []
                for member in members(data):
                    fields, block = parsed(member)
                    http = dict(x.partition(b": ")[::2] for x in block.partition(b"\r\n\r\n")[0].split(b"\r\n")) if fields["warc-type"] == "revisit" else {}
                    name = fields["warc-record-id"][1:-1]
                    rows.append((fields.get("warc-segment-origin-id", f"<{name}>")[1:-1], int(fields.get("warc-segment-number", 0)), int(t) if (t := fields.get("warc-segment-total-length")) else None, fields.get("x-page-id"), fields["warc-type"], fields["warc-refers-to"][10:-1] if "warc-refers-to" in fields else None, fields.get("warc-payload-digest", "")[5:], int(http[b"Content-Length"]) if http else None, None if http else block))
                    if len(rows) >= 256:
                        yield from batched(rows)
                        rows = []
                yield from batched(rows)

    def batched(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if rows:
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["origin", "number", "total", "id", "type", "refers", "digest", "bytes", "block"])

    return manifest.mapInArrow(read, RECORDS)


def payload_of(block: bytes, digest: str) -> bytes:
    """The decoded payload of a whole response block; raises ValueError if its digest differs."""
    head, _, body = block.partition(b"\r\n\r\n")
    payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
    if digest_of(payload) != digest:
        raise ValueError("a payload's digest differs from its record's")
    return payload


def reassemble(records: DataFrame, with_payload: bool = False) -> DataFrame:
    """A row per page record: id, bytes, digest, type, refers, and payload if asked for.

    Segments that follow one another in a file, from the first to the one with the total length, are put together where
    they are read. Those of other cut blocks move, by origin identifier, and for each block put together its identifier
    alone, so that a segment met elsewhere too is found. One page is held at a time. Missing or repeated segments, a wrong
    total length, broken framing and wrong digests raise ValueError.
    """
    schema = "id string, bytes long, digest string, type string, refers string" + ", payload binary" * with_payload
    names = ["id", "bytes", "digest", "type", "refers", *["payload"] * with_payload]

    def batched(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.binary()] * with_payload]
        columns = list(zip(*out)) if out else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
        """Records of one cut block that follow one another; those of whole blocks one by one."""
        group: list[dict] = []
        for batch in batches:
            for r in batch.to_pylist():
                if group and (r["number"] == 0 or r["origin"] != group[0]["origin"] or group[0]["number"] == 0):
                    yield group
                    group = []
                group.append(r)
        if group:
            yield group

    def complete(group: list[dict]) -> bool:
        return group[-1]["total"] is not None and [r["number"] for r in group] == list(range(1, len(group) + 1))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for group in runs(batches):
            r = group[0]
            if r["number"] == 0:
                payload = payload_of(r["block"], r["digest"]) if r["type"] == "response" else None
                out.append((r["id"], r["bytes"] if payload is None else len(payload), r["digest"], r["type"], r["refers"], *[payload] * with_payload))
            elif complete(group):
                out.append(page(group))
            if len(out) >= 256:
                yield batched(out)
                out = []
        yield batched(out)

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = pa.schema([("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("id", pa.string()), ("type", pa.string()), ("refers", pa.string()), ("digest", pa.string()), ("bytes", pa.int64()), ("block", pa.binary())])
        out: list[dict] = []
        for group in runs(batches):
            out += [{"origin": group[0]["origin"], "number": 0}] if complete(group) else group
            if len(out) >= 256:
                yield pa.RecordBatch.from_pylist(out, schema=kept)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema=kept)

    def page(group: list[dict]) -> tuple:
        origin = group[0]["origin"]
        if [r["number"] for r in group] != list(range(1, len(group) + 1)):
            raise ValueError(f"segments of {origin} are missing or repeated")
        block = b"".join(r["block"] for r in group)
        if group[-1]["total"] != len(block):
            raise ValueError(f"{origin} has {len(block)} bytes, not {group[-1]['total']}")
        first = group[0]
        payload = payload_of(block, first["digest"])
        return first["id"], len(payload), first["digest"], first["type"], first["refers"], *[payload] * with_payload

    def pages(group: list[dict]) -> list[tuple]:
        """The page of segments that moved; none of a block that was put together where it was read."""
        return [] if len(group) == 1 and group[0]["number"] == 0 else [page(group)]

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[dict] = []
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if group and r["origin"] != group[0]["origin"]:
                    out += pages(group)
                    group = []
                group.append(r)
            yield batched(out)
        yield batched(pages(group) if group else [])

    here = records.mapInArrow(whole, schema)
    cut = records.filter("number > 0").mapInArrow(others, RECORDS).repartition("origin").sortWithinPartitions("origin", "number")
    return here.unionByName(cut.mapInArrow(joined, schema))


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes a record per row and reads the archives back: id, payload_bytes, payload_digest, record_type, refers_to.

    Null html counts as empty, a null url as the empty address. Of equal payloads of at least revisit_bytes bytes the
    rows with the largest id are responses, the others revisit it; rows without an id revisit any row with one.
    Repeated rows each get a record. Other columns are ignored; an empty table gives no rows.
    """
    spark = pages.sparkSession
    id_type = pages.schema[id_col].dataType
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html")).withColumn("sha", F.sha1("html"))
    kept = rows.filter(F.octet_length("html") >= revisit_bytes).groupBy("sha").agg(F.max("id").alias("last"), F.count("*").alias("n"))
    kept = kept.filter("n > 1 and last is not null").select("sha", "last")
    refers = F.when(~F.col("id").eqNullSafe(F.col("last")) & F.col("last").isNotNull(), F.col("last").cast("string"))
    folder = workspace(spark, "op3-warc")
    written = rows.join(kept, "sha", "left").select("id", "url", "html", refers.alias("refers"))
    manifest = stage(write_archives(written, folder, segment_bytes, file_bytes), "op3-manifest")
    records = read_archives(manifest.repartition(shuffle_partitions(spark), "path"), folder)
    found = reassemble(records)
    as_id = lambda c: F.when(F.col(c) != "None", F.col(c)).cast(id_type)
    return found.select(as_id("id").alias(id_col), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), as_id("refers").alias("refers_to"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(load(spark, sf_dir, "pages"))


QUERIES = {"op3_warc": op3_warc}
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(s, {5 * g + 1}, 5))::BIGINT >> {15 - 5 * k}) & 31)::INT, 1)" for g in range(8) for k in range(4))
ORACLE_SQL = {
    "op3_warc": f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS s FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY s) AS last FROM p)
SELECT page_id, n AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM m
"""
}
