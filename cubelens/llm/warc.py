"""WARC archives as seekable Zstandard bundles.

A bundle is a ``.warc.zst`` file: records stand in independent Zstandard frames of about ``FRAME`` bytes of text each, a
record never crosses frames, and the file ends with a seek table (a skippable frame that lists compressed and
decompressed sizes of all frames), so that common readers can decompress it from the start and a reader of one record
reads the file's end and one frame. Beside the bundles stands ``index``, a Parquet table: ``page_id, bundle, frame, at,
length, record_type, refers_to``, where ``at`` counts from the start of the decompressed frame.

Tasks write bundles under names of their own attempt and hand on index rows. Spark commits the index, and a bundle
exists for readers only if the index names it: what lost or repeated attempts leave behind is never read, and
:func:`sweep` deletes it. Files are opened through ``pyarrow.fs``, which takes local and object-store addresses.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FRAME, BUNDLE, LEVEL, LEAST = 1 << 20, 1 << 28, 3, 1000
DATE = "1970-01-01T00:00:00Z"  # pages carry none; reruns must agree

# The seekable Zstandard format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
# Fixed value: the profile of revisit records in WARC 1.1.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAME = "urn:cubelens:page:"

INDEX = "page_id bigint, bundle string, frame int, at bigint, length bigint, record_type string, refers_to bigint"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def _urn(page_id: int | None) -> str:
    return f"<{NAME}{'none' if page_id is None else page_id}>"


def _page_id(urn: bytes) -> int | None:
    name = urn[len(NAME) + 1 : -1]
    return None if name == b"none" else int(name)


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None) -> bytes:
    """One WARC record; with ``refers_to`` a revisit, which has the payload's HTTP head and not the payload.

    Spaces and control characters of an address are written as percent codes.
    """
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_CONTROL.sub(lambda m: f'%{ord(m[0]):02X}', url)}")
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(binascii.unhexlify(sha1)).decode()}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {PROFILE}", "WARC-Truncated: length"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[tuple[int, int, dict]]:
    """(where it begins, where it ends, fields) of each record of a decompressed frame; responses are held to their digest."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:stop].split(b"\r\n")
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no record begins at {at}")
        head = dict(line.split(b": ", 1) for line in lines)
        low = stop + 4
        high = low + int(head[b"Content-Length"])
        body = data.index(b"\r\n\r\n", low, high) + 4
        http = dict(line.split(b": ", 1) for line in data[low : body - 4].split(b"\r\n")[1:])
        digest = base64.b32decode(head[b"WARC-Payload-Digest"].removeprefix(b"sha1:")).hex()
        kind = head[b"WARC-Type"].decode()
        payload = data[body:high] if kind == "response" else None
        if payload is not None and (len(payload) != int(http[b"Content-Length"]) or hashlib.sha1(payload).hexdigest() != digest):
            raise ValueError(f"the payload of {head[b'WARC-Record-ID'].decode()} is not what its record says")
        yield at, high + 4, {
            "page_id": _page_id(head[b"WARC-Record-ID"]), "url": head[b"WARC-Target-URI"].decode() if b"WARC-Target-URI" in head else None, "record_type": kind,
            "refers_to": _page_id(head[b"WARC-Refers-To"]) if b"WARC-Refers-To" in head else None, "payload_bytes": int(http[b"Content-Length"]), "payload_digest": digest, "payload": payload,
        }
        at = high + 4


class _Bundle:
    """A bundle that is being written."""

    def __init__(self, files: fs.FileSystem, folder: str, name: str):
        import zstandard

        self.name, self.file, self.sizes, self.bytes = name, files.open_output_stream(f"{folder}/{name}", compression=None), [], 0
        self.pack = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)

    def frame(self, data: bytes) -> None:
        packed = self.pack.compress(data)
        self.file.write(packed)
        self.sizes.append((len(packed), len(data)))
        self.bytes += len(packed)

    def close(self) -> None:
        entries = b"".join(struct.pack("<II", *s) for s in self.sizes)
        self.file.write(struct.pack("<II", SKIPPABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE))
        self.file.close()


def seek_table(file: pa.NativeFile) -> list[tuple[int, int, int]]:
    """(offset, compressed size, decompressed size) of each frame, from the end of a bundle."""
    size = file.size()
    file.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE:
        raise ValueError("the file does not end with a seek table")
    width = 12 if flags & 0x80 else 8
    file.seek(size - 9 - n * width)
    table = file.read(n * width)
    at, out = 0, []
    for i in range(n):
        packed, plain = struct.unpack_from("<II", table, i * width)
        out.append((at, packed, plain))
        at += packed
    return out


def read_frame(file: pa.NativeFile, entry: tuple[int, int, int]) -> bytes:
    import zstandard

    at, packed, plain = entry
    file.seek(at)
    data = zstandard.ZstdDecompressor().decompress(file.read(packed), max_output_size=plain)
    if len(data) != plain:
        raise ValueError("a frame has not the size that the seek table says")
    return data


def planned(pages: DataFrame) -> DataFrame:
    """``page_id, url, payload, sha1, refers_to``: which page each one revisits, null for responses.

    Payloads are equal if their SHA-256 is. Of equal ones of ``LEAST`` bytes or more the largest page_id is the response;
    rows that repeat this id are all responses. Smaller payloads get a key of their own, so that many empty pages don't
    meet in one task; a hot payload is one row on the counted side, and Spark splits the other side.
    """
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    key = F.when(F.octet_length("payload") >= LEAST, F.sha2("payload", 256)).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id").cast("string")))
    rows = rows.withColumn("key", key)
    # grouped from the keys alone: the payloads of this side stay in the scan's tasks
    groups = rows.where(~F.col("key").startswith("-")).groupBy("key").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    joined = rows.join(groups, "key", "left")
    return joined.select("page_id", "url", "payload", F.sha1("payload").alias("sha1"), F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("refers_to"))


def write(pages: DataFrame, path: str, frame: int = FRAME, bundle: int = BUNDLE) -> None:
    """Archive all rows of (page_id, url, html) as bundles at ``path``.

    A null html is an empty payload. A null url gives a record without address, a null page_id the name ``none``: it is
    a response only if nothing else of its group has an id. Pages of any length are one record, in a frame of its own if
    long. Repeated rows are a record each. Other columns are not read. No rows: an empty index and no bundles.
    """
    spark = pages.sparkSession

    def bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        files, folder = fs.FileSystem.from_uri(f"{path}/bundles")
        files.create_dir(folder, recursive=True)
        held: list[bytes] = []
        index: list[tuple] = []
        out, size, made = None, 0, 0

        def rows() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
            names = ["page_id", "bundle", "frame", "at", "length", "record_type", "refers_to"]
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*index, strict=True), kinds, strict=True)], names)

        for batch in batches:
            ids, urls, payloads, digests, refers = batch.columns
            for i in range(batch.num_rows):
                if out is None:
                    out, made = _Bundle(files, folder, f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{made:04d}.warc.zst"), made + 1
                page_id, refers_to = ids[i].as_py(), refers[i].as_py()
                data = record(page_id, urls[i].as_py(), payloads[i].as_py(), digests[i].as_py(), refers_to)
                if held and size + len(data) > frame:
                    out.frame(b"".join(held))
                    held, size = [], 0
                index.append((page_id, out.name, len(out.sizes), size, len(data), "response" if refers_to is None else "revisit", refers_to))
                held.append(data)
                size += len(data)
                if out.bytes >= bundle:
                    out.frame(b"".join(held))
                    out.close()
                    out, held, size = None, [], 0
                if len(index) >= 10_000:
                    yield rows()
                    index.clear()
        if out is not None:
            out.frame(b"".join(held))
            out.close()
        if index:
            yield rows()

    planned(pages).mapInArrow(common.released(bundles), INDEX).write.parquet(f"{path}/index")


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """``page_id, url, record_type, refers_to, payload_bytes, payload_digest, bundle, frame`` of every record, from the bundles.

    A task opens a bundle, reads its seek table and decompresses a frame at a time. A bundle with another number of
    records than the index has fails. With ``payloads`` responses bring their ``payload``; a revisit has null there.
    """
    named = spark.read.parquet(f"{path}/index").groupBy("bundle").agg(F.count(F.lit(1)).alias("n"))
    named = named.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))  # few bytes, which would be put in one task
    kinds = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "bundle": pa.string(), "frame": pa.int32()} | ({"payload": pa.binary()} if payloads else {})

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = fs.FileSystem.from_uri(f"{path}/bundles")
        for batch in batches:
            for name, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen = 0
                with files.open_input_file(f"{folder}/{name}") as file:
                    for k, entry in enumerate(seek_table(file)):
                        found = [fields | {"bundle": name, "frame": k} for _, _, fields in parse(read_frame(file, entry))]
                        seen += len(found)
                        yield pa.record_batch([pa.array([f[c] for f in found], t) for c, t in kinds.items()], list(kinds))
                if seen != n:
                    raise ValueError(f"{name} has {seen} records, the index says {n}")

    types = {pa.int64(): "bigint", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary"}
    return named.mapInArrow(common.released(records), ", ".join(f"{c} {types[t]}" for c, t in kinds.items()))


def read_record(spark: SparkSession, path: str, page_id: int) -> dict:
    """One page's record with its payload: one frame is read, or two for a revisit, whose payload is that of its response."""

    def fetch(wanted: int) -> dict:
        row = spark.read.parquet(f"{path}/index").where(F.col("page_id") == wanted).limit(1).collect()
        if not row:
            raise KeyError(wanted)
        files, folder = fs.FileSystem.from_uri(f"{path}/bundles")
        with files.open_input_file(f"{folder}/{row[0]['bundle']}") as file:
            data = read_frame(file, seek_table(file)[row[0]["frame"]])
        return next(parse(data[row[0]["at"] : row[0]["at"] + row[0]["length"]]))[2]

    found = fetch(page_id)
    if found["refers_to"] is not None:
        found["payload"] = fetch(found["refers_to"])["payload"]
    return found


def sweep(spark: SparkSession, path: str) -> int:
    """Delete bundles that the index doesn't name, left by attempts that didn't commit; their number."""
    there = spark.read.format("binaryFile").load(f"{path}/bundles").select(F.element_at(F.split("path", "/"), -1).alias("bundle"))  # lists names, opens nothing
    lost = there.join(spark.read.parquet(f"{path}/index").select("bundle").distinct(), "bundle", "left_anti")

    def delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = fs.FileSystem.from_uri(f"{path}/bundles")
        for batch in batches:
            for name in batch.column(0).to_pylist():
                files.delete_file(f"{folder}/{name}")
            yield batch

    return lost.mapInArrow(delete, "bundle string").count()


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``pages`` archived and read back; null page_ids, urls and htmls as :func:`write` says."""
    path = common.scratch(spark, "warc")
    write(common.table(spark, sf_dir, "pages", "page_id", "url", "html"), path)
    return read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
g AS (SELECT body, max(page_id) AS last FROM p WHERE octet_length(encode(body)) >= {LEAST} GROUP BY body)
SELECT p.page_id, CASE WHEN last IS NULL OR last = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN last IS DISTINCT FROM p.page_id THEN last END AS refers_to, octet_length(encode(p.body)) AS payload_bytes, sha1(p.body) AS payload_digest
FROM p LEFT JOIN g ON g.body = p.body
"""
