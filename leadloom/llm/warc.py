"""WARC archives of pages with a two-level capture index.

Writing: each task writes its pages as WARC/1.1 records, one gzip member each, into files of the archive's folder. Of equal payloads of at
least LEAST_BYTES bytes the one with the smallest page_id is a response record, the others are revisit records (identical-payload-digest
profile) that name it. A task returns its records' places; only files named in committed places belong to the archive, so a
task that is run again after a lost executor, or twice, does no harm.

Index: the places are sorted by reversed-host URL key (http://www.b.org/x?y is org,b,www)/x?y) over range partitions. Each is a shard file of
compressed blocks of BLOCK captures, followed by a sparse directory with the first key of every block. A table of the shards (one row each, as many
as partitions) is the upper level. A lookup finds a key's shards by binary search, reads the shard's directory and the one block
(or the blocks of a frequent key) that may hold it, by range reads, and then the records, by range reads in the order of their files.

Shard and archive files are written and read in tasks through pyarrow's file systems, so the folder must be of a kind that these know
(file, hdfs, s3, gs, abfs).

Cases: null html is an empty payload. Payloads under LEAST_BYTES bytes are all responses. Rows that repeat a page_id with its payload are the same
capture seen again: each is a record, all of one type. A null page_id is never the smallest unless a payload has no other. A null url
has the key "" and the target about:blank; white space and control characters of a url are percent-encoded in the record, not in the key; a
fragment isn't part of the key. A frequent key (a host, one url for a third of all pages) spans as many blocks and shards as it needs. Payloads are whole. Other
columns aren't read. An empty table makes an empty archive and an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm.common import as_bytes, released, written

#: Payloads below this size are never revisits.
LEAST_BYTES = 100
#: Captures of an index block; bytes after which a task begins a new archive file.
BLOCK, FILE_BYTES = 2000, 1 << 30
#: Neighbouring ranges of a file with at most GAP bytes between are read at once, up to READ bytes.
GAP, READ = 1 << 16, 1 << 23
#: Bytes of a file that one reading task takes.
STRETCH = 1 << 26

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: Column) -> Column:
    """The host's labels from last to first, the port, and path and query: the sort key of a capture. A url without a host is kept as it is behind ")"."""
    pattern = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(:[0-9]*)?([^#]*)"
    host = F.array_join(F.reverse(F.split(F.lower(F.regexp_extract(url, pattern, 1)), r"\.")), ",")
    surt = F.concat(host, F.regexp_extract(url, pattern, 2), F.lit(")"), F.regexp_extract(url, pattern, 3))
    return F.when(url.isNull(), "").when(url.rlike(pattern), surt).otherwise(F.concat(F.lit(")"), url))


def revisits(pages: DataFrame) -> DataFrame:
    """page_id, digest, refers_to and first_url of those pages whose payload is written by another page's record."""
    digests, _ = written(pages.select("page_id", F.sha2(as_bytes("html"), 256).alias("digest"), F.length(as_bytes("html")).alias("bytes"), "url"), "digests")
    large = digests.where(F.col("bytes") >= LEAST_BYTES)
    first = large.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.min_by("url", "page_id").alias("first_url"), F.count("*").alias("n")).where("n > 1")
    # Written, so that both sides are shuffled and a payload with many copies can be split.
    first, _ = written(first.drop("n"), "first")
    return large.join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "digest", "refers_to", "first_url").distinct()


# --- files --------------------------------------------------------------------------------------------------------


def _store(uri: str):
    """The file system of a folder, and the folder's path there."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


class _Output:
    """A new file in a folder, made when something is written; at is the next byte's place."""

    def __init__(self, folder: str, suffix: str):
        self.name, self.at = f"{uuid.uuid4().hex}{suffix}", 0
        self.store, path = _store(folder)
        self.store.create_dir(path, recursive=True)
        self.stream = self.store.open_output_stream(f"{path}/{self.name}", compression=None)

    def write(self, data: bytes) -> tuple[int, int]:
        start = self.at
        self.stream.write(data)
        self.at += len(data)
        return start, len(data)

    def close(self) -> None:
        self.stream.close()


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:x-page:{page_id}:{digest}>"


def _page_of(record_id: str) -> int | None:
    page = record_id.strip("<>").split(":")[2]
    return None if page == "None" else int(page)


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def _target(url: str | None) -> str:
    return "about:blank" if url is None else re.sub(r"[\x00-\x20\x7f-\xa0]", lambda x: "".join(f"%{c:02X}" for c in x[0].encode()), url)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, date: str, revisit: tuple[int | None, str | None] | None) -> bytes:
    """A page's record as a gzip member. revisit: page_id and url of the response that has the payload."""
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _record_id(page_id, digest)), ("WARC-Date", date), ("WARC-Target-URI", _target(url))]
    headers.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if revisit:
        headers += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", _record_id(revisit[0], digest)), ("WARC-Refers-To-Target-URI", _target(revisit[1])), ("WARC-Refers-To-Date", date)]
    headers.append(("Content-Type", "application/http; msgtype=response"))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return _member(headers, http + (b"" if revisit else payload))


def parsed(member: bytes) -> dict:
    """What a record says: page_id, url, record_type, refers_to, payload_bytes, payload_digest, and payload (None for a revisit).

    A response's size and digest are taken from its payload, which must agree with its headers; a revisit's are those that it states.
    """
    head, _, rest = zlib.decompress(member, 31).partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    headers = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(headers["Content-Length"])]
    if version != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a record")
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1]), headers["WARC-Payload-Digest"].removeprefix("sha256:")
    out = {"page_id": _page_of(headers["WARC-Record-ID"]), "url": headers["WARC-Target-URI"], "record_type": headers["WARC-Type"]}
    if out["record_type"] == "revisit":
        return out | {"refers_to": _page_of(headers["WARC-Refers-To"]), "payload_bytes": stated[0], "payload_digest": stated[1], "payload": None}
    found = len(payload), hashlib.sha256(payload).hexdigest()
    if found != stated:
        raise ValueError("a payload isn't what its record states")
    return out | {"refers_to": None, "payload_bytes": found[0], "payload_digest": found[1], "payload": payload}


# --- writing ------------------------------------------------------------------------------------------------------

_CAPTURE = "key string, page_id long, file string, offset long, length long"


def write(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", block: int = BLOCK, file_bytes: int = FILE_BYTES) -> None:
    """Writes pages (page_id, url, html) as an archive with its index into the folder path. date is the captures' date."""
    spark = pages.sparkSession

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            places = []
            names = ("page_id", "url", "digest", "found", "refers_to", "first_url")
            for payload, *row in zip(batch.column("payload"), *(batch.column(c).to_pylist() for c in names), strict=True):
                page_id, url, digest, found, refers_to, first_url = row
                if out is None or out.at >= file_bytes:
                    if out:
                        out.close()
                    out = _Output(f"{path}/archive", ".warc.gz")
                    info = b"software: leadloom\r\nformat: WARC File Format 1.1\r\n"
                    out.write(_member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], info))
                places.append((out.name, *out.write(record(page_id, url, payload.as_py(), digest, date, (refers_to, first_url) if found else None))))
            columns = [pa.array(x, t) for x, t in zip(zip(*places, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)] if places else [pa.array([], t) for t in (pa.string(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("page_id"), *columns], ["key", "page_id", "file", "offset", "length"])
        if out:
            out.close()

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, directory, held, last = None, [], [], ""

        def put() -> None:
            directory.append((held[0][0], *out.write(zlib.compress(json.dumps(held).encode()))))
            held.clear()

        for batch in batches:
            for row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                out = out or _Output(f"{path}/index", ".captures")
                held.append(row)
                last = row[0]
                if len(held) == block:
                    put()
        if out:
            if held:
                put()
            place = out.write(zlib.compress(json.dumps(directory).encode()))
            out.close()
            yield pa.RecordBatch.from_pylist([dict(zip(("file", "first_key", "last_key", "offset", "length"), (out.name, directory[0][0], last, *place), strict=True))])

    rows = pages.select("page_id", "url", url_key(F.col("url")).alias("key"), as_bytes("html").alias("payload"), F.sha2(as_bytes("html"), 256).alias("digest"))
    others = revisits(pages).select(F.col("page_id").alias("other"), F.col("digest").alias("other_digest"), "refers_to", "first_url", F.lit(True).alias("found"))
    rows = rows.join(others, rows["page_id"].eqNullSafe(others["other"]) & (rows["digest"] == others["other_digest"]), "left")
    # Written before they are sorted: finding the ranges would write the archive twice.
    places, places_path = written(rows.select("page_id", "url", "key", "payload", "digest", F.coalesce("found", F.lit(False)).alias("found"), "refers_to", "first_url").mapInArrow(archive, _CAPTURE), "places")
    order = ["key", "page_id", "file", "offset"]
    places.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(index, "file string, first_key string, last_key string, offset long, length long").write.parquet(f"{path}/shards")
    released(spark, places_path)


# --- reading ------------------------------------------------------------------------------------------------------


class _Shard:
    """A shard's directory and the block read last."""

    def __init__(self, folder: str, file: str, offset: int, length: int):
        store, path = _store(folder)
        self.file = store.open_input_file(f"{path}/{file}")
        self.directory = json.loads(zlib.decompress(self.file.read_at(length, offset)))
        self.first_keys = [x[0] for x in self.directory]
        self.block: tuple[int, list, list] = (-1, [], [])

    def _rows(self, k: int) -> tuple[list, list]:
        if self.block[0] != k:
            _, offset, length = self.directory[k]
            rows = json.loads(zlib.decompress(self.file.read_at(length, offset)))
            self.block = (k, rows, [x[0] for x in rows])
        return self.block[1:]

    def captures(self, key: str) -> Iterator[list]:
        k = max(0, bisect_left(self.first_keys, key) - 1)
        while k < len(self.directory) and self.first_keys[k] <= key:
            rows, keys = self._rows(k)
            yield from rows[bisect_left(keys, key) : bisect_right(keys, key)]
            k += 1


def lookup(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """key, page_id, file, offset and length of all captures of the given keys (column key, see url_key; a key that comes twice is answered once)."""
    # One row per shard, as many as the index has partitions.
    shards = sorted(spark.read.schema("file string, first_key string, last_key string, offset long, length long").parquet(f"{path}/shards").collect(), key=lambda x: (x.first_key, x.last_key))
    first_keys, last_keys = [x.first_key for x in shards], [x.last_key for x in shards]
    places = [(x.file, x.offset, x.length) for x in shards]

    def to_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(k, key) for key in batch.column("key").to_pylist() for k in range(bisect_left(last_keys, key), bisect_right(first_keys, key))]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.string())], ["shard", "key"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = -1, None
        types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        names = ["key", "page_id", "file", "offset", "length"]
        for batch in batches:
            found = []
            for k, key in zip(batch.column("shard").to_pylist(), batch.column("key").to_pylist(), strict=True):
                if k != number:
                    number, shard = k, _Shard(f"{path}/index", *places[k])
                for capture in shard.captures(key):
                    found.append(capture)
                    if len(found) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), types, strict=True)], names)
                        found = []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), types, strict=True)], names)

    asked = keys.where("key is not null").select("key").distinct().mapInArrow(to_shards, "shard int, key string")
    return asked.repartition("shard").sortWithinPartitions("shard", "key").mapInArrow(search, _CAPTURE)


_RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def records(captures: DataFrame, path: str, payload: bool = True) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest and, if wanted, payload of the captures' records."""
    schema = _RECORD + (", payload binary" if payload else "")
    types = dict(zip(("page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True))
    names = list(types)[: None if payload else -1]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _store(f"{path}/archive")
        name, file = None, None
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True))
            k = 0
            while k < len(rows):
                n, (_, start, length) = k + 1, rows[k]
                end = start + length
                while n < len(rows) and rows[n][0] == rows[k][0] and rows[n][1] - end <= GAP and rows[n][1] + rows[n][2] - start <= READ:
                    end = max(end, rows[n][1] + rows[n][2])
                    n += 1
                if rows[k][0] != name:
                    if file:
                        file.close()
                    name = rows[k][0]
                    file = store.open_input_file(f"{folder}/{name}")
                data = file.read_at(end - start, start)
                found = [parsed(data[o - start : o - start + size]) for _, o, size in rows[k:n]]
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], types[c]) for c in names], names)
                k = n

    dealt = captures.select("file", "offset", "length", F.floor(F.col("offset") / STRETCH).alias("stretch"))
    return dealt.repartition("file", "stretch").sortWithinPartitions("file", "offset").drop("stretch").mapInArrow(read, schema)


ORACLE_SQL = """
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM (
  SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id
  FROM (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages))
"""
