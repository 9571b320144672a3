"""WARC archives written and read as tables of record chunks.

Writing: a payload goes in as rows of (record, chunk number, bytes); it is cut before anything is shuffled, so exchanges
and sorts move bounded rows and Python holds one chunk at a time. Each task streams its records into gzip members, one a record, of archives that roll over at a size, and
returns the archives it finished; the manifest of finished archives is a table, so files of lost or repeated attempts are
never read. Of equal payloads one record is a response and the others are revisits of it.

Reading: an archive is inflated block by block. A record comes out as chunk rows, each with the SHA-1 and the length of the
payload up to that chunk, so the last one has those of the whole; no record is ever held as a whole.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.text import small_batches
from millrace.plans.materialize import materialize, new_path

#: Bytes of a chunk, and compressed bytes after which a task starts its next archive.
CHUNK, ROLL = 1 << 20, 64 << 20
_BLOCK = 1 << 18
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(data: Column) -> Column:
    """SHA-1 in upper-case base32, as WARC digests are written: each 40 bits are 8 digits of base 32."""
    hexed = F.sha1(data)
    digits = [F.lpad(F.conv(F.substring(hexed, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.upper(F.concat(*digits)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _base32(digest: bytes) -> str:
    import base64

    return base64.b32encode(digest).decode()


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme that Hadoop gives it: one without a scheme belongs to the default file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def _open(uri: str, write: bool):
    """A stream of a file in a store that Arrow knows under the scheme or under the one that Hadoop's stands for."""
    scheme, _, rest = uri.partition(":")
    if scheme == "file":
        store, name = fs.LocalFileSystem(), f"/{rest.lstrip('/')}"
    else:
        store, name = fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + ":" + quote(rest, safe="/:@?&=%"))
    if write:
        store.create_dir(name.rpartition("/")[0], recursive=True)
        return store.open_output_stream(name, compression=None)
    return store.open_input_stream(name, compression=None)


class _Archive:
    def __init__(self, folder: str):
        self.path, self.records, self.size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
        self.out, self.member = _open(self.path, True), None

    def write(self, data: bytes) -> None:
        part = self.member.compress(data)
        self.size += len(part)
        self.out.write(part)

    def begin(self, head: bytes) -> None:
        self.member = zlib.compressobj(6, zlib.DEFLATED, 31)
        self.records += 1
        self.write(head)

    def end(self) -> None:
        self.write(b"\r\n\r\n")
        part = self.member.flush()
        self.size += len(part)
        self.out.write(part)

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        return self.path, self.records, self.size


def _head(kind: str, key, url, digest: str, refers, length: int, date: str) -> bytes:
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:record:{'null' if key is None else key}>"), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%~")))
    fields.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if kind == "revisit":
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<urn:record:{refers}>")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(_HTTP) + length))]
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + b"\r\n" + _HTTP


def _write(folder: str, date: str):
    def run(batches):
        archive, done = None, []
        for b in batches:
            for key, url, digest, kind, refers, size, number, last, chunk in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if number == 0:
                    if archive and archive.size >= ROLL:
                        done.append(archive.close())
                        archive = None
                    archive = archive or _Archive(folder)
                    archive.begin(_head(kind, key, url, digest, refers, 0 if kind == "revisit" else size, date))
                if kind != "revisit" and chunk:
                    archive.write(chunk)
                if last:
                    archive.end()
        if archive:
            done.append(archive.close())
        yield pa.RecordBatch.from_pylist([{"path": p, "records": r, "bytes": s} for p, r, s in done], pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return run


def write_archives(records: DataFrame, key: str, url: str, payload: str, dedup_from: int = 0, folder: str | None = None) -> DataFrame:
    """Write a record for each row and return the manifest (path, records, bytes) of the archives.

    Null payloads are empty. Of records with equal payloads of at least ``dedup_from`` bytes those with the largest key
    are responses and the others revisit it (null keys are never the largest beside another; rows that repeat the largest
    key are all responses); smaller payloads are all responses. Null urls leave the field out. The key is kept in the
    record's identifier. Without rows there is no archive. Other columns are not read. ``folder`` is in a store that
    Arrow's file systems reach from the executors (local, S3, GCS, HDFS with its library).
    """
    spark = records.sparkSession
    small_batches(spark)
    folder = qualified(spark, folder or new_path(spark, "warc"))
    body = F.coalesce(F.col(payload).cast("binary"), F.lit("").cast("binary"))
    rows = records.select(F.col(key).alias("k"), F.col(url).alias("u"), body.alias("body"))
    rows = rows.select("k", "u", "body", F.octet_length("body").cast("long").alias("size"), sha1_base32(F.col("body")).alias("digest"))
    first = rows.where(F.col("size") >= dedup_from).groupBy("digest", "size").agg(F.max("k").alias("top"))
    pieces = F.greatest(F.lit(1), F.ceil(F.col("size") / CHUNK)).cast("int")
    chunks = rows.withColumn("record", F.monotonically_increasing_id()).select("*", pieces.alias("pieces"), F.explode(F.sequence(F.lit(0), pieces - 1)).alias("number"))
    chunks = chunks.select("record", "k", "u", "digest", "size", "pieces", "number", F.substring("body", F.col("number") * CHUNK + 1, F.lit(CHUNK)).alias("chunk"))
    chunks = chunks.join(first, ["digest", "size"], "left")
    is_response = F.col("top").isNull() | F.col("k").eqNullSafe(F.col("top"))
    chunks = chunks.where(is_response | (F.col("number") == 0)).sortWithinPartitions("record", "number")
    last = ~is_response | (F.col("number") == F.col("pieces") - 1)
    chunks = chunks.select("k", "u", "digest", F.when(is_response, "response").otherwise("revisit").alias("kind"), F.when(~is_response, F.col("top")).alias("refers"), "size", "number", last.alias("last"), F.when(is_response, F.col("chunk")).alias("chunk"))
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    manifest = chunks.mapInArrow(_write(folder, date), "path string, records long, bytes long")
    return materialize(manifest, "warc-manifest")


class _Inflated:
    """The inflated bytes of an archive (all gzip members in a row), read by line or by count."""

    def __init__(self, source):
        self.source, self.member, self.held, self.rest = source, zlib.decompressobj(31), b"", b""

    def _more(self) -> bool:
        data = self.rest or self.source.read(_BLOCK)
        if not data:
            return False
        if self.member.eof:
            self.member = zlib.decompressobj(31)
        part = self.member.decompress(data, _BLOCK)
        self.rest = self.member.unused_data if self.member.eof else self.member.unconsumed_tail
        self.held = self.held + part if self.held else part
        return True

    def line(self) -> bytes | None:
        while (end := self.held.find(b"\r\n")) < 0:
            if not self._more():
                return None
        out, self.held = self.held[:end], self.held[end + 2 :]
        return out

    def take(self, most: int) -> bytes:
        while not self.held:
            if not self._more():
                raise EOFError("the archive ends within a record")
        out, self.held = self.held[:most], self.held[most:]
        return out


def chunks_of(source, size: int = CHUNK) -> Iterator[dict]:
    """Chunk rows of an archive stream: type, id, uri, refers_to, declared digest, number, chunk, and SHA-1 (base32) and
    bytes of the payload so far; last marks the record's end."""
    data = _Inflated(source)
    while (version := data.line()) is not None:
        if not version:
            continue
        if not version.startswith(b"WARC/"):
            raise ValueError("no WARC record where one should begin")
        fields = {}
        while line := data.line():
            name, _, value = line.decode().partition(":")
            fields[name.lower()] = value.strip()
        left, http = int(fields["content-length"]), "application/http" in fields.get("content-type", "")
        while http and left:
            line = data.line()
            left -= len(line) + 2
            http = bool(line)
        bare = lambda n: fields[n].strip("<>").removeprefix("urn:record:") if n in fields else None
        base = {"type": fields["warc-type"], "id": bare("warc-record-id"), "uri": unquote(fields["warc-target-uri"]) if "warc-target-uri" in fields else None, "refers_to": bare("warc-refers-to"), "declared": fields.get("warc-payload-digest", "").removeprefix("sha1:")}
        sha, so_far, number = hashlib.sha1(), 0, 0
        while True:
            parts, room = [], min(left, size)
            while room:
                parts.append(data.take(room))
                room -= len(parts[-1])
            chunk = b"".join(parts)
            left -= len(chunk)
            so_far += len(chunk)
            sha.update(chunk)
            yield base | {"number": number, "chunk": chunk, "sha1": _base32(sha.digest()), "bytes": so_far, "last": left == 0}
            number += 1
            if not left:
                break


_CHUNKS = "archive string, type string, id string, uri string, refers_to string, declared string, number int, chunk binary, sha1 string, bytes long, last boolean"


def read_chunks(manifest: DataFrame, with_bytes: bool = True, size: int = CHUNK) -> DataFrame:
    """The chunk rows of all archives of a manifest, an archive to a task; without bytes, ``chunk`` is null."""
    schema = pa.schema([("archive", pa.string()), *((n, pa.string()) for n in ("type", "id", "uri", "refers_to", "declared")), ("number", pa.int32()), ("chunk", pa.binary()), ("sha1", pa.string()), ("bytes", pa.int64()), ("last", pa.bool_())])

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                with _open(path, False) as source:
                    rows, held = [], 0
                    for row in chunks_of(source, size):
                        row["archive"] = path
                        if not with_bytes:
                            row["chunk"] = None
                        held += len(row["chunk"] or b"")
                        rows.append(row)
                        if held >= 8 * CHUNK or len(rows) >= 4096:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)

    spread = manifest.select("path").repartition(max(1, min(8192, manifest.count())))
    return spread.mapInArrow(run, _CHUNKS)


def record_digests(manifest: DataFrame) -> DataFrame:
    """(id, payload_bytes, payload_digest, type, refers_to) of each record; a revisit's are those of its response, whose
    payload was read. A response whose payload does not have the digest it declares fails the job."""
    ends = materialize(read_chunks(manifest, with_bytes=False).where("last"), "warc-records")
    response = ends.where("type = 'response'")
    sound = F.when(F.col("sha1") == F.col("declared"), F.col("sha1")).otherwise(F.raise_error(F.concat(F.lit("payload digest differs: "), F.coalesce("id", F.lit("null")))))
    whole = response.select("id", F.col("bytes").alias("payload_bytes"), sound.alias("payload_digest"), "type", F.lit(None).cast("string").alias("refers_to"))
    sizes = whole.select(F.col("id").alias("refers_to"), F.col("payload_digest").alias("declared"), "payload_bytes").distinct()
    revisit = ends.where("type = 'revisit'").select("id", "declared", "refers_to").join(sizes, ["refers_to", "declared"])
    return whole.unionByName(revisit.select("id", "payload_bytes", F.col("declared").alias("payload_digest"), F.lit("revisit").alias("type"), "refers_to"))
