"""WARC archives: written as one gzip member a record, read as a stream.

The reader takes an archive in blocks and inflates it step by step; a member ends where zlib says so, a record's
payload where its content length says so, and its digest is verified. Memory holds one block and one record.

Archives are files in a folder that driver and executors share. A task writes under a name of its own and renames it
when it is whole, so a task that runs twice leaves one archive; the list of archives is a table, and only archives on
it are read.

Null payloads count as empty. Among records with equal payloads of least_bytes or more, the one with the largest id is
the response and the others are revisits of it; rows that repeat that id and payload are responses too. Where all ids
of a group are null they are all responses. An empty table gives no archive and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import os
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, byte_slices, materialize, new_path, ship

BLOCK = 1 << 16
#: Fixed values of the WARC 1.1 standard.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def sha1_base32(payload: bytes) -> str:
    """The digest that WARC headers carry."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, name: str, uri: str, payload: bytes, refers_to: str | None = None) -> bytes:
    """A gzip member with one record. A revisit keeps the payload's digest and length, not its bytes."""
    block = b"" if kind == "revisit" else payload
    fields = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:granary:{name}>", "WARC-Date": DATE, "WARC-Target-URI": uri, "WARC-Payload-Digest": f"sha1:{sha1_base32(payload)}", "WARC-Block-Digest": f"sha1:{sha1_base32(block)}"}
    if kind == "revisit":
        fields |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": f"<urn:granary:{refers_to}>", "X-Payload-Length": str(len(payload))}
    fields |= {"Content-Type": "text/html; charset=utf-8", "Content-Length": str(len(block))}
    text = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(f"{VERSION}\r\n{text}\r\n".encode() + block + b"\r\n\r\n") + packer.flush()


def members(blocks: Iterator[bytes]) -> Iterator[bytes]:
    """The inflated gzip members of a stream; raises ValueError where it is cut short or damaged."""
    inflater, parts, begun = zlib.decompressobj(31), [], False
    for data in blocks:
        while data:
            begun = True
            try:
                parts.append(inflater.decompress(data))
            except zlib.error as e:
                raise ValueError(f"a gzip member is damaged: {e}") from e
            data = inflater.unused_data
            if inflater.eof:
                yield b"".join(parts)
                inflater, parts, begun = zlib.decompressobj(31), [], False
    if begun:
        raise ValueError("the archive ends within a gzip member")


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """The headers, with names in lower case, and the block of a record; its frame and digest are verified."""
    head, mark, rest = member.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not mark or not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    n = int(fields["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("the block does not end where its length says")
    block = rest[:n]
    if "warc-block-digest" in fields and fields["warc-block-digest"] != f"sha1:{sha1_base32(block)}":
        raise ValueError("the block does not have its digest")
    if fields.get("warc-type") == "response" and fields["warc-payload-digest"] != f"sha1:{sha1_base32(block)}":
        raise ValueError("the payload does not have its digest")
    return fields, block


def read_blocks(uri: str) -> Iterator[bytes]:
    """A file's bytes, a block at a time."""
    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_stream(path, compression=None) as f:
        while block := f.read(BLOCK):
            yield block


def as_uri(path: str) -> str:
    """A path with its scheme."""
    return path if "://" in path else path.replace("file:", "file://", 1) if path.startswith("file:") else f"file://{os.path.abspath(path)}"


def decide(pages: DataFrame, least_bytes: int, id_col: str, payload_col: str) -> DataFrame:
    """pages with _refers: the id that a revisit refers to, else null."""
    digest = F.sha2(F.coalesce(F.col(payload_col), F.lit("")), 256)
    keyed = pages.withColumn("_digest", digest)
    counted = keyed.filter(F.octet_length(F.coalesce(F.col(payload_col), F.lit(""))) >= least_bytes)
    groups = counted.groupBy("_digest").agg(F.max(id_col).alias("_keeper"), F.count("*").alias("_rows")).filter("_rows > 1")
    groups = materialize(groups, "warc-groups")
    total = groups.agg(F.sum("_rows")).first()[0] or 0
    if not total:
        return pages.withColumn("_refers", F.lit(None).cast(pages.schema[id_col].dataType))
    joined = attach(keyed, groups, ["_digest"], ["_keeper"], "_rows", total, id_col)
    return joined.withColumn("_refers", F.when(~F.col("_keeper").eqNullSafe(F.col(id_col)), F.col("_keeper"))).drop("_digest", "_keeper")


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write a record of every row; returns the table of archives (archive, records, bytes)."""
    ship(pages.sparkSession)
    base = as_uri(folder)
    names = {"id": id_col, "uri": uri_col, "payload": payload_col}
    rows = decide(pages.select(*[F.col(v).alias(f"_{k}") for k, v in names.items()]), least_bytes, "_id", "_payload")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name = f"part-{TaskContext.get().partitionId():06d}.warc.gz"
        store, path = fs.FileSystem.from_uri(base)
        store.create_dir(path, recursive=True)
        own, records, size = f"{path}/.{name}.{uuid.uuid4().hex}", 0, 0
        out = None
        for batch in byte_slices(batches, 2):
            for r in batch.to_pylist():
                out = out or store.open_output_stream(own, compression=None)
                kind = "response" if r["_refers"] is None else "revisit"
                data = record(kind, "null" if r["_id"] is None else str(r["_id"]), urllib.parse.quote(r["_uri"] or "", safe=":/?#[]@!$&'()*+,;=%~"), (r["_payload"] or "").encode(), r["_refers"])
                out.write(data)
                records, size = records + 1, size + len(data)
        if out:
            out.close()
            store.move(own, f"{path}/{name}")
            yield pa.RecordBatch.from_pydict({"archive": [f"{base}/{name}"], "records": pa.array([records], pa.int64()), "bytes": pa.array([size], pa.int64())})

    return materialize(rows.mapInArrow(write, "archive string, records long, bytes long"), "warc-list")


def read_archives(archives: DataFrame) -> DataFrame:
    """A row for each record of the archives of column archive, read in a stream, one task an archive.

    (archive, record_type, record_id, target_uri, refers_to, payload_digest, payload_bytes, payload); the payload of a
    revisit is null, its digest and size are those of the payload it stands for.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("archive", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
        bare = lambda x: x.removeprefix("<urn:granary:").removesuffix(">") if x else None
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                rows, held = [], 0
                for member in members(read_blocks(archive)):
                    fields, block = parse(member)
                    revisit = fields["warc-type"] == "revisit"
                    rows.append({"archive": archive, "record_type": fields["warc-type"], "record_id": bare(fields["warc-record-id"]), "target_uri": fields.get("warc-target-uri"), "refers_to": bare(fields.get("warc-refers-to")), "payload_digest": fields["warc-payload-digest"].removeprefix("sha1:"), "payload_bytes": int(fields["x-payload-length"]) if revisit else len(block), "payload": None if revisit else block})
                    held += len(block)
                    if held > 1 << 22 or len(rows) >= 1024:
                        yield pa.RecordBatch.from_pylist(rows, kinds)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, kinds)

    n = max(1, archives.count())
    listed = archives.select("archive").repartitionByRange(n, "archive")
    return listed.mapInArrow(read, "archive string, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary")


def archive_folder(spark: SparkSession) -> str:
    """A fresh shared folder for archives."""
    return new_path(spark, "warc")
