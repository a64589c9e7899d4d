"""Deterministic sharded WARC writer and reader (operator 9).

Records are range-sorted by page_id and payload digest; each range is one task's stream of gzip members, rolled to a new file when the
compressed size reaches ROLL_BYTES. Headers, record ids and digests are made anew from the content, dates are a parameter, so
a rerun writes the same bytes. Files get their final names by a rename when whole, and a manifest lists them with the place of every
member, so a reader takes each record from its place; archives without a manifest are read as a stream.

Of pages with equal payloads of at least LEAST bytes, the one with the smallest page_id is a response and the others are revisits
that name it; they carry no payload. The payload moves once: pages meet their record types in the range shuffle, not by a join.

Null html is an empty payload. A page with a null id is never the smallest; it is a response if no page with an id has its
payload. Rows with one id and one payload are written each, all of the same type; an id with several payloads has records of each.
Payloads of any length are one record. Further columns, whatever their names, are not read. No pages, no files.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, files

LEAST, ROLL_BYTES, DATE = 100, 32 << 20, "2024-01-01T00:00:00Z"
#: Bytes of archives that a task reads back, or one archive.
READ_BYTES = 4 << 20
_NAMES = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def _record_id(page, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page} {digest}')}>"


def record(page, url: str | None, payload: bytes, refers=None, date: str = DATE) -> bytes:
    """One gzip member: a response with the payload, or a revisit that refers to a page."""
    digest = hashlib.sha256(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers is not None else http + payload
    target = "".join(c for c in url or "" if c > " ") or f"urn:page:{page}"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers is not None else 'response'}",
        f"WARC-Record-ID: {_record_id(page, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        *([f"WARC-Refers-To: {_record_id(refers, digest)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers}"] if refers is not None else []),
        *([f"X-Page-Id: {page}"] if page is not None else []),
        f"X-Payload-Bytes: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", compresslevel=6, mtime=0)


def members(data: bytes, step: int = 1 << 13):
    """The uncompressed gzip members of an archive, one after the other; raises if one is cut off."""
    view, at = memoryview(data), 0
    while at < len(view):
        d, parts = zlib.decompressobj(31), []
        while not d.eof:
            if at >= len(view):
                raise ValueError("archive ends inside a record")
            parts.append(d.decompress(view[at : at + step]))
            at += step
        at = min(at, len(view)) - len(d.unused_data)
        yield b"".join(parts)


def records(data: bytes, places: list[int] | None = None):
    """(headers, block) of each gzip member of an archive, at the given places or one after the other; raises if one is damaged."""
    if places is None:
        each = members(data)
    else:
        each = (zlib.decompress(data[a:b], 31) for a, b in zip(places, [*places[1:], len(data)], strict=True))
    for whole in each:
        head, _, rest = whole.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        block = rest[: int(headers["Content-Length"])]
        if lines[0] != "WARC/1.1" or "sha256:" + hashlib.sha256(block).hexdigest() != headers["WARC-Block-Digest"]:
            raise ValueError("damaged record")
        yield headers, block


def record_types(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, digest, refers (the response's page_id) of the pages that are revisits, a row each (repeats once)."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    facts = pages.select(F.col("page_id").cast("long").alias("page_id"), F.octet_length(html).alias("n"), F.sha2(html, 256).alias("digest")).where(F.col("n") >= least)
    first = facts.groupBy("digest").agg(F.min("page_id").alias("refers"), F.count("*").alias("times")).where("times > 1 and refers is not null").select("digest", "refers")
    return facts.join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers"))).select("page_id", "digest", "refers").distinct()


def write(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, date: str = DATE) -> DataFrame:
    """Write archives below folder; returns the manifest (uri, records, bytes, places), saved there too."""
    spark = pages.sparkSession
    common.ready(spark)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"), F.lit(None).cast("long").alias("refers"), F.lit(1).alias("kind"))
    types = record_types(pages).select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", "refers", F.lit(0).alias("kind"))
    # A page's type has its page's keys, so both are in one range, the type first.
    keys = [F.col("page_id").asc_nulls_last(), F.col("digest")]
    both = types.union(p)
    parts = common.ranges(both, 1000)
    placed = common.ranged(both, keys, 1000, [*keys, F.col("kind"), F.col("url")], parts)

    def run(batches):
        from pyspark import TaskContext

        part, seq, out, size, now, refers = TaskContext.get().partitionId(), 0, [], 0, None, None

        def flush():
            uri = f"{folder}/archives/{part:08d}-{seq:06d}.warc.gz"
            files.write(uri, b"".join(out))
            places = np.cumsum([0, *map(len, out[:-1])])
            return pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([len(out)], pa.int64()), pa.array([size], pa.int64()), pa.array([places], pa.list_(pa.int64()))], names=["uri", "records", "bytes", "places"])

        for batch in batches:
            for id_, url, html, digest, to, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (id_, digest):
                    now, refers = (id_, digest), None
                if kind == 0:
                    refers = to
                    continue
                out.append(record(id_, url, html.encode("utf-8", "surrogatepass"), refers, date))
                size += len(out[-1])
                if size >= roll_bytes:
                    yield flush()
                    seq, out, size = seq + 1, [], 0
        if out:
            yield flush()

    return common.save_manifest(placed.mapInArrow(run, "uri string, records long, bytes long, places array<long>"), parts, folder)


def read(manifest: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record of the archives.

    A response's size and digest are taken from its payload and must equal the headers.
    """
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches):
        for batch in batches:
            for uri, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = []
                for h, block in records(files.read(uri), places):
                    digest, n, kind = h["WARC-Payload-Digest"].removeprefix("sha256:"), int(h["X-Payload-Bytes"]), h["WARC-Type"]
                    if kind == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        if (len(payload), hashlib.sha256(payload).hexdigest()) != (n, digest):
                            raise ValueError(f"payload and headers differ in {uri}")
                    rows.append((int(h["X-Page-Id"]) if "X-Page-Id" in h else None, n, digest, kind, int(h["X-Refers-To-Page"]) if "X-Refers-To-Page" in h else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=_NAMES)

    n = common.readers(manifest, "bytes", READ_BYTES)
    return manifest.select("uri", "places").repartition(n).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
