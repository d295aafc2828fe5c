"""Web archives in which a payload is stored once: later records of it are revisits that refer to the original.

Headers (page id and payload digest) are shuffled by digest to find each payload's first page; pages then get their
role by page id, so that a payload shared by very many pages never gathers those pages in one task. Responses are
written first, with fresh record ids; the few that revisits refer to come back as an index of ids, URIs and dates.
Revisits hold no payload, so they are made from headers joined to that index.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import outputs
from .batches import schema_of
from .shared import cut, partitions

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE = "X-Page-Id"


def b32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _record(head: list[str], block: bytes) -> bytes:
    """A record in a gzip member of its own."""
    lines = ["WARC/1.1", *head, f"WARC-Block-Digest: sha1:{b32(hashlib.sha1(block).digest())}", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(1, wbits=31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def make_info(record: str, date: str, name: str) -> bytes:
    fields = b"software: tidemark\r\nformat: WARC File Format 1.1\r\n"
    return _record(["WARC-Type: warcinfo", f"WARC-Record-ID: {record}", f"WARC-Date: {date}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields"], fields)


def clean_uri(url: str | None) -> str:
    return "".join(c for c in url or "" if c not in "\r\n") or "urn:x-unknown"


def make_record(record: str, info: str, page_id: int | None, uri: str, digest: str, size: int, date: str, payload: bytes | None, original: tuple[str, str, str] | None) -> bytes:
    """A response with its payload of size bytes or, with (record id, URI, date) of an original, a revisit, which holds the HTTP head only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = [
        f"WARC-Type: {'revisit' if original else 'response'}", f"WARC-Record-ID: {record}", f"WARC-Warcinfo-ID: {info}", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}",
        "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if page_id is not None:
        head.append(f"{PAGE}: {page_id}")
    if original:
        head += [f"WARC-Profile: {PROFILE}", *(f"WARC-Refers-To{name}: {x}" for name, x in zip(("", "-Target-URI", "-Date"), original, strict=True))]
    return _record(head, http + (payload or b""))


def read_members(file) -> Iterator[bytes]:
    """The gzip members of a file, one after another."""
    rest = b""
    while rest or (rest := file.read(1 << 20)):
        member, out = zlib.decompressobj(wbits=31), []
        while not member.eof:
            if not rest and not (rest := file.read(1 << 20)):
                raise ValueError("an archive ends within a record")
            out.append(member.decompress(rest))
            rest = member.unused_data if member.eof else b""
        yield b"".join(out)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(headers, HTTP head, payload) of a record; raises ValueError where its digests or length don't hold."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    headers = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(headers["Content-Length"])]
    if not version.startswith("WARC/") or len(rest) != len(block) + 4 or headers["WARC-Block-Digest"] != "sha1:" + b32(hashlib.sha1(block).digest()):
        raise ValueError("a record is damaged")
    http, _, payload = block.partition(b"\r\n\r\n")
    if headers["WARC-Type"] == "response" and headers["WARC-Payload-Digest"] != "sha1:" + b32(hashlib.sha1(payload).digest()):
        raise ValueError("a payload doesn't have its digest")
    return headers, http, payload


def _heads(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    return pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.sha1(payload.cast("binary")).alias("digest"),
        F.octet_length(payload).cast("long").alias("size"), payload.alias("payload"),
    )


def _later() -> Column:
    """Whether a page comes after its payload's first one."""
    return F.col("page_id").isNull() | (F.col("page_id") > F.col("first_id"))


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, date: str | None = None,
) -> DataFrame:
    """Writes a WARC record per page to folder, after a warcinfo record in each file, and returns the listing of files.

    The payload is the UTF-8 of payload_col; null counts as empty. Of pages with equal payloads of min_bytes or more the
    one with the smallest id is a response, the others revisit it; shorter ones are all responses. Rows that repeat the
    smallest id are responses too, of which the one with the smallest record id is referred to. A null id comes after all
    others; if all are null, all are responses. Record ids are random, so no two records share one, whatever repeats.
    A null url becomes urn:x-unknown. Other columns are neither read nor kept. An empty table gives no files.
    """
    spark = pages.sparkSession
    outputs.make(folder)
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    heads = _heads(pages, id_col, url_col, payload_col)
    firsts = heads.where(F.col("size") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    firsts = cut(firsts.where("n > 1 AND first_id IS NOT NULL").select("digest", "first_id"), "originals")
    roles = heads.select("page_id", "digest").join(firsts, "digest").select(F.col("page_id").alias("role_id"), F.col("digest").alias("role_digest"), _later().alias("later")).distinct()
    own = heads["page_id"].eqNullSafe(F.col("role_id")) & (heads["digest"] == F.col("role_digest"))
    whole = heads.join(roles, own, "left").where("later IS NULL OR NOT later").select("page_id", "url", "digest", "size", "payload", F.col("later").isNotNull().alias("original"))
    responses = cut(whole.mapInArrow(_writer(folder, date, "response"), _WRITTEN), "responses")

    index = responses.where("digest IS NOT NULL").groupBy("digest").agg(F.min(F.struct("record", "uri", "date")).alias("original"))
    later = heads.select("page_id", "url", "digest", "size").join(firsts, "digest").where(_later()).join(index, "digest")
    revisits = cut(later.select("page_id", "url", "digest", "size", "original.*").mapInArrow(_writer(folder, date, "revisit"), _WRITTEN), "revisits")
    return responses.unionByName(revisits).where("file IS NOT NULL").select("part", "file", "records")


#: A row for a file, and rows for the responses that revisits refer to.
_WRITTEN = "part int, file string, records long, digest string, record string, uri string, date string"


def _writer(folder: str, date: str, kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    _, arrow = schema_of(_WRITTEN)
    fresh = lambda: f"<urn:uuid:{uuid.uuid4()}>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, file, info = TaskContext.get().partitionId(), 0, None, fresh()
        name = outputs.fresh(folder, part, ".warc.gz")
        for batch in batches:
            rows: list[tuple] = []
            for k in range(batch.num_rows):
                page_id, url, digest, size, *rest = (c[k].as_py() for c in batch.columns)
                if file is None:
                    file = outputs.writer(name)
                    file.write(make_info(info, date, name.rsplit("/", 1)[-1]))
                record, uri = fresh(), clean_uri(url)
                payload, original = (rest[0].encode(), None) if kind == "response" else (None, tuple(rest))
                file.write(make_record(record, info, page_id, uri, b32(bytes.fromhex(digest)), size, date, payload, original))
                n += 1
                if kind == "response" and rest[1]:
                    rows.append((None, None, None, digest, record, uri, date))
            if rows:
                yield _batch(rows, arrow)
        if file:
            file.close()
            yield _batch([(part, name, n, None, None, None, None)], arrow)

    return run


def read_archives(spark: SparkSession, listing: DataFrame, with_payload: bool = True) -> DataFrame:
    """Reads the files of a listing back and resolves revisits.

    Returns a row per record: page_id, url, payload_bytes, payload_digest (base32 SHA-1), record_type, refers_to (the
    original's page id, for revisits) and, with_payload, payload (of a revisit, null). Pages of null html have an empty
    payload; null and repeated page ids and repeated rows are records each. A listing without files gives no rows.
    """
    kinds, arrow = schema_of("page_id long, url string, payload_bytes long, payload_digest string, record_type string, record string, original string" + (", payload binary" if with_payload else ""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows: list[tuple] = []
                held = 0
                with outputs.reader(name) as f:
                    for data in read_members(f):
                        headers, http, payload = parse_record(data)
                        if headers["WARC-Type"] == "warcinfo":
                            continue
                        size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
                        page, kind = headers.get(PAGE), headers["WARC-Type"]
                        row = (None if page is None else int(page), headers["WARC-Target-URI"], size, headers["WARC-Payload-Digest"].removeprefix("sha1:"), kind, headers["WARC-Record-ID"], headers.get("WARC-Refers-To"))
                        rows.append((*row, payload if kind == "response" else None) if with_payload else row)
                        held += len(payload) if with_payload else 100
                        if held > 1 << 22:
                            yield _batch(rows, arrow)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows, arrow)

    files = listing.repartition(partitions(spark), "part").select("file")
    records = cut(files.mapInArrow(run, kinds), "records")
    names = records.where("record_type = 'response' AND page_id IS NOT NULL").select(F.col("record").alias("original"), F.col("page_id").alias("refers_to")).distinct()
    revisits = records.where("record_type = 'revisit'").join(names, "original", "left")
    columns = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["payload"] if with_payload else [])]
    return records.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long")).select(columns).unionByName(revisits.select(columns))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
