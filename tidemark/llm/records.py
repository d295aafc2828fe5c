"""Token ids as length-delimited binary records, with a separate index of offsets for shuffled reads.

A record is a 64-bit length, its masked checksum, the payload and the payload's masked checksum, all little-endian. A
payload is the document id, a flag word and the ids, of 16 bits where the vocabulary allows it, else 32. The mask turns
the CRC-32 by 15 bits and adds a constant, so that a checksum of bytes that hold checksums stays of use.
An index file is the number of records and the 64-bit offset of each in its records file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import outputs
from . import words as W
from .batches import schema_of
from .shared import cut, partitions
from .tokens import SLICE_BYTES, encoder, vocabulary

MASK = 0xA282EAD8
WIDE, NO_ID = 1, 2
_HEAD = struct.Struct("<QI")
_TAIL = struct.Struct("<I")
_OWN = struct.Struct("<qI")


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return length + _TAIL.pack(masked(length)) + payload + _TAIL.pack(masked(payload))


def payload(doc_id: int | None, ids: np.ndarray, wide: bool) -> bytes:
    return _OWN.pack(doc_id or 0, WIDE * wide | NO_ID * (doc_id is None)) + ids.astype("<u4" if wide else "<u2").tobytes()


def parse(data: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, flags = _OWN.unpack_from(data)
    return None if flags & NO_ID else doc_id, np.frombuffer(data, "<u4" if flags & WIDE else "<u2", offset=_OWN.size)


def read_records(file) -> Iterator[bytes]:
    """Payloads of a records file in order; raises ValueError where a checksum doesn't hold."""
    while head := file.read(_HEAD.size):
        length, check = _HEAD.unpack(head)
        if masked(head[:8]) != check:
            raise ValueError("a record's length is damaged")
        data = file.read(length)
        if len(data) != length or _TAIL.unpack(file.read(4))[0] != masked(data):
            raise ValueError("a record is damaged")
        yield data


def read_offsets(uri: str) -> np.ndarray:
    with outputs.reader(uri) as f:
        (n,) = struct.unpack("<Q", f.read(8))
        return np.frombuffer(f.read(8 * n), "<u8")


def read_at(system_file, offset: int) -> bytes:
    """The payload of one record of a file that can seek."""
    system_file.seek(offset)
    return next(read_records(system_file))


_LISTING = "part int, records_file string, index_file string, documents long, ids long"


def write_token_records(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = 0) -> DataFrame:
    """Writes the documents' ids to folder, in ascending order of document ids, a records and an index file a part.

    A document is its text's ids by the vocabulary file at path (byte_bpe_50k by default), without special tokens, then
    end_id. Null text counts as empty. Null ids come first; rows of equal ids go by a hash of their texts. Other columns
    are neither read nor kept. An empty table gives no files.

    Returns the listing, a row per part in order: part, records_file, index_file, documents, ids.
    """
    spark = docs.sparkSession
    path = path or vocabulary("byte_bpe_50k.json")
    outputs.make(folder)
    kinds, arrow = schema_of(_LISTING)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    ranged = base.repartitionByRange(partitions(spark), "id", "h").sortWithinPartitions("id", "h").select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(path, keep_blanks=True), TaskContext.get().partitionId()
        wide = max(end_id, encode.tokenizer.get_vocab_size() - 1) >= 1 << 16
        records, index = outputs.fresh(folder, part, ".rec"), outputs.fresh(folder, part, ".idx")
        file, offsets, place, total = None, [], 0, 0
        for batch in batches:
            for row, data, bounds in W.slices(batch.column(1), SLICE_BYTES):
                ids, at = encode.ids(data, bounds)
                ids = np.insert(ids, at[1:], end_id)
                at = (at + np.arange(len(at))).tolist()
                file = file or outputs.writer(records)
                for doc_id, lo, hi in zip(batch.column(0).slice(row, len(bounds) - 1).to_pylist(), at[:-1], at[1:], strict=True):
                    record = frame(payload(doc_id, ids[lo:hi], wide))
                    file.write(record)
                    offsets.append(place)
                    place += len(record)
                    total += hi - lo
        if file:
            file.close()
            with outputs.writer(index) as f:
                f.write(struct.pack("<Q", len(offsets)) + np.array(offsets, "<u8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((part, records, index, len(offsets), total), arrow.types, strict=True)], schema=arrow)

    return cut(ranged.mapInArrow(run, kinds), "listing").orderBy("part")


def read_token_records(spark: SparkSession, listing: DataFrame, with_ids: bool = True) -> DataFrame:
    """Reads the files of a listing back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (as little-endian unsigned 32-bit integers) and, with_ids, ids.

    A row per record: documents of null or empty text have one id, the end; null ids stay null, and repeated ids and rows are
    records each. A listing without files gives no rows. A checksum that doesn't fit is an error.
    """
    kinds, arrow = schema_of("doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = listing.select("part", "records_file", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("before"))  # a row a part
    files = files.repartition(partitions(spark), "part").select("records_file", "before")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows: list[tuple] = []
                size = 0
                with outputs.reader(name) as f:
                    for data in read_records(f):
                        doc_id, ids = parse(data)
                        rows.append((doc_id, before, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), *([ids] if with_ids else [])))
                        before += len(ids)
                        size += len(ids) if with_ids else 1
                        if size > 1 << 20:
                            yield _batch(rows, arrow)
                            rows, size = [], 0
                if rows:
                    yield _batch(rows, arrow)

    return files.mapInArrow(run, kinds)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
