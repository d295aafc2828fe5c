import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyarrow import fs
from tokenizers import Tokenizer

from tidemark.llm import records
from tidemark.llm.records import read_at, read_offsets, read_token_records, write_token_records

from . import brute
from .test_packing import texts


def want(rows):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    out, start = [], 0
    for i, text in sorted(rows):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_round_trip(spark, tmp_path):
    rows = [(k * 3, t) for k, t in enumerate(texts())] + [(10**12, None), (-4, "first")]
    listing = write_token_records(brute.documents(spark, rows[::-1]), f"file://{tmp_path}/out")
    got = brute.rows(read_token_records(spark, listing))
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) == want(rows)
    parts = listing.collect()
    assert [p["part"] for p in parts] == sorted(p["part"] for p in parts) and sum(p["documents"] for p in parts) == len(rows)
    # A shuffled read by the index.
    system, path = fs.FileSystem.from_uri(parts[1]["records_file"])
    offsets = read_offsets(parts[1]["index_file"])
    with system.open_input_file(path) as f:
        ids = {records.parse(read_at(f, int(o)))[0] for o in offsets[::-1]}
    assert len(ids) == len(offsets) == parts[1]["documents"]


def test_damage_is_noticed():
    good = records.frame(records.payload(None, np.array([1, 70000]), True))
    assert records.parse(next(records.read_records(io.BytesIO(good))))[0] is None
    for k in (0, 9, 20, len(good) - 1):
        bad = bytearray(good)
        bad[k] ^= 1
        with pytest.raises(ValueError):
            list(records.read_records(io.BytesIO(bytes(bad))))
    with pytest.raises(ValueError):
        list(records.read_records(io.BytesIO(good[:-6])))


def test_empty_table_and_repeated_ids(spark, tmp_path):
    assert read_token_records(spark, write_token_records(brute.documents(spark, []), f"file://{tmp_path}/a")).count() == 0
    rows = [(None, "x"), (2, "a"), (2, "a"), (2, "b")]
    got = brute.rows(read_token_records(spark, write_token_records(brute.documents(spark, rows), f"file://{tmp_path}/b")))
    assert sorted(r["start"] for r in got) == [0, 2, 4, 6] and next(r["start"] for r in got if r["doc_id"] is None) == 0
