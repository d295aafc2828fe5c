import base64
import gzip
import hashlib
import random

from pyarrow import fs

from tidemark.llm.warc import parse_record, read_archives, read_members, write_archives

from . import brute


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], "page_id long, url string, html string, digest string, record int")


def want(rows, least=0):
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        same = [j for j, _, g in rows if (g or "") == (h or "")]
        original = min(same) if len(data) >= least else i
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if original == i else "revisit", None if original == i else original))
    return sorted(out)


def cases():
    rng = random.Random(2)
    bodies = [None, "", "é" * 500, "<p>a</p>", "\r\n\r\nWARC/1.1\r\n\r\n", "x" * 200000, "𝄞"]
    return [(k * 5 - 20, rng.choice(["http://a/é", None, "http://b/\r\nX: y"]), rng.choice([*bodies, f"own {k}"])) for k in range(120)]


def test_round_trip(spark, tmp_path):
    for least in (0, 600):
        listing = write_archives(pages(spark, cases()), f"file://{tmp_path}/{least}", min_bytes=least)
        got = brute.rows(read_archives(spark, listing))
        assert sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want(cases(), least)
        html = {i: (h or "").encode() for i, _, h in cases()}
        assert all(bytes(r["payload"]) == html[r["page_id"]] for r in got if r["record_type"] == "response")
        system, path = fs.FileSystem.from_uri(listing.first()["file"])
        assert gzip.decompress(system.open_input_stream(path, compression=None).read()).startswith(b"WARC/1.1\r\nWARC-Type: ")


def test_null_and_repeated_ids_and_empty_table(spark, tmp_path):
    rows = [(None, "u", "a"), (3, "u", "a"), (3, "u", "a"), (4, "u", "a"), (None, "u", "b"), (None, "u", "b")]
    got = brute.rows(read_archives(spark, write_archives(pages(spark, rows), f"file://{tmp_path}/n")))
    assert sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in got), key=str) == sorted(
        [(None, "revisit", 3), (3, "response", None), (3, "response", None), (4, "revisit", 3), (None, "response", None), (None, "response", None)], key=str)
    assert read_archives(spark, write_archives(pages(spark, []), f"file://{tmp_path}/e")).count() == 0


def test_record_ids_and_references(spark, tmp_path):
    rows = [(None, "u", "a"), (None, "v", "a"), (3, "http://x/1", "a"), (3, "http://x/2", "a"), (3, "w", "b"), (4, None, "a"), (5, "z", "b")]
    listing = write_archives(pages(spark, rows), f"file://{tmp_path}/i", date="2024-05-06T07:08:09Z").collect()
    records, infos = [], []
    for r in listing:
        system, path = fs.FileSystem.from_uri(r["file"])
        with system.open_input_stream(path, compression=None) as f:
            members = [parse_record(m)[0] for m in read_members(f)]
        assert members[0]["WARC-Type"] == "warcinfo" and len(members) == r["records"] + 1
        infos += members[:1]
        records += members[1:]
    ids = [h["WARC-Record-ID"] for h in infos + records]
    assert len(set(ids)) == len(ids) and len(records) == len(rows)
    assert {h["WARC-Warcinfo-ID"] for h in records} <= {h["WARC-Record-ID"] for h in infos}
    by_id = {h["WARC-Record-ID"]: h for h in records}
    revisits = [h for h in records if h["WARC-Type"] == "revisit"]
    assert len(revisits) == 4
    for h in revisits:
        first = by_id[h["WARC-Refers-To"]]
        assert first["WARC-Type"] == "response" and first["X-Page-Id"] == "3" and first["WARC-Payload-Digest"] == h["WARC-Payload-Digest"]
        assert h["WARC-Refers-To-Target-URI"] == first["WARC-Target-URI"] and h["WARC-Refers-To-Date"] == first["WARC-Date"] == "2024-05-06T07:08:09Z"
    assert len({h["WARC-Refers-To"] for h in revisits}) == 2
