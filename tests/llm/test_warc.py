import gzip
import hashlib
import io

import pytest

from tidemark.llm import warc
from tidemark.llm.common import fresh_path

BIG = "x" * 100


def pages(spark, rows):
    # extra columns have names that the operator uses itself
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, digest string, same int")


def test_revisits_name_the_smallest_page(spark):
    rows = [(3, "u3", BIG), (1, "u1", BIG), (2, None, "short"), (4, "u\r\n4", "short"), (5, "u5", None), (6, "u6", ""), (1, "u1", BIG), (None, "u", BIG), (8, "é", "ünï" * 50)]
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(spark, pages(spark, rows)).collect()), key=str)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = [(i, len((h or "").encode()), sha(h or ""), "revisit" if h == BIG and i != 1 else "response", 1 if h == BIG and i != 1 else None) for i, _, h in rows]
    assert got == sorted(expected, key=str)


def test_null_ids_alone_never_name_a_group(spark):
    got = warc.round_trip(spark, pages(spark, [(None, "a", BIG), (None, "b", BIG)])).collect()
    assert [(r.page_id, r.record_type, r.refers_to) for r in got] == [(None, "response", None)] * 2


def test_empty_table(spark):
    assert warc.round_trip(spark, pages(spark, [])).collect() == []


@pytest.mark.parametrize("split", [7, 64, 1000, 1 << 20])
def test_every_split_size_reads_each_record_once(spark, split):
    rows = [(i, f"u{i}", f"page {i} " * (i * 7 % 300)) for i in range(60)]
    manifest = warc.write_warc(pages(spark, rows), fresh_path(spark, "warc"))
    if split < 1000:
        # many tiny splits: read them here, as tasks would
        got = []
        for r in manifest.collect():
            store, at = warc.open_store(r.path)
            data = store.open_input_file(at).read()
            got += [x[0] for s in range(0, len(data), split) for x in warc.records_in(io.BytesIO(data), s, min(len(data), s + split))]
    else:
        got = [r.record_id for r in warc.read_warc(manifest, split).collect()]
    assert sorted(map(int, got)) == list(range(60))


def test_members_are_gzip_and_magic_inside_a_payload_is_no_record():
    inner = warc.member(9, "inner", b"inner payload", "0" * 64, None)
    payload = b"\x1f\x8b\x08 junk " + inner[:40]
    a, b = warc.member(1, "u", payload, hashlib.sha256(payload).hexdigest(), None), warc.member(2, "u", b"", hashlib.sha256(b"").hexdigest(), 1)
    noise = b"\x1f\x8b\x08\x00\x00"
    data = a + noise + gzip.compress(b"not a record") + b
    assert gzip.decompress(a).startswith(b"WARC/1.1\r\n")
    got = list(warc.records_in(io.BytesIO(data), 0, len(data)))
    assert [(r[0], r[2], r[3], r[5]) for r in got] == [("1", "response", len(payload), None), ("2", "revisit", 0, "1")]
    assert got[0][6] == payload


def test_large_record_spans_views():
    import os

    payload = os.urandom(3 << 20)
    data = warc.member(1, "u", payload, "d", None) + warc.member(2, "u", b"z", "d", None)
    got = list(warc.records_in(io.BytesIO(data), 0, 10)) + list(warc.records_in(io.BytesIO(data), 10, len(data)))
    assert [r[0] for r in got] == ["1", "2"] and got[0][6] == payload


def test_payloads_can_be_read_back(spark):
    manifest = warc.write_warc(pages(spark, [(1, "u", "häll"), (2, "u", BIG), (3, "u", BIG)]), fresh_path(spark, "warc"))
    got = {r.record_id: r.payload for r in warc.read_warc(manifest, with_payload=True).collect()}
    assert bytes(got["1"]) == "häll".encode() and bytes(got["2"]) == BIG.encode() and got["3"] is None


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    rows = [(i, "u", BIG if i % 2 else f"{i}" * 200) for i in range(20)]
    got = {r.page_id: r.refers_to for r in warc.round_trip(spark, pages(spark, rows)).collect()}
    assert got == {i: 1 if i % 2 and i != 1 else None for i in range(20)}
