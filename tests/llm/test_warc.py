import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from evitrace.llm import warc
from evitrace.llm.queries import QUERIES


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id bigint, url string, html string, record_type string")


def test_odd_rows(spark):
    long = "ü<p>" * 300_000
    rows = [(1, "http://a/", "same"), (5, "http://b/", "same"), (3, None, "same"), (2, "u", None), (4, "u\r\nX: y", ""), (6, "u", long),
            (7, "u", long), (7, "u", long), (None, "u", "other"), (None, "u", "same"), (8, "", "a\r\n\r\nWARC/1.1\r\n\r\nb")]
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages(spark, rows)).collect()), key=repr)
    top = {"same": 5, "": 4, long: 7, "other": None, rows[-1][2]: 8}
    want = []
    for i, _, h in rows:
        h = h or ""
        first = top[h] is None or i == top[h]
        want.append((i, len(h.encode()), digest(h.encode()), "response" if first else "revisit", None if first else top[h]))
    assert got == sorted(want, key=repr)
    assert warc.round_trip(pages(spark, [])).count() == 0


def test_filters_are_pushed_and_payloads_left_alone(spark, tmp_path):
    warc.register(spark)
    path = str(tmp_path / "w")
    warc.archive(pages(spark, [(i, f"http://h{i % 3}/", "x" * (i // 2)) for i in range(40)]), path)
    read = spark.read.format("warc").option("payload", "false").load(path)
    some = read.filter((F.col("record_type") == "revisit") & F.col("target_uri").startswith("http://h1"))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "revisit" not in plan.split("BatchScan")[0] or "PushedFilters" in plan
    rows = some.collect()
    assert rows and all(r.record_type == "revisit" and r.target_uri == "http://h1/" and r.payload is None for r in rows)
    assert {r.record_id for r in rows} == {f"<urn:page:{i}>" for i in range(0, 40, 2) if i % 3 == 1}
    reader = warc.Reader(path, True, False)
    assert list(reader.pushFilters([warc.EqualTo(("record_type",), "metadata")])) == [] and reader.partitions() == []


def test_unwanted_bodies_are_not_inflated(monkeypatch, tmp_path):
    rows = [{"record_type": t, "record_id": f"<{i}>", "target_uri": "u", "date": None, "payload_digest": "sha1:x", "payload_length": 1 << 20,
             "refers_to": None, "payload": bytes(range(256)) * 4096} for i, t in enumerate(["response", "metadata", "response"])]
    data = b"".join(warc.member(warc.record(r)) for r in rows)
    assert gzip.decompress(data) == b"".join(warc.record(r) for r in rows)
    (tmp_path / "a.warc.gz").write_bytes(data)
    grown = []
    more = warc._Gzip._more
    monkeypatch.setattr(warc._Gzip, "_more", lambda self, most: (more(self, most), grown.append(len(self.data)))[0])
    with open(tmp_path / "a.warc.gz", "rb") as file:
        got = list(warc.records(file, warc.Part("a.warc.gz", 0, len(data)), lambda h: h["warc-type"] == "metadata", False))
    assert [h["warc-record-id"] for h, *_ in got] == ["<1>"] and got[0][1] == 1 << 20 and max(grown) <= 8192


@pytest.mark.parametrize("name", ["plain.warc", "other.warc.gz"])
def test_archives_of_others(spark, tmp_path, name):
    """Without a manifest, without member lengths, with other kinds of records."""
    warc.register(spark)
    block = lambda kind, body: (f"WARC/1.0\r\nWARC-Type: {kind}\r\nwarc-record-id: <{kind}>\r\nContent-Length: {len(body)}\r\n".encode()
                                + (b"Content-Type: application/http;msgtype=response\r\n" if kind == "response" else b"") + b"\r\n" + body + b"\r\n\r\n")
    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n" + b"z" * 100_000
    blocks = [block("warcinfo", b"software: x"), block("response", http), block("metadata", b"a: b")]
    (tmp_path / name).write_bytes(b"".join(map(gzip.compress, blocks)) if name.endswith(".gz") else b"".join(blocks))
    rows = {r.record_type: r for r in spark.read.format("warc").load(str(tmp_path)).collect()}
    assert rows["response"].payload == b"z" * 100_000 and rows["response"].payload_length == 100_000
    assert rows["warcinfo"].payload == b"software: x" and rows["metadata"].headers["warc-type"] == "metadata"
    assert spark.read.format("warc").load(str(tmp_path)).filter("record_type = 'metadata'").count() == 1


def test_query_matches_rows(spark):
    sf = "/root/testdata/sf0.001"
    given = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r.page_id: r for r in QUERIES["op4_warc"](spark, sf).collect()}
    assert got.keys() == given.keys()
    assert all(got[i].payload_digest == digest(p) and got[i].payload_bytes == len(p) for i, p in given.items())
