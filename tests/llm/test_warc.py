"""Archives written and read back: against plain Python, and with damage of every kind."""

from __future__ import annotations

import gzip
import hashlib
import io
import random

import pyarrow as pa

from tests.conftest import SF
from tidemark.llm import queries, warc

PAGES = "page_id long, url string, html string"
ROWS = [
    (1, "http://a.example/", "x" * 999),
    (2, "http://a.example/2", "x" * 999),
    (3, "http://b.example/\r\nX-Page-ID: 9", "é" * 500),
    (4, None, "é" * 500),
    (4, None, "é" * 500),  # a repeated row
    (None, "http://c.example/", "é" * 500),
    (None, None, None),
    (6, "", ""),
    (7, "http://long.example/", "".join(chr(97 + k * k % 23) for k in range(300_000))),
    (8, "http://n.example/", "y" * 1000),
    (None, "http://n.example/", "z" * 1000),
    (None, "http://n.example/", "z" * 1000),
]


def expected(rows):
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        same = [k for k, _, h in rows if h == html and k is not None]
        refers = max(same) if len(data) >= 1000 and same and (i is None or i < max(same)) else None
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=repr)


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame(ROWS, PAGES).selectExpr("*", "'clash' as n", "'clash' as key", "'clash' as file").repartition(3)
    found = warc.archived(df, f"file:{tmp_path}/w")
    assert sorted((tuple(r) for r in found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to_page").collect()), key=repr) == expected(ROWS)
    assert found.where("error is not null").count() == 0 and found.where("uri like '%X-Page-ID%'").first().uri == "http://b.example/%0D%0AX-Page-ID:%209"
    assert warc.archived(spark.createDataFrame([], PAGES)).count() == 0


def test_payloads_and_small_files(spark, tmp_path):
    df = spark.createDataFrame(ROWS, PAGES).coalesce(1)
    files = warc.write_warc(df, f"{tmp_path}/w", revisit=1 << 40, size=1)
    assert files.count() == len(ROWS) == files.agg({"records": "sum"}).first()[0]
    got = warc.read_warc(spark, files, payload=True).select("payload").collect()
    assert sorted(bytes(r.payload) for r in got) == sorted((h or "").encode() for _, _, h in ROWS)
    names = [r.file for r in files.collect()]
    assert all(gzip.open(n).read().startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") for n in names)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted((tuple(r) for r in queries.op11_warc(spark, SF).collect()), key=repr) == expected(rows)


def archive(n=40, size=3000):
    rng = random.Random(3)
    payloads = ["".join(rng.choices("abcdefgh ", k=rng.randrange(size))).encode() for _ in range(n)]
    return payloads, [warc.member(warc.record(p, len(p), hashlib.sha1(p).hexdigest(), f"http://x/{k}", k, None, "d")) for k, p in enumerate(payloads)]


def read(data):
    return list(warc.records(io.BytesIO(data), payload=True))


def test_chunks_of_any_size(monkeypatch):
    payloads, members = archive()
    for chunk in (1, 7, 64, 4096):
        monkeypatch.setattr(warc, "CHUNK", chunk)
        got = read(b"".join(members))
        assert [r["payload"] for r in got] == payloads and not any("error" in r for r in got)
        assert [r["offset"] for r in got] == [sum(map(len, members[:k])) for k in range(len(members))]
    assert read(b"") == []


def test_damage():
    payloads, members = archive()
    broken = bytearray(members[5])
    broken[len(broken) // 2] ^= 0xFF
    wrong = gzip.compress(warc.record(b"abc", 3, hashlib.sha1(b"abd").hexdigest(), None, 6, None, "d"))
    short = gzip.compress(warc.record(b"abc", 3, hashlib.sha1(b"abc").hexdigest(), None, 7, None, "d")[:-6])
    long = gzip.compress(warc.record(b"abc", 3, hashlib.sha1(b"abc").hexdigest(), None, 7, None, "d") + b"more")
    alien, headless = gzip.compress(b"hello\r\n\r\n"), gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\n")
    lines = gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\n\r\n")
    bad = {3: bytes(broken), 6: wrong, 9: short, 12: long, 15: alien, 18: headless, 21: b"\0\0junk\x1f\x8b\x08junk", 24: lines}
    data = b"".join(bad.get(k, m) for k, m in enumerate(members)) + members[0][:-9]
    got = read(data)
    good = [r["payload"] for r in got if "error" not in r]
    assert good == [p for k, p in enumerate(payloads) if k not in bad]
    assert [r["error"].split(":")[0] for r in got if "error" in r][1:] == [
        "payload digest differs", "record shorter than its content length", "content length doesn't fit the record", "no WARC record", "header without end",
        "inflate", "no content length", "truncated member",
    ]


def test_revisits_without_a_response(spark):
    rows = [{"record_id": "a", "record_type": "revisit", "refers_to": "gone", "told_digest": "sha1:X"}, {"record_id": "r", "record_type": "response", "payload_bytes": 3, "payload_digest": "d", "told_digest": "sha1:Y"},
            {"record_id": "b", "record_type": "revisit", "refers_to": "r", "told_digest": "sha1:Z"}, {"record_id": "c", "record_type": "revisit", "refers_to": "r", "told_digest": "sha1:Y"}]
    df = spark.createDataFrame(pa.Table.from_batches([warc._batch(rows, "f")]))
    assert sorted((r.record_id, r.error) for r in warc.resolved(df).collect()) == [("a", "refers to no record"), ("b", "payload digest differs"), ("c", None), ("r", None)]
