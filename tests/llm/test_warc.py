import gzip
import hashlib
import io

import compare
import pytest
from pyspark.sql import functions as F

from labelmill.llm import queries, warc


def test_same_as_sql(spark, folder):
    name = "op1_warc_round_trip"
    assert compare.difference(queries.queries()[name](spark, folder), compare.connect(folder), queries.oracle_sql()[name]) is None


ROWS = [(1, "http://a/\r\nX: y", "same é"), (2, None, "same é"), (3, "u", None), (4, "u", ""), (5, "u", "WARC/1.1\r\n\r\n\r\n"),
        (6, "u", "long " * 100_000), (9, "u", "same é"), (9, "u", "same é"), (None, "u", "same é"), (None, "u", "only here")]


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    df = spark.createDataFrame([(*r, "c", 1) for r in ROWS], "page_id long, url string, html string, payload string, key int").repartition(3)
    path = str(tmp_path_factory.mktemp("warc") / "out")
    warc.write(warc.to_records(df, "page_id", "url", "html"), path)
    return path


def test_edges(spark, path):
    got = warc.read(spark, path, verify="true").collect()
    assert len(got) == len(ROWS)
    body = lambda t: (t or "").encode()
    want = []
    for key, _, html in ROWS:
        again = html == "same é" and key != 9 or key == 3
        to = ("urn:row:9" if html else "urn:row:4") if again else None
        want.append((f"urn:row:{'' if key is None else key}", "revisit" if again else "response", to, warc.digest(body(html)), len(body(html)), "" if again else html or ""))
    names = ("record_id", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload")
    assert sorted((tuple(r[n] for n in names) for r in got), key=str) == sorted(want, key=str)
    assert {r["target_uri"] for r in got} == {"http://a/%0D%0AX: y", None, "u"}


def test_least(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "k long, u string, t string")
    got = {r["record_id"][8:]: r["record_type"] for r in warc.to_records(df, "k", "u", "t", least=3).collect()}
    assert got == {"1": "response", "2": "response", "3": "revisit", "4": "response"}
    assert warc.to_records(df.where("k > 9"), "k", "u", "t").collect() == []


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "k long, u string, t string")
    warc.write(warc.to_records(df, "k", "u", "t"), str(tmp_path / "none"))
    assert warc.read(spark, str(tmp_path / "none")).collect() == []


def test_filters_are_pushed_down(spark, path):
    df = warc.read(spark, path, ("record_type", "record_id")).where("record_type = 'revisit' and record_id in ('urn:row:1', 'urn:row:6')")
    assert [r["record_id"] for r in df.collect()] == ["urn:row:1"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "revisit" not in plan.split("BatchScan")[0]  # no filter is left above the scan
    some = warc.read(spark, path).where(F.col("payload_bytes") > 400_000).collect()
    assert [r["record_id"] for r in some] == ["urn:row:6"]


def test_unwanted_payloads_stay_packed(monkeypatch):
    rows = [{"record_type": t, "record_id": str(i), "payload": b"x" * 300_000, "payload_bytes": 300_000, "payload_digest": "D"} for i, t in enumerate(["response", "warcinfo"] * 5)]
    data = b"".join(warc.member(warc.record(r)) for r in rows)
    taken = []
    more = warc._Member.more
    monkeypatch.setattr(warc._Member, "more", lambda self: taken.append(1) or more(self))
    got = list(warc.records(io.BytesIO(data), 0, len(data), [("record_type", {"warcinfo"})], False))
    assert [r["record_id"] for r in got] == ["1", "3", "5", "7", "9"] and len(taken) <= 2 * len(rows)


@pytest.mark.parametrize("packed", ["gzip", "plain"])
def test_archives_of_others(spark, tmp_path, packed):
    """Members without lengths, plain archives, several files to a partition, and records that hold no HTTP."""
    head = b"WARC/1.0\r\nWARC-Type: %s\r\nWARC-Record-ID: <urn:%d>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n"
    for f in range(3):
        own = [head % (b"resource" if i % 2 else b"metadata", 10 * f + i, 100_000 + i, b"z" * (100_000 + i)) for i in range(4)]
        data = b"".join(gzip.compress(r) if packed == "gzip" else r for r in own)
        (tmp_path / f"a{f}.warc{'.gz' * (packed == 'gzip')}").write_bytes(data)
    df = warc.read(spark, str(tmp_path), partitionBytes=1 << 30)
    assert df.rdd.getNumPartitions() == 1
    got = df.where("record_type = 'resource'").select("record_id", F.length("payload").alias("n"), "payload_bytes").collect()
    assert sorted((r["record_id"], r["n"], r["payload_bytes"]) for r in got) == sorted(
        (f"urn:{10 * f + i}", 100_000 + i, 100_000 + i) for f in range(3) for i in (1, 3)
    )


def test_entered_in_the_middle(spark, tmp_path, monkeypatch):
    rows = [(i, "u", hashlib.sha512(str(i).encode()).hexdigest() * 9) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, u string, t string").coalesce(1)
    monkeypatch.setattr(warc, "ENTRY", 10_000)
    warc.write(warc.to_records(df, "k", "u", "t"), str(tmp_path / "o"))
    out = warc.read(spark, str(tmp_path / "o"), verify="true", partitionBytes=20_000)
    assert out.rdd.getNumPartitions() > 3
    assert sorted(r["payload"] for r in out.collect()) == sorted(t for _, _, t in rows)


def test_broken_archives():
    noise = b"".join(hashlib.sha256(bytes([i])).digest() for i in range(250))
    good = warc.member(warc.record({"record_type": "response", "record_id": "1", "payload": noise, "payload_bytes": len(noise), "payload_digest": "D"}))
    for data in (good[:-900], b"no archive at all\r\n\r\n"):
        with pytest.raises((ValueError, KeyError)):
            list(warc.records(io.BytesIO(data), 0, len(data), [], True))


def test_lost_attempts_do_not_count(spark, path):
    from pathlib import Path

    stray = Path(path) / "part-stray.warc.gz"
    stray.write_bytes(warc.member(warc.record({"record_type": "response", "record_id": "z", "payload": b"", "payload_bytes": 0, "payload_digest": "D"})))
    assert warc.read(spark, path).where("record_id = 'z'").count() == 0


def test_two_writes_to_one_folder(spark, tmp_path):
    """Each write has its own manifest: a second one adds its archives, and none is lost."""
    pages = [(k, f"http://x/{k}", f"page {k} " * k) for k in range(1, 7)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for lo, hi in ((1, 3), (3, 4), (4, 7)):
        warc.write(warc.to_records(df.where(f"page_id >= {lo} and page_id < {hi}"), "page_id", "url", "html"), str(tmp_path / "w"))
    found = warc.read(spark, str(tmp_path / "w"), ("record_id", "payload")).collect()
    assert sorted((r["record_id"], r["payload"]) for r in found) == [(f"urn:row:{k}", t) for k, _, t in pages]


def test_long_payload_in_linear_time():
    """256 MB within one record; pieces are not copied again and again."""
    import io
    import time

    body = (b"0123456789abcdef" * 4 + b"\n") * (256_000_000 // 65)
    plain = b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    start = time.process_time()
    [row] = warc.records(io.BytesIO(plain), 0, len(plain), [], True)
    assert row["payload"] == body and row["payload_bytes"] == len(body)
    packed = gzip.compress(plain, 1)
    [row] = warc.records(io.BytesIO(packed), 0, len(packed), [], True)
    assert row["payload"] == body
    assert time.process_time() - start < 60
