"""WARC archives: round trips, revisits, and broken archives."""

import hashlib
import base64
import random
import zlib

from pyspark.sql import functions as F

from laggard.llm import warc

FIELDS = "page_id long, url string, html string"


def page_rows():
    random.seed(2)
    rows = [(i, f"http://a.example/{i}", "x" * random.randint(0, 400) + str(i % 11)) for i in range(300)]
    return rows + [(900, None, None), (901, "http://b\r\nWARC-Type: x", ""), (None, "u", "null id"), (905, "u", "é\0\r\n\r\nWARC/1.1"),
                   (906, "long", "long " * 600_000), (906, "long", "long " * 600_000)]


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(page_rows(), FIELDS).withColumn("archive", F.lit("clash"))
    warc.write_warc(pages, str(tmp_path / "w"), archive_bytes=2_000)
    back = [r for r in warc.read_warc(spark, str(tmp_path / "w")).collect() if r["record_type"] in ("response", "revisit")]
    assert all(r["error"] is None and r["digest_ok"] for r in back)
    rows = page_rows()
    by_html = {}
    for i, _, html in rows:
        by_html.setdefault(html or "", []).append(i)
    assert len(back) == len(rows)
    want = {str(i): html or "" for i, _, html in rows}
    for r in back:
        key = warc.page_of(r["record_id"])
        html = "null id" if key is None else want[key]
        body = html.encode()
        assert r["payload_bytes"] == len(body)
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
        top = max((i for i in by_html[html] if i is not None), default=None)
        if key is None or int(key) == top:
            assert r["record_type"] == "response" and bytes(r["payload"]) == body and r["refers_to"] is None
        else:
            assert r["record_type"] == "revisit" and warc.page_of(r["refers_to"]) == str(top)


def test_short_payloads_are_not_revisited(spark, tmp_path):
    pages = spark.createDataFrame([(1, "a", "same"), (2, "b", "same"), (3, "c", "longer same"), (4, "d", "longer same")], FIELDS)
    got = {r["page_id"]: r["record_type"] for r in warc.round_trip(pages, min_bytes=5, path=str(tmp_path / "m")).collect()}
    assert got == {"1": "response", "2": "response", "3": "revisit", "4": "response"}


def test_empty_table(spark, tmp_path):
    assert warc.round_trip(spark.createDataFrame([], FIELDS), path=str(tmp_path / "e")).count() == 0


def test_members_end_in_a_zero_byte_and_stand_alone():
    data = [warc.page_record(i, "u", b"x" * i, None, True) for i in range(50)]
    joined = b"".join(warc.gzip_member(d) for d in data)
    assert joined[-1] == 0 and [m for _, m in warc.members(memoryview(joined))] == data
    assert zlib.decompress(warc.gzip_member(data[3]), 31) == data[3]


def test_damage_is_reported():
    good = warc.page_record(1, "u", b"payload", None, True)
    assert warc.parse_record(good)["error"] is None
    assert not warc.parse_record(good.replace(b"payload", b"PAYLOAD"))["digest_ok"]
    assert warc.parse_record(good[:-6])["error"]
    assert warc.parse_record(b"junk")["error"]
    cut = warc.gzip_member(good) + warc.gzip_member(good)[:-9]
    assert [m is None for _, m in warc.members(memoryview(cut))] == [False, True]


def test_archives_of_records_over_16_mib_end_in_zero():
    import pandas as pd

    batch = pd.DataFrame({"page_id": ["1"], "url": ["u"], "payload": [b"\1" * (17 << 20)], "response_id": [None], "is_response": [True]})
    (archive,) = [f["archive"][0] for f in warc.pack_archives(iter([batch]), 1 << 20)]
    kinds = [warc.parse_record(m)["record_type"] for _, m in warc.members(memoryview(archive + b"\0"))]
    assert kinds == ["warcinfo", "response", "metadata"]
