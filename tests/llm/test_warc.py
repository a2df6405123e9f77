import hashlib
import os

import duckdb
import zstandard
from foliant.llm import warc


def test_like_sql(spark):
    path = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{path}/pages.parquet'")
    want = sorted(con.sql(warc.ORACLE).fetchall())
    assert sorted(map(tuple, warc.op2_warc(spark, path).collect())) == want


def pages(spark):
    big = "x" * 150
    rows = [(3, "http://a/ b\r\nX: y", big), (2, None, big), (9, "u", big), (4, "u", "é" * 50), (5, "u", "é" * 50), (6, "u", "short"), (7, "u", "short"), (8, "u", None), (None, "u", big), (2, None, big), (10, "u", "a\r\n\r\nWARC/1.1\r\n" * 30_000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' digest")


def test_records_and_revisits(spark):
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read(warc.write(pages(spark))).collect()), key=str)
    assert got == sorted([(3, 150, "revisit", 2), (2, 150, "response", None), (2, 150, "response", None), (9, 150, "revisit", 2), (4, 100, "response", None), (5, 100, "revisit", 4), (6, 5, "response", None), (7, 5, "response", None), (8, 0, "response", None), (None, 150, "revisit", 2), (10, 450_000, "response", None)], key=str)


def test_seek_and_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 400)
    bundles = warc.write(pages(spark).repartition(1))
    payloads = {r["page_id"]: (r["html"] or "").encode() for r in pages(spark).collect()}
    data = {r["bundle"]: bytes(r["data"]) for r in bundles.collect()}
    places = warc.locate(bundles).collect()
    assert len(places) == pages(spark).count()
    kinds = {r["page_id"]: r["record_type"] for r in warc.read(bundles).collect()}
    for p in places:
        one = warc.seek(data[p["bundle"]], p["frame"], p["offset"], p["length"])
        (headers, block), = warc.records(one)
        assert headers["WARC-Type"] in ("response", "revisit")
        if kinds[p["page_id"]] == "response":
            assert block.partition(b"\r\n\r\n")[2] == payloads[p["page_id"]]
            assert headers["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(payloads[p["page_id"]]).hexdigest()
    files = warc.export(bundles, f"file://{tmp_path}")
    for f in files:
        raw = open(f.removeprefix("file:"), "rb").read()
        assert len(warc.seek_table(raw)) > 1
        plain = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()  # any reader of zstd files can read it
        assert sum(1 for _ in warc.records(plain)) == len(places)
    assert files and os.path.exists(files[0].removeprefix("file:"))


def test_damage_is_found():
    bundle = warc.Bundle()
    bundle.add("1", warc.record("1", "u", b"p" * 1000, hashlib.sha256(b"p" * 1000).hexdigest(), None))
    data = bytearray(bundle.done())
    data[20] ^= 255
    try:
        warc.frame(bytes(data), warc.seek_table(bytes(data))[0])
    except (ValueError, zstandard.ZstdError):
        return
    raise AssertionError


def test_empty_table(spark):
    assert warc.read(warc.write(pages(spark).limit(0))).count() == 0


def test_identifiers(spark):
    """Ids may be empty or hold any sign; records have identifiers of their own, repeated rows too."""
    html = "<p>" + "x" * 200 + "</p>"
    df = spark.createDataFrame([("", "u", html), ("a#b <c>%", "u", html), (None, "u", html), ("a#b <c>%", "u", html), ("z", None, "short")], "page_id string, url string, html string")
    bundles = warc.write(df)
    got = sorted((str(r["page_id"]), r["record_type"], str(r["refers_to"])) for r in warc.read(bundles, "string").collect())
    assert got == [("", "response", "None"), ("None", "revisit", ""), ("a#b <c>%", "revisit", ""), ("a#b <c>%", "revisit", ""), ("z", "response", "None")]
    names = [h["WARC-Record-ID"] for r in bundles.collect() for e in warc.seek_table(r["data"]) for h, _ in warc.records(warc.frame(r["data"], e))]
    assert len(set(names)) == 5
