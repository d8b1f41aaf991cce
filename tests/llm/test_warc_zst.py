import base64
import hashlib
import io

import pytest
import zstandard

from millrace.llm import warc_zst as w


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


ROWS = [(5, "http://a/?q=é\r\nx", "same é"), (3, None, "same é"), (9, "u", "same é"), (1, "u", None), (2, "u", ""), (7, "u", "<p>" * 50000), (8, "u", "once"), (None, "u", "null id"), (None, "u", "same é"), (3, None, "same é")]


def expected(rows):
    first = {}
    for page, _, html in rows:
        if page is not None:
            first[html or ""] = min(page, first.get(html or "", page))
    out = []
    for page, _, html in rows:
        payload = (html or "").encode()
        refers = first.get(html or "")
        refers = None if refers == page else refers
        out.append((page, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    rows = rows_of(spark, ROWS)
    got = [tuple(r) for r in w.archive_round_trip(rows).collect()]
    assert sorted(got, key=str) == expected(ROWS)
    assert w.archive_round_trip(rows.limit(0)).collect() == []


def test_payloads_and_small_archives(spark, tmp_path):
    folder = f"file://{tmp_path}"
    rows = [(k, f"http://x/{k}", f"page {k} " * (k % 40)) for k in range(900)]
    manifest = w.write_archives(rows_of(spark, rows), folder, archive_bytes=4000)
    assert manifest.count() > 5 and sum(r["records"] for r in manifest.collect()) == 900
    got = w.read_archives(manifest, folder).collect()
    text = {k: h for k, _, h in rows}
    for r in got:
        assert r["payload"] is None if r["record_type"] == "revisit" else r["payload"].decode() == text[r["page_id"]]


def archive(tmp_path, records):
    writer = w.Writer(f"file://{tmp_path}")
    for r in records:
        writer.add(r)
    (path, _, n), *more = writer.finish()
    assert not more and n == len(records)
    with open(path, "rb") as file:
        return file.read()


def good(k=1, payload=b"body"):
    return w.record("response", k, "http://x", payload, w.digest(payload), None)


def test_frames(tmp_path):
    records = [good(k, b"text %d " % k * 50) for k in range(300)]
    data = archive(tmp_path, records)
    assert int.from_bytes(data[:4], "little") == w.SKIPPABLE
    assert list(w.read_frames(io.BytesIO(data))) == records
    assert list(w.read_frames(io.BytesIO(data), chunk=7)) == records
    for cut in (3, 20, len(data) - 5):
        with pytest.raises(w.WarcError):
            list(w.read_frames(io.BytesIO(data[:cut])))
    plain = zstandard.ZstdCompressor().compress(records[0])
    with pytest.raises(w.WarcError):
        list(w.read_frames(io.BytesIO(plain)))


@pytest.mark.parametrize("change", [(b"WARC/1.1", b"WARC/9"), (b"Content-Length: ", b"Content-Length: 9"), (b"WARC-Type: response\r\n", b""), (b"body\r\n\r\n", b"bodY\r\n\r\n"), (b"WARC-Type: response", b"WARC-Type: other"), (b"body\r\n\r\n", b"body\r\n\r\nmore"), (b"WARC-Date: ", b"WARC-Date ")])
def test_broken_records_are_refused(change):
    assert w.page_row(good())[0] == 1
    with pytest.raises(w.WarcError):
        w.page_row(good().replace(*change))


@pytest.mark.parametrize("most", [0, 300_000])
def test_a_payload_of_most_pages(spark, monkeypatch, most):
    monkeypatch.setattr(w, "BROADCAST_DIGESTS", most)
    rows = [(k, f"http://x/{k}", "hot" if k % 10 else f"page {k}") for k in range(1, 2000)] + [(None, None, "hot")] * 3
    table = rows_of(spark, rows).repartition(4)
    assert sorted((tuple(r) for r in w.archive_round_trip(table).collect()), key=str) == expected(rows)


def test_schemes_are_those_of_arrow():
    uris = {"/a/b": "file:///a/b", "file:/a": "file:///a", "file:///a": "file:///a", "s3a://b/k": "s3://b/k", "dbfs:/x": "file:///dbfs/x", "hdfs://n:8020/x": "hdfs://n:8020/x", "wasbs://c@a.blob.core.windows.net/x": "abfss://c@a.dfs.core.windows.net/x"}
    assert {k: w.arrow_uri(k) for k in uris} == uris


def test_nothing_stays_in_the_shared_folder(tmp_path):
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import sys; sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from millrace.llm import mixing, ngram_join, warc_zst
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {str(tmp_path / "shared")!r}).getOrCreate()
warc_zst.archive_round_trip(spark.createDataFrame([(1, "u", "x"), (2, "u", "x")], "page_id long, url string, html string")).collect()
docs = spark.createDataFrame([(1, "a b c", "s"), (2, "a b c", "s")], "doc_id long, text string, source string")
mixing.mix(docs, carry=("text",)).collect(); ngram_join.link_groups(docs).collect()
import os; assert os.listdir({str(tmp_path / "shared")!r})
spark.stop()
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=300)
    assert [x for _, _, files in os.walk(tmp_path / "shared") for x in files] == []
