import base64
import gzip
import hashlib

import pytest

from deskspark.llm import warc as W
from deskspark.session import run_folder


def digest(body):
    return base64.b32encode(hashlib.sha1(body).digest()).decode()


def pages(spark, rows, parts=3):
    schema = "page_id long, url string, html string, payload string, chunk int, refers_to int"
    return spark.createDataFrame([(*r, None, None, None) for r in rows], schema).repartition(parts)


@pytest.fixture
def small(monkeypatch):
    for name, size in (("CHUNK_BYTES", 10), ("SEGMENT_BYTES", 400), ("FILE_BYTES", 900), ("READ_BYTES", 16)):
        monkeypatch.setattr(W, name, size)


@pytest.mark.parametrize("least", [0, 6])
def test_round_trip(spark, small, least):
    rows = [(i, f"http://x/{i}", f"<p>é page {i % 7}</p>" * (1 + i % 7)) for i in range(30)]
    rows += [(40, None, None), (41, "http://x/\nodd", ""), (42, "http://y", "short"), (43, "http://y", "short")]
    rows += [(5, "http://x/5", rows[5][2]), (50, "http://long", "0123456789" * 500)]
    got = W.archive_pages(pages(spark, rows), least=least).collect()
    first = {}
    for page, _, html in rows:
        body = (html or "").encode()
        first[body] = min(first.get(body, page), page)
    want = []
    for page, _, html in rows:
        body = (html or "").encode()
        again = first[body] < page and len(body) >= least
        want.append((page, len(body), digest(body), "revisit" if again else "response", first[body] if again else None))
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    assert {r["url"] for r in got if r["page_id"] == 41} == {"http://x/%0Aodd"}


def test_archives_are_plain_warc(spark, small):
    rows = [(1, "http://a", "hello"), (2, "http://b", "hello"), (3, None, "")]
    table = pages(spark, rows, 1).selectExpr("page_id", "url", "cast(html as binary) payload")
    extra = [(1, 5, digest(b"hello"), None), (2, 5, digest(b"hello"), 1), (3, 0, digest(b""), None)]
    told = spark.createDataFrame(extra, "page_id long, payload_bytes long, payload_digest string, refers_to long")
    folder = run_folder(spark, "archives-test")
    cuts = W.write_archives(table.join(told, "page_id").coalesce(1).sortWithinPartitions("page_id"), folder).collect()
    path = folder.removeprefix("file://").removeprefix("file:")
    text = b"".join(gzip.open(f"{path}/{name}").read() for name in sorted({c["file"] for c in cuts}))
    assert text.count(b"WARC/1.1\r\n") == 3 and text.count(b"WARC-Type: revisit\r\n") == 1
    assert b"WARC-Refers-To: <urn:page:1>" in text and text.endswith(b"\r\n\r\n\r\n\r\n")
    assert b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\nhello\r\n\r\n" in text


def test_empty_table(spark):
    assert W.archive_pages(pages(spark, [])).count() == 0
