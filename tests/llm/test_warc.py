import gzip
import hashlib
import io

import pytest

from galley.llm.warc import RecordReader, page_of, page_record, read_archives, write_archives

PAGES = "page_id long, url string, html string, payload string, _key string"


def pages(spark):
    big, other = "<p>" + "é" * 600 + "</p>", "x" * 1000
    rows = [(1, "http://a/é b", big), (2, None, big), (7, "u", big), (7, "u", big), (None, "u", big), (3, "u", None), (4, "u", ""),
            (5, "u", "short"), (6, "u", "short"), (8, "a\nb", other), (9, "u", other), (10, "u", "x" * 999), (11, "u", "x" * 999),
            (None, "u", "only once"), (12, "u", "long " * 200_000)]
    return spark.createDataFrame([(*r, "p", "k") for r in rows], PAGES), rows


def test_round_trip(spark):
    frame, rows = pages(spark)
    back = read_archives(write_archives(frame)).collect()
    largest = {}
    for page, _, html in rows:
        if page is not None and len((html or "").encode()) >= 1000:
            largest[html] = max(page, largest.get(html, page))
    expected = []
    for page, _, html in rows:
        body = (html or "").encode()
        keeper = largest.get(html)
        refers = keeper if keeper is not None and keeper != page else None
        expected.append((page, len(body), hashlib.sha1(body).hexdigest(), "revisit" if refers else "response", refers, None if refers else body))
    found = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in back]
    assert sorted(found, key=str) == sorted(expected, key=str)


def test_no_pages(spark):
    frame, _ = pages(spark)
    assert read_archives(write_archives(frame.limit(0))).count() == 0


def test_small_archives_are_all_read(spark):
    frame, rows = pages(spark)
    manifest = write_archives(frame, archive_bytes=500)
    assert manifest.count() > 3 and read_archives(manifest, with_payload=False).count() == len(rows)


def record(payload=b"hello", refers=None):
    return page_record(1, "http://a/", payload, hashlib.sha1(payload).hexdigest(), refers, "2024-01-01T00:00:00Z")


def test_records_are_plain_gzip_members():
    text = gzip.decompress(record() + record(b"x" * 99_999)).decode()
    assert text.count("WARC/1.1\r\n") == 2 and "WARC-Target-URI: http://a/\r\n" in text


@pytest.mark.parametrize("cut", [10, 100, -1, -9])
def test_a_cut_archive_is_an_error(cut):
    with pytest.raises((EOFError, ValueError)):
        list(RecordReader(io.BytesIO(record() + record()[:cut])))


def test_changed_content_is_an_error():
    raw = gzip.decompress(record())
    with pytest.raises(ValueError):
        list(RecordReader(io.BytesIO(gzip.compress(raw.replace(b"hello", b"hallo")))))
    with pytest.raises(ValueError):
        list(RecordReader(io.BytesIO(gzip.compress(raw + b"more"))))
    [(fields, block)] = RecordReader(io.BytesIO(record()))
    with pytest.raises(ValueError):
        page_of(fields, block.replace(b"hello", b"hallo"))
