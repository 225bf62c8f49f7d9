"""Archives: round trip, declared lengths, revisits, bad files."""

import base64
import gzip
import hashlib

import pytest

from quarrylane.llm import warc


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def pages():
    tricky = "a\n\nb\r\n\r\nWARC/1.0\r\nfiledesc://x 0 0 text/plain 5\n\x00é日本"
    out = [(10, "http://a/x y\n", "<p>one</p>"), (2, "http://b/é", "<p>one</p>"), (3, None, None), (4, "http://c", ""), (5, "http://d", tricky),
           (5, "http://d", "other with the same id"), (6, "u", tricky), (None, "no id", "<p>one</p>"), (7, "long", "<b>" * 300_000), (2, "http://b/é", "<p>one</p>")]
    return out + [(100 + i, f"http://hot/{i}", "same again") for i in range(60)]


def test_round_trip(spark):
    rows = pages()
    got = warc.archived(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    least = {}
    for i, _, html in rows:
        if i is not None:
            least[html or ""] = min(i, least.get(html or "", i))
    want = []
    for i, _, html in rows:
        first = least.get(html or "")
        again = i is not None and first != i
        want.append((i, len((html or "").encode()), digest(html), "revisit" if again else "response", first if again else None))
    assert sorted(str(tuple(r)[:5]) for r in got) == sorted(map(str, want))
    assert warc.archived(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_both_versions_and_members():
    for version in (1, 2):
        body = b"HTTP/1.1 200 OK\r\nX-Page-Id: 1\r\n\r\nhello\nworld"
        record = warc._arc_line(version, "http://x", "1.2.3.4", "20200102", "text/html", len(body)).encode() + b"\n" + body + b"\n"
        whole = warc.arc_block(version, "20200102") + b"\n" + record * 3
        members = gzip.compress(whole[:200]) + gzip.compress(whole[200:])
        for data in (whole, gzip.compress(whole), members):
            found = list(warc.parse_arc(memoryview(data)))
            assert len(found) == 3 and all(block == body and line["URL"] == "http://x" for line, block in found)
            assert set(found[0][0]) == set(warc.ARC_FIELDS[version])
        with pytest.raises(ValueError):
            list(warc.parse_arc(memoryview(whole[:-10])))
        with pytest.raises(ValueError):
            list(warc.parse_arc(memoryview(whole.replace(b"URL IP-address", b"URL address"))))
    assert warc.iso_date("20200102") == "2020-01-02T00:00:00Z" and warc.iso_date("20200102030405") == "2020-01-02T03:04:05Z"


def test_files_are_warc(spark):
    arc = warc.write_arc(spark.createDataFrame([(1, "http://x", "<p>é</p>"), (2, "http://y", "<p>é</p>")], "page_id long, url string, html string"))
    files = warc._binary(spark, warc.convert(spark, arc)).collect()
    kinds = [f["WARC-Type"] for r in files for f, _ in warc.parse_warc(memoryview(bytes(r.content)))]
    assert kinds.count("response") == 1 and kinds.count("revisit") == 1 and kinds[0] == "warcinfo"
    record = warc.warc_record("2", "http://y", "0.0.0.0", "20240101", "text/html", b"abc", "1", True) + warc.WARC_END.encode()
    (fields, block), = warc.parse_warc(memoryview(record))
    assert fields["WARC-Refers-To"] == warc.record_id("1", "20240101") and fields["WARC-Profile"] == warc.PROFILE and block.startswith(b"HTTP/1.1")
