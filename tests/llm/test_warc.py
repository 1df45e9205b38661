from __future__ import annotations

import base64
import gzip
import hashlib
import os

import pytest

from haberdash.llm import warc
from haberdash.llm.tables import new_folder


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, records int, revisit string")


ROWS = [
    (1, "http://a/", "same"), (2, "http://b/", "same"), (3, None, None), (4, "http://d/\r\nX: y", ""), (5, "u", "é\r\n\r\nx"),
    (5, "u", "other"), (None, "n", "same"), (None, "n", "alone"), (None, "n", "alone"), (9, "long", "ab" * 400_000),
]


def written(spark, rows=ROWS, **options):
    folder = new_folder(spark, "test-warc")
    frame = pages(spark, [(*r, 0, "") for r in rows])
    return folder, warc.write_archives(frame, folder, **options)


def expected(min_bytes=0):
    out = []
    for i, _, html in ROWS:
        data = (html or "").encode()
        same = [j for j, _, h in ROWS if (h or "") == (html or "") and j is not None]
        newest = max(same, default=None) if len(data) >= min_bytes else None
        revisit = newest is not None and i != newest
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((i, len(data), digest, "revisit" if revisit else "response", newest if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("options", [{}, {"min_bytes": 5}, {"archive_bytes": 1}])
def test_round_trip(spark, options):
    _, manifest = written(spark, **options)
    found = warc.read_archives(manifest)
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found.collect()]
    assert sorted(got, key=repr) == expected(options.get("min_bytes", 0))
    payloads = {bytes(r["payload"]) for r in found.where("record_type = 'response'").collect()}
    assert payloads == {(h or "").encode() for _, _, h in ROWS}


def test_archives_are_standard_gzip(spark):
    _, manifest = written(spark)
    records = 0
    for row in manifest.collect():
        with gzip.open(row["path"].removeprefix("file://")) as stream:
            records += stream.read().count(b"WARC/1.1\r\n")
    assert records == len(ROWS)


def test_files_outside_the_manifest_are_not_read(spark):
    folder, manifest = written(spark)
    with open(os.path.join(folder.removeprefix("file://"), "pages-stray.warc.gz"), "wb") as stray:
        stray.write(b"from a lost attempt")
    assert warc.read_archives(manifest).count() == len(ROWS)


def test_empty_table(spark):
    _, manifest = written(spark, [])
    assert warc.read_archives(manifest).count() == 0


def one(payload=b"body", **headers):
    return warc.write_record({"WARC-Type": "response", "X-Page-ID": "1"} | headers, b"HTTP/1.1 200 OK\r\n\r\n" + payload)


def test_broken_archives_are_refused():
    good = one()
    assert len(list(warc.read_members(iter([good[:7], good[7:], good])))) == 2
    with pytest.raises(warc.WarcError, match="cut off"):
        list(warc.read_members(iter([good[:-3]])))
    with pytest.raises(warc.WarcError, match="broken gzip"):
        list(warc.read_members(iter([b"plain text"])))
    member = next(warc.read_members(iter([good])))
    with pytest.raises(warc.WarcError, match="block digest"):
        warc.parse_record(member.replace(b"body", b"bodX"))
    with pytest.raises(warc.WarcError, match="Content-Length"):
        warc.parse_record(member.replace(b"body", b"bod"))
    wrong = one(**{"WARC-Payload-Digest": "sha1:AAAA"})
    with pytest.raises(warc.WarcError, match="payload digest"):
        list(warc.read_pages(iter([wrong])))
