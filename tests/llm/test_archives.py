"""Archives: round trip, single-stream input, dirty rows."""

import gzip
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from cratewise.llm import warc
from cratewise.plans.guards import cut_lineage

BIG = "<p>é" + "x" * 1500 + "\r\n\r\nWARC/1.1\r\n</p>"
PAGES = [
    (1, "http://a", BIG), (2, "http://b", BIG), (9, "http://c\r\nX: y", BIG), (3, None, "short"), (4, "http://d", "short"), (5, "u", None), (6, "", ""),
    (None, "n", BIG), (7, "long", "y" * 3_000_000), (8, "twice", BIG + "2"), (8, "twice", BIG + "2"),
]


def test_round_trip(spark):
    pages = cut_lineage(spark.createDataFrame([(*p, "x", "y") for p in PAGES], "page long, url string, html string, digest string, owner string"))
    rows = warc.archive_pages(pages, file_bytes=4096).collect()
    assert len(rows) == len(PAGES)
    want = []
    for page, _, html in PAGES:
        raw = (html or "").encode()
        owners = [p for p, _, h in PAGES if (h or "").encode() == raw and p is not None]
        again = len(raw) >= 1000 and page != max(owners, default=None)
        want.append((str(page) if page is not None else "null", "revisit" if again else "response", hashlib.sha1(raw).hexdigest(), len(raw), str(max(owners)) if again else None))
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_members_and_index(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://{i}", "z" * (i * 100)) for i in range(30)], "page long, url string, html string").coalesce(1)
    streams = warc.write_archives(pages, f"file://{tmp_path}/streams")
    (path,) = [r["path"] for r in streams.collect()]
    raw = open(path.removeprefix("file://"), "rb").read()
    single = zlib.decompressobj(31)
    single.decompress(raw)
    assert single.eof and not single.unused_data  # one member holds the whole file
    index = warc.normalise_archives(streams, f"file://{tmp_path}/members").orderBy("offset").collect()
    data = open(index[0]["archive"].removeprefix("file://"), "rb").read()
    assert gzip.decompress(data) == gzip.decompress(raw)
    for r in index:
        one = zlib.decompress(data[r["offset"] : r["offset"] + r["length"]], 31)
        assert one.startswith(b"WARC/1.1\r\n") and f"<urn:page:{r['record']}>".encode() in one
    assert [r["payload_bytes"] for r in index] == [i * 100 for i in range(30)]
    again = warc.normalise_archives(spark.createDataFrame([(index[0]["archive"],)], "path string"), f"file://{tmp_path}/again")
    assert again.select(F.sum("length")).first()[0] == len(data)  # many members are read as well as one


def test_cut_archives_are_an_error():
    pack = b"WARC/1.1\r\nContent-Length: 10\r\n\r\n12345"
    with pytest.raises(ValueError):
        list(warc.RecordReader(iter([pack])))
