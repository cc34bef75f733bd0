import gzip

import pytest

from worktide.llm import warc
from worktide.llm.queries import warc_round_trip


def test_round_trip(spark, tmp_path):
    rows = [
        (1, "http://a/", "<p>é</p>"), (2, "http://b/", "<p>é</p>"), (3, None, None), (4, "x", ""), (5, "y\r\nz", "q" * 300000),
        (2, "http://b/", "<p>é</p>"), (None, "n", "<p>é</p>"),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(2)
    index = warc.write(pages, str(tmp_path / "w"))
    got = sorted(
        (r.page_id or 0, r.record_type, r.refers_to, r.url, bytes(r.payload) if r.payload is not None else None, r.payload_bytes)
        for r in warc.read(index, str(tmp_path / "w"), gap=10, size=200).collect()
    )
    e = "<p>é</p>".encode()
    assert got == [
        (0, "revisit", 2, "n", None, len(e)), (1, "revisit", 2, "http://a/", None, len(e)),
        (2, "response", None, "http://b/", e, len(e)), (2, "response", None, "http://b/", e, len(e)),
        (3, "revisit", 4, None, None, 0), (4, "response", None, "x", b"", 0),
        (5, "response", None, "y%0D%0Az", b"q" * 300000, 300000),
    ]
    # Members stand alone, and a selection reads only its own records.
    one = index.where("page_id = 5")
    assert warc.read(one, str(tmp_path / "w")).count() == 1
    whole = b"".join(gzip.decompress(f.read_bytes()) for f in (tmp_path / "w").iterdir())
    assert whole.count(b"WARC/1.1\r\n") == len(rows)


def test_damage_is_noticed():
    data = warc.record(1, "u", b"abc", warc.base32(b"x" * 20), None, False)
    with pytest.raises(ValueError, match="digest"):
        warc.parse(data)


def test_ranges_are_joined():
    rows = [("a", 0, 10), ("a", 10, 10), ("a", 100, 10), ("a", 111, 5), ("b", 0, 5)]
    got = list(warc.coalesced(rows, gap=5, size=1000))
    assert [(p, a, b, len(m)) for p, a, b, m in got] == [("a", 0, 20, 2), ("a", 100, 116, 2), ("b", 0, 5, 1)]
    assert [m for _, _, _, ms in warc.coalesced(rows, gap=1000, size=15) for m in ms] == [r[1:] for r in rows]


def test_every_page_comes_back(spark):
    rows = warc_round_trip(spark, "/root/testdata/sf0.001").collect()
    assert len({r.page_id for r in rows}) == len(rows) == 50
