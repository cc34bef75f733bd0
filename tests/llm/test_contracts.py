"""Every corpus query against its SQL twin, on the test tables and on hard cases."""

import duckdb
import pytest

import __spark_entry__ as entry
from tests.llm.texts import edge_texts, prose

SMALL = "/root/testdata/sf0.001"
TWINS = ("op1_url_filters", "op3_decontamination", "op5_secret_scans", "op7_warc", "op10_quality_rules",
         "op13_hard_negatives")


def same(spark, name, folder, pattern):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages", "embeddings"):
        con.sql(f"create view {table} as select * from '{folder}/{table}.parquet{pattern}'")
    got = entry.queries()[name](spark, folder)
    want = con.sql(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted(tuple(map(str, r)) for r in got.select(columns).collect())
    assert rows == sorted(tuple(map(str, r)) for r in want.select(*columns).fetchall())
    return len(rows)


def test_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)]
    assert "pipeline" in entry.queries()


@pytest.mark.parametrize("name", TWINS)
def test_test_tables(spark, name):
    assert same(spark, name, SMALL, "") > 0


@pytest.mark.parametrize("name", TWINS)
def test_hard_cases(spark, folder, name):
    # The SQL twins take time with the square of a text's words.
    texts = edge_texts(1500)
    passage = prose(3, 400).split()[10:60]
    texts += [" ".join(passage).upper(), "x " + " ".join(passage[:13]) + " y", " ".join(passage[:12])]
    urls = [
        None, "", "no scheme", "http://", "HTTP://A.NET/x", "http://net/", "http://net", "http://x.example.net/en/1",
        "http://x.example.net/en", "http://Example.COM/de/?q=net/", "https://a.org/fr/#x", "https://org/fr/a",
        "ftp://notexample.net/en/", "http://a.example.com/DE/x", "http://casino-win.example.com/", "://net/",
        "http://x.example.com/addiction-help/casino/1", "http://xcasino.com/", "a://b.org?x/fr/", "http://é.net/É/ü",
    ]
    where = folder(
        documents=[(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (None, "null id")],
        benchmark=[(1, " ".join(passage)), (2, "one"), (3, None), (4, ""), (None, "a b"), (1, "wher"),
                   (10, "A, b: C!"), (11, prose(99, 30))],
        pages=[(i, u, f"<p>{u}</p>") for i, u in enumerate(urls)]
        + [(100, "u", None), (101, "u", ""), (102, None, "<p>é</p>"), (103, "v\r\nw", "<p>é</p>"), (None, "n", "<p>é</p>")],
        embeddings=[(i, [i % 5 / 8, i % 3 / -8, 0.1 * (i % 11)], i % 3) for i in range(0, 400, 5)]
        + [(1, None, 1), (2, [0.1, None], 1), (3, [float("nan")], 1), (200, [0.1, 0.2, 0.3], None), (300, [0.5], 1),
           (300, [0.5], 1), (7, [], 2), (None, [0.1, 0.1, 0.1], 1)],
    )
    assert same(spark, name, where, "/*.parquet") > 0


@pytest.mark.parametrize("name", [n for n in entry.queries() if n.startswith("op")] + ["pipeline"])
def test_empty_tables(spark, folder, name):
    assert entry.queries()[name](spark, folder()).count() == 0
