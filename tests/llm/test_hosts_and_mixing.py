"""Host reputation and mixing: the same as their SQL, and cases worked out by hand."""

from __future__ import annotations

import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from loamline.llm import hosts, mixing, queries


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir("/root/testdata/sf0.01"):
        c.execute(f"create view {f.split('.')[0]} as select * from '/root/testdata/sf0.01/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, db, name):
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.01").toPandas()
    want = db.execute(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda f: sorted(tuple("-" if v is None or v != v else str(v) for v in r) for r in f[sorted(f.columns)].astype(object).itertuples(index=False))
    assert rows(got) == rows(want)


def test_rules_and_parts(spark):
    urls = ["http://A.Example.com/en/71?x", "HTTP://b.com/en/1", "x://example.net/de/8", "x://www.example.net/de/9#f", "x://org/es/", "x://morg/es/", "no url", None, "a://b://c/d", "x://h?q/p", "x://é.COM"]
    rows = hosts.judge(spark.createDataFrame([(i, u, None, 1) for i, u in enumerate(urls)], "page_id long, url string, html string, host int"), hosts.thin_page(F.col("html"))).collect()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}
    assert got == {
        0: ("a.example.com", "/en/71", "example.com/en/7", "allow"), 1: ("b.com", "/en/1", "com/en/", "block"), 2: ("example.net", "/de/8", "example.net/de/8", "block"),
        3: ("www.example.net", "/de/9", "net/de/", "allow"), 4: ("org", "/es/", "org/es/", "block"), 5: ("morg", "/es/", None, "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"),
        8: ("b:", "//c/d", None, "allow"), 9: ("h", "", None, "allow"), 10: ("é.com", "", None, "allow"),
    }


def test_bad_hosts_are_blocked_and_small_ones_shrunk(spark):
    rows = [("bad.example.com", int(i % 20 > 0)) for i in range(400)] + [(f"h{k}.fine.org", int(i == 0)) for k in range(20) for i in range(40)] + [("one.fine.org", 1), ("none.fine.org", None)]
    r = {x.host: x for x in hosts.reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert r["bad.example.com"].blocked and not r["one.fine.org"].blocked and r["one.fine.org"].mean < 0.6 and r["none.fine.org"].n == 0
    assert sum(x.blocked for x in r.values()) == 1


def test_hosts_none(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert hosts.judge(empty, hosts.thin_page(F.col("html"))).collect() == []


SITES = {
    "a.b.co.uk": ("co.uk", "b.co.uk"), "co.uk": ("co.uk", "co.uk"), "x.y.com": ("com", "y.com"), "com": ("com", "com"), "": ("", ""),
    "a.com.mx": ("com.mx", "a.com.mx"), "w.a.co.il:8080": ("co.il", "a.co.il"), "x.github.io": ("github.io", "x.github.io"), "w.x.github.io": ("github.io", "x.github.io"),
    "10.0.0.1": ("10.0.0.1", "10.0.0.1"), "10.0.0.1:80": ("10.0.0.1", "10.0.0.1"), "[::1]:8": ("[::1]", "[::1]"), "u:p@h.d.org.": ("org", "d.org"), "community.de": ("de", "community.de"),
}


def test_suffixes(spark):
    df = spark.createDataFrame([(h,) for h in SITES], "h string")
    got = {r[0]: (r[1], r[2]) for r in df.select("h", hosts.suffix_of(F.col("h")), hosts.domain_of(F.col("h"))).collect()}
    assert got == SITES
    given = df.select("h", hosts.suffix_of(F.col("h"), ("b.co.uk", "y.com"))).collect()
    assert {r[0]: r[1] for r in given}["a.b.co.uk"] == "b.co.uk" and {r[0]: r[1] for r in given}["x.github.io"] == "io"


def test_hosts_of_all_kinds_same_as_sql(spark):
    """Suffixes of two labels, addresses and ports in the query and its SQL."""
    c = duckdb.connect()
    thin, full = "<p>few words</p>", "<p>" + "word " * 150 + "</p>"
    names = [h for h in SITES if h] + ["bad.b.co.uk", "c.b.co.uk", "one.com.mx", "two.com.mx", "y.github.io"]
    rows = [(i, f"http://{names[i % len(names)]}/p{i % 3}", thin if i % len(names) % 3 == 0 or i % 11 == 0 else full) for i in range(1500)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    c.register("pages", df.toPandas())
    got = {tuple(r) for r in hosts.judge(df, hosts.thin_page(F.col("html"))).select("page_id", "host", "path", "rule", "verdict").collect()}
    want = {tuple(None if v is None or v != v else v for v in r) for r in c.execute(f"select page_id, host, path, rule, verdict from ({hosts.SQL})").df().astype(object).itertuples(index=False)}
    assert got == want and {v for *_, v in got} == {"allow", "block"}


def tokens(rows):
    return sum(len((r.text or "").split()) for r in rows)


def test_quotas_and_limits(spark):
    docs = spark.createDataFrame([(i, "w " * (50 + i % 7), "big") for i in range(600)] + [(1000 + i, "w " * 40, "mid") for i in range(60)] + [(2000 + i, "w " * 40, None) for i in range(40)], "doc_id long, text string, source string")
    have = Counter()
    for r in docs.collect():
        have[r.source] += len(r.text.split())
    total = sum(have.values())
    for options in ({"entropy": 0.5, "repeats": None}, {"entropy": None, "repeats": 1.5}, {"entropy": 0.5, "repeats": 1.2}):
        got = mixing.mix(docs, block_tokens=500, **options).collect()
        by = Counter()
        for r in got:
            by[r.source] += len(r.text.split())
        assert total <= tokens(got) + 3 and tokens(got) <= total + 60 * len(have)
        if options["repeats"]:
            assert all(by[s] <= options["repeats"] * have[s] + 60 for s in have)
        copies = Counter(r.doc_id for r in got)
        assert max(copies.values()) - min(copies.get(r.doc_id, 0) for r in docs.filter("source = 'mid'").collect()) <= 3
    cover = mixing.mix(docs, entropy=None, repeats=1.5, cover=True, block_tokens=500).collect()
    counts = Counter(r.doc_id for r in cover)
    assert set(counts) == {r.doc_id for r in docs.collect()} and max(counts.values()) == 2 and all(n == 1 for i, n in counts.items() if i < 1000)


def test_mixing_odd_and_none(odd, none):
    got = mixing.mix(odd, entropy=None, repeats=1.5, cover=True)
    assert got.columns == [*odd.columns, "pass", "block_rank"]
    assert {r.doc_id for r in got.collect()} == {r.doc_id for r in odd.collect()}
    whole = mixing.mix(odd, entropy=None, repeats=1.5, cover=True, passes=False)
    assert whole.schema == odd.schema and {tuple(r) for r in whole.collect()} == {tuple(r) for r in odd.collect()}
    assert [r for r in mixing.mix(odd, columns=["a.b", "source", "doc_id"], cover=True, entropy=None, repeats=1.5).collect() if r[0] != "dot"] == []
    assert mixing.mix(none).collect() == [] and mixing.mix(none, cover=True).collect() == []
