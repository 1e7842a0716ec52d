from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from lyceum.llm import oracle, reputation


def test_same_as_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = sorted(con.sql(f"SELECT page_id, host, path, rule, verdict FROM ({oracle.host_verdicts()})").fetchall(), key=str)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").selectExpr("doc_id AS page_id", "quality AS good")
    got = reputation.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), labels)
    assert sorted(map(tuple, got.select("page_id", "host", "path", "rule", "verdict").collect()), key=str) == want


def judged(spark, urls, outcomes=(), **settings):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    good = spark.createDataFrame(list(outcomes), "page_id long, good int")
    return {r.page_id: r for r in reputation.judge(pages, good, **settings).collect()}


def test_rules_hosts_and_paths(spark):
    urls = ["HTTP://WWW.Example.NET/en/x?q=1#t", "http://a.example.net/es/", "http://b.example.com/de/1", "http://c.example.org/fr/", "http://net", "http://example.net/EN/", None, "no scheme", "x://h?a://b", "http://u@h.com:80/p#f", "http://notexample.com/de/", "http://É.com/É"]
    got = judged(spark, urls)
    parts = [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(len(urls))]
    assert parts == [
        ("www.example.net", "/en/x", "example.net/en/", "allow"), ("a.example.net", "/es/", "net/", "block"), ("b.example.com", "/de/1", "example.com/de/", "block"),
        ("c.example.org", "/fr/", "org/fr/", "allow"), ("net", "", None, "allow"), ("example.net", "/EN/", "net/", "block"), ("", "", None, "allow"),
        ("", "", None, "allow"), ("h", "", None, "allow"), ("u@h.com:80", "/p", None, "allow"), ("notexample.com", "/de/", None, "allow"), ("É.com", "/É", None, "allow"),
    ]


def test_bad_hosts_are_blocked_on_evidence(spark):
    urls = ["http://bad.one.com/"] * 60 + ["http://good.two.com/"] * 60 + ["http://new.one.com/", "http://new.two.com/", "http://rare.three.com/"]
    outcomes = [(i, 0) for i in range(60)] + [(i, 1) for i in range(60, 120)] + [(122, 0), (500, 1), (None, 1), (3, None)]
    got = judged(spark, urls, outcomes)
    assert got[0].verdict == "block" and got[61].verdict == "allow" and got[121].verdict == "allow"
    assert got[120].verdict == "block"  # an unknown host has its domain's reputation


@pytest.mark.parametrize("host,domain,suffix", [("a.b.co.uk", "b.co.uk", "co.uk"), ("x.example.com", "example.com", "com"), ("com", "com", "com"), ("u@w.example.org:8080", "example.org", "org"), ("", "", "")])
def test_domains(spark, host, domain, suffix):
    from pyspark.sql import functions as F

    row = spark.range(1).select(reputation.domain_of(F.lit(host)), reputation.suffix_of(F.lit(host))).first()
    assert tuple(row) == (domain, suffix)


def test_odd_cases(spark):
    pages = spark.createDataFrame(pd.DataFrame({"page_id": [1, 1, 2], "url": ["http://a.com/", "http://a.com/", None], "host": ["x"] * 3, "n": [1] * 3, "a": [2] * 3}))
    good = spark.createDataFrame([(1, 1), (1, 0)], "page_id long, good int")
    assert reputation.judge(pages, good).count() == 3
    assert reputation.judge(pages.limit(0), good).count() == 0
    assert {r.verdict for r in reputation.judge(pages, good.limit(0)).collect()} == {"allow"}
