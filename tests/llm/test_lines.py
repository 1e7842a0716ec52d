from __future__ import annotations

import duckdb
import pytest

from lyceum.llm import lines, oracle


def make(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_first_occurrence_stays(spark):
    docs = make(spark, [(k, f"menu\nown {k}\n menu ", f"s{k % 6}") for k in range(12)])
    got = {r.doc_id: r.text for r in lines.drop_boilerplate(docs).collect()}
    assert got[0] == "menu\nown 0" and all(got[k] == f"own {k}" for k in range(1, 12))


@pytest.mark.parametrize("sites", [lines.MIN_SITES - 1, lines.MIN_SITES])
def test_threshold_counts_sites_not_documents(spark, sites):
    docs = make(spark, [(k, f"menu\nown {k}", f"s{k % sites}") for k in range(40)])
    gone = lines.report(docs).agg({"n_removed": "sum"}).first()[0]
    assert gone == (39 if sites == lines.MIN_SITES else 0)


def test_many_sites_are_exact_near_the_threshold(spark):
    rows = [(k, "menu\nless" if k else "menu", f"site{k}") for k in range(300)]
    docs = make(spark, rows)
    gone = {r.doc_id: r.n_removed for r in lines.report(docs, min_sites=300).collect()}
    assert sum(gone.values()) == 299 and max(gone.values()) == 1  # "less" stands on 299 sites


def test_same_as_sql(spark, odd_docs, no_docs):
    for frame in (odd_docs, no_docs):
        documents = frame.filter("doc_id is not null").dropDuplicates(["doc_id"]).toPandas()  # noqa: F841 - read by the SQL
        con = duckdb.connect()
        con.register("documents", documents)
        want = sorted(con.sql(oracle.line_dedup(2)).fetchall())
        chosen = spark.createDataFrame(documents, frame.schema) if len(documents) else no_docs
        got = sorted((r.doc_id, r.n_lines, r.n_removed, r.text) for r in lines.report(chosen, min_sites=2).collect())
        assert got == want


def test_all_rows_and_columns_stay(odd_docs):
    out = lines.drop_boilerplate(odd_docs, min_sites=2)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    assert lines.with_lengths(out).filter("n_chars <> length(text)").count() == 0


def test_a_doc_id_with_two_texts_and_a_long_text(spark):
    rows = [(k, f"menu\nown {k}", f"s{k}") for k in range(10)]
    rows += [(50, "menu\nown 50", "s1"), (50, "precious\nother", "s2"), (51, "\n".join(["menu", "mine"] * 30_000), "s3")]
    got = sorted((r.doc_id, r.text) for r in lines.drop_boilerplate(make(spark, rows)).collect() if r.doc_id >= 50)
    assert got == [(50, "own 50"), (50, "precious\nother"), (51, "\n".join(["mine"] * 30_000))]


def test_native_plan(odd_docs):
    plan = lines.report(odd_docs)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
