"""Every core query with an SQL twin gives the same rows as DuckDB on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from convograph.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="session")
def duck(small):
    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{small}/{f}'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(repr(round(v, 6)) if isinstance(v, float) else str(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, small, name):
    a, b = QUERIES[name](spark, small).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, small, name):
    df = QUERIES[name](spark, small)
    assert len(df.collect()) > 0 and df.columns


def test_union_holds_all_platforms(spark, small):
    found = catalogue.file_union(spark, small)
    assert {r.platform for r in found.select("platform").distinct().collect()} == {"chatgpt", "claude", "gemini", "claude-code"}
    gemini = found.where("platform = 'gemini'").agg({"n": "sum"}).first()[0]
    assert gemini == catalogue.render_gemini_days(spark, small).count() > 0


def test_one_pass_terms_equal_the_separate_ones(spark, small):
    from convograph.operators import terms

    docs = catalogue._docs(spark, small)
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert same(terms.own_topics(docs), terms.topic_scores(terms.keywords(docs), terms.noun_phrases(docs)))
    assert same(terms.own_entities(docs), terms.entity_scores(terms.capitalised_phrases(docs), terms.regex_entities(docs)))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() >= 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
