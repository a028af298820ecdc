"""Every query of the core against its SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from compare import TABLES, canon
from folio.plans import general, reference
from tests.conftest import SMALL

QUERIES = {**general.QUERIES, **reference.QUERIES}
ORACLES = {**general.SQL, **reference.SQL}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    rel = con.sql(ORACLES[name])
    theirs = canon(rel.fetchall(), rel.columns)
    assert sorted(df.columns) == sorted(rel.columns)
    assert canon([tuple(r) for r in df.collect()], df.columns) == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() >= 0


def test_title_accents_as_in_sql():
    import pandas as pd

    assert list(reference._strip_accents(pd.Series(["tota² é", "ﬁn", None]))) == ["tota² e", "ﬁn", None]


def _nodes(plan):
    yield plan
    for i in range(plan.children().size()):
        yield from _nodes(plan.children().apply(i))


@pytest.mark.parametrize("name", ["hybrid", "confidence_bands", "evaluation", "weighted_fuse", "bm25_stemmed"])
def test_no_row_a_word_of_query_and_document(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan()
    joined = [{x.output().apply(i).name() for i in range(x.output().size())} for x in _nodes(plan) if x.nodeName() == "Join"]
    assert joined and not any({"term", "query_id", "doc_id"} <= names for names in joined)
