"""Driver contract and a DuckDB oracle comparison on the smallest fixture."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from conftest import SMOKE
from quillmark.sources.tables import TABLES

FAST = ["rouge_n", "bleu", "chrf", "meteor", "idf_table", "turn_challenges", "cloze_gain_lead",
        "embedding_match", "answer_coverage", "lm_perplexity", "check_alignment", "build_vocab"]


def test_entry_smoke(spark):
    df = entry(spark)
    assert df.count() > 0
    assert df.columns[0] == "pair_id"


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def _norm(pdf):
    pdf = pdf[sorted(pdf.columns)]
    rows = []
    for rec in pdf.itertuples(index=False):
        rows.append(tuple(None if (isinstance(v, float) and v != v) else
                          (round(v, 6) if isinstance(v, float) else v) for v in rec))
    return sorted(rows, key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, duck, name):
    s = queries()[name](spark, SMOKE).toPandas()
    d = duck.execute(oracle_sql()[name]).df()
    assert sorted(s.columns) == sorted(d.columns)
    assert _norm(s) == _norm(d)
