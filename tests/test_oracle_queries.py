"""Every registered query against its DuckDB statement on sf0.001."""

import pytest

import __spark_entry__ as E
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


CORE = sorted(set(E.queries()) - set(E.LLM_QUERIES))   # those have tests of their own


@pytest.mark.parametrize("name", CORE)
def test_query_matches_oracle(spark, con, name):
    res = compare(spark, con, name, E.queries()[name], E.oracle_sql().get(name), SF)
    assert res["status"] in ("ok", "rows-only"), res


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["l_returnflag", "revenue"]
    assert df.count() > 0


def test_every_query_has_sql_or_is_declared_rows_only():
    rows_only = set(CORE) - set(E.oracle_sql())
    assert rows_only <= {"ingest_csv", "ingest_workbooks", "sheet_catalog", "stream_refresh"}


def test_oracle_sql_uses_only_registered_views():
    import re
    views = set("region nation customer supplier part orders lineitem events documents "
                "embeddings pages benchmark labels conversations".split())
    for name, sql in E.oracle_sql().items():
        assert "read_parquet" not in sql and "/root/" not in sql, name
        assert re.fullmatch(r"[a-z][a-z0-9_]*", name), name
        used = set(re.findall(r"\b(?:from|join)\s+([a-z_]+)\b", sql.lower()))
        assert used & views, name
