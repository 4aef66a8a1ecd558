"""Every query with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from groupsight.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tiny}/{t}.parquet')")
    return con


def cell(x) -> str:
    if x is None or pd.isna(x) is True:
        return "~"
    if isinstance(x, bool) or type(x).__name__ == "bool":
        return str(bool(x))
    try:
        return repr(round(float(x), 7) + 0.0) if not math.isinf(float(x)) else str(x)
    except (TypeError, ValueError):
        return str(x)


def rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(cell(x) for x in r) for r in df[names].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.oracles()))
def test_same_rows(name, spark, tiny, duck):
    assert rows(catalog.queries()[name](spark, tiny).toPandas()) == rows(duck.sql(catalog.oracles()[name]).df())


@pytest.mark.parametrize("name", ["p_canonical", "p_strip", "e_dynamic", "m_lr", "m_embed", "s_anova_p", "z_threshold", "j_shared_cols"])
def test_runs(name, spark, tiny):
    assert catalog.queries()[name](spark, tiny).count() > 0
