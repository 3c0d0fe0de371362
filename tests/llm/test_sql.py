import math
import os

import duckdb
import pytest

from tidemark.llm import queries

DATA = "/root/testdata/sf0.001"


def plain(rows):
    return sorted(tuple("nan" if isinstance(v, float) and math.isnan(v) else str(v) for v in r) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_against_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings"):
        duck.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    found = duck.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    df = queries.queries()[name](spark, DATA)
    assert sorted(names) == sorted(df.columns)
    assert plain(df.select(*names).collect()) == plain(found.fetchall())
