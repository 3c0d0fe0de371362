import math
import os

import duckdb
import pytest

from tidemark.plans import queries as Q
from tidemark.sources.report import pivot_report, read_report, table_lines
from tidemark.streaming.windowed import windowed_stats

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return c


def plain(rows):
    return sorted(tuple("nan" if isinstance(v, float) and math.isnan(v) else str(v) for v in r) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query_against_sql(spark, duck, name):
    df = Q.queries()[name](spark, DATA)
    found = duck.execute(Q.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert plain(df.select(*names).collect()) == plain(found.fetchall())


def test_report(spark, tmp_path):
    head = "Benchmark cpu size Mode Cnt Score Error Units"
    p = tmp_path / "report.txt"
    p.write_text(f"{head}\nB.clsum true 64 thrpt 4 10.0 0.1 ops/s\n{head}\nB.clsum true 64 thrpt 2 13.0 0.1 ops/s\nB.stats false 32 thrpt 4 1.5 0.1 ops/s\n")
    lines = [r.line for r in table_lines(pivot_report(read_report(spark, str(p)), ["clsum", "stats_gpu"])).collect()]
    assert lines == ["size clsum stats_gpu", "32 nan 1.500", "64 11.000 nan"]
    p.write_text("Benchmark size Score\n")
    with pytest.raises(Exception, match="other columns"):
        read_report(spark, str(p)).collect()


def test_stream(spark, tmp_path):
    rows = spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id) t, cast(id as double) v from range(120)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = windowed_stats(stream, "t", "v", "1 minute", "1 minute").writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.stats.n, r.stats.mu) for r in spark.table("w").collect()) == [(60, 29.5), (60, 89.5)]


BIG = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(BIG), reason="no test tables")
def test_flatmap_takes_all_of_part(spark):
    part = spark.read.parquet(f"{BIG}/part.parquet").select("p_partkey", "p_size").collect()
    want = sorted((r.p_partkey, x) for r in part for x in range(r.p_size % 4 + 1))
    assert sorted(map(tuple, Q.queries()["q_rdd_flatmap"](spark, BIG).collect())) == want


@pytest.mark.skipif(not os.path.isdir(BIG), reason="no test tables")
def test_product_takes_all_of_part_in_several_groups(spark):
    part = spark.read.parquet(f"{BIG}/part.parquet").select("p_size").collect()
    want = 1
    for r in part:
        want = want * (r.p_size % 5 + 1) % 1000003
    assert len(part) > 2 * 4096 and Q.queries()["q_reduce_product"](spark, BIG).collect() == [(want,)]


@pytest.mark.skipif(not os.path.isdir(BIG), reason="no test tables")
def test_windowed_stats_to_the_last_digit(spark):
    """Here the exact sum of squares lies midway between two of its 9 digits in 88 windows; one thread, as the SQL's own last digit depends on how threads share the rows."""
    c = duckdb.connect(config={"threads": 1})
    c.execute(f"create view events as select * from read_parquet('{BIG}/events.parquet')")
    found = c.execute(Q.oracle_sql()["q_windowed_stats"])
    names = [d[0] for d in found.description]
    assert plain(Q.queries()["q_windowed_stats"](spark, BIG).select(*names).collect()) == plain(found.fetchall())


def test_windowed_stats_in_order(spark):
    rows = spark.sql("select id, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id * 7 % 600) t, case when id % 4 < 3 then concat('b', id % 4) end b, case when id % 4 = 2 then null when id % 97 = 0 then double('NaN') else cast(id * id % 1009 as double) end v from range(30000)")
    made = lambda df: sorted(map(str, windowed_stats(df, "t", "v", "1 minute", "1 minute", ("b",), ("id",)).collect()))
    got = windowed_stats(rows, "t", "v", "1 minute", "1 minute", ("b",), ("id",))
    want = windowed_stats(rows, "t", "v", "1 minute", "1 minute", ("b",))
    assert got.dtypes == want.dtypes
    key = lambda r: (r.start, str(r.b))
    for g, w in zip(sorted(got.collect(), key=key), sorted(want.collect(), key=key), strict=True):
        assert g[:3] == w[:3] and list(g.stats) == pytest.approx(list(w.stats), rel=1e-12, nan_ok=True)
    assert made(rows) == made(rows.repartition(7, "v")) and len(made(rows)) == 40
