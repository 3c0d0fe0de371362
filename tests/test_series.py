import math
import os
import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark import Series
from tidemark.functions import stats as S
from tidemark.functions.monoid import Monoid
from tidemark.operators.windows import sliding


def shuffled(spark, values, kind="double", step=7, parts=3):
    rows = [(step * i + 3, v) for i, v in enumerate(values)]
    random.Random(1).shuffle(rows)
    series = Series.from_values(spark, [], kind)
    df = spark.createDataFrame(rows, series.df.schema).repartition(parts)
    return Series(df, ("k0",))


GRID = [(1, 1), (1, 4), (2, 1), (3, 5), (5, 3), (5, 5), (16, 4), (40, 1), (41, 1), (42, 1)]


@pytest.mark.parametrize("n", [0, 1, 41])
def test_windows_against_the_contract(spark, n):
    values = [float((i * 37) % 101) for i in range(n)]
    s = shuffled(spark, values)
    s.df.cache()
    for w, stride in GRID:
        want = [sum(values[j : j + w]) for j in range(0, n - w + 1, stride)]
        assert s.sliding(w, stride, lambda f: f.sum()).collect() == want, (w, stride)


def test_blocks_smaller_than_the_input(spark):
    values = [float(i % 13) for i in range(203)]
    df = shuffled(spark, values).indexed
    for w, stride, block in [(16, 1, 15), (16, 3, 16), (5, 2, 64), (203, 1, 202), (204, 1, 203)]:
        got = [r.x for r in sliding(df, df.schema["x"].dataType, w, stride, lambda f: f.max(), block=block).orderBy("j").collect()]
        assert got == [max(values[j : j + w]) for j in range(0, 203 - w + 1, stride)]
    with pytest.raises(ValueError):
        sliding(df, df.schema["x"].dataType, 16, 1, lambda f: f.max(), block=14)
    for bad in ((0, 1), (1, 0)):
        with pytest.raises(ValueError):
            sliding(df, df.schema["x"].dataType, *bad, lambda f: f.max())


def test_closed_forms(spark):
    n = 1000
    s = Series.range(spark, n, 5)
    st = s.stats()
    assert s.sum() == n * (n - 1) / 2 and s.count() == n
    assert st.n == n and st.mu == (n - 1) / 2 and math.isclose(st.m2 / n, (n * n - 1) / 12)
    assert s.moving_average(16).collect() == [i + 7.5 for i in range(n - 15)]
    assert s.chunk_average(128).collect() == [k * 128 + 63.5 for k in range(n // 128)]
    rdd = s.df.rdd.map(lambda r: r.x).stats()
    assert math.isclose(rdd.sampleVariance(), s.stats_report_df().first().sample_variance)


def test_sums_keep_their_type(spark):
    assert shuffled(spark, [100, 100], "char").sum() == -56
    assert shuffled(spark, [2**31 - 1, 1], "int").sum() == -(2**31)
    assert shuffled(spark, [2**63 - 1, 1], "long").sum() == -(2**63)
    assert shuffled(spark, [], "int").sum() == 0 and shuffled(spark, [], "double").sum() == 0.0
    assert tuple(shuffled(spark, [(1, 2), (3, 4)], "int2").sum()) == (4, 6)
    assert tuple(shuffled(spark, [(1, 2), (3, 4)], "int2").moving_average(2).collect()[0]) == (2.0, 3.0)


def test_empty_single_and_special_stats(spark):
    e = shuffled(spark, []).stats_report_df().first()
    assert e["count"] == 0 and e["mean"] == 0 and e["max"] == -math.inf and e["min"] == math.inf and math.isnan(e["variance"])
    one = shuffled(spark, [4.0]).stats_report_df().first()
    assert one["variance"] == 0 and math.isnan(one["sample_variance"])
    odd = shuffled(spark, [1.0, math.nan, math.inf]).stats()
    assert math.isnan(odd.max) and odd.min == 1.0


@pytest.mark.parametrize("sizes", [(5, 5), (2, 40), (40, 2), (0, 4), (4, 0), (0, 0)])
def test_merge_of_stats(spark, sizes):
    a, b = ([float(i * i % 17) for i in range(n)] for n in sizes)
    sa, sb, both = (shuffled(spark, v).stats_df() for v in (a, b, a + b))
    got = sa.select(F.col("stats").alias("a")).crossJoin(sb.select(F.col("stats").alias("b"))).select(S.merge(F.col("a"), F.col("b")).alias("s")).first().s
    want = both.first().stats
    assert got.n == want.n and got.max == want.max and got.min == want.min
    assert math.isclose(got.mu, want.mu, abs_tol=1e-12) and math.isclose(got.m2, want.m2, abs_tol=1e-9)


def test_reductions(spark):
    s = shuffled(spark, [5, 3, 9, 4], "int")
    assert s.reduce("return max(x, y);", -1) == 9 and s.reduce("return y + x;", 0) == 21
    assert s.reduce("return x * y;", 1) == 540
    assert shuffled(spark, [], "int").reduce("return x * y;", 1) == 1
    logs = Monoid(F.lit(0.0), lambda a, b: a + b, lambda x: F.exp(x.cast("double")), F.log)
    assert math.isclose(s.reduce(logs), math.log(sum(map(math.exp, [5, 3, 9, 4]))))


@pytest.mark.parametrize(
    ("kind", "body", "to", "x", "want"),
    [
        ("int", "return x;", "double", 7, 7.0),
        ("double", "return (int)x;", "int", -3.9, -3),
        ("int", "return x / 2;", "int", -7, -3),
        ("int", "return x % 3 == 1 ? 10 : 20;", "int", 7, 10),
        ("int", "int s = 0; for (int i = 1; i <= 4; ++i) s += i * x; return s;", "int", 2, 20),
        ("int", "if (x > 3) { return 1; } else if (x > 1) { return 2; } return 3;", "int", 2, 2),
        ("double", "return clamp(fma(x, 2.0, 1.0), 0.0, 4.0);", "double", 9.0, 4.0),
        ("double", "return convert_double(x) * INFINITY;", "double", 1.0, math.inf),
        ("double", "return fmax(x, NAN);", "double", 2.0, 2.0),
        ("int", "x <<= 2; x |= 1; return x ^ 3;", "int", 5, 22),
        ("double", "return round(x) + rint(x) + trunc(x);", "double", 2.5, 7.0),
        ("char", "return x + x;", "int", 100, 200),
        ("char", "return x + x;", "char", 100, -56),
        ("short", "return (short)(x * 2);", "int", 20000, -25536),
    ],
)
def test_bodies(spark, kind, body, to, x, want):
    assert shuffled(spark, [x], kind).map(body, to).collect() == [want]


def test_vector_bodies(spark):
    s = shuffled(spark, [(1.0, 2.0)], "double2")
    assert tuple(s.map("return x * 2 + (double2)(1, 5);", "double2").collect()[0]) == (3.0, 9.0)
    assert s.map("return x.s0 - x.s1;", "double").collect() == [-1.0]
    assert tuple(s.map("double2 y = x; y.s1 = 7; return y;", "double2").collect()[0]) == (1.0, 7.0)


@pytest.mark.parametrize("body", ["return y;", "return foo(x);", "while (1) {}", "int i = x; for (; i < x; i++) {} return i;", "x = 2;", "return __import__('os');"])
def test_bodies_outside_the_subset(spark, body):
    with pytest.raises(ValueError):
        shuffled(spark, [1], "int").map(body if "return" in body else body + " //return")


def test_nulls_are_left_out_and_types_checked(spark):
    df = spark.createDataFrame([(1, 1.0, "a"), (2, None, "b")], "k long, v double, t string")
    assert Series.wrap(df, "v", "k").count() == 1
    with pytest.raises(TypeError):
        Series.wrap(df, "t", "k")


def test_plans(spark):
    s = Series.range(spark, 1000, 4)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(s.map("x + 1").map("x * 2").df).count("Project") == 1
    assert "partial_sum" in plan(s.sum_df())
    assert s.cache() is s and s.sum() == 499500 and s.uncache() is s


def test_zip_of_unequal_lengths_fails(spark):
    a, b = shuffled(spark, [1.0, 2.0, 3.0]), shuffled(spark, [4.0, 5.0])
    assert sorted(map(tuple, a.zip(a.map("x + 1")).collect())) == [(0, 1.0, 2.0), (1, 2.0, 3.0), (2, 3.0, 4.0)]
    for x, y in ((a, b), (b, a)):
        with pytest.raises(Exception, match="differ in length"):
            x.zip(y).collect()
        with pytest.raises(Exception, match="differ in length"):
            x.zip(y).count()
    assert a.zip(b, strict=False).count() == 2


def test_reduction_and_zip_by_key(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 1, 10), (None, 5, 7)], "g string, k long, v long")
    s = Series.wrap(df, "v", "k", by="g")
    assert {r.g0: r.value for r in s.reduce_df("return (x * y) % 1000;", 1).collect()} == {"a": 2, "b": 10, None: 7}
    assert {r.g0: r.value for r in s.reduce_df("return max(x, y);", -1).collect()} == {"a": 2, "b": 10, None: 7}
    assert {r.g0: r.value for r in s.reduce_df(Monoid(F.lit(0).cast("long"), lambda x, y: x + y)).collect()} == {"a": 3, "b": 10, None: 7}
    assert sorted(map(tuple, s.zip(s.map("x + 1")).collect()), key=str) == sorted([("a", 0, 1, 2), ("a", 1, 2, 3), ("b", 0, 10, 11), (None, 0, 7, 8)], key=str)
    with pytest.raises(Exception, match="differ in length"):
        s.zip(s.where("k0 > 1")).collect()
    with pytest.raises(ValueError):
        s.zip(Series.wrap(df, "v", "k"))


def test_keys_of_time_without_a_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")  # 02:30 doesn't exist there on that day
    try:
        df = spark.sql("select * from values (timestamp_ntz'2024-03-10 03:00:00', 3), (timestamp_ntz'2024-03-10 01:00:00', 1), (timestamp_ntz'2024-03-10 04:00:00', 4), (timestamp_ntz'2024-03-10 02:30:00', 2) as t(k, v)")
        assert [r.x for r in Series.wrap(df, "v", "k").indexed.orderBy("idx").collect()] == [1, 2, 3, 4]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_null_keys_are_left_out(spark):
    df = spark.createDataFrame([(None, 9), (1, 1), (3, 3), (2, 2)], "k long, v int")
    assert [r.x for r in Series.wrap(df, "v", "k").indexed.orderBy("idx").collect()] == [1, 2, 3]


@pytest.mark.parametrize(("body", "want"), [("return fmax(x, y);", 5.0), ("return fmin(x, y);", 1.0)])
def test_fmax_and_fmin_prefer_numbers(spark, body, want):
    assert shuffled(spark, [1.0, math.nan, 5.0]).reduce(body, want) == want
    assert shuffled(spark, [math.nan], "float").reduce(body, 2.0) == 2.0


def test_a_far_key_makes_no_cell_large(spark):
    n = 20_000
    near = spark.range(n).select((F.col("id") + 10**17).alias("k"), F.col("id").cast("int").alias("v"))
    df = near.union(spark.createDataFrame([(1, -1), (2 * 10**18, n)], "k long, v int"))
    indexed = Series.wrap(df, "v", "k").indexed
    assert indexed.where("idx <> x + 1").count() == 0 and indexed.count() == n + 2
    from tidemark.operators import index

    parts = index.cut(df.select(F.col("k").alias("k0")), "k0").groupBy("__cell", "__part").count().agg(F.max("count")).first()[0]
    assert parts < n / 100


@pytest.mark.parametrize("kind", ["string", "binary"])
def test_texts_as_keys(spark, kind):
    from tidemark.operators import index

    df = spark.range(5000).select(F.format_string("customer-%09d", F.col("id") * 7919 % 100_003).cast(kind).alias("k"), (F.col("id") * 7919 % 100_003).cast("int").alias("v"))
    got = [r.x for r in Series.wrap(df, "v", "k").indexed.orderBy("idx").collect()]
    assert got == sorted(i * 7919 % 100_003 for i in range(5000))
    assert index.cut(df, "k").groupBy("__cell", "__part").count().agg(F.max("count")).first()[0] < 100
    odd = spark.createDataFrame([("", 1), ("a", 2), ("a\u0000", 3), ("aé", 4)], "k string, v int")
    assert [r.x for r in Series.wrap(odd.select(F.col("k").cast(kind).alias("k"), "v"), "v", "k").indexed.orderBy("idx").collect()] == [1, 2, 3, 4]
    assert Series.wrap(odd.where("v > 9"), "v", "k").indexed.collect() == []


@pytest.mark.parametrize("width", [33, 100, 1024])
def test_wide_windows(spark, width):
    rnd = random.Random(width)
    values = [rnd.uniform(-1, 1) * 10 ** rnd.randrange(12) for _ in range(2500)]
    s = shuffled(spark, values)
    got = s.sliding(width, 3, lambda w: F.struct(w.mean().alias("_1"), w.max().alias("_2")), "double2").collect()
    want = [values[i : i + width] for i in range(0, len(values) - width + 1, 3)]
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert math.isclose(g[0], math.fsum(w) / width, rel_tol=1e-9, abs_tol=1e-3) and g[1] == max(w)
    low = shuffled(spark, list(range(400)), "int").sliding(width, 1, lambda w: w.sum()).collect() if width < 400 else []
    assert low == [sum(range(i, i + width)) for i in range(400 - width + 1)] if width < 400 else True


def test_series_of_summaries(spark):
    df = spark.createDataFrame([(i, i % 3, float(i)) for i in range(10)], "k long, g int, v double")
    parts = Series.wrap(Series.wrap(df, "v", "k", by="g").stats_df(), "stats", "g0")
    assert tuple(parts.merged_df().first().stats) == (10, 4.5, pytest.approx(82.5), 9.0, 0.0)
    assert parts.stats_report_df().first()["variance"] == pytest.approx(8.25)
    for bad in (parts.sum_df, parts.stats_df, lambda: parts.moving_average(2), lambda: parts.map("x"), Series.wrap(df, "v", "k").merged_df):
        with pytest.raises(TypeError):
            bad()


def test_what_a_collection_offers(spark, tmp_path):
    s = shuffled(spark, list(range(1000)), "int")
    half = s.sample(0.5, 3)
    assert 400 < half.count() < 600 and half.collect() == Series(s.df.repartition(2), s.keys).sample(0.5, 3).collect()
    assert [r.x for r in s.take(3).collect()] == [0, 1, 2] and s.sample(0).count() == 0 and s.sample(1).count() == 1000
    assert sorted(x for r in s.glom().collect() for x in r.xs) == list(range(1000))
    seen, profile = s.observed("elements_of_s")
    assert seen.sum() == 499500 and profile.get["elements"] == 1000
    s.write(str(tmp_path / "s"))
    assert Series.read(spark, str(tmp_path / "s")).collect() == s.collect() == list(s.iterate())
    assert [r["count"] for r in s.count_approx_distinct().collect()][0] == pytest.approx(1000, rel=0.2)
    p = Series.from_values(spark, [(1, 2), (1, 3), (2, 9)], "int2")
    assert sorted(map(tuple, p.reduce_by_key().collect())) == [(1, 5), (2, 9)]
    q = Series.from_values(spark, [(2, 5), (3, 1)], "int2")
    assert sorted((r.key, r.xs, r.ys) for r in p.cogroup(q).collect()) == [(1, [2, 3], []), (2, [9], [5]), (3, [], [1])]
    assert sorted(map(tuple, p.join(q).collect())) == [(2, 9, 5)]
    assert s.cartesian(q.map("return x.s0;", "int")).count() == 2000
    with pytest.raises(TypeError):
        s.join(s)


def test_sums_of_extremes(spark):
    for kind, bits in (("char", 8), ("short", 16), ("int", 32), ("long", 64)):
        low, high = -(2 ** (bits - 1)), 2 ** (bits - 1) - 1
        for values in ([low, low, low], [high, high, 5], [low, high], [-1, -2, 7]):
            want = (sum(values) - low) % 2**bits + low
            assert shuffled(spark, values, kind).sum() == want, (kind, values)


def test_full_join_in_pieces(spark, monkeypatch):
    monkeypatch.setattr("tidemark.operators.series.PIECE", 3)
    pairs = lambda sql: Series.wrap(spark.sql(sql), F.expr("struct(key as _1, v as _2)"), "id")
    a = pairs("select id, case when id < 20 then 1L when id < 22 then 2L when id < 30 then 3L when id < 33 then null else 4L end key, id % 7 v from range(40)")
    b = pairs("select id, case when id < 5 then 1L when id < 20 then 2L when id < 27 then 5L when id < 29 then null else 4L end key, id % 3 v from range(30)")
    got, want = a.join(b, "full"), a._paired("x").join(b._paired("y"), "key", "full")
    assert got.dtypes == want.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert want.count() > 20 * 5 + 2 * 15


def test_full_join_of_one_key_in_little_memory():
    """16 million pairs of one key, which a heap of 512 MB can't hold at once; in a process of its own, as the session's heap is given."""
    code = """
from pyspark.sql import SparkSession, functions as F
from tidemark import Series
s = SparkSession.builder.master("local[2]").config("spark.driver.memory", "512m").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
a, b = (Series.wrap(s.range(n), F.expr("struct(id div 1000000 as _1, id as _2)"), "id") for n in (8000, 2000))
a.join(b, "full").write.format("noop").mode("overwrite").save()
print("written")
"""
    env = {k: v for k, v in os.environ.items() if k not in ("PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    run = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(__file__).parents[1], timeout=300, env=env)
    assert "written" in run.stdout, run.stderr[-2000:]
