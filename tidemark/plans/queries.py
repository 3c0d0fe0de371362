"""The queries of the series engine by name, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import stats as S
from tidemark.functions.monoid import Monoid
from tidemark.operators.series import Series
from tidemark.sources.report import parse_report, pivot_report, table_lines
from tidemark.streaming.windowed import windowed_stats

Query = Callable[[SparkSession, str], DataFrame]
LINE_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}
#: Cents as whole numbers, so that sums are exact in any order.
CENTS = "cast(round(value * 100) as bigint)"


def _add(name: str, query: Query, sql: str) -> None:
    _queries[name], _sql[name] = query, sql


def _table(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def _series(table: str, value: str, *keys: str, **more) -> Callable[[SparkSession, str], Series]:
    return lambda s, d: Series.wrap(_table(s, d, table), F.expr(value), keys, **more)


events = _series("events", CENTS, "event_id")
prices = _series("lineitem", "l_extendedprice", *LINE_KEY)
sizes = _series("part", "p_size", "p_partkey")
vec2 = _series("lineitem", "struct(l_quantity as _1, l_extendedprice as _2)", *LINE_KEY)
embedding4 = _series("embeddings", "struct(cast(round(cast(embedding[0] as double) * 1000000) as bigint) as _1, cast(round(cast(embedding[1] as double) * 1000000) as bigint) as _2, cast(round(cast(embedding[2] as double) * 1000000) as bigint) as _3, cast(round(cast(embedding[3] as double) * 1000000) as bigint) as _4)", "vec_id")
orders2 = _series("orders", "struct(cast(round(o_totalprice * 100) as bigint) as _1, o_custkey as _2)", "o_orderkey")

_key = ", ".join(LINE_KEY)
_line_k = ", ".join(f"{c} k{i}" for i, c in enumerate(LINE_KEY))
_idx = "select row_number() over (order by event_id) - 1 idx, round(value * 100)::bigint x from events"

# -- maps and casts
_add("q_map_affine", lambda s, d: Series.wrap(_table(s, d, "lineitem"), F.expr("struct(l_extendedprice as _1, l_discount as _2)"), LINE_KEY).map(lambda x: x["_1"] * (1 - x["_2"]), "double").df, f"select {_line_k}, l_extendedprice * (1 - l_discount) x from lineitem")
_add("q_map_chain", lambda s, d: prices(s, d).map("return x * 2 + 1;").map(lambda x: x - 3).to("double").df, f"select {_line_k}, l_extendedprice * 2 + 1 - 3 x from lineitem")
_add("q_map_body_branches", lambda s, d: sizes(s, d).map("int y = x; for (int i = 0; i < 3; i++) { y += i * x; } if (y % 2 == 0) { return y / 2; } else { return -y; }", "int").df, "select p_partkey k0, (case when (p_size * 4) % 2 = 0 then p_size * 4 // 2 else -(p_size * 4) end)::int x from part")
_add("q_map_sql", lambda s, d: sizes(s, d).map("x * x + 1", "long").df, "select p_partkey k0, (p_size * p_size + 1)::bigint x from part")
_add("q_to_double", lambda s, d: sizes(s, d).to("double").df, "select p_partkey k0, p_size::double x from part")
_add("q_to_int", lambda s, d: _series("events", "value", "event_id")(s, d).to("int").df, "select event_id k0, trunc(value)::int x from events")
_add("q_map_vec2", lambda s, d: vec2(s, d).map("return x * (double2)(2.0, 0.5);", "double2").df.select("k0", "k1", "k2", "k3", "k4", "k5", F.col("x._1").alias("x1"), F.col("x._2").alias("x2")), f"select {_line_k}, l_quantity * 2.0::double x1, l_extendedprice * 0.5::double x2 from lineitem")

# -- reductions
_add("q_sum_double", lambda s, d: events(s, d).to("double").sum_df(), "select sum(round(value * 100)::bigint)::double as sum from events")
_add("q_sum_int", lambda s, d: sizes(s, d).sum_df(), "select (((sum(p_size) + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648)::int as sum from part")
_add("q_sum_long", lambda s, d: _series("orders", "o_orderkey", "o_orderkey")(s, d).sum_df(), "select sum(o_orderkey)::bigint as sum from orders")
_add("q_sum_byte_wrap", lambda s, d: _series("lineitem", "cast(l_quantity as tinyint)", *LINE_KEY)(s, d).sum_df(), "select (((sum(trunc(l_quantity)::int) + 128) % 256 + 256) % 256 - 128)::tinyint as sum from lineitem")
_add("q_sum_wide", lambda s, d: sizes(s, d).sum_wide_df(), "select sum(p_size)::bigint as sum from part")
_add("q_sum_vec4", lambda s, d: embedding4(s, d).sum_df().select(*[F.col(f"sum._{i}").alias(f"s{i}") for i in range(1, 5)]), "select " + ", ".join(f"sum(round(cast(embedding[{i}] as double) * 1000000)::bigint)::bigint s{i}" for i in range(1, 5)) + " from embeddings")
_add("q_sum_empty", lambda s, d: sizes(s, d).where("x < 0").sum_df(), "select coalesce(sum(p_size), 0)::int as sum from part where p_size < 0")
_add("q_count", lambda s, d: _series("orders", "o_totalprice", "o_orderkey")(s, d).count_df(), "select count(*) as count from orders")
_stats = "count({x}) n, coalesce(avg({x}), 0)::double mean, coalesce(max({x}), '-inf'::double)::double as max, coalesce(min({x}), 'inf'::double)::double as min"
#: The sum of squared differences to 9 digits, which hold whatever order Spark and DuckDB add up in.
_m2 = lambda m: F.format_string("%.9e", m).alias("m2")
_stats += ", format('{{:.9e}}', coalesce(var_pop({x}) * count({x}), 0)) m2"
_parts = lambda c: (F.col(f"{c}.n").alias("n"), F.col(f"{c}.mu").alias("mean"), F.col(f"{c}.max").alias("max"), F.col(f"{c}.min").alias("min"), _m2(F.col(f"{c}.m2")))
_add("q_stats", lambda s, d: events(s, d).stats_df().select(*_parts("stats")), f"select {_stats.format(x='x')} from ({_idx})")
_add("q_stats_accessors", lambda s, d: sizes(s, d).stats_report_df().select("count", "mean", "max", "min", *[F.round(c, 6).alias(c) for c in ("variance", "sample_variance", "stdev", "sample_stdev")]), "select count(*) as count, avg(p_size) mean, max(p_size)::double as max, min(p_size)::double as min, round(var_pop(p_size), 6) as variance, round(var_samp(p_size), 6) sample_variance, round(stddev_pop(p_size), 6) stdev, round(stddev_samp(p_size), 6) sample_stdev from part")
_add("q_stats_empty", lambda s, d: events(s, d).where("x < -1000000000000").stats_report_df().drop("text"), "select 0::bigint as count, 0::double mean, 0::double as sum, '-inf'::double as max, 'inf'::double as min, 'nan'::double as variance, 'nan'::double sample_variance, 'nan'::double stdev, 'nan'::double sample_stdev")
_add("q_stats_text", lambda s, d: sizes(s, d).stats_report_df().select("text"), "select format('(count: {:d}, mean: {:.6f}, stdev: {:.6f}, max: {:.6f}, min: {:.6f})', count(*), avg(p_size), stddev_pop(p_size), max(p_size)::double, min(p_size)::double) as text from part")


def _merged(s: SparkSession, d: str) -> DataFrame:
    """The summaries of each type of event as a series of summaries, which merge into one."""
    by_type = _series("events", CENTS, "event_id", by="event_type")(s, d).stats_df()
    return Series.wrap(by_type, "stats", "g0").merged_df().select(F.col("stats.n").alias("n"), F.round("stats.mu", 6).alias("mean"), F.col("stats.max").alias("max"), F.col("stats.min").alias("min"), _m2(F.col("stats.m2")))


_add("q_stats_merge", _merged, f"select count(x) n, round(avg(x), 6) mean, max(x)::double as max, min(x)::double as min, format('{{:.9e}}', var_pop(x) * count(x)) m2 from ({_idx})")
_add("q_reduce_max", lambda s, d: _series("orders", "o_totalprice", "o_orderkey")(s, d).reduce_df("return max(x, y);", float("-inf")), "select max(o_totalprice) as value from orders")
_add("q_reduce_min", lambda s, d: _series("orders", "o_totalprice", "o_orderkey")(s, d).reduce_df("return min(x, y);", float("inf")), "select min(o_totalprice) as value from orders")
_add("q_reduce_bitxor", lambda s, d: sizes(s, d).reduce_df("return x ^ y;", 0), "select bit_xor(p_size) as value from part")
_add("q_reduce_product", lambda s, d: sizes(s, d).map("x % 5 + 1", "long").reduce_df("return (x * y) % 1000003;", 1), "select list_reduce(list((p_size % 5 + 1)::bigint), lambda x, y: (x * y) % 1000003) as value from part")
_add("q_reduce_body", lambda s, d: sizes(s, d).to("long").reduce_df("if (x > y) { return x; } return y;", -1), "select max(p_size)::bigint as value from part")


def _pair() -> Monoid:
    long = lambda v: F.lit(v).cast("bigint")
    both = lambda s, q: F.struct(s.alias("s"), q.alias("q"))
    return Monoid(both(long(0), long(0)), lambda a, b: both(a["s"] + b["s"], a["q"] + b["q"]), lambda x: both(x.cast("bigint"), x.cast("bigint") * x))


_add("q_reduce_custom", lambda s, d: sizes(s, d).reduce_df(_pair()).select(F.col("value.s").alias("s"), F.col("value.q").alias("q")), "select sum(p_size)::bigint s, sum(p_size * p_size)::bigint q from part")
_add("q_map_reduce_fused", lambda s, d: prices(s, d).map(lambda x: F.round(x * 100), "long").map("return x + 1;").sum_df(), "select sum(round(l_extendedprice * 100)::bigint + 1)::bigint as sum from lineitem")


# -- windows
def _window_sql(width: int, stride: int, value: str, source: str = _idx) -> str:
    return f"select idx // {stride} as j, v as x from (select idx, {value} v, count(*) over w n from ({source}) window w as (order by idx rows between current row and {width - 1} following)) where n = {width} and idx % {stride} = 0"


for _w in (4, 16, 32, 128):
    _add(f"q_moving_average_{_w}", lambda s, d, w=_w: events(s, d).moving_average(w).df, _window_sql(_w, 1, f"(sum(x) over w)::double / {_w}"))
_orders = "select row_number() over (order by o_orderkey) - 1 idx, round(o_totalprice * 100)::bigint a, o_custkey b from orders"
_add("q_moving_average_vec2", lambda s, d: orders2(s, d).moving_average(8).df.select("j", F.col("x._1").alias("a"), F.col("x._2").alias("b")), f"select idx as j, a, b from (select idx, (sum(a) over w)::double / 8 a, (sum(b) over w)::double / 8 b, count(*) over w n from ({_orders}) window w as (order by idx rows between current row and 7 following)) where n = 8")
_add("q_sliding_overlap", lambda s, d: events(s, d).sliding(5, 3, lambda w: w.sum()).df, _window_sql(5, 3, "(sum(x) over w)::bigint"))
_add("q_sliding_gap", lambda s, d: events(s, d).sliding(3, 5, lambda w: w.max()).df, _window_sql(3, 5, "max(x) over w"))
_add("q_sliding_unit", lambda s, d: events(s, d).sliding(1, 1, "return GET(0);", "long").df, _window_sql(1, 1, "x"))
_add("q_sliding_weighted", lambda s, d: events(s, d).sliding(4, 1, "long s = 0; for (int i = 0; i < 4; i++) { s += (i + 1) * GET(i); } return s;", "long").df, _window_sql(4, 1, "x + 2 * lead(x, 1) over o + 3 * lead(x, 2) over o + 4 * lead(x, 3) over o").replace("window w as", "window o as (order by idx), w as"))
_add("q_sliding_body", lambda s, d: events(s, d).sliding(7, 2, "return GET(6) - GET(0);", "long").df, _window_sql(7, 2, "lead(x, 6) over o - x").replace("window w as", "window o as (order by idx), w as"))
_add("q_sliding_elements", lambda s, d: events(s, d).sliding(6, 6, lambda w: F.aggregate(w.elements(), F.lit(0).cast("bigint"), lambda a, x: a * 3 + x)).df, _window_sql(6, 6, " + ".join(f"{3 ** (5 - i)} * lead(x, {i}) over o" for i in range(6))).replace("window w as", "window o as (order by idx), w as"))
_lines = f"select row_number() over (order by {_key}) - 1 idx, round(l_extendedprice * 100)::bigint x from lineitem"
for _w in (16, 128, 1024):
    _add(f"q_chunk_avg_{_w}", lambda s, d, w=_w: _series("lineitem", "cast(round(l_extendedprice * 100) as bigint)", *LINE_KEY)(s, d).chunk_average(w).df, _window_sql(_w, _w, f"(sum(x) over w)::double / {_w}", _lines))
_add("q_sliding_wider_than_input", lambda s, d: _series("nation", "n_nationkey", "n_nationkey")(s, d).sliding(26, 1, lambda w: w.sum()).df, "select 0::bigint j, 0::int x where false")
_add("q_sliding_then_sum", lambda s, d: events(s, d).sliding(5, 3, lambda w: w.sum()).sum_df(), f"select sum(x)::bigint as sum from ({_window_sql(5, 3, '(sum(x) over w)::bigint')})")
_add("q_map_then_sliding", lambda s, d: events(s, d).map("return 2 * x;").sliding(4, 2, lambda w: w.min()).df, _window_sql(4, 2, "2 * min(x) over w"))
_add("q_sliding_twice", lambda s, d: events(s, d).sliding(4, 2, lambda w: w.sum()).sliding(3, 3, lambda w: w.sum()).df, _window_sql(3, 3, "(sum(x) over w)::bigint", f"select j idx, x from ({_window_sql(4, 2, '(sum(x) over w)::bigint')})"))



def _tripled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = pc.multiply(b.column(1).cast(pa.int64()), 3)
        yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), x], names=["k0", "x"])


def _squared(x: pa.Array) -> pa.Array:
    return pc.add(pc.multiply(x, x), 1)


# -- lifecycle, report, what a collection offers anyway


def _cached(s: SparkSession, d: str) -> DataFrame:
    """One row of stats and count of the cached series, made before it is uncached."""
    kept = events(s, d).cache()
    try:
        row = kept.stats_df().select(*_parts("stats")).crossJoin(kept.count_df("n_counted"))  # one row each
        return s.createDataFrame(row.collect(), row.schema)
    finally:
        kept.uncache()


_add("q_cached_stats", _cached, f"select {_stats.format(x='x')}, count(*) n_counted from ({_idx})")
_REPORT = "(values ('clsum', 'true', 64, 4, 10.0), ('clsum', 'true', 64, 2, 13.0), ('clsum', 'false', 64, 4, 100.0), ('stats', 'true', 64, 4, 7.5), ('clsum', 'true', 128, 4, 11.0)) t(name, cpu, size, cnt, score)"
_REPORT_NAMES = ["clsum", "clsum_gpu", "stats"]


def _report(s: SparkSession, d: str) -> DataFrame:
    return pivot_report(s.sql(f"select name, cpu, cast(size as bigint) size, cast(cnt as bigint) cnt, cast(score as double) score from {_REPORT}"), _REPORT_NAMES)


_add("q_report_pivot", _report, f"select size::bigint as size, {', '.join(f'sum(case when n = {chr(39)}{n}{chr(39)} then score * cnt end)::double / sum(case when n = {chr(39)}{n}{chr(39)} then cnt end)::double as {n}' for n in _REPORT_NAMES)} from (select *, name || case when cpu = 'false' then '_gpu' else '' end n from {_REPORT}) group by size")
_add("q_report_table", lambda s, d: table_lines(_report(s, d)), "select null::bigint as size, 'size clsum clsum_gpu stats' as line union all select 64::bigint, '64 11.000 100.000 7.500' union all select 128, '128 11.000 nan nan'")
_HEAD = "Benchmark cpu size Mode Cnt Score Error Units"
#: A report's text: a line for each order, under a header that comes again with each hundredth.
_TEXT = "case when o_orderkey % 100 = 0 then '{head}' else concat('Suite.c', o_orderkey % 7, ' ', case when o_orderkey % 2 = 0 then 'true' else 'false' end, '  ', o_orderkey % 5, ' thrpt 4 ', o_custkey, '.5 0.1 ops/s') end".format(head=_HEAD)
_add("q_report_read", lambda s, d: parse_report(_table(s, d, "orders").select(F.expr(_TEXT).alias("value"))), "select 'c' || (o_orderkey % 7) as name, case when o_orderkey % 2 = 0 then 'true' else 'false' end cpu, (o_orderkey % 5)::bigint as size, 4::bigint cnt, o_custkey + 0.5::double score from orders where o_orderkey % 100 <> 0")
_add("q_rdd_filter", lambda s, d: sizes(s, d).where("x > 25").df, "select p_partkey k0, p_size x from part where p_size > 25")
_add("q_rdd_distinct", lambda s, d: sizes(s, d).distinct(), "select distinct p_size x from part")
_add("q_rdd_topk", lambda s, d: _series("orders", "o_totalprice", "o_orderkey")(s, d).top(20), "select o_orderkey k0, o_totalprice x from orders order by x desc, k0 limit 20")
_add("q_rdd_sort", lambda s, d: sizes(s, d).df.orderBy("x", "k0"), "select p_partkey k0, p_size x from part")
_nations = _series("nation", "n_nationkey", "n_nationkey")
_customers = _series("customer", "c_nationkey", "c_custkey")
_add("q_rdd_union", lambda s, d: _nations(s, d).union(_customers(s, d)), "select n_nationkey x from nation union all select c_nationkey from customer")
_add("q_rdd_intersect", lambda s, d: _nations(s, d).intersect(_customers(s, d)), "select n_nationkey x from nation intersect select c_nationkey from customer")
_add("q_rdd_subtract", lambda s, d: _customers(s, d).subtract(_nations(s, d)), "select c_nationkey x from customer except all select n_nationkey from nation")
_add("q_rdd_zip", lambda s, d: _customers(s, d).zip(_series("customer", "cast(round(c_acctbal * 100) as bigint)", "c_custkey")(s, d)), "select row_number() over (order by c_custkey) - 1 idx, c_nationkey x, round(c_acctbal * 100)::bigint y from customer")
_add("q_rdd_flatmap", lambda s, d: sizes(s, d).flat_map(lambda x: F.sequence(F.lit(0), x % 4)), "select p_partkey k0, unnest(range(0, p_size % 4 + 1))::int x from part")
_pairs = lambda table, key, value, order: _series(table, f"struct({key} as _1, {value} as _2)", order)
_c2, _s2 = _pairs("customer", "cast(c_nationkey as bigint)", "cast(c_custkey as bigint)", "c_custkey"), _pairs("supplier", "cast(s_nationkey * 2 as bigint)", "cast(s_suppkey as bigint)", "s_suppkey")
_add("q_rdd_outer_join", lambda s, d: _c2(s, d).join(_s2(s, d), "full"), "select coalesce(c_nationkey, s_nationkey * 2)::bigint as key, c_custkey::bigint x, s_suppkey::bigint y from customer full join supplier on c_nationkey = s_nationkey * 2")
_add("q_rdd_left_join", lambda s, d: _c2(s, d).join(_s2(s, d), "left"), "select c_nationkey::bigint as key, c_custkey::bigint x, s_suppkey::bigint y from customer left join supplier on c_nationkey = s_nationkey * 2")
_add("q_rdd_cogroup", lambda s, d: _c2(s, d).cogroup(_s2(s, d)).select("key", F.concat_ws(",", F.col("xs").cast("array<string>")).alias("xs"), F.concat_ws(",", F.col("ys").cast("array<string>")).alias("ys")), "select coalesce(a.key, b.key) as key, coalesce(xs, '') xs, coalesce(ys, '') ys from (select c_nationkey::bigint as key, string_agg(c_custkey::varchar, ',' order by c_custkey) xs from customer group by 1) a full join (select (s_nationkey * 2)::bigint as key, string_agg(s_suppkey::varchar, ',' order by s_suppkey) ys from supplier group by 1) b on a.key = b.key")
_add("q_rdd_pairs_reduce", lambda s, d: _c2(s, d).reduce_by_key(), "select c_nationkey::bigint as key, sum(c_custkey)::bigint as sum from customer group by 1")
_add("q_rdd_cartesian", lambda s, d: _nations(s, d).cartesian(_series("region", "r_regionkey", "r_regionkey")(s, d)), "select n_nationkey x, r_regionkey y from nation cross join region")
_add("q_rdd_map_partitions", lambda s, d: sizes(s, d).map_batches(_tripled, "k0 long, x long").select("k0", "x"), "select p_partkey::bigint k0, (p_size * 3)::bigint x from part")
_add("q_rdd_glom", lambda s, d: sizes(s, d).glom().select(F.explode("xs").alias("x")).groupBy("x").agg(F.count("*").alias("n")), "select p_size x, count(*) n from part group by 1")
_add("q_rdd_take", lambda s, d: sizes(s, d).take(10), "select p_partkey k0, p_size x from part order by k0 limit 10")
_add("q_rdd_repartition", lambda s, d: _series("events", CENTS, "event_id", partitions=7)(s, d).repartition(5).coalesce(2).moving_average(16).df, _window_sql(16, 1, "(sum(x) over w)::double / 16"))
_add("q_rdd_count_approx_distinct", lambda s, d: sizes(s, d).count_approx_distinct(0.01).select(F.col("count").between(40, 60).alias("near_fifty")), "select count(distinct p_size) between 40 and 60 as near_fifty from part")
_add("q_map_arrow", lambda s, d: sizes(s, d).to("long").map_arrow(_squared, "long").df, "select p_partkey k0, (p_size * p_size + 1)::bigint x from part")
_add("q_rdd_join", lambda s, d: _table(s, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("x")).join(_table(s, d, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("y")), "k"), "select c_nationkey k, c_custkey x, s_suppkey y from customer join supplier on c_nationkey = s_nationkey")
_add("q_rdd_reduce_by_key", lambda s, d: _series("customer", "cast(round(c_acctbal * 100) as bigint)", "c_custkey", by="c_nationkey")(s, d).sum_df(), "select c_nationkey g0, sum(round(c_acctbal * 100)::bigint)::bigint as sum from customer group by 1")
_add("q_rdd_histogram", lambda s, d: sizes(s, d).to("double").histogram(0.0, 50.0, 10), "select least(floor(p_size / 5.0), 9)::bigint bucket, count(*) n from part where p_size between 0 and 50 group by 1")

# -- a series for each key
_add("q_keyed_stats", lambda s, d: _series("events", CENTS, "event_id", by="event_type")(s, d).stats_df().select("g0", *_parts("stats")), f"select event_type g0, {_stats.format(x='x')} from (select event_type, round(value * 100)::bigint x from events) group by 1")
_add("q_keyed_moving_average", lambda s, d: _series("events", CENTS, "event_id", by="event_type")(s, d).moving_average(8).df, "select g0, j, x from (select event_type g0, row_number() over (partition by event_type order by event_id) - 1 j, (sum(round(value * 100)::bigint) over w)::double / 8 x, count(*) over w n from events window w as (partition by event_type order by event_id rows between current row and 7 following)) where n = 8")

_by_type = _series("events", CENTS, "event_id", by="event_type")
_add("q_keyed_reduce_body", lambda s, d: _by_type(s, d).map("abs(x) % 5 + 1", "long").reduce_df("return (x * y) % 1000003;", 1), "select event_type g0, list_reduce(list((abs(round(value * 100)::bigint) % 5 + 1)::bigint), lambda x, y: (x * y) % 1000003) as value from events group by 1")
_add("q_keyed_zip", lambda s, d: _by_type(s, d).zip(_series("events", "event_id", "event_id", by="event_type")(s, d)), "select event_type g0, row_number() over (partition by event_type order by event_id) - 1 idx, round(value * 100)::bigint x, event_id y from events")
_add("q_moving_average_ts_key", lambda s, d: _series("events", CENTS, "ts")(s, d).moving_average(16).df, _window_sql(16, 1, "(sum(x) over w)::double / 16", "select row_number() over (order by ts) - 1 idx, round(value * 100)::bigint x from events"))
_add("q_moving_average_text_key", lambda s, d: Series.wrap(_table(s, d, "customer").withColumn("t", F.format_string("c-%09d", (F.col("c_custkey") * 7919) % 1000003)), F.expr("cast(round(c_acctbal * 100) as bigint)"), ("t", "c_custkey")).moving_average(5).df, _window_sql(5, 1, "(sum(x) over w)::double / 5", "select row_number() over (order by (c_custkey * 7919) % 1000003, c_custkey) - 1 idx, round(c_acctbal * 100)::bigint x from customer"))
_add("q_moving_average_1024", lambda s, d: events(s, d).moving_average(1024).df, _window_sql(1024, 1, "(sum(x) over w)::double / 1024"))
_add("q_sliding_wide_max", lambda s, d: events(s, d).sliding(100, 7, lambda w: w.max() - w.min()).df, _window_sql(100, 7, "max(x) over w - min(x) over w"))


def _digits(x: pa.Array) -> pa.Array:
    """9 digits of the double itself; Java's format rounds its shortest decimal, which can lie midway when the double doesn't."""
    return pa.array([None if v is None else f"{v:.9e}" for v in x.to_pylist()], pa.string())


_add("q_windowed_stats", lambda s, d: windowed_stats(_table(s, d, "events").withColumn("x", F.expr(CENTS)), "ts", "x", "1 hour", "10 minutes", ("event_type",), ("event_id",)).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", *_parts("stats")[:-1], F.arrow_udf(_digits, "string")("stats.m2").alias("m2")), f"select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') as start, event_type, {_stats.format(x='x')} from (select ts, event_type, round(value * 100)::bigint x from events) group by 1, 2")


# -- all arities and element types
def _micro(i: int) -> str:
    return f"round(cast(embedding[{i}] as double) * 1000000)"


def _wide(n: int, kind: str, scale: int = 1) -> Callable[[SparkSession, str], Series]:
    return _series("embeddings", "struct(" + ", ".join(f"cast({_micro(i)} / {scale} as {kind}) as _{i + 1}" for i in range(n)) + ")", "vec_id")


_flat = lambda df, n: df.select(*[F.col(f"sum._{i + 1}").alias(f"s{i + 1}") for i in range(n)])
_duck = lambda i: f"round(cast(embedding[{i + 1}] as double) * 1000000)"  # noqa: E731  its lists begin with 1
for _n in (8, 16):
    _add(f"q_sum_vec{_n}", lambda s, d, n=_n: _flat(_wide(n, "bigint")(s, d).map(f"return x * 3 - (long{n})(1);", f"long{n}").sum_df(), n), "select " + ", ".join(f"sum({_duck(i)}::bigint * 3 - 1)::bigint s{i + 1}" for i in range(_n)) + " from embeddings")
    _add(f"q_moving_average_vec{_n}", lambda s, d, n=_n: _wide(n, "bigint")(s, d).moving_average(4).df.select("j", *[F.col(f"x._{i + 1}").alias(f"x{i + 1}") for i in range(n)]), "select idx as j, " + ", ".join(f"x{i + 1}" for i in range(_n)) + " from (select idx, " + ", ".join(f"(sum(v{i + 1}) over w)::double / 4 x{i + 1}" for i in range(_n)) + ", count(*) over w n from (select row_number() over (order by vec_id) - 1 idx, " + ", ".join(f"{_duck(i)}::bigint v{i + 1}" for i in range(_n)) + " from embeddings) window w as (order by idx rows between current row and 3 following)) where n = 4")
_add("q_map_char4", lambda s, d: _wide(4, "tinyint", 20_000)(s, d).map("return x.s0 + x.s1 - x.s2 * x.s3;", "int").df, "select vec_id k0, (a + b - c * d)::int x from (select vec_id, " + ", ".join(f"trunc({_duck(i)} / 20000)::int {c}" for i, c in enumerate("abcd")) + " from embeddings)")
_add("q_sum_char", lambda s, d: _series("part", "cast(p_size as tinyint)", "p_partkey")(s, d).sum_df(), "select (((sum(p_size) + 128) % 256 + 256) % 256 - 128)::tinyint as sum from part")
_add("q_sum_short", lambda s, d: _series("part", "cast(p_size * 600 as smallint)", "p_partkey")(s, d).sum_df(), "select (((sum(p_size * 600) + 32768) % 65536 + 65536) % 65536 - 32768)::smallint as sum from part")
_add("q_map_float", lambda s, d: _series("part", "cast(p_size as float)", "p_partkey")(s, d).map("return x * 0.5f + 1.0f;", "float").to("double").df, "select p_partkey k0, (p_size * 0.5 + 1)::double x from part")
_add("q_moving_average_float", lambda s, d: _series("part", "cast(p_size as float)", "p_partkey")(s, d).moving_average(4).df, "select idx as j, v x from (select idx, (sum(x) over w)::double / 4 v, count(*) over w n from (select row_number() over (order by p_partkey) - 1 idx, p_size x from part) window w as (order by idx rows between current row and 3 following)) where n = 4")
_add("q_compare_vec2", lambda s, d: vec2(s, d).df.select(*(f"k{i}" for i in range(6)), (F.col("x") > F.struct(F.lit(25.0).alias("_1"), F.lit(30000.0).alias("_2"))).alias("above")), f"select {_line_k}, (l_quantity > 25 or l_quantity = 25 and l_extendedprice > 30000) above from lineitem")
_add("q_negate_vec4", lambda s, d: embedding4(s, d).map("return -x;", "long4").sum_df().select(*[F.col(f"sum._{i}").alias(f"s{i}") for i in range(1, 5)]), "select " + ", ".join(f"-sum(round(cast(embedding[{i}] as double) * 1000000)::bigint)::bigint s{i}" for i in range(1, 5)) + " from embeddings")
_add("q_moving_average_float4", lambda s, d: _wide(4, "float")(s, d).moving_average(8).df.select("j", *[F.col(f"x._{i + 1}").alias(f"x{i + 1}") for i in range(4)]), "select idx as j, " + ", ".join(f"x{i + 1}" for i in range(4)) + " from (select idx, " + ", ".join(f"(sum(v{i + 1}) over w)::double / 8 x{i + 1}" for i in range(4)) + ", count(*) over w n from (select row_number() over (order by vec_id) - 1 idx, " + ", ".join(f"{_duck(i)}::bigint v{i + 1}" for i in range(4)) + " from embeddings) window w as (order by idx rows between current row and 7 following)) where n = 8")
_add("q_cast_vec2", lambda s, d: vec2(s, d).to("long2").df.select(*(f"k{i}" for i in range(6)), F.col("x._1").alias("x1"), F.col("x._2").alias("x2")), f"select {_line_k}, trunc(l_quantity)::bigint x1, trunc(l_extendedprice)::bigint x2 from lineitem")
_add("q_values_sum", lambda s, d: Series.from_values(s, list(range(1000)), "int").map("return x * x;", "long").sum_df(), "select sum(x * x)::bigint as sum from range(1000) t(x)")


def _profiled(s: SparkSession, d: str) -> DataFrame:
    """One row: the sum of a series, and how many elements passed while it was made."""
    seen, profile = sizes(s, d).to("long").observed("elements of q_profile")
    return s.createDataFrame([(seen.sum(), profile.get["elements"])], "total long, elements long")


_add("q_profile", _profiled, "select sum(p_size)::bigint total, count(*) elements from part")

# -- the workloads over a range of doubles
_N = 1 << 17
_range = f"(select idx, idx::double x from range({_N}) t(idx))"
_of_range = lambda s, d: Series.range(s, _N)
_add("q_range_sum", lambda s, d: _of_range(s, d).sum_df(), f"select sum(x)::double as sum from {_range}")
_add("q_range_stats", lambda s, d: _of_range(s, d).stats_df().select(*_parts("stats")), f"select {_stats.format(x='x')} from {_range}")
for _w in (4, 16, 32, 128):
    _add(f"q_range_moving_average_{_w}", lambda s, d, w=_w: _of_range(s, d).moving_average(w).df, _window_sql(_w, 1, f"(sum(x) over w)::double / {_w}", _range[1:-1]))
for _w in (16, 128, 1024):
    _add(f"q_range_chunk_avg_{_w}", lambda s, d, w=_w: _of_range(s, d).chunk_average(w).df, _window_sql(_w, _w, f"(sum(x) over w)::double / {_w}", _range[1:-1]))


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
