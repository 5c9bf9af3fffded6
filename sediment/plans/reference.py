"""Queries of the engine's own operators over the given tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.functions import aggregates as A
from sediment.functions import dates as D
from sediment.functions import json_fns as J
from sediment.functions import scalar as S
from sediment.operators import fts, history, relational
from sediment.operators.snapshot_diff import consecutive
from sediment.runtime import table, workspace
from sediment.sources import export, ingest
from sediment.sources.kv import KeyValue, as_table
from sediment.sources.lake import Lake, Table
from sediment.streaming.series import Rollup, Series, partition_start

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, *names: str):
    out = tuple(table(spark, d, n) for n in names)
    return out[0] if len(out) == 1 else out


def _r(c, n: int = 4):
    return F.round(c, n)


# -- scan, filter, projection ------------------------------------------------------------------------------------------


@query("select l_orderkey, l_linenumber, l_quantity from lineitem where l_shipdate >= timestamp '1995-01-01' and l_discount > 0.05 and l_quantity < 10")
def scan_filter(spark, d):
    return _t(spark, d, "lineitem").filter((F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp_ntz")) & (F.col("l_discount") > 0.05) & (F.col("l_quantity") < 10)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("select o_orderkey, case when o_totalprice > 200000 then 'big' when o_totalprice > 50000 then 'mid' else 'small' end as size, case o_orderstatus when 'F' then 1 when 'O' then 2 else 0 end as code from orders")
def project_case(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_totalprice") > 200000, "big").when(F.col("o_totalprice") > 50000, "mid").otherwise("small").alias("size"), F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(0).alias("code"))


@query("select p_partkey, p_size from part where p_size between 10 and 20 and p_brand in ('Brand#11', 'Brand#12', 'Brand#23') and p_size not between 14 and 16")
def between_in(spark, d):
    return _t(spark, d, "part").filter(F.col("p_size").between(10, 20) & F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#23") & ~F.col("p_size").between(14, 16)).select("p_partkey", "p_size")


@query("select p_partkey, p_name from part where p_name ilike '%A%1_%' or p_type ilike 'e%'")
def like_ascii(spark, d):
    return _t(spark, d, "part").filter(S.like(F.col("p_name"), "%a%1_%") | S.like(F.col("p_type"), "E%")).select("p_partkey", "p_name")


@query("select c_custkey, c_name from customer where c_name glob 'Customer#0000[0-3]*'")
def glob_prefix(spark, d):
    return _t(spark, d, "customer").filter(S.glob(F.col("c_name"), "Customer#0000[0-3]*")).select("c_custkey", "c_name")


@query("select doc_id from documents where regexp_matches(text, '[0-9]+ (INFO|WARN)') and text is not null")
def regexp_find(spark, d):
    return _t(spark, d, "documents").filter(S.regexp(F.col("text"), "[0-9]+ (INFO|WARN)")).select("doc_id")


@query("select doc_id, lang is distinct from 'en' as differs, lang is null as missing from documents")
def is_distinct(spark, d):
    return _t(spark, d, "documents").select("doc_id", (~F.col("lang").eqNullSafe("en")).alias("differs"), F.col("lang").isNull().alias("missing"))


@query("select column1, column2 from (values (1, 'a'), (2, 'b'), (3, null)) v(column1, column2)")
def values_table(spark, d):
    return spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "column1 int, column2 string")


# -- joins -------------------------------------------------------------------------------------------------------------


@query("select o_orderkey, c_name, n_name from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where o_totalprice > 100000")
def inner_join(spark, d):
    o, c, n = _t(spark, d, "orders", "customer", "nation")
    return o.filter("o_totalprice > 100000").join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).select("o_orderkey", "c_name", "n_name")


@query("select c_custkey, o_orderkey from customer left join orders on c_custkey = o_custkey and o_totalprice > 200000 where c_acctbal > 0")
def left_join_residual(spark, d):
    c, o = _t(spark, d, "customer", "orders")
    return c.filter("c_acctbal > 0").join(o, (c.c_custkey == o.o_custkey) & (o.o_totalprice > 200000), "left").select("c_custkey", "o_orderkey")


@query("select k, n_name, r_name from (select n_regionkey as k, n_name from nation) join (select r_regionkey as k, r_name from region) using (k)")
def using_join(spark, d):
    n, r = _t(spark, d, "nation", "region")
    return n.select(F.col("n_regionkey").alias("k"), "n_name").join(r.select(F.col("r_regionkey").alias("k"), "r_name"), "k").select("k", "n_name", "r_name")


@query("select k, s_name, n_name from (select s_nationkey as k, s_name from supplier) natural join (select n_nationkey as k, n_name from nation)")
def natural_join(spark, d):
    s, n = _t(spark, d, "supplier", "nation")
    return s.select(F.col("s_nationkey").alias("k"), "s_name").join(n.select(F.col("n_nationkey").alias("k"), "n_name"), "k").select("k", "s_name", "n_name")


@query("select n_name, r_name from nation cross join region")
def cross_join(spark, d):
    n, r = _t(spark, d, "nation", "region")  # both tables have a fixed size
    return n.crossJoin(F.broadcast(r)).select("n_name", "r_name")


@query("select e.event_id, b.b as band from events e join (select unnest(range(0, 100, 10)) as b) b on e.value >= b.b and e.value < b.b + 10")
def theta_range_join(spark, d):
    e = _t(spark, d, "events")
    bands = spark.range(0, 100, 10).select(F.col("id").alias("band"), (F.col("id") + F.lit(10.0)).alias("high"))
    return relational.range_join(e, bands, "value", "band", "high", 10.0).filter("value < high").select("event_id", "band")


@query("select a.n_name as one, b.n_name as other from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey")
def self_join(spark, d):
    a, b = _t(spark, d, "nation").alias("a"), _t(spark, d, "nation").alias("b")
    return a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))).select(F.col("a.n_name").alias("one"), F.col("b.n_name").alias("other"))


@query("select c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 150000)")
def semi_in(spark, d):
    c, o = _t(spark, d, "customer", "orders")
    return c.join(o.filter("o_totalprice > 150000"), c.c_custkey == o.o_custkey, "left_semi").select("c_custkey")


@query("select o_orderkey from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity > 45 and l_discount < 0.03)")
def semi_exists(spark, d):
    o, li = _t(spark, d, "orders", "lineitem")
    return o.join(li.filter("l_quantity > 45 and l_discount < 0.03"), o.o_orderkey == li.l_orderkey, "left_semi").select("o_orderkey")


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 300000)")
def anti_not_in(spark, d):
    c, o = _t(spark, d, "customer", "orders")
    return relational.not_in_value(c, "c_custkey", o.filter("o_totalprice > 300000"), "o_custkey", "v").filter("v = 1").select("c_custkey")


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F')")
def anti_not_exists(spark, d):
    c, o = _t(spark, d, "customer", "orders")
    return c.join(o.filter("o_orderstatus = 'F'"), c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@query("select doc_id, case when lang not in (select n_name from nation union all select cast(null as varchar)) then 1 when lang in (select n_name from nation) then 0 end as absent from documents")
def not_in_three_valued(spark, d):
    docs, n = _t(spark, d, "documents", "nation")
    names = n.select(F.col("n_name").alias("v")).unionAll(spark.createDataFrame([(None,)], "v string"))
    return relational.not_in_value(docs.select("doc_id", "lang"), "lang", names, "v", "absent").select("doc_id", F.col("absent").cast("int").alias("absent"))


@query("select c_custkey, (select max(o_totalprice) from orders where o_custkey = c_custkey) as most from customer")
def correlated_scalar(spark, d):
    c, o = _t(spark, d, "customer", "orders")
    most = o.groupBy("o_custkey").agg(F.max("o_totalprice").alias("most"))
    return c.join(most, c.c_custkey == most.o_custkey, "left").select("c_custkey", "most")


@query("select c_custkey, o_orderkey from customer left join (select o_custkey, min(o_orderkey) as o_orderkey from orders group by 1) on c_custkey = o_custkey")
def correlated_first_row(spark, d):
    c, o = _t(spark, d, "customer", "orders")
    return relational.first_match(c.select("c_custkey"), o.withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"], [F.col("o_orderkey")], ["o_orderkey"])


@query("select c_custkey, o_orderkey from customer full join (select * from orders where o_totalprice > 250000) on c_custkey = o_custkey")
def beyond_full_join(spark, d):
    c, o = _t(spark, d, "customer", "orders")
    return c.join(o.filter("o_totalprice > 250000"), c.c_custkey == o.o_custkey, "full_outer").select("c_custkey", "o_orderkey")


# -- aggregation -------------------------------------------------------------------------------------------------------


@query(
    "select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, round(avg(l_discount), 6) as avg_disc from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2"
)
def hash_agg(spark, d):
    li = _t(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), _r(F.sum("l_quantity"), 2).alias("sum_qty"), _r(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), _r(F.avg("l_discount"), 6).alias("avg_disc"))


@query("select o_custkey, count(*) as n from orders group by 1 having count(*) > 15")
def having(spark, d):
    return _t(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).filter("n > 15")


@query("select l_suppkey, count(distinct l_partkey) as parts, cast(sum(distinct l_linenumber) as bigint) as lines from lineitem group by 1")
def count_distinct(spark, d):
    return _t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("parts"), F.sum_distinct("l_linenumber").alias("lines"))


@query("select event_type, count(*) filter (where value > 50) as big, round(sum(value) filter (where user_id % 2 = 0), 4) as even from events group by 1")
def agg_filter(spark, d):
    return _t(spark, d, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("big"), _r(F.sum(F.when(F.col("user_id") % 2 == 0, F.col("value")))).alias("even"))


@query("select coalesce(sum(value), 0.0) as nothing, count(*) as n, max(value) as most from events where event_id < 0")
def agg_total(spark, d):
    return _t(spark, d, "events").filter("event_id < 0").agg(A.total(F.col("value")).alias("nothing"), F.count("*").alias("n"), F.max("value").alias("most"))


@query("select n_regionkey, string_agg(n_name, '; ' order by n_name desc) as names from nation group by 1")
def group_concat_ordered(spark, d):
    return _t(spark, d, "nation").groupBy("n_regionkey").agg(A.group_concat(F.col("n_name"), "; ", F.col("n_name"), descending=True).alias("names"))


@query("select o_custkey, max(o_totalprice) as most, arg_max(o_orderkey, o_totalprice) as o_orderkey from orders group by 1")
def bare_max_row(spark, d):
    g = _t(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("most"), A.bare_at_max(F.col("o_totalprice"), F.col("o_orderkey"), tie=F.col("o_orderkey")).alias("r"))
    return g.select("o_custkey", "most", "r.o_orderkey")


@query("select n_regionkey, '[' || string_agg('\"' || n_name || '\"', ',' order by n_nationkey) || ']' as names from nation group by 1")
def json_group_array(spark, d):
    return _t(spark, d, "nation").groupBy("n_regionkey").agg(A.json_group_array(F.col("n_name"), F.col("n_nationkey")).alias("names"))


@query("select n_regionkey, '{' || string_agg('\"' || n_name || '\":' || n_nationkey, ',' order by n_nationkey) || '}' as names from nation group by 1")
def json_group_object(spark, d):
    return _t(spark, d, "nation").groupBy("n_regionkey").agg(A.json_group_object(F.col("n_name"), F.col("n_nationkey"), F.col("n_nationkey")).alias("names"))


@query("select distinct l_returnflag, l_linestatus from lineitem")
def select_distinct(spark, d):
    return _t(spark, d, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("select lower(lang) as lang, count(*) as n from documents group by 1")
def nocase_group(spark, d):
    return _t(spark, d, "documents").groupBy(S.nocase(F.col("lang")).alias("lang")).agg(F.count("*").alias("n"))


# -- order, limit, sets ------------------------------------------------------------------------------------------------


@query("select doc_id, lang from documents order by lang desc nulls last, doc_id limit 200")
def order_nulls(spark, d):
    return _t(spark, d, "documents").select("doc_id", "lang").orderBy(F.desc_nulls_last("lang"), "doc_id").limit(200)


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def top_k(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("select c_custkey from customer order by c_custkey limit 10 offset 20")
def limit_offset(spark, d):
    return relational.limit_offset(_t(spark, d, "customer").select("c_custkey").orderBy("c_custkey"), 10, 20)


@query("select s_nationkey as k from supplier union all select c_nationkey from customer")
def union_all(spark, d):
    s, c = _t(spark, d, "supplier", "customer")
    return relational.compound(s.select(F.col("s_nationkey").alias("k")), ("union all", c.select("c_nationkey")))


@query("select s_nationkey as k from supplier union select c_nationkey from customer")
def union_distinct(spark, d):
    s, c = _t(spark, d, "supplier", "customer")
    return relational.compound(s.select(F.col("s_nationkey").alias("k")), ("union", c.select("c_nationkey")))


@query("select l_partkey as k from lineitem where l_quantity > 49 intersect select p_partkey from part where p_size < 10")
def intersect(spark, d):
    li, p = _t(spark, d, "lineitem", "part")
    return relational.compound(li.filter("l_quantity > 49").select(F.col("l_partkey").alias("k")), ("intersect", p.filter("p_size < 10").select("p_partkey")))


@query("select c_custkey as k from customer except select o_custkey from orders where o_orderstatus = 'F'")
def except_(spark, d):
    c, o = _t(spark, d, "customer", "orders")
    return relational.compound(c.select(F.col("c_custkey").alias("k")), ("except", o.filter("o_orderstatus = 'F'").select("o_custkey")))


@query("(select n_nationkey as k from nation union select s_nationkey from supplier) intersect select c_nationkey from customer where c_nationkey < 9")
def compound_left_to_right(spark, d):
    n, s, c = _t(spark, d, "nation", "supplier", "customer")
    return relational.compound(n.select(F.col("n_nationkey").alias("k")), ("union", s.select("s_nationkey")), ("intersect", c.filter("c_nationkey < 9").select("c_nationkey")))


# -- common table expressions ------------------------------------------------------------------------------------------


@query("with a as (select o_custkey, sum(o_totalprice) as t from orders group by 1), b as (select * from a where t > 1000000) select c_name, round(t, 2) as t from b join customer on c_custkey = o_custkey")
def cte_chain(spark, d):
    o, c = _t(spark, d, "orders", "customer")
    a = o.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("t")).filter("t > 1000000")
    return a.join(c, c.c_custkey == a.o_custkey).select("c_name", _r(F.col("t"), 2).alias("t"))


@query("with recursive r(n) as (select 1 union all select n + 1 from r where n < 12) select n from r")
def recursive_union_all(spark, d):
    return relational.recursive(spark.createDataFrame([(1,)], "n int"), lambda r: r.filter("n < 12").select(F.col("n") + 1), distinct=False)


@query("with recursive r(k) as (select 0 union select (k * 7 + 3) % 25 from r) select k, n_name from r join nation on n_nationkey = k")
def recursive_union_distinct(spark, d):
    r = relational.recursive(spark.createDataFrame([(0,)], "k int"), lambda x: x.select(((F.col("k") * 7 + 3) % 25).alias("k")))
    n = _t(spark, d, "nation")
    return r.join(n, r.k == n.n_nationkey).select("k", "n_name")


# -- JSON --------------------------------------------------------------------------------------------------------------


@query("select event_id, props->>'$.k' as k, json_type(props, '$.k') = 'UBIGINT' as whole, json_valid(props)::int as ok from events")
def json_extract_props(spark, d):
    return _t(spark, d, "events").select("event_id", J.extract(F.col("props"), "$.k").alias("k"), (J.type_at(F.col("props"), "$.k") == "integer").alias("whole"), J.valid(F.col("props")).alias("ok"))


@query("select e.event_id, j.key, j.value::varchar as value from events e, json_each(e.props) j")
def json_each(spark, d):
    return J.each(_t(spark, d, "events").select("event_id", "props"), "props").select("event_id", "key", "value")


@query("select sha256, json_array_length(tags)::int as n from (select distinct lower(hex(sha256)) as sha256, tags from zx_meta where json_valid(tags))")
def json_array_length(spark, d):
    m = _t(spark, d, "zx_meta").filter(J.valid(F.col("tags")) == 1).select(F.lower(F.hex("sha256")).alias("sha256"), "tags").distinct()
    return m.select("sha256", J.array_length(F.col("tags")).alias("n"))


@query("select n_nationkey, '{\"name\":\"' || n_name || '\",\"region\":' || n_regionkey || ',\"none\":null}' as j from nation")
def json_object(spark, d):
    return _t(spark, d, "nation").select("n_nationkey", J.object_(name=F.col("n_name"), region=F.col("n_regionkey"), none=F.lit(None).cast("string")).alias("j"))


@query("select event_id, '{\"k\":' || (props->>'$.k') || ',\"t\":\"' || event_type || '\"}' as s, '{\"t\":\"' || event_type || '\"}' as r from events")
def json_edit(spark, d):
    return _t(spark, d, "events").select("event_id", J.set_(F.col("props"), "$.t", F.col("event_type")).alias("s"), J.remove(J.set_(F.col("props"), "$.t", F.col("event_type")), "$.k").alias("r"))


# -- dates -------------------------------------------------------------------------------------------------------------


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as t, strftime(o_orderdate, '%j') as doy, strftime(o_orderdate, '%w') as dow, strftime(o_orderdate, '%V') as week, strftime(o_orderdate, '%W') as w from orders")
def strftime_parts(spark, d):
    us = D.micros_of(F.col("o_orderdate"))
    return _t(spark, d, "orders").select("o_orderkey", D.strftime("%Y-%m-%d %H:%M:%S", us).alias("t"), D.strftime("%j", us).alias("doy"), D.strftime("%w", us).alias("dow"), D.strftime("%V", us).alias("week"), D.strftime("%W", us).alias("w"))


@query("select event_id, strftime(date_trunc('month', ts), '%Y-%m-%d') as m, strftime(date_trunc('year', ts), '%Y-%m-%d') as y, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') as day from events")
def date_start_of(spark, d):
    us = D.micros_of(F.col("ts"))
    return _t(spark, d, "events").select("event_id", D.date(us, "start of month").alias("m"), D.date(us, "start of year").alias("y"), D.datetime(us, "start of day").alias("day"))


@query("select event_id, round(epoch_ms(ts) / 86400000.0 + 2440587.5, 6) as jd from events")
def julian(spark, d):
    return _t(spark, d, "events").select("event_id", _r(D.julianday(D.micros_of(F.col("ts"))), 6).alias("jd"))


@query("select event_id, cast(floor(epoch_us(ts) / 1000000) as bigint) as s from events")
def unixepoch(spark, d):
    return _t(spark, d, "events").select("event_id", D.unixepoch(D.micros_of(F.col("ts"))).alias("s"))


@query("select o_orderkey, strftime(make_date(year(o_orderdate) + (month(o_orderdate) // 12), month(o_orderdate) % 12 + 1, 1) + to_days(day(o_orderdate)::int - 1), '%Y-%m-%d') as next from orders")
def date_shift(spark, d):
    """A month later, rolled over at the end of a shorter month."""
    return _t(spark, d, "orders").select("o_orderkey", D.date(D.micros_of(F.col("o_orderdate")), "+1 month").alias("next"))


@query("select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || '.' || lpad(cast(epoch_us(ts) % 1000000 as varchar), 6, '0') || '000' as t from events")
def nanosecond_text(spark, d):
    return _t(spark, d, "events").select("event_id", D.ns_text(D.micros_of(F.col("ts")) * 1000).alias("t"))


# -- text and numbers --------------------------------------------------------------------------------------------------


@query("select p_partkey, round(sqrt(p_retailprice), 6) as a, round(ln(p_retailprice), 6) as b, round(log10(p_retailprice), 6) as c, round(power(p_size, 2), 6) as e, floor(p_retailprice) as f, ceil(p_retailprice) as g, round(sin(p_size), 6) as h from part")
def math_fns(spark, d):
    p, s = F.col("p_retailprice"), F.col("p_size")
    return _t(spark, d, "part").select("p_partkey", _r(S.math("sqrt", p), 6).alias("a"), _r(S.math("ln", p), 6).alias("b"), _r(S.math("log", p), 6).alias("c"), _r(S.math("pow", s, F.lit(2)), 6).alias("e"), S.math("floor", p).alias("f"), S.math("ceil", p).alias("g"), _r(S.math("sin", s), 6).alias("h"))


@query("select c_custkey, lower(c_name) as lo, upper(c_mktsegment) as up, length(c_name) as len, instr(c_name, '#') as at, replace(c_name, '0', '') as rep, trim(c_mktsegment) as tr, unicode(c_mktsegment)::bigint as u, chr(960) as pi from customer")
def text_fns(spark, d):
    n, m = F.col("c_name"), F.col("c_mktsegment")
    return _t(spark, d, "customer").select("c_custkey", S.lower(n).alias("lo"), S.upper(m).alias("up"), S.length(n).alias("len"), S.instr(n, F.lit("#")).alias("at"), S.replace(n, F.lit("0"), F.lit("")).alias("rep"), S.trim(m).alias("tr"), S.unicode(m).alias("u"), S.char(F.lit(960)).alias("pi"))


@query("select doc_id, hex(text) as h, sha256(text) as s from documents where text is not null")
def hex_sha256(spark, d):
    return _t(spark, d, "documents").filter("text is not null").select("doc_id", S.hex_text(F.col("text")).alias("h"), F.lower(F.hex(S.sha256(F.col("text")))).alias("s"))


@query("select c_custkey, substr(c_name, 0, 2) as a, substr(c_name, 1, 3) as b, substr(c_name, -3) as c, substr(c_name, 4) as e from customer")
def substr_zero(spark, d):
    n = F.col("c_name")
    return _t(spark, d, "customer").select("c_custkey", S.substr(n, 0, 2).alias("a"), S.substr(n, 1, 3).alias("b"), S.substr(n, -3).alias("c"), S.substr(n, 4).alias("e"))


@query("select event_id, round(value, 1) as r1, round(value, 0) as r0 from events")
def round_half(spark, d):
    return _t(spark, d, "events").select("event_id", S.round_half(F.col("value"), 1).alias("r1"), S.round_half(F.col("value")).alias("r0"))


@query("select l_orderkey, l_linenumber, l_partkey // l_linenumber as q, case when l_linenumber <> 3 then l_partkey // (l_linenumber - 3) end as z, l_partkey % l_linenumber as m from lineitem")
def integer_division(spark, d):
    p, n = F.col("l_partkey"), F.col("l_linenumber")
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.divide(p, n, integers=True).alias("q"), S.divide(p, n - 3, integers=True).alias("z"), S.modulo(p, n).alias("m"))


@query("select doc_id, coalesce(try_cast(nullif(regexp_extract(text, '^\\s*([+-]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][+-]?\\d+)?)', 1), '') as double), 0.0) as n from documents where text is not null")
def numeric_prefix(spark, d):
    return _t(spark, d, "documents").filter("text is not null").select("doc_id", S.number_of(F.col("text")).alias("n"))


@query("select doc_id, case when lang is null or source is null then null else greatest(lang, source) end as g, case when lang is null or source is null then null else least(lang, source) end as l, coalesce(lang, '') || coalesce(source, '') as c from documents")
def scalar_extremes(spark, d):
    a, b = F.col("lang"), F.col("source")
    return _t(spark, d, "documents").select("doc_id", S.scalar_max(a, b).alias("g"), S.scalar_min(a, b).alias("l"), S.concat(a, b).alias("c"))


@query("select p_partkey, p_size << 3 as a, p_size >> 1 as b, 0::bigint as c from part")
def shifts(spark, d):
    s = F.col("p_size")
    return _t(spark, d, "part").select("p_partkey", S.shift_left(s, F.lit(3)).alias("a"), S.shift_right(s, F.lit(1)).alias("b"), S.shift_left(s, F.lit(64)).alias("c"))


@query("select c_custkey, printf('%05d|%-30s|%.2f', c_custkey, c_name, c_acctbal) as p, '''' || c_mktsegment || '''' as q from customer")
def printf_quote(spark, d):
    return _t(spark, d, "customer").select("c_custkey", S.printf("%05d|%-30s|%.2f", F.col("c_custkey"), F.col("c_name"), F.col("c_acctbal")).alias("p"), S.quote(F.col("c_mktsegment"), "string").alias("q"))


# -- series and rollups ------------------------------------------------------------------------------------------------


def _series(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events")
    return e.select((D.micros_of(F.col("ts")) * 1000).alias("ts"), F.col("event_type").alias("tag"), "value", "user_id", F.col("event_id").alias("seq"))


def _kept_series(spark: SparkSession, d: str, name: str, retention: str | None = None) -> Series:
    """The events as a series on a lake of its own: appended in order of time, not sealed yet."""
    series = Series(Lake(spark, workspace(spark)), name, "ts bigint, tag string, value double, user_id bigint, event_id bigint", "day", retention, ("tag",), seal_rows=1 << 62)
    series.append(_series(spark, d).withColumnRenamed("seq", "event_id"), ["ts", "event_id"])
    return series


def _ns(day: str) -> int:
    return (date.fromisoformat(day) - date(1970, 1, 1)).days * 86_400 * 10**9


@query("select event_id, epoch_us(ts) * 1000 as ts from events where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-20' order by ts desc, event_id desc")
def ts_range_desc(spark, d):
    s = _kept_series(spark, d, "m")
    s.seal()
    return s.rows(_ns("2024-01-05"), _ns("2024-01-20"), descending=True, columns=["event_id", "ts"])


@query("select event_id, value from events where event_type = 'click' and value > 10")
def ts_tag_eq(spark, d):
    s = _kept_series(spark, d, "m")
    s.seal()
    return s.rows(where="tag = 'click' and value > 10", columns=["event_id", "value"])


@query("select event_id from events where event_type in ('click', 'view')")
def ts_search(spark, d):
    """Words of a column, one by its start, over sealed and buffered rows."""
    s = _kept_series(spark, d, "m")
    return s.search("tag", "CLI*").unionByName(s.search("tag", "view")).select("event_id")


def _partition(unit: str):
    def run(spark, d):
        return _series(spark, d).groupBy(partition_start(F.col("ts"), unit).alias("part")).agg(F.count("*").alias("n"))

    run.__name__ = f"ts_partition_{unit}"
    return query(f"select epoch_us(date_trunc('{unit}', ts)) * 1000 as part, count(*) as n from events group by 1")(run)


for _unit in ("hour", "day", "week", "month"):
    _partition(_unit)

ROLLUP = Rollup("six", "6h", ("tag",), {"n": ("count", "*"), "s": ("sum", "value"), "a": ("avg", "value"), "lo": ("min", "value"), "hi": ("max", "value"), "f": ("first", "value"), "l": ("last", "value")})
_BUCKET = "(epoch_us(ts) - epoch_us(ts) % 21600000000) * 1000"
_ROLLED = "count(*) as n, round(sum(value), 4) as s, round(avg(value), 6) as a, min(value) as lo, max(value) as hi, arg_min(value, (ts, event_id)) as f, arg_max(value, (ts, event_id)) as l"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({"s": _r(F.col("s")), "a": _r(F.col("a"), 6)})


@query(f"select {_BUCKET} as bucket, event_type as tag, {_ROLLED} from events group by 1, 2")
def rollup_6h(spark, d):
    return _rounded(ROLLUP.of(_series(spark, d)))


@query(f"select {_BUCKET} as bucket, event_type as tag, {_ROLLED} from events where value >= 50 and event_type <> 'view' group by 1, 2")
def rollup_where(spark, d):
    return _rounded(Rollup("w", "6h", ("tag",), ROLLUP.aggregates, "value >= 50 and tag <> 'view'").of(_series(spark, d)))


@query(f"select {_BUCKET} as bucket, event_type as tag, {_ROLLED} from events group by 1, 2")
def rollup_merge_equals_full(spark, d):
    """Stored states of one part merged with those of the rest."""
    s = _series(spark, d)
    return _rounded(ROLLUP.final(ROLLUP.merged(ROLLUP.states(s.filter("seq % 3 = 0")).unionByName(ROLLUP.states(s.filter("seq % 3 <> 0"))))))


@query(f"select {_BUCKET} as bucket, event_type as tag, {_ROLLED} from events group by 1, 2")
def rollup_stored(spark, d):
    """A rollup made over sealed rows, fed by a second seal, read while the last rows are still buffered."""
    e = _series(spark, d).withColumnRenamed("seq", "event_id")
    s = Series(Lake(spark, workspace(spark)), "m", "ts bigint, tag string, value double, user_id bigint, event_id bigint", "week", seal_rows=1 << 62)
    for i in range(3):
        s.append(e.filter(F.col("event_id") % 3 == i), ["ts", "event_id"])
        if i == 1:
            s.seal()
        if i == 0:
            s.seal()
            s.create_rollup(Rollup("r", "6h", ("tag",), {k: v for k, v in ROLLUP.aggregates.items() if k not in ("f", "l")} | {k: ROLLUP.aggregates[k] for k in ("f", "l")}))
    return _rounded(s.rollup("r"))


@query("select event_id from events where date_trunc('day', ts) + interval 1 day > (select max(ts) - interval 10 day from events)")
def retention(spark, d):
    s = _kept_series(spark, d, "m", "10d")
    s.seal(now_ns=s.rows().agg(F.max("ts")).first()[0])
    return s.rows(columns=["event_id"])


# -- versions ----------------------------------------------------------------------------------------------------------


_LISTED = """with r as (select archive, path, size, generation, row_number() over (partition by archive, generation, path order by loaded_at desc nulls last, size desc nulls last) as rn
  from zx_files where generation <= 3 and archive is not null and path is not null),
l as (select archive, path, size, generation from r where rn = 1)"""


def _listings(spark: SparkSession, d: str) -> Lake:
    """Three listings put over each other in one keyed table: its generations 2, 3 and 4."""
    lake = Lake(spark, workspace(spark))
    lake.create("files", Table("archive string, path string, size bigint", key=("archive", "path")))
    f = _t(spark, d, "zx_files").filter("archive is not null and path is not null").withColumn("__order", D.micros_of(F.col("loaded_at")))
    for g in (1, 2, 3):
        lake.insert("files", f.filter(F.col("generation") == g), conflict="replace")
    return lake


@query(f"{_LISTED} select archive, path, arg_max(size, generation) filter (where size is not null or true) as size from (select archive, path, size, generation from l where generation <= 2 qualify row_number() over (partition by archive, path order by generation desc) = 1) group by 1, 2")
def as_of_generation(spark, d):
    return _listings(spark, d).read("files", generation=3)


@query(f"""{_LISTED}, s as (select *, lag(generation) over w as before, lag(size) over w as old from l window w as (partition by archive, path order by generation))
select generation + 1 as generation, case when before is null then 'insert' else 'update' end as op, archive, path, size from s where before is null or size is distinct from old""")
def lake_history(spark, d):
    return _listings(spark, d).history("files").drop("time_ns")


@query("""with n as (select o_orderkey as id, o_orderstatus as s, o_totalprice as p from orders where o_orderkey % 3 = 0),
u as (select o_orderkey as id, 'U' as s, o_totalprice * 2 as p from orders where o_orderkey % 2 = 0),
m as (select coalesce(n.id, u.id) as id, case when n.id is null or u.p > 100000 then coalesce(u.s, n.s) else n.s end as s, coalesce(n.p, u.p) as p from n full join u on n.id = u.id)
select id, case when p < 50000 then 'small' else s end as s, round(p, 2) as p from m where s <> 'P'""")
def lake_dml(spark, d):
    """Insert, upsert with a condition, update and delete in one transaction."""
    lake, o = Lake(spark, workspace(spark)), _t(spark, d, "orders")
    rows = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("p"))
    lake.create("t", Table("id bigint, s string, p double", key=("id",), not_null=("s",), checks=("p >= 0",)))
    lake.begin()
    lake.insert("t", rows.filter("id % 3 = 0"))
    lake.upsert("t", rows.filter("id % 2 = 0").withColumns({"s": F.lit("U"), "p": F.col("p") * 2}), {"s": "excluded.s"}, "excluded.p > 100000")
    lake.delete("t", "s = 'P'")
    lake.update("t", {"s": "'small'"}, "p < 50000")
    lake.commit()
    return lake.read("t").withColumn("p", _r(F.col("p"), 2))


# -- readers and writers ------------------------------------------------------------------------------------------------


@query("select cast(n_nationkey as varchar) as n_nationkey, n_name || ', \"x\"' as n_name, cast(n_regionkey as varchar) as n_regionkey from nation")
def csv_roundtrip(spark, d):
    folder = workspace(spark)
    export.write_csv(_t(spark, d, "nation").withColumn("n_name", F.concat("n_name", F.lit(', "x"'))), folder)
    return ingest.read_csv(spark, folder)


@query("select o_orderkey, o_orderstatus, o_totalprice from orders")
def jsonl_roundtrip(spark, d):
    folder = workspace(spark)
    export.write_jsonl(_t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), folder)
    return ingest.read_jsonl(spark, folder).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("select epoch_us(date_trunc('second', ts)) as us, 'h' || (user_id % 7) as host, event_type as app, cast(event_id as varchar) as pid, cast(user_id % 8 as int) as level, cast(user_id % 24 as int) as facility, props as message from events")
def syslog_parse(spark, d):
    e = _t(spark, d, "events")
    pri = (F.col("user_id") % 24) * 8 + F.col("user_id") % 8
    line = F.concat(F.lit("<"), pri.cast("string"), F.lit(">1 "), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(" h"), (F.col("user_id") % 7).cast("string"), F.lit(" "), F.col("event_type"), F.lit(" "), F.col("event_id").cast("string"), F.lit(" - - "), F.col("props"))
    p = ingest.parse_syslog(e.select(line.alias("value")))
    level = F.array_position(F.array(*map(F.lit, ingest.LEVELS)), F.col("level")) - 1
    return p.select(F.unix_micros("ts").alias("us"), "host", "app", "pid", level.cast("int").alias("level"), "facility", "message")


@query(
    "with g as (select distinct archive, number from zx_generations), l as (select archive, number, lag(number) over (partition by archive order by number) as b from g) select archive, number, number - b as step from l where b is not null"
)
def generation_steps(spark, d):
    g = consecutive(_t(spark, d, "zx_generations"), "archive", "number")
    return g.filter("before is not null").select("archive", "number", (F.col("number") - F.col("before")).alias("step"))


@query(
    """with v as (select c_custkey as k, g as generation, c_nationkey + case when c_custkey % 5 = 0 and g > 2 then 1 else 0 end as v from customer, (values (1), (2), (3)) t(g)
       where not (c_custkey % 7 = 0 and g = 2) and not (c_custkey % 11 = 0 and g = 3))
       select coalesce(a.generation, b.generation + 1) as generation, case when b.k is null then 'insert' when a.k is null then 'delete' else 'update' end as op, coalesce(a.k, b.k) as k, coalesce(a.v, b.v) as v
       from v a full join v b on a.k = b.k and a.generation = b.generation + 1 where (b.k is null or a.k is null or a.v <> b.v) and coalesce(a.generation, b.generation + 1) <= 3"""
)
def history_of(spark, d):
    c = _t(spark, d, "customer")
    v = c.select(F.col("c_custkey").alias("k"), "c_nationkey", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("generation"))
    v = v.filter("not (k % 7 = 0 and generation = 2) and not (k % 11 = 0 and generation = 3)").select("k", "generation", (F.col("c_nationkey") + F.when((F.col("k") % 5 == 0) & (F.col("generation") > 2), 1).otherwise(0)).alias("v"))
    return history.row_history(v, ["k"])


@query("select lower(hex(sha256)) as sha256, count(*) as n, count(distinct path) as paths from zx_files where sha256 is not null group by 1 having count(*) > 1")
def sha_duplicates(spark, d):
    g = _t(spark, d, "zx_files").filter("sha256 is not null").groupBy("sha256").agg(F.count("*").alias("n"), F.count_distinct("path").alias("paths"))
    return g.filter("n > 1").select(F.lower(F.hex("sha256")).alias("sha256"), "n", "paths")


# -- key-value ---------------------------------------------------------------------------------------------------------


@query("select c_name as key, c_mktsegment as value from customer where c_name >= 'Customer#00000001' and c_name < 'Customer#00000002' order by 1")
def kv_prefix_scan(spark, d):
    kv = KeyValue(Lake(spark, workspace(spark)), "kv")
    kv.put(_t(spark, d, "customer").select(F.col("c_name").cast("binary").alias("key"), F.col("c_mktsegment").cast("binary").alias("value")))
    return as_table(kv.scan(prefix=b"Customer#00000001")).select("key", "value")


@query("select cast(event_id as varchar) as key, props as value from events where epoch_ms(ts) + 86400000 * (user_id % 30) > (select epoch_ms(max(ts)) from events)")
def kv_ttl(spark, d):
    e = _t(spark, d, "events")
    ms = lambda c: F.call_function("div", D.micros_of(c), F.lit(1000))
    kv = KeyValue(Lake(spark, workspace(spark)), "kv")
    kv.put(e.select(F.col("event_id").cast("string").cast("binary").alias("key"), F.col("props").cast("binary").alias("value"), (ms(F.col("ts")) + F.lit(86_400_000) * (F.col("user_id") % 30)).alias("expires")))
    return as_table(kv.scan(now_ms=e.agg(ms(F.max("ts"))).first()[0])).select("key", "value")


# -- full text ---------------------------------------------------------------------------------------------------------

_TOKENS = "with t as (select doc_id, regexp_extract_all(lower(strip_accents(regexp_replace(coalesce(text, ''), '\\p{M}', ' ', 'g'))), '[\\p{L}\\p{N}]+') as w from documents)"


@query(f"{_TOKENS} select doc_id from t where list_contains(w, 'index') and list_contains(w, 'blocks')")
def fts_and(spark, d):
    return fts.search(_t(spark, d, "documents"), "doc_id", ["text"], "index blocks").select("doc_id")


@query(f"{_TOKENS} select doc_id from t where (list_contains(w, 'index') or list_contains(w, 'mirror')) and not list_contains(w, 'letters')")
def fts_or_not(spark, d):
    return fts.search(_t(spark, d, "documents"), "doc_id", ["text"], "(index OR mirror) NOT letters").select("doc_id")


@query(f"{_TOKENS} select doc_id from t where ' ' || array_to_string(w, ' ') || ' ' like '% the wrong order %'")
def fts_phrase(spark, d):
    return fts.search(_t(spark, d, "documents"), "doc_id", ["text"], '"the wrong order"').select("doc_id")


@query(f"{_TOKENS} select doc_id from t where len(list_filter(w, lambda x: starts_with(x, 'photo'))) > 0")
def fts_prefix(spark, d):
    return fts.search(_t(spark, d, "documents"), "doc_id", ["text"], "photo*").select("doc_id")


@query(
    f"""{_TOKENS}, c as (select doc_id, len(w) as l, len(list_filter(w, lambda x: x = 'letters')) as f from t),
    s as (select count(*) as n, avg(l) as a, count(*) filter (where f > 0) as d from c)
    select doc_id, round(-(case when ln((n - d + 0.5) / (d + 0.5)) <= 0 then 1e-6 else ln((n - d + 0.5) / (d + 0.5)) end * (f * 2.2) / (f + 1.2 * (0.25 + 0.75 * l / a))), 6) as score from c, s where f > 0"""
)
def bm25_scores(spark, d):
    return fts.search(_t(spark, d, "documents"), "doc_id", ["text"], "letters").select("doc_id", _r(F.col("score"), 6).alias("score"))


@query()
def meta_weighted(spark, d):
    m = _t(spark, d, "zx_meta").select(F.lower(F.hex("sha256")).alias("sha256"), "title", "description", "tags").distinct()
    return fts.weighted_search(m, "sha256", {"title": 3.0, "description": 1.0, "tags": 2.0}, ["index"], 50).withColumn("score", _r(F.col("score"), 6))


@query(f"{_TOKENS} select doc_id from t where list_contains(w, 'sciezka') or list_contains(w, 'glowka') or list_contains(w, 'dejente') or list_contains(w, 'lasst')")
def fts_fold(spark, d):
    """Words without their marks find those with them."""
    return fts.search(_t(spark, d, "documents"), "doc_id", ["text"], "sciezka OR ŚCIEŻKA OR dejenté OR lässt").select("doc_id")


@query(f"{_TOKENS} select doc_id from t where ' ' || array_to_string(w, ' ') || ' ' like '% the wrong order %' and list_contains(w, 'mirror')")
def fts_index(spark, d):
    """A kept index, filled in two generations, then searched."""
    index = fts.TextIndex(Lake(spark, workspace(spark)), "docs", "doc_id", ["text"])
    docs = _t(spark, d, "documents")
    index.add(docs.filter("doc_id % 2 = 0"))
    index.add(docs.filter("doc_id % 2 = 1"))
    return index.search('"the wrong order" mirror').select("doc_id")


@query("select doc_id, 'title' as \"column\", w as token, i - 1 as position from (select doc_id, unnest(x) as w, generate_subscripts(x, 1) as i from (select doc_id, regexp_extract_all(lower(strip_accents(coalesce(title, ''))), '[\\p{L}\\p{N}]+') as x from documents where coalesce(title, '') not similar to '.*[łøđßæœ].*'))")
def fts_postings(spark, d):
    plain = _t(spark, d, "documents").filter(~F.coalesce(F.col("title"), F.lit("")).rlike("[łøđßæœ]"))
    return fts.postings(plain, "doc_id", ["title"])


# -- similarity --------------------------------------------------------------------------------------------------------


def _digests(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct digest with a number for its id."""
    f = _t(spark, d, "zx_files").filter("tlsh is not null").groupBy("tlsh").agg(F.min("path").alias("path"))
    return f.select(F.pmod(F.xxhash64("tlsh"), F.lit(1 << 62)).alias("id"), "tlsh")


@query()
def tlsh_nearest(spark, d):
    """The ten nearest of all digests of every one whose id is divisible by 50."""
    from sediment.operators import tlsh

    x = _digests(spark, d)
    return tlsh.nearest_exact(x.filter("id % 50 = 0"), "id", x, "id", "tlsh", 10)


@query()
def tlsh_digest(spark, d):
    from sediment.operators import tlsh

    return _t(spark, d, "documents").select("doc_id", tlsh.digest_udf()(F.col("text")).alias("digest"))


@query("select archive, count(*) as files, count(distinct generation) as generations, cast(sum(size) as bigint) as bytes from zx_files group by 1")
def archive_summary(spark, d):
    return _t(spark, d, "zx_files").groupBy("archive").agg(F.count("*").alias("files"), F.count_distinct("generation").alias("generations"), F.sum("size").alias("bytes"))
