"""Registered queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import dataclasses
import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .errors import InvalidArgument, StaleData, TenantMismatch
from .functions.calendar import time
from .functions.expressions import Agg, Raw, all_of, any_of, avg, col, count, decrement, increment, max_, min_, outer, sum_
from .functions.extras import EVENTS, loaded, serialize
from .functions.full_text import full_text
from .functions.json_path import json
from .operators import writes
from .operators.audit import LOG, Audit
from .operators.query import Query
from .operators.retention import Retention
from .operators.shards import HashShard, ModShard, RangeShard, fan_out
from .operators.translation import Translations
from .operators.tree import Tree, Verbs
from .operators.writer import Writer
from .plans import schema_sync
from .schema import Model
from .sources.snapshots import Unsaved

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def models() -> list[Model]:
    region = Model("region").field("r_regionkey", "int", primary=True).field("r_name", "string").has_many("nations", "nation", "r_regionkey", "n_regionkey", order=("n_nationkey",))
    nation = Model("nation").field("n_nationkey", "int", primary=True).field("n_name", "string").field("n_regionkey", "int").belongs_to("region", "region", "n_regionkey", "r_regionkey").has_many("customers", "customer", "n_nationkey", "c_nationkey", order=("c_custkey",)).has_many("suppliers", "supplier", "n_nationkey", "s_nationkey")
    customer = Model("customer").field("c_custkey", "bigint", primary=True).field("c_name", "string").field("c_nationkey", "int").field("c_acctbal", "double", hidden=True).field("c_mktsegment", "string")
    customer.belongs_to("nation", "nation", "c_nationkey", "n_nationkey").has_many("orders", "orders", "c_custkey", "o_custkey", order=("o_orderkey",)).has_one("first_order", "orders", "c_custkey", "o_custkey", order=("o_orderdate", "o_orderkey"))
    orders = Model("orders").field("o_orderkey", "bigint", primary=True).field("o_custkey", "bigint").field("o_orderstatus", "string").field("o_totalprice", "double").field("o_orderdate", "timestamp_ntz").field("o_orderpriority", "string")
    orders.belongs_to("customer", "customer", "o_custkey", "c_custkey").has_many("lines", "lineitem", "o_orderkey", "l_orderkey", order=("l_linenumber",)).many_to_many("parts", "part", "o_orderkey", "lineitem", "l_orderkey", "l_partkey", "p_partkey", order=("p_partkey",))
    orders.dynamic_has_many("notes", "notes", "o_orderkey", "owner_id", "owner_type", "order").dynamic_many_to_many("marks", "part", "o_orderkey", "marks", "owner_id", "part_id", "p_partkey", "owner_type", "order")
    lineitem = Model("lineitem")
    for name, kind in (("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"), ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz")):
        lineitem.field(name, kind)
    lineitem.belongs_to("order", "orders", "l_orderkey", "o_orderkey").belongs_to("part", "part", "l_partkey", "p_partkey")
    part = Model("part").field("p_partkey", "bigint", primary=True).field("p_name", "string").field("p_brand", "string").field("p_type", "string").field("p_size", "int").field("p_retailprice", "double").many_to_many("orders", "orders", "p_partkey", "lineitem", "l_partkey", "l_orderkey", "o_orderkey")
    supplier = Model("supplier").field("s_suppkey", "bigint", primary=True).field("s_name", "string").field("s_nationkey", "int").field("s_acctbal", "double").belongs_to("nation", "nation", "s_nationkey", "n_nationkey")
    notes = Model("notes").field("note_id", "bigint", primary=True).field("owner_type", "string").field("owner_id", "bigint").field("body", "string").dynamic_belongs_to("owner", "owner_id", "owner_type", {"part": "part"}, "p_partkey")
    return [region, nation, customer, orders, lineitem, part, supplier, notes]


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine over a folder of test tables, with two tables made of others: notes and marks have a dynamic owner."""
    e = Engine(spark, sf_dir)
    load = e.catalog.load

    def notes() -> DataFrame:
        o = load("orders").select((F.col("o_orderkey") * 2).alias("note_id"), F.lit("order").alias("owner_type"), F.col("o_orderkey").alias("owner_id"), F.col("o_orderpriority").alias("body")).where("owner_id % 3 = 0")
        p = load("part").select((F.col("p_partkey") * 2 + 1).alias("note_id"), F.lit("part").alias("owner_type"), F.col("p_partkey").alias("owner_id"), F.col("p_brand").alias("body"))
        return o.unionByName(p)

    def marks() -> DataFrame:
        return load("lineitem").select(F.when(F.col("l_linenumber") % 2 == 0, "order").otherwise("other").alias("owner_type"), F.col("l_orderkey").alias("owner_id"), F.col("l_partkey").alias("part_id"))

    e.catalog.put("notes", notes)
    e.catalog.put("marks", marks)
    return e.register(*models())


_NOTES = "(SELECT o_orderkey * 2 AS note_id, 'order' AS owner_type, o_orderkey AS owner_id, o_orderpriority AS body FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT p_partkey * 2 + 1, 'part', p_partkey, p_brand FROM part)"


def query(sql: str | None):
    """Registers a function (engine) -> Query or DataFrame under its name, with its SQL."""

    def wrap(fn: Callable[[Engine], Query | DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = fn(engine(spark, sf_dir))
            return out.df() if isinstance(out, Query) else out

        QUERIES[fn.__name__] = run
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return wrap


def dec(name: str, alias: str, fn: str = "sum") -> Raw:
    """A sum (or other aggregate) of a double column that doesn't depend on the order of addition."""
    return Raw(f"{fn}(cast({name} as decimal(18,2)))").as_(alias)


# where


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE (l_returnflag = 'R' OR l_returnflag = 'A') AND l_quantity BETWEEN 10 AND 20 AND NOT (l_linestatus = 'O')")
def filter_groups(e):
    return e.use("lineitem").where_group(lambda g: g.where("l_returnflag", "R").or_where("l_returnflag", "A")).where(col("l_quantity").between(10, 20)).where(~col("l_linestatus").eq("O")).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000 OR o_orderpriority = '1-URGENT'")
def or_where_flat(e):
    return e.use("orders").where("o_orderstatus", "F").where("o_totalprice", ">", 200000).or_where("o_orderpriority", "1-URGENT").select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE p_name LIKE '%a%' AND p_type NOT LIKE 'S%' AND p_brand ILIKE 'brand#1%'")
def like_family(e):
    return e.use("part").where(col("p_name").like("%a%")).where(col("p_type").not_like("S%")).where(col("p_brand").ilike("brand#1%")).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE contains(p_name, '1') OR starts_with(p_type, 'PROMO') OR ends_with(p_brand, '3')")
def literal_text(e):
    return e.use("part").where(any_of(col("p_name").contains("1"), col("p_type").starts_with("PROMO"), col("p_brand").ends_with("3"))).select("p_partkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount < l_tax AND l_partkey <> l_suppkey")
def column_compare(e):
    return e.use("lineitem").where_column("l_discount", "<", "l_tax").where(col("l_partkey").ne_col("l_suppkey")).select("l_orderkey", "l_linenumber")


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2, 3)")
def in_values(e):
    return e.use("customer").where(col("c_mktsegment").in_("BUILDING", "MACHINERY")).where(col("c_nationkey").not_in(1, 2, 3)).select("c_custkey", "c_name")


@query("SELECT n_nationkey FROM nation WHERE 1 = 1")
def empty_in(e):
    return e.use("nation").where(any_of(col("n_nationkey").in_(), col("n_nationkey").not_in())).select("n_nationkey")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice NOT BETWEEN 1000 AND 300000 OR o_custkey IS NULL")
def between_and_null(e):
    return e.use("orders").where(col("o_totalprice").not_between(1000, 300000)).or_where(col("o_custkey").is_null()).select("o_orderkey")


@query("SELECT r_regionkey FROM region WHERE NULL")
def where_null_is_unknown(e):
    return e.use("region").where("r_name", None).select("r_regionkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 250000 AND o_orderpriority = '2-HIGH'")
def raw_condition(e):
    return e.table("orders").where_raw("o_totalprice > ? AND o_orderpriority = ?", 250000, "2-HIGH").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O'")
def where_when(e):
    return e.use("orders").where_when(True, lambda g: g.where("o_orderstatus", "O")).where_when(False, lambda g: g.where("o_custkey", -1)).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-03-01' AND o_orderdate < TIMESTAMP '1996-04-01'")
def time_in_month(e):
    return e.use("orders").where(time("o_orderdate").in_month(1996, 3)).select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01'")
def time_in_year(e):
    return e.use("lineitem").where(time("l_shipdate").in_year(1997)).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-12-31 16:00:00' AND o_orderdate < TIMESTAMP '1996-01-01 16:00:00'")
def time_on_date_in_zone(e):
    return e.use("orders").where(time("o_orderdate", "Asia/Shanghai").on_date(dt.date(1996, 1, 1))).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '1995-06-01' AND o_orderdate <= TIMESTAMP '1995-09-01' AND NOT (o_orderdate BETWEEN TIMESTAMP '1995-07-01' AND TIMESTAMP '1995-07-31')")
def time_bounds(e):
    t = time("o_orderdate")
    return e.use("orders").where(t.after(dt.datetime(1995, 6, 1))).where(t.until(dt.datetime(1995, 9, 1))).where(t.not_between(dt.datetime(1995, 7, 1), dt.datetime(1995, 7, 31))).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-05-05' AND o_orderdate < TIMESTAMP '1997-06-04'")
def time_last_days(e):
    return e.use("orders").where(time("o_orderdate", now=dt.datetime(1997, 6, 3, 9, tzinfo=dt.timezone.utc)).last_days(30)).select("o_orderkey")


@query("SELECT event_id FROM events WHERE json_extract(props, '$.k')::BIGINT = 87")
def json_equal(e):
    return e.table("events").where(json("props").path("k").eq(87)).select("event_id")


@query("SELECT event_id FROM events WHERE json_extract(props, '$.k')::BIGINT <> 87 AND json_extract(props, '$.k') IS NOT NULL")
def json_not_equal_exists(e):
    return e.table("events").where(json("props").path("k").ne(87)).where(json("props").path("k").exists()).select("event_id")


@query("SELECT event_id FROM events WHERE json_extract(props, '$.missing') IS NULL AND json_extract_string(props, '$.k') LIKE '1%'")
def json_null_like(e):
    return e.table("events").where(json("props").path("missing").is_null()).where(json("props").path("k").like("1%")).select("event_id")


@query("SELECT event_id FROM events WHERE json_extract(props, '$.k')::BIGINT = 42")
def json_contains(e):
    return e.table("events").where(json("props").contains({"k": 42})).select("event_id")


@query("SELECT doc_id FROM documents WHERE list_has_all(regexp_split_to_array(lower(text), '[^a-zA-Z0-9_]+'), ['licensed', 'apache'])")
def full_text_match(e):
    return e.table("documents").where(full_text("text").match("Apache licensed")).select("doc_id")


@query("""
SELECT doc_id, round(len(list_filter(t, lambda x: x = 'license'))::DOUBLE / nullif(len(t), 0), 9) AS relevance
FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-zA-Z0-9_]+'), lambda x: x <> '') AS t FROM documents) WHERE list_contains(t, 'license')
""")
def full_text_score(e):
    t = full_text("text")
    return e.table("documents").where(t.match("license")).select("doc_id", t.score("license").as_("relevance")).df().withColumn("relevance", F.round("relevance", 9))


# select, order, limit


@query("SELECT o_orderkey AS id, o_totalprice AS price, cast(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders")
def select_alias_raw(e):
    return e.use("orders").select(col("o_orderkey").as_("id"), col("o_totalprice").as_("price"), Raw("cast(round(o_totalprice * ?) as bigint)", 100).as_("cents"))


@query("SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def hidden_left_out(e):
    return e.use("customer")


@query("SELECT c_custkey, c_name, c_nationkey, c_mktsegment, c_acctbal FROM customer")
def hidden_asked_for(e):
    return e.use("customer").select_hidden("c_acctbal")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25")
def top_k(e):
    return e.use("orders").order_by_desc("o_totalprice").order_by("o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 20 OFFSET 40")
def limit_offset(e):
    return e.use("orders").order_by("o_orderdate", "o_orderkey").offset(40).limit(20).select("o_orderkey")


@query("SELECT c_custkey FROM customer ORDER BY c_custkey OFFSET 100")
def offset_only(e):
    return e.use("customer").order_by("c_custkey").offset(100).select("c_custkey")


@query("SELECT p_partkey FROM part ORDER BY length(p_name) DESC, p_partkey LIMIT 10")
def order_by_raw(e):
    return e.use("part").order_by_raw("length(p_name)", desc=True).order_by("p_partkey").limit(10).select("p_partkey")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 50")
def paginate_second_page(e):
    return e.use("orders").select("o_orderkey", "o_custkey").order_by("o_orderkey").paginate(50).page_df(2)


# joins


@query("SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")
def join_inner(e):
    return e.table("orders o").join("customer c", lambda j: j.on_column("o.o_custkey", "c.c_custkey"), "c").select("o.o_orderkey", "c.c_name")


@query("SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_orderstatus = 'P'")
def join_left_value_in_on(e):
    return e.table("customer c").left_join("orders", lambda j: j.on_column("c.c_custkey", "o.o_custkey").where(col("o.o_orderstatus").eq("P")), "o").select("c.c_custkey", "o.o_orderkey")


@query("SELECT s.s_suppkey, n.n_nationkey FROM supplier s RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey")
def join_right(e):
    return e.table("supplier s").right_join("nation", lambda j: j.on_column("s.s_nationkey", "n.n_nationkey"), "n").select("s.s_suppkey", "n.n_nationkey")


@query("SELECT c.c_custkey, s.s_suppkey FROM customer c FULL JOIN supplier s ON c.c_nationkey = s.s_nationkey")
def join_full(e):
    return e.table("customer c").full_join("supplier", lambda j: j.on_column("c.c_nationkey", "s.s_nationkey"), "s").select("c.c_custkey", "s.s_suppkey")


@query("SELECT n.n_name, r.r_name FROM nation n CROSS JOIN region r")
def join_cross(e):
    return e.table("nation n").cross_join("region", "r").select("n.n_name", "r.r_name")


@query("SELECT a.n_nationkey AS low, b.n_nationkey AS high FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_theta(e):
    return e.table("nation a").join("nation", lambda j: j.on_column("a.n_regionkey", "b.n_regionkey").on_column("a.n_nationkey", "<", "b.n_nationkey"), "b").select(col("a.n_nationkey").as_("low"), col("b.n_nationkey").as_("high"))


@query("SELECT n.n_nationkey, r.r_regionkey FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey OR (r.r_regionkey = 0 AND n.n_nationkey > 20)")
def join_or_group(e):
    return e.table("nation n").join("region", lambda j: j.on_column("n.n_regionkey", "r.r_regionkey").or_where_group(lambda g: g.where(col("r.r_regionkey").eq(0)).where(col("n.n_nationkey").gt(20))), "r").select("n.n_nationkey", "r.r_regionkey")


@query("SELECT c.c_custkey, t.total FROM customer c JOIN (SELECT o_custkey, sum(cast(o_totalprice AS DECIMAL(18,2))) AS total FROM orders GROUP BY o_custkey) t ON c.c_custkey = t.o_custkey")
def join_subquery(e):
    totals = e.table("orders").select("o_custkey", dec("o_totalprice", "total")).group_by("o_custkey")
    return e.table("customer c").join(totals, lambda j: j.on_column("c.c_custkey", "t.o_custkey"), "t").select("c.c_custkey", "t.total")


@query("SELECT n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey AND r.r_name <> 'ASIA'")
def join_raw(e):
    return e.table("nation n").join_raw("inner", "region", "n.n_regionkey = r.r_regionkey AND r.r_name <> ?", "ASIA", alias="r").select("n.n_name", "r.r_name")


# subqueries


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def where_in_subquery(e):
    return e.use("customer").where_in("c_custkey", e.use("orders").where("o_totalprice", ">", 300000).select("o_custkey")).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT (c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'))")
def where_not_in_subquery(e):
    return e.use("customer").where(~col("c_custkey").in_(e.use("orders").where("o_orderstatus", "F").select("o_custkey"))).select("c_custkey")


@query("SELECT c.c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 250000)")
def where_exists(e):
    inner = e.table("orders o").where(col("o.o_totalprice").gt(250000)).df().where(F.col("o.o_custkey") == outer("c.c_custkey"))
    return e.table("customer c").where_exists(inner).select("c.c_custkey")


@query("SELECT c.c_custkey FROM customer c WHERE c.c_mktsegment = 'BUILDING' OR NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
def or_not_exists(e):
    inner = e.table("orders o").df().where(F.col("o.o_custkey") == outer("c.c_custkey"))
    from .functions.expressions import exists

    return e.table("customer c").where(col("c.c_mktsegment").eq("BUILDING")).or_where(~exists(inner)).select("c.c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders) * 1")
def scalar_subquery_where(e):
    return e.use("orders").where("o_totalprice", ">", e.use("orders").select(avg("o_totalprice"))).select("o_orderkey")


@query("SELECT c_custkey, (SELECT count(*) FROM orders) AS all_orders FROM customer")
def scalar_subquery_select(e):
    return e.use("customer").select("c_custkey", (e.use("orders").select(count()), "all_orders"))


@query("SELECT t.o_orderstatus, t.n FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus) t WHERE t.n > 10")
def from_subquery(e):
    inner = e.use("orders").select("o_orderstatus", count().as_("n")).group_by("o_orderstatus")
    return e.from_(inner, "t").where(col("t.n").gt(10)).select("t.o_orderstatus", "t.n")


@query("SELECT r.r_name, count(*) AS n FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE n.n_nationkey > 3 GROUP BY r.r_name")
def raw_sql(e):
    return e.views("nation", "region").raw("SELECT r.r_name, count(*) AS n FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE n.n_nationkey > ? GROUP BY r.r_name", 3).df()


# aggregates


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, sum(cast(o_totalprice AS DECIMAL(18,2))) AS total, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY o_orderstatus, o_orderpriority")
def group_aggregates(e):
    return e.use("orders").select("o_orderstatus", "o_orderpriority", count().as_("n"), dec("o_totalprice", "total"), min_("o_totalprice").as_("low"), max_("o_totalprice").as_("high")).group_by("o_orderstatus", "o_orderpriority")


@query("SELECT l_returnflag, l_linestatus, sum(cast(l_quantity AS DECIMAL(18,2))) AS sum_qty, sum(cast(l_extendedprice AS DECIMAL(18,2))) AS sum_base, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus")
def pricing_summary(e):
    return e.use("lineitem").where(time("l_shipdate").until(dt.datetime(1998, 9, 2))).select("l_returnflag", "l_linestatus", dec("l_quantity", "sum_qty"), dec("l_extendedprice", "sum_base"), count().as_("n")).group_by("l_returnflag", "l_linestatus")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def having_count(e):
    return e.use("orders").select("o_custkey", count().as_("n")).group_by("o_custkey").having(count(), ">", 12)


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 9 AND max(o_totalprice) > 2 * avg(o_totalprice)")
def having_raw(e):
    return e.use("orders").select("o_custkey", count().as_("n")).group_by("o_custkey").having_raw("count(*) > ? AND max(o_totalprice) > 2 * avg(o_totalprice)", 9)


@query("SELECT l_suppkey FROM lineitem GROUP BY l_suppkey HAVING min(l_discount) < max(l_tax)")
def having_column(e):
    return e.use("lineitem").select("l_suppkey").group_by("l_suppkey").having_column(min_("l_discount"), "<", max_("l_tax"))


@query("SELECT o_custkey, max(o_totalprice) AS high FROM orders GROUP BY o_custkey HAVING max(o_totalprice) > (SELECT avg(o_totalprice) FROM orders) AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def having_subqueries(e):
    return e.use("orders").select("o_custkey", max_("o_totalprice").as_("high")).group_by("o_custkey").having(max_("o_totalprice"), ">", e.use("orders").select(avg("o_totalprice"))).having_in("o_custkey", e.use("customer").where("c_mktsegment", "BUILDING").select("c_custkey"))


@query("SELECT count(*) AS groups FROM (SELECT o_custkey FROM orders GROUP BY o_custkey)")
def grouped_count(e):
    return e.from_(e.use("orders").select("o_custkey").group_by("o_custkey"), "g").select(count().as_("groups"))


@query("SELECT count(*) AS n, count(o_custkey) AS with_customer, sum(cast(o_totalprice AS DECIMAL(18,2))) AS total, cast(round(avg(o_totalprice), 4) AS DECIMAL(18,4)) AS mean FROM orders")
def ungrouped_aggregates(e):
    return e.use("orders").select(count().as_("n"), count("o_custkey").as_("with_customer"), dec("o_totalprice", "total"), Raw("cast(round(avg(o_totalprice), 4) as decimal(18,4))").as_("mean"))


# relations


@query("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'F')")
def has_many_filter(e):
    return e.use("customer").where_has("orders", lambda q: q.where("o_orderstatus", "F")).select("c_custkey")


@query("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
def doesnt_have(e):
    return e.use("customer").where_doesnt_have("orders").select("c_custkey")


@query("SELECT c_custkey FROM customer c WHERE (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) >= 12")
def has_count_at_least(e):
    return e.use("customer").where_has("orders", op=">=", n=12).select("c_custkey")


@query("SELECT c_custkey FROM customer c WHERE (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'P') = 0")
def has_count_zero(e):
    return e.use("customer").where_has("orders", lambda q: q.where("o_orderstatus", "P"), "=", 0).select("c_custkey")


@query("SELECT c_custkey FROM customer c WHERE c_mktsegment = 'BUILDING' OR EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_totalprice > 300000)")
def or_where_has(e):
    return e.use("customer").where("c_mktsegment", "BUILDING").or_where_has("orders", lambda q: q.where("o_totalprice", ">", 300000)).select("c_custkey")


@query("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_quantity > 49))")
def nested_has(e):
    return e.use("customer").where_has("orders", lambda q: q.where_has("lines", lambda p: p.where("l_quantity", ">", 49))).select("c_custkey")


@query("SELECT o_orderkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_mktsegment = 'MACHINERY'")
def belongs_to_filter(e):
    return e.use("orders").where_has("customer", lambda q: q.where("c_mktsegment", "MACHINERY")).select("o_orderkey")


@query("SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey WHERE l.l_orderkey = o.o_orderkey AND p.p_size = 7)")
def many_to_many_filter(e):
    return e.use("orders").where_has("parts", lambda q: q.where("p_size", 7)).select("o_orderkey")


@query(f"SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM {_NOTES} n WHERE n.owner_type = 'order' AND n.owner_id = o.o_orderkey AND n.body LIKE '1%')")
def dynamic_has_many_filter(e):
    return e.use("orders").where_has("notes", lambda q: q.where(col("body").like("1%"))).select("o_orderkey")


@query("SELECT o_orderkey, (SELECT count(*) FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey WHERE l.l_orderkey = o.o_orderkey AND l.l_linenumber % 2 = 0) AS marks_count FROM orders o")
def dynamic_many_to_many_count(e):
    return e.use("orders").with_count("marks").select("o_orderkey")


@query("SELECT c_custkey, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS orders_count, EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey) AS orders_exists, (SELECT min(o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey) AS orders_o_totalprice_min, (SELECT max(o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey) AS orders_o_totalprice_max FROM customer c")
def with_aggregates(e):
    return e.use("customer").with_count("orders").with_exists("orders").with_min("orders", "o_totalprice").with_max("orders", "o_totalprice").select("c_custkey")


@query("SELECT c_custkey, round((SELECT sum(o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'F'), 2) AS total, round((SELECT avg(o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'F'), 6) AS mean FROM customer c")
def with_filtered_sum_avg(e):
    final = lambda q: q.where("o_orderstatus", "F")
    df = e.use("customer").with_sum("orders", "o_totalprice", final, "total").with_avg("orders", "o_totalprice", final, "mean").select("c_custkey").df()
    return df.withColumns({"total": F.round("total", 2), "mean": F.round("mean", 6)})


@query("SELECT p_partkey, (SELECT count(*) FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE l.l_partkey = p.p_partkey) AS orders_count FROM part p")
def many_to_many_count(e):
    return e.use("part").with_count("orders").select("p_partkey")


@query("SELECT r.r_regionkey, n.n_nationkey, n.n_name, (row_number() OVER (PARTITION BY r.r_regionkey ORDER BY n.n_nationkey) - 1)::INTEGER AS pos FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey")
def eager_has_many(e):
    df = e.use("region").with_("nations").df()
    return df.select("r_regionkey", F.posexplode("nations").alias("pos", "n")).select("r_regionkey", "n.n_nationkey", "n.n_name", "pos")


@query("SELECT c_custkey, o_orderkey FROM (SELECT c.c_custkey, o.o_orderkey, row_number() OVER (PARTITION BY c.c_custkey ORDER BY o.o_orderdate, o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey) WHERE n = 1")
def eager_has_one(e):
    return e.use("customer").with_("first_order").df().select("c_custkey", F.col("first_order.o_orderkey").alias("o_orderkey"))


@query("SELECT n.n_nationkey, r.r_name FROM nation n LEFT JOIN region r ON n.n_regionkey = r.r_regionkey")
def eager_belongs_to(e):
    return e.use("nation").with_("region").df().select("n_nationkey", F.col("region.r_name").alias("r_name"))


@query("SELECT c_custkey, o_orderkey FROM (SELECT c.c_custkey, o.o_orderkey, row_number() OVER (PARTITION BY c.c_custkey ORDER BY o.o_totalprice DESC, o.o_orderkey) AS n FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey) WHERE n <= 2")
def eager_limit_per_parent(e):
    df = e.use("customer").with_("orders", lambda q: q.order_by_desc("o_totalprice").order_by("o_orderkey"), limit=2).df()
    return df.select("c_custkey", F.explode("orders.o_orderkey").alias("o_orderkey"))


@query("SELECT r.r_regionkey, n.n_nationkey, s.s_suppkey FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey JOIN supplier s ON s.s_nationkey = n.n_nationkey")
def eager_nested(e):
    df = e.use("region").with_("nations.suppliers").df()
    return df.select("r_regionkey", F.explode("nations").alias("n")).select("r_regionkey", "n.n_nationkey", F.explode("n.suppliers.s_suppkey").alias("s_suppkey"))


@query("SELECT o.o_orderkey, p.p_partkey FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN part p ON p.p_partkey = l.l_partkey")
def eager_many_to_many(e):
    return e.use("orders").with_("parts").df().select("o_orderkey", F.explode("parts.p_partkey").alias("p_partkey"))


@query(f"SELECT n.note_id, p.p_brand FROM {_NOTES} n LEFT JOIN part p ON n.owner_type = 'part' AND n.owner_id = p.p_partkey")
def eager_dynamic_belongs_to(e):
    return e.use("notes").with_("owner").df().select("note_id", F.get_json_object("owner", "$.p_brand").alias("p_brand"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey = 7")
def for_instance(e):
    return e.use("orders").for_(e.registry.models["customer"], "orders", {"c_custkey": 7}).select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_orderkey = 3)")
def for_instance_linked(e):
    return e.use("part").for_(e.registry.models["orders"], "parts", {"o_orderkey": 3}).select("p_partkey")


@query("""
SELECT c_custkey, c_name, c_mktsegment, n AS orders_count, t AS total FROM (
  SELECT c.c_custkey, c.c_name, c.c_mktsegment, count(*) AS n, sum(cast(o_totalprice AS DECIMAL(18,2))) AS t, count(*) FILTER (WHERE o_orderstatus = 'F') AS f
  FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY ALL) WHERE f >= 3 ORDER BY t DESC NULLS LAST, c_custkey LIMIT 10
""")
def flagship(e):
    priced = lambda q: q.select("o_custkey", Raw("cast(o_totalprice as decimal(18,2))").as_("o_totalprice"))
    return e.use("customer").where_has("orders", lambda q: q.where("o_orderstatus", "F"), ">=", 3).with_count("orders", priced).with_sum("orders", "o_totalprice", priced, "total").order_by_raw("total", desc=True).order_by("c_custkey").limit(10).select("c_custkey", "c_name", "c_mktsegment")


# scopes and shards


def _orders_with_marks(e: Engine) -> Engine:
    """Orders with a tenant and a deletion mark, made of other columns."""
    made = e.catalog.load("orders").withColumn("tenant_id", F.col("o_custkey") % 4).withColumn("deleted_at", F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")))
    e.catalog.put("tenant_orders", made)
    e.register(Model("tenant_orders").field("o_orderkey", "bigint", primary=True).field("o_custkey", "bigint").field("o_totalprice", "double").field("tenant_id", "bigint").field("deleted_at", "timestamp_ntz", soft_delete=True).by_tenant("tenant_id"))
    return e


@query("SELECT o_orderkey FROM orders WHERE o_custkey % 4 = 2 AND o_orderstatus <> 'F' AND (o_totalprice < 50000 OR o_totalprice > 300000)")
def tenant_and_deletion_scopes(e):
    q = _orders_with_marks(e).tenant(tenant_id=2).use("tenant_orders")
    return q.where("o_totalprice", "<", 50000).or_where("o_totalprice", ">", 300000).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey % 4 = 1 AND o_orderstatus = 'F'")
def only_deleted(e):
    return _orders_with_marks(e).tenant(tenant_id=1).use("tenant_orders").only_deleted().select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey % 4 = 3")
def with_deleted(e):
    return _orders_with_marks(e).tenant(tenant_id=3).use("tenant_orders").with_deleted().select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 100000")
def named_scopes(e):
    is_open = lambda q: q.where("o_orderstatus", "O")
    return e.use("orders").scope(is_open).scope_when(True, lambda q: q.where("o_totalprice", ">", 100000)).scope_when(False, lambda q: q.limit(0)).select("o_orderkey")


@query("SELECT o_orderkey, (o_custkey % 3)::INTEGER AS shard FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15 OFFSET 5")
def shard_mod_fan_out(e):
    s = ModShard("o_custkey", 3)
    orders = e.catalog.load("orders")
    shards = [s.only(orders, k).withColumn("shard", F.lit(k)) for k in range(3)]
    return e.from_(fan_out(shards), "o").order_by_desc("o_totalprice").order_by("o_orderkey").offset(5).limit(15).select("o_orderkey", "shard")


@query("SELECT o_orderkey FROM orders WHERE o_custkey BETWEEN 51 AND 100")
def shard_range(e):
    return RangeShard("o_custkey", ((1, 50), (51, 100), (101, 1 << 40))).only(e.catalog.load("orders"), 77).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey % 5 = 2")
def shard_of_model(e):
    e.registry.models["orders"].sharded(ModShard("o_custkey", 5))
    return e.use("orders").shard(12).select("o_orderkey")


@query("""
WITH RECURSIVE b AS (SELECT o_orderkey, o_custkey::VARCHAR AS s, 0 AS i, 14695981039346656037::HUGEINT AS h FROM orders
  UNION ALL SELECT o_orderkey, s, i + 1, (xor(h, ascii(s[i + 1])::HUGEINT) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT FROM b WHERE i < length(s))
SELECT o_orderkey, (h % 7)::INTEGER AS shard FROM b WHERE i = length(s)
""")
def shard_hash(e):
    return e.catalog.load("orders").select("o_orderkey", HashShard("o_custkey", 7).key().cast("int").alias("shard"))


# writes


@query("SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_nationkey = 3 THEN s_acctbal + 100 ELSE s_acctbal END AS s_acctbal FROM supplier")
def write_update_increment(e):
    t = e.catalog.load("supplier")
    return writes.update(t, col("s_nationkey").eq(3), {"s_acctbal": increment(100)}, e.registry.models["supplier"]).table


@query("SELECT * FROM customer WHERE NOT (c_mktsegment = 'BUILDING' AND c_acctbal < 0)")
def write_delete(e):
    return writes.delete(e.catalog.load("customer"), all_of(col("c_mktsegment").eq("BUILDING"), col("c_acctbal").lt(0)), e.registry.models["customer"]).table


@query("SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN upper(n_name) || '!' ELSE n_name END AS n_name, n_regionkey FROM nation UNION ALL SELECT 100, 'ATLANTIS', 4")
def write_upsert_columns(e):
    t = e.catalog.load("nation")
    new = t.where("n_nationkey < 5").withColumn("n_name", F.concat(F.upper("n_name"), F.lit("!"))).withColumn("n_regionkey", F.lit(9)).unionByName(e.spark.sql("select 100 as n_nationkey, 'ATLANTIS' as n_name, 4 as n_regionkey"))
    return writes.upsert(t, new, writes.Conflict("n_nationkey").update("n_name")).table


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT 7, 'NEW'")
def write_upsert_nothing(e):
    t = e.catalog.load("region")
    return writes.upsert(t, e.spark.sql("select 0 as r_regionkey, 'CHANGED' as r_name union all select 7, 'NEW'"), writes.Conflict("r_regionkey").do_nothing()).table


@query("SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_suppkey <= 3 THEN s_acctbal - 1 ELSE s_acctbal END AS s_acctbal FROM supplier")
def write_upsert_map(e):
    t = e.catalog.load("supplier")
    return writes.upsert(t, t.where("s_suppkey <= 3"), writes.Conflict("s_suppkey").update_map({"s_acctbal": decrement(1)})).table


@query("SELECT o_orderkey, o_orderstatus = 'F' OR o_custkey = 10 AS gone FROM orders")
def write_soft_delete(e):
    _orders_with_marks(e)
    t = e.catalog.load("tenant_orders")
    return writes.delete(t, col("o_custkey").eq(10), e.registry.models["tenant_orders"]).table.select("o_orderkey", F.col("deleted_at").isNotNull().alias("gone"))


@query("SELECT o_orderkey, o_orderstatus = 'F' AND o_custkey >= 100 AS gone FROM orders")
def write_restore(e):
    _orders_with_marks(e)
    t = e.catalog.load("tenant_orders")
    return writes.restore(t, col("o_custkey").lt(100), e.registry.models["tenant_orders"]).table.select("o_orderkey", F.col("deleted_at").isNotNull().alias("gone"))


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT 5, 'NORTH' UNION ALL SELECT 6, 'SOUTH'")
def write_insert(e):
    rows = e.spark.sql("select 'NORTH' as r_name union all select 'SOUTH'")
    out = writes.insert(e.catalog.load("region"), rows.orderBy("r_name"), e.registry.models["region"]).table
    return out.withColumn("r_regionkey", F.col("r_regionkey").cast("int"))


# trees, retention, translations


def _tree(e: Engine) -> Tree:
    """Regions as roots, nations as their children, in the order of their keys."""
    nodes = e.catalog.load("region").select(F.col("r_regionkey").alias("id"), F.lit(None).cast("int").alias("parent_id"), F.col("r_name").alias("name")).unionByName(e.catalog.load("nation").select((F.col("n_nationkey") + 100).alias("id"), F.col("n_regionkey").alias("parent_id"), F.col("n_name").alias("name")))
    empty = nodes.withColumns({c: F.lit(0) for c in ("lft", "rgt", "depth")})
    return Tree(Tree(empty).rebuild(order="id"))


_TREE = """
t AS (SELECT r_regionkey AS id, NULL::INTEGER AS parent_id, r_name AS name FROM region UNION ALL SELECT n_nationkey + 100, n_regionkey, n_name FROM nation),
o AS (SELECT *, coalesce(parent_id, id) AS root, CASE WHEN parent_id IS NULL THEN 0 ELSE 1 END AS depth FROM t),
n AS (SELECT *, row_number() OVER (ORDER BY root, depth, id) AS n, CASE WHEN depth = 0 THEN count(*) OVER (PARTITION BY root) ELSE 1 END AS size FROM o),
tree AS (SELECT id, parent_id, name, (2 * n - 1 - depth)::INTEGER AS lft, (2 * n - 1 - depth + 2 * size - 1)::INTEGER AS rgt, depth FROM n)
"""


@query(f"WITH {_TREE} SELECT * FROM tree")
def tree_rebuild(e):
    return _tree(e).table


@query(f"WITH {_TREE} SELECT id, name, depth - 0 AS relative_depth FROM tree WHERE lft > (SELECT lft FROM tree WHERE id = 2) AND rgt < (SELECT rgt FROM tree WHERE id = 2)")
def tree_descendants(e):
    return _tree(e).descendants_with_depth(2).select("id", "name", "relative_depth")


@query(f"WITH {_TREE} SELECT a.id AS ancestor_id, d.id AS descendant_id, d.depth - a.depth AS distance FROM tree a JOIN tree d ON d.lft > a.lft AND d.rgt < a.rgt")
def tree_ancestor_pairs(e):
    return _tree(e).ancestor_pairs()


@query(f"WITH {_TREE} SELECT id FROM tree WHERE parent_id IS NULL OR rgt - lft = 1")
def tree_roots_and_leaves(e):
    t = _tree(e)
    return t.roots().select("id").union(t.leaves().select("id")).distinct()


@query("SELECT 0::BIGINT AS faults")
def tree_check_after_moves(e):
    t = _tree(e)
    moved = Tree(Tree(t.move(1, parent=3)).insert({"id": 500, "name": "NEW"}, parent=101))
    return e.spark.createDataFrame([(sum(Tree(moved.remove(2)).check().values()),)], "faults long")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id DESC) AS n FROM events) WHERE n <= 300")
def retention_keep_last(e):
    return Retention(keep_last=300, key="event_id", time="ts").kept(e.catalog.load("events")).select("event_id")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n <= 2")
def retention_per_user(e):
    return Retention(keep_last=2, key="event_id", time="ts", scope=("user_id",)).kept(e.catalog.load("events")).select("event_id")


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 5 DAY")
def retention_keep_for(e):
    t = e.catalog.load("events")
    return Retention(keep_for=dt.timedelta(days=5), key="event_id", time="ts", now=t.agg(F.max("ts")).first()[0]).kept(t).select("event_id")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'zh-' || n_name WHEN n_nationkey % 3 = 0 THEN 'en-' || n_name ELSE n_name END AS n_name FROM nation")
def translation_overlay(e):
    text = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit('{"zh-CN":{"n_name":"zh-'), "n_name", F.lit('"}}'))).when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit('{"en-US":{"n_name":"en-'), "n_name", F.lit('"}}')))
    t = e.catalog.load("nation").withColumn("translations", text)
    return Translations(("n_name",), fallback="en-US").overlay(t, "zh-CN").select("n_nationkey", "n_name")


@query("""
WITH RECURSIVE t AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 130 <> 0 AND c_custkey > 1 THEN c_custkey - 1 END AS parent_id FROM customer),
d AS (SELECT id, id AS root, 0 AS depth FROM t WHERE parent_id IS NULL UNION ALL SELECT t.id, d.root, d.depth + 1 FROM d JOIN t ON t.parent_id = d.id),
n AS (SELECT *, row_number() OVER (ORDER BY root, depth) AS n, count(*) OVER (PARTITION BY root) - depth AS size FROM d)
SELECT id, (2 * n - 1 - depth)::INTEGER AS lft, (2 * n - 1 - depth + 2 * size - 1)::INTEGER AS rgt, depth::INTEGER AS depth FROM n
""")
def tree_rebuild_deep(e):
    """Chains of 130 levels."""
    nodes = e.catalog.load("customer").select(F.col("c_custkey").alias("id"), F.when((F.col("c_custkey") % 130 != 0) & (F.col("c_custkey") > 1), F.col("c_custkey") - 1).alias("parent_id"))
    return Tree(nodes.withColumns({c: F.lit(0) for c in ("lft", "rgt", "depth")})).rebuild(order="id").select("id", "lft", "rgt", "depth")


_VERBS = Verbs()


@query(f"WITH {_TREE} SELECT id FROM tree WHERE depth = 1 AND lft > (SELECT lft FROM tree WHERE id = 3) AND rgt < (SELECT rgt FROM tree WHERE id = 3) ORDER BY lft DESC LIMIT 3")
def tree_verbs_descendants(e):
    t = _tree(e)
    return e.from_(t.table, "t").scope(_VERBS.descendants_of(t._node(3), at=1), _VERBS.reversed()).limit(3).select("id")


@query(f"WITH {_TREE} SELECT id FROM tree WHERE (id IN (1, 107) OR parent_id = 1 AND id <> 107 OR depth = 0) AND lft <= (SELECT rgt FROM tree WHERE id = 1)")
def tree_verbs_mixed(e):
    t = _tree(e)
    q, node = e.from_(t.table, "t").where(col("lft").lte(t._node(1)["rgt"])), t._node(107)
    parts = [q.scope(v).select("id").df() for v in (_VERBS.ancestors_of(node, itself=True), _VERBS.siblings_of({**node, "parent_id": 1}), _VERBS.roots())]
    return parts[0].union(parts[1]).union(parts[2]).distinct()


@query(f"WITH {_TREE} SELECT id, depth, (SELECT count(*) FROM tree c WHERE c.parent_id = t.id) AS children FROM tree t")
def tree_nested(e):
    out = []

    def walk(nodes, depth):
        for n in nodes:
            out.append((n["id"], depth, len(n["children"])))
            walk(n["children"], depth + 1)

    walk(_tree(e).nested(), 0)
    return e.spark.createDataFrame(out, "id int, depth int, children long")


@query(f"WITH {_TREE} SELECT d.id, d.lft > a.lft AND d.rgt < a.rgt AS below, d.rgt - d.lft = 1 AS leaf FROM tree d, tree a WHERE a.id = 2 AND d.id IN (102, 108, 112)")
def tree_predicates(e):
    t = _tree(e)
    leaf = {r["id"]: r["leaf"] for r in t.table.where(F.col("id").isin(102, 108, 112)).select("id", t.is_leaf().alias("leaf")).collect()}
    return e.spark.createDataFrame([(k, t.is_descendant(k, 2), leaf[k]) for k in leaf], "id int, below boolean, leaf boolean")


# terminals, sources, plugins


@query("SELECT count(*) AS n FROM orders WHERE o_custkey < 50")
def raw_exec(e):
    return e.spark.createDataFrame([(e.views("orders").raw("SELECT o_orderkey FROM orders WHERE o_custkey < ?", 50).exec(),)], "n long")


@dataclasses.dataclass
class NationName:
    n_nationkey: int
    n_name: str


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def typed_mapping(e):
    made = e.use("nation").where("n_regionkey", 2).select("n_nationkey", "n_name").map_to(NationName)
    return e.spark.createDataFrame([dataclasses.astuple(x) for x in made], "n_nationkey int, n_name string")


@query("SELECT n_nationkey FROM nation WHERE n_regionkey = 1")
def named_connection(e):
    e.catalog.connections["archive"] = e.catalog.connections["default"]
    return e.connection("archive").use("nation").where("n_regionkey", 1).select("n_nationkey")


@query("SELECT c_custkey FROM customer WHERE c_nationkey = 4")
def table_prefix(e):
    """A prefix is put before a logical name: cust and omer."""
    return Engine(e.spark, e.catalog.connections["default"].path, prefix="cust").table("omer").where("c_nationkey", 4).select("c_custkey")


@query("SELECT p_partkey, p_brand || '/' || p_size AS label FROM part WHERE p_size < 5")
def virtual_field(e):
    m = Model("part").field("p_partkey", "bigint", primary=True).field("p_brand", "string").field("p_size", "int").field("label", "string", virtual=True)
    return e.register(m).use("part").where("p_size", "<", 5).select("p_partkey", Raw("concat(p_brand, '/', p_size)").as_("label"))


@query("SELECT r_regionkey, r_regionkey < 3 AS there FROM region")
def terminal_exists(e):
    found = [(k, e.use("nation").where("n_regionkey", k).where("n_regionkey", "<", 3).exists()) for k in range(5)]
    return e.spark.createDataFrame(found, "r_regionkey int, there boolean")


@query("(SELECT 'first' AS how, o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) UNION ALL (SELECT 'find', 7)")
def terminal_first_find(e):
    q = e.use("orders")
    return e.spark.createDataFrame([("first", q.order_by_desc("o_totalprice").order_by("o_orderkey").first()["o_orderkey"]), ("find", q.find(7)["o_orderkey"])], "how string, o_orderkey long")


@query("SELECT s_suppkey, ((row_number() OVER (ORDER BY s_suppkey) - 1) // 7)::INTEGER AS page FROM supplier")
def terminal_chunk(e):
    out = []
    e.use("supplier").select("s_suppkey").order_by("s_suppkey").chunk(7, lambda rows: out.append([r["s_suppkey"] for r in rows]))
    return e.spark.createDataFrame([(k, i) for i, page in enumerate(out) for k in page], "s_suppkey long, page int")


@query("SELECT (row_number() OVER (ORDER BY n_name) - 1)::INTEGER AS at, n_name FROM nation")
def terminal_stream_each(e):
    q, each = e.use("nation").select("n_name").order_by("n_name"), []
    q.each(lambda r: each.append(r["n_name"]), 10)
    streamed = [r["n_name"] for r in q.stream()]
    return e.spark.createDataFrame([(i, n) for i, n in enumerate(streamed) if each[i] == n], "at int, n_name string")


@query("SELECT r_regionkey, count(n_nationkey) AS n FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey")
def access_loaded(e):
    rows = e.use("region").with_("nations").get()
    return e.spark.createDataFrame([(r["r_regionkey"], len(loaded(r, "nations"))) for r in rows], "r_regionkey int, n long")


@query(f"SELECT o.o_orderkey, n.note_id FROM orders o JOIN {_NOTES} n ON n.owner_type = 'order' AND n.owner_id = o.o_orderkey")
def eager_dynamic_has_many(e):
    return e.use("orders").with_("notes").df().select("o_orderkey", F.explode("notes.note_id").alias("note_id"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3")
def plugin_and_extension(e):
    class Segment:
        def on_query(self, q):
            return q.where("c_mktsegment", "BUILDING")

    class OneNation:
        def on_query(self, engine, q):
            return q.where("c_nationkey", 3) if q.name == "customer" else q

    return e.with_extension("one_nation", OneNation()).use("customer").apply(Segment()).select("c_custkey", "c_name")


@query("SELECT * FROM (VALUES ('before_sql', 1::BIGINT), ('after_sql', 1), ('after_find', 2), ('after_cache_hit', 1), ('after_cache_miss', 1)) AS x(event, n)")
def events_and_cache(e):
    seen = []
    for name in EVENTS:
        e.events.on(name, lambda p, name=name: seen.append((name,)))
    q = e.use("region").cache(60)
    q.get()
    q.get()
    return e.spark.createDataFrame(seen, "event string").groupBy("event").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey <= 5")
def serializer(e):
    rows = e.use("customer").select_hidden("c_acctbal").where("c_custkey", "<=", 5).get()
    out = serialize(rows, e.registry.models["customer"], omit=("c_nationkey", "c_mktsegment"))
    return e.spark.createDataFrame([(r["c_custkey"], r["c_name"]) for r in out if "c_acctbal" not in r], "c_custkey long, c_name string")


@query("SELECT * FROM (VALUES ('add_column', 'n_note'), ('unsafe', 'n_old'), ('unsafe', 'n_regionkey')) AS x(kind, \"column\")")
def schema_diff(e):
    want = Model("nation").field("n_nationkey", "int", primary=True).field("n_name", "string").field("n_regionkey", "bigint").field("n_note", "bool")
    have = e.catalog.load("nation").withColumn("n_old", F.lit(1))
    return e.spark.createDataFrame([(c.kind, c.column) for c in schema_sync.diff(want, have.schema)], "kind string, column string")


@query("SELECT n_nationkey, n_name, n_regionkey, 'none' AS n_note FROM nation")
def schema_applied(e):
    m, t = Model("nation").field("n_nationkey", "int", primary=True).field("n_name", "string").field("n_regionkey", "int").field("n_note", "string", default="none"), e.catalog.load("nation")
    return schema_sync.apply(e.spark, m, t, schema_sync.diff(m, t.schema))


# writes through a store


def _writer(e: Engine, *tables: str, audit: Audit | None = None) -> Writer:
    store = Unsaved(**{t: e.catalog.load(t) for t in tables})
    return Writer(e, store, audit, lambda: dt.datetime(2026, 1, 1)).share(*tables)


@query("SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region UNION ALL SELECT 5, 'NORTH' UNION ALL SELECT 9, 'SOUTH' UNION ALL SELECT 12, NULL")
def write_create_many(e):
    """Rows with different keys; a missing key follows the largest one by the row's place."""
    w = _writer(e, "region")
    w.create("region", [{"r_name": "NORTH"}], batch_size=2)
    w.create("region", [{"r_regionkey": 9, "r_name": "SOUTH"}, {"r_name": "gone", "r_regionkey": 10}], batch_size=1)
    w.delete(e.use("region").where("r_name", "gone"))
    w.create("region", [{"r_regionkey": 12, "r_name": "left out"}], omit=("r_name",))
    return w.store.read("region").select(F.col("r_regionkey").cast("long").alias("r_regionkey"), "r_name")


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer UNION ALL SELECT (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY c_custkey), c_name, c_mktsegment FROM customer")
def write_create_bulk(e):
    """A DataFrame of new rows: keys are numbered over partitions in the rows' order, none comes to the driver."""
    t = e.catalog.load("customer")
    made = writes.insert(t, t.withColumnRenamed("c_custkey", "o").coalesce(1).sortWithinPartitions("o").drop("o"), e.registry.models["customer"])
    return made.table.select("c_custkey", "c_name", "c_mktsegment")


@query("SELECT s_suppkey, CASE WHEN s_suppkey <= 4 THEN 'X' ELSE s_name END AS s_name, CASE WHEN s_suppkey <= 4 THEN 9 ELSE s_nationkey END AS s_nationkey FROM supplier UNION ALL SELECT 1000000, 'NEW', 1")
def write_upsert_all(e):
    w, t = _writer(e, "supplier"), e.catalog.load("supplier")
    new = t.where("s_suppkey <= 4").select("s_suppkey", F.lit("X").alias("s_name"), F.lit(9).alias("s_nationkey")).unionByName(e.spark.sql("select 1000000L as s_suppkey, 'NEW' as s_name, 1 as s_nationkey"))
    w.upsert("supplier", new, writes.Conflict("s_suppkey").update_all())
    return w.store.read("supplier").select("s_suppkey", "s_name", "s_nationkey")


@query("SELECT o_orderkey, CASE WHEN o_orderkey = 1 THEN 2 ELSE 1 END AS version, CASE WHEN o_orderkey = 1 THEN 'Z' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def write_optimistic_lock(e):
    """The second writer's version has passed: its change is refused."""
    m = Model("versioned").field("o_orderkey", "bigint", primary=True).field("o_orderstatus", "string").field("version", "int", optimistic=True)
    e.catalog.put("versioned", e.catalog.load("orders").select("o_orderkey", "o_orderstatus", F.lit(1).alias("version")))
    w = _writer(e.register(m), "versioned")
    one = e.use("versioned").where("o_orderkey", 1)
    w.update(one, {"o_orderstatus": "Z"}, check_version=1)
    try:
        w.update(one, {"o_orderstatus": "Y"}, check_version=1)
    except StaleData:
        pass
    return w.store.read("versioned")


@query("SELECT n_nationkey, CASE WHEN n_nationkey = 1 THEN 4 WHEN n_nationkey = 2 THEN NULL WHEN n_nationkey IN (5, 6) THEN 0 WHEN n_nationkey = 10 THEN 1 ELSE n_regionkey END AS n_regionkey FROM nation WHERE n_nationkey NOT IN (8)")
def write_relation_set_add_remove(e):
    w, models_ = _writer(e, "nation", "region"), e.registry.models
    nation, region = models_["nation"], models_["region"]
    row = lambda k: {"n_nationkey": k}
    w.set(nation, row(1), "region", {"r_regionkey": 4})
    w.unset(nation, row(2), "region")
    w.add(region, {"r_regionkey": 0}, "nations", row(5), row(6))
    w.add(region, {"r_regionkey": 1}, "nations", row(10))
    w.remove(region, {"r_regionkey": 4}, "nations", row(3))  # is in another region: stays
    w.force_delete(e.use("nation").where("n_nationkey", 8))
    return w.store.read("nation").select("n_nationkey", "n_regionkey")


def _links(e: Engine) -> Writer:
    """Parts of orders by the marks table, a few orders of it."""
    e.catalog.put("marks", e.catalog.load("marks").where("owner_type = 'order' and owner_id < 40").distinct())
    return _writer(e, "marks")


_MARKS = "marks AS (SELECT DISTINCT 'order' AS owner_type, l_orderkey AS owner_id, l_partkey AS part_id FROM lineitem WHERE l_linenumber % 2 = 0 AND l_orderkey < 40)"


@query(f"WITH {_MARKS} SELECT * FROM marks WHERE owner_id <> 2 UNION ALL SELECT 'order', 1, -5 UNION ALL SELECT 'order', 1, -6 UNION ALL SELECT 'order', 2, -7")
def write_attach_sync(e):
    w, orders = _links(e), e.registry.models["orders"]
    part = lambda k: {"p_partkey": k}
    w.attach(orders, {"o_orderkey": 1}, "marks", part(-5), part(-6))
    w.sync(orders, {"o_orderkey": 2}, "marks", [part(-7)])
    return w.store.read("marks").select("owner_type", "owner_id", F.col("part_id").cast("long").alias("part_id"))


@query(f"WITH {_MARKS} SELECT owner_type, owner_id, CASE WHEN owner_id = 5 THEN -1 ELSE part_id END AS part_id FROM marks WHERE owner_id NOT IN (3, 7)")
def write_detach_clear_through(e):
    w, orders = _links(e), e.registry.models["orders"]
    at = lambda k: {"o_orderkey": k}
    ids = lambda k: [{"p_partkey": r[0]} for r in w.store.read("marks").where(F.col("owner_id") == k).select("part_id").collect()]
    w.clear(orders, at(3), "marks")
    if ids(7):
        w.detach(orders, at(7), "marks", *ids(7))
    for p in ids(5):
        w.update_through(orders, at(5), "marks", p, {"part_id": -1})
    return w.store.read("marks").select("owner_type", "owner_id", F.col("part_id").cast("long").alias("part_id"))


@query("SELECT r_regionkey, CASE WHEN r_regionkey = 0 THEN 'outer' ELSE r_name END AS r_name FROM region")
def write_savepoint(e):
    """A failed inner transaction is undone alone."""
    w = _writer(e, "region")
    with e.transaction(w.store):
        w.update(e.use("region").where("r_regionkey", 0), {"r_name": "outer"})
        try:
            with w.store.transaction():
                w.update(e.use("region").where("r_regionkey", 1), {"r_name": "inner"})
                raise InvalidArgument("undone")
        except InvalidArgument:
            pass
    return w.store.read("region")


@query("SELECT o_orderkey, CASE WHEN o_custkey % 4 = 1 AND o_orderkey < 100 THEN 1.5 ELSE o_totalprice END AS o_totalprice FROM orders UNION ALL SELECT 90000001, 2.5")
def write_tenant_upsert(e):
    """Only the tenant's own rows are met; another tenant's key is refused."""
    t = _orders_with_marks(e).tenant(tenant_id=1)
    w, old = _writer(t, "tenant_orders"), t.catalog.load("tenant_orders")
    conflict = writes.Conflict("o_orderkey").update("o_totalprice")
    mine = old.where("tenant_id = 1 and o_orderkey < 100").select("o_orderkey", F.lit(1.5).alias("o_totalprice"))
    w.upsert("tenant_orders", mine.unionByName(e.spark.sql("select 90000001L as o_orderkey, 2.5D as o_totalprice")), conflict)
    try:
        w.upsert("tenant_orders", old.where("tenant_id = 2").select("o_orderkey", F.lit(0.0).alias("o_totalprice")), conflict)
    except TenantMismatch:
        pass
    return w.store.read("tenant_orders").select("o_orderkey", "o_totalprice")


@query("SELECT * FROM (VALUES ('create', '900', '{\"n_nationkey\":900,\"n_name\":\"NEW\",\"updated_by\":7}'), ('update', '1', '{\"n_nationkey\":1,\"n_name\":\"ONE\",\"updated_by\":7}'), ('delete', '2', NULL)) AS x(operation, key, \"values\")")
def write_audit_log(e):
    """Every changed row is noted with its visible values, the writer is stamped on it."""
    m = Model("audited").field("n_nationkey", "int", primary=True).field("n_name", "string").field("n_regionkey", "int", hidden=True).field("updated_by", "int")
    e.catalog.put("audited", e.catalog.load("nation").select("n_nationkey", "n_name", "n_regionkey", F.lit(None).cast("int").alias("updated_by")))
    e.catalog.put("log", e.spark.createDataFrame([], LOG))
    w = _writer(e.register(m), "audited", "log", audit=Audit(7, "log"))
    w.create("audited", {"n_nationkey": 900, "n_name": "NEW"})
    w.update(e.use("audited").where("n_nationkey", 1), {"n_name": "ONE"})
    w.delete(e.use("audited").where("n_nationkey", 2))
    return w.store.read("log").select("operation", "key", F.when(F.col("operation") != "delete", F.col("values")).alias("values"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey < 3 THEN lower(n_name) || '+' ELSE n_name END AS n_name FROM nation UNION ALL SELECT 800, 'plugged+'")
def write_hooks_and_plugins(e):
    class Plus:
        def on_write(self, context):
            if context.stage == "values" and context.mode in ("insert", "update"):
                for r in context.values if isinstance(context.values, list) else [context.values]:
                    if isinstance(r.get("n_name"), str):
                        r["n_name"] += "+"
                    elif "n_name" in r:
                        r["n_name"] = Raw("concat(lower(n_name), '+')")

    e.registry.models["nation"].on("before_create", lambda r: {**r, "n_name": r["n_name"].lower()})
    w = _writer(e, "nation")
    w.create("nation", {"n_nationkey": 800, "n_name": "PLUGGED", "n_regionkey": 1}, plugins=(Plus(),))
    w.update(e.use("nation").apply(Plus()).where("n_nationkey", "<", 3), {"n_name": None})
    return w.store.read("nation").select("n_nationkey", "n_name")


@query("SELECT o_orderkey, o_custkey FROM orders UNION ALL SELECT o_orderkey + 10000000, o_custkey FROM orders WHERE o_custkey % 5 = 2")
def write_shard_guard(e):
    """Bulk rows of the chosen shard are written; a row of another one is an error."""
    e.registry.models["orders"].sharded(ModShard("o_custkey", 5))
    w, t = _writer(e, "orders"), e.catalog.load("orders").withColumn("o_orderkey", F.col("o_orderkey") + 10000000)
    w.create("orders", t.where("o_custkey % 5 = 2"), shard=12)
    return w.store.read("orders").select("o_orderkey", "o_custkey")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["flagship"](spark, sf_dir)


__all__ = ["QUERIES", "SQL", "Agg", "engine", "entry", "models", "sum_"]
