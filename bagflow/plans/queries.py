"""Queries over the test tables, one or more for each operator, and the same in DuckDB's SQL."""

from __future__ import annotations

import gzip
import json
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bagflow.functions import Fold, bottom_k, collect, const, count, distinct_set, from_fold, from_monoid, from_reduce, integer_sum, max_, mean, min_, sum_, top_k
from bagflow.operators import Dataset, Options, Throttle, fork_concurrently
from bagflow.plans.context import run
from bagflow.sources import Partition, events, external, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _lines(spark: SparkSession, d: str) -> Dataset:
    return table(spark, d, "documents").concat_map(F.split("text", "\n"), "line", keep=["doc_id", "source"])


@query(
    "select source, count(*) as n_lines from (select source, unnest(string_split(text, chr(10))) as line from documents) where contains(lower(line), 'and') group by 1 order by 2 desc, 1 limit 5"
)
def flagship_topk_lines(spark: SparkSession, d: str) -> DataFrame:
    """The five sources with most lines that say a word."""
    said = _lines(spark, d).filter(F.lower("line").contains("and"))
    return said.grouped_aggr("source", count(), name="n_lines").top(5, F.desc("n_lines"), F.asc("source")).frame


# Row transforms.


@query("select n_nationkey as id, n_name as name from nation")
def map_project(spark, d):
    return table(spark, d, "nation").map(id=F.col("n_nationkey"), name=F.col("n_name")).frame


@query("select l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) as net from lineitem")
def map_arith(spark, d):
    return table(spark, d, "lineitem").map("l_orderkey", "l_linenumber", net=F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4)).frame


@query("select n_nationkey as id, upper(n_name) as name from nation")
def map_python_rows(spark, d):
    return table(spark, d, "nation").map_python(lambda r: {"id": r["n_nationkey"], "name": r["n_name"].upper()}, "id int, name string").frame


@query("select o_orderkey, o_custkey from orders where o_orderstatus = 'F'")
def filter_eq(spark, d):
    return table(spark, d, "orders").filter(F.col("o_orderstatus") == "F").map("o_orderkey", "o_custkey").frame


@query("select doc_id from documents where contains(lower(text), 'the')")
def filter_contains(spark, d):
    return table(spark, d, "documents").filter(F.lower("text").contains("the")).map("doc_id").frame


@query("select n_nationkey, n_name, n_regionkey from nation where n_nationkey % 2 = 0")
def filter_python_rows(spark, d):
    return table(spark, d, "nation").filter_python(lambda r: r["n_nationkey"] % 2 == 0).frame


@query("select doc_id, count(*) as n from (select doc_id, unnest(string_split(text, chr(10))) as line from documents) group by 1")
def concat_map_lines(spark, d):
    return _lines(spark, d).grouped_aggr("doc_id", count(), name="n").frame


@query("select doc_id, unnest(list_filter(string_split(text, ' '), lambda x: strlen(x) > 20)) as word from documents")
def concat_map_empty(spark, d):
    """Most documents give no row."""
    return table(spark, d, "documents").concat_map(F.filter(F.split("text", " "), lambda w: F.octet_length(w) > 20), "word", keep=["doc_id"]).frame


@query("select c_custkey as id, unnest(range(0, c_custkey % 3)) as i from customer")
def concat_map_python_rows(spark, d):
    return table(spark, d, "customer").map("c_custkey").concat_map_python(lambda r: ({"id": r["c_custkey"], "i": i} for i in range(r["c_custkey"] % 3)), "id bigint, i bigint").frame


@query("select event_id, value * 2 as doubled from events")
def pipe_per_partition(spark, d):
    return table(spark, d, "events").map("event_id", "value").pipe(lambda rows: ({"event_id": r["event_id"], "doubled": r["value"] * 2} for r in rows), "event_id bigint, doubled double").frame


@query("select distinct user_id, event_type from events")
def pipe_running_dedupe(spark, d):
    """A pipe with state: after partition() by user, what was seen before is dropped."""

    def fresh(rows):
        seen = set()
        for r in rows:
            if (key := (r["user_id"], r["event_type"])) not in seen:
                seen.add(key)
                yield r

    return table(spark, d, "events").map("user_id", "event_type").partition(8, "user_id").pipe(fresh, "user_id bigint, event_type string").frame


# Partitioning and distinct.


@query("select cast(0 as bigint) as split_users")
def partition_colocation(spark, d):
    """Users whose events are in more than one of the partitions they were dealt to."""
    placed = table(spark, d, "events").partition(8, "user_id").map("user_id", part=F.spark_partition_id())
    return placed.grouped_aggr("user_id", distinct_set("part").map(F.size), name="parts").filter("parts > 1").aggr_frame(count(), "split_users")


@query("select count(*) as n from orders")
def coalesce_rows(spark, d):
    return table(spark, d, "orders").coalesce(2).aggr_frame(count(), "n")


@query("select 2 as parts, count(*) as n from orders")
def coalesce_before_pipe(spark, d):
    """pipe is called once for each of the partitions that coalesce leaves."""
    parts = table(spark, d, "orders").partition(8, "o_custkey").coalesce(2).pipe(lambda rows: ({"n": sum(1 for _ in rows)},), "n bigint")
    return parts.frame.agg(F.count(F.lit(1)).cast("int").alias("parts"), F.sum("n").alias("n"))


@query("select distinct user_id, event_type from events")
def distinct_rows(spark, d):
    return table(spark, d, "events").map("user_id", "event_type").distinct(10).frame


@query("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts, event_id) as nth from events) where nth = 1")
def distinct_by_first(spark, d):
    return table(spark, d, "events").distinct_by("user_id", order=[F.asc("ts"), F.asc("event_id")]).map("user_id", "event_id", "event_type").frame


@query("select distinct event_type from events")
def distinct_by_keys(spark, d):
    return table(spark, d, "events").distinct_by("event_type").map("event_type").frame


# Aggregates of all rows.


@query("select cast(sum(l_linenumber) as bigint) as total from lineitem")
def agg_sum(spark, d):
    return table(spark, d, "lineitem").aggr_frame(sum_("l_linenumber"), "total")


@query("select cast(coalesce(sum(o_orderkey), 0) as bigint) as total from orders where o_orderkey < 0")
def agg_sum_empty(spark, d):
    return table(spark, d, "orders").filter("o_orderkey < 0").aggr_frame(sum_("o_orderkey"), "total")


@query("select cast(sum(o_orderkey) as varchar) as total from orders")
def agg_integer_sum(spark, d):
    return table(spark, d, "orders").aggr_frame(integer_sum("o_orderkey").map(lambda x: x.cast("string")), "total")


@query("select count(*) as n from lineitem")
def agg_count(spark, d):
    return table(spark, d, "lineitem").aggr_frame(count(), "n")


@query("select round(avg(l_quantity), 6) as mean from lineitem")
def agg_mean(spark, d):
    return table(spark, d, "lineitem").aggr_frame(mean("l_quantity").map(lambda x: F.round(x, 6)), "mean")


@query("select cast('nan' as double) as mean")
def agg_mean_empty(spark, d):
    return table(spark, d, "orders").filter("o_orderkey < 0").aggr_frame(mean("o_totalprice"), "mean")


@query("select max(o_totalprice) as most from orders where o_orderkey < 0")
def agg_max_empty(spark, d):
    return table(spark, d, "orders").filter("o_orderkey < 0").aggr_frame(max_("o_totalprice"), "most")


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey desc limit 20")
def agg_topk(spark, d):
    top = table(spark, d, "orders").aggr_frame(top_k(20, lambda r: F.struct(r["o_totalprice"], r["o_orderkey"])), "rows")
    return Dataset(top).concat_map(F.col("rows"), "r").map(o_orderkey=F.col("r.o_orderkey"), o_totalprice=F.col("r.o_totalprice")).frame


@query("select o_orderkey, o_totalprice from orders order by o_totalprice, o_orderkey limit 20")
def agg_bottomk(spark, d):
    low = table(spark, d, "orders").aggr_frame(bottom_k(20, lambda r: F.struct(r["o_totalprice"], r["o_orderkey"])), "rows")
    return Dataset(low).concat_map(F.col("rows"), "r").map(o_orderkey=F.col("r.o_orderkey"), o_totalprice=F.col("r.o_totalprice")).frame


# Aggregates of groups.


@query("select l_returnflag, l_linestatus, count(*) as n from lineitem group by 1, 2")
def grp_count(spark, d):
    return table(spark, d, "lineitem").grouped_aggr(["l_returnflag", "l_linestatus"], count(), name="n").frame


@query("select l_returnflag, round(sum(l_extendedprice), 2) as total from lineitem group by 1")
def grp_sum(spark, d):
    return table(spark, d, "lineitem").grouped_aggr("l_returnflag", sum_("l_extendedprice").map(lambda x: F.round(x, 2)), name="total").frame


@query("select l_returnflag, round(avg(l_quantity), 4) as mean from lineitem group by 1")
def grp_mean(spark, d):
    return table(spark, d, "lineitem").grouped_aggr("l_returnflag", mean("l_quantity").map(lambda x: F.round(x, 4)), name="mean").frame


@query("select o_orderpriority, max(o_totalprice) as most from orders group by 1")
def grp_max(spark, d):
    return table(spark, d, "orders").grouped_aggr("o_orderpriority", max_("o_totalprice"), name="most").frame


@query("select o_orderpriority, min(o_totalprice) as least from orders group by 1")
def grp_min(spark, d):
    return table(spark, d, "orders").grouped_aggr("o_orderpriority", min_("o_totalprice"), name="least").frame


@query("select c_mktsegment, list(c_nationkey order by c_nationkey) as keys from customer group by 1")
def grp_collect_sorted(spark, d):
    return table(spark, d, "customer").grouped_aggr("c_mktsegment", collect("c_nationkey").map(F.sort_array), name="keys").frame


@query("select c_mktsegment, list_sort(list(distinct c_nationkey)) as keys from customer group by 1")
def grp_distinct_set(spark, d):
    return table(spark, d, "customer").grouped_aggr("c_mktsegment", distinct_set("c_nationkey").map(F.sort_array), name="keys").frame


@query("select event_type, cast(count(distinct user_id) as int) as users from events group by 1")
def grp_distinct_count(spark, d):
    return table(spark, d, "events").grouped_aggr("event_type", distinct_set("user_id").map(F.size), name="users").frame


def _ranked_orders(spark, d, aggr):
    rows = table(spark, d, "orders").grouped_aggr("o_orderpriority", aggr, name="rows")
    return rows.concat_map(F.col("rows"), "r", keep=["o_orderpriority"]).map("o_orderpriority", o_orderkey=F.col("r.o_orderkey"), o_totalprice=F.col("r.o_totalprice")).frame


@query("select o_orderpriority, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey desc) as nth from orders) where nth <= 3")
def grp_topk(spark, d):
    return _ranked_orders(spark, d, top_k(3, lambda r: F.struct(r["o_totalprice"], r["o_orderkey"])))


@query("select o_orderpriority, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_orderpriority order by o_totalprice, o_orderkey) as nth from orders) where nth <= 3")
def grp_bottomk(spark, d):
    return _ranked_orders(spark, d, bottom_k(3, lambda r: F.struct(r["o_totalprice"], r["o_orderkey"])))


@query("select o_orderpriority, count(*) filter (where o_totalprice > 400000) as n, count(*) filter (where o_totalprice < 0) as none from orders group by 1")
def grp_filtered_count(spark, d):
    both = count().filtered(lambda r: r["o_totalprice"] > 400000).apply(count().filtered(lambda r: r["o_totalprice"] < 0), lambda a, b: F.struct(a.alias("n"), b.alias("none")))
    return table(spark, d, "orders").grouped_aggr("o_orderpriority", both).map("o_orderpriority", "value.n", "value.none").frame


@query("select o_orderpriority, round(coalesce(sum(o_totalprice) filter (where o_orderstatus = 'F'), 0), 2) as total, coalesce(sum(o_totalprice) filter (where o_orderstatus = 'X'), 0) as none from orders group by 1")
def grp_filtered_sum(spark, d):
    total = sum_("o_totalprice")
    both = total.filtered(lambda r: r["o_orderstatus"] == "F").apply(total.filtered(lambda r: r["o_orderstatus"] == "X"), lambda a, b: F.struct(F.round(a, 2).alias("total"), b.alias("none")))
    return table(spark, d, "orders").grouped_aggr("o_orderpriority", both).map("o_orderpriority", "value.total", "value.none").frame


@query("select o_orderpriority, round(avg(o_totalprice) filter (where o_orderstatus = 'F'), 4) as mean, cast('nan' as double) as none from orders group by 1")
def grp_filtered_mean(spark, d):
    price = mean("o_totalprice")
    both = price.filtered(lambda r: r["o_orderstatus"] == "F").apply(price.filtered(lambda r: r["o_orderstatus"] == "X"), lambda a, b: F.struct(F.round(a, 4).alias("mean"), b.alias("none")))
    return table(spark, d, "orders").grouped_aggr("o_orderpriority", both).map("o_orderpriority", "value.mean", "value.none").frame


@query("select event_type, 42 as answer from events group by 1")
def grp_const(spark, d):
    return table(spark, d, "events").grouped_aggr("event_type", const(42), name="answer").frame


# Folds of one's own.


@query("select event_type, round(avg(value), 6) as mean from events group by 1")
def fold_two_phase(spark, d):
    partial = Fold(lambda: (0.0, 0), lambda s, x: (s[0] + x, s[1] + 1))
    final = Fold(lambda: (0.0, 0), lambda s, x: (s[0] + x[0], s[1] + x[1]), lambda s: s[0] / s[1])
    return table(spark, d, "events").grouped_aggr("event_type", from_fold(partial, final, "double", "value").map(lambda x: F.round(x, 6)), name="mean").frame


@query("select event_type, bool_and(value > 0) as positive from events group by 1")
def fold_monoid_all(spark, d):
    return table(spark, d, "events").grouped_aggr("event_type", from_monoid(lambda: True, lambda a, b: a and b, "boolean", lambda r: r["value"] > 0), name="positive").frame


@query("select event_type, max(value) as most from events group by 1")
def fold_reduce(spark, d):
    return table(spark, d, "events").grouped_aggr("event_type", from_reduce(max, "double", "value"), name="most").frame


@query("select event_type, count(*) as n, max(value) as most, max(value) as again from events group by 1")
def fold_with_builtins(spark, d):
    """Built-in aggregates and one of one's own in one pass."""
    both = count().apply(max_("value"), lambda a, b: F.struct(a.alias("n"), b.alias("most"))).apply(from_reduce(max, "double", "value"), lambda a, b: F.struct(a.alias("a"), b.alias("again")))
    return table(spark, d, "events").grouped_aggr("event_type", both).map("event_type", "value.a.n", "value.a.most", "value.again").frame


# Combinators.


@query("select l_returnflag, cast(2 * sum(l_linenumber) as bigint) as total from lineitem group by 1")
def aggr_map(spark, d):
    return table(spark, d, "lineitem").grouped_aggr("l_returnflag", sum_("l_linenumber").map(lambda x: x * 2), name="total").frame


@query("select l_returnflag, cast(sum(-l_linenumber) as bigint) as total from lineitem group by 1")
def aggr_lmap(spark, d):
    return table(spark, d, "lineitem").grouped_aggr("l_returnflag", sum_().lmap(lambda r: -r["l_linenumber"]), name="total").frame


@query("select l_returnflag, cast(2 * sum(-l_linenumber) as bigint) as total from lineitem group by 1")
def aggr_dimap(spark, d):
    return table(spark, d, "lineitem").grouped_aggr("l_returnflag", sum_().dimap(lambda r: -r["l_linenumber"], lambda x: x * 2), name="total").frame


@query("select o_orderpriority, round(max(o_totalprice) - min(o_totalprice), 2) as width from orders group by 1")
def aggr_apply_range(spark, d):
    return table(spark, d, "orders").grouped_aggr("o_orderpriority", max_("o_totalprice").apply(min_("o_totalprice"), lambda a, b: F.round(a - b, 2)), name="width").frame


@query(
    "select o_orderpriority, n, o_orderkey from (select o_orderpriority, o_orderkey, count(*) over (partition by o_orderpriority) as n, row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) as nth from orders) where nth <= 3"
)
def aggr_apply_topk_and_count(spark, d):
    """Top-k beside a count: ranks and a partial aggregate, which meet by the group."""
    both = top_k(3, lambda r: F.struct(r["o_totalprice"], -r["o_orderkey"]), "o_orderkey").apply(count(), lambda a, b: F.struct(a.alias("top"), b.alias("n")))
    rows = table(spark, d, "orders").grouped_aggr("o_orderpriority", both)
    return rows.concat_map(F.col("value.top"), "o_orderkey", keep=["o_orderpriority", "value"]).map("o_orderpriority", "o_orderkey", "value.n").frame


# Actions and tasks.


@query("select n_nationkey, n_name from nation where n_regionkey = 1")
def fetch_rows(spark, d):
    """Rows as a stream on the driver, and a frame of them again."""
    rows = table(spark, d, "nation").filter("n_regionkey = 1").map("n_nationkey", "n_name").fetch()
    return spark.createDataFrame([tuple(r) for r in rows], "n_nationkey int, n_name string")


@query("select r_regionkey, r_name from region")
def to_list_rows(spark, d):
    return spark.createDataFrame([tuple(r) for r in run(spark, lambda s: table(s, d, "region").map("r_regionkey", "r_name").to_list(), "ERROR")], "r_regionkey int, r_name string")


@query("select v, v * v as square from range(0, 12) t(v)")
def fork_squares(spark, d):
    """Single tasks on executors, at most four at once, results in order."""
    squares = fork_concurrently(spark, [lambda i=i: i * i for i in range(12)], Options(progress=False, throttle=Throttle(4)))
    return spark.createDataFrame(list(enumerate(squares)), "v bigint, square bigint")


# Sources.


@query("select p * 10 + i as v from range(0, 4) a(p), range(0, 10) b(i)")
def src_external(spark, d):
    def made(p: int) -> Partition:
        return Partition.of(lambda: ((p * 10 + i,) for i in range(10)))

    return external(spark, [made(p) for p in range(4)], "v bigint").frame


@query("select v from range(0, 10) a(v) union all select v from range(0, 5) b(v)")
def src_combined(spark, d):
    both = Partition() + Partition.of(lambda: ((i,) for i in range(10))) + Partition.of(lambda: ((i,) for i in range(5)))
    return external(spark, [both, Partition()], "v bigint").frame


def _sample_archive(url: str) -> bytes | None:
    """Two hours of a day; the others have no file."""
    actor, repo = {"id": 1, "login": "ann", "url": "u"}, {"id": 7, "name": "r"}
    commit = {"author": {"email": "e", "name": "n"}, "message": "Cabal file", "sha": "s1"}
    hours = {
        "2019-01-01-0.json.gz": [
            {"actor": actor, "repo": repo, "type": "PushEvent", "payload": {"commits": [commit, commit | {"sha": "s2", "distinct": False}]}},
            {"actor": actor, "repo": repo, "type": "PushEvent", "payload": {"commits": []}},
        ],
        "2019-01-01-13.json.gz": [
            {"actor": {"url": "u"}, "repo": repo, "type": "WatchEvent", "payload": {}},
            {"actor": {"url": "u"}, "repo": repo, "type": "PushEvent", "payload": {"commits": [commit | {"sha": "s3", "message": "other"}]}},
        ],
    }
    rows = hours.get(url.rpartition("/")[2])
    return None if rows is None else gzip.compress("\n".join(map(json.dumps, rows)).encode())


@query("select * from (values ('ann', 'Cabal file', 's1', true), ('ann', 'Cabal file', 's2', false), (null, 'other', 's3', true)) t(login, message, sha, fresh)")
def src_archive(spark, d):
    found = events(spark, date(2019, 1, 1), date(2019, 1, 1), fetch=_sample_archive).concat_map(F.col("payload.commits"), "c", keep=["actor"])
    return found.map(F.col("actor.login").alias("login"), F.col("c.message").alias("message"), F.col("c.sha").alias("sha"), F.col("c.distinct").alias("fresh")).frame
