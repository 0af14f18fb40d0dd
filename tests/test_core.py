"""The dataset against plain lists, its edge cases, and the plans it makes."""

import gzip
import io
import json
import math
import os
import threading
import time
from collections import Counter
from datetime import date

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bagflow.functions import Fold, bottom_k, collect, const, count, distinct_set, from_fold, from_monoid, from_reduce, integer_sum, max_, mean, min_, sum_, top_k
from bagflow.operators import Dataset, Options, Progress, State, Status, TaskFailed, Throttle, fork, fork_concurrently
from bagflow.plans.context import explained, measured, observed, run
from bagflow.sources import Partition, events, external, table
from bagflow.sources.archive import dealt, producer, urls

SMALL = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
SHAPES = st.lists(st.lists(st.integers(0, 10), max_size=10), max_size=6)


def dealt_out(spark, parts, schema="v bigint"):
    """One partition for each inner list; none and empty ones occur."""
    return external(spark, [Partition.of(lambda rows=rows: ((x,) for x in rows)) for rows in parts], schema)


def flat(parts):
    return [x for part in parts for x in part]


@SMALL
@given(SHAPES)
def test_against_lists(spark, parts):
    ds, rows = dealt_out(spark, parts), flat(parts)
    assert Counter(r["v"] for r in ds.to_list()) == Counter(rows)
    assert ds.aggr(sum_("v")) == sum(rows)
    assert {r["v"]: r["value"] for r in ds.grouped_aggr("v", count(), 5).to_list()} == Counter(rows)
    assert sorted(r["v"] for r in ds.distinct(10).to_list()) == sorted(set(rows))
    assert ds.aggr(bottom_k(5, "v", "v")) == sorted(rows)[:5]
    assert ds.aggr(top_k(5, "v", "v")) == sorted(rows, reverse=True)[:5]
    assert sorted(r["item"] for r in ds.concat_map(F.array_repeat("v", F.col("v").cast("int") % 3)).to_list()) == sorted(x for x in rows for _ in range(x % 3))
    assert Counter(r["v"] for r in ds.map_python(lambda r: {"v": -r["v"]}, "v bigint").filter_python(lambda r: r["v"] < -3).to_list()) == Counter(-x for x in rows if x > 3)


BUILT_IN = [sum_("v"), count(), mean("v"), max_("v"), min_("v"), collect("v").map(F.sort_array), distinct_set("v").map(F.sort_array), const(7)]


def native_and_folded(frame, aggr):
    """The aggregate by Catalyst, and the same with a fold beside it, which makes all of it run as folds."""
    other = aggr.apply(from_monoid(lambda: 0, lambda a, b: a + b, "bigint", lambda r: F.lit(1).cast("bigint")), lambda a, b: a)
    one = {r["k"]: r["value"] for r in Dataset(frame).grouped_aggr("k", aggr).to_list()}
    two = {r["k"]: r["value"] for r in Dataset(frame).grouped_aggr("k", other).to_list()}
    all_one, all_two = Dataset(frame).aggr(aggr), Dataset(frame).aggr(other)
    return (one, all_one), (two, all_two)


def same(a, b):
    return repr(a) == repr(b)


ROWS = [("a", 1), ("a", 5), ("a", 5), ("b", None), ("b", 2), (None, 3), (None, None), ("c", None)]


@pytest.mark.parametrize("at", range(len(BUILT_IN)))
@pytest.mark.parametrize("p", [None, "v > 1", "v > 100"])
def test_catalyst_and_folds_agree(spark, at, p):
    frame = spark.createDataFrame(ROWS, "k string, v bigint").repartition(3)
    aggr = BUILT_IN[at] if p is None else BUILT_IN[at].filtered(F.expr(p))
    one, two = native_and_folded(frame, aggr)
    assert same(sorted(one[0].items(), key=repr), sorted(two[0].items(), key=repr)) and same(one[1], two[1])
    assert set(one[0]) == {"a", "b", "c", None}


def test_empty_results(spark):
    none = Dataset(spark.createDataFrame([], "k string, v double"))
    assert none.aggr(sum_("v")) == 0 and none.aggr(count()) == 0 and math.isnan(none.aggr(mean("v")))
    assert none.aggr(max_("v")) is None and none.aggr(min_("v")) is None
    assert none.aggr(collect("v")) == [] and none.aggr(distinct_set("v")) == [] and none.aggr(top_k(3, "v")) == [] and none.aggr(const(1)) == 1
    assert none.grouped_aggr("k", count()).to_list() == []
    assert none.aggr(from_reduce(max, "double", "v")) is None and none.aggr(from_monoid(lambda: True, lambda a, b: a and b, "boolean", lambda r: r["v"] > 0)) is True


def test_nulls(spark):
    ds = Dataset(spark.createDataFrame(ROWS, "k string, v bigint"))
    got = {r["k"]: r["value"] for r in ds.grouped_aggr("k", min_("v").apply(max_("v"), lambda a, b: F.array(a, b))).to_list()}
    assert got == {"a": [1, 5], "b": [None, 2], None: [None, 3], "c": [None, None]}
    got = {r["k"]: sorted(r["value"], key=repr) for r in ds.grouped_aggr("k", collect("v")).to_list()}
    assert got["b"] == [2, None] and got["c"] == [None]
    assert {r["k"]: sorted(r["value"], key=repr) for r in ds.grouped_aggr("k", distinct_set("v")).to_list()}["a"] == [1, 5]
    assert ds.aggr(top_k(2, "v", "v")) == [5, 5] and ds.aggr(bottom_k(2, "v", "v")) == [None, None]
    got = {r["k"]: r["value"] for r in ds.grouped_aggr("k", top_k(2, "v", "v").filtered(F.expr("v < 5"))).to_list()}
    assert got == {"a": [1], "b": [2], None: [3], "c": []}


def test_counts_of_groups_in_folds(spark):
    """Top-k beside other aggregates runs as folds with bounded heaps."""
    ds = Dataset(spark.createDataFrame(ROWS, "k string, v bigint").repartition(4))
    both = top_k(2, "v", "v").apply(count(), lambda a, b: F.struct(a.alias("top"), b.alias("n")))
    got = {r["k"]: (r["value"]["top"], r["value"]["n"]) for r in ds.grouped_aggr("k", both).to_list()}
    assert got == {"a": ([5, 5], 3), "b": ([2, None], 2), None: ([3, None], 2), "c": ([None], 1)}


@pytest.mark.parametrize("k", [0, -1])
def test_no_rows_wanted(spark, k):
    ds = Dataset(spark.createDataFrame(ROWS, "k string, v bigint"))
    assert ds.aggr(top_k(k, "v")) == [] and ds.top(k, F.asc("v")).to_list() == []
    assert {tuple(r["value"]) for r in ds.grouped_aggr("k", bottom_k(k, "v", "v")).to_list()} == {()}


@pytest.mark.parametrize("n", [0, -1])
def test_bad_numbers_of_partitions(spark, n):
    ds = Dataset(spark.range(3).toDF("id"))
    for f in (lambda: ds.partition(n, "id"), lambda: ds.coalesce(n), lambda: ds.distinct(n if n else -1), lambda: ds.partition(2, "id").coalesce(n)):
        with pytest.raises(ValueError):
            f()


def test_big_whole_numbers(spark):
    ds = Dataset(spark.createDataFrame([(2**62,)] * 8, "v bigint"))
    assert int(ds.aggr(integer_sum("v"))) == 2**65
    with pytest.raises(Exception, match="(?i)overflow"):
        ds.aggr(sum_("v"))


def test_combinators_in_one_pass(spark):
    ds = Dataset(spark.createDataFrame([("a", 1), ("a", 4), ("b", 2)], "k string, v bigint"))
    wide = max_("v").apply(min_("v"), lambda a, b: a - b).dimap(lambda r: F.struct((r["v"] * 10).alias("v")), lambda x: x + 1)
    assert {r["k"]: r["value"] for r in ds.grouped_aggr("k", wide).to_list()} == {"a": 31, "b": 1}
    total = from_fold(Fold(lambda: 0, lambda s, x: s + x), Fold(lambda: 0, lambda s, x: s + x), "bigint", "v").lmap(lambda r: F.struct((-r["v"]).alias("v"))).map(lambda x: x * 2)
    assert {r["k"]: r["value"] for r in ds.grouped_aggr("k", total).to_list()} == {"a": -10, "b": -4}
    assert ds.grouped_aggr([F.col("v") % 2, "k"], count()).frame.columns[1:] == ["k", "value"]


# Partitions and pipes.


def test_pipe_sees_partitions(spark):
    ten = Dataset(spark.range(0, 100, 1, 10).toDF("id"))
    one = lambda rows: [next(rows)]
    assert len(ten.pipe(one, "id bigint").to_list()) == 10
    assert len(ten.coalesce(2).pipe(one, "id bigint").to_list()) == 2
    assert ten.coalesce(20).frame.rdd.getNumPartitions() == 10 and ten.coalesce(2).coalesce(5).frame.rdd.getNumPartitions() <= 5


def test_pipe_and_empty_partitions(spark):
    calls = lambda rows: [{"n": sum(1 for _ in rows)}]
    keyed = Dataset(spark.range(3).toDF("id")).partition(8, "id").pipe(calls, "n bigint")
    assert sum(r["n"] for r in keyed.to_list()) == 3 and all(r["n"] for r in keyed.to_list())
    source = dealt_out(spark, [[1], [], [2, 3]]).pipe(calls, "n bigint")
    assert sorted(r["n"] for r in source.to_list()) == [0, 1, 2]


def test_coalesce_resets_the_number_of_a_keyed_partition(spark):
    ds = Dataset(spark.range(100).toDF("id")).partition(4, "id")
    assert ds.coalesce(8).frame.rdd.getNumPartitions() == 8 and ds.coalesce(2).frame.rdd.getNumPartitions() == 2


def test_distinct_by(spark):
    ds = Dataset(spark.createDataFrame([(1, "x", 3), (1, "y", 1), (2, "z", 2), (None, "n", 0), (None, "m", 1)], "k bigint, s string, o int"))
    assert {(r["k"], r["s"]) for r in ds.distinct_by("k", order=[F.asc("o")]).to_list()} == {(1, "y"), (2, "z"), (None, "n")}
    assert {r["k"] for r in ds.distinct_by("k").to_list()} == {1, 2, None} and ds.distinct_by(F.col("o") % 2).frame.count() == 2


def test_rows_of_every_type_pass(spark):
    rows = [(None, bytearray(b"\0\xff"), [1, None], {"a": 1.5}), (5, None, None, {"a": None})]
    ds = Dataset(spark.createDataFrame(rows, "m int, t binary, l array<int>, s struct<a: double>"))
    back = ds.pipe(lambda x: x, ds.frame.schema).to_list()
    assert Counter(map(repr, back)) == Counter(map(repr, ds.to_list()))


def test_fetch_streams(spark):
    assert sorted(r["id"] for r in Dataset(spark.range(50).toDF("id")).fetch()) == list(range(50))


# Sources.


def test_partitions_join(spark):
    assert external(spark, [], "v bigint").to_list() == []
    both = Partition.of(lambda: [(1,), (2,)]) + Partition() + Partition.of(lambda: [(3,)])
    ds = external(spark, [both, Partition(), Partition.of(lambda: [(4,)])], "v bigint")
    assert ds.frame.rdd.getNumPartitions() == 3 and ds.frame.rdd.glom().map(lambda p: [r["v"] for r in p]).collect() == [[1, 2, 3], [], [4]]


def archive(lines, hour="2020-02-29-5"):
    return lambda url: gzip.compress("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines).encode()) if url.endswith(f"/{hour}.json.gz") else None


GOOD = {"actor": {"url": "u"}, "repo": {"id": 1, "name": "r"}, "type": "PushEvent", "payload": {"commits": [{"author": {"email": "e", "name": "n"}, "message": "Cabal", "sha": "s"}]}}


def test_archive(spark):
    files = urls(date(2020, 2, 28), date(2020, 3, 1))
    assert len(files) == 72 and files[0].endswith("/2020-02-28-0.json.gz") and files[-1].endswith("/2020-03-01-23.json.gz")
    assert len(dealt(files)) == 18 and dealt(files)[2] == [files[2], files[20], files[38], files[56]]
    other = GOOD | {"type": "Other", "actor": {"id": 4, "login": "l", "url": "u"}}
    got = events(spark, date(2020, 2, 28), date(2020, 3, 1), fetch=archive([GOOD, "", other, GOOD | {"payload": {"commits": []}}])).to_list()
    assert len(got) == 3 and got[0]["payload"]["commits"][0]["distinct"] is True and got[0]["actor"]["login"] is None
    assert got[1]["payload"] is None and got[1]["actor"]["id"] == 4 and got[2]["payload"]["commits"] == []


@pytest.mark.parametrize("bad", [{**GOOD, "actor": {}}, {k: v for k, v in GOOD.items() if k != "payload"}, {k: v for k, v in GOOD.items() if k != "type"}, {**GOOD, "repo": {"name": "r"}}, "{not json"])
def test_bad_events_name_their_file(spark, bad):
    with pytest.raises(Exception, match="2020-02-29-5.json.gz"):
        events(spark, date(2020, 2, 29), date(2020, 2, 29), fetch=archive([GOOD, bad])).to_list()


def test_archive_is_read_as_a_stream():
    """Events come before the file has been read to its end."""
    class Counted(io.BytesIO):
        taken = 0

        def read(self, size=-1):
            got = super().read(size)
            Counted.taken += len(got)
            return got

    body = gzip.compress(b"".join(json.dumps(GOOD | {"noise": os.urandom(60).hex()}).encode() + b"\n" for _ in range(20000)), 1)
    events_ = producer("u", lambda url: Counted(body))()
    next(events_)
    assert Counted.taken < len(body) / 2
    assert sum(1 for _ in events_) == 19999


# Tasks, session.


def test_fork(spark):
    handle = fork(spark, lambda: 42)
    assert handle.result() == 42 and handle.poll() is Status.SUCCEEDED
    assert len(fork(spark, lambda: "x" * (1 << 22)).result()) == 1 << 22

    def broken():
        raise RuntimeError("no memory left")

    bad = fork(spark, broken)
    with pytest.raises(TaskFailed, match="no memory left"):
        bad.result()
    assert bad.poll() is Status.FAILED
    slow = fork(spark, lambda: time.sleep(1), Throttle(1))
    assert slow.poll() in (Status.WAITING, Status.SUBMITTED, Status.STARTED) and slow.result() is None


def test_fork_concurrently(spark, tmp_path):
    assert fork_concurrently(spark, [lambda i=i: i * i for i in range(20)]) == [i * i for i in range(20)]
    assert fork_concurrently(spark, []) == []

    def third_time(path=str(tmp_path / "tries")):
        with open(path, "a") as f:
            f.write("x")
        if len(open(path).read()) < 3:
            raise ValueError("not yet")
        return "done"

    assert fork_concurrently(spark, [third_time, lambda: 1]) == ["done", 1]
    (tmp_path / "tries").unlink()
    with pytest.raises(TaskFailed, match="not yet"):
        fork_concurrently(spark, [third_time], Options(retries=1))


def test_throttle_holds_for_each_task(spark, tmp_path):
    """No two tasks under way at once with a throttle of one, and more than one without."""

    def task(i, path=str(tmp_path)):
        import glob

        open(f"{path}/{i}.on", "w").close()
        time.sleep(0.2)
        seen = len(glob.glob(f"{path}/*.on"))
        os.remove(f"{path}/{i}.on")
        return seen

    tasks = [lambda i=i: task(i) for i in range(4)]
    assert fork_concurrently(spark, tasks, Options(throttle=Throttle(1))) == [1, 1, 1, 1]
    shared = Throttle(2)
    assert max(fork_concurrently(spark, tasks, Options(throttle=shared))) <= 2
    assert max(fork_concurrently(spark, tasks)) > 1


def test_progress(spark):
    told = []

    def runner(f, reporter):
        reporter.submitted("to nowhere")
        reporter.started()
        return f()

    tries = []

    def second_time():
        tries.append(1)
        if len(tries) < 2:
            raise ValueError("once more")
        return len(tries)

    assert fork_concurrently(spark, [second_time, lambda: 5], Options(progress=told.append), runner) == [2, 5]
    assert told[-1] == Progress(finished=2, retried=1) and all(x.waiting + x.submitted + x.started + x.finished == 2 for x in told)
    assert Progress(waiting=1) + -Progress(waiting=1) == Progress()


def test_states_have_texts(spark):
    gate = threading.Event()

    def runner(f, reporter):
        reporter.submitted("queue 7")
        gate.wait(20)
        return f()

    handle = fork(spark, lambda: 1, runner=runner)
    while handle.poll() is Status.WAITING:
        time.sleep(0.01)
    assert handle.state() == State(Status.SUBMITTED, "queue 7")
    gate.set()
    assert handle.result() == 1 and handle.state() == State(Status.SUCCEEDED)

    def broken(f, reporter):
        raise OSError("no room")

    bad = fork(spark, lambda: 1, runner=broken)
    with pytest.raises(TaskFailed, match="no room"):
        bad.result()
    assert bad.state().status is Status.FAILED and "no room" in bad.state().text


def test_measured(spark, tmp_path):
    frame = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    n, stats = measured(spark, lambda s: frame.groupBy("l_returnflag").count().write.parquet(str(tmp_path / "out")) or 3)
    assert n == 3 and stats.input_items == frame.count() and stats.output_items == 3
    assert min(stats.input_bytes, stats.output_bytes, stats.shuffle_write_bytes, stats.shuffle_read_bytes, stats.tasks) > 0
    assert stats.elapsed_ms > 0 and (stats + stats).tasks == 2 * stats.tasks


def test_run_and_observe(spark):
    frame, seen = observed(spark.range(7).toDF("id"))
    assert run(spark, lambda s: frame.count(), "ERROR") == 7 and seen.get["items"] == 7


# Plans.


def test_plans(spark):
    d = "/root/testdata/sf0.001"
    plan = explained(table(spark, d, "orders").filter(F.col("o_orderstatus") == "F").map("o_orderkey").frame)
    assert "EqualTo(o_orderstatus,F)" in plan and "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in plan
    plan = explained(table(spark, d, "lineitem").grouped_aggr("l_returnflag", sum_("l_quantity").apply(mean("l_tax"), lambda a, b: F.struct(a, b))).frame)
    assert "partial_sum" in plan and "Python" not in plan and "Arrow" not in plan
    plan = explained(table(spark, d, "orders").grouped_aggr("o_orderpriority", top_k(3, "o_totalprice")).frame)
    assert plan.count("WindowGroupLimit") >= 2
    assert "TakeOrderedAndProject" in explained(table(spark, d, "orders").aggr_frame(top_k(3, "o_totalprice")))
    both = top_k(3, "o_totalprice").apply(count(), lambda a, b: F.struct(a.alias("top"), b.alias("n")))
    for plan in (explained(table(spark, d, "orders").grouped_aggr("o_orderpriority", both).frame), explained(table(spark, d, "orders").aggr_frame(both))):
        assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_entry():
    import __spark_entry__ as entry
    from bagflow.plans import queries

    assert set(queries.ORACLE) <= set(queries.QUERIES) <= set(entry.queries())
