"""A lazy partitioned multiset over a DataFrame.

Functions given as columns stay in Catalyst: filters reach the scan, columns are pruned, aggregates are partial before the
shuffle. Python functions are the way out for what has no expression; they run over Arrow batches and hide what they do, so they
belong at the end of a chain. The order of rows is never promised."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from bagflow.functions.aggregates import Aggr, Leaf
from bagflow.functions.fold import final_phase, partial_phase

ROWS = 1000


def _positive(n: int) -> int:
    if n < 1:
        raise ValueError(f"the number of partitions must be 1 or more, not {n}")
    return n


def _columns(columns: tuple, named: dict[str, Column]) -> list:
    return [*columns, *(c.alias(name) for name, c in named.items())]


def _schema(frame: DataFrame, schema: StructType | str) -> StructType:
    return schema if isinstance(schema, StructType) else frame.sparkSession.createDataFrame([], schema).schema


@dataclass(frozen=True)
class Dataset:
    """frame, and where it comes from straight from partition(): its parent and keys, which coalesce() and pipe() look at."""

    frame: DataFrame
    keyed: tuple[DataFrame, tuple] | None = None

    # Row transforms.

    def map(self, *columns: Column | str, **named: Column) -> Dataset:
        """A row of expressions for every row."""
        return Dataset(self.frame.select(*_columns(columns, named)))

    def filter(self, condition: Column | str) -> Dataset:
        """The rows for which the condition is true; null is not."""
        return Dataset(self.frame.where(condition))

    def concat_map(self, items: Column, name: str = "item", keep: Iterable[str] = ()) -> Dataset:
        """A row for every element of an array; none for an empty or null one. keep names columns to have beside it."""
        return Dataset(self.frame.select(*keep, F.explode(items).alias(name)))

    def map_python(self, f: Callable[[dict], dict], schema: StructType | str) -> Dataset:
        return self.concat_map_python(lambda row: (f(row),), schema)

    def filter_python(self, p: Callable[[dict], bool]) -> Dataset:
        return self.concat_map_python(lambda row: (row,) if p(row) else (), self.frame.schema)

    def concat_map_python(self, f: Callable[[dict], Iterable[dict]], schema: StructType | str) -> Dataset:
        return self.pipe(lambda rows: (out for row in rows for out in f(row)), schema)

    def pipe(self, f: Callable[[Iterator[dict]], Iterable[dict]], schema: StructType | str) -> Dataset:
        """f over the rows of each partition, which it may keep state across, drop, multiply, or stop reading early.

        It is called once for each partition, also for an empty one, except straight after partition(): there, partitions to
        which no key was dealt don't exist. Coalesce before to have f see merged partitions. A task that is tried again calls f
        again, so effects of its own may repeat."""
        schema = _schema(self.frame, schema)
        arrow = pa.schema([(x.name, to_arrow_type(x.dataType)) for x in schema])
        skip_empty = self.keyed is not None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = (row for batch in batches for row in batch.to_pylist())
            if skip_empty:
                first = next(rows, None)
                if first is None:
                    return
                rows = _chained(first, rows)
            held: list[dict] = []
            for row in f(rows):
                held.append(row)
                if len(held) == ROWS:
                    yield pa.RecordBatch.from_pylist(held, schema=arrow)
                    held = []
            yield pa.RecordBatch.from_pylist(held, schema=arrow)

        return Dataset(self.frame.mapInArrow(run, schema))

    def pipe_arrow(self, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> Dataset:
        """As pipe, over Arrow batches."""
        return Dataset(self.frame.mapInArrow(f, schema))

    # Partitioning.

    def partition(self, n: int, *keys: Column | str) -> Dataset:
        """n partitions; rows with equal keys are in one."""
        return Dataset(self.frame.repartition(_positive(n), *keys), (self.frame, keys))

    def coalesce(self, n: int) -> Dataset:
        """At most n partitions, without moving rows. Straight after partition() it sets the number of that, upward too."""
        if self.keyed:
            parent, keys = self.keyed
            return Dataset(parent.repartition(_positive(n), *keys), self.keyed)
        return Dataset(self.frame.coalesce(_positive(n)))

    # Distinct.

    def distinct(self, n: int | None = None) -> Dataset:
        """Each row once. n is a wish for the number of partitions; Spark sets it by the size of the data."""
        _positive(n or 1)
        return Dataset(self.frame.distinct())

    def distinct_by(self, *keys: Column | str, n: int | None = None, order: Iterable[Column] = ()) -> Dataset:
        """One whole row for each key: the first in the order, or with none any."""
        _positive(n or 1)
        names = [f"__key_{i}" for i in range(len(keys))]
        frame = self.frame.withColumns({name: F.col(k) if isinstance(k, str) else k for name, k in zip(names, keys, strict=True)})
        if order:
            frame = frame.withColumn("__nth", F.row_number().over(Window.partitionBy(*names).orderBy(*order))).where("__nth = 1").drop("__nth")
        else:
            frame = frame.dropDuplicates(names)
        return Dataset(frame.drop(*names))

    # Aggregates.

    def grouped_aggr(self, key: Column | str | list, aggr: Aggr, n: int | None = None, name: str = "value") -> Dataset:
        """Key columns and the aggregate of each group. n is a wish, as in distinct()."""
        _positive(n or 1)
        keys = {f"k{i}" if isinstance(k, Column) and not _name(self.frame, k) else _name(self.frame, k): F.col(k) if isinstance(k, str) else k for i, k in enumerate(key if isinstance(key, list) else [key])}
        return Dataset(_aggregated(self.frame, keys, aggr, name))

    def aggr(self, aggr: Aggr):
        """The aggregate of all rows, as a Python value; of no rows its empty result."""
        return self.aggr_frame(aggr).first()[0]

    def aggr_frame(self, aggr: Aggr, name: str = "value") -> DataFrame:
        """The same as a frame of one row."""
        return _aggregated(self.frame, {}, aggr, name)

    def top(self, k: int, *order: Column) -> Dataset:
        """The first k rows in the order; none for k under 1. Ordered and cut in each task before the last."""
        return Dataset(self.frame.orderBy(*order).limit(max(k, 0)))

    # Actions.

    def fetch(self) -> Iterator:
        """Rows as they are asked for, one partition at a time on the driver."""
        return self.frame.toLocalIterator()

    def to_list(self) -> list:
        return self.frame.collect()


def _chained(first, rest):
    yield first
    yield from rest


def _name(frame: DataFrame, key: Column | str) -> str:
    return key if isinstance(key, str) else frame.select(key).columns[0]


def _row(frame: DataFrame) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in frame.columns])


def _aggregated(frame: DataFrame, keys: dict[str, Column], aggr: Aggr, name: str) -> DataFrame:
    leaves = aggr.leaves
    if keys and len(leaves) == 1 and leaves[0].order:
        inner = _first_of_groups(frame, keys, leaves[0])
    elif all(leaf.native for leaf in leaves) and not any(leaf.order for leaf in leaves):
        row = _row(frame)
        natives = [leaf.native(leaf.value(row), leaf.where(row) if leaf.where else None).alias(f"leaf_{i}") for i, leaf in enumerate(leaves)]
        inner = frame.groupBy(*[c.alias(k) for k, c in keys.items()]).agg(*natives)
    elif not keys and len(leaves) == 1 and leaves[0].order:
        inner = _first_of_all(frame, leaves[0])
    elif all(leaf.order or leaf.native for leaf in leaves):
        inner = _side_by_side(frame, keys, leaves)
    else:
        inner = _folded(frame, keys, leaves)
    return inner.select(*keys, aggr.finish([F.col(f"leaf_{i}") for i in range(len(leaves))]).alias(name))


def _ranked(frame: DataFrame, keys: dict[str, Column], leaf: Leaf) -> DataFrame:
    row = _row(frame)
    where = leaf.where(row) if leaf.where else F.lit(True)
    return frame.select(*[c.alias(k) for k, c in keys.items()], where.alias("__counts"), leaf.value(row).alias("__pair"))


def _first_of_groups(frame: DataFrame, keys: dict[str, Column], leaf: Leaf) -> DataFrame:
    """Top-k of groups: ranks cut to k in each task before the shuffle and after it, so no group is held whole. A group none of
    whose rows counts keeps one, so that its key stays."""
    k, greatest = leaf.order
    rank = F.col("__pair.key").desc() if greatest else F.col("__pair.key").asc()
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("__counts").desc(), rank))
    cut = _ranked(frame, keys, leaf).withColumn("__nth", nth).where(F.col("__nth") <= max(k, 1))
    rows = F.collect_list(F.when(F.col("__counts") & (F.col("__nth") <= k), F.struct("__nth", F.col("__pair.row").alias("row"))))
    return cut.groupBy(*keys).agg(F.transform(F.sort_array(rows), lambda r: r["row"]).alias("leaf_0"))


def _first_of_all(frame: DataFrame, leaf: Leaf) -> DataFrame:
    k, greatest = leaf.order
    order = F.col("__pair.key").desc() if greatest else F.col("__pair.key").asc()
    cut = _ranked(frame, {}, leaf).where("__counts").orderBy(order).limit(k)
    return cut.agg(F.transform(F.sort_array(F.collect_list("__pair"), not greatest), lambda r: r["row"]).alias("leaf_0"))


def _side_by_side(frame: DataFrame, keys: dict[str, Column], leaves: tuple[Leaf, ...]) -> DataFrame:
    """Top-k beside other aggregates, each by its own plan: what Catalyst aggregates in one grouping, each top-k by its ranks. All
    have the same groups, which meet by their keys; without keys each is one row."""
    row = _row(frame)
    plain = [leaf.native(leaf.value(row), leaf.where(row) if leaf.where else None).alias(f"leaf_{i}") for i, leaf in enumerate(leaves) if not leaf.order]
    parts = [frame.groupBy(*[c.alias(k) for k, c in keys.items()]).agg(*plain)] if plain else []
    for i, leaf in enumerate(leaves):
        if leaf.order:
            first = _first_of_groups(frame, keys, leaf) if keys else _first_of_all(frame, leaf)
            parts.append(first.withColumnRenamed("leaf_0", f"leaf_{i}"))
    out = parts[0]
    if not keys:
        for part in parts[1:]:
            out = out.unionByName(part, allowMissingColumns=True)
        return out.agg(*[F.first(f"leaf_{i}", ignorenulls=True).alias(f"leaf_{i}") for i in range(len(leaves))])
    for part in parts[1:]:
        other = part.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in part.columns if c not in keys])
        same = [out[k].eqNullSafe(other[f"__{k}"]) for k in keys]
        out = out.join(other, same).drop(*[f"__{k}" for k in keys])
    return out


def _folded(frame: DataFrame, keys: dict[str, Column], leaves: tuple[Leaf, ...]) -> DataFrame:
    """All leaves as folds: one pass before the shuffle, one streaming pass over states sorted by key after it."""
    row = _row(frame)
    values = []
    for i, leaf in enumerate(leaves):
        values += [leaf.value(row).alias(f"value_{i}"), (leaf.where(row) if leaf.where else F.lit(True)).alias(f"where_{i}")]
    grouped = keys or {"__all": F.lit(0)}
    flat = frame.select(*[c.alias(k) for k, c in grouped.items()], *values)
    heads = StructType(flat.schema.fields[: len(grouped)])
    states = flat.mapInArrow(partial_phase([leaf.partial for leaf in leaves], len(grouped)), StructType(list(heads.fields)).add("payload", "binary"))
    out = StructType(list(heads.fields))
    for i, leaf in enumerate(leaves):
        # what a built-in returns is read off its Catalyst form
        out.add(f"leaf_{i}", _schema(frame, f"x {leaf.returns}")[0].dataType if leaf.returns else flat.agg(leaf.native(F.col(f"value_{i}"), None).alias("x")).schema[0].dataType)
    types = [to_arrow_type(f.dataType) for f in out.fields[len(grouped) :]]
    ordered = states.repartition(*grouped).sortWithinPartitions(*grouped)
    done = ordered.mapInArrow(final_phase([leaf.final for leaf in leaves], len(grouped), types), out)
    if keys:
        return done
    # of no rows there are no states: the folds' own empty results
    empty = tuple(leaf.final.done(leaf.final.start()) for leaf in leaves)
    none = frame.sparkSession.createDataFrame([empty], StructType(out.fields[1:]))
    rest = [f"leaf_{i}" for i in range(len(leaves))]
    return done.select(F.lit(0).alias("__rank"), *rest).unionAll(none.select(F.lit(1), *rest)).orderBy("__rank").limit(1).select(*rest)
