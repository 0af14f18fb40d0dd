"""Datasets from the caller's own producers, one Spark partition for each of theirs."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from bagflow.operators.dataset import Dataset


@dataclass(frozen=True)
class Partition:
    """Rows made on one executor: those of its producers, one after the other. Adding partitions joins them; Partition() is
    the empty one."""

    producers: tuple[Callable[[], Iterable[tuple]], ...] = ()

    @staticmethod
    def of(producer: Callable[[], Iterable[tuple]]) -> Partition:
        return Partition((producer,))

    def __add__(self, other: Partition) -> Partition:
        return Partition(self.producers + other.producers)

    def rows(self) -> Iterator[tuple]:
        for producer in self.producers:
            yield from producer()


class _Part(InputPartition):
    def __init__(self, pickled: bytes):
        self.pickled = pickled


class _Reader(DataSourceReader):
    def __init__(self, partitions: list[Partition]):
        self._partitions = partitions

    def partitions(self) -> list[_Part]:
        return [_Part(cloudpickle.dumps(p)) for p in self._partitions]

    def read(self, partition: _Part) -> Iterator[tuple]:
        yield from cloudpickle.loads(partition.pickled).rows()


class External(DataSource):
    """Format "bagflow_external"; the option "partitions" has the pickled list."""

    @classmethod
    def name(cls) -> str:
        return "bagflow_external"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(cloudpickle.loads(base64.b64decode(self.options["partitions"])))


def external(spark: SparkSession, partitions: Iterable[Partition], schema: StructType | str) -> Dataset:
    """The rows of all partitions. No partitions make an empty dataset; an empty partition is a partition without rows."""
    partitions = list(partitions)
    if not partitions:
        return Dataset(spark.createDataFrame([], schema))
    spark.dataSource.register(External)
    pickled = base64.b64encode(cloudpickle.dumps(partitions)).decode()
    return Dataset(spark.read.format("bagflow_external").schema(schema).option("partitions", pickled).load())


def table(spark: SparkSession, path: str, name: str) -> Dataset:
    """A parquet table of a folder."""
    return Dataset(spark.read.parquet(f"{path}/{name}.parquet"))
