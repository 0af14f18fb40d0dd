"""Running an action in a session, with its log level and its figures."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, fields
from typing import TypeVar

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")


def run(spark: SparkSession, action: Callable[[SparkSession], T], log_level: str = "INFO") -> T:
    """The action's result. Messages under the level are left out. Spark's own progress bar is a setting of the session's start
    (spark.ui.showConsoleProgress)."""
    spark.sparkContext.setLogLevel(log_level)
    return action(spark)


@dataclass(frozen=True)
class Stats:
    """Of all tasks of an action: rows and bytes read and written, bytes shuffled, tasks, their milliseconds, and the action's."""

    input_items: int = 0
    input_bytes: int = 0
    output_items: int = 0
    output_bytes: int = 0
    shuffle_read_bytes: int = 0
    shuffle_write_bytes: int = 0
    tasks: int = 0
    task_ms: int = 0
    elapsed_ms: int = 0

    def __add__(self, other: Stats) -> Stats:
        return Stats(*(getattr(self, f.name) + getattr(other, f.name) for f in fields(Stats)))


def measured(spark: SparkSession, action: Callable[[SparkSession], T]) -> tuple[T, Stats]:
    """The action's result, and the sums of its tasks' figures as Spark keeps them."""
    sc, group = spark.sparkContext, f"measured-{uuid.uuid4().hex}"
    began = time.monotonic()
    sc.setJobGroup(group, "measured action")
    try:
        result = action(spark)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    elapsed = int(1000 * (time.monotonic() - began))
    scala = sc._jsc.sc()
    scala.listenerBus().waitUntilEmpty(30_000)
    tracker, store, total = sc.statusTracker(), scala.statusStore(), Stats(elapsed_ms=elapsed)
    stages = {stage for job in tracker.getJobIdsForGroup(group) if (info := tracker.getJobInfo(job)) for stage in info.stageIds}
    for stage in stages:
        try:
            data = store.lastStageAttempt(stage)
        except Py4JError:  # a stage that was skipped, or that Spark no longer remembers
            continue
        total += Stats(data.inputRecords(), data.inputBytes(), data.outputRecords(), data.outputBytes(), data.shuffleReadBytes(), data.shuffleWriteBytes(), data.numCompleteTasks(), data.executorRunTime())
    return result, total


def observed(frame: DataFrame, name: str = "rows") -> tuple[DataFrame, Observation]:
    """The frame, and what is known after its action: how many rows went through."""
    seen = Observation(name)
    return frame.observe(seen, F.count(F.lit(1)).alias("items")), seen


def explained(frame: DataFrame) -> str:
    """The physical plan as text."""
    return frame._jdf.queryExecution().toString()
