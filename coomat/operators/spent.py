"""What the tasks of some Spark jobs spent their time on, from Spark's own task metrics."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


@dataclass
class Spent:
    """Seconds of all tasks together: in all, and of that on shuffles (waiting for blocks, writing them)."""

    tasks: float = 0.0
    moving: float = 0.0

    @property
    def share_moving(self) -> float:
        return min(1.0, self.moving / self.tasks) if self.tasks > 0 else 0.0


@contextmanager
def measured(spark: SparkSession, into: Spent) -> Iterator[None]:
    """Adds the times of all jobs that this thread starts inside, those of broadcasts and adaptive stages included."""
    context, tag = spark.sparkContext, f"measured-{uuid.uuid4().hex}"
    context.addJobTag(tag)
    try:
        yield
    finally:
        context.removeJobTag(tag)
        scala = context._jsc.sc()
        scala.listenerBus().waitUntilEmpty(10_000)
        store, jobs = scala.statusStore(), context._jvm.scala.jdk.javaapi.CollectionConverters.asJava(scala.statusStore().jobsList(None))
        seen = set()
        for job in jobs:
            if job.jobTags().contains(tag):
                seen.update(context._jvm.scala.jdk.javaapi.CollectionConverters.asJava(job.stageIds()))
        for stage in seen:
            try:
                x = store.lastStageAttempt(stage)
            except Py4JJavaError:  # skipped, as its output was there: no task ran
                continue
            into.tasks += x.executorRunTime() / 1e3
            into.moving += x.shuffleFetchWaitTime() / 1e3 + x.shuffleWriteTime() / 1e9
