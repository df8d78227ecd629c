"""Work of many Spark jobs side by side: a pool of the fair scheduler each, and one failure ends all."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from concurrent.futures import FIRST_EXCEPTION, ThreadPoolExecutor, wait
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

POOL = "spark.scheduler.pool"


def side_by_side(spark: SparkSession, work: Mapping[Any, Callable[[], Any]], parallelism: int = 8) -> dict:
    """The results of all calls by their keys.

    Each call's jobs run in a scheduler pool of their own, so that with ``spark.scheduler.mode=FAIR`` short fits do not
    wait for long ones, and keep the caller's local properties.  If a call fails, those that have not begun are dropped, the
    running jobs of the others are cancelled, and its error is raised when none is left."""
    context, tag = spark.sparkContext, f"together-{uuid.uuid4().hex}"

    def run(name: Any, call: Callable[[], Any]) -> Any:
        before = context.getLocalProperty(POOL)
        context.addJobTag(tag)
        context.setLocalProperty(POOL, f"{tag}-{name}")
        try:
            return call()
        finally:
            context.removeJobTag(tag)
            context.setLocalProperty(POOL, before)

    with ThreadPoolExecutor(parallelism) as pool:
        waiting = {name: pool.submit(inheritable_thread_target(spark)(run), name, call) for name, call in work.items()}
        done, _ = wait(waiting.values(), return_when=FIRST_EXCEPTION)
        failed = next((f for f in done if f.exception() is not None), None)
        if failed is not None:
            for f in waiting.values():
                f.cancel()
            # A call that is between two jobs starts its next one after this; cancel until all have ended.
            while wait(waiting.values(), timeout=0.2).not_done:
                context.cancelJobsWithTag(tag)
            raise failed.exception()
    return {name: f.result() for name, f in waiting.items()}
