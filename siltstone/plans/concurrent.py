"""Independent jobs side by side: threads on the driver, jobs in pools of their own, results in the order of what was asked."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from concurrent.futures import FIRST_EXCEPTION, CancelledError, ThreadPoolExecutor, wait
from typing import Any, TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

T = TypeVar("T")
#: Branches that run at once.
AT_ONCE = 8
_POOL = "spark.scheduler.pool"


def together(spark: SparkSession, tasks: list[Callable[[], T]], at_once: int = AT_ONCE, pool: str = "branches") -> list[T]:
    """The results of ``tasks`` in their order, at most ``at_once`` at a time. A task's thread has the caller's job properties (group, tags, description) and a scheduler pool
    of its own: with ``spark.scheduler.mode=FAIR`` none waits behind another's stages, without it they still overlap. If one fails, those that haven't
    begun don't, the jobs of the others are cancelled by their tag, and of the errors that of the first task that failed by itself is raised."""
    if len(tasks) < 2:
        return [t() for t in tasks]
    context, tag, over = spark.sparkContext, f"together-{uuid.uuid4().hex}", threading.Event()

    def run(k: int) -> Any:
        if over.is_set():
            raise CancelledError
        context.addJobTag(tag)
        before = context.getLocalProperty(_POOL)
        context.setLocalProperty(_POOL, f"{pool}-{k % at_once}")
        try:
            return tasks[k]()
        except BaseException:
            over.set()  # before a thread is free for the next task
            raise
        finally:
            context.removeJobTag(tag)
            context.setLocalProperty(_POOL, before)

    with ThreadPoolExecutor(min(at_once, len(tasks))) as threads:
        found = [threads.submit(inheritable_thread_target(spark)(run), k) for k in range(len(tasks))]
        done, rest = wait(found, return_when=FIRST_EXCEPTION)
        failed = [f for f in found if f in done and f.exception() is not None]
        if failed:
            for f in rest:
                f.cancel()
            while rest:  # a task may be between two jobs when the first are cancelled
                context.cancelJobsWithTag(tag)
                rest = wait(rest, timeout=1).not_done
            raise failed[0].exception()
        return [f.result() for f in found]
