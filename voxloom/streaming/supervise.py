"""Watching long jobs: which are stuck, and what to do about one that is or that has ended."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Seconds between two looks, and looks without progress before a restart.
POLL_S, MOST_STALLS = 300.0, 6


@dataclass(frozen=True)
class Watch:
    """What is known of a job: its preset, the step last seen, and looks without progress since."""

    preset: str
    step: int
    stalls: int = 0


def looked(watch: Watch, running: bool, step: int, failure: str = "", presets: Sequence[str] = (), memory_signs: Sequence[str] = ("OutOfMemoryError",), most_stalls: int = MOST_STALLS) -> tuple[Watch, str]:
    """The state after a look and what to do: ``wait``, ``kill`` (stuck: end it and start again) or ``start`` (it has ended). A
    job that ran out of memory goes on with the next, smaller one of ``presets``, if there is one. A job at step 0
    is still starting, so it isn't stuck."""
    if running:
        stuck = step == watch.step and step > 0
        now = replace(watch, step=step, stalls=watch.stalls + 1 if stuck else 0)
        return (replace(now, stalls=0), "kill") if now.stalls >= most_stalls else (now, "wait")
    preset = watch.preset
    if any(sign in failure for sign in memory_signs) and preset in presets[:-1]:
        preset = presets[presets.index(preset) + 1]
    return Watch(preset, step), "start"


def supervise(job, presets: Sequence[str], looks: int | None = None, poll_s: float = POLL_S, sleep: Callable[[float], None] = time.sleep, **rules) -> Watch:
    """Look at ``job`` (running(), step(), failure(), stop(), start(preset)) again and again, ``looks`` times or for ever."""
    watch = Watch(presets[0], job.step())
    while looks is None or looks > 0:
        sleep(poll_s)
        running = job.running()
        watch, act = looked(watch, running, job.step(), "" if running else job.failure(), presets, **rules)
        if act == "kill":
            job.stop()
        if act != "wait":
            job.start(watch.preset)
            watch = replace(watch, step=job.step())
        looks = None if looks is None else looks - 1
    return watch


def stuck_jobs(progress: DataFrame, by: Sequence[str], order: Sequence[str], step: str = "step", most_stalls: int = MOST_STALLS) -> DataFrame:
    """(``by``..., step, looks) of each stretch of at least ``most_stalls`` looks at a job that saw the step of the look before."""
    looks = W.partitionBy(*by).orderBy(*order)
    moved = F.coalesce((F.col(step) != F.lag(step).over(looks)).cast("int"), F.lit(1))
    runs = progress.withColumn("_moved", moved).withColumn("_run", F.sum("_moved").over(looks.rowsBetween(W.unboundedPreceding, W.currentRow)))
    each = runs.groupBy(*by, "_run").agg(F.first(step).alias(step), (F.count(F.lit(1)) - 1).alias("looks"))
    return each.where(F.col("looks") >= most_stalls).drop("_run")
