"""Submitting work: one entry to graphs, time limits, concurrent steps with their outcomes, task figures and diagnosis."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from typing import Generic, TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from .graph import Graph

T = TypeVar("T")


@dataclass(frozen=True)
class Outcome(Generic[T]):
    """What a step gave, or why it failed, and how long it took."""

    value: T | None
    error: Exception | None
    ms: float

    @property
    def ok(self) -> bool:
        return self.error is None


@dataclass(frozen=True)
class Figures:
    """What the tasks of a step did, from Spark's own status store."""

    jobs: int = 0
    stages: int = 0
    tasks: int = 0
    failed_tasks: int = 0
    run_ms: int = 0
    cpu_ms: int = 0
    rows_read: int = 0
    shuffle_bytes: int = 0
    spilled_bytes: int = 0
    slowest_stage_ms: int = 0


@dataclass(frozen=True)
class Diagnosis:
    outcome: Outcome
    figures: Figures
    notes: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Context:
    """A session with settings for the steps that are submitted through it; settings are changed on copies."""

    spark: SparkSession
    time_limit: float | None = None
    parallelism: int = 4
    report_every: float | None = None
    report: Callable[[str], None] = print

    @staticmethod
    def of(spark: SparkSession, log_level: str = "WARN") -> Context:
        spark.sparkContext.setLogLevel(log_level)
        return Context(spark)

    def with_time_limit(self, seconds: float | None) -> Context:
        """Steps that take longer are cancelled and fail."""
        return replace(self, time_limit=seconds)

    def with_parallelism(self, steps: int) -> Context:
        """How many steps run at once."""
        return replace(self, parallelism=steps)

    def with_reports(self, seconds: float, report: Callable[[str], None] = print) -> Context:
        """Tell how far the stages of a running step are, every so many seconds."""
        return replace(self, report_every=seconds, report=report)

    def read(self, path: str, labeling: str = "ve", **options) -> Graph:
        from ..sources.text import read_graph

        return read_graph(self.spark, path, labeling, **options)

    def submit(self, step: Callable[[], T]) -> T:
        """Run a step; its failure is raised."""
        outcome, _ = self._run(step)
        if outcome.error is not None:
            raise outcome.error
        return outcome.value

    def try_submit(self, step: Callable[[], T]) -> Outcome[T]:
        """Run a step; its failure is told."""
        return self._run(step)[0]

    def submit_all(self, steps: Sequence[Callable[[], T]]) -> list[Outcome[T]]:
        """Run steps at the same time, each in a thread and job group of its own."""
        with ThreadPoolExecutor(max(1, self.parallelism)) as pool:
            return list(pool.map(lambda step: inheritable_thread_target(self.spark)(self.try_submit)(step), steps))

    def diagnose(self, step: Callable[[], T]) -> Diagnosis:
        """Run a step and say what its tasks spent their time on."""
        outcome, group = self._run(step)
        f, notes = self.figures(group), []
        if f.run_ms and f.cpu_ms < 0.5 * f.run_ms:
            notes.append("tasks wait more than they compute: input, shuffle or Python workers")
        if f.spilled_bytes:
            notes.append("tasks spill: more partitions, or more memory")
        if f.stages and f.slowest_stage_ms > 0.8 * f.run_ms and f.stages > 2:
            notes.append("one stage takes most of the time: look for a skewed key")
        if f.failed_tasks:
            notes.append(f"{f.failed_tasks} tasks failed and ran again")
        return Diagnosis(outcome, f, notes)

    def figures(self, group: str) -> Figures:
        sc = self.spark.sparkContext
        store = sc._jsc.sc().statusStore()
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        jobs = list(sc.statusTracker().getJobIdsForGroup(group))
        stages = {s for j in jobs for s in (sc.statusTracker().getJobInfo(j) or _none).stageIds}
        sums = dict.fromkeys(("tasks", "failed_tasks", "run_ms", "cpu_ms", "rows_read", "shuffle_bytes", "spilled_bytes", "slowest_stage_ms"), 0)
        ran = 0
        for s in stages:
            try:
                x = store.lastStageAttempt(s)
            except Exception:  # a stage that was skipped, or is no longer held
                continue
            ran += x.numTasks() > 0
            for k, v in (("tasks", x.numTasks()), ("failed_tasks", x.numFailedTasks()), ("run_ms", x.executorRunTime()), ("cpu_ms", x.executorCpuTime() // 1_000_000), ("rows_read", x.inputRecords()), ("shuffle_bytes", x.shuffleWriteBytes()), ("spilled_bytes", x.diskBytesSpilled())):
                sums[k] += v
            sums["slowest_stage_ms"] = max(sums["slowest_stage_ms"], x.executorRunTime())
        return Figures(len(jobs), ran, **sums)

    def _run(self, step: Callable[[], T]) -> tuple[Outcome[T], str]:
        sc, group = self.spark.sparkContext, f"lodestone-{uuid.uuid4().hex}"
        ended = threading.Event()
        before = sc.getLocalProperty("spark.jobGroup.id"), sc.getLocalProperty("spark.job.description")
        sc.setJobGroup(group, "lodestone step", interruptOnCancel=True)
        watch = threading.Thread(target=self._watch, args=(group, ended), daemon=True)
        watch.start()
        began = time.monotonic()
        value, error = None, None
        try:
            value = step()
        except Exception as e:  # whatever a step raises is its outcome
            error = e
        finally:
            ended.set()
            watch.join()
            for name, was in zip(("spark.jobGroup.id", "spark.job.description"), before, strict=True):
                sc.setLocalProperty(name, was)
        ms = 1000 * (time.monotonic() - began)
        if error is not None and self.time_limit is not None and ms >= 1000 * self.time_limit:
            error = TimeoutError(f"the step took more than {self.time_limit} seconds")
        return Outcome(value, error, ms), group

    def _watch(self, group: str, ended: threading.Event) -> None:
        """Cancel the group at its time limit, and report progress until it has ended."""
        sc = self.spark.sparkContext
        began, told = time.monotonic(), 0.0
        while not ended.wait(0.05):
            spent = time.monotonic() - began
            if self.time_limit is not None and spent >= self.time_limit:
                sc.cancelJobGroup(group)
            if self.report_every is not None and spent - told >= self.report_every:
                told = spent
                tracker = sc.statusTracker()
                for j in tracker.getJobIdsForGroup(group):
                    for s in (tracker.getJobInfo(j) or _none).stageIds:
                        if (info := tracker.getStageInfo(s)) and info.numActiveTasks:
                            self.report(f"{spent:.1f} s: stage {s}, {info.numCompletedTasks} of {info.numTasks} tasks done, {info.numActiveTasks} running")


class _None:
    stageIds = ()


_none = _None()


def as_rows(spark: SparkSession, named: dict[str, int]) -> DataFrame:
    return spark.createDataFrame(sorted(named.items()), "name string, n long")
