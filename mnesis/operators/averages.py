"""The moving average of feedback, rounded at each step, for memories with any number of events.

A step takes values to values, rising and closer together, so that what a long run of steps does to any value is a function of few levels. Events are sorted into
tasks by memory and time; a task that lies within one memory's events tells that function, and the driver carries one number from task to task.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnesis.functions.columns import lookup
from mnesis.model import DEFAULT, OUTCOMES, Params
from mnesis.operators.writes import cut

STEP = 1e6
SHORT = 64  # a run of so few steps is kept as it is; one step merges a tenth of the values


def step(value: float, target: float, alpha: float) -> float:
    return math.floor((value + alpha * (target - value)) * STEP + 0.5) / STEP


class Run:
    """What steps in a row do to any value that a step has left: their targets while they are few, then the least values from which each level is reached, and the levels."""

    def __init__(self, alpha: float):
        self.alpha, self.targets, self.at, self.level = alpha, [], None, None

    def add(self, targets: Iterable[float]) -> None:
        for t in targets:
            if self.targets is not None:
                self.targets.append(t)
                if len(self.targets) > SHORT:
                    early, self.targets = self.targets, None
                    self.at = self.level = np.arange(-1_000_000, 1_000_001) / STEP
                    for x in early:
                        self._step(x)
            else:
                self._step(t)

    def _step(self, t: float) -> None:
        level = np.floor((self.level + self.alpha * (t - self.level)) * STEP + 0.5) / STEP
        new = np.r_[True, level[1:] != level[:-1]]
        self.at, self.level = self.at[new], level[new]

    def text(self) -> str:
        return json.dumps({"targets": self.targets} if self.targets is not None else {"at": self.at.tolist(), "level": self.level.tolist()})


def through(run: str, value: float, alpha: float) -> float:
    """What a run's text makes of a value from -1 to 1 of six digits."""
    told = json.loads(run)
    if "targets" in told:
        for t in told["targets"]:
            value = step(value, t, alpha)
        return value
    return told["level"][max(0, int(np.searchsorted(told["at"], value, side="right")) - 1)]


def _runs(ids: np.ndarray) -> list[tuple[int, int]]:
    """Where the stretches of one memory begin and end within a batch."""
    cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
    return list(zip(cuts[:-1], cuts[1:], strict=True)) if len(ids) else []


def _read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("memory_id", "start", "target"))


def _ends(alpha: float):
    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = value = None
        run = Run(alpha)
        for batch in batches:
            ids, start, target = _read(batch)
            runs = _runs(ids)
            for n, (i, j) in enumerate(runs):
                if first is None:
                    first = ids[i]
                if ids[i] == first:
                    run.add(target[i:j].tolist())
                if n == len(runs) - 1:  # only the value of the task's last memory is asked for: others, which end within a batch, aren't walked through
                    if ids[i] != last:
                        last, value = ids[i], 0.0 if math.isnan(start[i]) else float(start[i])
                    for t in target[i:j].tolist():
                        value = step(value, t, alpha)
        if first is not None:  # where one memory has the whole task, its value at the end depends on tasks before
            columns = [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([first], pa.int64()), pa.array([last], pa.int64()), pa.array([value], pa.float64()), pa.array([run.text() if first == last else None], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "first", "last", "value", "run"])

    return ends


def _steps(alpha: float, carried: dict[int, float], keep: tuple[str, ...]):
    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, value = None, 0.0
        for batch in batches:
            ids, start, target = _read(batch)
            before, after = [], []
            for i, j in _runs(ids):
                if ids[i] != last:
                    value = carried.get(TaskContext.get().partitionId(), float(start[i])) if last is None else float(start[i])
                    last = ids[i]
                for t in target[i:j].tolist():
                    before.append(value)
                    value = step(0.0 if math.isnan(value) else value, t, alpha)
                    after.append(value)
            columns = [*(batch.column(c) for c in ("memory_id", "seq", "outcome")), pa.array(before, pa.float64(), from_pandas=True), pa.array(after, pa.float64()), *(batch.column(c) for c in keep)]
            yield pa.RecordBatch.from_arrays(columns, names=["memory_id", "seq", "outcome", "before", "after", *keep])

    return steps


def steps(feedback: DataFrame, memories: DataFrame | None = None, p: Params = DEFAULT, keep: tuple[str, ...] = ()) -> DataFrame:
    """memory_id, seq, outcome, before and after of each event of feedback (memory_id, seq, outcome) in order of seq, with the columns of feedback to `keep`: insight.ema() step by step, the same to the last digit.

    Starts from the polarity of memories (id, polarity), cut to -1..1; none counts as 0, and `before` of its first event is null. Events of unknown memories and outcomes, or without memory, are left out.
    The sorted events are written below spark.checkpoint.dir, as the tasks of both passes must be the same. The driver gets a row for each task.
    """
    rows = feedback.where(F.col("outcome").isin(*OUTCOMES) & F.col("memory_id").isNotNull()).select(F.col("memory_id").cast("long"), F.col("seq").cast("long"), "outcome", lookup(F.col("outcome"), OUTCOMES, None).cast("double").alias("target"), *keep)
    if memories is None:
        rows = rows.withColumn("start", F.lit(None).cast("double"))
    else:
        polarity = F.when(F.col("polarity").isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("polarity").cast("double"))))
        rows = rows.join(memories.select(F.col("id").alias("memory_id"), polarity.alias("start")), "memory_id")
    order = ["memory_id", "seq", "target"]
    tasks = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order))
    ends = sorted(tasks.select("memory_id", "start", "target").mapInArrow(_ends(p.ema_alpha), "part int, first long, last long, value double, run string").collect())
    carried, last, value = {}, None, 0.0
    for e in ends:
        if e.first == last:
            carried[e.part] = value
            value = through(e.run, value, p.ema_alpha) if e.run is not None else e.value
        else:
            value = e.value
        last = e.last
    kept = "".join(f", `{c}` {t}" for c, t in tasks.dtypes if c in keep)
    return tasks.select("memory_id", "seq", "outcome", "start", "target", *keep).mapInArrow(_steps(p.ema_alpha, carried, keep), f"memory_id long, seq long, outcome string, before double, after double{kept}")


def ema(feedback: DataFrame, memories: DataFrame | None = None, p: Params = DEFAULT) -> DataFrame:
    """insight.ema() for memories with any number of events: memory_id, polarity, events."""
    return steps(feedback, memories, p).groupBy("memory_id").agg(F.max_by("after", F.struct("seq", "outcome")).alias("polarity"), F.count(F.lit(1)).alias("events"))
