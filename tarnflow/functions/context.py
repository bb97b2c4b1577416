"""Where a Python function runs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import TaskContext


@dataclass(frozen=True)
class OperatorContext:
    """worker_id: the partition, which stays the same in a retry; attempt: how often it was tried before; operator_id: the
    operator's name, where it has one."""

    worker_id: int
    stage_id: int
    attempt: int
    operator_id: str | None = None


def operator_context() -> OperatorContext:
    """The context of the task that calls this; the driver's is worker 0."""
    task = TaskContext.get()
    return OperatorContext(0, 0, 0) if task is None else OperatorContext(task.partitionId(), task.stageId(), task.attemptNumber())
