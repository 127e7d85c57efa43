"""Large arrays of counts, sent between tasks in stripes of ``STRIPE`` cells and added up as they come.

Sums go through two levels: stripes of up to ``TASKS_TOGETHER`` neighbouring tasks meet first, so the
last level reads a stripe for each such group of tasks and not for each task.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

STRIPE = 1 << 16
TASKS_TOGETHER = 64


def pack(counts: np.ndarray) -> bytes:
    """Cells in use as a bit mask, then their counts, in as few bytes as the largest one needs."""
    kind = np.uint8 if counts.max() < 256 else np.uint16 if counts.max() < 65536 else np.uint32 if counts.max() < 1 << 32 else np.uint64
    return (bytes([np.dtype(kind).itemsize]) + np.packbits(counts > 0).tobytes()
            + counts[counts > 0].astype(kind).tobytes())


def unpack(buffer) -> np.ndarray:
    raw = np.frombuffer(buffer, np.uint8)
    used = np.unpackbits(raw[1:1 + STRIPE // 8]).astype(bool)
    out = np.zeros(STRIPE, np.int64)
    kind = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[int(raw[0])]
    out[used] = np.frombuffer(raw[1 + STRIPE // 8:].tobytes(), kind)
    return out


def split(table: np.ndarray):
    """(number, packed stripe) of every stripe that holds a count."""
    for k in range(len(table) // STRIPE):
        stripe = table[k * STRIPE:(k + 1) * STRIPE]
        if stripe.any():
            yield k, pack(stripe)


def add(batches, number: str, counts: str) -> dict[int, np.ndarray]:
    """Sums of the stripes of a task by number; one stripe is added at a time."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, packed in zip(batch.column(number).to_pylist(), batch.column(counts)):
            part = unpack(packed.as_buffer())
            sums[k] = sums[k] + part if k in sums else part
    return sums


def row(number: int, content: bytes, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([content], pa.binary())], names)


def group() -> int:
    """The group of neighbouring tasks that this one belongs to."""
    return TaskContext.get().partitionId() // TASKS_TOGETHER


def first_sums(sent: DataFrame, tasks: int) -> DataFrame:
    """(number, packed) of each group, from rows (number, task_group, packed) of the tasks."""
    def work(batches):
        for k, total in add(batches, "number", "packed").items():
            yield row(k, pack(total), ["number", "packed"])

    return sent.repartition(tasks, "number", "task_group").mapInArrow(work, "number long, packed binary")
