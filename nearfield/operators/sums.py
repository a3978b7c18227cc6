"""Sums of arrays over all tasks, and starting rows, for fits: one job each, whatever the number of partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers of a row that is shuffled on its way to a sum.
CHUNK = 4096


def add_up(rows: DataFrame, totals: Callable[[Iterator], np.ndarray | None]) -> np.ndarray | None:
    """The sum of what totals makes of each task's Arrow batches: arrays of one length, or None for a task without any.

    Tasks send their arrays in chunks, which are dealt by number and added up by tasks again, in the order of the first
    tasks, so reruns agree. The driver holds the sum alone. None if no task had any.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        t = totals(batches)
        if t is not None:
            task = TaskContext.get().partitionId()
            for i, a in enumerate(range(0, len(t), CHUNK)):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([task], pa.int32()), pa.array([t[a : a + CHUNK]], pa.list_(pa.float64()))], ["chunk", "task", "s"])

    def merge(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, s in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                x = s.values.to_numpy(zero_copy_only=False)
                sums[i] = sums[i] + x if i in sums else x
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.float64()))], ["chunk", "s"])

    parts = rows.mapInArrow(run, "chunk int, task int, s array<double>").repartition("chunk").sortWithinPartitions("chunk", "task")
    got = sorted(parts.mapInArrow(merge, "chunk int, s array<double>").collect())
    return np.concatenate([r[1] for r in got]) if got else None


def least_by_hash(vectors: DataFrame, k: int, seed: int | None = None, col: str = "embedding") -> np.ndarray:
    """The k distinct vectors of least hash, fewer if there are fewer. Four k rows of least hash are taken at a time, the
    next ones from behind the last hash, so neither all rows are shuffled nor many copies of one come to the driver."""
    h = F.xxhash64(col) if seed is None else F.xxhash64(F.lit(seed), col)
    rows, found, last = vectors.select(F.col(col).alias("x"), h.alias("h")), {}, None
    while len(found) < k:
        got = (rows if last is None else rows.where(F.col("h") > last)).orderBy("h").limit(4 * k).collect()
        for r in got:
            found.setdefault(r["h"], r["x"])
        if len(got) < 4 * k:
            break
        last = got[-1]["h"]
    return np.array([found[h] for h in sorted(found)[:k]], dtype=np.float64)
