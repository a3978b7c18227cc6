"""Two-level k-means: coarse lists, and finer ones within each, all fitted in the same rounds."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.operators.cluster import KMeans, assign
from nearfield.operators.sums import add_up


def _matrix(column, n: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(n, -1)


def _nearest_within(x: np.ndarray, lists: np.ndarray, fine: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The nearest fine centroid of each row's own list, ties to the first, and its squared distance."""
    at, dist = np.zeros(len(x), np.int64), np.zeros(len(x))
    for no in np.unique(lists).tolist():
        own, c = np.flatnonzero(lists == no), fine[no]
        y = x[own]
        d = (y * y).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * y @ c.T
        at[own] = d.argmin(1)
        dist[own] = np.maximum(d[np.arange(len(own)), at[own]], 0)
    return at, dist


def _starts(inside: DataFrame, k1: int, k2: int, seed: int) -> list[np.ndarray]:
    """For each list its k2 distinct vectors of least hash. A task keeps k2 a list, so neither the table is shuffled nor
    do copies of one vector crowd out others."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch if held is None else pa.concat_batches([held, batch])
            no, h = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            order = np.lexsort((h, no))
            no, h = no[order], h[order]
            new = np.concatenate(([True], (np.diff(no) != 0) | (np.diff(h) != 0)))
            order, no = order[new], no[new]
            rank = np.arange(len(no)) - np.searchsorted(no, no)
            held = batch.take(pa.array(order[rank < k2]))
        if held is not None:
            yield held

    kind = inside.schema["embedding"].dataType.simpleString()
    own = inside.select("list_no", F.xxhash64(F.lit(seed), "embedding").alias("h"), "embedding").mapInArrow(run, f"list_no int, h long, embedding {kind}")
    one = own.groupBy("list_no", "h").agg(F.first("embedding").alias("embedding"))
    best = one.withColumn("r", F.row_number().over(Window.partitionBy("list_no").orderBy("h"))).where(F.col("r") <= k2)
    out: list[list] = [[] for _ in range(k1)]
    for r in best.orderBy("list_no", "h").select("list_no", "embedding").collect():  # k1 * k2 rows, as many as centroids
        out[r[0]].append(r[1])
    return [np.array(x, dtype=np.float64) for x in out]


@dataclass
class TwoLevel:
    """k1 coarse lists and up to k2 fine ones in each: niter jobs for the coarse level and niter for all fine ones at once.

    A row is assigned by k1 + k2 distances, not by k1 * k2. Fine lists are numbered through, a coarse list's behind those
    of the one before; a coarse list of fewer distinct vectors has fewer. What is sent to tasks, and what comes back in a
    round, has the size of all centroids; the fine sums are added up as the coarse ones are, by sums.add_up.
    """

    k1: int
    k2: int
    niter: int = 8
    seed: int = 1234
    coarse: np.ndarray | None = None
    fine: list[np.ndarray] = field(default_factory=list)
    stats: list[dict] = field(default_factory=list)

    def fit(self, vectors: DataFrame, coarse: np.ndarray | None = None, fine: list[np.ndarray] | None = None) -> TwoLevel:
        """coarse: centroids that stay as they are; fine: where the fine ones start."""
        x = vectors.where("embedding is not null").select("embedding")
        self.coarse = KMeans(self.k1, self.niter, self.seed).fit(x) if coarse is None else np.asarray(coarse, dtype=np.float64)
        inside = assign(x, self.coarse).select("list_no", "embedding").persist()
        self.fine = _starts(inside, len(self.coarse), self.k2, self.seed) if fine is None else [np.array(c, dtype=np.float64) for c in fine]
        # an empty coarse list keeps its own centroid as the one fine list
        self.fine = [c if len(c) else self.coarse[i : i + 1] for i, c in enumerate(self.fine)]
        first, d = self._first(), self.coarse.shape[1]
        helper, self.stats = KMeans(self.k2, seed=self.seed), []
        for _ in range(self.niter):
            sent = x.sparkSession.sparkContext.broadcast(self.fine)

            def totals(batches, sent=sent):
                fine, t = sent.value, np.zeros((first[-1], d + 2))
                for batch in batches:
                    if not batch.num_rows:
                        continue
                    lists, y = batch.column(0).to_numpy(), _matrix(batch.column(1), batch.num_rows)
                    at, dist = _nearest_within(y, lists, fine)
                    at = at + first[lists]
                    t[:, 0] += np.bincount(at, minlength=len(t))
                    t[:, 1] += np.bincount(at, weights=dist, minlength=len(t))
                    order = np.argsort(at, kind="stable")
                    cuts = np.flatnonzero(np.diff(at[order], prepend=-1))
                    t[at[order][cuts], 2:] += np.add.reduceat(y[order], cuts, axis=0)
                return t.ravel()

            t = add_up(inside, totals)
            sent.unpersist()
            if t is None:
                break
            t = t.reshape(-1, d + 2)
            moved = 0.0
            for i, c in enumerate(self.fine):
                own = t[first[i] : first[i + 1]]
                n = own[:, 0].copy()
                new = np.where(n[:, None] > 0, own[:, 2:] / np.maximum(n, 1)[:, None], c)
                helper.split(new, n, 0)
                moved = max(moved, float(np.abs(new - c).max()))
                self.fine[i] = new
            n = t[:, 0]
            self.stats.append({"objective": float(t[:, 1].sum()), "imbalance": float(len(n) * (n * n).sum() / max(n.sum(), 1) ** 2), "moved": moved})
            if moved == 0.0:
                break
        inside.unpersist()
        return self

    def _first(self) -> np.ndarray:
        return np.concatenate(([0], np.cumsum([len(c) for c in self.fine])))

    @property
    def centroids(self) -> np.ndarray:
        return np.concatenate(self.fine)

    def assign(self, vectors: DataFrame) -> DataFrame:
        """vectors with coarse_no, list_no (of the fine list) and list_dist, through both levels."""
        sent = vectors.sparkSession.sparkContext.broadcast((self.fine, self._first()))
        rows = assign(vectors, self.coarse).withColumnRenamed("list_no", "coarse_no").drop("list_dist")

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            fine, first = sent.value
            for batch in batches:
                lists = batch.column(batch.schema.get_field_index("coarse_no")).to_numpy()
                x = _matrix(batch.column(batch.schema.get_field_index("embedding")), batch.num_rows) if batch.num_rows else np.zeros((0, 1))
                at, dist = _nearest_within(x, lists, fine) if batch.num_rows else (np.zeros(0, np.int64), np.zeros(0))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((at + first[lists]).astype(np.int32)), pa.array(dist)], [*batch.schema.names, "list_no", "list_dist"])

        return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("list_no", T.IntegerType()), T.StructField("list_dist", T.DoubleType())]))
