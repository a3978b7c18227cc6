"""k-means of sparse rows: (vec_id, dims, vals), whose other components are 0. Only non-zeros are multiplied and sent."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.operators.cluster import KMeans
from nearfield.operators.sums import add_up

#: Products of non-zeros and centroids that a task holds at a time.
PRODUCTS = 1 << 23


def to_sparse(vectors: DataFrame, least: float = 0.0) -> DataFrame:
    """Dense vectors as sparse ones, components of at most `least` left out."""
    kept = F.filter(F.transform("embedding", lambda x, i: F.struct(i.alias("d"), x.cast("double").alias("v"))), lambda p: F.abs(p["v"]) > least)
    return vectors.select("vec_id", kept.alias("p")).select("vec_id", F.col("p.d").alias("dims"), F.col("p.v").alias("vals"))


def _slices(batch, col: int, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, number of non-zeros of each row, dims, vals) of a batch, in slices of bounded products."""
    sizes = np.diff(batch.column(col).offsets.to_numpy()) if batch.num_rows else np.zeros(0, np.int64)
    dims, vals = (np.asarray(batch.column(col + j).flatten().to_numpy(zero_copy_only=False)) for j in (0, 1))
    ends, a, most = np.concatenate(([0], np.cumsum(sizes))), 0, max(1, PRODUCTS // max(1, k))
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + most, "right")) - 1)
        yield a, sizes[a:b], dims[ends[a] : ends[b]].astype(np.int64), vals[ends[a] : ends[b]].astype(np.float64)
        a = b


def _nearest(sizes: np.ndarray, dims: np.ndarray, vals: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    row = np.repeat(np.arange(len(sizes)), sizes)
    dot, norm = np.zeros((len(sizes), len(c))), np.bincount(row, vals * vals, len(sizes))
    if len(row):
        cuts = np.flatnonzero(np.diff(row, prepend=-1))
        dot[row[cuts]] = np.add.reduceat(vals[:, None] * c.T[dims], cuts, axis=0)
    d = norm[:, None] + (c * c).sum(1)[None] - 2 * dot
    at = d.argmin(1)
    return at, np.maximum(d[np.arange(len(at)), at], 0)


def sparse_assign(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """rows (vec_id, dims, vals) with list_no and list_dist of the nearest of dense centroids, ties to the first. A row
    without non-zeros is the zero vector."""
    sent = rows.sparkSession.sparkContext.broadcast(np.asarray(centroids, dtype=np.float64))
    own = rows.where("dims is not null and vals is not null").select("vec_id", "dims", "vals")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        c = sent.value
        for batch in batches:
            for a, sizes, dims, vals in _slices(batch, 1, len(c)):
                at, dist = _nearest(sizes, dims, vals, c)
                yield pa.RecordBatch.from_arrays([*batch.slice(a, len(sizes)).columns, pa.array(at.astype(np.int32)), pa.array(dist)], [*batch.schema.names, "list_no", "list_dist"])

    return own.mapInArrow(run, T.StructType([*own.schema.fields, T.StructField("list_no", T.IntegerType()), T.StructField("list_dist", T.DoubleType())]))


def sparse_kmeans(rows: DataFrame, k: int, d: int, niter: int = 8, seed: int = 1234, init: np.ndarray | None = None) -> np.ndarray:
    """Lloyd's algorithm over sparse rows of d dimensions, to the centroids that the dense rows would give from the same
    start: one job a round, whose tasks add up non-zeros. The start is the k distinct rows of least hash, or init."""
    x = rows.where("dims is not null and vals is not null").select("dims", "vals").persist()
    if init is None:
        h, found, last = F.xxhash64(F.lit(seed), "dims", "vals"), {}, None
        while len(found) < k:
            got = x.withColumn("h", h).where(F.lit(True) if last is None else F.col("h") > last).orderBy("h").limit(4 * k).collect()
            for r in got:
                found.setdefault(r["h"], r)
            if len(got) < 4 * k:
                break
            last = got[-1]["h"]
        init = np.zeros((min(k, len(found)), d))
        for i, key in enumerate(sorted(found)[:k]):
            init[i, found[key]["dims"]] = found[key]["vals"]
    c, helper = np.array(init, dtype=np.float64), KMeans(k, seed=seed)
    for _ in range(niter if len(c) else 0):
        sent = x.sparkSession.sparkContext.broadcast(c)

        def totals(batches, sent=sent):
            c = sent.value
            t = np.zeros((len(c), d + 1))
            for batch in batches:
                for _, sizes, dims, vals in _slices(batch, 0, len(c)):
                    at, _ = _nearest(sizes, dims, vals, c)
                    t[:, 0] += np.bincount(at, minlength=len(c))
                    np.add.at(t, (np.repeat(at, sizes), dims + 1), vals)
            return t.ravel()

        t = add_up(x, totals)
        sent.unpersist()
        if t is None:
            break
        t = t.reshape(len(c), d + 1)
        n = t[:, 0].copy()
        new = np.where(n[:, None] > 0, t[:, 1:] / np.maximum(n, 1)[:, None], c)
        helper.split(new, n, 0)
        moved, c = np.abs(new - c).max(), new
        if moved == 0.0:
            break
    x.unpersist()
    return c
