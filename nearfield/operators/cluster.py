"""Clustering and column statistics. Centroids are small NumPy arrays on the driver; vectors never are."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.functions.vectors import doubles
from nearfield.operators.manifest import digest, read_manifest, table_version, write_manifest
from nearfield.operators.sums import add_up, least_by_hash


def assign(vectors: DataFrame, centroids: np.ndarray, ip: bool = False, col: str = "embedding") -> DataFrame:
    """vectors with list_no and list_dist of the nearest centroid, ties to the first, by a map with the centroids sent along."""
    sent = vectors.sparkSession.sparkContext.broadcast(np.asarray(centroids, dtype=np.float64))

    def run(batches):
        import pyarrow as pa

        c = sent.value
        for batch in batches:
            i = batch.schema.get_field_index(col)
            n = batch.num_rows
            x = np.asarray(batch.column(i).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(n, -1) if n else np.zeros((0, c.shape[1]))
            d = -(x @ c.T) if ip else (x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * x @ c.T
            at = d.argmin(1)
            best = d[np.arange(n), at]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32)), pa.array(-best if ip else np.maximum(best, 0.0))], [*batch.schema.names, "list_no", "list_dist"])

    from pyspark.sql import types as T

    schema = T.StructType([*vectors.schema.fields, T.StructField("list_no", T.IntegerType()), T.StructField("list_dist", T.DoubleType())])
    return vectors.mapInArrow(run, schema)


def centroid_sums(assigned: DataFrame, d: int, weight: Column | None = None, col: str = "embedding") -> DataFrame:
    """Weight, count and weighted component sums of each list: partial sums make it a row per list and task to shuffle."""
    w = F.lit(1.0) if weight is None else weight
    x = doubles(F.col(col))
    return assigned.groupBy("list_no").agg(F.sum(w).alias("w"), F.count("*").alias("n"), *[F.sum(x[i] * w).alias(f"x{i}") for i in range(d)])


#: Numbers that a task may hold in a round of Lloyd's algorithm; beyond, lists are summed by a shuffle of vectors.
SUMS = 1 << 20


def lloyd_sums(vectors: DataFrame, books: list[np.ndarray], ip: bool = False) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each book of centroids over its slice of the dimensions: weights, counts and sums of the vectors nearest to
    each centroid. vectors has embedding and, if weighted, w. One job, whose tasks send sums only."""
    sent = vectors.sparkSession.sparkContext.broadcast(books)
    weighted = "w" in vectors.columns

    def totals(batches):
        books = sent.value
        total = [np.zeros((len(c), c.shape[1] + 2)) for c in books]
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = np.asarray(batch.column(0).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(n, -1)
            w = batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64) if weighted else np.ones(n)
            first = 0
            for t, c in zip(total, books, strict=True):
                y = x[:, first : first + c.shape[1]]
                first += c.shape[1]
                at = (-(y @ c.T) if ip else (c * c).sum(1)[None] - 2 * y @ c.T).argmin(1)
                t[:, 0] += np.bincount(at, weights=w, minlength=len(c))
                t[:, 1] += np.bincount(at, minlength=len(c))
                for j in range(c.shape[1]):
                    t[:, 2 + j] += np.bincount(at, weights=w * y[:, j], minlength=len(c))
        return np.concatenate([t.ravel() for t in total])

    flat = add_up(vectors.select("embedding", *["w"] * weighted), totals)
    flat = np.zeros(sum(c.size + 2 * len(c) for c in books)) if flat is None else flat
    out, at = [], 0
    for c in books:
        t = flat[at : at + c.size + 2 * len(c)].reshape(len(c), -1)
        at += t.size
        out.append((t[:, 0], t[:, 1], t[:, 2:]))
    return out


@dataclass
class KMeans:
    """Lloyd's algorithm over a DataFrame. init: the k vectors of least hash, distinct rows. An empty list is split off a
    large one, drawn by size, by moving both copies by +-eps on alternating dimensions."""

    k: int
    niter: int = 10
    seed: int = 1234  # fixed value, as is split()'s 1 / 1024
    spherical: bool = False
    int_centroids: bool = False
    frozen: np.ndarray | None = None
    max_points_per_centroid: int | None = None
    stats: list[dict] = field(default_factory=list)

    def fit(self, vectors: DataFrame, weight: Column | None = None, init: np.ndarray | None = None, col: str = "embedding", checkpoint: str | None = None) -> np.ndarray:
        """checkpoint: a path where the centroids are written after each round. A fit of the same settings, start and rows
        that was broken off goes on from there, to the same centroids; one of others starts anew."""
        x = vectors
        if self.max_points_per_centroid:
            n = x.count()
            if n > self.k * self.max_points_per_centroid:
                x = x.sample(self.k * self.max_points_per_centroid / n, seed=self.seed)
        x = (x.select(F.col(col).alias("embedding")) if weight is None else x.select(F.col(col).alias("embedding"), weight.alias("w"))).persist()
        col = "embedding"
        if init is None:
            init = least_by_hash(x, self.k, self.seed)
        c = np.array(init, dtype=np.float64)
        frozen, self.stats = 0, []
        if self.frozen is not None:
            frozen = len(self.frozen)
            c = np.concatenate([self.frozen, c])[: self.k]
        first = 0
        if checkpoint:
            version = digest(self.k, self.seed, self.spherical, self.int_centroids, frozen, c.tolist(), table_version(x))
            about = read_manifest(x.sparkSession, checkpoint) or {}
            if about.get("version") == version and about["round"] <= self.niter:
                first, c, self.stats = about["round"], np.array(about["centroids"]), about["stats"]
        for r in range(first, self.niter):
            if self.stats and self.stats[-1]["moved"] == 0.0:
                break
            new = c.copy()
            if c.size <= SUMS:
                ((w, n, sums),) = lloyd_sums(x, [c], self.spherical)
            else:
                w, n, sums = np.zeros(len(c)), np.zeros(len(c)), np.zeros(c.shape)
                for row in centroid_sums(assign(x, c, self.spherical), c.shape[1], None if weight is None else F.col("w")).collect():  # k rows
                    w[row["list_no"]], n[row["list_no"]], sums[row["list_no"]] = row["w"], row["n"], row[3:]
            own = (w > 0) & (np.arange(len(c)) >= frozen)
            new[own] = sums[own] / w[own, None]
            splits = self.split(new, n, frozen)
            if self.spherical:
                new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-30)
            if self.int_centroids:
                new = np.rint(new)
            self.stats.append({"imbalance": float(len(n) * (n * n).sum() / max(n.sum(), 1) ** 2), "nsplit": splits, "moved": float(np.abs(new - c).max())})
            c = new
            if checkpoint:
                write_manifest(x.sparkSession, checkpoint, {"version": version, "round": r + 1, "centroids": c.tolist(), "stats": self.stats})
        x.unpersist()
        return c

    def split(self, c: np.ndarray, n: np.ndarray, frozen: int, eps: float = 1 / 1024) -> int:
        rng, done = np.random.default_rng(self.seed), 0
        for e in np.flatnonzero(n == 0):
            p = np.maximum(n - 1, 0)
            if e < frozen or not p.sum():
                continue
            big = int(rng.choice(len(n), p=p / p.sum()))
            sign = np.where(np.arange(c.shape[1]) % 2 == 0, 1, -1) * eps
            c[e], c[big] = c[big] * (1 + sign), c[big] * (1 - sign)
            n[e] = n[big] / 2
            n[big] -= n[e]
            done += 1
        return done


def progressive_kmeans(vectors: DataFrame, k: int, steps: int = 3, niter: int = 4) -> np.ndarray:
    """k-means on growing numbers of leading dimensions, each starting from the last."""
    d = vectors.select(F.size("embedding")).first()[0]
    c = None
    for s in range(1, steps + 1):
        w = d if s == steps else max(1, d * s // steps)
        part = vectors.select(F.slice("embedding", 1, w).alias("embedding"))
        if c is not None:
            c = np.concatenate([c, np.zeros((len(c), w - c.shape[1]))], axis=1)
        c = KMeans(k, niter).fit(part, init=c)
    return c


def kmeans_1d(values: np.ndarray, k: int) -> np.ndarray:
    """Exact one-dimensional k-means of values on the driver (a column's quantiles, say): dynamic programming over sorted
    values, each layer filled by divide and conquer, as the best split moves right with the end."""
    x = np.sort(np.asarray(values, dtype=np.float64))
    n = len(x)
    s, q = np.concatenate(([0.0], x.cumsum())), np.concatenate(([0.0], (x * x).cumsum()))
    cost = lambda i, j: q[j] - q[i] - (s[j] - s[i]) ** 2 / np.maximum(j - i, 1)
    best = cost(np.zeros(n + 1, int), np.arange(n + 1))
    back = [np.zeros(n + 1, int)]
    for _ in range(1, min(k, n)):
        new, cut = np.full(n + 1, np.inf), np.zeros(n + 1, int)
        todo = [(0, n, 0, n)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            i = np.arange(a, min(b, mid) + 1)
            v = best[i] + cost(i, mid)
            at = int(v.argmin())
            new[mid], cut[mid] = v[at], i[at]
            todo += [(lo, mid - 1, a, i[at]), (mid + 1, hi, i[at], b)]
        best = new
        back.append(cut)
    ends, j = [n], n
    for cut in reversed(back[1:]):
        j = int(cut[j])
        ends.append(j)
    ends = sorted({0, *ends})
    return np.array([x[a:b].mean() for a, b in zip(ends, ends[1:], strict=False)])


def list_sizes(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("list_no").agg(F.count("*").alias("n"))


def imbalance(assigned: DataFrame, col: str = "list_no") -> DataFrame:
    """k * sum of squared sizes over the squared total."""
    n = assigned.groupBy(col).agg(F.count("*").alias("n"))
    return n.agg(F.round(F.count("*") * F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n")), 6).alias("imbalance"))


def matrix_stats(vectors: DataFrame, d: int) -> DataFrame:
    """Count, extremes, mean, deviation, zeros and NaNs of each dimension: one aggregate, whose row is then unfolded."""
    x = doubles(F.col("embedding"))
    ok = lambda i: F.when(~F.isnan(x[i]), x[i])
    each = [F.struct(F.lit(i).alias("dim"), F.count(ok(i)).alias("n"), F.round(F.min(ok(i)), 6).alias("min"), F.round(F.max(ok(i)), 6).alias("max"), F.round(F.avg(ok(i)), 6).alias("mean"), F.round(F.stddev_pop(ok(i)), 6).alias("std"), F.count_if(x[i] == 0).alias("n_zero"), F.count_if(F.isnan(x[i])).alias("n_nan")).alias(f"d{i}") for i in range(d)]
    return vectors.agg(*each).select(F.explode(F.array(*[F.col(f"d{i}") for i in range(d)])).alias("s")).select("s.*")


def duplicate_rows(vectors: DataFrame) -> DataFrame:
    n = vectors.groupBy("embedding").agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("n_distinct"), F.sum(F.when(F.col("n") > 1, F.col("n") - 1).otherwise(0)).alias("n_repeats"))


def histogram(df: DataFrame, col: str, lo: float, hi: float, bins: int) -> DataFrame:
    at = F.least(F.greatest(F.floor((F.col(col) - lo) / ((hi - lo) / bins)), F.lit(0)), F.lit(bins - 1))
    return df.select(at.cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
