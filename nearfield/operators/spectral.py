"""Spectral hash over inverted lists: sinusoid bits of projections, with thresholds of each list."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.operators.cluster import KMeans, assign
from nearfield.operators.ivf import IVF
from nearfield.operators.quantize import Codec
from nearfield.operators.search import rerank
from nearfield.operators.transforms import Linear, map_vectors, pca


@dataclass
class SpectralBits(Codec):
    """Bit i of a vector in a list: whether floor((y - t) * 2 / period) is odd, for its i-th projection y and the list's
    threshold t. Codes are words of 32 bits, the lowest bit first."""

    projection: Linear
    period: float
    thresholds: np.ndarray  # (nlist, bits)

    def words(self, x: np.ndarray, no: np.ndarray | int) -> np.ndarray:
        y = x @ np.asarray(self.projection.a).T + self.projection.b
        bits = (np.floor((y - self.thresholds[no]) * (2.0 / self.period)).astype(np.int64) & 1).astype(np.uint8)
        padded = np.zeros((len(x), -(-bits.shape[1] // 32) * 32), np.uint8)
        padded[:, : bits.shape[1]] = bits
        return np.packbits(padded, axis=1, bitorder="little").view("<u4").astype(np.int64)

    def distances(self, q: np.ndarray, codes: np.ndarray, no: int) -> np.ndarray:
        """(queries, codes) bits that differ, the queries' bits being those of the list."""
        own = self.words(q, no)
        return sum(np.bitwise_count(own[:, None, j] ^ codes[None, :, j]) for j in range(own.shape[1])).astype(np.float64)


@dataclass
class SpectralIVF:
    """An inverted file of spectral codes, ranked by Hamming distance; refine() ranks a shortlist by exact distance.

    threshold: where a bit flips, in each list: "global" (0), "centroid" (the list's projected centroid), "half" (a quarter
    of a period below it, so that the centroid is in the middle of a stretch), or "median" (of each projection over the
    list's training rows, by quantile sketches that are merged, a row for each list).
    """

    nlist: int
    bits: int
    period: float
    threshold: str = "half"
    index: IVF | None = None

    def fit(self, vectors: DataFrame, niter: int = 8, centroids: np.ndarray | None = None, projection: Linear | None = None) -> SpectralIVF:
        c = KMeans(self.nlist, niter).fit(vectors) if centroids is None else np.asarray(centroids, dtype=np.float64)
        p = pca(vectors, self.bits) if projection is None else projection
        t = np.zeros((len(c), self.bits))
        if self.threshold in ("centroid", "half"):
            t = c @ np.asarray(p.a).T + p.b - (self.period / 4 if self.threshold == "half" else 0.0)
        elif self.threshold == "median":
            rows = map_vectors(assign(vectors.select("embedding"), c).select("list_no", "embedding"), lambda x: x @ np.asarray(p.a).T + p.b)
            for r in rows.groupBy("list_no").agg(*[F.percentile_approx(F.col("embedding")[i], 0.5, 1000) for i in range(self.bits)]).collect():  # nlist rows
                t[r[0]] = r[1:]
        elif self.threshold != "global":
            raise ValueError(f"no threshold is called {self.threshold}")
        self.index = IVF(len(c), codec=SpectralBits(p, self.period, t), centroids=c)
        return self

    def add(self, vectors: DataFrame) -> SpectralIVF:
        codec = self.index.codec

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for b in batches:
                if b.num_rows:
                    x = np.asarray(b.column(2).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(b.num_rows, -1)
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(codec.words(x, b.column(0).to_numpy()).tolist(), pa.list_(pa.int64()))], ["list_no", "vec_id", "code"])

        rows = assign(vectors.where("embedding is not null").select("vec_id", "embedding"), self.index.centroids).select("list_no", "vec_id", "embedding")
        new = rows.mapInArrow(run, "list_no int, vec_id long, code array<long>")
        self.index.lists = new if self.index.lists is None else self.index.lists.unionByName(new)
        return self

    def search(self, queries: DataFrame, k: int, nprobe: int = 8) -> DataFrame:
        """(query_id, rank, vec_id, distance): distance is the number of bits that differ."""
        return self.index.search(queries, k, nprobe)

    def refine(self, queries: DataFrame, vectors: DataFrame, k: int, shortlist: int, nprobe: int = 8) -> DataFrame:
        return rerank(self.search(queries, shortlist, nprobe), queries, vectors, k)
