"""Product codes that are compared bit by bit before any table is looked up."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.operators.quantize import Codec, ProductQuantizer
from nearfield.operators.search import _each


@dataclass
class Polysemous(Codec):
    """A product quantiser whose codes are near in bits where their centroids are near: numbers of centroids are dealt by
    ProductQuantizer.reorder(). A search skips codes that differ from the query's own code in more than `most` bits; only
    those left are scored by tables of distances. most: from threshold()."""

    pq: ProductQuantizer
    most: int = 0

    def fit(self, vectors: DataFrame, niter: int = 8) -> Polysemous:
        self.pq.fit(vectors, niter).reorder()
        return self

    def encode(self, x: np.ndarray) -> np.ndarray:
        return self.pq.encode(x)

    def decode(self, c: np.ndarray) -> np.ndarray:
        return self.pq.decode(c)

    def differing(self, q: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """(queries, codes) bits that differ."""
        own = self.pq.encode(q)
        return sum(np.bitwise_count(own[:, None, j] ^ codes[None, :, j]).astype(np.int64) for j in range(self.pq.m))

    def distances(self, q: np.ndarray, codes: np.ndarray, no: int = 0) -> np.ndarray:
        """(queries, codes) distances by tables; not a number where a code is skipped, which no search returns."""
        out = np.full((len(q), len(codes)), np.nan)
        i, j = np.nonzero(self.differing(q, codes) <= self.most)
        tables = self.pq.tables(q)
        out[i, j] = sum(tables[i, part, codes[j, part]] for part in range(self.pq.m))
        return out


def _codes(codec: Polysemous, rows: DataFrame, vector: str, name: str, to: str) -> DataFrame:
    return codec.encode_table(rows.select(F.col(name), F.col(vector).alias("embedding"))).withColumnRenamed("code", to)


def _bits(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def histogram(codec: Polysemous, queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """(bits, n): how many pairs of a stated query set and all vectors differ in so many bits of their codes. Queries are
    broadcast in blocks of checked size; what is shuffled are counts."""
    q, v = _codes(codec, queries, "q", "query_id", "qc"), _codes(codec, vectors, "embedding", "vec_id", "vc")
    return _each(q, v, _bits("qc", "vc"), codec.pq.m).groupBy(F.col("distance").alias("bits")).agg(F.count("*").alias("n"))


def threshold(codec: Polysemous, queries: DataFrame, vectors: DataFrame, truth: DataFrame, recall: float = 0.95) -> int:
    """The fewest bits within which a share `recall` of true pairs (query_id, vec_id) are: read off the histogram of their
    codes, of which there are as many rows as bits. Without pairs all bits."""
    q, v = _codes(codec, queries, "q", "query_id", "qc"), _codes(codec, vectors, "embedding", "vec_id", "vc")
    pairs = truth.select("query_id", "vec_id").join(q, "query_id").join(v, "vec_id")
    rows = sorted(pairs.groupBy(_bits("qc", "vc").alias("bits")).count().collect())
    total, held = sum(r[1] for r in rows), 0
    for bits, n in rows:
        held += n
        if held >= recall * total:
            return int(bits)
    return codec.pq.m * codec.pq.nbits
