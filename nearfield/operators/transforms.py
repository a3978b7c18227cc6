"""Vector transforms: fitted on aggregates, applied as maps that carry a matrix."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.operators.sums import add_up


def moments(vectors: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, sums and the d x d matrix of products of all vectors: each task sends one row, not its vectors."""

    def totals(batches):
        t = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column(0).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(batch.num_rows, -1)
            t = np.concatenate(([len(x)], x.sum(0), (x.T @ x).ravel())) + (0 if t is None else t)
        return t

    t = add_up(vectors.select("embedding"), totals)
    if t is None:
        raise ValueError("no vectors to fit on")
    d = int((len(t) - 1) ** 0.5)  # 1 + d + d * d numbers
    return int(t[0]), t[1 : d + 1], t[d + 1 :].reshape(d, d)


def map_vectors(vectors: DataFrame, f) -> DataFrame:
    """vectors with `embedding` replaced by rows of f(matrix)."""
    from pyspark.sql import types as T

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            i = batch.schema.get_field_index("embedding")
            if not batch.num_rows:
                continue
            y = f(np.asarray(batch.column(i).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(batch.num_rows, -1))
            cols = list(batch.columns)
            cols[i] = pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(y, dtype=np.float32).ravel()), y.shape[1]).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays(cols, batch.schema.names)

    schema = T.StructType([T.StructField(x.name, T.ArrayType(T.FloatType()) if x.name == "embedding" else x.dataType) for x in vectors.schema.fields])
    return vectors.mapInArrow(run, schema)


@dataclass
class Linear:
    """y = A x + b."""

    a: np.ndarray
    b: np.ndarray | float = 0.0

    def apply(self, vectors: DataFrame) -> DataFrame:
        a, b = self.a, self.b
        return map_vectors(vectors, lambda x: x @ a.T + b)

    def reverse(self, vectors: DataFrame) -> DataFrame:
        """The inverse for orthonormal rows, else the least-squares one."""
        a, b = np.linalg.pinv(self.a), self.b
        return map_vectors(vectors, lambda y: (y - b) @ a.T)


def random_rotation(d_in: int, d_out: int, seed: int = 1234) -> Linear:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((max(d_in, d_out), max(d_in, d_out))))
    return Linear((q * np.sign(np.diag(r)))[:d_out, :d_in])


def centering(vectors: DataFrame) -> Linear:
    n, s, _ = moments(vectors)
    return Linear(np.eye(len(s)), -s / max(n, 1))


def pca(vectors: DataFrame, d_out: int, eigen_power: float = 0.0, rotate: bool = False) -> Linear:
    """Centred projection on the leading eigenvectors; eigen_power -0.5 whitens; rotate spreads the variance."""
    n, s, p = moments(vectors)
    mean = s / max(n, 1)
    w, v = np.linalg.eigh(p / max(n, 1) - np.outer(mean, mean))
    order = np.argsort(-w)[:d_out]
    v = v[:, order] * np.sign(v[np.abs(v[:, order]).argmax(0), order])
    a = v.T * (np.maximum(w[order], 1e-12) ** eigen_power)[:, None]
    if rotate:
        a = random_rotation(d_out, d_out).a @ a
    return Linear(a, -a @ mean)


def remap(vectors: DataFrame, places: list[int]) -> DataFrame:
    """Components by place; -1 is 0."""
    return vectors.withColumn("embedding", F.array(*[F.lit(0.0).cast("float") if i < 0 else F.col("embedding")[i] for i in places]))


def normalization(vectors: DataFrame) -> DataFrame:
    return map_vectors(vectors, lambda x: x / np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) > 0, n, 1))


def itq(vectors: DataFrame, bits: int, niter: int = 10, seed: int = 1234) -> Linear:
    """PCA to `bits` dimensions, then the rotation that brings components near to +-1: each round adds up X^T sign(X R)
    in the tasks and solves a Procrustes problem of bits x bits on the driver."""
    first = pca(vectors, bits)
    x = first.apply(vectors.select("embedding")).persist()
    r = random_rotation(bits, bits, seed).a
    for _ in range(niter):
        u, _, v = np.linalg.svd(_products(x, lambda m, r=r: np.sign(m @ r)))
        r = u @ v
    x.unpersist()
    return Linear(r.T @ first.a, r.T @ first.b)


def _products(x: DataFrame, f) -> np.ndarray:
    """The sum of x^T f(x) over all rows."""

    def totals(batches):
        p = None
        for batch in batches:
            if batch.num_rows:
                m = np.asarray(batch.column(0).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(batch.num_rows, -1)
                p = (m.T @ f(m)).ravel() + (0 if p is None else p)
        return p

    p = add_up(x.select("embedding"), totals)
    d = int(len(p) ** 0.5)
    return p.reshape(d, d)


def opq(vectors: DataFrame, m: int, nbits: int = 4, niter: int = 4, seed: int = 1234) -> Linear:
    """A rotation under which a product quantiser of m parts loses little: rounds of quantising and Procrustes."""
    from nearfield.operators.quantize import ProductQuantizer

    d = vectors.select(F.size("embedding")).first()[0]
    r = random_rotation(d, d, seed).a
    x = vectors.select("embedding").persist()
    for _ in range(niter):
        pq = ProductQuantizer(m, nbits).fit(map_vectors(x, lambda v, r=r: v @ r.T), niter=3)
        u, _, v = np.linalg.svd(_products(x, lambda v, r=r, pq=pq: pq.decode(pq.encode(v @ r.T))))
        r = (u @ v).T
    x.unpersist()
    return Linear(r)


@dataclass
class Chain:
    """Transforms one after another."""

    steps: list = field(default_factory=list)

    def apply(self, vectors: DataFrame) -> DataFrame:
        for s in self.steps:
            vectors = s.apply(vectors) if hasattr(s, "apply") else s(vectors)
        return vectors
