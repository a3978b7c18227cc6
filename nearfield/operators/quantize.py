"""Quantisers: fitted on aggregates or k-means of slices; encode and decode are NumPy on batches."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.functions.vectors import doubles
from nearfield.operators.cluster import KMeans, lloyd_sums
from nearfield.operators.sums import add_up, least_by_hash


class Codec:
    """encode(n x d floats) -> n x code integers; decode back."""

    def encode_table(self, vectors: DataFrame) -> DataFrame:
        """vectors' columns with `code` in the place of the vector."""
        from pyspark.sql import types as T

        codec = self

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                if not batch.num_rows:
                    continue
                i = batch.schema.get_field_index("embedding")
                x = np.asarray(batch.column(i).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(batch.num_rows, -1)
                cols, names = list(batch.columns), list(batch.schema.names)
                cols[i], names[i] = pa.array(codec.encode(x).astype(np.int32).tolist(), pa.list_(pa.int32())), "code"
                yield pa.RecordBatch.from_arrays(cols, names)

        schema = T.StructType([T.StructField("code", T.ArrayType(T.IntegerType())) if f.name == "embedding" else f for f in vectors.schema.fields])
        return vectors.mapInArrow(run, schema)

    def decode_table(self, codes: DataFrame) -> DataFrame:
        from pyspark.sql import types as T

        codec = self

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                if not batch.num_rows:
                    continue
                i = batch.schema.get_field_index("code")
                y = codec.decode(np.array(batch.column(i).to_pylist()))
                cols, names = list(batch.columns), list(batch.schema.names)
                cols[i], names[i] = pa.array(y.astype(np.float32).tolist(), pa.list_(pa.float32())), "embedding"
                yield pa.RecordBatch.from_arrays(cols, names)

        schema = T.StructType([T.StructField("embedding", T.ArrayType(T.FloatType())) if f.name == "code" else f for f in codes.schema.fields])
        return codes.mapInArrow(run, schema)

    def error(self, x: np.ndarray) -> float:
        return float(((x - self.decode(self.encode(x))) ** 2).sum(1).mean())


@dataclass
class ScalarQuantizer(Codec):
    """kind: 8bit, 6bit, 4bit (a range for each dimension), 8bit_uniform, 4bit_uniform (one range), 8bit_direct, fp16, bf16.
    spread: minmax, meanstd, quantiles (of the training set)."""

    kind: str = "8bit"
    spread: str = "minmax"
    arg: float = 0.0
    lo: np.ndarray = field(default_factory=lambda: np.zeros(1))
    width: np.ndarray = field(default_factory=lambda: np.ones(1))

    @property
    def bits(self) -> int:
        return 16 if self.kind in ("fp16", "bf16") else int(self.kind.split("bit")[0])

    def fit(self, vectors: DataFrame) -> ScalarQuantizer:
        if self.kind in ("fp16", "bf16", "8bit_direct"):
            return self
        d = vectors.select(F.size("embedding")).first()[0]
        x = doubles(F.col("embedding"))
        if self.spread == "meanstd":
            s = vectors.agg(*[F.avg(x[i]) for i in range(d)], *[F.stddev_pop(x[i]) for i in range(d)]).first()
            m, w = np.array(s[:d]), np.array(s[d:]) * (self.arg or 2.0)
            lo, hi = m - w, m + w
        elif self.spread == "quantiles":
            p = self.arg or 0.01
            s = vectors.agg(*[F.percentile_approx(x[i], [p, 1 - p], 10_000) for i in range(d)]).first()
            lo, hi = np.array([v[0] for v in s]), np.array([v[1] for v in s])
        else:
            s = vectors.agg(*[F.min(x[i]) for i in range(d)], *[F.max(x[i]) for i in range(d)]).first()
            lo, hi = np.array(s[:d]), np.array(s[d:])
            lo, hi = lo - (hi - lo) * self.arg, hi + (hi - lo) * self.arg
        if self.kind.endswith("uniform"):
            lo, hi = np.full(d, lo.min()), np.full(d, hi.max())
        self.lo, self.width = lo, np.where(hi > lo, hi - lo, 1.0)
        return self

    def encode(self, x: np.ndarray) -> np.ndarray:
        if self.kind == "fp16":
            return x.astype(np.float16).view(np.uint16).astype(np.int32)
        if self.kind == "bf16":
            return (x.astype(np.float32).view(np.uint32) >> 16).astype(np.int32)
        top = (1 << self.bits) - 1
        if self.kind == "8bit_direct":
            return np.clip(np.floor(x), 0, top).astype(np.int32)
        return np.clip(np.floor((x - self.lo) / self.width * (top + 1)), 0, top).astype(np.int32)

    def decode(self, c: np.ndarray) -> np.ndarray:
        if self.kind == "fp16":
            return c.astype(np.uint16).view(np.float16).astype(np.float64)
        if self.kind == "bf16":
            return (c.astype(np.uint32) << 16).view(np.float32).astype(np.float64)
        if self.kind == "8bit_direct":
            return c.astype(np.float64)
        return self.lo + (c + 0.5) / (1 << self.bits) * self.width


@dataclass
class ProductQuantizer(Codec):
    """m parts of the dimensions, each with 2**nbits centroids."""

    m: int
    nbits: int = 8
    books: np.ndarray | None = None  # (m, ksub, dsub)

    def fit(self, vectors: DataFrame, niter: int = 8) -> ProductQuantizer:
        """k-means of all slices at once, a map a round, from the vectors of least hash."""
        x = vectors.select("embedding").persist()
        k = 1 << self.nbits
        start = least_by_hash(x, k)
        books = np.split(start, self.m, axis=1)
        helper = KMeans(k)
        for _ in range(niter):
            for j, (_w, n, sums) in enumerate(lloyd_sums(x, books)):
                books[j] = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], books[j])
                helper.split(books[j], n.copy(), 0)
        x.unpersist()
        far = np.full((k - len(start), start.shape[1] // self.m), 1e15)  # fewer distinct vectors than centroids
        self.books = np.stack([np.concatenate([c, far]) for c in books])
        return self

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(n, m, ksub) squared distances of each query's parts to the centroids."""
        p = q.reshape(len(q), self.m, -1)
        return ((p[:, :, None, :] - self.books[None]) ** 2).sum(3)

    def encode(self, x: np.ndarray) -> np.ndarray:
        p = x.reshape(len(x), self.m, -1)
        return np.stack([((c * c).sum(1)[None] - 2 * p[:, j] @ c.T).argmin(1) for j, c in enumerate(self.books)], axis=1)

    def decode(self, c: np.ndarray) -> np.ndarray:
        return np.concatenate([self.books[j][c[:, j]] for j in range(self.m)], axis=1)

    def adc(self, q: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """(queries, codes) distances of queries to decoded vectors."""
        t = self.tables(q)
        return sum(t[:, j, :][:, codes[:, j]] for j in range(self.m))

    def sdc(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distances between two sets of codes by tables of centroid pairs."""
        pair = ((self.books[:, :, None, :] - self.books[:, None, :, :]) ** 2).sum(3)
        return sum(pair[j][a[:, j]][:, b[:, j]] for j in range(self.m))

    def reorder(self, seed: int = 1234, steps: int = 2000) -> ProductQuantizer:
        """Polysemous order: simulated annealing of each part's numbering, so that Hamming distances of codes follow the
        centroids' distances."""
        rng, k = np.random.default_rng(seed), 1 << self.nbits
        ham = np.array([[bin(a ^ b).count("1") for b in range(k)] for a in range(k)], dtype=float)
        for j, c in enumerate(self.books):
            d = ((c[:, None] - c[None]) ** 2).sum(2)
            goal = d / max(d.mean(), 1e-30) * ham.mean()
            perm, heat = np.arange(k), 0.7
            row = lambda p, i: ((ham[i] - goal[p[i]][p]) ** 2).sum()
            for _ in range(steps):
                a, b = rng.integers(0, k, 2)
                before = row(perm, a) + row(perm, b)
                perm[[a, b]] = perm[[b, a]]
                if row(perm, a) + row(perm, b) > before and rng.random() > heat * 0.1:
                    perm[[a, b]] = perm[[b, a]]
                heat *= 0.998
            self.books[j] = c[perm]
        return self


@dataclass
class ResidualQuantizer(Codec):
    """Sums of one row from each of m codebooks, found by beam search; books are k-means of residuals."""

    m: int
    nbits: int = 4
    beam: int = 4
    books: list[np.ndarray] = field(default_factory=list)

    def fit(self, vectors: DataFrame, niter: int = 8) -> ResidualQuantizer:
        from nearfield.operators.transforms import map_vectors

        self.books, x = [], vectors.select("embedding")
        for _ in range(self.m):
            part = ResidualQuantizer(len(self.books), self.nbits, self.beam, list(self.books))
            rest = x if not part.books else map_vectors(x, lambda v, part=part: v - part.decode(part.encode(v)))
            self.books.append(KMeans(1 << self.nbits, niter).fit(rest))
        return self

    def encode(self, x: np.ndarray) -> np.ndarray:
        n = len(x)
        codes, rest = np.zeros((n, 1, 0), dtype=int), x[:, None, :]
        for book in self.books:
            d = (rest * rest).sum(2)[:, :, None] + (book * book).sum(1)[None, None] - 2 * rest @ book.T
            k, flat = len(book), d.reshape(n, -1)
            best = np.argsort(flat, axis=1, kind="stable")[:, : self.beam]
            at, sym = best // k, best % k
            codes = np.concatenate([np.take_along_axis(codes, at[:, :, None], 1), sym[:, :, None]], axis=2)
            rest = np.take_along_axis(rest, at[:, :, None], 1) - book[sym]
        return codes[:, 0]

    def decode(self, c: np.ndarray) -> np.ndarray:
        return sum(b[c[:, j]] for j, b in enumerate(self.books))


@dataclass
class LocalSearchQuantizer(Codec):
    """Additive codes by iterated conditional modes with perturbation, starting from a residual quantiser's; codebooks by
    least squares on sums of code incidences."""

    m: int
    nbits: int = 4
    rounds: int = 4
    seed: int = 1234
    books: list[np.ndarray] = field(default_factory=list)

    def fit(self, vectors: DataFrame, niter: int = 2) -> LocalSearchQuantizer:
        self.books = ResidualQuantizer(self.m, self.nbits).fit(vectors, 4).books
        k = [len(b) for b in self.books]
        first = np.concatenate([[0], np.cumsum(k)])
        for _ in range(niter):
            codec = LocalSearchQuantizer(self.m, self.nbits, self.rounds, self.seed, list(self.books))

            def totals(batches, codec=codec):
                t = None
                for batch in batches:
                    if batch.num_rows:
                        x = np.asarray(batch.column(0).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(batch.num_rows, -1)
                        b = np.zeros((len(x), first[-1]))
                        b[np.arange(len(x))[:, None], codec.encode(x) + first[:-1]] = 1
                        t = np.concatenate(((b.T @ b).ravel(), (b.T @ x).ravel())) + (0 if t is None else t)
                return t

            g, h = np.split(add_up(vectors.select("embedding"), totals), [first[-1] ** 2])
            g, h = g.reshape(first[-1], -1), h.reshape(first[-1], -1)
            c = np.linalg.solve(g + 1e-3 * np.eye(len(g)), h)
            self.books = [c[a:b] for a, b in zip(first, first[1:], strict=False)]
        return self

    def encode(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(self.seed)
        best = ResidualQuantizer(self.m, self.nbits, 2, self.books).encode(x)
        loss = ((x - self.decode(best)) ** 2).sum(1)
        for _ in range(self.rounds):
            c = best.copy()
            j = rng.integers(0, self.m, len(x))
            c[np.arange(len(x)), j] = rng.integers(0, 1 << self.nbits, len(x)) % np.array([len(b) for b in self.books])[j]
            for i, book in enumerate(self.books):
                rest = x - self.decode(c) + book[c[:, i]]
                c[:, i] = ((book * book).sum(1)[None] - 2 * rest @ book.T).argmin(1)
            new = ((x - self.decode(c)) ** 2).sum(1)
            better = new < loss
            best[better], loss[better] = c[better], new[better]
        return best

    def decode(self, c: np.ndarray) -> np.ndarray:
        return sum(b[c[:, j]] for j, b in enumerate(self.books))


@dataclass
class ProductAdditive(Codec):
    """A quantiser of its own for each of `parts` slices of the dimensions."""

    parts: list[Codec]

    def fit(self, vectors: DataFrame) -> ProductAdditive:
        w = vectors.select(F.size("embedding")).first()[0] // len(self.parts)
        for j, p in enumerate(self.parts):
            p.fit(vectors.select(F.slice("embedding", j * w + 1, w).alias("embedding")))
        return self

    def encode(self, x: np.ndarray) -> np.ndarray:
        w = x.shape[1] // len(self.parts)
        return np.concatenate([p.encode(x[:, j * w : (j + 1) * w]) for j, p in enumerate(self.parts)], axis=1)

    def decode(self, c: np.ndarray) -> np.ndarray:
        w = c.shape[1] // len(self.parts)
        return np.concatenate([p.decode(c[:, j * w : (j + 1) * w]) for j, p in enumerate(self.parts)], axis=1)


@dataclass
class RowMinMax(Codec):
    """Each row scaled to 0..1 by its own extremes before the inner codec; the extremes are kept as two float32 words."""

    inner: Codec

    def fit(self, vectors: DataFrame) -> RowMinMax:
        lo, hi = F.array_min("embedding"), F.array_max("embedding")
        self.inner.fit(vectors.withColumn("embedding", F.transform("embedding", lambda v: F.when(hi > lo, (v - lo) / F.nullif(hi - lo, F.lit(0.0))).otherwise(0.0).cast("float"))))
        return self

    def encode(self, x: np.ndarray) -> np.ndarray:
        lo, hi = x.min(1, keepdims=True), x.max(1, keepdims=True)
        head = np.concatenate([lo, hi], 1).astype(np.float32).view(np.int32)
        return np.concatenate([head, self.inner.encode((x - lo) / np.where(hi > lo, hi - lo, 1))], axis=1)

    def decode(self, c: np.ndarray) -> np.ndarray:
        head = np.ascontiguousarray(c[:, :2].astype(np.int32)).view(np.float32).astype(np.float64)
        return head[:, :1] + self.inner.decode(c[:, 2:]) * (head[:, 1:] - head[:, :1])


@dataclass
class SignHash(Codec):
    """Sign bits of the (rotated) vector less thresholds; thresholds are medians if trained."""

    bits: int
    rotation: np.ndarray | None = None
    thresholds: np.ndarray | float = 0.0

    def fit(self, vectors: DataFrame, rotate: bool = True, train: bool = False) -> SignHash:
        from nearfield.operators.transforms import map_vectors, random_rotation

        d = vectors.select(F.size("embedding")).first()[0]
        self.rotation = random_rotation(d, self.bits).a if rotate else np.eye(d)[: self.bits]
        if train:
            r = self.rotation
            x = map_vectors(vectors.select("embedding"), lambda v: v @ r.T)
            self.thresholds = np.array(x.agg(*[F.percentile_approx(F.col("embedding")[i], 0.5, 10_000) for i in range(self.bits)]).first())
        return self

    def encode(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.rotation.T >= self.thresholds).astype(np.int32)

    def decode(self, c: np.ndarray) -> np.ndarray:
        return (2.0 * c - 1) @ self.rotation


@dataclass
class SphereLattice(Codec):
    """Each slice of dimensions to the integer point of squared norm r2 that is nearest in direction, kept as its sorted
    absolute values' pattern, the order and the signs; the slice's norm is a scalar of its own."""

    slices: int
    r2: int = 14
    bits: int = 6
    top: float = 1.0

    def atoms(self, d: int) -> np.ndarray:
        """Non-increasing points of squared norm r2."""
        out = []

        def grow(left: int, most: int, head: tuple) -> None:
            if len(head) == d:
                if not left:
                    out.append(head)
                return
            for v in range(min(most, int(left**0.5)), -1, -1):
                grow(left - v * v, v, (*head, v))

        grow(self.r2, int(self.r2**0.5), ())
        return np.array(out, dtype=float)

    def fit(self, vectors: DataFrame) -> SphereLattice:
        self.top = float(vectors.agg(F.max(F.aggregate(doubles(F.col("embedding")), F.lit(0.0), lambda a, v: a + v * v))).first()[0]) ** 0.5
        return self

    def encode(self, x: np.ndarray) -> np.ndarray:
        p = x.reshape(len(x), self.slices, -1)
        d = p.shape[2]
        order = np.argsort(-np.abs(p), axis=2, kind="stable")
        best = (np.take_along_axis(np.abs(p), order, 2) @ self.atoms(d).T).argmax(2)
        norm = np.clip(np.rint(np.linalg.norm(p, axis=2) / self.top * ((1 << self.bits) - 1)), 0, (1 << self.bits) - 1).astype(int)
        return np.concatenate([norm[:, :, None], best[:, :, None], order, (p >= 0).astype(int)], axis=2).reshape(len(x), -1)

    def decode(self, c: np.ndarray) -> np.ndarray:
        p = c.reshape(len(c), self.slices, -1)
        d = (p.shape[2] - 2) // 2
        v = np.zeros((len(c), self.slices, d))
        np.put_along_axis(v, p[:, :, 2 : 2 + d], self.atoms(d)[p[:, :, 1]], 2)
        v *= np.where(p[:, :, 2 + d :] > 0, 1, -1) / self.r2**0.5
        return (v * (p[:, :, :1] / ((1 << self.bits) - 1) * self.top)).reshape(len(c), -1)
