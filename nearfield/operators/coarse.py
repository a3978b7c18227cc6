"""Lists without a table of centroids: named by additive codes, or by cells of a product of books."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfield.functions.vectors import metric
from nearfield.operators.descent import written
from nearfield.operators.ivf import IVF, probes
from nearfield.operators.manifest import read_manifest, write_manifest
from nearfield.operators.quantize import Codec, LocalSearchQuantizer, ResidualQuantizer
from nearfield.operators.search import _best, dimension, query_blocks


def code_number(codes: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    """Code sequences as one number each, the first book's code the highest digit."""
    out = np.zeros(len(codes), np.int64)
    for j, b in enumerate(books):
        out = out * len(b) + codes[:, j]
    return out


def nearest_sums(x: np.ndarray, books: list[np.ndarray], n: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, squared distances) of about the n nearest sums of one row of each book, for each row of x, nearest first.

    Books are taken one after another; of the partial sums the `beam` nearest go on, so with a beam of at least the
    number of all sums of the books but the last the result is exact. Ties go to the lower number.
    """
    numbers, sums = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1, x.shape[1]))
    for j, book in enumerate(books):
        rest = x[:, None, :] - sums
        d = (rest * rest).sum(2)[:, :, None] + (book * book).sum(1)[None, None] - 2 * rest @ book.T
        flat, no = np.round(d.reshape(len(x), -1), 9), (numbers[:, :, None] * len(book) + np.arange(len(book))).reshape(len(x), -1)
        keep = min(n if j == len(books) - 1 else max(beam, n), flat.shape[1])
        at = np.lexsort((no, flat), axis=1)[:, :keep]
        numbers, dist = np.take_along_axis(no, at, 1), np.take_along_axis(flat, at, 1)
        sums = np.take_along_axis(sums, (at // len(book))[:, :, None], 1) + book[at % len(book)]
    return numbers, np.maximum(dist, 0)


@dataclass
class AdditiveIVF(IVF):
    """An inverted file whose lists are sums of one row of each of several books: len(book) ** m lists from m books.

    A vector is in the list of its nearest sum, a query probes its nearest sums; both are found by a beam over the books,
    so no table of centroids is made, sent or read, and most lists may be empty. kind: "residual" or "local" (books of a
    residual or a local-search quantiser). Search, range search, save, removal and the rest are those of IVF; by_residual
    isn't, as its lists have no centroids.
    """

    books: list[np.ndarray] = field(default_factory=list)
    beam: int = 16

    def fit(self, vectors: DataFrame, m: int = 2, nbits: int = 4, niter: int = 8, kind: str = "residual") -> AdditiveIVF:
        maker = {"residual": ResidualQuantizer, "local": LocalSearchQuantizer}[kind]
        self.books = [np.asarray(b, dtype=np.float64) for b in maker(m, nbits).fit(vectors, niter).books]
        self.nlist = int(np.prod([len(b) for b in self.books]))
        if self.nlist >= 1 << 31:
            raise ValueError(f"{self.nlist} lists are too many for their number")
        if self.codec is not None:
            self.codec.fit(vectors)
        return self

    def _nearest(self, rows: DataFrame, col: int, n: int, schema: str, names: list[str]) -> DataFrame:
        sent = rows.sparkSession.sparkContext.broadcast((self.books, self.beam))

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            books, beam = sent.value
            for batch in batches:
                # a slice's partial sums have some 64 MB
                step = max(1, (8 << 20) // max(1, books[0].shape[1] * max(beam, n) * max(len(b) for b in books)))
                for a in range(0, batch.num_rows, step):
                    part = batch.slice(a, step)
                    x = np.asarray(part.column(col).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(part.num_rows, -1)
                    no, d = nearest_sums(x, books, n, beam)
                    k = no.shape[1]
                    own = part.take(pa.array(np.repeat(np.arange(part.num_rows), k)))
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(no.ravel().astype(np.int32)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), part.num_rows)), pa.array(d.ravel())], names)

        return rows.mapInArrow(run, schema)

    def assign(self, vectors: DataFrame) -> DataFrame:
        rows = vectors.select("vec_id", "embedding")
        kind = rows.schema["embedding"].dataType.simpleString()
        found = self._nearest(rows, 1, 1, f"vec_id long, embedding {kind}, list_no int, probe int, coarse double", ["vec_id", "embedding", "list_no", "probe", "coarse"])
        return found.select("list_no", "vec_id", "embedding")

    def probes(self, queries: DataFrame, nprobe: int) -> DataFrame:
        kind = queries.schema["q"].dataType.simpleString()
        return self._nearest(queries.select("query_id", "q"), 1, nprobe, f"query_id long, q {kind}, list_no int, probe int, coarse double", ["query_id", "q", "list_no", "probe", "coarse"])

    def search(self, queries: DataFrame, k: int, nprobe: int = 8, max_codes: int | None = None) -> DataFrame:
        return self.search_assigned(self.probes(queries, nprobe), k, max_codes)

    def range_search(self, queries: DataFrame, radius: float, nprobe: int = 8) -> DataFrame:
        return self.scan(self.probes(queries, nprobe), radius=radius)

    def save(self, path: str) -> None:
        super().save(path)
        write_manifest(self.lists.sparkSession, f"{path}/books", {"books": [b.tolist() for b in self.books], "beam": self.beam})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> AdditiveIVF:
        out, own = super().load(spark, path), read_manifest(spark, f"{path}/books")
        out.books, out.beam = [np.array(b) for b in own["books"]], own["beam"]
        return out


@dataclass
class MultiIndex:
    """Lists by the cells of a product: a vector's parts each have a nearest row in that part's book, and the rows' numbers
    together name its cell. Most cells are empty and have no rows anywhere.

    A query walks the cells by rising summed distance until those walked hold `budget` rows; the last one is whole.
    """

    books: np.ndarray  # (m, ksub, dsub)
    codec: Codec | None = None
    lists: DataFrame | None = None

    @classmethod
    def fit(cls, vectors: DataFrame, m: int = 2, nbits: int = 4, niter: int = 8) -> MultiIndex:
        from nearfield.operators.quantize import ProductQuantizer

        return cls(ProductQuantizer(m, nbits).fit(vectors, niter).books)

    def add(self, vectors: DataFrame) -> MultiIndex:
        from nearfield.operators.cluster import assign

        m, ksub, w = self.books.shape
        out = vectors.select("vec_id", "embedding", F.lit(0).cast("long").alias("cell"))
        for j in range(m):
            part = out.select("vec_id", F.col("embedding").alias("whole"), "cell", F.slice("embedding", j * w + 1, w).alias("embedding"))
            out = assign(part, self.books[j]).select("vec_id", F.col("whole").alias("embedding"), (F.col("cell") * ksub + F.col("list_no")).alias("cell"))
        self.lists = out if self.lists is None else self.lists.unionByName(out)
        return self

    def cells(self, queries: DataFrame, n: int) -> DataFrame:
        """(query_id, q, cell, distance, rank): each query's n nearest cells. Of each part's rows the n nearest are enough,
        and after each part the n least sums go on, so no more than n * ksub sums a query are looked at."""
        m, ksub, w = self.books.shape
        out = None
        for j in range(m):
            part = probes(queries.select("query_id", F.slice("q", j * w + 1, w).alias("q")), self.books[j], min(n, ksub)).select("query_id", F.col("list_no").cast("long").alias("c"), "coarse")
            if out is None:
                out = part.select("query_id", F.col("c").alias("cell"), F.col("coarse").alias("distance"))
            else:
                out = out.join(part, "query_id").select("query_id", (F.col("cell") * ksub + F.col("c")).alias("cell"), (F.col("distance") + F.col("coarse")).alias("distance"))
            rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("distance", 9), "cell"))
            out = out.withColumn("rank", rank).where(F.col("rank") <= n)
        return out.join(queries.select("query_id", "q"), "query_id").select("query_id", "q", "cell", F.round("distance", 6).alias("distance"), "rank")

    def walk(self, queries: DataFrame, budget: int, first: int = 32) -> DataFrame:
        """(query_id, q, cell, rank): the cells that a query's walk meets until it has budget rows or has met all cells.

        `first` cells are ranked for all queries; for queries whose rows in them don't reach the budget, four times as
        many, and so on: a round is a join with the cells' sizes, and only open queries are in the next. Each round is
        written to the shared folder.
        """
        m, ksub, _ = self.books.shape
        sizes = written(self.lists.groupBy("cell").agg(F.count("*").alias("n")), "cells")
        total, n, open_, out = ksub**m, first, queries.select("query_id", "q"), None
        while True:
            n = min(n, total)
            w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
            met = self.cells(open_, n).join(sizes, "cell").withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).where(F.col("before") < budget)
            met = written(met.select("query_id", "q", "cell", "rank", "n"), "walk")
            held = met.groupBy("query_id").agg(F.sum("n").alias("held"))
            done = open_.join(held, "query_id", "left").where(F.coalesce("held", F.lit(0)) >= budget).select("query_id")
            if n == total or done.count() == open_.count():
                part = met
            else:
                part = met.join(done, "query_id", "left_semi")
            out = part if out is None else out.unionByName(part)
            if part is met:
                return out.drop("n")
            open_ = written(open_.join(done, "query_id", "left_anti"), "open")
            n *= 4

    def search(self, queries: DataFrame, k: int, budget: int) -> DataFrame:
        """(query_id, rank, vec_id, distance): the k nearest rows of the cells walked. Walks go in blocks of queries of
        checked size; cells and rows meet in a join, whose hot cells adaptive execution splits."""
        out = None
        for block in query_blocks(queries, dimension(queries, "q")):
            rows = self.walk(block, budget).join(self.lists, "cell")
            part = rows.select("query_id", "vec_id", F.round(metric("l2")[0](F.col("q"), F.col("embedding")), 6).alias("distance"))
            out = part if out is None else out.unionByName(part)
        return _best(out, k, False)
