"""Inverted-file indexes as tables: centroids on the driver, lists as (list_no, vec_id, embedding or code)."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfield.functions.vectors import hamming, metric, pack_bits
from nearfield.operators.cluster import KMeans, assign, imbalance
from nearfield.operators.quantize import Codec, ProductQuantizer, SignHash
from nearfield.operators.search import _best, _each, dimension, query_blocks, rerank


def probes(queries: DataFrame, centroids: np.ndarray, nprobe: int, ip: bool = False) -> DataFrame:
    """(query_id, q, list_no, probe, coarse): each query's nprobe nearest lists, in order."""
    sent = queries.sparkSession.sparkContext.broadcast(np.asarray(centroids, dtype=np.float64))
    kind = queries.schema["q"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        c = sent.value
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(n, -1)
            d = -(x @ c.T) if ip else (x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * x @ c.T
            at = np.argsort(d, axis=1, kind="stable")[:, :nprobe]
            k = at.shape[1]
            rows = pa.array(np.repeat(np.arange(n), k))
            best = np.take_along_axis(d, at, 1).ravel()
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(at.ravel().astype(np.int32)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(-best if ip else best)], ["query_id", "q", "list_no", "probe", "coarse"])

    return queries.select("query_id", "q").mapInArrow(run, f"query_id long, q {kind}, list_no int, probe int, coarse double")


@dataclass
class IVF:
    """fit() makes the centroids, add() the lists; search() is coarse rank, equi-join on list_no, rank.

    codec: None for raw vectors, or a fitted Codec; by_residual codes vectors less their centroid. Lists that are read
    from a table partitioned by list_no are pruned to those probed.
    """

    nlist: int
    metric: str = "l2"
    codec: Codec | None = None
    by_residual: bool = False
    centroids: np.ndarray | None = None
    lists: DataFrame | None = None

    @property
    def ip(self) -> bool:
        return self.metric == "ip"

    def fit(self, vectors: DataFrame, niter: int = 8, init: np.ndarray | None = None) -> IVF:
        self.centroids = KMeans(self.nlist, niter, spherical=self.ip).fit(vectors, init=init)
        if self.codec is not None:
            self.codec.fit(self.residuals(vectors) if self.by_residual else vectors)
        return self

    def assign(self, vectors: DataFrame) -> DataFrame:
        return assign(vectors.select("vec_id", "embedding"), self.centroids, self.ip).drop("list_dist")

    def residuals(self, vectors: DataFrame) -> DataFrame:
        c = np.asarray(self.centroids)
        rows = assign(vectors.select("vec_id", "embedding"), c, self.ip)
        return self._shift(rows, -1.0).drop("list_no", "list_dist")

    def _shift(self, rows: DataFrame, sign: float) -> DataFrame:
        table = rows.sparkSession.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(self.centroids)], "list_no int, c_ array<double>")
        return rows.join(F.broadcast(table), "list_no").withColumn("embedding", F.zip_with("embedding", "c_", lambda a, b: (a + sign * b).cast("float"))).drop("c_")

    def encode(self, assigned: DataFrame) -> DataFrame:
        if self.codec is None:
            return assigned
        return self.codec.encode_table(self._shift(assigned, -1.0) if self.by_residual else assigned)

    def decode(self, rows: DataFrame) -> DataFrame:
        if self.codec is None:
            return rows
        out = self.codec.decode_table(rows)
        return self._shift(out, 1.0) if self.by_residual else out

    def add(self, vectors: DataFrame) -> IVF:
        return self.add_assigned(self.assign(vectors))

    def add_assigned(self, assigned: DataFrame) -> IVF:
        """With given lists (list_no, vec_id, embedding)."""
        new = self.encode(assigned)
        self.lists = new if self.lists is None else self.lists.unionByName(new)
        return self

    def remove(self, ids: DataFrame) -> IVF:
        self.lists = self.lists.join(ids.select("vec_id").distinct(), "vec_id", "left_anti")
        return self

    def update(self, vectors: DataFrame) -> IVF:
        return self.remove(vectors.select("vec_id")).add(vectors)

    def merge(self, other: IVF, shift: int = 0) -> IVF:
        """Another index's lists, ids shifted; both have to have the same centroids."""
        if not np.array_equal(self.centroids, other.centroids):
            raise ValueError("indexes of different centroids can't be merged")
        self.lists = self.lists.unionByName(other.lists.withColumn("vec_id", F.col("vec_id") + shift))
        return self

    def subset(self, where: str) -> IVF:
        """A copy with the entries of an SQL condition on vec_id and list_no."""
        return IVF(self.nlist, self.metric, self.codec, self.by_residual, self.centroids, self.lists.where(where))

    def reconstruct(self, ids: DataFrame) -> DataFrame:
        return self.decode(self.lists.join(ids.select("vec_id").distinct(), "vec_id", "left_semi")).select("vec_id", "embedding")

    def read(self, list_nos: list[int]) -> DataFrame:
        """The rows of the given lists alone: of a table partitioned by list_no, no other list is read."""
        return self.lists.where(F.col("list_no").isin([int(x) for x in list_nos]))

    def candidates(self, probed: DataFrame) -> DataFrame:
        """The rows of the probed lists with their distances, for any metric. probed is as probes() or the caller gives it."""
        nos = [r[0] for r in probed.select("list_no").distinct().collect()]  # at most nlist
        rows = probed.select("query_id", "q", "list_no", "probe").join(self.decode(self.read(nos)), "list_no")
        return rows.select("query_id", "probe", "list_no", "vec_id", F.round(metric(self.metric)[0](F.col("q"), F.col("embedding")), 6).alias("distance"))

    def scan(self, probed: DataFrame, k: int | None = None, radius: float | None = None) -> DataFrame:
        """(query_id, vec_id, distance) of the probed lists' rows by squared L2 or inner product: each task's k best a
        query, or all within the radius.

        The probes of a block of queries of checked size are broadcast; the lists that they name are read once a block
        and scored in NumPy, codes of a product quantiser by tables of distances, others decoded a list at a time.
        """
        ip, codec, out = self.ip, self.codec, None
        col = "embedding" if codec is None else "code"
        centroids = np.asarray(self.centroids, dtype=np.float64) if self.by_residual else None
        asked = probed.groupBy("query_id").agg(F.first("q").alias("q"), F.collect_list("list_no").alias("lists"))
        for block in query_blocks(asked, dimension(asked, "q") + self.nlist):
            rows = block.orderBy("query_id").collect()  # at most BLOCK_BYTES, see query_blocks
            ids = np.array([r[0] for r in rows], dtype=np.int64)
            q = np.array([r[1] for r in rows], dtype=np.float64)
            by_list: dict[int, list[int]] = {}
            for i, r in enumerate(rows):
                for x in r[2]:
                    by_list.setdefault(x, []).append(i)
            sent = probed.sparkSession.sparkContext.broadcast((ids, q, by_list))

            def run(batches, sent=sent):
                import pyarrow as pa

                ids, q, by_list = sent.value
                best: tuple[np.ndarray, ...] = (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))

                def pack(rows):
                    return pa.RecordBatch.from_arrays([pa.array(ids[rows[0]]), pa.array(rows[2]), pa.array(rows[1])], ["query_id", "vec_id", "distance"])

                for batch in batches:
                    if not batch.num_rows:
                        continue
                    nos, names = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                    if codec is None:
                        x = np.asarray(batch.column(2).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(nos), -1)
                    else:
                        x = np.asarray(batch.column(2).flatten().to_numpy(zero_copy_only=False)).reshape(len(nos), -1)
                    parts = [best]
                    for no in np.unique(nos).tolist():
                        own = np.array(by_list.get(no, []), dtype=np.int64)
                        if not len(own):
                            continue
                        at = np.flatnonzero(nos == no)
                        d = scores(q[own], x[at], codec, None if centroids is None else centroids[no], ip, no)
                        for j, i in enumerate(own.tolist()):
                            dj = np.round(d[j], 6)
                            use = np.arange(len(dj)) if k is not None else np.flatnonzero(dj > radius if ip else dj < radius)
                            if k is not None and len(dj) > k:
                                use = np.lexsort((names[at], -dj if ip else dj))[:k]
                            parts.append((np.full(len(use), i), dj[use], names[at][use]))
                    rows = tuple(np.concatenate(c) for c in zip(*parts, strict=True))
                    if k is None:
                        yield pack(rows)
                        continue
                    order = np.lexsort((rows[2], -rows[1] if ip else rows[1], rows[0]))
                    rows = tuple(c[order] for c in rows)
                    first = np.searchsorted(rows[0], rows[0])  # where each query begins
                    best = tuple(c[np.arange(len(first)) - first < k] for c in rows)
                yield pack(best)

            part = self.read(sorted(by_list)).select("list_no", "vec_id", col).mapInArrow(run, "query_id long, vec_id long, distance double")
            out = part if out is None else out.unionByName(part)
        return out.withColumn("distance", F.round("distance", 6))

    def search(self, queries: DataFrame, k: int, nprobe: int = 8, max_codes: int | None = None) -> DataFrame:
        return self.search_assigned(probes(queries, self.centroids, nprobe, self.ip), k, max_codes)

    def search_refined(self, queries: DataFrame, raw: DataFrame, k: int, wide: int, nprobe: int = 8) -> DataFrame:
        """The k nearest by the raw vectors among the wide nearest by code, or, where those are too many to be ranked, among
        all within the distance of the last of them."""
        from nearfield.operators.shortlist import RANKED, refined

        if wide <= RANKED or self.metric != "l2":
            return rerank(self.search(queries, wide, nprobe), queries, raw, k, self.metric)
        return refined(self.lists, probes(queries, self.centroids, nprobe), queries, raw, k, wide, self.codec, self.centroids if self.by_residual else None)

    def search_assigned(self, probed: DataFrame, k: int, max_codes: int | None = None) -> DataFrame:
        """max_codes: a budget per query in probe order; the last list is read as far as the budget goes, by id."""
        if max_codes is not None:
            sizes = self.lists.groupBy("list_no").agg(F.count("*").alias("n"))
            w = Window.partitionBy("query_id").orderBy("probe").rowsBetween(Window.unboundedPreceding, -1)
            probed = probed.join(sizes, "list_no").withColumn("left", max_codes - F.coalesce(F.sum("n").over(w), F.lit(0))).where("left > 0")
            part = probed.groupBy("list_no").agg(F.max("left").alias("most"))
            nos = [r[0] for r in part.select("list_no").collect()]  # at most nlist
            ranked = self.read(nos).withColumn("at", F.row_number().over(Window.partitionBy("list_no").orderBy("vec_id"))).join(part, "list_no").where("at <= most").drop("most")
            rows = probed.select("query_id", "q", "list_no", "left").join(self.decode(ranked), "list_no").where("at <= left")
            pairs = rows.select("query_id", "vec_id", F.round(metric(self.metric)[0](F.col("q"), F.col("embedding")), 6).alias("distance"))
        else:
            pairs = self.scan(probed, k) if self.metric in ("l2", "ip") else self.candidates(probed)
        return _best(pairs, k, metric(self.metric)[1])

    def range_search(self, queries: DataFrame, radius: float, nprobe: int = 8) -> DataFrame:
        probed = probes(queries, self.centroids, nprobe, self.ip)
        if self.metric in ("l2", "ip"):
            return self.scan(probed, radius=radius)
        pairs = self.candidates(probed).select("query_id", "vec_id", "distance")
        return pairs.where(F.col("distance") > radius if metric(self.metric)[1] else F.col("distance") < radius)

    def search_and_reconstruct(self, queries: DataFrame, k: int, nprobe: int = 8) -> DataFrame:
        """Results with the vectors that the index holds for them, decoded for the results alone."""
        found = self.search(queries, k, nprobe)
        return found.join(self.reconstruct(found), "vec_id", "left")

    def search_and_return_codes(self, queries: DataFrame, k: int, nprobe: int = 8) -> DataFrame:
        """Results with their lists and codes (or raw vectors, without a codec)."""
        found = self.search(queries, k, nprobe)
        own = self.lists.join(found.select("vec_id").distinct(), "vec_id", "left_semi").select("vec_id", "list_no", "embedding" if self.codec is None else "code")
        return found.join(own, "vec_id")

    def stats(self) -> DataFrame:
        return imbalance(self.lists)

    def save(self, path: str) -> None:
        self.lists.write.mode("overwrite").partitionBy("list_no").parquet(f"{path}/lists")
        spark = self.lists.sparkSession
        about = {"nlist": self.nlist, "metric": self.metric, "by_residual": self.by_residual, "centroids": np.asarray(self.centroids).tolist(), "codec": _codec_json(self.codec)}
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> IVF:
        about = json.loads(spark.read.text(f"{path}/about").first()[0])
        return cls(about["nlist"], about["metric"], _codec_from(about["codec"]), about["by_residual"], np.array(about["centroids"]), spark.read.parquet(f"{path}/lists"))


def scores(q: np.ndarray, x: np.ndarray, codec: Codec | None, centroid: np.ndarray | None, ip: bool, no: int = 0) -> np.ndarray:
    """(queries, rows) scores of the rows of list `no`: vectors, or codes of a codec, of residuals if a centroid is given.
    A codec with distances of its own scores by those."""
    if isinstance(codec, ProductQuantizer) and not ip:
        return codec.adc(q if centroid is None else q - centroid, x)
    if hasattr(codec, "distances"):
        return codec.distances(q, x, no)
    if codec is not None:
        x = codec.decode(x).astype(np.float32).astype(np.float64)
        if centroid is not None:
            x = (x + centroid).astype(np.float32).astype(np.float64)
    if ip:
        return q @ x.T
    return np.stack([((x - v) ** 2).sum(1) for v in q])


@dataclass
class RefinedIVF:
    """An inverted file of codes with a second code of what the first leaves over: the shortlist is ranked by the first,
    the result by both together, without the raw vectors."""

    base: IVF
    codec: Codec
    k_factor: int = 4
    rest: DataFrame | None = None

    def _left(self, vectors: DataFrame) -> DataFrame:
        own = self.base.decode(self.base.encode(self.base.assign(vectors))).select("vec_id", F.col("embedding").alias("y"))
        return vectors.join(own, "vec_id").select("vec_id", F.zip_with("embedding", "y", lambda a, b: (a - b).cast("float")).alias("embedding"))

    def fit(self, vectors: DataFrame, niter: int = 8) -> RefinedIVF:
        self.base.fit(vectors, niter)
        self.codec.fit(self._left(vectors))
        return self

    def add(self, vectors: DataFrame) -> RefinedIVF:
        self.base.add(vectors)
        new = self.codec.encode_table(self._left(vectors))
        self.rest = new if self.rest is None else self.rest.unionByName(new)
        return self

    def reconstruct(self, ids: DataFrame) -> DataFrame:
        ids = ids.select("vec_id").distinct()
        one = self.base.reconstruct(ids)
        two = self.codec.decode_table(self.rest.join(ids, "vec_id", "left_semi")).select("vec_id", F.col("embedding").alias("y"))
        return one.join(two, "vec_id").select("vec_id", F.zip_with("embedding", "y", lambda a, b: (a + b).cast("float")).alias("embedding"))

    def search(self, queries: DataFrame, k: int, nprobe: int = 8) -> DataFrame:
        from nearfield.operators.shortlist import RANKED

        if k * self.k_factor > RANKED:
            return self.base.search_refined(queries, self.reconstruct(self.base.lists), k, k * self.k_factor, nprobe)
        short = self.base.search(queries, k * self.k_factor, nprobe)
        return rerank(short, queries, self.reconstruct(short), k, self.base.metric)


def _codec_json(codec) -> dict | None:
    if codec is None:
        return None

    def plain(v):
        if isinstance(v, np.ndarray):
            return {"array": v.tolist(), "type": str(v.dtype)}
        if isinstance(v, Codec):
            return _codec_json(v)
        return [plain(x) for x in v] if isinstance(v, list) else v

    return {"codec": type(codec).__name__, **{k: plain(v) for k, v in vars(codec).items()}}


def _codec_from(about) -> Codec | None:
    from nearfield.operators import quantize

    if about is None:
        return None

    def back(v):
        if isinstance(v, dict):
            return np.array(v["array"], dtype=v["type"]) if "array" in v else _codec_from(v)
        return [back(x) for x in v] if isinstance(v, list) else v

    return getattr(quantize, about["codec"])(**{k: back(v) for k, v in about.items() if k != "codec"})


@dataclass
class DedupIVF:
    """One row for each distinct vector of a list, with its ids; ids are unfolded after the rank."""

    base: IVF

    def lists(self, k: int, list_nos: list[int]) -> DataFrame:
        """Of the given lists the distinct vectors with their k least ids, which are all that a result of k can hold; a task
        sends k ids of a vector, however many copies it has."""
        w = Window.partitionBy("list_no", "embedding").orderBy("vec_id")
        few = self.base.read(list_nos).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
        return few.groupBy("list_no", "embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))

    def search(self, queries: DataFrame, k: int, nprobe: int = 8) -> DataFrame:
        probed = probes(queries, self.base.centroids, nprobe).select("query_id", "q", "list_no")
        nos = [r[0] for r in probed.select("list_no").distinct().collect()]  # at most nlist
        rows = probed.join(self.lists(k, nos), "list_no")
        best = rows.select("query_id", F.element_at("ids", 1).alias("vec_id"), "ids", F.round(metric("l2")[0](F.col("q"), F.col("embedding")), 6).alias("distance"))
        w = Window.partitionBy("query_id").orderBy("distance", "vec_id")
        best = best.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
        return _best(best.select("query_id", F.explode("ids").alias("vec_id"), "distance"), k, False)


def multi_index(queries: DataFrame, books: np.ndarray, k: int) -> DataFrame:
    """(query_id, rank, cell, distance): the k cells of least summed distance over the parts' centroids. books:
    (m, ksub, dsub); a part's k nearest are enough for the k best sums."""
    m, ksub, w = books.shape
    out = None
    for j in range(m):
        part = probes(queries.select("query_id", F.slice("q", j * w + 1, w).alias("q")), books[j], min(k, ksub)).select("query_id", F.col("list_no").cast("long").alias("c"), "coarse")
        if out is None:
            out = part.select("query_id", F.col("c").alias("cell"), F.col("coarse").alias("distance"))
            continue
        out = out.join(part, "query_id").select("query_id", (F.col("cell") * ksub + F.col("c")).alias("cell"), (F.col("distance") + F.col("coarse")).alias("distance"))
        out = out.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "cell"))).where(F.col("r") <= k).drop("r")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "cell"))).select("query_id", "rank", "cell", F.round("distance", 6).alias("distance"))


def hash_search(queries: DataFrame, vectors: DataFrame, codec: SignHash, k: int) -> DataFrame:
    """Hamming rank of sign codes."""
    code = lambda x: codec.encode_table(x)
    v = code(vectors.select("vec_id", "embedding")).select("vec_id", pack_bits(F.col("code")).alias("w"))
    q = code(queries.select("query_id", F.col("q").alias("embedding"))).select("query_id", pack_bits(F.col("code")).alias("wq"))
    return _best(_each(q, v, hamming(F.col("w"), F.col("wq")).cast("double"), dimension(q, "wq")), k, False)
