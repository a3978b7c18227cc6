"""An index made offline: statistics, distinct rows, training, shards, merge, search, evaluation and consistency as stages."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.operators import evaluate, search
from nearfield.operators.cluster import KMeans, assign, matrix_stats
from nearfield.operators.ivf import IVF
from nearfield.operators.manifest import Stage, run_stages


def _centroids(trained: DataFrame) -> np.ndarray:
    """nlist rows."""
    return np.array([r[0] for r in trained.orderBy("list_no").select("centroid").collect()], dtype=np.float64)


def offline_index(spark: SparkSession, path: str, vectors: DataFrame, queries: DataFrame, nlist: int = 16, shards: int = 4, k: int = 10, nprobe: int = 8, niter: int = 8, log: list[tuple[str, str]] | None = None) -> dict[str, DataFrame]:
    """All stages' tables by name, below path, by run_stages(): what is whole and up to date is kept, a run that was broken
    off goes on, and changed rows or settings make what depends on them again.

    stats: of each dimension. distinct: of equal vectors the least id, with their number. trained: centroids. shard_i: the
    rows of a shard by a hash of the id, with their list. merged: all shards. found: (query_id, rank, vec_id, distance) of
    nprobe lists, exact: of all distinct rows. recall: of each query. consistency: (check, n), where n has to be 0.

    vectors: (vec_id, embedding), queries: (query_id, q). Null vectors are left out by `distinct`.
    """
    d = search.dimension(vectors.where("embedding is not null"))

    def made(t: dict[str, DataFrame]) -> IVF:
        return IVF(nlist, centroids=_centroids(t["trained"]), lists=t["merged"])

    def train(t: dict[str, DataFrame]) -> DataFrame:
        c = KMeans(nlist, niter).fit(t["distinct"])
        return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(c)], "list_no int, centroid array<double>")

    def shard(i: int):
        return lambda t: assign(t["distinct"].where(F.pmod(F.xxhash64("vec_id"), F.lit(shards)) == i).select("vec_id", "embedding"), _centroids(t["trained"])).select("list_no", "vec_id", "embedding")

    def merge(t: dict[str, DataFrame]) -> DataFrame:
        out = t["shard_0"]
        for i in range(1, shards):
            out = out.unionByName(t[f"shard_{i}"])
        return out

    def check(t: dict[str, DataFrame]) -> DataFrame:
        own, all_ = t["merged"].groupBy("vec_id").agg(F.count("*").alias("n")), t["distinct"].select("vec_id")
        again = assign(t["merged"].withColumnRenamed("list_no", "was"), _centroids(t["trained"])).where("list_no <> was")
        rows = {"missing": all_.join(own, "vec_id", "left_anti"), "unknown": own.join(all_, "vec_id", "left_anti"), "twice": own.where("n > 1"), "in a wrong list": again, "found but not there": t["found"].join(all_, "vec_id", "left_anti")}
        out = None
        for name, r in rows.items():
            one = r.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
            out = one if out is None else out.unionByName(one)
        return out

    parts = [f"shard_{i}" for i in range(shards)]
    stages = [
        Stage("stats", lambda t: matrix_stats(t["vectors"], d), ("vectors",), {"d": d}),
        Stage("distinct", lambda t: t["vectors"].where("embedding is not null").groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")).select("vec_id", "embedding", "copies"), ("vectors",)),
        Stage("trained", train, ("distinct",), {"nlist": nlist, "niter": niter}),
        *[Stage(p, shard(i), ("distinct", "trained"), {"shards": shards}) for i, p in enumerate(parts)],
        Stage("merged", merge, tuple(parts)),
        Stage("found", lambda t: made(t).search(t["queries"], k, nprobe), ("merged", "trained", "queries"), {"k": k, "nprobe": nprobe}),
        Stage("exact", lambda t: search.knn(t["queries"], t["distinct"], k), ("distinct", "queries"), {"k": k}),
        Stage("recall", lambda t: evaluate.recall(t["found"], t["exact"], k), ("found", "exact"), {"k": k}),
        Stage("consistency", check, ("distinct", "trained", "merged", "found")),
    ]
    return run_stages(spark, path, {"vectors": vectors, "queries": queries}, stages, log)
