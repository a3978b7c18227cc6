"""Batches of queries larger than memory against inverted lists: list by list, each read once for all its queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.functions.vectors import metric
from nearfield.operators.ivf import IVF, probes, scores
from nearfield.operators.manifest import digest, read_manifest, remove, table_version, write_manifest
from nearfield.operators.search import _best

#: Rows of a list, and queries that probe it, which meet in one group; longer lists are several groups.
SLAB_ROWS, SLAB_QUERIES = 16_384, 4_096


def _score_groups(index: IVF, k: int):
    """(key, queries of a slab, rows of a slab) as Arrow tables -> the k best a query."""
    import pyarrow as pa

    ip, codec = index.ip, index.codec
    centroids = np.asarray(index.centroids, dtype=np.float64) if index.by_residual else None

    def run(key, asked, rows):
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
        if not asked.num_rows or not rows.num_rows:
            return empty
        flat = lambda c, n: np.asarray(c.combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(n, -1)
        q, x = flat(asked.column("q"), asked.num_rows).astype(np.float64), flat(rows.column("x"), rows.num_rows)
        x = x.astype(np.float64) if codec is None else x
        ids, names = asked.column("query_id").to_numpy(), rows.column("vec_id").to_numpy()
        out: list[tuple] = []
        step = max(1, (8 << 20) // max(1, len(names)))  # a slice of the score matrix has some 64 MB
        for a in range(0, len(ids), step):
            d = np.round(scores(q[a : a + step], x, codec, None if centroids is None else centroids[key[0].as_py()], ip, key[0].as_py()), 6)
            for i, row in enumerate(d):
                use = np.lexsort((names, -row if ip else row))[:k]
                out.append((np.full(len(use), ids[a + i]), names[use], row[use]))
        c = [np.concatenate(x) for x in zip(*out, strict=True)]
        return pa.table({"query_id": pa.array(c[0]), "vec_id": pa.array(c[1]), "distance": pa.array(c[2])})

    return run


def list_major_search(index: IVF, queries: DataFrame, k: int, nprobe: int, path: str, ranges: int = 8, log: list[str] | None = None) -> DataFrame:
    """index.search(queries, k, nprobe) for any number of queries, written below path range by range of lists.

    Queries are mapped to the lists they probe and dealt by list_no, as the lists' rows are; where a list has over
    SLAB_ROWS rows or SLAB_QUERIES queries, slabs of both meet pair by pair, so no group grows with the input, however hot
    a list. In a range each list is read once for all its queries, and a group sends k rows a query. No query is
    broadcast; sizes by list, of which there are nlist, go to the driver.

    Each range is written with a manifest of the index, the queries, k and nprobe. A run that was broken off goes on behind
    the ranges that are whole; ranges of other inputs are made again. log gets "kept" or "made" for each range.

    Only metrics that scores() knows, l2 and ip; null queries or vectors are left out; repeated query ids share results.
    """
    if index.metric not in ("l2", "ip"):
        raise ValueError(f"lists are scored by l2 or ip, not by {index.metric}")
    spark = queries.sparkSession
    col = "embedding" if index.codec is None else "code"
    asked = queries.where("q is not null").select("query_id", "q")
    rows = index.lists.where(F.col(col).isNotNull()).select("list_no", "vec_id", F.col(col).alias("x"))
    version = digest(table_version(asked), table_version(rows), np.asarray(index.centroids).tolist(), k, nprobe, index.metric, index.by_residual, ranges)
    probed = probes(asked, index.centroids, nprobe, index.ip).select("list_no", "query_id", "q")
    n_rows = n_asked = None
    cuts = np.linspace(0, index.nlist, ranges + 1).astype(int).tolist()
    for a, b in zip(cuts, cuts[1:], strict=False):
        at = f"{path}/lists={a}-{b}"
        about = read_manifest(spark, at)
        if about is not None and about["version"] == version:
            if log is not None:
                log.append("kept")
            continue
        if n_rows is None:
            n_rows = dict(rows.groupBy("list_no").count().collect())
            n_asked = dict(probed.groupBy("list_no").count().collect())
        remove(spark, at)
        own = F.col("list_no").between(a, b - 1)
        # a row for each probed list of the range
        parts = [(n, -(-n_asked[n] // SLAB_QUERIES), -(-n_rows[n] // SLAB_ROWS)) for n in n_rows if n in n_asked and a <= n < b]
        slabs = F.broadcast(spark.createDataFrame(parts, "list_no int, asked_slabs int, row_slabs int"))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        dealt = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
        left = probed.where(own).join(slabs, "list_no").select("list_no", "query_id", "q", dealt("query_id", "asked_slabs").alias("asked_slab"), every("row_slabs").alias("row_slab"))
        right = rows.where(own).join(slabs, "list_no").select("list_no", "vec_id", "x", dealt("vec_id", "row_slabs").alias("row_slab"), every("asked_slabs").alias("asked_slab"))
        groups = left.groupBy("list_no", "asked_slab", "row_slab").cogroup(right.groupBy("list_no", "asked_slab", "row_slab"))
        found = groups.applyInArrow(_score_groups(index, k), "query_id long, vec_id long, distance double")
        # a query's results from this range's lists, k of them
        _best(found, k, metric(index.metric)[1]).drop("rank").write.parquet(f"{at}/rows")
        write_manifest(spark, at, {"version": version, "lists": [a, b]})
        if log is not None:
            log.append("made")
    found = spark.read.parquet(*[f"{path}/lists={a}-{b}/rows" for a, b in zip(cuts, cuts[1:], strict=False)])
    return _best(found, k, metric(index.metric)[1])
