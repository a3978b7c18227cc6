"""Exact search: kNN and range joins of a stated query set with all vectors, selectors, and what works on results.

Queries are (query_id, q), vectors (vec_id, embedding), results (query_id, rank, vec_id, distance).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.functions.vectors import metric
from nearfield.operators import pairwise

#: Bytes of queries that one pass over the vectors may broadcast; more queries go in several passes.
BLOCK_BYTES = 64 << 20
#: Bytes of a bitmap of ids that a plan may hold.
BITMAP_BYTES = 1 << 20
#: What stands for a missing id in arrays: such a row comes first, as in _best.
NO_ID = int(np.iinfo(np.int64).min)


def queries_of(vectors: DataFrame, where: str = "vec_id % 100 = 0") -> DataFrame:
    return vectors.where(where).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def query_blocks(queries: DataFrame, d: int) -> list[DataFrame]:
    """The queries in blocks whose size is checked, so each can be broadcast."""
    n = queries.count()
    blocks = max(1, -(-n * (d * 8 + 16) // BLOCK_BYTES))
    return [queries] if blocks == 1 else [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i) for i in range(blocks)]


def dimension(vectors: DataFrame, col: str = "embedding") -> int:
    r = vectors.select(F.size(col)).first()
    return r[0] if r else 0


def _best(pairs: DataFrame, k: int, greater: bool) -> DataFrame:
    """Window rank with ties by id; Spark keeps k rows per query in each task before the shuffle (WindowGroupLimit)."""
    order = [F.desc("distance") if greater else F.asc("distance"), F.asc("vec_id")]
    return pairs.where(~F.isnan("distance")).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")


def _each(queries: DataFrame, vectors: DataFrame, distance: Column, d: int | None = None) -> DataFrame:
    """The distances of all queries to all vectors, a broadcast for each block of queries of d numbers."""
    blocks = [vectors.crossJoin(F.broadcast(b)).select("query_id", "vec_id", distance.alias("distance")) for b in query_blocks(queries, dimension(vectors) if d is None else d)]
    out = blocks[0]
    for b in blocks[1:]:
        out = out.unionByName(b)
    return out


def _pairs(queries: DataFrame, vectors: DataFrame, name: str, arg: float, digits: int | None) -> tuple[DataFrame, bool]:
    f, greater = metric(name, arg)
    d = f(F.col("q"), F.col("embedding"))
    return _each(queries, vectors, d if digits is None else F.round(d, digits)), greater


def _arrays(queries: DataFrame, vectors: DataFrame, name: str) -> bool:
    """Whether NumPy has the metric, and ids are whole numbers."""
    return pairwise.known(name) and all(isinstance(x.schema[c].dataType, T.IntegralType) for x, c in ((queries, "query_id"), (vectors, "vec_id")))


def knn(queries: DataFrame, vectors: DataFrame, k: int, name: str = "l2", arg: float = 2.0, selector: Column | None = None, digits: int | None = 6) -> DataFrame:
    """The k nearest of the vectors that the selector admits, for every query: ties by id, pairs without a distance in no
    result. Blocks of queries are broadcast; vectors are scored in NumPy batch by batch, a task keeps k a query."""
    vectors = vectors if selector is None else vectors.where(selector)
    greater = metric(name, arg)[1]
    if not _arrays(queries, vectors, name):
        return _best(_pairs(queries, vectors, name, arg, digits)[0], k, greater)
    return _nearest(queries, vectors, k, name, arg, digits)


def _nearest(queries: DataFrame, vectors: DataFrame, k: int, name: str, arg: float = 2.0, digits: int | None = 6, cuts: list[int] | None = None) -> DataFrame:
    greater = metric(name, arg)[1]

    def best(q: np.ndarray, met: Iterator) -> Iterator:
        own = pairwise.Nearest(q, k, name, greater, arg, digits, cuts)
        for ids, x in met:
            own.meet(ids, x)
        yield own.at, own.ids, own.d

    return _best(_scored(queries, vectors, best, 6 * k, digits), k, greater)


def _scored(queries: DataFrame, vectors: DataFrame, score: Callable, more: int, digits: int | None) -> DataFrame:
    """(query_id, vec_id, distance) of what score(queries, (ids, rows) of all batches) yields in each task: (places of
    queries, ids, distances). Queries are broadcast in blocks; `more`: numbers that a task holds a query besides."""
    kinds = [x.schema[c].dataType for x, c in ((queries, "query_id"), (vectors, "vec_id"))]
    d = dimension(queries.where("q is not null"), "q")
    # a block's results are held by a task as well
    asked = queries.where(F.size("q") == d).select(F.col("query_id").cast("long"), "q").where("query_id is not null")
    rows = vectors.where(F.size("embedding") == d).select(F.col("vec_id").cast("long"), "embedding")
    # few files would be few tasks
    rows = rows.repartition("vec_id")
    out = None
    for block in query_blocks(asked, d + more):
        table = block.toArrow()  # at most BLOCK_BYTES, see query_blocks
        q = _matrix(table.column("q").combine_chunks(), d)
        sent = queries.sparkSession.sparkContext.broadcast((table.column("query_id").to_numpy(), q))

        def run(batches: Iterator, sent=sent) -> Iterator:
            import pyarrow as pa

            names, q = sent.value
            met = ((b.column(0).fill_null(NO_ID).to_numpy(), _matrix(b.column(1), d)) for b in batches if b.num_rows and len(names))
            for at, ids, far in score(q, met):
                yield pa.RecordBatch.from_arrays([pa.array(names[at]), pa.array(ids, mask=ids == NO_ID), pa.array(far)], ["query_id", "vec_id", "distance"])

        part = rows.mapInArrow(run, "query_id long, vec_id long, distance double")
        out = part if out is None else out.unionByName(part)
    return out.select(F.col("query_id").cast(kinds[0]), F.col("vec_id").cast(kinds[1]), "distance" if digits is None else F.round("distance", digits).alias("distance"))


def _matrix(column, d: int) -> np.ndarray:
    """An Arrow list column whose lists have d numbers, as rows; null numbers are none."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(column), d)


def range_join(queries: DataFrame, vectors: DataFrame, radius: float, name: str = "l2", arg: float = 2.0, digits: int | None = 6) -> DataFrame:
    """Vectors strictly nearer than the radius. Blocks of queries are broadcast; vectors are scored in NumPy batch by batch,
    a task sends on what is inside and holds none of it."""
    greater = metric(name, arg)[1]
    if name in ("l2", "ip", "l1", "lp") and _arrays(queries, vectors, name):
        # with these a null number makes the distance null, which is in no range
        whole = vectors.where(~F.exists("embedding", lambda x: x.isNull()))
        asked = queries.where(~F.exists("q", lambda x: x.isNull()))

        def inside(q: np.ndarray, met: Iterator) -> Iterator:
            for ids, x in met:
                for i, j, far in pairwise.within(q, x, radius, name, greater, arg, digits):
                    yield i, ids[j], far

        pairs = _scored(asked, whole, inside, 0, digits)
    else:
        pairs, _ = _pairs(queries, vectors, name, arg, digits)
    return pairs.where(F.col("distance") > radius if greater else F.col("distance") < radius)


def knn_arrow(queries: DataFrame, vectors: DataFrame, k: int, name: str = "l2") -> DataFrame:
    """knn() by NumPy products of Arrow batches: each task keeps k per query of its vectors, then one rank over those."""
    greater = name == "ip"
    spark = queries.sparkSession
    parts = []
    for block in query_blocks(queries, dimension(vectors)):
        rows = block.collect()  # at most BLOCK_BYTES, see query_blocks
        sent = spark.sparkContext.broadcast((np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.float64)))

        def run(batches: Iterator, sent=sent) -> Iterator:
            import pyarrow as pa

            ids, q = sent.value
            best_d = np.full((len(ids), 0), 0.0)
            best_i = np.full((len(ids), 0), 0, dtype=np.int64)
            for batch in batches:
                v = batch.column(0).to_numpy()
                x = np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(v), -1)
                if not len(v) or not len(ids):
                    continue
                d = q @ x.T
                d = -d if greater else (q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * d
                d, i = np.concatenate([best_d, d], 1), np.concatenate([best_i, np.broadcast_to(v, d.shape)], 1)
                if d.shape[1] > k:
                    at = np.lexsort((i, d), axis=1)[:, :k]
                    d, i = np.take_along_axis(d, at, 1), np.take_along_axis(i, at, 1)
                best_d, best_i = d, i
            n = best_d.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(best_i.ravel()), pa.array((-best_d if greater else best_d).ravel())], ["query_id", "vec_id", "distance"])

        parts.append(vectors.select("vec_id", "embedding").mapInArrow(run, "query_id long, vec_id long, distance double"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return _best(out, k, greater)


def distances_by_id(pairs: DataFrame, queries: DataFrame, vectors: DataFrame, name: str = "l2") -> DataFrame:
    """The distances of given (query_id, vec_id) pairs."""
    return pairs.join(queries, "query_id").join(vectors, "vec_id").select("query_id", "vec_id", F.round(metric(name)[0](F.col("q"), F.col("embedding")), 6).alias("distance"))


def rerank(candidates: DataFrame, queries: DataFrame, vectors: DataFrame, k: int, name: str = "l2") -> DataFrame:
    """The k best of given candidates by exact distance."""
    return _best(distances_by_id(candidates.select("query_id", "vec_id").distinct(), queries, vectors, name), k, metric(name)[1])


def merge_results(results: list[DataFrame], k: int, greater: bool = False) -> DataFrame:
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return _best(out.select("query_id", "vec_id", "distance").dropDuplicates(["query_id", "vec_id"]), k, greater)


def pad(results: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """k rows for each query; vec_id -1 and no distance where there were fewer."""
    grid = queries.select("query_id").withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(k))))
    return grid.join(results, ["query_id", "rank"], "left").select("query_id", "rank", F.coalesce("vec_id", F.lit(-1)).alias("vec_id"), "distance")


def sharded(queries: DataFrame, vectors: DataFrame, shards: int, k: int) -> DataFrame:
    return merge_results([knn(queries, vectors, k, selector=F.pmod(F.col("vec_id"), F.lit(shards)) == s) for s in range(shards)], k)


def split_dimensions(queries: DataFrame, vectors: DataFrame, parts: int, k: int) -> DataFrame:
    """Distances of slices of the dimensions, added up; the first slices have one more where parts doesn't divide them."""
    w, more = divmod(dimension(vectors), parts)
    return _nearest(queries, vectors, k, "l2", cuts=[i * w + min(i, more) for i in range(parts + 1)])


def id_range(least: int, below: int) -> Column:
    return (F.col("vec_id") >= least) & (F.col("vec_id") < below)


def id_batch(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    """Vectors whose id is in a table; Spark picks a broadcast or a shuffle by the table's size."""
    return vectors.join(ids.select("vec_id").distinct(), "vec_id", "left_semi")


def remove_ids(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    return vectors.join(ids.select("vec_id").distinct(), "vec_id", "left_anti")


def compacted(vectors: DataFrame) -> DataFrame:
    """Ids 0, 1, 2, ... in the old order: counts of each range of ids first, so no task sees all rows."""
    spark = vectors.sparkSession
    dealt = vectors.repartitionByRange(F.col("vec_id")).sortWithinPartitions("vec_id").withColumn("part_", F.spark_partition_id()).withColumn("at_", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    counts = sorted((r[0], r[1]) for r in dealt.groupBy("part_").count().collect())
    starts, n = [], 0
    for p, c in counts:
        starts.append((p, n))
        n += c
    first = spark.createDataFrame(starts, T.StructType([T.StructField("part_", T.IntegerType()), T.StructField("first_", T.LongType())]))
    return dealt.join(F.broadcast(first), "part_").withColumn("vec_id", F.col("first_") + F.col("at_")).drop("part_", "at_", "first_")


def update_vectors(vectors: DataFrame, new: DataFrame) -> DataFrame:
    return remove_ids(vectors, new).unionByName(new.select(*vectors.columns))


def append_shifted(a: DataFrame, b: DataFrame, shift: int) -> DataFrame:
    return a.unionByName(b.withColumn("vec_id", F.col("vec_id") + shift))


def map_ids(results: DataFrame, ids: DataFrame) -> DataFrame:
    """Internal to external ids by a table (vec_id, external_id)."""
    return results.join(ids, "vec_id").select("query_id", "rank", F.col("external_id").alias("vec_id"), "distance")


def first_of_code(codes: DataFrame) -> DataFrame:
    """The least id of each code: an aggregate with partial results, not a window over all rows of a code."""
    return codes.groupBy("code").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))


def max_results(ranged: DataFrame, total: int, bins: int = 1024) -> DataFrame:
    """Range results with the radius lowered until at most `total` are left: rows before the distance at which the running
    count passes it. Each round cuts the interval where it does in `bins`, whose counts are all that the driver holds."""
    rows, left = ranged, total
    while True:
        low, high, n = rows.agg(F.min("distance"), F.max("distance"), F.count("*")).first()
        if n <= left:
            return ranged if rows is ranged else ranged.where(F.col("distance") <= F.lit(high))
        if low == high:
            return ranged.where(F.col("distance") < F.lit(low))
        at = F.least(F.floor((F.col("distance") - F.lit(low)) / F.lit((high - low) / bins)), F.lit(bins - 1))
        for r in rows.groupBy(at.alias("bin")).agg(F.count("*").alias("n")).orderBy("bin").collect():
            if r["n"] > left:
                rows = rows.where(at == r["bin"])
                break
            left -= r["n"]


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """The results of a that b has as well."""
    return a.join(b.select("query_id", "vec_id").distinct(), ["query_id", "vec_id"], "left_semi")


def id_bitmap(bits: bytes) -> Column:
    """Ids whose bit is set, the lowest bit of a byte first; ids beyond the bitmap are not selected. The bitmap is a literal
    of the plan, so over BITMAP_BYTES it is an error: id_batch() takes a table of ids of any size."""
    if len(bits) > BITMAP_BYTES:
        raise ValueError(f"a bitmap of {len(bits)} bytes is too large for a plan; select by a table of ids")
    byte = F.conv(F.hex(F.substring(F.lit(bytearray(bits)), (F.floor(F.col("vec_id") / 8) + 1).cast("int"), 1)), 16, 10).cast("int")
    return (F.col("vec_id") >= 0) & (F.col("vec_id") < 8 * len(bits)) & (F.call_function("shiftright", byte, (F.col("vec_id") % 8).cast("int")).bitwiseAND(F.lit(1)) == 1)


def translated(vectors: DataFrame, ids: DataFrame, selector: Column) -> DataFrame:
    """Vectors whose external id, by a table (vec_id, external_id), a selector on vec_id admits."""
    admitted = ids.select(F.col("vec_id").alias("own_"), F.col("external_id").alias("vec_id")).where(selector).select(F.col("own_").alias("vec_id"))
    return id_batch(vectors, admitted)


def big_batch(queries: DataFrame, vectors: DataFrame, k: int, path: str, blocks: int = 8, name: str = "l2") -> DataFrame:
    """knn() in blocks of queries that are written one after another; a run that was broken off goes on behind the blocks
    that are whole. The blocks follow a hash of the query's id, so every run makes the same. Each has a manifest of the
    tables' rows and the settings: a block of other ones is made again."""
    from nearfield.operators.manifest import digest, read_manifest, remove, table_version, write_manifest

    spark = queries.sparkSession
    version = digest(table_version(queries.select("query_id", "q")), table_version(vectors.select("vec_id", "embedding")), k, blocks, name)
    paths = [f"{path}/block={i}" for i in range(blocks)]
    for i, at in enumerate(paths):
        if (read_manifest(spark, at) or {}).get("version") != version:
            remove(spark, at)
            knn(queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i), vectors, k, name).write.parquet(f"{at}/rows")
            write_manifest(spark, at, {"version": version})
    return spark.read.parquet(*[f"{at}/rows" for at in paths])


def knn_line(queries: DataFrame, values: DataFrame, k: int) -> DataFrame:
    """kNN of numbers: queries (query_id, x), values (vec_id, x). Each task sorts its values and takes k on both sides of
    every query of a block, so a query costs a binary search and not a pass."""
    parts = None
    for block in query_blocks(queries, 1):
        rows = block.collect()  # at most BLOCK_BYTES, see query_blocks
        sent = queries.sparkSession.sparkContext.broadcast((np.array([r["query_id"] for r in rows], np.int64), np.array([r["x"] for r in rows], np.float64)))

        def run(batches: Iterator, sent=sent) -> Iterator:
            import pyarrow as pa

            ids, q = sent.value
            for batch in batches:
                names, x = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.float64)
                order = np.lexsort((names, x))
                names, x = names[order], x[order]
                # equal values beyond k on a side are the ones of greater ids only if the run's begin is taken
                left, right = np.searchsorted(x, q, "left"), np.searchsorted(x, q, "right")
                out: tuple[list, ...] = ([], [], [])
                for i, lo, hi, v in zip(ids.tolist(), left.tolist(), right.tolist(), q.tolist(), strict=True):
                    edge = int(np.searchsorted(x, x[max(0, lo - k)], "left")) if lo else 0
                    at = np.concatenate((np.arange(edge, lo), np.arange(lo, min(hi, lo + k)), np.arange(hi, min(len(x), hi + k))))
                    d = np.abs(x[at] - v)
                    best = np.lexsort((names[at], d))[:k]
                    out[0].extend([i] * len(best))
                    out[1].extend(names[at][best].tolist())
                    out[2].extend(d[best].tolist())
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "distance"])

        part = values.select("vec_id", "x").mapInArrow(run, "query_id long, vec_id long, distance double")
        parts = part if parts is None else parts.unionByName(part)
    return _best(parts.withColumn("distance", F.round("distance", 6)), k, False)


def approximate_top(queries: DataFrame, vectors: DataFrame, k: int, buckets: int = 8, per_bucket: int = 4) -> DataFrame:
    """The best per_bucket of each bucket of ids, then the k best of those. A task keeps per_bucket of each bucket a query."""
    if _arrays(queries, vectors, "l2"):

        def best(q: np.ndarray, met: Iterator) -> Iterator:
            own = [pairwise.Nearest(q, per_bucket, "l2", False) for _ in range(buckets + 1)]
            for ids, x in met:
                at = np.where(ids == NO_ID, buckets, ids % buckets)
                for b in np.unique(at).tolist():
                    own[b].meet(ids[at == b], x[at == b])
            for one in own:
                yield one.at, one.ids, one.d

        pairs = _scored(queries, vectors, best, 6 * per_bucket * buckets, 6)
    else:
        pairs, _ = _pairs(queries, vectors, "l2", 2.0, 6)
    w = Window.partitionBy("query_id", F.pmod("vec_id", F.lit(buckets))).orderBy("distance", "vec_id")
    return _best(pairs.withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_bucket), k, False)


def margin_pairs(a: DataFrame, b: DataFrame, k: int, threshold: float) -> DataFrame:
    """Pairs whose inner product is over threshold times the mean of both sides' k best."""
    q = lambda x: x.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    ab, ba = knn(q(a), b, k, "ip"), knn(q(b), a, k, "ip")
    ma = ab.groupBy("query_id").agg(F.avg("distance").alias("mean_a"))
    mb = ba.groupBy(F.col("query_id").alias("vec_id")).agg(F.avg("distance").alias("mean_b"))
    m = ab.join(ma, "query_id").join(mb, "vec_id").withColumn("margin", F.round(2 * F.col("distance") / (F.col("mean_a") + F.col("mean_b")), 6))
    return m.where(F.col("margin") > threshold).select("query_id", "vec_id", "margin")
