"""A kNN graph by neighbour descent: neighbours of neighbours meet, round by round, as joins and grouped blocks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a block whose pairs give the first links, and the random directions along which blocks are laid.
BLOCK, DIRECTIONS = 64, 3


def shared_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the folder that spark.checkpoint.dir names, which all executors have to share. Only on one machine,
    as in tests, a folder of its own is set where it is unset; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        root = f"{tempfile.gettempdir()}/nearfield-shared"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read back, so that a lost executor doesn't cost the rounds before."""
    path = shared_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes what written() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(f)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


_FOUND = "node long, neighbor long, distance double"


def _best_links(ids: np.ndarray, x: np.ndarray, k: int, worth: np.ndarray | None = None, fresh: np.ndarray | None = None):
    """(node, neighbor, distance) of a block's pairs: k a node, nearer than its worth, one of both fresh."""
    n = (x * x).sum(1)
    d = np.maximum(n[:, None] + n[None] - 2 * x @ x.T, 0)
    d[ids[:, None] == ids[None]] = np.inf
    if fresh is not None:
        d[~(fresh[:, None] | fresh[None])] = np.inf
    if worth is not None:
        d[d >= worth[:, None]] = np.inf
    if len(ids) > k:
        at = np.argpartition(d, k - 1, axis=1)[:, :k]
        d = np.take_along_axis(d, at, 1)
    else:
        at = np.broadcast_to(np.arange(len(ids)), d.shape)
    i, j = np.nonzero(np.isfinite(d))
    return ids[i], ids[at[i, j]], d[i, j]


def _first_links(vectors: DataFrame, k: int, direction: np.ndarray, seed: int) -> DataFrame:
    """Links within blocks of neighbours along a direction. Ties are dealt by a hash, so copies of one vector are no hot
    range."""
    along = F.aggregate(F.zip_with("embedding", F.lit(direction.tolist()), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    laid = vectors.select("vec_id", "embedding", along.alias("p"), F.xxhash64(F.lit(seed), "vec_id").alias("h")).repartitionByRange("p", "h").sortWithinPartitions("p", "h").select("vec_id", "embedding")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(0).to_numpy()
            if not len(ids):
                continue
            x = np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(ids), -1)
            # the last two blocks are one where the last would be short
            starts = list(range(0, max(1, len(ids) - BLOCK // 2), BLOCK))
            for a, b in zip(starts, [*starts[1:], len(ids)], strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in _best_links(ids[a:b], x[a:b], k)], ["node", "neighbor", "distance"])

    return laid.mapInArrow(run, _FOUND)


def _nearest(found: DataFrame, k: int) -> DataFrame:
    """The k nearest links of each node, ties by id; what is known as old stays old. A task sends k rows a node."""
    one = found.groupBy("node", "neighbor").agg(F.min("distance").alias("distance"), F.min("fresh").alias("fresh"))
    w = Window.partitionBy("node").orderBy("distance", "neighbor")
    return one.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _meetings(links: DataFrame, vectors: DataFrame, sample: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(links with sampled, messages (at, id, fresh, embedding, worth)): of the links to a node, `sample` fresh and as many
    old ones are drawn by a hash; both ends of these send their vector to each other. So a node that all others link to
    sends its vector 2 * sample times, and to its own neighbours."""
    w = Window.partitionBy("neighbor", "fresh").orderBy(F.xxhash64(F.lit(seed), "node"), "node")
    drawn = links.withColumn("draw", F.row_number().over(w)).where(F.col("draw") <= sample).select("node", "neighbor", "fresh")
    ways = drawn.select(F.col("node").alias("at"), F.col("neighbor").alias("id"), "fresh").unionByName(drawn.select(F.col("neighbor").alias("at"), F.col("node").alias("id"), "fresh"))
    ways = ways.groupBy("at", "id").agg(F.max("fresh").alias("fresh"))
    worth = links.groupBy("node").agg(F.max("distance").alias("worth"), F.count("*").alias("n"))
    own = vectors.join(worth, vectors["vec_id"] == worth["node"], "left").select(F.col("vec_id").alias("id"), "embedding", "worth", F.coalesce("n", F.lit(0)).alias("n"))
    return drawn, ways.join(own, "id")


def _met(messages: DataFrame, k: int) -> DataFrame:
    """Pairs of what met at a node, one of both fresh, that are nearer than the farther link of a whole list."""
    rows = messages.select("at", "id", "fresh", "embedding", F.when(F.col("n") < k, float("inf")).otherwise(F.col("worth")).alias("worth"))
    rows = rows.repartition("at").sortWithinPartitions("at")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held = None

        def block(rows):
            ids = rows.column(1).to_numpy()
            x = np.asarray(rows.column(3).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(ids), -1)
            return _best_links(ids, x, k, rows.column(4).to_numpy(), rows.column(2).to_numpy(zero_copy_only=False))

        def pack(found):
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["node", "neighbor", "distance"])

        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch if held is None else pa.concat_batches([held, batch])
            at = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist()]
            found = [block(batch.slice(a, b - a)) for a, b in zip(cuts, cuts[1:], strict=False)]
            held = batch.slice(cuts[-1])  # the last node's rows may go on; there are 2 * sample + k + 1 at most
            if found:
                yield pack(found)
        if held is not None:
            yield pack([block(held)])

    return rows.mapInArrow(run, _FOUND)


def neighbour_descent(vectors: DataFrame, k: int, rounds: int = 12, sample: int | None = None, delta: float = 0.001, seed: int = 1234, stats: list[dict] | None = None, wide: int | None = None) -> DataFrame:
    """(vec_id, rank, neighbor, distance): about the k nearest others of every vector by squared L2.

    First links come from blocks of BLOCK rows along DIRECTIONS random directions. In a round, nodes that are linked to or
    from one node meet there: pairs of which one is a fresh link are compared in the node's task, and those nearer than
    what both have become links. Of the links to a node only `sample` (k by default) fresh and as many old ones take
    part, drawn anew each round, so hubs are no hot keys: a round shuffles at most (wide + 2 * sample) vectors a node, in
    proportion to the number of rows. wide: links that a node holds until the end, k by default, more of which find more of
    the k nearest. Links that took part are old from then on. It ends when less than delta of all
    links are new, or after rounds.

    Every round is written to the shared folder; the one before is deleted. Null ids or vectors are left out; ids have to
    be unique; a table of one row or none has no links. stats gets a dict for each round: links, updates, messages.
    """
    sample, held = sample or k, max(k, wide or k)
    v = vectors.where("vec_id is not null and embedding is not null").select("vec_id", "embedding")
    d = v.select(F.size("embedding")).first()
    if d is None:
        return v.select("vec_id", F.lit(0).alias("rank"), F.col("vec_id").alias("neighbor"), F.lit(0.0).alias("distance")).limit(0)
    directions = np.random.default_rng(seed).standard_normal((DIRECTIONS, d[0]))
    found = _first_links(v, held, directions[0], seed)
    for i in range(1, DIRECTIONS):
        found = found.unionByName(_first_links(v, held, directions[i], seed + i))
    links = written(_nearest(found.withColumn("fresh", F.lit(True)), held), "links")
    for r in range(rounds):
        drawn, messages = _meetings(links, v, sample, seed + r)
        # both ends of a fresh link have met what is there once it was drawn
        old = links.join(drawn.where("fresh").select("node", "neighbor", F.lit(True).alias("drawn")), ["node", "neighbor"], "left")
        old = old.select("node", "neighbor", "distance", (F.col("fresh") & F.col("drawn").isNull()).alias("fresh"))
        new = _met(messages, held).withColumn("fresh", F.lit(True))
        nxt = written(_nearest(old.unionByName(new), held), "links")
        total, gone = nxt.agg(F.count("*"), F.count_if(~F.col("fresh"))).first()
        updates = nxt.join(links, ["node", "neighbor"], "left_anti").count()
        if stats is not None:
            stats.append({"round": r, "links": total, "old": gone, "updates": updates, "messages": messages.count()})
        forget(links)
        links = nxt
        if updates <= delta * total:
            break
    return links.where(F.col("rank") <= k).select(F.col("node").alias("vec_id"), "rank", "neighbor", F.round("distance", 6).alias("distance"))
