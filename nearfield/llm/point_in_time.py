"""Point-in-time feature join: an active-rank bitset sweep over chunks of a source's time."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import stored, table

#: Seconds (or whatever unit times have) of a chunk, a power of two.
CHUNK = 64
#: Beyond this age a version is stale.
STALE_AGE = 120


def _sweep(batches: Iterator) -> Iterator:
    """Rows (source, chunk, kind, at, hi, w, t), sorted by source, chunk, kind and w: versions active from at up to hi, of
    kind 0, and questions at at, of kind 1.

    A chunk's versions come in winning order, the least first, so that a version's rank is how many came before it; each
    toggles its rank's bit where it starts and where it expires. At the chunk's first question the toggles are summed
    (exclusive or) from second to second, and the highest bit set at a second is that second's winner. A chunk has at
    most as many versions as intervals, so what is kept is bounded by the chunk's length alone; questions pass.
    """
    import pyarrow as pa

    key = winner = None
    toggles: dict[int, int] = {}
    ranked: list = []  # the current chunk's versions, least first
    for batch in batches:
        source, chunk, kind, at, hi = (batch.column(i).to_pylist() for i in range(5))
        # versions that the last batch ended with stand before those of this one
        fresh: list[int] = []
        first, count = 0, len(ranked)
        asked, picked = [], []
        for i in range(batch.num_rows):
            if (source[i], chunk[i]) != key:
                key, toggles, winner = (source[i], chunk[i]), {}, None
                first, count = len(ranked) + len(fresh), 0
            if kind[i] == 0:
                bit = 1 << count
                toggles[at[i]] = toggles.get(at[i], 0) ^ bit
                toggles[hi[i]] = toggles.get(hi[i], 0) ^ bit
                fresh.append(i)
                count += 1
                continue
            if winner is None:
                winner, active = [], 0
                for s in range(max(toggles, default=-1) + 1):
                    active ^= toggles.get(s, 0)
                    winner.append(active.bit_length() - 1)
            rank = winner[at[i]] if at[i] < len(winner) else -1
            asked.append(i)
            picked.append(first + rank if rank >= 0 else None)
        w = batch.column(5)
        values = pa.concat_arrays([pa.array(ranked, w.type), w.take(pa.array(fresh, pa.int64()))])
        ranked = values.slice(first, count).to_pylist()
        if asked:
            rows = batch.take(pa.array(asked, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(6), values.take(pa.array(picked, pa.int64()))], ["source", "t", "w"])


def point_in_time(versions: DataFrame, asks: DataFrame, start: Column, end: Column, order: Column, keep: Column, source_col: str = "source", ask_source: str = "source", ask_time: str = "t", chunk: int = CHUNK) -> DataFrame:
    """asks with the version that wins at each one's source and time: column w, a struct (order, keep), null without one.

    Args: versions and asks: any tables; source_col and ask_source have one type, ask_time and the columns start and end
    are whole numbers. A version is active from start up to, but not at, end; a null end is never, a null start or source
    is never active. order: a struct (or value) whose greatest wins; keep: a struct of what else to return of the
    winner; among equal orders the greatest keep wins, so repeated rows change nothing. chunk: a power of two.

    Time is cut into chunks. Where a version is active in a part of a chunk it stands in the chunk with its seconds; the
    whole chunks between are covered by aligned nodes of 1, 2, 4, 8... chunks, so that a version of any length has at
    most two parts and twice as many nodes as a binary logarithm. Versions of one interval within a chunk or node are
    aggregated to their winner, before the shuffle already, so a chunk has at most chunk * (chunk + 1) / 2 of them and a
    larger node one, whatever a source's share of all rows and however many versions a second has: no group grows with
    the input. Chunks that are asked about inherit the winner of the nodes around them, as one more version of the whole
    chunk; then each chunk is swept. Questions of one source and second are asked once.

    Two numbers go to the driver (the first and last second asked); nothing has to be broadcast. What is shuffled are
    nodes, chunks asked about, questions, and the rows of asks to their answers, never other columns of versions.

    A row for each row of asks, with all its columns and w: a null time or source has no version; an empty table of
    versions gives nulls, an empty table of asks no rows. Columns of versions other than those named are not read.
    """
    shift = chunk.bit_length() - 1
    if chunk != 1 << shift:
        raise ValueError("chunk has to be a power of two")
    low, high = asks.agg(F.min(ask_time), F.max(ask_time)).first()
    w = F.struct(order.alias("order"), keep.alias("keep"))
    if low is None:
        kind = versions.select(w.alias("w")).schema["w"].dataType
        return asks.withColumn("w", F.lit(None).cast(kind))
    # only what the questions can reach, counted from the first
    v = versions.select(F.col(source_col).alias("source"), F.greatest(start.cast("long"), F.lit(low)).alias("a"), F.least(F.coalesce(end.cast("long"), F.lit(high + 1)), F.lit(high + 1)).alias("b"), start.isNotNull().alias("known"), w.alias("w"))
    v = v.where("known and source is not null and a < b").select("source", (F.col("a") - low).alias("a"), (F.col("b") - low).alias("b"), "w")
    top = max(0, ((high - low) >> shift).bit_length())
    first, last = F.shiftright("a", shift), F.shiftright(F.col("b") - 1, shift)
    part = lambda node, lo, hi: F.struct(F.lit(0).alias("level"), node.alias("node"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))
    mod = lambda x: x - F.shiftleft(F.shiftright(x, shift), shift)
    one = F.array(part(first, mod(F.col("a")), F.col("b") - F.shiftleft(first, shift)))
    ends = F.array(part(first, mod(F.col("a")), F.lit(chunk)), part(last, F.lit(0), F.col("b") - F.shiftleft(last, shift)))
    # whole chunks first + 1 .. last - 1: at each level the odd ends stand alone, the rest goes one level up
    covers, x, y = [], first + 1, last
    for level in range(top + 1):
        whole = lambda node, level=level: F.struct(F.lit(level).alias("level"), node.alias("node"), F.lit(0).alias("lo"), F.lit(chunk if level == 0 else 1).alias("hi"))
        covers += [F.when((x < y) & (x % 2 == 1), whole(x)), F.when((x < y) & (y % 2 == 1), whole(y - 1))]
        x, y = F.shiftright(x + 1, 1), F.shiftright(y, 1)
    spans = F.when(first == last, one).otherwise(F.concat(ends, F.array_compact(F.array(*covers))))
    nodes = stored(v.select("source", "w", F.inline(spans)).groupBy("source", "level", "node", "lo", "hi").agg(F.max("w").alias("w")), "nodes")
    at = F.col("t") - low
    q = asks.select(F.col(ask_source).alias("source"), F.col(ask_time).cast("long").alias("t")).where("source is not null and t is not null").distinct()
    q = q.select("source", F.shiftright(at, shift).alias("chunk"), mod(at).cast("int").alias("at"), "t")
    around = F.explode(F.sequence(F.lit(1), F.lit(top))) if top else F.lit(0)
    up = q.select("source", "chunk").distinct().select("source", "chunk", around.alias("level")).withColumn("node", F.expr("shiftright(chunk, level)"))
    # a source's largest nodes have many chunks below them; adaptive execution splits such a join
    above = nodes.where("level > 0").select("source", "level", "node", "w").join(up, ["source", "level", "node"]).groupBy("source", "chunk").agg(F.max("w").alias("w"))
    whole = above.select("source", "chunk", F.lit(0).alias("kind"), F.lit(0).alias("at"), F.lit(chunk).alias("hi"), "w", F.lit(None).cast("long").alias("t"))
    within = nodes.where("level = 0").select("source", F.col("node").alias("chunk"), F.lit(0).alias("kind"), F.col("lo").alias("at"), "hi", "w", F.lit(None).cast("long").alias("t"))
    questions = q.select("source", "chunk", F.lit(1).alias("kind"), "at", F.lit(0).alias("hi"), F.lit(None).cast(nodes.schema["w"].dataType).alias("w"), "t")
    rows = within.unionByName(whole).unionByName(questions).repartition("source", "chunk").sortWithinPartitions("source", "chunk", "kind", "w")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    answers = rows.mapInArrow(_sweep, f"source {kinds['source']}, t long, w {kinds['w']}").where("w is not null").select(F.col("source").alias("s_"), F.col("t").alias("t_"), "w")
    own = asks.select(F.struct(*[F.col(f"`{c}`") for c in asks.columns]).alias("own_"), F.col(ask_source).alias("ask_s_"), F.col(ask_time).cast("long").alias("ask_t_"))
    out = own.join(answers, (F.col("ask_s_") == F.col("s_")) & (F.col("ask_t_") == F.col("t_")), "left")
    return out.select("own_.*", "w")


def hashed(doc_id: Column, group: int) -> Column:
    """The group-th eight hexadecimal digits of the sha256 of the decimal id, as an unsigned number."""
    return F.conv(F.substring(F.sha2(doc_id.cast("string").cast("binary"), 256), 8 * group + 1, 8), 16, 10).cast("long")


def op11_point_in_time(spark, sf_dir: str) -> DataFrame:
    """The version of its document's source that each label sees.

    A label whose document isn't there, has no source or no id asks without a source: `none`. Where rows of documents
    repeat an id, its least source counts. A row for each row of labels. Of documents three narrow columns are read."""
    docs = table(spark, sf_dir, "documents")
    event = hashed(F.col("doc_id"), 0) % 50000
    arrival = event - 60 + hashed(F.col("doc_id"), 1) % 600
    expiry = event + hashed(F.col("doc_id"), 2) % 900
    sources = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min("source").alias("source"))
    asks = table(spark, sf_dir, "labels").select("doc_id", (hashed(F.col("doc_id"), 3) % 50000).alias("t")).join(sources, "doc_id", "left")
    asks = stored(asks, "asks")
    versions = docs.select("doc_id", "source", "n_chars", "lang", event.alias("event"), arrival.alias("arrival"), expiry.alias("expiry"))
    order = F.struct(F.col("event"), (-F.col("arrival")).alias("early"), F.col("doc_id"))
    won = point_in_time(versions, asks, F.greatest("event", "arrival"), F.col("expiry"), order, F.struct("n_chars", "lang"))
    age = F.col("t") - F.col("w.order.event")
    fresh = age <= STALE_AGE
    status = F.when(age.isNull(), "none").when(fresh, "fresh").otherwise("stale")
    return won.select("doc_id", "t", F.col("w.order.doc_id").alias("version_id"), age.alias("age"), status.alias("status"), F.when(fresh, F.col("w.keep.n_chars")).alias("n_chars"), F.when(fresh, F.col("w.keep.lang")).alias("lang"))


OP11_SQL = """
WITH h AS (SELECT *, sha256(CAST(doc_id AS VARCHAR)) AS x FROM documents),
v AS (SELECT doc_id, source, n_chars, lang, event, event - 60 + b % 600 AS arrival, event + c % 900 AS expiry
  FROM (SELECT *, CAST('0x' || substr(x, 1, 8) AS BIGINT) % 50000 AS event, CAST('0x' || substr(x, 9, 8) AS BIGINT) AS b, CAST('0x' || substr(x, 17, 8) AS BIGINT) AS c FROM h)),
s AS (SELECT doc_id, min(source) AS source FROM documents GROUP BY 1),
l AS (SELECT row_number() OVER () AS r, doc_id, CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 25, 8) AS BIGINT) % 50000 AS t FROM labels),
q AS (SELECT l.*, s.source FROM l LEFT JOIN s USING (doc_id)),
w AS (SELECT r, v.*, row_number() OVER (PARTITION BY r ORDER BY event DESC, arrival, v.doc_id DESC, n_chars DESC NULLS LAST, lang DESC NULLS LAST) AS k
  FROM (SELECT r, t, source, unnest([t // 1000, t // 1000 - 1]) AS slot FROM q) q JOIN v ON q.source = v.source AND v.event // 1000 = slot AND event <= t AND arrival <= t AND t < expiry)
SELECT q.doc_id, q.t, w.doc_id AS version_id, q.t - event AS age, CASE WHEN w.r IS NULL THEN 'none' WHEN q.t - event > 120 THEN 'stale' ELSE 'fresh' END AS status,
  CASE WHEN q.t - event <= 120 THEN w.n_chars END AS n_chars, CASE WHEN q.t - event <= 120 THEN lang END AS lang
FROM q LEFT JOIN w ON q.r = w.r AND k = 1
"""
