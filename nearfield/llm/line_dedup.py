"""Line dedup: lines that many documents share stay in one of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import stored, table

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The six characters of [\x20\x09-\x0D].
_BLANKS = " \t\n\x0b\x0c\r"


def two_hashes(*what: Column) -> tuple[Column, Column]:
    """128 bits in two longs, so that a collision is out of question at any corpus size."""
    return F.xxhash64(*what), F.xxhash64(F.lit("two"), *what)


def line_hashes(text: Column, least: int) -> Column:
    """The array of (pos, a, b) of a text's lines whose key has at least `least` code points. A line's key is the line
    without white space at its ends, A-Z lower-cased."""
    bare = F.transform(F.split(text, "\n", -1), lambda line, i: F.struct(i.alias("pos"), F.btrim(line, F.lit(_BLANKS)).alias("key")))
    a, b = lambda k: two_hashes(k)[0], lambda k: two_hashes(k)[1]
    lower = lambda x: F.translate(x["key"], _UPPER, _LOWER)
    return F.transform(F.filter(bare, lambda x: F.length(x["key"]) >= least), lambda x: F.struct(x["pos"].alias("pos"), a(lower(x)).alias("a"), b(lower(x)).alias("b")))


def without_lines(text: Column, gone: Column) -> Column:
    """The text less the lines at the positions in `gone` (distinct, any order), in one pass over both."""
    at = F.sort_array(gone)
    before = F.concat(F.array(F.lit(-1)), F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0))))
    marks = F.flatten(F.zip_with(at, before, lambda p, q: F.concat(F.array_repeat(F.lit(False), p - q - 1), F.array(F.lit(True)))))
    # array_join leaves nulls out
    return F.array_join(F.zip_with(F.split(text, "\n", -1), marks, lambda line, m: F.when(m, F.lit(None).cast("string")).otherwise(line)), "\n")


def dedup_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' texts without the lines that at least min_docs documents share, except in the largest id that holds one.

    Each text is hashed once: its long lines are exploded and written out as (row, position, hash). Distinct ids are
    counted for each hash in two steps, dealt by hash and id first, so that a line of every document reaches the second
    step as a row for each task. Hashes over the threshold meet the exploded lines in a join that Spark broadcasts where
    it is small, and otherwise deals anew where one hash is frequent. What comes back to a document is the positions of
    its dropped lines; the JVM cuts them out, in time and memory in proportion to the text. A row is known by 128 bits of
    its id and text, so the order in which docs is read doesn't matter, and equal rows meet the same positions.

    Returns id_col, text (null becomes empty), n_lines, n_dropped, a row for each row of docs. Rows that repeat an id are
    one document to the count, and all rows of the largest id keep the line. All rows of a null id are one document,
    smaller than any. Null and empty texts are one empty line; texts may have any number of lines. An empty table gives
    no rows. Other columns of docs are not read, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    k, k2 = two_hashes(F.col("id"), F.col("text"))
    # hashes come before the explosion, or a text would be hashed again for each of its lines
    hashed = rows.select(k.alias("k"), k2.alias("k2"), "id", line_hashes(F.col("text"), min_chars).alias("x"))
    lines = hashed.select("k", "k2", "id", F.explode("x").alias("x"))
    lines = stored(lines.select("k", "k2", "id", "x.pos", "x.a", "x.b"), "lines")
    holders = lines.select("a", "b", "id").distinct()
    common = holders.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("id").alias("keep")).where(F.col("n") >= min_docs)
    common = stored(common.select("a", "b", "keep"), "common-lines")
    dropped = lines.join(common, ["a", "b"]).where(~F.col("id").eqNullSafe(F.col("keep")))
    positions = dropped.groupBy("k", "k2").agg(F.collect_set("pos").alias("gone"))
    whole = rows.withColumn("k", k).withColumn("k2", k2).join(positions, ["k", "k2"], "left")
    text, gone = F.col("text"), F.col("gone")
    n_lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return whole.select(
        F.col("id").alias(id_col), F.when(gone.isNull(), text).otherwise(without_lines(text, gone)).alias("text"),
        n_lines.cast("long").alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Lines before and after, and the hash of what stays, of every document. Odd rows: as dedup_lines says."""
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT doc_id, line, pos, c.key IS NOT NULL AND doc_id <> keep AS dropped FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
