"""The queries of this subpackage's operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.best_fit import op12_best_fit
from nearfield.llm.chat import OP10_SQL, op10_chat
from nearfield.llm.common import table
from nearfield.llm.decontaminate import OP6_SQL, op6_decontamination
from nearfield.llm.fill_middle import OP13_SQL, op13_fill_middle
from nearfield.llm.lattice import op2_lattice
from nearfield.llm.line_dedup import OP5_SQL, op5_line_dedup
from nearfield.llm.mixing import op9_mixing
from nearfield.llm.near_join import op8_near_join
from nearfield.llm.point_in_time import OP11_SQL, op11_point_in_time
from nearfield.llm.quality import DecisionList, judge_quality, op7_quality
from nearfield.llm.token_counts import op4_token_counts
from nearfield.llm.token_file import op3_token_file
from nearfield.llm.toxicity import op1_toxicity

QUERIES = {f.__name__: f for f in (op1_toxicity, op2_lattice, op3_token_file, op4_token_counts, op5_line_dedup, op6_decontamination, op7_quality, op8_near_join, op9_mixing, op10_chat, op11_point_in_time, op12_best_fit, op13_fill_middle)}
SQL = {"op5_line_dedup": OP5_SQL, "op6_decontamination": OP6_SQL, "op10_chat": OP10_SQL, "op11_point_in_time": OP11_SQL, "op13_fill_middle": OP13_SQL}


def token_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4's part that SQL can state: bytes, and whether there are tokens where there are words."""
    words = F.regexp_like(F.coalesce("text", F.lit("")), F.lit(r"[^\x00-\x20]"))
    docs = table(spark, sf_dir, "documents").select("doc_id", words.alias("words"))
    return op4_token_counts(spark, sf_dir).join(docs, "doc_id").select("doc_id", "n_bytes", (~F.col("words") | (F.col("n_tokens") > 0)).alias("has_tokens"))


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7's counts and base rules, without the learned list."""
    return judge_quality(table(spark, sf_dir, "documents"), DecisionList()).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9's sizes and targets, and that no document is taken over twice."""
    return op9_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), (F.col("taken") <= 2 * F.col("size")).alias("within"))


QUERIES |= {f.__name__: f for f in (token_bytes, quality_counts, mixing_targets)}
SQL["token_bytes"] = "SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes, TRUE AS has_tokens FROM documents"
SQL["quality_counts"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
r AS (SELECT doc_id, i FROM g JOIN (SELECT doc_id, g FROM g GROUP BY ALL HAVING count(*) > 1) USING (doc_id, g)),
rw AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM r) GROUP BY 1),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rw.n, 0) AS BIGINT) AS n_repeat_words,
  len(w) < 10 OR 100 * coalesce(rw.n, 0) > 20 * len(w) AS base_failed
FROM d LEFT JOIN l USING (doc_id) LEFT JOIN rw USING (doc_id)
"""
SQL["mixing_targets"] = r"""
WITH z AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size) AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM z GROUP BY source),
c AS (SELECT source, n, 2.0 * n AS cap, CASE i % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / w, source) AS j, 1.5 * sum(n) OVER () AS total, sum(cap) OVER (ORDER BY cap / w, source) - cap AS filled, sum(w) OVER () - sum(w) OVER (ORDER BY cap / w, source) + w AS open FROM c),
h AS (SELECT arg_min((total - filled) / open, j) AS level FROM o WHERE (total - filled) / open <= cap / w)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(n AS BIGINT) AS source_size, round(CAST(least(cap, w * level) AS DOUBLE), 3) AS target, TRUE AS within
FROM z JOIN c ON z.source IS NOT DISTINCT FROM c.source, h
"""
