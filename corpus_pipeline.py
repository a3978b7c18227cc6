"""The corpus pipeline: five stages, each over all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.
docs is a table, as rows are numbered in two reads. In every stage rows that repeat an id are documents each, null and
empty texts are texts without words, texts of any length are taken whole, an empty table gives an empty table, and all
columns of docs are kept but for those that a stage names; columns that clash with a stage's own names are kept as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.common import scratch, stored, table
from nearfield.llm.decontaminate import find_contamination
from nearfield.llm.mixing import mixed_docs
from nearfield.llm.near_join import near_duplicates
from nearfield.llm.token_file import read_tokens, write_tokens
from nearfield.llm.toxicity import fit_toxicity, score_toxicity


def _keyed(docs: DataFrame) -> DataFrame:
    """id, text and a row number, to meet verdicts by: ids may be null or repeated."""
    return docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row_"))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs less the rows of the numbers in `gone`. The whole row travels as one column, so no name of it can clash."""
    rows = docs.select(F.monotonically_increasing_id().alias("row_"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own_"))
    return rows.join(gone, "row_", "left_anti").select("own_.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below 0.3. The classifier is fitted on the labelled ones of this stage's own input; without
    labels of both classes all documents stay, as do those without words."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    bad = stored(score_toxicity(_keyed(docs), model, "row_").where("predicted = 1").select("row_"), "toxic")
    return _without(docs, bad)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of five-word Jaccard similarity of at least 0.8 connect: that of the least
    id, null last, whatever the order of the rows. Documents without words are like nothing and stay."""
    rows = _keyed(docs).withColumn("key_", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_"))
    gone = stored(near_duplicates(rows, id_col="key_").where("not kept").select("key_.row_"), "copies")
    return _without(docs, gone)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no ten-word window of a benchmark item occurs; an empty benchmark leaves all."""
    hit = stored(find_contamination(_keyed(docs), table(spark, sf_dir, "benchmark"), id_col="row_").where("size(spans) > 0").select("row_"), "contaminated")
    return _without(docs, hit)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each whole copy of a document that it takes, and for each part, whose n_chars is counted again.
    Documents without words are in no mix; a null source is a source."""
    return mixed_docs(docs)


def write_token_file(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token file's documents, read back from it: a row for each row of docs, (doc_id, start, n_tokens, ids_crc32). Null
    ids come first; null and empty texts are the end id alone."""
    path = scratch(spark, "pipeline-tokens")
    write_tokens(docs, path, "word_bpe_49k.json")
    return read_tokens(spark, path)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_file", write_token_file),
]

#: Decoding, forests and coders aren't SQL's; each stage is tested against what brute force says of its input instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
