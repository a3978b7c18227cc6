"""Fill-in-middle: cuts at unit ordinals, found as relations of blocks and units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.common import table

#: Marks of the three parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A unit: a run of letters, or one other character.
UNIT = "[A-Za-z]+|[^A-Za-z]"
#: Characters of a block, and the letters that its last run goes on with.
BLOCK = 128


def n_units(text: Column) -> Column:
    """Units of a text: with each run of letters as one character, units are characters."""
    return F.length(F.regexp_replace(text, "[A-Za-z]+", "x")).cast("long")


def cut_offsets(texts: DataFrame, cuts: DataFrame, key: str, text_col: str = "text", ordinal: str = "ordinal") -> DataFrame:
    """cuts (key, ordinal) with `offset`: code points of the text before its unit number `ordinal`, counted from 0.

    A text is cut into blocks of some BLOCK characters that end where a unit ends; window sums of the blocks' lengths and
    numbers of units say in which block a cut falls. Only blocks with a cut are exploded into units, whose lengths a
    second window sums. Where texts and cuts are dealt by key already, nothing is shuffled. Ordinals from 0 to the
    number of units less one are found; others, and those of empty or null texts or of null keys, have no row. A text of
    any length is one pass; a run of letters of any length is one unit of one block. key has to be unique in texts; cuts
    may repeat.
    """
    # the outer forms keep Spark from testing the arrays' sizes, and so from making them twice
    blocks = texts.select(key, F.posexplode_outer(F.regexp_extract_all(F.col(text_col), F.lit(f"(?s).{{1,{BLOCK}}}[A-Za-z]*+"), F.lit(0))).alias("block", "chars"))
    before = Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("units", n_units(F.col("chars")))
    blocks = blocks.select(key, "chars", "units", F.coalesce(F.sum("units").over(before), F.lit(0)).alias("u0"), F.coalesce(F.sum(F.length("chars").cast("long")).over(before), F.lit(0)).alias("c0"))
    cuts = cuts.groupBy(key, ordinal).agg(F.count("*").alias("times"))
    inside = (F.col(f"c.{ordinal}") >= F.col("b.u0")) & (F.col(f"c.{ordinal}") < F.col("b.u0") + F.col("b.units"))
    hit = blocks.alias("b").join(cuts.alias("c"), (F.col(f"b.{key}") == F.col(f"c.{key}")) & inside)
    hit = hit.select("c.*", "b.u0", "b.c0", F.posexplode_outer(F.regexp_extract_all(F.col("b.chars"), F.lit(UNIT), F.lit(0))).alias("unit", "chars"))
    run = Window.partitionBy(key, ordinal).orderBy("unit").rowsBetween(Window.unboundedPreceding, -1)
    hit = hit.select(key, ordinal, "times", (F.col("u0") + F.col("unit")).alias("at_"), (F.col("c0") + F.coalesce(F.sum(F.length("chars").cast("long")).over(run), F.lit(0))).alias("offset"))
    return hit.where(F.col("at_") == F.col(ordinal)).select(key, ordinal, "offset", "times")


def fill_in_middle(docs: DataFrame, choices: Column, text_col: str = "text", shards: int | None = None) -> DataFrame:
    """docs with n, form, prefix_chars, middle_chars and output; text_col is the whole text, null as empty.

    Args: choices: a struct (first, second, plain, spm) over docs' columns and `n`, the text's number of units: the two
    cuts in any order, from 0 to n; whether the text stays as it is; whether the suffix goes first. shards: how many
    parts texts are dealt to by row, spark.sql.shuffle.partitions by default.

    psm is PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle; spm is SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle. A text
    that is empty or holds a mark is plain whatever the choice, so restore() is exact. Texts are shuffled once, by a
    number for each row; blocks, windows, joins and the substrings all stay in these parts.

    A row for each row of docs; repeated rows are rows each; a docs column named like a new one is replaced, one named
    choice_ may not be there. docs has to be a table or a stable plan, as its rows are numbered.
    """
    new = ("n", "form", "prefix_chars", "middle_chars", "output")
    if text_col in new:
        raise ValueError(f"{text_col} is the name of a new column")
    text = F.coalesce(text_col, F.lit(""))
    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    own = F.struct(F.lit(0), *[F.col(f"`{c}`") for c in docs.columns if c not in new and c != text_col])
    counted = docs.withColumn("n", n_units(text)).select("*", choices.alias("choice_"))
    pick = lambda c: F.col(f"choice_.{c}")
    all_ = F.struct(own.alias("own"), text.alias("text"), F.col("n").alias("n"), ((text == "") | marked | pick("plain")).alias("plain"), pick("spm").alias("spm"), F.least(pick("first"), pick("second")).alias("low"), F.greatest(pick("first"), pick("second")).alias("high"))
    # one array of one struct, which no branch below reads a part of, so that one exchange serves them all
    rows = counted.select(F.monotonically_increasing_id().alias("row"), F.array(all_).alias("x"))
    rows = rows.repartition(int(shards or docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "row")
    x = lambda c: F.element_at("x", 1).getField(c)
    # nor a filter on what is plain: it would be pushed below the exchange and make another one of it
    both = F.when(~x("plain"), F.array_distinct(F.array(x("low"), x("high"))))
    found = cut_offsets(rows.select("row", F.when(~x("plain"), x("text")).alias("text")), rows.select("row", F.explode_outer(both).alias("ordinal")), "row")
    offsets = found.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("ordinal", "offset"))).alias("offsets"))
    out = rows.join(offsets, "row", "left").select(x("own").alias("own_"), x("text").alias("text_"), x("n").alias("n_"), x("plain").alias("plain_"), x("spm").alias("spm_"), x("low").alias("low_"), x("high").alias("high_"), "offsets")
    chars = F.length("text_").cast("long")
    a = F.when(F.col("low_") == F.col("n_"), chars).otherwise(F.element_at("offsets", F.col("low_")))
    b = F.when(F.col("high_") == F.col("n_"), chars).otherwise(F.element_at("offsets", F.col("high_")))
    out = out.withColumn("a_", F.when(~F.col("plain_"), a)).withColumn("b_", F.when(~F.col("plain_"), b))
    part = lambda x, y: F.substring("text_", (x + 1).cast("int"), (y - x).cast("int"))
    prefix, middle, suffix = part(F.lit(0), F.col("a_")), part(F.col("a_"), F.col("b_")), part(F.col("b_"), chars)
    form = F.when(F.col("plain_"), "plain").when(F.col("spm_"), "spm").otherwise("psm")
    output = F.when(F.col("plain_"), F.col("text_")).when(F.col("spm_"), F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)).otherwise(F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
    made = (F.col("n_"), form, F.col("a_"), F.col("b_") - F.col("a_"), output)
    kept = [F.col("text_").alias(c) if c == text_col else F.col(f"own_.`{c}`") for c in docs.columns if c not in new]
    return out.select(*kept, *[e.alias(c) for c, e in zip(new, made, strict=True)])


def restore(output: Column, form: Column) -> Column:
    """The text that an output and its form stand for."""
    first, second = F.when(form == "spm", SUFFIX).otherwise(PREFIX), F.when(form == "spm", PREFIX).otherwise(SUFFIX)
    one, two = F.locate(SUFFIX, output), F.locate(MIDDLE, output)
    one = F.when(form == "spm", F.locate(PREFIX, output)).otherwise(one)
    head = F.substr(output, F.length(first) + 1, one - F.length(first) - 1)
    tail = F.substr(output, one + F.length(second), two - one - F.length(second))
    middle = F.substr(output, two + len(MIDDLE))
    return F.when(form == "plain", output).when(form == "spm", F.concat(tail, middle, head)).otherwise(F.concat(head, middle, tail))


def hashed_choices(doc_id: Column, seed: str = "1:") -> Column:
    """Choices from the sha256 of seed and decimal id; a null id counts as empty text."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = lambda i: F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")
    units = F.col("n") + 1
    return F.struct((h(0) % units).alias("first"), (h(1) % units).alias("second"), (h(2) % 100 >= 90).alias("plain"), (h(3) % 100 < 20).alias("spm"))


def op13_fill_middle(spark, sf_dir: str) -> DataFrame:
    """Every document in its fill-in-middle form, and read back. Null texts are empty and plain; more in fill_in_middle."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = fill_in_middle(docs, hashed_choices(F.col("doc_id")))
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP13_SQL = """
WITH u AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || substr(x, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(x, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(x, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(x, 25, 8) AS BIGINT) AS h4 FROM u),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS i, greatest(h1 % (n + 1), h2 % (n + 1)) AS j,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1 : i], '') AS p, array_to_string(u[i + 1 : j], '') AS m, array_to_string(u[j + 1 :], '') AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""
