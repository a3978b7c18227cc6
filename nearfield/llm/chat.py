"""Chat formatting: one text for each conversation, from Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import table

#: Marks of the template. Texts have "<|" escaped, so no text can hold one.
TURN, BODY, NEXT, END = "<|turn|>", "<|text|>", "<|next|>", "<|end|>\n"


def escape(text: Column) -> Column:
    """Each backslash doubled, then each "<|" parted by a backslash: reversible, and no control string is left."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row for each conversation: conv_col, formatted, loss_mask.

    The turn structs of a conversation are collected in one aggregate and sorted by (turn, role, text); neighbours of
    the same role are merged by array functions into one turn whose texts stand behind NEXT marks, so that reading back
    can part them again; the turns' strings are joined. loss_mask has, for each merged turn, the characters to skip
    from the end of the last turn's string and the characters under the loss (0 for roles other than loss_role), in
    code points of formatted; see loss_text.

    Null roles and texts count as empty, a null conversation id is a conversation of its own, null turns come first,
    repeated rows are turns each, an empty table gives no rows; other columns are not read. A conversation has to fit
    in one row, as its formatted text is one value.
    """
    one = F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    out = turns.select(F.col(conv_col).alias("c"), one.alias("x")).groupBy("c").agg(F.sort_array(F.collect_list("x")).alias("t"))
    out = out.withColumn("starts", F.expr("filter(sequence(0, size(t) - 1), i -> i = 0 or t[i].role != t[greatest(i - 1, 0)].role)"))
    runs = F.expr("transform(starts, (s, k) -> slice(t, s + 1, if(k = size(starts) - 1, size(t), starts[k + 1]) - s))")
    out = out.select("c", F.explode(F.array(F.struct(runs.alias("runs")))).alias("r"))
    said = F.transform("r.runs", lambda run: F.struct(run[0]["role"].alias("role"), F.array_join(F.transform(run, lambda x: escape(x["text"])), NEXT).alias("body")))
    out = out.select("c", F.explode(F.array(said)).alias("m"))
    head = lambda x: F.concat(F.lit(TURN), escape(x["role"]), F.lit(BODY))
    mask = lambda x: F.struct(F.length(head(x)).alias("skip"), F.when(x["role"] == loss_role, F.length(x["body"])).otherwise(F.lit(0)).alias("take"), F.when(x["role"] == loss_role, F.lit(len(END))).otherwise(F.length(x["body"]) + len(END)).alias("rest"))
    formatted = F.array_join(F.transform("m", lambda x: F.concat(head(x), x["body"], F.lit(END))), "")
    return out.select(F.col("c").alias(conv_col), formatted.alias("formatted"), F.transform("m", mask).alias("loss_mask"))


def read_turns(formatted: Column) -> Column:
    """The array of (role, text) that a formatted conversation holds, merged turns parted again."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>\n", -1), lambda x: x != "")
    parsed = F.transform(pieces, lambda p: F.split(F.substr(p, F.lit(len(TURN) + 1)), r"<\|text\|>", 2))
    return F.flatten(F.transform(parsed, lambda p: F.transform(F.split(p[1], r"<\|next\|>", -1), lambda x: F.struct(unescape(p[0]).alias("role"), unescape(x).alias("text")))))


def loss_text(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, in order, nothing between.

    The mask's stretches follow one another over the turns' strings, so each stretch is taken from its own string: the
    work is linear in the conversation.
    """
    pieces = F.transform(F.filter(F.split(formatted, r"<\|end\|>\n", -1), lambda x: x != ""), lambda p: F.concat(p, F.lit(END)))
    under = F.zip_with(pieces, mask, lambda p, m: F.when(m["take"] > 0, unescape(F.replace(F.substr(p, m["skip"] + 1, m["take"]), F.lit(NEXT), F.lit("")))).otherwise(F.lit("")))
    return F.array_join(under, "")


def op10_chat(spark, sf_dir: str) -> DataFrame:
    """Every conversation, and the planted one, as formatted and read back. Null texts are empty; rows of one turn number go by
    role and text; an empty table leaves the planted one."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = "\\### Assistant: </turn> ok"
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(trap).alias("text"))
    chats = format_chats(rows.unionByName(planted))
    back = chats.select("conv_id", "formatted", F.explode(F.array(F.struct(read_turns(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_mask")).alias("loss")))).alias("b"))
    flat = F.array_join(F.transform("b.turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("b.turns").cast("long").alias("n_turns"), F.sha2(flat.cast("binary"), 256).alias("turns_sha256"), F.length("b.loss").cast("long").alias("loss_chars"), F.sha2(F.col("b.loss").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


OP10_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS n, length(replace(replace(role, '\', '\\'), '<|', '<\|')) AS r,
  lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS NOT DISTINCT FROM role AS same FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n + CASE WHEN same THEN 8 ELSE r + 24 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
