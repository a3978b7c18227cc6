"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks."""

from __future__ import annotations

import heapq
import re
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.common import SPACE, stored, table

#: Code points sort as the bytes of UTF-8, which is how Spark compares strings.
CYCLE = (3, 1, 2)


def targets(sizes: list[int], weights: list[int], share: Fraction = Fraction(3, 2), cap: int = 2) -> list[Fraction]:
    """share of all sizes, dealt by weight; targets stop at cap times their size, the excess is dealt again by weight."""
    out = [Fraction(0)] * len(sizes)
    rest, open_ = share * sum(sizes), [i for i in range(len(sizes)) if weights[i] > 0]
    while open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if rest * weights[i] > cap * sizes[i] * total]
        if not full:
            for i in open_:
                out[i] = rest * weights[i] / total
            break
        for i in full:
            out[i] = Fraction(cap * sizes[i])
        rest -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def sainte_lague(seats: int, votes: list[Fraction | int], most: list[int]) -> list[int]:
    """seats given one after another to the highest quotient votes / (2 * won + 1), ties to the first; at most most[i].

    Instead of dealing every seat, all but a few are found at once: at a divisor d, each party wins
    floor(votes / d + 1/2) seats, as many as it has quotients of at least d / 2 in the scheme's terms.
    """
    votes = [Fraction(v) for v in votes]
    won = [0] * len(votes)
    seats = min(seats, sum(m for m, v in zip(most, votes, strict=True) if v > 0))
    if seats <= 0:
        return won
    at = lambda d: [min(m, int(v / d + Fraction(1, 2))) if v > 0 else 0 for v, m in zip(votes, most, strict=True)]
    high = max(votes) * 2 + 1  # nobody wins a seat
    low = min(v for v in votes if v > 0) / (max(most) + 1)  # everybody is full
    for _ in range(200):
        if seats - sum(won) <= len(votes):
            break
        mid = (low + high) / 2
        mid = Fraction(mid).limit_denominator(1 << 40) or mid
        got = at(mid)
        if sum(got) <= seats:
            won, high = got, mid
        else:
            low = mid
    queue = [(-v / (2 * w + 1), i) for i, (v, w, m) in enumerate(zip(votes, won, most, strict=True)) if v > 0 and w < m]
    heapq.heapify(queue)
    for _ in range(seats - sum(won)):
        _, i = heapq.heappop(queue)
        won[i] += 1
        if won[i] < most[i]:
            heapq.heappush(queue, (-votes[i] / (2 * won[i] + 1), i))
    return won


def size_of(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in the text; null has none."""
    text = F.coalesce(text, F.lit(""))
    return F.expr("0L") + F.length(F.regexp_replace(F.regexp_replace(text, rf"[^\x20\x09-\x0D]+", "x"), rf"{SPACE}+", ""))


def mix(docs: DataFrame, size: Column, id_col: str = "doc_id", source_col: str = "source", weights: tuple[int, ...] = CYCLE, share: Fraction = Fraction(3, 2), cap: int = 2, block_tokens: int = 64, max_shards: int = 4096, seed: int = 17, place: Column | None = None) -> DataFrame:
    """How many tokens of every document a mix of sources takes.

    Sources, ordered by code point with null last, weigh as `weights` in turn and share `share` of all tokens; a target
    stops at cap times its source's size. A source's documents are dealt by a seeded hash to shards, in numbers that
    follow its size, so a source of a third of all rows is many shards. Within a shard, documents stand in a seeded
    order, end to end, and are cut into blocks of equal tokens. Sainte-Lague gives each source its quota of blocks
    from its target, and again each shard from its source's quota. A shard takes its blocks round by round from a
    seeded start: a quota of 1.3 times its blocks is every block once and three tenths of them twice.

    Three aggregates or shuffles carry ids and sizes only, never texts. The driver holds a row for each source and for
    each shard: at most the number of sources plus max_shards. Block length shrinks where a source is so small that
    rounding would matter.

    place, if given, is hashed in the place of the id: rows of one place and id are as good as one another.

    Returns id_col, size, source_size, target, taken, first (position in the document of a partly taken run), and full
    (times that the whole document is taken), a row for each row of docs. Documents of no tokens have taken 0; an
    empty table gives no rows; rows that repeat an id are documents each; a null id is hashed as a value of its own.
    """
    spark = docs.sparkSession
    kept = stored(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.cast("long").alias("size"), F.xxhash64(F.lit(seed), F.col(id_col) if place is None else place).alias("h")), "sizes")
    sources = [(r["source"], int(r["n"] or 0)) for r in kept.groupBy("source").agg(F.sum("size").alias("n")).orderBy(F.col("source").asc_nulls_last()).collect()]
    sizes = [n for _, n in sources]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share, cap)
    total = sum(sizes)
    # a rounding error of a block is at most half a percent of the smallest source
    block = max(1, min([block_tokens, *(n // 200 for n in sizes if n)]))
    shards = [max(1, min(-(-n // (block * 1000)), max_shards * n // max(total, 1))) for n in sizes]
    numbered = spark.createDataFrame([(s, i, n, float(t), k) for i, ((s, n), t, k) in enumerate(zip(sources, goal, shards, strict=True))], "source string, source_no int, source_size long, target double, shards int")
    placed = kept.join(F.broadcast(numbered), kept["source"].eqNullSafe(numbered["source"])).drop(numbered["source"])
    placed = placed.withColumn("shard", F.expr("pmod(h, shards)")).select("id", "size", "h", "source_no", "source_size", "target", "shard")
    held = placed.groupBy("source_no", "shard").agg(F.sum("size").alias("n")).orderBy("source_no", "shard").collect()
    by_source: list[list[tuple[int, int]]] = [[] for _ in sizes]
    for r in held:
        by_source[r["source_no"]].append((r["shard"], int(r["n"])))
    blocks = [[-(-n // block) for _, n in own] for own in by_source]
    quota = sainte_lague(int(sum(goal) / block + Fraction(1, 2)), goal, [min(cap * sum(b), -(-int(t) // block)) for b, t in zip(blocks, goal, strict=True)])
    rows = []
    for i, own in enumerate(by_source):
        for (shard, n), b, q in zip(own, blocks[i], sainte_lague(quota[i], [n for _, n in own], [cap * b for b in blocks[i]]), strict=True):
            full, part = divmod(q, b) if b else (0, 0)
            start = (seed * 7919 + i * 104729 + shard * 1299709) % b if b else 0
            rows.append((i, shard, n, full, start * block, part * block, b * block))
    plan = spark.createDataFrame(rows, "source_no int, shard long, shard_size long, full int, start long, run long, ring long")
    order = Window.partitionBy("source_no", "shard").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = placed.withColumn("b", F.sum("size").over(order)).withColumn("a", F.col("b") - F.col("size"))
    laid = laid.join(F.broadcast(plan), ["source_no", "shard"])
    # the run [start, start + run) of the shard's ring of blocks, cut at the ring's end
    lo, hi = F.col("start"), F.col("start") + F.col("run")
    cut = lambda x, y: F.greatest(F.lit(0).cast("long"), F.least(F.col("b"), y) - F.greatest(F.col("a"), x))
    one, two = cut(lo, F.least(hi, F.col("ring"))), cut(F.lit(0).cast("long"), hi - F.col("ring"))
    laid = laid.withColumn("one", one).withColumn("two", two)
    first = F.when(F.col("one") > 0, F.greatest(F.col("a"), lo) - F.col("a")).otherwise(F.lit(0).cast("long"))
    return laid.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("full") * F.col("size") + F.col("one") + F.col("two")).alias("taken"), "full", first.alias("first"), "one", "two")


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def cut_words(text: str, first: int, n: int) -> str:
    """The stretch of a text from its word `first` over n words, white space between them kept."""
    start = end = 0
    for i, m in enumerate(_WORD.finditer(text)):
        if i == first:
            start = m.start()
        if i == first + n - 1:
            end = m.end()
            break
    return text[start:end]


def mixed_docs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """docs as the mix has them: a row for each whole copy that it takes and for each part, with docs' columns.

    Rows are numbered in two reads, so docs has to be a table; the numbers meet the plan of mix() in one shuffle, in which
    no key is hot. Where a row stands in the mix follows from its id, text and source, so it is the same in any order of
    rows. Rows whose words aren't taken go; n_chars, if there, is counted again. A document without words is in no mix;
    equal rows are documents each; texts of any length are cut in one pass.
    """
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    numbered = docs.select(F.monotonically_increasing_id().alias("row_"), own.alias("own_"))
    content = docs.select(F.struct(F.col(id_col), F.monotonically_increasing_id().alias("row_")).alias("key"), F.xxhash64(id_col, text_col, source_col).alias("h"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("n"))
    taken = mix(content, F.col("n"), "key", "source", place=F.col("h"), **how)
    taken = taken.where("taken > 0").select(F.col("key.row_").alias("row_"), F.col("size").alias("size_"), "full", "first", "one", "two")
    # a part of all words is a whole copy
    parts = F.filter(F.array(F.struct(F.lit(0).cast("long").alias("at"), F.col("two").alias("n")), F.struct(F.col("first").alias("at"), F.col("one").alias("n"))), lambda p: p["n"] > 0)
    pieces = F.concat(F.array_repeat(F.struct(F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("n")), F.col("full")), parts)
    out = numbered.join(taken, "row_").withColumn("piece_", F.explode(pieces))

    @F.pandas_udf("string")
    def part(text: pd.Series, at: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else cut_words(t, int(a), int(k)) for t, a, k in zip(text, at, n, strict=True)], dtype=object)

    at = F.when(F.col("piece_.n") == F.col("size_"), -1).otherwise(F.col("piece_.at"))
    whole = F.col("own_").getField(text_col)
    out = out.select("own_", F.when(at < 0, whole).otherwise(part(F.when(at >= 0, whole), at, F.col("piece_.n"))).alias("text_"))
    new = {text_col: F.col("text_")} | ({"n_chars": F.length("text_").cast("long")} if "n_chars" in docs.columns else {})
    return out.select(*[new.get(c, F.col("own_").getField(c)).alias(c) for c in docs.columns])


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    """How much the mix takes of every document. Null texts have no words, a null source is the last; more in mix."""
    out = mix(table(spark, sf_dir, "documents"), size_of(F.col("text")))
    return out.select("doc_id", "size", "source_size", "target", "taken")
