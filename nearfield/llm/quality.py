"""Quality rules: decision lists learned from labelled statistics, as ordered Spark conditional expressions.

Everything that runs over the corpus is a Spark SQL expression; only the fit of the list, on a bounded sample of
labelled statistics, is plain Python on the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import SPACE, table

#: Each statistic as SQL over the columns of text_stats(); every one is defined for empty texts.
RATIOS = {
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(word_chars, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
    "size": "log2(n_words + 1)",
}

#: The starts of 5-word windows found twice or more. Windows are compared by a 64-bit hash within one text. Sorting the
#: (hash, start) pairs puts equal windows side by side, so the work is n log n in the text's words; the let-binding by
#: transform(array(x), ...) keeps x from being evaluated again for every element.
_REPEATED = """
if(size(grams) = size(array_distinct(grams)), cast(array() as array<int>),
  array_sort(transform(array(array_sort(transform(grams, (g, i) -> named_struct('g', g, 'i', i)))),
    s -> transform(filter(transform(s, (x, k) -> named_struct('i', x.i, 'r',
           (k > 0 and s[greatest(k - 1, 0)].g = x.g) or (k < size(s) - 1 and s[least(k + 1, size(s) - 1)].g = x.g))), x -> x.r), x -> x.i))[0]))
"""


def text_stats(docs: DataFrame, text_col: str = "text", window: int = 5) -> DataFrame:
    """docs' columns but the text, with counts of words, characters, symbols, lines and repeats of each whole text."""
    space = SPACE.replace("\\", "\\\\")
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumn("t_", text).drop(text_col)
    out = out.withColumn("w_", F.expr(f"filter(split(t_, '{space}+'), x -> x != '')"))
    gram = ", ".join(f"w[i + {j}]" for j in range(window))
    out = out.withColumn("g_", F.explode(F.array(F.struct(F.col("w_").alias("w"), F.col("t_").alias("t")))))  # a barrier: the words are split once
    out = out.withColumn("grams", F.expr(f"transform(array(g_.w), w -> if(size(w) < {window}, cast(array() as array<bigint>), transform(sequence(0, size(w) - {window}), i -> xxhash64({gram}))))[0]"))
    out = out.withColumn("g_", F.explode(F.array(F.struct(F.col("grams"), F.col("g_.w").alias("w"), F.col("g_.t").alias("t"), F.expr("filter(split(g_.t, '\\n', -1), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')").alias("lines"), F.regexp_replace("g_.t", rf"{SPACE}+", "").alias("solid"))))).drop("grams", "w_", "t_")
    out = out.withColumn("s_", F.explode(F.array(F.expr(_REPEATED.replace("grams", "g_.grams")))))
    length = lambda x: F.length(x).cast("long")
    solid = F.col("g_.solid")
    without = lambda chars: length(solid) - length(F.translate(solid, chars, ""))
    counts = {
        "n_words": F.size("g_.w").cast("long"),
        "word_chars": length(solid),
        "n_symbols": without("#*$%&|<>"),
        "n_dup_lines": (F.size("g_.lines") - F.size(F.array_distinct("g_.lines"))).cast("long"),
        "n_repeat_words": F.expr(f"transform(array(s_), s -> aggregate(transform(s, (x, k) -> if(k = size(s) - 1, {window}, least({window}, s[least(k + 1, size(s) - 1)] - x))), 0L, (a, x) -> a + x))[0]"),
        "n_lines": F.size("g_.lines").cast("long"),
        "n_upper": length(solid) - length(F.regexp_replace(solid, r"\p{Lu}+", "")),
        "n_digits": without("0123456789"),
        "n_marks": without("!?.,;:'\"()[]{}@/\\-_=+~`^"),
    }
    return out.select(*[c for c in docs.columns if c != text_col and c not in counts], *[v.alias(k) for k, v in counts.items()])


def base_failed() -> Column:
    """Of the columns of text_stats(): fewer than 10 words, or more than a fifth of them in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass
class Rule:
    """A conjunction of (statistic, ">=" or "<", threshold) and the verdict of the texts that meet it first."""

    tests: list[tuple[str, str, float]]
    keep: bool
    covered: int = 0
    right: int = 0

    def meets(self, x: dict[str, float]) -> bool:
        return all(x[n] >= t if op == ">=" else x[n] < t for n, op, t in self.tests)

    def column(self, ratios: dict[str, str]) -> Column:
        out = F.lit(True)
        for n, op, t in self.tests:
            value = F.expr(ratios[n])
            out = out & (value >= F.lit(t) if op == ">=" else value < F.lit(t))
        return out


@dataclass
class DecisionList:
    rules: list[Rule] = field(default_factory=list)
    default: bool = True

    def column(self, ratios: dict[str, str] = RATIOS) -> Column:
        """CASE WHEN rule THEN verdict ... ELSE default END, in the rules' order."""
        if not self.rules:
            return F.lit(self.default)
        out = F
        for r in self.rules:
            out = out.when(r.column(ratios), F.lit(r.keep))
        return out.otherwise(F.lit(self.default))

    def predict(self, x: dict[str, float]) -> bool:
        return next((r.keep for r in self.rules if r.meets(x)), self.default)

    def describe(self) -> list[str]:
        said = [("IF " + " AND ".join(f"{n} {op} {t:.6g}" for n, op, t in r.tests) + f" THEN {'keep' if r.keep else 'drop'}  [{r.right}/{r.covered}]") for r in self.rules]
        return [*said, f"ELSE {'keep' if self.default else 'drop'}"]


def _cuts(values: list[float], bins: int) -> list[float]:
    """Thresholds half-way between neighbours at evenly spaced ranks, each end's extremes included."""
    v = sorted(set(values))
    mids = [(a + b) / 2 for a, b in zip(v, v[1:], strict=False)]
    if len(mids) <= bins:
        return mids
    return sorted({mids[round(i * (len(mids) - 1) / (bins - 1))] for i in range(bins)})


def learn_list(rows: list[tuple[dict[str, float], bool]], min_precision: float = 0.9, min_cover: int = 5, max_rules: int = 12, max_tests: int = 3, bins: int = 64) -> DecisionList:
    """Sequential covering for the verdict "drop" over (statistics, is good) rows; the rest is kept.

    Two thirds of the rows (dealt by position, bad and good apart) grow a rule: it starts empty and takes the threshold
    test of the greatest FOIL gain until no good row is left in it. The other third prunes it: last tests go while its
    (p - n) / (p + n) there doesn't fall. A rule stays only if it covers min_cover rows with min_precision of them bad
    on both parts together and isn't worse on the pruning part; covered rows leave, and the next rule is grown.
    No rows, or rows of one class only, give an empty list that keeps.
    """
    out = DecisionList()
    left = {part: [] for part in (0, 1)}
    seen = {True: 0, False: 0}
    for x, good in rows:
        left[int(seen[good] % 3 == 2)].append((x, good))
        seen[good] += 1
    if not seen[False] or not seen[True]:
        return out
    names = sorted(rows[0][0])
    while len(out.rules) < max_rules and any(not g for _, g in left[0]):
        tests: list[tuple[str, str, float]] = []
        inside = left[0]
        while len(tests) < max_tests and any(g for _, g in inside):
            p0 = sum(not g for _, g in inside)
            base, best = math.log2(p0 / len(inside)), (1e-9, None)
            for n in names:
                pairs = sorted((x[n], not g) for x, g in inside)
                total, size = p0, len(pairs)
                below = at = 0
                for t in _cuts([v for v, _ in pairs], bins):
                    while at < size and pairs[at][0] < t:
                        below += pairs[at][1]
                        at += 1
                    for op, p, m in (("<", below, at), (">=", total - below, size - at)):
                        if p and (gain := p * (math.log2(p / m) - base)) > best[0]:
                            best = (gain, (n, op, t))
            if best[1] is None:
                break
            tests.append(best[1])
            rule = Rule(tests, False)
            inside = [r for r in inside if rule.meets(r[0])]
        if not tests:
            break

        def worth(k: int) -> float:
            met = [g for x, g in left[1] if Rule(tests[:k], False).meets(x)]
            return (2 * sum(not g for g in met) - len(met)) / len(met) if met else -1.0

        k = len(tests)
        while k > 1 and worth(k - 1) >= worth(k):
            k -= 1
        rule = Rule(tests[:k], False)
        met = [g for part in left.values() for x, g in part if rule.meets(x)]
        rule.covered, rule.right = len(met), sum(not g for g in met)
        if rule.covered < min_cover or rule.right < min_precision * rule.covered:
            break
        out.rules.append(rule)
        left = {k: [r for r in part if not rule.meets(r[0])] for k, part in left.items()}
    return out


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = 5000, **how) -> DecisionList:
    """The decision list of the statistics of a bounded sample of labelled documents.

    max_labelled bounds the sample: the labelled ids with the smallest hashes. Labels that aren't 0 or 1 and null
    ids are left out; an id that is labelled twice has its greatest label, and all rows of docs that repeat it teach. Texts
    are measured whole, and only numbers come to the driver. Only the texts that pass the base rules teach, as the list judges only those.
    """
    some = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("y_"))
    some = some.orderBy(F.xxhash64(id_col), id_col).limit(max_labelled)
    ids = [(r[0], r[1]) for r in some.collect()]
    if not ids:
        return DecisionList()
    few = docs.sparkSession.createDataFrame(ids, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, y_ int")
    taught = text_stats(docs.select(id_col, text_col).join(F.broadcast(few), id_col), text_col).where(~base_failed())
    names = list(RATIOS)
    rows = taught.select(id_col, "y_", *[F.expr(RATIOS[n]).cast("double").alias(n) for n in names]).collect()
    # rows that repeat an id are in an order of their own too, so the list is the same in every run
    rows.sort(key=lambda r: (r[0], r["y_"], [(r[n] is not None, r[n] or 0.0) for n in names]))
    return learn_list([({n: r[n] for n in names}, r["y_"] == 1) for r in rows], **how)


def judge_quality(docs: DataFrame, rules: DecisionList, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base statistics and verdict of every whole text: one projection, no shuffle, no Python.

    A null or empty text has no words, so base_failed is true. A row for each row of docs; a null id stays null; other
    columns of docs are not read.
    """
    stats = text_stats(docs.select(F.col(id_col), F.col(text_col)), text_col)
    failed = base_failed()
    return stats.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & rules.column()).alias("kept"))


def op7_quality(spark, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document. Null texts have no words and fail; more in judge_quality."""
    docs = table(spark, sf_dir, "documents")
    return judge_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
