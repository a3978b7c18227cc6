"""Evaluation: recall, result-quality features, range precision, operating points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.functions.vectors import inner_product, l2, mean_vector, norm_sqr


def recall(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(query_id, recall): how much of the true k nearest was found."""
    hits = results.where(F.col("rank") <= k).join(truth.where(F.col("rank") <= k).select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("hits"))
    return truth.select("query_id").distinct().join(hits, "query_id", "left").select("query_id", (F.coalesce("hits", F.lit(0)) / F.lit(float(k))).alias("recall"))


def one_recall_at(results: DataFrame, truth: DataFrame, r: int) -> DataFrame:
    """The share of queries whose nearest is among the first r."""
    nearest = truth.where("rank = 1").select("query_id", F.col("vec_id").alias("nearest"))
    got = results.where(F.col("rank") <= r).join(nearest, "query_id").groupBy("query_id").agg(F.max((F.col("vec_id") == F.col("nearest")).cast("int")).alias("hit"))
    return nearest.join(got, "query_id", "left").agg(F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("recall"))


def percentile_at(sorted_d: Column, p: float) -> Column:
    """The element at floor(p * (k - 1)), without interpolation."""
    return F.element_at(sorted_d, (F.floor(F.lit(p) * (F.size(sorted_d) - 1)) + 1).cast("int"))


def features(results: DataFrame) -> DataFrame:
    """Per-query statistics of the current results' distances; moments are the population's, skewness is the third
    central moment, self matches don't count as nearest and zeros not in the mean."""
    a = results.groupBy("query_id").agg(
        F.count("*").alias("n"),
        F.avg(F.when((F.col("distance") != 0) & ~F.isnan("distance"), F.col("distance"))).alias("avg_dist"),
        F.min(F.when(F.col("vec_id") != F.col("query_id"), F.col("distance"))).alias("nn_dist"),
        F.max("distance").alias("furthest_dist"), F.avg("distance").alias("m1"), F.avg(F.col("distance") ** 2).alias("m2"), F.avg(F.col("distance") ** 3).alias("m3"),
        F.avg(F.col("distance") ** 4).alias("m4"), F.sum(F.col("distance") ** 2).alias("energy"), F.array_sort(F.collect_list("distance")).alias("ds"),
    )
    var = F.col("m2") - F.col("m1") ** 2
    c4 = F.col("m4") - 4 * F.col("m1") * F.col("m3") + 6 * F.col("m1") ** 2 * F.col("m2") - 3 * F.col("m1") ** 4
    r = lambda c: F.round(c, 6)
    return a.select(
        "query_id", r(F.col("avg_dist")).alias("avg_dist"), r(F.col("nn_dist")).alias("nn_dist"), r(F.col("furthest_dist")).alias("furthest_dist"), r(var).alias("variance"), r(F.sqrt(F.greatest(var, F.lit(0.0)))).alias("std"),
        r(F.col("furthest_dist") - F.col("nn_dist")).alias("range"), *[r(percentile_at(F.col("ds"), p / 100)).alias(f"percentile_{p}") for p in (25, 50, 75, 95)],
        r(F.col("m3") - 3 * F.col("m1") * var - F.col("m1") ** 3).alias("skewness"), F.round(F.try_divide(c4, var * var) - 3, 4).alias("kurtosis"), r(F.col("energy")).alias("energy"),
        r(F.when(F.col("n") >= 10, F.element_at("ds", F.least(F.lit(10), F.size("ds")))).otherwise(-1.0)).alias("nn10_dist"), r(F.try_divide(F.lit(1.0), F.col("avg_dist"))).alias("density"),
    )


def quality(results: DataFrame, truth: DataFrame, k: int, all_ranks: int) -> DataFrame:
    """recall, RDE, TDR and NRS of each query's results against the truth of `all_ranks` ranks.

    RDE: mean of found / true - 1 by rank, over true distances that aren't 0. TDR: true over found total. NRS: 1 less
    the excess of the results' true ranks over the best sum, a miss ranking behind all.
    """
    t, f = truth.where(F.col("rank") <= k), results.where(F.col("rank") <= k)
    both = t.select("query_id", "rank", F.col("distance").alias("g")).join(f.select("query_id", "rank", F.col("distance").alias("d")), ["query_id", "rank"])
    rel = both.groupBy("query_id").agg(F.avg(F.when(F.col("g") != 0, F.col("d") / F.nullif("g", F.lit(0.0)) - 1)).alias("rde"), F.try_divide(F.sum("g"), F.sum("d")).alias("tdr"))
    ranked = f.join(truth.select("query_id", "vec_id", F.col("rank").alias("true_rank")), ["query_id", "vec_id"], "left").groupBy("query_id").agg(F.sum(F.coalesce("true_rank", F.lit(all_ranks + 1))).alias("s"))
    ideal = k * (k + 1) / 2
    return recall(results, truth, k).join(rel, "query_id", "left").join(ranked, "query_id", "left").select("query_id", F.round("recall", 6).alias("recall"), F.round(F.coalesce("rde", F.lit(0.0)), 6).alias("rde"), F.round(F.coalesce("tdr", F.lit(1.0)), 6).alias("tdr"), F.round(1 - (F.col("s") - k) / F.lit(max(ideal - k, 1.0)), 6).alias("nrs"))


def range_precision_recall(found: DataFrame, truth: DataFrame, mode: str = "overall") -> DataFrame:
    """Precision and recall of range results: over all pairs, or ("average") the mean of the queries' own, where a query
    without results has a precision, and one without true ones a recall, of 1."""
    pairs = lambda x: x.select("query_id", "vec_id").distinct()
    both = pairs(found).withColumn("f", F.lit(1)).join(pairs(truth).withColumn("t", F.lit(1)), ["query_id", "vec_id"], "full")
    counts = F.count("f").alias("n_found"), F.count("t").alias("n_true"), F.count(F.when(F.col("f").isNotNull() & F.col("t").isNotNull(), 1)).alias("n_both")
    if mode == "average":
        share = lambda x: F.when(F.col(x) == 0, 1.0).otherwise(F.try_divide("n_both", x))
        return both.groupBy("query_id").agg(*counts).agg(F.count("*").alias("n_queries"), F.round(F.avg(share("n_found")), 6).alias("precision"), F.round(F.avg(share("n_true")), 6).alias("recall"))
    s = both.agg(*counts)
    return s.select("n_found", "n_true", "n_both", F.round(F.try_divide(F.col("n_both"), F.col("n_found")), 6).alias("precision"), F.round(F.try_divide(F.col("n_both"), F.col("n_true")), 6).alias("recall"))


def geometry(results: DataFrame, queries: DataFrame, vectors: DataFrame, d: int, bins: int = 20) -> DataFrame:
    """How the results lie about the query: mean, variance and entropy (20 bins of (s + 1) / 2) of their cosines with it,
    and its squared distance to their mean."""
    x, q = F.col("embedding"), F.col("q")
    rows = results.join(vectors.select("vec_id", "embedding"), "vec_id").join(queries.select("query_id", "q"), "query_id")
    rows = rows.withColumn("s", inner_product(x, q) / F.sqrt(norm_sqr(x) * norm_sqr(q)))
    at = F.least(F.lit(bins - 1), F.floor((F.col("s") + 1) * 0.5 * bins).cast("int"))
    each = rows.withColumn("bin", at).groupBy("query_id").agg(F.avg("s").alias("m"), F.var_pop("s").alias("v"), F.count("*").alias("n"), mean_vector(x, d).alias("c"), F.first("q").alias("q"), *[F.count_if(F.col("bin") == b).alias(f"b{b}") for b in range(bins)])
    entropy = sum((F.when(F.col(f"b{b}") > 0, -F.col(f"b{b}") / F.col("n") * F.ln(F.col(f"b{b}") / F.col("n"))).otherwise(0.0) for b in range(bins)), F.lit(0.0))
    return each.select("query_id", F.round("m", 6).alias("cosine_mean"), F.round("v", 6).alias("cosine_variance"), F.round(entropy, 6).alias("cosine_entropy"), F.round(l2(F.col("c"), q), 6).alias("medoid_dist"))


def degrees(results: DataFrame, graph: DataFrame, k: int) -> DataFrame:
    """(query_id, avg_degree, degree_0) in a graph's lowest level: the whole part of the results' mean out-degree, and the
    nearest one's."""
    deg = graph.where("level = 0").select(F.col("node").alias("vec_id"), F.size("neighbors").alias("n"))
    rows = results.where(F.col("rank") <= k).join(deg, "vec_id")
    return rows.groupBy("query_id").agg(F.floor(F.sum("n") / k).cast("long").alias("avg_degree"), F.max(F.when(F.col("rank") == 1, F.col("n"))).alias("degree_0"))


def pareto(points: DataFrame) -> DataFrame:
    """Operating points (key, perf, t) that no faster or equal one matches in performance. The points are a sweep's."""
    w = Window.partitionBy(F.lit(0)).orderBy("t", F.desc("perf"), "key").rowsBetween(Window.unboundedPreceding, -1)
    return points.withColumn("best", F.max("perf").over(w)).where(F.col("best").isNull() | (F.col("perf") > F.col("best"))).drop("best")


def hit_ratio(scores: DataFrame, target: float) -> DataFrame:
    return scores.agg(F.avg((F.col("recall") >= target).cast("double")).alias("hit_ratio"), F.avg("recall").alias("mean_recall"))


def mean_of_runs(runs: DataFrame) -> DataFrame:
    return runs.groupBy("qid").agg(*[F.avg(c).alias(c) for c in runs.columns if c != "qid"])


def recall_correlation(log: DataFrame, columns: list[str]) -> DataFrame:
    stats = log.agg(*[F.corr("r", c).alias(c) for c in columns])
    return stats.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("corr")) for c in columns])).alias("x")).select("x.*")


def distances_to_target(log: DataFrame, target: float) -> DataFrame:
    """The distances computed when a query's trace first reaches the target."""
    return log.where(F.col("r") >= target).groupBy("qid").agg(F.min_by("dists", "step").alias("dists"))


def budget_targets(log: DataFrame) -> DataFrame:
    """Least distances among the rows of the greatest recall, per query and shard: each shard's walk has a budget."""
    keys = [c for c in ("qid", "shard") if c in log.columns]
    return log.groupBy(*keys).agg(F.min(F.struct((-F.col("r")).alias("n"), "dists")).alias("m")).select(*keys, F.col("m.dists").alias("dists_for_max_recall"))
