"""Declarative recall: the user states a recall, a model of the running search says when to stop.

Traces of searches on training queries become a table; Spark ML fits boosted trees on it; the trees travel to the
searches as plain arrays. Policies are what graph.search() takes.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.operators.graph import Policy, State, dealt, load_slices, walk
from nearfield.operators.search import _best, dimension, query_blocks

# The features that the published methods name, by the names of their logs' columns.
RECALL_FEATURES = ["step", "dists", "inserts", "first_nn_dist", "nn_dist", "furthest_dist", "avg_dist", "variance", "percentile_25", "percentile_50", "percentile_75"]
STABLE_FEATURES = ["step", "dists", "inserts", "visited_points", "duration", "nn_dist", "furthest_dist", "avg_dist", "variance"]
BUDGET_FEATURES = ["first_nn_dist", "nn_dist", "furthest_dist", "avg_dist", "nn_to_first"]
WIDTH_FEATURES = ["step", "dists", "inserts", "first_nn_dist", "visited_points", "nn_dist", "avg_dist", "furthest_dist", "variance", "std", "range", "energy", "nn_to_first", "density"]


#: What calibrated predictions look at besides: how long results have stood still, how many of them were expanded, and how
#: far the next node is against the k-th result.
GAP_FEATURES = [*RECALL_FEATURES, "visited_points", "duration", "gap"]


def tick(s: State, d: float) -> None:
    """Keeps `visited` (expanded nodes among the k nearest) and `duration` (steps that it has stood still), before a node at
    distance d is expanded. Both are counted again only where the k nearest changed or one of them was expanded."""
    m = s.memory
    if m.get("inserts") != s.inserts or m.get("last", math.inf) <= m.get("kth", math.inf):
        near = s.ranked()
        visited = sum(i in s.expanded for _, i in near)
        m["duration"] = m.get("duration", 0) + 1 if m.get("visited") == visited else 0
        m["visited"], m["inserts"], m["kth"] = visited, s.inserts, near[-1][0] if near else math.inf
    else:
        m["duration"] += 1
    m["last"] = d


def observe(s: State) -> dict[str, float]:
    """The running features of a search; moments are over the k nearest so far. visited_points is counted here, duration and
    the distance behind gap are tick()'s, or 0."""
    # plain numbers: arrays of k cost more to make than to add up
    near = s.ranked()
    d = [a for a, _ in near] or [float(s.first)]
    far = [a for a in d if a != 0]
    n = len(d)
    visited = sum(i in s.expanded for _, i in near)
    mean = sum(far) / len(far) if far else 0.0
    energy = sum(a * a for a in d)
    var = max(energy / n - (sum(d) / n) ** 2, 0.0)
    p = lambda x: d[int(x * (n - 1))]
    ahead = s.memory.get("last", 0.0)
    return {
        "step": s.step, "dists": s.ndis, "inserts": s.inserts, "first_nn_dist": s.first, "visited_points": visited, "duration": s.memory.get("duration", 0), "nn_dist": d[0], "avg_dist": mean, "furthest_dist": d[-1],
        "percentile_25": p(0.25), "percentile_50": p(0.5), "percentile_75": p(0.75), "percentile_95": p(0.95), "variance": var, "std": math.sqrt(var), "range": d[-1] - d[0],
        "energy": energy, "nn_to_first": d[0] / s.first if s.first > 0 else -1.0, "nn10_to_first": d[9] / s.first if s.first > 0 and n >= 10 else -1.0, "density": 1.0 / mean if mean else 0.0,
        "gap": ahead / d[-1] if d[-1] > 0 else 1.0,
    }


@dataclass
class Trees:
    """An ensemble as arrays: for each tree (feature, threshold, left, right, value) per node; leaves have feature -1."""

    names: list[str]
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    weights: np.ndarray
    #: Of each feature's share in the splits' gains.
    importance: dict[str, float] | None = None

    def probability(self, x: dict[str, float]) -> float:
        """Of the second class, for trees that train_classifier() made."""
        return 1.0 / (1.0 + math.exp(-2.0 * max(-300.0, min(300.0, self.predict(x)))))

    def predict_all(self, x: np.ndarray) -> np.ndarray:
        """Of rows with the columns that names says."""
        total = np.zeros(len(x))
        for (feature, cut, left, right, value), w in zip(self.trees, self.weights, strict=True):
            at = np.zeros(len(x), np.int64)
            while (inner := np.flatnonzero(feature[at] >= 0)).size:
                a = at[inner]
                at[inner] = np.where(x[inner, feature[a]] <= cut[a], left[a], right[a])
            total += w * value[at]
        return total

    @cached_property
    def _plain(self) -> list[tuple]:
        """The trees as lists, which one row is quicker through, and their weights."""
        return [(*(c.tolist() for c in t), w) for t, w in zip(self.trees, self.weights.tolist(), strict=True)]

    def predict(self, x: dict[str, float]) -> float:
        row = [x[n] for n in self.names]
        total = 0.0
        for feature, cut, left, right, value, w in self._plain:
            at = 0
            while feature[at] >= 0:
                at = left[at] if row[feature[at]] <= cut[at] else right[at]
            total += w * value[at]
        return float(total)


def export(model, names: list[str]) -> Trees:
    out = []
    for tree in model.trees:
        cols: tuple[list, ...] = ([], [], [], [], [])

        def grow(node, cols=cols) -> int:
            at = len(cols[0])
            leaf = node.numDescendants() == 0
            for c, v in zip(cols, (-1, 0.0, -1, -1, float(node.prediction())), strict=True):
                c.append(v)
            if not leaf:
                s = node.split()
                cols[0][at], cols[1][at] = s.featureIndex(), s.threshold()
                cols[2][at] = grow(node.leftChild())
                cols[3][at] = grow(node.rightChild())
            return at

        grow(tree._call_java("rootNode"))
        out.append(tuple(np.array(c) for c in cols))
    return Trees(names, out, np.array(model.treeWeights), dict(zip(names, model.featureImportances.toArray().tolist(), strict=True)))


#: Rows that a task of a fit has at least. A fit is some hundred short jobs, whose time is that of starting their tasks.
FIT_ROWS = 20_000


def _fit(estimator, rows: DataFrame, names: list[str], label: str):
    """The estimator's model of the features and the label. The table is kept for the fit, in no more parts than its rows
    need: the shuffles that made it leave 200, however few rows it has. Where cores have several parts each, all have as
    many, so that no job ends in a round of a few tasks."""
    table = rows.select(*[F.col(n).cast("double") for n in names], F.col(label).cast("double").alias("y_")).persist()
    parts, cores = max(1, -(-table.count() // FIT_ROWS)), rows.sparkSession.sparkContext.defaultParallelism
    parts = parts // cores * cores if parts > cores else parts
    model = estimator.fit(VectorAssembler(inputCols=names, outputCol="x_").transform(table.coalesce(parts)))
    table.unpersist()
    return model


def train(rows: DataFrame, names: list[str], label: str = "r", trees: int = 20, depth: int = 5, step: float = 0.1, seed: int = 42) -> Trees:
    """Boosted trees of the features on the label, by Spark ML on the cluster."""
    return export(_fit(GBTRegressor(featuresCol="x_", labelCol="y_", maxIter=trees, maxDepth=depth, stepSize=step, seed=seed), rows, names, label), names)


def train_classifier(rows: DataFrame, names: list[str], label: str = "y", trees: int = 20, depth: int = 4, seed: int = 42) -> Trees:
    """Boosted trees for a label of 0 and 1; probability() gives the second class's."""
    from pyspark.ml.classification import GBTClassifier

    return export(_fit(GBTClassifier(featuresCol="x_", labelCol="y_", maxIter=trees, maxDepth=depth, seed=seed), rows, names, label), names)


def compare_models(rows: DataFrame, names: list[str], label: str = "r") -> dict[str, float]:
    """R2 of linear, forest and boosted regressors on a held-out fifth."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.regression import LinearRegression, RandomForestRegressor

    table = VectorAssembler(inputCols=names, outputCol="x_").transform(rows.select("qid", *[F.col(n).cast("double") for n in names], F.col(label).cast("double").alias("y_")))
    part = F.pmod(F.xxhash64("qid"), F.lit(5)) == 0
    scores = {}
    for name, kind in (("linear", LinearRegression), ("forest", RandomForestRegressor), ("boosted", GBTRegressor)):
        m = kind(featuresCol="x_", labelCol="y_").fit(table.where(~part))
        scores[name] = RegressionEvaluator(labelCol="y_", metricName="r2").evaluate(m.transform(table.where(part)))
    return scores


def trace(graph: DataFrame, queries: DataFrame, truth: DataFrame, k: int, ef: int = 128, every: int = 1, max_queries: int | None = 10_000, slices: int = 1) -> DataFrame:
    """The observation log: a row of features and true recall r for each `every` steps of every query's walk, per shard.
    `beyond` says that the next node is farther than the k-th result; `width` is the narrowest queue whose walk comes as far.

    truth has (query_id, vec_id) of the k nearest; r counts those that the shard holds, which are `near`. At most max_queries training
    queries are walked, those of least hash, or all with None; they go out in blocks of checked size. slices: how many tasks share a shard's
    queries.
    """
    few = queries if max_queries is None else queries.orderBy(F.xxhash64("query_id"), "query_id").limit(max_queries)
    asked = few.join(truth.groupBy("query_id").agg(F.collect_list("vec_id").alias("gt")), "query_id")
    out = None
    for block in query_blocks(asked, dimension(asked, "q") + k):
        part = _trace(graph, block, k, ef, every, slices)
        out = part if out is None else out.unionByName(part)
    return out


def _trace(graph: DataFrame, queries: DataFrame, k: int, ef: int, every: int, slices: int) -> DataFrame:
    names = ["qid", "shard", *observe(State(1, 1, np.zeros(1))), "beyond", "width", "near", "r"]
    whole = {"step", "dists", "inserts", "visited_points", "duration", "qid", "shard", "beyond", "width", "near"}
    rows = queries.orderBy("query_id").collect()  # at most BLOCK_BYTES, see query_blocks
    sent = graph.sparkSession.sparkContext.broadcast([(r["query_id"], np.array(r["q"], dtype=np.float64), set(r["gt"])) for r in rows])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for shard, own, g in load_slices(batches):
            out: list[dict] = []
            names_ = g.ids.tolist()
            held = set(names_)
            for qid, q, gt in sent.value[own::slices]:
                near = gt & held
                if not near:
                    continue

                def note(s: State, d: float, qid=qid, near=near, names_=names_, out=out) -> bool:
                    tick(s, d)
                    width = s.memory.get("width", s.k)
                    # a queue of w ends the walk before a node that w nodes are nearer than
                    s.memory["width"] = max(width, 1 + bisect_left(s.wide, d))
                    if s.step % every == 0:
                        x = observe(s)
                        beyond = int(len(s.best) >= s.k and d > s.memory["kth"])
                        out.append({"qid": qid, "shard": shard, "beyond": beyond, "width": width, "near": len(near)} | x | {"r": sum(names_[i] in near for i in s.nearest()) / len(near)})
                    return False

                s = walk(g, q, k, ef, note)
                note(s, 0.0)
            cols = [pa.array([float(r[n]) if n not in whole else int(r[n]) for r in out], pa.int64() if n in whole else pa.float64()) for n in names]
            yield pa.RecordBatch.from_arrays(cols, names)

    return dealt(graph, slices).mapInArrow(run, ", ".join(f"{n} {'long' if n in whole else 'double'}" for n in names))


def balanced(log: DataFrame, full: int = 20, bucket: int = 10, buckets: int = 10, seed: int = 42) -> DataFrame:
    """Of each query's rows (and shard's) at most `full` at a recall of 1, and `bucket` in each of the buckets of recall below.

    A row is dealt to one of a bucket's places by a hash of its step, and of a place the row of least hash stays: one
    aggregate whose partial results have the same bound, and no window over the log.
    """
    at = F.when(F.col("r") >= 1, F.lit(buckets)).otherwise(F.least(F.floor(F.col("r") * buckets), F.lit(buckets - 1)))
    h = F.xxhash64(F.lit(seed), "qid", "shard", "step")
    place = F.pmod(h, F.when(F.col("r") >= 1, F.lit(full)).otherwise(F.lit(bucket)))
    own = [F.col(f"`{c}`") for c in log.columns]
    one = F.min_by(F.struct(*own), F.struct(F.xxhash64(F.lit(seed + 1), "step"), "step")).alias("x")
    return log.groupBy("qid", "shard", at.alias("bucket_"), place.alias("place_")).agg(one).select("x.*")


def predicted(log: DataFrame, model: Trees) -> DataFrame:
    """The log with the model's prediction, `p`."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            x = np.array([b.column(b.schema.get_field_index(n)).to_numpy(zero_copy_only=False).astype(np.float64) for n in model.names]).T
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.predict_all(x.reshape(b.num_rows, -1)))], [*b.schema.names, "p"])

    from pyspark.sql import types as T

    return log.mapInArrow(run, T.StructType([*log.schema.fields, T.StructField("p", T.DoubleType())]))


def needed(log: DataFrame, value: Column, target: float, before: bool = False) -> DataFrame:
    """(qid, s): what a stop has to let pass so that a query is at the target over all its shards. Each of a query's true
    neighbours has the least value among its shard's rows that have found it, or, with `before`, the greatest among those
    that have not; of these it is the one in ascending order that makes up the target. Infinite where the walks don't come
    to it."""
    found = F.round(F.col("r") * F.col("near")).cast("int")
    own = log.groupBy("qid", "shard", "near", found.alias("found")).agg((F.max if before else F.min)(value).alias("v"))
    w = Window.partitionBy("qid", "shard").orderBy("found")  # a row for each neighbour at most
    if before:
        own = own.withColumn("v", F.max("v").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    new = F.col("found") - F.coalesce(F.lag("found").over(w), F.lit(0))
    missed = F.when(F.lead("found").over(w).isNull(), F.col("near") - F.col("found")).otherwise(0)
    each = F.concat(F.array_repeat(F.coalesce(F.col("v").cast("double"), F.lit(-math.inf)), new.cast("int")), F.array_repeat(F.lit(math.inf), missed.cast("int")))
    all_ = own.select("qid", each.alias("v")).groupBy("qid").agg(F.sort_array(F.flatten(F.collect_list("v"))).alias("v"))
    return all_.select("qid", F.element_at("v", F.ceil(F.size("v") * target - 1e-9).cast("int")).alias("s"))


def enough(scores: DataFrame, confidence: float = 0.95) -> float:
    """The quantile of rank ceil((n + 1) * confidence) of (qid, s): what is enough for that share of queries drawn as these
    are. Infinite where there are too few of them for the rank."""
    own = sorted(r["s"] for r in scores.select("s").collect())  # one number a query
    rank = math.ceil((len(own) + 1) * confidence)
    return math.inf if rank > len(own) else float(own[rank - 1])


def threshold(log: DataFrame, model: Trees, target: float, confidence: float = 0.95) -> float:
    """What a prediction has to be above for a stop that keeps the promise: of queries that are drawn as the log's are, a
    share of `confidence` is at the target when the model first predicts more, over all shards.

    Of a log that the model was not fitted on: for each true neighbour of a query the highest prediction made in its shard
    before it was found, and of these the one that makes up the target. Of the queries' the quantile that enough() gives.
    Infinite, so that nothing is stopped, where the log has too few queries for that rank.
    """
    rows = predicted(log, model)
    if "near" in log.columns:
        return enough(needed(rows, F.col("p"), target, before=True), confidence)
    # a log of one shard: the highest prediction while the recall was below the target
    return enough(rows.groupBy("qid").agg(F.coalesce(F.max(F.when(F.col("r") < target, F.col("p"))), F.lit(-math.inf)).alias("s")), confidence)


def factor(log: DataFrame, rows: DataFrame, model: Trees, value: str, target: float, confidence: float = 0.95) -> float:
    """By what a model's predictions of `value` have to be multiplied so that a share of `confidence` of queries is at the
    target over all shards, where a shard's walk ends at its own prediction's multiple. rows: the log's row of each query
    and shard at which the prediction is made; without one the walk isn't ended."""
    own = predicted(rows, model).select("qid", "shard", F.greatest("p", F.lit(1.0)).alias("p_"))
    return enough(needed(log.join(own, ["qid", "shard"], "left"), F.coalesce(F.col(value) / F.col("p_"), F.lit(0.0)), target), confidence)


def widths(log: DataFrame, target: float, widest: int) -> DataFrame:
    """(qid, ef): the narrowest queue with which walks of all shards come to the target recall, or the widest, read off one
    trace of the widest: a narrower walk is the same up to where it ends."""
    return needed(log, F.col("width"), target).select("qid", F.least("s", F.lit(float(widest))).cast("int").alias("ef"))


def shard_widths(log: DataFrame, widest: int) -> DataFrame:
    """(qid, shard, ef): the narrowest queue with which a shard's walk finds all that the longest finds."""
    end = log.groupBy("qid", "shard").agg(F.min(F.struct((-F.col("r")).alias("r"), "width")).alias("x"))
    return end.select("qid", "shard", F.least(F.col("x.width"), F.lit(widest)).cast("int").alias("ef"))


def fixed(budget: int) -> Callable[[], Policy]:
    """Stop at a number of distances."""
    return lambda: lambda s, d: s.ndis >= budget


def recall_policy(model: Trees, target: float, first: int = 50, least: int = 10, above: float | None = None, every: int = 1) -> Callable[[], Policy]:
    """Predict recall each time an interval of distances has passed, and stop at the target; the interval shrinks from
    `first` to `least` as the prediction nears the target. above: stop where the prediction is above what threshold()
    found for the target instead; every: predict at such steps alone as the log that it was found on has."""

    ticks = not {"duration", "gap"}.isdisjoint(model.names)

    def make() -> Policy:
        due = first

        def stop(s: State, d: float) -> bool:
            nonlocal due
            if ticks:
                tick(s, d)
            if s.ndis < due or s.step % every:
                return False
            p = model.predict(observe(s))
            s.predicted = min(1.0, max(0.0, p))
            due = s.ndis + max(1, round(least + (first - least) * max(0.0, target - s.predicted)))
            return s.predicted >= target if above is None else p > above

        return stop

    return make


def budget_policy(model: Trees, after: int = 50, multiplier: float = 1.0) -> Callable[[], Policy]:
    """After `after` distances predict the whole budget once; from then on only the budget ends the search."""

    def make() -> Policy:
        budget = math.inf

        def stop(s: State, d: float) -> bool:
            nonlocal budget
            if budget == math.inf and s.ndis >= after:
                s.predicted = model.predict(observe(s))
                budget = multiplier * max(s.predicted, 1.0)
            return s.ndis >= budget

        return stop

    return make


def stable_policy(model: Trees, target: float, times: int = 3, times_late: int = 8) -> Callable[[], Policy]:
    """Predict recall only once results are stable: `times` nodes running brought few of the k. A prediction is due at
    first, when the last one plus what came since could be enough, and at times_late."""

    def make() -> Policy:
        stable = last = since = 0
        passed = False
        predicted = -1.0

        def stop(s: State, d: float) -> bool:
            nonlocal stable, last, since, passed, predicted
            got, last = s.inserts - last, s.inserts
            since += got
            passed = passed or s.step > 1
            if passed:
                stable = stable + 1 if (stable and not got) or got <= s.k * (1 - target) else 0
            tick(s, d)
            if stable >= times and (predicted < 0 or predicted + since / s.k >= target or stable == times_late):
                predicted, since = min(1.0, max(0.0, model.predict(observe(s)))), 0
                s.predicted = predicted
                return round(predicted, 2) >= round(target, 2)
            return False

        return stop

    return make


def beyond(s: State, d: float) -> bool:
    """Whether the next node, at distance d, is farther than the k-th result."""
    if len(s.best) < s.k:
        return False
    m = s.memory
    if m.get("at") != s.inserts or "far" not in m:
        m["at"], m["far"] = s.inserts, float(s.top()[-1])
    return d > m["far"]


def width_policy(model: Trees, multiplier: float = 1.0) -> Callable[[], Policy]:
    """When the next node is first farther than the k-th result, predict the queue width that the query needs, once."""

    def make() -> Policy:
        done = False

        def stop(s: State, d: float) -> bool:
            nonlocal done
            if not done and beyond(s, d):
                done = True
                s.predicted = model.predict(observe(s))
                s.ef = int(min(s.ef, max(s.k, math.ceil(min(multiplier * max(s.predicted, 1.0), s.ef)))))
            return False

        return stop

    return make


def width_rows(log: DataFrame) -> DataFrame:
    """The log's row of each query where the next node is first farther than the k-th result: where width_policy
    predicts."""
    return log.where("beyond = 1").groupBy("qid", "shard").agg(F.min_by(F.struct(*[c for c in log.columns if c not in ("qid", "shard")]), "step").alias("x")).select("qid", "shard", "x.*")


def least_width(graph: DataFrame, queries: DataFrame, truth: DataFrame, k: int, target: float, widest: int = 256, tolerance: float = 0.1) -> DataFrame:
    """(query_id, ef): the narrowest queue that reaches the target recall, to a share of `tolerance`, or the widest.

    Widths double until the target is met; the interval between the last miss and the first hit is then halved, for all
    queries in one search a round, each with a width of its own.
    """
    from nearfield.operators.evaluate import recall
    from nearfield.operators.graph import merged, search

    spark = queries.sparkSession
    kind = queries.schema["query_id"].dataType.simpleString()
    low: dict = {}
    high = {r[0]: widest for r in queries.select("query_id").collect()}
    todo = {i: min(k, widest) for i in high}
    met: set = set()
    while todo:
        asked = queries.join(F.broadcast(spark.createDataFrame(list(todo.items()), f"query_id {kind}, ef int")), "query_id")
        got = {r["query_id"]: r["recall"] for r in recall(merged(search(graph, asked, k, k), k), truth.join(asked.select("query_id"), "query_id", "left_semi"), k).collect()}
        new = {}
        for i, ef in todo.items():
            if got.get(i, 0.0) >= target:
                high[i] = ef
                met.add(i)
            else:
                low[i] = ef
            if i not in met and ef < widest:
                new[i] = min(2 * ef, widest)
            elif i in met and i in low and high[i] - low[i] > max(1, tolerance * high[i]):
                new[i] = (low[i] + high[i]) // 2
        todo = new
    return spark.createDataFrame(list(high.items()), f"query_id {kind}, ef int")


def chosen_policy(width: Callable[[], Policy], rest: Callable[[], Policy], classifier: Trees | None = None) -> Callable[[], Policy]:
    """Both run from the start; where the next node is first farther than the k-th result one of them is chosen: by the
    classifier's probability of a half on what is observed there, or the width without a classifier."""

    def make() -> Policy:
        by_width, by_recall, choice = width(), rest(), None

        def stop(s: State, d: float) -> bool:
            nonlocal choice
            if choice is None and beyond(s, d):
                choice = by_width if classifier is None or classifier.probability(observe(s)) >= 0.5 else by_recall
            if choice is by_width:
                return by_width(s, d)
            return by_recall(s, d)

        return stop

    return make


def select_policy(classifier: Callable[[np.ndarray], float], one: Callable[[], Policy], other: Callable[[], Policy]) -> Callable[[], Policy]:
    """A policy by the query itself: `one` where the classifier's probability is at least a half."""

    def make() -> Policy:
        own: Policy | None = None

        def stop(s: State, d: float) -> bool:
            nonlocal own
            if own is None:
                own = (one if classifier(s.query) >= 0.5 else other)()
            return own(s, d)

        return stop

    return make


def query_features(d: int) -> list[str]:
    return [f"q{i}" for i in range(d)]


def train_selector(queries: DataFrame, costs: DataFrame, d: int) -> Callable[[np.ndarray], float]:
    """A classifier on the raw query for select_policy: costs has (query_id, one, other), the distances that either policy
    took, null where it missed the target. The label is whether `one` is the cheaper that doesn't miss."""
    better = F.col("one").isNotNull() & (F.col("other").isNull() | (F.col("one") <= F.col("other")))
    rows = queries.join(costs, "query_id").select(*[F.col("q")[i].alias(n) for i, n in enumerate(query_features(d))], better.cast("int").alias("y"))
    kinds = rows.agg(F.min("y"), F.max("y")).first()
    if kinds[0] == kinds[1]:
        share = float(kinds[0] or 0)
        return lambda q: share
    names = query_features(d)
    trees = train_classifier(rows, names)
    return lambda q: trees.probability(dict(zip(names, q.tolist(), strict=True)))


def stability_times(log: DataFrame, target: float) -> DataFrame:
    """(n, avg, min, max) over queries of the longest run of steps without a new result before the recall met the target:
    what stable_policy has to wait out."""
    w = Window.partitionBy("qid", "shard").orderBy("step")
    moved = log.withColumn("last", F.max(F.when(F.col("inserts") > F.coalesce(F.lag("inserts").over(w), F.lit(-1)), F.col("step"))).over(w))
    runs = moved.groupBy("qid", "shard").agg(F.max(F.when(F.col("r") < target, F.col("step") - F.col("last")).otherwise(0)).alias("stable"))
    return runs.agg(F.count("*").alias("n"), F.round(F.avg("stable"), 6).alias("avg"), F.min("stable").alias("min"), F.max("stable").alias("max"))


def optimal_stop(log: DataFrame, target: float) -> DataFrame:
    """(qid, dists, all): distances to where the recall first meets the target, which no policy can better, and of the
    whole walk; over all shards."""
    own = log.groupBy("qid", "shard").agg(F.min(F.when(F.col("r") >= target, F.col("dists"))).alias("dists"), F.max("dists").alias("whole"))
    return own.groupBy("qid").agg(F.sum(F.coalesce("dists", "whole")).alias("dists"), F.sum("whole").alias("all"))


def step_deltas(log: DataFrame, columns: list[str]) -> DataFrame:
    """The log with each column's change since the step before, 0 at the first."""
    w = Window.partitionBy("qid", "shard").orderBy("step")
    return log.select("*", *[(F.col(c) - F.coalesce(F.lag(c).over(w), F.col(c))).alias(f"{c}_delta") for c in columns])


def tune_multiplier(run: Callable[[float], float], target: float, low: float = 0.1, high: float = 8.0, steps: int = 8) -> float:
    """The least multiplier whose recall reaches the target, by bisection of a callable that measures it."""
    for _ in range(steps):
        mid = (low + high) / 2
        if run(mid) >= target:
            high = mid
        else:
            low = mid
    return high


def ivf_recall_search(index, queries: DataFrame, model: Trees, k: int, target: float, nprobe: int = 16, step: int = 2) -> DataFrame:
    """(query_id, rank, vec_id, distance, probed): inverted lists are read `step` probes at a time; after each the recall
    of every open query is predicted from its results, and queries at the target are done. A done query's further lists
    are not read for it, and lists that no open query probes are not read at all.

    The driver holds k results for each query of a block of checked size, and runs at most nprobe / step jobs a block.
    """
    from nearfield.operators.ivf import probes

    out = None
    for block in query_blocks(queries, dimension(queries, "q") + 3 * k + 2 * nprobe):
        part = _ivf_block(index, probes(block, index.centroids, nprobe, index.ip), model, k, target, nprobe, step)
        out = part if out is None else out.unionByName(part)
    return out


def ivf_state(found: list[tuple[float, int]], k: int, first: float, probe: int, codes: int, before: State | None) -> State:
    """What observe() needs of a search over lists: steps are probes, distances are codes read."""
    s = State(k, k, np.zeros(1), step=probe, ndis=codes, first=first)
    s.best = [(-d, i) for d, i in found[:k]]
    s.inserts = len({i for _, i in s.best} - ({i for _, i in before.best} if before else set())) + (before.inserts if before else 0)
    return s


def _ivf_steps(index, probed: DataFrame, k: int, nprobe: int, step: int, done: Callable[[int, State], bool]):
    """Yields after each block of probes: (probes so far, {query: State}, {query: [(distance, vec_id)]})."""
    rows = probed.select("query_id", "list_no", "probe", "coarse").collect()
    sizes = {r["list_no"]: r["count"] for r in index.lists.groupBy("list_no").count().collect()}  # at most nlist
    first = {r["query_id"]: float(r["coarse"]) for r in rows if r["probe"] == 1}
    by_query: dict = {}
    for r in sorted(rows, key=lambda r: r["probe"]):
        by_query.setdefault(r["query_id"], []).append(r["list_no"])
    found: dict = {i: [] for i in by_query}
    states: dict = {}
    open_ = set(by_query)
    for lo in range(0, nprobe, step):
        if not open_:
            return
        some = probed.where((F.col("probe") > lo) & (F.col("probe") <= lo + step)).where(F.col("query_id").isin(sorted(open_)))
        for r in _best(index.scan(some, k), k, index.ip).collect():
            found[r["query_id"]].append((r["distance"], r["vec_id"]))
        for i in sorted(open_):
            best = found[i] = sorted(found[i])[:k]
            own = by_query[i][: lo + step]
            states[i] = ivf_state(best, k, first[i], len(own), sum(sizes.get(x, 0) for x in own), states.get(i))
        yield lo + step, {i: states[i] for i in open_}, found
        open_ = {i for i in open_ if not done(i, states[i])}


def _ivf_block(index, probed: DataFrame, model: Trees, k: int, target: float, nprobe: int, step: int) -> DataFrame:
    def done(i: int, s: State) -> bool:
        s.predicted = min(1.0, max(0.0, model.predict(observe(s))))
        return s.predicted >= target

    probed_of: dict = {}
    found: dict = {}
    for _, states, found in _ivf_steps(index, probed, k, nprobe, step, done):
        probed_of |= {i: s.step for i, s in states.items()}
    rows = [(i, r + 1, v, d, probed_of[i]) for i, own in found.items() for r, (d, v) in enumerate(own)]
    return probed.sparkSession.createDataFrame(rows, "query_id long, rank int, vec_id long, distance double, probed int")


def ivf_trace(index, queries: DataFrame, truth: DataFrame, k: int, nprobe: int = 16, step: int = 2) -> DataFrame:
    """The observation log of searches over lists, as trace() gives it of graphs: queries are a bounded training set."""
    from nearfield.operators.ivf import probes

    true = {r["query_id"]: set(r["gt"]) for r in truth.groupBy("query_id").agg(F.collect_list("vec_id").alias("gt")).collect()}
    rows: list[tuple] = []
    names = ["qid", "shard", *observe(State(1, 1, np.zeros(1))), "r"]
    for _, states, found in _ivf_steps(index, probes(queries, index.centroids, nprobe, index.ip), k, nprobe, step, lambda i, s: False):
        for i, s in states.items():
            x = observe(s) | {"qid": i, "shard": 0, "r": len(true[i] & {v for _, v in found[i]}) / len(true[i])}
            rows.append(tuple(float(x[n]) for n in names))
    return queries.sparkSession.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
