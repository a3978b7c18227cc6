"""Declared recall: features, labels, policies and their choice."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.operators import declarative, evaluate, graph, search
from nearfield.operators.ivf import IVF


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(20, 12)) * 2
    x = centers[rng.integers(0, 20, 500)] + rng.normal(size=(500, 12))
    v = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>").cache()
    g = graph.build(v, 8).cache()
    train = search.queries_of(v, "vec_id % 10 = 1").cache()
    truth = search.knn(train, v, 5).cache()
    return v, g, train, truth, declarative.trace(g, train, truth, 5, 40).cache()


def test_running_duration_equals_a_full_count(world):
    v, g, *_ = world
    shard = next(s for _, s in graph.load_shards(iter(g.orderBy("shard", "level", "node").toArrow().to_batches()), []))
    for i in range(0, 60, 7):
        slow = {"visited": None, "duration": 0}

        def both(s, d, slow=slow):
            visited = sum(j in s.expanded for j in s.nearest())
            slow["duration"] = slow["duration"] + 1 if slow["visited"] == visited else 0
            slow["visited"] = visited
            declarative.tick(s, d)
            assert (s.memory["visited"], s.memory["duration"]) == (visited, slow["duration"])
            return False

        graph.walk(shard, shard.x[i] + 0.1, 5, 30, both)


def test_the_log_grows_and_ends_well(world):
    log = world[-1]
    last = log.groupBy("qid").agg(F.max_by("r", "step").alias("r"), F.max("dists").alias("n")).collect()
    assert np.mean([r["r"] for r in last]) > 0.95
    best = {r["qid"]: r for r in declarative.optimal_stop(log, 0.9).collect()}
    assert all(best[r["qid"]]["dists"] <= r["n"] == best[r["qid"]]["all"] for r in last)
    times = declarative.stability_times(log, 0.9).first()
    assert times["n"] == len(last) and 0 <= times["min"] <= times["avg"] <= times["max"]
    delta = declarative.step_deltas(log, ["dists"]).groupBy("qid").agg(F.sum("dists_delta").alias("s"), (F.max("dists") - F.min("dists")).alias("d"))
    assert delta.where("s <> d").count() == 0


def test_labels_are_of_where_widths_are_predicted(world):
    log = world[-1]
    rows = declarative.width_rows(log)
    first = {r[0]: r[1] for r in log.where("beyond = 1").groupBy("qid").agg(F.min("step")).collect()}
    assert {r["qid"]: r["step"] for r in rows.collect()} == first
    assert log.where("beyond = 1").count() < log.count()


def test_least_widths_are_narrow(world):
    v, g, train, truth, _ = world
    ef = {r["query_id"]: r["ef"] for r in declarative.least_width(g, train, truth, 5, 0.95, 64, tolerance=0.0).collect()}
    for i in sorted(ef)[:6]:
        q, t = train.where(F.col("query_id") == i), truth.where(F.col("query_id") == i)
        at = lambda w, q=q, t=t: evaluate.recall(graph.merged(graph.search(g, q, 5, w), 5), t, 5).first()["recall"]
        assert at(ef[i]) >= 0.95 or ef[i] == 64
        assert ef[i] == 5 or at(ef[i] - 1) < 0.95


def test_widths_of_one_trace_are_those_of_searches(world):
    v, g, train, truth, _ = world
    wide = declarative.trace(g, train, truth, 5, 64)
    read = {r["qid"]: r["ef"] for r in declarative.widths(wide, 0.95, 64).collect()}
    found = {r["query_id"]: r["ef"] for r in declarative.least_width(g, train, truth, 5, 0.95, 64, tolerance=0.0).collect()}
    assert read == found


def test_a_classifier_chooses(spark, world):
    v, g, train, truth, log = world
    trees = declarative.train_classifier(log.withColumn("y", (F.col("dists") > 100).cast("int")), ["dists", "inserts"])
    assert trees.probability({"dists": 20.0, "inserts": 5.0}) < 0.5 < trees.probability({"dists": 300.0, "inserts": 9.0})
    assert trees.importance["dists"] > 0.9 and sum(trees.importance.values()) == pytest.approx(1)
    costs = train.select("query_id", F.when(F.col("q")[0] > 0, 10).alias("one"), F.lit(20).alias("other"))
    prob = declarative.train_selector(train, costs, 12)
    assert np.mean([(prob(np.array(r["q"])) >= 0.5) == (r["q"][0] > 0) for r in train.collect()]) > 0.9
    calls = []
    make = lambda name: lambda: lambda s, d: calls.append(name) or False
    s = graph.State(2, 2, np.zeros(12), best=[(-1.0, 0), (-2.0, 1)])
    p = declarative.select_policy(lambda q: 1.0, make("one"), make("other"))()
    p(s, 1.0)
    both = declarative.chosen_policy(make("width"), make("recall"))()
    both(s, 1.5)
    both(s, 2.5)
    assert calls == ["one", "recall", "width"]
    declarative.chosen_policy(make("width"), make("recall"), declarative.Trees([], [], np.zeros(0)))()(s, 3.0)
    assert calls[-1] == "width"


def test_budgets_are_tuned(world):
    got = declarative.tune_multiplier(lambda m: min(1.0, m / 4), 0.5)
    assert abs(got - 2.0) < 0.1


def test_models_are_compared(world):
    r2 = declarative.compare_models(world[-1], ["dists", "inserts", "nn_dist"])
    assert set(r2) == {"linear", "forest", "boosted"} and r2["boosted"] > 0.3


def test_lists_are_read_until_the_target(world):
    v, _, train, truth, _ = world
    index = IVF(16).fit(v, 3).add(v)
    log = declarative.ivf_trace(index, train, truth, 5, 16, 2).cache()
    ends = log.groupBy("qid").agg(F.max_by("r", "step").alias("r")).collect()
    assert all(r["r"] == 1.0 for r in ends)
    model = declarative.train(log, declarative.RECALL_FEATURES)
    q = search.queries_of(v, "vec_id % 50 = 3")
    found = declarative.ivf_recall_search(index, q, model, 5, 0.95, 16, 2).cache()
    exact = search.knn(q, v, 5)
    assert evaluate.recall(found, exact, 5).agg(F.avg("recall")).first()[0] >= 0.8
    assert found.agg(F.avg("probed")).first()[0] < 16
    whole = declarative.ivf_recall_search(index, q, model, 5, 2.0, 16, 2)
    cols = ["query_id", "rank", "vec_id"]
    assert sorted(whole.select(*cols).collect()) == sorted(exact.select(*cols).collect())


def test_runs_and_targets(spark):
    log = spark.createDataFrame([(q, s, 10 * s, min(1.0, s / 5), s, 1.0) for q in (1, 2) for s in range(1, 9)], "qid long, step long, dists long, r double, inserts long, nn_dist double")
    goal = {r["qid"]: r[1] for r in evaluate.distances_to_target(log, 0.8).collect()}
    assert goal == {1: 40, 2: 40}
    assert evaluate.recall_correlation(log, ["dists"]).first()[0] is not None
    scores = spark.createDataFrame([(1, 0.95), (2, 0.85)], "query_id long, recall double")
    assert evaluate.hit_ratio(scores, 0.9).first()[0] == 0.5
    assert math.isclose(declarative.fixed(5)()(graph.State(1, 1, np.zeros(1), ndis=5), 0.0), True)


def test_degrees_of_results(world):
    v, g, train, truth, _ = world
    deg = {r["node"]: len(r["neighbors"]) for r in g.where("level = 0").collect()}
    own = {}
    for r in truth.collect():
        own.setdefault(r["query_id"], {})[r["rank"]] = deg[r["vec_id"]]
    got = {r["query_id"]: (r["avg_degree"], r["degree_0"]) for r in evaluate.degrees(truth, g, 5).collect()}
    assert got == {i: (sum(x.values()) // 5, x[1]) for i, x in own.items()}


def shards_log(spark):
    """Query 1 has three true neighbours in shard 0 and one in shard 1; query 2 has one that is never found."""
    rows = [(1, 0, 3, 0 / 3, 0.9, 10, 5), (1, 0, 3, 2 / 3, 0.2, 20, 6), (1, 0, 3, 3 / 3, 0.3, 40, 9)]
    rows += [(1, 1, 1, 0.0, 0.4, 15, 5), (1, 1, 1, 0.0, 0.7, 30, 7), (1, 1, 1, 1.0, 0.1, 90, 8), (2, 0, 1, 0.0, 0.5, 7, 5)]
    return spark.createDataFrame(rows, "qid long, shard int, near int, r double, p double, dists int, width int")


def test_what_a_stop_needs_is_of_all_shards(spark):
    log = shards_log(spark)
    at = lambda value, target, before=False: {r["qid"]: r["s"] for r in declarative.needed(log, F.col(value), target, before).collect()}
    # two found after 0.9, one after 0.9 as well (it stays the highest), and one after 0.7
    assert at("p", 0.25, True) == {1: 0.7, 2: math.inf} and at("p", 1.0, True) == {1: 0.9, 2: math.inf}
    assert at("dists", 0.5) == {1: 20, 2: math.inf} and at("dists", 0.75) == {1: 40, 2: math.inf} and at("dists", 1.0)[1] == 90
    assert {r["qid"]: r["ef"] for r in declarative.widths(log, 1.0, 64).collect()} == {1: 9, 2: 64}


def test_each_shard_has_a_budget_and_a_query_pays_for_all(spark):
    goal = {(r["qid"], r["shard"]): r["dists_for_max_recall"] for r in evaluate.budget_targets(shards_log(spark)).collect()}
    assert goal == {(1, 0): 40, (1, 1): 90, (2, 0): 7}
    found = spark.createDataFrame([(1, 5, 10, 0), (1, 6, 10, 0), (1, 7, 30, 1), (2, 5, 20, 0), (2, 8, 40, 1)], "query_id long, vec_id long, ndis long, shard int")
    assert graph.cost(found) == 50.0


def test_factors_keep_a_promise_over_shards(spark, monkeypatch):
    log = shards_log(spark)
    wide = spark.range(3, 60).selectExpr("id AS qid", "0 AS shard", "1 AS near", "1.0D AS r", "0.5D AS p", "10 AS dists", "5 AS width")
    rows = log.unionByName(wide).where("qid <> 2")
    monkeypatch.setattr(declarative, "predicted", lambda log, model: log.withColumn("p", F.lit(10.0)))
    # of 58 queries one needs 90 / 10 to have all, the others 10 / 10
    assert declarative.factor(rows, rows.select("qid", "shard").distinct(), None, "dists", 1.0) == 1.0
    assert declarative.factor(rows, rows.select("qid", "shard").distinct(), None, "dists", 1.0, 0.98) == 9.0


def test_multiples_of_predictions_end_walks():
    trees = declarative.Trees([], [], np.zeros(0))  # predicts 0, which counts as 1
    s = graph.State(2, 50, np.zeros(3), best=[(-1.0, 0), (-2.0, 1)], ndis=60)
    declarative.width_policy(trees, 7.0)()(s, 3.0)
    assert s.ef == 7
    declarative.width_policy(trees, math.inf)()(s, 3.0)
    assert s.ef == 7  # no narrower than it was
    assert declarative.budget_policy(trees, 40, 60.0)()(s, 1.0) and not declarative.budget_policy(trees, 40, math.inf)()(s, 1.0)
