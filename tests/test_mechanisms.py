"""Fits in single jobs, neighbour descent, list-major batches, manifests, two-level k-means and joins of near codes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.operators import binary, cluster, coarse, declarative, descent, graph, list_major, manifest, polysemous, quantize, search, sparse, spectral, sums, transforms, tuning, two_level
from nearfield.operators.ivf import IVF, DedupIVF, RefinedIVF
from nearfield.plans import offline, store
from nearfield.plans.factory import Index

VECTORS = "vec_id long, embedding array<float>"


def table(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in r]) for i, r in enumerate(x)], VECTORS)


def jobs(spark, name, f):
    """f's result and how many Spark jobs it took."""
    sc = spark.sparkContext
    sc.setJobGroup(name, name)
    try:
        out = f()
        return out, len(sc.statusTracker().getJobIdsForGroup(name))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


@pytest.fixture(scope="module")
def x():
    rng = np.random.default_rng(5)
    return (rng.standard_normal((12, 16))[rng.integers(0, 12, 400)] * 2 + rng.standard_normal((400, 16))).astype(np.float32)


def truth(x, k):
    d = ((x[:, None].astype(np.float64) - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    return np.sort(d, 1)[:, :k], d


# fits


def test_a_round_is_one_job_whatever_the_partitions(spark, x):
    counts = []
    for parts in (2, 24):
        v = table(spark, x).repartition(parts).persist()
        v.count()
        one = jobs(spark, f"one-{parts}", lambda v=v: cluster.KMeans(8, 1).fit(v))[1]
        four, n = jobs(spark, f"four-{parts}", lambda v=v: cluster.KMeans(8, 4).fit(v))
        counts.append((one, n))
        # adaptive execution makes a job of each stage: two a round
        assert n - one <= 6
    assert counts[0] == counts[1]
    assert jobs(spark, "pca", lambda: transforms.pca(table(spark, x).repartition(24), 4))[1] <= 3


def test_sums_of_long_arrays_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(sums, "CHUNK", 7)
    rows = spark.range(100).repartition(9)
    total = lambda batches: sum((np.arange(50.0) * b.num_rows for b in batches), np.zeros(50))
    assert np.allclose(sums.add_up(rows, total), np.arange(50) * 100)
    assert sums.add_up(rows, lambda batches: None) is None


def test_starting_rows_are_distinct_whatever_the_copies(spark, x):
    v = table(spark, np.concatenate([x[:5], np.repeat(x[:1], 300, 0)]))
    got = sums.least_by_hash(v, 4, 1)
    assert len(got) == 4 and len(np.unique(got, axis=0)) == 4
    assert len(sums.least_by_hash(v, 9, 1)) == 5
    assert len(sums.least_by_hash(v.limit(0), 3)) == 0


def test_a_broken_fit_goes_on_to_the_same_centroids(spark, x, tmp_path):
    v, at = table(spark, x), f"file://{tmp_path}/fit"
    whole = cluster.KMeans(6, 5).fit(v)
    cluster.KMeans(6, 2).fit(v, checkpoint=at)
    assert manifest.read_manifest(spark, at)["round"] == 2
    fit = cluster.KMeans(6, 5)
    again, n = jobs(spark, "resumed", lambda: fit.fit(v, checkpoint=at))
    assert np.array_equal(whole, again) and len(fit.stats) == 5
    other = cluster.KMeans(6, 5).fit(table(spark, x[:100]), checkpoint=at)
    assert np.array_equal(other, cluster.KMeans(6, 5).fit(table(spark, x[:100])))


# neighbour descent


def test_descent_finds_the_neighbours(spark, x):
    stats = []
    rows = descent.neighbour_descent(table(spark, x), 10, stats=stats).collect()
    last, d = truth(x, 10)
    assert len(rows) == 4000
    for r in rows:
        assert abs(r["distance"] - d[r["vec_id"], r["neighbor"]]) < 1e-3 and r["vec_id"] != r["neighbor"]
    hits = sum(r["distance"] <= last[r["vec_id"], -1] + 1e-3 for r in rows)
    assert hits >= 0.95 * len(rows)
    assert all(s["messages"] <= 400 * 30 for s in stats) and stats[-1]["updates"] <= 4


def test_descent_with_a_hub_and_copies(spark, x):
    """All rows link to a centre, a third are copies: what a node is sent stays bounded."""
    hub = np.concatenate([np.zeros((1, 16)), x[:200] / np.linalg.norm(x[:200], axis=1, keepdims=True), np.repeat(x[:1] * 9, 100, 0)])
    v, links = table(spark, hub), spark.createDataFrame([(i, 0, 1.0, True) for i in range(1, 301)], "node long, neighbor long, distance double, fresh boolean")
    _, messages = descent._meetings(links, v, 5, 1)
    assert messages.groupBy("at").count().agg(F.max("count")).first()[0] <= 5 + 10 + 1
    assert messages.groupBy("id").count().agg(F.max("count")).first()[0] <= 2 * 5 + 1
    rows = descent.neighbour_descent(v, 6).collect()
    assert all(r["distance"] == 0 for r in rows if r["vec_id"] > 200) and len(rows) == 301 * 6


def test_descent_of_few_rows(spark, x):
    assert descent.neighbour_descent(table(spark, x[:0]), 3).count() == 0
    assert descent.neighbour_descent(table(spark, x[:1]), 3).count() == 0
    assert descent.neighbour_descent(table(spark, x[:3]), 5).count() == 6
    odd = table(spark, x[:4]).unionByName(spark.createDataFrame([(None, [1.0] * 16), (9, None)], VECTORS))
    assert descent.neighbour_descent(odd, 2).count() == 8


# list-major batches


def made_index(spark, x, codec=None, by_residual=False):
    index = IVF(6, codec=codec, by_residual=by_residual)
    index.fit(table(spark, x), 3)
    return index.add(table(spark, x))


def as_rows(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], round(r["distance"], 4)) for r in df.collect())


def queries(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "query_id long, q array<float>")


@pytest.mark.parametrize("kind", ["flat", "pq"])
def test_list_major_is_the_probe_join(spark, x, tmp_path, monkeypatch, kind):
    monkeypatch.setattr(list_major, "SLAB_ROWS", 30)
    monkeypatch.setattr(list_major, "SLAB_QUERIES", 20)
    index = made_index(spark, x, quantize.ProductQuantizer(4, 4) if kind == "pq" else None, kind == "pq")
    q, log, at = queries(spark, x[:90]), [], f"file://{tmp_path}/{kind}"
    want = as_rows(index.search(q, 5, 3))
    assert as_rows(list_major.list_major_search(index, q, 5, 3, at, 3, log)) == want
    assert log == ["made"] * 3
    # a run that was broken off in the second range goes on there; another k makes all anew
    manifest.remove(spark, f"{at}/lists=2-4/{manifest.NAME}")
    log.clear()
    assert as_rows(list_major.list_major_search(index, q, 5, 3, at, 3, log)) == want
    assert log == ["kept", "made", "kept"]
    log.clear()
    assert as_rows(list_major.list_major_search(index, q, 4, 3, at, 3, log)) == as_rows(index.search(q, 4, 3))
    assert log == ["made"] * 3


def test_list_major_sends_no_queries_and_reads_lists_once(spark, x, tmp_path):
    index = made_index(spark, x)
    index.save(f"file://{tmp_path}/index")
    stored = IVF.load(spark, f"file://{tmp_path}/index")
    q = queries(spark, x[:40])
    assert as_rows(list_major.list_major_search(stored, q, 5, 2, f"file://{tmp_path}/out", 2)) == as_rows(index.search(q, 5, 2))
    nothing = list_major.list_major_search(stored, q.limit(0), 5, 2, f"file://{tmp_path}/none", 2)
    assert nothing.count() == 0
    with pytest.raises(ValueError, match="l1"):
        list_major.list_major_search(IVF(6, "l1", centroids=index.centroids, lists=index.lists), q, 5, 2, f"file://{tmp_path}/l1")


# manifests


def test_stages_are_kept_made_and_stale(spark, tmp_path):
    at, log = f"file://{tmp_path}/stages", []

    def run(rows, times=2, fail=False):
        log.clear()

        def broken(t):
            if fail:
                raise RuntimeError("broken off")
            return t["b"].agg(F.sum("x").alias("x"))

        stages = [
            manifest.Stage("a", lambda t: t["rows"].where("x > 1"), ("rows",)),
            manifest.Stage("b", lambda t: t["a"].selectExpr(f"x * {times} as x"), ("a",), {"times": times}),
            manifest.Stage("c", broken, ("b",)),
            manifest.Stage("other", lambda t: t["rows"].agg(F.count("*").alias("n")), ("rows",)),
        ]
        return manifest.run_stages(spark, at, {"rows": rows}, stages, log)

    rows = spark.range(5).select(F.col("id").alias("x"))
    with pytest.raises(RuntimeError):
        run(rows, fail=True)
    assert run(rows)["c"].first()[0] == 18
    assert log == [("a", "kept"), ("b", "kept"), ("c", "made"), ("other", "made")]
    run(rows.repartition(3).orderBy(F.desc("x")))
    assert {x[1] for x in log} == {"kept"}
    assert run(rows, times=3)["c"].first()[0] == 27
    assert log == [("a", "kept"), ("b", "made"), ("c", "made"), ("other", "kept")]
    assert run(rows.unionByName(rows.limit(1)), times=3)["other"].first()[0] == 6
    assert {x[1] for x in log} == {"made"}


# two levels


def test_fine_lists_are_fitted_in_the_same_rounds(spark, x):
    v = table(spark, x).repartition(6).persist()
    fit = two_level.TwoLevel(5, 4, niter=4)
    _, n = jobs(spark, "two", lambda: fit.fit(v))
    more = two_level.TwoLevel(15, 2, niter=4)
    assert jobs(spark, "more", lambda: more.fit(v))[1] <= n + 2
    goals = [s["objective"] for s in fit.stats]
    assert all(b <= a * 1.0001 for a, b in zip(goals, goals[1:], strict=False))
    got = fit.assign(v).collect()
    first = fit._first()
    for r in got:
        y = np.array(r["embedding"], dtype=np.float64)
        assert r["coarse_no"] == ((fit.coarse - y) ** 2).sum(1).argmin()
        d = ((fit.fine[r["coarse_no"]] - y) ** 2).sum(1)
        assert r["list_no"] == first[r["coarse_no"]] + d.argmin() and abs(r["list_dist"] - d.min()) < 1e-6
    assert sum(r["list_dist"] for r in got) <= goals[-1] < sum(((fit.coarse[r["coarse_no"]] - np.array(r["embedding"])) ** 2).sum() for r in got)
    assert 1 <= cluster.imbalance(fit.assign(v)).first()[0] < 4
    assert np.array_equal(two_level.TwoLevel(5, 4, niter=4).fit(v).centroids, fit.centroids)


def test_two_levels_of_copies_and_few_rows(spark, x):
    v = table(spark, np.concatenate([np.repeat(x[:1], 200, 0), x[:6]]))
    fit = two_level.TwoLevel(2, 8, niter=3).fit(v)
    assert fit.assign(v).count() == 206 and all(len(c) <= 8 for c in fit.fine)
    assert len(np.unique(fit.centroids, axis=0)) == len(fit.centroids)
    assert fit.assign(v.limit(0)).count() == 0


# near codes


@pytest.mark.parametrize(("bits", "radius"), [(64, 7), (40, 3), (96, 2), (64, 0)])
def test_near_codes_are_brute_force(spark, bits, radius):
    rng = np.random.default_rng(bits)
    base = rng.integers(0, 2, (20, bits))
    b = base[rng.integers(0, 20, 150)] ^ (rng.random((150, bits)) < 0.04)
    b = np.concatenate([b, np.repeat(b[:1], 80, 0)])
    pad = np.zeros((len(b), -(-bits // 32) * 32), int)
    pad[:, :bits] = b
    words = (pad.reshape(len(b), -1, 32) << np.arange(32)).sum(2)
    v = spark.createDataFrame([(i, [int(x) for x in w]) for i, w in enumerate(words)], "vec_id long, words array<long>")
    d = (b[:, None] != b[None]).sum(2)
    got = binary.match_counts(v, radius, bits)
    assert dict(got.collect()) == {i: int((d[i] <= radius).sum()) - 1 for i in range(len(b))}
    codes = binary.code_classes(v)
    pairs = binary.match_codes(codes, codes, radius, bits)
    first = {i: int(np.flatnonzero((b == b[i]).all(1))[0]) for i in range(len(b))}
    want = {(first[i], first[j], int(d[i, j])) for i in range(len(b)) for j in range(len(b)) if d[i, j] <= radius}
    rows = pairs.collect()
    assert len(rows) == len(want) and {(r["a_id"], r["b_id"], r["distance"]) for r in rows} == want
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_bits_stay_words_in_lists(spark, x):
    b = binary.to_binary(table(spark, x))
    codec = binary.BitWords(16)
    assert np.array_equal(codec.encode(codec.decode(codec.encode(x))), codec.encode(x))
    index = binary.BinaryIVF(4, 16).fit(b, 3).add(b)
    assert index.index.lists.columns == ["list_no", "vec_id", "code"]
    q = b.where("vec_id < 9").select(F.col("vec_id").alias("query_id"), F.col("words").alias("qw"))
    key = lambda df: sorted((r["query_id"], r["rank"], r["vec_id"], r["distance"]) for r in df.collect())
    assert key(index.search(q, 5, 4)) == key(binary.knn(q, b, 5))
    near = lambda df: sorted((r["query_id"], r["vec_id"], r["distance"]) for r in df.collect())
    assert near(index.range_search(q, 4, 4)) == near(binary.range_join(q, b, 4))


# additive lists and cells


@pytest.mark.parametrize("m", [1, 2, 3])
def test_nearest_sums_are_an_enumeration(m):
    rng = np.random.default_rng(m)
    books = [rng.standard_normal((5, 6)) / (j + 1) for j in range(m)]
    books[-1][1] = books[-1][0]  # ties go to the lower number
    x = rng.standard_normal((40, 6))
    grid = np.array(np.meshgrid(*[np.arange(5)] * m, indexing="ij")).reshape(m, -1).T
    sums = sum(b[grid[:, j]] for j, b in enumerate(books))
    assert np.array_equal(coarse.code_number(grid, books), np.arange(5**m))
    d = ((x[:, None] - sums[None]) ** 2).sum(2)
    want = np.lexsort((np.broadcast_to(np.arange(len(sums)), d.shape), np.round(d, 9)), axis=1)[:, :4]
    no, dist = coarse.nearest_sums(x, books, 4, 5 ** max(m - 1, 0))
    assert np.array_equal(no, want) and np.allclose(dist, np.take_along_axis(d, no, 1))
    narrow, _ = coarse.nearest_sums(x, books, 4, 2)
    assert np.mean([len(set(a) & set(b)) for a, b in zip(narrow.tolist(), want.tolist(), strict=True)]) > 2


@pytest.mark.parametrize("kind", ["residual", "local"])
def test_additive_lists_hold_all_rows_and_come_back(spark, x, tmp_path, kind):
    v, q = table(spark, x), queries(spark, x[:20])
    index = coarse.AdditiveIVF(0).fit(v, 2, 3, 3, kind).add(v)
    assert index.nlist == 64 and index.lists.count() == 400
    whole = as_rows(index.search(q, 5, 64))
    assert whole == as_rows(search.knn(q, v, 5))
    near = lambda df: sorted((r["query_id"], r["vec_id"]) for r in df.collect())
    assert near(index.range_search(q, 20.0, 64)) == near(search.range_join(q, v, 20.0))
    index.save(f"file://{tmp_path}/{kind}")
    again = coarse.AdditiveIVF.load(spark, f"file://{tmp_path}/{kind}")
    assert as_rows(again.search(q, 5, 6)) == as_rows(index.search(q, 5, 6))
    hits = len({r[:1] + r[2:3] for r in as_rows(index.search(q, 5, 16))} & {r[:1] + r[2:3] for r in whole})
    assert hits >= 60


def test_cells_are_walked_to_the_budget(spark, x):
    v, q = table(spark, x), queries(spark, x[:15])
    index = coarse.MultiIndex.fit(v, 2, 3, 3).add(v)
    cell = dict(index.lists.select("vec_id", "cell").collect())
    b = index.books
    part = lambda y, j: ((b[j] - y[8 * j : 8 * j + 8]) ** 2).sum(1)
    for i in range(400):
        assert cell[i] == part(x[i], 0).argmin() * 8 + part(x[i], 1).argmin()
    sizes = np.bincount(list(cell.values()), minlength=64)
    for budget, first in ((50, 2), (1000, 4)):
        walked = {}
        for r in index.walk(q, budget, first).collect():
            walked.setdefault(r["query_id"], set()).add(r["cell"])
        for i in range(15):
            d = (part(x[i], 0)[:, None] + part(x[i], 1)[None]).ravel()
            want, held = set(), 0
            for c in np.lexsort((np.arange(64), np.round(d, 9))).tolist():
                if held < budget and sizes[c]:
                    want.add(c)
                    held += sizes[c]
            assert walked[i] == want
    assert as_rows(index.search(q, 5, 1000)) == as_rows(search.knn(q, v, 5))


# tuning


def test_exploring_finds_what_the_sweep_finds_in_fewer_searches():
    for seed in range(20):
        rng = np.random.default_rng(seed)
        # steps up along both axes; perf saturates
        perf = np.minimum(np.cumsum(np.cumsum(rng.random((5, 6)) ** 4, 0), 1), 1.5).round(2)
        cost = np.cumsum(np.cumsum(rng.random((5, 6)), 0), 1)
        measure = lambda v: (float(perf[v["a"], v["b"]]), float(cost[v["a"], v["b"]]))  # noqa: B023, E731
        ranges = {"a": list(range(5)), "b": list(range(6))}
        space = tuning.ParameterSpace(ranges)
        got = space.explore(measure, seed)
        every = [tuning.Point((a, b), {}, *measure({"a": a, "b": b})) for a in range(5) for b in range(6)]
        assert [(p.perf, p.cost) for p in got] == [(p.perf, p.cost) for p in tuning.pareto_points(every)]
        assert len(space.measured) + space.skipped == 30 and space.skipped > 0
    one = tuning.ParameterSpace({"a": [7]})
    assert [p.values for p in one.explore(lambda v: (1.0, 2.0))] == [{"a": 7}]


# declared recall


def test_balanced_rows_are_bounded_and_thresholds_keep_the_promise(spark):
    rng = np.random.default_rng(1)
    rows = []
    for qid in range(200):
        need = int(rng.integers(20, 120))
        for step in range(150):
            r = min(1.0, round(step / need, 1))
            rows.append((qid, 0, step, r, float(min(1, step / need) + rng.normal() * 0.02), int(10 + step)))
    log = spark.createDataFrame(rows, "qid long, shard int, step long, r double, f double, width long").persist()
    own = declarative.balanced(log)
    per = own.groupBy("qid", F.when(F.col("r") >= 1, 10).otherwise(F.floor(F.col("r") * 10)).alias("b")).count().collect()
    assert max(r["count"] for r in per if r["b"] == 10) <= 20 and max(r["count"] for r in per if r["b"] < 10) <= 10
    assert {r["qid"] for r in per} == set(range(200)) and own.columns == log.columns
    assert sorted(own.collect()) == sorted(declarative.balanced(log.repartition(5)).collect())
    model = declarative.train(own.where("qid < 80"), ["f"])
    x = np.array([[0.1], [0.9], [1.2]])
    assert np.allclose(model.predict_all(x), [model.predict({"f": v[0]}) for v in x])
    above = declarative.threshold(log.where("qid between 80 and 139"), model, 0.9)
    end = declarative.predicted(log.where("qid >= 140"), model).groupBy("qid").agg(F.min(F.when(F.col("p") > above, F.struct("step", "r"))).alias("s")).collect()
    assert np.mean([r["s"] is None or r["s"]["r"] >= 0.9 for r in end]) >= 0.85
    assert np.mean([r["s"] is not None for r in end]) > 0.5
    assert declarative.threshold(log.where("qid < 5"), model, 0.9) == float("inf")
    log.unpersist()


def test_an_offline_index_goes_on_and_follows_its_rows(spark, x, tmp_path):
    path, log = f"file://{tmp_path}/offline", []
    v, q = table(spark, np.concatenate([x[:200], x[:20]])), queries(spark, x[:10])
    t = offline.offline_index(spark, path, v, q, 4, 2, 5, 4, 3, log)
    assert {h for _, h in log} == {"made"} and t["merged"].count() == 200 and t["consistency"].agg(F.max("n")).first()[0] == 0
    assert as_rows(t["found"]) == as_rows(t["exact"]) and t["recall"].agg(F.min("recall")).first()[0] == 1
    manifest.remove(spark, f"{path}/shard_1")
    log.clear()
    offline.offline_index(spark, path, v, q, 4, 2, 5, 4, 3, log)
    assert [n for n, h in log if h == "made"] == ["shard_1"]
    log.clear()
    offline.offline_index(spark, path, v, q, 4, 2, 5, 2, 3, log)
    assert [n for n, h in log if h == "made"] == ["found", "recall", "consistency"]
    log.clear()
    offline.offline_index(spark, path, v.where("vec_id <> 7"), q, 4, 2, 5, 2, 3, log)
    assert {h for _, h in log} == {"made"}


# spectral hash


@pytest.mark.parametrize("threshold", ["global", "centroid", "half", "median"])
def test_spectral_codes_are_brute_force(spark, x, threshold):
    v, q = table(spark, x), queries(spark, x[:8])
    fit = spectral.SpectralIVF(4, 12, 9.0, threshold).fit(v, 3)
    fit.add(v)
    c, codec = fit.index.centroids, fit.index.codec
    no = ((x[:, None].astype(np.float64) - c[None]) ** 2).sum(2).argmin(1)
    y = x.astype(np.float64) @ codec.projection.a.T + codec.projection.b
    if threshold == "median":
        for i in range(4):
            assert np.allclose(codec.thresholds[i], np.sort(y[no == i], 0)[(int((no == i).sum()) - 1) // 2], atol=0.2)
    else:
        want = {"global": 0 * c[:, :12], "centroid": c @ codec.projection.a.T + codec.projection.b, "half": c @ codec.projection.a.T + codec.projection.b - 2.25}[threshold]
        assert np.allclose(codec.thresholds, want)
    bits = lambda y, i: np.floor((y - codec.thresholds[i]) * 2 / 9.0).astype(int) % 2
    own = np.array([bits(y[j], no[j]) for j in range(400)])
    got = fit.search(q, 400, 4).collect()
    assert len(got) == 8 * 400
    for r in got[::37]:
        assert r["distance"] == (bits(y[r["query_id"]], no[r["vec_id"]]) != own[r["vec_id"]]).sum()


def test_spectral_shortlists_carry_the_recall(spark, x):
    v, q = table(spark, x), queries(spark, x[:30] + 0.05)
    # a period of some four deviations of a projection; a shortlist of 9 % of the rows
    fit = spectral.SpectralIVF(4, 64, 4.4).fit(v, 3, projection=transforms.random_rotation(16, 64)).add(v)
    found, exact = as_rows(fit.refine(q, v, 3, 36, 4)), as_rows(search.knn(q, v, 3))
    assert len({(r[0], r[2]) for r in found} & {(r[0], r[2]) for r in exact}) >= 0.9 * len(exact)
    with pytest.raises(ValueError, match="odd"):
        spectral.SpectralIVF(4, 4, 1.0, "odd").fit(v, 1)


# saving and loading


KINDS = ["IVF4,Flat", "PCA8,IVF4,SQ8", "L2norm,OPQ4,PQ4x4,RFlat", "IVF4,RQ2x3", "LSQ2x3", "LSH16rt,RFlat", "ITQ8,LSH8,RFlat", "HNSW8", "RR8,NSG8"]


@pytest.mark.parametrize("text", KINDS)
def test_factory_indexes_come_back(spark, x, tmp_path, text):
    v, q = table(spark, x[:150]), queries(spark, x[:8])
    index = Index(text).fit(v).add(v)
    store.save(spark, index, f"file://{tmp_path}/index")
    again = store.load(spark, f"file://{tmp_path}/index")
    assert as_rows(again.search(q, 4, nprobe=2)) == as_rows(index.search(q, 4, nprobe=2))


def test_other_indexes_come_back(spark, x, tmp_path):
    v, q = table(spark, x[:150]), queries(spark, x[:8])
    b = binary.to_binary(v)
    words = b.where("vec_id < 8").select(F.col("vec_id").alias("query_id"), F.col("words").alias("qw"))
    refined = RefinedIVF(IVF(4, codec=quantize.ProductQuantizer(4, 3), by_residual=True), quantize.ProductQuantizer(8, 3)).fit(v, 2).add(v)
    every = {
        "additive": (coarse.AdditiveIVF(0).fit(v, 2, 2, 2).add(v), lambda i: i.search(q, 4, 4)),
        "refined": (refined, lambda i: i.search(q, 4, 2)),
        "binary": (binary.BinaryIVF(3, 16).fit(b, 2).add(b), lambda i: i.search(words, 4, 2)),
        "spectral": (spectral.SpectralIVF(3, 8, 9.0, "median").fit(v, 2).add(v), lambda i: i.search(q, 4, 2)),
        "cells": (coarse.MultiIndex.fit(v, 2, 2, 2).add(v), lambda i: i.search(q, 4, 30)),
        "graph": (graph.build(v, 8), lambda i: graph.merged(graph.search(i, q, 4, 20), 4)),
        "levels": (two_level.TwoLevel(3, 2, 2).fit(v), lambda i: i.assign(v).select(F.col("vec_id").alias("query_id"), F.col("coarse_no").alias("rank"), F.col("list_no").alias("vec_id"), F.col("list_dist").alias("distance"))),
    }
    for name, (index, use) in every.items():
        store.save(spark, index, f"file://{tmp_path}/{name}")
        again = store.load(spark, f"file://{tmp_path}/{name}")
        assert as_rows(use(again)) == as_rows(use(index)), name
    lists = store.load(spark, f"file://{tmp_path}/additive").lists
    assert "PartitionFilters: [isnotnull(list_no" in lists.where("list_no = 3")._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError, match="elsewhere"):
        store.save(spark, store.load(spark, f"file://{tmp_path}/cells"), f"file://{tmp_path}/cells")
    manifest.remove(spark, f"file://{tmp_path}/cells/{manifest.NAME}")
    with pytest.raises(FileNotFoundError):
        store.load(spark, f"file://{tmp_path}/cells")


# sparse rows


def test_sparse_kmeans_is_the_dense_one(spark, x, monkeypatch):
    monkeypatch.setattr(sparse, "PRODUCTS", 2000)
    y = np.where(np.abs(x) > 2, x, 0).astype(np.float32)
    y[7] = 0
    v = table(spark, y).repartition(3)
    rows = sparse.to_sparse(v)
    start = y[[0, 50, 90, 200, 300]].astype(np.float64)
    dense, own = cluster.KMeans(5, 6).fit(v, init=start), sparse.sparse_kmeans(rows, 5, 16, 6, init=start)
    assert np.allclose(dense, own, atol=1e-9)
    a = {r["vec_id"]: (r["list_no"], r["list_dist"]) for r in cluster.assign(v, dense).collect()}
    b = {r["vec_id"]: (r["list_no"], r["list_dist"]) for r in sparse.sparse_assign(rows, dense).collect()}
    assert a.keys() == b.keys() and all(a[i][0] == b[i][0] and abs(a[i][1] - b[i][1]) < 1e-9 for i in a)


def test_sparse_starts_and_empty_tables(spark, x):
    rows = sparse.to_sparse(table(spark, np.concatenate([np.repeat(x[:1], 50, 0), x[:3]])), 1.0)
    c = sparse.sparse_kmeans(rows, 6, 16, 0)
    assert len(c) == 3 and len(np.unique(c, axis=0)) == 3
    assert sparse.sparse_kmeans(rows.limit(0), 3, 16).shape == (0, 16)
    odd = spark.createDataFrame([(1, [], []), (2, None, None), (3, [2], [1.0])], "vec_id long, dims array<int>, vals array<double>")
    got = {r["vec_id"]: r["list_dist"] for r in sparse.sparse_assign(odd, np.eye(4)[:2]).collect()}
    assert got == {1: 1.0, 3: 2.0}


# polysemous codes


def test_codes_far_in_bits_are_skipped_at_a_known_recall(spark, x):
    v, q = table(spark, x), queries(spark, x[:40])
    codec = polysemous.Polysemous(quantize.ProductQuantizer(4, 4)).fit(v, 4)
    exact = search.knn(q, v, 5)
    codec.most = polysemous.threshold(codec, q, v, exact, 0.95)
    assert 0 < codec.most < 16
    codes = codec.encode(x.astype(np.float64))
    bits = np.array([[sum(bin(int(a) ^ int(b)).count("1") for a, b in zip(m, n, strict=True)) for n in codes] for m in codes[:40]])
    assert np.array_equal(codec.differing(x[:40].astype(np.float64), codes), bits)
    true = [bits[r["query_id"], r["vec_id"]] for r in exact.collect()]
    assert np.mean([b <= codec.most for b in true]) >= 0.95 > np.mean([b <= codec.most - 1 for b in true])
    assert {r["bits"]: r["n"] for r in polysemous.histogram(codec, q, v).collect()} == {int(b): int(n) for b, n in zip(*np.unique(bits, return_counts=True), strict=True)}
    assert (bits > codec.most).mean() > 0.3
    index = IVF(1, codec=codec, centroids=np.zeros((1, 16))).add(v)
    whole = codec.pq.adc(x[:40].astype(np.float64), codes).round(6)
    whole[bits > codec.most] = np.inf
    for i, rank, j, d in as_rows(index.search(q, 5, 1)):
        order = np.lexsort((np.arange(400), whole[i]))
        assert j == order[rank - 1] and abs(d - whole[i, j]) < 1e-3
    assert polysemous.threshold(codec, q, v, exact.limit(0)) == 16


def test_copies_in_lists_are_k_ids_at_most(spark, x):
    y = np.concatenate([x[:60], np.repeat(x[:1], 90, 0)])
    v, q = table(spark, y), queries(spark, x[:6])
    base = IVF(3).fit(v, 2).add(v)
    assert as_rows(DedupIVF(base).search(q, 7, 2)) == as_rows(base.search(q, 7, 2))
    assert DedupIVF(base).lists(7, [0, 1, 2]).agg(F.max(F.size("ids"))).first()[0] == 7
