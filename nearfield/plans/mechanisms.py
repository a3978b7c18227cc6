"""Registered queries of neighbour descent, list-major batches, two-level k-means and joins of near codes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.operators import binary, cluster, declarative, descent, evaluate, graph, search
from nearfield.operators.coarse import AdditiveIVF, MultiIndex
from nearfield.operators.ivf import IVF, RefinedIVF, hash_search, probes
from nearfield.operators.list_major import list_major_search
from nearfield.operators.polysemous import Polysemous, histogram
from nearfield.operators.quantize import ProductQuantizer, SignHash
from nearfield.operators.sparse import sparse_assign, to_sparse
from nearfield.operators.spectral import SpectralIVF
from nearfield.operators.transforms import Linear
from nearfield.operators.tuning import ParameterSpace
from nearfield.operators.two_level import TwoLevel
from nearfield.plans.offline import offline_index
from nearfield.plans.queries import _B, _D, _KM, _V, EVERY, Q, V, _calibrated, _ivf_sql, _log, _whole, first_centroids, training
from nearfield.sources import vecs

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


@query("SELECT count(*) AS n_queries, TRUE AS reached, TRUE AS linear, TRUE AS ended FROM embeddings WHERE vec_id % 100 = 0")
def descent_graph(spark, sf: str) -> DataFrame:
    """The graph of all rows by descent. Of every hundredth row's ten neighbours, 0.9 or more are no farther than the exact
    tenth; a round shuffles at most 3 * k vectors a row; few links were new in the last one."""
    v, k, stats = V(spark, sf), 20, []
    links = descent.neighbour_descent(v, k, stats=stats, wide=2 * k)
    own = links.where("vec_id % 100 = 0 and rank <= 10").select(F.col("vec_id").alias("query_id"), "distance")
    # a row is no neighbour of itself
    exact = search.knn(Q(v), v, 11).where("query_id <> vec_id").groupBy("query_id").agg(F.sort_array(F.collect_list("distance")).alias("d"))
    hits = exact.select("query_id", F.get("d", F.least(F.size("d"), F.lit(10)) - 1).alias("last")).join(own, "query_id", "left")
    hits = hits.groupBy("query_id").agg(F.count_if(F.col("distance") <= F.col("last") + 1e-6).alias("n"))
    n = v.count()
    linear = all(s["messages"] <= n * 3 * k for s in stats)
    ended = bool(stats) and stats[-1]["updates"] <= 0.001 * stats[-1]["links"]
    return hits.agg(F.count("*").alias("n_queries"), (F.avg("n") >= 9).alias("reached")).select("n_queries", "reached", F.lit(linear).alias("linear"), F.lit(ended).alias("ended"))


@query(_ivf_sql())
def list_major(spark, sf: str) -> DataFrame:
    """ivf_flat's rows, list by list."""
    v = V(spark, sf)
    index = IVF(16)
    index.centroids = first_centroids(v, 16)
    path = descent.shared_path(spark, "list-major")
    return list_major_search(index.add(v), Q(v), 10, 4, path, 4)


_TWO = (
    _KM.replace("list_no < 16", "list_no < 4")
    + ", f0 AS (SELECT list_no, row_number() OVER (PARTITION BY list_no ORDER BY vec_id) - 1 AS sub, v AS q FROM a JOIN v USING (vec_id) QUALIFY sub < 3)"
    + f", s1 AS (SELECT vec_id, list_no, arg_min(sub, (round({_D['l2']}, 9), sub)) AS sub FROM a JOIN v USING (vec_id) JOIN f0 USING (list_no) GROUP BY vec_id, list_no)"
    + ", x AS (SELECT list_no, sub, dim, avg(x) AS m FROM (SELECT list_no, sub, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM s1 JOIN v USING (vec_id)) GROUP BY list_no, sub, dim)"
    + ", f1 AS (SELECT list_no, sub, list(m ORDER BY dim) AS q FROM x GROUP BY list_no, sub)"
)


@query(f"WITH {_TWO} SELECT vec_id, list_no AS coarse_no, CAST(list_no * 3 + arg_min(sub, (round({_D['l2']}, 9), sub)) AS INTEGER) AS list_no FROM a JOIN v USING (vec_id) JOIN f1 USING (list_no) GROUP BY vec_id, list_no")
def two_level_lists(spark, sf: str) -> DataFrame:
    """One round of the fine level from stated starts: the first four vectors, and in each of their lists the first three."""
    v = V(spark, sf)
    coarse = first_centroids(v, 4)
    inside = cluster.assign(v, coarse).withColumn("r", F.row_number().over(Window.partitionBy("list_no").orderBy("vec_id")))
    rows = inside.where("r <= 3").orderBy("list_no", "r").select("list_no", "embedding").collect()  # 12 rows
    fine = [np.array([r[1] for r in rows if r[0] == i], dtype=np.float64).reshape(-1, coarse.shape[1]) for i in range(4)]
    return TwoLevel(4, 3, niter=1).fit(v, coarse, fine).assign(v).select("vec_id", "coarse_no", "list_no")


_ALL = _B.replace("WHERE vec_id % 100 = 0", "")


@query(f"WITH {_ALL} SELECT query_id AS vec_id, count(*) FILTER (WHERE distance <= 7) - 1 AS n FROM p GROUP BY query_id")
def hamming_match_counts(spark, sf: str) -> DataFrame:
    """For every row, the others within 7 of 64 bits, by equal slices of 8 bits."""
    return binary.match_counts(binary.to_binary(V(spark, sf)), 7, 64)


@query("SELECT t AS target, (SELECT count(*) FROM embeddings WHERE vec_id % 5 = 2) AS n_queries, TRUE AS kept, TRUE AS saved FROM (SELECT unnest([0.9, 0.95]) AS t)")
def declared_promise(spark, sf: str) -> DataFrame:
    """For recalls of 0.90 and 0.95, of queries that neither model nor threshold have seen: whether nine in ten are at
    what was declared, and whether that takes at most half the distances of the search without a stop."""
    return spark.createDataFrame([(t, n, hit >= 0.9, whole >= 2 * own) for t, n, hit, own, whole in promises(spark, sf)], "target double, n_queries long, kept boolean, saved boolean")


def promises(spark, sf: str, targets: tuple[float, ...] = (0.9, 0.95)) -> list[tuple[float, int, float, float, float]]:
    """(target, queries, share at the target, distances with and without a stop) of all held-out queries. Model and
    thresholds are from all rows of all queries of the other splits."""
    v = V(spark, sf)
    g = graph.build(v, 12).persist()
    ef, log = _whole(v, g, "vec_id % 5 = 1", every=True)
    own = _log(v, g, "vec_id % 5 > 2", ef, every=True)
    model, above = _calibrated(log, own, targets, every=True)
    for x in (log, own):
        descent.forget(x)
    held, some = training(v, "vec_id % 5 = 2", every=True), graph.slices(g)
    exact = descent.written(search.knn(held, v, 10), "truth")
    whole, out = graph.cost(graph.search(g, held, 10, ef, slices=some)), []
    for t, a in zip(targets, above, strict=True):
        found = graph.search(g, held, 10, ef, declarative.recall_policy(model, t, above=a, every=EVERY), slices=some).persist()
        n, hit = evaluate.recall(graph.merged(found, 10), exact, 10).agg(F.count("*"), F.avg((F.col("recall") >= t).cast("double"))).first()
        out.append((t, n, hit, graph.cost(found), whole))
        found.unpersist()
    g.unpersist()
    return out


def _halves(v: DataFrame) -> np.ndarray:
    """Books that SQL can state: the halves of the first eight vectors."""
    first = first_centroids(v, 8)
    return np.stack([first[:, :32], first[:, 32:]])


def _two_books(v: DataFrame) -> list[np.ndarray]:
    """Books that SQL can state: the first eight vectors, and half of the eight after them."""
    first = first_centroids(v, 16)
    return [first[:8], first[8:] / 2]


_SUMS = (
    f"{_V}, f AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS c, v FROM v QUALIFY c < 16)"
    + ", s AS (SELECT CAST(a.c * 8 + b.c - 8 AS INTEGER) AS list_no, list_transform(range(1, 65), lambda i: a.v[i] + b.v[i] / 2) AS v FROM f a, f b WHERE a.c < 8 AND b.c >= 8)"
    + f", pr AS (SELECT query_id, list_no, row_number() OVER (PARTITION BY query_id ORDER BY round({_D['l2']}, 9), list_no) AS probe FROM q, s)"
)


@query(f"WITH {_SUMS} SELECT query_id, list_no, CAST(probe AS INTEGER) AS probe FROM pr WHERE probe <= 12")
def additive_probes(spark, sf: str) -> DataFrame:
    """The twelve nearest of 64 sums, by a beam over two books."""
    v = V(spark, sf)
    return AdditiveIVF(64, books=_two_books(v), beam=8).probes(Q(v), 12).select("query_id", "list_no", "probe")


_SWAP = _D["l2"].replace("q[i]", "s.v[i]").replace(" v[i]", " v.v[i]").replace("len(q)", "len(s.v)")


@query(
    f"WITH {_SUMS}, a AS (SELECT vec_id, arg_min(list_no, (round({_SWAP}, 9), list_no)) AS list_no FROM v, s GROUP BY vec_id)"
    f", r AS (SELECT query_id, vec_id, round({_D['l2']}, 6) AS distance FROM pr JOIN a USING (list_no) JOIN v USING (vec_id) JOIN q USING (query_id) WHERE probe <= 12)"
    ", z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM r) SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, distance FROM z WHERE rank <= 10"
)
def additive_lists(spark, sf: str) -> DataFrame:
    """The ten nearest in twelve of 64 lists that are named by two codes."""
    v = V(spark, sf)
    return AdditiveIVF(64, books=_two_books(v), beam=8).add(v).search(Q(v), 10, 12)


_CELLS = (
    f"{_V}, f AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS c, v FROM v QUALIFY c < 8)"
    + ", h AS (SELECT unnest([0, 1]) AS j)"
    + ", e AS (SELECT x.vec_id, j, arg_min(c, (round(list_sum(list_transform(range(32 * j + 1, 32 * j + 33), lambda i: (x.v[i] - f.v[i]) * (x.v[i] - f.v[i]))), 9), c)) AS c FROM v x, f, h GROUP BY x.vec_id, j)"
    + ", l AS (SELECT a.vec_id, a.c * 8 + b.c AS cell FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.j = 0 AND b.j = 1)"
    + ", d AS (SELECT query_id, c, j, list_sum(list_transform(range(32 * j + 1, 32 * j + 33), lambda i: (q[i] - v[i]) * (q[i] - v[i]))) AS d FROM q, f, h)"
    + ", p AS (SELECT a.query_id, a.c * 8 + b.c AS cell, a.d + b.d AS d FROM d a JOIN d b ON a.query_id = b.query_id AND a.j = 0 AND b.j = 1)"
    + ", n AS (SELECT cell, count(*) AS n FROM l GROUP BY cell)"
    + ", w AS (SELECT query_id, cell, coalesce(sum(n) OVER (PARTITION BY query_id ORDER BY round(d, 9), cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p JOIN n USING (cell))"
)


@query(
    f"WITH {_CELLS}, r AS (SELECT w.query_id, v.vec_id, round({_D['l2']}, 6) AS distance FROM w JOIN l USING (cell) JOIN v USING (vec_id) JOIN q ON q.query_id = w.query_id WHERE before < 100)"
    ", z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM r) SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, distance FROM z WHERE rank <= 10"
)
def multi_index_lists(spark, sf: str) -> DataFrame:
    """The ten nearest among the rows of 64 cells, walked until a hundred rows are met."""
    v = V(spark, sf)
    return MultiIndex(_halves(v)).add(v).search(Q(v), 10, 100)


_TUNED = (
    f"WITH {_KM}, pr AS (SELECT query_id, list_no, row_number() OVER (PARTITION BY query_id ORDER BY round(list_sum(list_transform(range(1, len(w) + 1), lambda i: (w[i] - c[i]) * (w[i] - c[i]))), 9), list_no) AS probe FROM (SELECT query_id, q AS w FROM q) s, (SELECT list_no, q AS c FROM c) t)"
    + ", x AS (SELECT list_no, vec_id, row_number() OVER (PARTITION BY list_no ORDER BY vec_id) AS pos, count(*) OVER (PARTITION BY list_no) AS n FROM a)"
    + ", b AS (SELECT query_id, list_no, probe, n, coalesce(sum(n) OVER (PARTITION BY query_id ORDER BY probe ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pr JOIN (SELECT DISTINCT list_no, n FROM x) USING (list_no))"
    + ", g AS (SELECT * FROM (SELECT unnest([1, 4, 16]) AS nprobe), (SELECT unnest([50, 150, 450]) AS budget))"
    + f", e AS (SELECT query_id, vec_id FROM (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY round({_D['l2']}, 6), vec_id) AS r FROM q, v) WHERE r <= 10)"
    + ", h AS (SELECT nprobe, budget, count(*) AS hits FROM g, e JOIN x USING (vec_id) JOIN b USING (query_id, list_no) WHERE probe <= nprobe AND pos <= budget - before GROUP BY nprobe, budget)"
    + ", k AS (SELECT nprobe, budget, sum(greatest(0, least(n, budget - before))) AS cost FROM g, b WHERE probe <= nprobe GROUP BY nprobe, budget)"
    + ", p AS (SELECT DISTINCT CAST(coalesce(hits, 0) AS BIGINT) AS hits, CAST(cost AS BIGINT) AS codes FROM k LEFT JOIN h USING (nprobe, budget))"
)


@query(f"{_TUNED} SELECT hits, codes, TRUE AS fewer FROM p WHERE NOT EXISTS (SELECT 1 FROM p o WHERE o.hits >= p.hits AND o.codes <= p.codes AND (o.hits > p.hits OR o.codes < p.codes))")
def tuned_parameters(spark, sf: str) -> DataFrame:
    """The Pareto points of probes by budgets of codes: true neighbours found and codes read by all queries; and that not
    all combinations were measured."""
    v = V(spark, sf)
    index = IVF(16)
    index.centroids = first_centroids(v, 16)
    index.add(v)
    index.lists = descent.written(index.lists, "lists")
    q, exact = Q(v), descent.written(search.knn(Q(v), v, 10).select("query_id", "vec_id"), "exact")
    sizes, order = index.lists.groupBy("list_no").agg(F.count("*").alias("n")), probes(q, index.centroids, 16)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("query_id").orderBy("probe").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    read = descent.written(order.join(sizes, "list_no").select("query_id", "probe", "n", before.alias("before")), "sizes")

    def measure(x: dict) -> tuple[float, float]:
        hits = index.search(q, 10, x["nprobe"], x["max_codes"]).join(exact, ["query_id", "vec_id"], "left_semi").count()
        left = F.greatest(F.lit(0), F.least("n", x["max_codes"] - F.col("before")))
        return hits, read.where(F.col("probe") <= x["nprobe"]).agg(F.sum(left)).first()[0]

    space = ParameterSpace({"nprobe": [1, 4, 16], "max_codes": [50, 150, 450]})
    points = space.explore(measure)
    return spark.createDataFrame([(int(p.perf), int(p.cost), space.skipped > 0) for p in points], "hits long, codes long, fewer boolean")


_DISTINCT = "SELECT count(*) FROM (SELECT DISTINCT embedding FROM embeddings)"


@query(
    f"SELECT * FROM (SELECT unnest(['missing', 'unknown', 'twice', 'in a wrong list', 'found but not there', 'made again']) AS check, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'rows in lists', ({_DISTINCT})"
    f" UNION ALL SELECT 'copies', (SELECT count(*) FROM embeddings) UNION ALL SELECT 'results', (SELECT count(*) FROM embeddings WHERE vec_id % 100 = 0) * least(10, ({_DISTINCT})))"
)
def offline_pipeline(spark, sf: str) -> DataFrame:
    """An index made offline over all rows, its checks, and that a second run makes nothing again."""
    v, path = V(spark, sf).select("vec_id", "embedding"), descent.shared_path(spark, "offline")
    log: list[tuple[str, str]] = []
    offline_index(spark, path, v, Q(v))
    t = offline_index(spark, path, v, Q(v), log=log)
    count = lambda name, df, n=F.count("*"): df.agg(n.cast("long").alias("n")).select(F.lit(name).alias("check"), "n")
    again = spark.createDataFrame([("made again", sum(how == "made" for _, how in log))], "check string, n long")
    return t["consistency"].unionByName(again).unionByName(count("rows in lists", t["merged"])).unionByName(count("copies", t["distinct"], F.sum("copies"))).unionByName(count("results", t["found"]))


_BITS = (
    f"WITH {_KM}, pr AS (SELECT query_id, list_no, row_number() OVER (PARTITION BY query_id ORDER BY round(list_sum(list_transform(range(1, len(w) + 1), lambda i: (w[i] - c[i]) * (w[i] - c[i]))), 9), list_no) AS probe FROM (SELECT query_id, q AS w FROM q) s, (SELECT list_no, q AS c FROM c) t)"
    + ", b AS (SELECT vec_id, list_no, list_transform(range(1, 33), lambda i: CAST(floor((v.v[i] - (c.q[i] - 0.125)) * 4.0) AS BIGINT) & 1) AS b FROM a JOIN v USING (vec_id) JOIN c USING (list_no))"
    + ", w AS (SELECT query_id, list_no, list_transform(range(1, 33), lambda i: CAST(floor((q.q[i] - (c.q[i] - 0.125)) * 4.0) AS BIGINT) & 1) AS b FROM pr JOIN q USING (query_id) JOIN c USING (list_no) WHERE probe <= 4)"
)


@query(
    f"{_BITS}, r AS (SELECT query_id, vec_id, CAST(list_sum(list_transform(range(1, 33), lambda i: CASE WHEN w.b[i] <> b.b[i] THEN 1 ELSE 0 END)) AS DOUBLE) AS distance FROM w JOIN b USING (list_no))"
    ", z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM r) SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, distance FROM z WHERE rank <= 10"
)
def spectral_lists(spark, sf: str) -> DataFrame:
    """The ten of least Hamming distance in four lists: bits of the first 32 components around each list's centroid."""
    v = V(spark, sf)
    index = SpectralIVF(16, 32, 0.5).fit(v, centroids=first_centroids(v, 16), projection=Linear(np.eye(32, 64)))
    return index.add(v).search(Q(v), 10, 4)


_SPARSE = "v AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN abs(CAST(x AS DOUBLE)) > 0.1 THEN CAST(x AS DOUBLE) ELSE 0 END) AS v FROM embeddings)"


@query(f"WITH {_SPARSE}, c AS (SELECT CAST(row_number() OVER (ORDER BY vec_id) - 1 AS INTEGER) AS list_no, v AS q FROM v QUALIFY list_no < 16) SELECT vec_id, CAST(len(list_filter(any_value(v), lambda x: x <> 0)) AS INTEGER) AS n, arg_min(list_no, (round({_D['l2']}, 9), list_no)) AS list_no FROM v, c GROUP BY vec_id")
def sparse_lists(spark, sf: str) -> DataFrame:
    """Components over 0.1 as sparse rows, and the nearest of the first sixteen for each."""
    rows = to_sparse(V(spark, sf), 0.1)
    first = rows.orderBy("vec_id").limit(16).collect()
    c = np.zeros((len(first), 64))
    for i, r in enumerate(first):
        c[i, r["dims"]] = r["vals"]
    return sparse_assign(rows, c).select("vec_id", F.size("dims").alias("n"), "list_no")


_POLY = (
    f"{_V}, f AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS c, v FROM v QUALIFY c < 16), h AS (SELECT unnest(range(0, 8)) AS j)"
    + ", g AS (SELECT x.vec_id, j, c, list_sum(list_transform(range(8 * j + 1, 8 * j + 9), lambda i: (x.v[i] - f.v[i]) * (x.v[i] - f.v[i]))) AS d FROM v x, f, h)"
    + ", e AS (SELECT vec_id, j, arg_min(c, (round(d, 9), c)) AS c FROM g GROUP BY vec_id, j)"
    + ", p AS (SELECT a.vec_id AS query_id, b.vec_id, sum(bit_count(xor(CAST(a.c AS BIGINT), CAST(b.c AS BIGINT)))) AS bits, sum(t.d) AS d FROM e a JOIN e b USING (j) JOIN g t ON t.vec_id = a.vec_id AND t.j = a.j AND t.c = b.c WHERE a.vec_id % 100 = 0 GROUP BY a.vec_id, b.vec_id)"
)


@query(
    f"WITH {_POLY}, r AS (SELECT query_id, vec_id, round(d, 6) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 6), vec_id) AS rank FROM p WHERE bits <= 10)"
    " SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, distance, (SELECT count(*) FROM p WHERE bits > 10) AS skipped FROM r WHERE rank <= 10"
)
def polysemous_codes(spark, sf: str) -> DataFrame:
    """The ten nearest by codes of 32 bits among those that differ in at most ten of them, and how many were skipped."""
    v = V(spark, sf).select("vec_id", "embedding")
    first = first_centroids(v, 16)
    codec = Polysemous(ProductQuantizer(8, 4, np.stack([first[:, 8 * j : 8 * j + 8] for j in range(8)])), 10)
    index = IVF(1, codec=codec, centroids=np.zeros((1, 64))).add(v)
    skipped = histogram(codec, Q(v), v).agg(F.coalesce(F.sum(F.when(F.col("bits") > 10, F.col("n"))), F.lit(0)).alias("skipped"))
    return index.search(Q(v), 10, 1).crossJoin(skipped)  # one row


_FILES = (
    "WITH x AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS place, embedding AS e, list_transform(embedding, lambda x: CAST(least(greatest(floor((CAST(x AS DOUBLE) + 1) * 128), 0), 255) AS BIGINT)) AS b FROM embeddings WHERE embedding IS NOT NULL)"
    ", k AS (SELECT unnest(['bvecs', 'fbin', 'fvecs', 'ivecs']) AS kind)"
)


@query(f"{_FILES} SELECT kind, place, CAST(len(e) AS INTEGER) AS d, CASE WHEN kind IN ('fvecs', 'fbin') THEN round(list_sum(list_transform(e, lambda x: CAST(x AS DOUBLE))), 5) ELSE CAST(list_sum(b) AS DOUBLE) END AS total FROM x, k")
def vector_files(spark, sf: str) -> DataFrame:
    """All vectors as files of the four kinds (as bytes and whole numbers, components by 128 from -1 up), read back; a
    vector's place is its rank by id."""
    v = V(spark, sf).where("embedding is not null").select("vec_id", "embedding")
    whole = v.withColumn("embedding", F.transform("embedding", lambda x: F.least(F.greatest(F.floor((x.cast("double") + 1) * 128), F.lit(0)), F.lit(255)).cast("int")))
    out = None
    for kind in sorted(vecs.KINDS):
        path = descent.shared_path(spark, kind)
        vecs.write_vecs(v if kind in ("fvecs", "fbin") else whole, path, kind)
        total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
        part = vecs.read_vecs(spark, path, kind=kind).select(F.lit(kind).alias("kind"), F.col("vec_id").alias("place"), F.size("embedding").alias("d"), F.round(total, 5).alias("total"))
        out = part if out is None else out.unionByName(part)
    return out


def _part(a: str, b: str) -> str:
    """Squared distance of the eight components of part j."""
    return f"list_sum(list_transform(range(8 * j + 1, 8 * j + 9), lambda i: ({a} - {b}) * ({a} - {b})))"


#: Books of eight parts that SQL can state: the first sixteen vectors' slices, halved for what the lists leave over.
_ADC = (
    f"WITH {_KM}, pr AS (SELECT query_id, list_no, row_number() OVER (PARTITION BY query_id ORDER BY round(list_sum(list_transform(range(1, len(w) + 1), lambda i: (w[i] - c[i]) * (w[i] - c[i]))), 9), list_no) AS probe FROM (SELECT query_id, q AS w FROM q) s, (SELECT list_no, q AS c FROM c) t)"
    + ", f AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS c, v FROM v QUALIFY c < 16), h AS (SELECT unnest(range(0, 8)) AS j)"
    + ", r AS (SELECT vec_id, list_no, list_transform(range(1, 65), lambda i: CAST(CAST(v.v[i] - c.q[i] AS FLOAT) AS DOUBLE)) AS r FROM a JOIN v USING (vec_id) JOIN c USING (list_no))"
    + f", e AS (SELECT vec_id, j, arg_min(c, (round({_part('r.r[i]', 'f.v[i] / 2')}, 9), c)) AS c FROM r, f, h GROUP BY vec_id, j)"
    + f", t AS (SELECT query_id, list_no, j, f.c, {_part('q.q[i] - c.q[i]', 'f.v[i] / 2')} AS d FROM pr JOIN q USING (query_id) JOIN c USING (list_no), f, h WHERE probe <= 4)"
    + ", p AS (SELECT query_id, vec_id, round(sum(d), 6) AS distance FROM t JOIN a USING (list_no) JOIN e USING (vec_id, j, c) GROUP BY query_id, vec_id)"
    + ", z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM p)"
)


def _stated_pq(v: DataFrame) -> IVF:
    first = first_centroids(v, 16)
    return IVF(16, codec=_slices(first / 2), by_residual=True, centroids=first)


def _slices(x: np.ndarray) -> ProductQuantizer:
    return ProductQuantizer(8, 4, np.stack([x[:, 8 * j : 8 * j + 8] for j in range(8)]))


@query(f"{_ADC} SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(distance, 5) AS distance FROM z WHERE rank <= 10")
def residual_codes(spark, sf: str) -> DataFrame:
    """The ten nearest in four of sixteen lists by product codes of what the centroids leave over, from stated books."""
    v = V(spark, sf).select("vec_id", "embedding")
    return _stated_pq(v).add(v).search(Q(v), 10, 4).withColumn("distance", F.round("distance", 5))


@query(
    f"{_ADC}, y AS (SELECT e.vec_id, e.j, list_transform(range(8 * e.j + 1, 8 * e.j + 9), lambda i: CAST(CAST(f.v[i] / 2 AS FLOAT) + c.q[i] AS FLOAT)) AS y FROM e JOIN f ON f.c = e.c JOIN a ON a.vec_id = e.vec_id JOIN c ON c.list_no = a.list_no)"
    + ", l AS (SELECT vec_id, j, y, list_transform(range(1, 9), lambda i: CAST(CAST(v.v[8 * j + i] - y[i] AS FLOAT) AS DOUBLE)) AS l FROM y JOIN v USING (vec_id))"
    + ", g AS (SELECT vec_id, j, any_value(y) AS y, arg_min(c, (round(list_sum(list_transform(range(1, 9), lambda i: (l.l[i] - f.v[8 * j + i] / 4) * (l.l[i] - f.v[8 * j + i] / 4))), 9), c)) AS c FROM l, f GROUP BY vec_id, j)"
    + ", w AS (SELECT z.query_id, z.vec_id, round(sum(list_sum(list_transform(range(1, 9), lambda i: (q.q[8 * g.j + i] - CAST(g.y[i] + CAST(f.v[8 * g.j + i] / 4 AS FLOAT) AS FLOAT)) ** 2))), 6) AS distance FROM z JOIN g USING (vec_id) JOIN f ON f.c = g.c JOIN q ON q.query_id = z.query_id WHERE rank <= 40 GROUP BY z.query_id, z.vec_id)"
    + ", x AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM w) SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(distance, 5) AS distance FROM x WHERE rank <= 10"
)
def refined_codes(spark, sf: str) -> DataFrame:
    """residual_codes' forty nearest, ranked again by a second code of what the first leaves over, without raw vectors."""
    v = V(spark, sf).select("vec_id", "embedding")
    index = RefinedIVF(_stated_pq(v), _slices(first_centroids(v, 16) / 4), k_factor=4).add(v)
    return index.search(Q(v), 10, 4).withColumn("distance", F.round("distance", 5))


_SIGNS = f"{_V}, b AS (SELECT vec_id, list_transform(range(1, 49), lambda i: v[i] >= 0.02) AS b FROM v)"


@query(
    f"WITH {_SIGNS}, p AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(len(list_filter(range(1, 49), lambda i: a.b[i] <> b.b[i])) AS DOUBLE) AS distance FROM b a, b WHERE a.vec_id % 100 = 0)"
    ", r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM p) SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, distance FROM r WHERE rank <= 10"
)
def sign_codes(spark, sf: str) -> DataFrame:
    """The ten of least Hamming distance by 48 signs: the first components against a threshold."""
    v = V(spark, sf)
    return hash_search(Q(v), v, SignHash(48, np.eye(48, 64), 0.02), 10)
