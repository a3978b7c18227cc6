"""The library's queries over the embeddings, lineitem and events tables, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.functions import vectors as fv
from nearfield.operators import binary, cluster, declarative, descent, evaluate, graph, quantize, search, transforms
from nearfield.operators.ivf import IVF, DedupIVF, RefinedIVF, multi_index, probes
from nearfield.plans.factory import Index

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def V(spark, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/embeddings.parquet")


def Q(v: DataFrame) -> DataFrame:
    """The stated query set: every hundredth id, against all rows."""
    return search.queries_of(v)


def first_centroids(v: DataFrame, k: int) -> np.ndarray:
    """A fixed start that SQL can state as well: the k least ids' vectors."""
    return np.array([r[0] for r in v.orderBy("vec_id").limit(k).select("embedding").collect()], dtype=np.float64)


# --- SQL pieces -------------------------------------------------------------------------------------------------------

_V = "v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), q AS (SELECT vec_id AS query_id, v AS q FROM v WHERE vec_id % 100 = 0)"
_D = {
    "l2": "list_sum(list_transform(range(1, len(q) + 1), lambda i: (q[i] - v[i]) * (q[i] - v[i])))",
    "ip": "list_sum(list_transform(range(1, len(q) + 1), lambda i: q[i] * v[i]))",
    "l1": "list_sum(list_transform(range(1, len(q) + 1), lambda i: abs(q[i] - v[i])))",
    "linf": "list_max(list_transform(range(1, len(q) + 1), lambda i: abs(q[i] - v[i])))",
    "lp": "list_sum(list_transform(range(1, len(q) + 1), lambda i: pow(abs(q[i] - v[i]), 3)))",
    "canberra": "list_sum(list_transform(range(1, len(q) + 1), lambda i: CASE WHEN abs(q[i]) + abs(v[i]) = 0 THEN CAST('nan' AS DOUBLE) ELSE abs(q[i] - v[i]) / (abs(q[i]) + abs(v[i])) END))",
    "bray_curtis": "list_sum(list_transform(range(1, len(q) + 1), lambda i: abs(q[i] - v[i]))) / list_sum(list_transform(range(1, len(q) + 1), lambda i: abs(q[i] + v[i])))",
    "jaccard": "list_sum(list_transform(range(1, len(q) + 1), lambda i: least(abs(q[i]), abs(v[i])))) / list_sum(list_transform(range(1, len(q) + 1), lambda i: greatest(abs(q[i]), abs(v[i]))))",
    "jensen_shannon": "list_sum(list_transform(range(1, len(q) + 1), lambda i: (CASE WHEN abs(q[i]) > 0 THEN abs(q[i]) * ln(abs(q[i]) / ((abs(q[i]) + abs(v[i])) / 2)) ELSE 0 END) + (CASE WHEN abs(v[i]) > 0 THEN abs(v[i]) * ln(abs(v[i]) / ((abs(q[i]) + abs(v[i])) / 2)) ELSE 0 END))) / 2",
}


def _knn_sql(metric: str, k: int, greater: bool = False, where: str = "TRUE", names: str = "query_id, CAST(rank AS INTEGER) AS rank, vec_id, distance") -> str:
    return f"WITH {_V}, p AS (SELECT query_id, vec_id, round({_D[metric]}, 6) AS distance FROM q, v WHERE {where}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance {'DESC' if greater else 'ASC'}, vec_id) AS rank FROM p WHERE NOT isnan(distance)) SELECT {names} FROM r WHERE rank <= {k}"


def _knn_query(name: str, k: int = 10, arg: float = 2.0, absolute: bool = False):
    def run(spark, sf: str) -> DataFrame:
        v = V(spark, sf)
        if absolute:
            v = v.withColumn("embedding", F.transform("embedding", lambda x: F.abs(x)))
        return search.knn(Q(v), v, k, name, arg)

    run.__name__ = f"knn_{name}"
    QUERIES[run.__name__] = run
    SQL[run.__name__] = _knn_sql(name, k, name in ("ip", "jaccard"))


for _n in ("l2", "ip", "l1", "linf", "canberra", "bray_curtis"):
    _knn_query(_n)
_knn_query("lp", arg=3.0)
_knn_query("jaccard", absolute=True)
_knn_query("jensen_shannon", absolute=True)


@query(f"WITH {_V}, n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM v) SELECT vec_id, round(n, 6) AS norm, round(list_sum(list_transform(v, lambda x: x / n)), 6) AS unit_sum FROM n")
def norms(spark, sf):
    v = V(spark, sf)
    return v.select("vec_id", F.round(F.sqrt(fv.norm_sqr(F.col("embedding"))), 6).alias("norm"), F.round(F.aggregate(fv.normalize(F.col("embedding")), F.lit(0.0), lambda a, x: a + x), 6).alias("unit_sum"))


@query(f"WITH {_V} SELECT query_id, vec_id, round({_D['l2']}, 6) AS distance FROM q, v WHERE round({_D['l2']}, 6) < 1.2")
def range_l2(spark, sf):
    v = V(spark, sf)
    return search.range_join(Q(v), v, 1.2)


@query(f"WITH {_V} SELECT query_id, vec_id, round({_D['ip']}, 6) AS distance FROM q, v WHERE round({_D['ip']}, 6) > 0.4")
def range_ip(spark, sf):
    v = V(spark, sf)
    return search.range_join(Q(v), v, 0.4, "ip")


@query(_knn_sql("l2", 5, where="vec_id >= (SELECT max(vec_id) FROM embeddings) // 4 AND NOT (vec_id % 3 = 0 AND vec_id % 2 = 1)"))
def knn_selector(spark, sf):
    """A range that follows the table's ids, less every sixth."""
    v = V(spark, sf)
    odd = (F.col("vec_id") % 3 == 0) & (F.col("vec_id") % 2 == 1)
    last = v.agg(F.max("vec_id")).first()[0] or 0
    return search.knn(Q(v), v, 5, selector=search.id_range(last // 4, last + 1) & ~odd)


@query(_knn_sql("l2", 5))
def knn_sharded(spark, sf):
    v = V(spark, sf)
    return search.sharded(Q(v), v, 4, 5)


@query(_knn_sql("l2", 5))
def knn_arrow(spark, sf):
    v = V(spark, sf)
    return search.knn_arrow(Q(v), v, 5).withColumn("distance", F.round("distance", 6))


@query(_knn_sql("l2", 5))
def knn_split_dimensions(spark, sf):
    v = V(spark, sf)
    return search.split_dimensions(Q(v), v, 4, 5)


@query(f"WITH {_V}, p AS (SELECT query_id, vec_id, round({_D['ip']}, 6) AS ip, round({_D['l2']}, 6) AS l2 FROM q, v), c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ip DESC, vec_id) AS r FROM p), s AS (SELECT query_id, vec_id, l2, row_number() OVER (PARTITION BY query_id ORDER BY l2, vec_id) AS rank FROM c WHERE r <= 20) SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, l2 AS distance FROM s WHERE rank <= 5")
def refine(spark, sf):
    v = V(spark, sf)
    return search.rerank(search.knn(Q(v), v, 20, "ip"), Q(v), v, 5)


@query(f"WITH {_V}, p AS (SELECT query_id, vec_id, round({_D['l2']}, 6) AS distance FROM q, v), b AS (SELECT *, row_number() OVER (PARTITION BY query_id, vec_id % 8 ORDER BY distance, vec_id) AS r FROM p), s AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM b WHERE r <= 4) SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, distance FROM s WHERE rank <= 10")
def approximate_top(spark, sf):
    v = V(spark, sf)
    return search.approximate_top(Q(v), v, 10)


@query(f"WITH {_V}, e AS (SELECT * FROM v WHERE vec_id % 2 = 0), o AS (SELECT * FROM v WHERE vec_id % 2 = 1), p AS (SELECT a.vec_id AS query_id, b.vec_id, round({_D['ip'].replace('q[i]', 'a.v[i]').replace(' v[i]', ' b.v[i]').replace('len(q)', 'len(a.v)')}, 6) AS d FROM e a, o b), ab AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d DESC, vec_id) AS r FROM p), ba AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d DESC, query_id) AS r FROM p), ma AS (SELECT query_id, avg(d) AS ma FROM ab WHERE r <= 4 GROUP BY query_id), mb AS (SELECT vec_id, avg(d) AS mb FROM ba WHERE r <= 4 GROUP BY vec_id) SELECT query_id, vec_id, round(2 * d / (ma + mb), 6) AS margin FROM ab JOIN ma USING (query_id) JOIN mb USING (vec_id) WHERE r <= 4 AND round(2 * d / (ma + mb), 6) > 1.06")
def margin_mining(spark, sf):
    v = V(spark, sf)
    return search.margin_pairs(v.where("vec_id % 2 = 0"), v.where("vec_id % 2 = 1"), 4, 1.06)


@query("SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM embeddings WHERE label = 3)")
def remove_ids(spark, sf):
    v = V(spark, sf)
    return search.remove_ids(v, v.where("label = 3")).select("vec_id")


@query("SELECT row_number() OVER (ORDER BY vec_id) - 1 AS vec_id, label FROM embeddings WHERE label <> 3")
def remove_and_compact(spark, sf):
    return search.compacted(V(spark, sf).where("label <> 3")).select("vec_id", "label")


@query("SELECT vec_id, label FROM embeddings UNION ALL SELECT vec_id + 1000000 AS vec_id, label FROM embeddings WHERE label < 5")
def merge_shifted(spark, sf):
    v = V(spark, sf).select("vec_id", "label")
    return search.append_shifted(v, v.where("label < 5"), 1_000_000)


@query("WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x >= 0 THEN 1 ELSE 0 END) AS b FROM embeddings) SELECT vec_id, list_sum(list_transform(range(0, 32), lambda i: CAST(b[i + 1] AS BIGINT) << i))::BIGINT AS w0, list_sum(list_transform(range(0, 32), lambda i: CAST(b[i + 33] AS BIGINT) << i))::BIGINT AS w1 FROM s")
def binarize(spark, sf):
    return binary.to_binary(V(spark, sf)).select("vec_id", F.col("words")[0].alias("w0"), F.col("words")[1].alias("w1"))


_B = "b AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x >= 0 THEN 1 ELSE 0 END) AS v FROM embeddings), q AS (SELECT vec_id AS query_id, v AS q FROM b WHERE vec_id % 100 = 0), p AS (SELECT query_id, vec_id, CAST(list_sum(list_transform(range(1, len(q) + 1), lambda i: CASE WHEN q[i] <> v[i] THEN 1 ELSE 0 END)) AS DOUBLE) AS distance FROM q, b)"


def _binary(spark, sf):
    b = binary.to_binary(V(spark, sf))
    return b.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("words").alias("qw")), b


@query(f"WITH {_B}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM p) SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, distance FROM r WHERE rank <= 10")
def hamming_knn(spark, sf):
    return binary.knn(*_binary(spark, sf), 10)


@query(f"WITH {_B} SELECT query_id, vec_id, distance FROM p WHERE distance < 24")
def hamming_range(spark, sf):
    return binary.range_join(*_binary(spark, sf), 24)


@query(f"WITH {_B} SELECT CAST(distance AS INTEGER) AS distance, count(*) AS n FROM p GROUP BY 1")
def hamming_histogram(spark, sf):
    return binary.histogram(*_binary(spark, sf))


def reached(bound: float, name: str, n: str = "(SELECT count(*) FROM embeddings WHERE vec_id % 100 = 0)") -> str:
    return f"SELECT '{name}' AS index, {n} AS n_queries, TRUE AS reached"


def at_least(found: DataFrame, truth: DataFrame, k: int, bound: float, name: str) -> DataFrame:
    """One row: whether the mean share of results that are no farther than the exact k-th reaches the bound. Brute force
    over all rows is the truth."""
    last = truth.groupBy("query_id").agg(F.max("distance").alias("last"))
    hits = found.where(F.col("rank") <= k).join(last, "query_id").where(F.col("distance") <= F.col("last") + 1e-6).groupBy("query_id").agg(F.count("*").alias("n"))
    r = last.join(hits, "query_id", "left").agg(F.count("*").alias("n_queries"), F.avg(F.coalesce("n", F.lit(0)) / k).alias("recall"))
    return r.select(F.lit(name).alias("index"), "n_queries", (F.col("recall") >= bound).alias("reached"))


#: The results behind the digests.
SEARCHES: dict[str, Callable] = {}


def digested(exact: str, bound: float = 0.9, k: int = 10):
    """Registers a search as the digest of its recall, against a registered exact search."""

    def keep(f):
        SEARCHES[f.__name__] = f

        def run(spark, sf):
            return at_least(f(spark, sf), QUERIES[exact](spark, sf), k, bound, f.__name__)

        run.__name__ = f.__name__
        return query(reached(bound, f.__name__))(run)

    return keep


@digested("hamming_knn")
def binary_multihash(spark, sf):
    q, b = _binary(spark, sf)
    return binary.hash_search(q, b, 10, bits=8, tables=8, flips=1)


@query(f"WITH {_B}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM p) SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, distance FROM r WHERE rank <= 10")
def binary_ivf_all_probes(spark, sf):
    q, b = _binary(spark, sf)
    return binary.BinaryIVF(8, 64).fit(b, 3).add(b).search(q, 10, 8)


@digested("hamming_knn")
def binary_graph(spark, sf):
    q, b = _binary(spark, sf)
    return binary.graph_search(binary.build_graph(b, 64, 16), q, 64, 10, 128)


_KM = _V + ", c AS (SELECT CAST(row_number() OVER (ORDER BY vec_id) - 1 AS INTEGER) AS list_no, v AS q FROM v QUALIFY list_no < 16), a AS (SELECT vec_id, arg_min(list_no, (round(" + _D["l2"] + ", 9), list_no)) AS list_no FROM v, c GROUP BY vec_id)"


@query(f"WITH {_KM} SELECT vec_id, list_no FROM a")
def kmeans_assign(spark, sf):
    v = V(spark, sf)
    return cluster.assign(v, first_centroids(v, 16)).select("vec_id", "list_no")


@query(f"WITH {_KM}, x AS (SELECT list_no, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS dim FROM a JOIN v USING (vec_id)) SELECT list_no, CAST(dim AS INTEGER) AS dim, round(avg(x), 6) AS mean FROM x GROUP BY ALL")
def kmeans_update(spark, sf):
    v = V(spark, sf)
    rows = cluster.centroid_sums(cluster.assign(v, first_centroids(v, 16)), 64)
    return rows.select("list_no", F.posexplode(F.array(*[F.round(F.col(f"x{i}") / F.col("w"), 6) for i in range(64)])).alias("dim", "mean"))


@query(f"WITH {_KM}, n AS (SELECT list_no, count(*) AS n FROM a GROUP BY 1) SELECT round(count(*) * sum(n * n) / (sum(n) * sum(n)), 6) AS imbalance FROM n")
def imbalance_factor(spark, sf):
    v = V(spark, sf)
    return cluster.imbalance(cluster.assign(v, first_centroids(v, 16)))


@query("SELECT count(*) AS n, CAST(least(16, count(*)) AS BIGINT) AS lists, TRUE AS better FROM embeddings")
def kmeans_fit(spark, sf):
    """A fit's lists hold all rows, and its objective is below that of the first vectors as centroids."""
    v = V(spark, sf)
    fitted, first = (cluster.assign(v, c) for c in (cluster.KMeans(16, 8).fit(v), first_centroids(v, 16)))
    total = first.agg(F.sum("list_dist").alias("first"))
    own = fitted.agg(F.count("*").alias("n"), F.countDistinct("list_no").alias("lists"), F.sum("list_dist").alias("own"))
    return own.crossJoin(total).select("n", "lists", (F.col("own") < F.col("first")).alias("better"))


@query("WITH x AS (SELECT unnest(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings) SELECT CAST(dim AS INTEGER) AS dim, count(*) AS n, round(min(x), 6) AS min, round(max(x), 6) AS max, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, count(*) FILTER (WHERE x = 0) AS n_zero, count(*) FILTER (WHERE isnan(x)) AS n_nan FROM x GROUP BY dim")
def matrix_stats(spark, sf):
    return cluster.matrix_stats(V(spark, sf), 64)


@query("SELECT count(*) AS n_distinct, CAST(sum(n - 1) AS BIGINT) AS n_repeats FROM (SELECT count(*) AS n FROM embeddings GROUP BY embedding)")
def duplicate_vectors(spark, sf):
    return cluster.duplicate_rows(V(spark, sf))


@query("SELECT CAST(least(greatest(floor(l_extendedprice / 2500), 0), 39) AS INTEGER) AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def price_histogram(spark, sf):
    return cluster.histogram(spark.read.parquet(f"{sf}/lineitem.parquet"), "l_extendedprice", 0, 100_000, 40)


def _fixed_ivf(spark, sf) -> tuple[IVF, DataFrame]:
    v = V(spark, sf)
    index = IVF(16)
    index.centroids = first_centroids(v, 16)
    return index.add(v), Q(v)


def _ivf_sql(limit: str = "TRUE") -> str:
    d = "list_sum(list_transform(range(1, len(w.q) + 1), lambda i: (w.q[i] - v.v[i]) * (w.q[i] - v.v[i])))"
    p = "pr AS (SELECT query_id, list_no, row_number() OVER (PARTITION BY query_id ORDER BY round(list_sum(list_transform(range(1, len(w) + 1), lambda i: (w[i] - c[i]) * (w[i] - c[i]))), 9), list_no) AS probe FROM (SELECT query_id, q AS w FROM q) s, (SELECT list_no, q AS c FROM c) t)"
    return f"WITH {_KM}, {p}, x AS (SELECT a.list_no, a.vec_id, v.v, row_number() OVER (PARTITION BY a.list_no ORDER BY a.vec_id) AS pos, count(*) OVER (PARTITION BY a.list_no) AS n FROM a JOIN v USING (vec_id)), b AS (SELECT pr.*, coalesce(sum(s.n) OVER (PARTITION BY query_id ORDER BY probe ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pr JOIN (SELECT DISTINCT list_no, n FROM x) s USING (list_no) WHERE probe <= 4), r AS (SELECT w.query_id, v.vec_id, round({d}, 6) AS distance FROM b JOIN x v USING (list_no) JOIN q w ON w.query_id = b.query_id WHERE {limit}), z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM r) SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, distance FROM z WHERE rank <= 10"


@query(_ivf_sql())
def ivf_flat(spark, sf):
    index, q = _fixed_ivf(spark, sf)
    return index.search(q, 10, 4)


@query(_ivf_sql("pos <= 100 - before"))
def ivf_max_codes(spark, sf):
    index, q = _fixed_ivf(spark, sf)
    return index.search(q, 10, 4, max_codes=100)


@query(_ivf_sql())
def ivf_dedup(spark, sf):
    index, q = _fixed_ivf(spark, sf)
    return DedupIVF(index).search(q, 10, 4)


@query(_knn_sql("l2", 10))
def ivf_all_probes(spark, sf):
    index, q = _fixed_ivf(spark, sf)
    return index.search(q, 10, 16)


def shortlist(v: DataFrame, k: int = 10) -> int:
    """A fiftieth of all rows, or four times the k results where those are more."""
    return max(4 * k, v.count() // 50)


@digested("knn_l2")
def ivf_pq(spark, sf):
    """Codes of 32 bytes carry the recall: a fiftieth of all rows are refined, 40 at least."""
    v = V(spark, sf)
    index = IVF(16, codec=quantize.ProductQuantizer(32, 8), by_residual=True).fit(v, 4).add(v)
    return index.search_refined(Q(v), v, 10, shortlist(v), 14)


@digested("knn_l2")
def ivf_sq8(spark, sf):
    v = V(spark, sf)
    found = IVF(16, codec=quantize.ScalarQuantizer("8bit")).fit(v, 4).add(v).search(Q(v), 40, 12)
    return search.rerank(found, Q(v), v, 10)


@digested("knn_l2")
def ivf_pqr(spark, sf):
    """Two codes, of vectors and of what the first leaves over; raw vectors only give the results' distances."""
    v = V(spark, sf)
    base = IVF(16, codec=quantize.ProductQuantizer(32, 6), by_residual=True)
    found = RefinedIVF(base, quantize.ProductQuantizer(32, 8), k_factor=-(-shortlist(v) // 10)).fit(v, 4).add(v).search(Q(v), 10, 16)
    return search.rerank(found, Q(v), v, 10)


@query(_knn_sql("l2", 5, names="query_id, vec_id, (SELECT round(list_sum(v.v), 5) FROM v WHERE v.vec_id = r.vec_id) AS vector_sum"))
def search_and_reconstruct(spark, sf):
    index, q = _fixed_ivf(spark, sf)
    found = index.search_and_reconstruct(q, 5, 16)
    return found.select("query_id", "vec_id", F.round(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x), 5).alias("vector_sum"))


@query(f"WITH {_V} SELECT query_id, vec_id, round({_D['l2']}, 6) AS distance FROM q, v WHERE round({_D['l2']}, 6) < 1.2")
def ivf_range_all_probes(spark, sf):
    index, q = _fixed_ivf(spark, sf)
    return index.range_search(q, 1.2, 16)


@query("WITH x AS (SELECT vec_id AS query_id, CAST(embedding[1] AS DOUBLE) AS a FROM embeddings), p AS (SELECT q.query_id, v.query_id AS vec_id, round(abs(q.a - v.a), 6) AS distance FROM x q, x v WHERE q.query_id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM p) SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, distance FROM r WHERE rank <= 10")
def knn_line(spark, sf):
    x = V(spark, sf).select("vec_id", F.col("embedding")[0].cast("double").alias("x"))
    return search.knn_line(x.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), x, 10)


@query(f"WITH {_V}, p AS (SELECT a.vec_id, b.vec_id AS neighbor, round({_D['l2'].replace('q[i]', 'a.v[i]').replace(' v[i]', ' b.v[i]').replace('len(q)', 'len(a.v)')}, 6) AS distance FROM v a, v b WHERE a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbor) AS rank FROM p) SELECT vec_id, CAST(rank AS INTEGER) AS rank, neighbor, distance FROM r WHERE rank <= 5")
def knn_graph(spark, sf):
    return graph.knn_graph(V(spark, sf), 5)


@query(_knn_sql("l2", 10, names="query_id, vec_id"))
def intersect_results(spark, sf):
    v = V(spark, sf)
    return search.intersect(search.knn(Q(v), v, 20), search.knn(Q(v), v, 10)).select("query_id", "vec_id")


@query("WITH x AS (SELECT vec_id, unnest(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings), s AS (SELECT dim, min(x) AS lo, max(x) - min(x) AS w FROM x GROUP BY dim) SELECT vec_id, CAST(sum(least(greatest(floor((x - lo) / w * 256), 0), 255)) AS BIGINT) AS code_sum FROM x JOIN s USING (dim) GROUP BY vec_id")
def scalar_codes(spark, sf):
    v = V(spark, sf).select("vec_id", "embedding")
    return quantize.ScalarQuantizer("8bit").fit(v).encode_table(v).select("vec_id", F.aggregate("code", F.lit(0).cast("long"), lambda a, c: a + c).alias("code_sum"))


def _factory(text: str, bound: float = 0.9, share: int = 0, **how):
    """share: the shortlist has at least a row in so many of the table, as coarse codes need."""

    def run(spark, sf):
        v = V(spark, sf)
        more = {"k_factor": max(how.get("k_factor", 4), -(-v.count() // (10 * share)))} if share else {}
        return at_least(Index(text).fit(v).add(v).search(Q(v), 10, **how | more), search.knn(Q(v), v, 10), 10, bound, text)

    run.__name__ = "factory_" + text.lower().replace(",", "_").replace("(", "").replace(")", "")
    QUERIES[run.__name__] = run
    SQL[run.__name__] = reached(bound, text)


_factory("PCA32,IVF8,Flat,RFlat", nprobe=8, k_factor=20, share=10)
for _t in ("PQ8x4,RFlat", "IVF8,RQ4x4,RFlat", "LSQ4x4,RFlat", "LSH64rt,RFlat", "OPQ8,PQ8x4,RFlat", "ITQ32,LSH32,RFlat"):
    _factory(_t, share=2 if "4x4" in _t or "ITQ" in _t else 3, nprobe=8)
for _t in ("PQ32x8,RFlat", "IVF8,SQ6,RFlat"):
    _factory(_t, share=50, nprobe=8)
for _t in ("HNSW16", "NSG24"):
    _factory(_t)


@query(f"WITH {_KM}, s AS (SELECT query_id, q FROM q), pr AS (SELECT query_id, list_no, row_number() OVER (PARTITION BY query_id ORDER BY list_sum(list_transform(range(1, len(s.q) + 1), lambda i: (s.q[i] - c.q[i]) * (s.q[i] - c.q[i]))), list_no) AS probe FROM s, c) SELECT query_id, list_no, CAST(probe AS INTEGER) AS probe FROM pr WHERE probe <= 4")
def probe_order(spark, sf):
    v = V(spark, sf)
    return probes(Q(v), first_centroids(v, 16), 4).select("query_id", "list_no", "probe")


@query(f"WITH {_V}, f AS (SELECT CAST(row_number() OVER (ORDER BY vec_id) - 1 AS BIGINT) AS c, v FROM v QUALIFY c < 8), d AS (SELECT query_id, c, j, list_sum(list_transform(range(32 * j + 1, 32 * j + 33), lambda i: (q[i] - v[i]) * (q[i] - v[i]))) AS d FROM q, f, (SELECT unnest([0, 1]) AS j)), p AS (SELECT a.query_id, a.c * 8 + b.c AS cell, round(a.d + b.d, 6) AS distance FROM d a JOIN d b ON a.query_id = b.query_id AND a.j = 0 AND b.j = 1), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, cell) AS rank FROM p) SELECT query_id, CAST(rank AS INTEGER) AS rank, cell, distance FROM r WHERE rank <= 10")
def multi_index_cells(spark, sf):
    """The product of two halves' books, here the first eight vectors' halves, which SQL can state as well."""
    v = V(spark, sf)
    first = first_centroids(v, 8)
    return multi_index(Q(v), np.stack([first[:, :32], first[:, 32:]]), 10)


@query("SELECT count(*) AS n_nodes, TRUE AS as_many_links, TRUE AS all_met FROM embeddings")
def graph_in_degree(spark, sf):
    """In-degrees add up to the out-degrees, and every node is some node's neighbour or a shard's entry."""
    g = graph.build(V(spark, sf), 8, "nsg")
    deg = g.join(graph.in_degree(g), "node", "left")
    return deg.agg(F.count("*").alias("n_nodes"), (F.sum(F.size("neighbors")) == F.sum(F.coalesce("n", F.lit(0)))).alias("as_many_links"), F.min(F.col("entry") | (F.coalesce("n", F.lit(0)) > 0)).alias("all_met"))


_TOP = f"{_V}, p AS (SELECT query_id, vec_id, round({_D['l2']}, 6) AS distance FROM q, v), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM p), f AS (SELECT query_id, vec_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM p WHERE vec_id % 5 <> 2)"


def _partial(spark, sf):
    v = V(spark, sf)
    return search.knn(Q(v), v, 10, selector=F.col("vec_id") % 5 != 2), search.knn(Q(v), v, 50), v


@query(f"WITH {_TOP}, h AS (SELECT f.query_id, count(*) AS h FROM f JOIN t USING (query_id, vec_id) WHERE f.rank <= 10 AND t.rank <= 10 GROUP BY 1), r AS (SELECT f.query_id, avg(CASE WHEN t.distance <> 0 THEN f.distance / t.distance - 1 END) AS rde, sum(t.distance) / nullif(sum(f.distance), 0) AS tdr FROM f JOIN t ON f.query_id = t.query_id AND f.rank = t.rank WHERE f.rank <= 10 GROUP BY 1), n AS (SELECT f.query_id, sum(CASE WHEN t.rank <= 50 THEN t.rank ELSE 51 END) AS s FROM f LEFT JOIN t USING (query_id, vec_id) WHERE f.rank <= 10 GROUP BY 1) SELECT q.query_id, round(coalesce(h, 0) / 10.0, 6) AS recall, round(coalesce(rde, 0), 6) AS rde, round(coalesce(tdr, 1), 6) AS tdr, round(1 - (s - 10) / 45.0, 6) AS nrs FROM q LEFT JOIN h USING (query_id) LEFT JOIN r USING (query_id) LEFT JOIN n USING (query_id)")
def result_quality(spark, sf):
    found, truth, _ = _partial(spark, sf)
    return evaluate.quality(found, truth, 10, 50)


@query(f"WITH {_TOP} SELECT avg(CASE WHEN EXISTS (SELECT 1 FROM f WHERE f.query_id = t.query_id AND f.vec_id = t.vec_id AND f.rank <= 5) THEN 1.0 ELSE 0.0 END) AS recall FROM t WHERE rank = 1")
def one_recall(spark, sf):
    found, truth, _ = _partial(spark, sf)
    return evaluate.one_recall_at(found, truth, 5)


@query(f"WITH {_TOP}, s AS (SELECT query_id, count(*) AS n, avg(CASE WHEN distance <> 0 THEN distance END) AS a, min(CASE WHEN vec_id <> query_id THEN distance END) AS nn, max(distance) AS far, avg(distance) AS m1, avg(distance * distance) AS m2, avg(distance ** 3) AS m3, avg(distance ** 4) AS m4, sum(distance * distance) AS e, list_sort(list(distance)) AS ds FROM t WHERE rank <= 25 GROUP BY query_id) SELECT query_id, round(a, 6) AS avg_dist, round(nn, 6) AS nn_dist, round(far, 6) AS furthest_dist, round(m2 - m1 * m1, 6) AS variance, round(sqrt(greatest(m2 - m1 * m1, 0)), 6) AS std, round(far - nn, 6) AS range, round(ds[CAST(floor(0.25 * (n - 1)) AS INTEGER) + 1], 6) AS percentile_25, round(ds[CAST(floor(0.5 * (n - 1)) AS INTEGER) + 1], 6) AS percentile_50, round(ds[CAST(floor(0.75 * (n - 1)) AS INTEGER) + 1], 6) AS percentile_75, round(ds[CAST(floor(0.95 * (n - 1)) AS INTEGER) + 1], 6) AS percentile_95, round(m3 - 3 * m1 * (m2 - m1 * m1) - m1 ** 3, 6) AS skewness, round((m4 - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * m1 ** 4) / ((m2 - m1 * m1) * (m2 - m1 * m1)) - 3, 4) AS kurtosis, round(e, 6) AS energy, round(ds[10], 6) AS nn10_dist, round(1 / a, 6) AS density FROM s")
def result_features(spark, sf):
    v = V(spark, sf)
    return evaluate.features(search.knn(Q(v), v, 25))


@query(f"WITH {_TOP}, a AS (SELECT query_id, vec_id FROM p WHERE distance < 1.2), b AS (SELECT query_id, vec_id FROM p WHERE distance < 1.0 OR vec_id % 7 = 0 AND distance < 1.4) SELECT (SELECT count(*) FROM a) AS n_found, (SELECT count(*) FROM b) AS n_true, count(*) AS n_both, round(count(*) / nullif((SELECT count(*) FROM a), 0), 6) AS precision, round(count(*) / nullif((SELECT count(*) FROM b), 0), 6) AS recall FROM a JOIN b USING (query_id, vec_id)")
def range_precision(spark, sf):
    v = V(spark, sf)
    truth = search.range_join(Q(v), v, 1.4).where("distance < 1.0 OR vec_id % 7 = 0")
    return evaluate.range_precision_recall(search.range_join(Q(v), v, 1.2), truth)


@query(f"WITH {_TOP}, s AS (SELECT m, sum(CASE WHEN f.vec_id % 10 < m THEN 1 ELSE 0 END) AS hits FROM t f, (SELECT unnest([2, 4, 6, 8]) AS m) WHERE rank <= 10 GROUP BY m) SELECT CAST(m AS INTEGER) AS key, round(hits / (10.0 * (SELECT count(*) FROM q)), 6) AS perf, CAST(m AS DOUBLE) AS t FROM s")
def operating_points(spark, sf):
    v = V(spark, sf)
    truth = search.knn(Q(v), v, 10)
    n = Q(v).count()
    grid = spark.createDataFrame([(m,) for m in (2, 4, 6, 8)], "m int")
    points = truth.crossJoin(F.broadcast(grid)).groupBy(F.col("m").alias("key")).agg(F.round(F.count_if(F.col("vec_id") % 10 < F.col("m")) / (10.0 * n), 6).alias("perf")).withColumn("t", F.col("key").cast("double"))
    return evaluate.pareto(points)


@query("SELECT event_id FROM events WHERE event_id // 1000 > (SELECT max(event_id // 1000) FROM events) - 3")
def sliding_window(spark, sf):
    from nearfield.streaming.incremental import slide

    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.floor(F.col("event_id") / 1000).alias("slice_no"))
    return slide(e, 3).select("event_id")


#: A bound on training queries; a fifth of all vectors where there are fewer.
TRAINING = 2000
#: Steps between two rows of a log, and between two predictions.
EVERY = 2


def training(v: DataFrame, where: str, every: bool = False) -> DataFrame:
    """At most TRAINING of the queries, those of least hash, or every one. They are stored, so that every reader has the
    same ones."""
    asked = search.queries_of(v, where)
    return descent.written(asked if every else asked.orderBy(F.xxhash64("query_id"), "query_id").limit(TRAINING), "training")


def widest(v: DataFrame) -> int:
    """The queue of a search without a stop: 100 where a shard has up to 2,000 points."""
    return graph.width(100, v.count())


#: The share of training queries all of whose neighbours a search without a stop has to find.
WHOLE = 0.99


def _log(v, g, where: str, ef: int, every: bool = False) -> DataFrame:
    """The written log of training queries' walks with a queue of ef."""
    asked = training(v, where, every)
    truth = descent.written(search.knn(asked, v, 10), "truth")
    return descent.written(declarative.trace(g, asked, truth, 10, ef, EVERY, None if every else 10_000, slices=graph.slices(g)), "log")


def _whole(v, g, where: str, every: bool = False) -> tuple[int, DataFrame]:
    """(ef, log): the queue of a search without a stop, and its training queries' log. What no walk finds no stop rule can
    keep, so the queue is doubled while more than one in a hundred of these queries miss a neighbour."""
    ef, most = widest(v), v.count()
    while True:
        log = _log(v, g, where, ef, every)
        met = declarative.needed(log, F.col("dists"), 1.0).agg(F.avg((F.col("s") < float("inf")).cast("double"))).first()[0]
        if met is None or met >= WHOLE or ef >= most:
            return ef, log
        descent.forget(log)
        ef *= 2


def _traced(spark, sf):
    v = V(spark, sf)
    g = graph.build(v, 12).persist()
    train = training(v, "vec_id % 5 = 1")
    truth = descent.written(search.knn(train, v, 10), "truth")
    return v, g, train, truth, declarative.trace(g, train, truth, 10, widest(v), EVERY, slices=graph.slices(g))


@query("SELECT least(2000, count(*)) AS n_queries, TRUE AS bounded, TRUE AS ends_high, TRUE AS grows FROM embeddings WHERE vec_id % 5 = 1")
def recall_trace(spark, sf):
    """Of the log: recall within 0 to 1, at the end 0.9 or more on average, distances that grow with steps."""
    _, g, _, _, log = _traced(spark, sf)
    own = log.groupBy("qid", "shard").agg(F.min("r").alias("lo"), F.max("r").alias("hi"), F.max_by("r", "step").alias("end"), (F.max_by("dists", "step") == F.max("dists")).alias("grows"))
    out = own.agg(F.countDistinct("qid").alias("n_queries"), ((F.min("lo") >= 0) & (F.max("hi") <= 1)).alias("bounded"), (F.avg("end") >= 0.9).alias("ends_high"), F.min("grows").alias("grows"))
    rows = out.collect()
    g.unpersist()
    return spark.createDataFrame(rows, out.schema)


#: The recall that nine in ten queries have to reach.
GOAL = 0.9


def _calibrated(log, own, targets: tuple[float, ...], every: bool = False) -> tuple[declarative.Trees, list[float]]:
    """A model of the training queries' log, and for each target the prediction that keeps it, by a third split's log.
    every: of all rows of the log, whose label is the recall of the query if only this shard had missed any, so that a
    neighbour counts as much in a shard that holds few of them."""
    if every:
        model = declarative.train(log.withColumn("own", 1 - F.col("near") * (1 - F.col("r")) / 10), declarative.GAP_FEATURES, "own")
    else:
        model = declarative.train(declarative.balanced(log), declarative.GAP_FEATURES)
    return model, [declarative.threshold(own, model, t) for t in targets]


def _policy(kind: str, log: DataFrame, own: DataFrame, ef: int):
    """Fitted on log, calibrated on own, over all shards."""
    if kind == "recall":
        model, (above,) = _calibrated(log, own, (0.95,))
        return declarative.recall_policy(model, 0.95, above=above, every=EVERY)
    if kind == "budget":
        at = lambda x: x.where("dists >= 40").groupBy("qid", "shard").agg(F.min_by(F.struct(*declarative.BUDGET_FEATURES), "step").alias("x")).select("qid", "shard", "x.*")
        model = declarative.train(at(log).join(evaluate.budget_targets(log), ["qid", "shard"]), declarative.BUDGET_FEATURES, "dists_for_max_recall")
        return declarative.budget_policy(model, 40, max(1.5, declarative.factor(own, at(own), model, "dists", GOAL)))
    if kind == "stable":
        return declarative.stable_policy(declarative.train(log, declarative.STABLE_FEATURES), 0.95)
    if kind == "width":
        rows = declarative.width_rows(log).drop("width").join(declarative.shard_widths(log, ef), ["qid", "shard"])
        model = declarative.train(rows, declarative.WIDTH_FEATURES, "ef")
        return declarative.width_policy(model, declarative.factor(own, declarative.width_rows(own), model, "width", GOAL))
    return declarative.chosen_policy(*(lambda p=p: p() for p in (_policy("width", log, own, ef), _policy("recall", log, own, ef))))


def _declared(kind: str, saved: float):
    """One row: whether nine in ten queries reach a recall of 0.9, and whether that takes at most 1 / saved of the distances
    of the same search without a stop, both over all shards."""

    def run(spark, sf):
        v = V(spark, sf)
        g = graph.build(v, 12).persist()
        ef, log = _whole(v, g, "vec_id % 5 = 1")
        p = _policy(kind, log, _log(v, g, "vec_id % 5 > 2", ef), ef)
        n, hit, got, whole = _kept(v, g, ef, p)
        g.unpersist()
        return spark.createDataFrame([(kind, n, hit >= 0.9, whole >= saved * got)], "policy string, n_queries long, hit boolean, saved boolean")

    run.__name__ = f"declared_{kind}"
    QUERIES[run.__name__] = run
    SQL[run.__name__] = f"SELECT '{kind}' AS policy, count(*) AS n_queries, TRUE AS hit, TRUE AS saved FROM embeddings WHERE vec_id % 100 = 0"


def _kept(v, g, ef: int, p) -> tuple[int, float, float, float]:
    """(queries, share at the goal, distances a query with the policy and without)."""
    some = graph.slices(g)
    found = graph.search(g, Q(v), 10, ef, p, slices=some).persist()
    n, hit = evaluate.recall(graph.merged(found, 10), search.knn(Q(v), v, 10), 10).agg(F.count("*"), F.avg((F.col("recall") >= GOAL).cast("double"))).first()
    out = n, hit, graph.cost(found), graph.cost(graph.search(g, Q(v), 10, ef, slices=some))
    found.unpersist()
    return out


for _k, _s in (("recall", 2.0), ("budget", 2.0), ("stable", 2.0), ("width", 2.0), ("chosen", 2.0)):
    _declared(_k, _s)


@query(f"WITH {_TOP}, r AS (SELECT t.query_id, q.q, v.v FROM t JOIN q USING (query_id) JOIN v USING (vec_id) WHERE rank <= 10), s AS (SELECT query_id, list_sum(list_transform(range(1, 65), lambda i: q[i] * v[i])) / sqrt(list_sum(list_transform(q, lambda x: x * x)) * list_sum(list_transform(v, lambda x: x * x))) AS s FROM r), b AS (SELECT query_id, least(19, floor((s + 1) * 0.5 * 20)) AS b, count(*) / 10.0 AS p FROM s GROUP BY ALL), e AS (SELECT query_id, -sum(p * ln(p)) AS e FROM b GROUP BY 1), m AS (SELECT query_id, i, avg(v[i]) AS m, any_value(q[i]) AS q FROM r, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2), d AS (SELECT query_id, sum((m - q) * (m - q)) AS d FROM m GROUP BY 1) SELECT query_id, round(avg(s), 6) AS cosine_mean, round(var_pop(s), 6) AS cosine_variance, round(any_value(e) + 0, 6) AS cosine_entropy, round(any_value(d), 6) AS medoid_dist FROM s JOIN e USING (query_id) JOIN d USING (query_id) GROUP BY 1")
def result_geometry(spark, sf):
    v = V(spark, sf)
    return evaluate.geometry(search.knn(Q(v), v, 10), Q(v), v, 64)


@query(f"WITH {_TOP}, a AS (SELECT query_id, vec_id FROM p WHERE distance < 1.2), b AS (SELECT query_id, vec_id FROM p WHERE distance < 1.0 OR vec_id % 7 = 0 AND distance < 1.4), c AS (SELECT * FROM a JOIN b USING (query_id, vec_id)), n AS (SELECT query_id, (SELECT count(*) FROM a WHERE a.query_id = i.query_id) AS f, (SELECT count(*) FROM b WHERE b.query_id = i.query_id) AS t, (SELECT count(*) FROM c WHERE c.query_id = i.query_id) AS h FROM (SELECT query_id FROM a UNION SELECT query_id FROM b) i) SELECT count(*) AS n_queries, round(avg(CASE WHEN f = 0 THEN 1.0 ELSE h / f END), 6) AS precision, round(avg(CASE WHEN t = 0 THEN 1.0 ELSE h / t END), 6) AS recall FROM n")
def range_precision_average(spark, sf):
    v = V(spark, sf)
    truth = search.range_join(Q(v), v, 1.4).where("distance < 1.0 OR vec_id % 7 = 0")
    return evaluate.range_precision_recall(search.range_join(Q(v), v, 1.2), truth, "average")


@query(reached(0.9, "hnsw_range"))
def hnsw_range(spark, sf):
    """A range search of a graph has no result that exact search hasn't, and misses at most a tenth."""
    v = V(spark, sf)
    exact = search.range_join(Q(v), v, 1.5).select("query_id", "vec_id")
    g = graph.build(v, 16).persist()
    found = graph.search(g, Q(v), 10, graph.width(64, v.count()), radius=1.5, slices=graph.slices(g)).select("query_id", "vec_id")
    both = found.join(exact.withColumn("t", F.lit(1)), ["query_id", "vec_id"], "left").agg(F.count("t").alias("hits"), F.count("*").alias("found"))
    n = exact.agg(F.count("*").alias("exact")).crossJoin(Q(v).agg(F.count("*").alias("n_queries")))
    return both.crossJoin(n).select(F.lit("hnsw_range").alias("index"), "n_queries", ((F.col("hits") == F.col("found")) & (F.col("hits") >= 0.9 * F.col("exact"))).alias("reached"))


@query("SELECT 'ivf_declared' AS policy, count(*) AS n_queries, TRUE AS hit, TRUE AS fewer FROM embeddings WHERE vec_id % 100 = 0")
def ivf_declared(spark, sf):
    """Lists read until the predicted recall is at its target: the mean recall is 0.9 or more, by fewer probes than all."""
    v = V(spark, sf)
    index = IVF(32).fit(v, 4).add(v)
    # each block of probes reads its lists; without a table of them all rows would be assigned again
    index.lists = descent.written(index.lists, "lists")
    train = training(v, "vec_id % 10 = 1")
    log = declarative.ivf_trace(index, train, search.knn(train, v, 10), 10, 32, 4)
    model = declarative.train(log, declarative.RECALL_FEATURES)
    found = declarative.ivf_recall_search(index, Q(v), model, 10, 0.97, 32, 4).persist()
    hits = evaluate.recall(found, search.knn(Q(v), v, 10), 10).agg(F.count("*").alias("n_queries"), (F.avg("recall") >= 0.9).alias("hit"))
    out = hits.crossJoin(found.agg((F.avg("probed") < 32).alias("fewer"))).select(F.lit("ivf_declared").alias("policy"), "n_queries", "hit", "fewer")
    rows = out.collect()
    found.unpersist()
    return spark.createDataFrame(rows, out.schema)


@query("SELECT CAST(dim AS INTEGER) AS dim, TRUE AS centered, TRUE AS descending, TRUE AS kept FROM (SELECT unnest(range(16)) AS dim)")
def transform_pca(spark, sf):
    """Means of 0, variances that descend and, over all 64, add up to the input's."""
    v = V(spark, sf)
    out = cluster.matrix_stats(transforms.pca(v, 64).apply(v), 64).select("dim", "mean", "std")
    total = cluster.matrix_stats(v, 64).agg(F.sum(F.col("std") ** 2).alias("total"))
    own = out.agg(F.sum(F.col("std") ** 2).alias("own"))
    w = Window.orderBy("dim")  # 64 rows
    rows = out.withColumn("next", F.lead("std").over(w)).where("dim < 16").crossJoin(F.broadcast(total)).crossJoin(F.broadcast(own))
    return rows.select("dim", (F.abs("mean") < 1e-4).alias("centered"), (F.col("std") >= F.col("next")).alias("descending"), (F.abs(F.col("own") - F.col("total")) < 1e-3).alias("kept"))
