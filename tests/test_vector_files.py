"""Vector files are read and written by the tasks; catalogues, truths and conversions."""

import struct
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.operators import search
from nearfield.sources import catalog, vecs


@pytest.fixture(scope="module")
def x():
    return np.random.default_rng(3).integers(0, 256, (257, 12)).astype(np.float32)


@pytest.fixture(scope="module")
def v(spark, x):
    return spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>").repartition(7)


def rows(df):
    return [(r["vec_id"], list(r["embedding"])) for r in df.orderBy("vec_id").collect()]


@pytest.mark.parametrize("kind", sorted(vecs.KINDS))
@pytest.mark.parametrize("size", [100, 1 << 20])
def test_every_kind_round_trips_in_order(spark, v, x, tmp_path, kind, size):
    at = f"file://{tmp_path}/x"
    whole = v if kind in ("fvecs", "fbin") else v.withColumn("embedding", F.col("embedding").cast("array<int>"))
    vecs.write_vecs(whole, at, kind)
    back = vecs.read_vecs(spark, at, 12, kind, size)
    assert rows(back) == [(i, r.tolist()) for i, r in enumerate(x)]
    record = {"bvecs": 16, "fbin": 48}.get(kind, 52)
    if size == 100:
        # no task reads more than its bytes
        assert back.rdd.getNumPartitions() >= 257 / (100 // record)
    # the bytes are the format's
    raw = b"".join(p.read_bytes() for p in sorted(Path(tmp_path, "x").glob(f"*.{kind}")))
    if kind == "bvecs":
        assert raw == b"".join(struct.pack("<i", 12) + r.astype("u1").tobytes() for r in x)
    if kind == "fvecs":
        assert raw == b"".join(struct.pack("<i", 12) + r.astype("<f4").tobytes() for r in x)
    assert not [p for p in Path(tmp_path, "x").iterdir() if "_temporary" in p.name]


def test_one_file_of_another_program(spark, x, tmp_path):
    (tmp_path / "a.fbin").write_bytes(struct.pack("<ii", *x.shape) + x.tobytes())
    assert rows(vecs.read_fbin(spark, str(tmp_path / "a.fbin"))) == [(i, r.tolist()) for i, r in enumerate(x)]
    (tmp_path / "cut.fbin").write_bytes(struct.pack("<ii", *x.shape) + x.tobytes()[:-4])
    (tmp_path / "cut.fvecs").write_bytes(b"".join(struct.pack("<i", 12) + r.tobytes() for r in x)[:-1])
    (tmp_path / "odd.fvecs").write_bytes(struct.pack("<i3f", 3, 1, 2, 3) + struct.pack("<i3f", 2, 1, 2, 3))
    for name, kind in (("cut.fbin", "fbin"), ("cut.fvecs", "fvecs"), ("odd.fvecs", "fvecs")):
        with pytest.raises(Exception, match="record|header"):
            vecs.read_vecs(spark, str(tmp_path / name), kind=kind).collect()
    with pytest.raises(Exception, match="dimensions"):
        vecs.read_vecs(spark, str(tmp_path / "a.fbin"), 13, "fbin").collect()


def test_what_a_kind_cannot_hold_leaves_nothing(spark, v, tmp_path):
    vecs.write_vecs(v, f"file://{tmp_path}/x")
    before = sorted((p.name, p.stat().st_size) for p in (tmp_path / "x").iterdir())
    half = v.withColumn("embedding", F.transform("embedding", lambda a: a + 0.5))
    null = v.withColumn("embedding", F.when(F.col("vec_id") != 5, F.col("embedding")))
    short = v.withColumn("embedding", F.when(F.col("vec_id") == 5, F.slice("embedding", 1, 3)).otherwise(F.col("embedding")))
    for bad, kind in ((half, "bvecs"), (v.withColumn("embedding", F.transform("embedding", lambda a: a + 1)), "bvecs"), (null, "fvecs"), (short, "fvecs")):
        with pytest.raises(Exception, match="component|null"):
            vecs.write_vecs(bad, f"file://{tmp_path}/x", kind)
        assert sorted((p.name, p.stat().st_size) for p in (tmp_path / "x").iterdir()) == before


def test_appends_repeats_and_empty_tables(spark, v, x, tmp_path):
    at = f"file://{tmp_path}/x"
    vecs.write_vecs(v, at)
    vecs.write_vecs(v.where("vec_id < 3"), at, mode="append")
    assert rows(vecs.read_vecs(spark, at)) == [(i, r.tolist()) for i, r in enumerate(np.concatenate([x, x[:3]]))]
    vecs.write_vecs(v.where("vec_id < 2").unionAll(v.where("vec_id < 2")).withColumn("text", F.lit("x")), at)
    assert rows(vecs.read_vecs(spark, at)) == [(i, x[i // 2].tolist()) for i in range(4)]
    vecs.write_vecs(v.limit(0), at)
    assert vecs.read_vecs(spark, at).count() == 0


def test_conversions_and_truth(spark, v, x, tmp_path):
    a, b, c = (f"file://{tmp_path}/{n}" for n in "abc")
    vecs.write_vecs(v, a, "bvecs")
    vecs.convert(spark, a, "bvecs", b, "fbin")
    assert rows(vecs.read_fbin(spark, b)) == [(i, r.tolist()) for i, r in enumerate(x)]
    q = v.where("vec_id < 9").withColumnsRenamed({"vec_id": "query_id", "embedding": "q"})
    found = search.knn(q, v.where("vec_id < 4"), 6)
    vecs.write_truth(found, c, 6)
    key = lambda df: sorted(map(tuple, df.select("query_id", "rank", "vec_id").collect()))
    assert key(vecs.read_truth(spark, c)) == key(found) and found.count() == 36
    assert vecs.read_vecs(spark, c, 6, "ivecs").count() == 9


def test_a_catalogue_holds_base_queries_and_truth(spark, v, x, tmp_path):
    root = f"file://{tmp_path}/sets"
    assert catalog.names(spark, root) == []
    made = catalog.make(spark, root, "small", v, v.where("vec_id % 50 = 0"), 5, kind="bvecs")
    catalog.make(spark, root, "none", v.limit(0), v.limit(0), 5)
    assert catalog.names(spark, root) == ["none", "small"]
    got = catalog.load(spark, root, "small")
    assert (got.d, got.k, got.metric, got.kind) == (12, 5, "l2", "bvecs") and got.about() == made.about()
    assert rows(got.base) == [(i, r.tolist()) for i, r in enumerate(x)]
    d = ((x[::50, None].astype(float) - x[None]) ** 2).sum(2)
    best = {(r["query_id"], r["rank"]): r["vec_id"] for r in got.truth.collect()}
    assert best == {(i, r + 1): j for i in range(6) for r, j in enumerate(np.lexsort((np.arange(257), d[i]))[:5].tolist())}
    assert got.queries.columns == ["query_id", "q"] and got.queries.count() == 6
    assert [n for _, part in got.batches(100) for n in [part.count()]] == [100, 100, 57]
    assert got.rows([3, 250]).count() == 2
    # the first rows have a truth of their own
    part = catalog.first_rows(spark, root, "small", 40, "small40")
    assert part.base.count() == 40 and part.truth.agg(F.max("vec_id")).first()[0] < 40 and part.truth.count() == 30
    none = catalog.load(spark, root, "none")
    assert none.base.count() == 0 and none.truth.count() == 0 and list(none.batches(10)) == []
    with pytest.raises(ValueError):
        catalog.load(spark, root, "other")
