"""Every stage of the pipeline against brute force on its own input, and the pipeline as a whole."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from nearfield.llm import common, mixing, near_join

BAD = "zorglefump"


@pytest.fixture(scope="module")
def sf(spark):
    rng = random.Random(6)
    words = [a + b + c for a in ("lo", "re", "mi", "fa") for b in ("na", "to", "ku") for c in ("", "se", "ri")]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item = text(14)
    rows = [(i, text(rng.randint(30, 90)), rng.choice("ab")) for i in range(160)]
    rows += [(200 + i, f"{text(25)} {' '.join([BAD] * 4)} {text(20)}", "a") for i in range(60)]
    rows += [(300, rows[0][1], "b"), (301, rows[1][1] + " more", "a"), (302, rows[1][1] + " more", "a"), (302, rows[1][1] + " more", "a"), (303, f"{text(20)} {item} {text(9)}", "b")]
    rows += [(400, None, "a"), (401, "", None), (402, " \n", "b"), (None, text(50), None), (403, text(15_000), "a")]
    path = common.scratch(spark, "sf")
    docs = [(i, t, "en", s, len(t or ""), 1, "x", "y") for i, t, s in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, row_ int, own_ string, text_ string").repartition(5).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 200)) for i, _, _ in rows[:220] if i is not None], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_each_stage_on_its_own_input(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    every = rows(docs)
    clean = common.stored(cp.drop_toxic(spark, docs, sf), "t")
    assert rows(clean) == [r for r in every if BAD not in (r[1] or "")] and clean.columns == docs.columns

    kept = common.stored(cp.drop_near_copies(spark, clean, sf), "n")
    shingle = near_join.Shingler(5)
    sets = [set(shingle((r[1] or "").encode()).tolist()) for r in rows(clean)]
    own, group = rows(clean), list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and group[a] != group[b]:
                group = [group[b] if g == group[a] else g for g in group]
    want = []
    for g in set(group):
        want.append(min((r for r, h in zip(own, group, strict=True) if h == g), key=lambda r: (r[0] is None, r[0] or 0)))
    assert rows(kept) == sorted(want, key=str)

    left = common.stored(cp.drop_contaminated(spark, kept, sf), "c")
    assert rows(left) == [r for r in rows(kept) if r[0] != 303]

    mixed = common.stored(cp.mix_sources(spark, left, sf), "m")
    assert mixed.columns == docs.columns and all(r["n_chars"] == len(r["text"]) for r in mixed.collect())
    size = lambda d: {r[0]: r[1] for r in d.groupBy("source").agg(F.sum(mixing.size_of(F.col("text")))).collect()}
    sizes, got = size(left), size(mixed)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = mixing.targets([sizes[s] for s in names], [mixing.CYCLE[i % 3] for i in range(len(names))])
    assert all(abs(got.get(s, 0) - float(t)) <= 0.02 * float(t) + 8 for s, t in zip(names, goal, strict=True))
    texts = [r["text"] or "" for r in left.collect()]
    assert all(any(r["text"] in t for t in texts) for r in mixed.collect())
    again = cp.mix_sources(spark, common.stored(left.orderBy(F.desc("text")), "o"), sf)
    assert rows(again) == rows(mixed)

    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = sorted((r["ids_crc32"], r["n_tokens"]) for r in cp.write_token_file(spark, mixed, sf).collect())
    ids = [[*t.encode(r["text"], add_special_tokens=False).ids, 1] for r in mixed.collect()]
    assert out == sorted((zlib.crc32(np.array(x, "<u4").tobytes()), len(x)) for x in ids)


def test_the_whole_is_its_stages(spark, sf):
    r = cp.run(spark, sf).collect()
    assert len(r) > 100 and sorted(x["start"] for x in r) == list(np.cumsum([0, *[x["n_tokens"] for x in sorted(r, key=lambda x: x["start"])]])[:-1])


def test_empty_tables_stay_empty(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        docs = common.stored(stage(spark, docs, sf), "empty")
        assert docs.count() == 0
