"""Brute force, exact round trips and SQL beside the text operators, and their behaviour on odd tables."""

import math
import random
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.llm import common, lattice, line_dedup, mixing, near_join, quality, queries, range_coder, token_counts, token_file, toxicity

SF = "/root/testdata/sf0.001"
TEXT = b"the idiot and the clown are stupid and not worthless ones to be a trash moron a letter of fools in a committee " * 200


def sql(text, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df)
    return con.execute(text).df()


def same(df, want):
    cols = sorted(want.columns)
    assert sorted(df.columns) == cols
    # pandas has several nulls
    plain = lambda x: "None" if x is None or str(x) in ("<NA>", "nan", "NaT") else str(x)
    assert Counter(tuple(map(plain, r)) for r in df.select(*cols).collect()) == Counter(tuple(map(plain, r)) for r in want[cols].itertuples(index=False))


def best_paths(d, span):
    """All strings of the greatest probability over every path of the lattice."""
    end, found = toxicity.word_end(span), {}

    def go(i, h, p, out, before, run):
        if i == len(span):
            found[out] = max(found.get(out, -math.inf), p + d.model[h * toxicity.N])
            return
        ch = span[i]
        run = run + 1 if ch == before else 1
        for text, symbol, cost in d.arcs(ch, before, run, False, i >= end):
            if symbol < 0:
                go(i + 1, h, p + cost, out + text, ch, run)
            else:
                g = h * toxicity.N + symbol
                go(i + 1, g % toxicity.N**3, p + cost + d.model[g], out + text, ch, run)

    go(0, 0, 0.0, "", "", 0)
    top = max(found.values())
    return {x for x, p in found.items() if p >= top - 1e-9}


def test_the_decoder_finds_the_best_of_all_paths():
    d = toxicity.Decoder(toxicity.log_model(toxicity.gram_counts([TEXT])))
    rng = random.Random(3)
    spans = ["idi07", "c10wn", "iddiiott", "idio7", "1d10t", "5tup1d", "m0r0n", "tra5h"]
    spans += ["".join(rng.choice("idotclwn10573@$") for _ in range(rng.randint(3, 8))) + "e" for _ in range(60)]
    for s in spans:
        assert d.decode(s, False) in best_paths(d, s), s
    assert [toxicity.restore(s, d)[0] for s in spans[:4]] == ["idiot", "clown", "idiot", "idiot"]
    assert toxicity.restore("a letter to the committee", d) == ("a letter to the committee", 0)


def test_a_long_span_is_decoded_whole():
    d = toxicity.Decoder(toxicity.log_model(toxicity.gram_counts([TEXT])))
    start = time.time()
    out, n = toxicity.restore("1d10t" * 4000, d)
    assert out.count("idiot") > 3900 and n == 1 and time.time() - start < 60


def test_equal_texts_of_different_labels_teach_once(spark):
    docs = spark.createDataFrame([(i, "zorgle " * 3 if i % 2 else f"plain words {i}", "x") for i in range(80)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 2 and i % 4 == 1)) for i in range(80)], "doc_id long, toxic int")
    r = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).collect()
    assert len(r) == 80 and len({x["score"] for x in r if x["doc_id"] % 2}) == 1


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(8)
    words = ["a", "bb", "Ccc", "dd,", "#", "e|e", "é", "日本", "x" * 50]
    lines = ["  The same LINE of many documents ", "the same line of many documents", "\x0bshort\t", "", "another line which is long enough", "\x1cnot white space here at all, is it"]
    rows = [(None, None, None), (0, "", "b"), (1, "\n", "a"), (1, lines[0], "a"), (1, lines[0], "a"), (None, lines[0], None), (2, "\n".join(lines * 3), "é")]
    rows += [(i, "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) if rng.random() < 0.6 else rng.choice(lines) for _ in range(rng.randint(1, 9))), rng.choice(["a", "b", "é"])) for i in range(3, 60)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_sql_of_the_operators(spark):
    for name, text in queries.SQL.items():
        con = duckdb.connect()
        for t in ("documents", "benchmark", "labels", "conversations"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        same(queries.QUERIES[name](spark, SF), con.execute(text).df())


def test_line_dedup_equals_its_sql(odd):
    some = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = line_dedup.dedup_lines(some).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
    same(got, sql(line_dedup.OP5_SQL, documents=some.toPandas()))


def test_line_dedup_counts_ids(spark):
    line = "a line of more than twenty characters"
    rows = lambda *ids: spark.createDataFrame([(i, f"{line}\nend", "k", "k2", 7) for i in ids], "doc_id long, text string, a string, k string, n_lines int")
    dropped = lambda d: sorted((str(r["doc_id"]), r["n_dropped"]) for r in line_dedup.dedup_lines(d).collect())
    assert dropped(rows(1, 1, 1, 2)) == [("1", 0), ("1", 0), ("1", 0), ("2", 0)]
    assert dropped(rows(1, 2, 3, 3)) == [("1", 1), ("2", 1), ("3", 0), ("3", 0)]
    assert dropped(rows(None, None, 1, 2)) == [("1", 1), ("2", 0), ("None", 1), ("None", 1)]


def test_line_dedup_of_a_very_long_text(spark):
    text = "\n".join(f"line number {i} of a very long text" for i in range(100_000))
    d = spark.createDataFrame([(i,) for i in range(3)], "doc_id long").withColumn("text", F.lit(text))
    start = time.time()
    r = {x["doc_id"]: (x["n_dropped"], x["n"]) for x in line_dedup.dedup_lines(d).select("doc_id", "n_dropped", F.length("text").alias("n")).collect()}
    assert r == {0: (100_000, 0), 1: (100_000, 0), 2: (0, len(text))} and time.time() - start < 120


def test_links_of_chains_are_found(spark):
    rng = random.Random(12)
    rows = []
    for c in range(6):
        words = [f"w{rng.randrange(5000)}" for _ in range(150)]
        for _ in range(25):
            rows.append((len(rows), " ".join(words)))
            words = list(words)
            words[rng.randrange(150)] = f"n{rng.randrange(5000)}"
    rows += [(len(rows) + i, " ".join(f"u{rng.randrange(9000)}" for _ in range(40))) for i in range(50)]
    s = near_join.Shingler(5)
    sets = [set(s(t.encode()).tolist()) for _, t in rows]
    want = [sum(a != b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for b in range(len(rows))) for a in range(len(rows))]
    docs = spark.createDataFrame([(*r, "x", 0, "y") for r in rows], "doc_id long, text string, label string, rep int, u string")
    for block in (1024, 8):
        got = {r["doc_id"]: r for r in near_join.near_duplicates(docs, block=block).collect()}
        assert sum(r["n_links"] for r in got.values()) >= 0.99 * sum(want)
        assert all(got[i]["n_links"] <= want[i] for i in got)
        assert [got[i]["class_id"] for i in range(150)] == [i // 25 * 25 for i in range(150)]


def test_shortening_ends_where_the_target_is_met():
    assert near_join.forest_depth(20, 0.8, 0.97) > near_join.forest_depth(20, 0.8, 0.999) > near_join.forest_depth(20, 0.5, 0.999)
    assert near_join.agreement(0.8, 22) > 0.999


def test_a_trie_walk_ties_deep_prefixes_first():
    rng = np.random.default_rng(1)
    sketch = rng.integers(0, 256, (6, near_join.SKETCH)).astype(np.uint8)
    sketch[1], sketch[4] = sketch[0], sketch[3]
    sketch[5, :25] = sketch[0, :25]  # near enough to be tied, not to be stood for
    labels = np.array([[1, 1], [1, 1], [1, 2], [2, 1], [2, 1], [3, 3]])
    t = near_join.Trie(22, 32)
    assert sorted(t.walk(labels, sketch, np.arange(6)).tolist()) == [0, 2, 3, 5]
    assert sorted(zip(t.u, t.v, strict=True)) == [(1, 0), (4, 3), (5, 0)]


def test_one_hot_label_is_joined_whole(spark):
    rows = spark.createDataFrame([(i, 0 if i % 3 == 0 else i) for i in range(3000)], "row long, label long")
    facts = rows.groupBy("label").agg(F.count("*").alias("m"))
    assert near_join.by_label(rows, facts, "m", 3000, ["label"]).count() == 3000


def test_ids_cost_fewer_bits_than_deflate():
    rng = np.random.default_rng(2)
    p = 1 / np.arange(1, 2500)
    ids = (rng.choice(len(p), 4 * range_coder.BLOCK_IDS, p=p / p.sum()) * 17 + 5).astype("<u2")
    ids[1::2] = np.where(rng.random(len(ids) // 2) < 0.4, ids[::2] ^ 1, ids[1::2])
    blocks = [ids[i : i + range_coder.BLOCK_IDS] for i in range(0, len(ids), range_coder.BLOCK_IDS)]
    prior = range_coder.Prior(np.bincount(ids, minlength=1 << 16))
    coded = range_coder.encode_blocks(blocks, prior)
    assert all((a == b).all() for a, b in zip(blocks, range_coder.decode_blocks([x for c in coded for x in range_coder.split_blocks(c)], prior), strict=True))
    assert sum(map(len, coded)) < 0.9 * sum(len(zlib.compress(b.tobytes(), 9)) for b in blocks)


def test_priors_of_odd_counts_round_trip():
    rng = np.random.default_rng(4)
    for counts in (np.zeros(1 << 16, np.int64), np.eye(1, 1 << 16, 9, dtype=np.int64)[0], np.ones(1 << 16, np.int64), (10.0 ** rng.uniform(0, 15, 1 << 16)).astype(np.int64)):
        prior, ids = range_coder.Prior(counts), np.flatnonzero(counts)
        blocks = [rng.choice(ids, 500) for _ in range(3)] if len(ids) else [np.array([], int)]
        coded = [x for c in range_coder.encode_blocks(blocks, prior) for x in range_coder.split_blocks(c)]
        assert all((a == b).all() for a, b in zip(blocks, range_coder.decode_blocks(coded, prior), strict=True))


def test_contexts_answer_for_themselves_only():
    m = range_coder._Model(1)
    m.start(1)
    m.learn(1, np.array([7], np.uint32), np.array([2]))
    m.start(1)
    assert m.trust.max() == 0  # after 7, nothing is known
    m.learn(1, np.array([0], np.uint32), np.array([2]))
    m.start(1)
    assert m.id[0][0] == 7 and m.trust[0][0] == 1


def test_damaged_files_are_errors(spark, tmp_path):
    d = spark.createDataFrame([(i, f"some words {i} of a text " * 9) for i in range(20)], "doc_id long, text string")
    path = common.scratch(spark, "damage")
    token_file.write_tokens(d, path, "word_bpe_49k.json")
    bad = common.scratch(spark, "damaged")
    rows = spark.read.parquet(f"{path}/segments")
    rows.withColumn("blocks", F.concat(F.substring("blocks", 1, 20), F.expr("unhex('ffff')"), F.expr("substring(blocks, 23)"))).write.parquet(f"{bad}/segments")
    spark.read.parquet(f"{path}/head").write.parquet(f"{bad}/head")
    with pytest.raises(Exception, match="checksum"):
        token_file.read_tokens(spark, bad).collect()


def test_other_tokenizers_are_errors(spark):
    import public_tokenizers

    with pytest.raises(ValueError, match="white space"):
        token_file.WordIds(public_tokenizers.path("byte_bpe_50k.json"))


def test_equal_ids_are_written_once_each(spark):
    d = spark.createDataFrame([(i, t, "x", 1) for i in (None, 5) for t in (None, "", "a b", "a b", "c")], "doc_id long, text string, h string, shard int")
    path = common.scratch(spark, "equal-ids")
    token_file.write_tokens(d, path, "word_bpe_49k.json")
    r = sorted(map(tuple, token_file.read_tokens(spark, path).collect()), key=lambda x: x[1])
    assert len(r) == 10 and [x[0] for x in r] == [None] * 5 + [5] * 5 and [x[1] for x in r] == list(np.cumsum([0, *[x[2] for x in r]])[:-1])


def count_quality(t):
    words = [w.encode() for w in []] if t is None else t.encode().split()
    lines = [] if t is None else t.split("\n")
    text = t or ""
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = set()
    for i in range(len(words) - 4):
        if grams[tuple(words[i : i + 5])] > 1:
            hit.update(range(i, i + 5))
    seen, dup = set(), 0
    for line in lines:
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_quality_counts_equal_brute_force(spark, odd):
    for docs in (odd, spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")):
        got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in quality.judge_quality(docs, quality.DecisionList()).collect())
        assert got == Counter((r["doc_id"], *count_quality(r["text"])) for r in docs.collect())


def test_quality_of_a_long_text(spark):
    d = spark.createDataFrame([(1, "some words of a text that repeats itself now and then " * 20_000)], "doc_id long, text string")
    r = quality.judge_quality(d, quality.DecisionList()).first()
    assert r["n_words"] == r["n_repeat_words"] == 220_000 and not r["kept"]


def test_mixing_takes_what_the_quotas_say(odd):
    size = mixing.size_of(F.col("text"))
    r = mixing.mix(odd, size, block_tokens=4).collect()
    by = {}
    for x in r:
        own = by.setdefault(x["source_size"], [0, x["target"]])
        own[0] += x["taken"]
    assert all(abs(taken - target) <= max(8, 0.05 * target) for taken, target in by.values())
    again = mixing.mix(odd, size, block_tokens=4).collect()
    assert Counter(map(tuple, r)) == Counter(map(tuple, again))


def test_lattice_of_a_long_word(spark):
    d = spark.createDataFrame([(1, "日本語" * 3000), (2, "ab " * 50), (3, None), (9, "abc" * 4000)], "doc_id long, text string")
    r = {x["doc_id"]: x for x in lattice.score_texts(d, "piece_bpe_32k.model").collect()}
    assert all(math.isfinite(x["score"]) for x in r.values()) and r[1]["n_tokens"] == 2


def test_pieces_are_bounded_in_bytes():
    import pyarrow as pa

    texts = ["x" * n for n in (10, 3000, 1, 1, 5000, 2, 0)] + [None] * 3
    b = pa.RecordBatch.from_arrays([pa.array(range(10)), pa.array(texts)], ["i", "t"])
    cut = list(common.pieces(iter([b]), 1, limit=1000))
    assert [x for c in cut for x in c.column(0).to_pylist()] == list(range(10))
    assert all(c.num_rows == 1 or sum(len(t or "") for t in c.column(1).to_pylist()) <= 1000 for c in cut)


def test_scratch_needs_a_shared_folder(spark):
    at = spark.conf.get("spark.checkpoint.dir")
    assert common.scratch(spark, "x").startswith(at)
    assert token_counts.count_tokens(spark.createDataFrame([(1, "a")], "doc_id long, text string"), "piece_bpe_32k.model").count() == 1
