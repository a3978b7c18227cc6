"""Point-in-time join, best-fit packing and fill-in-middle on odd tables, against brute force and SQL."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.llm import best_fit, fill_middle, point_in_time, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_point_in_time", "op13_fill_middle"])
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.SQL[name])
    cols = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(cols)
    assert sorted(map(repr, got.select(*cols).rdd.map(tuple).collect())) == sorted(map(repr, want.fetchall()))


# point in time


def joined(versions, asks, chunk=64):
    order, keep = F.struct(F.col("event"), (-F.col("arrival")).alias("early"), F.col("id")), F.struct(F.col("lang"))
    return point_in_time.point_in_time(versions, asks, F.greatest("event", "arrival"), F.col("expiry"), order, keep, chunk=chunk)


VERSIONS = "id long, source string, event long, arrival long, expiry long, lang string, w string, t long, node long"
ASKS = "id long, source string, t long, w_ string, own_ string, lang string"


@pytest.mark.parametrize("chunk", [1, 8, 64])
def test_point_in_time_is_brute_force(spark, chunk):
    rng = random.Random(chunk)
    v = []
    for i in range(600):
        e = rng.randint(-300, 900)
        length = rng.choice([0, 1, 5, 40, 400, 3000])
        v.append((i % 550, rng.choice(["a", "a", "a", "b", "c", None]), e if i % 50 else None, e + rng.randint(-40, 60), e + length if i % 7 else None, rng.choice("xyz"), "x", 1, 1))
    v += v[:40]  # repeated rows
    q = [(i, rng.choice(["a", "b", "c", "d", None]), rng.randint(-200, 1200) if i % 20 else None, "w", "o", "en") for i in range(300)]
    q += [q[5], q[5]]

    def brute(source, t):
        best = None
        for i, s, e, a, x, lang, *_ in v:
            if s is not None and s == source and None not in (e, a, t) and e <= t and a <= t and (x is None or t < x):
                best = max(best or (-(10**9),), (e, -a, i, lang))
        return best

    got = joined(spark.createDataFrame(v, VERSIONS), spark.createDataFrame(q, ASKS), chunk).collect()
    assert sorted(repr(tuple(r)[:6]) for r in got) == sorted(map(repr, q))
    for r in got:
        w = r["w"] and (*r["w"]["order"], r["w"]["keep"]["lang"])
        assert w == brute(r["source"], r["t"]), r


def test_point_in_time_of_empty_tables(spark):
    v, q = spark.createDataFrame([(1, "a", 1, 1, 9, "x", "x", 1, 1)], VERSIONS), spark.createDataFrame([(1, "a", 5, "w", "o", "en")], ASKS)
    assert joined(v, q.limit(0)).count() == 0
    assert [r["w"] for r in joined(v.limit(0), q).collect()] == [None]
    assert joined(v, q).first()["w"]["order"]["id"] == 1


def test_nodes_dont_grow_with_copies(spark):
    """However many versions a second has, a node has a row for each interval."""
    v = spark.range(20_000).select("id", F.lit("hot").alias("source"), (F.col("id") % 64).alias("event"), F.lit(0).cast("long").alias("arrival"), F.lit(500).cast("long").alias("expiry"), F.lit("x").alias("lang"))
    q = spark.range(64).select("id", F.lit("hot").alias("source"), F.col("id").alias("t"))
    got = joined(v, q).collect()
    assert all(r["w"]["order"]["event"] == r["t"] and r["w"]["order"]["id"] == 20_000 - 20_000 % 64 + r["t"] - (64 if r["t"] >= 20_000 % 64 else 0) for r in got)


# best fit


def check_sequences(rows, capacity):
    at = defaultdict(list)
    for r in rows:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in at.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert 0 < end <= capacity
    return at


def test_packing_of_odd_tables(spark):
    rng = random.Random(1)
    texts = [None, "", "<|endoftext|> in a text <|endoftext|>", "a  b \n\n c\t\n   d e'll DON'T ½ 漢字", "x" * 5000, " " * 3000, "word " * 40_000] + [" ".join(rng.choice(["lorem", "ipsum", "dolor", "1234"]) for _ in range(rng.randint(1, 900))) for _ in range(60)]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(None, "null id", "x", 1), (3, texts[3], "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, size long").repartition(3)
    got = best_fit.pack_documents(docs, "byte_bpe_50k.json", capacity=256, with_ids=True).cache()
    out = got.collect()
    at = check_sequences(out, 256)
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by = defaultdict(list)
    for r in out:
        by[r["doc_id"]].append(r)
    total = 0
    for i, t, *_ in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        for copy in range(2 if i == 3 else 1):
            own = sorted(by[i], key=lambda r: r["piece"])[copy :: 2 if i == 3 else 1]
            assert [x for r in own for x in r["ids"]] == ids
            assert [r["start"] for r in own] == [sum(len(r["ids"]) for r in own[:k]) for k in range(len(own))]
            assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in own) and all(r["length"] == 256 for r in own[1:])
    assert len(at) <= -(-total // 256) + 1
    whole = {r["sequence_id"]: r["ids"] for r in best_fit.sequences(got).collect()}
    assert all(list(whole[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]]) == list(r["ids"]) for r in out)
    assert best_fit.pack_documents(docs.limit(0), "byte_bpe_50k.json").count() == 0


def test_packing_by_parts_islands_and_rounds(spark):
    """Many small parts: their rests are packed with one another, and reruns agree."""
    items = spark.range(3000).select(F.col("id").alias("row"), (1 + F.pmod(F.xxhash64("id"), F.lit(700))).cast("int").alias("size")).cache()
    sizes = dict(items.collect())
    a, b = (sorted(tuple(r) for r in best_fit.pack(items, 1000, part_items=250, islands=2, epochs=2).collect()) for _ in range(2))
    assert a == b and sorted(r[0] for r in a) == sorted(sizes)
    seq = check_sequences([{"sequence_id": s, "offset": o, "length": sizes[i]} for i, s, o in a], 1000)
    assert len(seq) <= 1.01 * -(-sum(sizes.values()) // 1000) + 1


def test_a_hot_size_and_full_ones(spark):
    items = spark.range(900).select(F.col("id").alias("row"), F.when(F.col("id") % 3 == 0, 1000).when(F.col("id") % 3 == 1, 501).otherwise(1).alias("size"))
    got = best_fit.pack(items, 1000, part_items=200).collect()
    assert len({r["sequence"] for r in got}) == 600
    with pytest.raises(Exception, match="."):
        best_fit.pack(items, 999).count()


def exact_bins(sizes, capacity):
    """Brute force by branch and bound."""
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def go(i, load):
        if len(load) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(load)
            return
        for b in range(len(load)):
            if load[b] + sizes[i] <= capacity and load[b] not in load[:b]:
                load[b] += sizes[i]
                go(i + 1, load)
                load[b] -= sizes[i]
        load.append(sizes[i])
        go(i + 1, load)
        load.pop()

    go(0, [])
    return best[0]


def test_evolution_reaches_brute_force():
    rng, worse = np.random.default_rng(4), 0
    for case in range(20):
        sizes = rng.integers(20, 60, 14)
        m = best_fit.first_members(sizes, np.random.default_rng(case), 100)
        for epoch in range(4):
            m = best_fit.evolve(sizes, m, np.random.default_rng([case, epoch]), 100)
        least, got = exact_bins(sizes.tolist(), 100), int(m[0].max()) + 1
        assert best_fit.least_bins(sizes, 100) <= least <= got <= least + 1
        assert np.bincount(m[0], sizes).max() <= 100
        worse += got > least
    assert worse <= 2


def test_children_are_packings_and_hold_whole_bins():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 400, 500)
    a, b = best_fit.first_members(sizes, rng, 1000)[2:4]
    for _ in range(20):
        c = best_fit.cross(sizes, a, b, rng, 1000)
        load = np.bincount(c, sizes)
        assert load.max() <= 1000 and load.min() > 0
        bins = lambda m: {frozenset(np.flatnonzero(m == k).tolist()) for k in range(m.max() + 1)}
        assert len(bins(c) & bins(b)) >= 5


# fill in middle


def units(text):
    return re.findall(r"[A-Za-z]+|[^A-Za-z]", text or "")


ODD = [None, "", "a", " ", "ab cd", "x<P>y", "line\nbreak\r\n", "ä漢字 mixed ßtext", "Z" * 5000, "1" * 700, "a1" * 400, "word " * 3000, "\U0001f600 smile \U0001f600\U0001f600", "tail of letters" * 30 + "Q" * 400]


def test_cuts_are_brute_force(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "k long, text string")
    rng = random.Random(3)
    asked = [(i, o) for i, t in enumerate(ODD) for n in [len(units(t))] for o in {0, n // 2, max(0, n - 1), n, n + 5, rng.randint(0, n)}] + [(4, 1), (None, 1)]
    got = fill_middle.cut_offsets(docs, spark.createDataFrame(asked, "k long, ordinal long"), "k").collect()
    want = {(i, o): len("".join(units(ODD[i])[:o])) for i, o in asked if i is not None and o < len(units(ODD[i]))}
    assert {(r["k"], r["ordinal"]): r["offset"] for r in got} == want
    assert {r["times"] for r in got if (r["k"], r["ordinal"]) == (4, 1)} == {sum(x == (4, 1) for x in asked)}


def test_fill_in_middle_is_brute_force(spark):
    rows = [(i, t, "clash", 9, "old") for i, t in enumerate(ODD * 8)] + [(None, "a null id here", "x", 1, "y"), (3, "a b c", "x", 1, "y"), (3, "a b c", "x", 1, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_ string, n_ long, form string")
    got = fill_middle.fill_in_middle(docs, fill_middle.hashed_choices(F.col("doc_id"))).withColumn("back", fill_middle.restore(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {"doc_id", "text", "row_", "n_", "n", "form", "prefix_chars", "middle_chars", "output", "back"}
    want, seen = [], set()
    for i, t, clash, nn, _ in rows:
        t = t or ""
        x = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
        h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
        u = units(t)
        lo, hi = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
        p, m, s = "".join(u[:lo]), "".join(u[lo:hi]), "".join(u[hi:])
        form = "plain" if not t or any(k in t for k in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
        output = {"plain": t, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        seen.add(form)
        want.append((i, t, len(u), form, None if form == "plain" else len(p), None if form == "plain" else len(m), output, t))
    assert seen == {"plain", "psm", "spm"}
    assert sorted(map(repr, ((r["doc_id"], r["text"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]) for r in got))) == sorted(map(repr, want))
    assert fill_middle.fill_in_middle(docs.limit(0), fill_middle.hashed_choices(F.col("doc_id"))).count() == 0


def test_fill_in_middle_shuffles_texts_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    df = fill_middle.fill_in_middle(docs, fill_middle.hashed_choices(F.col("doc_id")))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    plan = plan[: plan.index("Initial Plan")]
    made = [x for x in plan.split("\n") if " Exchange hashpartitioning" in x and "ReusedExchange" not in x]
    assert len(made) == 1 and plan.count("ReusedExchange") == 2, plan


def test_words_of_letters_are_encoded_together_and_marks_apart(monkeypatch):
    import public_tokenizers

    from nearfield.llm import token_file

    w = token_file.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    plain = w.tokenizer
    texts = [
        "İstanbul ıIJ été$$", "éa café ́x", "don't ab's, it's$", "x<|endoftext|>, a|> foo<|endoftext", "ab$'s ab,'t", "한글 ᄒ ᅡ",
        "a1b2 12. 3,4 é, é.. ß$$ ＡＢ ½ Ⅳ ʰx ǅ", "ab..,, #ab# $5 a&&b * ×$ 中$", "", " ".join(f"{a}{b}e{c}" for a in "abcd" for b in "xyzé" for c in ("", "$$", ",")),
    ]
    texts = [t.encode() for t in texts]
    calls = []

    class Counted:
        def encode_batch_fast(self, runs, add_special_tokens):
            calls.append(len(runs))
            return plain.encode_batch_fast(runs, add_special_tokens=add_special_tokens)

    w.tokenizer = Counted()
    monkeypatch.setattr(token_file, "CACHE_ENTRIES", 20)
    for some in (texts, texts[::-1], texts[5:]):
        for t in some:
            assert w([t])[0] == b"".join(i.to_bytes(2, "little") for i in plain.encode(t.decode(), add_special_tokens=False).ids)
    calls.clear()
    w.known.clear()
    w([texts[-1]])
    assert calls[0] == 1 and sum(calls) <= 3  # sixteen words in one text; before, and with marks, one each


@pytest.mark.parametrize("part", [4 << 20, 2000])
def test_marked_words_are_the_tokenizers(monkeypatch, part):
    import public_tokenizers

    from nearfield.llm import token_file

    monkeypatch.setattr(token_file.MarkedWords, "PART", part)
    w = token_file.TextIds(public_tokenizers.path("word_bpe_49k.json"))
    plain = w.runs.tokenizer
    rng = random.Random(3)
    parts = [*"abzAZ09'.,!|<>$_-\"\\ \n\t\r\x0b", "'s", "'S", "'re", "'LL", "'ve", "'d", "'x", "''", "É", "é", "ß", "ÿ", "Ÿ", "ł", "Ł", "the", "ing"]
    texts = ["", "xİ$ İ.", "a" * 1200 + " b", "don't''s 's's 5'm.'d", "<|endoftext|> A", *("".join(rng.choices(parts, k=30)) for _ in range(400))]
    texts += ["".join(rng.choices([*parts, "İ", "×", "÷", "中", "\x00", "\x1c", "\xa0", "é"], k=20)) for _ in range(200)]
    raw = [t.encode() for t in texts]
    assert sum(map(w.marked.can, raw)) > 300 and None in w.marked([raw[0], raw[2], raw[3]])
    assert [np.frombuffer(x, "<u2").tolist() for x in w(raw)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    # a word whose lower case ends in a mark isn't parted from the marks behind it
    assert w.runs(["xİ$".encode()]) == [np.array(plain.encode("xİ$", add_special_tokens=False).ids, "<u2").tobytes()]


def test_coder_keeps_rare_ids_and_tells_damage():
    from nearfield.llm import range_coder

    rng = np.random.default_rng(5)
    counts = np.zeros(1 << 16, np.int64)
    counts[rng.choice(1 << 16, 5000, replace=False)] = (10.0 ** rng.uniform(0, 9, 5000)).astype(np.int64)
    prior, own = range_coder.Prior(counts), np.flatnonzero(counts)
    blocks = [rng.choice(own, n) for n in (0, 1, 2, 300, 4096)] + [np.repeat(rng.choice(own, 5), 800)] * 2
    coded = range_coder.encode_blocks(blocks, prior)
    back = range_coder.decode_blocks([x for c in coded for x in range_coder.split_blocks(c)], prior)
    assert all((a == b).all() for a, b in zip(blocks, back, strict=True))
    for at in (17, 21, 24, 60, len(coded[4]) // 2):
        broken = bytearray(coded[4])
        broken[at] ^= 0xFF
        with pytest.raises(ValueError, match="checksum"):
            range_coder.decode_blocks(range_coder.split_blocks(bytes(broken)), prior)
