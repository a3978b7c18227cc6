"""The text operators on nulls, empty and long texts, repeated rows, empty tables, clashing columns, and brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.llm import chat, common, decontaminate, lattice, line_dedup, mixing, near_join, quality, range_coder, token_counts, token_file, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, row long, word string, label string, key string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, 9, 9, "x", "x", "x") for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    words = [a + b for a in ("lo", "re", "mi", "fa") for b in ("na", "to", "ku", "se", "ri")]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = text(120)
    rows = [(0, None, None), (1, "", "a"), (2, "   \n ", "a"), (None, "a null id " + text(30), "b"), (3, base, "a"), (4, base, "b"), (4, base, "b"), (5, base + " more", "a"), (6, base.replace(base.split()[60], "odd", 1), "c"), (7, text(20_000), "b"), (8, "short", "a")]
    rows += [(i, text(rng.randint(1, 200)) + "\nA line that many documents share here\n" + text(9), rng.choice("abc")) for i in range(10, 60)]
    return table(spark, rows).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")


def pairs(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def test_empty_tables(spark, labels):
    none = table(spark, []).limit(0)
    bench = spark.createDataFrame([], "item_id long, text string")
    assert toxicity.score_toxicity(none, toxicity.fit_toxicity(none, labels)).count() == 0
    assert lattice.score_texts(none, "piece_bpe_32k.model").count() == 0
    assert token_counts.count_tokens(none, "piece_bpe_32k.model").count() == 0
    assert line_dedup.dedup_lines(none).count() == 0
    assert decontaminate.find_contamination(none, bench).count() == 0
    assert quality.judge_quality(none, quality.fit_quality(none, labels)).count() == 0
    assert near_join.near_duplicates(none).count() == 0
    assert mixing.mix(none, mixing.size_of(F.col("text"))).count() == 0
    assert mixing.mixed_docs(none).count() == 0
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_toxicity_scores_every_row(docs, labels):
    r = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels), with_text=True).collect()
    assert len(r) == docs.count() and all(0 <= x["score"] <= 1 for x in r)


def test_decoding_restores_written_words():
    text = b"the idiot and the clown are stupid and not worthless ones to be a trash moron " * 200
    d = toxicity.Decoder(toxicity.log_model(toxicity.gram_counts([text])))
    for written, meant in (("1d10t", "idiot"), ("i d i o t", "idiot"), ("cl0wn", "clown"), ("$tup1d", "stupid"), ("iiidiiiot", "idiot"), ("s.t.u.p.i.d", "stupid")):
        assert toxicity.restore(written, d)[0] == meant
    assert toxicity.restore("plain words, left alone!", d) == ("plain words, left alone!", 0)


def test_stand_ins_in_a_row_and_at_the_end_are_decoded():
    text = b"a loser is an idiot and a fool says shit to an asshole or an ass and the ass bit a dog " * 200
    d = toxicity.Decoder(toxicity.log_model(toxicity.gram_counts([text])))
    for written, meant in (("id107", "idiot"), ("sh17", "shit"), ("shi+", "shit"), ("a55", "ass"), ("a$$", "ass"), ("a55hole", "asshole"), ("l053r", "loser"), ("f00l!", "fool!"), ("іԁiot", "idiot"), ("аѕshole", "asshole"), ("d o g", "dog"), ("a\nd.o.g\n", "a\ndog\n"), ("(f o o l)", "(fool)")):
        assert toxicity.restore(written, d)[0].lstrip("(") == meant.lstrip("("), written
    for plain in ("the fool says, an idiot!", "1.2.3 and 107", "a dog!!", "a fool$$$"):
        assert toxicity.restore(plain, d) == (plain, 0)
    # a letter twice is a choice: spelling stays, what the language has with one letter only doesn't
    assert toxicity.restore("annd!!", d)[0] == "and!!" and toxicity.restore("a fool and an ass!!", d)[0] == "a fool and an ass!!"


def test_planted_insults_are_learned(spark):
    rng = random.Random(2)
    words = ["lo", "re", "mi", "fa", "nato", "kuse"]
    rows = [(i, " ".join([*(rng.choice(words) for _ in range(30)), *["zorgle"] * (i % 4 == 0)]), "a") for i in range(400)]
    d = table(spark, rows)
    m = toxicity.fit_toxicity(d, spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int"))
    r = {x["doc_id"]: x for x in toxicity.score_toxicity(d, m).collect()}
    assert all(r[i]["predicted"] == int(i % 4 == 0) for i in r)


def test_lattice_sums_all_segmentations():
    p = lattice.Pieces.of(["^a", "^ab", "+a", "+b", "+ab"] + [s + "\0" + chr(b) for s in "^+" for b in range(256)], np.array([[3.0], [2], [1], [2], [1], *[[1e-6]] * 512]), np.array([2.0]))
    def brute(w, first=True):
        if not w:
            return math.exp(p.end[0])
        return sum(math.exp(p.logp[p.index[("^" if first else "+") + w[:k]], 0]) * brute(w[k:], False) for k in range(1, len(w) + 1) if ("^" if first else "+") + w[:k] in p.index)

    for w in ("a", "ab", "aab", "abab"):
        assert math.exp(lattice.log_probabilities([w], p)[0, 0]) == pytest.approx(brute(w))
    got = lattice.expected_counts(["abab"], np.ones((1, 1)), p)
    assert got[p.index["^a"], 0] + got[p.index["^ab"], 0] == pytest.approx(1)
    alone = lattice.log_probabilities(["日b"], p)[0, 0]
    assert alone == pytest.approx(sum(p.logp[p.index[k], 0] for k in ("^\0" + chr(0xE6), "+\0" + chr(0x97), "+\0" + chr(0xA5), "+b")) + p.end[0])
    # characters spelled in bytes leave the other words of a group as they were
    words = ["日b", "ab", "b本", "語日", "本b"]
    assert lattice.log_probabilities(words, p)[:, 0] == pytest.approx([lattice.log_probabilities([w], p)[0, 0] for w in words])
    assert math.exp(lattice.log_probabilities(["ab", "本語"], p)[0, 0]) == pytest.approx(brute("ab"))


def test_lattice_base_scores(docs):
    r = lattice.score_texts(docs, "piece_bpe_32k.model", class_col="lang", frequent=8).collect()
    c = Counter()
    for i, t in pairs(docs):
        if common.fold(i, 7) != 2:
            c.update([*(t or "").encode().lower().split(), None])
    n, v = sum(c.values()), len(c)
    want = sorted((sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*(t or "").encode().lower().split(), None]), sum(c[w] > 0 for w in [*(t or "").encode().lower().split(), None])) for _, t in pairs(docs))
    got = sorted((x["base_score"], x["n_known"]) for x in r)
    assert np.allclose(want, got) and {x["train_tokens"] for x in r} == {n} and all(x["score"] < 0 for x in r)


def test_range_coder_round_trips():
    rng = np.random.default_rng(0)
    blocks = [np.array([], int), np.array([0]), np.full(2048, 65535), rng.integers(0, 65536, 2048), np.tile([1, 2, 3], 600), *(rng.integers(0, 9, n) for n in range(1, 40))]
    coded = range_coder.encode_blocks(blocks)
    assert all((a == b).all() for a, b in zip(blocks, range_coder.decode_blocks([x for c in coded for x in range_coder.split_blocks(c)]), strict=True))
    broken = bytearray(coded[3])
    broken[40] ^= 1
    with pytest.raises(ValueError):
        range_coder.decode_blocks(range_coder.split_blocks(bytes(broken)))


def test_token_file_is_the_tokenizers(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    path = common.scratch(spark, "test-tokens")
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(99, "It's 3.14, <|endoftext|> <|ENDOFTEXT|> ΟΔΟΣ é. don't... «É»,")], "doc_id long, text string"))
    token_file.write_tokens(more, path, "word_bpe_49k.json")
    at, want = 0, []
    for i, x in sorted(pairs(more), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, token_file.read_tokens(spark, path).collect()), key=lambda r: r[1]) == want


def test_token_counts_are_the_librarys(docs):
    import public_tokenizers
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = Counter(map(tuple, token_counts.count_tokens(docs, "piece_bpe_32k.model").collect()))
    assert got == Counter((i, len((t or "").encode()), len(m.encode(t or "")), len(m.encode(t or "")) > 4096) for i, t in pairs(docs))
    odd = ["", " ", "a  b ", "▁a ▁", "</s> <s>", "\n\n x", "é 🙂  "]
    assert token_counts.piece_counter(public_tokenizers.path("piece_bpe_32k.model"))([x.encode() for x in odd]) == [len(m.encode(x)) for x in odd]


def test_quality_of_repeated_ids_is_the_same_in_any_order(spark, docs):
    twice = docs.unionByName(docs.withColumn("text", F.concat(F.reverse("text"), F.lit(" # # 1 2 3"))))
    marks = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    lists = [quality.fit_quality(d, marks) for d in (twice, twice.repartition(7).orderBy(F.desc("text")), twice.orderBy("text"))]
    assert lists[0] == lists[1] == lists[2]


def test_lines_that_many_documents_share_stay_once(docs):
    r = line_dedup.dedup_lines(docs).collect()
    shared = [x for x in r if "many documents share" in x["text"]]
    # rows of one id count once, so the line of documents 3, 4 and 4 is in two documents only and stays
    assert [x["doc_id"] for x in shared] == [59] and sum(x["n_dropped"] for x in r) == 49 and len(r) == docs.count()


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_search_equals_brute_force(spark, docs, block_bytes):
    some = [t for _, t in pairs(docs) if t and len(t.split()) > 30]
    bench = spark.createDataFrame([(1, " ".join(some[0].split()[4:20])), (2, "short"), (3, None), (4, "MIKU, not there at all"), (1, " ".join(some[5].split()[2:13]))], "item_id long, text string")
    got = Counter((r["doc_id"], r["n_words"], r["n_hit"], r["items_sha256"]) for r in decontaminate.digest(decontaminate.find_contamination(docs, bench, block_bytes=block_bytes)).collect())
    windows = defaultdict(set)
    for r in bench.collect():
        w = decontaminate.words_of((r[1] or "").encode())
        for j in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[j : j + 10])].add(str(r[0]))
    want = Counter()
    for i, t in pairs(docs):
        w = decontaminate.words_of((t or "").encode())
        hit, items = set(), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if own := windows.get(tuple(w[j : j + n])):
                    hit.update(range(j, j + n))
                    items |= own
        want[i, len(w), len(hit), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()] += 1
    assert got == want


def test_statistics_of_repeats(spark):
    d = table(spark, [(1, "a b c d e f a b c d e x", "s"), (2, None, "s"), (3, "one two three four", "s"), (4, "x x x x x x x x", "s"), (5, "l m\nl m\n\n \n#$ q", "s")])
    r = {x["doc_id"]: x for x in quality.judge_quality(d, quality.DecisionList()).collect()}
    assert r[1]["n_repeat_words"] == 10 and r[4]["n_repeat_words"] == 8 and r[5]["n_dup_lines"] == 1 and r[5]["n_symbols"] == 2 and r[2]["base_failed"]


def test_decision_list_finds_the_threshold():
    rows = [({"a": i / 100, "b": (i * 37 % 100) / 100}, i < 80) for i in range(100)]
    rules = quality.learn_list(rows)
    assert all(rules.predict(x) == good for x, good in rows) and rules.describe()[-1] == "ELSE keep"
    assert quality.learn_list([]).rules == [] and quality.learn_list([({"a": 1.0}, True)] * 9).rules == []


def test_near_join_equals_brute_force(docs):
    got = sorted(((r["doc_id"] if r["doc_id"] is not None else -1, r["n_links"]) for r in near_join.near_duplicates(docs, block=2).collect()))
    rows, want = pairs(docs), []
    s = near_join.Shingler(5)
    sets = [set(s((t or "").encode()).tolist()) for _, t in rows]
    for a, (i, _) in enumerate(rows):
        want.append((i if i is not None else -1, sum(a != b and bool(sets[a]) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for b in range(len(rows)))))
    assert got == sorted(want)


def test_pipeline_keeps_the_same_copies_in_any_order(spark, docs):
    import corpus_pipeline

    some = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    orders = [common.stored(some.orderBy(o), "order") for o in (F.asc("doc_id"), F.desc("doc_id"))]
    one, two = (sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, d, "").collect()) for d in orders)
    assert one == two
    assert corpus_pipeline.drop_near_copies(spark, docs, "").columns == docs.columns


def test_stars_connect_what_edges_connect(spark):
    rng = np.random.default_rng(4)
    edges = [(int(u), int(v)) for u, v in rng.integers(0, 60, (70, 2))] + [(100 + i, 200 + t) for i in range(50) for t in range(4)] + [(7, 7)]

    def parts(pairs):
        least = {x: x for e in edges for x in e}
        for _ in least:
            for u, v in pairs:
                least[u] = least[v] = min(least[u], least[v])
        return least

    got = [tuple(r) for r in near_join.stars(spark.createDataFrame(edges, "u long, v long")).collect()]
    assert parts(got) == parts(edges)
    assert sum(u >= 100 for u, _ in got) == 50 + 3


def test_seats_go_to_the_highest_quotients():
    rng = random.Random(5)
    for _ in range(200):
        n = rng.randint(1, 6)
        votes, most, seats = [rng.choice([0, 1, 5, 100, rng.randint(1, 9999)]) for _ in range(n)], [rng.choice([0, 3, 99]) for _ in range(n)], rng.randint(0, 99)
        won = [0] * n
        for _ in range(seats):
            open_ = [(-Fraction(votes[i], 2 * won[i] + 1), i) for i in range(n) if votes[i] and won[i] < most[i]]
            if open_:
                won[min(open_)[1]] += 1
        assert mixing.sainte_lague(seats, votes, most) == won


def test_mix_is_near_its_targets(docs):
    r = mixing.mix(docs, mixing.size_of(F.col("text")), source_col="source").collect()
    got, goal = Counter(), {}
    for x in r:
        assert 0 <= x["taken"] <= 2 * x["size"]
        got[x["source_size"]] += x["taken"]
        goal[x["source_size"]] = x["target"]
    assert len(r) == docs.count() and all(abs(got[s] - goal[s]) <= 0.02 * goal[s] + 8 for s in goal if s)
    assert sum(goal.values()) == pytest.approx(1.5 * sum(goal))
    cut = mixing.mixed_docs(docs)
    assert cut.columns == docs.columns
    # rows are numbered by content there, so blocks fall elsewhere; the amount is the same but for the last blocks
    assert cut.agg(F.sum(mixing.size_of(F.col("text")))).first()[0] == pytest.approx(sum(x["taken"] for x in r), rel=0.01)


def test_chats_read_back(spark):
    odd = ["\\", "<|end|>\n", "<|next|>", "\\<|", "<\\|turn|>", "", None, "a<", "|b", "\\### Assistant: </turn> ok"]
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", None, "<|text|>"]), rng.choice(odd)) for c in (1, 2, None) for t in range(40)]
    rows.append(rows[0])
    r = {x[0]: x for x in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).select("conv_id", chat.read_turns(F.col("formatted")), chat.loss_text(F.col("formatted"), F.col("loss_mask"))).collect()}
    for c in (1, 2, None):
        own = sorted((t, role or "", text or "") for k, t, role, text in rows if k == c)
        assert [tuple(x) for x in r[c][1]] == [x[1:] for x in own]
        assert r[c][2] == "".join(x[2] for x in own if x[1] == "assistant")
