"""LM scoring: a subword lattice whose arcs are an existing vocabulary's pieces, summed over all segmentations."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import fold, fold_column, pieces, stored, table, texts_of

MARK = "▁"
LOG10 = math.log(10.0)
NONE = -1e30


def vocabulary(path: str) -> tuple[dict[str, float], dict[str, float]]:
    """First and later pieces of a sentencepiece vocabulary with weights from its scores.

    A BPE model's score is minus the rank of its merge, so a piece of rank r gets 1 / (r + 10), as words of Zipf's law
    have; a unigram model's score is a log probability and stays so. Byte pieces are keyed "\\0" + the byte.
    """
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    n = m.get_piece_size()
    ranked = min(m.get_score(i) for i in range(n) if m.is_byte(i) is False) < -1000
    first: dict[str, float] = {}
    later: dict[str, float] = {}
    for i in range(n):
        p = m.id_to_piece(i)
        if m.is_control(i) or m.is_unknown(i):
            continue
        if m.is_byte(i):
            b = "\0" + chr(int(p[3:5], 16))
            first[b] = later[b] = 1e-6
            continue
        # characters of the alphabet have scores without meaning in a model that ranks merges
        w = 1.0 / (10.0 + max(0.0, -m.get_score(i)) % 1e6) if ranked else math.exp(m.get_score(i))
        if p.startswith(MARK):
            if p.strip(MARK) and not p.startswith(MARK * 2):
                first[p[1:]] = w
        elif MARK not in p:
            later[p] = w
    for p, w in later.items():  # a word may begin with any piece, if hardly with those that have no space mark
        first.setdefault(p, w * 1e-3)
    return first, later


@dataclass
class Pieces:
    """Log probabilities of the pieces, a column for each class of texts.

    index: a row of logp for each piece, "^" + piece for a word's first one and "+" + piece for later ones; bytes, which
    spell characters that no piece holds, are "^\\0" + byte and "+\\0" + byte. Row `none` is no piece at all, and rows of
    characters spelled in bytes come behind it, so that no row changes its number. A first
    piece is drawn from one distribution, each later one from another until the word's end is drawn, so the
    probabilities of all words sum to at most 1 in every class.
    """

    index: dict[str, int]
    logp: np.ndarray
    end: np.ndarray
    longest: int
    none: int
    first: dict[str, int]
    later: dict[str, int]

    @classmethod
    def of(cls, names: list[str], weight: np.ndarray, end: np.ndarray) -> Pieces:
        """weight: (pieces, classes), none 0; end: (classes,)."""
        first = np.array([n[0] == "^" for n in names])
        later = weight[~first].sum(0) + end
        logp = np.where(first[:, None], np.log(weight) - np.log(weight[first].sum(0)), np.log(weight) - np.log(later))
        return cls({n: i for i, n in enumerate(names)}, np.vstack([logp, np.full(weight.shape[1], NONE)]), np.log(end) - np.log(later), max(len(n) - 1 for n in names), len(names), *({n[1:]: i for i, n in enumerate(names) if n[0] == sign} for sign in "^+"))

    def lattice(self, words: list[str]) -> dict[tuple[int, int], np.ndarray]:
        """The arcs of words of one length: (start, end) to each word's row of logp. Places with no piece in any word are
        left out; a character without a piece of its own gets a row appended that spells it in bytes."""
        n, none = len(words[0]), self.none
        out = {}
        for e in range(1, n + 1):
            for s in range(max(0, e - self.longest), e):
                sign, own = ("+", self.later) if s else ("^", self.first)
                get = own.get
                rows = [get(w[s:e], none) for w in words]
                if s == e - 1 and none in rows:
                    rows = [get(w[s:e]) or self.spelled(sign, w[s:e]) if r == none else r for r, w in zip(rows, words, strict=True)]
                if e - s == 1 or min(rows) < none:  # only single characters are spelled in bytes
                    out[s, e] = np.array(rows)
        return out

    def spelled(self, sign: str, c: str) -> int:
        raw = c.encode()
        row = self.logp[self.index[sign + "\0" + chr(raw[0])]] + sum(self.logp[self.index["+\0" + chr(b)]] for b in raw[1:])
        self.logp = np.vstack([self.logp, row])
        self.index[sign + c] = (self.later if sign == "+" else self.first)[c] = len(self.logp) - 1
        return len(self.logp) - 1


def by_length(words: list[str], most: int = 4096) -> Iterator[list[int]]:
    """Positions of words of one length, in groups that get smaller as words get longer."""
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    for n, own in sorted(groups.items()):
        step = max(1, most * 8 // max(8, n))
        yield from (own[k : k + step] for k in range(0, len(own), step))


def _log_sum(terms: list[np.ndarray]) -> np.ndarray:
    if len(terms) == 1:
        return terms[0]
    x = np.stack(terms)
    m = x.max(0)
    return m + np.log(np.exp(x - m).sum(0))


def log_probabilities(words: list[str], pieces: Pieces) -> np.ndarray:
    """(words, classes): natural log of the sum over all segmentations, by forward recursion in log space."""
    out = np.zeros((len(words), len(pieces.end)))
    for own in by_length(words):
        some = [words[i] for i in own]
        lattice, n = pieces.lattice(some), len(some[0])
        alpha = [np.zeros((len(some), len(pieces.end)))]
        for e in range(1, n + 1):
            alpha.append(_log_sum([alpha[s] + pieces.logp[lattice[s, e]] for s in range(max(0, e - pieces.longest), e) if (s, e) in lattice]))
        out[own] = alpha[n] + pieces.end
    return out


def expected_counts(words: list[str], members: np.ndarray, pieces: Pieces) -> np.ndarray:
    """(rows of logp, classes): how often each piece is expected in the words' segmentations under the first column of
    logp, each word counted as members (words, classes) says. By forward and backward recursion."""
    total = np.zeros((len(pieces.logp), members.shape[1]))
    for own in by_length(words):
        some = [words[i] for i in own]
        lattice, n = pieces.lattice(some), len(some[0])
        if len(pieces.logp) > len(total):
            total = np.vstack([total, np.zeros((len(pieces.logp) - len(total), total.shape[1]))])
        p = pieces.logp[:, 0]
        alpha, beta = [np.zeros(len(some))], {n: np.zeros(len(some))}
        for e in range(1, n + 1):
            alpha.append(_log_sum([alpha[s] + p[lattice[s, e]] for s in range(max(0, e - pieces.longest), e) if (s, e) in lattice]))
        for s in range(n - 1, 0, -1):
            beta[s] = _log_sum([beta[e] + p[lattice[s, e]] for e in range(s + 1, min(n, s + pieces.longest) + 1) if (s, e) in lattice])
        # each arc's probability in each word that has it; one sum of all arcs for each class
        met = [(rows, np.exp(alpha[s] + p[rows] + beta[e] - alpha[n])) for (s, e), rows in lattice.items()]
        rows, weight = (np.concatenate(x) for x in zip(*met, strict=True))
        word = np.tile(own, len(met))
        some = np.flatnonzero(rows != pieces.none)
        rows, weight, word = rows[some], weight[some], word[some]
        for z in range(members.shape[1]):
            total[:, z] += np.bincount(rows, weights=weight * members[word, z], minlength=len(total))
    return total


@dataclass
class LatticeModel:
    """Of class z (the last one is all training texts): a word of count c_z among N_z tokens is an arc of its own, of
    weight (c_z - d) / N_z; the discounts' mass goes to all texts' arcs, and the discounts of those to the class's
    subword lattice. The end of a text is a token, of weight ends_z / N_z."""

    pieces: Pieces
    words: np.ndarray
    types: np.ndarray
    ends: np.ndarray
    discount: float

    def values(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """log10 of the words' probabilities. counts: (words, classes)."""
        n = self.words + self.ends
        sub = log_probabilities(words, self.pieces)
        if not n[-1] or not self.words[-1]:  # nothing was learned: a word has half of the mass
            return (sub + math.log(0.5)) / LOG10
        with np.errstate(divide="ignore", invalid="ignore"):
            own = np.log(np.maximum(counts - self.discount, 0.0) / n)
            share = np.log(self.discount * self.types / n)
            every = np.logaddexp(own[:, -1:], share[-1] + sub)
            out = np.where(n > 0, np.logaddexp(own, share + every), every)
        out[:, -1] = every[:, -1]
        return out / LOG10

    def end(self) -> np.ndarray:
        n = self.words + self.ends
        at = math.log10(0.5) if not self.words[-1] else math.log10(max(self.ends[-1], 0.5) / n[-1])
        return np.array([math.log10(e / k) if e and k else at for e, k in zip(self.ends, n, strict=True)])

    @property
    def tokens(self) -> int:
        return int(self.words[-1] + self.ends[-1])

    def base_unit(self) -> float:
        return math.log10(self.tokens + int(self.types[-1]) + (self.ends[-1] > 0) + 1)


def words_in(text: bytes) -> list[bytes]:
    return text.lower().split()


def count_words(docs: DataFrame, classes: list[str], folds: int, held: int, most: int = 200_000) -> DataFrame:
    """(word, every, train, c0, c1, ...): occurrences in all texts, in the training folds, and there in each class. docs
    has id, text and class. Each task adds up its own before the shuffle."""
    at = {c: i for i, c in enumerate(classes)}

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen: dict[int, Counter] = {}
        size = lambda: sum(map(len, seen.values()))

        def pack():
            rows = [(w, z, n) for z, own in seen.items() for w, n in own.items()]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64())], ["word", "z", "n"])

        for batch in pieces(batches, 1):
            for d, t, c in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                z = -1 if fold(d, folds) == held else at.get(c, len(at))
                seen.setdefault(z, Counter()).update(words_in(t))
                if len(t) > 4096 and size() > most:
                    yield pack()
            if size() > most:
                yield pack()
        yield pack()

    rows = docs.select("id", "text", "class").mapInArrow(run, "word binary, z int, n long")
    each = [F.sum(F.when(F.col("z") == i, F.col("n")).otherwise(0)).alias(f"c{i}") for i in range(len(classes))]
    return rows.groupBy("word").agg(F.sum("n").alias("every"), F.sum(F.when(F.col("z") >= 0, F.col("n")).otherwise(0)).alias("train"), *each)


def fit_pieces(words: DataFrame, columns: list[str], vocab: str, prior: float = 0.1) -> Pieces:
    """The vocabulary's scores weigh all segmentations of every training word type; their expected counts among each
    class's types, with a little of the scores, are the class's pieces. columns: counts, each class's and then all
    texts'. Tasks send sums of whole millionths, which add up the same in any order; the driver gets a row a piece."""
    first, later = vocabulary(vocab)
    names = ["^" + p for p in first] + ["+" + p for p in later]
    score = np.array([*first.values(), *later.values()])
    sent = words.sparkSession.sparkContext.broadcast(Pieces.of(names, score[:, None], np.array([0.3 * sum(later.values())])))
    k, n = len(columns), len(names)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        pieces = sent.value
        total, spelled = np.zeros((n, k)), Counter()
        for batch in batches:
            some = [w.decode() for w in batch.column(0).to_pylist()]
            members = np.stack([batch.column(1 + z).to_numpy(zero_copy_only=False) > 0 for z in range(k)], axis=1).astype(float)
            got = expected_counts(some, members, pieces)
            total += got[:n]
            for name, i in pieces.index.items():
                if i > n and got[i].any():  # characters in bytes
                    raw = name[1:].encode()
                    for j, b in enumerate(raw):
                        total[pieces.index[("+" if j else name[0]) + "\0" + chr(b)]] += got[i]
        at = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(np.rint(total[at] * 1e6).astype(np.int64).tolist(), pa.list_(pa.int64()))], ["p", "n"])

    got = words.where("train > 0").select("word", *columns).mapInArrow(run, "p long, n array<long>").groupBy("p").agg(*[F.sum(F.col("n")[z]).alias(f"n{z}") for z in range(k)])
    counts = np.zeros((n, k))
    for r in got.collect():
        counts[r[0]] = [x / 1e6 for x in r[1:]]
    ends = np.array([float(x or 0) for x in words.agg(*[F.count_if(F.col(c) > 0) for c in columns]).first()])
    part = np.array([1.0 / sum(first.values())] * len(first) + [1.0 / sum(later.values())] * len(later))
    # a class leans on all texts' pieces, and these on the scores
    every = counts[:, -1:] + (prior * np.sqrt(1 + ends[-1]) * score * part)[:, None]
    lean = np.array([prior * math.sqrt(1 + e) / (1 + ends[-1]) for e in ends[:-1]] + [0.0])
    weight = counts + every * lean
    weight[:, -1:] = every
    return Pieces.of(names, weight, ends + 0.5)


def score_texts(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text", class_col: str | None = None, folds: int = 7, held: int = 2, frequent: int = 65_536, max_classes: int = 8) -> DataFrame:
    """log10 probability of every whole text, learning from the folds other than `held`.

    vocab: a sentencepiece model file whose pieces and scores weigh the segmentations. class_col: a column whose
    max_classes most frequent values in training texts get counts of their own; at scoring, a text's class is unknown,
    and its probability is the sum over classes, one of which is "all texts". Word counts come from all training texts
    and are kept as a table, never on the driver. `frequent` bounds the words whose values are broadcast: the most
    frequent ones, which also are the hot keys; texts send only their other words through the join with the table.

    Returns id_col, held_out, n_tokens, n_known, train_tokens, base_score, score, a row for each row of docs. A null or
    empty text is an end token alone; a null id counts as an empty string for its fold; repeated rows are texts each;
    without training texts words get lattice probabilities from the vocabulary's scores; other columns aren't read.
    A run without white space is one lattice, whatever its length: time and memory are linear in it, some 700 bytes a
    character with six classes, so a run of a megabyte takes 700 MB of its task.
    """
    import os

    if not os.path.dirname(vocab):
        import public_tokenizers

        vocab = public_tokenizers.path(vocab)
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (F.col(class_col).cast("string") if class_col else F.lit(None).cast("string")).alias("class"))
    learned = rows.where(fold_column(F.col("id"), folds) != held).groupBy("class").agg(F.count("*").alias("n"))
    end_count = learned.agg(F.sum("n")).first()[0] or 0
    tops = learned.where("class is not null").orderBy(F.desc("n"), "class").limit(max_classes).collect()
    classes = [r["class"] for r in tops]
    words = stored(count_words(rows, classes, folds, held), "word-counts")
    columns = [*[f"c{i}" for i in range(len(classes))], "train"]
    t = words.agg(*[F.sum(c) for c in columns], *[F.count_if(F.col(c) > 0) for c in columns], F.count_if(F.col("train") == 1), F.count_if(F.col("train") == 2)).first()
    k = len(columns)
    one, two = t[2 * k], t[2 * k + 1]
    number = lambda xs: np.array([float(x or 0) for x in xs])
    model = LatticeModel(fit_pieces(words, columns, vocab), number(t[:k]), number(t[k : 2 * k]), number([*[r["n"] for r in tops], end_count]), one / (one + 2 * two) if one and two else 0.5)
    sent = spark.sparkContext.broadcast(model)

    def value(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            counts = np.stack([batch.column(1 + z).to_numpy(zero_copy_only=False) for z in range(k)], axis=1)
            lp = sent.value.values([w.decode() for w in batch.column(0).to_pylist()], counts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(k), pa.FixedSizeListArray.from_arrays(pa.array(lp.ravel(), pa.float64()), k).cast(pa.list_(pa.float64()))], ["word", "train", "lp"])

    valued = lambda some: some.select("word", *columns).mapInArrow(value, "word binary, train long, lp array<double>")
    # the least count that at most `frequent` words reach, from the counts' histogram
    least, total = None, 0
    steps = words.groupBy(F.floor(F.log2("every") * 8).alias("b")).agg(F.count("*").alias("n"), F.min("every").alias("at"))
    for r in sorted(steps.collect(), key=lambda r: -r["b"]):
        total += r["n"]
        if total > frequent:
            break
        least = r["at"]
    top = [] if least is None else [(bytes(r[0]), r[1], r[2]) for r in valued(words.where(F.col("every") >= least)).collect()]
    rare = words if least is None else words.where(F.col("every") < least)
    unit = model.base_unit()
    known = spark.sparkContext.broadcast(({w: i for i, (w, _, _) in enumerate(top)}, np.array([[c > 0, math.log10(c + 1) - unit, *lp] for _, c, lp in top]).reshape(-1, k + 2)))
    sums = ["b", *[f"s{z}" for z in range(k)]]

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        at, near = known.value
        m = sent.value
        end = np.array([m.ends[-1] > 0, math.log10(m.ends[-1] + 1) - unit, *m.end()])
        for batch in pieces(batches, 2):
            key, word, n, ids, out, tokens, own = [], [], [], [], [], [], []
            for i, d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch.column(2)), strict=True):
                every = Counter(words_in(t))
                found = [(at[w], c) for w, c in every.items() if w in at]
                other = [(w, c) for w, c in every.items() if w not in at]
                x = np.array(found, dtype=np.int64).reshape(-1, 2)
                key += [i] * (len(other) + 1)
                word += [b" %d" % i, *[w for w, _ in other]]  # no word has a space: the text's own row meets nothing, and lies anywhere
                n += [0, *[c for _, c in other]]
                blank = [None] * len(other)
                ids += [d, *blank]
                out += [fold(d, folds) == held, *blank]
                tokens += [every.total() + 1, *blank]
                own += [end + x[:, 1] @ near[x[:, 0]], *blank]
            col = lambda j: pa.array([None if v is None else v[j] for v in own], pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(word, pa.binary()), pa.array(n, pa.int32()), pa.array(ids, batch.column(1).type), pa.array(out, pa.bool_()), pa.array(tokens, pa.int64()), *[col(j) for j in range(k + 2)]], ["k", "word", "n", "id", "held_out", "n_tokens", "known", *sums])

    parts = rows.select(F.monotonically_increasing_id().alias("k"), "id", "text").mapInArrow(read, f"k long, word binary, n int, id {kind}, held_out boolean, n_tokens long, known double, " + ", ".join(f"{c} double" for c in sums))
    met = parts.join(valued(rare), "word", "left")
    met = met.select(
        "k", "id", "held_out", "n_tokens",
        F.coalesce("known", F.when(F.col("train") > 0, F.col("n")).otherwise(0)).alias("known"),
        F.coalesce("b", F.col("n") * (F.log10(F.col("train") + 1) - F.lit(unit))).alias("b"),
        *[F.coalesce(f"s{z}", F.col("n") * F.col("lp")[z]).alias(f"s{z}") for z in range(k)],
    )
    out = met.groupBy("k").agg(F.max("id").alias("id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.sum("known").cast("long").alias("n_known"), *[F.sum(c).alias(c) for c in sums])
    # the sum over classes: a tenth of the mass is all texts', the rest goes by the classes' shares of training texts
    share = [math.log10(0.9 * (e + 0.5) / (sum(model.ends[:-1]) + 0.5 * (k - 1))) for e in model.ends[:-1]] + [-1.0 if k > 1 else 0.0]
    each = F.array(*[F.col(f"s{z}") + F.lit(float(v)) for z, v in enumerate(share)])
    out = out.withColumn("m", F.array_max(each))
    score = F.col("m") + F.log10(F.aggregate(F.transform(each, lambda x: F.pow(F.lit(10.0), x - F.col("m"))), F.lit(0.0), lambda a, x: a + x))
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), F.col("b").alias("base_score"), score.alias("score"))


def op2_lattice(spark, sf_dir: str) -> DataFrame:
    """Base and lattice scores of every document. Nulls, empties, long texts: as score_texts says."""
    return score_texts(table(spark, sf_dir, "documents"), "piece_bpe_32k.model", class_col="lang")
