"""Toxicity: noisy-channel deobfuscation by Viterbi decoding, then a score of the restored text."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import byte_batches, fold, pieces, stored, table, texts_of

# What a written character may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i"}
HOMOGLYPHS = {"а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k"}

#: Symbols of the character model: 0 between words, 1 to 26 letters, 27 characters beyond ASCII, 28 the rest.
N = 29
_CODES = np.array([1 + b - 97 if 97 <= b <= 122 else 1 + b - 65 if 65 <= b <= 90 else 27 if b >= 128 else 0 if b in b" \t\n\x0b\x0c\r.,;:?" else 28 for b in range(256)], dtype=np.int32)
_ORDER = 4


def gram_counts(texts: list[bytes]) -> np.ndarray:
    """Counts of all 4-grams of symbols; texts stand apart by word ends."""
    c = _CODES[np.frombuffer(b"   " + b"   ".join(texts) + b"   ", dtype=np.uint8)]
    c = c[np.concatenate(([True, True, True], ~((c[3:] == 0) & (c[2:-1] == 0) & (c[1:-2] == 0) & (c[:-3] == 0))))]
    return np.bincount(((c[:-3] * N + c[1:-2]) * N + c[2:-1]) * N + c[3:], minlength=N**_ORDER)


def log_model(counts: np.ndarray) -> np.ndarray:
    """log p(symbol | three before), by Witten-Bell interpolation of the orders 3 to 0."""
    p = np.full(N, 1.0 / N)
    for k in range(1, _ORDER + 1):
        c = counts.reshape(-1, N**k).sum(0).reshape(-1, N).astype(float)
        total, kinds = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True)
        lower = np.tile(p.reshape(-1, N), (c.shape[0] // p.reshape(-1, N).shape[0], 1))
        p = np.where(total > 0, (c + kinds * lower) / np.maximum(total + kinds, 1), lower)
    return np.log(p.ravel())


class Decoder:
    """The likeliest intended string behind a written span, under the channel and the character model.

    Viterbi over histories of three symbols, none of them cut: a position has as many as its last characters can stand
    for, and 29**3 at most, so time is in proportion to the span's length. Spans met before are kept, up to a number of
    characters.
    """

    KEEP, SWAP, DROP, REPEAT, TWICE, GAP, END = (math.log(x) for x in (0.05, 0.8, 0.02, 0.3, 0.01, 0.95, 0.9))

    def __init__(self, model: np.ndarray) -> None:
        self.model = model.tolist()
        self.known: dict[tuple[str, bool], str] = {}
        self.held = 0

    def __call__(self, span: str, spaced: bool) -> str:
        out = self.known.get((span, spaced))
        if out is None:
            self.held += 32 + len(span)
            if self.held > 4 << 20:
                self.known.clear()
                self.held = 32 + len(span)
            out = self.known[span, spaced] = self.decode(span, spaced)
        return out

    def arcs(self, ch: str, before: str, run: int, spaced: bool, ends: bool = False) -> list[tuple[str, int, float]]:
        """(written out, its symbol or -1 for none, log channel probability) of a lattice position. ends: nothing but
        marks of sentences follow, so that the character may be one as well, beside the word."""
        ch = HOMOGLYPHS.get(ch, ch)
        if spaced and not ch.isalnum() and ch not in LEET:
            return [("", -1, self.GAP), (" ", 0, math.log(1 - math.exp(self.GAP)))]
        if "a" <= ch <= "z":
            own = [(ch, ord(ch) - 96, 0.0 if run < 3 else 3 * self.DROP)]
        elif ch in LEET:
            own = [(x, ord(x) - 96, self.SWAP - math.log(len(LEET[ch]))) for x in LEET[ch]]
            own += [(ch, 28, self.KEEP), (ch, -1, self.END) if ends else ("", -1, self.DROP)]
        else:
            own = [(ch, 27 if ord(ch) >= 128 else 28, 0.0)]
        if ch == before:
            own.append(("", -1, self.REPEAT if run > 2 else self.TWICE))
        return own

    def decode(self, span: str, spaced: bool) -> str:
        model, size = self.model, N**3
        states: dict[int, tuple[float, tuple]] = {0: (0.0, ())}
        before, run = "", 0
        end = len(span) if spaced else word_end(span)
        for i, ch in enumerate(span):
            run = run + 1 if ch == before else 1
            after: dict[int, tuple[float, tuple]] = {}
            for text, symbol, cost in self.arcs(ch, before, run, spaced, i >= end):
                for h, (p, path) in states.items():
                    if symbol < 0:
                        to, q, way = h, p + cost, (path, text) if text else path
                    else:
                        g = h * N + symbol
                        to, q, way = g % size, p + cost + model[g], (path, text)
                    if to not in after or after[to][0] < q:
                        after[to] = (q, way)
            states, before = after, ch
        _, path = max(((p + model[h * N], path) for h, (p, path) in states.items()), key=lambda x: x[0])
        out = []
        while path:
            path, text = path
            out.append(text)
        out = "".join(reversed(out))
        # with the marks at the end read as marks, a word that has no choice itself (a letter twice is one) stays as written
        return span if end < len(span) and out.endswith(span[end:]) and not _NOISE.search(span[:end]) else out


_MARKS = re.escape("".join(x for x in LEET if not x.isdigit()))
#: Stand-ins that may also end a sentence, a cell or a term after a word.
_ENDING = "!|+(<"
#: Spans whose lattice has more than one path: three or more single characters with gaps (with a letter if just three); a
#: whole word, marks included, of a letter and a stand-in, a homoglyph or a letter twice in a row.
_SPACED = re.compile(rf"(?<![^\W_])(?:(?:[a-z0-9{_MARKS}]([ .\-_*])(?:\1)?){{3,}}|(?=[^a-z]{{0,6}}[a-z])(?:[a-z0-9{_MARKS}]([ .\-_*])(?:\2)?){{2}})[a-z0-9{_MARKS}](?![^\W_])")
_WORD = re.compile(rf"(?:[^\W_]|[{_MARKS}])+")


def word_end(span: str) -> int:
    """Where marks begin that may stand after the word: those of sentences, and any thrice or more."""
    end = len(span.rstrip(_ENDING))
    last = span[end - 1 : end]
    return len(span[:end].rstrip(last)) if last and last * 3 == span[end - 3 : end] and last in LEET and not last.isdigit() else end


_LATIN = re.compile(r"[a-z]")
_NOISE = re.compile(rf"[0-9{_MARKS}{''.join(HOMOGLYPHS)}]|([a-z])\1")
_ODD = re.compile(r"[​-‏⁠﻿­]")
_WIDE = re.compile(r"[！-～\U0001d400-\U0001d7ff]")
_WORDS = re.compile(r"[^\W_]+")


_B = np.arange(256)
_LETTER = (_B >= 97) & (_B <= 122)
_STAND = np.isin(_B, [ord(x) for x in LEET if x.isascii()])
_MARK = np.isin(_B, [0xE2, 0xC2])  # of € £ ¡ alone
_ALNUM = _LETTER | ((_B >= 48) & (_B <= 57))
_FOREIGN = np.isin(_B, [0xCE, 0xCF, 0xD0, 0xD1, 0xD2, 0xD4, 0xE2, 0xC2])  # lead bytes of homoglyphs and of € £ ¡


_BLANK = np.isin(_B, list(b" \t\n\x0b\x0c\r"))


def choices(text: bytes) -> list[tuple[int, int]]:
    """The stretches of a lower-cased text, whole words each, where a span can have more than one path; most texts have
    none and stay as they are."""
    b = np.frombuffer(text, dtype=np.uint8)
    if len(b) < 2:
        return []
    letter, stand = _LETTER[b], _STAND[b]
    hot = stand | _FOREIGN[b]
    hot[1:] |= letter[1:] & (b[1:] == b[:-1])
    edge = np.concatenate(([True], ~_ALNUM[b], [True]))
    alone = np.flatnonzero((letter | stand | _MARK[b]) & edge[:-2] & edge[2:])  # a single character; three near one another
    spaced = np.zeros(len(b), dtype=bool)
    if len(alone) > 2:
        near = alone[2:] - alone[:-2] <= (6 if text.isascii() else 10)
        for k in range(3):
            spaced[alone[k : len(alone) - 2 + k][near]] = True
    at = np.flatnonzero(hot | spaced)
    if not len(at):
        return []
    blank = np.concatenate(([-1], np.flatnonzero(_BLANK[b]), [len(b)]))
    k = np.searchsorted(blank, at)
    starts, ends = blank[k - 1] + 1, blank[k]
    letters = np.concatenate(([0], np.cumsum(letter)))
    use = spaced[at] | (letters[ends] > letters[starts])
    if not use.any():
        return []
    starts, ends = starts[use], ends[use]
    first = np.concatenate(([True], starts[1:] > ends[:-1] + 2))
    return list(zip(starts[first].tolist(), np.maximum.reduceat(ends, np.flatnonzero(first)).tolist(), strict=True))


def restore(text: str, decoder: Decoder) -> tuple[str, int]:
    """The lower-cased text with each obfuscated span decoded; how many were. A span without choice is left alone,
    and so are words without a Latin letter."""
    t = text.lower()
    if not t.isascii():
        if _ODD.search(t):
            t = _ODD.sub("", t)
        if _WIDE.search(t):
            t = unicodedata.normalize("NFKC", t).lower()
    raw = t.encode()
    stretches = choices(raw)
    if not stretches:
        return t, 0
    n = 0

    def one(spaced: bool):
        def put(m: re.Match) -> str:
            nonlocal n
            s = m.group()
            if not spaced and not (_LATIN.search(s) and _NOISE.search(s)):
                return s
            out = decoder(s, spaced)
            n += out != s
            return out

        return put

    out, last = [], 0
    for a, e in stretches:
        out += [raw[last:a].decode(), _WORD.sub(one(False), _SPACED.sub(one(True), raw[a:e].decode()))]
        last = e
    return "".join([*out, raw[last:].decode()]), n


#: Lengths of word beginnings that may become features, besides whole words.
PARTS = (4, 5, 6, 7)


def features(words: Counter) -> Counter:
    """Occurrences of words (=) and of their beginnings (^)."""
    out = Counter({f"={w}": n for w, n in words.items()})
    for k in PARTS:
        for w, n in words.items():
            if len(w) >= k:
                out[f"^{w[:k]}"] += n
    return out


def value(n: int, size: int) -> float:
    """A feature's value in a text of `size` words: how dense it is, so that chance hits of long texts weigh little."""
    return math.log1p(100.0 * n / max(size, 1))


@dataclass
class Toxicity:
    """chars: log probabilities of the character model. weights: a logistic weight for each feature's value."""

    chars: np.ndarray
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -3.0

    def scorer(self, with_text: bool = False):
        decoder = Decoder(self.chars)
        kinds: dict[tuple[str, int], dict[str, float]] = {}
        for f, w in self.weights.items():
            kinds.setdefault((f[0], 0 if f[0] == "=" else len(f) - 1), {})[f[1:]] = w

        def score(text: str) -> tuple[float, str | None, int]:
            restored, n = restore(text, decoder)
            every = _WORDS.findall(restored)
            words, met = Counter(every), Counter()
            for (kind, k), own in kinds.items():
                if kind == "=":
                    met.update({f"={w}": words[w] for w in own.keys() & words.keys()})
                else:
                    for w in words:
                        if w[:k] in own:
                            met[f"^{w[:k]}"] += words[w]
            z = self.bias + math.fsum(sorted(self.weights[f] * value(c, len(every)) for f, c in met.items()))
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), restored if with_text else None, n

        return score


def logistic(rows: list[tuple[dict[int, float], int]], n: int, ridge: float = 0.02, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge-regularised logistic regression by accelerated gradient descent; both start at 0."""
    at = np.array([(i, j) for i, (x, _) in enumerate(rows) for j in x], dtype=np.int64).reshape(-1, 2)
    v = np.array([x[j] for x, _ in rows for j in x])
    y = np.array([float(b) for _, b in rows])
    w, bias, before, lead = np.zeros(n), 0.0, (np.zeros(n), 0.0), 1.0
    size = np.bincount(at[:, 0], weights=v * v, minlength=len(rows)).max() if len(v) else 0.0
    rate = 1.0 / (0.25 * (size + 1) + ridge)
    for _ in range(steps):
        z = bias + np.bincount(at[:, 0], weights=v * w[at[:, 1]], minlength=len(rows))
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(rows)
        new = (w - rate * len(rows) ** 0.5 * (np.bincount(at[:, 1], weights=v * g[at[:, 0]], minlength=n) + ridge / len(rows) * w), bias - rate * len(rows) ** 0.5 * g.sum())
        after = (1 + (1 + 4 * lead * lead) ** 0.5) / 2
        k = (lead - 1) / after
        w, bias = new[0] + k * (new[0] - before[0]), new[1] + k * (new[1] - before[1])
        before, lead = new, after
    return before


def _fold_rows(batch, i: int, n: int, out: int, keep: bool) -> list[bytes]:
    ids, texts = batch.column(0).to_pylist(), texts_of(batch.column(i))
    return [t for d, t in zip(ids, texts, strict=True) if (fold(d, n) == out) != keep]


def fit_characters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 4, held: int = 2) -> np.ndarray:
    """The character model of all documents outside the held-out fold. Each task sends its non-zero counts, so the driver
    gets at most 29**4 sums, whatever the corpus."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(N**_ORDER, dtype=np.int64)
        for batch in pieces(batches, 1):
            texts = _fold_rows(batch, 1, folds, held, True)
            for a, b in byte_batches(texts, 2 << 20):  # counting takes several times a text's size
                total += gram_counts(texts[a:b])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["g", "n"])

    counts = np.zeros(N**_ORDER)
    for r in docs.select(id_col, text_col).mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).collect():
        counts[r[0]] = r[1]
    return log_model(counts)


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 4, held: int = 2, max_labelled: int = 12_000, max_features: int = 50_000, max_kept: int = 400, min_ratio: float = 3.0, most_of_one: int = 3) -> Toxicity:
    """Character model of all training documents; a classifier fitted on a bounded sample of labelled ones.

    max_labelled bounds the labelled sample (the ids of smallest hash, held-out fold left out; equal texts teach once);
    max_features bounds the candidates that the driver holds (the most frequent in toxic texts). A feature is a word, or
    a beginning of words, of the restored text that is at least min_ratio times as frequent in toxic texts; the
    max_kept of greatest log likelihood ratio enter a logistic regression on their density. In these frequencies, by
    which features are chosen, a text counts a feature most_of_one times at most, so that no single text makes one; fit
    and scores know all occurrences. Without labels of both classes no feature is taken, and every text gets the same
    score. Texts are restored whole, a few megabytes at a time; null and empty ones teach nothing but the bias; rows that
    repeat an id share its label, equal texts of different labels teach once, as toxic; other columns aren't read.
    """
    spark = docs.sparkSession
    model = Toxicity(fit_characters(docs, id_col, text_col, folds, held))
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (F.crc32(F.col(id_col).cast("string").cast("binary")) % folds != held))
    some = usable.groupBy(id_col).agg(F.max(label_col).alias("y")).orderBy(F.xxhash64(id_col), id_col).limit(max_labelled).collect()
    n_bad = sum(r[1] for r in some)
    if not n_bad or n_bad == len(some):
        return model
    kind = docs.schema[id_col].dataType.simpleString()
    few = F.broadcast(spark.createDataFrame([(r[0], r[1]) for r in some], f"`{id_col}` {kind}, y int"))
    taught = docs.select(id_col, text_col).join(few, id_col)
    sent = spark.sparkContext.broadcast(model.chars)

    def count(only: frozenset | None):
        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            decoder, seen = Decoder(sent.value), Counter()
            pack = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["f", "n"])
            for batch in pieces(batches, 0):
                for t in texts_of(batch.column(0)):
                    words = Counter(_WORDS.findall(restore(t.decode(), decoder)[0]))
                    seen["*"] += words.total()
                    seen.update({f: min(n, most_of_one) for f, n in features(words).items() if only is None or f in only})
                if len(seen) > 500_000:
                    yield pack()
                    seen.clear()
            yield pack()

        return run

    # equal texts teach once
    parts = stored(taught.groupBy(F.xxhash64(text_col).alias("h")).agg(F.first(text_col).alias("text"), F.max("y").alias("y")).select("text", "y").repartition(spark.sparkContext.defaultParallelism), "toxic-sample")
    bad = parts.where("y = 1").select("text").mapInArrow(count(None), "f string, n long").groupBy("f").agg(F.sum("n").alias("n"))
    toxic = {r[0]: r[1] for r in bad.where("n >= 3").orderBy(F.desc("n"), "f").limit(max_features).collect()}
    fine = parts.where("y = 0").select("text").mapInArrow(count(frozenset(toxic)), "f string, n long").groupBy("f").agg(F.sum("n").alias("n"))
    clean = {r[0]: r[1] for r in fine.collect()}
    size = (toxic.pop("*", 0), clean.pop("*", 0))
    if not all(size):
        return model

    def worth(t: int, c: int) -> float:
        """Log likelihood ratio of the two rates being apart, for words more frequent in toxic texts."""
        if t * size[1] < min_ratio * (c + 0.5) * size[0]:
            return 0.0
        p = (t + c) / (size[0] + size[1])
        return t * math.log(t / size[0] / p) + (c * math.log(c / size[1] / p) if c else 0.0)

    ranked = sorted(((worth(t, clean.get(f, 0)), f) for f, t in toxic.items()), key=lambda x: (-x[0], x[1]))
    names = {f: i for i, (_, f) in enumerate([x for x in ranked if x[0] > 8.0][:max_kept])}
    if not names:
        return model

    def having(batches: Iterator) -> Iterator:
        import pyarrow as pa

        decoder = Decoder(sent.value)
        for batch in pieces(batches, 0):
            rows = []
            for t in texts_of(batch.column(0)):
                words = Counter(_WORDS.findall(restore(t.decode(), decoder)[0]))
                rows.append([{"i": names[f], "v": value(n, words.total())} for f, n in sorted(features(words).items()) if f in names])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(rows, pa.list_(pa.struct([("i", pa.int32()), ("v", pa.float64())])))], ["y", "x"])

    rows = sorted(((r[0], sorted((x["i"], x["v"]) for x in r[1])) for r in parts.mapInArrow(having, "y int, x array<struct<i:int,v:double>>").collect()), key=lambda r: (r[0], r[1]))
    w, bias = logistic([(dict(x), y) for y, x in rows], len(names))
    model.weights, model.bias = {f: float(w[i]) for f, i in names.items()}, float(bias)
    return model


def score_toxicity(docs: DataFrame, model: Toxicity, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, with_text: bool = False) -> DataFrame:
    """Scores of every whole text under a fitted model, in one map without a shuffle.

    Returns id_col, score (0 to 1), predicted (1 from the threshold on), n_restored (spans that decoding changed) and,
    if asked for, the restored text; a row for each row of docs. Null and empty texts have the score of a text without
    features; a null id stays null; repeated rows give repeated rows; other columns of docs are not read. Texts of any
    length are decoded whole.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        score = sent.value.scorer(with_text)
        for batch in pieces(batches, 1):
            rows = [score(t.decode()) for t in texts_of(batch.column(1))]
            s = [r[0] for r in rows]
            cols = [batch.column(0), pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32()), pa.array([r[2] for r in rows], pa.int32())]
            names = [id_col, "score", "predicted", "n_restored"]
            if with_text:
                cols, names = [*cols, pa.array([r[1] for r in rows], pa.string())], [*names, "restored"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int, n_restored int" + ", restored string" * with_text)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """Score and prediction of every document; null and empty texts have the score of no features. More in fit_toxicity."""
    from nearfield.llm.common import fold_column

    docs = table(spark, sf_dir, "documents")
    out = score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (fold_column(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted", "n_restored")
