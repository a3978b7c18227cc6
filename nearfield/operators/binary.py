"""Binary vectors: (vec_id, words) with words an array of longs of 32 bits; queries are (query_id, qw)."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.functions.vectors import hamming, pack_bits, sign_bits, unpack_bits
from nearfield.operators import graph
from nearfield.operators.cluster import KMeans, assign
from nearfield.operators.ivf import IVF
from nearfield.operators.quantize import Codec
from nearfield.operators.search import _best, _each, dimension


def to_binary(vectors: DataFrame) -> DataFrame:
    return vectors.select("vec_id", pack_bits(sign_bits(F.col("embedding"))).alias("words"))


def pairs(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """Hamming distances of a stated query set, broadcast in blocks of checked size, to all vectors."""
    return _each(queries, vectors, hamming(F.col("words"), F.col("qw")).cast("double"), dimension(queries, "qw"))


def knn(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    return _best(pairs(queries, vectors), k, False)


def range_join(queries: DataFrame, vectors: DataFrame, radius: int) -> DataFrame:
    return pairs(queries, vectors).where(F.col("distance") < radius)


def histogram(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    return pairs(queries, vectors).groupBy(F.col("distance").cast("int").alias("distance")).agg(F.count("*").alias("n"))


def count_within(queries: DataFrame, vectors: DataFrame, threshold: int) -> DataFrame:
    return pairs(queries, vectors).groupBy("query_id").agg(F.count_if(F.col("distance") <= threshold).alias("n"))


def _prefix(words: Column, bits: int, table: int = 0) -> Column:
    at = table * bits
    x = F.call_function("shiftright", F.element_at(words, at // 32 + 1), F.lit(at % 32))
    return x.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def hash_search(queries: DataFrame, vectors: DataFrame, k: int, bits: int = 8, tables: int = 1, flips: int = 1) -> DataFrame:
    """Candidates share one of `tables` pieces of `bits` bits up to `flips` flipped ones; then exact Hamming rank. Pieces
    lie within words, so bits divides 32."""
    masks = [sum(1 << b for b in c) for n in range(flips + 1) for c in combinations(range(bits), n)]
    got = None
    for t in range(tables):
        v = vectors.withColumn("h", _prefix(F.col("words"), bits, t))
        q = queries.withColumn("m", F.explode(F.array(*[F.lit(m).cast("long") for m in masks]))).withColumn("h", _prefix(F.col("qw"), bits, t).bitwiseXOR(F.col("m")))
        new = q.join(v, "h").select("query_id", "vec_id", hamming(F.col("words"), F.col("qw")).cast("double").alias("distance"))
        got = new if got is None else got.unionByName(new)
    return _best(got.dropDuplicates(["query_id", "vec_id"]) if tables > 1 else got, k, False)


def from_float(distance: Column) -> Column:
    """Squared L2 distance of +-1 vectors as bits."""
    return F.round(distance / 4)


def signs(rows: DataFrame, bits: int, words: str = "words", to: str = "embedding") -> DataFrame:
    """Words as vectors of -1 and 1, whose squared L2 distance is four times the Hamming distance."""
    return rows.withColumn(to, F.transform(unpack_bits(F.col(words), bits), lambda b: (2 * b - 1).cast("float"))).drop(words)


class BitWords(Codec):
    """Words of 32 bits as they are; scores() compares them by exclusive or and a count of bits."""

    def __init__(self, bits: int) -> None:
        self.bits = bits

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Signs as words, the lowest bit first."""
        b = np.zeros((len(x), -(-self.bits // 32) * 32), np.uint8)
        b[:, : self.bits] = x > 0
        return np.packbits(b, axis=1, bitorder="little").view("<u4").astype(np.int64)

    def decode(self, c: np.ndarray) -> np.ndarray:
        b = np.unpackbits(np.ascontiguousarray(c.astype("<u4")).view(np.uint8), axis=1, bitorder="little")[:, : self.bits]
        return 2.0 * b - 1

    def distances(self, q: np.ndarray, codes: np.ndarray, no: int = 0) -> np.ndarray:
        """(queries, codes) squared L2 distances of vectors of -1 and 1: four times the bits that differ."""
        own = self.encode(q)
        return 4.0 * sum(np.bitwise_count(own[:, None, j] ^ codes[None, :, j]) for j in range(own.shape[1])).astype(np.float64)


class BinaryIVF:
    """An inverted file of bits: centroids are the majority of their lists' bits, lists hold words, the rank is by Hamming
    distance."""

    def __init__(self, nlist: int, bits: int) -> None:
        self.bits, self.index = bits, IVF(nlist, codec=BitWords(bits))

    def fit(self, vectors: DataFrame, niter: int = 8) -> BinaryIVF:
        c = KMeans(self.index.nlist, niter).fit(signs(vectors, self.bits))
        self.index.centroids = np.where(c >= 0, 1.0, -1.0)
        return self

    def add(self, vectors: DataFrame) -> BinaryIVF:
        """Bits are unfolded to find a row's list, and go on as words."""
        rows = vectors.select("vec_id", F.col("words").alias("code"), F.transform(unpack_bits(F.col("words"), self.bits), lambda b: (2 * b - 1).cast("float")).alias("embedding"))
        new = assign(rows, self.index.centroids).select("list_no", "vec_id", "code")
        self.index.lists = new if self.index.lists is None else self.index.lists.unionByName(new)
        return self

    def search(self, queries: DataFrame, k: int, nprobe: int = 8) -> DataFrame:
        found = self.index.search(signs(queries, self.bits, "qw", "q"), k, nprobe)
        return found.withColumn("distance", from_float(F.col("distance")))

    def range_search(self, queries: DataFrame, radius: int, nprobe: int = 8) -> DataFrame:
        return self.index.range_search(signs(queries, self.bits, "qw", "q"), 4 * radius, nprobe).withColumn("distance", from_float(F.col("distance")))


def slice_masks(bits: int, slices: int) -> list[list[tuple[int, int]]]:
    """For each of the slices of about equal width, the words it has bits in and the mask of these."""
    cuts = [bits * i // slices for i in range(slices + 1)]
    out = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        words = range(a // 32, (b - 1) // 32 + 1)
        out.append([(w, sum(1 << (x - 32 * w) for x in range(max(a, 32 * w), min(b, 32 * w + 32)))) for w in words])
    return out


def code_classes(vectors: DataFrame) -> DataFrame:
    """(code_id, words, n): each distinct code with its least id and its number of rows."""
    return vectors.where("words is not null").groupBy("words").agg(F.min("vec_id").alias("code_id"), F.count("*").alias("n"))


def match_codes(a: DataFrame, b: DataFrame, radius: int, bits: int) -> DataFrame:
    """(a_id, b_id, n_a, n_b, distance): all pairs of codes of two tables of code_classes() that differ in at most radius
    bits.

    Of radius + 1 slices of the bits at least one is the same in both codes of such a pair, so codes are joined by equal
    slices; a pair counts at the first slice that agrees, so no pair is found twice and nothing has to be made distinct.
    The join is a shuffle by slice, no pair beyond equal slices is looked at; adaptive execution splits slices that many
    codes share. Copies are in one class, so a code of a third of all rows is one row here. Slices should have some bits
    more than the logarithm of the number of codes; with radius + 1 over bits it is an error.
    """
    if radius + 1 > bits:
        raise ValueError("more slices than bits")
    masks = slice_masks(bits, radius + 1)
    word = lambda words, w, m: F.element_at(words, w + 1).bitwiseAND(F.lit(m))

    def sliced(codes: DataFrame, name: str) -> DataFrame:
        keys = F.array(*[F.xxhash64(F.lit(i), *[word(F.col("words"), w, m) for w, m in own]) for i, own in enumerate(masks)])
        return codes.select(F.col("code_id").alias(f"{name}_id"), F.col("n").alias(f"n_{name}"), F.col("words").alias(f"w_{name}"), F.posexplode(keys).alias("slice", "key"))

    # a key is a hash: what agrees is seen from the words
    both = sliced(a, "a").join(sliced(b, "b"), ["slice", "key"])
    differ = F.zip_with("w_a", "w_b", lambda x, y: x.bitwiseXOR(y))
    rows = both.select("a_id", "b_id", "n_a", "n_b", "slice", hamming(F.col("w_a"), F.col("w_b")).alias("distance"), differ.alias("x")).where(F.col("distance") <= radius)
    agrees = [F.when(sum((F.when(word(F.col("x"), w, m) != 0, 1).otherwise(0) for w, m in own), F.lit(0)) == 0, F.lit(i)) for i, own in enumerate(masks)]
    return rows.where(F.coalesce(*agrees) == F.col("slice")).select("a_id", "b_id", "n_a", "n_b", F.col("distance").cast("int").alias("distance"))


def match_counts(vectors: DataFrame, radius: int, bits: int) -> DataFrame:
    """(vec_id, n): for every row, how many other rows differ from it in at most radius bits, by match_codes() of the table
    with itself. Pairs are made of classes alone, copies are counted."""
    codes = code_classes(vectors)
    found = match_codes(codes, codes, radius, bits).groupBy(F.col("a_id").alias("code_id")).agg((F.sum("n_b") - 1).alias("others"))
    return vectors.join(codes.join(found, "code_id").select("words", "others"), "words").select("vec_id", F.col("others").alias("n"))


def build_graph(vectors: DataFrame, bits: int, m: int = 16, **how) -> DataFrame:
    """A layered graph over bits."""
    return graph.build(signs(vectors, bits), m, **how)


def graph_search(built: DataFrame, queries: DataFrame, bits: int, k: int, ef: int = 64) -> DataFrame:
    found = graph.merged(graph.search(built, signs(queries, bits, "qw", "q"), k, ef), k)
    return found.withColumn("distance", from_float(F.col("distance")))
