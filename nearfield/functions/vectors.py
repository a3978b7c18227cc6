"""Vector functions as Spark columns. Sums run in DOUBLE over index order, so that results don't depend on the engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def doubles(x: Column) -> Column:
    return x.cast("array<double>")


def _zip(x: Column, y: Column, f: Callable) -> Column:
    return F.zip_with(doubles(x), doubles(y), f)


def l2(x: Column, y: Column) -> Column:
    """Squared, without a root."""
    return _sum(_zip(x, y, lambda a, b: (a - b) * (a - b)))


def inner_product(x: Column, y: Column) -> Column:
    return _sum(_zip(x, y, lambda a, b: a * b))


def l1(x: Column, y: Column) -> Column:
    return _sum(_zip(x, y, lambda a, b: F.abs(a - b)))


def linf(x: Column, y: Column) -> Column:
    return F.array_max(_zip(x, y, lambda a, b: F.abs(a - b)))


def lp(p: float) -> Callable[[Column, Column], Column]:
    """The sum of p-th powers, without a root."""
    return lambda x, y: _sum(_zip(x, y, lambda a, b: F.pow(F.abs(a - b), F.lit(float(p)))))


def canberra(x: Column, y: Column) -> Column:
    """NaN where two components are both 0."""
    return _sum(_zip(x, y, lambda a, b: F.when((F.abs(a) + F.abs(b)) == 0, F.lit(float("nan"))).otherwise(F.abs(a - b) / F.nullif(F.abs(a) + F.abs(b), F.lit(0.0)))))


def bray_curtis(x: Column, y: Column) -> Column:
    return F.try_divide(_sum(_zip(x, y, lambda a, b: F.abs(a - b))), _sum(_zip(x, y, lambda a, b: F.abs(a + b))))


def jensen_shannon(x: Column, y: Column) -> Column:
    """Half the sum of both divergences from the midpoint; terms of 0 add nothing. For non-negative components."""

    def term(a: Column, b: Column) -> Column:
        m = (a + b) / 2
        return F.when(a > 0, a * F.ln(F.try_divide(a, m))).otherwise(0.0) + F.when(b > 0, b * F.ln(F.try_divide(b, m))).otherwise(0.0)

    return _sum(_zip(x, y, term)) / 2


def jaccard(x: Column, y: Column) -> Column:
    """Weighted: the sum of minima over the sum of maxima. Greater is nearer."""
    return F.try_divide(_sum(_zip(x, y, lambda a, b: F.least(a, b))), _sum(_zip(x, y, lambda a, b: F.greatest(a, b))))


def nan_euclidean(x: Column, y: Column) -> Column:
    """Squared differences where both are numbers, scaled up by the share that is; NaN if none is."""
    both = F.filter(_zip(x, y, lambda a, b: F.when(~F.isnan(a) & ~F.isnan(b), (a - b) * (a - b))), lambda v: v.isNotNull())
    return F.when(F.size(both) == 0, F.lit(float("nan"))).otherwise(F.size(x) / F.nullif(F.size(both), F.lit(0)) * _sum(both))


#: name -> (function, whether greater is nearer)
METRICS: dict[str, tuple[Callable[[Column, Column], Column], bool]] = {
    "l2": (l2, False), "ip": (inner_product, True), "l1": (l1, False), "linf": (linf, False), "canberra": (canberra, False), "bray_curtis": (bray_curtis, False),
    "jensen_shannon": (jensen_shannon, False), "jaccard": (jaccard, True), "nan_euclidean": (nan_euclidean, False),
}


def metric(name: str, arg: float = 2.0) -> tuple[Callable[[Column, Column], Column], bool]:
    return (lp(arg), False) if name == "lp" else METRICS[name]


def norm_sqr(x: Column) -> Column:
    return _sum(F.transform(doubles(x), lambda v: v * v))


def normalize(x: Column) -> Column:
    """Of unit L2 norm; a zero vector stays."""
    n = F.sqrt(norm_sqr(x))
    return F.when(n > 0, F.transform(doubles(x), lambda v: v / n)).otherwise(doubles(x))


def add(x: Column, y: Column) -> Column:
    return _zip(x, y, lambda a, b: a + b)


def subtract(x: Column, y: Column) -> Column:
    return _zip(x, y, lambda a, b: a - b)


def multiply_add(x: Column, factor: float, y: Column) -> Column:
    return _zip(x, y, lambda a, b: a + F.lit(factor) * b)


def argmin(x: Column) -> Column:
    """0-based place of the first least component."""
    return (F.array_position(x, F.array_min(x)) - 1).cast("int")


def l2_from_ip(ip: Column, norm_x: Column, norm_y: Column) -> Column:
    return norm_x + norm_y - 2 * ip


def mean_vector(x: Column, d: int) -> Column:
    """An aggregate: the mean of each component. Partial sums make it a row per task before the shuffle."""
    return F.array(*[F.avg(doubles(x)[i]) for i in range(d)])


def sign_bits(x: Column) -> Column:
    """1 where a component is at least 0."""
    return F.transform(x, lambda v: F.when(v >= 0, 1).otherwise(0))


def pack_bits(bits: Column, width: int = 32) -> Column:
    """Words of `width` bits as longs, the first bit lowest."""
    words = F.transform(F.sequence(F.lit(0), F.ceil(F.size(bits) / width).cast("int") - 1), lambda w: F.aggregate(F.slice(bits, w * width + 1, width), F.struct(F.lit(0).cast("long").alias("v"), F.lit(1).cast("long").alias("u")), lambda a, b: F.struct((a["v"] + b.cast("long") * a["u"]).alias("v"), (a["u"] * 2).alias("u")), lambda a: a["v"]))
    return F.when(F.size(bits) > 0, words).otherwise(F.array().cast("array<bigint>"))


def unpack_bits(words: Column, n: int, width: int = 32) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.expr("0") + F.call_function("shiftright", F.element_at(words, (F.floor(i / width) + 1).cast("int")), (i % width).cast("int")).bitwiseAND(F.lit(1).cast("long")).cast("int"))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of words."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, v: s + v)


def generalized_hamming(a: Column, b: Column) -> Column:
    """Differing components."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda v: v))


def distance_entropy(ds: Column, entry: Column, bins: int = 20) -> Column:
    """Entropy of distances over 20 bins of min(d / entry / 10, 1); 0 if the entry distance is about 0."""
    at = F.transform(ds, lambda d: F.least(F.lit(bins - 1), F.floor(F.least(F.lit(1.0), F.try_divide(d, entry) / 10) * bins).cast("int")))
    n = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.size(F.filter(at, lambda x: x == b)) / F.nullif(F.size(at), F.lit(0)))
    return F.when(entry < 1e-12, 0.0).otherwise(F.aggregate(n, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.ln(F.when(p > 0, p))).otherwise(0.0)))
