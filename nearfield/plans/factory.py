"""A factory string such as "PCA32,IVF16,PQ8x4,RFlat" as a plan of transforms, coarse lists, codec and refinement."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.operators import quantize, transforms
from nearfield.operators.graph import build, merged, slices, width
from nearfield.operators.graph import search as graph_search
from nearfield.operators.ivf import IVF, hash_search, probes
from nearfield.operators.search import knn, rerank
from nearfield.operators.shortlist import RANKED, refined


@dataclass
class Spec:
    transforms: list[tuple[str, int]] = field(default_factory=list)
    nlist: int = 0
    kind: str = "Flat"
    args: tuple = ()
    refine: bool = False
    id_map: bool = False


def parse(text: str) -> Spec:
    """Parts from left to right: ID map, transforms (PCA, PCAW, PCAR, RR, OPQ, ITQ, L2norm, Centering), IVF or none, then
    Flat, SQ, PQ, RQ, LSQ, LSH, HNSW or NSG, and RFlat or Refine(Flat) at the end."""
    s = Spec()
    for part in text.split(","):
        if part in ("IDMap", "IDMap2"):
            s.id_map = True
        elif part in ("RFlat", "Refine(Flat)"):
            s.refine = True
        elif m := re.fullmatch(r"(PCAWR|PCAW|PCAR|PCA|RR|OPQ|ITQ)(\d+)(?:_\d+)?", part):
            s.transforms.append((m[1], int(m[2])))
        elif part in ("L2norm", "Centering"):
            s.transforms.append((part, 0))
        elif m := re.fullmatch(r"IVF(\d+)(k?)", part):
            s.nlist = int(m[1]) * (1024 if m[2] else 1)
        elif part == "Flat":
            s.kind = "Flat"
        elif m := re.fullmatch(r"SQ(4|6|8|fp16|bf16)", part):
            s.kind, s.args = "SQ", (m[1] if m[1].startswith(("f", "b")) else f"{m[1]}bit",)
        elif m := re.fullmatch(r"PQ(\d+)(?:x(\d+))?(?:fs|fsr)?", part):
            s.kind, s.args = "PQ", (int(m[1]), int(m[2] or 8))
        elif m := re.fullmatch(r"(RQ|LSQ)(\d+)x(\d+)(?:fs)?", part):
            s.kind, s.args = m[1], (int(m[2]), int(m[3]))
        elif m := re.fullmatch(r"LSH(\d*)(r?)(t?)", part):
            s.kind, s.args = "LSH", (int(m[1] or 64), bool(m[2]), bool(m[3]))
        elif m := re.fullmatch(r"(HNSW|NSG)(\d*)(?:Flat)?", part):
            s.kind, s.args = m[1], (int(m[2] or 32),)
        else:
            raise ValueError(f"can't parse {part!r} of {text!r}")
    return s


def codec_of(s: Spec) -> quantize.Codec | None:
    if s.kind == "SQ":
        return quantize.ScalarQuantizer(*s.args)
    if s.kind == "PQ":
        return quantize.ProductQuantizer(*s.args)
    if s.kind == "RQ":
        return quantize.ResidualQuantizer(*s.args)
    if s.kind == "LSQ":
        return quantize.LocalSearchQuantizer(*s.args)
    return None


def code_size(text: str, d: int) -> int:
    """Bytes of a vector's code."""
    s = parse(text)
    for kind, n in s.transforms:
        d = n if kind.startswith(("PCA", "RR", "ITQ")) else d
    if s.kind == "SQ":
        return -(-d * {"8bit": 8, "6bit": 6, "4bit": 4}.get(s.args[0], 16) // 8)
    if s.kind in ("PQ", "RQ", "LSQ"):
        return -(-s.args[0] * s.args[1] // 8)
    return -(-s.args[0] // 8) if s.kind == "LSH" else 4 * d


class Index:
    """fit, add and search of a factory string's plan over DataFrames."""

    def __init__(self, text: str, metric: str = "l2") -> None:
        self.text, self.spec, self.metric = text, parse(text), metric
        self.chain = transforms.Chain()
        self.inner: IVF | DataFrame | None = None
        self.raw: DataFrame | None = None

    def _before(self, vectors: DataFrame) -> DataFrame:
        return self.chain.apply(vectors)

    def fit(self, vectors: DataFrame) -> Index:
        for kind, n in self.spec.transforms:
            x = self._before(vectors)
            d = x.selectExpr("size(embedding)").first()[0]
            step = {"RR": lambda n=n, d=d: transforms.random_rotation(d, n), "ITQ": lambda x=x, n=n: transforms.itq(x, n), "OPQ": lambda x=x, n=n: transforms.opq(x, n), "Centering": lambda x=x: transforms.centering(x), "L2norm": lambda: transforms.normalization}.get(kind)
            self.chain.steps.append(step() if step else transforms.pca(x, n, -0.5 if "W" in kind else 0.0, kind.endswith("R")))
        x = self._before(vectors)
        if self.spec.kind == "LSH":
            bits, rotate, train = self.spec.args
            self.hash = quantize.SignHash(bits).fit(x, rotate, train)
        elif self.spec.kind not in ("HNSW", "NSG"):
            self.inner = IVF(max(1, self.spec.nlist), self.metric, codec_of(self.spec), self.spec.nlist > 0 and self.spec.kind in ("PQ", "RQ", "LSQ")).fit(x)
        return self

    def add(self, vectors: DataFrame) -> Index:
        x = self._before(vectors.select("vec_id", "embedding"))
        self.raw = vectors if self.raw is None else self.raw.unionByName(vectors)
        if self.spec.kind in ("HNSW", "NSG"):
            self.inner = build(self._before(self.raw), self.spec.args[0], self.spec.kind.lower())
        elif isinstance(self.inner, IVF):
            self.inner.add(x)
        return self

    def search(self, queries: DataFrame, k: int, nprobe: int = 8, ef: int = 64, k_factor: int = 4) -> DataFrame:
        wide = k * k_factor if self.spec.refine else k
        q = self._before(queries.select("query_id", queries["q"].alias("embedding"))).withColumnRenamed("embedding", "q")
        if self.spec.refine and wide > RANKED and self.metric == "l2" and self.spec.kind not in ("HNSW", "NSG"):
            return self._refined(queries, q, k, wide, nprobe)
        if self.spec.kind in ("HNSW", "NSG"):
            graph = self.inner.persist()
            out = merged(graph_search(graph, q, wide, width(max(ef, wide), self.raw.count()), slices=slices(graph)), wide)
        elif self.spec.kind == "LSH":
            out = hash_search(q, self._before(self.raw.select("vec_id", "embedding")), self.hash, wide)
        elif not self.spec.nlist and self.spec.kind == "Flat":
            out = knn(q, self.inner.lists, wide, self.metric)
        else:
            out = self.inner.search(q, wide, nprobe if self.spec.nlist else 1)
        return rerank(out, queries, self.raw, k, self.metric) if self.spec.refine else out

    def _refined(self, queries: DataFrame, q: DataFrame, k: int, wide: int, nprobe: int) -> DataFrame:
        """search() with a shortlist too long to be ranked."""
        if self.spec.kind != "LSH":
            lists, codec = self.inner.lists, self.inner.codec
            probed = probes(q, self.inner.centroids, nprobe if self.spec.nlist else 1)
            return refined(lists, probed, queries, self.raw, k, wide, codec, self.inner.centroids if self.inner.by_residual else None)
        # the squared distance of codes of 0 and 1 is Hamming's
        codes = self.hash.encode_table(self._before(self.raw.select("vec_id", "embedding")))
        asked = self.hash.encode_table(q.select("query_id", F.col("q").alias("embedding")))
        one = F.lit(0).alias("list_no")
        return refined(codes.select(one, "vec_id", F.col("code").alias("embedding")), asked.select("query_id", F.col("code").alias("q"), one), queries, self.raw, k, wide)
