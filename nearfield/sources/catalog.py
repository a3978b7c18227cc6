"""Named data sets in a folder: base vectors, queries and exact truth as vector files, with a description."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.operators import search
from nearfield.sources import vecs


@dataclass
class Dataset:
    """base (vec_id, embedding), queries (query_id, q), truth (query_id, rank, vec_id); ids are places in the files."""

    name: str
    kind: str
    metric: str
    d: int
    k: int
    n: int
    base: DataFrame
    queries: DataFrame
    truth: DataFrame

    def about(self) -> dict:
        return {"kind": self.kind, "metric": self.metric, "d": self.d, "k": self.k, "n": self.n}

    def batches(self, size: int) -> Iterator[tuple[int, DataFrame]]:
        """(first id, rows) of ranges of `size` ids, for work that goes on range by range."""
        for i in range(0, self.n, size):
            yield i, self.base.where((F.col("vec_id") >= i) & (F.col("vec_id") < i + size))

    def rows(self, ids: list[int]) -> DataFrame:
        """The rows of a short list of ids."""
        return self.base.where(F.col("vec_id").isin(ids))


def _places(rows: DataFrame) -> DataFrame:
    return rows.withColumnsRenamed({"vec_id": "query_id", "embedding": "q"})


def make(spark: SparkSession, root: str, name: str, base: DataFrame, queries: DataFrame, k: int, metric: str = "l2", kind: str = "fvecs") -> Dataset:
    """Writes base and queries (vec_id, embedding) in the order of their ids, reads them back and writes the k exact
    neighbours of each query. The description comes last: a set without one isn't there. Empty tables make an empty set."""
    at = f"{root}/{name}"
    vecs.write_vecs(base, f"{at}/base", kind)
    vecs.write_vecs(queries, f"{at}/queries", kind)
    b, q = (vecs.read_vecs(spark, f"{at}/{x}", kind=kind) for x in ("base", "queries"))
    vecs.write_truth(search.knn(_places(q), b, k, metric), f"{at}/truth", k)
    n, d = b.agg(F.count("*"), F.max(F.size("embedding"))).first()
    about = {"kind": kind, "metric": metric, "d": d or 0, "k": k, "n": n}
    files, path = vecs._opened(at)
    with files.open_output_stream(f"{path}/about.json") as out:
        out.write(json.dumps(about).encode())
    return load(spark, root, name)


def load(spark: SparkSession, root: str, name: str) -> Dataset:
    if name not in names(spark, root):
        raise ValueError(f"no data set {name!r} in {root}")
    at = f"{root}/{name}"
    files, path = vecs._opened(at)
    with files.open_input_stream(f"{path}/about.json") as f:
        about = json.loads(f.read())
    b, q = (vecs.read_vecs(spark, f"{at}/{x}", kind=about["kind"]) for x in ("base", "queries"))
    return Dataset(name, base=b, queries=_places(q), truth=vecs.read_truth(spark, f"{at}/truth"), **about)


def names(spark: SparkSession, root: str) -> list[str]:
    """The data sets of a folder that are whole."""
    files, path = vecs._opened(root)
    inside = files.get_file_info(fs.FileSelector(path, allow_not_found=True))
    there = [f.base_name for f in inside if f.type == fs.FileType.Directory]
    return sorted(x for x in there if files.get_file_info(f"{path}/{x}/about.json").type == fs.FileType.File)


def first_rows(spark: SparkSession, root: str, name: str, n: int, new: str) -> Dataset:
    """A data set's first n rows as a set of its own, with all queries and their exact neighbours among those rows."""
    whole = load(spark, root, name)
    queries = whole.queries.withColumnsRenamed({"query_id": "vec_id", "q": "embedding"})
    return make(spark, root, new, whole.base.where(F.col("vec_id") < n), queries, whole.k, whole.metric, whole.kind)
