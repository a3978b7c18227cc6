"""Saving and loading of every kind of index: tables as Parquet, the rest in a manifest that is written last."""

from __future__ import annotations

from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from nearfield.operators import binary, coarse, ivf, polysemous, quantize, spectral, transforms, two_level
from nearfield.operators.manifest import read_manifest, remove, write_manifest
from nearfield.plans import factory

#: For each class the fields that are saved; tables among them go to Parquet.
FIELDS: dict[type, tuple[str, ...]] = {
    ivf.IVF: ("nlist", "metric", "codec", "by_residual", "centroids", "lists"),
    coarse.AdditiveIVF: ("nlist", "metric", "codec", "by_residual", "centroids", "lists", "books", "beam"),
    ivf.RefinedIVF: ("base", "codec", "k_factor", "rest"),
    ivf.DedupIVF: ("base",),
    binary.BinaryIVF: ("bits", "index"),
    spectral.SpectralIVF: ("nlist", "bits", "period", "threshold", "index"),
    coarse.MultiIndex: ("books", "codec", "lists"),
    two_level.TwoLevel: ("k1", "k2", "niter", "seed", "coarse", "fine", "stats"),
    transforms.Linear: ("a", "b"),
    transforms.Chain: ("steps",),
    factory.Index: ("text", "metric", "chain", "inner", "raw", "hash"),
    binary.BitWords: ("bits",),
    polysemous.Polysemous: ("pq", "most"),
    spectral.SpectralBits: ("projection", "period", "thresholds"),
    **{c: tuple(c.__dataclass_fields__) for c in (quantize.ScalarQuantizer, quantize.ProductQuantizer, quantize.ResidualQuantizer, quantize.LocalSearchQuantizer, quantize.ProductAdditive, quantize.SignHash)},
}
_BY_NAME = {c.__name__: c for c in FIELDS}
#: A table is laid out by the column that searches prune it by.
_LAID_BY = ("list_no", "shard")


def _plain(value: Any, place: str, tables: dict[str, DataFrame]) -> Any:
    if isinstance(value, DataFrame):
        tables[place] = value
        return {"table": place, "columns": value.columns}
    if isinstance(value, np.ndarray):
        return {"array": value.tolist(), "type": str(value.dtype)}
    if isinstance(value, np.generic):
        return value.item()
    if isinstance(value, (list, tuple)):
        return [_plain(v, f"{place}-{i}", tables) for i, v in enumerate(value)]
    if type(value) in FIELDS:
        return {"class": type(value).__name__, "fields": {n: _plain(getattr(value, n, None), f"{place}-{n}", tables) for n in FIELDS[type(value)]}}
    if value is transforms.normalization:
        return {"step": "normalization"}
    if isinstance(value, dict):
        return {"dict": {k: _plain(v, f"{place}-{k}", tables) for k, v in value.items()}}
    if value is None or isinstance(value, (str, int, float, bool)):
        return value
    raise TypeError(f"no way to save a {type(value).__name__} at {place}")


def _back(spark: SparkSession, value: Any, path: str) -> Any:
    if isinstance(value, list):
        return [_back(spark, v, path) for v in value]
    if not isinstance(value, dict):
        return value
    if "table" in value:
        return spark.read.parquet(f"{path}/{value['table']}").select(*value["columns"])
    if "array" in value:
        return np.array(value["array"], dtype=value["type"])
    if "step" in value:
        return transforms.normalization
    if "dict" in value:
        return {k: _back(spark, v, path) for k, v in value["dict"].items()}
    made = _BY_NAME[value["class"]]
    fields = {n: _back(spark, v, path) for n, v in value["fields"].items()}
    if made is factory.Index:
        out = factory.Index(fields.pop("text"), fields.pop("metric"))
    else:
        out = made.__new__(made)
    for n, v in fields.items():
        setattr(out, n, v)
    return out


def save(spark: SparkSession, index: Any, path: str) -> None:
    """Any index, transform, codec or graph (a DataFrame) of this library. What was at path is deleted first, unless it is
    among the tables to be saved. Lists are partitioned by list_no and graphs by shard, so a search reads what it probes."""
    tables: dict[str, DataFrame] = {}
    about = _plain(index, "index", tables)
    root = path.split(":", 1)[-1].rstrip("/")
    for t in tables.values():
        if any(f"{root}/" in f for f in t.inputFiles()):
            raise ValueError(f"a table of the index is read from {path}; save it elsewhere")
    remove(spark, path)
    for name, t in tables.items():
        by = [c for c in _LAID_BY if c in t.columns]
        t.write.partitionBy(*by).parquet(f"{path}/{name}")
    write_manifest(spark, path, {"index": about})


def load(spark: SparkSession, path: str) -> Any:
    about = read_manifest(spark, path)
    if about is None:
        raise FileNotFoundError(f"{path} has no whole index")
    return _back(spark, about["index"], path)
