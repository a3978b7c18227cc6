"""Manifests beside outputs: what an output was made from, so that only what is whole and up to date is kept."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAME = "_manifest.json"


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    """The manifest of an output, None if it has none, by whatever file system the path names."""
    at, fs = _path(spark, f"{path}/{NAME}")
    if not fs.exists(at):
        return None
    source = fs.open(at)
    try:
        return json.loads(bytes(source.readAllBytes()).decode())
    finally:
        source.close()


def write_manifest(spark: SparkSession, path: str, about: dict) -> None:
    """Written last and in one piece: an output without it isn't whole."""
    at, fs = _path(spark, f"{path}/{NAME}")
    sink = fs.create(at, True)
    try:
        sink.write(bytearray(json.dumps(about, sort_keys=True).encode()))
    finally:
        sink.close()


def remove(spark: SparkSession, path: str) -> None:
    at, fs = _path(spark, path)
    fs.delete(at, True)


def digest(*parts: object) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


def table_version(df: DataFrame) -> str:
    """A version of a table that follows its rows alone, in any order: their number and two sums of hashes. One pass."""
    h = [F.xxhash64(F.lit(s), *[F.col(f"`{c}`") for c in df.columns]) for s in (1, 2)]
    n, a, b = df.agg(F.count("*"), *[F.sum(F.pmod(x, F.lit(1 << 40)).cast("decimal(38,0)")) for x in h]).first()
    return digest(n, str(a), str(b), df.schema.simpleString())


@dataclass
class Stage:
    """make(outputs of `after` by name) -> DataFrame, or None where rows aren't the result. settings are all that make
    depends on besides its inputs; a changed setting makes the stage and those after it stale."""

    name: str
    make: Callable[[dict[str, DataFrame]], DataFrame]
    after: tuple[str, ...] = ()
    settings: dict = field(default_factory=dict)


def run_stages(spark: SparkSession, path: str, inputs: dict[str, DataFrame], stages: list[Stage], log: list[tuple[str, str]] | None = None) -> dict[str, DataFrame]:
    """Runs stages whose outputs are tables below path and returns inputs and outputs by name.

    A stage's version is made from its name, its settings and the versions of what it comes after; inputs have the
    versions of their rows. An output whose manifest has the same version is kept and read; a stale one, or one without a
    manifest (its run was broken off), is deleted and made again, and so is what comes after it, as versions differ.
    Stages come in an order in which each follows what it needs. log gets (name, "kept" or "made").
    """
    known = dict(inputs)
    versions = {name: table_version(df) for name, df in inputs.items()}
    for s in stages:
        if s.name in known:
            raise ValueError(f"two tables are named {s.name}")
        version = digest(s.name, s.settings, [versions[a] for a in s.after])
        at = f"{path}/{s.name}"
        about = read_manifest(spark, at)
        kept = about is not None and about["version"] == version
        if not kept:
            remove(spark, at)
            s.make({a: known[a] for a in s.after}).write.parquet(f"{at}/rows")
            write_manifest(spark, at, {"stage": s.name, "version": version, "after": {a: versions[a] for a in s.after}, "settings": s.settings})
        if log is not None:
            log.append((s.name, "kept" if kept else "made"))
        known[s.name], versions[s.name] = spark.read.parquet(f"{at}/rows"), version
    return known
