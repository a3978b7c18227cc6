"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The class [\x20\x09-\x0D] as Java and DuckDB patterns; bytes.split() and bytes.strip() use the same six bytes.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder that spark.checkpoint.dir names. Only on one machine, as in tests, a folder of
    its own is set where it is unset; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        root = "/tmp/nearfield-shared"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table of the shared folder that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, what: str, **options: str) -> DataFrame:
    """df written to the shared folder and read back: cuts lineage, survives lost executors, gives true sizes."""
    path = scratch(df.sparkSession, what)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(doc_id: object, n: int) -> int:
    """crc32 of the id's decimal text, modulo n; a null id counts as empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % n


def fold_column(doc_id: Column, n: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def byte_batches(texts: list[bytes], limit: int) -> Iterator[tuple[int, int]]:
    """Index ranges of about `limit` bytes each; a longer text is a range of its own."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def pieces(batches: Iterator, text: int, limit: int = 2 << 20) -> Iterator:
    """The batches in slices of about `limit` bytes of the text column each; a longer text is a slice of its own. What a
    task makes of texts at a time so has a bound in bytes, not in rows."""
    import pyarrow.compute as pc

    for batch in batches:
        if batch.get_total_buffer_size() <= limit:
            yield batch
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)
    trim()


def trim() -> None:
    """Gives what a worker has freed back to the system: workers live on from stage to stage, so one stage's caches would
    stay beside the next one's."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:
        pass  # not glibc


def texts_of(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null is empty."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]
