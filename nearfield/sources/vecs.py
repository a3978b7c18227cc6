"""Vector files: records of an int32 dimension and its components (fvecs, ivecs, bvecs), and fbin with one header.

They are a data source of their own, named "vectors": tasks read ranges of bytes and write their own files, none of which
passes through the driver. Any file system that Arrow opens by a URI will do (file, hdfs, s3, gs).
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

# Component types of the formats.
KINDS = {"fvecs": ("<f4", "float"), "ivecs": ("<i4", "int"), "bvecs": ("u1", "int"), "fbin": ("<f4", "float")}

#: Bytes of a task's range, of a read, and of an fbin file, whose count stands before its rows.
RANGE, READ, FBIN = 128 << 20, 4 << 20, 64 << 20


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """A path's file system and its name there; file:/x, as Hadoop writes it, is a URI as well."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


@dataclass
class Range(InputPartition):
    """Rows [first, first + n) of a table, which lie in a file from a byte on."""

    path: str
    at: int
    n: int
    first: int

    def __init__(self, path: str, at: int, n: int, first: int) -> None:
        super().__init__(None)
        self.path, self.at, self.n, self.first = path, at, n, first


class VectorFiles(DataSource):
    """Options: kind (fvecs, ivecs, bvecs, fbin), path (a file or a folder), and range, the bytes a task reads."""

    @classmethod
    def name(cls) -> str:
        return "vectors"

    def schema(self) -> str:
        return f"vec_id long, embedding array<{KINDS[self.options['kind']][1]}>"

    def reader(self, schema) -> VectorReader:
        return VectorReader(self.options)

    def writer(self, schema, overwrite: bool) -> VectorWriter:
        return VectorWriter(self.options, overwrite)


class VectorReader(DataSourceReader):
    """vec_id is a row's place over all files in the order of their names; sizes give it, so no job counts rows."""

    def __init__(self, options) -> None:
        self.kind, self.path, self.range = options["kind"], options["path"], int(options.get("range", RANGE))
        self.d = int(options["d"]) if "d" in options else None

    def _files(self) -> list[tuple[str, int]]:
        files, at = _opened(self.path)
        info = files.get_file_info(at)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if info.type == fs.FileType.File:
            return [(at, info.size)]
        inside = files.get_file_info(fs.FileSelector(at))
        return sorted((f.path, f.size) for f in inside if f.type == fs.FileType.File and f.size and not f.base_name.startswith(("_", ".")))

    def partitions(self) -> list[Range]:
        files, _ = _opened(self.path)
        item, head = np.dtype(KINDS[self.kind][0]).itemsize, 8 if self.kind == "fbin" else 0
        out, first, d = [], 0, self.d
        for name, size in self._files():
            with files.open_input_file(name) as f:
                n, own = struct.unpack("<ii", f.read(8)) if head else (None, struct.unpack("<i", f.read(4))[0])
            d = own if d is None else d
            if own != d:
                raise ValueError(f"{name} has {own} dimensions, not {d}")
            record = d * item + (0 if head else 4)
            rows, rest = divmod(size - head, record)
            if rest or (head and rows != n):
                raise ValueError(f"{name} ends within a record, or its header's count is another")
            step = max(1, self.range // record)
            out += [Range(name, head + i * record, min(step, rows - i), first + i) for i in range(0, rows, step)]
            first += rows
        self.d = d
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part is None or getattr(part, "path", None) is None:  # an empty folder
            return
        files, _ = _opened(self.path)
        dtype = np.dtype(KINDS[self.kind][0])
        with files.open_input_file(part.path) as f:
            if self.kind == "fbin":
                d, head = struct.unpack("<ii", f.read(8))[1], 0
            else:
                d, head = struct.unpack("<i", f.read(4))[0], 4
            record = head + d * dtype.itemsize
            f.seek(part.at)
            step = max(1, READ // record)
            for i in range(0, part.n, step):
                n = min(step, part.n - i)
                raw = np.frombuffer(f.read(n * record), dtype=np.uint8).reshape(n, record)
                if head and (raw[:, :4].copy().view("<i4") != d).any():
                    raise ValueError(f"a record's dimension isn't {d} in {part.path}")
                x = np.ascontiguousarray(raw[:, head:]).view(dtype)
                x = x.astype(np.int32) if self.kind == "bvecs" else x
                at = pa.array(np.arange(0, (n + 1) * d, d, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(part.first + i, part.first + i + n)), pa.ListArray.from_arrays(at, pa.array(x.ravel()))], ["vec_id", "embedding"])


@dataclass
class Written(WriterCommitMessage):
    """Files that a task's attempt left in the temporary folder, with their final names."""

    files: list[tuple[str, str]]


class VectorWriter(DataSourceArrowWriter):
    """A task writes files of its own in a temporary folder, a batch at a time; they get their names when all tasks have
    ended, so a lost or repeated attempt leaves nothing behind. Files follow the order of partitions. A folder takes one
    write at a time, and one that is overwritten has none of its rows while the files get their names."""

    def __init__(self, options, overwrite: bool) -> None:
        self.kind, self.path, self.overwrite = options["kind"], options["path"], overwrite
        self.d = int(options["d"]) if "d" in options else None
        self.token = uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        files, root = _opened(self.path)
        context = TaskContext.get()
        folder = f"{root}/_temporary-{self.token}/{context.taskAttemptId()}"
        files.create_dir(folder, recursive=True)
        dtype, d = np.dtype(KINDS[self.kind][0]), self.d
        names: list[tuple[str, str]] = []

        def name() -> str:
            names.append((f"{folder}/{len(names)}", f"part-{context.partitionId():06d}-{len(names):06d}.{self.kind}"))
            return names[-1][0]

        def fbin(held: list[np.ndarray]) -> None:
            with files.open_output_stream(name()) as out:
                out.write(struct.pack("<ii", sum(map(len, held)), d))
                for x in held:
                    out.write(x.tobytes())

        out, held, size = None, [], 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            col = batch.column(batch.schema.get_field_index("embedding"))
            lengths = np.diff(col.offsets.to_numpy())
            if col.null_count:
                raise ValueError("a vector is null")
            d = int(lengths[0]) if d is None else d
            flat = col.flatten()
            if (lengths != d).any() or flat.null_count:
                raise ValueError(f"a vector hasn't {d} components")
            x = np.asarray(flat.to_numpy(zero_copy_only=False)).reshape(n, d)
            if dtype.kind != "f" and len(x) and d:
                top = np.iinfo(dtype)
                if (x != np.floor(x)).any() or x.min() < top.min or x.max() > top.max:
                    raise ValueError(f"a component is no whole number from {top.min} to {top.max}")
            x = np.ascontiguousarray(x.astype(dtype))
            if self.kind == "fbin":
                held.append(x)
                size += x.nbytes
                if size >= FBIN:
                    fbin(held)
                    held, size = [], 0
                continue
            if out is None:
                out = files.open_output_stream(name())
            raw = np.empty((n, 4 + d * dtype.itemsize), dtype=np.uint8)
            raw[:, :4] = np.frombuffer(struct.pack("<i", d), dtype=np.uint8)
            raw[:, 4:] = x.view(np.uint8).reshape(n, -1)
            out.write(raw.tobytes())
        if out is not None:
            out.close()
        if held:
            fbin(held)
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = _opened(self.path)
        if self.overwrite:
            old = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
            for f in old:
                if f.type == fs.FileType.File:
                    files.delete_file(f.path)
        # names of another write in the same folder begin with its own number, after those that are there
        run = 0 if self.overwrite else sum(f.base_name.startswith("_run-") for f in files.get_file_info(fs.FileSelector(root, allow_not_found=True)))
        files.create_dir(root, recursive=True)
        for m in messages:
            for was, name in m.files if m else []:
                files.move(was, f"{root}/{run:06d}-{name}")
        with files.open_output_stream(f"{root}/_run-{run:06d}") as out:
            out.write(b"")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        files, root = _opened(self.path)
        left = f"{root}/_temporary-{self.token}"
        if files.get_file_info(left).type != fs.FileType.NotFound:
            files.delete_dir(left)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VectorFiles)


def read_vecs(spark: SparkSession, path: str, d: int | None = None, kind: str = "fvecs", size: int = RANGE) -> DataFrame:
    """(vec_id, embedding) of a file or a folder: vec_id is the row's place over all files by name. A task reads at most
    `size` bytes of a file. d, if given, is what all files have to have; an empty folder is an empty table."""
    register(spark)
    how = spark.read.format("vectors").option("kind", kind).option("range", size)
    return (how.option("d", d) if d is not None else how).load(path)


def read_fbin(spark: SparkSession, path: str) -> DataFrame:
    return read_vecs(spark, path, kind="fbin")


def write_vecs(vectors: DataFrame, path: str, kind: str = "fvecs", mode: str = "overwrite") -> None:
    """The vectors in the order of their ids (and of the vectors, where ids repeat), each task's range in files of its own.
    Null vectors, unequal lengths, and components that the kind can't hold are errors: nothing is written then. With mode
    append the rows stand behind those that are there."""
    register(vectors.sparkSession)
    rows = vectors.select("vec_id", "embedding").repartitionByRange("vec_id").sortWithinPartitions("vec_id", "embedding")
    rows.write.format("vectors").option("kind", kind).mode(mode).save(path)


def convert(spark: SparkSession, path: str, kind: str, to: str, to_kind: str) -> None:
    """Files of one kind as files of another, rows in the same order."""
    write_vecs(read_vecs(spark, path, kind=kind), to, to_kind)


def write_truth(found: DataFrame, path: str, k: int) -> None:
    """Each query's k results (query_id, rank, vec_id) by rank as ivecs, queries by id; fewer results are filled with -1,
    as the format has one length. Ids have to be whole numbers of 32 bits."""
    own = found.where(F.col("rank") <= k).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id"))).alias("r"))
    ids = F.concat(F.transform("r", lambda x: x["vec_id"].cast("long")), F.array_repeat(F.lit(-1).cast("long"), k))
    write_vecs(own.select(F.col("query_id").alias("vec_id"), F.slice(ids, 1, k).alias("embedding")), path, "ivecs")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, rank, vec_id) as write_truth() wrote it; query_id is the query's place."""
    rows = read_vecs(spark, path, kind="ivecs").select(F.col("vec_id").alias("query_id"), F.posexplode("embedding").alias("pos", "id"))
    return rows.where("id >= 0").select("query_id", (F.col("pos") + 1).alias("rank"), F.col("id").cast("long").alias("vec_id"))


def synthetic(spark: SparkSession, n: int, d: int, seed: int = 1338, inner: int = 10) -> DataFrame:
    """Vectors of few inner dimensions, mapped linearly and bent by a sine."""
    m = np.random.default_rng(seed).uniform(-1, 1, (inner, d)) * np.linspace(1, 4, d)
    x = [F.randn(seed + i) for i in range(inner)]
    base = spark.range(n).select(F.col("id").alias("vec_id"), *[c.alias(f"z{i}") for i, c in enumerate(x)])
    return base.select("vec_id", F.array(*[F.sin(sum(F.col(f"z{i}") * float(m[i, j]) for i in range(inner))).cast("float") for j in range(d)]).alias("embedding"))


def noisy_queries(queries: DataFrame, percent: float, seed: int = 7) -> DataFrame:
    """Queries with normal noise of percent / 100 of their norm; the noise is drawn from a hash of id and place."""
    unit = lambda salt: lambda i: (F.pmod(F.xxhash64("query_id", i, F.lit(seed), F.lit(salt)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    normal = lambda i: F.sqrt(-2 * F.ln(unit(1)(i))) * F.cos(2 * np.pi * unit(2)(i))
    norm = F.sqrt(F.aggregate("q", F.lit(0.0), lambda a, v: a + v.cast("double") * v))
    return queries.withColumn("q", F.transform("q", lambda v, i: (v + normal(i) * norm * percent / 100).cast("float")))
