"""Binary matrix files (``.fbin``, ``.ibin``) as Spark data sources, and binary record files.

A matrix file is int32 rows, int32 columns, then the values row by row, little-endian: float32 in ``.fbin``, int32 in
``.ibin``. Every task seeks to its own row range; nothing is read on the driver but the header. All files are opened
through Arrow's file systems, so a path may lie on any store that all executors reach.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

KINDS = {"fbin": (np.dtype("<f4"), "float"), "ibin": (np.dtype("<i4"), "int")}
ROWS_PER_TASK = 100_000
#: Bytes of a record file that a task holds before it starts the next part.
PART_BYTES = 32 << 20


def opened(path: str):
    """(file system, path in it) of a path or URI."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class RowRange(InputPartition):
    def __init__(self, path: str, first: int, count: int, columns: int):
        self.path, self.first, self.count, self.columns = path, first, count, columns


class MatrixReader(DataSourceReader):
    def __init__(self, kind: str, options: dict):
        self.kind, self.options = kind, options

    def partitions(self) -> list[RowRange]:
        path = self.options["path"]
        store, name = opened(path)
        with store.open_input_file(name) as f:
            rows, columns = struct.unpack("<ii", f.read(8))
        first = int(self.options.get("start", 0))
        last = min(rows, first + int(self.options["count"])) if "count" in self.options else rows
        step = int(self.options.get("rowspertask", ROWS_PER_TASK))
        return [RowRange(path, at, min(step, last - at), columns) for at in range(first, last, step)] or [RowRange(path, 0, 0, columns)]

    def read(self, part: RowRange) -> Iterator[pa.RecordBatch]:
        dtype, _ = KINDS[self.kind]
        store, name = opened(part.path)
        with store.open_input_file(name) as f:
            f.seek(8 + part.first * part.columns * dtype.itemsize)
            for at in range(part.first, part.first + part.count, 10_000):
                n = min(10_000, part.first + part.count - at)
                values = np.frombuffer(f.read(n * part.columns * dtype.itemsize), dtype)
                if len(values) < n * part.columns:
                    raise ValueError(f"{part.path} ends before row {at + n}")
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * part.columns, pa.int32()), pa.array(values))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + n)), lists], names=["row_idx", "vector"])


class Written(WriterCommitMessage):
    def __init__(self, path: str, first: int, rows: int, columns: int):
        self.path, self.first, self.rows, self.columns = path, first, rows, columns


class MatrixWriter(DataSourceWriter):
    """Writes rows (row_idx, vector): each task a piece beside the file, joined in the order of the pieces' first rows at commit."""

    def __init__(self, kind: str, options: dict):
        self.kind, self.path = kind, options["path"]

    def write(self, rows) -> Written:
        import uuid

        piece, n, columns, first = f"{self.path}.piece-{uuid.uuid4().hex}", 0, 0, -1
        store, name = opened(piece)
        with store.open_output_stream(name) as f:
            for row in rows:
                values = np.asarray(row["vector"], KINDS[self.kind][0])
                if n and len(values) != columns:
                    raise ValueError("all vectors of a matrix file have the same length")
                first, columns, n = row["row_idx"] if not n else first, len(values), n + 1
                f.write(values.tobytes())
        return Written(piece, first, n, columns)

    def commit(self, messages: list[Written | None]) -> None:
        done = sorted((m for m in messages if m), key=lambda m: m.first)
        columns = max((m.columns for m in done), default=0)
        if any(m.rows and m.columns != columns for m in done):
            raise ValueError("all vectors of a matrix file have the same length")
        store, name = opened(self.path)
        with store.open_output_stream(name) as out:
            out.write(struct.pack("<ii", sum(m.rows for m in done), columns))
            for m in done:
                with store.open_input_stream(opened(m.path)[1]) as f:
                    while chunk := f.read(1 << 22):
                        out.write(chunk)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m:
                store, name = opened(m.path)
                store.delete_file(name)


class FloatMatrixSource(DataSource):
    KIND = "fbin"

    @classmethod
    def name(cls) -> str:
        return cls.KIND

    def schema(self) -> str:
        return f"row_idx bigint, vector array<{KINDS[self.KIND][1]}>"

    def reader(self, schema) -> MatrixReader:
        return MatrixReader(self.KIND, {k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> MatrixWriter:
        return MatrixWriter(self.KIND, {k.lower(): v for k, v in self.options.items()})


class IntMatrixSource(FloatMatrixSource):
    KIND = "ibin"


def register(spark: SparkSession) -> None:
    """Make ``spark.read.format('fbin')`` and ``'ibin'`` known, with the options path, start, count, rowsPerTask."""
    spark.dataSource.register(FloatMatrixSource)
    spark.dataSource.register(IntMatrixSource)


def write_matrix(df: DataFrame, path: str, kind: str = "fbin") -> None:
    """Write (row_idx, vector) in the order of row_idx."""
    ordered = df.select("row_idx", "vector").repartitionByRange("row_idx").sortWithinPartitions("row_idx")
    register(df.sparkSession)
    ordered.write.format(kind).mode("append").save(path)


#: Record files: numbers of the header, whether a record has a key, a length, values. All numbers are uint32, ids int32, values float32.
#: ``postings``: an index, header (keys, documents); ``weights``: sparse queries or fetched postings; ``lists``: token ids or judged
#: documents; ``groups``: judged documents without their number.
LAYOUTS = {"postings": (2, True, False, True), "weights": (1, False, True, True), "lists": (1, True, True, False), "groups": (1, True, False, False)}


def write_records(df: DataFrame, folder: str, layout: str, n_docs: int = 0) -> int:
    """Write (key, ids array, values array) in the order of the keys as record files, one part or more per task; the number of parts.

    A part's name tells its place, and writing it again gives the same file, so a repeated task does no harm. Layouts without
    keys leave them out; null values stand for weight 1.
    """
    headers, keyed, sized, valued = LAYOUTS[layout]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = 0, [], 0

        def flush() -> pa.RecordBatch:
            name = f"{folder}/part-{TaskContext.get().partitionId():06d}-{number:06d}.bin"
            store, inner = opened(name)
            store.create_dir(opened(folder)[1], recursive=True)
            with store.open_output_stream(inner) as f:
                f.write(struct.pack("<II", len(held), n_docs)[: 4 * headers])
                f.write(b"".join(held))
            return pa.RecordBatch.from_arrays([pa.array([name])], names=["part"])

        for batch in batches:
            for key, ids, values in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                raw = np.asarray(ids, "<i4").tobytes()
                record = struct.pack("<I", key) if keyed else b""
                record += struct.pack("<I", len(ids)) if sized else b""
                record += struct.pack("<I", len(raw)) + raw
                if valued:
                    weights = np.asarray([1.0] * len(ids) if values is None else values, "<f4").tobytes()
                    record += struct.pack("<I", len(weights)) + weights
                held.append(record)
                size += len(record)
                if size >= PART_BYTES:
                    yield flush()
                    number, held, size = number + 1, [], 0
        if held:
            yield flush()

    columns = df.select(F.col("key").cast("long").alias("key"), F.col("ids").cast("array<int>").alias("ids"), (F.col("values") if "values" in df.columns else F.lit(None)).cast("array<float>").alias("values"))
    return columns.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(run, "part string").count()


def _records(path: str, layout: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray | None]]:
    headers, keyed, sized, valued = LAYOUTS[layout]
    store, name = opened(path)
    with store.open_input_stream(name, buffer_size=1 << 20) as f:
        (count, *_) = struct.unpack(f"<{headers}I", f.read(4 * headers))
        for at in range(count):
            key = struct.unpack("<I", f.read(4))[0] if keyed else at
            if sized:
                f.read(4)
            ids = np.frombuffer(f.read(struct.unpack("<I", f.read(4))[0]), "<i4")
            yield at, key, ids, np.frombuffer(f.read(struct.unpack("<I", f.read(4))[0]), "<f4") if valued else None


def read_records(spark: SparkSession, path: str, layout: str) -> DataFrame:
    """(part, place, key, ids array<int>, values array<float>) of a record file or of a folder of them, one task per file.

    ``place`` is the record's ordinal in its part; where the layout has no keys it is the key too, and values are null where it has none.
    """
    from pyarrow import fs

    store, name = opened(path)
    info = store.get_file_info(name)
    prefix = path[: len(path) - len(name)] if path.endswith(name) and "://" in path else ""
    parts = sorted(prefix + x.path for x in store.get_file_info(fs.FileSelector(name)) if x.is_file) if info.type == fs.FileType.Directory else [path]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "place", "key", "ids", "values"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.float32())]
        for batch in batches:
            for part in batch.column(0).to_pylist():
                rows: list[tuple] = []
                for record in _records(part, layout):
                    rows.append((part, *record))
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    files = spark.createDataFrame([(p,) for p in parts], "path string").repartition(max(1, len(parts)))
    return files.mapInArrow(run, "part string, place bigint, key bigint, ids array<int>, values array<float>")


def write_postings(packed: DataFrame, folder: str, n_docs: int) -> int:
    """Write packed postings (term_id, postings) as index files; a term's chunks follow each other, sorted by document."""
    rows = packed.select(F.col("term_id").alias("key"), F.transform("postings", lambda p: p["doc_id"]).alias("ids"), F.transform("postings", lambda p: p["weight"]).alias("values"))
    return write_records(rows, folder, "postings", n_docs)


def postings_table(spark: SparkSession, path: str) -> DataFrame:
    """(term_id, doc_id, weight) of index files."""
    zipped = F.explode(F.arrays_zip("ids", "values"))
    return read_records(spark, path, "postings").select(F.col("key").alias("term_id"), zipped.alias("p")).select("term_id", F.col("p.ids").cast("long").alias("doc_id"), F.col("p.values").cast("double").alias("weight"))
