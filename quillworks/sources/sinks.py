"""Writers: JSON Lines, JSON, Parquet, Arrow, TFRecord, CSV; and readers of JSON Lines."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceWriter, WriterCommitMessage

FORMATS = ("jsonl", "json", "parquet", "arrow", "tfrecord")
#: A JSON array is one file, put together by one task.
JSON_ROWS = 1_000_000


def format_of(path: str, asked: str = "jsonl") -> str:
    """The format that the ending names, if none but the default was asked for."""
    ending = path.rpartition(".")[2].lower()
    return ending if asked == "jsonl" and ending in FORMATS else asked


def file_name(source: str) -> str:
    """A source's name as a file name: no ending, no brackets, underscores for blanks."""
    return source.rpartition(".")[0].translate({32: "_", 40: None, 41: None}) if "." in source else source.translate({32: "_", 40: None, 41: None})


def file_name_of(source: Column) -> Column:
    """:func:`file_name` as a column."""
    bare = F.when(F.contains(source, F.lit(".")), F.regexp_replace(source, r"\.[^.]*$", "")).otherwise(source)
    return F.translate(bare, " ()", "_")


def flat(df: DataFrame) -> DataFrame:
    """Quality dimensions as columns of their own."""
    if "quality_dimensions" not in df.columns:
        return df
    return df.select(*(c for c in df.columns if c != "quality_dimensions"), "quality_dimensions.*")


def scalars(df: DataFrame) -> DataFrame:
    """Columns other than arrays, maps and structs."""
    return df.select(*(f.name for f in df.schema if f.dataType.typeName() not in ("array", "map", "struct")))


MODES = ("errorifexists", "error", "overwrite", "append", "ignore")


def write(df: DataFrame, path: str, kind: str = "jsonl", mode: str = "errorifexists", by: list[str] | None = None) -> None:
    """Writes a folder of files in one of ``FORMATS``; the values of ``by`` columns become folders, as Spark names them. A JSON array is
    one file, so it takes no ``by``."""
    if kind not in FORMATS:
        raise ValueError(f"format must be one of {', '.join(FORMATS)}")
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    if kind == "json":
        if by:
            raise ValueError("a JSON array is one file; use jsonl for a folder a value")
        if df.limit(JSON_ROWS + 1).count() > JSON_ROWS:
            raise ValueError(f"a JSON array takes up to {JSON_ROWS} rows; use jsonl")
        rows = df.select(F.to_json(F.struct(*df.columns), {"pretty": "true"}).alias("value")).coalesce(1)
        rows.mapInPandas(_array, "value string").write.mode(mode).text(path)
        return
    spark = df.sparkSession
    if kind in ("arrow", "tfrecord"):
        if not _cleared(spark, path, mode):
            return
        spark.dataSource.register(ArrowFiles if kind == "arrow" else RecordFiles)
        rows = scalars(df)
        if by:  # a task then has one file open at a time
            rows = rows.repartition(*by).sortWithinPartitions(*by)
        rows.write.format("quill_" + kind).option("path", path).option("by", json.dumps(by or [])).mode("append").save()
        return
    writer = (flat(df) if kind == "parquet" else df).write.mode(mode)
    if by:
        writer = writer.partitionBy(*by)
    writer.parquet(path) if kind == "parquet" else writer.json(path)


def _cleared(spark: SparkSession, path: str, mode: str) -> bool:
    """Whether to write to ``path``, after what ``mode`` asks to do to it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if mode == "append" or not store.exists(at):
        return True
    if mode == "overwrite":
        return store.delete(at, True)
    if mode == "ignore":
        return False
    raise FileExistsError(path)


def _array(frames):
    import pandas as pd

    first = True
    for frame in frames:
        lines = [("[\n" if first and not i else ",\n") + v for i, v in enumerate(frame["value"])]
        if lines:
            first = False
            yield pd.DataFrame({"value": ["".join(lines)]})
    yield pd.DataFrame({"value": ["[]" if first else "]"]})


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The quality table with a header."""
    df.write.mode(mode).option("header", True).csv(path)


def read_jsonl(spark: SparkSession, path: str, lenient: bool = False) -> DataFrame:
    """Rows of JSON Lines; a bad line fails the read, or (lenient) is skipped."""
    return spark.read.option("mode", "DROPMALFORMED" if lenient else "FAILFAST").json(path)


def _filesystem(path: str):
    """The store and the path in it; plain paths are local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _folder(by: list[str], values: tuple) -> str:
    """The folders of a row's values, in Spark's form."""
    from urllib.parse import quote

    return "".join(f"/{c}={'__HIVE_DEFAULT_PARTITION__' if v is None or v == '' else quote(str(v), safe=' ().-_')}" for c, v in zip(by, values, strict=True))


def _target(folder: str, ending: str):
    """A file of its own for a task attempt."""
    from pyspark import TaskContext

    context = TaskContext.get()
    files, path = _filesystem(folder)
    files.create_dir(path, recursive=True)
    return files, f"{path}/part-{context.partitionId():05d}-{context.taskAttemptId()}.{ending}"


class Done(WriterCommitMessage):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class _Folder:
    """Files of failed attempts go; a marker says that all is there."""

    def __init__(self, folder: str, by: list[str]) -> None:
        self.folder, self.by = folder, by

    def commit(self, messages) -> None:
        files, path = _filesystem(self.folder)
        with files.open_output_stream(f"{path}/_SUCCESS"):
            pass

    def abort(self, messages) -> None:
        for m in messages:
            for path in m.paths if m is not None else ():
                files, _ = _filesystem(self.folder)
                files.delete_file(path)


class ArrowFiles(DataSource):
    """Arrow IPC files."""

    @classmethod
    def name(cls) -> str:
        return "quill_arrow"

    def writer(self, schema, overwrite: bool):
        return _ArrowWriter(self.options["path"], json.loads(self.options["by"]))


class _ArrowWriter(_Folder, DataSourceArrowWriter):
    def write(self, batches: Iterator) -> WriterCommitMessage:
        import pyarrow as pa

        done, writer, out, now = [], None, None, None
        for batch in batches:
            for values, part in self._runs(batch):
                if writer is None or values != now:
                    if writer is not None:
                        writer.close()
                        out.close()
                    files, path = _target(self.folder + _folder(self.by, values), "arrow")
                    out, now = files.open_output_stream(path), values
                    writer = pa.ipc.new_file(out, part.schema)
                    done.append(path)
                writer.write_batch(part)
        if writer is not None:
            writer.close()
            out.close()
        return Done(done)

    def _runs(self, batch):
        """Stretches of rows with the same values, without these."""
        rest = batch.select([c for c in batch.schema.names if c not in self.by])
        keys = [*zip(*(batch[c].to_pylist() for c in self.by), strict=True)] if self.by else [()] * batch.num_rows
        start = 0
        for end in range(1, len(keys) + 1):
            if end == len(keys) or keys[end] != keys[start]:
                yield keys[start], rest.slice(start, end - start)
                start = end


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, data: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def example(row: dict) -> bytes:
    """A serialised tf.train.Example of a row's scalars: whole numbers and booleans, floats, and text; nulls are left out."""
    features = b""
    for key, value in row.items():
        if value is None:
            continue
        if isinstance(value, (bool, int)):
            feature = _field(3, _field(1, _varint(int(value))))
        elif isinstance(value, float):
            feature = _field(2, _field(1, struct.pack("<f", value)))
        else:
            feature = _field(1, _field(1, str(value).encode()))
        features += _field(1, _field(1, key.encode()) + _field(2, feature))
    return _field(1, features)


def _crc_tables() -> list[list[int]]:
    """For CRC-32C: the checksum of each byte followed by 0 to 7 empty ones, from the polynomial."""
    first = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0x82F63B78 if n & 1 else 0)
        first.append(n)
    tables = [first]
    for _ in range(7):
        tables.append([c >> 8 ^ first[c & 255] for c in tables[-1]])
    return tables[::-1]


CRC = _crc_tables()


def masked_crc(data: bytes) -> int:
    """Eight bytes at a time, then the rest one by one."""
    crc, whole = 0xFFFFFFFF, len(data) & ~7
    a, b, c, d, e, f, g, h = CRC
    for low, high in struct.iter_unpack("<II", data[:whole]):
        low ^= crc
        crc = a[low & 255] ^ b[low >> 8 & 255] ^ c[low >> 16 & 255] ^ d[low >> 24] ^ e[high & 255] ^ f[high >> 8 & 255] ^ g[high >> 16 & 255] ^ h[high >> 24]
    for x in data[whole:]:
        crc = crc >> 8 ^ h[(crc ^ x) & 255]
    crc ^= 0xFFFFFFFF
    return (crc >> 15 | crc << 17) + 0xA282EAD8 & 0xFFFFFFFF


def record(data: bytes) -> bytes:
    """A framed record: length, checksum of the length, data, checksum of the data."""
    size = struct.pack("<Q", len(data))
    return size + struct.pack("<I", masked_crc(size)) + data + struct.pack("<I", masked_crc(data))


class RecordFiles(DataSource):
    """TFRecord files of tf.train.Example."""

    @classmethod
    def name(cls) -> str:
        return "quill_tfrecord"

    def writer(self, schema, overwrite: bool):
        return _RecordWriter(self.options["path"], json.loads(self.options["by"]))


class _RecordWriter(_Folder, DataSourceWriter):
    def write(self, rows: Iterator) -> WriterCommitMessage:
        done = []
        for values, some in groupby((row.asDict() for row in rows), lambda r: tuple(r[c] for c in self.by)):
            files, path = _target(self.folder + _folder(self.by, values), "tfrecord")
            done.append(path)
            with files.open_output_stream(path) as out:
                for row in some:
                    out.write(record(example({k: v for k, v in row.items() if k not in self.by})))
        return Done(done)
