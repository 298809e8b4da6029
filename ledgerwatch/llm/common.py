"""Helpers shared by the training-data operators: shared files, packed arrays, byte-level words."""

from __future__ import annotations

import io
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwatch.session import configure
from ledgerwatch.sources.files import scratch

#: Bounds of one Arrow batch, so that a task's memory follows them and not the table.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def prepare(spark: SparkSession) -> SparkSession:
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder, as a URI that pyarrow opens too."""
    path = scratch(spark, name)
    if path.startswith("file:/") and not path.startswith("file:///"):
        path = "file:///" + path[len("file:/"):].lstrip("/")
    return path if "://" in path else "file://" + path


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and continue from the files: done once, and kept when executors are lost."""
    path = folder(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def body(text: str | Column) -> Column:
    """The text as UTF-8 bytes, empty for null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")


def crc_mod5(id_col: str) -> Column:
    """crc32 of the id as text, modulo 5: the fold of a document."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5))


class SharedFile:
    """A file that appears under its name only when complete, so that a lost attempt leaves nothing that counts."""

    def __init__(self, base: str, stem: str):
        self.fs, root = pafs.FileSystem.from_uri(base)
        self.fs.create_dir(root, recursive=True)
        self.name = f"{stem}-{uuid.uuid4().hex}"
        self.path = f"{root}/{self.name}"
        self.out = self.fs.open_output_stream(self.path + ".part")
        self.size = 0

    def write(self, data: bytes) -> int:
        at = self.size
        self.out.write(data)
        self.size += len(data)
        return at

    def close(self) -> str:
        self.out.close()
        self.fs.move(self.path + ".part", self.path)
        return self.name


def open_shared(base: str, name: str):
    """Random access to a file written by ``SharedFile``."""
    fs, root = pafs.FileSystem.from_uri(base)
    return fs.open_input_file(f"{root}/{name}")


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed block; unpack() gives them back."""
    raw = io.BytesIO()
    for a in arrays:
        np.lib.format.write_array(raw, np.ascontiguousarray(a), allow_pickle=False)
    return zstandard.ZstdCompressor(level=1).compress(raw.getvalue())


def unpack(block: bytes) -> list[np.ndarray]:
    raw = io.BytesIO(zstandard.ZstdDecompressor().decompress(block))
    size, found = raw.getbuffer().nbytes, []
    while raw.tell() < size:
        found.append(np.lib.format.read_array(raw, allow_pickle=False))
    return found


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column as one byte array, and the offset of each value (one more than rows)."""
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)
    else:
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)
    offsets = offsets[column.offset: column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]: offsets[-1]], offsets - offsets[0]


#: Lower-cases A-Z; the other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The bytes that part words: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

_MUL = np.uint64(0x9E3779B97F4A7C15)  # odd, as all multipliers here
_INV = np.uint64(pow(int(_MUL), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base of the rolling hash and of its inverse, modulo 2^64."""
    up, down = np.full(n, _MUL), np.full(n, _INV)
    if n:
        up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def prefix_hash(data: np.ndarray, up: np.ndarray) -> np.ndarray:
    """Running polynomial sums (one more than bytes): differences give the hash of any range."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(mix(data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of lower-cased texts: their starts, ends, and the first word of each text (one more than texts).

    Words end at the borders of texts; ``data`` holds the texts one after the other.
    """
    inside = ~SPACE[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    borders = offsets[1:-1]
    borders = borders[(borders > 0) & (borders < len(data))]
    both = borders[inside[borders] & inside[borders - 1]]
    starts[both] = True
    ends[both - 1] = True
    at = np.flatnonzero(starts)
    return at, np.flatnonzero(ends) + 1, np.searchsorted(at, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes; equal words have equal hashes wherever they stand."""
    up, down = powers(len(data))
    sums = prefix_hash(data, up)
    return mix((sums[ends] - sums[starts]) * down[starts] + mix((ends - starts).astype(np.uint64)))


#: Rows that tasks send each other: what it is, the bucket or chunk it goes to, where it comes from, packed arrays.
SENT = "kind string, place long, source long, block binary"


def sent_rows(rows: list[tuple[str, int, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * 4
    types = (pa.string(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["kind", "place", "source", "block"])
