"""Helpers that the corpus operators share: staging to the shared folder, Arrow plumbing, word hashing."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofsheet.functions.session import plain_unions

# Functions of this package travel to executors by value, so that a cluster needs no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Words are maximal runs of anything but the six ASCII white-space bytes; bytes.split() cuts at exactly these.
SPACE_CLASS = "[\\x20\\x09-\\x0D]"
WORD_CLASS = "[^\\x20\\x09-\\x0D]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a fresh one where that is unset and all run on one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: later steps start from these files, whichever executor is lost.

    All such tables of an application lie in one folder, to be removed with it.
    """
    spark = df.sparkSession
    plain_unions(df)
    path = f"{shared_dir(spark)}/proofsheet-{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_bytes(df: DataFrame) -> int:
    """Bytes of the files in the folder of a staged table."""
    spark = df.sparkSession
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    folders = map(spark._jvm.org.apache.hadoop.fs.Path, {f.rsplit("/", 1)[0] for f in df.inputFiles()})
    return sum(p.getFileSystem(conf).getContentSummary(p).getLength() for p in folders)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df does not have yet."""
    taken = {c.lower() for c in df.columns}
    name, i = stem, 0
    while name.lower() in taken:
        i += 1
        name = f"{stem}_{i}"
    return name


def source(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Just (doc_id, text): other columns, whatever their names, play no part."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def small_batches(spark: SparkSession, rows: int = 2000, size: str = "8m") -> None:
    """Arrow batches bounded in rows and bytes, so that one batch of long texts stays small in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def worker_cache(name: str) -> types.ModuleType:
    """A namespace that lives as long as the Python worker, across its tasks."""
    key = f"_proofsheet_{name}"
    return sys.modules.setdefault(key, types.ModuleType(key))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(values: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null is empty."""
    return [v or b"" for v in values.cast(pa.binary()).to_pylist()]


def listed(a: pa.Array) -> list:
    """The values of an array of longs or of binary, as to_pylist() gives them but without a scalar for each."""
    if pa.types.is_binary(a.type):
        _, offsets, data = a.buffers()
        cuts = np.frombuffer(offsets, np.int32)[a.offset:a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int32)
        raw = data.slice(int(cuts[0]), int(cuts[-1] - cuts[0])).to_pybytes() if data is not None else b""
        cuts = (cuts - cuts[0]).tolist()
        out = [raw[x:z] for x, z in zip(cuts[:-1], cuts[1:])]
    else:
        out = (a.fill_null(0) if a.null_count else a).to_numpy(zero_copy_only=False).tolist()
    if a.null_count:
        out = [x if v else None for x, v in zip(out, a.is_valid().to_numpy(zero_copy_only=False).tolist())]
    return out


def rows_of(batches: Iterable[pa.RecordBatch], most: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with the bytes of column text: about `most` bytes each, at least one row."""
    for batch in batches:
        texts = text_bytes(batch.column(batch.schema.get_field_index("text")))
        start = size = 0
        for i, t in enumerate(texts):
            if i > start and size + len(t) > most:
                yield batch.slice(start, i - start), texts[start:i]
                start, size = i, 0
            size += len(t)
        if start < len(texts):
            yield batch.slice(start), texts[start:]


def map_arrow(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    small_batches(df.sparkSession)
    return df.mapInArrow(f, schema)


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)


def blobs(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The bytes of values[cuts[i]:cuts[i+1]] for each i, as binary."""
    width = values.dtype.itemsize
    offsets = pa.py_buffer((cuts * width).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, offsets, pa.py_buffer(np.ascontiguousarray(values).tobytes())])


# ---------------------------------------------------------------- hashing in numpy

def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_table(seed: int, n: int = 256) -> np.ndarray:
    """n random 64-bit values, such as one for each byte."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def word_bounds(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word of a buffer."""
    gap = np.ones(len(b) + 2, bool)
    gap[1:-1] = (b == 32) | ((b >= 9) & (b <= 13))
    return np.flatnonzero(gap[:-2] & ~gap[1:-1]), np.flatnonzero(~gap[1:-1] & gap[2:]) + 1


def word_hashes(b: np.ndarray, start: np.ndarray, end: np.ndarray, seeds: int = 1, most: int = 4 << 20) -> list[np.ndarray]:
    """One 64-bit hash per word and seed, from all its bytes and its length; the buffer is worked through in pieces."""
    out = [np.empty(len(start), np.uint64) for _ in range(seeds)]
    if not len(start):
        return out
    cuts, i = [0], 0
    while i < len(start):
        i = max(i + 1, int(np.searchsorted(end, start[i] + most)))
        cuts.append(i)
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        s, e = start[lo:hi], end[lo:hi]
        size = e - s
        first = np.concatenate(([0], np.cumsum(size)[:-1]))
        within = np.arange(int(size.sum())) - np.repeat(first, size)
        chars = b[within + np.repeat(s, size)]
        for k in range(seeds):
            h = byte_table(k)[chars] * powers(BASES[k], int(size.max()))[within]
            out[k][lo:hi] = mix(np.add.reduceat(h, first) + size.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    return out


def window_hashes(h: np.ndarray, width: int, base: int) -> np.ndarray:
    """A hash of each run of `width` consecutive values, by doubling; empty if there is no such run."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, at, length, block = None, 0, 1, h
    power = np.uint64(base)  # base ** length
    scale = np.uint64(1)
    with np.errstate(over="ignore"):
        while True:
            if width & length:
                out = block[at:at + n] if out is None else out + scale * block[at:at + n]
                at += length
                scale = scale * power
            length *= 2
            if length > width:
                break
            half = length // 2
            block = block[:-half] + power * block[half:]
            power = power * power
    return mix(out)


def sliding_argmin(v: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` values the index of its least value, the leftmost at ties."""
    n = len(v) - width + 1
    idx = np.arange(len(v))
    span = 1
    best = idx
    while span * 2 <= width:
        a, b = best[:-span], best[span:]
        best = np.where(v[b] < v[a], b, a)
        span *= 2
    if span < width:
        a, b = best[:n], best[width - span:width - span + n]
        best = np.where((v[b] < v[a]), b, a)
    return best[:n]


def runs(index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of consecutive numbers in an ascending array."""
    if not len(index):
        return index, index
    first = np.flatnonzero(np.concatenate(([True], np.diff(index) != 1)))
    return index[first], np.diff(np.concatenate((first, [len(index)])))


def same_row(a: str, b: str, names: Iterable[str] = ("doc_id", "text_key")) -> Column:
    """Equality of the row keys of two aliased tables; null equals null."""
    out = F.lit(True)
    for n in names:
        out = out & F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}"))
    return out
