"""What the corpus operators share: the shared work folder, Arrow blocks, byte tables, components."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that an Arrow-based operator works on at a time; one longer text is a block of its own.
BLOCK_BYTES = 4 << 20
#: Bytes of an Arrow batch that Spark sends to a Python worker.
BATCH_BYTES = 8 << 20
SPACE = "[\\x20\\x09-\\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where that is unset and all runs in one process (tests)."""
    at = spark.sparkContext.getCheckpointDir() if spark.conf.get("spark.checkpoint.dir", None) is None else spark.conf.get("spark.checkpoint.dir")
    if at is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: a cluster needs a folder that all its machines share")
        at = "file://" + tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one; every executor sees it and it outlives any of them."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df as a table in the shared folder: cuts lineage and survives lost executors.

    Shuffle files of the job go as soon as the table is there, not when the driver collects its garbage.
    """
    at, conf = work_dir(df.sparkSession, name), df.sparkSession.conf
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        df.write.option("compression", codec).parquet(at)
    finally:
        conf.set(key, before)
    return df.sparkSession.read.schema(df.schema).parquet(at)


@lru_cache(maxsize=4)
def _shipped(app: str) -> bool:
    """Sends this package to the executors of one application."""
    package = Path(__file__).resolve().parent.parent
    at = Path(tempfile.mkdtemp(prefix="package-")) / "homeledger_package.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, str(p.relative_to(package.parent)))
    SparkContext._active_spark_context.addPyFile(str(at))
    return True


def prepare(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, so that very long texts do not pile up in a worker; ships the package."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    _shipped(spark.sparkContext.applicationId)


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that one column holds at most limit bytes, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offs = text_bytes(batch.column(column))[1]
        lo = 0
        while lo < batch.num_rows:
            hi = int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1
            hi = min(max(hi, lo + 1), batch.num_rows)
            yield batch.slice(lo, hi - lo)
            lo = hi
    trim()


def trim() -> None:
    """Gives memory that a worker no longer uses back: the worker stays for other stages, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # only glibc has it
        pass


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and len + 1 offsets into them; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(kind)
    width = np.int64 if pa.types.is_large_binary(kind) else np.int32
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random odd multiplier and its inverse modulo 2**64.
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)


_tables: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse, from one table a process."""
    if not _tables or len(_tables[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        made = []
        for base in (_P, _P_INV):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            made.append(np.multiply.accumulate(x, out=x))
        _tables[:] = made
    return _tables[0][:n], _tables[1][:n]


_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Slices:
    """64-bit hashes of many slices of one byte array, equal for equal bytes, in constant time each.

    They are linear in the bytes: for features that may collide, never for the identity of words (word_hashes).
    """

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        part = _BYTES[data]
        part *= up[: len(data)]
        np.cumsum(part, out=self.sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        return mixed(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


#: Low bytes of a little-endian number, by how many count; slices of more bytes than LONG_SLICE are hashed one by one.
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
LONG_SLICE = 512


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of slices of a byte array, equal for equal bytes wherever they stand.

    Eight bytes at a time go through a finaliser that is not linear, so that no algebra of the text (as with
    polynomial hashes and Thue-Morse words) makes two slices alike; slices of one length of up to eight bytes never are.
    """
    size = ends - starts
    eights = np.ndarray(len(data) + 1, "<u8", np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))
    h = mixed((size + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    long = np.flatnonzero(size > LONG_SLICE)
    at, k = np.flatnonzero((size > 0) & (size <= LONG_SLICE)), 0
    while len(at):
        left = size[at] - k
        h[at] = mixed(h[at] ^ (eights[starts[at] + k] & _MASKS[np.minimum(left, 8)]))
        at, k = at[left > 8], k + 8
    for i in long.tolist():
        h[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), 42)
    return h


def runs(mask: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of mask within each row; rows are given by offsets."""
    n = len(mask)
    first, last = mask.copy(), mask.copy()
    first[1:] &= ~mask[:-1]
    last[:-1] &= ~mask[1:]
    inner = offs[1:-1][(offs[1:-1] > 0) & (offs[1:-1] < n)]
    first[inner] = mask[inner]
    last[inner - 1] = mask[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def spans_of(lens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Concatenated ranges starts[i] .. starts[i] + lens[i]."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    base = np.repeat(starts - (np.cumsum(lens) - lens), lens)
    return base + np.arange(total, dtype=np.int64)


def bitmap(keys: DataFrame, column: str, bits: int) -> DataFrame:
    """(part, map): a bitmap of 2**bits bits of the low bits of a long column, in parts of 4 kB."""
    low = F.col(column).bitwiseAND((1 << bits) - 1)
    rows = keys.select(low.alias("x")).select(F.expr("CAST(shiftright(x, 15) AS int)").alias("part"), F.expr("x & 32767").alias("bit"))
    return rows.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("map"))


def with_bit(rows: DataFrame, key: Column, maps: DataFrame, bits: int, name: str) -> DataFrame:
    """rows with whether the bitmap holds a long key: false positives only. Broadcasts 2**bits bits."""
    rows = rows.withColumn("_x", key.bitwiseAND((1 << bits) - 1)).withColumn("part", F.expr("CAST(shiftright(_x, 15) AS int)"))
    rows = rows.join(F.broadcast(maps), "part", "left")
    byte = F.expr("CAST(conv(hex(substring(map, CAST((_x & 32767) / 8 AS int) + 1, 1)), 16, 10) AS int)")
    return rows.withColumn(name, F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, CAST(_x & 7 AS int))")) != 0, F.lit(False))).drop("_x", "part", "map")


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node that it reaches over the links a-b."""
    label = np.arange(n, dtype=np.int64)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while True:
            deeper = label[label]
            if np.array_equal(deeper, label):
                break
            label = deeper
        if np.array_equal(before, label):
            break
        keep = label[a] != label[b]
        a, b = a[keep], b[keep]
    return label


def connected_components(edges: DataFrame, name: str, most: int = 60) -> DataFrame:
    """(node, component) for every node of links (u, v): component is the least node reachable.

    Alternates large-star and small-star steps; each step is two aggregates with partial sums and two
    joins, is written to the shared folder, and the count and hash sum of the links tell the end.
    """
    e = edges.where("u <> v").selectExpr("greatest(u, v) AS u", "least(u, v) AS v").distinct()
    e, seen = written(e, name), None
    for _ in range(most):
        got = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 40))).first()
        if tuple(got) == seen or not got[0]:
            break
        seen = tuple(got)
        both = e.unionByName(e.selectExpr("v AS u", "u AS v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) AS m")
        large = both.where("v > u").join(least, "u").selectExpr("v AS u", "m AS v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").selectExpr("v AS u", "m AS v")
        e = written(small.unionByName(least.selectExpr("u", "m AS v")).distinct(), name)
    else:
        raise RuntimeError("components did not settle")
    e = e.unionByName(e.selectExpr("v AS u", "v"))  # the least nodes themselves
    return e.groupBy("u").agg(F.min("v").alias("component")).selectExpr("u AS node", "component")
