"""What the operators share: scratch tables, code shipping, word hashing and bounded reductions."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: [\x20\x09-\x0D].
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z on bytes, nothing else.
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[ord("A") : ord("Z") + 1] += 32

try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim
except (OSError, AttributeError):  # another C library
    _LIBC = None

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a context, so that they import it wherever the driver runs from, and bound Arrow's batches."""
    # few texts at a time between the JVM and Python; long ones count by their bytes
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))
    context = spark.sparkContext
    if getattr(context, "_tessera_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="tessera-")), "tessera_src.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(os.path.join(root, "tessera")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, root))
    context.addPyFile(path)
    context._tessera_shipped = True


def scratch_path(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share. Where that is unset, a local one on a local master, as in tests; else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), "tessera-checkpoints")
    return f"{folder.rstrip('/')}/tessera/{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs within go when it ends, not when the driver happens to collect its garbage. For plans that run once."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table in the shared folder; a lost executor then costs a read, no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark)
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_apart(df: DataFrame, column: str, values: list[str]) -> list[DataFrame]:
    """As written(), but a table for each of these values of a column, without it, so that each can be dropped by itself."""
    spark = df.sparkSession
    path, rest = scratch_path(spark), df.drop(column).schema
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").partitionBy(column).parquet(path)
    out = []
    for value in values:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{column}={value}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)  # it may have no rows
        out.append(spark.read.schema(rest).parquet(f"{path}/{column}={value}"))
    return out


def drop_written(df: DataFrame) -> None:
    """Delete the tables that written() made for this frame."""
    spark = df.sparkSession
    for name in {os.path.dirname(x) for x in df.inputFiles()}:
        if "/tessera/" in name:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, each with as many underscores before it as keep it apart from the columns of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def column_or_null(df: DataFrame, name: str, kind: str):
    """A column by name, cast; a null of that type if the table lacks it."""
    return F.col(f"`{name}`").cast(kind) if name in df.columns else F.lit(None).cast(kind)


# --- words ---------------------------------------------------------------------------------------------------


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier and of its inverse, modulo 2**64."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        inverse = pow(_MULTIPLIER, -1, 1 << 64)
        for key, base in (("up", _MULTIPLIER), ("down", inverse)):
            out = np.empty(size, dtype=np.uint64)
            out[0] = 1
            done = 1
            step = base
            while done < size:  # doubling
                take = min(done, size - done)
                out[done : done + take] = out[:take] * np.uint64(step)
                done += take
                step = step * step % (1 << 64)
            _POWERS[key] = out
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts end to end, offsets); null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=n + 1, offset=8 * texts.offset)
    first, last = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[first:last] if last > first else np.zeros(0, np.uint8)
    return data, offsets - first


def runs(kinds: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the longest runs of one kind other than 0; a text's end ends a run."""
    if not len(kinds):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    change = np.ones(len(kinds) + 1, bool)
    change[1:-1] = kinds[1:] != kinds[:-1]
    change[offsets] = True
    at = np.flatnonzero(change)
    starts, ends = at[:-1], at[1:]
    ink = kinds[starts] != 0
    return starts[ink], ends[ink]


def hash_segments(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits for each segment: a polynomial over its bytes with its length mixed in. Starts must not fall."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    out = np.empty(len(starts), np.uint64)
    block, at = 1 << 20, 0  # in blocks, so that the powers of the multiplier stay few
    while at < len(starts):
        base = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, base + block, side="right")))
        top = int(ends[to - 1])
        up, down = powers(top - base + 1)
        total = np.empty(top - base + 1, np.uint64)
        total[0] = 0
        np.cumsum((data[base:top].astype(np.uint64) + np.uint64(1)) * up[: top - base], out=total[1:])
        s, e = starts[at:to] - base, ends[at:to] - base
        out[at:to] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        at = to
    return out


class Words:
    """The words of a batch of texts, by bytes: starts, ends and hashes of each word and the words of each text.

    Words are the longest runs outside [\\x20\\x09-\\x0D]. ``lower`` folds A-Z only. Null texts count as empty.
    """

    def __init__(self, texts: pa.Array, lower: bool = True):
        self.raw, self.offsets = buffers(texts)
        self.data = ASCII_LOWER[self.raw] if lower else self.raw
        self.starts, self.ends = runs((~SPACES)[self.raw], self.offsets)
        #: words of text i: bounds[i] to bounds[i + 1]
        self.bounds = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.bounds)

    def __len__(self) -> int:
        return len(self.starts)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        return hash_segments(self.data, self.starts, self.ends)


def shingles(hashes: np.ndarray, bounds: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every window of ``size`` words; a text with fewer words has all its words as one window."""
    counts = np.diff(bounds)
    windows = np.where(counts >= size, counts - size + 1, (counts > 0).astype(counts.dtype))
    total = int(windows.sum())
    owner = np.repeat(np.arange(len(counts)), windows)
    if not total:
        return owner, np.zeros(0, np.uint64)
    first = np.cumsum(windows) - windows
    at = np.arange(total) - np.repeat(first, windows) + np.repeat(bounds[:-1], windows)
    length = np.minimum(counts, size)[owner]
    out = np.full(total, 0x243F6A8885A308D3, np.uint64)
    for k in range(size):
        live = length > k
        step = hashes[np.minimum(at + k, len(hashes) - 1)]
        out = np.where(live, mix(out * np.uint64(0x9E3779B97F4A7C15) + step), out)
    return owner, mix(out + length.astype(np.uint64))


def distinct_in_text(owner: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (text, key)."""
    order = np.lexsort((keys, owner))
    owner, keys = owner[order], keys[order]
    if len(keys):
        new = np.ones(len(keys), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (keys[1:] != keys[:-1])
        owner, keys = owner[new], keys[new]
    return owner, keys


def crc_mod(ids, n: int) -> np.ndarray:
    """crc32 of the decimal text of each id, modulo n; -1 for a null id."""
    import zlib

    return np.array([zlib.crc32(str(x).encode()) % n if x is not None else -1 for x in ids], dtype=np.int64)


def slices(batch: pa.RecordBatch, column: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch with about ``limit`` bytes of text each, and one row at least."""
    n = batch.num_rows
    if not n:
        return
    import pyarrow.compute as pc

    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < n:
        before = int(size[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(size, before + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to
    trim()


def trim() -> None:
    """Give freed memory back to the system: a Python worker lives on after its tasks, beside others in the same container."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


# --- bounded sums --------------------------------------------------------------------------------------------


def sum_vectors(partial: DataFrame, fan: int = 64) -> DataFrame:
    """Sum (slot int, part int, vec binary of int64) by slot, in two levels, so that no task holds a row of every input task.

    The number of slots and each vector's length are fixed by the caller; the result is bounded by them.
    """

    def add(table: pa.Table) -> pa.Table:
        total = None
        for x in table.column("vec").to_pylist():
            v = np.frombuffer(x, np.int64)
            total = v.copy() if total is None else total + v
        return pa.table({"slot": table.column("slot").slice(0, 1), "part": pa.array([0], pa.int32()), "vec": pa.array([total.tobytes()], pa.binary())})

    schema = "slot int, part int, vec binary"
    first = partial.select("slot", (F.col("part") % fan).cast("int").alias("part"), "vec").groupBy("slot", "part").applyInArrow(add, schema)
    return first.groupBy("slot").applyInArrow(add, schema).select("slot", "vec")


def task_number() -> int:
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId() if context else 0


# --- components ----------------------------------------------------------------------------------------------


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for the nodes of ``edges`` (a, b), both long.

    Alternating large-star and small-star rounds; each is two aggregations with map-side minima and joins that AQE may split,
    so that a node with very many links never gathers them in one task. Each round is written to the shared folder.
    """
    both = edges.where("a is not null and b is not null and a <> b")
    now = written(both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last = None
    for _ in range(max_rounds):
        # large-star: every larger neighbour of u moves to the smallest of u's neighbours and u
        around = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = around.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        # small-star: u and its smaller neighbours move to the smallest of them
        large = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select("a", F.col("m").alias("b")))
        after = written(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if last is not None:
            drop_written(now)
        now = after
        if mark == last:
            break
        last = mark
    else:
        raise RuntimeError("components did not settle")
    roots = now.groupBy(F.col("b").alias("node")).agg(F.min("b").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
