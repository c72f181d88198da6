"""What the operators of this subpackage share: Arrow batches of text cut to a bounded size, vectorised words and
hashes, exchanges of packed rows, tables in the shared folder, and exactly bounded samples."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker holds as numpy arrays at a time (one longer document is held alone).
SLICE_BYTES = 4 << 20
#: Bytes of input for each partition of an exchange; the setting spark.logquern.partitionBytes takes its place.
PARTITION_BYTES = 16 << 20
#: Keys of which a join broadcasts the few that hold more than this part of all rows: there are fewer of them than this.
HOT = 1024
U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset, local mode takes one of the driver's own; on a cluster
    executors could not share it, so that is an error."""
    jsc = spark.sparkContext._jsc.sc()
    named = spark.conf.get("spark.checkpoint.dir", None) or (jsc.getCheckpointDir().get() if jsc.getCheckpointDir().isDefined() else None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="logquern-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def stored(df: DataFrame, by: str | None = None) -> DataFrame:
    """df written as Parquet into the shared folder and read again: a lost executor costs no recomputation past it. by: a
    column of few values, each of which gets files of its own. The table goes when the driver ends, or by forget()."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/logquern/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    fs, at = _file_system(spark, path)
    fs.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a stored table that nothing reads any more."""
    fs, at = _file_system(df.sparkSession, df._stored_at)
    fs.delete(at, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """A name like each of names that no column of df has."""
    taken = {n.lower() for n in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def partitions(df: DataFrame) -> int:
    """Partitions for an exchange of about the size of df: spark.sql.shuffle.partitions, or more for a large input."""
    spark = df.sparkSession
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    known = size < 1 << 60  # rows that the driver made have no size
    each = int(spark.conf.get("spark.logquern.partitionBytes", str(PARTITION_BYTES)))
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each) if known else 1)


def looked_up(left: DataFrame, right: DataFrame, keys: list[str], many: str, total: int | None = None) -> DataFrame:
    """left with the columns of right, whose keys are unique; right's column many tells how many rows of left a key has.
    Keys with more than a HOT-th of all those rows (total, if known), fewer than HOT in number, are broadcast; the others
    are joined by exchange, so no task gets much more than a HOT-th of left. Rows without a partner, or with a null key, get
    nulls and meet nobody."""
    names = [c for c in right.columns if c not in keys and c != many]
    total = (right.agg(F.sum(many)).first()[0] or 0) if total is None else total
    hot = F.col(many) > F.lit(total / HOT)
    value = F.struct(*names).alias("_value")
    known = left.join(F.broadcast(right.filter(hot).select(*keys, value)), keys, "left")
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    done = known.filter(F.col("_value").isNotNull() | ~whole)
    rest = known.filter(F.col("_value").isNull() & whole).drop("_value").join(right.filter(~hot).select(*keys, value), keys, "left")
    return done.unionByName(rest).select(*left.columns, "_value.*")


def exchange(df: DataFrame, n: int, pid: str = "pid") -> DataFrame:
    """Each row to the partition that its pid (0 to n - 1) names."""
    return df.repartitionById(n, F.col(pid).cast("int"))


def crc_mod(column: str, n: int) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def bounded_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """At most about n rows of df, those with the least hash of key: the same rows in any order of the input. Only hashes
    are sorted; rows that tie with the last hash are kept."""
    h = F.xxhash64(F.col(key))
    last = df.select(h.alias("h")).orderBy("h").limit(n).agg(F.max("h")).first()[0]
    return df.filter(h <= F.lit(last)) if last is not None else df.limit(0)


def tidy(each: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """each, after which its worker gives memory that is free back to the system: workers outlive their tasks."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from each(batches)
        give_back()

    return tidied


def give_back() -> None:
    """Memory that is free goes back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in runs whose texts together have at most limit bytes, or of one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, end - start)
            start = end


def flat(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets (from 0) and values of a list array without nulls."""
    offsets = np.asarray(lists.offsets).astype(np.int64)
    return offsets - offsets[0], lists.flatten()


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words [^\\x20\\x09-\\x0D]+ of texts with A-Z lower-cased; null: none. Offsets by text, codes, and the distinct words."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    offsets, values = flat(lists)
    full = pc.greater(pc.binary_length(values), 0)
    kept = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    encoded = values.filter(full).dictionary_encode()
    return kept[offsets], encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary


def raw(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string or binary array without nulls."""
    strings = strings.cast(pa.large_binary())
    _, offsets, data = strings.buffers()
    if not len(strings):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(offsets, np.int64)[strings.offset : strings.offset + len(strings) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def strings(offsets: np.ndarray, data: np.ndarray, kind: pa.DataType = pa.large_binary()) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())]).cast(kind)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finalizer of splitmix64)."""
    h = h.astype(U64)
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def powers(n: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    out = np.full(max(n, 1), base, U64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def within(offsets: np.ndarray) -> np.ndarray:
    """The place of each value within its own list."""
    return np.arange(offsets[-1]) - np.repeat(offsets[:-1], np.diff(offsets))


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the values of each list; integer sums wrap."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0, dtype=values.dtype)])
    return total[offsets[1:]] - total[offsets[:-1]]


def hashes(values: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string: each block of 8 bytes is spread together with its place, so no sum of terms that is
    linear in the bytes can cancel; strings of at most 8 bytes and one size never share a hash."""
    offsets, data = raw(values)
    sizes = np.diff(offsets)
    blocks = np.maximum((sizes + 7) >> 3, 1)
    starts = np.concatenate([[0], np.cumsum(blocks)])
    flat_ = np.zeros(8 * starts[-1], np.uint8)
    flat_[np.repeat(8 * starts[:-1] - offsets[:-1], sizes) + np.arange(len(data))] = data
    with np.errstate(over="ignore"):
        place = within(starts).astype(U64) * U64(0x9E3779B97F4A7C15)
        terms = mix(flat_.view("<u8") ^ mix(place + U64(1)))
        return mix(sums(mix(terms + place), starts) + sizes.astype(U64) * U64(0xC2B2AE3D27D4EB4F))


def gather(offsets: np.ndarray, data: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists in the given order (repeats allowed), as offsets and values."""
    sizes = np.diff(offsets)[order]
    out = np.concatenate([[0], np.cumsum(sizes)])
    return out, data[np.repeat(offsets[:-1][order] - out[:-1], sizes) + np.arange(out[-1])]


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Offsets of the runs of equal keys."""
    n = len(sorted_keys)
    if not n:
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1, [n]])


def packed(pids: np.ndarray, rows: np.ndarray, n: int) -> Iterator[tuple[int, bytes]]:
    """The structured rows of each partition as one value, for an exchange without a JVM row for each."""
    order = np.argsort(pids, kind="stable")
    edges = np.searchsorted(pids[order], np.arange(n + 1))
    for p in np.flatnonzero(np.diff(edges)):
        yield int(p), rows[order[edges[p] : edges[p + 1]]].tobytes()


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start and count."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


def held_out(modulus: int, held: int) -> Column:
    return F.coalesce(crc_mod("doc_id", modulus) == held, F.lit(False))


def labelled(documents: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, n: int) -> DataFrame:
    """text, y and doc_id of at most about n labelled documents that may be learned from. The sample is drawn from the
    labels, so that the broadcast side has at most n rows; of several labels of a document the largest counts."""
    y = labels.select("doc_id", F.col(label).alias("y")).filter(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", modulus) != held)).groupBy("doc_id").agg(F.max("y").alias("y"))
    return documents.select("doc_id", "text").join(F.broadcast(bounded_sample(y, "doc_id", n)), "doc_id")
