"""Helpers shared by the corpus operators: shared folders, chunk keys and byte arithmetic."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of the whitespace kind: code points outside space and U+0009..U+000D.
SPACE_WORDS = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one chunk holds on average; chunks grow in number, not in size.
CHUNK_BYTES = 8 << 20

_M1 = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xBF58476D1CE4E5B9)
_M3 = np.uint64(0x94D049BB133111EB)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` where the session names one, else the context's, else a
    new folder of our own, in local sessions only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}")
    return sc.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, codec: str = "snappy", options: Mapping[str, int] | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder, with Parquet's ``options``, and read it back."""
    path = new_path(df.sparkSession, name)
    df.write.options(compression=codec, **(options or {})).parquet(path)
    return _reread(df, path)


def _reread(df: DataFrame, path: str) -> DataFrame:
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def discard(*stored: DataFrame) -> None:
    """Delete tables that ``materialize`` has written, once nothing lazy reads them any more."""
    for df in stored:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Rows up to which a side of a join is broadcast (counted first); beyond, both sides are shuffled.
BROADCAST_ROWS = 1_000_000


def if_small(stored: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table of narrow rows, marked for broadcast if it has at most so many rows (its files' footers tell)."""
    return F.broadcast(stored) if stored.count() <= rows else stored


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts, by one distributed sum."""
    return docs.agg(F.sum(F.octet_length(F.col(text))).alias("b")).first()["b"] or 0


def chunk_of(key: Column, chunks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(chunks)).cast("long")


def row_key() -> list[Column]:
    """(none, id, h): a row's doc_id, text and source as columns without nulls, to bring a decision back to the row."""
    parts = [c for name in ("text", "source") for c in (F.col(name).isNull(), F.col(name))]
    return [F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64(*parts).alias("h")]


def numbered_rows(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose key (``row_key``) is among the different keys, as (row, nth, *columns of keys); rows of equal keys are numbered from 1."""
    joined = docs.select(F.struct("*").alias("row"), *row_key()).join(keys, ["none", "id", "h"])
    return joined.withColumn("nth", F.row_number().over(Window.partitionBy("none", "id", "h").orderBy(F.xxhash64("row"))))


def string_views(array: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string array, and the n + 1 offsets into them; null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
        if isinstance(array, pa.ChunkedArray):
            array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], pa.string())
    array = array.fill_null("").cast(pa.large_string())
    _, offsets, data = array.buffers()
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64, len(array) + 1, array.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans_of_bytes(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Cut rows into runs of about ``most`` bytes, a longer row alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """At each position the next eight bytes as one little-endian number, zeros after the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ascontiguousarray(np.lib.stride_tricks.as_strided(padded.view(), (len(data), 8), (1, 1))).view("<u8").ravel()


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit numbers over all 64 bits (in place where it can)."""
    x = x ^ (x >> np.uint64(30))
    x *= _M2
    x ^= x >> np.uint64(27)
    x *= _M3
    x ^= x >> np.uint64(31)
    return x


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each run, one run after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def joined_roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union-find within a task: the roots (smallest positions) once the pairs (a, b) of positions are joined as well."""
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return root
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(root, up := root[root]):
            root = up


def range_hash(words8: np.ndarray, starts: np.ndarray, lengths: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of data[start : start + length] for each (short) range; words8 is ``eight_bytes(data)``."""
    out = mix(lengths.astype(np.uint64) * _M1 + np.uint64(salt))
    left, at = lengths.astype(np.int64), starts.astype(np.int64)
    live = np.flatnonzero(left > 0)
    while len(live):
        word, rest = words8[at[live]], left[live]
        short = rest < 8
        if short.any():
            keep = (np.uint64(1) << (rest[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
            word[short] &= keep
        out[live] = mix((out[live] ^ word) * _M1 + np.uint64(salt | 1))
        left[live] -= 8
        at[live] += 8
        live = live[~(rest <= 8)]
    return out


def stretch_hash(data: bytes | memoryview, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """As ``range_hash``, for long stretches; a row of two 64-bit numbers each."""
    digest, view = xxhash.xxh3_128_digest, memoryview(data)
    return np.frombuffer(b"".join([digest(view[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]), "<u8").reshape(-1, 2)
