"""What several operators use: tables in the shared folder, let-bindings, hashing of words in Arrow batches."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lexforge.functions.batches import BATCH_BYTES, BATCH_ROWS, bounded_batches  # noqa: F401

_made: dict[str, SparkSession] = {}
#: Folders of tables that ``written`` has made and nothing has freed, oldest first.
_tables: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir``, or, where all runs in one process as in tests, one of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[[^,]*(,\s*\d+)?\])?", spark.sparkContext.master):
            raise RuntimeError("on a cluster spark.checkpoint.dir has to name a folder that all executors see")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lexforge-"))
        path = spark.sparkContext.getCheckpointDir()
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


def _clean() -> None:
    for path, spark in _made.items():
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the JVM has gone before us; the cluster's own sweep takes the folder
            return


atexit.register(_clean)


def written(df: DataFrame, name: str, seen: Observation | None = None, *metrics: Column) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage is cut and lost executors cost nothing.

    ``seen`` gets the metrics of the rows as they are written, which saves reading them for it.
    """
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/lexforge-{spark.sparkContext.applicationId}"
    _made[root] = spark
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    (df.observe(seen, *metrics) if seen else df).write.parquet(path)
    _tables[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def made_since(before: set[str] | None = None) -> set[str]:
    """Folders of the tables that there are now and weren't in ``before``."""
    return set(_tables) - (before or set())


def free(*tables: DataFrame | str) -> None:
    """Delete tables made by ``written``, or their folders, that nothing reads any more."""
    for t in tables:
        path = t if isinstance(t, str) else t._written_at
        if spark := _tables.pop(path, None):
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Keys of over HOT_ROWS rows, and of over one HOT_KEYS-th of all rows, are hot: there are HOT_KEYS of them at most.
HOT_ROWS = 500
HOT_KEYS = 50_000


def spread_join(rows: DataFrame, groups: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """``rows`` joined with ``groups`` (one row a key, ``n`` is how many of the ``total`` rows have it): hot keys by a broadcast, so that no task
    gets all rows of one; the others by a shuffle."""
    hot = F.col(n) > max(HOT_ROWS, total // HOT_KEYS)
    few = groups.filter(hot)
    return rows.join(F.broadcast(few), key).unionByName(rows.join(F.broadcast(few.select(key)), key, "left_anti").join(groups.filter(~hot), key))


def sent_or_shuffled(small: DataFrame, most: int) -> DataFrame:
    """``small``, to be broadcast if it has ``most`` rows at most."""
    return F.broadcast(small) if small.count() <= most else small


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, though ``body`` (or a lambda in it) names it many times."""
    return F.transform(F.array(value), body)[0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folded(docs: DataFrame, keep: tuple[str, ...]) -> tuple[DataFrame, list[Column]]:
    """``docs`` as the columns ``keep`` and one struct ``__rest`` of all others, and the columns that bring ``docs`` back.

    An operator that adds columns of its own can't clash with columns in the struct.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in keep]
    narrow = docs.select(*keep, F.struct(F.lit(True).alias("__one"), *rest).alias("__rest"))
    return narrow, [F.col(c) if c in keep else F.col("__rest").getField(c).alias(c) for c in docs.columns]


# ---- Arrow batches -------------------------------------------------------------------------------------------

#: Keeps the first 0 to 8 bytes of a little-endian integer.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _salt(k: int) -> np.uint64:
    return np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on unsigned 64-bit integers; a permutation of them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_table(raw: bool) -> np.ndarray:
    """256 entries: 0 separates words, any other value is the byte that enters the hash.

    raw: words are what stands between ASCII white space. Else they are runs of letters and digits, ASCII letters
    in lower case, all bytes from 0x80 as they are.
    """
    to = np.arange(256, dtype=np.uint8)
    if raw:
        to[[0x20, 9, 10, 11, 12, 13]] = 0
        return to
    to[:128] = 0
    for c in range(128):
        if chr(c).isalnum():
            to[c] = ord(chr(c).lower())
    return to


WORDS = word_table(False)


def stretches(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of true values start and end."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    return edge[::2], edge[1::2]


def span_hashes(code: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of code[start:end] for each start and end, eight bytes at a time. Spans of one length up to 8 never collide."""
    eights = np.ndarray(len(code) + 1, "<u8", np.concatenate((code, np.zeros(8, np.uint8))), strides=(1,))
    left = end - start
    out = mix(left.astype(np.uint64) + _salt(2 * seed + 1))
    live, at = np.arange(len(start)), start
    while len(live):
        out[live] = mix(out[live] ^ (eights[at] & _FIRST[np.minimum(left, 8)]))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return out


def hashed_words(texts: list[bytes], to: np.ndarray = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and for each text how many it has. A text may be of any length."""
    code = to[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    start, end = stretches(code != 0)
    stops = np.cumsum([len(t) + 1 for t in texts])
    return span_hashes(code, start, end), np.diff(np.searchsorted(start, stops), prepend=0)


def chunks(batches, most: int = 1 << 21):
    """(batch, from, to) with at most ``most`` bytes of text each, or one text; the batches have a column ``text``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column("text").cast(pa.large_binary())])
        at = 0
        while at < len(sizes):
            to = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), most)))
            yield batch.slice(at, to - at)
            at = to
    give_back()


def give_back() -> None:
    """Return to the system what a worker, which other tasks will use again, has freed."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def bytes_of(batch) -> list[bytes]:
    return [x or b"" for x in batch.column("text").cast(pa.large_binary()).to_pylist()]
