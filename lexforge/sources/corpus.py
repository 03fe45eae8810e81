"""Where texts come from and go to: directories of files, tables, shards of JSON lines."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexforge.functions import text as X
from lexforge.functions.patterns import ALLOWED_LICENSES

RECORD = "path string, text string, sha256 string"
#: Hashes of copies that are broadcast at most.
BROADCAST_KEYS = 1 << 17
STATUS = ("decode", "size", "secret", "license", "dedup", "kept")


def corpus_files(spark: SparkSession, directory: str, extensions: Iterable[str], max_bytes: int = 5_000_000) -> DataFrame:
    """path, length and content of the files of a tree that have a wanted suffix and aren't too large.

    Both filters are on metadata: content that isn't selected isn't read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory)
    return wanted(files, extensions, max_bytes).select("path", "length", "content")


def wanted(files: DataFrame, extensions: Iterable[str], max_bytes: int, min_bytes: int = 0) -> DataFrame:
    """Rows (path, length and others) of a wanted suffix, in any case, and a size within the bounds."""
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return files.filter(F.col("length").between(min_bytes, max_bytes) & suffix.isin([e.lower() for e in extensions]))


def gathered(files: DataFrame, extensions: Iterable[str], n: int) -> DataFrame:
    """The first ``n`` files by path of a wanted suffix."""
    return wanted(files, extensions, 2**62).orderBy("path").limit(n)


def holdout(files: DataFrame, extensions: Iterable[str], n: int, seed: int = 42, min_bytes: int = 200, max_bytes: int = 200_000) -> DataFrame:
    """``n`` files chosen by a seeded hash of the path among those of a wanted suffix and size, with their ``kind`` (the suffix)."""
    chosen = seeded_sample(wanted(files, extensions, max_bytes, min_bytes), "path", seed, n)
    return chosen.withColumn("kind", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))


def decoded(files: DataFrame) -> DataFrame:
    """path and text; null where the content is no valid UTF-8. Line ends become \\n."""
    valid = F.expr("is_valid_utf8(CAST(content AS STRING))") if "content" in files.columns else F.lit(True)
    return files.select("path", F.when(valid, X.normal_newlines(F.col("content").cast("string"))).alias("text"))


def judged(records: DataFrame, secrets: bool = True, licenses: bool = False, allowed: Iterable[str] = ALLOWED_LICENSES) -> DataFrame:
    """path, text, sha256 and status of every record.

    Of equal texts that pass all else one of the smallest path is kept, also if records are repeated. Rejection depends on the text alone, so
    the order of records doesn't matter, and copies are found without it: hashes and paths are counted, and only those that occur more than once are joined
    with the records (by a broadcast, if they are BROADCAST_KEYS at most, so that texts stay where they are).
    """
    t = F.col("text")
    reject = F.when(t.isNull(), "decode").when(t == "", "size")
    if secrets:
        reject = reject.when(X.secret_name(t).isNotNull(), "secret")
    if licenses:
        reject = reject.when(~X.license_allowed(t, allowed), "license")
    hashed = records.select("path", "text", F.sha2("text", 256).alias("sha256"))
    times = hashed.filter("text <> ''").groupBy("sha256", "path").agg(F.count("*").alias("n"))
    # the least path, null paths last; several records may have it
    best = F.min(F.struct(F.col("path").isNull().alias("none"), "path", "n")).alias("best")
    copies = times.groupBy("sha256").agg(best, F.sum("n").alias("total")).filter("total > 1").select("sha256", F.col("best.path").alias("__first"), F.col("best.n").alias("__times")).persist()
    few, repeated = copies.count() <= BROADCAST_KEYS, not copies.filter("__times > 1").isEmpty()
    rows = hashed.join(F.broadcast(copies) if few else copies, "sha256", "left")
    other = F.col("__times").isNotNull() & ~F.col("path").eqNullSafe(F.col("__first"))
    tied = F.coalesce(~other & (F.col("__times") > 1), F.lit(False))
    status = F.coalesce(reject, F.when(other, "dedup").otherwise("kept")).alias("status")
    if not repeated:
        return rows.select("path", "text", "sha256", status)
    # records that are equal in all are counted, and as many rows of them come back
    equal = rows.filter(tied).groupBy("path", "text", "sha256").agg(F.count("*").alias("__n")).withColumn("__k", F.explode(F.sequence(F.lit(1).cast("long"), "__n")))
    equal = equal.select("path", "text", "sha256", F.coalesce(reject, F.when(F.col("__k") == 1, "kept").otherwise("dedup")).alias("status"))
    return rows.filter(~tied).select("path", "text", "sha256", status).unionByName(equal)


def exact_dedup(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """sha256 and the least ``key`` of each distinct text that isn't null."""
    return rows.filter(F.col(text).isNotNull()).groupBy(F.sha2(text, 256).alias("sha256")).agg(F.min(key).alias(key))


def ingest_stats(judged_: DataFrame) -> DataFrame:
    """One row: records of each status, and bytes kept."""
    count = [F.count_if(F.col("status") == s).alias("n_kept" if s == "kept" else f"dropped_{s}") for s in STATUS]
    return judged_.agg(F.count("*").alias("n_seen"), *count, F.coalesce(F.sum(F.when(F.col("status") == "kept", F.octet_length("text"))), F.lit(0)).cast("long").alias("bytes_kept"))


def private_use_inventory(records: DataFrame) -> DataFrame:
    """codepoint and the number of records that hold it."""
    return records.select(F.explode(X.private_use_codepoints("text")).alias("codepoint")).groupBy("codepoint").agg(F.count("*").alias("n_docs"))


def first_of_each(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """The row of least ``order`` for each key."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(order))).filter("__n = 1").drop("__n")


def round_robin(rows: DataFrame, source: str, order: str) -> DataFrame:
    """``rows`` with ``turn``: the first rows of all sources come first, then the second ones."""
    return rows.withColumn("turn", F.row_number().over(W.partitionBy(source).orderBy(order)).cast("long"))


def seeded_sample(rows: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """``n`` rows of least hash of the seed and the key."""
    return rows.withColumn("__h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)).orderBy("__h", key).limit(n).drop("__h")


def hub_split(rows: DataFrame, licenses: Iterable[str], prefix: str = "0", shortest: int = 100, longest: int = 200_000, allowed: Iterable[str] = ALLOWED_LICENSES) -> DataFrame:
    """content, sha256 and split of rows whose licence and length fit, once for each content."""
    fit = rows.filter(X.any_license_allowed(licenses, allowed) & F.length("content").between(shortest, longest))
    return fit.select("content", F.sha2("content", 256).alias("sha256"), X.split_of("content", prefix).alias("split")).dropDuplicates(["sha256"])


def sharded(records: DataFrame, most: int) -> DataFrame:
    """``records`` (path, text, sha256) with ``shard``: within a partition a new shard starts where a line of JSON would take the current one
    over ``most`` bytes (line ends included, uncompressed), unless that one is empty."""
    line = records.select("path", "text", "sha256").withColumn("__size", F.octet_length(F.to_json(F.struct("path", "text", "sha256"))) + 1)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, shard, held = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            out = []
            for n in batch.column("__size").to_pylist():
                if held and held + n > most:
                    shard, held = shard + 1, 0
                held += n
                out.append(first + shard)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.int64())], names=["path", "text", "sha256", "shard"])

    return line.mapInArrow(number, RECORD + ", shard long")


def write_shards(records: DataFrame, path: str, rows_per_file: int = 0, bytes_per_shard: int = 0) -> None:
    """JSON lines, compressed; at most ``rows_per_file`` rows or ``bytes_per_shard`` bytes in a file, if given."""
    rows = sharded(records, bytes_per_shard) if bytes_per_shard else records.select("path", "text", "sha256")
    out = rows.write.mode("overwrite").option("compression", "gzip")
    out = out.partitionBy("shard") if bytes_per_shard else out
    (out.option("maxRecordsPerFile", rows_per_file) if rows_per_file else out).json(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORD).option("mode", "FAILFAST").json(path).select("path", "text", "sha256")


def corpus_hash(records: DataFrame) -> DataFrame:
    """One row with the hash of the hashes of all contents; it depends on neither files nor order.

    Hashes are first combined within 4,096 groups, so no task gathers all of them.
    """
    joined = lambda c: F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(c))), 256)
    part = records.groupBy(F.substring("sha256", 1, 3).alias("part")).agg(joined("sha256").alias("h"))
    return part.agg(joined(F.concat("part", F.lit(":"), "h")).alias("corpus_hash"))
