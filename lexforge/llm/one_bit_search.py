"""Nearest neighbours by randomly rotated one-bit codes.

Index: unit vectors are dealt to the nearest of some centroids, and what is left of a vector beyond its centroid is rotated at random and cut to its signs. The code
is kept packed, with correction scalars: the length of the rest, and the inner product of the rotated rest and its code. Search: a query is rotated
as well and each component rounded to BITS bits. Its inner product with a code is a sum of population counts of packed words; divided by the scalar it estimates the
cosine without bias, and its error is bounded with high probability by a multiple of sqrt((1 - a^2) / a^2 / (D - 1)), a being the scalar, and of
what rounding has left. Each query is compared with a sample of bounded size first; the k-th best of the sample's rows in its cells is a floor. Vectors whose upper bound reaches
the floor are compared exactly, in double precision; where those are many, the best estimates come first and raise the floor.

Every row is in the index. A query looks into the cells whose centroids are nearest. How many, is measured: CALIBRATE queries are compared with all rows, and
the least number that finds a share of RECALL of their neighbours is taken. Where vectors lie in groups that is a few cells, so work grows with queries times cells' rows;
where they lie without any order, as in the tables made for tests, no index can leave out much, and estimates grow with queries times rows, though few vectors are compared exactly. Cells and the queries that look into them are cut into parts of bounded size, and a task gets one part of each. Of equal vectors only the
k + 1 of smallest ids can be among the k nearest of any query, so a vector that very many rows share takes no more room than that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexforge.llm.shared import table, written

NEAREST = 5
EVERY = 50
#: Bits of a code at least (a power of two), and of a query's component.
WIDTH = 256
BITS = 4
#: Standard errors on either side of an estimate.
SPREAD = 4.0
SEED = 20
#: Rows of a cell on average, and cells at most; the centroids are fitted on at most SAMPLE vectors, and at most SAMPLE_BYTES.
CELL = 256
CELLS = 4096
CALIBRATE = 128
RECALL = 0.98
SAMPLE = 1 << 15
SAMPLE_BYTES = 1 << 26
ROUNDS = 6
#: Bytes of the vectors of a part.
PART_BYTES = 1 << 21
#: Pairs of a query and a code that one step of estimating looks at, and components of exact comparisons: they stay in the processor's cache.
STEP = 1 << 16
#: By how much a cosine may be less than a floor, for rounding.
SLACK = 1e-9


def width_of(dim: int) -> int:
    return max(WIDTH, 1 << (dim - 1).bit_length())


def hadamard(size: int) -> np.ndarray:
    h = np.ones((1, 1), np.float32)
    while len(h) < size:
        h = np.block([[h, h], [h, -h]])
    return h


def rotated(x: np.ndarray, width: int) -> np.ndarray:
    """Rows padded with zeros and turned: three times random signs and a Walsh-Hadamard transform, as two products with matrices of about the root of its size."""
    y = np.zeros((len(x), width), np.float32)
    y[:, : x.shape[1]] = x
    rng = np.random.default_rng(SEED)
    right = 1 << width.bit_length() // 2
    outer, inner = hadamard(width // right), hadamard(right)
    for _ in range(3):
        y *= rng.choice(np.array([-1, 1], np.float32), width)
        y = (outer @ (y.reshape(-1, right) @ inner).reshape(len(y), len(outer), right)).reshape(len(y), width)
        y *= np.float32(width**-0.5)
    return y


def units(x: np.ndarray) -> np.ndarray:
    """Scaled first, so that the squares of very large or small components stay finite."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of the rows of x and y, in double precision."""
    with np.errstate(over="ignore", under="ignore"):
        x, y = x / np.abs(x).max(axis=1, keepdims=True), y / np.abs(y).max(axis=1, keepdims=True)
        return (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))


def centroids(x: np.ndarray, cells: int) -> np.ndarray:
    """Means of ``cells`` groups of unit vectors, by rounds of dealing to the nearest; at most as many as there are different vectors."""
    rng = np.random.default_rng(SEED)
    x = x.astype(np.float32)
    c = np.unique(x, axis=0)
    c = c[rng.permutation(len(c))[:cells]]
    for _ in range(ROUNDS if len(c) > 1 else 0):
        near = np.concatenate([np.argmax(x[i : i + 4096] @ c.T, axis=1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.maximum(norm, 1e-30), c)
    return c


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors) for each length of vector."""
    size = np.diff(column.offsets.to_numpy())
    for dim in np.unique(size):
        rows = np.flatnonzero(size == dim)
        yield rows, column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def encoded(rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (64-bit words), lengths, and inner products of rotated unit rests and their codes."""
    length = np.linalg.norm(rest, axis=1)
    y = rotated(np.divide(rest, length[:, None], out=np.zeros_like(rest), where=length[:, None] > 0), width_of(rest.shape[1]))
    return np.packbits(y > 0, axis=1).view("<u8"), length, np.abs(y).sum(axis=1) / np.sqrt(y.shape[1])


def _index(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, x in _by_length(batch.column("embedding")):
            unit, c = units(x), sent.value.get(x.shape[1])
            cell = np.argmax(unit.astype(np.float32) @ c.T, axis=1) if c is not None else np.zeros(len(x), np.int64)
            code, length, a = encoded(unit - c[cell] if c is not None else unit)
            own = batch.take(pa.array(rows))
            added = [pa.array(np.full(len(rows), x.shape[1], np.int32)), pa.array(cell.astype(np.int32)), pa.array([b.tobytes() for b in code], pa.binary()), pa.array(length.astype(np.float32)), pa.array(a.astype(np.float32))]
            yield pa.RecordBatch.from_arrays([*own.columns, *added], names=[*own.schema.names, "dim", "cell", "code", "length", "a"])


def _nearest(batches: Iterator[pa.RecordBatch], queries, k: int) -> Iterator[pa.RecordBatch]:
    """The k nearest of each of a few queries {dim: (ids, unit vectors)} in this part of the index, and their cells."""
    best: dict[int, list[tuple]] = {}
    for batch in batches:
        for rows, x in _by_length(batch.column("embedding")):
            if (asked := queries.value.get(x.shape[1])) is None:
                continue
            score = asked[1] @ units(x).T
            ids, cell = batch.column("vec_id").to_numpy()[rows], batch.column("cell").to_numpy()[rows]
            score[asked[0][:, None] == ids[None]] = -np.inf
            top = np.argsort(-score, axis=1)[:, :k]
            for i, q in enumerate(asked[0].tolist()):
                found = best.get(q, []) + list(zip(score[i, top[i]].tolist(), cell[top[i]].tolist(), strict=True))
                best[q] = sorted((f for f in found if f[0] > -np.inf), reverse=True)[:k]
    flat = [(q, *f) for q, found in best.items() for f in found]
    yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in flat], t) for i, t in enumerate((pa.int64(), pa.float64(), pa.int32()))], names=["query_id", "score", "cell"])


def _probes(index: DataFrame, asking: DataFrame, means: dict[int, np.ndarray], k: int, recall: float) -> dict[int, int]:
    """For each length, into how many cells a query has to look. The driver gets k numbers for each of CALIBRATE queries of a length."""
    spark = index.sparkSession
    dims = [d for d in means if len(means[d]) > 1]
    if not dims:
        return {}
    length = F.size("embedding")
    place = F.row_number().over(W.partitionBy(length).orderBy(F.xxhash64("query_id"), "query_id"))
    some = asking.filter(length.isin(dims)).withColumn("place", place).filter(F.col("place") <= CALIBRATE).select("query_id", "embedding").toArrow()
    if not some.num_rows:
        return {}
    ids = some.column("query_id").to_numpy()
    queries = {x.shape[1]: (ids[rows], units(x)) for rows, x in _by_length(some.column("embedding").combine_chunks())}
    sent = spark.sparkContext.broadcast(queries)
    near = index.select("vec_id", "embedding", "cell").mapInArrow(lambda b: _nearest(b, sent, k), "query_id long, score double, cell int")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "cell")
    cells: dict[int, list[int]] = {}
    for r in near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).collect():
        cells.setdefault(r.query_id, []).append(r.cell)
    out = {}
    for dim, (who, q) in queries.items():
        ranks = np.argsort(np.argsort(-(q.astype(np.float32) @ means[dim].T), axis=1, kind="stable"), axis=1)
        needed = np.sort(np.array([ranks[i, c] for i, w in enumerate(who.tolist()) for c in cells.get(w, [])]))
        out[dim] = 1 + int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) if len(needed) else len(means[dim])
    return out


def _floors(ids: np.ndarray, q: np.ndarray, near: np.ndarray, cells: int, some: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> np.ndarray:
    """For each query (a row of unit vectors q) the k-th largest cosine with the sample's rows (ids, unit vectors, cells) in its cells; -inf if they are fewer."""
    out = np.full(len(q), -np.inf)
    if len(some[0]) < k:
        return out
    n = max(1, 4 * STEP // len(some[0]))
    for lo in range(0, len(q), n):
        looked = np.zeros((len(q[lo : lo + n]), cells), bool)
        np.put_along_axis(looked, near[lo : lo + n], True, 1)
        score = q[lo : lo + n] @ some[1].T
        score[~looked[:, some[2]] | (ids[lo : lo + n, None] == some[0][None])] = -np.inf
        out[lo : lo + n] = np.partition(score, -k, axis=1)[:, -k]
    return out


def _asked(batches: Iterator[pa.RecordBatch], sent, some, probes: dict[int, int], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, x in _by_length(batch.column("embedding")):
            own, dim = batch.take(pa.array(rows)), x.shape[1]
            near, floor = np.zeros((len(x), 1), np.int32), np.full(len(x), -np.inf)
            if (c := sent.value.get(dim)) is not None:
                unit = units(x)
                near = np.argsort(-(unit.astype(np.float32) @ c.T), axis=1, kind="stable")[:, : probes.get(dim, len(c))].astype(np.int32)
                floor = _floors(own.column("query_id").to_numpy(), unit, near, len(c), some.value[dim], k)
            added = [pa.array(np.full(len(rows), dim, np.int32)), pa.array(floor), pa.array(list(near), pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*own.columns, *added], names=[*own.schema.names, "dim", "floor", "cells"])


def estimates(q: np.ndarray, code: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of unit vectors q (rows) with the coded directions (columns), and standard errors, from packed bits."""
    width = code.shape[1] * 64
    y = rotated(q, width)
    low = y.min(axis=1, keepdims=True)
    step = np.maximum((y.max(axis=1, keepdims=True) - low) / ((1 << BITS) - 1), 1e-20)
    level = np.rint((y - low) / step).astype(np.uint8)
    planes = [np.packbits((level >> k) & 1, axis=1).view("<u8") for k in range(BITS)]
    total = np.zeros((len(q), len(code)), np.int32)
    words = np.ascontiguousarray(code.T)
    n = max(1, STEP // max(1, len(code)))
    for lo in range(0, len(q), n):
        for k, plane in enumerate(planes):
            count = np.zeros((len(q[lo : lo + n]), len(code)), np.uint16 if width < 1 << 16 else np.int32)
            for w, word in enumerate(words):
                count += np.bitwise_count(plane[lo : lo + n, w, None] & word)
            total[lo : lo + n] += count.astype(np.int32) << k
    ones = np.bitwise_count(code).sum(axis=1, dtype=np.int64)
    whole = (low + step * level).sum(axis=1, keepdims=True)
    product = (2 * (low * ones + step * total) - whole) / np.sqrt(width)
    rounding = np.linalg.norm(y - (low + step * level), axis=1, keepdims=True) ** 2 / width
    return product / a, np.sqrt(np.maximum(0, 1 - a * a) / (width - 1) + rounding) / a


def compared(q: np.ndarray, x: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Inner products of q[rows] and x[cols], a few at a time."""
    n = max(1, STEP // q.shape[1])
    return np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", q[rows[i : i + n]], x[cols[i : i + n]]) for i in range(0, len(rows), n))])


def candidates(q: np.ndarray, x: np.ndarray, estimate: np.ndarray, error: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the unit vectors q, and of x, for all pairs that may be among the k best of their row of q and reach its floor. An estimate of -inf is no pair."""
    reach = estimate + error
    fine = (reach >= floor[:, None]) & np.isfinite(estimate)
    many = np.flatnonzero(np.count_nonzero(fine, axis=1) > 8 * k)
    if len(many):
        best = np.argpartition(-estimate[many], 8 * k - 1, axis=1)[:, : 8 * k]
        known = compared(q, x, np.repeat(many, 8 * k), best.ravel()).reshape(-1, 8 * k)
        floor = floor.copy()
        floor[many] = np.maximum(floor[many], np.partition(known, -k, axis=1)[:, -k] - SLACK)
        fine[many] &= reach[many] >= floor[many, None]
    rows, cols = np.nonzero(fine)
    score = compared(q, x, rows, cols)
    fine = score >= floor[rows] - SLACK
    rows, cols, score = rows[fine], cols[fine], score[fine]
    order = np.lexsort((-score, rows))
    rows, cols, score = rows[order], cols[order], score[order]
    last = np.searchsorted(rows, rows) + k - 1
    there = np.minimum(last, len(rows) - 1)
    least = np.where((last < len(rows)) & (rows[there] == rows), score[there], -np.inf) if len(rows) else score
    fine = score >= least - SLACK
    return rows[fine], cols[fine]


def _search(key, asked: pa.Table, cell: pa.Table, sent, k: int) -> pa.Table:
    """The k nearest of each query in a part of a cell, without those that are below the query's floor."""
    dim, at = key[0].as_py(), key[1].as_py()
    vectors = lambda t: t.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    who, ids = asked.column("query_id").to_numpy(), cell.column("vec_id").to_numpy()
    if not len(who) or not len(ids):
        return _SCHEMA.empty_table()
    q, x = vectors(asked), vectors(cell)
    unit, there, c = units(q), units(x), sent.value.get(dim)
    code = np.frombuffer(b"".join(cell.column("code").to_pylist()), "<u8").reshape(len(ids), -1)
    length, a = cell.column("length").to_numpy().astype(np.float64), np.maximum(cell.column("a").to_numpy().astype(np.float64), 1e-6)
    floor = asked.column("floor").to_numpy()
    pairs = []
    n = max(1, 4 * STEP // len(ids))
    for lo in range(0, len(who), n):
        some = unit[lo : lo + n]
        estimate, error = estimates(some, code, a)
        # a vector that is its centroid has no rest, hence no error
        estimate = (some @ c[at].astype(np.float64))[:, None] + length * estimate if c is not None else length * estimate
        estimate[who[lo : lo + n, None] == ids[None]] = -np.inf  # a query is no candidate of its own
        rows, cols = candidates(some, there, estimate, SPREAD * length * error + 1e-6, floor[lo : lo + n], k)
        pairs.append((rows + lo, cols))
    rows, cols = (np.concatenate(p) for p in zip(*pairs, strict=True))
    m = max(1, 4 * STEP // dim)
    score = np.concatenate([np.zeros(0), *(cosines(q[rows[i : i + m]], x[cols[i : i + m]]) for i in range(0, len(rows), m))])
    order = np.lexsort((ids[cols], -score, rows))
    rows, cols, score = rows[order], cols[order], score[order]
    top = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return pa.table({"query_id": who[rows[top]], "vec_id": ids[cols[top]], "n": cell.column("n").to_numpy()[cols[top]], "score": score[top]}, schema=_SCHEMA)


_SCHEMA = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("n", pa.int64()), ("score", pa.float64())])


def usable(vectors: DataFrame) -> DataFrame:
    """Rows that take part: an id, and a vector without null or non-finite components that isn't zero."""
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(F.col("vec_id").isNotNull() & fine & F.exists(e, lambda x: x != 0))


def search(vectors: DataFrame, k: int = NEAREST, every: int = EVERY, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each row whose vec_id is divisible by ``every``.

    Vectors are searched among those of their length, whatever it is; very long ones take parts of few rows. A repeated vec_id:
    rows of the query's vec_id are the query's own and no candidates; of several query rows the least vector asks; other rows are candidates
    each. Ties go to the smaller vec_id. Columns but these two are left out. An empty table gives no rows. A query whose cells hold fewer than ``k`` candidates looks into all.
    """
    spark = vectors.sparkSession
    # equal rows are one with a count; of equal vectors, k + 1 ids
    rows = usable(vectors).groupBy("vec_id", "embedding").agg(F.least(F.count("*"), F.lit(k)).alias("n"))
    rows = written(rows.withColumn("place", F.row_number().over(W.partitionBy("embedding").orderBy("vec_id"))).filter(F.col("place") <= k + 1).drop("place"), "vectors")
    lengths = {r[0]: r[1] for r in rows.groupBy(F.size("embedding").alias("dim")).count().collect()}
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    some = min(SAMPLE, max(1, SAMPLE_BYTES // (8 * max(lengths))))
    sample = rows.select("vec_id", "embedding").orderBy(F.xxhash64("embedding"), "embedding", "vec_id").limit(some).toArrow()
    ids, means, firsts = sample.column("vec_id").to_numpy(), {}, {}
    for at, x in _by_length(sample.column("embedding").combine_chunks()):
        if (n := min(CELLS, -(-lengths[x.shape[1]] // CELL))) > 1:
            unit = units(x)
            c = means[x.shape[1]] = centroids(unit, n)
            # floors come from as many of the sample's rows as a part has at most
            unit = unit[: max(1, PART_BYTES // (8 * x.shape[1]))]
            firsts[x.shape[1]] = ids[at[: len(unit)]], unit, np.argmax(unit.astype(np.float32) @ c.T, axis=1)
    sent, sent_firsts = spark.sparkContext.broadcast(means), spark.sparkContext.broadcast(firsts)
    element = vectors.schema["embedding"].dataType.elementType.simpleString()
    index = written(rows.mapInArrow(lambda b: _index(b, sent), f"vec_id long, embedding array<{element}>, n long, dim int, cell int, code binary, length float, a float"), "index")
    asking = usable(vectors).filter(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("embedding").alias("embedding"))
    asking = written(asking, "asking")
    probes = _probes(index, asking, means, k, recall)
    asked = written(asking.mapInArrow(lambda b: _asked(b, sent, sent_firsts, probes, k), f"query_id long, embedding array<{element}>, dim int, floor double, cells array<int>"), "asked")
    found = _found(index, asked.withColumn("cell", F.explode("cells")).drop("cells"), sent, k)
    # a query with fewer than k candidates in its cells (few rows, or nearly all equal to it) is asked of all cells of its length, without a floor
    found = written(found, "found")
    enough = found.groupBy("query_id").agg(F.sum("n").alias("had"))
    short = written(asked.join(enough, "query_id", "left").filter(F.coalesce("had", F.lit(0)) < k).drop("had", "cells").withColumn("floor", F.lit(float("-inf"))), "short")
    if not short.isEmpty():
        everywhere = written(index.select("dim", "cell").distinct().join(short, "dim").select("query_id", "embedding", "dim", "floor", "cell"), "everywhere")
        found = found.join(short.select("query_id"), "query_id", "left_anti").unionByName(_found(index, everywhere, sent, k))
    single = found.withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return single.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _found(index: DataFrame, asked: DataFrame, sent, k: int) -> DataFrame:
    """The k nearest of each query in each part of each cell that it is asked of."""
    # a few thousand cells for each length: their sizes say in how many parts rows and queries go
    most = F.greatest(F.lit(1), F.floor(F.lit(PART_BYTES) / (8 * F.col("dim"))))
    share = lambda d, name: d.groupBy("dim", "cell").agg(F.count("*").alias("n")).select("dim", "cell", F.ceil(F.col("n") / most).cast("int").alias(name))
    sizes = F.broadcast(written(share(index, "parts").join(share(asked, "blocks"), ["dim", "cell"]), "sizes"))
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    mine = lambda c, name: F.pmod(F.xxhash64(c), F.col(name)).cast("int")
    rows = index.join(sizes, ["dim", "cell"]).withColumns({"part": mine("vec_id", "parts"), "block": every("blocks")})
    queries = asked.join(sizes, ["dim", "cell"]).withColumns({"block": mine("query_id", "blocks"), "part": every("parts")})
    key = ["dim", "cell", "part", "block"]
    left = queries.select(*key, "query_id", "floor", "embedding").groupBy(*key)
    right = rows.select(*key, "vec_id", "n", "embedding", "code", "length", "a").groupBy(*key)
    return left.cogroup(right).applyInArrow(lambda at, q, c: _search(at, q, c, sent, k), "query_id long, vec_id long, n long, score double")


def op2_one_bit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
