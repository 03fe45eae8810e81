"""BagMinHash near-duplicates: weighted Jaccard over multisets of five-word shingles, at least 0.8.

Signatures. The weight of a shingle is how often it occurs. The weight axis is cut into dyadic intervals [0,1), [1,2), [2,4), ...;
each (shingle, interval) is a Poisson process of points seeded by the shingle, so that two documents see the same points. A point has a time, a
register, and a place in its interval; a bit of its hash sends it to one half of the interval, again and again, until it is
below or above the document's weight (here: one comparison). A register keeps the earliest time of the points below. Two registers agree with exactly the chance of
the weighted Jaccard similarity. Points are only made up to the time by which all registers are likely to be taken; a document
whose registers aren't all taken goes on.

Candidates. Bands of 6 registers, 42 of them: at similarity 0.8 a pair has no band in common once in 340,000 times. Equal texts are
collapsed first. Each bucket links its members to its smallest row, so n members give n - 1 links and never all
pairs; the components of these links hold every pair that any bucket holds.

Verification. A component goes to one task if it is small. In a large one each row is compared with the head of one bucket first; what classes that makes
are dealt into blocks, and each pair of blocks of different classes is a task. In a task
the exact overlap of multisets decides, and pairs are left out only by proof: two texts are in one class already, or a bound on the
overlap or the triangle inequality of the Jaccard distance rules them out. So no link is lost within a component, whatever its size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexforge.llm.shared import bytes_of, chunks, folded, free, hashed_words, made_since, mix, sent_or_shuffled, spread_join, table, written

SHINGLE = 5
SIMILARITY = 0.8
BAND, BANDS = 6, 42
REGISTERS = BAND * BANDS
UNIT_ROWS = 2000
UNIT_WEIGHT = 3_000_000
SKETCH = 512
#: Rows of three numbers that are broadcast at most, so that texts stay where they are; with more, texts are joined by a shuffle.
BROADCAST_ROWS = 1 << 20

_G = np.uint64(0x9E3779B97F4A7C15)


def _salt(k: int) -> np.uint64:
    return np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))


def shingles(texts: list[bytes], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of each text, and their number; a text of fewer words is one shingle, one without words none."""
    words, n = hashed_words(texts)
    out = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    first = np.cumsum(n) - n
    at = np.repeat(first - (np.cumsum(out) - out), out) + np.arange(out.sum())
    size = np.repeat(np.minimum(n, width), out)
    h = mix(size.astype(np.uint64) + _G)
    for k in range(width):
        use = size > k
        h = np.where(use, mix(h + words[np.minimum(at + k, max(0, len(words) - 1))]) if len(words) else h, h)
    return h, out


def multisets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, weight), sorted by text, then shingle."""
    h, n = shingles(texts)
    doc = np.repeat(np.arange(len(texts)), n)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(h)))


def signatures(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n_docs: int, registers: int = REGISTERS) -> np.ndarray:
    """Registers of each document, as times; infinite where a document has no shingle.

    Points are made in stretches of time. After each, a document all of whose registers are taken is done: what comes later is later than its
    slowest register. The others go on from where they are.
    """
    out = np.full(n_docs * registers, np.inf)
    total = np.bincount(doc, weight, n_docs)
    unit = np.divide(1, total, out=np.zeros(n_docs), where=total > 0)
    end = unit * max(1.0, np.log(registers) - 1)
    # one process for each shingle and level
    parts = []
    for level in range(int(weight.max()).bit_length() + 1 if len(weight) else 0):
        low, width = (0, 1) if level == 0 else (1 << (level - 1), 1 << (level - 1))
        some = np.flatnonzero(weight > low)
        if not len(some):
            break
        parts.append((doc[some], weight[some], np.full(len(some), low), np.full(len(some), width), mix(h[some] + _salt(level))))
    if not parts:
        return out.reshape(n_docs, registers)
    d, w, low, width, seed = (np.concatenate(x) for x in zip(*parts, strict=True))
    step = np.ones(len(d), np.uint64)
    salted = np.uint64(0x9E3779B97F4A7C15)
    point = lambda some: mix(seed[some] + step[some] * salted)
    gap = lambda r, some: -np.log(((r >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / (width[some] * registers)
    everything = slice(None)
    now = point(everything)
    time = gap(now, everything)
    while len(d):
        live = np.flatnonzero(time < end[d])
        while len(live):
            q = mix(now[live] ^ np.uint64(0xD6E8FEB86659FD93))
            register = ((q >> np.uint64(32)) * np.uint64(registers)) >> np.uint64(32)
            place = low[live] + (((q & np.uint64(0xFFFFFFFF)) * width[live].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
            below = place < w[live]
            np.minimum.at(out, d[live[below]] * registers + register[below].astype(np.int64), time[live[below]])
            step[live] += np.uint64(1)
            now[live] = point(live)
            time[live] += gap(now[live], live)
            live = live[time[live] < end[d[live]]]
        more = np.isinf(out.reshape(n_docs, registers)).any(axis=1)
        left = more[d]
        d, w, low, width, seed, step, now, time = (x[left] for x in (d, w, low, width, seed, step, now, time))
        end[more] += unit[more]
    return out.reshape(n_docs, registers)


def band_keys(sig: np.ndarray) -> np.ndarray:
    bits = sig.view(np.uint64).reshape(len(sig), BANDS, BAND)
    key = mix(np.arange(BANDS, dtype=np.uint64) + _G)[None, :].repeat(len(sig), 0)
    for k in range(BAND):
        key = mix(key + bits[:, :, k])
    return key.view(np.int64)


_ADDED = ["__nd_row", "__nd_key", "__nd_weight", "__nd_bands"]


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 36
    for batch in chunks(batches):
        texts = bytes_of(batch)
        doc, h, weight = multisets(texts)
        total = np.bincount(doc, weight, len(texts)).astype(np.int64)
        keys = band_keys(signatures(doc, h, weight, len(texts)))
        n = np.where(total > 0, BANDS, 0)
        bands = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(keys[total > 0].ravel()))
        added = [pa.array(np.arange(row, row + len(texts))), pa.array([hashlib.md5(t).digest() if t else None for t in texts], pa.binary()), pa.array(total), bands]
        yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *_ADDED])
        row += len(texts)


def components(edges: DataFrame) -> DataFrame:
    """(v, root): the smallest vertex of each vertex's component, for the vertices of ``edges`` (a, b).

    Alternates large and small stars until every edge leads to a smallest vertex. Stars are made with a minimum per vertex and a join, in
    which vertices of very many edges are broadcast: their edges are neither collected nor dealt to one task.
    """
    metrics = (F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("hash"))
    seen = Observation()
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges", seen, *metrics)
    mark = seen.get
    while True:
        before, total = mark, mark["n"]
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n")), "least")
        large = spread_join(both.filter("b > a"), least, "a", "n", 2 * total).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.union(least.filter("m < a").select("a", F.col("m").alias("b"))).filter("a > b").distinct(), "large")
        low = written(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "low")
        small = spread_join(large, low, "a", "n", total).select(F.col("b").alias("a"), F.col("m").alias("b"))
        seen = Observation()
        new = written(small.union(low.select("a", F.col("m").alias("b"))).filter("a > b").distinct(), "edges", seen, *metrics)
        free(now, least, large, low)
        now, mark = new, seen.get
        if mark == before:
            return now.select(F.col("a").alias("v"), F.col("b").alias("root")).union(now.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct())


class Classes:
    """Exact classes among the texts of one task: connected by weighted Jaccard similarity of at least ``least``."""

    def __init__(self, texts: list[bytes], least: float = SIMILARITY, known: list | None = None):
        """known: what class each text is in already; texts of one class are in one from the start."""
        doc, h, weight = multisets(texts)
        cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
        self.sets = [(h[a:b], weight[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        self.total = np.array([w.sum() for _, w in self.sets], np.int64)
        self.sketch = np.zeros((len(texts), SKETCH), np.uint16 if not len(weight) or self.total.max() < 65536 else np.uint32)
        np.add.at(self.sketch, (doc, (h % np.uint64(SKETCH)).astype(np.int64)), weight.astype(self.sketch.dtype))
        self.least = least
        first: dict = {}
        self.parent = [first.setdefault(c, i) for i, c in enumerate(known)] if known else list(range(len(texts)))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def overlap(self, i: int, j: int) -> int:
        (a, v), (b, w) = self.sets[i], self.sets[j]
        _, x, y = np.intersect1d(a, b, assume_unique=True, return_indices=True)
        return int(np.minimum(v[x], w[y]).sum())

    def linked(self, i: int, j: int) -> tuple[bool, float]:
        o = self.overlap(i, j)
        whole = int(self.total[i] + self.total[j]) - o
        return o > 0 and o * 1_000_000 >= round(self.least * 1_000_000) * whole, 1 - o / whole if whole else 1.0

    def run(self) -> list[int]:
        """The root of each text. A ball is a text and others linked to it, with their distances from it."""
        far = 1 - self.least + 1e-9
        heads: list[int] = []
        members: list[list[tuple[int, float]]] = []
        widest: list[float] = []
        for x in range(len(self.parent)):
            home = None
            if heads and self.total[x]:
                h = np.array(heads)
                most = np.minimum(self.sketch[h], self.sketch[x]).sum(axis=1, dtype=np.int64)  # no overlap can be larger
                apart = 1 - most / (self.total[h] + self.total[x] - most)
                for b in np.flatnonzero(apart <= far + np.array(widest)):
                    if self.find(heads[b]) == self.find(x):
                        continue
                    near, d = self.linked(x, heads[b])
                    if near:
                        self.join(x, heads[b])
                        if home is None:
                            home = b, d
                        continue
                    for y, e in members[b]:
                        if d - e <= far and self.linked(x, y)[0]:
                            self.join(x, y)
                            break
            if home is None:
                heads.append(x), members.append([]), widest.append(0.0)
            else:
                members[home[0]].append((x, home[1]))
                widest[home[0]] = max(widest[home[0]], home[1])
        return [self.find(i) for i in range(len(self.parent))]

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.parent[max(i, j)] = min(i, j)


def _verify(unit: pa.Table) -> pa.Table:
    """Links that join the classes of a unit: row, text and class as known so far."""
    unit = unit.sort_by("row")
    row = unit.column("row").to_numpy()
    known = unit.column("class").to_pylist()
    roots = Classes([t or b"" for t in unit.column("text").cast(pa.large_binary()).to_pylist()], known=known).run()
    return pa.table({"a": row, "b": row[roots]})


def _verify_star(unit: pa.Table) -> pa.Table:
    """The rows of a part of a star that are linked to its head."""
    row, head = unit.column("row").to_numpy(), unit.column("head").to_numpy()
    texts = unit.column("text").cast(pa.large_binary()).to_pylist()
    at = int(np.flatnonzero(row == head)[0])
    classes = Classes([t or b"" for t in texts])
    hit = np.array([i != at and classes.linked(i, at)[0] for i in range(len(row))])
    return pa.table({"a": row[hit], "b": head[hit]})


def _parts(rows, weight):
    """In how many parts so many rows of so much weight go."""
    return F.greatest(F.ceil(rows / UNIT_ROWS), F.ceil(weight / UNIT_WEIGHT), F.lit(1)).cast("int")


def _links(grouped: DataFrame, candidates: DataFrame, rows: DataFrame) -> tuple[DataFrame, bool]:
    """(a, b): verified links that connect every class within the components ``grouped`` (v, root), and no others; whether each b is the smallest of its class.

    A component that fits in a task is one. In a larger one each row is first compared with the head of one of its buckets; rows so linked
    are one class. Then classes are dealt into blocks (a large one has blocks of its own, small ones share), and each pair of blocks is a
    task, unless both are of one class. So a large group of copies takes tasks in proportion to its rows, not to their square.
    """
    weights = rows.select(F.col("__nd_row").alias("v"), F.col("__nd_weight").alias("w"))
    total = grouped.count()
    sized = written(weights.join(sent_or_shuffled(grouped, BROADCAST_ROWS), "v"), "sized")
    sizes = written(sized.groupBy("root").agg(F.count("*").alias("n"), F.sum("w").alias("w")).withColumn("parts", _parts(F.col("n"), F.col("w"))), "sizes")
    text_of = lambda units: rows.select("__nd_row", "text").join(sent_or_shuffled(units, BROADCAST_ROWS), "__nd_row").withColumnRenamed("__nd_row", "row")
    small = sized.join(sizes.filter("parts > 1"), "root", "left_anti").select(F.col("v").alias("__nd_row"), "root", F.col("v").alias("class"))
    links = text_of(written(small, "units")).groupBy("root").applyInArrow(_verify, "a long, b long").filter("a <> b")
    if sizes.filter("parts > 1").isEmpty():
        return links, True  # each component was in one task, which has found whole classes
    links = written(links, "links")
    large = written(spread_join(sized.withColumnRenamed("w", "weight"), sizes.filter("parts > 1").select("root", "n", "parts"), "root", "n", total), "large")
    heads = candidates.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("head"))
    starred = written(large.select("v", "weight").join(heads, "v"), "starred")
    counts = starred.groupBy("head").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).select("head", "n", _parts(F.col("n"), F.col("w")).alias("chunks"))
    chunk = F.pmod(F.xxhash64("v"), F.col("chunks")).cast("int")
    members = spread_join(starred, written(counts, "counts"), "head", "n", total).select(F.col("v").alias("__nd_row"), "head", chunk.alias("chunk"))
    leaders = counts.select(F.col("head").alias("__nd_row"), "head", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    stars = text_of(written(members.unionByName(leaders), "stars")).groupBy("head", "chunk").applyInArrow(_verify_star, "a long, b long")
    stars = written(stars, "links")
    return links.unionByName(stars).unionByName(_between(large, stars, text_of, total)), False


def _between(large: DataFrame, stars: DataFrame, text_of, total: int) -> DataFrame:
    """Links between the classes that ``stars`` make of the rows of large components (v, root, weight)."""
    found = components(stars).select("v", F.col("root").alias("class"))
    of = written(large.select("v", "root", "weight").join(found, "v", "left").withColumn("class", F.coalesce("class", "v")), "classes")
    classes = of.groupBy("root", "class").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).withColumn("parts", _parts(F.col("n"), F.col("w")))
    many = classes.groupBy("root").agg(F.count("*").alias("k"), F.sum(F.when(F.col("parts") == 1, F.col("n")).otherwise(0)).alias("n1"), F.sum(F.when(F.col("parts") == 1, F.col("w")).otherwise(0)).alias("w1"))
    # components of one class are done
    many = many.filter("k > 1").select("root", (2 * _parts(F.col("n1"), F.col("w1"))).alias("pool"))
    classes = written(classes.join(many, "root"), "classes")
    if classes.isEmpty():
        return stars.limit(0)
    # a block: (class, part) of a large class, (-1, part) of small ones, of which there are two parts at least
    single = F.col("parts") == 1
    own = F.when(single, F.lit(-1)).otherwise(F.col("class")).cast("long").alias("block")
    number = F.when(single, F.col("pool")).otherwise(2 * F.col("parts"))
    place = F.when(single, F.pmod(F.xxhash64("class"), F.col("pool"))).otherwise(F.pmod(F.xxhash64("v"), 2 * F.col("parts"))).cast("int")
    placed = spread_join(of, classes.select("class", "n", "parts", "pool"), "class", "n", total).select("v", "root", "class", own, place.alias("part"))
    groups = classes.select("root", own, number.alias("number")).distinct()
    one, two = (groups.select("root", F.col("block").alias(f"block{k}"), F.col("number").alias(f"number{k}")) for k in (1, 2))
    pairs = one.join(two, "root").filter((F.col("block1") < F.col("block2")) | ((F.col("block1") == -1) & (F.col("block2") == -1)))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(f"number{k}") - 1)).alias(f"part{k}")
    pairs = pairs.select("root", "block1", "block2", "number2", every(1)).select("root", "block1", "block2", "part1", every(2)).filter("block1 < block2 OR part1 < part2")
    pairs = written(pairs.withColumn("unit", F.monotonically_increasing_id()), "pairs")
    sides = [pairs.select("root", F.col(f"block{k}").alias("block"), F.col(f"part{k}").alias("part"), "unit") for k in (1, 2)]
    units = placed.join(sides[0].union(sides[1]), ["root", "block", "part"]).select(F.col("v").alias("__nd_row"), "unit", "class")
    return written(text_of(written(units, "units")).groupBy("unit").applyInArrow(_verify, "a long, b long").filter("a <> b"), "links")


def classed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with ``class_id`` (the smallest doc_id of the class) and ``first`` (true in one row of each class).

    Equal texts are one class. A null or empty text has no copies: its row is a class. A text without letters or digits is in one class
    with its exact copies only. A null doc_id counts as a negative number of its own where it is all that a class has. Repeated rows are copies. The row of
    the smallest doc_id is first; of several such, the one that was read first. A text may be of any length. All columns are kept, but ``class_id`` and ``first``,
    which are replaced; an empty table gives no rows. Words are runs of letters and digits in lower case (ASCII), so a changed
    comma or capital is no difference; a text of one to four words is one shingle.
    """
    docs = docs.drop("class_id", "first")
    schema = T.StructType([*docs.schema.fields, T.StructField("__nd_row", T.LongType()), T.StructField("__nd_key", T.BinaryType()), T.StructField("__nd_weight", T.LongType()), T.StructField("__nd_bands", T.ArrayType(T.LongType()))])
    earlier = made_since()
    rows = written(docs.mapInArrow(_sign, schema), "signed")
    total = rows.count()
    keyed = rows.filter("__nd_key IS NOT NULL").select("__nd_key", F.col("__nd_row").alias("row"))
    groups = written(keyed.groupBy("__nd_key").agg(F.min("row").alias("rep"), F.count("*").alias("n")).filter("n > 1"), "groups")
    copies = written(spread_join(keyed, groups, "__nd_key", "n", total).filter("row <> rep").select("row", "rep"), "copies")
    texts = rows.select("__nd_row", "__nd_bands").join(sent_or_shuffled(copies.select(F.col("row").alias("__nd_row")), BROADCAST_ROWS), "__nd_row", "left_anti")
    banded = texts.select(F.col("__nd_row").alias("row"), F.explode("__nd_bands").alias("band"))
    buckets = written(banded.groupBy("band").agg(F.min("row").alias("head"), F.count("*").alias("n")).filter("n > 1"), "buckets")
    links = written(spread_join(banded, buckets, "band", "n", BANDS * total).filter("row <> head").select(F.col("row").alias("a"), F.col("head").alias("b")).distinct(), "candidates")
    grouped = written(components(links), "components")
    found, whole = _links(grouped, links, rows)
    found = written(found, "links")
    free(*made_since(earlier | {t._written_at for t in (rows, copies, found)}))
    roots = found.select(F.col("a").alias("row"), F.col("b").alias("root")) if whole else written(components(found).filter("v <> root").select(F.col("v").alias("row"), "root"), "roots")
    # the copies of a text go where it goes; a text with very many is joined by a broadcast
    times = copies.groupBy("rep").agg(F.count("*").alias("n")).join(roots.select(F.col("row").alias("rep"), "root"), "rep", "left")
    moved = spread_join(copies, times, "rep", "n", total).select("row", F.coalesce("root", "rep").alias("root")).union(roots)
    moved = written(moved, "moved")
    # class ids: only rows of classes of two and more are touched
    ids = rows.select(F.col("__nd_row").alias("row"), "doc_id")
    members = moved.union(moved.select(F.col("root").alias("row"), "root").distinct())
    members = written(ids.join(sent_or_shuffled(members, BROADCAST_ROWS), "row"), "members")
    head = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    least = written(members.groupBy("root").agg(head.alias("head"), F.count("*").alias("n")).select("root", "n", F.col("head.doc_id").alias("least"), F.col("head.row").alias("first")), "least")
    assigned = spread_join(members, least, "root", "n", total).select(F.col("row").alias("__nd_row"), F.col("first").alias("__nd_first"), F.col("least").alias("__nd_least"))
    assigned = written(assigned, "assigned")
    free(*made_since(earlier | {t._written_at for t in (rows, assigned)}))
    assigned = sent_or_shuffled(assigned, BROADCAST_ROWS)
    out = rows.drop("__nd_key", "__nd_weight", "__nd_bands").join(assigned, "__nd_row", "left")
    return out.select(*docs.columns, F.coalesce("__nd_least", "doc_id", -1 - F.col("__nd_row")).alias("class_id"), (F.col("__nd_row") == F.coalesce("__nd_first", "__nd_row")).alias("first"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each class of ``docs``, with all its columns, whatever their names."""
    narrow, back = folded(docs, ("doc_id", "text"))
    return classed(narrow).filter("first").select(*back)


def op6_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id and whether the row is the one of its class that stays."""
    return classed(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "first")
