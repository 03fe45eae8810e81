"""Histogram sort: shards of nearly equal bytes, cut out of the sorted order of the documents.

The sort key is a chain of hashes (of the text, then of doc_id, then of the row's place), so equal texts lie side by side
and a heavy group of copies can still be cut. Exact bytes below candidate boundaries are counted over all partitions,
round by round: a round splits the cells that hold a wanted splitter 4,096-fold. A splitter that is within the tolerance is
kept where it is, so groups are cut only where the tolerance asks for it. Then each row knows its shard, and the rows
are exchanged once. A round brings at most (shards - 1) * 4,096 counts to the driver, whatever the size of the input.

DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexforge.llm.shared import table, written

SHARDS = 24
TOLERANCE = 0.002
BITS = 63
DIGIT = 12
KEYS = ("k_text", "k_doc", "k_row")
CELLS = 4096
RESULT = ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@dataclass
class _Cell:
    """A stretch of the key order: the rows whose keys so far equal ``fixed`` and whose next key starts with ``prefix``."""

    fixed: tuple[int, ...] = ()
    prefix: int = 0
    bits: int = 0
    below: int = 0
    wanted: list[int] = field(default_factory=list)

    def holds(self) -> Column:
        c = F.lit(True)
        for k, v in zip(KEYS, self.fixed, strict=False):
            c = c & (F.col(k) == v)
        if self.bits and len(self.fixed) < len(KEYS):
            c = c & (F.shiftright(F.col(KEYS[len(self.fixed)]), BITS - self.bits) == self.prefix)
        return c

    def step(self) -> int:
        return min(DIGIT, BITS - self.bits)

    def key(self) -> Column:
        return F.col(KEYS[len(self.fixed)])

    def digit(self) -> Column:
        shift = BITS - self.bits - self.step()
        return F.shiftright(self.key(), shift).bitwiseAND(F.lit((1 << self.step()) - 1).cast("long"))

    def start(self) -> tuple[int, ...]:
        if len(self.fixed) == len(KEYS):
            return self.fixed
        at = (*self.fixed, self.prefix << (BITS - self.bits))
        return at + (0,) * (len(KEYS) - len(at))

    def inner(self, digit: int, below: int) -> _Cell:
        bits, prefix = self.bits + self.step(), (self.prefix << self.step()) | digit
        return _Cell((*self.fixed, prefix), 0, 0, below) if bits == BITS else _Cell(self.fixed, prefix, bits, below)


def splitters(rows: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[tuple[int, ...]]:
    """Keys at which shards 1, 2, ... begin. rows: ``size`` and the columns KEYS."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    goals = [total * i // shards for i in range(1, shards)]
    near = max(1, int(tolerance * total / shards))
    found: dict[int, tuple[int, ...]] = {}
    open_cells = [_Cell(wanted=list(goals))] if total else []
    while open_cells:
        which = F.lit(None).cast("int")
        for i, c in reversed(list(enumerate(open_cells))):
            which = F.when(c.holds(), F.lit(i)).otherwise(which)
        chosen = lambda of: F.element_at(F.array(*[of(c) for c in open_cells]), F.col("cell") + 1)
        held = rows.withColumn("cell", which).filter("cell IS NOT NULL").select("cell", "size", chosen(_Cell.digit).alias("digit"), chosen(_Cell.key).alias("key"))
        counts = held.groupBy("cell", "digit").agg(F.sum("size").alias("bytes"), F.min("key").alias("low"), F.max("key").alias("high"))
        by: dict[int, list[tuple[int, int, int | None]]] = {}
        for r in counts.collect():
            by.setdefault(r["cell"], []).append((r["digit"], r["bytes"], r["low"] if r["low"] == r["high"] else None))
        deeper = []
        for i, c in enumerate(open_cells):
            below = c.below
            parts = []
            for d, n, only in sorted(by.get(i, []), key=lambda x: x[0]):
                # a cell with one key is known to its last bit
                part = c.inner(d, below) if only is None else _Cell((*c.fixed, only), 0, 0, below)
                parts.append((part, below, below + n))
                below += n
            for goal in c.wanted:
                k = next((j for j, (_, _, end) in enumerate(parts) if goal < end), len(parts) - 1)
                part, first, end = parts[k]
                last = len(part.fixed) == len(KEYS)
                # the end of a cell is the start of the next one; past the last cell of all lies no row
                if goal - first <= near or last and (goal - first <= end - goal or k + 1 == len(parts)):
                    found[goal] = part.start()
                elif k + 1 < len(parts) and (end - goal <= near or last):
                    found[goal] = parts[k + 1][0].start()
                else:
                    part.wanted.append(goal)
                    if part not in deeper:
                        deeper.append(part)
        open_cells = deeper
    return [found[g] for g in goals] if found else []


def _at_or_after(key: tuple[int, ...]) -> Column:
    a, b, c = (F.col(k) for k in KEYS)
    x, y, z = key
    return (a > x) | ((a == x) & ((b > y) | ((b == y) & (c >= z))))


def histogram_shards(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and the columns ``carry`` for every row of ``docs``.

    Within a shard rows are numbered in the order of cells of the key; a cell is a stretch of the text's hash, and heavy cells
    (many rows, such as copies of one text) are cut by a hash of the row's place, so that no task numbers a heavy group alone, not even one of repeated rows.
    A carried column that is named as a column of the result gets ``_carried`` at its end.
    A null text has size 8 and the checksum of no bytes; a null doc_id is a key like any other; repeated rows are told apart by their
    place; an empty table gives no rows. With fewer rows than shards some shards are empty.
    """
    positive = lambda *c: F.shiftrightunsigned(F.xxhash64(*c), 1)
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        positive(text).alias("k_text"), positive("doc_id").alias("k_doc"), F.monotonically_increasing_id().alias("__row"), F.struct(F.lit(True).alias("__one"), *[F.col(f"`{c}`") for c in carry]).alias("__carry"),
    )
    rows = written(slim.withColumn("k_row", positive("__row")).drop("__row"), "keys")  # the text is read this once
    shard = F.lit(0)
    for key in splitters(rows, shards, tolerance):
        shard = shard + F.when(_at_or_after(key), 1).otherwise(0)
    width = (CELLS - 1).bit_length()
    cell = F.shiftright("k_text", BITS - width)
    heavy = rows.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"))  # CELLS rows at most
    mean = heavy.agg(F.avg("n").alias("mean"))
    # as many parts as keep a part near the mean, by the leading bits of the hash of the row's place; never over CELLS, as no cell has more rows than all have
    parts = heavy.join(F.broadcast(mean)).select("cell", F.when(F.col("n") > 4 * F.col("mean"), F.ceil(F.col("n") / F.col("mean")).cast("int")).otherwise(F.lit(1)).alias("parts"))
    part = (F.shiftright("k_row", BITS - 31) * F.col("parts")).cast("long")
    placed = rows.withColumns({"shard": shard, "cell": cell}).join(F.broadcast(parts), "cell").withColumn("part", F.shiftright(part, 31).cast("int"))
    # cells are few (CELLS and the parts of heavy ones, cut at most shards - 1 times more), so where each starts is broadcast too
    starts = placed.groupBy("shard", "cell", "part").agg(F.count("*").alias("n"))
    before = W.partitionBy("shard").orderBy("cell", "part").rowsBetween(W.unboundedPreceding, -1)
    starts = starts.select("shard", "cell", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = W.partitionBy("shard", "cell", "part").orderBy(*KEYS)
    out = placed.withColumn("__place", F.row_number().over(inside)).join(F.broadcast(starts), ["shard", "cell", "part"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("__place") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *[F.col("__carry").getField(c).alias(f"{c}_carried" if c in RESULT else c) for c in carry])


def op1_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram_shards(table(spark, sf_dir, "documents"))
