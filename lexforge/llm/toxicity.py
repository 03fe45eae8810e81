"""Toxicity by two Kneser-Ney models, one of toxic and one of ordinary texts.

A model gives a word the chances of its bytes, one after another, and of its end, each given the six bytes before it in the word (fewer at its start). An
expression is such a stretch of at most ORDER bytes, so forms and compounds of a word share what they have in common, and a word that was never
seen has a likelihood in both models. All stretches of all labelled texts are in the models, however rare.

    p_c(x | h)  = max(c_c(hx) - D_c, 0) / c_c(h) + L_c(h) P(x | h'),   L_c(h) = sum of min(c_c(hx), D_c) over x / c_c(h)
    P(x | h)    = max(n(hx) - D, 0) / n(h) + L(h) P(x | h'),           n(hx): distinct bytes before hx, both classes; P(x) backs off to 1/256

h' is h without its first byte. If h isn't known, p is what it backs off to. Below the longest stretches all counts are shared, so what is rare speaks for
neither class. c_c counts an expression once for each word that it is in and each word before that: copies of a text, near ones as well, and
repeated lines count once. The discount of the longest stretches is proportional to a class's size, so that an expression spread as the classes are has equal
chances in both.

A toxic text isn't toxic in every word: each of its words comes from the toxic model with chance SHARE, else from the ordinary one. So a
text's log-likelihood ratio is the sum of log(1 - SHARE + SHARE p_toxic / p_ordinary) over its words. It is normalised by the text's length and its root, and
calibrated on labelled texts that took no part in the counts (folds 1 to 3 are counted, fold 4 calibrates, fold 0 is held out).

A stretch of seven bytes is one integer, so nothing is hashed in the models.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm.shared import WORDS, bytes_of, chunks, span_hashes, stretches, table, written

ORDER = 7
DISCOUNT = 0.75
#: Of the longest stretches, in the smaller class.
TOP_DISCOUNT = 3.0
SHARE = 0.005
#: Expressions that are broadcast at most (12 bytes each); with more, words are joined with them by a shuffle.
BROADCAST = 1 << 22
#: Ratios are summed as integers in this unit, so that no order of summing changes a score.
UNIT = 2.0**-20
CALIBRATION = 20_000
#: Labelled ids that are broadcast at most (72 MB); with more, texts are joined with them by a shuffle.
MARKS = 1 << 23
CUT = 0.5
#: Stands for a word's end; no word holds this byte, nor 0, which stands before a word.
END = 1
#: Marks the key of a context, which says what an unseen byte after it tells.
CONTEXT = 1 << 62
_KEEP = np.array([(1 << 8 * (n + 1)) - 1 for n in range(ORDER)], np.uint64)


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts as bytes, where words start and end in them, and for each text how many it has."""
    code = WORDS[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    start, end = stretches(code != 0)
    return code, start, end, np.diff(np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts])), prepend=0)


def gathered(code: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of some words, one after another, and where each starts (one more than there are words)."""
    at = np.append(0, np.cumsum(end - start))
    return code[np.repeat(start - at[:-1], end - start) + np.arange(at[-1])], at


def expressions(code: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each word, and its end, the stretch that ends there, as an integer; how many a word has is its length and 1."""
    size = end - start + 1
    at = np.append(0, np.cumsum(size))
    within = np.arange(at[-1]) - np.repeat(at[:-1], size)
    flat = np.concatenate((np.zeros(7, np.uint8), np.append(code, np.uint8(0))[np.repeat(start, size) + within]))
    flat[at[1:] + 6] = END
    eights = np.ndarray(len(flat) - 7, ">u8", flat, strides=(1,))
    return (eights.astype(np.uint64) & _KEEP[np.minimum(within, ORDER - 1)]).view(np.int64), size


def _marked(batches: Iterator[pa.RecordBatch], known) -> Iterator[pa.RecordBatch]:
    """The texts (``text``, ``y``) whose doc_id is among the sorted ids of ``known``."""
    ids, marks = known.value
    for batch in batches:
        doc = batch.column("doc_id")
        mine = doc.fill_null(0).to_numpy()
        at = np.minimum(np.searchsorted(ids, mine), max(0, len(ids) - 1))
        hit = (ids[at] == mine) & doc.is_valid().to_numpy(zero_copy_only=False) if len(ids) else np.zeros(len(mine), bool)
        yield pa.RecordBatch.from_arrays([batch.column("text").filter(pa.array(hit)), pa.array(marks[at[hit]], pa.int8())], names=["text", "y"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct (word, hash of the word before it or 0, class)."""
    for batch in chunks(batches):
        code, start, end, n = words_of(bytes_of(batch))
        h = span_hashes(code, start, end)
        before = np.append(np.uint64(0), h[:-1])[: len(h)] >> np.uint64(32)
        before[(np.cumsum(n) - n)[n > 0]] = 0
        y = np.repeat(batch.column("y").to_numpy(), n)
        one = np.unique((h ^ before * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(2) + y.astype(np.uint64), return_index=True)[1]
        for lo in range(0, len(one), 200_000):
            some = one[lo : lo + 200_000]
            raw, at = gathered(code, start[some], end[some])
            word = pa.BinaryArray.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([word, pa.array(before[some].astype(np.uint32).view(np.int32)), pa.array(y[some], pa.int8())], names=["w", "v", "y"])


def _spelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, toxic, ordinary) of the expressions in words (w, t, p), summed in each batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        words = batch.column("w").cast(pa.large_binary())
        at = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        keys, size = expressions(np.frombuffer(words.buffers()[2], np.uint8), at[:-1], at[1:])
        one, which = np.unique(keys, return_inverse=True)
        sums = [np.bincount(which, np.repeat(batch.column(c).to_numpy(), size), len(one)).astype(np.int64) for c in "tp"]
        yield pa.RecordBatch.from_arrays([pa.array(one), *map(pa.array, sums)], names=["key", "t", "p"])


def _grouped(keys: np.ndarray, *values: np.ndarray) -> tuple:
    one, which = np.unique(keys, return_inverse=True)
    return one, which, *(np.bincount(which, v, len(one)) for v in values)


@dataclass
class Shared:
    """What all expressions back off to: P(x) and P(x | one byte), from counts of distinct bytes before them."""

    one: np.ndarray
    two: np.ndarray

    @classmethod
    def of(cls, pairs: np.ndarray, counts: np.ndarray) -> Shared:
        """pairs: stretches of two bytes; counts: distinct bytes before each."""
        n2 = np.bincount(pairs, counts, 1 << 16).reshape(256, 256)
        n1 = (n2 > 0).sum(axis=0).astype(float)  # distinct bytes before a byte
        one = (np.maximum(n1 - DISCOUNT, 0) + np.minimum(n1, DISCOUNT).sum() / 256) / max(1.0, n1.sum())
        total = n2.sum(axis=1, keepdims=True)
        two = (np.maximum(n2 - DISCOUNT, 0) + np.minimum(n2, DISCOUNT).sum(axis=1, keepdims=True) * one) / np.maximum(total, 1)
        return cls(one, np.where(total > 0, two, one))


def shared_chances(keys: np.ndarray, shared: Shared) -> np.ndarray:
    """P of the last byte of each of the distinct stretches ``keys`` given the ORDER - 2 bytes before it. Of the stretches that agree in the
    two bytes before the last, all must be there."""
    levels, at = [], [keys]
    for n in range(ORDER - 1, 2, -1):
        one, which, count = _grouped(at[-1] & ((1 << 8 * n) - 1), np.ones(len(at[-1])))
        levels.append((one, which, count))
        at.append(one)
    two = at[-1] & 0xFFFF
    below = shared.two[two >> 8, two & 255]
    for one, which, count in reversed(levels):
        _, context, total, left = _grouped(one >> 8, count, np.minimum(count, DISCOUNT))
        p = np.maximum(count - DISCOUNT, 0) / total[context] + (left / total)[context] * below
        below = p[which]
    return below


def class_chances(keys: np.ndarray, count: np.ndarray, discount: float, back: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """p_c of each stretch; contexts, and L_c of each (1 where the class doesn't know the context)."""
    contexts, which, total, left = _grouped(keys >> 8, count, np.minimum(count, discount))
    weight = np.divide(left, total, out=np.ones(len(total)), where=total > 0)
    own = np.divide(np.maximum(count - discount, 0), total[which], out=np.zeros(len(keys)), where=total[which] > 0)
    return own + weight[which] * back, contexts, weight


def discounts(toxic: float, ordinary: float) -> tuple[float, float]:
    least = min(toxic, ordinary)
    return TOP_DISCOUNT * toxic / least, TOP_DISCOUNT * ordinary / least


def _weighed(group: pa.Table, shared: Shared, d_toxic: float, d_ordinary: float) -> pa.Table:
    group = group.sort_by("key")
    keys = group.column("key").to_numpy()
    back = shared_chances(keys, shared)
    toxic, contexts, left_t = class_chances(keys, group.column("t").to_numpy().astype(float), d_toxic, back)
    plain, _, left_p = class_chances(keys, group.column("p").to_numpy().astype(float), d_ordinary, back)
    value = np.rint(np.append(np.log(toxic / plain), np.log(left_t / left_p)) / UNIT).astype(np.int32)
    return pa.table({"key": np.append(keys, contexts | CONTEXT), "value": value})


@dataclass
class KneserNey:
    """What scoring needs: what each expression adds to a word's log-likelihood ratio, in UNITs.

    ``head`` has the sorted keys of all expressions and contexts if they are few enough to be broadcast; else all are in ``table``.
    """

    head: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    head_value: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    table: DataFrame | None = None
    #: Weights of (ratio / words, ratio / sqrt(words), 1).
    weights: np.ndarray = field(default_factory=lambda: np.array([0.0, 0.0, -40.0]))


def _value_of(keys: np.ndarray, head: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Of each stretch, its own or that of its context; 0 if neither is known."""
    if not len(head):
        return np.zeros(len(keys), np.int64)
    find = lambda k: np.minimum(np.searchsorted(head, k), len(head) - 1)
    at = find(keys)
    out, other = np.where(head[at] == keys, value[at], 0).astype(np.int64), np.flatnonzero(head[at] != keys)
    context = (keys[other] >> 8) | CONTEXT
    at = find(context)
    out[other] = np.where(head[at] == context, value[at], 0)
    return out


def mixed(ratio: np.ndarray) -> np.ndarray:
    """What a word adds to a text's ratio (in UNITs), given the word's own."""
    return np.rint(np.log1p(SHARE * np.expm1(np.minimum(ratio * UNIT, 50.0))) / UNIT).astype(np.int64)


def _distinct_words(texts: list[bytes]) -> tuple:
    """The texts as bytes, words per text, the distinct words' hashes, starts and ends, and which of them each word is."""
    code, start, end, n = words_of(texts)
    one, first, which = np.unique(span_hashes(code, start, end), return_index=True, return_inverse=True)
    return code, n, one, start[first], end[first], which


def _per_text(value: np.ndarray, n: np.ndarray) -> np.ndarray:
    ends = np.append(0, np.cumsum(value))
    cuts = np.append(0, np.cumsum(n))
    return ends[cuts[1:]] - ends[cuts[:-1]]


def log_ratios(docs: DataFrame, model: KneserNey) -> DataFrame:
    """doc_id, the log-likelihood ratio ``r`` of its text, toxic against ordinary, and its words ``n``."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if model.table is not None:
        return _log_ratios_by_join(slim, model.table)
    sent = docs.sparkSession.sparkContext.broadcast((model.head, model.head_value))

    def by_head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, value = sent.value
        for batch in chunks(batches):
            code, n, _, start, end, which = _distinct_words(bytes_of(batch))
            keys, size = expressions(code, start, end)
            known, at = np.unique(keys, return_inverse=True)
            total = _per_text(mixed(_per_text(_value_of(known, head, value)[at], size))[which], n)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(total)], names=["doc_id", "n", "total"])

    return slim.mapInArrow(by_head, "doc_id long, n long, total long").select("doc_id", (F.col("total") * F.lit(UNIT)).alias("r"), "n")


def _log_ratios_by_join(slim: DataFrame, model: DataFrame) -> DataFrame:
    """As by the broadcast model: distinct words are joined with the model, then texts with the words."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            code, _, one, start, end, _ = _distinct_words(bytes_of(batch))
            for lo in range(0, len(one), 200_000):
                raw, at = gathered(code, start[lo : lo + 200_000], end[lo : lo + 200_000])
                yield pa.RecordBatch.from_arrays([pa.array(one[lo : lo + 200_000].view(np.int64)), pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(raw)])], names=["word", "w"])

    def spelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = batch.column("w").cast(pa.large_binary())
            if len(w):
                at = np.frombuffer(w.buffers()[1], np.int64)[w.offset : w.offset + len(w) + 1]
                keys, size = expressions(np.frombuffer(w.buffers()[2], np.uint8), at[:-1], at[1:])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("word").to_numpy(), size)), pa.array(keys)], names=["word", "key"])

    def used(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            _, n, one, _, _, which = _distinct_words(bytes_of(batch))
            pairs, times = np.unique(np.repeat(np.arange(len(n)), n) * max(1, len(one)) + which, return_counts=True)
            # a text without words keeps its row
            bare = np.flatnonzero(n == 0)
            text = np.append(pairs // max(1, len(one)), bare)
            word = pa.array(np.append(one[pairs % max(1, len(one))] if len(one) else one, np.zeros(len(bare), np.uint64)).view(np.int64), mask=np.append(np.zeros(len(pairs), bool), np.ones(len(bare), bool)))
            yield pa.RecordBatch.from_arrays([batch.column("k").take(pa.array(text)), batch.column("doc_id").take(pa.array(text)), pa.array(n[text].astype(np.int64)), word, pa.array(np.append(times, np.zeros(len(bare), np.int64)).astype(np.int64))], names=["k", "doc_id", "n", "word", "times"])

    def mix_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(mixed(batch.column("ratio").to_numpy()))], names=["word", "value"])

    known = slim.mapInArrow(words, "word long, w binary").groupBy("word").agg(F.first("w").alias("w"))
    stretches_ = known.mapInArrow(spelt, "word long, key long")
    seen, context = model.filter(F.col("key") < CONTEXT), model.filter(F.col("key") >= CONTEXT).select(F.col("key").alias("c"), F.col("value").alias("cv"))
    hit = stretches_.join(seen, "key", "left").withColumn("c", F.when(F.col("value").isNull(), F.shiftright("key", 8).bitwiseOR(F.lit(CONTEXT))))
    value = hit.join(context, "c", "left").groupBy("word").agg(F.sum(F.coalesce("value", "cv", F.lit(0))).alias("ratio"))
    value = written(value.mapInArrow(mix_up, "word long, value long"), "words")
    # a row's own number tells equal rows apart; only here, after the table is written, is it the same each time
    numbered = written(slim.withColumn("k", F.monotonically_increasing_id()), "numbered")
    rows = numbered.mapInArrow(used, "k long, doc_id long, n long, word long, times long").join(value, "word", "left")
    total = rows.groupBy("k").agg(F.first("doc_id").alias("doc_id"), F.first("n").alias("n"), F.sum(F.col("times") * F.coalesce("value", F.lit(0))).alias("total"))
    return total.select("doc_id", (F.col("total") * F.lit(UNIT)).alias("r"), "n")


def normalised(ratio: np.ndarray, n: np.ndarray) -> np.ndarray:
    """By the length and by its root; bounded, so that no single text of the calibration outweighs the others."""
    n = np.maximum(n, 1)
    return np.stack([np.clip(ratio / n, -1, 1), np.clip(ratio / np.sqrt(n), -4, 4), np.ones(len(n))], axis=1)


def calibrated(x: np.ndarray, y: np.ndarray, ridge: float = 1e-6) -> np.ndarray:
    """Logistic regression by Newton's method; no weight of a ratio is negative."""
    if not len(y):
        return np.array([0.0, 0.0, -40.0])
    prior = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    for use in ([0, 1, 2], [1, 2], [0, 2], [2]):
        scale = np.maximum(x[:, use].std(axis=0), 1e-9)
        scale[-1] = 1.0
        z, w = x[:, use] / scale, np.zeros(len(use))
        w[-1] = prior
        keep = np.append(np.full(len(use) - 1, ridge * len(y)), 0.0)
        loss = lambda w: np.logaddexp(0, z @ w).sum() - y @ (z @ w) + 0.5 * keep @ (w * w)  # noqa: E731, B023
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(keep + 1e-9), z.T @ (p - y) + keep * w)
            # classes that a line parts make full steps overshoot
            part = next((k for k in 0.5 ** np.arange(40) if loss(w - k * step) < loss(w)), 0)
            w = w - part * step
            if part * np.abs(step).max() < 1e-8:
                break
        if (w[:-1] >= 0).all():
            break
    out = np.zeros(3)
    out[use] = w / scale
    return out


def fold() -> Column:
    return F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(5))


def marked(labels: DataFrame, name: str) -> DataFrame:
    return labels.filter(F.col(name).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(name).cast("tinyint").alias("y"))


def learnt_from(docs: DataFrame, labels: DataFrame, name: str = "toxic") -> KneserNey:
    """Count and weigh. The driver gets at most BROADCAST expressions, and 65,536 counts of pairs of bytes."""
    spark = docs.sparkSession
    marks = marked(labels, name)
    learnt = written(marks.filter((fold() > 0) & (fold() < 4)).select(F.col("doc_id").cast("long").alias("doc_id"), "y"), "marks")
    if learnt.count() <= MARKS:
        # ids and marks go to the texts, 9 bytes each, so texts don't move
        rows = learnt.orderBy("doc_id").toArrow()
        known = spark.sparkContext.broadcast((rows.column("doc_id").to_numpy(), rows.column("y").to_numpy()))
        slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        counted = slim.mapInArrow(lambda b: _count(_marked(b, known)), "w binary, v int, y tinyint")
    else:
        counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(learnt, "doc_id").select("text", "y").mapInArrow(_count, "w binary, v int, y tinyint")
    # a word after many others is in many groups of the first grouping, and counted in parts before the second
    pairs = counted.groupBy("w", "v").agg(F.max("y").cast("long").alias("t"), (1 - F.min("y")).cast("long").alias("p"))
    words = pairs.groupBy("w").agg(F.sum("t").alias("t"), F.sum("p").alias("p"))
    counts = written(words.mapInArrow(_spelt, "key long, t long, p long").groupBy("key").agg(F.sum("t").alias("t"), F.sum("p").alias("p")), "expressions")
    model = KneserNey()
    toxic, plain = counts.agg(F.coalesce(F.sum("t"), F.lit(0)), F.coalesce(F.sum("p"), F.lit(0))).first()
    if not toxic or not plain:
        return model
    low = lambda n: F.col("key").bitwiseAND(F.lit((1 << 8 * n) - 1).cast("long"))
    before = counts.select(low(3).alias("key")).distinct().groupBy(low(2).alias("key")).count().toArrow()
    shared = Shared.of(before.column("key").to_numpy(), before.column("count").to_numpy())
    d_toxic, d_plain = discounts(toxic, plain)
    groups = counts.groupBy(F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFF).cast("long")))
    model.table = written(groups.applyInArrow(lambda g: _weighed(g, shared, d_toxic, d_plain), "key long, value int"), "model")
    if model.table.count() <= BROADCAST:
        rows = model.table.orderBy("key").toArrow()
        model.head, model.head_value, model.table = rows.column("key").to_numpy(), rows.column("value").to_numpy(), None
    return model


def weights_of(ratios: DataFrame, labels: DataFrame, name: str = "toxic") -> np.ndarray:
    """Calibrated on at most CALIBRATION documents of fold 4: rows of ``log_ratios`` that bear their ids."""
    rows = ratios.join(F.broadcast(_calibrating(labels, name)), "doc_id").select("y", "r", "n").orderBy("y", "r", "n").limit(2 * CALIBRATION).toArrow()
    return calibrated(normalised(rows.column("r").to_numpy(), rows.column("n").to_numpy()), rows.column("y").to_numpy().astype(float))


def _calibrating(labels: DataFrame, name: str) -> DataFrame:
    return marked(labels, name).filter(fold() == 4).orderBy(F.xxhash64("doc_id"), "doc_id").limit(CALIBRATION).select(F.col("doc_id").cast("long").alias("doc_id"), "y")


def fitted(docs: DataFrame, labels: DataFrame, name: str = "toxic") -> KneserNey:
    """Count, weigh and calibrate. The driver gets CALIBRATION rows of two numbers besides."""
    model = learnt_from(docs, labels, name)
    some = docs.withColumn("doc_id", F.col("doc_id").cast("long")).join(F.broadcast(_calibrating(labels, name).select("doc_id")), "doc_id", "left_semi")
    model.weights = weights_of(log_ratios(some, model), labels, name)
    return model


def _scores(ratios: DataFrame, weights: np.ndarray) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = normalised(batch.column("r").to_numpy(), batch.column("n").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(x @ weights, -50, 50))))], names=["doc_id", "score"])

    return ratios.mapInArrow(work, "doc_id long, score double")


def scored(docs: DataFrame, model: KneserNey) -> DataFrame:
    """doc_id and score for every row of ``docs``.

    A null text is an empty one and has the score of a text whose ratio is 0. Without labels of both classes all scores are near 0. Repeated rows and
    texts have equal scores, so ties are ties; texts are scored whole, however long; columns but these two are left out. Of several labels
    of a doc_id the greatest holds. An empty table gives no rows. Words are runs of letters and digits, ASCII in lower case.
    """
    return _scores(log_ratios(docs, model), model.weights)


def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    ratios = written(log_ratios(docs, learnt_from(docs, labels)), "ratios")  # each text is scored once, those that calibrate as well
    out = _scores(ratios, weights_of(ratios, labels))
    return out.select("doc_id", F.coalesce(fold() == 0, F.lit(True)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
