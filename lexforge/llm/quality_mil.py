"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Each passage is described by the shares of byte classes, of hashed byte pairs and of repeated words,
encoded by a learnt layer, and weighted by learnt gated attention; the weighted mean is scored. Only documents have labels; which
passages matter is learnt from them.

The model is fitted on the driver on at most FIT_DOCS labelled documents (those of least hash) and at most FIT_PASSAGES passages of theirs, and has
a fixed number of weights. All passages of all documents are scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexforge.llm.shared import chunks, folded, mix, table, written

PASSAGE = 64
PAIRS = 128
FIT_DOCS = 4000
FIT_PASSAGES = 60_000
HIDDEN, ATTENTION = 24, 12
EPOCHS, RATE, DECAY = 40, 0.01, 1e-4
CUT = 0.3
SEED = 5


def _classes() -> np.ndarray:
    """A class for each byte: white space, line ends, digits, letters, and common marks each of their own."""
    to = np.zeros(256, np.int64)
    for c in range(256):
        ch = chr(c)
        to[c] = 1 if ch in " \t" else 2 if ch in "\r\n" else 3 if c >= 128 else 4 if ch.isdigit() else 5 if ch.islower() else 6 if ch.isupper() else 0
    for k, ch in enumerate(".,!?|#*$%&<>=/:;\"'()[]{}@-_+"):
        to[ord(ch)] = 7 + k
    return to


CLASSES = _classes()
N_CLASSES = int(CLASSES.max()) + 1
N_FEATURES = N_CLASSES + PAIRS + 5


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of all texts, and how many each text has: one at least, which is empty for an empty text."""
    parts: list[bytes] = []
    extra: list[tuple[float, ...]] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = text.split(" ")
        rows = 0
        for at in range(0, len(words), PASSAGE):
            some = words[at : at + PASSAGE]
            piece = " ".join(some)
            # a "word" without spaces can be of any length; then the passage is as long
            n = len(some)
            same = sum(map(str.__eq__, some, some[1:]))
            extra.append((1 - len(set(some)) / n, same / n, min(1.0, len(piece) / n / 20), n / PASSAGE, float(not piece)))
            parts.append(piece.encode())
            rows += 1
        counts[i] = rows
    size = np.array([len(p) for p in parts], np.int64)
    data = np.frombuffer(b"".join(parts), np.uint8)
    who = np.repeat(np.arange(len(parts)), size)
    kinds = np.bincount(who * N_CLASSES + CLASSES[data], minlength=len(parts) * N_CLASSES).reshape(len(parts), N_CLASSES)
    lower = data | np.where((data >= 65) & (data <= 90), 32, 0).astype(np.uint8)
    if len(data) > 1:
        pair = lower[:-1].astype(np.uint64) * np.uint64(256) + lower[1:]
        inner = who[:-1] == who[1:]
        pairs = np.bincount(who[:-1][inner] * PAIRS + (mix(pair[inner]) >> np.uint64(57)).astype(np.int64), minlength=len(parts) * PAIRS)
    else:
        pairs = np.zeros(len(parts) * PAIRS, np.int64)
    total = np.maximum(size, 1)[:, None]
    x = np.concatenate([np.sqrt(kinds / total), np.sqrt(pairs.reshape(len(parts), PAIRS) / total), np.array(extra, np.float64).reshape(len(parts), 5)], axis=1)
    return x.astype(np.float32), counts


def _sum(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, starts, axis=0)


class AttentionModel:
    """h = tanh(xE + e); a = softmax over the bag of (tanh(hV) * sigmoid(hU))w; score = sigmoid((sum a h)c + b)."""

    def __init__(self, n_features: int, seed: int = SEED):
        g = np.random.default_rng(seed)
        r = lambda *s: (g.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.mean, self.scale = np.zeros(n_features, np.float32), np.ones(n_features, np.float32)
        self.w = {"E": r(n_features, HIDDEN), "e": np.zeros(HIDDEN, np.float32), "V": r(HIDDEN, ATTENTION), "U": r(HIDDEN, ATTENTION), "w": r(ATTENTION), "c": r(HIDDEN), "b": np.zeros(1, np.float32)}

    def _forward(self, x: np.ndarray, counts: np.ndarray):
        w = self.w
        starts = np.cumsum(counts) - counts
        bag = np.repeat(np.arange(len(counts)), counts)
        h = np.tanh(x @ w["E"] + w["e"])
        v, u = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        s = (v * u) @ w["w"]
        s = np.exp(s - np.maximum.reduceat(s, starts)[bag])
        a = s / _sum(s, starts)[bag]
        z = _sum(a[:, None] * h, starts)
        p = 1 / (1 + np.exp(-(z @ w["c"] + w["b"][0])))
        return starts, bag, h, v, u, a, z, p

    def score(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self._forward((x - self.mean) / self.scale, counts)[-1]

    def gradient(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss of bags with labels y, with respect to the weights; worked out by hand."""
        starts, bag, h, v, u, a, z, p = self._forward(x, counts)
        w = self.w
        dz = ((p - y) / len(y)).astype(x.dtype)
        grad = {"c": z.T @ dz, "b": np.array([dz.sum()], x.dtype)}
        dbag = dz[:, None] * w["c"]
        da = (dbag[bag] * h).sum(axis=1)
        ds = a * (da - _sum(a * da, starts)[bag])
        dh = a[:, None] * dbag[bag]
        vu = ds[:, None] * w["w"]
        grad["w"] = (v * u).T @ ds
        dv, du = vu * u * (1 - v * v), vu * v * u * (1 - u)
        grad["V"], grad["U"] = h.T @ dv, h.T @ du
        dh += dv @ w["V"].T + du @ w["U"].T
        dh *= 1 - h * h
        grad["E"], grad["e"] = x.T @ dh, dh.sum(axis=0)
        return grad

    def fit(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray) -> AttentionModel:
        """Adam on batches of bags."""
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        x = (x - self.mean) / self.scale
        # start from the share of the labels, so that few or one-sided labels give just that
        self.w["b"][0] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
        ends = np.cumsum(counts)
        g = np.random.default_rng(SEED)
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        t = 0
        for epoch in range(EPOCHS):
            order = g.permutation(len(counts))
            for lo in range(0, len(order), 64):
                t += 1
                some = order[lo : lo + 64]
                rows = np.concatenate([np.arange(ends[i] - counts[i], ends[i]) for i in some])
                xb, nb = x[rows], counts[some]
                grad, w = self.gradient(xb, nb, y[some]), self.w
                rate = RATE * (1 - epoch / EPOCHS) + 1e-4
                for k, d in grad.items():
                    d = d + DECAY * w[k]
                    first[k] = 0.9 * first[k] + 0.1 * d
                    second[k] = 0.999 * second[k] + 0.001 * d * d
                    w[k] -= (rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        x, counts = passages([t or "" for t in batch.column("text").to_pylist()])
        cuts = np.append(0, np.cumsum(counts))
        yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(counts), pa.array([x[a:b].astype(np.float16).tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())], names=["y", "n", "x"])


def held_out() -> F.Column:
    """Whether the labels of a document are kept from training; so are those without a doc_id."""
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(5)) == 0, F.lit(True))


def fitted(docs: DataFrame, labels: DataFrame, name: str = "quality") -> AttentionModel:
    """A model from the labelled documents that aren't held out: FIT_DOCS of least hash, of those as many as have FIT_PASSAGES passages together."""
    marks = labels.filter(F.col(name).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(name).cast("int").alias("y"))
    wanted = marks.filter(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_DOCS)  # bounded: ids and marks of FIT_DOCS rows
    rows = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("y", "text")
    slim = written(rows.mapInArrow(_features, "y int, n long, x binary"), "features").withColumn("order", F.xxhash64("x"))
    running = slim.select("order", "n").orderBy("order").limit(FIT_DOCS).toArrow()
    total = np.cumsum(running.column("n").to_numpy()) if running.num_rows else np.zeros(0)
    ok = int(np.searchsorted(total, FIT_PASSAGES, side="right"))
    got = slim.orderBy("order").limit(max(1, ok)).select("y", "n", "x").toArrow()
    model = AttentionModel(N_FEATURES)
    if not got.num_rows:
        return model
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float16).reshape(-1, N_FEATURES).astype(np.float32)
    return model.fit(x, got.column("n").to_numpy().astype(np.int64), got.column("y").to_numpy().astype(np.float32))


def _score(batches: Iterator[pa.RecordBatch], model, whole: bool) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        x, counts = passages([t or "" for t in batch.column("text").to_pylist()])
        score = np.clip(model.value.score(x, counts).astype(np.float64), 0, 1)
        names = batch.schema.names if whole else [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(score)], names=[*names, "__score"])


def scored(docs: DataFrame, model: AttentionModel, whole: bool = True) -> DataFrame:
    """``docs`` (with or without the text) and ``__score``, the chance that a text is of quality.

    A null text is scored as an empty one, which is one empty passage; texts of any length are scored whole. Columns keep their names. Without labels, or with labels of one kind only, scores are near
    the labels' share, and one half without any. Repeated rows have equal scores; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights
    fields = [f for f in docs.schema.fields if whole or f.name != "text"]
    return docs.mapInArrow(lambda b: _score(b, sent, whole), T.StructType([*fields, T.StructField("__score", T.DoubleType())]))


def op5_attention_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, fitted(docs, table(spark, sf_dir, "labels")), whole=False)
    return out.select("doc_id", held_out().alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= CUT).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, with all their columns, whatever their names."""
    narrow, back = folded(docs, ("doc_id", "text"))
    return scored(narrow, fitted(narrow, labels)).filter(F.col("__score") >= CUT).select(*back)
