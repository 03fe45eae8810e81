import zlib

import numpy as np

from lexforge.llm import quality_mil as Q


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    y = np.array(y, bool)
    return (rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())


def test_held_out_documents(spark, sf_dir):
    got = {r.doc_id: r for r in Q.op5_attention_mil(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= Q.CUT) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    marks = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r.quality is not None and r.doc_id in got]
    held = [(got[i].score, y) for i, y in marks if got[i].held_out]
    assert auc([s for s, _ in held], [y for _, y in held]) > 0.8


def bags(n=40, features=7):
    g = np.random.default_rng(1)
    counts = g.integers(1, 6, n)
    model = Q.AttentionModel(features)
    model.w = {k: v.astype(float) + 0.1 * g.standard_normal(v.shape) for k, v in model.w.items()}
    return model, g.standard_normal((counts.sum(), features)), counts, g.integers(0, 2, n).astype(float)


def test_scores_are_those_of_the_formulas():
    """Bag by bag, passage by passage."""
    model, x, counts, _ = bags()
    w, got, at = model.w, model._forward(x, counts)[-1], 0
    for n, score in zip(counts, got, strict=True):
        h = [np.tanh(x[i] @ w["E"] + w["e"]) for i in range(at, at + n)]
        gate = np.array([float((np.tanh(k @ w["V"]) / (1 + np.exp(-(k @ w["U"])))) @ w["w"]) for k in h])
        a = np.exp(gate) / np.exp(gate).sum()
        z = sum(weight * k for weight, k in zip(a, h, strict=True))
        assert abs(score - 1 / (1 + np.exp(-(z @ w["c"] + w["b"][0])))) < 1e-12
        at += n


def test_gradient_against_differences():
    model, x, counts, y = bags()

    def loss():
        p = model._forward(x, counts)[-1]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    grad = model.gradient(x, counts, y)
    for name, weights in model.w.items():
        flat, own = weights.reshape(-1), grad[name].reshape(-1)
        for i in np.linspace(0, len(flat) - 1, min(len(flat), 9)).astype(int):
            old, step = flat[i], 1e-6
            flat[i] = old + step
            high = loss()
            flat[i] = old - step
            low = loss()
            flat[i] = old
            assert abs((high - low) / (2 * step) - own[i]) < 1e-7, name


def test_fitting():
    """Fitted on bags whose label one passage tells."""
    g = np.random.default_rng(0)
    counts = g.integers(1, 6, 300)
    y = g.integers(0, 2, 300).astype(np.float32)
    x = g.standard_normal((counts.sum(), 10)).astype(np.float32)
    starts = np.cumsum(counts) - counts
    x[starts[y == 1], 0] += 6
    model = Q.AttentionModel(10).fit(x, counts, y)
    assert auc(model.score(x, counts), y) > 0.95


def test_messy_rows(spark, messy, empty, marks, no_marks):
    kept = Q.good_documents(messy, marks)
    assert kept.columns == messy.columns and kept.count() <= messy.count()
    same = Q.scored(messy.select("doc_id", "text"), Q.fitted(messy, no_marks)).collect()
    assert len(same) == messy.count() and all(0 <= r["__score"] <= 1 for r in same)
    assert Q.good_documents(empty, marks).collect() == []
