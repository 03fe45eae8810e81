import os

import numpy as np
import pytest

from lexforge.llm import one_bit_search as O
from lexforge.llm.one_bit_search import cosines, op2_one_bit_codes, search


def brute(ids, x, k=5, every=50):
    out = {}
    for q, v in zip(ids, x, strict=True):
        if q % every == 0:
            score = cosines(x, np.broadcast_to(v, x.shape))
            out[q] = sorted((-s, i) for s, i in zip(score.tolist(), ids, strict=True) if i != q)[:k]
    return out


def test_recall_and_exact_scores(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    want = brute([r.vec_id for r in rows], np.array([r.embedding for r in rows], np.float64))
    got = op2_one_bit_codes(spark, sf_dir).collect()
    assert sorted((r.query_id, r.rank) for r in got) == [(q, k) for q in sorted(want) for k in range(1, 6)]
    found = {(r.query_id, r.vec_id): r.score for r in got}
    exact = {(q, i): -s for q, best in want.items() for s, i in best}
    both = found.keys() & exact.keys()
    assert len(both) >= 0.95 * len(exact)
    assert all(abs(found[p] - exact[p]) < 1e-12 for p in both)


def test_recall_on_more_rows(spark):
    """2,000 vectors, of which a query's cells hold a part."""
    folder = "/root/testdata/sf0.1/embeddings.parquet"
    if not os.path.exists(folder):
        pytest.skip("no larger table")
    rows = spark.read.parquet(folder).collect()
    want = brute([r.vec_id for r in rows], np.array([r.embedding for r in rows], np.float64))
    exact = {(q, i) for q, best in want.items() for _, i in best}
    found = {(r.query_id, r.vec_id) for r in search(spark.read.parquet(folder)).collect()}
    assert len(found & exact) >= 0.95 * len(exact)
    fewer = {(r.query_id, r.vec_id) for r in search(spark.read.parquet(folder), recall=0.5).collect()}
    assert 0.3 * len(exact) < len(fewer & exact) < len(found & exact)


def test_groups_of_vectors_take_few_cells(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((12, 32)) * 4
    x = (base[rng.integers(0, 12, 4000)] + rng.standard_normal((4000, 32)) * 0.3).astype(np.float32)
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    want = brute(list(range(4000)), x.astype(float))
    exact = {(q, i) for q, best in want.items() for _, i in best}
    found = {(r.query_id, r.vec_id) for r in search(docs).collect()}
    assert len(found & exact) >= 0.9 * len(exact)


def test_estimates_are_within_their_bounds():
    rng = np.random.default_rng(4)
    for dim in (3, 64, 300):
        x, q = O.units(rng.standard_normal((500, dim))), O.units(rng.standard_normal((20, dim)))
        code, length, a = O.encoded(x)
        got, error = O.estimates(q, code, a)
        assert code.shape == (500, O.width_of(dim) // 64) and np.allclose(length, 1)
        assert (np.abs(got - q @ x.T) <= O.SPREAD * error + 1e-6).mean() > 0.999 and abs((got - q @ x.T).mean()) < 0.01


def test_lengths_hot_vectors_and_parts(spark, monkeypatch):
    """A third of the rows share a vector; lengths differ; repeated rows and ids; parts of few rows."""
    rng = np.random.default_rng(8)
    rows = [(i, [1.0, 2.0, 3.0, 4.0] if i % 3 == 0 else rng.standard_normal(4).round(2).tolist() if i % 3 == 1 else rng.standard_normal(7).tolist()) for i in range(900)]
    rows += [rows[4], rows[4], (50, [9.0, 9.0, 9.0, 9.0]), (3000, [1.0] * 11), (3001, [2.0] * 11)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    monkeypatch.setattr(O, "PART_BYTES", 640)
    got = {}
    for r in search(docs, recall=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((round(-r.score, 9), r.vec_id))
    for q in {i for i, _ in rows if i % 50 == 0}:
        v = min(x for i, x in rows if i == q)
        others = [(i, x) for i, x in rows if i != q and len(x) == len(v)]
        want = sorted((round(-s, 9), i) for s, (i, _) in zip(cosines(np.array([x for _, x in others]), np.array([v] * len(others))).tolist(), others, strict=True))[:5]
        assert got.get(q, []) == want, q


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, None), (100, [0.0, 0.0]), (1, [1.0, None]), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [2.0, 0.0]), (5, [1.0, 1.0]), (None, [1.0, 0.0]), (6, [1.0]), (7, [3.0, 0.0]), (7, [-1.0, 0.0])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS score", "2 AS rank", "'c' AS code")
    got = [(r.query_id, r["rank"], r.vec_id, round(r.score, 12)) for r in search(docs).orderBy("rank").collect()]
    assert got == [(0, 1, 4, 1.0), (0, 2, 7, 1.0), (0, 3, 5, round(0.5**0.5, 12)), (0, 4, 7, -1.0)]


def test_ties_go_to_the_smaller_id(spark):
    docs = spark.range(40).selectExpr("id AS vec_id", "array(1.0f, 2.0f) AS embedding")
    assert [(r.query_id, r.vec_id) for r in search(docs).orderBy("rank").collect()] == [(0, i) for i in range(1, 6)]


def test_no_rows(spark):
    assert search(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_rows_without_order_are_pruned_by_a_floor(spark, monkeypatch):
    """What a query's cells send on doesn't grow with their number, though half of them or more are looked into; nothing is lost by it."""
    rng = np.random.default_rng(11)
    made = {}
    monkeypatch.setattr(O, "written", lambda df, name, real=O.written: made.setdefault(name, real(df, name)))
    for rows in (1500, 6000):
        made.clear()
        x = rng.standard_normal((rows, 32))
        got = {}
        for r in search(spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>"), recall=1.0).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
        want = brute(list(range(rows)), x)
        assert {q: [i for _, i in best] for q, best in got.items()} == {q: [i for _, i in best] for q, best in want.items()}
        assert made["found"].count() < 20 * len(want)


def test_few_pairs_are_compared_exactly(monkeypatch):
    """A part of a cell, queries whose floor is the 5th best of 20 times as many rows: of all pairs a few are compared, and none that reaches the floor is lost."""
    rng = np.random.default_rng(12)
    x, q, others = (O.units(rng.standard_normal((n, 64))) for n in (400, 50, 8000))
    code, length, a = O.encoded(x)
    estimate, error = O.estimates(q, code, a)
    exact, pairs = q @ x.T, []
    monkeypatch.setattr(O, "compared", lambda q, x, rows, cols, real=O.compared: (pairs.append(len(rows)), real(q, x, rows, cols))[1])
    reach = O.SPREAD * error + 1e-6
    for floor in (np.partition(q @ others.T, -5, axis=1)[:, -5], np.full(50, -np.inf)):
        found = set(zip(*(v.tolist() for v in O.candidates(q, x, estimate, reach, floor, 5)), strict=True))
        best = {(i, j) for i in range(50) for j in np.argsort(-exact[i])[:5].tolist() if exact[i, j] >= floor[i]}
        assert best <= found <= {(i, j) for i, j in zip(*np.nonzero(exact >= floor[:, None] - 1e-6), strict=True)}
    assert sum(pairs[:1]) < 0.1 * exact.size
