import random
import re
from collections import Counter

import numpy as np

from lexforge.llm import near_dedup as N
from lexforge.llm import shared as S
from tests.llm.conftest import GOOD


def bag(text):
    words = re.findall(rb"[a-z0-9\x80-\xff]+", bytes(text or "", "utf-8").lower())
    return Counter([tuple(words)] if 0 < len(words) < 5 else [tuple(words[i : i + 5]) for i in range(len(words) - 4)])


def brute(texts):
    """Classes of all pairs of weighted Jaccard similarity of 0.8 and more; equal texts are one."""
    bags = [bag(t) for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if find(i) != find(j):
                a, b = bags[i], bags[j]
                same = texts[i] == texts[j] and texts[i]
                if same or (a and b and 4 * max(a.total(), b.total()) <= 5 * min(a.total(), b.total()) and 5 * (a & b).total() >= 4 * (a | b).total()):
                    parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def sets(pairs):
    out = {}
    for i, c in pairs:
        out.setdefault(c, set()).add(i)
    return sorted(map(sorted, out.values()))


def test_classes_of_documents(spark, sf_dir, documents):
    rows = documents.orderBy("doc_id").collect()
    want = brute([r.text for r in rows])
    got = N.op6_bagminhash(spark, sf_dir).collect()
    assert sets((r.doc_id, r.class_id) for r in got) == sets((rows[i].doc_id, c) for i, c in enumerate(want))
    assert sum(r.first for r in got) == len(set(want))
    assert all(r.class_id == min(x.doc_id for x in got if x.class_id == r.class_id) for r in got[:50])


def test_registers_estimate_weighted_jaccard():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 2**63, 400).astype(np.uint64)
    v, w = rng.integers(0, 40, 400), rng.integers(0, 40, 400)
    doc = np.concatenate([np.zeros((v > 0).sum(), int), np.ones((w > 0).sum(), int)])
    sig = N.signatures(doc, np.concatenate([h[v > 0], h[w > 0]]), np.concatenate([v[v > 0], w[w > 0]]), 2, 4096)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(v, w).sum() / np.maximum(v, w).sum()) < 0.03


def test_a_chain_in_one_large_component(spark, monkeypatch):
    """Blocks of a component meet pairwise, and classes are those of all pairs."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(60):
        texts.append(" ".join(words))
        words[rng.randrange(400)] = f"v{rng.random()}"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(N, "UNIT_ROWS", 7)
    got = N.classed(docs).collect()
    assert sets((r.doc_id, r.class_id) for r in got) == sets(enumerate(brute(texts)))


def test_large_components_of_several_classes(spark, monkeypatch):
    """Two large classes and small ones that passages tie into one component; one class is itself held together by a single chain."""
    rng = random.Random(9)
    base = [[f"w{k}x{i}" for i in range(60)] for k in range(3)]
    texts = []
    for i in range(130):
        words = list(base[i % 2])
        words[rng.randrange(60)] = f"v{i}"
        texts.append(" ".join(words))
    for i in range(40):  # between the first two, not as near as 0.8 to most
        texts.append(" ".join(base[0][: 30 + i % 25] + base[1][30 + i % 25 :]))
    texts += [" ".join(base[2][:50] + [f"u{i}" for i in range(rng.randrange(8))]) for _ in range(30)]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = sets(enumerate(brute(texts)))
    for rows, hot in ((7, 500), (25, 20), (2000, 10)):
        monkeypatch.setattr(N, "UNIT_ROWS", rows)
        monkeypatch.setattr(S, "HOT_ROWS", hot)
        assert sets((r.doc_id, r.class_id) for r in N.classed(docs).collect()) == want


def test_without_broadcasts_of_rows(spark, documents, monkeypatch):
    want = sets((r.doc_id, r.class_id) for r in N.classed(documents).collect())
    monkeypatch.setattr(N, "BROADCAST_ROWS", 0)
    got = N.classed(documents).collect()
    assert sets((r.doc_id, r.class_id) for r in got) == want and sum(r.first for r in got) == len(want)


def test_early_stop_changes_no_register():
    rng = np.random.default_rng(3)
    doc = np.sort(rng.integers(0, 5, 300))
    h, weight = rng.integers(0, 2**63, 300).astype(np.uint64), rng.integers(1, 50, 300)
    sig = N.signatures(doc, h, weight, 5)
    assert np.isfinite(sig).all()
    for d in range(5):  # alone, a document's stretches of time are the same; among others that take longer they go on
        mine = doc == d
        assert (N.signatures(np.zeros(mine.sum(), int), h[mine], weight[mine], 1)[0] == sig[d]).all()


def test_columns_of_its_own_names(spark):
    rows = [(1, GOOD, "a", "b"), (2, GOOD, "c", "d"), (3, "other words than those", "e", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id string, first string")
    assert N.classed(docs).columns == ["doc_id", "text", "class_id", "first"]
    assert sorted((r.class_id, r.first) for r in N.classed(docs).collect()) == [(1, False), (1, True), (3, True)]
    assert sorted(tuple(r) for r in N.one_of_each(docs).collect()) == [rows[0], rows[2]]


def test_hundreds_of_copies(spark):
    docs = spark.range(900).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'one two three four five six' ELSE concat('text number ', id, ' has words of its own ', id * 7, ' and ', id * 13) END AS text").repartition(4)
    got = N.classed(docs).collect()
    assert Counter(r.class_id for r in got)[0] == 300 and sum(r.first for r in got) == 601


def test_messy_rows(messy, empty):
    got = N.one_of_each(messy)
    ids = sorted((r.doc_id for r in got.collect()), key=str)
    assert got.columns == messy.columns
    assert ids == sorted([1, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, None, None], key=str)
    assert N.one_of_each(empty).collect() == []
