import math
import random
import zlib
from collections import Counter

from lexforge.llm import toxicity as X
from tests.llm.test_quality_mil import auc


def test_held_out_documents(spark, sf_dir):
    got = {r.doc_id: r for r in X.op10_kneser_ney(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= X.CUT) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [(got[r.doc_id].score, r.toxic) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r.toxic is not None and r.doc_id in got]
    assert auc([s for s, _ in held], [y for _, y in held]) > 0.75


def expressions(word):
    s = bytes(X.ORDER - 1) + word + bytes([X.END])
    return [s[k : k + X.ORDER] for k in range(len(word) + 1)]


def brute(texts, marks):
    """Both models straight from the formulas, on strings of bytes; the chance of a byte after a context, in a class."""
    top = (Counter(), Counter())
    seen = set()
    for text, y in zip(texts, marks, strict=True):
        words = "".join(c if c.isalnum() or c > "\x7f" else " " for c in text.lower()).encode().split()
        for before, word in zip([b"", *words], words, strict=False):
            if (before, word, y) not in seen:
                seen.add((before, word, y))
                top[y].update(expressions(word))
    all_ = [set(top[0]) | set(top[1])]
    shared = []
    for _ in range(X.ORDER - 1):
        shared.append(Counter(g[1:] for g in all_[-1]))
        all_.append(set(shared[-1]))

    def back(h, x):
        if len(h) == 0:
            counts = shared[-1]
            total = sum(counts.values())
            return max(counts[bytes([x])] - X.DISCOUNT, 0) / total + sum(min(n, X.DISCOUNT) for n in counts.values()) / total / 256
        counts = shared[X.ORDER - 2 - len(h)]
        here = [n for g, n in counts.items() if g[:-1] == h]
        if not here:
            return back(h[1:], x)
        return max(counts[h + bytes([x])] - X.DISCOUNT, 0) / sum(here) + sum(min(n, X.DISCOUNT) for n in here) / sum(here) * back(h[1:], x)

    sizes = [sum(t.values()) for t in top]
    off = [X.TOP_DISCOUNT * s / min(sizes) for s in sizes]

    def chance(y, h, x):
        here = [n for g, n in top[y].items() if g[:-1] == h]
        if not here:
            return back(h[1:], x)
        return max(top[y][h + bytes([x])] - off[y], 0) / sum(here) + sum(min(n, off[y]) for n in here) / sum(here) * back(h[1:], x)

    return chance, top


def small():
    rng = random.Random(2)
    part = ["an", "ba", "é", "tri", "on", "x"]
    word = lambda: "".join(rng.choice(part) for _ in range(rng.randrange(1, 5)))
    rows = [(i, " ".join(("badword " if i % 3 == 0 and rng.random() < 0.3 else "") + word() for _ in range(12)), int(i % 3 == 0)) for i in range(60)]
    ids = [d for d in range(400) if 0 < zlib.crc32(str(d).encode()) % 5 < 4][:60]
    return [(d, t, y) for d, (_, t, y) in zip(ids, rows, strict=True)]


def test_chances_are_those_of_the_formulas_and_sum_to_one(spark):
    rows = small()
    chance, top = brute([t for _, t, _ in rows], [y for _, _, y in rows])
    contexts = random.Random(1).sample(sorted({g[:-1] for t in top for g in t}), 25)
    for h in [*contexts, b"zzzzzz", bytes(6)]:
        for y in (0, 1):
            assert abs(sum(chance(y, h, x) for x in range(256)) - 1) < 1e-9
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(5)
    model = X.learnt_from(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    value = dict(zip(model.head.tolist(), model.head_value.tolist(), strict=True))
    grams = {g for t in top for g in t}
    assert sum(k < X.CONTEXT for k in value) == len(grams)
    for g in grams:
        assert abs(value[int.from_bytes(g)] * X.UNIT - math.log(chance(1, g[:-1], g[-1]) / chance(0, g[:-1], g[-1]))) < 1e-5
    for h in {g[:-1] for g in grams}:
        x = next(x for x in range(2, 256) if h + bytes([x]) not in grams)
        assert abs(value[int.from_bytes(h) | X.CONTEXT] * X.UNIT - math.log(chance(1, h, x) / chance(0, h, x))) < 1e-5
    # whole texts, known and unknown words
    texts = [*(t for _, t, _ in rows), "badword", "Badwords, anbaxyz!", "", "naïve zzzz \U0001f600"]
    got = {r.doc_id: r for r in X.log_ratios(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(texts):
        words = "".join(c if c.isalnum() or c > "\x7f" else " " for c in t.lower()).encode().split()
        ratios = [sum(math.log(chance(1, g[:-1], g[-1]) / chance(0, g[:-1], g[-1])) for g in expressions(w)) for w in words]
        assert got[i].n == len(words) and abs(got[i].r - sum(math.log1p(X.SHARE * math.expm1(r)) for r in ratios)) < 1e-3


def test_it_learns_a_word(spark):
    # the expression stands after ever other words: one that only repeats its surroundings would be a copy, which proves nothing
    rng = random.Random(1)
    words = lambda bad: " ".join(("grumpkin " if bad and j % 10 == 3 else "") + f"w{rng.randrange(300)}" for j in range(30))
    rows = [(i, words(i % 4 == 0)) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    got = X.scored(docs, X.fitted(docs, marks)).collect()
    assert all((r.score >= 0.5) == (r.doc_id % 4 == 0) for r in got)


def test_messy_rows(messy, empty, marks, no_marks):
    for labels in (marks, no_marks):
        got = X.scored(messy, X.fitted(messy, labels)).collect()
        assert len(got) == messy.count() and all(0 <= r.score <= 1 for r in got)
    assert X.scored(empty, X.fitted(empty, marks)).collect() == []


def test_a_model_too_large_to_send_scores_alike(spark, documents, monkeypatch):
    labels = spark.createDataFrame([(r.doc_id, int("the" in (r.text or "")[:200])) for r in documents.select("doc_id", "text").collect()], "doc_id long, toxic int")
    docs = documents.select("doc_id", "text").union(documents.select("doc_id", "text").limit(3))  # rows that are equal are scored alike
    whole = X.learnt_from(docs, labels)
    monkeypatch.setattr(X, "BROADCAST", 3)
    parted = X.learnt_from(docs, labels)
    assert whole.table is None and parted.table.count() == len(whole.head) > 3
    a, b = (sorted((r.doc_id, r.r, r.n) for r in X.log_ratios(docs, m).collect()) for m in (whole, parted))
    assert a == b and len(a) == docs.count() and any(r for _, r, _ in a)
