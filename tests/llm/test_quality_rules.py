import math
import os
import re
from collections import Counter

import regex
from pyspark.sql import functions as F

from lexforge.llm import quality_rules as R


def brute(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def check(got, texts):
    for r in got:
        want = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want, r.doc_id
        assert not (r.kept and r.base_failed)


def test_documents(spark, sf_dir, documents):
    got = R.op8_risk_controlled_rules(spark, sf_dir).collect()
    check(got, {r.doc_id: r.text for r in documents.collect()})
    assert len(got) == documents.count()
    good = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").collect()}
    fine = [r.kept for r in got if r.doc_id in good and not r.base_failed]
    assert sum(fine) >= 0.9 * len(fine)


def test_verdicts_by_brute_force(spark, sf_dir):
    """Every cutoff of every rule and stratum against exact tails, on distinct texts; then every document against the cutoffs."""
    folder = "/root/testdata/sf0.1" if os.path.isdir("/root/testdata/sf0.1") else sf_dir
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    good = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    rows = [(r.doc_id, r.lang or "\0none", r.text or "") for r in docs.collect()]

    def steps_of(text):
        n, chars, symbols, dup, covered, failed = brute(text)
        lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in text.split("\n"))
        capitals = len(regex.findall(r"\p{Lu}", text))
        step = lambda a, b: min(R.GRID, math.ceil(R.GRID * a / b)) if b else 0
        return failed, dict(zip(R.RULES, (step(symbols, chars), step(dup, lines), step(capitals, chars), step(covered, n)), strict=True))

    known = {t: steps_of(t) for _, _, t in rows}
    trials = {}
    for d, lang, t in rows:
        if d in good and not known[t][0]:
            trials[lang, t] = max(trials.get((lang, t), 0), good[d])
    strata, cuts = {lang for lang, _ in trials}, {}
    p = R.RISK / len(R.RULES)
    for lang in strata:
        for rule in R.RULES:
            cells = [(known[t][1][rule], y) for (at, t), y in trials.items() if at == lang]
            n, bad = sum(y for _, y in cells), sum(1 - y for _, y in cells)
            best = None
            for cut in range(R.GRID - 1, -1, -1):
                k, caught = sum(y for s, y in cells if s > cut), sum(1 - y for s, y in cells if s > cut)
                tail = 1.0 if k >= n * p else sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
                if tail > R.LEVEL / (len(R.RULES) * len(strata)):
                    break
                gain = caught / max(bad, 1) - R.MISTAKE * k / max(n, 1)
                if gain > 0 and (best is None or gain > best[0]):
                    best = gain, cut
            if best:
                cuts[lang, rule] = best[1]
    want = sorted((d, not known[t][0] and not any(known[t][1][r] > cuts.get((lang, r), R.GRID) for r in R.RULES)) for d, lang, t in rows)
    assert sorted((r.doc_id, r.kept) for r in R.op8_risk_controlled_rules(spark, folder).collect()) == want


def test_copies_are_one_trial(spark):
    text = " ".join(f"word{i}" for i in range(40))
    docs = spark.createDataFrame([(i, text + " #" * 30, "en") for i in range(3000)] + [(5000 + i, text + f" n{i}", "en") for i in range(900)], "doc_id long, text string, lang string")
    labels = docs.select("doc_id", F.when(F.col("doc_id") < 5000, 0).otherwise(1).alias("quality"))
    # good documents are one trial each, the 3,000 bad copies one in all: cutoffs are certified by the 900 alone
    got = R.judged(docs, labels).groupBy("kept").count().collect()
    assert {r.kept: r["count"] for r in got} == {True: 900, False: 3000}
    few = R.judged(docs.filter("doc_id < 5001").withColumn("text", F.concat(F.lit(text), F.lit(" #"))), labels.withColumn("quality", F.lit(1)))
    assert few.filter("NOT kept").count() == 0  # 3,001 good rows of one text are no evidence


def test_binomial_tail(spark):
    cases = [(k, n, p) for n in (1, 7, 100, 900) for k in (0, 1, 3, 9) if k <= n for p in (0.01, 0.2)]
    for p in (0.01, 0.2):
        got = spark.createDataFrame([(k, n) for k, n, q in cases if q == p], "k long, n long").withColumn("t", R.binomial_tail(F.col("k"), F.col("n"), p)).collect()
        for r in got:
            want = sum(math.comb(r.n, i) * p**i * (1 - p) ** (r.n - i) for i in range(r.k + 1))
            assert r.t == 1.0 if r.k >= r.n * p else abs(r.t - want) < 1e-9


def test_cutoffs(spark):
    """A cutoff is certified if the exact tail, corrected for rules and strata, allows it; the least certified one that gains is taken."""
    rows = [("a", 1, 0, 0, 0, 0)] * 2000 + [("a", 0, 40, 0, 0, 0)] * 300 + [("b", 1, 0, 0, 0, 0)] * 20 + [("b", 0, 40, 0, 0, 0)] * 20
    got = R.cutoffs(spark.createDataFrame(rows, "stratum string, good int, symbols int, dup_lines int, capitals int, repeats int").withColumn("good", F.col("good").cast("long"))).collect()
    assert [(r.stratum, r.rule, r.rejected) for r in got] == [("a", "symbols", 0)] and 0 <= got[0].cutoff < 40
    assert abs(got[0].p_value - 0.99**2000) < 1e-9


def test_messy_rows(messy, empty, marks, no_marks):
    texts = {r.doc_id: r.text for r in messy.filter("doc_id IS NOT NULL").collect()}
    for labels in (marks, no_marks):
        got = R.judged(messy, labels).collect()
        assert len(got) == messy.count()
        check([r for r in got if r.doc_id is not None], texts)
        kept = R.kept_documents(messy, labels)
        assert kept.columns == messy.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.kept)
    assert R.judged(empty, marks).collect() == [] and R.kept_documents(empty, marks).collect() == []
