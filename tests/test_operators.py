import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexforge.functions import patterns as P
from lexforge.operators import bpe, evaluate, frequency, mapping, selection


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def as_dict(df):
    return {r[0]: r[1] for r in df.collect()}


def test_frequency(spark):
    got = as_dict(frequency.token_frequency(docs(spark, "def foo(): return foo() + foo()")))
    assert (got["def"], got["foo"], got["return"], got["("], got[")"]) == (1, 3, 1, 3, 3)
    got = as_dict(frequency.boosted_frequency(docs(spark, "getUserId getUserId", None, ""), 0.5))
    assert got == {"getUserId": 2, "get": 1, "User": 1, "Id": 1}
    assert as_dict(frequency.boosted_frequency(docs(spark, "a_b " * 10), 0.3))["a"] == 3
    assert as_dict(frequency.boosted_frequency(docs(spark, "x" * 51 + " ok"))) == {"ok": 1}


def test_selection(spark):
    freq = spark.createDataFrame([("e", 1_000_000), ("self.", 100), ("return", 200), ("deadbeef" * 4, 99)], "token string, freq long")
    cost = F.when(F.col("token") == "self.", 3).when(F.col("token") == "return", 2).otherwise(1)
    assert [r.token for r in selection.by_savings(freq, 10, cost).collect()] == ["return", "self."]
    assert selection.by_savings(freq, 0).count() == 0
    many = spark.range(6550).select(F.concat(F.lit("tok_"), "id").alias("token"), F.lit(5).cast("long").alias("freq"))
    assert selection.by_savings(many, 6500).count() == 6400 and selection.by_savings(many, 6500, supplementary=True).count() == 6500


@pytest.mark.parametrize("target", [0.1, 0.5, 0.6, 0.95, 0.999])
def test_coverage(spark, target):
    rows = [("aa", 50), ("bb", 20), ("cc", 20), ("dd", 5), ("ee", 4), ("x", 1)]
    freq = spark.createDataFrame(rows, "token string, freq long")
    want, run = set(), 0
    for t, n in rows[:-1]:
        if run >= target * 100:
            break
        want.add(t)
        run += n
    got = selection.by_coverage(freq, target)
    assert {r.token for r in got.collect()} == want
    assert selection.coverage_of(freq, got).first()[0] == pytest.approx(run / 100)
    assert selection.by_coverage(freq, target, most=1).count() == 1
    assert selection.by_coverage(freq.limit(0), target).count() == 0 and selection.coverage_of(freq.limit(0), freq).first()[0] == 0.0


def words(spark, *tokens):
    return spark.createDataFrame([(t, i + 1) for i, t in enumerate(tokens)], "word string, rank int")


def test_assignment(spark):
    taken = spark.createDataFrame([(0xE000,), (0xE005,)], "codepoint int")
    got = mapping.assign(words(spark, *"abcdef"), taken).orderBy("rank").collect()
    assert [r.codepoint for r in got] == [0xE001, 0xE002, 0xE003, 0xE004, 0xE006, 0xE007] and all(ord(r.pua) == r.codepoint for r in got)
    many = spark.range(6401).select(F.concat(F.lit("w"), "id").alias("word"), (F.col("id") + 1).cast("int").alias("rank"))
    assert mapping.assign(many).orderBy(F.desc("rank")).first().codepoint == 0xF0000
    assert mapping.assign(words(spark, "a"), skip_bmp=True).first().codepoint == 0xF0000
    with pytest.raises(ValueError):
        mapping.assign(words(spark, "a", "a"))
    with pytest.raises(ValueError):
        mapping.assign(spark.range(mapping.CAPACITY + 1).select(F.col("id").cast("string").alias("word"), (F.col("id") + 1).cast("int").alias("rank")))
    with pytest.raises(ValueError):
        mapping.validate(spark.createDataFrame([("a", 0xE000, "\ue000"), ("b", 0xE000, "\ue000")], "word string, codepoint int, pua string"))


TEXTS = ["calculateTotal(x) return", "def calculate_Total: é ​  x", "", "日本語 return\n\n", "\x00 👩‍💻 -> return", "no match here", "calculate calculateX"]
MAP = {"return": "\ue000", "calculate": "\ue001", "Total": "\ue002", "->": "\ue003", "(": "\ue004"}


def test_substitution(spark, tmp_path):
    rows = docs(spark, *TEXTS, None)
    table = spark.createDataFrame([(i, w, ord(c), c) for i, (w, c) in enumerate(MAP.items())], "rank int, word string, codepoint int, pua string")
    both = rows.select("doc_id", "text", mapping.substituted("text", MAP).alias("sub"), mapping.split_text("text", MAP).alias("pieces"))
    got = {r.doc_id: r for r in both.collect()}
    assert got[0].sub == "\ue001\ue002\ue004x) \ue000" and got[1].sub.startswith("def \ue001_\ue002:") and got[7].sub is None
    assert all("".join(r.pieces) == r.sub for r in got.values() if r.sub is not None) and got[5].pieces == ["no", " ", "match", " ", "here"]
    joined = as_dict(mapping.substituted_by_join(rows, table))
    assert all((joined[i] or "") == (r.sub or "") for i, r in got.items())
    back = as_dict(both.select("doc_id", mapping.restored("sub", MAP)))
    assert all(back[i] == t for i, t in enumerate(TEXTS))
    assert [r[0] for r in docs(spark, "a\ue000", "b").select(mapping.has_mapped_character("text", MAP)).collect()] == [True, False]
    mapping.save(table, str(tmp_path / "m"))
    assert mapping.as_dict(mapping.load(spark, str(tmp_path / "m"))) == MAP


def brute_merge(piece, ids):
    part = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        ways = [(ids[a + b], i) for i, (a, b) in enumerate(zip(part, part[1:], strict=False)) if a + b in ids]
        if not ways:
            return [ids[p] for p in part]
        i = min(ways)[1]
        part[i : i + 2] = [part[i] + part[i + 1]]


def test_bpe(spark, tmp_path):
    rows = docs(spark, *["low lower lowest new newer newest wide wider " * 5] * 3, *TEXTS)
    vocabulary = bpe.train(bpe.piece_counts(rows), 320)
    assert len(vocabulary) <= 320 and vocabulary.special["<|endoftext|>"] == 0 and vocabulary.merges
    vocabulary.add([*MAP.values(), "self)"])
    vocabulary.save(spark, str(tmp_path))
    again = bpe.Vocabulary.load(spark, str(tmp_path))
    assert (again.ids, again.special, again.added, again.merges) == (vocabulary.ids, vocabulary.special, vocabulary.added, vocabulary.merges)
    codec = bpe.Codec(again, MAP)
    for t in ["lowest newer", "aaaa" * 40, "lowlowlow" * 20, "é漢", "x"]:
        assert codec.merged(t.encode()) == brute_merge(t.encode(), again.ids)
    odd = docs(spark, *TEXTS, "a<|im_start|>b self) lowest", "<pad> </s>", "lone ́ marks ﻿", " \t\n  x ")
    done = evaluate.round_trip(odd, codec)
    assert done.filter("NOT ok").count() == 0
    ids = codec.encode_substituted("a<|im_start|>b")
    assert codec.decode(ids) == "a<|im_start|>b" and codec.decode(ids, skip_special=True) == "ab" and codec.decode([10**6]) == ""
    with pytest.raises(ValueError):
        bpe.train(bpe.piece_counts(rows), 200)


def test_join_never_deals_out_by_token(spark):
    table = spark.createDataFrame([(i, w, ord(c), c) for i, (w, c) in enumerate(MAP.items())], "rank int, word string, codepoint int, pua string")
    out = mapping.substituted_by_join(docs(spark, *["a b return_x " * 50] * 3, None), table)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert set(re.findall(r"hashpartitioning\((\w+)#", plan)) == {"doc_id"}
    assert as_dict(out) == {0: "a b \ue000_x " * 50, 1: "a b \ue000_x " * 50, 2: "a b \ue000_x " * 50, 3: ""}


def test_batches_are_bounded(spark):
    """What a worker gets at once, though the session asks for more."""
    for name in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.set(f"spark.sql.execution.arrow.{name}", str(1 << 30))
    texts = spark.range(0, 3000, 1, 1).select("id", F.repeat(F.lit("return é "), 400).alias("text"))

    @F.pandas_udf("long")
    def held(x):
        return x.map(lambda _: len(x))

    mapping.split_text("text", MAP)
    assert texts.select(held("text").alias("n")).agg(F.max("n")).first()[0] <= 1000
    sizes = texts.select(F.size(mapping.split_text("text", MAP)).alias("n")).distinct().collect()
    assert [r.n for r in sizes] == [1600]


def learnt(pieces, merges):
    """Merges of {piece: n} by counting all pairs anew each time."""
    first = len(P.SPECIAL_TOKENS)
    ids = {bytes([b]): first + i for i, b in enumerate(bpe._BYTE[c] for c in sorted(bpe._TABLE))}
    parts, out = {p: [bytes([b]) for b in p.encode()] for p in pieces}, []
    while len(out) < merges:
        count = Counter()
        for p, part in parts.items():
            for pair in zip(part, part[1:], strict=False):
                count[pair] += pieces[p]
        a, b = best = min(count, key=lambda x: (-count[x], ids[x[0]], ids[x[1]]), default=(None, None))
        if count[best] < 2:
            break
        out.append(best)
        ids.setdefault(a + b, first + len(ids))
        for part in parts.values():
            i = 0
            while i + 1 < len(part):
                if (part[i], part[i + 1]) == best:
                    part[i : i + 2] = [a + b]
                i += 1
    return out


@pytest.mark.parametrize("most, pairs, chunk", [(60, 1 << 18, 1 << 19), (1 << 20, 1 << 18, 1 << 19), (200, 7, 50)])
def test_training_in_rounds(spark, monkeypatch, most, pairs, chunk):
    draw = random.Random(5)
    pieces = Counter("".join(draw.choices("abcé", (5, 3, 2, 1), k=draw.randint(1, 14))) for _ in range(400)) + Counter({"a" * 37: 3, "ab" * 20: 2})
    had, build = [], bpe._Words.__init__

    def noted(self, tokens, *rest):
        had.append(len(tokens))
        build(self, tokens, *rest)

    monkeypatch.setattr(bpe, "DRIVER_TOKENS", most)
    monkeypatch.setattr(bpe, "DRIVER_PAIRS", pairs)
    monkeypatch.setattr(bpe, "WORKER_TOKENS", chunk)
    monkeypatch.setattr(bpe._Words, "__init__", noted)
    rows = spark.createDataFrame([(bpe.to_chars(p.encode()), n) for p, n in pieces.items()], "piece string, n long")
    room = 70
    vocabulary = bpe.train(rows, room + 256 + len(P.SPECIAL_TOKENS))
    assert vocabulary.merges == learnt(pieces, room)
    assert all(n <= 2 * most for n in had)  # the driver's share, whatever the pieces are


def test_audit(spark):
    merges = spark.createDataFrame([(0, "\ue000", "\ue001"), (1, "a", "b"), (2, "\ue001", "\ue000")], "rank int, left string, right string")
    vocab = spark.createDataFrame([(0, "\ue000"), (1, "\ue001")], "id int, token string")
    named = vocab.select(F.col("token").alias("pua"))
    kept, counts = bpe.audited(merges, vocab, named)
    assert [r.left for r in kept.collect()] == ["a"] and counts == {"found": 2, "removed": 2}
    assert bpe.audited(merges, vocab, named, strict=False)[0].count() == 3
    with pytest.raises(ValueError):
        bpe.audited(merges, vocab.limit(1), named)
