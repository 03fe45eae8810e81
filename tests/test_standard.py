import json
import random
import warnings

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexforge.functions import text as X
from lexforge.operators import baseline, batch, bpe, mapping
from lexforge.sources import corpus, standard


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    words = {"the": "\U000f0000", "and": "\U000f0001", "token": "\U000f0002"}
    vocabulary = bpe.train(bpe.piece_counts(docs.select(mapping.substituted("text", words).alias("text"))), 900)
    vocabulary.add([*words.values(), "    ", "== ", "=="])
    return docs, bpe.Codec(vocabulary, words)


def test_ids_are_those_of_the_tokenizers_library(spark, model, tmp_path):
    docs, codec = model
    standard.write_tokenizer(spark, codec.vocabulary, f"file://{tmp_path}/tokenizer.json")
    library = Tokenizer.from_file(str(tmp_path / "tokenizer.json"))
    rows = docs.select("doc_id", mapping.substituted("text", codec.words).alias("sub"), codec.encode_column("text").alias("ids")).collect()
    assert len(rows) == docs.count() and sum(len(r.ids or []) for r in rows) > 10_000
    for r in rows:
        if r["sub"] is not None:
            assert library.encode(r["sub"], add_special_tokens=False).ids == r.ids
    for t in ("x ==  y    z", "== ===", "\U000f0000\U000f0000 a", "naïve 日本\n\n  x"):
        assert library.encode(t, add_special_tokens=False).ids == codec.encode_substituted(t)


def test_merges_are_those_of_the_tokenizers_library(spark):
    """Where no two pairs are equally frequent the order of merges is settled, so it can be compared."""
    from tokenizers import models, pre_tokenizers, trainers

    rng = random.Random(3)
    texts = [" ".join(rng.choices(["low", "lower", "newest", "widest", "aaaa", "aaab", "banana"], [61, 29, 83, 47, 17, 7, 37], k=200)) for _ in range(20)]
    got = bpe.train(bpe.piece_counts(spark.createDataFrame([(t,) for t in texts], "text string")), 256 + 6, special=())
    library = Tokenizer(models.BPE())
    library.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    library.train_from_iterator(texts, trainers.BpeTrainer(vocab_size=256 + 6, min_frequency=2, initial_alphabet=pre_tokenizers.ByteLevel.alphabet(), show_progress=False))
    want = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in json.loads(library.to_str())["model"]["merges"]]
    assert [(bpe.to_chars(a), bpe.to_chars(b)) for a, b in got.merges] == want


def test_a_tokenizer_file_comes_back(spark, model, tmp_path):
    _, codec = model
    path = f"file://{tmp_path}/t.json"
    standard.write_tokenizer(spark, codec.vocabulary, path)
    assert standard.read_tokenizer(spark, path) == codec.vocabulary
    old = json.loads(standard.read_text(spark, path))
    old["model"]["merges"] = [" ".join(m) for m in old["model"]["merges"]]  # the older form
    old["model"]["vocab"][codec.vocabulary.rows()[0][1]] = 0  # a special token that is in the vocabulary as well
    assert standard.vocabulary_of(old) == codec.vocabulary
    with pytest.raises(ValueError):
        standard.vocabulary_of({"model": {"type": "Unigram", "vocab": {}, "merges": []}})


def test_mapping_files(spark, tmp_path):
    path = f"file://{tmp_path}/m.json"
    rows = spark.createDataFrame([(1, "b", 0xE001, ""), (2, "a", 0xE000, "")], "rank int, word string, codepoint int, pua string")
    standard.write_mapping(spark, rows, path)
    assert json.loads((tmp_path / "m.json").read_text()) == {"a": 0xE000, "b": 0xE001}
    assert [(r["rank"], r.word, r.pua) for r in standard.read_mapping(spark, path).orderBy("rank").collect()] == [(1, "a", ""), (2, "b", "")]
    for bad in ({"a": 0xE000, "b": 0xE000}, {"a": 0xD800}, {"a": 65}, {"a": "x"}):
        standard.write_text(spark, path, json.dumps(bad))
        with pytest.raises(ValueError):
            standard.read_mapping(spark, path)


def test_audit_of_a_file(spark, tmp_path):
    vocabulary = bpe.train(bpe.piece_counts(spark.createDataFrame([("a",)], "text string")), 300, special=("<s>",), alphabet=("", ""))
    vocabulary.ids["".encode()] = 299
    vocabulary.merges = [("".encode(), "".encode()), (b"a", "".encode())]
    path = f"file://{tmp_path}/t.json"
    standard.write_tokenizer(spark, vocabulary, path)
    known = spark.createDataFrame([("",), ("",)], "pua string")
    assert standard.audit_file(spark, path, known, strict=False) == {"found": 1, "removed": 0}
    assert standard.audit_file(spark, path, known) == {"found": 1, "removed": 1}
    assert standard.audit_file(spark, path, known) == {"found": 0, "removed": 0}
    with pytest.raises(ValueError, match="1 private-use"):
        standard.audit_file(spark, path, spark.createDataFrame([("",)], "pua string"))
    model = json.loads(standard.read_text(spark, path))
    assert len(standard.broken_invariants({**model, "decoder": None, "pre_tokenizer": {"type": "Whitespace"}, "model": {"type": "WordLevel"}}, [""])) == 4
    assert standard.broken_invariants({**model, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Digits"}, {"type": "ByteLevel"}]}}, [""]) == []
    assert standard.tokenizer_config(("<s>", "</s>", "<|x|>"))["eos_token"] == "</s>"


def test_many_added_tokens_cost_no_more_than_few(spark):
    rng = random.Random(1)
    tokens = [chr(0xF0000 + i) for i in range(40_000)] + ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(2, 9))) for _ in range(5_000)]
    pattern = bpe.re.compile(bpe.trie_pattern(tokens))
    text = "".join(rng.choice("abcdefgh xyz") for _ in range(3000)) + "".join(rng.choice(tokens) for _ in range(300))
    longest = sorted(set(tokens), key=lambda t: -len(t))
    got, at = [m.group() for m in pattern.finditer(text)], 0
    by = {}
    for t in longest:
        by.setdefault(t[0], []).append(t)
    want = []
    while at < len(text):
        t = next((t for t in by.get(text[at], ()) if text.startswith(t, at)), None)
        if t:
            want.append(t)
        at += len(t) if t else 1
    assert got == want


def test_decoding_by_join_and_words(spark, model):
    docs, codec = model
    vocabulary = spark.createDataFrame(codec.vocabulary.rows(), "id int, token string, kind string")
    ids = docs.select("doc_id", codec.encode_column("text").alias("ids"))
    back = bpe.decoded_by_join(ids, vocabulary).select("doc_id", mapping.restored("text", codec.words).alias("t")).join(docs, "doc_id")
    assert back.filter("NOT (t <=> coalesce(text, ''))").count() == 0 and back.count() == docs.count()
    odd = spark.createDataFrame([(1, [99_999, codec.vocabulary.ids[b"a"], -1]), (2, []), (3, None)], "doc_id long, ids array<int>")
    assert sorted((r.doc_id, r.text) for r in bpe.decoded_by_join(odd, vocabulary).collect()) == [(1, "a"), (2, ""), (3, "")]
    rows = spark.createDataFrame([(["the", " and", None, "x"],), (None,)], "w array<string>").select("w", codec.encode_words_column("w").alias("ids")).collect()
    assert codec.decode(rows[0].ids) == "the andx" and rows[1].ids is None
    table = {i: t for i, t, _ in codec.vocabulary.rows()}
    assert codec.tokens_to_text([table[i] for i in codec.encode_substituted("naïve == x")]) == "naïve == x"
    assert mapping.substituted_text("the tokenAnd x", codec.words) == spark.createDataFrame([("the tokenAnd x",)], "t string").select(mapping.substituted("t", codec.words)).first()[0]
    less = bpe.without_special(codec.vocabulary, ["== ", "nothing"])
    assert len(less) == len(codec.vocabulary) - 1 and less.ids == codec.vocabulary.ids


def test_pairs_truncation_and_padding(spark, model):
    _, codec = model
    one = spark.range(1).select(*[F.array(*[F.lit(i) for i in x]).cast("array<int>").alias(n) for n, x in (("a", range(7)), ("b", range(10, 13)))])
    get = lambda *c: [list(x) for x in one.select(*c).first()]
    assert get(batch.truncated("a", 3), batch.truncated("a", 3, "left"), batch.truncated("b", 9)) == [[0, 1, 2], [4, 5, 6], [10, 11, 12]]
    for most in range(11):
        a, b = list(range(7)), [10, 11, 12]
        while len(a) + len(b) > most:
            (a if len(a) > len(b) else b).pop()
        assert get(*batch.pair_truncated("a", "b", most)) == [a, b], most
    assert get(batch.padded("b", 5, 9), batch.padded("b", 5, 9, "left"), batch.padded("b", 2, 9), batch.attention_mask("b", 5)) == [[10, 11, 12, 9, 9], [9, 9, 10, 11, 12], [10, 11, 12], [1, 1, 1, 0, 0]]
    assert get(batch.joined("b", "b", (1,), (2, 3), (4,)), batch.type_ids("b", "b", 1, 2, 1)) == [[1, 10, 11, 12, 2, 3, 10, 11, 12, 4], [0] * 6 + [1] * 4]
    docs = spark.createDataFrame([(1, "the cat sat", "and more"), (2, "x", None), (3, None, "y"), (4, "", "")], "id long, text string, other string")
    got = {r.id: r for r in batch.encoded(docs, codec, pair="other", most=8, pad=0, before=(1,), between=(2,), after=(3,)).collect()}
    assert all(len(r.input_ids) == len(r.attention_mask) == len(r.token_type_ids) for i, r in got.items() if i != 3) and got[3].input_ids is None
    assert len({len(r.input_ids) for i, r in got.items() if i != 3}) == 1 and max(sum(r.attention_mask) for i, r in got.items() if i != 3) == 8
    assert got[4].input_ids[:3] == [1, 2, 3] and sum(got[2].token_type_ids) == 0
    single = {r.id: r for r in batch.encoded(docs, codec, most=4).collect()}
    assert len(single[1].input_ids) == 4 and single[4].input_ids == [] and single[1].attention_mask == [1] * 4


def test_baselines_and_reports(spark, model, tmp_path):
    docs, codec = model
    lines = [b"%s %d" % (__import__("base64").b64encode(bytes([i])), i) for i in range(256)] + [b"dGhl 256", b"aGU= 257"]
    (tmp_path / "r.tiktoken").write_bytes(b"\n".join(lines))
    ranks = baseline.rank_file(str(tmp_path / "r.tiktoken"))
    assert ranks.encode("the") == [256] and ranks.decode(ranks.encode("the né")) == "the né" and ranks.vocab_size == 258
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        found = baseline.available({"ranks": lambda: ranks, "gone": lambda: baseline.rank_file("/nowhere")})
        assert [a.name for a in found] == ["ranks"] and len(said) == 1
        baseline._warned.clear()
        assert baseline.default_baseline().encode("abc") == [0] and baseline.default_baseline("/nowhere").name == "none"
        assert sum("no baseline" in str(w.message) for w in said) == 1
    counts = docs.limit(50).select("text", ranks.count_column("text").alias("n")).collect()
    assert all(r.n == (len(ranks.encode(r.text)) if r.text else 0) for r in counts)
    records = baseline.benchmark(docs.limit(40), [baseline.raw_bytes(), baseline.characters(), ranks, baseline.own(codec)], "bytes")
    by = {r["tokenizer"]: r for r in records}
    assert by["bytes"]["ratio"] == 1 and by["bytes"]["n_tokens"] == by["bytes"]["n_bytes"] and all(r["n_exact"] == r["n_files"] for r in records)
    assert by["own"]["n_tokens"] < by["ranks"]["n_tokens"] and records[0]["tokenizer"] == "own" and by["own"]["encode_us_p50"] >= 0
    baseline.write_report(spark, records, f"file://{tmp_path}", title="T")
    assert json.loads((tmp_path / "report.json").read_text())[0]["tokenizer"] == "own" and (tmp_path / "report.md").read_text().count("\n| ") == 5
    assert baseline.markdown([]).startswith("# Tokenizers")
    baseline.write_top(spark, docs.select("doc_id"), f"file://{tmp_path}/top.json", 3, "doc_id")
    assert len(json.loads((tmp_path / "top.json").read_text())) == 3
    assert baseline.throughput(docs.limit(20), ranks)["texts_per_second"] > 0 and baseline.latency(ranks, "some text", 5)["mean_ms"] >= 0
    pairs = docs.limit(30).select("doc_id", "text", F.split("text", " ").alias("a"), F.split(F.replace("text", F.lit("the"), F.lit("a")), " ").alias("b"))
    differ = baseline.id_differences(pairs, F.col("a"), F.col("b")).collect()
    assert [r.n_different for r in differ] == sorted(r.n_different for r in differ) and all(r.n_different for r in differ)


def test_shards_of_bytes(spark, tmp_path):
    docs = spark.createDataFrame([(f"p{i:03}", "é" * (i * 7 % 90), None) for i in range(60)] + [("long", "x" * 5000, None)], "path string, text string, sha256 string").withColumn("sha256", F.sha2("text", 256)).coalesce(2)
    corpus.write_shards(docs, f"file://{tmp_path}/s", bytes_per_shard=1500)
    back = corpus.read_shards(spark, f"file://{tmp_path}/s")
    assert sorted(back.collect()) == sorted(docs.collect()) and back.columns == ["path", "text", "sha256"]
    size = F.octet_length(F.to_json(F.struct("path", "text", "sha256"))) + 1
    sums = corpus.sharded(docs, 1500).groupBy("shard").agg(F.sum(size).alias("n"), F.count("*").alias("rows")).collect()
    assert all(r.n <= 1500 or r["rows"] == 1 for r in sums) and len(sums) > 3


def test_holdout_and_gathering(spark):
    files = spark.createDataFrame([(f"d/{i:03}.{'py' if i % 2 else 'JS'}", i * 100) for i in range(100)], "path string, length long")
    a, b = (corpus.holdout(files.repartition(n), (".py", ".js"), 20, seed=7).collect() for n in (1, 5))
    assert sorted(a) == sorted(b) and len(a) == 20 and all(200 <= r.length <= 200_000 for r in a) and {r.kind for r in a} == {"py", "js"}
    assert [r.path for r in corpus.gathered(files, (".py",), 2).collect()] == ["d/001.py", "d/003.py"]


def test_repeated_records(spark):
    """Of records that are equal in all, and of equal texts, one is kept."""
    rows = [("a", "t")] * 3 + [("b", "t")] * 2 + [("b", "u"), ("b", "u"), (None, "u"), (None, "v"), (None, "v"), ("c", ""), ("c", ""), ("d", None), ("e", "solo")]
    for few in (1 << 17, 0):
        corpus.BROADCAST_KEYS = few
        got = corpus.judged(spark.createDataFrame(rows, "path string, text string").repartition(4)).collect()
        assert sorted((str(r.path), str(r.text), r.status) for r in got) == sorted(
            [("a", "t", "kept"), ("a", "t", "dedup"), ("a", "t", "dedup"), ("b", "t", "dedup"), ("b", "t", "dedup"), ("b", "u", "kept"), ("b", "u", "dedup"), ("None", "u", "dedup"),
             ("None", "v", "kept"), ("None", "v", "dedup"), ("c", "", "size"), ("c", "", "size"), ("d", "None", "decode"), ("e", "solo", "kept")]
        )
    corpus.BROADCAST_KEYS = 1 << 17


def test_differences(spark):
    assert spark.range(1).select(X.differences(F.array(F.lit(1), F.lit(2)), F.array(F.lit(1)))).first()[0] == 1
