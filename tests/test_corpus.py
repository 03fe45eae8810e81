from pyspark.sql import functions as F

from lexforge.sources import corpus
from lexforge.streaming import ingest

KEY = "AK" + "IA" + "ABCDEFGHIJKLMNOP"


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, data in {"a.py": b"x = 1\r\n", "sub/b.PY": b"y", "c.txt": b"no", "d.py": b"\xff\xfe", "e.py": b"z" * 2000}.items():
        (tmp_path / name).write_bytes(data)
    files = corpus.corpus_files(spark, str(tmp_path), [".py"], 1000)
    got = {r.path.rsplit("/", 1)[1]: r.text for r in corpus.decoded(files).collect()}
    assert got == {"a.py": "x = 1\n", "b.PY": "y", "d.py": None}


def test_status_and_stats(spark):
    rows = [("a", "same"), ("b", "same"), ("c", f"k = '{KEY}'"), ("d", f"k = '{KEY}'"), ("e", ""), ("f", None), ("g", "All Rights Reserved"), ("h", "# SPDX-License-Identifier: GPL-3.0")]
    docs = spark.createDataFrame(rows, "path string, text string")
    status = {r.path: r.status for r in corpus.judged(docs, licenses=True).collect()}
    assert status == {"a": "kept", "b": "dedup", "c": "secret", "d": "secret", "e": "size", "f": "decode", "g": "license", "h": "license"}
    loose = corpus.judged(docs, secrets=False)
    stats = corpus.ingest_stats(loose).first()
    assert (stats.n_seen, stats.n_kept, stats.dropped_dedup, stats.dropped_secret, stats.dropped_license) == (8, 4, 2, 0, 0)
    assert corpus.ingest_stats(docs.limit(0).transform(corpus.judged)).first().bytes_kept == 0


def test_shards_come_back(spark, tmp_path):
    docs = spark.createDataFrame([("a", 'q"\né'), ("b", "t")], "path string, text string").withColumn("sha256", F.sha2("text", 256))
    corpus.write_shards(docs, str(tmp_path / "s"), rows_per_file=1)
    assert sorted(corpus.read_shards(spark, str(tmp_path / "s")).collect()) == sorted(docs.collect())
    one, two = (corpus.corpus_hash(d.repartition(n)).first()[0] for d, n in ((docs, 1), (docs, 3)))
    assert one == two


def test_hub_split(spark):
    rows = spark.createDataFrame([("c" * 200, ["mit"], None), ("c" * 200, ["MIT"], None), ("short", ["MIT"], None), ("d" * 200, ["gpl"], ["ISC "]), ("e" * 200, None, None)], "content string, a array<string>, b array<string>")
    got = corpus.hub_split(rows, ["a", "b"]).collect()
    assert {r.content[0] for r in got} == {"c", "d"} and all((r.split == "holdout") == (r.sha256[0] == "0") for r in got)


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("a", "x"), ("b", "x"), ("c", ""), ("d", KEY), ("e", "y")], "path string, text string").write.json(str(src))
    ingest.start(ingest.kept(ingest.arriving(spark, str(src))), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.text for r in spark.read.json(str(tmp_path / "out")).collect()) == ["x", "y"]
