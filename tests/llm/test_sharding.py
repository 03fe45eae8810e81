import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lexforge.llm.sharding import SHARDS, histogram_shards


def check(got, docs):
    want = sorted((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in docs if d is not None)
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in got if r.doc_id is not None) == want
    assert len(got) == len(docs)
    slots = defaultdict(list)
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < SHARDS
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return slots


def test_sizes_are_near_equal_and_copies_lie_together(documents):
    got = histogram_shards(documents).collect()
    check(got, [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()])
    size, groups = defaultdict(int), defaultdict(set)
    for r in got:
        size[r.shard] += r["size"]
        groups[r.text_crc32].add(r.shard)
    # a row is never cut, so a shard is off by a row at most
    assert max(size.values()) - sum(size.values()) / SHARDS <= max(r["size"] for r in got)
    assert max(len(s) for s in groups.values()) <= 2


def test_messy_rows(messy):
    docs = [(r[0], r[1]) for r in messy.select("doc_id", "text").collect()]
    check(histogram_shards(messy).collect(), docs)


def test_carried_columns(messy):
    """Also those that are named as columns of the result, or as the operator's own."""
    docs = messy.withColumns({"size": F.length("text"), "cell": F.lit("c"), "part": F.lit("p"), "k_row": F.lit("k"), "__row": F.lit("r")})
    got = histogram_shards(docs, carry=("first", "shard", "size", "cell", "part", "k_row", "__row")).collect()
    check(got, [(r[0], r[1]) for r in messy.select("doc_id", "text").collect()])
    of = {r.doc_id: len(r.text) for r in messy.collect() if r.doc_id is not None and r.text is not None}
    assert all((r["first"], r["shard_carried"], r["cell"], r["part"], r["k_row"], r["__row"]) == ("x", "x", "c", "p", "k", "r") for r in got)
    assert all(r["size_carried"] == of[r.doc_id] for r in got if r.doc_id in of)


def test_repeated_rows_fill_many_shards(spark):
    docs = spark.range(3000).selectExpr("CASE WHEN id % 2 = 0 THEN 7L END AS doc_id", "'same text' AS text")
    got = histogram_shards(docs).collect()
    sizes = Counter(r.shard for r in got)
    assert len(got) == 3000 and len(sizes) == SHARDS and max(sizes.values()) - min(sizes.values()) <= 5
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in sizes.items())


def test_one_group_fills_many_shards(spark):
    docs = spark.range(5000).selectExpr("id AS doc_id", "'same text' AS text")
    sizes = [len(s) for s in check(histogram_shards(docs).collect(), [(i, "same text") for i in range(5000)]).values()]
    assert len(sizes) == SHARDS and max(sizes) - min(sizes) <= 5


def test_no_rows(empty):
    assert histogram_shards(empty).collect() == []
