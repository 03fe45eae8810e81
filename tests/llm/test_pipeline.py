import corpus_pipeline as C
from lexforge.llm import near_dedup, packing, quality_mil, quality_rules, sanitise
from tests.llm.test_near_dedup import brute
from tests.llm.test_packing import check, library


def through(spark, docs, sf_dir, tmp_path):
    out = [docs]
    for k, (name, stage) in enumerate(C.STAGES):
        df = stage(spark, docs, sf_dir)
        df.write.parquet(f"file://{tmp_path}/{k}-{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{k}-{name}")
        out.append(docs)
    return out


def test_each_stage(spark, sf_dir, documents, tmp_path):
    """Each stage against what its operator says of its own input, row by row."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    raw, ruled, good, single, clean, packed = through(spark, documents, sf_dir, tmp_path)
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    assert all(d.columns == documents.columns for d in (ruled, good, single, clean))
    assert ids(ruled) == ids(quality_rules.judged(raw, labels).filter("kept"))
    model = quality_mil.fitted(ruled, labels)
    assert ids(good) == ids(quality_mil.scored(ruled, model).filter(f"__score >= {quality_mil.CUT}"))
    rows = good.orderBy("doc_id").collect()
    classes = brute([r.text for r in rows])
    of = {r.doc_id: c for r, c in zip(rows, classes, strict=True)}
    assert sorted(of[i] for i in ids(single)) == sorted(set(classes))
    want = {r.doc_id: r["__pii_text"] for r in sanitise.sanitised(single).collect()}
    assert {r.doc_id: r.text for r in clean.collect()} == want
    assert not any(any(sanitise.found(t)) for t in want.values())
    check(packed.collect(), list(want.items()), library())
    assert C.run(spark, sf_dir).count() == packed.count() and packing.CAPACITY == 2048 and near_dedup.SIMILARITY == 0.8


def test_messy_rows(spark, messy, empty, sf_dir, tmp_path):
    assert [d.columns for d in through(spark, messy, sf_dir, tmp_path / "a")[1:-1]] == [messy.columns] * 4
    assert through(spark, empty, sf_dir, tmp_path / "b")[-1].count() == 0
