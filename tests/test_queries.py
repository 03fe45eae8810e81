"""Every query against its SQL, run by another engine over the same tables."""

import duckdb
import pytest

from lexforge import queries
from lexforge.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in ("documents", "pages", "part", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted([tuple(r[i] for i in order) for r in found], key=repr)


@pytest.mark.parametrize("name", list(SQL))
def test_as_the_sql_says(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir)
    want = duck.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


@pytest.mark.parametrize("hot", [256, 1])
@pytest.mark.parametrize("name", ["first_diff", "first_diff_context"])
def test_first_texts_of_languages(spark, tmp_path, monkeypatch, name, hot):
    """No task gets all texts of a language, and texts without one are compared as well."""
    monkeypatch.setattr(queries, "HOT_LANGS", hot, raising=False)
    langs = ["de"] * 12 + ["en"] * 3 + [None] * 4 + ["fr"]
    table = [(i, f"text {i % 5} of {lang}" if i % 6 else None, lang) for i, lang in enumerate(langs, 1)]
    spark.createDataFrame(table, "doc_id long, text string, lang string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(SQL[name])
    assert rows(got.columns, got.collect()) == rows([d[0] for d in want.description], want.fetchall())
    if hot == 256:
        plan = got._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
