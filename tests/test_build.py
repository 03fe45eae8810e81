import pytest

from lexforge.plans import build as B
from lexforge.operators import evaluate

SMALL = {"vocab_size": 2000, "pua_budget": 200, "min_bpe_budget": 1500, "min_frequency": 1}


def test_config(tmp_path):
    for bad in ({"vocab_size": 100}, {"coverage_target": 1.0}, {"max_token_len": 0}, {"pua_budget": -1}, {"min_bpe_budget": 10}, {"vocab_size": 2000}):
        with pytest.raises(ValueError):
            B.Config(**bad)
    (tmp_path / "c.toml").write_text('vocab_size = 200000\nunknown = 1\nextensions = [".py"]\n')
    assert B.Config.from_toml(str(tmp_path / "c.toml")).extensions == (".py",)
    with pytest.raises(ValueError):
        B.Config.from_toml(str(tmp_path / "c.toml"), strict=True)
    assert all(B.preset(p).to_dict()["pua_budget"] == 50_000 for p in B.PRESETS)


def test_build(spark, tmp_path):
    source = tmp_path / "src"
    source.mkdir()
    (source / "a.py").write_text("def calculate_total(values):\n    return sum(values)\n" * 100)
    (source / "b.py").write_text("class UserService:\n    def getUser(self, user_id):\n        return self.users[user_id]\n" * 100)
    (source / "c.py").write_text((source / "a.py").read_text())
    one = B.build(spark, str(source), str(tmp_path / "m"), B.Config(**SMALL))
    assert one["ingest_stats"]["dropped_dedup"] == 1 and one["pua_mapping_size"] > 5 and 0 < one["coverage_achieved"] <= 1
    assert B.read_manifest(spark, str(tmp_path / "m"))["vocab_hash"] == one["vocab_hash"]
    two = B.build(spark, str(source), str(tmp_path / "n"), B.Config(**SMALL))
    assert B.manifest_diff(one, two) == [] and B.manifest_diff(one, two | {"version": 2}) == ["version"]
    codec = B.load_codec(spark, str(tmp_path / "m"))
    texts = spark.createDataFrame([(1, (source / "b.py").read_text()), (2, "unseen ünïcode 😀 <|endoftext|>")], "doc_id long, text string")
    assert evaluate.round_trip(texts, codec).filter("NOT ok").count() == 0
    assert B.main(["roundtrip-check", str(tmp_path / "m"), str(source)]) == 0 and B.main(["info", str(tmp_path / "m"), "--summary"]) == 0


def test_nothing_to_count(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("   \n")
    with pytest.raises(ValueError, match="no tokens"):
        B.build(spark, str(tmp_path / "src"), str(tmp_path / "m"), B.Config(**SMALL))
