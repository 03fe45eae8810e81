"""From a corpus to a tokenizer: ingest, count, select, map, train, audit, write."""

from __future__ import annotations

import argparse
import json
import platform
import sys
import time
import tomllib
from dataclasses import asdict, dataclass, fields
from datetime import UTC, datetime

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.functions import patterns as P
from lexforge.operators import bpe, evaluate, frequency, mapping, selection
from lexforge.sources import corpus

# Suffixes of files with code.
EXTENSIONS = (".py", ".js", ".ts", ".tsx", ".jsx", ".java", ".c", ".cpp", ".h", ".hpp", ".cs", ".rs", ".go", ".rb", ".php", ".swift", ".kt", ".scala", ".sh", ".sql", ".html", ".css", ".scss", ".json", ".yaml", ".yml", ".toml", ".md")


@dataclass(frozen=True)
class Config:
    vocab_size: int = 120_000
    pua_budget: int = 50_000
    coverage_target: float = 0.9
    max_token_len: int = 50
    boost_weight: float = 0.3
    min_bpe_budget: int = 50_000
    min_frequency: int = 2
    seed: int = 42
    allow_supplementary_pua: bool = False
    use_savings_selection: bool = True
    strict_pua_atomicity: bool = True
    pua_skip_bmp: bool = True
    extensions: tuple[str, ...] = EXTENSIONS
    special_tokens: tuple[str, ...] = P.SPECIAL_TOKENS
    workers: int = 0
    shard_size_bytes: int = 64 * 1024 * 1024
    license_allowlist: tuple[str, ...] = P.ALLOWED_LICENSES
    enable_secret_scrub: bool = True
    enable_license_filter: bool = False

    def __post_init__(self) -> None:
        floor = 256 + len(self.special_tokens) + self.pua_budget + self.min_bpe_budget
        rules = (
            (0 < self.coverage_target < 1, "coverage_target must lie between 0 and 1"), (self.vocab_size >= 1024, "vocab_size must be 1024 at least"),
            (self.max_token_len >= 1, "max_token_len must be positive"), (self.pua_budget >= 0, "pua_budget must not be negative"),
            (self.min_bpe_budget >= 256, "min_bpe_budget must be 256 at least"), (floor <= self.vocab_size, f"vocab_size must be {floor} at least for these budgets"),
        )
        for ok, why in rules:
            if not ok:
                raise ValueError(why)

    @classmethod
    def from_toml(cls, path: str, strict: bool = False) -> Config:
        """Unknown keys are ignored, or (if strict) an error."""
        with open(path, "rb") as f:
            found = tomllib.load(f)
        names = {f.name for f in fields(cls)}
        if strict and found.keys() - names:
            raise ValueError(f"unknown keys: {sorted(found.keys() - names)}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in found.items() if k in names})

    def to_dict(self) -> dict:
        return asdict(self)


PRESETS = {
    "default": {},
    "v4": {"allow_supplementary_pua": True, "special_tokens": ("<pad>", "<s>", "</s>", "<unk>", *P.SPECIAL_TOKENS[:6])},
    "v5": {"allow_supplementary_pua": True, "vocab_size": 200_000, "min_bpe_budget": 130_000},
}


def preset(name: str) -> Config:
    return Config(**PRESETS[name])


def selected(records: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    """The frequency table and the ranked words (word, rank) chosen from it."""
    freq = frequency.boosted_frequency(records, config.boost_weight, config.max_token_len).persist()
    if config.use_savings_selection:
        best = selection.by_savings(freq, config.pua_budget, max_len=config.max_token_len, supplementary=config.allow_supplementary_pua)
        return freq, mapping.ranked(best, F.desc("score"), "token")
    best = selection.by_coverage(freq, config.coverage_target, config.max_token_len, config.pua_budget)
    return freq, mapping.ranked(best, F.desc("freq"), "token")


def train(records: DataFrame, words: dict[str, str], config: Config, mode: str = "added") -> bpe.Vocabulary:
    """mode 'added': mapped characters are added tokens; 'alphabet': they are in the alphabet, and the vocabulary is of full size."""
    counts = bpe.piece_counts(records.select(mapping.substituted("text", words).alias("text")))
    if mode == "alphabet":
        return bpe.train(counts, config.vocab_size, config.min_frequency, config.special_tokens, tuple(words.values()))
    room = config.vocab_size - len(words)
    if room < 256 + len(config.special_tokens):
        raise ValueError("no room for merges")
    out = bpe.train(counts, room, config.min_frequency, config.special_tokens)
    out.add(sorted(words.values()))
    return out


def build(spark: SparkSession, source: str | DataFrame, output: str, config: Config | None = None) -> dict:
    """Build from a directory of files, or a DataFrame of path and text, into ``output``; returns the manifest."""
    config = config or Config()
    began, timing = time.time(), {}
    records = source if isinstance(source, DataFrame) else corpus.decoded(corpus.corpus_files(spark, source, config.extensions))
    status = corpus.judged(records, config.enable_secret_scrub, config.enable_license_filter, config.license_allowlist).persist()
    stats = corpus.ingest_stats(status).first().asDict()
    kept = status.filter("status = 'kept'").drop("status")
    corpus.write_shards(kept, f"{output}/shards", bytes_per_shard=config.shard_size_bytes)
    kept = corpus.read_shards(spark, f"{output}/shards")
    status.unpersist()
    timing["ingest"] = time.time() - began
    taken = corpus.private_use_inventory(kept).persist()
    freq, words = selected(kept, config)
    if freq.isEmpty():
        raise ValueError("the corpus has no tokens")
    mapped = mapping.assign(words, taken, config.pua_skip_bmp)
    mapping.save(mapped, f"{output}/mapping")
    mapped = mapping.load(spark, f"{output}/mapping")
    timing["select"] = time.time() - began
    vocabulary = train(kept, mapping.as_dict(mapped), config)
    vocabulary.save(spark, output)
    table = spark.read.parquet(f"{output}/vocab")
    _, audit = bpe.audited(spark.read.parquet(f"{output}/merges"), table, mapped, config.strict_pua_atomicity)
    timing["train"] = time.time() - began
    manifest = {
        "version": 1, "config": config.to_dict(), "corpus_hash": corpus.corpus_hash(kept).first()[0], "vocab_hash": bpe.vocabulary_hash(table).first()[0], "pua_mapping_size": mapped.count(),
        "pua_codepoints_in_corpus": sorted(r[0] for r in taken.select("codepoint").collect()), "audit": audit, "ingest_stats": stats, "timing_seconds": timing,
        "coverage_achieved": selection.coverage_of(freq, words.select(F.col("word").alias("token"))).first()[0], "timestamp_utc": datetime.now(UTC).isoformat(),
        "library_versions": {"pyspark": pyspark.__version__, "python": platform.python_version()}, "build_host_info": {"system": platform.system(), "machine": platform.machine()},
    }
    freq.unpersist(), taken.unpersist()
    write_manifest(spark, manifest, output)
    return manifest


def write_manifest(spark: SparkSession, manifest: dict, output: str) -> None:
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{output}/manifest")


def read_manifest(spark: SparkSession, output: str) -> dict:
    return json.loads(spark.read.text(f"{output}/manifest").first()[0])


def manifest_diff(a: dict, b: dict) -> list[str]:
    """The fields that differ, but for host, timing and time."""
    free = {"build_host_info", "timing_seconds", "timestamp_utc"}
    plain = lambda x: json.loads(json.dumps(x))
    return sorted(k for k in (a.keys() | b.keys()) - free if plain(a.get(k)) != plain(b.get(k)))


def load_codec(spark: SparkSession, path: str) -> bpe.Codec:
    return bpe.Codec(bpe.Vocabulary.load(spark, path), mapping.as_dict(mapping.load(spark, f"{path}/mapping")))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lexforge")
    commands = parser.add_subparsers(dest="command", required=True)
    b = commands.add_parser("build")
    b.add_argument("corpus"), b.add_argument("output"), b.add_argument("--config"), b.add_argument("--preset", default="default", choices=PRESETS)
    r = commands.add_parser("roundtrip-check")
    r.add_argument("model"), r.add_argument("corpus"), r.add_argument("--max-files", type=int, default=1000)
    i = commands.add_parser("info")
    i.add_argument("model"), i.add_argument("--summary", action="store_true")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if args.command == "build":
        config = Config.from_toml(args.config, strict=True) if args.config else preset(args.preset)
        print(json.dumps(build(spark, args.corpus, args.output, config)["ingest_stats"]))
        return 0
    if args.command == "info":
        manifest = read_manifest(spark, args.model)
        print(json.dumps({k: manifest[k] for k in ("pua_mapping_size", "coverage_achieved", "vocab_hash")} if args.summary else manifest, indent=1, sort_keys=True))
        return 0
    files = corpus.decoded(corpus.corpus_files(spark, args.corpus, EXTENSIONS)).filter("text IS NOT NULL").orderBy("path").limit(args.max_files)
    done = evaluate.round_trip(files.withColumnRenamed("path", "doc_id"), load_codec(spark, args.model))
    n, ok = done.agg(F.count("*"), F.count_if("ok")).first()
    print(f"{ok} of {n} texts came back")
    return int(ok != n)


if __name__ == "__main__":
    sys.exit(main())
