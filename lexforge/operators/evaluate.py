"""Reports: compression, coverage, round trips, what candidates would save."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexforge.functions import text as X

#: Baselines that need no files: how many tokens a text has.
COUNTERS: dict[str, Callable[[Column], Column]] = {
    "bytes": F.octet_length,
    "chars": F.length,
    "gpt2_pieces": lambda t: F.size(X.pieces(t)),
    "tokens": lambda t: F.size(X.tokens(t)),
    "none": lambda t: F.when(F.length(t) > 0, 1).otherwise(0),
}


def percentiles(rows: DataFrame, value: str, group: str, percents: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """``group``, n, mean and exact nearest-rank percentiles of an integer column.

    Values are counted first: what is ordered are distinct values, not rows.
    """
    counts = rows.groupBy(group, value).agg(F.count("*").alias("__c"))
    upto = F.sum("__c").over(W.partitionBy(group).orderBy(value))
    of = W.partitionBy(group)
    placed = counts.select(group, value, "__c", upto.alias("__upto"), F.sum("__c").over(of).alias("__n"))
    at = lambda p: F.bround(F.lit(float(p)) / 100 * (F.col("__n") - 1)).cast("long")
    cols = [F.min(F.when(F.col("__upto") > at(p), F.col(value))).cast("long").alias(f"p{p}") for p in percents]
    return placed.groupBy(group).agg(F.max("__n").alias("n"), (F.sum(F.col(value) * F.col("__c")) / F.max("__n")).alias("mean"), *cols)


def compression_report(docs: DataFrame, counters: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """For each tokenizer: files, bytes, tokens, bytes per token and percentiles of tokens. Texts are read once."""
    counters = counters or COUNTERS
    cell = F.explode(F.array(*[F.struct(F.lit(k).alias("tokenizer"), f(F.col("text")).cast("long").alias("tokens")) for k, f in counters.items()]))
    rows = docs.filter(F.col("text").isNotNull()).select(F.octet_length("text").cast("long").alias("bytes"), cell.alias("x")).select("bytes", "x.*")
    total = rows.groupBy("tokenizer").agg(F.sum("bytes").alias("n_bytes"), F.sum("tokens").alias("n_tokens"))
    out = total.join(percentiles(rows, "tokens", "tokenizer"), "tokenizer")
    return out.select("tokenizer", F.col("n").alias("n_files"), "n_bytes", "n_tokens", F.round(F.col("n_bytes") / F.greatest(F.lit(1), F.col("n_tokens")), 6).alias("bytes_per_token"), F.round("mean", 6).alias("mean_tokens"), "p50", "p95", "p99")


def relative_to(report: DataFrame, reference: str) -> DataFrame:
    """``report`` (a few rows) and how many tokens each takes for one of the reference."""
    ref = report.filter(F.col("tokenizer") == reference).select(F.col("n_tokens").alias("__ref"))
    return report.join(F.broadcast(ref), how="cross").withColumn("ratio", F.round(F.col("n_tokens") / F.col("__ref"), 6)).drop("__ref")


def savings_analysis(docs: DataFrame, own: Callable[[Column], Column] = F.length, top: int = 30_000) -> DataFrame:
    """Pieces of a baseline: how often they occur, what our own tokenizer takes for one, and what an id for each would save."""
    counts = docs.select(F.explode(X.pieces("text")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    costed = counts.filter(~F.col("token").contains("�")).withColumn("cost", own(F.col("token")).cast("long"))
    return costed.filter("cost > 1").withColumn("savings", F.col("n") * (F.col("cost") - 1)).orderBy(F.desc("savings"), "token").limit(top)


def multi_patterns(docs: DataFrame, top: int = 100) -> DataFrame:
    """The most frequent pieces of a baseline that our own tokens would cut."""
    counts = docs.select(F.explode(X.pieces("text")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return counts.filter(X.multi_pattern("token")).orderBy(F.desc("n"), "token").limit(top)


def waste(docs: DataFrame) -> DataFrame:
    """One row: pieces of a baseline, how many of them our own tokens would cut, and their share in percent."""
    counts = docs.select(F.explode(X.pieces("text")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    cut = F.coalesce(F.sum(F.when(X.multi_pattern("token"), F.col("n"))), F.lit(0))
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_pieces"), cut.alias("n_cut"), F.round(F.coalesce(100 * cut / F.sum("n"), F.lit(0.0)), 6).alias("percent"))


def round_trip(docs: DataFrame, codec) -> DataFrame:
    """doc_id, n_tokens and whether the text comes back."""
    ids = docs.select("doc_id", "text", codec.encode_column("text").alias("ids"))
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), (codec.decode_column("ids") == F.col("text")).alias("ok"))


def coverage_of_patterns(patterns: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """pattern and whether it has an id of its own."""
    known = vocabulary.select(F.col("token").alias("__v")).distinct().withColumn("__in", F.lit(True))
    return patterns.join(known, X.spelled("pattern") == F.col("__v"), "left").select("pattern", F.coalesce("__in", F.lit(False)).alias("in_vocab"))


def added_matches(docs: DataFrame, patterns: list[str], text: str = "text") -> DataFrame:
    """Matches of a small set of added tokens, leftmost and longest first."""
    longest = sorted(patterns, key=lambda p: (-len(p), p))
    quoted = "|".join("\\Q" + p + "\\E" for p in longest)
    return docs.withColumn("matches", F.regexp_extract_all(F.col(text), F.lit(quoted), F.lit(0)))
