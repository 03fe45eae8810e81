"""Counts of tokens, and of the parts of identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.functions import text as X

MILLION = 1_000_000


def token_rows(docs: DataFrame, max_len: int = 50) -> DataFrame:
    return docs.select(F.explode(X.tokens("text")).alias("token")).filter(F.length("token") <= max_len)


def token_frequency(docs: DataFrame, max_len: int = 50) -> DataFrame:
    """token and n."""
    return token_rows(docs, max_len).groupBy("token").agg(F.count("*").alias("n"))


def bonus(parts: Column, weight: float) -> Column:
    """ceil(parts * weight), in whole numbers, so that no order of summing changes it."""
    return F.floor((parts * round(weight * MILLION) + (MILLION - 1)) / MILLION).cast("long") if weight else F.lit(0).cast("long")


def boosted_frequency(docs: DataFrame, weight: float = 0.3, max_len: int = 50) -> DataFrame:
    """token and freq: occurrences, and a bonus for occurrences as a part of another identifier.

    Identifiers are split once for each kind of token, not for each occurrence: parts are weighted with their token's count.
    """
    whole = token_frequency(docs, max_len)
    part = F.explode(F.when(X.is_identifier("token"), X.identifier_parts("token")))
    parts = whole.select("token", "n", part.alias("part")).filter("part <> token")
    both = whole.select("token", "n", F.lit(0).cast("long").alias("parts")).union(parts.select("part", F.lit(0).cast("long"), "n"))
    return both.groupBy("token").agg((F.sum("n") + bonus(F.sum("parts"), weight)).alias("freq"))
