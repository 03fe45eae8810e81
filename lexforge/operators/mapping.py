"""The bijection of words and private-use code points, and texts under it."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexforge.functions import batches as A
from lexforge.functions import patterns as P
from lexforge.functions import text as X

#: Tokens that a worker keeps with what becomes of them, and how long they may be.
KEPT, KEPT_CHARS = 1 << 17, 64
CAPACITY = sum(b - a + 1 for a, b in P.PUA_RANGES)


def free_codepoints(spark, taken: DataFrame | None, skip_bmp: bool = False) -> DataFrame:
    """rank (from 1) and codepoint, in the order of allocation; CAPACITY rows at most."""
    ranges = P.PUA_RANGES[1:] if skip_bmp else P.PUA_RANGES
    all_ = None
    for a, b in ranges:
        part = spark.range(a, b + 1).select(F.col("id").cast("int").alias("codepoint"))
        all_ = part if all_ is None else all_.union(part)
    if taken is not None:
        all_ = all_.join(taken.select("codepoint").distinct(), "codepoint", "left_anti")
    return all_.select(F.row_number().over(W.orderBy("codepoint")).alias("rank"), "codepoint")


def assign(words: DataFrame, taken: DataFrame | None = None, skip_bmp: bool = False) -> DataFrame:
    """rank, word, codepoint and pua for ``words`` (word, rank from 1): the k-th word gets the k-th free code point.

    Words must be distinct, and no more than there are code points without all those taken.
    """
    spark, words = words.sparkSession, words.persist()  # CAPACITY rows at most; all tokens are counted for them
    n, distinct = words.agg(F.count("*"), F.count_distinct("word")).first()
    if n != distinct:
        raise ValueError("a word occurs twice")
    used = 0 if taken is None else taken.select("codepoint").distinct().count()
    room = CAPACITY - used - (P.PUA_RANGES[0][1] - P.PUA_RANGES[0][0] + 1 if skip_bmp else 0)
    if n > room:
        raise ValueError(f"{n} words, but {room} private-use code points are free")
    return words.join(free_codepoints(spark, taken, skip_bmp), "rank").select("rank", "word", "codepoint", X.character("codepoint").alias("pua"))


def ranked(selected: DataFrame, *order) -> DataFrame:
    """word and rank of selected tokens; they are as many as code points at most."""
    return selected.select(F.col("token").alias("word"), F.row_number().over(W.orderBy(*order)).alias("rank"))


def validate(mapping: DataFrame) -> None:
    n, words, codes, private = mapping.agg(F.count("*"), F.count_distinct("word"), F.count_distinct("codepoint"), F.count_if(X.is_private_use("pua"))).first()
    if not n == words == codes == private:
        raise ValueError("not a bijection of words and private-use characters")


def save(mapping: DataFrame, path: str) -> None:
    mapping.write.mode("overwrite").parquet(path)


def load(spark, path: str) -> DataFrame:
    mapping = spark.read.parquet(path)
    validate(mapping)
    return mapping


def as_dict(mapping: DataFrame) -> dict[str, str]:
    """At most CAPACITY entries."""
    return {r["word"]: r["pua"] for r in mapping.select("word", "pua").collect()}


_identifier = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")
_weave = re.compile("_|" + P.IDENTIFIER_RUNS)


def parts_of(token: str, words: dict[str, str]) -> list[str]:
    """What becomes of one token: its character; or, for an identifier, those of its parts; or itself."""
    if token in words:
        return [words[token]]
    if _identifier.match(token):
        runs = _weave.findall(token)
        if any(r in words for r in runs) and "".join(runs) == token:
            return [words.get(r, r) for r in runs]
    return [token]


#: The same pattern as this engine spells it.
_token = regex.compile(re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", P.TOKEN).replace("(?U:", "(?:") + "|(?s:.)")


def substituted_text(text: str, words: dict[str, str]) -> str:
    """As ``substituted``, for one text on the driver or in a worker."""
    return "".join("".join(parts_of(t, words)) for t in _token.findall(text)) if words else text


def substituted(text: Column | str, words: dict[str, str]) -> Column:
    """The text with mapped words and parts as single characters. Tokens are found in the JVM; the dictionary is in the worker."""
    A.bounded_batches()

    @F.pandas_udf("string")
    def join(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, str] = {}  # long tokens come again seldom
        spell = lambda t: "".join(parts_of(t, words))
        for batch in batches:
            out = []
            for tokens in batch:
                if tokens is None:
                    out.append(None)
                    continue
                for t in tokens:
                    if t not in known and len(t) <= KEPT_CHARS:
                        known[t] = spell(t)
                out.append("".join([known[t] if len(t) <= KEPT_CHARS else spell(t) for t in tokens]))
                if len(known) > KEPT:
                    known.clear()
            yield pd.Series(out, dtype=object)

    return join(X.tokens_and_gaps(text)) if words else (F.col(text) if isinstance(text, str) else text)


def split_text(text: Column | str, words: dict[str, str]) -> Column:
    """The pieces: stretches between tokens, characters of words and parts, tokens that stay."""
    A.bounded_batches()

    @F.pandas_udf("array<string>")
    def cut(tokens: pd.Series, marks: pd.Series) -> pd.Series:
        out = []
        for ts, ms in zip(tokens, marks, strict=True):
            if ts is None:
                out.append(None)
                continue
            pieces, gap = [], ""
            for t, m in zip(ts, ms, strict=True):
                if not m:
                    gap += t
                    continue
                if gap:
                    pieces.append(gap)
                    gap = ""
                pieces += parts_of(t, words)
            out.append(pieces + [gap] if gap else pieces)
        return pd.Series(out, dtype=object)

    t = F.col(text) if isinstance(text, str) else text
    return cut(X.tokens_and_gaps(t), F.regexp_extract_all(t, F.lit(f"({P.TOKEN})|(?s:.)"), F.lit(1)))


def substituted_by_join(docs: DataFrame, mapping: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key`` and ``sub``, by joins alone. The mapping has CAPACITY rows at most, so it is broadcast; tokens are dealt out by ``key``, never by token."""
    small = lambda c, pua: F.broadcast(mapping.select(F.col("word").alias(c), F.col("pua").alias(pua)))
    rows = docs.select(key, F.posexplode_outer(X.tokens_and_gaps("text")).alias("pos", "token")).join(small("token", "whole"), "token", "left")
    # what isn't an identifier, or is a single run, is one piece and has no character
    woven = F.when(F.col("whole").isNull() & X.is_identifier("token"), X.identifier_weave("token")).otherwise(F.array("token"))
    parts = rows.select(key, "pos", "whole", F.posexplode(woven).alias("i", "piece")).join(small("piece", "pua"), "piece", "left")
    part = F.struct("pos", "i", F.coalesce("whole", "pua", "piece").alias("p"))
    return parts.groupBy(key).agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(part)), lambda x: x["p"])).alias("sub"))


def restored(text: Column | str, words: dict[str, str]) -> Column:
    """Back from ``substituted``: each mapped character becomes its word."""
    A.bounded_batches()
    back = {ord(c): w for w, c in words.items()}

    @F.pandas_udf("string")
    def translate(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: None if t is None else t.translate(back))

    t = F.col(text) if isinstance(text, str) else text
    return translate(t) if words else t


def has_mapped_character(text: Column | str, mapping: dict[str, str]) -> Column:
    """Whether a text already holds a mapped character, which would come back as a word."""
    t = F.col(text) if isinstance(text, str) else text
    codes = F.array(*[F.lit(ord(c)) for c in mapping.values()]) if mapping else F.array().cast("array<int>")
    return F.arrays_overlap(X.private_use_codepoints(t), codes)
