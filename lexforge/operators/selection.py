"""Which tokens get a code point of their own."""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.functions import text as X

BMP_SLOTS = 6400


def savings(freq: Column, cost: Column) -> Column:
    return freq * F.greatest(F.lit(0), cost - 1)


def by_savings(freq: DataFrame, budget: int, cost: Column | None = None, max_len: int = 50, least: int = 1, supplementary: bool = False) -> DataFrame:
    """token, freq and score of the tokens that save most tokens of a baseline, best first.

    freq: token and freq. cost: how many tokens the baseline takes for one; its length if not given.
    """
    n = max(0, min(budget, budget if supplementary else BMP_SLOTS))
    scored = freq.filter(X.good_token("token", max_len)).withColumn("score", savings(F.col("freq"), F.length("token") if cost is None else cost).cast("long"))
    return scored.filter(F.col("score") >= least).orderBy(F.desc("score"), "token").limit(n).select("token", "freq", "score")


def by_coverage(freq: DataFrame, target: float = 0.9, max_len: int = 50, most: int | None = None) -> DataFrame:
    """token and freq of the most frequent good tokens, up to the one that reaches ``target`` of all occurrences.

    Tokens of one frequency are counted together; only of the frequency at which the target is reached are tokens ranked.
    So no task orders all tokens.
    """
    total = freq.agg(F.sum("freq")).first()[0] or 0
    good = freq.filter(X.good_token("token", max_len))
    levels = good.groupBy("freq").agg(F.count("*").alias("n")).orderBy(F.desc("freq")).toLocalIterator()
    need, last, some = target * total, None, 0
    for r in levels:
        if need <= 0:
            break
        last = r["freq"]
        some = min(r["n"], math.ceil(need / last)) if last else r["n"]
        need -= last * r["n"]
    if last is None:
        return good.limit(0).select("token", "freq")
    out = good.filter(F.col("freq") > last).union(good.filter(F.col("freq") == last).orderBy("token").limit(some)).select("token", "freq")
    return out if most is None else out.orderBy(F.desc("freq"), "token").limit(max(1, most))


def select_by_coverage(*args, **kwargs) -> DataFrame:
    """The former name of ``by_coverage``."""
    warnings.warn("use by_coverage or by_savings", DeprecationWarning, stacklevel=2)
    return by_coverage(*args, **kwargs)


def coverage_of(freq: DataFrame, tokens: DataFrame) -> DataFrame:
    """One row: the share of all occurrences that ``tokens`` have; 0 if there are none."""
    hit = freq.join(tokens.select("token").distinct().withColumn("__hit", F.lit(True)), "token", "left")
    return hit.agg(F.coalesce(F.sum(F.when(F.col("__hit"), F.col("freq"))) / F.sum("freq"), F.lit(0.0)).alias("coverage"))


def new_candidates(candidates: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Candidates (token) whose byte-level spelling isn't in ``vocabulary`` (token)."""
    return candidates.join(vocabulary.select(F.col("token").alias("__v")), X.spelled("token") == F.col("__v"), "left_anti")


def compounds_by_savings(candidates: DataFrame, vocabulary: DataFrame, top: int, least: int = 10, max_len: int = 80) -> DataFrame:
    """Of the ``top`` candidates (token, savings) those that save enough, may be added and are new."""
    best = candidates.orderBy(F.desc("savings"), "token").limit(top)
    return new_candidates(best.filter((F.col("savings") >= least) & X.addable("token", max_len)), vocabulary)


def compounds_by_count(candidates: DataFrame, vocabulary: DataFrame, most: int, least: int = 3) -> DataFrame:
    """The ``most`` most frequent candidates (token, n) that are useful and new."""
    fit = candidates.filter((F.col("n") >= least) & X.useful_compound("token"))
    return new_candidates(fit, vocabulary).orderBy(F.desc("n"), "token").limit(most)
