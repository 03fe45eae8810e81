"""Quality rules whose cutoffs carry a guarantee: at most so many good documents of a stratum are rejected.

Labelled documents are the holdout; equal texts are one trial, as the tail is of independent ones. For each rule and stratum the cutoffs are tested from the most lenient on
("would more than ``risk`` of the good documents be rejected?") with the exact binomial tail; testing stops at the first
cutoff that is not certified, so a rule needs no correction over its own cutoffs (fixed-sequence testing), and the level
is divided by the number of rules and strata (Bonferroni). Among certified cutoffs the one that gains most is taken.

Everything is DataFrame and SQL functions. Documents are read once into a narrow table of counts; what is joined to
them are a few rows per stratum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexforge.llm.shared import folded, let, table, written

SPACE = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"
GRID = 64
RULES = ("symbols", "dup_lines", "capitals", "repeats")
RISK = 0.04
LEVEL = 0.05
MISTAKE = 10.0
BROADCAST_STRATA = 4096


def repeated_words(words: Column) -> Column:
    """How many words lie in windows of 8 words that occur twice or more in ``words``."""
    width = 8

    def counted(windows: Column) -> Column:
        def covered(s: Column) -> Column:
            twice = F.filter(s, lambda x, i: (F.get(s, i - 1)["v"] == x["v"]) | (F.get(s, i + 1)["v"] == x["v"]))
            start = F.struct(F.lit(-width).alias("last"), F.lit(0).alias("n"))
            return F.aggregate(
                F.array_sort(F.transform(twice, lambda x: x["i"])), start,
                lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(width), p - a["last"])).alias("n")),
                lambda a: a["n"],
            )

        ordered = F.array_sort(F.transform(windows, lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(ordered, covered))

    def widened(h: Column, by: int):
        return F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + by)))

    # windows of 2, 4 and 8 words, each from two of half its width; the last ones would reach past the end
    eights = lambda h: let(widened(h, 1), lambda h2: let(widened(h2, 2), lambda h4: let(F.slice(widened(h4, 4), F.lit(1), F.size(h) - 7), counted)))
    return F.when(F.size(words) <= 8, F.lit(0)).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), eights))


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one more column ``stats``: the counts of the whole text; a null text counts as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    bare = F.btrim(t, F.lit(SPACES))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE + "+"))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    size = lambda c: F.size(c).cast("long")
    of_words = lambda w: F.struct(size(w).alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).cast("long").alias("n_repeat_words"))
    of_lines = lambda x: F.struct(size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))
    return docs.withColumn(
        "stats",
        F.struct(
            let(words, of_words).alias("w"), let(lines, of_lines).alias("l"),
            F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        ),
    )


def counted(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and the counts, each a column of its own, a hash of the text, and ``base_failed``."""
    s = with_counts(docs).select(*keep, F.xxhash64("text").alias("__same"), "stats")
    flat = s.select(
        *keep, "__same", F.col("stats.w.n_words").alias("n_words"), F.col("stats.w.word_chars").alias("word_chars"), F.col("stats.n_symbols").alias("n_symbols"),
        F.col("stats.l.n_dup_lines").alias("n_dup_lines"), F.col("stats.w.n_repeat_words").alias("n_repeat_words"),
        F.col("stats.l.n_lines").alias("n_lines"), F.col("stats.n_capitals").alias("n_capitals"),
    )
    return flat.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def steps() -> dict[str, Column]:
    """For each rule the share it looks at, as the number of steps of 1/GRID, rounded up: a row is above cutoff k if its step is."""
    share = lambda a, b: F.when(F.col(b) > 0, F.least(F.lit(GRID), F.ceil(F.lit(GRID) * F.col(a) / F.col(b)))).otherwise(F.lit(0)).cast("int")
    return {"symbols": share("n_symbols", "word_chars"), "dup_lines": share("n_dup_lines", "n_lines"), "capitals": share("n_capitals", "word_chars"), "repeats": share("n_repeat_words", "n_words")}


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X of n trials with chance p, exact but for rounding; 1 where k >= n * p (no cutoff is certified there).

    Summed in logarithms, so that it holds for any n.
    """
    odds = p / (1 - p)

    def add(a: Column, i: Column) -> Column:
        term = a["term"] + F.log((n - i + 1) / i * odds)
        high = F.greatest(term, a["sum"])
        return F.struct(term.alias("term"), (high + F.log(F.exp(term - high) + F.exp(a["sum"] - high))).alias("sum"))

    first = n * F.log1p(F.lit(-p))
    whole = F.aggregate(F.sequence(F.lit(1).cast("long"), k), F.struct(first.alias("term"), first.alias("sum")), add, lambda a: F.exp(a["sum"]))
    return F.when(k >= n * p, F.lit(1.0)).when(k < 1, F.exp(first)).otherwise(whole)


def cutoffs(calibration: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """(stratum, rule, cutoff, rejected, good, p_value) for the rules certified, a row per stratum and rule.

    calibration: stratum, good (0/1) and a column of steps for each rule. ``risk`` bounds the share of good documents of
    a stratum that all rules together reject; each rule has an equal part of it.
    """
    parts = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("step")) for r in RULES]))
    cells = calibration.select("stratum", "good", parts.alias("x")).groupBy("stratum", F.col("x.rule").alias("rule"), F.col("x.step").alias("step")).agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad"))
    # one small row per stratum, rule and step: from here on nothing grows with the documents
    shape = cells.groupBy("stratum", "rule").agg(F.collect_list(F.struct("step", "good", "bad")).alias("cells"), F.sum("good").alias("n"), F.sum("bad").alias("n_bad"))
    above = lambda f: F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + F.when(c["step"] > F.col("cutoff"), c[f]).otherwise(F.lit(0)))
    tests = shape.withColumn("cutoff", F.explode(F.sequence(F.lit(0), F.lit(GRID - 1)))).withColumns({"rejected": above("good"), "caught": above("bad")})
    strata = shape.select(F.count_distinct("stratum").alias("n_strata"))
    tests = tests.join(F.broadcast(strata)).withColumn("p_value", binomial_tail(F.col("rejected"), F.col("n"), risk / len(RULES)))
    down = W.partitionBy("stratum", "rule").orderBy(F.desc("cutoff")).rowsBetween(W.unboundedPreceding, 0)
    certified = tests.withColumn("worst", F.max("p_value").over(down)).filter(F.col("worst") <= F.lit(level) / (F.lit(len(RULES)) * F.col("n_strata")))
    gain = F.col("caught") / F.greatest(F.col("n_bad"), F.lit(1)) - MISTAKE * F.col("rejected") / F.greatest(F.col("n"), F.lit(1))
    best = certified.filter(gain > 0).groupBy("stratum", "rule").agg(F.max_by(F.struct("cutoff", "rejected", "n", "p_value"), F.struct(gain, "cutoff")).alias("b"))
    return best.select("stratum", "rule", "b.cutoff", "b.rejected", F.col("b.n").alias("good"), "b.p_value")


def _verdicts(rows: DataFrame, labels: DataFrame, risk: float, level: float) -> DataFrame:
    """``rows`` (doc_id, __stratum and others; written, with counts and steps) and ``kept``.

    The cutoffs go to the rows, a few for each stratum; rows aren't shuffled.
    """
    marks = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").cast("long").alias("good"))
    holdout = rows.filter(~F.col("base_failed")).select("doc_id", F.col("__stratum").alias("stratum"), "__same", *RULES).join(marks, "doc_id")
    # a text is one trial, good if any label of it says so; its steps are those of its copies
    holdout = holdout.groupBy("stratum", "__same", *RULES).agg(F.max("good").alias("good"))
    found = written(cutoffs(holdout, risk, level), "cutoffs")
    wide = found.groupBy(F.col("stratum").alias("__stratum")).pivot("rule", list(RULES)).agg(F.first("cutoff"))
    wide = wide.select("__stratum", *[F.col(r).alias(f"cut_{r}") for r in RULES])
    few = found.select("stratum").distinct().count() <= BROADCAST_STRATA
    rejects = F.lit(False)
    for r in RULES:
        rejects = rejects | F.coalesce(F.col(r) > F.col(f"cut_{r}"), F.lit(False))
    return rows.join(F.broadcast(wide) if few else wide, "__stratum", "left").withColumn("kept", ~F.col("base_failed") & ~rejects)


def _stratum(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("\0none")).alias("__stratum")


def judged(docs: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL, stratum: str = "lang") -> DataFrame:
    """doc_id, the counts, base_failed and kept for every row of ``docs``.

    Texts may be of any length. Null or empty texts have no words and fail the base rule. A null stratum is a stratum of its own; one without
    enough labels has no certified cutoff and keeps all that the base rule keeps. Repeated rows are judged alike;
    labels that are null take no part and of several labels of a document the largest counts. Empty tables give no rows.
    """
    rows = docs.select("doc_id", "text", _stratum(stratum))
    return _verdicts(written(counted(rows, ["doc_id", "__stratum"]).withColumns(steps()), "counts"), labels, risk, level)


def op8_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def kept_documents(docs: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL, stratum: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns, whatever their names; see ``judged``.

    Rows are judged where they stand: documents are written once with their counts, and neither joined nor shuffled again.
    """
    narrow, back = folded(docs.withColumn("__stratum", _stratum(stratum)), ("doc_id", "text", "__stratum"))
    rows = written(counted(narrow, [*narrow.columns]).withColumns(steps()), "rule-stats")
    return _verdicts(rows, labels, risk, level).filter("kept").select(*back).drop("__stratum")
