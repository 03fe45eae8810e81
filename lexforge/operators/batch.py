"""Sequences of ids made ready for a model: pairs, special ids, truncation, padding and masks. Column functions, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def truncated(ids: Column | str, most: int, side: str = "right") -> Column:
    """At most ``most`` ids; what is over goes at the ``side``."""
    c = _col(ids)
    return F.slice(c, 1, most) if side == "right" else F.slice(c, F.greatest(F.lit(1), F.size(c) - most + 1), F.lit(most))


def pair_truncated(first: Column | str, second: Column | str, most: int) -> tuple[Column, Column]:
    """Both sequences with ``most`` ids in all: ids go from the longer one, one by one from its end; of equally long ones from the second."""
    a, b = _col(first), _col(second)
    n, m = F.size(a), F.size(b)
    over = F.greatest(F.lit(0), n + m - most)
    # the longer one gives first, until both are equal; what is left is halved
    lead = F.least(over, F.abs(n - m))
    rest = over - lead
    from_a = F.when(n > m, lead).otherwise(0) + F.floor(rest / 2)
    from_b = F.when(m > n, lead).otherwise(0) + F.ceil(rest / 2)
    cut = lambda c, k: F.slice(c, F.lit(1), F.greatest(F.lit(0), F.size(c) - k).cast("int"))
    return cut(a, from_a), cut(b, from_b)


def joined(first: Column | str, second: Column | str | None = None, before: tuple[int, ...] = (), between: tuple[int, ...] = (), after: tuple[int, ...] = ()) -> Column:
    """One sequence, with special ids before, between (if there are two) and after; null where the first is null. A null second one is none."""
    lit = lambda ids: F.array(*[F.lit(i) for i in ids]).cast("array<int>")
    a = _col(first)
    if second is None:
        return F.concat(lit(before), a, lit(after))
    b = _col(second)
    return F.concat(lit(before), a, F.when(b.isNull(), lit(())).otherwise(F.concat(lit(between), b)), lit(after))


def type_ids(first: Column | str, second: Column | str, before: int = 0, between: int = 0, after: int = 0) -> Column:
    """0 for the first sequence and what stands before and between, 1 for the second; what stands after is of the last one."""
    n, b = F.size(_col(first)) + before, _col(second)
    m = F.when(b.isNull(), 0).otherwise(F.size(b))
    zeros = n + F.when(b.isNull(), F.lit(after)).otherwise(F.lit(between))
    return F.concat(F.array_repeat(F.lit(0), zeros), F.array_repeat(F.lit(1), F.when(b.isNull(), 0).otherwise(m + after)))


def padded(ids: Column | str, length: Column | int, pad: int, side: str = "right") -> Column:
    c = _col(ids)
    fill = F.array_repeat(F.lit(pad), F.greatest(F.lit(0), (F.lit(length) if isinstance(length, int) else length) - F.size(c)))
    return F.concat(c, fill) if side == "right" else F.concat(fill, c)


def attention_mask(ids: Column | str, length: Column | int, side: str = "right") -> Column:
    """1 for each id, 0 for what ``padded`` adds."""
    return padded(F.transform(_col(ids), lambda _: F.lit(1)), length, 0, side)


def multiple_of(n: Column, k: int) -> Column:
    return (F.ceil(n / k) * k).cast("int")


def encoded(docs: DataFrame, codec, text: str = "text", pair: str | None = None, most: int | None = None, pad: int | None = None, pad_to: int | None = None, before: tuple[int, ...] = (), between: tuple[int, ...] = (), after: tuple[int, ...] = ()) -> DataFrame:
    """``docs`` with input_ids and attention_mask (and token_type_ids for pairs).

    ``most`` bounds a sequence with its special ids. With ``pad``, sequences are filled up to ``pad_to`` or, without it, to the longest of ``docs``.
    """
    rows = docs.withColumn("__a", codec.encode_column(text))
    rows = rows.withColumn("__b", codec.encode_column(pair)) if pair else rows
    extra = len(before) + len(after) + (len(between) if pair else 0)
    if most is not None:
        room = max(0, most - extra)
        a, b = pair_truncated("__a", F.coalesce("__b", F.array().cast("array<int>")), room) if pair else (truncated("__a", room), None)
        rows = rows.withColumn("__a2", a).drop("__a").withColumnRenamed("__a2", "__a") if not pair else rows.withColumns({"__a2": a, "__b2": F.when(F.col("__b").isNotNull(), b)}).drop("__a", "__b").withColumnsRenamed({"__a2": "__a", "__b2": "__b"})
    rows = rows.withColumn("input_ids", joined("__a", "__b" if pair else None, before, between, after))
    if pair:
        rows = rows.withColumn("token_type_ids", type_ids("__a", "__b", len(before), len(between), len(after)))
    length = F.size("input_ids")
    if pad is not None:
        to = pad_to if pad_to is not None else (rows.agg(F.max(length)).first()[0] or 0)
        rows = rows.withColumn("attention_mask", attention_mask("input_ids", to)).withColumn("input_ids", padded("input_ids", to, pad))
        rows = rows.withColumn("token_type_ids", padded("token_type_ids", to, 0)) if pair else rows
    else:
        rows = rows.withColumn("attention_mask", F.transform("input_ids", lambda _: F.lit(1)))
    return rows.drop("__a", "__b")
