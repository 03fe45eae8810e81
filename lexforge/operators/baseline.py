"""Tokenizers to compare with: adapters that encode and decode, a registry that leaves out what isn't there, and what they are measured by."""

from __future__ import annotations

import base64
import json
import math
import statistics
import time
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.functions import patterns as P
from lexforge.operators import evaluate
from lexforge.sources import standard

_warned: set[str] = set()


@dataclass(frozen=True)
class Adapter:
    """A tokenizer under a name. ``decode`` is None if texts don't come back from its ids."""

    name: str
    encode: Callable[[str], list[int]]
    decode: Callable[[list[int]], str] | None = None
    vocab_size: int = 0
    note: str = ""

    def count_column(self, text: Column | str) -> Column:
        """How many tokens; a null or empty text has none."""
        encode = self.encode

        @F.pandas_udf("int")
        def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            known: dict[str, int] = {}
            for batch in batches:
                out = []
                for t in batch:
                    if not t:
                        out.append(0)
                        continue
                    if len(t) > 64:
                        out.append(len(encode(t)))
                        continue
                    if t not in known:
                        if len(known) >= 200_000:
                            known.clear()
                        known[t] = len(encode(t))
                    out.append(known[t])
                yield pd.Series(out, dtype="int32")

        return count(text)


def characters() -> Adapter:
    return Adapter("chars", lambda t: [ord(c) for c in t], lambda ids: "".join(map(chr, ids)), 0x110000, "code points")


def raw_bytes() -> Adapter:
    return Adapter("bytes", lambda t: list(t.encode()), lambda ids: bytes(ids).decode("utf-8", "replace"), 256, "UTF-8")


def null() -> Adapter:
    """One token for each text that isn't empty, so that nothing can be saved; says so once."""
    if "null" not in _warned:
        _warned.add("null")
        warnings.warn("no baseline at hand: each token costs 1, so all savings are 0", stacklevel=2)
    return Adapter("none", lambda t: [0] if t else [], None, 1, "no baseline")


def rank_file(path: str, name: str = "ranks", pattern: str = P.PIECES.removeprefix("(?U)")) -> Adapter:
    """A byte-level vocabulary in a file of ranks (a line for each token: base64, rank), without special tokens."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    made: list = []

    def engine():
        if not made:
            import tiktoken

            made.append(tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={}))
        return made[0]

    engine(), made.clear()  # an error now rather than in a worker; workers make their own
    return Adapter(name, lambda t: engine().encode_ordinary(t), lambda ids: engine().decode(ids), len(ranks), path)


def tokenizer_file(path: str, name: str = "tokenizer") -> Adapter:
    """A file of the tokenizers library; white space and case come back only if it keeps them."""
    from tokenizers import Tokenizer

    size = Tokenizer.from_file(path).get_vocab_size()
    made: list = []

    def engine():
        if not made:
            made.append(Tokenizer.from_file(path))
        return made[0]

    return Adapter(name, lambda t: engine().encode(t, add_special_tokens=False).ids, lambda ids: engine().decode(ids, skip_special_tokens=False), size, path)


def own(codec, name: str = "own") -> Adapter:
    """Ours, on whole texts: substitution, then ids."""
    from lexforge.operators.mapping import substituted_text

    words = codec.words
    return Adapter(name, lambda t: codec.encode_substituted(substituted_text(t, words)), codec.decode, len(codec.vocabulary))


def available(loaders: dict[str, Callable[[], Adapter]]) -> list[Adapter]:
    """Those that can be loaded; a warning for each of the others."""
    out = []
    for name, load in loaders.items():
        try:
            out.append(load())
        except Exception as e:  # a missing file or library, or a broken file
            warnings.warn(f"{name} is left out: {e}", stacklevel=2)
    return out


def default_baseline(path: str | None = None) -> Adapter:
    """The file of ranks, if there is one, else ``null``."""
    found = available({"ranks": lambda: rank_file(path)}) if path else []
    return found[0] if found else null()


# ---- measures ------------------------------------------------------------------------------------------------

_MEASURED = "n_tokens int, exact boolean, encode_us long, decode_us long"


def measured(docs: DataFrame, adapter: Adapter) -> DataFrame:
    """bytes, n_tokens, whether the text comes back, and microseconds of encoding and decoding, for every text that isn't null."""
    encode, decode = adapter.encode, adapter.decode

    @F.pandas_udf(_MEASURED)
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encode("warm up")
        for batch in batches:
            out = []
            for t in batch:
                a = time.perf_counter_ns()
                ids = encode(t)
                b = time.perf_counter_ns()
                back = decode(ids) if decode else None
                c = time.perf_counter_ns()
                out.append((len(ids), back == t, (b - a) // 1000, (c - b) // 1000 if decode else None))
            yield pd.DataFrame(out, columns=["n_tokens", "exact", "encode_us", "decode_us"]).astype({"decode_us": "Int64"})

    rows = docs.filter("text IS NOT NULL").select(F.octet_length("text").cast("long").alias("bytes"), measure("text").alias("m"))
    return rows.select("bytes", "m.*")


def benchmark(docs: DataFrame, adapters: list[Adapter], reference: str | None = None) -> list[dict]:
    """A record for each adapter, the most compact first: files, bytes, tokens, exact round trips, percentiles of tokens and times, and tokens for one of ``reference``.

    Each adapter's texts are read once; what comes to the driver are the records.
    """
    out = []
    for a in adapters:
        rows = measured(docs, a).withColumn("tokenizer", F.lit(a.name)).persist()
        sums = rows.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("n_bytes"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"), F.count_if("exact").alias("n_exact")).first().asDict()
        record = {"tokenizer": a.name, "vocab_size": a.vocab_size, "note": a.note, **sums, "bytes_per_token": round(sums["n_bytes"] / max(1, sums["n_tokens"]), 6)}
        for column, short in (("n_tokens", "tokens"), ("encode_us", "encode_us"), ("decode_us", "decode_us")):
            found = evaluate.percentiles(rows.filter(F.col(column).isNotNull()), column, "tokenizer").first()
            record |= {f"{short}_{k}": (round(float(found[k]), 3) if found else None) for k in ("mean", "p50", "p95", "p99")}
        rows.unpersist()
        out.append(record)
    base = next((r["n_tokens"] for r in out if r["tokenizer"] == reference), None)
    for r in out:
        r["ratio"] = round(r["n_tokens"] / base, 6) if base else None
    return sorted(out, key=lambda r: (r["n_tokens"], r["tokenizer"]))


def throughput(docs: DataFrame, adapter: Adapter) -> dict:
    """Texts and MB in a second of all tasks together, from reading to the last count."""
    rows = docs.filter("text IS NOT NULL").select("text")
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    began = time.perf_counter()
    rows.select(adapter.count_column("text")).write.format("noop").mode("overwrite").save()
    took = max(1e-9, time.perf_counter() - began)
    return {"tokenizer": adapter.name, "texts_per_second": round(n / took, 3), "mb_per_second": round(size / took / 1e6, 3), "seconds": round(took, 3)}


def latency(adapter: Adapter, text: str, times: int = 100) -> dict:
    """Milliseconds of one call on the driver: mean, deviation, and for each KB of text."""
    adapter.encode(text)
    took = []
    for _ in range(times):
        a = time.perf_counter_ns()
        adapter.encode(text)
        took.append((time.perf_counter_ns() - a) / 1e6)
    mean = statistics.fmean(took)
    return {"tokenizer": adapter.name, "mean_ms": mean, "sd_ms": statistics.stdev(took) if times > 1 else 0.0, "ms_per_kb": mean / max(1e-9, len(text.encode()) / 1024)}


def id_differences(docs: DataFrame, one: Column, other: Column, key: str = "doc_id") -> DataFrame:
    """``key`` and ``n_different`` of the texts whose two sequences of ids differ, those of fewest differences first."""
    from lexforge.functions.text import differences

    rows = docs.select(key, one.alias("__a"), other.alias("__b")).select(key, differences("__a", "__b").alias("n_different"))
    return rows.filter("n_different > 0").orderBy("n_different", key)


# ---- reports -------------------------------------------------------------------------------------------------


def markdown(records: list[dict], title: str = "Tokenizers") -> str:
    """A table of the records; columns are the keys of the first."""
    show = lambda v: "" if v is None else f"{v:,.3f}".rstrip("0").rstrip(".") if isinstance(v, float) and math.isfinite(v) else f"{v:,}" if isinstance(v, int) and not isinstance(v, bool) else str(v).replace("|", "\\|")
    if not records:
        return f"# {title}\n\nNothing was measured.\n"
    names = list(records[0])
    lines = ["| " + " | ".join(names) + " |", "|" + "---|" * len(names), *("| " + " | ".join(show(r.get(k)) for k in names) + " |" for r in records)]
    return f"# {title}\n\n" + "\n".join(lines) + "\n"


def write_report(spark: SparkSession, records: list[dict], folder: str, name: str = "report", title: str = "Tokenizers") -> None:
    """``name``.json and ``name``.md in ``folder``."""
    standard.write_text(spark, f"{folder}/{name}.json", json.dumps(records, indent=1, sort_keys=True, ensure_ascii=False))
    standard.write_text(spark, f"{folder}/{name}.md", markdown(records, title))


def write_top(spark: SparkSession, rows: DataFrame, path: str, top: int, order: str) -> None:
    """The first ``top`` rows by descending ``order`` as a list in one file of JSON."""
    found = [r.asDict(recursive=True) for r in rows.orderBy(F.desc(order), *[c for c in rows.columns if c != order]).limit(top).collect()]
    standard.write_text(spark, path, json.dumps(found, ensure_ascii=False))
