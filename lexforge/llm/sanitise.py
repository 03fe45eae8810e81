"""Personal data: patterns, and terms that reveal them.

Patterns find e-mail and IP addresses, card and phone numbers in whole texts. Protected entities are each value found, and each kind: that a text has a
card number at all. How strongly a term (a word) reveals an entity is estimated from the whole corpus by pointwise mutual information,

    PMI(t; c) = log(p(t, c) / (p(t) p(c))),    against the entity's own information    IC(c) = -log p(c),

where all probabilities are shares of distinct whole texts, so that copies prove nothing; words of the entity itself are no terms. A term whose PMI reaches IC(c) / ALPHA
discloses too much: in all texts that hold the term, with the entity or without, it is generalised to a placeholder, and removed if its PMI reaches IC(c) itself
(the term never occurs without the entity). Threshold in another form: p(c | t) >= p(c) ** (1 - 1 / ALPHA). A pair seen in fewer than SUPPORT texts is no
evidence, nor is one that chance may well bring about: n texts that hold a term all hold an entity by chance with p(c) ** n, which has to be below exp(-EVIDENCE).
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexforge.llm.shared import chunks, folded, sent_or_shuffled, table, written

KINDS = ("email", "ip", "card", "phone")
SUPPORT = 3
ALPHA = 1.2
EVIDENCE = 14.0
#: Rows of terms or texts that are broadcast at most; beyond that they are joined by a shuffle.
BROADCAST_TERMS = 1 << 17

_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can't start inside a run of digits: what follows the run is the same for each start. So each run is tried once.
_ip = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_card = re.compile(r"[0-9](?:[ -]?[0-9])+")
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_word = re.compile(r"[^\W\d_]{3,}")


def emails(text: str) -> list[tuple[int, int]]:
    """As the pattern ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`` would, in linear time: from each @ to both sides."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        first = at
        while first > done and text[first - 1] in _LOCAL:
            first -= 1
        m = _domain.match(text, at + 1) if first < at else None
        if m:
            out.append((first, m.end()))
        # no match reaches back over an @, which no local part may hold
        done = m.end() if m else at + 1
        at = text.find("@", done)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def found(text: str) -> list[list[tuple[int, int]]]:
    """Spans of each of KINDS, in code points, end exclusive."""
    out = [emails(text), [], [], []]
    for m in _ip.finditer(text):
        # a part of over 3 digits can still be small: 0001
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split(".")):
            out[1].append(m.span())
    for m in _card.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out[2].append(m.span())
    for m in _phone.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            out[3].append(m.span())
    return out


def _entity(kind: int, value: str) -> str:
    """One spelling for each value."""
    if kind == 0:
        return "email:" + value.lower()
    if kind == 1:
        return "ip:" + ".".join(str(int(p[-4:])) for p in value.split("."))
    return KINDS[kind] + ":" + "".join(c for c in value if "0" <= c <= "9")


def terms_of(text: str, base: list[list[tuple[int, int]]]) -> set[str]:
    """The words of a text, in lower case, without those in the spans ``base``."""
    out, at = set(), 0
    for a, b in sorted(span for spans in base for span in spans):
        if a > at:
            out.update(m.group().lower() for m in _word.finditer(text, at, a))
        at = max(at, b)
    out.update(m.group().lower() for m in _word.finditer(text, at))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key of the text, entities, terms) for each text with an entity."""
    for batch in chunks(batches):
        keys, entities, terms = [], [], []
        for key, text in zip(batch.column("__pii_key").to_pylist(), batch.column("text").to_pylist(), strict=True):
            base = found(text or "")
            if any(base):
                keys.append(key), terms.append(sorted(terms_of(text, base)))
                entities.append(sorted({KINDS[k] for k, spans in enumerate(base) if spans} | {_entity(k, text[a:b]) for k, spans in enumerate(base) for a, b in spans}))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(entities, pa.list_(pa.string())), pa.array(terms, pa.list_(pa.string()))], names=["key", "entities", "terms"])


def _key() -> F.Column:
    return F.unhex(F.md5(F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")))


def disclosing(docs: DataFrame, alpha: float = ALPHA, support: int = SUPPORT, evidence: float = EVIDENCE) -> DataFrame:
    """(term, certain): the words that disclose an entity, and whether they never occur without it. docs: ``text`` and ``__pii_key``."""
    slim = docs.select("text", "__pii_key")
    holders = written(slim.mapInArrow(_holders, "key binary, entities array<string>, terms array<string>").dropDuplicates(["key"]), "holders")
    # texts are told apart by their digests; two counts, no text moves
    n = written(docs.select("__pii_key").distinct().agg(F.count("*").alias("n")), "texts").first()["n"]
    p_c = F.col("n_c") / F.lit(float(max(1, n)))
    share = F.pow(p_c, F.lit(1 - 1 / alpha))
    # values are nearly all of one text: what too few texts hold is left out before pairs are made
    entities = holders.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_c")).filter(F.col("n_c") >= support)
    entities = sent_or_shuffled(written(entities, "entities"), BROADCAST_TERMS)
    pairs = holders.select("terms", F.explode("entities").alias("entity")).join(entities.select("entity"), "entity", "left_semi").select("entity", F.explode("terms").alias("term"))
    near = pairs.groupBy("entity", "term").agg(F.count("*").alias("n_tc")).filter(F.col("n_tc") >= support)
    # a term occurs in at least as many texts as hold it and an entity; what is too common by that alone needs no count of the corpus
    seen = holders.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n_seen"))
    likely = near.join(entities, "entity").filter(-F.col("n_tc") * F.log(p_c) >= evidence).join(seen, "term").filter(F.col("n_tc") / F.col("n_seen") >= share)
    likely = written(likely.select("entity", "term", "n_tc", "n_c"), "likely")
    terms = sent_or_shuffled(likely.select("term").distinct(), BROADCAST_TERMS)
    words = slim.select("__pii_key", F.explode(_terms()).alias("term")).join(terms, "term").distinct()
    scored = likely.join(words.groupBy("term").agg(F.count("*").alias("n_t")), "term").filter(F.col("n_tc") / F.col("n_t") >= share)
    chosen = scored.groupBy("term").agg(F.max(F.col("n_tc") >= F.col("n_t")).alias("certain"))
    return written(chosen, "chosen")


def _terms() -> F.Column:
    return F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(?<![\p{L}])\p{L}{3,}"), F.lit(0)))


_ADDED = [("__pii_n_email", T.LongType()), ("__pii_n_ip", T.LongType()), ("__pii_n_card", T.LongType()), ("__pii_n_phone", T.LongType()), ("__pii_base", T.StringType()), ("__pii_spans", T.StringType()), ("__pii_text", T.StringType())]


def _apply(text: str, wanted: set[str], gone: set[str]) -> tuple[list[int], str, str, str]:
    base = found(text)
    spans = [(KINDS[k], a, b) for k, s in enumerate(base) for a, b in s]
    own = joined(spans)
    new = []
    if wanted:
        inside = sorted((a, b) for _, a, b in spans)
        starts = [a for a, _ in inside]
        ends = list(accumulate((b for _, b in inside), max))
        covered = lambda a: bool(k := bisect_right(starts, a)) and a < ends[k - 1]
        new = [m.span() for m in _word.finditer(text) if m.group().lower() in wanted and not covered(m.start())]
        spans = spans + [("term", a, b) for a, b in new]
    if not spans:
        return [0] * 4, own, own, text
    cut = sorted([(a, -b, f"[{k.upper()}]") for k, a, b in spans if k != "term"] + [(a, -b, "" if text[a:b].lower() in gone else "[TERM]") for a, b in new])
    out, at = [], 0
    for a, b, mark in cut:
        if a >= at:
            out += [text[at:a], mark]
            at = -b
        elif -b > at:
            at = -b  # spans that overlap go under one mark
    return [len(s) for s in base], own, joined(spans), "".join(out) + text[at:]


def _sanitise(batches: Iterator[pa.RecordBatch], text_out: bool, sent) -> Iterator[pa.RecordBatch]:
    """With the terms that are sent, or those of each row."""
    own = ("__pii_terms", "__pii_removed")
    for batch in chunks(batches):
        texts = batch.column("text").to_pylist()
        if sent is None:
            got = [_apply(t or "", set(x or ()), set(r or ())) for t, x, r in zip(texts, *(batch.column(c).to_pylist() for c in own), strict=True)]
        else:
            got = [_apply(t or "", *sent.value) for t in texts]
        names = [n for n in batch.schema.names if n not in own]
        clean = [None if t is None else g[3] for t, g in zip(batch.column("text").to_pylist(), got, strict=True)] if text_out else [None] * len(got)
        added = [*(pa.array([g[0][k] for g in got], pa.int64()) for k in range(4)), pa.array([hashlib.sha256(g[1].encode()).hexdigest() for g in got]), pa.array([g[2] for g in got]), pa.array(clean, pa.string())]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *added], names=[*names, *(n for n, _ in _ADDED)])


def sanitised(docs: DataFrame, alpha: float = ALPHA, support: int = SUPPORT, text_out: bool = True) -> DataFrame:
    """``docs`` with the counts, digests and spans of what was found, and (if asked for) the sanitised text, in columns ``__pii_*``.

    A null text is an empty one and stays null. Texts are looked at whole, however long. Spans of a kind don't overlap; those of two kinds may, and go under one mark in the sanitised text.
    A term isn't marked inside another span. Repeated rows are treated alike and count as one text. All columns are kept; an empty table gives no rows.
    """
    keyed = docs.withColumn("__pii_key", _key())
    chosen = disclosing(keyed, alpha, support)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t in _ADDED)])
    if chosen.count() <= BROADCAST_TERMS:
        rows = chosen.collect()
        sent = docs.sparkSession.sparkContext.broadcast(({r.term for r in rows}, {r.term for r in rows if r.certain}))
        return docs.mapInArrow(lambda b: _sanitise(b, text_out, sent), schema)
    held = keyed.select("__pii_key", F.explode(_terms()).alias("term")).join(chosen, "term").groupBy("__pii_key")
    flagged = held.agg(F.collect_set("term").alias("__pii_terms"), F.collect_set(F.when(F.col("certain"), F.col("term"))).alias("__pii_removed"))
    work = keyed.join(written(flagged, "flagged"), "__pii_key", "left").select(*docs.columns, "__pii_terms", "__pii_removed")
    return work.mapInArrow(lambda b: _sanitise(b, text_out, None), schema)


def clean_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with sanitised texts; a column ``n_chars`` follows the new text, all others stay, whatever their names."""
    narrow, back = folded(docs, ("text",))
    out = sanitised(narrow).drop("text").withColumnRenamed("__pii_text", "text")
    return out.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else b for c, b in zip(docs.columns, back, strict=True)])


def op4_information_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sanitised(table(spark, sf_dir, "documents").select("doc_id", "text"), text_out=False)
    return out.select("doc_id", *[F.col(f"__pii_n_{k}").alias(f"n_{k}") for k in KINDS], F.col("__pii_base").alias("base_sha256"), F.col("__pii_spans").alias("spans"))
