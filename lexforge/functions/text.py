"""Column functions on texts, tokens and candidates; all of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexforge.functions import patterns as P


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _all(c: Column | str, pattern: str) -> Column:
    return F.regexp_extract_all(_col(c), F.lit(pattern), F.lit(0))


def tokens(text: Column | str) -> Column:
    """Emoji sequences, words, operators and single marks; white space and combining marks are no tokens."""
    return _all(text, P.TOKEN)


def tokens_and_gaps(text: Column | str) -> Column:
    return _all(text, P.TOKEN_OR_GAP)


def pieces(text: Column | str) -> Column:
    """Pieces within which a byte-level vocabulary merges; joined they are the text."""
    return _all(text, P.PIECES)


def is_identifier(token: Column | str) -> Column:
    return _col(token).rlike(r"^[A-Za-z_][A-Za-z0-9_]*\z")


def identifier_parts(token: Column | str) -> Column:
    """Runs of an ASCII identifier: acronyms, capitalised and lower words, digits."""
    return _all(token, P.IDENTIFIER_RUNS)


def identifier_weave(token: Column | str) -> Column:
    """The runs and each underscore, in order; joined they are the identifier."""
    return _all(token, "_|" + P.IDENTIFIER_RUNS)


def secret_name(text: Column | str) -> Column:
    """The name of the first kind of secret in a text, or null."""
    t = _col(text)
    return F.coalesce(*[F.when(t.rlike(p), F.lit(n)) for n, p in P.SECRETS])


def license_id(text: Column | str) -> Column:
    """The identifier of the licence header in the head of a text, or null."""
    head = F.substring(_col(text), 1, P.LICENSE_HEAD)
    return F.when(head.rlike(P.SPDX), F.trim(F.regexp_extract(head, P.SPDX, 1)))


def license_allowed(text: Column | str, allowed: Iterable[str] = P.ALLOWED_LICENSES) -> Column:
    found = license_id(text)
    some = [a.strip().lower() for a in allowed]
    marked = F.substring(_col(text), 1, P.LICENSE_HEAD).rlike(P.PROPRIETARY)
    return F.when(found.isNotNull(), F.lower(found).isin(some) if some else F.lit(False)).otherwise(~marked)


def any_license_allowed(licenses: Iterable[Column | str], allowed: Iterable[str] = P.ALLOWED_LICENSES) -> Column:
    """Whether any entry of several arrays is allowed; null arrays are empty."""
    both = F.concat(*[F.coalesce(_col(c), F.array().cast("array<string>")) for c in licenses])
    return F.exists(both, lambda x: F.coalesce(F.lower(F.trim(x)).isin([a.lower() for a in allowed]), F.lit(False)))


def codepoint(char: Column | str) -> Column:
    return F.ascii(_col(char))


def character(code: Column | str) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(_col(code).cast("long")), 8, "0")), "UTF-32")


def is_private_use(char: Column | str) -> Column:
    c = _col(char)
    return (F.length(c) == 1) & c.rlike(P.PUA)


def private_use_codepoints(text: Column | str) -> Column:
    return F.array_sort(F.array_distinct(F.transform(_all(text, P.PUA), F.ascii)))


def private_use_count(text: Column | str) -> Column:
    return F.regexp_count(_col(text), F.lit(P.PUA)).cast("long")


def looks_like_hash(token: Column | str) -> Column:
    """UUIDs, 16 and more hexadecimal digits, and long strings of a base-64 alphabet with hardly a word in them."""
    t = _col(token)
    blob = t.rlike(r"^[A-Za-z0-9+/=_\-]{24,}\z") & (F.size(_all(t, "[a-z]{3,}")) < 2)
    return t.rlike(r"(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}\z") | t.rlike(r"(?i)^[0-9a-f]{16,}\z") | blob


def good_token(token: Column | str, max_len: int = 50) -> Column:
    """Whether a token is worth a code point of its own."""
    t = _col(token)
    return ~t.rlike(r"(?U)^\s*\z") & (F.length(t) <= max_len) & (F.octet_length(t) > 1) & ~looks_like_hash(t)


def addable(token: Column | str, max_len: int = 80) -> Column:
    t = _col(token)
    return F.length(t).between(2, max_len) & ~t.rlike(r"[^\x00-\x7F]") & ~t.rlike(r"^\s+\z")


_WORD, _MARK = r"[\p{L}\p{N}_]", r"(?U)[^\s\p{L}\p{N}_]"


def useful_compound(token: Column | str) -> Column:
    """Two and more characters, no space ahead, with a mark: word and mark mixed, or marks only."""
    t = _col(token)
    return (F.length(t) >= 2) & ~t.rlike(r"^[ \t\n]") & t.rlike(_MARK)


def multi_pattern(token: Column | str) -> Column:
    """White space only, or word characters mixed with others."""
    t = _col(token)
    return t.rlike(r"(?U)^\s+\z") | (t.rlike(_WORD) & t.rlike(r"[^\p{L}\p{N}_]"))


_TABLE = P.byte_table()
_FROM = "".join(chr(b) for b in range(256) if _TABLE[b] != chr(b))
_TO = "".join(c for b, c in enumerate(_TABLE) if c != chr(b))


def byte_level(text: Column | str) -> Column:
    """A printable character for each UTF-8 byte."""
    return F.translate(F.decode(F.encode(_col(text), "UTF-8"), "ISO-8859-1"), _FROM, _TO)


def from_byte_level(text: Column | str) -> Column:
    """Back from ``byte_level``; characters outside the table are not allowed."""
    return F.decode(raw_of_byte_level(text), "UTF-8")


def raw_of_byte_level(text: Column | str) -> Column:
    """The bytes that byte-level text stands for, which need not be whole characters."""
    # translate() drops characters that become NUL, so that one is replaced first
    plain = F.replace(_col(text), F.lit(_TO[0]), F.decode(F.unhex(F.lit("00")), "UTF-8"))
    return F.encode(F.translate(plain, _TO[1:], _FROM[1:]), "ISO-8859-1")


def spelled(text: Column | str) -> Column:
    """The byte-level spelling of spaces, line ends and tabs; all else stays."""
    return F.translate(_col(text), " \n\t", "ĠĊĉ")


def split_merge(merge: Column | str) -> Column:
    return F.split(_col(merge), " ", 2)


def normal_newlines(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), "\r\n?", "\n")


def split_of(text: Column | str, prefix: str) -> Column:
    """'holdout' where the text's SHA-256 starts with ``prefix``, else 'train'."""
    return F.when(F.sha2(_col(text), 256).startswith(prefix), F.lit("holdout")).otherwise(F.lit("train"))


def code_of_markdown(text: Column | str) -> Column:
    """The longest fenced block of code (the first of equally long ones), or the text, trimmed."""
    t = F.regexp_replace(_col(text), r"(?U)^\s+|\s+\z", "")
    found = F.regexp_extract_all(t, F.lit(r"(?is)```(?:python|py)?\s*\n(.*?)```"), F.lit(1))
    best = F.aggregate(found, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    return F.when(F.size(found) > 0, F.regexp_replace(best, r"(?U)^\s+|\s+\z", "")).otherwise(t)


def rough_tokens(text: Column | str) -> Column:
    n = F.length(_col(text))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("long")


TRIMMED = "[…truncated for API context limit…]\n"


def trim_tail(text: Column | str, most: int) -> Column:
    """At most ``most`` characters: a note and the end of the text."""
    t = _col(text)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.lit(TRIMMED), F.right(t, F.lit(most - len(TRIMMED)))))


def first_difference(a: Column | str, b: Column | str) -> Column:
    """Where two texts first differ, from 0; -1 if they are equal."""
    differ = F.zip_with(F.split(_col(a), ""), F.split(_col(b), ""), lambda x, y: ~x.eqNullSafe(y))
    return (F.array_position(differ, True) - 1).cast("long")


def around(text: Column | str, at: Column | str, width: int = 20) -> Column:
    """What stands up to ``width`` characters before and after place ``at`` (from 0); null where that is negative."""
    t, i = _col(text), _col(at)
    first = F.greatest(F.lit(0), i - width)
    return F.when(i >= 0, F.substr(t, (first + 1).cast("int"), (i - first + width).cast("int")))


def differences(a: Column | str, b: Column | str) -> Column:
    """How many places of two id sequences differ; what one of them lacks counts."""
    return F.size(F.filter(F.zip_with(_col(a), _col(b), lambda x, y: ~x.eqNullSafe(y)), lambda d: d)).cast("long")


def flat_name(path: Column | str) -> Column:
    return F.substring(F.regexp_replace(_col(path), r"[/\\]", "_"), 1, 80)


def nearest_rank(ordered: Column, percent: float) -> Column:
    """Of a sorted array the element at round(percent / 100 * (n - 1)), halves to even."""
    return F.get(ordered, F.bround(F.lit(percent) / 100 * (F.size(ordered) - 1)).cast("int"))
