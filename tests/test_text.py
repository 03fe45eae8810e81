import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexforge.functions import patterns as P
from lexforge.functions import text as X


def values(spark, texts, column):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in rows.select("i", column.alias("v")).orderBy("i").select("v").collect()]


TOKENS = {
    "hello world": ["hello", "world"], "foo, bar.": ["foo", ",", "bar", "."], "a == b": ["a", "==", "b"], "x->y": ["x", "->", "y"], "a := 1": ["a", ":=", "1"],
    "ab-cd": ["ab-cd"], "ab--cd": ["ab--cd"], "5e-3": ["5e-3"], "naïve café": ["naïve", "café"], " \t\n": [], "": [], "...": ["..."], "1️⃣": ["1"], "x👨‍👩‍👧y": ["x", "👨‍👩‍👧", "y"], "ℹ": ["ℹ"],
}


def test_tokens(spark):
    assert values(spark, list(TOKENS), X.tokens("t")) == list(TOKENS.values())
    odd = [*TOKENS, "a​b ‌c é 𐎀𐎁 \x00x", "﻿bom", "tab\tand\r\nline"]
    assert values(spark, odd, F.concat_ws("", X.tokens_and_gaps("t"))) == odd


PARTS = {
    "HTTPRequestParser": ["HTTP", "Request", "Parser"], "getUserId42": ["get", "User", "Id", "42"], "__dunder__": ["dunder"], "a1b2c3": ["a", "1", "b", "2", "c", "3"], "": [],
    "snake_case_name": ["snake", "case", "name"], "SCREAMING_CASE": ["SCREAMING", "CASE"], "myVar": ["my", "Var"],
}


def test_identifiers(spark):
    assert values(spark, list(PARTS), X.identifier_parts("t")) == list(PARTS.values())
    assert values(spark, ["a", "_x1", "1a", "", "a-b", "é", "a\n"], X.is_identifier("t")) == [True, True, False, False, False, False, False]
    names = [n for n in PARTS if n]
    assert values(spark, names, F.concat_ws("", X.identifier_weave("t"))) == names


def test_secrets_and_licences(spark):
    key = "AK" + "IA" + "A1B2C3D4E5F6G7H8"
    texts = [f"x = '{key}'", "sk-" + "a" * 30, "gh" + "p_" + "b" * 36, "AI" + "za" + "c" * 35, "-----BEGIN RSA " + "PRIVATE KEY-----", "eyJ" + "a" * 12 + ".eyJ" + "b" * 12 + "." + "c" * 12, "def f(): return 1", "AK" + "IA only"]
    assert values(spark, texts, X.secret_name("t")) == ["aws_access_key", "openai_api_key", "github_pat", "google_api", "private_key_pem", "jwt", None, None]
    heads = ["# SPDX-License-Identifier: MIT", "// SPDX-License-Identifier: Apache-2.0", "# SPDX-License-Identifier: GPL-3.0", "All Rights Reserved", "License: UNLICENSED", "code", "SPDX-License-Identifier: MIT OR Apache-2.0", "x" * 5000 + " All Rights Reserved"]
    assert values(spark, heads, X.license_id("t")) == ["MIT", "Apache-2.0", "GPL-3.0", None, None, None, "MIT OR Apache-2.0", None]
    assert values(spark, heads, X.license_allowed("t", ["MIT", "Apache-2.0"])) == [True, True, False, False, False, True, False, True]


def test_candidates(spark):
    bad = ["", " ", "a", "\n", "f" * 51, "deadbeef" * 2, "1234567890123456", "123e4567-e89b-12d3-a456-426614174000", "A" * 24, "SCREAMING_SNAKE_CASE_NAME"]
    good = ["ab", "é", "return", "self.", "abcdef", "this_is_a_long_identifier_name"]
    assert values(spark, bad + good, X.good_token("t")) == [False] * len(bad) + [True] * len(good)
    assert values(spark, ["a", "ab", "é!", "  ", "x" * 81, "):"], X.addable("t")) == [False, True, False, False, False, True]
    assert values(spark, [".get", "self)", "):", "ab", " .x", "n=", "x"], X.useful_compound("t")) == [True, True, True, False, False, True, False]
    assert values(spark, ["   ", " a", "ab", "a.", "..", ""], X.multi_pattern("t")) == [True, True, False, True, False, False]


def test_bytes_and_characters(spark):
    texts = ["a b\n", "\x00\x01é漢😀", "", "".join(map(chr, range(1, 300)))]
    assert values(spark, texts, X.from_byte_level(X.byte_level("t"))) == texts
    table = P.byte_table()
    assert len(set(table)) == 256 and table[32] == "Ġ" and table[10] == "Ċ" and table[65] == "A"
    assert values(spark, ["\ue000", "ab", "\U000f0000", ""], X.is_private_use("t")) == [True, False, True, False]
    assert values(spark, ["a\ue001b\ue000\ue001"], X.private_use_codepoints("t")) == [[0xE000, 0xE001]]


def test_small_helpers(spark):
    assert values(spark, ["", "abc", "a" * 9], X.rough_tokens("t")) == [0, 1, 2]
    assert values(spark, ["abc", "abd", "ab", "abcd"], X.first_difference("t", F.lit("abc"))) == [-1, 2, 2, 3]
    assert values(spark, ["x\n```python\na = 1\n```\n```\nlonger text\n```", " plain "], X.code_of_markdown("t")) == ["longer text", "plain"]
    assert values(spark, ["a/b\\c"], X.flat_name("t")) == ["a_b_c"]
    assert values(spark, ["a\r\nb\rc"], X.normal_newlines("t")) == ["a\nb\nc"]
    assert len(values(spark, ["y" * 100], X.trim_tail("t", 50))[0]) == 50


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(st.characters(max_codepoint=0x2FFF, exclude_categories=("Cs", "Cn")), max_size=40), min_size=1, max_size=20))
def test_pieces_as_the_regex_module_finds_them(spark, texts):
    assert values(spark, texts, F.concat_ws("", X.pieces("t"))) == texts
    ascii_ = [t.encode("ascii", "ignore").decode() for t in texts]
    want = [regex.findall(P.PIECES.removeprefix("(?U)"), t) for t in ascii_]
    got = values(spark, ascii_, X.pieces("t"))
    assert [p for p, t in zip(got, ascii_, strict=True) if not set(t) & set("\x1c\x1d\x1e\x1f")] == [p for p, t in zip(want, ascii_, strict=True) if not set(t) & set("\x1c\x1d\x1e\x1f")]


@pytest.mark.parametrize("p", [0, 50, 95, 99, 100])
def test_nearest_rank(spark, p):
    for n in (1, 2, 5, 12):
        got = spark.range(1).select(X.nearest_rank(F.sequence(F.lit(0), F.lit(n - 1)), float(p)).alias("v")).first()[0]
        assert got == round(p / 100 * (n - 1))
