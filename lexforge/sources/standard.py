"""Tokenizers and mappings in the usual JSON files, on any file system that Spark reads."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.functions import patterns as P
from lexforge.operators import mapping as M
from lexforge.operators.bpe import Vocabulary, to_bytes, to_chars


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One file, written under another name and then renamed, so that no reader sees half of it."""
    jvm = spark.sparkContext._jvm
    at, draft = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".new")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(draft, True)
    out.write(text.encode())
    out.close()
    fs.delete(at, False)
    if not fs.rename(draft, at):
        raise OSError(f"{path} can't be written")


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


# ---- tokenizers ----------------------------------------------------------------------------------------------


def tokenizer_dict(vocabulary: Vocabulary) -> dict:
    """Byte-level BPE as the tokenizers library reads it. Special tokens come first, then added ones, by id."""
    added = [(i, t, True) for t, i in vocabulary.special.items()] + [(i, t, False) for t, i in vocabulary.added.items()]
    level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    return {
        "version": "1.0", "truncation": None, "padding": None,
        "added_tokens": [{"id": i, "content": t, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": s} for i, t, s in sorted(added)],
        "normalizer": None, "pre_tokenizer": level, "post_processor": None, "decoder": level,
        "model": {
            "type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False,
            "vocab": {_name(b): i for b, i in sorted(vocabulary.ids.items(), key=lambda x: x[1])}, "merges": [[_name(a), _name(b)] for a, b in vocabulary.merges],
        },
    }


def _name(token: bytes) -> str:
    """Characters of the alphabet that are no bytes stand for themselves."""
    try:
        text = token.decode()
    except UnicodeDecodeError:
        return to_chars(token)
    return text if len(text) == 1 and any(a <= ord(text) <= b for a, b in P.PUA_RANGES) else to_chars(token)


def vocabulary_of(model: dict) -> Vocabulary:
    """From the content of a tokenizer file. Ids may have gaps; entries that are added or special tokens too are left out of the BPE vocabulary."""
    bpe, out = model["model"], Vocabulary()
    if bpe.get("type", "BPE") != "BPE":
        raise ValueError(f"a model of type {bpe['type']}, not BPE")
    for t in model.get("added_tokens") or []:
        (out.special if t.get("special") else out.added)[t["content"]] = t["id"]
    whole = out.special.keys() | out.added.keys()
    out.ids = {to_bytes(t): i for t, i in bpe["vocab"].items() if t not in whole}
    pairs = (m.split(" ", 1) if isinstance(m, str) else m for m in bpe["merges"])
    out.merges = [(to_bytes(a), to_bytes(b)) for a, b in pairs]
    return out


def write_tokenizer(spark: SparkSession, vocabulary: Vocabulary, path: str) -> None:
    write_text(spark, path, json.dumps(tokenizer_dict(vocabulary), ensure_ascii=False))


def read_tokenizer(spark: SparkSession, path: str) -> Vocabulary:
    return vocabulary_of(json.loads(read_text(spark, path)))


def tokenizer_config(special: tuple[str, ...], longest: int = 1 << 30) -> dict:
    """What a wrapper wants to know besides: names of special tokens by their spelling, and that white space stays as it is."""
    roles = {"bos_token": ("<s>", "<bos>"), "eos_token": ("</s>", "<eos>", "<|endoftext|>"), "pad_token": ("<pad>", "<|pad|>"), "unk_token": ("<unk>",), "mask_token": ("<mask>",)}
    named = {role: t for role, names in roles.items() for t in names if t in special}
    return {"tokenizer_class": "PreTrainedTokenizerFast", "model_max_length": longest, "clean_up_tokenization_spaces": False, "add_prefix_space": False, "additional_special_tokens": [t for t in special if t not in named.values()], **named}


def write_tokenizer_config(spark: SparkSession, special: tuple[str, ...], path: str) -> None:
    write_text(spark, path, json.dumps(tokenizer_config(special), sort_keys=True, ensure_ascii=False))


# ---- mappings ------------------------------------------------------------------------------------------------


def write_mapping(spark: SparkSession, mapping: DataFrame, path: str) -> None:
    """{word: code point}, by code point; CAPACITY entries at most."""
    rows = mapping.select("word", "codepoint").orderBy("codepoint").collect()
    write_text(spark, path, json.dumps({r["word"]: r["codepoint"] for r in rows}, ensure_ascii=False))


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """rank, word, codepoint and pua, if it is one to one and all code points are characters for private use."""
    found = json.loads(read_text(spark, path))
    strange = [c for c in found.values() if not isinstance(c, int) or not 0 <= c <= 0x10FFFF or 0xD800 <= c <= 0xDFFF]
    if strange:
        raise ValueError(f"no code points: {strange[:5]}")
    rows = [(rank, w, c, chr(c)) for rank, (w, c) in enumerate(sorted(found.items(), key=lambda x: x[1]), 1)]
    out = spark.createDataFrame(rows, "rank int, word string, codepoint int, pua string")
    M.validate(out)
    return out


# ---- audit of a tokenizer file -------------------------------------------------------------------------------


def _has_level(part: dict | None) -> bool:
    return bool(part) and (part.get("type") == "ByteLevel" or any(_has_level(x) for x in part.get("pretokenizers") or part.get("decoders") or []))


def broken_invariants(model: dict, characters: list[str]) -> list[str]:
    """Which of four don't hold: a BPE model, a byte-level decoder, a byte-level pre-tokenizer, and an id for each mapped character."""
    known = set(model["model"].get("vocab", {})) | {t["content"] for t in model.get("added_tokens") or []}
    lacking = [c for c in characters if c not in known]
    checks = (
        (model["model"].get("type") == "BPE", "the model isn't BPE"), (_has_level(model.get("decoder")), "the decoder isn't byte-level"),
        (_has_level(model.get("pre_tokenizer")), "the pre-tokenizer isn't byte-level"), (not lacking, f"{len(lacking)} private-use characters have no id"),
    )
    return [why for ok, why in checks if not ok]


def audit_file(spark: SparkSession, path: str, mapping: DataFrame, strict: bool = True) -> dict[str, int]:
    """Merges of two private-use characters are counted and (if strict) taken out of the file, ids stay; then all four invariants must hold."""
    model = json.loads(read_text(spark, path))
    single = lambda t: len(t) == 1 and any(a <= ord(t) <= b for a, b in P.PUA_RANGES)
    pairs = [m.split(" ", 1) if isinstance(m, str) else m for m in model["model"]["merges"]]
    kept = [m for m, (a, b) in zip(model["model"]["merges"], pairs, strict=True) if not (single(a) and single(b))]
    found = len(pairs) - len(kept)
    characters = [r[0] for r in mapping.select("pua").filter(F.col("pua").isNotNull()).collect()]
    if strict:
        model["model"]["merges"] = kept
    if why := broken_invariants(model, characters):
        raise ValueError("; ".join(why))
    if strict and found:
        write_text(spark, path, json.dumps(model, ensure_ascii=False))
    return {"found": found, "removed": found if strict else 0}
