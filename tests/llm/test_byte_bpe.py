import base64
import hashlib
import random

import numpy as np
import tiktoken

from lexforge.llm import byte_bpe as B

ODD = ["", " ", "\n\n\t  x", "a" * 5000, "😀👨‍👩‍👧 日本語テキスト", "don't I'LL we've", "x" * 255 + " " + "y" * 257, "\x00\x01 end", "<|endoftext|>", "1234567890 " * 50, "é" * 300]


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(B.RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=B.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_documents(spark, sf_dir, documents):
    enc, texts = library(), {r.doc_id: r.text or "" for r in documents.collect()}
    got = B.op7_duckdb_bpe(spark, sf_dir).collect()
    assert len(got) == documents.count()
    for r in got:
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_odd_and_random_texts():
    enc, bpe, rng = library(), B.DuckBpe(), random.Random(7)
    texts = ODD + ["".join(rng.choice("abcdeéñ 漢字.,'\n 0123") for _ in range(rng.randrange(300))) for _ in range(200)]
    for t, ids in zip(texts, bpe.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(t), t
    assert [b"".join(p) for p in bpe.decode(bpe.encode(texts))] == [t.encode() for t in texts]


def test_long_pieces():
    """Pieces of 300, 5,000 and 100,000 bytes: of one letter, of a few, and of a language's."""
    enc, bpe, rng = library(), B.DuckBpe(), random.Random(11)
    parts = ["ther", "ing", "tion", "aux", "men", "qu", "ré", "што", "e", "s"]
    texts = ["".join(rng.choice(x) for _ in range(n)) for x in ("ab", "aab", "etaoinshr", parts) for n in (17, 34, 300, 5000)]
    texts += ["x" * 100_000, "ab" * 50_000, "".join(rng.choice(parts) for _ in range(30_000)), "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000))]
    for t, ids in zip(texts, bpe.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(t), t[:40]


def test_merges_that_bring_lower_ranks():
    """Vocabularies that no trainer makes: a longer token may have a lower rank than its parts."""
    rng = random.Random(5)
    for _ in range(12):
        bpe = B.DuckBpe()
        tokens = {"".join(rng.choice("ab") for _ in range(rng.randrange(2, 6))).encode() for _ in range(14)}
        order = [*(bytes([i]) for i in range(256)), *rng.sample(sorted(tokens), len(tokens))]
        bpe.load({t: i for i, t in enumerate(order)})
        for n in (3, 8, 40, 300):
            t = "".join(rng.choice("ab") for _ in range(n)).encode()
            parts = [t[i : i + 1] for i in range(n)]
            while True:
                ranked = [(bpe.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in bpe.ranks]
                if not ranked:
                    break
                i = min(ranked)[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            assert np.frombuffer(bpe.contract([t])[0], "<u4").tolist() == [bpe.ranks[p] for p in parts], t


def test_known_pieces_are_bounded():
    bpe = B.DuckBpe(bound=200_000)
    enc = library()
    for k in range(40):
        t = " ".join(f"wörd{k}x{i}" for i in range(200))
        assert np.frombuffer(bpe.encode([t])[0], "<u4").tolist() == enc.encode_ordinary(t)
        assert len(bpe.known) + len(bpe.before) < 2000


def test_messy_rows(messy, empty):
    got = B.encoded(messy).collect()
    assert len(got) == messy.count() and all(r.n_tokens == len(r.ids) for r in got)
    assert all(r.n_tokens == 0 for r in got if r.doc_id in (4, 5))
    assert B.encoded(empty).collect() == []
