import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from lexforge.llm import packing as P


def library():
    t = Tokenizer.from_file(P.TOKENIZER)
    t.encode_special_tokens = True
    return t


def check(got, docs, tokenizer, slack=1.02):
    """docs: (doc_id, text), doc_ids unique."""
    ids = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for d, t in docs}
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == ids.keys()
    for d, rows in pieces.items():
        rows.sort(key=lambda r: r.piece)
        assert [(r.piece, r.start) for r in rows] == [(k, k * P.CAPACITY) for k in range(len(rows))]
        for r in rows:
            part = ids[d][r.start : r.start + r.length]
            assert len(part) == r.length and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
            assert r.length == P.CAPACITY or r is rows[-1]
        assert sum(r.length for r in rows) == len(ids[d])
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= P.CAPACITY
    least = -(-sum(map(len, ids.values())) // P.CAPACITY)
    assert len(bins) <= least * slack + 1


def test_documents(spark, sf_dir, documents):
    check(P.op9_residual_packing(spark, sf_dir).collect(), [(r.doc_id, r.text) for r in documents.collect()], library())


def test_many_partitions_pack_as_well_as_one(spark, documents):
    docs = documents.repartition(40)
    # five documents a partition: sequences that few documents leave open are merged as they are
    check(P.packed(docs).collect(), [(r.doc_id, r.text) for r in documents.collect()], library(), slack=1.08)


def test_ids_as_the_library_says():
    own, lib, rng = P.WordTokenizer(P.TOKENIZER), library(), random.Random(3)
    texts = ["", " ", "It's 3½ don'T É ÿ ßtraße", "日本語 text", "<|endoftext|> a", "x" * 5000, "a b", "İstanbul ﬁ"]
    texts += ["".join(rng.choice("aB c'stré½²1 \n.,!-—漢") for _ in range(rng.randrange(80))) for _ in range(400)]
    for t in texts:
        assert np.frombuffer(own.ids(t), "<u4").tolist() == [*lib.encode(t, add_special_tokens=False).ids, 0], t


def test_best_fit():
    bins, offsets, fill = P.best_fit([5, 5, 4, 3, 3], 10)
    assert sorted(fill) == [10, 10] and len(bins) == len(offsets) == 5


def test_messy_rows(messy, empty):
    got = P.packed(messy).collect()
    assert sum(r.piece == 0 for r in got) == messy.count()
    assert all(r.length == 1 for r in got if r.doc_id in (4, 5))
    assert P.packed(empty).collect() == []
