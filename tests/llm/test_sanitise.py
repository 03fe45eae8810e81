import hashlib
import math
import os
import random
import re
from collections import Counter

from lexforge.llm import sanitise as S

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def right(kind, s):
    digits = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        doubled = [int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    return [[m.span() for m in re.finditer(p, text) if right(k, m.group())] for k, p in PATTERNS.items()]


def test_base_spans_as_the_patterns_say(documents):
    for r in documents.select("text").collect():
        assert S.found(r.text or "") == brute(r.text or "")
    rng = random.Random(1)
    for alphabet in ("0123456789 -.", "+0123456789().- ", "ab@.-_%", "1.2 3.4.5.6", "a@b.c@d.e "):
        for _ in range(3000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))
            assert S.found(text) == brute(text), text


def test_query(spark, sf_dir, documents):
    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    for r in S.op4_information_sanitise(spark, sf_dir).collect():
        want = brute(texts[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k, s in zip(S.KINDS, want, strict=True) for a, b in s)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(s) for s in want]
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and r.spans.startswith(joined)


def brute_terms(texts, alpha=S.ALPHA, support=S.SUPPORT, evidence=S.EVIDENCE):
    """{term: whether it is removed} by PMI and information over distinct texts: every term against every value and kind."""
    texts = sorted({t or "" for t in texts})
    pattern = r"[^\W\d_]{3,}"
    words = [set(re.findall(pattern, t.lower())) for t in texts]
    holds, outside = {}, []
    for i, t in enumerate(texts):
        base, bare = brute(t), list(t)
        for k, spans in enumerate(base):
            for a, b in spans:
                holds.setdefault(S._entity(k, t[a:b]), set()).add(i)
                holds.setdefault(S.KINDS[k], set()).add(i)
                bare[a:b] = "0" * (b - a)
        outside.append(set(re.findall(pattern, "".join(bare).lower())))
    n_t, out = Counter(w for ws in words for w in ws), {}
    for c, where in holds.items():
        for w, n_tc in Counter(w for i in where for w in outside[i]).items():
            ic = math.log(len(texts) / len(where))
            if n_tc >= support and n_tc * ic >= evidence and math.log(n_tc * len(texts) / (len(where) * n_t[w])) >= ic / alpha - 1e-12:
                out[w] = out.get(w, False) or n_tc >= n_t[w]
    return out


def chosen(spark, texts):
    docs = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("__pii_key", S._key()).repartition(3)
    return {r.term: r.certain for r in S.disclosing(docs).collect()}


def letters(rng):
    common = ["apple", "river", "stone", "cloud", "green", "table", "music", "paper", "light", "house"]
    far = lambda: " ".join(rng.choices(common, k=400))
    texts = [" ".join(rng.choices(common, k=30)) for _ in range(60)]
    for i in range(6):  # the name stands at the head, the address at the end
        texts.append(f"{rng.choice(common)} Zorblax minister of Quendale {far()} mail zorblax@court.org {rng.choice(common)} number {i}")
    return texts + texts[-3:]


def test_disclosing_terms(spark):
    texts = letters(random.Random(5))
    want = brute_terms(texts)
    assert chosen(spark, texts) == want and {"zorblax", "quendale", "minister"} <= want.keys() and not {"apple", "court", "org"} & want.keys()
    clean = [r[0] for r in S.sanitised(spark.createDataFrame([(t,) for t in texts], "text string")).select("__pii_text").collect()]
    assert not any("orblax" in t or "@" in t for t in clean)


def test_terms_of_documents(spark, documents):
    """On the tables: the kinds have terms that brute force confirms, and they are marked wherever they stand."""
    folder = "/root/testdata/sf0.01/documents.parquet"
    docs = spark.read.parquet(folder).select("doc_id", "text") if os.path.exists(folder) else documents.select("doc_id", "text")
    rows = docs.collect()
    want = brute_terms([r.text for r in rows])
    assert chosen(spark, [r.text for r in rows]) == want
    text = {r.doc_id: r.text or "" for r in rows}
    marked = 0
    for r in S.sanitised(docs, text_out=False).collect():
        base = [x for s in brute(text[r.doc_id]) for x in s]
        spans = [x.split(":") for x in r["__pii_spans"].split(",") if x]
        own = [(m.start(), m.end()) for m in re.finditer(r"[^\W\d_]{3,}", text[r.doc_id]) if m.group().lower() in want and not any(a <= m.start() < b for a, b in base)]
        assert [(int(a), int(b)) for k, a, b in spans if k == "term"] == own
        marked += len(own)
    assert marked > 0 or folder not in str(docs.inputFiles())


def test_terms_too_many_to_send(spark, monkeypatch):
    docs = spark.createDataFrame([(t,) for t in letters(random.Random(6))], "text string")
    get = lambda: sorted((r["__pii_spans"], r["__pii_text"]) for r in S.sanitised(docs).collect())
    want = get()
    monkeypatch.setattr(S, "BROADCAST_TERMS", 0)
    assert get() == want


def test_messy_rows(messy, empty):
    got = S.clean_documents(messy)
    assert got.columns == messy.columns and got.count() == messy.count()
    by = {r.doc_id: r for r in got.collect()}
    assert by[4].text is None and by[4].n_chars is None and by[5].text == ""
    assert "[EMAIL]" in by[9].text and "[IP]" in by[9].text and "4111" not in by[9].text and by[9].n_chars == len(by[9].text)
    assert S.clean_documents(empty).collect() == []


def test_a_disclosing_term_goes_from_texts_without_the_entity(spark):
    texts = [f"plain words of text number {chr(97 + i // 26)}{chr(97 + i % 26)}x" for i in range(200)]
    texts += [f"Zorblax wrote from zorblax@court.org on day {i}" for i in range(6)] + ["nobody but Zorblax was here"]
    clean = [r[0] for r in S.sanitised(spark.createDataFrame([(t,) for t in texts], "text string")).select("__pii_text").collect()]
    assert "nobody but [TERM] was here" in clean and not any("orblax" in t for t in clean)
