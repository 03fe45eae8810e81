"""One query for each operator over the whole of its table, and the same in SQL, written on its own.

The tables hold no secrets, licence headers, identifiers of several words or private-use characters, so queries about these derive
them from ids in the same way on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.functions import patterns as P
from lexforge.functions import text as X
from lexforge.operators import baseline, batch, bpe, evaluate, frequency, mapping, selection
from lexforge.sources import corpus

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def note(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return note


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table in as many partitions as tasks can run at least. Large tables have more than that and stay as they are."""
    rows, least = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return rows.repartition(least) if rows.rdd.getNumPartitions() < least else rows


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


# ---- pieces of SQL -------------------------------------------------------------------------------------------

_TOK = P.token_pattern(r"[^\s\p{Z}\x{85}\x{0B}\p{L}\p{N}\p{M}\p{Pc}_]")
_WS, _NWS = r"[\s\p{Z}\x{85}\x{0B}]", r"[^\s\p{Z}\x{85}\x{0B}]"
# no look-ahead there: a mark is put before the last space of a run that another character follows
_GPT = rf"''s|''t|''re|''ve|''m|''ll|''d| ?\p{{L}}+| ?\p{{N}}+| ?[^\s\p{{Z}}\x{{85}}\x{{0B}}\p{{L}}\p{{N}}\x{{1}}]+|{_WS}+"
_RUNS = "regexp_extract_all(regexp_replace({0}, '([A-Z])([A-Z][a-z])', '\\1_\\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+')"
_IDENT = "regexp_full_match({0}, '[A-Za-z_][A-Za-z0-9_]*')"


def _tokens(c: str) -> str:
    return f"regexp_extract_all({c}, '{_TOK}')"


def _pieces(c: str) -> str:
    return f"regexp_extract_all(regexp_replace({c}, '({_WS})({_WS}{_NWS})', '\\1' || chr(1) || '\\2', 'g'), '{_GPT}')"


def _boosted(docs: str, ppm: int) -> str:
    return f"""f AS (SELECT token, count(*) AS n FROM (SELECT unnest({_tokens("text")}) AS token FROM {docs}) WHERE length(token) <= 50 GROUP BY token),
 p AS (SELECT part AS token, n FROM (SELECT token, n, unnest({_RUNS.format("token")}) AS part FROM f WHERE {_IDENT.format("token")}) WHERE part <> token),
 freq AS (SELECT token, (sum(n) + (sum(parts) * {ppm} + 999999) // 1000000)::BIGINT AS freq
          FROM (SELECT token, n, 0 AS parts FROM f UNION ALL SELECT token, 0, n FROM p) GROUP BY token)"""


_HASH = """(regexp_full_match({0}, '(?i)[0-9a-f]{{8}}(-[0-9a-f]{{4}}){{3}}-[0-9a-f]{{12}}') OR regexp_full_match({0}, '(?i)[0-9a-f]{{16,}}')
 OR (regexp_full_match({0}, '[A-Za-z0-9+/=_-]{{24,}}') AND len(regexp_extract_all({0}, '[a-z]{{3,}}')) < 2))"""
_GOOD = "(trim({0}) <> '' AND length({0}) <= 50 AND strlen({0}) > 1 AND NOT " + _HASH + ")"
_SAVED = "saved AS (SELECT token, freq, freq * (length(token) - 1) AS score FROM freq WHERE " + _GOOD.format("token") + " AND freq * (length(token) - 1) >= 1)"
_TOP = "top AS (SELECT token, freq, score, row_number() OVER (ORDER BY score DESC, token) AS rank FROM saved QUALIFY rank <= {0})"

# texts with keys and licence headers in some
_SECRET = "concat(text, CASE WHEN doc_id % 10 = 3 THEN ' AK' || 'IA' || upper(substr(sha256(doc_id::VARCHAR), 1, 16)) WHEN doc_id % 10 = 5 THEN ' gh' || 'p_' || substr(sha256(doc_id::VARCHAR), 1, 36) ELSE '' END)"
_HEADED = "concat(CASE doc_id % 7 WHEN 0 THEN '# SPDX-License-Identifier: MIT' || chr(10) WHEN 1 THEN '// spdx-license-identifier : GPL-3.0' || chr(10) WHEN 2 THEN 'License: UNLICENSED' || chr(10) WHEN 3 THEN '# SPDX-License-Identifier: MIT OR Apache-2.0' || chr(10) ELSE '' END, text)"
_SPDX = "regexp_extract(substr({0}, 1, 4096), '(?i)SPDX-License-Identifier\\s*:\\s*([A-Za-z0-9.\\-+ ]+)', 1)"
_HAS_SPDX = "regexp_matches(substr({0}, 1, 4096), '(?i)SPDX-License-Identifier\\s*:\\s*([A-Za-z0-9.\\-+ ]+)')"
_PROPRIETARY = "regexp_matches(substr({0}, 1, 4096), '(?i)\\b(All Rights Reserved|Proprietary and Confidential|UNLICENSED|License: Proprietary)\\b')"
_ALLOWED = "(CASE WHEN " + _HAS_SPDX + " THEN lower(trim(" + _SPDX + ")) IN ('mit', 'apache-2.0', 'bsd-3-clause', 'bsd-2-clause', 'isc', 'apache 2.0', 'apache license 2.0') ELSE NOT " + _PROPRIETARY + " END)"
_NAME = "CASE " + " ".join(f"WHEN regexp_matches({{0}}, '{p.replace('{', '{{').replace('}', '}}')}') THEN '{n}'" for n, p in P.SECRETS) + " END"


def _secret_text(c="text"):
    h = F.sha2(F.col("doc_id").cast("string"), 256)
    k = F.col("doc_id") % 10
    return F.concat(F.col(c), F.when(k == 3, F.concat(F.lit(" AK" + "IA"), F.upper(F.substring(h, 1, 16)))).when(k == 5, F.concat(F.lit(" gh" + "p_"), F.substring(h, 1, 36))).otherwise(""))


def _headed_text(c):
    k = F.col("doc_id") % 7
    head = F.when(k == 0, "# SPDX-License-Identifier: MIT\n").when(k == 1, "// spdx-license-identifier : GPL-3.0\n").when(k == 2, "License: UNLICENSED\n").when(k == 3, "# SPDX-License-Identifier: MIT OR Apache-2.0\n").otherwise("")
    return F.concat(head, c)


_PATH = "source || '/' || lpad(doc_id::VARCHAR, 9, '0') || CASE doc_id % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.MD' ELSE '.bin' END"


def _files(docs: DataFrame) -> DataFrame:
    k = F.col("doc_id") % 3
    path = F.concat("source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.when(k == 0, ".py").when(k == 1, ".MD").otherwise(".bin"))
    return docs.withColumn("path", path)


# ---- corpus --------------------------------------------------------------------------------------------------


@query(f"SELECT path, strlen(text)::BIGINT AS n_bytes FROM (SELECT {_PATH} AS path, text FROM documents) WHERE lower(path[-3:]) IN ('.py', '.md') AND strlen(text) <= 20000")
def corpus_files_filter(spark, sf_dir):
    files = _files(_docs(spark, sf_dir)).withColumn("length", F.octet_length("text").cast("long"))
    return corpus.wanted(files, (".PY", ".md"), 20_000).select("path", F.col("length").alias("n_bytes"))


_JUDGED = f"""j AS (SELECT doc_id, path, t, CASE WHEN t IS NULL THEN 'decode' WHEN t = '' THEN 'size' WHEN ({_NAME.format("t")}) IS NOT NULL THEN 'secret' WHEN NOT {_ALLOWED.format("t")} THEN 'license' END AS reject
 FROM (SELECT doc_id, {_PATH} AS path, {_HEADED.replace(", text)", ", " + _SECRET + ")")} AS t FROM (FROM documents UNION ALL FROM documents WHERE doc_id % 4 = 1))),
 s AS (SELECT path, t, coalesce(reject, CASE WHEN row_number() OVER (PARTITION BY reject, t ORDER BY path) > 1 THEN 'dedup' ELSE 'kept' END) AS status FROM j)"""


def _records(spark, sf_dir):
    """Every document, and a fourth of them once more: records of one path and text."""
    docs = _docs(spark, sf_dir)
    return _files(docs.union(docs.filter("doc_id % 4 = 1"))).select("path", _headed_text(_secret_text()).alias("text"))


@query(f"WITH {_JUDGED} SELECT path, sha256(t) AS sha256, status FROM s")
def ingest_status(spark, sf_dir):
    return corpus.judged(_records(spark, sf_dir), licenses=True).select("path", "sha256", "status")


@query(f"""WITH {_JUDGED} SELECT count(*)::BIGINT AS n_seen, {", ".join(f"count_if(status = '{x}')::BIGINT AS {'n_kept' if x == 'kept' else 'dropped_' + x}" for x in corpus.STATUS)},
 coalesce(sum(CASE WHEN status = 'kept' THEN strlen(t) END), 0)::BIGINT AS bytes_kept FROM s""")
def ingest_stats(spark, sf_dir):
    return corpus.ingest_stats(corpus.judged(_records(spark, sf_dir), licenses=True))


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL GROUP BY text")
def exact_dedup(spark, sf_dir):
    return corpus.exact_dedup(_docs(spark, sf_dir), "doc_id")


@query("SELECT doc_id, prefix FROM (SELECT doc_id, substr(sha256(text), 1, 16) AS prefix FROM documents WHERE text IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY prefix ORDER BY doc_id) = 1")
def dedup_prefix16(spark, sf_dir):
    rows = _docs(spark, sf_dir).filter("text IS NOT NULL").select("doc_id", F.substring(F.sha2("text", 256), 1, 16).alias("prefix"))
    return corpus.first_of_each(rows, F.col("prefix"), "doc_id")


@query(f"SELECT doc_id, {_NAME.format('t')} AS secret FROM (SELECT doc_id, {_SECRET} AS t FROM documents)")
def secret_scan(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.secret_name(_secret_text()).alias("secret"))


@query(f"SELECT doc_id, CASE WHEN {_HAS_SPDX.format('t')} THEN trim({_SPDX.format('t')}) END AS spdx, {_ALLOWED.format('t')} AS allowed FROM (SELECT doc_id, {_HEADED} AS t FROM documents)")
def license_detect(spark, sf_dir):
    t = _headed_text(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", X.license_id(t).alias("spdx"), X.license_allowed(t).alias("allowed"))


@query("""SELECT doc_id, list_has_any(['mit', 'isc'], list_transform(list_concat(a, b), lambda x: lower(trim(x)))) AS allowed
FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN [' MIT '] ELSE [] END AS a, CASE WHEN doc_id % 5 = 0 THEN ['GPL', 'isc'] WHEN doc_id % 5 = 1 THEN [lang] ELSE [] END AS b FROM documents)""")
def license_any_match(spark, sf_dir):
    k = F.col("doc_id")
    docs = _docs(spark, sf_dir).withColumns({"a": F.when(k % 3 == 0, F.array(F.lit(" MIT "))), "b": F.when(k % 5 == 0, F.array(F.lit("GPL"), F.lit("isc"))).when(k % 5 == 1, F.array("lang"))})
    return docs.select("doc_id", X.any_license_allowed(["a", "b"], ["MIT", "ISC"]).alias("allowed"))


@query("SELECT sha256(text) AS sha256, CASE WHEN sha256(text)[1] = '0' THEN 'holdout' ELSE 'train' END AS split FROM documents WHERE length(text) BETWEEN 100 AND 200000 GROUP BY text")
def hash_split(spark, sf_dir):
    rows = _docs(spark, sf_dir).select(F.col("text").alias("content"), F.array(F.lit("MIT")).alias("licenses"))
    return corpus.hub_split(rows, ["licenses"]).select("sha256", "split")


@query("SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS turn FROM documents")
def round_robin_by_lang(spark, sf_dir):
    return corpus.round_robin(_docs(spark, sf_dir).select("doc_id", "lang"), "lang", "doc_id")


@query("SELECT doc_id, source FROM documents ORDER BY sha256('42:' || doc_id::VARCHAR), doc_id LIMIT 150")
def seeded_sample(spark, sf_dir):
    return corpus.seeded_sample(_docs(spark, sf_dir).select("doc_id", "source"), "doc_id", 42, 150)


@query("""WITH p AS (SELECT substr(h, 1, 3) AS part, sha256(string_agg(h, chr(10) ORDER BY h)) AS h2 FROM (SELECT sha256(text) AS h FROM documents WHERE text IS NOT NULL) GROUP BY 1)
SELECT sha256(string_agg(part || ':' || h2, chr(10) ORDER BY part || ':' || h2)) AS corpus_hash FROM p""")
def corpus_hash(spark, sf_dir):
    return corpus.corpus_hash(_docs(spark, sf_dir).filter("text IS NOT NULL").select(F.sha2("text", 256).alias("sha256")))


# ---- tokens --------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, (i - 1)::BIGINT AS pos, token FROM (SELECT doc_id, unnest(l) AS token, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, {_tokens('text')} AS l FROM documents))")
def token_positions(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", F.posexplode(X.tokens("text")).alias("pos", "token"))
    return rows.withColumn("pos", F.col("pos").cast("long"))


@query(f"SELECT page_id, len({_tokens('html')})::BIGINT AS n_tokens FROM pages")
def token_counts_per_page(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", F.size(X.tokens("html")).cast("long").alias("n_tokens"))


_IDENTS = "SELECT p_partkey, replace(p_name, ' ', '_') || '_' || p_size AS ident FROM part UNION ALL SELECT p_partkey, split_part(p_name, ' ', 1) || upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] || 'HTTP' || upper(p_brand[1]) || p_brand[2:] FROM part"


def _identifiers(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    a, b = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    up = lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))
    snake = part.select("p_partkey", F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_size").cast("string")).alias("ident"))
    return snake.union(part.select("p_partkey", F.concat(a, up(b), F.lit("HTTP"), up(F.col("p_brand"))).alias("ident")))


@query(f"SELECT p_partkey, ident, {_IDENT.format('ident')} AS is_identifier, array_to_string({_RUNS.format('ident')}, ' ') AS parts FROM ({_IDENTS})")
def split_identifiers(spark, sf_dir):
    return _identifiers(spark, sf_dir).select("p_partkey", "ident", X.is_identifier("ident").alias("is_identifier"), F.array_join(X.identifier_parts("ident"), " ").alias("parts"))


@query(f"SELECT token, count(*)::BIGINT AS n FROM (SELECT unnest({_tokens('text')}) AS token FROM documents) WHERE length(token) <= 50 GROUP BY token")
def token_frequency(spark, sf_dir):
    return frequency.token_frequency(_docs(spark, sf_dir))


@query(f"WITH i AS (SELECT ident AS text FROM ({_IDENTS})), {_boosted('i', 300000)} SELECT * FROM freq")
def boosted_frequency(spark, sf_dir):
    return frequency.boosted_frequency(_identifiers(spark, sf_dir).withColumnRenamed("ident", "text"))


@query(f"""SELECT token, {_GOOD.format("token")} AS good FROM (SELECT DISTINCT token FROM (SELECT unnest({_tokens("text")}) AS token FROM documents
 UNION ALL SELECT sha256(doc_id::VARCHAR) FROM documents UNION ALL SELECT upper(lang) || '_' || repeat('SCREAMING', 3) FROM documents))""")
def good_tokens(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    rows = docs.select(F.explode(X.tokens("text")).alias("token")).union(docs.select(F.sha2(F.col("doc_id").cast("string"), 256))).union(docs.select(F.concat(F.upper("lang"), F.lit("_" + "SCREAMING" * 3))))
    return rows.filter("token IS NOT NULL").distinct().select("token", X.good_token("token").alias("good"))


@query(f"WITH {_boosted('documents', 300000)}, {_SAVED}, {_TOP.format(100)} SELECT token, freq, score FROM top")
def savings_topk(spark, sf_dir):
    return selection.by_savings(frequency.boosted_frequency(_docs(spark, sf_dir)), 100)


_COVER = f"""WITH {_boosted("documents", 300000)}, c AS (SELECT token, freq, coalesce(sum(freq) OVER (ORDER BY freq DESC, token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM freq WHERE {_GOOD.format("token")}),
 chosen AS (SELECT token, freq FROM c WHERE before < 0.8 * (SELECT sum(freq) FROM freq))"""


@query(f"{_COVER} SELECT token, freq FROM chosen")
def coverage_select(spark, sf_dir):
    return selection.by_coverage(frequency.boosted_frequency(_docs(spark, sf_dir)).persist(), 0.8)


@query(f"{_COVER} SELECT round((SELECT sum(freq) FROM chosen) / (SELECT sum(freq) FROM freq), 9) AS coverage")
def coverage_of(spark, sf_dir):
    freq = frequency.boosted_frequency(_docs(spark, sf_dir)).persist()
    return selection.coverage_of(freq, selection.by_coverage(freq, 0.8)).select(F.round("coverage", 9).alias("coverage"))


# ---- mapping -------------------------------------------------------------------------------------------------


def _mapped(spark, sf_dir, n, taken=None):
    best = selection.by_savings(frequency.boosted_frequency(_docs(spark, sf_dir)), n)
    return mapping.assign(mapping.ranked(best, F.desc("score"), "token"), taken, skip_bmp=True)


_WITH_PUA = "text || chr((983040 + 3 * (doc_id % 50))::INTEGER)"


def _private_text():
    return F.concat("text", X.character(F.lit(983040) + 3 * (F.col("doc_id") % 50)))


@query(f"""WITH {_boosted("documents", 300000)}, {_SAVED}, {_TOP.format(500)},
 free AS (SELECT c, row_number() OVER (ORDER BY c) AS rank FROM (SELECT unnest(range(983040, 1048574)) AS c) WHERE c NOT IN (SELECT 983040 + 3 * (doc_id % 50) FROM documents))
SELECT rank, token AS word, c::INTEGER AS codepoint, chr(c::INTEGER) AS pua FROM top JOIN free USING (rank)""")
def pua_assignment(spark, sf_dir):
    taken = corpus.private_use_inventory(_docs(spark, sf_dir).select(_private_text().alias("text")))
    return _mapped(spark, sf_dir, 500, taken).withColumn("rank", F.col("rank").cast("long"))


@query("SELECT (983040 + 3 * (doc_id % 50))::INTEGER AS codepoint, count(*)::BIGINT AS n_docs FROM documents WHERE text IS NOT NULL GROUP BY 1")
def pua_inventory(spark, sf_dir):
    return corpus.private_use_inventory(_docs(spark, sf_dir).select(_private_text().alias("text")))


_SUB = f"""WITH {_boosted("documents", 300000)}, {_SAVED}, {_TOP.format(200)}, m AS (SELECT token, chr((983039 + rank)::INTEGER) AS pua FROM top),
 t AS (SELECT doc_id, unnest(l) AS token, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{_TOK}|(?s:.)') AS l FROM documents)),
 w AS (SELECT token, unnest(r) AS part, generate_subscripts(r, 1) AS k FROM (SELECT token, regexp_extract_all(regexp_replace(token, '([A-Z])([A-Z][a-z])', '\\1' || chr(1) || '\\2', 'g'), '_|[A-Z]?[a-z]+|[A-Z]+|[0-9]+') AS r FROM (SELECT DISTINCT token FROM t) WHERE {_IDENT.format("token")} AND token NOT IN (SELECT token FROM m))),
 v AS (SELECT w.token, string_agg(coalesce(m.pua, w.part), '' ORDER BY k) AS sub FROM w LEFT JOIN m ON w.part = m.token GROUP BY w.token),
 sub AS (SELECT doc_id, string_agg(coalesce(m.pua, v.sub, t.token), '' ORDER BY i) AS sub FROM t LEFT JOIN m USING (token) LEFT JOIN v USING (token) GROUP BY doc_id)"""


@query(f"{_SUB} SELECT doc_id, length(sub)::BIGINT AS n_chars, sha256(sub) AS sha256 FROM sub")
def pretokenized_text(spark, sf_dir):
    words = mapping.as_dict(_mapped(spark, sf_dir, 200))
    rows = _docs(spark, sf_dir).filter("text <> ''").select("doc_id", mapping.substituted("text", words).alias("sub"))
    return rows.select("doc_id", F.length("sub").cast("long").alias("n_chars"), F.sha2("sub", 256).alias("sha256"))


@query(f"{_SUB} SELECT doc_id, length(sub)::BIGINT AS n_chars, sha256(sub) AS sha256 FROM sub")
def pretokenized_by_join(spark, sf_dir):
    rows = mapping.substituted_by_join(_docs(spark, sf_dir).filter("text <> ''"), _mapped(spark, sf_dir, 200))
    return rows.select("doc_id", F.length("sub").cast("long").alias("n_chars"), F.sha2("sub", 256).alias("sha256"))


@query(f"{_SUB} SELECT doc_id, (length(sub) - length(regexp_replace(sub, '[\\x{{F0000}}-\\x{{FFFFD}}]', '', 'g')))::BIGINT AS n FROM sub")
def pua_substitution_count(spark, sf_dir):
    words = mapping.as_dict(_mapped(spark, sf_dir, 200))
    return _docs(spark, sf_dir).filter("text <> ''").select("doc_id", X.private_use_count(mapping.substituted("text", words)).alias("n"))


@query("SELECT doc_id, text FROM documents")
def pua_reverse_roundtrip(spark, sf_dir):
    words = mapping.as_dict(_mapped(spark, sf_dir, 200))
    return _docs(spark, sf_dir).select("doc_id", mapping.restored(mapping.substituted("text", words), words).alias("text"))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def split_text_rejoined(spark, sf_dir):
    """The pieces of every text, put together again with words for their characters."""
    words = mapping.as_dict(_mapped(spark, sf_dir, 200))
    pieces = _docs(spark, sf_dir).select("doc_id", F.concat_ws("", mapping.split_text("text", words)).alias("sub"))
    return pieces.select("doc_id", F.sha2(mapping.restored("sub", words), 256).alias("sha256"))


# ---- byte-level pieces and vocabularies ----------------------------------------------------------------------


@query(f"SELECT doc_id, (i - 1)::BIGINT AS pos, piece FROM (SELECT doc_id, unnest(l) AS piece, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, {_pieces('text')} AS l FROM documents))")
def gpt2_pieces(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", F.posexplode(X.pieces("text")).alias("pos", "piece"))
    return rows.withColumn("pos", F.col("pos").cast("long"))


_BYTES = "[" + ", ".join(f"'{c}'" if c != "'" else "''''" for c in P.byte_table()) + "]"
_LEVEL = f"array_to_string(list_transform(range(0, strlen(p)), lambda i: {_BYTES}[instr('0123456789ABCDEF', hex(p)[2 * i + 1]) * 16 + instr('0123456789ABCDEF', hex(p)[2 * i + 2]) - 16]), '')"


@query(f"SELECT {_LEVEL} AS piece, n FROM (SELECT p, count(*)::BIGINT AS n FROM (SELECT unnest({_pieces('text')}) AS p FROM documents) GROUP BY p)")
def piece_counts(spark, sf_dir):
    return bpe.piece_counts(_docs(spark, sf_dir))


@query("SELECT doc_id, sha256(text) AS sha256, strlen(text)::BIGINT AS n_bytes FROM documents")
def bytelevel_roundtrip(spark, sf_dir):
    level = X.byte_level("text")
    return _docs(spark, sf_dir).select("doc_id", F.sha2(X.from_byte_level(level), 256).alias("sha256"), F.length(level).cast("long").alias("n_bytes"))


def _codec(spark, sf_dir, size=2000):
    docs = _docs(spark, sf_dir)
    words = mapping.as_dict(_mapped(spark, sf_dir, 200))
    vocabulary = bpe.train(bpe.piece_counts(docs.select(mapping.substituted("text", words).alias("text"))), size)
    vocabulary.add(sorted(words.values()))
    return bpe.Codec(vocabulary, words)


@query("SELECT doc_id, TRUE AS ok FROM documents")
def bpe_roundtrip(spark, sf_dir):
    return evaluate.round_trip(_docs(spark, sf_dir), _codec(spark, sf_dir)).select("doc_id", "ok")


@query()
def bpe_token_stats(spark, sf_dir):
    done = evaluate.round_trip(_docs(spark, sf_dir), _codec(spark, sf_dir)).withColumn("tokenizer", F.lit("own"))
    return evaluate.percentiles(done, "n_tokens", "tokenizer")


@query("""SELECT m.rank, m.l AS "left", m.r AS "right" FROM (VALUES (0, 'a', 'b'), (2, 'ab', 'c')) m(rank, l, r)""")
def merge_audit(spark, sf_dir):
    merges = spark.createDataFrame([(0, "a", "b"), (1, "\ue000", "\ue001"), (2, "ab", "c"), (3, "\ue001", "\ue000")], "rank int, left string, right string")
    vocabulary = spark.createDataFrame([(0, "\ue000"), (1, "\ue001")], "id int, token string")
    return bpe.audited(merges, vocabulary, vocabulary.select(F.col("token").alias("pua")))[0]


@query("SELECT sha256(string_agg(id || chr(9) || token || chr(10), '' ORDER BY id)) AS vocab_hash FROM (SELECT p_partkey AS id, p_name AS token FROM part)")
def vocab_hash(spark, sf_dir):
    return bpe.vocabulary_hash(_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("token")))


# ---- reports -------------------------------------------------------------------------------------------------

_COUNTS = {"bytes": "strlen(text)", "chars": "length(text)", "gpt2_pieces": f"len({_pieces('text')})", "tokens": f"len({_tokens('text')})", "none": "(text <> '')::INTEGER"}
_RANKED = "list_sort(list(n))[(round_even({0} / 100 * (count(*) - 1), 0) + 1)::INTEGER]::BIGINT AS p{0}"
_REPORT = f"""r AS (SELECT tokenizer, count(*)::BIGINT AS n_files, sum(bytes)::BIGINT AS n_bytes, sum(n)::BIGINT AS n_tokens, round(sum(bytes) / greatest(1, sum(n)), 6) AS bytes_per_token, round(sum(n) / count(*), 6) AS mean_tokens,
 {", ".join(_RANKED.format(p) for p in (50, 95, 99))} FROM ({" UNION ALL ".join(f"SELECT '{k}' AS tokenizer, strlen(text) AS bytes, {e} AS n FROM documents WHERE text IS NOT NULL" for k, e in _COUNTS.items())}) GROUP BY tokenizer)"""


@query(f"WITH {_REPORT} SELECT r.*, round(n_tokens / (SELECT n_tokens FROM r WHERE tokenizer = 'gpt2_pieces'), 6) AS ratio FROM r")
def compression_report(spark, sf_dir):
    return evaluate.relative_to(evaluate.compression_report(_docs(spark, sf_dir)), "gpt2_pieces")


@query(f"SELECT lang, count(*)::BIGINT AS n, round(avg(n), 6) AS mean, {', '.join(_RANKED.format(p) for p in (50, 95, 99))} FROM (SELECT lang, length(text) AS n FROM documents WHERE text IS NOT NULL) GROUP BY lang")
def nearest_rank_percentiles(spark, sf_dir):
    rows = _docs(spark, sf_dir).filter("text IS NOT NULL").select("lang", F.length("text").cast("long").alias("n_chars"))
    return evaluate.percentiles(rows, "n_chars", "lang").withColumn("mean", F.round("mean", 6))


_PIECE_N = f"SELECT token, count(*)::BIGINT AS n FROM (SELECT unnest({_pieces('text')}) AS token FROM documents) GROUP BY token"
_MULTI = "(regexp_full_match(token, '[\\s\\p{Z}]+') OR (regexp_matches(token, '[\\p{L}\\p{N}_]') AND regexp_matches(token, '[^\\p{L}\\p{N}_]')))"


@query(f"SELECT token, n FROM ({_PIECE_N}) WHERE {_MULTI} ORDER BY n DESC, token LIMIT 100")
def multi_pattern_topk(spark, sf_dir):
    return evaluate.multi_patterns(_docs(spark, sf_dir))


@query(f"SELECT sum(n)::BIGINT AS n_pieces, sum(CASE WHEN {_MULTI} THEN n ELSE 0 END)::BIGINT AS n_cut, round(100 * sum(CASE WHEN {_MULTI} THEN n ELSE 0 END) / sum(n), 6) AS percent FROM ({_PIECE_N})")
def piece_waste(spark, sf_dir):
    return evaluate.waste(_docs(spark, sf_dir))


@query(f"SELECT token, n, length(token)::BIGINT AS cost, (n * (length(token) - 1))::BIGINT AS savings FROM ({_PIECE_N}) WHERE length(token) > 1 AND NOT contains(token, chr(65533)) ORDER BY savings DESC, token LIMIT 30000")
def savings_analysis(spark, sf_dir):
    return evaluate.savings_analysis(_docs(spark, sf_dir))


_BIGRAMS = f"""b AS (SELECT l[i] || l[i + 1] AS token, count(*)::BIGINT AS n FROM (SELECT l, unnest(range(1, len(l))) AS i FROM (SELECT {_pieces("html")} AS l FROM pages)) GROUP BY 1)"""


def _bigrams(spark, sf_dir):
    pieces = _table(spark, sf_dir, "pages").select(X.pieces("html").alias("l"))
    pairs = F.zip_with("l", F.slice("l", F.lit(2), F.greatest(F.size("l"), F.lit(1))), lambda a, b: F.concat(a, b))
    return pieces.select(F.explode(F.filter(pairs, lambda p: p.isNotNull())).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query(f"WITH {_BIGRAMS} SELECT token, n FROM b WHERE n >= 3 AND length(token) >= 2 AND NOT regexp_matches(token, '^[ \\t\\n]') AND regexp_matches(token, '[^\\s\\p{{Z}}\\p{{L}}\\p{{N}}_]') AND token NOT IN ('<p>', '</p>') ORDER BY n DESC, token LIMIT 200")
def compound_candidates(spark, sf_dir):
    known = spark.createDataFrame([("<p>",), ("</p>",)], "token string")
    return selection.compounds_by_count(_bigrams(spark, sf_dir), known, 200)


@query(f"WITH {_BIGRAMS} SELECT token, savings FROM (SELECT token, (n * (length(token) - 1))::BIGINT AS savings FROM b ORDER BY savings DESC, token LIMIT 500) WHERE savings >= 10 AND length(token) BETWEEN 2 AND 80 AND NOT regexp_matches(token, '[^\\x00-\\x7F]') AND trim(token, ' ' || chr(9) || chr(10)) <> '' AND token NOT IN ('<p>', '</p>')")
def compounds_by_savings(spark, sf_dir):
    known = spark.createDataFrame([("<p>",), ("</p>",)], "token string")
    rows = _bigrams(spark, sf_dir).select("token", (F.col("n") * (F.length("token") - 1)).cast("long").alias("savings"))
    return selection.compounds_by_savings(rows, known, 500)


_ADDED = ["<p>", "</p>", "<div", "</div>", "<!--", "-->", "</", "<a href="]


@query("SELECT page_id, match, count(*)::BIGINT AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '" + "|".join(sorted(_ADDED, key=lambda p: (-len(p), p))) + "')) AS match FROM pages) GROUP BY page_id, match")
def added_token_matches(spark, sf_dir):
    rows = evaluate.added_matches(_table(spark, sf_dir, "pages"), _ADDED, "html").select("page_id", F.explode("matches").alias("match"))
    return rows.groupBy("page_id", "match").agg(F.count("*").alias("n"))


@query(f"WITH {_boosted('documents', 300000)}, q(pattern) AS (VALUES ('the'), ('of the'), (' x'), ('self.')) SELECT pattern, replace(replace(pattern, ' ', 'Ġ'), chr(10), 'Ċ') IN (SELECT token FROM freq) AS in_vocab FROM q")
def pattern_coverage(spark, sf_dir):
    patterns = spark.createDataFrame([("the",), ("of the",), (" x",), ("self.",)], "pattern string")
    return evaluate.coverage_of_patterns(patterns, frequency.boosted_frequency(_docs(spark, sf_dir)))


#: Languages whose first text is broadcast; no other has more than a share of so many of the rows.
HOT_LANGS = 256


def _beside_heads(docs: DataFrame) -> DataFrame:
    """doc_id, text, and as head the text of the first document of the language; without null texts. No language is one: null stands for itself."""
    docs = docs.select("doc_id", "text", "lang")
    counts = docs.groupBy("lang").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(HOT_LANGS + 1).collect()
    hot = counts[:HOT_LANGS]
    of = lambda rows: rows.groupBy(F.col("lang").alias("__lang")).agg(F.min_by("text", "doc_id").alias("head"))
    same = F.col("lang").eqNullSafe(F.col("__lang"))
    firsts = docs.filter(F.col("doc_id").isin([r["first"] for r in hot if r["first"] is not None]))
    names = F.broadcast(docs.sparkSession.createDataFrame([(r["lang"],) for r in hot], "__lang string"))
    # the first documents of other languages aren't their heads if a number occurs twice
    heads = of(firsts.join(names, same, "left_semi"))
    out = docs.join(F.broadcast(heads), same)
    if len(counts) > len(hot):
        rest = docs.join(names, same, "left_anti")
        out = out.unionByName(rest.join(of(rest).hint("shuffle_merge"), same))
    return out.filter("text IS NOT NULL AND head IS NOT NULL").select("doc_id", "text", "head")


@query("""SELECT a.doc_id, (coalesce(list_position(list_transform(list_zip(string_split(a.text, ''), string_split(b.text, '')), lambda z: z[1] IS DISTINCT FROM z[2]), TRUE), 0) - 1)::BIGINT AS first_diff
FROM documents a JOIN (SELECT doc_id, text, min(doc_id) OVER (PARTITION BY lang) AS head FROM documents) h ON a.doc_id = h.doc_id JOIN documents b ON b.doc_id = h.head WHERE a.text IS NOT NULL AND b.text IS NOT NULL""")
def first_diff(spark, sf_dir):
    return _beside_heads(_docs(spark, sf_dir)).select("doc_id", X.first_difference("text", "head").alias("first_diff"))


@query("""SELECT doc_id, (CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END)::BIGINT AS tokens, CASE WHEN length(text) <= 400 THEN text ELSE '[…truncated for API context limit…]' || chr(10) || right(text, 364) END AS tail,
 substr(regexp_replace(source || '/' || doc_id || '\\x.py', '[/\\\\]', '_', 'g'), 1, 80) AS flat FROM documents""")
def prompt_helpers(spark, sf_dir):
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("\\x.py"))
    return _docs(spark, sf_dir).select("doc_id", X.rough_tokens("text").alias("tokens"), X.trim_tail("text", 400).alias("tail"), X.flat_name(path).alias("flat"))


_FENCED = "CASE turn % 3 WHEN 0 THEN 'So:' || chr(10) || '```python' || chr(10) || 'x = 1' || chr(10) || '```' || chr(10) || '```' || chr(10) || text || ' ' || chr(10) || '```' WHEN 1 THEN '  ' || text || chr(10) ELSE text END"
_TRIMMED = "regexp_replace({0}, '^[\\s\\p{{Z}}\\x{{85}}\\x{{0B}}]+|[\\s\\p{{Z}}\\x{{85}}\\x{{0B}}]+$', '', 'g')"


@query(f"""WITH t AS (SELECT conv_id, turn, role, {_TRIMMED.format(_FENCED)} AS t FROM conversations), f AS (SELECT *, regexp_extract_all(t, '(?is)```(?:python|py)?\\s*\\n(.*?)```', 1) AS l FROM t)
SELECT conv_id, turn, role, CASE WHEN len(l) > 0 THEN {_TRIMMED.format("list_reduce(list_prepend('', l), lambda a, x: CASE WHEN length(x) > length(a) THEN x ELSE a END)")} ELSE t END AS code FROM f""")
def markdown_code_extract(spark, sf_dir):
    k = F.col("turn") % 3
    fenced = F.when(k == 0, F.concat(F.lit("So:\n```python\nx = 1\n```\n```\n"), "text", F.lit(" \n```"))).when(k == 1, F.concat(F.lit("  "), "text", F.lit("\n"))).otherwise(F.col("text"))
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", X.code_of_markdown(fenced).alias("code"))


@query("""SELECT doc_id, CASE WHEN d >= 0 THEN substr(text, greatest(0, d - 20) + 1, d - greatest(0, d - 20) + 20) END AS context FROM (
SELECT a.doc_id, a.text, coalesce(list_position(list_transform(list_zip(string_split(a.text, ''), string_split(b.text, '')), lambda z: z[1] IS DISTINCT FROM z[2]), TRUE), 0) - 1 AS d
FROM documents a JOIN (SELECT doc_id, min(doc_id) OVER (PARTITION BY lang) AS head FROM documents) h ON a.doc_id = h.doc_id JOIN documents b ON b.doc_id = h.head WHERE a.text IS NOT NULL AND b.text IS NOT NULL)""")
def first_diff_context(spark, sf_dir):
    rows = _beside_heads(_docs(spark, sf_dir)).withColumn("at", X.first_difference("text", "head"))
    return rows.select("doc_id", X.around("text", "at").alias("context"))


# ---- files of a corpus ---------------------------------------------------------------------------------------

_LENGTHS = f"SELECT {_PATH} AS path, strlen(text)::BIGINT AS length FROM documents"


def _sized(spark, sf_dir):
    return _files(_docs(spark, sf_dir)).select("path", F.octet_length("text").cast("long").alias("length"))


@query(f"SELECT path, length, lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS kind FROM ({_LENGTHS}) WHERE lower(path[-3:]) IN ('.py', '.md') AND length BETWEEN 200 AND 200000 ORDER BY sha256('7:' || path), path LIMIT 60")
def holdout_files(spark, sf_dir):
    return corpus.holdout(_sized(spark, sf_dir), (".py", ".md"), 60, 7)


@query(f"SELECT path, length FROM ({_LENGTHS}) WHERE lower(path[-3:]) = '.py' ORDER BY path LIMIT 100")
def gathered_files(spark, sf_dir):
    return corpus.gathered(_sized(spark, sf_dir), (".py",), 100)


# ---- sequences of ids ----------------------------------------------------------------------------------------

# ids that both sides can make: the lengths of words
_IDS = "list_transform(string_split({0}, ' '), lambda w: length(w))"


def _ids(text):
    return F.transform(F.split(text, " "), lambda w: F.length(w))


def _shown(*names):
    return [F.array_join(F.col(n), ",").alias(n) for n in names]


@query(f"""SELECT doc_id, array_to_string(list_concat(i, list_transform(range(len(i), 48), lambda x: 0)), ',') AS ids, array_to_string(list_transform(range(48), lambda x: (x < len(i))::INTEGER), ',') AS mask,
 array_to_string(list_concat(list_transform(range(len(e), 48), lambda x: 0), e), ',') AS ends FROM (SELECT doc_id, l[1:40] AS i, l[greatest(1, len(l) - 39):len(l)] AS e FROM (SELECT doc_id, {_IDS.format("text")} AS l FROM documents WHERE text IS NOT NULL))""")
def padded_sequences(spark, sf_dir):
    ids, end = batch.truncated(_ids("text"), 40), batch.truncated(_ids("text"), 40, "left")
    rows = _docs(spark, sf_dir).filter("text IS NOT NULL").select("doc_id", batch.padded(ids, 48, 0).alias("ids"), batch.attention_mask(ids, 48).alias("mask"), batch.padded(end, 48, 0, "left").alias("ends"))
    return rows.select("doc_id", *_shown("ids", "mask", "ends"))


@query(f"""WITH p AS (SELECT doc_id, {_IDS.format("text")} AS a, CASE WHEN doc_id % 5 > 0 THEN {_IDS.format("repeat(lang || ' ' || source || ' ', 1 + (doc_id % 9)::INTEGER)")} END AS b FROM documents WHERE text IS NOT NULL),
 n AS (SELECT *, len(a) AS na, coalesce(len(b), 0) AS nb, greatest(0, len(a) + coalesce(len(b), 0) - 24) AS over FROM p),
 c AS (SELECT *, least(over, abs(na - nb)) AS lead FROM n),
 t AS (SELECT doc_id, a[1:na - (CASE WHEN na > nb THEN lead ELSE 0 END + (over - lead) // 2)] AS a, b[1:nb - (CASE WHEN nb > na THEN lead ELSE 0 END + (over - lead + 1) // 2)] AS b FROM c)
SELECT doc_id, array_to_string(list_concat([101], a, CASE WHEN b IS NULL THEN [] ELSE list_concat([102], b) END, [102]), ',') AS ids,
 array_to_string(list_concat(list_transform(range(len(a) + CASE WHEN b IS NULL THEN 2 ELSE 2 END), lambda x: 0), CASE WHEN b IS NULL THEN [] ELSE list_transform(range(len(b) + 1), lambda x: 1) END), ',') AS types FROM t""")
def pair_sequences(spark, sf_dir):
    second = F.when(F.col("doc_id") % 5 > 0, _ids(F.repeat(F.concat("lang", F.lit(" "), "source", F.lit(" ")), (1 + F.col("doc_id") % 9).cast("int"))))
    rows = _docs(spark, sf_dir).filter("text IS NOT NULL").select("doc_id", _ids("text").alias("a"), second.alias("b"))
    a, b = batch.pair_truncated("a", F.coalesce("b", F.array().cast("array<int>")), 24)
    cut = rows.select("doc_id", a.alias("a"), F.when(F.col("b").isNotNull(), b).alias("b"))
    return cut.select("doc_id", batch.joined("a", "b", (101,), (102,), (102,)).alias("ids"), batch.type_ids("a", "b", 1, 1, 1).alias("types")).select("doc_id", *_shown("ids", "types"))


@query(f"""SELECT doc_id, n_different FROM (SELECT doc_id, len(list_filter(list_zip({_IDS.format("text")}, {_IDS.format("replace(text, 'the', 'a')")}), lambda z: z[1] IS DISTINCT FROM z[2]))::BIGINT AS n_different FROM documents WHERE text IS NOT NULL) WHERE n_different > 0""")
def id_differences(spark, sf_dir):
    docs = _docs(spark, sf_dir).filter("text IS NOT NULL")
    return baseline.id_differences(docs, _ids("text"), _ids(F.replace("text", F.lit("the"), F.lit("a"))))


@query("SELECT doc_id, coalesce(text, '') AS text FROM documents")
def bpe_decoded_by_join(spark, sf_dir):
    codec = _codec(spark, sf_dir)
    vocabulary = spark.createDataFrame(codec.vocabulary.rows(), "id int, token string, kind string")
    back = bpe.decoded_by_join(_docs(spark, sf_dir).select("doc_id", codec.encode_column("text").alias("ids")), vocabulary)
    return back.select("doc_id", mapping.restored("text", codec.words).alias("text"))


@query("SELECT tokenizer, count(*)::BIGINT AS n_files, sum(strlen(text))::BIGINT AS n_bytes, sum(CASE tokenizer WHEN 'bytes' THEN strlen(text) ELSE length(text) END)::BIGINT AS n_tokens, count(*)::BIGINT AS n_exact FROM documents, (VALUES ('bytes'), ('chars')) t(tokenizer) WHERE text IS NOT NULL GROUP BY tokenizer")
def baseline_benchmark(spark, sf_dir):
    records = baseline.benchmark(_docs(spark, sf_dir), [baseline.raw_bytes(), baseline.characters()])
    names = ("tokenizer", "n_files", "n_bytes", "n_tokens", "n_exact")
    return spark.createDataFrame([tuple(r[n] for n in names) for r in records], "tokenizer string, n_files long, n_bytes long, n_tokens long, n_exact long")
