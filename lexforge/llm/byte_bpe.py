"""Byte-level BPE in DuckDB, inside each partition.

Encoding: the distinct pieces of a stretch of texts become token-position rows. A recursive query joins neighbours with the
merge table and contracts each piece's leftmost pair of least rank, until no piece has a pair left; rows of pieces that are done leave the
recursion. Decoding: token rows join the vocabulary, and an ordered aggregate puts the bytes together.

Contracting one pair a round takes a piece as many rounds as it has merges. In pieces longer than any token, pairs far apart are contracted
in the same round: what isn't within a token's length of a pair can't touch it before it is contracted, so a pair that comes first within
that stretch comes before all that could change it. A run of equal pairs (one letter many times) is contracted in one round as well, every second pair
from its left end, unless a pair of lower rank would arise in that piece; then only strictly first pairs are. The ids are those of one pair at a time.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from lexforge.llm.shared import chunks, table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
#: Bytes of pieces that are contracted together, and ids that are decoded together.
BYTES = 1_000_000
DECODED = 400_000
#: Bytes that a process keeps of pieces it has encoded.
KNOWN_BYTES = 256_000_000

CONTRACT = """
WITH RECURSIVE step(w, pos, tok, nxt, live) AS (
  SELECT w, pos, tok, nxt, true FROM start
  UNION ALL
  SELECT w, pos, CASE WHEN key = best THEN (key >> 20)::INTEGER ELSE tok END,
      CASE WHEN key = best THEN beyond WHEN after = best THEN (after >> 20)::INTEGER ELSE nxt END, best IS NOT NULL
  FROM (
    SELECT *, min(key) OVER (PARTITION BY w ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS best,
        lag(key) OVER p AS before, lead(key) OVER p AS after, lead(nxt, 1, -1) OVER p AS beyond
    FROM (SELECT s.w, s.pos, s.tok, s.nxt, (m.merged::BIGINT << 20) + s.pos AS key
          FROM (SELECT * FROM step WHERE live) s LEFT JOIN merges m ON m.pair = s.tok::BIGINT * 16777216 + s.nxt)
    WINDOW p AS (PARTITION BY w ORDER BY pos))
  WHERE best IS NULL OR before IS DISTINCT FROM best)
SELECT w, pos, tok FROM step WHERE NOT live ORDER BY w, pos
"""
CONTRACT_FAR = """
WITH RECURSIVE step(w, pos, tok, live) AS (
  SELECT w, pos, tok, true FROM start
  UNION ALL
  SELECT w, pos, CASE WHEN pick THEN rank ELSE tok END, alive
  FROM (
    SELECT *, lag(pick, 1, false) OVER (PARTITION BY w ORDER BY pos) AS gone FROM (
      SELECT *, CASE WHEN bool_or(lower) OVER (PARTITION BY w) THEN coalesce(key = lowest, false) ELSE even END AS pick FROM (
        SELECT e.*, even AND coalesce(least(a.merged, b.merged, c.merged) < rank, false) AS lower FROM (
          SELECT *, coalesce(fit AND (nr - began) % 2 = 0 AND sum(CASE WHEN fit THEN 0 ELSE 1 END) OVER (PARTITION BY w, began ORDER BY pos) = 0, false) AS even FROM (
            SELECT *, max(CASE WHEN fresh THEN nr END) OVER (PARTITION BY w ORDER BY pos) AS began, coalesce(rank = lowest >> 40, false) AS fit FROM (
              SELECT *, min(key) OVER (PARTITION BY w ORDER BY pos RANGE BETWEEN $reach PRECEDING AND 2 * $reach FOLLOWING) AS lowest,
                  bool_or(key IS NOT NULL) OVER (PARTITION BY w) AS alive, row_number() OVER p AS nr, rank IS DISTINCT FROM lag(rank) OVER p AS fresh
              FROM (SELECT s.*, m.merged AS rank, (m.merged::BIGINT << 40) + s.pos AS key
                    FROM (SELECT w, pos, tok, lead(tok) OVER n AS nxt, lead(tok, 2) OVER n AS beyond, lag(tok) OVER n AS prior FROM step WHERE live WINDOW n AS (PARTITION BY w ORDER BY pos)) s
                    LEFT JOIN merges m ON m.pair = s.tok::BIGINT * 16777216 + s.nxt)
              WINDOW p AS (PARTITION BY w ORDER BY pos)))) e
        LEFT JOIN merges a ON even AND a.pair = e.prior::BIGINT * 16777216 + e.rank
        LEFT JOIN merges b ON even AND b.pair = e.rank::BIGINT * 16777216 + e.beyond
        LEFT JOIN merges c ON even AND c.pair = e.rank::BIGINT * 16777216 + e.rank)))
  WHERE NOT gone)
SELECT w, pos, tok FROM step WHERE NOT live ORDER BY w, pos
"""
JOINED = "SELECT d, string_agg(s, '' ORDER BY pos) AS s FROM ids JOIN vocab USING (id) GROUP BY d ORDER BY d"


class DuckBpe:
    """A vocabulary of ranks (bytes to id); the rank of a pair is the id of its concatenation."""

    def __init__(self, path: str = RANKS, pattern: str = PATTERN, bound: int = KNOWN_BYTES):
        import duckdb

        self.split = regex.compile(pattern).findall
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        self.bound = bound
        with open(path, "rb") as lines:
            self.load({base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())})

    def load(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.longest = max(map(len, ranks))
        find = ranks.get
        merges = [(a * 16777216 + b, m) for t, m in ranks.items() for k in range(1, len(t)) if (a := find(t[:k])) is not None and (b := find(t[k:])) is not None]
        self.con.register("given", pa.table({"pair": pa.array([a for a, _ in merges], pa.int64()), "merged": pa.array([m for _, m in merges], pa.int32())}))
        self.con.execute("CREATE OR REPLACE TABLE merges AS SELECT * FROM given")
        self.con.register("given", pa.table({"id": pa.array(ranks.values(), pa.int32()), "s": [b.decode("latin-1") for b in ranks]}))
        self.con.execute("CREATE OR REPLACE TABLE vocab AS SELECT * FROM given")
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.held = 0

    def contract(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of pieces, as unsigned 32-bit integers, by a recursive query. Pieces are longer than any token, or none is."""
        n = np.array([len(p) for p in pieces])
        ends = np.cumsum(n)
        tok = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        nxt = np.append(tok[1:], np.int32(-1))
        nxt[ends - 1] = -1
        self.con.register("start", pa.table({"w": np.repeat(np.arange(len(pieces), dtype=np.int32), n), "pos": np.arange(ends[-1]) - np.repeat(ends - n, n), "tok": tok, "nxt": nxt}))
        far = n.max() > self.longest
        got = self.con.execute(CONTRACT_FAR.replace("$reach", str(self.longest)) if far else CONTRACT).fetchnumpy()
        ids = got["tok"].astype("<u4").tobytes()
        cuts = (4 * np.searchsorted(got["w"], np.arange(len(pieces) + 1))).tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def learn(self, words: set[str]) -> None:
        """Make words known. Half of what is kept is of words used of late; the other half goes when that is full."""
        if self.held > self.bound // 2:
            self.before, self.known, self.held = self.known, {}, 0
        short: list[tuple[str, bytes]] = []
        far: list[tuple[str, bytes]] = []
        for w in words - self.known.keys():
            if (ids := self.before.get(w)) is not None:
                self._keep(w, ids)
                continue
            b = w.encode()
            if (rank := self.ranks.get(b)) is not None:
                self._keep(w, rank.to_bytes(4, "little"))
            else:
                (far if len(b) > self.longest else short).append((w, b))
        for some in (short, far):
            while some:
                n = 1 + int(np.searchsorted(np.cumsum([len(b) for _, b in some]), BYTES))
                for (w, _), ids in zip(some, self.contract([b for _, b in some[:n]]), strict=False):
                    self._keep(w, ids)
                some = some[n:]

    def _keep(self, word: str, ids: bytes) -> None:
        self.known[word] = ids
        self.held += 200 + 2 * len(word) + len(ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.split(t) for t in texts]
        self.learn({w for words in split for w in words})
        find = self.known.__getitem__
        return [b"".join(map(find, words)) for words in split]

    def decode(self, ids: list[bytes]) -> Iterator[Iterator[bytes]]:
        """The bytes of each sequence of ids, in stretches of at most DECODED ids."""
        slices = [(i, x[4 * k : 4 * (k + DECODED)]) for i, x in enumerate(ids) for k in range(0, max(1, len(x) // 4), DECODED)]
        done: dict[int, list[bytes]] = {i: [] for i in range(len(ids))}
        while slices:
            n = held = 0
            while n < len(slices) and (not n or held + len(slices[n][1]) <= 4 * DECODED):
                held += len(slices[n][1])
                n += 1
            some, slices = slices[:n], slices[n:]
            sizes = np.array([len(x) // 4 for _, x in some])
            starts = np.cumsum(sizes) - sizes
            self.con.register("ids", pa.table({"d": np.repeat(np.arange(n, dtype=np.int32), sizes), "pos": np.arange(sizes.sum()) - np.repeat(starts, sizes), "id": np.frombuffer(b"".join(x for _, x in some), "<u4").astype(np.int32)}))
            for d, s in self.con.execute(JOINED).fetchall():
                done[some[d][0]].append(s.encode("latin-1"))
        return (iter(done[i]) for i in range(len(ids)))


_bpe: dict[tuple[str, str], DuckBpe] = {}


def _digests(batches: Iterator[pa.RecordBatch], path: str, pattern: str, whole: bool) -> Iterator[pa.RecordBatch]:
    bpe = _bpe.get((path, pattern)) or _bpe.setdefault((path, pattern), DuckBpe(path, pattern))
    for batch in chunks(batches):
        ids = bpe.encode([t or "" for t in batch.column("text").to_pylist()])
        decoded = []
        for parts in bpe.decode(ids):
            h = hashlib.sha256()
            for p in parts:
                h.update(p)
            decoded.append(h.hexdigest())
        columns = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids]), "decoded_sha256": pa.array(decoded)}
        if whole:
            columns["ids"] = pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def encoded(docs: DataFrame, path: str = RANKS, pattern: str = PATTERN, ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids of every row of ``docs``.

    A null text is an empty one: no ids. Null and repeated doc_ids stay as they are, row by row; other columns are left out; an empty
    table gives no rows. Rows don't move between tasks.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(lambda b: _digests(b, path, pattern, ids), schema)


def op7_duckdb_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), ids=False)
