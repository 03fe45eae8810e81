"""Byte-level BPE: learning merges, encoding, decoding, and the audit of merges.

Pieces are counted in Spark and stay there. Merges are learnt on the driver over the stretches of distinct pieces within which all pairs are
frequent: as many merges as DRIVER_TOKENS tokens of such stretches tell of, then again over the pieces as they have become.
Of equally frequent pairs the one of smallest ids is merged first.
"""

from __future__ import annotations

import heapq
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.functions import batches as A
from lexforge.functions import patterns as P
from lexforge.functions import text as X

#: What the driver learns from at once: tokens of distinct stretches, and the most frequent pairs.
DRIVER_TOKENS, DRIVER_PAIRS = 1 << 20, 1 << 18
#: Tokens that a worker has in arrays at once.
WORKER_TOKENS = 1 << 19
#: Rounds after which pieces are merged from the start again, so that plans stay short.
DEPTH = 10
#: Pieces that a codec keeps with their ids, and how long they may be.
KEPT, KEPT_CHARS = 1 << 18, 64
_TABLE = P.byte_table()
_BYTE = {c: b for b, c in enumerate(_TABLE)}
_pieces = regex.compile(P.PIECES.removeprefix("(?U)"))


def _private(token: str) -> bool:
    return len(token) == 1 and any(a <= ord(token) <= b for a, b in P.PUA_RANGES)


def to_chars(data: bytes) -> str:
    return "".join(_TABLE[b] for b in data)


def to_bytes(token: str) -> bytes:
    return b"".join(bytes([_BYTE[c]]) if c in _BYTE else c.encode() for c in token)


def piece_counts(docs: DataFrame, text: Column | str = "text") -> DataFrame:
    """piece (byte-level) and n. Pieces are spelled once for each kind, after they are counted."""
    rows = docs.select(F.explode(X.pieces(text)).alias("raw")).groupBy("raw").agg(F.count("*").alias("n"))
    return rows.select(X.byte_level("raw").alias("piece"), "n")


@dataclass
class Vocabulary:
    """Ids of byte strings, and of tokens that are matched whole before all else."""

    ids: dict[bytes, int] = field(default_factory=dict)
    special: dict[str, int] = field(default_factory=dict)
    added: dict[str, int] = field(default_factory=dict)
    merges: list[tuple[bytes, bytes]] = field(default_factory=list)

    def __len__(self) -> int:
        return len(self.ids) + len(self.special) + len(self.added)

    def next_id(self) -> int:
        return 1 + max([-1, *self.ids.values(), *self.special.values(), *self.added.values()])

    def add(self, tokens: list[str]) -> int:
        """Adds tokens that are matched whole; how many were new."""
        new = [t for t in dict.fromkeys(tokens) if t and t not in self.added and t not in self.special]
        first = self.next_id()
        self.added.update({t: first + i for i, t in enumerate(new)})
        return len(new)

    def rows(self) -> list[tuple[int, str, str]]:
        kinds = ((self.special.items(), "special"), (((to_chars(b), i) for b, i in self.ids.items()), "bpe"))
        rows = [(i, t, k) for items, k in kinds for t, i in items]
        return sorted(rows + [(i, t, "pua" if _private(t) else "compound") for t, i in self.added.items()])

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame(self.rows(), "id int, token string, kind string").coalesce(1).write.mode("overwrite").parquet(f"{path}/vocab")
        merges = [(r, to_chars(a), to_chars(b)) for r, (a, b) in enumerate(self.merges)]
        spark.createDataFrame(merges, "rank int, left string, right string").coalesce(1).write.mode("overwrite").parquet(f"{path}/merges")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Vocabulary:
        out = cls()
        for r in spark.read.parquet(f"{path}/vocab").collect():
            if r["kind"] == "bpe":
                out.ids[to_bytes(r["token"])] = r["id"]
            else:
                (out.special if r["kind"] == "special" else out.added)[r["token"]] = r["id"]
        out.merges = [(to_bytes(r["left"]), to_bytes(r["right"])) for r in spark.read.parquet(f"{path}/merges").orderBy("rank").collect()]
        return out


def train(counts: DataFrame, size: int, min_frequency: int = 2, special: tuple[str, ...] = P.SPECIAL_TOKENS, alphabet: tuple[str, ...] = ()) -> Vocabulary:
    """A vocabulary of ``size`` ids at most from ``counts`` (piece, n): special tokens, bytes, further characters of ``alphabet``, merges."""
    room = size - len(special) - 256 - len(alphabet)
    if room < 0:
        raise ValueError(f"a vocabulary of {size} has no room for bytes and special tokens")
    out = Vocabulary(special={t: i for i, t in enumerate(special)})
    first = len(special)
    for c in sorted(_TABLE):
        out.ids[bytes([_BYTE[c]])] = first + len(out.ids)
    known = set(out.ids.values())
    for c in alphabet:
        out.ids[c.encode()] = first + len(out.ids)
    token_of, floor = {i: b for b, i in out.ids.items()}, max(1, min_frequency)
    rows = counts.select("piece", F.col("n").cast("long").alias("n")).mapInArrow(_to_ids({c: out.ids[bytes([_BYTE[c]])] for c in _TABLE}), _STATE).persist()
    pieces, made, depth = rows, [], 0
    try:
        size = rows.agg(F.sum(F.octet_length("ids"))).first()[0] or 0
        if size <= 4 * DRIVER_TOKENS:
            _learn(_Words(*_arrays(rows.toArrow())), out, token_of, room, floor)
            return out
        while len(out.merges) < room:
            pairs = rows.mapInArrow(_pair_counts, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).filter(F.col("n") >= floor)
            top = pairs.orderBy(F.desc("n"), "pair").limit(DRIVER_PAIRS + 1).toArrow()
            if not top.num_rows:
                break
            pair, n = (top.column(c).to_numpy() for c in ("pair", "n"))
            merges, last = _from_stretches(rows, pair, n, out, token_of, room, floor, known)
            if last or len(out.merges) >= room:
                break
            made, depth, done = made + merges, depth % DEPTH + 1, rows
            rows = (pieces if depth == 1 else rows).mapInArrow(_merging(made if depth == 1 else merges), _STATE).persist()
            rows.count()
            if done is not pieces:
                done.unpersist()
    finally:
        rows.unpersist()
        pieces.unpersist()
    return out


def _learn(words: _Words, out: Vocabulary, token_of: dict[int, bytes], room: int, floor: int, known: set[int] | None = None) -> tuple[list[tuple[int, int, int]], bool]:
    """The merges (left, right, new) that are made while pairs occur ``floor`` times at least, and whether it ended for want of such pairs.

    ``known``: ids that the pieces may hold. It ends after a merge that makes one of them in a second way.
    """
    first, made = len(out.special), []
    heap = [(-n, pair) for pair, n in words.count.items() if n >= floor]
    heapq.heapify(heap)
    while heap and len(out.merges) < room:
        n, pair = heapq.heappop(heap)
        if -n != (now := words.count.get(pair, 0)):
            if now > 0:
                heapq.heappush(heap, (-now, pair))
            continue
        if -n < floor:
            break
        new = _noted(pair, out, token_of, first)
        made.append((*pair, new))
        for p in words.merge(pair, new):
            if words.count.get(p, 0) > 0:
                heapq.heappush(heap, (-words.count[p], p))
        if known is not None:
            if new in known:
                return made, False
            known.add(new)
    return made, True


def _noted(pair: tuple[int, int], out: Vocabulary, token_of: dict[int, bytes], first: int) -> int:
    """The id that a merge makes, which is noted."""
    a, b = (token_of[i] for i in pair)
    new = out.ids.get(a + b)
    if new is None:
        new = first + len(out.ids)
        out.ids[a + b], token_of[new] = new, a + b
    out.merges.append((a, b))
    return new


def _from_stretches(rows: DataFrame, pair: np.ndarray, n: np.ndarray, out: Vocabulary, token_of: dict[int, bytes], room: int, floor: int, known: set[int]) -> tuple[list[tuple[int, int, int]], bool]:
    """The next merges, one at least, and whether there are no more. ``pair`` and ``n``: the most frequent pairs, best first.

    Pieces are cut where a pair occurs less than ``least`` times. Two tokens that meet there later occur together no more often than that pair,
    as each token is made of the same ones wherever it stands (``known`` sees to that). So until no pair in the stretches is as frequent as
    ``least``, the best pair in them is the best of all, and all its places are in them.
    """
    whole = len(n) <= DRIVER_PAIRS
    lowest = int(n[-1]) + (not whole)
    ladder = sorted({int(n[min(r, len(n)) - 1]) for r in (1 << np.arange(len(n).bit_length() + 1)).tolist()} | {lowest}, reverse=True)
    ladder = [t for t in ladder if lowest <= t <= n[0]]
    if ladder:
        hot = n >= lowest
        order = np.argsort(pair[hot])
        keys, level = pair[hot][order], np.searchsorted(-np.array(ladder), -n[hot][order]).astype(np.uint8)
        found = rows.mapInArrow(_stretch_sizes(keys, level, len(ladder)), "level int, hash long, size long").groupBy("level", "hash").agg(F.max("size").alias("size")).groupBy("level").agg(F.sum("size")).collect()
        sizes = {r[0]: r[1] * _SAMPLED for r in found}
        k = max([i for i in range(len(ladder)) if sizes.get(i, 0) <= DRIVER_TOKENS], default=0)
        while k >= 0:
            some = rows.mapInArrow(_stretches(keys[level <= k]), _STATE).groupBy("ids").agg(F.sum("n").alias("n")).persist()
            if some.agg(F.sum(F.octet_length("ids"))).first()[0] <= 8 * DRIVER_TOKENS:
                # no more pairs to come only if those that were cut are too rare to be merged
                least = floor if whole and k == len(ladder) - 1 else ladder[k]
                made, ended = _learn(_Words(*_arrays(some.toArrow())), out, token_of, room, least, known)
                some.unpersist()
                return made, ended and least == floor
            some.unpersist()
            k -= 1
    best = int(pair[0]) >> 32, int(pair[0]) & 0xFFFFFFFF
    new = _noted(best, out, token_of, len(out.special))
    known.add(new)
    return [(*best, new)], False


# ---- distinct pieces as ids, in Arrow batches ----------------------------------------------------------------

_STATE = "ids binary, n long"
#: One of so many stretches, by their hash, is counted to learn how many there are.
_SAMPLED = 16


def _arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids, how many each row has, and the rows' weights."""
    parts = [x or b"" for x in table.column("ids").to_pylist()]
    return np.frombuffer(b"".join(parts), "<i4").astype(np.int64), np.array([len(x) // 4 for x in parts], np.int64), table.column("n").to_numpy().astype(np.int64)


def _rows(tokens: np.ndarray, sizes: np.ndarray, weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Batches of the rows that have two ids at least."""
    data, ends = tokens.astype("<i4").tobytes(), np.cumsum(sizes) * 4
    keep = np.flatnonzero(sizes > 1)
    for at in range(0, len(keep), 10_000):
        some = keep[at : at + 10_000]
        ids = [data[e - 4 * s : e] for e, s in zip(ends[some].tolist(), sizes[some].tolist(), strict=True)]
        yield pa.record_batch([pa.array(ids, pa.binary()), pa.array(weights[some], pa.int64())], ["ids", "n"])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.column(0).nbytes // 4
        if n >= WORKER_TOKENS:
            yield _arrays(pa.Table.from_batches(held))
            held, n = [], 0
    if n:
        yield _arrays(pa.Table.from_batches(held))


def _to_ids(id_of: dict[str, int]):
    to = np.zeros(max(map(ord, id_of)) + 1, np.int64)
    to[[ord(c) for c in id_of]] = list(id_of.values())

    def ids(batches):
        for batch in batches:
            pieces = [p or "" for p in batch.column(0).to_pylist()]
            yield from _rows(to[np.frombuffer("".join(pieces).encode("utf-32-le"), "<u4")], np.array([len(p) for p in pieces], np.int64), batch.column(1).to_numpy())

    return ids


def _inner(tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pair that each token begins, and whether both are of one row; for all tokens but the last."""
    inside = np.ones(len(tokens), bool)
    inside[np.cumsum(sizes) - 1] = False
    return (tokens[:-1] << 32) | tokens[1:], inside[:-1]


def _pair_counts(batches):
    for tokens, sizes, weights in _chunks(batches):
        keys, inside = _inner(tokens, sizes)
        keys, n = keys[inside], np.repeat(weights, sizes)[:-1][inside]
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        yield pa.record_batch([pa.array(keys[cuts]), pa.array(np.add.reduceat(n[order], cuts))], ["pair", "n"])


def _merging(merges: list[tuple[int, int, int]]):
    def merged(batches):
        for tokens, sizes, weights in _chunks(batches):
            words = _Words(tokens, sizes, weights)
            for a, b, new in merges:
                if (a, b) in words.where:
                    words.merge((a, b), new)
            left = words.token >= 0
            ends = np.cumsum(sizes)
            have = np.cumsum(left)[ends - 1]
            yield from _rows(words.token[left], np.diff(have, prepend=0), weights)

    return merged


def _runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last token of each stretch of pairs."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    return edge[::2], edge[1::2]


def _found(keys: np.ndarray, tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in ``keys`` (in order) each pair is, and whether it is there."""
    pair, inside = _inner(tokens, sizes)
    at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
    return at, inside & (keys[at] == pair)


def _stretches(keys: np.ndarray):
    def cut(batches):
        for tokens, sizes, weights in _chunks(batches):
            first, last = _runs(_found(keys, tokens, sizes)[1])
            size = last - first + 1
            kept = np.zeros(len(tokens) + 1, np.int64)
            kept[first] += 1
            kept[last + 1] -= 1
            yield from _rows(tokens[np.cumsum(kept)[:-1] > 0], size, np.repeat(weights, sizes)[first])

    return cut


def _stretch_sizes(keys: np.ndarray, level: np.ndarray, levels: int):
    """For each level of pairs, some of the stretches that hold pairs up to it: hash and size."""
    mixer, back = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)

    def measured(batches):
        for tokens, sizes, _ in _chunks(batches):
            at, there = _found(keys, tokens, sizes)
            of = np.where(there, level[at], 255)
            power, inverse = (np.cumprod(np.append(np.uint64(1), np.full(len(tokens), m, np.uint64))) for m in (mixer, back))
            code = (tokens.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((code ^ (code >> np.uint64(29))) * power[:-1])))
            for k in range(levels):
                first, last = _runs(of <= k)
                h = (total[last + 1] - total[first]) * inverse[first]
                h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
                some = (h >> np.uint64(40)) % np.uint64(_SAMPLED) == 0
                h, pick = np.unique(h[some], return_index=True)
                size = (last - first + 1)[some][pick]
                yield pa.record_batch([pa.array(np.full(len(h), k, np.int32)), pa.array(h.view(np.int64)), pa.array(size)], ["level", "hash", "size"])

    return measured


class _Words:
    """Distinct pieces as one chain of tokens in arrays, how often each pair of neighbours occurs, and where."""

    def __init__(self, tokens: np.ndarray, size: np.ndarray, weights: np.ndarray):
        ends = np.cumsum(size)
        self.token, at = tokens.copy(), np.arange(len(tokens), dtype=np.int64)
        self.after, self.before = at + 1, at - 1
        self.after[ends[size > 0] - 1] = -1
        self.before[(ends - size)[size > 0]] = -1
        self.weight = np.repeat(weights, size)
        self.count: dict[tuple[int, int], int] = {}
        self.where: dict[tuple[int, int], list[np.ndarray]] = {}
        self._note(at[self.after >= 0])

    def _grouped(self, starts: np.ndarray) -> Iterator[tuple[tuple[int, int], int, np.ndarray]]:
        """The pairs that start at ``starts``: (pair, weight, where)."""
        if not len(starts):
            return
        keys = (self.token[starts] << 32) | self.token[self.after[starts]]
        order = np.argsort(keys, kind="stable")
        keys, starts = keys[order], starts[order]
        cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        sums = np.add.reduceat(self.weight[starts], cuts)
        for key, n, lo, hi in zip(keys[cuts].tolist(), sums.tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(keys)], strict=True):
            yield (key >> 32, key & 0xFFFFFFFF), n, starts[lo:hi]

    def _note(self, starts: np.ndarray) -> list[tuple[int, int]]:
        found = []
        for pair, n, where in self._grouped(starts):
            self.count[pair] = self.count.get(pair, 0) + n
            self.where.setdefault(pair, []).append(where)
            found.append(pair)
        return found

    def merge(self, pair: tuple[int, int], new: int) -> list[tuple[int, int]]:
        """Replace the pair everywhere, from the left; the pairs that this brings about."""
        at = np.unique(np.concatenate(self.where.pop(pair)))
        at = at[self.token[at] == pair[0]]
        at = at[self.after[at] >= 0]
        at = at[self.token[self.after[at]] == pair[1]]
        if pair[0] == pair[1] and len(at):  # of overlapping ones every second, from the left end of their run
            fresh = np.append(True, self.after[at[:-1]] != at[1:])
            run = np.flatnonzero(fresh)
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
        second = self.after[at]
        left, right = self.before[at], self.after[second]
        for p, n, _ in self._grouped(np.unique(np.concatenate([left[left >= 0], second[right >= 0]]))):
            self.count[p] -= n
        self.token[at], self.token[second] = new, -1
        self.after[at] = right
        self.before[right[right >= 0]] = at[right >= 0]
        self.count.pop(pair, None)
        left = self.before[at]
        return self._note(np.unique(np.concatenate([left[left >= 0], at[right >= 0]])))


def trie_pattern(tokens: list[str]) -> str:
    """A pattern that matches the longest of ``tokens``; tokens with a common start share it, so a match takes no longer with many of them."""
    root: dict = {}
    for t in tokens:
        node = root
        for c in t:
            node = node.setdefault(c, {})
        node[""] = {}

    def spell(node: dict) -> str:
        leaves = sorted(c for c, below in node.items() if c and below.keys() == {""})
        rest = [re.escape(c) + spell(below) for c, below in sorted(node.items()) if c and below.keys() != {""}]
        if leaves:
            rest.append("[" + "".join(map(re.escape, leaves)) + "]" if len(leaves) > 1 else re.escape(leaves[0]))
        if not rest:
            return ""
        return ("(?:" + "|".join(rest) + ")" if len(rest) > 1 or "" in node else rest[0]) + ("?" if "" in node else "")

    return spell(root)


_codecs: dict[str, Codec] = {}


class Codec:
    """Texts to ids and back. Added tokens are matched first, leftmost and longest; then pieces are merged by least id."""

    def __init__(self, vocabulary: Vocabulary, words: dict[str, str] | None = None):
        self.vocabulary, self.words = vocabulary, dict(words or {})
        self.whole = {**vocabulary.added, **vocabulary.special}
        self.name = uuid.uuid4().hex
        self.matcher = re.compile(trie_pattern(list(self.whole))) if self.whole else None
        self.bytes_of = {i: b for b, i in vocabulary.ids.items()} | {i: t.encode() for t, i in self.whole.items()}
        self.special_ids = set(vocabulary.special.values())
        self.back = {ord(c): w for w, c in self.words.items()}
        self.known: dict[str, list[int]] = {}

    def merged(self, piece: bytes) -> list[int]:
        """The ids of a piece: its pair of least id, the leftmost one, is merged until none is left."""
        ids = self.vocabulary.ids
        part = [piece[i : i + 1] for i in range(len(piece))]
        after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        alive, heap = [True] * len(part), []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(part) and (rank := ids.get(part[i] + part[after[i]])) is not None:
                heapq.heappush(heap, (rank, i, len(part[i]), len(part[after[i]])))

        for i in range(len(part)):
            offer(i)
        while heap:
            _, i, n, m = heapq.heappop(heap)
            j = after[i]
            if alive[i] and j < len(part) and (len(part[i]), len(part[j])) == (n, m):
                part[i] += part[j]
                alive[j], after[i] = False, after[j]
                if after[i] < len(part):
                    before[after[i]] = i
                offer(before[i]), offer(i)
        return [ids[p] for p, a in zip(part, alive, strict=True) if a]

    def _plain(self, text: str) -> list[int]:
        out: list[int] = []
        for piece in _pieces.findall(text):
            ids = self.known.get(piece)
            if ids is None:
                ids = self.merged(piece.encode())
                if len(piece) <= KEPT_CHARS:
                    if len(self.known) > KEPT:
                        self.known.clear()
                    self.known[piece] = ids
            out += ids
        return out

    def encode_substituted(self, text: str) -> list[int]:
        if not self.matcher:
            return self._plain(text)
        out, at = [], 0
        for m in self.matcher.finditer(text):
            out += self._plain(text[at : m.start()])
            out.append(self.whole[m.group()])
            at = m.end()
        return out + self._plain(text[at:])

    def decode(self, ids, skip_special: bool = False) -> str:
        """Ids that aren't in the vocabulary are left out."""
        data = b"".join(self.bytes_of.get(int(i), b"") for i in ids if not (skip_special and i in self.special_ids))
        return data.decode("utf-8", "replace").translate(self.back)

    def encode_column(self, text: Column | str) -> Column:
        from lexforge.operators.mapping import substituted

        A.bounded_batches()

        @F.pandas_udf("array<int>")
        def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            own = _codecs.setdefault(self.name, self)  # one for each process, with the pieces it has met
            for batch in batches:
                yield pd.Series([None if t is None else own.encode_substituted(t) for t in batch], dtype=object)

        return ids(substituted(text, self.words))

    def encode_words_column(self, words: Column | str) -> Column:
        """The ids of a text that is split already (an array of strings): those of its words, one after another."""
        A.bounded_batches()
        joined = F.transform(F.col(words) if isinstance(words, str) else words, lambda w: F.coalesce(w, F.lit("")))

        @F.pandas_udf("array<int>")
        def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            from lexforge.operators.mapping import substituted_text

            own = _codecs.setdefault(self.name, self)
            for batch in batches:
                yield pd.Series([None if ws is None else [i for w in ws for i in own.encode_substituted(substituted_text(w, own.words))] for ws in batch], dtype=object)

        return ids(joined)

    def tokens_to_text(self, tokens: list[str]) -> str:
        """From the spellings of tokens, as in the vocabulary's table, to text."""
        data = b"".join(t.encode() if t in self.whole else to_bytes(t) for t in tokens)
        return data.decode("utf-8", "replace").translate(self.back)

    def decode_column(self, ids: Column | str, skip_special: bool = False) -> Column:
        A.bounded_batches()

        @F.pandas_udf("string")
        def texts(batch: pd.Series) -> pd.Series:
            return pd.Series([None if x is None else self.decode(x, skip_special) for x in batch], dtype=object)

        return texts(ids)


def decoded_by_join(ids: DataFrame, vocabulary: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key`` and ``text`` of rows (key, ids), by joins alone: ids that the vocabulary (id, token, kind) lacks are left out.

    A vocabulary is bounded, so it is broadcast. Byte-level tokens are spelled back once for each id; others are as they are.
    """
    data = F.when(F.col("kind") == "bpe", X.raw_of_byte_level("token")).otherwise(F.encode("token", "UTF-8"))
    spelled = F.broadcast(vocabulary.select(F.col("id").alias("__id"), F.hex(data).alias("__hex")))
    rows = ids.select(key, F.posexplode_outer("ids").alias("__at", "__id")).join(spelled, "__id", "left")
    parts = F.array_sort(F.collect_list(F.when(F.col("__hex").isNotNull(), F.struct("__at", "__hex"))))
    return rows.groupBy(key).agg(F.decode(F.unhex(F.array_join(F.transform(parts, lambda p: p["__hex"]), "")), "UTF-8").alias("text"))


def without_special(vocabulary: Vocabulary, drop: Iterable[str]) -> Vocabulary:
    """The vocabulary without some of its added and special tokens; all other ids stay."""
    gone = set(drop)
    keep = lambda d: {t: i for t, i in d.items() if t not in gone}
    return Vocabulary(dict(vocabulary.ids), keep(vocabulary.special), keep(vocabulary.added), list(vocabulary.merges))


def private_use_merges(merges: DataFrame) -> DataFrame:
    """Merges (rank, left, right) both sides of which are a single private-use character."""
    return merges.filter(X.is_private_use("left") & X.is_private_use("right"))


def audited(merges: DataFrame, vocabulary: DataFrame, mapping: DataFrame, strict: bool = True) -> tuple[DataFrame, dict[str, int]]:
    """``merges`` without those of two private-use characters (if strict), and the counts.

    Every mapped character must have an id of its own, in the vocabulary or among added tokens.
    """
    missing = mapping.select(F.col("pua").alias("token")).join(vocabulary, "token", "left_anti").count()
    if missing:
        raise ValueError(f"{missing} private-use characters have no id")
    found = private_use_merges(merges).count()
    kept = merges.filter(~(X.is_private_use("left") & X.is_private_use("right"))) if strict else merges
    return kept, {"found": found, "removed": found if strict else 0}


def vocabulary_hash(vocabulary: DataFrame) -> DataFrame:
    """One row: the hash of all ``id<tab>token`` lines by id. A vocabulary is bounded."""
    line = F.concat(F.col("id").cast("string"), F.lit("\t"), F.col("token"), F.lit("\n"))
    rows = F.array_sort(F.collect_list(F.struct(F.col("id").alias("id"), line.alias("line"))))
    return vocabulary.agg(F.sha2(F.array_join(F.transform(rows, lambda r: r["line"]), ""), 256).alias("vocab_hash"))
