"""Hierarchical residual packing of token sequences.

Each input partition is tokenised and packed best-fit, longest pieces first, where it lies. Sequences that are nearly full
are final. The others go up a tree as items: groups of partitions pack them best-fit again, until one group is left. So a task never holds more than its own partition, or the few sequences that
its children could not fill; what moves between tasks are sizes, not tokens.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm.shared import chunks, span_hashes, table, written

CAPACITY = 2048
FAN_IN = 16
SLACK = 16
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Bytes that a process keeps of words it has encoded, and words encoded in one call.
KNOWN_BYTES = 32_000_000
SLICE = 20_000
#: Bytes of text that a worker looks at together.
CHUNK = 1 << 20
BROADCAST_BINS = 1 << 18
#: Open sequences that a node sends up at most, the emptiest; its others are final as they are. It matters only where texts are such that few fit together.
OPEN = 1 << 16


class WordTokenizer:
    """The ids of whole texts as bytes (unsigned 32-bit, little-endian), then id 0.

    The tokenizer splits a text into words that it encodes one by one, so a word is encoded once and looked up after that.
    That way is taken for texts whose characters are printable Latin-1 or plain white space, where lower case and
    normal form are the same in Python and in the tokenizer; other texts are encoded whole. Words are found, told apart (by two
    hashes of 64 bits) and replaced by their ids in arrays; Python strings are made of new words only. What is known of words
    takes ``bound`` bytes at most, whatever the texts are.
    """

    plain = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xff]*\Z")
    letters = "abcdefghijklmnopqrstuvwxyz\xaa\xb5\xba" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
    digits = "0123456789\xb2\xb3\xb9\xbc\xbd\xbe"
    #: What may follow an apostrophe that starts a word.
    shortened = ("s", "t", "re", "ve", "m", "ll", "d")

    def __init__(self, path: str, bound: int = KNOWN_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.bound = bound
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.kind = np.full(256, 3, np.uint8)  # 0: white space, 1: letters, 2: digits, 3: all else
        self.kind[[9, 10, 13, 32]] = 0
        self.kind[list(self.letters.encode("latin-1"))] = 1
        self.kind[list(self.digits.encode("latin-1"))] = 2
        self.forget()

    def forget(self) -> None:
        self.hash, self.check, self.at, self.n = (np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int32))
        self.flat = np.zeros(0, "<u4")

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def words(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the words of Latin-1 in lower case, white space at its end, start and end."""
        kind = self.kind[code]
        start = np.append(True, kind[1:] != kind[:-1]) | (kind == 2)
        mark = np.flatnonzero((code[:-1] == 39) & start[:-1])
        one, two = code[np.minimum(mark + 1, len(code) - 1)], code[np.minimum(mark + 2, len(code) - 1)]
        size = np.zeros(len(mark), np.int64)
        for s in self.shortened:
            size[(one == ord(s[0])) & ((len(s) == 1) | (two == ord(s[-1])))] = 1 + len(s)
        mark, size = mark[size > 0], size[size > 0]
        start[mark + 1] = False
        after = mark + size
        start[after[kind[after] == 1]] = True
        inside = kind != 0
        return np.flatnonzero(start & inside), np.flatnonzero(inside & np.append(start[1:] | ~inside[1:], True)) + 1

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and how many each has. Lines of some words are encoded; an id that ends a word tells whose it is."""
        flat, sizes = [], []
        for lo in range(0, len(words), SLICE):
            some = words[lo : lo + SLICE]
            lines = ["\n".join(some[k : k + 50]) for k in range(0, len(some), 50)]
            ids = np.concatenate([np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)])
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(some) or ends[-1] != len(ids):
                each = [self.whole(w) for w in some]
                ids, ends = np.concatenate(each), np.cumsum([len(x) for x in each])
            flat.append(ids), sizes.append(np.diff(ends, prepend=0))
        return np.concatenate(flat), np.concatenate(sizes)

    def find(self, h: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words are among those known, and whether they are."""
        at = np.minimum(np.searchsorted(self.hash, h), max(0, len(self.hash) - 1))
        return at, (self.hash[at] == h) & (self.check[at] == check) if len(self.hash) else np.zeros(len(h), bool)

    def learn(self, h: np.ndarray, check: np.ndarray, text_of) -> None:
        """Make the distinct words of h known."""
        new = np.flatnonzero(~self.find(h, check)[1])
        if len(self.flat) * 4 + (len(self.hash) + len(new)) * 32 > self.bound:
            self.forget()
            new = np.arange(len(h))
        if not len(new):
            return
        ids, n = self.encode_words([text_of(i) for i in new])
        keep = ~np.isin(self.hash, h[new])  # of two words of one hash the newer is known
        hashes = np.append(self.hash[keep], h[new])
        order = np.argsort(hashes, kind="stable")
        self.hash, self.check = hashes[order], np.append(self.check[keep], check[new])[order]
        self.at, self.n = np.append(self.at[keep], len(self.flat) + np.cumsum(n) - n)[order], np.append(self.n[keep], n).astype(np.int32)[order]
        self.flat = np.append(self.flat, ids)

    def many(self, texts: list[str]) -> list[np.ndarray]:
        """As many texts as fit in memory with their words."""
        plain = [k for k, t in enumerate(texts) if self.plain.match(t)]
        out: list = [None] * len(texts)
        if plain:
            joined = "\n".join([*(texts[k].lower() for k in plain), ""]).encode("latin-1")
            code = np.frombuffer(joined, np.uint8)
            start, end = self.words(code)
            if len(start):
                h, check = span_hashes(code, start, end), span_hashes(code, start, end, 1)
                one, first, which = np.unique(h, return_index=True, return_inverse=True)
                self.learn(one, check[first], lambda i: joined[start[first[i]] : end[first[i]]].decode("latin-1"))
                at = self.find(one, check[first])[0][which]
                n = self.n[at].astype(np.int64)
                before = np.cumsum(n) - n
                ids = self.flat[np.repeat(self.at[at] - before, n) + np.arange(n.sum())]
                alike = check == check[first][which]
            else:
                n = before = np.zeros(0, np.int64)
                ids, alike = np.zeros(0, "<u4"), np.ones(0, bool)
            stops = np.append(0, np.cumsum([len(texts[k]) + 1 for k in plain]))
            cuts = np.searchsorted(start, stops)
            edges = np.append(before, n.sum())[cuts]
            for k, a, b, u, v in zip(plain, edges[:-1], edges[1:], cuts[:-1], cuts[1:], strict=True):
                if alike[u:v].all():
                    out[k] = np.append(ids[a:b], np.uint32(0))
        return [np.append(self.whole(t), np.uint32(0)) if x is None else x for x, t in zip(out, texts, strict=True)]

    def ids(self, text: str) -> bytes:
        return self.many([text])[0].astype("<u4").tobytes()


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer_of(path: str) -> WordTokenizer:
    """One for each process, whatever tasks it runs."""
    return _tokenizers.get(path) or _tokenizers.setdefault(path, WordTokenizer(path))


def best_fit(sizes, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(bin, offset) of each item and the fill of each bin. Longest first; a bin with the least room that is enough takes the item.

    Rooms are small integers: bins of a room lie on a stack, and a bit mask finds the next room.
    """
    sizes = np.asarray(sizes, np.int64)
    bin_of, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    fill: list[int] = []
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i in np.argsort(-sizes, kind="stable"):
        n = int(sizes[i])
        high = mask >> n
        if high:
            room = n + ((high & -high).bit_length() - 1)
            b = stacks[room].pop()
            if not stacks[room]:
                mask &= ~(1 << room)
        else:
            b, room = len(fill), capacity
            fill.append(0)
        bin_of[i], offset[i] = b, fill[b]
        fill[b] += n
        if room > n:
            stacks[room - n].append(b)
            mask |= 1 << (room - n)
    return bin_of, offset, fill


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long"


def _pack_partition(batches: Iterator[pa.RecordBatch], path: str, capacity: int) -> Iterator[pa.RecordBatch]:
    tokenizer = tokenizer_of(path)
    docs, piece, start, length, crc = array("q"), array("i"), array("q"), array("q"), array("q")
    nulls: list[int] = []
    for batch in chunks(batches, CHUNK):
        for doc, ids in zip(batch.column("doc_id").to_pylist(), tokenizer.many([t or "" for t in batch.column("text").to_pylist()]), strict=True):
            for k in range(0, len(ids), capacity):
                part = ids[k : k + capacity]
                if doc is None:
                    nulls.append(len(docs))
                docs.append(doc or 0), piece.append(k // capacity), start.append(k), length.append(len(part)), crc.append(zlib.crc32(part.tobytes()))
    bins, offsets, fill = best_fit(length, capacity)
    first = TaskContext.get().partitionId() << 36
    unknown = np.zeros(len(docs), bool)
    unknown[nulls] = True
    fill = np.array(fill, np.int64)
    for lo in range(0, len(docs), 50_000):
        cut = slice(lo, lo + 50_000)
        columns = [pa.array(np.asarray(docs[cut]), pa.int64(), mask=unknown[cut]), *(pa.array(np.asarray(x[cut])) for x in (piece, start, length, crc)), pa.array(bins[cut] + first), pa.array(offsets[cut]), pa.array(fill[bins[cut]])]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "fill"])


def _merge(group: pa.Table, capacity: int, slack: int, most: int = OPEN) -> pa.Table:
    group = group.sort_by([("fill", "descending"), ("bin", "ascending")])
    own = group.column("bin").to_numpy()
    bins, offsets, fill = best_fit(group.column("fill").to_numpy(), capacity)
    fill, head = np.array(fill, np.int64), np.zeros(len(fill), np.int64)
    head[bins[::-1]] = own[::-1]  # a sequence is named after its first item
    still = np.zeros(len(fill), bool)
    still[np.argsort(fill, kind="stable")[:most]] = True
    still &= fill < capacity - slack
    return pa.table({"bin": own, "head": head[bins], "shift": offsets, "full": fill[bins], "open": still[bins] & (own == head[bins])})


def packed(docs: DataFrame, capacity: int = CAPACITY, path: str = TOKENIZER, fan_in: int = FAN_IN, slack: int = SLACK) -> DataFrame:
    """One row for each piece of each document: doc_id, piece, start, length, ids_crc32, sequence_id and offset.

    A null text is an empty one, which is the id 0 alone. Null and repeated doc_ids are packed as documents of their own. An empty
    table gives no rows. Texts of more than ``capacity`` ids are cut into pieces, the last of which may be shorter.
    """
    spark = docs.sparkSession
    pieces = written(docs.select("doc_id", "text").mapInArrow(lambda b: _pack_partition(b, path, capacity), _PIECES), "pieces")
    # the tree: a level merges the open sequences of fan_in nodes; few are left open after it
    left = pieces.filter(F.col("fill") < capacity - slack).select("bin", "fill").distinct()
    node = F.shiftright("bin", 36)
    level, moves, nodes = 0, None, 2
    while nodes > 1:
        level += 1
        grouped = left.withColumn("node", F.floor(node / fan_in**level)).groupBy("node")
        step = written(grouped.applyInArrow(lambda g: _merge(g, capacity, slack), "bin long, head long, shift long, full long, open boolean"), "merges")
        if moves is None:
            moves = step
        else:
            up = step.select(F.col("bin").alias("head"), F.col("head").alias("__head"), F.col("shift").alias("__shift"))
            up = up.filter("head <> __head OR __shift <> 0")
            moves = written(moves.join(up, "head", "left").select("bin", F.coalesce("__head", "head").alias("head"), (F.col("shift") + F.coalesce("__shift", F.lit(0))).alias("shift")), "moves")
        left = step.filter("open").select("bin", F.col("full").alias("fill"))
        nodes = left.select(F.floor(node / fan_in**level).alias("n")).agg(F.count_distinct("n")).first()[0]
    moves = moves.filter("bin <> head OR shift <> 0").select("bin", "head", "shift")
    moves = F.broadcast(moves) if moves.count() <= BROADCAST_BINS else moves
    out = pieces.join(moves, "bin", "left")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("head", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))


def op9_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
