"""Byte-level BPE encoding and decoding with two-tier lookup.

A pattern splits a text into pre-tokens. Tier one: a minimal perfect hash over the vocabulary (hash,
bucket, displacement; one slot per token, hits compared byte by byte) resolves pre-tokens that are
tokens themselves. Tier two: all others are merged by a heap over a linked list of their bytes, lowest
rank first and leftmost among equals. Both tiers work on the distinct pre-tokens of a slice: a bounded memo holds
what a pre-token was resolved to and answers for its later occurrences.

Defined results for odd input: null text counts as empty and gives no ids; ids decode to the very bytes
of the text; repeated rows are encoded each; an empty table gives an empty result; other columns are
carried or ignored as the caller chooses.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismflow import storage
from prismflow.llm import textkit as tk
from prismflow.llm.pool import Pool, file_digest, kept_in_worker

PER_BUCKET = 4


def read_ranks(path: str) -> list[bytes]:
    """Tokens in rank order from a file of base64 token and rank per line; ranks must be 0, 1, 2, ..."""
    pairs = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                pairs[int(rank)] = base64.b64decode(token)
    if sorted(pairs) != list(range(len(pairs))):
        raise ValueError("ranks are not consecutive")
    return [pairs[k] for k in range(len(pairs))]


def hashed(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and length of byte strings."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    ends = np.cumsum(sizes)
    return tk.WordHasher(quick=True)(np.frombuffer(b"".join(pieces), np.uint8), ends - sizes, ends), sizes


class PerfectHash:
    """Minimal perfect hash: key k of n keys has a slot of its own among n."""

    def __init__(self, tokens: list[bytes]):
        key, size = hashed(tokens)
        n = len(tokens)
        self.n = n
        self.buckets = max(1, n // PER_BUCKET)
        bucket = (key % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        self.shift = np.zeros(self.buckets, np.uint64)
        taken = np.zeros(n, bool)
        self.rank = np.full(n, -1, np.int64)
        for b in np.argsort(edges[:-1] - edges[1:], kind="stable").tolist():
            members = order[edges[b] : edges[b + 1]]
            if not len(members):
                break
            first = 1
            while True:
                tries = np.arange(first, first + 64, dtype=np.uint64)
                slots = self._slots(key[members][None, :], tries[:, None])
                free = ~taken[slots].any(axis=1)
                if len(members) > 1:
                    ordered = np.sort(slots, axis=1)
                    free &= (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
                if free.any():
                    at = int(np.argmax(free))
                    self.shift[b] = tries[at]
                    taken[slots[at]] = True
                    self.rank[slots[at]] = members
                    break
                first += 64
        self.key, self.size = key[self.rank], size[self.rank]

    def _slots(self, key: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (tk.mix(key ^ (shift * np.uint64(0xD6E8FEB86659FD93))) % np.uint64(self.n)).astype(np.int64)

    def __call__(self, pieces: list[bytes]) -> np.ndarray:
        """Rank of each piece, -1 for pieces outside the vocabulary."""
        if not pieces or not self.n:
            return np.full(len(pieces), -1, np.int64)
        key, size = hashed(pieces)
        slot = self._slots(key, self.shift[(key % np.uint64(self.buckets)).astype(np.int64)])
        return np.where((self.key[slot] == key) & (self.size[slot] == size), self.rank[slot], -1)


def merged(piece: bytes, rank_of: dict[bytes, int]) -> list[int]:
    """BPE of one pre-token: a heap of mergeable pairs over linked parts, named by their first byte."""
    n = len(piece)
    get = rank_of.get
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    heapify(heap)
    gone = bytearray(n)
    while heap:
        _, a, end = heappop(heap)
        if gone[a] or (b := after[a]) == n or after[b] != end:
            continue
        gone[b] = 1
        after[a] = end
        if end < n:
            before[end] = a
            last = after[end]
            if (r := get(piece[a:last])) is not None:
                heappush(heap, (r, a, last))
        p = before[a]
        if p >= 0 and (r := get(piece[p:end])) is not None:
            heappush(heap, (r, p, end))
    out, i = [], 0
    while i < n:
        out.append(rank_of[piece[i : after[i]]])
        i = after[i]
    return out


class Codec:
    """Encoder and decoder of one vocabulary; built once a worker from broadcast arrays."""

    def __init__(self, tokens: list[bytes], table: PerfectHash, pattern: str):
        self.tokens, self.table = tokens, table
        self.split = regex.compile(pattern).findall
        self.rank_of = dict(zip(tokens, range(len(tokens)), strict=True))
        self.pool = Pool(self._encode)

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [p.encode() for p in pieces]
        tokens = self.tokens
        rank = np.array([r if r >= 0 and tokens[r] == piece else -1 for r, piece in zip(self.table(raw).tolist(), raw, strict=True)], np.int64)
        sizes = np.ones(len(raw), np.int64)
        missed = np.flatnonzero(rank < 0)
        if not len(missed):
            return rank.astype(np.uint32), sizes
        parts = [merged(raw[i], self.rank_of) for i in missed.tolist()]
        sizes[missed] = [len(x) for x in parts]
        out = np.empty(int(sizes.sum()), np.uint32)
        start = np.cumsum(sizes) - sizes
        whole = rank >= 0
        out[start[whole]] = rank[whole]
        inner = np.repeat(start[missed], sizes[missed]) + np.concatenate([np.arange(len(x)) for x in parts])
        out[inner] = np.concatenate([np.array(x, np.uint32) for x in parts])
        return out, sizes

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        pieces, counts = [], []
        for text in texts:
            found = self.split(text)
            pieces += found
            counts.append(len(found))
        ids, sizes = self.pool(pieces)
        ends = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum(counts))).astype(np.int64)]
        return [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ``ids`` stand for."""
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids.tolist()])


def encoded(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ids (array of int), and the decoded text's SHA-256, read back from the ids."""
    return _mapped(docs, ranks_path, pattern, id_col, text_col, "ids array<int>, decoded_sha256 string", lambda codec, ids: (pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array([hashlib.sha256(codec.decode(x)).hexdigest() for x in ids], pa.string())))


def digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, SHA-256 of the ids (little-endian, 32 bits each) and of the decoded bytes."""

    def columns(codec: Codec, ids: list[np.ndarray]) -> tuple:
        return (
            pa.array([len(x) for x in ids], pa.int64()),
            pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
            pa.array([hashlib.sha256(codec.decode(x)).hexdigest() for x in ids], pa.string()),
        )

    return _mapped(docs, ranks_path, pattern, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", columns)


def _mapped(docs: DataFrame, ranks_path: str, pattern: str, id_col: str, text_col: str, schema: str, columns) -> DataFrame:
    storage.bounded_batches(docs.sparkSession)
    tokens, made_of = read_ranks(ranks_path), file_digest(ranks_path)
    table = PerfectHash(tokens)
    shared = docs.sparkSession.sparkContext.broadcast((tokens, vars(table)))
    names = [id_col, *(x.split()[0] for x in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def build() -> Codec:
            tokens, state = shared.value
            table = PerfectHash.__new__(PerfectHash)
            table.__dict__ = state
            return Codec(tokens, table, pattern)

        codec = kept_in_worker(f"byte bpe {made_of} {pattern}", build)
        for batch in batches:
            for a, b in tk.text_slices(batch.column(1)):
                ids = codec.encode([x or "" for x in batch.column(1).slice(a, b - a).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).cast(pa.int64()), *columns(codec, ids)], names)

    return storage.spread(docs.select(F.col(id_col), F.col(text_col))).mapInArrow(tk.tidy(run), f"`{id_col}` long, {schema}")
