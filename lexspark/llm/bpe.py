"""Problem 8: byte-level BPE ids of whole texts, by a two-tier lookup.

A text is cut into pre-tokens. Tier one: a minimal perfect hash over the vocabulary tells at once whether a
whole pre-token is a token, and its id. Tier two, for the rest: the bytes of the pre-token form a linked list,
and a heap of adjacent pairs, ordered by rank and place, merges them one by one.

The vocabulary (tens of thousands of entries, fixed by the tokenizer and checked against ``MAX_VOCABULARY``)
is read once on the driver and broadcast; the texts never shuffle.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_RANKS = os.path.join("/opt/tokenizers", "byte_bpe_50k.tiktoken")
MAX_VOCABULARY = 300_000
#: Fixed value: the pre-token pattern of this public vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens a worker remembers; beyond it the memory starts anew.
MEMO = 200_000


def load_ranks(path: str = DEFAULT_RANKS) -> list[bytes]:
    """The tokens of a rank file in the order of their ids."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    if len(pairs) > MAX_VOCABULARY:
        raise ValueError(f"{path}: more than {MAX_VOCABULARY} tokens")
    out: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


class PerfectHash:
    """A minimal perfect hash of byte strings: hash and displace.

    A key's bucket names a seed; the key's hash under that seed is its slot, and each of the n slots holds one key.
    """

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.buckets = max(1, 2 * n // 3)  # few keys to a bucket: filling the last slots stays cheap
        groups: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, k in enumerate(keys):
            groups[xxhash.xxh3_64_intdigest(k) % self.buckets].append(i)
        self.seeds = [0] * self.buckets
        slots = [-1] * n
        free_from = 0
        for b in sorted(range(self.buckets), key=lambda b: -len(groups[b])):
            group = groups[b]
            if not group:
                break
            if len(group) == 1:  # any free slot will do; a negative seed names it
                while slots[free_from] >= 0:
                    free_from += 1
                slots[free_from] = group[0]
                self.seeds[b] = -free_from - 1
                continue
            seed = 1
            while True:
                at = [xxhash.xxh3_64_intdigest(keys[i], seed) % n for i in group]
                if len(set(at)) == len(at) and all(slots[s] < 0 for s in at):
                    break
                seed += 1
            for s, i in zip(at, group):
                slots[s] = i
            self.seeds[b] = seed
        self.slots, self.keys = slots, keys

    def find(self, key: bytes) -> int:
        """The number of ``key``, or -1."""
        if not self.n:
            return -1
        seed = self.seeds[xxhash.xxh3_64_intdigest(key) % self.buckets]
        slot = -seed - 1 if seed < 0 else xxhash.xxh3_64_intdigest(key, seed) % self.n
        i = self.slots[slot]
        return i if self.keys[i] == key else -1


class Encoder:
    """Encodes texts; special tokens are plain text here, since none is known."""

    def __init__(self, tokens: list[bytes], pattern: str = PATTERN):
        self.table = PerfectHash(tokens)
        self.split = regex.compile(pattern).findall
        self.memo: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """The ids of a pre-token that is no token itself."""
        find = self.table.find
        n = len(piece)
        start, end = list(range(n)), list(range(1, n + 1))  # of the part that begins at each byte
        nxt, prv, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[int, int, int, int]] = []

        def push(i: int) -> None:
            j = nxt[i]
            if j < n and (rank := find(piece[start[i] : end[j]])) >= 0:
                heapq.heappush(heap, (rank, i, end[i], end[j]))

        for i in range(n - 1):
            push(i)
        while heap:
            _, i, mid, stop = heapq.heappop(heap)
            if not alive[i] or end[i] != mid or nxt[i] >= n or end[nxt[i]] != stop:
                continue  # one side has been merged since
            j = nxt[i]
            alive[j], end[i], nxt[i] = False, stop, nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
            push(i)
            if prv[i] >= 0:
                push(prv[i])
        out, i = [], 0
        while i < n:
            out.append(find(piece[start[i] : end[i]]))
            i = nxt[i]
        return tuple(out)

    def piece(self, text: str) -> tuple[int, ...]:
        key = text.encode("utf-8", "replace")
        i = self.table.find(key)
        got = (i,) if i >= 0 else self.merge(key)
        if len(self.memo) >= MEMO:
            self.memo.clear()
        if len(text) <= 64:
            self.memo[text] = got
        return got

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        memo, piece, extend = self.memo, self.piece, out.extend
        for t in self.split(text):
            extend(memo.get(t) or piece(t))
        return out


@lru_cache(maxsize=2)
def _encoder(tokens: tuple[bytes, ...], pattern: str) -> Encoder:
    return Encoder(list(tokens), pattern)


def encode_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", ranks: str = DEFAULT_RANKS, pattern: str = PATTERN) -> DataFrame:
    """``<key>, ids``: one row per row of ``docs``; an empty and a null text give an empty list.

    Whole texts are encoded, whatever their length; a pre-token of n bytes takes n log n steps. Strings that
    look like special tokens are plain text. Further columns of ``docs`` are not read.
    """
    tokens = docs.sparkSession.sparkContext.broadcast(tuple(load_ranks(ranks)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokens.value, pattern).encode
        for batch in batches:
            parts, offsets = [], [0]
            for t in batch.column(1):
                ids = encode(t.as_py())
                parts.append(np.array(ids, dtype=np.int32))
                offsets.append(offsets[-1] + len(ids))
            values = np.concatenate(parts) if parts else np.array([], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
