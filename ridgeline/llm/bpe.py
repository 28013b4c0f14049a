"""Encoding of texts with a public byte-level BPE vocabulary.

Merges of one pre-token run in a hierarchical-bitmap rank queue: each merge rank that occurs has a bucket of linked-list
positions; a three-level bitmap marks non-empty buckets, find-first-set gives the next rank, and entries whose pair has
changed in the meantime are stale and skipped. The cost is near-linear in the pre-token, however long it is. Pre-tokens are
encoded once and kept in a bounded cache per worker, as most of a corpus repeats few of them.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.tiktoken"
TOKENIZER_DIR = "/opt/tokenizers"
#: The split of text before merging that belongs to the vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE_WORDS = 200_000
CACHED_LENGTH = 64
FAN = 64


class BitmapQueue:
    """Set of ranks below 64**3 with the least one by find-first-set on three levels of 64-bit words."""

    def __init__(self, size: int):
        leaves = -(-size // FAN)
        self.leaf = [0] * leaves
        self.middle = [0] * (-(-leaves // FAN))
        self.top = 0

    def add(self, rank: int) -> None:
        leaf = rank >> 6
        self.leaf[leaf] |= 1 << (rank & 63)
        self.middle[leaf >> 6] |= 1 << (leaf & 63)
        self.top |= 1 << (leaf >> 6)

    def discard(self, rank: int) -> None:
        leaf = rank >> 6
        self.leaf[leaf] &= ~(1 << (rank & 63))
        if not self.leaf[leaf]:
            self.middle[leaf >> 6] &= ~(1 << (leaf & 63))
            if not self.middle[leaf >> 6]:
                self.top &= ~(1 << (leaf >> 6))

    def first(self) -> int:
        """The least rank, or -1."""
        if not self.top:
            return -1
        block = (self.top & -self.top).bit_length() - 1
        word = self.middle[block]
        leaf = (block << 6) + (word & -word).bit_length() - 1
        word = self.leaf[leaf]
        return (leaf << 6) + (word & -word).bit_length() - 1


class BytePairEncoder:
    """Ids of texts under a rank file: base64 token and rank a line."""

    def __init__(self, path: str):
        import regex

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.size = max(ranks.values()) + 1
        # the merge of two ids, when their bytes together are a token
        self.merges: dict[tuple[int, int], int] = {}
        for token, rank in ranks.items():
            for at in range(1, len(token)):
                a, b = ranks.get(token[:at]), ranks.get(token[at:])
                if a is not None and b is not None:
                    self.merges[a, b] = rank
        self.whole = ranks
        self.split = regex.compile(PATTERN).findall
        self.cache: dict[str, list[int]] = {}
        self.queue = BitmapQueue(self.size)

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pre-token: always the least rank next, leftmost first among equal ones."""
        n = len(data)
        ids = [self.single[b] for b in data]
        if n < 2:
            return ids
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        buckets: dict[int, list[int]] = {}
        queue, merges = self.queue, self.merges
        for i in range(n - 1):
            rank = merges.get((ids[i], ids[i + 1]))
            if rank is not None:
                if rank in buckets:
                    buckets[rank].append(i)
                else:
                    buckets[rank] = [i]
                    queue.add(rank)
        while (rank := queue.first()) >= 0:
            queue.discard(rank)
            # positions of one rank in order; merging one may add no pair of the same rank to its left
            for i in sorted(buckets.pop(rank)):
                j = following[i]
                if ids[i] < 0 or j >= n or merges.get((ids[i], ids[j])) != rank:
                    continue  # stale
                ids[i], ids[j] = rank, -1
                k = following[j]
                following[i] = k
                if k < n:
                    before[k] = i
                    new = merges.get((rank, ids[k]))
                    if new is not None:
                        buckets.setdefault(new, []).append(i)
                        queue.add(new)
                h = before[i]
                if h >= 0:
                    new = merges.get((ids[h], rank))
                    if new is not None:
                        buckets.setdefault(new, []).append(h)
                        queue.add(new)
        return [x for x in ids if x >= 0]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        cache = self.cache
        for word in self.split(text):
            ids = cache.get(word)
            if ids is None:
                data = word.encode("utf-8", "surrogatepass")
                whole = self.whole.get(data)
                ids = [whole] if whole is not None else self.merge(data)
                if len(word) <= CACHED_LENGTH:
                    if len(cache) >= CACHE_WORDS:
                        cache.clear()
                    cache[word] = ids
            out += ids
        return out


def _encode(path: str, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    encoder = BytePairEncoder(path)
    for pdf in batches:
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "ids": [encoder.encode(t) if isinstance(t, str) else [] for t in pdf["text"]]})


def encode_corpus(documents: DataFrame, tokenizer_dir: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids): token ids of every document, without special tokens; text that looks like one is ordinary text.

    Null and empty texts give an empty array, repeated rows are kept, other columns are ignored. Vocabulary files are read by each
    worker from ``tokenizer_dir``.
    """
    path = os.path.join(tokenizer_dir, vocabulary)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(lambda it: _encode(path, it), "doc_id long, ids array<int>")


def decode_ids(path: str, ids: list[int]) -> str:
    """The text of ids, for round trips."""
    with open(path, "rb") as lines:
        token = {int(b): base64.b64decode(a) for a, b in (line.split() for line in lines if line.strip())}
    return b"".join(token[i] for i in ids).decode("utf-8")
