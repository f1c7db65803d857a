"""Byte-level BPE encoding and decoding with a rank queue under a hierarchical bitmap.

A pre-token starts as single bytes in a linked list. Each adjacent pair that is in the vocabulary waits in
the bucket of its rank; a tree of 64-bit words marks the non-empty buckets, so the next rank is found by a
find-first-set on each level. Positions of one rank leave in text order, and an entry whose pair has changed
since it was queued is skipped. A merge touches two neighbours, so a pre-token of n bytes takes about
n log n steps however long it is.

Defined results: a null or empty text has no ids; a repeated row is encoded like any other; a byte that is no
vocabulary entry by itself is an error, because such a text could not be decoded.
"""

from __future__ import annotations

import base64
import hashlib
import sys
import types
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from cohortline.llm.common import record_batch, whole_texts

# Pre-tokens remembered by a worker process, in two generations: when the newer is full, the older goes.
REMEMBERED = 250_000
LONGEST_REMEMBERED = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank per line."""
    with open(path, "rb") as file:
        pairs = (line.split() for line in file if line.strip())
        return {base64.b64decode(token): int(rank) for token, rank in pairs}


class RankQueue:
    """Positions by merge rank, lowest rank first, then text order.

    Two levels of bitmaps: a bit per rank in words of 256, and a bit per word in ``top``. ``merge`` works on
    the fields itself, because a call per step would cost as much as the step.
    """

    def __init__(self, ranks: int):
        self.words = [0] * ((ranks >> 8) + 1)
        self.buckets: dict[int, list[int]] = {}
        self.bits = [1 << i for i in range(max(256, len(self.words)))]


def merge(piece: bytes, ranks: dict[bytes, int], queue: RankQueue) -> list[int]:
    """The ids of one pre-token. The queue is empty before and after."""
    n = len(piece)
    end = list(range(1, n + 1))  # where the part that starts here ends
    before = list(range(-1, n - 1))  # where the part on its left starts
    waiting = [-1] * n  # rank under which the pair that starts here waits
    get, words, buckets, bits, top = ranks.get, queue.words, queue.buckets, queue.bits, 0
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            waiting[i] = rank
            if rank in buckets:
                buckets[rank].append(i)  # ascending, so a heap already
            else:
                buckets[rank] = [i]
                word = rank >> 8
                words[word] |= bits[rank & 255]
                top |= bits[word]
    while top:
        word = (top & -top).bit_length() - 1
        low = words[word]
        bit = low & -low
        rank = (word << 8) + bit.bit_length() - 1
        bucket = buckets[rank]
        if len(bucket) > 1:
            i = heappop(bucket)
        else:
            i = bucket[0]
            del buckets[rank]
            words[word] = low = low ^ bit
            if not low:
                top ^= bits[word]
        if waiting[i] != rank:  # stale: the pair has changed since
            continue
        middle = end[i]
        stop = end[i] = end[middle]
        waiting[middle] = -1
        left = before[i]
        changed = ((i, i, end[stop]), (left, left, stop)) if stop < n else ((left, left, stop),)
        if stop < n:
            before[stop] = i
        else:
            waiting[i] = -1
        for at, start, until in changed:
            if at < 0:
                continue
            rank = get(piece[start:until])
            if rank is None:
                waiting[at] = -1
            elif waiting[at] != rank:
                waiting[at] = rank
                if rank in buckets:
                    heappush(buckets[rank], at)
                else:
                    buckets[rank] = [at]
                    word = rank >> 8
                    words[word] |= bits[rank & 255]
                    top |= bits[word]
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class Codec:
    """Text to ids and back. Pre-tokens are found by ``pattern`` and merged one by one."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.queue = RankQueue(max(ranks.values(), default=0) + 1)
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.bytes = {rank: token for token, rank in ranks.items()}
        self.decimal = {rank: str(rank) for rank in self.bytes}

    def ids_of(self, piece: str) -> tuple[int, ...]:
        """The ids of a pre-token that is not among the newer remembered ones."""
        ids = self.older.get(piece)
        if ids is None:
            raw = piece.encode()
            rank = self.ranks.get(raw)
            ids = (rank,) if rank is not None else tuple(merge(raw, self.ranks, self.queue))
            if len(raw) > LONGEST_REMEMBERED:
                return ids
        if len(self.known) >= REMEMBERED:
            self.older, self.known = self.known, {}
        self.known[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        extend, known, miss = ids.extend, self.known.get, self.ids_of
        for piece in self.find(text):
            extend(known(piece) or miss(piece))
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def _kept_codec(ranks_file: bytes, pattern: str) -> Codec:
    """One codec for each worker process, so that later tasks find the pre-tokens of earlier ones."""
    store = sys.modules.setdefault("_kept_codecs", types.ModuleType("_kept_codecs"))
    name = hashlib.sha256(ranks_file + pattern.encode()).hexdigest()
    if not hasattr(store, name):
        pairs = (line.split() for line in ranks_file.splitlines() if line.strip())
        setattr(store, name, Codec({base64.b64decode(token): int(rank) for token, rank in pairs}, pattern))
    return getattr(store, name)


_KINDS = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}


def _coded(docs: DataFrame, ranks_path: str, pattern: str, id_col: str, rest: str, row: Callable) -> DataFrame:
    """Run ``row(codec, text)`` over whole texts; ``rest`` is the schema of what it returns."""
    with open(ranks_path, "rb") as file:  # the vocabulary: a fixed file of about 1 MB
        ranks_file = docs.sparkSession.sparkContext.broadcast(file.read())
    kept = docs.schema[id_col].dataType.simpleString()
    texts = whole_texts(docs, id_col)
    names = [c.split() for c in rest.split(", ")]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _kept_codec(ranks_file.value, pattern)
        for batch in batches:
            rows = [row(codec, text) for text in batch.column(1).to_pylist()]
            columns = zip(*rows, strict=True) if rows else [[] for _ in names]
            fields = [(id_col, batch.column(0).type), *[(n, _KINDS[k]) for n, k in names]]
            yield record_batch(pa.schema(fields), [batch.column(0), *columns])

    return texts.mapInArrow(code, f"`{id_col}` {kept}, {rest}")


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """Each document's ids: ``id_col``, ``ids`` array<int>."""

    def row(codec: Codec, text: str) -> tuple:
        return (codec.encode(text),)

    return _coded(docs, ranks_path, pattern, id_col, "ids array<int>", row)


def digest(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """Number of ids, SHA-256 of the ids in decimal joined by commas, SHA-256 of the bytes decoded from them."""

    def row(codec: Codec, text: str) -> tuple:
        ids = codec.encode(text)
        listed = ",".join(map(codec.decimal.__getitem__, ids))
        return (
            len(ids),
            hashlib.sha256(listed.encode()).hexdigest(),
            hashlib.sha256(codec.decode(ids)).hexdigest(),
        )

    return _coded(docs, ranks_path, pattern, id_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", row)


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id") -> DataFrame:
    """The bytes of ``ids`` arrays: ``id_col``, ``decoded`` binary; a null array has no bytes."""
    with open(ranks_path, "rb") as file:
        ranks_file = encoded.sparkSession.sparkContext.broadcast(file.read())
    kept = encoded.schema[id_col].dataType.simpleString()

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _kept_codec(ranks_file.value, r"\X")
        for batch in batches:
            raw = [codec.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], [id_col, "decoded"])

    return encoded.select(id_col, "ids").mapInArrow(back, f"`{id_col}` {kept}, decoded binary")
