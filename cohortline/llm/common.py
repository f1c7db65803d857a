"""What several operators share: whole texts in Arrow chunks, word and shingle hashes, packed arrays, scratch tables."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.session import cut_lineage

# A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

# Texts are handled in chunks of about this many bytes; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 21

_U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
SHINGLE = 5


def scratch(df: DataFrame) -> DataFrame:
    """The frame written to the shared folder and read back."""
    return cut_lineage(df)


def whole_texts(docs: DataFrame, *others: str, text: str = "text") -> DataFrame:
    """The columns asked for and ``text`` as a string that is never null; all other columns are left out."""
    return docs.select(*others, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts, for choosing a number of buckets."""
    return docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]


def buckets_for(size: int, each: int, least: int = 1) -> int:
    """How many buckets keep each near ``each`` bytes, whatever the size."""
    return max(least, math.ceil(size / each))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column, without a copy."""
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    if len(column) == 0 or column.buffers()[1] is None:
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def text_chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[tuple]:
    """Pieces of the batches: ``(rows, offsets, bytes of the texts)``; every text is whole."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        offsets, data = buffers(pc.fill_null(batch.column("text"), ""))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            own = offsets[first : last + 1]
            yield batch.slice(first, last - first), own - own[0], data[own[0] : own[-1]]
            first = last


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U64(27))
    x = x * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


class Hasher:
    """Hashes of the words and five-word shingles of many texts at once; powers are kept between calls."""

    def __init__(self, lower: bool):
        table = mix(np.arange(1, 257, dtype=_U64) * _U64(0xD1342543DE82EF95))
        if lower:
            table[65:91] = table[97:123]
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        table[self.space] = 0
        self.table = table
        self.up = self.down = np.ones(1, _U64)

    def powers(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, CHUNK_BYTES)
            self.up = np.cumprod(np.r_[_U64(1), np.full(size - 1, _BASE, _U64)])
            self.down = np.cumprod(np.r_[_U64(1), np.full(size - 1, _INVERSE, _U64)])

    def words(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends, hashes of all words, and the number of the first word of each text (one more at the end)."""
        n = len(data)
        if n == 0:
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(0, _U64), np.zeros(len(offsets), np.int64)
        self.powers(n)
        word = ~self.space[data]
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        before = np.r_[False, word[:-1]] & ~cut[:-1]
        after = np.r_[word[1:], False] & ~cut[1:]
        starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
        if len(starts) == 0:
            return starts, ends, np.zeros(0, _U64), np.zeros(len(offsets), np.int64)
        sums = np.add.reduceat(self.table[data] * self.up[:n], starts)
        return starts, ends, mix(sums * self.down[starts]), np.searchsorted(starts, offsets)

    def shingles(self, hashes: np.ndarray, first: np.ndarray, short: bool) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the five-word window at each word and whether it lies in one text.

        With ``short``, a text of one to four words has one window at its first word: the whole sequence.
        """
        n = len(hashes)
        counts = np.diff(first)
        owner_end = np.repeat(first[1:], counts)
        at = np.arange(n)
        sums, weight = np.zeros(n, _U64), 1
        for j in range(SHINGLE):
            weight = weight * 0xA0761D6478BD642F % (1 << 64)
            inside = at + j < owner_end
            sums[: n - j] += np.where(inside[: n - j], hashes[j:], _U64(0)) * _U64(weight)
        length = np.minimum(owner_end - at, SHINGLE)
        valid = length == SHINGLE
        if short:
            valid |= (at == np.repeat(first[:-1], counts)) & (np.repeat(counts, counts) < SHINGLE)
        return mix(sums + length.astype(_U64) * _U64(0xE7037ED1A0B428DB)), valid


def pack(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array).tobytes()


def record_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    """Columns, lists or Arrow arrays, as a batch of the schema."""
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)
