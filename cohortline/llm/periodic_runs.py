"""Periodic runs of words: maximal stretches that repeat with some period, and texts without the repeats.

A run of period q is a stretch of consecutive words in which words q apart are equal, q being its smallest period, at
least ``max(LEAST, 2q)`` words long, that no neighbouring word extends. Method: longest common extensions from a
difference cover, driving a harmonic grid.

* Words become numbers, exact within a chunk of texts; a number of its own stands after each text, so that nothing
  reaches into the next one.
* Of all suffixes only those at positions whose residue lies in a difference cover of ``PERIOD`` are sorted: by their
  first ``PERIOD`` words, then by doubling, where a suffix still tied asks for the place of the one ``PERIOD``,
  twice ``PERIOD``, ... words on, which is in the sample as well.
* For any two positions one shift below ``PERIOD`` takes both into the sample. Their common extension is found by comparing
  the few words up to there and, if all agree, by a range minimum over the common prefixes of sorted neighbours.
* Any run of period q covers two neighbouring points i, i + q of the grid of every ``max(q, LEAST - q)``-th word. Pairs of
  the grid with equal words ask for their extension forwards and, in the reversed text, backwards; the two together say
  whether there is a run and where it ends. A multiple of a run's period finds the same ends and is dropped.

The grids of a text of n words have about n ln n pairs. Chunks of texts are handled independently by Spark's tasks; a
longer text is a chunk of its own and is held whole, like its row.

Null and empty texts have no words and no runs. Repeated rows and equal ids are rows like any other; extra columns are left out;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.llm.common import record_batch, text_chunks, whole_texts

# Every difference modulo 31 is a difference of two of these residues.
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)

# Shortest run.
LEAST = 12

# Pairs of the grid that are looked at together.
BLOCK = 1 << 21


def _shifts() -> np.ndarray:
    """For two residues the smallest shift that takes both into the cover."""
    inside = np.isin(np.arange(2 * PERIOD) % PERIOD, COVER)
    both = inside[np.add.outer(np.arange(PERIOD), np.arange(PERIOD))]  # residue, shift
    return np.argmax(both[:, None, :] & both[None, :, :], axis=2)


_SHIFT = _shifts()


def ragged(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each count, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


class Extensions:
    """Longest common extensions of positions in a sequence of numbers, in which no position beyond it may be asked for."""

    def __init__(self, values: np.ndarray):
        self.values = np.concatenate([values, np.full(PERIOD + 1, -1, values.dtype)])
        n = len(values)
        sampled = np.flatnonzero(np.isin(np.arange(n) % PERIOD, COVER))
        self.place = np.zeros(n + PERIOD + 1, np.int64)  # rank of a sampled suffix
        if len(sampled) == 0:
            sampled = np.zeros(1, np.int64)
        order, levels = self._sort(sampled, n)
        self.place[sampled[order]] = np.arange(len(order))
        self._minima(self._neighbours(sampled[order], levels))

    def _sort(self, sampled: np.ndarray, n: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Order of the sampled suffixes, and their group numbers after PERIOD, 2 PERIOD, ... words."""
        bits = max(1, int(self.values.max(initial=0) + 2).bit_length())
        each = 63 // bits
        group = np.zeros(len(sampled), np.int64)
        order, tied = np.arange(len(sampled)), np.arange(len(sampled))
        for first in range(0, PERIOD, each):
            key = np.zeros(len(tied), np.int64)
            at = sampled[order[tied]]
            for j in range(first, min(first + each, PERIOD)):
                key = (key << bits) | (self.values[np.minimum(at + j, n + PERIOD)] + 1)
            order, group, tied = self._refine(order, group, tied, key)
            if len(tied) == 0:
                break
        levels, step = [], PERIOD
        index = np.zeros(n + PERIOD + 1, np.int64)
        index[sampled] = np.arange(len(sampled))
        while True:
            named = np.empty(len(sampled), np.int64)
            named[order] = group
            levels.append(named)
            if len(tied) == 0:
                return order, levels
            # A tied suffix reaches step words on without leaving its text, where another sampled suffix begins.
            key = named[index[np.minimum(sampled[order[tied]] + step, n)]]
            order, group, tied = self._refine(order, group, tied, key)
            step *= 2

    @staticmethod
    def _refine(order: np.ndarray, group: np.ndarray, tied: np.ndarray, key: np.ndarray) -> tuple:
        """Sort the tied places of the order by group and key, name the groups by their first place, return who is still tied."""
        sub = np.lexsort((key, group[tied]))
        old, key = group[tied][sub], key[sub]
        order, group = order.copy(), group.copy()
        order[tied] = order[tied][sub]
        opens = np.r_[True, (old[1:] != old[:-1]) | (key[1:] != key[:-1])]
        group[tied] = tied[np.maximum.accumulate(np.where(opens, np.arange(len(tied)), 0))]
        alone = opens & np.r_[opens[1:], True]
        return order, group, tied[~alone]

    def _neighbours(self, suffixes: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Common prefix of each suffix with the one before it in the order; the groups say how many whole steps agree."""
        n = len(self.values) - PERIOD - 1
        index = np.zeros(len(self.values), np.int64)
        index[np.sort(suffixes)] = np.arange(len(suffixes))
        left, right = suffixes[:-1].copy(), suffixes[1:].copy()
        length = np.zeros(len(left), np.int64)
        for k in reversed(range(len(levels))):
            same = levels[k][index[np.minimum(left, n)]] == levels[k][index[np.minimum(right, n)]]
            step = np.where(same, PERIOD << k, 0)
            left, right, length = left + step, right + step, length + step
        return np.r_[0, length + self._compare(left, right, np.full(len(left), PERIOD))]

    def _compare(self, left: np.ndarray, right: np.ndarray, at_most: np.ndarray) -> np.ndarray:
        """How many words agree one by one, up to a number for each pair."""
        length = np.zeros(len(left), np.int64)
        going = np.arange(len(left))
        last = len(self.values) - 1
        for j in range(PERIOD):
            a, b = np.minimum(left[going] + j, last), np.minimum(right[going] + j, last)
            going = going[(at_most[going] > j) & (self.values[a] == self.values[b]) & (a != b)]
            if len(going) == 0:
                break
            length[going] += 1
        return length

    def _minima(self, prefixes: np.ndarray) -> None:
        self.table = [prefixes]
        width = 1
        while 2 * width <= len(prefixes):
            below = self.table[-1]
            self.table.append(np.minimum(below[: len(below) - width], below[width:]))
            width *= 2

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Common extension of two different positions each."""
        shift = _SHIFT[left % PERIOD, right % PERIOD]
        length = self._compare(left, right, shift)
        on = np.flatnonzero(length == shift)
        a, b = self.place[left[on] + shift[on]], self.place[right[on] + shift[on]]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b)
        level = np.frexp((high - low + 1).astype(float))[1] - 1
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            row = self.table[k]
            length[on[at]] += np.minimum(row[low[at]], row[high[at] - (1 << int(k)) + 1])
        return length


def _grid(counts: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and periods of all grid pairs of texts with these word counts, in blocks."""
    able = counts >= LEAST
    counts, starts = counts[able], starts[able]
    period = ragged(counts // 2) + 1
    text = np.repeat(np.arange(len(counts)), counts // 2)
    spacing = np.maximum(period, LEAST - period)
    pairs = -(-(counts[text] - period) // spacing)
    block = np.cumsum(pairs) // BLOCK
    for b in range(block[-1] + 1 if len(block) else 0):
        own = slice(np.searchsorted(block, b), np.searchsorted(block, b, side="right"))
        many = pairs[own]
        q = np.repeat(period[own], many)
        yield np.repeat(starts[text[own]], many) + ragged(many) * np.repeat(spacing[own], many), q


def runs_of(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Runs of several texts in one sequence: rows ``start, end, period`` in the sequence, by start and period.

    After each text stands a number that occurs nowhere else.
    """
    n = len(values)
    found = []
    forwards = backwards = None
    for at, q in _grid(counts, starts):
        equal = np.flatnonzero(values[at] == values[at + q])
        at, q = at[equal], q[equal]
        if len(at) == 0:
            continue
        if forwards is None:
            # The text before the first one ends in a number of its own too.
            forwards, backwards = Extensions(values), Extensions(np.r_[values[::-1], values.max() + 1])
        ahead = forwards(at, at + q)
        # The word before position i stands at n - i in the reversed sequence.
        behind = backwards(n - at, n - at - q)
        whole = np.flatnonzero(ahead + behind >= np.maximum(q, LEAST - q))
        at, q = at[whole], q[whole]
        found.append(np.stack([at - behind[whole], at + q + ahead[whole], q], axis=1))
    rows = np.concatenate([np.zeros((0, 3), np.int64), *found])
    if len(rows) == 0:
        return rows
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.r_[True, (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])]  # the smallest period of equal ends
    rows = rows[first]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def find_runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text's runs and what is left without their repeats.

    ``id_col``, ``n_words`` long, ``runs`` array of ``start, length, period`` by start and period, ``collapsed`` string: the
    words joined by one space, without any word that some run contains after its first ``period`` words.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, offsets, data in text_chunks(batches):
            raw = data.tobytes()
            texts = [raw[a:b].split() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]  # at ASCII white space
            counts = np.fromiter(map(len, texts), np.int64, len(texts))
            starts = np.cumsum(counts + 1) - counts - 1
            number: dict[bytes, int] = {}
            values = np.empty(int(counts.sum()) + len(texts), np.int64)
            for i, words in enumerate(texts):
                values[starts[i] : starts[i] + len(words)] = [number.setdefault(w, len(number)) for w in words]
            values[starts + counts] = len(number) + np.arange(len(texts))
            found = runs_of(values, starts, counts)
            owner = np.searchsorted(starts, found[:, 0], side="right") - 1
            bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
            marks = np.zeros(len(values) + 1, np.int64)
            np.add.at(marks, found[:, 0] + found[:, 2], 1)
            np.add.at(marks, found[:, 1], -1)
            repeated = np.cumsum(marks)[:-1] > 0
            collapsed = []
            for i, words in enumerate(texts):
                if bounds[i] < bounds[i + 1]:
                    kept = np.flatnonzero(~repeated[starts[i] : starts[i] + len(words)])
                    words = [words[j] for j in kept]
                collapsed.append(b" ".join(words).decode())
            parts = [found[:, 0] - starts[owner], found[:, 1] - found[:, 0], found[:, 2]]
            flat = pa.StructArray.from_arrays([pa.array(p, pa.int64()) for p in parts], fields=list(run))
            runs = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), flat)
            schema = pa.schema([(id_col, rows.column(0).type), ("n_words", pa.int64()), ("runs", runs.type), ("collapsed", pa.string())])
            yield record_batch(schema, [rows.column(0), counts, runs, collapsed])

    schema = f"`{id_col}` {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return whole_texts(docs, id_col, text=text).mapInArrow(search, schema)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Number of runs, the longest one (then the first, then the shortest period) and SHA-256 of the runs and of what is left."""
    longest = F.array_max(
        F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("first"), (-r["period"]).alias("short")))
    )
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    best = found.withColumn("_best", longest)
    start, length, period = -F.col("_best.first"), F.col("_best.length"), -F.col("_best.short")
    return best.select(
        id_col,
        F.size("runs").cast("long").alias("n_runs"),
        start.alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.expr("_best.length * 1000 div -_best.short").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_planted_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The texts, of which one in ten by a checksum of the id repeats a stretch of its own words to its end.

    With h the CRC-32 of the id in decimal and g = h // 10, a text of n > 0 words with h % 10 = 0 keeps its first
    a = g % n words and then repeats the p = 1 + (n - a) // (3 + g % 8) words from there on. A NULL id repeats nothing.
    """
    h = F.crc32(F.col(id_col).cast("string"))
    words = F.expr(f"filter(split(`{text}`, '[\\\\x20\\\\x09-\\\\x0D]+', -1), w -> w != '')")
    n = F.size("_words").cast("long")
    g = F.expr("_h div 10")
    a = g % n
    p = F.lit(1) + F.expr("(_n - _a) div (3 + _h div 10 % 8)")
    planted = F.expr(
        "concat_ws(' ', transform(_words, (w, i) -> _words[cast(if(i < _a, i, _a + (i - _a) % _p) as int)]))"
    )
    chosen = (F.col("_h") % 10 == 0) & (F.col("_n") > 0)
    return (
        docs.select(id_col, text)
        .withColumn("_h", h)
        .withColumn("_words", F.when(F.col("_h") % 10 == 0, words))
        .withColumn("_n", F.when(F.col("_words").isNotNull(), n).otherwise(0))
        .withColumn("_a", F.when(chosen, a))
        .withColumn("_p", F.when(chosen, p))
        .select(id_col, F.when(chosen, planted).otherwise(F.col(text)).alias(text))
    )

