"""Best-fit packing of tokenised texts into as few sequences of a fixed capacity as it can.

``pieces`` turns texts into ids and cuts what is longer than the capacity. ``pack`` gives every piece a sequence and a place in
it. Method: bulk-synchronous best fit. In each round all unplaced pieces and all gaps stand in one order by size,
dealt by a range partitioning; sweeps over the tiles match each piece, the largest first, with the smallest gap that is
still free and holds it, all at once; then the gaps shrink, and what found no gap tries again.

* A piece longer than half the capacity opens a sequence. As many more are opened as the sum of all lengths asks for.
* A gap that holds several of the largest piece that is left is offered in parts of that size, so that a round can
  fill a sequence with several pieces; what a part has left over is a gap again in the next round.
* Matching the tightest free gap, largest piece first, pairs brackets: in the order by falling size a gap opens and a piece
  closes the gap opened last. The depth of every row is a running sum, found per tile and carried from tile to tile; a gap
  and its piece have one depth and are neighbours among the rows of that depth. Depth is the rank that
  settles who gets which gap, so no two pieces ask for one. At one depth sizes fall from pair to pair, so there are at most
  two rows per size, however many pieces have equal lengths.
* Pieces longer than every gap open as many new sequences as the sum of their lengths asks for, so the largest
  piece is placed in every round.

Between rounds the state is written to the shared folder: a lost executor costs a part of one round. The driver sees counts,
sums and the largest size of a round only.

Null and empty texts are one piece with the end id alone. Repeated rows and equal ids are rows like any other. Extra columns of
``docs`` are left out by ``pieces`` and kept by ``pack``; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortline.llm.common import record_batch, scratch, whole_texts

CAPACITY = 4096

# Words longer than this are not kept, and no more than this many words are.
KEPT_LENGTH = 64
KEPT_WORDS = 1 << 18

# Fixed value: what the tokenizer takes as a word of its own, in lower case without white space, if all that is not ASCII is letters.
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\x80-\U0010ffff]+|[0-9]|[^a-z0-9\x80-\U0010ffff]+")

# ASCII and the Latin letters below U+0250 whose lower case is one letter.
LATIN = re.compile(r"[\x00-\x7f\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u024f]*")


def byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, as the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class WordIds(dict):
    """Ids of words as little-endian unsigned 32-bit numbers, worked out when first asked for.

    The tokenizer brings texts to NFC and lower case, drops white space and codes letters, single digits and runs of anything else
    on their own, so a text's ids are those of its words one after the other. For words of ASCII characters and Latin
    letters below U+0250, which NFC leaves alone, that is done here and only the merging is left to its model; all other
    words, and those in which a special token may stand, go through the whole tokenizer. The parts of a word are looked up as
    words: most have been seen alone or beside other signs.
    """

    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.tokenizer, self.model, self.letters = tokenizer, tokenizer.model, byte_letters()

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        if "<|" in text or not LATIN.fullmatch(text):
            return self._keep(word, self.tokenizer.encode(text, add_special_tokens=False).ids)
        text = text.lower()
        if not text.isalpha():
            parts = PARTS.findall(text)
            if len(parts) > 1:
                return self._hold(word, b"".join([self[part.encode()] for part in parts]))
        if not (text.isascii() and text.isalnum()):
            text = text.encode().decode("latin-1").translate(self.letters)
        return self._keep(word, [token.id for token in self.model.tokenize(text)])

    def _keep(self, word: bytes, ids: list[int]) -> bytes:
        return self._hold(word, struct.pack(f"<{len(ids)}I", *ids))

    def _hold(self, word: bytes, coded: bytes) -> bytes:
        if len(word) <= KEPT_LENGTH:
            self[word] = coded
        return coded

    def encode(self, text: str) -> bytes:
        if len(self) > KEPT_WORDS:
            self.clear()
        data = text.encode()
        if text.isascii() and "<|" not in text:
            data = data.lower()  # fewer different words
        return b"".join(map(self.__getitem__, data.split()))  # at ASCII white space


def pieces(
    docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Each text's ids and the end id, cut after every ``capacity`` ids.

    ``id_col``, ``piece`` int from 0, ``start`` long (ids of the text before it), ``length`` long, ``ids`` binary
    (little-endian unsigned 32-bit numbers).
    """
    with open(tokenizer_path, encoding="utf-8") as file:  # the vocabulary: a fixed file of a few MB
        described = docs.sparkSession.sparkContext.broadcast(file.read())
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()
    width = 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals the work; threads of the library would wait for it in a loop
        words = WordIds(Tokenizer.from_str(described.value))
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                rows = batch.slice(first, 512)
                coded = [words.encode(text) + end for text in rows.column(1).to_pylist()]
                owner = [i for i, ids in enumerate(coded) for _ in range(0, len(ids), width)]
                begins = [at for ids in coded for at in range(0, len(ids), width)]
                parts = [coded[i][at : at + width] for i, at in zip(owner, begins, strict=True)]
                schema = pa.schema(
                    [(id_col, rows.column(0).type), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())]
                )
                at = np.array(begins, np.int64)
                columns = [rows.column(0).take(pa.array(owner, pa.int64())), at // width, at // 4, [len(p) // 4 for p in parts], parts]
                yield record_batch(schema, columns)

    return whole_texts(docs, id_col, text=text).mapInArrow(cut, f"`{id_col}` {kind}, piece int, start long, length long, ids binary")


def pack(items: DataFrame, length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """All columns with ``sequence_id`` long and ``offset`` long: where each item lies, without gaps from 0 on.

    Items are between 1 and ``capacity`` long; any other, or a NULL length, has no sequence.
    """
    spark = items.sparkSession
    items = scratch(items.withColumn("_item", F.monotonically_increasing_id()))
    sizes = items.select("_item", F.col(length).cast("long").alias("_size")).filter(F.col("_size").between(1, capacity))
    alone = F.col("_size") * 2 > capacity
    n_alone, total = sizes.agg(F.count_if(alone), F.coalesce(F.sum("_size"), F.lit(0))).first()

    opened = sizes.filter(alone)
    placed = [opened.select("_item", "_size", F.col("_item").alias("_bin"), F.lit(0).alias("_round"), F.lit(0).cast("long").alias("_part"))]
    gaps = opened.select(F.col("_item").alias("_bin"), (capacity - F.col("_size")).alias("_gap")).filter(F.col("_gap") > 0)
    rest = sizes.filter(~alone)
    turn, empty = 0, 0

    def fresh(tokens: int) -> DataFrame:
        """Empty sequences, as many as so many tokens fill."""
        nonlocal empty
        first, empty = empty, empty + -(-tokens // capacity)
        return spark.range(first, empty).select((-1 - F.col("id")).alias("_bin"), F.lit(capacity).cast("long").alias("_gap"))

    gaps = gaps.unionByName(fresh(max(0, total - n_alone * capacity)))
    while True:
        n, largest, least = rest.agg(F.count(F.lit(1)), F.max("_size"), F.min("_size")).first()
        if n == 0:
            break
        turn += 1
        gaps = gaps.filter(F.col("_gap") >= least)
        n_gaps, widest = gaps.agg(F.count(F.lit(1)), F.coalesce(F.max("_gap"), F.lit(0))).first()
        if largest > widest:
            gaps = gaps.unionByName(fresh(rest.filter(F.col("_size") > widest).agg(F.sum("_size")).first()[0]))
        # No more parts than a few times the pieces that are left.
        most = max(1, -(-4 * n // max(1, n_gaps)))
        matched = scratch(_sweep(_parts(gaps, largest, most), rest))
        found = matched.filter(F.col("_item").isNotNull() & F.col("_bin").isNotNull())
        placed.append(found.select("_item", "_size", "_bin", F.lit(turn).alias("_round"), "_part"))
        rest = matched.filter(F.col("_bin").isNull()).select("_item", "_size")
        used = found.groupBy("_bin").agg(F.sum("_size").alias("_used"))
        gaps = scratch(
            gaps.join(used, "_bin", "left").select("_bin", (F.col("_gap") - F.coalesce("_used", F.lit(0))).alias("_gap")).filter(F.col("_gap") > 0)
        )

    # A sequence holds at most as many items as its capacity.
    inside = Window.partitionBy("_bin").orderBy("_round", "_part", "_item").rowsBetween(Window.unboundedPreceding, -1)
    where = reduce(DataFrame.unionByName, placed).select(
        "_item", F.col("_bin").alias("sequence_id"), F.coalesce(F.sum("_size").over(inside), F.lit(0)).alias("offset")
    )
    return items.drop("sequence_id", "offset").join(where, "_item", "left").drop("_item")


def _parts(gaps: DataFrame, largest: int, most: int) -> DataFrame:
    """Gaps offered in parts that hold the largest piece; the last part has what is left over."""
    n = F.least(F.greatest(F.expr(f"_gap div {largest}"), F.lit(1)), F.lit(most))
    parts = gaps.withColumn("_parts", n).withColumn("_part", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_parts"))))
    last = F.col("_gap") - (F.col("_parts") - 1) * largest
    return parts.select("_bin", "_part", F.when(F.col("_part") == F.col("_parts"), last).otherwise(F.lit(largest).cast("long")).alias("_size"))


def _sweep(parts: DataFrame, rest: DataFrame) -> DataFrame:
    """One round: each piece, the largest first, with the smallest free part that holds it.

    ``_item, _size, _bin, _part`` of the pairs found, and of the pieces left over, those without ``_bin``.
    """
    none = F.lit(None).cast("long")
    offers = parts.select(F.lit(1).alias("_step"), "_size", "_bin", "_part", none.alias("_item"))
    asks = rest.select(F.lit(-1).alias("_step"), "_size", none.alias("_bin"), none.alias("_part"), "_item")
    # By falling size, parts before pieces of their size; a hash spreads equal sizes over the tiles.
    order = ["_fall", "_late", "_hash", "_bin", "_part", "_item"]
    rows = offers.unionByName(asks).withColumns(
        {"_fall": -F.col("_size"), "_late": -F.col("_step"), "_hash": F.xxhash64("_bin", "_part", "_item")}
    )
    tiled = scratch(rows.repartitionByRange(*order[:3]).withColumn("_tile", F.spark_partition_id()))

    in_tile = Window.partitionBy("_tile").orderBy(*order)
    so_far = in_tile.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = in_tile.rowsBetween(Window.unboundedPreceding, -1)
    running = tiled.withColumn("_sum", F.sum("_step").over(so_far))
    # One row per tile: what the tiles before it add up to, and how low the sum went in them.
    earlier = Window.orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    tiles = running.groupBy("_tile").agg(F.sum("_step").alias("_all"), F.min("_sum").alias("_low"))
    tiles = tiles.withColumn("_base", F.coalesce(F.sum("_all").over(earlier), F.lit(0)))
    tiles = tiles.withColumn("_floor", F.least(F.lit(0), F.coalesce(F.min(F.col("_base") + F.col("_low")).over(earlier), F.lit(0))))
    tiles = F.broadcast(tiles.select("_tile", "_base", "_floor"))

    depth = running.join(tiles, "_tile").withColumn("_sum", F.col("_sum") + F.col("_base"))
    lowest = F.least(F.col("_floor"), F.coalesce(F.min("_sum").over(before), F.lit(0)))
    depth = depth.withColumn("_level", F.col("_sum") - lowest + F.when(F.col("_step") == -1, 1).otherwise(0))
    # A piece that brings the sum to a new low finds nothing open; a hash spreads these rows.
    left_over = (F.col("_step") == -1) & (F.col("_level") <= 0)
    depth = depth.withColumn("_level", F.when(left_over, -1 - F.pmod("_hash", F.lit(1 << 30))).otherwise(F.col("_level")))
    at_level = Window.partitionBy("_level").orderBy(*order)
    last = F.lag(F.struct("_step", "_bin", "_part")).over(at_level)
    closed = depth.withColumn("_open", last).filter(F.col("_step") == -1)
    pair = F.col("_level") > 0
    return closed.select("_item", "_size", F.when(pair, F.col("_open._bin")).alias("_bin"), F.when(pair, F.col("_open._part")).alias("_part"))

