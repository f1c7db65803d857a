"""Exact top-k inner-product search over an impact-ordered index, score at a time.

Components become integers, floor(256 x). The rows are dealt to blocks by a hash; in a block, every dimension has one
posting segment per quantised impact, listing the rows whose component falls on that step. A batch of queries takes
the segments by descending size of the impact and adds the quantised contribution to each row's score.

What is not yet added, and what quantising lost, is bounded per query. Once the rows that can still be among the best
``k`` of the block are few, the bound proves that no other row can be, and those few are rescored exactly. If the bound
never gets that tight, all segments are taken and all possible rows rescored; the result is exact either way. The best
of all blocks are merged.

Queries and blocks meet on (block, chunk of queries), so a task holds one block and a bounded number of queries.

Defined results: vectors that are null, or hold a null or non-finite component, or have a null id, take no part; rows equal
in id and vector count once; different vectors under one id are separate rows, and none of them is a candidate of a query with
that id; missing components of shorter vectors are 0; ties go to the smaller id; an empty table gives an empty result.
Vectors of any length take part. Scores that 64-bit sums might not hold are bounded in floating point and computed in Python integers
where they can be among the best; a scaled component or a best score beyond 64 bits is an error, as it is in SQL.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortline.llm.common import buckets_for, pack, scratch

BLOCK_ROWS = 8192
CHUNK_QUERIES = 4096
BATCH = 64
STEP_BITS = 2  # a segment spans 2 ** STEP_BITS neighbouring component values
FEW = 64  # rows per query worth rescoring


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id`` and ``vec`` (array<int>) of the rows that take part, each once."""
    vector = F.col(vector_col)
    wide = F.transform(vector, lambda x: x.cast("double"))
    whole = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    found = rows.filter(F.col(id_col).isNotNull() & vector.isNotNull() & F.coalesce(whole, F.lit(False)))
    too_large = F.raise_error(F.lit("a component times 256 does not fit into 64 bits")).cast("long")
    scaled = F.transform(wide, lambda x: F.when(F.abs(x) < float(1 << 55), F.floor(x * 256)).otherwise(too_large))
    return found.select(F.col(id_col).cast("long").alias("id"), scaled.alias("vec")).distinct()


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Lists of integers as rows, shorter ones filled up with 0."""
    vectors = vectors.combine_chunks()
    lengths = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(lengths), int(lengths.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = vectors.flatten().to_numpy()
    return out


def _narrow(values: np.ndarray) -> np.ndarray:
    """As 32-bit integers if all fit."""
    fits = len(values) == 0 or (values.min(initial=0) >= -(1 << 31) and values.max(initial=0) < 1 << 31)
    return values.astype(np.int32) if fits else values


def build_index(vectors: DataFrame, blocks: int) -> DataFrame:
    """One row per block: ``ids``, ``values`` (rows by dimension) and, per dimension, ``postings`` by impact."""
    schema = pa.schema([("block", pa.int32()), ("dims", pa.int32()), ("ids", pa.binary()), ("values", pa.binary()), ("postings", pa.binary())])

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        values = _narrow(_matrix(table.column("vec")))
        postings = np.argsort(values >> STEP_BITS, axis=0, kind="stable").T.astype(np.int32)
        row = [[table.column("block")[0].as_py()], [values.shape[1]], [pack(table.column("id").to_numpy())], [pack(values)], [pack(postings)]]
        return pa.table([pa.array(c, f.type) for c, f in zip(row, schema, strict=True)], schema=schema)

    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("id", "vec"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("block").applyInArrow(build, "block int, dims int, ids binary, values binary, postings binary")


def segments(values: np.ndarray, postings: np.ndarray) -> list[list[tuple[int, int, np.ndarray]]]:
    """Segments (dimension, step, rows) grouped by size of impact, largest first.

    A step s holds the values from s * 2 ** STEP_BITS on; its size is its distance from the values around 0.
    """
    found: dict[int, list] = {}
    for dim, order in enumerate(postings):
        steps = (values[order, dim]) >> STEP_BITS
        edges = np.r_[0, np.flatnonzero(np.diff(steps)) + 1, len(steps)]
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            step = int(steps[lo])
            found.setdefault(step if step >= 0 else -step - 1, []).append((dim, step, order[lo:hi]))
    return [found[size] for size in sorted(found, reverse=True)]


def _exact_scores(values: np.ndarray, q: np.ndarray) -> list[int]:
    wanted = q.tolist()
    return [sum(a * b for a, b in zip(row, wanted, strict=True)) for row in values.tolist()]


def search_long(ids: np.ndarray, values: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> list:
    """``search_block`` for components so large that sums may leave 64 bits: rows that the rounding error of floating
    point sums cannot rule out are scored in Python integers."""
    out: list[list] = [[], [], []]
    wide = values.astype(np.float64)
    for query_id, wanted in zip(query_ids, q, strict=True):
        rows = np.flatnonzero(ids != query_id)
        about = wide[rows] @ wanted.astype(np.float64)
        error = (np.abs(wide[rows]) @ np.abs(wanted.astype(np.float64))) * (len(wanted) + 4) * 2.0**-51
        if len(rows) > k:
            left = about + error >= np.partition(about - error, len(rows) - k)[len(rows) - k]
            rows = rows[left]
        exact = _exact_scores(values[rows], wanted)
        best = sorted(zip([-e for e in exact], ids[rows].tolist(), strict=True))[:k]
        out[0].append(np.full(len(best), query_id))
        out[1].append(np.array([i for _, i in best], np.int64))
        out[2].append(np.array([-e for e, _ in best], np.int64))  # an error if it does not fit
    return out


def search_block(ids: np.ndarray, values: np.ndarray, groups: list, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list:
    """The best ``k`` rows of a block per query: arrays of query, id, score."""
    width = 1 << STEP_BITS
    dims = values.shape[1]
    q = np.zeros((len(queries), dims), np.int64)
    shared = min(dims, queries.shape[1])
    q[:, :shared] = queries[:, :shared]
    if np.abs(q.astype(np.float64)).sum(axis=1).max(initial=0) * np.abs(values.astype(np.float64)).max(initial=0) > 1 << 58:
        return search_long(ids, values, query_ids, q, k)
    # Twice the contribution, so that the middle of a step is an integer.
    scores = np.zeros((len(ids), len(q)), np.int64 if np.abs(q).sum(axis=1).max(initial=0) * 2 * np.abs(values).max(initial=0) > 1 << 30 else np.int32)
    doubled = np.ascontiguousarray(q.T.astype(scores.dtype))
    own = ids[:, None] == query_ids[None, :]
    size_of_q = np.abs(q).sum(axis=1)
    lowest = np.iinfo(scores.dtype).min // 2

    def possible(left: int) -> np.ndarray:
        """Rows that may be among the best when no impact of more than ``left`` is missing in any dimension."""
        error = size_of_q * max(width - 1, 2 * left)  # of the doubled score
        seen = np.where(own, lowest, scores)
        if len(ids) <= k:
            return ~own
        kth = np.partition(seen, len(ids) - k, axis=0)[len(ids) - k]
        return (seen >= np.maximum(kth - 2 * error, lowest + 1)) & ~own

    members = None
    for number, group in enumerate(groups):
        for dim, step, rows in group:
            scores[rows] += doubled[dim] * (2 * step * width + width - 1)
        last = number == len(groups) - 1
        size = max(s if s >= 0 else -s - 1 for _, s, _ in group)
        if last or 2 * size * width <= 8 * (width - 1):  # before that the bound cannot be tight
            members = possible(0 if last else size * width)
            if members.sum() <= FEW * len(q):
                break
    out: list[list] = [[], [], []]
    for column in range(len(q)):
        rows = np.flatnonzero(members[:, column])
        exact = values[rows].astype(np.int64) @ q[column]
        best = np.lexsort((ids[rows], -exact))[:k]
        out[0].append(np.full(len(best), query_ids[column]))
        out[1].append(ids[rows[best]])
        out[2].append(exact[best])
    return out


def top_k(rows: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``id_col``, ``score``: each query's best ``k`` other rows."""
    vectors = scratch(integer_vectors(rows, id_col, vector_col))
    queries = vectors.filter(is_query)
    n, nq = vectors.count(), queries.count()
    blocks, chunks = buckets_for(n, BLOCK_ROWS), buckets_for(nq, CHUNK_QUERIES)
    index = scratch(build_index(vectors, blocks))
    placed = index.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    asked = queries.withColumn("chunk", F.pmod(F.xxhash64("id", "vec"), F.lit(chunks)).cast("int"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    schema = pa.schema([("query_id", pa.int64()), ("found", pa.int64()), ("score", pa.int64())])

    def search(block: pa.Table, chunk: pa.Table) -> pa.Table:
        if block.num_rows == 0 or chunk.num_rows == 0:
            return schema.empty_table()
        dims = block.column("dims")[0].as_py()
        ids = np.frombuffer(block.column("ids")[0].as_py(), np.int64)
        packed = block.column("values")[0].as_py()
        values = np.frombuffer(packed, np.int64 if len(packed) == 8 * len(ids) * dims else np.int32).reshape(len(ids), dims)
        postings = np.frombuffer(block.column("postings")[0].as_py(), np.int32).reshape(dims, len(ids))
        groups = segments(values, postings)
        query_ids, wanted = chunk.column("id").to_numpy(), _matrix(chunk.column("vec"))
        out: list[list] = [[], [], []]
        for lo in range(0, len(query_ids), BATCH):
            part = search_block(ids, values, groups, query_ids[lo : lo + BATCH], wanted[lo : lo + BATCH], k)
            for column, new in zip(out, part, strict=True):
                column.extend(new)
        return pa.table([np.concatenate(c) for c in out], schema=schema)

    pairs = placed.groupBy("block", "chunk").cogroup(asked.groupBy("block", "chunk"))
    found = pairs.applyInArrow(search, "query_id long, found long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "found")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("found").alias(id_col), "score")
