"""N-gram Jaccard join by parity sketches.

A document's set is its distinct five-word shingles. XOR-hashing the shingles into a sketch makes the sketch of two
sets differ at most where their symmetric difference falls, so the number of differing places is a lower bound
of its size. Two sets with Jaccard similarity of at least 3/4 differ in at most (n + m) / 7 shingles, which is
at most n / 3.

* **Size bands.** Bands are a factor of 4 wide; a set in the upper quarter of its band joins the next one too,
  so partners always meet in a band. All sets of a band share one sketch layout.
* **Pigeonhole.** The sketch is cut into parts, each holding the XOR of its shingles' hashes. A set with ``a``
  non-empty parts has at least ``a - n / 3`` of them in common with any partner. (Bands have so many parts that
  ``a`` exceeds ``n / 3`` by six standard deviations or more; the smallest band has a part per shingle, where it always
  does.) Only parts that two different sets have can matter: a set with too few of those has no partner at
  all, and of the others only the rarest, as many as can fail plus one, are joined on.
* **Verify.** Sets that share a part are compared by sketches of bits (the Hamming distance must not exceed
  (n + m) / 7) and then on their shingles. A set is first verified against the set that it shares most parts
  with among the smallest of each part. After that only pairs from different components are compared, the nearest
  first, more in each round until none is left, so a group of near copies costs a few pairs per member and no link that
  joins two components is lost.

Equal sets are one class from the first step on, so copies cost nothing. Parts travel as packed arrays, one row
per batch and bucket. Work in a bucket is bounded by the number of buckets, which follows the input; large
groups of one part are compared in blocks.

Defined results: a null or empty text, or one without words, has no shingles and is its own component; a text of one
to four words is one shingle; rows that repeat a document id are one document for the component id, which
ignores null ids; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.llm.common import Hasher, buckets_for, mix, pack, record_batch, scratch, text_bytes, text_chunks, whole_texts
from cohortline.llm.graph import connected_components

SMALLEST = 64  # sets below this size are band 0
BUCKET_TEXT = 32 << 20  # bytes of text whose parts share a bucket
FLUSH_PARTS = 1_500_000  # parts that are packed together
LEAST_BUCKETS = 16  # so that small inputs use more than one core
BLOCK = 1024  # sets of one part compared in one task at a time
FIRST_KEYS = 16  # of a set, by which a pair is known in the other parts it shares
_U64 = np.uint64


def bands(n: np.ndarray) -> np.ndarray:
    """The band of each set size."""
    large = np.maximum(n, SMALLEST) // SMALLEST
    return np.where(n < SMALLEST, 0, (np.floor(np.log2(large)) // 2).astype(np.int64) + 1)


def band_end(band: np.ndarray) -> np.ndarray:
    """The first size above a band."""
    return SMALLEST << (2 * band)


def sketch_bits(band: np.ndarray) -> np.ndarray:
    return np.maximum(256, band_end(band))


def distinct_shingles(hasher: Hasher, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every distinct shingle, by text and hash."""
    _, _, hashes, first = hasher.words(offsets, data)
    shingles, valid = hasher.shingles(hashes, first, short=True)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(first))[valid]
    shingles = shingles[valid]
    order = np.argsort(shingles, kind="stable")
    order = order[np.argsort(owner[order], kind="stable")]
    owner, shingles = owner[order], shingles[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (shingles[1:] != shingles[:-1])
    return owner[new], shingles[new]


def fingerprints(owner: np.ndarray, shingles: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and identity of each text's set."""
    n = np.bincount(owner, minlength=texts)
    total = np.zeros(texts, _U64)
    if len(owner):
        present = np.flatnonzero(n)
        starts = np.r_[0, np.cumsum(n[present])[:-1]]
        total[present] = mix(np.add.reduceat(mix(shingles ^ _U64(0x6A09E667F3BCC909)), starts) + n[present].astype(_U64))
    return n, total.view(np.int64)


def parts(owner: np.ndarray, shingles: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and key of every non-empty sketch part, by owner. ``band`` is per owner; a negative one has no sketch."""
    own = band[owner]
    owner, shingles, own = owner[own >= 0], shingles[own >= 0], own[own >= 0]
    if len(owner) == 0:
        return owner, shingles
    scrambled = mix(shingles + _U64(0x3C6EF372FE94F82B))
    count = (band_end(own) // 2).astype(_U64)
    place = ((scrambled >> _U64(32)) * count) >> _U64(32)
    place = np.where(own == 0, scrambled & _U64((1 << 40) - 1), place)
    order = np.argsort(owner.astype(_U64) << _U64(40) | place, kind="stable")
    owner, place, scrambled, own = owner[order], place[order], scrambled[order], own[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (place[1:] != place[:-1])
    starts = np.flatnonzero(new)
    content = np.bitwise_xor.reduceat(scrambled, starts)
    return owner[starts], mix(content ^ mix(place[starts] * _U64(64) + own[starts].astype(_U64)))


def memberships(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The band of each set, and the next one for a set that partners may lie in (-1: none)."""
    band = np.where(n > 0, bands(n), -1)
    above = np.where((band >= 0) & (4 * n >= 3 * band_end(np.maximum(band, 0))), band + 1, -1)
    return band, above


def text_hash(docs: DataFrame) -> Column:
    return F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))


def describe(docs: DataFrame, id_col: str) -> DataFrame:
    """Per document: ``id``, ``text_hash``, ``n`` shingles, ``fp`` of the set, non-empty parts ``a0`` in its band and ``a1`` in the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(lower=True)
        for rows, offsets, data in text_chunks(batches):
            texts = rows.num_rows
            owner, shingles = distinct_shingles(hasher, offsets, data)
            n, fp = fingerprints(owner, shingles, texts)
            a = [np.bincount(parts(owner, shingles, m)[0], minlength=texts) for m in memberships(n)]
            schema = pa.schema([("id", rows.column(0).type), *[(c, pa.int64()) for c in ("text_hash", "n", "fp", "a0", "a1")]])
            yield record_batch(schema, [rows.column(0), rows.column(1), n, fp, *a])

    kept = docs.schema[id_col].dataType.simpleString()
    hashed = docs.select(F.col(id_col).alias("id"), text_hash(docs).alias("text_hash"), "text")
    return whole_texts(hashed, "id", "text_hash").mapInArrow(run, f"id {kept}, text_hash long, n long, fp long, a0 long, a1 long")


def packed_parts(docs: DataFrame, id_col: str, buckets: int) -> DataFrame:
    """Rows (``bucket``, ``packed``): the sets of a batch and the upper half of their keys that fall into the bucket."""

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        fp, flag, keys = (np.concatenate([h[i] for h in held]) for i in range(3))
        bucket = (keys & _U64(0xFFFFFFFF)) % _U64(buckets)
        order = np.argsort(bucket, kind="stable")  # keeps the units in order
        fp, flag, keys, bucket = fp[order], flag[order], (keys[order] >> _U64(32)).astype(np.uint32), bucket[order]
        edges = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(bucket)]
        squeeze = zstandard.ZstdCompressor(level=1)
        numbers, packed = [], []
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            own, side = fp[lo:hi], flag[lo:hi]
            first = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (side[1:] != side[:-1])])
            counts = np.diff(np.r_[first, hi - lo]).astype(np.uint32)
            head = np.array([len(first)], np.uint32)
            body = pack(head) + pack(own[first]) + pack(side[first]) + pack(counts) + pack(keys[lo:hi])
            numbers.append(int(bucket[lo]))
            packed.append(squeeze.compress(body))
        yield record_batch(pa.schema([("bucket", pa.int32()), ("packed", pa.binary())]), [numbers, packed])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, kept, seen = Hasher(lower=True), [], 0, set()
        for rows, offsets, data in text_chunks(batches):
            owner, shingles = distinct_shingles(hasher, offsets, data)
            n, fp = fingerprints(owner, shingles, rows.num_rows)
            fresh = np.zeros(rows.num_rows, bool)
            for i, f in enumerate(fp.tolist()):  # equal sets of a batch count once
                if f not in seen:
                    seen.add(f)
                    fresh[i] = True
            for flag, band in enumerate(memberships(n)):
                unit, keys = parts(owner, shingles, np.where(fresh, band, -1))
                if len(unit):
                    held.append((fp[unit], np.full(len(unit), flag, np.uint8), keys))
                    kept += len(keys)
            if kept >= FLUSH_PARTS:
                yield from flush(held)
                held, kept, seen = [], 0, set()
        if held:
            yield from flush(held)

    return whole_texts(docs, id_col).mapInArrow(run, "bucket int, packed binary")


def _unpacked(packed: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set, flag and key of every entry of a bucket."""
    expand, columns = zstandard.ZstdDecompressor(), ([], [], [])
    for item in packed:
        raw = expand.decompress(item.as_py())
        units = int(np.frombuffer(raw, np.uint32, 1)[0])
        fp = np.frombuffer(raw, np.int64, units, 4)
        flag = np.frombuffer(raw, np.uint8, units, 4 + 8 * units)
        counts = np.frombuffer(raw, np.uint32, units, 4 + 9 * units)
        columns[0].append(np.repeat(fp, counts))
        columns[1].append(np.repeat(flag, counts))
        columns[2].append(np.frombuffer(raw, np.uint32, -1, 4 + 13 * units))
    return tuple(np.concatenate(c) for c in columns)


def shared_parts(packed: DataFrame) -> DataFrame:
    """Keys that at least two different sets have: ``fp``, ``flag``, ``bucket``, ``keys`` (key and how many sets have it)."""
    fields = [("fp", pa.int64()), ("flag", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary())]
    schema = pa.schema(fields)

    def reduce(table: pa.Table) -> pa.Table:
        fp, flag, key = _unpacked(table.column("packed"))
        order = np.lexsort((flag, fp, key))
        fp, flag, key = fp[order], flag[order], key[order]
        new_key = np.r_[True, key[1:] != key[:-1]]
        new_set = new_key | np.r_[True, fp[1:] != fp[:-1]]
        new_entry = new_set | np.r_[True, flag[1:] != flag[:-1]]
        number = np.cumsum(new_key) - 1
        freq = np.bincount(number[new_set])[number]
        keep = new_entry & (freq > 1)
        fp, flag, key, freq = fp[keep], flag[keep], key[keep], freq[keep]
        if len(fp) == 0:
            return schema.empty_table()
        order = np.lexsort((flag, fp))
        fp, flag, both = fp[order], flag[order], np.stack([key, freq], axis=1)[order].astype(np.uint32)
        starts = np.flatnonzero(np.r_[True, (fp[1:] != fp[:-1]) | (flag[1:] != flag[:-1])])
        stops = np.r_[starts[1:], len(fp)]
        keys = [pack(both[lo:hi]) for lo, hi in zip(starts, stops, strict=True)]
        bucket = np.full(len(starts), table.column("bucket")[0].as_py(), np.int32)
        return pa.table([fp[starts], flag[starts].astype(np.int32), bucket, keys], schema=schema)

    return packed.groupBy("bucket").applyInArrow(reduce, "fp long, flag int, bucket int, keys binary")


def joining_parts(classes: DataFrame, shared: DataFrame) -> DataFrame:
    """Sets that can have a partner: ``fp``, ``n``, ``id``, and the ``keys`` they must be joined on."""
    listed = shared.groupBy("fp", "flag").agg(F.collect_list(F.struct("bucket", "keys")).alias("found"))
    joined = listed.join(classes, "fp").select(
        "fp", "n", "id", F.when(F.col("flag") == 0, F.col("a0")).otherwise(F.col("a1")).alias("a"), "found"
    )
    kept = classes.schema["id"].dataType.simpleString()

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys = [], []
            for i, (n, a, found) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("n", "a", "found")), strict=True)):
                both = [np.frombuffer(f["keys"], np.uint32).reshape(-1, 2).astype(np.int64) for f in found]
                full = np.concatenate([(f["bucket"] << 32) | b[:, 0] for f, b in zip(found, both, strict=True)])
                freq = np.concatenate([b[:, 1] for b in both])
                take = len(full) - max(1, a - n // 3) + 1
                if take > 0:
                    rows.append(i)
                    keys.append(full[np.lexsort((full, freq))[:take]])
            schema = pa.schema([("fp", pa.int64()), ("n", pa.int64()), ("id", batch.column("id").type), ("keys", pa.list_(pa.int64()))])
            picked = batch.select(["fp", "n", "id"]).take(pa.array(rows, pa.int64()))
            yield record_batch(schema, [*picked.columns, keys])

    return joined.mapInArrow(choose, f"fp long, n long, id {kept}, keys array<long>")


def survivor_sets(docs: DataFrame, survivors: DataFrame, id_col: str) -> DataFrame:
    """Per class: ``fp``, ``n``, ``band`` of its widest sketch, the ``sketch``, and the ``shingles`` packed and sorted."""
    wanted = survivors.select(F.col("id").alias("_wanted")).distinct()
    texts = whole_texts(docs, id_col).withColumnRenamed(id_col, "id")
    texts = texts.join(wanted, texts["id"].eqNullSafe(wanted["_wanted"]), "left_semi").select("id", "text")
    names = [("fp", pa.int64()), ("n", pa.int64()), ("band", pa.int32()), ("sketch", pa.binary()), ("shingles", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(lower=True)
        for rows, offsets, data in text_chunks(batches):
            owner, shingles = distinct_shingles(hasher, offsets, data)
            n, fp = fingerprints(owner, shingles, rows.num_rows)
            band, above = memberships(n)
            widest = np.maximum(band, above)
            stops = np.cumsum(n)
            sketches, sets = [], []
            for size, stop, b in zip(n, stops, widest, strict=True):
                own = shingles[stop - size : stop]
                sets.append(pack(own))
                bits = np.zeros(int(sketch_bits(max(b, 0))), np.uint8)
                if size:
                    places, odd = np.unique((own >> _U64(7)) & _U64(len(bits) - 1), return_counts=True)
                    bits[places[odd % 2 == 1]] = 1
                sketches.append(pack(np.packbits(bits)))
            yield record_batch(pa.schema(names), [fp, n, widest.astype(np.int32), sketches, sets])

    made = texts.mapInArrow(run, "fp long, n long, band int, sketch binary, shingles binary")
    return made.join(survivors.select("fp").distinct(), "fp", "left_semi").dropDuplicates(["fp"])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (``u``, ``v``) with 100 * intersection >= 75 * union."""
    left = sets.select(F.col("fp").alias("u"), F.col("shingles").alias("set_u"))
    right = sets.select(F.col("fp").alias("v"), F.col("shingles").alias("set_v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("set_u"), batch.column("set_v"), strict=True):
                x, y = np.frombuffer(a.as_buffer(), _U64), np.frombuffer(b.as_buffer(), _U64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= 75 * (len(x) + len(y) - common))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(left, "u").join(right, "v").select("u", "v", "set_u", "set_v")
    return joined.mapInArrow(run, "u long, v long")


def first_pairs(keyed: DataFrame) -> DataFrame:
    """Each set with one other: among the smallest sets of its parts, the one it meets most often."""
    smallest = scratch(keyed.groupBy("key").agg(F.min("fp").alias("v"), F.count(F.lit(1)).alias("m")).filter("m > 1").drop("m"))
    met = keyed.join(smallest, "key").filter("fp <> v").groupBy("fp", "v").agg(F.count(F.lit(1)).alias("c"))
    return met.groupBy(F.col("fp").alias("u")).agg(F.max_by("v", F.struct("c", "v")).alias("v"))


def _folded(sketches: list, bits: np.ndarray, to: int) -> np.ndarray:
    """Sketches of possibly more bits, XOR-folded to ``to`` bits, as 64-bit words."""
    out = np.zeros((len(sketches), to // 64), _U64)
    for i, (raw, size) in enumerate(zip(sketches, bits, strict=True)):
        words = np.frombuffer(raw.as_buffer(), _U64).reshape(int(size) // to, -1)
        out[i] = np.bitwise_xor.reduce(words, axis=0)
    return out


def near_pairs(blocks: DataFrame, most: int) -> DataFrame:
    """Pairs of sets of one part from different components whose sketches allow a link, the nearest first.

    At most ``most`` pairs per set and block; ``more`` tells whether some were left out. A pair that meets in several parts is
    compared in the first of them, as far as the members' ``first_keys`` show; that part stays until the pair had its turn.
    """
    schema = pa.schema([("key", pa.int64()), ("u", pa.int64()), ("v", pa.int64()), ("more", pa.bool_())])

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("fp")
        key = table.column("key")[0].as_py()
        fp, n, comp = (table.column(c).to_numpy() for c in ("fp", "n", "component"))
        side = table.column("side").to_numpy()
        same_block = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        bits = sketch_bits(table.column("band").to_numpy().astype(np.int64))
        words = _folded(list(table.column("sketch")), bits, int(bits.min()))
        seen = None  # worked out for the first pair that is near
        out_u, out_v, more = [], [], []
        rows = np.arange(len(fp)) if same_block else np.flatnonzero(side == 0)
        others = np.arange(len(fp)) if same_block else np.flatnonzero(side == 1)
        for i in rows:
            fit = others[(comp[others] != comp[i]) & (4 * np.minimum(n[others], n[i]) >= 3 * np.maximum(n[others], n[i]))]
            if len(fit) == 0:
                continue
            distance = np.bitwise_count(words[fit] ^ words[i]).sum(axis=1, dtype=np.int64)
            near = 7 * distance <= n[fit] + n[i]
            fit, distance = fit[near], distance[near]
            if len(fit) == 0:
                continue
            if seen is None:
                seen = _earlier_keys(table.column("first_keys").combine_chunks(), key)
            here = ~(seen[fit] & seen[i]).any(axis=1)
            fit, distance = fit[here], distance[here]
            best = np.lexsort((fp[fit], distance))[:most]
            out_u.append(np.full(len(best), fp[i]))
            out_v.append(fp[fit[best]])
            more.append(np.full(len(best), len(fit) > most))
        if not out_u:
            return schema.empty_table()
        u, v = np.concatenate(out_u), np.concatenate(out_v)
        return pa.table([np.full(len(u), key), np.maximum(u, v), np.minimum(u, v), np.concatenate(more)], schema=schema)

    return blocks.groupBy("key", "i", "j").applyInArrow(compare, "key long, u long, v long, more boolean")


def _earlier_keys(lists: pa.Array, key: int) -> np.ndarray:
    """Which of the keys before ``key`` each list has, as bits of 64-bit words."""
    owner = lists.value_parent_indices().to_numpy()
    keys = lists.flatten().to_numpy()
    owner, keys = owner[keys < key], keys[keys < key]
    _, number = np.unique(keys, return_inverse=True)
    out = np.zeros((len(lists), max(1, -(-(int(number.max()) + 1) // 64) if len(number) else 1)), _U64)
    np.bitwise_or.at(out, (owner, number // 64), _U64(1) << (number % 64).astype(_U64))
    return out


def in_blocks(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """Members of each part dealt to pairs of blocks of about ``BLOCK`` sets, so that all pairs of blocks meet."""
    dealt = members.join(sizes, "key").withColumn("b", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    partner = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return partner.select(
        "*", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), F.when(F.col("b") <= F.col("o"), 0).otherwise(1).alias("side")
    ).drop("blocks", "b", "o")


def link_components(survivors: DataFrame, sets: DataFrame) -> DataFrame:
    """``node`` (a class) and ``component`` for every class that is linked to another."""
    keyed = scratch(survivors.select("fp", F.explode("keys").alias("key")))
    links = scratch(verified(first_pairs(keyed), sets))
    tried = left = None
    most = 1
    while True:
        components = scratch(connected_components(links))
        labelled = keyed.join(components, keyed["fp"] == components["node"], "left").select(
            "key", "fp", F.coalesce("component", "fp").alias("component")
        )
        # Parts whose sets are all in one component have nothing to add; parts with the same sets add it once.
        per_key = labelled.groupBy("key").agg(
            F.count(F.lit(1)).alias("m"),
            F.min("component").alias("low"),
            F.max("component").alias("high"),
            F.sum(F.xxhash64("fp").cast("decimal(38,0)")).alias("members"),
        )
        if left is not None:  # all pairs of the other parts have been compared
            per_key = per_key.join(left, "key", "left_semi")
        open_keys = per_key.filter("low <> high").groupBy("m", "members").agg(F.min("key").alias("key"))
        sizes = scratch(open_keys.select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")))
        facts = sets.select("fp", "n", "band", "sketch")
        opened = labelled.join(sizes.select("key"), "key", "left_semi")
        first_keys = opened.groupBy("fp").agg(F.slice(F.array_sort(F.collect_list("key")), 1, FIRST_KEYS).alias("first_keys"))
        # Part by part the sets are few, but a set takes part in many; its sketch joins only where it is compared.
        members = in_blocks(labelled, sizes).join(facts, "fp").join(first_keys, "fp")
        found = scratch(near_pairs(members, most))
        pairs = found.select("u", "v").distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["u", "v"], "left_anti")
        pairs = scratch(pairs)
        tried = pairs if tried is None else tried.unionByName(pairs)
        new = scratch(verified(pairs, sets))
        if not new.isEmpty():
            links = links.unionByName(new)
        left = scratch(found.filter("more").select("key").distinct())
        if not left.isEmpty():
            most *= 8
            continue
        return connected_components(links) if not new.isEmpty() else components


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document: ``id``, ``text_hash``, ``n``, ``fp`` of its set, ``component`` and ``component_id``, the smallest id reachable by links."""
    size = text_bytes(docs)
    info = scratch(describe(docs, id_col))
    classes = scratch(
        info.filter("n > 0").groupBy("fp", "n").agg(F.min("id").alias("id"), F.first("a0").alias("a0"), F.first("a1").alias("a1"))
    )
    shared = shared_parts(packed_parts(docs, id_col, buckets_for(size, BUCKET_TEXT, LEAST_BUCKETS)))
    survivors = scratch(joining_parts(classes, shared))
    sets = scratch(survivor_sets(docs, survivors, id_col))
    components = link_components(survivors, sets)
    labelled = classes.join(components, classes["fp"] == components["node"], "left").select(
        "fp", "n", "id", F.coalesce("component", "fp").alias("component")
    )
    smallest = labelled.groupBy("component").agg(F.min("id").alias("component_id"))
    named = labelled.join(smallest, "component").select(F.col("fp").alias("_fp"), F.col("n").alias("_n"), "component", "component_id")
    out = info.join(named, (info["fp"] == named["_fp"]) & (info["n"] == named["_n"]), "left")
    return out.select("id", "text_hash", "n", "fp", "component", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id_col``, ``n_shingles``, ``component_id`` per document."""
    found = near_duplicate_classes(docs, id_col)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def keep_first_of_each(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without those that have an earlier near duplicate; documents without shingles all stay.

    The first of a component is the document with the smallest id, null ids last, and of these the one with the smallest
    hash of its text. Documents are judged by id and text, so different texts under one id have their own verdicts. Of
    several rows equal in id and text, all stay if one does.
    """
    found = scratch(near_duplicate_classes(docs, id_col).filter("n > 0"))
    order = F.struct(F.col("id").isNull(), "id", "text_hash")
    first = found.groupBy("component").agg(F.min(order).alias("first"))
    gone = found.join(first, "component").filter(order > F.col("first")).select(F.col("id").alias("_gone"), F.col("text_hash").alias("_gone_text"))
    same = docs[id_col].eqNullSafe(F.col("_gone")) & (text_hash(docs) == F.col("_gone_text"))
    return docs.join(gone.distinct(), same, "left_anti")
