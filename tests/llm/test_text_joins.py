"""Line dedup, n-gram join and substring dedup against plain versions, on odd rows and with every limit forced."""

import time

import pytest
from odd import components, cut_repeats, empty, kept_lines, odd, shingles, texts, unique_pairs

from cohortline.llm import line_dedup, near_duplicates, substring_dedup
from cohortline.llm.graph import connected_components

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    return docs, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def test_components_on_odd_rows(spark):
    got = near_duplicates.near_duplicates(odd(spark)).collect()
    assert len(got) == len(texts())
    want = components(unique_pairs())
    named = {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None}
    assert named == want
    nameless = sorted((r.n_shingles, r.component_id) for r in got if r.doc_id is None)
    assert nameless == [(0, None), (46, None)]
    assert near_duplicates.near_duplicates(empty(spark)).count() == 0


def test_components_on_documents(small):
    docs, pairs = small
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.near_duplicates(docs).collect()}
    assert got == components(pairs)


def test_components_of_a_family_linked_only_through_its_middle(spark, monkeypatch):
    """Copies that each changed other words are near the original, not near one another; blocks of a few sets."""
    monkeypatch.setattr(near_duplicates, "BLOCK", 7)
    import random

    draw = random.Random(5)
    original = [f"w{i}" for i in range(300)]
    pairs = [(40, " ".join(original))]
    for i in range(40):
        words = list(original)
        for at in draw.sample(range(300), 6):
            words[at] = f"x{i}_{at}"
        pairs.append((i, " ".join(words)))
    pairs += [(100 + i, " ".join(original[:60]) + " " + " ".join(f"y{i}_{j}" for j in range(40))) for i in range(30)]
    docs = spark.createDataFrame(pairs, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.near_duplicates(docs).collect()}
    want = components(pairs)
    assert got == want
    assert sum(c == 0 for _, c in want.values()) == 41


def test_a_pair_is_compared_in_one_of_its_parts(spark):
    """Forty sets in their own components that share five parts, and one more part that only two of them share."""
    from pyspark.sql import functions as F

    sets = spark.createDataFrame([(fp, 30, 0, bytearray(32), fp) for fp in range(40)], "fp long, n long, band int, sketch binary, component long")
    shared = sets.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.when(F.col("fp").isin(7, 8), 6).otherwise(5).cast("long"))).alias("key"))
    blocks = shared.withColumns({"i": F.lit(0), "j": F.lit(0), "side": F.lit(0), "first_keys": F.array(*[F.lit(k).cast("long") for k in range(1, 6)])})
    found = near_duplicates.near_pairs(blocks, 100).collect()
    assert len(found) == 40 * 39 and {r["key"] for r in found} == {1}
    assert {(r["u"], r["v"]) for r in found} == {(u, v) for u in range(40) for v in range(u)}
    few = near_duplicates.near_pairs(blocks, 3).collect()
    assert len(few) == 40 * 3 and all(r["more"] for r in few)
    late = blocks.filter("key = 6").withColumn("first_keys", F.array(F.lit(6).cast("long")))
    assert {(r["key"], r["u"], r["v"]) for r in near_duplicates.near_pairs(late, 3).collect()} == {(6, 8, 7)}


def test_band_borders(spark):
    """Pairs of all sizes around the bands, exactly at the threshold and just below it."""
    pairs = []
    for n in (3, 4, 7, 8, 47, 48, 60, 63, 64, 65, 70, 190, 255, 256, 260):
        words = [f"a{n}_{i}" for i in range(n + 4)]
        for drop in range(1, n):
            # The set of the shorter text lies inside the other's.
            if abs(4 * (n - drop) - 3 * n) <= 4:
                pairs.append((len(pairs), f"b{drop} " * 0 + " ".join(words[: len(words) - drop])))
        pairs.append((len(pairs), " ".join(words)))
    docs = spark.createDataFrame(pairs, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.near_duplicates(docs).collect()}
    assert got == components(pairs)


def test_keep_first_keeps_columns_and_strangers(spark):
    kept = near_duplicates.keep_first_of_each(odd(spark))
    assert kept.columns == odd(spark).columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    want = components(unique_pairs())
    assert ids == sorted(d for d, t in texts() if d is not None and (want[d][1] == d or not shingles(t)))


def test_keep_first_judges_by_id_and_text(spark):
    one, two, three = (" ".join(f"{name}{i}" for i in range(60)) for name in ("a", "b", "c"))
    rows = [(1, one), (2, one), (2, two), (None, one), (None, three), (None, three + " tail"), (None, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {(r.doc_id, r.text) for r in near_duplicates.keep_first_of_each(docs).collect()}
    thirds = kept & {(None, three), (None, three + " tail")}
    assert len(thirds) == 1
    assert kept - thirds == {(1, one), (2, two), (None, None), (3, "")}


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(200, 260)] + [(5, 9), (9, 7), (300, 5), (7, 7)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == {**{i: 200 for i in range(200, 261)}, 5: 5, 9: 5, 7: 5, 300: 5}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_lines_on_odd_rows(spark):
    docs = odd(spark)
    got = line_dedup.dedup_lines(docs)
    assert got.columns == [*docs.columns, "_dropped_lines", "_kept_lines"]
    found = got.collect()
    assert len(found) == len(texts())
    want = kept_lines(unique_pairs())
    assert {r.doc_id: r.text for r in found if r.doc_id is not None} == want
    assert all(r._dropped_lines + r._kept_lines == len(t.split("\n")) for r in found for d, t in texts() if d == r.doc_id and t and d)
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_near_lines(spark):
    pairs = [
        (1, "a b c d e f"),
        (2, "a b X d e f"),  # changed
        (3, "a b c d e f g"),  # added at the end
        (4, "z a b c d e f"),  # added in front
        (5, "b c d e f"),  # left out in front
        (6, "a b c e f d"),  # moved: two changes
        (7, "a  b\tc d e   f"),  # the same words
        (8, "a b c d"),  # too short
        (9, "a b c d"),
        (10, "p p p p p p"),
        (11, "p p p p p"),
    ]
    docs = spark.createDataFrame(pairs, "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert got == kept_lines(pairs)
    assert [d for d, t in got.items() if t == ""] == [2, 3, 4, 5, 7, 11]


def test_lines_without_quadratic_work(spark):
    """A text of many lines and a line of many words take seconds."""
    lines = [f"a{i} b{i} c{i} d{i} e{i}" for i in range(40_000)]
    words = [f"w{i}" for i in range(40_000)]
    changed = [*words[:20_000], "other", *words[20_001:]]
    pairs = [(1, "\n".join([*lines, lines[7], "x y", "x y"])), (2, " ".join(words)), (3, " ".join(changed)), (4, " ".join(words[1:]))]
    began = time.monotonic()
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(pairs, "doc_id long, text string")).collect()}
    assert time.monotonic() - began < 40
    assert {d: r.text for d, r in got.items()} == {1: "\n".join([*lines, "x y", "x y"]), 2: pairs[1][1], 3: "", 4: ""}
    assert (got[1]._dropped_lines, got[1]._kept_lines) == (1, 40_002)


def test_near_lines_of_every_length(spark):
    """A word changed, left out or added at every place, around the borders of the blocks that are hashed together."""
    pairs, want = [], {}
    for n in (6, 7, 8, 9, 15, 16, 17, 18):
        line = [f"w{i}" for i in range(n)]
        near = [[*line[:i], *new, *line[j:]] for i in range(n + 1) for j in (i, i + 1) if j <= n for new in ((), ("n",)) if new or j > i]
        far = [[*line[:i], "n", *line[i + 1 :], "m"] for i in range(n)]
        for other, stays in [*((t, False) for t in near), *((t, True) for t in far)]:
            own = len(pairs)  # no words in common with other pairs
            pairs += [(own + m, " ".join(f"{w}x{own}" for w in t)) for m, t in enumerate((line, other))]
            want |= {own: pairs[-2][1], own + 1: pairs[-1][1] if stays else ""}
    docs = spark.createDataFrame(pairs, "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()} == want


def test_substrings_on_odd_rows(spark):
    got = substring_dedup.dedup_substrings(odd(spark)).collect()
    assert len(got) == len(texts())
    want = cut_repeats([(d, t) for d, t in unique_pairs()])
    # Null ids come after all others.
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got if r.doc_id is not None} == want
    assert substring_dedup.dedup_substrings(empty(spark)).count() == 0


def test_substrings_with_frequent_keys(spark, small, monkeypatch):
    monkeypatch.setattr(substring_dedup, "FREQUENT", 2)
    monkeypatch.setattr(substring_dedup, "SNIPPET_BUCKET", 1 << 12)
    monkeypatch.setattr(substring_dedup, "BUCKET_TEXT", 1 << 14)
    docs, pairs = small
    got = substring_dedup.dedup_substrings(docs, keep_bytes=False).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == cut_repeats(pairs)


def test_suffix_order():
    import random

    import numpy as np

    draw = random.Random(3)
    for _ in range(100):
        letters = [0, 1, 97, 98, 255][: draw.randint(1, 5)]
        data = np.array([draw.choice(letters) for _ in range(draw.randint(1, 400))], np.uint8)
        if draw.random() < 0.3:
            data = np.r_[data, data, data[:50]]
        order, raw = substring_dedup.suffix_order(data).tolist(), data.tobytes()
        assert sorted(order) == list(range(len(raw)))
        starts = [raw[i : i + substring_dedup.WIDTH] for i in order]
        assert starts == sorted(starts)
