"""Periodic runs against a plain search, and the query's columns against the contract said plainly."""

import hashlib
import random
import zlib

import numpy as np
import odd
import pytest
from pyspark.sql import functions as F

from cohortline.llm import catalog, periodic_runs

FOLDER = "/root/testdata/sf0.001"


def plain_runs(words):
    """Every period in turn: stretches in which words a period apart are equal."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(12, 2 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, q, e - s) for (s, e), q in found.items())


def planted(doc_id, text):
    words = odd.WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def plain_digest(doc_id, text):
    words = planted(doc_id, text)
    runs = plain_runs(words)
    gone = {i for s, q, length in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[2], r[0], r[1]), default=None)
    listed = "".join(f"{s},{length},{q}\n" for s, q, length in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (
        doc_id,
        len(runs),
        *((best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4),
        hashlib.sha256(listed.encode()).hexdigest(),
        hashlib.sha256(kept.encode()).hexdigest(),
    )


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def in_order(rows):
    return sorted(map(tuple, rows), key=repr)


def test_cover_holds_every_difference():
    d = periodic_runs.COVER
    assert {(a - b) % periodic_runs.PERIOD for a in d for b in d} == set(range(periodic_runs.PERIOD))


@pytest.mark.parametrize("seed", range(40))
def test_runs_of_small_alphabets(seed, monkeypatch):
    draw = random.Random(seed)
    if seed % 2:
        monkeypatch.setattr(periodic_runs, "BLOCK", 50)
    docs = []
    for _ in range(draw.randint(0, 6)):
        n, letters = draw.choice([0, 1, 5, 12, 40, 100, 400]), draw.choice([1, 2, 3, 8])
        words = [draw.randrange(letters) for _ in range(n)]
        if n > 20 and seed % 3:
            a, p = draw.randrange(n), draw.randint(1, max(1, n // 4))
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        docs.append(words)
    counts = np.array([len(w) for w in docs], np.int64)
    starts = np.cumsum(counts + 1) - counts - 1
    values = np.array([v for i, w in enumerate(docs) for v in [*w, 100 + i]], np.int64)
    want = [(s + at, s + at + length, q) for w, at in zip(docs, starts.tolist(), strict=True) for s, q, length in plain_runs(w)]
    got = [tuple(map(int, r)) for r in periodic_runs.runs_of(values, starts, counts)]
    assert got == sorted(want, key=lambda r: (r[0], r[2]))


def test_extensions_of_all_pairs():
    draw = random.Random(3)
    values = np.array([draw.randrange(2) for _ in range(150)] * 2 + [7], np.int64)
    n = len(values)
    left, right = (a.ravel() for a in np.meshgrid(np.arange(n), np.arange(n)))
    left, right = left[left != right], right[left != right]
    got = periodic_runs.Extensions(values)(left, right)
    for a, b, length in zip(left[::37], right[::37], got[::37], strict=True):
        k = 0
        while max(a, b) + k < n and values[a + k] == values[b + k]:
            k += 1
        assert k == length


def test_query_on_whole_texts(spark):
    """All documents of the smallest table up to 4,000 words (the plain search is quadratic), all through one run."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in catalog.QUERIES["op11_periodic_runs"](spark, FOLDER).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert got.keys() == texts.keys()
    short = [(d, t) for d, t in texts.items() if len(odd.WORD.findall(t or "")) <= 4000]
    assert len(short) > 0.9 * len(texts) and any(planted(d, t) != odd.WORD.findall(t or "") for d, t in short)
    for d, t in short:
        assert got[d] == plain_digest(d, t)


def test_odd_rows(spark):
    df = spark.createDataFrame(odd.rows(), odd.SCHEMA)
    texts = periodic_runs.with_planted_repeats(df)
    got = periodic_runs.digest(periodic_runs.find_runs(texts)).select(COLUMNS).collect()
    assert in_order(got) == in_order(plain_digest(d, t) for d, t in odd.texts())
    assert periodic_runs.find_runs(df.limit(0)).count() == 0


def test_runs_and_texts(spark):
    data = [(1, "x " + "a b c " * 5 + "a end"), (2, "go " * 11), (3, "go " * 12), (4, "a b c d e f a b c d e f"), (5, None)]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("runs", F.lit("clash"))
    got = {r.doc_id: (r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.find_runs(df).collect()}
    assert got == {
        1: (18, [(1, 16, 3)], "x a b c end"),
        2: (11, [], " ".join(["go"] * 11)),
        3: (12, [(0, 12, 1)], "go"),
        4: (12, [(0, 12, 6)], "a b c d e f"),
        5: (0, [], ""),
    }
