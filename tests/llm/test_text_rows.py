"""Operators that judge or rewrite each document, on odd rows and against plain versions."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from odd import WORD, empty, odd, texts
from pyspark.sql import functions as F

from cohortline import session
from cohortline.llm import byte_bpe, mixing, personal_data, quality_rules, resampling, toxicity, vector_search

FOLDER = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


# --- byte-level BPE


@pytest.fixture(scope="module")
def reference_encoding():
    ranks = byte_bpe.read_ranks(RANKS)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_agree_and_decode(spark, docs, reference_encoding):
    for frame in (odd(spark), docs):
        encoded = byte_bpe.encode(frame, RANKS, public_tokenizers.PATTERN)
        want = Counter((d, tuple(reference_encoding.encode_ordinary(t or ""))) for d, t in frame.select("doc_id", "text").collect())
        assert Counter((r.doc_id, tuple(r.ids)) for r in encoded.collect()) == want
        decoded = byte_bpe.decode(encoded, RANKS).collect()
        assert Counter((r.doc_id, bytes(r.decoded)) for r in decoded) == Counter(
            (d, (t or "").encode()) for d, t in frame.select("doc_id", "text").collect()
        )
    assert byte_bpe.encode(empty(spark), RANKS, public_tokenizers.PATTERN).count() == 0


def test_long_pieces(reference_encoding):
    codec = byte_bpe.Codec(byte_bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    import random

    draw = random.Random(1)
    for text in ("a" * 5000, "ab" * 3000, " " * 3000 + "x", "日本" * 800, "".join(draw.choice("abcdefghij") for _ in range(9000))):
        assert codec.encode(text) == reference_encoding.encode_ordinary(text)
    for _ in range(500):
        text = "".join(draw.choice("abAB éü日\n  \U0001f600$%123\t") for _ in range(draw.randint(0, 60)))
        assert codec.encode(text) == reference_encoding.encode_ordinary(text)


def test_digest(spark, reference_encoding):
    for r in byte_bpe.digest(odd(spark), RANKS, public_tokenizers.PATTERN).collect():
        if r.doc_id == 5:
            assert (r.n_tokens, r.ids_sha256) == (0, hashlib.sha256(b"").hexdigest())


# --- personal data


def plain_spans(text):
    """The base patterns as regular expressions."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m.group())
        total = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
        if 12 <= len(digits) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_base_spans(spark, docs):
    find = personal_data.automaton()
    import random

    draw = random.Random(2)
    cases = [t or "" for _, t in texts()] + [r.text for r in docs.select("text").collect()]
    cases += ["".join(draw.choice("ab.@-1234567890 +()İé://") for _ in range(draw.randint(0, 80))) for _ in range(3000)]
    cases += ["1.2.3.4.5.6.7.8", "999.1.1.1", "a@b", "a@b.c@d.e", "+1 555 010 9999 +44", "٣.1.1.1.1", "00010.1.1.1", "0" * 4000 + "1.2.3.4"]
    for text in cases:
        spans = personal_data.spans_of(text, find)
        assert [s for s in spans if s[1] < 4] == plain_spans(text), text


def test_added_spans(spark):
    text = "see https://x.example/a?b=1. IBAN: DE89 3704 0044 0532 0130 00 now, account no 123-456-789, token = \"abcdef0123456789\""
    rows = [(1, text), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.found for r in personal_data.find_personal_data(df).collect()}
    assert [(f.kind, text[f.start : f.end]) for f in found[1] if not f.base] == [
        ("url", "https://x.example/a?b=1"),
        ("iban", "DE89 3704 0044 0532 0130 00"),
        ("account", "123-456-789"),
        ("secret", "abcdef0123456789"),
    ]
    assert found[2] == []
    assert personal_data.digest(odd(spark)).count() == len(texts())
    assert personal_data.digest(empty(spark)).count() == 0


# --- mixing


def test_mix_on_odd_rows(spark):
    got = mixing.mix(odd(spark)).collect()
    assert len(got) == len(texts())
    assert all(r["size"] == len(WORD.findall(t or "")) for r in got for d, t in texts() if d == r.doc_id and d)
    by_source = {r.source: r for r in got}
    assert sum(r.target for r in by_source.values()) == pytest.approx(1.5 * sum(r.source_size for r in by_source.values()))
    assert all(r.target <= 2 * r.source_size + 1e-9 and r.taken <= 2 * r["size"] for r in got)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(odd(spark).repartition(7)).collect()), key=str)
    assert mixing.mix(empty(spark)).count() == 0
    mixed = mixing.mixed_documents(odd(spark))
    assert mixed.columns == odd(spark).columns


def test_mix_comes_near_its_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 50)
    rows = [(i, "w " * (1 + i * 7919 % 90), "abc"[min(i % 5, 2)]) for i in range(4000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    totals = got.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 2 for r in totals)


# --- toxicity


def test_clause_grammar():
    lexicon = toxicity.Lexicon({"idiot$": 4.0, "stup": 2.0})

    def weight(clause):
        return toxicity.clause_weight([lexicon.symbol(w) for w in toxicity.TOKEN.findall(clause)])

    assert weight("a fine day") == 0
    assert weight("idiot") == 4.0
    assert weight("stupidity") == 2.0
    assert weight("you idiot") == pytest.approx(4.0 * toxicity.AIMED)
    assert weight("not an idiot") == pytest.approx(4.0 * toxicity.NEGATED)
    assert weight("she said something about an idiot") < weight("something about an idiot") * 0.7
    assert weight("kill the process") == 0
    assert weight("kill you") == weight("you kill") == 3.0


def test_toxicity_learns_and_never_reads_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = toxicity.judge(docs, labels).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.toxic == held.predicted).mean() > 0.95
    assert got.score.between(0, 1).all()
    flipped = labels.withColumn("toxic", F.when(toxicity.is_held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.judge(docs, flipped)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, toxicity.judge(docs, labels).collect()))


def test_toxicity_on_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (7, 0)], "doc_id long, toxic int")
    assert toxicity.judge(odd(spark), labels).count() == len(texts())
    assert toxicity.judge(empty(spark), labels).count() == 0
    assert toxicity.keep_clean(odd(spark), labels).columns == odd(spark).columns


# --- quality rules


def plain_measures(text):
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_measures(spark, docs):
    for frame in (odd(spark), docs):
        given = Counter((d, plain_measures(t or "")) for d, t in frame.select("doc_id", "text").collect())
        got = quality_rules.judge(frame).collect()
        assert Counter((r.doc_id, tuple(r[m] for m in quality_rules.MEASURES)) for r in got) == given
        for r in got:
            assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
            assert not (r.kept and r.base_failed)
    assert quality_rules.judge(empty(spark)).count() == 0


def test_model_sums_to_one():
    import random

    draw = random.Random(4)
    classes = np.array([draw.choice([1, 2, 2, 3, 5]) for _ in range(4000)])
    owner = np.arange(4000) // 50
    codes, counts = np.unique(quality_rules.grams(owner, classes, 4), return_counts=True)
    tables = quality_rules.kneser_ney(codes, counts)
    for history in ([1, 2, 3], [5, 5, 5], [0, 0, 0], [9, 1, 2]):
        own = [h for h in history if h]
        total = 0.0
        for c in range(64):
            line = np.array([*own, c])
            total += math.exp(quality_rules.log_probability(tables, np.zeros(len(line), int), line)[-1])
        assert total == pytest.approx(1.0, abs=1e-4)


def test_junk_is_rejected(spark):
    clean = [(i, "en", " ".join(f"w{j * 31 % 97}ord{(j * j + i) % 13}" for j in range(200 + i))) for i in range(60)]
    junk = [(1000, "en", "zq#@!xj^^ " * 3 + " ".join(f"%{j}~zq{j * 7}" for j in range(200)))]
    got = {r.doc_id: r.kept for r in quality_rules.judge(spark.createDataFrame(clean + junk, "doc_id long, lang string, text string")).collect()}
    assert not got[1000]
    assert sum(got.values()) >= 58


@pytest.mark.parametrize("n_copies", [150, 400])
def test_copies_leave_the_band(spark, n_copies):
    import random

    draw = random.Random(6)
    words = ["".join(draw.choice("aeioulnrst") for _ in range(draw.randint(2, 9))) for _ in range(400)]
    clean = [(i, "en", " ".join(draw.choice(words) for _ in range(150))) for i in range(100)]
    copies = [(1000 + i, "en", clean[0][2]) for i in range(n_copies)]
    rows = spark.createDataFrame(clean + copies, "doc_id long, lang string, text string")
    got = {r.doc_id: r.kept for r in quality_rules.judge(rows).collect()}
    assert sum(got[i] for i, _, _ in clean) >= 95
    assert all(got[i] for i, _, _ in copies)


def test_words_in_random_order_are_rejected(spark):
    import random

    draw = random.Random(8)
    # Equal ends, so that four characters say nothing about the order of words.
    stems = ["tala" + "".join(draw.choice("aeioulnrst") for _ in range(4)) + "nana" for _ in range(300)]
    after = {w: draw.sample(stems, 4) for w in stems}

    def walk(n):
        out = [draw.choice(stems)]
        while len(out) < n:
            out.append(draw.choice(after[out[-1]]))
        return out

    clean = [walk(draw.randint(150, 250)) for _ in range(200)]
    salad = [draw.sample(words, len(words)) for words in clean[:8]]
    rows = [(i, "en", " ".join(words)) for i, words in enumerate(clean + salad)]
    got = {r.doc_id: r.kept for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, lang string, text string")).collect()}
    assert sum(got[i] for i in range(200)) >= 190
    assert not any(got[i] for i in range(200, 208))


def plain_word_entropy(texts):
    """Interpolated Kneser-Ney on token trigrams, every occurrence scored by the counts without itself."""
    split = re.compile(r"[\u0800-\U0010ffff]|[^\x20\x09-\x0D\u0800-\U0010ffff]+")
    rows = {t: [None, None, *split.findall(t)] for t in texts}
    three = Counter(gram for row in rows.values() for gram in zip(row, row[1:], row[2:], strict=False))
    two = Counter((v, w) for _, v, w in three)
    one = Counter(w for _, w in two)
    uv, uv_types, v_all, v_types = Counter(), Counter(), Counter(), Counter()
    for (u, v, _), n in three.items():
        uv[u, v] += n
        uv_types[u, v] += 1
    for (v, _), n in two.items():
        v_all[v] += n
        v_types[v] += 1

    def discount(counts):
        once, twice = (sum(n == k for n in counts.values()) for k in (1, 2))
        return min(max(once / max(once + 2 * twice, 1), 0.05), 0.95)

    def smoothed(n, total, types, d, below):
        return (max(n - d, 0) + d * types * below) / total if total > 0 else below

    d1, d2, d3 = map(discount, (one, two, three))

    def probability(u, v, w):
        own = three[u, v, w] == 1  # without it, its pair loses a trigram
        gone = own and two[v, w] == 1
        low = (max(one[w] - gone - d1, 0) + d1) / sum(one.values())
        low = smoothed(two[v, w] - own, v_all[v] - own, v_types[v] - gone, d2, low)
        return smoothed(three[u, v, w] - 1, uv[u, v] - 1, uv_types[u, v] - own, d3, low)

    return {
        t: (-sum(math.log(probability(*g)) for g in zip(row, row[1:], row[2:], strict=False)) / (len(row) - 2), len(row) - 2)
        for t, row in rows.items()
        if len(row) > 2
    }


@pytest.mark.parametrize(("bucket_bytes", "turns"), [(300, 3), (2000, 2), (1 << 30, 1)])
def test_token_scores_are_those_of_plain_counts(spark, bucket_bytes, turns):
    import random

    draw = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["the"] * 60 + ["日本", "語", "é日x", "😀"]
    rows = [" ".join(draw.choice(words) for _ in range(draw.randint(0, 60))) for _ in range(80)]
    rows += rows[:20] * 3 + ["the the the the the", "", "  ", None]
    docs = spark.createDataFrame([(t,) for t in rows], "text string").repartition(7)
    assert len(quality_rules.frequent_middles(docs, 20)) > 0
    got = quality_rules.token_scores(docs, bucket_bytes, turns).collect()
    hashed = {r[1]: r[0] or "" for r in docs.select("text", F.xxhash64(F.coalesce("text", F.lit("")))).collect()}
    expected = plain_word_entropy({t or "" for t in rows})
    assert {hashed[r._text_hash]: r.n_tokens for r in got} == {t: n for t, (_, n) in expected.items()}
    assert len(got) == len(expected)
    for r in got:
        assert r.word_entropy == pytest.approx(expected[hashed[r._text_hash]][0], rel=1e-9)
    assert quality_rules.token_scores(empty(spark), bucket_bytes, turns).count() == 0


def test_many_words_in_a_bucket_are_counted_alike(spark, monkeypatch):
    docs = odd(spark).select("text").union(spark.createDataFrame([("a b a b c a b",), ("b a b c",)], "text string"))
    frequent = quality_rules.frequent_middles(docs, 2)
    rows = quality_rules.trigrams(docs, frequent, 1, 0, 1).toArrow()
    by_key = [quality_rules.BucketCounts(rows, frequent, scored) for scored in (True, False)]
    monkeypatch.setattr(quality_rules, "ONE_KEY_WORDS", 0)
    by_columns = [quality_rules.BucketCounts(rows, frequent, scored) for scored in (True, False)]
    for one, other in zip(by_key, by_columns, strict=True):
        for name in ("n", "v", "w", "pair_n", "shared"):
            assert np.array_equal(getattr(one, name), getattr(other, name))
    for name in ("triple", "context", "context_total", "context_types", "pair"):
        assert np.array_equal(getattr(by_key[0], name), getattr(by_columns[0], name))


def test_trigrams_are_not_written(spark, monkeypatch, tmp_path):
    import random

    draw = random.Random(9)
    words = ["".join(draw.choice("aeioulnrst") for _ in range(6)) for _ in range(3000)]
    rows = [(i, "en", " ".join(draw.choice(words) for _ in range(300))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    monkeypatch.setattr(session, "shared_folder", lambda spark: str(tmp_path))
    assert quality_rules.judge(docs).count() == 300
    written = sum(f.stat().st_size for f in tmp_path.rglob("*.parquet"))
    assert 0 < written < sum(len(t) for _, _, t in rows)


def test_tokens_are_words_and_wide_code_points():
    hasher = quality_rules.Hasher(lower=False)

    def found(text):
        data = np.frombuffer(text.encode(), np.uint8)
        return quality_rules.tokens(hasher, np.array([0, len(data)]), data)[1].tolist()

    assert found("日本 é1") == found("日") + found("本") + found("é1")
    assert found("ab日c d") == found("ab") + found("日") + found("c") + found("d")
    assert len(set(found("日月火水木 1 2 12"))) == 8


# --- importance resampling


def test_resampling_prefers_the_target(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = resampling.resample(docs, labels.filter("quality = 1"), share=0.85)
    assert got.filter("kept").count() == 850
    table = got.join(labels, "doc_id").toPandas()
    assert table[table.quality == 1].kept.mean() > 0.95
    assert table[table.quality == 0].kept.mean() < 0.2


def test_threshold_narrows(spark, monkeypatch):
    monkeypatch.setattr(resampling, "FEW_KEYS", 5)
    monkeypatch.setattr(resampling, "BINS", 4)
    rows = [(i, float(i * 7919 % 1000) // 3) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, key double")
    ordered = sorted(rows, key=lambda r: (-r[1], r[0]))
    for k in (1, 2, 499, 1000):
        assert resampling.threshold(df, k, "key", "doc_id") == (ordered[k - 1][1], ordered[k - 1][0])


def test_resampling_on_odd_rows(spark):
    good = spark.createDataFrame([(1,), (None,), (50,)], "doc_id long")
    assert resampling.resample(odd(spark), good).count() == len(texts())
    assert resampling.resample(empty(spark), good).count() == 0


# --- vector search


def plain_top(vectors, k=5, every=50):
    ids = np.array([i for i, _ in vectors])
    matrix = np.floor(256 * np.array([v for _, v in vectors], float)).astype(np.int64)
    out = []
    for i in np.flatnonzero(ids % every == 0):
        others = np.flatnonzero(ids != ids[i])
        scores = matrix[others] @ matrix[i]
        best = np.lexsort((ids[others], -scores))[:k]
        out += [(ids[i], r + 1, ids[others[j]], scores[j]) for r, j in enumerate(best)]
    return sorted(out)


def test_search_is_exact(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "BLOCK_ROWS", 200)
    monkeypatch.setattr(vector_search, "CHUNK_QUERIES", 10)
    draw = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in np.float32(draw.normal(0, 0.125, 16))]) for i in range(1200)]
    vectors += [(i, vectors[i % 7][1]) for i in range(1200, 1260)]  # ties
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3)
    got = vector_search.top_k(df, F.col("id") % 50 == 0).collect()
    assert sorted(map(tuple, got)) == plain_top(vectors)


def test_search_on_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.5]), (0, [1.0, 0.5]), (1, [0.25, -3.0]), (2, None), (3, [nan, 1.0]), (4, [1.0, None]), (5, [inf, 0.0]),
        (None, [1.0, 1.0]), (6, [2.0]), (7, []),
    ]
    schema = "vec_id long, embedding array<float>"
    got = vector_search.top_k(spark.createDataFrame(rows, schema), F.col("id") % 50 == 0).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 6, 512 * 256), (0, 2, 7, 0), (0, 3, 1, 64 * 256 - 768 * 128)]
    assert vector_search.top_k(spark.createDataFrame([], schema), F.col("id") % 50 == 0).count() == 0


def test_search_keeps_long_vectors(spark):
    draw = np.random.default_rng(2)
    for size, every in ((5_000.0, 3), (2.0**24, 7), (2.0**42, 7)):  # 64-bit sums, 64-bit components, sums beyond 2 ** 58
        vectors = [(i, [float(x) for x in draw.normal(0, size if i % every == 3 % every else 0.5, 8)]) for i in range(300)]
        vectors = [(i, v if every == 3 or i % 50 else [x % 1.0 for x in v]) for i, v in vectors]  # short queries, so that sums fit
        df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3)
        got = vector_search.top_k(df, F.col("id") % 50 == 0).collect()
        assert sorted(map(tuple, got)) == plain_top(vectors)


def test_search_raises_rather_than_drops(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [1e30])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="does not fit into 64 bits"):
        vector_search.top_k(df, F.col("id") % 50 == 0).collect()
