"""Alignment of two tokenizers against a plain version of the contract."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import odd
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortline.llm import catalog, token_alignment

FOLDER = "/root/testdata/sf0.001"
PATH_A, PATH_B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def byte_characters():
    """The characters that stand for bytes, in the order of the bytes."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    other = iter(range(256, 600))
    return {chr(b if b in plain else next(other)): b for b in range(256)}


def plain(docs):
    """Every token a byte range; every pair of ranges that overlap a link."""
    a, b = Tokenizer.from_file(PATH_A), sentencepiece.SentencePieceProcessor(model_file=PATH_B)
    a.encode_special_tokens = True
    back = byte_characters()

    def bytes_a(i):
        return bytes(back[c] for c in a.id_to_token(i))

    def bytes_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    rows, holds = [], Counter()
    for doc_id, text in docs:
        whole = (" " + text).encode() if text else b""
        ids = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        parts = [[f(i) for i in side] for f, side in zip((bytes_a, bytes_b), ids, strict=True)]
        if not text or any(b"".join(p) != whole for p in parts):
            rows.append((doc_id, [], [], [], []))
            continue
        ends = [np.cumsum([len(x) for x in p]).tolist() for p in parts]
        common = sorted(set(ends[0]) & set(ends[1]))
        sides = []
        for side, end in zip(ids, ends, strict=True):
            groups = defaultdict(list)
            for i, e in zip(side, end, strict=True):
                groups[next(k for k, c in enumerate(common) if e <= c) if len(common) < 50 else int(np.searchsorted(common, e))].append(i)
            sides.append(groups)
        text_groups = [",".join(map(str, sides[0][k])) + "|" + ",".join(map(str, sides[1][k])) for k in range(len(common))]
        links, j = [], 0
        begins = [[0, *e[:-1]] for e in ends]
        for i, (s, e) in enumerate(zip(begins[0], ends[0], strict=True)):
            while ends[1][j] <= s:
                j += 1
            k = j
            while k < len(ends[1]) and begins[1][k] < e:
                links.append((ids[0][i], ids[1][k]))
                k += 1
        holds.update(set(links))
        rows.append((doc_id, *ids, text_groups, links))
    best = defaultdict(int)
    for (x, _), n in holds.items():
        best[x] = max(best[x], n)
    return [
        (
            doc_id, len(x), len(y), len(groups), len(links),
            sum(holds[p] == best[p[0]] for p in links), sum(holds[p] for p in links),
            hashlib.sha256(";".join(groups).encode()).hexdigest() if x else "",
        )
        for doc_id, x, y, groups, links in rows
    ]


def in_order(rows):
    return sorted(map(tuple, rows), key=repr)


def test_query(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    got = catalog.QUERIES["op13_token_alignment"](spark, FOLDER).select(COLUMNS).collect()
    assert in_order(got) == in_order(plain([(r.doc_id, r.text) for r in docs]))


WEIRD = [
    "don't  stop\n\n now \t x", " leading", "trailing ", "  two", "a　b  c", "<|endoftext|> <s> </s> <unk> <0x41>", "▁under",
    "½ ﬁ Ａ", "é é", "\U0001f600 \U0001f1e9\U0001f1ea \U00100000", "\x00\x01 \x7f", "日本語 テキスト", "x" * 3000, "1 22 333 4444",
]


def test_odd_rows_over_small_chunks(spark, monkeypatch):
    texts = [*odd.texts(), *[(900 + i, t) for i, t in enumerate(WEIRD)]]
    rows = [*odd.rows(), *[(900 + i, t, None, None, 1, *["0"] * len(odd.CLASHING)) for i, t in enumerate(WEIRD)]]
    df = spark.createDataFrame(rows, odd.SCHEMA).withColumns({c: F.lit("x") for c in ("chunk", "pairs", "n_a", "count")})
    got = token_alignment.align(df, PATH_A, PATH_B).select(COLUMNS).collect()
    want = plain(texts)
    assert in_order(got) == in_order(want)
    assert sum(r[1] == 0 for r in want) >= 4 and sum(r[1] > 0 for r in want) > 25
    assert token_alignment.align(df.limit(0), PATH_A, PATH_B).count() == 0


def test_whole_groups(spark):
    df = spark.createDataFrame([(1, "tokenization matters"), (2, None)], "doc_id long, text string")
    for r in token_alignment.align(df, PATH_A, PATH_B, whole=True).collect():
        assert r.groups_sha256 == (hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "")
        assert (r.groups.count(";") + 1 if r.groups else 0) == r.n_groups
        assert sum(len(side.split(",")) for g in r.groups.split(";") for side in g.split("|") if side) == r.n_a + r.n_b


@pytest.mark.parametrize("seed", range(12))
def test_gallop_is_a_search(seed):
    draw = np.random.default_rng(seed)
    size = int(draw.choice([1, 2, 63, 64, 65, 1000]))
    long = np.unique(draw.integers(0, 10 ** int(draw.integers(1, 6)), size * int(draw.choice([1, 3, 50]))))
    short = np.unique(np.r_[draw.choice(long, min(size, len(long)) // 2 + 1), draw.integers(0, long[-1] + 1, size // 2 + 1), long[-1]])
    assert (token_alignment.gallop(short, long) == np.searchsorted(long, short)).all()


def test_plain_pieces_are_merged_by_the_model_alone():
    import random

    with open(PATH_A, encoding="utf-8") as file:
        coder = token_alignment.ByteLevel(file.read())
    whole = coder.coder.tokenizer
    rng = random.Random(3)
    signs = [*"abzé'sStTrReEldLmMvVdD019.,<|>İıǅßÀ×÷ªµ\x02\n\u0301\u0410\u4e00    ", chr(0x24F), chr(0x250)]
    texts = ["".join(rng.choices(signs, k=rng.randint(1, 16))) for _ in range(3000)] + ["x <|endoftext|> y", "a'll 's 'S 'lls"]
    for text, ids in zip(texts, coder.encode(texts), strict=True):
        assert ids.tolist() == whole.encode(" " + text, add_special_tokens=False).ids, ascii(text)

    class Merging:
        """Only what the model does, once the mark is known."""

        model = whole.model

    coder.coder.tokenizer = Merging()
    coder.coder.kept.clear()
    again = ["équeoivi&&& l'Épée,### naïve9ü a'll %%%'s 12é3 ***", "plain words"]
    assert [ids.tolist() for ids in coder.encode(again)] == [whole.encode(" " + text, add_special_tokens=False).ids for text in again]
