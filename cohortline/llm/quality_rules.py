"""Quality rules and n-gram perplexity.

The rules are counts on words, symbols, lines and repeated five-word windows. The language model is a character
4-gram model with modified Kneser-Ney smoothing. Its counts cover every character of every distinct text: tasks count,
Spark adds up. Characters fold into 64 classes (26 letters, digits, white space, punctuation, and 34 classes of all
other characters by code point), so a model has at most 64 ** 4 entries of 12 bytes, about 200 MB, however large the
corpus; that bound is what allows it to be broadcast. Entries are sorted by the hash of their n-gram and found
by binary search; a task first unfolds the longest n-grams to a table by code, and searches only for those unknown there.

The spelling model sees four characters and has a fixed largest size; a second model of token trigrams grows with the
corpus. Its tokens are words, and single code points of three or more bytes (CJK, emoji). The trigrams of the distinct texts are
dealt by their middle word to buckets of bounded size, a frequent middle word together with the word before it. A bucket counts
its trigrams, their contexts and its pairs; in how many pairs a word is the last, and the pairs of frequent words, are put
together across buckets and answered in the order they were asked for. Totals per order and per frequent word come to the driver.
The buckets go in turns: each reads all texts, keeps the trigrams of its buckets, and its shuffle is gone before the next. Smoothing
is interpolated Kneser-Ney with one discount per order; every occurrence is
scored by the counts without itself, as otherwise a word that occurs once would predict itself. A text whose
negative log-probability per token lies above the band of its language is rejected: words in random order, lists of keywords,
digits. Low values are no objection, near copies have them.

A document's score is its mean negative log-probability per character, the logarithm of its perplexity. Every language has
its own band around its median. A mean over n characters strays in proportion to 1 / sqrt(n), so the band is as wide as
``WIDTH`` times the spread between the quartiles of ``deviation * sqrt(n)``, over sqrt(n): wide for short documents
and narrow for long ones. Median and quartiles come from the distinct texts of the language that pass the base rules, so
copies do not narrow the band, and the spread counts as ``LEAST_SPREAD`` at least.

Defined results: a null or empty text has no words, fails the base rules and has a null score; a null language
is a language; every row gets a verdict, but a text counts once in the model and in the bands, however often it
occurs; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.llm.common import Hasher, buckets_for, mix, pack, record_batch, scratch, text_bytes, text_chunks, whole_texts
from cohortline.session import remove_scratch, write_scratch

MIN_WORDS = 10
MOST_REPEATED = 20  # percent
WIDTH = 3.2
LEAST_SPREAD = 0.1
LEAST_WORD_SPREAD = 0.5  # a text may have about five times the middle word perplexity of its language
ORDER = 4
CLASSES = 64
SYMBOLS = b"#*$%&|<>"
FLUSH_TOKENS = 1 << 22  # tokens of a task that are put together
BUCKET_BYTES = 12_000_000  # of text, for a bucket of token trigrams
ONE_KEY_WORDS = 1 << 21  # so many word numbers fit three to a 64-bit key
TURNS = 3  # the buckets go in so many turns, as the trigrams of all together take more disk than the texts
_U64 = np.uint64
_FIRST, _LAST = _U64(0x9E3779B97F4A7C15), _U64(0xD1342543DE82EF95)
_UNDO_FIRST, _UNDO_LAST = (_U64(pow(int(x), -1, 1 << 64)) for x in (_FIRST, _LAST))


def _byte_classes() -> np.ndarray:
    """The class of each byte that is a character by itself: letters 1-26, digit 27, space 28, line end 29, others 30."""
    table = np.full(256, 30, np.uint8)
    for i in range(26):
        table[65 + i] = table[97 + i] = 1 + i
    table[48:58] = 27
    table[[9, 11, 12, 13, 32]] = 28
    table[10] = 29
    return table


def characters(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and class (1 to 63) of each character; a character of several bytes falls into classes 31 to 63."""
    lead = (data & 0xC0) != 0x80
    classes = _byte_classes()[data].astype(np.int64)
    many = np.flatnonzero(data >= 0xC0)
    if len(many):
        value = data[many].astype(np.int64) * 64
        value += np.where(many + 1 < len(data), data[np.minimum(many + 1, len(data) - 1)] & 0x3F, 0)
        classes[many] = 31 + value % 33
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    return owner[lead], classes[lead]


def grams(owner: np.ndarray, classes: np.ndarray, order: int) -> np.ndarray:
    """The n-gram that ends at each character; before the start of a text stands class 0."""
    code = classes.copy()
    for back in range(1, order):
        before = np.zeros(len(classes), np.int64)
        before[back:] = np.where(owner[back:] == owner[:-back], classes[:-back], 0)
        code += before << (6 * back)
    return code


def _dense(n: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the values per code, for codes that occur."""
    codes, inverse = np.unique(n, return_inverse=True)
    return codes, np.bincount(inverse, weights=values).astype(np.int64)


def unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose text hash the task has not met before."""
    seen: set[int] = set()
    for batch in batches:
        fresh = []
        for key in batch.column(TEXT_HASH).to_pylist():
            fresh.append(key not in seen)
            seen.add(key)
        yield batch.filter(pa.array(fresh, pa.bool_()))


def distinct_texts(docs: DataFrame) -> DataFrame:
    """``text`` and its hash, with all copies of a text in one task; a task passes on one copy of a text, so that copies do not pile up."""
    hashed = whole_texts(docs).withColumn(TEXT_HASH, F.xxhash64("text"))
    return hashed.mapInArrow(unseen, f"text string, {TEXT_HASH} long").repartition(TEXT_HASH)


def count_grams(docs: DataFrame) -> DataFrame:
    """How often each 4-gram of character classes occurs in the distinct texts: ``gram``, ``n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, size = np.zeros(CLASSES**ORDER, np.int32), 0  # 64 MB, for all texts of the task
        for _, offsets, data in text_chunks(unseen(batches)):
            owner, classes = characters(offsets, data)
            codes = np.sort(grams(owner, classes, ORDER).astype(np.int32))
            first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]][: len(codes)])
            total[codes[first]] += np.diff(np.r_[first, len(codes)]).astype(np.int32)
            size += len(codes)
            if size > 1 << 30:
                yield from flush(total)
                total[:], size = 0, 0
        yield from flush(total)

    def flush(total: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = np.flatnonzero(total)
        for lo in range(0, len(found), 100_000):
            part = found[lo : lo + 100_000]
            yield record_batch(pa.schema([("gram", pa.int64()), ("n", pa.int64())]), [part, total[part].astype(np.int64)])

    counted = distinct_texts(docs).mapInArrow(run, "gram long, n long")
    return counted.groupBy("gram").agg(F.sum("n").alias("n"))


def scramble(codes: np.ndarray, order: int) -> np.ndarray:
    """A hash of an n-gram; it is one to one, as the n-grams are short."""
    return (codes.astype(_U64) * _FIRST + _U64(order)) * _LAST


def _estimate(codes: np.ndarray, counts: np.ndarray, below: tuple | None) -> tuple:
    """Probability of each n-gram, the contexts, and the weight that each leaves to the shorter n-grams."""
    n1, n2, n3, n4 = (max(int((counts == k).sum()), 1) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    ideal = ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))
    discounts = np.array([0.0, *[min(max(d, 0.05), k - 0.05) for k, d in ideal]])
    taken = discounts[np.minimum(counts, 3)]
    contexts, inverse = np.unique(codes >> 6, return_inverse=True)
    totals = np.bincount(inverse, weights=counts)
    weight = np.bincount(inverse, weights=taken) / totals
    prob = (counts - taken) / totals[inverse]
    if below is None:
        return prob + weight[inverse] / CLASSES, contexts, weight
    shorter, shorter_prob, order = below
    at = np.searchsorted(shorter, codes & ((1 << (6 * order)) - 1))
    return prob + weight[inverse] * shorter_prob[at], contexts, weight


def kneser_ney(codes: np.ndarray, counts: np.ndarray) -> list[tuple]:
    """Modified Kneser-Ney estimates from the counts of the longest n-grams.

    Per order: hashes of the n-grams, sorted, and their log probabilities; hashes of the contexts, sorted, and
    the logs of their back-off weights.
    """
    levels = [(codes, counts)]
    for order in range(ORDER - 1, 0, -1):  # shorter n-grams count the different characters before them
        shorter = levels[-1][0] & ((1 << (6 * order)) - 1)
        levels.append(_dense(shorter, np.ones(len(shorter))))
    tables, below = [], None
    for order, (codes, counts) in zip(range(1, ORDER + 1), reversed(levels), strict=True):
        if len(codes) == 0:
            none = np.zeros(0, np.float32)
            tables.append((np.zeros(0, _U64), none, np.zeros(0, _U64), none))
            continue
        prob, contexts, weight = _estimate(codes, counts, below)
        hashes, context_hashes = scramble(codes, order), scramble(contexts, order + 10)
        turn, context_turn = np.argsort(hashes), np.argsort(context_hashes)
        tables.append(
            (
                hashes[turn],
                np.log(prob[turn]).astype(np.float32),
                context_hashes[context_turn],
                np.log(weight[context_turn]).astype(np.float32),
            )
        )
        below = (codes, prob, order)
    return tables


def _find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(table) == 0:
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
    return at, table[at] == wanted


def unfold(tables: list) -> np.ndarray:
    """Log probability of every longest n-gram at the place of its code, 64 MB; not a number where it is unknown."""
    hashes, logs = tables[-1][:2]
    codes = ((hashes * _UNDO_LAST - _U64(ORDER)) * _UNDO_FIRST).astype(np.int64)
    out = np.full(CLASSES**ORDER, np.nan, np.float32)
    out[codes] = logs
    return out


def log_probability(tables: list, owner: np.ndarray, classes: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
    """Natural logarithm of the probability of each character after the three before it.

    A character whose longest n-gram is unknown backs off; the weights of the known contexts add up. With ``known``, the
    longest n-grams unfolded, only the unknown ones are searched for.
    """
    codes = grams(owner, classes, ORDER)
    out = np.zeros(len(classes)) if known is None else known[codes].astype(float)
    left = np.arange(len(classes)) if known is None else np.flatnonzero(np.isnan(out))
    out[left] = 0.0
    for order in range(ORDER, 0, -1):
        hashes, logs, contexts, weights = tables[order - 1]
        code = codes[left] & ((1 << (6 * order)) - 1)
        at, hit = _find(hashes, scramble(code, order))
        out[left[hit]] += logs[at[hit]]
        left, code = left[~hit], code[~hit]
        if len(left) == 0:
            return out
        at, hit = _find(contexts, scramble(code >> 6, order + 10))
        out[left[hit]] += weights[at[hit]]
    out[left] -= np.log(CLASSES)
    return out


def fit(docs: DataFrame) -> list[tuple]:
    """The model of all texts. Its counts, at most 64 ** 4 numbers, come to the driver as Arrow columns."""
    table = scratch(count_grams(docs)).toArrow().sort_by("gram")
    return kneser_ney(table.column("gram").to_numpy(), table.column("n").to_numpy())


def tokens(hasher: Hasher, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of each token: a word, or a code point of three or more bytes."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hasher.powers(n)
    word = ~hasher.space[data]
    joined = np.zeros(n, bool)  # to the byte before
    joined[1:] = word[:-1]
    big = np.flatnonzero(data >= 0xE0)
    if len(big):
        wide = np.zeros(n + 3, bool)
        wide[big] = wide[big + 1] = wide[big + 2] = True
        wide[big[data[big] >= 0xF0] + 3] = True
        lead = (data[1:] & 0xC0) != 0x80
        joined[1:] &= ~(lead & (wide[1:n] | wide[: n - 1]))
    joined[offsets[:-1][offsets[:-1] < n]] = False
    starts = np.flatnonzero(word & ~joined)
    if len(starts) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sums = np.add.reduceat(hasher.table[data] * hasher.up[:n], starts)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))
    return owner, mix(sums * hasher.down[starts]).view(np.int64)


def _token_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Some millions of tokens at a time: hashes of the texts, and text number and hash of each token; a text comes once in a task."""
    hasher, parts, size = Hasher(lower=False), [], 0

    def put_together() -> tuple:
        texts, owners, hashes = zip(*parts, strict=True)
        first = np.cumsum([0, *map(len, texts)])
        owner = np.concatenate([(o + at).astype(np.int32) for o, at in zip(owners, first[:-1], strict=True)])
        return np.concatenate(texts), owner, np.concatenate(hashes)

    for rows, offsets, data in text_chunks(unseen(batches)):
        owner, found = tokens(hasher, offsets, data)
        if len(found):
            parts.append((rows.column(TEXT_HASH).to_numpy(), owner, found))
            size += len(found)
        if size >= FLUSH_TOKENS:
            yield put_together()
            parts, size = [], 0
    if parts:
        yield put_together()


def _before(owner: np.ndarray, words: np.ndarray, back: int) -> np.ndarray:
    """The word so many places before each, 0 before the start of its text."""
    out = np.zeros(len(words), words.dtype)
    out[back:] = words[:-back]
    out[back:][owner[back:] != owner[:-back]] = 0
    return out


def _among(values: np.ndarray, few: np.ndarray) -> np.ndarray:
    """Places of the values that are among the few; most others are told by their last bits."""
    bits = np.zeros(1 << 16, bool)
    bits[few & 0xFFFF] = True
    at = np.flatnonzero(bits[values & 0xFFFF])
    return at[np.isin(values[at], few)]


def _hashed_texts(docs: DataFrame) -> DataFrame:
    return whole_texts(docs).withColumn(TEXT_HASH, F.xxhash64("text"))


def frequent_middles(docs: DataFrame, buckets: int) -> list[int]:
    """Hashes of words that may be the middle of more trigrams than a bucket should hold.

    Such a word has that share of the trigrams in one batch at least, so a batch names its own, at most ``buckets`` words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, owner, w in _token_batches(batches):
            v = _before(owner, w, 1)
            bits = np.flatnonzero(np.bincount(v & 0xFFFF, minlength=1 << 16) * buckets > len(v))
            few = np.zeros(1 << 16, bool)
            few[bits] = True
            words, counts = np.unique(v[few[v & 0xFFFF]], return_counts=True)
            yield record_batch(pa.schema([("word", pa.int64())]), [words[counts * buckets > len(v)]])

    return [r.word for r in _hashed_texts(docs).mapInArrow(run, "word long").distinct().collect()]


def _squeeze(numbers: np.ndarray) -> bytes:
    """Non-negative 32-bit numbers by byte planes, compressed."""
    return pa.compress(pack(numbers.astype(np.uint32).view(np.uint8).reshape(-1, 4).T), codec="zstd", asbytes=True)


def _spread(packed: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, 4 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view(np.int32).ravel()


PACKED = "bucket int, n int, words binary, ids binary, texts binary, each binary"


def trigrams(docs: DataFrame, frequent: list[int], buckets: int, turn: int, turns: int) -> DataFrame:
    """Token trigrams of the texts, packed per batch and bucket, for every ``turns``-th bucket from ``turn`` on.

    The middle word deals a trigram to its bucket; a frequent middle word does so together with the word before. A row holds
    ``n`` trigrams in the order of the texts: hashes of the distinct ``words``, their numbers in each trigram (``ids``), hashes of
    the ``texts`` and how many trigrams ``each`` has here. A text that lies in several tasks comes once from each.
    """
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int32()), *[(c, pa.binary()) for c in ("words", "ids", "texts", "each")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = np.array(frequent, np.int64)
        for texts, owner, w in _token_batches(batches):
            v = _before(owner, w, 1)
            bucket = ((v.view(_U64) >> _U64(20)) % _U64(buckets)).astype(np.int32)
            u, many = _before(owner, w, 2), _among(v, split)
            bucket[many] = mix(v[many].view(_U64) * _U64(3) + u[many].view(_U64)) % _U64(buckets)
            at = np.flatnonzero(bucket % turns == turn)
            at = at[np.argsort(bucket[at], kind="stable")]
            numbers, first = np.unique(bucket[at], return_index=True)
            for number, lo, hi in zip(numbers, first, [*first[1:], len(at)], strict=True):
                here = at[lo:hi]
                coded = pa.array(np.concatenate([u[here], v[here], w[here]])).dictionary_encode()
                begins = np.flatnonzero(np.r_[True, owner[here[1:]] != owner[here[:-1]]])
                columns = (
                    pack(coded.dictionary.to_numpy()),
                    _squeeze(coded.indices.to_numpy()),
                    pack(texts[owner[here[begins]]]),
                    _squeeze(np.diff(np.r_[begins, len(here)])),
                )
                yield record_batch(schema, [[number], [len(here)], *[[c] for c in columns]])

    return _hashed_texts(docs).mapInArrow(run, PACKED)


class BucketCounts:
    """Counts of the trigrams of a bucket, sorted by their words; a text that came from several tasks counts once.

    ``v`` and ``w`` are the numbers of the words of every pair, ``pair_n`` says in how many trigrams it is. With ``scored``, too:
    ``texts`` and ``triple`` give the text and the trigram of every occurrence, ``context`` and ``pair`` the first two and the
    last two words of every trigram. Pairs with a frequent first word may lie in other buckets too.
    """

    def __init__(self, rows: pa.Table, frequent: list[int], scored: bool):
        rows = rows.to_pylist()
        coded = pa.array(np.concatenate([np.frombuffer(r["words"], np.int64) for r in rows])).dictionary_encode()
        self.hashes, index = coded.dictionary.to_numpy(), coded.indices.to_numpy()
        one_number = len(self.hashes) < ONE_KEY_WORDS
        texts = np.concatenate([np.frombuffer(r["texts"], np.int64) for r in rows])
        each = np.concatenate([_spread(r["each"], len(r["texts"]) // 8) for r in rows])
        self.text_hashes, once, number = np.unique(texts, return_index=True, return_inverse=True)
        fresh = np.zeros(len(texts), bool)
        fresh[once] = True
        parts, first = [], 0
        for r in rows:
            size = len(r["words"]) // 8
            u, v, w = index[first : first + size][_spread(r["ids"], 3 * r["n"])].reshape(3, -1)
            parts.append([(v.astype(np.int64) << 42) | (u.astype(np.int64) << 21) | w] if one_number else [v, u, w])
            first += size
        keys = [np.concatenate(c) for c in zip(*parts, strict=True)]
        del rows, parts
        if not fresh.all():
            keep = np.repeat(fresh, each)
            keys = [k[keep] for k in keys]
        if scored:
            order = np.argsort(keys[0]) if one_number else np.lexsort(keys[::-1])
            self.texts = np.repeat(number[fresh].astype(np.int32), each[fresh])[order]
            keys = [k[order] for k in keys]
        elif one_number:
            keys[0].sort()
        else:
            order = np.lexsort(keys[::-1])
            keys = [k[order] for k in keys]
        new = np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)]
        at = np.flatnonzero(new)
        self.n = np.diff(np.r_[at, len(new)])
        if one_number:
            key = keys[0][at]
            v, u, w = key >> 42, (key >> 21) & 0x1FFFFF, key & 0x1FFFFF
        else:
            v, u, w = (k[at].astype(np.int64) for k in keys)
        if scored:
            self.triple = np.cumsum(new, dtype=np.int32) - 1
            self.context = np.cumsum(np.r_[True, (v[1:] != v[:-1]) | (u[1:] != u[:-1])]) - 1
            self.context_total = np.bincount(self.context, weights=self.n).astype(np.int64)
            self.context_types = np.bincount(self.context)
        key = (v << 32) | w
        if scored:
            order = np.argsort(key)
            key = key[order]
        else:
            key.sort()
        new = np.r_[True, key[1:] != key[:-1]]
        if scored:
            self.pair = np.empty(len(order), np.int64)
            self.pair[order] = np.cumsum(new) - 1
        at = np.flatnonzero(new)
        self.pair_n = np.diff(np.r_[at, len(new)])
        self.v, self.w = key[at] >> 32, key[at] & 0xFFFFFFFF
        self.shared = np.isin(self.hashes, np.array(frequent, np.int64))[self.v]

    def last_words(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the distinct last words by part and hash, their parts, and in how many pairs of this bucket alone each is."""
        alone = np.bincount(self.w[~self.shared], minlength=len(self.hashes))
        words = np.flatnonzero(np.bincount(self.w, minlength=len(self.hashes)))
        part = self._part(words, buckets)
        order = np.lexsort((self.hashes[words], part))
        return words[order], part[order], alone[words[order]]

    def shared_pairs(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that may lie in other buckets too, by part and hashes, and their parts."""
        pairs = np.flatnonzero(self.shared)
        part = self._part(self.w[pairs], buckets)
        order = np.lexsort((self.hashes[self.w[pairs]], self.hashes[self.v[pairs]], part))
        return pairs[order], part[order]

    def _part(self, words: np.ndarray, buckets: int) -> np.ndarray:
        return (mix(self.hashes[words].view(_U64) + _U64(7)) % _U64(buckets)).astype(np.int64)


ASKED = "part int, bucket int, words binary, alone binary, v binary, w binary, n binary, three_once long, three_twice long, two_once long, two_twice long"


def asked(rows: DataFrame, frequent: list[int], buckets: int) -> DataFrame:
    """What a bucket cannot count by itself, per part of the last words: in how many pairs each word is the last, and how often
    a shared pair occurs; beside them how many trigrams, and pairs of its own, occur once and twice."""
    kinds = [pa.int32()] * 2 + [pa.binary()] * 5 + [pa.int64()] * 4
    schema = pa.schema(list(zip([c.split()[0] for c in ASKED.split(", ")], kinds, strict=True)))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        counts = BucketCounts(table, frequent, scored=False)
        own = counts.pair_n[~counts.shared]
        totals = [int((c == k).sum()) for c in (counts.n, own) for k in (1, 2)]
        words, part, alone = counts.last_words(buckets)
        pairs, pair_part = counts.shared_pairs(buckets)
        out, first = [], np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        for lo, hi in zip(first, [*first[1:], len(part)], strict=True):
            here = pairs[slice(*np.searchsorted(pair_part, [part[lo], part[lo] + 1]))]
            out.append(
                [
                    int(part[lo]),
                    key[0].as_py(),
                    pack(counts.hashes[words[lo:hi]]),
                    _squeeze(alone[lo:hi]),
                    pack(counts.hashes[counts.v[here]]),
                    pack(counts.hashes[counts.w[here]]),
                    _squeeze(counts.pair_n[here]),
                    *(totals if lo == 0 else [0] * 4),
                ]
            )
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return rows.groupBy("bucket").applyInArrow(run, ASKED)


ANSWERED = "bucket int, part int, ones binary, twos binary, kind string, v long, n long, types long"


def answered(requests: DataFrame) -> DataFrame:
    """The answers, in the order of the requests: per bucket and part ``ones`` and ``twos`` (kind ``answer``); totals of the part
    beside them: per shared first word its trigrams and pairs (``shared``), how many words and shared pairs occur once and twice
    (``one``, ``two``) and the number of all pairs (``every``)."""
    schema = pa.schema(
        [("bucket", pa.int32()), ("part", pa.int32()), ("ones", pa.binary()), ("twos", pa.binary()), ("kind", pa.string())]
        + [(c, pa.int64()) for c in ("v", "n", "types")]
    )

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        sizes, pair_sizes = ([len(r[c]) // 8 for r in rows] for c in ("words", "v"))
        words, v, w = (np.concatenate([np.frombuffer(r[c], np.int64) for r in rows]) for c in ("words", "v", "w"))
        alone = np.concatenate([_spread(r["alone"], size) for r, size in zip(rows, sizes, strict=True)])
        n = np.concatenate([_spread(r["n"], size) for r, size in zip(rows, pair_sizes, strict=True)])
        words, word = np.unique(words, return_inverse=True)
        firsts, first = np.unique(v, return_inverse=True)
        pairs, pair = np.unique(first * (len(words) + 1) + np.searchsorted(words, w), return_inverse=True)
        two = np.bincount(pair, weights=n, minlength=len(pairs)).astype(np.int64)
        one = np.bincount(word, weights=alone, minlength=len(words)).astype(np.int64)
        one += np.bincount(pairs % (len(words) + 1), minlength=len(words))
        part, out, at, pair_at = key[0].as_py(), [], 0, 0
        for r, size, pair_size in zip(rows, sizes, pair_sizes, strict=True):
            ones, twos = one[word[at : at + size]], two[pair[pair_at : pair_at + pair_size]]
            out.append([r["bucket"], part, _squeeze(ones), _squeeze(twos), "answer", None, size, pair_size])
            at, pair_at = at + size, pair_at + pair_size
        owner = pairs // (len(words) + 1)
        for i, (total, types) in enumerate(zip(np.bincount(owner, weights=two, minlength=len(firsts)), np.bincount(owner, minlength=len(firsts)), strict=True)):
            out.append([None, part, None, None, "shared", int(firsts[i]), int(total), int(types)])
        for kind, counts in (("one", one), ("two", two)):
            out.append([None, part, None, None, kind, None, int((counts == 1).sum()), int((counts == 2).sum())])
        out.append([None, part, None, None, "every", None, int(one.sum()), 0])
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return requests.groupBy("part").applyInArrow(run, ANSWERED)


def _discount(once: int, twice: int) -> float:
    """Absolute discount from how many n-grams occur once and twice."""
    return min(max(once / max(once + 2 * twice, 1), 0.05), 0.95)


def _smoothed(n: np.ndarray, total: np.ndarray, types: np.ndarray, discount: float, below: np.ndarray) -> np.ndarray:
    inside = (np.maximum(n - discount, 0.0) + discount * types * below) / np.maximum(total, 1)
    return np.where(total > 0, inside, below)


SUMS = "part int, texts binary, logs binary, n binary"


def text_sums(rows: DataFrame, answers: DataFrame, totals: dict, frequent: list[int], buckets: int, parts: int) -> DataFrame:
    """Per bucket and part of the texts, hashes of the ``texts``, the sums of the ``logs`` of the probabilities of their
    trigrams, and their number."""
    d1, d2, d3, every, shared = (totals[k] for k in ("d1", "d2", "d3", "every", "shared"))
    schema = pa.schema([("part", pa.int32()), *[(c, pa.binary()) for c in ("texts", "logs", "n")]])

    def unigram(n: np.ndarray) -> np.ndarray:  # over the vocabulary, what discounts free is dealt evenly
        return (np.maximum(n - d1, 0.0) + d1) / max(every, 1)

    def run(key: tuple, table: pa.Table, given: pa.Table) -> pa.Table:
        if table.num_rows == 0:
            return schema.empty_table()
        counts = BucketCounts(table, frequent, scored=True)
        given = given.sort_by("part").to_pylist()
        one = np.zeros(len(counts.hashes), np.int64)
        one[counts.last_words(buckets)[0]] = np.concatenate([_spread(r["ones"], r["n"]) for r in given])
        two = counts.pair_n
        v_total = np.bincount(counts.v, weights=two, minlength=len(one)).astype(np.int64)
        v_types = np.bincount(counts.v, minlength=len(one))
        two[counts.shared_pairs(buckets)[0]] = np.concatenate([_spread(r["twos"], r["types"]) for r in given])
        for i in np.unique(counts.v[counts.shared]):
            v_total[i], v_types[i] = shared[int(counts.hashes[i])]
        total, types, one, last = v_total[counts.v], v_types[counts.v], one[counts.w], (two == 1).astype(np.int64)
        below = np.where(
            last == 1,  # a pair that occurs in one trigram only; below, a trigram that occurs once takes itself from its pair
            _smoothed(two - 1, total - 1, types - 1, d2, unigram(one - 1)),
            _smoothed(two - 1, total - 1, types, d2, unigram(one)),
        )
        whole = _smoothed(two, total, types, d2, unigram(one))
        last = (counts.n == 1).astype(np.int64)
        below = np.where(last == 1, below[counts.pair], whole[counts.pair])
        total, types = counts.context_total[counts.context], counts.context_types[counts.context]
        logs = np.log(_smoothed(counts.n - 1, total - 1, types - last, d3, below))
        size = len(counts.text_hashes)
        sums, n = np.bincount(counts.texts, logs[counts.triple], size), np.bincount(counts.texts, minlength=size)
        part = (counts.text_hashes.view(_U64) % _U64(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        numbers, first = np.unique(part[order], return_index=True)
        pieces = [order[lo:hi] for lo, hi in zip(first, [*first[1:], len(order)], strict=True)]
        columns = [[pack(counts.text_hashes[p]) for p in pieces], [pack(sums[p]) for p in pieces], [_squeeze(n[p]) for p in pieces]]
        return pa.Table.from_batches([record_batch(schema, [numbers, *columns])])

    kept = answers.filter("kind = 'answer'").select("bucket", "part", "ones", "twos", "n", "types")
    return rows.groupBy("bucket").cogroup(kept.groupBy("bucket")).applyInArrow(run, SUMS)


def _summed(sums: DataFrame) -> DataFrame:
    """Per text, the sum over the buckets (``log``) and the number of trigrams (``n``)."""
    schema = pa.schema([(TEXT_HASH, pa.int64()), ("log", pa.float64()), ("n", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        texts, number = np.unique(np.concatenate([np.frombuffer(r["texts"], np.int64) for r in rows]), return_inverse=True)
        logs = np.bincount(number, np.concatenate([np.frombuffer(r["logs"]) for r in rows]))
        n = np.bincount(number, np.concatenate([_spread(r["n"], len(r["texts"]) // 8) for r in rows])).astype(np.int64)
        return pa.Table.from_arrays([pa.array(c) for c in (texts, logs, n)], schema=schema)

    return sums.groupBy("part").applyInArrow(run, f"{TEXT_HASH} long, log double, n long")


def _totals(requests: DataFrame, answers: DataFrame) -> dict:
    """Discounts, the number of all pairs, and trigrams and pairs of every shared first word."""
    three_one, three_two, two_one, two_two = requests.agg(
        *[F.coalesce(F.sum(c), F.lit(0)) for c in ("three_once", "three_twice", "two_once", "two_twice")]
    ).first()
    rows = answers.filter("kind <> 'answer'").groupBy("kind", "v").agg(F.sum("n").alias("n"), F.sum("types").alias("types")).collect()
    found = {r.kind: (r.n, r.types) for r in rows if r.kind != "shared"}
    two, every = found.get("two", (0, 0)), found.get("every", (0, 0))[0]
    return {
        "d1": _discount(*found.get("one", (0, 0))),
        "d2": _discount(two_one + two[0], two_two + two[1]),
        "d3": _discount(three_one, three_two),
        "every": every,
        "shared": {r.v: (r.n, r.types) for r in rows if r.kind == "shared"},
    }


def token_scores(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, turns: int = TURNS) -> DataFrame:
    """Per text hash, the mean negative log-probability of its tokens (``word_entropy``) and their number (``n_tokens``).

    The trigrams are dealt to buckets by their middle word, so that a bucket counts trigrams, their contexts and its pairs
    by itself; only how many pairs end in a word, and pairs with a frequent first word, are put together across buckets.
    Trigrams are never written: a part of the buckets at a time reads the texts, first for the counts and again for the scores.
    """
    spark = docs.sparkSession
    buckets = buckets_for(text_bytes(docs), bucket_bytes, turns)
    frequent = frequent_middles(docs, buckets)
    parts = [trigrams(docs, frequent, buckets, turn, turns) for turn in range(turns)]
    paths = [write_scratch(asked(rows, frequent, buckets)) for rows in parts]
    requests = spark.read.schema(ASKED).parquet(*paths)
    answers = scratch(answered(requests))
    totals = _totals(requests, answers)
    for path in paths:
        remove_scratch(spark, path)
    sums = [scratch(_summed(text_sums(rows, answers, totals, frequent, buckets, buckets // turns))) for rows in parts]
    scored = reduce(DataFrame.union, sums).groupBy(TEXT_HASH).agg(F.sum("log").alias("log"), F.sum("n").alias("n_tokens"))
    return scored.select(TEXT_HASH, (-F.col("log") / F.col("n_tokens")).alias("word_entropy"), "n_tokens")


def _repeated_words(hasher: Hasher, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text, words inside five-word windows that occur at least twice in it."""
    shingles, valid = hasher.shingles(hashes, first, short=False)
    at = np.flatnonzero(valid)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    key = mix(shingles[at] + owner[at].astype(_U64)).view(np.int64)
    inorder = np.sort(key)
    twice = at[_among(key, np.unique(inorder[1:][inorder[1:] == inorder[:-1]]))]
    steps = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(steps, twice, 1)
    np.add.at(steps, twice + 5, -1)
    return np.bincount(owner[np.cumsum(steps)[:-1] > 0], minlength=len(first) - 1)


def _duplicate_lines(text: str) -> int:
    lines = [line for line in text.split("\n") if line.strip(" \t\x0b\x0c\r")]
    return len(lines) - len(set(lines))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
TEXT_HASH = "_text_hash"


def measure(docs: DataFrame, tables: list[tuple], id_col: str = "doc_id", lang_col: str = "lang") -> DataFrame:
    """The measures of each text and ``cross_entropy``, the mean negative log-probability of its characters."""
    sent = docs.sparkSession.sparkContext.broadcast(tables)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, tables = Hasher(lower=False), sent.value
        known = unfold(tables)
        for rows, offsets, data in text_chunks(batches, 1 << 21):
            texts = rows.num_rows
            _, _, hashes, first = hasher.words(offsets, data)
            lead = ((data & 0xC0) != 0x80) & ~hasher.space[data]
            columns = [
                np.diff(first),
                np.diff(np.r_[0, np.cumsum(lead)][offsets]),
                np.diff(np.searchsorted(np.flatnonzero(symbol[data]), offsets)),
                [_duplicate_lines(t) for t in rows.column("text").to_pylist()],
                _repeated_words(hasher, hashes, first),
            ]
            char_owner, classes = characters(offsets, data)
            total = np.bincount(char_owner, weights=log_probability(tables, char_owner, classes, known), minlength=texts)
            length = np.bincount(char_owner, minlength=texts)
            entropy = pa.array(-total / np.maximum(length, 1), pa.float64(), mask=length == 0)
            fields = [(id_col, rows.column(0).type), (lang_col, rows.column(1).type), (TEXT_HASH, pa.int64()), *[(m, pa.int64()) for m in MEASURES]]
            schema = pa.schema([*fields, ("n_scored", pa.int64()), ("cross_entropy", pa.float64())])
            yield record_batch(schema, [rows.column(0), rows.column(1), rows.column(2), *columns, length, entropy])

    kept = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (id_col, lang_col)]
    numbers = [f"{m} long" for m in (TEXT_HASH, *MEASURES)]
    hashed = docs.withColumn(TEXT_HASH, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return whole_texts(hashed, id_col, lang_col, TEXT_HASH).mapInArrow(run, ", ".join([*kept, *numbers, "n_scored long, cross_entropy double"]))


def medians(measured: DataFrame, lang_col: str) -> DataFrame:
    """The median cross entropy of each language."""
    middle = F.percentile_approx("cross_entropy", 0.5, 10_000).alias("middle")
    return measured.groupBy(F.col(lang_col).alias("_lang")).agg(middle)


def _word_bands(once: DataFrame, lang_col: str) -> DataFrame:
    """Per language the median word entropy, the spread between its quartiles, and that of strays times the root of the length.

    Texts on different subjects differ however long they are, so the band does not shrink below the first spread.
    """
    quartiles = F.percentile_approx("word_entropy", [0.25, 0.5, 0.75], 10_000)
    middles = once.groupBy(F.col(lang_col).alias("_word_lang")).agg(
        quartiles[1].alias("word_middle"), F.greatest(quartiles[2] - quartiles[0], F.lit(LEAST_WORD_SPREAD)).alias("word_spread")
    )
    centred = once.join(middles, once[lang_col].eqNullSafe(middles["_word_lang"]))
    strays = F.percentile_approx((F.col("word_entropy") - F.col("word_middle")) * F.sqrt("n_tokens"), [0.25, 0.75], 10_000)
    return centred.groupBy("_word_lang", "word_middle", "word_spread").agg((strays[1] - strays[0]).alias("word_stray"))


def judge(docs: DataFrame, width: float = WIDTH, id_col: str = "doc_id", lang_col: str = "lang") -> DataFrame:
    """Measures, ``base_failed``, ``perplexity`` and ``word_perplexity``, the bands of the language at this length, and
    ``kept`` per document."""
    measured = scratch(measure(docs, fit(docs), id_col, lang_col)).withColumn(
        "base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    )
    passing = measured.filter(~F.col("base_failed"))
    once = scratch(passing.groupBy(lang_col, TEXT_HASH).agg(*[F.min(c).alias(c) for c in ("cross_entropy", "n_scored")]))
    middles = scratch(medians(once, lang_col))
    centred = once.join(middles, once[lang_col].eqNullSafe(middles["_lang"]))
    root = F.sqrt(F.greatest("n_scored", F.lit(1)))
    strays = (F.col("cross_entropy") - F.col("middle")) * root
    quartiles = F.percentile_approx(strays, [0.25, 0.75], 10_000)
    spread = F.greatest(quartiles[1] - quartiles[0], F.lit(LEAST_SPREAD))
    bands = scratch(centred.groupBy("_lang", "middle").agg(spread.alias("spread")))
    token_scored = scratch(token_scores(docs))
    word_bands = scratch(_word_bands(once.join(token_scored, TEXT_HASH), lang_col))
    measured = measured.join(token_scored, TEXT_HASH, "left")
    joined = measured.join(bands, measured[lang_col].eqNullSafe(bands["_lang"]), "left")
    joined = joined.join(word_bands, joined[lang_col].eqNullSafe(word_bands["_word_lang"]), "left")
    most = F.col("word_middle") + width * F.greatest("word_spread", F.col("word_stray") / F.sqrt("n_tokens"))
    reach = F.lit(float(width)) * F.col("spread") / root
    inside = F.col("cross_entropy").between(F.col("middle") - reach, F.col("middle") + reach) & (F.col("word_entropy") <= most)
    return joined.select(
        id_col,
        *MEASURES,
        "base_failed",
        (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept"),
        F.exp("cross_entropy").alias("perplexity"),
        F.exp(F.col("middle") - reach).alias("lowest_perplexity"),
        F.exp(F.col("middle") + reach).alias("highest_perplexity"),
        F.exp("word_entropy").alias("word_perplexity"),
        F.exp(most).alias("highest_word_perplexity"),
    )
