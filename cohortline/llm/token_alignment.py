"""Alignment of two tokenizers over the same texts: groups of tokens between common ends, and linked id pairs with their counts.

Tokenizer A is byte-level BPE, tokenizer B has pieces with byte fallback; both cover a space and then the text. Their tokens are
laid over the bytes of it. Offsets at which tokens of both end cut the tokens into groups, and two tokens are linked if
their bytes overlap. Method: galloping intersection of the two lists of ends.

* The shorter list of a text drives. For each of its ends the search goes on from where the last one stopped: steps of 1, 2, 4, ...
  until the end is passed, then a binary search in the last step (``gallop``). Many stretches of the list are driven side
  by side; only the first end of each is looked up by a plain binary search.
* An end that is met is common: it closes a group on both sides. The ranks of two neighbouring ends say which tokens of the
  longer list a token of the shorter one overlaps, so links are read off rank differences.
* In how many texts an id pair is linked is counted over the corpus: a chunk of texts first reduces its links to
  distinct pairs, the chunks' counts are added by a grouping, and the best pairs of an A id are found per id, of which there are
  no more than B has ids. The counts go back to the chunks by a join on the pair and meet the texts again by chunk.

Null and empty texts, and texts that either tokenizer does not give back byte for byte (B may normalise), have no tokens: all
numbers are 0 and ``groups`` is empty. Ties for an id's highest count all are best. Repeated rows and equal ids are rows
like any other and count each; extra columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortline.llm.common import record_batch, scratch, text_chunks, whole_texts
from cohortline.llm.packing import byte_letters
from cohortline.llm.periodic_runs import ragged
from cohortline.operators.joins import lookup_join

# Ends that one search after another walks through; stretches of this length are walked side by side.
STRETCH = 64

# Before a space between two characters that are none, byte-level pre-tokens always end.
_CUT = re.compile(r"(?<=\S)(?= \S)")

# The letters among ASCII and the Latin characters below U+0250, and the byte-level pre-tokens of a piece that has, after
# a space or none, only these, digits and other visible ASCII.
_LETTERS = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
_PLAIN = re.compile(rf" ?[!-~{_LETTERS}]+")
_PRE_TOKENS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^ 0-9{_LETTERS}]+")


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For each end in ``short`` the place of the first end in ``long`` that is not before it. Both rise, and ``long`` ends last."""
    rank = np.empty(len(short), np.int64)
    if len(short) == 0:
        return rank
    firsts = np.arange(0, len(short), STRETCH)
    at = np.searchsorted(long, short[firsts])
    rank[firsts] = at
    last = len(long) - 1
    for turn in range(1, STRETCH):
        own = firsts + turn
        own = own[own < len(short)]
        if len(own) == 0:
            break
        wanted, low = short[own], at[: len(own)].copy()
        high, step = low.copy(), 1
        ahead = np.flatnonzero(long[low] < wanted)
        while len(ahead):  # exponential: everything before low is too small
            low[ahead] = high[ahead] + 1
            high[ahead] = np.minimum(high[ahead] + step, last)
            low[ahead] = np.minimum(low[ahead], last)
            ahead = ahead[long[high[ahead]] < wanted[ahead]]
            step *= 2
        inside = np.flatnonzero(low < high)
        while len(inside):  # binary, in the last step
            middle = (low[inside] + high[inside]) >> 1
            small = long[middle] < wanted[inside]
            low[inside] = np.where(small, middle + 1, low[inside])
            high[inside] = np.where(small, high[inside], middle)
            inside = inside[low[inside] < high[inside]]
        rank[own] = high
        at = high
    return rank


def overlaps(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Common ends as a mask over ``short`` and places in ``long``, and the links as places in both."""
    rank = gallop(short, long)
    common = long[rank] == short if len(short) else np.zeros(0, bool)
    first = np.r_[0, (rank + common)[:-1]] if len(short) else rank
    many = rank - first + 1
    return common, rank[common], np.repeat(np.arange(len(short)), many), np.repeat(first, many) + ragged(many)


# A character that hardly occurs, and how much text with it is coded at once.
MARK = "\x02"
JOINED = 1 << 16

# Pre-tokens longer than this are not kept, and no more than this many are.
KEPT_LENGTH = 64
KEPT_WORDS = 1 << 18


class WordCoder:
    """Ids of pieces of text after which the tokenizer always cuts, as little-endian unsigned 32-bit numbers; each is coded once and kept.

    Pieces of letters, digits and signs that are easily told (``_PLAIN``) are taken apart here and only the merging is left to
    the tokenizer's model; their parts are kept too, as most occur in several pieces. For the others a call of the tokenizer costs
    more than a word, so new ones are coded many in one text, with ``between`` after each: a text with ``MARK``, before which
    the tokenizer cuts too, so that the ids up to each mark are those of one piece. Pieces that have the mark in them are
    coded one by one.
    """

    def __init__(self, tokenizer: Tokenizer, between: str = f" {MARK}"):
        self.tokenizer, self.model, self.between = tokenizer, tokenizer.model, between
        *self.before, self.mark = tokenizer.encode(between, add_special_tokens=False).ids
        self.kept: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.letters = byte_letters()

    def code(self, split: list[list[str]]) -> list[bytes]:
        if len(self.kept) > KEPT_WORDS:
            self.kept.clear()
        if len(self.parts) > KEPT_WORDS:
            self.parts.clear()
        new = list({word for words in split for word in words if word not in self.kept})
        self.kept.update(zip(new, self._ids(new), strict=True))
        coded = [b"".join(map(self.kept.__getitem__, words)) for words in split]
        for word in new:
            if len(word) > KEPT_LENGTH:
                del self.kept[word]
        return coded

    def _ids(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(words)
        held, size = [], 0
        for i, word in enumerate(words):
            if _PLAIN.fullmatch(word):
                out[i] = b"".join([self.parts.get(part) or self._part(part) for part in _PRE_TOKENS.findall(word)])
                continue
            if MARK in word:
                out[i] = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
                continue
            held.append(i)
            size += len(word)
            if size >= JOINED:
                self._joined(words, held, out)
                held, size = [], 0
        if held:
            self._joined(words, held, out)
        return out

    def _part(self, part: str) -> bytes:
        ids = [token.id for token in self.model.tokenize(part.encode().decode("latin-1").translate(self.letters))]
        coded = struct.pack(f"<{len(ids)}I", *ids)
        if len(part) <= KEPT_LENGTH:
            self.parts[part] = coded
        return coded

    def _joined(self, words: list[str], held: list[int], out: list[bytes]) -> None:
        text = "".join([words[i] + self.between for i in held])
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        marks = np.flatnonzero(ids == self.mark)
        raw = ids.tobytes()
        ends = (4 * (marks - len(self.before))).tolist()
        begins = [0, *(4 * (marks + 1)).tolist()[:-1]]
        for i, begin, end in zip(held, begins, ends, strict=True):
            out[i] = raw[begin:end]


class ByteLevel:
    """Tokenizer A: ids of a space and the text, and the bytes of each id."""

    def __init__(self, described: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals the work; threads of the library would wait for it in a loop
        tokenizer = Tokenizer.from_str(described)
        tokenizer.encode_special_tokens = True
        alphabet = {letter: byte for byte, letter in byte_letters().items()}
        vocabulary = tokenizer.get_vocab(with_added_tokens=False)
        self.bytes = [b""] * (max(tokenizer.get_vocab().values()) + 1)
        for token, i in vocabulary.items():
            if all(c in alphabet for c in token):
                self.bytes[i] = bytes(alphabet[c] for c in token)
        self.coder = WordCoder(tokenizer)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        coded = self.coder.code([_CUT.split(" " + text) if text else [] for text in texts])
        return [np.frombuffer(ids, "<u4").astype(np.int64) for ids in coded]


class Pieces:
    """Tokenizer B: ids of the text, to which it adds a space, and the bytes of each id."""

    def __init__(self, model: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(self.model.get_piece_size())
        self.bytes = [
            bytes([int(self.model.id_to_piece(i)[3:5], 16)]) if self.model.is_byte(i) else self.model.id_to_piece(i).replace("▁", " ").encode()
            for i in ids
        ]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int64) for ids in self.model.encode(texts, num_threads=1)]


class Aligner:
    """Everything about the texts of one chunk."""

    def __init__(self, described: str, model: bytes):
        self.a, self.b = ByteLevel(described), Pieces(model)
        self.size_a, self.size_b = (np.array([len(x) for x in side.bytes], np.int64) for side in (self.a, self.b))
        most = max(len(self.a.bytes), len(self.b.bytes))
        self.comma, self.bar, self.stop = (np.array([f"{i}{mark}" for i in range(most)], object) for mark in ",|;")

    def _tokens(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        none = np.zeros(0, np.int64)
        own_a, own_b = self.a.encode(texts), self.b.encode(texts)
        for i, text in enumerate(texts):
            whole = (" " + text).encode()
            if not text or any(
                b"".join(map(side.bytes.__getitem__, ids.tolist())) != whole for side, ids in ((self.a, own_a[i]), (self.b, own_b[i]))
            ):
                own_a[i] = own_b[i] = none
        return own_a, own_b

    def align(self, texts: list[str]) -> tuple[dict[str, np.ndarray], list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Numbers per text, groups as strings, and the links: text, A id, B id."""
        own_a, own_b = self._tokens(texts)
        n_a, n_b = (np.fromiter(map(len, own), np.int64, len(own)) for own in (own_a, own_b))
        a, b = (np.concatenate([np.zeros(0, np.int64), *own]) for own in (own_a, own_b))
        # Both tokenizers cover the same bytes of each text, so ends counted through the chunk agree as well.
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        doc_a, doc_b = np.repeat(np.arange(len(texts)), n_a), np.repeat(np.arange(len(texts)), n_b)
        closes_a, closes_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        links = []
        for a_drives in (True, False):
            chosen = (n_a <= n_b) == a_drives
            in_a, in_b = np.flatnonzero(chosen[doc_a]), np.flatnonzero(chosen[doc_b])
            if a_drives:
                common, met, left, right = overlaps(ends_a[in_a], ends_b[in_b])
                closes_a[in_a[common]], closes_b[in_b[met]] = True, True
            else:
                common, met, right, left = overlaps(ends_b[in_b], ends_a[in_a])
                closes_b[in_b[common]], closes_a[in_a[met]] = True, True
            links.append((in_a[left], in_b[right]))
        left, right = (np.concatenate(side) for side in zip(*links, strict=True))
        doc = doc_a[left]
        numbers = {
            "n_a": n_a,
            "n_b": n_b,
            "n_groups": np.bincount(doc_a[closes_a], minlength=len(texts)),
            "n_links": np.bincount(doc, minlength=len(texts)),
        }
        return numbers, self._groups(a, b, closes_a, closes_b, n_a + n_b), doc, a[left], b[right]

    def _groups(self, a: np.ndarray, b: np.ndarray, closes_a: np.ndarray, closes_b: np.ndarray, many: np.ndarray) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` per text: the tokens of a group, A before B, in the order of the groups."""
        after_a, after_b = np.flatnonzero(closes_a) + 1, np.r_[0, np.flatnonzero(closes_b) + 1]
        out = np.empty(len(a) + len(b), object)
        out[np.arange(len(a)) + after_b[np.cumsum(closes_a) - closes_a]] = np.where(closes_a, self.bar[a], self.comma[a])
        if len(b):
            out[np.arange(len(b)) + after_a[np.cumsum(closes_b) - closes_b]] = np.where(closes_b, self.stop[b], self.comma[b])
        ends = np.cumsum(many)
        return ["".join(out[begin:end])[:-1] for begin, end in zip(ends - many, ends, strict=True)]


_NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text: str = "text", whole: bool = False) -> DataFrame:
    """One row per text: ``id_col``, ``n_a``, ``n_b`` (tokens), ``n_groups``, ``n_links``, ``n_best`` (links whose pair is in as
    many texts as any pair of its A id), ``count_sum`` (of the pairs' counts over the links), all long, ``groups_sha256``
    string and, if ``whole``, ``groups`` string: ``a1,a2|b1;a3|b2,b3``, the ids of each group.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    context = docs.sparkSession.sparkContext
    with open(path_a, encoding="utf-8") as file, open(path_b, "rb") as other:  # vocabularies: fixed files of a few MB
        files = context.broadcast((file.read(), other.read()))
    ids_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    chunks = scratch(_chunks(docs, files, ids_b, id_col, kind, text, whole))

    # A chunk's pairs stand in the row of its first text.
    listed = chunks.filter(F.col("pairs").isNotNull()).select("chunk", F.posexplode(F.arrays_zip("pairs", "holds")).alias("place", "p"))
    listed = listed.select("chunk", "place", F.col("p.pairs").alias("pair"), F.col("p.holds").alias("holds"))
    counts = listed.groupBy("pair").agg(F.sum("holds").alias("count"))
    of_a = Window.partitionBy(F.expr(f"pair div {ids_b}"))
    counts = counts.withColumn("best", F.col("count") == F.max("count").over(of_a))
    counted = lookup_join(listed, counts, ["pair"]).select(F.col("chunk").alias("of"), "place", "count", "best")

    names = [*_NUMBERS, "n_best", "count_sum", "groups_sha256", *(["groups"] if whole else [])]
    types = {**dict.fromkeys(names, "long"), "groups_sha256": "string", "groups": "string"}

    def total(texts: pa.Table, known: pa.Table) -> pa.Table:
        """The pairs' counts added up over the links of each text of a chunk."""
        count, best = np.zeros(known.num_rows, np.int64), np.zeros(known.num_rows, np.int64)
        place = known.column("place").to_numpy()
        count[place], best[place] = known.column("count").to_numpy(), known.column("best").to_numpy()
        sums = []
        for pair, times in zip(texts.column("entry_pair"), texts.column("entry_times"), strict=True):
            at, n = pair.values.to_numpy(), times.values.to_numpy().astype(np.int64)
            sums.append((int(n @ best[at]), int(n @ count[at])))
        best_sum, count_sum = zip(*sums, strict=True)
        made = {"n_best": pa.array(best_sum, pa.int64()), "count_sum": pa.array(count_sum, pa.int64())}
        return pa.table([texts.column(id_col), *[made[c] if c in made else texts.column(c) for c in names]], names=[id_col, *names])

    schema = ", ".join([f"`{id_col}` {kind}", *[f"{c} {types[c]}" for c in names]])
    own = chunks.drop("pairs", "holds")
    return own.groupBy("chunk").cogroup(counted.groupBy("of")).applyInArrow(total, schema)


def _chunks(docs: DataFrame, files, ids_b: int, id_col: str, kind: str, text: str, whole: bool) -> DataFrame:
    """A row per text: its numbers and groups, its distinct links as places in the chunk's list of pairs, and how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*files.value)
        chunk = TaskContext.get().partitionId() << 32
        for rows, offsets, data in text_chunks(batches):
            raw = data.tobytes()
            texts = [raw[s:e].decode() for s, e in zip(offsets[:-1], offsets[1:], strict=True)]
            n = len(texts)
            numbers, groups, doc, a, b = aligner.align(texts)
            entry, times = np.unique((a * ids_b + b) * n + doc, return_counts=True)
            pair, owner = entry // n, entry % n
            opens = np.r_[True, pair[1:] != pair[:-1]] if len(pair) else np.zeros(0, bool)
            place = np.cumsum(opens) - 1
            by_doc = np.argsort(owner, kind="stable")
            bounds = pa.array(np.searchsorted(owner[by_doc], np.arange(n + 1)), pa.int32())
            holds = np.bincount(place, minlength=0)
            first = [i == 0 for i in range(n)]
            columns = [
                np.full(n, chunk),
                rows.column(0),
                *[numbers[c] for c in _NUMBERS],
                [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups],
                *([groups] if whole else []),
                pa.ListArray.from_arrays(bounds, pa.array(place[by_doc], pa.int32())),
                pa.ListArray.from_arrays(bounds, pa.array(times[by_doc], pa.int32())),
                [pair[opens] if f else None for f in first],
                [holds if f else None for f in first],
            ]
            names = ["chunk", id_col, *_NUMBERS, "groups_sha256", *(["groups"] if whole else []), "entry_pair", "entry_times", "pairs", "holds"]
            lists = {"entry_pair": pa.list_(pa.int32()), "entry_times": pa.list_(pa.int32()), "pairs": pa.list_(pa.int64()), "holds": pa.list_(pa.int64())}
            strings = {"groups_sha256": pa.string(), "groups": pa.string(), id_col: rows.column(0).type}
            yield record_batch(pa.schema([(c, lists.get(c) or strings.get(c) or pa.int64()) for c in names]), columns)
            chunk += 1

    fields = ["chunk long", f"`{id_col}` {kind}", *[f"{c} long" for c in _NUMBERS], "groups_sha256 string"]
    fields += ["groups string"] if whole else []
    fields += ["entry_pair array<int>", "entry_times array<int>", "pairs array<long>", "holds array<long>"]
    return whole_texts(docs, id_col, text=text).mapInArrow(run, ", ".join(fields))
