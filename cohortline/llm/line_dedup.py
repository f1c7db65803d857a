"""Line dedup by a deletion-neighbourhood join, in DataFrame operations only.

A line is a ``\\n``-split piece of a text; its words are its runs of non-white-space. Two lines are near when one
word changed, added or left out turns one into the other. A line goes when an equal or near line occurs earlier
(smaller document id, null last, or the same document, further up). Lines with fewer than ``min_words`` words always
stay, and what a line is compared with does not depend on whether that other line stays.

1. Equal lines are one line: its digest and its earliest place. All but the earliest go.
2. Two near lines share their first or last half, give or take a word. A line none of whose halves occurs
   in another line has no near line; the neighbourhood is only emitted for the others.
3. Each remaining line emits itself and every variant with one word deleted, as hashed keys with the position. Equal
   variants are a changed word; a variant equal to a whole line is an added or missing word. Per key only the earliest
   lines matter, so a key shared by any number of lines is one aggregate, never pairs.
4. Every line keeps its earliest partners, and the edit distance to them is verified on the words.

Defined results: a null text has no lines and stays null; an empty text stays empty; ties (the same document
id in several rows) are broken by a hash of the text; rows that are equal in id and text are copies of one
another and keep the same lines; an empty table gives an empty result; other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.llm.common import scratch

MIN_WORDS = 5
BLOCK_BITS = 3
BLOCK = 1 << BLOCK_BITS  # words that are hashed together
# White space in a line other than one blank between two words.
UNEVEN_SPACE = r"[\x09\x0B-\x0D][\x20\x09\x0B-\x0D]*|\x20[\x20\x09\x0B-\x0D]+"


def spaced(line: Column) -> Column:
    """The words of a line with one blank between them."""
    return F.trim(F.regexp_replace(line, UNEVEN_SPACE, " "))


def spaced_lines(text: Column) -> Column:
    """The lines of a text, each as its words with one blank between them.

    Most texts are spaced like that as they are; a search for plain strings tells so faster than a pattern.
    """
    uneven = text.startswith(" ") | text.endswith(" ")
    for piece in ("  ", " \n", "\n ", "\t", "\x0b", "\x0c", "\r"):
        uneven = uneven | text.contains(piece)
    lines = F.split(text, "\n")
    return F.when(uneven, F.transform(lines, spaced)).otherwise(lines)


def word_count(line: Column) -> Column:
    """Words of a line that ``spaced`` made."""
    return F.when(line == "", 0).otherwise(occurrences(line, " ") + 1)


def occurrences(text: Column, sign: str) -> Column:
    """How often one ASCII character occurs."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(sign), F.lit("")))


def has_words(line: Column, n: int) -> Column:
    """Whether a line that ``spaced`` made has ``n`` words or more; it is read as far as that only."""
    if n <= 1:
        return (line != "") | F.lit(n <= 0)
    return F.octet_length(F.substring_index(line, " ", n - 1)) < F.octet_length(line)


def document_number(id_col: Column, text: Column) -> Column:
    """One number that orders documents by id (null last), then by a hash of the text."""
    spread = F.pmod(F.xxhash64(text), F.lit(1 << 32)).cast("decimal(20,0)")
    number = F.coalesce(id_col.cast("decimal(20,0)"), F.lit((1 << 63) - 1).cast("decimal(20,0)"))
    return (number * F.lit(1 << 32).cast("decimal(11,0)") + spread).cast("decimal(32,0)")


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per line: ``doc`` and ``at``, and its words as ``line``."""
    text = F.col(text_col).cast("string")
    doc = document_number(F.col(id_col), text)
    # Spaced inside the array: a projection would be computed again in every filter that is pushed below it.
    return docs.select(doc.alias("doc"), F.posexplode(spaced_lines(text)).alias("at", "line"))


def place_of(doc: Column, at: Column) -> Column:
    """A number that orders all lines. A smallest decimal per group is found in a hash table, a smallest struct by sorting."""
    return (doc * F.lit(1 << 31).cast("decimal(10,0)") + at.cast("decimal(10,0)")).cast("decimal(38,0)")


def digest_of(line: Column) -> Column:
    return F.unhex(F.md5(line))


def distinct_lines(lines: DataFrame, min_words: int) -> DataFrame:
    """One row per different line that is long enough.

    ``line``, its number of ``words``, its ``digest``, the ``place`` of the earliest, and ``n`` occurrences.
    """
    counted = lines.filter(has_words(F.col("line"), min_words)).select("line", place_of(F.col("doc"), F.col("at")).alias("place"))
    grouped = counted.groupBy("line").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("n"))
    return grouped.withColumns({"digest": digest_of(F.col("line")), "words": word_count(F.col("line"))})


def with_shared_half(distinct: DataFrame) -> DataFrame:
    """Lines that share their first or last words with another, so far that they can be near it.

    If one word differs, the lines agree before it and after it, and the shorter of both sides is at most half of
    the line. With h = floor(n / 2) for the own length, and for one word less, the longer side covers it.
    """
    n = F.col("words")

    def ends(length: Column) -> list[Column]:
        h = F.floor(length).cast("int")
        return [
            F.xxhash64(F.lit("first"), h, F.call_function("substring_index", F.col("line"), F.lit(" "), h)),
            F.xxhash64(F.lit("last"), h, F.call_function("substring_index", F.col("line"), F.lit(" "), -h)),
        ]

    # For an odd number of words both lengths are the same.
    halves = F.when(n % 2 == 1, F.array(*ends(n / 2))).otherwise(F.array(*ends(n / 2 - 1), *ends(n / 2)))
    keyed = scratch(distinct.select("place", F.explode(halves).alias("half")))
    # Written first: a join of two plain inputs is one whose hot keys adaptive execution can split.
    met = scratch(keyed.groupBy("half").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("half"))
    found = keyed.join(met, "half", "left_semi").select("place").distinct()
    return distinct.select("place", "line").join(found, "place", "left_semi")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of a value that is computed once, also where ``use`` names it inside a lambda."""
    return F.get(F.transform(F.array(value), use), 0)


def _chain(words: Column) -> Column:
    """Hashes of the first 0, 1, 2, ... words.

    A beginning is the hash of its whole blocks, each made from the one before it, and of the words after them. A chain
    word by word would copy all hashes before it for every word.
    """

    def blocks(words: Column) -> Column:
        start = F.array(F.xxhash64(F.lit("start")))
        at = F.sequence(F.lit(0), F.shiftright(F.size(words), BLOCK_BITS))
        return F.aggregate(at, start, lambda made, b: F.concat(made, F.array(F.xxhash64(F.element_at(made, -1), F.slice(words, b * BLOCK + 1, BLOCK)))))

    def beginnings(words: Column, whole: Column) -> Column:
        rest = F.sequence(F.lit(0), F.size(words))
        return F.transform(rest, lambda i: F.xxhash64(F.get(whole, F.shiftright(i, BLOCK_BITS)), F.slice(words, i - i % BLOCK + 1, i % BLOCK)))

    return _once(words, lambda w: _once(blocks(w), lambda whole: beginnings(w, whole)))


def earliest_partners(candidates: DataFrame) -> DataFrame:
    """The earliest lines that share a variant with a later one: ``place`` of the later, ``partner`` of the earlier.

    The key of a variant with word i left out is a hash of the words before i and the words after it, so a variant costs
    one hash of two numbers. The line itself is listed under each split in two, where it meets the variants
    of lines with one word more at that place.
    """
    words = F.split("line", " ")
    # Beginnings by length, and ends from the whole line down to nothing.
    split = scratch(candidates.select("place", _chain(words).alias("head"), F.reverse(_chain(F.reverse(words))).alias("tail")))

    rows = split.select("place", "head", "tail", F.slice("tail", 2, F.size("tail")).alias("after"))
    spots = rows.select("place", F.inline(F.arrays_zip("head", "tail", "after")))
    whole = F.struct(F.xxhash64("head", "tail").alias("key"), F.lit(True).alias("whole"))
    left_out = F.struct(F.xxhash64("head", "after").alias("key"), F.lit(False).alias("whole"))
    # After the last word there is none to leave out.
    both = F.when(F.col("after").isNull(), F.array(whole)).otherwise(F.array(whole, left_out))
    variants = spots.select("place", F.explode(both).alias("v")).select("place", "v.key", "v.whole")
    # Per key only the earliest whole line and the earliest line with a word left out matter.
    per_key = variants.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(F.col("whole"), F.col("place"))).alias("first_whole"),
        F.min(F.when(~F.col("whole"), F.col("place"))).alias("first_left_out"),
    )
    useful = scratch(per_key.filter("n > 1").drop("n"))
    met = variants.join(useful, "key")
    partners = F.when(F.col("whole"), F.array("first_left_out")).otherwise(F.array("first_whole", "first_left_out"))
    links = met.select("place", F.explode(partners).alias("partner"))
    return links.filter(F.col("partner") < F.col("place")).distinct()


def one_word_apart(a: Column, b: Column) -> Column:
    """Whether one word changed, added or left out turns one word array into the other."""

    def agree(x: Column, y: Column) -> Column:
        """Number of leading words in common."""
        differ = F.array_position(F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False))), False)
        return F.when(differ > 0, differ - 1).otherwise(F.greatest(F.size(x), F.size(y))).cast("int")

    longest = F.greatest(F.size(a), F.size(b))
    return (F.abs(F.size(a) - F.size(b)) <= 1) & (
        agree(a, b) + agree(F.reverse(a), F.reverse(b)) >= longest - 1
    )


def near_lines(distinct: DataFrame) -> DataFrame:
    """Places of lines that have an earlier near line, verified on the words."""
    candidates = scratch(with_shared_half(distinct))
    partners = earliest_partners(candidates)
    left = candidates.select("place", F.col("line").alias("line_a"))
    right = candidates.select(F.col("place").alias("partner"), F.col("line").alias("line_b"))
    checked = partners.join(left, "place").join(right, "partner")
    return checked.filter(one_word_apart(F.split("line_a", " "), F.split("line_b", " "))).select("place").distinct()


def dropped_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All lines that go: ``doc`` (see ``document_number``) and ``at``, counted from 0."""
    lines = lines_of(docs, id_col, text_col)
    distinct = scratch(distinct_lines(lines, min_words))
    near = scratch(near_lines(distinct).withColumn("near", F.lit(True)))
    # From here on only lines that occur again or are near an earlier one matter.
    verdict = distinct.select("digest", "place", "n").join(near, "place", "left").filter("near OR n > 1")
    verdict = scratch(verdict.select("digest", F.col("place").alias("earliest"), "near"))
    long_enough = lines.filter(has_words(F.col("line"), min_words))
    judged = long_enough.select("doc", "at", digest_of(F.col("line")).alias("digest")).join(verdict, "digest")
    gone = judged.filter(F.col("near") | (place_of(F.col("doc"), F.col("at")) > F.col("earliest")))
    return gone.select("doc", "at").distinct()


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the lines that stay as text, and ``_dropped_lines`` and ``_kept_lines`` counted."""
    gone = dropped_lines(docs, min_words, id_col, text_col).groupBy(F.col("doc").alias("_doc"))
    gone = scratch(gone.agg(F.collect_set("at").alias("_dropped_at")))
    text = F.col(text_col).cast("string")
    joined = docs.join(gone, document_number(docs[id_col], text) == gone["_doc"], "left")
    # Only texts that lose a line are split, once each.
    kept_parts = _once(
        F.split(text, "\n"),
        lambda parts: F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("_dropped_at")), lambda i: F.get(parts, i)),
    )
    kept = F.when(F.col("_dropped_at").isNull(), text).otherwise(F.array_join(kept_parts, "\n"))
    count = F.when(F.col("_dropped_at").isNull(), 0).otherwise(F.size("_dropped_at")).cast("long")
    total = F.when(text.isNull(), 0).otherwise(occurrences(text, "\n") + 1).cast("long")
    return joined.withColumns({text_col: kept, "_dropped_lines": count, "_kept_lines": total - count}).drop("_doc", "_dropped_at")
