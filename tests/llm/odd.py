"""Documents with everything that may go wrong in a row, and plain versions of the contracts."""

import hashlib
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")

# The columns of documents, and others whose names the operators use themselves.
CLASHING = ["id", "n", "fp", "h", "key", "rank", "size", "copies", "line", "place", "words", "bucket", "score", "_id", "u", "v"]
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        *[T.StructField(c, T.StringType()) for c in CLASHING],
    ]
)


def prose(seed, words):
    draw = random.Random(seed)
    return " ".join("".join(draw.choice(["ta", "ri", "mo", "len", "sku", "é", "ß"]) for _ in range(draw.randint(1, 3))) for _ in range(words))


def texts():
    base = prose(1, 120)
    long = prose(2, 6000)
    changed = base.split()
    changed[60] = "changed"
    draw = random.Random(7)
    return [
        (1, base),
        (2, base),  # equal text
        (3, " ".join(changed)),  # one word away
        (4, None),
        (5, ""),
        (6, " \t\n "),
        (7, "one"),
        (8, "one"),
        (9, "a b c d"),
        (10, long),
        (11, long + " tail"),
        (12, "x" * 30_000),
        (13, "ab" * 700 + "z" + "ab" * 300),
        (14, prose(3, 40) + "\n" + prose(4, 12) + "\n" + prose(3, 40)),
        (15, prose(4, 12) + "\nshort line\nshort line\n" + prose(5, 30)),
        (16, prose(4, 12).replace("ta", "ri", 1) + "\n" + prose(6, 15)),
        (17, "Mail a.b@mail7.example.com or ip 10.0.0.255, card 4111 1111 1111 1111, call +1 (555) 010-9999 now"),
        (18, "日本語 " * 40 + "\U0001f600 end"),
        (None, prose(8, 50)),
        (None, None),
        *[(30 + i, base[draw.randint(0, 200) :] + " " + prose(100 + i, 20)) for i in range(10)],
        (50, prose(9, 25)),
        (50, prose(9, 25)),  # a repeated row
    ]


def rows():
    out = []
    for i, (doc_id, text) in enumerate(texts()):
        lang = [None, "en", "de"][i % 3]
        source = [None, "b", "a", "ü"][i % 4]
        out.append((doc_id, text, lang, source, None if text is None else len(text), *[str(i)] * len(CLASHING)))
    return out


def odd(spark, keep=lambda row: True):
    return spark.createDataFrame([r for r in rows() if keep(r)], SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) >= 5:
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
    return {tuple(words)} if words else set()


def components(pairs):
    """doc_id -> (set size, smallest id reachable), for unique ids."""
    sets = {d: shingles(t) for d, t in pairs}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for d in sorted(sets):
        for s in sets[d]:
            holders[s].append(d)
    common = Counter((a, b) for h in holders.values() for j, b in enumerate(h) for a in h[:j])
    for (a, b), c in common.items():
        if 100 * c >= 75 * (len(sets[a]) + len(sets[b]) - c):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def one_word_apart(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    p = q = 0
    while p < min(len(a), len(b)) and a[p] == b[p]:
        p += 1
    while q < min(len(a), len(b)) and a[-1 - q] == b[-1 - q]:
        q += 1
    return p + q >= max(len(a), len(b)) - 1


def kept_lines(pairs):
    """doc_id -> text without lines equal or near to an earlier one, for unique ids."""
    seen, out = [], {}
    for d, text in sorted(pairs):
        kept = []
        for line in (text or "").split("\n"):
            words = WORD.findall(line)
            if len(words) < 5 or not any(one_word_apart(words, s) for s in seen):
                kept.append(line)
            if len(words) >= 5:
                seen.append(words)
        out[d] = None if text is None else "\n".join(kept)
    return out


def cut_repeats(pairs, width=100):
    """doc_id -> (bytes, removed, runs, hash of the rest), for unique ids."""
    seen, out = set(), {}
    for d, text in sorted(pairs):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - width + 1):
            window = raw[i : i + width]
            if window in seen:
                gone[i : i + width] = b"\1" * width
            seen.add(window)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        rest = bytes(c for c, g in zip(raw, gone) if not g)
        out[d] = (len(raw), sum(gone), runs, hashlib.sha256(rest).hexdigest())
    return out


def unique_pairs():
    found = {}
    for d, t in texts():
        if d is not None:
            found.setdefault(d, t)
    return list(found.items())
