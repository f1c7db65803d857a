"""Personal data by anchor expansion.

One Aho-Corasick pass finds where personal data can be: at-signs, scheme separators, and words that announce
an account or a secret. A parser at each anchor expands to both sides and validates what it finds, so work
is linear in the text and a long run of letters without an anchor costs nothing. Numbers without an anchor
(addresses of machines, cards, telephones) start at their digits or plus sign.

``base`` spans follow fixed patterns, leftmost and non-overlapping per kind: email, ip, card, phone. The method
adds url, iban, account and secret spans; added spans never remove a base one. Positions are code points, end
exclusive.

Defined results: a null or empty text has no spans; repeated rows each have their own; a document may be of
any length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from ahocorasick import Automaton
from pyspark.sql import DataFrame

from cohortline.llm.common import record_batch, whole_texts

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "iban", "account", "secret")

# Anchors and what they announce. Cues are matched in lower-cased text.
ANCHORS = {
    "@": "email",
    "://": "url",
    "iban": "iban",
    "account": "account",
    "acct": "account",
    "konto": "account",
    "cuenta": "account",
    "compte": "account",
    "passport": "account",
    "ssn": "account",
    "token": "secret",
    "api_key": "secret",
    "apikey": "secret",
    "password": "secret",
    "passwd": "secret",
    "secret": "secret",
}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
URL_REST = re.compile(r"[^\s<>\"'|]+")
IBAN = re.compile(r"[\s:=#.]{0,4}([A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]){10,30})(?![A-Za-z0-9])")
ACCOUNT = re.compile(r"(?:\s*(?:number|nummer|no|nr|id))?[\s:=#.]{0,4}([0-9](?:[ -]?[0-9]){5,19})(?![0-9])", re.I)
SECRET = re.compile(r"\s*[:=]\s*[\"']?([A-Za-z0-9_+/=-]{12,})")
_TO_VALUE = {c: str(int(c, 36)) for c in "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)

Span = tuple[int, int, int]  # start, number of the kind, end


def luhn(digits: str) -> bool:
    values = [ord(c) - 48 for c in reversed(digits)]
    return (sum(values[::2]) + sum(_DOUBLED[v] for v in values[1::2])) % 10 == 0


def iban_valid(text: str) -> bool:
    code = text.replace(" ", "").upper()
    return 15 <= len(code) <= 34 and int("".join(_TO_VALUE[c] for c in code[4:] + code[:4])) % 97 == 1


def automaton() -> Automaton:
    found = Automaton()
    for anchor, kind in ANCHORS.items():
        found.add_word(anchor, (kind, len(anchor)))
    found.make_automaton()
    return found


def _email(text: str, at: int, free: int) -> Span | None:
    start = at
    while start > free and text[start - 1] in LOCAL:
        start -= 1
    if start == at:
        return None
    domain = DOMAIN.match(text, at + 1)
    return domain and (start, 0, domain.end())


def _url(text: str, at: int, free: int) -> Span | None:
    start = at
    while start > free and text[start - 1] in SCHEME:
        start -= 1
    while start < at and not ("a" <= text[start].lower() <= "z"):
        start += 1
    rest = URL_REST.match(text, at + 3)
    if start == at or not rest:
        return None
    end = rest.end()
    while end > at + 3 and text[end - 1] in ".,;:!?)":
        end -= 1
    return (start, 4, end) if end > at + 3 else None


def _after_cue(pattern: re.Pattern, kind: int, text: str, at: int) -> Span | None:
    found = pattern.match(text, at)
    return found and (found.start(1), kind, found.end(1))


def _iban(text: str, at: int) -> Span | None:
    found = IBAN.match(text, at)
    if not found:
        return None
    start, end = found.span(1)
    while end - start >= 15:  # words that follow may look like further groups
        if iban_valid(text[start:end]):
            return start, 5, end
        space = text.rfind(" ", start, end)
        if space < 0:
            return None
        end = space
    return None


def anchored(text: str, find: Automaton) -> list[Span]:
    """Spans grown from anchors; those of one kind do not overlap."""
    lowered = text.lower()
    if len(lowered) != len(text):  # a few letters change their length
        lowered = "".join(c if len(c.lower()) > 1 else c.lower() for c in text)
    out: list[Span] = []
    free = dict.fromkeys(KINDS, 0)
    for last, (kind, length) in find.iter(lowered):
        at = last - length + 1
        if kind == "email":
            span = _email(text, at, free[kind])
        elif at < free[kind]:
            continue
        elif kind == "url":
            span = _url(text, at, free[kind])
        elif kind == "iban":
            span = _iban(text, last + 1)
        elif kind == "account":
            span = _after_cue(ACCOUNT, 6, text, last + 1)
        else:
            span = _after_cue(SECRET, 7, text, last + 1)
        if span:
            out.append(span)
            free[kind] = span[2]
    return out


def numeric(text: str) -> list[Span]:
    out: list[Span] = []
    for m in IP.finditer(text):
        if all(len(short) <= 3 and int(short or "0") <= 255 for short in (part.lstrip("0") for part in m.groups())):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return out


def spans_of(text: str, find: Automaton) -> list[Span]:
    """All spans of a text by start, then kind."""
    return sorted(anchored(text, find) + numeric(text))


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id_col`` and ``found``, an array of (kind, start, end, base)."""
    kept = docs.schema[id_col].dataType.simpleString()
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = automaton()
        for batch in batches:
            schema = pa.schema([(id_col, batch.column(0).type), ("found", pa.list_(item))])
            found = [
                [{"kind": KINDS[k], "start": s, "end": e, "base": k < len(BASE_KINDS)} for s, k, e in spans_of(t, find)]
                for t in batch.column(1).to_pylist()
            ]
            yield record_batch(schema, [batch.column(0), found])

    kind = "array<struct<kind:string,start:long,end:long,base:boolean>>"
    return whole_texts(docs, id_col).mapInArrow(scan, f"`{id_col}` {kept}, found {kind}")


def digest(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of base spans per kind, SHA-256 of the listed base spans, and all spans listed."""
    kept = docs.schema[id_col].dataType.simpleString()
    counts = [f"n_{kind}" for kind in BASE_KINDS]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = automaton()
        for batch in batches:
            rows: list[list] = [[] for _ in range(len(counts) + 3)]
            for text in batch.column(1).to_pylist():
                spans = spans_of(text, find)
                base = [s for s in spans if s[1] < len(BASE_KINDS)]
                values = [sum(s[1] == k for s in base) for k in range(len(counts))]
                values += [hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(spans), len(spans) - len(base)]
                for column, value in zip(rows, values, strict=True):
                    column.append(value)
            kinds = [pa.int64()] * len(counts) + [pa.string(), pa.string(), pa.int64()]
            names = [*counts, "base_sha256", "spans", "n_added"]
            schema = pa.schema([(id_col, batch.column(0).type), *zip(names, kinds, strict=True)])
            yield record_batch(schema, [batch.column(0), *rows])

    numbers = ", ".join(f"{c} long" for c in counts)
    return whole_texts(docs, id_col).mapInArrow(
        scan, f"`{id_col}` {kept}, {numbers}, base_sha256 string, spans string, n_added long"
    )
