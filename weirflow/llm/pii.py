"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over a text: at-signs,
plus signs, the first characters of numbers, URL schemes and words that
announce an identifier.  Around each anchor a deterministic parser that never
backtracks over more than the span in hand expands to the boundaries and
validates (octets, Luhn, digit counts, IBAN remainder).

Kinds ``email ip card phone`` follow fixed definitions (leftmost,
non-overlapping per kind; a span that fails its check is dropped and the scan
goes on behind it).  The cues add ``url``, ``iban`` and ``account``.

Defined results: a null text counts as empty, an empty text has no spans, very
long texts are scanned whole, rows are independent (repeated rows and ids give a
result each; null ids pass through; spans are ordered by start, then kind),
an empty table gives an empty table, and only the columns named are read, so
further columns of any name are harmless.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.spans import Span, digest, render

KINDS = ("email", "ip", "card", "phone", "url", "iban", "account")
BASE_KINDS = 4
EMAIL, IP, CARD, PHONE, URL, IBAN, ACCOUNT = range(len(KINDS))

DIGITS = frozenset(string.digits)
ALNUM = frozenset(string.ascii_letters + string.digits)
LOCAL = ALNUM | frozenset("._%+-")
DOMAIN = ALNUM | frozenset("-")
PHONE_BODY = DIGITS | frozenset(" ().-")
CARD_GAP = frozenset(" -")
URL_BODY = ALNUM | frozenset("-._~:/?#[]@!$&'()*+,;=%")
URL_TAIL = frozenset(".,;:!?)]'")
CUE_GAP = frozenset(" \t:#=.")

#: What announces a URL or an identifier.
SCHEMES = ("http://", "https://", "ftp://")
IBAN_CUES = ("iban",)
ACCOUNT_CUES = ("account", "acct", "ssn", "passport")

_AT, _PLUS, _DIGIT, _SCHEME, _IBAN, _ACCOUNT = range(6)


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    """Anchors with their class and length; cues in lower, title and upper case."""
    auto = ahocorasick.Automaton()
    auto.add_word("@", (_AT, 1))
    auto.add_word("+", (_PLUS, 1))
    for d in string.digits:
        auto.add_word(d, (_DIGIT, 1))
    for kind, words in ((_SCHEME, SCHEMES), (_IBAN, IBAN_CUES), (_ACCOUNT, ACCOUNT_CUES)):
        for word in words:
            for form in {word, word.title(), word.upper(), word.capitalize()}:
                auto.add_word(form, (kind, len(form)))
    auto.make_automaton()
    return auto


def _run(text: str, at: int, chars: frozenset[str]) -> int:
    """The first position from ``at`` on whose character is not in ``chars``."""
    n = len(text)
    while at < n and text[at] in chars:
        at += 1
    return at


def parse_email(text: str, at: int, floor: int) -> Span | None:
    """The address around the at-sign at ``at`` that starts at ``floor`` or later."""
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    end = _run(text, at + 1, DOMAIN)
    if start == at or end == at + 1:
        return None
    labels = 0
    while end < len(text) and text[end] == "." and (stop := _run(text, end + 1, DOMAIN)) > end + 1:
        end, labels = stop, labels + 1
    return (start, EMAIL, end) if labels else None


def parse_address(text: str, at: int) -> tuple[int, bool]:
    """Where the dotted quad at ``at`` ends and if it is valid; -1 if there is none."""
    end, valid = at, True
    for part in range(4):
        if part:
            if end >= len(text) or text[end] != ".":
                return -1, False
            end += 1
        stop = _run(text, end, DIGITS)
        if stop == end:
            return -1, False
        octet = text[end:stop].lstrip("0")
        valid = valid and len(octet) <= 3 and int(octet or "0") <= 255
        end = stop
    return end, valid


def luhn(digits: str) -> bool:
    """Whether the check digit at the end is right."""
    odd = digits[-1::-2]
    even = digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def parse_card(text: str, at: int) -> tuple[int, bool]:
    """Where the number at ``at`` with single gaps ends, and if it is a card's."""
    end, n = at + 1, len(text)
    while True:
        if end < n and text[end] in DIGITS:
            end += 1
        elif end + 1 < n and text[end] in CARD_GAP and text[end + 1] in DIGITS:
            end += 2
        else:
            break
    if end - at > 64:
        return end, False
    digits = "".join(c for c in text[at:end] if c in DIGITS)
    return end, 12 <= len(digits) <= 19 and luhn(digits)


def parse_phone(text: str, at: int) -> tuple[int, bool]:
    """Where the number behind the plus sign at ``at`` ends; -1 if there is none."""
    if at + 1 >= len(text) or text[at + 1] not in DIGITS:
        return -1, False
    last = _run(text, at + 2, PHONE_BODY) - 1
    while last >= at + 3 and text[last] not in DIGITS:
        last -= 1
    if last < at + 3:
        return -1, False
    n = sum(c in DIGITS for c in text[at : last + 1])
    return last + 1, 9 <= n <= 15


def parse_url(text: str, start: int, body: int) -> Span | None:
    """The URL whose scheme spans ``start`` to ``body``, without closing punctuation."""
    end = _run(text, body, URL_BODY)
    while end > body and text[end - 1] in URL_TAIL:
        end -= 1
    return (start, URL, end) if end > body else None


def parse_iban(text: str, cue_end: int) -> Span | None:
    """Behind its cue: country, check digits and up to 30 characters, remainder 1."""
    at = _run(text, cue_end, CUE_GAP)
    end = at
    while end < len(text) and end - at < 42 and (text[end] in ALNUM or text[end] == " " and text[end + 1 : end + 2] in ALNUM):
        end += 1
    for stop in range(end, at + 14, -1):
        code = text[at:stop].replace(" ", "").upper()
        if text[stop - 1] != " " and 15 <= len(code) <= 34 and code[:2].isalpha() and code[2:4].isdigit():
            if int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1:
                return at, IBAN, stop
    return None


def parse_account(text: str, cue_end: int) -> Span | None:
    """Behind its cue: 6 to 17 digits with single gaps."""
    at = _run(text, cue_end, CUE_GAP)
    if at == cue_end or at >= len(text) or text[at] not in DIGITS:
        return None
    end, _ = parse_card(text, at)
    n = sum(c in DIGITS for c in text[at:end])
    return (at, ACCOUNT, end) if 6 <= n <= 17 else None


def find(text: str) -> tuple[list[Span], list[Span]]:
    """Spans of the base kinds and spans that the cues add, in code points."""
    base: list[Span] = []
    more: list[Span] = []
    email_from = ip_from = card_from = phone_from = url_from = 0
    for last, (kind, size) in _automaton().iter(text):
        if kind == _DIGIT:
            if last >= card_from:
                card_from, valid = parse_card(text, last)
                if valid:
                    base.append((last, CARD, card_from))
            if last >= ip_from:
                end, valid = parse_address(text, last)
                if end < 0:
                    ip_from = _run(text, last, DIGITS)
                else:
                    ip_from = end
                    if valid:
                        base.append((last, IP, end))
        elif kind == _AT:
            if last >= email_from and (span := parse_email(text, last, email_from)):
                base.append(span)
                email_from = span[2]
        elif kind == _PLUS:
            if last >= phone_from:
                end, valid = parse_phone(text, last)
                if end > 0:
                    phone_from = end
                    if valid:
                        base.append((last, PHONE, end))
        elif kind == _SCHEME:
            if last >= url_from and (span := parse_url(text, last + 1 - size, last + 1)):
                more.append(span)
                url_from = span[2]
        else:
            start = last + 1 - size
            if (start == 0 or text[start - 1] not in ALNUM) and (span := (parse_iban if kind == _IBAN else parse_account)(text, last + 1)):
                more.append(span)
    return base, more


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_added long, base_spans string, spans string"


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: counts by base kind, all base spans, all spans."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(8)]
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                base, more = find(text.as_py() or "")
                by = [0] * BASE_KINDS
                for _, kind, _ in base:
                    by[kind] += 1
                for column, value in zip(rows, (doc.as_py(), *by, len(more), render(base, KINDS), render(base + more, KINDS)), strict=True):
                    column.append(value)
            types = [pa.int64()] * 6 + [pa.string()] * 2
            names = [f.split()[0] for f in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=names)

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(scan, SCHEMA)


def op3_pii(spark, sf_dir: str) -> DataFrame:
    """The query of this operator over the whole of ``documents``."""
    found = detect(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone",
        F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans", "n_added",
    )


__all__ = ["KINDS", "detect", "digest", "find", "op3_pii"]
