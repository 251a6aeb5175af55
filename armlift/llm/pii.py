"""Personal data by anchor expansion.

One Aho-Corasick pass finds anchors: at-signs, plus signs, digits, URL schemes and account
cues. A parser for each kind then expands from the anchor, to the left and right as far as
its grammar goes, and checks what it found. Parsers start only where a run starts, so the
work is linear even in runs of millions of digits, where a plain pattern search is not.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from armlift.llm.tables import documents, map_batches

# Kinds in the order of reports; the first four are the base kinds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "login")
# Anchors and the parsers they start.
CUES = {
    "@": "at",
    "+": "plus",
    **{digit: "digit" for digit in "0123456789"},
    **{cue: "iban" for cue in ("IBAN", "Iban", "iban")},
    "://": "scheme",
}
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
NUMBER = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"[ :#.-]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
LOGIN = re.compile(r"[^\s/@:]{1,256}:[^\s/@]{1,256}(?=@)")
NOT_DIGIT = re.compile(r"[^0-9]")

Span = tuple[str, int, int]


def passes_luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def is_address(text: str) -> bool:
    parts = [p.lstrip("0") for p in text.split(".")]
    return all(len(p) <= 3 and int(p or "0") <= 255 for p in parts)


def is_iban(text: str) -> bool:
    compact = text.replace(" ", "")
    turned = compact[4:] + compact[:4]
    return 15 <= len(compact) <= 34 and int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


class Finder:
    """Spans (kind, start, end) of one text, in code points with an exclusive end."""

    def __init__(self) -> None:
        self.anchors = ahocorasick.Automaton()
        for cue, parser in CUES.items():
            self.anchors.add_word(cue, (parser, len(cue)))
        self.anchors.make_automaton()

    def spans(self, text: str) -> list[Span]:
        """All spans by start, then kind. Matches of one kind do not overlap; a failed check is not retried."""
        found: list[Span] = []
        # ends of the last match of each kind: a match starts at or after it
        email = ip = number = phone = iban = login = 0
        last_digit = -2
        for at, (parser, length) in self.anchors.iter(text):
            if parser == "digit":
                run_start, last_digit = at != last_digit + 1, at
                if at >= ip and (run_start or at == ip):
                    if match := IP.match(text, at):
                        ip = match.end()
                        if is_address(match.group()):
                            found.append(("ip", at, ip))
                if at >= number and (run_start or at == number):
                    if match := NUMBER.match(text, at):
                        number = match.end()
                        digits = NOT_DIGIT.sub("", match.group())
                        if 14 <= len(digits) <= 19 and passes_luhn(digits):
                            found.append(("card", at, number))
            elif parser == "at":
                start = at
                while start > email and text[start - 1] in LOCAL:
                    start -= 1
                if start < at and (match := DOMAIN.match(text, at + 1)):
                    email = match.end()
                    found.append(("email", start, email))
            elif parser == "plus":
                if at >= phone and (match := PHONE.match(text, at)):
                    phone = match.end()
                    if 10 <= len(NOT_DIGIT.sub("", match.group())) <= 15:
                        found.append(("phone", at, phone))
            elif parser == "iban":
                if at >= iban and (match := IBAN.match(text, at + 1)) and is_iban(match.group(1)):
                    iban = match.end()
                    found.append(("iban", match.start(1), iban))
            elif at >= login and (match := LOGIN.match(text, at + 1)):
                login = match.end()
                found.append(("login", at + 1, login))
        found.sort(key=lambda s: (s[1], KINDS.index(s[0])))
        return found


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each run of overlapping spans replaced by the kind of its first span."""
    parts, done, i = [], 0, 0
    while i < len(spans):
        kind, start, end = spans[i]
        i += 1
        while i < len(spans) and spans[i][1] < end:
            end = max(end, spans[i][2])
            i += 1
        parts += [text[done:start], f"<{kind.upper()}>"]
        done = end
    return "".join([*parts, text[done:]])


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every whole text.

    Null and empty texts have no spans. Repeated rows give repeated results; other columns
    are dropped. Counts and digest cover the base kinds, ``spans`` all kinds.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for batch in batches:
            spans = [finder.spans(text or "") for text in batch.column("text").to_pylist()]
            base = [[s for s in some if s[0] in BASE_KINDS] for some in spans]
            counts = [pa.array([sum(s[0] == k for s in some) for some in base], pa.int64()) for k in BASE_KINDS]
            sums = pa.array([hashlib.sha256(joined(some).encode()).hexdigest() for some in base], pa.string())
            listed = pa.array([joined(some) for some in spans], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *counts, sums, listed],
                ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"],
            )

    counts = ", ".join(f"n_{k} bigint" for k in BASE_KINDS)
    return map_batches(docs.select("doc_id", "text"), found, f"doc_id {kind}, {counts}, base_sha256 string, spans string")


def redact(docs: DataFrame) -> DataFrame:
    """The same rows and columns with personal data replaced by <KIND>; null texts stay null."""
    names = docs.columns

    def replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for batch in batches:
            texts = [t if t is None else redacted(t, finder.spans(t)) for t in batch.column("text").to_pylist()]
            columns = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    return map_batches(docs, replaced, StructType(docs.schema.fields))


def op5_find_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in all documents."""
    return find_personal_data(documents(spark, folder))
