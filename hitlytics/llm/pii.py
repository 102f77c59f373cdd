"""Personal data: expressions propose spans, checksums confirm them, nearby words adjust the score.

Every expression runs in time linear in the text: digit runs are taken whole, and an email's local part is read back
from its `@`, so a megabyte of letters costs one pass.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitlytics.llm import texts

#: Kinds of the contract in its order; further kinds follow.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "national")

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])([A-Za-z]{2})[0-9]{2}(?= ?[A-Za-z0-9])")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_DIGITS = re.compile("[^0-9]+")

#: How long an IBAN of a country is, by the public register.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28,
    "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18,
    "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22,
    "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20,
    "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18,
    "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31,
    "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29,
    "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}
_IBAN_ENDS = {n: re.compile(rf"(?: ?[A-Za-z0-9]){{{n - 4}}}(?![A-Za-z0-9])") for n in sorted(set(IBAN_LENGTHS.values()))}

#: Words that, close by, speak for a kind.
CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "mastercard", "credit"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "konto", "cuenta", "compte"),
    "national": ("ssn", "social", "security", "insurance"),
}
#: Score of a kind's expression alone, and what its checksum and a context word add.
EXPRESSION = {"email": 0.7, "ip": 0.6, "card": 0.3, "phone": 0.6, "iban": 0.2, "national": 0.3}
CHECKED, NEARBY = 0.4, 0.2
CONTEXT_CHARS = 40
#: Further kinds need this score; base kinds always stay.
LEAST_SCORE = 0.5


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    doubled = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(doubled) + sum(map(int, digits[-1::-2]))) % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        start = free + len(before.rstrip(_LOCAL))
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            yield start, domain.end()
            free = domain.end()
        else:
            free = at + 1
        at = text.find("@", free)


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Checked IBANs of their country's length, in capitals or not, in groups or not; what follows them is not theirs."""
    free = 0
    for m in _IBAN.finditer(text):
        length = IBAN_LENGTHS.get(m[1].upper())
        if length is not None and m.start() >= free and (rest := _IBAN_ENDS[length].match(text, m.end())):
            if mod97((m[0] + rest[0]).replace(" ", "").upper()):
                free = rest.end()
                yield m.start(), free


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def _proposals(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """(kind, start, end, whether a checksum confirmed it) of every proposed span that its rules admit."""
    for start, end in _emails(text):
        yield "email", start, end, False
    if "." in text:
        for m in _IP.finditer(text):
            if all(map(_byte, m.groups())):
                yield "ip", m.start(), m.end(), False
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _DIGITS.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield "card", m.start(), m.end(), True
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 10 <= len(_DIGITS.sub("", m[0])) <= 15:
            yield "phone", m.start(), m.end(), False
    for start, end in _ibans(text):
        yield "iban", start, end, True
    for m in _NATIONAL.finditer(text) if "-" in text else ():
        yield "national", m.start(), m.end(), False


def find(text: str | None) -> list[Span]:
    """Scored spans (code points, end exclusive) by start, then kind as listed."""
    out = []
    for kind, start, end, checked in _proposals(text or ""):
        score = EXPRESSION[kind] + CHECKED * checked
        around = (text[max(0, start - CONTEXT_CHARS):start] + " " + text[end:end + CONTEXT_CHARS]).lower()
        score = min(1.0, score + NEARBY * any(w in CONTEXT[kind] for w in re.findall(r"\w+", around)))
        if kind in BASE_KINDS or score >= LEAST_SCORE:
            out.append(Span(kind, start, end, score))
    return sorted(out, key=lambda s: (s.start, KINDS.index(s.kind)))


def redacted(text: str | None, spans: list[Span]) -> str | None:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become the first one's kind."""
    if not spans:
        return text
    out, at, kind, end = [], 0, None, 0
    for span in spans:
        if kind is not None and span.start < end:
            end = max(end, span.end)
            continue
        if kind is not None:
            out.append(f"<{kind}>")
            at = end
        out.append(text[at:span.start])
        kind, end = span.kind, span.end
    return "".join([*out, f"<{kind}>", text[end:]])


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def detect(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, spans): array of (kind, start, end, score) per row of `docs`; null and empty texts have none."""
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            spans = [[vars(s) for s in find(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _SPANS)], ["id", "spans"])

    return docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(
        batches, f"id {texts.kind(docs, id_column)}, spans array<struct<kind:string,start:long,end:long,score:double>>")


def redact(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """`docs` with personal data in the text replaced by its kind; null stays null, other columns stay as they are."""
    @F.pandas_udf("string")
    def clean(column: pd.Series) -> pd.Series:
        return column.map(lambda t: t if t is None else redacted(t, find(t)))

    return docs.withColumn(text_column, clean(text_column))


def joined(kinds: tuple[str, ...]) -> F.Column:
    """kind:start:end of the spans of these kinds, comma-joined."""
    chosen = F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(kind: str) -> F.Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
