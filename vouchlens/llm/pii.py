"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Four base kinds are reported wherever their pattern and validator agree. Two more
kinds (iban by mod-97, and a bare national number in the 3-2-4 form) are added when
their score, moved by context words, reaches the threshold.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from vouchlens.llm.common import texts

#: Order in which the kinds are listed.
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "national")

# Patterns that the contract fixes. A start inside a run of digits can match only
# where the start of the run did, so the look-behind changes no result; it keeps long
# runs linear.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
NOT_DIGIT = re.compile(r"[^0-9]")

#: Score of a confirmed span, and what a context word within reach adds.
START = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "national": 0.3}
CONTEXT = {
    "email": ("email", "mail", "contact"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile"),
    "iban": ("iban", "account", "bank"),
    "national": ("ssn", "social", "security", "identity"),
}
BONUS, REACH, THRESHOLD = 0.4, 40, 0.5


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(account: str) -> bool:
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches found from each ``@``: the run of local characters before it, the domain after it."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and LOCAL.match(text, start - 1):
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(end, at + 1))


def proposals(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans that pattern and validator agree on."""
    if "@" in text:
        yield from (("email", s, e) for s, e in emails(text))
    for m in IP.finditer(text):
        # a part of over 18 digits with leading zeros is still read as a number
        if all(len(p := g.lstrip("0")) <= 3 and int(p or 0) <= 255 for g in m.groups()):
            yield "ip", *m.span()
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield "card", *m.span()
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                yield "phone", *m.span()
    for m in IBAN.finditer(text):
        if mod97(m[0].replace(" ", "")):
            yield "iban", *m.span()
    for m in NATIONAL.finditer(text):
        yield "national", *m.span()


def score(text: str, kind: str, start: int, end: int) -> float:
    near = text[max(0, start - REACH) : start].lower() + " " + text[end : end + REACH].lower()
    words = set(re.findall(r"[a-z]+", near))
    return min(1.0, START[kind] + BONUS * any(w in words for w in CONTEXT[kind]))


def find(text: str) -> list[tuple[str, int, int, float]]:
    """Kind, start, end (code points, end exclusive) and score, by kind and start."""
    out = []
    for kind, start, end in proposals(text):
        s = score(text, kind, start, end)
        if kind in BASE or s >= THRESHOLD:
            out.append((kind, start, end, s))
    order = {k: i for i, k in enumerate(BASE + ADDED)}
    return sorted(out, key=lambda x: (order[x[0]], x[1]))


SPANS = "array<struct<kind:string,start:long,end:long,score:double>>"
ARROW_SPANS = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
)


def find_pii(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and spans (kind, start, end, score) of every whole text.

    Null and empty texts have no spans; overlapping spans of different kinds are all
    kept; repeated rows are searched each; null ids stay null; an empty table gives an
    empty result; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [
                [dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in find(t)]
                for t in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, ARROW_SPANS)], names=["doc_id", "spans"])

    return texts(docs, id_column, text_column).mapInArrow(run, f"doc_id long, spans {SPANS}")


def redact(text: str) -> str:
    """The text with each found stretch replaced by its kind; overlaps go under the first kind."""
    out, at = [], 0
    for kind, start, end, _ in sorted(find(text), key=lambda x: (x[1], -x[2])):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
            at = end
        elif end > at:
            at = end
    return "".join(out) + text[at:]


def redact_pii(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The same rows and columns with personal data in the texts replaced; null texts stay null."""
    names, schema = docs.columns, docs.schema
    place = names.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = [None if t is None else redact(t) for t in batch.column(place).to_pylist()]
            columns = [pa.array(clean, pa.string()) if i == place else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, schema)
