"""Fill-in-the-middle transformation by repeated-capture matching.

One full match of ``(unit)*`` keeps the end of every repetition: their number is the
number of tokens of the text, and both cuts are looked up among them. A hash of the
row's id draws the cuts and the form, so a row gives the same output wherever it runs.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouchlens.llm.common import map_rows, texts

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINELS = (PREFIX, SUFFIX, MIDDLE)
#: A token is a stretch without white space and the white space before it; white space at the end is one by itself.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
UNITS = regex.compile(f"({UNIT})*")


@dataclass(frozen=True)
class Settings:
    """``rate`` percent of the texts are transformed, ``spm`` percent of those with the suffix first."""

    seed: int = 42
    rate: int = 50
    spm: int = 80


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four 32-bit numbers for a row."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def transformed(doc_id: int | None, text: str, s: Settings) -> tuple:
    """n, form, prefix_chars, middle_chars and output of one text."""
    ends = UNITS.fullmatch(text).ends(1)
    n = len(ends)
    first, second, rate, order = draws(s.seed, doc_id)
    if not text or any(x in text for x in SENTINELS) or rate % 100 >= s.rate:
        return n, "plain", None, None, text
    cuts = [ends[k - 1] if k else 0 for k in sorted((first % (n + 1), second % (n + 1)))]
    prefix, middle, suffix = text[: cuts[0]], text[cuts[0] : cuts[1]], text[cuts[1] :]
    if order % 100 < s.spm:
        form, output = "spm", SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    else:
        form, output = "psm", PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle
    return n, form, len(prefix), len(middle), output


COLUMNS = ("n", "form", "prefix_chars", "middle_chars", "output")


def transform(
    docs: DataFrame, settings: Settings | None = None, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """doc_id, n (tokens), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output of every row.

    Null and empty texts are plain and empty with n = 0; a text that holds a sentinel is
    plain; repeated rows give the same output each; a null id is drawn for as an empty
    one and stays null; long texts are whole; an empty table gives an empty result; other
    columns are not looked at.
    """
    s = settings or Settings()

    def make(batch: dict) -> dict:
        rows = [transformed(i, t, s) for i, t in zip(batch["doc_id"], batch["text"], strict=True)]
        return {"doc_id": batch["doc_id"], **{c: [r[k] for r in rows] for k, c in enumerate(COLUMNS)}}

    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    return map_rows(texts(docs, id_column, text_column), schema, make)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of, from it and its form alone.

    A sentinel can't arise where a piece and another sentinel meet, so the first one of
    each kind is the real one.
    """

    def cut(first: str, second: str) -> tuple[Column, Column, Column]:
        at, end = F.instr(output, second), F.instr(output, MIDDLE)
        start = F.lit(len(first) + 1)
        return (
            F.substring(output, start, at - start),
            F.substring(output, at + len(second), end - at - len(second)),
            F.substring(output, end + len(MIDDLE), F.length(output)),
        )

    prefix, suffix, middle = cut(PREFIX, SUFFIX)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = cut(SUFFIX, PREFIX)
    spm = F.concat(prefix, middle, suffix)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
