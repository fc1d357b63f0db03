"""Token counts with a whole-token shortcut.

Offline, every string of the vocabulary is encoded by its own: those that come out as
one token are proven whole. A pre-token found among them counts one; only the rest is
merged (by the pair index of ``bpe``).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vouchlens.llm.bpe import Chunks, Merges, merges, slices
from vouchlens.llm.common import texts


@lru_cache(maxsize=4)
def whole_tokens(path: str) -> frozenset[bytes]:
    """The words (as bytes) that are proven to encode as one token."""
    table = merges(path)
    byte_of = {c: b for b, c in enumerate(table.letters)}
    words = []
    for name in table.names:
        if name.endswith(table.end) and name not in table.special:
            word = name.removesuffix(table.end)
            if word and all(c in byte_of for c in word):
                words.append(bytes(byte_of[c] for c in word))
    return frozenset(w for w, n in zip(words, lengths(table, words), strict=True) if n == 1)


def lengths(table: Merges, words: list[bytes]) -> list[int]:
    """Number of tokens of each word."""
    return np.diff(table.encode(words)[1], prepend=0).tolist()


def counter(table: Merges, whole: frozenset[bytes]):
    def of(new: list[list[bytes]]) -> list[int]:
        rest = sorted({w for chunk in new for w in chunk if w not in whole})
        merged = dict(zip(rest, lengths(table, rest), strict=True))
        return [sum([1 if w in whole else merged[w] for w in chunk]) for chunk in new]

    return of


def count_tokens(
    docs: DataFrame, path: str, limit: int = 2048, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > ``limit``) of every whole text.

    Null and empty texts have no bytes and no tokens; special strings in a text count
    one; repeated rows are counted each; null ids stay null; an empty table gives an
    empty result; other columns are not looked at.
    """
    whole = whole_tokens(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = merges(path)
        chunks = Chunks(table, counter(table, whole))
        for part in (part for batch in batches for part in slices(batch)):
            found = part.column(1).to_pylist()
            split = chunks.batch(found)
            chunks.known.update(dict.fromkeys(table.special, 1))
            counts = [sum([chunks.known[c] for c in pieces]) for pieces in split]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(t.encode()) for t in found], pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array([n > limit for n in counts], pa.bool_()),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return texts(docs, id_column, text_column).mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )
