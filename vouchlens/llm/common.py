"""What several operators share: Arrow maps over texts, number columns, table sizes."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z and nothing else, as the query contracts lower-case.
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Id and text alone, so that no other column can clash; a null text is empty."""
    return docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"),
    )


def map_rows(df: DataFrame, schema: str, make: Callable[[dict], dict]) -> DataFrame:
    """``make`` turns the columns of a batch (lists) into columns of the result."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = make({n: batch.column(i).to_pylist() for i, n in enumerate(names)})
                yield pa.RecordBatch.from_pydict(out)

    return df.mapInArrow(run, schema)


def word_keys(data: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit key and start of each word: a stretch of bytes between those where ``gap`` holds.

    ``data`` begins and ends with a gap. A word's key is its polynomial hash, read from
    running sums, so only words of more than LONG bytes are looked at by themselves: among
    such, polynomials modulo 2^64 can be equal for any base, so they take a real hash.
    """
    start = np.flatnonzero(~gap[1:] & gap[:-1]) + 1
    end = np.flatnonzero(gap[1:] & ~gap[:-1]) + 1
    summed = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(LETTER[data] * powers(STEP, len(data)), out=summed[1:])
    keys = mix64((summed[end] - summed[start]) * powers(BACK, len(data))[start])
    for i in np.flatnonzero(end - start > LONG).tolist():
        keys[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return keys, start


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def remainder(column: str, base: int):
    """crc32 of the id as text, modulo ``base``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % base


def mix64(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers (a finalizer of xor, shift and multiply)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: For the hash of words: a number for each byte, an odd base and its inverse modulo 2^64.
LETTER = mix64(np.arange(1, 257, dtype=np.uint64))
#: Bytes of a word up to which the polynomial tells words apart.
LONG = 64
STEP = 0x9E3779B97F4A7C15
BACK = pow(STEP, -1, 1 << 64)
#: A-Z lower-cased in bytes, and the bytes that part words.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
