"""Language-model scores by prediction by partial matching.

A trie of byte contexts (five bytes deep) over the learning texts gives each byte a
probability: the share of the longest context that has seen the byte, or an escape to
the next shorter one, where the symbols of the longer context are excluded. The
probability depends on six bytes alone, so each block of documents asks once for each
of its six-byte strings (and its words, for the unigram base). Questions go by
context (by hash for words) to the tasks that hold that part of the trie, answers
come back to the block. Nothing that grows with the corpus is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouchlens.llm.common import LOWER, WHITE, mix64, shuffle_partitions, word_keys
from vouchlens.session import written_once

ORDER = 5
#: Bytes that UTF-8 never has: ORDER before each text, one after it.
BEFORE, AFTER = 0xFE, 0xFF
SYMBOLS = 256
#: Bytes of text that a block has about, that numpy handles at once, and that a route answers for.
BLOCK, PART, ROUTE = 16 << 20, 1 << 20, 4 << 20
#: The key of the token that ends a text.
END = np.uint64(1)

GAP = WHITE.copy()
GAP[[BEFORE, AFTER]] = True


class Part:
    """Some texts as one array of lower-case bytes: codes of six bytes and keys of words with their texts."""

    def __init__(self, found: list[str]):
        raw = [t.encode() for t in found]
        size = np.array([len(r) for r in raw], np.int64)
        pad = bytes([BEFORE] * ORDER)
        b = LOWER[np.frombuffer(b"".join([pad + r + bytes([AFTER]) for r in raw]), np.uint8)]
        n = len(b)
        first = np.cumsum(size + ORDER + 1) - (size + ORDER + 1)
        code = np.zeros(n - ORDER, np.int64)
        for k in range(ORDER + 1):
            code = code << 8 | b[k : n - ORDER + k]
        self.codes = code[b[ORDER:] != BEFORE]  # one for each byte and end
        self.per_text = size + 1
        self.words, start = word_keys(b, GAP[b])
        self.text_of_word = np.searchsorted(first, start, side="right") - 1


def text_parts(found: list[str]) -> Iterator[tuple[int, int, Part]]:
    """Stretches of about PART bytes, each with its first and last + 1 text."""
    at, size = 0, 0
    for i, t in enumerate(found):
        size += len(t)
        if size >= PART or i + 1 == len(found):
            yield at, i + 1, Part(found[at : i + 1])
            at, size = i + 1, 0


def tally(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sum of the weights of each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    if not len(keys):
        return keys, np.empty(0, np.int64)
    cut = np.append(0, np.flatnonzero(keys[1:] != keys[:-1]) + 1)
    return keys[cut], np.add.reduceat(weights[order].astype(np.int64), cut)


def tally_marked(keys: np.ndarray, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``tally`` of marks; for codes, whose upper bits are free: one plain sort."""
    both = np.sort(keys << 1 | marked)
    mark, keys = both & 1, both >> 1
    if not len(keys):
        return keys, np.empty(0, np.int64)
    cut = np.append(0, np.flatnonzero(keys[1:] != keys[:-1]) + 1)
    return keys[cut], np.add.reduceat(mark, cut)


def merged(tallies: list[tuple[np.ndarray, np.ndarray]], kind) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([np.empty(0, kind), *(t[0] for t in tallies)])
    return tally(keys, np.concatenate([np.empty(0, np.int64), *(t[1] for t in tallies)]))


def add(tallies: list[tuple[np.ndarray, np.ndarray]], new: tuple[np.ndarray, np.ndarray], kind) -> None:
    """Adds a tally; those of like size are merged, so that little more than the distinct keys is held."""
    tallies.append(new)
    while len(tallies) > 1 and len(tallies[-2][0]) <= 2 * len(tallies[-1][0]):
        tallies.append(merged([tallies.pop(), tallies.pop()], kind))


def code_route(codes: np.ndarray, routes: int) -> np.ndarray:
    """By the last two bytes of the context, so that all orders from two on lie in one task."""
    return (mix64((codes >> 8 & 0xFFFF).astype(np.uint64)) % np.uint64(routes)).astype(np.int64)


def packed(x: np.ndarray) -> bytes:
    """An array as compressed bytes after their plain size; equal places of the numbers lie together, most are zero."""
    raw = np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(b: bytes, kind) -> np.ndarray:
    size, width = int.from_bytes(b[:8], "little"), np.dtype(kind).itemsize
    raw = np.frombuffer(pa.decompress(b[8:], size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, -1).T).ravel().view(kind)


def packed_few(x: np.ndarray) -> bytes:
    """Doubles of which many are equal: their distinct values and a place among these for each."""
    values, place = np.unique(x, return_inverse=True)
    first = packed(values)
    return len(first).to_bytes(8, "little") + first + packed(place.astype(np.uint32))


def unpacked_few(b: bytes) -> np.ndarray:
    size = 8 + int.from_bytes(b[:8], "little")
    return unpacked(b[8:size], np.float64)[unpacked(b[size:], np.uint32)]


def steps(x: np.ndarray) -> np.ndarray:
    """Differences of ascending numbers, which compress well; a running sum restores them."""
    return np.diff(x, prepend=x.dtype.type(0))


def split_by(route: np.ndarray, routes: int) -> list[np.ndarray]:
    order = np.argsort(route, kind="stable")
    return np.split(order, np.searchsorted(route[order], np.arange(1, routes)))


QUESTIONS = "block int, route int, codes binary, code_n binary, words binary, word_n binary"


def questions(blocks: DataFrame, routes: int) -> DataFrame:
    """Distinct codes and words of each block with their counts in its learning texts, by route.

    Route -1 has the block's counts of two-byte strings (at most 65,536).
    """

    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        found, learned = table.column("text").to_pylist(), np.array(table.column("learned").to_pylist(), np.int64)
        codes, words = [], []
        for at, end, part in text_parts(found):
            mark = learned[at:end]
            add(codes, tally_marked(part.codes, np.repeat(mark, part.per_text)), np.int64)
            add(words, tally(part.words, mark[part.text_of_word]), np.uint64)
        code, code_n = merged(codes, np.int64)
        words.append((np.array([END]), np.array([learned.sum()])))
        word, word_n = merged(words, np.uint64)
        pair, pair_n = tally(code & 0xFFFF, code_n)
        rows = [(block, -1, packed(steps(pair)), packed(pair_n), b"", b"")]
        ways = zip(
            split_by(code_route(code, routes), routes),
            split_by((word % np.uint64(routes)).astype(np.int64), routes),
            strict=True,
        )
        for route, (c, w) in enumerate(ways):
            rows.append(
                (block, route, packed(steps(code[c])), packed(code_n[c]), packed(steps(word[w])), packed(word_n[w]))
            )
        return pa.Table.from_pylist(
            [dict(zip(("block", "route", "codes", "code_n", "words", "word_n"), r, strict=True)) for r in rows],
            schema=pa.schema(
                [("block", pa.int32()), ("route", pa.int32())]
                + [(c, pa.binary()) for c in ("codes", "code_n", "words", "word_n")]
            ),
        )

    return blocks.groupBy("block").applyInArrow(run, QUESTIONS)


def numbers(column: pa.ChunkedArray, kind) -> list[np.ndarray]:
    return [unpacked(x, kind) for x in column.to_pylist()]


def keys_of(column: pa.ChunkedArray, kind) -> list[np.ndarray]:
    return [np.cumsum(x, dtype=kind) for x in numbers(column, kind)]


def value_of(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, otherwise=0) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), otherwise)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], otherwise)


class Level:
    """One order of the trie: counts by (context, symbol) and, by context, what the escape needs."""

    def __init__(self, grams: np.ndarray, n: np.ndarray, below):
        seen = n > 0
        self.grams, self.n = grams[seen], n[seen]
        context = self.grams >> 8
        cut = np.append(0, np.flatnonzero(context[1:] != context[:-1]) + 1) if len(context) else np.empty(0, np.int64)
        self.contexts = context[cut]
        total = lambda x: np.add.reduceat(x, cut) if len(cut) else np.empty(0, np.int64)
        self.sums, self.kinds = total(self.n), total(np.ones(len(self.n), np.int64))
        #: count in the next shorter context of the symbols that this context has seen
        self.excluded = total(below(self.grams))


class Trie:
    """The orders from five down to none; ``pairs`` are the global counts of two-byte strings."""

    def __init__(self, pairs: tuple[np.ndarray, np.ndarray], codes: np.ndarray, n: np.ndarray):
        single, single_n = tally(pairs[0] & 0xFF, pairs[1])
        levels = {0: Level(single, single_n, lambda g: np.zeros(len(g), np.int64))}
        shorter = (single, single_n)
        tables = {1: pairs} | {k: tally(codes & ((1 << 8 * (k + 1)) - 1), n) for k in range(2, ORDER + 1)}
        for k in range(1, ORDER + 1):
            mask, below = (1 << 8 * k) - 1, shorter
            levels[k] = Level(*tables[k], lambda g, m=mask, t=below: value_of(*t, g & m))
            shorter = tables[k]
        self.levels = levels

    def log10(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(codes))
        todo = np.arange(len(codes))
        out_of = np.zeros(len(codes), np.int64)  # counts and kinds excluded by the longer context
        kinds_out = np.zeros(len(codes), np.int64)
        for k in range(ORDER, -1, -1):
            level, own = self.levels[k], codes[todo] & ((1 << 8 * (k + 1)) - 1)
            context = own >> 8
            n = value_of(level.grams, level.n, own)
            kinds = value_of(level.contexts, level.kinds, context)
            rest = value_of(level.contexts, level.sums, context) - out_of[todo]
            fresh = kinds - kinds_out[todo]
            whole = np.maximum(rest + fresh, 1)
            hit = n > 0
            out[todo[hit]] += np.log10(n[hit] / whole[hit])
            miss = ~hit
            escape = miss & (fresh > 0)
            out[todo[escape]] += np.log10(fresh[escape] / whole[escape])
            out_of[todo] = value_of(level.contexts, level.excluded, context)
            kinds_out[todo] = kinds
            todo = todo[miss]
        out[todo] -= np.log10(SYMBOLS - kinds_out[todo])
        return out


ANSWERS = "block int, codes binary, chances binary, words binary, counts binary"


def answers(asked: DataFrame, pairs: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Each question with log10 probabilities of its codes and learning counts of its words."""

    def run(table: pa.Table) -> pa.Table:
        codes, code_n = keys_of(table.column("codes"), np.int64), numbers(table.column("code_n"), np.int64)
        words, word_n = keys_of(table.column("words"), np.uint64), numbers(table.column("word_n"), np.int64)
        code, total = tally(np.concatenate(codes), np.concatenate(code_n))
        chance = Trie(pairs, code, total).log10(code)
        word, count = tally(np.concatenate(words), np.concatenate(word_n))
        chances = [packed_few(value_of(code, chance, c).astype(np.float64)) for c in codes]
        counts = [packed(value_of(word, count, w).astype(np.int64)) for w in words]
        kept = table.select(["block", "codes", "words"])
        with_both = kept.append_column("chances", pa.array(chances, pa.binary())).append_column("counts", pa.array(counts, pa.binary()))
        return with_both.select(["block", "codes", "chances", "words", "counts"])

    return asked.where("route >= 0").groupBy("route").applyInArrow(run, ANSWERS)


def learned_words(asked: DataFrame) -> tuple[int, int]:
    """Learning tokens and distinct learning tokens."""

    def run(table: pa.Table) -> pa.Table:
        words, word_n = keys_of(table.column("words"), np.uint64), numbers(table.column("word_n"), np.int64)
        _, count = tally(np.concatenate(words), np.concatenate(word_n))
        return pa.table({"tokens": [int(count.sum())], "kinds": [int((count > 0).sum())]})

    by_route = asked.where("route >= 0").select("route", "words", "word_n").groupBy("route")
    total = by_route.applyInArrow(run, "tokens long, kinds long").agg(F.sum("tokens"), F.sum("kinds")).first()
    return total[0] or 0, total[1] or 0


SCORES = "doc_id long, learned boolean, n_tokens long, n_known long, logs double, score double"


def scores(blocks: DataFrame, answered: DataFrame) -> DataFrame:
    """Texts of each block with the sums of what was answered; ``logs``: of log10(count + 0.1)."""

    def run(table: pa.Table, known: pa.Table) -> pa.Table:
        def joined(keys, values, kind, value):
            if not known.num_rows:
                return np.empty(0, kind), np.empty(0)
            k = np.concatenate(keys_of(known.column(keys), kind))
            order = np.argsort(k)
            return k[order], np.concatenate([value(x) for x in known.column(values).to_pylist()])[order]

        codes, chances = joined("codes", "chances", np.int64, unpacked_few)
        words, counts = joined("words", "counts", np.uint64, lambda x: unpacked(x, np.int64))
        end = int(value_of(words, counts, np.array([END]))[0])
        found = table.column("text").to_pylist()
        out = []
        for at, to, part in text_parts(found):
            first = np.cumsum(part.per_text) - part.per_text
            chance = np.add.reduceat(value_of(codes, chances, part.codes), first)
            count = value_of(words, counts, part.words)
            n = np.bincount(part.text_of_word, minlength=to - at)
            have = np.bincount(part.text_of_word, weights=count > 0, minlength=to - at)
            logs = np.bincount(part.text_of_word, weights=np.log10(count + 0.1), minlength=to - at)
            out.append((n + 1, have + (end > 0), logs + np.log10(end + 0.1), chance))
        n, have, logs, chance = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table(
            {
                "doc_id": table.column("doc_id"),
                "learned": table.column("learned"),
                "n_tokens": pa.array(n.astype(np.int64)),
                "n_known": pa.array(have.astype(np.int64)),
                "logs": pa.array(logs),
                "score": pa.array(chance),
            }
        )

    # a block without answers can't be: each asks for the end token
    return blocks.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(run, SCORES)


def score_texts(docs: DataFrame, learned: Column, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Scores every whole text under a model of the rows where ``learned`` holds.

    Returns doc_id, learned, n_tokens, n_known, train_tokens, base_score (words and one
    end under add-0.1 unigrams) and score (log10 probability of the lower-case bytes
    and an end symbol). Null and empty texts have the end alone; repeated rows are
    learned from and scored each; null ids stay null; long texts are whole; without
    learning rows all bytes are equally likely; an empty table gives an empty result;
    other columns are not looked at.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"),
        F.coalesce(learned, F.lit(False)).alias("learned"),
    )
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = int(size // BLOCK) + 1
    blocks = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int"))
    asked = written_once(questions(blocks, max(shuffle_partitions(spark), int(size // ROUTE))))
    # at most 65,536 sums, whatever the corpus
    pairs = asked.where("route = -1").select("codes", "code_n").mapInArrow(_pair_rows, "pair long, n long")
    found = pairs.groupBy("pair").agg(F.sum("n").alias("n")).where("n > 0").collect()
    pair = tuple(np.array(x, np.int64) for x in zip(*sorted(map(tuple, found)), strict=True)) if found else ()
    answered = answers(asked, pair or (np.empty(0, np.int64), np.empty(0, np.int64)))
    tokens, kinds = learned_words(asked)
    whole = tokens + 0.1 * (kinds + 1)
    return scores(blocks, answered).select(
        "doc_id",
        "learned",
        "n_tokens",
        "n_known",
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.log10(F.lit(whole))).alias("base_score"),
        "score",
    )


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        keys = [np.cumsum(unpacked(k, np.int64)) for k, _ in rows]
        n = [unpacked(x, np.int64) for _, x in rows]
        if rows:
            pair, count = tally(np.concatenate(keys), np.concatenate(n))
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(count)], names=["pair", "n"])
