"""BPE encoding and decoding by a pair occurrence index.

The words of a batch lie in one array of symbols. An index maps each pair that has
a merge rank to all its positions; active ranks are applied in ascending order,
each to all its positions at once, and the pairs that arise beside a merged one are
added to the lists of their ranks. A token arises from one merge only, so a pair
that holds it ranks later: every rank is applied once.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from vouchlens.llm.common import texts

#: White space as the tokenizer's patterns understand it.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: Code points that Python's split() takes for white space and the patterns don't.
ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Bytes of chunks and their encodings that a task remembers before it starts anew (results don't depend on it),
#: and what an entry takes besides them.
REMEMBERED, ENTRY = 64 << 20, 350
#: Rows and bytes of text that are encoded at once (a longer text is encoded alone).
ROWS, BYTES = 2000, 2 << 20


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = {b: chr(b) for b in own}, 256
    for b in range(256):
        if b not in letters:
            letters[b], spare = chr(spare), spare + 1
    return [letters[b] for b in range(256)]


class Merges:
    """The tables of a word-end BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.end = end
        self.size = max(vocab.values()) + 1
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self.letters = byte_letters()
        self.inner = np.array([vocab[c] for c in self.letters], np.int64)
        self.last = np.array([vocab[c + end] for c in self.letters], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        code = self.left * self.size + self.right
        self.rank_of = np.argsort(code, kind="stable")
        self.codes = code[self.rank_of]
        pattern = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern["pattern"]["Regex"].replace(r"\s", SPACE))
        self.space = re.compile(f"[{SPACE}]+")
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge rank of each pair of symbols, -1 without one."""
        code = a * self.size + b
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.rank_of[at], -1)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words (non-empty bytes of one pre-token each), and where each word's ids end."""
        if not words:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        lengths = np.array([len(w) for w in words])
        ends = np.cumsum(lengths)
        letters = np.frombuffer(b"".join(words), np.uint8)
        n = len(letters)
        sym = self.inner[letters]
        sym[ends - 1] = self.last[letters[ends - 1]]
        after = np.arange(1, n + 1)
        after[ends - 1] = n  # n: no neighbour
        before = np.arange(-1, n - 1)
        before[ends - lengths] = n
        after, before = np.append(after, n), np.append(before, n)
        sym = np.append(sym, -1)
        lists: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(at: np.ndarray) -> None:
            rank = self.ranks(sym[at], sym[after[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            if not len(at):
                return
            if len(at) > 1:
                order = np.argsort(rank, kind="stable")
                at, rank = at[order], rank[order]
                cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
                heads, groups = rank[np.append(0, cuts)].tolist(), np.split(at, cuts)
            else:
                heads, groups = rank.tolist(), [at]
            for r, group in zip(heads, groups, strict=True):
                if r not in lists:
                    lists[r] = []
                    heapq.heappush(active, r)
                lists[r].append(group)

        add(np.flatnonzero(after[:n] < n))
        while active:
            r = heapq.heappop(active)
            found = lists.pop(r)
            at = np.unique(np.concatenate(found)) if len(found) > 1 else np.sort(found[0])
            a, b = self.left[r], self.right[r]
            at = at[(sym[at] == a) & (sym[after[at]] == b)]
            if a == b and len(at) > 1:  # of overlapping places every other one, from the left
                first = np.append(True, after[at[:-1]] != at[1:])
                start = np.flatnonzero(first)
                at = at[(np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            follow = after[gone]
            sym[at], sym[gone] = self.made[r], -1
            after[at] = follow
            before[follow] = at
            before[n] = after[n] = n
            around = np.concatenate([before[at], at])
            around = around[around < n]
            around = around[after[around] < n]
            if len(around):
                add(np.unique(around))
        alive = sym[:n] >= 0
        return sym[:n][alive], np.cumsum(np.add.reduceat(alive, ends - lengths, dtype=np.int64))


@lru_cache(maxsize=4)
def merges(path: str) -> Merges:
    return Merges(path)


class Chunks:
    """Splits texts into chunks without white space and remembers what each stands for.

    ``value`` gets the pre-tokens of each new chunk, all of a batch together.
    """

    def __init__(self, table: Merges, value, remembered: int = REMEMBERED):
        self.table, self.value, self.remembered = table, value, remembered
        self.known, self.size = {}, 0

    def pieces(self, text: str) -> list[str]:
        """Chunks and special strings of a text, in order."""
        out = []
        for i, part in enumerate(self.table.specials.split(text) if "<|" in text else [text]):
            if i % 2:
                out.append(part)
            elif ODD_SPACE.search(part):
                out += [x for x in self.table.space.split(part) if x]
            else:
                out += part.split()
        return out

    def pretokens(self, chunk: str) -> list[bytes]:
        plain = unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()
        return [w.encode() for w in self.table.words.findall(plain)]

    def batch(self, batch: Iterable[str]) -> Iterator[list[str]]:
        """The chunks of each text; afterwards ``known`` has them all."""
        split = [self.pieces(t) for t in batch]
        new = set().union(*split)
        if self.size > self.remembered:
            self.known, self.size = {}, 0
        new = [c for c in new if c not in self.known and c not in self.table.special]
        values = self.value([self.pretokens(c) for c in new])
        self.known.update(zip(new, values, strict=True))
        self.size += ENTRY * len(new) + sum(map(len, new)) + sum(len(x) for v in values if isinstance(v, tuple) for x in v)
        return split


def encode_texts(table: Merges, batch: Iterable[str], chunks: Chunks) -> tuple[list[bytes], list[bytes]]:
    split = chunks.batch(batch)
    known = chunks.known
    for s, i in table.special.items():
        known[s] = (np.uint32(i).tobytes(), s.encode())
    ids, decoded = [], []
    for pieces in split:
        both = [known[c] for c in pieces]
        ids.append(b"".join([x[0] for x in both]))
        decoded.append(b" ".join([x[1] for x in both if x[1]]))
    return ids, decoded


def values(table: Merges):
    """Ids (little-endian, 32 bits) and decoded tokens of each chunk's pre-tokens."""
    names = [n.encode() for n in table.names]

    def of(new: list[list[bytes]]) -> list[tuple[bytes, bytes]]:
        words = sorted({w for chunk in new for w in chunk})
        ids, ends = table.encode(words)
        packed, spelled = ids.astype("<u4").tobytes(), [names[i] for i in ids.tolist()]
        code, at = {}, 0
        for word, end in zip(words, ends.tolist(), strict=True):
            code[word] = (packed[4 * at : 4 * end], b" ".join(spelled[at:end]))
            at = end
        out = []
        for chunk in new:
            if len(chunk) == 1:
                out.append(code[chunk[0]])
            else:
                own = [code[w] for w in chunk]
                out.append((b"".join([x[0] for x in own]), b" ".join([x[1] for x in own])))
        return out

    return of


def encode(
    docs: DataFrame,
    path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    remembered: int = REMEMBERED,
    at_once: int = BYTES,
) -> DataFrame:
    """Token ids of every whole text and the text that they decode to.

    Returns doc_id, ids (binary: little-endian unsigned 32-bit numbers) and decoded
    (string: the tokens' names joined by blanks, as a file without a decoder asks for).
    Null and empty texts have no ids and decode to the empty text; special strings in
    a text are their special tokens; repeated rows are encoded each; null ids stay
    null; an empty table gives an empty result; other columns are not looked at. A task
    remembers about ``remembered`` bytes of what it has encoded, besides what about ``at_once`` bytes of text bring anew
    (ten to twenty times as much); both change its time and memory only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = merges(path)
        chunks = Chunks(table, values(table), remembered)
        for batch in batches:
            for part in slices(batch, size=at_once):
                ids, decoded = encode_texts(table, part.column(1).to_pylist(), chunks)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary()).cast(pa.string())],
                    names=["doc_id", "ids", "decoded"],
                )

    return texts(docs, id_column, text_column).mapInArrow(run, "doc_id long, ids binary, decoded string")


def slices(batch: pa.RecordBatch, column: int = 1, size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most ROWS rows and about ``size`` bytes of text, so that a task holds the results of a few texts at a time."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    at, held = 0, 0
    for i, n in enumerate(sizes):
        if i > at and (i - at == ROWS or held + n > size):
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if at < len(sizes):
        yield batch.slice(at)


def decode(encoded: DataFrame, path: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """The text of stored ids (binary as ``encode`` gives it); null ids decode to the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = merges(path).names
        for batch in batches:
            found = [np.frombuffer(x or b"", "<u4").tolist() for x in batch.column(1).to_pylist()]
            joined = [" ".join([names[i] for i in ids]) for ids in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(joined, pa.string())], names=["doc_id", "decoded"])

    from pyspark.sql import functions as F

    rows = encoded.select(F.col(id_column).cast("long").alias("doc_id"), F.col(ids_column).alias("ids"))
    return rows.mapInArrow(run, "doc_id long, decoded string")
