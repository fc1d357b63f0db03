"""Toxicity by a factorization machine over hashed terms.

Terms are a text's distinct lower-case words and their first three to five letters,
hashed to 2^18 places. All labelled rows are counted by class and place; places whose
class frequencies differ significantly are the model's inputs. A factorization
machine (a weight a term and a short vector a term, whose products weigh pairs of
terms) is fitted on a bounded sample of labelled rows and scores every text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vouchlens.llm.common import texts
from vouchlens.session import written_once

WORD = re.compile(r"[^\W\d_]+")
#: Words whose terms a task remembers before it starts anew (results don't depend on it); a word takes some 400 bytes.
REMEMBERED = 100_000
#: Labels of two numbers each that are sent to every executor at most.
BROADCAST_ROWS = 1_000_000


@dataclass(frozen=True)
class Settings:
    """``max_rows`` bounds the sample that the machine is fitted on; counts cover all labelled rows."""

    places: int = 1 << 18
    max_rows: int = 50_000
    min_rows: int = 3
    min_z: float = 4.5
    factors: int = 8
    rounds: int = 10
    batch: int = 256
    rate: float = 0.2
    decay: float = 1e-4
    positive_weight: float = 3.0
    seed: int = 7


@dataclass(frozen=True)
class Model:
    """``slot`` maps a kept place to its row of ``weights`` (first column) and vectors (the rest)."""

    places: int
    slot: dict[int, int]
    bias: float
    weights: np.ndarray

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        """Probability of each row of term slots."""
        start, flat, n = packed(rows)
        linear, _, sums, squares = self._parts(flat, start, n)
        return sigmoid(self.bias + linear + 0.5 * ((sums * sums).sum(1) - squares) / np.maximum(n, 1))

    def _parts(self, flat, start, n):
        return parts(self.weights, flat, start, n)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def packed(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = np.array([len(r) for r in rows], np.int64)
    flat = np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64)
    return np.cumsum(n) - n, flat, n


def parts(weights, flat, start, n):
    """Per row: sum of weights, vectors of its terms, sum of vectors, sum of their squares."""
    own = np.vstack([weights[flat], np.zeros((1, weights.shape[1]))])
    full = (n > 0)[:, None]
    sums = np.add.reduceat(own, start, axis=0) * full
    squares = np.add.reduceat((own[:, 1:] ** 2).sum(1), start) * (n > 0)
    return sums[:, 0], own[:-1, 1:], sums[:, 1:], squares


class Terms:
    """Places of the terms of texts."""

    def __init__(self, places: int, slot: dict[int, int] | None = None):
        self.places, self.slot, self.known = places, slot, {}

    def of_word(self, word: str) -> tuple[int, ...]:
        forms = [word, *(f"{k}{word[:k]}" for k in (3, 4, 5) if len(word) > k)]
        places = {zlib.crc32(f.encode()) % self.places for f in forms}
        if self.slot is not None:
            return tuple(self.slot[p] for p in places if p in self.slot)
        return tuple(places)

    def of_text(self, text: str) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.known = {}
        known, found = self.known, set()
        for word in set(WORD.findall(text.lower())):
            own = known.get(word)
            if own is None:
                own = known[word] = self.of_word(word)
            if own:
                found.update(own)
        return np.array(sorted(found), np.int64)


def class_counts(labelled: DataFrame, settings: Settings) -> DataFrame:
    """place, label, n: rows of each label that have a term at the place (place -1: all rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(settings.places)
        counts = np.zeros((2, settings.places + 1), np.int64)
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[label, terms.of_text(text)] += 1
                counts[label, settings.places] += 1
        label, place = np.nonzero(counts)
        n = counts[label, place]
        place[place == settings.places] = -1
        for at in range(0, len(n), 50_000):
            part = slice(at, at + 50_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(place[part]), pa.array(label[part]), pa.array(n[part])], names=["place", "label", "n"]
            )

    counted = labelled.select("text", "label").mapInArrow(run, "place long, label long, n long")
    return counted.groupBy("place", "label").agg(F.sum("n").alias("n"))


def kept_places(counts: DataFrame, total: dict[int, int], settings: Settings) -> list[int]:
    """Places whose frequency differs between the classes, chosen where the counts are."""
    if not (total.get(0) and total.get(1)):
        return []
    rows = total[0] + total[1]
    n = F.sum("n")
    toxic = F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0))
    share = n / F.lit(rows)
    spread = F.sqrt(F.greatest(share * (1 - share), F.lit(1e-12)) * F.lit(1 / total[0] + 1 / total[1]))
    z = (toxic / F.lit(total[1]) - (n - toxic) / F.lit(total[0])) / spread
    by_place = counts.where("place >= 0").groupBy("place").agg(n.alias("n"), z.alias("z"))
    kept = by_place.where((F.col("n") >= settings.min_rows) & (F.abs("z") >= settings.min_z))
    return sorted(r.place for r in kept.select("place").collect())


def sample_terms(labelled: DataFrame, slot: dict[int, int], share: float, settings: Settings) -> DataFrame:
    """Label and term slots (32-bit numbers as bytes) of a share of the rows, chosen by a hash of the id."""
    chosen = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(settings.places, slot)
        for batch in batches:
            found = [terms.of_text(t).astype(np.uint32).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(found, pa.binary())],
                names=["doc_id", "label", "terms"],
            )

    return chosen.select("doc_id", "text", "label").mapInArrow(run, "doc_id long, label int, terms binary")


def fit(labelled: DataFrame, settings: Settings | None = None) -> Model:
    """A model from rows (doc_id, text, label 0 or 1).

    The driver holds the kept places and the kept terms of at most about
    ``max_rows`` rows (a share of all, by hash); without rows of both labels the model
    scores every text with the share of label 1 (0 without any rows).
    """
    settings = settings or Settings()
    counts = written_once(class_counts(labelled, settings))
    total = {r.label: r.n for r in counts.where("place < 0").collect()}
    rows = sum(total.values())
    kept = kept_places(counts, total, settings)
    slot = {p: i for i, p in enumerate(kept)}
    rng = np.random.default_rng(settings.seed)
    weights = np.hstack([np.zeros((len(kept), 1)), rng.normal(0, 0.02, (len(kept), settings.factors))])
    mean = (total.get(1, 0) + 1e-3) / (rows + 2e-3) if total.get(1) else 1e-3
    bias = float(np.log(mean / (1 - mean)))
    if not len(kept):
        return Model(settings.places, slot, bias, weights)
    share = min(1.0, settings.max_rows / rows)
    sample = sorted(sample_terms(labelled, slot, share, settings).collect())
    label = np.array([r.label for r in sample], float)
    terms = [np.frombuffer(r.terms, np.uint32) for r in sample]
    grown, grown_bias = np.full(weights.shape, 1e-4), 1e-8
    for _ in range(settings.rounds):
        order = rng.permutation(len(terms))
        for at in range(0, len(order), settings.batch):
            own = order[at : at + settings.batch]
            start, flat, n = packed([terms[i] for i in own])
            linear, vectors, sums, squares = parts(weights, flat, start, n)
            scale = 1 / np.maximum(n, 1)
            p = sigmoid(bias + linear + 0.5 * ((sums * sums).sum(1) - squares) * scale)
            error = (p - label[own]) * np.where(label[own] > 0, settings.positive_weight, 1)
            row = np.repeat(np.arange(len(own)), n)
            step = np.hstack([error[row][:, None], (error * scale)[row][:, None] * (sums[row] - vectors)])
            used, where = np.unique(flat, return_inverse=True)
            slope = np.zeros((len(used), weights.shape[1]))
            np.add.at(slope, where, step)
            slope = slope / len(own) + settings.decay * weights[used]
            grown[used] += slope**2
            rate = np.where(np.arange(weights.shape[1]) == 0, settings.rate, settings.rate / 4)
            weights[used] -= rate * slope / np.sqrt(grown[used])
            grown_bias += error.mean() ** 2
            bias -= settings.rate / 2 * error.mean() / np.sqrt(grown_bias)
    return Model(settings.places, slot, float(bias), weights)


def labelled_texts(docs: DataFrame, labels: DataFrame, label_column: str = "toxic") -> DataFrame:
    """doc_id, text, label of the rows to learn from: labelled, crc32 of the id modulo 5 not 0.

    The narrow labels come to the documents by id; rows with a null id or label are not learned from.
    """
    marks = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_column).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
        .where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    )
    if marks.count() <= BROADCAST_ROWS:
        marks = F.broadcast(marks)  # else the texts meet the labels in a shuffle
    return texts(docs).join(marks, "doc_id")


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 if score >= 0.5) of every whole text.

    Null and empty texts get the score of the bias alone; repeated rows are scored
    each; null ids stay null; an empty table gives an empty result; other columns are
    not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(model.places, model.slot)
        for batch in batches:
            if not batch.num_rows:
                continue
            got = model.scores([terms.of_text(t) for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(got), pa.array((got >= 0.5).astype(np.int32))],
                names=["doc_id", "score", "predicted"],
            )

    return texts(docs, id_column, text_column).mapInArrow(run, "doc_id long, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """The rows that are not predicted toxic, with all their columns; a null text is judged as empty."""
    place = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(model.places, model.slot)
        for batch in batches:
            if batch.num_rows:
                got = model.scores([terms.of_text(t or "") for t in batch.column(place).to_pylist()])
                yield batch.filter(pa.array(got < 0.5))

    return docs.mapInArrow(run, docs.schema)
