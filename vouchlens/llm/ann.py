"""Approximate nearest neighbours by learned partitions.

On a bounded sample: the graph of nearest neighbours is cut into balanced parts
(bisection along the main direction, then swaps that cut fewer edges), and a small
classifier learns to tell a vector's part. Every row is indexed under its most
probable part; a query goes to as many of its most probable parts as the sample needed
for the wanted recall, and their rows are ranked by the exact distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the rows that the index is fitted on; ``rows`` those of a part that one task ranks."""

    k: int = 10
    sample: int = 4096
    parts: int = 16
    neighbours: int = 10
    recall: float = 0.97
    hidden: int = 128
    rounds: int = 60
    rows: int = 20_000
    seed: int = 11


def usable(vector: Column) -> Column:
    """Not null, not zero, every component a finite number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(rows: np.ndarray, among: np.ndarray, k: int, skip_self: bool) -> np.ndarray:
    """Places of the k nearest of ``among`` to each row (within the sample)."""
    out = []
    size = (among**2).sum(1)
    for at in range(0, len(rows), 512):
        d = size - 2 * rows[at : at + 512] @ among.T
        if skip_self:
            d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        out.append(np.argpartition(d, k - 1, axis=1)[:, :k])
    return np.concatenate(out)


def halves(vectors: np.ndarray, own: np.ndarray, edges: np.ndarray, rng) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of the places ``own``: by the main direction, then swaps across the cut while they help."""
    x = vectors[own] - vectors[own].mean(0)
    way = rng.normal(size=x.shape[1])
    for _ in range(20):
        way = x.T @ (x @ way)
        way /= np.linalg.norm(way) or 1
    side = np.zeros(len(own), bool)
    side[np.argsort(x @ way, kind="stable")[len(own) // 2 :]] = True
    local = np.full(len(vectors), -1)
    local[own] = np.arange(len(own))
    a, b = local[edges[:, 0]], local[edges[:, 1]]
    inside = (a >= 0) & (b >= 0)
    a, b = a[inside], b[inside]
    for _ in range(30):
        across = np.where(side[a] != side[b], 1, -1)
        gain = np.bincount(a, across, len(own)) + np.bincount(b, across, len(own))
        left, right = np.flatnonzero(~side), np.flatnonzero(side)
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        n = min(len(left), len(right))
        good = int((gain[left[:n]] + gain[right[:n]] > 0).sum())
        good = min(good, max(1, n // 10))  # few at a time: gains change as neighbours move
        trial = side.copy()
        trial[left[:good]], trial[right[:good]] = True, False
        if (trial[a] != trial[b]).sum() >= (side[a] != side[b]).sum():
            break
        side = trial
    return own[~side], own[side]


def balanced_parts(vectors: np.ndarray, settings: Settings, rng) -> np.ndarray:
    """Part of each sampled vector; all parts have the same size, but for one row."""
    n = len(vectors)
    part = np.zeros(n, np.int64)
    if n <= 2 * settings.parts:
        return part
    near = nearest(vectors, vectors, min(settings.neighbours, n - 1), True)
    edges = np.stack([np.repeat(np.arange(n), near.shape[1]), near.ravel()], 1)
    groups = [np.arange(n)]
    while len(groups) < settings.parts:
        groups = [h for g in groups for h in halves(vectors, g, edges, rng)]
    for i, g in enumerate(groups):
        part[g] = i
    return part


@dataclass(frozen=True)
class Router:
    """A classifier with one hidden layer; ``probes`` parts are searched for each query."""

    mean: np.ndarray
    scale: float
    layers: tuple
    parts: int
    probes: int

    def order(self, vectors: np.ndarray) -> np.ndarray:
        """Parts of each vector, the most probable first."""
        w1, b1, w2, b2 = self.layers
        x = (vectors - self.mean) / self.scale
        return np.argsort(-(np.maximum(x @ w1 + b1, 0) @ w2 + b2), axis=1, kind="stable")


def trained(x: np.ndarray, part: np.ndarray, settings: Settings, rng) -> tuple:
    """Weights of the classifier, by Adam over the sample."""
    kinds, dim = int(part.max()) + 1, x.shape[1]
    layers = [
        rng.normal(0, np.sqrt(2 / dim), (dim, settings.hidden)),
        np.zeros(settings.hidden),
        rng.normal(0, np.sqrt(1 / settings.hidden), (settings.hidden, kinds)),
        np.zeros(kinds),
    ]
    first, second, t = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers], 0
    for _ in range(settings.rounds):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 128):
            own = order[at : at + 128]
            hidden = np.maximum(x[own] @ layers[0] + layers[1], 0)
            z = hidden @ layers[2] + layers[3]
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(own)), part[own]] -= 1
            p /= len(own)
            back = (p @ layers[2].T) * (hidden > 0)
            slopes = [x[own].T @ back + 1e-4 * layers[0], back.sum(0), hidden.T @ p + 1e-4 * layers[2], p.sum(0)]
            t += 1
            for w, g, m, v in zip(layers, slopes, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= 0.002 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return tuple(layers)


def fit(sample: np.ndarray, settings: Settings) -> Router:
    """A router from sampled vectors; its probes reach the wanted recall among them."""
    rng = np.random.default_rng(settings.seed)
    sample = sample.astype(np.float64)
    most = float(np.abs(sample).max(initial=0))
    large = most if most > 1e100 or 0 < most < 1e-100 else 1.0  # squares would leave the range of doubles
    sample = sample / large
    mean, scale = sample.mean(0), float(sample.std()) or 1.0
    part = balanced_parts(sample, settings, rng)
    kinds = int(part.max()) + 1
    if kinds == 1:
        dim = sample.shape[1]
        layers = (np.zeros((dim, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
        return Router(mean * large, scale * large, layers, 1, 1)
    fold = rng.permutation(len(sample)) % 4 == 0  # measured on rows the classifier hasn't seen
    guide = Router(mean, scale, trained((sample[~fold] - mean) / scale, part[~fold], settings, rng), kinds, kinds)
    order = guide.order(sample)
    k = min(settings.k, len(sample) - 1)
    near = nearest(sample, sample, k, True)[fold]
    rank = np.argsort(order[fold], axis=1)  # when a part is searched for a query
    when = np.take_along_axis(rank, order[:, 0][near], axis=1)
    reached = [(when < m).mean() for m in range(1, kinds + 1)]
    probes = next((m for m, r in enumerate(reached, 1) if r >= settings.recall), kinds)
    layers = trained((sample - mean) / scale, part, settings, rng)
    return Router(mean * large, scale * large, layers, kinds, probes)


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(flat), -1).astype(np.float64)


def routed(rows: DataFrame, router: Router, parts: int) -> DataFrame:
    """Rows (vec_id, embedding) with the array of their ``parts`` most probable parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                order = router.order(matrix(batch.column(1)))[:, :parts]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(order.tolist(), pa.list_(pa.int32()))],
                    names=["vec_id", "embedding", "parts"],
                )

    return rows.mapInArrow(run, "vec_id long, embedding array<double>, parts array<int>")


def distances(vectors: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Euclidean distances; where squares would leave the range of doubles, of gaps brought to one first."""
    with np.errstate(over="ignore"):
        gap = vectors - vector
        square = np.einsum("ij,ij->i", gap, gap)
    d = np.sqrt(square)
    odd = np.flatnonzero(~((square >= 1e-280) & (square < np.inf)))
    if len(odd):
        half = vectors[odd] / 2 - vector / 2  # can't overflow
        most = np.abs(half).max(1, initial=0)
        d[odd] = 2 * (most * np.sqrt(((half / np.where(most > 0, most, 1)[:, None]) ** 2).sum(1)))
    return d


def ranked(rows: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """The k nearest ids of one block for each query, by distance and then id; exact.

    Rows that repeat an id are one candidate, at the smallest distance among them.
    """
    got_q, got_v, got_d = [], [], []
    if rows.num_rows and queries.num_rows:
        of_row = rows.column("vec_id").to_numpy()
        order = np.argsort(of_row, kind="stable")
        vectors = matrix(rows.column("embedding"))[order]
        ids, first = np.unique(of_row[order], return_index=True)
        asked = queries.column("query_id").to_pylist()
        for query, vector in zip(asked, matrix(queries.column("embedding")), strict=True):
            d = distances(vectors, vector)
            if len(ids) < len(d):
                d = np.minimum.reduceat(d, first)
            others = np.flatnonzero(ids != query)
            if len(others) > k:
                others = others[d[others] <= np.partition(d[others], k - 1)[k - 1]]
            near = others
            near = near[np.lexsort((ids[near], d[near]))][:k]
            got_q += [query] * len(near)
            got_v += ids[near].tolist()
            got_d += d[near].tolist()
    return pa.table(
        {"query_id": pa.array(got_q, pa.int64()), "vec_id": pa.array(got_v, pa.int64()), "score": pa.array(got_d, pa.float64())}
    )


def search(vectors: DataFrame, is_query: Column, settings: Settings | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance, double) of the ``k`` nearest found.

    Queries are the rows where ``is_query`` (over vec_id) holds; every row but the
    query's own is indexed and can be found. Rows that are null, zero or have null or
    non-finite components, rows without an id and rows of another length than the most
    common one take no part. Rows that repeat an id count once each where they are the
    same; under one id with several vectors the nearest counts. Ties go to the smaller
    id. Fewer than k candidates are all returned; an empty table gives an empty result;
    other columns are not looked at.

    A part with more than ``rows`` rows is dealt over several tasks by a hash of the
    id, so copies of one vector don't meet in one.
    """
    settings = settings or Settings()
    schema = "query_id long, rank int, vec_id long, score double"
    rows = (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        .where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    )
    lengths = rows.groupBy(F.size("embedding").alias("n")).count().collect()
    if not lengths:
        return vectors.sparkSession.createDataFrame([], schema)
    length, n = max(((r["n"], r["count"]) for r in lengths), key=lambda r: (r[1], -r[0]))
    rows = rows.where(F.size("embedding") == length)
    share = min(1.0, settings.sample / n)
    chosen = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    chosen = chosen.dropDuplicates(["vec_id", "embedding"])  # copies of a row are no neighbours of it
    sample = np.array([r.embedding for r in sorted(chosen.collect())], np.float64)
    if not len(sample):
        sample = np.array([rows.first().embedding], np.float64)
    router = fit(sample, settings)
    placed = routed(rows, router, 1).select("vec_id", "embedding", F.element_at("parts", 1).alias("part"))
    sizes = dict(placed.groupBy("part").count().collect())  # one row a part
    blocks = F.array(*(F.lit(sizes.get(p, 0) // settings.rows + 1) for p in range(router.parts)))
    n_blocks = F.get(blocks, F.col("part"))
    dealt = placed.select("part", F.pmod(F.xxhash64("vec_id"), n_blocks).cast("int").alias("block"), "vec_id", "embedding")
    asked = (
        routed(rows.where(is_query), router, router.probes)
        .select(F.col("vec_id").alias("query_id"), "embedding", F.explode("parts").alias("part"))
        .select("query_id", "embedding", "part", F.explode(F.sequence(F.lit(0), (n_blocks - 1).cast("int"))).alias("block"))
    )
    k = settings.k
    found = (
        dealt.groupBy("part", "block")
        .cogroup(asked.groupBy("part", "block"))
        .applyInArrow(lambda a, b: ranked(a, b, k), "query_id long, vec_id long, score double")
    )
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
