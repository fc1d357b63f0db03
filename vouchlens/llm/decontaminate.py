"""Benchmark decontamination by winnowing, in DataFrame functions only.

Of every ``SPAN`` consecutive words the smallest hash of ``GRAM`` consecutive words is
a fingerprint, so two texts that share ``SPAN`` words share a fingerprint. Documents
whose fingerprints meet those of a benchmark item are aligned with it at each hit, and
the hit is extended word by word; spans of ``SPAN`` equal words count. Items with
fewer words are looked up by their first words among all the words of a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouchlens.session import written_once

SPAN, GRAM = 13, 4
#: Up to so many benchmark fingerprints are compared as literals; more are joined.
LITERALS = 20_000
#: Runs of these part words (A-Z are words too: they are lower-cased only for comparison).
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
KIND_SPAN, KIND_START, KIND_WORD = 0, 1, 2


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), BETWEEN), "")


def lowered(found: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    return F.transform(found, lambda w: F.translate(w, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def _first(values: str, n: int) -> Column:
    """All but the last n - 1 places of an array column: where a run of n values starts."""
    return F.slice(F.col(values), F.lit(1), F.greatest(F.size(values) - (n - 1), F.lit(0)))


def with_fingerprints(rows: DataFrame) -> DataFrame:
    """Adds hashes (of each word), grams (of each GRAM words) and prints (of each SPAN words).

    Words equal but for the case of A-Z are equal after lower(), so they have one hash.
    """
    return (
        rows.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(F.lower(w))))
        .withColumn(
            "grams",
            F.transform(
                _first("hashes", GRAM), lambda x, i: F.xxhash64(x, *(F.get("hashes", i + k) for k in range(1, GRAM)))
            ),
        )
        .withColumn(
            "prints",
            F.array_distinct(
                F.transform(
                    _first("grams", SPAN - GRAM + 1),
                    lambda x, i: F.least(x, *(F.get("grams", i + k) for k in range(1, SPAN - GRAM + 1))),
                )
            ),
        )
    )


def item_keys(items: DataFrame) -> DataFrame:
    """kind, hash, at (place in the item), item: what a document must hold to be compared with an item.

    A whole item of at least SPAN words has all places of its fingerprints; a shorter
    one its first GRAM words, or its first word where it has fewer still.
    """
    n = F.size("words")
    own = with_fingerprints(items)
    spans = own.where(n >= SPAN).select("item", "prints", F.posexplode("grams").alias("at", "hash"))
    spans = spans.where(F.array_contains("prints", F.col("hash")))
    starts = own.where((n < SPAN) & (n >= GRAM)).select("item", F.lit(0).alias("at"), F.get("grams", F.lit(0)).alias("hash"))
    single = own.where((n < GRAM) & (n > 0)).select("item", F.lit(0).alias("at"), F.get("hashes", F.lit(0)).alias("hash"))
    parts = [
        part.select(F.lit(kind).alias("kind"), "hash", "at", "item")
        for kind, part in ((KIND_SPAN, spans), (KIND_START, starts), (KIND_WORD, single))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _column(kind: int) -> str:
    return {KIND_SPAN: "prints", KIND_START: "grams", KIND_WORD: "hashes"}[kind]


def _holds(column: str, values: list[int]) -> Column:
    return F.exists(column, lambda x: x.isin(values))


def candidates(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """doc_id, n_words, and for documents that hold a key also digest (of the text) and words."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    read = read.withColumn("words", words(F.col("text")))
    marked = with_fingerprints(read)
    distinct = keys.select("kind", "hash").distinct()
    if distinct.count() <= LITERALS:
        by_kind: dict[int, list[int]] = {}
        for kind, value in distinct.collect():
            by_kind.setdefault(kind, []).append(value)
        held = F.lit(False)
        for kind, values in sorted(by_kind.items()):
            held = held | _holds(_column(kind), values)
        rows = marked.withColumn("digest", F.when(held, F.sha2("text", 256)))
    else:
        each = marked.select(F.sha2("text", 256).alias("digest"), "prints", "grams", "hashes")
        found = None
        for kind in (KIND_SPAN, KIND_START, KIND_WORD):
            own = each.select("digest", F.explode(F.array_distinct(_column(kind))).alias("hash"))
            hit = own.join(distinct.where(F.col("kind") == kind), "hash", "left_semi").select("digest")
            found = hit if found is None else found.unionByName(hit)
        found = found.distinct().withColumnRenamed("digest", "digest_found")
        rows = read.withColumn("own", F.sha2("text", 256))
        rows = rows.join(found, F.col("own") == F.col("digest_found"), "left").withColumn("digest", F.col("digest_found"))
    return rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        "digest",
        F.when(F.col("digest").isNotNull(), F.col("words")).alias("words"),
    )


def hits(texts: DataFrame, keys: DataFrame, items: DataFrame) -> DataFrame:
    """digest, item_id, places (of the words in found windows) of each text and item that share a window."""
    own = with_fingerprints(texts)
    places = None
    for kind in (KIND_SPAN, KIND_START, KIND_WORD):
        column = "hashes" if kind == KIND_WORD else "grams"
        at = own.select("digest", F.posexplode(column).alias("place", "hash"))
        met = at.join(keys.where(F.col("kind") == kind), "hash").select(
            "digest", "item", (F.col("place") - F.col("at")).alias("shift")
        )
        places = met if places is None else places.unionByName(met)
    length = F.least(F.lit(SPAN), F.size("item_words"))
    aligned = (
        places.distinct()
        .join(texts.select("digest", lowered(F.col("words")).alias("words")), "digest")
        .join(items.select("item", "item_id", lowered(F.col("words")).alias("item_words")), "item")
        .withColumn(
            "equal",
            F.transform(
                "item_words", lambda w, j: F.coalesce(F.get("words", F.col("shift") + j) == w, F.lit(False))
            ),
        )
        .select("digest", "item_id", "shift", "equal", length.alias("length"))
        .withColumn(
            "starts",
            F.filter(
                F.sequence(F.lit(0), F.size("equal") - F.col("length")),
                lambda j: F.forall(F.slice("equal", j + 1, F.col("length")), lambda e: e),
            ),
        )
        .where(F.size("starts") > 0)
    )
    spans = F.transform("starts", lambda j: F.sequence(F.col("shift") + j, F.col("shift") + j + F.col("length") - 1))
    return aligned.select("digest", "item_id", F.array_distinct(F.flatten(spans)).alias("places"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (ids as sorted strings), contaminated of every document.

    A word is hit if it lies in an occurrence of 13 consecutive words of an item (of
    the whole item, if that has fewer). A document is contaminated if a twentieth of
    its words is hit. Null and empty texts have no words and are clean; items without
    words occur nowhere; items without an id hit words but aren't listed; repeated
    documents are judged each, repeated items once; long texts are judged whole; empty
    tables give an empty result or a clean one; other columns are not looked at.

    A text that many documents share is aligned once, by its digest.
    """
    return judged(docs, benchmark).drop("digest")


def judged(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """What ``contamination`` returns, with digest: sha2 (256) of the text, of every contaminated document at least."""
    items = benchmark.select(
        F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("words")
    ).distinct()
    items = items.withColumn("item", F.xxhash64("item_id", "words"))
    keys = item_keys(items)
    seen = written_once(candidates(docs, keys))
    held = seen.where(F.col("digest").isNotNull())
    found = hits(held.select("digest", "words").dropDuplicates(["digest"]), keys, items)
    per_text = found.groupBy("digest").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).cast("long").alias("n_hit"),
        F.array_sort(F.collect_set("item_id")).alias("items"),
    )
    nothing = F.array().cast("array<string>")
    met = (
        held.select("doc_id", "n_words", "digest")
        .join(per_text, "digest", "left")
        .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", nothing).alias("items"), "digest")
    )
    clean = seen.where(F.col("digest").isNull()).select(
        "doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), nothing.alias("items"), "digest"
    )
    return met.unionByName(clean).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        "items",
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        "digest",
    )
