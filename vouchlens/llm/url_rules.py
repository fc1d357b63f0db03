"""URL filter by association rules.

FP-growth mines combinations of URL tokens together with a label; rules that conclude
a label are pruned by support, confidence and by simpler rules that say the same. A
URL is matched by an inverted index from each rule's rarest token to the rule. Tokens
that stand in the same rows are mined as one, which leaves every verdict as it is: sets
of two such tokens say no more than either of them.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouchlens.llm.common import ASCII_LOWER, shuffle_partitions

#: The rules of the list, a host and the start of a path each.
LISTED = (
    ("net/", "block"),
    ("example.net/en/", "allow"),
    ("example.com/de/", "block"),
    ("org/fr/", "allow"),
)


#: Words of a path part.
PATH_WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Settings:
    """A frequent set holds in ``min_support`` of the labelled rows, and in ``min_rows`` of them at least.

    Tokens in exactly the same labelled rows are one class, so what only one URL or one
    site has counts once, however many tokens it is. Rules have any number of classes
    unless ``max_tokens`` is set.
    """

    min_support: float = 0.002
    min_rows: int = 2
    min_confidence: float = 0.8
    max_tokens: int | None = None
    default: str = "allow"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def listed_rule(host: Column, path: Column, rules=LISTED) -> tuple[Column, Column]:
    """The longest listed rule that fits, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):  # a longer one overrides
        own, start = text[: text.index("/")], text[text.index("/") :]
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        rule = F.when(fits, text).otherwise(rule)
        verdict = F.when(fits, says).otherwise(verdict)
    return rule, verdict


def tokens(url: str | None) -> list[str]:
    """Distinct tokens: host, its parent domains, labels and their words, path parts and their words, query names, scheme.

    A path part and a word of one are the same token, so ``/casino/`` and ``/casino-royale/`` share one.
    """
    scheme, mark, rest = (url or "").partition("://")
    if not mark:
        return []
    m = re.match(r"([^/?#]*)([^?#]*)(?:\?([^#]*))?(#?)", rest, re.S)
    host = m[1].translate(ASCII_LOWER)
    labels = host.split(".")
    out = {f"scheme:{scheme.translate(ASCII_LOWER)}"}
    out.update("host:" + ".".join(labels[i:]) for i in range(len(labels)))
    out.update(f"word:{w}" for label in labels[:-1] for w in label.split("-") if w)
    parts = [p for p in m[2].split("/") if p]
    out.update(f"path:{w}" for p in parts for w in (p, *PATH_WORD.findall(p)))
    if parts and len(parts[0]) == 2:
        out.add(f"first:{parts[0]}")
    out.update(f"ending:{p.rpartition('.')[2]}" for p in parts[-1:] if "." in p)
    out.update(f"query:{q.partition('=')[0]}" for q in (m[3] or "").split("&") if q)
    return sorted(out | ({"fragment"} if m[4] else set()))


def token_classes(split: DataFrame, least: int) -> dict[str, str]:
    """The class (its smallest token) of every token that is in ``least`` rows or more.

    Two tokens are in the same rows if their counts and two sums of row hashes agree. There
    are at most so many tokens as the rows have in all, over ``least``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [tokens(u) for u in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], names=["url", "tokens"])

    each = split.select("url").mapInArrow(run, "url string, tokens array<string>")
    places = each.select(F.explode("tokens").alias("token"), F.xxhash64("url").alias("a"), F.xxhash64(F.lit(1), "url").alias("b"))
    sums = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("a", "b")]
    frequent = places.groupBy("token").agg(F.count("*").alias("n"), *sums).where(F.col("n") >= least).collect()
    first: dict[tuple, str] = {}
    for r in sorted(frequent):
        first.setdefault((r.n, r.a, r.b), r.token)
    return {r.token: first[r.n, r.a, r.b] for r in frequent}


def mined_rules(
    labelled: DataFrame, settings: Settings
) -> tuple[list[tuple[frozenset[str], str, float, float]], dict[str, str]]:
    """(classes, label, confidence, support), best first, from rows (url, label); and the class of each token.

    Rules come to the driver in order of their length, and one is dropped there if a kept rule with some
    of its classes says the same at least as surely.
    """
    split = labelled.where(F.col("label").isNotNull()).select(F.coalesce("url", F.lit("")).alias("url"), "label")
    rows = split.count()
    least = max(settings.min_rows, ceil(settings.min_support * rows))
    if rows < least:
        return [], {}
    classes = token_classes(split, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [
                [*sorted(classes_of(u, classes)), f"label:{y}"]
                for u, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.list_(pa.string()))], names=["items"])

    sets = split.mapInArrow(run, "items array<string>")
    growth = FPGrowth(
        itemsCol="items",
        minSupport=(least - 0.5) / rows,
        minConfidence=settings.min_confidence,
        numPartitions=shuffle_partitions(labelled.sparkSession),
    )
    length = F.size("antecedent")
    said = (
        growth.fit(sets)
        .associationRules.where(F.element_at("consequent", 1).startswith("label:"))
        .where(F.lit(True) if settings.max_tokens is None else length <= settings.max_tokens)
        .select(F.array_sort("antecedent").alias("antecedent"), F.element_at("consequent", 1).substr(7, 1000).alias("label"), "confidence", "support")
        .orderBy(length, F.desc("confidence"), F.desc("support"), "antecedent", "label")
    )
    kept: list[tuple[frozenset[str], str, float, float]] = []
    simpler: dict[str, list[int]] = defaultdict(list)  # kept rules by their first token
    for r in said.toLocalIterator():
        own = frozenset(r.antecedent)
        fits = (kept[i] for t in own for i in simpler.get(t, ()))
        if not any(k[1] == r.label and k[2] >= r.confidence and k[0] < own for k in fits):
            simpler[min(own, default="")].append(len(kept))
            kept.append((own, r.label, r.confidence, r.support))
    return sorted(kept, key=lambda k: (-k[2], -k[3], sorted(k[0]), k[1])), classes


def classes_of(url: str | None, classes: dict[str, str]) -> set[str]:
    return {classes[t] for t in tokens(url) if t in classes}


class Index:
    """Rules by their rarest class of tokens (the one in the fewest rules)."""

    def __init__(self, rules, classes: dict[str, str], default: str):
        self.rules, self.classes, self.default = rules, classes, default
        often = Counter(t for r in rules for t in r[0])
        self.lists: dict[str, list[int]] = defaultdict(list)
        for i, r in enumerate(rules):
            self.lists[min(r[0], key=lambda t: (often[t], t))].append(i)

    def verdict(self, url: str | None) -> str:
        have = classes_of(url, self.classes)
        fits = [i for t in have for i in self.lists.get(t, ()) if self.rules[i][0] <= have]
        return self.rules[min(fits)][1] if fits else self.default


def judge(pages: DataFrame, labelled: DataFrame, settings: Settings | None = None, rules=LISTED) -> DataFrame:
    """page_id, url, host, path, rule, verdict, mined (the method's own verdict) of every row.

    The listed rule decides where one fits, the mined rules elsewhere (the best
    matching one; ``default`` where none matches). Null or odd urls have an empty host
    and path and get the default; repeated rows are judged each; without labelled rows
    nothing is mined; an empty table gives an empty result; other columns are dropped.
    """
    settings = settings or Settings()
    index = Index(*mined_rules(labelled, settings), settings.default)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [index.verdict(u) for u in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.string())], names=[*names, "mined"])

    host, path = host_and_path(F.col("url"))
    rule, verdict = listed_rule(F.col("host"), F.col("path"), rules)
    names = ["page_id", "url", "host", "path", "rule", "listed"]
    seen = (
        pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
        .select("page_id", "url", host.alias("host"), path.alias("path"))
        .select("page_id", "url", "host", "path", rule.alias("rule"), verdict.alias("listed"))
    )
    out = seen.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in zip([*names, "mined"], ["long"] + ["string"] * 6, strict=True)))
    return out.select("page_id", "url", "host", "path", "rule", F.coalesce("listed", "mined").alias("verdict"), "mined")


def listed_labels(pages: DataFrame, rules=LISTED) -> DataFrame:
    """url and label of the pages that a listed rule decides: what the rules are mined from."""
    host, path = host_and_path(F.col("url"))
    _, verdict = listed_rule(F.col("host"), F.col("path"), rules)
    return (
        pages.select(F.col("url").cast("string").alias("url"))
        .select("url", host.alias("host"), path.alias("path"))
        .select("url", verdict.alias("label"))
        .where(F.col("label").isNotNull())
    )
