"""URL rules, nearest neighbours, the pipeline, and the registered queries."""

import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.compare import compare
from vouchlens.llm import ann, queries, url_rules

FOLDER = "/root/testdata/sf0.001"


def plain_verdict(url):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate({c: c + 32 for c in range(65, 91)})
    fits = [
        (len(r), r, v)
        for r, v in url_rules.LISTED
        if (host == r[: r.index("/")] or host.endswith("." + r[: r.index("/")])) and path.startswith(r[r.index("/") :])
    ]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_url_rules(spark):
    urls = ["http://A.Example.NET/en/1?x#y", "http://net/", "http://net", "https://x.org/fr/2", "ftp://xnet/", "http://spam.win.com/a", "http://spam.win.net/a", "//x.net/", None, "", "http://", "http://a.net?x=/en/", "http://b.example.com/de/\n/z", "http://É.net/"]
    urls += [f"http://spam{i % 3}.bad.net/p{i}" for i in range(60)] + [f"http://good.example.net/en/{i}" for i in range(60)]
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls)] + [(1, urls[1], "h", "v")], "page_id long, url string, host string, verdict string")
    got = url_rules.judge(pages, url_rules.listed_labels(pages))
    rows = got.collect()
    assert len(rows) == len(urls) + 1
    for r in rows:
        host, path, rule, verdict = plain_verdict(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.mined)
    assert {r.verdict for r in rows if r.url == "http://spam.win.net/a"} == {"block"}
    assert url_rules.judge(pages.limit(0), url_rules.listed_labels(pages.limit(0))).isEmpty()


def test_url_rules_from_path_words_and_long_ones(spark):
    def verdicts(made, asked):
        labelled = spark.createDataFrame(made, "url string, label string")
        pages = spark.createDataFrame(list(enumerate(asked)), "page_id long, url string")
        got = url_rules.judge(pages, labelled, url_rules.Settings(default="none"), rules=())
        return [r.verdict for r in got.orderBy("page_id").collect()]

    made = [(f"http://h{i % 7}.net/{i}/{p}/{i}.html", y) for i in range(60) for p, y in (("casino", "block"), ("my-news", "allow"))]
    made += [(f"http://h{i % 7}.net/category/{p}/{i}", y) for i in range(60) for p, y in (("shop", "block"), ("help", "allow"))]
    asked = ["http://new.org/casino/", "http://new.org/x/casino-royale/1", "http://new.org/news", "http://new.org/category/shop/9", "http://new.org/category/help"]
    assert verdicts(made, asked) == ["block", "block", "allow", "block", "allow"]
    words = ["a1", "b2", "c3", "d4"]  # only all four together tell "block"
    some = [[w for j, w in enumerate(words) if i >> j & 1] for i in range(16)]
    made = [("http://h.net/" + "/".join(s), "block" if len(s) == 4 else "allow") for s in some for _ in range(10)]
    assert verdicts(made, ["http://h.net/a1/b2/c3/d4", "http://h.net/a1/b2/c3"]) == ["block", "allow"]


def test_rules_match_by_index():
    rules = [(frozenset("ab"), "block", 0.9, 0.1), (frozenset("a"), "allow", 0.8, 0.2), (frozenset("c"), "block", 0.8, 0.1)]
    index = url_rules.Index(rules, {}, "none")
    for have in ("", "a", "ab", "abc", "c", "bc"):
        fits = [i for i, r in enumerate(rules) if r[0] <= set(have)]
        lists = {i for t in set(have) for i in index.lists.get(t, ()) if rules[i][0] <= set(have)}
        assert lists == set(fits)


def plain_rules(labelled, settings):
    """All frequent sets of tokens, one by one, and the rules that no simpler one makes needless."""
    sets = [(frozenset(url_rules.tokens(u)), y) for u, y in labelled]
    least = max(settings.min_rows, math.ceil(settings.min_support * len(sets)))
    often = sorted({t for s, _ in sets for t in s if sum(t in o for o, _ in sets) >= least})
    kept = []
    for k in range(1, len(often) + 1):
        for own in map(frozenset, itertools.combinations(often, k)):
            inside = [y for s, y in sets if own <= s]
            for label in sorted(set(inside)):
                n = inside.count(label)
                sure = n / len(inside)
                simpler = any(o < own and y == label and c >= sure for o, y, c, _ in kept)
                if n >= least and sure >= settings.min_confidence and not simpler:
                    kept.append((own, label, sure, n / len(sets)))
    return kept


def test_rules_equal_plain_mining(spark):
    pick = random.Random(4)
    parts = ["a", "b", "c"]
    labelled = []
    for _ in range(60):
        own = [p for p in parts if pick.random() < 0.5]
        labelled.append(("x://h/" + "/".join(own), "block" if {"a", "b"} <= set(own) or pick.random() < 0.1 else "allow"))
    settings = url_rules.Settings(min_support=0.05, default="none")
    plain = plain_rules(labelled, settings)
    asked = ["x://h/" + "/".join(o) for k in range(4) for o in itertools.combinations(parts, k)] + ["y://h/a/b", "z://q/c", None]
    pages = spark.createDataFrame(list(enumerate(asked)), "page_id long, url string")
    got = url_rules.judge(pages, spark.createDataFrame(labelled, "url string, label string"), settings, rules=())
    for r in got.collect():
        have = set(url_rules.tokens(r.url))
        fits = [(-c, -n) for own, _, c, n in plain if own <= have]
        best = {y for own, y, c, n in plain if own <= have and (-c, -n) == min(fits)} or {"none"}
        assert r.verdict in best


def test_long_urls_end(spark):
    """Two hundred tokens that stand in the same rows are one; alone they are below the least number of rows."""
    long = "http://long.org/" + "/".join(f"word{i}" for i in range(200))
    lone = "http://lone.org/" + "/".join(f"part{i}" for i in range(200))
    labelled = [(long, "block")] * 20 + [(lone, "block")] + [(f"http://ok.org/{i % 3}", "allow") for i in range(40)]
    pages = spark.createDataFrame([(1, long), (2, "http://new.org/word7"), (3, "http://new.org/part7")], "page_id long, url string")
    settings = url_rules.Settings(default="none")
    got = url_rules.judge(pages, spark.createDataFrame(labelled, "url string, label string"), settings, rules=())
    assert [r.verdict for r in got.orderBy("page_id").collect()] == ["block", "block", "none"]


def test_nearest(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    vectors = (centres[rng.integers(0, 12, 3000)] + 0.3 * rng.normal(size=(3000, 16))).astype(np.float32)
    vectors[500:900] = vectors[500]  # many ties
    rows = [(i, v.tolist(), 0, "p") for i, v in enumerate(vectors)]
    rows += [(9000, None, 0, "p"), (9100, [0.0] * 16, 0, "p"), (9200, [float("nan")] * 16, 0, "p"), (9300, [1.0] * 3, 0, "p"), (None, vectors[0].tolist(), 0, "p"), rows[7], (9400, [None] * 16, 0, "p")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, part int, query_id string")
    settings = ann.Settings(rows=150, sample=1500)
    got = ann.search(df, F.col("vec_id") % 100 == 0, settings).toPandas()
    hits = total = 0
    exact = vectors.astype(float)
    for query, found in got.groupby("query_id"):
        d = np.sqrt(((exact - exact[query]) ** 2).sum(1))
        want = [i for i in np.lexsort((np.arange(3000), d)) if i != query][:10]
        found = found.sort_values("rank")
        assert found["rank"].tolist() == list(range(1, 11)) and found.vec_id.is_unique
        assert np.allclose(found.score, d[found.vec_id], rtol=0, atol=1e-12)
        hits, total = hits + len(set(want) & set(found.vec_id)), total + 10
    assert got.query_id.nunique() == 30 and hits >= 0.9 * total
    few = ann.search(df.where("vec_id < 4"), F.col("vec_id") == 0).collect()
    assert [r["rank"] for r in few] == [1, 2, 3]
    assert ann.search(df.limit(0), F.col("vec_id") == 0).isEmpty()


def test_nearest_of_repeated_rows(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(40, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    moved = [(i, (v + 0.01 * rng.normal(size=8)).tolist()) for i, v in rows]  # several vectors of one id
    for table in (rows[:20] * 2, rows * 12 + moved):
        df = spark.createDataFrame(table, "vec_id long, embedding array<double>").repartition(3)
        got = ann.search(df, F.col("vec_id") < 4, ann.Settings(parts=1)).toPandas()
        for query in range(4):
            best = {}
            for a in (np.array(v) for i, v in table if i == query):
                for i, v in table:
                    if i != query:
                        best[i] = min(best.get(i, np.inf), float(np.sqrt(((a - np.array(v)) ** 2).sum())))
            want = sorted(best, key=lambda i: (best[i], i))[:10]
            found = got[got.query_id == query].sort_values("rank")
            assert found.vec_id.tolist() == want and np.allclose(found.score, [best[i] for i in want])
    settings = ann.Settings(rows=150)  # the sample holds all rows, so the parts are the same
    centres = rng.normal(size=(6, 8))
    once = [(i, (centres[i % 6] + 0.3 * rng.normal(size=8)).tolist()) for i in range(600)]
    found = [
        {tuple(r) for r in ann.search(spark.createDataFrame(once * n, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, settings).collect()}
        for n in (1, 3)
    ]
    assert found[0] == found[1] and len(found[0]) == 120


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    lines = []
    assert not compare(spark, FOLDER, {name: queries.QUERIES[name]}, lines.append), lines


def test_registered():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 11)}
    assert "pipeline" in entry.queries()


def test_pipeline(spark):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "jaccard_join", "decontamination", "pii", "bpe"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    extra = docs.withColumn("component_id", F.lit("x")).limit(40)
    rows = extra.unionByName(extra.limit(1))
    now = rows.unionByName(rows.limit(1).withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.lit(None).cast("string")))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, FOLDER)
        assert after.columns == now.columns
        now = spark.createDataFrame(after.collect(), after.schema)
    assert now.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
    assert now.where("doc_id is null").count() == 1
    nothing = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, FOLDER).isEmpty()
    assert 0 < corpus_pipeline.run(spark, FOLDER).count() <= docs.count()


def test_pipeline_judges_texts_of_one_id_each(spark):
    import corpus_pipeline

    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet").where("size(split(text, ' ')) > 15").first().text
    a, b = (" ".join(f"{x}{i * i % 97}{i}" for i in range(40)) for x in "ab")
    rows = [(3, a), (7, a + " end"), (7, b), (7, b), (9, bench), (9, "clean words only"), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    near = corpus_pipeline.one_of_each_group(spark, docs, FOLDER)
    assert sorted(map(tuple, near.collect()), key=str) == sorted([rows[0], rows[2], *rows[4:]], key=str)
    clean = corpus_pipeline.drop_contaminated(spark, docs, FOLDER)
    assert sorted(map(tuple, clean.collect()), key=str) == sorted([*rows[:4], *rows[5:]], key=str)


@pytest.mark.parametrize("size", [1e200, 1e-200, 5e307])
def test_very_large_and_small_vectors_have_neighbours(spark, size):
    rows = [(i, [size * (i % 7 - 3) / 3, size * (i // 7 + 1) / 3]) for i in range(12)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()
    plain = sorted((math.hypot(x / 2 - rows[0][1][0] / 2, y / 2 - rows[0][1][1] / 2) * 2, i) for i, (x, y) in rows[1:])[:10]
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank)] == [i for _, i in plain]
    assert [r.score for r in sorted(got, key=lambda r: r.rank)] == pytest.approx([d for d, _ in plain])
