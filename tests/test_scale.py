"""The ways around hot keys and big tables give the same rows as the plain ways."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from vouchlens.operators import features, metrics, provider_risk
from vouchlens.plans import lookup as lk
from vouchlens.plans import ordered, quantiles


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows under one key, a tenth without a key, the rest spread."""
    n = 20_000
    key = F.when(F.col("id") % 3 == 0, 5).when(F.col("id") % 10 == 1, None).otherwise(F.col("id") % 4000)
    value = F.when(F.col("id") % 4 == 0, 1.5).otherwise(F.round(F.sin("id") * 1000, 1))
    df = spark.range(n).select("id", key.cast("long").alias("k"), value.alias("v"))
    return df.cache()


def rows(df):
    return sorted(df.collect(), key=repr)


def test_hot_keys(spark, skewed):
    hot = {r.k for r in lk.hot_keys(skewed, "k").collect()}
    assert hot == {5, None}


def test_lookup_split_is_a_left_join(spark, skewed):
    stats = skewed.where("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("s"))
    stats = stats.where("k % 2 = 1")
    plain = skewed.join(stats, "k", "left")
    split = lk.lookup_split(skewed, stats, "k")
    assert split.columns == plain.columns
    assert rows(split.withColumn("s", F.round("s", 6))) == rows(plain.withColumn("s", F.round("s", 6)))


def test_three_split_lookups_scan_the_rows_once(spark, skewed, tmp_path):
    skewed.write.parquet(str(tmp_path / "rows"))
    stored = spark.read.parquet(str(tmp_path / "rows"))
    out, plain = stored, stored
    for name in ("a", "b", "c"):
        stats = skewed.where("k IS NOT NULL").groupBy("k").agg(F.count("*").alias(name))
        out, plain = lk.lookup_split(out, stats, "k"), plain.join(stats, "k", "left")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1
    assert rows(out) == rows(plain)


def test_split_lookup_spreads_hot_and_missing_keys(spark, skewed):
    stats = skewed.where("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n"))
    split = lk.lookup_split(skewed, stats, "k")
    assert "_spread" in split._jdf.queryExecution().optimizedPlan().toString().split("Join")[1].split("\n")[0]


def test_lookup_of_a_big_table_is_not_broadcast(spark, skewed, monkeypatch):
    stats = skewed.where("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n"))
    monkeypatch.setattr(lk, "BROADCAST_ROWS", 10)
    big = lk.lookup(skewed, stats, "k")
    monkeypatch.undo()
    assert rows(big) == rows(lk.lookup(skewed, stats, "k"))


@pytest.mark.parametrize("bounds", [(1_000, 100_000), (10, 100), (10, 10)])
@pytest.mark.parametrize("groups", [[], ["g"]])
def test_quantiles_by_brackets(spark, skewed, groups, bounds, monkeypatch):
    """Equal to the built-in percentile on each of the ways that a group's bounds are taken."""
    monkeypatch.setattr(quantiles, "WHOLE", bounds[0])
    monkeypatch.setattr(quantiles, "SOME", bounds[1])
    if bounds[1] < 20_000:  # bounds that are narrow for many rows must stay two ranks wide for few
        monkeypatch.setattr(quantiles, "NARROW", 2e-3)
    wide = F.col("id") % 3 == 0
    df = skewed.withColumn("g", F.when(wide, "hot").when(F.col("id") < 9, "few").otherwise((F.col("id") % 7).cast("string")))
    df = df.withColumns({"w": F.sin(F.col("id") * 7) * F.col("id"), "e": F.lit(None).cast("double")})
    probs = {"a": 0.0, "b": 0.1, "c": 0.3, "d": 0.5, "e": 0.75, "f": 1.0}
    for few in (False, True):
        for v in ("v", "w"):
            want = df.groupBy(*groups).agg(*[F.percentile(v, F.lit(p)).alias(n) for n, p in probs.items()])
            got = quantiles.exact_quantiles(df, v, probs, groups, few)
            tidy = [df_.select(*groups, *[F.round(n, 9).alias(n) for n in probs]) for df_ in (got, want)]
            assert rows(tidy[0]) == rows(tidy[1])
    both = spark.range(1).select(quantiles.column_quantiles(df, ["v", "w", "e"], probs).alias("q")).first().q
    for v in ("v", "w"):
        want = df.agg(*[F.percentile(v, F.lit(p)).alias(n) for n, p in probs.items()]).first()
        assert list(both[v]) == pytest.approx(list(want))
    assert list(both.e) == [None] * 6


def test_quantiles_of_small_groups_of_every_size(spark):
    df = spark.range(1, 60).select(F.col("id").alias("g"), F.explode(F.sequence(F.lit(1), F.col("id"))).alias("v"))
    probs = {f"p{i}": i / 20 for i in range(21)}
    want = df.groupBy("g").agg(*[F.percentile("v", F.lit(p)).alias(n) for n, p in probs.items()])
    got = quantiles.exact_quantiles(df, "v", probs, ["g"])
    tidy = [df_.select("g", *[F.round(n, 9).alias(n) for n in probs]) for df_ in (got, want)]
    assert rows(tidy[0]) == rows(tidy[1])


def test_quantiles_of_nothing(spark, skewed):
    none = skewed.where("id < 0")
    assert quantiles.exact_quantiles(none, "v", {"m": 0.5}).first().m is None
    assert quantiles.exact_quantiles(none, "v", {"m": 0.5}, ["k"]).count() == 0


def test_ranges_follow_the_count():
    assert ordered.ranges_for(10, 1_000_000) == 256
    for n in (10**9, 10**11):
        ranges = ordered.ranges_for(n, 1_000_000)
        assert ranges & (ranges - 1) == 0 and 1_000_000 / 10 < n / ranges <= 1_000_000 / 4


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(spark, skewed, descending):
    cells = skewed.groupBy("v").agg(F.count("*").alias("n"))
    small = ordered.running_totals(cells, ["v"], ["n"], descending=descending)
    big = ordered.running_totals(cells, ["v"], ["n"], descending=descending, limit=0)
    assert rows(small) == rows(big.select(small.columns))


def test_row_numbers_with_one_value_for_a_third(spark, skewed):
    df = skewed.select("id", F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.abs("v")).alias("s"))
    want = df.withColumn("i", F.row_number().over(Window.orderBy("s", "id")).cast("bigint"))
    for limit in (0, None):
        got = ordered.with_row_number(df, "s", "id", "i", limit)
        assert rows(got.select("id", "s", "i")) == rows(want)


def test_modes_take_the_smallest_on_a_tie(spark):
    df = spark.createDataFrame([("b", "x"), ("a", "x"), ("b", "y"), ("a", None)], "p string, q string")
    m = spark.range(1).select(ordered.column_modes(df, ["p", "q"]).alias("m")).first().m
    assert (m.p, m.q) == ("a", "x")


def test_splits_are_exact_and_repeatable(spark, skewed):
    hot_day = F.when(F.col("id") % 3 == 0, F.lit(700)).otherwise(F.col("id") % 1000)
    df = skewed.withColumn("d", F.date_add(F.lit("2020-01-01").cast("date"), hot_day.cast("int")))
    df = df.withColumn("y", (F.col("id") % 5 == 0).cast("int"))
    n = df.count()
    one = features.temporal_split(df, "d", ["id"])
    two = features.temporal_split(df.repartition(7), "d", ["id"])
    assert one.where("split = 'train'").count() == int(n * 0.8)
    assert rows(one) == rows(two)
    last = one.where("split = 'train'").agg(F.max("d")).first()[0]
    first = one.where("split = 'test'").agg(F.min("d")).first()[0]
    assert last <= first
    strata = features.stratified_split(df, "y", ["id"]).groupBy("y", "split").count().collect()
    assert {(r.y, r.split): r["count"] for r in strata} == {
        (0, "test"): 3200,
        (0, "train"): 12800,
        (1, "test"): 800,
        (1, "train"): 3200,
    }
    folds = features.time_folds(df, "d", ["id"]).groupBy("fold").count().collect()
    assert {r.fold: r["count"] for r in folds} == {0: n - 5 * (n // 6), **{i: n // 6 for i in range(1, 6)}}
    even = features.stratified_folds(df, "y", ["id"]).groupBy("fold", "y").count().collect()
    assert {r["count"] for r in even if r.y == 1} == {800}


def test_auc_of_known_cases(spark):
    def frame(pairs):
        return metrics.with_prediction(spark.createDataFrame(pairs, "label int, score double"))

    perfect = metrics.ranking_metrics(frame([(0, 0.1), (1, 0.9)])).first()
    assert (perfect.roc_auc, perfect.average_precision) == (1.0, 1.0)
    tied = metrics.ranking_metrics(frame([(0, 0.5), (1, 0.5)])).first()
    assert (tied.roc_auc, tied.average_precision) == (0.5, 0.5)
    one_class = metrics.ranking_metrics(frame([(1, 0.5)])).first()
    assert one_class.roc_auc is None
    never = metrics.binary_metrics(frame([(1, 0.1), (0, 0.2)])).first()
    assert (never.precision, never.recall, never.f1) == (0.0, 0.0, 0.0)


def test_weights_must_sum_to_one(spark):
    with pytest.raises(ValueError):
        provider_risk.unranked_scores(None, None, weights={"a": 0.5})


def test_folds_hash_each_key_once(spark):
    df = spark.range(60).select("id", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 7).cast("int")).alias("d"))
    marked = features.time_folds(df, "d", ["id"], folds=5)
    top = marked.select("fold")._jdf.queryExecution().optimizedPlan().toString().splitlines()[0]
    assert top.startswith("Project") and "lambda" not in top
    order = sorted((str(r.d), r.h, r.id) for r in df.withColumn("h", F.md5(F.concat_ws("|", F.lit(""), F.col("id").cast("string")))).collect())
    want = {key: max(0, i // 10) for i, (_, _, key) in enumerate(order)}
    assert {r.id: r.fold for r in marked.collect()} == want
