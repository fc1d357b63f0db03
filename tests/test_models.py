"""Models against their definitions: optima, MLlib's own scores, their SQL in another engine, shared fits."""

import duckdb
import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from vouchlens.operators import boosting, forests, logistic, training, trees
from vouchlens.operators.logistic import Wanted
from vouchlens.session import scratch_path

FEATURES = ["a", "b b", "c", "flat"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3)) * [1, 30, 0.1] + [0, 2000, 0]
    y = (x[:, 0] + (x[:, 1] - 2000) / 30 + rng.normal(size=400) > 0.5).astype(int)
    data = [(*map(float, r), 1.0, int(t), int(i % 4)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(data, "a double, `b b` double, c double, flat double, y int, fold int")
    return df.repartition(3).cache()


def objective_slopes(pdf, model, w):
    """Slope of the mean loss in each coefficient and the intercept, written out plainly."""
    x, y = pdf[FEATURES].to_numpy(), pdf["y"].to_numpy()
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum())) if w.balanced else np.ones(len(y))
    p = 1 / (1 + np.exp(-(x @ np.array(model.coefficients) + model.intercept)))
    return ((weight * (p - y)) @ x) / len(y), (weight * (p - y)).sum() / len(y)


@pytest.mark.parametrize("l1", [False, True])
def test_logistic_models_are_optimal(spark, rows, l1):
    wanted = [Wanted(c, l1, b, f) for c in (0.01, 1.0, 100.0) for b in (False, True) for f in (None, frozenset({0, 1}))]
    models = logistic.fit_many(rows, FEATURES, "y", wanted, "fold")
    pdf = rows.toPandas()
    for w, m in zip(wanted, models, strict=True):
        own = pdf if w.folds is None else pdf[pdf.fold.isin(list(w.folds))]
        slope, level = objective_slopes(own, m, w)
        b, strength = np.array(m.coefficients), 1 / (w.C * len(own))
        assert abs(level) < 1e-9
        scale = own[FEATURES].std().to_numpy() + 1e-3
        if l1:
            on = b != 0
            assert np.all(np.abs(slope[on] + strength * np.sign(b[on])) < 1e-8 * scale[on])
            assert np.all(np.abs(slope[~on]) <= strength + 1e-8)
        else:
            assert np.all(np.abs(slope + strength * b) < 1e-8 * scale)
    if l1:
        assert any(0.0 in m.coefficients[:3] for m in models)


def test_logistic_without_rows_or_a_class(spark, rows):
    one = logistic.fit_many(rows.where("y = 1"), FEATURES, "y", [Wanted(), Wanted(folds=frozenset({9}))], "fold")
    assert one[1].coefficients == (0.0,) * 4 and one[1].intercept == 0.0
    assert all(np.isfinite(one[0].coefficients))
    assert logistic.fit_many(rows.limit(0), FEATURES, "y", [Wanted()])[0].coefficients == (0.0,) * 4


def scores_in_sql(df, expression):
    pdf = df.toPandas()
    con = duckdb.connect()
    con.register("t", pdf)
    return np.array([r[0] for r in con.execute(f"SELECT {expression} FROM t").fetchall()]), pdf["score"].to_numpy()


def test_models_as_sql_and_saved(spark, rows):
    s = training.TrainingSettings(FEATURES, "y")
    small = {
        training.LOGISTIC: {},
        training.FOREST: {"n_estimators": 12, "max_depth": 4},
        training.BOOSTING: {"n_estimators": 6, "max_depth": 3},
    }
    folder = scratch_path(spark, "kept")
    for name, parameters in small.items():
        model = training.train(rows, name, {**training.DEFAULTS[name], **parameters}, s)
        other, own = scores_in_sql(model.scored(rows), model.sql(quote='"'))
        assert other == pytest.approx(own, abs=1e-12) and len(set(own.tolist())) > 5
        training.save_models({name: model}, folder)
        again = training.load_model(folder, name).scored(rows).select("a", "score", "prediction")
        assert again.exceptAll(model.scored(rows).select("a", "score", "prediction")).count() == 0
        importance = training.feature_importance(model, FEATURES).collect()
        assert len(importance) == 4 and importance[-1].feature == "flat"


def test_forest_groups_equal_their_fits(spark, rows, monkeypatch):
    monkeypatch.setattr(trees, "GROUP", 3)
    learner = RandomForestClassifier(
        featuresCol="features", labelCol="y", weightCol="w", numTrees=7, maxDepth=5, featureSubsetStrategy="sqrt", seed=5
    )
    ready = rows.withColumn("w", F.when(F.col("y") == 1, 1.5).otherwise(1.0))
    folder = scratch_path(spark, "forest")
    forest = trees.fit_forest(ready, FEATURES, 400, learner, folder)
    seen = trees.assembled(ready.coalesce(1), FEATURES)
    parts = [learner.copy().setNumTrees(n).setSeed(5 + i).fit(seen) for i, n in enumerate((3, 3, 1))]
    votes, importance = np.zeros((400, 2)), np.zeros(4)
    for p in parts:
        votes += np.array([r[0] for r in p.transform(seen).select(vector_to_array("rawPrediction")).collect()])
        importance += p.featureImportances.toArray() * p.getNumTrees / 7
    own = forest.scored(ready.coalesce(1)).collect()
    assert [r.score for r in own] == pytest.approx((votes[:, 1] / 7).tolist())
    assert [r.prediction for r in own] == (votes[:, 1] > votes[:, 0]).astype(int).tolist()
    assert forest.importance() == pytest.approx(importance.tolist(), abs=1e-6)

    def refuse(*_):
        raise AssertionError("grown again")

    monkeypatch.setattr(trees, "keep", refuse)  # all groups are there already
    assert trees.fit_forest(ready, FEATURES, 400, learner, folder).importance() == pytest.approx(forest.importance())


def test_leading_trees_are_the_smaller_models(spark, rows):
    seen = rows.withColumn("w", F.lit(1.0)).coalesce(1)

    def learner(n):
        return GBTClassifier(featuresCol="features", labelCol="y", weightCol="w", maxIter=n, maxDepth=3, subsamplingRate=0.8, seed=3)

    large = trees.fit_boosted(seen, FEATURES, 400, learner(9)).sums(seen, [4, 9]).select("sums").collect()
    for k, n in enumerate((4, 9)):
        raw = learner(n).fit(trees.assembled(seen, FEATURES)).transform(trees.assembled(seen, FEATURES))
        plain = [r[0][1] for r in raw.select(vector_to_array("rawPrediction")).collect()]
        assert [r.sums[k] for r in large] == pytest.approx(plain)


@pytest.mark.parametrize(
    "name, grid",
    [
        (training.LOGISTIC, {"C": [0.1, 1], "penalty": ["l1", "l2"], "solver": ["liblinear", "saga"]}),
        (training.FOREST, {"n_estimators": [3, 6], "max_depth": [None, 30], "min_samples_split": [2, 5]}),
        (training.BOOSTING, {"n_estimators": [2, 4], "max_depth": [2], "gamma": [0, 0.1], "subsample": [1.0]}),
    ],
)
def test_search_shares_fits_and_goes_on(spark, rows, name, grid, monkeypatch):
    s = training.TrainingSettings(FEATURES, "y")
    points = training.grid_points(grid)
    fits = []
    plain = training.train
    monkeypatch.setattr(training, "train", lambda *a, **k: fits.append(a[1]) or plain(*a, **k))
    folder = scratch_path(spark, "search")
    found, best, model = training.search_and_refit(rows, name, s, points, results=folder)
    got = {r.point: r.mean_f1 for r in found.collect()}
    assert len(got) == len(points) and found.first().mean_f1 == max(got.values())
    assert {k: best[k] for k in grid} == points[found.first().point] and model.scored(rows).count() == 400
    shared = training.shared_fits(name, points)
    assert len(fits) == (0 if name == training.LOGISTIC else 3 * len(shared)) + 1
    assert all(len({got[i] for i in own}) == 1 or name != training.LOGISTIC for own in shared.values())
    # a point alone, fold by fold; a forest's draws depend on the order of rows
    for i in (0, len(points) - 1) if name != training.FOREST else ():
        scores = []
        for n in (1, 2, 3):
            one = plain(rows.where(F.col("fold") < n), name, {**training.DEFAULTS[name], **points[i]}, s)
            held = one.scored(rows.where(F.col("fold") == n)).select("y", "prediction").collect()
            tp = sum(r.y == r.prediction == 1 for r in held)
            scores.append(2 * tp / (sum(r.y for r in held) + sum(r.prediction for r in held)) if tp else 0.0)
        assert got[i] == pytest.approx(sum(scores) / 3)
    fits.clear()
    again = training.search(rows, name, points, s, results=folder)
    assert {r.point: r.mean_f1 for r in again.collect()} == got and not fits


def test_a_logistic_search_computes_its_rows_once(spark, rows):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    points = training.grid_points({"C": [0.1, 1], "penalty": ["l1", "l2"]})
    computed = rows.coalesce(2).mapInArrow(count, rows.schema)
    results, best, model = training.search_and_refit(computed, training.LOGISTIC, training.TrainingSettings(FEATURES, "y"), points)
    assert seen.value == 400 and results.count() == 4
    alone = training.train(rows, training.LOGISTIC, best, training.TrainingSettings(FEATURES, "y"))
    assert model.coefficients == pytest.approx(alone.coefficients, abs=1e-10)


def test_packed_rows_are_the_rows(spark, rows, monkeypatch):
    monkeypatch.setattr(logistic, "CELL", 3 * 8 * len(FEATURES))  # three rows a value, the last value of a batch with fewer
    more = rows.unionByName(rows.limit(1).withColumn("y", F.lit(None).cast("int")))
    known = logistic.pack(more, FEATURES, "y", "fold")
    got = []
    for r in known.packed.toArrow().to_batches():
        for x, y, fold in logistic.unpacked([r], np.zeros(4)):
            got += [(*v[:4], int(c), int(f)) for v, c, f in zip(x.tolist(), y, fold, strict=True)]
    want = [tuple(r) for r in rows.select(*[f"`{f}`" for f in FEATURES], "y", "fold").collect()]
    assert sorted(got) == sorted(want) and sum(known.counts.values()) == 400
    assert known.centre == pytest.approx(np.mean([r[:4] for r in want], axis=0))


def test_models_that_start_alike_share_their_sums(spark, rows, monkeypatch):
    """Products for many models at once are those of each; in the first pass models differ by folds and weights only."""
    x, w = np.random.default_rng(1).normal(size=(50, 5)), np.random.default_rng(2).random((50, 6))
    upper = np.triu_indices(5)
    for k in range(6):
        assert logistic.products(x, w, upper)[k] == pytest.approx(((x * w[:, [k]]).T @ x)[upper])
    wanted = [Wanted(c, l1, False, f) for c in (0.1, 1.0, 10.0) for l1 in (False, True) for f in (frozenset({0}), frozenset({0, 1}))]
    known = logistic.pack(rows, FEATURES, "y", "fold")
    sums = logistic.curvature(known, wanted, {m: np.zeros(5) for m in range(len(wanted))})
    assert list(sums) == list(range(12)) and len({id(s[2]) for s in sums.values()}) == 2
    own = rows.where("fold in (0, 1)").toPandas()[FEATURES].to_numpy() - known.centre
    own = np.concatenate([own, np.ones((len(own), 1))], axis=1)
    assert sums[1][2] == pytest.approx(own.T @ own / 4)
    some = logistic.curvature(known, wanted, {m: np.full(5, m / 100) for m in range(12)}, {3, 5})
    every = logistic.curvature(known, wanted, {m: np.full(5, m / 100) for m in range(12)})
    assert [m for m, s in some.items() if s[2] is not None] == [3, 5]
    for m in range(12):
        assert some[m][0] == pytest.approx(every[m][0]) and some[m][1] == pytest.approx(every[m][1])
    assert some[5][2] == pytest.approx(every[5][2])


@pytest.mark.parametrize("finish, at_once", [(1_000_000, 4096), (60, 3)])
def test_deep_trees_are_those_of_mllib(spark, rows, monkeypatch, finish, at_once):
    """Without draws a deep tree is MLlib's, whether its nodes are split in passes or finished in tasks."""
    monkeypatch.setattr(forests, "FINISH", finish)
    monkeypatch.setattr(forests, "AT_ONCE", at_once)
    monkeypatch.setattr(forests, "BLOCK", 50)
    ready = rows.withColumn("w", F.when(F.col("y") == 1, 1.5).otherwise(1.0))
    learner = RandomForestClassifier(
        featuresCol="features", labelCol="y", weightCol="w", numTrees=2, maxDepth=20, featureSubsetStrategy="all",
        bootstrap=False, minInstancesPerNode=2, seed=5,
    )
    forest = trees.fit_forest(ready, FEATURES, 400, learner)
    model = learner.fit(trees.assembled(ready, FEATURES))
    trees.keep(spark, model, 0, False, path := scratch_path(spark, "plain"))
    plain = trees.TreeModel(False, tuple(FEATURES), 2, spark.read.parquet(path))
    assert forest.nodes.count() == plain.nodes.count() > 100
    score = [r.score for r in plain.scored(rows).orderBy("a").collect()]
    assert [r.score for r in forest.scored(rows).orderBy("a").collect()] == pytest.approx(score)
    assert forest.importance() == pytest.approx(plain.importance())
    values = forest.nodes.groupBy("tree").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("id").alias("n"), F.count_distinct("id").alias("d"))
    assert all(r.low == 0 and r.high + 1 == r.n == r.d for r in values.collect())
    assert forest.nodes.where("left >= 0 and (left <= id or right <= id)").isEmpty()


def test_a_deep_forest_draws_bags_and_columns(spark, rows, monkeypatch):
    """Trees differ, are the same when grown again, however the rows come to their tasks, and tell as much as MLlib's."""
    ready = rows.withColumn("w", F.when(F.col("y") == 1, 1.5).otherwise(1.0)).repartition(1)
    learner = RandomForestClassifier(featuresCol="features", labelCol="y", weightCol="w", numTrees=24, maxDepth=20, minInstancesPerNode=2, seed=5)
    found = [trees.fit_forest(ready.orderBy("a").coalesce(1), FEATURES, 400, learner).nodes.drop("part").orderBy("tree", "id").collect() for _ in range(2)]
    assert found[0] == found[1] and len({r.threshold for r in found[0] if r.id == 0}) > 3
    monkeypatch.setattr(forests, "FINISH", 50)
    forest = trees.fit_forest(ready.orderBy("a").coalesce(1), FEATURES, 400, learner)
    score = {r.a: r.score for r in forest.scored(rows).collect()}
    again = trees.TreeModel(False, tuple(FEATURES), 24, spark.createDataFrame(found[0], trees.NODES)).scored(rows)
    assert all(score[r.a] == pytest.approx(r.score) for r in again.collect())
    plain = learner.fit(trees.assembled(ready, FEATURES)).transform(trees.assembled(ready, FEATURES)).select("a", vector_to_array("probability")[1].alias("p"))
    assert np.mean([abs(score[r.a] - r.p) for r in plain.collect()]) < 0.08


def test_a_large_model_is_applied_in_parts(spark, rows, monkeypatch):
    model = training.train(rows, training.FOREST, {**training.DEFAULTS[training.FOREST], "n_estimators": 9}, training.TrainingSettings(FEATURES, "y"))
    whole = {r.a: r.sums for r in model.sums(rows, [2, 5, 9]).collect()}
    monkeypatch.setattr(trees, "AT_ONCE", 200)
    assert len(model.parts()) > 3 and model.sums(rows, [2, 5, 9]).columns == [*rows.columns, "sums"]
    got = model.sums(rows, [2, 5, 9]).collect()
    assert len(got) == 400 and all(r.sums == pytest.approx(whole[r.a]) for r in got)


@pytest.mark.parametrize("together", [64, 1])
def test_boosted_trees_of_large_tables_are_those_of_mllib(spark, rows, monkeypatch, together):
    """Without draws the trees grown by sums over packed rows are MLlib's, with few nodes, columns and blocks at once too."""
    ready = rows.withColumn("w", F.when(F.col("y") == 1, 2.0).otherwise(1.0))
    learner = GBTClassifier(
        featuresCol="features", labelCol="y", weightCol="w", maxIter=5, maxDepth=4, minInstancesPerNode=3, minInfoGain=0.1 / 400, seed=3
    )
    plain = trees.fit_boosted(ready, FEATURES, 400, learner)
    for name, value in (("BLOCK", 50), ("AT_ONCE", 3), ("ANEW", 2), ("CELLS", 40), ("TOGETHER", together)):
        monkeypatch.setattr(boosting, name, value)
    monkeypatch.setattr(trees, "TASK_ROWS", 100)

    def refuse(*_):
        raise AssertionError("a shuffle for every level")

    monkeypatch.setattr(GBTClassifier, "fit", refuse)
    own = trees.fit_boosted(ready, FEATURES, 400, learner)
    assert own.nodes.count() == plain.nodes.count() > 50 and own.trees == 5
    want = [r.sums for r in plain.sums(rows, [1, 3, 5]).orderBy("a").collect()]
    assert [r.sums for r in own.sums(rows, [1, 3, 5]).orderBy("a").collect()] == [pytest.approx(s, abs=1e-9) for s in want]
    assert own.importance() == pytest.approx(plain.importance(), abs=1e-2)


def test_boosted_trees_draw_bags_and_columns(spark, rows, monkeypatch):
    monkeypatch.setattr(trees, "TASK_ROWS", 100)
    ready = rows.withColumn("w", F.lit(1.0)).orderBy("a").coalesce(1)
    learner = GBTClassifier(
        featuresCol="features", labelCol="y", weightCol="w", maxIter=6, maxDepth=3, subsamplingRate=0.8, featureSubsetStrategy="0.5", seed=3
    )
    found = [trees.fit_boosted(ready, FEATURES, 400, learner).nodes.orderBy("tree", "id").collect() for _ in range(2)]
    assert found[0] == found[1] and len({r.feature for r in found[0] if r.id == 0}) > 1
    scored = trees.fit_boosted(ready, FEATURES, 400, learner).scored(rows).select("y", "prediction").collect()
    assert np.mean([r.y == r.prediction for r in scored]) > 0.7
    # one class, as the search's folds may have it
    alike = trees.fit_boosted(ready.where("y = 1"), FEATURES, 400, learner)
    assert alike.nodes.count() == 6 and {r.prediction for r in alike.scored(rows).collect()} == {1}


def test_a_model_that_fails_is_no_result(spark, rows, monkeypatch):
    from vouchlens.suite import models as suite

    few = {
        training.LOGISTIC: training.DEFAULTS[training.LOGISTIC],
        training.BOOSTING: {**training.DEFAULTS[training.BOOSTING], "n_estimators": 2, "max_depth": 2},
    }
    split = rows.withColumn("split", F.when(F.col("fold") == 0, "test").otherwise("train")).withColumn("risk_target", F.col("y"))
    monkeypatch.setattr(suite, "prepared", lambda s, d: (split.withColumnRenamed("b b", "b"), ["a", "b", "c"], ["a", "b", "c"]))
    monkeypatch.setattr(training, "DEFAULTS", few)
    assert {r.model for r in suite.QUERIES["M20_train_and_evaluate"](spark, "").collect()} == set(few)

    def refuse(*_, **__):
        raise MemoryError

    monkeypatch.setattr(training, "fit_boosted", refuse)
    with pytest.raises(training.TrainingFailed, match="xgboost: MemoryError"):
        suite.QUERIES["M20_train_and_evaluate"](spark, "")
    found = {(r.model, r.split): r.message for r in suite.QUERIES["M5_train_all_models"](spark, "").collect()}
    assert found == {("logistic_regression", "train"): None, ("logistic_regression", "test"): None, ("xgboost", None): "MemoryError: "}
    monkeypatch.setattr(training, "fit_many", refuse)
    with pytest.raises(training.TrainingFailed, match="logistic_regression: MemoryError"):
        suite.QUERIES["M5_train_all_models"](spark, "")


def test_rows_are_led_by_one_number_a_node():
    """Children in any order, values on and beside thresholds, values that are none, a tree of one leaf; 16 bytes a node."""
    rng, tree, nodes = np.random.default_rng(4), [], []
    for t, splits in enumerate((12, 0, 30)):
        first, free = len(nodes), [len(nodes)]
        nodes.append([-1, -1, 0, 0.0, rng.random()])
        for _ in range(splits):
            at, a = free.pop(rng.integers(len(free))), len(nodes)
            nodes[at][:4] = *rng.permutation([a, a + 1]).tolist(), int(rng.integers(3)), float(rng.integers(6))
            nodes += [[-1, -1, 0, 0.0, rng.random()] for _ in range(2)]
            free += [a, a + 1]
        tree += [t] * (len(nodes) - first)
    left, right, feature, threshold, value = (np.array(c) for c in zip(*nodes, strict=True))
    x = rng.integers(-1, 14, (300, 3)) / 2.0
    x[rng.random(x.shape) < 0.1] = np.nan

    def walk(row, at):
        while left[at] >= 0:
            at = left[at] if row[feature[at]] <= threshold[at] else right[at]
        return value[at]

    leaves = np.array([[walk(row, at) for at in (0, 25, 26)] for row in x])
    arrays = trees.Arrays.of(3, np.array(tree), left, right, feature, threshold, value)
    assert (arrays.sums(x, [1, 3]) == np.stack([leaves[:, 0], leaves[:, 0] + leaves[:, 1] + leaves[:, 2]], axis=1)).all()
    assert arrays.node.nbytes + arrays.value.nbytes == 16 * len(nodes)


def test_rows_are_counted_in_pieces(monkeypatch):
    rng = np.random.default_rng(6)
    thresholds = tuple(np.arange(k) + 0.5 for k in (3, 1, 7, 0))
    plan = forests.Plan(thresholds, (0,) * 5, (0, 2, 3, 6, 6), (1.0, 2.0), 2, 9, 1, 0.0, True, 1.0, 3)
    x = np.stack([rng.integers(0, len(t) + 1, 500) for t in thresholds], axis=1).astype(np.uint8)
    y, n, slot = rng.integers(0, 2, 500), rng.integers(1, 4, 500).astype(float), rng.integers(0, 5, 500)
    columns = plan.columns(0, np.arange(8, 13))
    some = np.flatnonzero(rng.random(500) < 0.7)
    want = [
        n[(slot == s) & (x[:, f] == b) & (y == c) & np.isin(np.arange(500), some)].sum()
        for s, drawn in enumerate(columns.tolist())
        for f in drawn
        for b in range(plan.bins[f])
        for c in (0, 1)
    ]
    monkeypatch.setattr(forests, "CHUNK", 64)
    got = forests.counted(forests.doubled(x, y, plan), some * 4, n[some], slot[some], columns, plan)
    assert got.ravel().tolist() == want
    draws = np.random.default_rng([3, 5, 9]).random(4000)
    assert (plan.bag(5, 9, 4000) == np.searchsorted(plan.poisson, draws, side="right")).all()
