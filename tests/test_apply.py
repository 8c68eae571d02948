import random
import os
from dataclasses import replace

import pytest
from pyspark.ml.classification import LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.sql import functions as F

from gainsieve import PatternClassifier, PatternClassifierModel, PatternMiner, PatternModel
from gainsieve.operators import apply as matching
from gainsieve.operators import explain, metrics, prep
from gainsieve.plans.tuning import cross_validate, scorers, stratified_folds, summarize
from gainsieve.sources import files
from gainsieve.sources.workspace import Workspace
from gainsieve.streaming import apply as streams
from tests.test_mining import random_rows

SCHEMA = "tid bigint, a int, b double, c string, d string, y int"


@pytest.fixture(scope="module")
def train(spark):
    return spark.createDataFrame(random_rows(11, 200), SCHEMA)


@pytest.fixture(scope="module")
def model(train):
    return PatternMiner(label="y", keys=["tid"], bins=4, length=3).fit(train)


def unseen(spark):
    rows = [(0, -5, 0.1, "p", "u"), (1, 99, 99.0, "zz", "v"), (2, 8, float("nan"), None, " u "), (3, 9, 1.0, "q", "v")]
    return spark.createDataFrame(rows, "tid bigint, a int, b double, c string, d string")


def pairs(df):
    return sorted((r["tid"], r["pid"]) for r in df.collect())


def test_three_ways_to_match_agree(spark, model, train):
    for rows in (train, unseen(spark)):
        inline = pairs(matching.coordinates(model.match(rows), ["tid"]))
        joined = pairs(matching.match_join(model.row_items(rows), model.patterns, ["tid"]))
        bare = replace(model, shapes=None, _known=None)
        assert pairs(matching.coordinates(bare.match(rows), ["tid"])) == joined
        ids = model.row_items(rows)
        profiled = pairs(matching.coordinates(matching.match_profiles(ids, model.patterns), ["tid"]))
        assert inline == joined == profiled


def test_training_rows_match_their_patterns(model, train):
    got = {r["pid"]: r["n"] for r in model.coordinates(train, ["tid"]).groupBy("pid").agg(F.count("*").alias("n")).collect()}
    assert got == {r["pid"]: r["support"] for r in model.patterns.collect()}


def test_unseen_values_have_no_item(spark, model):
    rows = {r["tid"]: r for r in model.row_items(unseen(spark)).collect()}
    names = {r["item"]: r["col"] for r in model.items.collect()}
    assert [names[i] for i in rows[1]["item_ids"]] in ([], ["d"])
    assert not {"b", "c"} & {names[i] for i in rows[2]["item_ids"]}


def test_model_round_trip(spark, model, train):
    path = Workspace(spark).new_path("model")
    model.save(path)
    back = PatternModel.load(spark, path)
    assert [r["pids"] for r in back.match(train).orderBy("tid").collect()] == [
        r["pids"] for r in model.match(train).orderBy("tid").collect()
    ]


def test_matrix_round_trip(spark, model, train):
    path = Workspace(spark).new_path("matrix")
    files.write_coordinates(model.coordinates(train, ["tid"]), path, train.count(), model.n_patterns)
    coords, shape = files.read_coordinates(spark, path)
    assert shape == (200, model.n_patterns)
    vectors = files.coordinates_to_vectors(train.select("tid"), coords, ["tid"], model.n_patterns).orderBy("tid").collect()
    direct = model.transform(train).orderBy("tid").collect()
    assert [v["features"] for v in vectors] == [d["features"] for d in direct]


def test_stream_equals_batch(spark, model, train):
    ws = Workspace(spark)
    ws.table(train, "stream-in")
    source = spark.readStream.schema(train.schema).parquet(f"{ws.path}/001-stream-in")
    out = ws.new_path("out")
    streams.write_matches(source, model, ["tid"], out, ws.new_path("state")).awaitTermination()
    got = {r["tid"]: r["pids"] for r in spark.read.parquet(out).collect()}
    assert got == {r["tid"]: r["pids"] for r in model.match(train).collect()}


def test_joined_patterns_equal_inline_ones_in_batch_and_stream(spark, model, train):
    beyond = replace(model, inline_patterns=0)
    plain, joined = model.match(train), beyond.match(train)
    assert joined.columns == plain.columns
    expected = sorted(plain.select("tid", "item_ids", "pids").collect())
    assert sorted(joined.select("tid", "item_ids", "pids").collect()) == expected
    ws = Workspace(spark)
    ws.table(train, "stream-in")
    source = spark.readStream.schema(train.schema).parquet(f"{ws.path}/001-stream-in")
    out = ws.new_path("out")
    streams.write_matches(source, beyond, ["tid"], out, ws.new_path("state")).awaitTermination()
    assert {r["tid"]: r["pids"] for r in spark.read.parquet(out).collect()} == {r["tid"]: r["pids"] for r in expected}


def test_fit_rejects_null_labels_and_infinite_values(spark):
    rows = [(i, float(i), i % 2) for i in range(20)]
    with pytest.raises(ValueError, match="nulls"):
        PatternMiner(label="y", features=["v"]).fit(spark.createDataFrame([*rows, (20, 1.0, None)], "tid int, v double, y int"))
    with pytest.raises(ValueError, match="infinite"):
        PatternMiner(label="y", features=["v"]).fit(spark.createDataFrame([*rows, (20, float("inf"), 1)], "tid int, v double, y int"))


def test_split_keeps_rows_without_label(spark):
    df = spark.createDataFrame([(i, [0, 1, None][i % 3]) for i in range(90)], "k int, y int")
    out = prep.stratified_split(df, "y", ["k"], Workspace(spark))
    sizes = {(r["y"], r["is_test"]): r["count"] for r in out.groupBy("y", "is_test").count().collect()}
    assert sizes == {(y, t): 6 if t else 24 for y in (0, 1, None) for t in (True, False)}


@pytest.fixture(scope="module")
def classifier(train):
    return PatternClassifier(labelCol="y", keys=["tid"], bins=4, length=2).fit(train.filter("y < 2"))


def test_classifier_learns_and_reloads(spark, classifier, train):
    two = train.filter("y < 2")
    scored = classifier.transform(two)
    acc = scored.agg(F.avg((F.col("label_code") == F.col("prediction")).cast("double"))).first()[0]
    assert acc > 0.8
    assert scored.filter("abs(probability[0] + probability[1] - 1) > 1e-9").count() == 0
    path = Workspace(spark).new_path("classifier")
    classifier.save(path)
    back = PatternClassifierModel.load(spark, path)
    assert pairs_of(back.transform(two)) == pairs_of(scored)
    decoded = classifier.predict(two).select("predicted_label").distinct().collect()
    assert {r[0] for r in decoded} <= {0, 1}


def pairs_of(df):
    return sorted((r["tid"], r["prediction"]) for r in df.select("tid", "prediction").collect())


def test_merged_training_rows_give_the_same_model(classifier, train):
    merged = classifier.patterns.training_table()
    assert merged.agg(F.sum("weight")).first()[0] == train.filter("y < 2").count()


@pytest.mark.parametrize("base", ["forest", "bayes", "default"])
def test_three_classes_and_other_classifiers(train, base):
    kinds = {"forest": lambda n, k: RandomForestClassifier(numTrees=5, seed=1), "bayes": lambda n, k: NaiveBayes(modelType="bernoulli")}
    model = PatternClassifier(labelCol="y", keys=["tid"], bins=3, base_estimator=kinds.get(base)).fit(train)
    rows = model.transform(train).select("prediction", "probability").collect()
    assert all(len(r["probability"]) == 3 and abs(sum(r["probability"]) - 1) < 1e-9 for r in rows)


def test_cross_validation_and_scorers(spark, train):
    est = PatternClassifier(labelCol="y", keys=["tid"], bins=3)
    two = train.filter("y < 2")
    folds = cross_validate(est, two, ["tid"], folds=2)
    assert folds.count() == 14
    summary = {r["metric"]: r["value"] for r in summarize(folds).collect()}
    assert set(summary) == {"accuracy", "f1", "auc", "h", "log_loss"} and summary["accuracy"] > 0.6
    dealt = stratified_folds(two, "y", ["tid"], Workspace(spark), 4).groupBy("y", "fold").count().collect()
    for y in (0, 1):
        sizes = [r["count"] for r in dealt if r["y"] == y]
        assert max(sizes) - min(sizes) <= 1
    assert not scorers(2)["log_loss"].isLargerBetter() and scorers(3)["f1"].isLargerBetter()


def test_filed_patterns_are_a_table_of_known_size(model, train):
    matched = replace(model, inline_patterns=0).match(train)
    assert "collect_list" not in matched._jdf.queryExecution().toString()
    assert pairs(matching.coordinates(matched, ["tid"])) == pairs(model.coordinates(train, ["tid"]))


def test_classifier_is_fitted_on_few_partitions(spark, train):
    parts = []

    class Spy(LogisticRegression):
        def _fit(self, dataset):
            parts.append(dataset.persist().rdd.getNumPartitions())
            return super()._fit(dataset)

    spark.conf.set("spark.sql.shuffle.partitions", 40)
    try:
        PatternClassifier(labelCol="y", keys=["tid"], bins=3, base_estimator=lambda n, k: Spy()).fit(train)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert parts[0] < 8


def test_permutation_importance_equals_brute_force(spark, classifier, train):
    ws = Workspace(spark)
    two = train.filter("y < 2")
    matched = ws.table(classifier.transform(two).select("tid", F.col("label_code").alias("y"), "pids", "prediction"), "matched")
    args = (matched, classifier.classifier, classifier.patterns.patterns, ["tid"], ws, classifier.patterns.n_patterns)
    got = {r["pid"]: r["mean"] for r in explain.permutation_importance(*args, repeats=2, top=1000, one_task_rows=0).collect()}
    spread = matched.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("rep"))
    order = spread.withColumn("h", F.md5(F.concat_ws(":", "tid", "rep", F.lit("0")).cast("binary"))).orderBy("rep", "h", "tid").collect()
    weights, bias = classifier.coefficients(), classifier.classifier.intercept
    expected = dict.fromkeys(got, 0.0)
    for rep in (1, 2):
        rows = [r for r in order if r["rep"] == rep]
        for i, r in enumerate(rows):
            own, other = set(r["pids"]), set(rows[(i + 1) % len(rows)]["pids"])
            margin = bias + sum(weights[p] for p in own)
            for p in own ^ other:
                moved = margin + (-weights[p] if p in own else weights[p])
                change = int((margin > 0) == (r["y"] == 1)) - int((moved > 0) == (r["y"] == 1))
                expected[p] += change / len(rows) / 2
    assert got.keys() == expected.keys()
    assert all(abs(got[p] - expected[p]) < 1e-12 for p in got)


def test_permutation_importance_writes_no_row_for_each_repeat(spark, classifier):
    ws, written = Workspace(spark), []
    table = ws.table

    def counted(df, name):
        out = table(df, name)
        written.append(out.count())
        return out

    ws.table = counted
    rows = spark.range(3000).selectExpr("id as tid", "cast(id % 2 as int) as y", "array(cast(id % 3 as int)) as pids")
    args = (rows, classifier.classifier, classifier.patterns.patterns, ["tid"], ws, classifier.patterns.n_patterns)
    assert explain.permutation_importance(*args, repeats=4, top=3).count() == 3
    assert max(written) == 3000


def test_metric_vector_of_a_perfect_score(spark):
    df = spark.createDataFrame([(i, int(i > 5), int(i > 5), [1 - i / 10, i / 10]) for i in range(10)], "tid int, y int, prediction int, probability array<double>")
    row = metrics.metric_vector(df, Workspace(spark)).first()
    assert (row["accuracy"], row["f1"], row["auc"], row["h"]) == (1.0, 1.0, 1.0, 1.0)


def test_h_measure_of_a_useless_score_is_zero(spark):
    df = spark.createDataFrame([(i % 2, 0.5) for i in range(40)], "y int, score double")
    assert abs(metrics.h_measure(df, Workspace(spark)).first()[0]) < 1e-12


def test_no_rows_above_threshold(spark):
    df = spark.createDataFrame([(1, 1, 1, [0.4, 0.6])], "tid int, y int, prediction int, probability array<double>")
    with pytest.raises(ValueError, match="reaches"):
        explain.rows_of_class_above(df, ["tid"], 1, 0.9)


def test_hull_survives_the_chord_filter(spark):
    rng = random.Random(5)
    counts = spark.createDataFrame([(1, rng.random(), rng.randint(0, 3), rng.randint(0, 3)) for _ in range(3000)], "cls int, score double, n1 int, n0 int")
    points, x, y = [], 0, 0
    for r in sorted(counts.collect(), key=lambda r: r["score"]):
        x, y = x + r["n1"], y + r["n0"]
        points.append((1, x, y))
    df = spark.createDataFrame(points, "cls bigint, cum1 bigint, cum0 bigint").distinct()
    left = df.withColumn("_part", F.lit(0))
    for _ in range(metrics.CHORD_ROUNDS):
        left = metrics.above_chords(left)
    kept = sorted((r["cum1"], r["cum0"]) for r in left.collect())
    assert len(kept) < len(points) / 4
    assert metrics._hull(kept) == metrics._hull(sorted({p[1:] for p in points}))
    assert abs(metrics.h_by_class(df).first()["h"] - metrics.h_from_hull([p[1:] for p in points], x, y)) < 1e-12


def test_many_classes_are_refused_unless_asked_for(spark):
    df = spark.range(1500).selectExpr("id as y")
    with pytest.raises(ValueError, match="max_classes"):
        prep.label_codes(df, "y")
    assert prep.label_codes(df, "y", max_classes=2000).count() == 1500


def test_workspace_goes_when_closed(spark):
    with Workspace(spark) as ws:
        ws.table(spark.range(3), "t")
        assert os.path.isdir(ws.path.removeprefix("file:"))
    assert not os.path.isdir(ws.path.removeprefix("file:"))


def test_anchors_are_balanced_and_the_plan_does_not_hold_the_items(spark):
    patterns = [(p, [1, 2 + p % 50]) for p in range(200)]
    support = {1: 10, **{i: 12 for i in range(2, 52)}}
    filed = {}
    for _, its in matching.balanced_anchors(patterns, support):
        filed[its[0]] = filed.get(its[0], 0) + 1
    assert max(support[i] * n for i, n in filed.items()) <= 60  # all 200 under the rarest item would be 2000
    rows = [(i, f"c{i % 900}", int(i % 900 < 40)) for i in range(1800)]
    df = spark.createDataFrame(rows, "tid bigint, c string, y int")
    few, many = (PatternMiner(label="y", keys=["tid"], top_k=20).fit(df.where(f"substr(c, 2) < {n}")) for n in (90, 900))
    sizes = [len(m.match(df)._jdf.queryExecution().analyzed().toString()) for m in (few, many)]
    assert sizes[1] < 1.5 * sizes[0]
    pids = many.match(df).select("tid", "pids")
    joined = replace(many, inline_patterns=0).match(df).select("tid", "pids")
    assert sorted(map(tuple, pids.collect())) == sorted(map(tuple, joined.collect()))
