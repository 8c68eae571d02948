"""User columns that have the names of the library's helpers, and saved estimators."""

from dataclasses import replace

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from gainsieve import PatternClassifier, PatternClassifierModel, PatternMiner
from gainsieve.functions.names import free
from gainsieve.operators import encode, prep
from gainsieve.sources.workspace import Workspace
from tests.test_mining import random_rows

SCHEMA = "tid bigint, a int, b double, c string, d string, y int"
#: Features and carried columns named like helpers; a is numeric and takes the name of a label, c that of a bin.
ODD = {"a": "l_0", "b": "_y", "c": "b_0", "d": "L_1"}
CARRIED = ["b_1", "_index", "_set", "_known", "_first0", "_filed0", "_item0", "_slot", "_terms", "_label", "_sum", "_code", "own0"]


@pytest.fixture(scope="module")
def plain(spark):
    return spark.createDataFrame(random_rows(11, 200), SCHEMA)


@pytest.fixture(scope="module")
def odd(plain):
    return plain.withColumnsRenamed(ODD).select("*", *[F.concat(F.lit(f"{c} of "), F.col("tid")).alias(c) for c in CARRIED])


def test_free_names_differ_in_any_case():
    assert free(["A", "_h", "_h_"], "a", "_h", "b", "b") == ["a_", "_h__", "b", "b_"]


@pytest.fixture(scope="module")
def models(plain, odd):
    return [PatternMiner(label="y", keys=["tid"], features=list(f), bins=4, length=2).fit(df) for df, f in ((plain, ODD), (odd, ODD.values()))]


def test_features_named_like_helpers_give_the_same_patterns(models):
    was, now = models
    assert was.n_patterns == now.n_patterns > 0
    expected = [[f"{ODD[n.split('=')[0]]}={n.split('=', 1)[1]}" for n in r["names"]] for r in was.patterns.orderBy("pid").collect()]
    assert [list(r["names"]) for r in now.patterns.orderBy("pid").collect()] == expected


@pytest.mark.parametrize("inline", [5000, 0])
def test_matching_keeps_columns_named_like_helpers(plain, odd, models, inline):
    was, now = models[0], replace(models[1], inline_patterns=inline)
    out = now.transform(odd)
    assert out.columns == [*odd.columns, "item_ids", "pids", "features"]
    assert sorted(map(str, out.select(odd.columns).collect())) == sorted(map(str, odd.collect()))
    expected = {r["tid"]: (r["item_ids"], r["pids"]) for r in was.match(plain).collect()}
    assert {r["tid"]: (r["item_ids"], r["pids"]) for r in out.collect()} == expected


def test_labels_split_and_lookup_keep_columns_named_like_helpers(spark):
    df = spark.createDataFrame([(i, f"c{i % 3}", i % 2, i, i, i, i, i, i) for i in range(20)], "k int, c string, y int, _label int, _y int, _h int, _rn int, _n int, _found int")
    codes = prep.label_codes(df, "y")
    coded = prep.decode_label(prep.encode_label(df, "y", codes, "code"), "code", codes, "back")
    split = prep.stratified_split(coded, "y", ["k"], Workspace(spark))
    looked = encode.category_lookup(split, "c", encode.category_dictionary(df, ["c"], Workspace(spark)), "idx")
    assert looked.columns == [*df.columns, "code", "back", "is_test", "idx"]
    for r in looked.collect():
        assert r["back"] == r["y"] and r["idx"] == 1 + r["k"] % 3 and {r[c] for c in ("_label", "_y", "_h", "_rn", "_n", "_found")} == {r["k"]}


def scores_of(df):
    return sorted((r["tid"], r["prediction"], [round(p, 12) for p in r["probability"]]) for r in df.select("tid", "prediction", "probability").collect())


def test_pipelines_with_the_estimator_and_its_model_are_saved(spark, plain):
    ws = Workspace(spark)
    base = LogisticRegression(regParam=0.01, maxIter=20)
    est = PatternClassifier(labelCol="lab", features=["a", "b", "c", "d"], bins=4, length=2, classWeights=[1, 2, 3], base_estimator=base)
    both = Pipeline(stages=[SQLTransformer(statement="SELECT *, y AS lab FROM __THIS__"), est])
    both.save(path := ws.new_path("estimator"))
    back = Pipeline.load(path)
    own = back.getStages()[1]
    assert own.uid == est.uid and own.getOrDefault("classWeights") == [1, 2, 3] and own.base_estimator.getRegParam() == 0.01
    assert {p.name: v for p, v in own.extractParamMap().items()} == {p.name: v for p, v in est.extractParamMap().items()}
    model = back.fit(plain)
    expected = scores_of(model.transform(plain))
    model.save(path := ws.new_path("model"))
    assert scores_of(PipelineModel.load(path).transform(plain)) == expected
    model.write().overwrite().save(path)
    assert scores_of(PatternClassifierModel.load(f"{path}/stages/1_{model.stages[1].uid}").transform(plain.withColumn("lab", F.col("y")))) == expected


def test_a_function_as_base_cannot_be_saved(spark):
    est = PatternClassifier(labelCol="y", base_estimator=lambda rows, classes: LogisticRegression())
    with pytest.raises(ValueError, match="saved"):
        est.save(Workspace(spark).new_path("estimator"))
    PatternClassifier(labelCol="y").save(path := Workspace(spark).new_path("estimator"))
    assert PatternClassifier.load(path).base_estimator is None
