"""Delimited files, named dataset recipes, and the tables a fit reads and writes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gainsieve.operators import apply as matching
from gainsieve.operators import prep
from gainsieve.sources.local import local_frame
from gainsieve.sources.workspace import Workspace

READABLE = (".csv", ".data", ".gz")


def read_delimited(
    spark: SparkSession,
    path: str,
    sep: str = ",",
    header: bool = True,
    names: list[str] | None = None,
    schema: str | None = None,
) -> DataFrame:
    """Read delimited text (plain or gzip). Give ``schema`` to save the pass that infers types.

    Zip archives are not splittable and have to be unpacked first.
    """
    if not any(ext in path for ext in READABLE):
        raise ValueError(f"{path}: unknown extension, expected one of {READABLE}")
    reader = spark.read.option("sep", sep).option("header", header)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    df = reader.csv(path)
    return df.toDF(*names) if names else df


def first_rows(df: DataFrame, n: int, order: list[Column] | None = None) -> DataFrame:
    """The first n rows; give an order for a result that does not depend on the partitions."""
    return df.orderBy(*order).limit(n) if order else df.limit(n)


@dataclass
class Prepared:
    """A cleaned table: features ordered int, float, string, then the label column."""

    df: DataFrame
    label: str
    groups: prep.FeatureGroups


def _finish(df: DataFrame, label: str, features: list[str] | None = None) -> Prepared:
    groups = prep.feature_groups(df, features, exclude=[label])
    return Prepared(df.select(*[prep.q(c) for c in groups.ordered], prep.q(label)), label, groups)


def load_table(
    df: DataFrame,
    ws: Workspace,
    target: str | None = None,
    drop: list[str] | None = None,
    as_strings: bool = False,
    condense: bool = False,
) -> Prepared:
    """Clean any table: drop columns, drop columns over 60 % missing, condense, impute mode and median."""
    data = df.drop(*(drop or []))
    data = prep.drop_sparse_columns(data)
    if as_strings:
        data = prep.all_strings(data)
    features, data = prep.split_target(data, target)
    label = target or data.columns[-1]
    groups = prep.feature_groups(data, features)
    if condense and groups.cats:
        data = prep.condense_categories(data, groups.cats)
    if groups.cats:
        data = prep.impute_mode(data, groups.cats)
    if groups.ints or groups.floats:
        data = prep.impute_median(data, [*groups.ints, *groups.floats], ws)
    return _finish(data, label, features)


def iris(df: DataFrame) -> Prepared:
    """Four measurements and the class, in file order."""
    return _finish(df.toDF("sepalLength", "sepalWidth", "petalLength", "petalWidth", "class"), "class")


def bank_marketing(df: DataFrame) -> Prepared:
    """Replace the marker "unknown" by the mode ("no" for default), keep the used columns."""
    texts = [c for c in prep.feature_groups(df).cats]
    clean = prep.replace_marker(df, texts, "unknown", {"default": "no"} if "default" in texts else None)
    floats = [
        "campaign", "previous", "pdays", "emp.var.rate", "cons.price.idx", "cons.conf.idx", "euribor3m", "nr.employed",
    ]
    cats = ["job", "marital", "education", "default", "housing", "loan"]
    label = df.columns[-1]
    clean = prep.all_doubles(clean.select(*[prep.q(c) for c in ["age", *floats, *cats, label]]), floats)
    return _finish(clean, label)


def pima(df: DataFrame) -> Prepared:
    names = ["numPregnancies", "glucose", "bp", "skinThickness", "insulin", "bmi", "diabetesPedigreeFunction", "age", "class"]
    return _finish(df.toDF(*names), "class")


def heloc(df: DataFrame, ws: Workspace) -> Prepared:
    """Drop rows without a score (-9), replace -7 and -8 by the median, cast features to double."""
    label, features = df.columns[0], df.columns[1:]
    scored = prep.drop_sentinel_rows(df, "ExternalRiskEstimate", -9)
    clean = prep.replace_sentinels(scored, features[1:], [-7, -8], ws)
    return _finish(prep.all_doubles(clean, features), label)


def titanic(df: DataFrame) -> Prepared:
    """Impute, log of the fare, number of relatives, class as a category."""
    clean = prep.impute_mode(df, ["Embarked"])
    clean = prep.impute_mean(clean, ["Age", "Fare"])
    clean = prep.log1p(clean, "Fare")
    clean = prep.row_sum(clean, ["SibSp", "Parch"], "numRelatives").withColumn("Pclass", F.col("Pclass").cast("string"))
    used = ["Pclass", "Age", "Sex", "numRelatives", "Fare", "Embarked"]
    return _finish(clean.select(*used, "Survived"), "Survived")


def write_coordinates(coords: DataFrame, path: str, n_rows: int, n_patterns: int) -> None:
    """Write a sparse row x pattern matrix as (keys, pid) plus its shape."""
    coords.write.parquet(f"{path}/cells")
    shape = local_frame(coords.sparkSession, [(n_rows, n_patterns)], "n_rows bigint, n_patterns bigint")
    shape.write.parquet(f"{path}/shape")


def read_coordinates(spark: SparkSession, path: str) -> tuple[DataFrame, tuple[int, int]]:
    shape = spark.read.parquet(f"{path}/shape").first()
    return spark.read.parquet(f"{path}/cells"), (shape["n_rows"], shape["n_patterns"])


def coordinates_to_vectors(rows: DataFrame, coords: DataFrame, keys: list[str], n_patterns: int) -> DataFrame:
    """Rows with the sparse vector of their coordinates; rows without a cell get the zero vector."""
    lists = coords.groupBy(*keys).agg(F.array_sort(F.collect_list("pid")).alias("pids"))
    joined = rows.join(lists, keys, "left").withColumn("pids", F.coalesce("pids", F.array().cast("array<int>")))
    return matching.assemble_vectors(joined, n_patterns)


def write_pattern_table(patterns: DataFrame, path: str) -> None:
    """Readable pattern table: utility, pattern, ig, entropy, pure class, and the item list."""
    table = patterns.select("pid", "utility", F.col("name").alias("pattern"), "ig", "entropy", "pure_class", "items", "support")
    table.write.parquet(path)


def read_pattern_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
