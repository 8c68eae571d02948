"""Cleaning, imputation, column groups, label codes and the train/test split."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gainsieve.functions.names import free
from gainsieve.operators.order_stats import median
from gainsieve.operators.running import numbered
from gainsieve.sources.local import local_frame
from gainsieve.sources.workspace import Workspace

INT_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOAT_TYPES = (T.FloatType, T.DoubleType, T.DecimalType)
STRING_TYPES = (T.StringType, T.BooleanType)
MAX_CLASSES = 1000  # default of the parameter max_classes
CONDENSED = "Other"  # fixed value


@dataclass(frozen=True)
class FeatureGroups:
    """Feature columns by type, in the order int, float, string."""

    ints: list[str]
    floats: list[str]
    cats: list[str]

    @property
    def ordered(self) -> list[str]:
        return [*self.ints, *self.floats, *self.cats]

    def positions(self) -> tuple[list[int], list[int], list[int]]:
        a, b = len(self.ints), len(self.ints) + len(self.floats)
        return list(range(a)), list(range(a, b)), list(range(b, len(self.ordered)))


def q(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def feature_groups(df: DataFrame, features: list[str] | None = None, exclude: list[str] | None = None) -> FeatureGroups:
    """Group columns by type. Booleans are categories; dates and nested types have to be cast first."""
    skip = set(exclude or [])
    names = [c for c in (features or df.columns) if c not in skip]
    groups = FeatureGroups([], [], [])
    for c in names:
        t = df.schema[c].dataType
        if isinstance(t, INT_TYPES):
            groups.ints.append(c)
        elif isinstance(t, FLOAT_TYPES):
            groups.floats.append(c)
        elif isinstance(t, STRING_TYPES):
            groups.cats.append(c)
        else:
            raise TypeError(f"column {c} has type {t.simpleString()}; cast it to a number or a string")
    return groups


def ordered_features(df: DataFrame, groups: FeatureGroups, keep: list[str] | None = None) -> DataFrame:
    return df.select(*[q(c) for c in (keep or [])], *[q(c) for c in groups.ordered])


def split_target(df: DataFrame, target: str | None = None) -> tuple[list[str], DataFrame]:
    """Feature names and the frame with the target: the last column, or a named one cast to string."""
    if target is None:
        return df.columns[:-1], df
    if not isinstance(df.schema[target].dataType, T.StringType):
        df = df.withColumn(target, q(target).cast("string"))
    return [c for c in df.columns if c != target], df


def _is_missing(df: DataFrame, c: str) -> Column:
    if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)):
        return q(c).isNull() | F.isnan(q(c))
    return q(c).isNull()


def missing_ratio(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(col, missing, ratio): missing values per column in one aggregate, ratio in percent."""
    columns = columns or df.columns
    aggs = [F.count_if(_is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(columns)]
    row = df.agg(F.count("*").alias("n"), *aggs)
    cells = [F.struct(F.lit(c).alias("col"), F.col(f"m{i}").alias("missing")) for i, c in enumerate(columns)]
    long = row.select("n", F.explode(F.array(*cells)).alias("s")).select("n", "s.*")
    ratio = F.when(F.col("n") > 0, F.col("missing") * F.lit(100.0) / F.col("n")).otherwise(F.lit(0.0))
    return long.select("col", "missing", ratio.alias("ratio"))


def drop_sparse_columns(df: DataFrame, limit: float = 60.0) -> DataFrame:
    """Drop columns with more than ``limit`` percent missing."""
    sparse = [r["col"] for r in missing_ratio(df).filter(F.col("ratio") > F.lit(limit)).collect()]
    return df.drop(*sparse)


def reject_missing(df: DataFrame, columns: list[str]) -> None:
    bad = [r["col"] for r in missing_ratio(df, columns).filter("missing > 0").collect()]
    if bad:
        raise ValueError(f"null or NaN in feature columns {bad}; impute or drop them first")


def all_strings(df: DataFrame) -> DataFrame:
    """Cast every column to string; null stays null."""
    return df.select(*[q(c).cast("string").alias(c) for c in df.columns])


def all_doubles(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: q(c).cast("double") for c in columns})


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(col, value, n) of string columns, null left out."""
    cells = [F.struct(F.lit(c).alias("col"), q(c).cast("string").alias("value")) for c in columns]
    long = df.select(F.explode(F.array(*cells)).alias("s")).select("s.*").filter(F.col("value").isNotNull())
    return long.groupBy("col", "value").agg(F.count("*").alias("n"))


def largest_categories(df: DataFrame, columns: list[str], n: int = 5) -> DataFrame:
    """(col, value, n, rn): the n most frequent values per column, ties by value descending.

    The row_number limit is pushed below the shuffle, so a column with very many
    values sends only n of them per task.
    """
    w = Window.partitionBy("col").orderBy(F.desc("n"), F.desc("value"))
    return value_counts(df, columns).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


def condense_categories(df: DataFrame, columns: list[str], n: int = 5) -> DataFrame:
    """Keep the n most frequent values of each column, everything else becomes 'Other'."""
    kept: dict[str, list[str]] = {c: [] for c in columns}
    for r in largest_categories(df, columns, n).collect():  # n rows per column
        kept[r["col"]].append(r["value"])
    return df.withColumns(
        {c: F.when(q(c).cast("string").isin(kept[c]), q(c).cast("string")).otherwise(F.lit(CONDENSED)) for c in columns}
    )


def modes(df: DataFrame, columns: list[str]) -> dict[str, str | None]:
    """Most frequent value per column, the smallest on ties, null left out."""
    w = Window.partitionBy("col").orderBy(F.desc("n"), F.col("value"))
    top = value_counts(df, columns).withColumn("rn", F.row_number().over(w)).filter("rn = 1").collect()
    found = {r["col"]: r["value"] for r in top}
    return {c: found.get(c) for c in columns}


def impute_mode(df: DataFrame, columns: list[str]) -> DataFrame:
    found = modes(df, columns)
    return df.withColumns({c: F.coalesce(q(c), F.lit(found[c])) for c in columns})


def replace_marker(
    df: DataFrame, columns: list[str], marker: str = "unknown", forced: dict[str, str] | None = None
) -> DataFrame:
    """Replace a marker by the column's mode (the marker itself counts), or by a forced value."""
    found = {**modes(df, columns), **(forced or {})}
    return df.withColumns({c: F.when(q(c) == marker, F.lit(found[c])).otherwise(q(c)) for c in columns})


def impute_median(df: DataFrame, columns: list[str], ws: Workspace, **options) -> DataFrame:
    found = median(df, columns, ws, **options)
    return _fill_numeric(df, found)


def impute_mean(df: DataFrame, columns: list[str]) -> DataFrame:
    aggs = [F.avg(F.when(~F.isnan(q(c).cast("double")), q(c).cast("double"))).alias(f"a{i}") for i, c in enumerate(columns)]
    row = df.agg(*aggs).first()
    return _fill_numeric(df, {c: row[f"a{i}"] for i, c in enumerate(columns)})


def _fill_numeric(df: DataFrame, values: dict[str, float | None]) -> DataFrame:
    out = {}
    for c, v in values.items():
        if v is not None:
            whole = isinstance(df.schema[c].dataType, INT_TYPES) and float(v).is_integer()
            fill = F.lit(v).cast(df.schema[c].dataType) if whole else F.lit(float(v))
            out[c] = F.when(_is_missing(df, c), fill).otherwise(q(c))
    return df.withColumns(out)


def drop_sentinel_rows(df: DataFrame, column: str, sentinel) -> DataFrame:
    return df.filter(q(column) != F.lit(sentinel))


def replace_sentinels(df: DataFrame, columns: list[str], sentinels: list, ws: Workspace, **options) -> DataFrame:
    """Replace sentinel values by the column median, which includes the sentinels."""
    found = median(df, columns, ws, **options)
    return df.withColumns({c: F.when(q(c).isin(sentinels), F.lit(found[c])).otherwise(q(c)) for c in columns})


def negative_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """(col, has_negative) per column."""
    row = df.agg(*[F.coalesce(F.bool_or(q(c) < 0), F.lit(False)).alias(f"b{i}") for i, c in enumerate(columns)])
    cells = [F.struct(F.lit(c).alias("col"), F.col(f"b{i}").alias("has_negative")) for i, c in enumerate(columns)]
    return row.select(F.explode(F.array(*cells)).alias("s")).select("s.*")


def log1p(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.log1p(q(column)))


def row_sum(df: DataFrame, columns: list[str], out: str) -> DataFrame:
    total = q(columns[0])
    for c in columns[1:]:
        total = total + q(c)
    return df.withColumn(out, total)


def label_codes(df: DataFrame, label: str, max_classes: int = MAX_CLASSES) -> DataFrame:
    """(label, y, n): code 0 for the most frequent class, ties in label order.

    ``max_classes`` guards against a column that is no label: class counts are columns, and so parts of every plan.
    """
    counts = df.filter(q(label).isNotNull()).groupBy(q(label).alias("label")).agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "label").limit(max_classes + 1).collect()
    if len(top) > max_classes:
        raise ValueError(f"label {label} has more than {max_classes} classes; raise max_classes if it is one")
    kind = df.schema[label].dataType.simpleString()
    return local_frame(df.sparkSession, [(r["label"], i, r["n"]) for i, r in enumerate(top)], f"label {kind}, y int, n bigint")


def encode_label(df: DataFrame, label: str, codes: DataFrame, out: str = "y") -> DataFrame:
    """Join the class code. Unknown labels get NULL. The dictionary is a local table, broadcast if Spark finds it small."""
    (own,) = free(df.columns, "_label")
    keys = codes.select(F.col("label").alias(own), F.col("y").alias(out))
    return df.join(keys, q(label) == F.col(own), "left").drop(own)


def decode_label(df: DataFrame, code: str, codes: DataFrame, out: str = "label") -> DataFrame:
    (own,) = free(df.columns, "_y")
    keys = codes.select(F.col("y").alias(own), F.col("label").alias(out))
    return df.join(keys, q(code).cast("int") == F.col(own), "left").drop(own)


def regression_target(df: DataFrame, label: str, out: str = "y") -> DataFrame:
    return df.withColumn(out, q(label).cast("double"))


def data_profile(df: DataFrame, groups: FeatureGroups, y: str) -> DataFrame:
    """(metric, name, value): rows, feature counts per type group, and class sizes."""
    fixed = [
        ("features", "int", len(groups.ints)),
        ("features", "float", len(groups.floats)),
        ("features", "string", len(groups.cats)),
    ]
    sizes = df.groupBy(q(y).cast("string").alias("name")).agg(F.count("*").alias("value"))
    classes = sizes.select(F.lit("class").alias("metric"), "name", "value")
    rows = classes.groupBy().agg(F.sum("value").alias("value"))
    rows = rows.select(F.lit("rows").alias("metric"), F.lit("all").alias("name"), F.coalesce("value", F.lit(0)).alias("value"))
    spark = df.sparkSession
    return classes.unionByName(rows).unionByName(local_frame(spark, fixed, "metric string, name string, value bigint"))


def prepare(df: DataFrame, label: str, features: list[str] | None = None, keys: list[str] | None = None):
    """(prepared frame, groups, label dictionary): columns ordered int, float, string, plus keys and code y."""
    keys = keys or []
    groups = feature_groups(df, features, exclude=[label, *keys])
    codes = label_codes(df, label)
    coded = encode_label(df, label, codes)
    return ordered_features(coded, groups, [*keys, "y"]), groups, codes


def stratified_split(
    df: DataFrame,
    y: str,
    keys: list[str],
    ws: Workspace,
    test_share: float = 0.2,
    seed: int = 0,
    order: list[Column] | None = None,
) -> DataFrame:
    """Add ``is_test``: exactly round(share x class size) rows of each class, chosen by a seeded key hash.

    ``keys`` identify a row. Rows without a label are split as a class of their own. Row numbers come from range partitions with offsets, so a
    huge class is never ranked by one task.
    """
    h, rn, own, n = free(df.columns, "_h", "_rn", "_y", "_n")
    base = df.withColumn(h, F.xxhash64(*[q(k) for k in keys], F.lit(seed)))
    by = order or [F.col(h), *[q(k) for k in keys]]
    ranked = numbered(base, by, ws, rn, groups=[y])
    sizes = df.groupBy(q(y).alias(own)).agg(F.count("*").alias(n))
    joined = ranked.join(sizes, q(y).eqNullSafe(F.col(own)))
    quota = F.floor(F.col(n) * F.lit(test_share) + F.lit(0.5))
    return joined.withColumn("is_test", F.col(rn) <= quota).drop(h, rn, own, n)
