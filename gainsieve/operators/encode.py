"""Quantile bins for numeric columns, dictionaries for categories, auto bin counts."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gainsieve.functions import scores
from gainsieve.functions.names import free
from gainsieve.operators.lookups import heavy_labels, looked_up
from gainsieve.operators.order_stats import MAX_DISTINCT, attach_values, bucketized, order_statistics, profile_columns, profile_numeric
from gainsieve.operators.running import numbered
from gainsieve.sources.local import local_frame
from gainsieve.sources.workspace import Workspace

AUTO_BINS = range(2, 21)  # fixed value: candidate bin counts


@dataclass
class NumericColumn:
    """Fitted parameters of one numeric column; ``edges`` is empty for a constant column."""

    name: str
    kind: str  # "int" or "float"
    minimum: float
    maximum: float
    edges: list[float]

    @property
    def bins(self) -> int:
        return max(len(self.edges) - 1, 0)

    def right_edges(self) -> list[float]:
        """Right edge / largest edge: raw units for int, min-max scaled units for float.

        A largest edge of 0 gives no ratio, hence no item.
        """
        if self.bins == 0:
            return []
        if self.kind == "float":
            span = scale_span(self.minimum, self.maximum)
            scaled = [(e - self.minimum) / span for e in self.edges]
        else:
            scaled = self.edges
        top = max(scaled)
        return [e / top for e in scaled[1:]] if top != 0 else [0.0] * self.bins


def scale_span(minimum: float, maximum: float) -> float:
    return (maximum - minimum) if maximum != minimum else 1.0


def minmax_scale(df: DataFrame, columns: list[str], params: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Min-max scale columns; returns (scaled frame, params(col, min, max)). max = min + 1 for a constant."""
    spark = df.sparkSession
    if params is None:
        profile = profile_numeric(df, columns)
        rows = [(c, p["min"], p["max"] if p["max"] != p["min"] else p["min"] + 1.0) for c, p in profile.items()]
        params = local_frame(spark, rows, "col string, min double, max double")
    fitted = {r["col"]: (r["min"], r["max"]) for r in params.collect()}
    scaled = df.withColumns(
        {c: (F.col(f"`{c}`").cast("double") - F.lit(fitted[c][0])) / F.lit(fitted[c][1] - fitted[c][0]) for c in columns}
    )
    return scaled, params


def minmax_inverse(value: Column, minimum: float, maximum: float) -> Column:
    return value * F.lit(scale_span(minimum, maximum)) + F.lit(minimum)


def quantile_ranks(n: int, bins: int) -> list[int]:
    """0-based ranks ceil(p / 100 * (n - 1)) with p = float32(q * 100 / bins), q = 0..bins."""
    ranks = []
    for q in range(bins + 1):
        p = float(np.float32(q * 100.0 / bins))
        ranks.append(min(math.ceil(p / 100.0 * (n - 1)), n - 1))
    return ranks


def distinct_edges(values: list[float]) -> list[float]:
    return sorted(set(v + 0.0 for v in values))


def quantile_edges(
    df: DataFrame, columns: list[str], bins: int | dict[str, int], ws: Workspace, profile: dict | None = None, stats: dict | None = None, **options
) -> dict[str, list[float]]:
    """Quantile edges per column: order statistics without interpolation, repeated edges dropped. ``stats``: those known already."""
    profile = profile or profile_numeric(df, columns)
    per_column = bins if isinstance(bins, dict) else {c: bins for c in columns}
    ranks = {c: quantile_ranks(profile[c]["n"], per_column[c]) for c in columns if profile[c]["n"]}
    stats = stats or {}
    left = {c: rs for c, rs in ranks.items() if not set(rs) <= set(stats.get(c, {}))}
    stats = {**stats, **(order_statistics(df, left, profile, ws, **options) if left else {})}
    return {c: distinct_edges([stats[c][r] for r in ranks[c]]) for c in ranks}


def exact_distinct(df: DataFrame, columns: list[str]) -> DataFrame:
    """(col, n_distinct) per column, counted by grouping (col, value) so that no task holds a column."""
    cells = [F.struct(F.lit(c).alias("col"), F.col(f"`{c}`").cast("string").alias("v")) for c in columns]
    long = df.select(F.explode(F.array(*cells)).alias("s")).select("s.*")
    return long.filter(F.col("v").isNotNull()).distinct().groupBy("col").agg(F.count("*").alias("n_distinct"))


def clamp_bins(bins: int, distinct: int | Column):
    """No more bins than distinct values less one, and two at least; for a number or a column of numbers."""
    if isinstance(distinct, Column):
        return F.greatest(F.least(distinct - 1, F.lit(bins)), F.lit(2)).cast("int")
    return max(min(distinct - 1, bins), 2)


def clamped_bins(df: DataFrame, columns: list[str], bins: int) -> DataFrame:
    """(col, nb): the number of bins each column gets."""
    return exact_distinct(df, columns).select("col", clamp_bins(bins, F.col("n_distinct")).alias("nb"))


def auto_order_statistics(df: DataFrame, columns: list[str], ws: Workspace, profile: dict, **options) -> dict[str, dict[int, float]]:
    """The order statistics that the edges of all bin counts 2..20 need, searched once."""
    ranks = {c: sorted({r for nb in AUTO_BINS for r in quantile_ranks(profile[c]["n"], nb)}) for c in columns if profile[c]["n"]}
    return order_statistics(df, ranks, profile, ws, **options)


def auto_bin_scores(
    df: DataFrame, columns: list[str], y: str, n_classes: int, ws: Workspace, profile: dict | None = None, stats: dict | None = None, **options
) -> DataFrame:
    """(col, nb, gain) for nb = 2..20: information gain of the binned column, rounded to 6.

    One scan counts classes in the cells between all candidate edges; every candidate
    binning is then a regrouping of those few cells.
    """
    spark = df.sparkSession
    profile = profile or profile_numeric(df, columns)
    columns = [c for c in columns if profile[c]["n"]]
    stats = stats or auto_order_statistics(df, columns, ws, profile, **options)
    cuts = {c: distinct_edges(list(stats[c].values())) for c in columns}
    plain = {c: f"v{i}" for i, c in enumerate(columns)}
    data = df.select(y, *[F.col(f"`{c}`").cast("double").alias(v) for c, v in plain.items()])
    cut = bucketized(data, {plain[c]: cuts[c] for c in columns}, "__cell")
    cells = [F.struct(F.lit(c).alias("col"), F.col(f"{plain[c]}__cell").alias("cell")) for c in columns]
    per_cell = (
        cut.select(y, F.explode(F.array(*cells)).alias("s"))
        .groupBy("s.col", "s.cell")
        .agg(*scores.class_count_columns(y, n_classes))
    )
    per_cell = ws.table(per_cell, "auto-cells")

    regroup = []
    for c in columns:
        for nb in AUTO_BINS:
            edges = distinct_edges([stats[c][r] for r in quantile_ranks(profile[c]["n"], nb)])
            for cell in range(len(cuts[c]) + 2):
                at_or_below = 0 if cell == 0 else sum(e <= cuts[c][cell - 1] for e in edges) if cell <= len(cuts[c]) else len(edges)
                regroup.append((c, nb, cell, len(edges) if at_or_below == 0 else at_or_below))
    mapping = local_frame(spark, regroup, "col string, nb int, cell int, bin int")
    binned = (
        per_cell.join(mapping, ["col", "cell"])
        .groupBy("col", "nb", "bin")
        .agg(*scores.sum_class_counts(n_classes))
        .withColumn("cls", scores.class_array(n_classes))
    )
    totals = [F.sum(f"c{j}").alias(f"t{j}") for j in range(n_classes)]
    rows = scores.array_total("cls").cast("double")
    gain = (
        binned.withColumn("h", rows * scores.entropy("cls", n_classes))
        .groupBy("col", "nb")
        .agg(*totals, F.sum("h").alias("h"))
        .withColumn("tot", F.array(*[F.col(f"t{j}") for j in range(n_classes)]))
    )
    base = scores.entropy("tot", n_classes)
    return gain.select("col", "nb", scores.round6(base - F.col("h") / scores.array_total("tot")).alias("gain"))


def choose_bins(gains: DataFrame) -> DataFrame:
    """(col, nb): the smallest bin count with the highest positive gain, 2 if no gain is positive."""
    best = F.struct(F.greatest(F.col("gain"), F.lit(0.0)).alias("gain"), (-F.col("nb")).alias("neg"))
    return gains.groupBy("col").agg(F.max(best).alias("b")).select("col", (-F.col("b.neg")).cast("int").alias("nb"))


def fit_numeric(
    df: DataFrame, ints: list[str], floats: list[str], bins: int, y: str, n_classes: int, ws: Workspace,
    cats: list[str] | None = None, **options,
) -> list[NumericColumn]:
    """Fit edges of every numeric column; ``bins = -1`` picks the count per column by gain.

    Missing values are rejected, in ``cats`` too, from the same scan that profiles the columns.
    """
    columns = [*ints, *floats]
    profile, nulls = profile_columns(df, columns, cats or [])
    missing = [c for c in columns if profile[c]["missing"]] + [c for c, n in nulls.items() if n]
    if missing:
        raise ValueError(f"null or NaN in feature columns {missing}; impute or drop them first")
    infinite = [c for c in columns if profile[c]["n"] and (math.isinf(profile[c]["min"]) or math.isinf(profile[c]["max"]))]
    if infinite:
        raise ValueError(f"infinite values in feature columns {infinite}; replace or drop them first")
    if not columns:
        return []
    attach_values(df, profile)  # makes small distinct counts exact
    stats = None
    if bins == -1:
        stats = auto_order_statistics(df, columns, ws, profile, **options)
        chosen = {r["col"]: r["nb"] for r in choose_bins(auto_bin_scores(df, columns, y, n_classes, ws, profile, stats, **options)).collect()}
    else:
        chosen = {c: bins for c in columns}
    # a large count is a sketch's, some hundredths off: where it may bind the clamp, the values are counted
    near = [c for c in columns if "values" not in profile[c] and profile[c]["distinct"] < 2 * (chosen[c] + 1)]
    if near:
        # + 0.0: the two zeros are one value
        counted = exact_distinct(df.select(*[(F.col(f"`{c}`").cast("double") + F.lit(0.0)).alias(c) for c in near]), near)
        for r in counted.collect():
            profile[r["col"]]["distinct"] = r["n_distinct"]
    chosen = {c: clamp_bins(chosen[c], profile[c]["distinct"]) for c in columns}
    edges = quantile_edges(df, columns, chosen, ws, profile, stats, **options)
    return [
        NumericColumn(
            c,
            "int" if c in set(ints) else "float",
            profile[c]["min"],
            profile[c]["max"],
            edges[c] if profile[c]["min"] != profile[c]["max"] else [],
        )
        for c in columns
    ]


def assign_bins(df: DataFrame, numeric: list[NumericColumn], prefix: str = "b_") -> DataFrame:
    """Add ``b_0, b_1, ...`` (in the order of ``numeric``): bin 1..nb, anything else nb + 1.

    The maximum, values outside the fitted range, NaN and NULL all get nb + 1.
    """
    used = {i: c for i, c in enumerate(numeric) if c.bins}
    work = df.withColumns({f"{prefix}{i}__v": F.col(f"`{c.name}`").cast("double") for i, c in used.items()})
    work = bucketized(work, {f"{prefix}{i}__v": c.edges for i, c in used.items()}, "__k")
    out = {}
    for i, c in enumerate(numeric):
        if c.bins:
            k = F.col(f"{prefix}{i}__v__k")
            out[f"{prefix}{i}"] = F.when(k.between(1, c.bins), k).otherwise(F.lit(c.bins + 1))
        else:
            out[f"{prefix}{i}"] = F.lit(1)
    drop = [f"{prefix}{i}__v" for i in used] + [f"{prefix}{i}__v__k" for i in used]
    return work.withColumns(out).drop(*drop)


def category_dictionary(df: DataFrame, columns: list[str], ws: Workspace) -> DataFrame:
    """(col, label, idx): distinct trimmed labels of each column, 1..m in label order."""
    cells = [F.struct(F.lit(c).alias("col"), F.trim(F.col(f"`{c}`").cast("string")).alias("label")) for c in columns]
    labels = df.select(F.explode(F.array(*cells)).alias("s")).select("s.*").filter(F.col("label").isNotNull()).distinct()
    return numbered(labels, [F.col("label")], ws, "idx", groups=["col"]).withColumn("idx", F.col("idx").cast("int"))


def category_lookup(df: DataFrame, column: str, dictionary: DataFrame, out: str, heavy: list[str] | None = None) -> DataFrame:
    """Index of the trimmed label; unseen and NULL labels get -1.

    ``heavy``: labels of many rows, which are looked up without a join; found by counting unless given, but not on a stream.
    """
    own = dictionary.filter(F.col("col") == column).select("label", "idx")
    if heavy is None:
        heavy = [] if df.isStreaming else heavy_labels(df, [column])[column]
    found = {r["label"]: r["idx"] for r in own.filter(F.col("label").isin(heavy)).collect()} if heavy else {}
    known = [{"label": v, "idx": found.get(v, -1)} for v in heavy]  # an unseen label may be heavy too
    label, place = free(df.columns, "_own_label", "_found")
    work = df.withColumn(label, F.trim(F.col(f"`{column}`").cast("string")))
    work = looked_up(work, label, own, {"idx": "int"}, known, place)
    return work.withColumn(out, F.coalesce(F.col(f"{place}.idx"), F.lit(-1))).drop(label, place)


def category_indicators(df: DataFrame, column: str, dictionary: DataFrame, keys: list[str], dense: bool = False) -> DataFrame:
    """(keys, label, is_label): the 0/1 indicators of a category column.

    Sparse by default: only ones, a row for each row whose trimmed label the dictionary (col, label, idx) holds. ``dense`` adds
    the zeros, so there are rows times labels; the labels are sent along with every row, from a dictionary of any number of labels.
    """
    label = F.trim(F.col(f"`{column}`").cast("string"))
    own = dictionary.filter(F.col("col") == column)
    if not dense:
        return df.select(*keys, label.alias("label")).join(own.select("label"), "label").select(*keys, "label", F.lit(1).alias("is_label"))
    listed = own.groupBy("col").agg(F.array_sort(F.collect_list("label")).alias("labels"))
    rows = df.select(*keys, label.alias("_own"), F.lit(column).alias("col")).join(listed, "col")
    return rows.select(*keys, "_own", F.explode("labels").alias("label")).select(*keys, "label", F.coalesce((F.col("label") == F.col("_own")).cast("int"), F.lit(0)).alias("is_label"))


def bin_ranges(spark, numeric: list[NumericColumn]) -> DataFrame:
    """(col, bin, lo, hi): the original-unit range of each bin."""
    rows = [(c.name, i + 1, c.edges[i], c.edges[i + 1]) for c in numeric for i in range(c.bins)]
    return local_frame(spark, rows, "col string, bin int, lo double, hi double")
