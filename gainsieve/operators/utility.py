"""From encoded rows to scored items: row shapes, contingency counts, item utilities."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gainsieve.functions import scores
from gainsieve.functions.names import free
from gainsieve.operators.encode import NumericColumn, assign_bins
from gainsieve.operators.lookups import HEAVY_SHARE, looked_up
from gainsieve.operators.order_stats import kth_largest
from gainsieve.operators.running import numbered
from gainsieve.sources.local import local_frame
from gainsieve.sources.workspace import Workspace

log = logging.getLogger(__name__)

CATEGORY_NEGATIVE = 0.05  # fixed value: internal utility of a category with correlation <= 0


def encode_rows(df: DataFrame, numeric: list[NumericColumn], cats: list[str]) -> DataFrame:
    """Add ``b_i`` (bin of numeric column i) and ``l_j`` (trimmed label of category column j)."""
    labels = free(df.columns, *[f"_label{j}" for j in range(len(cats))])
    # before the bins: a category column may be called b_0
    work = df.withColumns({name: F.trim(F.col(f"`{c}`").cast("string")) for name, c in zip(labels, cats)}) if cats else df
    coded = assign_bins(work, numeric)
    return coded.withColumns({f"l_{j}": F.col(name) for j, name in enumerate(labels)}).drop(*labels) if cats else coded


def code_columns(n_numeric: int, n_cats: int) -> list[str]:
    return [f"b_{i}" for i in range(n_numeric)] + [f"l_{j}" for j in range(n_cats)]


def row_shapes(encoded: DataFrame, n_numeric: int, n_cats: int, y: str, n_classes: int) -> DataFrame:
    """Distinct coded rows with their class counts ``c0..cK-1``.

    Everything after this point depends on a row only through its codes, so mining
    works on this table. Partial aggregation collapses equal rows before the shuffle.
    """
    return encoded.groupBy(*code_columns(n_numeric, n_cats)).agg(*scores.class_count_columns(y, n_classes))


def weighted_shapes(shapes: DataFrame, class_weights: list[int]) -> DataFrame:
    """Shapes whose class counts are multiplied by whole weights, so that all sums over them stay exact."""
    return shapes.withColumns({f"c{j}": F.col(f"c{j}") * F.lit(w).cast("bigint") for j, w in enumerate(class_weights)})


def contingency(shapes: DataFrame, n_numeric: int, n_cats: int, n_classes: int) -> DataFrame:
    """(col_idx, bin, label, c0..cK-1): class counts per column and code."""
    cells = [f"struct({i} as col_idx, b_{i} as bin, string(NULL) as label)" for i in range(n_numeric)]
    cells += [f"struct({n_numeric + j} as col_idx, int(NULL) as bin, l_{j} as label)" for j in range(n_cats)]
    counts = scores.class_columns(n_classes)
    long = shapes.selectExpr(f"inline(array({', '.join(cells)}))", *counts)
    return long.groupBy("col_idx", "bin", "label").agg(*scores.sum_class_counts(n_classes))


def _label_sums(totals: list[int]) -> tuple[float, float, float]:
    """Rows, sum and sum of squares of the class code."""
    return (
        float(sum(totals)),
        float(sum(j * t for j, t in enumerate(totals))),
        float(sum(j * j * t for j, t in enumerate(totals))),
    )


def _row_sums(n_classes: int) -> tuple[str, str]:
    """Rows of a contingency cell, and the sum of their class codes."""
    return (
        "double(" + " + ".join(scores.class_columns(n_classes)) + ")",
        "(" + " + ".join(f"{j}D * c{j}" for j in range(n_classes)) + ")",
    )


def numeric_correlation(ct: DataFrame, totals: list[int]) -> DataFrame:
    """(col_idx, corr): correlation of the bin number, overflow bin included, with the class code."""
    rows, dot = _row_sums(len(totals))
    sums = (
        ct.filter("bin is not null")
        .groupBy("col_idx")
        .agg(
            F.expr(f"sum(bin * {rows})").alias("sx"),
            F.expr(f"sum(bin * bin * {rows})").alias("sxx"),
            F.expr(f"sum(bin * {dot})").alias("sxy"),
        )
    )
    return sums.select("col_idx", scores.round6(scores.correlation("sx", "sxx", "sxy", *_label_sums(totals))).alias("corr"))


def category_association(ct: DataFrame, totals: list[int]) -> DataFrame:
    """(col_idx, label, c*, corr, nmi, share) of every category's 0/1 indicator; share of the rows hold it."""
    counts = scores.class_columns(len(totals))
    rows, dot = _row_sums(len(totals))
    share = F.expr(rows) / F.lit(float(sum(totals)))
    corr = scores.correlation(rows, rows, dot, *_label_sums(totals))
    nmi = scores.nmi_indicator(f"array({', '.join(counts)})", scores.bigint_array_sql(totals))
    return ct.filter("label is not null").select(
        "col_idx", "label", *counts, scores.round6(corr).alias("corr"), scores.round6(nmi).alias("nmi"), share.alias("share")
    )


def score_items(
    ct: DataFrame, numeric: list[NumericColumn], cats: list[str], totals: list[int], minority_weight: float, ws: Workspace,
    n_codes: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """All scored (column, code) pairs, and the item dimension made of those with a positive score.

    Items: id, column, bin or label, range, name, external, internal, raw score; ``u`` is the
    utility in millionths. A class weight multiplies every item of a class and
    that class's maximum alike, so ``minority_weight`` leaves the normalised scores as they are.
    """
    if n_codes is None:
        n_codes = ct.count()
    if minority_weight <= 0:
        raise ValueError("minority_weight must be positive")
    spark = ct.sparkSession
    grid = []
    for i, c in enumerate(numeric):
        right = c.right_edges()
        if c.bins and right and max(right) == 0.0 == min(right):
            log.warning("column %s has a largest edge of 0 and gives no item", c.name)
        for b in range(1, c.bins + 1):
            grid.append((i, c.name, b, c.edges[b - 1], c.edges[b], right[b - 1], right[c.bins - b]))
    grid_df = local_frame(
        spark, grid, "col_idx int, col string, bin int, lo double, hi double, up double, down double"
    )
    from_numeric = (
        grid_df.join(numeric_correlation(ct, totals), "col_idx")
        .withColumn("external", F.abs("corr"))
        .withColumn("internal", F.when(F.col("corr") > 0, F.col("up")).otherwise(F.col("down")))
        .select(
            "col_idx",
            "col",
            "bin",
            F.lit(None).cast("string").alias("label"),
            "lo",
            "hi",
            F.concat(
                F.col("col"), F.lit("=["), F.col("lo").cast("string"), F.lit("-"), F.col("hi").cast("string"), F.lit("]")
            ).alias("name"),
            "corr",
            "external",
            "internal",
            F.lit(None).cast("double").alias("share"),
        )
    )
    scored = from_numeric
    if cats:
        names = F.array(*[F.lit(c) for c in cats])
        labels = category_association(ct, totals).select("col_idx", "label", "corr", "nmi", "share")
        coded = numbered(labels, [F.col("label")], ws, "bin", ["col_idx"], rows=n_codes)
        from_category = coded.withColumn("col", F.element_at(names, F.col("col_idx") - F.lit(len(numeric) - 1))).select(
            "col_idx",
            "col",
            F.col("bin").cast("int").alias("bin"),
            "label",
            F.lit(None).cast("double").alias("lo"),
            F.lit(None).cast("double").alias("hi"),
            F.concat(F.col("col"), F.lit("="), F.col("label")).alias("name"),
            "corr",
            F.col("nmi").alias("external"),
            F.when(F.col("corr") > 0, F.lit(1.0)).otherwise(F.lit(CATEGORY_NEGATIVE)).alias("internal"),
            "share",
        )
        scored = from_numeric.unionByName(from_category)
    raw = scored.withColumn("raw", F.col("external") * F.col("internal"))
    scored, size = ws.counted(raw, "scored", F.max("raw").alias("top"), F.count_if(F.col("raw") > 0).alias("n"))
    top, kept = size["top"] or 0.0, scored.filter(F.col("raw") > 0)
    ids = numbered(kept, [F.col("col_idx"), F.col("bin")], ws, "item", rows=size["n"])
    items = ids.withColumn("item", F.col("item").cast("int")).withColumn("u", scores.micros(F.col("raw") / F.lit(top if top > 0 else 1.0)))
    return scored, ws.table(items, "items")


def normalised(scored: DataFrame) -> DataFrame:
    """scored with share: the raw score over the largest one, 0 to 1."""
    top = scored.agg(F.max("raw")).first()[0] or 0.0
    return scored.withColumn("share", F.col("raw") / F.lit(top if top > 0 else 1.0))


def _literals(numeric: list[NumericColumn], n_cats: int, lookup: DataFrame) -> tuple[list[tuple[int, str, str]], list[list[dict]], list[bool]]:
    """(column, SQL of the item id, SQL of u) of the numeric columns; of each category column its heavy labels, and whether there are others."""
    heavy = F.coalesce(F.col("share") * HEAVY_SHARE > 1, F.lit(False))
    by_column: dict[int, dict[int, tuple[int, int]]] = {}
    known: list[list[dict]] = [[] for _ in range(n_cats)]
    for r in lookup.filter(F.col("label").isNull() | heavy).select("col_idx", "bin", "label", "id", "u").collect():
        if r["label"] is None:
            by_column.setdefault(r["col_idx"], {})[r["bin"]] = (r["id"], r["u"])
        else:
            known[r["col_idx"] - len(numeric)].append(r.asDict())
    cells = []
    for i, c in enumerate(numeric):
        pairs = [by_column.get(i, {}).get(b, (None, None)) for b in range(1, c.bins + 2)]
        if i in by_column:
            ids = ", ".join("int(NULL)" if p[0] is None else str(p[0]) for p in pairs)
            us = ", ".join("bigint(NULL)" if p[1] is None else f"{p[1]}L" for p in pairs)
            cells.append((i, f"array({ids})[b_{i} - 1]", f"array({us})[b_{i} - 1]"))
    tails = {r["col_idx"] for r in lookup.filter(F.col("label").isNotNull() & ~heavy).select("col_idx").distinct().collect()} if n_cats else set()
    return cells, known, [len(numeric) + j in tails for j in range(n_cats)]


def item_columns(
    encoded: DataFrame, numeric: list[NumericColumn], n_cats: int, lookup: DataFrame
) -> tuple[DataFrame, list[tuple[str, str]], list[str]]:
    """Per feature column the SQL of its item (id, u), NULL without one; and helper columns to drop.

    ``lookup`` holds (col_idx, bin, label, id, u, share). Numeric ids (columns x bins) and heavy labels (fewer than HEAVY_SHARE a
    column) become literals; a column with other labels is joined with them, by broadcast when Spark finds them few enough.
    """
    literals, known, tails = _literals(numeric, n_cats, lookup)
    cells, work, helpers = [(i, u) for _, i, u in literals], encoded, []
    for j in range(n_cats):
        own = lookup.filter(F.col("col_idx") == len(numeric) + j).select("label", "id", "u")
        work = looked_up(work, f"l_{j}", own, {"id": "int", "u": "bigint"}, known[j], f"_item{j}", tails[j])
        cells.append((f"_item{j}.id", f"_item{j}.u"))
        helpers.append(f"_item{j}")
    return work, cells, helpers


def item_transactions(encoded: DataFrame, numeric: list[NumericColumn], n_cats: int, lookup: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, item, u): one row per coded row and item. All category columns meet the dictionary in one join, without heavy labels."""
    literals, known, tails = _literals(numeric, n_cats, lookup)
    work, cells = encoded, [(i, u) for _, i, u in literals]
    left = []
    for j in range(n_cats):
        work = looked_up(work, f"l_{j}", lookup, {"id": "int", "u": "bigint"}, known[j], f"_item{j}", tail=False)
        cells.append((f"_item{j}.id", f"_item{j}.u"))
        if tails[j]:
            left.append(f"struct({len(numeric) + j} as col_idx, if(_item{j} is null, l_{j}, null) as label)")
    out = work.select(*keys, F.explode(F.expr(items_sql(cells))).alias("s")).select(*keys, F.col("s.id").alias("item"), F.col("s.u").alias("u"))
    if not left:
        return out
    rest = work.select(*keys, F.explode(F.expr(f"array({', '.join(left)})")).alias("s")).filter("s.label is not null")
    table = lookup.filter(F.col("label").isNotNull()).select(F.col("col_idx").alias("_c"), F.col("label").alias("_l"), F.col("id").alias("item"), "u")
    met = rest.join(table, (F.col("s.col_idx") == F.col("_c")) & (F.col("s.label") == F.col("_l")))
    return out.unionByName(met.select(*keys, "item", "u"))


def with_items(
    encoded: DataFrame, numeric: list[NumericColumn], n_cats: int, lookup: DataFrame, out: str = "items"
) -> DataFrame:
    """Add ``out``: array of (id, u) of the row's items, in column order."""
    work, cells, helpers = item_columns(encoded, numeric, n_cats, lookup)
    return work.withColumn(out, F.expr(items_sql(cells))).drop(*helpers)


def items_sql(cells: list[tuple[str, str]]) -> str:
    if not cells:
        return "cast(array() as array<struct<id:int,u:bigint>>)"
    return f"filter(array({', '.join(f'struct({i} as id, {u} as u)' for i, u in cells)}), x -> x.id is not null)"


def item_lookup(items: DataFrame) -> DataFrame:
    return items.select("col_idx", "bin", "label", F.col("item").alias("id"), "u", "share")


def transactions(with_item_rows: DataFrame, keys: list[str], carry: list[str] | None = None) -> DataFrame:
    """(keys, item, u): one row per row and item; rows without items do not appear."""
    carry = carry or []
    return with_item_rows.select(*keys, *carry, F.explode("items").alias("s")).select(
        *keys, *carry, F.col("s.id").alias("item"), F.col("s.u").alias("u")
    )


def transaction_utility(items: str = "items") -> Column:
    """Sum of the row's item utilities, in millionths."""
    return F.expr(f"aggregate({items}, 0L, (s, x) -> s + x.u)")


def item_sums(shape_items: DataFrame, n_classes: int) -> DataFrame:
    """(item, support, twu, riu) in millionths, exact.

    twu: utilities of the rows that hold the item; riu: the item's own utility over those rows.
    """
    per_row = shape_items.select(scores.class_rows(n_classes).alias("n"), transaction_utility().alias("tu"), F.explode("items").alias("s"))
    weighted = F.col("n").cast("decimal(20,0)") * F.col("tu").cast("decimal(18,0)")
    return (
        per_row.groupBy(F.col("s.id").alias("item"))
        .agg(F.sum("n").alias("support"), F.sum(weighted).cast("decimal(38,0)").alias("twu"), F.max("s.u").alias("u"))
        .select(
            "item",
            "support",
            "twu",
            (F.col("support").cast("decimal(20,0)") * F.col("u").cast("decimal(18,0)")).cast("decimal(38,0)").alias("riu"),
        )
    )


def start_threshold(sums: DataFrame, top_k: int):
    """k-th largest riu when there are at least k items, else 0 (millionths)."""
    value = kth_largest(sums, "riu", top_k)
    return value if value is not None else 0


def code_entropy(ct: DataFrame, n_classes: int) -> DataFrame:
    """(col_idx, bin, label, rows, entropy): class entropy, base K, inside each code of a column."""
    wide = ct.withColumn("cls", scores.class_array(n_classes))
    return wide.select(
        "col_idx",
        "bin",
        "label",
        scores.class_rows(n_classes).alias("rows"),
        scores.entropy("cls", n_classes).alias("entropy"),
    )


def column_gain(ct: DataFrame, totals: list[int]) -> DataFrame:
    """(col_idx, base_entropy, cond_entropy, gain): gain of a whole column, rounded to 6."""
    per_code = code_entropy(ct, len(totals))
    cond = per_code.groupBy("col_idx").agg((F.sum(F.col("rows") * F.col("entropy")) / F.lit(float(sum(totals)))).alias("cond"))
    base = scores.entropy(scores.bigint_array_sql(totals), len(totals))
    return cond.select(
        "col_idx", base.alias("base_entropy"), F.col("cond").alias("cond_entropy"), scores.round6(base - F.col("cond")).alias("gain")
    )
