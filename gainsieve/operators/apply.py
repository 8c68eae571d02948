"""Match mined patterns against rows: pattern items have to be a subset of the row's items."""

from __future__ import annotations

import json

from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gainsieve.functions.names import free, keeps_columns
from gainsieve.operators.encode import NumericColumn
from gainsieve.operators.utility import encode_rows, item_columns, item_lookup
from gainsieve.sources.local import local_frame
from gainsieve.sources.workspace import Workspace

INLINE_PATTERNS = 5_000
KNOWN_SETS = 100_000
MASK_WORDS = 8  # item sets of up to 64 * 8 items are compared as bit masks


def _coded_items(df: DataFrame, numeric: list[NumericColumn], cats: list[str], items: DataFrame, slots: dict[int, int] | None = None):
    """The coded frame, the SQL of each feature column's item id (and, with slots, of its slot), and the helper columns to drop."""
    lookup = item_lookup(items)
    if slots is not None:  # a slot for few items; it takes the place of the utility
        table = local_frame(df.sparkSession, list(slots.items()), "_item int, _slot bigint")
        lookup = lookup.join(table, F.col("id") == F.col("_item"), "left").select("col_idx", "bin", "label", "id", F.col("_slot").alias("u"), "share")
    work, cells, helpers = item_columns(encode_rows(df, numeric, cats), numeric, len(cats), lookup)
    helpers += [f"b_{i}" for i in range(len(numeric))] + [f"l_{j}" for j in range(len(cats))]
    if slots is not None:
        return work, cells, helpers
    return work, [i for i, _ in cells], helpers


def balanced_anchors(patterns: list[tuple[int, list[int]]], support: dict[int, int]) -> list[tuple[int, list[int]]]:
    """The patterns with the item first under which each is filed: of its items the one with the least load, which is the item's
    support times the patterns filed under it. Items of unknown support count as rare, in their order."""
    filed: dict[int, int] = {}
    out = []
    for pid, its in sorted(patterns, key=lambda p: (len(p[1]), p[0])):  # those without a choice first
        anchor = min(its, key=lambda i: (support.get(i, 0) * (filed.get(i, 0) + 1), its.index(i)))
        filed[anchor] = filed.get(anchor, 0) + 1
        out.append((pid, [anchor, *(i for i in its if i != anchor)]))
    return sorted(out)


def with_anchor(patterns: DataFrame, support: DataFrame | None = None) -> DataFrame:
    """patterns with the column anchor: as balanced_anchors, for any number of them and in one step: the load of an item is its
    support (item, support) times the patterns that hold it. Without supports the first, rarest item."""
    if support is None:
        return patterns.withColumn("anchor", F.element_at("items", 1))
    each = patterns.select("pid", F.explode("items").alias("item"))
    load = each.groupBy("item").agg(F.count("*").alias("n")).join(support.select("item", "support"), "item", "left")
    load = load.select("item", (F.col("n") * F.coalesce("support", F.lit(0))).alias("load"))
    best = each.join(load, "item").groupBy("pid").agg(F.min_by("item", F.struct("load", "item")).alias("anchor"))
    return patterns.join(best, "pid")


def _ids_sql(ids: list[str]) -> str:
    return f"filter(array({', '.join(ids)}), x -> x is not null)" if ids else "cast(array() as array<int>)"


@keeps_columns
def row_items(df: DataFrame, numeric: list[NumericColumn], cats: list[str], items: DataFrame, out: str = "item_ids") -> DataFrame:
    """Add the row's item ids (array, column order; empty when the row has none)."""
    work, ids, helpers = _coded_items(df, numeric, cats, items)
    return work.withColumn(out, F.expr(_ids_sql(ids))).drop(*helpers)


def _signed(word: int) -> int:
    return word - (1 << 64) if word >= 1 << 63 else word


@keeps_columns
def match_inline(
    df: DataFrame, numeric: list[NumericColumn], cats: list[str], items: DataFrame, patterns: list[tuple[int, list[int]]],
    n_items: int, ids_out: str = "item_ids", out: str = "pids", known: DataFrame | None = None,
) -> DataFrame:
    """Add item ids and the sorted matched pattern ids, row by row and without grouping; works on streams.

    Patterns are filed under their first item, so a row only looks at patterns whose first item it holds, and compares the
    rest as bit masks. For at most INLINE_PATTERNS patterns; the plan holds an entry for each pattern, none for each item.
    ``known`` (item_ids, pids; at most KNOWN_SETS rows) answers the item sets seen in training by a
    lookup, which Spark broadcasts if its bytes are few, so only new sets are compared.
    """
    words = (n_items + 63) // 64
    slots = {item: k for k, item in enumerate(sorted({its[0] for _, its in patterns}))}
    work, cells, helpers = _coded_items(df, numeric, cats, items, slots)
    ids, places = [i for i, _ in cells], [s for _, s in cells]
    work = work.withColumn(ids_out, F.expr(_ids_sql(ids)))
    masked = 0 < words <= MASK_WORDS
    filed: list[list[dict]] = [[] for _ in slots]
    for pid, its in patterns:
        entry: dict = {"p": pid}
        if masked:
            for w in range(words):
                entry[f"m{w}"] = _signed(sum(1 << ((i - 1) % 64) for i in its if (i - 1) // 64 == w))
        else:
            entry["r"] = its[1:]
        filed[slots[its[0]]].append(entry)
    fields = ", ".join(f"m{w}: bigint" for w in range(words)) if masked else "r: array<int>"
    index = F.from_json(F.lit(json.dumps(filed)), f"array<array<struct<p: int, {fields}>>>")
    work = work.withColumn("_index", index)
    near = ", ".join(f"coalesce(get(_index, int({s})), slice(_index[0], 1, 0))" for s in places)
    # The one-element transform binds the row's side as r, else it would be computed per pattern.
    if masked:
        bits = [
            " | ".join(f"if({i} between {64 * w + 1} and {64 * w + 64}, shiftleft(1L, {i} - {64 * w + 1}), 0L)" for i in ids)
            for w in range(words)
        ]
        bound = f"struct({', '.join(f'{b} as m{w}' for w, b in enumerate(bits))})"
        test = " and ".join(f"(x.m{w} & r.m{w}) = x.m{w}" for w in range(words))
    else:
        bound, test = _ids_sql(ids), "forall(x.r, i -> array_contains(r, i))"
    hits = f"transform(filter(concat({near}), x -> {test}), x -> x.p)"
    found = f"transform(array({bound}), r -> sort_array({hits}))[0]" if ids else "cast(array() as array<int>)"
    if known is not None:
        sets = known.select(F.col("item_ids").alias("_set"), F.col("pids").alias("_known"))
        work = work.join(sets, F.col(ids_out) == F.col("_set"), "left")
        found, helpers = f"if(_known is not null, _known, {found})", [*helpers, "_set", "_known"]
    return work.withColumn(out, F.expr(found)).drop("_index", *helpers)


@keeps_columns
def match_rows(
    df: DataFrame, numeric: list[NumericColumn], cats: list[str], items: DataFrame, patterns: DataFrame, ids_out: str = "item_ids", out: str = "pids",
    support: DataFrame | None = None,
) -> DataFrame:
    """What ``match_inline`` adds, for any number of patterns and without reading them to the driver; works on streams.

    The patterns filed under an item are one row of a table, which is joined once for each feature column; the rest
    is checked inside the row, so rows are neither exploded nor grouped.
    """
    work, ids, helpers = _coded_items(df, numeric, cats, items)
    work = work.withColumn(ids_out, F.expr(_ids_sql(ids)))
    filed = with_anchor(patterns, support).groupBy(F.col("anchor").alias("_first")).agg(
        F.collect_list(F.struct("pid", F.array_remove("items", F.col("anchor")).alias("rest"))).alias("_filed")
    )
    # a table of known size: if it is small, rows are not dealt by item, of which a numeric column has few
    filed = Workspace(df.sparkSession).table(filed, "filed-patterns")
    none = "cast(array() as array<struct<pid:int,rest:array<int>>>)"
    for i, own in enumerate(ids):
        near = filed.select(F.col("_first").alias(f"_first{i}"), F.col("_filed").alias(f"_filed{i}"))
        work = work.join(near, F.expr(own) == F.col(f"_first{i}"), "left")
        helpers += [f"_first{i}", f"_filed{i}"]
    if not ids:
        return work.withColumn(out, F.array().cast("array<int>")).drop(*helpers)
    near = ", ".join(f"coalesce(_filed{i}, {none})" for i in range(len(ids)))
    hits = f"transform(filter(concat({near}), x -> forall(x.rest, i -> array_contains({ids_out}, i))), x -> x.pid)"
    return work.withColumn(out, F.expr(f"sort_array({hits})")).drop(*helpers)


def match_join(df: DataFrame, patterns: DataFrame, keys: list[str], ids: str = "item_ids", support: DataFrame | None = None) -> DataFrame:
    """(keys, pid) coordinates for any number of patterns.

    Rows meet a pattern only through one item (see with_anchor); the rest is checked in
    place. The pattern table is broadcast when it is small enough, and nothing is
    grouped by row, so a row with many hits stays in its task.
    """
    anchored = with_anchor(patterns, support).select("pid", "anchor", F.col("items").alias("_need"))
    exploded = df.select(*keys, ids, F.explode(ids).alias("anchor"))
    hit = exploded.join(anchored, "anchor").filter(f"size(_need) = 1 or forall(_need, x -> array_contains({ids}, x))")
    return hit.select(*keys, "pid")


def match_profiles(df: DataFrame, patterns: DataFrame, ids: str = "item_ids", out: str = "pids") -> DataFrame:
    """Add matched pattern ids when there are too many patterns to inline.

    Distinct item sets are matched once and joined back, which needs no row key.
    """
    profiles = df.select(ids).distinct()
    met = match_join(profiles.withColumn("_set", F.col(ids)), patterns, ["_set"], ids)
    lists = met.groupBy("_set").agg(F.array_sort(F.collect_list("pid")).alias(out))
    joined = df.join(lists, F.col(ids) == F.col("_set"), "left").drop("_set")
    return joined.withColumn(out, F.coalesce(out, F.array().cast("array<int>")))


def coordinates(df: DataFrame, keys: list[str], pids: str = "pids") -> DataFrame:
    return df.select(*keys, F.explode(pids).alias("pid"))


def density(coords: DataFrame, n_rows: int, n_patterns: int) -> DataFrame:
    """(n_rows, n_patterns, nnz, density in percent)."""
    cells = F.lit(float(n_rows)) * F.lit(float(n_patterns))
    return coords.agg(F.count("*").alias("nnz")).select(
        F.lit(n_rows).cast("bigint").alias("n_rows"),
        F.lit(n_patterns).cast("bigint").alias("n_patterns"),
        "nnz",
        F.when(cells > 0, F.lit(100.0) * F.col("nnz") / cells).otherwise(F.lit(0.0)).alias("density"),
    )


def assemble_vectors(df: DataFrame, n_patterns: int, pids: str = "pids", out: str = "features") -> DataFrame:
    """Add the sparse 0/1 vector over all patterns; a row without a hit gets the zero vector."""
    (terms,) = free(df.columns, "_terms")
    vectorizer = CountVectorizerModel.from_vocabulary(
        [str(i) for i in range(max(n_patterns, 1))], inputCol=terms, outputCol=out, binary=True
    )
    return vectorizer.transform(df.withColumn(terms, F.col(pids).cast("array<string>"))).drop(terms)
