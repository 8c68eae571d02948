"""Level-wise pattern mining on weighted row shapes.

Item utilities are constants, so an itemset's utility is support x (sum of its
item utilities), and its row set is identified by the shapes that hold it. Every
level is one partially aggregated groupBy over the shapes; there is no join on
row ids and no list of row ids.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gainsieve.functions import scores
from gainsieve.operators.encode import NumericColumn
from gainsieve.operators.order_stats import kth_largest
from gainsieve.operators.running import numbered
from gainsieve.operators.utility import item_lookup, item_sums, start_threshold, with_items
from gainsieve.sources.workspace import Workspace

HASH_SALT = 7919


def set_hashes() -> list[Column]:
    """Two 64-bit hashes of a shape's item set. Sums of them stand for row sets; equality is proved by counting all the same."""
    # the salt comes first: each column's hash is seeded with the one before, so a salt after the items would add nothing
    return [F.xxhash64("items").alias("h1"), F.xxhash64(F.lit(HASH_SALT), "items").alias("h2")]


# The bound is summed in doubles and only prunes, so it is loosened by far more than the rounding error.
BOUND_SLACK = 1.0 + 1e-9


@dataclass
class MiningResult:
    items: DataFrame
    patterns: DataFrame
    report: dict = field(default_factory=dict)


def default_top_k(length: int, top_k: int, item_percent: float) -> int:
    """Pattern budget: sums of binomials of 100 nominal items, by maximal length."""
    if top_k != -1:
        return top_k
    cumulated = {1: 100, 2: 5050, 3: 166750, 4: 4087975, 5: 79375495, 6: 1271427895}  # fixed values
    if length in (-1, 1):
        return cumulated[1]
    return int(item_percent * cumulated.get(length, cumulated[2]))


def default_fs_k(fs_k: int, top_k: int) -> int:
    return top_k if fs_k == -1 or fs_k > top_k else fs_k


def ranked_items(items: DataFrame, sums: DataFrame, threshold, ws: Workspace, most: int | None = None) -> DataFrame:
    """Items with twu >= threshold and their rank 1..N by (twu, item); ``most`` bounds their number."""
    kept = sums.filter(F.col("twu") >= F.lit(threshold))
    ranked = numbered(items.join(kept, "item"), [F.col("twu"), F.col("item")], ws, "rank", rows=most)
    return ws.table(ranked.withColumn("rank", F.col("rank").cast("int")), "ranked-items")


def ranked_rows(
    coded: DataFrame, numeric: list[NumericColumn], n_cats: int, ranked: DataFrame
) -> DataFrame:
    """Coded rows or shapes with their kept items in rank order.

    Adds ``items`` (ranks), ``us`` (utilities) and ``suf`` (utility of the items after each one).
    """
    lookup = ranked.select("col_idx", "bin", "label", F.col("rank").alias("id"), "u", "share")
    found = with_items(coded, numeric, n_cats, lookup, "_found").withColumn("_found", F.array_sort("_found"))
    split = found.withColumns({"items": F.expr("transform(_found, x -> x.id)"), "us": F.expr("transform(_found, x -> x.u)")})
    return split.withColumn("suf", F.expr(SUFFIX_SQL)).drop("_found")


SUFFIX_SQL = "transform(us, (u, i) -> aggregate(slice(us, i + 2, size(us)), 0L, (s, x) -> s + x))"


def mining_base(
    shapes: DataFrame, numeric: list[NumericColumn], n_cats: int, ranked: DataFrame, n_classes: int
) -> DataFrame:
    """Distinct sets of kept items: items, us, suf, class counts, rows, two hashes of the set."""
    rows = ranked_rows(shapes, numeric, n_cats, ranked).filter(F.size("items") > 0)
    merged = rows.groupBy("items", "us", "suf").agg(*scores.sum_class_counts(n_classes))
    return merged.select("*", scores.class_rows(n_classes).alias("n"), *set_hashes())


def item_occurrences(rows: DataFrame, carry: list[str]) -> DataFrame:
    """(last, u, r, carried): one row per row and item; r is the utility after the item."""
    out = rows.select(F.posexplode("items").alias("i", "last"), "us", "suf", *carry)
    return out.select("last", F.expr("us[i]").alias("u"), F.expr("suf[i]").alias("r"), *carry)


def pair_occurrences(rows: DataFrame, carry: list[str]) -> DataFrame:
    """(x, last, u, r, carried): the item pairs of each row, made inside the row without a join."""
    firsts = rows.select("items", "us", "suf", *carry, F.posexplode("items").alias("i", "x"))
    both = firsts.select("us", "suf", "i", "x", *carry, F.posexplode(F.expr("slice(items, i + 2, size(items))")).alias("k", "last"))
    return both.select(
        "x", "last", F.expr("us[i] + us[i + k + 1]").alias("u"), F.expr("suf[i + k + 1]").alias("r"), *carry
    )


def itemset_sums(occurrences: DataFrame, keys: list[str], n_classes: int) -> DataFrame:
    """Per itemset: class counts, support, utility, remaining utility, row-set fingerprint."""
    return (
        occurrences.groupBy(*keys)
        .agg(
            *scores.sum_class_counts(n_classes),
            F.sum("n").alias("support"),
            F.max("u").alias("u"),
            F.sum(F.col("n").cast("double") * F.col("r").cast("double")).alias("rutil"),
            F.bit_xor("h1").alias("f1"),
            F.bit_xor("h2").alias("f2"),
        )
        .withColumn("cls", scores.class_array(n_classes))
        .withColumn("util", (F.col("support").cast("decimal(20,0)") * F.col("u").cast("decimal(18,0)")).cast("decimal(38,0)"))
        .drop(*scores.class_columns(n_classes), "u")
    )


def _carried(n_classes: int) -> list[str]:
    return [*scores.class_columns(n_classes), "n", "h1", "h2"]


def single_sums(base: DataFrame, n_classes: int) -> DataFrame:
    sums = itemset_sums(item_occurrences(base, _carried(n_classes)), ["last"], n_classes)
    return sums.withColumn("prefix", F.array().cast("array<int>"))


def pair_sums(base: DataFrame, n_classes: int) -> DataFrame:
    sums = itemset_sums(pair_occurrences(base, _carried(n_classes)), ["x", "last"], n_classes)
    return sums.withColumn("prefix", F.array("x")).drop("x")


def with_gain(sums: DataFrame, parent: str) -> DataFrame:
    """Gain (rounded to 12 decimals, so that equal gains are equal), entropy and pure class."""
    return sums.withColumns(
        {
            "ig": F.round(scores.information_gain("cls", parent), 12),
            "entropy": scores.entropy("cls"),
            "pure_class": scores.pure_class("cls"),
        }
    )


def raised_by_pairs(pairs: DataFrame, threshold, top_k: int):
    """k-th largest pair utility among pairs at or above the threshold, if there are k of them."""
    value = kth_largest(pairs.filter(F.col("util") >= F.lit(threshold)), "util", top_k)
    return value if value is not None and value > threshold else threshold


def rows_with_both(pairs: DataFrame, base: DataFrame) -> DataFrame:
    """pairs (id, both: sorted ranks of two itemsets) with n_both, the rows that hold all of both: 0 when there are none.

    A pair is looked for in the shapes that hold its first item, which is the one in the fewest rows, or nearly.
    """
    anchored = pairs.select("id", "both", F.element_at("both", 1).alias("anchor"))
    wanted = anchored.select("anchor").distinct()
    # only shapes that hold an anchor are taken apart, and only at anchors
    occurrences = base.select("items", "n", F.explode("items").alias("anchor")).join(wanted, "anchor", "left_semi")
    held = occurrences.join(anchored, "anchor").filter(F.size(F.array_intersect("both", "items")) == F.size("both"))
    counted = held.groupBy("id").agg(F.sum("n").alias("n_both"))
    return pairs.join(counted, "id", "left").withColumn("n_both", F.coalesce("n_both", F.lit(0)))


def equal_row_classes(
    found: DataFrame, group: list[str], order: list[Column], base: DataFrame, ws: Workspace, name: str, proved: bool = True
) -> tuple[DataFrame, int]:
    """Itemsets (ranks, support, f1, f2, ...) with same_as, the ranks of the first in order of those of their group that have the
    same rows; and how many are not that first.

    Equal fingerprints only say which may be the same. Each is compared with the first of its fingerprint by counting the rows
    that hold both: as many as hold one means the same rows. Those that turn out to differ are compared among themselves in
    the next round, so whatever the hashes are, the result is right.
    """
    w = Window.partitionBy(*group, "support", "f1", "f2").orderBy(*order)
    columns, done, gone, left, turn = found.columns, [], 0, found, 0
    while True:
        placed = left.withColumns({"_rn": F.row_number().over(w), "same_as": F.first("ranks").over(w)})
        placed, size = ws.counted(placed, f"{name}-{turn}", F.count_if(F.col("_rn") > 1).alias("repeats"))
        if not size["repeats"] or not proved:
            gone += size["repeats"]
            done.append(placed.select(*columns, "same_as"))
            break
        pairs = placed.filter("_rn > 1").select(F.struct("ranks", F.col("same_as").alias("_first")).alias("id"), F.array_sort(F.array_union("ranks", "same_as")).alias("both"))
        same = rows_with_both(pairs.distinct(), base).select(F.col("id.ranks").alias("_ranks"), "n_both")
        judged = placed.filter("_rn > 1").join(same, F.col("ranks") == F.col("_ranks"), "left")
        unlike = F.col("n_both") != F.col("support")
        judged, size = ws.counted(judged, f"{name}-{turn}-judged", F.count_if(unlike).alias("n"), F.count("*").alias("judged"))
        gone += size["judged"] - size["n"]
        done += [placed.filter("_rn = 1").select(*columns, "same_as"), judged.filter(~unlike).select(*columns, "same_as")]
        if not size["n"]:
            break
        left, turn = judged.filter(unlike).select(columns), turn + 1
    return reduce(DataFrame.unionByName, done), gone


def first_of_equal_rows(
    found: DataFrame, group: list[str], order: list[Column], base: DataFrame, ws: Workspace, name: str, proved: bool = True
) -> tuple[DataFrame, int]:
    """Of itemsets of a group that have the same rows the first in order (see equal_row_classes); and how many went."""
    classed, gone = equal_row_classes(found, group, order, base, ws, name, proved)
    return classed.filter(F.col("ranks") == F.col("same_as")).select(found.columns), gone


def drop_sibling_duplicates(extensions: DataFrame, base: DataFrame, ws: Workspace, proved: bool = True) -> tuple[DataFrame, int]:
    """Among extensions of one prefix with the same rows, the first in item order stays; and how many went."""
    whole = extensions.withColumn("ranks", F.concat("prefix", F.array("last")))
    left, gone = first_of_equal_rows(whole, ["prefix"], [F.col("last")], base, ws, "siblings", proved)
    return left.select(extensions.columns), gone


def extendable(threshold) -> Column:
    bound = F.col("util").cast("double") + F.col("rutil")
    return (F.col("util") > 0) & (bound * F.lit(BOUND_SLACK) >= F.lit(float(threshold)))


def emitted(level: DataFrame, threshold, gain: float) -> DataFrame:
    return level.filter((F.col("util") >= F.lit(threshold)) & (F.col("util") > 0) & (F.col("ig") > F.lit(gain)))


#: A prefix with more than one in HOT_SHARE rows is spread over SALTS keys where it meets its sibling lists.
HOT_SHARE, SALTS = 64, 16


def meet_siblings(state: DataFrame, siblings: DataFrame, total: int) -> DataFrame:
    """state (p, h1, ...) joined with siblings (p, most, ...) on p, heavy and light prefixes in one join.

    most, the largest support of a prefix's extensions, tells the heavy ones: few, as a row has only so many prefixes. Their
    rows are dealt over SALTS keys by the shape's hash, and their lists are there once for each; all others have one key.
    """
    heavy = F.col("most") * HOT_SHARE >= F.lit(total)
    hot = siblings.filter(heavy).select("p", F.lit(True).alias("_hot"))
    lists = siblings.withColumn("_salt", F.explode(F.when(heavy, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("most")
    dealt = state.join(hot, "p", "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod("h1", F.lit(SALTS)).cast("int")).otherwise(0)).drop("_hot")
    return dealt.join(lists, ["p", "_salt"]).drop("_salt")


def _deeper(base: DataFrame, survivors: DataFrame, threshold, length: int, n_classes: int, total: int) -> DataFrame:
    """Counts of itemsets P + x + y for surviving siblings P + x, P + y (``length`` = |P| + 2 >= 3)."""
    siblings = (
        survivors.withColumn("head", extendable(threshold))
        .groupBy("prefix")
        .agg(F.collect_list("last").alias("s"), F.collect_list(F.when(F.col("head"), F.col("last"))).alias("x"), F.max("support").alias("most"))
        .filter((F.size("s") > 1) & (F.size("x") > 0))
    )
    state = base.select("*", F.explode("items").alias("_a")).withColumn("p", F.array("_a")).drop("_a")
    for depth in range(1, length - 2):
        # Walk only along prefixes that some sibling group has.
        steps = siblings.groupBy(F.slice("prefix", 1, depth).alias("p")).agg(
            F.collect_set(F.element_at("prefix", depth + 1)).alias("next")
        )
        state = state.join(steps, "p").withColumn("_a", F.explode(F.array_intersect("items", "next")))
        state = state.withColumn("p", F.concat("p", F.array("_a"))).drop("_a", "next")
    met = meet_siblings(state, siblings.withColumnRenamed("prefix", "p"), total)
    met = met.withColumn("s", F.array_intersect("items", "s")).filter(F.size("s") > 1)
    firsts = met.withColumn("a", F.explode(F.array_intersect("s", "x")))
    both = firsts.withColumn("last", F.explode(F.filter("s", lambda y: y > F.col("a"))))
    whole = F.concat("p", F.array("a", "last"))
    places = F.transform(whole, lambda v: F.array_position(F.col("items"), v).cast("int"))
    occ = both.withColumn("_at", places).select(
        "p",
        "a",
        "last",
        F.aggregate("_at", F.lit(0).cast("bigint"), lambda acc, i: acc + F.element_at(F.col("us"), i)).alias("u"),
        F.element_at("suf", F.element_at("_at", -1)).alias("r"),
        *_carried(n_classes),
    )
    return itemset_sums(occ, ["p", "a", "last"], n_classes).withColumn("prefix", F.concat("p", F.array("a"))).drop("a")


LEVEL_COLUMNS = ["prefix", "last", "support", "util", "rutil", "cls", "f1", "f2", "ig", "entropy", "pure_class"]


def mine(
    shapes: DataFrame,
    numeric: list[NumericColumn],
    n_cats: int,
    items: DataFrame,
    totals: list[int],
    length: int,
    gain: float,
    top_k: int,
    fs_k: int,
    ws: Workspace,
    most_items: int,
    keep_duplicate: str = "lowest",
    exact_dedupe: bool = True,
) -> MiningResult:
    """Mine, rank, dedupe and select patterns; see the module text for the data layout.

    ``most_items`` is an upper bound of the number of items; with fewer than topK of them
    (or of their pairs) a threshold cannot bind and is not computed.
    """
    k = len(totals)
    whole = scores.bigint_array_sql(totals)
    sums = ws.table(item_sums(with_items(shapes, numeric, n_cats, item_lookup(items)), k), "item-sums")
    threshold = start_threshold(sums, top_k) if most_items >= top_k else 0
    ranked = ranked_items(items, sums, threshold, ws, most_items)
    base = ws.table(mining_base(shapes, numeric, n_cats, ranked, k), "base")
    levels: dict[int, DataFrame] = {}
    report = {"threshold_start": float(threshold) / scores.MICRO, "levels": []}

    counts = (F.count("*").alias("candidates"), F.count_if(F.col("ig") > F.lit(gain)).alias("survivors"))
    level, size = ws.counted(with_gain(single_sums(base, k), whole).select(*LEVEL_COLUMNS), "level-1", *counts)
    levels[1] = level.filter(F.col("ig") > F.lit(gain))
    pairs = None
    if length >= 2:
        pairs = ws.table(with_gain(pair_sums(base, k), whole).select(*LEVEL_COLUMNS), "pairs")
        if most_items * (most_items - 1) // 2 >= top_k:
            threshold = raised_by_pairs(pairs, threshold, top_k)
    report["threshold_raised"] = float(threshold) / scores.MICRO
    found = [emitted(levels[1], threshold, gain)]
    report["levels"].append({"length": 1, **size, "passed_gain": size["survivors"], "siblings_dropped": 0})

    m, bar = 2, threshold
    while (length == -1 or m <= length) and report["levels"][-1]["survivors"] > 1:
        if m == 2:
            if pairs is None:
                pairs = ws.table(with_gain(pair_sums(base, k), whole).select(*LEVEL_COLUMNS), "pairs")
            heads = levels[1].filter(extendable(bar)).select(F.array("last").alias("prefix"))
            tails = levels[1].select("last")
            candidates = pairs.join(heads, "prefix", "left_semi").join(tails, "last", "left_semi")
        else:
            raw = _deeper(base, levels[m - 1], bar, m, k, sum(totals))
            parents = levels[m - 2].select(
                F.concat("prefix", F.array("last")).alias("p"), F.col("cls").alias("parent_cls")
            )
            candidates = with_gain(raw.join(parents, "p"), "parent_cls").select(*LEVEL_COLUMNS)
        candidates, size = ws.counted(candidates.select(*LEVEL_COLUMNS), f"candidates-{m}", *counts)
        levels[m], gone = drop_sibling_duplicates(candidates.filter(F.col("ig") > F.lit(gain)), base, ws, exact_dedupe)
        size = {**size, "survivors": size["survivors"] - gone, "passed_gain": size["survivors"], "siblings_dropped": gone}
        found.append(emitted(levels[m], threshold, gain))
        report["levels"].append({"length": m, **size})
        if length != -1 and m == length:
            break
        if sum(lv["survivors"] for lv in report["levels"]) < top_k:
            m += 1
            continue
        best = kth_largest(reduce(DataFrame.unionByName, found), "util", top_k)
        if best is not None and best > bar:
            bar = best
        m += 1

    everything = reduce(DataFrame.unionByName, found)
    patterns = select_patterns(everything, ranked, base, top_k, fs_k, ws, report, keep_duplicate, exact_dedupe)
    return MiningResult(ranked, patterns, report)


def name_patterns(patterns: DataFrame, ranked: DataFrame) -> DataFrame:
    """Replace rank arrays by item ids and names, in the same order."""
    parts = (
        patterns.select("ranks", F.posexplode("ranks").alias("pos", "rank"))
        .join(ranked.select("rank", "item", "name"), "rank")
        .groupBy("ranks")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "item", "name"))).alias("parts"))
    )
    return patterns.join(parts, "ranks").select(
        "*",
        F.transform("parts", lambda x: x["item"]).alias("items"),
        F.transform("parts", lambda x: x["name"]).alias("names"),
        F.array_join(F.transform("parts", lambda x: x["name"]), ", ").alias("name"),
    ).drop("parts")


def select_patterns(
    found: DataFrame,
    ranked: DataFrame,
    base: DataFrame,
    top_k: int,
    fs_k: int,
    ws: Workspace,
    report: dict,
    keep_duplicate: str = "lowest",
    exact_dedupe: bool = True,
) -> DataFrame:
    """Top-K by utility, one pattern per row set, order by gain, first fsK; pid = 0, 1, ...

    Patterns are cut to the top K before their items are named; only what ties with the last is named to settle the tie.
    Where ``found`` has same_as, that column tells the row sets and nothing is compared.
    """
    shown = ["support", "util", "ig", "entropy", "pure_class", "cls", "f1", "f2", *(["same_as"] if "same_as" in found.columns else [])]
    whole, size = ws.counted(
        found.withColumn("ranks", F.concat("prefix", F.array("last"))).select("ranks", *shown),
        "emitted", F.count("*").alias("n"), F.min("util").alias("least_util"), F.min("ig").alias("least_ig"), F.max("ig").alias("most_ig"),
    )
    size_found, n_found = size, size["n"]
    if n_found > top_k:
        bar = kth_largest(whole, "util", top_k)
        whole = whole.filter(F.col("util") >= F.lit(bar))
    top = name_patterns(whole, ranked).select("ranks", "items", "names", "name", *shown)
    if n_found > top_k:
        ordered = numbered(top, [F.desc("util"), F.col("items")], ws, "_by_util", rows=n_found)
        top = ordered.filter(F.col("_by_util") <= top_k).drop("_by_util")
    if keep_duplicate == "highest":
        choice = [F.desc("ig"), F.desc("util"), F.col("items")]
    else:
        choice = [F.col("ig"), F.col("util"), F.desc("items")]
    if "same_as" in shown:
        distinct = top.withColumn("_rn", F.row_number().over(Window.partitionBy("same_as").orderBy(*choice))).filter("_rn = 1")
    else:
        distinct, _ = first_of_equal_rows(top, [], choice, base, ws, "same-rows", exact_dedupe)
    distinct = distinct.drop("f1", "f2", "same_as", "_rn")
    by_gain = [F.desc("ig"), F.desc("util"), F.col("items")]
    ordered = numbered(distinct, by_gain, ws, "_place", rows=min(n_found, top_k))
    ordered = ordered.withColumn("pid", (F.col("_place") - 1).cast("int")).drop("_place")
    ordered, size = ws.counted(ordered, "patterns", F.count("*").alias("n"))
    n_distinct = size["n"]
    chosen = ordered.filter(F.col("pid") < fs_k) if fs_k != -1 else ordered
    report.update(
        {
            "patterns_found": n_found,
            "patterns_same_rows": min(n_found, top_k) - n_distinct,
            "least_utility": float(size_found["least_util"]) / scores.MICRO if n_found else 0.0,
            "least_gain": float(size_found["least_ig"]) if n_found else 0.0,
            "most_gain": float(size_found["most_ig"]) if n_found else 0.0,
            "patterns_top": min(n_found, top_k),
            "patterns_distinct": n_distinct,
            "patterns_selected": n_distinct if fs_k == -1 else min(n_distinct, fs_k),
        }
    )
    return chosen.select(
        "pid",
        "items",
        "names",
        "name",
        F.size("items").alias("len"),
        "support",
        scores.from_micros(F.col("util")).alias("utility"),
        "util",
        "ig",
        "entropy",
        "pure_class",
        "cls",
    )
