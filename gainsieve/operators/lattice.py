"""One mining run for many lengths and gains.

Without a threshold that binds, the patterns of a smaller length or a larger gain follow from those of the longest length and
the smallest gain: the same itemsets have the same counts, fewer of them pass. So the rows are mined once, keeping what
sibling lists would drop, and each (length, gain) is derived from the tables of itemsets alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gainsieve.functions import scores
from gainsieve.operators import mine
from gainsieve.operators.encode import NumericColumn
from gainsieve.operators.mine import LEVEL_COLUMNS, MiningResult, emitted, extendable
from gainsieve.operators.utility import item_lookup, item_sums, with_items
from gainsieve.sources.workspace import Workspace


@dataclass
class Lattice:
    """levels: by length the candidates with same_as, the class of those with the same rows (NULL below the gain).

    ``passed``: by length how many have a gain above ``gain``; ``whole``: there are no longer ones.
    """

    levels: dict[int, DataFrame]
    passed: dict[int, int]
    ranked: DataFrame
    base: DataFrame
    gain: float
    most_items: int
    whole: bool

    def answers(self, length: int, gain: float, top_k: int) -> bool:
        """Whether a run with these parameters can be derived: it is inside the lattice and its thresholds stay 0."""
        deepest = max(self.levels)
        if gain < self.gain or not (self.whole or 0 < length <= deepest):
            return False
        if self.most_items >= top_k or (length >= 2 and self.most_items * (self.most_items - 1) // 2 >= top_k):
            return False
        return sum(n for m, n in self.passed.items() if length == -1 or m < length) < top_k


def grow(
    shapes: DataFrame, numeric: list[NumericColumn], n_cats: int, items: DataFrame, totals: list[int], length: int, gain: float,
    most_nodes: int, ws: Workspace, most_items: int, exact_dedupe: bool = True,
) -> Lattice:
    """All itemsets up to ``length`` (-1: any) whose parts have a gain above ``gain``, siblings with the same rows among them.

    No level is grown on ``most_nodes`` itemsets or more: no run whose top K is that many could be derived from it.
    """
    k = len(totals)
    whole = scores.bigint_array_sql(totals)
    sums = ws.table(item_sums(with_items(shapes, numeric, n_cats, item_lookup(items)), k), "item-sums")
    ranked = mine.ranked_items(items, sums, 0, ws, most_items)
    base = ws.table(mine.mining_base(shapes, numeric, n_cats, ranked, k), "base")
    above = F.col("ig") > F.lit(gain)
    count = F.count_if(above).alias("n")
    first, size = ws.counted(mine.with_gain(mine.single_sums(base, k), whole).select(*LEVEL_COLUMNS), "level-1", count)
    levels, passed, m = {1: first}, {1: size["n"]}, 1
    while passed[m] > 1 and m != length and sum(passed.values()) < most_nodes:
        before = levels[m].filter(above)
        m += 1
        if m == 2:
            heads = before.filter(extendable(0)).select(F.array("last").alias("prefix"))
            found = mine.with_gain(mine.pair_sums(base, k), whole)
            found = found.join(heads, "prefix", "left_semi").join(before.select("last"), "last", "left_semi")
        else:
            parents = levels[m - 2].select(F.concat("prefix", F.array("last")).alias("p"), F.col("cls").alias("parent_cls"))
            found = mine.with_gain(mine._deeper(base, before, 0, m, k, sum(totals)).join(parents, "p"), "parent_cls")
        levels[m], size = ws.counted(found.select(*LEVEL_COLUMNS), f"level-{m}", count)
        passed[m] = size["n"]
    ranks = F.concat("prefix", F.array("last"))
    nodes = reduce(DataFrame.unionByName, [v.filter(above) for v in levels.values()]).withColumn("ranks", ranks)
    classed, _ = mine.equal_row_classes(nodes.select("ranks", "support", "f1", "f2"), [], [F.col("ranks")], base, ws, "classes", exact_dedupe)
    classed = ws.table(classed.select("ranks", "same_as"), "same-rows")
    for at, level in levels.items():
        joined = level.withColumn("ranks", ranks).join(classed, "ranks", "left").drop("ranks")
        levels[at] = ws.table(joined, f"classed-{at}")
    return Lattice(levels, passed, ranked, base, gain, most_items, passed[m] <= 1)


def derive(lattice: Lattice, length: int, gain: float, top_k: int, fs_k: int, ws: Workspace, keep_duplicate: str = "lowest") -> MiningResult:
    """What ``mine.mine`` finds with these parameters, which ``lattice.answers``: no row is read."""
    report = {"threshold_start": 0.0, "threshold_raised": 0.0, "levels": []}
    above = F.col("ig") > F.lit(gain)
    counts = (F.count("*").alias("candidates"), F.count_if(above).alias("passed_gain"), F.count_if(F.col("first") & above).alias("survivors"))
    first = F.row_number().over(Window.partitionBy("prefix", "same_as").orderBy("last")) == 1
    found, m, before = [], 1, None
    while m in lattice.levels and (length == -1 or m <= length):
        level = lattice.levels[m]
        if m == 1:
            level = level.withColumn("first", F.lit(True))
        else:
            heads = before.filter(extendable(0)).select(F.concat("prefix", F.array("last")).alias("prefix"))
            tails = before.select(F.col("prefix").alias("_p"), F.col("last").alias("_l"))
            sibling = (F.slice("prefix", 1, m - 2) == F.col("_p")) & (F.col("last") == F.col("_l"))
            level = level.join(heads, "prefix", "left_semi").join(tails, sibling, "left_semi").withColumn("first", first)
        level, size = ws.counted(level, f"derived-{m}", *counts)
        report["levels"].append({"length": m, **size, "siblings_dropped": size["passed_gain"] - size["survivors"]})
        before = level.filter(F.col("first") & above)
        found.append(emitted(before, 0, gain))
        if size["survivors"] <= 1:
            break
        m += 1
    everything = reduce(DataFrame.unionByName, found)
    patterns = mine.select_patterns(everything, lattice.ranked, lattice.base, top_k, fs_k, ws, report, keep_duplicate)
    return MiningResult(lattice.ranked, patterns, report)
