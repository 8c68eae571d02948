"""Labelled views of the given tables, in Spark and in SQL, and models fitted on them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.registry import table
from gainsieve.operators import prep
from gainsieve.plans.miner import PatternMiner, PatternModel


@dataclass(frozen=True)
class View:
    name: str
    keys: list[str]
    ints: list[str]
    floats: list[str]
    cats: list[str]
    label: str  # SQL of the label, the same text for both engines
    source: str  # SQL FROM clause for the check
    derived: tuple[tuple[str, str], ...] = ()  # extra feature columns as (name, SQL)
    where: str = "true"  # rows of the view, the same text for both engines

    @property
    def features(self) -> list[str]:
        return [*self.ints, *self.floats, *self.cats]

    def frame(self, spark: SparkSession, sf: str) -> DataFrame:
        if self.name == "p4":
            base = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
        else:
            base = table(spark, sf, self.source)
        base = base.where(self.where)
        derived = dict(self.derived)
        chosen = [F.expr(derived[c]).alias(c) if c in derived else prep.q(c) for c in [*self.keys, *self.features]]
        return base.select(*chosen, F.expr(self.label).alias("lab"))

    def sql(self) -> str:
        """(tid, features, lab); tid numbers the rows when the key has several columns."""
        tid = self.keys[0] if len(self.keys) == 1 else f"row_number() OVER (ORDER BY {', '.join(self.keys)})"
        derived = dict(self.derived)
        features = ", ".join(f"{derived[c]} AS {c}" if c in derived else c for c in self.features)
        return f"SELECT {tid} AS tid, {features}, {self.label} AS lab FROM {self.source} WHERE {self.where}"


P1 = View(
    "p1",
    ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"],
    ["l_linenumber"],
    ["l_quantity", "l_extendedprice", "l_discount", "l_tax"],
    ["l_linestatus"],
    "case when l_quantity >= 25 and l_discount >= cast(0.05 as double) then 1"
    " when l_tax >= cast(0.06 as double) and l_quantity < 15 then 2 else 0 end",
    "lineitem",
)
P2 = View(
    "p2",
    ["o_orderkey"],
    [],
    ["o_totalprice"],
    ["o_orderstatus", "o_orderpriority"],
    "case when o_totalprice >= 250000 and o_orderstatus = 'F' then 1 else 0 end",
    "orders",
)
P3 = View(
    "p3",
    ["event_id"],
    ["user_id"],
    ["value"],
    ["event_type"],
    "case when event_type in ('error', 'purchase') and value >= 50 then 1 else 0 end",
    "events",
)
P4 = View("p4", ["doc_id"], ["n_chars"], [], ["lang", "source"], "quality", "labels JOIN documents USING (doc_id)")
P5 = View("p5", P1.keys, P1.ints, P1.floats, P1.cats, "l_returnflag", "lineitem")

# A column that repeats another one, so that many itemsets share their rows.
P2_TWIN = View(
    "p2twin", P2.keys, [], P2.floats, ["o_orderstatus", "twin"], P2.label, "orders", (("twin", "'s' || o_orderstatus"),)
)
# One numeric feature: the row with the largest value has no item.
P3_VALUE = View("p3value", P3.keys, [], ["value"], [], P3.label, "events")

_MODELS: dict[tuple, PatternModel] = {}


def fitted(view: View, spark: SparkSession, sf: str, **params) -> PatternModel:
    """The fitted model of a view; queries that show different parts of one fit share it."""
    key = (spark.sparkContext.applicationId, sf, view.name, repr(sorted(params.items())))
    if key not in _MODELS:
        frame = view.frame(spark, sf).select(*dict.fromkeys([*view.features, "lab"]))
        _MODELS[key] = PatternMiner(label="lab", features=view.features, **params).fit(frame)
    return _MODELS[key]
