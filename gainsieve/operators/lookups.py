"""Values looked up by label, for labels of any frequency and dictionaries of any size.

Labels that a large share of the rows hold are few, so they become a map literal; only rows with other labels meet the
dictionary, and those without any are spread over salted keys, so that no task gets a hot label or all rows without one.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A label of more than one in HEAVY_SHARE rows is heavy, so a column has fewer than HEAVY_SHARE of them.
HEAVY_SHARE = 64
SALTS = 64


def heavy_labels(df: DataFrame, columns: list[str]) -> dict[str, list[str]]:
    """The trimmed labels of more than one in HEAVY_SHARE rows, of each column; all columns are counted in one groupBy."""
    if not columns:
        return {}
    cells = [F.struct(F.lit(c).alias("col"), F.trim(F.col(f"`{c}`").cast("string")).alias("label")) for c in columns]
    counts = df.select(F.explode(F.array(*cells)).alias("s")).groupBy("s.col", "s.label").agg(F.count("*").alias("n"))
    # every column has all rows, NULL labels included
    rows = counts.groupBy("col").agg(F.sum("n").alias("rows"))
    most = counts.filter(F.col("label").isNotNull()).join(rows, "col").filter(F.col("n") * HEAVY_SHARE > F.col("rows"))
    out: dict[str, list[str]] = {c: [] for c in columns}
    for r in most.select("col", "label").collect():
        out[r["col"]].append(r["label"])
    return out


def looked_up(work: DataFrame, label: str, table: DataFrame, fields: dict[str, str], heavy: list[dict], out: str, tail: bool = True) -> DataFrame:
    """work with the struct ``out`` of the fields that table (label, fields; a row a label) has for the label, NULL without any.

    ``heavy``: the rows of the table, as dictionaries, that are answered without a join. ``tail``: whether there are others.
    Nothing is grouped, so it works on streams.
    """
    shape = f"struct<{', '.join(f'{n}:{t}' for n, t in fields.items())}>"
    near = F.lit(None).cast(shape)
    if heavy:
        known = {h["label"]: {n: h[n] for n in fields} for h in heavy}
        near = F.element_at(F.from_json(F.lit(json.dumps(known)), f"map<string,{shape}>"), F.col(label))
    if not tail:
        return work.withColumn(out, near)
    plain = [F.col(f"`{f.name}`") for f in work.schema.fields if isinstance(f.dataType, T.AtomicType)]
    salt = F.pmod(F.xxhash64(*plain), F.lit(SALTS)).cast("int")
    work = work.withColumn(f"{out}_near", near).withColumn(f"{out}_key", F.when(F.col(f"{out}_near").isNull(), F.col(label)))
    work = work.withColumn(f"{out}_salt", F.when(F.col(f"{out}_key").isNull(), salt).otherwise(0))
    far = table.select(F.col("label").alias(f"{out}_label"), F.lit(0).alias(f"{out}_zero"), F.struct(*fields).alias(f"{out}_far"))
    met = (F.col(f"{out}_key") == F.col(f"{out}_label")) & (F.col(f"{out}_salt") == F.col(f"{out}_zero"))
    met = work.join(far, met, "left").withColumn(out, F.coalesce(f"{out}_near", f"{out}_far"))
    return met.drop(*[f"{out}_{x}" for x in ("near", "key", "salt", "label", "zero", "far")])
