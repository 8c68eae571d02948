"""Boilerplate lines: those found on many distinct sites, removed from every text.

For each line hash a HyperLogLog sketch of the sites it is on; sketches merge by aggregation, so a line that a third of
all rows share is summed up before any shuffle. Lines whose estimate is too near the threshold to tell get an exact count of
distinct sites; the rest keep their estimate. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gainsieve.llm.common import text_key
from gainsieve.sources.workspace import Workspace

#: Sites from which on a line is boilerplate.
MIN_SITES = 10
#: log2 of a sketch's registers.
REGISTERS = 10
#: Standard errors around the threshold within which lines are counted exactly.
BAND = 6


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _line_key(line: Column) -> list[Column]:
    line = F.trim(line)
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(0x11E5), line).alias("h2")]


def boilerplate(docs: DataFrame, ws: Workspace, text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """h1, h2: hashes of the lines (without outer spaces, not empty) on min_sites distinct sites or more; a null site counts for none."""
    exploded = docs.select(F.col(site_col).alias("site"), F.explode(_lines(F.col(text_col))).alias("line")).where(F.trim("line") != "")
    seen = exploded.select("site", *_line_key(F.col("line"))).where(F.col("site").isNotNull())
    # a line is on no more sites than it has occurrences: the rest need no sketch, and this sum is cheap
    sketches = seen.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.hll_sketch_agg(F.xxhash64("site"), REGISTERS).alias("sketch"))
    spread = ws.table(sketches.where(F.col("n") >= min_sites).select("h1", "h2", F.hll_sketch_estimate("sketch").alias("sites")), "spread")
    error = BAND * 1.04 / 2 ** (REGISTERS / 2)
    low, high = min_sites * (1 - error) - 1, min_sites * (1 + error) + 1
    near = spread.where(F.col("sites").between(low, high)).select("h1", "h2")
    exact = seen.join(near, ["h1", "h2"], "left_semi").distinct().groupBy("h1", "h2").agg(F.count("*").alias("sites"))
    return spread.where(F.col("sites") > high).select("h1", "h2").union(exact.where(F.col("sites") >= min_sites).select("h1", "h2"))


def unused(columns: list[str], name: str) -> str:
    """name, with underscores added until no column (in any case) begins so."""
    while any(c.lower().startswith(name.lower()) for c in columns):
        name = f"_{name}"
    return name


def without_boilerplate(docs: DataFrame, text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> tuple[DataFrame, Column]:
    """docs with its text column replaced by the text without boilerplate lines, and one more column; and that column, a struct of
    n_lines and n_removed.

    A null text stays null, an empty one empty (one empty line, never removed). Rows that repeat are treated alike, as
    removal depends on the text alone; texts of any length are cut whole, and as lines are counted, not ranked, there are no
    ties. All other columns, whatever their names, stay as they are.
    """
    ws = Workspace(docs.sparkSession)
    bad = ws.table(boilerplate(docs, ws, text_col, site_col, min_sites), "boilerplate")
    name = unused(docs.columns, "_line_dedup")
    key, places = f"{name}_key", f"{name}_places"
    keyed = docs.withColumn(name, F.struct(*text_key(F.col(text_col))))
    lines = keyed.select(F.col(name).alias("key"), F.posexplode(_lines(F.col(text_col))).alias("at", "line")).where(F.trim("line") != "")
    found = lines.select("key", "at", *_line_key(F.col("line"))).join(bad, ["h1", "h2"], "left_semi")
    # written, so that the join below has bare shuffles on both sides: then Spark can split the key of a text with many copies
    remove = ws.table(found.groupBy(F.col("key").alias(key)).agg(F.collect_set("at").alias(places)), "places")
    own = _lines(F.col(text_col))
    joined = keyed.join(remove, (F.col(f"{name}._k1") == F.col(f"{key}._k1")) & (F.col(f"{name}._k2") == F.col(f"{key}._k2")), "left")
    # a one-element list binds the lines to a name, else the text would be split again for each of them
    left = lambda o: F.array_except(F.sequence(F.lit(0), F.size(o) - 1), F.col(places))
    kept = F.transform(F.array(own), lambda o: F.array_join(F.transform(left(o), lambda i: F.get(o, i)), "\n"))[0]
    counts = F.struct(F.when(F.col(text_col).isNull(), 0).otherwise(F.size(own)).cast("long").alias("n_lines"), F.coalesce(F.size(places), F.lit(0)).cast("long").alias("n_removed"))
    columns = [F.when(F.col(places).isNull() | F.col(c).isNull(), F.col(c)).otherwise(kept).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*columns, counts.alias(name)), F.col(name)


def line_report(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """doc_id, n_lines, n_removed, n_chars (code points kept) and kept_sha256 (of the text without boilerplate lines; null text: empty)."""
    text = F.coalesce("text", F.lit(""))
    out, counts = without_boilerplate(docs.select("doc_id", "text", "source"), min_sites=min_sites)
    return out.select("doc_id", counts["n_lines"].alias("n_lines"), counts["n_removed"].alias("n_removed"), F.length(text).cast("long").alias("n_chars"), F.sha2(text, 256).alias("kept_sha256"))


LINES_SQL = f"""
WITH lines AS (
  SELECT d.doc_id, d.source, u.pos, u.line
  FROM documents d, LATERAL (SELECT unnest(string_split(coalesce(d.text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(d.text, ''), chr(10)), 1) AS pos) u
), bad AS (
  SELECT trim(line) AS line FROM lines WHERE trim(line) <> '' GROUP BY 1 HAVING count(DISTINCT source) >= {MIN_SITES}
), kept AS (
  SELECT l.doc_id, count(b.line) AS n_removed, count(*) AS n_lines,
         coalesce(string_agg(CASE WHEN b.line IS NULL THEN l.line END, chr(10) ORDER BY l.pos), '') AS text
  FROM lines l LEFT JOIN bad b ON trim(l.line) = b.line GROUP BY l.doc_id
)
SELECT k.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE k.n_lines END AS n_lines, k.n_removed,
       length(k.text)::BIGINT AS n_chars, sha256(k.text) AS kept_sha256
FROM kept k JOIN documents d USING (doc_id)
"""


def cleaned(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """docs without boilerplate lines, its n_chars (if there is one) renewed where lines went; no row is dropped."""
    out, counts = without_boilerplate(docs, min_sites=min_sites)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(counts["n_removed"] > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select([F.col(f"`{c}`") for c in docs.columns])
