"""Exact order statistics of many columns, without sorting them.

The range of every column is cut into cells of equal width, and one partially
aggregated groupBy counts the values in each; the cells that hold wanted ranks
become the next ranges, until they are small. Then their values are counted as
histograms and the wanted ranks are read off. Where equal widths do not part the
values (many magnitudes, or one far outlier), the next cells are of equal width
in the exponent, so a few rounds do for any doubles. All counts are exact, no
task merges more than counts of cells, and the driver sees only those.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from gainsieve.sources.local import local_frame
from gainsieve.sources.workspace import Workspace

MAX_DISTINCT = 200_000
FEW_VALUES = 1_000
#: Cells of one counting pass over all columns, and of each range at least.
CELLS, CELLS_OF_RANGE = 1 << 16, 16


@dataclass
class Bracket:
    """Closed value range [lo, hi] that holds the wanted 0-based ranks; by_exponent: how its cells are cut."""

    lo: float
    hi: float
    before: int
    rows: int
    distinct: float
    ranks: list[int] = field(default_factory=list)
    by_exponent: bool = False


def bucketized(df: DataFrame, splits: dict[str, list[float]], suffix: str) -> DataFrame:
    """Add ``col + suffix``: how many of the column's cut points are <= the value.

    The open-ended outer buckets make every bucket half open, [a, b). NaN gets the
    number of cut points + 1, NULL stays NULL.
    """
    if not splits:
        return df
    columns = list(splits)
    outputs = [c + suffix for c in columns]
    bucketizer = Bucketizer(
        splitsArray=[[-math.inf, *splits[c], math.inf] for c in columns],
        inputCols=columns,
        outputCols=outputs,
        handleInvalid="keep",
    )
    return bucketizer.transform(df).withColumns({o: F.col(o).cast("int") for o in outputs})


def profile_columns(df: DataFrame, numeric: list[str], others: list[str]) -> tuple[dict[str, dict], dict[str, int]]:
    """One scan over all columns.

    Numeric: rows without null and NaN, missing rows, min, max, rough distinct count. Others: nulls.
    """
    aggs = []
    for i, c in enumerate(numeric):
        v = f"nullif(double(`{c}`), double('NaN'))"
        wanted = ("n", "count"), ("lo", "min"), ("hi", "max"), ("d", "approx_count_distinct")
        aggs += [f"{fn}({v}) as {out}{i}" for out, fn in wanted]
    aggs += [f"count(`{c}`) as k{i}" for i, c in enumerate(others)]
    row = df.agg(F.count("*").alias("rows"), *[F.expr(a) for a in aggs]).first()
    profile = {
        c: {"n": row[f"n{i}"], "missing": row["rows"] - row[f"n{i}"], "min": row[f"lo{i}"], "max": row[f"hi{i}"], "distinct": row[f"d{i}"]}
        for i, c in enumerate(numeric)
    }
    return profile, {c: row["rows"] - row[f"k{i}"] for i, c in enumerate(others)}


def profile_numeric(df: DataFrame, columns: list[str]) -> dict[str, dict]:
    return profile_columns(df, columns, [])[0] if columns else {}


def _segmented(data: DataFrame, brackets: dict[str, list[Bracket]]) -> DataFrame:
    """Add ``col__seg`` for each column of brackets: 2 i + 1 in its bracket i, even numbers in the gaps between."""
    splits = {v: [e for b in bs for e in (b.lo, math.nextafter(b.hi, math.inf)) if math.isfinite(e)] for v, bs in brackets.items()}
    cut = bucketized(data.select(*brackets), {v: edges for v, edges in splits.items() if edges}, "__seg")
    # a bracket that begins with minus infinity has no cut point before it
    first = {v: int(bs[0].lo == -math.inf) for v, bs in brackets.items()}
    return cut.withColumns({f"{v}__seg": F.col(f"{v}__seg") + first[v] if splits[v] else F.lit(1) for v in brackets})


def _long_segments(df: DataFrame, brackets: dict[str, list[Bracket]], names: dict[str, int]) -> DataFrame:
    """One row (col, seg, v) per value; odd segments are brackets, even ones the gaps between."""
    cut = _segmented(df, brackets)
    cells = [F.struct(F.lit(names[c]).alias("col"), F.col(f"{c}__seg").alias("seg"), F.col(c).alias("v")) for c in brackets]
    return cut.select(F.explode(F.array(*cells)).alias("s")).select("s.*").filter(F.col("v").isNotNull() & ~F.isnan("v"))


def attach_values(df: DataFrame, profile: dict[str, dict], few: int = FEW_VALUES) -> None:
    """Put the whole value histogram of columns with few values into their profile (one scan)."""
    columns = [c for c, p in profile.items() if p["n"] and p["distinct"] <= few and "values" not in p]
    if not columns:
        return
    cells = [F.struct(F.lit(i).alias("col"), F.col(f"`{c}`").cast("double").alias("v")) for i, c in enumerate(columns)]
    long = df.select(F.explode(F.array(*cells)).alias("s")).select("s.*")
    counted = long.filter(F.col("v").isNotNull() & ~F.isnan("v")).groupBy("col", "v").agg(F.count("*").alias("n"))
    for c in columns:
        profile[c]["values"] = []
    for r in counted.collect():  # columns x few
        profile[columns[r["col"]]]["values"].append((r["v"], r["n"]))
    for c in columns:
        profile[c]["values"].sort()
        profile[c]["distinct"] = len(profile[c]["values"])


def _ranks_from_values(values: list[tuple[float, int]], ranks: list[int]) -> dict[int, float]:
    found, upto, wanted = {}, 0, sorted(set(ranks))
    for v, n in values:
        upto += n
        while wanted and wanted[0] < upto:
            found[wanted.pop(0)] = v
    return found


def _exponent_sql(v: str) -> str:
    """Rises with v over all doubles, infinities too, by about 1 for each doubling of its size."""
    return f"signum({v}) * (coalesce(least(log2(abs({v})), 1100D), 0D) + 1076D)"


def _exponent(v: float) -> float:
    return math.copysign((min(math.log2(abs(v)), 1100.0) if abs(v) > 0 else 0.0) + 1076.0, v) if v else 0.0


def _cell_sql(value: str, seg: str, brackets: list[Bracket], cells: int) -> str:
    """The cell 0..cells-1 of a value in odd segment seg: rises with the value, whatever the rounding; 0 in gaps."""

    def numbers(values: list[float]) -> str:
        return "array(" + ", ".join(f"{v!r}D" for v in values) + ")"

    starts, widths = [], []
    for b in brackets:
        lo, hi = (_exponent(b.lo), _exponent(b.hi)) if b.by_exponent else (b.lo, b.hi)
        starts.append(lo)
        widths.append(max((hi - lo) / cells, 5e-324))
    at = f"get({{}}, ({seg} - 1) div 2)"
    scaled = f"IF({at.format('array(' + ', '.join(str(b.by_exponent).lower() for b in brackets) + ')')}, {_exponent_sql(value)}, {value})"
    place = f"floor(({scaled} - {at.format(numbers(starts))}) / {at.format(numbers(widths))})"
    return f"IF({seg} % 2 = 1, cast(greatest(0D, least({cells - 1}D, double({place}))) as int), 0)"


def _counted_cells(data: DataFrame, brackets: dict[str, list[Bracket]], names: dict[str, int], cells: int) -> dict[str, list[Row]]:
    """For each column its non-empty cells (seg, cell, n, lo, hi) in order of their values: one scan of all columns."""
    each = max(CELLS_OF_RANGE, cells // sum(map(len, brackets.values())))
    cut = _segmented(data, brackets)
    rows = [
        F.struct(F.lit(names[v]).alias("col"), F.col(f"{v}__seg").alias("seg"), F.expr(_cell_sql(v, f"{v}__seg", bs, each)).alias("cell"), F.col(v).alias("v"))
        for v, bs in brackets.items()
    ]
    long = cut.select(F.explode(F.array(*rows)).alias("s")).select("s.*").filter(F.col("v").isNotNull() & ~F.isnan("v"))
    counted = long.groupBy("col", "seg", "cell").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    out: dict[str, list[Row]] = {v: [] for v in brackets}
    back = {i: v for v, i in names.items()}
    for r in counted.collect():  # as many rows as cells
        out[back[r["col"]]].append(r)
    return {v: sorted(rs, key=lambda r: (r["seg"], r["cell"])) for v, rs in out.items()}


def _narrowed(held: list[Bracket], cells: list[Row]) -> list[Bracket]:
    """The cells that hold wanted ranks, as ranges. A cell with most of its range's rows is cut by the exponent next, or back."""
    wanted = sorted(r for b in held for r in b.ranks)
    out = []
    for s, at, here in _place(wanted, cells):
        old = held[(s["seg"] - 1) // 2]
        stuck = 4 * s["n"] > old.rows
        by_exponent = stuck != old.by_exponent if stuck else False
        out.append(Bracket(s["lo"], s["hi"], at, s["n"], s["n"], here, by_exponent or math.isinf(s["hi"] - s["lo"])))
    return out


def _place(wanted: list[int], segments: list[Row]) -> list[tuple[Row, int, list[int]]]:
    """Which wanted ranks lie in which counted segment, with the rows before the segment."""
    placed, before = [], 0
    for s in segments:
        here = [r for r in wanted if before <= r < before + s["n"]]
        if here:
            placed.append((s, before, here))
        before += s["n"]
    return placed


def order_statistics(
    df: DataFrame,
    ranks: dict[str, list[int]],
    profile: dict[str, dict],
    ws: Workspace,
    max_distinct: int = MAX_DISTINCT,
    cells: int = CELLS,
) -> dict[str, dict[int, float]]:
    """``{column: {rank: value}}`` for 0-based ranks of the sorted column (null and NaN left out).

    ``profile`` comes from :func:`profile_numeric`. The result is as large as the
    list of ranks, never as the data.
    """
    attach_values(df, {c: profile[c] for c in ranks}, min(FEW_VALUES, max_distinct))
    found: dict[str, dict[int, float]] = {}
    brackets: dict[str, list[Bracket]] = {}
    plain: dict[str, str] = {}
    for i, (c, wanted) in enumerate(ranks.items()):
        p = profile[c]
        if not p["n"]:
            found[c] = {}
        elif "values" in p:
            found[c] = _ranks_from_values(p["values"], wanted)
        else:
            found[c] = {r: p["min"] if r <= 0 else p["max"] for r in wanted if r <= 0 or r >= p["n"] - 1}
            inner = sorted({r for r in wanted if 0 < r < p["n"] - 1})
            if inner:
                plain[f"v{i}"] = c
                brackets[f"v{i}"] = [Bracket(p["min"], p["max"], 0, p["n"], p["distinct"], inner)]
    if not brackets:
        return found
    data = df.select(*[F.col(f"`{c}`").cast("double").alias(v) for v, c in plain.items()])
    names = {v: i for i, v in enumerate(plain)}
    order = list(plain)

    def settled(b: Bracket) -> bool:
        return b.lo == b.hi

    for held in brackets.values():
        for b in held:
            b.by_exponent = math.isinf(b.hi - b.lo)
    while any(b.distinct > max_distinct for held in brackets.values() for b in held):
        wide = {v: [b for b in held if b.distinct > max_distinct] for v, held in brackets.items()}
        wide = {v: held for v, held in wide.items() if held}
        counted = _counted_cells(data, wide, names, cells)
        for v, held in wide.items():
            narrow = [b for b in brackets[v] if b.distinct <= max_distinct]
            for b in _narrowed(held, counted[v]):
                if settled(b):
                    found[plain[v]].update(dict.fromkeys(b.ranks, b.lo))
                else:
                    narrow.append(b)
            brackets[v] = sorted(narrow, key=lambda b: b.lo)
    brackets = {v: held for v, held in brackets.items() if held}
    if not brackets:
        return found
    # small enough: count the values inside the ranges one by one
    long = _long_segments(data, brackets, names).filter(F.col("seg") % 2 == 1)
    histogram = ws.table(long.groupBy("col", "seg", F.col("v").alias("value")).agg(F.count("*").alias("n")), "bracket-values")
    targets = [(names[v], 2 * i + 1, r - b.before, r) for v, held in brackets.items() for i, b in enumerate(held) for r in b.ranks]
    w = Window.partitionBy("col", "seg").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cumulated = histogram.withColumn("upto", F.sum("n").over(w))  # at most max_distinct values in a range
    wanted = local_frame(df.sparkSession, targets, "col int, seg int, local bigint, rank bigint")
    hits = cumulated.join(wanted, ["col", "seg"]).filter((F.col("upto") > F.col("local")) & (F.col("upto") - F.col("n") <= F.col("local")))
    for row in hits.select("col", "rank", "value").collect():
        found[plain[order[row["col"]]]][row["rank"]] = row["value"]
    return found


def kth_largest(df: DataFrame, column: str, k: int, cells: int = 4096):
    """The k-th largest value of an exact numeric column (integers or decimals without a fraction), or None when there are
    fewer than k; nulls do not count.

    Counts in cells of equal width between the least and the greatest value tell in which cell it is; that cell is cut in turn.
    Each round divides the range by the number of cells at least.
    """
    if k <= 0:
        return None
    kind = "decimal(38,0)"
    values = df.select(F.col(column).cast(kind).alias("v")).where("v is not null")
    whole = values.agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    if whole["n"] < k:
        return None
    lo, hi = int(whole["lo"]), int(whole["hi"])
    while lo < hi:
        width = (hi - lo) // cells + 1
        inside = values.where(f"v between cast('{lo}' as {kind}) and cast('{hi}' as {kind})")
        cell = F.expr(f"cast((v - cast('{lo}' as {kind})) div cast('{width}' as {kind}) as int)")
        counted = inside.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        for r in sorted(counted, key=lambda r: -r["cell"]):
            if k <= r["n"]:
                lo, hi = int(r["lo"]), int(r["hi"])
                break
            k -= r["n"]
    return Decimal(lo)


def median(df: DataFrame, columns: list[str], ws: Workspace, **options) -> dict[str, float | None]:
    """Exact, linearly interpolated median per column, null and NaN left out."""
    profile = profile_numeric(df, columns)
    ranks = {c: [(p["n"] - 1) // 2, p["n"] // 2] for c, p in profile.items() if p["n"]}
    stats = order_statistics(df, ranks, profile, ws, **options)
    return {c: (sum(stats[c][r] for r in ranks[c]) / 2 if c in ranks else None) for c in columns}
