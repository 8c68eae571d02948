"""Column expressions shared by the operators: rounding, entropy, gain, association.

Functions over class counts take the *name* (or SQL text) of an ``array<bigint>``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICRO = 1_000_000


def round6(x: Column) -> Column:
    """Half-up rounding to 6 decimals: floor(x * 1e6 + 0.5) / 1e6."""
    return F.floor(x * F.lit(1e6) + F.lit(0.5)).cast("double") / F.lit(1e6)


def micros(x: Column) -> Column:
    """A score as a whole number of millionths, so that sums are exact in any order."""
    return F.floor(x * F.lit(1e6) + F.lit(0.5)).cast("bigint")


def from_micros(x: Column) -> Column:
    return x.cast("double") / F.lit(1e6)


def total_sql(counts: str) -> str:
    return f"aggregate({counts}, 0L, (s, c) -> s + c)"


def _entropy_sql(counts: str) -> str:
    # ln(n) - sum(c ln c) / n would cancel badly for large counts, so proportions are used.
    n = f"double({total_sql(counts)})"
    return f"(0D - aggregate({counts}, 0D, (s, c) -> s + if(c > 0, c / {n} * ln(c / {n}), 0D)))"


def array_total(counts: str) -> Column:
    return F.expr(total_sql(counts))


def entropy(counts: str, base: int | None = None) -> Column:
    """Entropy of an array of counts; natural log, or log of the given base. NULL without rows."""
    scale = f" / ln({float(base)}D)" if base is not None else ""
    return F.expr(f"if({total_sql(counts)} > 0, {_entropy_sql(counts)}{scale}, NULL)")


def information_gain(counts: str, parent: str) -> Column:
    """Gain of the split in / not in, inside the parent's class counts.

    NULL when the set covers its parent, which then fails every ``gain > G`` filter.
    """
    rest = f"zip_with({parent}, {counts}, (p, c) -> p - c)"
    n = f"double({total_sql(parent)})"
    return F.expr(
        f"if({total_sql(rest)} > 0, {_entropy_sql(parent)}"
        f" - {total_sql(counts)} / {n} * {_entropy_sql(counts)}"
        f" - {total_sql(rest)} / {n} * {_entropy_sql(rest)}, NULL)"
    )


def pure_class(counts: str) -> Column:
    """The only class that occurs, else -1."""
    n = total_sql(counts)
    return F.expr(f"if({n} > 0 and array_max({counts}) = {n}, int(array_position({counts}, {n})) - 1, -1)")


def correlation(sx: str, sxx: str, sxy: str, n: float, sy: float, syy: float) -> Column:
    """Pearson correlation from sums (SQL text for x, numbers for y); 0 when either side is constant."""
    var_x, var_y = f"({sxx} - {sx} * {sx} / {n!r}D)", f"({syy!r}D - {sy!r}D * {sy!r}D / {n!r}D)"
    cov = f"({sxy} - {sx} * {sy!r}D / {n!r}D)"
    return F.expr(f"if({var_x} > 0 and {var_y} > 0, {cov} / sqrt({var_x} * {var_y}), 0D)")


def nmi_indicator(counts: str, totals: str) -> Column:
    """Normalised mutual information of an indicator with the class, from class counts.

    ``counts`` holds the class counts where the indicator is 1, ``totals`` of all rows.
    """
    n = f"double({total_sql(totals)})"

    def bits(values: str) -> str:
        return f"aggregate({values}, 0D, (s, c) -> s - if(c > 0, c / {n} * log2(c / {n}), 0D))"

    ones, rest = total_sql(counts), f"zip_with({totals}, {counts}, (t, c) -> t - c)"
    h_x = bits(f"array({ones}, {total_sql(totals)} - {ones})")
    h_y = bits(totals)
    h_xy = f"({bits(counts)} + {bits(rest)})"
    return F.expr(f"if({h_x} * {h_y} > 0, ({h_x} + {h_y} - {h_xy}) / sqrt({h_x} * {h_y}), 0D)")


def class_count_columns(y: str, n_classes: int) -> list[Column]:
    """Aggregates ``c0 .. cK-1``: rows per class."""
    return [F.expr(f"count_if({y} = {j})").alias(f"c{j}") for j in range(n_classes)]


def class_columns(n_classes: int) -> list[str]:
    return [f"c{j}" for j in range(n_classes)]


def class_array(n_classes: int) -> Column:
    return F.expr(f"array({', '.join(class_columns(n_classes))})")


def class_rows(n_classes: int) -> Column:
    return F.expr(" + ".join(class_columns(n_classes)))


def sum_class_counts(n_classes: int) -> list[Column]:
    return [F.sum(c).alias(c) for c in class_columns(n_classes)]


def bigint_array_sql(values) -> str:
    return "array(" + ", ".join(f"{int(v)}L" for v in values) + ")"
