"""Column names for helpers that no column of a user's table has."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import replace
from functools import wraps

from pyspark.sql import DataFrame

#: What matching calls its own columns: codes b_0, l_0 ..., and names with a leading underscore.
CODE_NAMES = re.compile(r"_|[bl]_\d", re.I)


def free(taken: list[str], *names: str) -> list[str]:
    """Each name, with underscores added until no name of taken equals it in any case."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def keeps_columns(match: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """match(df, numeric, cats, ...) where columns of df, features too, may have the names that matching gives to its helpers:
    such columns bear other names meanwhile. Columns that match adds (out, ids_out) replace those of the same name."""

    @wraps(match)
    def run(df, numeric, cats, *args, **kwargs):
        made = {kwargs.get("out"), kwargs.get("ids_out")}
        clash = [c for c in df.columns if CODE_NAMES.match(c) and c not in made]
        if not clash:
            return match(df, numeric, cats, *args, **kwargs)
        aside = dict(zip(clash, free(df.columns, *[f"own{i}" for i in range(len(clash))])))
        named = [replace(c, name=aside.get(c.name, c.name)) for c in numeric]
        out = match(df.withColumnsRenamed(aside), named, [aside.get(c, c) for c in cats], *args, **kwargs)
        return out.withColumnsRenamed({v: k for k, v in aside.items()})

    return run
