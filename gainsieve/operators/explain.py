"""Explanation tables: which patterns fire, for whom, and how much they matter.

``coords`` holds (keys, pid) of every match, ``scored`` one row per instance with
the keys, ``prediction`` and the array ``probability``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gainsieve.operators.apply import assemble_vectors
from gainsieve.operators.running import ONE_TASK_ROWS
from gainsieve.sources.local import local_frame
from gainsieve.sources.workspace import Workspace


def class_probability(scored: DataFrame, cls: int, out: str = "prob") -> DataFrame:
    return scored.withColumn(out, F.element_at("probability", cls + 1))


def attach_prediction(coords: DataFrame, scored: DataFrame, keys: list[str]) -> DataFrame:
    return coords.join(scored.select(*keys, F.col("prediction").cast("int").alias("label")), keys)


def top_rows_per_class(scored: DataFrame, keys: list[str], sample: int = 30) -> DataFrame:
    """The ``round(sample / classes)`` rows with the highest probability of each predicted class.

    Rows are not restricted to the class. With at most ``sample`` rows, all of them once.
    """
    label = F.col("prediction").cast("int").alias("label")
    if scored.limit(sample + 1).count() <= sample:
        return scored.select(*keys, F.lit(-1).alias("cls"), label)
    classes = sorted(int(r[0]) for r in scored.select("prediction").distinct().collect())
    size = round(sample / len(classes))
    cells = F.array(
        *[F.struct(F.lit(c).alias("cls"), F.element_at("probability", c + 1).alias("prob")) for c in classes]
    )
    long = scored.select(*keys, label, F.explode(cells).alias("s")).select(*keys, "label", "s.*")
    w = Window.partitionBy("cls").orderBy(F.desc("prob"), *keys)
    return long.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= size).select(*keys, "cls", "label")


def pattern_counts_by_label(labelled: DataFrame, classes: list[int]) -> DataFrame:
    """(pid, n_0, n_1, ...): rows per predicted label that hold the pattern, ascending by the counts."""
    counts = labelled.groupBy("pid").agg(*[F.count_if(F.col("label") == c).alias(f"n_{c}") for c in classes])
    return counts.orderBy(*[f"n_{c}" for c in classes], "pid")


def counts_long(wide: DataFrame, classes: list[int]) -> DataFrame:
    """(pid, label, n) without zeros."""
    names = ", ".join(f"'{c}', n_{c}" for c in classes)
    long = wide.selectExpr("pid", f"stack({len(classes)}, {names}) as (label, n)")
    return long.select("pid", F.col("label").cast("int").alias("label"), "n").filter("n > 0")


def top_rows_of_class(scored: DataFrame, keys: list[str], cls: int = 1, sample: int = 30) -> DataFrame:
    mine = class_probability(scored, cls).filter(F.col("prediction") == cls)
    return mine.orderBy(F.desc("prob"), *keys).limit(sample).select(*keys, "prob")


def rows_of_class_above(scored: DataFrame, keys: list[str], cls: int = 1, threshold: float = 0.7) -> DataFrame:
    mine = class_probability(scored, cls).filter((F.col("prediction") == cls) & (F.col("prob") >= F.lit(threshold)))
    if mine.isEmpty():
        raise ValueError(f"no row of class {cls} reaches probability {threshold}")
    return mine.select(*keys, "prob")


def patterns_of_rows(coords: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pid) of the selected rows; patterns without a hit do not appear."""
    return coords.join(rows.select(*keys), keys, "left_semi")


def pattern_support(coords: DataFrame) -> DataFrame:
    return coords.groupBy("pid").agg(F.count("*").alias("n"))


def item_pairs(
    coords: DataFrame, scored: DataFrame, patterns: DataFrame, keys: list[str], cls: int | None = None,
    threshold: float = -1.0, max_rows: int = 10,
) -> DataFrame:
    """(c1, c2, keys, class): first two items of longer patterns, for the first rows above the threshold.

    Without a class: for each class that is predicted, its own first rows.
    """
    longer = patterns.filter(F.col("len") >= 2).select(
        "pid", F.element_at("names", 1).alias("c1"), F.element_at("names", 2).alias("c2")
    )
    if cls is None:
        classes = scored.select(F.col("prediction").cast("int").alias("class")).distinct()
        each = F.transform("probability", lambda p, i: F.struct(i.cast("int").alias("class"), p.alias("prob")))
        above = scored.select(*keys, F.explode(each).alias("s")).select(*keys, "s.*").join(classes, "class", "left_semi")
    else:
        above = class_probability(scored, cls).select(*keys, F.lit(cls).alias("class"), "prob")
    above = above.filter(F.col("prob") > F.lit(threshold)).drop("prob")
    hits = coords.join(longer, "pid").join(above, keys)
    rows = hits.select("class", *keys).distinct()
    # max_rows of each class
    first = rows.withColumn("_rn", F.row_number().over(Window.partitionBy("class").orderBy(*keys))).filter(F.col("_rn") <= max_rows)
    return hits.join(first, ["class", *keys], "left_semi").select("c1", "c2", *keys, "class")


def patterns_by_class(
    coords: DataFrame, scored: DataFrame, patterns: DataFrame, keys: list[str], cls: int = 1, threshold: float = -1.0
) -> DataFrame:
    """(pid, name, len) of patterns seen in rows with a probability above the threshold."""
    above = class_probability(scored, cls).filter(F.col("prob") > F.lit(threshold)).select(*keys)
    seen = coords.join(above, keys, "left_semi").select("pid").distinct()
    return patterns.join(seen, "pid", "left_semi").select("pid", "name", "len").orderBy("name")


def group_patterns(patterns: DataFrame) -> DataFrame:
    """(len, first, rest): patterns of length 1, 2 and 3 by their first item; rest is sorted."""
    rest = F.array_join(F.slice("names", 2, 3), ", ")
    cut = patterns.filter(F.col("len").between(1, 3)).select("len", F.element_at("names", 1).alias("first"), rest.alias("rest"))
    return cut.groupBy("len", "first").agg(F.array_sort(F.collect_list("rest")).alias("rest"))


def condense_names(patterns: DataFrame) -> DataFrame:
    """(prefix, ranges): the columns of a pattern joined by ':', and all their values.

    Patterns come in name order, and each adds the values of its items in item order.
    """
    columns = F.array_join(F.transform("names", lambda n: F.substring_index(n, "=", 1)), ":")
    values = F.transform("names", lambda n: F.regexp_replace(F.element_at(F.split(n, "=", 2), 2), r"[\[\]]", ""))
    listed = patterns.select(columns.alias("prefix"), "name", values.alias("values"))
    ordered = F.array_sort(F.collect_list(F.struct("name", "values")))
    return listed.groupBy("prefix").agg(F.flatten(F.transform(ordered, lambda x: x["values"])).alias("ranges"))


def explain_rows(
    coords: DataFrame, patterns: DataFrame, scored: DataFrame, keys: list[str], rows: DataFrame, actual: str | None = None
) -> DataFrame:
    """(keys, prediction, pid, name) of the given rows; ``rows`` holds their keys. ``actual`` names scored's column with the true
    class, which then stands beside the predicted one."""
    true = [] if actual is None else [F.col(actual).cast("int").alias("actual")]
    chosen = scored.join(rows.select(*keys), keys, "left_semi").select(*keys, F.col("prediction").cast("int").alias("prediction"), *true)
    beside = [] if actual is None else ["actual"]
    return coords.join(chosen, keys).join(patterns.select("pid", "name"), "pid").select(*keys, "prediction", *beside, "pid", "name")


def explain_row(coords: DataFrame, patterns: DataFrame, scored: DataFrame, key: dict) -> DataFrame:
    chosen, hits = scored, coords
    for k, v in key.items():
        chosen, hits = chosen.filter(F.col(k) == F.lit(v)), hits.filter(F.col(k) == F.lit(v))
    return explain_rows(hits, patterns, chosen, list(key), chosen)


def random_row(scored: DataFrame, keys: list[str], cls: int = 1, threshold: float = 0.0, seed: int = 0) -> DataFrame:
    """One row above the threshold, by seeded key hash, so that the choice does not depend on partitions."""
    above = class_probability(scored, cls).filter(F.col("prob") > F.lit(threshold))
    return above.orderBy(seeded(keys, F.lit(seed)), *keys).limit(1)


def seeded(keys: list[str], *more: Column) -> Column:
    """A hash of a row's keys and a seed by which rows are drawn or permuted; any engine can compute it."""
    return F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in keys], *[m.cast("string") for m in more]).cast("binary"))


def probability_histogram(scored: DataFrame, classes: list[int], bins: int = 10) -> DataFrame:
    """(cls, bucket, n): rows per probability bucket 1..bins; 1.0 belongs to the last bucket."""
    cells = F.array(*[F.struct(F.lit(c).alias("cls"), F.element_at("probability", c + 1).alias("p")) for c in classes])
    long = scored.select(F.explode(cells).alias("s")).select("s.*")
    bucket = F.least(F.floor(F.col("p") * F.lit(float(bins))) + F.lit(1), F.lit(bins)).cast("int")
    return long.groupBy("cls", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def coefficient_importance(coefficients: list[float], patterns: DataFrame, top: int = 10) -> DataFrame:
    """(pid, name, coefficient, importance) with the largest absolute coefficients."""
    coefs = local_frame(patterns.sparkSession, list(enumerate(map(float, coefficients))), "pid int, coefficient double")
    joined = patterns.select("pid", "name").join(coefs, "pid").withColumn("importance", F.abs("coefficient"))
    return joined.orderBy(F.desc("importance"), "pid").limit(top)


def _state_codes(rows: DataFrame, ws: Workspace) -> tuple[DataFrame, dict, Column]:
    """(y, pids, state) of the distinct (y, pids), the number of rows, and the expression of state: a hash that tells all of them apart."""
    for salt in range(8):
        parts = [F.lit(salt), F.col("y").isNull(), F.col("y"), F.col("pids").isNull(), F.size("pids"), F.col("pids")]
        code = F.xxhash64(*parts)
        states = rows.groupBy("y", "pids").agg(F.count("*").alias("n")).withColumn("state", code)
        states, size = ws.counted(states, "importance-states", F.count("*").alias("states"), F.countDistinct("state").alias("codes"), F.sum("n").alias("rows"))
        if size["states"] == size["codes"]:
            return states.drop("n"), size, code
    raise ValueError("no hash tells the rows' classes and patterns apart")


def permutation_importance(
    matched: DataFrame, model, patterns: DataFrame, keys: list[str], ws: Workspace, n_patterns: int,
    repeats: int = 10, seed: int = 0, top: int = 10, one_task_rows: int | None = None,
) -> DataFrame:
    """(pid, name, mean, sd): accuracy lost when a pattern's column is permuted.

    ``matched`` holds keys, y and pids. Each repeat is one seeded random cycle over the
    rows, so a row takes the column of its successor. Only cells that change are scored
    again, and equal (row, successor, class) triples are scored once with their count.

    A row travels once for each repeat, as its keys and a code of (y, pids), to the part of the cycle its hash belongs to;
    parts have ``one_task_rows`` rows or so, and are linked by their ends.
    """
    own = [f"_key{i}" for i in range(len(keys))]
    rows = ws.table(matched.select(*[F.col(k).alias(o) for k, o in zip(keys, own)], F.col("y").cast("int").alias("y"), "pids"), "importance-rows")
    states, size, code = _state_codes(rows, ws)
    n = size["rows"] or 0
    most, digits = max(ONE_TASK_ROWS if one_task_rows is None else one_task_rows, 1), 0
    while n > most * 16**digits:
        digits += 1
    tasks = max(-(-n * repeats // most), 1)
    spread = rows.select(*own, code.alias("state"), F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("rep"))
    hashed = seeded(own, F.col("rep"), F.lit(seed))
    # the hash is made again where the row arrives: it would be most of what is shuffled
    spread = spread.withColumn("_part", F.substring(hashed, 1, digits)).repartition(tasks, "rep", "_part").withColumn("_h", F.unhex(hashed))
    along = Window.partitionBy("rep", "_part").orderBy("_h", *own, "state")
    turned = spread.select("rep", "_part", "state", F.lead("state").over(along).alias("next"), F.lag("state").over(along).isNull().alias("first"))
    last = F.col("next").isNull()
    steps = turned.groupBy("rep", F.when(F.col("first") | last, F.col("_part")).alias("_part"), "first", "state", "next").agg(F.count("*").alias("w"))
    steps = ws.table(steps, "importance-steps")
    heads = steps.filter("first").select("rep", "_part", F.col("state").alias("head"))
    ends = steps.filter(last).select("rep", "_part", "state").join(heads, ["rep", "_part"])
    parts = Window.partitionBy("rep").orderBy("_part")
    whole = parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    links = ends.select("rep", "state", F.coalesce(F.lead("head").over(parts), F.first("head").over(whole)).alias("next"), F.lit(1).cast("bigint").alias("w"))
    pairs = steps.filter(~last).select("rep", "state", "next", "w").unionByName(links).groupBy("rep", "state", "next").agg(F.sum("w").alias("w"))
    triples = (
        pairs.join(states, "state")
        .join(states.select(F.col("state").alias("next"), F.col("pids").alias("other")), "next")
        .withColumn("changed", F.array_union(F.array_except("pids", "other"), F.array_except("other", "pids")))
    )
    cells = triples.select("rep", "y", "pids", "w", F.explode("changed").alias("pid"))
    flipped = F.when(F.array_contains("pids", F.col("pid")), F.array_remove("pids", F.col("pid"))).otherwise(
        F.array_sort(F.array_append("pids", F.col("pid")))
    )
    cells = cells.groupBy("rep", "y", "pid", "pids").agg(F.sum("w").alias("w")).withColumn("new_pids", flipped)

    def correct(df: DataFrame, column: str, out: str) -> DataFrame:
        scored = model.transform(assemble_vectors(df, n_patterns, column, "features"))
        hit = (F.col("prediction").cast("int") == F.col("y")).cast("int")
        return scored.withColumn(out, hit).drop("features", "rawPrediction", "probability", "prediction")

    both = correct(correct(cells, "pids", "was"), "new_pids", "now")
    loss = both.groupBy("pid", "rep").agg((F.sum((F.col("was") - F.col("now")) * F.col("w")) / F.lit(float(n))).alias("drop"))
    grid = patterns.select("pid", "name", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("rep"))
    filled = grid.join(loss, ["pid", "rep"], "left").withColumn("drop", F.coalesce("drop", F.lit(0.0)))
    summary = filled.groupBy("pid", "name").agg(F.avg("drop").alias("mean"), F.stddev_pop("drop").alias("sd"))
    return summary.orderBy(F.desc("mean"), "pid").limit(top)
