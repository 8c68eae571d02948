"""Mixing sources to target weights by weighted fair queueing.

Documents are shuffled by a hash of their id. Each pass of a document (a source may be passed ``max_repeats`` times) gets a
virtual finish time: the words of its source up to its end, divided by the source's weight. All passes of all sources are
sorted by it over the whole cluster, in ranges, and running sums over that order tell how much has been served when each ends:
all of the sources that have run out by then, and of the others their weight times the virtual time. The order is truncated
in the first pass at whose end the total budget is used up. Service is fluid, as in fair queueing, so at that time each source
has a document in service, which is cut there; a source that ran out before has left its excess to the others by weight.

Running sums within a source are taken in two steps: within buckets of its shuffled order, and over the buckets' sums. A source
with a third of all rows is spread over its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gainsieve.sources.workspace import Workspace

#: Weights that sources take in turn, by code point, null last.
WEIGHTS = (3, 1, 2)
#: The mix's words as a share of all words.
BUDGET = 1.5
MAX_REPEATS = 2
SEED = "mix-1"
#: Buckets of the shuffled order; the first hex digits of the hash.
BUCKET_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _ranged(df: DataFrame, ws: Workspace, order: list[Column], name: str) -> DataFrame:
    """df range-partitioned and sorted, with its partition in _part: written, so that every reader sees one layout."""
    return ws.table(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), name)


def _running(df: DataFrame, ws: Workspace, order: list[Column], sums: dict[str, str], name: str) -> DataFrame:
    """Sums over all rows before each row in a global order; ties in the order must be equal rows. Each task takes one range."""
    parts = _ranged(df, ws, order, name)
    w = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy("_part").agg(*[F.sum(c).alias(f"_t_{out}") for out, c in sums.items()])
    over = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as range partitions
    offsets = totals.select("_part", *[F.coalesce(F.sum(f"_t_{out}").over(over), F.lit(0)).alias(f"_o_{out}") for out in sums])
    zero = F.lit(0)
    return parts.withColumns({f"_w_{out}": F.coalesce(F.sum(c).over(w), zero) for out, c in sums.items()}).join(offsets, "_part").select(
        *df.columns, *[(F.col(f"_w_{out}") + F.col(f"_o_{out}")).alias(out) for out in sums]
    )


def source_weights(sizes: DataFrame, ws: Workspace, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, weight from a table (source, source_size) of any number of sources: weights in turn, null last."""
    ranked = _running(sizes.withColumn("one", F.lit(1)), ws, [F.col("source").isNull(), F.col("source")], {"place": "one"}, "places")
    weight = F.get(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights)).cast("int"))
    return ws.table(ranked.select("source", "source_size", weight.alias("weight")), "weights")


def virtual_time(passes: DataFrame, sources: DataFrame, ws: Workspace, budget: float = BUDGET, max_repeats: int = MAX_REPEATS) -> float:
    """The virtual time at which budget times all words are served, from the passes (finish, cap, weight, last: whether its
    source has run out then, and columns that settle ties), sorted by finish."""
    # a source without words is served nothing and takes no share
    total = sources.where("source_size > 0").agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weights")).first()
    if total["words"] is None:
        return 0.0
    ends = passes.withColumns({c: F.when(F.col("last"), F.col(c)).otherwise(0) for c in ("cap", "weight")})
    queue = _running(ends, ws, [F.col("finish"), *[F.col(c) for c in passes.columns if c not in ("finish", "cap", "weight", "last")]], {"used": "cap", "gone": "weight"}, "queue")
    at = (F.lit(budget * total["words"]) - F.col("used")) / (F.lit(total["weights"]) - F.col("gone"))
    found = queue.withColumn("t", at).where("t <= finish").agg(F.min_by("t", "finish")).first()[0]
    return float("inf") if found is None else float(found)  # none: all passes together are within the budget


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET,
    max_repeats: int = MAX_REPEATS, seed: str = SEED, keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per input row: doc_id, size, source, source_size, weight, target, taken and finish (virtual time at which its
    first pass ends).

    ``taken`` counts words with repeats: whole passes, and a part of the document in service when the budget ends. Null and
    empty texts have no words and are taken zero times, texts of any length are counted whole; a null source is a source of its
    own, the last. Rows that repeat an id are served one after the other, and a null id takes its place by a hash of its text.
    Ties in the shuffled order go to the smaller id. Without any words all targets are zero; an empty table gives no rows.
    Columns named in ``keep`` come along in the struct ``kept``; others are ignored.
    """
    ws = Workspace(docs.sparkSession)
    text = F.col(text_col)
    kept = [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept")] if keep else []
    named_by = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    rows = ws.table(
        docs.select(
            F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"),
            F.md5(F.concat(F.lit(f"{seed}:"), named_by).cast("binary")).alias("key"), *([F.xxhash64(text)] if keep else [F.lit(0)]), *kept,
        ).toDF("row", "doc_id", "source", "size", "key", "tie", *(["kept"] if keep else [])),
        "sizes",
    )
    slim = rows.select("row", "doc_id", "source", "size", "key", "tie", F.substring("key", 1, BUCKET_DIGITS).alias("bucket"))
    buckets = ws.table(slim.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "buckets")
    sources = source_weights(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), ws, weights)
    before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = buckets.select("source", "bucket", before.alias("offset"))  # at most 16 ** BUCKET_DIGITS rows of a source
    named = offsets.join(sources, offsets["source"].eqNullSafe(sources["source"])).select(offsets["source"].alias("s"), F.col("bucket").alias("b"), "offset", "source_size", "weight")
    inner = Window.partitionBy("source", "bucket").orderBy("key", F.col("doc_id").asc_nulls_first(), "size", "tie").rowsBetween(Window.unboundedPreceding, 0)
    placed = slim.withColumn("upto", F.sum("size").over(inner)).join(named, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    placed = ws.table(placed.select("row", "doc_id", "source", "size", "key", "tie", "source_size", "weight", (F.col("offset") + F.col("upto")).alias("end")), "placed")
    cap = max_repeats * F.col("source_size")
    served_by = F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))).alias("pass")
    passes = placed.where("size > 0").select("*", served_by).withColumn("own", F.col("pass") * F.col("source_size") + F.col("end"))
    passes = passes.select((F.col("own") / F.col("weight")).alias("finish"), "key", "doc_id", "pass", "size", "tie", "weight", cap.alias("cap"), (F.col("own") == cap).alias("last"))
    target = F.least(cap.cast("double"), F.col("weight") * F.lit(virtual_time(passes, sources, ws, budget, max_repeats)))
    parts = [F.greatest(F.lit(0), F.least(F.col("size"), F.round("target").cast("long") - k * F.col("source_size") - F.col("end") + F.col("size"))) for k in range(max_repeats)]
    taken = sum(parts[1:], parts[0]).cast("long")
    out = placed.withColumn("target", target).withColumns({"taken": taken, "finish": F.col("end") / F.col("weight")})
    if keep:
        out = out.join(rows.select("row", "kept"), "row")
    return out.select("doc_id", "size", "source", "source_size", "weight", "target", "taken", "finish", *(["kept"] if keep else []))


def first_words(text: Column, n: Column) -> Column:
    """text up to its n-th word's end."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), n.cast("int")), "")


SERVED = ["source_size", "weight", "target", "size", "pass", "taken"]


def served(docs: DataFrame, text_col: str = "text", into: str = "mix", **options) -> DataFrame:
    """docs as the mix takes them: a row for each pass of a document, with the pass's text, which is cut if the budget ends in it,
    and one more column, a struct of SERVED: pass (from 0), taken (words of this pass), and what mix tells of its source.

    A document that the mix takes nothing of has one row, with taken 0 and an empty text. Columns of docs keep their names; the
    struct is named into, with underscores added while there is a column of that name.
    """
    while into.lower() in [c.lower() for c in docs.columns]:
        into = f"_{into}"
    mixed = mix(docs, text_col=text_col, keep=tuple(docs.columns), **options)
    last = F.when(F.col("taken") > 0, F.ceil(F.col("taken") / F.col("size")).cast("int") - 1).otherwise(0)
    passes = mixed.withColumn("pass", F.explode(F.sequence(F.lit(0), last)))
    words = F.least(F.col("size"), F.col("taken") - F.col("pass") * F.col("size"))
    text = F.col(f"kept.`{text_col}`")
    cut = F.when(F.col("taken") == 0, F.lit("")).when(F.col("taken") < F.col("size"), first_words(text, F.col("taken"))).otherwise(text)
    own = passes.withColumn("taken", words)
    return own.select(*[cut.alias(c) if c == text_col else F.col(f"kept.`{c}`").alias(c) for c in docs.columns], F.struct(*SERVED).alias(into))


MIX_SQL = f"""
WITH rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, '')))) AS key
  FROM documents
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM rows GROUP BY source
), caps AS (
  SELECT *, [3, 1, 2][(place % 3 + 1)::INT] AS weight, {MAX_REPEATS} * source_size AS cap FROM sizes
), queue AS (
  SELECT *, cap / weight AS out_at,
         coalesce(sum(cap) OVER q, 0) AS used, coalesce(sum(weight) OVER q, 0) AS gone,
         {BUDGET} * sum(source_size) OVER () AS want, sum(weight) OVER () AS weights
  FROM caps WINDOW q AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), cut AS (
  SELECT min_by(t, out_at) AS t FROM (SELECT (want::DOUBLE - used) / (weights - gone)::DOUBLE AS t, out_at FROM queue) WHERE t <= out_at
), targets AS (
  SELECT source, source_size, least(cap::DOUBLE, weight * coalesce((SELECT t FROM cut), 0.0)) AS target FROM queue
), placed AS (
  SELECT r.*, t.source_size, t.target,
         sum(size) OVER (PARTITION BY r.source ORDER BY key, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
  FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(size, round(target)::BIGINT - upto + size)) + greatest(0, least(size, round(target)::BIGINT - source_size - upto + size)))::BIGINT AS taken
FROM placed
"""
