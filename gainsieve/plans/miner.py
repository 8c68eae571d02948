"""Fit patterns on a labelled table and map any table to them."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gainsieve.functions import scores
from gainsieve.functions.names import free
from gainsieve.operators import apply as matching
from gainsieve.operators import encode, mine, prep, utility
from gainsieve.operators.encode import NumericColumn
from gainsieve.operators.lattice import Lattice, derive, grow
from gainsieve.sources.local import local_frame
from gainsieve.sources.workspace import Workspace


@dataclass
class PatternMiner:
    """Parameters of a fit.

    bins: quantile bins per numeric column, -1 picks them by information gain.
    length: longest pattern, -1 for no limit. gain: patterns need a larger information gain.
    top_k, fs_k: patterns kept by utility and then by gain, -1 for the defaults.
    class_weights: a whole number for each class, by label code (0: the most frequent). From the coded rows on a row counts
    as often as its class's number says: in scores, gains, supports and utilities, and as the classifier's row weights. Bin
    edges and label codes come from the rows as they are.
    """

    label: str
    features: list[str] | None = None
    keys: list[str] = field(default_factory=list)
    bins: int = 5
    length: int = 1
    gain: float = 1e-4
    top_k: int = -1
    fs_k: int = -1
    item_percent: float = 1.0
    minority_weight: float = 1.0
    class_weights: list[int] | None = None
    keep_duplicate: str = "lowest"
    exact_dedupe: bool = True
    max_distinct: int = encode.MAX_DISTINCT
    max_classes: int = prep.MAX_CLASSES

    def validate(self) -> None:
        for name in ("bins", "length", "top_k", "fs_k"):
            value = getattr(self, name)
            if isinstance(value, bool) or not isinstance(value, int):
                raise TypeError(f"{name} has to be an int")
        if self.gain == 0:
            self.gain = 0.0
        if not isinstance(self.gain, float):
            raise TypeError("gain has to be a float")
        if self.class_weights is not None and any(isinstance(w, bool) or not isinstance(w, int) or w < 1 for w in self.class_weights):
            raise ValueError("class_weights are whole numbers of 1 or more")
        if not self.label:
            raise ValueError("label names the class column")
        if self.length == 0 or self.length < -1:
            raise ValueError("length is at least 1, or -1 for no limit")
        if self.bins < 1 and self.bins != -1:
            raise ValueError("bins is at least 1, or -1 for automatic")

    def code(self, df: DataFrame) -> CodedTable:
        """Classes, bins, row shapes and scored items: all of a fit that length, gain and the budgets have no part in."""
        self.validate()
        spark = df.sparkSession
        ws = Workspace(spark)
        groups = prep.feature_groups(df, self.features, exclude=[self.label, *self.keys])
        if df.filter(prep.q(self.label).isNull()).limit(1).count():
            raise ValueError(f"label {self.label} has nulls; drop or fill them first")
        codes = prep.label_codes(df, self.label, self.max_classes)
        totals = [r["n"] for r in codes.orderBy("y").collect()]  # at most max_classes rows
        n_classes = len(totals)
        (y,) = free(df.columns, "_y")
        coded = prep.encode_label(df, self.label, codes, y).select(y, *[prep.q(c) for c in groups.ordered])
        options = {"max_distinct": self.max_distinct}
        numeric = encode.fit_numeric(
            coded, groups.ints, groups.floats, self.bins, y, n_classes, ws, groups.cats, **options
        )
        encoded = utility.encode_rows(coded, numeric, groups.cats)
        shapes = utility.row_shapes(encoded, len(numeric), len(groups.cats), y, n_classes)
        if self.class_weights is not None:
            if len(self.class_weights) != n_classes:
                raise ValueError(f"{len(self.class_weights)} class weights for {n_classes} classes")
            shapes = utility.weighted_shapes(shapes, self.class_weights)
            totals = [t * w for t, w in zip(totals, self.class_weights)]
        shapes = ws.table(shapes, "shapes")
        ct = utility.contingency(shapes, len(numeric), len(groups.cats), n_classes)
        ct, size = ws.counted(ct, "contingency", F.count("*").alias("n"))
        scored, items = utility.score_items(ct, numeric, groups.cats, totals, self.minority_weight, ws, size["n"])
        return CodedTable(groups, codes, totals, numeric, shapes, scored, items, size["n"], ws)

    def fit(self, df: DataFrame) -> PatternModel:
        return self.mine(self.code(df))

    def _budgets(self) -> tuple[int, int]:
        top_k = mine.default_top_k(self.length, self.top_k, self.item_percent)
        return top_k, mine.default_fs_k(self.fs_k, top_k)

    def mine(self, coded: CodedTable, lattice: Lattice | None = None) -> PatternModel:
        """The patterns of a coded table, derived from a lattice of it where that one answers."""
        self.validate()
        top_k, fs_k = self._budgets()
        derived = lattice is not None and lattice.answers(self.length, self.gain, top_k)
        if derived:
            result = derive(lattice, self.length, self.gain, top_k, fs_k, coded.ws, self.keep_duplicate)
        else:
            result = mine.mine(
                coded.shapes, coded.numeric, len(coded.groups.cats), coded.items, coded.totals, self.length, self.gain, top_k, fs_k,
                coded.ws, coded.n_codes, self.keep_duplicate, self.exact_dedupe,
            )
        return PatternModel(
            label=self.label,
            groups=coded.groups,
            codes=coded.codes,
            totals=coded.totals,
            numeric=coded.numeric,
            scored=coded.scored,
            items=coded.items,
            patterns=result.patterns,
            n_patterns=result.report["patterns_selected"],
            report={**result.report, "top_k": top_k, "fs_k": fs_k, "gain": self.gain, "length": self.length, "derived": int(derived)},
            shapes=coded.shapes,
            ranked=result.items,
            class_weights=self.class_weights,
        )

    def fit_grid(self, df: DataFrame, points: list[tuple[int, float]]) -> dict[tuple[int, float], PatternModel]:
        """The models of several (length, gain), equal to those of a fit each: the rows are coded once, and mined once for all
        points whose thresholds cannot bind (see Lattice.answers). Each of the others is mined by itself, from the same codes.
        """
        if not points:
            return {}
        coded = self.code(df)
        miners = {(length, gain): replace(self, length=length, gain=float(gain)) for length, gain in points}
        for m in miners.values():
            m.validate()
        lattice = None
        # a budget of no more than the items, or their pairs, rules a point out beforehand
        pairs = coded.n_codes * (coded.n_codes - 1) // 2
        open_points = [m for m in miners.values() if m._budgets()[0] > (pairs if m.length >= 2 else coded.n_codes)]
        if len(open_points) > 1:
            lengths = [m.length for m in open_points]
            lattice = grow(
                coded.shapes, coded.numeric, len(coded.groups.cats), coded.items, coded.totals, -1 if -1 in lengths else max(lengths),
                min(m.gain for m in open_points), max(m._budgets()[0] for m in open_points), coded.ws, coded.n_codes, self.exact_dedupe,
            )
        return {point: m.mine(coded, lattice) for point, m in miners.items()}


@dataclass
class CodedTable:
    """A labelled table in codes: row shapes with class counts, and the scored items."""

    groups: prep.FeatureGroups
    codes: DataFrame
    totals: list[int]
    numeric: list[NumericColumn]
    shapes: DataFrame
    scored: DataFrame
    items: DataFrame
    n_codes: int
    ws: Workspace


@dataclass
class PatternModel:
    label: str
    groups: prep.FeatureGroups
    codes: DataFrame
    totals: list[int]
    numeric: list[NumericColumn]
    scored: DataFrame
    items: DataFrame
    patterns: DataFrame
    n_patterns: int
    report: dict
    shapes: DataFrame | None = None
    ranked: DataFrame | None = None
    class_weights: list[int] | None = None
    inline_patterns: int = matching.INLINE_PATTERNS
    _inline: tuple | None = field(default=None, repr=False)
    _known: DataFrame | None = field(default=None, repr=False)
    _too_many: bool = field(default=False, repr=False)

    def bin_counts(self) -> list[tuple[str, int]]:
        return [(c.name, c.bins) for c in self.numeric]

    def edges(self) -> DataFrame:
        rows = [(c.name, c.kind, c.minimum, c.maximum, c.edges) for c in self.numeric]
        spark = self.items.sparkSession
        return local_frame(spark, rows, "col string, kind string, min double, max double, edges array<double>")

    def dictionary(self) -> DataFrame:
        return self.scored.filter(F.col("label").isNotNull()).select("col", "label", F.col("bin").alias("idx"))

    def pattern_names(self) -> DataFrame:
        return self.patterns.select("pid", "name")

    def report_frame(self) -> DataFrame:
        flat = [(k, float(v)) for k, v in self.report.items() if isinstance(v, (int, float))]
        for lv in self.report["levels"]:
            flat += [(f"level_{lv['length']}_{k}", float(lv[k])) for k in ("candidates", "passed_gain", "siblings_dropped", "survivors")]
        return local_frame(self.items.sparkSession, flat, "metric string, value double")

    def row_items(self, df: DataFrame) -> DataFrame:
        return matching.row_items(df, self.numeric, self.groups.cats, self.items)

    def _local_patterns(self) -> tuple[list[tuple[int, list[int]]], int]:
        """Patterns and the number of items, for at most ``inline_patterns`` patterns; read once."""
        if self._inline is None:
            local = [(r["pid"], list(r["items"])) for r in self.patterns.select("pid", "items").collect()]
            support = {}
            if self.ranked is not None:  # of the patterns' items alone
                used = self.patterns.select(F.explode("items").alias("item")).distinct()
                support = {r["item"]: r["support"] for r in self.ranked.join(used, "item", "left_semi").select("item", "support").collect()}
            self._inline = matching.balanced_anchors(local, support), self.items.agg(F.max("item")).first()[0]
        return self._inline

    def known_sets(self) -> DataFrame | None:
        """(item_ids, pids) of the training rows' distinct item sets; None when there are too many to broadcast."""
        if self._known is None and self.shapes is not None and not self._too_many:
            lookup = utility.item_lookup(self.items)
            coded = utility.with_items(self.shapes, self.numeric, len(self.groups.cats), lookup, "_items")
            sets = coded.select(F.expr("transform(_items, x -> x.id)").alias("item_ids")).distinct()
            ws = Workspace(self.items.sparkSession)
            sets = ws.table(sets, "item-sets")
            if sets.limit(matching.KNOWN_SETS + 1).count() <= matching.KNOWN_SETS:
                self._known = ws.table(matching.match_profiles(sets, self.patterns), "known-sets")
            else:
                self._too_many = True
        return self._known

    def match(self, df: DataFrame) -> DataFrame:
        """Add ``item_ids`` and the sorted matched pattern ids ``pids``."""
        if self.n_patterns == 0:
            return self.row_items(df).withColumn("pids", F.array().cast("array<int>"))
        if self.n_patterns <= self.inline_patterns:
            return matching.match_inline(
                df, self.numeric, self.groups.cats, self.items, *self._local_patterns(), known=self.known_sets()
            )
        return matching.match_rows(df, self.numeric, self.groups.cats, self.items, self.patterns, support=self.ranked)

    def transform(self, df: DataFrame) -> DataFrame:
        """``match`` plus the sparse 0/1 vector ``features``."""
        return matching.assemble_vectors(self.match(df), self.n_patterns)

    def coordinates(self, df: DataFrame, keys: list[str]) -> DataFrame:
        """(keys, pid) of every match; beyond the inline limit through the join form."""
        if self.n_patterns <= self.inline_patterns:
            return matching.coordinates(self.match(df), keys)
        return matching.match_join(self.row_items(df), self.patterns, keys, support=self.ranked)

    def density(self, df: DataFrame, keys: list[str]) -> DataFrame:
        return matching.density(self.coordinates(df, keys), df.count(), self.n_patterns)

    def training_table(self) -> DataFrame:
        """(features, y, weight): equal training rows merged, made from the row shapes."""
        k = len(self.totals)
        lookup = utility.item_lookup(self.items)
        coded = utility.with_items(self.shapes, self.numeric, len(self.groups.cats), lookup, "_items")
        rows = coded.select(F.expr("transform(_items, x -> x.id)").alias("item_ids"), *scores.class_columns(k))
        if self.n_patterns:
            rows = matching.match_profiles(rows, self.patterns)
        else:
            rows = rows.withColumn("pids", F.array().cast("array<int>"))
        merged = rows.groupBy("pids").agg(*scores.sum_class_counts(k))
        cells = F.array(*[F.struct(F.lit(j).alias("y"), F.col(f"c{j}").alias("weight")) for j in range(k)])
        long = merged.select("pids", F.explode(cells).alias("s")).select("pids", "s.*").filter("weight > 0")
        long = long.select("pids", F.col("y").cast("double").alias("y"), F.col("weight").cast("double").alias("weight"))
        return matching.assemble_vectors(long, self.n_patterns).select("features", "y", "weight")

    def save(self, path: str) -> None:
        """Write parameters, items, dictionaries and patterns as parquet under ``path``."""
        self.codes.write.parquet(f"{path}/classes")
        self.edges().coalesce(1).write.parquet(f"{path}/edges")
        self.scored.write.parquet(f"{path}/scored")
        self.items.write.parquet(f"{path}/items")
        self.patterns.write.parquet(f"{path}/patterns")
        meta = {
            "label": self.label,
            "groups": asdict(self.groups),
            "totals": self.totals,
            "n_patterns": self.n_patterns,
            "report": self.report,
            "class_weights": self.class_weights,
            "order": [c.name for c in self.numeric],
            "known": self.known_sets() is not None,
        }
        if meta["known"]:
            self.known_sets().write.parquet(f"{path}/known")
        spark = self.items.sparkSession
        local_frame(spark, [(json.dumps(meta),)], "value string").write.text(f"{path}/metadata")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PatternModel:
        meta = json.loads(spark.read.text(f"{path}/metadata").first()["value"])
        rows = {r["col"]: r for r in spark.read.parquet(f"{path}/edges").collect()}
        numeric = [
            NumericColumn(c, rows[c]["kind"], rows[c]["min"], rows[c]["max"], list(rows[c]["edges"])) for c in meta["order"]
        ]
        return cls(
            label=meta["label"],
            groups=prep.FeatureGroups(**meta["groups"]),
            codes=spark.read.parquet(f"{path}/classes"),
            totals=meta["totals"],
            numeric=numeric,
            scored=spark.read.parquet(f"{path}/scored"),
            items=spark.read.parquet(f"{path}/items"),
            patterns=spark.read.parquet(f"{path}/patterns"),
            n_patterns=meta["n_patterns"],
            report=meta["report"],
            class_weights=meta.get("class_weights"),
            _known=spark.read.parquet(f"{path}/known") if meta["known"] else None,
        )
