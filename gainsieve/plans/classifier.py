"""A Spark ML estimator: patterns as features, any Spark classifier on top."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import LogisticRegression, OneVsRest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gainsieve.functions.names import free
from gainsieve.operators import prep
from gainsieve.plans.miner import PatternMiner, PatternModel
from gainsieve.sources.local import local_frame
from gainsieve.sources.workspace import Workspace


def default_classifier(n_rows: float, n_classes: int, c: float = 1.0, multinomial: bool = False):
    """L2 logistic regression with total-loss weight C; one against the rest for more than two classes."""
    base = LogisticRegression(
        regParam=1.0 / (c * max(n_rows, 1.0)), elasticNetParam=0.0, standardization=False, maxIter=500, tol=1e-8
    )
    if n_classes <= 2:
        return base.setFamily("binomial")
    return base.setFamily("multinomial") if multinomial else OneVsRest(classifier=base.setFamily("binomial"), parallelism=min(n_classes, 4))


class PatternClassifier(Estimator, MLWritable, MLReadable):
    """Mine patterns, fit a classifier on the merged training rows (weight = row count).

    ``base_estimator`` is any Spark classifier with featuresCol / labelCol; when it has no
    weightCol it is fitted on unmerged rows. It may also be a function (rows, classes) -> classifier,
    which cannot be saved. Estimator and model can be stages of a Pipeline that is saved.
    """

    labelCol = Param(Params._dummy(), "labelCol", "class column", TypeConverters.toString)
    features = Param(Params._dummy(), "features", "feature columns", TypeConverters.toListString)
    keys = Param(Params._dummy(), "keys", "row key columns, never features", TypeConverters.toListString)
    bins = Param(Params._dummy(), "bins", "quantile bins, -1 = by information gain", TypeConverters.toInt)
    length = Param(Params._dummy(), "length", "longest pattern, -1 = no limit", TypeConverters.toInt)
    gain = Param(Params._dummy(), "gain", "patterns need a larger information gain", TypeConverters.toFloat)
    topK = Param(Params._dummy(), "topK", "patterns kept by utility, -1 = default", TypeConverters.toInt)
    fsK = Param(Params._dummy(), "fsK", "patterns kept by gain, -1 = all of topK", TypeConverters.toInt)
    itemPercent = Param(Params._dummy(), "itemPercent", "share of the default topK", TypeConverters.toFloat)
    classWeights = Param(Params._dummy(), "classWeights", "whole number for each class, by label code", TypeConverters.toListInt)
    regC = Param(Params._dummy(), "regC", "inverse regularisation of the default classifier", TypeConverters.toFloat)

    @keyword_only
    def __init__(
        self, *, labelCol="label", features=None, keys=None, bins=5, length=1, gain=1e-4, topK=-1, fsK=-1,
        itemPercent=1.0, regC=1.0, classWeights=None, base_estimator=None,
    ):
        super().__init__()
        self._setDefault(
            labelCol="label", keys=[], bins=5, length=1, gain=1e-4, topK=-1, fsK=-1, itemPercent=1.0, regC=1.0
        )
        kwargs = {k: v for k, v in self._input_kwargs.items() if v is not None and k != "base_estimator"}
        self._set(**kwargs)
        self.base_estimator = base_estimator

    def write(self) -> MLWriter:
        return _EstimatorWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _EstimatorReader()

    def miner(self) -> PatternMiner:
        g = self.getOrDefault
        return PatternMiner(
            label=g(self.labelCol),
            features=g(self.features) if self.isSet(self.features) else None,
            keys=g(self.keys),
            bins=g(self.bins),
            length=g(self.length),
            gain=g(self.gain),
            top_k=g(self.topK),
            fs_k=g(self.fsK),
            item_percent=g(self.itemPercent),
            class_weights=g(self.classWeights) if self.isSet(self.classWeights) else None,
        )

    def _fit(self, dataset: DataFrame) -> PatternClassifierModel:
        return self._train(self.miner().fit(dataset), dataset)

    def fit_grid(self, dataset: DataFrame, points: list[tuple[int, int, float]]) -> Iterator[tuple[tuple[int, int, float], PatternClassifierModel]]:
        """((bins, length, gain), model) of each point, as separate fits would give: rows are coded and mined once for each bins."""
        for bins in dict.fromkeys(b for b, _, _ in points):
            own = [(length, gain) for b, length, gain in points if b == bins]
            for (length, gain), patterns in self.copy({self.bins: bins}).miner().fit_grid(dataset, own).items():
                yield (bins, length, gain), self._train(patterns, dataset)

    def _train(self, patterns: PatternModel, dataset: DataFrame) -> PatternClassifierModel:
        if patterns.n_patterns == 0:
            raise ValueError("no pattern passes the thresholds; lower gain or raise topK")
        n, k = sum(patterns.totals), len(patterns.totals)
        base = self.base_estimator
        if base is None:
            base = default_classifier(n, k, self.getOrDefault(self.regC))
        elif not isinstance(base, Estimator):
            base = base(n, k)
        base = base.copy({base.getParam("featuresCol"): "features", base.getParam("labelCol"): "y"})
        if base.hasParam("weightCol"):
            base = base.copy({base.getParam("weightCol"): "weight"})
            # a table of its own: one partition for few merged rows, where a cached shuffle would keep all of its own in every iteration
            train = Workspace(dataset.sparkSession).table(patterns.training_table(), "training-rows")
        else:
            (code,) = free(dataset.columns, "_code")
            coded = prep.encode_label(dataset, patterns.label, patterns.codes, code).filter(F.col(code).isNotNull())
            if patterns.class_weights is not None:
                raise ValueError("class weights need a classifier with a weightCol")
            train = patterns.transform(coded).select("features", F.col(code).cast("double").alias("y"))
        return PatternClassifierModel(patterns, base.fit(train))


class PatternClassifierModel(Model, MLWritable, MLReadable):
    def __init__(self, patterns: PatternModel, classifier):
        super().__init__()
        self.patterns = patterns
        self.classifier = classifier

    def copy(self, extra=None):
        """A copy whose classifier has the parameters of extra."""
        return PatternClassifierModel(self.patterns, self.classifier.copy(extra) if extra else self.classifier)._resetUid(self.uid)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """Add pids, features, prediction and probability (array); label_code too when the label is there."""
        df = dataset
        if self.patterns.label in df.columns:
            df = prep.encode_label(df, self.patterns.label, self.patterns.codes, "label_code")
        scored = self.classifier.transform(self.patterns.transform(df))
        if "probability" in scored.columns:
            return scored.withColumn("probability", vector_to_array("probability"))
        # One against the rest gives raw scores: logistic per class, then normalised.
        raw = F.transform(vector_to_array("rawPrediction"), lambda r: F.lit(1.0) / (F.lit(1.0) + F.exp(-r)))
        scored = scored.withColumn("probability", raw)
        total = F.aggregate("probability", F.lit(0.0), lambda s, p: s + p)
        (sums,) = free(scored.columns, "_sum")
        return scored.withColumn(sums, total).withColumn("probability", F.transform("probability", lambda p: p / F.col(sums))).drop(sums)

    def predict(self, dataset: DataFrame) -> DataFrame:
        """The prediction decoded to the original label, column ``predicted_label``."""
        return prep.decode_label(self.transform(dataset), "prediction", self.patterns.codes, "predicted_label")

    def class_coefficients(self) -> tuple[list[list[float]], list[float]]:
        """For each class with a linear score of its own its coefficients and intercept; one (that of class 1) for two classes."""
        model = self.classifier
        models = getattr(model, "models", None)
        if models:
            return [[float(v) for v in m.coefficients.toArray()] for m in models], [float(m.intercept) for m in models]
        if getattr(model, "numClasses", 2) > 2:
            return [[float(v) for v in row] for row in model.coefficientMatrix.toArray()], [float(v) for v in model.interceptVector.toArray()]
        if hasattr(model, "theta"):  # naive Bayes over 0/1 features: log odds are linear in them
            theta = model.theta.toArray()
            present = theta - np.log1p(-np.exp(theta))
            absent = np.log1p(-np.exp(theta)).sum(axis=1) + model.pi.toArray()
            return [[float(v) for v in present[1] - present[0]]], [float(absent[1] - absent[0])]
        return [[float(v) for v in model.coefficients.toArray()]], [float(model.intercept)]

    def coefficients(self) -> list[float]:
        """Coefficients of the linear score; of the first class when there are several."""
        return self.class_coefficients()[0][0]

    def optimality(self, dataset: DataFrame, penalty: float | None = None) -> DataFrame:
        """(cls, pid, coefficient, gradient): the derivative of mean log loss plus ``penalty / 2`` times the squared coefficients,
        at the fitted coefficients; pid -1 is the intercept, which is not penalised. Near zero everywhere for the training rows
        of a logistic regression, or of one for each class against the rest: the loss is convex, so that proves the fit.

        ``penalty``: the default classifier's with C = 1 unless given.
        """
        coefficients, intercepts = self.class_coefficients()
        n = float(sum(self.patterns.totals))
        penalty = 1.0 / n if penalty is None else penalty
        classes = [1] if len(coefficients) == 1 else list(range(len(coefficients)))
        rows = self.transform(dataset)
        if len(coefficients) == 1:
            chance = F.array(F.element_at("probability", 2))
        else:
            chance = F.transform(vector_to_array("rawPrediction"), lambda r: F.lit(1.0) / (F.lit(1.0) + F.exp(-r)))
        weight = F.lit(1.0)
        if self.patterns.class_weights is not None:
            weight = F.get(F.array(*[F.lit(float(w)) for w in self.patterns.class_weights]), F.col("label_code").cast("int"))
        known = F.array(*[(F.col("label_code") == c).cast("double") for c in classes])
        residual = rows.select("pids", F.posexplode(F.zip_with(chance, known, lambda p, y: (p - y) * weight)).alias("k", "r"))
        each = residual.select("k", "r", F.explode(F.array_append("pids", F.lit(-1))).alias("pid"))
        sums = each.groupBy("k", "pid").agg((F.sum("r") / F.lit(n)).alias("slope"))
        fitted = [(k, classes[k], p, w) for k, ws in enumerate(coefficients) for p, w in enumerate(ws)]
        fitted += [(k, classes[k], -1, w) for k, w in enumerate(intercepts)]
        table = local_frame(self.patterns.items.sparkSession, fitted, "k int, cls int, pid int, coefficient double")
        own = F.when(F.col("pid") >= 0, F.col("coefficient") * F.lit(penalty)).otherwise(0.0)
        return table.join(sums, ["k", "pid"], "left").select("cls", "pid", "coefficient", (F.coalesce("slope", F.lit(0.0)) + own).alias("gradient"))

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader()

    @classmethod
    def load(cls, *where) -> PatternClassifierModel:
        """load(path), as Spark's own models, or load(spark, path)."""
        reader = cls.read()
        return (reader.session(where[0]) if len(where) > 1 else reader).load(where[-1])


class _EstimatorWriter(MLWriter):
    def __init__(self, instance: PatternClassifier):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        base = self.instance.base_estimator
        if base is not None and not isinstance(base, MLWritable):
            raise ValueError("base_estimator cannot be saved; give a Spark classifier instead of a function")
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, {"base": base is not None})
        if base is not None:
            base.save(f"{path}/base")


class _EstimatorReader(MLReader):
    def load(self, path: str) -> PatternClassifier:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        base = DefaultParamsReader.loadParamsInstance(f"{path}/base", self.sparkSession) if metadata["base"] else None
        out = PatternClassifier(base_estimator=base)._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(out, metadata)
        return out


class _ModelWriter(MLWriter):
    def __init__(self, instance: PatternClassifierModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.patterns.save(f"{path}/patterns")
        self.instance.classifier.save(f"{path}/classifier")


class _ModelReader(MLReader):
    def load(self, path: str) -> PatternClassifierModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        patterns = PatternModel.load(self.sparkSession, f"{path}/patterns")
        classifier = DefaultParamsReader.loadParamsInstance(f"{path}/classifier", self.sparkSession)
        return PatternClassifierModel(patterns, classifier)._resetUid(metadata["uid"])
