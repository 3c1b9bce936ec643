"""Model families as pipelines: linear, kernel (random Fourier features), forest, boosting and a small network.

Features come as an array of doubles, with nulls or NaN for what is missing. Preparation fills, and scales where a family
asks for it; wide blocks are reduced by themselves. Class weights are balanced by a column. All fitted stages can be
saved. Boosting and the network stop early: a share of the rows is held out within the training set.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Transformer
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import PCA, VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WEIGHT, LABEL = "weight", "label"
#: Blocks of this width and more are reduced, to so many components at most.
WIDE, COMPONENTS = 128, 64


@dataclass(frozen=True)
class Family:
    """make(params, rows, width) gives the stages on the vector column `x`; grid holds the params to try; scaled: whether
    x is scaled."""

    name: str
    make: Callable[[dict, int, int], list]
    grid: tuple[dict, ...]
    scaled: bool = True


class _Saved(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A stage whose params are all that it holds."""

    @keyword_only
    def __init__(self, **given):
        super().__init__()
        if given:
            self._set(**given)

    def of(self, name: str):
        return self.getOrDefault(self.getParam(name))


class Prepared(_Saved):
    """The array column `source` as the vector `target`: missing features filled, then (v - mean) / scale."""

    source = Param(Params._dummy(), "source", "array column", TypeConverters.toString)
    target = Param(Params._dummy(), "target", "vector column", TypeConverters.toString)
    fill = Param(Params._dummy(), "fill", "what missing features become", TypeConverters.toListFloat)
    mean = Param(Params._dummy(), "mean", "what is taken off", TypeConverters.toListFloat)
    scale = Param(Params._dummy(), "scale", "what is divided by", TypeConverters.toListFloat)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        given = F.array(*[F.struct(F.lit(float(f)).alias("f"), F.lit(float(m)).alias("m"), F.lit(float(s)).alias("s")) for f, m, s in zip(self.of("fill"), self.of("mean"), self.of("scale"), strict=True)])
        made = F.zip_with(F.col(self.of("source")), given, lambda v, g: (F.coalesce(F.nanvl(v, F.lit(None).cast("double")), g.f) - g.m) / g.s)
        return dataset.withColumn(self.of("target"), array_to_vector(made))


class Preparation(Estimator):
    """Fits Prepared: medians over what is there (0 where nothing is), and, if scaled, mean and population deviation of
    the filled features. Statistics are grouped by place, one row a feature reaches the driver."""

    def __init__(self, source: str, target: str, scaled: bool):
        super().__init__()
        self.names, self.scaled = (source, target), scaled

    def _fit(self, dataset: DataFrame) -> Prepared:
        source, target = self.names
        each = dataset.select(F.posexplode(source).alias("at", "v")).withColumn("v", F.nanvl("v", F.lit(None).cast("double")))
        stats = each.groupBy("at").agg(F.percentile("v", 0.5).alias("median"), F.count("v").alias("there"), F.count("*").alias("n"), F.avg("v").alias("avg"), F.var_pop("v").alias("var"))
        got = sorted(stats.collect())
        fill, mean, scale = [], [], []
        for _, median, there, n, avg, var in got:
            median, avg, var = median or 0.0, avg or 0.0, var or 0.0
            m = (there * avg + (n - there) * median) / n
            spread = (there * (var + (avg - m) ** 2) + (n - there) * (median - m) ** 2) / n
            fill.append(median), mean.append(m if self.scaled else 0.0), scale.append((spread**0.5 or 1.0) if self.scaled else 1.0)
        return Prepared(source=source, target=target, fill=fill, mean=mean, scale=scale)


class Fourier(_Saved):
    """Random Fourier features of a Gaussian kernel: an inner product of them stands for the kernel's value."""

    source = Param(Params._dummy(), "source", "vector column", TypeConverters.toString)
    target = Param(Params._dummy(), "target", "vector column", TypeConverters.toString)
    width = Param(Params._dummy(), "width", "features of a vector", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "of the kernel", TypeConverters.toFloat)
    size = Param(Params._dummy(), "size", "random features", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "of the draws", TypeConverters.toInt)

    @classmethod
    def of_kernel(cls, source: str, target: str, width: int, gamma: float, size: int = 200, seed: int = 42) -> Fourier:
        return cls(source=source, target=target, width=width, gamma=float(gamma), size=size, seed=seed)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        dice, width, size = np.random.default_rng(self.of("seed")), self.of("width"), self.of("size")
        turns, shifts = dice.normal(0, np.sqrt(2 * self.of("gamma")), (size, width)), dice.uniform(0, 2 * np.pi, size)
        rows = F.array(*[F.struct(F.array(*[F.lit(float(v)) for v in w]).alias("w"), F.lit(float(b)).alias("b")) for w, b in zip(turns, shifts, strict=True)])
        held = dataset.withColumn("_raw", vector_to_array(self.of("source")))
        dot = lambda w: F.aggregate(F.zip_with(F.col("_raw"), w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        scale = float(np.sqrt(2 / size))
        return held.withColumn(self.of("target"), array_to_vector(F.transform(rows, lambda r: F.cos(dot(r["w"]) + r["b"]) * scale))).drop("_raw")


class HeldOut(_Saved):
    """Marks a share of the rows by a hash of their vector, so that equal rows are on one side."""

    source = Param(Params._dummy(), "source", "vector column", TypeConverters.toString)
    target = Param(Params._dummy(), "target", "boolean column", TypeConverters.toString)
    share = Param(Params._dummy(), "share", "of the rows", TypeConverters.toFloat)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        at = F.pmod(F.xxhash64(vector_to_array(self.of("source"))), F.lit(10_000))
        return dataset.withColumn(self.of("target"), at < int(self.of("share") * 10_000))


class Network(Estimator):
    """A network of one hidden layer, trained `step` rounds at a time from the weights so far, until the loss on the
    held-out share has not fallen for `patience` times; the weights of the least loss are kept.

    Without both classes on both sides there is nothing to stop by: it is trained for `most` rounds. The fitted model
    tells its `rounds`.
    """

    def __init__(self, source: str, inputs: int, most: int = 500, hidden: int = 64, step: int = 20, patience: int = 2, share: float = 0.2, seed: int = 42):
        super().__init__()
        self.source, self.layers, self.most, self.step, self.patience, self.share, self.seed = source, [inputs, hidden, 2], most, step, patience, share, seed

    def _one(self, rows: DataFrame, rounds: int, weights):
        made = MultilayerPerceptronClassifier(featuresCol=self.source, labelCol=LABEL, layers=self.layers, maxIter=rounds, seed=self.seed)
        return (made.setInitialWeights(weights) if weights is not None else made).fit(rows)

    def _fit(self, dataset: DataFrame):
        rows = HeldOut(source=self.source, target="_held", share=self.share).transform(dataset).select(self.source, LABEL, "_held").persist()
        try:
            if rows.select("_held", LABEL).distinct().count() < 4:
                model = self._one(rows, self.most, None)
                model.rounds = self.most
                return model
            train, held = rows.filter("not _held"), rows.filter("_held")
            best, least, done, waited, weights = None, float("inf"), 0, 0, None
            right = F.get(vector_to_array("probability"), F.col(LABEL).cast("int"))
            while done < self.most and waited < self.patience:
                model = self._one(train, min(self.step, self.most - done), weights)
                done, weights = done + self.step, model.weights
                loss = model.transform(held).agg(F.avg(-F.log(F.greatest(right, F.lit(1e-15))))).first()[0]
                if loss < least - 1e-6:
                    best, least, waited = model, loss, 0
                    best.rounds = done
                else:
                    waited += 1
            return best
        finally:
            rows.unpersist()


def _lr(params: dict, rows: int, width: int) -> list:
    return [LogisticRegression(featuresCol="x", labelCol=LABEL, weightCol=WEIGHT, regParam=1 / (params["C"] * max(rows, 1)), standardization=False, maxIter=100)]


def _svm(params: dict, rows: int, width: int) -> list:
    gamma = params["gamma"] if params["gamma"] != "scale" else 1 / max(width, 1)
    return [Fourier.of_kernel("x", "k", width, gamma), LinearSVC(featuresCol="k", labelCol=LABEL, weightCol=WEIGHT, regParam=1 / (params["C"] * max(rows, 1)), maxIter=50)]


def _forest(params: dict, source: str, trees: int) -> RandomForestClassifier:
    return RandomForestClassifier(featuresCol=source, labelCol=LABEL, weightCol=WEIGHT, numTrees=trees, maxDepth=params.get("max_depth", 10), minInstancesPerNode=params.get("min_samples_leaf", 1), seed=42)


def _hgb(params: dict, rows: int, width: int) -> list:
    boosted = GBTClassifier(featuresCol="x", labelCol=LABEL, weightCol=WEIGHT, stepSize=params["learning_rate"], maxDepth=params["max_depth"], maxIter=100, validationIndicatorCol="held", validationTol=0.01, seed=42)
    return [HeldOut(source="x", target="held", share=0.1), boosted]


def components(rows: int, width: int, most: int = COMPONENTS) -> int:
    """Components of a block: at most `most`, one under the rows, and the width; one at least."""
    return max(1, min(most, rows - 1, width))


def reduced_blocks(widths: tuple[int, ...], rows: int) -> tuple[list, int]:
    """Stages from the scaled vector `x` to `w`: each block of WIDE columns and more by a PCA of its own, the others as
    they are; and the width of w. Scaled columns have mean 0, so that the PCA is a centred one."""
    if not widths or min(widths) < 1:
        raise ValueError("blocks must have columns")
    stages, parts, begin, total = [], [], 0, 0
    for i, width in enumerate(widths):
        stages.append(VectorSlicer(inputCol="x", outputCol=f"b{i}", indices=list(range(begin, begin + width))))
        k = components(rows, width) if width >= WIDE else width
        if width >= WIDE:
            stages.append(PCA(inputCol=f"b{i}", outputCol=f"c{i}", k=k))
        parts.append(f"c{i}" if width >= WIDE else f"b{i}")
        begin, total = begin + width, total + k
    return [*stages, VectorAssembler(inputCols=parts, outputCol="w")], total


def _lr_reduced(params: dict, rows: int, width: int) -> list:
    pca = PCA(inputCol="x", outputCol="c", k=components(rows, width))
    return [pca, LogisticRegression(featuresCol="c", labelCol=LABEL, weightCol=WEIGHT, regParam=1 / (params["C"] * max(rows, 1)), standardization=False)]


def _mlp(params: dict, rows: int, width: int) -> list:
    k = components(rows, width)
    return [PCA(inputCol="x", outputCol="c", k=k), Network("c", k, most=params.get("max_iter", 500))]


def _grid(**values: tuple) -> tuple[dict, ...]:
    out: list[dict] = [{}]
    for name, options in values.items():
        out = [{**o, name: v} for o in out for v in options]
    return tuple(out)


def m0_families(trees: int = 500) -> dict[str, Family]:
    """Families on handcrafted features."""
    found = (
        Family("lr", _lr, _grid(C=(0.1, 1.0, 10.0))),
        Family("svm", _svm, _grid(C=(0.5, 2.0, 8.0), gamma=("scale", 0.01, 0.1))),
        Family("rf", lambda params, rows, width: [_forest(params, "x", trees)], _grid(max_depth=(5, 10, 20), min_samples_leaf=(1, 3, 5)), scaled=False),
        Family("hgb", _hgb, _grid(learning_rate=(0.03, 0.1), max_depth=(3, 4, 5)), scaled=False),
    )
    return {f.name: f for f in found}


def m1_families() -> dict[str, Family]:
    """Families on embeddings."""
    return {"lr": Family("lr", _lr_reduced, _grid(C=(0.1, 1.0, 10.0))), "mlp": Family("mlp", _mlp, _grid(max_iter=(500,)))}


def fusion_families(widths: tuple[int, ...], trees: int = 500, rounds: int = 500) -> dict[str, Family]:
    """Families on joined blocks of given widths: each block is filled and scaled, the wide ones are reduced. trees of the
    forest, and rounds of the network at most."""

    def forest(params: dict, rows: int, width: int) -> list:
        return [*reduced_blocks(widths, rows)[0], _forest(params, "w", trees)]

    def network(params: dict, rows: int, width: int) -> list:
        stages, k = reduced_blocks(widths, rows)
        return [*stages, Network("w", k, most=rounds)]

    return {"rf": Family("rf", forest, ({},)), "mlp": Family("mlp", network, ({},))}


def balanced(rows: DataFrame, label: str = LABEL, counts: dict | None = None) -> DataFrame:
    """rows with weights that give both classes the same total; counts: rows of each class, where they are known."""
    if counts is None:
        counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    total = sum(counts.values())
    weight = F.lit(1.0)
    for value, n in counts.items():
        weight = F.when(F.col(label) == value, total / (len(counts) * n)).otherwise(weight)
    return rows.withColumn(WEIGHT, weight)


def positive_score(scored: DataFrame) -> DataFrame:
    """scored with the probability of class 1 as `score`; a margin becomes one by the logistic function."""
    if "probability" in scored.columns:
        return scored.withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))
    return scored.withColumn("score", 1 / (1 + F.exp(-F.get(vector_to_array("rawPrediction"), F.lit(1)))))
