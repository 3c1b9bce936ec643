"""Nested grouped cross-validation, selection, final fit, ablation and permutation importance.

Training sets are bounded by the size limits of the core (2,500 rows), so one fit is small; there are many of them. The
driver submits the fits of all folds, families and params at once, a bounded number of them at a time, each to a
scheduler pool of its own; data sets are persisted before, and what is scored is written by the fit that scored it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sequoria.functions.plan import scratch
from sequoria.operators import curation as C
from sequoria.operators import evaluation as E
from sequoria.operators import fusion as U

from . import families as Fam

#: Fits that run at a time.
WORKERS = 4
SELECTED = "nested_selected"
SCORED = ["seed", "fold", "model", "chosen"]


@dataclass
class Fitted:
    name: str
    params: dict
    model: PipelineModel
    features: str

    def score(self, rows: DataFrame) -> DataFrame:
        """rows with `score`."""
        named = rows.withColumn("features", F.col(self.features)) if self.features != "features" else rows
        return Fam.positive_score(self.model.transform(named)).select(*rows.columns, "score")


def fit(train: DataFrame, family: Fam.Family, params: dict, features: str = "features") -> Fitted:
    """One family with one choice of params on all rows of train (label, features)."""
    data = train.select(F.col("label").cast("double").alias(Fam.LABEL), F.col(features).alias("features"))
    held = data.groupBy(Fam.LABEL).agg(F.count("*").alias("n"), F.max(F.size("features")).alias("width")).collect()
    rows, width = sum(x.n for x in held), max((x.width for x in held), default=None)
    data = Fam.balanced(data, counts={x[Fam.LABEL]: x.n for x in held})
    stages = [Fam.Preparation("features", "x", family.scaled), *family.make(params, rows, width)]
    return Fitted(family.name, params, Pipeline(stages=stages).fit(data), features)


def concurrently(spark: SparkSession, calls: Sequence[Callable], workers: int = WORKERS) -> list:
    """What the calls return, in their order; `workers` of them run at a time, with the caller's local properties."""

    def one(at: int, call: Callable):
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fit{at % workers}")
        return call()

    with ThreadPoolExecutor(max(1, workers)) as pool:
        return [x.result() for x in [pool.submit(inheritable_thread_target(lambda i=i, c=c: one(i, c))) for i, c in enumerate(calls)]]


def mcc(scored: DataFrame) -> float:
    """MCC of scored rows (label, score), from four counts; 0 where it is not defined, NaN without rows."""
    yes, up = F.col("label") == 1, F.col("score") >= 0.5
    tp, fp, fn, tn = scored.agg(F.count_if(yes & up), F.count_if(~yes & up), F.count_if(yes & ~up), F.count_if(~yes & ~up)).first()
    if not tp + fp + fn + tn:
        return float("nan")
    below = math.sqrt(float(tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return (tp * tn - fp * fn) / below if below else 0.0


def inner(train: DataFrame, group: str, seed: int, requested: int) -> tuple[DataFrame, int | None]:
    """train with its inner `fold`, and how many there are; None where they are not feasible."""
    k = E.inner_folds(train.withColumn("every", F.lit(1)), ["every"], group, requested).first().folds
    if k is None:
        return train.withColumn("fold", F.lit(0)), None
    return train.join(E.group_splits(train, group, "label", k, (seed,)).select(group, "fold"), group), k


def candidates(dealt: DataFrame, k: int | None, families: dict[str, Fam.Family], features: str) -> list[tuple[dict, list[Callable]]]:
    """Each choice of family and params with the calls that give its MCC on the inner folds; none where k is None."""
    out = []
    for order, family in enumerate(families.values()):
        for params in family.grid if k else family.grid[:1]:
            run = lambda f, family=family, params=params: mcc(fit(dealt.filter(F.col("fold") != f), family, params, features).score(dealt.filter(F.col("fold") == f)))
            out.append(({"model": family.name, "order": order, "params": params}, [lambda f=f, run=run: run(f) for f in range(k or 0)]))
    return out


def judged(tried: list[tuple[dict, list[float]]]) -> tuple[list[dict], list[dict]]:
    """All choices with their inner_mean_mcc, and the best of each family, best family first. A mean that is not finite
    counts only where nothing else is there; ties go to what comes first."""
    rows = [what | {"inner_mean_mcc": sum(got) / len(got) if got else float("nan")} for what, got in tried]
    key = lambda r: (not math.isfinite(r["inner_mean_mcc"]), -r["inner_mean_mcc"] if math.isfinite(r["inner_mean_mcc"]) else 0.0, r["order"])
    best: dict[str, dict] = {}
    for r in rows:
        if r["model"] not in best or key(r) < key(best[r["model"]]):
            best[r["model"]] = r
    return rows, sorted(best.values(), key=key)


def _tried(spark: SparkSession, choices: list[tuple[dict, list[Callable]]], workers: int) -> list[tuple[dict, list[float]]]:
    got = iter(concurrently(spark, [c for _, calls in choices for c in calls], workers))
    return [(what, [next(got) for _ in calls]) for what, calls in choices]


def select_and_fit(train: DataFrame, families: dict[str, Fam.Family], group: str, seed: int = 42, requested: int = 3, features: str = "features", workers: int = WORKERS) -> tuple[Fitted, list[dict]]:
    """The family and params of the best mean MCC over inner grouped folds, fitted to all of train; and what was tried.
    Ties go to the family and params that come first. Where inner folds are not feasible, the first family is fitted."""
    spark = train.sparkSession
    dealt, k = inner(train, group, seed, requested)
    dealt = dealt.persist()
    try:
        rows, best = judged(_tried(spark, candidates(dealt, k, families, features), workers))
        return fit(dealt.drop("fold"), families[best[0]["model"]], best[0]["params"], features), rows
    finally:
        dealt.unpersist()


def evaluate(rows: DataFrame, families: dict[str, Fam.Family], sample: str, group: str, seeds: tuple[int, ...] = (42, 43, 44), n: int = 3, features: str = "features", workers: int = WORKERS) -> DataFrame:
    """Out-of-fold scores (seed, fold, model, chosen, sample, group, label, score) of a nested evaluation.

    In each outer fold every family is fitted with the params that inner folds choose; the rows of the best one stand
    again under the model `nested_selected`, with its name as chosen. No group is on both sides of a fold.
    """
    return _evaluated(rows, [("", families, features)], sample, group, seeds, n, workers).drop("feature_set")


def _evaluated(rows: DataFrame, sets_of: Sequence[tuple[str, dict[str, Fam.Family], str]], sample: str, group: str, seeds: tuple[int, ...], n: int, workers: int) -> DataFrame:
    """`evaluate` for feature sets (name, families, column), each by itself, with `feature_set`. Folds hold for all sets and
    are made once; the fits of all sets are submitted together."""
    spark = rows.sparkSession
    folds = E.group_splits(rows, group, "label", n, seeds)
    outer = [(seed, f) for seed in seeds for f in range(n)]
    dealt = {seed: rows.join(folds.filter(F.col("seed") == seed).select(group, F.col("fold").alias("outer")), group).persist() for seed in seeds}

    def prepare(seed: int, f: int) -> tuple[DataFrame, int | None]:
        train, k = inner(dealt[seed].filter(F.col("outer") != f).drop("outer"), group, seed + f, n)
        return train.persist(), k

    sets = concurrently(spark, [lambda s=s, f=f: prepare(s, f) for s, f in outer], workers)
    try:
        choices = [[(what | {"at": (at, of)}, calls) for what, calls in candidates(train, k, families, features)] for of, (_, families, features) in enumerate(sets_of) for at, (train, k) in enumerate(sets)]
        tried = _tried(spark, [c for x in choices for c in x], workers)
        best = {key: judged([t for t in tried if t[0]["at"] == key])[1] for key in dict.fromkeys(t[0]["at"] for t in tried)}
        path = scratch(spark, "oof")

        def score(at: int, of: int, choice: dict, first: bool) -> None:
            (seed, f), (name, families, features) = outer[at], sets_of[of]
            model = fit(sets[at][0].drop("fold"), families[choice["model"]], choice["params"], features)
            out = model.score(dealt[seed].filter(F.col("outer") == f))
            none = F.lit(None).cast("string")
            names = [F.struct(F.lit(choice["model"]).alias("model"), none.alias("chosen"))] + [F.struct(F.lit(SELECTED).alias("model"), F.lit(choice["model"]).alias("chosen"))] * first
            out.select(F.lit(name).alias("feature_set"), F.lit(seed).alias("seed"), F.lit(f).alias("fold"), sample, group, "label", "score", F.inline(F.array(*names))).write.parquet(f"{path}/at={of}-{at}-{choice['model']}")

        concurrently(spark, [lambda at=at, of=of, c=c, i=i: score(at, of, c, i == 0) for (at, of), x in best.items() for i, c in enumerate(x)], workers)
    finally:
        for x in [*dealt.values(), *(t for t, _ in sets)]:
            x.unpersist()
    return spark.read.parquet(path).select("feature_set", *SCORED, sample, group, "label", "score")


def ablation(rows: DataFrame, sample: str, group: str, names: Sequence[str] = tuple(U.BLOCKS), seeds: tuple[int, ...] = (42, 43, 44), n: int = 3, trees: int = 500, rounds: int = 500, workers: int = WORKERS) -> DataFrame:
    """Scores of `evaluate` for each feature set (first column `feature_set`), over one and the same set of folds.

    rows: sample, group, label and the blocks of the sets. A block has one width in all rows; each is filled, scaled,
    and reduced if it is wide, within the fold.
    """
    blocks = list(dict.fromkeys(b for name in names for b in U.BLOCKS[name]))
    width = rows.agg(*[F.max(F.size(b)).alias(b) for b in blocks], *[F.min(F.size(b)).alias(f"{b}_least") for b in blocks]).first()
    if uneven := [b for b in blocks if width[b] != width[f"{b}_least"]]:
        raise ValueError(f"rows of differing widths in {', '.join(uneven)}")
    sets_of = [(name, Fam.fusion_families(tuple(width[b] for b in U.BLOCKS[name]), trees, rounds), f"set_{name}") for name in dict.fromkeys(names)]
    wide = rows
    for name, _, column in sets_of:
        wide = U.feature_set(wide, name, column)
    return _evaluated(wide.select(sample, group, "label", *[column for _, _, column in sets_of]), sets_of, sample, group, seeds, n, workers)


def permutation_importance(model: Fitted, rows: DataFrame, names: list[str], sample: str, repeats: int = 30, seed: int = 42, workers: int = WORKERS) -> DataFrame:
    """(feature, mean, std, rank): how much MCC falls if a feature's values are dealt out anew among the rows.

    A permutation is a join of ranks by two hashes. Descriptive only.
    """
    spark, base, drops = rows.sparkSession, mcc(model.score(rows)), []
    for r in range(repeats):
        own = C.hashed_rank(rows, [], C.draw(seed, F.col(sample)), sample, "_place")
        other = C.hashed_rank(rows.select(sample, F.col(model.features).alias("_other")), [], C.draw(seed + 1 + r, F.col(sample)), sample, "_place").select("_place", "_other")
        both = own.join(other, "_place").persist()

        def drop(i: int, both: DataFrame = both) -> float:
            shuffled = F.concat(F.slice(F.col(model.features), 1, i) if i else F.array().cast("array<double>"), F.array(F.get(F.col("_other"), F.lit(i))), F.slice(F.col(model.features), i + 2, len(names)))
            return base - mcc(model.score(both.withColumn(model.features, shuffled).drop("_other", "_place")))

        drops += zip(names, concurrently(spark, [lambda i=i: drop(i) for i in range(len(names))], workers), strict=True)
        both.unpersist()
    return E.permuted_ranks(spark.createDataFrame(drops, "feature string, drop double"))
