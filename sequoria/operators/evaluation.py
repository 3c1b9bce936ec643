"""Evaluation: all metrics of scored rows, group bootstrap intervals, grouped folds, summaries and choice of models."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sequoria.functions.plan import importable, stored

from . import curation as C

METRICS = ("mcc", "f1", "roc_auc", "pr_auc", "accuracy")
COUNTS = ("tn", "fp", "fn", "tp")
# Families from simple to complex; ties go to the simpler one.
SIMPLICITY = ("lr", "svm", "rf", "hgb", "mlp")


def cells(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, score, p, q): positives and negatives of each distinct score. rows: label (0 or 1), score, both not null."""
    checked = F.when(F.col("label").isin(0, 1) & F.col("score").isNotNull(), F.col("label")).otherwise(F.raise_error(F.lit("labels must be 0 or 1 and scores not null")).cast("int"))
    return rows.groupBy(*by, "score").agg(F.sum(checked.cast("long")).alias("p"), F.sum((1 - checked).cast("long")).alias("q"))


def metrics(scored: DataFrame, by: list[str], threshold: float = 0.5) -> DataFrame:
    """(by, tn, fp, fn, tp, mcc, f1, roc_auc, pr_auc, accuracy) of cells (by, score, p, q); one window over the distinct
    scores. Degenerate denominators give 0; ROC AUC is NaN with a single class, and pr_auc 0 without positives."""
    upto = Window.partitionBy(*by).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    before = lambda c: F.coalesce(F.sum(c).over(upto), F.lit(0))
    parts = scored.withColumns({"_p": before("p"), "_q": before("q"), "_tp": F.sum("p").over(whole), "_tq": F.sum("q").over(whole)})
    p, q, reached, seen = F.col("p"), F.col("q"), F.col("_tp") - F.col("_p"), F.col("_tp") + F.col("_tq") - F.col("_p") - F.col("_q")
    parts = parts.withColumns({"won": p * (F.col("_q") + q / 2.0), "ap": F.coalesce(F.try_divide(p * reached, seen), F.lit(0.0))})
    up = F.col("score") >= threshold
    pick = lambda cond, c: F.coalesce(F.sum(F.when(cond, c)), F.lit(0)).cast("long")
    out = parts.groupBy(*by).agg(pick(~up, q).alias("tn"), pick(up, q).alias("fp"), pick(~up, p).alias("fn"), pick(up, p).alias("tp"), F.sum("won").alias("won"), F.sum("ap").alias("ap"))
    tn, fp, fn, tp = (F.col(c).cast("double") for c in COUNTS)
    under = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return out.select(*by, *COUNTS, share(tp * tn - fp * fn, under).alias("mcc"), share(2 * tp, 2 * tp + fp + fn).alias("f1"), F.coalesce(F.try_divide("won", (tp + fn) * (tn + fp)), F.lit(float("nan"))).alias("roc_auc"), share(F.col("ap"), tp + fn).alias("pr_auc"), share(tp + tn, tp + tn + fp + fn).alias("accuracy"))


def draws(groups: DataFrame, group: str, by: list[str], replicates: int, seed: int) -> DataFrame:
    """(by, r, group, times): how often each replicate takes a group, as many hashed draws as there are groups.

    Groups are numbered by order within `by`; draw k of replicate r takes the group whose number is a hash of both.
    """
    numbered = groups.select(*by, group).distinct().withColumn("i", F.row_number().over(Window.partitionBy(*by).orderBy(group)) - 1)
    sizes = numbered.groupBy(*by).agg(F.count("*").alias("g"))
    each = sizes.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)))
    at = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), "r", "k"), 256), 1, 12), 16, 10).cast("long") % F.col("g")
    return each.withColumn("i", at).groupBy(*by, "r", "i").agg(F.count("*").alias("times")).join(numbered, [*by, "i"]).drop("i")


def bootstrap_metrics(rows: DataFrame, group: str, by: list[str], replicates: int = 1000, seed: int = 42) -> DataFrame:
    """Metrics of each replicate of a bootstrap over whole groups; replicates with a single class are left out.

    Rows become counts of each group and score first, so what is repeated does not grow with the rows of a group.
    """
    if replicates < 1:
        raise ValueError("at least one replicate is required")
    each = cells(rows, [*by, group])
    taken = each.join(draws(each, group, by, replicates, seed), [*by, group])
    merged = taken.groupBy(*by, "r", "score").agg(F.sum(F.col("p") * F.col("times")).alias("p"), F.sum(F.col("q") * F.col("times")).alias("q"))
    out = metrics(merged, [*by, "r"])
    return out.filter("tp + fn > 0 and tn + fp > 0")


def intervals(replicated: DataFrame, by: list[str], confidence: float = 0.95) -> DataFrame:
    """(by, metric, low, high): percentile intervals over the finite values of replicates; NaN where there is none."""
    if not 0 < confidence < 1:
        raise ValueError("confidence must be between 0 and 1")
    tail = (1 - confidence) / 2
    long = replicated.select(*by, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.nanvl(m, F.lit(None).cast("double")).alias("v")) for m in METRICS])))
    bound = lambda x: F.coalesce(F.percentile("v", x), F.lit(float("nan")))
    return long.groupBy(*by, "metric").agg(bound(tail).alias("low"), bound(1 - tail).alias("high"))


def shares(at: list[tuple[int, int]], p: int, q: int, c: int, all_p: int, all_q: int) -> list[int]:
    """How many of c groups of p positives and q negatives each fold gets that holds `at` so far, if they are dealt one
    after another to the fold whose squared deviation of either label's share grows least; then to the one of fewer
    rows, then to the first. What a fold asks grows by one step with each group, so what is surely given is given at
    once and only the last few are dealt."""
    cost = lambda f, i: (at[f][0] + i * p) * p / (float(all_p) * all_p) + (at[f][1] + i * q) * q / (float(all_q) * all_q)
    step, n = p * p / (float(all_p) * all_p) + q * q / (float(all_q) * all_q), len(at)
    top = max(cost(f, 0) for f in range(n))
    given = [max(0, int((top - cost(f, 0)) / step) - 1) for f in range(n)]
    if sum(given) > c:
        given = [0] * n
    else:
        whole = max(0, (c - sum(given)) // n - 2)
        given = [g + whole for g in given]
    offer = lambda f: (cost(f, given[f]), sum(at[f]) + given[f] * (p + q), f)
    heap = [offer(f) for f in range(n)]
    heapq.heapify(heap)
    for _ in range(c - sum(given)):
        f = heap[0][2]
        given[f] += 1
        heapq.heapreplace(heap, offer(f))
    return given


def _dealt_kinds(kinds: Iterator[pd.DataFrame], n: int) -> Iterator[pd.DataFrame]:
    """(p, q, c) in order in: positives and negatives of a group, and how many groups have them. (p, q, upto) out: the
    places within the kind where each fold's groups end."""
    held = pd.concat(list(kinds) or [pd.DataFrame({"p": [], "q": [], "c": []})])
    rows = [tuple(map(int, r)) for r in held[["p", "q", "c"]].itertuples(index=False)]
    all_p, all_q = max(sum(p * c for p, _, c in rows), 1), max(sum(q * c for _, q, c in rows), 1)
    at, out = [(0, 0)] * n, []
    for p, q, c in rows:
        given = shares(at, p, q, c, all_p, all_q)
        at = [(a + g * p, b + g * q) for (a, b), g in zip(at, given, strict=True)]
        out.append((p, q, np.cumsum(given).tolist()))
    yield pd.DataFrame(out, columns=["p", "q", "upto"])


def group_splits(rows: DataFrame, group: str, label: str = "label", n: int = 3, seeds: tuple[int, ...] = (42, 43, 44)) -> DataFrame:
    """(group, seed, fold): each group is in one fold of a seed; folds are alike in their numbers of either label.

    Groups with as many rows of each label are a kind. Kinds follow each other by falling difference of the two numbers,
    and all their groups are dealt greedily, see `shares`. Which groups of a kind go where is by a seeded hash. One task
    sees a row a kind (two numbers; N rows have fewer than 2 * N ** (2 / 3) kinds), none sees the groups.
    """
    importable(rows.sparkSession)
    each = stored(rows.groupBy(group).agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum((1 - F.col(label)).cast("long")).alias("q")), "groups")
    kinds = each.groupBy("p", "q").agg(F.count("*").alias("c")).repartition(1).sortWithinPartitions(F.abs(F.col("p") - F.col("q")).desc(), F.col("p").desc(), F.col("q").desc())
    rest = kinds.mapInPandas(lambda x: _dealt_kinds(x, n), "p long, q long, upto array<long>")
    out = None
    for seed in seeds:
        ranked = C.hashed_rank(each, ["p", "q"], C.draw(seed, F.col(group)), group, "_rank").join(rest, ["p", "q"])
        fold = F.size(F.filter("upto", lambda x: x < F.col("_rank")))
        made = ranked.select(group, F.lit(seed).alias("seed"), fold.alias("fold"))
        out = made if out is None else out.unionByName(made)
    return out


def inner_folds(rows: DataFrame, by: list[str], group: str, requested: int = 3, label: str = "label") -> DataFrame:
    """(by, folds): how many grouped folds are feasible: at most as many as requested, as groups, and as groups of each
    class; null under two."""
    counts = rows.groupBy(*by).agg(F.countDistinct(group).alias("_all"), F.countDistinct(F.when(F.col(label) == 0, F.col(group))).alias("_no"), F.countDistinct(F.when(F.col(label) == 1, F.col(group))).alias("_yes"))
    some = lambda c: F.when(F.col(c) > 0, F.col(c))
    least = F.least(F.lit(requested).cast("long"), F.col("_all"), some("_no"), some("_yes"))
    return counts.select(*by, F.when(least >= 2, least).cast("int").alias("folds"))


def oof_average(predictions: DataFrame, by: list[str], sample: str) -> DataFrame:
    """One averaged score a model and sample over all repeats, with their number."""
    return predictions.groupBy(*by, sample).agg(F.avg("score").alias("score"), F.count("*").alias("repeats"), F.first("label").alias("label"))


def fold_summary(fold_rows: DataFrame, by: list[str]) -> DataFrame:
    """Mean and sample deviation of each metric over folds, NaN skipped; the deviation of a single row is 0."""
    out = []
    for m in METRICS:
        v = F.nanvl(m, F.lit(None).cast("double"))
        out += [F.avg(v).alias(f"mean_{m}"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias(f"std_{m}")]
    return fold_rows.groupBy(*by).agg(*out)


def oof_summary(fold_rows: DataFrame, predictions: DataFrame, sample: str, group: str, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """One row a model: mean and deviation over folds, metrics of the averaged out-of-fold scores, and their intervals.
    predictions: model, sample, group, label, score."""
    averaged = predictions.groupBy("model", sample, group).agg(F.avg("score").alias("score"), F.first("label").alias("label"))
    pooled = metrics(cells(averaged, ["model"]), ["model"])
    pooled = pooled.select("model", *[F.col(c).alias(f"oof_{c}") for c in (*METRICS, *COUNTS)])
    spans = intervals(bootstrap_metrics(averaged, group, ["model"], replicates, seed), ["model"])
    wide = spans.groupBy("model").pivot("metric", list(METRICS)).agg(F.first("low").alias("ci95_low"), F.first("high").alias("ci95_high"))
    wide = wide.select("model", *[F.col(f"{m}_{e}").alias(f"oof_{m}_{e}") for m in METRICS for e in ("ci95_low", "ci95_high")])
    return fold_summary(fold_rows, ["model"]).join(pooled, "model").join(wide, "model").withColumns({"ci_method": F.lit("group_percentile_bootstrap"), "ci_n_bootstrap": F.lit(replicates)})


def simplicity(model: Column) -> Column:
    """Place of a family in the order of simplicity; others come last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(m) for m in SIMPLICITY]), model), F.lit(0).cast("long")), F.lit(len(SIMPLICITY) + 1).cast("long"))


def best_model(summaries: DataFrame, by: list[str], metric: str = "mean_mcc") -> DataFrame:
    """(by, model): the model with the greatest metric; NaN and null only count if nothing else is there; ties go to the
    simpler family."""
    value = F.nanvl(F.col(metric), F.lit(None).cast("double"))
    return summaries.groupBy(*by).agg(F.min_by("model", F.struct(value.isNull(), -F.coalesce(value, F.lit(0.0)), simplicity(F.col("model")), F.col("model"))).alias("model"))


def consensus(votes: DataFrame, by: list[str]) -> DataFrame:
    """(by, model): the family chosen most often; ties go to the simpler one."""
    counted = votes.groupBy(*by, "model").agg(F.count("*").alias("n"))
    return counted.groupBy(*by).agg(F.min_by("model", F.struct(-F.col("n"), simplicity(F.col("model")), F.col("model"))).alias("model"))


def permuted_ranks(importances: DataFrame) -> DataFrame:
    """(feature, mean, std, rank): permutation importances by falling mean; ties by name. importances: feature, drop."""
    each = importances.groupBy("feature").agg(F.avg("drop").alias("mean"), F.coalesce(F.stddev_pop("drop"), F.lit(0.0)).alias("std"))
    return each.withColumn("rank", F.row_number().over(Window.orderBy(F.col("mean").desc(), "feature")))  # a row a feature
