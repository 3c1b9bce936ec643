"""Classification metrics, vector means, scaling and quantiles as aggregations and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion(rows: DataFrame, by: list[str], threshold: float = 0.5) -> DataFrame:
    """tn, fp, fn, tp and the scores that follow from them; a degenerate denominator gives 0. rows: label, score."""
    up, yes = F.col("score") >= threshold, F.col("label") == 1
    out = rows.groupBy(*by).agg(F.count_if(~yes & ~up).alias("tn"), F.count_if(~yes & up).alias("fp"), F.count_if(yes & ~up).alias("fn"), F.count_if(yes & up).alias("tp"))
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    under = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return out.withColumns(
        {
            "mcc": F.when(under == 0, 0.0).otherwise((tp * tn - fp * fn) / F.when(under == 0, 1.0).otherwise(under)),
            "f1": F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)),
            "accuracy": F.coalesce(F.try_divide(tp + tn, tp + tn + fp + fn), F.lit(0.0)),
        }
    )


def _by_score(rows: DataFrame, by: list[str]) -> DataFrame:
    """Positives and rows of each distinct score: as many rows as there are scores, whatever the table's size."""
    return rows.groupBy(*by, "score").agg(F.sum(F.col("label").cast("long")).alias("p"), F.count("*").alias("n"))


def roc_auc(rows: DataFrame, by: list[str]) -> DataFrame:
    """Area under the ROC curve with half credit for ties; NaN for a single class."""
    w = Window.partitionBy(*by).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum(F.col("n") - F.col("p")).over(w), F.lit(0))
    parts = _by_score(rows, by).withColumn("won", F.col("p") * (below + (F.col("n") - F.col("p")) / 2.0))
    out = parts.groupBy(*by).agg(F.sum("won").alias("won"), F.sum("p").cast("double").alias("p"), F.sum(F.col("n") - F.col("p")).cast("double").alias("q"))
    return out.select(*by, F.coalesce(F.try_divide("won", F.col("p") * F.col("q")), F.lit(float("nan"))).alias("roc_auc"))


def average_precision(rows: DataFrame, by: list[str]) -> DataFrame:
    """Step sum of precision over recall, by distinct threshold; NaN without positives."""
    w = Window.partitionBy(*by).orderBy(F.col("score").desc())
    parts = _by_score(rows, by).withColumn("part", F.col("p") * F.sum("p").over(w) / F.sum("n").over(w))
    out = parts.groupBy(*by).agg(F.sum("part").alias("part"), F.sum("p").alias("p"))
    return out.select(*by, F.coalesce(F.try_divide("part", "p"), F.lit(float("nan"))).alias("average_precision"))


def vector_mean(rows: DataFrame, by: list[str], vector: str) -> DataFrame:
    """Element-wise mean of vectors, in order. Long form, so that a group of any size is summed before the shuffle."""
    parts = rows.select(*by, F.posexplode(vector)).groupBy(*by, "pos").agg(F.avg(F.col("col").cast("double")).alias("mean"))
    return parts
