"""Scoring of requests by all branches at once: fitted models as DataFrame stages, other predictors by batches.

A predictor that fails does so for one batch of one branch: the scores of that batch are null, with the error as a note.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from sequoria.functions.plan import importable
from sequoria.operators import scoring as R

from .bundles import Registry

#: A batch of rows in (as a list of dictionaries), one score for each out.
Predictor = Callable[[list[dict]], Sequence[float]]


def _scored(predictors: dict[str, Predictor], size: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, max(batch.num_rows, 1), size):
                part = batch.slice(start, size)
                rows, columns, notes = part.to_pylist(), [], [[] for _ in range(part.num_rows)]
                fine = [i for i, r in enumerate(rows) if r["error"] is None]
                for branch, predictor in predictors.items():
                    out: list[float | None] = [None] * len(rows)
                    try:
                        got = list(predictor([rows[i] for i in fine])) if fine else []
                        if len(got) != len(fine):
                            raise ValueError(f"{len(got)} scores for {len(fine)} rows")
                        for i, v in zip(fine, got, strict=True):
                            out[i] = float(v) if v is not None and math.isfinite(v) else None
                            if out[i] is None:
                                notes[i].append(f"{branch}: the score is no finite number")
                    except Exception as e:  # the branch is lost for this batch, the others are not
                        out = [None] * len(rows)
                        for i in fine:
                            notes[i].append(f"{branch}: {type(e).__name__}: {str(e)[:200]}")
                    columns.append(pa.array(out, pa.float64()))
                yield pa.RecordBatch.from_arrays([*part.columns, *columns, pa.array(notes, pa.list_(pa.string()))], names=[*part.schema.names, *(names), "notes"])

    return run


def run_predictors(requests: DataFrame, predictors: dict[str, Predictor], batch: int = 256) -> DataFrame:
    """requests (error, ...) with `<branch>_raw` for each predictor and `notes`; rows in error are scored by none."""
    importable(requests.sparkSession)
    names = [f"{b}_raw" for b in predictors]
    schema = StructType([*requests.schema.fields, *(StructField(n, DoubleType()) for n in names), StructField("notes", ArrayType(StringType()))])
    return requests.mapInArrow(_scored(predictors, batch, names), schema)


def predict(requests: DataFrame, key: str, predictors: dict[str, Predictor], registry: Registry | None = None, features: dict[str, str] | None = None, branches: Sequence[str] = ("m0", "m1", "lora", "m2"), batch: int = 256) -> DataFrame:
    """requests (sequence, cyclization_type, bond_pairs, ...) validated, scored by all branches, with warnings and
    recommendation, see scoring.score.

    predictors: functions by branch. registry: fitted models by branch, features the array columns that they take; a
    request whose features are null or of another width has no score from that branch.
    """
    registry = registry or Registry()
    checked = run_predictors(R.validated(requests), predictors, batch)
    columns = {b: f"{b}_raw" for b in predictors}
    for branch, model in registry.models.items():
        width, column = registry.contracts[branch]["features"].get("dimension"), (features or {})[branch]
        fits = F.col("error").isNull() & F.col(column).isNotNull()
        fits = fits & (F.size(column) == width) if width else fits
        rows = checked.filter(fits).select(key, F.col(column).cast("array<double>").alias(model.features))
        checked = checked.join(model.score(rows).select(key, F.col("score").alias(f"{branch}_raw")), key, "left")
        columns[branch] = f"{branch}_raw"
    out = R.score(checked, columns, tuple(b for b in branches if b not in columns))
    whole = F.concat(F.array(*[F.lit(w) for w in registry.warnings]).cast("array<string>"), "warnings", F.coalesce("notes", F.array().cast("array<string>")))
    return out.withColumn("warnings", F.when(F.col("error").isNull(), whole).otherwise(F.col("warnings"))).drop("notes", *columns.values())
