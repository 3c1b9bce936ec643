"""Helpers that keep plans in shape."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def lowered(text: Column) -> Column:
    """Lower case. The engine's own goes by Unicode's tables, which takes microseconds even for a short ASCII text."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(text.rlike(r"[^\x00-\x7f]"), F.lower(text)).when(text.rlike("[A-Z]"), F.translate(text, upper, upper.lower())).otherwise(text)


def sealed(df: DataFrame, *columns: Column | str) -> DataFrame:
    """The columns, made once: filters and joins above are not rewritten in terms of the expressions below, which would
    make long ones again for each use. Only for columns that are all needed."""
    return df.select(F.inline(F.array(F.struct(*columns))))


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer files than cores dealt out to all cores; a larger one as it is read, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df in as many partitions as shuffles have. Adaptive execution joins small partitions by their bytes; rows that
    are about to be multiplied are to stay apart."""
    session = df.sparkSession
    n = max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *keys)


def importable(spark: SparkSession) -> None:
    """Puts this package's folder on the path of Python workers that start from now on."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder of the session (spark.checkpoint.dir); a local session may do without one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        at = "file://" + tempfile.mkdtemp(prefix="sequoria-")
    return f"{at.rstrip('/')}/sequoria/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, swept: bool = False) -> DataFrame:
    """df written to a new folder of the shared one and read again: made once, however often it is used above. swept: the
    shuffle files that it took are removed at once, not when the driver happens to collect its garbage."""
    session, path = df.sparkSession, scratch(df.sparkSession, name)
    before = session.conf.get(_SWEEP)
    session.conf.set(_SWEEP, "true" if swept else before)
    try:
        df.write.parquet(path)
    finally:
        session.conf.set(_SWEEP, before)
    return session.read.schema(df.schema).parquet(path)


def distinct_dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The distinct keys of df in as many partitions as shuffles have, by one exchange: what is dealt by the keys need
    not be dealt again to be made distinct."""
    return dealt(df.select(*keys), *keys).distinct()
