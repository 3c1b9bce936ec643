"""Writers: one FASTA file a row, manifests, failure logs, an embedding cache with its contract, and resumption."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sequoria.functions import sequence as S
from sequoria.functions import topology as T

CACHE_VERSION = 1


def csv(spark: SparkSession, path: str) -> DataFrame:
    """Any CSV with a header: all columns are text, quoted line ends stay in their cells, a byte order mark is dropped."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def union_all(*tables: DataFrame) -> DataFrame:
    """Rows of all tables, repeats included; columns that a table lacks are null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def write_fasta_files(rows: DataFrame, path: str) -> None:
    """rows (record_id, sequence) as one FASTA text for each record, in a folder file=<safe id>."""
    text = F.concat(F.lit(">"), F.col("record_id").cast("string"), F.lit("\n"), F.col("sequence")).alias("value")
    rows.select(T.file_id(F.col("record_id").cast("string")).alias("file"), text).repartition("file").write.partitionBy("file").text(path)


def write_ordered(rows: DataFrame, path: str, order: list[str], form: str = "parquet", files: int | None = None) -> None:
    """rows in total order: partitions are ranges of `order`, each sorted; files read by name give the order back. files: how
    many, else as sizes ask."""
    dealt = rows.repartitionByRange(files, *order) if files else rows.repartitionByRange(*order)
    dealt.sortWithinPartitions(*order).write.format(form).save(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(file, digest): SHA-256 of the bytes of each file. A file is one row, so this is for artifacts, not for corpora."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("digest"))


def write_manifest(summary: DataFrame, path: str) -> None:
    """A table of few rows, such as counts and digests, as one JSON file."""
    summary.coalesce(1).write.mode("overwrite").json(path)


def write_failures(results: DataFrame, path: str) -> None:
    """The results that did not succeed, as JSON; null counts as failure."""
    results.filter(~F.coalesce(F.col("success"), F.lit(False))).write.mode("overwrite").json(path)


def pending(requests: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Requests that are not done yet."""
    return requests.join(done.select(key), key, "left_anti")


def zero_based_pairs(text: Column) -> Column:
    """`2 5 7 9` (one-based residues) as array<array<int>> from 0; an odd number of them, or one under 1, is an error."""
    items = F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"), lambda x: x != "")
    numbers = F.transform(items, lambda x: x.try_cast("int"))
    fine = (F.size(numbers) % 2 == 0) & F.forall(numbers, lambda n: F.coalesce(n >= 1, F.lit(False)))
    made = F.transform(F.filter(numbers, lambda n, i: i % 2 == 0), lambda n, i: F.array(n - 1, F.get(numbers, i * 2 + 1) - 1))
    return F.when(fine, made).otherwise(F.raise_error(F.concat(F.lit("odd or invalid residue list: "), text)).cast("array<array<int>>"))


def sequence_hash(rows: DataFrame, order: str = "ord") -> str:
    """SHA-256 of the compact JSON list of [sequence, type] in order. The list is one text, so this is for the data
    sets that the size limits allow (10,000 rows); see curation.block_digest for larger ones."""
    each = F.struct(order, F.concat(F.lit('["'), S.normalized(F.col("sequence")), F.lit('","'), S.cyclization_type(F.col("cyclization_type")), F.lit('"]')).alias("t"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(each)), lambda r: r["t"]), ",")
    return rows.agg(F.sha2(F.concat(F.lit("["), listed, F.lit("]")), 256)).first()[0]


def cache_contract(rows: DataFrame, model: str, revision: str | None, rotation_average: bool) -> dict:
    """What an embedding cache is of. rows: ord, sequence, cyclization_type, embedding; vectors of one width."""
    widths = rows.agg(F.min(F.size("embedding")), F.max(F.size("embedding")), F.count("*")).first()
    if widths[0] != widths[1]:
        raise ValueError("embedding matrix shape does not match cache metadata")
    return {"schema_version": CACHE_VERSION, "model_name": model, "model_revision": revision, "embedding_size": widths[0], "sequence_count": widths[2], "sequence_hash": sequence_hash(rows), "cyclic_rotation_average": rotation_average, "pooling": "mean_non_special_tokens"}


def write_embedding_cache(rows: DataFrame, path: str, model: str, revision: str | None, rotation_average: bool = True) -> dict:
    """The vectors as 32-bit floats in Parquet and their contract as JSON beside them."""
    contract = cache_contract(rows, model, revision, rotation_average)
    rows.withColumn("embedding", F.col("embedding").cast("array<float>")).write.parquet(f"{path}/vectors")
    rows.sparkSession.createDataFrame([(json.dumps(contract, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/contract")
    return contract


def read_embedding_cache(sequences: DataFrame, path: str, model: str, rotation_average: bool = True) -> DataFrame:
    """The vectors, if the cache is of these sequences (ord, sequence, cyclization_type) and this model; else an error
    that names the fields that differ."""
    spark = sequences.sparkSession
    held = json.loads(spark.read.text(f"{path}/contract").first()[0])
    want = {"schema_version": CACHE_VERSION, "model_name": model, "sequence_count": sequences.count(), "sequence_hash": sequence_hash(sequences), "cyclic_rotation_average": rotation_average}
    if wrong := [k for k, v in want.items() if held.get(k) != v]:
        raise ValueError(f"embedding cache metadata mismatch: {', '.join(wrong)}")
    vectors = spark.read.parquet(f"{path}/vectors")
    if vectors.filter(F.size("embedding") != held["embedding_size"]).limit(1).count() or vectors.count() != held["sequence_count"]:
        raise ValueError("embedding cache matrix shape is invalid")
    return vectors
