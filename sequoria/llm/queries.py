"""The registered queries of the training-data operators; each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, fingerprint, hnsw, hyperminhash, langid, licenses, merkle, mixing, ppm, quality, suffixdedup, urlfilter
from .common import crc_mod, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(spark, table(spark, sf_dir, "documents"))


def op2_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_one_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op5_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_mod(F.col("doc_id"), 3) == 1
    out = langid.identify(docs.select("doc_id", "text"), langid.samples(docs, ~held_out))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "lang_pred", "score")


def op6_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 7) != 2)


def op7_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.known_licenses(spark))


def op8_hash_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken")


def op9_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.classify(docs, quality.train(docs, quality.graded(table(spark, sf_dir, "labels")))).drop("text")


def op10_boosted_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op11_end_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(table(spark, sf_dir, "documents"))


def op12_merged_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.remove_repeats(table(spark, sf_dir, "documents"))


def op13_mountain_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_byte_bpe, op2_hnsw, op3_hyperminhash, op4_one_permutation, op5_cross_parsing, op6_ppm, op7_license_digests, op8_hash_mix, op9_ordinal_quality, op10_boosted_urls, op11_end_alignment, op12_merged_transforms, op13_mountain_manifest)}


def oracle_sql() -> dict[str, str]:
    """op7, op8 and op13 whole; the others' results are not expressible, and are tested against plain implementations."""
    return {"op7_license_digests": licenses.ORACLE_SQL, "op8_hash_mix": mixing.ORACLE_SQL, "op13_mountain_manifest": merkle.ORACLE_SQL}
