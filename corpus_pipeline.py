"""The corpus pipeline: language, quality, near-duplicates, mix, tokens. Each stage works on all that the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sequoria.llm import bpe, hyperminhash, langid, mixing, quality
from sequoria.llm.common import crc_mod, discard, materialize, small_side, table

#: The columns of documents, which all stages but the last return.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is undetermined: null text, or no letter. All others stay, repeats included.

    Columns other than those of documents are left out, here and in all stages; an empty table gives an empty one.
    """
    model = langid.samples(docs, crc_mod(F.col("doc_id"), 3) != 1)
    return langid.identify(docs.select(*COLUMNS), model).filter(F.col("lang_pred") != langid.UNDETERMINED).select(*COLUMNS)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a grade above the lowest is unlikely (under one half; a tie stays). Repeats are judged
    alike; a null or blank text has no features and is judged by the thresholds alone."""
    model = quality.train(docs, quality.graded(table(spark, sf_dir, "labels")))
    return quality.classify(docs.select(*COLUMNS), model).filter("selected").select(*COLUMNS)


def keyed(docs: DataFrame) -> DataFrame:
    """docs with a `key` that no two rows share: the doc_id, where that is one row's alone. Rows of one doc_id and one
    text become one, the least of them by lang, source and n_chars; texts that differ under one doc_id, and rows
    without doc_id, get keys below all ids."""
    docs = docs.select(*COLUMNS)
    shared = materialize(docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null").select("doc_id"), "shared-ids")
    plain = docs.withColumn("key", F.col("doc_id").cast("long"))
    if shared.isEmpty():
        return plain
    on = docs["doc_id"].eqNullSafe(shared["doc_id"])
    few = docs.join(small_side(shared), on, "left_semi").groupBy("doc_id", F.sha2("text", 256).alias("digest")).agg(F.min(F.struct("lang", "source", "n_chars", "text")).alias("row"))
    few = materialize(few.select("doc_id", "row.*").withColumn("nth", F.monotonically_increasing_id()), "shared")
    low = min(docs.agg(F.min("doc_id")).first()[0] or 0, 0)
    few = few.withColumn("key", F.lit(low - 1) - F.col("nth")).select(*COLUMNS, "key")
    return plain.join(small_side(shared), plain["doc_id"].eqNullSafe(shared["doc_id"]), "left_anti").unionByName(few)


def once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, and every text that has none.

    Near copies have a Jaccard of 0.8 or more on their 5-word shingle sets, the general rule; op3's own contract has
    0.85. Texts without words are no copies of each other and stay. See `keyed` for repeated ids.
    """
    each = keyed(docs)
    found = hyperminhash.near_duplicates(each.select(F.col("key").alias("doc_id"), "text"), 80, 100).filter("kept")
    found = materialize(found.select(F.col("doc_id").alias("key")), "kept")
    return each.join(small_side(found), "key", "left_semi").select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that the sources have their target weights. A null source is a source of its own,
    null texts have no size; rows of one id and source go together."""
    return mixing.mixed_documents(docs.select(*COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the digests of ids and decoded bytes; a null text has no token, repeats stay."""
    return bpe.encode_documents(spark, docs, with_ids=True)


STAGES = [("language ID", language), ("quality classifier", good), ("MinHash near-dedup", once), ("mixing sources", mixed), ("byte-level BPE", tokens)]

#: SQL cannot express the language, quality and token stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written to the shared folder and read again; what a stage alone needed is deleted."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(spark, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
