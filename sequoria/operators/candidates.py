"""Positive candidates out of the tables of a peptide collection: allowed functions, first valid sequence, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sequoria.functions import sequence as S

# Names of functions that count.
FUNCTIONS = ("anti-bacterial", "anti-gram+", "anti-gram-", "anti-mycobacterial", "anti-tubercular", "anti-mrsa")
FIELDS = ("Seq_for_PP", "Tran_one_letter", "One_letter")


def valid_sequence(raw: Column, least: int = 5, most: int = 50) -> Column:
    """The normalised sequence if its length and letters are in order, else null."""
    seq = S.normalized(raw)
    return F.when(F.length(seq).between(least, most) & seq.rlike(f"^[{S.ALPHABET}]+\\z"), seq)


def _last(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The last row of each key by ord."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), "ord").alias("_x")).select(key, "_x.*")


def candidates(functions: DataFrame, mapping: DataFrame, basic: DataFrame, sequences: DataFrame, structures: DataFrame, allowed: tuple[str, ...] = FUNCTIONS) -> DataFrame:
    """One row a peptide with an allowed function and a valid sequence: the first of three fields that is valid, its
    name, the functions and their evidence, sorted and joined. A missing mapping never makes a negative.

    functions (Function_ID, Name); mapping (CPID, FunctionID, Evidence1..3, Link1..3); basic (ord, CPID, Name, PubMed);
    sequences (ord, CPID, the three fields); structures (ord, CPID, SMILES, Structure_evidence). Of rows of one CPID the
    last counts.
    """
    named = functions.filter(F.lower(F.trim("Name")).isin(*allowed)).groupBy(F.col("Function_ID").cast("string").alias("FunctionID")).agg(F.max("Name").alias("function"))
    rows = mapping.withColumn("FunctionID", F.col("FunctionID").cast("string")).join(named, "FunctionID")
    blank = F.lit("")
    filled = lambda c: F.coalesce(F.col(c), blank)
    pairs = F.filter(F.array(*[F.when((filled(f"Evidence{k}") != "") | (filled(f"Link{k}") != ""), F.concat(filled(f"Evidence{k}"), F.lit("|"), filled(f"Link{k}"))) for k in (1, 2, 3)]), lambda x: x.isNotNull())
    known = rows.groupBy("CPID").agg(F.array_sort(F.collect_set(F.struct("FunctionID", "function"))).alias("f"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(pairs)))).alias("e"))
    valid = [valid_sequence(F.col(f)) for f in FIELDS]
    field = F.coalesce(*[F.when(v.isNotNull(), F.lit(f)) for v, f in zip(valid, FIELDS, strict=True)])
    seqs = _last(sequences, "CPID", list(FIELDS)).select("CPID", F.coalesce(*valid).alias("sequence"), field.alias("sequence_source_field")).filter("sequence is not null")
    out = known.join(seqs, "CPID").join(_last(basic, "CPID", ["Name", "PubMed"]), "CPID", "left").join(_last(structures, "CPID", ["SMILES", "Structure_evidence"]), "CPID", "left")
    joined = lambda c: F.array_join(c, "##")
    return out.select(
        F.col("CPID").alias("peptide_id"), filled("Name").alias("name"), "sequence", "sequence_source_field", F.length("sequence").alias("length"), F.lit(1).alias("antibacterial_annotation"),
        F.lit("positive_candidate_only_no_mic_threshold_label").alias("label_scope"), F.lit("cyclic_unspecified").alias("cyclization_type"), joined(F.col("f.FunctionID")).alias("function_ids"), joined(F.col("f.function")).alias("function_names"),
        joined(F.col("e")).alias("function_evidence"), filled("PubMed").alias("pubmed"), filled("SMILES").alias("smiles"), filled("Structure_evidence").alias("structure_evidence"),
    )
