"""Cleaning of measurement and transfer rows with reasons, and their roll-up to one row an entity or sequence.

No step holds the rows of a key together: keys are aggregated, map side first, and only those that need it are joined
back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sequoria.functions import measure as M
from sequoria.functions import sequence as S
from sequoria.functions import topology as T
from sequoria.functions.plan import sealed, stored

UNSPECIFIED = ("", "unknown", "unspecified", "cyclic_unspecified")
# Labels of transfer rows.
LABELS = {"1": 1, "0": 0, "amp": 1, "non-amp": 0, "active": 1, "inactive": 0}


def _text(rows: DataFrame, name: str) -> Column:
    """A column of text; one that is missing is null. Null counts as absent."""
    return F.col(name).cast("string") if name in rows.columns else F.lit(None).cast("string")


def judge_core(rows: DataFrame, least: int = 5, most: int = 50) -> DataFrame:
    """rows (ord, sequence, mic, unit, target_species, cyclization_type and, where they are there, bonds, topology,
    molecular_weight, conversion_exclusion_reason) with reason, which is null for rows that are kept, and their
    canonical, topology_key, entity, target, weight, mic_ug_ml, censor and measured label.

    The first reason wins: veto from upstream, sequence, length, type, topology, weight, measurement.
    """
    blank = F.lit("")
    kind = F.lower(F.trim(F.coalesce(_text(rows, "cyclization_type"), blank)))
    out = rows.withColumns({"seq": S.normalized(F.coalesce(_text(rows, "sequence"), blank)), "kind": kind, "veto": T.first_filled(F.trim(_text(rows, "conversion_exclusion_reason")))})
    shape = F.coalesce(S.validity_reason(F.col("seq")), F.when(~F.length("seq").between(least, most), "sequence_length_out_of_range"), F.when(F.col("kind").isin(*UNSPECIFIED), "missing_or_unspecified_cyclization_type"))
    out = sealed(out, *rows.columns, "seq", "kind", F.coalesce(F.col("veto"), shape).alias("shape"))
    bonds = T.first_filled(_text(rows, "intrachain_bonds_json"), _text(rows, "bonds_json"), _text(rows, "bond_pairs"))
    fits = F.col("shape").isNull()  # rotations and bonds of rows that are excluded anyway are not made
    ring = fits & (F.col("kind") == "head_to_tail")
    out = out.withColumns({"canonical": F.when(ring, S.canonical(F.when(ring, F.col("seq")))).when(fits, F.col("seq")), "_bonds": F.when(fits, bonds)})
    out = T.with_topology_key(out, F.col("kind"), F.length("seq"), "_bonds", _text(rows, "topology"), "t")
    given, unit = T.first_filled(_text(rows, "molecular_weight")), M.normalized_unit(_text(rows, "unit"))
    molar = F.coalesce(unit == "um", F.lit(False))
    number = F.trim(given).try_cast("double")
    weight = F.when(given.isNotNull(), number).when(molar & (F.col("kind") == "head_to_tail"), S.molecular_weight(F.col("seq"), F.lit(True)))
    out = out.withColumns({"weight": weight, "heavy": F.when(given.isNotNull() & number.isNull(), F.concat(F.lit("could not convert string to float: '"), given, F.lit("'"))).when(molar & given.isNull() & (F.col("kind") != "head_to_tail"), "trusted_molecular_weight_required_for_non_head_uM")})
    out = out.withColumn("p", M.parsed(_text(rows, "mic"), F.coalesce(_text(rows, "unit"), blank), F.col("weight")))
    entity = F.concat(F.col("canonical"), F.lit("|"), F.col("kind"), F.lit("|"), F.col("t.key"))
    return sealed(
        out,
        *[F.col(c) for c in rows.columns if c not in ("reason",)],
        F.coalesce(F.col("shape"), F.col("t.reason"), F.col("heavy"), F.col("p.reason")).alias("reason"),
        "seq", "kind", "canonical", F.col("t.key").alias("topology_key"), entity.alias("entity"),
        F.lower(F.trim(F.coalesce(_text(rows, "target_species"), F.lit("unknown")))).alias("target"),
        "weight", F.col("p.mic").alias("mic_ug_ml"), F.col("p.censor").alias("censor"), F.col("p.label").alias("measured"),
    )


def target_flags(judged: DataFrame) -> DataFrame:
    """Of each entity and target of the rows that are kept so far: least and greatest label, and what a roll-up needs.
    One row has the least measurement, ties go to the first by ord."""
    best = F.struct("mic_ug_ml", "ord")
    carried = F.struct("canonical", "kind", "topology_key", "seq", *[c for c in ("peptide_id", "source", "reference") if c in judged.columns])
    return judged.filter("reason is null").groupBy("entity", "target").agg(F.min("measured").alias("low"), F.max("measured").alias("high"), F.count("*").alias("n"), F.min("ord").alias("first_ord"), F.min(best).alias("best"), F.min_by(carried, best).alias("row"))


def core_records(judged: DataFrame) -> DataFrame:
    """One row an entity: active if any agreed target is, with number of measurements, least value, and the row that has
    it; ties go to the target that came first, then to the first row. Targets with both labels are left out."""
    at = F.struct("best.mic_ug_ml", "first_ord", "best.ord")
    each = target_flags(judged).filter("low = high")
    out = each.groupBy("entity").agg(F.max("high").cast("int").alias("label"), F.sum("n").alias("measurement_count"), F.min("best.mic_ug_ml").alias("minimum_mic_ug_ml"), F.min_by(F.struct("row", F.col("best.ord").alias("ord")), at).alias("r"))
    row = lambda c: F.col(f"r.row.{c}") if c in judged.columns else F.lit(None).cast("string")
    return out.select(
        F.coalesce(T.first_filled(row("peptide_id")), S.stable_id("pep", F.col("entity"))).alias("peptide_id"),
        F.col("r.row.seq").alias("sequence"), F.col("r.row.canonical").alias("canonical_sequence"), F.col("entity").alias("cyclic_entity_key"), F.col("r.row.topology_key").alias("topology_key"),
        S.stable_id("cyc", F.col("entity")).alias("rotation_group_id"), F.col("r.row.kind").alias("cyclization_type"), "label", "measurement_count", "minimum_mic_ug_ml",
        F.coalesce(row("source"), F.lit("unknown")).alias("source"), F.coalesce(row("reference"), F.lit("")).alias("reference"), F.col("r.ord").alias("ord"),
    )


def core_exclusions(judged: DataFrame) -> DataFrame:
    """Rows that are left out, with reason: that of the row, or labels of its target that contradict each other. Rows are
    judged once and stored, so only columns that are needed should be given: entity, target, measured and reason are."""
    judged = stored(judged, "judged", swept=True)
    kept = judged.filter("reason is null")
    both = kept.groupBy("entity", "target").agg(F.min("measured").alias("low"), F.max("measured").alias("high")).filter("low < high").select("entity", "target")
    kept = kept.join(both, ["entity", "target"], "left_semi").withColumn("reason", F.lit("conflicting_labels_same_target"))
    return judged.filter("reason is not null").unionByName(kept)


def judge_transfer(rows: DataFrame, least: int = 5, most: int = 100) -> DataFrame:
    """rows (ord, sequence, label as text) with seq, y and reason: of the row, else of its sequence (labels that
    contradict each other, or a repeat of the first row by ord); null for rows that are kept."""
    domain = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    out = rows.withColumns({"seq": S.normalized(F.coalesce(_text(rows, "sequence"), F.lit(""))), "y": F.try_element_at(domain, F.lower(F.trim(F.coalesce(_text(rows, "label"), F.lit("")))))})
    out = out.withColumn("reason", F.coalesce(S.validity_reason(F.col("seq")), F.when(~F.length("seq").between(least, most), "sequence_length_out_of_range"), F.when(F.col("y").isNull(), "invalid_pretrain_label")))
    many = out.filter("reason is null").groupBy("seq").agg(F.min("y").alias("low"), F.max("y").alias("high"), F.min("ord").alias("first_ord"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = F.when(F.col("low") < F.col("high"), "conflicting_duplicate_pretrain_labels").when(F.col("ord") > F.col("first_ord"), "duplicate_pretrain_sequence")
    return out.join(many, "seq", "left").withColumn("reason", F.coalesce("reason", later)).drop("low", "high", "first_ord")


def transfer_records(judged: DataFrame) -> DataFrame:
    """Rows that are kept, with a stable record id."""
    return judged.filter("reason is null").select("ord", S.stable_id("pre", F.col("seq")).alias("record_id"), F.col("seq").alias("sequence"), F.col("y").alias("label"), *[c for c in ("source", "reference") if c in judged.columns])


def group_conflicts(rows: DataFrame, group: str, label: str = "label") -> DataFrame:
    """Groups whose rows have both labels; assigning folds to such groups is refused."""
    return rows.groupBy(group).agg(F.min(label).alias("low"), F.max(label).alias("high")).filter("low < high").select(group)


def agreed_groups(rows: DataFrame, group: str, label: str = "label") -> DataFrame:
    """(group, label), one row a group; a group with both labels is an error when it is read."""
    each = rows.groupBy(group).agg(F.min(label).alias("low"), F.max(label).alias("high"))
    return each.select(group, F.when(F.col("low") == F.col("high"), F.col("high")).otherwise(F.raise_error(F.concat(F.lit("conflicting labels in group "), F.col(group).cast("string"))).cast("int")).alias(label))
