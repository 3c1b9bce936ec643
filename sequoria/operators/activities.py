"""Activity rows out of nested measurement documents, and the match of an index with candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = r"\d+(?:\.\d+)?"


def six_digits(x: Column) -> Column:
    """A positive number as C's %g prints it: six significant digits, no trailing zeros, an exponent beyond 1e-4 to 1e6."""
    text = F.format_string("%.5e", x)
    power = F.regexp_extract(text, r"e([+-]\d+)$", 1).cast("int")
    digits = F.replace(F.regexp_extract(text, r"^([\d.]+)e", 1), F.lit("."), F.lit(""))
    fixed = F.when(power >= 0, F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, F.lit(6)))).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits))
    bare = lambda c: F.regexp_replace(c, r"\.?0*$", "")
    wide = F.concat(bare(F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, 2, 5))), F.regexp_extract(text, r"(e[+-]\d+)$", 1))
    return F.when(power.between(-4, 5), bare(fixed)).otherwise(wide)


def censored(raw: Column, normalized: Column) -> Column:
    """struct(value, status, reason): the sign of the reported text before the normalised number. Ranges and texts that
    cannot be read are excluded, as are numbers that are missing, not finite or not positive."""
    text = F.replace(F.replace(F.trim(F.coalesce(raw, F.lit(""))), F.lit("≤"), F.lit("<=")), F.lit("≥"), F.lit(">="))
    sign = F.regexp_extract(text, rf"^(<=|>=|<|>)?\s*{NUMBER}\z", 1)
    finite = normalized.isNotNull() & ~F.isnan(normalized) & (normalized > 0) & (normalized < float("inf"))
    single, span = text.rlike(rf"^(<=|>=|<|>)?\s*{NUMBER}\z"), text.rlike(rf"^{NUMBER}\s*[-–—]\s*{NUMBER}\z")
    value = F.when(finite & single, F.when(sign != "", F.concat(sign, six_digits(normalized))).otherwise(normalized.cast("string")))
    reason = F.when(~finite, "missing_or_invalid_dbaasp_normalized_activity").when(single, "").when(span, "range_cannot_be_reconstructed_from_scalar_activity").otherwise("unparseable_raw_concentration_censor")
    return F.struct(value.alias("value"), F.when(reason == "", "normalized").otherwise("excluded").alias("status"), reason.alias("reason"))


def _name(x: Column) -> Column:
    return F.upper(F.trim(F.coalesce(x, F.lit(""))))


def cyclization(bonds: Column, sequence: Column) -> Column:
    """head_to_tail for an NCB cycle or an AMD bond from first to last, disulfide for DSB, else sidechain_or_other."""
    ring = F.exists(bonds, lambda b: _name(b["cycleType"]["name"]) == "NCB")
    ends = F.exists(bonds, lambda b: F.coalesce((b["position1"] == 1) & (b["position2"] == F.length(sequence)), F.lit(False)) & (_name(b["type"]["name"]) == "AMD"))
    bridge = F.exists(bonds, lambda b: _name(b["type"]["name"]) == "DSB")
    return F.when(ring | ends, "head_to_tail").when(bridge, "disulfide").otherwise("sidechain_or_other")


def mic_rows(documents: DataFrame) -> DataFrame:
    """One row for each MIC activity of a cyclic document; documents without bonds or sequence have none."""
    sequence = F.upper(F.trim("sequence"))
    cyclic = documents.filter((F.size(F.coalesce("intrachainBonds", F.array())) > 0) & (F.coalesce(sequence, F.lit("")) != ""))
    ids = F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce("articles", F.array()), lambda a: a["pubmed"]["pubmedId"]), lambda p: p.isNotNull() & (p != "")))), "##")
    kept = F.filter("targetActivities", lambda a: (_name(a["activityMeasureGroup"]["name"]) == "MIC") | (_name(a["activityMeasureValue"]) == "MIC"))
    rows = cyclic.select(F.coalesce("dbaaspId", F.col("id").cast("string")).alias("peptide_id"), sequence.alias("sequence"), cyclization(F.col("intrachainBonds"), sequence).alias("cyclization_type"), F.to_json("intrachainBonds").alias("intrachain_bonds_json"), "url", ids.alias("pubmed"), F.explode(kept).alias("a"))
    made, reported = censored(F.col("a.concentration"), F.col("a.activity")), F.col("a.activity").isNull()
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return rows.withColumn("c", made).select(
        "peptide_id",
        "sequence",
        F.when(reported, blank("a.concentration")).otherwise(F.col("c.value")).alias("mic"),
        F.when(reported, blank("a.unit.name")).otherwise("ug/mL").alias("unit"),
        F.col("a.concentration").alias("mic_raw"),
        blank("a.unit.name").alias("unit_raw"),
        F.when(reported, "raw_value_requires_downstream_conversion").otherwise(F.col("c.status")).alias("conversion_status"),
        F.when(reported, "").otherwise(F.col("c.reason")).alias("conversion_exclusion_reason"),
        blank("a.targetSpecies.name").alias("target_species"),
        "cyclization_type",
        "intrachain_bonds_json",
        F.col("a.id").alias("activity_id"),
        blank("a.medium.name").alias("medium"),
        F.col("a.ph").alias("ph"),
        F.col("a.ionicStrength").alias("ionic_strength"),
        F.col("url").alias("reference"),
        "pubmed",
    )


def match_index(index: DataFrame, candidates: DataFrame) -> DataFrame:
    """Rows of the index (sequence, ...) whose trimmed upper-case sequence a candidate (sequence, peptide_id) has, with
    the sorted ids of all of those, repeats kept, joined by ##."""
    key = F.upper(F.trim(F.coalesce("sequence", F.lit("")))).alias("_key")
    ids = candidates.select(key, F.coalesce(F.col("peptide_id").cast("string"), F.lit("")).alias("_id")).groupBy("_key").agg(F.array_join(F.array_sort(F.collect_list("_id")), "##").alias("matched_ids"))
    return index.withColumn("_key", key).join(ids, "_key").drop("_key")
