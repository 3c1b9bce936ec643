"""Choice among taxonomy suggestions, audited mappings, and the split of rows by verified domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUGGESTIONS = "array<struct<sci_name:string, tax_id:string, matched_term:string>>"
MAPPED = ("status", "selected_tax_id", "selected_sci_name", "match_quality", "tax_id", "scientific_name", "rank", "domain_name", "domain_tax_id", "audit_reason")


def plain_name(raw: Column) -> Column:
    """Lower case with single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(raw, F.lit(""))), r"(?U)\s+", " "))


def binomial(raw: Column) -> Column:
    """The first two words of a name without trailing dots; null for fewer, or for a candidate species."""
    words = F.regexp_extract_all(plain_name(raw), F.lit("[a-z][a-z.-]*"), F.lit(0))
    two = F.concat_ws(" ", *[F.regexp_replace(F.get(words, F.lit(i)), r"\.+$", "") for i in range(2)])
    return F.when((F.size(words) >= 2) & (F.get(words, F.lit(0)) != "candidatus"), two)


def chosen(target: Column, suggestions: Column) -> Column:
    """struct(tax_id, sci_name, matched_term, suggestion_rank, match_quality) of the first suggestion with the same
    name, else of the first with the same binomial; null if there is none."""
    name, pair = plain_name(target), binomial(target)
    placed = F.transform(suggestions, lambda s, i: F.struct(s["tax_id"].alias("tax_id"), s["sci_name"].alias("sci_name"), s["matched_term"].alias("matched_term"), (i + 1).alias("suggestion_rank")))
    exact = F.get(F.filter(placed, lambda s: (plain_name(s["sci_name"]) == name) | (plain_name(s["matched_term"]) == name)), F.lit(0))
    close = F.get(F.filter(placed, lambda s: F.coalesce(binomial(s["sci_name"]) == pair, F.lit(False))), F.lit(0))
    made = lambda s, quality: F.struct(*[s[c].alias(c) for c in ("tax_id", "sci_name", "matched_term", "suggestion_rank")], F.lit(quality).alias("match_quality"))
    return F.when(exact.isNotNull(), made(exact, "exact")).when(close.isNotNull(), made(close, "binomial_domain_only"))


def mappings(targets: DataFrame) -> DataFrame:
    """targets (target_species, suggestions, reports: array of struct(tax_id, rank, scientific_name, domain_name,
    domain_tax_id), error) to one audited row each. Nothing is inferred: a missing, empty or ambiguous report leaves
    the target unmatched, with the reason."""
    out = targets.withColumn("s", F.when(F.col("error").isNull(), chosen(F.col("target_species"), F.coalesce("suggestions", F.array().cast(SUGGESTIONS)))))
    one = F.when((F.size("reports") == 1) & (F.coalesce(F.get("reports", F.lit(0))["domain_name"], F.lit("")) != ""), F.get("reports", F.lit(0)))
    out = out.withColumn("r", F.when(F.col("s").isNotNull(), one))
    bacterial = F.lower("r.domain_name") == "bacteria"
    status = F.when(F.col("error").isNotNull(), "error").when(F.col("r").isNull(), "unmatched").when(bacterial, "bacterial").otherwise("non_bacteria")
    reason = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("s").isNull(), "no_reliable_ncbi_suggestion")
        .when(F.col("reports").isNull(), "missing_or_invalid_dataset_report")
        .when(F.col("r").isNull(), "missing_or_ambiguous_dataset_report")
        .when(bacterial, "")
        .otherwise("classification.domain.name_is_not_Bacteria")
    )
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return out.select(
        "target_species",
        status.alias("status"),
        F.size(F.coalesce("suggestions", F.array().cast(SUGGESTIONS))).alias("suggestion_count"),
        text("s.tax_id").alias("selected_tax_id"),
        text("s.sci_name").alias("selected_sci_name"),
        text("s.suggestion_rank").alias("suggestion_rank"),
        text("s.match_quality").alias("match_quality"),
        *[text(f"r.{c}").alias(c) for c in ("tax_id", "scientific_name", "rank", "domain_name", "domain_tax_id")],
        reason.alias("audit_reason"),
    )


def verified_rows(rows: DataFrame, mapped: DataFrame) -> DataFrame:
    """rows (target_species, ...) with the taxonomy_ columns of their mapping and `kept`: bacterial, and said to be so.
    Of several mappings of a target the last by ord holds, if they have one, else the greatest; targets without one are
    audited. Rows are never dropped here."""
    held = F.struct(*MAPPED)
    once = mapped.groupBy("target_species").agg(F.max_by(held, "ord").alias("m") if "ord" in mapped.columns else F.max(held).alias("m"))
    once = once.select("target_species", *[F.col(f"m.{c}").alias(f"taxonomy_{c}") for c in MAPPED])
    out = rows.join(once, "target_species", "left")
    lost = {"taxonomy_status": "unmatched", "taxonomy_audit_reason": "target_missing_from_mapping"}
    out = out.withColumns({f"taxonomy_{c}": F.coalesce(f"taxonomy_{c}", F.lit(lost.get(f"taxonomy_{c}", ""))) for c in MAPPED})
    return out.withColumn("kept", (F.col("taxonomy_status") == "bacterial") & (F.col("taxonomy_domain_name") == "Bacteria"))
