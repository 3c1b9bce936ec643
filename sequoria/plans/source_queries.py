"""Queries on activity rows, candidates, taxonomy mappings, streams and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from sequoria.functions import sequence as S
from sequoria.operators import activities as A
from sequoria.operators import candidates as D
from sequoria.operators import taxonomy as N
from sequoria.sources import readers, sinks
from sequoria.streaming import events as stream_events

from . import proxies as P
from .base import query


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL")
def json_extract(spark, sf_dir):
    return P.table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k bigint")["k"].alias("k")).groupBy("event_type", "k").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT lower(trim(event_type)) AS target FROM events")
def distinct_targets(spark, sf_dir):
    return P.table(spark, sf_dir, "events").select(F.lower(F.trim("event_type")).alias("target")).distinct()


_NESTED = """
nested AS (SELECT ord, doc_id, pos, seq, CASE pos % 5 WHEN 0 THEN '>20' WHEN 1 THEN '≤ 7.5' WHEN 2 THEN '10-20' WHEN 3 THEN 'abc' ELSE '3' END AS concentration,
  CASE WHEN pos % 11 = 0 THEN NULL WHEN pos % 11 = 1 THEN -1.0::DOUBLE ELSE (pos % 90 + 1) * 0.5::DOUBLE END AS activity, CASE pos % 4 WHEN 0 THEN 'mic' WHEN 1 THEN 'MBC' ELSE NULL END AS grp, CASE pos % 4 WHEN 2 THEN ' MIC ' ELSE 'LC50' END AS val FROM docs)
"""


def _nested(spark, sf_dir):
    """Each sequence as a nested measurement document of one activity."""
    pos = F.col("pos")
    pick = P._pick
    name = lambda c: F.struct(c.alias("name"))
    none = F.lit(None).cast("string")
    bond = F.struct(F.lit(1).alias("position1"), F.when(pos % 3 == 0, F.length("seq")).otherwise(3).cast("int").alias("position2"), name(F.when(pos % 3 == 1, "DSB").otherwise("AMD")).alias("type"), name(F.when(pos % 10 == 9, "NCB").otherwise(none)).alias("cycleType"), name(none).alias("chainParticipating"))
    act = F.struct(F.col("ord").alias("id"), name(F.when(pos % 4 == 0, "mic").when(pos % 4 == 1, "MBC")).alias("activityMeasureGroup"), F.when(pos % 4 == 2, " MIC ").otherwise("LC50").alias("activityMeasureValue"), pick(pos, ">20", "≤ 7.5", "10-20", "abc", "3").alias("concentration"), name(F.lit("µM")).alias("unit"), F.when(pos % 11 == 0, F.lit(None)).when(pos % 11 == 1, -1.0).otherwise((pos % 90 + 1) * 0.5).cast("double").alias("activity"), name(F.lit("E. coli")).alias("targetSpecies"), name(none).alias("medium"), none.alias("ph"), none.alias("ionicStrength"))
    article = lambda x: F.struct(F.struct(x.alias("pubmedId")).alias("pubmed"))
    rows = P.sequences(spark, sf_dir)
    return rows.select(F.col("doc_id").alias("id"), F.concat(F.lit("D"), F.col("ord").cast("string")).alias("dbaaspId"), F.lower("seq").alias("sequence"), F.lit("u").alias("url"), F.when(pos % 6 != 5, F.array(bond)).otherwise(F.array().cast(bond_type())).alias("intrachainBonds"), F.array(article(F.lit("9")), article(F.lit("12")), article(F.lit("9"))).alias("articles"), F.array(act).alias("targetActivities"))


def bond_type() -> str:
    return "array<struct<position1:int, position2:int, type:struct<name:string>, cycleType:struct<name:string>, chainParticipating:struct<name:string>>>"


@query(_NESTED + """, kept AS (SELECT *, activity IS NOT NULL AND activity > 0 AS fine FROM nested WHERE pos % 6 <> 5 AND seq <> '' AND (grp = 'mic' OR trim(val) = 'MIC'))
SELECT 'D' || ord AS peptide_id, seq AS sequence, CASE WHEN pos % 10 = 9 OR (pos % 3 = 0) OR (pos % 3 <> 1 AND len(seq) = 3) THEN 'head_to_tail' WHEN pos % 3 = 1 THEN 'disulfide' ELSE 'sidechain_or_other' END AS cyclization_type,
  CASE WHEN activity IS NULL THEN concentration WHEN fine AND pos % 5 IN (0, 1, 4) THEN CASE pos % 5 WHEN 0 THEN '>' || regexp_replace(printf('%.1f', activity), '\\.0$', '') WHEN 1 THEN '<=' || regexp_replace(printf('%.1f', activity), '\\.0$', '') ELSE printf('%.1f', activity) END END AS mic,
  CASE WHEN activity IS NULL THEN 'raw_value_requires_downstream_conversion' WHEN fine AND pos % 5 IN (0, 1, 4) THEN 'normalized' ELSE 'excluded' END AS conversion_status,
  CASE WHEN activity IS NULL THEN '' WHEN NOT fine THEN 'missing_or_invalid_dbaasp_normalized_activity' WHEN pos % 5 = 2 THEN 'range_cannot_be_reconstructed_from_scalar_activity' WHEN pos % 5 = 3 THEN 'unparseable_raw_concentration_censor' ELSE '' END AS reason, '12##9' AS pubmed FROM kept""")
def mic_rows(spark, sf_dir):
    """Measurement rows out of nested documents, with their censoring, class of cyclization and articles."""
    out = A.mic_rows(_nested(spark, sf_dir))
    return out.select("peptide_id", "sequence", "cyclization_type", "mic", "conversion_status", F.col("conversion_exclusion_reason").alias("reason"), "pubmed")


@query("c AS (SELECT seq, string_agg('P' || doc_id, '##' ORDER BY 'P' || doc_id) AS ids FROM docs WHERE role = 'core' AND len(seq) > 8 GROUP BY seq) SELECT ord, c.ids AS matched_ids FROM docs d JOIN c ON c.seq = d.seq WHERE role = 'pretrain'")
def match_index(spark, sf_dir):
    """Index rows with the ids of all candidates of the same sequence."""
    rows = P.sequences(spark, sf_dir)
    index = rows.filter("role = 'pretrain'").select("ord", F.concat(F.lit(" "), F.lower("seq")).alias("sequence"))
    own = rows.filter("role = 'core' and length(seq) > 8").select("seq", "doc_id").select(F.col("seq").alias("sequence"), F.concat(F.lit("P"), F.col("doc_id").cast("string")).alias("peptide_id"))
    return A.match_index(index, own).select("ord", "matched_ids")


_FUNCTION = "CASE n_nationkey % 5 WHEN 0 THEN 'Anti-Gram+' WHEN 1 THEN ' anti-bacterial ' WHEN 2 THEN 'anti-fungal' WHEN 3 THEN 'Anti-MRSA' ELSE 'anti-gram' END"


@query(f"""fn AS (SELECT CAST(n_nationkey AS VARCHAR) AS id, {_FUNCTION} AS name FROM nation WHERE n_nationkey % 5 IN (0, 1, 3)),
mp AS (SELECT user_id AS cpid, fn.id, fn.name, CASE WHEN event_id % 3 = 0 THEN 'e' || (event_id % 4) ELSE '' END AS ev, CASE WHEN event_id % 2 = 0 THEN 'l' ELSE NULL END AS li FROM events JOIN fn ON fn.id = CAST(event_id % 25 AS VARCHAR)),
f AS (SELECT cpid, string_agg(id, '##' ORDER BY id) AS ids, string_agg(name, '##' ORDER BY id) AS names FROM (SELECT DISTINCT cpid, id, name FROM mp) t GROUP BY cpid),
e AS (SELECT cpid, string_agg(p, '##' ORDER BY p) AS evidence FROM (SELECT DISTINCT cpid, ev || '|' || coalesce(li, '') AS p FROM mp WHERE ev <> '' OR li IS NOT NULL) t GROUP BY cpid),
sq AS (SELECT doc_id AS cpid, arg_max(raw, ord) AS a, arg_max(seq, ord) AS b FROM docs GROUP BY doc_id),
v AS (SELECT cpid, CASE WHEN len(a) BETWEEN 5 AND 50 AND regexp_full_match(a, '[ACDEFGHIKLMNPQRSTVWY]+') THEN a END AS va, CASE WHEN len(b) BETWEEN 5 AND 50 THEN b END AS vb FROM sq)
SELECT CAST(f.cpid AS BIGINT) AS peptide_id, coalesce(va, vb) AS sequence, CASE WHEN va IS NOT NULL THEN 'Seq_for_PP' ELSE 'One_letter' END AS sequence_source_field, ids AS function_ids, names AS function_names, coalesce(evidence, '') AS function_evidence, coalesce(source, '') AS name
FROM f JOIN v ON v.cpid = f.cpid LEFT JOIN e ON e.cpid = f.cpid LEFT JOIN documents d ON d.doc_id = f.cpid WHERE coalesce(va, vb) IS NOT NULL""")
def candidates(spark, sf_dir):
    """Positive candidates: allowed functions joined with the first valid sequence and all evidence."""
    k = F.col("n_nationkey") % 5
    functions = P.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("Function_ID"), P._pick(k, "Anti-Gram+", " anti-bacterial ", "anti-fungal", "Anti-MRSA", "anti-gram").alias("Name"))
    e = F.col("event_id")
    mapping = P.table(spark, sf_dir, "events").select(F.col("user_id").alias("CPID"), (e % 25).alias("FunctionID"), F.when(e % 3 == 0, F.concat(F.lit("e"), (e % 4).cast("string"))).otherwise("").alias("Evidence2"), F.when(e % 2 == 0, "l").alias("Link2"), *[F.lit(None).cast("string").alias(c) for c in ("Evidence1", "Link1", "Evidence3", "Link3")])
    rows = P.sequences(spark, sf_dir).select("ord", F.col("doc_id").alias("CPID"), F.col("raw").alias("Seq_for_PP"), F.lit(None).cast("string").alias("Tran_one_letter"), F.col("seq").alias("One_letter"))
    docs = P.table(spark, sf_dir, "documents").select(F.lit(0).alias("ord"), F.col("doc_id").alias("CPID"), F.col("source").alias("Name"), F.lit("").alias("PubMed"), F.lit("").alias("SMILES"), F.lit("").alias("Structure_evidence"))
    out = D.candidates(functions, mapping, docs, rows, docs)
    return out.select("peptide_id", "sequence", "sequence_source_field", "function_ids", "function_names", "function_evidence", "name")


_MAPPED = """
tg AS (SELECT n_nationkey AS k, n_name AS target, r_name FROM nation JOIN region ON r_regionkey = n_regionkey),
mp AS (SELECT k, target, CASE WHEN k % 7 = 6 THEN 'error' WHEN k % 6 = 5 OR k % 5 = 4 THEN 'unmatched' WHEN r_name = 'EUROPE' THEN 'bacterial' ELSE 'non_bacteria' END AS status,
  CASE WHEN k % 7 = 6 THEN 'ncbi_request_error:x' WHEN k % 6 = 5 THEN 'no_reliable_ncbi_suggestion' WHEN k % 5 = 4 THEN CASE WHEN k % 2 = 0 THEN 'missing_or_invalid_dataset_report' ELSE 'missing_or_ambiguous_dataset_report' END WHEN r_name = 'EUROPE' THEN '' ELSE 'classification.domain.name_is_not_Bacteria' END AS reason,
  CASE WHEN k % 7 <> 6 AND k % 6 <> 5 THEN CASE WHEN k % 4 = 0 THEN '2' ELSE '1' END ELSE '' END AS rank,
  CASE WHEN k % 7 <> 6 AND k % 6 <> 5 AND k % 5 <> 4 THEN CASE WHEN r_name = 'EUROPE' THEN 'Bacteria' ELSE r_name END ELSE '' END AS domain FROM tg)
"""


def _targets(spark, sf_dir):
    nation, region = (P.table(spark, sf_dir, t) for t in ("nation", "region"))
    rows = nation.join(region, nation.n_regionkey == region.r_regionkey).select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("target_species"), "r_name")
    k = F.col("k")
    hit = F.struct(F.lower("target_species").alias("sci_name"), k.cast("string").alias("tax_id"), F.lit("").alias("matched_term"))
    miss = F.struct(F.lit("something else").alias("sci_name"), F.lit("0").alias("tax_id"), F.lit("none").alias("matched_term"))
    report = F.struct(k.cast("string").alias("tax_id"), F.lit("species").alias("rank"), F.col("target_species").alias("scientific_name"), F.when(F.col("r_name") == "EUROPE", "Bacteria").otherwise(F.col("r_name")).alias("domain_name"), F.lit("2").alias("domain_tax_id"))
    reports = F.when((k % 5 == 4) & (k % 2 == 0), F.lit(None)).when(k % 5 == 4, F.array(report, report)).otherwise(F.array(report))
    suggestions = F.when(k % 6 == 5, F.array(miss)).when(k % 4 == 0, F.array(miss, hit)).otherwise(F.array(hit, miss))
    return rows.select("k", "target_species", suggestions.alias("suggestions"), reports.alias("reports"), F.when(k % 7 == 6, "ncbi_request_error:x").alias("error"))


@query(_MAPPED + " SELECT target AS target_species, status, reason AS audit_reason, rank AS suggestion_rank, domain AS domain_name FROM mp")
def taxonomy_mapping(spark, sf_dir):
    """One audited mapping a target."""
    return N.mappings(_targets(spark, sf_dir)).select("target_species", "status", "audit_reason", "suggestion_rank", "domain_name")


@query(_MAPPED + " SELECT s_suppkey, coalesce(status, 'unmatched') AS status, coalesce(reason, 'target_missing_from_mapping') AS audit_reason, coalesce(status = 'bacterial' AND domain = 'Bacteria', false) AS kept FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_nationkey <> 3 LEFT JOIN mp ON target = n_name")
def taxonomy_partition(spark, sf_dir):
    """Rows split by the verified domain of their target, with the audit reason."""
    nation = P.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("target_species")).filter("s_nationkey <> 3")
    rows = P.table(spark, sf_dir, "supplier").join(nation, "s_nationkey", "left").select("s_suppkey", "target_species")
    out = N.verified_rows(rows, N.mappings(_targets(spark, sf_dir)))
    return out.select("s_suppkey", F.col("taxonomy_status").alias("status"), F.col("taxonomy_audit_reason").alias("audit_reason"), "kept")


@query("SELECT r_name AS domain, string_agg(DISTINCT n_name, '##' ORDER BY n_name) AS names, count(*) AS n FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY r_name")
def set_collect(spark, sf_dir):
    nation, region = (P.table(spark, sf_dir, t) for t in ("nation", "region"))
    return nation.join(region, nation.n_regionkey == region.r_regionkey).groupBy(F.col("r_name").alias("domain")).agg(F.array_join(F.array_sort(F.collect_set("n_name")), "##").alias("names"), F.count("*").alias("n"))


@query("SELECT role, count(*) AS n, count(DISTINCT source) AS sources FROM (SELECT source, role FROM texts WHERE role = 'core' UNION ALL SELECT source, role FROM texts WHERE role = 'pretrain' UNION ALL SELECT NULL, 'extra' FROM region) t GROUP BY role")
def source_union(spark, sf_dir):
    """Rows of sources with differing columns, one after the other."""
    texts = P.labelled_texts(spark, sf_dir)
    out = sinks.union_all(texts.filter("role = 'core'").select("source", "role"), texts.filter("role = 'pretrain'").select("role", "source"), P.table(spark, sf_dir, "region").select(F.lit("extra").alias("role")))
    return out.groupBy("role").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_items(spark, sf_dir):
    """What is still to do after a run that was cut off."""
    return sinks.pending(P.table(spark, sf_dir, "documents").select("doc_id"), P.table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_window_counts(spark, sf_dir):
    """An extension: hourly counts of the events as a stream that is run over all that is there."""
    path = f"{sf_dir}/events.parquet"
    found = stream_events.run_all(stream_events.window_counts(stream_events.stream(spark, path + "*", path), late="3650 days"))
    return found.withColumn("total", F.round("total", 4))


def _vector_rows(spark, sf_dir):
    rows = P.table(spark, sf_dir, "embeddings").filter("label is not null")
    return rows.select("vec_id", (F.col("label") < 5).cast("int").alias("label"), (F.col("vec_id") % 97).alias("grp"), F.col("embedding").cast("array<double>").alias("features"))


@query()
def nested_evaluation(spark, sf_dir):
    """Nested grouped evaluation of a linear and a forest family on all labelled vectors: metrics by outer fold."""
    from sequoria.models import families, protocol
    from sequoria.operators import evaluation as E

    found = families.m0_families(trees=20)
    few = {"lr": families.Family("lr", found["lr"].make, ({"C": 1.0},)), "rf": families.Family("rf", found["rf"].make, ({"max_depth": 5, "min_samples_leaf": 1},), scaled=False)}
    scored = protocol.evaluate(_vector_rows(spark, sf_dir), few, "vec_id", "grp", seeds=(42,), n=3)
    return E.metrics(E.cells(scored, protocol.SCORED), protocol.SCORED)


@query()
def fusion_ablation(spark, sf_dir):
    """m0, m1, m0_m1 and m2 over one set of grouped folds: metrics of each family and of the nested choice. The blocks of
    a vector are how many of its values are over some bounds, the vector, and its moments."""
    from sequoria.models import protocol
    from sequoria.operators import evaluation as E

    v = F.col("features")
    over = lambda x: F.aggregate(v, F.lit(0.0), lambda s, y: s + (y > x).cast("double"))
    power = lambda k: F.aggregate(v, F.lit(0.0), lambda s, y: s + F.pow(y, F.lit(k)))
    rows = _vector_rows(spark, sf_dir).select("vec_id", "grp", "label", F.array(*[over(x) for x in (-0.2, -0.1, 0.0, 0.1, 0.2)]).alias("handcrafted"), v.alias("embedding"), F.array(power(2.0), power(3.0), power(4.0)).alias("structure"))
    scored = protocol.ablation(rows, "vec_id", "grp", seeds=(42,), n=2, trees=10, rounds=20)
    by = ["feature_set", *protocol.SCORED]
    return E.metrics(E.cells(scored, by), by)


@query()
def format_round_trip(spark, sf_dir):
    """Sequences written as FASTA and read again: as many, with the same digests, by source."""
    from sequoria.functions.plan import scratch

    rows = P.sequences(spark, sf_dir).filter("seq <> ''").select(F.concat_ws("_", "source", "ord").alias("record_id"), F.col("seq").alias("sequence"))
    path = scratch(spark, "fasta")
    readers.write_fasta(rows, path)
    return readers.fasta(spark, path).groupBy(F.split("record_id", "_")[0].alias("source")).agg(F.count("*").alias("n"), F.sum(F.length("sequence")).alias("letters"), F.min(S.stable_id("rec", F.col("sequence"))).alias("least"))
