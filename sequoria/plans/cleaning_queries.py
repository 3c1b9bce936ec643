"""Queries on cleaning and roll-up of measurement and transfer rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from sequoria.functions import topology as T
from sequoria.operators import cleaning as K
from sequoria.operators import curation as C

from . import proxies as P
from .base import query

# Free masses, written a second time for the SQL.
_MASSES = "MAP {'A': 89.094, 'C': 121.154, 'D': 133.104, 'E': 147.131, 'F': 165.192, 'G': 75.067, 'H': 155.156, 'I': 131.175, 'K': 146.189, 'L': 131.175, 'M': 149.208, 'N': 132.119, 'P': 115.132, 'Q': 146.146, 'R': 174.203, 'S': 105.093, 'T': 119.120, 'V': 117.148, 'W': 204.228, 'Y': 181.191}"
_MASS = f"list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_sort(map_keys({_MASSES})), lambda a: (len(seq) - len(replace(seq, a, ''))) * CAST(map_extract({_MASSES}, a)[1] AS DOUBLE))), lambda x, y: x + y) - len(seq) * 18.01528::DOUBLE"
_NUMBER = "[0-9]+(?:\\.[0-9]+)?"


def _shown(x: str) -> str:
    return f"CASE json_type({x}) WHEN 'VARCHAR' THEN '''' || ({x} ->> '$') || '''' WHEN 'NULL' THEN 'None' ELSE CAST({x} AS VARCHAR) END"


def _name(b: str, field: str) -> str:
    return f"coalesce(CASE json_type({b} -> '$.{field}') WHEN 'OBJECT' THEN {b} ->> '$.{field}.name' WHEN 'VARCHAR' THEN {b} ->> '$.{field}' END, '')"


_FIELDS = ("type", "cycleType", "chainParticipating")
_OBJECT = "struct_pack(at := '(' || " + " || ', ' || ".join([_shown("(b -> '$.position1')"), _shown("(b -> '$.position2')"), *[f"'''' || {_name('b', f)} || ''''" for f in _FIELDS]]) + " || ')', js := '[' || " + " || ',' || ".join(["CAST(b -> '$.position1' AS VARCHAR)", "CAST(b -> '$.position2' AS VARCHAR)", *[f"'\"' || {_name('b', f)} || '\"'" for f in _FIELDS]]) + " || ']')"
_LIST = "struct_pack(at := '(' || " + _shown("(b -> '$[0]')") + " || ', ' || " + _shown("(b -> '$[1]')") + " || ', '''', '''', '''')', js := '[' || CAST(b -> '$[0]' AS VARCHAR) || ',' || CAST(b -> '$[1]' AS VARCHAR) || ',\"\",\"\",\"\"]')"
_JUDGED = f"""
m1 AS (SELECT *, lower(trim(coalesce(cyclization_type, ''))) AS kind, upper(sequence) AS s, TRY_CAST(bonds_json AS JSON) AS j FROM measured),
m2 AS (SELECT *, s AS seq, CASE WHEN j IS NULL THEN NULL WHEN json_type(j) = 'OBJECT' THEN [j] WHEN json_type(j) = 'ARRAY' THEN json_extract(j, '$[*]') END AS items,
    CASE lower(replace(trim(unit), ' ', '')) WHEN 'ug/ml' THEN 'ug' WHEN 'mcg/ml' THEN 'ug' WHEN 'mg/l' THEN 'ug' WHEN 'µm' THEN 'um' WHEN 'um' THEN 'um' WHEN 'umol/l' THEN 'um' END AS u,
    regexp_extract(replace(trim(mic), '–', '-'), '^(<=|>=|<|>)?\\s*({_NUMBER})$', ['sign', 'v']) AS one,
    regexp_extract(replace(trim(mic), '–', '-'), '^({_NUMBER})\\s*-\\s*({_NUMBER})$', ['a', 'b']) AS two FROM m1),
m3 AS (SELECT *, CASE WHEN bonds_json = '' THEN [] WHEN items IS NULL THEN NULL ELSE list_sort(list_filter(list_transform(items, lambda b: CASE WHEN json_type(b) = 'OBJECT' THEN {_OBJECT} WHEN json_type(b) = 'ARRAY' AND json_array_length(b) >= 2 THEN {_LIST} END), lambda r: r IS NOT NULL)) END AS recs,
    TRY_CAST(one.v AS DOUBLE) AS v, least(TRY_CAST(two.a AS DOUBLE), TRY_CAST(two.b AS DOUBLE)) AS lo, greatest(TRY_CAST(two.a AS DOUBLE), TRY_CAST(two.b AS DOUBLE)) AS hi,
    CASE WHEN molecular_weight <> '' THEN TRY_CAST(molecular_weight AS DOUBLE) WHEN u = 'um' AND kind = 'head_to_tail' AND seq <> '' THEN {_MASS} END AS weight FROM m2),
m4 AS (SELECT *, CASE WHEN recs IS NULL THEN NULL WHEN len(recs) > 0 THEN '[' || array_to_string(list_transform(recs, lambda r: r.js), ',') || ']'
      WHEN kind = 'head_to_tail' THEN '[[1,' || len(seq) || ',"amide","head_to_tail","mainchain-mainchain"]]' WHEN trim(topology) <> '' THEN '[["topology","' || trim(topology) || '","","",""]]' END AS topology_key,
    CASE WHEN one.v <> '' THEN CASE one.sign WHEN '' THEN 'exact' WHEN '<' THEN 'lt' WHEN '<=' THEN 'le' WHEN '>' THEN 'gt' ELSE 'ge' END WHEN two.a <> '' THEN 'range' END AS form,
    CASE WHEN u = 'um' THEN weight / 1000.0::DOUBLE ELSE 1.0::DOUBLE END AS k FROM m3),
m5 AS (SELECT *, CASE form WHEN 'exact' THEN v WHEN 'gt' THEN nextafter(v, 'infinity'::DOUBLE) WHEN 'ge' THEN v WHEN 'range' THEN lo END * k AS low,
    CASE form WHEN 'exact' THEN v WHEN 'lt' THEN nextafter(v, '-infinity'::DOUBLE) WHEN 'le' THEN v WHEN 'range' THEN hi END * k AS high,
    CASE WHEN u IS NULL THEN 'unsupported MIC unit: ' || unit WHEN form IS NULL THEN 'unparseable MIC value: ' || mic WHEN form = 'range' AND lo <= 0 THEN 'MIC range bounds must be positive' WHEN v <= 0 THEN 'MIC must be positive'
      WHEN u = 'um' AND coalesce(weight, 0) <= 0 THEN 'molecular_weight_required_for_uM' END AS broken FROM m4),
judged AS (SELECT *, CASE WHEN broken IS NULL THEN CASE WHEN form = 'range' THEN (low + high) / 2.0::DOUBLE ELSE coalesce(high, low) END END AS mic_ug_ml,
    CASE WHEN broken IS NULL AND high <= 25 THEN 1 WHEN broken IS NULL AND low > 25 THEN 0 END AS measured,
    CASE WHEN broken LIKE 'molecular%' THEN form WHEN broken IS NULL THEN form ELSE 'invalid' END AS censor,
    CASE WHEN veto <> '' THEN veto WHEN seq = '' THEN 'sequence must not be empty'
      WHEN regexp_replace(seq, '[ACDEFGHIKLMNPQRSTVWY]', '', 'g') <> '' THEN 'non-standard amino-acid symbols: ' || array_to_string(list_sort(list_distinct(string_split(regexp_replace(seq, '[ACDEFGHIKLMNPQRSTVWY]', '', 'g'), ''))), '')
      WHEN len(seq) < 5 OR len(seq) > 50 THEN 'sequence_length_out_of_range'
      WHEN kind IN ('', 'unknown', 'unspecified', 'cyclic_unspecified') THEN 'missing_or_unspecified_cyclization_type'
      WHEN recs IS NULL THEN 'invalid_intrachain_bond_topology' WHEN topology_key IS NULL THEN 'missing_topology_for_non_head_cyclization'
      WHEN molecular_weight <> '' AND TRY_CAST(molecular_weight AS DOUBLE) IS NULL THEN 'could not convert string to float: ''' || molecular_weight || ''''
      WHEN molecular_weight = '' AND u = 'um' AND kind <> 'head_to_tail' THEN 'trusted_molecular_weight_required_for_non_head_uM'
      WHEN broken IS NOT NULL THEN broken
      WHEN coalesce(high <= 25, false) OR coalesce(low > 25, false) THEN NULL ELSE 'mic_interval_crosses_threshold' END AS reason FROM m5),
kept AS (SELECT *, lower(trim(target_species)) AS target, CASE WHEN kind = 'head_to_tail' THEN list_min(list_transform(range(0, len(seq)), lambda i: substr(seq, CAST(i AS BIGINT) + 1) || substr(seq, 1, CAST(i AS BIGINT)))) ELSE seq END AS canonical FROM judged WHERE reason IS NULL),
entities AS (SELECT *, canonical || '|' || kind || '|' || topology_key AS entity FROM kept),
targeted AS (SELECT *, min(measured) OVER w < max(measured) OVER w AS conflict, min(ord) OVER w AS target_ord FROM entities WINDOW w AS (PARTITION BY entity, target)),
places AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY mic_ug_ml, target_ord, ord) AS nth, count(*) OVER e AS n, max(measured) OVER e AS any_label, min(mic_ug_ml) OVER e AS least FROM targeted WHERE NOT conflict WINDOW e AS (PARTITION BY entity)),
core AS (SELECT ord, CASE WHEN peptide_id <> '' THEN peptide_id ELSE 'pep_' || substr(sha256(entity), 1, 12) END AS peptide_id, seq AS sequence, canonical AS canonical_sequence, entity AS cyclic_entity_key, topology_key,
    'cyc_' || substr(sha256(entity), 1, 12) AS rotation_group_id, kind AS cyclization_type, any_label AS label, n AS measurement_count, least AS minimum_mic_ug_ml, source FROM places WHERE nth = 1)
"""


def judged(spark, sf_dir):
    return K.judge_core(P.measurements(spark, sf_dir))


@query(_JUDGED + " SELECT ord, mic, unit, CASE WHEN seq <> '' THEN round(mic_ug_ml, 6) END AS mic_ug_ml, CASE WHEN seq <> '' THEN measured END AS label, censor FROM judged WHERE seq <> ''")
def parse_measurement(spark, sf_dir):
    """Every measurement text in ug/ml with its conservative label, of rows with a sequence."""
    return judged(spark, sf_dir).filter("seq <> ''").select("ord", "mic", "unit", F.round("mic_ug_ml", 6).alias("mic_ug_ml"), F.col("measured").alias("label"), "censor")


@query(_JUDGED + " SELECT censor, measured AS label, count(*) AS n FROM judged WHERE seq <> '' GROUP BY ALL")
def interval_label(spark, sf_dir):
    return judged(spark, sf_dir).filter("seq <> ''").groupBy("censor", F.col("measured").alias("label")).agg(F.count("*").alias("n"))


@query(_JUDGED + " SELECT ord, topology_key FROM judged WHERE reason IS NULL OR reason LIKE 'MIC%' OR reason LIKE 'mic%' OR reason LIKE 'unsupported%'")
def topology_key(spark, sf_dir):
    rows = judged(spark, sf_dir)
    return rows.filter("reason is null or reason like 'MIC%' or reason like 'mic%' or reason like 'unsupported%'").select("ord", "topology_key")


@query(_JUDGED + " SELECT * EXCLUDE (minimum_mic_ug_ml), round(minimum_mic_ug_ml, 6) AS minimum_mic_ug_ml FROM core")
def entity_rollup(spark, sf_dir):
    return K.core_records(judged(spark, sf_dir)).drop("reference").withColumn("minimum_mic_ug_ml", F.round("minimum_mic_ug_ml", 6))


@query(_JUDGED + " SELECT entity, target, count(*) AS n FROM targeted WHERE conflict GROUP BY ALL")
def target_conflicts(spark, sf_dir):
    return K.target_flags(judged(spark, sf_dir)).filter("low < high").select("entity", "target", "n")


@query(_JUDGED + " SELECT ord, reason FROM judged WHERE reason IS NOT NULL UNION ALL SELECT ord, 'conflicting_labels_same_target' FROM targeted WHERE conflict")
def core_exclusions(spark, sf_dir):
    # what rows with a reason would be compared by is not stored
    kept = F.col("reason").isNull()
    rows = judged(spark, sf_dir).select("ord", "reason", F.when(kept, F.col("entity")).alias("entity"), F.when(kept, F.col("target")).alias("target"), "measured")
    return K.core_exclusions(rows).select("ord", "reason")


@query(_JUDGED + " SELECT coalesce(split_part(reason, ':', 1), 'kept') AS reason, cyclization_type, count(*) AS n FROM judged GROUP BY ALL")
def exclusion_counts(spark, sf_dir):
    rows = judged(spark, sf_dir)
    return rows.groupBy(F.coalesce(F.split("reason", ":")[0], F.lit("kept")).alias("reason"), "cyclization_type").agg(F.count("*").alias("n"))


_PRE = """
pre AS (SELECT ord, seq, CASE WHEN label = 1 THEN ['AMP', '1', ' Active '][pos % 3 + 1] WHEN label = 0 THEN ['non-amp', '0', 'Inactive'][pos % 3 + 1] ELSE ['', 'true', '1.0'][pos % 3 + 1] END AS raw_label, source FROM docs WHERE role = 'pretrain'),
pre1 AS (SELECT *, CASE WHEN lower(trim(raw_label)) IN ('amp', '1', 'active') THEN 1 WHEN lower(trim(raw_label)) IN ('non-amp', '0', 'inactive') THEN 0 END AS y FROM pre),
pre2 AS (SELECT *, CASE WHEN seq = '' THEN 'sequence must not be empty' WHEN len(seq) NOT BETWEEN 5 AND 100 THEN 'sequence_length_out_of_range' WHEN y IS NULL THEN 'invalid_pretrain_label' END AS why FROM pre1),
pre3 AS (SELECT *, min(y) OVER w < max(y) OVER w AS conflict, row_number() OVER (PARTITION BY seq ORDER BY ord) AS nth FROM pre2 WHERE why IS NULL WINDOW w AS (PARTITION BY seq)),
pre4 AS (SELECT *, CASE WHEN conflict THEN 'conflicting_duplicate_pretrain_labels' WHEN nth > 1 THEN 'duplicate_pretrain_sequence' END AS reason FROM pre3)
"""


def transfer(spark, sf_dir):
    pos = F.col("pos")
    raw = F.when(F.col("label") == 1, P._pick(pos, "AMP", "1", " Active ")).when(F.col("label") == 0, P._pick(pos, "non-amp", "0", "Inactive")).otherwise(P._pick(pos, "", "true", "1.0"))
    rows = P.sequences(spark, sf_dir).filter("role = 'pretrain'").select("ord", F.col("seq").alias("sequence"), raw.alias("label"), "source")
    return K.judge_transfer(rows)


@query(_PRE + " SELECT ord, 'pre_' || substr(sha256(seq), 1, 12) AS record_id, seq AS sequence, y AS label, source FROM pre4 WHERE reason IS NULL")
def clean_pretrain(spark, sf_dir):
    return K.transfer_records(transfer(spark, sf_dir))


@query(_PRE + " SELECT ord, why AS reason FROM pre2 WHERE why IS NOT NULL UNION ALL SELECT ord, reason FROM pre4 WHERE reason IS NOT NULL")
def pretrain_exclusions(spark, sf_dir):
    return transfer(spark, sf_dir).filter("reason is not null").select("ord", "reason")


@query(_PRE + " SELECT lower(trim(raw_label)) AS raw_label, y AS label, count(*) AS n FROM pre1 GROUP BY ALL")
def label_domain(spark, sf_dir):
    return transfer(spark, sf_dir).groupBy(F.lower(F.trim("label")).alias("raw_label"), F.col("y").alias("label")).agg(F.count("*").alias("n"))


@query("SELECT label, source, role, count(*) AS n FROM texts GROUP BY GROUPING SETS ((label), (source), (role), (label, role), ())")
def summary_counts(spark, sf_dir):
    """Counts of texts by several keys at once; the texts are not read."""
    return P.labelled_texts(spark, sf_dir).groupingSets([["label"], ["source"], ["role"], ["label", "role"], []], "label", "source", "role").agg(F.count("*").alias("n"))


@query(_JUDGED + " SELECT count(*) AS n, count(*) FILTER (label = 1) AS positive, count(*) FILTER (label = 0) AS negative, count(*) >= 50 AND least(count(*) FILTER (label = 1), count(*) FILTER (label = 0)) >= 15 AS formal_eligible, count(*) <= 2500 AS within_limit FROM core")
def formal_eligibility(spark, sf_dir):
    """Whether the core is large and balanced enough for a formal analysis, and whether it is within its size limit."""
    yes, no = F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)
    n = F.count("*")
    return K.core_records(judged(spark, sf_dir)).agg(n.alias("n"), yes.alias("positive"), no.alias("negative"), ((n >= 50) & (F.least(yes, no) >= 15)).alias("formal_eligible"), (n <= 2500).alias("within_limit"))


@query("""d AS (SELECT source, ord, coalesce(canonical, '') || coalesce(CAST(label AS VARCHAR), '') AS t FROM canon),
b AS (SELECT source, ord // 4096 AS block, sha256(string_agg(t, '' ORDER BY ord)) AS h, count(*) AS n FROM d GROUP BY ALL),
m AS (SELECT max(block) >= 4096 AS deep FROM b),
u AS (SELECT source, block // 4096 AS block, sha256(string_agg(h, '' ORDER BY block)) AS h, sum(n) AS n FROM b GROUP BY source, block // 4096)
SELECT source, sha256(string_agg(h, '' ORDER BY block)) AS digest, CAST(sum(n) AS BIGINT) AS n FROM (SELECT * FROM u WHERE (SELECT deep FROM m) UNION ALL SELECT * FROM b WHERE NOT (SELECT deep FROM m)) t GROUP BY source""")
def dataset_digest(spark, sf_dir):
    """One digest a source over its sequences and labels in order, by a tree of digests."""
    from sequoria.functions import sequence as S

    rows = P.sequences(spark, sf_dir).select("ord", "source", F.concat(F.coalesce(S.canonical(F.col("seq")), F.lit("")), F.coalesce(F.col("label").cast("string"), F.lit(""))).alias("t"))
    return C.block_digest(rows, ["source"], "ord", F.col("t")).withColumn("n", F.col("n").cast("long"))


@query("""SELECT ord, CASE WHEN pos % 3 = 0 THEN '1-' || len(seq) WHEN pos % 3 = 1 THEN '2:5，' || (pos % 30) || '－4' ELSE 'x-1' END AS given,
  CASE WHEN pos % 3 = 0 THEN '((1, ' || len(seq) || '),)' WHEN pos % 3 = 1 THEN CASE WHEN pos % 30 < 2 THEN '((' || (pos % 30) || ', 4), (2, 5))' ELSE '((2, 5), (' || least(4, pos % 30) || ', ' || greatest(4, pos % 30) || '))' END END AS pairs,
  CASE WHEN pos % 3 = 0 THEN len(seq) > 1 WHEN pos % 3 = 1 THEN len(seq) >= greatest(5, pos % 30) AND pos % 30 NOT IN (0, 4) END AS in_range FROM docs WHERE seq <> ''""")
def bond_text(spark, sf_dir):
    """Bond lists typed as text, in normal order, and whether they fit the sequence."""
    pos = F.col("pos")
    given = F.when(pos % 3 == 0, F.concat(F.lit("1-"), F.length("seq").cast("string"))).when(pos % 3 == 1, F.concat(F.lit("2:5，"), (pos % 30).cast("string"), F.lit("－4"))).otherwise("x-1")
    rows = P.sequences(spark, sf_dir).filter("seq <> ''").select("ord", "seq", given.alias("given")).withColumn("p", T.parse_pairs(F.col("given")))
    shown = F.when(F.col("p").isNotNull(), T._pair_text(T.normalized_pairs(F.col("p"))))
    return rows.select("ord", "given", shown.alias("pairs"), F.when(F.col("p").isNotNull(), T.pairs_in_range(F.col("p"), F.length("seq"))).alias("in_range"))
