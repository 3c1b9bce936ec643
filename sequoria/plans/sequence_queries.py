"""Queries on single sequences, leakage and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from sequoria.functions import sequence as S
from sequoria.functions.plan import distinct_dealt, sealed, stored
from sequoria.operators import curation as C
from sequoria.operators import metrics as X

from . import proxies as P
from .base import query

_OFFEND = f"array_to_string(list_sort(list_distinct(string_split(regexp_replace(raw, '[{S.ALPHABET}]', '', 'g'), ''))), '')"


@query(f"""SELECT ord, raw, {_OFFEND} AS offending,
  CASE WHEN raw = '' THEN 'sequence must not be empty' WHEN {_OFFEND} <> '' THEN 'non-standard amino-acid symbols: ' || {_OFFEND} END AS reason FROM docs""")
def normalize_validate(spark, sf_dir):
    raw = S.normalized(F.col("raw"))
    return P.sequences(spark, sf_dir).select("ord", raw.alias("raw"), S.offending(raw).alias("offending"), S.validity_reason(raw).alias("reason"))


@query("SELECT ord, canonical, CAST(len(list_distinct(turns)) AS BIGINT) AS n_rotations FROM canon")
def canonical_rotation(spark, sf_dir):
    return P.sequences(spark, sf_dir).select("ord", S.canonical(F.col("seq")).alias("canonical"), S.period(F.col("seq")).cast("long").alias("n_rotations"))


@query("SELECT DISTINCT ord, unnest(turns) AS rotation FROM canon")
def rotations_explode(spark, sf_dir):
    return P.sequences(spark, sf_dir).select("ord", F.explode(S.distinct_rotations(F.col("seq"))).alias("rotation"))


@query("SELECT ord, CAST(i AS BIGINT) AS i, turns[CAST(i * len(seq) // least(4, len(seq)) AS BIGINT) + 1] AS rotation FROM (SELECT *, unnest(range(0, least(4, len(seq)))) AS i FROM canon) t")
def even_rotations(spark, sf_dir):
    return P.sequences(spark, sf_dir).select("ord", F.posexplode(S.even_rotations(F.col("seq"))).alias("i", "rotation")).withColumn("i", F.col("i").cast("long"))


_KMERS = "list_distinct(list_transform(range(0, greatest(len({0}) - 2, 1)), lambda i: substr({0}, CAST(i AS BIGINT) + 1, 3)))"


@query(f"SELECT ord, CAST(len({_KMERS.format('seq')}) AS BIGINT) AS n_linear, CAST(len({_KMERS.format('ring')}) AS BIGINT) AS n_cyclic, array_to_string(list_sort({_KMERS.format('seq')}), ',') AS kmers FROM (SELECT *, CASE WHEN len(seq) >= 3 THEN seq || substr(seq, 1, 2) ELSE seq END AS ring FROM docs) t")
def kmer_sets(spark, sf_dir):
    linear = S.kmers(F.col("seq"))
    return P.sequences(spark, sf_dir).select("ord", F.size(linear).cast("long").alias("n_linear"), F.size(S.kmers(F.col("seq"), cyclic=True)).cast("long").alias("n_cyclic"), F.array_join(F.array_sort(linear), ",").alias("kmers"))


def _sum_sql(table: dict[str, float], x: str = "seq") -> str:
    return " + ".join(f"(len({x}) - len(replace({x}, '{a}', ''))) * {v}::DOUBLE" for a, v in table.items())


@query(f"SELECT ord, {_sum_sql(S.FREE_MASS)} - (len(seq) - 1) * 18.01528::DOUBLE AS linear, {_sum_sql(S.FREE_MASS)} - len(seq) * 18.01528::DOUBLE AS cyclic FROM docs")
def molecular_weight(spark, sf_dir):
    return P.sequences(spark, sf_dir).select("ord", S.molecular_weight(F.col("seq"), F.lit(False)).alias("linear"), S.molecular_weight(F.col("seq"), F.lit(True)).alias("cyclic"))


@query("""SELECT ord, 'rec_' || substr(sha256(seq), 1, 12) AS record_id, substr(sha256(seq), 1, 20) AS cache_key,
  CAST('0x' || substr(sha256(canonical), 1, 8) AS BIGINT) & 2147483647 AS seed FROM canon""")
def stable_ids(spark, sf_dir):
    seq = F.col("seq")
    return P.sequences(spark, sf_dir).select("ord", S.stable_id("rec", seq).alias("record_id"), F.substring(F.sha2(seq, 256), 1, 20).alias("cache_key"), S.conformer_seed(S.canonical(seq)).alias("seed"))


@query("SELECT CASE WHEN len(seq) <= 10 THEN '05_10' WHEN len(seq) <= 20 THEN '11_20' WHEN len(seq) <= 40 THEN '21_40' ELSE '41_plus' END AS length_bin, role, count(*) AS n FROM docs GROUP BY ALL")
def length_bins(spark, sf_dir):
    return P.sequences(spark, sf_dir).groupBy(S.length_bin(F.col("seq")).alias("length_bin"), "role").agg(F.count("*").alias("n"))


_LEAK = f"""
pool AS (SELECT ord, seq, canonical, {_KMERS.format('seq')} AS kmers FROM canon WHERE role = 'pretrain' AND len(seq) >= 5),
coreset AS (SELECT DISTINCT canonical AS seq, {_KMERS.format('canonical')} AS kmers FROM canon WHERE role = 'core' AND len(seq) >= 5),
a AS (SELECT seq, len(kmers) AS n, unnest(kmers) AS kmer FROM (SELECT DISTINCT seq, kmers FROM pool) t),
b AS (SELECT seq, len(kmers) AS n, unnest(kmers) AS kmer FROM coreset),
near AS (SELECT DISTINCT x FROM (SELECT a.seq AS x, b.seq AS y, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c FROM a JOIN b ON a.kmer = b.kmer AND a.n * 0.8::DOUBLE <= b.n AND b.n * 0.8::DOUBLE <= a.n GROUP BY a.seq, b.seq) t WHERE c / (n + m - c)::DOUBLE >= 0.8),
leaks AS (SELECT p.ord, p.seq, CASE WHEN p.seq IN (SELECT seq FROM coreset) THEN 'exact_core_leakage' WHEN p.canonical IN (SELECT seq FROM coreset) THEN 'cyclic_rotation_core_leakage'
   WHEN p.seq IN (SELECT x FROM near) THEN 'core_3mer_jaccard_ge_0.8' WHEN row_number() OVER (PARTITION BY p.seq ORDER BY p.ord) > 1 THEN 'duplicate_pretrain_sequence' END AS reason FROM pool p)
"""


def _leaks(spark, sf_dir):
    docs = P.sequences(spark, sf_dir).select("ord", "seq", "role").filter(F.length("seq") >= 5)
    core = docs.filter("role = 'core'").transform(lambda d: sealed(d, S.canonical(F.col("seq")).alias("seq")))
    return C.leak_reasons(docs.filter("role = 'pretrain'").select("ord", "seq"), core)


@query(_LEAK + " SELECT ord, reason FROM leaks")
def leak_reasons(spark, sf_dir):
    return _leaks(spark, sf_dir).select("ord", "reason")


@query(_LEAK + " SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM leaks GROUP BY 1")
def leak_counts(spark, sf_dir):
    return _leaks(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query(_LEAK + " SELECT x AS seq FROM near")
def leak_jaccard(spark, sf_dir):
    docs = P.sequences(spark, sf_dir).select("ord", "seq", "role").filter(F.length("seq") >= 5)
    return C.similar(docs.filter("role = 'pretrain'"), docs.filter("role = 'core'").transform(lambda d: sealed(d, S.canonical(F.col("seq")).alias("seq"))))


@query("SELECT p.ord FROM canon p WHERE role = 'pretrain' AND EXISTS (SELECT 1 FROM canon c WHERE c.role = 'core' AND c.seq = p.seq)")
def leak_exact(spark, sf_dir):
    docs = P.sequences(spark, sf_dir)
    return docs.filter("role = 'pretrain'").join(docs.filter("role = 'core'").select("seq"), "seq", "left_semi").select("ord")


@query("SELECT p.ord FROM canon p WHERE role = 'pretrain' AND EXISTS (SELECT 1 FROM canon c WHERE c.role = 'core' AND c.canonical = p.canonical)")
def leak_rotation(spark, sf_dir):
    docs = stored(sealed(P.sequences(spark, sf_dir).filter("seq <> ''"), "ord", "role", S.canonical(F.col("seq")).alias("canonical")), "turned")
    core = distinct_dealt(docs.filter("role = 'core'"), "canonical")
    return docs.filter("role = 'pretrain'").join(core, "canonical", "left_semi").select("ord")


def _charge_sql() -> str:
    basic = [f"(len(seq) - len(replace(seq, '{a}', ''))) / {1 + 10 ** (7.0 - p)!r}::DOUBLE" for a, p in S.BASIC_PKA.items()]
    acid = [f"(len(seq) - len(replace(seq, '{a}', ''))) / {1 + 10 ** (p - 7.0)!r}::DOUBLE" for a, p in S.ACIDIC_PKA.items()]
    return "(" + " + ".join(basic) + " - " + " - ".join(acid) + ")"


@query(f"SELECT ord, {_charge_sql()} AS charge, ({_sum_sql(S.HYDROPATHY)}) / len(seq) AS hydropathy FROM docs WHERE seq <> ''")
def charge_hydropathy(spark, sf_dir):
    seq = F.col("seq")
    return P.sequences(spark, sf_dir).filter("seq <> ''").select("ord", S.net_charge(seq).alias("charge"), (S.total(seq, S.HYDROPATHY) / F.length(seq)).alias("hydropathy"))


def _features_sql() -> str:
    n = "len(seq)"
    share = lambda letters: f"len(regexp_replace(seq, '[^{letters}]', '', 'g')) / {n}::DOUBLE"
    cols = [f"CAST({n} AS DOUBLE)", f"{_sum_sql(S.RESIDUE_MASS)} + CASE cyclization_type WHEN 'head_to_tail' THEN 0.0::DOUBLE WHEN 'disulfide' THEN 18.01528::DOUBLE - 2.01588::DOUBLE ELSE 0.0::DOUBLE END", _charge_sql(), f"{_charge_sql()} / {n}", f"({_sum_sql(S.HYDROPATHY)}) / {n}", share("AILMFWVY"), share("FWY")]
    cols += [share(a) for a in S.ALPHABET]
    cols += [f"CAST(cyclization_type = '{c}' AS DOUBLE)" for c in S.CYCLIZATIONS] + ["CAST(cyclization_type NOT IN ('head_to_tail', 'disulfide', 'sidechain') AS DOUBLE)", "1.0::DOUBLE"]
    names = [g for g, _ in S.GROUPS]
    for a, b in S.PAIRS:
        i, j = names.index(a), names.index(b)
        cols.append(f"len(list_filter(range(1, {n} + 1), lambda k: substr(codes || substr(codes, 1, 1), CAST(k AS BIGINT), 2) IN ('{i}{j}', '{j}{i}'))) / {n}::DOUBLE")
    letters = "".join(x for _, x in S.GROUPS)
    digits = "".join(str(i) * len(x) for i, (_, x) in enumerate(S.GROUPS))
    return "SELECT ord, " + ", ".join(f"{c} AS {name}" for c, name in zip(cols, S.FEATURES, strict=True)) + f" FROM (SELECT *, translate(seq, '{letters}', '{digits}') AS codes FROM docs WHERE seq <> '') t"


@query(_features_sql())
def feature_row_53(spark, sf_dir):
    rows = P.sequences(spark, sf_dir).filter("seq <> ''").withColumn("made", S.composition(F.col("seq")))
    cols = S.feature_columns(F.col("seq"), F.col("cyclization_type"), F.lit(1), F.col("made"))
    return rows.select("ord", *cols)


@query("SELECT label, CAST(i AS INTEGER) AS pos, round(avg(embedding[i + 1]::DOUBLE), 6) AS mean FROM (SELECT label, embedding, unnest(range(0, len(embedding))) AS i FROM embeddings) t GROUP BY ALL")
def vector_mean(spark, sf_dir):
    return X.vector_mean(P.table(spark, sf_dir, "embeddings"), ["label"], "embedding").withColumn("mean", F.round("mean", 6))


_CONF = "conf AS (SELECT model, count(*) FILTER (label = 0 AND score < 0.5) AS tn, count(*) FILTER (label = 0 AND score >= 0.5) AS fp, count(*) FILTER (label = 1 AND score < 0.5) AS fn, count(*) FILTER (label = 1 AND score >= 0.5) AS tp FROM scored GROUP BY model)"
_MCC = "coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0)"


@query(_CONF + f" SELECT CAST(model AS INTEGER) AS model, tn, fp, fn, tp, round({_MCC}, 9) AS mcc, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 9) AS f1, round((tp + tn) / (tp + tn + fp + fn)::DOUBLE, 9) AS accuracy FROM conf")
def confusion_mcc_f1(spark, sf_dir):
    return X.confusion(P.scores(spark, sf_dir), ["model"]).withColumns({c: F.round(c, 9) for c in ("mcc", "f1", "accuracy")})


@query("r AS (SELECT model, label, rank() OVER w + (count(*) OVER (PARTITION BY model, score) - 1) / 2.0::DOUBLE AS rk FROM scored WINDOW w AS (PARTITION BY model ORDER BY score)) SELECT CAST(model AS INTEGER) AS model, round((sum(rk) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE) / (sum(label) * sum(1 - label))::DOUBLE, 9) AS roc_auc FROM r GROUP BY model")
def roc_auc(spark, sf_dir):
    return X.roc_auc(P.scores(spark, sf_dir), ["model"]).withColumn("roc_auc", F.round("roc_auc", 9))


@query("s AS (SELECT model, score, sum(label) AS p, count(*) AS n FROM scored GROUP BY ALL), c AS (SELECT model, p, sum(p) OVER w / (sum(n) OVER w)::DOUBLE AS prec FROM s WINDOW w AS (PARTITION BY model ORDER BY score DESC)) SELECT CAST(model AS INTEGER) AS model, round(sum(p * prec) / sum(p)::DOUBLE, 9) AS average_precision FROM c GROUP BY model")
def average_precision(spark, sf_dir):
    return X.average_precision(P.scores(spark, sf_dir), ["model"]).withColumn("average_precision", F.round("average_precision", 9))


@query("""m AS (SELECT median(CASE WHEN label IS NOT NULL THEN len(seq)::DOUBLE END) AS med FROM docs), f AS (SELECT ord, coalesce(CASE WHEN label IS NOT NULL THEN len(seq)::DOUBLE END, med) AS x FROM docs, m),
s AS (SELECT avg(x) AS mu, stddev_pop(x) AS sd FROM f) SELECT ord, round(x, 6) AS filled, round(coalesce((x - mu) / nullif(sd, 0), 0), 6) AS scaled FROM f, s""")
def impute_scale(spark, sf_dir):
    """Median of the known values for the missing ones, then population scaling."""
    rows = P.sequences(spark, sf_dir).select("ord", F.when(F.col("label").isNotNull(), F.length("seq").cast("double")).alias("x"))
    rows = rows.crossJoin(F.broadcast(rows.agg(F.percentile("x", 0.5).alias("med")))).withColumn("x", F.coalesce("x", "med"))
    out = rows.crossJoin(F.broadcast(rows.agg(F.avg("x").alias("mu"), F.stddev_pop("x").alias("sd"))))
    return out.select("ord", F.round("x", 6).alias("filled"), F.round(F.coalesce(F.try_divide(F.col("x") - F.col("mu"), "sd"), F.lit(0.0)), 6).alias("scaled"))


@query("SELECT ord, seq, len(seq) AS n FROM docs WHERE seq <> '' ORDER BY len(seq), ord LIMIT 20")
def shortest_first(spark, sf_dir):
    """A top-k report: the 20 shortest sequences, ties by id."""
    return P.sequences(spark, sf_dir).filter("seq <> ''").select("ord", "seq", F.length("seq").cast("long").alias("n")).orderBy("n", "ord").limit(20)


