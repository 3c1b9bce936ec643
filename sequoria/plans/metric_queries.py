"""Queries on evaluation: metrics, bootstrap intervals, folds, summaries, choices, scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from sequoria.functions.plan import stored
from sequoria.operators import evaluation as E
from sequoria.operators import scoring as R

from . import proxies as P
from .base import query


def _metrics_sql(cells: str, by: str, name: str) -> str:
    """A CTE with the metrics of cells (by, score, p, q), from the definitions."""
    return f"""
{name}_r AS (SELECT *, coalesce(sum(p) OVER lo, 0) AS pb, coalesce(sum(q) OVER lo, 0) AS qb, sum(p) OVER hi AS pa, sum(p + q) OVER hi AS na FROM {cells}
  WINDOW lo AS (PARTITION BY {by} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), hi AS (PARTITION BY {by} ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
{name}_s AS (SELECT {by}, coalesce(sum(q) FILTER (score < 0.5), 0) AS tn, coalesce(sum(q) FILTER (score >= 0.5), 0) AS fp, coalesce(sum(p) FILTER (score < 0.5), 0) AS fn, coalesce(sum(p) FILTER (score >= 0.5), 0) AS tp,
  sum(p * (qb + q / 2.0::DOUBLE)) AS won, sum(CASE WHEN na > 0 THEN p * pa / na::DOUBLE ELSE 0 END) AS ap FROM {name}_r GROUP BY {by}),
{name} AS (SELECT {by}, CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tp AS BIGINT) AS tp,
  coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0) AS mcc, coalesce(2 * tp / nullif((2 * tp + fp + fn)::DOUBLE, 0), 0) AS f1,
  CASE WHEN (tp + fn) * (tn + fp) > 0 THEN won / ((tp + fn) * (tn + fp))::DOUBLE ELSE 'nan'::DOUBLE END AS roc_auc, CASE WHEN tp + fn > 0 THEN ap / (tp + fn)::DOUBLE ELSE 0 END AS pr_auc, (tp + tn) / (tp + tn + fp + fn)::DOUBLE AS accuracy FROM {name}_s)"""


def _rounded(names, digits: int = 9) -> dict:
    return {c: F.round(c, digits) for c in names}


_CELLS = "cells AS (SELECT model, score, sum(label) AS p, sum(1 - label) AS q FROM scored GROUP BY ALL)"


@query(_CELLS + "," + _metrics_sql("cells", "model", "m") + " SELECT CAST(model AS INTEGER) AS model, tn, fp, fn, tp, " + ", ".join(f"round({m}, 9) AS {m}" for m in E.METRICS) + " FROM m")
def classification_metrics(spark, sf_dir):
    """Counts and all five metrics of each model in one pass over its distinct scores."""
    return E.metrics(E.cells(P.scores(spark, sf_dir), ["model"]), ["model"]).withColumns(_rounded(E.METRICS))


_BOOT = """
gcells AS (SELECT model, source, score, sum(label) AS p, sum(1 - label) AS q FROM scored GROUP BY ALL),
gnum AS (SELECT model, source, row_number() OVER (PARTITION BY model ORDER BY source) - 1 AS i, count(*) OVER (PARTITION BY model) AS g FROM (SELECT DISTINCT model, source FROM gcells) t),
gdraw AS (SELECT model, r, CAST('0x' || substr(sha256('42|' || r || '|' || k), 1, 12) AS BIGINT) % g AS i FROM (SELECT DISTINCT model, g FROM gnum) s, range(1000) a(r), range(g) b(k)),
gtimes AS (SELECT model, r, i, count(*) AS times FROM gdraw GROUP BY ALL),
rcells AS (SELECT c.model, r, score, sum(p * times) AS p, sum(q * times) AS q FROM gcells c JOIN gnum n ON n.model = c.model AND n.source = c.source JOIN gtimes t ON t.model = c.model AND t.i = n.i GROUP BY ALL)"""


@query(_BOOT + "," + _metrics_sql("rcells", "model, r", "b") + ", long AS (" + " UNION ALL ".join(f"SELECT model, '{m}' AS metric, {m} AS v FROM b WHERE tp + fn > 0 AND tn + fp > 0" for m in E.METRICS) + ") SELECT CAST(model AS INTEGER) AS model, metric, round(quantile_cont(v, 0.025), 9) AS low, round(quantile_cont(v, 0.975), 9) AS high FROM long WHERE NOT isnan(v) GROUP BY ALL")
def bootstrap_ci(spark, sf_dir):
    """Percentile intervals of all metrics over 1,000 bootstrap replicates of whole groups."""
    rows = P.scores(spark, sf_dir).select("model", "source", "label", "score")
    out = E.intervals(E.bootstrap_metrics(rows, "source", ["model"], 1000), ["model"], 0.95)
    return out.withColumns(_rounded(("low", "high")))


_FCELLS = "fcells AS (SELECT model, source, score, sum(label) AS p, sum(1 - label) AS q FROM scored GROUP BY ALL)"
_FOLDS = _FCELLS + "," + _metrics_sql("fcells", "model, source", "f")


@query(_FOLDS + " SELECT CAST(model AS INTEGER) AS model, " + ", ".join(f"round(avg({m}) FILTER (NOT isnan({m})), 9) AS mean_{m}, round(coalesce(stddev_samp({m}) FILTER (NOT isnan({m})), 0), 9) AS std_{m}" for m in E.METRICS) + " FROM f GROUP BY model")
def fold_summary(spark, sf_dir):
    """Mean and sample deviation over folds (here: sources) of each metric."""
    rows = E.metrics(E.cells(P.scores(spark, sf_dir), ["model", "source"]), ["model", "source"])
    out = E.fold_summary(rows, ["model"])
    return out.withColumns(_rounded(c for c in out.columns if c != "model"))


@query(_FOLDS + " SELECT source, arg_min(name, (CASE WHEN isnan(mcc) THEN 1 ELSE 0 END, -mcc, k)) AS model FROM (SELECT *, ['lr', 'rf', 'mlp'][model + 1] AS name, [1, 3, 5][model + 1] AS k FROM f) t GROUP BY source")
def best_model(spark, sf_dir):
    """The best family of each source by MCC, ties to the simpler one."""
    rows = E.metrics(E.cells(P.scores(spark, sf_dir), ["model", "source"]), ["model", "source"])
    return E.best_model(rows.withColumn("model", F.get(F.array(*[F.lit(x) for x in ("lr", "rf", "mlp")]), F.col("model"))), ["source"], "mcc")


@query("v AS (SELECT source, ['lr', 'rf', 'mlp'][model + 1] AS name, [1, 3, 5][model + 1] AS k, count(*) AS n FROM scored WHERE score >= 0.5 GROUP BY ALL) SELECT source, arg_min(name, (-n, k)) AS model FROM v GROUP BY source")
def family_consensus(spark, sf_dir):
    """The most frequent choice, ties by simplicity."""
    votes = P.scores(spark, sf_dir).filter("score >= 0.5").select("source", F.get(F.array(*[F.lit(x) for x in ("lr", "rf", "mlp")]), F.col("model")).alias("model"))
    return E.consensus(votes, ["source"])


@query("SELECT doc_id, round(avg(score), 9) AS score, count(*) AS repeats, CAST(max(label) AS INTEGER) AS label FROM scored GROUP BY doc_id")
def oof_average(spark, sf_dir):
    return E.oof_average(P.scores(spark, sf_dir), [], "doc_id").withColumns({"score": F.round("score", 9), "label": F.col("label").cast("int")})


_AVERAGED = "av AS (SELECT model, doc_id, source, avg(score) AS score, max(label) AS label FROM (SELECT * FROM scored UNION ALL SELECT doc_id, label, source, model, score / 2 + 0.25 FROM scored) t GROUP BY ALL), acells AS (SELECT model, score, sum(label) AS p, sum(1 - label) AS q FROM av GROUP BY ALL)"


@query(_AVERAGED + "," + _metrics_sql("acells", "model", "o") + "," + _FOLDS + ", fs AS (SELECT model, " + ", ".join(f"round(avg({m}) FILTER (NOT isnan({m})), 9) AS mean_{m}" for m in E.METRICS) + " FROM f GROUP BY model) SELECT CAST(o.model AS INTEGER) AS model, " + ", ".join(f"mean_{m}, round({m}, 9) AS oof_{m}" for m in E.METRICS) + ", tn AS oof_tn, fp AS oof_fp, fn AS oof_fn, tp AS oof_tp, 100 AS ci_n_bootstrap FROM o JOIN fs ON fs.model = o.model")
def oof_summary(spark, sf_dir):
    """Fold means and metrics of the averaged out-of-fold scores; intervals are those of bootstrap_ci."""
    rows = P.scores(spark, sf_dir)
    twice = rows.unionByName(rows.withColumn("score", F.col("score") / 2 + 0.25))
    folds = E.metrics(E.cells(rows, ["model", "source"]), ["model", "source"])
    out = E.oof_summary(folds, twice, "doc_id", "source", 100)
    keep = ["model", *[f"{k}_{m}" for m in E.METRICS for k in ("mean", "oof")], *[f"oof_{c}" for c in E.COUNTS], "ci_n_bootstrap"]
    return out.select(*keep).withColumns(_rounded(f"{k}_{m}" for m in E.METRICS for k in ("mean", "oof")))


def dealt_sql(groups: str, name: str, seeds: tuple[int, ...]) -> str:
    """CTEs that end with `name` (canonical, seed, fold): the greedy deal of groups (canonical, p, q) to three folds. Of what
    the folds ask for each next group of a kind, the least are met."""
    asked = ", ".join(f"list_transform(range(k.c), lambda i: {{'c': (p{f} + i * k.p) * k.p / (tp * tp) + (q{f} + i * k.q) * k.q / (tq * tq), 's': p{f} + q{f} + i * (k.p + k.q), 'f': {f}}})" for f in range(3))
    count = lambda f: f"len(list_filter(got, lambda x: x.f = {f}))"
    state = ", ".join(f"p{f}, q{f}" for f in range(3))
    moved = ", ".join(f"p{f} + {count(f)} * p, q{f} + {count(f)} * q" for f in range(3))
    return f"""kinds AS (SELECT p, q, c, row_number() OVER (ORDER BY abs(p - q) DESC, p DESC, q DESC) AS j FROM (SELECT p, q, count(*) AS c FROM {groups} GROUP BY ALL) t),
totals AS (SELECT greatest(sum(p * c), 1)::DOUBLE AS tp, greatest(sum(q * c), 1)::DOUBLE AS tq FROM kinds),
dealt(j, n0, n1, {state}) AS (
  SELECT 0::BIGINT, 0::BIGINT, 0::BIGINT, {", ".join("0::BIGINT, 0::BIGINT" for _ in range(3))}
  UNION ALL
  SELECT j, {count(0)}, {count(1)}, {moved} FROM (SELECT k.j, k.p, k.q, {state}, list_sort(flatten([{asked}]))[1:k.c] AS got FROM dealt d JOIN kinds k ON k.j = d.j + 1, totals) t),
ranked AS (SELECT canonical, k.j, s AS seed, row_number() OVER (PARTITION BY g.p, g.q, s ORDER BY sha256(s || '|' || canonical), canonical) AS rnk FROM {groups} g JOIN kinds k USING (p, q), (SELECT unnest({list(seeds)}) AS s) x),
{name} AS (SELECT canonical, seed, CASE WHEN rnk <= n0 THEN 0 WHEN rnk <= n0 + n1 THEN 1 ELSE 2 END AS fold FROM ranked JOIN dealt USING (j))"""


_SPLITS = "g AS (SELECT canonical, CAST(sum(label) AS BIGINT) AS p, CAST(sum(1 - label) AS BIGINT) AS q FROM canon WHERE label IS NOT NULL AND canonical IS NOT NULL GROUP BY canonical),"


@query(_SPLITS + dealt_sql("g", "splits", (42, 43, 44)) + " SELECT canonical, CAST(seed AS INTEGER) AS seed, fold FROM splits")
def group_splits(spark, sf_dir):
    """Repeated grouped folds, stratified greedily by the labels of the groups."""
    from .split_queries import _labelled

    return E.group_splits(_labelled(spark, sf_dir).select("canonical", "label"), "canonical")


@query(_SPLITS + dealt_sql("g", "splits", (42,)) + " SELECT canonical, CASE fold WHEN 2 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END AS split FROM splits")
def cyclic_split(spark, sf_dir):
    """Train, validation and test by groups of rings."""
    from sequoria.operators import splits as L

    from .split_queries import _labelled

    folds = E.group_splits(_labelled(spark, sf_dir).select("canonical", "label"), "canonical", seeds=(42,))
    return L.cyclic_split(folds).select("canonical", "split")


@query(_SPLITS + dealt_sql("g", "splits", (42, 43, 44)) + ", sizes AS (SELECT s.source, CAST(seed AS INTEGER) AS seed, fold, count(*) FILTER (label = 0) AS no, count(*) FILTER (label = 1) AS yes FROM splits JOIN canon s USING (canonical) WHERE label IS NOT NULL GROUP BY ALL) SELECT seed, fold, sum(no)::BIGINT AS no, sum(yes)::BIGINT AS yes FROM sizes GROUP BY ALL HAVING sum(no) < 4000 OR sum(yes) < 4000")
def fold_sizes(spark, sf_dir):
    """Folds that have too few rows of a label (here under 4,000)."""
    from .split_queries import _labelled

    rows = stored(_labelled(spark, sf_dir).select("canonical", "label"), "labelled")
    return R.fold_size_errors(E.group_splits(rows, "canonical").join(rows, "canonical"), 4000)


@query("t AS (SELECT doc_id, CAST(label AS VARCHAR) AS l, source FROM texts WHERE label IS NOT NULL), b AS (SELECT doc_id // 4096 AS b, sha256(string_agg('[\"' || doc_id || '\",\"' || l || '\",\"' || source || '\"]', '' ORDER BY doc_id)) AS d, count(*) AS n FROM t GROUP BY 1) SELECT sha256(string_agg(d, '' ORDER BY b)) AS digest, CAST(sum(n) AS BIGINT) AS n FROM b")
def training_digest(spark, sf_dir):
    """Digest of the labelled texts in order, as a model's contract names it."""
    from sequoria.operators import splits as L

    return L.training_digest(P.labelled_texts(spark, sf_dir).filter("label is not null"), "doc_id", "doc_id", "label", "source")


@query("c AS (SELECT source, count(DISTINCT doc_id % 5) AS a, count(DISTINCT doc_id % 5) FILTER (label = 0) AS n, count(DISTINCT doc_id % 5) FILTER (label = 1) AS y FROM texts WHERE label IS NOT NULL GROUP BY source) SELECT source, CASE WHEN least(3, a, nullif(n, 0), nullif(y, 0)) >= 2 THEN CAST(least(3, a, nullif(n, 0), nullif(y, 0)) AS INTEGER) END AS folds FROM c")
def inner_folds(spark, sf_dir):
    """How many grouped folds each source allows."""
    rows = P.labelled_texts(spark, sf_dir).filter("label is not null").withColumn("g", F.col("doc_id") % 5)
    return E.inner_folds(rows, ["source"], "g")


@query("d AS (SELECT source AS feature, avg(score - 0.5) AS mean, coalesce(stddev_pop(score - 0.5), 0) AS std FROM scored GROUP BY source) SELECT feature, round(mean, 9) AS mean, round(std, 9) AS std, CAST(row_number() OVER (ORDER BY mean DESC, feature) AS INTEGER) AS rank FROM d")
def importance_rank(spark, sf_dir):
    """Rank of features by mean drop over repeats."""
    out = E.permuted_ranks(P.scores(spark, sf_dir).select(F.col("source").alias("feature"), (F.col("score") - 0.5).alias("drop")))
    return out.withColumns(_rounded(("mean", "std")))


_WIDE = "wide AS (SELECT doc_id, max(score) FILTER (model = 0) AS m0, max(score) FILTER (model = 1) AS m1, CASE WHEN doc_id % 2 = 0 THEN max(score) FILTER (model = 2) END AS m2, CASE WHEN doc_id % 3 <> 0 THEN 1 - max(score) FILTER (model = 0) END AS lora FROM scored GROUP BY doc_id)"


def _wide(spark, sf_dir):
    rows = P.scores(spark, sf_dir).groupBy("doc_id").agg(*[F.max(F.when(F.col("model") == k, F.col("score"))).alias(f"m{k}") for k in range(3)])
    return rows.withColumns({"m2": F.when(F.col("doc_id") % 2 == 0, F.col("m2")), "lora": F.when(F.col("doc_id") % 3 != 0, 1 - F.col("m0"))})


@query(_WIDE + """ SELECT doc_id, CASE WHEN m2 IS NOT NULL AND m2 >= 0.7 AND len(list_filter([m0, m1, lora, m2], lambda x: x IS NOT NULL AND x >= 0.5)) >= 3 THEN '建议优先实验验证'
  WHEN m2 IS NULL AND lora IS NOT NULL AND lora >= 0.7 AND (coalesce(m0 >= 0.5, false) OR coalesce(m1 >= 0.5, false)) THEN '可考虑实验验证' ELSE '暂不优先' END AS advice FROM wide""")
def recommend_rules(spark, sf_dir):
    """Scores that are missing stay null and never count as 0."""
    return _wide(spark, sf_dir).select("doc_id", R.recommendation(*[F.col(c) for c in ("m0", "m1", "lora", "m2")]).alias("advice"))


@query(_WIDE + " SELECT doc_id, coalesce(printf('%.3f', m2), '不可用') AS m2_text, coalesce(printf('%.3f', m0), '不可用') AS m0_text FROM wide")
def score_text(spark, sf_dir):
    """Scores as they are shown; a missing one is not a zero."""
    return _wide(spark, sf_dir).select("doc_id", R.score_text(F.col("m2")).alias("m2_text"), R.score_text(F.col("m0")).alias("m0_text"))


@query("""s AS (SELECT ord, seq, ['Head-to-tail', 'disulfide', 'stapled', ' side chain '][pos % 4 + 1] AS kind, CASE WHEN pos % 2 = 0 THEN [[1, 3 + pos % 20]] ELSE [] END AS pairs, pos FROM docs),
n AS (SELECT *, replace(replace(lower(trim(kind)), '-', '_'), ' ', '_') AS k FROM s),
e AS (SELECT *, CASE WHEN seq = '' THEN 'sequence must not be empty' WHEN len(seq) NOT BETWEEN 5 AND 50 THEN 'sequence length must be between 5 and 50 residues' WHEN k NOT IN ('head_to_tail', 'disulfide', 'sidechain', 'side_chain', 'other') THEN 'unsupported cyclization_type: ' || kind
  WHEN pos % 2 = 0 AND (3 + pos % 20 > len(seq)) THEN 'bond pair indices must be distinct and within the sequence' END AS error FROM n)
SELECT ord, error, CASE WHEN error IS NULL THEN CASE WHEN k = 'head_to_tail' THEN list_min(list_transform(range(0, len(seq)), lambda i: substr(seq, CAST(i AS BIGINT) + 1) || substr(seq, 1, CAST(i AS BIGINT)))) ELSE seq END END AS canonical,
  CASE WHEN error IS NULL THEN CASE WHEN pos % 3 = 0 THEN 0 ELSE 1 END + 1 + CASE WHEN k NOT IN ('head_to_tail', 'disulfide') THEN 1 WHEN k = 'disulfide' AND pos % 2 <> 0 THEN 1 ELSE 0 END ELSE 0 END AS n_warnings FROM e""")
def score_requests(spark, sf_dir):
    """Scoring requests with their validation errors and the warnings of branches that cannot run."""
    pos = F.col("pos")
    rows = P.sequences(spark, sf_dir).select("ord", F.col("seq").alias("sequence"), P._pick(pos, "Head-to-tail", "disulfide", "stapled", " side chain ").alias("cyclization_type"), F.when(pos % 2 == 0, F.array(F.array(F.lit(1), 3 + pos % 20))).otherwise(F.array().cast("array<array<int>>")).alias("bond_pairs"), F.when(pos % 3 == 0, F.lit(0.5)).alias("m0"), F.lit(0.25).alias("lora"))
    out = R.score(R.validated(rows), {"m0": "m0", "lora": "lora"}, ("m1",))
    return out.select("ord", "error", F.col("canonical"), F.size("warnings").alias("n_warnings"))


@query("""s AS (SELECT ord, seq, ['Head-to-tail', 'disulfide', 'stapled', ' side chain '][pos % 4 + 1] AS kind, pos FROM docs),
n AS (SELECT *, replace(replace(lower(trim(kind)), '-', '_'), ' ', '_') AS k FROM s),
e AS (SELECT *, seq = '' OR len(seq) NOT BETWEEN 5 AND 50 OR k NOT IN ('head_to_tail', 'disulfide', 'sidechain', 'side_chain', 'other') AS bad FROM n)
SELECT ord, CASE WHEN NOT bad THEN len(seq) / 50.0::DOUBLE END AS m0_score, CASE WHEN NOT bad AND ord % 3 <> 0 THEN (ord % 10) / 10.0::DOUBLE END AS lora_score, CAST(NULL AS DOUBLE) AS m1_score,
  CASE WHEN bad THEN '' ELSE concat_ws('; ', 'm2: no model, no score', CASE WHEN ord % 3 = 0 THEN 'lora: inference failed, degraded' END, 'm1: inference failed, degraded',
    CASE WHEN k NOT IN ('head_to_tail', 'disulfide') THEN 'structure: only for head-to-tail rings and disulfides with explicit bonds' WHEN k = 'disulfide' THEN 'structure: disulfide without explicit bonds, none is guessed' END,
    CASE WHEN ord % 3 = 0 THEN 'lora: the score is no finite number' END, 'm1: RuntimeError: no weights') END AS warnings FROM e""")
def predict_requests(spark, sf_dir):
    """Requests scored by branches run in batches: m0 works, lora gives no number for some, m1 fails as a whole."""
    from sequoria.models.predict import predict

    def lengths(rows):
        return [len(r["canonical"]) / 50.0 for r in rows]

    def some(rows):
        return [float("nan") if r["ord"] % 3 == 0 else (r["ord"] % 10) / 10.0 for r in rows]

    def broken(rows):
        raise RuntimeError("no weights")

    pos = F.col("pos")
    rows = P.sequences(spark, sf_dir).select("ord", F.col("seq").alias("sequence"), P._pick(pos, "Head-to-tail", "disulfide", "stapled", " side chain ").alias("cyclization_type"), F.array().cast("array<array<int>>").alias("bond_pairs"))
    out = predict(rows, "ord", {"m0": lengths, "lora": some, "m1": broken})
    return out.select("ord", "m0_score", "lora_score", "m1_score", F.array_join("warnings", "; ").alias("warnings"))
