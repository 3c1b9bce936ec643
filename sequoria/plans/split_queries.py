"""Queries on capping, folds and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from sequoria.functions import sequence as S
from sequoria.functions.plan import sealed, stored
from sequoria.operators import cleaning as K
from sequoria.operators import curation as C

from . import proxies as P
from .base import query

_BIN = "CASE WHEN len(seq) <= 10 THEN '05_10' WHEN len(seq) <= 20 THEN '11_20' WHEN len(seq) <= 40 THEN '21_40' ELSE '41_plus' END"
_CAP = f"""
strata AS (SELECT ord, coalesce(CAST(label AS VARCHAR), '') || '|' || coalesce(source, '') || '|' || {_BIN} AS stratum FROM docs),
ranked AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256('42|' || ord), ord) AS rnd FROM strata)
"""


@query(_CAP + " SELECT ord, row_number() OVER (ORDER BY rnd, stratum) <= 2500 AS selected FROM ranked")
def stratified_cap(spark, sf_dir):
    """The cap is the feature here: 2,500 rows are selected, all rows are returned."""
    rows = P.sequences(spark, sf_dir).select("ord", "label", "source", S.length_bin(F.col("seq")).alias("bin"))
    return C.stratified_cap(rows, ["label", "source", "bin"], "ord", 2500).select("ord", "selected")


@query(_CAP + ", picked AS (SELECT ord, row_number() OVER (ORDER BY rnd, stratum) <= 2500 AS selected FROM ranked) SELECT source, count(*) AS n, 'not_selected_after_core_leakage_filter_and_cap' AS reason FROM docs JOIN picked USING (ord) WHERE NOT selected GROUP BY source")
def not_selected(spark, sf_dir):
    """What the cap leaves out, by source: the eligible rows less the selected ones."""
    rows = P.sequences(spark, sf_dir).select("ord", "label", "source", S.length_bin(F.col("seq")).alias("bin"))
    chosen = C.stratified_cap(rows, ["label", "source", "bin"], "ord", 2500).filter("selected").select("ord")
    return rows.join(chosen, "ord", "left_anti").groupBy("source").agg(F.count("*").alias("n")).withColumn("reason", F.lit("not_selected_after_core_leakage_filter_and_cap"))


_GROUPS = "groups AS (SELECT canonical, min(label) AS label FROM canon WHERE label IS NOT NULL AND canonical IS NOT NULL GROUP BY canonical HAVING min(label) = max(label))"
_FOLD = "CAST((row_number() OVER (PARTITION BY label ORDER BY sha256('{0}|' || canonical), canonical) - 1) % 3 AS INTEGER) AS fold_seed_{0}"


def _labelled(spark, sf_dir):
    rows = P.sequences(spark, sf_dir).filter("label is not null and seq <> ''")
    return sealed(rows, "ord", "source", "label", "seq", S.canonical(F.col("seq")).alias("canonical"))


@query(_GROUPS + " SELECT canonical, label, " + ", ".join(_FOLD.format(s) for s in (42, 43, 44)) + " FROM groups")
def fold_assign(spark, sf_dir):
    """Folds of the groups that have one label; see group_conflicts for the others."""
    rows = stored(_labelled(spark, sf_dir).select("canonical", "label"), "labelled")
    groups = K.agreed_groups(rows.join(K.group_conflicts(rows, "canonical"), "canonical", "left_anti"), "canonical")
    return C.folds(groups, "label", "canonical")


@query("SELECT canonical FROM canon WHERE label IS NOT NULL AND canonical IS NOT NULL GROUP BY canonical HAVING count(DISTINCT label) > 1")
def group_conflicts(spark, sf_dir):
    return K.group_conflicts(_labelled(spark, sf_dir), "canonical")


_BINS = "CASE WHEN len(seq) <= 10 THEN '5-10' WHEN len(seq) <= 20 THEN '11-20' WHEN len(seq) <= 40 THEN '21-40' ELSE '41-100' END"
_SPLIT = f"binned AS (SELECT *, {_BINS} AS bin FROM canon), splits AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY label, source, bin ORDER BY sha256('42|' || ord), ord) <= least(greatest(1, round_even(count(*) OVER (PARTITION BY label, source, bin) * 0.1::DOUBLE, 0)), count(*) OVER (PARTITION BY label, source, bin) - 1) THEN 'valid' ELSE 'train' END AS split FROM binned)"


def _split(spark, sf_dir):
    rows = P.sequences(spark, sf_dir).select("ord", "label", "source", "seq", S.split_length_bin(F.col("seq")).alias("bin"))
    return C.train_valid(rows, ["label", "source", "bin"], "ord")


@query(_SPLIT + " SELECT ord, split FROM splits")
def train_valid_split(spark, sf_dir):
    return _split(spark, sf_dir).select("ord", "split")


@query(_SPLIT + " SELECT canonical, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM splits WHERE canonical IS NOT NULL GROUP BY canonical HAVING count(DISTINCT split) > 1")
def split_leak_audit(spark, sf_dir):
    rows = sealed(_split(spark, sf_dir).filter("seq <> ''"), "split", S.canonical(F.col("seq")).alias("canonical"))
    return C.leaks_between(rows, "canonical")
