from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sequoria.functions import measure as M
from sequoria.functions import sequence as S
from sequoria.operators import curation as C


def value(spark, text, make):
    return spark.createDataFrame([(text,)], "x string").select(make(F.col("x"))).first()[0]


def test_normalisation_and_rotation(spark):
    assert value(spark, " klv\nff ", S.normalized) == "KLVFF"
    assert value(spark, "KLVX", S.offending) == "X"
    assert value(spark, "KLVFF", S.canonical) == "FFKLV"
    rows = spark.createDataFrame([("KLVFF"[i:] + "KLVFF"[:i],) for i in range(5)], "x string")
    assert rows.select(S.canonical(F.col("x"))).distinct().count() == 1
    assert value(spark, "", S.rotations) == []
    assert len(value(spark, "ACDEFG", S.even_rotations)) == 4


def test_kmers_and_jaccard(spark):
    assert value(spark, "AAAAA", S.kmers) == ["AAA"]
    assert value(spark, "AC", S.kmers) == ["AC"]
    assert value(spark, "ACDE", lambda x: F.size(S.kmers(x, cyclic=True))) == 4
    with pytest.raises(ValueError):
        S.kmers(F.lit("A"), 0)


def test_masses_and_charge(spark):
    gap = value(spark, "KLVFF", lambda x: S.molecular_weight(x, F.lit(False)) - S.molecular_weight(x, F.lit(True)))
    assert abs(gap - 18.01528) < 1e-9
    assert value(spark, "AAAAA", S.net_charge) == 0
    assert value(spark, "KKKKK", S.net_charge) > 4.9
    assert len(S.FEATURES) == 53


@pytest.mark.parametrize(
    ("raw", "unit", "weight", "label"),
    [("25", "ug/mL", None, 1), ("25.1", "mg/L", None, 0), ("10", "uM", 2000.0, 1), ("<=20", "ug/mL", None, 1), (">25", "ug/mL", None, 0), (">20", "ug/mL", None, None), (">=25", "ug/mL", None, None), ("<30", "ug/mL", None, None), ("20-30", "ug/mL", None, None), ("<20", "ug/mL", None, 1), ("10", "uM", None, None), ("0", "ug/ml", None, None)],
)
def test_measurements(spark, raw, unit, weight, label):
    got = spark.createDataFrame([(raw, unit, weight)], "v string, u string, w double").select(M.parsed(F.col("v"), F.col("u"), F.col("w")).alias("p")).select("p.*").first()
    assert got.label == label
    assert (got.reason is None) == (label is not None)
    if raw == "10" and weight is None:
        assert got.reason == "molecular_weight_required_for_uM"


def test_leaks(spark):
    pre = spark.createDataFrame([(0, "KLVFF"), (1, "LVFFK"), (2, "KLVFA"), (3, "AAAAAAAA"), (4, "AAAAAAAA")], "ord long, seq string")
    got = {r.ord: r.reason for r in C.leak_reasons(pre, spark.createDataFrame([("KLVFF",)], "seq string")).collect()}
    assert got == {0: "exact_core_leakage", 1: "cyclic_rotation_core_leakage", 2: None, 3: None, 4: "duplicate_pretrain_sequence"}


def test_cap_takes_the_limit_and_repeats(spark):
    rows = spark.createDataFrame([(i, f"s{i % 3}") for i in range(12)], "k long, s string")
    one = {r.k for r in C.stratified_cap(rows, ["s"], "k", 6).filter("selected").collect()}
    two = {r.k for r in C.stratified_cap(rows.repartition(3), ["s"], "k", 6).filter("selected").collect()}
    assert len(one) == 6 and one == two
    assert C.stratified_cap(rows, ["s"], "k", 20).filter("selected").count() == 12
