"""Model families, selection, fusion, bundles, embedders and prediction on data whose answer is known."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.ml.feature import PCAModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from sequoria.models import bundles as B
from sequoria.models import embedding as M
from sequoria.models import families as Fam
from sequoria.models import predict as Q
from sequoria.models import protocol as P
from sequoria.operators import evaluation as E


def labelled(spark, n=80, noise=False):
    """The label is the sign of the first feature (or of none); the second tells nothing, the third is missing here and there."""
    r = np.random.default_rng(2)
    x = r.normal(size=(n, 3))
    y = r.integers(0, 2, n) if noise else (x[:, 0] > 0).astype(int)
    x[:, 0] += 0 if noise else np.sign(x[:, 0])
    rows = [(i, f"g{i % 20}", int(c), [float(v[0]), float(v[1]), None if i % 7 == 0 else float(v[2])]) for i, (v, c) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id long, grp string, label int, features array<double>").coalesce(1)


def test_fourier_features_stand_for_the_kernel(spark):
    x = np.random.default_rng(5).normal(size=(12, 3))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<double>").select("i", array_to_vector("v").alias("z"))
    got = Fam.Fourier.of_kernel("z", "k", 3, 0.3, size=3000).transform(rows).orderBy("i").select(vector_to_array("k").alias("k")).collect()
    k = np.array([r.k for r in got])
    want = np.exp(-0.3 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert np.abs(k @ k.T - want).max() < 0.1


def test_preparation_fills_and_scales_by_the_population(spark):
    x = [[1.0, None, 5.0], [2.0, 4.0, 5.0], [4.0, float("nan"), 5.0], [9.0, 6.0, 5.0]]
    rows = spark.createDataFrame([(v,) for v in x], "features array<double>")
    model = Fam.Preparation("features", "x", True).fit(rows)
    filled = np.array([[1, 5, 5], [2, 4, 5], [4, 5, 5], [9, 6, 5]], float)
    spread = filled.std(axis=0)
    want = (filled - filled.mean(axis=0)) / np.where(spread > 0, spread, 1)
    got = np.array([r[0] for r in model.transform(rows).select(vector_to_array("x")).collect()])
    assert np.allclose(sorted(got.tolist()), sorted(want.tolist()))


FAMILIES = [("m0", "lr", {"C": 1.0}), ("m0", "svm", {"C": 2.0, "gamma": "scale"}), ("m0", "rf", {"max_depth": 5, "min_samples_leaf": 1}), ("m0", "hgb", {"learning_rate": 0.1, "max_depth": 3}), ("m1", "lr", {"C": 1.0}), ("m1", "mlp", {"max_iter": 60})]


@pytest.mark.parametrize(("kind", "name", "params"), FAMILIES)
def test_families_learn_a_sign_and_can_be_saved(spark, tmp_path, kind, name, params):
    rows = labelled(spark)
    family = (Fam.m0_families(10) if kind == "m0" else Fam.m1_families())[name]
    made = P.fit(rows, family, params)
    scored = made.score(rows)
    assert scored.columns == [*rows.columns, "score"] and scored.filter("score < 0 or score > 1").isEmpty() and P.mcc(scored) > 0.9
    B.save(made, str(tmp_path / "b"), "m", {"kind": "x", "dimension": 3})
    again, held = B.load(spark, str(tmp_path / "b"), "m", {"kind": "x", "dimension": 3})
    assert held["model_family"] == name
    a, b = ({r.id: r.score for r in m.score(rows).collect()} for m in (made, again))
    assert a.keys() == b.keys() and all(math.isclose(a[k], b[k], abs_tol=1e-12) for k in a)


def test_network_stops_early_on_noise(spark):
    ready = lambda rows: Fam.Preparation("features", "x", True).fit(rows).transform(rows).withColumn(Fam.LABEL, F.col("label").cast("double"))
    noise, signal = (Fam.Network("x", 3, most=200, step=10).fit(ready(labelled(spark, 120, k))).rounds for k in (True, False))
    assert noise < signal <= 200


def test_choices_that_are_not_finite_never_win():
    tried = [({"model": "a", "order": 0, "params": {"k": 1}}, [float("nan"), 0.9]), ({"model": "a", "order": 0, "params": {"k": 2}}, [0.1, 0.1]), ({"model": "b", "order": 1, "params": {}}, [0.3, 0.2]), ({"model": "c", "order": 2, "params": {}}, [0.25, 0.25])]
    rows, best = P.judged(tried)
    assert len(rows) == 4 and [b["model"] for b in best] == ["b", "c", "a"] and best[2]["params"] == {"k": 2}
    assert P.judged([({"model": "a", "order": 0, "params": {}}, [float("nan")])])[1][0]["model"] == "a"


def test_calls_run_at_a_time_and_in_order(spark):
    import threading

    gate = threading.Barrier(3, timeout=20)  # passed only if three calls run at once
    assert P.concurrently(spark, [lambda i=i: (gate.wait(), i)[1] for i in range(6)], 3) == list(range(6))


def test_ablation_makes_folds_once_for_all_sets(spark, monkeypatch):
    rows = [(i, i % 10, (i // 10 + i) % 2, [float(i)], [float(-i), 1.0], [0.5]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, grp long, label int, handcrafted array<double>, embedding array<double>, structure array<double>")
    splits, dealt = P.E.group_splits, []
    monkeypatch.setattr(P.E, "group_splits", lambda *a, **b: dealt.append(a) or splits(*a, **b))

    def tried(spark, choices, workers):
        raise RuntimeError(f"{len(choices)} choices")

    monkeypatch.setattr(P, "_tried", tried)
    with pytest.raises(RuntimeError, match="^16 choices"):
        P.ablation(df, "id", "grp", seeds=(42,), n=2)
    assert len(dealt) <= 3


def test_ablation_reduces_wide_blocks_within_the_fold(spark):
    r = np.random.default_rng(8)
    rows = []
    for i in range(48):
        y = i % 2
        rows.append((i, f"g{i % 16}", y, [y + 0.1 * float(v) for v in r.normal(size=2)], [float(v) for v in r.normal(size=130)], [float(r.normal())]))
    df = spark.createDataFrame(rows, "id long, grp string, label int, handcrafted array<double>, embedding array<double>, structure array<double>").coalesce(1)
    got = P.ablation(df, "id", "grp", names=("m0", "m2"), seeds=(42,), n=2, trees=5).collect()
    by = {}
    for x in got:
        by.setdefault((x.feature_set, x.model), []).append(x.id)
        assert (x.chosen is not None) == (x.model == P.SELECTED)
    assert set(by) == {(s, m) for s in ("m0", "m2") for m in ("rf", "mlp", P.SELECTED)} and all(sorted(v) == list(range(48)) for v in by.values())
    folds = {}
    for x in got:
        folds.setdefault(x.grp, set()).add(x.fold)
    assert all(len(v) == 1 for v in folds.values())  # one set of folds, no group in two
    stages, width = Fam.reduced_blocks((2, 130, 1), 30)
    assert width == 2 + 29 + 1 and [s.getK() for s in stages if hasattr(s, "getK")] == [29]
    assert Fam.reduced_blocks((500, 127), 1000)[1] == 64 + 127
    model = P.fit(df.select("label", F.concat("handcrafted", "embedding", "structure").alias("features")), Fam.fusion_families((2, 130, 1), 5)["rf"], {})
    assert [m.pc.numCols for m in model.model.stages if isinstance(m, PCAModel)] == [47]
    with pytest.raises(ValueError, match="widths"):
        P.ablation(df.withColumn("structure", F.when(F.col("id") == 3, F.array()).otherwise(F.col("structure")).cast("array<double>")), "id", "grp", names=("m2",))


def greedy(groups, n=3):
    """Groups (p, q) dealt one by one, the most uneven first, to the fold of least added squared deviation."""
    tp, tq = max(sum(p for p, _ in groups), 1), max(sum(q for _, q in groups), 1)
    at = [[0, 0] for _ in range(n)]
    for p, q in sorted(groups, key=lambda g: -abs(g[0] - g[1])):
        f = min(range(n), key=lambda f: (at[f][0] * p / tp**2 + at[f][1] * q / tq**2, sum(at[f]), f))
        at[f][0] += p
        at[f][1] += q
    return at


def off(at):
    tp, tq = (max(sum(x[k] for x in at), 1) for k in (0, 1))
    return sum((p / tp - 1 / len(at)) ** 2 + (q / tq - 1 / len(at)) ** 2 for p, q in at)


def test_grouped_folds_are_balanced_as_greedy_ones(spark):
    r = np.random.default_rng(3)
    sizes = [(int(r.integers(0, 4)), int(r.integers(0, 9))) for _ in range(200)] + [(40, 0), (0, 60), (25, 30)]
    sizes = [(p, q) if p + q else (1, 0) for p, q in sizes]
    rows = [(f"g{i}", y) for i, (p, q) in enumerate(sizes) for y in [1] * p + [0] * q]
    df = spark.createDataFrame(rows, "grp string, label int")
    got = {(x.grp, x.seed): x.fold for x in E.group_splits(df, "grp", seeds=(1, 2)).collect()}
    assert len(got) == 2 * len(sizes) and got == {(x.grp, x.seed): x.fold for x in E.group_splits(df.repartition(7), "grp", seeds=(1, 2)).collect()}
    for seed in (1, 2):
        at = [[0, 0] for _ in range(3)]
        for i, (p, q) in enumerate(sizes):
            at[got[f"g{i}", seed]][0] += p
            at[got[f"g{i}", seed]][1] += q
        assert off(at) <= off(greedy(sizes)) + 1e-4
    at = [(3, 9), (40, 2), (0, 0)]
    for p, q, c in ((1, 0, 200), (2, 3, 7), (0, 5, 1), (4, 4, 1000)):
        want, held = [0, 0, 0], [list(x) for x in at]
        for _ in range(c):  # one by one
            f = min(range(3), key=lambda f: (held[f][0] * p / 500.0**2 + held[f][1] * q / 700.0**2, sum(held[f]), f))
            want[f], held[f] = want[f] + 1, [held[f][0] + p, held[f][1] + q]
        assert E.shares(at, p, q, c, 500, 700) == want
    assert any(got[f"g{i}", 1] != got[f"g{i}", 2] for i in range(len(sizes)))


def test_importance_ranks_what_the_label_follows(spark):
    rows = labelled(spark, 60)
    model = P.fit(rows, Fam.m0_families()["lr"], {"C": 1.0})
    got = {r.feature: r for r in P.permutation_importance(model, rows, ["sign", "noise", "gaps"], "id", repeats=2).collect()}
    assert got["sign"]["rank"] == 1 and got["sign"]["mean"] > 0.5 and abs(got["noise"]["mean"]) < 0.2 and sorted(r["rank"] for r in got.values()) == [1, 2, 3]


def test_registry_keeps_what_is_sound(spark, tmp_path):
    made = P.fit(labelled(spark), Fam.m0_families()["lr"], {"C": 1.0})
    B.save(made, str(tmp_path / "m0"), "m0", {"kind": "x", "dimension": 3})
    B.save(made, str(tmp_path / "m1"), "other", {"kind": "y", "dimension": 4})
    (tmp_path / "m2").mkdir()
    (tmp_path / "m2" / "contract").write_text("no json")
    got = B.load_registry(spark, str(tmp_path), {"m0": {"kind": "x"}, "m1": {"kind": "x", "dimension": 3}, "m2": {}, "lora": {}})
    assert list(got.models) == ["m0"] and len(got.warnings) == 2 and "model_name is 'other'" in got.warnings[0] and "dimension is 4" in got.warnings[0]
    assert B.differences([], {}) and "params is missing" in " ".join(B.differences({"features": {}}, {}))
    requests = spark.createDataFrame([(1, "KLVFF", "head_to_tail", [1.0, 0.0, None]), (2, "KLVFF", "head_to_tail", None), (3, "KLVFF", "head_to_tail", [1.0]), (4, "K", "head_to_tail", [1.0, 2.0, 3.0])], "id long, sequence string, cyclization_type string, features array<double>").withColumn("bond_pairs", F.array().cast("array<array<int>>"))

    def moody(rows):
        if any(r["id"] == 2 for r in rows):
            raise KeyError("no such weight")
        return [0.25] * len(rows)

    out = {r.id: r for r in Q.predict(requests.coalesce(1), "id", {"lora": moody}, got, {"m0": "features"}, batch=1).collect()}
    assert out[1].m0_score > 0.5 and out[1].lora_score == 0.25 and out[2].m0_score is None and out[3].m0_score is None and out[2].lora_score is None and out[3].lora_score == 0.25
    assert any("KeyError" in w for w in out[2].warnings) and not any("KeyError" in w for w in out[3].warnings) and any("m1: bundle not loaded" in w for w in out[1].warnings)
    assert out[4].error and out[4].m0_score is None and out[4].warnings == [] and "features" in out[1].asDict()


def test_embedder_batches_masks_and_caches(spark):
    lengths = np.array([5, 1, 9, 2, 30, 3])
    parts = M.planned(lengths, 12)
    assert sorted(np.concatenate(parts).tolist()) == list(range(6)) and all(len(p) == 1 or lengths[p].max() * len(p) <= 12 for p in parts)
    rows = spark.createDataFrame([(1, "KLVFF", "head_to_tail"), (2, "FFKLV", "head_to_tail"), (3, "KLVFF", "disulfide"), (4, None, "head_to_tail"), (5, "", None), (6, "K", "head_to_tail")], "id long, seq string, cyclization_type string")
    one = M.LetterEmbedder()
    one.load()
    vector = lambda s: M.pooled(*one.states([s, "AAAAAAAAA"]))[0]
    ring = np.mean([vector("KLVFF"[i:] + "KLVFF"[:i]) for i in range(5)], axis=0)
    want = {1: ring, 2: ring, 3: vector("KLVFF"), 4: None, 5: None, 6: vector("K")}
    got = {r.id: r.embedding for r in M.embed_rows(rows, M.LetterEmbedder(), tokens=20).collect()}
    assert all((got[k] is None) if v is None else np.allclose(got[k], v) for k, v in want.items())
    cache = spark.createDataFrame([("K", [7.0, 7.0, 7.0]), ("unused", [0.0, 0.0, 0.0])], "seq string, embedding array<float>")
    held = {r.seq: r.embedding for r in M.embed(rows, M.LetterEmbedder(), cache).collect()}
    assert held["K"] == [7.0] * 3 and np.allclose(held["KLVFF"], vector("KLVFF")) and set(held) == {"K", "KLVFF", "FFKLV"}
