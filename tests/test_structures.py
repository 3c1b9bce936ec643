"""Structures, positions, digests and ordered files against plain calculations."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sequoria.operators import curation as C
from sequoria.operators import fusion as U
from sequoria.operators import shape
from sequoria.operators import splits as L
from sequoria.sources import sinks

ATOMS = "file string, atom string, residue int, x double, y double, z double"


def plain(points, names):
    x, m = np.array(points, float), np.array([shape.MASSES.get(n[0], shape.MASSES["C"]) for n in names])
    centre = (x * m[:, None]).sum(axis=0) / m.sum()
    r = x - centre
    gyration = np.linalg.eigvalsh((r * m[:, None]).T @ r / m.sum())
    inertia = np.linalg.eigvalsh(sum(w * (np.eye(3) * (v @ v) - np.outer(v, v)) for w, v in zip(m, r, strict=True)) / m.sum())
    bare = np.linalg.eigvalsh(np.cov(x.T, bias=True))
    i1, i2, i3 = np.maximum(inertia, 0)
    part = lambda a, b: a / b if b > 1e-12 else 0.0
    far = max(math.dist(a, b) for a in x for b in x)
    return [math.sqrt(max(gyration.sum(), 0)), part(((i3 - i2) ** 2 + (i3 - i1) ** 2 + (i2 - i1) ** 2) / 2, i1**2 + i2**2 + i3**2), part(math.sqrt(max(i3**2 - i1**2, 0)), i3), part(3 * max(bare[0], 0), bare.sum()), part(i1, i3), part(i2, i3), far]


def test_descriptors_of_planted_shapes(spark):
    r = np.random.default_rng(1)
    ball = r.normal(size=(200, 3))
    shapes = {
        "cloud": (r.normal(size=(60, 3)) * [1, 4, 9] + [50, -20, 7]).tolist(),
        "shell": (ball / np.linalg.norm(ball, axis=1)[:, None] * 8).tolist(),
        "line": [[i, 2 * i, -i] for i in range(5)],
        "plane": [[i, j, 0] for i in range(3) for j in range(4)],
        "cube": [[i, j, k] for i in (0, 1) for j in (0, 1) for k in (0, 1)],
        "one": [[3, 4, 5]],
        "same": [[1, 1, 1]] * 3,
    }
    names = ["N", "CA", "1HB", "OXT", "SG", "FE"]
    same = {"cube", "plane"}
    rows = [(f, "C" if f in same else names[i % 6], i, *map(float, p)) for f, ps in shapes.items() for i, p in enumerate(ps)] + [("cloud", "C", 1, float("nan"), 0.0, 0.0), ("none", "C", 1, None, 0.0, 0.0)]
    got = {x.file: x for x in shape.descriptors(spark.createDataFrame(rows, ATOMS)).collect()}
    assert set(got) == set(shapes)
    for f, ps in shapes.items():
        atoms = ["C" if f in same else "H" if names[i % 6] == "1HB" else names[i % 6] for i in range(len(ps))]
        want = plain(ps, atoms)
        assert np.allclose([got[f][d] for d in shape.DESCRIPTORS], want, atol=1e-6), f


def test_structures_of_one_row_are_described_without_an_exchange(spark):
    r = np.random.default_rng(2)
    shapes = {f"s{k}": (r.normal(size=(k, 3)) * [1, 2, 5] + 1000 * k).tolist() for k in (1, 2, 30, 700)} | {"copies": [[0, 0, 0], [3, 4, 0]] * 3000}
    rows = [(f, [("C", *map(float, p)) for p in ps]) for f, ps in shapes.items()] + [("none", []), ("null", None), ("bad", [("C", float("inf"), 0.0, 0.0), (None, None, 1.0, 1.0), None])]
    df = spark.createDataFrame(rows, "file string, atoms array<struct<atom: string, x: double, y: double, z: double>>").repartition(2)
    out = shape.described(df)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    got = {x.file: x for x in out.collect()}
    assert set(got) == set(shapes)
    for f, ps in shapes.items():
        want = plain(ps, ["C"] * len(ps)) if f != "copies" else [2.5, 0.5, 1, 0, 0, 1, 5]
        assert np.allclose([got[f][d] for d in shape.DESCRIPTORS], want, atol=1e-6), f


def test_shape_query_cuts_texts_once_and_deals_no_atoms(spark):
    from sequoria.plans.fusion_queries import shape_descriptors

    plan = shape_descriptors(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 2 and "Aggregate" not in plan


def test_bonds_must_be_seen_in_the_atoms(spark):
    atoms = spark.createDataFrame([("a", "SG", 2, 0.0, 0.0, 0.0), ("a", "SG", 5, 2.0, 0.0, 0.0), ("a", "N", 1, 0.0, 0.0, 0.0), ("a", "C", 9, 1.3, 0.0, 0.0), ("b", "SG", 2, 0.0, 0.0, 0.0), ("b", "SG", 5, 3.0, 0.0, 0.0), ("b", "N", 1, 0.0, 0.0, 0.0), ("b", "C", 9, 1.7, 0.0, 0.0)], ATOMS)
    items = spark.createDataFrame([("a", " 2 5 ", "1"), ("b", "2 5", "1"), ("b", "2 5 7", "0"), ("c", None, "1"), ("a", "2 4", "0"), ("a", "2 x", "0"), ("a", "", "0")], "file string, disulfide_pairs_flat string, flag_cyclic string")
    for item, want in zip(items.collect(), ([], ["closure 1-9: 1.70 A", "disulfide 2-5: 3.00 A"], ["odd or invalid residue list"], ["closure ?-?: atom missing"], ["disulfide 2-4: atom missing"], ["odd or invalid residue list"], []), strict=True):
        assert U.geometry_faults(spark.createDataFrame([item], items.schema), atoms).collect()[0].faults == want


def test_rows_are_zipped_by_place(spark):
    left, right = spark.createDataFrame([(0, "a"), (1, "b")], "ord long, x string"), spark.createDataFrame([(1, 5), (0, 4)], "ord long, y int")
    assert sorted(map(tuple, U.zipped(left, right).collect())) == [(0, "a", 4), (1, "b", 5)]
    for more in (right.limit(1), right.union(right)):
        with pytest.raises(Exception, match="no single pair"):
            U.zipped(left, more).collect()


def test_digest_trees_do_not_depend_on_partitions(spark):
    rows = [(i, "ab"[i % 2], f"t{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "ord long, k string, t string")
    one, two = ({r.k: (r.digest, r.n) for r in C.block_digest(df.repartition(n), ["k"], "ord", F.col("t"), block=4).collect()} for n in (1, 7))

    def plain_tree(k):
        level = {}
        for i, g, t in rows:
            if g == k:
                level.setdefault(i // 4, []).append(t)
        level = {b: hashlib.sha256("".join(v).encode()).hexdigest() for b, v in level.items()}
        most = 299 // 4
        while most >= 4:
            up = {}
            for b in sorted(level):
                up.setdefault(b // 4, []).append(level[b])
            level, most = {b: hashlib.sha256("".join(v).encode()).hexdigest() for b, v in up.items()}, most // 4
        return hashlib.sha256("".join(level[b] for b in sorted(level)).encode()).hexdigest()

    assert one == two == {k: (plain_tree(k), 150) for k in "ab"}
    said = L.training_digest(spark.createDataFrame([(0, 'x"', 1, None)], "ord long, id string, label int, g string"), "ord", "id", "label", "g").first()
    leaf = hashlib.sha256('["x\\"","1",null]'.encode()).hexdigest()
    assert (said.digest, said.n) == (hashlib.sha256(leaf.encode()).hexdigest(), 1)


def test_files_in_order(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), F.lit("x").alias("t")).repartition(5)
    sinks.write_ordered(df, str(tmp_path / "o"), ["v"], "csv", files=5)
    files = sorted((tmp_path / "o").glob("part-*.csv"))
    assert [int(line.split(",")[0]) for f in files for line in f.read_text().splitlines()] == list(range(1000)) and len(files) > 1
    (tmp_path / "f.bin").write_bytes(b"abc")
    assert [tuple(r) for r in sinks.file_digests(spark, str(tmp_path / "f.bin")).collect()] == [("f.bin", hashlib.sha256(b"abc").hexdigest())]


def test_pretraining_must_not_meet_evaluation(spark):
    pretrain = spark.createDataFrame([("KLVFFAEDVGSN",), ("VFFAEDVGSNKL",), ("AAAAAAAAAAAA",), ("KLVFFAEDVGSK",), ("WWWWYYYY",)], "seq string")
    evaluation = spark.createDataFrame([("KLVFFAEDVGSN", "head_to_tail"), ("WWWWYYYY", "disulfide")], "seq string, cyclization_type string")
    got = {r.value for r in L.pretrain_violations(pretrain, evaluation).collect()}
    assert {"KLVFFAEDVGSN", "VFFAEDVGSNKL", "WWWWYYYY"} <= got and "AAAAAAAAAAAA" not in got
