"""The operators on the cases that define them: exact thresholds, ties, nulls, empty tables, services and files."""

from __future__ import annotations

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from sequoria.functions import sequence as S
from sequoria.functions import topology as T
from sequoria.operators import cleaning as K
from sequoria.operators import curation as C
from sequoria.operators import evaluation as E
from sequoria.operators import fusion as U
from sequoria.operators import scoring as R
from sequoria.operators import splits as L
from sequoria.sources import rest, sinks

CORE = "ord long, sequence string, mic string, unit string, target_species string, cyclization_type string, bonds_json string, molecular_weight string"


def core(spark, *rows):
    return K.judge_core(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], CORE))


def test_rotations_merge_and_any_active_wins(spark):
    rows = core(spark, ("KLVFF", "8", "ug/ml", "E. coli", "head_to_tail", "", ""), ("LVFFK", "100", "ug/ml", "S. aureus", "head_to_tail", None, None))
    got = K.core_records(rows).collect()
    assert [(r.label, r.measurement_count, r.minimum_mic_ug_ml, r.canonical_sequence) for r in got] == [(1, 2, 8.0, "FFKLV")]
    assert got[0].topology_key == '[[1,5,"amide","head_to_tail","mainchain-mainchain"]]'


def test_conflicts_types_topology_and_weights(spark):
    rows = core(
        spark,
        ("KLVFF", "8", "ug/ml", "E. coli", "head_to_tail", "", ""),
        ("KLVFF", "100", "ug/ml", "e. COLI ", "head_to_tail", "", ""),
        ("KLVFF", "8", "ug/ml", "x", None, "", ""),
        ("KLVFF", "8", "uM", "x", "disulfide", "[[2,5]]", ""),
        ("KLVFF", "8", "uM", "x", "disulfide", "[[2,5]]", "2000"),
        ("KLVFF", "8", "ug/ml", "x", "disulfide", '{"position1":1,"position2":4,"type":{"name":"DSB"}}', ""),
        ("LVFFK", "8", "ug/ml", "x", "disulfide", "[[2,5]]", ""),
        ("KLVFF", "8", "ug/ml", "x", "disulfide", "[[1,", ""),
        ("KLVFF", "0-5", "ug/ml", "x", "head_to_tail", "", ""),
        ("KLVFF", "<0", "ug/ml", "x", "head_to_tail", "", "heavy"),
    )
    got = {r.ord: r.reason for r in K.core_exclusions(rows).collect()}
    assert got == {0: "conflicting_labels_same_target", 1: "conflicting_labels_same_target", 2: "missing_or_unspecified_cyclization_type", 3: "trusted_molecular_weight_required_for_non_head_uM", 7: "invalid_intrachain_bond_topology", 8: "MIC range bounds must be positive", 9: "could not convert string to float: 'heavy'"}
    assert K.core_records(rows).count() == 3  # a rotated disulfide, and other bonds, are other entities
    assert K.core_records(rows.limit(0)).count() == 0


def test_group_with_both_labels_is_refused(spark):
    rows = spark.createDataFrame([("a", 0), ("a", 1)], "g string, label int")
    with pytest.raises(Exception, match="conflicting labels in group a"):
        K.agreed_groups(rows, "g").collect()


def test_a_jaccard_of_exactly_the_threshold_counts(spark):
    left = spark.createDataFrame([("ENKEIT",), ("AAAAAAAA",), (None,), ("",)], "seq string")
    right = spark.createDataFrame([("NENKEIT",), ("KLVFF",)], "seq string")
    assert [r.seq for r in C.similar(left, right).collect()] == ["ENKEIT"]
    ev = right.withColumn("cyclization_type", F.lit("disulfide"))
    assert [r.seq for r in L.near_evaluation(left, ev).collect()] == ["ENKEIT"]
    assert C.similar(left.limit(0), right).count() == 0


def test_similar_against_all_pairs(spark):
    dice = np.random.default_rng(5)
    base = ["".join(dice.choice(list("ACDEFGHIKL"), n)) for n in (6, 9, 14, 20, 33, 50, 77, 110) for _ in range(12)]
    edited = ["".join(c if dice.random() > 0.02 else "W" for c in s) for s in base]
    km = lambda s: {s[i : i + 3] for i in range(max(1, len(s) - 2))}
    want = sorted({a for a in edited for b in base if len(km(a) & km(b)) >= 0.8 * len(km(a) | km(b)) - 1e-12})
    frame = lambda x: spark.createDataFrame([(s,) for s in x], "seq string")
    assert len(want) > 30 and sorted(r.seq for r in C.similar(frame(edited), frame(base)).collect()) == want


def test_ranks_of_hot_keys_are_whole(spark):
    rows = spark.range(3000).select(F.col("id").alias("k"), F.when(F.col("id") % 50 == 0, None).otherwise("a").alias("g"))
    got = C.hashed_rank(rows, ["g"], C.draw(1, F.col("k")), "k", "place").groupBy("g").agg(F.sort_array(F.collect_list("place")).alias("p")).collect()
    assert {r.g: r.p for r in got} == {None: list(range(1, 61)), "a": list(range(1, 2941))}


def test_metrics_of_the_definitions(spark):
    rows = spark.createDataFrame([(0, 0.1, "m"), (0, 0.4, "m"), (1, 0.6, "m"), (1, 0.9, "m"), (1, 0.5, "one")], "label int, score double, model string")
    got = {r.model: r for r in E.metrics(E.cells(rows, ["model"]), ["model"]).collect()}
    assert [got["m"][c] for c in (*E.COUNTS, *E.METRICS)] == [2, 0, 0, 2, 1, 1, 1, 1, 1]
    assert np.isnan(got["one"].roc_auc) and got["one"].mcc == 0
    grouped = rows.filter("model = 'm'").withColumn("g", F.col("score"))
    first, again = ({r.metric: (r.low, r.high) for r in E.intervals(E.bootstrap_metrics(grouped, "g", ["model"], 50), ["model"]).collect()} for _ in range(2))
    assert first == again and first["roc_auc"] == (1.0, 1.0)


def test_choice_prefers_simple_models_and_finite_scores(spark):
    rows = spark.createDataFrame([("x", "hgb", 0.5), ("x", "lr", 0.5), ("x", "rf", float("nan")), ("y", "rf", float("nan"))], "s string, model string, mean_mcc double")
    assert {r.s: r.model for r in E.best_model(rows, ["s"]).collect()} == {"x": "lr", "y": "rf"}


def test_folds_keep_groups_together(spark):
    rows = spark.range(600).select((F.col("id") % 90).alias("g"), (F.col("id") % 90 % 3 == 0).cast("int").alias("label"))
    got = E.group_splits(rows, "g").join(rows.groupBy("g").agg(F.sum("label").alias("p"), F.count("*").alias("n")), "g").groupBy("seed", "fold").agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.count("*").alias("groups")).collect()
    assert len(got) == 9 and all(abs(r.n - 200) < 30 and abs(r.p - 67) < 20 for r in got)


def test_fusion_refuses_what_is_not_reproducible(spark):
    head = "peptide_id string, cyclization_type string, topology string, join_key string, handcrafted array<double>"
    one = ("p", "Head-to-tail", "t", "", [1.0])
    vectors = spark.createDataFrame([("p|head_to_tail|t", [0.5, 0.5])], "join_key string, embedding array<double>")
    made = spark.createDataFrame([("p", "head_to_tail", "t", "true", [2.0]), ("q", "head_to_tail", "t", "true", [float("nan")])], "peptide_id string, cyclization_type string, topology string, success string, structure array<double>")
    out = U.feature_set(U.align(spark.createDataFrame([one], head), vectors, made), "m2").collect()
    assert [r.features for r in out] == [[1.0, 0.5, 0.5, 2.0]]
    for core_rows, e, m in (([one, one], vectors, made), ([(*one[:3], "x", [1.0])], vectors, made), ([one], vectors.limit(0), made), ([one], vectors, made.union(made))):
        with pytest.raises(Exception, match="duplicate|join_key|embedding"):
            U.align(spark.createDataFrame(core_rows, head), e, m).collect()


def test_scoring_and_contracts(spark):
    rows = spark.createDataFrame([(0.8, 0.8, 0.8, 0.8), (0.6, None, 0.7, None), (None, None, None, None), (0.8, 0.8, 0.1, None)], "m0 double, m1 double, lora double, m2 double")
    assert [r[0] for r in rows.select(R.recommendation(*[F.col(c) for c in ("m0", "m1", "lora", "m2")])).collect()] == [R.FIRST, R.MAYBE, R.LATER, R.LATER]
    assert R.runtime_errors({"model_revision": "a", "cyclic_rotation_average": True}, "b", "disulfide") and not R.runtime_errors({}, None, "x")
    R.check_sizes(2500, 7500)
    with pytest.raises(ValueError, match="core"):
        R.check_sizes(2501, 1)


def test_pair_texts_and_labels(spark):
    df = spark.createDataFrame([("1-6，2:5",), ("1-2-3",), ("",), ("x-1",)], "t string")
    assert [r[0] for r in df.select(T.parse_pairs(F.col("t"))).collect()] == [[[1, 6], [2, 5]], None, [], None]
    assert spark.createDataFrame([("a b/ü-1_",)], "t string").select(T.file_id(F.col("t"))).first()[0] == "a_b_ü-1_"
    assert df.limit(1).select(sinks.zero_based_pairs(F.lit("2 5 7 9"))).first()[0] == [[1, 4], [6, 8]]
    with pytest.raises(Exception, match="odd or invalid"):
        df.select(sinks.zero_based_pairs(F.lit("2 5 7"))).collect()


def test_masses_written_out(spark):
    got = spark.createDataFrame([("ACDEFGHIKLMNPQRSTVWY",)], "s string").select(S.total(F.col("s"), S.FREE_MASS), S.total(F.col("s"), S.RESIDUE_MASS), S.total(F.col("s"), S.HYDROPATHY)).first()
    assert np.allclose(got, (2738.025, 2377.7206, -9.8))  # sums of the published tables


@pytest.fixture
def service():
    calls = []

    class Answer(BaseHTTPRequestHandler):
        def do_GET(self):
            calls.append(self.path)
            at = urlparse(self.path)
            if at.path == "/flaky" and calls.count(self.path) < 3 or at.path == "/broken":
                return self.send_error(500)
            q = {k: int(v[0]) for k, v in parse_qs(at.query).items()}
            body = json.dumps({"totalCount": 25, "data": [{"id": i} for i in range(q["offset"], min(25, q["offset"] + q["limit"]))]} if at.path == "/peptides" else {"path": at.path}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", calls
    server.shutdown()


def test_services(spark, service, tmp_path):
    url, calls = service
    items = rest.paged(spark, url, page_size=10, pause=0.01)
    assert sorted(json.loads(r.item)["id"] for r in items.collect()) == list(range(25))
    assert rest.Client(url, tries=3, pause=0.01).get("/flaky") == {"path": "/flaky"}
    requests = spark.createDataFrame([("a",), ("b",), ("a",), (None,), ("broken",)], "request string")
    make = lambda limiter: rest.from_service(url, "/{}", limiter, tries=1, pause=0.01)
    for _ in range(2):
        got = {r.request: (r.payload, r.error is not None) for r in rest.looked_up(requests, str(tmp_path / "cache"), make, per_second=1000).collect()}
        assert got == {"a": ('{"path": "/a"}', False), "b": ('{"path": "/b"}', False), "broken": (None, True)}
    assert calls.count("/a") == 1 and calls.count("/broken") == 2


def test_one_rate_over_four_tasks(spark, service, tmp_path):
    """Forty requests at twenty a second take two seconds whoever makes them, and no second sees more than the rate."""
    url, _ = service

    def make(limiter):
        def fetch(text):
            limiter.wait()
            return time.time()

        return fetch

    requests = spark.createDataFrame([(f"r{i}",) for i in range(40)], "request string")
    at = sorted(float(r.payload) for r in rest.looked_up(requests, str(tmp_path / "cache"), make, per_second=20, tasks=4).collect())
    assert len(at) == 40 and at[-1] - at[0] >= 1.8
    assert max(sum(1 for t in at if s <= t < s + 1) for s in at) <= 22


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(0, "KLVFF", "head_to_tail", [1.0, 2.0]), (1, "aaaa", "disulfide", [3.0, 4.0])], "ord long, sequence string, cyclization_type string, embedding array<double>")
    sinks.write_embedding_cache(rows, str(tmp_path / "cache"), "model", None)
    assert sinks.read_embedding_cache(rows.drop("embedding"), str(tmp_path / "cache"), "model").count() == 2
    with pytest.raises(ValueError, match="model_name, sequence_count, sequence_hash"):
        sinks.read_embedding_cache(rows.limit(1), str(tmp_path / "cache"), "other")
    sinks.write_fasta_files(rows.select(F.concat(F.lit("a/"), F.col("ord")).alias("record_id"), "sequence"), str(tmp_path / "fasta"))
    assert sorted(p.name for p in (tmp_path / "fasta").glob("file=*")) == ["file=a_0", "file=a_1"]
    sinks.write_failures(rows.select("ord", (F.col("ord") == 0).alias("success")), str(tmp_path / "failed"))
    assert [r.ord for r in spark.read.json(str(tmp_path / "failed")).collect()] == [1]
    sinks.write_manifest(rows.groupBy().count(), str(tmp_path / "manifest"))
    (tmp_path / "x.csv").write_bytes('﻿a,b\n"1\n2",""\n'.encode())
    assert [tuple(r) for r in sinks.csv(spark, str(tmp_path / "x.csv")).collect()] == [("1\n2", None)]
