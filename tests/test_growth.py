"""What queries on long or many sequences must not do again and again."""

from __future__ import annotations

import time
from pathlib import Path

from pyspark.sql import functions as F

from sequoria.functions import letters as W
from sequoria.functions import sequence as S
from sequoria.operators import curation as C
from sequoria.operators import evaluation as E
from sequoria.plans import proxies as P


def scratched(spark, name: str) -> set[str]:
    at = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")) / "sequoria"
    return {p.name for p in at.glob(f"{name}-*")}


def counted(spark, rows):
    """rows through a function that counts how many it has seen."""
    seen = spark.sparkContext.accumulator(0)

    def each(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return rows.mapInArrow(each, rows.schema), seen


def test_rings_of_many_letters_are_turned_in_time(spark):
    ring, began = "C" * 10_000 + "A" + "C" * 10_000, time.time()
    row = spark.createDataFrame([(ring,)], "seq string").select(S.canonical(F.col("seq")).alias("c"), S.even_rotations(F.col("seq")).alias("e"), S.period(F.col("seq")).alias("p")).first()
    assert row.c == "A" + "C" * 20_000 and row.p == len(ring)
    assert row.e == [ring[i:] + ring[:i] for i in (0, 5_000, 10_000, 15_000)]
    assert time.time() - began < 15


def test_distinct_rotations_end_at_the_period(spark):
    rows = spark.createDataFrame([("",), (None,), ("A",), ("AAA",), ("ABAB",), ("AABAAB",), ("ABC",)], "seq string")
    for r in rows.select("seq", S.distinct_rotations(F.col("seq")).alias("d"), S.period(F.col("seq")).alias("p")).collect():
        assert r.d == list(dict.fromkeys(r.seq[i:] + r.seq[:i] for i in range(len(r.seq or "")))) and r.p == len(r.d)


def test_letters_are_those_of_the_expression(spark):
    texts = ["", "a\0b", "ß ſ ı İ ﬁ K é😀x😀.y Q\r\n!?", "zzz...AAA\x7f[]^_`{|}@", "12 ab-C"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    plain = F.upper(F.regexp_replace("text", "[^A-Za-z.!?\n]", ""))
    assert [r[0] for r in rows.select(P.upper_letters(F.col("text"))).collect()] == [r[0] for r in rows.select(plain).collect()]


def test_groups_are_made_once(spark):
    rows, seen = counted(spark, spark.createDataFrame([(f"g{i % 40}", i % 2) for i in range(200)], "g string, label int"))
    assert E.group_splits(rows, "g").count() == 120
    assert seen.value == 200


def test_folds_and_splits_read_their_rows_once(spark):
    rows, seen = counted(spark, spark.createDataFrame([(f"g{i}", i % 2) for i in range(60)], "g string, label int"))
    assert C.folds(rows, "label", "g").count() == 60 and seen.value == 60
    assert C.train_valid(rows, ["label"], "g").count() == 60 and seen.value == 120


def test_rotations_are_not_stored_to_be_averaged(spark):
    from sequoria.models.embedding import LetterEmbedder, embed_rows

    before = scratched(spark, "rotations")
    rows = spark.createDataFrame([(1, "KLVFF", "head_to_tail"), (2, "VFFKL", "Head-to-tail"), (3, "KLVFF", "disulfide"), (4, "", "head_to_tail"), (5, "ALAL", "head_to_tail")], "ord long, seq string, cyclization_type string")
    got = {r.ord: r.embedding for r in embed_rows(rows, LetterEmbedder()).collect()}
    assert scratched(spark, "rotations") == before
    value = lambda t: [sum(x) / len(t) for x in zip(*[(S.HYDROPATHY[c], S.HYDROPATHY[c] * i, i / len(t)) for i, c in enumerate(t, 1)], strict=True)]
    mean = lambda ts: [sum(x) / len(ts) for x in zip(*map(value, ts), strict=True)]
    near = lambda a, b: all(abs(x - y) < 1e-9 for x, y in zip(a, b, strict=True))
    assert got[1] == got[2] and near(got[1], mean(["KLVFF"[i:] + "KLVFF"[:i] for i in range(5)]))
    assert near(got[3], value("KLVFF")) and got[4] is None and near(got[5], mean(["ALAL", "LALA"]))


def test_signatures_are_slim_and_find_all_pairs(spark):
    import random

    r, texts = random.Random(5), set()
    for _ in range(60):
        t = "".join(r.choice("ACDEF") for _ in range(r.randint(3, 90)))
        texts |= {t, t[:-1] or t, t + r.choice("ACD"), t[: len(t) // 2] + "G" + t[len(t) // 2 :]}
    rows = spark.createDataFrame([(t,) for t in sorted(texts)], "seq string")
    sides = C._sketched(C.with_kmers(rows)).withColumn("classes", F.array(C._size_class(F.col("n"))))
    assert len(C._signatures(sides, 0.8, True).columns) == 5
    grams = {t: {t[i : i + 3] for i in range(max(1, len(t) - 2))} for t in texts}
    like = {(a, b) for a in texts for b in texts if len(grams[a] & grams[b]) / len(grams[a] | grams[b]) >= 0.8}
    assert {tuple(x) for x in C.similar_pairs(C.with_kmers(rows), C.with_kmers(rows)).collect()} == like


def test_letters_of_a_batch_give_what_each_text_gives(spark, monkeypatch):
    import random
    import re

    import pyarrow as pa

    r = random.Random(1)
    texts = [None, "", "A", "AA", "ABAB", "é", "aé" * 3, "AB" * 60, "C" * 300 + "A" + "C" * 300]
    texts += ["".join(r.choice(a) for _ in range(r.randint(0, 90))) for a in ("A", "AB", "ABC", S.ALPHABET) for _ in range(100)]
    prose = [None, "..", "Hello World! x\ny", "é a" * 100, "z" * 240 + ".", "z" * 241, "?a?", "BJOUXZ.abz"] + ["".join(r.choice("abZX.!\n é1?") for _ in range(r.randint(0, 400))) for _ in range(100)]
    for part in (50, 1 << 20):
        monkeypatch.setattr(W, "PART", part)
        some = pa.array(texts).slice(1)
        assert W._canonical(some).to_pylist() == [min(t[i:] + t[:i] for i in range(len(t))) if t else None for t in texts[1:]]
        for k, cyclic in ((1, False), (3, False), (3, True), (6, True)):
            rings = [t + t[: k - 1] if cyclic and len(t) >= k else t for t in texts[1:]]
            assert W._kmers(some, k, cyclic).to_pylist() == [list(dict.fromkeys(t[i : i + k] for i in range(max(1, len(t) - k + 1)))) for t in rings]
        for text, got in zip(prose, W._pieces(pa.array(prose), P.ENDS, 120, P.OTHERS).to_pylist(), strict=True):
            raw = re.findall("[A-Z]{1,120}", re.sub("[^A-Za-z.!?\n]", "", text or "").upper())
            assert [x["raw"] for x in got] == raw and [x["seq"] for x in got] == [re.sub("[BJOUXZ]", "", x) for x in raw]


def test_no_call_a_letter_in_the_engine(spark):
    rows = spark.createDataFrame([("KLVFF",)], "seq string")
    plan = rows.select(S.canonical(F.col("seq")), S.kmers(F.col("seq"), cyclic=True))._jdf.queryExecution().toString()
    assert "lambda" not in plan and "ArrowEvalPython" in plan


def shuffle_files(spark) -> int:
    """Files of shuffles on disk; old ones are only ever removed, so a growth is what is left over."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(str(files.apply(i).getName()).endswith(".data") for i in range(files.size()))


def near_texts(n: int) -> list[str]:
    import random

    r, texts = random.Random(7), set()
    for _ in range(n):
        t = "".join(r.choice("ACDEFGHIKL") for _ in range(r.randint(3, 120)))
        texts |= {t, t[:-1] or t, t + r.choice("ACD"), t[: len(t) // 2] + "M" + t[len(t) // 2 :]}
    return sorted(texts)


def test_similarity_join_goes_by_rounds_and_leaves_no_shuffles(spark, monkeypatch):
    texts, before = near_texts(80), scratched(spark, "pairs")
    rows = C.with_kmers(spark.createDataFrame([(t,) for t in texts], "seq string"))
    grams = {t: {t[i : i + 3] for i in range(max(1, len(t) - 2))} for t in texts}
    like = {(a, b) for a in texts for b in texts if len(grams[a] & grams[b]) / len(grams[a] | grams[b]) >= 0.8}
    monkeypatch.setattr(C, "ROUND", 1_000)
    monkeypatch.setattr(C, "ROUNDS", 12)
    held = shuffle_files(spark)
    pairs = C.similar_pairs(rows, rows)
    # the counts of sizes, by four tasks each
    assert shuffle_files(spark) <= held + 2 * 4
    assert len(scratched(spark, "pairs") - before) >= 8
    assert {tuple(x) for x in pairs.collect()} == like


def test_rounds_hold_all_groups_of_all_classes(monkeypatch):
    sizes = [(s, 10 * s, 7 * s) for s in (3, 4, 9, 16, 19, 57, 118)]
    assert C._rounds(sizes, 0.8) == [((3, 118), (0, 1))]
    monkeypatch.setattr(C, "ROUND", 100)
    parts = C._rounds(sizes, 0.8)
    for size, _, _ in sizes:
        groups = C._grid(size, 0.8)[0]
        assert sorted(g for (a, b), (i, n) in parts for g in range(groups) if a <= size <= b and g % n == i) == list(range(groups))
    assert len(parts) > len(sizes)


def test_keys_are_shared_by_few(spark):
    import random

    r = random.Random(3)
    words = ["".join(r.choice(S.ALPHABET) for _ in range(r.randint(3, 8))) for _ in range(60)]
    texts = sorted({"".join(r.choice(words) for _ in range(12))[:70] for _ in range(400)})
    rows = C._sketched(C.with_kmers(spark.createDataFrame([(t,) for t in texts], "seq string")))
    made = C._signatures(rows.withColumn("classes", F.array(C._size_class(F.col("n")))), 0.8, True).select("id", "key").distinct()
    assert made.groupBy("key").count().agg(F.sum(F.col("count") * (F.col("count") - 1))).first()[0] < 2 * len(texts)


def test_leak_reasons_deal_sequences_alone(spark):
    pre = spark.createDataFrame([(i, t) for i, t in enumerate(near_texts(10))] + [(9_999, None)], "ord long, seq string")
    got = C.leak_reasons(pre, spark.createDataFrame([(t,) for t in near_texts(5)], "seq string"))
    # rotations are looked up before, and are not dealt out beside the sequences
    assert "canonical" not in got._jdf.queryExecution().toString()
    assert {r.ord: r.reason for r in got.collect()}[9_999] is None


def test_exclusions_judge_rows_once(spark):
    from sequoria.operators import cleaning as K

    columns = "ord long, entity string, target string, measured int, reason string, mic_ug_ml double, canonical string, kind string, topology_key string, seq string"
    given = [(1, "a", "x", 1, None), (2, "a", "x", 0, None), (3, "a", "y", 1, None), (4, None, "x", None, "short"), (5, "b", "x", 0, None)]
    rows, seen = counted(spark, spark.createDataFrame([(*r, 1.0, "", "", "", "") for r in given], columns))
    got = {r.ord: r.reason for r in K.core_exclusions(rows).select("ord", "reason").collect()}
    assert got == {1: "conflicting_labels_same_target", 2: "conflicting_labels_same_target", 4: "short"} and seen.value == 5
