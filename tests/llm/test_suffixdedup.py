"""Removal of repeated strings against a plain search of all windows."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from sequoria.llm import suffixdedup

SIZE = suffixdedup.LENGTH


def expected(rows):
    texts = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(t[p : p + SIZE] for _, t in texts for p in range(len(t) - SIZE + 1))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - SIZE + 1):
            if count[t[p : p + SIZE]] > 1:
                gone[p : p + SIZE] = True
        left = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def words(rng, n):
    return " ".join("".join(rng.choices("abcdéñ日", k=rng.randrange(2, 7))) for _ in range(n))


def corpus(rng):
    base = [words(rng, rng.randrange(5, 150)) for _ in range(40)]
    passage, short = words(rng, 60), words(rng, 200).encode()[: SIZE + 3].decode(errors="ignore")
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, words(rng, 30) + passage + words(rng, 20)) for i in range(60)]
    rows += [(200 + i, words(rng, 9) + short + words(rng, 9)) for i in range(30)]
    for i in range(30):  # near copies
        t = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            t[rng.randrange(len(t))] = "x"
        rows.append((300 + i, "".join(t)))
    rows += [(400, "a" * 199), (401, "a" * 199), (402, "b" * 200), (403, "c" * 201), (404, "d" * 200), (405, "d" * 200), (406, "xy" * 500), (407, None), (408, ""), (409, None)]
    rows += [(410, "z" * 150 + "\0" * 150), (411, "z" * 150 + "\0" * 150 + "q"), (412, "\0" * 199 + "k"), (None, base[0]), (5, base[5]), (5, base[5])]
    return rows


@pytest.mark.parametrize("hot", [suffixdedup.HOT, 25])
def test_all_windows(spark, hot):
    """With hot = 25 the passages' groups are split, down to single windows."""
    rows = corpus(random.Random(hot))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 row", "2 h", "3 x", "4 k", "5 n_bytes").repartition(4)
    got = suffixdedup.remove_repeats(df, hot)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows)


def test_empty_table_and_no_repeat(spark):
    assert suffixdedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = [(1, words(random.Random(1), 100)), (2, words(random.Random(2), 100))]
    assert sorted(map(tuple, suffixdedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == expected(rows)


def test_blocks_do_not_change_segments():
    """Pieces of a very long text have the anchors and hashes of the whole."""
    text, old = words(random.Random(3), 4000).encode(), suffixdedup.BLOCK
    whole = suffixdedup.segments(text)
    try:
        suffixdedup.BLOCK = 1000
        parts = suffixdedup.segments(text)
    finally:
        suffixdedup.BLOCK = old
    at = lambda f: np.repeat(f[4], f[3] - f[2] + 1).tolist()
    assert at(parts) == at(whole) and set(parts[0]) == set(whole[0])


@pytest.mark.parametrize("shard", [1, 3, 250])
def test_merged_transforms(shard, monkeypatch):
    """Whatever the shards, the merge finds the windows that occur twice."""
    monkeypatch.setattr(suffixdedup, "SHARD", shard)
    rng = random.Random(shard)
    core = bytes(rng.choices(b"ab", k=300))
    texts = [bytes(rng.choices(b"ab", k=rng.randrange(40))) + core[rng.randrange(90) : 300 - rng.randrange(90)] + bytes(rng.choices(b"ab", k=rng.randrange(40))) for _ in range(20)] + [b"", b"a", b"ab"]
    count = Counter(t[p : p + SIZE] for t in texts for p in range(len(t) - SIZE + 1))
    for t, found in zip(texts, suffixdedup.merged_repeats(texts), strict=True):
        assert found.tolist() == [p for p in range(len(t) - SIZE + 1) if count[t[p : p + SIZE]] > 1]


def test_sorted_shard():
    rng = random.Random(9)
    texts = [bytes(rng.choices(b"ab", k=rng.randrange(60))) for _ in range(30)]
    symbols, ends = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8), np.cumsum([len(t) + 1 for t in texts]) - 1
    suffixes = [(t[p:].ljust(0) + b"", k) for k, t in enumerate(texts) for p in range(len(t) + 1)]
    # an end mark comes before all bytes, an earlier one before a later one
    key = [[*(x + len(texts) for x in s), k] for s, k in suffixes]
    assert suffixdedup.sorted_shard(symbols, ends).tolist() == sorted(range(len(key)), key=key.__getitem__)
