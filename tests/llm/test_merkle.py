"""The Merkle manifest against a plain tree in memory."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from sequoria.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row: tuple) -> str:
    doc_id, source, lang, n_chars, text = row
    each = ["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)]
    return h(*each)


def levels(digests: list[str]) -> list[list[str]]:
    out = [digests]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def expected(rows: list[tuple]) -> list[tuple]:
    by: dict = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {s: levels([leaf(r) for r in by[s]]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(by[s]):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            low = "".join(c.lower() if c.isascii() else c for c in r[4]) if tampered else r[4]
            digest, proof = leaf((*r[:4], low)), []
            for at, tree in ((i, trees[s]), (k, top)):
                for level in tree[:-1]:
                    run = level[at // 16 * 16 : at // 16 * 16 + 16]
                    left, right = run[: at % 16], run[at % 16 + 1 :]
                    proof += left + right
                    digest, at = h(*left, digest, *right), at // 16
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], h(*proof), digest, digest == top[-1][0]))
    return sorted(out, key=str)


def found(spark, rows: list[tuple]) -> list[tuple]:
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(map(tuple, merkle.manifest(df).collect()), key=str)


def test_hot_source_ties_nulls_and_repeats(spark):
    rng = random.Random(3)
    rows = [(i, "hot", "en", i, f"Text {rng.random()} Ä") for i in rng.sample(range(10_000), 700)]
    rows += [(rng.randrange(50), rng.choice([None, "", "é", "z", "Z"]), None, None, rng.choice([None, "", "ABC", "x" * 70_000])) for _ in range(120)]
    rows += [rows[0]] * 40 + [(None, "hot", "en", 1, "A")] * 3 + [(5, f"s{i:03}", "en", 1, "One") for i in range(20)]
    got = found(spark, rows)
    assert got == expected(rows)
    assert {r[6] for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 17, 256])
def test_whole_and_short_runs(spark, n):
    rows = [(i, "a", "en", 1, f"T{i}") for i in range(n)]
    assert found(spark, rows) == expected(rows)


def test_empty_table_and_other_columns(spark):
    df = spark.createDataFrame([], SCHEMA + ", grp int, idx int, leaf int, root int, digest int")
    assert merkle.manifest(df).collect() == []
    rows = [(1, "a", "en", 1, "T", 5), (2, "a", "en", 1, "t", 6)]
    wide = spark.createDataFrame(rows, SCHEMA + ", grp int").selectExpr("*", "grp idx", "grp leaf", "grp root", "grp digest", "grp n", "grp tie")
    assert sorted(map(tuple, merkle.manifest(wide).collect()), key=str) == expected([r[:5] for r in rows])


def test_runs_that_start_and_end_anywhere():
    """Stacks over any cuts of a group give each node once, or its children as peaks."""
    n, digests = 5000, [h(str(i)) for i in range(5000)]
    whole = levels(digests)
    rng = random.Random(1)
    for cuts in ([], [1], [15, 16, 17], [256, 300, 4096], sorted(rng.sample(range(1, n), 40))):
        out: list = []
        for a, b in zip([0, *cuts], [*cuts, n], strict=True):
            stack = merkle.Mountains("g", n, out)
            for i in range(a, b):
                stack.push(i, digests[i])
            stack.close()
        assert all(whole[level][i] == d for _, _, level, i, d, _ in out)
        nodes = [(level, i) for _, _, level, i, _, c in out if c is not None]
        peaks = [(level, i) for _, _, level, i, _, c in out if c is None]
        assert len(set(nodes)) == len(nodes) and not {(level + 1, i // 16) for level, i in peaks} & set(nodes)
        assert len(peaks) <= 2 * 15 * len(whole) * (len(cuts) + 1)
