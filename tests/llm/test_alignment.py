"""Token alignment against whole-text tokenizers and plain loops."""

from __future__ import annotations

import hashlib
import os
import random
from collections import Counter

import numpy as np
import pytest

from sequoria.llm import alignment

public_tokenizers = pytest.importorskip("public_tokenizers")
SPECIAL = "<|endoftext|>"


@pytest.fixture(scope="module")
def plain():
    """Text to (ids, ends) of both sides, by the libraries over whole texts."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = alignment.byte_alphabet()

    def bytes_b(i: int) -> bytes:
        piece = two.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if two.is_byte(i) else piece.replace("▁", " ").encode()

    def run(text: str | None):
        if not text:
            return ([], []), ([], [])
        a, b = one.encode(" " + text, add_special_tokens=False), two.encode(text)
        out = []
        for ids, each in ((a.ids, [bytes(letters[c] for c in t) for t in a.tokens]), (b, [bytes_b(i) for i in b])):
            if b"".join(each) != (" " + text).encode():
                return ([], []), ([], [])
            ends, at = [], 0
            for x in each:
                at += len(x)
                ends.append(at)
            out.append((ids, ends))
        return tuple(out)

    return run


def expected(plain, rows):
    found = [(doc_id, *plain(text)) for doc_id, text in rows]
    links = [[(a[0][i], b[0][b[1].index(e)]) for i, e in enumerate(a[1]) if e in set(b[1])] for _, a, b in found]
    count = Counter(p for x in links for p in x)
    best: dict = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for (doc_id, a, b), mine in zip(found, links, strict=True):
        cuts, groups, i, j = sorted(set(a[1]) & set(b[1])), [], 0, 0
        for c in cuts:
            x, y = [], []
            while i < len(a[1]) and a[1][i] <= c:
                x, i = [*x, str(a[0][i])], i + 1
            while j < len(b[1]) and b[1][j] <= c:
                y, j = [*y, str(b[0][j])], j + 1
            groups.append(",".join(x) + "|" + ",".join(y))
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((doc_id, len(a[0]), len(b[0]), len(cuts), len(mine), sum(count[p] == best[p[1]] for p in mine), sum(count[p] for p in mine), sha))
    return sorted(out, key=str)


ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "  a   b  ", "a\n b", "a \n  b", "\n\n  x", "a\t\t b  c", "a▁b", "▁", SPECIAL + " x" + SPECIAL,
    "<s> </s> <unk> <0x41>", "don't I'll  we've", "x\x1c y\x85 z \x1fq", "​ 　   u", "日本語 テキスト", "🙂🙂 é é", "\x00 a", "ab" * 3000, " " * 5000 + "z" + " " * 17, "1234567890 " * 50, "\r\n \r\n", "ﬁ Å ｆｕｌｌ",
]


def test_whole_texts(spark, plain):
    rng = random.Random(5)
    words = ["the", "Über", "naïve,", "x1", "\n", "", " ", "\t", "end.\nNew", "…", "'s", "日本", " ", SPECIAL, "7", "%%"]
    rows = list(enumerate(ODD)) + [(100 + i, " ".join(rng.choices(words, k=rng.randrange(40)))) for i in range(300)]
    rows += rows[-3:] * 2 + [(None, "the the"), (7, "another text under an id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 a", "2 b", "3 cuts", "4 row", "5 pair", "6 n_best").repartition(3)
    got = alignment.align_documents(docs)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == expected(plain, rows)


def test_rare_pairs_by_a_join_and_long_texts(spark, plain):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices(["alpha", "beta", "gammas", "delta", "Epsilon", "zeta!"], k=200))) for i in range(30)]
    rows += [(99, "long text, " * 20_000), (98, "a" * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path, pattern, other = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model")
    few = sorted(map(tuple, alignment.align(docs, path, pattern, other, broadcast_rows=3).collect()), key=str)
    assert few == sorted(map(tuple, alignment.align_documents(docs).collect()), key=str)
    short = [r for r in rows if r[0] < 98]
    assert sorted(map(tuple, alignment.align_documents(docs.filter("doc_id < 98")).collect()), key=str) == expected(plain, short)


def test_empty_table(spark):
    assert alignment.align_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_segments_are_tokenised_together_as_one_by_one():
    tools = alignment.Tokenizers(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))
    calls, fast = [], tools.fast

    class Counted:
        def encode_ordinary(self, text):
            calls.append(text)
            return fast.encode_ordinary(text)

    tools.fast = Counted()
    keys = [f"w{i}x's" for i in range(500)] + ["a\nb", "c \n", "ﬁne", "é", "日本", "y" * 5000, "<unk>", "1,2", "z\x1cq"]
    tools.learn(keys)
    assert len(calls) < 10
    held = {c: np.frombuffer(tools.flat[c], np.int32) for c in tools.flat}
    for key in keys:
        row, text = tools.rows[key], f" {key}".encode()
        a, b = tools.ids_a(" " + key), tools.pieces.encode(key)
        for c, ids, names in (("a", a, tools.bytes_a), ("b", b, tools.bytes_b)):
            at = slice(tools.start[c][row], tools.start[c][row + 1])
            assert held[c][at].tolist() == ids and held[c + "_len"][at].tolist() == [len(names[i]) for i in ids]
        assert tools.fits[row] == (b"".join(tools.bytes_a[i] for i in a) == text == b"".join(tools.bytes_b[i] for i in b))
