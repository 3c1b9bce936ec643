"""Alignment of two tokenizers' tokens by byte offsets.

Python tokenises and returns, for each text, both lists of tokens and of byte offsets where they end. All else is
array functions: array_intersect of the end arrays gives the cuts, a sort puts a mark behind the token that ends at each
cut, transforms and joins of arrays make the groups' texts and the links. Links are counted over the corpus by id pair;
counts come back to the texts by a join.

Texts are tokenised by segments, which both tokenizers treat alike wherever they stand: a space, and what follows up to
the next space that has something other than white space behind it. Workers keep the tokens of the segments they met.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .bpe import merge
from .common import BROADCAST_ROWS, importable_on_workers, lean, materialize

#: Bytes of text that a worker has in hand at once; tokens of kept segments at most; segment length from which pre-tokens
#: are merged here, in n log n; segments that are tokenised as one text.
SLICE, KEPT, LONG, TOGETHER = 2_000_000, 750_000, 2_000, 4_096
#: A token is its end offset << BITS | id; an end is a mark, which has an id that no token has.
BITS, MARK = 20, 999_999
TOKENS = StructType([StructField("doc_id", LongType())] + [StructField(c, ArrayType(LongType(), False), False) for c in ("a", "a_ends", "b", "b_ends")])
SPACE = "▁"


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 characters for themselves,
    all other bytes for the characters from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Both vocabularies, and the tokens of the segments met so far. A key k stands for the segment ' ' + k."""

    def __init__(self, path_a: str, pattern: str, path_b: str):
        import sentencepiece
        import tiktoken

        with open(path_a, encoding="utf-8") as f:
            model = json.load(f)
        letters, special = byte_alphabet(), {x["content"] for x in model["added_tokens"]}
        self.ranks = {bytes(map(letters.__getitem__, t)): i for t, i in model["model"]["vocab"].items() if t not in special}
        self.bytes_a = {i: t for t, i in self.ranks.items()}
        self.fast, self.form = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={}), regex.compile(pattern)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path_b)
        n = self.pieces.get_piece_size()
        text = [self.pieces.id_to_piece(i) for i in range(n)]
        self.bytes_b = [bytes([int(t[1:-1], 16)]) if self.pieces.is_byte(i) else t.replace(SPACE, " ").encode() for i, t in enumerate(text)]
        self.len_a, self.len_b = np.zeros(max(self.bytes_a) + 1, np.int64), np.array([len(t) for t in self.bytes_b])
        self.len_a[list(self.bytes_a)] = [len(t) for t in self.bytes_a.values()]
        if max(n, *self.bytes_a) >= MARK:
            raise ValueError(f"ids must be under {MARK}")
        if any(SPACE in t.lstrip(SPACE) for t in text):
            raise ValueError("a piece goes on behind a space: segments would not be tokenised as whole texts are")
        self.clear()

    def clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.flat = {c: array("i") for c in ("a", "a_len", "b", "b_len")}
        self.start = {"a": array("q", [0]), "b": array("q", [0])}
        self.fits = array("b")

    def ids_a(self, text: str) -> list[int]:
        if len(text) < LONG:
            return self.fast.encode_ordinary(text)
        return [i for piece in self.form.findall(text) for i in merge(piece.encode(), self.ranks)]

    def ids_together(self, whole: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of short segments without more white space, and how many each has, from their common text; bounds:
        where each ends. None where tokens do not end where segments do."""
        ids = np.array(self.fast.encode_ordinary(whole.decode()), np.int64)
        ends = np.cumsum(self.len_a[ids])
        last = np.searchsorted(ends, bounds)
        if not len(ids) or ends[-1] != len(whole) or (ends[last] != bounds).any():
            return None
        return ids, np.diff(last, prepend=-1)

    def learn(self, keys: list[str]) -> None:
        plain = [len(k) < LONG - 1 and k.split() == [k] for k in keys]
        for kind in (True, False):
            part = [k for k, p in zip(keys, plain, strict=True) if p is kind]
            for i in range(0, len(part), TOGETHER):
                self._learn(part[i : i + TOGETHER], kind)

    def _learn(self, keys: list[str], plain: bool) -> None:
        each = [f" {k}".encode() for k in keys]
        whole, bounds = b"".join(each), np.cumsum([len(x) for x in each])
        fits = np.ones(len(keys), np.int8)
        if (got := self.ids_together(whole, bounds) if plain else None) is None:
            lists = [self.ids_a(" " + k) for k in keys]
            got = np.array([i for ids in lists for i in ids], np.int64), np.array([len(ids) for ids in lists])
        lists = self.pieces.encode(keys, num_threads=1)
        both = (got, (np.array([i for ids in lists for i in ids], np.int64), np.array([len(ids) for ids in lists])))
        for c, (ids, n), texts, sizes in (("a", both[0], self.bytes_a, self.len_a), ("b", both[1], self.bytes_b, self.len_b)):
            size, begin = sizes[ids], self.start[c][-1]
            joined, ends = b"".join(map(texts.__getitem__, ids.tolist())), np.append(0, np.cumsum(size))[np.cumsum(n)]
            if joined != whole or (ends != bounds).any():
                fits &= np.array([joined[p:q] == x for p, q, x in zip([0, *ends[:-1].tolist()], ends.tolist(), each, strict=True)], np.int8)
            self.flat[c].frombytes(ids.astype(np.int32).tobytes())
            self.flat[c + "_len"].frombytes(size.astype(np.int32).tobytes())
            self.start[c].frombytes((begin + np.cumsum(n)).astype(np.int64).tobytes())
        self.fits.frombytes(fits.tobytes())
        self.rows.update(zip(keys, range(len(self.rows), len(self.rows) + len(keys)), strict=True))

    def known(self, keys: list[str]) -> np.ndarray:
        """Row of each key; -1 where it is no segment by itself: empty, or white space stands behind its space."""
        if missing := [k for k in dict.fromkeys(keys) if k not in self.rows and k and not k[0].isspace()]:
            self.learn(missing)
        return np.fromiter((self.rows.get(k, -1) for k in keys), np.int64, len(keys))

    def joined(self, keys: list[str], alone: np.ndarray) -> list[str]:
        """Keys of the segments of a text: what is none by itself goes with the one before it and the one behind."""
        out: list[list[str]] = []
        glue = False
        for key, ok in zip(keys, alone, strict=True):
            if out and (glue or not ok):
                out[-1].append(key)
            else:
                out.append([key])
            glue = not ok
        return [" ".join(x) for x in out]


_LOADED: dict[tuple, Tokenizers] = {}


def _ragged(start: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all entries of some rows of a ragged table, and how many each row has."""
    n = start[rows + 1] - start[rows]
    before = np.cumsum(n) - n
    return np.repeat(start[rows] - before, n) + np.arange(n.sum()), n


def _tokenised(path_a: str, pattern: str, path_b: str):
    def one(tools: Tokenizers, ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        parts = pc.split_pattern(pc.fill_null(texts, ""), " ")
        coded = parts.flatten().dictionary_encode()
        codes, bounds = coded.indices.to_numpy(zero_copy_only=False), parts.offsets.to_numpy() - parts.offsets[0].as_py()
        words = coded.dictionary.to_pylist()
        rows = tools.known(words)[codes] if len(codes) else np.empty(0, np.int64)
        counts = np.diff(bounds)
        odd = np.add.reduceat(rows < 0, bounds[:-1]) > 0 if len(rows) else np.zeros(len(counts), bool)
        if odd.any():
            pieces = []
            for d in range(len(counts)):
                part = rows[bounds[d] : bounds[d + 1]]
                if odd[d]:
                    keys = [words[i] for i in codes[bounds[d] : bounds[d + 1]]]
                    keys = tools.joined(keys, part >= 0) if keys != [""] else []
                    if missing := [k for k in dict.fromkeys(keys) if k not in tools.rows]:
                        tools.learn(missing)
                    part = np.fromiter(map(tools.rows.__getitem__, keys), np.int64, len(keys))
                pieces.append(part)
            rows, counts = np.concatenate(pieces), np.array([len(p) for p in pieces])
        doc = np.repeat(np.arange(len(counts)), counts)
        bad = np.zeros(len(counts), bool)
        bad[doc[np.frombuffer(tools.fits, np.int8)[rows] == 0]] = True
        keep = ~bad[doc]
        rows, doc = rows[keep], doc[keep]
        out: list[pa.Array] = [ids]
        for c in ("a", "b"):
            at, n = _ragged(np.frombuffer(tools.start[c], np.int64), rows)
            total = np.append(0, np.cumsum(np.bincount(doc, n, len(counts)).astype(np.int64)))
            ends = np.cumsum(np.frombuffer(tools.flat[c + "_len"], np.int32)[at], dtype=np.int64) if len(at) else np.empty(0, np.int64)
            base = np.concatenate([[0], ends])[total[:-1]]
            ends -= np.repeat(base, np.diff(total))
            values = np.frombuffer(tools.flat[c], np.int32)[at] if len(at) else np.empty(0, np.int32)
            offsets = pa.array(total.astype(np.int32))
            out += [pa.ListArray.from_arrays(offsets, pa.array(ends << BITS | values)), pa.ListArray.from_arrays(offsets, pa.array(ends << BITS | MARK))]
        return pa.RecordBatch.from_arrays(out, names=["doc_id", "a", "a_ends", "b", "b_ends"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (path_a, pattern, path_b)
        if key not in _LOADED:
            _LOADED[key] = Tokenizers(*key)
        tools = _LOADED[key]
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
            start = 0
            while start < batch.num_rows:
                done = sizes[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(sizes, done + SLICE, "right")))
                part = batch.slice(start, stop - start)
                yield one(tools, part.column(0), part.column(1))
                start = stop
                if len(tools.flat["a"]) > KEPT:
                    tools.clear()

    return run


def tokenised(docs: DataFrame, path_a: str, pattern: str, path_b: str) -> DataFrame:
    """TOKENS of every row of docs (doc_id, text); empty arrays for null and empty texts, and where the joined bytes of
    either side's tokens are not those of a space and the text."""
    importable_on_workers(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(_tokenised(path_a, pattern, path_b)), TOKENS)


def grouped(tokens: str, marks: str) -> Column:
    """The ids of each group of a side, decimal, joined by commas. Tokens are end << BITS | id; a mark stands behind the
    token that ends at a cut, after one sort of two ascending runs, and the joined ids are split at the marks."""
    ids = F.transform(F.sort_array(F.concat(tokens, marks)), lambda x: x.bitwiseAND(F.lit(2**BITS - 1).cast("long")))
    return F.split(F.array_join(ids.cast("array<string>"), ","), f",{MARK},")


def beside(left: str, right: str) -> Column:
    """`x|y;...` of two arrays of strings. Their pairs become text by a cast to `{x, y}`, which costs a third of a lambda."""
    pairs = F.array_join(F.arrays_zip(left, right).cast("array<string>"), ";")
    return F.replace(F.replace(F.btrim(pairs, F.lit("{}")), F.lit("};{"), F.lit(";")), F.lit(", "), F.lit("|"))


def aligned(tokens: DataFrame) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, groups_sha256, a_link, b_link) for TOKENS: the ids linked at each cut, in order."""
    df = tokens.withColumn("cuts", F.array_intersect("a_ends", "b_ends"))
    # nothing is behind the last cut, which is the end of both
    marks = F.slice("cuts", F.lit(1), F.greatest(F.size("cuts") - 1, F.lit(0)))
    df = df.select("doc_id", "a", "b", F.size("cuts").cast("long").alias("n_groups"), marks.alias("marks"))
    df = df.select("doc_id", "n_groups", F.size("a").cast("long").alias("n_a"), F.size("b").cast("long").alias("n_b"), grouped("a", "marks").alias("in_a"), grouped("b", "marks").alias("in_b"))
    some = F.col("n_groups") > 0
    last = lambda side: F.when(some, F.transform(side, lambda x: F.substring_index(x, ",", -1)).cast("array<int>"))
    return df.select("doc_id", "n_a", "n_b", "n_groups", F.when(some, F.sha2(beside("in_a", "in_b"), 256)).otherwise("").alias("groups_sha256"), last("in_a").alias("a_link"), last("in_b").alias("b_link"))


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, b, n, best) of links (pair): how often each id pair is linked, and whether none with its B id is more so."""
    n = materialize(links.groupBy("pair").agg(F.count("*").alias("n")), "pairs").withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int"))
    most = n.groupBy("b").agg(F.max("n").alias("most"))
    return materialize(n.join(most, "b").select("pair", "b", "n", (F.col("n") == F.col("most")).cast("long").alias("best")), "pair-counts")


def linked_sums(links: DataFrame, counts: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """(row, n_best, count_sum) of links (row, pair). The most frequent pairs, about `rows` at most, are broadcast; the
    rest, none of which is frequent, are summed by row and joined."""
    total, over = counts.count(), 0
    if total > rows:
        over = counts.agg(F.percentile_approx("n", 1 - rows / total, 100_000)).first()[0]
    often = F.broadcast(counts.filter(F.col("n") > over).select("pair", "n", "best"))
    if not over:
        return links.join(often, "pair").groupBy("row").agg(F.sum("best").alias("n_best"), F.sum("n").alias("count_sum"))
    met = links.join(often, "pair", "left")
    seldom = met.filter("n is null").groupBy("row", "pair").agg(F.count("*").alias("m"))
    seldom = seldom.join(counts, "pair").select("row", (F.col("best") * F.col("m")).alias("best"), (F.col("n") * F.col("m")).alias("n"))
    return met.filter("n is not null").select("row", "best", "n").unionByName(seldom).groupBy("row").agg(F.sum("best").alias("n_best"), F.sum("n").alias("count_sum"))


def align(docs: DataFrame, path_a: str, pattern: str, path_b: str, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of docs (doc_id, text).

    A: byte-level BPE vocabulary (path_a, split by pattern), B: sentence pieces (path_b); both of a space and the text.
    Tokens of a side never end at one offset, so a cut has one link. A text without tokens has zeros and ''. Repeated
    rows count as often as they stand there; an empty table gives none; other columns are ignored.
    """
    out = aligned(tokenised(docs, path_a, pattern, path_b)).withColumn("row", F.monotonically_increasing_id())
    out = materialize(out, "aligned")
    pair = lambda x: F.shiftleft(x.a_link.cast("long"), 32).bitwiseOR(x.b_link.cast("long"))
    links = out.select("row", F.explode(F.arrays_zip("a_link", "b_link")).alias("x")).select("row", pair(F.col("x")).alias("pair"))
    sums = linked_sums(links, pair_counts(links), broadcast_rows)
    out = out.join(sums, "row", "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"), F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"), "groups_sha256")


def align_documents(docs: DataFrame) -> DataFrame:
    """align with the public 50k byte-level vocabulary and the public 32k piece model."""
    import public_tokenizers

    return align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))
