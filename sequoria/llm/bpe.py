"""Byte-level BPE encoding by overlapping chunks, and decoding.

A long text is cut into chunks that overlap. Each chunk is pre-tokenised by itself, from wherever it starts. A
pre-token's extent depends only on what follows its start, so once two neighbouring chunks share a boundary in their
overlap they agree from there on: the earlier chunk is used up to it and the later one after it. The stitched
pre-tokens are then encoded, each by merging its bytes in order of rank. Decoding concatenates the tokens' bytes.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import importable_on_workers, lean

#: Characters of a chunk, and how far it reads on into the next one.
CHUNK, OVERLAP = 65_536, 2_048
#: A match that ends this near to a chunk's end may be another one in the whole text (contractions, trailing space).
GUARD = 4
#: Distinct pre-tokens whose encoding a worker keeps, and the longest that it keeps.
KEPT, KEPT_CHARS = 400_000, 64


def load_ranks(path: str) -> dict[bytes, int]:
    """The tiktoken file format: base64 of the bytes, a space, the rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-token: the pair of least rank is merged first, the leftmost of equals.

    A heap of pairs and a linked list of parts keep the cost near n log n for very long pieces.
    """
    import heapq

    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    end, after, before = [i + 1 for i in range(n)], [i + 1 for i in range(n)], [i - 1 for i in range(n)]
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (r := ranks.get(piece[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[j]))

    for i in range(n - 1):
        offer(i)
    gone = bytearray(n)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if gone[i] or (j := after[i]) >= n or end[j] != stop:
            continue
        end[i], after[i], gone[j] = stop, after[j], 1
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = after[i]
    return out


class Pieces(dict):
    """Pre-token to its ids as decimal text, each with a leading space; short ones are kept up to a bound."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks

    def __missing__(self, piece: str) -> str:
        out = "".join(f" {x}" for x in merge(piece.encode("utf-8", "surrogatepass"), self.ranks))
        if len(piece) <= KEPT_CHARS:
            if len(self) >= KEPT:
                self.clear()
            self[piece] = out
        return out


def chunk_starts(n: int, chunk: int) -> range:
    return range(0, max(n, 1), chunk)


def boundaries(text: str, pattern: regex.Pattern, last: bool) -> list[int]:
    """Starts of the pre-tokens of a chunk, and the end of the last one that is sure."""
    out, stop = [], len(text) if last else len(text) - GUARD
    end = 0
    for m in pattern.finditer(text):
        if m.end() > stop:
            break
        out.append(m.start())
        end = m.end()
    return [*out, end] if out else []


def stitch(n: int, marks: list[list[int]], starts: list[int], again) -> list[int]:
    """One list of boundaries of the whole text from those of its chunks (in the text's positions).

    again(at): boundaries from a given position on, for the rare case that an overlap shows no common one.
    """
    out = list(marks[0]) or [0]
    for k in range(1, len(marks)):
        seen = set(marks[k])
        while True:
            common = next((x for x in out[bisect_left(out, starts[k]) :] if x in seen), None)
            if common is not None or out[-1] >= n:
                break
            more = again(out[-1])  # the earlier chunk reads on
            if not more or more[-1] <= out[-1]:
                break
            out += more[1:]
        if common is None:
            continue
        del out[bisect_left(out, common) :]
        out += marks[k][bisect_left(marks[k], common) :]
    return out


def pretokens(text: str, pattern: regex.Pattern, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """Pre-tokens of a whole text through its overlapping chunks; texts of one chunk need no stitching."""
    if len(text) <= chunk + overlap:
        return pattern.findall(text)
    starts = list(chunk_starts(len(text), chunk))
    marks = [[s + x for x in boundaries(text[s : s + chunk + overlap], pattern, s + chunk + overlap >= len(text))] for s in starts]
    return cut(text, marks, starts, pattern, overlap)


def cut(text: str, marks: list[list[int]], starts: list[int], pattern: regex.Pattern, overlap: int = OVERLAP) -> list[str]:
    def again(at: int) -> list[int]:
        span = max(overlap, 64)
        while True:
            got = boundaries(text[at : at + span], pattern, at + span >= len(text))
            if len(got) > 1 or at + span >= len(text):
                return [at + x for x in got]
            span *= 2

    at = stitch(len(text), marks, starts, again)
    if at[-1] < len(text):
        at += [x for x in again(at[-1])[1:]]
        while at[-1] < len(text):
            at += again(at[-1])[1:]
    return [text[a:b] for a, b in zip(at, at[1:], strict=False)]


_LOADED: dict[tuple[str, str], tuple] = {}


def tools(path: str, pattern: str) -> tuple[regex.Pattern, Pieces, dict[str, bytes]]:
    """Compiled pattern, encoder and decoder table of this worker; the file is part of each machine's installation."""
    if (path, pattern) not in _LOADED:
        ranks = load_ranks(path)
        _LOADED[path, pattern] = regex.compile(pattern), Pieces(ranks), {str(i): b for b, i in ranks.items()}
    return _LOADED[path, pattern]


def decode(ids: str, table: dict[str, bytes]) -> bytes:
    """Bytes of ids in decimal, with a space before each."""
    return b"".join(map(table.__getitem__, ids[1:].split(" "))) if ids else b""


def _encoded(path: str, pattern: str, pieces_of, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form, pieces, table = tools(path, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                n, sha, back, ids = [], [], [], []
                for row in pieces_of(part, form):
                    out = "".join(map(pieces.__getitem__, row))
                    n.append(out.count(" "))
                    sha.append(hashlib.sha256(out[1:].encode()).hexdigest())
                    back.append(hashlib.sha256(decode(out, table)).hexdigest())
                    if with_ids:
                        ids.append(np.fromstring(out, np.int32, sep=" "))
                cols = [part.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
                names = [part.schema.names[0], "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    cols, names = [*cols, pa.array(ids, pa.list_(pa.int32()))], [*names, "token_ids"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def _short(batch: pa.RecordBatch, form: regex.Pattern) -> Iterator[list[str]]:
    for text in batch.column(1).to_pylist():
        yield pretokens(text or "", form)


def _stitched(batch: pa.RecordBatch, form: regex.Pattern) -> Iterator[list[str]]:
    for chunks in batch.column(1).to_pylist():
        chunks.sort(key=lambda c: c["k"])
        text = "".join(c["text"][:CHUNK] for c in chunks)
        starts = [c["k"] * CHUNK for c in chunks]
        yield cut(text, [[s + x for x in c["marks"]] for s, c in zip(starts, chunks, strict=True)], starts, form)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, text in zip(batch.column(0), batch.column(1), strict=True):
            text, key = text.as_py(), key.as_py()
            for s in chunk_starts(len(text), CHUNK):
                yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([s // CHUNK], pa.int32()), pa.array([text[s : s + CHUNK + OVERLAP]]), pa.array([s + CHUNK + OVERLAP >= len(text)])], names=["key", "k", "text", "last"])


def _marked(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = tools(path, pattern)[0]
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                marks = boundaries(row.column(2)[0].as_py(), form, row.column(3)[0].as_py())
                yield pa.RecordBatch.from_arrays([row.column(0), row.column(1), row.column(2), pa.array([marks], pa.list_(pa.int32()))], names=["key", "k", "text", "marks"])

    return run


def encode(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, token_ids]) for every row of docs (doc_id, text).

    ids_sha256 is of the decimal ids joined by one space, decoded_sha256 of the bytes decoded from those ids. A null
    text is an empty one: 0 tokens. Repeated rows give repeated rows; an empty table none; other columns are ignored.
    Texts of more than CHUNK + OVERLAP characters are dealt out as chunk rows, pre-tokenised in parallel, and each
    such text is stitched in one row; equal long texts are encoded once.
    """
    importable_on_workers(docs.sparkSession)
    out = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    is_long = F.coalesce(F.length("text") > CHUNK + OVERLAP, F.lit(False))
    short = docs.filter(~is_long).mapInArrow(lean(_encoded(path, pattern, _short, with_ids)), f"doc_id long, {out}")
    large = docs.filter(is_long).withColumn("key", F.sha2("text", 256))
    once = large.select("key", "text").dropDuplicates(["key"]).mapInArrow(lean(_chunks), "key string, k int, text string, last boolean")
    marked = once.repartition("key", "k").mapInArrow(lean(_marked(path, pattern)), "key string, k int, text string, marks array<int>")
    stitched = marked.groupBy("key").agg(F.collect_list(F.struct("k", "text", "marks")).alias("chunks"))
    done = stitched.mapInArrow(lean(_encoded(path, pattern, _stitched, with_ids)), f"key string, {out}")
    return short.unionByName(large.select("doc_id", "key").join(done, "key").drop("key"))


def tokenizer() -> tuple[str, str]:
    """Path and pattern of the public 50k byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode_documents(spark: SparkSession, docs: DataFrame, with_ids: bool = False) -> DataFrame:
    path, pattern = tokenizer()
    return encode(docs, path, pattern, with_ids)
