"""Frozen embedders run over sequences: batches planned by length, masked mean pooling, rings averaged over rotations.

An embedder is loaded once in each worker. It gets a list of sequences and gives the states of all their tokens; what
is not a residue is masked. Sequences are embedded once each, and only those that a cache does not have.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sequoria.functions import sequence as S
from sequoria.functions.plan import distinct_dealt, importable, sealed, stored

RING = "head_to_tail"


class Embedder(Protocol):
    """What an embedder has to offer; it is sent to the workers, so weights are loaded by `load`, not before."""

    #: Width of the vectors.
    size: int

    def load(self) -> None:
        """Gets ready on a worker; called once for each task."""

    def states(self, sequences: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """States (sequence, token, size) and which tokens are residues (sequence, token); shorter ones are padded."""


def planned(lengths: np.ndarray, most: int) -> list[np.ndarray]:
    """Places of sequences in batches of like lengths: a batch's longest sequence times their number is `most` tokens at
    most, a single sequence aside."""
    order, out, start = np.argsort(lengths, kind="stable"), [], 0
    for stop in range(1, len(order) + 1):
        if stop == len(order) or lengths[order[stop]] * (stop + 1 - start) > most:
            out.append(order[start:stop])
            start = stop
    return out


def pooled(states: np.ndarray, residues: np.ndarray) -> np.ndarray:
    """Mean state over the residues of each sequence; NaN for one without."""
    mask = residues[:, :, None].astype(np.float64)
    with np.errstate(invalid="ignore", divide="ignore"):
        return (states * mask).sum(axis=1) / mask.sum(axis=1)


def _vectors(embedder: Embedder, texts: list[str], tokens: int) -> np.ndarray:
    """The pooled vectors of the texts, in their order."""
    out = np.empty((len(texts), embedder.size))
    for part in planned(np.fromiter(map(len, texts), np.int64, len(texts)), tokens):
        vectors = pooled(*embedder.states([texts[i] for i in part]))
        if vectors.shape != (len(part), embedder.size):
            raise ValueError(f"the embedder gave {vectors.shape} for {len(part)} sequences of width {embedder.size}")
        out[part] = vectors
    return out


def _rows(keys: pa.Array, vectors: np.ndarray, name: str) -> pa.RecordBatch:
    offsets = pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * vectors.shape[1])
    return pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(offsets, pa.array(vectors.ravel()))], names=[name, "embedding"])


def _embedded(embedder: Embedder, tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embedder.load()
        for batch in batches:
            yield _rows(batch.column(0), _vectors(embedder, batch.column(0).to_pylist(), tokens), "seq")

    return run


#: Rings that a task turns at once; all their rotations are in memory.
UNITS = 512


def _turns(unit: str) -> list[str]:
    """What a unit is averaged over: all distinct rotations of a ring (`o` before it), else the sequence (`-`)."""
    text = unit[1:]
    return [text[i:] + text[:i] for i in range((text + text).index(text, 1))] if unit[0] == "o" else [text]


def _averaged(embedder: Embedder, tokens: int):
    """Means of the units' vectors, each made of rotations within its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embedder.load()
        for batch in batches:
            for start in range(0, batch.num_rows, UNITS):
                units = batch.column(0).slice(start, UNITS)
                turns = [_turns(u) for u in units.to_pylist()]
                counts = np.array([len(t) for t in turns])
                vectors = _vectors(embedder, [t for each in turns for t in each], tokens)
                yield _rows(units, np.add.reduceat(vectors, np.cumsum(counts) - counts) / counts[:, None], "_unit")

    return run


def embed(sequences: DataFrame, embedder: Embedder, cache: DataFrame | None = None, tokens: int = 16_384) -> DataFrame:
    """(seq, embedding) of the distinct seq of sequences; those of cache (seq, embedding) are taken from there."""
    importable(sequences.sparkSession)
    once = distinct_dealt(sequences.filter("seq is not null and seq <> ''"), "seq")
    if cache is None:
        return once.mapInArrow(_embedded(embedder, tokens), "seq string, embedding array<double>")
    once = stored(once, "sequences")
    missing = once.join(cache, "seq", "left_anti").mapInArrow(_embedded(embedder, tokens), "seq string, embedding array<double>")
    return cache.join(once, "seq", "left_semi").select("seq", F.col("embedding").cast("array<double>").alias("embedding")).unionByName(missing)


def embed_rows(rows: DataFrame, embedder: Embedder, cache: DataFrame | None = None, tokens: int = 16_384) -> DataFrame:
    """rows (seq, cyclization_type, ...) with `embedding`: of a head-to-tail ring the mean over all its distinct
    rotations, of anything else that of seq. Empty and null sequences get none.

    A mean is made once for each ring, whatever rotation it is given in. Rotations are made where they are embedded: two
    rings share none, so only rings are dealt out. Those that a cache has are looked up, which takes rows of rotations.
    """
    kind = S.cyclization_type(F.coalesce("cyclization_type", F.lit("")))
    keyed = sealed(rows.withColumn("_ring", (kind == RING) & (F.coalesce("seq", F.lit("")) != "")), *rows.columns, F.when(F.col("_ring"), F.concat(F.lit("o"), S.canonical(F.col("seq")))).otherwise(F.concat(F.lit("-"), "seq")).alias("_unit"))
    keyed = stored(keyed, "units")
    units = distinct_dealt(keyed.filter("_unit is not null and _unit <> '-'"), "_unit")
    if cache is None:
        importable(rows.sparkSession)
        means = units.mapInArrow(_averaged(embedder, tokens), "_unit string, embedding array<double>")
        return keyed.join(means, "_unit", "left").drop("_unit")
    bare = F.substring("_unit", 2, 1 << 20)
    turns = sealed(units, "_unit", F.when(F.col("_unit").startswith("o"), S.distinct_rotations(bare)).otherwise(F.array(bare)).alias("turns"))
    turns = stored(turns.select("_unit", F.explode("turns").alias("seq")), "rotations")
    vectors = embed(turns, embedder, cache, tokens)
    means = turns.join(vectors, "seq").groupBy("_unit").agg(F.array(*[F.avg(F.get("embedding", F.lit(i))) for i in range(embedder.size)]).alias("embedding"))
    return keyed.join(means, "_unit", "left").drop("_unit")


class LetterEmbedder:
    """A small embedder without weights: the states of a residue are its hydropathy, that times its place, and the share
    of its place; a start and an end token stand around, masked. For tests and as an example."""

    size = 3

    def load(self) -> None:
        self.value = np.zeros(128)
        for letter, v in S.HYDROPATHY.items():
            self.value[ord(letter)] = v

    def states(self, sequences: list[str]) -> tuple[np.ndarray, np.ndarray]:
        n = np.fromiter(map(len, sequences), np.int64, len(sequences))
        states, residues = np.full((len(n), int(n.max()) + 2, self.size), 1e6), np.zeros((len(n), int(n.max()) + 2), bool)
        residues[:, 1:-1] = np.arange(1, n.max() + 1) <= n[:, None]
        v = self.value[np.frombuffer("".join(sequences).encode("ascii"), np.uint8)]
        place = np.nonzero(residues)[1]
        states[residues] = np.stack([v, v * place, place / np.repeat(n, n)], axis=1)
        return states, residues
