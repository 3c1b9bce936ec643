"""Near-duplicate documents by HyperMinHash registers, banding and exact verification.

Each document's register i holds, for hash function i, the leading-zero count of its least shingle hash and the next
MANTISSA bits: 16 bits that stand for 64. Bands of registers propose pairs; the share of equal registers, corrected
for chance collisions, drops those that are surely too far apart; what is left is verified on full shingle sets.

Exact copies (equal sets) are one class from the start. Within a band's bucket a text is first verified against its
likeliest partner only; a second round then verifies, in blocks, just the members that those links left in different
components. So a bucket of m like texts costs about m verifications, and none of its links is skipped that could join
two components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import importable_on_workers, lean, materialize, mixed, shingle_hashes, small_side
from .components import connected_components

REGISTERS, MANTISSA, ROWS = 64, 10, 4
BANDS = REGISTERS // ROWS
#: Chance that two unrelated registers agree, for sets of like size.
COLLISION = 0.1699 / 2**MANTISSA
#: Members of a bucket that meet in one task; larger buckets are dealt out as pairs of blocks.
BLOCK = 2048
_FACTORS = mixed(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
SKETCH = "doc_id long, n_shingles long, class_a long, class_b long, registers binary, bands array<long>"


def registers(hashes: np.ndarray) -> np.ndarray:
    """REGISTERS 16-bit registers of a non-empty set of 64-bit hashes."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(hashes), 4096):
            least = np.minimum(least, (_FACTORS[:, None] * hashes[None, i : i + 4096]).min(axis=1))
    zeros = np.empty(REGISTERS, np.uint64)
    for i, x in enumerate(least.tolist()):
        zeros[i] = 64 - x.bit_length()
    below = np.where(zeros < 63, least << np.minimum(zeros + np.uint64(1), np.uint64(63)), np.uint64(0))
    return ((zeros << np.uint64(MANTISSA)) | (below >> np.uint64(64 - MANTISSA))).astype(np.uint16)


def estimate(equal: np.ndarray) -> np.ndarray:
    """Jaccard estimate from numbers of equal registers, without the expected chance collisions."""
    return np.clip((equal / REGISTERS - COLLISION) / (1 - COLLISION), 0, 1)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    salts = mixed(np.arange(1, BANDS + 1, dtype=np.uint64))
    for batch in batches:
        n, ka, kb, regs, bands = [], [], [], [], []
        for text in batch.column(1).cast(pa.binary()).to_pylist():
            h = shingle_hashes(text)
            n.append(len(h))
            if not len(h):
                ka.append(None), kb.append(None), regs.append(None), bands.append(None)
                continue
            with np.errstate(over="ignore"):
                ka.append(int(mixed(h).sum().astype(np.int64)))
                kb.append(int(np.bitwise_xor.reduce(mixed(h ^ np.uint64(0x5851F42D4C957F2D)) * np.uint64(3)).astype(np.int64)))
                r = registers(h)
                regs.append(r.tobytes())
                bands.append(mixed(np.ascontiguousarray(r).view(np.uint64) ^ salts).astype(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ka, pa.int64()), pa.array(kb, pa.int64()), pa.array(regs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "class_a", "class_b", "registers", "bands"])


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in; set size, class key of the whole set, registers and band keys out. No set: nulls."""
    importable_on_workers(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(_sketch), SKETCH)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[list]]:
    """Runs of rows with equal first `keys` columns, as lists of columns; rows come sorted by them."""
    held: list[list] | None = None
    for batch in batches:
        cols = [c.to_pylist() for c in batch.columns]
        if not cols or not cols[0]:
            continue
        marks = list(zip(*cols[:keys], strict=True))
        start = 0
        for i in range(1, len(marks) + 1):
            if i < len(marks) and marks[i] == marks[start]:
                continue
            part = [c[start:i] for c in cols]
            if held and tuple(c[0] for c in held[:keys]) == marks[start]:
                for a, b in zip(held, part, strict=True):
                    a.extend(b)
            else:
                if held:
                    yield held
                held = part
            start = i
    if held:
        yield held


def _likely(regs: np.ndarray, n: np.ndarray, i0: int, i1: int, num: int, den: int, cut: float) -> tuple[np.ndarray, np.ndarray]:
    """Equal registers of members i0..i1 with all, and which of those may reach the threshold."""
    equal = np.zeros((i1 - i0, len(regs)), np.uint8)
    for k in range(REGISTERS):
        equal += regs[i0:i1, k, None] == regs[None, :, k]
    a, b = n[i0:i1, None], n[None, :]
    may = (estimate(equal) >= cut) & (np.minimum(a, b) * den >= np.maximum(a, b) * num)
    may[np.arange(i1 - i0), np.arange(i0, i1)] = False
    return equal, may


def _best_partner(num: int, den: int, cut: float, sure: float):
    """For each member of a bucket one partner: the least id that is surely a link, else the likeliest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, rep, n, raw in _groups(batches, 3):
            if len(rep) < 2:
                continue
            regs, n, ids = np.frombuffer(b"".join(raw), np.uint16).reshape(len(rep), REGISTERS), np.asarray(n), np.asarray(rep)
            by_id = np.argsort(ids, kind="stable")
            regs, n, ids = regs[by_id], n[by_id], ids[by_id]
            out = []
            for i0 in range(0, len(ids), 256):
                i1 = min(i0 + 256, len(ids))
                equal, may = _likely(regs, n, i0, i1, num, den, cut)
                equal = np.where(may, equal, 0)
                safe = may & (estimate(equal) >= sure)
                some = safe.any(axis=1)
                j = np.where(some, safe.argmax(axis=1), equal.argmax(axis=1))
                at = np.arange(i1 - i0)
                ok = may[at, j] & (ids[i0:i1] != ids[j])
                out.append((ids[i0:i1][ok], ids[j][ok], np.where(some, REGISTERS + 1, equal[at, j])[ok]))
            cols = [np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True)]
            if len(cols[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["a", "b", "rank"])

    return run


def _open_members(num: int, den: int, cut: float):
    """What the links so far leave open in a bucket: its few likely pairs across components, as rows with other; where
    those outnumber the members, the members, to be verified together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "lo", "hi", "rep", "comp", "other"]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        for key, lo, hi, rep, n, raw, comp in _groups(batches, 3):
            if len(set(comp)) < 2:
                continue
            regs, n, comps, ids = np.frombuffer(b"".join(raw), np.uint16).reshape(len(rep), REGISTERS), np.asarray(n), np.asarray(comp), np.asarray(rep)
            keep, pairs, count = np.zeros(len(rep), bool), [], 0
            for i0 in range(0, len(rep), 256):
                i1 = min(i0 + 256, len(rep))
                _, may = _likely(regs, n, i0, i1, num, den, cut)
                may &= comps[i0:i1, None] != comps[None, :]
                keep[i0:i1] = may.any(axis=1)
                count += int(may.sum())
                if count <= 2 * len(rep):
                    i, j = np.nonzero(may)
                    pairs.append((i + i0, j))
            if count <= 2 * len(rep):
                i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
                i, j = i[ids[i] < ids[j]], j[ids[i] < ids[j]]
                cols = [[None] * len(i)] * 3 + [ids[i], [None] * len(i), ids[j]]
            else:
                k = np.flatnonzero(keep)
                cols = [[key[0]] * len(k), [lo[0]] * len(k), [hi[0]] * len(k), ids[k], comps[k], [None] * len(k)]
            if len(cols[3]):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types, strict=True)], names=names)

    return run


def _verify(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ta, tb = batch.column(2).cast(pa.binary()), batch.column(3).cast(pa.binary())
            ok = []
            for i in range(len(a)):
                if a[i] != last:
                    last, held = a[i], shingle_hashes(ta[i].as_py())
                other = shingle_hashes(tb[i].as_py())
                both = len(np.intersect1d(held, other, assume_unique=True))
                ok.append(den * both >= num * (len(held) + len(other) - both) and both > 0)
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return run


def block_links(sets: list[np.ndarray], comp: list[int], num: int, den: int) -> list[tuple[int, int]]:
    """Pairs of positions whose exact Jaccard reaches num/den and that join two components, a spanning set of them."""
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(ids, kind="stable")
    owners = owner[order]
    start = np.concatenate([[0], np.cumsum(np.bincount(ids))])
    first = np.concatenate([[0], np.cumsum(size)])
    root = {c: c for c in comp}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i in range(len(sets)):
        mine = ids[first[i] : first[i + 1]]
        lens = start[mine + 1] - start[mine]
        at = np.repeat(start[mine] - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(lens.sum())
        both = np.bincount(owners[at], minlength=len(sets))
        for j in np.flatnonzero(den * both >= num * (size + size[i] - both)).tolist():
            if j > i and (x := find(comp[i])) != (y := find(comp[j])):
                root[max(x, y)] = min(x, y)
                out.append((i, j))
    return out


def _block_links(num: int, den: int):
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # texts become hashes at once, one row at a time
            sets = [shingle_hashes(x.as_py()).tobytes() for x in batch.column(5).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sets, pa.large_binary())], names=batch.schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, rep, comp, raw in _groups(hashed(batches), 3):
            links = block_links([np.frombuffer(x, np.uint64) for x in raw], comp, num, den)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([comp[i] for i, _ in links], pa.int64()), pa.array([comp[j] for _, j in links], pa.int64())], names=["a", "b"])

    return run


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """One text for each of the ids; of several rows with one id, the least text."""
    ids = materialize(ids.distinct(), "ids")
    return docs.join(small_side(ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))


def _verified(docs: DataFrame, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """The (a, b) pairs that are links on full sets; each pair is verified once."""
    pairs = materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    texts = materialize(_texts(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))), "texts")
    both = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return materialize(both.select("a", "b", "text_a", "text_b").mapInArrow(lean(_verify(num, den)), "a long, b long"), "links")


def near_duplicates(docs: DataFrame, numerator: int = 85, denominator: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs (doc_id, text; other columns are ignored).

    Two documents are linked if denominator * |A and B| >= numerator * |A or B| on their 5-word shingle sets.
    Null, empty or blank texts have an empty set, link with nothing and are kept. Repeated rows share a component.
    Rows that share a doc_id
    share a component; texts that differ under one doc_id are judged by the least of them. A row without doc_id gets its class's
    component, if that has one, and kept false. An empty table gives no rows.

    A pair at the threshold 0.85 shares none of the 16 bands with a chance of 7e-6 (at 0.80: 2e-4), less above it. Pairs whose
    estimate lies 4.5 standard deviations under the threshold are not verified.
    """
    threshold = numerator / denominator
    cut = threshold - 4.5 * (threshold * (1 - threshold) / REGISTERS) ** 0.5
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = materialize(sketches(docs), "sketch")
    classes = materialize(
        sketch.filter("class_a is not null and doc_id is not null").groupBy("class_a", "class_b").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers"), F.first("bands").alias("bands")),
        "classes",
    )
    banded = classes.select("rep", F.explode("bands").alias("key"))
    counted = banded.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("size") / BLOCK)).cast("int")
    met = banded.join(counted, "key").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "rep")
    members = materialize(met.join(classes.select("rep", "n", "registers"), "rep").select("key", "lo", "hi", "rep", "n", "registers"), "members")

    def by_bucket(df: DataFrame) -> DataFrame:
        return df.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")

    sure = min(1.0, threshold + 2 * (threshold * (1 - threshold) / REGISTERS) ** 0.5)
    found = by_bucket(members).mapInArrow(lean(_best_partner(numerator, denominator, cut, sure)), "a long, b long, rank long")
    # one partner for each text, over all its buckets: a hub where one is sure, else the likeliest
    found = found.groupBy("a").agg(F.min_by("b", F.struct(-F.col("rank"), F.col("b"))).alias("b"))
    first = materialize(connected_components(_verified(docs, found, numerator, denominator)), "components")
    held = members.join(first.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")
    mixed_keys = held.groupBy("key", "lo", "hi").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("key", "lo", "hi")
    still = by_bucket(held.join(mixed_keys, ["key", "lo", "hi"]).select("key", "lo", "hi", "rep", "n", "registers", "comp"))
    still = materialize(still.mapInArrow(lean(_open_members(numerator, denominator, cut)), "key long, lo int, hi int, rep long, comp long, other long"), "open")
    crowds = still.filter("other is null")
    more = _texts(docs, crowds.select(F.col("rep").alias("doc_id"))).withColumnRenamed("doc_id", "rep")
    late = by_bucket(crowds.join(more, "rep").select("key", "lo", "hi", "rep", "comp", "text")).mapInArrow(lean(_block_links(numerator, denominator)), "a long, b long")
    pairs = still.filter("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b"))
    for end in ("a", "b"):
        step = first.select(F.col("node").alias(end), "component")
        pairs = pairs if end == "b" else _verified(docs, pairs, numerator, denominator)
        pairs = pairs.join(step, end, "left").withColumn(end, F.coalesce("component", end)).drop("component")
    second = connected_components(late.union(pairs.select("a", "b")))
    label = classes.select("class_a", "class_b", "rep").join(first.withColumnRenamed("node", "rep"), "rep", "left").withColumn("c", F.coalesce("component", "rep")).select("class_a", "class_b", "c")
    label = label.join(second.select(F.col("node").alias("c"), F.col("component").alias("d")), "c", "left").select("class_a", "class_b", F.coalesce("d", "c").alias("component"))
    out = sketch.select("doc_id", "n_shingles", "class_a", "class_b").join(label, ["class_a", "class_b"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
