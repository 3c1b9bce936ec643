"""Exact repeats of L bytes by merging Burrows-Wheeler transforms of shards.

All suffixes of a corpus can't be put in one order on one machine, so they are dealt to groups by content: of all
windows of L bytes, equal ones agree in their anchor, the least-hashed gram within (the leftmost of equals). The
neighbouring windows that share an anchor are one segment. Only segments whose anchor occurs twice can hold a repeat;
equal segments become one with a weight.

Groups of unlike segments are merged. Shards of at most SHARD segments are sorted by themselves, which gives each its
transform: the bytes before each suffix, in the suffixes' order, and the way from a suffix to the one before it. The
shards' orders are then interleaved by refinement: each round takes the suffixes in the present interleave, and puts
those before them in stable order of the two bytes in front. It begins with the suffixes behind a window, so that after
L / 2 rounds it has all windows, sorted by L bytes. A round also knows where neighbours first differ, which bounds their
common prefix; suffixes that stand alone in their interval have no repeat, nor have those before them, and take no part
in later rounds. Intervals that are left have a common prefix of L bytes: these are the repeats.

Groups of more than HOT unlike segments (a passage that very many texts share, each with its own neighbours) are split:
windows are dealt to two halves by the place of the anchor in them, each with a longer core that all its windows have in
common, as often as need be; at last the core is the window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, importable_on_workers, lean, materialize, mixed, small_side

#: Bytes of a repeat (even) and of an anchor's gram.
LENGTH, GRAM = 200, 64
#: Windows of a text that are looked at together, segments of a shard, bytes of segments merged together, and unlike
#: segments of a group that is not split.
BLOCK, SHARD, MERGED, HOT = 1 << 20, 250, 1 << 20, 256
#: Places of an anchor within a window.
PLACES = LENGTH - GRAM + 1
_LOW = np.uint64((1 << 26) - 1)
_BASE = 0x9E3779B97F4A7C15
SEGMENTED = "row long, doc_id long, n_bytes long, text string, sha string, h array<long>, x array<long>, s array<int>, e array<int>, a array<int>"
RANGES = "array<struct<i:int,j:int>>"


class Powers:
    """Powers of the base of the rolling hash and of its inverse."""

    def __init__(self, n: int):
        with np.errstate(over="ignore"):
            self.up, self.down = np.ones(n, np.uint64), np.ones(n, np.uint64)
            self.up[1:] = np.multiply.accumulate(np.full(n - 1, _BASE, np.uint64))
            self.down[1:] = np.multiply.accumulate(np.full(n - 1, pow(_BASE, -1, 1 << 64), np.uint64))


_POWERS: list[Powers] = []


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last window start, anchor's place and anchor's hash of each segment of at most BLOCK windows."""
    if not _POWERS:
        _POWERS.append(Powers(BLOCK + LENGTH))
    n = len(text)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1)) * _POWERS[0].up[:n], out=sums[1:])
        grams = mixed((sums[GRAM:] - sums[: n - GRAM + 1]) * _POWERS[0].down[: n - GRAM + 1])
    m = len(grams)
    key = np.full(m + -m % PLACES, np.iinfo(np.uint64).max, np.uint64)
    key[:m] = (grams & ~_LOW) | np.arange(m, dtype=np.uint64)
    key = key.reshape(-1, PLACES)
    windows = n - LENGTH + 1
    upto = np.minimum.accumulate(key, axis=1).ravel()[PLACES - 1 : PLACES - 1 + windows]
    since = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].ravel()[:windows]
    at = (np.minimum(upto, since) & _LOW).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return first, np.append(first[1:], windows) - 1, at[first], grams[at[first]]


def segments(text: bytes) -> tuple[np.ndarray, ...]:
    """Hash of the anchor, hash of the segment's bytes, first and last window start and anchor's place of all segments."""
    parts, n = [], len(text)
    for begin in range(0, max(n - LENGTH + 1, 0), BLOCK):
        piece = text[begin : begin + BLOCK + LENGTH - 1]
        s, e, a, h = anchors(piece)
        view = memoryview(piece)
        x = np.fromiter((xxhash.xxh3_64_intdigest(view[i:j]) for i, j in zip(s.tolist(), (e + LENGTH).tolist(), strict=True)), np.uint64, len(s))
        parts.append((h.view(np.int64), x.view(np.int64), s + begin, e + begin, a + begin))
    if not parts:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _segmented(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            texts = [t or b"" for t in part.column(2).cast(pa.binary()).to_pylist()]
            found = [segments(t) for t in texts]
            offsets = pa.array(np.cumsum([0] + [len(f[0]) for f in found]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([f[c] for f in found]).astype(np.int64 if c < 2 else np.int32))) for c in range(5)]
            sizes, sha = pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), sizes, part.column(2), sha, *lists], names=["row", "doc_id", "n_bytes", "text", "sha", "h", "x", "s", "e", "a"])


def sorted_shard(symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Order of all suffixes of a shard by LENGTH symbols and more. symbols: the segments' bytes, each closed by an end mark;
    ends: places of the marks, which are unlike each other, and come in their order before all bytes."""
    n, m = len(symbols), len(ends)
    rank = symbols.astype(np.int64) + m
    rank[ends] = np.arange(m)
    base, span = m + 256, 1
    while base ** (span + 1) < 1 << 62 and span < 8:
        span += 1
    padded, key = np.concatenate([rank, np.zeros(span, np.int64)]), np.zeros(n, np.int64)
    for i in range(span):
        key = key * base + padded[i : i + n]
    while True:
        order = np.argsort(key)
        held = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], held[1:] != held[:-1]]))
        if span >= LENGTH:
            return order
        after = np.zeros(n, np.int64)
        after[: n - span] = rank[span:] if span < n else 0
        key, span = rank * (n + 1) + after, span * 2


def merged_repeats(texts: list[bytes]) -> list[np.ndarray]:
    """For each text the window starts whose LENGTH bytes also start at another place of these texts."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(lengths + 1) - lengths - 1
    symbols = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    n, ends = len(symbols), starts + lengths
    # transforms of the shards, one after another: suffixes in order, what stands before them, and the way there
    place = np.empty(n, np.int64)
    for k in range(0, len(texts), SHARD):
        a, b = starts[k], ends[min(k + SHARD, len(texts)) - 1] + 1
        place[a:b] = a + sorted_shard(symbols[a:b], ends[k : k + SHARD] - a)
    index = np.empty(n, np.int32)
    index[place] = np.arange(n, dtype=np.int32)
    two = np.zeros(n, np.uint16)
    two[2:] = symbols[:-2].astype(np.uint16) << np.uint16(8) | symbols[1:-1]
    two, before = two[place], index[np.maximum(place - 2, 0)]
    # the interleave: at first what is behind each window, the shards in turn, with nothing known in common; as many
    # rounds as lead to the windows never leave a segment
    offset = np.arange(n) - np.repeat(starts, lengths + 1)
    order = np.flatnonzero(offset[place] >= LENGTH).astype(np.int32)
    interval = np.zeros(len(order), np.int32)
    for _ in range(LENGTH // 2):
        if not len(order):
            break
        symbol = two[order]
        by = np.argsort(symbol, kind="stable")
        symbol, interval, order = symbol[by], interval[by], before[order[by]]
        order, interval = _shared(order, np.concatenate([[True], (symbol[1:] != symbol[:-1]) | (interval[1:] != interval[:-1])]))
    at = np.sort(place[order])
    owner = np.searchsorted(ends, at)
    cut = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [at[cut[k] : cut[k + 1]] - starts[k] for k in range(len(texts))]


def _shared(order: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes whose interval has others too, and their intervals' numbers; new: where intervals begin."""
    last = np.append(new[1:], True)
    keep = ~(new & last)
    if keep.all():
        return order, np.cumsum(new, dtype=np.int32)
    return order[keep], np.cumsum(new, dtype=np.int32)[keep]


def ranges(starts: np.ndarray) -> list[dict[str, int]]:
    """Ascending numbers as runs from i to j."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) != 1)
    first, last = np.append(starts[0], starts[cut + 1]), np.append(starts[cut], starts[-1])
    return [{"i": int(i), "j": int(j)} for i, j in zip(first, last, strict=True)]


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, x, text) sorted by g in, (g, x, ranges of repeated window starts) out; groups are kept together."""
    schema = pa.schema([("g", pa.int64()), ("x", pa.int64()), ("ranges", pa.list_(pa.struct([("i", pa.int32()), ("j", pa.int32())])))])
    held: list[tuple] = []
    size, last = 0, None

    def out() -> pa.RecordBatch:
        found = merged_repeats([t for _, _, t in held])
        return pa.RecordBatch.from_arrays([pa.array([g for g, _, _ in held], pa.int64()), pa.array([x for _, x, _ in held], pa.int64()), pa.array([ranges(f) for f in found], schema.field(2).type)], schema=schema)

    for batch in batches:
        for g, x, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if size > MERGED and g != last:
                yield out()
                held, size = [], 0
            held.append((g, x, text))
            size, last = size + len(text), g
    if held:
        yield out()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, s, e, a, picks array of (g, x, k, n)) in, (g, x, n, at, text) out: the segments' bytes, and the anchor in them."""
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            g, x, n, at, cut = [], [], [], [], []
            for text, s, e, a, picks in zip(part.column(0).cast(pa.binary()).to_pylist(), *(part.column(c).to_pylist() for c in range(1, 5)), strict=True):
                for p in picks:
                    k = p["k"]
                    g.append(p["g"]), x.append(p["x"]), n.append(p["n"]), at.append(a[k] - s[k]), cut.append(text[s[k] : e[k] + LENGTH])
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(x, pa.int64()), pa.array(n, pa.int64()), pa.array(at, pa.int32()), pa.array(cut, pa.binary())], names=["g", "x", "n", "at", "text"])


def _halved(lo: int, hi: int):
    """(g, x, n, at, text) of segments whose anchors stand lo to hi bytes into their windows, dealt to two halves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["g", "x", "i", "lo", "hi", "cg", "cx", "n", "at", "text"]
        for batch in batches:
            rows = []
            for g, x, n, at, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                last = len(text) - LENGTH
                for a, b in ((lo, (lo + hi) // 2), ((lo + hi) // 2 + 1, hi)):
                    i, j = max(0, at - b), min(last, at - a)
                    if i <= j and a <= b:
                        core, part = text[at - a : at - b + LENGTH], text[i : j + LENGTH]
                        key = xxhash.xxh3_64_intdigest(core, a * 1000 + b) ^ (g & (2**64 - 1))
                        rows.append((g, x, i, a, b, key - 2**64 if key >> 63 else key, xxhash.xxh3_64_intdigest(part) - 2**63, n, at - i, part))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 10, [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()], strict=True)], names=names)

    return run


def repeats(items: DataFrame, keys: DataFrame, lo: int = 0, hi: int = PLACES - 1, hot: int = HOT) -> DataFrame:
    """(g, x, ranges): the repeated window starts of those segments of items (g, x, n, at, text) that stand once (n = 1).

    Rows of one g share an anchor that stands lo to hi bytes into their windows; x tells unlike segments apart, n is how
    often one stands there. Segments with n > 1 are repeats as they are, and only serve as partners. keys: g of items
    with `c`, how many unlike segments it has; those with one are not in it.
    """
    few = items.join(small_side(keys.filter(F.col("c") <= hot)), "g").select("g", "x", "text").repartition("g").sortWithinPartitions("g", "x")
    found = few.mapInArrow(lean(_merged), f"g long, x long, ranges {RANGES}")
    many = keys.filter(F.col("c") > hot)
    if many.isEmpty():
        return found
    found = materialize(found, "merged")
    many = items.join(small_side(many), "g").select("g", "x", "n", "at", "text")
    halves = materialize(many.mapInArrow(lean(_halved(lo, hi)), "g long, x long, i int, lo int, hi int, cg long, cx long, n long, at int, text binary"), "halves")
    for a, b in ((lo, (lo + hi) // 2), ((lo + hi) // 2 + 1, hi)):
        half = halves.filter((F.col("lo") == a) & (F.col("hi") == b))
        like = materialize(half.groupBy("cg", "cx").agg(F.sum("n").alias("n"), F.min("at").alias("at"), F.min("text").alias("text")).withColumnsRenamed({"cg": "g", "cx": "x"}), "halved")
        inside = repeats(like, unlike(like), a, b, hot).select(F.col("g").alias("cg"), F.col("x").alias("cx"), "ranges")
        whole = like.filter("n > 1").select(F.col("g").alias("cg"), F.col("x").alias("cx"), F.array(F.struct(F.lit(0).alias("i"), (F.length("text") - LENGTH).cast("int").alias("j"))).alias("ranges"))
        known = inside.join(whole.select("cg", "cx"), ["cg", "cx"], "left_anti").unionByName(whole)
        back = half.select("g", "x", "i", "cg", "cx").join(known, ["cg", "cx"])
        moved = back.select("g", "x", F.transform("ranges", lambda r: F.struct((r.i + F.col("i")).alias("i"), (r.j + F.col("i")).alias("j"))).alias("ranges"))
        found = found.unionByName(moved)
    return materialize(found.groupBy("g", "x").agg(F.flatten(F.collect_list("ranges")).alias("ranges")), "found")


def unlike(like: DataFrame) -> DataFrame:
    """(g, c): groups of more than one unlike segment, and how many. like: a row (g, x) for each."""
    return materialize(like.groupBy("g").agg(F.count("*").alias("c")).filter("c > 1"), "unlike")


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, s, e, picks array of (k, ranges or null for all)) in, the result of each text out."""
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            n, gone, runs, sha = [], [], [], []
            for text, s, e, picks in zip(part.column(1).cast(pa.binary()).to_pylist(), *(part.column(c).to_pylist() for c in (2, 3, 4)), strict=True):
                edge = np.zeros(len(text) + 1, np.int32)
                for p in picks:
                    begin = s[p["k"]]
                    for i, j in [(0, e[p["k"]] - begin)] if p["ranges"] is None else [(r["i"], r["j"]) for r in p["ranges"]]:
                        edge[begin + i] += 1
                        edge[begin + j + LENGTH] -= 1
                out = np.cumsum(edge[:-1]) > 0
                left = np.frombuffer(text, np.uint8)[~out].tobytes()
                n.append(len(text)), gone.append(len(text) - len(left)), sha.append(hashlib.sha256(left).hexdigest())
                runs.append(int(np.count_nonzero(np.diff(np.concatenate([[0], out.view(np.int8)])) == 1)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of docs (doc_id, text).

    Each byte of a string of LENGTH bytes that starts anywhere else too, in this text or another, is removed; what is
    left is not looked at again. A null text is an empty one; shorter texts stay whole; repeated rows remove each other.
    An empty table gives no rows; other columns are ignored. Equal segments are told by two 64-bit hashes (anchor,
    bytes): of a million unlike segments with one anchor, two are taken for equal with a chance of 3e-8.
    """
    importable_on_workers(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = materialize(rows.mapInArrow(lean(_segmented), SEGMENTED), "segmented", "zstd")
    each = rows.filter(F.size("h") > 0).select("row", F.posexplode(F.arrays_zip("h", "x")).alias("k", "z")).select("row", "k", "z.h", "z.x")
    twice = materialize(each.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1").select("h"), "twice")
    met = materialize(each.join(twice, "h"), "met")
    like = materialize(met.groupBy("h", "x").agg(F.count("*").alias("n"), F.min(F.struct("row", "k")).alias("at")).select(F.col("h").alias("g"), "x", "n", "at.row", "at.k"), "like")
    # unlike segments under one anchor are merged; the bytes of each come from one text
    keys = unlike(like)
    wanted = materialize(like.join(small_side(keys), "g").select("row", "g", "x", "k", "n"), "wanted")
    picks = wanted.groupBy("row").agg(F.collect_list(F.struct("g", "x", "k", "n")).alias("picks"))
    picks = F.broadcast(picks) if wanted.count() <= BROADCAST_ROWS else picks
    items = rows.select("row", "text", "s", "e", "a").join(picks, "row").select("text", "s", "e", "a", "picks").mapInArrow(lean(_cut), "g long, x long, n long, at int, text binary")
    found = repeats(items, keys, hot=hot).filter(F.size("ranges") > 0)
    once = like.filter("n = 1").join(found, ["g", "x"]).select("row", "k", "ranges")
    all_ = met.join(like.filter("n > 1").select(F.col("g").alias("h"), "x"), ["h", "x"]).select("row", "k", F.lit(None).cast(RANGES).alias("ranges"))
    gone = once.unionByName(all_).groupBy("row").agg(F.collect_list(F.struct("k", "ranges")).alias("picks"))
    gone = materialize(gone, "gone")
    # texts that stay as they are need not be dealt
    changed = rows.select("row", "doc_id", "text", "s", "e").join(small_side(gone.select(F.col("row").alias("row"))), "row", "left_semi").join(gone, "row")
    changed = changed.select("doc_id", "text", "s", "e", "picks").mapInArrow(lean(_kept), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    zero = F.lit(0).cast("long")
    same = rows.select("row", "doc_id", "n_bytes", "sha").join(small_side(gone.select("row")), "row", "left_anti").select("doc_id", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), F.col("sha").alias("kept_sha256"))
    return changed.unionByName(same)
