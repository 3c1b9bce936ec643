"""Language-model scores by prediction by partial matching over bytes.

A trie of byte contexts up to ORDER is counted over all training documents. A byte that a context has not seen escapes
to the next shorter one; the escape is estimated from the number of distinct successors (method C), and the symbols
that the longer context had are excluded there. The pretrained code length of a text is the sum over its bytes and its
end. A unigram base with add-one counts is computed beside it.

The trie is never cut: it stands in tables, and the cost of each distinct gram that any row holds is computed there once.
What a worker holds is bounded: the costs of the MODEL_GRAMS most frequent grams at most, and FREQUENT_WORDS words; all
other grams and words are looked up by a join, so the bounds do not change the results.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, importable_on_workers, lean, materialize, small_side, words

ORDER = 4
MODEL_GRAMS, FREQUENT_WORDS = 2**19, 300_000
#: The end of a text and what stands before its start; no word holds a line feed.
END = b"\n"
#: Bytes that are handled at a time (a longer text is handled in slices, with the bytes before each as its context), and
#: distinct grams that a task gathers before it passes them on.
BLOCK_BYTES, GATHERED = 1_000_000, 1_000_000


def canonical(text: bytes | None) -> bytes:
    """The text's words in lower case (A-Z) with one space between; this is what both models score."""
    return b" ".join(text.lower().split()) if text else b""


def grams(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of ORDER context bytes and the byte that follows, for each byte of the pieces after their first ORDER
    ones, which are only context; and the piece that each belongs to."""
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    size = np.array([len(t) - ORDER for t in pieces])
    owner = np.repeat(np.arange(len(pieces), dtype=np.int32), size)
    at = np.arange(len(owner)) + ORDER * (owner + 1)
    code = np.zeros(len(at), np.int64)
    for k in range(ORDER + 1):
        code |= np.left_shift(raw[at - k], 8 * k, dtype=np.int64)
    return code, owner


def sliced(texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Pieces of at most BLOCK_BYTES in all and the text that each is of: context, then text or a part of it; the last
    one of a text has its end."""
    owners, pieces, total = [], [], 0
    for k, text in enumerate(texts):
        whole = END * ORDER + text + END
        for at in range(0, len(text) + 1, BLOCK_BYTES):
            piece = whole[at : at + ORDER + BLOCK_BYTES]
            if pieces and total + len(piece) > BLOCK_BYTES + ORDER:
                yield owners, pieces
                owners, pieces, total = [], [], 0
            owners.append(k), pieces.append(piece)
            total += len(piece)
    if pieces:
        yield owners, pieces


def _canonical(column: pa.Array) -> list[bytes]:
    return [canonical(x.as_py()) for x in column.cast(pa.binary())]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (text, held_out): each code, how often it stands in training rows, and in all rows."""
    codes, counts = np.empty(0, np.int64), np.empty((2, 0), np.int64)
    for batch in (whole.slice(i, 256) for whole in batches for i in range(0, whole.num_rows, 256)):
        held_out = batch.column(1)
        for learned, part in ((1, batch.column(0).filter(pc.invert(held_out))), (0, batch.column(0).filter(held_out))):
            for _, pieces in sliced(_canonical(part)):
                c, n = np.unique(grams(pieces)[0], return_counts=True)
                codes, inverse = np.unique(np.concatenate([codes, c]), return_inverse=True)
                counts = np.stack([np.bincount(inverse, np.concatenate([old, n * by])) for old, by in zip(counts, (learned, 1), strict=True)]).astype(np.int64)
                if len(codes) > GATHERED:
                    yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts[0]), pa.array(counts[1])], names=["code", "n", "times"])
                    codes, counts = codes[:0], counts[:, :0]
    if len(codes):
        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts[0]), pa.array(counts[1])], names=["code", "n", "times"])


class Index:
    """Open-addressed table from 64-bit keys to their positions, looked up for many at once."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 2 + 1))))
        self.keys, self.at = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        rest, pos = keys.astype(np.int64), np.arange(len(keys), dtype=np.int32)
        slot = self._slot(rest)
        while len(rest):
            free = np.flatnonzero(self.keys[slot] == -1)
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.at[slot[put]] = rest[put], pos[put]
            keep = np.ones(len(rest), bool)
            keep[put] = False
            rest, pos, slot = rest[keep], pos[keep], (slot[keep] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, -1 where it is not held."""
        slot = self._slot(keys)
        got = self.keys[slot]
        out = np.where(got == keys, self.at[slot], -1)
        open_ = np.flatnonzero((got != keys) & (got != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            got = self.keys[slot[open_]]
            hit = got == keys[open_]
            out[open_[hit]] = self.at[slot[open_[hit]]]
            open_ = open_[~hit & (got != -1)]
        return out


def _suffix(code: Column, size: int) -> Column:
    """The last `size` bytes of a code."""
    return code.bitwiseAND(F.lit((1 << (8 * size)) - 1))


def gram_costs(docs: DataFrame) -> DataFrame:
    """(code, times, cost): every distinct gram of the longest order in docs (text, held_out), how often it occurs, and
    the base-10 logarithm of its probability by the trie of all training rows.

    The trie is tables: the grams of each order with their counts, and of each context the sum of them (n), their
    number (d) and the counts that its successors have one order below (taken). No order is cut. Codes that training
    rows hold need the longest order only; the others walk down the orders, a join with each.
    """
    importable_on_workers(docs.sparkSession)
    found = docs.select("text", F.coalesce("held_out", F.lit(True)).alias("held_out")).mapInArrow(lean(_counted), "code long, n long, times long")
    all_codes = materialize(found.groupBy("code").agg(F.sum("n").alias("n"), F.sum("times").alias("times")), "codes")
    levels = {ORDER: materialize(all_codes.filter("n > 0").select("code", "n"), "grams")}
    for k in range(ORDER - 1, -1, -1):
        levels[k] = materialize(levels[k + 1].groupBy(_suffix(F.col("code"), k + 1).alias("code")).agg(F.sum("n").alias("n")), "grams")
    contexts = {}
    for k, df in levels.items():
        below = F.lit(0).cast("long").alias("below")
        if k:
            lower = levels[k - 1].select(F.col("code").alias("lower"), F.col("n").alias("below"))
            df, below = df.withColumn("lower", _suffix(F.col("code"), k)).join(small_side(lower), "lower"), F.col("below")
        df = df.select(F.shiftright("code", 8).alias("ctx"), "n", below)
        contexts[k] = materialize(df.groupBy("ctx").agg(F.sum("n").alias("n"), F.count("*").alias("d"), F.sum("below").alias("taken")), "contexts")
    top = contexts[ORDER].select("ctx", (F.col("n") + F.col("d")).alias("all"))
    seen = all_codes.filter("n > 0").withColumn("ctx", F.shiftright("code", 8)).join(small_side(top), "ctx")
    seen = seen.select("code", "times", (F.log10("n") - F.log10("all")).alias("cost"))
    zero = F.lit(0).cast("long")
    # nx, dx: what the context above took of n and d; total: the logarithms so far; hit: the symbol was found
    open_ = all_codes.filter("n = 0").select("code", "times", F.lit(0.0).alias("total"), F.lit(False).alias("hit"), zero.alias("nx"), zero.alias("dx"))
    for k in range(ORDER, -1, -1):
        here = contexts[k].select(F.col("ctx"), F.col("n").alias("cn"), F.col("d").alias("cd"), "taken")
        open_ = open_.withColumn("ctx", _suffix(F.shiftright("code", 8), k)).join(small_side(here), "ctx", "left")
        if k == ORDER:
            open_ = open_.withColumn("g", F.lit(None).cast("long"))  # no training row holds them
        else:
            got = levels[k].select(F.col("code").alias("gram"), F.col("n").alias("g"))
            open_ = open_.withColumn("gram", _suffix(F.col("code"), k + 1)).join(small_side(got), "gram", "left")
        n, d = F.col("cn") - F.col("nx"), F.col("cd") - F.col("dx")
        step = F.when(F.col("hit"), 0.0).when(F.col("g").isNotNull(), F.log10("g") - F.log10(n + d)).when(d > 0, F.log10(d) - F.log10(n + d)).otherwise(0.0)
        open_ = open_.select("code", "times", (F.col("total") + step).alias("total"), (F.col("hit") | F.col("g").isNotNull()).alias("hit"), F.coalesce("taken", zero).alias("nx"), F.coalesce("cd", zero).alias("dx"))
    none = F.log10(F.greatest(F.lit(256) - F.col("dx"), F.lit(1)))  # dx: the distinct bytes of all training rows
    return materialize(seen.union(open_.select("code", "times", F.when(F.col("hit"), F.col("total")).otherwise(F.col("total") - none))), "costs")


def most_frequent(df: DataFrame, by: str, most: int) -> int:
    """A bound on the whole-number column `by` that at most `most` rows of df reach."""
    held = 0
    for q, n in sorted(df.groupBy(F.floor(F.log2(by) * 4).alias("q")).count().collect(), reverse=True):
        held += n
        if held > most:
            return int(np.ceil(2 ** ((q + 1) / 4)))
    return 1


_MODELS: dict[str, tuple] = {}


def worker_model(value: tuple) -> tuple[Index, np.ndarray, dict[bytes, float], float]:
    """Index of the frequent grams and their costs, logarithms of the frequent words' counts and of the end's; a worker
    keeps the last model."""
    codes, costs, names, times, ends, mark = value
    if mark not in _MODELS:
        _MODELS.clear()
        logs = dict(zip(names, np.log10(np.asarray(times, float) + 1).tolist(), strict=True))
        _MODELS[mark] = Index(codes), costs, logs, float(np.log10(ends + 1))
    return _MODELS[mark]


def gram_scores(texts: list[bytes], index: Index, costs: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Of each text: the sum of the costs that are held, and the grams that are not, with how often each occurs."""
    sums, codes, times = np.zeros(len(texts)), [[] for _ in texts], [[] for _ in texts]
    for owners, pieces in sliced(texts):
        code, owner = grams(pieces)
        at = index.find(code)
        if len(costs):
            np.add.at(sums, owners, np.bincount(owner, np.where(at >= 0, costs[at], 0.0), len(pieces)))
        miss = np.flatnonzero(at < 0)
        ends = np.searchsorted(owner[miss], np.arange(len(pieces) + 1))
        for k, a, b in zip(owners, ends[:-1], ends[1:], strict=True):
            if b > a:
                c, n = np.unique(code[miss[a:b]], return_counts=True)
                codes[k].append(c), times[k].append(n)
    none = np.empty(0, np.int64)
    return sums, [np.concatenate(c) if c else none for c in codes], [np.concatenate(n) if n else none for n in times]


SCORED = "uid long, doc_id long, held_out boolean, n_tokens long, known long, logs double, score double, rare array<string>, times array<int>, grams array<long>, gram_times array<long>"


def score(docs: DataFrame, learn: Column) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs (doc_id, text).

    learn: which rows are training rows; held_out is its opposite. A null text is empty: its only token is the end.
    With no training row every count is 0, and the byte model is uniform. Repeated rows are scored alike and, in
    training, count each time. Words that are not among the broadcast ones are looked up by a join on the word.
    """
    spark = docs.sparkSession
    importable_on_workers(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (~learn).alias("held_out"))
    training = docs.filter("not held_out")
    # a word's own count is its key's size: hot words are summed before the shuffle
    counts = training.select(F.explode(words(ascii_lower(F.col("text")))).alias("word")).filter("word <> ''").groupBy("word").agg(F.count("*").alias("c"))
    counts = materialize(counts, "words")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = training.count()
    n_train, vocabulary = total + ends, distinct + (ends > 0)
    bound = most_frequent(counts, "c", FREQUENT_WORDS)
    top = counts.filter(F.col("c") >= bound).toArrow()
    costs = gram_costs(docs)
    gram_bound = most_frequent(costs, "times", MODEL_GRAMS)
    held = costs.filter(F.col("times") >= gram_bound).toArrow()
    model = spark.sparkContext.broadcast((held.column("code").to_numpy(), held.column("cost").to_numpy(), top.column("word").cast(pa.binary()).to_pylist(), top.column("c").to_pylist(), ends, uuid.uuid4().hex))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, gram_cost, logs, end_log = worker_model(model.value)
        uid = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                cols = [[] for _ in range(5)]
                texts = _canonical(part.column(1))
                sums, open_grams, open_times = gram_scores(texts, index, gram_cost)
                for text in texts:
                    each = text.split(b" ") if text else []
                    got = [logs.get(w) for w in each]
                    missing = Counter(w for w, x in zip(each, got, strict=True) if x is None) if None in got else {}
                    known = len(each) - sum(missing.values())
                    for col, x in zip(cols, (len(each) + 1, known + (end_log > 0), sum(x for x in got if x is not None) + end_log, list(missing), list(missing.values())), strict=True):
                        col.append(x)
                n = part.num_rows
                rare = pa.array(cols[3], pa.list_(pa.binary())).cast(pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(range(uid, uid + n), pa.int64()), part.column(0), part.column(2), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()), pa.array(sums), rare, pa.array(cols[4], pa.list_(pa.int32())), pa.array(open_grams, pa.list_(pa.int64())), pa.array(open_times, pa.list_(pa.int64()))], names=["uid", "doc_id", "held_out", "n_tokens", "known", "logs", "score", "rare", "times", "grams", "gram_times"])
                uid += n

    scored = materialize(docs.select("doc_id", "text", "held_out").mapInArrow(lean(run), SCORED), "scores")
    rare = scored.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("uid", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    more = rare.join(counts.filter(F.col("c") < bound), "word").groupBy("uid").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("more_logs"))
    base = F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(n_train + vocabulary + 1)))
    out = scored.drop("rare", "times", "grams", "gram_times").join(more, "uid", "left")
    score_ = F.col("score")
    if gram_bound > 1:  # else all grams are broadcast
        open_ = scored.select("uid", F.explode(F.arrays_zip("grams", "gram_times")).alias("x")).select("uid", F.col("x.grams").alias("code"), F.col("x.gram_times").alias("by"))
        rest = costs.filter(F.col("times") < gram_bound).select("code", "cost")
        out = out.join(open_.join(rest, "code").groupBy("uid").agg(F.sum(F.col("by") * F.col("cost")).alias("rest")), "uid", "left")
        score_ = score_ + F.coalesce("rest", F.lit(0.0))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"), F.lit(int(n_train)).cast("long").alias("train_tokens"), base.alias("base_score"), score_.alias("score"))
