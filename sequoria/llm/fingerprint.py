"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Each 5-word shingle is hashed once. The top bits of the hash are its bin, and the least hash of a bin stands for it.
An empty bin borrows from the first filled one in a pseudo-random order of its own (optimal densification; start and odd
step are hashes of the bin, so the order runs through all bins and always ends). The low 8 bits of each bin are stored,
eight bins packed in a long, and likeness is the share of equal bins corrected for the chance agreement of 8 bits.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, words

#: Bins (a power of two), stored bits of each, and words of a shingle.
BINS, BITS, SHINGLE = 128, 8, 5
#: Bins in a packed long.
PACK = 64 // BITS
_ONES = 0x0101010101010101
_SHIFT = 64 - (BINS.bit_length() - 1)
#: Groups of neighbouring documents: a tree of this width and two levels.
WIDTH, GROUP_ROWS = 64, 256


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the packed fingerprint of a text column: BINS / PACK longs, no longs for a text without words.

    Equal texts have equal fingerprints. Fewer than SHINGLE words are one shingle. Columns named _fp* are replaced.
    """
    seeds = [int(hashlib.sha256(str(j).encode()).hexdigest()[:8], 16) for j in range(BINS)]
    starts = F.from_json(F.lit(json.dumps([x % BINS for x in seeds])), "array<int>")
    steps = F.from_json(F.lit(json.dumps([x // BINS % BINS | 1 for x in seeds])), "array<int>")
    df = df.withColumn("_fpw", words(ascii_lower(F.col(text))))
    n = F.when(F.get("_fpw", F.lit(0)) == "", 0).otherwise(F.size("_fpw"))
    at = lambda i, k: F.get("_fpw", i + k)
    each = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*[at(i, k) for k in range(SHINGLE)]))
    hashes = F.when(n == 0, F.array().cast("array<bigint>")).when(n < SHINGLE, F.array(F.xxhash64("_fpw"))).otherwise(each)
    df = df.withColumn("_fph", F.sort_array(hashes)).drop("_fpw")
    # sorted, the hashes of a bin stand together, its least one first
    first = F.filter("_fph", lambda x, i: (i == 0) | (F.shiftrightunsigned(x, _SHIFT) != F.shiftrightunsigned(F.get("_fph", i - 1), _SHIFT)))
    df = df.withColumn("_fpf", first).drop("_fph")
    # bin j stands where as many filled bins precede it as the two bitmaps (bins under 64, and the others) say;
    # signed order puts the upper half of the bins first
    half = BINS // 2
    bit = lambda lo: F.aggregate(F.transform("_fpf", lambda x: F.shiftrightunsigned(x, _SHIFT).cast("int")), F.lit(0).cast("bigint"), lambda s, b: F.when((b >= lo) & (b < lo + half), s.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), b - lo))).otherwise(s))
    df = df.withColumns({"_fpx": bit(0), "_fpy": bit(half)}).withColumn("_fpn", F.bit_count("_fpy"))

    def own(bits: str, before: Column | str) -> Column:
        under = lambda j: F.col(bits).bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("bigint"), j)))
        has = lambda j: F.call_function("shiftrightunsigned", F.col(bits), j).bitwiseAND(F.lit(1).cast("bigint")) == 1
        return F.transform(F.sequence(F.lit(0), F.lit(half - 1)), lambda j: F.when(has(j), F.get("_fpf", before + F.bit_count(under(j)))))

    df = df.withColumn("_fpb", F.concat(own("_fpx", F.col("_fpn")), own("_fpy", F.lit(0)))).drop("_fpx", "_fpy", "_fpn")
    # most empty bins find a filled one in a few steps; the order is the same however far it is followed
    lent = lambda j, far: F.get(F.filter(F.transform(F.sequence(F.lit(1), F.lit(far)), lambda t: F.get("_fpb", (F.get(starts, j) + t * F.get(steps, j)).bitwiseAND(F.lit(BINS - 1)))), lambda v: v.isNotNull()), F.lit(0))
    found = F.transform("_fpb", lambda v, j: F.coalesce(v, lent(j, 3), lent(j, 16), lent(j, BINS)))
    df = df.withColumn("_fpd", F.when(F.size("_fpf") == BINS, F.col("_fpb")).otherwise(found))
    low = lambda k, i: F.shiftleft(F.get("_fpd", k * PACK + i).bitwiseAND(F.lit((1 << BITS) - 1)), BITS * i)

    def packed(k: Column) -> Column:
        out = low(k, 0)
        for i in range(1, PACK):
            out = out.bitwiseOR(low(k, i))
        return out

    longs = F.transform(F.sequence(F.lit(0), F.lit(BINS // PACK - 1)), packed)
    return df.withColumn(out, F.when(F.size("_fpf") == 0, F.array().cast("array<bigint>")).otherwise(longs)).drop("_fpf", "_fpb", "_fpd")


def as_text(packed: str) -> Column:
    """A packed fingerprint as 2 * BINS hex digits; '' for an empty one."""
    return F.array_join(F.transform(packed, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard likeness of two packed fingerprints, from 0 to 1; 1 for two empty ones, 0 for one empty."""
    # the lowest bit of each byte becomes the OR of its eight bits
    fold = lambda x, k: x.bitwiseOR(F.shiftrightunsigned(x, k))
    zero_bytes = lambda x: F.lit(PACK) - F.bit_count(fold(fold(fold(x, 4), 2), 1).bitwiseAND(F.lit(_ONES).cast("bigint")))
    same = F.aggregate(F.zip_with(a, b, lambda x, y: zero_bytes(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    chance = 2.0**-BITS
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(F.greatest(F.lit(0.0), (same / float(BINS) - chance) / (1 - chance)))


def with_next(docs: DataFrame, carry: list[str]) -> DataFrame:
    """Adds next_<column> of the following row by descending doc_id (nulls last, ties by text); after the last, the first.

    Rows are dealt to groups of neighbouring ids at quantiles, so the texts move once. The first row of each group is
    also dealt to the group before it, where it only serves as the last one's next.
    """
    quantiles = [i / WIDTH**2 for i in range(1, WIDTH**2)]
    bounds = docs.agg(F.percentile_approx("doc_id", quantiles, WIDTH**2 * 4).alias("q"), F.max("doc_id").alias("top"), F.count("*").alias("n")).first()
    # the number of groups follows the number of rows, so that few rows are dealt twice
    every = max(1, WIDTH**2 // max(1, bounds["n"] // GROUP_ROWS))
    top, cuts = bounds["top"], sorted(set((bounds["q"] or [])[every - 1 :: every]))
    rows = [cuts[i : i + WIDTH] for i in range(0, len(cuts), WIDTH)] or [[]]
    # group g holds the ids over cut g - 1 up to cut g; null ids come last of all, with the lowest ids
    inner = F.from_json(F.lit(json.dumps(rows)), "array<array<bigint>>")
    tops = F.from_json(F.lit(json.dumps([row[-1] for row in rows if row][:-1])), "array<bigint>")
    block = F.size(F.filter(tops, lambda c: c < F.col("doc_id")))
    fine = F.size(F.filter(F.get(inner, F.col("_block")), lambda c: c < F.col("doc_id")))
    df = docs.withColumn("_block", F.coalesce(F.when(F.col("doc_id").isNotNull(), block), F.lit(0)))
    df = df.withColumn("_group", F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("_block") * WIDTH + fine), F.lit(0)).cast("long"))
    is_cut = F.coalesce(F.array_contains(F.get(inner, F.col("_block")), F.col("doc_id")), F.lit(False))
    wrap = F.lit(True) if top is None else F.coalesce(F.col("doc_id") == top, F.lit(False))
    places = F.array(
        F.struct(F.col("_group").alias("g"), F.lit(0).alias("extra")),
        F.when(is_cut, F.struct((F.col("_group") + 1).alias("g"), F.lit(1).alias("extra"))),
        F.when(wrap, F.struct(F.lit(0).cast("long").alias("g"), F.lit(2).alias("extra"))),
    )
    df = df.withColumn("_place", F.explode(F.filter(places, lambda p: p.isNotNull()))).select("*", "_place.g", "_place.extra").drop("_place", "_block", "_group")
    over = Window.partitionBy("g").orderBy(F.col("extra"), F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first())
    df = df.withColumns({f"next_{c}": F.lead(c).over(over) for c in carry})
    return df.filter("extra = 0").drop("g", "extra")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row of docs
    (doc_id, text).

    The edited text is the text with its last floor(n_chars / 2) code points replaced by as many of the next
    document's first ones, or all of it. A null text is an empty one; its fingerprint is ''. Of repeated rows one is
    the next of another. A single row is its own next.
    """
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    df = with_next(with_fingerprint(df, "text", "fingerprint"), ["text", "fingerprint"])
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring(F.coalesce("next_text", "text"), F.lit(1), half))
    df = df.withColumns({"n_chars": F.length("text").cast("long"), "edited": edited, "next_fingerprint": F.coalesce("next_fingerprint", "fingerprint")}).drop("text", "next_text")
    df = with_fingerprint(df, "edited", "edited_fingerprint")
    return df.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text("fingerprint").alias("fingerprint"),
        as_text("edited_fingerprint").alias("edited_fingerprint"),
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        likeness("fingerprint", "next_fingerprint").alias("near_next"),
    )
