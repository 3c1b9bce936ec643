"""Leakage joins, capping, folds, splits and digests. Ranks within hot keys are made by hash ranges, not by one task."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sequoria.functions import sequence as S
from sequoria.functions.plan import dealt, distinct_dealt, importable, sealed, stored


def _size_class(m: Column) -> Column:
    """The greatest size of the class of m: sizes up to 16 have their own, above them classes grow by a fifth."""
    step = F.ceil(F.log(m / F.lit(16.0)) / F.lit(log(1.2)))
    return F.when(m <= 16, m).otherwise(F.floor(16 * F.pow(F.lit(1.2), step) + 1e-6)).cast("int")


#: Cells (rows by pieces) of signatures that a task makes at once.
CELLS = 500_000
#: Signatures that a round of the join is to hold, and rounds at most. What a round deals out is removed before the next.
ROUND, ROUNDS = 8_000_000, 48


def _apart(n: np.ndarray, m: np.ndarray, threshold: float) -> np.ndarray:
    """How many k-mers two sets of n and m that are alike may differ by at most."""
    return np.floor((n + m) * ((1 - threshold) / (1 + threshold)) + 1e-9).astype(np.int64)


def _grid(size: int, threshold: float) -> tuple[int, int, int]:
    """(groups, pieces of a group, pieces left out) of the class of sets of `size` at most. Sets that are alike have a group
    in which they differ by no more k-mers than pieces are left out. Few pieces would make keys that many sets share."""
    differ = int((1 - threshold) / threshold * size + 1e-9)
    pieces, out = (1, 0) if differ == 0 else (6, 2) if differ == 2 else (4, 1)
    return differ // (out + 1) + 1, pieces, out


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _signs(hashes: np.ndarray, counts: np.ndarray, size: int, threshold: float, all_groups: bool, cut: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Row and key of the signatures of rows in the class of `size`: hashes has their k-mers, one row after another, counts
    of each. A key is of class, group, pieces left out and the k-mers in the others. cut (i, n): of each n groups the ith."""
    groups, pieces, out = _grid(size, threshold)
    cells, row = groups * pieces, np.repeat(np.arange(len(counts)), counts)
    cell = row * cells + (hashes % np.uint64(cells)).astype(np.int64)
    held, sign = np.bincount(cell, minlength=len(counts) * cells).reshape(-1, groups, pieces).sum(axis=2), np.zeros(len(counts) * cells, np.uint64)
    np.add.at(sign, cell, _mixed(hashes + np.uint64(1)))
    sign = sign.reshape(-1, groups, pieces)
    shown = np.ones(held.shape, bool)
    if not all_groups:  # those with the most k-mers: one of any so many has no more differences than pieces are left out
        need = np.minimum(groups - 1, _apart(counts, np.int64(size), threshold) // (out + 1))
        shown[:] = False
        np.put_along_axis(shown, np.argsort(-held, axis=1, kind="stable"), np.arange(groups) <= need[:, None], axis=1)
    shown[:, np.arange(groups) % cut[1] != cut[0]] = False
    at, group = np.nonzero(shown)
    own, rows, keys = sign[at, group], [], []
    for i, left in enumerate(combinations(range(pieces), out)):
        name = _mixed((np.uint64(size) << np.uint64(32)) ^ (group.astype(np.uint64) << np.uint64(8)) ^ np.uint64(i))
        rows.append(at)
        keys.append(_mixed(own.sum(axis=1) - own[:, list(left)].sum(axis=1) + name))
    return np.concatenate(rows), np.concatenate(keys)


def _signed(threshold: float, all_groups: bool, classes: tuple[int, int], cut: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kmers, named = batch.column("kmers"), batch.column("classes")
            begin, hashes = kmers.offsets.to_numpy(), _mixed(kmers.values.to_numpy().view(np.uint64))
            counts, n, ids = np.diff(begin), batch.column("n").to_numpy(), batch.column("id").to_numpy()
            of, sizes = np.repeat(np.arange(batch.num_rows), np.diff(named.offsets.to_numpy())), named.values.to_numpy()
            for size in np.unique(sizes[(sizes >= classes[0]) & (sizes <= classes[1])]).tolist():
                rows, (groups, pieces, _) = of[sizes == size], _grid(size, threshold)
                step = max(1, CELLS // (groups * pieces))
                for at in range(0, len(rows), step):
                    some = rows[at : at + step]
                    here = counts[some]
                    upto = np.cumsum(here) - here
                    held = hashes[np.repeat(begin[some] - upto, here) + np.arange(here.sum())]
                    row, key = _signs(held, here, size, threshold, all_groups, cut)
                    bit, bits = _mixed(held ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(64 * len(_BITS)), np.zeros(len(some) * len(_BITS), np.uint64)
                    word = np.repeat(np.arange(len(some)), here) * len(_BITS) + (bit >> np.uint64(6)).astype(np.int64)
                    np.bitwise_or.at(bits, word, np.uint64(1) << (bit & np.uint64(63)))
                    words = [pa.array(x[row].view(np.int64)) for x in bits.reshape(-1, len(_BITS)).T.copy()]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[some][row]), *words, pa.array(n[some][row]), pa.array(key.view(np.int64))], names=["id", *_BITS, "n", "key"])

    return run


def _signatures(sides: DataFrame, threshold: float, all_groups: bool, classes: tuple[int, int] = (0, 1 << 31), cut: tuple[int, int] = (0, 1)) -> DataFrame:
    """(id, bits, n, key) for rows of those with kmers and classes, of the classes from one to another. k-mers are dealt to
    the groups of a class, and in them to pieces, by hash; a key is of a group without some of its pieces. Not all groups:
    only as many as one must be alike of, those with the most k-mers. cut (i, n): of each n groups only the ith."""
    importable(sides.sparkSession)
    kmers = F.col("kmers") if sides.schema["kmers"].dataType.elementType.typeName() == "long" else F.transform("kmers", lambda x: F.xxhash64(x))
    return sides.select("id", "n", kmers.alias("kmers"), "classes").mapInArrow(_signed(threshold, all_groups, classes, cut), ", ".join(["id long", *(f"{c} long" for c in _BITS), "n int, key long"]))


#: 128 bits that a sequence's k-mers set: twice as many let through a quarter less and double the rows that are dealt.
_BITS = ("bits0", "bits1")


def _sketched(df: DataFrame) -> DataFrame:
    """df (seq, kmers) with n and a number. To be stored before use: numbers follow from how rows are dealt."""
    return df.withColumns({"n": F.size("kmers"), "id": F.monotonically_increasing_id()})


def _rounds(sizes: list[tuple[int, int, int]], threshold: float) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    """Classes from one to another, and which groups of them, that are joined together. sizes: class, rows of the left and
    of the right in it. A class of more signatures than a round is to hold is cut by groups."""
    held = {}
    for size, ours, theirs in sorted(sizes):
        groups, pieces, out = _grid(size, threshold)
        held[size] = (ours + theirs) * groups * comb(pieces, out)
    most, rounds, full = max(ROUND, sum(held.values()) // ROUNDS), [], 0
    for size, n in held.items():
        slices = min(-(-n // most), _grid(size, threshold)[0])
        if slices > 1:
            rounds += [((size, size), (i, slices)) for i in range(slices)]
            full = most
        elif full + n > most or not rounds:
            rounds.append(((size, size), (0, 1)))
            full = n
        else:
            rounds[-1] = ((rounds[-1][0][0], size), (0, 1))
            full += n
    return rounds


def similar_pairs(left: DataFrame, right: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(seq, other): pairs of rows of left and right (seq, kmers; seq not repeated) whose sets of k-mers have a Jaccard of
    `threshold` or more.

    Exact. Two such sets differ by at most a share of their size, d. Dealt into d / 2 + 1 groups, they differ by one k-mer
    at most in one of them; of that group's four pieces three are the same in both, and each three are a key (see _grid
    for sizes with other numbers). So no frequent k-mer is a key by itself. Of any d / 2 + 1 groups one is such, and the
    left side offers those with the most k-mers. Pairs whose bits differ too much are dropped in the join; the others are
    verified on the full sets. The join is made in rounds of classes of sizes, or of some groups of a large class: of
    signatures, which are many times the input, no more than a round's are on disk.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be over 0 and at most 1")
    sizes = F.sequence(F.ceil(F.col("n") * threshold - 1e-9).cast("int"), F.floor(F.col("n") / threshold + 1e-9).cast("int"))
    classes = F.array_distinct(F.transform(sizes, _size_class)), F.array(_size_class(F.col("n")))
    # rows by size, so that a round reads little but its own
    sides = [stored(_sketched(df.select("seq", "kmers")).withColumn("classes", c).sortWithinPartitions("n"), "sketches", swept=True) for df, c in zip((left, right), classes, strict=True)]
    ours, theirs = ({r[0]: r[1] for r in s.select(F.explode("classes").alias("size")).groupBy("size").count().collect()} for s in sides)
    found = [_near_pairs(*sides, threshold, *part) for part in _rounds([(c, ours[c], theirs[c]) for c in ours if c in theirs], threshold)]
    if not found:
        return sides[0].select("seq", F.col("seq").alias("other")).limit(0)
    pairs = dealt(reduce(DataFrame.union, found).distinct())
    ours = sides[0].select("id", "seq", F.col("kmers").alias("k_own"))
    theirs = sides[1].select(F.col("id").alias("other_id"), F.col("seq").alias("other"), F.col("kmers").alias("k_other"))
    both = pairs.join(ours, "id").join(theirs, "other_id").withColumn("shared", F.size(F.array_intersect("k_own", "k_other")))
    return both.filter(F.col("shared") / (F.size("k_own") + F.size("k_other") - F.col("shared")) >= threshold).select("seq", "other")


def _near_pairs(left: DataFrame, right: DataFrame, threshold: float, classes: tuple[int, int], cut: tuple[int, int]) -> DataFrame:
    """(id, other_id) of one round, stored: pairs with a key in common whose bits do not differ too much."""
    # a class begins above five sixths of its greatest size
    least, most = int(classes[0] / 1.25 * threshold), int(classes[1] / threshold + 1)
    sides = [s.filter(F.col("n").between(least, most)) for s in (left, right)]
    a, b = _signatures(sides[0], threshold, False, classes, cut), _signatures(sides[1], threshold, True, classes, cut)
    b = b.select("key", F.col("n").alias("m"), *[F.col(c).alias(f"other_{c}") for c in ("id", *_BITS)])
    # sets differ by a k-mer at least for each bit that one of them alone has set
    gap = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"other_{c}"))) for c in _BITS), F.lit(0))
    near = gap <= (F.col("n") + F.col("m")) * ((1 - threshold) / (1 + threshold)) + 1e-9
    return stored(a.join(b.hint("shuffle_hash"), "key").filter(near).select("id", "other_id").distinct(), "pairs", swept=True)


def with_kmers(rows: DataFrame, k: int = 3) -> DataFrame:
    """Distinct seq of rows that are not empty, with their k-mers; short ones as whole numbers, whose sets are compared
    without objects."""
    coded = (lambda x: F.conv(F.hex(x), 16, 10).cast("long")) if k <= 3 else (lambda x: x)
    return distinct_dealt(rows.filter("seq is not null and seq <> ''"), "seq").withColumn("kmers", F.transform(S.kmers(F.col("seq"), k), coded))


def similar(left: DataFrame, right: DataFrame, threshold: float = 0.8, k: int = 3) -> DataFrame:
    """Distinct sequences of left (seq) that have one in right (seq) of k-mer Jaccard `threshold` or more."""
    return similar_pairs(with_kmers(left, k), with_kmers(right, k), threshold).select("seq").distinct()


def leak_reasons(pretrain: DataFrame, core: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(ord, seq, reason) of pretrain (ord, seq): exact, rotated or near copy of a core sequence, else a repeat of the first
    row by ord; null is kept. Reasons are found once for each distinct sequence."""
    pretrain, core = stored(pretrain.select("ord", "seq"), "pretrain"), stored(core.select("seq").distinct(), "core", swept=True)
    near = similar(pretrain, core, threshold).withColumn("near", F.lit(True))
    turned = sealed(core, S.canonical(F.col("seq")).alias("canonical")).distinct()
    turned = sealed(distinct_dealt(pretrain, "seq"), "seq", S.canonical(F.col("seq")).alias("canonical")).join(turned, "canonical", "left_semi")
    turned = stored(turned.select("seq"), "turned", swept=True).withColumn("turned", F.lit(True))
    # dealt by seq once, for all that is joined by it
    rows = dealt(pretrain, "seq")
    once = rows.groupBy("seq").agg(F.min("ord").alias("first_ord"))
    once = once.join(core.withColumn("exact", F.lit(True)), "seq", "left").join(turned, "seq", "left").join(near, "seq", "left")
    leak = F.when(F.col("exact"), "exact_core_leakage").when(F.col("turned"), "cyclic_rotation_core_leakage").when(F.col("near"), f"core_3mer_jaccard_ge_{threshold:g}")
    found = once.select("seq", "first_ord", leak.alias("leak"))
    out = rows.join(found, "seq", "left")
    return out.withColumn("reason", F.coalesce("leak", F.when(F.col("ord") > F.col("first_ord"), "duplicate_pretrain_sequence"))).drop("leak", "first_ord")


def draw(seed: int, key: Column) -> Column:
    """The order that stands for a seeded shuffle: SHA-256 of seed and key."""
    return F.sha2(F.concat(F.lit(f"{seed}|"), key.cast("string")), 256)


def stratum_name(strata: list[str]) -> Column:
    """The texts of a stratum's columns, joined; null is empty."""
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in strata])


def stratified_cap(rows: DataFrame, strata: list[str], key: str, limit: int, seed: int = 42) -> DataFrame:
    """Adds `selected`: round-robin over the strata, each in seeded order, up to `limit` rows.

    Of a stratum only the first `limit` rows by hash can be taken, and Spark keeps no more of them in any task. All
    strata up to a round are taken, and in the round where the limit falls those that come first by name. What is ranked
    over all strata is at most a row a round, and a row a stratum in the last one.
    """
    slim = rows.select(key, stratum_name(strata).alias("_stratum"), draw(seed, F.col(key)).alias("_h"))
    ranked = slim.withColumn("_round", F.row_number().over(Window.partitionBy("_stratum").orderBy("_h", key))).filter(F.col("_round") <= limit)
    rounds = ranked.groupBy("_round").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.orderBy("_round"))
    cut = rounds.withColumn("_upto", upto).filter(F.col("_upto") > limit).agg(F.min("_round").alias("_last"), F.min_by(F.col("_upto") - F.col("_n"), "_round").alias("_before"))
    near = ranked.crossJoin(F.broadcast(cut)).filter(F.col("_last").isNull() | (F.col("_round") <= F.col("_last")))
    at = F.row_number().over(Window.partitionBy("_round").orderBy("_stratum"))
    chosen = near.withColumn("_at", at).filter(F.col("_last").isNull() | (F.col("_round") < F.col("_last")) | (F.col("_before") + F.col("_at") <= limit))
    chosen = chosen.select(key, F.lit(True).alias("selected"))
    if limit <= BROADCAST_ROWS:  # at most `limit` rows are chosen
        chosen = F.broadcast(chosen)
    return rows.join(chosen, key, "left").withColumn("selected", F.coalesce("selected", F.lit(False)))


#: Rows of a key and a flag that are broadcast at most.
BROADCAST_ROWS = 1_000_000


def hashed_rank(rows: DataFrame, by: list[str], h: Column, key: str, name: str, counted: DataFrame | None = None) -> DataFrame:
    """Adds the place (from 1) of a row among those with equal `by` columns, in order of the hex text h, then key.

    Rows are ranked within the 4,096 ranges of the first three digits, so that no task holds all rows of a hot key; a
    running sum of the ranges' counts gives where each begins. counted: the same rows with fewer columns, to count.
    """
    counted = (rows if counted is None else counted).withColumn("_h", h).withColumn("_range", F.substring("_h", 1, 3))
    rows = rows.withColumn("_h", h).withColumn("_range", F.substring("_h", 1, 3))
    counts = counted.groupBy(*by, "_range").agg(F.count("*").alias("_held"))
    starts = counts.withColumn("_start", F.sum("_held").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)))
    starts = starts.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_range").alias("_at"), F.coalesce("_start", F.lit(0)).alias("_start"))
    same = F.col("_range") == F.col("_at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    near = F.row_number().over(Window.partitionBy(*by, "_range").orderBy("_h", key))
    return rows.join(starts, same).withColumn(name, F.col("_start") + near).drop("_h", "_range", "_start", "_at", *[f"_by_{c}" for c in by])


def folds(groups: DataFrame, label: str, key: str, n: int = 3, seeds: tuple[int, ...] = (42, 43, 44)) -> DataFrame:
    """Adds fold_seed_<s>: within each label, seeded order modulo n."""
    groups = once = stored(groups, "groups")
    for s in seeds:
        groups = hashed_rank(groups, [label], draw(s, F.col(key)), key, "_rank", once).withColumn(f"fold_seed_{s}", ((F.col("_rank") - 1) % n).cast("int")).drop("_rank")
    return groups


def train_valid(rows: DataFrame, strata: list[str], key: str, fraction: float = 0.1, seed: int = 42) -> DataFrame:
    """Adds `split`: of each stratum a fraction is valid, one row at least and not all; single rows are train."""
    rows = stored(rows, "rows")
    sizes = rows.groupBy(*strata).agg(F.count("*").alias("_size")).select(*[F.col(c).alias(f"_of_{c}") for c in strata], "_size")
    same = F.lit(True)
    for c in strata:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    out = hashed_rank(rows, strata, draw(seed, F.col(key)), key, "_rank").join(sizes, same)
    take = F.least(F.greatest(F.lit(1), F.bround(F.col("_size") * fraction)), F.col("_size") - 1)
    return out.withColumn("split", F.when(F.col("_rank") <= take, "valid").otherwise("train")).drop("_rank", "_size", *[f"_of_{c}" for c in strata])


def block_digest(rows: DataFrame, by: list[str], order: str, text: Column, block: int = 4096) -> DataFrame:
    """(by, digest, n): SHA-256 over a tree of digests. Leaves are the texts by `order`; `block` neighbouring places make a
    node, and as many neighbouring nodes the next one, until a group has `block` of them at most, which the digest is of.
    It depends on the rows and their order only, and no task holds more than `block` texts or digests of a group."""
    up = lambda c: F.call_function("div", F.col(c), F.lit(block)).alias("_block")
    each = rows.select(*by, up(order), F.struct(F.col(order).alias("o"), F.coalesce(text, F.lit("")).alias("t")).alias("_row")).groupBy(*by, "_block").agg(F.array_sort(F.collect_list("_row")).alias("_rows"))
    each = stored(each.select(*by, "_block", F.sha2(F.array_join(F.col("_rows.t"), ""), 256).alias("_d"), F.size("_rows").cast("long").alias("_n")), "digests")
    joined = lambda: F.sha2(F.array_join(F.col("_all._d"), ""), 256)
    most = each.agg(F.max("_block")).first()[0] or 0
    while most >= block:
        each = each.select(*by, up("_block"), F.struct("_block", "_d").alias("_s"), "_n").groupBy(*by, "_block").agg(F.array_sort(F.collect_list("_s")).alias("_all"), F.sum("_n").alias("_n")).select(*by, "_block", joined().alias("_d"), "_n")
        most //= block
    listed = F.array_sort(F.collect_list(F.struct("_block", "_d")))
    return each.groupBy(*by).agg(listed.alias("_all"), F.sum("_n").alias("n")).select(*by, joined().alias("digest"), "n")


def leaks_between(rows: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys that stand in more than one split, with the splits."""
    return rows.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(split)), ",").alias("splits"), F.countDistinct(split).alias("n")).filter("n > 1").drop("n")
