"""Mixing sources to target weights by hash-threshold histograms.

Every document has a hash. Tokens are summed by source and hash bucket; the running sums find the bucket in which a
source's budget ends; only that bucket is refined, by the next bits of the hash. What lies under the final threshold
is taken by a filter. Thresholds of a smaller budget lie under those of a larger one, so mixes are nested.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, materialize, small_side

#: Weights by rank of the source; they repeat.
WEIGHTS = (5, 2, 1)
#: Copies of a source that a target may ask for at most.
MOST_COPIES = 3
#: Bits of the hash, and bits of each level of the histograms.
BITS, LEVEL = 48, 12


def document_hash(doc_id: Column) -> Column:
    """The first BITS bits of SHA-256 of the id as text; null counts as the text 'null'."""
    return F.conv(F.substring(F.sha2(F.coalesce(doc_id.cast("string"), F.lit("null")), 256), 1, BITS // 4), 16, 10).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, share: float = 1.0) -> dict[str | None, float]:
    """Target of each source: share of all tokens by weight, at most `most` times its size; the excess goes to the
    others by weight until none is above. Sources are ranked by code point, null last; a source without tokens gets 0."""
    ranked = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode("utf-8", "surrogatepass")))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(ranked)}
    size, out, rest = dict(ranked), {}, share * sum(n for _, n in ranked)
    free = set(size)
    while free:
        unit = rest / sum(weight[s] for s in free)
        over = {s for s in free if unit * weight[s] > most * size[s]}
        if not over:
            return out | {s: unit * weight[s] for s in free}
        out |= {s: float(most * size[s]) for s in over}
        rest -= sum(out[s] for s in over)
        free -= over
    return out


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every row of docs (doc_id, text, source).

    size: words of the text, 0 for null. Each document is taken floor(target / source_size) times, and once more if
    its hash is under its source's threshold, which is set where the running sum comes nearest to the budget that is
    left. Rows with one doc_id have one hash and go together. Documents without words are taken 0 words, in as many
    copies as any other. An empty table gives no rows. Reruns agree: the hash depends on doc_id only.

    The driver sees one row a source: its size, and on each level the bucket in which its budget ends.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    sized = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), document_hash(F.col("doc_id")).alias("h")), "sizes")
    sizes = [(r[0], r[1]) for r in sized.groupBy("source").agg(F.sum("size")).collect()]
    goal = targets(sizes, weights, most)
    whole = {s: min(int(goal[s] // n), most) if n else 0 for s, n in sizes}
    left = {s: goal[s] - whole[s] * n for s, n in sizes}
    # below[s]: hashes under it are taken; it is moved up level by level, and `left` goes down by what lies under it
    below, open_, shift = {s: 0 for s, _ in sizes}, {s for s, n in sizes if n and left[s] > 0}, BITS
    while open_ and shift:
        shift -= LEVEL
        frame = spark.createDataFrame([(s, s is None, below[s], float(left[s])) for s in open_], "source string, none boolean, below long, budget double")
        inside = sized.filter("size > 0").join(F.broadcast(frame), sized.source.eqNullSafe(frame.source)).drop(frame.source)
        inside = inside.filter(F.shiftright("h", shift + LEVEL) == F.shiftright("below", shift + LEVEL))
        bars = inside.groupBy("source", "budget", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("tokens"))
        upto = F.sum("tokens").over(Window.partitionBy("source").orderBy("bucket"))
        ends = bars.withColumn("upto", upto).filter(F.col("upto") > F.col("budget")).groupBy("source").agg(F.min(F.struct("bucket", "upto", "tokens")).alias("x")).select("source", "x.*").collect()
        met = {r[0]: r for r in ends}
        for s in list(open_):
            if s not in met:  # all that is inside fits
                open_.discard(s)
                below[s] = ((below[s] >> (shift + LEVEL)) + 1) << (shift + LEVEL)
                continue
            _, bucket, reached, tokens = met[s]
            left[s] -= reached - tokens
            below[s] = bucket << shift
            if not shift and tokens - left[s] < left[s]:  # the one hash on the boundary, if that is nearer
                below[s] += 1
    plan = spark.createDataFrame([(s, n, float(goal[s]), whole[s], below[s]) for s, n in sizes], "source string, source_size long, target double, whole int, below long")
    if len(sizes) <= 100_000:
        plan = F.broadcast(plan)
    out = sized.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
    copies = (F.col("whole") + (F.col("h") < F.col("below")).cast("int")).cast("int")
    return out.select("d.doc_id", "d.source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: every row of docs as often as it is taken, with its own columns."""
    ids = materialize(mix(docs).filter("copies > 0").select("doc_id", "source", "copies").distinct(), "copies")
    joined = docs.alias("d").join(small_side(ids).alias("m"), F.col("d.doc_id").cast("long").eqNullSafe(F.col("m.doc_id")) & F.col("d.source").eqNullSafe(F.col("m.source")))
    if "_copy" in docs.columns:
        raise ValueError("docs has a column _copy")
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("d.*")


#: The same mix in SQL: water-filling in closed form, and a sort where the operator uses histograms.
ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(sha256(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, {BITS // 4}) AS BIGINT) AS h
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS n,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM d GROUP BY source),
o AS (
  SELECT *, {MOST_COPIES} * n / w::DOUBLE AS level,
         coalesce(sum({MOST_COPIES} * n) OVER (ORDER BY {MOST_COPIES} * n / w::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
         sum(w) OVER (ORDER BY {MOST_COPIES} * n / w::DOUBLE, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_after,
         sum(n) OVER () AS total FROM s),
u AS (SELECT coalesce(arg_min((total - full_before) / w_after::DOUBLE, level) FILTER (WHERE (total - full_before) / w_after::DOUBLE <= level), 0) AS unit FROM o),
t AS (SELECT source, n, CAST(least(unit * w, {MOST_COPIES} * n) AS DOUBLE) AS target FROM s, u),
p AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE CAST(least(floor(target / n), {MOST_COPIES}) AS BIGINT) END AS whole FROM t),
g AS (SELECT d.source, h, sum(size) AS size FROM d GROUP BY d.source, h),
c AS (
  SELECT g.source, g.h, g.size, target - whole * n AS budget,
         sum(g.size) OVER (PARTITION BY g.source ORDER BY g.h) AS upto
  FROM g JOIN p ON g.source IS NOT DISTINCT FROM p.source WHERE n > 0),
k AS (
  SELECT source, max(CASE WHEN upto <= budget OR (upto > budget AND upto - size <= budget AND size > 0 AND upto - budget < budget - (upto - size)) THEN h END) AS last
  FROM c WHERE budget > 0 GROUP BY source)
SELECT d.doc_id, d.size, p.n AS source_size, round(p.target, 3) AS target,
       CAST(d.size * (p.whole + CASE WHEN k.last IS NOT NULL AND d.h <= k.last THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN k ON d.source IS NOT DISTINCT FROM k.source
"""
