"""Merkle manifest of a data set: a tree of digests for each group of rows, one tree over the groups, a proof a row.

Rows are dealt to partitions by ranges of (group, key), so that each has a run of consecutive indexes of a group. Each
partition folds its run with a mountain range: a stack holds for every level the children of the node that is still
open, and the last child of a node carries it one level up. Nodes that lie within the run are complete and are emitted
with their children; what is left at the two unaligned edges is emitted as peaks. Peaks meet their neighbours by
(group, node) level by level, at most FANOUT of them in a group. Short last runs are hashed as they are, unpadded.
Proofs go the other way: from the root down, a node hands each child its siblings and its own proof.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_LOWER, ASCII_UPPER, ascii_lower, importable_on_workers, lean, materialize, small_side

#: Children of a node.
FANOUT = 16
#: Columns of a row that its leaf covers, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: What a partition emits: complete nodes with their children, and peaks without.
RECORD = "grp string, n long, level int, idx long, digest string, children array<string>"
#: Siblings to the left and to the right of a node, joined, on its level and on all above it.
PATH = "array<struct<l:string,r:string>>"


def field(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value; no two rows share a text of all fields."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(fields: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*(field(fields[c]) for c in FIELDS)), 256)


def depth(n: int) -> int:
    """Levels over n leaves; a lone leaf is its own root."""
    out = 0
    while n > 1:
        n, out = -(-n // FANOUT), out + 1
    return out


class Mountains:
    """The stack of one run of leaves of one group: push digests in order, then take the records."""

    def __init__(self, group: str | None, n: int, out: list):
        self.group, self.out, self.sizes, self.open = group, out, [n], []
        while self.sizes[-1] > 1:
            self.sizes.append(-(-self.sizes[-1] // FANOUT))
        self.open = [[] for _ in self.sizes]

    def push(self, idx: int, digest: str) -> None:
        level = 0
        while True:
            held = self.open[level]
            held.append((idx, digest))
            if level == len(self.sizes) - 1 or (idx % FANOUT != FANOUT - 1 and idx != self.sizes[level] - 1):
                return
            if held[0][0] % FANOUT:  # the node began in an earlier partition
                self.out += [(self.group, self.sizes[0], level, i, d, None) for i, d in held]
                held.clear()
                return
            children = [d for _, d in held]
            held.clear()
            digest = hashlib.sha256("".join(children).encode()).hexdigest()
            level, idx = level + 1, idx // FANOUT
            self.out.append((self.group, self.sizes[0], level, idx, digest, children))

    def close(self) -> None:
        """Peaks of nodes that a later partition ends. A root is a peak too if nothing is above it and it has no record."""
        for level, held in enumerate(self.open):
            if level < len(self.sizes) - 1 or level == 0:
                self.out += [(self.group, self.sizes[0], level, i, d, None) for i, d in held]


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, grp, idx, n, digest) sorted by part, grp and idx in, RECORD out."""
    schema = pa.schema([("grp", pa.string()), ("n", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("digest", pa.string()), ("children", pa.list_(pa.string()))])
    out, at, stack = [], None, None
    for batch in batches:
        for part, group, idx, n, digest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (part, group) != at:
                if stack:
                    stack.close()
                at, stack = (part, group), Mountains(group, n, out)
            stack.push(idx, digest)
        if len(out) > 4096:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)
            out.clear()
    if stack:
        stack.close()
    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)


def indexed(leaves: DataFrame, order: list[str]) -> DataFrame:
    """leaves (grp, digest, ...) with `part`, `idx`, the place in the group by the columns `order` and the digest (nulls
    first), and `n`, the group's number of leaves.

    Equal rows are told apart by a number of their own, so that no range of keys has to hold them all. The running
    sums are over one row for each partition and group in it.
    """
    keys = ["grp", *order, "digest", "tie"]
    ranged = leaves.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    ranged = materialize(ranged.withColumn("part", F.shiftright("at", 33)).drop("tie"), "ranged")
    runs = ranged.groupBy("part", "grp").agg(F.count("*").alias("m"), F.min("at").alias("first"))
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("grp")
    runs = runs.select("part", "grp", (F.coalesce(F.sum("m").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("m").over(whole).alias("n"))
    runs = materialize(runs, "runs")
    on = (ranged["part"] == runs["part"]) & ranged["grp"].eqNullSafe(runs["grp"])
    return ranged.join(small_side(runs), on).select(*(ranged[c] for c in ranged.columns if c != "at"), (F.col("at") + F.col("shift")).alias("idx"), "n")


def nodes(rows: DataFrame, most: int) -> DataFrame:
    """RECORDs of all nodes over the leaves of indexed rows, and of lone leaves as level 0; most: the largest n."""
    importable_on_workers(rows.sparkSession)
    runs = rows.select("part", "grp", "idx", "n", "digest").repartition("part").sortWithinPartitions("part", "grp", "idx")
    found = materialize(runs.mapInArrow(lean(_folded), RECORD), "mountains")
    done, peaks, carried = [found.filter("children is not null or n = 1")], found.filter("children is null and n > 1"), None
    for level in range(depth(most)):
        at = peaks.filter(F.col("level") == level).select("grp", "n", "idx", "digest")
        at = at if carried is None else at.unionByName(carried.select("grp", "n", "idx", "digest"))
        runs = at.groupBy("grp", "n", F.floor(F.col("idx") / FANOUT).alias("up")).agg(F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("c"))
        children = F.transform("c", lambda x: x.digest)
        made = runs.select("grp", "n", F.lit(level + 1).alias("level"), F.col("up").alias("idx"), F.sha2(F.array_join(children, ""), 256).alias("digest"), children.alias("children"))
        made = materialize(made, "merged")
        done.append(made)
        carried = made.filter(F.col("n") > FANOUT ** (level + 1))  # the only node of a level is a root, no child
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def siblings(children: Column, k: Column) -> Column:
    """The children before and after the k-th (from 0), each joined."""
    k = k.cast("int")
    return F.struct(F.array_join(F.slice(children, F.lit(1), k), "").alias("l"), F.array_join(F.slice(children, k + 2, F.lit(FANOUT)), "").alias("r"))


def tree(leaves: DataFrame, order: list[str], above: DataFrame | None = None):
    """A tree for each group of leaves (grp, digest, tie, columns of order and others).

    Returns (roots, prove): roots (grp, n, root); prove(above) gives every leaf row with its `path` (PATH), which goes
    on with above's (grp, top) over the root. Groups come by a null-safe grp.
    """
    rows = materialize(indexed(leaves, order), "indexed")
    most = rows.agg(F.max("n")).first()[0] or 0
    tops = materialize(nodes(rows, most), "nodes")
    height = sum(((F.col("n") > FANOUT**k).cast("int") for k in range(15)), F.lit(0))
    roots = tops.withColumn("height", height).filter("level = height").select("grp", "n", "height", F.col("digest").alias("root"))
    roots = materialize(roots, "roots")

    def prove(above: DataFrame) -> DataFrame:
        start = roots.alias("t").join(above.alias("a"), F.col("t.grp").eqNullSafe(F.col("a.grp"))).select("t.grp", "t.height", "a.top")
        reached = None  # (grp, idx, path) of the nodes of a level
        for level in range(depth(most), 0, -1):
            here = start.filter(F.col("height") == level).select("grp", F.lit(0).cast("long").alias("idx"), F.col("top").alias("path"))
            here = here if reached is None else here.unionByName(reached)
            node = tops.filter((F.col("level") == level) & F.col("children").isNotNull()).select(F.col("grp").alias("g"), F.col("idx").alias("i"), "children")
            runs = here.join(node, F.col("grp").eqNullSafe(F.col("g")) & (F.col("idx") == F.col("i"))).select("grp", "idx", "path", "children")
            if level == 1:
                reached = runs.select(F.col("grp").alias("g"), F.col("idx").alias("i"), "path", "children")
            else:
                each = runs.select("grp", "idx", "path", "children", F.posexplode("children").alias("k", "_d"))
                reached = each.select("grp", (F.col("idx") * FANOUT + F.col("k")).alias("idx"), F.concat(F.array(siblings(F.col("children"), F.col("k"))), F.col("path")).alias("path"))
        base = rows.drop("part")
        alone = base.filter("n = 1").join(start.select(F.col("grp").alias("g"), "top"), F.col("grp").eqNullSafe(F.col("g"))).drop("g", "idx", "n").withColumnRenamed("top", "path")
        if reached is None:
            return alone
        many = base.filter("n > 1").join(reached, F.col("grp").eqNullSafe(F.col("g")) & (F.floor(F.col("idx") / FANOUT) == F.col("i")))
        path = F.concat(F.array(siblings(F.col("children"), F.col("idx") % FANOUT)), F.col("path"))
        return many.withColumn("path", path).drop("g", "i", "idx", "n", "children").unionByName(alone)

    return roots, prove


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row of docs (FIELDS).

    A source's leaves are in the order of doc_id, null first; rows of one doc_id by their leaf; repeated rows are
    leaves of their own. Subroots are in the order of their source, null first, by UTF-8 bytes. folded_root is made
    from the row as it is after tampering (text in lower case where 5 divides the crc32 of doc_id; rows without doc_id
    or text stay) and the siblings of the original. An empty table gives no rows. Other columns are ignored.
    """
    now = {c: F.col(c) for c in FIELDS}
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    edited = leaf(now | {"text": ascii_lower(F.col("text"))})
    rows = docs.select(*FIELDS).select(F.col("source").cast("string").alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), leaf(now).alias("digest"), F.when(tampered, edited).alias("edited"), F.monotonically_increasing_id().alias("tie"))
    roots, prove = tree(materialize(rows, "leaves"), ["doc_id"])
    # the tree over the sources: one group, which nothing is above
    whole = roots.select(F.lit("").alias("grp"), F.col("grp").alias("source"), F.col("root").alias("digest"), F.lit(0).cast("long").alias("tie"))
    root, prove_source = tree(whole, ["source"])
    nothing = root.select("grp", F.array().cast(PATH).alias("top"))
    sources = materialize(prove_source(nothing).select(F.col("source").alias("grp"), F.col("digest").alias("subroot"), F.col("path").alias("top")), "sources")
    proved = prove(sources.select("grp", "top"))
    fold = lambda h, s: F.sha2(F.concat(s.l, h, s.r), 256)
    proved = proved.select("grp", "doc_id", F.col("digest").alias("leaf"), F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s.l, s.r)), ""), 256).alias("proof_sha256"), F.aggregate("path", F.coalesce("edited", "digest"), fold).alias("folded_root"))
    top = root.first()  # one row, none for an empty table
    out = proved.join(small_side(sources.select(F.col("grp").alias("g"), "subroot")), F.col("grp").eqNullSafe(F.col("g"))).withColumn("root", F.lit(top and top["root"]).cast("string"))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_HEAD = ", ".join(f"coalesce(CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in FIELDS[:-1])
#: The same by recursion over levels; crc32 is spelled out bit by bit.
ORACLE_SQL = f"""
WITH RECURSIVE f AS (
  SELECT row_number() OVER () AS r, doc_id, source, text,
         concat_ws('', {_HEAD}) AS head
  FROM documents),
crc(r, k, c, b) AS (
  SELECT r, 0, 4294967295::BIGINT, CAST(doc_id AS VARCHAR) FROM f WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT r, k + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, b
  FROM (SELECT r, k, b, CASE WHEN k % 8 = 0 THEN xor(c, ord(b[k // 8 + 1])::BIGINT) ELSE c END AS x FROM crc WHERE k < 8 * length(b))),
t AS (SELECT r FROM crc WHERE k = 8 * length(b) AND xor(c, 4294967295) % 5 = 0),
l AS (
  SELECT r, doc_id, source,
         sha256(head || coalesce(CAST(octet_length(encode(text)) AS VARCHAR) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(CAST(octet_length(encode(text)) AS VARCHAR) || ':' || CASE WHEN r IN (SELECT r FROM t) THEN translate(text, '{ASCII_UPPER}', '{ASCII_LOWER}') ELSE text END, '-')) AS edited
  FROM f),
i AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM l),
up(source, level, idx, n, h) AS (
  SELECT source, 0, idx, n, leaf FROM i
  UNION ALL
  SELECT source, level + 1, idx // {FANOUT}, (n + {FANOUT - 1}) // {FANOUT}, sha256(string_agg(h, '' ORDER BY idx)) FROM up WHERE n > 1
  GROUP BY source, level, idx // {FANOUT}, n),
s AS (SELECT source, level AS height, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM up WHERE n = 1),
top(level, idx, n, h) AS (
  SELECT 0, idx, n, h FROM s
  UNION ALL
  SELECT level + 1, idx // {FANOUT}, (n + {FANOUT - 1}) // {FANOUT}, sha256(string_agg(h, '' ORDER BY idx)) FROM top WHERE n > 1
  GROUP BY level, idx // {FANOUT}, n),
u AS (
  SELECT source, level, idx, idx // {FANOUT} AS run, h FROM up WHERE n > 1
  UNION ALL
  SELECT s.source, s.height + t.level, t.idx, t.idx // {FANOUT}, t.h FROM s JOIN top t ON t.n > 1),
sides AS (
  SELECT source, level, idx,
         coalesce(string_agg(h, '') OVER (PARTITION BY source, level, run ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
         coalesce(string_agg(h, '') OVER (PARTITION BY source, level, run ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b
  FROM u),
fold(r, source, level, idx, h, proof) AS (
  SELECT r, source, 0, idx, edited, '' FROM i
  UNION ALL
  SELECT r, f.source, f.level + 1, CASE WHEN f.level + 1 = s.height THEN s.idx ELSE f.idx // {FANOUT} END, sha256(x.a || f.h || x.b), f.proof || x.a || x.b
  FROM (SELECT fold.r, fold.source, fold.level, fold.h, fold.proof, CASE WHEN fold.level = 0 AND s0.height = 0 THEN s0.idx ELSE fold.idx END AS idx FROM fold JOIN s s0 ON fold.source IS NOT DISTINCT FROM s0.source) f
  JOIN s ON f.source IS NOT DISTINCT FROM s.source
  JOIN sides x ON x.source IS NOT DISTINCT FROM f.source AND x.level = f.level AND x.idx = f.idx),
e AS (SELECT r, arg_max(h, level) AS folded_root, arg_max(proof, level) AS proof FROM fold GROUP BY r)
SELECT i.doc_id, i.leaf, s.h AS subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(e.proof) AS proof_sha256, e.folded_root,
       e.folded_root = (SELECT h FROM top WHERE n = 1) AS verified
FROM i JOIN e USING (r) JOIN s ON i.source IS NOT DISTINCT FROM s.source
"""
