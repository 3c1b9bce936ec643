"""Embedding near-duplicates by hierarchical navigable small-world graphs, one for each shard of a label.

Equal vectors of a label become one with a weight. They are dealt to shards by a hash of their id; each shard gets a
graph, and every vector queries every shard of its label: a beam search for many queries at once, whose hits near the
threshold name the groups of like vectors that the graph's own links make; cosines with all of a group are verified in
double precision. Each task audits itself, on queries and on planted near copies of its own vectors, against a full scan
of those, and widens beam and margin until the audit passes; a task that never passes scans in full. A task returns a
count for each vector and a spanning set of its links, not the links, so a group of m like vectors gives m rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import importable_on_workers, materialize, mixed, small_side
from .components import connected_components

#: Vectors of a shard, their bytes, neighbours of a node, beam while building.
SHARD, SHARD_BYTES, NEIGHBOURS, BUILD = 32_768, 16_000_000, 10, 40
#: First beam and margin under the threshold, one query in so many is audited, recall that passes, widenings tried.
BEAM, MARGIN, AUDIT, PASS, WIDENINGS = 40, 0.01, 50, 0.999, 4
#: Planted near copies in an audit.
PLANTED = 256
#: Queries searched at once, nodes that each of them opens in a step, cosines verified at once, numbers of the equal
#: vectors that are broadcast at most.
BLOCK, OPENED, CELLS, BROADCAST = 256, 4, 2_000_000, 2_000_000


def _spread(x: np.ndarray, ids: np.ndarray, likeness: np.ndarray, most: int) -> np.ndarray:
    """For each row of candidates (-1: none): those nearer to the node than to each other, the likest of the rest after
    them; `most` in all."""
    order = np.argsort(-likeness, axis=1, kind="stable")
    ids, likeness = np.take_along_axis(ids, order, 1), np.take_along_axis(likeness, order, 1)
    points = x[ids]
    between = points @ points.transpose(0, 2, 1)
    kept, to_kept, count = np.zeros(ids.shape, bool), np.full(ids.shape, -np.inf, np.float32), np.zeros(len(ids), int)
    for a in range(ids.shape[1]):
        takes = (to_kept[:, a] < likeness[:, a]) & (ids[:, a] >= 0) & (count < most)
        kept[takes, a] = True
        to_kept[takes] = np.maximum(to_kept[takes], between[takes, a])
        count += takes
    rank = np.where(kept, 0, np.where(ids >= 0, 1, 2))
    return np.take_along_axis(ids, np.argsort(rank, axis=1, kind="stable")[:, :most], 1)


class Graph:
    """Hierarchical graph over unit vectors. The level of a node is drawn from a hash of its position; `order` puts
    higher levels first, so that a level is a prefix of it, and links are positions in it (-1: none)."""

    def __init__(self, unit: np.ndarray):
        u = (mixed(np.arange(1, len(unit) + 1, dtype=np.uint64)).astype(np.float64) + 1) / 2.0**64
        level = np.minimum((-np.log(u) / np.log(NEIGHBOURS)).astype(int), 12)
        self.order = np.argsort(-level, kind="stable")
        self.x = unit[self.order].astype(np.float32)
        self.levels: list[np.ndarray] = []  # from the top down
        for k in range(level.max(), -1, -1):
            self._add_level(int((level >= k).sum()), NEIGHBOURS * (2 if k == 0 else 1))

    def search(self, q: np.ndarray, enter: np.ndarray, beam: int, links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The `beam` likest nodes (-1: none) that are found from each query's entry node over the links, and their
        likeness, in no order."""
        row = np.arange(len(q))
        seen = np.zeros((len(q), len(links) + 1), bool)  # the last one stands for no node
        seen[:, -1] = True
        ids, s = np.full((len(q), beam), -1, np.int64), np.full((len(q), beam), -np.inf, np.float32)
        ids[:, 0], s[:, 0] = enter, np.einsum("ij,ij->i", self.x[enter], q)
        seen[row, enter] = True
        todo = ids >= 0
        while len(row := np.flatnonzero(todo.any(axis=1))):
            open_ = np.where(todo[row], s[row], -np.inf)
            pick = np.argpartition(-open_, min(OPENED, beam) - 1, axis=1)[:, :OPENED]
            used = np.take_along_axis(todo[row], pick, 1)
            todo[row[:, None], pick] = False
            near = np.where(used[:, :, None], links[ids[row[:, None], pick]], -1).reshape(len(row), -1)
            near.sort(axis=1)
            fresh = ~seen[row[:, None], near]
            fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
            seen[row[:, None], near] = True
            at, col = np.nonzero(fresh)
            likeness = np.full(near.shape, -np.inf, np.float32)
            likeness[at, col] = np.einsum("ij,ij->i", self.x[near[at, col]], q[row[at]])
            all_s = np.concatenate([s[row], likeness], axis=1)
            best = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
            s[row] = np.take_along_axis(all_s, best, 1)
            ids[row] = np.take_along_axis(np.concatenate([ids[row], np.where(fresh, near, -1)], axis=1), best, 1)
            todo[row] = np.take_along_axis(np.concatenate([todo[row], fresh], axis=1), best, 1)
        return ids, s

    def _entries(self, q: np.ndarray) -> np.ndarray:
        """The node by which each query enters the level under those that stand."""
        at = np.zeros(len(q), np.int64)
        for links in self.levels:
            at = self.search(q, at, 1, links)[0][:, 0]
        return at

    def _add_level(self, size: int, most: int) -> None:
        """Nodes come in batches; each sees those before it by a search, and its own batch in full."""
        links, held = np.full((size, most), -1, np.int64), len(self.levels[-1]) if self.levels else 0
        done = 1
        while done < size:
            upto = min(held if done < held else size, done + min(BLOCK, max(1, done // 4)))
            q, own = self.x[done:upto], np.arange(done, upto)
            enter = self._entries(q) if held and done >= held else np.zeros(len(q), np.int64)
            ids, s = self.search(q, enter, BUILD, links[:done])
            batch = q @ q.T
            np.fill_diagonal(batch, -np.inf)
            few = np.argsort(-batch, axis=1, kind="stable")[:, : min(NEIGHBOURS, len(q) - 1)]
            ids = np.concatenate([ids, few + done], axis=1)
            chosen = _spread(self.x, ids, np.concatenate([s, np.take_along_axis(batch, few, 1)], axis=1), NEIGHBOURS)
            links[done:upto, : chosen.shape[1]] = chosen
            a, col = np.nonzero(chosen >= 0)
            self._link_back(links, chosen[a, col], own[a])
            done = upto
        self.levels.append(links)

    def _link_back(self, links: np.ndarray, to: np.ndarray, new: np.ndarray) -> None:
        """Adds `new` to the links of `to`; nodes that have too many then spread theirs."""
        order = np.argsort(to, kind="stable")
        to, new = to[order], new[order]
        nodes, start, count = np.unique(to, return_index=True, return_counts=True)
        by_count = np.argsort(count, kind="stable")
        for part in (by_count[i : i + 64] for i in range(0, len(nodes), 64)):
            more = np.full((len(part), count[part].max()), -1, np.int64)
            at = np.arange(more.shape[1])[None] < count[part][:, None]
            more[at] = new[(start[part][:, None] + np.arange(more.shape[1])[None])[at]]
            more[(more[:, :, None] == links[nodes[part]][:, None]).any(axis=2)] = -1  # linked already
            ids = np.concatenate([links[nodes[part]], more], axis=1)
            s = np.where(ids >= 0, (self.x[ids] @ self.x[nodes[part]][:, :, None])[:, :, 0], -np.inf)
            links[nodes[part]] = _spread(self.x, ids, s, links.shape[1])

    def near(self, q: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, position of a vector) for what the beams of the queries hold of likeness `least` and more."""
        got = []
        for i in range(0, len(q), BLOCK):
            part = q[i : i + BLOCK]
            enter = np.zeros(len(part), np.int64)
            for links in self.levels[:-1]:
                enter = self.search(part, enter, 1, links)[0][:, 0]
            ids, s = self.search(part, enter, beam, self.levels[-1])
            at, col = np.nonzero(s >= least)
            got.append((at + i, self.order[ids[at, col]]))
        return np.concatenate([a for a, _ in got]), np.concatenate([b for _, b in got])

    def strong(self, least: float) -> tuple[np.ndarray, np.ndarray]:
        """The links of the lowest level between vectors of likeness `least` and more."""
        links, ends = self.levels[-1], []
        for i in range(0, len(links), BLOCK):
            at, col = np.nonzero(links[i : i + BLOCK] >= 0)
            to = links[i : i + BLOCK][at, col]
            like = np.einsum("ij,ij->i", self.x[at + i], self.x[to]) >= least
            ends.append((self.order[at[like] + i], self.order[to[like]]))
        return np.concatenate([a for a, _ in ends]), np.concatenate([b for _, b in ends])


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the groups that the links (a, b) connect have become one; a label is the least node of its group."""
    while len(a):
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        differ = low < high
        a, b = a[differ], b[differ]
        label = label.copy()
        np.minimum.at(label, high[differ], low[differ])
        while (label != (next_ := label[label])).any():
            label = next_
    return label


def _blocks(label: np.ndarray, query: np.ndarray, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Queries and the members of a group that they are to be compared with, in blocks of at most CELLS pairs (one query
    at least)."""
    members, order = np.argsort(label, kind="stable"), np.argsort(group, kind="stable")
    query, group = query[order], group[order]
    for g, start, n in zip(*np.unique(group, return_index=True, return_counts=True), strict=True):
        own = members[np.searchsorted(label, g, "left", sorter=members) : np.searchsorted(label, g, "right", sorter=members)]
        step = max(1, CELLS // len(own))
        for i in range(start, start + n, step):
            yield query[i : min(i + step, start + n)], own


def planted(own: np.ndarray, least: float) -> np.ndarray:
    """Near copies of evenly spaced vectors, with cosines between `least` and 1 to them; the same ones in each run."""
    r = np.random.default_rng(len(own))
    base = own[np.linspace(0, len(own) - 1, min(PLANTED, len(own))).astype(int)]
    aside = r.normal(size=base.shape)
    aside -= np.einsum("ij,ij->i", aside, base)[:, None] * base
    size = np.linalg.norm(aside, axis=1)[:, None]
    aside = np.divide(aside, size, out=np.zeros_like(aside), where=size > 1e-9)
    cosine = r.uniform(least + 0.05 * (1 - least), 1, (len(base), 1))
    got = cosine * base + np.sqrt(1 - cosine**2) * aside
    return got / np.linalg.norm(got, axis=1)[:, None]


def links_of(graph: Graph, own: np.ndarray, queries: np.ndarray, least: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks (queries, positions in `own`, whether the cosine is `least` and more) with every pair once that may be
    linked; audited. own and queries are unit vectors in double. same: the queries are the vectors themselves.

    The audit holds one query in AUDIT and PLANTED near copies against a full scan; the mean recall of those with links
    must pass (a hit on itself tells nothing).
    """
    tests = np.arange(0, len(queries), AUDIT)
    probes = np.concatenate([queries[tests], planted(own, least)])
    single, everything = queries.astype(np.float32), np.zeros(len(own), np.int64)
    beam, margin = BEAM, MARGIN

    def hits(vectors: np.ndarray, a: np.ndarray, b: np.ndarray, itself: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Groups of `own`, and which query is to be compared with which group."""
        label = joined(np.arange(len(own)), *graph.strong(least - margin))
        if itself:
            label = joined(label, a, b)
            return label, np.arange(len(own)), label
        pairs = np.unique(a * len(own) + label[b]) if len(a) else np.empty(0, np.int64)
        return label, pairs // len(own), pairs % len(own)

    for _ in range(WIDENINGS):
        a, b = graph.near(single, least - margin, beam)
        found = hits(queries, a, b, same)
        pa_, pb = graph.near(probes[len(tests) :].astype(np.float32), least - margin, beam)
        chosen = np.isin(found[1], tests)
        where = np.searchsorted(tests, found[1][chosen])
        label, q2, g2 = hits(probes[len(tests) :], pa_, pb, False)
        caught, want = np.zeros(len(probes)), np.zeros(len(probes))
        for lab, q, g in ((found[0], where, found[2][chosen]), (label, q2 + len(tests), g2)):
            for rows, cols in _blocks(lab, q, g):
                caught[rows] += (probes[rows] @ own[cols].T >= least).sum(axis=1)
        for rows, cols in _blocks(everything, np.arange(len(probes)), np.zeros(len(probes), np.int64)):
            want[rows] += (probes[rows] @ own[cols].T >= least).sum(axis=1)
        if same:
            caught[: len(tests)] -= 1
            want[: len(tests)] -= 1
        linked = want > 0
        if not linked.any() or np.mean(caught[linked] / want[linked]) >= PASS:
            break
        beam, margin = beam * 2, margin * 2
    else:
        found = everything, np.arange(len(queries)), np.zeros(len(queries), np.int64)
    for rows, cols in _blocks(*found):
        yield rows, cols, queries[rows] @ own[cols].T >= least


def _unit(raw: bytes, dim: int) -> np.ndarray:
    x = np.frombuffer(raw, np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1)[:, None]  # squares of very large or small parts stay finite
    return x / np.linalg.norm(x, axis=1)[:, None]


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            label, dim, shard = (batch.column(k)[i].as_py() for k in range(3))
            rows = batch.column(3).slice(i, 1).flatten()
            ids = rows.field("vec_id").to_numpy()
            order = np.argsort(ids)
            raw = rows.field("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)[order].tobytes()
            ids, copies = ids[order].astype(np.int64), rows.field("w").to_numpy()[order].astype(np.int64)
            graph = pickle.dumps(Graph(_unit(raw, dim)), 5)
            yield pa.RecordBatch.from_arrays([pa.array([label], pa.int64()), pa.array([dim], pa.int32()), pa.array([shard], pa.int32()), *(pa.array([x], pa.binary()) for x in (ids.tobytes(), copies.tobytes(), raw, graph))], names=["label", "dim", "shard", "ids", "copies", "vectors", "graph"])


def _query(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                dim, same, ids, copies, raw, graph, q_ids, q_raw = (batch.column(c)[k].as_py() for c in range(8))
                ids, copies, q_ids = (np.frombuffer(x, np.int64) for x in (ids, copies, q_ids))
                own = _unit(raw, dim)
                nodes, first = (ids, 0) if same else (np.concatenate([ids, q_ids]), len(ids))
                counts, label = np.zeros(len(q_ids), np.int64), np.arange(len(nodes))
                for rows, cols, linked in links_of(pickle.loads(graph), own, own if same else _unit(q_raw, dim), least, same):
                    if same:
                        linked &= rows[:, None] != cols[None]
                    counts[rows] += linked @ copies[cols]
                    at, col = np.nonzero(linked)
                    label = joined(label, rows[at] + first, cols[col])
                ends = np.flatnonzero(label != np.arange(len(label)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([q_ids, nodes[ends]])), pa.array([None] * len(q_ids) + nodes[label[ends]].tolist(), pa.int64()), pa.array(np.concatenate([counts, np.zeros(len(ends), np.int64)]))], names=["a", "b", "n"])

    return run


def near_duplicates(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding, label).

    Vectors of one label (not null) and length are linked if their cosine is at least `least`. Null or zero vectors,
    and those with null or non-finite parts, link with nothing. Repeated rows count as one vector; of differing rows
    with one id the least (label, embedding) counts. Rows without id: 0 links, no component, not kept.
    """
    spark = vectors.sparkSession
    importable_on_workers(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    sound = "label is not null and vec_id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)"
    once = rows.filter(sound).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x")).select("vec_id", "x.*")
    once = materialize(once, "vectors")
    # equal vectors of a label are one, named by their least id; a cosine with itself is 1
    kinds = materialize(once.groupBy("label", "v").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("w")).withColumn("dim", F.size("v")), "kinds")
    per_shard = F.greatest(F.lit(1), F.least(F.lit(SHARD), F.floor(F.lit(SHARD_BYTES) / (8 * F.col("dim")))))
    shards = kinds.groupBy("label", "dim").agg(F.count("*").alias("n")).select("label", "dim", F.ceil(F.col("n") / per_shard).cast("int").alias("shards"))
    dealt = kinds.join(shards, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int"))
    grouped = dealt.groupBy("label", "dim", "shard").agg(F.collect_list(F.struct("vec_id", "w", "v")).alias("rows"))
    graphs = materialize(grouped.mapInArrow(_build, "label long, dim int, shard int, ids binary, copies binary, vectors binary, graph binary"), "graphs")
    asks = graphs.select("label", "dim", F.col("shard").alias("q_shard"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    both = graphs.join(asks, ["label", "dim"]).repartition(F.col("label"), F.col("dim"), F.col("shard"), F.col("q_shard"))
    found = both.select("dim", (F.col("shard") == F.col("q_shard")).alias("same"), "ids", "copies", "vectors", "graph", "q_ids", "q_vectors").mapInArrow(_query(least), "a long, b long, n long")
    found = materialize(found, "links")
    counts = found.filter("b is null").groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "vec_id")
    parts = connected_components(found.filter("b is not null").select("a", "b")).select(F.col("node").alias("vec_id"), "component")
    each = kinds.join(counts, "vec_id", "left").join(parts, "vec_id", "left")
    each = materialize(each.select("vec_id", "label", "v", "w", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component")), "linked")
    repeated = each.filter("w > 1").select("label", "v", "n_links", "component")
    widest = repeated.agg(F.max(F.size("v"))).first()[0]
    linked = each.filter("w = 1").select("vec_id", "n_links", "component")
    if widest:
        linked = linked.union(once.join(small_side(repeated, BROADCAST // widest), ["label", "v"]).select("vec_id", "n_links", "component"))
    out = rows.select("vec_id").join(linked, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
