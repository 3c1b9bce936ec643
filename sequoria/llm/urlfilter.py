"""URL filters: host and path rules, and gradient-boosted trees on lexical features where no rule speaks.

The labelled URLs are those that a rule speaks on. The trees see length, depth, digit ratio, entropy, parameter counts
and suffix statistics: smoothed block rates of the host's last label and last two labels, over all labelled URLs. A
labelled URL's own rates come from the other folds of hosts, and rates are told in steps of a quarter: what is left out
lowers a fine rate where it was blocked, which would tell the label again. A suffix that the rules speak on throughout,
and always alike, is as neutral as an unknown one: its rate restates the rules and no URL without a rule has it. One that
they are silent on in part has its rate, so that URLs without a rule are judged by it too. Both verdicts weigh the same
in the fit.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, importable_on_workers, materialize, small_side

# Fixed values: (rule, verdict).
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
#: Labelled URLs that the trees are fitted on, by order of a hash; rows of suffix statistics that are broadcast.
SAMPLE_ROWS, BROADCAST_ROWS = 20_000, 100_000
TREES, DEPTH, RATE, BINS, LEAST_LEAF, PRIOR, FOLDS, STEPS = 40, 3, 0.2, 32, 20, 20.0, 5, 4


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; path: from there up to `?`, `#`
    or the end. Both are empty for a null url or one without `://`."""
    form = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(url, form, 1)), F.regexp_extract(url, form, 2)


def matched_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The longest rule whose host is the url's host or above it and whose path begins the url's path; else null."""
    out = None
    for rule, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        at, _, rest = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + rest)
        out = F.when(fits, F.lit(rule)) if out is None else out.when(fits, F.lit(rule))
    return out if out is not None else F.lit(None).cast("string")


def lexical(url: str | None) -> list[float]:
    """Length, depth, digit ratio, entropy of characters, parameters, hyphens in the host, labels of the host."""
    url = url or ""
    rest = url.partition("://")[2] or url
    before, _, query = rest.partition("#")[0].partition("?")
    host, _, path = before.partition("/")
    n = len(url)
    entropy = -sum(c / n * log2(c / n) for c in Counter(url).values()) if n else 0.0
    return [n, len([x for x in path.split("/") if x]), sum(c.isdigit() for c in url) / n if n else 0.0, entropy, query.count("=") + query.count("&"), host.count("-"), host.count(".")]


@dataclass
class Trees:
    """Boosted trees of one depth; node 2i + 1 and 2i + 2 are below node i, go right if value > threshold."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def probability(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), int)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[np.arange(len(x)), f[at]] > t[at])
            score += leaf[at - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-score))


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Logistic gradient boosting with histogram splits. Without rows nothing is blocked; with one class all is it."""
    inner = 2**DEPTH - 1
    both = len(y) and 0 < y.mean() < 1
    base = 0.0 if both else 7.0 if len(y) and y[0] else -7.0
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) if both else np.ones(len(y))
    feature, threshold, leaves = [], [], []
    if both:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
        score = np.full(len(y), base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            g, h = (y - p) * weight, p * (1 - p) * weight
            f, t, at = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(len(y), int)
            for node in range(inner):
                mine = np.flatnonzero(at == node)
                best = (1e-6, 0, None)
                for k, c in enumerate(cuts):
                    if not len(mine) or not len(c):
                        continue
                    b = binned[mine, k]
                    sg, sh, sn = (np.cumsum(np.bincount(b, w, len(c) + 1)) for w in (g[mine], h[mine], np.ones(len(mine))))
                    gain = sg[:-1] ** 2 / (sh[:-1] + 1) + (sg[-1] - sg[:-1]) ** 2 / (sh[-1] - sh[:-1] + 1) - sg[-1] ** 2 / (sh[-1] + 1)
                    gain[(sn[:-1] < LEAST_LEAF) | (sn[-1] - sn[:-1] < LEAST_LEAF)] = -1
                    j = int(gain.argmax())
                    if gain[j] > best[0]:
                        best = (gain[j], k, j)
                if best[2] is not None:
                    f[node], t[node] = best[1], cuts[best[1]][best[2]]
                at[mine] = 2 * node + 1 + (x[mine, f[node]] > t[node])
            leaf = np.bincount(at - inner, g, inner + 1) / (np.bincount(at - inner, h, inner + 1) + 1) * RATE
            score += leaf[at - inner]
            feature.append(f), threshold.append(t), leaves.append(leaf)
    return Trees(base, np.array(feature, int).reshape(-1, inner), np.array(threshold).reshape(-1, inner), np.array(leaves).reshape(-1, inner + 1))


def with_rates(df: DataFrame) -> DataFrame:
    """df (host, ruled: null where no rule speaks) with `last_rate` and `two_rate`, the smoothed block rates of the
    host's suffixes; of labelled rows without the hosts of their fold. A suffix without rows that no rule speaks on has a
    rate only if those other hosts have both verdicts; else it is 0.5, as for unknown ones. Adds last, two and fold too."""
    block, ruled = (F.col("ruled") == "block").cast("double"), F.col("ruled").isNotNull()
    df = df.withColumns({"last": F.substring_index("host", ".", -1), "two": F.substring_index("host", ".", -2), "fold": F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int")})
    for name in ("last", "two"):
        each = lambda v: F.array(*[F.sum(F.when(ruled & (F.col("fold") == k), v).otherwise(0.0)) for k in range(FOLDS)])
        stats = df.groupBy(name).agg(each(block).alias("blocked"), each(F.lit(1.0)).alias("known"), F.count_if(~ruled).alias("silent"))
        mixed = "exists(blocked, x -> x > 0) and blocked <> known"
        stats = materialize(stats.filter(f"exists(known, x -> x > 0) and (silent > 0 or {mixed})"), "suffixes")
        total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
        apart = lambda c: F.coalesce(total(F.col(c)) - F.when(ruled, F.get(c, F.col("fold"))).otherwise(0.0), F.lit(0.0))
        rate = F.round((apart("blocked") + PRIOR * 0.5) / (apart("known") + PRIOR) * STEPS) / STEPS
        told = (F.col("silent") > 0) | ((apart("blocked") > 0) & (apart("blocked") < apart("known")))
        df = df.join(small_side(stats, BROADCAST_ROWS), name, "left").withColumn(f"{name}_rate", F.when(told, rate).otherwise(0.5)).drop("blocked", "known", "silent")
    return df


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, threshold: float = 0.5, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(page_id, host, path, rule, verdict, block_probability) for every row of pages (page_id, url).

    The trees are fitted on at most `rows` urls that a rule speaks on, by order of a hash.
    verdict: the rule's, else block where the trees give more than `threshold`. Null and malformed urls have an empty
    host and path and are judged by the trees. Repeated rows are judged alike; an empty table gives no rows.
    """
    spark = pages.sparkSession
    importable_on_workers(spark)
    host, path = host_and_path(F.col("url"))
    df = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), path.alias("path"))
    df = df.withColumn("rule", matched_rule(F.col("host"), F.col("path"), rules))
    verdicts = F.create_map(*[F.lit(x) for r in rules for x in r]) if rules else F.lit(None)
    df = df.withColumn("ruled", F.try_element_at(verdicts, F.col("rule")) if rules else F.lit(None).cast("string"))
    total, block = df.filter("ruled is not null").count(), (F.col("ruled") == "block").cast("double")
    df = with_rates(df)
    part = min(1.0, 1.5 * rows / max(1, total) + 1e-4)
    mark = F.xxhash64("page_id", "url")
    sample = df.filter("ruled is not null").filter(mark / F.lit(float(2**64)) + 0.5 <= part).orderBy(mark).limit(rows)
    chosen = sample.select("url", "last_rate", "two_rate", block.alias("y")).toArrow().to_pylist()
    x = np.array([[*lexical(r["url"]), r["last_rate"], r["two_rate"]] for r in chosen], float).reshape(-1, 9)
    model = spark.sparkContext.broadcast(boost(x, np.array([r["y"] for r in chosen], float)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls, last, two = (batch.column(k).to_pylist() for k in (1, 6, 7))
            x = np.array([[*lexical(u), a, b] for u, a, b in zip(urls, last, two, strict=True)], float).reshape(-1, 9)
            p = model.value.probability(x)
            verdict = [r or ("block" if q > threshold else "allow") for r, q in zip(batch.column(5).to_pylist(), p.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(batch.column(k) for k in (2, 3, 4)), pa.array(verdict, pa.string()), pa.array(p)], names=["page_id", "host", "path", "rule", "verdict", "block_probability"])

    return df.select("page_id", "url", "host", "path", "rule", "ruled", "last_rate", "two_rate").mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, block_probability double")
