"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built of a bounded sample of labelled text. A text is parsed greedily into the
longest phrases that occur in the sample; the language that needs the fewest phrases, normalised by what a phrase
costs there, wins. The automata are transition tables, walked for many stretches of text at once.
"""

from __future__ import annotations

import random
import threading
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import importable_on_workers, lean, materialize, output_schema, small_side

#: Characters of labelled text of each language, and documents that they are taken from.
SAMPLE_CHARS, SAMPLE_DOCS = 16_384, 64
#: All samples together; with very many languages each gets a smaller one.
SAMPLE_TOTAL = 8_000_000
#: Characters that are walked one after the other. Stretches of a text are walked at once, then joined: a phrase goes on
#: over their border.
STRETCH = 512
#: A sample of up to so many characters gets a dense table; one of more a sparse one, with the same results.
SYMBOLS = 62
UNDETERMINED = "und"
_NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")


def letters(text: str | None) -> str:
    """Lower-cased letters and marks; whatever is between them becomes one space."""
    return _NOT_LETTERS.sub(" ", unicodedata.normalize("NFC", text or "").lower()).strip()


def automaton(sample: str) -> tuple[list[dict[str, int]], list[int]]:
    """Suffix automaton: transitions of each state, and suffix links."""
    nxt, link, length, last = [{}], [-1], [0], 0
    for c in sample:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt, link


class Parser:
    """Counts phrases of many texts against one sample, over all characters that the sample has."""

    def __init__(self, sample: str):
        kept = [c for c, _ in Counter(sample).most_common()]
        self.symbol = {c: i for i, c in enumerate(kept)}
        self.width = len(kept) + 2  # the last two: any other character, padding
        nxt, _ = automaton(sample)
        nxt.append({})  # a state without a way on: every text starts there, and a character that the sample lacks leads there
        self.none = len(nxt) - 1
        self.root = np.full(self.width, self.none, np.int32)
        for c, s in nxt[0].items():
            self.root[self.symbol[c]] = s
        self.dense = len(kept) <= SYMBOLS
        self._fill_dense(nxt) if self.dense else self._fill_sparse(nxt)
        lookup = np.full(max(map(ord, kept), default=0) + 2, len(kept), np.uint8 if self.width <= 256 else np.uint32)
        for c, i in self.symbol.items():
            lookup[ord(c)] = i
        self.lookup = lookup
        self.cost = np.log2(max(len(sample), 2))

    def _fill_dense(self, nxt: list[dict[str, int]]) -> None:
        w = self.width
        table = np.empty((len(nxt), w), np.int32)
        table[:] = ~(self.root * w)[None, :]  # no transition: a phrase begins
        for s, to in enumerate(nxt):
            for c, t in to.items():
                table[s, self.symbol[c]] = t * w
        table[:, w - 1] = np.arange(len(nxt), dtype=np.int32) * w  # padding stays where it is
        self.table, self.none = table.ravel(), self.none * w

    def _fill_sparse(self, nxt: list[dict[str, int]]) -> None:
        """Rows of all states laid over each other: a state's transition by x is at base + x, if that place is its own."""
        room = 4 * sum(map(len, nxt))
        taken, base, placed, dice = bytearray(room + self.width), np.zeros(len(nxt), np.int64), [], random.Random(0)
        for s in sorted(range(len(nxt)), key=lambda s: -len(nxt[s])):
            row = [(self.symbol[c], t) for c, t in nxt[s].items()]
            for _ in range(64):
                at = dice.randrange(room)
                if not any(taken[at + x] for x, _ in row):
                    break
            else:  # a row of its own
                at = len(taken)
                taken.extend(bytes(self.width))
            base[s] = at
            for x, t in row:
                taken[at + x] = 1
                placed.append((at + x, s, t))
        where, owner, to = np.array(placed).T
        self.base, self.owner, self.to = base, np.full(len(taken), -1, np.int32), np.zeros(len(taken), np.int32)
        self.owner[where], self.to[where] = owner, to

    def _step(self, state: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States after one more symbol each, and -1 where that began a phrase, else 0."""
        if self.dense:
            to = self.table.take(state + row)
            ended = to >> 31
            return to ^ ended, ended
        at = self.base.take(state) + row  # padding comes last, so its state does not matter
        on = self.owner.take(at) == state
        return np.where(on, self.to.take(at), self.root.take(row)), -(~on & (row != self.width - 1)).astype(np.int32)

    def phrases(self, points: np.ndarray, follows: np.ndarray, before: int = 0) -> tuple[np.ndarray, int]:
        """points: (STRETCH, n) code points, 0 as padding; follows: which columns go on with the text of the column
        before; before: the state that the first column goes on from. Phrases that begin in each column, and the last
        column's state at its end.

        All columns are walked afresh first. Those that go on with a text are then walked again from where the column
        before them ended, beside the first walk, up to the symbol at which both are in one state.
        """
        symbols = self.lookup[np.minimum(points, len(self.lookup) - 1)]
        symbols[points == 0] = self.width - 1
        n = points.shape[1]
        end, count = np.full(n, self.none, np.int32), np.zeros(n, np.int32)
        for row in symbols:
            end, began = self._step(end, row)
            count -= began
        todo, fresh, fresh_end = np.flatnonzero(follows), count.copy(), end.copy()
        while len(todo):
            at, a, b = todo, np.where(todo > 0, end[todo - 1], before).astype(np.int32), np.full(len(todo), self.none, np.int32)
            old = end[todo].copy()
            count[todo], end[todo] = fresh[todo], fresh_end[todo]
            for row in symbols:
                apart = a != b
                if not apart.all():
                    at, a, b = at[apart], a[apart], b[apart]
                if not len(at):
                    break
                a, x = self._step(a, row[at])
                b, y = self._step(b, row[at])
                count[at] += y - x
            end[at] = a  # no common state in the whole stretch, or at its very end
            moved = todo[end[todo] != old] + 1
            moved = moved[moved < n]
            todo = moved[follows[moved]]
        return count, int(end[-1]) if n else before


_PARSERS: dict[int, tuple[list[str], list[Parser]]] = {}
_LOCK = threading.Lock()


def parsers(samples: dict[str, str]) -> tuple[list[str], list[Parser]]:
    """The worker keeps the parsers of the last samples."""
    mark = hash(tuple(sorted(samples.items())))
    with _LOCK:
        if mark not in _PARSERS:
            _PARSERS.clear()
            names = sorted(samples)
            _PARSERS[mark] = names, [Parser(samples[x]) for x in names]
        return _PARSERS[mark]


def stretches(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(STRETCH, n) code points of all stretches, and the text that each belongs to."""
    owner, cols = [], []
    for k, text in enumerate(texts):
        if text:
            owner += [k] * -(-len(text) // STRETCH)
            cols.append(text + "\0" * (-len(text) % STRETCH))
    points = np.frombuffer("".join(cols).encode("utf-32-le"), np.uint32).reshape(-1, STRETCH)
    return np.ascontiguousarray(points.T), np.asarray(owner, np.int64)


def predict(texts: list[str | None], samples: dict[str, str]) -> tuple[list[str], list[float]]:
    """Language and score of each text. Ties go to the first name by code point."""
    names, tools = parsers(samples)
    langs, scores = [], []
    norm = [letters(t) for t in texts]
    at = 0
    while at < len(norm):  # about 4 M characters at a time, one text at least
        to, total = at, 0
        while to < len(norm) and (to == at or total + len(norm[to]) <= 4_000_000):
            total += len(norm[to])
            to += 1
        part = norm[at:to]
        at = to
        points, owner = stretches(part)
        bits = np.zeros((len(tools), len(part)))
        follows, ends = np.diff(owner, prepend=-1) == 0, [0] * len(tools)
        for i in range(0, len(owner), 8192):
            p, o = np.ascontiguousarray(points[:, i : i + 8192]), owner[i : i + 8192]
            for k, tool in enumerate(tools):
                count, ends[k] = tool.phrases(p, follows[i : i + 8192], ends[k])
                bits[k] += np.bincount(o, count, len(part)) * tool.cost
        size = np.array([max(len(x), 1) for x in part])
        each = bits / size  # bits a character
        best = each.argmin(axis=0) if tools else np.zeros(len(part), int)
        for k, text in enumerate(part):
            if not tools or not any(c.isalpha() for c in text):
                langs.append(UNDETERMINED), scores.append(0.0)
                continue
            gap = np.exp2(-(each[:, k] - each[best[k], k]) * min(len(text), 16))
            langs.append(names[best[k]]), scores.append(float(1 / gap.sum()))
    return langs, scores


def samples(docs: DataFrame, learn: Column, chars: int = SAMPLE_CHARS, n_docs: int = SAMPLE_DOCS, total: int = SAMPLE_TOTAL) -> dict[str, str]:
    """A bounded sample of text for each label among the rows that `learn` admits: `n_docs` distinct texts that have a
    letter, by order of a hash, cut to equal parts from their first letter on. A label with such a text is never lost. The bound is labels x chars,
    at most `total` in all: with more than total / chars labels each gets a smaller sample."""
    known = docs.filter(learn).filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text", F.xxhash64("text").alias("h"))
    # copies count once; each task passes on its least hashes only, before the rows of a label meet
    first = known.select("lang", "h", F.shiftright("h", 58).alias("part")).distinct()
    for by in (["lang", "part"], ["lang"]):  # 64 ranges of hashes first, so that a common language meets in small numbers
        first = first.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy("h"))).filter(F.col("k") <= n_docs)
    near = known.join(small_side(materialize(first.select("lang", "h"), "least")), ["lang", "h"])
    each = max(1, chars // min(n_docs, 16))
    start = F.regexp_replace("text", r"^[^\p{L}]+", "")
    near = near.select("lang", "h", F.substring(start, 1, 4 * each).alias("text")).distinct()
    ranked = near.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).filter(F.col("k") <= n_docs)
    out: dict[str, list[str]] = {}
    for lang, text in ranked.orderBy("lang", "k").select("lang", "text").toLocalIterator():
        held = out.setdefault(lang, [])
        if (room := chars - sum(map(len, held))) > 0:
            held.append(letters(text)[: min(2 * each, room)] + " ")
    most = total // max(1, len(out))
    return {k: s[:most] for k, v in out.items() if (s := "".join(v)).strip()}


PREDICTED = "lang_pred string, score double"


def identify(docs: DataFrame, model: dict[str, str]) -> DataFrame:
    """docs (text, any other columns) with lang_pred and score added, for every row.

    lang_pred is `und` with score 0 if the text is null or has no letter, or if nothing was learned. score is the
    winner's share when each language weighs 2 to minus its excess bits of 16 characters. Ties go to the first name.
    Columns of docs named lang_pred or score are an error.
    """
    importable_on_workers(docs.sparkSession)
    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")
    schema = output_schema(docs, PREDICTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                langs, scores = predict(part.column(at).to_pylist(), held.value)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*part.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(lean(run), schema)
