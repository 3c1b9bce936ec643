"""Functions on the letters of many texts at once, in Arrow batches.

Functions of arrays of letters take a call a letter in the engine. Here the letters of a batch are one array of bytes; a
part of at most PART bytes (one text at least) is worked on at a time. Texts with letters beyond ASCII, which the
sequences of this package do not have, are done one by one.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import functions as F

#: Bytes of text that are worked on at a time.
PART = 1 << 20
#: Letters that are compared of all rotations of a batch together; a text that needs more is done by itself.
DEPTH = 24


def _parts(texts: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Slices of texts, null as empty, with their bytes and the places where each begins (one more than texts)."""
    texts = texts.cast(pa.string()).fill_null("")
    if not len(texts):
        return
    held = texts.buffers()
    off = np.frombuffer(held[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(held[2], np.uint8) if held[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = min(max(at + 1, int(np.searchsorted(off, off[at] + PART, "right")) - 1), len(texts))
        yield texts.slice(at, to - at), data[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


def _strings(data: np.ndarray, off: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    out = pa.StringArray.from_buffers(len(off) - 1, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))
    return out if valid is None else pc.if_else(pa.array(valid), out, pa.scalar(None, pa.string()))


def _joined(parts: list[pa.Array], kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def least_turn(text: str | bytes) -> int:
    """Where the least rotation begins, the first of equal ones; in linear time."""
    n, i, j, k = len(text), 0, 1, 0
    while i < n and j < n and k < n:
        a, b = text[(i + k) % n], text[(j + k) % n]
        if a == b:
            k += 1
            continue
        if a > b:
            i += k + 1
        else:
            j += k + 1
        j, k = j + (i == j), 0
    return min(i, j)


def _turns(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where the least rotation of each text begins. Rotations that do not have the least letter at a place are out."""
    n, found = np.diff(off), np.zeros(len(off) - 1, np.int64)
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(data)) - off[row]
    k = 0
    while len(row):
        begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        held = np.diff(np.append(begin, len(row)))
        # one rotation is left, or all that are left are equal
        done = (held == 1) | (n[row[begin]] <= k)
        if done.any():
            found[row[begin[done]]] = at[begin[done]]
            rest = np.repeat(~done, held)
            row, at, held = row[rest], at[rest], held[~done]
            begin = np.cumsum(held) - held
        if not len(row):
            break
        if k == DEPTH:
            for r in row[begin]:
                found[r] = least_turn(data[off[r] : off[r + 1]].tobytes())
            break
        letter = data[off[row] + (at + k) % n[row]] if k else data[off[row] + at]
        keep = letter == np.repeat(np.minimum.reduceat(letter, begin), held)
        row, at, k = row[keep], at[keep], k + 1
    return found


def _canonical(texts: pa.Array) -> pa.Array:
    out = []
    for part, data, off in _parts(texts):
        n = np.diff(off)
        if len(data) and data.max() > 127:
            turned = [(t[(i := least_turn(t)) :] + t[:i]) or None for t in part.to_pylist()]
            out.append(pa.array(turned, pa.string()))
            continue
        row = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(data)) + _turns(data, off)[row]
        at -= np.where(at >= off[row + 1], n[row], 0)
        out.append(_strings(data[at], off, n > 0))
    return _joined(out, pa.string())


def _kmers(texts: pa.Array, k: int, cyclic: bool) -> pa.Array:
    kind, out = pa.list_(pa.string()), []
    for part, data, off in _parts(texts):
        n = np.diff(off)
        if k > 5 or (len(data) and data.max() > 127):  # a window and its text's number are to fit 64 bits
            wrapped = [t + t[: k - 1] if cyclic and len(t) >= k else t for t in part.to_pylist()]
            out.append(pa.array([list(dict.fromkeys(t[i : i + k] for i in range(max(1, len(t) - k + 1)))) for t in wrapped], kind))
            continue
        windows = np.where(n < k, 1, n if cyclic else n - k + 1)
        row = np.repeat(np.arange(len(n)), windows)
        at = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
        full, m = n[row] >= k, np.maximum(n[row], 1)
        key = row.astype(np.uint64) << np.uint64(8 * k)
        for i in range(k if len(data) else 0):
            key |= np.where(full, data[np.minimum(off[row] + (at + i) % m, len(data) - 1)], 0).astype(np.uint64) << np.uint64(8 * (k - 1 - i))
        first = np.sort(np.unique(key, return_index=True)[1])
        row, at = row[first], at[first]
        size = np.minimum(n[row], k)
        begin = np.cumsum(size) - size
        which = np.repeat(np.arange(len(row)), size)
        inside = at[which] + np.arange(len(which)) - begin[which]
        letters = data[off[row][which] + inside % m[first][which]]
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(n)))])
        out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _strings(letters, np.append(begin, len(letters)))))
    return _joined(out, kind)


def _pieces(texts: pa.Array, ends: str, most: int, others: str) -> pa.Array:
    mark, table = 1, np.zeros(256, np.uint8)
    for c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        table[c] = table[c + 32] = c
    table[list(ends.encode())] = mark
    own = np.ones(256, bool)
    own[list(others.encode())] = False
    kind, out = pa.list_(pa.struct([("raw", pa.string()), ("seq", pa.string())])), []
    for _, data, off in _parts(texts):
        seen = table[data]
        place = np.flatnonzero(seen > mark)
        letters, texts_at = seen[place], np.searchsorted(place, off)
        cuts = np.unique(np.concatenate([texts_at[:-1], np.searchsorted(place, np.flatnonzero(seen == mark))]))
        cuts = cuts[cuts < len(letters)]
        runs = np.diff(np.append(cuts, len(letters)))
        many = -(-runs // most)
        starts = np.repeat(cuts, many) + most * (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
        raw = np.append(starts, len(letters))
        kept = own[letters]
        upto = np.concatenate([[0], np.cumsum(kept)])
        pieces = pa.StructArray.from_arrays([_strings(letters, raw), _strings(letters[kept], upto[raw])], ["raw", "seq"])
        out.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, texts_at), pa.int32()), pieces))
    return _joined(out, kind)


#: Terms of a sum: a letter, a value, and whether its count is multiplied by it, divided by it, or divided and taken off.
Terms = tuple[tuple[str, float, str], ...]


def _composition(texts: pa.Array, alphabet: str, groups: tuple[str, ...], sums: tuple[Terms, ...], sets: tuple[str, ...]) -> pa.Array:
    code, group, g = np.full(256, len(alphabet)), np.full(256, len(groups)), len(groups) + 1
    code[list(alphabet.encode())] = np.arange(len(alphabet))
    for i, letters in enumerate(groups):
        group[list(letters.encode())] = i
    width, out = len(alphabet) + 1, []
    for _, data, off in _parts(texts):
        n = np.diff(off)
        row, at = np.repeat(np.arange(len(n)), n), np.arange(len(data))
        follows = np.where(at + 1 < off[row + 1], at + 1, off[row])
        a, b = group[data], group[data[follows]]
        counts = np.bincount(row * width + code[data], minlength=len(n) * width).reshape(-1, width)[:, :-1]
        pairs = np.bincount((row * g + np.minimum(a, b)) * g + np.maximum(a, b), minlength=len(n) * g * g).reshape(-1, g, g)
        of = lambda letter, counts=counts: counts[:, alphabet.index(letter)]
        made = []
        for terms in sums:  # in the order of the terms, so that the last digits are those of such a sum elsewhere
            total = np.zeros(len(n))
            for letter, value, how in terms:
                total = total + of(letter) * value if how == "*" else total + of(letter) / value if how == "/" else total - of(letter) / value
            made.append(total)
        shares = [*made, *[sum(of(x) for x in letters) for letters in sets], *counts.T, *pairs[:, *np.triu_indices(len(groups))].T]
        with np.errstate(invalid="ignore", divide="ignore"):
            both = np.stack([*made, *[x / n for x in shares]], axis=1)
        out.append(pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * both.shape[1], pa.int32()), pa.array(both.ravel())))
    return _joined(out, pa.list_(pa.float64()))


def _made(f: Callable[[pa.Array], pa.Array], kind: str) -> Callable:
    def run(texts: pa.Array) -> pa.Array:
        return f(texts)

    return F.arrow_udf(run, kind)


def canonical() -> Callable:
    """The least rotation of a text, null for none or an empty one."""
    return _made(_canonical, "string")


def kmers(k: int, cyclic: bool) -> Callable:
    """The distinct windows of k letters, in order of first occurrence; a shorter text is its only one."""
    return _made(lambda texts: _kmers(texts, k, cyclic), "array<string>")


def pieces(ends: str, most: int, others: str) -> Callable:
    """The letters A-Z of a text, in upper case, cut at the marks `ends` and after `most` letters: as they are, and without
    the letters `others`."""
    return _made(lambda texts: _pieces(texts, ends, most, others), "array<struct<raw:string,seq:string>>")


def composition(alphabet: str, groups: tuple[str, ...], sums: tuple[Terms, ...], sets: tuple[str, ...]) -> Callable:
    """Sums over the letters of a text; then by its length: these sums, how often it has a letter of each set, each letter,
    and how often neighbours, last and first included, are of each pair of groups in either order."""
    return _made(lambda texts: _composition(texts, alphabet, groups, sums, sets), "array<double>")


# what runs in workers brings this module's functions along
cloudpickle.register_pickle_by_value(sys.modules[__name__])
