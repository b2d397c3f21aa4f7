"""Benchmark decontamination by q-gram lemma filtering (operator 9).

Texts and items are normalised (case, marks and white space folded). An item is cut into overlapping windows; a
window of m characters with k edits shares at least m - q + 1 - k q of its q-grams with the text on diagonals that
lie within k of each other. Shared q-grams are counted in overlapping bands of diagonals, bands that meet the bound
are verified by banded alignment. Items too short for that are matched exactly, as runs of whole words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import textvec as tv
from spanloom.llm.common import slices, table, tidy

#: q-gram length (eight bytes are one machine word), window and its step (normalised bytes), edits as a share of a window, least item matched with edits.
Q, WINDOW, STEP, EDITS, LEAST = 8, 80, 40, 0.1, 24
#: Windows a step. They lie no further apart than twice the edits of one and one more (17), so that any verbatim stretch of a window's length is within the edits of some window.
FINER = 3
#: Bytes of benchmark items that one pass over the documents looks for; a larger benchmark takes more passes.
PASS_BYTES = 1 << 20
#: Text bytes that are searched together.
SLICE = 1 << 20
_FILTER_BITS = 22
_MUL = tv.U64(0x9E3779B97F4A7C15)
_KEEP = np.zeros(256, np.uint8)
_KEEP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = [*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]
_KEEP[_KEEP == 0] = 32


def normalise(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, row offsets, place of each byte in ``buf``): lower case, runs of other bytes as one space, none at a text's start."""
    x = _KEEP[tv.fold(buf)]
    n = len(x)
    if not n:
        return x, off, np.zeros(0, np.int64)
    space = x == 32
    drop = np.zeros(n, bool)
    drop[1:] = space[1:] & space[:-1]
    begin = off[:-1][off[:-1] < n]
    drop[begin] = space[begin]
    kept = np.flatnonzero(~drop)
    return x[kept], np.searchsorted(kept, off), kept


def grams(x: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one number."""
    if len(x) < Q:
        return np.zeros(0, tv.U64)
    a = x.astype(tv.U64)
    a = a[:-1] | (a[1:] << tv.U64(8))
    a = a[:-2] | (a[2:] << tv.U64(16))
    return a[:-4] | (a[4:] << tv.U64(32))


@dataclass
class Patterns:
    item: list  # item id of each window, then of each short item
    text: np.ndarray  # windows x WINDOW bytes, 0 beyond the end
    size: np.ndarray
    places: np.ndarray  # windows x 256, as symbol_places has them
    shift: np.ndarray  # where a window begins in its item
    least: np.ndarray  # of each long item: the fewest grams that one of its windows needs
    gram: np.ndarray  # sorted distinct grams
    start: np.ndarray  # their postings: number and place of the long item, the first window that holds the gram, and how many do
    long: np.ndarray
    place: np.ndarray
    first: np.ndarray
    count: np.ndarray
    bits: np.ndarray  # filter
    short: dict  # number of words -> (hashes, bytes -> places in ``item``) of the items under LEAST


def word_runs(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n words in a row."""
    m = len(h) - n + 1
    out = h[:m].copy()
    for k in range(1, n):
        out = tv.mix(out * _MUL + h[k : m + k])
    return out


def patterns(items: list[tuple]) -> Patterns | None:
    """Windows of (item_id, text) and their q-grams; items under LEAST normalised bytes as runs of words."""
    item, text, size, shift, least, low = [], [], [], [], [], []
    cols: list[tuple] = []  # grams with their long item, place, first window and number of windows
    for name, t in items:
        raw = np.frombuffer((t or "").encode(), np.uint8)
        x, _, _ = normalise(raw, np.asarray([0, len(raw)]))
        while len(x) and x[-1] == 32:
            x = x[:-1]
        if len(x) < LEAST:
            low += [(name, x)] * (len(x) > 0)
            continue
        last = max(0, len(x) - WINDOW)
        begin = np.asarray(sorted({*(k * STEP // FINER for k in range(last * FINER // STEP + 1)), last}))
        wide = min(len(x), WINDOW)
        g = grams(x)
        at = np.arange(len(g))
        first = np.searchsorted(begin, at + Q - wide)
        cols.append((g, np.full(len(g), len(least)), at, first + len(item), np.searchsorted(begin, at, "right") - first))
        least.append(need_of(np.asarray([wide]))[0])
        for b in begin.tolist():
            item.append(name)
            size.append(wide)
            shift.append(b)
            text.append(np.pad(x[b : b + wide], (0, WINDOW - wide)))
    short: dict = {}
    for k, (name, x) in enumerate(low, len(item)):
        h = tv.words(x, np.asarray([0, len(x)])).hash
        hashes, places = short.setdefault(len(h), ([], {}))
        hashes.append(word_runs(h, len(h))[0])
        places.setdefault(x.tobytes(), []).append(k)
    short = {n: (np.unique(np.asarray(hashes, tv.U64)), places) for n, (hashes, places) in short.items()}
    item += [name for name, _ in low]
    if not item:
        return None
    empty = [(np.zeros(0, tv.U64), *[np.zeros(0, np.int64)] * 4)]
    g, *rest = (np.concatenate(c) for c in zip(*(cols or empty), strict=True))
    order = np.lexsort((rest[1], rest[0], g))
    g = g[order]
    gram, start = np.unique(g, return_index=True)
    bits = np.zeros(1 << _FILTER_BITS, bool)
    bits[(gram * _MUL) >> tv.U64(64 - _FILTER_BITS)] = True
    windows = np.stack(text) if text else np.zeros((0, WINDOW), np.uint8)
    size, shift, least = (np.asarray(v, np.int64) for v in (size, shift, least))
    return Patterns(item, windows, size, symbol_places(windows, size), shift, least, gram, np.append(start, len(g)), *(c[order] for c in rest), bits, short)


def budget(size: np.ndarray) -> np.ndarray:
    return np.floor(EDITS * size).astype(np.int64)


def need_of(size: np.ndarray) -> np.ndarray:
    """Grams that a window shares at least with a match."""
    return np.maximum(1, size - Q + 1 - budget(size) * Q)


def spread(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, number): the numbers start .. start + count of each."""
    which = np.repeat(np.arange(len(count)), count)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + start[which]


def crowded(p: Patterns, row: np.ndarray, item: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
    """Which shared grams lie beside enough others of their item to be part of a match of any of its windows.

    Diagonals are counted in stretches as wide as a window's band, each with the next, so that every band lies within two.
    """
    wide = 2 * (int(budget(np.asarray([WINDOW]))[0]) + 1)
    most = int(diagonal.max()) // wide + 2
    key = (row.astype(np.int64) * len(p.least) + item) * most + diagonal // wide
    place, inverse, hits = np.unique(key, return_inverse=True, return_counts=True)
    both = hits.copy()  # with the next stretch
    beside = np.flatnonzero(place[1:] == place[:-1] + 1)
    both[beside] += hits[beside + 1]
    enough = both >= p.least[place // most % len(p.least)]
    enough[beside + 1] |= enough[beside]
    return enough[inverse]


def align(p: Patterns, window: np.ndarray, x: np.ndarray, low: np.ndarray, high: np.ndarray, base: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Least edits of each window within x[low:high] on diagonals base .. base + wide, and where that match ends."""
    n, d = len(window), np.arange(wide)
    text, size = p.text[window], p.size[window]
    cost = np.zeros((n, wide), np.int32)
    best, ends = np.full(n, 10**6), np.zeros(n, np.int64)
    for i in range(int(size.max())):
        at = base[:, None] + d + i
        inside = (at >= low[:, None]) & (at < high[:, None])
        t = np.where(inside, x[np.clip(at, 0, len(x) - 1)], 1)
        step = cost + (t != text[:, i : i + 1])
        step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)
        cost = np.minimum.accumulate(step - d, axis=1) + d  # extra text characters
        done = np.flatnonzero(size == i + 1)
        if len(done):
            k = cost[done].argmin(axis=1)
            best[done], ends[done] = cost[done, k], base[done] + k + i + 1
    return best, ends


#: Characters of a window that fit a machine word.
WORD = 64


def symbol_places(text: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each window and byte the places among its first ``WORD`` characters that hold it, as bits."""
    out = np.zeros((len(text), 256), np.uint64)
    rows = np.arange(len(text))
    for k in range(min(WORD, text.shape[1])):
        on = rows[size > k]
        out[on, text[on, k]] |= np.uint64(1) << np.uint64(k)
    return out


def hopeful(p: Patterns, window: np.ndarray, x: np.ndarray, low: np.ndarray, high: np.ndarray, base: np.ndarray, wide: int) -> np.ndarray:
    """Whether the first ``WORD`` characters of each window lie in x[low:high] near its band within its edits.

    Columns of the edit distances are advanced as bit vectors, all windows at a time. A whole window needs as many
    edits at least, so nothing that :func:`align` would accept is turned down.
    """
    one = np.uint64(1)
    size = np.minimum(p.size[window], WORD)
    last = (size - 1).astype(np.uint64)
    most = budget(p.size[window])
    up, down = np.full(len(window), ~np.uint64(0)), np.zeros(len(window), np.uint64)
    score, best = size.copy(), size.copy()
    for k in range(wide + WORD + int(most.max(initial=0))):
        at = base + k
        same = p.places[window, np.where((at >= low) & (at < high), x[np.clip(at, 0, len(x) - 1)], 1)]
        across = same | down
        along = (((same & up) + up) ^ up) | same
        plus, minus = down | ~(along | up), up & along
        score += ((plus >> last) & one).astype(np.int64) - ((minus >> last) & one).astype(np.int64)
        plus, minus = plus << one, minus << one
        up, down = minus | ~(across | plus), plus & across
        np.minimum(best, score, out=best)
    return best <= most


def whole_words(p: Patterns, x: np.ndarray, rows: np.ndarray):
    """(row, place in ``item``, begin, end) of the short items in normalised texts."""
    if not p.short:
        return
    w = tv.words(x, rows)
    for n, (hashes, places) in p.short.items():
        if len(w.hash) < n:
            continue
        h = word_runs(w.hash, n)
        for i in np.flatnonzero(np.isin(h, hashes) & (w.row[: len(h)] == w.row[n - 1 :])).tolist():
            begin, end = int(w.start[i]), int(w.end[i + n - 1])
            for k in places.get(x[begin:end].tobytes(), ()):
                yield int(w.row[i]), k, begin, end


def search(p: Patterns, texts: pa.Array) -> dict[tuple[int, int], list]:
    """(row, place in ``item``) -> [edits, first byte, end byte] in the texts' own bytes."""
    buf, off = tv.strings(texts)
    x, rows, place = normalise(buf, off)
    g = grams(x)
    found: dict[tuple[int, int], list] = {}
    for r, k, begin, end in whole_words(p, x, rows):
        low, high = int(place[begin] - off[r]), int(place[end - 1] + 1 - off[r])
        own = found.setdefault((r, k), [0, low, high])
        own[:] = [0, min(own[1], low), max(own[2], high)]
    hit = np.flatnonzero(p.bits[(g * _MUL) >> tv.U64(64 - _FILTER_BITS)])
    if not len(hit):
        return found
    k = np.minimum(np.searchsorted(p.gram, g[hit]), len(p.gram) - 1)
    same = p.gram[k] == g[hit]
    hit, k = hit[same], k[same]
    row = np.searchsorted(rows, hit, "right") - 1
    inside = hit + Q <= rows[row + 1]
    hit, k, row = hit[inside], k[inside], row[inside]
    if not len(hit):
        return found
    which, post = spread(p.start[k], p.start[k + 1] - p.start[k])
    keep = crowded(p, row[which], p.long[post], hit[which] - p.place[post] + int(p.place.max()))
    which, post = which[keep], post[keep]
    own, window = spread(p.first[post], p.count[post])
    which, post = which[own], post[own]
    if not len(window):
        return found
    row = row[which]
    half = int(budget(np.asarray([WINDOW]))[0]) + 1
    diagonal = hit[which] - (p.place[post] - p.shift[window]) + WINDOW  # never negative
    far = int(diagonal.max()) + 2 * half
    key, hits = np.unique((row.astype(np.int64) * len(p.item) + window) * far + diagonal, return_counts=True)
    diagonal, rest = key % far, key // far
    window, row = rest % len(p.item), rest // len(p.item)

    def note(r: int, w: int, edits: int, begin: int, stop: int) -> None:
        low, high = int(place[begin] - off[r]), int(place[stop - 1] + 1 - off[r])
        own = found.setdefault((r, w), [edits, low, high])
        own[:] = [min(own[0], edits), min(own[1], low), max(own[2], high)]

    # all grams on one diagonal: the window itself
    whole = hits == p.size[window] - Q + 1
    for r, w, d in zip(row[whole].tolist(), window[whole].tolist(), (diagonal[whole] - WINDOW).tolist(), strict=True):
        note(r, w, 0, d, d + int(p.size[w]))
    # bands of two halves, each overlapping the next by one
    bands = far // half + 2
    key = rest * bands + diagonal // half
    key, inverse = np.unique(np.concatenate([key, key + 1]), return_inverse=True)
    total = np.bincount(inverse, np.concatenate([hits, hits])).astype(np.int64)
    known = np.bincount(inverse, np.concatenate([whole, whole])) > 0
    band, rest = key % bands, key // bands
    window, row = rest % len(p.item), rest // len(p.item)
    ok = (total >= need_of(p.size[window])) & ~known
    window, row, band = window[ok], row[ok], band[ok]
    for a in range(0, len(window), 20_000):
        w, r = window[a : a + 20_000], row[a : a + 20_000]
        base = (band[a : a + 20_000] - 1) * half - WINDOW - half
        able = hopeful(p, w, x, rows[r], rows[r + 1], base, 4 * half)
        w, r, base = w[able], r[able], base[able]
        if not len(w):
            continue
        edits, ends = align(p, w, x, rows[r], rows[r + 1], base, 4 * half)
        for j in np.flatnonzero(edits <= budget(p.size[w])).tolist():
            stop = min(int(ends[j]), int(rows[r[j] + 1]))
            note(int(r[j]), int(w[j]), int(edits[j]), max(int(rows[r[j]]), stop - int(p.size[w[j]])), stop)
    return found


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per (document row, item) that match: doc_id, item_id, n_windows, edits (of the best window), first_byte, end_byte.

    Null and empty texts and items match nothing; repeated rows match each for itself.
    """
    spark = docs.sparkSession
    out = None
    for block in passes(benchmark):
        held = spark.sparkContext.broadcast(patterns(block))

        def run(batches, held=held):
            p = held.value
            for whole in batches:
                for b in slices(whole, "text", SLICE):
                    merged: dict[tuple, list] = {}
                    for (r, w), (edits, low, high) in (search(p, b.column("text")) if p else {}).items():
                        own = merged.setdefault((r, p.item[w]), [0, edits, low, high])
                        own[:] = [own[0] + 1, min(own[1], edits), min(own[2], low), max(own[3], high)]
                    keys = sorted(merged)
                    rows = pa.array([k[0] for k in keys], pa.int64())
                    cols = [[merged[k][i] for k in keys] for i in range(4)]
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(rows), pa.array([k[1] for k in keys], pa.int64()), *(pa.array(c, pa.int32()) for c in cols)], names=["doc_id", "item_id", "n_windows", "edits", "first_byte", "end_byte"])

        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, item_id long, n_windows int, edits int, first_byte int, end_byte int")
        out = part if out is None else out.unionByName(part)
    return out


def passes(benchmark: DataFrame) -> list[list[tuple]]:
    """Items in blocks of PASS_BYTES, read one partition at a time."""
    blocks, size = [[]], 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL").toLocalIterator():
        n = len((r.text or "").encode())
        if blocks[-1] and size + n > PASS_BYTES:
            blocks.append([])
            size = 0
        blocks[-1].append((r.item_id, r.text))
        size += n
    return blocks


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that match no item, all columns kept; no shuffle."""
    for block in passes(benchmark):
        held = docs.sparkSession.sparkContext.broadcast(patterns(block))

        def run(batches, held=held):
            p = held.value
            for whole in batches:
                for b in slices(whole, "text", SLICE):
                    keep = np.ones(b.num_rows, bool)
                    keep[[r for r, _ in (search(p, b.column("text")) if p else ())]] = False
                    yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(tidy(run), docs.schema)
    return docs


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document row and item that match, as :func:`matches` defines them."""
    return matches(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
