"""Line deduplication by an exact set-similarity join (operator 7).

Lines are sets of words. Words are ordered by rarity over the whole corpus; two lines of Jaccard similarity t must
share a word within their prefixes, at places that leave room for the needed overlap, and have fitting lengths. A
128-bit bitmap of each set bounds the overlap before the sets themselves are compared. A line goes if an earlier
line (by doc_id, then line number) matches it.

Words, lines and postings travel as packed arrays, one row for each share of the hashes and buffer of a task, so that
a shuffle moves a few large rows. A share is gathered in a task that lets go of what it has settled: repeated lines
are told apart as they come, and the postings of a word that is in very many prefixes leave in blocks of ``GROUP``,
which later meet the lines that are still open, block by block, in all tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import textvec as tv
from spanloom.llm.common import bit_set, bits_for, in_set, materialise, n_parts, packed, place_name, share_of, slices, table, tidy, with_base

SIMILARITY = 0.8
#: Words whose exact counts order prefixes; rarer ones precede them all.
RANKED_WORDS = 200_000
#: log2 slots of the table of ranks.
RANK_BITS = 20
#: Words up to which a line's bitmap has 64 bits, not 128.
NARROW = 64
#: Earlier candidates of a line by one word that are verified at first; the rest follow for the lines that these leave open.
FIRST_TRIES = 3
#: Further candidates that are written beside the first tries; where there are more, the word's postings are.
BESIDE = 60
#: Postings of a word that are compared in one task; a word with more has several blocks.
GROUP = 4096
#: Entries that a task holds before it settles what it can, and pairs of postings that are compared at a time.
HELD, PAIRS = 1 << 20, 1 << 18
_SALT1, _SALT2 = tv.U64(0x1F83D9ABFB41BD6B), tv.U64(0x5BE0CD19137E2179)
POSTING = {"word": np.uint64, "key": np.uint64, "doc": np.int64, "line": np.int64, "b1": np.uint64, "b2": np.uint64, "n": np.int32, "pos": np.int32}
#: Kinds of packed rows of the survey.
WORDS, LINES, AGAIN, STEPS, ROWS = range(5)


class Lines:
    """Lines of a slice of texts with their sorted distinct word hashes; ``base`` is added to a row's line numbers."""

    def __init__(self, texts: pa.Array, base: np.ndarray | None = None, wanted=None):
        """``wanted``, if given, tells by a line's row and number whether its words are needed; other lines get none."""
        buf, off = tv.strings(texts)
        breaks = np.flatnonzero(buf == 10) + 1
        full = np.flatnonzero(np.diff(off) > 0)
        starts = np.union1d(off[full], breaks)
        starts = starts[starts < len(buf)]  # a break at a text's end starts no line
        self.row = np.searchsorted(off, starts, "right") - 1
        first = np.searchsorted(self.row, np.arange(len(off) - 1))
        self.number = np.arange(len(starts)) - first[self.row] if len(starts) else np.zeros(0, np.int64)
        if base is not None and len(starts):
            self.number = self.number + base[self.row]
        off = np.append(starts, len(buf)) if len(starts) else np.zeros(1, np.int64)
        if wanted is not None and len(starts):
            size = np.where(wanted(self.row, self.number), np.diff(off), 0)
            buf = buf[np.repeat(size > 0, np.diff(off))]
            off = np.concatenate(([0], np.cumsum(size)))
        w = tv.words(tv.fold(buf), off)
        self.values, self.bounds = tv.unique_sets(w.row, w.hash, len(starts))
        self.n = np.diff(self.bounds)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        k1, k2 = np.zeros(len(self.n), tv.U64), np.zeros(len(self.n), tv.U64)
        full = np.flatnonzero(self.n > 0)
        if len(full):
            k1[full] = np.add.reduceat(tv.mix(self.values ^ _SALT1), self.bounds[full])
            k2[full] = np.add.reduceat(tv.mix(self.values ^ _SALT2), self.bounds[full])
        return tv.mix(k1), k2


def lines_of(b: pa.RecordBatch) -> tuple[Lines, np.ndarray]:
    """Lines of a batch of (doc_id, base, text), and the doc_id of each."""
    x = Lines(b.column("text"), b.column("base").to_numpy(zero_copy_only=False))
    return x, b.column("doc_id").to_numpy(zero_copy_only=False)[x.row] if len(x.row) else np.zeros(0, np.int64)


def overlap_needed(n: np.ndarray, m: np.ndarray, t: float) -> np.ndarray:
    return np.ceil(t / (1 + t) * (n + m) - 1e-9).astype(np.int64)


def told_apart(held: list[tuple]) -> tuple[tuple, tuple]:
    """Of (k1, k2, doc, line): the first line of each set, and (doc, line) of the others that differ from it."""
    k1, k2, doc, line = (np.concatenate(c) for c in zip(*held, strict=True))
    by = np.lexsort((line, doc, k2, k1))
    k1, k2, doc, line = k1[by], k2[by], doc[by], line[by]
    first = np.ones(len(k1), bool)
    first[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
    start = np.flatnonzero(first)
    own = np.repeat(start, np.diff(np.append(start, len(k1))))
    again = (doc != doc[own]) | (line != line[own])  # a row of documents may be repeated whole
    return (k1[first], k2[first], doc[first], line[first]), (doc[again], line[again])


def counted(held: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    word, inverse = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
    return word, np.bincount(inverse, np.concatenate([n for _, n in held]), minlength=len(word)).astype(np.int64)


def steps_of(df: np.ndarray) -> np.ndarray:
    """Eighths of doublings."""
    return np.floor(np.log2(df) * 8).astype(np.int64)


def survey(docs: DataFrame, parts: int) -> DataFrame:
    """kind, a, b, c: words that occur in several lines with their counts; lines that repeat a set; how many words a step
    of counts has; rows (doc_id, base) with their number of lines."""

    def read(batches):
        words, lines, n_words, n_lines = [], [], 0, 0

        def deal(kind, share, arrays):
            cut = np.searchsorted(share, np.arange(parts + 1))
            for s in np.flatnonzero(np.diff(cut)).tolist():
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([kind], pa.int32()), *packed(a[cut[s] : cut[s + 1]] for a in arrays), *(pa.nulls(1, pa.binary()) for _ in range(4 - len(arrays)))], names=["share", "kind", "a", "b", "c", "d"])

        def words_out():
            w, n = counted(words)
            yield from deal(WORDS, share_of(w, parts), (w, n))

        def lines_out():
            first, (doc, line) = told_apart(lines)
            yield from deal(LINES, share_of(first[0], parts), first)
            if len(doc):
                yield pa.RecordBatch.from_arrays([pa.array([int(line[0]) % parts], pa.int32()), pa.array([AGAIN], pa.int32()), *packed((doc, line)), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary())], names=["share", "kind", "a", "b", "c", "d"])

        for whole in batches:
            for b in slices(whole, "text"):
                x, doc = lines_of(b)
                full = x.n > 0
                k1, k2 = x.keys()
                lines.append((k1[full], k2[full], doc[full], x.number[full]))
                words.append(np.unique(x.values, return_counts=True))
                n_lines += int(full.sum())
                ids, base = (b.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "base"))
                rows = packed((ids, base, np.bincount(x.row, minlength=b.num_rows).astype(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([int(ids[0]) % parts], pa.int32()), pa.array([ROWS], pa.int32()), *rows, pa.nulls(1, pa.binary())], names=["share", "kind", "a", "b", "c", "d"])
                n_words += len(words[-1][0])
                if n_words > HELD:
                    yield from words_out()
                    words, n_words = [], 0
                if n_lines > HELD // 2:
                    yield from lines_out()
                    lines, n_lines = [], 0
        if words:
            yield from words_out()
            yield from lines_out()

    def settle(batches):
        words, lines, n_words, n_lines, most = [], [], 0, 0, 2 * HELD

        def row(kind, *arrays):
            return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), *packed(arrays), *[pa.nulls(1, pa.binary())] * (3 - len(arrays))], names=["kind", "a", "b", "c"])

        for batch in batches:
            for kind, *blobs in zip(*(batch.column(c).to_pylist() for c in ("kind", "a", "b", "c", "d")), strict=True):
                if kind == WORDS:
                    words.append((np.frombuffer(blobs[0], tv.U64), np.frombuffer(blobs[1], np.int64)))
                    n_words += len(words[-1][0])
                elif kind == LINES:
                    lines.append((*(np.frombuffer(x, tv.U64) for x in blobs[:2]), *(np.frombuffer(x, np.int64) for x in blobs[2:])))
                    n_lines += len(lines[-1][0])
                else:
                    yield row(kind, *(np.frombuffer(x, np.int64) for x in blobs if x is not None))
            if n_words > most:
                words = [counted(words)]
                n_words = len(words[0][0])
            if n_lines > most:
                first, again = told_apart(lines)
                lines, n_lines = [first], len(first[0])
                yield row(AGAIN, *again)
            most = max(most, 2 * max(n_words, n_lines))
        if words:
            w, n = counted(words)
            w, n = w[n > 1], n[n > 1]
            step, count = np.unique(steps_of(n), return_counts=True)
            yield row(STEPS, step, count)
            for k in range(0, len(w), HELD):
                yield row(WORDS, w[k : k + HELD], n[k : k + HELD])
        if lines:
            yield row(AGAIN, *told_apart(lines)[1])

    told = docs.mapInArrow(tidy(read), "share int, kind int, a binary, b binary, c binary, d binary")
    return told.repartitionById(parts, "share").mapInArrow(tidy(settle), "kind int, a binary, b binary, c binary")


def rank_table(words: np.ndarray, df: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tags, ranks) by a slot of the hash; of words that share a slot the most frequent keeps it, the others count as rare."""
    by = np.argsort(df, kind="stable")
    slot = (words[by] >> tv.U64(64 - RANK_BITS)).astype(np.int64)
    tags, rank = np.zeros(1 << RANK_BITS, np.uint32), np.zeros(1 << RANK_BITS, np.int32)
    tags[slot] = words[by].astype(np.uint32)
    rank[slot] = np.minimum(df[by], 2**31 - 1)
    return tags, rank


def rank_of(tags: np.ndarray, rank: np.ndarray, v: np.ndarray) -> np.ndarray:
    slot = (v >> tv.U64(64 - RANK_BITS)).astype(np.int64)
    return np.where(tags[slot] == v.astype(np.uint32), rank[slot], 0)


def line_order(row: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Order by row and rank; equal ones stay as they are."""
    start = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    base = np.repeat(start, np.diff(np.append(start, len(row))))
    local = np.arange(len(row)) - base
    if row[-1] < 1 << 20 and local.max() < 1 << 16 and rank.max() < 1 << 28:
        # rows stay where they are, so that the places within them can be read from the sorted numbers
        key = (row.astype(tv.U64) << tv.U64(44)) | (rank.astype(tv.U64) << tv.U64(16)) | local.astype(tv.U64)
        key.sort()
        return (key & tv.U64(0xFFFF)).astype(np.int64) + base
    return np.lexsort((rank, row))


def word_order(told: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The table of ranks, and the set of words that occur in more than one line."""
    step = told.where(F.col("kind") == STEPS)

    def counts(batches):
        for b in batches:
            for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, np.int64)), pa.array(np.frombuffer(y, np.int64))], names=["step", "k"])

    have, least, known = 0, 1 << 20, sorted(step.mapInArrow(counts, "step long, k long").groupBy("step").agg(F.sum("k").alias("k")).collect(), key=lambda r: -r.step)
    for r in known:
        have += r.k
        if have > RANKED_WORDS:
            break
        least = r.step
    words = told.where(F.col("kind") == WORDS).select("a", "b")

    def frequent(batches):
        for b in batches:
            for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True):
                w, n = np.frombuffer(x, tv.U64), np.frombuffer(y, np.int64)
                on = steps_of(n) >= least
                if on.any():
                    yield pa.RecordBatch.from_arrays([pa.array(w[on].view(np.int64)), pa.array(n[on])], names=["w", "n"])

    def hashes(b):
        return np.concatenate([np.zeros(0, tv.U64), *(np.frombuffer(x, tv.U64) for x in b.column("a").to_pylist())])

    top = words.mapInArrow(frequent, "w long, n long").toArrow()
    ranks = rank_table(top.column("w").to_numpy().view(tv.U64), top.column("n").to_numpy())
    return (*ranks, bit_set(words, hashes, bits_for(sum(r.k for r in known))))


def postings(docs: DataFrame, order: Broadcast, similarity: float, parts: int) -> DataFrame:
    """share and packed columns of POSTING: every prefix word that occurs in another line too."""

    def run(batches):
        tags, rank, seen = order.value
        held, size = [], 0

        def out():
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            by = np.argsort(cols[0])
            cols = [c[by] for c in cols]
            cut = np.searchsorted(share_of(cols[0], parts), np.arange(parts + 1))
            for s in np.flatnonzero(np.diff(cut)).tolist():
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), *packed(c[cut[s] : cut[s + 1]] for c in cols)], names=["share", *POSTING])

        for whole in batches:
            for b in slices(whole, "text"):
                x, doc = lines_of(b)
                # of lines that repeat a set whole the first one is enough
                k1, k2 = x.keys()
                some = np.flatnonzero(x.n > 0)
                by = some[np.lexsort((x.number[some], doc[some], k2[some], k1[some]))]
                ask = np.zeros(len(x.n), bool)
                if len(by):
                    ask[by[np.concatenate(([True], (k1[by][1:] != k1[by][:-1]) | (k2[by][1:] != k2[by][:-1])))]] = True
                keep = np.repeat(ask, x.n)
                v, row = x.values[keep], np.repeat(np.arange(len(x.n)), x.n)[keep]
                if not len(v):
                    continue
                # words of a line are in order of their hashes already, which decides between equal ranks
                by = line_order(row, rank_of(tags, rank, v))
                v, row = v[by], row[by]
                start = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
                n = np.diff(np.append(start, len(row)))
                bit = tv.mix(v * _SALT1)
                low, which = tv.U64(1) << (bit & tv.U64(63)), (bit >> tv.U64(6)) & tv.U64(1)
                wide = np.repeat(n > NARROW, n) & (which == 1)  # short lines do with 64 bits
                b1 = np.bitwise_or.reduceat(np.where(wide, tv.U64(0), low), start)
                b2 = np.bitwise_or.reduceat(np.where(wide, low, tv.U64(0)), start)
                line = np.repeat(np.arange(len(start)), n)
                pos = np.arange(len(row)) - start[line]
                prefix = n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1
                on = np.flatnonzero(pos < prefix[line])
                on = on[in_set(seen, v[on])]
                own, line = row[on], line[on]
                held.append((v[on], k1[own], doc[own], x.number[own], b1[line], b2[line], n[line].astype(np.int32), pos[on].astype(np.int32)))
                size += len(on)
                if size > HELD:
                    yield from out()
                    held, size = [], 0
        if held:
            yield from out()

    return docs.mapInArrow(tidy(run), "share int, " + ", ".join(f"{c} binary" for c in POSTING))


def bits_apart(n, b1, b2, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Bits in which two bitmaps differ: at most as many as the words in which the lines do."""
    x1, y1, x2, y2 = b1[i], b1[j], b2[i], b2[j]
    fold = (n[i] <= NARROW) | (n[j] <= NARROW)
    one = np.where(fold, (x1 | x2) ^ (y1 | y2), x1 ^ y1)
    return np.bitwise_count(one).astype(np.int64) + np.bitwise_count(np.where(fold, tv.U64(0), x2 ^ y2))


def earliest(word: np.ndarray, key: np.ndarray, doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Which postings no other of the same word and set comes before."""
    keep = np.ones(len(word), bool)
    name = tv.mix(word * tv._P + key)
    by = np.argsort(name)
    twin = name[by][1:] == name[by][:-1]
    if twin.any():
        some = np.zeros(len(by), bool)
        some[1:] |= twin
        some[:-1] |= twin
        at = by[some]
        at = at[np.lexsort((line[at], doc[at], key[at], word[at]))]
        keep[at[1:][(word[at][1:] == word[at][:-1]) & (key[at][1:] == key[at][:-1])]] = False
    return keep


class Postings:
    """Postings in order of (word, n, doc, line), one for each word and set.

    ``lone``: words of which a single posting is kept as well; of others it has no partner and goes. All, if None.
    """

    def __init__(self, held: list[tuple], lone: set | None = None):
        cols = [np.concatenate(c) for c in zip(*held, strict=True)]
        if lone is not None:
            by = np.argsort(cols[0])
            word = cols[0][by]
            twin = word[1:] == word[:-1]
            several = np.concatenate((twin, [False])) | np.concatenate(([False], twin))
            if lone:
                several |= np.isin(word, np.asarray(sorted(lone), tv.U64))
            cols = [c[by[several]] for c in cols]
        keep = earliest(*cols[:4])
        if not keep.all():
            cols = [c[keep] for c in cols]
        if lone is None:
            by = np.argsort(cols[0])
            cols = [c[by] for c in cols]
        word = cols[0]
        cut = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1]))) if len(word) else np.zeros(0, np.int64)
        group = np.repeat(np.arange(len(cut)), np.diff(np.append(cut, len(word))))
        place = (group << 32) | cols[6]
        by = np.argsort(place)
        twin = place[by][1:] == place[by][:-1]
        if twin.any():
            some = np.concatenate((twin, [False])) | np.concatenate(([False], twin))
            at = by[some]
            by[some] = at[np.lexsort((cols[3][at], cols[2][at], place[at]))]
        self.cols = [c[by] for c in cols]
        self.word, self.key, self.doc, self.line, self.b1, self.b2, n, pos = self.cols
        self.n, self.pos = n.astype(np.int64), pos.astype(np.int64)
        self.cut = np.append(cut, len(by)).astype(np.int64)

    def take(self, keep: np.ndarray) -> tuple:
        return tuple(c[keep] for c in self.cols)

    def pairs(self, similarity: float, asked: np.ndarray | None = None):
        """(i, j, bits apart): each line (of ``asked``) with all earlier ones of its word that fit, whole lines at a time.

        Two lines fit if they can reach the overlap, given that this word is the first that they share: by what is
        left of each after it, and by the bits in which their bitmaps differ. A later shared word needs no candidate.
        """
        if not len(self.word):
            return
        rest = self.n - self.pos
        overlap = overlap_needed(np.arange(2 * int(self.n.max()) + 1), 0, similarity)
        size = np.diff(self.cut)
        group = np.repeat(np.arange(len(size)), size)
        place = (group << 32) | self.n  # in order
        low = np.searchsorted(place, (group << 32) | np.ceil(similarity * self.n - 1e-9).astype(np.int64))
        same = np.searchsorted(place, place, "right")
        high = np.searchsorted(place, (group << 32) | np.floor(self.n / similarity + 1e-9).astype(np.int64), "right")
        here = np.arange(len(place))
        count = (here - low) + (high - same)  # shorter ones, earlier ones of its length, longer ones
        if asked is not None:
            here = np.flatnonzero(asked)
        done = np.cumsum(count[here])
        at = 0
        while at < len(here):
            stop = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + PAIRS, "right")))
            some = here[at:stop]
            at = stop
            c = count[some]
            i = np.repeat(some, c)
            if not len(i):
                continue
            j = np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c) + low[i]
            j += np.where(j >= i, same[i] - i, 0)
            need = overlap[self.n[i] + self.n[j]]
            ok = (rest[j] >= need) & (rest[i] >= need)
            i, j, need = i[ok], j[ok], need[ok]
            a, b = self.doc[j], self.doc[i]
            ok = (a < b) | ((a == b) & (self.line[j] < self.line[i]))
            i, j, need = i[ok], j[ok], need[ok]
            apart = bits_apart(self.n, self.b1, self.b2, i, j)
            ok = self.n[i] + self.n[j] - apart >= 2 * need
            if ok.any():
                yield i[ok], j[ok], apart[ok]


#: What a waiting line takes along, beside its place: the rest of its posting.
OWN = {"key": "long", "b1": "long", "b2": "long", "n": "int", "pos": "int"}
CANDIDATES = "a_doc long, a_line long, b_doc long, b_line long, d_docs array<long>, d_lines array<long>, word long, " + ", ".join(f"{c} {k}" for c, k in OWN.items()) + ", " + ", ".join(f"p_{c} binary" for c in POSTING)
NAMES = ["a_doc", "a_line", "b_doc", "b_line", "d_docs", "d_lines", "word", *OWN, *(f"p_{c}" for c in POSTING)]


def candidates(posts: DataFrame, similarity: float, parts: int, tries: int) -> DataFrame:
    """a_doc, a_line, b_doc, b_line, d_docs, d_lines: pairs of a line and an earlier one, the nearest ``tries`` by bitmap for each word.

    The first pair of a line has the others beside it (d_docs, d_lines). Where they are more than ``BESIDE``, or the
    word has more than ``GROUP`` postings, that row (or one without b) has the ``word`` and the line's posting
    instead, and a row without a line has a block of the word's postings (p_ columns).
    """

    def row(p: Postings, a: np.ndarray, b, beside, ask: np.ndarray):
        """Rows of the lines a with their partners b; those of ``ask`` with their posting."""
        k = len(a)
        pair = [pa.nulls(k, pa.int64())] * 2 if b is None else [pa.array(p.doc[b]), pa.array(p.line[b])]
        lists = [pa.nulls(k, pa.list_(pa.int64()))] * 2 if beside is None else beside
        own = [pa.array(c.view(np.int64) if c.dtype == tv.U64 else c, mask=~ask) for c in (p.word[a], p.key[a], p.b1[a], p.b2[a], p.n[a].astype(np.int32), p.pos[a].astype(np.int32))]
        return pa.RecordBatch.from_arrays([pa.array(p.doc[a]), pa.array(p.line[a]), *pair, *lists, *own, *[pa.nulls(k, pa.binary())] * len(POSTING)], names=NAMES)

    def block(p: Postings, low: int, high: int):
        gone = [pa.nulls(1, pa.int64())] * 4 + [pa.nulls(1, pa.list_(pa.int64()))] * 2
        own = [pa.nulls(1, pa.int64())] * 3 + [pa.nulls(1, pa.int32())] * 2
        return pa.RecordBatch.from_arrays([*gone, pa.array(p.word[low : low + 1].view(np.int64)), *own, *packed(c[low:high] for c in p.cols)], names=NAMES)

    def compare(p: Postings, large: set):
        """Candidates within blocks; ``large``: words that have further blocks."""
        size, wide = np.diff(p.cut), np.zeros(len(p.cut) - 1, bool)
        group = np.repeat(np.arange(len(size)), size)
        many = np.isin(p.word[p.cut[:-1]], np.asarray(sorted(large), tv.U64))
        met = np.zeros(len(group), bool)
        for i, j, apart in p.pairs(similarity):
            by = np.lexsort((apart + np.abs(p.n[i] - p.n[j]), i))
            i, j = i[by], j[by]
            first = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1])))
            count = np.diff(np.append(first, len(i)))
            turn = np.arange(len(i)) - np.repeat(first, count)
            each = np.repeat(count, count)
            tried = turn < tries
            hot = (each > tries + BESIDE) | many[group[i]]
            wide[group[i[hot]]] = True
            met[i] = True
            d = j[~tried & ~hot]
            waits = np.where(~hot & (turn == 0), np.maximum(each - tries, 0), 0)[tried]
            beside = np.concatenate(([0], np.cumsum(waits)))
            ask = (hot & (turn == 0))[tried]
            yield row(p, i[tried], j[tried], [tv.list_array(p.doc[d], beside, pa.int64()), tv.list_array(p.line[d], beside, pa.int64())], ask)
        alone = np.flatnonzero(many[group] & ~met)  # without a partner in this block, but there are others
        if len(alone):
            yield row(p, alone, None, None, np.ones(len(alone), bool))
        for g in np.flatnonzero(wide | many).tolist():
            yield block(p, int(p.cut[g]), int(p.cut[g + 1]))

    def run(batches):
        held, size, large, most = [], 0, set(), 2 * HELD
        for batch in batches:
            for blobs in zip(*(batch.column(c).to_pylist() for c in POSTING), strict=True):
                held.append(tuple(np.frombuffer(x, kind) for x, kind in zip(blobs, POSTING.values(), strict=True)))
                size += len(held[-1][0])
            if size > most:
                # full blocks of words with very many postings leave
                p = Postings(held)
                own = np.repeat(np.diff(p.cut), np.diff(p.cut))
                turn = np.arange(len(own)) - np.repeat(p.cut[:-1], np.diff(p.cut))
                leave = turn < own // GROUP * GROUP
                if leave.any():
                    part = turn[leave] // GROUP
                    cols = p.take(leave)
                    large.update(np.unique(cols[0]).tolist())
                    for k in range(int(part.max()) + 1):
                        yield from compare(Postings([tuple(c[part == k] for c in cols)]), large)
                held = [p.take(~leave)]
                size = len(held[0][0])
                most = max(most, 2 * size)
        if held:
            p = Postings(held, large)
            size = np.diff(p.cut)
            large.update(p.word[p.cut[:-1][size > GROUP]].tolist())
            turn = (np.arange(len(p.word)) - np.repeat(p.cut[:-1], size)) // GROUP
            for k in range(int(turn.max()) + 1 if len(turn) else 0):
                yield from compare(Postings([p.take(turn == k)]) if turn.max() else p, large)

    return posts.repartitionById(parts, "share").mapInArrow(tidy(run), CANDIDATES)


def open_pairs(blocks: DataFrame, waiting: DataFrame, similarity: float) -> DataFrame:
    """a_doc, a_line, b_doc, b_line: the waiting lines (a_doc, a_line, word and the rest of their postings) with all
    earlier ones of the word's blocks that fit. Chunks of lines meet blocks; only what fits becomes a row."""
    count = waiting.groupBy("word").agg(F.count("*").alias("count"))
    chunk = F.pmod(F.xxhash64("a_doc", "a_line"), F.ceil(F.col("count") / GROUP))
    columns = {"key": "key", "doc": "a_doc", "line": "a_line", "b1": "b1", "b2": "b2", "n": "n", "pos": "pos"}
    asked = waiting.join(count, "word").groupBy("word", chunk.alias("chunk")).agg(F.collect_list(F.struct(*(F.col(c).alias(k) for k, c in columns.items()))).alias("lines"))

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                x = tuple(np.frombuffer(b.column(f"p_{c}")[r].as_buffer(), kind) for c, kind in POSTING.items())
                lines = b.column("lines")[r].values
                own = {c: lines.field(c).to_numpy(zero_copy_only=False) for c in columns}
                own["word"] = np.full(len(lines), x[0][0])
                both = Postings([tuple(np.ascontiguousarray(own[c]).view(kind) if kind is np.uint64 else own[c].astype(kind) for c, kind in POSTING.items()), x])
                mine = np.isin(place_name(both.doc, both.line), place_name(own["doc"], own["line"]))
                for i, j, _ in both.pairs(similarity, mine):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (both.doc[i], both.line[i], both.doc[j], both.line[j])], names=["a_doc", "a_line", "b_doc", "b_line"])

    return asked.join(blocks, "word").mapInArrow(tidy(run), "a_doc long, a_line long, b_doc long, b_line long").distinct()


def sets_of(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """d, l, n, words (sorted hashes) and s0 .. s7 (a bitmap of 512 bits) of the lines in materialised pairs (and some others)."""
    spark = docs.sparkSession
    bits = bits_for(2 * pairs.count())

    def lines(b):
        d, n = (np.concatenate([b.column(f"{s}_{c}").to_numpy() for s in "ab"]) for c in ("doc", "line"))
        return place_name(d, n)

    def documents(b):
        d = np.concatenate([b.column(f"{s}_doc").to_numpy() for s in "ab"])
        return place_name(d, np.zeros(len(d)))

    filters = spark.sparkContext.broadcast((bit_set(pairs, lines, bits), bit_set(pairs, documents, bits)))

    def run(batches):
        wanted, holders = filters.value
        for whole in batches:
            d = whole.column("doc_id").to_numpy(zero_copy_only=False)
            whole = whole.filter(pa.array(in_set(holders, place_name(d, np.zeros(len(d))))))
            for b in slices(whole, "text"):
                ids, base = (b.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "base"))
                x = Lines(b.column("text"), base, lambda row, number, ids=ids: in_set(wanted, place_name(ids[row], number)))
                on, v = np.flatnonzero(x.n > 0), x.values
                if not len(on):
                    continue
                doc = ids[x.row]
                start = np.concatenate(([0], np.cumsum(x.n[on])))
                bit = tv.mix(v * _SALT2)
                low, which = tv.U64(1) << (bit & tv.U64(63)), (bit >> tv.U64(6)) & tv.U64(7)
                maps = [np.bitwise_or.reduceat(np.where(which == k, low, tv.U64(0)), start[:-1]).view(np.int64) for k in range(8)]
                raw, cut = v.tobytes(), (start * 8).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(doc[on]), pa.array(x.number[on]), pa.array(x.n[on].astype(np.int32)), pa.array([raw[i:j] for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary()), *map(pa.array, maps)], names=["d", "l", "n", "words", *(f"s{k}" for k in range(8))])

    # a repeated row of documents would give a set twice, which changes nothing
    return materialise(docs.mapInArrow(tidy(run), "d long, l long, n int, words binary, " + ", ".join(f"s{k} long" for k in range(8))))


PAIR = ["a_doc", "a_line", "b_doc", "b_line"]


def both_sides(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    """Pairs with columns of both lines, as a_... and b_..."""
    for s in "ab":
        pairs = pairs.join(sets.select(F.col("d").alias(f"{s}_doc"), F.col("l").alias(f"{s}_line"), *(F.col(c).alias(f"{s}_{c}") for c in columns)), [f"{s}_doc", f"{s}_line"])
    return pairs


def screened(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs, with ``apart``, whose bitmaps of 512 bits leave room for the overlap."""
    maps = [f"s{k}" for k in range(8)]
    met = both_sides(pairs, sets.select("d", "l", "n", *maps), "n", *maps)
    apart = sum((F.bit_count(F.col(f"a_{m}").bitwiseXOR(F.col(f"b_{m}"))) for m in maps), F.lit(0))
    size = F.col("a_n") + F.col("b_n")
    fits = size - F.col("apart") >= 2 * F.ceil(similarity / (1 + similarity) * size - 1e-9)
    return met.withColumn("apart", apart).where(fits).select(*PAIR, "apart").distinct()


def verify(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The distinct (doc_id, line) that match one of their partners exactly."""

    def compare(batches):
        for b in batches:
            x, y = b.column("a_words").to_pylist(), b.column("b_words").to_pylist()
            keep = np.zeros(len(x), bool)
            for k, (p, q) in enumerate(zip(x, y, strict=True)):
                p, q = np.frombuffer(p, tv.U64), np.frombuffer(q, tv.U64)
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                same = int((q[at] == p).sum())
                keep[k] = same >= similarity * (len(p) + len(q) - same) - 1e-9
            yield pa.RecordBatch.from_arrays([b.column("a_doc"), b.column("a_line")], names=["doc_id", "line"]).filter(pa.array(keep))

    met = both_sides(pairs.select(*PAIR), sets, "words")
    return met.select("a_doc", "a_line", "a_words", "b_words").mapInArrow(tidy(compare), "doc_id long, line long").distinct()


def repeated_lines(docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(rows, removed): rows are doc_id, base, n_lines; removed the (doc_id, line) that match an earlier line.

    ``line`` counts from the row's ``base``. A line without words matches nothing; rows with a null doc_id take no
    part. Rows that repeat a doc_id with another text follow each other in order of the texts' hashes and keep their
    lines apart; rows that repeat doc_id and text are one, so that each of them loses the same lines.
    """
    return settled(with_base(docs)[0], similarity)


def settled(docs: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """As :func:`repeated_lines`, of rows with a base."""
    spark = docs.sparkSession
    parts = n_parts(spark)
    told = materialise(survey(docs, parts))
    order = spark.sparkContext.broadcast(word_order(told))

    def flat(names: list[str]):
        def run(batches):
            for b in batches:
                for blobs in zip(*(b.column(c).to_pylist() for c in "abc"[: len(names)]), strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, np.int64)) for x in blobs], names=names)

        return run

    again = told.where(F.col("kind") == AGAIN).select("a", "b").mapInArrow(flat(["doc_id", "line"]), "doc_id long, line long")
    rows = told.where(F.col("kind") == ROWS).select("a", "b", "c").mapInArrow(flat(["doc_id", "base", "n_lines"]), "doc_id long, base long, n_lines long")
    near = materialise(candidates(postings(docs, order, similarity, parts), similarity, parts, FIRST_TRIES))
    order.unpersist()
    tries = materialise(near.where("b_doc IS NOT NULL").select(*PAIR).distinct())
    sets = sets_of(docs, tries)
    likely = materialise(screened(tries, sets, similarity))
    # the nearest partner of each line settles most of them
    nearest = likely.groupBy("a_doc", "a_line").agg(F.min(F.struct("apart", "b_doc", "b_line")).alias("b")).select("a_doc", "a_line", F.col("b.b_doc").alias("b_doc"), F.col("b.b_line").alias("b_line"))
    first = materialise(verify(nearest, sets, similarity))

    # the exact rest, for lines that are still open: the other tries, the candidates written beside them, and the blocks of words that had too many
    def still_open(rows: DataFrame) -> DataFrame:
        return rows.join(first.withColumnsRenamed({"doc_id": "a_doc", "line": "a_line"}), ["a_doc", "a_line"], "left_anti")

    removed = again.unionByName(first).unionByName(verify(still_open(likely), sets, similarity))
    beside = still_open(near.where(F.size("d_docs") > 0).select("a_doc", "a_line", "d_docs", "d_lines"))
    rest = beside.select("a_doc", "a_line", F.explode(F.arrays_zip("d_docs", "d_lines")).alias("d")).select("a_doc", "a_line", F.col("d.d_docs").alias("b_doc"), F.col("d.d_lines").alias("b_line"))
    waiting = materialise(still_open(near.where("word IS NOT NULL AND a_doc IS NOT NULL").select("a_doc", "a_line", "word", *OWN)))
    if not waiting.isEmpty():
        blocks = near.where("a_doc IS NULL").select("word", *(f"p_{c}" for c in POSTING))
        rest = rest.unionByName(open_pairs(blocks, waiting, similarity))
    rest = materialise(rest.distinct())
    if not rest.isEmpty():
        sets = sets_of(docs, rest)
        removed = removed.unionByName(verify(screened(rest, sets, similarity), sets, similarity))
    return rows, removed.distinct()


def removed_of_rows(removed: DataFrame) -> DataFrame:
    """doc_id, base, gone: line numbers, ascending, that each row (a repeated one once) loses."""
    start = F.shiftleft(F.shiftright("line", 31), 31)
    return removed.select("doc_id", start.alias("base"), (F.col("line") - start).cast("int").alias("line")).groupBy("doc_id", "base").agg(F.sort_array(F.collect_list("line")).alias("gone"))


def remove_repeated_lines(docs: DataFrame, similarity: float = SIMILARITY, drop_emptied: bool = True) -> DataFrame:
    """docs without their repeated lines, all columns kept (``n_chars``, if there, follows the text).

    Documents that lose every line with words go if ``drop_emptied``; documents that were empty before stay, as do
    rows with a null doc_id. Columns named as this function's own are safe: it works on positions of its own structs.
    """
    based, repeated = with_base(docs)
    gone = removed_of_rows(settled(based, similarity)[1]).withColumnRenamed("doc_id", "id")
    held = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"))
    if repeated:
        several = based.where("base > 0").select(F.col("doc_id").alias("id"), "base", F.xxhash64("text").alias("name")).distinct()
        held = held.withColumn("name", F.xxhash64("row.text")).join(several, ["id", "name"], "left").drop("name")
    else:
        held = held.withColumn("base", F.lit(0))
    held = held.withColumn("base", F.coalesce("base", F.lit(0)).cast("long")).join(gone, ["id", "base"], "left")
    text = F.col("row.text")
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(F.col("gone"), i)), "\n")
    out = held.withColumn("left", F.when(F.col("gone").isNull() | text.isNull(), text).otherwise(kept))
    if drop_emptied:
        out = out.where(F.col("gone").isNull() | text.isNull() | (F.trim(F.regexp_replace("left", r"\s+", " ")) != ""))

    def column(f):
        if f.name == "text":
            return F.col("left").alias("text")
        own = F.col("row").getField(f.name)
        if f.name == "n_chars":
            own = F.when(F.col("gone").isNull(), own).otherwise(F.length("left").cast(f.dataType))
        return own.alias(f.name)

    return out.select(*(column(f) for f in docs.schema))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed, removed (line numbers from 0, ascending, joined by commas).

    A null or empty text has no lines; a null doc_id loses none.
    """
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    rows, removed = repeated_lines(docs)
    out = rows.join(removed_of_rows(removed), ["doc_id", "base"], "left").select("doc_id", "n_lines", "gone")
    breaks = F.size(F.split("text", "\n", -1)) - F.endswith("text", F.lit("\n")).cast("int")
    no_id = F.when(F.col("text").isNull() | (F.col("text") == ""), 0).otherwise(breaks).cast("long")
    out = out.unionByName(docs.where("doc_id IS NULL").select(F.lit(None).cast("long").alias("doc_id"), no_id.alias("n_lines"), F.lit(None).cast("array<int>").alias("gone")))
    return out.select("doc_id", "n_lines", F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).alias("n_removed"), F.coalesce(F.array_join(F.col("gone").cast("array<string>"), ","), F.lit("")).alias("removed"))
