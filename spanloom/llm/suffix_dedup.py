"""Exact removal of repeated 400-byte strings with difference-cover suffix arrays (operator 8).

Sorting every suffix of a corpus at once moves each byte many times, so the work is first dealt out by content:
every 400-byte window names its anchor, the least-hashed 64-byte gram in it; equal windows have equal anchors at
equal places. Windows that share an anchor and lie side by side form a context. A context that occurs twice repeats
as a whole; one whose anchor occurs nowhere else cannot repeat at all; what is left, contexts that share an anchor
but differ, goes to the tasks by anchor. There a suffix array is built by the difference-cover algorithm (sort
sampled triples, recurse on their names, sort the remaining suffixes by them, merge) and the 400-byte prefixes of
neighbours are compared byte by byte. Anchors with very many different contexts are not gathered: 128-bit hashes of
their windows are dealt over all tasks and counted there.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import textvec as tv
from spanloom.llm.common import bit_set, bits_for, in_set, materialise, n_parts, place_name, slices, table, tidy, whole_groups, with_base

LENGTH, GRAM = 400, 64
#: Different contexts of an anchor beyond which its windows are dealt by hash.
HOT_CONTEXTS = 2000
#: Context bytes whose suffixes are sorted together.
SORT_BYTES = 1 << 20


# --- suffix arrays ---------------------------------------------------------------------------------------------


def name_order(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order that sorts key, names from 1 in that order for each place)."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    name = np.empty(len(key), np.int64)
    name[order] = np.cumsum(np.concatenate(([True], k[1:] != k[:-1])))
    return order, name


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of an integer string (values from 0, below 2**20) by the difference cover {1, 2} modulo 3."""
    n = len(text)
    if n < 4:
        return np.asarray(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    t = np.zeros(n + 3, np.int64)
    t[:n] = text
    t[:n] += 1
    wide = int(t.max()) + 1
    # sampled triples; a dummy at n keeps the halves apart when n is 1 modulo 3
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate((one, two))
    key = (t[sample] * wide + t[sample + 1]) * wide + t[sample + 2]
    order, name = name_order(key)
    if name.max() == len(sample):
        ranked = order
    else:
        ranked = suffix_array(name - 1)
    sa12 = sample[ranked]
    rank = np.zeros(n + 3, np.int64)
    rank[sa12] = np.arange(1, len(sa12) + 1)
    sa12 = sa12[sa12 < n]
    # the other suffixes by their first symbol and the sampled suffix that follows
    zero = np.arange(0, n, 3)
    many = len(sample) + 2
    k0 = t[zero] * many + rank[zero + 1]
    zero = zero[np.argsort(k0, kind="stable")]
    # merge: places of the zeros among the sampled suffixes of either kind, each compared by what it can be
    mod = sa12 % 3
    a, b = sa12[mod == 1], sa12[mod == 2]
    before = np.searchsorted(t[a] * many + rank[a + 1], t[zero] * many + rank[zero + 1])
    before += np.searchsorted((t[b] * wide + t[b + 1]) * many + rank[b + 2], (t[zero] * wide + t[zero + 1]) * many + rank[zero + 2])
    out = np.empty(n, np.int64)
    at = before + np.arange(len(zero))
    out[at] = zero
    rest = np.ones(n, bool)
    rest[at] = False
    out[rest] = sa12
    return out


def eight_bytes(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one number (fewer places than bytes: the last seven have none)."""
    x = raw.astype(tv.U64)
    x = x[:-1] | (x[1:] << tv.U64(8))
    x = x[:-2] | (x[2:] << tv.U64(16))
    return x[:-4] | (x[4:] << tv.U64(32))


def common_prefixes(text: np.ndarray, sa: np.ndarray, length: int) -> np.ndarray:
    """Whether each suffix but the first shares its first ``length`` bytes with the one before it in sorted order.

    A few places tell most neighbours apart. What is left is compared in whole: neighbours that go on side by side
    lie on one diagonal of the text, whose equal bytes are counted once for all of them.
    """
    raw = np.append(text, np.full(length + 8, 257)) & 0xFF
    eight = eight_bytes(raw)
    a, b = sa[:-1], sa[1:]
    same = np.ones(len(a), bool)
    for at in (0, length - 8, length // 2):
        on = np.flatnonzero(same)
        same[on] = eight[a[on] + at] == eight[b[on] + at]
    on = np.flatnonzero(same)
    if not len(on):
        return same
    on = on[np.argsort(b[on], kind="stable")]
    i, apart = b[on], a[on] - b[on]
    new = np.concatenate(([True], (i[1:] != i[:-1] + 1) | (apart[1:] != apart[:-1])))
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(on)))
    # equal bytes on the diagonal of each stretch, from its first place to length bytes after its last
    span = size + length - 1
    start = np.concatenate(([0], np.cumsum(span)))
    place = np.arange(start[-1]) - np.repeat(start[:-1], span) + np.repeat(i[first], span)
    other = place + np.repeat(apart[first], span)
    padded = np.append(text, np.full(length + 8, 256))
    differ = np.concatenate(([0], np.cumsum((padded[place] != padded[other]) | (padded[place] == 256))))
    here = np.arange(len(on)) - np.repeat(first, size) + np.repeat(start[:-1], size)
    same[on] = differ[here + length] == differ[here]
    return same


def repeated_windows(contexts: list[bytes], windows: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For each context which of its first so many windows occur as a window of any other place among them all."""
    size = np.asarray([len(c) for c in contexts])
    text = np.full(int(size.sum()) + len(size), 256, np.int64)
    start = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
    own = np.zeros(len(text), bool)
    for s, c, n in zip(start.tolist(), contexts, windows, strict=True):
        text[s : s + len(c)] = np.frombuffer(c, np.uint8)
        own[s : s + n] = True
    sa = suffix_array(text)
    sa = sa[own[sa]]
    same = common_prefixes(text, sa, length)
    hit = np.zeros(len(text), bool)
    hit[sa[1:][same]] = True
    hit[sa[:-1][same]] = True
    return [hit[s : s + n] for s, n in zip(start.tolist(), windows, strict=True)]


# --- anchors ---------------------------------------------------------------------------------------------------


#: A number for each byte, for a second hash that is independent of the first.
SECOND = np.random.RandomState(8).randint(1, 2**63 - 1, 256, dtype=np.int64).astype(tv.U64)


def prefix_sums(buf: np.ndarray, numbers: np.ndarray = tv._BYTE) -> np.ndarray:
    up, _ = tv.place_powers(len(buf))
    out = np.zeros(len(buf) + 1, tv.U64)
    np.cumsum(numbers[buf] * up[: len(buf)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    _, down = tv.place_powers(len(sums))
    return tv.mix((sums[high] - sums[low]) * down[low] + (high - low).astype(tv.U64))


def window_hashes(buf: np.ndarray, length: int) -> np.ndarray:
    n = len(buf) - length + 1
    if n <= 0:
        return np.zeros(0, tv.U64)
    sums = prefix_sums(buf)
    _, down = tv.place_powers(len(sums))
    return tv.mix((sums[length:] - sums[:n]) * down[:n])


def sliding_least(key: np.ndarray, width: int) -> np.ndarray:
    """Least of key[i : i + width] for each i that has so many."""
    n = len(key)
    pad = -n % width
    x = np.concatenate((key, np.full(pad, ~tv.U64(0)))).reshape(-1, width)
    left = np.minimum.accumulate(x, axis=1).reshape(-1)
    right = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    m = n - width + 1
    return np.minimum(right[:m], left[width - 1 : width - 1 + m])


def anchors(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Contexts of a slice of texts: row, first and last window (places in buf), anchor and context hashes, and the prefix sums."""
    none = np.zeros(0, np.int64)
    n = len(buf) - LENGTH + 1
    sums = prefix_sums(buf)
    if n <= 0:
        return none, none, none, none.view(tv.U64), none.view(tv.U64), sums
    bits = tv.U64(max(1, int(len(buf)).bit_length()))
    _, down = tv.place_powers(len(sums))
    grams = tv.mix((sums[GRAM:] - sums[:-GRAM]) * down[: len(buf) - GRAM + 1])
    key = ((grams >> bits) << bits) | np.arange(len(grams), dtype=tv.U64)
    at = (sliding_least(key, LENGTH - GRAM + 1) & ((tv.U64(1) << bits) - tv.U64(1))).astype(np.int64)
    # windows inside one text
    row_starts, row_size = off[:-1], np.diff(off)
    fit = row_size >= LENGTH
    valid = np.zeros(n + 1, np.int8)
    np.add.at(valid, row_starts[fit], 1)
    np.add.at(valid, np.minimum(off[1:][fit] - LENGTH + 1, n), -1)
    valid = np.cumsum(valid[:n]) > 0
    new = valid.copy()
    new[1:] &= (at[1:] != at[:-1]) | ~valid[:-1]
    new[row_starts[fit]] = True
    low = np.flatnonzero(new)
    end = valid.copy()
    end[:-1] &= (at[1:] != at[:-1]) | ~valid[1:]
    later = row_starts[fit][1:] - 1
    end[later[(later >= 0) & (later < n)]] &= valid[later[(later >= 0) & (later < n)]]
    high = np.flatnonzero(end)
    row = np.searchsorted(off, low, "right") - 1
    place = at[low]
    anchor = span_hash(sums, place, place + GRAM)
    context = tv.mix(span_hash(sums, low, high + LENGTH) + (place - low).astype(tv.U64) * tv._P)
    return row, low, high, anchor, context, sums


def survey(docs: DataFrame) -> DataFrame:
    """doc_id, low, high (windows, as places in the text from its base on), anchor, context of every context."""

    def run(batches):
        for whole in batches:
            for b in slices(whole, "text"):
                buf, off = tv.strings(b.column("text"))
                row, low, high, anchor, context, _ = anchors(buf, off)
                local = b.column("base").to_numpy(zero_copy_only=False)[row] - off[row]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row)), pa.array(low + local), pa.array(high + local), pa.array(anchor.view(np.int64)), pa.array(context.view(np.int64))], names=["doc_id", "low", "high", "anchor", "context"])

    return docs.mapInArrow(tidy(run), "doc_id long, low long, high long, anchor long, context long")


RUNS = "doc_id long, low long, high long"


def runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def solve(docs: DataFrame, open_contexts: DataFrame) -> DataFrame:
    """Repeated windows (as runs) among contexts that share an anchor but differ; open_contexts: doc_id, low, anchor, kinds."""
    spark = docs.sparkSession
    parts = n_parts(spark)

    def places(b):
        return place_name(b.column("doc_id").to_numpy(), b.column("low").to_numpy())

    def names_of(b):
        return b.column("anchor").to_numpy().view(tv.U64)

    bits = bits_for(open_contexts.count())
    wanted = spark.sparkContext.broadcast(bit_set(open_contexts.select("doc_id", "low"), places, bits))
    hot = spark.sparkContext.broadcast(bit_set(open_contexts.where(F.col("kinds") > HOT_CONTEXTS).select("anchor").distinct(), names_of, bits))

    def found(b, want_hot: bool):
        buf, off = tv.strings(b.column("text"))
        row, low, high, anchor, _, sums = anchors(buf, off)
        none = np.zeros(0, np.int64)
        doc = b.column("doc_id").to_numpy(zero_copy_only=False)[row] if len(row) else none
        local = low + (b.column("base").to_numpy(zero_copy_only=False)[row] - off[row]) if len(row) else none
        on = np.flatnonzero(in_set(wanted.value, place_name(doc, local)) & (in_set(hot.value, anchor) == want_hot)) if len(row) else none
        return buf, local[on], low[on], high[on], anchor[on], doc[on], sums

    def ship(batches):
        for whole in batches:
            for b in slices(whole, "text"):
                buf, local, low, high, anchor, doc, _ = found(b, False)
                raw = buf.tobytes()
                text = [raw[a : z + LENGTH] for a, z in zip(low.tolist(), high.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(doc), pa.array(local), pa.array((high - low + 1).astype(np.int32)), pa.array(text, pa.binary())], names=["anchor", "doc_id", "low", "windows", "body"])

    def sort(batches):
        held: list = []
        size = 0

        def out():
            hits = repeated_windows([x[3] for x in held], [x[2] for x in held])
            rows = [(x[0], x[1] + a, x[1] + z) for x, hit in zip(held, hits, strict=True) if hit.any() for a, z in zip(*(v.tolist() for v in runs(hit)), strict=True)]
            cols = list(zip(*rows, strict=True)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "low", "high"])

        for t in whole_groups(batches, "anchor"):
            anchor = t.column("anchor").to_numpy()
            cut = np.concatenate((np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1]))), [len(anchor)]))
            doc, low, windows, body = (t.column(c).to_pylist() for c in ("doc_id", "low", "windows", "body"))
            for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if z - a < 2:
                    continue
                held += zip(doc[a:z], low[a:z], windows[a:z], body[a:z], strict=True)
                size += sum(map(len, body[a:z]))
                if size > SORT_BYTES:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    ordinary = docs.mapInArrow(tidy(ship), "anchor long, doc_id long, low long, windows int, body binary").repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(tidy(sort), RUNS)
    if open_contexts.where(F.col("kinds") > HOT_CONTEXTS).isEmpty():
        return ordinary

    def deal(batches):
        """Window hashes of hot anchors, a row for each share of a slice."""
        for whole in batches:
            for b in slices(whole, "text"):
                buf, local, low, high, _, doc, sums = found(b, True)
                if not len(low):
                    continue
                other = prefix_sums(buf, SECOND)
                n = high - low + 1
                shift = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = np.repeat(low, n) + shift
                h, h2, doc, place = span_hash(sums, at, at + LENGTH), span_hash(other, at, at + LENGTH), np.repeat(doc, n), np.repeat(local, n) + shift
                share = (h % tv.U64(parts)).astype(np.int64)
                by = np.argsort(share, kind="stable")
                cut = np.searchsorted(share[by], np.arange(parts + 1))
                some = [(k, by[a:z]) for k, (a, z) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if z > a]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in some], pa.int32()), *(pa.array([v[i].tobytes() for _, i in some], pa.binary()) for v in (h, h2, doc.astype(np.int64), place.astype(np.int64)))], names=["share", "hashes", "seconds", "docs", "places"])

    def count(batches):
        for t in whole_groups(batches, "share"):
            h, h2, doc, place = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.int64) for c in ("hashes", "seconds", "docs", "places"))
            order = np.lexsort((h2, h))
            twin = (h[order][1:] == h[order][:-1]) & (h2[order][1:] == h2[order][:-1])
            several = np.zeros(len(h), bool)
            several[order[1:][twin]] = True
            several[order[:-1][twin]] = True
            on = np.flatnonzero(several)
            by = on[np.lexsort((place[on], doc[on]))]
            if not len(by):
                continue
            # one row for each text; windows of other shares lie between its places
            d, p = doc[by], place[by]
            cut = np.concatenate((np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (p[1:] >> 31 != p[:-1] >> 31)))), [len(d)]))
            yield pa.RecordBatch.from_arrays([pa.array(d[cut[:-1]]), tv.list_array(p, cut, pa.int64())], names=["doc_id", "places"])

    dealt = docs.mapInArrow(tidy(deal), "share int, hashes binary, seconds binary, docs binary, places binary").repartitionById(parts, "share").sortWithinPartitions("share").mapInArrow(tidy(count), "doc_id long, places array<long>")
    return ordinary.select("doc_id", "low", "high", F.lit(None).cast("array<long>").alias("places")).unionByName(dealt.select("doc_id", F.lit(None).cast("long").alias("low"), F.lit(None).cast("long").alias("high"), "places"))


def repeated_runs(docs: DataFrame) -> DataFrame:
    """doc_id, base, lows, highs, places: the windows of each row that occur elsewhere, as runs and single places."""
    told = materialise(survey(docs))
    kinds = materialise(told.groupBy("anchor", "context").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "low")).alias("rep")))
    whole = told.join(kinds.where("c > 1").select("anchor", "context"), ["anchor", "context"]).select("doc_id", "low", "high")
    many = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    open_contexts = materialise(kinds.join(many, "anchor").select(F.col("rep.doc_id").alias("doc_id"), F.col("rep.low").alias("low"), "anchor", "kinds"))
    solved = solve(docs, open_contexts)
    if "places" not in solved.columns:
        solved = solved.withColumn("places", F.lit(None).cast("array<long>"))
    both = whole.withColumn("places", F.lit(None).cast("array<long>")).unionByName(solved.select("doc_id", "low", "high", "places"))
    start = F.shiftleft(F.shiftright(F.coalesce("low", F.col("places")[0]), 31), 31)
    return both.groupBy("doc_id", start.alias("base")).agg(F.collect_list("low").alias("lows"), F.collect_list("high").alias("highs"), F.flatten(F.collect_list("places")).alias("places"))


def spans_removed(size: int, low: np.ndarray, high: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal removed byte runs [start, end) under windows that repeat."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, np.concatenate((low, places)), 1)
    np.add.at(edge, np.concatenate((high, places)) + LENGTH, -1)
    gone = np.concatenate(([0], np.cumsum(edge[:size]) > 0, [0])).astype(np.int8)
    step = np.diff(gone)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per row of (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left).

    A null text is empty. Rows are told apart by doc_id and text, whether the doc_id is unique, repeated or null; rows
    that repeat both repeat each other's text. Texts under 400 bytes lose nothing; long ones are read whole. Other
    columns are not read. An empty table gives an empty one.
    """
    least = -(2**63)  # the id of rows without one
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows, _ = with_base(docs.withColumn("doc_id", F.coalesce("doc_id", F.lit(least))))
    found = repeated_runs(rows.where(F.octet_length("text") >= LENGTH))

    def cut(batches):
        for whole in batches:
            for b in slices(whole, "text"):
                out = []
                for text, base, low, high, places in zip(*(b.column(c).to_pylist() for c in ("text", "base", "lows", "highs", "places")), strict=True):
                    raw = (text or "").encode()
                    gone = spans_removed(len(raw), *(np.asarray(v or [], np.int64) - base for v in (low, high, places))) if low or places else (np.zeros(0, np.int64),) * 2
                    kept, at = [], 0
                    for a, z in zip(*(v.tolist() for v in gone), strict=True):
                        kept.append(raw[at:a])
                        at = z
                    left = b"".join([*kept, raw[at:]])
                    out.append((len(raw), len(raw) - len(left), len(gone[0]), hashlib.sha256(left).hexdigest(), left))
                cols = list(zip(*out, strict=True))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    joined = rows.join(found, ["doc_id", "base"], "left")
    out = joined.select("doc_id", "base", "text", "lows", "highs", "places").mapInArrow(tidy(cut), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != least, F.col("doc_id")))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, as :func:`remove_repeats` defines them, and text.

    ``text`` is what is left; bytes of a character that a removed run has cut through show as U+FFFD.
    """
    out = remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.withColumn("text", F.make_valid_utf8(F.col("kept").cast("string"))).drop("kept")
