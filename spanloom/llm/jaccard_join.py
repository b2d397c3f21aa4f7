"""N-gram Jaccard self-join by chosen paths (operator 5).

Texts are sets of five-word shingles. In each repeat a set walks down a tree by the shingle it samples at every
level (a min-hash, so that sets with similarity J sample the same with probability J); a bucket with few sets stops
there, a larger one goes on splitting. Buckets are compared by brute force with exact similarities; those that stay
large at the last level (groups of close variants) in blocks. A pair is counted only in the first repeat in which
its two sets share a bucket, so nothing has to be told apart later, and no row is made per pair.

With ``DEPTH`` levels and ``REPEATS`` repeats a pair of similarity J is met with a probability of at least
1 - (1 - J**DEPTH)**REPEATS: 0.9998 at 0.8, 0.9999999 at 0.9 (1 - (1 - J)**REPEATS in buckets that stop at once).
Sets that are equal are one class from the start.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import textvec as tv
from spanloom.llm.common import components, materialise, n_parts, slices, table, tidy, whole_groups

SHINGLE, SIMILARITY, REPEATS, DEPTH = 5, 0.8, 12, 3
#: Sets of a bucket that stops splitting; sets of a block of a bucket that can't split further.
SMALL, BLOCK = 48, 512
_SEED = np.random.RandomState(5)
_XOR = _SEED.randint(0, 2**63 - 1, (REPEATS, DEPTH)).astype(tv.U64)
_ODD = (_SEED.randint(0, 2**62, (REPEATS, DEPTH)).astype(tv.U64) << tv.U64(1)) | tv.U64(1)


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes and row bounds."""
    buf, off = tv.strings(texts)
    row, h = tv.shingles(tv.words(tv.fold(buf), off), SHINGLE)
    return tv.unique_sets(row, h, len(off) - 1)


def set_keys(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit name of each set."""
    rows = len(bounds) - 1
    k1, k2 = np.zeros(rows, tv.U64), np.zeros(rows, tv.U64)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        k1[full] = np.add.reduceat(tv.mix(values), bounds[full])
        k2[full] = np.add.reduceat(tv.mix(values ^ tv.U64(0xA5A5A5A5DEADBEEF)), bounds[full])
    return k1.view(np.int64), k2.view(np.int64)


def paths(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Bucket names: rows x (REPEATS * DEPTH)."""
    rows = len(bounds) - 1
    out = np.zeros((rows, REPEATS * DEPTH), tv.U64)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if not len(full):
        return out.view(np.int64)
    for r in range(REPEATS):
        node = np.full(len(full), r + 1, tv.U64)
        for d in range(DEPTH):
            sampled = np.minimum.reduceat((values ^ _XOR[r, d]) * _ODD[r, d], bounds[full])
            node = tv.mix(node * tv._P + sampled)
            out[full, r * DEPTH + d] = node
    return out.view(np.int64)


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2 (name of its set), n (shingles), nodes."""

    def run(batches):
        for whole in batches:
            for b in slices(whole, "text"):
                values, bounds = shingle_sets(b.column("text"))
                k1, k2 = set_keys(values, bounds)
                nodes = pa.ListArray.from_arrays(pa.array(np.arange(len(k1) + 1, dtype=np.int32) * REPEATS * DEPTH), pa.array(paths(values, bounds).reshape(-1)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(k1), pa.array(k2), pa.array(np.diff(bounds)), nodes], names=["doc_id", "k1", "k2", "n", "nodes"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, k1 long, k2 long, n long, nodes array<long>")


def leaves(sets: DataFrame) -> DataFrame:
    """Where each set's walks end beside other sets: doc_id, n, r, node, size (rows of the bucket)."""
    walk = sets.select("doc_id", "n", "nodes", F.explode(F.sequence(F.lit(0), F.lit(REPEATS - 1))).alias("r"))
    walk = walk.select("doc_id", "n", "r", *(F.col("nodes")[F.col("r") * DEPTH + d].alias(f"n{d}") for d in range(DEPTH)))
    out = None
    for d in range(DEPTH):
        count = walk.groupBy(f"n{d}").agg(F.count("*").alias("size")).where("size > 1")
        met = materialise(walk.join(count, f"n{d}"))
        stop = met if d == DEPTH - 1 else met.where(F.col("size") <= SMALL)
        stop = stop.select("doc_id", "n", "r", F.col(f"n{d}").alias("node"), "size")
        out = stop if out is None else out.unionByName(stop)
        walk = met.where(F.col("size") > SMALL).drop("size")
    return out


def first_meetings(vectors: np.ndarray, r: int) -> np.ndarray:
    """Pairs (as a square of booleans) that share no bucket of an earlier repeat; vectors: members x REPEATS, 0 for none."""
    g = len(vectors)
    out = np.ones((g, g), bool)
    for q in range(r):
        v = vectors[:, q]
        out &= (v[:, None] != v[None, :]) | (v == 0)[:, None]
    np.fill_diagonal(out, False)
    return out


def similar_size(n: np.ndarray, similarity: float) -> np.ndarray:
    return np.minimum(n[:, None], n[None, :]) >= similarity * np.maximum(n[:, None], n[None, :]) - 1e-9


def vector_matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(-1, REPEATS)


def bounds_of(keys: np.ndarray) -> np.ndarray:
    return np.concatenate((np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))), [len(keys)]))


def intersections(values: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of sorted sets of distinct hashes."""
    g = len(values)
    if g == 2:
        a, b = values if len(values[0]) < len(values[1]) else values[::-1]
        at = np.minimum(np.searchsorted(b, a), len(b) - 1)
        k = int((b[at] == a).sum())
        return np.asarray([[0, k], [k, 0]])
    flat = np.concatenate(values)
    owner = np.repeat(np.arange(g), [len(v) for v in values])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate(([True], flat[1:] != flat[:-1]))
    column = np.cumsum(new) - 1
    shared = np.bincount(column) > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    column, owner = number[column[keep]], owner[keep]
    wide, out = int(shared.sum()), np.zeros((g, g), np.float32)
    cuts = np.searchsorted(column, np.arange(0, wide + 4096, 4096))
    for k, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        m = np.zeros((g, min(4096, wide - 4096 * k)), np.float32)
        m[owner[a:z], column[a:z] - 4096 * k] = 1
        out += m @ m.T
    return np.rint(out).astype(np.int64)


def roots(linked: np.ndarray) -> np.ndarray:
    """Least member of each member's component."""
    label = np.arange(len(linked))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(label)).min(axis=1, initial=len(label)))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def link_counts(docs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """doc_id, links, root for every bucket in which a representative set meets others."""
    own = materialise(leaves(sets))
    vector = own.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("r", "node"))).alias("walks"))
    joined = own.join(vector, "doc_id")

    def pack(batches):
        for b in batches:
            if not b.num_rows:
                continue
            flat = b.column("walks").flatten()
            v = np.zeros((b.num_rows, REPEATS), np.int64)
            rows = np.repeat(np.arange(b.num_rows), b.column("walks").value_lengths().to_numpy())
            v[rows, flat.field("r").to_numpy()] = flat.field("node").to_numpy()
            raw = v.tobytes()
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "n", "r", "node", "size")), pa.array([raw[k : k + 8 * REPEATS] for k in range(0, len(raw), 8 * REPEATS)], pa.binary())], names=["doc_id", "n", "r", "node", "size", "vector"])

    packed = joined.mapInArrow(tidy(pack), "doc_id long, n long, r int, node long, size long, vector binary")

    def screen(batches):
        """Members that meet a set of fitting size here for the first time."""
        for t in whole_groups(batches, "node"):
            node, r, n = (t.column(c).to_numpy() for c in ("node", "r", "n"))
            v, cut = vector_matrix(t.column("vector")), bounds_of(node)
            keep = np.zeros(len(node), bool)
            for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                keep[a:z] = (first_meetings(v[a:z], int(r[a])) & similar_size(n[a:z], similarity)).any(axis=1)
            yield from t.filter(pa.array(keep)).to_batches()

    parts = n_parts(docs.sparkSession)
    small = packed.where(F.col("size") <= BLOCK).repartition(parts, "node").sortWithinPartitions("node").mapInArrow(tidy(screen), packed.schema)
    needed = small.unionByName(packed.where(F.col("size") > BLOCK))
    per_doc = needed.groupBy("doc_id").agg(F.first("vector").alias("vector"), F.collect_list(F.struct("r", "node", "size")).alias("at"))
    wanted = per_doc.join(sets.select("doc_id", "k1", "k2", "w"), "doc_id")

    def emit(batches):
        """A row for each block of each bucket in which a set is to be compared."""
        for whole in batches:
            for b in slices(whole, "text", 1 << 20):
                values, bounds = shingle_sets(b.column("text"))
                k1, k2 = set_keys(values, bounds)
                same = (k1 == b.column("k1").to_numpy()) & (k2 == b.column("k2").to_numpy())
                out: list[tuple] = []

                def pour(rows):
                    cols = list(zip(*rows, strict=True))
                    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["grp", "r", "block", "low", "high", "doc_id", "w", "vector", "hashes"])

                ids, weight, vectors = b.column("doc_id").to_pylist(), b.column("w").to_pylist(), b.column("vector").to_pylist()
                for i, at in enumerate(b.column("at").to_pylist()):
                    if not same[i]:
                        continue
                    raw = values[bounds[i] : bounds[i + 1]].tobytes()
                    for x in at:
                        blocks = -(-x["size"] // BLOCK)
                        mine = ids[i] * 0x9E3779B97F4A7C15 % 2**64 % blocks
                        for other in range(blocks):
                            low, high = min(mine, other), max(mine, other)
                            group = (x["node"] * 1_000_003 + low * 65_537 + high) % 2**64
                            out.append((group - 2**63, x["r"], mine, low, high, ids[i], weight[i], vectors[i], raw))
                            if len(out) >= 500:
                                yield pour(out)
                                out.clear()
                if out:
                    yield pour(out)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id").mapInArrow(tidy(emit), "grp long, r int, block int, low int, high int, doc_id long, w long, vector binary, hashes binary")

    def verify(batches):
        for t in whole_groups(batches, "grp"):
            grp, ids, weight, block, r = (t.column(c).to_numpy() for c in ("grp", "doc_id", "w", "block", "r"))
            low, high, v = t.column("low").to_numpy(), t.column("high").to_numpy(), vector_matrix(t.column("vector"))
            raw, cut = t.column("hashes").combine_chunks() if isinstance(t.column("hashes"), pa.ChunkedArray) else t.column("hashes"), bounds_of(grp)
            out: list[tuple] = []
            for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                _, one = np.unique(ids[a:z], return_index=True)  # a row of documents may be repeated
                if len(one) < 2:
                    continue
                one += a
                sets_ = [np.frombuffer(raw[int(i)].as_buffer(), tv.U64) for i in one]
                n = np.asarray([len(s) for s in sets_])
                ask = first_meetings(v[one], int(r[a]))
                if low[a] != high[a]:
                    ask &= block[one][:, None] != block[one][None, :]
                ask &= similar_size(n, similarity)
                if not ask.any():
                    continue
                both = intersections(sets_)
                linked = ask & (both >= similarity * (n[:, None] + n[None, :] - both) - 1e-9)
                if not linked.any():
                    continue
                root, counts = roots(linked), linked @ weight[one]
                for k in np.flatnonzero(counts):
                    out.append((int(ids[one[k]]), int(counts[k]), int(ids[one[root[k]]])))
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "links", "root"])

    return rows.repartition(parts, "grp").sortWithinPartitions("grp").mapInArrow(tidy(verify), "doc_id long, links long, root long")


def jaccard_join(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of (doc_id, text): doc_id, class_id, copy_of, n_links.

    ``class_id`` is the least doc_id of those that links join, directly or not; ``copy_of`` that of the documents
    with the very same shingles; ``n_links`` the number of other documents of at least that similarity. Texts of
    fewer than five words are one shingle. A text without words (null, empty, white space) links to nothing and
    stands for itself. A null doc_id never names a class. Other columns are not read.
    """
    told = materialise(describe(docs))
    sets = told.where("n > 0 AND doc_id IS NOT NULL").groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("w"), F.first("n").alias("n"), F.first("nodes").alias("nodes"))
    sets = materialise(sets)
    found = materialise(link_counts(docs, sets, similarity))
    links = found.groupBy("doc_id").agg(F.sum("links").alias("links"))
    group = components(found.select(F.col("doc_id").alias("a"), F.col("root").alias("b")))
    known = sets.select("k1", "k2", "w", F.col("doc_id").alias("copy_of")).join(links.withColumnRenamed("doc_id", "copy_of"), "copy_of", "left").join(group.withColumnRenamed("node", "copy_of"), "copy_of", "left")
    known = known.select("k1", "k2", "copy_of", F.coalesce("component", "copy_of").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"))
    out = told.select("doc_id", "k1", "k2", "n").join(known, ["k1", "k2"], "left")
    real = (F.col("n") > 0) & F.col("copy_of").isNotNull()
    return out.select("doc_id", F.when(real, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.when(real, F.col("copy_of")).otherwise(F.col("doc_id")).alias("copy_of"), F.when(real, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs that stand for their class (the least doc_id; of rows that repeat it, all); all columns kept.

    Rows with a null doc_id stay.
    """
    gone = jaccard_join(docs, similarity).where("class_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, class_id, copy_of, n_links, as :func:`jaccard_join` defines them."""
    return jaccard_join(table(spark, sf_dir, "documents", "doc_id", "text"))
