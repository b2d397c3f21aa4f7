"""Exact top-k inner-product search with multi-resolution segment statistics (operator 6).

With segment means m, deviations s and length L, |q - x|^2 >= sum L ((mq - mx)^2 + (sq - sx)^2); together with the
norms that bounds the inner product from above: q.x <= sum L (mq mx + sq sx). Bounds are taken on few long segments
first, on more, shorter ones for the pairs that are left, and exact integer products of the survivors alone decide.
Every level is computed pair by pair where few pairs are left, and as one matrix product over the rows that have
any where many are: the arithmetic differs, the levels and what survives them do not.

Queries and rows are packed as blocks and dealt to the cells of a grid, a group of query blocks by a group of row
blocks; a cell holds its queries and lets its row blocks pass. Each query's floor under its k-th score comes from a
bounded sample of rows and rises with what its cell has found.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import materialise, table, tidy, whole_groups

K, SCALE, EVERY = 20, 64, 20
#: Rows and queries of a block, rows of the sample that sets the floors, segments of each resolution.
ROWS, QUERIES, SAMPLE, RESOLUTIONS = 4096, 1024, 4096, (4, 16)
#: Share of a block's pairs beyond which a level is computed as a matrix product; queries met at a time.
DENSE, STRIP = 0.02, 256
#: Groups of row blocks, and query blocks that a cell holds, at most.
GROUPS, HELD = 1024, 32
PARTIAL = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id and floor(64 * x) as longs of the vectors without null or non-finite components (and not null); empty ones take part."""
    v = F.col("embedding")
    good = F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("v"))


def to_blocks(batches, rows: int, name: str):
    """Vectors packed as blocks: ids, matrix (row-major longs), dim."""
    held: dict[int, tuple[list, list]] = {}

    def out(dim):
        ids, values = held.pop(dim)
        return pa.RecordBatch.from_arrays([pa.array([np.asarray(ids, np.int64).tobytes()], pa.binary()), pa.array([np.asarray(values, np.int64).tobytes()], pa.binary()), pa.array([dim], pa.int32())], names=["ids", "matrix", "dim"])

    for b in batches:
        for i, v in zip(b.column("vec_id").to_pylist(), b.column("v").to_pylist(), strict=True):
            ids, values = held.setdefault(len(v), ([], []))
            ids.append(i)
            values.append(v)
            if len(ids) == rows:
                yield out(len(v))
    for dim in list(held):
        yield out(dim)


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of segments, scaled so that the product of two rows' statistics bounds their inner product."""
    n, dim = x.shape
    edge = np.linspace(0, dim, min(segments, max(1, dim)) + 1).astype(int)
    parts = []
    for a, z in zip(edge[:-1], edge[1:], strict=True):
        if z > a:
            s = x[:, a:z]
            parts += [s.mean(axis=1) * np.sqrt(z - a), s.std(axis=1) * np.sqrt(z - a)]
    return np.stack(parts, 1) if parts else np.zeros((n, 1))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of paired rows: 64-bit integers, or Python's where those could overflow."""
    if q.size == 0:
        return np.zeros(len(q), np.int64)
    if float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] < 2**62:
        return np.einsum("ij,ij->i", q, x)
    return np.asarray([sum(a * b for a, b in zip(r.tolist(), s.tolist(), strict=True)) for r, s in zip(q, x, strict=True)], object)


def leaders(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k highest scores, ties to smaller ids, by query and rank."""
    by = np.lexsort((ids, ~score, q))
    q = q[by]
    first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.zeros(0, int)
    turn = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return by[turn < k]


def long_scores(score: np.ndarray) -> np.ndarray:
    """Scores as longs; those beyond 64 bits stop at the least or greatest one."""
    return score if score.dtype == np.int64 else np.asarray([min(max(int(v), -(2**63)), 2**63 - 1) for v in score.tolist()], np.int64)


class Rows:
    """A block of rows with its statistics at every resolution."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x, self.xf = ids, x, x.astype(np.float64)
        self.levels = [statistics(self.xf, s) for s in RESOLUTIONS]
        self.top = float(np.abs(x).max()) if x.size else 0.0
        self.norm = float(np.sqrt((self.xf**2).sum(axis=1)).max()) if x.size else 0.0


class Asked(Rows):
    """A block of queries with their floors and what they have found so far."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, floor: np.ndarray):
        super().__init__(ids, x)
        self.floor = floor.copy()
        self.found = tuple(np.zeros(0, np.int64) for _ in range(3))  # query number, row id, score
        self.tried = [0] * (len(RESOLUTIONS) + 2)  # pairs met, left by each level, that reached the floor

    def narrowed(self, left: np.ndarray, strip: slice, rows: Rows, level: int, limit: np.ndarray) -> np.ndarray:
        """``left`` less the pairs whose bound at this level stays under the limit."""
        mine, theirs, out = self.levels[level][strip], rows.levels[level], np.zeros_like(left)
        if np.count_nonzero(left) > DENSE * left.size:
            cols = np.flatnonzero(left.any(axis=0))
            bound = mine @ (theirs if len(cols) == left.shape[1] else theirs[cols]).T
            out[:, cols] = left[:, cols] & (bound >= limit)
            return out
        i, j = np.nonzero(left)
        for c in range(0, len(i), 65536):
            at, to = i[c : c + 65536], j[c : c + 65536]
            out[at, to] = np.einsum("ij,ij->i", mine[at], theirs[to]) >= limit[at, 0]
        return out

    def scores(self, left: np.ndarray, strip: slice, rows: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, row number, exact product) of the pairs that are left and reach the floor."""
        # doubles hold the products and their sums exactly up to here
        if np.count_nonzero(left) > DENSE * left.size and self.top * rows.top * max(1, self.x.shape[1]) < 2**52:
            cols = np.flatnonzero(left.any(axis=0))
            score = self.xf[strip] @ (rows.xf if len(cols) == left.shape[1] else rows.xf[cols]).T
            i, j = np.nonzero(left[:, cols] & (score >= self.floor[strip, None]))
            return i + strip.start, cols[j], score[i, j].astype(np.int64)
        i, j = np.nonzero(left)
        i += strip.start
        got = [products(self.x[i[c : c + 65536]], rows.x[j[c : c + 65536]]) for c in range(0, len(i), 65536)]
        score = np.concatenate([long_scores(g) for g in got]) if got else np.zeros(0, np.int64)
        on = score >= self.floor[i]
        return i[on], j[on], score[on]

    def meet(self, rows: Rows, k: int) -> None:
        """Let a block of rows pass: coarse bounds, finer bounds, products of the survivors; floors rise."""
        parts = [self.found]
        for a in range(0, len(self.ids), STRIP):
            strip = slice(a, min(a + STRIP, len(self.ids)))
            # a bound may be off by rounding; keep what comes within that of the floor
            floor = self.floor[strip, None]
            limit = floor - 1e-6 * (1 + np.abs(floor)) - 1e-9 * self.norm * rows.norm
            left = self.ids[strip, None] != rows.ids[None, :]
            self.tried[0] += left.size
            for level in range(len(RESOLUTIONS)):
                left = self.narrowed(left, strip, rows, level, limit)
                self.tried[level + 1] += int(np.count_nonzero(left))
            i, j, score = self.scores(left, strip, rows)
            self.tried[-1] += len(i)
            parts.append((i, rows.ids[j], score))
        q, ids, score = (np.concatenate(c) for c in zip(*parts, strict=True))
        on = leaders(q, ids, score, k)
        q, ids, score = self.found = (q[on], ids[on], score[on])
        # the k-th of those that have k: each query's last place, as places are by query and rank
        last = np.flatnonzero(np.concatenate((q[1:] != q[:-1], [True]))) if len(q) else np.zeros(0, int)
        full = last[np.bincount(q, minlength=len(self.ids))[q[last]] >= k] if len(q) else last
        self.floor[q[full]] = np.maximum(self.floor[q[full]], under(score[full].astype(np.float64)))


def under(score: np.ndarray) -> np.ndarray:
    """Under a score by more than rounding."""
    return score - 1 - 1e-9 * np.abs(score)


def counted(blocks: DataFrame) -> tuple[int, int]:
    """How many blocks there are, and the tasks that made them."""
    r = blocks.agg(F.count("*").alias("n"), F.coalesce(F.max(F.shiftright("block", 33)), F.lit(0)).alias("last")).first()
    return r.n, r.last + 1


def group_of(block: str, parts: int, groups: int):
    """The group of a block: blocks of all tasks are numbered in turn, without a pass over them."""
    return F.pmod(F.col(block).bitwiseAND(F.lit((1 << 33) - 1)) * parts + F.shiftright(block, 33), F.lit(groups))


def search(vectors: DataFrame, is_query, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row the k highest integer inner products with other rows, ties to the smaller id.

    Rows with the query's own id are no candidates; a repeated id counts as often as it occurs. Vectors of different
    lengths don't meet. Empty input gives no rows. Scores beyond 64 bits stop at the least or greatest long.
    """
    rows = quantised(vectors)
    blocks = materialise(rows.mapInArrow(lambda it: to_blocks(it, ROWS, "x"), "ids binary, matrix binary, dim int").withColumn("block", F.monotonically_increasing_id()))
    asked = rows.where(is_query).mapInArrow(lambda it: to_blocks(it, QUERIES, "q"), "ids binary, matrix binary, dim int")
    asked = asked.withColumn("block", F.monotonically_increasing_id())

    def matrix(ids: bytes, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        i = np.frombuffer(ids, np.int64)
        return i, np.frombuffer(raw, np.int64).reshape(len(i), -1)

    # floors: a bounded sample of distinct rows, each query's own left out
    sample = rows.dropDuplicates(["vec_id"]).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    by_dim: dict[int, tuple[list, list]] = {}
    for i, v in zip(sample.column("vec_id").to_pylist(), sample.column("v").to_pylist(), strict=True):
        by_dim.setdefault(len(v), ([], []))
        by_dim[len(v)][0].append(i)
        by_dim[len(v)][1].append(v)
    held = vectors.sparkSession.sparkContext.broadcast({d: (np.asarray(i), np.asarray(v, np.int64).reshape(len(i), d)) for d, (i, v) in by_dim.items()})

    def floors(batches):
        for b in batches:
            for ids, raw, dim, block in zip(*(b.column(c).to_pylist() for c in ("ids", "matrix", "dim", "block")), strict=True):
                q_ids, q = matrix(ids, raw)
                floor = np.full(len(q_ids), -(2.0**62))
                s_ids, s = held.value.get(dim, (np.zeros(0, np.int64), np.zeros((0, dim), np.int64)))
                if len(s_ids) > k:
                    got = q.astype(np.float64) @ s.T.astype(np.float64)
                    got[q_ids[:, None] == s_ids[None, :]] = -np.inf
                    floor = under(np.partition(got, len(s_ids) - k, axis=1)[:, len(s_ids) - k])
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((ids, raw, dim, block, floor.tobytes()), (pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["ids", "matrix", "dim", "block", "floor"])

    ready = materialise(asked.mapInArrow(tidy(floors), "ids binary, matrix binary, dim int, block long, floor binary"))
    # every query block meets every row block of its length in one cell of the grid; blocks, not rows, are copied
    n_rows, row_parts = counted(blocks)
    n_asked, asked_parts = counted(ready)
    across = max(1, min(n_rows, GROUPS))
    down = max(1, min(n_asked, max(-(-n_asked // HELD), -(-4 * vectors.sparkSession.sparkContext.defaultParallelism // across))))
    to_rows = ready.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(across - 1)))).withColumn("cell", F.col("g") * down + group_of("block", asked_parts, down))
    to_asked = blocks.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(down - 1)))).withColumn("cell", group_of("block", row_parts, across) * down + F.col("g"))
    dealt = to_rows.unionByName(to_asked.withColumn("floor", F.lit(None).cast("binary"))).drop("g")
    dealt = dealt.repartitionById(across * down, F.col("cell").cast("int")).sortWithinPartitions("cell", "dim", F.col("floor").isNull(), "block")

    def meet(batches):
        place, held = None, []

        def out():
            for h in held:
                q, ids, score = h.found
                yield pa.RecordBatch.from_arrays([pa.array(h.ids[q]), pa.array(ids), pa.array(score)], names=["query_id", "vec_id", "score"])

        for b in batches:
            for cell, dim, ids, raw, floor in zip(*(b.column(c) for c in ("cell", "dim", "ids", "matrix", "floor")), strict=True):
                if (now := (cell.as_py(), dim.as_py())) != place:
                    yield from out()
                    place, held = now, []
                if floor.is_valid:
                    held.append(Asked(*matrix(ids.as_buffer(), raw.as_buffer()), np.frombuffer(floor.as_buffer(), np.float64)))
                elif held:
                    block = Rows(*matrix(ids.as_buffer(), raw.as_buffer()))
                    for h in held:
                        h.meet(block, k)
        yield from out()

    found = dealt.mapInArrow(tidy(meet), PARTIAL)

    def merge(batches):
        for t in whole_groups(batches, "query_id"):
            q, v, s = (t.column(c).to_numpy() for c in ("query_id", "vec_id", "score"))
            first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
            turn = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q)))) + 1
            on = turn <= k
            yield pa.RecordBatch.from_arrays([pa.array(q[on]), pa.array(turn[on].astype(np.int32)), pa.array(v[on]), pa.array(s[on])], names=["query_id", "rank", "vec_id", "score"])

    # a query has at most k rows a group of row blocks here
    return found.repartition("query_id").sortWithinPartitions("query_id", F.desc("score"), "vec_id").mapInArrow(tidy(merge), "query_id long, rank int, vec_id long, score long")


def op6_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score of the 20 best rows for each vec_id divisible by 20."""
    return search(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % EVERY == 0)


SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, x.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, x.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v x ON q.vec_id % {EVERY} = 0 AND x.vec_id <> q.vec_id AND len(q.v) = len(x.v)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s
)
SELECT query_id, CAST(k AS INTEGER) AS "rank", vec_id, score FROM r WHERE k <= {K}
"""
