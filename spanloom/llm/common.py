"""Shared plumbing: table access, materialising through the shared folder, Arrow batch slicing."""

from __future__ import annotations

import ctypes
import uuid
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.textvec import _P, U64, mix

#: Arrow batches are cut to about this many text bytes before numpy sees them.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, or under the context's checkpoint folder if that is unset.

    With neither, a local master gets a folder under /tmp; on a cluster, where that would be a folder of each machine,
    this raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "/tmp/spanloom-checkpoints"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/spanloom-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a folder made by :func:`shared_dir`."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: What this worker keeps between tasks: owner -> how to let it go.
CACHES: dict[str, Callable[[], None]] = {}
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release(owner: str | None = None) -> None:
    """Let go of what other operators keep between tasks, and give freed memory back to the system."""
    for name in [n for n in CACHES if n != owner]:
        CACHES.pop(name)()
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def tidy(run: Callable, owner: str | None = None) -> Callable:
    """``run`` for mapInArrow, with :func:`release` before and after: workers are reused by the tasks of other operators."""

    def tidied(batches):
        release(owner)
        try:
            yield from run(batches)
        finally:
            release(owner)

    return tidied


def share_of(h: np.ndarray, parts: int) -> np.ndarray:
    """Which of ``parts`` equal ranges of 64-bit hashes each one lies in."""
    return (((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int32)


def bits_for(entries: int) -> int:
    """log2 bits of a filter for so many entries: 16 bits an entry, 128 KiB to 16 MiB in all."""
    return min(27, max(20, int(max(1, entries)).bit_length() + 4))


def packed(arrays) -> list[pa.Array]:
    return [pa.array([a.tobytes()], pa.binary()) for a in arrays]


def bit_set(rows: DataFrame, numbers, bits: int) -> np.ndarray:
    """Packed set of the hashes that ``numbers`` makes of a batch, by their upper bits: 2**bits bits whatever the input.

    Tasks send only the parts of the set that they fill; these are joined by part before they come to the driver.
    """
    span = 1 << max(0, bits - 6 - 6)

    def mark(batches):
        out = np.zeros(1 << (bits - 6), U64)
        for b in batches:
            at = np.unique(numbers(b).view(U64) >> U64(64 - bits))
            word = (at >> U64(6)).astype(np.int64)
            if len(at):
                start = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
                out[word[start]] |= np.bitwise_or.reduceat(U64(1) << (at & U64(63)), start)
        for k in range(len(out) // span):
            some = out[k * span : (k + 1) * span]
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([some.tobytes()], pa.binary())], names=["k", "part"])

    def join(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for k, part in zip(b.column("k").to_pylist(), b.column("part").to_pylist(), strict=True):
                x = np.frombuffer(part, U64)
                held[k] = held[k] | x if k in held else x
        for k, x in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["k", "part"])

    # a task for each 256 KiB of the set
    tasks = min(64, max(4, 1 << max(0, bits - 21)), n_parts(rows.sparkSession))
    parts = rows.mapInArrow(tidy(mark), "k int, part binary").repartitionById(tasks, "k").mapInArrow(tidy(join), "k int, part binary")
    out = np.zeros(1 << (bits - 6), U64)
    for r in parts.collect():
        out[r.k * span : (r.k + 1) * span] = np.frombuffer(r.part, U64)
    return out


def in_set(packed_bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h.view(U64) >> U64(64 - (len(packed_bits).bit_length() + 5))
    return (packed_bits[(at >> U64(6)).astype(np.int64)] >> (at & U64(63))) & U64(1) > 0


def place_name(doc_id: np.ndarray, line: np.ndarray) -> np.ndarray:
    """A hash of an occurrence, spread over all bits."""
    return mix(doc_id.astype(np.int64).view(U64) * _P + line.astype(np.int64).view(U64))


def with_base(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(doc_id, base, text of the rows with a doc_id; whether a doc_id is repeated).

    ``base`` (0 but for a doc_id that is repeated) is to be added to places in a text (below 2**31): it sets the places
    of rows that repeat a doc_id with other texts apart, in order of the texts' hashes.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    repeated = docs.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
    if repeated.isEmpty():
        return docs.select("doc_id", F.lit(0).cast("long").alias("base"), "text"), False
    spark, name = docs.sparkSession, F.xxhash64("text")
    texts = docs.join(repeated, "doc_id", "left_semi").select("doc_id", name.alias("name")).distinct()
    # places in a range partitioning, so that a doc_id with very many texts is numbered by many tasks
    parts = n_parts(spark)
    dealt = materialise(texts.repartitionByRange(parts, "doc_id", "name").sortWithinPartitions("doc_id", "name").withColumn("at", F.monotonically_increasing_id()))
    step, sizes = F.shiftright("at", 33), {}
    for r in dealt.groupBy(step.alias("s")).agg(F.count("*").alias("k")).collect():
        sizes[r.s] = r.k
    before, total = {}, 1
    for s in sorted(sizes):
        before[s] = total
        total += sizes[s]
    first = spark.createDataFrame(list(before.items()), "s long, first long")  # a row for each partition
    place = F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("first")
    base = dealt.join(F.broadcast(first), step == F.col("s")).select("doc_id", "name", F.shiftleft(place, 31).alias("base"))
    return materialise(docs.withColumn("name", name).join(base, ["doc_id", "name"], "left").select("doc_id", F.coalesce("base", F.lit(0)).alias("base"), "text")), True


def slices(batch: pa.RecordBatch, col: str, most: int = SLICE_BYTES):
    """Cut a batch into runs of rows whose ``col`` holds at most ``most`` bytes (one row at least)."""
    n = batch.num_rows
    if not n:
        return
    size = pc.fill_null(pc.binary_length(batch.column(col)), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, s in enumerate(size.tolist()):
        if i > start and total + s > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += s
    yield batch.slice(start, n - start)


def most_frequent(df: DataFrame, count: str, most: int) -> DataFrame:
    """The rows whose ``count`` (1 or more) reaches the least threshold that at most ``most`` rows reach.

    Thresholds are steps of an eighth of a doubling, so what the driver gathers to choose one is a few hundred
    numbers; unlike ORDER BY ... LIMIT no task sends ``most`` rows of its own.
    """
    step = F.floor(F.log2(F.col(count)) * 8).cast("int")
    have, chosen = 0, 64 * 8
    for r in sorted(df.groupBy(step.alias("s")).agg(F.count("*").alias("k")).collect(), key=lambda r: -r.s):
        have += r.k
        if have > most:
            break
        chosen = r.s
    return df.where(step >= chosen)


def crc_mod(col: str, mod: int):
    """crc32 of an id as text, modulo ``mod``; null where the id is null."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(mod)


def crc_mod_py(value, mod: int) -> int:
    return zlib.crc32(str(value).encode()) % mod


def n_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def context(spark: SparkSession) -> SparkContext:
    return spark.sparkContext


def whole_groups(batches, key: str):
    """Batches regrouped so that rows of one ``key``, which arrive one after another, are never cut apart."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key)
        last = k[-1]
        first = int(pc.index(k, last).as_py())
        if first == 0 and (not held or held[-1].column(key)[-1] == last):
            held.append(b)  # one group that goes on
            continue
        if first == 0:  # a new group fills the batch
            yield pa.Table.from_batches(held).combine_chunks()
            held = [b]
            continue
        yield pa.Table.from_batches([*held, b.slice(0, first)]).combine_chunks()
        held = [b.slice(first)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (a, b) edges of longs: (node, component), the component being its least node.

    Rounds of contraction: every node moves to its first neighbour (or itself) by an order drawn anew each round, so
    the nodes that still have edges shrink by a constant share; nothing but counts comes to the driver.
    """
    edges = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    label = None
    turn = 0
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = F.struct(F.xxhash64(F.col("b"), F.lit(turn)).alias("o"), F.col("b").alias("v"))
        own = F.struct(F.xxhash64(F.col("a"), F.lit(turn)).alias("o"), F.col("a").alias("v"))
        move = materialise(both.groupBy("a").agg(F.min(order).alias("m")).select("a", F.least(own, F.col("m"))["v"].alias("to")))
        if label is None:
            label = move.select(F.col("a").alias("node"), F.col("to").alias("at"))
        else:
            label = label.join(move.select(F.col("a").alias("at"), "to"), "at", "left").select("node", F.coalesce("to", "at").alias("at"))
        label = materialise(label)
        edges = edges.join(move, "a").select(F.col("to").alias("a"), "b").join(move.select(F.col("a").alias("b"), F.col("to").alias("t")), "b").select("a", F.col("t").alias("b"))
        edges = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        turn += 1
    if label is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    least = label.groupBy("at").agg(F.min("node").alias("component"))
    return label.join(least, "at").select("node", "component")
