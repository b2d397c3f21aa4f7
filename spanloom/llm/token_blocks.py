"""Token-id output in patched frame-of-reference blocks (operator 1).

File format, one self-contained shard per row of the written table (so that Spark's committer makes the write
retry-safe in any store): little endian,

    magic ``SLPF``, u32 version, u64 documents, u64 ids, u64 blocks, u64 exceptions, u64 packed bytes
    doc_id       i64[documents]      (a null id is stored as the least i64)
    doc_end      u64[documents]      ids of this shard up to and with each document
    block_start  u64[blocks + 1]     byte at which each block's packed ids start
    block_min    u32[blocks]         frame of reference
    block_width  u8[blocks]          bits an id, chosen at ``PERCENTILE`` of the block's differences
    patch_start  u64[blocks + 1]     first exception of each block
    patch_at     u8[exceptions]      place in the block
    patch_value  u32[exceptions]     the whole difference
    packed       bytes

A block is 128 ids; the last one of a shard is padded with its minimum.
"""

from __future__ import annotations

import os
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm.chunks import MARKS, MEMO_ENTRIES, ChunkMemo
from spanloom.llm.common import CACHES, n_parts, shared_dir, slices, table, tidy

MAGIC, VERSION, BLOCK, PERCENTILE, END_ID = b"SLPF", 1, 128, 0.9, 2
#: Ids after which a writer closes its shard.
SHARD_IDS = 2_000_000
#: Text bytes whose chunks are told apart together.
ENCODE_BYTES = 8 << 20
#: Words whose letters lie under U+0250, without the one (U+0130) that does not lower-case to a single letter.
LATIN = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+$"
#: Marks after such a word; a chunk with more is encoded whole.
LONGEST_TAIL = 8
NO_ID = -(2**63)
SHARDS = "shard long, seq int, n_docs long, n_ids long, payload binary"


NOTHING = pa.array([], pa.string()), pa.array([], pa.large_binary())


class LibraryMemo(ChunkMemo):
    """Chunks' ids as bytes, from the tokenizers library. Latin words, nearly all of a text, are kept and met as Arrow arrays."""

    def __init__(self, path: str, most: int = MEMO_ENTRIES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        def library():
            tok = Tokenizer.from_file(path)
            tok.no_truncation()
            tok.no_padding()
            return tok

        # normalising leaves lower-case Latin words alone, and each is one pre-token
        self.whole, self.bare = library(), library()
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.closes = np.zeros(self.whole.get_vocab_size() + 1, bool)
        for s, i in self.whole.get_vocab().items():
            self.closes[i] = s.endswith("</w>")
        super().__init__(lambda some: self.words_by(self.whole, some).to_pylist(), self.others_by, bytes.__add__, most)
        self.known = self.known_before = NOTHING

    def others_by(self, some: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.whole.encode_batch_fast(some, add_special_tokens=False)]

    def words_by(self, tok, some: list[str]) -> pa.Array:
        lines = [" ".join(some[i : i + 256]) for i in range(0, len(some), 256)]
        ids = [np.asarray(e.ids, "<u4") for k in range(0, len(lines), 64) for e in tok.encode_batch_fast(lines[k : k + 64], add_special_tokens=False)]
        ids = np.concatenate([np.zeros(0, "<u4"), *ids])
        # a plain word is one pre-token, and the last token of each pre-token closes it
        stops = 4 * (np.flatnonzero(self.closes[ids]) + 1)
        if len(stops) != len(some):
            return pa.array(self.others_by(some), pa.large_binary())
        return pa.Array.from_buffers(pa.large_binary(), len(some), [None, pa.py_buffer(np.concatenate(([0], stops)).astype(np.int64)), pa.py_buffer(ids)])

    def latin(self, words: pa.Array) -> pa.Array:
        """Values of distinct lower-case Latin words."""
        young, old = (values.take(pc.index_in(words, value_set=names)) for names, values in (self.known, self.known_before))
        out = pc.coalesce(young, old)
        fresh = words.filter(out.is_null())
        if len(fresh):
            out = pc.replace_with_mask(out, out.is_null(), self.words_by(self.bare, fresh.to_pylist()))
        new = young.is_null()
        if len(self.known[0]) > self.most:
            self.known_before, self.known = self.known, NOTHING
        self.known = tuple(pa.concat_arrays([a, b.filter(new)]) for a, b in zip(self.known, (words, out), strict=True))
        return out

    def distinct_values(self, chunks: pa.Array) -> pa.Array:
        """Values of distinct chunks without ASCII white space."""
        core = pc.ascii_rtrim(chunks, MARKS)
        tail_size = pc.subtract(pc.binary_length(chunks), pc.binary_length(core)).to_numpy(zero_copy_only=False)
        latin = pc.match_substring_regex(core, LATIN).to_numpy(zero_copy_only=False) & (tail_size <= LONGEST_TAIL)
        low = pc.utf8_lower(core.filter(pa.array(latin))).dictionary_encode()
        parts = [self.latin(low.dictionary).take(low.indices)]
        size, some = tail_size[latin], chunks.filter(pa.array(latin))
        if size.any():
            tail = np.zeros(len(size), np.int64)
            tails = [b""]
            for n in np.unique(size[size > 0]).tolist():
                own = pc.utf8_slice_codeunits(some.filter(pa.array(size == n)), -n).dictionary_encode()
                tail[size == n] = own.indices.to_numpy() + len(tails)
                tails += self.values_in(own.dictionary.to_pylist())
            parts.append(pa.array(tails, pa.large_binary()).take(pa.array(tail)))
            parts = [pc.binary_join_element_wise(*parts, pa.scalar(b"", pa.large_binary()))]
        rest = self.values_in(chunks.filter(pa.array(~latin)).to_pylist())
        at = np.empty(len(chunks), np.int64)
        at[latin] = np.arange(len(some))
        at[~latin] = len(some) + np.arange(len(rest))
        return pa.concat_arrays([*parts, pa.array(rest, pa.large_binary())]).take(pa.array(at))

    def values_in(self, chunks: list[str]) -> list[bytes]:
        self.learn([c for c in chunks if c not in self])
        return list(map(self.__getitem__, chunks))

    def joined(self, texts: pa.Array, end: bytes) -> tuple[pa.Buffer, np.ndarray]:
        """The ids of the texts one after another as bytes, each text's with ``end`` after them, and where each text ends.

        Cut at ASCII white space only: other white space stays within a chunk and is folded there.
        """
        cut = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = cut.flatten().dictionary_encode()
        values = pa.concat_arrays([self.distinct_values(coded.dictionary.cast(pa.string())), pa.array([end], pa.large_binary())])
        stops = np.diff(cut.offsets.to_numpy()).cumsum()
        at = np.insert(coded.indices.to_numpy().astype(np.int64), stops, len(coded.dictionary))
        out = values.take(pa.array(at))
        ends = np.frombuffer(out.buffers()[1], np.int64)[: len(at) + 1]
        return out.buffers()[2], ends[stops + np.arange(1, len(stops) + 1)]


@lru_cache(1)
def library_memo(path: str) -> LibraryMemo:
    return LibraryMemo(path)


def put_bits(x: np.ndarray, w: int) -> np.ndarray:
    """Blocks of 128 numbers under 2**w (rows) as rows of 16 * w bytes, least bits first."""
    t = np.ascontiguousarray(x.T).astype(np.uint64)
    out = np.zeros((2 * w, len(x)), np.uint64)
    for j in range(BLOCK):
        k, shift = divmod(j * w, 64)
        out[k] |= t[j] << np.uint64(shift)
        if shift + w > 64:
            out[k + 1] |= t[j] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T).view(np.uint8)


def get_bits(raw: np.ndarray, w: int) -> np.ndarray:
    t = np.ascontiguousarray(np.ascontiguousarray(raw).view("<u8").T)
    out, mask = np.empty((BLOCK, raw.shape[0]), np.uint32), np.uint64((1 << w) - 1)
    for j in range(BLOCK):
        k, shift = divmod(j * w, 64)
        v = t[k] >> np.uint64(shift)
        if shift + w > 64:
            v = v | (t[k + 1] << np.uint64(64 - shift))
        out[j] = v & mask
    return np.ascontiguousarray(out.T)


def pack(ids: np.ndarray, doc_id: np.ndarray, doc_end: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    n = len(ids)
    blocks = -(-n // BLOCK)
    x = np.empty((blocks, BLOCK), np.uint32)
    flat = x.reshape(-1)
    flat[:n] = ids
    if n < len(flat):
        flat[n:] = ids[(blocks - 1) * BLOCK :].min()
    low = x.min(axis=1) if blocks else np.zeros(0, np.uint32)
    diff = x - low[:, None]
    at = min(BLOCK - 1, int(percentile * BLOCK))
    limit = np.partition(diff, at, axis=1)[:, at] if blocks else low
    width = np.ceil(np.log2(limit.astype(np.float64) + 1)).astype(np.uint8)
    over = diff > ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)[:, None]
    rows, cols = np.nonzero(over)
    patch_value = diff[rows, cols]
    patch_start = np.concatenate(([0], np.cumsum(over.sum(axis=1)))).astype("<u8")
    diff[over] = 0
    starts = np.concatenate(([0], np.cumsum(width.astype(np.int64) * (BLOCK // 8))))
    packed = np.zeros(int(starts[-1]), np.uint8)
    for w in np.unique(width):
        if w:
            own = np.flatnonzero(width == w)
            for a in range(0, len(own), 4096):
                some = own[a : a + 4096]
                out = put_bits(diff[some], int(w))
                packed[starts[some][:, None] + np.arange(out.shape[1])] = out
    head = struct.pack("<4sI5Q", MAGIC, VERSION, len(doc_id), n, blocks, len(rows), len(packed))
    parts = (doc_id.astype("<i8"), doc_end.astype("<u8"), starts.astype("<u8"), low.astype("<u4"), width, patch_start, cols.astype(np.uint8), patch_value.astype("<u4"), packed)
    return head + b"".join(p.tobytes() for p in parts)


def unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_id, doc_end, ids) of a shard."""
    magic, version, docs, n, blocks, patches, size = struct.unpack_from("<4sI5Q", payload)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a token shard")
    at = struct.calcsize("<4sI5Q")

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(payload, kind, count, at)
        at += out.nbytes
        return out

    doc_id, doc_end, starts, low, width = take("<i8", docs), take("<u8", docs), take("<u8", blocks + 1), take("<u4", blocks), take("u1", blocks)
    patch_start, patch_at, patch_value, packed = take("<u8", blocks + 1), take("u1", patches), take("<u4", patches), take("u1", size)
    x = np.zeros((blocks, BLOCK), np.uint32)
    for w in np.unique(width):
        if w:
            own = np.flatnonzero(width == w)
            for a in range(0, len(own), 4096):
                some = own[a : a + 4096]
                raw = packed[starts[some].astype(np.int64)[:, None] + np.arange(int(w) * BLOCK // 8)]
                x[some] = get_bits(raw, int(w))
    rows = np.repeat(np.arange(blocks), np.diff(patch_start.astype(np.int64)))
    x[rows, patch_at] = patch_value
    x += low[:, None]
    return doc_id, doc_end, x.reshape(-1)[:n]


def write_token_shards(docs: DataFrame, path: str, tokenizer_path: str, shard_ids: int = SHARD_IDS, percentile: float = PERCENTILE, end_id: int = END_ID) -> None:
    """Encode ``text`` of (doc_id, text), in ascending doc_id order, into a table of shard files at ``path``.

    Null and empty texts give the end id alone; rows with the same doc_id follow each other in text order; a null
    doc_id comes first. Other columns are not read.
    """

    def encode(batches):
        memo = library_memo(tokenizer_path)
        CACHES["token_blocks"] = library_memo.cache_clear
        from pyspark import TaskContext

        shard, seq = TaskContext.get().partitionId(), 0
        end = np.asarray([end_id], "<u4").tobytes()
        held: list[np.ndarray] = []
        names: list[np.ndarray] = []
        ends: list[np.ndarray] = []
        total = 0

        def close():
            nonlocal held, names, ends, total, seq
            doc_id = np.concatenate(names)
            payload = pack(np.concatenate(held), doc_id, np.concatenate(ends), percentile)
            out = pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "seq": pa.array([seq], pa.int32()), "n_docs": pa.array([len(doc_id)], pa.int64()), "n_ids": pa.array([total], pa.int64()), "payload": pa.array([payload], pa.binary())})
            held, names, ends, total, seq = [], [], [], 0, seq + 1
            return out

        for whole in batches:
            for b in slices(whole, "text", ENCODE_BYTES):
                doc_id = b.column("doc_id").fill_null(NO_ID).to_numpy()
                raw, stop = memo.joined(b.column("text"), end)
                ids, stop = np.frombuffer(raw, "<u4"), stop // 4
                first = row = 0
                while row < len(stop):
                    # up to the text that fills the shard
                    till = min(int(np.searchsorted(stop, first + shard_ids - total)) + 1, len(stop))
                    last = int(stop[till - 1])
                    held.append(ids[first:last])
                    names.append(doc_id[row:till])
                    ends.append(stop[row:till] - first + total)
                    total += last - first
                    first, row = last, till
                    if total >= shard_ids:
                        yield close()
        if names:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.repartitionByRange(n_parts(docs.sparkSession), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    rows.mapInArrow(tidy(encode, "token_blocks"), SHARDS).write.parquet(path)


def read_token_shards(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the shards at ``path``: doc_id, start, n_tokens, ids_crc32, shard, seq."""
    shards = spark.read.schema(SHARDS).parquet(path)
    # one row a shard file, so the running sum over them is small beside the ids
    place = shards.select("shard", "seq", "n_ids").withColumn("base", F.coalesce(F.sum("n_ids").over(Window.orderBy("shard", "seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n_ids")

    def decode(batches):
        for b in batches:
            for shard, seq, payload in zip(b.column("shard").to_pylist(), b.column("seq").to_pylist(), b.column("payload"), strict=True):
                doc_id, doc_end, ids = unpack(memoryview(payload.as_buffer()))
                raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                stop = doc_end.astype(np.int64)
                first = np.concatenate(([0], stop[:-1]))
                crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(first.tolist(), stop.tolist(), strict=True)]
                n = len(doc_id)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc_id, mask=doc_id == NO_ID), "local": pa.array(first), "n_tokens": pa.array(stop - first), "ids_crc32": pa.array(crc, pa.int64()), "shard": pa.array(np.full(n, shard)), "seq": pa.array(np.full(n, seq, np.int32))})

    docs = shards.select("shard", "seq", "payload").mapInArrow(tidy(decode, "token_blocks"), "doc_id long, local long, n_tokens long, ids_crc32 long, shard long, seq int")
    return docs.join(place, ["shard", "seq"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", "shard", "seq")


def op1_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document, read back from the shard files: doc_id, start, n_tokens, ids_crc32, shard, seq."""
    import public_tokenizers

    path = shared_dir(spark)
    write_token_shards(table(spark, sf_dir, "documents", "doc_id", "text"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_shards(spark, path)
