"""BPE encoding and decoding with a minimal acyclic transducer lexicon (operator 10).

The corpus' most frequent words, counted over every text, are compiled on the driver into a minimal acyclic
automaton with shared suffixes whose arcs carry word counts, so that a walk numbers the word and the number finds
its ids. Executors memory-map it. Words it lacks are merged exactly by rank.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import tempfile
import unicodedata
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.chunks import MARKS, MEMO_ENTRIES, ChunkMemo, plain_word, split
from spanloom.llm.common import CACHES, materialise, most_frequent, slices, table, tidy

#: Words of the compiled lexicon; with their ids some 3 MB, whatever the corpus.
LEXICON_WORDS = 100_000
#: Distinct words a counting task holds before it sends them on.
COUNTER_ENTRIES = 400_000
NONE = np.iinfo(np.int32).max


class Vocabulary:
    """Ids, merges and byte alphabet of a word-end BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = dict(model["vocab"])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.suffix = model["end_of_word_suffix"] or ""
        self.strings = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.added.items()}
        self.alphabet = byte_alphabet()
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        left, right, made = [], [], []
        for m in model["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            left.append(self.ids[a])
            right.append(self.ids[b])
            made.append(self.ids[a + b])
        self.size = max(self.strings) + 1
        key = np.asarray(left, np.int64) * self.size + np.asarray(right, np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.made = key[order], order.astype(np.int32), np.asarray(made, np.int32)[order]
        self.pairs = {(a, b): (r, m) for r, (a, b, m) in enumerate(zip(left, right, made, strict=True))}
        self.byte_id = np.asarray([self.ids[c] for c in self.alphabet], np.int32)
        self.last_id = np.asarray([self.ids[c + self.suffix] for c in self.alphabet], np.int32)

    def look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged id) of pairs; NONE where they don't merge."""
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        hit = (self.key[at] == key) & (a >= 0) & (b >= 0)
        return np.where(hit, self.rank[at], NONE), self.made[at]

    def merge_long(self, raw: bytes) -> list[int]:
        """Ids of one word of any length: a queue of merges over a linked list."""
        sym = [int(self.byte_id[x]) for x in raw[:-1]] + [int(self.last_id[raw[-1]])]
        n = len(sym)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        queue = [(p[0], i, p[1], sym[i], sym[i + 1]) for i in range(n - 1) if (p := self.pairs.get((sym[i], sym[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, made, a, b = heapq.heappop(queue)
            j = after[i]
            if not alive[i] or j >= n or sym[i] != a or sym[j] != b:
                continue
            sym[i], alive[j], after[i] = made, False, after[j]
            if after[i] < n:
                before[after[i]] = i
                if p := self.pairs.get((made, sym[after[i]])):
                    heapq.heappush(queue, (p[0], i, p[1], made, sym[after[i]]))
            if (h := before[i]) >= 0 and (p := self.pairs.get((sym[h], made))):
                heapq.heappush(queue, (p[0], h, p[1], sym[h], made))
        return [s for s, x in zip(sym, alive, strict=True) if x]

    def merge(self, raws: list[bytes]) -> list[np.ndarray]:
        """Ids of words (UTF-8): short ones together, one merge of each in a step."""
        out: list = [None] * len(raws)
        size = np.fromiter(map(len, raws), np.int64, len(raws))
        for low, high in ((1, 8), (9, 12), (13, 16), (17, 24), (25, 40)):
            own = np.flatnonzero((size >= low) & (size <= high))
            if not len(own):
                continue
            n, text = size[own], b"".join(raws[i] for i in own)
            cols = np.arange(high)
            inside = cols < n[:, None]
            buf = np.zeros(inside.shape, np.uint8)
            buf[inside] = np.frombuffer(text, np.uint8)
            sym = np.where(inside, self.byte_id[buf], -1)
            rows = np.arange(len(own))
            sym[rows, n - 1] = self.last_id[buf[rows, n - 1]]
            rank, made = self.look(sym[:, :-1], sym[:, 1:])
            todo = rows
            while len(todo):
                s, r, m = sym[todo], rank[todo], made[todo]
                at = r.argmin(axis=1)
                here = np.arange(len(todo))
                go = r[here, at] < NONE
                if not go.all():
                    todo, s, r, m, at = todo[go], s[go], r[go], m[go], at[go]
                    here = here[: len(todo)]
                    if not len(todo):
                        break
                s[here, at] = m[here, at]
                # what stands right of the merged pair moves left by one
                move = cols[:-1] > at[:, None]
                s[:, :-1] = np.where(move, s[:, 1:], s[:, :-1])
                s[:, -1] = -1
                move = cols[:-2] > at[:, None]
                r[:, :-1] = np.where(move, r[:, 1:], r[:, :-1])
                m[:, :-1] = np.where(move, m[:, 1:], m[:, :-1])
                r[:, -1] = NONE
                right = np.minimum(at, high - 2)
                r[here, right], m[here, right] = self.look(s[here, right], s[here, right + 1])
                left = np.maximum(at - 1, 0)
                some = np.flatnonzero(at > 0)
                r[some, left[some]], m[some, left[some]] = self.look(s[some, left[some]], s[some, at[some]])
                sym[todo], rank[todo], made[todo] = s, r, m
            stop = (sym >= 0).sum(axis=1).tolist()
            for i, k, x in zip(own.tolist(), stop, sym.astype(np.uint32), strict=True):
                out[i] = x[:k]
        for i in np.flatnonzero(size > 40).tolist():
            out[i] = np.asarray(self.merge_long(raws[i]), np.uint32)
        return out

    def pre_tokens(self, text: str) -> list[str]:
        """Normalised pre-tokens of a text without special tokens."""
        text = regex.sub(r"[\t-\r\x20\x85\xa0  -     　]+", " ", unicodedata.normalize("NFC", text))
        return self.pattern.findall("".join(c.lower() for c in text))


def byte_alphabet() -> list[str]:
    """The character standing for each byte: printable bytes stand for themselves, the rest follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(rest)) for b in range(256)]


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


# --- lexicon -------------------------------------------------------------------------------------------------


def compile_lexicon(words: list[str], vocab: Vocabulary) -> bytes:
    """A minimal acyclic automaton of words: sorted arc keys (state * 256 + byte), targets, skipped counts, finality, ids."""
    raws = sorted({w.encode() for w in words if w})
    arcs: list[dict[int, int]] = [{}]
    final = [False]
    known: dict[tuple, int] = {}
    path: list[int] = [0]
    free: list[int] = []

    def settle(depth: int, raw: bytes) -> None:
        while len(path) - 1 > depth:
            state = path.pop()
            sign = (final[state], tuple(arcs[state].items()))
            same = known.setdefault(sign, state)
            if same != state:
                arcs[path[-1]][raw[len(path) - 1]] = same
                arcs[state] = {}
                free.append(state)

    last = b""
    for raw in raws:
        shared = len(os.path.commonprefix((last, raw)))
        settle(shared, last)
        for x in raw[shared:]:
            if free:
                state = free.pop()
                final[state] = False
            else:
                state = len(arcs)
                arcs.append({})
                final.append(False)
            arcs[path[-1]][x] = state
            path.append(state)
        final[path[-1]] = True
        last = raw
    settle(0, last)

    below: dict[int, int] = {}
    stack = [0]
    while stack:
        state = stack[-1]
        missing = [t for t in arcs[state].values() if t not in below]
        if missing:
            stack += missing
        else:
            below[state] = final[state] + sum(below[t] for t in arcs[state].values())
            stack.pop()
    number = {s: i for i, s in enumerate(sorted(below))}
    key, target, skip = [], [], []
    for state in sorted(below):
        passed = int(final[state])
        for x, t in sorted(arcs[state].items()):
            key.append(number[state] * 256 + x)
            target.append(number[t])
            skip.append(passed)
            passed += below[t]
    ids = vocab.merge(raws)
    start = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype("<u4") if ids else np.zeros(1, "<u4")
    parts = [np.asarray(key, "<u8"), np.asarray(target, "<u4"), np.asarray(skip, "<u4"), np.asarray([final[s] for s in sorted(below)], "u1"), start, np.concatenate(ids).astype("<u2" if vocab.size <= 65536 else "<u4") if ids else np.zeros(0, "<u2")]
    head = np.asarray([len(p) for p in parts] + [parts[-1].itemsize, 0], "<u8")
    return head.tobytes() + b"".join(p.tobytes() + b"\0" * (-p.nbytes % 8) for p in parts)


class Lexicon:
    """A compiled lexicon in memory-mapped bytes."""

    def __init__(self, data):
        head = np.frombuffer(data, "<u8", 8)
        at, self.parts = 64, []
        for n, kind in zip(head[:6].tolist(), ("<u8", "<u4", "<u4", "u1", "<u4", f"<u{head[6]}"), strict=True):
            p = np.frombuffer(data, kind, n, at)
            self.parts.append(p)
            at += p.nbytes + -p.nbytes % 8
        self.key, self.target, self.skip, self.final, self.start, self.ids = self.parts

    @classmethod
    def mapped(cls, data: bytes) -> Lexicon:
        with tempfile.TemporaryFile() as f:  # the name is gone at once; the mapping keeps the pages
            f.write(data)
            f.flush()
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def find(self, raws: list[bytes]) -> np.ndarray:
        """Number of each word, -1 if it isn't there: all words take a step at a time."""
        n = len(raws)
        number, state = np.zeros(n, np.int64), np.zeros(n, np.int64)
        if not n or not len(self.key):
            return np.full(n, -1)
        size = np.fromiter(map(len, raws), np.int64, n)
        first = np.concatenate(([0], np.cumsum(size)[:-1]))
        text = np.frombuffer(b"".join(raws), np.uint8)
        go = np.arange(n)
        for step in range(int(size.max())):
            on = size[go] > step
            go = go[on]
            if not len(go):
                break
            key = (state[go] * 256 + text[first[go] + step]).astype(np.uint64)
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            hit = self.key[at] == key
            number[go[~hit]] = -1
            state[go[~hit]] = -1
            go, at = go[hit], at[hit]
            number[go] += self.skip[at]
            state[go] = self.target[at]
        bad = (state < 0) | (size == 0)
        bad[~bad] = self.final[state[~bad]] == 0
        number[bad] = -1
        return number

    def ids_of(self, number: int) -> np.ndarray:
        return self.ids[self.start[number] : self.start[number + 1]].astype(np.uint32)


class Codec:
    """Encoder and decoder of whole texts; values of chunks are (ids as little-endian u32 bytes, decoded text)."""

    def __init__(self, path: str, lexicon: Lexicon | None):
        self.vocab, self.lexicon = vocabulary(path), lexicon
        self.text_of = np.empty(self.vocab.size, object)
        for i, s in self.vocab.strings.items():
            self.text_of[i] = s
        self.memo = ChunkMemo(self.words, self.others, lambda a, b: (a[0] + b[0], f"{a[1]} {b[1]}"), MEMO_ENTRIES // 5)

    def word_ids(self, words: list[str]) -> list[np.ndarray]:
        raws = [w.encode() for w in words]
        if self.lexicon is None:
            return self.vocab.merge(raws)
        number = self.lexicon.find(raws)
        out = [self.lexicon.ids_of(k) if k >= 0 else None for k in number.tolist()]
        lost = np.flatnonzero(number < 0).tolist()
        for i, ids in zip(lost, self.vocab.merge([raws[i] for i in lost]), strict=True):
            out[i] = ids
        return out

    def value(self, ids: np.ndarray) -> tuple[bytes, str]:
        return ids.astype("<u4").tobytes(), " ".join(self.text_of[ids])

    def words(self, words: list[str]) -> list[tuple[bytes, str]]:
        return [self.value(x) for x in self.word_ids(words)]

    def others(self, chunks: list[str]) -> list[tuple[bytes, str]]:
        """Values of chunks of any kind; the pre-tokens of all are looked up together."""
        cut: list[list] = []
        for chunk in chunks:
            row: list = []
            for s in self.vocab.special.split(chunk) if self.vocab.special else [chunk]:
                if s in self.vocab.added:
                    row.append(self.vocab.added[s])
                elif s:
                    row += self.vocab.pre_tokens(s)
            cut.append(row)
        words = list({w for row in cut for w in row if isinstance(w, str)})
        ids = dict(zip(words, self.word_ids(words), strict=True)) | {i: np.asarray([i], np.uint32) for i in self.vocab.added.values()}
        return [self.value(np.concatenate([ids[w] for w in row]) if row else np.zeros(0, np.uint32)) for row in cut]

    def encode(self, texts) -> list[tuple[bytes, str]]:
        """Per text its ids as bytes, and their decoding."""
        return [(b"".join([v[0] for v in vs]), " ".join([v[1] for v in vs if v[1]])) for vs in self.memo.values_of(texts)]

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(self.text_of[ids])


_CODECS: dict[tuple, Codec] = {}


def codec(path: str, lexicon: Broadcast | None) -> Codec:
    """This worker's codec for a broadcast lexicon."""
    data = lexicon.value if lexicon is not None else None
    key = (path, hashlib.md5(data).digest() if data else None)
    if key not in _CODECS:
        _CODECS.clear()
        CACHES["bpe"] = _CODECS.clear
        _CODECS[key] = Codec(path, Lexicon.mapped(data) if data else None)
    return _CODECS[key]


# --- DataFrames ----------------------------------------------------------------------------------------------


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over every text: lower-cased runs of letters that stand between white space or before marks."""

    def count(batches):
        held: Counter = Counter()

        def out():
            return pa.RecordBatch.from_pydict({"word": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})

        for whole in batches:
            for b in slices(whole, text):
                chunks: Counter = Counter()
                for t in b.column(text).to_pylist():
                    chunks.update(split(t))
                for chunk, n in chunks.items():
                    core = chunk.rstrip(MARKS)
                    if core and plain_word(core):
                        held[core.lower()] += n
                if len(held) > COUNTER_ENTRIES:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return docs.select(text).mapInArrow(tidy(count, "bpe"), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, path: str, words: int = LEXICON_WORDS, text: str = "text") -> Broadcast:
    """Broadcast the compiled lexicon of the at most ``words`` most frequent words."""
    top = most_frequent(materialise(count_words(docs, text).where("n > 1")), "n", words).collect()
    return docs.sparkSession.sparkContext.broadcast(compile_lexicon([r.word for r in top], vocabulary(path)))


def encode_documents(docs: DataFrame, path: str, lexicon: Broadcast | None, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids as an int array) of (doc_id, text); a null text is empty."""

    def encode(batches):
        c = codec(path, lexicon)
        for whole in batches:
            for b in slices(whole, "text"):
                made = c.encode(b.column("text").to_pylist())
                cols = {
                    "doc_id": b.column("doc_id"),
                    "n_tokens": pa.array([len(i) // 4 for i, _ in made], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(i).hexdigest() for i, _ in made], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(d.encode()).hexdigest() for _, d in made], pa.string()),
                }
                if keep_ids:
                    ends = np.cumsum([0] + [len(i) // 4 for i, _ in made]).astype(np.int32)
                    cols["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(i for i, _ in made), "<i4")))
                yield pa.RecordBatch.from_pydict(cols)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(encode, "bpe"), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256; a null text encodes to nothing."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return encode_documents(docs, path, build_lexicon(docs, path))
