"""Language identification by error-correcting output codes (operator 2).

Every language gets a codeword; one binary classifier a bit, over hashed byte n-grams of the lower-cased text,
predicts it; loss-weighted decoding (logistic loss of each margin against each codeword, bits weighted by their
training accuracy) takes the nearest codeword. A small gap to the next codeword marks the text ambiguous.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import textvec as tv
from spanloom.llm.common import crc_mod, slices, table, tidy

#: Training rows of a language, the longest text (bytes) among them, n-gram orders, hashed features of an order.
TRAIN_ROWS, TRAIN_BYTES, ORDERS, BITS = 600, 65_536, (1, 2, 3), 13
WIDTH = len(ORDERS) << BITS
#: Training texts made dense at a time, and blocks of them that stay so; the rest are held as their non-zero features.
BLOCK, DENSE_BLOCKS = 512, 8
#: Gap between the best two codewords' probabilities under which a text is ambiguous.
AMBIGUOUS = 0.2


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray  # languages x bits, of -1 and 1
    weight: np.ndarray  # WIDTH x bits
    bias: np.ndarray
    bit_weight: np.ndarray
    sharpness: float


def codewords(n: int) -> np.ndarray:
    """Rows of -1 and 1: the exhaustive code up to five languages, else random dense columns with the widest least distance of several draws."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 5:
        cols = [c for c in itertools.product((-1, 1), repeat=n) if c[0] == 1 and -1 in c]
        return np.asarray(cols, np.int8).T
    bits, best, gap = int(np.ceil(10 * np.log2(n))), None, -1
    draw = np.random.RandomState(7)
    for _ in range(200):
        m = draw.choice([-1, 1], (n, bits)).astype(np.int8)
        if (np.abs(m.sum(axis=0)) == n).any():
            continue
        d = (bits - m.astype(int) @ m.T.astype(int))[~np.eye(n, dtype=bool)].min()
        if d > gap:
            best, gap = m, d
    return best


def grams(buf: np.ndarray) -> list[np.ndarray]:
    """Feature numbers of the n-gram that starts at each byte, for each order."""
    low = tv.fold(buf)
    low[tv.WS[low]] = 32
    x, out = tv._BYTE[low].astype(np.uint32), []
    for g, n in enumerate(ORDERS):
        m = len(low) - n + 1
        if m <= 0:
            out.append(np.zeros(0, np.int64))
            continue
        h = np.zeros(m, np.uint32)
        for j in range(n):
            h += x[j : j + m] * np.uint32(2 * j * 0x9E3779B1 + 1 & 0xFFFFFFFF)
        h *= np.uint32(0x85EBCA6B)
        out.append((h >> np.uint32(32 - BITS)).astype(np.int64) + (g << BITS))
    return out


class Features:
    """Mean presence of every feature, a row a text, as blocks of rows (for training).

    A text's non-zero features take some KB, a dense row 96: only DENSE_BLOCKS blocks stay dense, whatever the number
    of languages; the others are made again each time they are read.
    """

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.rows: list[tuple[np.ndarray, np.ndarray]] = []
        for r in range(len(off) - 1):
            at, value = [], []
            for f in grams(buf[off[r] : off[r + 1]]):
                if len(f):
                    u, n = np.unique(f, return_counts=True)
                    at.append(u.astype(np.int32))
                    value.append((n / len(f)).astype(np.float32))
            self.rows.append((np.concatenate(at), np.concatenate(value)) if at else (np.zeros(0, np.int32), np.zeros(0, np.float32)))
        self.mean, self.scale, self.held = np.zeros(WIDTH, np.float32), np.ones(WIDTH, np.float32), {}
        total = sum(x.sum(axis=0, dtype=np.float64) for _, x in self.blocks())
        self.mean = (total / len(self.rows)).astype(np.float32)
        square = sum(np.einsum("ij,ij->j", x, x, dtype=np.float64) for _, x in self.blocks())
        self.scale = (1 / (np.sqrt(square / len(self.rows)) + 1e-3)).astype(np.float32)

    def keep(self) -> None:
        """Hold the first blocks, centred and scaled."""
        self.held = {at.start: x for at, x in itertools.islice(self.blocks(), DENSE_BLOCKS)}

    def blocks(self):
        """(rows, their centred and scaled features) block by block."""
        for a in range(0, len(self.rows), BLOCK):
            at = slice(a, min(a + BLOCK, len(self.rows)))
            if a in self.held:
                yield at, self.held[a]
                continue
            x = np.zeros((at.stop - a, WIDTH), np.float32)
            for r, (i, v) in enumerate(self.rows[at]):
                x[r, i] = v
            x -= self.mean
            x *= self.scale
            yield at, x


def fit(texts: pa.Array, lang: list[str], steps: int = 150) -> Model:
    names = sorted(set(lang))
    code = codewords(len(names))
    if len(names) < 2:
        return Model(names, code, np.zeros((WIDTH, 1), np.float32), np.ones(1, np.float32), np.ones(1), 1.0)
    x = Features(*tv.strings(texts))
    x.keep()
    number = {k: n for n, k in enumerate(names)}
    of = np.asarray([number[k] for k in lang])
    target = code[of].astype(np.float32)
    share = (1 / np.bincount(of)[of]).astype(np.float32)
    share /= share.sum()
    w, b = np.zeros((WIDTH, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    m1, m2 = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        gw, gb = 1e-4 * w, np.zeros_like(b)
        for at, rows in x.blocks():
            margin = rows @ w + b
            g = -target[at] / (1 + np.exp(np.clip(target[at] * margin, -30, 30))) * share[at, None]
            gw += rows.T @ g
            gb += g.sum(axis=0)
        m1 = 0.9 * m1 + 0.1 * gw
        m2 = 0.99 * m2 + 0.01 * gw * gw
        w -= 0.003 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
        b -= 0.5 * gb
    right = sum(((rows @ w + b) * target[at] > 0).sum(axis=0) for at, rows in x.blocks()) / len(lang)
    weight = w * x.scale[:, None]
    return Model(names, code, weight, b - x.mean @ weight, np.maximum(0.05, 2 * right - 1), 3.0 / code.shape[1])


def decode(model: Model, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language number, its probability, gap to the next) by the weighted loss against each codeword."""
    loss = np.zeros((len(margin), len(model.langs)))
    for k in range(len(model.langs)):
        loss[:, k] = np.logaddexp(0, -np.clip(model.code[k] * margin, -50, 50)) @ model.bit_weight
    z = np.exp(-model.sharpness * (loss - loss.min(axis=1, keepdims=True)))
    z /= z.sum(axis=1, keepdims=True)
    best = loss.argmin(axis=1)
    top = np.sort(z, axis=1)
    gap = top[:, -1] - top[:, -2] if z.shape[1] > 1 else top[:, -1]
    return best, z[np.arange(len(z)), best], gap


def margins(model: Model, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Bit margins of each text. The n-grams that reach over a text's end are left out."""
    rows, bits = len(off) - 1, model.weight.shape[1]
    out = np.repeat(model.bias[None, :].astype(np.float64), rows, axis=0)
    for n, f in zip(ORDERS, grams(buf), strict=True):
        size = np.maximum(0, np.diff(off) - n + 1)
        full = np.flatnonzero(size)
        if not len(full):
            continue
        low, high = off[full], off[full] + size[full]
        # texts follow each other: every other segment between these bounds holds the grams over an edge
        cuts = np.minimum(np.stack([low, high], 1).reshape(-1), len(f) - 1)
        for k in range(bits):
            v = np.ascontiguousarray(model.weight[:, k])[f]
            sums = np.add.reduceat(v, cuts, dtype=np.float64)[::2]
            last = (high >= len(f)) & (low == len(f) - 1)  # reduceat of equal cuts gives the element itself, as wanted here
            tail = np.flatnonzero((high >= len(f)) & ~last)
            sums[tail] += v[-1]
            out[full, k] += sums / size[full]
    return out


def predict(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    buf, off = tv.strings(texts)
    best, p, gap = decode(model, margins(model, buf, off))
    letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    lang = [model.langs[k] if ok else "und" for k, ok in zip(best.tolist(), letters.tolist(), strict=True)]
    return lang, np.where(letters, p, 0.0), letters & (gap < AMBIGUOUS) | ~letters


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit on up to ``rows`` labelled texts a language, first by a hash of the id (a bounded sample)."""
    known = docs.where(F.col("lang").isNotNull() & (crc_mod("doc_id", 4) != 2))
    share = {r.lang: min(1.0, 2.0 * rows / r.n) for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not share:
        return Model(["und"], np.ones((1, 1), np.int8), np.zeros((WIDTH, 1), np.float32), np.ones(1, np.float32), np.ones(1), 1.0)
    at = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(1_000_000)) / 1_000_000
    want = F.lit(False)
    for lang, p in share.items():
        want = want | ((F.col("lang") == lang) & (at < p))
    got = known.where(want & (F.octet_length("text") <= TRAIN_BYTES)).select("lang", "doc_id", "text").toPandas().sort_values(["lang", "doc_id", "text"])
    got["h"] = [(i * 2654435761) % 2**32 for i in got.doc_id.fillna(-1).astype("int64")]
    got = got.sort_values(["lang", "h", "doc_id"]).groupby("lang").head(rows)
    return fit(pa.array(got.text, pa.string()), got.lang.tolist())


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Every column of docs with lang_pred, score (0 to 1) and ambiguous.

    A null text or one without a letter gives ``und``, 0 and true. Columns named as the new ones are replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "ambiguous")]

    def run(batches):
        for whole in batches:
            for b in slices(whole, "text"):
                lang, score, unsure = predict(held.value, b.column("text"))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(lang, pa.string()), pa.array(score), pa.array(unsure)], names=[*keep, "lang_pred", "score", "ambiguous"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*keep).mapInArrow(tidy(run), f"{kinds}, lang_pred string, score double, ambiguous boolean")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, ambiguous. A null doc_id is not held out."""
    model = train(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))
    out = identify(table(spark, sf_dir, "documents", "doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")
