"""Toxic spans by a linear-chain conditional random field (operator 3).

Labels are of documents, so the training tokens are labelled first: features (words, prefixes, suffixes) that mark
toxic documents are chosen greedily, each by the toxic documents that none before it explains, and the tokens of
toxic documents that carry one are the labelled toxic tokens. A two-state chain is fitted to those sequences;
forward-backward marginals give the spans, and a logistic curve over a document's marginals its score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm import textvec as tv
from spanloom.llm.common import crc_mod, slices, table, tidy

#: Labelled rows that the model is fitted on, of each class: a bounded sample.
TOXIC_ROWS, CLEAN_ROWS = 700, 1000
#: Bytes of toxic training texts in all (the shortest of the sample, whole), and of the piece that stands for a clean one.
TOXIC_BYTES, PIECE = 12 << 20, 8192
#: Marginals under which a token is no evidence, and the greatest log odds of a document without evidence.
EVIDENCE, PRIOR = 0.1, -0.4
GROUPS, BITS = 7, 18
WIDTH = 1 << BITS
#: A feature marks toxicity if this many times likelier in toxic documents and seen in so many of them that no earlier feature explains.
ODDS, SUPPORT = 30.0, 4
SPANS = "array<struct<start:int,end:int,p:double>>"


def features(buf: np.ndarray, off: np.ndarray) -> tuple[tv.Words, np.ndarray]:
    """Words of the texts and their feature numbers, one column a group; GROUPS * WIDTH is no feature."""
    low = tv.fold(buf)
    w = tv.words(low, off, hashes=False)
    out = np.full((len(w.start), GROUPS), GROUPS * WIDTH, np.int32)
    if not len(w.start):
        return w, out
    start, end = tv.strip_marks(low, w.start, w.end)
    size, shift = end - start, tv.U64(64 - BITS)
    out[:, 0] = tv.hash_spans(low, start, end) >> shift
    for g, (n, back) in enumerate(((3, False), (4, False), (5, False), (6, False), (3, True), (5, True)), 1):
        own = np.flatnonzero(size >= n)
        first = end[own] - n if back else start[own]
        h = np.zeros(len(own), tv.U64)
        for j in range(n):
            h += tv._BYTE[low[first + j]] * tv.powers(n)[j]
        out[own, g] = g * WIDTH + (tv.mix(h) >> shift).astype(np.int64)
    return w, out


@dataclass
class Model:
    weight: np.ndarray  # GROUPS * WIDTH + 1, the last for no feature
    bias: float
    trans: np.ndarray  # 2 x 2, log scale
    curve: np.ndarray  # of bias, max marginal, log1p of their sum


def chain(score: np.ndarray, first: np.ndarray, trans: np.ndarray, width: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of state 1 over many chains laid end to end; also forward and backward ratios.

    ``first`` marks where a chain begins. The chains are cut into rows of ``width`` steps that advance together;
    a row's composed map (a Moebius transform of the ratio of states) gives the next row's start.
    """
    n = len(score)
    if not n:
        return score, score, score
    rows = -(-n // width)
    e = np.ones(rows * width)
    e[:n] = np.exp(np.clip(score, -30, 30))
    new = np.ones(rows * width, bool)
    new[:n] = first
    e, new = np.ascontiguousarray(e.reshape(rows, width).T), np.ascontiguousarray(new.reshape(rows, width).T)
    (t00, t01), (t10, t11) = np.exp(trans)
    # forward: r' = (a r + b) / (c r + d)
    a, b = np.where(new, 0.0, e * t11), np.where(new, e, e * t01)
    c, d = np.where(new, 0.0, t10), np.where(new, 1.0, t00)

    def compose(a, b, c, d, steps):
        pa_, pb, pc_, pd = np.ones(rows), np.zeros(rows), np.zeros(rows), np.ones(rows)
        for t in steps:
            at, bt, ct, dt = a[t], b[t], c[t], d[t]
            pa_, pb, pc_, pd = at * pa_ + bt * pc_, at * pb + bt * pd, ct * pa_ + dt * pc_, ct * pb + dt * pd
            scale = 1.0 / np.maximum(np.maximum(pa_, pb), np.maximum(pc_, pd))
            pa_, pb, pc_, pd = pa_ * scale, pb * scale, pc_ * scale, pd * scale
        return pa_.tolist(), pb.tolist(), pc_.tolist(), pd.tolist()

    fa, fb, fc, fd = compose(a, b, c, d, range(width))
    r, start = 1.0, np.empty(rows)
    for k in range(rows):
        start[k] = r
        r = (fa[k] * r + fb[k]) / (fc[k] * r + fd[k])
    fwd = np.empty_like(e)
    r = start
    for t in range(width):
        r = (a[t] * r + b[t]) / (c[t] * r + d[t])
        fwd[t] = r
    # backward over step t: q before it from q after it
    a, b = np.where(new, 0.0, e * t11), np.where(new, 1.0, t10)
    c, d = np.where(new, 0.0, e * t01), np.where(new, 1.0, t00)
    ba, bb, bc, bd = compose(a, b, c, d, range(width - 1, -1, -1))
    q, last = 1.0, np.empty(rows)
    for k in range(rows - 1, -1, -1):
        last[k] = q
        q = (ba[k] * q + bb[k]) / (bc[k] * q + bd[k])
    bwd = np.empty_like(e)
    q = last
    for t in range(width - 1, -1, -1):
        bwd[t] = q
        q = (a[t] * q + b[t]) / (c[t] * q + d[t])
    fwd, bwd = fwd.T.reshape(-1)[:n], bwd.T.reshape(-1)[:n]
    odds = fwd * bwd
    return odds / (1 + odds), fwd, bwd


def label_tokens(feat: np.ndarray, bounds: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Which tokens carry a feature that marks toxicity, for toxic documents."""
    size, none = GROUPS * WIDTH + 1, GROUPS * WIDTH
    docs = np.repeat(np.arange(len(toxic)), np.diff(bounds))
    pairs = (docs[:, None].astype(np.int64) * size + feat).reshape(-1)
    pairs.sort()
    pairs = pairs[np.concatenate(([True], pairs[1:] != pairs[:-1]))]
    doc, f = (pairs // size).astype(np.int32), (pairs % size).astype(np.int32)
    del pairs
    keep = f != none
    doc, f = doc[keep], f[keep]
    clean = np.bincount(f[~toxic[doc]], minlength=size)
    own, of = doc[toxic[doc]], f[toxic[doc]]
    left = np.bincount(of, minlength=size)
    n1, n0 = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    odds = ((left + 0.5) / n1) / ((clean + 0.5) / n0)
    able = (odds >= ODDS) & (left >= SUPPORT)
    keep = able[of]
    own, of = own[keep], of[keep]
    order = np.argsort(of, kind="stable")
    by_f, docs_of = of[order], own[order]
    at = np.searchsorted(own, np.arange(len(toxic) + 1))  # pairs are sorted by document
    count = np.where(able, left, 0).astype(np.int64)
    open_doc, chosen = toxic.copy(), np.zeros(size, bool)
    # every toxic document that holds features is explained once, so this ends after as many rounds at most
    while count.max(initial=0) >= SUPPORT:
        best = int((count - 1e-6 * np.arange(size) / size + 1e-3 * np.minimum(odds, 900)).argmax()) if count.max() else 0
        if count[best] < SUPPORT:
            break
        chosen[best] = True
        for k in docs_of[np.searchsorted(by_f, best) : np.searchsorted(by_f, best, "right")]:
            if open_doc[k]:
                open_doc[k] = False
                count[of[at[k] : at[k + 1]]] -= 1
    return chosen[feat].any(axis=1) & toxic[docs]


def fit(texts: pa.Array, toxic: np.ndarray, epochs: int = 12, rate: float = 0.5) -> Model:
    """Fit the chain to labelled documents (ties to none: a model without evidence scores every token low)."""
    buf, off = tv.strings(texts)
    w, feat = features(buf, off)
    model = Model(np.zeros(GROUPS * WIDTH + 1, np.float32), -4.0, np.zeros((2, 2)), np.asarray([-3.0, 4.0, 2.0]))
    if not len(feat) or not toxic.any():
        return model
    y = label_tokens(feat, w.bounds, toxic)
    if not y.any():
        return model  # nothing tells the classes apart: no document is called toxic
    first = np.zeros(len(feat), bool)
    first[w.bounds[:-1][np.diff(w.bounds) > 0]] = True
    # only features of toxic tokens, and those that share a token with them, can move away from zero usefully
    useful = np.zeros(len(model.weight), bool)
    useful[feat[y].reshape(-1)] = True
    useful[-1] = False
    names = np.flatnonzero(useful)
    number = np.full(len(model.weight), len(names), np.int32)
    number[names] = np.arange(len(names))
    cols = number[feat]
    weight, grad2 = np.zeros(len(names) + 1), np.full(len(names) + 1, 1e-2)
    bias, b2, trans, t2 = -4.0, 1e-2, np.asarray([[0.5, -0.5], [-0.5, 0.5]]), np.full((2, 2), 1e-2)
    inner = ~first
    before = np.flatnonzero(inner) - 1
    for _ in range(epochs):
        score = weight[cols].sum(axis=1) + bias
        p, fwd, bwd = chain(score, first, trans)
        diff = p - y
        g = np.bincount(cols.reshape(-1), np.repeat(diff, GROUPS), minlength=len(weight)) + 1e-2 * weight
        g[-1] = 0
        grad2 += g * g
        weight -= rate * g / np.sqrt(grad2) * 2
        gb = diff.sum()
        b2 += gb * gb
        bias -= rate * gb / np.sqrt(b2)
        # transitions: expected less seen pairs
        t = np.exp(trans)
        e, q, r = np.exp(np.clip(score[inner], -30, 30)), bwd[inner], fwd[before]
        m = np.stack([t[0, 0] * np.ones_like(e), t[0, 1] * e * q, t[1, 0] * r, t[1, 1] * r * e * q])
        m /= m.sum(axis=0)
        seen = np.bincount(2 * y[before].astype(int) + y[inner], minlength=4)
        gt = (m.sum(axis=1) - seen).reshape(2, 2) + 0.1 * trans
        t2 += gt * gt
        trans = trans - 0.3 * rate * gt / np.sqrt(t2)
    model.weight[names], model.bias, model.trans = weight[:-1], float(bias), trans
    x = document_features(chain(weight[cols].sum(axis=1) + bias, first, trans)[0], w.bounds)
    model.curve = logistic(x, toxic.astype(float))
    model.curve[0] = min(model.curve[0], PRIOR - model.curve[1] * EVIDENCE)
    return model


def document_features(p: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """1, the greatest marginal and the logarithm of their sum, of tokens that are evidence: none of a long clean text adds up."""
    p = np.where(p >= EVIDENCE, p, 0.0)
    out = np.zeros((len(bounds) - 1, 3))
    out[:, 0] = 1
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        out[full, 1] = np.maximum.reduceat(p, bounds[full])
        out[full, 2] = np.log1p(np.add.reduceat(p, bounds[full]))
    return out


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the classes weigh alike."""
    c = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-6, *[1e-1] * (x.shape[1] - 1)])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (c * p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w))
        w -= np.linalg.solve(h, x.T @ (c * (p - y)) + ridge @ w)
    w[1:] = np.maximum(w[1:], 0)  # more evidence never lowers the score
    return w


def score_texts(model: Model, texts: pa.Array, spans: bool = True) -> tuple[np.ndarray, list[list[dict]]]:
    buf, off = tv.strings(texts)
    w, feat = features(buf, off)
    first = np.zeros(len(feat), bool)
    first[w.bounds[:-1][np.diff(w.bounds) > 0]] = True
    s = np.full(len(feat), model.bias)
    for g in range(GROUPS):
        s += model.weight[feat[:, g]]
    p = chain(s, first, model.trans)[0]
    score = 1 / (1 + np.exp(-np.clip(document_features(p, w.bounds) @ model.curve, -30, 30)))
    found: list[list[dict]] = [[] for _ in range(len(off) - 1)]
    for i in np.flatnonzero(p >= 0.5).tolist() if spans else ():
        r = int(w.row[i])
        text = buf[off[r] : off[r + 1]]
        a, z = int(w.start[i] - off[r]), int(w.end[i] - off[r])
        lead = int(((text[:a] & 0xC0) != 0x80).sum())
        found[r].append({"start": lead, "end": lead + int(((text[a:z] & 0xC0) != 0x80).sum()), "p": float(p[i])})
    return score, found


def training_rows(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> DataFrame:
    """Up to so many labelled rows of each class, first by a hash of the id: (text, toxic). A bounded sample."""
    seen = labels.where(F.col("toxic").isNotNull() & (crc_mod("doc_id", 5) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id", F.lit(3))
    sample = seen.where("toxic = 1").orderBy(order, "doc_id").limit(toxic_rows).unionByName(seen.where("toxic = 0").orderBy(order, "doc_id").limit(clean_rows))
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "toxic")


def piece(text: str, own: int) -> str:
    """One stretch of at most ``PIECE`` bytes or so of a clean text, between white space; ``own`` decides which."""
    out, held, size = [], [], 0
    for word in text.split():
        size += len(word.encode()) + 1
        held.append(word)
        if size >= PIECE:
            out.append(held)
            held, size = [], 0
    out = [*out, held] if held or not out else out
    return " ".join(out[own % len(out)])


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on a bounded sample of the labelled rows that aren't held out; several labels of a doc_id count as the greatest.

    Rows without text, and documents without a label, take no part. Without a toxic row, or where nothing tells toxic
    rows from clean ones, the model has no weights and calls no document toxic.
    """

    def cut(batches):
        for b in batches:
            some = [piece(t, own) if not label else t for t, own, label in zip(*(b.column(c).to_pylist() for c in ("text", "own", "toxic")), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), b.column("toxic")], names=["text", "toxic"])

    rows = training_rows(docs, labels).select(F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic"), F.crc32(F.coalesce("text", F.lit(""))).alias("own"))
    size = F.octet_length("text")
    # of the sample alone, which the numbers of rows bound
    total = F.sum(size).over(Window.partitionBy("toxic").orderBy(size, "own").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("total", F.when(F.col("toxic") == 1, total).otherwise(0)).where(F.col("total") <= TOXIC_BYTES)
    rows = rows.mapInArrow(tidy(cut), "text string, toxic int").toArrow().combine_chunks()
    rows = rows.take(pc.sort_indices(rows, [("text", "ascending"), ("toxic", "ascending")]))  # float sums in a fixed order
    return fit(rows.column("text"), rows.column("toxic").to_numpy().astype(bool) if rows.num_rows else np.zeros(0, bool))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """Every column of docs with score (0 to 1), predicted (0 or 1) and spans (code-point offsets, end exclusive).

    ``text`` may be null or empty: no evidence, no span, a score under 0.5. Long texts are read whole; repeated rows
    score alike; an empty table gives an empty one. Columns named as the new ones are replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c not in ("score", "predicted", "spans")]

    def run(batches):
        m = held.value
        for whole in batches:
            for b in slices(whole, "text"):
                score, spans = score_texts(m, b.column("text"))
                cols = [b.column(c) for c in keep] + [pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])))]
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, "score", "predicted", "spans"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*keep).mapInArrow(tidy(run), f"{kinds}, score double, predicted int, spans {SPANS}")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs scored under 0.5, all columns kept."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for whole in batches:
            for b in slices(whole, "text"):
                yield b.filter(pa.array(score_texts(held.value, b.column("text"), spans=False)[0] < 0.5))

    return docs.mapInArrow(tidy(run), docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, n_spans, spans (code-point offsets of the toxic tokens).

    A null doc_id is not held out.
    """
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    scored = score_documents(docs, train(docs, table(spark, sf_dir, "labels", "doc_id", "toxic")))
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted", F.size("spans").alias("n_spans"), "spans")
