"""Joins and deduplication against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from spanloom.llm import jaccard_join as jj
from spanloom.llm import line_dedup as ld
from spanloom.llm import suffix_dedup as sd


def shingles(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_classes(rows):
    sets = [shingles(t) for _, t in rows]
    links, up = [0] * len(rows), list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                up[root(i)] = root(j)
    least = defaultdict(lambda: 10**9)
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least[root(i)], d)
    return sorted((d, least[root(i)] if sets[i] else d, links[i]) for i, (d, _) in enumerate(rows))


def test_jaccard_join(docs, docs_rows, no_docs, monkeypatch):
    want = brute_classes(docs_rows)
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in jj.jaccard_join(docs).collect())
    assert got == want
    assert jj.jaccard_join(no_docs).count() == 0


def test_jaccard_join_splits(docs, docs_rows, monkeypatch):
    """Small limits: buckets split at every level and are compared in blocks."""
    monkeypatch.setattr(jj, "SMALL", 2)
    monkeypatch.setattr(jj, "BLOCK", 4)
    # the limits are read on the driver and in closures of its module; local mode shares them through the pickled globals
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in jj.jaccard_join(docs).collect())
    assert got == brute_classes(docs_rows)


def test_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (None, None)], "doc_id long, text string")
    got = {(r.doc_id, r.class_id) for r in jj.jaccard_join(df).collect()}
    assert got == {(None, 5), (5, 5), (None, None)}


def brute_lines(rows):
    lines = []
    for d, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            lines.append((d, k, frozenset(line.lower().split())))
    lines = sorted(set(lines), key=lambda x: x[:2])
    gone = set()
    for i, (d, k, s) in enumerate(lines):
        if s and any(len(s & o) >= 0.8 * len(s | o) - 1e-9 for _, _, o in lines[:i]):
            gone.add((d, k))
    return gone


def test_line_dedup(docs, docs_rows, no_docs):
    _, removed = ld.repeated_lines(docs)
    assert {(r.doc_id, r.line % 2**31) for r in removed.collect()} == brute_lines(docs_rows)
    assert ld.repeated_lines(no_docs)[1].count() == 0


def test_line_dedup_first_tries(docs, docs_rows, monkeypatch):
    monkeypatch.setattr(ld, "FIRST_TRIES", 1)
    monkeypatch.setattr(ld, "BESIDE", 2)
    monkeypatch.setattr(ld, "RANKED_WORDS", 20)
    _, removed = ld.repeated_lines(docs)
    assert {(r.doc_id, r.line % 2**31) for r in removed.collect()} == brute_lines(docs_rows)


def test_line_dedup_blocks(docs, docs_rows, monkeypatch):
    """A word's postings fill several blocks, and tasks settle what they hold early."""
    monkeypatch.setattr(ld, "FIRST_TRIES", 1)
    monkeypatch.setattr(ld, "BESIDE", 0)
    monkeypatch.setattr(ld, "RANKED_WORDS", 0)
    monkeypatch.setattr(ld, "GROUP", 3)
    monkeypatch.setattr(ld, "HELD", 20)
    monkeypatch.setattr(ld, "PAIRS", 5)
    _, removed = ld.repeated_lines(docs)
    assert {(r.doc_id, r.line % 2**31) for r in removed.collect()} == brute_lines(docs_rows)


def test_line_dedup_hot_word(spark):
    """Hundreds of lines that share one word of their prefixes, few of them alike."""
    import random

    r = random.Random(11)
    rows = []
    for k in range(300):
        other = [f"w{r.randrange(40)}" for _ in range(7)]
        rows.append((k, "\n".join(["the " + " ".join(other), "the " + " ".join(f"v{r.randrange(9)}" for _ in range(3))])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    _, removed = ld.repeated_lines(df)
    assert {(x.doc_id, x.line % 2**31) for x in removed.collect()} == brute_lines(rows)


def test_line_dedup_repeated_ids(spark):
    """Rows of one doc_id with other texts keep their lines apart; null ids lose nothing."""
    rows = [(1, "alpha beta gamma delta eps"), (5, "one two three four five"), (5, "alpha beta gamma delta eps"), (5, "one two three four five"), (None, "one two three four five"), (None, None), (7, None), (8, "x\n\none two three four five\n")]
    df = spark.createDataFrame([(d, t, d, "z") for d, t in rows], "doc_id long, text string, gone long, base string").repartition(3)
    left = ld.remove_repeated_lines(df, drop_emptied=False)
    assert left.columns == df.columns
    got = Counter((r.doc_id, r.text) for r in left.collect())
    assert got == Counter({(1, rows[0][1]): 1, (5, rows[1][1]): 2, (5, ""): 1, (None, rows[1][1]): 1, (None, None): 1, (7, None): 1, (8, "x\n\n"): 1})


def test_remove_repeated_lines(docs, docs_rows):
    gone = brute_lines(docs_rows)
    want = Counter()
    for d, t in docs_rows:
        if t is None:
            want[d, None] += 1
            continue
        kept = "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone)
        if kept.split() or not any((d, k) in gone for k in range(t.count("\n") + 1)):
            want[d, kept] += 1
    out = ld.remove_repeated_lines(docs)
    assert out.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in out.collect()) == want


def brute_repeats(rows, length=400):
    raw = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[i : i + length] for _, b in raw for i in range(len(b) - length + 1))
    out = []
    for d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_suffix_dedup(docs, docs_rows, no_docs):
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.remove_repeats(docs).collect())
    assert got == brute_repeats(docs_rows)
    assert sd.remove_repeats(no_docs).count() == 0


def test_suffix_dedup_hot(docs, docs_rows, monkeypatch):
    monkeypatch.setattr(sd, "HOT_CONTEXTS", 2)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.remove_repeats(docs).collect())
    assert got == brute_repeats(docs_rows)


def test_suffix_dedup_repeated_ids(spark):
    """Null and repeated doc_ids with equal and other texts, one of them under the length of the others."""
    a, b, c = "A" * 650 + "tail", "q" * 100 + "A" * 501, "".join(chr(97 + k * k % 23) for k in range(900))
    rows = [(1, a), (1, b), (2, a), (None, c), (None, "x" + c), (None, None), (3, c[:399]), (4, ""), (2, a), (1, c[100:620])]
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert got == brute_repeats([(-1 if d is None else d, t) for d, t in rows])


def test_common_prefixes():
    import numpy as np

    r = np.random.RandomState(5)
    for n in (40, 200):
        text = np.concatenate([r.randint(0, 2, n), [256], r.randint(0, 2, n // 2), [256]])
        text = np.concatenate([text, text[3 : n - 2], [256]])
        sa = sd.suffix_array(text)
        for length in (16, 24):
            own = sa[sa + length <= len(text)]
            own = own[[256 not in text[i : i + length] for i in own]]
            want = [text[i : i + length].tolist() == text[j : j + length].tolist() for i, j in zip(own[:-1], own[1:], strict=True)]
            assert sd.common_prefixes(text, own, length).tolist() == want and any(want)


def test_suffix_array():
    import numpy as np

    r = np.random.RandomState(0)
    for n in range(80):
        for a in (1, 2, 4, 26):
            t = r.randint(0, a, n)
            assert sd.suffix_array(t).tolist() == sorted(range(n), key=lambda i: t[i:].tolist())


def test_one_of_each(docs, docs_rows, no_docs):
    want = sorted(d for d, c, _ in brute_classes(docs_rows) if d == c)
    out = jj.one_of_each(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == want
    assert jj.one_of_each(no_docs).count() == 0


def test_lines_wanted():
    rng = random.Random(3)
    texts = pa.array([None, "", "\n", *("".join(rng.choices("aB é\n\t", k=rng.randint(1, 40))) for _ in range(200))])
    base = np.arange(len(texts)) << 31
    whole = ld.Lines(texts, base)
    asked = []

    def wanted(row, number):
        asked.append(len(row))
        return (row + number) % 3 == 0

    some = ld.Lines(texts, base, wanted)
    keep = wanted(whole.row, whole.number)
    assert asked == [len(whole.n)] * 2 and keep.any() and (some.n == np.where(keep, whole.n, 0)).all()
    assert (some.row == whole.row).all() and (some.number == whole.number).all() and (some.values == whole.values[np.repeat(keep, whole.n)]).all()


def test_postings_without_partners():
    rng = np.random.RandomState(4)
    n = 4000
    cols = {"word": rng.zipf(1.3, n) * 2**40 % 2**62, "key": np.arange(n), "doc": rng.randint(0, 900, n), "line": np.arange(n), "b1": rng.randint(0, 2**40, n), "b2": np.zeros(n), "n": rng.randint(2, 9, n), "pos": np.zeros(n)}
    held = [tuple(np.asarray(cols[c]).astype(kind) for c, kind in ld.POSTING.items())]

    def pairs(p):
        return sorted((p.word[a], p.line[a], p.line[b], c) for i, j, apart in p.pairs(0.1) for a, b, c in zip(i, j, apart, strict=True))

    every, some = ld.Postings(held), ld.Postings(held, set())
    word, count = np.unique(held[0][0], return_counts=True)
    lone = word[count == 1]
    assert pairs(every) and pairs(every) == pairs(some) and len(every.word) == n
    assert len(lone) and len(some.word) == n - len(lone) and len(ld.Postings(held, {int(lone[0])}).word) == n - len(lone) + 1
    for p in (every, some):
        assert (np.lexsort((p.line, p.doc, p.n, p.word)) == np.arange(len(p.word))).all()
    assert not len(ld.Postings([tuple(c[held[0][0] == lone[0]] for c in held[0])], set()).word)
