"""The registered queries: columns and types of every one, and the pipeline against a plain chain of its stages."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from spanloom.llm import decontamination, registry, toxicity
from spanloom.llm.common import table
from test_similarity import brute_classes, brute_lines, brute_repeats

DATA = "/root/testdata/sf0.001"
#: What each query must return, by its contract.
COLUMNS = {
    "op1_token_blocks": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op2_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op3_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op4_html_text": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op5_jaccard_join": {"doc_id": "bigint", "class_id": "bigint", "n_links": "bigint"},
    "op6_vector_search": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    "op7_line_dedup": {"doc_id": "bigint"},
    "op8_suffix_dedup": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op9_decontamination": {"doc_id": "bigint", "item_id": "bigint"},
    "op10_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
}


@pytest.fixture(scope="module")
def rows(spark):
    return [(r.doc_id, r.text) for r in table(spark, DATA, "documents", "doc_id", "text").collect()]


@pytest.mark.parametrize("name", COLUMNS)
def test_columns(spark, name, rows):
    out = registry.queries()[name](spark, DATA)
    assert COLUMNS[name].items() <= dict(out.dtypes).items()
    got = out.collect()
    if "held_out" in out.columns:
        mod, rest = (4, 2) if name.startswith("op2") else (5, 0)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == rest) and 0 <= r.score <= 1 for r in got)
    if COLUMNS[name].keys() >= {"doc_id"} and name != "op9_decontamination":
        assert sorted(r.doc_id for r in got) == sorted(d for d, _ in rows)
    if name == "op5_jaccard_join":
        assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == brute_classes(rows)
    if name == "op7_line_dedup":
        gone = brute_lines(rows)
        assert {(r.doc_id, int(k)) for r in got for k in r.removed.split(",") if k} == gone
        lines = {d: (t or "").count("\n") + (0 if not t or t.endswith("\n") else 1) for d, t in rows}
        assert {r.doc_id: r.n_lines for r in got} == lines
    if name == "op8_suffix_dedup":
        assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_repeats(rows)


def test_pipeline_against_plain_chain(spark, rows):
    """Row for row: the fitted chain, set comparisons of lines and documents, the search, the tokenizers library."""
    import pyarrow as pa

    docs = table(spark, DATA, "documents", "doc_id", "text")
    model = toxicity.train(docs, table(spark, DATA, "labels", "doc_id", "toxic"))
    score, _ = toxicity.score_texts(model, pa.array([t for _, t in rows], pa.string()), spans=False)
    left = sorted((d, t) for (d, t), s in zip(rows, score, strict=True) if s < 0.5)
    gone = brute_lines(left)
    cut = []
    for d, t in left:
        mine = [k for k in range((t or "").count("\n") + 1) if (d, k) in gone]
        kept = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in mine) if mine else t
        if not mine or kept.split():
            cut.append((d, kept))
    first = [(d, t) for (d, t), (e, c, _) in zip(cut, brute_classes(cut), strict=True) if c == e]
    p = decontamination.patterns([(r.item_id, r.text) for r in table(spark, DATA, "benchmark", "item_id", "text").collect()])
    hit = {r for r, _ in decontamination.search(p, pa.array([t for _, t in first], pa.string()))}
    clean = [x for k, x in enumerate(first) if k not in hit]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    want = {}
    for d, t in clean:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[d] = (" ".join(map(str, ids)), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest())
    got = {r.doc_id: (r.ids, r.ids_sha256) for r in corpus_pipeline.run(spark, DATA).collect()}
    assert len(rows) > len(got) > 100 and got == want


def test_stages_odd_rows(spark):
    """Every stage on null, empty, repeated and clashing rows, and on none."""
    odd = spark.createDataFrame([(1, None, "en", "s", 0, 1, "x"), (None, "a b c d e f g", None, None, 13, 2, "y"), (2, "", "en", "s", 0, 3, "z"), (3, "a b c d e f g", "en", "s", 13, 4, "w"), (3, "a b c d e f g", "en", "s", 13, 4, "w"), (4, "a b c d e f g\nq r s t u", "en", "s", 23, 5, "v")], "doc_id long, text string, lang string, source string, n_chars long, gone int, base string")
    for name, stage in corpus_pipeline.STAGES:
        for df in (odd, odd.limit(0)):
            out = stage(spark, df, DATA)
            if name != "encoding":
                assert out.columns == odd.columns
            got = out.collect()
            assert len(got) == 0 if df is not odd else {r.doc_id for r in got} >= {None, 1, 2, 3}
