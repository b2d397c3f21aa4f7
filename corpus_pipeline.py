"""From raw documents to token ids: five stages, each over all that the one before kept.

1. toxicity     documents that the fitted chain scores 0.5 or more go
2. lines        lines that match an earlier line go; documents that lose every line with words go
3. near copies  of each group that five-word-shingle similarities of 0.8 join, the least doc_id stays
4. benchmark    documents that hold a stretch of a benchmark item go
5. encoding     token ids of what is left

Null texts and texts without words pass stages 1 to 4 unchanged and encode to no ids; rows with a null doc_id pass
the two deduplicating stages untouched. An empty table gives an empty one. ``labels`` and ``benchmark`` are read
from ``sf_dir``. Columns beside those of ``documents`` are kept up to stage 4.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import bpe, decontamination, jaccard_join, line_dedup, toxicity
from spanloom.llm.common import materialise, table


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.5; the model is fitted on the labelled rows of the corpus' own documents."""
    model = toxicity.train(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity.drop_toxic(docs, model)


def lines_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that match an earlier one."""
    return line_dedup.remove_repeated_lines(docs)


def copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard_join.one_of_each(docs)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no stretch of a benchmark item."""
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids of every document left."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.encode_documents(docs, path, bpe.build_lexicon(docs, path), keep_ids=True)


STAGES = [("toxicity", toxic_out), ("lines", lines_out), ("near copies", copies_out), ("benchmark", benchmark_out), ("encoding", encoded)]
#: No stage but the fourth could be put in SQL; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs.withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), " "))
