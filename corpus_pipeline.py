"""Corpus preparation as a chain of stages over `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next stage's docs. All but the last return the columns of documents:

1. quality: documents that the classifier rejects go;
2. lines: repeated passages (30 or more words in whole sentences) and repeated multi-line chunks are cut out; a document
   of which nothing is left goes;
3. near_duplicates: of each group of near copies (five-word shingles, similarity 0.8) the smallest id stays;
4. decontaminate: documents that hold a benchmark item go;
5. pack: what is left is packed into sequences.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightmill.llm import decontaminate, jaccard_join, line_dedup, packing, quality
from brightmill.llm.common import cut_lineage, doc_remainder, table
from brightmill.session import shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
QUALITY_THRESHOLD = 0.3

#: Packing needs a tokenizer, so SQL can't express the result.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a score of 0.3 or more, learned from the labels outside the held-out fifth."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    # statistics before the join: they are far smaller than the texts, which so are not shuffled
    features = docs.where(doc_remainder(F.col("doc_id"), 5) != 0).select("doc_id", quality.feature_column().alias("features"))
    model = quality.fit(cut_lineage(features).join(labels, "doc_id"))  # cut: else one task may run two Python workers
    return docs.withColumn("__score", quality.score_text_column(docs, model)).where(F.col("__score") >= QUALITY_THRESHOLD).drop("__score")


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out repeated passages, then repeated chunks, and drops documents of which nothing visible is left. n_chars follows the text."""
    out = line_dedup.dedup_lines(line_dedup.dedup_passages(docs))
    cut = F.col("removed_passages") + F.col("removed_chunks") > 0
    left = ~cut | (F.trim(F.translate("text", "\n\t\r", "   ")) != "")
    n_chars = F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.where(left).withColumn("n_chars", n_chars).select(*docs.columns)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id."""
    return jaccard_join.keep_one(docs, jaccard_join.JaccardJoin(k=5, percent=80))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold at least 0.8 of a benchmark item's five-word shingles."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents as instruction data into sequences of at most 4096 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), packing.INSTRUCTIONS, prompt_share=packing.PROMPT_SHARE)


STAGES = [
    ("quality", quality_stage),
    ("lines", lines_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontaminate", decontaminate_stage),
    ("pack", pack_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    base = shared_folder(spark, f"corpus-{uuid.uuid4().hex}")
    last = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if last:  # nothing reads it any more
            path = spark._jvm.org.apache.hadoop.fs.Path(last)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        last = f"{base}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
