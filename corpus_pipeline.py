"""Corpus cleaning, stage by stage. Each stage takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's docs. All but the
last return the columns of documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaview.llm import decontaminate, line_dedup, ngram_join, sentencepiece_codec, toxicity
from deltaview.llm.runtime import is_held_out, stored


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more go. Learned from the documents and labels of the corpus
    that aren't held out; texts without words stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    net = toxicity.fit(docs, labels, learn=~is_held_out(F.col("doc_id")))
    return toxicity.accepted(docs, net, threshold=0.3)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 characters or more in 5 documents or more stay in the last one only; n_chars
    follows. All documents stay, those without lines left as empty texts. Rows without doc_id
    stay as they are; a column named n_lines or the like is one of the documents' own."""
    out = line_dedup.cleaned(docs, min_chars=40, min_docs=5)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at a Jaccard similarity of 0.8 of 5-word shingles, that of the
    smallest doc_id stays. Documents of empty sets or without doc_id stay."""
    groups = ngram_join.link(docs, k=5, threshold=(4, 5))
    gone = groups.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 0.8 or more of a benchmark item's 5-word shingles go. Null and empty
    texts hold none and stay; without items, or with empty ones only, all documents stay."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=5, threshold=(4, 5))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and decoded_sha256 of the text that the ids decode to. One row for
    each row; null and empty texts have no ids and decode to the empty text."""
    out = sentencepiece_codec.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", remove_toxic),
    ("line_dedup", remove_repeated_lines),
    ("ngram_jaccard", remove_near_duplicates),
    ("decontamination", remove_benchmark),
    ("sentencepiece", encode),
]

#: SQL cannot train the toxicity network; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
