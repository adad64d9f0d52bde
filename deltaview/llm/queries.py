"""The corpus operators as registered queries, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaview.llm import decontaminate, embedding_dedup, language_id, line_dedup, ngram_join, sentencepiece_codec, suffix_dedup, token_counts, token_store, toxicity
from deltaview.llm.runtime import is_held_out


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups at a Jaccard similarity of 0.8 of 5-word shingles."""
    return ngram_join.link(_read(spark, sf_dir, "documents"), k=5, threshold=(4, 5)).select("doc_id", "n_shingles", "component_id")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes covered by 100-byte strings that start earlier in the corpus, removed."""
    return suffix_dedup.digest(_read(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SentencePiece ids and their decoded text, as digests."""
    return sentencepiece_codec.digest(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under a byte-level BPE vocabulary."""
    return token_counts.token_counts(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of 40 characters or more in 5 documents or more, kept in the last one only."""
    return line_dedup.digest(_read(spark, sf_dir, "documents"), min_chars=40, min_docs=5)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores, learned from the labelled rows that aren't held out."""
    docs = _read(spark, sf_dir, "documents")
    net = toxicity.fit(docs, _read(spark, sf_dir, "labels"), learn=~is_held_out(F.col("doc_id")))
    out = toxicity.score(docs, net)
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of embeddings of one label at a cosine of 0.93."""
    return embedding_dedup.near_duplicates(_read(spark, sf_dir, "embeddings"), threshold=0.93)


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold 0.8 or more of a benchmark item's 5-word shingles."""
    return decontaminate.contained(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), k=5, threshold=(4, 5))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-id files written in doc_id order, then read back."""
    files = token_store.write_tokens(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_store.read_tokens(spark, files)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the rows that aren't held out."""
    docs = _read(spark, sf_dir, "documents")
    out = language_id.predict(docs, learn=~is_held_out(F.col("doc_id")))
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


_OPERATORS = (
    op1_ngram_jaccard, op2_suffix_dedup, op3_sentencepiece, op4_token_counts, op5_line_dedup, op6_toxicity, op7_embedding_dedup,
    op8_benchmark_decontamination, op9_token_files, op10_language_id,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _OPERATORS} | {"pipeline": corpus_pipeline.run}


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Distinct 5-word shingles of a table, the whole sequence of texts of fewer words.
_SHINGLES = """
  {name}_words AS (SELECT {id} AS id, regexp_extract_all(""" + _LOWER.format("coalesce(text, '')") + """, '[^\x20\x09-\x0D]+') AS w FROM {table}),
  {name} AS (SELECT DISTINCT id, unnest(list_transform(range(greatest(len(w) - 4, least(len(w), 1))), lambda i: array_to_string(w[i + 1:i + 5], ' '))) AS s FROM {name}_words)"""

_OP1 = "WITH RECURSIVE" + _SHINGLES.format(name="sh", id="doc_id", table="documents") + """,
  sizes AS (SELECT id, count(*) AS n FROM sh GROUP BY id),
  common AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.id < y.id GROUP BY 1, 2),
  links AS (SELECT a, b FROM common JOIN sizes p ON p.id = a JOIN sizes q ON q.id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
  both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
  reach AS (SELECT doc_id AS id, doc_id AS other FROM documents UNION SELECT r.id, e.b FROM reach r JOIN both_ways e ON e.a = r.other)
SELECT d.doc_id, coalesce(max(s.n), 0)::BIGINT AS n_shingles, min(r.other) AS component_id
FROM documents d JOIN reach r ON r.id = d.doc_id LEFT JOIN sizes s ON s.id = d.doc_id GROUP BY d.doc_id"""

_OP5 = """
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
  l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM split),
  k AS (SELECT *, """ + _LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))") + """ AS key FROM l),
  hot AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
  j AS (SELECT k.*, hot.key IS NOT NULL AND doc_id < last AS gone FROM k LEFT JOIN hot ON hot.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id"""

_OP8 = "WITH" + _SHINGLES.format(name="d", id="doc_id", table="documents") + "," + _SHINGLES.format(name="q", id="item_id", table="benchmark") + """,
  long AS (SELECT q.* FROM q JOIN q_words w ON w.id = q.id WHERE len(w.w) >= 5),
  sizes AS (SELECT id, count(*) AS n FROM long GROUP BY id),
  common AS (SELECT d.id AS doc_id, q.id AS item_id, count(*) AS c FROM long q JOIN d ON d.s = q.s GROUP BY 1, 2)
SELECT doc_id, item_id, n AS n_shingles, c AS n_common, c::DOUBLE / n AS containment
FROM common JOIN sizes ON sizes.id = item_id WHERE 5 * c >= 4 * n
UNION ALL
SELECT d.id, q.id, 1, 1, 1.0::DOUBLE
FROM q_words q JOIN d_words d ON contains(' ' || array_to_string(d.w, ' ') || ' ', ' ' || array_to_string(q.w, ' ') || ' ') WHERE len(q.w) BETWEEN 1 AND 4"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard": _OP1, "op5_line_dedup": _OP5, "op8_benchmark_decontamination": _OP8}
