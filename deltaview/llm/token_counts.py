"""Token counts by rank-synchronous array merging.

The distinct pre-tokens of a block of documents are held as one ragged numpy array. Each
round applies every pre-token's lowest-rank pair, in all of them at once; what symbols
survive are counted and summed up by document. No ids are made.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaview.llm.bytelevel import ByteLevel, cut_block, whole
from deltaview.llm.runtime import ensure_importable, held, slices, tidied

#: Distinct cuts a worker keeps between blocks; those beyond it are merged anew in each block.
CACHE = 700_000
BLOCK_CHARS = 8_000_000

_FILES: dict[str, ByteLevel] = {}


def _counts(spec: ByteLevel, texts: list[str]) -> list[int]:
    own = [spec.words(t) for t in texts]
    words = list(set().union(*(w for w, _ in own)))
    of = dict(zip(words, spec.count(words).tolist(), strict=True))
    return [n + sum([of[w] for w in ws]) for ws, n in own]


def count_all(texts: list[str], path: str) -> Iterator[int]:
    """Number of tokens of each text, as the tokenizers library counts them."""
    if path not in _FILES:
        _FILES[path] = ByteLevel(path)
    spec = _FILES[path]
    cache: dict[str, int] = held(f"token counts {path}", dict)
    for begin, end in slices([len(t) for t in texts], BLOCK_CHARS):
        heads, tails, new = cut_block(texts[begin:end], cache)
        rest: dict[str, int] = {}
        (cache if len(cache) + len(new) <= CACHE else rest).update(zip(new, _counts(spec, whole(new)), strict=True))
        get = cache.get
        for head, tail in zip(_counts(spec, heads), tails, strict=True):
            yield head + sum([get(c) or rest[c] for c in tail])


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit.

    Null and empty texts count 0. Strings of added tokens count as one token each. Texts of
    any length are counted whole; repeated rows give repeated results; other columns are
    not read.
    """
    ensure_importable(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidied(batches):
            counts = list(count_all([t or "" for t in batch.column(1).to_pylist()], path))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).mapInArrow(work, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
