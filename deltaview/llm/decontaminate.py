"""Benchmark decontamination: which short test items stand inside which documents.

Containment of an item (distinct shingles Q) in a document (X) is |Q ∩ X| / |Q|. The search is a
size-partitioned MinHash search that can't miss. All hashes are of one permutation (mixed 64 bits).

1. An item must share need = ceil(t |Q|) shingles. Its signature is its |Q| - need + 1 smallest
   hashes: whatever need of its shingles a document holds, one of these is among them.
   Ordinary MinHash signatures of a fixed length would miss short items in long documents.
2. Items are dealt into size partitions by powers of two of need. A partition's signatures
   reach up to its largest value. Partition p is marked as bit p in one table of hash slots.
3. A document of |X| shingles can reach the threshold in the partitions of need <= |X| only. Its
   signature is its hashes up to the largest value of these partitions, and they are
   looked up in these partitions' bits. What is found there is looked up in the items' signatures.
4. Candidates are verified by exact shingle containment.

Documents are never shuffled: a block of items (bounded in number and in characters) is
broadcast, and more items mean more passes over the documents, not a larger broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaview.llm import shingles
from deltaview.llm.runtime import ensure_importable, pieces, slices

#: A block of items has about so many items and characters at most.
BLOCK_ITEMS, BLOCK_CHARS = 50_000, 32_000_000
_BITS = 22


@dataclass
class Items:
    """Shingle sets of a block of items, and the index of their signatures."""

    sets: list[np.ndarray]
    words: np.ndarray
    need: np.ndarray
    values: np.ndarray  # signatures, ascending
    owners: np.ndarray
    partitions: np.ndarray  # by hash slot: the size partitions that hold a signature there, as bits
    reach: np.ndarray  # by size partition: the largest value of its signatures and of smaller ones'
    widths: list[int]


def size_partition(n: np.ndarray) -> np.ndarray:
    """The power of two that n does not exceed, at most 31."""
    return np.minimum(31, np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))


def index_items(texts: list[str | None], k: int, threshold: tuple[int, int]) -> Items:
    words, bounds = shingles.word_hashes([(t or "").encode() for t in texts])
    flat, begins = shingles.distinct_sorted(*shingles.shingle_hashes(words, bounds, k))
    sets = np.split(flat, begins[1:-1])
    size = np.diff(begins)
    need = -(-threshold[0] * size // threshold[1])
    rank = np.arange(len(flat)) - np.repeat(begins[:-1], size)  # sets are sorted: the smallest values come first
    signed = rank <= np.repeat(size - need, size)
    values, owners = flat[signed], np.repeat(np.arange(len(texts)), size)[signed]
    order = np.argsort(values, kind="stable")
    values, owners = values[order], owners[order]
    at = size_partition(need)[owners]
    partitions, reach = np.zeros(1 << _BITS, np.uint32), np.zeros(32, np.uint64)
    np.bitwise_or.at(partitions, (values >> shingles.U(64 - _BITS)).astype(np.int64), np.uint32(1) << at.astype(np.uint32))
    np.maximum.at(reach, at, values)
    count = np.diff(bounds)
    return Items(sets, count, need, values, owners, partitions, np.maximum.accumulate(reach), sorted({int(c) for c in count[(count > 0) & (count < k)]}))


def search(texts: list[bytes], items: Items, k: int) -> Iterator[tuple[int, int, int]]:
    """(place of the text, place of the item, common shingles) of all pairs over the threshold."""
    words, bounds = shingles.word_hashes(texts)
    for width in [k, *items.widths]:
        if width == k:
            hashes, begins = shingles.shingle_hashes(words, bounds, k)
        else:  # items of fewer words than a shingle: their whole sequence, anywhere in the text
            wide = np.where(np.diff(bounds) >= width, np.diff(bounds) - width + 1, 0)
            begins = np.r_[0, np.cumsum(wide)]
            first = np.repeat(bounds[:-1] - begins[:-1], wide) + np.arange(begins[-1])
            hashes = _sequences(words, first, width, k)
        size = np.diff(begins)
        largest = size_partition(size)
        near = np.flatnonzero(hashes <= np.repeat(items.reach[largest], size))
        probed = np.repeat(np.uint32(2) << largest.astype(np.uint32), size)[near] - np.uint32(1)  # bits of all partitions up to the largest
        near = near[items.partitions[(hashes[near] >> shingles.U(64 - _BITS)).astype(np.int64)] & probed > 0]
        if not len(near):
            continue
        left = np.searchsorted(items.values, hashes[near], "left")
        right = np.searchsorted(items.values, hashes[near], "right")
        hit = right > left
        text = np.searchsorted(begins, near[hit], "right") - 1
        left, many = left[hit], (right - left)[hit]
        slots = np.repeat(left - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
        pairs = np.unique(np.stack([np.repeat(text, many), items.owners[slots]], 1), axis=0)
        item_words = items.words[pairs[:, 1]]
        pairs = pairs[(item_words >= k) if width == k else (item_words == width)]
        pairs = pairs[items.need[pairs[:, 1]] <= size[pairs[:, 0]]]
        last, own = -1, None
        for t, i in pairs.tolist():
            if t != last:
                last, own = t, np.unique(hashes[begins[t] : begins[t + 1]])
            at = np.searchsorted(own, items.sets[i])
            common = int((own[np.minimum(at, len(own) - 1)] == items.sets[i]).sum())
            if common >= items.need[i]:
                yield t, i, common


def _sequences(words: np.ndarray, first: np.ndarray, width: int, k: int) -> np.ndarray:
    """Hashes that texts of just these words would have as their whole sequence."""
    starts = np.r_[0, np.cumsum(np.full(len(first), width))]
    spread = words[(first[:, None] + np.arange(width)).ravel()] if len(first) else words[:0]
    return shingles.shingle_hashes(spread, starts, k)[0]


def _item_blocks(items: DataFrame, item_id: str, item_text: str) -> Iterator[tuple[list, list]]:
    """Ids and texts of the items, in blocks cut row by row as they are read: no block is larger
    than its bounds, or one item. Without items there is one empty block."""
    ids: list[int | None] = []
    texts: list[str | None] = []
    chars, empty = 0, True
    for row in items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).toLocalIterator():
        n = len(row["text"] or "")
        if ids and (len(ids) == BLOCK_ITEMS or chars + n > BLOCK_CHARS):
            yield ids, texts
            ids, texts, chars, empty = [], [], 0, False
        ids.append(row["item_id"])
        texts.append(row["text"])
        chars += n
    if ids or empty:
        yield ids, texts


def contained(docs: DataFrame, items: DataFrame, k: int = 5, threshold: tuple[int, int] = (4, 5), doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and item of containment >= threshold (a fraction of two ints):
    doc_id, item_id, n_shingles (of the item), n_common, containment.

    Items of fewer than k words count as one shingle, found wherever their words follow each
    other. Null, empty or blank items are in no document, and such documents hold none.
    Repeated rows of either side give repeated rows. No documents or no items: no rows.
    Other columns are not read.
    """
    spark = docs.sparkSession
    ensure_importable(spark)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(doc_text).cast("string").alias("text"))
    out = None
    for block in _item_blocks(items, item_id, item_text):
        shared = spark.sparkContext.broadcast(block)

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, own = shared.value
            index = index_items(own, k, threshold)
            for batch in pieces(batches):
                doc_ids = batch.column(0).to_pylist()
                raw = [(t or "").encode() for t in batch.column(1).to_pylist()]
                found = [(doc_ids[a + t], ids[i], len(index.sets[i]), c, c / len(index.sets[i])) for a, b in slices([len(t) for t in raw], shingles.BLOCK_BYTES) for t, i, c in search(raw[a:b], index, k)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], ["doc_id", "item_id", "n_shingles", "n_common", "containment"])

        part = texts.mapInArrow(work, "doc_id long, item_id long, n_shingles long, n_common long, containment double")
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, items: DataFrame, k: int = 5, threshold: tuple[int, int] = (4, 5), text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, that hold no item to the threshold (see contained).

    Null and empty texts hold nothing and stay, as does everything if there are no items;
    repeated rows share one fate; any length is judged whole; a null id means nothing here, and
    columns may have any name. Rows are judged where they are read; nothing is shuffled.
    """
    spark = docs.sparkSession
    ensure_importable(spark)
    at, schema = docs.columns.index(text_col), docs.schema
    for block in _item_blocks(items, item_id, item_text):
        shared = spark.sparkContext.broadcast(block[1])

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = index_items(shared.value, k, threshold)
            for batch in pieces(batches):
                raw = [(t or "").encode() for t in batch.column(at).to_pylist()]
                keep = np.ones(len(raw), bool)
                for a, b in slices([len(t) for t in raw], shingles.BLOCK_BYTES):
                    for t, _, _ in search(raw[a:b], index, k):
                        keep[a + t] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(work, schema)
    return docs
