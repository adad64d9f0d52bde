"""Removal of repeated byte strings, by column-wise sorting of many documents' suffixes.

Two equal strings of LENGTH bytes hold the same anchor at the same place: the leftmost of
their GRAM-byte strings of least hash. So all strings that can be equal meet under one
anchor, and a document is a chain of segments, each the strings of one anchor.

1. Segments are found in every document and shuffled as hashes: (anchor, segment, doc_id,
   start). Of equal segments only the first one keeps anything. An anchor with a single
   distinct segment needs no more. Segments are called equal by 128 hash bits (64 of the anchor, 64
   of the whole segment); bytes are not compared again.
2. Segments of the other anchors are shuffled with their bytes. Those of an anchor form a
   collection, laid side by side with their anchors in one column. The collection's suffixes
   are sorted by inserting one symbol of every segment a round, from the right: a stable
   sort by the new symbol turns the last column's order into this one's, and the common
   prefixes of neighbours follow from range minima of the last ones. Neighbours whose common
   prefix reaches LENGTH start with equal strings; all but the earliest start are repeated.
   Equal strings have their anchor at one place, so a column need only be compared with
   itself, and a round needs the last column's order and prefixes, not the whole transform.
3. Ranges go back to their documents.

Within a task equal segments are collapsed before the shuffle. An anchor with more than HOT
distinct segments, as at the ends of a very common passage, is split into its columns and what
they hold: each of its strings is compared for itself, by 128 bits of its two halves, and
collapsed within tasks like a segment. So a collection holds HOT segments of an anchor at most,
however large the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deltaview.llm import shingles
from deltaview.llm.runtime import ensure_importable, shuffle_width, slices, stored, tidied

U = np.uint64
#: Strings of LENGTH bytes or more are removed; anchors are strings of GRAM bytes.
LENGTH, GRAM = 100, 30
SPAN = LENGTH - GRAM + 1
HOT = 4_096
#: Anchors that a bit table of 32 MB is made for, at most; for more, their lists go to the documents by a join.
TABLE_IDS = 4_000_000
#: Segments and strings that a task holds before it passes them on.
HELD_ROWS = 400_000
BLOCK_BYTES = 1_000_000
#: Segments of a task among which equal ones are collapsed before the shuffle.
COLLAPSED = 1_000_000
#: Segments that are sorted together at most, but for those of one anchor; 16 bits must number their anchors.
COLLECTION = 60_000
_BYTE = shingles.mix(np.arange(5001, 5257, dtype=U) * U(0xD1B54A32D192ED03))
_UP = 0xC2B2AE3D27D4EB4F


class Block:
    """Documents one after another, with prefix sums from which any substring's hash follows."""

    def __init__(self, texts: list[bytes]):
        self.data = b"".join(texts)
        self.bounds = np.r_[0, np.cumsum([len(t) for t in texts])]
        buffer = np.frombuffer(self.data, np.uint8)
        n = len(buffer)
        self.total = np.zeros(n + 1, U)
        np.cumsum(_BYTE[buffer] * shingles._power(_UP, "bytes up", n)[:n], out=self.total[1:])
        self.down = shingles._power(pow(_UP, -1, 2**64), "bytes down", n + 1)

    def hashes(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return shingles.mix((self.total[end] - self.total[begin]) * self.down[begin])

    def segments(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each segment: its text, its anchor's place, its first string's place, its number
        of strings (places in the block), and its anchor's hash."""
        n = len(self.data)
        empty = np.zeros(0, np.int64)
        if n < LENGTH:
            return empty, empty, empty, empty, np.zeros(0, U)
        grams = n - GRAM + 1
        low = shingles.mix((self.total[GRAM:] - self.total[:grams]) * self.down[:grams])
        place, width = np.arange(grams, dtype=np.int32), 1
        keys = low
        while width < SPAN:
            step = min(width, SPAN - width)
            left = keys[:-step] <= keys[step:]  # equal grams: the leftmost
            place = np.where(left, place[:-step], place[step:])
            keys = np.minimum(keys[:-step], keys[step:])
            width += step
        # place[i]: anchor of the string that starts at i. Strings across two texts are none.
        text = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))[: len(place)]
        valid = np.arange(len(place)) + LENGTH <= self.bounds[1:][text]
        place = np.where(valid, place, -1)
        begin = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        size = np.diff(np.r_[begin, len(place)])
        some = place[begin] >= 0
        begin, size = begin[some], size[some]
        anchor = place[begin].astype(np.int64)
        return text[begin], anchor, begin, size, low[anchor]


def _segment_hash(block: Block, anchor: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    return shingles.mix(block.hashes(begin, begin + size + (LENGTH - 1)) ^ ((anchor - begin) * 1_000 + size).astype(U))


def _later(h: np.ndarray, s: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows, those that are the first of their (h, s) by (doc, start), and those that start later."""
    order = np.lexsort((start, doc, s, h))
    h, s, doc, start = h[order], s[order], doc[order], start[order]
    fresh = np.r_[True, (h[1:] != h[:-1]) | (s[1:] != s[:-1])] if len(h) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(h)), 0)) if len(h) else order
    later = (doc != doc[first]) | (start != start[first])
    return order[fresh], order[later]


def _find(texts: DataFrame) -> DataFrame:
    """Segments as hashes, equal ones of a task collapsed: h, s, doc_id, start, size. Ranges
    that a task knows to be repeated have h null and size their number of strings."""

    def collapsed(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        h, s, doc, start, size = (np.concatenate(x) for x in zip(*found, strict=True))
        first, later = _later(h, s, doc, start)
        both = np.r_[first, later]
        known = np.r_[np.zeros(len(first), bool), np.ones(len(later), bool)]
        # Rows known to be repeated only pass through the shuffle: any partition will do.
        return pa.RecordBatch.from_arrays(
            [pa.array(np.where(known, doc[both] ^ start[both], h[both].view(np.int64))), pa.array(s[both].view(np.int64), mask=known), pa.array(doc[both], pa.int64()), pa.array(start[both], pa.int32()), pa.array(size[both], pa.int32())],
            ["h", "s", "doc_id", "start", "size"],
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, ...]] = []
        rows = 0
        for batch in tidied(batches):
            raw = [t or b"" for t in batch.column(1).to_pylist()]
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b in slices([len(t) for t in raw], BLOCK_BYTES):
                block = Block(raw[a:b])
                text, anchor, begin, size, h = block.segments()
                found.append((h, _segment_hash(block, anchor, begin, size), ids[a + text], begin - block.bounds[text], size))
                rows += len(h)
            if rows >= COLLAPSED:
                yield collapsed(found)
                found, rows = [], 0
        if found:
            yield collapsed(found)

    return texts.mapInArrow(work, "h long, s long, doc_id long, start int, size int")


def _bit_table(ids: DataFrame) -> np.ndarray:
    """A bit for each hash h of ids: 64 bits for each of them, up to 2^28 (32 MB). Anchors have
    the least hashes, so it is the low bits that are evenly spread."""
    bits = min(28, max(16, (64 * ids.count()).bit_length()))
    slot = F.col("h").bitwiseAND(F.lit((1 << bits) - 1))
    rows = ids.select(F.shiftright(slot, 15).alias("word"), (slot % 32_768).alias("bit")).groupBy("word").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    table = np.zeros(1 << (bits - 3), np.uint8)
    for r in rows:
        table[r["word"] * 4096 : (r["word"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return table


def _holds(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & U(len(table) * 8 - 1)
    return (table[(at >> U(3)).astype(np.int64)] >> (at & U(7)).astype(np.uint8)) & 1 > 0


def _by_table(mixed, hot):
    """Whether segments' anchors are mixed, and hot, by broadcast bit tables."""
    return lambda batch, a, b: lambda text, h: (_holds(mixed.value, h), _holds(hot.value, h))


def _by_list(batch: pa.RecordBatch, a: int, b: int):
    """The same by the lists that came with the documents a to b of a batch."""
    known = []
    for column in (2, 3):
        held = batch.column(column).slice(a, b - a)
        owner = np.repeat(np.arange(b - a), held.fill_null([]).value_lengths().to_numpy(zero_copy_only=False))
        known.append(held.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(U) ^ shingles.mix(owner.astype(U)))
    return lambda text, h: tuple(np.isin(h ^ shingles.mix(text.astype(U)), x) for x in known)


def _gather(texts: DataFrame, tests) -> DataFrame:
    """What is left of the segments of mixed anchors (and of a few others), in three kinds:
    "segment", with key (its anchor's hash), s (its own), doc_id, anchor and start (places in the
    document), size and bytes; "string", of hot anchors, with key and s (its halves' hashes) and
    size 1; "known", strings that a task knows to be repeated."""

    def batch_of(rows: list[tuple], pieces: list[bytes | None]) -> pa.RecordBatch:
        h, s, doc, anchor, start, size, single = (np.concatenate(x) for x in zip(*rows, strict=True))
        first, later = _later(h, s, doc, start)
        later = later[single[later]]  # later ones of whole segments are known by now, those of strings are not
        both = np.r_[first, later]
        kind = np.where(np.arange(len(both)) >= len(first), "known", np.where(single[both], "string", "segment"))
        return pa.RecordBatch.from_arrays(
            [pa.array(kind.astype(object), pa.string()), pa.array(h[both].view(np.int64)), pa.array(s[both].view(np.int64)), pa.array(doc[both], pa.int64()), pa.array(anchor[both], pa.int32()), pa.array(start[both], pa.int32()), pa.array(size[both], pa.int32()), pa.array([*(pieces[i] for i in first.tolist()), *([None] * len(later))], pa.binary())],
            ["kind", "key", "s", "doc_id", "anchor", "start", "size", "bytes"],
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        pieces: list[bytes | None] = []
        for batch in tidied(batches):
            raw = [t or b"" for t in batch.column(1).to_pylist()]
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b in slices([len(t) for t in raw], BLOCK_BYTES):
                block, test = Block(raw[a:b]), tests(batch, a, b)
                text, anchor, begin, size, h = block.segments()
                some, split = test(text, h)
                for single, chosen in ((False, some & ~split), (True, some & split)):
                    own = [x[chosen] for x in (text, anchor, begin, size, h)]
                    if not len(own[0]):
                        continue
                    t, at, start, n, key = _strings(block, *own[:4]) if single else own
                    s = block.hashes(start + LENGTH // 2, start + LENGTH) if single else _segment_hash(block, at, start, n)
                    origin = block.bounds[t]
                    rows.append((key, s, ids[a + t], at - origin, start - origin, n, np.full(len(t), single)))
                    pieces += [None] * len(t) if single else [block.data[x:y] for x, y in zip(start.tolist(), (start + n + (LENGTH - 1)).tolist(), strict=True)]
                if len(pieces) >= HELD_ROWS:
                    yield batch_of(rows, pieces)
                    rows, pieces = [], []
        if rows:
            yield batch_of(rows, pieces)

    return texts.mapInArrow(work, "kind string, key long, s long, doc_id long, anchor int, start int, size int, bytes binary")


def _strings(block: Block, text: np.ndarray, anchor: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """Every string of the segments as a segment of its own, under the hash of its first half."""
    within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    start = np.repeat(begin, size) + within
    return np.repeat(text, size), np.repeat(anchor, size), start, np.ones(len(start), np.int64), block.hashes(start, start + LENGTH // 2)


def repeated(group: np.ndarray, rank: np.ndarray, offset: np.ndarray, size: np.ndarray, pieces: list[bytes]) -> np.ndarray:
    """Which strings repeat an earlier one, as [segment, column] from the leftmost column.

    Segments of a group are laid with their anchors in one column; `offset` is the anchor's
    place in a segment, `size` its number of strings, `rank` its order in the corpus.
    """
    m, left = len(group), int(offset.max())
    lengths = np.array([len(p) for p in pieces])
    width = left + int((lengths - offset).max())
    symbols = np.zeros((width, m), np.uint16)  # 0: no symbol, else the byte + 1
    flat = np.frombuffer(b"".join(pieces), np.uint8)
    owner = np.repeat(np.arange(m), lengths)
    column = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + (left - offset)[owner]
    symbols[column, owner] = flat.astype(np.uint16) + 1
    group = np.unique(group, return_inverse=True)[1].astype(np.uint16 if m <= 65_536 else np.int64)
    order = np.argsort(group, kind="stable")
    prefix = np.zeros(m, np.uint8)  # common prefix of a row and the one before it, in order
    out = np.zeros((m, left + 1), bool)
    for x in range(width - 1, -1, -1):
        symbol = symbols[x, order]
        move = np.argsort(symbol, kind="stable")
        move = move[np.argsort(group[order[move]], kind="stable")]
        new, sym = order[move], symbol[move]
        same = np.r_[False, (group[new[1:]] == group[new[:-1]]) & (sym[1:] == sym[:-1]) & (sym[1:] > 0)]
        at = np.flatnonzero(same)
        lows = _range_min(prefix, move[at - 1] + 1, move[at])
        prefix = np.zeros(m, np.uint8)
        prefix[at] = np.minimum(lows, 254) + 1
        order = new
        if x <= left:
            equal = prefix >= LENGTH
            if equal.any():
                begin = np.flatnonzero(~equal)
                first = np.minimum.reduceat(rank[order], begin)
                out[order, x] = rank[order] > np.repeat(first, np.diff(np.r_[begin, m]))
    return out


def _range_min(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Minima of values[first..last], ends included."""
    out = values[last].copy()
    span = last - first + 1
    level, table = 1, values
    todo = np.flatnonzero(span > 1)
    while len(todo):
        done = span[todo] < 2 * level
        now = todo[done]
        if len(now):
            out[now] = np.minimum(table[first[now]], table[last[now] - level + 1])
        todo = todo[~done]
        if len(todo):
            table = np.minimum(table[:-level], table[level:])
            level *= 2
    return out


def _sorted_out(segments: DataFrame) -> DataFrame:
    """doc_id, start, size of runs of strings that repeat an earlier one, by the collections'
    sorted suffixes. Rows come sorted by key; a collection holds whole keys."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        rows = 0
        for batch in tidied(batches):
            kept.append(batch)
            rows += batch.num_rows
            if rows >= COLLECTION:
                table = pa.Table.from_batches(kept)
                key = table["key"].to_numpy()
                cut = int(np.searchsorted(key, key[-1]))
                if cut:
                    yield from _collections(table.slice(0, cut))
                    kept, rows = table.slice(cut).to_batches(), len(key) - cut
        if rows:
            yield from _collections(pa.Table.from_batches(kept))

    return segments.mapInArrow(work, "doc_id long, start int, size int")


def _collections(table: pa.Table) -> Iterator[pa.RecordBatch]:
    key = table["key"].to_numpy()
    _, again = np.unique(key, return_inverse=True)
    alone = np.bincount(again)[again] < 2
    table, key = table.filter(pa.array(~alone)), key[~alone]
    edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    for a, b in slices(np.diff(np.r_[edges, len(key)]).tolist(), COLLECTION):
        begin, end = int(edges[a]), int(edges[b]) if b < len(edges) else len(key)
        part = table.slice(begin, end - begin)
        doc, anchor, start, size = (part[c].to_numpy().astype(np.int64) for c in ("doc_id", "anchor", "start", "size"))
        rank = np.unique(np.stack([doc, anchor], 1), axis=0, return_inverse=True)[1].ravel()
        offset = anchor - start
        marks = repeated(key[begin:end], rank, offset, size, part["bytes"].to_pylist())
        edge = np.diff(np.pad(marks.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        row, first = np.nonzero(edge == 1)
        last = np.nonzero(edge == -1)[1]
        place = anchor[row] - int(offset.max()) + first
        yield pa.RecordBatch.from_arrays([pa.array(doc[row], pa.int64()), pa.array(place, pa.int32()), pa.array(last - first, pa.int32())], ["doc_id", "start", "size"])


def repeated_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and `ranges`, sorted (start << 32 | end) of byte ranges to remove, which may
    overlap; documents without any are left out."""
    spark = docs.sparkSession
    ensure_importable(spark)
    texts = docs.where(F.octet_length(text_col) >= LENGTH).select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    # By anchor and segment, not by anchor: a group has a row from each task at most.
    first = F.min(F.struct("doc_id", "start")).over(Window.partitionBy("h", "s"))
    rows = _find(texts).withColumn("later", F.col("s").isNull() | (F.struct("doc_id", "start") != first))
    later = F.col("later")
    rows = stored(rows.select(F.when(~later, F.col("h")).alias("h"), F.when(~later, F.col("doc_id")).alias("first_id"), *(F.when(later, F.col(c)).alias(c) for c in ("doc_id", "start", "size"))), "segments")
    anchors = stored(rows.where("h is not null").groupBy("h").agg(F.count("*").alias("segments")).where("segments > 1"), "anchors")
    hot = anchors.where(F.col("segments") > HOT)
    if anchors.count() <= TABLE_IDS:
        left = _gather(texts, _by_table(*(spark.sparkContext.broadcast(_bit_table(x)) for x in (anchors, hot))))
    else:
        wanted = rows.where("h is not null").join(anchors, "h").select(F.col("first_id").alias("doc_id"), "h", (F.col("segments") > HOT).alias("hot")).distinct()
        lists = wanted.groupBy("doc_id").agg(F.collect_list(F.when(~F.col("hot"), F.col("h"))).alias("mixed"), F.collect_list(F.when(F.col("hot"), F.col("h"))).alias("hot"))
        lists = lists.select("doc_id", F.concat("mixed", "hot").alias("mixed"), "hot")
        left = _gather(texts.join(lists, "doc_id").select("doc_id", "text", "mixed", "hot"), _by_list)
    left = stored(left, "left")
    key = Window.partitionBy("key", "s").orderBy("doc_id", "start")
    strings = left.where("kind = 'string'").withColumn("nth", F.row_number().over(key)).where("nth > 1")
    # Equal segments of several tasks were settled above: one of each is enough.
    segments = left.where("kind = 'segment'").repartition(shuffle_width(spark), "key").withColumn("nth", F.row_number().over(key)).where("nth = 1")
    segments = segments.select("key", "doc_id", "anchor", "start", "size", "bytes").sortWithinPartitions("key")
    ranges = rows.where("doc_id is not null").select("doc_id", "start", "size")
    for more in (left.where("kind = 'known'"), strings, _sorted_out(segments)):
        ranges = ranges.unionByName(more.select("doc_id", "start", "size"))
    packed = F.shiftleft(F.col("start").cast("long"), 32) + F.col("start") + F.col("size") + F.lit(LENGTH - 1)
    return ranges.select("doc_id", packed.alias("range")).groupBy("doc_id").agg(F.sort_array(F.collect_list("range")).alias("ranges"))


def _runs(ranges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of sorted, maybe overlapping or touching ranges."""
    start, end = ranges >> 32, ranges & 0xFFFFFFFF
    reach = np.maximum.accumulate(end)
    fresh = np.r_[True, start[1:] > reach[:-1]]
    begin = np.flatnonzero(fresh)
    return start[begin], np.maximum.reduceat(end, begin)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, and `kept`, the bytes that stay.

    A byte goes if a string of LENGTH bytes covers it that also starts earlier: in a smaller
    doc_id, or earlier in the same document. All strings are judged on the input. Null texts
    are empty; texts of fewer than LENGTH bytes stay. Rows that share a doc_id are versions
    of one document: equal places of them don't repeat each other, and ranges found in one
    go from all. A null doc_id counts as the smallest. Other columns are not read.
    """
    ensure_importable(docs.sparkSession)
    ranges = repeated_ranges(docs, id_col, text_col).select(F.col("doc_id").alias("own_id"), "ranges")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    both = texts.join(ranges, F.coalesce("doc_id", F.lit(-(2**63))) == F.col("own_id"), "left").select("doc_id", "text", "ranges")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidied(batches):
            held = batch.column(2)
            flat, at = held.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(held.fill_null([]).value_lengths().to_numpy(zero_copy_only=False))]
            rows = []
            for i, text in enumerate(batch.column(1).to_pylist()):
                text = text or b""
                if at[i] == at[i + 1]:
                    rows.append((len(text), 0, 0, text))
                    continue
                start, end = _runs(flat[at[i] : at[i + 1]])
                start, end = start[start < len(text)], np.minimum(end[start < len(text)], len(text))
                kept = b"".join([text[x:y] for x, y in zip([0, *end.tolist()], [*start.tolist(), len(text)], strict=True)])
                rows.append((len(text), len(text) - len(kept), len(start), kept))
            n, removed, spans, kept = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return both.mapInArrow(work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, and kept_sha256 of the bytes that stay; one row for each
    row of docs, nulls, repeated rows and empty tables as remove_repeats has them."""
    out = remove_repeats(docs, id_col, text_col)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[tuple[int, bytes]]) -> list[tuple[int, int, int, int, str]]:
    """The same rows by a dictionary of all strings, for tests."""
    texts = sorted(texts)
    seen: set[bytes] = set()
    out = []
    for doc_id, text in texts:
        gone = np.zeros(len(text) + 1, np.int64)
        for i in range(len(text) - LENGTH + 1):
            piece = text[i : i + LENGTH]
            if piece in seen:
                gone[i] += 1
                gone[i + LENGTH] -= 1
            seen.add(piece)
        mask = np.cumsum(gone)[:-1] > 0
        kept = bytes(np.frombuffer(text, np.uint8)[~mask])
        spans = int((np.diff(np.r_[0, mask.astype(np.int8)]) == 1).sum())
        out.append((doc_id, len(text), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out
