"""N-gram Jaccard join by prefix filtering, and the groups that its links make.

1. Counts of all shingles of all documents go into a table of fixed size; (count, hash) is
   one total order on shingles, rare ones first.
2. A document keeps the first |X| - ceil(t |X|) + 1 shingles in that order: two sets of
   similarity t or more share one of them. Copies, which have equal sets, keep one
   representative; groups of copies are never joined with each other.
3. Prefix shingles are joined: two sets of one shingle are a candidate if their sizes
   (length filter), the places of the shingle in both (positional filter) and the parity
   sketches of both (suffix filter: the bits in which they differ are a lower bound of the
   sets' Hamming distance) leave room for the overlap that t asks for.
4. Every candidate is verified once, on its whole sets.

Candidates come in two rounds. The first takes the sets of a shingle in order of their
size and tries near neighbours, a number linear in the rows, which gathers groups of near
copies. The second tries all candidates whose ends are not in one group by then and that
the first didn't try. So no link between groups is lost, no pair is verified twice, and a
large group of near copies is not joined with itself.

No task holds a whole shingle, text or group: in the first round the sets of a frequent
shingle are dealt into parts, other ones for each shingle; in the second they are compared
block by block; pairs to verify are dealt into cells of bounded numbers of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deltaview.llm import shingles
from deltaview.llm.components import components
from deltaview.llm.runtime import ensure_importable, forget, pieces, slices, stored

#: Slots of the table of counts, and bits of the coarse parity sketch. The fine one has as many
#: as the set has shingles or more, as a power of two times these.
COUNT_BITS, SKETCH_BITS = 20, 512
_ROWS = 256
#: The first round tries the sets that stand so far apart among those of a shingle.
LAGS = (1, 2, 3, 5, 8, 13)
#: Pairs that one task verifies together, about.
CELL_PAIRS = 10_000
#: Sets of one shingle that one task orders or joins together, about.
TOKEN_SETS = 2_000
#: Ids that a bit table is made for, and rows of a small table that is sent to all tasks, at most.
TABLE_IDS, SMALL = 16_000_000, 100_000


def _count_sketch(texts: DataFrame, k: int) -> np.ndarray:
    """How many documents hold a shingle of each slot, from all documents; 4 MB."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNT_BITS, np.uint32)
        for batch in pieces(batches):
            raw = [(t or "").encode() for t in batch.column(0).to_pylist()]
            for a, b in slices([len(t) for t in raw], shingles.BLOCK_BYTES):
                flat, _ = shingles.shingle_sets(raw[a:b], k)
                counts += np.bincount((flat >> shingles.U(64 - COUNT_BITS)).astype(np.int64), minlength=1 << COUNT_BITS).astype(np.uint32)
        if counts.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(_ROWS), pa.int32()), pa.array([c.tobytes() for c in np.split(counts, _ROWS)], pa.binary())], ["row", "counts"])

    def added(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << COUNT_BITS) // _ROWS, np.int64)
        for batch in batches:
            for c in batch.column(1).to_pylist():
                total += np.frombuffer(c, np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["row", "counts"])

    rows = texts.select("text").mapInArrow(partial, "row int, counts binary").groupBy("row").applyInArrow(added, "row int, counts binary").collect()
    out = np.zeros(1 << COUNT_BITS, np.int64).reshape(_ROWS, -1)
    for r in rows:
        out[r["row"]] = np.frombuffer(r["counts"], np.int64)
    return np.minimum(out.ravel(), 65_535).astype(np.uint16)


def _need(n: Column, num: int, den: int) -> Column:
    return F.ceil(n * num / den)


def _parities(flat: np.ndarray, size: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each set, `width` bits: whether an odd number of its shingles end in that bit's number."""
    begin = np.r_[0, np.cumsum(width)]
    place = np.repeat(begin[:-1], size) + (flat & np.repeat(width - 1, size).astype(shingles.U)).astype(np.int64)
    bits = np.bincount(place, minlength=begin[-1]) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64), begin // 64


def _set_rows(texts: DataFrame, counts, k: int, num: int, den: int) -> DataFrame:
    """Per document: doc_id, n (set size), a 128-bit signature of the set, its prefix and its parity sketches."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counts.value
        for batch in pieces(batches):
            raw = [(t or "").encode() for t in batch.column(1).to_pylist()]
            ids = batch.column(0)
            for a, b in slices([len(t) for t in raw], shingles.BLOCK_BYTES):
                flat, begins = shingles.shingle_sets(raw[a:b], k)
                size = np.diff(begins)
                total = np.r_[shingles.U(0), np.cumsum(shingles.mix(flat))]
                other = np.r_[shingles.U(0), np.cumsum(shingles.mix(flat ^ shingles.U(0xA5A5A5A5A5A5A5A5)))]
                wide = SKETCH_BITS << np.ceil(np.log2(np.maximum(size, SKETCH_BITS) / SKETCH_BITS)).astype(np.int64)
                (coarse, coarse_at), (fine, fine_at) = (_parities(flat, size, w) for w in (np.full(b - a, SKETCH_BITS), wide))
                common = count[(flat >> shingles.U(64 - COUNT_BITS)).astype(np.int64)]
                keep = np.where(size > 0, size + (-num * size // den) + 1, 0)
                prefix = [flat[s:e][np.argsort(common[s:e], kind="stable")[:p]] for s, e, p in zip(begins[:-1].tolist(), begins[1:].tolist(), keep.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(a, b - a),
                        pa.array(size, pa.int32()),
                        pa.array((total[begins[1:]] - total[begins[:-1]]).view(np.int64)),
                        pa.array((other[begins[1:]] - other[begins[:-1]]).view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(keep)], pa.int32()), pa.array(np.concatenate([*prefix, np.zeros(0, np.uint64)]).view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(coarse_at, pa.int32()), pa.array(coarse)),
                        pa.ListArray.from_arrays(pa.array(fine_at, pa.int32()), pa.array(fine)),
                    ],
                    ["doc_id", "n", "s1", "s2", "prefix", "sketch", "fine"],
                )

    return texts.mapInArrow(work, "doc_id long, n int, s1 long, s2 long, prefix array<long>, sketch array<long>, fine array<long>")


def _sets_of(texts: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, shingles) of the documents whose id is in ids, and of a few others.

    A bit table of up to TABLE_IDS ids, 16 bits for each (32 MB), goes to all tasks, so that
    texts are not shuffled; what it lets through besides is dropped by the join. For more ids
    than that texts and ids are shuffled by id.
    """
    n = ids.count()
    if n > TABLE_IDS:
        return _shingled(texts.select(F.col("doc_id").alias("id"), "text").join(ids, "id", "left_semi"), k)
    bits = min(28, max(16, (16 * n).bit_length()))
    slot = F.shiftrightunsigned(F.xxhash64("id"), 64 - bits)
    words = ids.select(F.shiftright(slot, 15).alias("word"), (slot % 32_768).alias("bit")).groupBy("word").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    table = np.zeros(1 << (bits - 3), np.uint8)
    for r in words:
        table[r["word"] * 4096 : (r["word"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    shared = texts.sparkSession.sparkContext.broadcast(table)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in pieces(batches):
            at = batch.column(2).to_numpy(zero_copy_only=False)
            some = np.flatnonzero((own[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
            if not len(some):
                continue
            yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(some)) for i in (0, 1)], ["id", "text"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _sets(chosen(batches), k)

    hashed = texts.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("id"), "text").select("id", "text", slot.alias("slot"))
    return hashed.mapInArrow(work, "id long, shingles array<long>")


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(id, shingles) of (id, text)."""
    for batch in pieces(batches):
        raw = [(t or "").encode() for t in batch.column(1).to_pylist()]
        for a, b in slices([len(t) for t in raw], shingles.BLOCK_BYTES):
            flat, begins = shingles.shingle_sets(raw[a:b], k)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(flat.view(np.int64)))], ["id", "shingles"])


def _shingled(texts: DataFrame, k: int) -> DataFrame:
    return texts.mapInArrow(lambda batches: _sets(batches, k), "id long, shingles array<long>")


def _differ(a: str, b: str) -> Column:
    """Bits in which two parity sketches differ."""
    terms = [F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(SKETCH_BITS // 64)]
    return sum(terms[1:], terms[0])


def _finely_differ(a: str, b: str) -> Column:
    """The same of fine sketches; the longer one is folded to the length of the other."""
    fold = f"""aggregate(sequence(1, cast(round(log2(greatest(size({a}), size({b})) / least(size({a}), size({b})))) as int) + 1), if(size({a}) > size({b}), {a}, {b}),
      (acc, i) -> if(size(acc) > least(size({a}), size({b})), zip_with(slice(acc, 1, size(acc) div 2), slice(acc, size(acc) div 2 + 1, size(acc) div 2), (x, y) -> x ^ y), acc))"""
    return F.expr(f"aggregate(zip_with({fold}, if(size({a}) > size({b}), {b}, {a}), (x, y) -> bit_count(x ^ y)), 0, (acc, x) -> acc + x)")


def _fitting(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) whose sketches leave room for the overlap."""
    held = classes.select("rep", "n", "fine")
    both = pairs.join(held.toDF("a", "n1", "f1"), "a").join(held.toDF("b", "n2", "f2"), "b")
    return both.where(_finely_differ("f1", "f2") <= F.col("n1") + F.col("n2") - 2 * _need(F.col("n1") + F.col("n2"), num, num + den)).select("a", "b")


def _room(n1: Column, p1: Column, n2: Column, p2: Column, num: int, den: int, first: bool) -> Column:
    """Length and positional filter, for n1 <= n2 and a shared shingle in places p1 and p2 from 0.

    With `first`, whether it can be the first one that two similar sets share: one of the
    shingles in both prefixes is, so no pair is lost, and few come up more than once.
    """
    most = F.least(n1 - p1, n2 - p2)
    if not first:
        most = most + F.least(p1, p2)
    return (n1 * den >= n2 * num) & (most >= _need(n1 + n2, num, num + den))


def _small(df: DataFrame) -> DataFrame:
    """df, to be sent to all tasks if it has SMALL rows at most, else joined as Spark sees fit."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def _placed(pairs: DataFrame) -> DataFrame:
    """Pairs with a cell such that a text meets most of its partners in one cell: the smallest id within two steps."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    one = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    two = both.join(one.toDF("b", "low"), "b").groupBy("a").agg(F.min("low").alias("cell"))
    return pairs.join(two, "a")


def _cells(placed: DataFrame) -> DataFrame:
    """Pairs as (cell, i, j, a, b): a cell of many pairs is split into blocks of a and of b, more of the side that has more texts."""
    counts = placed.groupBy("cell").agg((F.count("*") / CELL_PAIRS).alias("parts")).where("parts > 1")
    sides = placed.join(_small(counts), "cell").groupBy("cell").agg(F.first("parts").alias("parts"), F.approx_count_distinct("a").alias("as"), F.approx_count_distinct("b").alias("bs"))
    by_a = F.least(F.ceil(F.sqrt(F.col("parts") * F.col("as") / F.col("bs"))), F.ceil("parts")).alias("by_a")
    large = sides.select("cell", "parts", by_a).select("cell", "by_a", F.ceil(F.col("parts") / F.col("by_a")).alias("by_b"))
    block = lambda c, n: F.coalesce(F.pmod(F.xxhash64(c), F.col(n)), F.lit(0).cast("long"))
    return placed.join(_small(large), "cell", "left").select("cell", block("a", "by_a").alias("i"), block("b", "by_b").alias("j"), "a", "b")


def _verified(texts: DataFrame, pairs: DataFrame, k: int, num: int, den: int, name: str) -> DataFrame:
    """Of pairs (a, b), those whose whole sets have the similarity, as a stored table. A set is
    sent to a cell once, not once for each pair."""
    candidates = stored(pairs, f"{name}-candidates")
    dealt = stored(_placed(candidates), f"{name}-placed")
    placed = stored(_cells(dealt), f"{name}-cells")
    cell = ["cell", "i", "j"]
    wanted = placed.select(*cell, F.col("a").alias("id")).unionByName(placed.select(*cell, F.col("b").alias("id"))).distinct()
    sets = _sets_of(texts, wanted.select("id").distinct(), k).dropDuplicates(["id"])
    sent = wanted.join(sets, "id").select(*cell, "id", "shingles")

    def verify(left: pa.Table, right: pa.Table) -> pa.Table:
        held = right["shingles"].combine_chunks()
        flat = held.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        at = np.r_[0, np.cumsum(held.value_lengths().to_numpy(zero_copy_only=False))]
        place = {x: i for i, x in enumerate(right["id"].to_pylist())}
        ends = [left["a"].to_pylist(), left["b"].to_pylist()]
        keep = np.zeros(left.num_rows, bool)
        for n, (a, b) in enumerate(zip(*ends, strict=True)):
            a, b = place[a], place[b]
            x, y = flat[at[a] : at[a + 1]], flat[at[b] : at[b + 1]]
            common = len(np.intersect1d(x, y, assume_unique=True))
            keep[n] = common * den >= (len(x) + len(y) - common) * num
        return left.filter(pa.array(keep)).select(["a", "b"])

    sent = sent.toDF("cell2", "i2", "j2", "id", "shingles")
    out = stored(placed.groupBy(*cell).cogroup(sent.groupBy("cell2", "i2", "j2")).applyInArrow(verify, "a long, b long"), name)
    forget(candidates, dealt, placed)
    return out


def link(docs: DataFrame, k: int = 5, threshold: tuple[int, int] = (4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, class_id (smallest doc_id of an equal set),
    component_id (smallest doc_id reachable by links, itself included).

    Words are runs of bytes other than [\\x20\\x09-\\x0D], with A-Z lower-cased; a set holds
    the distinct k-word shingles, or the whole sequence of a text of fewer words. Null,
    empty and blank texts have the empty set, which links with nothing. Two documents link
    at |X ∩ Y| / |X ∪ Y| >= threshold, a fraction of two ints. Repeated rows are repeated in
    the result; rows that share a doc_id count as copies of one. A null doc_id has null ids.
    Shingles are compared by 64-bit hashes, sets of copies by 128 bits.
    """
    spark = docs.sparkSession
    ensure_importable(spark)
    num, den = threshold
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counts = spark.sparkContext.broadcast(_count_sketch(texts, k))
    sets = stored(_set_rows(texts, counts, k, num, den), "sets")
    linked = sets.where("n > 0 and doc_id is not null")
    classes = stored(linked.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("sketch").alias("sketch"), F.first("fine").alias("fine")), "classes")
    # Size and place in one word: fewer bytes to shuffle, and the order that the length filter wants.
    postings = classes.select("rep", "n", F.posexplode("prefix").alias("pos", "token")).select("token", "rep", (F.shiftleft(F.col("n").cast("long"), 32) + F.col("pos")).alias("np"))
    size = lambda c: F.shiftright(c, 32)
    place = lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF))
    slot = F.shiftrightunsigned("token", 64 - COUNT_BITS)
    slots = stored(postings.groupBy(slot.alias("slot")).agg(F.count("*").alias("held")), "slots")
    most = F.greatest(F.lit(TOKEN_SETS).cast("double"), slots.agg(F.coalesce(F.sum("held"), F.lit(0)) / (1 << (COUNT_BITS - 2))).scalar())
    frequent = F.broadcast(slots.select("slot", F.ceil(F.col("held") / most).alias("parts")).where("parts > 1"))  # 2^COUNT_BITS rows at most
    # Sets of a frequent shingle are dealt into parts by a hash of both, so that other shingles bring other ones together.
    dealt = postings.withColumn("slot", slot).join(frequent, "slot", "left").withColumn("part", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("token", "rep"), F.col("parts"))))
    by_token = Window.partitionBy("token", "part").orderBy("np", "rep")
    near = dealt.select("token", "part", "rep", "np", F.lag("rep").over(by_token).alias("before"), F.lead("rep").over(by_token).alias("after"))
    shared = stored(near.where("part is not null or before is not null or after is not null").select("token", "part", "rep", "np"), "shared")

    earlier = F.array(*(F.lag(F.struct(F.col("rep").alias("a"), F.col("np").alias("np0")), i).over(by_token) for i in LAGS))
    tried = shared.select("rep", "np", earlier.alias("earlier")).select("rep", "np", F.explode(F.array_compact("earlier")).alias("x")).select("rep", "np", "x.*")
    first = tried.where((F.col("a") != F.col("rep")) & _room(size("np0"), place("np0"), size("np"), place("np"), num, den, first=False))
    first = first.select(F.least("a", "rep").alias("a"), F.greatest("a", "rep").alias("b")).distinct()
    first = stored(_fitting(first, classes, num, den), "first")
    edges = _verified(texts, first, k, num, den, "edges")
    groups = components(edges)
    forget(edges)

    grouped = shared.select("token", "rep", "np").join(groups.toDF("rep", "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = grouped.groupBy("token").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.ceil(F.count("*") / TOKEN_SETS).alias("blocks")).where("c1 <> c2").select("token", "blocks")
    mixed = stored(mixed, "mixed")
    rest = stored(grouped.join(_small(mixed), "token").join(classes.select("rep", "sketch"), "rep"), "rest")
    # Block i of a frequent shingle meets the blocks from i on: a set goes to as many tasks as there are blocks.
    block = F.pmod(F.xxhash64("rep"), F.col("blocks"))
    every = lambda low, high: F.explode(F.sequence(low, high))
    left = rest.withColumn("i", block).withColumn("j", every(F.col("i"), F.col("blocks") - 1)).select("token", "i", "j", F.col("rep").alias("a"), F.col("np").alias("np1"), F.col("component").alias("g1"), F.col("sketch").alias("k1"))
    right = rest.withColumn("j", block).withColumn("i", every(F.lit(0).cast("long"), F.col("j"))).select("token", "i", "j", F.col("rep").alias("b"), F.col("np").alias("np2"), F.col("component").alias("g2"), F.col("sketch").alias("k2"))
    n1, n2 = size("np1"), size("np2")
    # _room wants the smaller set first; within a block each pair comes in both orders.
    ordered = (n1 < n2) | ((n1 == n2) & (F.col("a") < F.col("b")))
    fits = F.when(ordered, _room(n1, place("np1"), n2, place("np2"), num, den, first=True)).otherwise(_room(n2, place("np2"), n1, place("np1"), num, den, first=True))
    once = (F.col("i") < F.col("j")) | ordered
    room = fits & (_differ("k1", "k2") <= n1 + n2 - 2 * _need(n1 + n2, num, num + den))
    found = left.join(right, ["token", "i", "j"]).where((F.col("g1") != F.col("g2")) & once & room)
    found = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.greatest(n1, n2).alias("n")).distinct()
    second = stored(found.join(first, ["a", "b"], "left_anti"), "second")
    # Sets of so few shingles have no finer sketch than the one just compared.
    large = _fitting(second.where(F.col("n") > SKETCH_BITS).select("a", "b"), classes, num, den)
    more = _verified(texts, second.where(F.col("n") <= SKETCH_BITS).select("a", "b").unionByName(large), k, num, den, "more")
    forget(slots, shared, first, mixed, rest, second)
    # The first groups stand for their own links.
    groups = components(more.unionByName(groups.select(F.col("id").alias("a"), F.col("component").alias("b"))))
    forget(more)

    members = sets.select("doc_id", "n", "s1", "s2").join(classes.select("s1", "s2", "rep"), ["s1", "s2"], "left")
    out = members.join(groups.toDF("rep", "component"), "rep", "left")
    class_id = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("rep")).otherwise(F.col("doc_id"))
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component", "rep")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), class_id.alias("class_id"), component.alias("component_id"))
