"""Embedding near-dedup with a pivot-permutation index.

Every vector is described by the PREFIX reference points (pivots) that are nearest to it, in
order. Inverted lists, one for each pair of label and pivot, bring together the vectors
that share a pivot; all pairs of a list are compared by cosine in double precision, and a
pair counts in the list of the first pivot that it shares.

No two pivots are near copies of each other, so a dense group of vectors holds few of them and
its members share these. A vector with a pivot close by is also in the lists of all pivots
that a linked vector may have as its nearest: among such vectors no link is missed.

Equal vectors are one class before anything is listed. Long lists are dealt out in blocks,
by which a list is compared block against block, so that no task holds a whole list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaview.llm.components import components
from deltaview.llm.runtime import ensure_importable, stored

#: Pivots are vectors of the table, at most so many: the square root of the number of classes times PER_ROOT.
MAX_PIVOTS, PER_ROOT = 4_096, 2
PREFIX = 8
#: Pivots have a cosine below APART; a vector whose nearest pivot has CLOSE or more is in the lists of all that a link may lead to.
APART, CLOSE = 0.7, 0.9
#: Vectors of a list that one block holds.
BLOCK = 2_000


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(1, keepdims=True)  # first by the largest component: no square overflows or vanishes
    x = x / scale
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _apart(x: np.ndarray, most: float = APART) -> np.ndarray:
    """The unit vectors of x, in their order, without those of a cosine of `most` or more to one that is kept."""
    kept = x[:0]
    for part in np.array_split(x, max(1, -(-len(x) // 256))):
        part = part[(part @ kept.T < most).all(1)]
        near = part @ part.T >= most
        some: list[int] = []
        for i in range(len(part)):
            if not near[i, some].any():
                some.append(i)
        kept = np.concatenate([kept, part[some]])
    return kept


def _permutations(vectors: DataFrame, pivots, prefix: int, least: float) -> DataFrame:
    """label, id, vector, copies, and the pivots nearest to it, nearest first.

    If x and y link (an angle of at most t) and x is nearer to its nearest pivot (at d) than y
    is to its own (at e), that pivot is at most d + t <= e + t from y: lists that reach
    e + t bring x and y together.
    """
    link = np.arccos(np.clip(least, -1, 1))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = pivots.value
        for batch in batches:
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            nearest: list = [None] * batch.num_rows
            for size in np.unique(sizes).tolist():
                own = points.get(size)
                some = np.flatnonzero(sizes == size)
                if own is None:  # no pivot of this length was drawn: all of them share one list
                    for i in some:
                        nearest[i] = [0]
                    continue
                for part in np.array_split(some, max(1, len(some) // 1_000)):
                    near = _unit(_matrix(batch.column(2).take(pa.array(part)))) @ own.T
                    top = np.argsort(-near, axis=1, kind="stable")
                    best = near.max(1)
                    reach = np.cos(np.minimum(np.pi, np.arccos(np.clip(best, -1, 1)) + link)) - 1e-9
                    lists = np.where(best >= CLOSE, np.maximum(prefix, (near >= reach[:, None]).sum(1)), prefix)
                    for i, p, n in zip(part, top, lists.tolist(), strict=True):
                        nearest[i] = p[:n]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(nearest, pa.list_(pa.int32()))], ["label", "id", "vector", "copies", "mark", "nearest"])

    return vectors.select("label", "id", "vector", "copies", "mark").mapInArrow(work, "label long, id long, vector array<double>, copies long, mark long, nearest array<int>")


def _linked(key: tuple, batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Of each class that is linked within a cell (a block with itself, or with another one):
    a, mark: the class; b: the smallest id that the cell's links lead to; n: how many vectors it is linked with.
    Pairs stay in the cell; a group of n near copies gives n rows."""
    table = pa.Table.from_batches(list(batches)).combine_chunks()
    pivot, low, high = key[1].as_py(), key[2].as_py(), key[3].as_py()
    found = []
    sizes = np.array([len(v) for v in table["vector"].to_pylist()])
    for size in np.unique(sizes).tolist():
        own = table.take(pa.array(np.flatnonzero(sizes == size))).combine_chunks()
        order = np.argsort(own["id"].to_numpy(), kind="stable")
        own = own.take(pa.array(order)).combine_chunks()
        ids, marks, block, copies = (own[c].to_numpy() for c in ("id", "mark", "block", "copies"))
        nearest = own["nearest"].to_pylist()
        width = max(len(p) for p in nearest)
        lists = np.array([p + [-1 - i] * (width - len(p)) for i, p in enumerate(nearest)])
        vectors = _unit(_matrix(own["vector"].combine_chunks()))
        codes, inverse = np.unique(lists, return_inverse=True)
        member = np.zeros((len(ids), len(codes)), np.float32)
        member[np.arange(len(ids))[:, None], inverse.reshape(lists.shape)] = 1
        before = member[:, (codes >= 0) & (codes < pivot)]
        left = np.flatnonzero(block == low)
        right = np.flatnonzero(block == high)
        n = np.zeros(len(ids), np.int64)
        root = np.arange(len(ids))
        for some in np.array_split(left, max(1, len(left) // 500)):
            cosine = vectors[some] @ vectors[right].T
            ok = cosine >= least
            i, j = np.nonzero(np.abs(cosine - least) < 1e-9)  # these may differ by their sums' order
            ok[i, j] = np.einsum("ij,ij->i", vectors[some[i]], vectors[right[j]]) >= least
            if low == high:
                ok &= some[:, None] < right
            rows, columns = np.flatnonzero(ok.any(1)), np.flatnonzero(ok.any(0))
            i, j, ok = some[rows], right[columns], ok[np.ix_(rows, columns)]
            ok &= before[i] @ before[j].T == 0  # else the pair belongs to the list of an earlier pivot
            n[i] += ok @ copies[j]
            n[j] += copies[i] @ ok
            while ok.any():  # rows are in order of their ids: the smallest place is the smallest id
                now = root.copy()
                for side, lowest in ((i, np.where(ok, root[j], len(ids)).min(1)), (j, np.where(ok, root[i][:, None], len(ids)).min(0))):
                    lowest = np.minimum(root[side], lowest)
                    np.minimum.at(now, root[side], lowest)
                    np.minimum.at(now, side, lowest)
                now = now[now]
                if (now == root).all():
                    break
                root = now
        some = np.flatnonzero(n)
        found.append(np.stack([ids[some], marks[some], ids[root[some]], n[some]], 1))
    out = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(out[:, i], pa.int64()) for i in range(4)], ["a", "mark", "b", "n"])


def near_duplicates(rows: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", prefix: int = PREFIX) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors of equal, non-null labels link at a cosine of at least threshold (never below
    it; some links may be missed, see README for the measured recall). n_links counts the
    other vectors linked directly, copies included; component_id is the smallest vec_id
    reachable by links; kept marks it. Vectors that are null, empty, zero or hold null or
    non-finite components, and those of a null label or vec_id, link with nothing. Vectors
    of different lengths never link. Repeated rows count as copies. Rows of one vec_id and
    different vectors have links of their own and one component. An empty table gives none.
    Other columns are not read.
    """
    spark = rows.sparkSession
    ensure_importable(spark)
    base = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"), F.col(label_col).cast("long").alias("label"))
    sound = F.expr("vector is not null and size(vector) > 0 and forall(vector, x -> coalesce(not isnan(x) and abs(x) < double('Infinity'), false)) and exists(vector, x -> x <> 0)")
    fit = sound & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    # -0.0 and 0.0 are equal: adding 0.0 makes copies of such vectors one class.
    good = base.where(fit).withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))
    classes = stored(good.groupBy("label", "vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")).withColumn("mark", F.xxhash64("label", "vector")), "vector-classes")
    n = classes.count()
    wanted = max(1, min(MAX_PIVOTS, int(PER_ROOT * n**0.5)))
    share = min(1.0, 1.5 * wanted / max(1, n))
    drawn = classes.where(F.pmod(F.xxhash64("id", "label"), F.lit(1 << 30)) < int(share * (1 << 30))).orderBy(F.xxhash64("id", "label"), "id").limit(wanted).select("vector").collect()
    points: dict[int, list] = {}
    for r in drawn:
        points.setdefault(len(r["vector"]), []).append(r["vector"])
    pivots = spark.sparkContext.broadcast({size: _apart(_unit(np.array(v))) for size, v in points.items()})
    described = stored(_permutations(classes, pivots, prefix, threshold), "permutations")
    listed = described.select("label", "id", "vector", "copies", "mark", "nearest", F.explode("nearest").alias("pivot"))
    lengths = listed.groupBy("label", "pivot").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    # A list of b blocks has b (b + 1) / 2 cells; a vector goes to the cells of its block.
    dealt = listed.join(lengths, ["label", "pivot"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cells = cells.select("label", "pivot", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "id", "vector", "copies", "mark", "nearest")

    def work(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _linked(key, batches, threshold)

    links = stored(cells.groupBy("label", "pivot", "low", "high").applyInArrow(work, "a long, mark long, b long, n long"), "vector-links")
    groups = components(links.select("a", "b"))
    others = links.groupBy("a", "mark").agg(F.sum("n").alias("others"))
    by_class = classes.join(others.toDF("id", "mark", "others"), ["id", "mark"], "left").join(groups, "id", "left")
    by_class = by_class.select("label", "vector", F.col("copies") - 1 + F.coalesce("others", F.lit(0)), F.coalesce("component", "id")).toDF("label", "vector", "n_links", "component_id")
    member = good.select("vec_id", "label", "vector").join(by_class, ["label", "vector"])
    alone = base.where(~F.coalesce(fit, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = member.select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
