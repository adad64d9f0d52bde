"""Line dedup, in DataFrame functions only.

1. Each long line becomes a row of hashes, (h1, h2, doc_id, version, pos); these are written
   once. Text is never shuffled by line.
2. Rows are counted in 2^SLOT_BITS slots of h1. A slot with more rows than a quarter of a
   partition's share may hold a very common line; there are few such slots, whatever the corpus.
3. The other rows are dealt out by range of h1, with a secondary sort by line, document from
   the last one down, and position. A window over the lines of a key streams over these sorted rows:
   the first occurrence's document keeps its lines, later ones lose them if the key has documents enough.
4. Lines of the large slots are counted by two-step aggregation and meet their key in as
   many salted parts as the slot's count asks for, so that no task gathers a common line.
5. What goes back to a document is its keep bitmap, compressed as the runs of lines that it drops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deltaview.llm.runtime import shuffle_width, stored

#: Fixed value: the white space that keys are stripped of.
BLANK = " \t\n\x0b\x0c\r"
SLOT_BITS = 16
#: Rows of a slot that are never split.
LEAST_ROWS = 1_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    """The line stripped at both ends, with A-Z lower-cased and no other letter changed."""
    bare = F.btrim(line, F.lit(BLANK))
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _UPPER.lower()))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _places(docs: DataFrame, min_chars: int) -> DataFrame:
    """Hashes of every line whose key is long enough. Rows that share a doc_id are told apart by version, a hash of the text."""
    lines = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("version"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    keys = lines.where(F.length("line") >= min_chars).withColumn("key", line_key(F.col("line"))).where(F.length("key") >= min_chars)
    return keys.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "version", "pos")


def _streamed(places: DataFrame, min_docs: int, width: int) -> DataFrame:
    """Lines to drop, by one pass over sorted ranges."""
    by = ["h1", "h2"]
    ranged = places.repartitionByRange(width, "h1").sortWithinPartitions(*by, F.col("doc_id").desc(), "pos")
    key = Window.partitionBy(*by)
    nth = ranged.withColumn("nth", F.dense_rank().over(key.orderBy(F.col("doc_id").desc())))
    return nth.withColumn("n_docs", F.max("nth").over(key)).where((F.col("n_docs") >= min_docs) & (F.col("nth") > 1)).select("doc_id", "version", "pos")


def _split(places: DataFrame, min_docs: int) -> DataFrame:
    """Lines to drop of large slots; `salts` is the number of parts that a slot's rows are split into."""
    per_doc = places.groupBy("h1", "h2", "doc_id").agg(F.first("salts").alias("salts"))
    keys = per_doc.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last"), F.first("salts").alias("salts")).where(F.col("n_docs") >= min_docs)
    salted = keys.select("h1", "h2", "last", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    dealt = places.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")))
    return dealt.join(salted, ["h1", "h2", "salt"]).where(F.col("doc_id") < F.col("last")).select("doc_id", "version", "pos")


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """For documents that lose lines: doc_id, version (xxhash64 of the text), and `dropped`: the keep
    bitmap of their lines, run-length compressed, as array<struct<start, size>> of the dropped runs in order.

    `docs` holds doc_id and text. Null and empty texts have one empty line, which stays; a null
    doc_id is no document: it doesn't count, and loses nothing. Equal rows count once.
    """
    width = shuffle_width(docs.sparkSession)
    # Written once: range partitioning reads its rows twice, and counts and parts start from them, too.
    places = stored(_places(docs, min_chars), "lines").withColumn("slot", F.shiftrightunsigned("h1", 64 - SLOT_BITS))
    counts = places.groupBy("slot").agg(F.count("*").alias("n"))
    share = F.greatest(F.lit(LEAST_ROWS).cast("double"), counts.agg(F.coalesce(F.sum("n"), F.lit(0)) / (4 * width)).scalar())
    # At most 2^SLOT_BITS rows, and at most four a partition.
    large = counts.select("slot", F.ceil(F.col("n") / share).alias("salts")).where("salts > 1")
    marked = places.join(F.broadcast(large), "slot", "left").drop("slot")
    dropped = _streamed(marked.where("salts is null").drop("salts"), min_docs, width).unionByName(_split(marked.where("salts is not null"), min_docs))
    lines = dropped.groupBy("doc_id", "version").agg(F.sort_array(F.collect_set("pos")).alias("p"))
    starts = "filter(p, (x, i) -> i = 0 or p[i - 1] <> x - 1)"
    ends = "filter(p, (x, i) -> i = size(p) - 1 or p[i + 1] <> x + 1)"
    return lines.select("doc_id", "version", F.expr(f"zip_with({starts}, {ends}, (a, b) -> named_struct('start', a, 'size', b - a + 1))").alias("dropped"))


def _applied(docs: DataFrame, min_chars: int, min_docs: int) -> tuple[DataFrame, list[Column], Column, Column]:
    """docs under names of their own beside their bitmaps; the columns of docs with the kept text; n_lines and n_dropped."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.toDF(*names.values()).withColumn("doc", F.col(names["doc_id"]).cast("long"))
    plain = plain.withColumn("version", F.xxhash64(names["text"]))
    bitmaps = keep_bitmaps(plain.select(F.col("doc").alias("doc_id"), F.col(names["text"]).alias("text")), min_chars, min_docs)
    both = plain.join(bitmaps.toDF("doc", "version", "dropped"), ["doc", "version"], "left").withColumn("lines", _lines(F.col(names["text"])))
    kept = F.expr("""array_join(flatten(transform(sequence(0, size(dropped)), i -> slice(lines, coalesce(get(dropped, i - 1).start + get(dropped, i - 1).size, 0) + 1,
      coalesce(get(dropped, i).start, size(lines)) - coalesce(get(dropped, i - 1).start + get(dropped, i - 1).size, 0)))), '\\n')""")
    text = F.when(F.col("dropped").isNull(), F.col(names["text"])).otherwise(kept)
    columns = [(text if c == "text" else F.col(own)).alias(c) for c, own in names.items()]
    return both, columns, F.size("lines").cast("long"), F.coalesce(F.expr("aggregate(dropped, 0, (a, x) -> a + x.size)"), F.lit(0)).cast("long")


def cleaned(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """The columns of docs, `text` less its dropped lines (see dedup_lines)."""
    both, columns, _, _ = _applied(docs, min_chars, min_docs)
    return both.select(*columns)


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """All columns of docs with `text` less its dropped lines, then n_lines and n_dropped, which
    stand for columns of that name in docs. Other columns may have any name.

    A line's key is the line stripped of [\\x20\\x09-\\x0D] with A-Z lower-cased. Keys of
    min_chars code points or more in min_docs documents or more lose all their lines except
    in the largest doc_id that has the key, where all stay. Null and empty texts are one
    empty line and stay as they are; repeated rows of a doc_id count as one document, each with its
    own lines; rows without doc_id are no document and stay as they are. Lines without such
    a key always stay, and texts of any length are split whole. No documents: no rows.
    """
    both, columns, n_lines, n_dropped = _applied(docs, min_chars, min_docs)
    columns = [x for c, x in zip(docs.columns, columns, strict=True) if c not in ("n_lines", "n_dropped")]
    return both.select(*columns, n_lines.alias("n_lines"), n_dropped.alias("n_dropped"))


def digest(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """doc_id, n_lines (before dropping), n_dropped, kept_sha256 of the kept text (null: empty);
    one row for each row of docs, see dedup_lines."""
    out = dedup_lines(docs.select("doc_id", "text"), min_chars, min_docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("kept_sha256"))
