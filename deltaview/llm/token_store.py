"""Token-id files: each document compressed for itself against one shared dictionary.

A shard is one byte string, little-endian:

    8 bytes   magic "DVTIDS01"
    u32       bytes per id in a frame (2 where the vocabulary allows, else 4)
    u32       number of documents n
    32 bytes  SHA-256 of the dictionary
    n x i64   doc_id, ascending
    (n+1) x u64  offsets of the frames, counted from the end of this index
    n x u32   number of ids
    frames    one zstandard frame a document, made with the dictionary

so one short document is read with one seek and one small decompression. Shards and the
dictionary are written through Spark, as binary columns of Parquet files: any file system
that Spark writes will do, and executors need no folder of their own.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deltaview.llm.bytelevel import byte_letters, read_spec, split_heads, whole
from deltaview.llm.runtime import ensure_importable, held, shared_dir, shuffle_width, slices, tidied

MAGIC = b"DVTIDS01"
HEAD = struct.Struct("<8sII32s")
SHARD_BYTES = 4_000_000
BLOCK_CHARS = 4_000_000
#: Distinct cuts a worker keeps between blocks; those beyond it are encoded anew in each block.
CACHE = 900_000
#: The dictionary is trained on at most so many documents, of at most so many characters each.
SAMPLE_DOCS, SAMPLE_CHARS, DICT_BYTES = 200, 20_000, 32_768

#: Cuts that are a run of Latin letters: a line feed before it or none, and punctuation behind it or none.
_WORD = re.compile(r"(\n?)([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?)\"]*)")


class Encoder:
    """The tokenizers library over a byte-level BPE file.

    Its pre-tokenizer takes longer than its BPE model. A run of Latin letters behind a space, or
    behind a text's cut, is one pre-token whatever surrounds it, as is the punctuation after
    it: these go to the library's model at once, everything else through the whole library.
    """

    def __init__(self, path: str, width: int = 4):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        read_spec(path)
        self.library = Tokenizer.from_file(path)
        self.kind = np.dtype(f"<u{width}")
        self.code = {2: "H", 4: "I"}[width]
        self.letters = byte_letters()

    def whole(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, little-endian, in the given width."""
        return [np.array(e.ids, self.kind).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def cuts(self, cuts: list[str]) -> list[bytes]:
        """Ids of cuts (see split_heads), each distinct word and each distinct end of one encoded once."""
        found = [m and m.groups() for m in map(_WORD.fullmatch, cuts)]
        pre_tokens = {x for f in found if f for x in (f[0], f[1] if f[0] else " " + f[1], f[2])}
        tokenize, letters, code = self.library.model.tokenize, self.letters, self.code
        known = {x: array(code, [t.id for t in tokenize(x.encode().decode("latin-1").translate(letters))]).tobytes() for x in pre_tokens}
        odd = iter(self.whole(whole([c for c, f in zip(cuts, found, strict=True) if not f])))
        return [known[f[0]] + known[f[1] if f[0] else " " + f[1]] + known[f[2]] if f else next(odd) for f in found]


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, width: int = 4) -> Encoder:
    if (path, width) not in _ENCODERS:
        _ENCODERS[path, width] = Encoder(path, width)
    return _ENCODERS[path, width]


def _block(texts: list[str], own: Encoder, cache: dict[str, bytes]) -> Iterator[bytes]:
    heads, bodies = split_heads(texts)
    lists = pc.split_pattern(pa.array(bodies, pa.string()), " ")
    cuts = lists.flatten().dictionary_encode()
    distinct = cuts.dictionary.to_pylist()
    found = list(map(cache.get, distinct))
    new = [i for i, ids in enumerate(found) if ids is None]
    for some, few in slices([1] * len(new), 50_000):
        names = [distinct[i] for i in new[some:few]]
        encoded = own.cuts(names)
        for i, ids in zip(new[some:few], encoded, strict=True):
            found[i] = ids
        if len(cache) + len(names) <= CACHE:
            cache.update(zip(names, encoded, strict=True))
    size = np.fromiter(map(len, found), np.int64, len(found)) // own.kind.itemsize
    flat, begin = np.frombuffer(b"".join(found), own.kind), np.cumsum(size) - size
    index = cuts.indices.to_numpy()
    many = size[index]
    ends = np.r_[0, np.cumsum(many)]
    ids = flat[np.repeat(begin[index] - ends[:-1], many) + np.arange(ends[-1])]
    bounds = ends[lists.offsets.to_numpy()].tolist()
    place = 0
    for head, body in zip(own.whole(heads), bodies, strict=True):
        yield head + ids[bounds[place] : bounds[place + 1]].tobytes() if body is not None else head
        place += 1


def encode_all(texts: list[str], path: str, width: int = 4) -> Iterator[bytes]:
    """Ids of each text, little-endian, `width` bytes each. The library encodes every distinct cut
    of a block once (see split_heads: no token reaches across); texts that can't be cut, whole.
    Cuts are told apart and put together again in arrays, not one by one."""
    own = encoder(path, width)
    cache: dict[str, bytes] = held(f"token ids {path} {width}", dict)
    for begin, end in slices([len(t) for t in texts], BLOCK_CHARS):
        yield from _block(texts[begin:end], own, cache)


def _codec_dict(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def train_dictionary(arrays: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A dictionary for such serialized arrays; empty where they are too few to train one."""
    samples = [a for a in arrays if len(a) >= 8]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def narrow(ids: bytes, width: int) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


class ShardWriter:
    """Collects documents in ascending order into one shard."""

    def __init__(self, dictionary: bytes, width: int):
        self.width, self.digest = width, hashlib.sha256(dictionary).digest()
        self.codec = zstandard.ZstdCompressor(level=1, dict_data=_codec_dict(dictionary), write_checksum=False, write_content_size=True)
        self.clear()

    def clear(self) -> None:
        self.doc_ids: list[int] = []
        self.counts: list[int] = []
        self.frames: list[bytes] = []
        self.size = 0

    def add(self, doc_id: int, ids: bytes) -> None:
        """A document by its ids as little-endian u32."""
        self.add_narrow(doc_id, narrow(ids, self.width))

    def add_narrow(self, doc_id: int, ids: bytes) -> None:
        """A document by its ids in the shard's width."""
        self.doc_ids.append(doc_id)
        self.counts.append(len(ids) // self.width)
        self.frames.append(self.codec.compress(ids))
        self.size += len(self.frames[-1])

    def close(self) -> bytes:
        offsets = np.zeros(len(self.frames) + 1, "<u8")
        offsets[1:] = np.cumsum([len(f) for f in self.frames])
        data = b"".join([HEAD.pack(MAGIC, self.width, len(self.frames), self.digest), np.array(self.doc_ids, "<i8").tobytes(), offsets.tobytes(), np.array(self.counts, "<u4").tobytes(), *self.frames])
        self.clear()
        return data


class Shard:
    """A shard's documents, by place or by id, without reading the others."""

    def __init__(self, data: bytes, dictionary: bytes):
        magic, self.width, n, digest = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token-id shard")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError("the shard was written with another dictionary")
        at = HEAD.size
        self.doc_ids = np.frombuffer(data, "<i8", n, at)
        self.offsets = np.frombuffer(data, "<u8", n + 1, at + 8 * n) + np.uint64(at + 8 * n + 8 * (n + 1) + 4 * n)
        self.counts = np.frombuffer(data, "<u4", n, at + 8 * n + 8 * (n + 1))
        self.data = memoryview(data)
        self.codec = zstandard.ZstdDecompressor(dict_data=_codec_dict(dictionary))

    def __len__(self) -> int:
        return len(self.doc_ids)

    def ids(self, place: int) -> np.ndarray:
        frame = self.data[int(self.offsets[place]) : int(self.offsets[place + 1])]
        out = np.frombuffer(self.codec.decompress(frame), "<u2" if self.width == 2 else "<u4").astype("<u4")
        if len(out) != self.counts[place]:
            raise ValueError(f"document {self.doc_ids[place]} is damaged")
        return out

    def find(self, doc_id: int) -> np.ndarray | None:
        place = int(np.searchsorted(self.doc_ids, doc_id))
        return self.ids(place) if place < len(self) and self.doc_ids[place] == doc_id else None


@dataclass(frozen=True)
class TokenFiles:
    """Where a written collection lies."""

    path: str

    def dictionary(self, spark: SparkSession) -> bytes:
        return bytes(spark.read.parquet(f"{self.path}/dictionary").head()["data"])

    def shards(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/shards")


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> TokenFiles:
    """Encode every whole text, append end_id, and write shards in ascending doc_id order.

    Null and empty texts hold the end id alone. Rows of one doc_id follow each other in the
    order of a hash of their text. Rows whose doc_id is null come first, under id -2^63. An
    empty table gives a collection without shards. Other columns are not read. Files that
    split_heads doesn't hold for are refused. The dictionary is trained on SAMPLE_DOCS documents.
    """
    spark = docs.sparkSession
    ensure_importable(spark)
    out = TokenFiles(path or f"{shared_dir(spark)}/deltaview-tokens-{uuid.uuid4().hex}")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Hashes alone are ranked, so that the driver gets SAMPLE_DOCS texts in all, not from every task.
    fitting = rows.where(F.length("text").between(1, SAMPLE_CHARS)).withColumn("h", F.xxhash64("doc_id", "text"))
    last = fitting.select("h").orderBy("h").limit(SAMPLE_DOCS).agg(F.max("h")).head()[0]
    sample = [] if last is None else fitting.where(F.col("h") <= last).limit(SAMPLE_DOCS).collect()
    sample.sort(key=lambda r: (r["h"], r["doc_id"], r["text"]))
    width = 2 if max(encoder(tokenizer_path).library.get_vocab_size(with_added_tokens=True), end_id + 1) <= 65_536 else 4
    dictionary = train_dictionary(encoder(tokenizer_path, width).whole([r["text"] for r in sample]))
    spark.createDataFrame([(hashlib.sha256(dictionary).hexdigest(), bytearray(dictionary))], "sha256 string, data binary").write.mode("overwrite").parquet(f"{out.path}/dictionary")
    end = end_id.to_bytes(width, "little")
    shared = spark.sparkContext.broadcast(dictionary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, part, serial = ShardWriter(shared.value, width), TaskContext.get().partitionId(), 0

        def flushed() -> pa.RecordBatch:
            n, data = sum(writer.counts), writer.close()
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([serial], pa.int64()), pa.array([n], pa.int64()), pa.array([data], pa.binary())], ["part", "serial", "n_tokens", "data"])

        for batch in tidied(batches):
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode_all(batch.column(1).to_pylist(), tokenizer_path, width), strict=True):
                writer.add_narrow(doc_id, ids + end)
                if writer.size >= SHARD_BYTES:
                    yield flushed()
                    serial += 1
        if writer.frames:
            yield flushed()

    order = ["doc_id", F.xxhash64("text")]
    ranged = rows.repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order)
    ranged.mapInArrow(work, "part int, serial long, n_tokens long, data binary").write.mode("overwrite").option("compression", "none").parquet(f"{out.path}/shards")
    return out


def read_tokens(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """Per document of the files, in their order: doc_id, start (ids before it), n_tokens, ids_crc32.

    Each row written gives a row: repeated ones as often as they were written, those of null or
    empty texts with the end id alone, those of a null doc_id under -2^63. No shards: no rows.
    """
    ensure_importable(spark)
    shared = spark.sparkContext.broadcast(files.dictionary(spark))
    shards = files.shards(spark)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidied(batches):
            for part, serial, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                shard = Shard(data, shared.value)
                crc = [zlib.crc32(shard.ids(i).tobytes()) for i in range(len(shard))]
                counts = shard.counts.astype(np.int64)
                n = len(shard)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int32()), pa.array([serial] * n, pa.int64()), pa.array(shard.doc_ids), pa.array(np.cumsum(counts) - counts), pa.array(counts), pa.array(crc, pa.int64())],
                    ["part", "serial", "doc_id", "within", "n_tokens", "ids_crc32"],
                )

    docs = shards.select("part", "serial", "data").mapInArrow(work, "part int, serial long, doc_id long, within long, n_tokens long, ids_crc32 long")
    # Two prefix sums, over the shards of each part and over the parts: neither sorts all shards in one task.
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before_part"))
    begins = shards.select("part", "serial", (F.sum("n_tokens").over(Window.partitionBy("part").orderBy("serial")) - F.col("n_tokens")).alias("before_shard"))
    begins = begins.join(parts, "part")
    return docs.join(begins, ["part", "serial"]).select("doc_id", (F.col("before_part") + F.col("before_shard") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """Per document of the files: doc_id and its ids, the end id included; repeated rows, null and
    empty texts and null ids as read_tokens has them."""
    ensure_importable(spark)
    shared = spark.sparkContext.broadcast(files.dictionary(spark))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidied(batches):
            for data in batch.column(0).to_pylist():
                shard = Shard(data, shared.value)
                for begin, end in slices(shard.counts.tolist(), 4_000_000):
                    yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids[begin:end]), pa.array([shard.ids(i).astype(np.int64) for i in range(begin, end)], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return files.shards(spark).select("data").mapInArrow(work, "doc_id long, ids array<long>")
