"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A model's pieces are read from its protobuf file. Text is cut where no piece can reach
across (before a space that follows another character); every distinct cut of a block is
merged once, all together: flat numpy symbol arrays, the lowest pair rank of each cut,
its leftmost merges at once, compaction until no pair remains. Cuts that were merged
before come from a bounded cache.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaview.llm import bpe
from deltaview.llm.runtime import ensure_importable, held, pieces, slices

SPACE = "▁"
#: Symbols from here on stand for a code point that is no piece.
FOREIGN = 1 << 24
#: Distinct cuts a worker keeps between blocks; those beyond it are merged anew in each block.
CACHE = 150_000
BLOCK_CHARS = 1_000_000


def _varint(data: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[i]
        i += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, i


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    i = 0
    while i < len(data):
        key, i = _varint(data, i)
        kind = key & 7
        if kind == 0:
            value, i = _varint(data, i)
        elif kind == 2:
            size, i = _varint(data, i)
            value, i = data[i : i + size], i + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, i = data[i : i + size], i + size
        else:
            raise ValueError(f"wire type {kind}")
        yield key >> 3, value


class Model:
    """A BPE model with byte fallback, a dummy prefix and no normalisation."""

    NORMAL, CONTROL, BYTE = 1, 3, 6

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        pieces: list[tuple[str, float, int]] = []
        for field, value in _fields(data):
            if field == 1:
                own = dict(_fields(value))
                score = float(np.frombuffer(own.get(2, b"\0\0\0\0"), "<f4")[0])
                pieces.append((own[1].decode(), score, own.get(3, 1)))
            elif field == 2 and dict(_fields(value)).get(3) != 2:
                raise ValueError("not a BPE model")
            elif field == 3:
                own = dict(_fields(value))
                if own.get(1, b"identity") != b"identity" or own.get(4, 1) != 0 or own.get(3, 1) != 1:
                    raise ValueError("only models with the identity normaliser, a dummy prefix and all white space are read")
        self.ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == self.NORMAL}
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.ids):
            raise ValueError("a piece reaches across words")
        self.bytes_ids = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == self.BYTE}
        if len(self.bytes_ids) != 256:
            raise ValueError("only models with byte fallback are read")
        self.surface = [
            bytes([int(p[3:5], 16)]) if kind == self.BYTE else b"" if kind == self.CONTROL else p.replace(SPACE, " ").encode()
            for p, _, kind in pieces
        ]
        scores = {p: s for p, s, kind in pieces if kind == self.NORMAL}
        rank_of = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        # A piece that no single character or shorter piece makes up is never merged.
        rows = [
            (self.ids[p[:k]] if p[:k] in self.ids else FOREIGN + ord(p[0]), self.ids[p[k:]] if p[k:] in self.ids else FOREIGN + ord(p[-1]), rank_of[s], self.ids[p])
            for p, s in scores.items()
            for k in range(1, len(p))
            if (p[:k] in self.ids or k == 1) and (p[k:] in self.ids or k == len(p) - 1)
        ]
        self.table = bpe.PairTable(*(np.array(c, np.int64) for c in zip(*rows, strict=True)))
        self._code = np.arange(0x110000, dtype=np.int32) + FOREIGN
        for p, i in self.ids.items():
            if len(p) == 1:
                self._code[ord(p)] = i

    def pieces_of(self, cuts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of every cut (its spaces as SPACE), flat, and their counts."""
        points = np.frombuffer("".join(cuts).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols, counts = bpe.merge(self._code[points], np.array([len(c) for c in cuts], np.int64), self.table, monotone=False)
        foreign = symbols >= FOREIGN
        if foreign.any():
            width = np.ones(len(symbols), np.int64)
            raw = [chr(s - FOREIGN).encode() for s in symbols[foreign].tolist()]
            width[foreign] = [len(r) for r in raw]
            owner = np.repeat(np.arange(len(counts)), counts)
            counts = np.bincount(owner, weights=width, minlength=len(counts)).astype(np.int64)
            out = np.repeat(symbols, width)
            out[np.repeat(foreign, width)] = [self.bytes_ids[b] for r in raw for b in r]
            symbols = out
        return symbols, counts


_CUT = re.compile(" *[^ \n]+|\n[^ \n]*| +")
_MODELS: dict[str, Model] = {}


def cuts_of(text: str) -> list[str]:
    """The text behind its dummy prefix, cut before each line feed and before each space that
    follows another character; the one leading space of cuts other than line feeds is left out."""
    if not text:
        return []
    text = text.replace(SPACE, " ")
    if "  " in text or text[0] == " ":
        return [c if c[0] == "\n" else c[1:] for c in _CUT.findall(" " + text)]
    return text.replace("\n", " \n").split(" ")


def model(path: str) -> Model:
    if path not in _MODELS:
        _MODELS[path] = Model(path)
    return _MODELS[path]


def _fill(cache: dict[str, tuple[int, str, bytes]], m: Model, cuts: Iterable[str]) -> None:
    cuts = list(cuts)
    ids, counts = m.pieces_of([c if c[:1] == "\n" else SPACE + c.replace(" ", SPACE) for c in cuts])
    ids, ends, begin, surface = ids.tolist(), np.cumsum(counts).tolist(), 0, m.surface
    for cut, end in zip(cuts, ends, strict=True):
        own = ids[begin:end]
        cache[cut] = (end - begin, ",".join(map(str, own)), b"".join([surface[i] for i in own]))
        begin = end


def encode_all(texts: list[str], path: str) -> Iterator[tuple[int, str, bytes]]:
    """For each text: number of ids, the ids joined by commas, the decoded bytes."""
    m = model(path)
    cache: dict[str, tuple[int, str, bytes]] = held(f"sentencepiece {path}", dict)
    for begin, end in slices([len(t) for t in texts], BLOCK_CHARS):
        cut = [cuts_of(t) for t in texts[begin:end]]
        new = set().union(*cut).difference(cache)
        rest: dict[str, tuple[int, str, bytes]] = {}
        _fill(cache if len(cache) + len(new) <= CACHE else rest, m, new)
        get = cache.get
        for own in cut:
            found = [get(c) or rest[c] for c in own]
            yield sum([f[0] for f in found]), ",".join([f[1] for f in found]), b"".join([f[2] for f in found])[1:]


def encode(text: str, path: str) -> list[int]:
    """Ids of one text."""
    joined = next(encode_all([text], path))[1]
    return [int(i) for i in joined.split(",")] if joined else []


def decode(ids: Iterable[int], path: str) -> str:
    """Text of ids: surfaces joined, stray bytes replaced, the dummy prefix taken off."""
    surface = model(path).surface
    raw = b"".join([surface[i] for i in ids])
    return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, number of ids, SHA-256 of the ids and of the decoded text.

    Null and empty texts have no ids. Any length is encoded whole; other columns are not
    read; repeated rows give repeated results; an empty table gives none.
    """
    ensure_importable(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n, ids, decoded = [], [], []
            for count, joined, raw in encode_all(texts, path):
                n.append(count)
                ids.append(hashlib.sha256(joined.encode()).hexdigest())
                decoded.append(hashlib.sha256(raw).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, the ids as array<int>, the decoded text.

    Null and empty texts have no ids and decode to the empty text. Any length is encoded whole;
    repeated rows give repeated results; an empty table gives none; other columns are not read.
    """
    ensure_importable(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids, decoded = [], []
            for _, joined, raw in encode_all(texts, path):
                ids.append(np.fromstring(joined, np.int32, sep=",") if joined else np.zeros(0, np.int32))
                decoded.append(raw.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, "doc_id long, ids array<int>, decoded string")
