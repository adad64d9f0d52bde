"""Language identification by cross-parsing entropy.

For each language, a suffix automaton of a bounded sample of its labelled texts is built.
A text is cut greedily into the longest phrases that occur in that sample; the fewer
phrases it takes, each weighted by the logarithm of the sample's length, the closer the
language. Texts are parsed in blocks of CHUNK code points side by side, all languages at
once, so that a step of the automata is one numpy gather for thousands of blocks. Then the
blocks of a text are joined: the parse that comes in from the block before goes on until it
meets the block's own, from where on both are the same. So phrases are those of the whole
text, wherever the blocks' edges lie. Where
samples hold so many letters that a table of all ways would be too large, the ways
that there are lie in a hash table, and a step is a few gathers.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deltaview.llm.runtime import ensure_importable, held, slices, tidied

#: The fit: at most so many labelled documents a language, and so many characters of each, from so many places of it.
SAMPLE_DOCS, SAMPLE_CHARS, PLACES = 128, 256, 4
#: Symbols: 0 all but letters, 1 letters that the samples don't hold, the rest, one for each letter, from there on.
OTHER = 2
#: Entries of the table of all ways (states times symbols), at most.
DENSE = 32_000_000
CHUNK = 256
BLOCK_CHARS = 4_000_000
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")
_OVER = np.int32(-(2**31))


def automaton(codes: list[int]) -> tuple[int, np.ndarray]:
    """The suffix automaton of a sequence: number of states, and its ways [state, symbol, next state]."""
    links, size, following = [-1], [0], [{}]
    last = 0
    for c in codes:
        new = len(size)
        size.append(size[last] + 1)
        links.append(0)
        following.append({})
        p = last
        while p >= 0 and c not in following[p]:
            following[p][c] = new
            p = links[p]
        if p >= 0:
            q = following[p][c]
            if size[p] + 1 == size[q]:
                links[new] = q
            else:
                twin = len(size)
                size.append(size[p] + 1)
                links.append(links[q])
                following.append(following[q].copy())
                while p >= 0 and following[p].get(c) == q:
                    following[p][c] = twin
                    p = links[p]
                links[q] = links[new] = twin
        last = new
    ways = [(state, c, to) for state, own in enumerate(following) for c, to in own.items()]
    return len(size), np.array(ways, np.int64).reshape(-1, 3)


class Ways:
    """A hash table from keys (distinct, not negative) to values, with linear probing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        at = self._place(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]  # of several, one stays
            put = self.keys[at] == keys
            self.values[at[put]] = values[put]
            keys, values, at = keys[~put], values[~put], (at[~put] + 1) & self.mask

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 where a key is not in the table."""
        at = self._place(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], -1)
        left = np.flatnonzero((there != keys) & (there >= 0))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            there = self.keys[at[left]]
            hit = there == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (there >= 0)]
        return out


class CrossParser:
    """Automata of all languages in one table, with phrase ends folded in: where a state has
    no way on, the entry is where the root would go, marked as the end of a phrase."""

    def __init__(self, samples: dict[str, list[str]]):
        self.languages = sorted(samples)
        joined = {lang: " ".join(samples[lang]).lower() for lang in self.languages}
        letters = Counter(c for text in joined.values() for c in text if c.isalpha())
        self.symbols = OTHER + len(letters)
        self.code = np.zeros(0x110000, np.min_scalar_type(self.symbols - 1))
        points = np.arange(0x110000)
        self._letters(points)
        for i, (c, _) in enumerate(sorted(letters.items(), key=lambda x: (-x[1], x[0]))):
            for form in {c, *(u for u in (c.upper(), c.title()) if len(u) == 1 and u.lower() == c)}:
                self.code[ord(form)] = i + OTHER
        self.weights, roots, built, first = [], [], [], []
        offset = 0
        for lang in self.languages:
            codes = self.codes_of(joined[lang])
            states, ways = automaton(codes.tolist())
            # A symbol that the sample lacks is a phrase of its own: the last state leads to new phrases only.
            root = ways[:, 0] == 0
            again = np.full(self.symbols, states + offset, np.int32)
            again[ways[root, 1]] = ways[root, 2] + offset
            built.append((offset, ways[~root]))
            first.append(again)
            roots.append(offset)
            offset += states + 1
            self.weights.append(np.log2(max(2, len(codes))))
        self.roots = np.array(roots, np.int32)
        self.first = np.stack(first) if first else np.zeros((0, self.symbols), np.int32)
        self.table = self.ways = None
        if offset * self.symbols <= DENSE:
            table = np.repeat(self.first | _OVER, np.diff([*roots, offset]), 0)
            table[self.roots] = self.first
            for begin, ways in built:
                table[ways[:, 0] + begin, ways[:, 1]] = ways[:, 2] + begin
            self.table = table.ravel()
        else:
            self.ways = Ways(np.concatenate([(w[:, 0] + o) * self.symbols + w[:, 1] for o, w in built]), np.concatenate([w[:, 2] + o for o, w in built]))

    def _step(self, lang: np.ndarray, state: np.ndarray, symbol: np.ndarray, begins: bool = False) -> np.ndarray:
        """The states after one symbol of each block, marked where a phrase ends. `begins`: all are roots."""
        if self.table is not None:
            return self.table.take(state * self.symbols + symbol)
        again = self.first[lang, symbol]
        if begins:
            return again
        to = self.ways.get((state.astype(np.int64) * self.symbols + symbol).ravel()).reshape(state.shape)
        return np.where(to >= 0, to, again | _OVER)

    def _letters(self, points: np.ndarray) -> None:
        """All letters stand for symbol 1 until the samples say otherwise."""
        for c in points.tolist():
            if chr(c).isalpha():
                self.code[c] = 1

    def codes_of(self, text: str) -> np.ndarray:
        codes = self.code[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] > 0) | (codes[:-1] > 0)  # runs of other characters count as one
        return codes[keep]

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of phrases [text, language] if each block is parsed by itself, and of symbols [text]."""
        return self._parsed(texts, joined=False)

    def whole_phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of phrases [text, language] of the whole texts, and of symbols [text]."""
        return self._parsed(texts, joined=True)

    def _parsed(self, texts: list[str], joined: bool) -> tuple[np.ndarray, np.ndarray]:
        codes = [self.codes_of(t) for t in texts]
        flat = np.concatenate([*codes, np.zeros(1, self.code.dtype)]).astype(np.int32)
        size = np.array([len(c) for c in codes], np.int64)
        begins = np.r_[0, np.cumsum(size)[:-1]] if len(size) else size
        chunks = -(-size // CHUNK)
        owner = np.repeat(np.arange(len(texts)), chunks)
        nth = np.arange(len(owner)) - np.repeat(np.r_[0, np.cumsum(chunks)[:-1]] if len(chunks) else chunks, chunks)
        start, length = begins[owner] + nth * CHUNK, np.minimum(CHUNK, size[owner] - nth * CHUNK)
        order = np.argsort(-length, kind="stable")
        from_, long = start[order], length[order]
        live = np.searchsorted(-long, -np.arange(CHUNK), "left")  # at column j: those longer than j
        lang = np.arange(len(self.languages))[:, None]
        state = np.repeat(self.roots[:, None], len(order), 1)
        count = np.ones((len(self.languages), len(order)), np.int32)
        for j in range(CHUNK):
            n = int(live[j])
            if not n:
                break
            to = self._step(lang, state[:, :n], flat[from_[:n] + j], j == 0)
            count[:, :n] += to < 0
            state[:, :n] = to & 0x7FFFFFFF
        back = np.argsort(order)
        count, state = count[:, back], state[:, back]
        if joined:
            count += self._reaching(flat, start, length, nth > 0, state)
        out = np.stack([np.bincount(owner, weights=c, minlength=len(texts)) for c in count], 1) if len(count) else np.zeros((len(texts), 0))
        return out, size

    def _reaching(self, flat: np.ndarray, start: np.ndarray, length: np.ndarray, goes_on: np.ndarray, alone: np.ndarray) -> np.ndarray:
        """Phrases [language, block] that the whole text's parse begins in a block beyond those of
        the block's own parse, which ended in the states `alone`.

        Both parses run side by side until their states are equal. A parse that doesn't meet the
        block's own before the end changes what comes into the next block, which is run again.
        """
        more, ends = np.zeros(alone.shape, np.int32), alone.copy()
        lang, block = np.nonzero(np.repeat(goes_on[None], len(self.languages), 0))
        while len(block):
            own, real = self.roots[lang], ends[lang, block - 1]
            extra = np.full(len(block), -1, np.int32)  # the block's own first phrase
            apart = np.arange(len(block))
            for j in range(CHUNK):
                apart = apart[length[block[apart]] > j]
                if not len(apart):
                    break
                symbol = flat[start[block[apart]] + j]
                a, b = self._step(lang[apart], own[apart], symbol, j == 0), self._step(lang[apart], real[apart], symbol)
                extra[apart] += (b < 0).astype(np.int32) - (a < 0)
                own[apart], real[apart] = a & 0x7FFFFFFF, b & 0x7FFFFFFF
                apart = apart[own[apart] != real[apart]]
            more[lang, block] = extra
            end = alone[lang, block]
            end[apart] = real[apart]
            changed = end != ends[lang, block]
            ends[lang, block] = end
            lang, block = lang[changed], block[changed] + 1
            some = block < len(start)
            lang, block = lang[some], block[some]
            some = goes_on[block]
            lang, block = lang[some], block[some]
        return more

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language of the fewest weighted phrases (the first by name of equal ones), and
        by which share of its phrases the next one needs more, at most 1."""
        lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        known = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
        if not self.languages:
            return lang, score
        for a, b in slices([len(texts[i]) for i in known], BLOCK_CHARS):
            phrases, _ = self.whole_phrases([texts[i] for i in known[a:b]])
            cost = phrases * np.array(self.weights)
            best = cost.argmin(1)
            low = cost[np.arange(len(cost)), best]
            cost[np.arange(len(cost)), best] = np.inf
            margin = np.minimum(1.0, np.where(np.isfinite(cost.min(1)), cost.min(1) / np.maximum(low, 1e-9) - 1, 1.0))
            for i, l, s in zip(known[a:b], best.tolist(), margin.tolist(), strict=True):
                lang[i], score[i] = self.languages[l], s
        return lang, score


def _spread() -> Column:
    """Texts of up to SAMPLE_CHARS characters whole; of longer ones, a piece at a place of
    each of PLACES equal parts, chosen by a hash of doc_id and length."""
    size, piece = F.length("text"), SAMPLE_CHARS // PLACES
    pieces = []
    for i in range(PLACES):
        begin, end = F.floor(size * i / PLACES), F.floor(size * (i + 1) / PLACES)
        at = begin + F.pmod(F.xxhash64("doc_id", size, F.lit(i)), end - begin - piece + 1)
        pieces.append(F.col("text").substr((at + 1).cast("int"), F.lit(piece)))
    return F.when(size <= SAMPLE_CHARS, F.col("text")).otherwise(F.concat_ws(" ", *pieces))


def samples(docs: DataFrame, learn: Column) -> dict[str, list[str]]:
    """By language, up to SAMPLE_DOCS labelled texts where `learn` holds, in the order of a
    hash of doc_id and text, SAMPLE_CHARS characters of each, spread over the whole text."""
    rows = docs.where(learn & F.col("lang").isNotNull() & (F.length("text") > 0)).select("lang", _spread().alias("text"), F.xxhash64("doc_id", F.substring("text", 1, SAMPLE_CHARS)).alias("h"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    out: dict[str, list[str]] = {}
    for r in rows.withColumn("nth", nth).where(F.col("nth") <= SAMPLE_DOCS).orderBy("lang", "nth").collect():
        out.setdefault(r["lang"], []).append(r["text"])
    return out


def predict(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, lang_pred (a learned language; "und" for null texts,
    texts without a letter, and if nothing was learned), score (0 to 1).

    `learn`, over doc_id, picks the documents that may be learned from. Texts of any length
    are parsed whole, in one sequence of phrases; repeated rows give repeated results; other columns are not read.
    """
    spark = docs.sparkSession
    ensure_importable(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    shared = spark.sparkContext.broadcast(samples(rows, learn))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        parser = held(f"language {hashlib.sha256(repr(sorted(own.items())).encode()).hexdigest()}", lambda: CrossParser(own))
        for batch in tidied(batches):
            lang, score = parser.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return rows.select("doc_id", "text").mapInArrow(work, "doc_id long, lang_pred string, score double")
