"""Toxicity scores from a bidirectional GRU with attention pooling, in numpy.

A word goes in as two embeddings: one of the whole word, and the sum of those of its
character n-grams with word ends marked (both tables are hashed, so there is no vocabulary
and no unknown word). Windows of WINDOW words, each overlapping the next by half, run
through a GRU in both directions; attention weighs their states and gives the window's
logit. All windows of a text are scored; the text's score is that of its highest window.

Training fits all of this by Adam on a bounded sample of labelled documents. A document's
logit is then a sharp soft maximum of its windows', so that the gradient finds the windows
that matter. Labels, languages, sources and ids never enter a score.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaview.llm import shingles
from deltaview.llm.runtime import ensure_importable, held, pieces, slices

WINDOW, STRIDE = 32, 16
HIDDEN, WORD_DIM, CHAR_DIM = 8, 6, 6
WORD_BITS, CHAR_BITS, NGRAMS = 15, 15, (3, 4, 5)
#: The fit: at most so many documents of each label, of at most so many characters each.
SAMPLE_DOCS, SAMPLE_CHARS = 1_000, 8_000
EPOCHS, BATCH_DOCS, RATE, SHARPNESS = 4, 32, 0.012, 4.0
#: A bucket that fewer documents of the sample hold has no embedding, so that no document is learned by heart.
LEAST_DOCS = 3
#: Distinct words whose inputs a worker keeps between blocks.
CACHE = 120_000
BLOCK_CHARS = 2_000_000
#: Words whose n-grams are hashed together.
HASHED = 30_000
#: Windows that run side by side: their states fit a core's cache.
FORWARD = 2_048
_EDGES = string.punctuation + string.whitespace + "¡¿«»“”„’…–—"


def bare(word: str) -> str:
    return word.strip(_EDGES).lower()


def words_of(text: str) -> list[str]:
    return text.split()


def hashed(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each bare word: its bucket; and of all of them, the buckets of character n-grams
    with the word that each belongs to, in order of the words."""
    raw = [w.replace(" ", "_").encode("utf-8", "replace") or b"_" for w in words]
    whole, _ = shingles.word_hashes([r.translate(None, b" \t\n\x0b\x0c\r") or b"_" for r in raw])
    marked = "".join(["^" + w + "$" for w in words])
    points = np.frombuffer(marked.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    size = np.array([len(w) + 2 for w in words], np.int64)
    ends = np.cumsum(size)
    begins = ends - size
    owners, grams = [], []
    for n in NGRAMS:
        many = np.maximum(size - n + 1, 0)
        at = np.repeat(begins - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
        h = np.full(len(at), np.uint64(n))
        for j in range(n):
            h = h * np.uint64(0x100000001B3) + points[at + j]
        grams.append((shingles.mix(h) >> np.uint64(64 - CHAR_BITS)).astype(np.int64))
        owners.append(np.repeat(np.arange(len(words)), many))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return (whole >> np.uint64(64 - WORD_BITS)).astype(np.int64), np.concatenate(grams)[order], owner[order]


def _sums(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, values.shape[1]), np.float32)
    if len(owner):
        begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        out[owner[begin]] = np.add.reduceat(values, begin, axis=0)
    return out


def windows(counts: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For documents of so many words that stand one after another: the document of each
    window, its first word and its number of words. A document without words has none."""
    n = np.array(counts, np.int64)
    many = np.where(n > 0, np.maximum(1, -(-(n - (WINDOW - STRIDE)) // STRIDE)), 0)
    doc = np.repeat(np.arange(len(n)), many)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    return doc, (np.cumsum(n) - n)[doc] + nth * STRIDE, np.minimum(WINDOW, n[doc] - nth * STRIDE)


def grid(ids: np.ndarray, start: np.ndarray, size: np.ndarray, pad: int) -> np.ndarray:
    """Word ids [window, place], short windows filled up with `pad`."""
    place = np.arange(WINDOW)
    at = np.minimum(start[:, None] + place, len(ids) - 1)
    return np.where(place < size[:, None], ids[at], pad)


@dataclass
class Net:
    p: dict[str, np.ndarray] = field(default_factory=dict)
    #: Score of texts without words: the share of label 1.
    prior: float = 0.0

    @staticmethod
    def new(seed: int) -> Net:
        r = np.random.default_rng(seed)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        p = {"Ew": r.normal(0, 0.05, (1 << WORD_BITS, WORD_DIM)), "Ec": r.normal(0, 0.05, (1 << CHAR_BITS, CHAR_DIM)), "v": r.normal(0, 0.3, 2 * h), "w": r.normal(0, 0.5, 2 * h), "b": np.zeros(1) - 1}
        for k in "fb":
            p |= {f"W{k}": r.normal(0, d**-0.5, (d, 3 * h)), f"U{k}": r.normal(0, 0.7 * h**-0.5, (h, 3 * h)), f"c{k}": np.zeros(3 * h)}
        return Net({k: x.astype(np.float32) for k, x in p.items()})

    def inputs(self, hashes: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        bucket, grams, owner = hashes
        return np.concatenate([self.p["Ew"][bucket], 0.25 * _sums(self.p["Ec"][grams], owner, len(bucket))], 1)

    def projected(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """What each word gives the gates of either direction; the last row is the padding,
        which holds the update gate open for the old state."""
        h = HIDDEN
        pad = np.zeros((1, 3 * h), np.float32)
        pad[:, :h] = 80
        return {k: np.concatenate([x @ self.p[f"W{k}"] + self.p[f"c{k}"], pad]) for k in "fb"}

    def _run(self, k: str, table: np.ndarray, ids: np.ndarray, keep: list | None) -> list[np.ndarray]:
        h, U = np.zeros((len(ids), HIDDEN), np.float32), self.p[f"U{k}"]
        out: list = [None] * WINDOW
        for t in range(WINDOW) if k == "f" else range(WINDOW - 1, -1, -1):
            x, a = table[ids[:, t]], h @ U
            gates = 0.5 * np.tanh(0.5 * (x[:, : 2 * HIDDEN] + a[:, : 2 * HIDDEN])) + 0.5
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            n = np.tanh(x[:, 2 * HIDDEN :] + r * a[:, 2 * HIDDEN :])
            new = n + z * (h - n)
            if keep is not None:
                keep.append((t, h, a[:, 2 * HIDDEN :], z, r, n))
            out[t] = h = new
        return out

    def forward(self, tables: dict[str, np.ndarray], ids: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows."""
        runs = {k: self._run(k, tables[k], ids, None if keep is None else keep.setdefault(k, [])) for k in "fb"}
        states = np.concatenate([np.stack(runs["f"], 1), np.stack(runs["b"], 1)], 2)
        score = states @ self.p["v"]
        score[ids == len(tables["f"]) - 1] = -1e30
        score = np.exp(score - score.max(1, keepdims=True))
        alpha = score / score.sum(1, keepdims=True)
        pooled = (alpha[:, None, :] @ states)[:, 0]
        if keep is not None:
            keep |= {"states": states, "alpha": alpha, "pooled": pooled}
        return pooled @ self.p["w"] + self.p["b"]

    def backward(self, g: np.ndarray, ids: np.ndarray, keep: dict, n_words: int) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
        """From the logits' gradient: the parameters', and the projected inputs'."""
        d: dict[str, np.ndarray] = {"b": g.sum(keepdims=True), "w": keep["pooled"].T @ g}
        pooled = g[:, None] * self.p["w"]
        states, alpha = keep["states"], keep["alpha"]
        ds = alpha[:, :, None] * pooled[:, None, :]
        da = (states @ pooled[:, :, None])[:, :, 0]
        da = alpha * (da - (alpha * da).sum(1, keepdims=True))
        d["v"] = np.einsum("nt,nth->h", da, states)
        ds += da[:, :, None] * self.p["v"]
        dx = {}
        flat = ids.T.ravel()
        order = np.argsort(flat, kind="stable")
        owner = flat[order]
        for i, k in enumerate("fb"):
            own, U = ds[:, :, i * HIDDEN : (i + 1) * HIDDEN], self.p[f"U{k}"]
            dU, dh = np.zeros_like(U), np.zeros((len(ids), HIDDEN), np.float32)
            gates = np.empty((WINDOW, len(ids), 3 * HIDDEN), np.float32)
            for t, h, an, z, r, n in reversed(keep[k]):
                dh = dh + own[:, t]
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (h - n) * z * (1 - z)
                dr = dn * an * r * (1 - r)
                da_ = np.concatenate([dz, dr, dn * r], 1)
                gates[t] = da_
                gates[t, :, 2 * HIDDEN :] = dn
                dU += h.T @ da_
                dh = dh * z + da_ @ U.T
            d[f"U{k}"], dx[k] = dU, _sums(gates.reshape(-1, 3 * HIDDEN)[order], owner, n_words + 1)[:-1]
        return d, dx


def _log_odds(buckets: list[np.ndarray], labels: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """By bucket: the log-odds of label 1 in the documents that hold it, over those of all
    (rarer buckets count less); and whether LEAST_DOCS documents hold it."""
    seen = [np.zeros(1 << bits), np.zeros(1 << bits)]
    for b, y in zip(buckets, labels.tolist(), strict=True):
        seen[int(y)][b] += 1
    rate = [(s + 0.5) / (n + 1) for s, n in zip(seen, (len(labels) - labels.sum(), labels.sum()), strict=True)]
    many = seen[0] + seen[1]
    return np.clip(np.log(rate[1] / rate[0]) * (1 - 1 / (1 + many)), -4, 4), many >= LEAST_DOCS


def train(texts: list[str], labels: list[int], prior: float, seed: int = 7) -> Net:
    """Fit a net to whole texts. Texts without words teach nothing; without both labels the net scores the prior."""
    known = [(words_of(t), int(y)) for t, y in zip(texts, labels, strict=True)]
    known = [(w, y) for w, y in known if w]
    y = np.array([y for _, y in known], np.float32)
    if not len(y) or y.min() == y.max():
        return Net(prior=prior)
    net = Net.new(seed)
    net.prior = prior
    forms = list({bare(x) for w, _ in known for x in w})
    place = {w: i for i, w in enumerate(forms)}
    docs = [np.array([place[bare(x)] for x in w], np.int64) for w, _ in known]
    bucket, grams, owner = hashed(forms)
    first = np.searchsorted(owner, np.arange(len(forms) + 1))
    own_grams = [np.unique(np.concatenate([grams[first[i] : first[i + 1]] for i in np.unique(d)])) for d in docs]
    live = {}
    for table, held, bits in (("Ew", [np.unique(bucket[d]) for d in docs], WORD_BITS), ("Ec", own_grams, CHAR_BITS)):
        odds, often = _log_odds(held, y, bits)
        net.p[table][:, 0] += 0.4 * odds
        net.p[table] *= often[:, None]
        live[table] = often[:, None].astype(np.float32)
    rng = np.random.default_rng(seed + 1)
    moments = {k: (np.zeros_like(x), np.zeros_like(x)) for k, x in net.p.items()}
    step = 0
    # Equal weight for both labels, and the rarer one is never more than one in four by weight of the loss.
    weight = np.where(y == 1, min(4.0, max(1.0, (y == 0).sum() / max(1, (y == 1).sum()) / 2)), 1.0).astype(np.float32)
    for epoch in range(EPOCHS):
        for batch in np.array_split(rng.permutation(len(docs)), max(1, -(-len(docs) // BATCH_DOCS))):
            flat, ids = np.unique(np.concatenate([docs[i] for i in batch]), return_inverse=True)
            doc, start, size = windows([len(docs[i]) for i in batch])
            own = grid(ids, start, size, len(flat))
            count = first[flat + 1] - first[flat]
            at = np.repeat(first[flat] - np.cumsum(count) + count, count) + np.arange(count.sum())
            hashes = bucket[flat], grams[at], np.repeat(np.arange(len(flat)), count)
            x = net.inputs(hashes)
            keep: dict = {}
            logit = net.forward(net.projected(x), own, keep)
            top = np.full(len(batch), -np.inf, np.float32)
            np.maximum.at(top, doc, logit)
            e = np.exp(SHARPNESS * (logit - top[doc]))
            total = np.bincount(doc, e, len(batch)).astype(np.float32)
            whole = top + np.log(total) / SHARPNESS
            g = (1 / (1 + np.exp(-whole)) - y[batch]) * weight[batch] / len(batch)
            d, dx = net.backward((g[doc] * e / total[doc]).astype(np.float32), own, keep, len(flat))
            di = np.zeros_like(x)
            for k in "fb":
                d[f"W{k}"], d[f"c{k}"] = x.T @ dx[k], dx[k].sum(0)
                di += dx[k] @ net.p[f"W{k}"].T
            d["Ew"], d["Ec"] = np.zeros_like(net.p["Ew"]), np.zeros_like(net.p["Ec"])
            for table, at, part in (("Ew", hashes[0], di[:, :WORD_DIM]), ("Ec", hashes[1], 0.25 * di[hashes[2], WORD_DIM:])):
                order = np.argsort(at, kind="stable")
                d[table] = _sums(part[order], at[order], len(d[table])) * live[table]
            step += 1
            rate = RATE * (1 - 0.8 * epoch / EPOCHS)
            for k, m in moments.items():
                m[0][...] += 0.1 * (d[k] - m[0])
                m[1][...] += 0.005 * (d[k] * d[k] - m[1])
                net.p[k] -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.995**step)) + 1e-6)
    return net


class Scorer:
    """Scores texts in blocks; keeps the projected inputs of words that it has seen."""

    def __init__(self, net: Net):
        self.net = net
        self.rows: dict[str, int] = {}
        self.tables: dict[str, np.ndarray] = {}

    def scores(self, texts: list[str]) -> Iterator[float]:
        for a, b in slices([len(t) for t in texts], BLOCK_CHARS):
            yield from self._block(texts[a:b])

    def _block(self, texts: list[str]) -> list[float]:
        net = self.net
        if not net.p:
            return [net.prior] * len(texts)
        words = [words_of(t) for t in texts]
        new = list(set().union(*words).difference(self.rows))
        base = len(self.rows)
        rows = dict(zip(new, range(base, base + len(new)), strict=True))
        inputs = [net.inputs(hashed([bare(w) for w in new[i : i + HASHED]])) for i in range(0, len(new), HASHED)]
        tables = net.projected(np.concatenate([np.zeros((0, WORD_DIM + CHAR_DIM), np.float32), *inputs]))
        if base:
            tables = {k: np.concatenate([self.tables[k], t]) for k, t in tables.items()}
        if base + len(new) <= CACHE:
            self.rows |= rows
            self.tables = {k: t[:-1] for k, t in tables.items()}
            rows = self.rows
        else:
            rows = _Either(rows, self.rows)
        ids = np.fromiter((rows[w] for own in words for w in own), np.int64, sum(map(len, words)))
        doc, start, size = windows([len(w) for w in words])
        top = np.full(len(texts), -np.inf, np.float32)
        for i in range(0, len(doc), FORWARD):
            part = slice(i, i + FORWARD)
            np.maximum.at(top, doc[part], net.forward(tables, grid(ids, start[part], size[part], len(tables["f"]) - 1)))
        return [net.prior if t == -np.inf else float(1 / (1 + np.exp(-np.float64(t)))) for t in top]


class _Either:
    def __init__(self, first: dict[str, int], second: dict[str, int]):
        self.first, self.second = first, second

    def __getitem__(self, word: str) -> int:
        at = self.second.get(word)
        return self.first[word] if at is None else at


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Net:
    """Train on up to SAMPLE_DOCS labelled documents of each label where `learn` (over doc_id)
    holds, of SAMPLE_CHARS characters or fewer, in the order of a hash of doc_id."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(learn & F.col("y").isin(0, 1))
    marks = marks.groupBy("doc_id").agg(F.max("y").alias("y"))
    total, ones = marks.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).head()
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(learn & F.length("text").between(1, SAMPLE_CHARS))
    chosen = []
    for y in (0, 1):
        # Twice as many ids as wanted: some of their texts are too long.
        ids = marks.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * SAMPLE_DOCS).select("doc_id")
        some = texts.join(F.broadcast(ids), "doc_id").collect()
        some = sorted({r["doc_id"]: r["text"] for r in some}.items(), key=lambda x: shingles.mix(np.array([x[0]], np.int64).view(np.uint64))[0])
        chosen += [(t, y) for _, t in some[:SAMPLE_DOCS]]
    return train([t for t, _ in chosen], [y for _, y in chosen], ones / total if total else 0.0)


def _scorer(net: Net) -> Scorer:
    """The worker's scorer of this net, with the words that it has seen so far."""
    key = hashlib.sha256(b"".join(x.tobytes() for x in net.p.values())).hexdigest() if net.p else repr(net.prior)
    return held(f"toxicity {key}", lambda: Scorer(net))


def score(docs: DataFrame, net: Net, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, score (0 to 1, higher: label 1 likelier).

    Texts of any length are scored whole, window by window. Null and empty texts, and those of
    white space, score the share of label 1 among the labelled rows, as does every text if
    the labels were all equal. Repeated rows give repeated results; other columns are not read.
    """
    spark = docs.sparkSession
    ensure_importable(spark)
    shared = spark.sparkContext.broadcast(net)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared.value)
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(scorer.scores([t or "" for t in batch.column(1).to_pylist()])), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, "doc_id long, score double")


def accepted(docs: DataFrame, net: Net, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, whose score is below the threshold, and those
    without words. Rows are judged where they are read; nothing is shuffled."""
    spark = docs.sparkSession
    ensure_importable(spark)
    shared = spark.sparkContext.broadcast(net)
    at = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared.value)
        for batch in pieces(batches):
            texts = [t or "" for t in batch.column(at).to_pylist()]
            keep = [s < threshold or not t.strip() for s, t in zip(scorer.scores(texts), texts, strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(work, docs.schema)
