"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from deltaview.llm import components, decontaminate, embedding_dedup, language_id, line_dedup, ngram_join, sentencepiece_codec, suffix_dedup, token_counts, token_store, toxicity

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
ODD = "doc_id long, text string, lang string, source string, n_chars long, key string, rep long, n long, h long, `__dropped` string"
R = random.Random(3)
WORDS = [f"w{i}" for i in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


LONG = prose(40_000, 1)
BLOCK = "x" * 30_000
TEXTS = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one two three"), (6, "One  TWO\tthree"), (7, LONG), (8, LONG), (8, LONG), (9, BLOCK), (10, BLOCK + "y"), (11, prose(80, 5)), (12, prose(80, 5) + " more"),
    (13, "a\n\nb\n\n"), (14, "▁ é\U0001f642\x00 <|endoftext|> <s>"), (15, "ab" * 300), (16, "\n".join(prose(30, 9) for _ in range(3))), (None, "no id " + prose(20, 11)),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, None if (i or 0) % 3 == 0 else "en", None, None, "k", 5, 6, 7, "d") for i, t in TEXTS], ODD)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


def by_id(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def shingle_set(text):
    words = [w for w in "".join(c if c not in " \t\n\x0b\x0c\r" else " " for c in (text or "")).translate({c: c + 32 for c in range(65, 91)}).split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_ngram_join(odd, empty):
    sets = {i: shingle_set(t) for i, t in TEXTS if i is not None}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.link(odd).collect()]
    assert sorted(got, key=repr) == sorted([(i, len(sets[i]), root(i)) if i is not None else (None, len(shingle_set(t)), None) for i, t in TEXTS], key=repr)
    assert root(8) == 7 and root(12) == 11 and root(6) == 5 and ngram_join.link(empty).count() == 0


def mutated(words, share, seed):
    r = random.Random(seed)
    return [r.choice(WORDS) + str(seed) if r.random() < share else w for w in words]


def test_ngram_join_random_groups(spark):
    """Groups of near copies around the threshold, against all pairs."""
    texts = []
    for g in range(6):
        base = prose(60 + 20 * g, 100 + g).split()
        texts += [" ".join(mutated(base, share, 1000 * g + n)) for n, share in enumerate([0, 0.005, 0.01, 0.02, 0.02, 0.03, 0.04, 0.05, 0.01, 0.02, 0.03, 0.01, 0.0])]
    rows = list(enumerate(texts))
    sets = [shingle_set(t) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: root(i) for i in range(len(texts))} and 6 < len(set(got.values())) < len(texts)


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(r.randrange(100), r.randrange(100)) for _ in range(60)] + [(7, 7), (None, 3)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent if root(x) != x}


def test_suffix_dedup(spark, odd, empty):
    rows = [(i, (t or "").encode()) for i, t in TEXTS if i is not None]
    expected = {i: x for (i, _), x in zip(sorted(dict(rows).items()), suffix_dedup.brute_force(list(dict(rows).items())), strict=True)}
    got = [tuple(r) for r in suffix_dedup.digest(odd).collect()]
    assert len(got) == len(TEXTS)
    assert all(g == expected[g[0]] for g in got if g[0] is not None)
    assert suffix_dedup.digest(empty).count() == 0
    kept = {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.remove_repeats(odd).collect()}
    assert kept[4] == b"one" and kept[9] == b"x" and kept[8] == b""


def test_suffix_dedup_random(spark):
    """Passages of about the length, in random places, with periodic stretches."""
    r = random.Random(5)
    passages = ["".join(r.choice("abcd ") for _ in range(n)) for n in (99, 100, 101, 130, 240, 400)] + ["ab" * 90, "z" * 250]
    texts = [(i, "".join(r.choice(passages) if r.random() < 0.5 else "".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 120))) for _ in range(r.randrange(1, 9)))) for i in range(60)]
    got = sorted(tuple(x) for x in suffix_dedup.digest(spark.createDataFrame(texts, "doc_id long, text string")).collect())
    assert got == suffix_dedup.brute_force([(i, t.encode()) for i, t in texts])


def test_sentencepiece(odd, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    expected = sorted(((i, len(ids := sp.encode(t or "")), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()) for i, t in TEXTS), key=repr)
    assert by_id(sentencepiece_codec.digest(odd, PIECES)) == expected
    assert sentencepiece_codec.digest(empty, PIECES).count() == 0
    pieces = {r["doc_id"]: (r["ids"], r["decoded"]) for r in sentencepiece_codec.encoded(odd, PIECES).collect()}
    assert pieces[1] == ([], "") and pieces[5] == (sp.encode("one two three"), "one two three")
    for text in ["", " ", " lead", "trail ", "two  spaces", "▁", "\n", " \n ", "a\nb \nc\n d", "the" * 500, "".join(R.choice("ab \né日") for _ in range(500))]:
        assert sentencepiece_codec.encode(text, PIECES) == sp.encode(text), text
        assert sentencepiece_codec.decode(sp.encode(text), PIECES) == sp.decode(sp.encode(text))
    assert sentencepiece_codec.decode([sp.piece_to_id("<0xFF>")], PIECES) == "�"


def tokens(texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(BYTES).encode_batch(texts, add_special_tokens=False)]


def test_token_counts(odd, empty):
    expected = sorted(((i, len((t or "").encode()), len(x), len(x) > 512) for (i, t), x in zip(TEXTS, tokens([t or "" for _, t in TEXTS]), strict=True)), key=repr)
    assert by_id(token_counts.token_counts(odd, BYTES)) == expected
    assert token_counts.token_counts(empty, BYTES).count() == 0
    parts = ["a", " ", "  ", "\n", "\t", " the", "'s", "12", "é", "　", "\x85", "<|endoftext|>", "!?", "\n\n", " \n", "\nAb"]
    texts = ["".join(R.choice(parts) for _ in range(R.randrange(12))) for _ in range(3000)]
    assert list(token_counts.count_all(texts, BYTES)) == [len(x) for x in tokens(texts)]
    assert [len(x) // 4 for x in token_store.encode_all(texts, BYTES)] == [len(x) for x in tokens(texts)]


def test_token_files(spark, odd, empty, tmp_path):
    files = token_store.write_tokens(odd, BYTES, end_id=2, path=str(tmp_path / "tokens"))
    got = sorted(((r["doc_id"], r["ids"]) for r in token_store.read_ids(spark, files).collect()), key=repr)
    expected = sorted(((-(2**63) if i is None else i, [*x, 2]) for (i, _), x in zip(TEXTS, tokens([t or "" for _, t in TEXTS]), strict=True)), key=repr)
    assert got == expected
    table = sorted((r["start"], r["n_tokens"], r["doc_id"]) for r in token_store.read_tokens(spark, files).collect())
    assert all(a[0] + a[1] == b[0] and a[2] <= b[2] for a, b in zip(table, table[1:], strict=False)) and table[0][0] == 0
    nothing = token_store.write_tokens(empty, BYTES, end_id=2, path=str(tmp_path / "none"))
    assert token_store.read_tokens(spark, nothing).count() == 0


def test_shards():
    r = np.random.default_rng(0)
    arrays = [np.sort(r.integers(0, 50_000, n)).astype("<u4") for n in (1, 5, 900, 0, 30_000, *[50] * 40)]
    trained = token_store.train_dictionary([token_store.narrow(a.tobytes(), 2) for a in arrays])
    for dictionary, width in ((trained, 2), (b"", 4)):
        writer = token_store.ShardWriter(dictionary, width)
        for i, a in enumerate(arrays):
            writer.add(10 * i - 20, a.tobytes())
        data = writer.close()
        shard = token_store.Shard(data, dictionary)
        assert len(shard) == len(arrays) and all((shard.ids(i) == a).all() for i, a in enumerate(arrays))
        assert (shard.find(-10) == arrays[1]).all() and shard.find(3) is None
        with pytest.raises(ValueError):
            token_store.Shard(data, dictionary + b"x")
    with pytest.raises(ValueError):
        token_store.Shard(b"nope" * 20, b"")


def lines_by_hand(rows, min_chars, min_docs):
    strip = " \t\n\x0b\x0c\r"
    key = lambda line: line.strip(strip).translate({c: c + 32 for c in range(65, 91)})
    seen = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                seen.setdefault(key(line), set()).add(i)
    gone = {k: max(d) for k, d in seen.items() if len(d) >= min_docs}
    out = []
    for i, t in rows:
        kept = [line for line in (t or "").split("\n") if not (key(line) in gone and i < gone[key(line)])]
        out.append((i, len((t or "").split("\n")), len((t or "").split("\n")) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def test_line_dedup(spark, odd, empty):
    assert len(by_id(line_dedup.digest(odd))) == len(TEXTS) and line_dedup.digest(empty).count() == 0
    shared = ["The same LONG line of forty characters and É more", "   the same long line of forty characters and É more\x0b", "the same long line of forty characters and é more", "short", "", "another line that many of these documents have, too", "z" * 200]
    r = random.Random(2)
    rows = [(i, "\n".join(r.choice(shared) for _ in range(r.choice([0, 1, 5, 200])))) for i in range(40)] + [(90, None), (91, "\n\n")]
    docs = spark.createDataFrame([(i, t, i, "x") for i, t in rows], "doc_id long, text string, n_lines long, pos string")
    assert by_id(line_dedup.digest(docs)) == sorted(lines_by_hand(rows, 40, 5), key=repr)
    out = line_dedup.dedup_lines(docs)
    assert out.columns == ["doc_id", "text", "pos", "n_lines", "n_dropped"] and out.where("doc_id = 90 and text is null").count() == 1


def test_toxicity(spark, odd, empty):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(240):
        toxic = i % 4 == 0
        words = prose(r.randrange(20, 200), 7000 + i).split()
        for _ in range(4 if toxic else 0):
            words[r.randrange(len(words))] = r.choice(["dreck" + r.choice("abcdefgh"), "Vileness!", "scumm"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    net = toxicity.fit(docs, spark.createDataFrame(labels + [(999, None), (5, 0)], "doc_id long, toxic int"), learn=F.col("doc_id") % 3 != 0)
    scores = {x["doc_id"]: x["score"] for x in toxicity.score(docs, net).collect()}
    test = [(scores[i] >= 0.3) == bool(y) for i, y in labels if i % 3 == 0]
    assert np.mean(test) > 0.9
    got = {x["doc_id"]: x["score"] for x in toxicity.score(odd, net).collect()}
    assert got[1] == got[2] == got[3] == pytest.approx(net.prior) and all(0 <= s <= 1 for s in got.values())
    assert toxicity.score(empty, net).count() == 0
    kept = toxicity.accepted(odd, net)
    assert kept.columns == odd.columns and kept.where("doc_id <= 3").count() == 3
    untrained = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"), learn=F.lit(True))
    assert {x["score"] for x in toxicity.score(docs, untrained).collect()} == {0.0}


def test_toxicity_gradient():
    """The backward pass against differences."""
    net = toxicity.Net.new(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    words = ["idiot", "the", "of", "x", "pathetic"] * 9
    forms = sorted(set(words))
    ids = np.array([forms.index(w) for w in words])
    hashes = toxicity.hashed(forms)
    doc, start, size = toxicity.windows([len(ids)])
    own, weights = toxicity.grid(ids, start, size, len(forms)), np.arange(1.0, len(doc) + 1)
    loss = lambda: net.forward(net.projected(net.inputs(hashes)), own).astype(np.float64) @ weights
    keep: dict = {}
    x = net.inputs(hashes)
    net.forward(net.projected(x), own, keep)
    d, dx = net.backward(weights, own, keep, len(forms))
    for k in "fb":
        d[f"W{k}"], d[f"c{k}"] = x.T @ dx[k], dx[k].sum(0)
    for k in ("v", "w", "b", "Uf", "Ub", "Wf", "Wb", "cf", "cb"):
        at = np.unravel_index(3 % net.p[k].size, net.p[k].shape)
        old = net.p[k][at]
        net.p[k][at] = old + 1e-3
        high = loss()
        net.p[k][at] = old - 1e-3
        low = loss()
        net.p[k][at] = old
        assert (high - low) / 2e-3 == pytest.approx(float(d[k][at]), abs=2e-4)


def test_embeddings(spark):
    r = np.random.default_rng(1)
    base = r.normal(size=(40, 16))
    rows, i = [], 0
    for b in base:
        for scale in (0, 0.05, 0.2, 0.28, 0.4):
            rows.append((i, (b + scale * r.normal(size=16) * 1.0).tolist(), i % 2))
            i += 1
    rows += [(i + n, rows[0][1], 0) for n in range(30)]
    rows += [(2000, None, 0), (2001, [0.0] * 16, 0), (2002, [float("nan")] * 16, 0), (2003, [1.0, None] * 8, 0), (2004, rows[0][1], None), (2005, [], 0), (2006, [1.0, 2.0], 0), (2007, [2.0, 4.0], 0), (2008, [1e300] * 16, 1), (2009, [1e-300] * 16, 1), (2010, [float("inf")] * 16, 0)]
    df = spark.createDataFrame([(*x, 1, "b") for x in rows], "vec_id long, embedding array<double>, label int, n_links int, block string")
    got = {x["vec_id"]: x for x in embedding_dedup.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    good = [(v, np.array(e), l) for v, e, l in rows if e and l is not None and None not in e and np.isfinite(e).all() and any(e)]
    unit = {v: (e / abs(e).max()) / np.linalg.norm(e / abs(e).max()) for v, e, _ in good}
    links = {v: {w for w, f, m in good if w != v and m == l and len(f) == len(e) and unit[v] @ unit[w] >= 0.93} for v, e, l in good}
    found, all_ = sum(got[v]["n_links"] for v in links), sum(map(len, links.values()))
    assert 0.95 * all_ <= found <= all_ and all(got[v]["n_links"] <= len(links[v]) for v in links)
    assert got[2006]["component_id"] == got[2007]["component_id"] == 2006 and got[2009]["component_id"] == 2008
    for v in (2000, 2001, 2002, 2003, 2004, 2005, 2010):
        assert (got[v]["n_links"], got[v]["component_id"], got[v]["kept"]) == (0, v, True)
    assert embedding_dedup.near_duplicates(df.where("false")).count() == 0


def test_embedding_recall(spark):
    """Pairs right at the threshold, among many others: at least nine in ten are found."""
    r = np.random.default_rng(2)
    x = r.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = r.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.935 * x + np.sqrt(1 - 0.935**2) * z
    rows = [(i, v.tolist(), 0) for i, v in enumerate(np.concatenate([x, y]))]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert got.agg(F.sum("n_links")).head()[0] >= 0.9 * 3000


@pytest.mark.parametrize("cosine", [0.97, 0.95])
def test_embedding_group(spark, cosine):
    """A third of the rows are near copies of each other that all differ: no link among them is missed."""
    r = np.random.default_rng(4)
    z = r.normal(size=(2400, 64))
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    z[:800] = cosine**0.5 * z[-1] + (1 - cosine) ** 0.5 * z[:800]
    x = z / np.linalg.norm(z, axis=1, keepdims=True)
    got = embedding_dedup.near_duplicates(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")).collect()
    links = (x @ x.T >= 0.93).sum(1) - 1
    assert links[:800].sum() > 400_000
    assert [g["n_links"] for g in sorted(got, key=lambda g: g["vec_id"])] == links.tolist()


def test_decontamination(spark, odd, empty):
    passage = prose(40, 77)
    words = passage.split()
    docs = [(i, t) for i, t in TEXTS if i is not None] + [
        (20, prose(3000, 78) + " " + passage.upper() + " " + prose(500, 79)),
        (21, prose(50, 80) + " " + " ".join([*words[:38], "changed", "end"])),
        (22, " ".join(words[:20]) + " " + prose(30, 81) + " " + " ".join(words[20:])),
        (23, " ".join(words[:20])),
        (24, "x two three y"),
    ]
    items = [(1, passage), (2, "TWO three"), (3, None), (4, " "), (5, LONG), (6, passage + " " + prose(10, 90)), (2, "one")]

    def contained(text, item):
        q = shingle_set(item)
        w, d = (item or "").lower().split(), (text or "").lower().split()
        if 0 < len(w) < 5:
            return len(q), int(any(d[j : j + len(w)] == w for j in range(len(d))))
        return len(q), len(q & shingle_set(text))

    expected = sorted((i, j, n, c, c / n) for i, t in docs for j, it in items for n, c in [contained(t, it)] if n and 5 * c >= 4 * n)
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, item_id int, n_common int")
    table = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, doc_id int")
    assert sorted(tuple(r) for r in decontaminate.contained(df, table).collect()) == expected
    assert {1: True, 2: True}.items() <= {j: True for _, j, *_ in expected}.items()
    kept = decontaminate.clean(df, table)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, _ in docs if i not in {e[0] for e in expected})
    assert decontaminate.contained(empty, table).count() == 0 and decontaminate.contained(odd, table.where("false")).count() == 0


def test_decontamination_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 2)
    items = spark.createDataFrame([(i, prose(20, 300 + i)) for i in range(7)], "item_id long, text string")
    docs = spark.createDataFrame([(i, prose(100, 50) + " " + prose(20, 300 + i)) for i in range(7)] + [(9, prose(100, 51))], "doc_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.contained(docs, items).collect()) == [(i, i) for i in range(7)]
    assert [r["doc_id"] for r in decontaminate.clean(docs, items).collect()] == [9]


def cross_parse(codes, sample, chunk):
    """Phrases of the greedy parse, by searching the sample."""
    total = 0
    for at in range(0, len(codes), chunk):
        part, i = codes[at : at + chunk], 0
        while i < len(part):
            j = i + 1
            while j <= len(part) and part[i:j] in sample:
                j += 1
            i = max(j - 1, i + 1)
            total += 1
    return total


def test_cross_parsing():
    samples = {"a": ["the cat sat on the mat and the dog"], "b": ["été à la plage avec le chat"], "c": ["x"]}
    parser = language_id.CrossParser(samples)
    texts = ["The dog sat", "la plage à été zzz 日本", "the mat " * 100, "x"]
    phrases, size = parser.phrases(texts)
    for t, text in enumerate(texts):
        codes = parser.codes_of(text).tobytes()
        assert size[t] == len(codes)
        for l, lang in enumerate(parser.languages):
            assert phrases[t, l] == cross_parse(codes, parser.codes_of(" ".join(samples[lang]).lower()).tobytes(), language_id.CHUNK)


@pytest.mark.parametrize("dense", [32_000_000, 0])
def test_many_letters(dense, monkeypatch):
    """Every letter that the samples hold counts as itself, however rare, by table and by hash."""
    monkeypatch.setattr(language_id, "DENSE", dense, raising=False)
    r = random.Random(8)
    scripts = {"ar": (0x628, 36), "el": (0x3B1, 17), "hy": (0x561, 38), "ka": (0x10D0, 33), "ru": (0x430, 32), "zh": (0x4E00, 400)}
    samples = {lang: ["".join(chr(first + r.randrange(n)) for _ in range(3)) + " " for _ in range(400)] for lang, (first, n) in scripts.items()}
    # Two languages of the rarest letters, with words of equal lengths.
    for lang, first in (("am", 0x1200), ("km", 0x1780)):
        samples[lang] = ["".join(chr(first + r.randrange(20)) for _ in range(3)) for _ in range(40)]
    parser = language_id.CrossParser(samples)
    assert (parser.table is None) == (dense == 0)
    texts = [" ".join(r.sample(samples[lang], 12)) for lang in parser.languages] + ["mixed \u4e01\u1201 x" * 40, "", "I \u0130"]
    assert parser.predict(texts[: len(samples)])[0] == parser.languages
    phrases, size = parser.phrases(texts)
    for t, text in enumerate(texts):
        codes = "".join(map(chr, parser.codes_of(text).tolist()))
        assert size[t] == len(codes)
        for l, lang in enumerate(parser.languages):
            sample = "".join(map(chr, parser.codes_of(" ".join(samples[lang]).lower()).tolist()))
            assert phrases[t, l] == cross_parse(codes, sample, language_id.CHUNK)
    letters = {c for own in samples.values() for x in own for c in x if c.isalpha()}
    assert len(set(parser.codes_of("".join(sorted(letters))).tolist())) == len(letters)


@pytest.mark.parametrize("dense", [32_000_000, 0])
def test_whole_cross_parsing(dense, monkeypatch):
    """Phrases across the blocks' edges: those of a plain parse of the whole text, also where parses never meet."""
    monkeypatch.setattr(language_id, "DENSE", dense, raising=False)
    r = random.Random(9)
    words = ["".join(r.choice("abcdef") for _ in range(r.randint(1, 6))) for _ in range(60)]
    samples = {"a": [" ".join(r.choice(words) for _ in range(300))], "b": ["z" * 10 + " " + "".join(r.choice("abc") for _ in range(400))], "c": ["x"]}
    parser = language_id.CrossParser(samples)
    n = language_id.CHUNK
    texts = [" ".join(r.choice(words) for _ in range(m)) for m in (1, 40, 400, 1500)]
    texts += ["z" * (5 * n + 3), samples["a"][0] * 3, "abc" * n, "q" * (2 * n), "a" * n, "b" * (n + 1), "", "  "]
    phrases, size = parser.whole_phrases(texts)
    for t, text in enumerate(texts):
        codes = "".join(map(chr, parser.codes_of(text).tolist()))
        assert size[t] == len(codes)
        for l, lang in enumerate(parser.languages):
            sample = "".join(map(chr, parser.codes_of(" ".join(samples[lang]).lower()).tolist()))
            assert phrases[t, l] == cross_parse(codes, sample, max(1, len(codes)))
    assert (phrases != parser.phrases(texts)[0]).any()


def test_language_id(spark, odd, empty):
    everything = F.lit(True)
    out = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(odd, everything).collect()}
    assert out[1] == out[2] == out[3] == ("und", 0.0) and out[4][0] == "en"
    assert language_id.predict(empty, everything).count() == 0
    unlearned = language_id.predict(odd, F.lit(False))
    assert {r["lang_pred"] for r in unlearned.collect()} == {"und"}
    digits = spark.createDataFrame([(1, "123 456 !!", None), (2, "hello there", "en")], "doc_id long, text string, lang string")
    assert {r["doc_id"]: r["lang_pred"] for r in language_id.predict(digits, everything).collect()} == {1: "und", 2: "en"}


def test_language_id_header(spark):
    """Documents of every language that open with the same header: what is learned lies behind it, too."""
    r = random.Random(6)
    words = {lang: ["".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(60)] for lang, letters in (("x", "abcdefghijkl"), ("y", "efghijklmnop"), ("z", "ijklmnopqrst"))}
    header = prose(100, 12)[:300]
    assert len(header) == 300

    def body(lang, n):
        return " ".join(r.choice(words[lang]) for _ in range(n))

    rows = [(i, header + " " + body(lang, 300), lang) for i, lang in enumerate(["x", "y", "z"] * 20)]
    held = [(100 + i, body(lang, 30), lang) for i, lang in enumerate(["x", "y", "z"] * 10)]
    docs = spark.createDataFrame(rows + held, "doc_id long, text string, lang string")
    got = {d["doc_id"]: d["lang_pred"] for d in language_id.predict(docs, F.col("doc_id") < 100).collect()}
    assert [got[i] for i, _, _ in held] == [lang for _, _, lang in held]
    taken = language_id.samples(docs, F.col("doc_id") < 100)
    for lang, texts in taken.items():
        whole = [t for _, t, l in rows if l == lang]
        for t in texts:
            size = language_id.SAMPLE_CHARS // language_id.PLACES
            pieces = [t[i : i + size] for i in range(0, len(t), size + 1)]
            assert len(pieces) == language_id.PLACES and any(all(p in w for p in pieces) for w in whole)
