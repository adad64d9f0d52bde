"""Cases around hot keys, names that clash, and results against plain loops."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_edges import LONG, TEXTS, lines_by_hand, mutated, prose, shingle_set

import corpus_pipeline as P
from deltaview.llm import decontaminate, embedding_dedup, language_id, line_dedup, ngram_join, suffix_dedup, toxicity
from deltaview.llm import queries as Q

ODD = "doc_id long, text string, lang string, source string, n_chars long, n_lines long, dropped string, `__dropped` string, version long, c0 int, lines string"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "s", len(t or ""), 7, "d", "e", 8, 9, "f") for i, t in TEXTS]
    return spark.createDataFrame(rows, ODD)


def test_line_dedup_names_and_nulls(spark, odd):
    out = line_dedup.dedup_lines(odd, 1, 2)
    assert out.columns == [c for c in odd.columns if c != "n_lines"] + ["n_lines", "n_dropped"]
    expected = lines_by_hand([(i, t) for i, t in TEXTS if i is not None], 1, 2)
    got = line_dedup.digest(odd, 1, 2).where("doc_id is not null").collect()
    assert sorted(map(tuple, got)) == expected
    assert {tuple(r) for r in out.where("doc_id is null").select("text", "n_dropped").collect()} == {(t, 0) for i, t in TEXTS if i is None}
    line = "a line of more than forty characters, all told"
    for ids, dropped in (([1, 2, 3, 4, None], 0), ([1, 2, 3, 4, 5, None], 4)):
        rows = spark.createDataFrame([(i, line) for i in ids], "doc_id long, text string")
        assert line_dedup.digest(rows).agg(F.sum("n_dropped")).head()[0] == dropped


def test_line_dedup_versions(spark):
    """Rows of one doc_id and different texts lose their own lines only."""
    rows = [(i, "x\ncommon") for i in range(5)] + [(2, "common\ny\ncommon"), (2, "z\ny")]
    got = line_dedup.cleaned(spark.createDataFrame(rows, "doc_id long, text string"), 3, 5)
    assert Counter(map(tuple, got.collect())) == Counter([*((i, "x") for i in range(4)), (4, "x\ncommon"), (2, "y"), (2, "z\ny")])


def test_line_dedup_hot_line(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "LEAST_ROWS", 10)
    rows = [(i, f"own line {i}\nthe common line\nshared by {i % 40}\nthe common line") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, line_dedup.digest(df, 5, 5).collect())) == lines_by_hand(rows, 5, 5)


def test_line_dedup_streams(spark, odd):
    """Windows stand on the range exchange and its one sort."""
    plan = line_dedup._streamed(line_dedup._places(odd.select("doc_id", "text"), 1), 2, 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("rangepartitioning") == 1 and plan.count("Window [") == 2 and plan.count("Sort [") == 1


def test_stages_on_odd_tables(spark, odd, tmp_path):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    for docs in (odd, odd.where("false")):
        for name, stage in P.STAGES:
            out = stage(spark, docs, str(tmp_path))
            rows = out.collect()
            if name == "sentencepiece":
                assert len(rows) == docs.count() and all(r["n_tokens"] == len(r["ids"]) for r in rows)
            else:
                assert out.columns == docs.columns and all(r["n_lines"] == 7 and r["c0"] == 9 for r in rows)
            if rows:
                kept = {r["doc_id"] for r in rows}
                assert None in kept and {1, 2, 3} <= kept  # nothing to judge: null, empty and blank texts stay


@pytest.mark.parametrize("many", [2_000, 3])
def test_ngram_pairs_are_verified_once(spark, monkeypatch, many):
    """Around the threshold, with all shingles of groups frequent, too."""
    monkeypatch.setattr(ngram_join, "TOKEN_SETS", many)
    monkeypatch.setattr(ngram_join, "CELL_PAIRS", 10_000 if many > 100 else 7)
    seen = []
    verified = ngram_join._verified
    monkeypatch.setattr(ngram_join, "_verified", lambda texts, pairs, *rest: (seen.extend(map(tuple, pairs.collect())), verified(texts, pairs, *rest))[1])
    texts = [" ".join(mutated(prose(90, g).split(), 0.004 * (n % 6), 100 * g + n)) for g in range(3) for n in range(18)]
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root[a], root[b]))
                root = [x if r == y else r for r in root]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.link(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == dict(enumerate(root)) and len(seen) > 20
    assert max(Counter(tuple(sorted(p)) for p in seen).values()) == 1


def test_ngram_join_by_shuffle(spark, monkeypatch):
    """Beyond TABLE_IDS, texts go to ids by a join."""
    rows = [(i, prose(60, i // 2)) for i in range(10)] + [(20, prose(60, 0) + " x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    before = sorted(map(tuple, ngram_join.link(df).collect()))
    monkeypatch.setattr(ngram_join, "TABLE_IDS", 0)
    assert sorted(map(tuple, ngram_join.link(df).collect())) == before


def test_hot_passage(spark, monkeypatch):
    """One passage in many random surroundings: no collection of an anchor exceeds HOT segments."""
    monkeypatch.setattr(suffix_dedup, "HOT", 20)
    r = random.Random(5)
    word = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    passage = word(104)
    rows = [(i, word(150) + passage + word(150)) for i in range(300)]
    largest = []
    inner = suffix_dedup._sorted_out

    def counted(segments):
        largest.append(segments.groupBy("key").count().agg(F.max("count")).head()[0] or 0)
        return inner(segments)

    monkeypatch.setattr(suffix_dedup, "_sorted_out", counted)
    for ids in (4_000_000, 0):
        monkeypatch.setattr(suffix_dedup, "TABLE_IDS", ids)
        got = sorted(map(tuple, suffix_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()))
        assert got == suffix_dedup.brute_force([(i, t.encode()) for i, t in rows])
    assert max(largest) <= 20


def test_short_items(spark, duck):
    """Code and SQL agree on items of fewer than five words, and in blocks of a few items."""
    docs = spark.createDataFrame([(1, "one two three four five six seven"), (2, "Three FOUR"), (3, "threefour"), (4, None), (5, LONG[:300]), (6, "one two three four five x")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "three four"), (2, "seven"), (3, "one two three four five six seven"), (4, ""), (5, None), (6, LONG[20:120]), (7, "one two three four five")], "item_id long, text string")
    duck.register("short_docs", docs.toPandas())
    duck.register("short_items", items.toPandas())
    sql = Q.oracle_sql()["op8_benchmark_decontamination"].replace("FROM documents", "FROM short_docs").replace("FROM benchmark", "FROM short_items")
    expected = sorted(duck.execute(sql).fetchall())
    assert sorted(map(tuple, decontaminate.contained(docs, items).collect())) == expected and {(1, 1), (2, 1), (1, 2)} <= {r[:2] for r in expected}
    decontaminate.BLOCK_ITEMS, before = 2, decontaminate.BLOCK_ITEMS
    try:
        blocks = list(decontaminate._item_blocks(items.unionByName(items), "item_id", "text"))
        assert [len(b[0]) for b in blocks] == [2] * 7
        assert sorted(map(tuple, decontaminate.contained(docs, items).collect())) == expected
    finally:
        decontaminate.BLOCK_ITEMS = before


def test_embeddings_of_one_id(spark):
    """Rows that share a vec_id, and all results against all pairs."""
    r = np.random.default_rng(4)
    base = r.normal(size=(12, 16))
    x = np.concatenate([base, base + 0.1 * r.normal(size=base.shape), base[:4] + 0.15 * r.normal(size=(4, 16))])
    ids = [1, 1, *range(2, len(x))]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.93) & ~np.eye(len(x), dtype=bool)
    group = {i: i for i in ids}
    for a, b in zip(*np.nonzero(links), strict=True):
        low, high = sorted((group[ids[a]], group[ids[b]]))
        group = {k: low if v == high else v for k, v in group.items()}
    rows = spark.createDataFrame([(i, v.tolist(), 3) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>, label int")
    got = Counter(map(tuple, embedding_dedup.near_duplicates(rows).collect()))
    assert got == Counter((i, int(links[n].sum()), group[i], group[i] == i) for n, i in enumerate(ids))


def test_language_choice():
    """Language and score against phrases cut one by one."""
    samples = {"aa": ["the cat sat on the mat with the hat"], "bb": ["der hund lag auf dem sofa mit dem ball"], "cc": ["le chat dort sur le lit avec la balle"]}
    parser = language_id.CrossParser(samples)
    texts = ["the hat on the cat", "dem hund der ball", "la balle sur le chat", "mat ball lit", "xyz the"]
    for text, lang, score in zip(texts, *parser.predict(texts), strict=True):
        cost = {}
        for name, sample in samples.items():
            body, n, at = " ".join(sample).lower(), 0, 0
            while at < len(text):
                end = at + 1
                while end < len(text) and text[at : end + 1] in body:
                    end += 1
                n, at = n + 1, end
            cost[name] = n * np.log2(len(body))
        best = min(sorted(cost), key=cost.get)
        low, second = sorted(cost.values())[:2]
        assert lang == best and score == pytest.approx(min(1.0, second / low - 1))


def test_toxicity_forward():
    """Scores against loops over windows, words, gates and n-grams."""
    net = toxicity.Net.new(3)
    net.prior = 0.25
    texts = ["Plain words, here. " * 30, "one", "", "  ", "é ü 🙂 " * 9 + "end"]
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    h = toxicity.HIDDEN

    def embedded(word):
        bucket, grams, _ = toxicity.hashed([toxicity.bare(word)])
        return np.concatenate([p["Ew"][bucket[0]], 0.25 * sum((p["Ec"][g] for g in grams), np.zeros(toxicity.CHAR_DIM))])

    def run(words, k):
        state, out = np.zeros(h), []
        for w in words:
            x, a = embedded(w) @ p[f"W{k}"] + p[f"c{k}"], state @ p[f"U{k}"]
            z, r = sigmoid(x[:h] + a[:h]), sigmoid(x[h : 2 * h] + a[h : 2 * h])
            new = np.tanh(x[2 * h :] + r * a[2 * h :])
            state = (1 - z) * new + z * state
            out.append(state)
        return out

    def logit(words):
        states = [np.concatenate(s) for s in zip(run(words, "f"), run(words[::-1], "b")[::-1], strict=True)]
        weight = np.exp([s @ p["v"] for s in states])
        return sum(w * s for w, s in zip(weight / weight.sum(), states, strict=True)) @ p["w"] + p["b"][0]

    for text, got in zip(texts, toxicity.Scorer(net).scores(texts), strict=True):
        words, begin, tops = text.split(), 0, []
        while words:
            tops.append(logit(words[begin : begin + toxicity.WINDOW]))
            if begin + toxicity.WINDOW >= len(words):
                break
            begin += toxicity.STRIDE
        assert got == pytest.approx(sigmoid(max(tops)) if tops else 0.25, abs=1e-4)
