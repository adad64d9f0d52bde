"""The registered corpus queries on whole small tables: against SQL, brute force, the
tokenizers' own libraries, or held-out labels."""

import hashlib
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
import public_tokenizers

from deltaview.llm import queries as Q
from deltaview.llm import suffix_dedup

SF2 = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(sf):
    t = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    return {r["doc_id"]: r["text"] for r in t}


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_against_sql(name, spark, sf, duck, rows_of):
    assert rows_of(Q.queries()[name](spark, sf)) == rows_of(duck.execute(Q.oracle_sql()[name]).df())


def test_suffix_dedup(spark, sf, documents):
    got = sorted(tuple(r) for r in Q.op2_suffix_dedup(spark, sf).collect())
    assert got == suffix_dedup.brute_force([(i, t.encode()) for i, t in documents.items()])


def test_suffix_dedup_with_split_anchors(spark, sf, documents, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 2)
    got = sorted(tuple(r) for r in Q.op2_suffix_dedup(spark, sf).collect())
    assert got == suffix_dedup.brute_force([(i, t.encode()) for i, t in documents.items()])


def test_sentencepiece(spark, sf, documents):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in Q.op3_sentencepiece(spark, sf).collect():
        ids = sp.encode(documents[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def library(texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode_batch(texts, add_special_tokens=False)]


def test_token_counts(spark, sf, documents):
    counts = dict(zip(documents, map(len, library(list(documents.values()))), strict=True))
    rows = Q.op4_token_counts(spark, sf).collect()
    assert len(rows) == len(documents)
    for r in rows:
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(documents[r["doc_id"]].encode()), counts[r["doc_id"]], counts[r["doc_id"]] > 512)


def test_token_files(spark, sf, documents):
    ids = {i: [*x, 2] for (i, _), x in zip(documents.items(), library(list(documents.values())), strict=True)}
    rows = {r["doc_id"]: r for r in Q.op9_token_files(spark, sf).collect()}
    start = 0
    for doc_id in sorted(documents):
        r = rows[doc_id]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids[doc_id]), zlib.crc32(np.array(ids[doc_id], "<u4").tobytes()))
        start += len(ids[doc_id])


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_language_id(spark):
    t = pq.read_table(f"{SF2}/documents.parquet").to_pylist()
    lang = {r["doc_id"]: r["lang"] for r in t}
    rows = Q.op10_language_id(spark, SF2).collect()
    assert len(rows) == len(t) and all(r["held_out"] == held_out(r["doc_id"]) and 0 <= r["score"] <= 1 for r in rows)
    test = [r["lang_pred"] == lang[r["doc_id"]] for r in rows if r["held_out"]]
    assert np.mean(test) > 0.95


def test_toxicity(spark):
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{SF2}/labels.parquet").to_pylist()}
    rows = Q.op6_toxicity(spark, SF2).collect()
    assert len(rows) == 1000 and all(r["held_out"] == held_out(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    test = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    ones, zeros = [s for s, y in test if y], [s for s, y in test if not y]
    assert np.mean([a > b for a in ones for b in zeros]) > 0.8  # area under the curve; a few dozen labels to learn from


def test_embeddings(spark, sf):
    t = pq.read_table(f"{sf}/embeddings.parquet").to_pylist()
    rows = {r["vec_id"]: r for r in Q.op7_embedding_dedup(spark, sf).collect()}
    assert len(rows) == len(t)
    x = np.array([r["embedding"] for r in t], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r["label"] for r in t])
    links = (x @ x.T >= 0.93) & (label[:, None] == label) & ~np.eye(len(t), dtype=bool)
    assert [rows[r["vec_id"]]["n_links"] for r in t] == links.sum(1).tolist()


def test_pipeline(spark, sf, documents, duck):
    """Each stage on what the one before it kept."""
    import corpus_pipeline as P
    from deltaview.llm.runtime import stored

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in P.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf), f"test-{name}")
        assert docs.columns == columns
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    toxic, lines, near, clean = kept
    assert set(lines) == set(toxic) and 0 < len(near) < len(lines) and set(clean) <= set(near)
    assert all(near[i] == lines[i] for i in near)
    duck.register("stage_docs", spark.createDataFrame(list(toxic.items()), "doc_id long, text string").toPandas())
    sql = Q.oracle_sql()["op5_line_dedup"].replace("FROM documents", "FROM stage_docs")
    assert {r[0]: r[3] for r in duck.execute(sql).fetchall()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in lines.items()}
    duck.register("line_docs", spark.createDataFrame(list(lines.items()), "doc_id long, text string").toPandas())
    sql = Q.oracle_sql()["op1_ngram_jaccard"].replace("FROM documents", "FROM line_docs")
    assert {r[0] for r in duck.execute(sql).fetchall() if r[0] == r[2]} == set(near)
    leaked = {r[0] for r in duck.execute(Q.oracle_sql()["op8_benchmark_decontamination"]).fetchall()}
    assert not leaked & set(clean) or all(lines[i] != documents[i] for i in leaked & set(clean))
    last = {r["doc_id"]: r for r in P.STAGES[-1][1](spark, docs, sf).collect()}
    assert set(last) == set(clean)
    assert all(last[i]["decoded_sha256"] == hashlib.sha256(clean[i].encode()).hexdigest() for i in clean)
