"""Operators do the whole job: nothing is left out by rank, number or kind."""

import random

import numpy as np

from pyspark.sql import functions as F

from lectern import catalog
from lectern.operators import align, dense, lexical
from lectern.plans import search


def _noise(r: random.Random, n: int) -> str:
    return "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))


def test_reuse_is_found_behind_many_chance_hits(spark, tmp_path):
    r = random.Random(3)
    common, passage = _noise(r, 16), _noise(r, 300)
    rows = [(i, _noise(r, 100) + common + _noise(r, 100)) for i in range(1, 61)]
    rows += [(100, common + _noise(r, 50) + passage), (150, _noise(r, 80) + passage)]
    rows += [(i, _noise(r, 40)) for i in range(201, 400)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(x.query_id, x.document_id): x.matched_chars for x in catalog.QUERIES["r11_reuse_report"](spark, str(tmp_path)).collect()}
    assert list(got) == [(100, 150)] and 300 <= got[100, 150] <= 310


def test_blocks_of_probes_align_like_every_pair(spark, monkeypatch):
    monkeypatch.setattr(align, "BLOCK", 2)
    r = random.Random(4)
    run, chinese = _noise(r, 90), "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏"
    texts = ["A [1] " + run, run[:40] + "  [12]" + run[40:].upper(), _noise(r, 200), chinese, "前文。" + chinese[:13] + "，" + chinese[13:], chinese[:13], "ﬁ " + run[:60], ""]
    f = list(range(5))
    probes = spark.createDataFrame([(i, t, f) for i, t in enumerate(texts[:7])], "query_id long, text string, f array<bigint>")
    documents = spark.createDataFrame([(i, t, f) for i, t in enumerate(texts)], "document_id long, text string, f array<bigint>")
    got = sorted(map(tuple, align.align_probes(probes, documents, 5).collect()))
    assert got == sorted((i, j, *p) for i, a in enumerate(texts[:7]) for j, b in enumerate(texts) if i != j for p in align.passages(a, b))
    assert {x[:2] for x in got} >= {(0, 1), (0, 6), (3, 4), (5, 3)}
    assert align.align_probes(probes, documents, 6).count() == 0


def test_text_without_places_is_the_normal_form():
    samples = ["A [1]  b　ﬁ İß [note 2] Σ", "卷一，天 地。", "", "x\n\n[12] y", "½ ㎏ ｶﾞ"]
    assert all(align.normal_text(t, p) == align.normal_form(t, p).text for t in samples for p in ("generic", "zh"))
    assert len(align.gram_hashes("abcab", 2)) == 3 and align.gram_hashes("a", 2).dtype == np.uint64


def test_vectors_reach_chunks_without_a_lexical_place(spark):
    requests = spark.createDataFrame([("q", "lamp", "t", ["a"], True)], "query_id string, query string, tenant_id string, acl array<string>, current_only boolean")
    # 45 short chunks fill the lexical pool; the long one has the direction of the request, at a lower BM25 rank.
    rows = [(f"c{i:02}", f"lamp w{i}", "t", ["a"], True) for i in range(45)] + [("far", "lamp " * 40 + "x y", "t", ["a"], True)]
    rows += [("other", "lamp", "u", ["a"], True), ("old", "lamp", "t", ["a"], False), ("hidden", "lamp", "t", ["b"], True), ("unlisted", "lamp", "t", None, True)]
    chunks = spark.createDataFrame(rows, "chunk_id string, text string, tenant_id string, acl array<string>, is_current boolean")
    got = [x.chunk_id for x in lexical.top(search.dense(requests, chunks, 5), 5).orderBy("rank").collect()]
    assert len(got) == 5 and got[0] == "far" and not {"other", "old", "hidden", "unlisted"} & set(got)


def test_visible_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK", 3)
    r = random.Random(5)
    vector = lambda: [float(r.randint(-2, 2)) for _ in range(4)]
    acls = [None, [], ["public"], ["a"], ["a", "b"]]
    q = [(f"q{i}", r.choice("tu"), r.choice(acls), r.choice([True, False]), vector()) for i in range(8)]
    c = [(f"c{i:03}", r.choice("tu"), r.choice(acls), r.choice([True, False]), vector()) for i in range(200)]
    queries = spark.createDataFrame(q, "query_id string, tenant_id string, acl array<string>, current_only boolean, dense array<double>")
    chunks = spark.createDataFrame(c, "chunk_id string, tenant_id string, acl array<string>, is_current boolean, dense array<double>")
    got = {(x.query_id, x.rank): x.chunk_id for x in lexical.top(dense.nearest_visible(queries, chunks, 5, 4), 5).collect()}
    pairs = queries.select("query_id", F.col("dense").alias("x")).crossJoin(chunks.select("chunk_id", F.col("dense").alias("y")))
    hits = pairs.select("query_id", "chunk_id", F.round(dense.cosine(F.col("x"), F.col("y")), 9).alias("score")).where("score IS NOT NULL")
    want = lexical.top(search.allowed_pairs(hits, queries, chunks), 5)
    assert got == {(x.query_id, x.rank): x.chunk_id for x in want.collect()} and len(got) >= 30


def test_snippets_are_cut_from_prose_too(spark):
    d = "/root/testdata/sf0.001"
    got = {x.chunk_id for x in catalog.QUERIES["f20_snippets"](spark, d).select("chunk_id").distinct().collect()}
    hit = catalog.requests(spark, d).where("query IS NOT NULL").join(catalog.delivered_once(spark, d, "fused_hits", "query_id", "document_id"), "query_id")
    blocks = catalog.blocks(spark, d, "id", "document_id", "kind", "text").where("text IS NOT NULL").join(hit, "document_id", "left_semi")
    assert got == {x.id for x in blocks.collect()} and blocks.where("kind = 'text'").count()
