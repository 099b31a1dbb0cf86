"""Hybrid search ranks in blocks of an index: as brute force does, without a row for each request and chunk."""

import random

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import dense, lexical, overlap
from lectern.plans import search

_REQUEST = "query_id string, query string, tenant_id string, top_k int, mode string, acl array<string>, rerank boolean, current_only boolean"


def _tables(spark, r):
    words = [f"w{i}" for i in range(25)]
    acls = [None, [], ["public"], ["a"], ["a", "b"]]
    texts = [" ".join(r.choices(words, k=r.randrange(0, 7))) for _ in range(120)]
    chunks = [(f"c{i:03}", r.choice(texts), r.choice("tu"), r.choice(acls), r.choice([True, False]), None, 1, "x") for i in range(400)]
    requests = [(f"q{i:02}", " ".join(r.choices(words, k=4)), r.choice("tu"), r.choice([1, 3]), "hybrid", r.choice(acls), True, r.choice([True, False])) for i in range(30)]
    requests += [("none", "?!", "t", 3, "hybrid", None, True, False), ("lost", "w1 w2", None, 3, "hybrid", None, True, False)]
    chunks = spark.createDataFrame(chunks + chunks[:30], "chunk_id string, text string, tenant_id string, acl array<string>, is_current boolean, heading_path array<string>, page int, uri string")
    return spark.createDataFrame(requests, _REQUEST), chunks


def test_vectors_of_an_index_equal_brute_force(spark, monkeypatch):
    for name, most in (("ITEMS", 50), ("QUERIES", 7)):
        monkeypatch.setattr(overlap, name, most)
    monkeypatch.setattr(overlap.in_blocks, "__defaults__", (50,))
    requests, chunks = _tables(spark, random.Random(11))
    asked = requests.withColumn("_limit", F.col("top_k") * 2).withColumn("variant", F.explode(F.split("query", " (?=w2)"))).withColumn("terms", T.tokens(F.col("variant")))
    index = lexical.index(chunks, keep=("tenant_id", "acl", "is_current"), scope=("tenant_id",))
    found = dense.best_visible(asked, index, 16).join(index.select("number", "chunk_id"), "number")
    queries = dense.with_hash_embedding(asked, "variant", "dense", 16).select("query_id", "tenant_id", "acl", "current_only", "dense")
    stored = dense.with_hash_embedding(chunks.distinct(), "text", "dense", 16)
    pairs = queries.select("query_id", F.col("dense").alias("x")).crossJoin(stored.select("chunk_id", F.col("dense").alias("y")))
    scores = pairs.select("query_id", "chunk_id", F.round(dense.cosine(F.col("x"), F.col("y")), 9).alias("score")).where("score IS NOT NULL").groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    want = lexical.top(search.allowed_pairs(scores, requests, chunks.distinct()).join(requests.select("query_id", (F.col("top_k") * 2).alias("_limit")), "query_id"), "_limit")
    key = lambda x: (x.query_id, x.rank, x.chunk_id, x.score)
    got = sorted(map(key, found.collect()))
    assert got == sorted(map(key, want.collect())) and len(got) > 60


def test_hybrid_has_no_row_for_each_request_and_chunk(spark):
    requests, chunks = _tables(spark, random.Random(12))
    found = search.hybrid(requests, chunks)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "Generate" not in plan
    got = {}
    for x in found.collect():
        got.setdefault(x.query_id, []).append(x.contributions)
    # Copies tie, by id, however the sums of their terms were rounded.
    sparse = lexical.top(search.sparse(requests, chunks.distinct(), lexical.postings(chunks.distinct(), scope=("tenant_id",))).withColumn("score", F.round("score", 6)), 4)
    ranks = {(x.query_id, x.chunk_id): x.rank for x in sparse.where("rank <= 4").collect()}
    named = {(x.query_id, x.chunk_id): x.contributions["sparse"] for x in found.where("map_contains_key(contributions, 'sparse') AND contributions['sparse'] <= 4").collect()}
    assert len(got) == 30 and named and all(ranks[k] == v for k, v in named.items())


def test_hybrid_of_one_mode_only(spark):
    requests, chunks = _tables(spark, random.Random(13))
    for mode, name in (("sparse", "sparse"), ("dense", "dense")):
        found = search.hybrid(requests.withColumn("mode", F.lit(mode)), chunks).collect()
        assert found and all(list(x.contributions) == [name] for x in found)
    assert search.hybrid(requests.where("query_id = 'none'"), chunks).count() == 0
