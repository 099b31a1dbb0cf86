"""The best items by shared features against brute force, and what leaves a task."""

import random

import numpy as np
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import lexical, overlap, reuse


def test_best_items_over_blocks_equal_brute_force():
    r = random.Random(5)
    queries = [sorted(r.sample(range(30), r.randrange(0, 6))) for _ in range(40)]
    own = [r.randrange(9) for _ in queries]
    audience = [r.randrange(2) for _ in queries]
    items = [sorted(r.sample(range(30), r.randrange(0, 12))) for _ in range(300)]
    group, open_to = np.array([r.randrange(9) for _ in items]), np.array([[r.random() < 0.6, True] for _ in items])
    k = 7
    starts = np.concatenate([[0], np.cumsum([len(q) for q in queries])])
    asked = overlap.Queries(starts, np.array([f for q in queries for f in q], dtype=np.int32), np.full(40, k), own=np.array(own), audience=np.array(audience))
    got = {}
    for low in range(0, 300, 100):
        rows = [(i, f) for i, x in enumerate(items[low : low + 100]) for f in x]
        seen = {a: open_to[low : low + 100, a] for a in (0, 1)}
        for q, at, value in zip(*asked.best(100, np.array([x[0] for x in rows]), np.array([x[1] for x in rows]), None, group[low : low + 100], seen)):
            got.setdefault(int(q), []).append((-value, int(at) + low))
    for i, q in enumerate(queries):
        want = sorted((-len(set(q) & set(x)), j) for j, x in enumerate(items) if set(q) & set(x) and group[j] != own[i] and open_to[j, audience[i]])
        assert sorted(got.get(i, []))[:k] == want[:k]


def test_bm25_of_an_index_equals_the_join_and_no_pair_is_a_row(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(40)] + ["向量的索引", "Œuvre", "a_b"]
    chunks = [(f"c{i:04}", " ".join(["common", *r.choices(words, k=r.randrange(0, 9))])) for i in range(400)]
    chunks += chunks[:20] + [("empty", ""), ("nothing", "...")]
    df = spark.createDataFrame(chunks, "chunk_id string, text string")
    asked = spark.createDataFrame([(f"q{i:03}", " ".join(["common", *r.choices(words, k=3)])) for i in range(60)] + [("none", "?"), ("unknown", "zzz")], "query_id string, query string")
    stored = lexical.index(df)
    made = {x.chunk_id: (x.a, x.b) for x in stored.join(df.distinct(), "chunk_id").select("chunk_id", F.col("terms").alias("a"), T.tokens(F.col("text")).alias("b")).collect()}
    assert len(made) == 402 and all(a == b for a, b in made.values())
    best = lexical.best(asked.select("query_id", T.tokens(F.col("query")).alias("terms")), stored, 5)
    joined = lexical.bm25(lexical.query_terms(asked), lexical.postings(df.distinct())).withColumn("score", F.round("score", 6))
    key = lambda x: (x.query_id, x.rank, x.chunk_id, x.score)
    assert sorted(map(key, best.collect())) == sorted(map(key, lexical.top(joined, 5).collect()))

    def every(table):
        n = table.num_rows
        yield n, [table["number"].combine_chunks()], np.arange(n), np.zeros(n, np.int32), None, None, None

    # Every chunk shares a word with every query; a task returns five of them.
    pairs = overlap.scored(stored.select("number", "terms"), overlap.Queries(np.arange(61), np.zeros(60, np.int32), np.full(60, 5)), {"number": "long"}, every)
    assert pairs.count() <= 60 * 5 * spark.sparkContext.defaultParallelism


def test_f16_keeps_ten_chunks_with_ties_by_id(spark, tmp_path):
    from lectern.catalog import QUERIES

    # Copies under many ids, delivered twice, that all tie.
    rows = [(f"b{i:03}", "lamp oil" if i % 2 else "lamp") for i in range(200)] * 2
    spark.createDataFrame(rows, "id string, text string").write.parquet(f"{tmp_path}/blocks.parquet")
    asked = [(f"q{i}", "lamp" if i else None, "t", 10, "hybrid", ["public"], True, True) for i in range(30)]
    spark.createDataFrame(asked, "query_id string, query string, tenant_id string, top_k int, mode string, acl array<string>, rerank boolean, current_only boolean").write.parquet(f"{tmp_path}/requests.parquet")
    found = QUERIES["f16_bm25"](spark, str(tmp_path))
    # 6,000 pairs of a request and a chunk: none is a row of a join.
    assert "MapInArrow" in found._jdf.queryExecution().toString()
    got = {}
    for x in found.collect():
        got.setdefault(x.query_id, {})[x.rank] = x.chunk_id
    assert len(got) == 29 and all([r[i] for i in range(1, 11)] == [f"b{j:03}" for j in range(0, 20, 2)] for r in got.values())


def test_f16_keeps_copies_side_by_side_on_disk(spark, tmp_path):
    from pathlib import Path

    from lectern.catalog import QUERIES
    from lectern.session import shared_dir

    r = random.Random(11)
    texts = [" ".join(f"w{r.randrange(10**9)}" for _ in range(40)) for _ in range(300)]
    rows = [(f"{c:02}-{i:03}", t) for i, t in enumerate(texts) for c in range(20)]
    rows += rows[:20]
    spark.createDataFrame(rows, "id string, text string").coalesce(1).write.parquet(f"{tmp_path}/blocks.parquet")
    asked = [(f"q{i:03}", texts[i].split()[0], "t", 10, "hybrid", ["public"], True, True) for i in range(0, 300, 50)]
    spark.createDataFrame(asked, "query_id string, query string, tenant_id string, top_k int, mode string, acl array<string>, rerank boolean, current_only boolean").write.parquet(f"{tmp_path}/requests.parquet")
    size = lambda: sum(p.stat().st_size for p in Path(shared_dir(spark).removeprefix("file://")).rglob("*.parquet"))
    before = size()
    got = sorted((x.query_id, x.rank, x.chunk_id) for x in QUERIES["f16_bm25"](spark, str(tmp_path)).collect())
    assert got == [(f"q{i:03}", k + 1, f"{k:02}-{i:03}") for i in range(0, 300, 50) for k in range(10)]
    # Ordered by id, the copies of a text lie 300 rows apart, too far for the compression.
    assert size() - before < 350_000, size() - before


def test_best_shared_counts_documents_and_leaves_out_the_own(spark):
    r = random.Random(8)
    docs = {d: [sorted(r.sample(range(100, 160), r.randrange(0, 14))) + ([1] if d % 2 else []) for _ in range(r.randrange(1, 5))] for d in range(60)}
    docs[0], docs[10] = [[1], [1, 1_000]], [[], []]
    rows = [(d, i, f) for d, x in docs.items() for i, f in enumerate(x)]
    prints = spark.createDataFrame(rows, "document_id long, chunk_index long, f array<bigint>").coalesce(1)
    got = sorted(tuple(x) for x in reuse.best_shared(prints.where("document_id % 10 = 0"), prints, 4).collect())
    held = {d: {f for x in fs for f in x} for d, fs in docs.items()}
    limit = max(1, sum(map(bool, held.values())) // 4)
    stop = {f for x in held.values() for f in x if sum(f in y for y in held.values()) > limit}
    assert 1 in stop
    want = []
    for d, i, f in rows:
        if d % 10 == 0 and f:
            use = set(f) - stop or set(f)
            shared = sorted((-len(use & set(g)), e, j) for e, j, g in rows if e != d and use & set(g))
            want += [(d, i, e, j, -n) for n, e, j in shared[:4]]
    assert got == sorted(want)


def test_md5_of_all_grams_at_once(spark):
    texts = ["", "abcd", "abcde", "straße 向量的索引 🙂🙃🙂🙃🙂🙃 naïve", "x" * 40, "é𝔘\x00\n" * 9]
    got = reuse.md5_grams(texts, 5)
    assert [g.tolist() for g in got] == [[reuse._md5(t[i : i + 5].encode()) for i in range(len(t) - 4)] for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for k, w in ((5, 8), (3, 5), (4, 1)):
        for x in reuse.with_fingerprints(df, "text", "f", "md5", k, w).collect():
            t = x.text.lower().replace("\n", " ").strip(" ")
            h = [reuse._md5(t[i : i + k].encode()) for i in range(len(t) - k + 1)]
            assert x.f == sorted({min(h[i : i + w]) for i in range(max(1, len(h) - w + 1))} if h else ())


def test_r04_of_a_common_text_keeps_what_shares_most(spark, tmp_path):
    from lectern.catalog import QUERIES

    # One text in all documents: its fingerprints are stopped, but the probe has no others.
    rows = [(i, "the same sentence in every document of the table" + ("" if i % 2 else " and some more words")) for i in range(1, 140)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["r04_candidates"](spark, str(tmp_path))
    assert found.columns == ["query_id", "document_id", "shared"]
    # Fingerprints of the longer text are in half of the documents, which is too many as well.
    got = sorted(tuple(x) for x in found.collect())
    assert [x[:2] for x in got] == [(100, i) for i in range(2, 102, 2) if i != 100] + [(100, 102)] and len({x[2] for x in got}) == 1
    assert "Join" not in found._jdf.queryExecution().toString().split("MapInArrow")[-1]
