"""The core's operators against small cases and plain Python specifications."""

import uuid

import pytest
from pyspark.sql import functions as F

from lectern.functions import identity
from lectern.functions import text as T
from lectern.functions.probit import probit
from lectern.operators import align, dense, fusion, intervals, lexical, positions, reuse, visibility
from lectern.sources import parse, store
from lectern.streaming import jobs


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")


def evaluate(spark, values, expression, kind="string"):
    rows = column(spark, values, kind).select("i", expression(F.col("x")).alias("y")).collect()
    return [r.y for r in sorted(rows, key=lambda r: r.i)]


def test_tokens_split_words_and_spread_ideographs(spark):
    got = evaluate(spark, ["Self-hosted 2nd x_y", "卷一 abc", "", None, "a卷"], T.tokens)
    assert got == [["self", "hosted", "2nd", "x_y"], ["卷", "一", "卷一", "abc"], [], [], ["a", "卷", "a卷"]]


def test_fold_keeps_length_and_protected_glyphs(spark):
    assert evaluate(spark, ["乾坤巻歳說書", None], T.fold) == ["乾坤卷岁说书", None]
    assert len(T.fold_table()[0]) == len(T.fold_table()[1]) > 2_500


def test_estimates_and_sentences(spark):
    assert evaluate(spark, ["", None, "abcd", "卷一", "a", "abcdefgh卷"], T.token_estimate) == [0, 0, 1, 2, 1, 3]
    assert evaluate(spark, ["a! b.c? d", "", "卷。"], T.sentences) == [["a!", " b.c?", " d"], [], ["卷。"]]


def test_rewrite(spark):
    got = evaluate(spark, ["What is winnowing, minimizers?", "  ", None, "卷一"], T.rewrite)
    assert got == [["What is winnowing, minimizers?", "winnowing, minimizers", "winnowing"], [], [], ["卷一"]]


def test_snippet_takes_the_densest_window(spark):
    text = "x" * 200 + " lamp lamp " + "y" * 200
    got = evaluate(spark, [text, "short lamp"], lambda c: T.snippet(c, F.array(F.lit("lamp")), 80))
    assert "lamp lamp" in got[0] and got[0].startswith("…") and got[0].endswith("…") and len(got[0]) <= 82
    assert got[1] == "short lamp"


def test_derived_ids_equal_python(spark):
    got = evaluate(spark, ["書|a", "", None], lambda c: identity.uuid5(identity.SPACES["chunk"], c))
    assert got == [str(uuid.uuid5(identity.SPACES["chunk"], "書|a")), str(uuid.uuid5(identity.SPACES["chunk"], "")), None]


def test_probit(spark):
    got = evaluate(spark, [0.5, 0.975, 0.001, 0.0, None], probit, "double")
    assert got[0] == pytest.approx(0, abs=1e-9) and got[1] == pytest.approx(1.959964, abs=1e-6) and got[2] == pytest.approx(-3.090232, abs=1e-6)
    assert got[3] is None and got[4] is None


def test_cumulative_and_following_by_group(spark):
    rows = [("a", k, 1) for k in range(50)] + [("b", 7, 2)]
    df = spark.createDataFrame(rows, "g string, k int, n int")
    got = {(r.g, r.k): (r.below, r.total) for r in positions.cumulative(df, ["g"], ["k"], "n").collect()}
    assert all(got[("a", k)] == (k, 50) for k in range(50)) and got[("b", 7)] == (0, 2)
    after = {(r.g, r.k): r.next for r in positions.following(df, ["g"], ["k"], "k", "next").collect()}
    assert all(after[("a", k)] == (k + 1 if k < 49 else None) for k in range(50)) and after[("b", 7)] is None


def test_positions_of_empty_tables(spark):
    df = spark.createDataFrame([], "g string, k int, n int")
    assert positions.cumulative(df, ["g"], ["k"], "n").count() == 0
    assert positions.following(df, ["g"], ["k"], "k", "next").count() == 0


def test_bm25_ranks_more_occurrences_higher_and_common_terms_low(spark):
    chunks = spark.createDataFrame([("1", "lamp lamp common"), ("2", "lamp word common"), ("3", "other common"), ("4", "common")], "chunk_id string, text string")
    terms = lexical.query_terms(spark.createDataFrame([("q", "lamp")], "query_id string, query string"))
    tf = lexical.postings(chunks)
    best = lexical.top(lexical.bm25(terms, tf), 2).orderBy("rank").collect()
    assert [r.chunk_id for r in best] == ["1", "2"]
    common = lexical.query_terms(spark.createDataFrame([("q", "common")], "query_id string, query string"))
    assert all(r.score < 1e-3 for r in lexical.bm25(common, tf, "clamped").collect())


def test_nearest_is_exact_and_ignores_unusable_vectors(spark):
    v = spark.createDataFrame([("a", "t", [1.0, 0.0]), ("b", "t", [2.0, 0.1]), ("c", "t", [0.0, 1.0]), ("d", "t", [0.0, 0.0]), ("e", "t", [1.0]), ("f", "t", None)], "chunk_id string, tenant_id string, dense array<double>")
    q = v.where("chunk_id = 'a'").withColumnRenamed("chunk_id", "query_id")
    got = lexical.top(dense.nearest(q, v, 2, 2), 2).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["b", "c"]


def test_rank_fusion(spark):
    hits = spark.createDataFrame([("q", "dense", "a", 0.9), ("q", "dense", "b", 0.8), ("q", "sparse", "b", 5.0), ("q", "sparse", "c", 4.0)], "query_id string, retriever string, chunk_id string, score double")
    best = lexical.top(fusion.reciprocal_rank(hits), 3).orderBy("rank").collect()
    assert best[0].chunk_id == "b" and best[0].contributions == {"dense": 2, "sparse": 1}
    assert {r.chunk_id for r in fusion.reciprocal_rank(hits, {"sparse": 0.0}).collect()} == {"a", "b"}


@pytest.mark.parametrize("acl, allowed, seen", [(["public"], ["team-a"], True), (["team-a"], ["team-a"], True), (["team-a"], ["team-b"], False), (["team-a"], [], True), (None, ["team-b"], True), ([], ["team-b"], True)])
def test_document_visibility(spark, acl, allowed, seen):
    df = spark.createDataFrame([(acl, allowed)], "acl array<string>, allowed array<string>")
    assert df.select(visibility.document_visible(F.col("acl"), F.col("allowed")).alias("y")).first().y is seen


def test_intervals(spark):
    df = spark.createDataFrame([("g", 0, 5), ("g", 5, 10), ("g", 20, 30), ("g", 25, 25), ("h", 1, 2)], "k string, start long, end long")
    merged = sorted((r.k, r.start, r.end) for r in intervals.merge(df, ["k"]).collect())
    assert merged == [("g", 0, 10), ("g", 20, 30), ("h", 1, 2)]
    cover = spark.createDataFrame([("g", 2, 4), ("g", 22, 40)], "k string, start long, end long")
    left = sorted((r.start, r.end) for r in intervals.subtract(intervals.merge(df, ["k"]).where("k = 'g'"), cover, ["k"]).collect())
    assert left == [(0, 2), (4, 10), (20, 22)]


def test_winnowing(spark):
    got = evaluate(spark, ["", "abcd", "abcde", "a" * 10, None], lambda c: F.size(reuse.fingerprints(c)))
    assert got[:4] == [0, 0, 1, 1]
    shared = "a common run of twenty-five characters"
    a, b = evaluate(spark, ["xyz " + shared, shared + " other"], reuse.fingerprints)
    assert set(a) & set(b)
    assert evaluate(spark, ["Hello  World again"], reuse.fingerprints) == evaluate(spark, ["hello world AGAIN"], reuse.fingerprints)


def test_alignment():
    import random

    r = random.Random(1)
    a, b = ("".join(r.choice("abcdefghij klmnop") for _ in range(2_000)) for _ in range(2))
    assert align.passages(a, b) == []
    run = "the quick brown fox jumps over the lazy dog and runs far away into the deep wood"
    assert align.passages(run, run) == [(0, len(run), 0, len(run), 1.0, "verbatim")]
    (p,) = align.passages(run, "head of it. " + run + " tail of it")
    assert p[2] == 10 and p[4] >= 0.95  # with the stop and blank before it
    assert align.passages(run[:40], run[:40]) == []
    chinese = "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏"
    (p,) = align.passages(chinese, "前文。" + chinese[:12] + "，" + chinese[12:] + "后文")
    assert p[4] >= 0.99
    assert align.passages("天地玄黄宇宙洪荒日月盈昃", "甲" + chinese)[0][5] == "short_exact"
    assert align.passages("", run) == align.passages("。。。，，，" * 9, run) == []


def test_one_place_is_one_passage():
    inside = [(10, 90, 510, 590, 0.92), (30, 88, 530, 588, 0.99), (31, 90, 700, 759, 0.99)]
    assert align.distinct_places(inside) == [1, 2]  # the better one of a place; another place of the source stays
    assert align.distinct_places([]) == [] and align.distinct_places(inside[:1]) == [0]


def test_decoding():
    assert parse.decode("é卷".encode("utf-8")) == "é卷"
    assert parse.decode("卷一".encode("gb18030")) == "卷一"
    assert parse.decode("ab".encode("utf-16")) == "ab"
    assert parse.decode("plain text".encode("utf-16-le")) == "plain text"
    assert parse.decode(b"") == ""


def test_markdown_sections_and_offsets():
    text = "# A\n\nintro\n\n## B\n\nfirst\nline\n\n### C\nx\n## D\ny"
    sections, blocks = parse.sections_and_blocks(text)
    assert [s["heading_path"] for s in sections] == [[], ["A"], ["A", "B"], ["A", "B", "C"], ["A", "D"]]
    assert all(text[b["char_start"] : b["char_end"]] == b["text"] for b in blocks)


def test_headings_of_books_are_promoted(spark):
    texts = ["第一章 天地\n正文。", "# Title\n第一章 天地", "卷之三\n序\n第一章，\n  第二节　人 "]
    assert evaluate(spark, texts, T.promote_headings) == ["## 第一章 天地\n正文。", texts[1], "## 卷之三\n## 序\n第一章，\n## 第二节　人"]


def test_documents_are_read_by_the_first_parser_that_takes_them(spark):
    files = spark.createDataFrame([("a.md", "第一章 天地\n正文。".encode("gb18030")), ("b.html", b"<h1>A</h1><p>x"), ("c.bin", b"x"), ("d.txt", None)], "path string, content binary")
    got = {r.path: r for r in parse.parse_documents(files).collect()}
    assert got["a.md"].sections[1].heading == "第一章 天地" and got["b.html"].blocks[0].text == "x"
    assert got["c.bin"].error == "no parser for .bin" and got["d.txt"].blocks == []
    assert {r.path: r.text for r in parse.decoded(files).collect()}["d.txt"] is None


def test_html():
    page = "<html><head><title>t</title></head><body><h1>A</h1><p>x <b>y</b></p><script>no</script><ul><li>z</li></ul></body></html>"
    assert parse.html_to_markdown(page) == "# A\n\nx y\n\n- z"
    assert parse.parse(b"x", "a.bin") == (None, None, "no parser for .bin")


def test_chunks_slice_back():
    text = "One! " * 900 + "卷" * 3000
    spans = parse.chunk_block(text)
    assert all(0 <= o <= a and b - a <= 4000 and text[a:b].strip() == text[a:b] for a, b, o in spans)
    assert "".join(text[a:b] for a, b, _ in spans).replace(" ", "") == text.replace(" ", "")
    assert parse.chunk_block("   ") == []
    assert parse.absorb_runts([(0, 100, 0), (101, 105, 0)], 80, 4000) == [(0, 105, 0)]


def test_index_maintenance(spark):
    index = spark.createDataFrame([("a", 1), ("b", 2)], "chunk_id string, n int")
    rows = spark.createDataFrame([("b", 9), ("c", 3)], "chunk_id string, n int")
    as_dict = lambda df: {r.chunk_id: r.n for r in df.collect()}
    assert as_dict(store.upsert(index, rows)) == {"a": 1, "b": 9, "c": 3}
    assert as_dict(store.update_only(index, rows)) == {"a": 1, "b": 9}
    assert as_dict(store.delete(index, rows)) == {"a": 1}


def test_publication_is_all_or_nothing(spark, tmp_path):
    p = store.Publication(spark, str(tmp_path / "index"))
    df = spark.createDataFrame([(1,)], "x int")
    p.write({"t": df})
    df.write.parquet(str(tmp_path / "index" / "t" / "batch_id=unpublished"))
    assert p.read("t").count() == 1
    p.write({"t": df})
    assert p.read("t").count() == 2
    p.write({"t": df}, replace=True)
    assert p.read("t").count() == 1


def test_paths_stay_under_their_roots(tmp_path):
    assert store.allowed_path(str(tmp_path / "a"), [str(tmp_path)])
    with pytest.raises(PermissionError):
        store.allowed_path(str(tmp_path / ".." / "x"), [str(tmp_path)])


def test_state_machines(spark):
    log = spark.createDataFrame([("j", 1, "parsing"), ("j", 2, "completed"), ("j", 3, "chunking"), ("k", 1, "cancelled"), ("k", 2, "pending")], "job_id string, seq long, state string")
    got = {r.job_id: (r.state, r.applied, r.rejected) for r in jobs.replay(log, jobs.INGEST).collect()}
    assert got == {"j": ("chunking", 2, 1), "k": ("pending", 2, 0)}
    assert {r.job_id: r.state for r in jobs.current_states(log).collect()} == {"j": "chunking", "k": "pending"}


def test_exact_rate_limit_as_a_stream(spark, tmp_path):
    import datetime as dt

    rows = [("u", dt.datetime(2024, 1, 1, 0, 0, s), s) for s in (0, 1, 2, 3, 59)] + [("u", dt.datetime(2024, 1, 1, 0, 1, 1), 61)]
    spark.createDataFrame(rows, "key string, ts timestamp, id long").coalesce(1).write.parquet(str(tmp_path / "in.parquet"))
    stream = spark.readStream.schema("key string, ts timestamp, id long").parquet(str(tmp_path / "in.parquet"))
    jobs.drain(jobs.allow_requests(stream, 3), str(tmp_path / "out"), str(tmp_path / "log"))
    got = {r.id: r.allowed for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {0: True, 1: True, 2: True, 3: False, 59: False, 61: True}


def test_no_query_of_the_core_plans_a_cartesian_product(spark):
    from lectern import catalog

    for name in ("f16_bm25", "r04_candidates", "j07_span_overlap", "p02_filter"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name


def test_filters_reach_the_scan(spark):
    from lectern import catalog

    plan = catalog.QUERIES["p05_current"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(is_current)" in plan
