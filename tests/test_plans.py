"""Metadata, reading, reports, projections and stores on small and awkward inputs."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lectern.functions import highlights
from lectern.operators import intervals, positions, projection
from lectern.plans import metadata, reading, reports, search
from lectern.session import bounded, written
from lectern.sources import store


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_spans_of_a_hot_group_equal_brute_force(spark):
    r = random.Random(2)
    spans = [("hot" if r.random() < 0.7 else f"g{r.randrange(3)}", s := r.randrange(40_000), s + r.randrange(0, 300)) for _ in range(400)]
    df = spark.createDataFrame(spans, "g string, start long, end long")
    want, covered = [], {}
    for g in {x[0] for x in spans}:
        at = set()
        for k, s, e in spans:
            if k == g:
                at.update(range(s, e))
        covered[g] = at
        for x in sorted(at):
            if x - 1 not in at:
                want.append([g, x, x + 1])
            want[-1][2] = x + 1
    merged = rows(intervals.merge(df, ["g"]), "g", "start", "end")
    # Touching spans are one: what is covered without a gap.
    assert merged == sorted(map(tuple, want), key=str)
    other = df.select("g", F.col("start").alias("s"), F.col("end").alias("e"), F.monotonically_increasing_id().alias("i"))
    pairs = intervals.overlapping(df.where("g <> 'hot'"), other, ["g"], ("start", "end"), ("s", "e"))
    few = [x for x in spans if x[0] != "hot"]
    assert pairs.count() == sum(a[0] == b[0] and a[2] > b[1] and b[2] > a[1] and a[2] > a[1] and b[2] > b[1] for a in few for b in spans)
    left = intervals.subtract(spark.createDataFrame([("hot", 0, 40_300)], "g string, start long, end long"), df.where("g = 'hot'"), ["g"])
    assert sum(e - s for s, e in rows(left, "start", "end")) == 40_300 - len(covered["hot"])
    empty = df.where("1 = 0")
    assert intervals.merge(empty, ["g"]).count() == intervals.gaps(empty, ["g"]).count() == 0


def test_positions_of_a_group_cut_into_ranges(spark):
    df = spark.createDataFrame([("a", i, (i * 7919) % 101) for i in range(200)] + [("b", 1, 5)], "g string, i int, v int")
    got = {(x.g, x.i): x.top for x in positions.reached(df, ["g"], ["i"], "v", "top").collect()}
    assert got["a", 0] is None and got["b", 1] is None
    assert all(got["a", i] == max((j * 7919) % 101 for j in range(i)) for i in range(1, 200))
    assert [n for _, n in rows(intervals.numbered(df, ["g"], ["i"], first=1), "g", "ordinal")].count(1) == 2


def test_written_tables_and_bounded_sides(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, s string")
    assert written(df).count() == 2 and bounded(df, 1).count() == bounded(df, 10).count() == 2
    assert written(df.where("1 = 0")).count() == 0
    assert "BroadcastExchange" in df.join(bounded(df, 10), "i")._jdf.queryExecution().toString()


def test_merge_keeps_what_isnt_given(spark):
    now = spark.createDataFrame([("a", "x", "k", {"p": 1}), ("b", "y", None, None)], "id string, name string, uri string, config map<string,int>")
    new = spark.createDataFrame([("a", "z", "", {"q": 2}), ("c", None, "u", {})], "id string, name string, uri string, config map<string,int>")
    got = {r.id: r for r in metadata.merge(now, new, ["id"], fixed=("name",), defaults={"uri": F.lit("none")}).collect()}
    assert got["a"].name == "x" and got["a"].uri == "k" and got["a"].config == {"p": 1, "q": 2}
    assert got["b"].uri == "none" and got["b"].config is None and got["c"].uri == "u"


def test_claims_leases_and_limits(spark):
    t = datetime(2024, 1, 1)
    jobs = spark.createDataFrame(
        [("late", "pending", t.replace(day=9), t, None), ("b", "pending", t, t.replace(hour=2), None), ("a", "pending", t, t.replace(hour=1), None), ("lost", "running", t.replace(day=2), t, t), ("held", "running", t, t, t.replace(day=8))],
        "job_id string, state string, available_at timestamp_ntz, created_at timestamp_ntz, lease_until timestamp_ntz",
    )
    now = F.lit("2024-01-05 00:00:00").cast("timestamp_ntz")
    assert [r.job_id for r in metadata.claim(jobs, now, 2).orderBy("available_at", "created_at").collect()] == ["a", "b"]
    assert {r.job_id for r in metadata.claim(jobs, now, 9).collect()} == {"a", "b", "lost"}
    asked = spark.createDataFrame([("x", 1, "r1"), ("x", 2, "r2"), ("x", 3, "r3"), (None, 1, "r4")], "creator string, asked_at int, request_id string")
    active = spark.createDataFrame([("x",)], "creator string")
    assert rows(metadata.within_limit(asked, active, 2), "request_id", "admitted") == [("r1", True), ("r2", False), ("r3", False), ("r4", True)]
    beats = spark.createDataFrame([("w", t), ("v", t.replace(day=4, hour=23, minute=59))], "worker_id string, at timestamp_ntz")
    assert [r.worker_id for r in metadata.live_workers(beats, now).collect()] == ["v"]


def test_principals_and_changes(spark):
    keys = spark.createDataFrame([("k1", "t1", ["a"], True), ("k2", "t2", None, False)], "key string, tenant_id string, acl array<string>, active boolean").withColumn("key_hash", F.sha2("key", 256))
    presented = spark.createDataFrame([("1", "k1"), ("2", "k2"), ("3", ""), ("4", None)], "request_id string, api_key string")
    got = rows(metadata.principals(presented, keys), "request_id", "tenant_id", "known")
    assert got == [("1", "t1", True), ("2", None, False), ("3", "default", True), ("4", "default", True)]
    a = spark.createDataFrame([("x", 1), ("y", 1), ("n", None)], "id string, v int")
    b = spark.createDataFrame([("y", 2), ("z", 1), ("n", None)], "id string, v int")
    assert rows(metadata.changes(a, b, "id", ["v"]), "id", "event") == [("x", "removed"), ("y", "changed"), ("z", "added")]


def test_passage_windows_refuse_what_they_cant_show(spark):
    text = "0123456789"
    blocks = spark.createDataFrame([(f"c{i}", "v", i * 12, i * 12 + 10, text) for i in range(6)] + [("bad", "v", 200, 300, "short")], "id string, version_id string, char_start int, char_end int, text string")
    versions = spark.createDataFrame([("v", "t", "d", 1, None), ("w", "t", "e", 1, ["secret"])], "version_id string, tenant_id string, document_id string, version_no int, acl array<string>")
    asked = [("ok", "d", 5, 27), ("gap", "d", 8, 15), ("tail", "d", 60, 99), ("between", "d", 10, 12), ("hidden", "e", 0, 5), ("empty", "d", 5, 5), ("null", "d", None, 5), ("broken", "d", 210, 220)]
    df = spark.createDataFrame([(r, "t", d, 1, s, e, ["x"]) for r, d, s, e in asked], "request_id string, tenant_id string, document_id string, version_no int, start int, end int, allowed array<string>")
    found = reading.passage_windows(df, versions, reading.numbered_chunks(blocks), context=1).collect()
    reasons = {r.request_id: r.reason for r in found}
    assert reasons == {"ok": None, "gap": None, "tail": "unresolved", "between": "unresolved", "hidden": "not_found", "empty": "invalid_range", "null": "invalid_range", "broken": "unresolved"}
    ok = sorted((r.ordinal, r.local_start, r.local_end) for r in found if r.request_id == "ok")
    assert ok == [(0, 5, 10), (1, 0, 10), (2, 0, 3), (3, None, None)]
    assert {(r.next_from, r.has_more, r.focus) for r in found if r.request_id == "ok"} == {(4, True, 0)}
    with pytest.raises(ValueError):
        reading.passage_windows(df, versions, reading.numbered_chunks(blocks), context=99)
    p = spark.createDataFrame([("p", "v", 5, 27)], "passage_id string, version_id string, start int, end int")
    held = blocks.withColumnRenamed("id", "chunk_id")
    assert rows(reading.excerpts(p, held, ["version_id"]), "excerpt") == [("56789" + text + "012",)]


def test_segments_put_together_are_the_text(spark):
    cases = [("abcdefghij", [(2, 4), (3, 6), (8, 10)]), ("abc", []), ("abc", None), ("abc", [(1, 9), (-1, 2), (2, 2)]), ("", [(0, 1)]), (None, None), ("a𝄞b", [(1, 2)])]
    df = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(cases)], "i int, t string, s array<struct<start:int,end:int>>")
    for clip in (False, True):
        got = {r.i: r.p for r in df.select("i", reading.segments(F.col("t"), F.col("s"), clip).alias("p")).collect()}
        assert all("".join(x.text for x in got[i]) == (t or "") for i, (t, _) in enumerate(cases))
        hits = [x.text for x in got[0] if x.hit]
        assert hits == (["cd", "ef", "ij"] if clip else ["cd", "ij"]) and [x.anchor for x in got[0] if x.hit][0] and sum(x.anchor for x in got[0]) == 1
        assert [x.text for x in got[6] if x.hit] == ["𝄞"]


def test_highlights_take_longer_terms_first():
    assert highlights.spans("abcabcab", ["ab", "abc", ""]) == [(0, 3), (3, 6), (6, 8)]
    assert len(highlights.spans("a" * 100, ["a"])) == 32 and highlights.spans("", ["a"]) == [] and highlights.spans("x", []) == []


def test_windows_of_sentences(spark):
    text = "One. Two! Three? 四。五；Six\nSeven"
    sentences = [text[a:z] for a, z in projection.spans(text)]
    assert "".join(sentences) == text and len(sentences) == 7
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "a.b"), (5, "\n")], "i int, t string")
    got = projection.sentence_windows(df, "t").collect()
    assert [(r.chunk_index, r.sentence_count) for r in got if r.i == 1] == [(0, 4), (1, 4)]
    assert all(text[r.char_start : r.char_end] == r.chunk for r in got if r.i == 1) and {r.i for r in got} == {1, 4, 5}
    with pytest.raises(ValueError):
        projection.sentence_windows(df, "t", 2, 2)
    both = projection.with_chunk_fingerprints(spark.createDataFrame([("天地，玄黄 宇宙，洪荒。",), ("plain text of latin",), (None,)], "chunk string"), "md5").collect()
    assert len(both[0].fingerprints) == 2 and len(both[1].fingerprints) > 0 and both[2].fingerprints == []


def test_policies_and_languages(spark):
    df = spark.createDataFrame([("天地玄黄宇宙洪荒日月盈昃", "auto"), ("天地玄黄宇宙洪荒日月盈昃", "en"), ("plain", "zh-Hant"), (None, None)], "t string, l string")
    got = [r.p for r in df.select(projection.policy(F.col("t"), F.col("l")).alias("p")).collect()]
    assert [(p.profile, p.seed, p.short_exact) for p in got] == [("zh", 12, True), ("generic", 30, False), ("zh", 12, False), ("generic", 30, False)]
    texts = {"de": "Der Bericht und die Karte sind nicht von der Stadt", "fr": "Le rapport et la carte ne sont pas dans les archives", "es": "El informe y la carta no se guardan en las casas", "en": "The report of the city is in the archive", "ja": "これは報告です", "zh": "天地玄黄宇宙洪荒", "ru": "Это отчёт о городе"}
    df = spark.createDataFrame([*texts.items(), ("en", None), ("en", "")], "l string, t string")
    assert all(r.l == r.g for r in df.select("l", projection.detect_language(F.col("t")).alias("g")).collect())


def test_reports(spark):
    p = spark.createDataFrame([("q", "a", 0, 10, 0.5), ("q", "a", 5, 20, 0.9), ("q", "b", 15, 30, 0.7)], "query_id string, document_id string, query_start int, query_end int, score double")
    t = spark.createDataFrame([("q", "x" * 40, 40)], "query_id string, text string, n_chars int")
    got = rows(reports.rollup(p, t), "document_id", "matched_chars", "score", "total_matched", "ratio")
    assert got == [("a", 20, 0.9, 30, 75.0), ("b", 15, 0.7, 30, 75.0)]
    numbered = reports.numbered_sources(reports.rollup(p, t))
    assert rows(numbered, "document_id", "ordinal") == [("a", 1), ("b", 2)] and reports.query_spans(p, numbered).count() == 3
    assert rows(reports.previews(p, t), "preview")[0] == ("x" * 10,)
    v = spark.createDataFrame([("a", ["s"], True)], "document_id string, acl array<string>, is_current boolean")
    allowed = spark.createDataFrame([("q", ["s"])], "query_id string, allowed array<string>")
    assert rows(reports.visible_reports(p, v, allowed), "readable") == [(False,)]
    sizes = spark.createDataFrame([(0,), (1023,), (1024,), (5 * 1024**2,), (3 * 1024**3,)], "n long")
    assert [r[0] for r in sizes.select(reports.file_size(F.col("n"))).collect()] == ["0 B", "1023 B", "1.0 KB", "5.0 MB", "3.0 GB"]


def test_requests_are_checked_and_obeyed(spark):
    asked = spark.createDataFrame([("a", " ", 1, "dense"), ("b", "x" * 2001, 1, None), ("c", "x", 0, None), ("d", "x", None, "wild"), ("e", "x", None, None), ("f", None, 5, "hybrid")], "query_id string, query string, top_k int, mode string").withColumn("rerank", F.lit(None).cast("boolean"))
    got = {r.query_id: (r.reason, r.top_k, r.mode) for r in search.checked(asked).collect()}
    assert got["e"] == (None, 10, "hybrid") and [got[k][0] for k in "abcdf"] == ["no_query", "query_too_long", "invalid_top_k", "invalid_mode", "no_query"]
    words = ["river harbour", "river garden", "stone tower", "river river stone"]
    chunks = spark.createDataFrame([(f"c{i}", w, "t", None, True, [], None, None) for i, w in enumerate(words)], "chunk_id string, text string, tenant_id string, acl array<string>, is_current boolean, heading_path array<string>, page int, uri string")
    requests = spark.createDataFrame([(m, "river", "t", 2, m, None, r, False) for m, r in (("sparse", True), ("dense", False), ("hybrid", True))], "query_id string, query string, tenant_id string, top_k int, mode string, acl array<string>, rerank boolean, current_only boolean")
    found = search.hybrid(requests, chunks).collect()
    by = {m: [r for r in found if r.query_id == m] for m in ("sparse", "dense", "hybrid")}
    assert all(len(x) == 2 for x in by.values())
    assert all(set(r.contributions) == {"sparse"} for r in by["sparse"]) and all(set(r.contributions) == {"dense"} and r.rerank_score == 0 for r in by["dense"])
    traced = {r.query_id: (r.n_results, r.n_sparse) for r in search.trace(requests, search.hybrid(requests, chunks)).collect()}
    assert traced["sparse"] == (2, 2) and traced["dense"] == (2, 0)
    stored = search.backfilled(chunks.withColumn("analyzed", F.when(F.col("chunk_id") == "c0", "kept")))
    assert [r.analyzed for r in stored.orderBy("chunk_id").collect()] == ["kept", *words[1:]]
    assert search.hybrid(requests, stored).count() == 6


def test_object_store(spark, tmp_path):
    s = store.ObjectStore(spark, str(tmp_path / "objects"))
    assert not s.exists("a/b") and not s.delete("a/b")
    assert s.put("a/b", b"one") and s.put("a/b", b"two\x00") and s.get("a/b") == b"two\x00"
    for key in ("", "/etc/x", "../x", "a//b", "a/../../x", "a/."):
        with pytest.raises(PermissionError):
            s.uri(key)
    assert s.delete("a/b") and not s.exists("a/b")
    for name in ("z.md", "a.md", "b.txt"):
        s.put(f"in/{name}", name.encode())
    s.put("in/none.md", b"")
    files = store.scan_files(spark, s.uri("in"), "*.md", most=2)
    assert [r.path.rsplit("/")[-1] for r in files.orderBy("path").collect()] == ["a.md", "z.md"]  # empty files hold nothing
    taken = store.incoming_files(store.scan_files(spark, s.uri("in")), "t", "s")
    assert rows(taken, "title", "mime")[0] == ("a", "text/markdown") and taken.count() == 3
    versions = taken.where("title = 'a'").select("document_id", "content_hash", F.lit(1).alias("version_no"), F.lit("indexed").alias("status"))
    assert store.register(taken, versions).count() == 2
