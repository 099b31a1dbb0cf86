"""Rules of the training-data operators that hold at every size: no cap, prefix, or share of the corpus decides."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lectern.llm import distinctive_terms, fuse_scores, garbled, same_look, scan_repair, scan_words, similar_vectors

BLOCK = "id string, document_id string, kind string, text string, section_id string, page int, char_start int, bbox array<double>"
SECTIONS, VERSIONS = "document_id string, heading string, page int", "document_id string, title string, is_current boolean"


def blocks_of(spark, texts, title="Quiet Lantern of Tovar"):
    at, rows = 0, []
    for name, text, page in texts:
        rows.append((name, "d", "text", text, None, page, at, None))
        at += len(text or "") + 2
    return spark.createDataFrame(rows, BLOCK), spark.createDataFrame([], SECTIONS), spark.createDataFrame([("d", title, True)], VERSIONS)


def noise(*tables):
    return {(r.id, r.noise) for r in scan_repair.find_noise(*tables).collect()}


def test_furniture_beside_long_lines_and_of_long_titles(spark):
    title = " ".join(["Remarkable", "observations"] * 6) + " on the harbour of Tovar and the gardens near the ancient river"
    long = "The careful lantern describes the harbour. " * 12
    texts = [("first", title, 1), ("a", long, 1), ("inside", f"{long}\n{title}\n{long}", 2), ("alone", title + "  3", 3), ("b", long, 4)]
    tables = blocks_of(spark, texts, title)
    assert len(title) > scan_repair.SHORT_LINE and {("inside", "running"), ("alone", "running")} <= noise(*tables)


def test_misread_words_are_the_same_looked_up_or_joined(spark):
    good = "The careful lantern describes the harbour and every archive near the river."
    texts = [("t", "Quiet Lantern of Tovar", 1), *[(f"b{i}", good, 1) for i in range(60)], ("x", "The carcful lantern describes the harbour.", 2), ("y", "Every arcbive, the arcbive and archive near.", 2), ("z", "rivcr is a word that begins no text, arcbive", 2)]
    tables = blocks_of(spark, texts)
    longest = scan_repair.longest_title(*tables[1:])
    rows, counts = scan_repair.once(scan_repair.written(scan_repair.read_blocks(tables[0], longest)))
    fixes = scan_words.corrections(counts)
    none = rows.select("id", F.lit("").alias("word")).where("1 = 0")
    both = [{tuple(r) for r in scan_repair.misread(rows, none, none, fixes, most).collect()} for most in (0, 1_000_000)]
    assert both[0] == both[1] == {("x", "carcful", "careful"), ("y", "arcbive", "archive"), ("z", "arcbive", "archive")}
    assert {b for b, n in noise(*tables) if n == "misread"} == {"x", "y", "z"}


def test_delivered_rows_count_once(spark):
    texts = [("t", "Quiet Lantern of Tovar", 1), ("a", "plain words of the archive", 1), ("b", "plain words of the river", 1)]
    blocks, sections, versions = blocks_of(spark, texts)
    twice = blocks.unionByName(blocks.where("id = 'a'")).unionByName(blocks.where("id = 'a'"))
    longest = scan_repair.longest_title(sections, versions)
    rows, counts = scan_repair.once(scan_repair.written(scan_repair.read_blocks(twice, longest)))
    n = {r.word: r.n for r in counts.collect()}
    assert rows.count() == 3 and n["plain"] == 2 and n["archive"] == 1 and n["river"] == 1


def test_no_blocks_no_noise(spark):
    empty = [spark.createDataFrame([], s) for s in (BLOCK, SECTIONS, VERSIONS)]
    assert noise(*empty) == set() and scan_repair.repair_text(*empty).count() == 0


def test_what_is_enough_doesnt_depend_on_the_corpus():
    assert scan_words.enough("arcbive", 1, 8) and not scan_words.enough("arcbive", 1, 7)
    assert scan_words.enough("arcbive", 5_000, 500_000) and not scan_words.enough("hut", 5_000, 400_000)
    assert scan_words.enough("1antern", 2, 4)
    near = [{"fix": "here", "weight": 1.0, "n": 900}, {"fix": "hero", "weight": 0.5, "n": 10}]
    assert scan_words.choose(near, {"hero", "song"}) == "hero" and scan_words.choose(near, set()) == "here"


def test_segments_are_found_where_sums_rise():
    r = np.random.default_rng(0)
    for _ in range(200):
        b = r.normal(-0.3, 1, r.integers(1, 200))
        whole = [(x, y, round(t, 9)) for x, y, t in garbled.segments(b) if t >= 1.5]
        assert whole == [(x, y, round(t, 9)) for x, y, t in garbled.segments_above(b, 1.5)]
    texts = ["abc", "", "x", "zzzz"]
    scores = np.full(7, 0.7, dtype=np.float32)
    scores[4:6] = -4.0  # within the last row
    offsets = np.array([0, 3, 3, 4, 8])
    assert garbled.doubtful(scores, offsets) == {3} and len(texts) == 4
    scores[:] = 0.7
    scores[2:4] = -4.0  # between rows only
    assert garbled.doubtful(scores, offsets) == set()


def test_a_garbled_text_copied_to_a_third_of_the_rows_is_found(spark):
    r = random.Random(4)
    words = "größe käfer straße für schön müller über brücke hören grün der die das und nicht mit von haus wald stein".split()
    rows = [(i, " ".join(r.choice(words) for _ in range(60))) for i in range(400)]
    broken = rows[0][1].encode("utf-8").decode("cp1252", "replace")
    rows = [(i, broken if i % 3 == 0 else t) for i, t in rows] + [(1000, None), (1001, ""), (1002, "ascii only")]
    got = {x.id: x for x in garbled.repair_documents(spark.createDataFrame(rows, "id int, text string"), "id", "text").collect()}
    assert {i for i, x in got.items() if x.garbled} == {i for i, _ in rows if i < 1000 and i % 3 == 0}
    assert got[0].restored.count("ö") >= 1 and got[1000].restored is None
    # The end of a long run decides as well as its beginning.
    long = [(i, t) for i, t in rows[:400]] + [(2000, "é" * 200 + " " + broken)]
    assert {x.id: x.garbled for x in garbled.repair_documents(spark.createDataFrame(long, "id int, text string"), "id", "text").collect()}[2000]


def test_hits_leading_by_every_score(spark):
    r = random.Random(1)
    hits, results = [], []
    for q in range(12):
        for c in range(r.choice([4, 6, 9])):
            score = lambda: r.choice([None, float("nan"), 1.0, 2.0, 3.0, 4.0])
            hits.append((f"q{q}", f"c{c}", 1.0, {"dense": 1}, score(), score()))
            results.append((f"q{q}", f"c{c}", score()))
    h = spark.createDataFrame(hits + hits[:3], "query_id string, chunk_id string, score double, contributions map<string,int>, dense_score double, sparse_score double")
    s = spark.createDataFrame(results, "query_id string, chunk_id string, rerank_score double")
    want = set()
    good = lambda v: v is not None and v == v
    for q in {x[0] for x in hits}:
        rows = {x[1]: (x[4], x[5], next(z[2] for z in results if z[:2] == x[:2])) for x in hits if x[0] == q}
        for c, v in rows.items():
            if len(rows) >= 6 and all(good(v[k]) and sum(good(o[k]) and o[k] > v[k] for o in rows.values()) < 3 for k in range(3)):
                want.add((q, c))
    assert {tuple(x) for x in fuse_scores.top_by_all(h, s).collect()} == want and want
    assert fuse_scores.top_by_all(h.where("1 = 0"), s).count() == 0


def test_terms_that_mark_their_record(spark):
    rows = [("a", "1", "alpha " * 6 + "common"), ("b", "2", "alpha common"), ("c", "3", "common " * 7), ("d", "4", "common alpha"), ("e", "5", "beta alpha"), ("n", "6", None)]
    w = distinctive_terms.log_entropy(spark.createDataFrame(rows, "doc string, id string, text string"), "doc", "text", ["id"])
    assert {(r.doc, r.term) for r in distinctive_terms.marks(w, 6, 4).collect()} == {("a", "alpha"), ("c", "common")}
    assert {(r.doc, r.term) for r in distinctive_terms.marks(w, 6, 3).collect()} == set()


def test_code_points_of_slices():
    texts = pa.array(["é", None, "", "a𝄞", "zz"])
    points, offsets = same_look.code_points(texts.slice(1, 3))
    assert [chr(p) for p in points] == ["a", "𝄞"] and offsets.tolist() == [0, 0, 0, 2]


def test_lists_grow_with_the_collection():
    sizes = [similar_vectors.codewords(10**k) ** 2 for k in range(2, 11)]
    assert all(a < b for a, b in zip(sizes, sizes[2:])) and sizes[-1] >= 65_536  # each is a power of two
