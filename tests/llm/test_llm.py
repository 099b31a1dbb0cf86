"""The training-data operators against brute force and on awkward inputs."""

import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.llm import byte_bpe, distinctive_terms, fill_containers, fuse_scores, garbled, same_look, scan_repair, scan_words, similar_vectors, split_oversized
from lectern.llm.levenshtein import Trie


def test_similar_vectors_equal_brute_force(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(400, 8)).astype(np.float32)
    x[100:140] = x[:40] * 3 + r.normal(size=(40, 8)).astype(np.float32) * 0.05
    x[200:212] = x[200] * np.arange(1, 13)[:, None]  # copies of a direction, of other lengths
    rows = [(f"c{i:03d}", [float(v) for v in x[i]], i) for i in range(400)] + [("c000", [float(v) for v in x[0]], 7)]
    rows += [("n1", None, 0), ("n2", [0.0] * 8, 0), ("n3", [1.0], 0), ("n4", [float("nan")] * 8, 0), (None, [1.0] * 8, 0), ("n5", [], 0)]
    df = spark.createDataFrame(rows, "chunk_id string, dense array<float>, id int")
    got = similar_vectors.similar_pairs(df, "chunk_id", "dense", 0.9, dim=8)
    unit = x.astype(np.float64) / np.linalg.norm(x, axis=1)[:, None]
    s = unit @ unit.T
    np.fill_diagonal(s, -2)
    want = set()
    for i in range(400):
        if 200 <= i < 212:
            continue
        for j in np.argsort(-s[i], kind="stable")[:5]:
            if s[i, j] >= 0.9 and not 200 <= j < 212:
                want.add((f"c{min(i, j):03d}", f"c{max(i, j):03d}"))
    found = {(r.chunk_a, r.chunk_b) for r in got.collect()}
    assert len(want - found) <= 0.02 * len(want)
    # Every copy has five others, each pair once, not all pairs of the group.
    copies = {p for p in found if "c200" <= p[0] < "c212" and "c200" <= p[1] < "c212"}
    assert all(sum(f"c{i}" in p for p in copies) >= 5 for i in range(200, 212)) and len(copies) < 66
    assert all(a < b for a, b in found) and not any(n.startswith("n") for p in found for n in p)


def test_neighbours_of_few_vectors(spark):
    empty = spark.createDataFrame([], "chunk_id string, dense array<float>")
    assert similar_vectors.neighbours(empty, "chunk_id", "dense", dim=2).count() == 0
    two = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "chunk_id string, dense array<float>")
    assert {(r.id, r.neighbour) for r in similar_vectors.neighbours(two, "chunk_id", "dense", dim=2).collect()} == {("a", "b"), ("b", "a")}


def test_trie_intersection_is_complete():
    r = random.Random(3)
    words = list({"".join(r.choice("abcé") for _ in range(r.randint(1, 7))) for _ in range(300)})
    trie = Trie(words)
    queries = ["", *("".join(r.choice("abcdé") for _ in range(r.randint(0, 8))) for _ in range(80))]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1]

    got = sorted((i, trie.words[j]) for i, j in trie.within(queries, 2))
    assert got == sorted((i, w) for i, q in enumerate(queries) for w in words if distance(q, w) <= 2)


@pytest.fixture(scope="module")
def scanned(spark):
    block = "id string, document_id string, version_id string, source_id string, kind string, text string, section_id string, page int, char_start int, char_end int, bbox array<double>"
    rows, at = [], 0
    lines = ["The careful lantern describes the harbour and the garden near the river.", "Every reader of the archive explains the ancient record."]

    def add(name, text, page=1, kind="text"):
        nonlocal at
        rows.append((name, "d", "v", "s", kind, text, None, page, at, at + len(text or ""), None))
        at += len(text or "") + 2

    add("title", "Quiet Lantern of Tovar")
    for i in range(60):
        add(f"b{i}", lines[i % 2], page=1 + i // 20)
        if i in (10, 30, 50):
            add(f"p{i}", f"- {1 + i // 20} -", page=1 + i // 20)
            add(f"r{i}", "Quiet Lantcrn of Tovar", page=1 + i // 20)
    add("cut", "The careful lan-\ntern describes the self-\nhosted record.", page=3)
    add("end", "Every reader of the arc-", page=3)
    add("next", "hive explains the ancient record.", page=3)
    add("bad", "The careful lantern dcscribes the harbour.", page=3)
    add("self", "A self-hosted record and a self-hosted garden, self-hosted.", page=3)
    for name, text in (("null", None), ("empty", ""), ("blank", " \n ")):
        rows.append((name, "d", "v", "s", "text", text, None, None, at, at, None))
    rows.append(rows[3])
    blocks = spark.createDataFrame(rows, block)
    sections = spark.createDataFrame([], "id string, document_id string, heading string, page int, char_start int")
    versions = spark.createDataFrame([("d", "Quiet Lantern of Tovar", True)], "document_id string, title string, is_current boolean")
    return blocks, sections, versions


def test_noise_of_scanned_pages(scanned):
    got = {(r.id, r.noise) for r in scan_repair.find_noise(*scanned).collect()}
    assert {i for i, n in got if n == "running"} == {"r10", "r30", "r50"}
    assert {i for i, n in got if n == "page_number"} == {"p10", "p30", "p50"}
    assert {i for i, n in got if n == "hyphen"} == {"cut", "end"}
    assert {i for i, n in got if n == "misread"} >= {"bad"} and "cut" not in {i for i, n in got if n == "misread"}


def test_repaired_paragraphs(scanned):
    text = " ".join(r.text for r in scan_repair.repair_text(*scanned).orderBy("char_start").collect())
    assert "lantern describes the self-hosted record" in text and "reader of the archive explains" in text
    assert "lantern describes the harbour." in text and "Lantcrn" not in text and "- 1 -" not in text


def test_page_numbers():
    assert [scan_repair.page_number(x) for x in ("36", "- 12 -", "[3]", "Page 4", "3 / 7", "xiv", "第一〇页", "第十二页", "684.", "in 12", "abc")] == [36, 12, 3, 4, 3, 14, 10, 12, None, None, None]


def test_words_with_marks_are_one():
    assert scan_words.words_of("médecin con(ern checklist_0 a/b gaIlery") == ["médecin", "con(ern", "gaIlery"]


def test_percentiles_average_ties_and_leave_missing_scores_out(spark):
    hits = spark.createDataFrame([("q", c, s, None, d, None) for c, s, d in (("a", 1.0, 5.0), ("b", 1.0, float("nan")), ("c", 0.0, None), ("d", None, None))], "query_id string, chunk_id string, score double, contributions map<string,int>, dense_score double, sparse_score double")
    results = spark.createDataFrame([("q", "a", 900.0)], "query_id string, chunk_id string, rerank_score double")
    rows = fuse_scores.fuse(hits, results).orderBy("position").collect()
    assert [r.chunk_id for r in rows] == ["b", "a", "c", "d"] and rows[3].fused is None and rows[3].n_scores == 0
    p = {(r.chunk_id, r.kind): r.percentile for r in fuse_scores.percentiles(fuse_scores.scored(fuse_scores.gather_scores(hits, results))).collect()}
    assert p[("a", "score")] == p[("b", "score")] == pytest.approx(2 / 3) and p[("c", "score")] == pytest.approx(1 / 6)
    assert fuse_scores.fuse(hits.limit(0), results).count() == 0


def test_one_look_one_form():
    t = ["café ＡＢＣ", "café ABC", "a‍b", "👩‍🔬", "ﬁne о", "fine o", None, "", "​", "x² ①", "x2 1", "a‑b", "a-b", "樂⼭", "樂山", "naïve", "naive"]
    f = same_look.fold_array(pa.array(t)).to_pylist()
    assert f[0] == f[1] and f[4] == f[5] and f[11] == f[12] and f[13] == f[14] and f[8] == f[7] == ""
    assert f[3] == "👩‍🔬" and f[6] is None and f[9] != f[10] and f[15] != f[16]


def test_forms_are_canonical():
    r = random.Random(1)
    texts = ["".join(r.choice("aeoụ́̈̇éüs한ㅏ각 ") for _ in range(r.randint(0, 12))) for _ in range(500)]
    nfd = [unicodedata.normalize("NFD", t) for t in texts]
    assert same_look.fold_array(pa.array(texts)).to_pylist() == same_look.fold_array(pa.array(nfd)).to_pylist()


def test_same_look_pairs(spark):
    df = spark.createDataFrame([("1", "caf\u00e9"), ("2", "cafe\u0301"), ("3", "caf\u00e9"), ("3", "caf\u00e9"), ("4", None), ("5", "cafe")], "id string, text string")
    assert {(r.id_a, r.id_b) for r in same_look.same_look_pairs(df, "block", "id", "text").collect()} == {("1", "2"), ("2", "3")}


def test_pieces_cover_the_text_with_overlap():
    r = random.Random(5)
    texts = ["x" * 5_000, "。" * 4_100, "Word here. " * 900, "".join(r.choice("ab .\n,;é") for _ in range(30_000)), "\r\n" * 3_000]
    for text in texts:
        cut = split_oversized.pieces(text)
        assert cut[0][0] == 0 and cut[-1][1] == len(text) and all(0 < b - a <= 2_000 for a, b in cut)
        assert all(0 < b - c <= 200 for (_, b), (c, _) in zip(cut, cut[1:]))
    assert split_oversized.pieces("short") == [(0, 5)]
    assert all("Word here. " * 900 for _ in [0]) and all(("Word here. " * 900)[b - 2 : b] in (". ", "e.") for _, b in split_oversized.pieces("Word here. " * 900)[:-1])


def test_strongest_cut_equals_brute_force():
    r = np.random.default_rng(2)
    v = r.integers(-2, 5, 300).astype(np.int16)
    table = split_oversized.StrongestCut(v, 100)
    for _ in range(300):
        a = int(r.integers(0, 299))
        b = int(min(299, a + r.integers(0, 100)))
        assert table.at(a, b) == max(range(a, b + 1), key=lambda i: (v[i], i))


def test_log_entropy(spark):
    df = spark.createDataFrame([("1", "d1", "common common rarely"), ("2", "d2", "common common"), ("2", "d2", "common common"), ("3", "d3", None), ("4", None, "nothing")], "id string, doc string, text string")
    got = {(r.doc, r.term): (r.tf, r.df, r.score) for r in distinctive_terms.log_entropy(df, "doc", "text", ["id"]).collect()}
    assert set(got) == {("d1", "common"), ("d1", "rarely"), ("d2", "common")} and got[("d2", "common")][0] == 2
    assert got[("d1", "rarely")][2] == pytest.approx(np.log(2)) and got[("d1", "common")][2] < got[("d1", "rarely")][2]


@pytest.fixture(scope="module")
def vocabulary():
    return byte_bpe.Vocabulary(byte_bpe.read_vocabulary(f"{byte_bpe.TOKENIZERS}/{byte_bpe.VOCABULARY}"))


def test_encoding_equals_the_library(vocabulary):
    import tiktoken

    known = tiktoken.Encoding("t", pat_str=byte_bpe.PATTERN, mergeable_ranks={t: i for i, t in enumerate(vocabulary.tokens)}, special_tokens={})
    r = random.Random(4)
    alphabet = "abcdefghij  \n\t.,'0123éß中文字字典일本語🏺👩‍🔬ÃÂ" + "the ing tion "
    texts = [None, "", " ", "<|endoftext|>", "a" * 3_000, "中" * 500] + ["".join(r.choice(alphabet) for _ in range(r.randint(0, 300))) for _ in range(300)]
    ids, offsets = vocabulary.encode_batch(texts)
    for t, a, b in zip(texts, offsets, offsets[1:]):
        assert ids[a:b].tolist() == (known.encode_ordinary(t) if t else [])
        assert vocabulary.decode(ids[a:b]).decode() == (t or "")


def test_containers(spark):
    r = random.Random(6)
    sizes = [r.choice([1, 3, 30, 60, 99, 100]) for _ in range(500)] + [0, None, 250, 300]
    df = spark.createDataFrame(list(enumerate(sizes)), "k long, n int")
    rows = fill_containers.fill(df, "k", "n", 100).collect()
    used = {}
    for x in rows:
        if x.container is not None:
            used[x.container] = used.get(x.container, 0) + x.size
    total = sum(s or 0 for s in sizes)
    assert max(used.values()) <= 100 and sum(used.values()) == total and sorted(used) == list(range(len(used)))
    assert len(used) <= 1.05 * -(-total // 100) + 1
    assert {x.k for x in rows} == set(range(len(sizes))) and all(x.piece_no == 0 for x in rows if (sizes[x.k] or 0) <= 100)
    assert fill_containers.fill(df.limit(0), "k", "n", 100).count() == 0


def test_equal_items_share_containers():
    assert sum(n for n, _ in fill_containers.shortest_pack_first({10: 1_000}, 100)) == 100


def test_garbled_text_is_found_and_restored(spark):
    good = ["Le café près de l’école était fermé, déjà.", "El niño añadió después una canción más.", "Der Gärtner prüft die Größe für später."] * 1_000
    bad = [good[0].encode().decode("cp1252", "replace"), good[1].encode("utf-8").decode("latin-1"), good[2].encode().decode("mac_roman"), "broken � text"]
    rows = [(i, t) for i, t in enumerate(good + bad)] + [(9000, None), (9001, ""), (9002, "plain ascii"), (9003, "½ ± 3 °C")]
    got = {r.doc_id: r for r in garbled.repair_documents(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    n = len(good)
    assert [i for i, r in got.items() if r.garbled] == [n, n + 1, n + 2, n + 3]
    assert got[n + 1].restored == good[1] and got[n + 2].restored == good[2]
    assert got[9000].restored is None and got[9001].restored == ""


def test_maximal_segments():
    assert [(a, b) for a, b, _ in garbled.segments(np.array([4.0, -5, 3, -3, 1, 2, -2, 2, -2, 1, 5]))] == [(0, 1), (2, 3), (4, 11)]
    assert garbled.segments(np.zeros(0)) == []
