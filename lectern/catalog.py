"""All queries of the core, by name, and the SQL they must agree with.

A name begins with the group and number of the operator it exercises.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import identity, text as T
from lectern.operators import align, dense, fusion, intervals, lexical, reuse, visibility
from lectern.plans import library, reports, search
from lectern.session import bounded, cut, written
from lectern.sources import parse, store
from lectern.sources.tables import delivered_once, load, spread
from lectern.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


# Common tables, repeated deliveries counted once.
_BLOCKS = ("id", "document_id", "version_id", "source_id", "kind", "text", "section_id", "page", "char_start", "char_end")
_VERSIONS = ("version_id", "document_id", "version_no", "tenant_id", "source_id", "external_id", "title", "lang", "parser", "status", "page_count", "acl", "content_hash", "is_current", "created_at")
_SECTIONS = ("id", "document_id", "level", "heading", "heading_path", "page", "char_start", "char_end")
_REQUESTS = ("query_id", "query", "tenant_id", "top_k", "mode", "acl", "rerank", "current_only")
B = f"b AS (SELECT DISTINCT {', '.join(_BLOCKS)} FROM blocks)"
V = f"v AS (SELECT DISTINCT {', '.join(_VERSIONS)} FROM versions)"
S = f"s AS (SELECT DISTINCT {', '.join(_SECTIONS)} FROM sections)"
Q = f"q AS (SELECT DISTINCT {', '.join(_REQUESTS)} FROM requests)"


def blocks(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return delivered_once(spark, d, "blocks", *(columns or _BLOCKS))


def versions(spark: SparkSession, d: str) -> DataFrame:
    return delivered_once(spark, d, "versions", *_VERSIONS)


def sections(spark: SparkSession, d: str) -> DataFrame:
    return delivered_once(spark, d, "sections", *_SECTIONS)


def requests(spark: SparkSession, d: str) -> DataFrame:
    return delivered_once(spark, d, "requests", *_REQUESTS)


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _less(x: str, pattern: str) -> str:
    return f"(length({x}) - length(regexp_replace({x}, '{pattern}', '', 'g')))"


_tokens = T.tokens_sql


# --- text functions -------------------------------------------------------------------------------


@query("s13_normalized", rf"""SELECT doc_id, md5({_strip("regexp_replace(regexp_replace(regexp_replace(text, E'\r\n|\r', E'\n', 'g'), '[ \t　]+', ' ', 'g'), E'\n{3,}', E'\n\n', 'g')")}) AS digest FROM documents WHERE text IS NOT NULL""")
def _s13(spark, d):
    return load(spark, d, "documents", "doc_id", "text").where("text IS NOT NULL").select("doc_id", F.md5(F.encode(T.normalize_text(F.col("text")), "UTF-8")).alias("digest"))


@query("s11_language", f"""SELECT doc_id, CASE WHEN coalesce(length(text), 0) = 0 THEN 'unknown'
    WHEN {_less("substr(text, 1, 2000)", "[一-鿿]")} / length(substr(text, 1, 2000))::DOUBLE > 0.15 THEN 'zh' ELSE 'en' END AS lang FROM documents""")
def _s11(spark, d):
    return load(spark, d, "documents", "doc_id", "text").select("doc_id", T.guess_language(F.col("text")).alias("lang"))


@query("s07_mime", r"""SELECT DISTINCT external_id, CASE lower(regexp_extract(external_id || CASE version_no % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.TXT' WHEN 2 THEN '.pdf' ELSE '' END, '\.([^./\\]+)$', 1))
    WHEN 'md' THEN 'text/markdown' WHEN 'txt' THEN 'text/plain' WHEN 'pdf' THEN 'application/pdf' ELSE 'application/octet-stream' END AS mime FROM versions""")
def _s07(spark, d):
    suffix = F.when(F.col("version_no") % 4 == 0, ".md").when(F.col("version_no") % 4 == 1, ".TXT").when(F.col("version_no") % 4 == 2, ".pdf").otherwise("")
    return versions(spark, d).select("external_id", T.mime_type(F.concat("external_id", suffix)).alias("mime")).distinct()


@query("f02_tokens", f"SELECT doc_id, len(x)::BIGINT AS n, md5(array_to_string(x, ' ')) AS digest FROM (SELECT doc_id, {_tokens('text')} AS x FROM documents WHERE text IS NOT NULL)")
def _f02(spark, d):
    x = load(spark, d, "documents", "doc_id", "text").where("text IS NOT NULL").select("doc_id", T.tokens(F.col("text")).alias("x"))
    return x.select("doc_id", F.size("x").cast("long").alias("n"), F.md5(F.encode(F.array_join("x", " "), "UTF-8")).alias("digest"))


@query("f04_token_estimate", f"""SELECT doc_id, CASE WHEN coalesce(length(text), 0) = 0 THEN 0 ELSE greatest(1, floor({_less("text", T.WIDE)} + (length(text) - {_less("text", T.WIDE)}) / 4.0)) END::BIGINT AS n FROM documents""")
def _f04(spark, d):
    return load(spark, d, "documents", "doc_id", "text").select("doc_id", T.token_estimate(F.col("text")).cast("long").alias("n"))


@query("f05_chars_for_tokens", f"""SELECT doc_id, greatest(1, floor(512 / (greatest(1, floor({_less("text", T.WIDE)} + (length(text) - {_less("text", T.WIDE)}) / 4.0)) / length(text)::DOUBLE)))::BIGINT AS n FROM documents WHERE length(text) > 0""")
def _f05(spark, d):
    return load(spark, d, "documents", "doc_id", "text").where(F.length("text") > 0).select("doc_id", T.chars_for_tokens(512, F.col("text")).cast("long").alias("n"))


@query("f06_sentences", r"""SELECT doc_id, len(x)::BIGINT AS n, coalesce(list_max(list_transform(x, lambda s: length(s))), 0)::BIGINT AS longest
    FROM (SELECT doc_id, regexp_extract_all(text, E'[^。！？；!?;\n]*[。！？；!?;\n]|[^。！？；!?;\n]+') AS x FROM documents WHERE text IS NOT NULL)""")
def _f06(spark, d):
    x = load(spark, d, "documents", "doc_id", "text").where("text IS NOT NULL").select("doc_id", T.sentences(F.col("text")).alias("x"))
    return x.select("doc_id", F.size("x").cast("long").alias("n"), F.coalesce(F.array_max(F.transform("x", F.length)), F.lit(0)).cast("long").alias("longest"))


def _rewrite_sql() -> str:
    steps = [rf"c0 AS (SELECT query_id, {_strip('query')} AS o, {_strip(f'regexp_replace({_strip("query")}, {chr(39)}{T.QUESTION_TAIL}{chr(39)}, {chr(39)}{chr(39)})')} AS c FROM q WHERE query IS NOT NULL)"]
    for i, p in enumerate(T.FRAMING):
        steps.append(f"c{i + 1} AS MATERIALIZED (SELECT query_id, o, CASE WHEN starts_with(lower(c), '{p}') THEN regexp_replace(substr(c, {len(p) + 1}), '^[的 　]+|[的 　]+$', '', 'g') ELSE c END AS c FROM c{i})")
    parts = f"list_transform(regexp_split_to_array(c, '{T.SEPARATOR}'), lambda x: {_strip('x')})"
    return f"""WITH {Q}, {", ".join(steps)}, l AS (SELECT query_id, list_filter(list_concat([o, c], {parts}), lambda x: x = o OR length(x) >= 2) AS x, o FROM c{len(T.FRAMING)}),
        u AS (SELECT query_id, list_filter(x, lambda y, i: list_position(x, y) = i) AS x, o FROM l)
        SELECT query_id, array_to_string(list_slice(x, 1, 3), ' | ') AS variants FROM u WHERE o <> ''"""


@query("f11_rewrite", _rewrite_sql())
def _f11(spark, d):
    x = requests(spark, d).select("query_id", T.rewrite(F.col("query")).alias("x")).where(F.size("x") > 0)
    return x.select("query_id", F.array_join("x", " | ").alias("variants"))


@query("f01_fold")
def _f01(spark, d):
    return blocks(spark, d, "id", "text").where("text IS NOT NULL").select("id", T.fold(F.col("text")).alias("folded")).where("folded IS NOT NULL")


@query("f22_anchor", f"""WITH {B}, u AS (SELECT DISTINCT source_id, uri FROM sources) SELECT id, CASE WHEN coalesce(uri, '') = '' OR coalesce(page, 0) = 0 THEN uri
    ELSE uri || CASE WHEN contains(uri, '#') THEN '&' ELSE '#' END || 'page=' || page END AS anchor FROM b LEFT JOIN u USING (source_id)""")
def _f22(spark, d):
    u = bounded(delivered_once(spark, d, "sources", "source_id", "uri"))
    return blocks(spark, d, "id", "source_id", "page").join(u, "source_id", "left").select("id", T.source_anchor(F.col("uri"), F.col("page")).alias("anchor"))


@query("p09_discriminative", rf"WITH {B} SELECT id FROM b WHERE length(text) > 0 AND {_less('text', T.WORD)} / length(text)::DOUBLE >= 0.5")
def _p09(spark, d):
    return blocks(spark, d, "id", "text").where(visibility.discriminative(F.col("text"))).select("id")


@query("p10_effective", r"SELECT doc_id, length(regexp_replace(text, '[\s\p{P}\p{Z}]', '', 'g'))::BIGINT AS n FROM documents WHERE text IS NOT NULL")
def _p10(spark, d):
    return load(spark, d, "documents", "doc_id", "text").where("text IS NOT NULL").select("doc_id", T.effective_characters(F.col("text")).cast("long").alias("n"))


@query("p11_cjk", rf"SELECT doc_id, coalesce({_less(r"regexp_replace(text, '\s', '', 'g')", T.DOMINANT)} / nullif(length(regexp_replace(text, '\s', '', 'g')), 0)::DOUBLE >= 0.5, false) AS dominant, coalesce(regexp_matches(text, '{T.DOMINANT}'), false) AS present FROM documents")
def _p11(spark, d):
    t = F.col("text")
    return load(spark, d, "documents", "doc_id", "text").select("doc_id", T.cjk_dominant(t).alias("dominant"), F.coalesce(t.rlike(T.DOMINANT), F.lit(False)).alias("present"))


# --- identity and versions ------------------------------------------------------------------------


def _uuid5(space, name: str) -> str:
    h = f"sha1(unhex('{space.hex}') || encode({name}))"
    variant = f"substr('89ab89ab89ab89ab', ('0x' || substr({h}, 17, 1))::INT + 1, 1)"
    return f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || {variant} || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"


@query("m01_derived_ids", f"WITH {V} SELECT version_id, {_uuid5(identity.SPACES['document'], "tenant_id || '|' || source_id || '|' || external_id")} AS doc, {_uuid5(identity.SPACES['version'], "document_id || '|' || content_hash")} AS ver FROM v")
def _m01(spark, d):
    v = versions(spark, d)
    return v.select("version_id", identity.derived_id("document", v.tenant_id, v.source_id, v.external_id).alias("doc"), identity.derived_id("version", v.document_id, v.content_hash).alias("ver"))


@query("m03_hashes", "SELECT doc_id, sha256(text) AS digest FROM documents WHERE text IS NOT NULL")
def _m03(spark, d):
    return load(spark, d, "documents", "doc_id", "text").where("text IS NOT NULL").select("doc_id", identity.content_hash(F.col("text")).alias("digest"))


@query("m04_object_keys", rf"WITH {V} SELECT version_id, CASE WHEN t = '' THEN 'default' ELSE t END || '/' || document_id || '/' || content_hash || '.md' AS key FROM (SELECT *, substr(regexp_replace(tenant_id, '[^\p{{L}}\p{{N}}_-]', '', 'g'), 1, 64) AS t FROM v)")
def _m04(spark, d):
    v = versions(spark, d)
    return v.select("version_id", identity.object_key(v.tenant_id, v.document_id, v.content_hash, F.lit("m/d")).alias("key"))


@query("m07_next_version", f"WITH {V} SELECT document_id, (max(version_no) + 1)::BIGINT AS next_no FROM v GROUP BY 1")
def _m07(spark, d):
    return versions(spark, d).groupBy("document_id").agg((F.max("version_no") + 1).cast("long").alias("next_no"))


@query("s05_register", f"""WITH {V}, i AS (SELECT DISTINCT document_id, CASE WHEN version_no % 2 = 0 THEN content_hash ELSE sha256(content_hash) END AS content_hash FROM v),
    k AS (SELECT i.* FROM i WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.document_id = i.document_id AND v.content_hash = i.content_hash AND status = 'indexed')),
    m AS (SELECT document_id, max(version_no) AS m FROM v GROUP BY 1)
    SELECT document_id, content_hash, (m + row_number() OVER (PARTITION BY document_id ORDER BY content_hash))::BIGINT AS version_no, 'pending' AS status FROM k JOIN m USING (document_id)""")
def _s05(spark, d):
    v = versions(spark, d)
    incoming = v.select("document_id", F.when(F.col("version_no") % 2 == 0, F.col("content_hash")).otherwise(F.sha2("content_hash", 256)).alias("content_hash"))
    return store.register(incoming, v).withColumn("version_no", F.col("version_no").cast("long"))


@query("r03_validity", f"WITH {V} SELECT document_id, version_id, created_at AS active_from, lead(created_at) OVER (PARTITION BY document_id ORDER BY version_no) AS active_until FROM v")
def _r03(spark, d):
    return library.validity(versions(spark, d))


@query("p12_snapshot", f"""WITH {V}, w AS (SELECT document_id, version_id, created_at AS f, lead(created_at) OVER (PARTITION BY document_id ORDER BY version_no) AS u FROM v)
    SELECT document_id, version_id FROM w WHERE f <= TIMESTAMP '2024-06-01' AND (u IS NULL OR u > TIMESTAMP '2024-06-01')""")
def _p12(spark, d):
    at = F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")
    w = library.validity(versions(spark, d))
    return w.where((F.col("active_from") <= at) & (F.col("active_until").isNull() | (F.col("active_until") > at))).select("document_id", "version_id")


@query("j06_snapshot_join", f"""WITH {V}, w AS (SELECT document_id, version_id, created_at AS f, lead(created_at) OVER (PARTITION BY document_id ORDER BY version_no) AS u FROM v),
    c AS (SELECT DISTINCT document_id, created_at + INTERVAL 30 DAY AS t FROM v)
    SELECT c.document_id, c.t, w.version_id FROM c JOIN w ON c.document_id = w.document_id AND f <= t AND (u IS NULL OR u > t)""")
def _j06(spark, d):
    v = versions(spark, d)
    checks = v.select("document_id", F.expr("created_at + INTERVAL 30 DAYS").alias("t")).distinct()
    w = library.validity(v)
    joined = checks.join(w, "document_id").where((F.col("active_from") <= F.col("t")) & (F.col("active_until").isNull() | (F.col("active_until") > F.col("t"))))
    return joined.select("document_id", "t", "version_id")


@query("t07_superseded", f"WITH {V} SELECT version_id FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY version_no DESC) AS r FROM v) WHERE r > 1")
def _t07(spark, d):
    v = versions(spark, d).select("document_id", "version_id", "version_no")
    last = v.groupBy("document_id").agg(F.max("version_no").alias("_last"))
    return v.join(last, "document_id").where("version_no < _last").select("version_id")


# --- filters and joins ----------------------------------------------------------------------------


@query("p02_filter", f"WITH {B}, {V} SELECT id FROM b JOIN v USING (version_id) WHERE tenant_id = 'atlas' AND kind IN ('text', 'list') AND is_current")
def _p02(spark, d):
    f = visibility.SearchFilter("atlas", kinds=("text", "list"), source_ids=())
    joined = blocks(spark, d, "id", "version_id", "kind").join(versions(spark, d).select("version_id", "tenant_id", "is_current"), "version_id")
    return joined.where(f.predicate()).select("id")


@query("p03_acl_overlap", f"WITH {V} SELECT version_id FROM v WHERE list_has_any(coalesce(acl, ['public']), ['team-a', 'team-b'])")
def _p03(spark, d):
    return versions(spark, d).where(visibility.acl_overlap(F.col("acl"), F.array(F.lit("team-a"), F.lit("team-b")))).select("version_id")


@query("p04_visible", f"WITH {V} SELECT version_id FROM v WHERE coalesce(len(acl), 0) = 0 OR list_contains(acl, 'public') OR list_has_any(acl, ['team-b'])")
def _p04(spark, d):
    return versions(spark, d).where(visibility.document_visible(F.col("acl"), F.array(F.lit("team-b")))).select("version_id")


@query("p05_current", f"WITH {V} SELECT document_id, version_id FROM v WHERE is_current AND status = 'indexed'")
def _p05(spark, d):
    return versions(spark, d).where("is_current AND status = 'indexed'").select("document_id", "version_id")


@query("p06_title_ids", f"WITH {V} SELECT DISTINCT document_id FROM v WHERE is_current AND title ILIKE '%r of%'")
def _p06(spark, d):
    return visibility.titles_matching(versions(spark, d), "R of")


@query("p07_resolve", f"WITH {B}, {V} SELECT id FROM b WHERE document_id IN (SELECT document_id FROM v WHERE is_current AND title ILIKE '%of%') AND document_id IN (SELECT document_id FROM v WHERE lang = 'en')")
def _p07(spark, d):
    v = versions(spark, d)
    titled = visibility.titles_matching(v, "of")
    return visibility.resolve_documents(titled, v.where("lang = 'en'"), blocks(spark, d, "id", "document_id")).select("id")


@query("p08_heading", f"WITH {B}, {S} SELECT b.id FROM b JOIN s ON b.section_id = s.id WHERE contains(lower(array_to_string(heading_path, ' ')), 'of l')")
def _p08(spark, d):
    s = sections(spark, d).select(F.col("id").alias("section_id"), "heading_path")
    return blocks(spark, d, "id", "section_id").join(s, "section_id").where(visibility.heading_contains(F.col("heading_path"), "of L")).select("id")


@query("j01_payload", f"""WITH {B}, {V}, {S}, u AS (SELECT DISTINCT source_id, uri FROM sources)
    SELECT b.id AS chunk_id, v.tenant_id, v.document_id, v.version_id, b.source_id, title, kind, uri, array_to_string(heading_path, ' > ') AS path, length(coalesce(text, ''))::BIGINT AS n, md5(coalesce(text, '')) AS digest,
           b.page::BIGINT AS page, b.char_start::BIGINT AS char_start, b.char_end::BIGINT AS char_end, is_current, array_to_string(acl, ',') AS acl
    FROM b JOIN v USING (version_id) LEFT JOIN s ON b.section_id = s.id LEFT JOIN u ON b.source_id = u.source_id""")
def _j01(spark, d):
    c = library.chunks(spark, d)
    numbers = [F.col(x).cast("long").alias(x) for x in ("page", "char_start", "char_end")]
    return c.select(
        "chunk_id", "tenant_id", "document_id", "version_id", "source_id", "title", "kind", "uri", F.array_join("heading_path", " > ").alias("path"), F.length("text").cast("long").alias("n"),
        F.md5(F.encode("text", "UTF-8")).alias("digest"), *numbers, "is_current", F.array_join("acl", ",").alias("acl"),
    )


@query("j02_library", f"WITH {V}, n AS (SELECT document_id, count(DISTINCT version_id) AS n_versions FROM v GROUP BY 1), c AS (SELECT document_id, count(DISTINCT id) AS n_chunks FROM blocks GROUP BY 1) SELECT document_id, n_versions, coalesce(n_chunks, 0) AS n_chunks FROM n LEFT JOIN c USING (document_id)")
def _j02(spark, d):
    return library.version_counts(versions(spark, d), load(spark, d, "blocks", "id", "document_id"))


@query("j07_span_overlap", f"""WITH {B}, {S} SELECT s.id AS section, b.id AS block FROM s JOIN b ON s.document_id = b.document_id AND b.char_end > s.char_start AND b.char_start < s.char_end WHERE s.char_end > s.char_start AND b.char_end > b.char_start""")
def _j07(spark, d):
    s = sections(spark, d).select(F.col("id").alias("section"), "document_id", F.col("char_start").alias("ss"), F.col("char_end").alias("se"))
    joined = intervals.overlapping(s, blocks(spark, d, "id", "document_id", "char_start", "char_end"), ["document_id"], ("ss", "se"), ("char_start", "char_end"))
    return joined.select("section", F.col("id").alias("block"))


@query("j11_unbuilt", f"WITH {V} SELECT version_id FROM v WHERE status <> 'failed' AND version_id NOT IN (SELECT version_id FROM blocks WHERE version_id IS NOT NULL)")
def _j11(spark, d):
    built = load(spark, d, "blocks", "version_id").distinct()
    return versions(spark, d).where("status <> 'failed'").join(built, "version_id", "left_anti").select("version_id")


@query("j12_visible_blocks", f"WITH {B}, {V} SELECT id FROM b WHERE document_id IN (SELECT document_id FROM v WHERE is_current AND (coalesce(len(acl), 0) = 0 OR list_contains(acl, 'public') OR list_has_any(acl, ['team-a'])))")
def _j12(spark, d):
    seen = versions(spark, d).where(F.col("is_current") & visibility.document_visible(F.col("acl"), F.array(F.lit("team-a")))).select("document_id")
    return blocks(spark, d, "id", "document_id").join(seen, "document_id", "left_semi").select("id")


# --- aggregates, windows, sets --------------------------------------------------------------------


@query("a04_readiness", f"""WITH {V}, x AS (SELECT tenant_id, document_id, bool_or(is_current AND status = 'indexed') AS ready, bool_or(status = 'failed') AS failed FROM v GROUP BY 1, 2)
    SELECT tenant_id, count(*) AS total, count(*) FILTER (ready) AS ready, count(*) FILTER (failed AND NOT ready) AS failed, count(*) FILTER (NOT ready AND NOT failed) AS pending FROM x GROUP BY 1""")
def _a04(spark, d):
    """Documents that are ready, those of the others that failed, and what is left."""
    x = versions(spark, d).groupBy("tenant_id", "document_id").agg(F.bool_or(F.expr("is_current AND status = 'indexed'")).alias("r"), F.bool_or(F.expr("status = 'failed'")).alias("f"))
    return x.groupBy("tenant_id").agg(F.count("*").alias("total"), F.count_if("r").alias("ready"), F.count_if(F.expr("f AND NOT r")).alias("failed"), F.count_if(F.expr("NOT r AND NOT f")).alias("pending"))


@query("a08_states", f"WITH {V} SELECT tenant_id, status, count(*) AS n FROM v GROUP BY 1, 2")
def _a08(spark, d):
    return versions(spark, d).groupBy("tenant_id", "status").agg(F.count("*").alias("n"))


@query("a09_per_source", f"WITH {V} SELECT name, count(DISTINCT document_id) AS n FROM sources s LEFT JOIN v ON s.source_id = v.source_id GROUP BY 1")
def _a09(spark, d):
    per = versions(spark, d).groupBy("source_id").agg(F.countDistinct("document_id").alias("n"))
    return load(spark, d, "sources", "source_id", "name").join(per, "source_id", "left").select("name", F.coalesce("n", F.lit(0)).alias("n"))


@query("s23_counts", "SELECT tenant_id, count(DISTINCT chunk_id) AS n FROM vectors GROUP BY 1")
def _s23(spark, d):
    return load(spark, d, "vectors", "tenant_id", "chunk_id").groupBy("tenant_id").agg(F.countDistinct("chunk_id").alias("n"))


_UPSERT = "SELECT id AS chunk_id, CASE WHEN kind = 'list' THEN 'replaced' ELSE kind END AS kind FROM b"


def _index_and_rows(spark, d):
    """The index, and rows of which some are known and some are new."""
    index = blocks(spark, d, "id", "kind").withColumnRenamed("id", "chunk_id")
    fresh = index.where("kind = 'code'").select(F.concat("chunk_id", F.lit("-new")).alias("chunk_id"), "kind")
    return index, index.where("kind = 'list'").withColumn("kind", F.lit("replaced")).unionByName(fresh)


@query("s21_upsert", f"WITH {B} {_UPSERT} UNION ALL SELECT id || '-new', kind FROM b WHERE kind = 'code'")
def _s21(spark, d):
    return store.upsert(*_index_and_rows(spark, d))


@query("s21_update_only", f"WITH {B} {_UPSERT}")
def _s21_update(spark, d):
    return store.update_only(*_index_and_rows(spark, d))


@query("s22_delete", f"WITH {B}, {V} SELECT id AS chunk_id FROM b WHERE document_id NOT IN (SELECT document_id FROM v WHERE status = 'superseded')")
def _s22(spark, d):
    index = blocks(spark, d, "id", "document_id").withColumnRenamed("id", "chunk_id")
    return store.delete(index, versions(spark, d).where("status = 'superseded'"), "document_id").select("chunk_id")


_SPANS = "x AS (SELECT document_id, char_start::BIGINT AS \"start\", char_end::BIGINT + 1 AS \"end\" FROM b WHERE kind <> 'table' AND char_end > char_start)"
_ISLANDS = f"""{_SPANS}, m AS (SELECT *, max("end") OVER (PARTITION BY document_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM x),
    i AS (SELECT *, sum(CASE WHEN "start" <= r THEN 0 ELSE 1 END) OVER (PARTITION BY document_id ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS g FROM m),
    y AS (SELECT document_id, min("start") AS "start", max("end") AS "end" FROM i GROUP BY document_id, g)"""


def _spans(spark, d):
    b = blocks(spark, d).where("kind <> 'table' AND char_end > char_start")
    return b.select("document_id", "id", F.col("char_start").cast("long").alias("start"), (F.col("char_end") + 1).cast("long").alias("end"))


@query("w04_islands", f'WITH {B}, {_ISLANDS} SELECT document_id, "start", "end" FROM y')
def _w04(spark, d):
    return intervals.merge(_spans(spark, d), ["document_id"])


@query("a05_covered", f'WITH {B}, {_ISLANDS} SELECT document_id, sum("end" - "start")::BIGINT AS covered FROM y GROUP BY 1')
def _a05(spark, d):
    return intervals.covered_length(_spans(spark, d), ["document_id"])


@query("w08_gaps", f'WITH {B}, {_ISLANDS} SELECT document_id, "end" AS "start", n AS "end" FROM (SELECT *, lead("start") OVER (PARTITION BY document_id ORDER BY "start") AS n FROM y) WHERE n IS NOT NULL')
def _w08(spark, d):
    return intervals.gaps(_spans(spark, d), ["document_id"])


@query("u06_subtract", f"""WITH {B}, {S}, {_SPANS}, q AS (SELECT DISTINCT document_id, "start" AS s, max("end") OVER (PARTITION BY document_id, "start", "end") AS e FROM x),
    c AS (SELECT DISTINCT document_id, char_start::BIGINT AS cs, char_end::BIGINT AS ce FROM s WHERE char_end > char_start AND level = 2),
    m AS (SELECT *, max(ce) OVER (PARTITION BY document_id ORDER BY cs, ce ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM c),
    i AS (SELECT *, sum(CASE WHEN cs <= r THEN 0 ELSE 1 END) OVER (PARTITION BY document_id ORDER BY cs, ce ROWS UNBOUNDED PRECEDING) AS g FROM m),
    h AS (SELECT document_id, min(cs) AS hs, max(ce) AS he FROM i GROUP BY document_id, g),
    o AS (SELECT q.document_id, s, e, hs, he FROM q JOIN h ON q.document_id = h.document_id AND hs < e AND he > s),
    p AS (SELECT document_id, he AS a, coalesce(lead(hs) OVER (PARTITION BY document_id, s, e ORDER BY hs), e) AS z FROM o
          UNION ALL SELECT document_id, s, min(hs) FROM o GROUP BY document_id, s, e
          UNION ALL SELECT document_id, s, e FROM q WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.document_id = q.document_id AND o.s = q.s AND o.e = q.e))
    SELECT DISTINCT document_id, a AS "start", z AS "end" FROM p WHERE z > a""")
def _u06(spark, d):
    s = sections(spark, d).where("char_end > char_start AND level = 2").select("document_id", F.col("char_start").cast("long").alias("start"), F.col("char_end").cast("long").alias("end"))
    return intervals.subtract(_spans(spark, d).drop("id"), s, ["document_id"])


@query("f34_coverage", f"""WITH {S}, x AS (SELECT id, document_id, char_start::BIGINT AS a, char_end::BIGINT AS z FROM s WHERE char_end > char_start),
    p AS (SELECT document_id, a AS t FROM x UNION SELECT document_id, z FROM x),
    w AS (SELECT document_id, t AS f, lead(t) OVER (PARTITION BY document_id ORDER BY t) AS u FROM p),
    o AS (SELECT w.document_id, f, u, list_sort(list(DISTINCT id)) AS owners FROM w JOIN x ON w.document_id = x.document_id AND a <= f AND z >= u WHERE u IS NOT NULL GROUP BY 1, 2, 3),
    r AS (SELECT *, CASE WHEN lag(u) OVER l = f AND lag(owners) OVER l = owners THEN 0 ELSE 1 END AS n FROM o WINDOW l AS (PARTITION BY document_id ORDER BY f)),
    g AS (SELECT *, sum(n) OVER (PARTITION BY document_id ORDER BY f) AS k FROM r)
    SELECT document_id, min(f) AS "start", max(u) AS "end", array_to_string(any_value(owners), ',') AS owners FROM g GROUP BY document_id, k""")
def _f34(spark, d):
    x = sections(spark, d).where("char_end > char_start").select("id", "document_id", F.col("char_start").cast("long").alias("start"), F.col("char_end").cast("long").alias("end"))
    return intervals.coverage_segments(x, ["document_id"], "id").withColumn("owners", F.array_join("owners", ","))


@query("c05_allocate", f"""WITH {B}, m AS (SELECT *, max(char_end) OVER (PARTITION BY document_id ORDER BY char_start, char_end, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM b)
    SELECT id AS chunk_id, greatest(char_start, coalesce(r, char_start))::BIGINT AS own_start, char_end::BIGINT AS own_end FROM m WHERE char_end > greatest(char_start, coalesce(r, char_start))""")
def _c05(spark, d):
    c = blocks(spark, d, "id", "document_id", "char_start", "char_end").withColumnRenamed("id", "chunk_id")
    a = intervals.allocate(c, ["document_id"])
    return a.select("chunk_id", F.col("own_start").cast("long").alias("own_start"), F.col("own_end").cast("long").alias("own_end"))


@query("w07_ordinals", f"WITH {B} SELECT id, (row_number() OVER (PARTITION BY version_id ORDER BY char_start, id) - 1)::BIGINT AS ordinal FROM b")
def _w07(spark, d):
    return intervals.numbered(blocks(spark, d, "id", "version_id", "char_start"), ["version_id"], ["char_start", "id"]).select("id", "ordinal")


@query("w05_sentence_windows", r"""WITH x AS (SELECT doc_id, regexp_extract_all(text, E'[^。！？；!?;\n]*[。！？；!?;\n]|[^。！？；!?;\n]+') AS s FROM documents WHERE length(text) > 0),
    y AS (SELECT doc_id, s, unnest(range(0, len(s), 3)) AS a FROM x)
    SELECT doc_id, (a / 3)::BIGINT AS chunk_index, length(array_to_string(list_slice(s, (a + 1)::BIGINT, (a + 4)::BIGINT), ''))::BIGINT AS n FROM y WHERE a = 0 OR a + 1 < len(s)""")
def _w05(spark, d):
    x = load(spark, d, "documents", "doc_id", "text").where(F.length("text") > 0).select("doc_id", T.sentences(F.col("text")).alias("s"))
    y = x.select("doc_id", "s", F.explode(F.sequence(F.lit(0), F.size("s") - 1, F.lit(3))).alias("a")).where("a = 0 OR a + 1 < size(s)")
    return y.select("doc_id", (F.col("a") / 3).cast("long").alias("chunk_index"), F.length(F.array_join(F.slice("s", F.col("a") + 1, F.lit(4)), "")).cast("long").alias("n"))


@query("u03_intersection", f"WITH {V} SELECT document_id FROM v WHERE lang = 'en' INTERSECT SELECT document_id FROM v WHERE status = 'superseded'")
def _u03(spark, d):
    v = versions(spark, d)
    return v.where("lang = 'en'").select("document_id").intersect(v.where("status = 'superseded'").select("document_id"))


@query("u04_outstanding", f"WITH {V} SELECT document_id FROM v EXCEPT SELECT document_id FROM v WHERE status = 'indexed'")
def _u04(spark, d):
    v = versions(spark, d)
    return v.select("document_id").exceptAll(v.where("1 = 0").select("document_id")).distinct().subtract(v.where("status = 'indexed'").select("document_id"))


@query("l06_page", f"WITH {V} SELECT document_id, version_no::BIGINT AS version_no, title FROM v ORDER BY created_at DESC, version_id OFFSET 20 LIMIT 50")
def _l06(spark, d):
    return versions(spark, d).orderBy(F.desc("created_at"), "version_id").offset(20).limit(50).select("document_id", F.col("version_no").cast("long").alias("version_no"), "title")


@query("c09_shelves", f"WITH {V} SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY coalesce(title, ''), document_id)::BIGINT AS place, coalesce(title, '') AS title, document_id FROM v WHERE is_current")
def _c09(spark, d):
    return library.shelves(versions(spark, d))


# --- retrieval ------------------------------------------------------------------------------------

_TF = f"t AS (SELECT id AS chunk_id, unnest({_tokens('text')}) AS term FROM b WHERE text IS NOT NULL), tf AS (SELECT chunk_id, term, count(*) AS tf FROM t GROUP BY 1, 2)"


def _chunk_texts(spark, d):
    return blocks(spark, d, "id", "text").select(F.col("id").alias("chunk_id"), "text").where("text IS NOT NULL")


@query("s19_index_statistics", f"WITH {B}, {_TF} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM tf GROUP BY 1")
def _s19(spark, d):
    tf = lexical.postings(_chunk_texts(spark, d))
    return tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


_BM25 = f"""{B}, {Q}, {_TF}, dl AS (SELECT chunk_id, sum(tf) AS dl FROM tf GROUP BY 1), n AS (SELECT count(*) AS n, avg(dl) AS a FROM dl),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), qt AS (SELECT DISTINCT query_id, unnest({_tokens("query")}) AS term FROM q WHERE query IS NOT NULL),
    h AS (SELECT query_id, tf.chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 6) AS score
          FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN dl ON dl.chunk_id = tf.chunk_id, n GROUP BY 1, 2)"""


def _lexical_hits(spark, d):
    """The ten best chunks of every request by BM25."""
    delivered = load(spark, d, "blocks", "id", "text").select(F.col("id").alias("chunk_id"), "text").where("text IS NOT NULL")
    asked = requests(spark, d).where("query IS NOT NULL").select("query_id", T.tokens(F.col("query")).alias("terms"))
    return lexical.best(asked, lexical.index_in_place(delivered), 10)


@query("f16_bm25", f"WITH {_BM25} SELECT query_id, chunk_id, score, r::BIGINT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM h) WHERE r <= 10")
def _f16(spark, d):
    return _lexical_hits(spark, d).withColumn("rank", F.col("rank").cast("long"))


_USABLE = "u AS (SELECT DISTINCT chunk_id, tenant_id, dense::DOUBLE[] AS x FROM vectors WHERE len(dense) = 64 AND len(list_filter(dense, lambda y: isnan(y) OR isinf(y))) = 0 AND len(list_filter(dense, lambda y: y <> 0)) > 0)"


@query("j13_nearest", f"""WITH {_USABLE}, q AS (SELECT * FROM u WHERE ('0x' || substr(md5(chunk_id), 1, 8))::BIGINT % 100 = 0),
    s AS (SELECT q.chunk_id AS query_id, u.chunk_id, list_cosine_similarity(q.x, u.x) AS c FROM q, u WHERE q.chunk_id <> u.chunk_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, chunk_id) AS rank FROM s) SELECT query_id, chunk_id, round(c, 4) AS score, rank::BIGINT AS rank FROM r WHERE rank <= 10""")
def _j13(spark, d):
    """Queries: every hundredth chunk, by hash of its id, against all."""
    v = delivered_once(spark, d, "vectors", "chunk_id", "tenant_id", "dense")
    asked = v.where(F.conv(F.substring(F.md5(F.encode("chunk_id", "UTF-8")), 1, 8), 16, 10).cast("long") % 100 == 0).select(F.col("chunk_id").alias("query_id"), "tenant_id", "dense")
    best = lexical.top(dense.nearest(asked, v, 10, 64), 10)
    return best.withColumn("score", F.round("score", 4)).withColumn("rank", F.col("rank").cast("long"))


def _asked_blocks(spark, d):
    """Requests with all blocks of the documents they hit."""
    h = delivered_once(spark, d, "fused_hits", "query_id", "document_id")
    b = blocks(spark, d, "id", "document_id", "kind", "text").where("text IS NOT NULL").select(F.col("id").alias("chunk_id"), "document_id", "kind", "text")
    return h.join(requests(spark, d).where("query IS NOT NULL").select("query_id", "query"), "query_id").join(b, "document_id")


_RUNS = """f AS (SELECT DISTINCT query_id, chunk_id, dense_score, sparse_score FROM fused_hits),
    l AS (SELECT query_id, chunk_id, 'dense' AS retriever, dense_score AS s FROM f WHERE dense_score IS NOT NULL UNION ALL SELECT query_id, chunk_id, 'sparse', sparse_score FROM f WHERE sparse_score IS NOT NULL),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id, retriever ORDER BY s DESC, chunk_id) AS r FROM l)"""


@query("f17_rrf", f"WITH {_RUNS} SELECT query_id, chunk_id, round(sum(1.0 / (60 + r)), 9) AS score, array_to_string(list(retriever || ':' || r ORDER BY retriever), ',') AS ranks FROM k GROUP BY 1, 2")
def _f17(spark, d):
    f = delivered_once(spark, d, "fused_hits", "query_id", "chunk_id", "dense_score", "sparse_score")
    runs = f.select("query_id", "chunk_id", F.expr("stack(2, 'dense', dense_score, 'sparse', sparse_score) AS (retriever, score)")).where("score IS NOT NULL")
    fused = fusion.reciprocal_rank(runs)
    named = F.transform(F.array_sort(F.map_entries("contributions")), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))
    return fused.select("query_id", "chunk_id", F.round("score", 9).alias("score"), F.array_join(named, ",").alias("ranks"))


@query("f18_rerank", f"""WITH {B}, {Q}, h AS (SELECT DISTINCT query_id, document_id FROM fused_hits),
    x AS (SELECT query_id, b.id AS chunk_id, list_distinct({_tokens("query")}) AS t, {_tokens("text")} AS c FROM h JOIN q USING (query_id) JOIN b ON b.document_id = h.document_id WHERE query IS NOT NULL AND text IS NOT NULL)
    SELECT query_id, chunk_id, CASE WHEN len(t) = 0 OR len(c) = 0 THEN 0.0 ELSE round(0.7 * len(list_intersect(t, list_distinct(c))) / len(t)::DOUBLE
      + 0.2 * least(len(list_filter(c, lambda y: list_contains(t, y))) / (sqrt(len(c)) + 1.0), 1.0)
      + 0.1 * (1.0 - coalesce(list_min(list_filter(list_transform(t, lambda y: list_position(c, y)), lambda p: p > 0)) - 1, len(c)) / len(c)::DOUBLE), 6) END AS rerank_score FROM x""")
def _f18(spark, d):
    # A block is taken apart once, however many requests hit its document.
    b = blocks(spark, d, "id", "document_id", "text").where("text IS NOT NULL").select(F.col("id").alias("chunk_id"), "document_id", T.tokens(F.col("text")).alias("c"))
    q = requests(spark, d).where("query IS NOT NULL").select("query_id", T.tokens(F.col("query")).alias("t"))
    tokenized = delivered_once(spark, d, "fused_hits", "query_id", "document_id").join(q, "query_id").join(b, "document_id")
    return tokenized.select("query_id", "chunk_id", fusion.coverage_score(F.col("t"), F.col("c")).alias("rerank_score"))


@query("f20_snippets")
def _f20(spark, d):
    x = _asked_blocks(spark, d)
    terms = F.filter(F.array_distinct(T.tokens(F.col("query"))), lambda t: F.length(t) > 1)
    return x.select("query_id", "chunk_id", T.snippet(F.col("text"), terms, 80).alias("snippet"))


@query("f12_hash_embedding")
def _f12(spark, d):
    return dense.with_hash_embedding(_chunk_texts(spark, d), "text", "dense", search.DIM).select("chunk_id", "dense")


@query("c1_hybrid_search")
def _c1(spark, d):
    asked = requests(spark, d).where("query IS NOT NULL")
    return search.hybrid(asked, library.chunks(spark, d, once=False)).withColumn("contributions", F.to_json("contributions"))


@query("c1_hybrid_folded")
def _c1_folded(spark, d):
    asked = requests(spark, d).where("query IS NOT NULL")
    return search.hybrid(asked, library.chunks(spark, d, once=False), folded=True).withColumn("contributions", F.to_json("contributions"))


# --- reuse ----------------------------------------------------------------------------------------

_PLAIN = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"
_MARKS = T.CITATION_MARK
_PRINTS = rf"""x AS (SELECT doc_id, regexp_extract_all(trim(regexp_replace(lower(regexp_replace(text, '{_MARKS}', '', 'g')), '\s+', ' ', 'g')), '(?s).') AS p FROM documents WHERE text IS NOT NULL),
    c AS (SELECT doc_id, unnest(p) AS c, unnest(range(1, len(p) + 1)) AS i FROM x),
    g AS (SELECT doc_id, i, c || lead(c, 1) OVER o || lead(c, 2) OVER o || lead(c, 3) OVER o || lead(c, 4) OVER o AS g FROM c WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    h AS (SELECT doc_id, i, ('0x' || substr(md5(g), 1, 15))::BIGINT AS h, count(*) OVER (PARTITION BY doc_id) AS n FROM g WHERE g IS NOT NULL),
    m AS (SELECT doc_id, i, n, min(h) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS m FROM h),
    e AS (SELECT DISTINCT doc_id, m AS fingerprint FROM m WHERE i <= greatest(n - 7, 1))"""


def _prints(spark, d):
    texts = spread(load(spark, d, "documents", "doc_id", "text").where("text IS NOT NULL"))
    return reuse.with_fingerprints(texts, "text", "f", kernel="md5").select("doc_id", "f")


@query("f26_winnow", f"WITH {_PRINTS} SELECT doc_id, count(*) AS n, min(fingerprint) AS low, max(fingerprint) AS high FROM e GROUP BY 1")
def _f26(spark, d):
    f = _prints(spark, d).where(F.size("f") > 0)
    return f.select("doc_id", F.size("f").cast("long").alias("n"), F.array_min("f").alias("low"), F.array_max("f").alias("high"))


@query("a01_fingerprint_df", f"WITH {_PRINTS}, y AS (SELECT fingerprint, count(*) AS df FROM e GROUP BY 1) SELECT df, count(*) AS n FROM y GROUP BY 1")
def _a01(spark, d):
    index = _prints(spark, d).select(F.col("doc_id").alias("document_id"), F.explode("f").alias("fingerprint"))
    return reuse.frequencies(index).groupBy("df").agg(F.count("*").alias("n"))


@query("a02_stop_list", f"""WITH {_PRINTS}, n AS (SELECT count(DISTINCT doc_id) AS n FROM e)
    SELECT fingerprint, count(DISTINCT doc_id) AS df FROM e, n GROUP BY fingerprint, n HAVING n >= 3 AND count(DISTINCT doc_id) > greatest(1, floor(n * 0.02))""")
def _a02(spark, d):
    index = written(_prints(spark, d).select(F.col("doc_id").alias("document_id"), F.explode("f").alias("fingerprint")))
    return reuse.stop_list(index, 0.02)


@query("r04_candidates", f"""WITH {_PRINTS}, f AS (SELECT doc_id, fingerprint AS fp FROM e), n AS (SELECT count(DISTINCT doc_id) AS n FROM f),
    st AS (SELECT fp FROM f, n GROUP BY fp, n HAVING n >= 3 AND count(*) > greatest(1, floor(n * 0.25))),
    p AS (SELECT doc_id, fp, fp IN (SELECT fp FROM st) AS stop FROM f WHERE doc_id % 100 = 0),
    k AS (SELECT doc_id, fp FROM (SELECT *, sum(CASE WHEN stop THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id) AS free FROM p) WHERE NOT stop OR free = 0),
    s AS (SELECT k.doc_id AS query_id, f.doc_id AS document_id, count(*) AS shared FROM k JOIN f USING (fp) WHERE k.doc_id <> f.doc_id GROUP BY 1, 2)
    SELECT query_id, document_id, shared FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, document_id) AS r FROM s) WHERE r <= 50""")
def _r04(spark, d):
    """Checked documents: those whose id is divisible by 100, against all."""
    texts = load(spark, d, "documents", "doc_id", "text").where("text IS NOT NULL").withColumnRenamed("doc_id", "document_id")
    prints = lambda x: reuse.with_fingerprints(spread(x), "text", "f", kernel="md5").select("document_id", "f")
    return reuse.best_shared(prints(texts.where("document_id % 100 = 0")), prints(texts))


@query("r11_reuse_report")
def _r11(spark, d):
    """Aligned passages of the checked documents with all that share five fingerprints or more."""
    texts = spread(load(spark, d, "documents", "doc_id", "text").where("text IS NOT NULL"))
    prints = written(reuse.with_fingerprints(texts.withColumnRenamed("doc_id", "document_id"), "text", "f", kernel="md5"))
    index = prints.select("document_id", F.explode("f").alias("fingerprint"))
    probes = index.where("document_id % 100 = 0").withColumn("query_id", F.col("document_id"))
    asked = reuse.used(probes, index).groupBy("query_id").agg(F.collect_set("fingerprint").alias("f"))
    asked = asked.join(prints.select(F.col("document_id").alias("query_id"), "text"), "query_id")
    found = cut(align.align_probes(asked, prints, 5))
    kept = align.one_per_place(found)
    sizes = prints.select(F.col("document_id").alias("query_id"), F.length("text").alias("n_chars"))
    return reports.rollup(kept, sizes).withColumn("score", F.round("score", 6))


@query("f25_blake_fingerprints")
def _f25(spark, d):
    done = reuse.with_fingerprints(spread(load(spark, d, "documents", "doc_id", "text")), "text")
    return done.select("doc_id", F.size("fingerprints").alias("n"))


# --- parsing --------------------------------------------------------------------------------------


_BLANK_SQL = r"[\s\x{00A0}\x{0085}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{001C}-\x{001F}\x{000B}]"
_BLANK = r"[\s\u00A0\u0085\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\u001C-\u001F]"


@query("f07_chunks", f"""WITH {B}, x AS (SELECT id, kind, text, coalesce(char_start, 0) AS a, length(regexp_extract(text, '^{_BLANK_SQL}*')) AS l, length(regexp_extract(text, '{_BLANK_SQL}*$')) AS r FROM b WHERE regexp_matches(text, '[^{_BLANK_SQL[1:]}'))
    SELECT id, (CASE WHEN kind = 'table' THEN a ELSE a + l END)::BIGINT AS first, (CASE WHEN kind = 'table' THEN a + length(text) ELSE a + length(text) - r END)::BIGINT AS last,
           md5(regexp_replace(text, '{_BLANK_SQL}', '', 'g')) AS digest, true AS fitting FROM x""")
def _f07(spark, d):
    """Of every block where its chunks begin and end, what they hold together but for blanks, and whether all slice back and keep the limit."""
    b = blocks(spark, d, "id", "kind", "text", "char_start")
    c = parse.chunk_blocks(b).join(b.select("id", F.col("text").alias("_t"), F.coalesce("char_start", F.lit(0)).alias("_at")), "id")
    ok = (F.substring("_t", F.col("char_start") - F.col("_at") + 1, F.col("char_end") - F.col("char_start")) == F.col("text")) & ((F.length("text") <= 4000) | (F.col("kind") == "table"))
    # The chunks of one block are bounded by its text.
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), "")
    found = c.groupBy("id").agg(F.min("char_start").cast("long").alias("first"), F.max("char_end").cast("long").alias("last"), F.regexp_replace(whole, _BLANK, "").alias("_w"), F.min(ok).alias("fitting"))
    return found.select("id", "first", "last", F.md5(F.encode("_w", "UTF-8")).alias("digest"), "fitting")


_NORMAL = _strip(r"regexp_replace(regexp_replace(regexp_replace(text, E'\r\n|\r', E'\n', 'g'), '[ \t　]+', ' ', 'g'), E'\n{3,}', E'\n\n', 'g')")
_ATX = r"(?m)^#{1,6}[ \t]+[^\n]*$"


@query("s14_markdown", rf"""WITH n AS (SELECT doc_id, {_NORMAL} AS t FROM documents WHERE text IS NOT NULL),
    l AS (SELECT doc_id, t, list_transform(string_split(t, E'\n'), lambda x: regexp_replace(x, '^[\s　]+|[\s　]+$', '', 'g')) AS x FROM n),
    p AS (SELECT doc_id, CASE WHEN regexp_matches(t, '(?m)^#{{1,6}}\s+\S') THEN t ELSE array_to_string(list_transform(x, lambda y:
        CASE WHEN length(y) BETWEEN 1 AND {T.HEADING_LENGTH} AND NOT regexp_matches(y, '{T.NO_HEADING_END}') AND regexp_matches(y, '{T.HEADING}') THEN '## ' || y ELSE y END), E'\n') END AS m FROM l),
    q AS (SELECT doc_id, {_strip("m")} AS m FROM p)
    SELECT doc_id || '.md' AS path, 'text' AS parser, (1 + len(regexp_extract_all(m, '{_ATX}')))::INT AS n_sections,
           len(list_filter(regexp_split_to_array(m, '{_ATX}'), lambda y: regexp_matches(y, '\S')))::INT AS n_blocks FROM q""")
def _s14(spark, d):
    """Sections and blocks of every document's text."""
    files = load(spark, d, "documents", "doc_id", "text").where("text IS NOT NULL").select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.encode("text", "UTF-8").alias("content"))
    done = parse.parse_documents(files)
    return done.select("path", "parser", F.size("sections").alias("n_sections"), F.size("blocks").alias("n_blocks"))


# --- jobs and streams -----------------------------------------------------------------------------

_LOG = "l AS (SELECT user_id AS job_id, event_id AS seq, CASE event_type WHEN 'view' THEN 'parsing' WHEN 'click' THEN 'chunking' WHEN 'purchase' THEN 'embedding' WHEN 'signup' THEN 'retry_wait' ELSE 'failed' END AS state FROM events)"


def _log(spark, d):
    state = F.create_map(*map(F.lit, ("view", "parsing", "click", "chunking", "purchase", "embedding", "signup", "retry_wait")))
    return load(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.coalesce(F.element_at(state, F.col("event_type")), F.lit("failed")).alias("state"))


@query("t01_states", f"WITH {_LOG} SELECT job_id, arg_max(state, seq) AS state, max(seq) AS seq FROM l GROUP BY 1")
def _t01(spark, d):
    return jobs.current_states(_log(spark, d))


@query("t02_replay")
def _t02(spark, d):
    return jobs.replay(_log(spark, d), jobs.INGEST)


@query("t08_resume", "SELECT event_id, user_id, event_type FROM events WHERE event_id > (SELECT max(event_id) // 2 FROM events)")
def _t08(spark, d):
    log = load(spark, d, "events", "event_id", "user_id", "event_type")
    last = log.agg(F.floor(F.max("event_id") / 2)).first()[0]
    return jobs.events_after(log, last)


@query("t10_rate", "SELECT event_id AS id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS in_window FROM events")
def _t10(spark, d):
    asked = load(spark, d, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"))
    return jobs.rate_usage(asked.withColumn("ts", F.col("ts").cast("timestamp")), 3_600).select("id", "in_window")


@query("t13_usage", "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _t13(spark, d):
    events = load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return jobs.usage_by_window(events).select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("t04_retry", f"WITH {_LOG}, f AS (SELECT job_id, count(*) AS attempts FROM l WHERE state = 'failed' GROUP BY 1) SELECT job_id, attempts, CASE WHEN attempts < 3 THEN 'retry_wait' ELSE 'failed' END AS state, CASE WHEN attempts < 3 THEN least(5.0 * 2 ** (attempts - 1), 600.0)::DOUBLE END AS delay FROM f")
def _t04(spark, d):
    failures = _log(spark, d).where("state = 'failed'").groupBy("job_id").agg(F.count("*").alias("attempts"))
    return jobs.retry_plan(failures)


@query("t05_stream_drain", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _t05(spark, d):
    """The events table as a file stream, drained once into the shared folder and counted."""
    import uuid

    from lectern.session import shared_dir

    base = f"{shared_dir(spark)}/drain-{uuid.uuid4().hex}"
    jobs.drain(jobs.file_stream(spark, d, "events.parquet").select("event_id", "event_type"), f"{base}/out", f"{base}/log")
    return spark.read.parquet(f"{base}/out").groupBy("event_type").agg(F.count("*").alias("n"))
