"""Further queries of the core: metadata, reading, reports, projections; each beside the SQL it must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.catalog import _BM25, _ISLANDS, B, Q, S, V, _asked_blocks, _chunk_texts, _less, _lexical_hits, _strip, blocks, query, requests, sections, versions
from lectern.functions import highlights, text as T
from lectern.operators import intervals, lexical, projection, reuse
from lectern.plans import library, metadata, reading, reports, search
from lectern.sources import parse, store
from lectern.sources.tables import delivered_once, load, spread

_VISIBLE = "(coalesce(len(acl), 0) = 0 OR list_contains(acl, 'public') OR list_has_any(acl, ['team-a']))"

# --- requests and the index -----------------------------------------------------------------------


@query("p15_validation", f"""WITH {Q} SELECT query_id, CASE WHEN coalesce(length({_strip("query")}), 0) = 0 THEN 'no_query' WHEN length(query) > 2000 THEN 'query_too_long'
    WHEN NOT coalesce(top_k, 10) BETWEEN 1 AND 100 THEN 'invalid_top_k' WHEN coalesce(mode, 'hybrid') NOT IN ('hybrid', 'dense', 'sparse') THEN 'invalid_mode' END AS reason FROM q""")
def _p15(spark, d):
    return search.checked(requests(spark, d)).select("query_id", "reason")


@query("s12_titles", r"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'notes-' || doc_id ELSE substr(regexp_extract(coalesce(text, ''), '(?m)^\s*(\S.*?)\s*$', 1), 1, 120) END AS title FROM documents""")
def _s12(spark, d):
    """Titles of files named after the document, and of files without a name."""
    name = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("in/notes-"), F.col("doc_id").cast("string"), F.lit(".MD"))).otherwise("")
    return load(spark, d, "documents", "doc_id", "text").select("doc_id", T.title_from(name, F.col("text")).alias("title"))


@query("s20_backfill", f"WITH {B} SELECT id AS chunk_id, md5(array_to_string({T.tokens_sql('text')}, ' ')) AS digest FROM b WHERE text IS NOT NULL")
def _s20(spark, d):
    """Index forms of all chunks, of which half had none."""
    half = F.when(F.substring("chunk_id", 1, 1) < "8", T.analyze(F.col("text"))).otherwise("")
    done = search.backfilled(_chunk_texts(spark, d).withColumn("analyzed", half))
    return done.select("chunk_id", F.md5(F.encode("analyzed", "UTF-8")).alias("digest"))


@query("s18_to_embed", f"WITH {B} SELECT id AS chunk_id FROM b WHERE text IS NOT NULL AND NOT (substr(id, 1, 1) < '8' AND length(text) > 100)")
def _s18(spark, d):
    """Chunks that a broken-off run with another model has left."""
    chunks = _chunk_texts(spark, d)
    old = chunks.select("chunk_id", F.when((F.substring("chunk_id", 1, 1) < "8") & (F.length("text") > 100), "hash-128").otherwise("hash-64").alias("model"))
    return search.to_embed(chunks, old, "hash-128").select("chunk_id")


@query("m19_replace", f"WITH {B} SELECT id AS chunk_id, kind FROM b WHERE kind <> 'table' UNION ALL SELECT id || '-new', kind FROM b WHERE kind = 'table'")
def _m19(spark, d):
    """All chunks of some kind replaced together."""
    index = blocks(spark, d, "id", "kind").withColumnRenamed("id", "chunk_id")
    return store.replace(index, index.where("kind = 'table'").withColumn("chunk_id", F.concat("chunk_id", F.lit("-new"))), "kind")


@query("c04_trace", f"""WITH {_BM25}, k AS (SELECT query_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM h) WHERE r <= 10),
    c AS (SELECT query_id, count(*) AS n FROM k GROUP BY 1) SELECT query_id, coalesce(n, 0)::BIGINT AS n_results, coalesce(n, 0)::BIGINT AS n_sparse, 0::BIGINT AS n_dense FROM q LEFT JOIN c USING (query_id)""")
def _c04(spark, d):
    """What the lexical retriever alone gives each request."""
    results = _lexical_hits(spark, d).withColumn("contributions", F.create_map(F.lit("sparse"), F.col("rank")))
    return search.trace(requests(spark, d), results).select("query_id", "n_results", "n_sparse", "n_dense")


# --- metadata -------------------------------------------------------------------------------------


@query("m05_sources", """WITH s AS (SELECT DISTINCT source_id, tenant_id, name, kind, uri FROM sources), i AS (SELECT source_id, tenant_id, name, '' AS kind, 'https://mirror/' || name AS uri FROM s WHERE uri IS NULL
      UNION ALL SELECT source_id || '-b', tenant_id, name || ' B', 'crawl', NULL FROM s WHERE kind = 'upload')
    SELECT source_id, coalesce(s.tenant_id, i.tenant_id) AS tenant_id, coalesce(s.name, i.name) AS name, coalesce(nullif(i.kind, ''), s.kind) AS kind, coalesce(nullif(i.uri, ''), s.uri) AS uri FROM s FULL JOIN i USING (source_id)""")
def _m05(spark, d):
    """Sources with what a crawl found: addresses for those without, and new ones."""
    s = delivered_once(spark, d, "sources", "source_id", "tenant_id", "name", "kind", "uri")
    known = s.where("uri IS NULL").withColumn("kind", F.lit("")).withColumn("uri", F.concat(F.lit("https://mirror/"), "name"))
    new = s.where("kind = 'upload'").select(F.concat("source_id", F.lit("-b")).alias("source_id"), "tenant_id", F.concat("name", F.lit(" B")).alias("name"), F.lit("crawl").alias("kind"), F.lit(None).cast("string").alias("uri"))
    return metadata.merge(s, known.unionByName(new), ["source_id"], fixed=("tenant_id", "name"))


@query("m06_documents", f"""WITH {V}, c AS (SELECT document_id, title, acl FROM v WHERE is_current), i AS (SELECT document_id, upper(title) AS title, CASE WHEN lang = 'en' THEN ['team-x'] ELSE []::VARCHAR[] END AS acl FROM v WHERE is_current AND (lang = 'en' OR title LIKE 'A%')
      UNION ALL SELECT document_id || '-new', NULL, NULL FROM v WHERE is_current AND status = 'failed')
    SELECT document_id, coalesce(nullif(i.title, ''), c.title, 'untitled') AS title, array_to_string(coalesce(CASE WHEN len(i.acl) > 0 THEN i.acl END, c.acl, ['public']), ',') AS acl FROM c FULL JOIN i USING (document_id)""")
def _m06(spark, d):
    v = versions(spark, d).where("is_current")
    given = v.where("lang = 'en' OR title LIKE 'A%'").select("document_id", F.upper("title").alias("title"), F.when(F.coalesce(F.col("lang") == "en", F.lit(False)), F.array(F.lit("team-x"))).otherwise(F.array().cast("array<string>")).alias("acl"))
    new = v.where("status = 'failed'").select(F.concat("document_id", F.lit("-new")).alias("document_id"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("array<string>").alias("acl"))
    merged = metadata.merge(v.select("document_id", "title", "acl"), given.unionByName(new), ["document_id"], defaults={"title": F.lit("untitled"), "acl": F.array(F.lit("public"))})
    return merged.withColumn("acl", F.array_join("acl", ","))


@query("m08_versions", f"WITH {V} SELECT document_id, string_agg(version_no || ':' || status, ' ' ORDER BY version_no) AS listed FROM v GROUP BY 1")
def _m08(spark, d):
    return library.version_lists(versions(spark, d))


@query("m12_cascade", f"""WITH {B}, {V}, {S}, g AS (SELECT DISTINCT document_id FROM v WHERE status = 'superseded')
    SELECT 'blocks' AS name, count(*) AS n FROM b WHERE document_id NOT IN (SELECT document_id FROM g) UNION ALL SELECT 'sections', count(*) FROM s WHERE document_id NOT IN (SELECT document_id FROM g)
    UNION ALL SELECT 'versions', count(*) FROM v WHERE document_id NOT IN (SELECT document_id FROM g)""")
def _m12(spark, d):
    """Rows that are left in every table when the documents with a superseded version go."""
    v = versions(spark, d)
    left = metadata.cascade({"blocks": blocks(spark, d, "id", "document_id"), "sections": sections(spark, d), "versions": v}, v.where("status = 'superseded'"))
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in left.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("m14_principals", f"""WITH {Q}, k AS (SELECT sha256(name) AS key_hash, tenant_id, ['team-' || kind] AS acl, kind <> 'upload' AS active FROM (SELECT DISTINCT source_id, name, tenant_id, kind FROM sources)),
    n AS (SELECT list(name ORDER BY name) AS names FROM sources), p AS (SELECT query_id AS request_id, CASE WHEN length(query) % 3 = 0 THEN '' WHEN length(query) % 3 = 1 THEN names[1 + length(query) % len(names)] ELSE query END AS api_key FROM q, n WHERE query IS NOT NULL)
    SELECT request_id, CASE WHEN api_key = '' THEN 'default' ELSE k.tenant_id END AS tenant_id, CASE WHEN api_key = '' THEN '' ELSE coalesce(array_to_string(k.acl, ','), '') END AS acl, api_key = '' OR k.tenant_id IS NOT NULL AS known
    FROM p LEFT JOIN k ON key_hash = sha256(api_key) AND active""")
def _m14(spark, d):
    """Requests with no key, one of a source, or a wrong one."""
    s = delivered_once(spark, d, "sources", "source_id", "name", "tenant_id", "kind")
    keys = s.select(F.sha2(F.encode("name", "UTF-8"), 256).alias("key_hash"), "tenant_id", F.array(F.concat(F.lit("team-"), "kind")).alias("acl"), (F.col("kind") != "upload").alias("active"))
    names = s.agg(F.array_sort(F.collect_list("name")).alias("names"))
    n = F.length("query")
    key = F.when(n % 3 == 0, "").when(n % 3 == 1, F.element_at("names", n % F.size("names") + 1)).otherwise(F.col("query"))
    presented = requests(spark, d).where("query IS NOT NULL").join(F.broadcast(names)).select(F.col("query_id").alias("request_id"), key.alias("api_key"))
    return metadata.principals(presented, keys).withColumn("acl", F.array_join("acl", ","))


_JOBS = f"j AS (SELECT version_id AS job_id, CASE WHEN status = 'pending' THEN 'pending' WHEN version_no % 2 = 0 THEN 'running' ELSE status END AS state, created_at AS available_at, created_at, created_at + INTERVAL 10 DAY AS lease_until FROM v)"


@query("l08_claim", f"""WITH {V}, {_JOBS} SELECT job_id FROM j WHERE state = 'pending' AND available_at <= TIMESTAMP '2024-09-01' OR state = 'running' AND lease_until < TIMESTAMP '2024-09-01' ORDER BY available_at, created_at, job_id LIMIT 25""")
def _l08(spark, d):
    state = F.when(F.col("status") == "pending", "pending").when(F.col("version_no") % 2 == 0, "running").otherwise(F.col("status"))
    jobs = versions(spark, d).select(F.col("version_id").alias("job_id"), state.alias("state"), F.col("created_at").alias("available_at"), "created_at", F.expr("created_at + INTERVAL 10 DAYS").alias("lease_until"))
    return metadata.claim(jobs, F.lit("2024-09-01 00:00:00").cast("timestamp_ntz"), 25).select("job_id")


@query("m17_enqueue", f"""WITH {V} SELECT document_id, content_hash, CASE WHEN status = 'failed' AND is_current THEN 'pending' ELSE status END AS state FROM v UNION ALL SELECT document_id, sha256(content_hash), 'pending' FROM v WHERE is_current""")
def _m17(spark, d):
    v = versions(spark, d)
    jobs = v.select("document_id", "content_hash", F.col("status").alias("state"))
    wanted = v.where("is_current").select("document_id", F.explode(F.array("content_hash", F.sha2("content_hash", 256))).alias("content_hash"))
    # Only failed ones and new keys change by being asked for.
    return metadata.enqueue(jobs, wanted, ["document_id", "content_hash"])


@query("a15_live_workers", "WITH m AS (SELECT max(ts) AS now FROM events) SELECT user_id AS worker_id FROM events, m GROUP BY user_id, now HAVING max(ts) >= now - INTERVAL 6 HOUR")
def _a15(spark, d):
    """Users as workers, their events as heartbeats, live in the last six hours."""
    beats = load(spark, d, "events", "user_id", "ts").select(F.col("user_id").alias("worker_id"), F.col("ts").cast("timestamp_ntz").alias("at"))
    now = F.lit(beats.agg(F.max("at")).first()[0])
    return metadata.live_workers(beats, now, 6 * 3_600).select("worker_id")


@query("r19_retired", f"""WITH {V}, {Q}, w AS (SELECT tenant_id, version_id, created_at AS f, lead(created_at) OVER (PARTITION BY document_id ORDER BY version_no) AS u FROM v),
    a AS (SELECT tenant_id, min(created_at) AS o FROM v WHERE status = 'pending' GROUP BY 1)
    SELECT version_id FROM w LEFT JOIN a USING (tenant_id) WHERE u IS NOT NULL AND u <= least(TIMESTAMP '2025-01-01', coalesce(o, TIMESTAMP '2025-01-01'))""")
def _r19(spark, d):
    v = versions(spark, d)
    kept = library.validity(v).join(v.select("version_id", "tenant_id"), "version_id")
    snapshots = v.where("status = 'pending'").select("tenant_id", F.col("created_at").alias("snapshot_at"))
    return metadata.retired(kept, snapshots, F.lit("2025-01-01 00:00:00").cast("timestamp_ntz")).select("version_id")


@query("a11_oldest_snapshot", f"WITH {V} SELECT tenant_id, min(created_at) AS oldest FROM v WHERE status = 'pending' GROUP BY 1")
def _a11(spark, d):
    return versions(spark, d).where("status = 'pending'").groupBy("tenant_id").agg(F.min("created_at").alias("oldest"))


@query("r20_outstanding", f"WITH {V}, w AS (SELECT version_id, lead(created_at) OVER (PARTITION BY document_id ORDER BY version_no) AS u, status FROM v) SELECT tenant_id, version_id FROM v WHERE is_current AND version_id NOT IN (SELECT version_id FROM w WHERE u IS NULL AND status = 'indexed')")
def _r20(spark, d):
    v = versions(spark, d)
    built = library.validity(v).join(v.where("status = 'indexed'").select("version_id"), "version_id", "left_semi")
    return metadata.outstanding(v, built)


@query("m20_within_limit", f"""WITH {Q}, {V}, a AS (SELECT tenant_id AS creator, count(*) AS held FROM v WHERE status = 'pending' AND NOT is_current GROUP BY 1), r AS (SELECT tenant_id AS creator, query_id, row_number() OVER (PARTITION BY tenant_id ORDER BY length(query), query_id) AS k FROM q WHERE query IS NOT NULL)
    SELECT query_id AS request_id, k <= 5 AND k + coalesce(held, 0) <= 5 AS admitted FROM r LEFT JOIN a USING (creator)""")
def _m20(spark, d):
    asked = requests(spark, d).where("query IS NOT NULL").select(F.col("tenant_id").alias("creator"), F.length("query").alias("asked_at"), F.col("query_id").alias("request_id"))
    active = versions(spark, d).where("status = 'pending' AND NOT is_current").select(F.col("tenant_id").alias("creator"))
    return metadata.within_limit(asked, active, 5).select("request_id", "admitted")


@query("t06_changes", f"""WITH {B}, a AS (SELECT id, kind, text FROM b WHERE kind <> 'code'), z AS (SELECT id, CASE WHEN kind = 'list' THEN 'text' ELSE kind END AS kind, text FROM b WHERE kind <> 'figure')
    SELECT id, CASE WHEN a.kind IS NULL THEN 'added' WHEN z.kind IS NULL THEN 'removed' ELSE 'changed' END AS event FROM a FULL JOIN z USING (id) WHERE a.kind IS NULL OR z.kind IS NULL OR a.kind <> z.kind""")
def _t06(spark, d):
    b = blocks(spark, d, "id", "kind", "text")
    after = b.where("kind <> 'figure'").withColumn("kind", F.when(F.col("kind") == "list", "text").otherwise(F.col("kind")))
    return metadata.changes(b.where("kind <> 'code'"), after, "id", ["kind", "text"])


@query("m26_frames", """SELECT event_id, 'id: ' || event_id || E'\\nevent: ' || event_type || E'\\ndata: {"user":' || user_id || E'}\\n\\n' AS frame FROM events""")
def _m26(spark, d):
    e = load(spark, d, "events", "event_id", "event_type", "user_id")
    data = F.to_json(F.struct(F.col("user_id").alias("user")))
    return e.select("event_id", metadata.event_frame(F.col("event_id"), F.col("event_type"), data).alias("frame"))


# --- reading and reports --------------------------------------------------------------------------

_ORD = "o AS (SELECT version_id, id AS chunk_id, char_start, char_end, coalesce(text, '') AS text, row_number() OVER (PARTITION BY version_id ORDER BY char_start, id) - 1 AS ordinal FROM b WHERE version_id IS NOT NULL)"


@query("c06_passage_window", f"""WITH {B}, {V}, {S}, {_ORD},
    a AS (SELECT s.id AS request_id, s.document_id, v.version_id, acl, s.char_start AS st, s.char_end AS en FROM s JOIN v ON v.document_id = s.document_id AND is_current),
    k AS (SELECT * FROM a WHERE st >= 0 AND en > st AND en - st <= 200000 AND {_VISIBLE}),
    h AS (SELECT request_id, k.version_id, st, en, ordinal, chunk_id, char_start, char_end FROM k JOIN o ON o.version_id = k.version_id AND char_end > st AND char_start < en AND char_start >= 0 AND char_end = char_start + length(text) AND char_end > char_start),
    f AS (SELECT *, count(*) OVER (PARTITION BY request_id) AS n, coalesce(max(least(char_end, en)) OVER (PARTITION BY request_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), st) AS reach, lag(ordinal) OVER (PARTITION BY request_id ORDER BY ordinal) AS bef FROM h),
    g AS (SELECT *, greatest(char_start, st, reach) AS fr, least(char_end, en) AS til, greatest(char_start, st, reach) > reach AND NOT coalesce(bef + 1 = ordinal, false) AS gap FROM f WHERE n <= 200),
    x AS (SELECT request_id, version_id, min(ordinal) FILTER (til > fr) AS focus, max(ordinal) FILTER (til > fr) AS until FROM g GROUP BY request_id, version_id, en HAVING NOT bool_or(gap) AND max(til) = en),
    m AS (SELECT version_id, max(ordinal) AS most FROM o GROUP BY 1),
    w AS (SELECT request_id, version_id, focus, least(until + 2, most) AS hi, most, unnest(range(greatest(focus - 2, 0), least(until + 2, most) + 1)) AS ordinal FROM x JOIN m USING (version_id))
    SELECT w.request_id, NULL::VARCHAR AS reason, w.focus::BIGINT AS focus, (hi + 1)::BIGINT AS next_from, hi < most AS has_more, w.ordinal::BIGINT AS ordinal, o.chunk_id, (fr - g.char_start)::BIGINT AS local_start, (til - g.char_start)::BIGINT AS local_end
    FROM w JOIN o ON o.version_id = w.version_id AND o.ordinal = w.ordinal LEFT JOIN g ON g.request_id = w.request_id AND g.ordinal = w.ordinal AND til > fr
    UNION ALL SELECT request_id, CASE WHEN st IS NULL OR en IS NULL OR st < 0 OR en <= st OR en - st > 200000 THEN 'invalid_range' WHEN NOT {_VISIBLE} THEN 'not_found' WHEN request_id IN (SELECT request_id FROM f WHERE n > 200) THEN 'too_many_chunks' ELSE 'unresolved' END, NULL, NULL, NULL, NULL, NULL, NULL, NULL
    FROM a WHERE request_id NOT IN (SELECT request_id FROM x)""")
def _c06(spark, d):
    """The window of chunks around every section of the current versions."""
    v = versions(spark, d)
    current = v.where("is_current").select("document_id", "tenant_id", "version_no")
    asked = sections(spark, d).join(current, "document_id").select(
        F.col("id").alias("request_id"), "tenant_id", "document_id", "version_no", F.col("char_start").alias("start"), F.col("char_end").alias("end"), F.array(F.lit("team-a")).alias("allowed")
    )
    found = reading.passage_windows(asked, v, reading.numbered_chunks(blocks(spark, d)))
    return found.select("request_id", "reason", "has_more", "chunk_id", *[F.col(c).cast("long").alias(c) for c in ("focus", "next_from", "ordinal", "local_start", "local_end")])


@query("f32_excerpts", f"""WITH {B}, {S}, p AS (SELECT id AS passage_id, document_id, char_start + 5 AS st, char_end - 3 AS en FROM s WHERE char_end - char_start > 8 AND char_end - char_start <= 200000)
    SELECT passage_id, md5(string_agg(substr(text, greatest(st - char_start, 0) + 1, least(en, char_start + length(text)) - char_start - greatest(st - char_start, 0)), '' ORDER BY char_start, id)) AS digest
    FROM p JOIN b ON b.document_id = p.document_id AND length(text) > 0 AND char_start + length(text) > st AND char_start < en GROUP BY 1""")
def _f32(spark, d):
    p = sections(spark, d).where("char_end - char_start > 8").select(F.col("id").alias("passage_id"), "document_id", (F.col("char_start") + 5).alias("start"), (F.col("char_end") - 3).alias("end"))
    c = blocks(spark, d, "id", "document_id", "char_start", "text").withColumnRenamed("id", "chunk_id")
    return reading.excerpts(p, c, ["document_id"]).select("passage_id", F.md5(F.encode("excerpt", "UTF-8")).alias("digest"))


def _covered(spark, d):
    """Documents as sources of what their blocks cover of them, in reports by the source they come from."""
    b = blocks(spark, d).where("kind <> 'table' AND char_end > char_start")
    spans = b.select("source_id", "document_id", F.col("char_start").cast("long").alias("start"), (F.col("char_end") + 1).cast("long").alias("end"))
    sizes = b.groupBy("document_id").agg((F.max("char_end") + 100).alias("n_chars"))
    return intervals.covered_length(spans, ["source_id", "document_id"], out="matched_chars").join(sizes, "document_id").withColumnRenamed("source_id", "query_id")


_MATCHED = f"""{_ISLANDS}, z AS (SELECT document_id, any_value(source_id) AS query_id, max(char_end) + 100 AS n FROM b WHERE kind <> 'table' AND char_end > char_start GROUP BY 1),
    c AS (SELECT query_id, document_id, sum("end" - "start")::BIGINT AS matched_chars, any_value(n) AS n FROM y JOIN z USING (document_id) GROUP BY 1, 2)"""


@query("a07_ratio", f"WITH {B}, {_MATCHED} SELECT document_id, round(matched_chars / n * 100, 1) AS ratio FROM c")
def _a07(spark, d):
    return _covered(spark, d).select("document_id", reports.duplication_ratio(F.col("matched_chars"), F.col("n_chars")).alias("ratio"))


@query("w09_numbering", f"WITH {B}, {_MATCHED} SELECT query_id, document_id, row_number() OVER (PARTITION BY query_id ORDER BY matched_chars DESC, document_id)::BIGINT AS ordinal FROM c")
def _w09(spark, d):
    return reports.numbered_sources(_covered(spark, d)).select("query_id", "document_id", F.col("ordinal").cast("long").alias("ordinal"))


@query("r15_rollup", f"""WITH {B}, p AS (SELECT document_id AS query_id, coalesce(nullif(section_id, ''), 'none') AS document_id, char_start AS s, char_end AS e, (length(text) % 100) / 100.0::DOUBLE AS score FROM b WHERE char_end > char_start),
    m1 AS (SELECT *, max(e) OVER (PARTITION BY query_id, document_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM p), i1 AS (SELECT *, sum(CASE WHEN s <= r THEN 0 ELSE 1 END) OVER (PARTITION BY query_id, document_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM m1),
    c1 AS (SELECT query_id, document_id, sum(l) AS matched FROM (SELECT query_id, document_id, max(e) - min(s) AS l FROM i1 GROUP BY query_id, document_id, g) GROUP BY 1, 2),
    m2 AS (SELECT *, max(e) OVER (PARTITION BY query_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM p), i2 AS (SELECT *, sum(CASE WHEN s <= r THEN 0 ELSE 1 END) OVER (PARTITION BY query_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM m2),
    c2 AS (SELECT query_id, sum(l) AS total FROM (SELECT query_id, max(e) - min(s) AS l FROM i2 GROUP BY query_id, g) GROUP BY 1), n AS (SELECT query_id, max(e) AS n FROM p GROUP BY 1),
    x AS (SELECT query_id, document_id, round(max(score), 6) AS score, count(*) AS passages FROM p GROUP BY 1, 2)
    SELECT query_id, document_id, score, passages, matched::BIGINT AS matched_chars, total::BIGINT AS total_matched, round(total / n * 100, 1) AS ratio FROM x JOIN c1 USING (query_id, document_id) JOIN c2 USING (query_id) JOIN n USING (query_id)""")
def _r15(spark, d):
    """Blocks as passages of their document that come from their section."""
    b = blocks(spark, d).where("char_end > char_start")
    section = F.when(F.coalesce("section_id", F.lit("")) == "", "none").otherwise(F.col("section_id"))
    p = b.select(F.col("document_id").alias("query_id"), section.alias("document_id"), F.col("char_start").alias("query_start"), F.col("char_end").alias("query_end"), F.round(F.length("text") % 100 / 100.0, 6).alias("score"))
    done = reports.rollup(p, p.groupBy("query_id").agg(F.max("query_end").alias("n_chars")))
    return done.withColumn("matched_chars", F.col("matched_chars").cast("long")).withColumn("total_matched", F.col("total_matched").cast("long"))


@query("r16_readable", f"""WITH {Q}, {V}, h AS (SELECT DISTINCT query_id, document_id FROM fused_hits), c AS (SELECT document_id, acl AS dacl FROM v WHERE is_current)
    SELECT query_id, bool_and(c.document_id IS NOT NULL AND (coalesce(len(q.acl), 0) = 0 OR coalesce(len(dacl), 0) = 0 OR list_contains(dacl, 'public') OR list_has_any(dacl, q.acl))) AS readable FROM h JOIN q USING (query_id) LEFT JOIN c USING (document_id) GROUP BY 1""")
def _r16(spark, d):
    hits = delivered_once(spark, d, "fused_hits", "query_id", "document_id")
    return reports.visible_reports(hits, versions(spark, d), requests(spark, d).select("query_id", F.col("acl").alias("allowed")))


@query("f36_formats", f"""WITH {B}, {S}, x AS (SELECT b.id, length(text)::BIGINT * 7919 AS n, heading_path FROM b JOIN s ON b.section_id = s.id WHERE text IS NOT NULL)
    SELECT id, CASE WHEN len(heading_path) > 0 THEN array_to_string(heading_path, ' › ') ELSE '—' END AS path, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576.0) ELSE printf('%.1f GB', n / 1073741824.0) END AS size FROM x""")
def _f36(spark, d):
    s = sections(spark, d).select(F.col("id").alias("section_id"), "heading_path")
    b = blocks(spark, d, "id", "text", "section_id").where("text IS NOT NULL").join(s, "section_id")
    return b.select("id", reports.breadcrumb(F.col("heading_path")).alias("path"), reports.file_size(F.length("text").cast("long") * 7919).alias("size"))


@query("f33_segments")
def _f33(spark, d):
    """Blocks in pieces, with spans at fixed shares of their length as hits; overlapping ones cut."""
    n = F.length("text")
    span = lambda a, z: F.struct(F.floor(n * a).cast("int").alias("start"), F.floor(n * z).cast("int").alias("end"))
    b = blocks(spark, d, "id", "text").where("text IS NOT NULL")
    pieces = reading.segments(F.col("text"), F.array(span(0.5, 0.9), span(0.1, 0.3), span(0.2, 0.4), span(0.7, 1.2)), clip=True)
    return b.select("id", F.to_json(F.transform(pieces, lambda p: F.struct(F.length(p["text"]).alias("n"), p["hit"], p["anchor"]))).alias("pieces"))


@query("f21_highlights")
def _f21(spark, d):
    """Where the terms of a request stand in the blocks of the documents it hit."""
    x = _asked_blocks(spark, d)
    terms = F.filter(F.array_distinct(T.tokens(F.col("query"))), lambda t: F.length(t) > 1)
    marked = highlights.with_spans(x.select("query_id", "chunk_id", F.lower("text").alias("text"), terms.alias("terms")), "text", "terms", "spans")
    return marked.select("query_id", "chunk_id", F.to_json("spans").alias("spans"))


@query("w06_line_offsets", r"""WITH x AS (SELECT doc_id, string_split(text, E'\n') AS l FROM documents WHERE length(text) > 0), y AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS k FROM x)
    SELECT doc_id, k::BIGINT AS line_no, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start, length(line)::BIGINT AS n FROM y""")
def _w06(spark, d):
    return parse.line_offsets(load(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


# --- projections for reuse ------------------------------------------------------------------------

_SENTENCES = projection.SENTENCE.replace(r"\Z", r"\z").replace("'", "''")
_WINDOWS = rf"""s AS (SELECT doc_id, regexp_extract_all(text, '{_SENTENCES}') AS s FROM documents WHERE length(text) > 0),
    w AS (SELECT doc_id, s, unnest(range(0, greatest(1, len(s) - 1), 3)) AS a FROM s),
    k AS (SELECT doc_id, (a / 3)::BIGINT AS chunk_index, length(array_to_string(list_slice(s, 1, a), ''))::BIGINT AS char_start, len(list_slice(s, a + 1, a + 4))::BIGINT AS sentence_count, array_to_string(list_slice(s, a + 1, a + 4), '') AS chunk FROM w)"""


def _chunks(spark, d):
    return projection.sentence_windows(spread(load(spark, d, "documents", "doc_id", "text")), "text")


@query("r02_windows", f"WITH {_WINDOWS} SELECT doc_id, chunk_index, char_start, char_start + length(chunk) AS char_end, sentence_count, md5(chunk) AS digest FROM k")
def _r02(spark, d):
    c = _chunks(spark, d)
    return c.select("doc_id", *[F.col(x).cast("long").alias(x) for x in ("chunk_index", "char_start", "char_end", "sentence_count")], F.md5(F.encode("chunk", "UTF-8")).alias("digest"))


def _prints_of(name: str, plain: str) -> str:
    return rf"""x{name} AS (SELECT doc_id, chunk_index, regexp_extract_all({plain}, '(?s).') AS p FROM k),
    c{name} AS (SELECT doc_id, chunk_index, unnest(p) AS c, unnest(range(1, len(p) + 1)) AS i FROM x{name}),
    g{name} AS (SELECT doc_id, chunk_index, i, c || lead(c, 1) OVER o || lead(c, 2) OVER o || lead(c, 3) OVER o || lead(c, 4) OVER o AS g FROM c{name} WINDOW o AS (PARTITION BY doc_id, chunk_index ORDER BY i)),
    h{name} AS (SELECT doc_id, chunk_index, i, ('0x' || substr(md5(g), 1, 15))::BIGINT AS h, count(*) OVER (PARTITION BY doc_id, chunk_index) AS n FROM g{name} WHERE g IS NOT NULL),
    m{name} AS (SELECT doc_id, chunk_index, i, n, min(h) OVER (PARTITION BY doc_id, chunk_index ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS m FROM h{name})"""


_CHUNK_PRINTS = rf"""{_WINDOWS}, {_prints_of("1", rf"trim(regexp_replace(lower(regexp_replace(chunk, '{T.CITATION_MARK}', '', 'g')), '\s+', ' ', 'g'))")},
    {_prints_of("2", rf"CASE WHEN regexp_matches(chunk, '{T.DOMINANT}') THEN trim(regexp_replace(regexp_replace(lower(chunk), '[\s\p{{P}}]', '', 'g'), '\s+', ' ', 'g')) ELSE '' END")},
    e AS (SELECT DISTINCT doc_id, chunk_index, m AS fp FROM (SELECT doc_id, chunk_index, m, i, n FROM m1 UNION ALL SELECT doc_id, chunk_index, m, i, n FROM m2) WHERE i <= greatest(n - 7, 1))"""


@query("u01_chunk_fingerprints", f"WITH {_CHUNK_PRINTS} SELECT doc_id, chunk_index, count(*) AS n, min(fp) AS low, max(fp) AS high FROM e GROUP BY 1, 2")
def _u01(spark, d):
    """Chunks with ideographs hold the fingerprints of both profiles."""
    f = projection.with_chunk_fingerprints(_chunks(spark, d), "md5", "f").where(F.size("f") > 0)
    return f.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.size("f").cast("long").alias("n"), F.array_min("f").alias("low"), F.array_max("f").alias("high"))


@query("l05_chunk_candidates", f"""WITH {_CHUNK_PRINTS}, n AS (SELECT count(DISTINCT doc_id) AS n FROM e),
    st AS (SELECT fp FROM e, n GROUP BY fp, n HAVING n >= 3 AND count(DISTINCT doc_id) > greatest(1, floor(n * 0.25))),
    p AS (SELECT doc_id, chunk_index, fp, fp IN (SELECT fp FROM st) AS stop FROM e WHERE doc_id % 100 = 0),
    u AS (SELECT doc_id, chunk_index, fp FROM (SELECT *, sum(CASE WHEN stop THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, chunk_index) AS free FROM p) WHERE NOT stop OR free = 0),
    sh AS (SELECT u.doc_id AS query_id, u.chunk_index AS probe_chunk, e.doc_id AS document_id, e.chunk_index, count(*) AS shared FROM u JOIN e USING (fp) WHERE u.doc_id <> e.doc_id GROUP BY 1, 2, 3, 4)
    SELECT query_id, probe_chunk, document_id, chunk_index, shared FROM (SELECT *, row_number() OVER (PARTITION BY query_id, probe_chunk ORDER BY shared DESC, document_id, chunk_index) AS r FROM sh) WHERE r <= 50""")
def _l05(spark, d):
    """Of each chunk of the checked documents the chunks of others that share most fingerprints with it, 50 at most."""
    texts = load(spark, d, "documents", "doc_id", "text").withColumnRenamed("doc_id", "document_id")

    def prints(x):
        c = projection.with_chunk_fingerprints(projection.sentence_windows(spread(x), "text"), "md5", "f")
        return c.select("document_id", F.col("chunk_index").cast("long").alias("chunk_index"), "f")

    return reuse.best_shared(prints(texts.where("document_id % 100 = 0")), prints(texts))


@query("f29_policy", rf"""WITH x AS (SELECT doc_id, text, lower(split_part(coalesce(lang, 'auto'), '-', 1)) AS base, regexp_replace(text, '\s', '', 'g') AS solid, length(regexp_replace(text, '[\s\p{{P}}\p{{Z}}]', '', 'g')) AS n FROM documents),
    y AS (SELECT doc_id, base = 'zh' OR base = 'auto' AND coalesce({_less("solid", T.DOMINANT)} / nullif(length(solid), 0)::DOUBLE >= 0.5, false) AS zh, coalesce(n, 0)::BIGINT AS effective FROM x)
    SELECT doc_id, CASE WHEN zh THEN 'zh' ELSE 'generic' END AS profile, effective, CASE WHEN zh THEN 12 ELSE 30 END::BIGINT AS seed, CASE WHEN zh THEN 20 ELSE 50 END::BIGINT AS passage, zh AND effective >= 12 AND effective < 20 AS short_exact FROM y""")
def _f29(spark, d):
    p = load(spark, d, "documents", "doc_id", "text", "lang").select("doc_id", projection.policy(F.col("text"), F.col("lang")).alias("p")).select("doc_id", "p.*")
    return p.select("doc_id", "profile", "short_exact", *[F.col(c).cast("long").alias(c) for c in ("effective", "seed", "passage")])


@query("f27_languages")
def _f27(spark, d):
    return load(spark, d, "documents", "doc_id", "text").select("doc_id", projection.detect_language(F.col("text")).alias("lang"))


@query("s24_dimension", "SELECT count(*) AS n FROM (SELECT DISTINCT chunk_id FROM vectors WHERE len(dense) = 64)")
def _s24(spark, d):
    """A collection takes only vectors of its dimension."""
    v = delivered_once(spark, d, "vectors", "chunk_id", "dense").where(F.size("dense") == 64)
    return store.check_dimension(v, 64).where(F.size("dense") == 64).select("chunk_id").distinct().agg(F.count("*").alias("n"))


@query("t14_sessions", """WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), y AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM x)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n FROM y GROUP BY user_id, g""")
def _t14(spark, d):
    from lectern.streaming import jobs

    events = load(spark, d, "events", "user_id", "ts").withColumn("ts", F.col("ts").cast("timestamp"))
    return jobs.sessions(events).select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n")
