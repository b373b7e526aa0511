"""Every query of the engine and the DuckDB SQL that checks it, by name.

Most queries are operators in SQL that both engines read alike; for them the check runs the operator's text over the twins of its tables. The others are built from columns and
have SQL of their own.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convolake.functions import markdown as MD
from convolake.functions import text as T
from convolake.operators import analytics, archive, calibration, lookup, media, normalize, pages, parsers, quality, reparse, reports, sanitize, search, shapes, wire
from convolake.scratch import scratch
from convolake.sources import archive as archives
from convolake.sources import bindings as B
from convolake.streaming import incremental, ingest

#: More tables of the fixtures: SQL that both engines read, over the bound ones.
DERIVED = {
    "old": ("messages", "SELECT platform, conversation_id, pos, role, CASE WHEN conv_id % 5 = 3 AND pos = 0 THEN 'x' || message_id ELSE message_id END AS message_id, CASE WHEN conv_id % 5 = 4 THEN texte || ' old' ELSE texte END AS texte FROM {messages} WHERE conv_id % 7 <> 0 AND NOT (conv_id % 5 = 1 AND pos > 2)"),
    "new": ("messages", "SELECT platform, conversation_id, pos, role, message_id, texte FROM {messages} WHERE conv_id % 6 <> 5 AND NOT (conv_id % 5 = 2 AND pos < 2)"),
    "daily": ("messages", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR(10)) AS day, count(*) AS n FROM {messages} GROUP BY CAST(ts AS DATE)"),
    "entries": ("conv", "SELECT conversation_id, title, message_count AS ord FROM {conv} UNION ALL SELECT conversation_id, 'b' || title, message_count + 1 FROM {conv} WHERE conv_id % 2 = 0"),
    "scores": ("events", "SELECT event_type AS service, value AS score FROM {events}"),
    "canaries": ("conv", "SELECT platform AS canary, conv_id % 3 <> 0 AS expected, conv_id % 4 <> 0 AS detected FROM {conv}"),
}
AXIS = "SELECT strftime(CAST(unnest(generate_series(TIMESTAMP '2023-02-01', TIMESTAMP '2025-01-01', INTERVAL 1 MONTH)) AS DATE), '%Y-%m') AS month"
DAYS = "SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-02', TIMESTAMP '2024-12-31', INTERVAL 1 DAY)) AS DATE) AS day"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "axis":
        return spark.range(24).select(F.date_format(F.add_months(F.lit("2023-02-01").cast("date"), F.col("id").cast("int")), "yyyy-MM").alias("month"))
    if name == "days":
        return spark.range(365).select(F.date_add(F.lit("2024-01-02").cast("date"), F.col("id").cast("int")).alias("day"))
    if name in DERIVED:
        base, sql = DERIVED[name]
        return spark.sql(sql, **{base: _table(spark, sf_dir, base)})
    return B.TABLES[name](spark, sf_dir) if name in B.TABLES else B.read(spark, sf_dir, name)


def _duck(names: tuple[str, ...], sql: str) -> str:
    """sql with the tables that it needs before it."""
    known, more = [], []
    for n in names:
        base = DERIVED[n][0] if n in DERIVED else n
        if base in B.SQL:
            known.append(base)
        if n in DERIVED:
            more.append(f"{n} AS ({DERIVED[n][1].replace('{' + base + '}', base)})")
        elif n in ("axis", "days"):
            more.append(f"{n} AS ({AXIS if n == 'axis' else DAYS})")
    body = B.cte(*known).removeprefix("WITH ").strip() if known else ""
    parts = ", ".join(x for x in (body, *more) if x)
    if not parts:
        return sql
    if sql.lstrip().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {parts}, {sql.lstrip().removeprefix('WITH RECURSIVE ')}"
    return f"WITH {parts}, {sql.lstrip().removeprefix('WITH ')}" if sql.lstrip().startswith("WITH ") else f"WITH {parts} {sql}"


Q: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def _sql(**operators) -> None:
    for name, op in operators.items():
        Q[name] = (lambda spark, sf_dir, op=op: op(*(_table(spark, sf_dir, t) for t in op.tables)), _duck(op.tables, op.sql))


def _query(name: str, tables: str, sql: str | None):
    """Registers a function of the named tables."""
    names = tuple(tables.split())

    def add(f):
        Q[name] = (lambda spark, sf_dir: f(*(_table(spark, sf_dir, t) for t in names)), sql and _duck(names, sql))
        return f

    return add


_sql(
    g1_stats=analytics.stats, g2_top_models=analytics.top_models, g3_activity_daily=analytics.daily, g4_timeline_platform=analytics.timeline_platform, g4_timeline_model=analytics.timeline_model, 
    g6_distinct_models=analytics.distinct_models, g7_date_bounds=analytics.date_bounds, g9_facets=analytics.facets, g11_tool_stats=analytics.tool_stats, g15_majority=analytics.majority,
    g18_media_stats=analytics.media_stats, g20_inventory_counters=analytics.inventory_counters, g21_heat_levels=analytics.heat_levels, g22_bars=analytics.bars,
    k6_event_days=analytics.event_days, 
    o1_merge_status=archive.merge_status, o1_merge_payload=archive.merge_payload, o2_content_equal=archive.content_equal, o4_inventory_upsert=archive.inventory_upsert, b3_inventory_order=archive.inventory_order, a6_inventory_load=archive.inventory_load,
    b5_replace=archive.replace_conversations, b16_media_prune=archive.media_prune, 
    j16_file_referenced=archive.file_referenced, 
    a15_platforms=archive.platforms,
    w1_consecutive_roles=normalize.consecutive_roles, w3_message_index=normalize.message_index, w5_first_message=normalize.first_message, w2_alternation_runs=normalize.role_runs,
    
    g16_shape_monitor=shapes.monitor, g23_canary_coverage=quality.canary_coverage,
)

#: A vector that the fixtures search by: that of vec_id 0.
_OWN = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"


def _vector(embeddings: DataFrame) -> list[float]:
    return list(embeddings.where("vec_id = 0").first()["embedding"])  # a query is one vector


_query("t1_knn_topk", "embeddings", f"SELECT vec_id, round(1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST({_OWN} AS DOUBLE[])), 4) AS distance FROM embeddings ORDER BY 1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST({_OWN} AS DOUBLE[])), vec_id LIMIT 10")(
    lambda e: search.nearest(e, _vector(e), 10, "vec_id").select("vec_id", F.round("distance", 4).alias("distance"))
)
_COS = f"list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST({_OWN} AS DOUBLE[]))"
_query("v5_knn_prefilter", "messages vectors embeddings", f"SELECT m.msg_seq, round(1 - {_COS}, 4) AS distance FROM vectors v JOIN messages m USING (msg_seq) WHERE m.platform = 'claude' AND m.role = 'user' ORDER BY 1 - {_COS}, m.msg_seq LIMIT 10")(
    lambda m, v, e: search.knn_prefiltered(m, v, _vector(e), 10, "claude", "user").select("msg_seq", F.round("distance", 4).alias("distance"))
)
_query("v4_knn_postfilter", "messages vectors embeddings", f"SELECT msg_seq FROM (SELECT v.msg_seq FROM vectors v ORDER BY 1 - {_COS}, v.msg_seq LIMIT 40) n JOIN messages m USING (msg_seq) WHERE m.platform IN ('claude', 'grok')")(
    lambda m, v, e: search.knn_postfiltered(m, v, _vector(e), 40, platforms=["claude", "grok"]).select("msg_seq")
)
_query("t7_similar", "messages vectors", "SELECT m.msg_seq, m.platform, m.conversation_id, round(s, 4) AS score FROM (SELECT v.msg_seq, list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(o.embedding AS DOUBLE[])) AS s FROM vectors v CROSS JOIN (SELECT embedding FROM vectors WHERE msg_seq = 1000) o WHERE v.msg_seq <> 1000 ORDER BY s DESC, v.msg_seq LIMIT 10) n JOIN messages m USING (msg_seq)")(
    lambda m, v: search.similar(m, v, 1000)
)
_query("v6_vector_fetch", "vectors", "SELECT msg_seq, round(CAST(embedding[1] AS DOUBLE), 4) AS first_value FROM vectors WHERE msg_seq IN (1, 1000, 2001, 3002)")(
    lambda v: v.where(F.col("msg_seq").isin(1, 1000, 2001, 3002)).select("msg_seq", F.round(F.get("embedding", 0).cast("double"), 4).alias("first_value"))
)
QUERY = "the and of that"
_TERMS = "'the', 'and', 'of', 'that'"
_FOLD = "strip_accents(lower({}))"
_TOKENS = r"list_distinct(regexp_extract_all({}, '[\p{{L}}\p{{N}}_\-]+'))"
_KW = f"CAST(len(list_intersect([{_TERMS}], {_TOKENS.format(_FOLD.format('texte'))})) AS DOUBLE) / 4"
_SCORED = f"least(1.0, {_KW} + CASE WHEN contains({_FOLD.format('texte')}, '{QUERY}') THEN 0.3 ELSE 0 END)"
_LOW = "translate(texte, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ANY = "(" + " OR ".join(f"contains({_LOW}, {t})" for t in _TERMS.split(", ")) + ")"
_query("p2_keyword_candidates", "messages", f"SELECT msg_seq FROM messages WHERE {_ANY} AND platform IN ('claude', 'gemini') ORDER BY msg_seq LIMIT 2000")(lambda m: search.keyword_candidates(m, QUERY, platforms=["claude", "gemini"]).select("msg_seq"))
_query("c23_keyword_score", "messages", f"SELECT msg_seq, round({_SCORED}, 4) AS score FROM messages")(lambda m: m.select("msg_seq", F.round(T.keyword_score(F.col("texte"), T.query_terms(QUERY), QUERY), 4).alias("score")))
_HYBRID = f"""near AS (SELECT v.msg_seq, {_COS} AS s FROM vectors v ORDER BY 1 - {_COS}, v.msg_seq LIMIT 200), word AS (SELECT msg_seq FROM messages WHERE {_ANY} ORDER BY msg_seq LIMIT 2000),
    both_ AS (SELECT msg_seq, s, 0 AS arm FROM near UNION ALL SELECT v.msg_seq, list_inner_product(CAST(v.embedding AS DOUBLE[]), CAST({_OWN} AS DOUBLE[])), 1 FROM word JOIN vectors v USING (msg_seq) WHERE v.msg_seq NOT IN (SELECT msg_seq FROM near)),
    scored AS (SELECT m.*, arm, s, greatest(0.0, least(1.0, s)) AS sem, {_SCORED} AS kw FROM both_ JOIN messages m USING (msg_seq)),
    best AS (SELECT *, round(0.6 * sem + 0.4 * kw, 4) AS score FROM scored WHERE 0.6 * sem + 0.4 * kw > 0 ORDER BY round(0.6 * sem + 0.4 * kw, 4) DESC, arm, CASE WHEN arm = 0 THEN -s ELSE 0 END, msg_seq LIMIT 20)"""
_query("v7_hybrid_messages", "messages vectors embeddings", f"WITH {_HYBRID} SELECT msg_seq, score, round(sem, 4) AS semantic_score, round(kw, 4) AS keyword_score FROM best")(
    lambda m, v, e: search.hybrid(m, v, _vector(e), QUERY).select("msg_seq", "score", "semantic_score", "keyword_score")
)
_GROUPED = "SELECT platform, conversation_id, count(*) AS hit_count, max(score) AS best_score, arg_max(msg_seq, (score, -msg_seq)) AS best_seq, row_number() OVER (ORDER BY CASE WHEN count(*) >= 2 THEN 0 ELSE 1 END, max(score) DESC, conversation_id) AS place FROM best GROUP BY platform, conversation_id"
_query("v7_hybrid_search", "messages vectors embeddings", f"WITH {_HYBRID} {_GROUPED}")(lambda m, v, e: search.group_results(search.hybrid(m, v, _vector(e), QUERY)))
_query("p4_filter_only", "messages", "SELECT msg_seq FROM messages WHERE platform IN ('claude', 'grok') AND ts >= TIMESTAMP '2024-08-01' AND ts <= TIMESTAMP '2024-11-30 23:59:59' ORDER BY ts DESC, msg_seq DESC LIMIT 200")(
    lambda m: search.criteria_only(m, platforms=["claude", "grok"], date_from="2024-08-01", date_to="2024-11-30 23:59:59").select("msg_seq")
)
_query("p7_grep_literal", "messages", "SELECT conversation_id, pos, 'texte' AS field, CAST((length(texte) - length(replace(lower(texte), 'the', ''))) / 3 AS BIGINT) AS n FROM messages WHERE contains(lower(texte), 'the') ORDER BY platform, conversation_id, pos LIMIT 100")(
    lambda m: search.grep(m, "the", limit=100).select("conversation_id", "pos", "field", "n")
)
_query("p6_grep_regex", "messages", r"SELECT msg_seq, CAST(len(regexp_extract_all(texte, '\b[A-Z][a-z]+ing\b')) AS BIGINT) AS n FROM messages WHERE regexp_matches(texte, '\b[A-Z][a-z]+ing\b')")(
    lambda m: m.where(F.col("texte").rlike(r"\b[A-Z][a-z]+ing\b")).select("msg_seq", F.regexp_count("texte", F.lit(r"\b[A-Z][a-z]+ing\b")).cast("long").alias("n"))
)
_query("g19_run_summary", "conv old new", f"""WITH told AS (SELECT platform, conversation_id, status FROM ({archive.merge_status.sql}) t WHERE status <> 'absent' AND NOT EXISTS (SELECT 1 FROM conv c WHERE c.conversation_id = t.conversation_id AND conv_id % 7 = 1)),
    o AS (SELECT * FROM told UNION ALL SELECT platform, conversation_id, 'failed' FROM conv WHERE conv_id % 7 = 1)
    SELECT c.platform, count(*) AS discovered, count(o.status) AS targets, count(CASE WHEN o.status IN ('written', 'patched', 'rewritten') THEN 1 END) AS exported, count(CASE WHEN o.status = 'patched' THEN 1 END) AS patched, count(CASE WHEN o.status IN ('unchanged', 'kept') THEN 1 END) AS unchanged,
           count(CASE WHEN o.status = 'failed' THEN 1 END) AS failed, count(CASE WHEN o.status IS NULL AND c.unavailable THEN 1 END) AS skipped FROM conv c LEFT JOIN o ON o.platform = c.platform AND o.conversation_id = c.conversation_id GROUP BY c.platform""")(
    lambda c, o, n: ingest.run_summary(c, archive.merge_status(o, n).where("status <> 'absent'").join(c.where("conv_id % 7 = 1"), ["platform", "conversation_id"], "left_anti").select("platform", "conversation_id", "status").unionByName(c.where("conv_id % 7 = 1").select("platform", "conversation_id", F.lit("failed").alias("status"))))
)
_query("p7_grep_archive", "messages conv", """WITH f AS (SELECT platform, conversation_id, 0 AS pos, 0 AS k, title AS value FROM conv UNION ALL SELECT platform, conversation_id, pos + 1, 0, texte FROM messages),
    n AS (SELECT *, CAST((length(value) - length(replace(lower(value), 'er', ''))) / 2 AS INTEGER) AS n FROM f), e AS (SELECT *, unnest(range(n)) AS i FROM n WHERE n > 0)
    SELECT platform, conversation_id, CASE pos WHEN 0 THEN 'title' ELSE 'texte' END AS field, CAST(count(*) AS BIGINT) AS n, TRUE AS truncated FROM (SELECT * FROM e ORDER BY platform, conversation_id, pos, k, i LIMIT 60) t GROUP BY ALL""")(
    lambda m, c: _grepped(c, m)
)


def _grepped(c: DataFrame, m: DataFrame) -> DataFrame:
    found, cut = search.grep_archive(c.select("platform", "conversation_id", "title", F.col("conversation_id").alias("file")), m.select("platform", "conversation_id", "pos", "texte"), "er", limit=60)
    return found.groupBy("platform", "conversation_id", "field").agg(F.count(F.lit(1)).alias("n")).withColumn("truncated", F.lit(cut))


_LOCAL = "images/' || substr(sha1('https://i.example/' || CAST(pos % 5 AS VARCHAR) || '.png'), 1, 20) || '.png"
_query("r19_media_cache", "messages", f"SELECT msg_seq, md5(texte || CASE WHEN pos % 5 < 3 THEN ' ![x]({_LOCAL})' ELSE ' ![x](https://i.example/' || CAST(pos % 5 AS VARCHAR) || '.png)' END) AS texte FROM messages")(lambda m: _localised(m).select("msg_seq", F.md5("texte").alias("texte")))


def _localised(m: DataFrame) -> DataFrame:
    linked = m.withColumn("texte", F.concat("texte", F.lit(" ![x](https://i.example/"), (F.col("pos") % 5).cast("string"), F.lit(".png)")))
    wanted = media.addresses(linked)
    got = wanted.select("url", F.lit("image/png").alias("content_type"), F.when(F.regexp_extract("url", r"(\d)\.png", 1).cast("int") < 3, F.unhex(F.lit("89504E470D0A1A0A00"))).alias("content"))
    empty = wanted.select("address_key", "url", "folder", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("kind")).limit(0)
    return media.localised(linked, media.refresh_cache(wanted, empty, got)[0])


_query("p8_grep_inventory", "conv", "SELECT conversation_id, title FROM conv WHERE NOT scraped AND (contains(lower(title), '3') OR contains(lower(conversation_id), '12'))")(
    lambda c: c.where(~F.col("scraped") & (F.contains(F.lower("title"), F.lit("3")) | F.contains(F.lower("conversation_id"), F.lit("12")))).select("conversation_id", "title")
)
_query("p20_message_lookup", "messages", "SELECT message_id, pos FROM messages WHERE conversation_id = 'c000003' AND pos = 1")(lambda m: search.lookup(m, "c000003", "2").select("message_id", "pos"))
_query("p15_all_terms", "messages", "SELECT msg_seq FROM messages WHERE contains(lower(texte), 'the') AND contains(lower(texte), 'and')")(lambda m: m.where(F.forall(F.array(F.lit("the"), F.lit("and")), lambda t: F.contains(F.lower("texte"), t))).select("msg_seq"))
_query("p16_anniversary", "messages", "SELECT msg_seq FROM messages WHERE strftime(ts, '%m-%d') = '08-15' AND year(ts) < 2025 ORDER BY msg_seq LIMIT 6")(lambda m: m.where((F.date_format("ts", "MM-dd") == "08-15") & (F.year("ts") < 2025)).orderBy("msg_seq").limit(6).select("msg_seq"))
_query("c58_field_stack", "messages", "SELECT conversation_id, pos, field, md5(value) AS value FROM (SELECT conversation_id, pos, 'texte' AS field, texte AS value FROM messages UNION ALL SELECT conversation_id, pos, 'message_id', message_id FROM messages UNION ALL SELECT conversation_id, pos, 'model', model FROM messages) t WHERE value <> ''")(
    lambda m: search.field_stack(m).select("conversation_id", "pos", "field", F.md5("value").alias("value"))
)
_query("j4_vector_cache", "messages vectors", "SELECT md5(texte) AS fingerprint, min(msg_seq) AS msg_seq FROM messages JOIN vectors USING (msg_seq) WHERE md5(texte) IN (SELECT md5(texte) FROM messages WHERE pos = 0) GROUP BY md5(texte)")(
    lambda m, v: search.cached_vectors(m.where("pos = 0").select(F.md5("texte").alias("fingerprint")), m.join(v, "msg_seq").select("msg_seq", "embedding", F.md5("texte").alias("fingerprint"))).select("fingerprint", "msg_seq")
)
_query("j5_meta_left", "messages conv", "SELECT m.msg_seq, c.title FROM messages m LEFT JOIN (SELECT * FROM conv WHERE conv_id % 2 = 0) c ON c.conversation_id = m.conversation_id WHERE m.pos = 0")(
    lambda m, c: m.where("pos = 0").join(c.where("conv_id % 2 = 0").select("conversation_id", "title"), "conversation_id", "left").select("msg_seq", "title")
)
_query("j8_media_full_outer", "messages media", "SELECT coalesce(t.conversation_id, h.conversation_id) AS conversation_id, coalesce(hit_count, 0) AS hit_count, coalesce(media_hits, 0) AS media_hits FROM (SELECT conversation_id, count(*) AS hit_count FROM messages GROUP BY 1) t FULL OUTER JOIN (SELECT conversation_id, count(*) AS media_hits FROM media GROUP BY 1) h ON h.conversation_id = t.conversation_id")(
    lambda m, d: search.media_groups(m.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("hit_count")), d)
)

# The archive, order within conversations and counts. The fixtures cut or change the bound tables; the SQL says the same by other means.
_KEY = ["platform", "conversation_id"]
_KNOWN = "k AS (SELECT * FROM conv WHERE conv_id % 5 <> 0), r AS (SELECT *, CASE WHEN conv_id % 9 = 0 THEN '' ELSE 'new ' || title END AS told FROM conv WHERE conv_id % 4 <> 0)"
_query("j20_inventory_refresh", "conv", f"""WITH {_KNOWN} SELECT platform, conversation_id, title, scraped, FALSE AS added FROM k WHERE scraped
    UNION ALL SELECT k.platform, k.conversation_id, CASE WHEN r.told <> '' THEN r.told ELSE k.title END, FALSE, FALSE FROM k LEFT JOIN r USING (platform, conversation_id) WHERE NOT k.scraped
    UNION ALL SELECT platform, conversation_id, nullif(told, ''), FALSE, TRUE FROM r WHERE (platform, conversation_id) NOT IN (SELECT platform, conversation_id FROM k)""")(
    lambda c: archive.inventory_refresh(c.where("conv_id % 5 <> 0"), c.where("conv_id % 4 <> 0").withColumn("title", F.when(F.col("conv_id") % 9 == 0, "").otherwise(F.concat(F.lit("new "), "title")))).drop("last_message_at")
)
_query("b6_delete", "messages conv", "SELECT m.message_id FROM messages m JOIN conv c USING (platform, conversation_id) WHERE NOT c.unavailable")(lambda m, c: archive.delete_conversations(m, c.where("unavailable")).select("message_id"))
_OWNED = "owned AS (SELECT media_id, content_key, c.platform, c.conversation_id, c.unavailable FROM media m JOIN conv c ON c.conv_id = m.media_id % 97)"
_query("b15_purge_cascade", "messages conv media", f"""WITH {_OWNED}, away AS (SELECT content_key, count(*) AS n FROM owned WHERE unavailable GROUP BY content_key), home AS (SELECT DISTINCT content_key FROM owned WHERE NOT unavailable),
    m AS (SELECT CASE WHEN content_key IN (SELECT content_key FROM home) THEN 'detach' ELSE 'delete' END AS action, CAST(sum(n) AS BIGINT) AS n FROM away GROUP BY 1)
    SELECT 'media' AS what, action, n FROM m UNION ALL SELECT 'messages', 'delete', count(*) FROM messages WHERE conv_id % 11 = 0 UNION ALL SELECT 'conversations', 'delete', count(*) FROM conv WHERE conv_id % 11 = 0""")(
    lambda m, c, d: archive.purge_cascade(m, d.drop("platform", "conversation_id").join(c.select(*_KEY, "conv_id"), F.col("media_id") % 97 == F.col("conv_id")), c.where("unavailable"))
)
_query("w17_content_dedupe", "media", "SELECT min(media_id) AS media_id FROM media WHERE media_id % 13 <> 0 GROUP BY content_key UNION ALL SELECT media_id FROM media WHERE media_id % 13 = 0")(
    lambda d: archive.media_dedupe(d.withColumn("content_key", F.when(F.col("media_id") % 13 != 0, F.col("content_key")))).select("media_id")
)
_query("b7_media_upsert", "media", "SELECT media_id, CASE WHEN media_id % 3 = 1 THEN 'new' ELSE kind END AS kind FROM media")(
    lambda d: archive.media_upsert(d.where("media_id % 5 <> 1 OR media_id % 3 <> 1"), d.where("media_id % 3 = 1").withColumn("kind", F.lit("new"))).select("media_id", "kind")
)
_query("t5_gallery_page", "media", "SELECT media_id, kind, (SELECT count(*) FROM media WHERE kind <> 'audio') AS total FROM media WHERE kind <> 'audio' ORDER BY media_id DESC LIMIT 20 OFFSET 20")(
    lambda d: archive.gallery_page(d, ["image", "video"], 20, 20).select("media_id", "kind", "total")
)
_query("b11_retention", "conv", "SELECT conversation_id AS name, platform AS stem FROM conv c WHERE (SELECT count(*) FROM conv n WHERE n.platform = c.platform AND n.conversation_id > c.conversation_id) >= 3")(
    lambda c: archive.retention(c.select(F.col("conversation_id").alias("name"), F.col("platform").alias("stem")), 3)
)
_query("p10_daily_targets", "conv", "SELECT platform, conversation_id FROM conv c WHERE NOT unavailable AND (NOT scraped OR (SELECT count(*) FROM conv n WHERE n.platform = c.platform AND (n.last_message_at > c.last_message_at OR n.last_message_at = c.last_message_at AND n.conversation_id < c.conversation_id)) < 20)")(
    lambda c: archive.daily_targets(c, 20).select(*_KEY)
)
_query("p9_incremental_skip", "conv", "SELECT platform, conversation_id FROM conv WHERE conv_id % 4 = 0 OR conv_id % 6 = 1")(
    lambda c: archive.incremental_skip(c.withColumn("exported_at", F.col("last_message_at").cast("string")), c.where("conv_id % 4 <> 0").withColumn("exported_at", F.when(F.col("conv_id") % 6 == 1, "older").otherwise(F.col("last_message_at").cast("string")))).select(*_KEY)
)
_query("p14_seeded_sample", "conv", "SELECT platform, unnest(list_transform(list_sort(list(md5(conversation_id || '-42') || ' ' || conversation_id))[1:3], lambda x: split_part(x, ' ', 2))) AS conversation_id FROM conv WHERE message_count >= 4 GROUP BY platform")(
    lambda c: archive.seeded_sample(c, 4, 3, 42).select(*_KEY)
)
_query("u1_union_first_wins", "conv", "SELECT conversation_id, 1 AS pass, title FROM conv WHERE conv_id % 2 = 0 UNION ALL SELECT conversation_id, 2, 'later ' || title FROM conv WHERE conv_id % 2 = 1 AND conv_id % 3 > 0")(
    lambda c: archive.union_first_wins(c.where("conv_id % 2 = 0"), *(c.where(x).withColumn("title", F.concat(F.lit("later "), "title")) for x in ("conv_id % 3 > 0", "conv_id % 6 = 2", "TRUE"))).select("conversation_id", "pass", "title")
)
_query("u2_unknown_or_recent", "conv", "SELECT conversation_id FROM conv WHERE conv_id % 3 = 0 UNION SELECT DISTINCT conversation_id FROM messages WHERE ts >= TIMESTAMP '2024-10-01 00:00:00'")(lambda c: archive.unknown_or_recent(c, "2024-10-01 00:00:00").select("conversation_id"))
_query("u4_set_difference", "conv", "SELECT conversation_id FROM conv WHERE conv_id % 3 = 0")(lambda c: archive.lost(c.select("conversation_id"), c.where("scraped").select("conversation_id")))
_query("u5_set_intersection", "conv", "SELECT conversation_id FROM conv WHERE conv_id % 3 <> 0 AND conv_id % 2 = 0")(lambda c: archive.common(c.where("scraped").select("conversation_id"), c.where("conv_id % 2 = 0").select("conversation_id")))
_query("b17_url_backfill", "conv", "SELECT conversation_id, CASE WHEN conv_id % 7 = 0 THEN 'https://known.example/' || conversation_id WHEN conv_id % 6 = 4 AND conv_id % 7 = 1 THEN 'https://chat.mistral.ai/work/x' ELSE ['https://chatgpt.com/c/', 'https://claude.ai/chat/', 'https://gemini.google.com/app/', 'https://grok.com/chat/', 'https://chat.mistral.ai/work/', 'https://www.perplexity.ai/search/'][conv_id % 6 + 1] || conversation_id END AS url FROM conv")(
    lambda c: archive.url_backfill(c.withColumn("url", F.when(F.col("conv_id") % 7 == 0, F.concat(F.lit("https://known.example/"), "conversation_id")).when((F.col("conv_id") % 6 == 4) & (F.col("conv_id") % 7 == 1), "https://chat.mistral.ai/chat/x").when(F.col("conv_id") % 2 == 0, ""))).select("conversation_id", "url")
)
_query("b19_legacy", "messages", "SELECT platform, conversation_id, texte, role, if(role = 'assistant', 'm-1', NULL) AS model FROM messages")(
    lambda m: archive.legacy(m.select(F.col("platform").alias("service"), F.col("conversation_id").alias("id"), F.col("texte").alias("content"), "role", F.lit("m-1").alias("model")))
)
_query("a14_legacy_union", "conv", "SELECT conversation_id, CASE WHEN conv_id % 3 <> 0 THEN 'disk' ELSE 'state' END AS origin FROM conv WHERE conv_id % 3 <> 0 OR conv_id % 2 = 0")(lambda c: archive.legacy_union(c.where("scraped"), c.where("conv_id % 2 = 0")).select("conversation_id", "origin"))
_query("j10_metadata_fallback", "messages", """SELECT conversation_id, pos, CASE WHEN pos = 0 AND conv_id % 2 = 0 THEN 'own' ELSE (SELECT o.model FROM messages o WHERE o.conversation_id = m.conversation_id AND o.pos = CASE WHEN m.pos % 2 = 0 THEN m.pos ELSE m.pos + 1 END) END AS model,
    CASE WHEN pos % 2 = 0 OR (SELECT max(pos) FROM messages o WHERE o.conversation_id = m.conversation_id) > pos THEN if(pos % 2 = 0, 'id', 'place') ELSE 'none' END AS matched FROM messages m""")(
    lambda m: archive.metadata_fallback(m.withColumns({"message_id": F.when(F.col("pos") % 2 == 0, F.col("message_id")).otherwise(""), "model": F.when((F.col("pos") == 0) & (F.col("conv_id") % 2 == 0), "own")}), m.withColumn("pos", F.when(F.col("pos") % 2 == 0, F.when(F.col("pos") > 0, F.col("pos") - 1).otherwise(0)).otherwise(F.col("pos") + 100_000))).select("conversation_id", "pos", "model", "matched")
)
_query("t4_list_conversations", "conv", "SELECT platform, conversation_id, message_count FROM conv ORDER BY last_message_at DESC, conversation_id LIMIT 50")(lambda c: archive.list_conversations(c, 50).select(*_KEY, "message_count"))
_query("t3_list_by_messages", "conv", "SELECT platform, conversation_id, message_count, (SELECT count(*) FROM conv) > 30 AS truncated FROM conv ORDER BY message_count DESC, conversation_id LIMIT 30")(lambda c: archive.list_by_messages(c, 30).select(*_KEY, "message_count", "truncated"))
_query("o6_retry_unavailable", "conv", "SELECT conversation_id, FALSE AS unavailable, conv_id % 11 = 0 AS reset FROM conv")(lambda c: archive.retry_unavailable(c).select("conversation_id", "unavailable", "reset"))
_query("c15_unique_filename", "conv", "SELECT conversation_id, 'title-' || CAST(conv_id % 7 AS VARCHAR) || CASE WHEN conversation_id = min(conversation_id) OVER (PARTITION BY platform, conv_id % 7) THEN '' ELSE '-' || conversation_id END AS name FROM conv")(lambda c: archive.unique_names(c).select("conversation_id", "name"))

_query("w4_nth_message", "messages", "SELECT conversation_id, list(message_id ORDER BY msg_seq)[3] AS message_id FROM messages GROUP BY conversation_id HAVING count(*) > 2")(lambda m: normalize.nth_message(m, 3).select("conversation_id", "message_id"))
_query("p21_first_n", "messages", "SELECT conversation_id, message_id, len(a) > 4 AS truncated FROM (SELECT conversation_id, list(message_id ORDER BY pos) AS a FROM messages GROUP BY conversation_id) t, unnest(a[:4]) u(message_id)")(lambda m: normalize.first_n(m, 4).select("conversation_id", "message_id", "truncated"))
_query("w7_attach_pending", "messages", "SELECT m.message_id, (SELECT o.message_id FROM messages o WHERE o.conversation_id = m.conversation_id AND o.pos >= m.pos AND o.role <> 'system' AND o.msg_seq % 5 <> 0 ORDER BY o.pos LIMIT 1) AS owner FROM messages m")(
    lambda m: normalize.attach_pending(m, (F.col("role") != "system") & (F.col("msg_seq") % 5 != 0)).select("message_id", "owner")
)
_NEAR = "(SELECT o.ts FROM messages o WHERE o.conversation_id = m.conversation_id AND o.msg_seq % 3 <> 0 AND o.pos {} m.pos ORDER BY o.pos {} LIMIT 1)"
_query("w8_fill_times", "messages", f"WITH x AS (SELECT *, CASE WHEN msg_seq % 3 <> 0 THEN ts END AS own, {_NEAR.format('<', 'DESC')} AS before, {_NEAR.format('>', '')} AS later FROM messages m) SELECT message_id, strftime(coalesce(own, before, later), '%Y-%m-%d %H:%M:%S') AS filled, if(own IS NOT NULL, 'own', if(before IS NOT NULL, 'before', if(later IS NOT NULL, 'after', 'none'))) AS origin, row_number() OVER (PARTITION BY conversation_id ORDER BY coalesce(own, before, later) NULLS LAST, pos) AS place FROM x")(
    lambda m: normalize.fill_times(m, F.when(F.col("msg_seq") % 3 != 0, F.col("ts"))).select("message_id", F.date_format("filled", "yyyy-MM-dd HH:mm:ss").alias("filled"), "origin", "place")
)
_query("w9_longest_row", "messages", "SELECT conversation_id, pos % 3 AS key, arg_max(message_id, (length(texte), -pos)) AS message_id FROM messages GROUP BY ALL")(lambda m: normalize.longest_row(m, F.col("pos") % 3).select("conversation_id", "key", "message_id"))
_query("w10_best_turn", "messages", "SELECT conversation_id, pos % 4 AS key, arg_max(message_id, (if(role = 'assistant', 1, 0), pos)) AS message_id, row_number() OVER (PARTITION BY conversation_id ORDER BY min(pos)) AS place FROM messages GROUP BY conversation_id, pos % 4")(
    lambda m: normalize.best_turn(m, F.col("pos") % 4, F.col("role") == "assistant").select("conversation_id", (F.col("pos") % 4).alias("key"), "message_id", "place")
)
_query("w11_last_per_key", "messages", "SELECT conversation_id, key, message_id, rank() OVER (PARTITION BY conversation_id ORDER BY p, key) AS place FROM (SELECT conversation_id, role AS key, arg_max(message_id, pos) AS message_id, max(pos) AS p FROM messages GROUP BY ALL) t")(lambda m: normalize.last_per_key(m, "role").select("conversation_id", "key", "message_id", "place"))
_query("w14_nearest_heading", "messages", "SELECT m.message_id, h.msg_seq AS heading FROM messages m ASOF LEFT JOIN (SELECT * FROM messages WHERE role = 'user') h ON h.conversation_id = m.conversation_id AND h.pos <= m.pos")(lambda m: normalize.nearest_heading(m, F.when(F.col("role") == "user", F.col("msg_seq"))).select("message_id", "heading"))
_query("w16_dedupe_keep_first", "messages", "WITH x AS (SELECT conversation_id, min(msg_seq) AS msg_seq FROM messages WHERE pos % 5 <> 4 GROUP BY conversation_id, lower(texte)[1] UNION ALL SELECT conversation_id, msg_seq FROM messages WHERE pos % 5 = 4) SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY msg_seq) AS place FROM x")(
    lambda m: normalize.dedupe_keep_first(m, F.when(F.col("pos") % 5 != 4, F.substring(F.lower("texte"), 1, 1))).select("conversation_id", "msg_seq", "place")
)
_query("j11_siblings", "messages", "SELECT message_id, len(a) AS n, CAST(list_position(a, msg_seq) - 1 AS INTEGER) AS version, msg_seq = list_max(a) AS active FROM messages JOIN (SELECT conversation_id, CAST(floor(pos / 2.0) AS INTEGER) AS parent, role, list_sort(list(msg_seq)) AS a FROM messages GROUP BY ALL) s USING (conversation_id, role) WHERE CAST(floor(pos / 2.0) AS INTEGER) = s.parent")(
    lambda m: normalize.siblings(m.withColumn("parent", F.floor(F.col("pos") / 2)), ["parent", "role"]).select("message_id", "n", "version", "active")
)
_query("j13_active_branch", "messages", """SELECT conversation_id, pos, CAST(row_number() OVER (PARTITION BY conversation_id ORDER BY pos DESC) - 1 AS INTEGER) AS depth FROM messages WHERE pos % 4 <> 2 OR pos = (SELECT max(o.pos) FROM messages o WHERE o.conversation_id = messages.conversation_id)""")(
    lambda m: normalize.active_branch(m.withColumns({"parent": F.when(F.col("pos") % 4 == 3, F.col("pos") - 2).otherwise(F.col("pos") - 1), "leaf": F.col("pos") == F.max("pos").over(Window.partitionBy("conversation_id"))}))
)
_query("w12_window_chain", "messages", "SELECT conversation_id, msg_seq AS key, CAST(row_number() OVER (PARTITION BY conversation_id ORDER BY pos) - 1 AS INTEGER) AS place FROM messages")(
    lambda m: normalize.window_chain(m.select("conversation_id", F.explode(F.sequence(F.greatest(F.lit(0), F.floor(F.col("pos") / 3) - 1), F.floor(F.col("pos") / 3))).alias("window"), "pos", F.col("msg_seq").alias("key")).withColumn("window", -F.col("window")))
)
_query("w13_edge_chain", "messages", "SELECT conversation_id, msg_seq AS key, CAST(row_number() OVER (PARTITION BY conversation_id ORDER BY CASE WHEN pos % 6 < 3 THEN 0 ELSE 1 END, pos) - 1 AS INTEGER) AS place FROM messages")(
    lambda m: normalize.chain(
        m.select("conversation_id", F.col("msg_seq").alias("key"), (F.col("pos") + F.when(F.col("pos") % 6 >= 3, 1000).otherwise(0)).alias("seen")),
        m.where("pos % 3 <> 2").select("conversation_id", F.col("msg_seq").alias("key"), (F.col("msg_seq") + 1).alias("next"), F.col("pos").alias("seen")),
    )
)
_query("q8_suite_answer", "messages", "SELECT a.conversation_id, min(b.msg_seq) AS answer_seq FROM messages a JOIN messages b ON b.conversation_id = a.conversation_id AND b.pos = a.pos + 1 WHERE a.role = 'user' AND b.role = 'assistant' AND contains(a.texte, 'the') GROUP BY 1")(
    lambda m: normalize.suite_answer(m, F.contains("texte", F.lit("the"))).select("conversation_id", "answer_seq")
)

_query("g5_day_view", "messages", "SELECT platform, conversation_id, n, first_seq, row_number() OVER (ORDER BY first_ts, first_seq) AS place, CAST(sum(n) OVER () AS BIGINT) AS message_count FROM (SELECT platform, conversation_id, count(*) AS n, min(msg_seq) AS first_seq, min(ts) AS first_ts FROM messages WHERE strftime(ts, '%Y%m%d') = '20240715' GROUP BY ALL) t")(lambda m: analytics.day_view(m, "2024-07-15"))
_query("g10_status", "conv events", "SELECT platform, count(*) AS listed, sum(if(conv_id % 3 <> 0, 1, 0))::BIGINT AS scraped, sum(if(conv_id % 11 = 0, 1, 0))::BIGINT AS unavailable, CASE platform WHEN 'claude' THEN 'attention' WHEN 'grok' THEN 'critique' WHEN 'gemini' THEN 'ok' ELSE 'inconnu' END AS verdict FROM conv GROUP BY platform")(
    lambda c, e: analytics.status(c, e.sparkSession.createDataFrame([("claude", "ok"), ("claude", "attention"), ("grok", "critique"), ("grok", "ok"), ("gemini", "ok"), ("mistral", "odd"), ("mistral", None)], "platform string, verdict string")).drop("last_message_at")
)
_query("g17_bench_summary", "events", "SELECT event_type AS service, count(*) AS n, count(*) FILTER (value > 10) AS fetched, count(*) FILTER (NOT coalesce(value > 10, FALSE)) AS failed, CAST(sum(user_id) AS BIGINT) AS bytes, round(avg(value) FILTER (value > 10), 3) AS mean_s, round(min(value) FILTER (value > 10), 3) AS min_s, round(max(value) FILTER (value > 10), 3) AS max_s FROM events GROUP BY event_type")(
    lambda e: analytics.bench_summary(e.select(F.col("event_type").alias("service"), F.when(F.col("value") > 10, F.col("value")).alias("seconds"), F.col("user_id").alias("bytes"), F.lit(1).alias("messages"), F.lit(1.0).alias("score"))).drop("messages", "mean_score")
)
_query("a18_api_health", "events", "SELECT event_type AS service, round(100.0 * sum(if(value >= 50, 1, 0)) / count(*), 1) AS rate FROM events GROUP BY 1 UNION ALL SELECT 'none', NULL")(
    lambda e: analytics.api_health(e.groupBy(F.col("event_type").alias("service")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") >= 50).alias("matches")).unionByName(e.sparkSession.createDataFrame([("none", 0, 0)], "service string, n long, matches long"))).select("service", "rate")
)
_query("w5_recent", "events", "SELECT user_id, strftime(min(ts), '%Y-%m') AS month, count(*) AS n FROM events GROUP BY user_id")(lambda e: analytics.first_months(e, "user_id").select("user_id", "month", "n"))

# Text operations, over messages, documents and pages.
_SAID = "'# Head\n\n' || texte || '\n```py\nprint(1)\n```\n\n- see https://a.example/x.png?q=1, ![i](https://b.example/i.jpg) and [f](https://c.example/f.pdf)\n\n\n'"
_made = lambda: F.concat(F.lit("# Head\n\n"), F.col("texte"), F.lit("\n```py\nprint(1)\n```\n\n- see https://a.example/x.png?q=1, ![i](https://b.example/i.jpg) and [f](https://c.example/f.pdf)\n\n\n"))


def _text(name: str, column, duck: str, key: str = "msg_seq", tables: str = "messages") -> None:
    _query(name, tables, f"SELECT {key}, {duck} AS value FROM {tables}")(lambda t: t.select(key, column().alias("value")))


_text("c1_timestamps", lambda: T.iso_z(T.parse_iso(F.concat(F.lit("2024-03-"), F.lpad((F.col("pos") + 25).cast("string"), 2, "0"), F.lit("T10:00:00+02:00")))), "CASE WHEN pos + 25 <= 31 THEN '2024-03-' || CAST(pos + 25 AS VARCHAR) || 'T08:00:00Z' END")
_text("c2_iso_z", lambda: T.iso_z(F.col("ts")), "strftime(ts, '%Y-%m-%dT%H:%M:%SZ')")
_text("c3_code_blocks", lambda: F.array_join(F.transform(T.code_blocks(_made()), lambda b: F.concat_ws("|", b["language"], b["code"])), ";"), "'py|print(1)'")
_text("c9_index_text", lambda: F.md5(T.index_text(F.col("texte"), F.lit("why"), F.array(F.lit("a"), F.lit("")), F.array().cast("array<string>"), F.array(F.lit("t1"), F.lit("t2")))), "md5(trim(texte, ' \n\t\r') || '\n\n[Raisonnement]\nwhy\n\n[Artefacts]\na\n\n[Outils]\nt1\nt2')")
_text("c10_fingerprint", lambda: T.fingerprint("model", F.col("texte")), "sha256('model' || chr(10) || texte)")
_text("c11_media_fingerprint", lambda: T.fingerprint("model", F.col("content_key"), F.col("media_id").cast("string")), "sha256('model' || chr(10) || content_key || chr(10) || CAST(media_id AS VARCHAR))", "media_id", "media")
_text("c13_slug", lambda: T.slug(F.col("text")), r"""coalesce(nullif(regexp_replace(substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace(strip_accents(lower(text)), '[^\x00-\x7F]', '', 'g'), '[^a-z0-9._-]+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g'), '-{2,}', '-', 'g'), 1, 80), '[-.]+$', ''), ''), 'untitled')""", "doc_id", "documents")
_text("c16_urls", lambda: T.conversation_url(F.col("platform"), F.col("conversation_id")), "CASE platform WHEN 'chatgpt' THEN 'https://chatgpt.com/c/' WHEN 'claude' THEN 'https://claude.ai/chat/' WHEN 'gemini' THEN 'https://gemini.google.com/app/' WHEN 'perplexity' THEN 'https://www.perplexity.ai/search/' WHEN 'grok' THEN 'https://grok.com/chat/' ELSE 'https://chat.mistral.ai/work/' END || conversation_id")
_text("c16_current_url", lambda: T.current_url(F.concat(F.lit("https://chat.mistral.ai/chat/"), F.col("message_id"))), "'https://chat.mistral.ai/work/' || message_id")
_text("c19_clean", lambda: F.md5(T.clean_vendor_text(F.concat(F.lit("<grok:render x>y\n</grok:render>a<br/>b  \n\n\n\n"), F.col("texte"), F.lit("<xaiArtifact id=1> ")))), r"md5('a' || chr(10) || 'b' || chr(10) || chr(10) || regexp_replace(regexp_replace(regexp_replace(texte, '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g'))")
_text("c20_fold", lambda: F.md5(T.fold(F.col("text"))), "md5(strip_accents(lower(text)))", "doc_id", "documents")
_text("c21_match_key", lambda: T.match_key(F.col("text"), 40), r"substr(regexp_replace(strip_accents(lower(text)), '[^\p{L}\p{N}]', '', 'g'), 1, 40)", "doc_id", "documents")
_text("c22_tokenize", lambda: F.md5(F.array_join(F.array_sort(T.tokens(F.col("text"))), " ")), r"md5(array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_\-]+'), lambda x: length(x) >= 2))), ' '))", "doc_id", "documents")
_text("c25_collapse", lambda: F.md5(T.collapse(F.col("text"))), r"md5(trim(regexp_replace(text, '\s+', ' ', 'g')))", "doc_id", "documents")
_FLAT = r"trim(regexp_replace(texte, '\s+', ' ', 'g'))"
_text("c26_snippet", lambda: T.snippet(F.col("texte"), ["the"], 60), f"CASE WHEN length({_FLAT}) <= 60 THEN {_FLAT} ELSE CASE WHEN greatest(instr(lower({_FLAT}), 'the') - 21, 0) > 0 THEN '…' ELSE '' END || substr({_FLAT}, greatest(instr(lower({_FLAT}), 'the') - 21, 0) + 1, 60) || CASE WHEN greatest(instr(lower({_FLAT}), 'the') - 21, 0) + 60 < length({_FLAT}) THEN '…' ELSE '' END END")
_text("c27_window", lambda: T.window(F.col("texte"), F.lit(20), F.lit(25), 10, 10), r"CASE WHEN 1 = 1 THEN '…' || trim(regexp_replace(substr(texte, 11, least(length(texte), 35) - 10), '\s+', ' ', 'g')) || CASE WHEN length(texte) > 35 THEN '…' ELSE '' END END")
_text("c28_extract", lambda: T.extract(F.col("texte"), 50), f"CASE WHEN length({_FLAT}) <= 50 THEN {_FLAT} ELSE regexp_replace(substr({_FLAT}, 1, 50), '(.) [^ ]*$', '\\1') || '…' END")
_text("c29_ui_title", lambda: T.ui_title(F.when(F.col("pos") % 3 == 0, F.lit("ChatGPT")).otherwise(F.concat(F.lit("  A "), F.col("message_id")))), "CASE WHEN pos % 3 <> 0 THEN 'A ' || message_id END")
_text("c31_math", lambda: T.math(F.concat(F.lit("\\( x \\) "), F.col("message_id"), F.lit(" \\[ y \\]"))), "'$ x $ ' || message_id || ' $$y$$'")
_text("c35_image_urls", lambda: F.array_join(T.image_urls(_made()), " "), "'https://b.example/i.jpg'")
_text("c36_media_urls", lambda: F.array_join(F.transform(T.media_urls(_made()), lambda x: F.concat_ws(" ", x["context"], x["url"])), ";"), "'bare https://a.example/x.png?q=1,;md-image https://b.example/i.jpg;md-link https://c.example/f.pdf'")
_text("c37_media_kind", lambda: T.media_kind(F.concat(F.lit("https://x/"), F.col("content_key"), F.get(F.array(F.lit(".PNG?a"), F.lit(".mp3"), F.lit(".mov#t"), F.lit(".txt")), (F.col("media_id") % 4).cast("int")))), "CASE media_id % 4 WHEN 0 THEN 'image' WHEN 1 THEN 'audio' WHEN 2 THEN 'video' END", "media_id", "media")
_text("c38_display_name", lambda: T.display_name(F.concat(F.lit("https://x/y/"), F.col("message_id"), F.lit("/?q=/z"))), "message_id")
_text("c39_rewrite_links", lambda: F.md5(T.rewrite_links(_made(), F.create_map(F.lit("https://b.example/i.jpg"), F.lit("images/i.jpg")))), f"md5(replace({_SAID}, 'https://b.example/i.jpg', 'images/i.jpg'))")
_text("c40_attachment", lambda: T.is_attachment(F.lit(""), F.concat(F.lit("https://x/a"), F.when(F.col("pos") % 2 == 0, F.lit(".pdf?x=1")).otherwise(F.lit(".exe")))), "pos % 2 = 0")
_text("c43_html_text", lambda: F.md5(T.collapse(T.html_text(F.lit("<p>a &amp; b</p><script>x</script><li>c<br>d</li>")))), "md5('a & b c d')", "page_id", "pages")
_text("c45_strip_fences", lambda: F.md5(T.strip_fences(_made())), f"md5(regexp_replace({_SAID}, '(?s)```.*?```', '', 'g'))")
_text("c46_format_tags", lambda: F.array_join(T.format_tags(F.get(F.array(F.lit("2024-01-02"), F.lit("a@b.co"), F.md5("texte"), F.lit("https://x.y"), F.lit("no tag")), F.col("pos") % 5)), "+"), "CASE pos % 5 WHEN 0 THEN 'iso-date' WHEN 1 THEN 'email' WHEN 2 THEN 'hash' WHEN 3 THEN 'url' ELSE '' END")
_text("c47_buckets", lambda: T.bucket(F.length("texte") % 150), "CASE WHEN length(texte) % 150 = 0 THEN '0' WHEN length(texte) % 150 = 1 THEN '1' WHEN length(texte) % 150 <= 5 THEN '2-5' WHEN length(texte) % 150 <= 20 THEN '6-20' WHEN length(texte) % 150 <= 100 THEN '21-100' ELSE '100+' END")
_text("c48_masked_key", lambda: T.masked_key(F.concat(F.lit("k:"), F.md5("texte"))), "'k:<hash>'")
_text("c51_relative_dates", lambda: T.iso_z(T.relative_date(F.get(F.array(F.lit("25 sept., 19:01"), F.lit("hier, 08:05"), F.lit("31 avr., 10:00"), F.lit("1 janv., 00:30"), F.lit("soon")), F.col("pos") % 5), F.lit("2024-07-10 12:00:00").cast("timestamp"))), "CASE pos % 5 WHEN 0 THEN '2023-09-25T19:01:00Z' WHEN 1 THEN '2024-07-09T08:05:00Z' WHEN 3 THEN '2024-01-01T00:30:00Z' END")
_text("c57_source_entry", lambda: T.source_entry(F.when(F.col("pos") % 2 == 0, F.lit(" T ")), F.concat(F.lit("u"), F.col("message_id"))), "CASE WHEN pos % 2 = 0 THEN 'T — u' || message_id ELSE 'u' || message_id END")
_text("c14_safe_id", lambda: F.md5(T.safe_id(F.col("text"))), r"md5(coalesce(nullif(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '[^A-Za-z0-9._-]', '_', 'g'), ''), 'unknown'))", "doc_id", "documents")
_query("c43_html_text_pages", "pages", None)(lambda p: p.select("page_id", T.html_text(F.col("html")).alias("value")))
_text("u6_ordered_distinct", lambda: F.md5(F.array_join(F.array_distinct(F.split(F.regexp_replace("texte", r"\s+", " "), " ")), " ")), r"md5(array_to_string(list_transform(list_filter(list_zip(string_split(regexp_replace(texte, '\s+', ' ', 'g'), ' '), range(len(string_split(regexp_replace(texte, '\s+', ' ', 'g'), ' ')))), lambda x: list_position(string_split(regexp_replace(texte, '\s+', ' ', 'g'), ' '), x[1]) = x[2] + 1), lambda x: x[1]), ' '))")

# Quality, sanitising, shapes.
_METRICS = r"SELECT platform, conversation_id, count(*) AS messages, CAST(0 AS BIGINT) AS consecutive_roles, count(*) AS images, CAST(0 AS BIGINT) AS tables, CAST(count(*) AS BIGINT) AS lists, CAST(0 AS BIGINT) AS code_langs, CAST(sum(length(texte) - length(replace(texte, '$', ''))) AS BIGINT) AS latex FROM messages GROUP BY platform, conversation_id"
_query("c1_times_of_numbers", "messages", "SELECT msg_seq, CASE pos % 4 WHEN 3 THEN NULL ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS value FROM messages")(
    lambda m: m.select("msg_seq", T.iso_z(T.any_time(F.parse_json(F.get(F.array(F.unix_timestamp("ts").cast("string"), F.concat(F.unix_timestamp("ts").cast("string"), F.lit(".75")), F.concat(F.lit('"'), T.iso_z(F.col("ts")), F.lit('"')), F.concat(F.lit('"'), F.unix_timestamp("ts").cast("string"), F.lit('"'))), (F.col("pos") % 4).cast("int"))))).alias("value"))
)
_query("g16_key_histogram", "events", """SELECT event_type, count(*) AS n, count(CASE WHEN event_id % 3 <> 2 THEN 1 END) AS matches, count(CASE WHEN event_id % 3 = 2 THEN 1 END) AS drifts, CASE WHEN count(CASE WHEN event_id % 3 = 2 THEN 1 END) > 0 THEN '$.a:' || count(CASE WHEN event_id % 3 = 2 THEN 1 END) ELSE '' END AS drift_keys,
    CASE WHEN count(CASE WHEN event_id % 3 = 1 THEN 1 END) > 0 THEN '$.more:' || count(CASE WHEN event_id % 3 = 1 THEN 1 END) ELSE '' END AS new_keys FROM events WHERE event_id < 300 GROUP BY event_type""".replace(" WHERE event_id < 300", ""))(lambda e: _histogram(e))


def _histogram(e: DataFrame) -> DataFrame:
    base = lambda more="": '{"a": 1, "b": "x", "c": 2.5' + more + "}"
    said = F.get(F.array(F.lit(base()), F.lit(base(', "more": 1')), F.lit(base().replace('"a": 1, ', ""))), (F.col("event_id") % 3).cast("int"))
    rows = shapes.shape_rows(e.select(F.col("event_id").alias("payload_id"), said.alias("payload")))
    ref = shapes.merge(shapes.shape_rows(e.sparkSession.createDataFrame([(0, base())], "payload_id long, payload string")))
    health = shapes.payload_health(ref, rows).join(e.select(F.col("event_id").alias("payload_id"), "event_type"), "payload_id")
    keys = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["key"], x["n"].cast("string"))), ",").alias(c)
    parts = [shapes.key_histogram(health.where(F.pmod(F.xxhash64("payload_id"), F.lit(2)) == k), "event_type") for k in (0, 1)]
    return shapes.merged_histograms(parts[0].unionByName(parts[1]), "event_type").select("event_type", "n", "matches", "drifts", keys("drift_keys"), keys("new_keys"))


_query("c41_metrics", "messages", _METRICS)(lambda m: quality.metrics(m.withColumn("texte", _made())))
#: For each capability a message that shows it, or what else of a message does; the place of a capability says which messages have it.
_SHOWS = {
    "headings": "# a", "emphasis": "**a**", "inline_code": "`a`", "link": "[a](https://a)", "blockquote": "> a", "hr": "---", "list_bullet": "- a", "list_numbered": "1. a", "checklist": "- [x] a", "list_nested": "  - a", "table": "| -- |", "latex_inline": "$a$", "latex_display": "$$a$$", "latex_matrix": "\\\\begin{cases}",
    "image_markdown": "![a](b)", "emoji_unicode": "漢", "refusal_error": "Désolé", "code_block": "```\na\n```", "code_languages": "```py\na\n```", "code_long": "```\n" + "a\n" * 9 + "```", "long_message": "a" * 1200, "upload_pdf": "Document1.pdf", "upload_csv": "](files/a.csv)", "upload_json": "donnees (1).json".replace(" ", ""), "upload_text": "notes.md", "audio": "audio.mp3",
    "video": "](files/b.webm)", "upload_image": "](images/a", "reasoning": "", "artifact_canvas": "", "web_search_citations": "", "code_execution": "", "connectors": "", "image_generation": "", "thread_memory": "",
}
#: What the messages of those also show. Fixed by the forms above.
_ALSO = {"checklist": ("list_bullet",), "list_nested": ("list_bullet",), "code_languages": ("code_block",), "code_long": ("code_block",)}
_BY_TOOL = {"code_execution": "Terminal", "connectors": "MCP x", "image_generation": "Génération d'image", "thread_memory": "Mémoire lue"}


def _capable(m: DataFrame) -> DataFrame:
    k = F.pmod(F.col("msg_seq"), F.lit(len(_SHOWS))).cast("int")
    name = F.get(F.array(*map(F.lit, _SHOWS)), k)
    filled = lambda n, c: F.when(name == n, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias(c)
    label = F.try_element_at(F.create_map(*(F.lit(x) for kv in _BY_TOOL.items() for x in kv)), name)
    tool = F.when(label.isNotNull(), F.array(label)).otherwise(F.array().cast("array<string>"))
    return m.select("platform", "conversation_id", "pos", F.get(F.array(*map(F.lit, _SHOWS.values())), k).alias("texte"), F.when(name == "reasoning", "why").otherwise("").alias("reasoning"), filled("artifact_canvas", "artifacts"), filled("web_search_citations", "sources"), tool.alias("tools"))


_ALL_SHOWN = "[" + ", ".join("[" + ", ".join(f"'{x}'" for x in (n, *_ALSO.get(n, ()))) + "]" for n in _SHOWS) + "]"
_query("c42_capabilities", "messages", f"SELECT platform, conversation_id, array_to_string(list_sort(list_distinct(flatten(list({_ALL_SHOWN}[1 + CAST(msg_seq % {len(_SHOWS)} AS INTEGER)])))), ',') AS capabilities FROM messages GROUP BY platform, conversation_id")(
    lambda m: quality.capabilities(_capable(m)).select("platform", "conversation_id", F.array_join("capabilities", ",").alias("capabilities"))
)
_CHECKED = "checked AS (SELECT platform, conversation_id, count(*) AS old_messages, count(CASE WHEN NOT (conv_id % 3 = 1 AND pos > 1) THEN 1 END) AS new_messages FROM messages GROUP BY ALL), told AS (SELECT *, round(CAST(new_messages AS DOUBLE) / old_messages, 3) AS retention, CASE WHEN new_messages < old_messages * 0.6 OR round(CAST(new_messages AS DOUBLE) / old_messages, 3) < 1.0 THEN 'degrade' ELSE 'ok' END AS status FROM checked)"


def _rechecked(m: DataFrame) -> DataFrame:
    told = m.withColumn("code_langs", F.size(F.filter(T.code_blocks(F.col("texte")), lambda b: b["language"] != "")))
    return quality.recheck(quality.metrics(told.where("NOT (conv_id % 3 = 1 AND pos > 1)")), quality.metrics(told))


_query("j15_recheck_compare", "messages", f"WITH {_CHECKED} SELECT platform, conversation_id, old_messages, new_messages, retention, status FROM told")(lambda m: _rechecked(m).drop("lost"))
_query("q1_regressions", "messages", f"WITH {_CHECKED} SELECT platform, conversation_id, CASE WHEN new_messages < old_messages * 0.6 THEN 'messages' ELSE '' END AS lost FROM told")(lambda m: _rechecked(m).select("platform", "conversation_id", F.array_join("lost", ",").alias("lost")))
_query("g12_recheck_summary", "messages", f"WITH {_CHECKED} SELECT platform, count(*) AS compared, count(CASE WHEN status = 'ok' THEN 1 END) AS ok, count(CASE WHEN status = 'degrade' THEN 1 END) AS degraded, CAST(0 AS BIGINT) AS failed, CAST(0 AS BIGINT) AS ignored, round(avg(retention), 3) AS retention, CASE WHEN min(retention) < 0.5 THEN 'critique' WHEN count(CASE WHEN status = 'degrade' THEN 1 END) > 0 THEN 'attention' ELSE 'ok' END AS verdict FROM told GROUP BY platform")(
    lambda m: quality.verdicts(_rechecked(m))
)
_query("g14_audit", "messages conv", f"""WITH a AS (SELECT platform, count(DISTINCT conversation_id) AS conv, count(*) AS msgs, CAST(sum(len(regexp_extract_all({_SAID}, '{quality.LINK}'))) AS BIGINT) AS links, CAST(sum(len(regexp_extract_all({_SAID}, '{quality.FENCE}'))) AS BIGINT) AS fences, CAST(sum(len(regexp_extract_all({_SAID}, '{quality.IMAGE}'))) AS BIGINT) AS images, CAST(count(*) AS BIGINT) AS code_blocks, count(CASE WHEN regexp_matches(regexp_replace({_SAID}, '(?s)```.*?```', '', 'g'), '{quality.HTML}') THEN 1 END) AS residual_html, CAST(0 AS BIGINT) AS near_empty FROM messages GROUP BY platform)
    SELECT c.platform, count(*) AS conv, coalesce(any_value(msgs), 0) AS msgs, coalesce(any_value(links), 0) AS links, coalesce(any_value(fences), 0) AS fences, coalesce(any_value(images), 0) AS images, coalesce(any_value(code_blocks), 0) AS code_blocks, coalesce(any_value(residual_html), 0) AS residual_html,
           coalesce(any_value(near_empty), 0) AS near_empty, count(CASE WHEN conv_id % 4 = 1 THEN 1 END) AS without_time, count(CASE WHEN conv_id % 3 = 2 THEN 1 END) AS without_model FROM conv c LEFT JOIN a USING (platform) GROUP BY c.platform""")(
    lambda m, c: quality.audit(m.withColumn("texte", _made()), c.select("platform", F.when(F.col("conv_id") % 4 != 1, F.col("started_at")).alias("started_at"), F.when(F.col("conv_id") % 3 != 2, "m").alias("model")))
)
_query("c18_pii_scan", "documents", rf"SELECT doc_id, line, 'email' AS kind, n FROM (SELECT doc_id, line, len(list_filter(regexp_extract_all(said, '{sanitize.EMAIL}'), lambda x: NOT regexp_matches(x, '{sanitize.SAFE_EMAIL}'))) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS said, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INTEGER) AS line FROM documents) l) t WHERE n > 0")(
    lambda d: sanitize.findings(d).where("kind = 'email'")
)
_query("c17_sanitize", "documents", r"SELECT doc_id, md5('calendar@example.com ' || text || ' ?sig=REDACTED') AS value FROM documents")(
    lambda d: d.select("doc_id", F.md5(sanitize.sanitize(F.concat(F.lit("a.b@group.calendar.google.com "), F.col("text"), F.lit(" ?sig=abc")))).alias("value"))
)
_query("n2_shape_union", "events", "SELECT '$.' || key AS path, string_agg(DISTINCT CASE json_type(value) WHEN 'VARCHAR' THEN 'str' WHEN 'UBIGINT' THEN 'int' WHEN 'BIGINT' THEN 'int' WHEN 'DOUBLE' THEN 'float' WHEN 'BOOLEAN' THEN 'bool' WHEN 'NULL' THEN 'null' WHEN 'ARRAY' THEN 'list' ELSE 'object' END, '+') AS kinds FROM (SELECT unnest(json_keys(props)) AS key, json_extract(props, '$.' || unnest(json_keys(props))) AS value FROM events) t GROUP BY key")(
    lambda e: shapes.merge(shapes.shape_rows(e, "event_id", "props")).where("path <> '$' AND path NOT LIKE '%[]%' AND path NOT LIKE '$.%.%'").select("path", F.array_join("kinds", "+").alias("kinds"))
)


def _two_shapes(m: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = m.groupBy("conversation_id").agg(F.max("conv_id").alias("k"), F.collect_list(F.struct("message_id", "role", "pos")).alias("messages"))
    said = F.to_json(F.struct("conversation_id", "messages"))
    less = F.when(F.col("k") % 2 == 0, F.to_json(F.struct("conversation_id", F.transform("messages", lambda x: F.struct(x["message_id"].alias("message_id"), x["pos"].cast("string").alias("pos"), F.lit(1).alias("extra"))).alias("messages")))).otherwise(said)
    return shapes.merge(shapes.shape_rows(rows.select("conversation_id", said.alias("payload")), "conversation_id")), shapes.merge(shapes.shape_rows(rows.where("k % 2 = 0").select("conversation_id", less.alias("payload")), "conversation_id"))


_query("j22_shape_compare", "messages", None)(lambda m: shapes.compare(*_two_shapes(m)).select("path", F.array_join("ref_kinds", "+").alias("ref_kinds"), F.array_join("kinds", "+").alias("kinds"), "change"))
_query("n4_shape_score", "messages", None)(lambda m: shapes.score(shapes.compare(*_two_shapes(m))))
_query("n9_signature", "messages", None)(lambda m: shapes.signature(_two_shapes(m)[0]))
_query("n1_shape_rows", "events", None)(lambda e: shapes.shape_rows(e, "event_id", "props"))
_query("w2_alternation_fold", "messages", None)(lambda m: normalize.fold_runs(m.withColumn("role", F.when(F.col("pos") % 3 == 2, F.lit("user")).otherwise(F.col("role")))).select("conversation_id", "run", "role", "message_id", F.md5("texte").alias("texte")))
_query("c34_autolink", "messages", f"SELECT msg_seq, md5(replace({_SAID}, 'see https://a.example/x.png?q=1', 'see <https://a.example/x.png?q=1>')) AS value FROM messages WHERE NOT contains(texte, 'http') UNION ALL SELECT msg_seq, 'http' FROM messages WHERE contains(texte, 'http')")(lambda m: m.select("msg_seq", F.when(F.contains("texte", F.lit("http")), "http").otherwise(F.md5(T.autolink(_made()))).alias("value")))
_query("c44_markdown_text", "messages", None)(lambda m: m.select("msg_seq", F.md5(T.markdown_text(_made())).alias("value")))
_query("t6_random", "conv", None)(lambda c: search.random_conversations(c, 8, 42).select("conversation_id"))


# Payloads, pages, calibration and indexing; their inputs are made from the bound tables.
def _flat(x, kind: str):
    """A message of a flat list: a thought, a tool's image, an answer with a mark that a reference fills, or a question with an image and a transcript."""
    part = lambda kind, **more: F.parse_json(F.to_json(F.struct(F.lit(kind).alias("content_type"), *(v.alias(k) for k, v in more.items()))))
    image = lambda sign: part(parsers.CHATGPT_IMAGE, asset_pointer=F.concat(F.lit(f"sediment://{sign}-"), x["message_id"]))
    parts = {
        "thoughts": F.array().cast("array<variant>"), "tool": F.array(image("g")), "text": F.array(F.concat(x["texte"], F.lit(" <MARK>")).cast("variant")),
        "multimodal_text": F.array(x["texte"].cast("variant"), image("f"), part("audio_transcription", text=F.lit(" heard "))),
    }[kind]
    references = F.array(*(F.struct(F.lit(t).alias("type"), F.lit("T").alias("title"), F.concat(F.lit("https://s/"), x["message_id"]).alias("url"), F.lit("<MARK>").alias("matched_text"), F.concat(F.lit("![a](https://i/"), x["message_id"], F.lit(")")).alias("alt")) for t in ("image_group", "url")))
    return F.struct(
        x["message_id"].alias("id"), F.struct((F.lit("tool") if kind == "tool" else x["role"]).alias("role")).alias("author"), F.unix_timestamp(x["ts"]).cast("double").alias("create_time"),
        F.struct(F.lit("multimodal_text" if kind == "tool" else kind).alias("content_type"), parts.alias("parts"), F.array(F.struct(F.lit("Look").alias("summary"), F.lit(" why ").alias("content"))).alias("thoughts")).alias("content"),
        F.struct(x["model"].alias("model_slug"), F.lit("G").alias("image_gen_title"), F.array(F.struct(F.concat(F.lit("f-"), x["message_id"]).alias("id"), F.lit("p.png").alias("name"))).alias("attachments"), references.alias("content_references")).alias("metadata"),
    )


#: Blocks of an entry besides its text: results with an attached file, a step, an asset and a picture.
_BLOCKS = """[{"web_result_block": {"web_results": [{"name": "A", "url": "https://a/ID"}, {"name": "n.txt", "url": "https://n/ID?x", "is_attachment": true}]}},
 {"sources_mode_block": {"web_results": [{"name": "again", "url": "https://a/ID"}]}}, {"workflow_block": {"steps": [{"title": "Step", "items": [{"type": "WORKFLOW_ITEM_SOURCES", "payload": {"sources_payload": {"sources": [{"url": "https://b/ID"}]}}}]}]}},
 {"unified_assets_block": {"assets": [{"asset_type": "CODE_ASSET", "code_file": {"filename": "ID.py"}}]}}, {"media_block": {"media_items": [{"medium": "image", "image": "https://p/ID", "name": "P"}, {"medium": "video", "url": "https://v/ID"}]}}]"""


def _segments(x):
    """The answer of an entry: a whole block after a stale segment at even places, else segments out of order, one of them in chunks."""
    block = lambda usage, answer, chunks, offset: F.parse_json(F.to_json(F.struct(F.lit(usage).alias("intended_usage"), F.struct(answer.alias("answer"), chunks.alias("chunks"), F.lit(offset).alias("chunk_starting_offset")).alias("markdown_block"))))
    none, said = F.array().cast("array<string>"), F.concat(F.lit("re "), x["texte"])
    whole = F.array(block("ask_text_0_markdown", F.lit("stale"), none, 0), block("ask_text", said, none, 0))
    return F.when(x["pos"] % 2 == 0, whole).otherwise(F.array(block("ask_text_10_markdown", said, none, 5), block("ask_text_2_markdown", F.lit(""), F.array(F.lit("one "), F.lit("two")), 5), block("ask_text", F.lit(" "), none, 0)))


def _payloads(m: DataFrame, platform: str) -> DataFrame:
    own = m.where(F.col("platform") == platform).groupBy("conversation_id").agg(F.sort_array(F.collect_list(F.struct("pos", "message_id", "role", "texte", "model", "ts"))).alias("a"))
    iso = lambda x: T.iso_z(x["ts"])
    each = lambda f: F.transform("a", f)
    made = {
        "claude": lambda: F.struct(
            F.get(F.col("a"), F.size("a") - 1)["message_id"].alias("current_leaf_message_uuid"),
            F.transform("a", lambda x, i: F.struct(x["message_id"].alias("uuid"), F.when(i > 0, F.get(F.col("a"), i - 1)["message_id"]).alias("parent_message_uuid"), F.when(x["role"] == "assistant", "assistant").otherwise("human").alias("sender"), i.alias("index"), iso(x).alias("created_at"), F.array(F.struct(F.lit("text").alias("type"), x["texte"].alias("text"))).alias("content"))).alias("chat_messages"),
        ),
        "chatgpt": lambda: F.struct(F.flatten(F.transform("a", lambda x: F.when(x["role"] == "assistant", F.array(_flat(x, "thoughts"), _flat(x, "tool"), _flat(x, "text"))).otherwise(F.array(_flat(x, "multimodal_text"))))).alias("messages")),
        "grok": lambda: F.struct(each(lambda x: F.struct(x["message_id"].alias("responseId"), F.when(x["role"] == "user", "human").otherwise("assistant").alias("sender"), x["texte"].alias("message"), iso(x).alias("createTime"), x["model"].alias("model"))).alias("responses")),
        "perplexity": lambda: F.struct(each(lambda x: F.struct(x["message_id"].alias("uuid"), x["texte"].alias("query_str"), F.lit("turbo").alias("display_model"), iso(x).alias("entry_created_datetime"), F.concat(_segments(x), F.from_json(F.replace(F.lit(_BLOCKS), F.lit("ID"), x["message_id"]), "array<variant>")).alias("blocks"))).alias("entries")),
        "mistral": lambda: F.struct(F.struct(F.transform("a", lambda x, i: F.struct(x["message_id"].alias("id"), F.lit(0).alias("version"), F.when(i > 0, F.get(F.col("a"), i - 1)["message_id"]).alias("parentId"), x["role"].alias("role"), iso(x).alias("createdAt"), F.array(F.struct(F.lit("text").alias("type"), x["texte"].alias("text"))).alias("contentChunks"))).alias("items")).alias("messages")),
    }
    return own.select("conversation_id", (_positional(F.col("a")) if platform == "gemini" else F.to_json(made[platform]())).alias("payload"))


#: A turn of lists: the question has an image, or a video at odd places; the answer cites a file, holds a file's tag and a made image's address, and has two steps.
_TURN = """[["c", "r_%(id)s"], ["c", "r_2", "rc_%(id)s"], [%(text)s, null, null, null, [[null, null, null, [%(file)s], [[null, 1, "other.png", null]]]]],
 [[["rc_%(id)s", [%(answer)s], null, [2], "fr", [{"9": 1, "44": [[["[cite: 5]", 0], [[null, [[null, 0, "donnees.json", null, "application/json"]]]]]]}, {"44": [], "59": [[["[file-tag: f1]"], [[null, 2, "out[1].csv", null, null, "text/csv", null, ["https://contribution.usercontent.google.com/download?c=%(id)s"]]]]]}],
   [7, [["http://googleusercontent.com/image_generation_content/1"], [[null, 1, "made.png", "https://lh3.googleusercontent.com/gg/a-long-name-that-no-kind-of-file-has-%(id)s", "image/png"]]]]]], null, null, "x", [[1, ["google", ["Search"]]], [2, ["data_analysis_tool", ["%(label)s"]]]], null, "gemini-test"], [%(epoch)s, 500000000]]"""
_IMAGE = '[null, 1, "image.png", "https://lh3.googleusercontent.com/gg/a-long-name-that-no-kind-of-file-has-in", null, null, null, null, null, null, null, "image/png"]'
_VIDEO = '[null, 3, "video.mp4", null, null, "video/mp4", null, ["https://lh3.googleusercontent.com/gg/v", "https://contribution.usercontent.google.com/download?v"]]'
_MARKS = "* un[cite: 5]\n[file-tag: f1]\nhttp://googleusercontent.com/image_generation_content/1\n\n```python?code_reference\nx\n\n```\nre "


def _positional(messages):
    """Payload of nested lists, as text, since no column type has them."""
    said = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)
    odd = lambda x: x["pos"] % 2 == 1
    by = {"id": lambda x: x["message_id"], "text": lambda x: said(x["texte"]), "answer": lambda x: said(F.concat(F.lit(_MARKS), x["texte"])), "file": lambda x: F.when(odd(x), _VIDEO).otherwise(_IMAGE), "label": lambda x: F.when(odd(x), "Imagen").otherwise("Code"), "epoch": lambda x: F.unix_timestamp(x["ts"]).cast("string")}
    parts = re.split(r"%\((\w+)\)s", _TURN)
    turn = lambda x: F.concat(*(by[p](x) if k % 2 else F.lit(p) for k, p in enumerate(parts)))
    return F.concat(F.lit('{"turns": [null, 3, '), F.array_join(F.transform(messages, turn), ", "), F.lit("]}"))


_LINE = r"regexp_replace(texte, '^\s+|\s+$', '', 'g')"
_ALL = "SELECT conversation_id, CAST(row_number() OVER (PARTITION BY conversation_id ORDER BY pos) - 1 AS INTEGER) AS pos, message_id, {role} AS role, md5({text}) AS texte FROM messages WHERE platform = '{p}'"
for _name, _platform, _role in (("m2", "claude", "CASE WHEN role = 'assistant' THEN 'assistant' ELSE 'user' END"), ("m4", "grok", "CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END"), ("m5", "mistral", "role")):
    _query(f"{_name}_{_platform}", "messages", _ALL.format(role=_role or "role", text=_LINE, p=_platform) )(
        lambda m, p=_platform: parsers.MAPPERS[p](_payloads(m, p)).select("conversation_id", "pos", "message_id", "role", F.md5("texte").alias("texte"))
    )
_NL = "chr(10)"
_query("m3_gemini", "messages", f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY pos) - 1 AS k, {_LINE} AS said FROM messages WHERE platform = 'gemini')
    SELECT conversation_id, CAST(2 * k AS INTEGER) + h AS pos, CASE h WHEN 0 THEN 'user' ELSE 'assistant' END AS role, CASE h WHEN 0 THEN 'r_' ELSE 'rc_' END || message_id AS message_id, CASE h WHEN 1 THEN 'gemini-test' END AS model, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts,
           md5(CASE h WHEN 0 THEN said || {_NL} || {_NL} || CASE WHEN pos % 2 = 0 THEN '![image.png](https://lh3.googleusercontent.com/gg/a-long-name-that-no-kind-of-file-has-in)' ELSE '![video.mp4](https://lh3.googleusercontent.com/gg/v)' || {_NL} || {_NL} || '[video.mp4](https://contribution.usercontent.google.com/download?v)' END
               ELSE '- un' || {_NL} || '[out\\[1\\].csv](https://contribution.usercontent.google.com/download?c=' || message_id || ')' || {_NL} || '![made.png](https://lh3.googleusercontent.com/gg/a-long-name-that-no-kind-of-file-has-' || message_id || ')' || {_NL} || {_NL} || '```python' || {_NL} || 'x' || {_NL} || '```' || {_NL} || 're ' || regexp_replace(texte, '\\s+$', '') END) AS texte,
           CASE h WHEN 0 THEN '' ELSE 'Recherche web|' || CASE WHEN pos % 2 = 0 THEN 'Exécution de code' ELSE 'Génération d''images|Analyse vidéo' END END AS tools, CASE h WHEN 0 THEN '' ELSE 'JSON: donnees.json' END AS sources
    FROM t CROSS JOIN (SELECT 0 AS h UNION ALL SELECT 1) x""")(
    lambda m: parsers.gemini(_payloads(m, "gemini")).select("conversation_id", "pos", "role", "message_id", "model", T.iso_z(F.col("ts")).alias("ts"), F.md5("texte").alias("texte"), *(F.array_join(c, "|").alias(c) for c in ("tools", "sources")))
)
_got = lambda: (F.md5("texte").alias("texte"), "reasoning", *(F.array_join(c, "|").alias(c) for c in ("tools", "sources", "artifacts")))
_HEAD = r"regexp_replace(texte, '^\s+', '')"
_query("m1_chatgpt", "messages", f"""SELECT conversation_id, CAST(row_number() OVER (PARTITION BY conversation_id ORDER BY pos) - 1 AS INTEGER) AS pos, message_id, role, CASE role WHEN 'assistant' THEN 'why' ELSE '' END AS reasoning, CASE role WHEN 'assistant' THEN 'Look' ELSE '' END AS tools, CASE role WHEN 'assistant' THEN 'T — https://s/' || message_id ELSE '' END AS sources, '' AS artifacts,
    md5(CASE role WHEN 'assistant' THEN {_HEAD} || ' ![a](https://i/' || message_id || ')' || {_NL} || {_NL} || '![Generated image: G](https://chatgpt.com/backend-api/files/g-' || message_id || '/download)'
        ELSE {_HEAD} || {_NL} || 'heard' || {_NL} || {_NL} || '![p.png](https://chatgpt.com/backend-api/files/f-' || message_id || '/download)' || {_NL} || {_NL} || '![a](https://i/' || message_id || ')' END) AS texte FROM messages WHERE platform = 'chatgpt' AND role <> 'system'""")(
    lambda m: parsers.chatgpt(_payloads(m, "chatgpt")).select("conversation_id", "pos", "message_id", "role", *_got())
)
_query("m6_perplexity", "messages", f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY pos) - 1 AS k FROM messages WHERE platform = 'perplexity')
    SELECT conversation_id, CAST(2 * k AS INTEGER) + h AS pos, CASE h WHEN 0 THEN 'user' ELSE 'assistant' END AS role, CASE h WHEN 0 THEN '' ELSE 'Step' END AS reasoning, CASE h WHEN 0 THEN '' ELSE 'Recherche|Code' END AS tools, CASE h WHEN 0 THEN '' ELSE 'A — https://a/' || message_id || '|https://b/' || message_id END AS sources, CASE h WHEN 0 THEN '' ELSE message_id || '.py' END AS artifacts,
           md5(CASE h WHEN 0 THEN {_LINE} || {_NL} || {_NL} || '[n.txt](https://n/' || message_id || '?x)' ELSE CASE WHEN pos % 2 = 1 THEN 'one two' || {_NL} ELSE '' END || 're ' || texte || {_NL} || {_NL} || '![P](https://p/' || message_id || ')' || {_NL} || {_NL} || '[https://v/' || message_id || '](https://v/' || message_id || ')' END) AS texte
    FROM t CROSS JOIN (SELECT 0 AS h UNION ALL SELECT 1) x""")(
    lambda m: parsers.perplexity(_payloads(m, "perplexity")).select("conversation_id", "pos", "role", *_got())
)
_query("html_to_markdown", "pages", None)(lambda p: parsers.html_to_markdown(p))
_query("a22_page_links", "pages", None)(lambda p: parsers.page_links(p, "^https?://|^/"))
_query("a16_canonical_url", "pages", "SELECT page_id, url AS canonical FROM pages")(lambda p: p.select("page_id", T.canonical_url(F.concat(F.lit("<LINK href='"), F.col("url"), F.lit("' rel=\"canonical\">"), F.col("html"))).alias("canonical")))
_NL = "chr(10)"
_query("b13_markdown", "messages", f"SELECT platform, conversation_id, md5('# ' || conversation_id || {_NL} || {_NL} || '- Messages : ' || count(*) || {_NL} || {_NL} || string_agg('## ' || role || coalesce(' (' || model || ')', '') || ' — ' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || {_NL} || {_NL} || texte || {_NL}, {_NL} ORDER BY pos)) AS markdown FROM messages GROUP BY platform, conversation_id")(lambda m: archives.render_markdown(m).withColumn("markdown", F.md5("markdown")))
_ESCAPED = "replace(replace(replace(replace(replace(texte, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#x27;')"
_query("b12_html", "messages", f"SELECT platform, conversation_id, md5('<!DOCTYPE html>' || {_NL} || '<html><head><meta charset=\"utf-8\"><title>' || conversation_id || '</title></head><body>' || {_NL} || string_agg('<div class=\"msg ' || role || '\"><pre class=\"texte\">' || {_ESCAPED} || '</pre></div>', {_NL} ORDER BY pos) || {_NL} || '</body></html>' || {_NL}) AS html FROM messages GROUP BY platform, conversation_id")(lambda m: archives.render_html(m).withColumn("html", F.md5("html")))
_query("a10_media_references", "messages", "SELECT platform, 'images' AS folder, 'i' || CAST(pos % 3 AS VARCHAR) || '.png' AS name, arg_min(message_id, (conversation_id, pos)) AS message_id FROM messages GROUP BY ALL")(
    lambda m: archives.media_references(m.withColumn("texte", F.concat(F.lit("![x](images/i"), (F.col("pos") % 3).cast("string"), F.lit(".png)")))).select("platform", "folder", "name", "message_id")
)
_query("j19_queue_coverage", "messages", None)(lambda m: calibration.queue_coverage(m.where("role = 'user'").withColumn("place", F.col("msg_seq")), m.where("role = 'user' AND conv_id % 3 <> 0").withColumn("place", F.col("msg_seq"))))
_TAXONOMY = [("articles", "the"), ("conjunctions", "and"), ("prepositions", "of"), ("german", "und"), ("french", "les"), ("never", "zzzz")]


def _tagged(m: DataFrame) -> DataFrame:
    tests = m.select("platform", F.col("msg_seq").alias("place"), F.lit("").alias("capability"), F.col("texte").alias("prompt"))
    return calibration.tag_tests(tests, m.sparkSession.createDataFrame(_TAXONOMY, "id string, keyword string"))


def _found(m: DataFrame) -> DataFrame:
    return _tagged(m).select("place", F.array_join("capabilities", ",").alias("found"))


_query("q4_tag_tests", "messages", "SELECT msg_seq AS place, array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN contains(strip_accents(lower(texte)), '{k}') THEN '{i}' END" for i, k in _TAXONOMY) + "], lambda x: x IS NOT NULL)), ',') AS found FROM messages")(lambda m: _found(m))
_query("q5_min_cover", "messages", None)(lambda m: calibration.minimum_cover(_tagged(m), "platform"))
_SAYS = "[" + ", ".join(f"CASE WHEN {{}} bool_or(contains(strip_accents(lower(texte)), '{k}')) THEN '{i}' END" for i, k in sorted(_TAXONOMY)) + "]"
_query("q7_payload", "messages", f"SELECT platform, array_to_string(list_filter({_SAYS.replace('{}', '')}, lambda x: x IS NOT NULL), ',') AS covered, array_to_string(list_filter({_SAYS.replace('{}', 'NOT')}, lambda x: x IS NOT NULL), ',') AS missing FROM messages GROUP BY platform")(lambda m: calibration.payload(_tagged(m), m.sparkSession.createDataFrame(_TAXONOMY, "id string, keyword string"), "platform").select("platform", F.array_join("covered", ",").alias("covered"), F.array_join("missing", ",").alias("missing")))


def _indexed(m: DataFrame) -> DataFrame:
    rows = m.withColumn("exported_at", F.concat(F.lit("2024-"), (F.col("conv_id") % 3).cast("string")))
    old = incremental.hashing_encoder(rows.where("conv_id % 3 <> 1").withColumn("fingerprint", T.fingerprint("hash", F.col("texte"))), 8).select("platform", "conversation_id", "message_id", "fingerprint", "embedding")
    state = rows.where("conv_id % 3 = 0").select("platform", "conversation_id", "exported_at").distinct()
    return incremental.index_step(rows, state, old, lambda d: incremental.hashing_encoder(d, 8), "hash")[0]


_query("v9_incremental_index", "messages", "SELECT message_id, sha256('hash' || chr(10) || texte) AS fingerprint FROM messages WHERE conv_id % 3 = 0 OR trim(texte) <> ''")(lambda m: _indexed(m).select("message_id", "fingerprint"))
_query("v1_hashing_encoder", "messages", r"SELECT msg_seq, if(regexp_matches(texte, '[\p{L}\p{N}_\-]'), 1.0, 0.0) AS norm FROM messages")(lambda m: incremental.hashing_encoder(m, 16).select("msg_seq", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x), 3).alias("norm")))
_query("k1_merged_messages", "old new", archive.merge_payload.sql.replace("SELECT t.platform, t.conversation_id, t.status, o.i AS pos, o.k AS identity FROM", "SELECT t.conversation_id, o.k AS identity FROM").replace("SELECT t.platform, t.conversation_id, t.status, w.i, w.k FROM", "SELECT t.conversation_id, w.k FROM"))(
    lambda o, n: incremental.merged_messages(o, n).select("conversation_id", F.concat(F.lit("id:"), F.col("message_id")).alias("identity"))
)


# Look-ups, reports, wire formats, pages of vendors, media and the archive parsed anew.
_query("a12_lookup", "conv", "SELECT platform, conversation_id FROM conv WHERE starts_with(conversation_id, 'c00001')")(lambda c: lookup.candidates(c, "c00001").select(*_KEY))
_query("a11_locate", "conv", "SELECT platform, conversation_id FROM conv WHERE conv_id = 7")(lambda c: lookup.locate(c, "claude", "c000007").select(*_KEY))
_query("p11_by_title", "conv", "SELECT conversation_id FROM conv WHERE conv_id % 7 = 3 OR conversation_id LIKE '%itle 3%'")(lambda c: lookup.by_title(c, "ÍTLE 3").select("conversation_id"))
_query("r5_indexed_file", "messages", "SELECT platform, conversation_id, message_id || '.json' AS file FROM messages WHERE pos = 1")(
    lambda m: lookup.indexed_file(m.withColumn("file", F.when(F.col("pos") > 0, F.concat("message_id", F.lit(".json"))).otherwise(""))).select(*_KEY, "file")
)
_query("r10_view", "messages conv", "SELECT pos, message_id, coalesce(texte, '') AS texte, 'Title ' || CAST(conv_id % 7 AS VARCHAR) AS title, 'https://claude.ai/chat/c000007' AS url FROM messages WHERE conv_id = 7")(lambda m, c: lookup.view(m, c, "claude", "c000007").select("pos", "message_id", "texte", "title", "url"))


def _reports(c: DataFrame) -> DataFrame:
    status = F.when(F.col("conv_id") % 5 == 0, "degrade").when(F.col("conv_id") % 7 == 0, "echec").otherwise("ok")
    rows = c.select("platform", "conversation_id", "title", status.alias("status"), F.when(F.col("conv_id") % 7 == 0, "lost").alias("error"), F.expr("array('images', 'links')").alias("lost"), F.lit(0.75).alias("retention"), F.col("message_count").alias("old_messages"), F.lit("x").alias("new_messages"))
    return reports.write_recheck(rows)


_query("a17_recheck_report", "conv", "WITH t AS (SELECT *, CASE WHEN conv_id % 5 = 0 THEN 'degrade' WHEN conv_id % 7 = 0 THEN 'echec' ELSE 'ok' END AS s FROM conv) SELECT platform, if(2 * count(*) FILTER (s = 'echec') >= count(*), 'critique', if(count(*) FILTER (s <> 'ok') = 0, 'ok', 'attention')) AS verdict, count(*) AS checked, count(*) AS compared, count(*) FILTER (s = 'ok') AS ok, count(*) FILTER (s = 'degrade') AS degraded, count(*) FILTER (s = 'echec') AS failed, 0.75 AS retention FROM t GROUP BY platform")(
    lambda c: reports.read_recheck(_reports(c)).drop("ignored", "checked_at", "seed", "issues")
)
_query("r13_report_issues", "conv", "SELECT platform, conversation_id, if(conv_id % 5 = 0 AND conv_id % 7 <> 0, 'images, links', 'lost') AS reason, message_count AS old_messages, CAST(NULL AS BIGINT) AS new_messages FROM conv WHERE conv_id % 5 = 0 OR conv_id % 7 = 0")(
    lambda c: reports.read_recheck(_reports(c)).select("platform", F.explode("issues").alias("i")).select("platform", "i.conversation_id", "i.reason", "i.old_messages", "i.new_messages")
)
_query("b14_health_report", "events", "SELECT event_type AS service, count(*) AS n, count(*) FILTER (value >= 95) AS matches FROM events GROUP BY 1")(
    lambda e: reports.write_health(e.groupBy(F.col("event_type").alias("service")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") >= 95).alias("matches"), F.lit(0).alias("drifts"), F.lit(0).alias("breaks"), F.min("value").alias("least"))).select("service", F.from_json("report", "n long, matches long").alias("r")).select("service", "r.*")
)
_query("o5_outcomes", "conv", "SELECT conversation_id, ['exported', 'blocked', 'skipped', 'failed', 'failed'][conv_id % 5 + 1] AS status, conv_id % 5 = 1 AS stop, conv_id % 5 = 2 AS unavailable FROM conv")(
    lambda c: reports.outcomes(c.select("conversation_id", F.get(F.array(F.lit(None), F.lit("blocked"), F.lit("unavailable"), F.lit("schema"), F.lit("other")), (F.col("conv_id") % 5).cast("int")).alias("error"))).drop("error")
)
_query("a21_wire_payload", "messages", "SELECT msg_seq, md5(texte) AS value FROM messages WHERE pos % 4 <> 3 UNION ALL SELECT msg_seq, NULL FROM messages WHERE pos % 4 = 3")(
    lambda m: m.select("msg_seq", F.concat(F.lit(")]}'\n\n123\n"), F.to_json(F.array(F.array(F.lit("di"), F.lit("59")), F.array(F.lit("wrb.fr"), F.when(F.col("pos") % 4 == 3, "other").otherwise("call"), F.to_json(F.array("texte")), F.lit("generic")))), F.lit("\n25\n[[\"e\",4]]\n")).alias("said"))
    .select("msg_seq", F.md5(F.get(F.from_json(wire.batch_payload(F.col("said"), "call"), "array<string>"), 0)).alias("value"))
)
_query("a23_page_payload", "messages", "SELECT msg_seq, md5(texte || texte) AS value FROM messages")(
    lambda m: m.select("msg_seq", F.md5(wire.page_payload(F.concat(F.lit("<script>self.__next_f.push([1,"), *(x for _ in range(2) for x in (F.regexp_extract(F.to_json(F.array("texte")), r"(?s)^\[(.*)\]$", 1), F.lit("])</script><script>self.__next_f.push([1,"))), F.lit("1])</script>")))).alias("value"))
)
_query("a24_page_objects", "messages", "SELECT conversation_id, message_id AS object_id, md5(texte) AS value FROM messages WHERE role IN ('user', 'assistant')")(
    lambda m: wire.objects(m.where("role IN ('user', 'assistant')").groupBy("conversation_id").agg(F.concat(F.lit("0:["), F.array_join(F.collect_list(F.concat(F.lit("x,"), F.to_json(F.struct("role", F.col("message_id").alias("id"), F.struct("texte").alias("c"))))), " "), F.lit('{"role":"user","id":"open')).alias("payload")), id_col="conversation_id")
    .select("conversation_id", "object_id", F.md5(F.get_json_object("object", "$.c.texte")).alias("value"))
)
_PLAIN_DUCK = r"trim(regexp_replace(texte, '\s+', ' ', 'g'))"
_text("c30_normalise_text", lambda: F.md5(T.collapse(MD.normalise_text(F.concat(F.lit(" x\u00a0\u200b  y\t\n\n\n\n```py\n  a  =  1  \n```  \n"), F.col("texte"))))), f"md5(trim('x y ```py a = 1 ``` ' || {_PLAIN_DUCK}))")
_text("c32_tidy_blank_lines", lambda: F.md5(MD.tidy_blank_lines(F.concat(F.lit("a\n\n \n\nb\n```\n\n\n\nx\n```\n\n\n"), F.col("message_id")))), "md5('a' || repeat(chr(10), 2) || 'b' || chr(10) || '```' || repeat(chr(10), 4) || 'x' || chr(10) || '```' || repeat(chr(10), 2) || message_id)")
_text("c33_normalise_markdown", lambda: MD.normalise_markdown(F.concat(F.lit("* a [cite: 3]\n[file-tag: f1] https://googleusercontent.com/image_generation_content/7\n```py?code_x\nz\n\n```\n"), F.col("message_id")), F.create_map(F.lit("[file-tag: f1]"), F.lit("[f](u)"))), "'- a ' || chr(10) || '[f](u) ' || chr(10) || '```py' || chr(10) || 'z' || chr(10) || '```' || chr(10) || message_id")
_text("j18_citations", lambda: MD.render_citations(F.concat(F.lit("a <grok:render card_id=\"k1\" x><argument name=\"citation_id\">7</argument></grok:render> <grok:render card_id=\"k2\"></grok:render> "), F.col("message_id")), F.create_map(F.lit("k1"), F.concat(F.lit("https://x/("), "message_id"))), "'a [7](https://x/(' || message_id || ') <grok:render card_id=\"k2\"></grok:render> ' || message_id")


#: What answers of pages have beside their text, before and after it: a formula, code, citations, a step, an artifact, a file. ID stands for the message's.
_BESIDE = {
    "chatgpt": ('<article data-testid="conversation-turn-1"><button>Worked for 2s</button><div class="activity"><div class="activity-header"><span class="truncate">Step ID</span></div></div>',
                '<span data-testid="webpage-citation-pill"><a href="https://p/ID"><span class="truncate">Site</span><span>+2</span></a></span><div id="textdoc-message-1"><b class="font-semibold">Doc ID</b><div contenteditable="true">canvas ID</div></div></article>'),
    "gemini": ('<div class="conversation-container">', '<source-inline-chip><span class="source-title">Site</span><a href="https://p/ID">x</a></source-inline-chip><generated-image></generated-image></div>'),
    "perplexity": ("<div>", '<div data-testid="sources"><a href="https://p/ID" title="Site">s</a></div></div>'),
}
_INSIDE = {
    "chatgpt": '<p>so <span class="katex"><annotation encoding="application/x-tex">x_ID</annotation>x</span></p><pre><div class="font-sans"><div>C++</div></div><code>int ID;</code></pre>',
    "gemini": '<p>so <span data-math="x_ID">x</span></p><code-block><div class="code-block-decoration">C++</div><pre><code>int ID;</code></pre></code-block>',
    "perplexity": '<p>so <span data-math-source="x_ID">x</span></p><pre><figcaption><span>C++</span></figcaption><code>int ID;</code></pre>',
}


def _with_id(said: str):
    return F.replace(F.lit(said), F.lit("ID"), F.col("message_id"))


def _around(platform: str, made):
    """An answer of a page with what is beside it and at the end of its text."""
    if platform not in _BESIDE:
        return made
    end = {"chatgpt": "</div><button>Copy</button></div>", "gemini": "</div></message-content>", "perplexity": "</div>"}[platform]
    inside = F.concat(F.regexp_replace(made, f"(?s){re.escape(end)}.*?$" if platform != "perplexity" else "</div>$", ""), _with_id(_INSIDE[platform]))
    rest = {"chatgpt": end, "gemini": "</div></message-content><message-actions>Share</message-actions></model-response>", "perplexity": end}[platform]
    before, after = map(_with_id, _BESIDE[platform])
    whole = F.concat(inside, F.lit(rest))
    return F.concat(before, F.regexp_replace(whole, "</model-response>$", ""), after) if platform != "gemini" else F.concat(before, F.regexp_replace(whole, "</model-response>$", ""), F.replace(after, F.lit("</div>"), F.lit("</model-response></div>")))


def _page(m: DataFrame, platform: str) -> DataFrame:
    said = F.concat(F.lit("<p>"), *[F.replace(F.replace(F.replace(F.col("texte"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("\n"), F.lit("<br>"))], F.lit("</p>"))
    user = F.col("role") != "assistant"
    made = {
        "chatgpt": F.concat(F.lit('<div data-message-id="'), "message_id", F.lit('" data-message-author-role="'), F.when(user, "user").otherwise("assistant"), F.lit('"><span>no</span><div class="markdown prose">'), said, F.lit("</div><button>Copy</button></div>")),
        "claude": F.concat(F.when(user, '<div data-testid="user-message">').otherwise('<div class="font-claude-message"><details>x</details><div data-test="collapsible-text"><div data-testid="thinking-block">why</div>'), said, F.when(user, "</div>").otherwise("</div></div>")),
        "gemini": F.when(user, F.concat(F.lit('<user-query><div class="query-text">'), said, F.lit("</div></user-query>"))).otherwise(F.concat(F.lit('<model-response><message-content><div class="model-response-text">'), said, F.lit("</div></message-content><message-actions>Share</message-actions></model-response>"))),
        "mistral": F.concat(F.lit('<div data-message-author-role="'), F.when(user, "user").otherwise("assistant"), F.lit('" data-message-id="'), "message_id", F.lit('"><div class="text-hint text-sm">hier 10:00</div>'), said, F.lit("</div>")),
        "perplexity": F.concat(F.when(user, '<div class="group/user-bubble">').otherwise('<div data-workflow-final-text="1"><span class="citation">a+1</span>'), said, F.lit("</div>")),
    }[platform]
    made = F.when(user, made).otherwise(_around(platform, made))
    own = m.where(F.col("platform") == platform).groupBy("platform", "conversation_id").agg(F.sort_array(F.collect_list(F.struct("pos", made.alias("said")))).alias("a"))
    return own.select("platform", "conversation_id", F.concat(F.lit("<!DOCTYPE html><html><head><title>t</title></head><body><nav>menu</nav>"), F.array_join(F.transform("a", lambda x: x["said"]), "<hr>\n"), F.lit("</body>")).alias("html"))


_FORMULA = " || ' so $x_' || message_id || '$ ```cpp int ' || message_id || '; ```'"
for _platform in pages.PAGES:
    _id, _rich, _gpt = "message_id" if _platform in ("chatgpt", "mistral") else "''", _platform in _BESIDE, _platform == "chatgpt"
    _answer = lambda c: f"if(role = 'assistant', {c}, '')"
    _why = _answer("'why'") if _platform == "claude" else _answer("'Step ' || message_id") if _gpt else "''"
    _said = f"{_PLAIN_DUCK}{_FORMULA}" + (" || ' canvas ' || message_id" if _gpt else "") if _rich else _PLAIN_DUCK
    _query(f"m7_{_platform}_page", "messages", f"""SELECT conversation_id, CAST(row_number() OVER (PARTITION BY conversation_id ORDER BY pos) - 1 AS INTEGER) AS pos, if(role = 'assistant', 'assistant', 'user') AS role, {_id} AS message_id, md5(if(role = 'assistant', {_said}, {_PLAIN_DUCK})) AS texte, {_why} AS why,
        {_answer("'Step ' || message_id" if _gpt else "'Génération d''images'" if _platform == 'gemini' else "''")} AS tools, {_answer("'Site — https://p/' || message_id" if _rich else "''")} AS sources, {_answer("'Doc ' || message_id" if _gpt else "''")} AS artifacts FROM messages WHERE platform = '{_platform}'""")(
        lambda m, p=_platform: pages.read_pages(_page(m, p), p).select("conversation_id", "pos", "role", "message_id", F.md5(T.collapse(F.col("texte"))).alias("texte"), F.col("reasoning").alias("why"), *(F.array_join(c, "|").alias(c) for c in ("tools", "sources", "artifacts")))
    )


def _reparsed(m: DataFrame) -> tuple[DataFrame, DataFrame]:
    payloads = _payloads(m.where("conv_id % 12 = 1 OR pos < 2"), "claude").withColumn("platform", F.lit("claude"))
    own = m.select("platform", "conversation_id", "pos", "message_id", "role", "model", "ts", "texte")
    return reparse.reparse(own, payloads, _page(m, "mistral").unionByName(_page(m, "claude")))


_query("b18_reparse", "messages", "SELECT platform, conversation_id, CASE platform WHEN 'claude' THEN 'remapped' WHEN 'mistral' THEN 'reparsed' ELSE 'cleaned' END AS origin, platform = 'claude' AND conv_id % 12 <> 1 AND count(*) > 2 AS kept, count(*) AS messages FROM messages GROUP BY platform, conversation_id, conv_id")(lambda m: _reparsed(m)[1].drop("status"))
_query("r15_reparsed_messages", "messages", "SELECT conversation_id, message_id, model FROM messages")(lambda m: _reparsed(m)[0].select("conversation_id", "message_id", "model"))
_query("g26_reparse_counters", "messages", "WITH c AS (SELECT platform, conv_id, count(*) AS n FROM messages GROUP BY ALL) SELECT platform, CASE platform WHEN 'claude' THEN 'remapped' WHEN 'mistral' THEN 'reparsed' ELSE 'cleaned' END AS what, count(*) AS n FROM c GROUP BY platform UNION ALL SELECT platform, 'kept', count(*) FROM c WHERE platform = 'claude' AND conv_id % 12 <> 1 AND n > 2 GROUP BY platform")(lambda m: reparse.counters(_reparsed(m)[1]))
_query("c7_derived_times", "messages conv", "SELECT c.conversation_id, strftime(CASE WHEN c.conv_id % 2 = 0 THEN c.started_at ELSE min(m.ts) END, '%Y%m%d%H%M%S') AS started_at FROM conv c JOIN messages m USING (conversation_id) GROUP BY c.conversation_id, c.conv_id, c.started_at")(
    lambda m, c: reparse.derive_times(c.withColumn("started_at", F.when(F.col("conv_id") % 2 == 0, F.col("started_at"))), m).select("conversation_id", F.date_format("started_at", "yyyyMMddHHmmss").alias("started_at"))
)
_query("m8_checked", "messages", "WITH r AS (SELECT *, lag(role) OVER (PARTITION BY conversation_id ORDER BY pos) IS DISTINCT FROM role AS head FROM messages) SELECT conversation_id, count(*) FILTER (head) AS messages, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started_at, TRUE AS valid FROM r GROUP BY conversation_id")(
    lambda m: reparse.checked(m)[1].select("conversation_id", "messages", F.col("started_at").cast("string").alias("started_at"), "valid")
)
_NEAR_MEDIA = f"SELECT m.*, list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST({_OWN} AS DOUBLE[])) AS s FROM media m JOIN embeddings v ON v.vec_id = m.media_id"
_vectors_of = lambda e: e.select(F.col("vec_id").alias("media_id"), "embedding")
_query("j6_media_nearest", "media embeddings", f"SELECT media_id, round(s, 4) AS score FROM ({_NEAR_MEDIA}) t WHERE kind = 'image' ORDER BY s DESC, media_id LIMIT 10")(lambda d, e: media.nearest(d, _vectors_of(e), _vector(e), 10, "image").select("media_id", F.round("score", 4).alias("score")))
_query("t8_media_for_query", "media embeddings", f"WITH n AS (SELECT * FROM ({_NEAR_MEDIA}) t ORDER BY s DESC, media_id LIMIT 64), o AS (SELECT *, row_number() OVER (PARTITION BY content_key ORDER BY s DESC, media_id) AS k FROM n WHERE platform IN ('en', 'de', 'fr')) SELECT media_id, round(s, 4) AS score FROM o WHERE k = 1 ORDER BY s DESC, media_id LIMIT 8")(
    lambda d, e: media.for_query(d, _vectors_of(e), _vector(e), 8, ["en", "de", "fr", "xx"], ["en", "de", "fr"]).select("media_id", "score")
)
_query("j7_media_referenced", "messages", "SELECT 'i' || CAST(pos AS VARCHAR) || '.png' AS name, platform, if(pos % 2 = 0, min(conversation_id), '') AS conversation_id FROM messages GROUP BY platform, pos")(
    lambda m: media.referenced(
        m.select("platform", F.lit("images").alias("folder"), F.concat(F.lit("i"), F.col("pos").cast("string"), F.lit(".png")).alias("name")).distinct(),
        archives.media_references(m.where("pos % 2 = 0").withColumn("texte", F.concat(F.lit("![x](images/i"), F.col("pos").cast("string"), F.lit(".png)")))),
    ).select("name", "platform", "conversation_id")
)


def _media_index(d: DataFrame) -> tuple[DataFrame, DataFrame]:
    files = d.select("media_id", "platform", "kind", F.col("media_id").alias("size"), F.lit(5).alias("mtime"))
    told = files.withColumn("fingerprint", T.fingerprint("model", F.col("media_id"), F.col("size").cast("string"), F.lit("5")))
    index = told.where("media_id % 3 <> 0").select("media_id", "platform", "kind", F.when(F.col("media_id") % 2 == 0, F.col("fingerprint")).otherwise("old").alias("fingerprint"), F.array(F.lit(0.5)).alias("embedding"))
    return media.index_step(files, index, lambda f: f.withColumn("embedding", F.when(F.col("media_id") % 7 != 0, F.array(F.lit(1.0)))), "model")


_query("g25_media_counters", "media", "SELECT kind, count(*) AS scanned, count(*) FILTER (media_id % 6 IN (2, 4)) AS skipped, count(*) FILTER (media_id % 6 NOT IN (2, 4) AND media_id % 7 <> 0) AS indexed, count(*) FILTER (media_id % 6 NOT IN (2, 4) AND media_id % 7 = 0) AS failed FROM media GROUP BY kind")(lambda d: _media_index(d)[1])
_query("v10_media_index", "media", "SELECT media_id, if(media_id % 6 IN (2, 4) OR media_id % 7 = 0, 0.5, 1.0) AS value FROM media WHERE media_id % 3 <> 0 OR media_id % 7 <> 0")(lambda d: _media_index(d)[0].select("media_id", F.get("embedding", 0).cast("double").alias("value")))
_query("v8_backfill", "messages", "SELECT msg_seq, if(pos % 2 = 0, sha256('m' || chr(10) || texte), 'known') AS fingerprint FROM messages")(lambda m: media.backfill_fingerprints(m.withColumn("fingerprint", F.when(F.col("pos") % 2 == 1, "known").when(F.col("pos") % 4 == 0, "")), "m").select("msg_seq", "fingerprint"))
_query("r29_media_delete", "media", "SELECT media_id FROM media WHERE media_id % 3 <> 0")(lambda d: media.delete(d, d.where("media_id % 3 = 0")).select("media_id"))


# What is read from files and untrusted values, suites, labels and picks.
def _exports(m: DataFrame) -> DataFrame:
    """Conversations as older archives write them: other names, nulls, and in some what the schema forbids."""
    said = F.struct("pos", F.struct(F.when(F.col("pos") % 2 == 0, F.col("message_id")).alias("message_id"), F.when((F.col("conv_id") % 9 == 4) & (F.col("pos") == 0), "robot").otherwise(F.col("role")).alias("role"), F.when(F.col("pos") % 3 == 0, F.col("texte")).alias("texte"), F.when(F.col("pos") % 3 == 1, F.col("texte")).alias("content"), F.array(F.lit("s"), F.lit(None)).alias("sources")).alias("m"))
    own = m.groupBy(F.col("platform").alias("service"), "conversation_id", "conv_id").agg(F.sort_array(F.collect_list(said)).alias("a"))
    return own.select("service", "conversation_id", "conv_id", F.when(F.col("conv_id") % 5 != 2, "T").alias("title"), F.when(F.col("conv_id") % 7 == 3, "soon").alias("started_at"), F.transform("a", lambda x: x["m"]).alias("messages"))


def _read_exports(m: DataFrame) -> DataFrame:
    """Exports written and read again, a conversation a line: a file for each would cost more than all that is in it."""
    root = f"{scratch(m.sparkSession)}/exports-{uuid.uuid4().hex[:12]}"
    _exports(m).withColumn("platform", F.col("service")).drop("conv_id").write.partitionBy("platform").json(root)
    return archives.read_conversations(m.sparkSession, root, lines=True)


_query("a1_export_scan", "messages", "SELECT platform, conversation_id, count(*) AS n FROM messages GROUP BY ALL")(lambda m: _read_exports(m).select("platform", "conversation_id", F.size("messages").cast("long").alias("n")))
_query("c4_message_coercion", "messages", "SELECT conversation_id, pos, if(pos % 2 = 0, message_id, '') AS message_id, md5(if(pos % 3 < 2, texte, '')) AS texte, 1 AS n_sources FROM messages")(lambda m: archives.messages(_read_exports(m)).select("conversation_id", "pos", "message_id", F.md5("texte").alias("texte"), F.size("sources").alias("n_sources")))
_query("c6_violations", "messages", "SELECT conversation_id, trim(if(conv_id % 5 = 2, 'title ', '') || if(conv_id % 9 = 4, 'role ', '') || if(conv_id % 7 = 3, 'started_at', '')) AS violations FROM messages GROUP BY conversation_id, conv_id")(lambda m: archives.violations(_read_exports(m)).select("conversation_id", F.array_join("violations", " ").alias("violations")))
_query("c52_coercions", "messages", "SELECT msg_seq, [pos, -2, 0, 0, 0][pos % 5 + 1] AS whole, CASE pos % 5 WHEN 0 THEN pos WHEN 1 THEN -2.5 END AS finite, pos % 5 = 4 AS flag FROM messages")(
    lambda m: m.withColumn("x", F.get(F.array(F.col("pos").cast("string"), F.lit("-2.5"), F.lit("inf"), F.lit("x"), F.lit("True")), F.col("pos") % 5)).select("msg_seq", reports.whole(F.col("x")).alias("whole"), reports.finite(F.col("x")).alias("finite"), reports.flag(F.when(F.col("pos") % 5 == 4, F.col("x"))).alias("flag"))
)
_query("c56_tool_labels", "messages", "SELECT msg_seq, ['Recherche web', 'Exécution de commandes', 'other tool', ''][pos % 4 + 1] AS label FROM messages")(
    lambda m: m.select("msg_seq", parsers.tool_label(F.get(F.array(F.lit("Web_Search"), F.lit(" bash"), F.lit("other tool"), F.lit(None)), F.col("pos") % 4), parsers.GROK_TOOLS, True).alias("label"))
)
_query("c49_month_axis", "events", "SELECT strftime(m, '%Y-%m') AS month FROM generate_series(DATE '2023-03-01', DATE '2024-02-01', INTERVAL 1 MONTH) t(m)")(lambda e: analytics.month_axis(e.sparkSession, "2024-02-29", 12))


def _thread_sources(m: DataFrame) -> DataFrame:
    """Sources of threads: u and the place of the first answer, and v; in even conversations each answer has a source of its own."""
    first = m.where("role = 'assistant'").groupBy("conversation_id").agg(F.min("pos").alias("lo"), F.count(F.lit(1)).alias("n"))
    thread = first.select("conversation_id", F.explode(F.array(F.struct(F.lit(1).alias("place"), F.lit("T").alias("title"), F.concat(F.lit("u"), F.col("lo").cast("string")).alias("url")), F.struct(F.lit(2).alias("place"), F.lit("T").alias("title"), F.lit("v").alias("url")))).alias("x")).select("conversation_id", "x.*")
    rows = m.join(first, "conversation_id", "left").select("conversation_id", "pos", "role", F.when((F.col("role") == "assistant") & (F.col("conv_id") % 2 == 0), F.array(F.concat(F.lit("x — u"), F.col("pos").cast("string")))).otherwise(F.expr("CAST(array() AS array<string>)")).alias("sources"), F.when((F.col("conv_id") % 3 == 0) & (F.col("pos") == F.col("lo")), 2).alias("source_count"))
    even = rows.join(thread.select("conversation_id").distinct(), "conversation_id", "left_semi")
    return parsers.attach_thread_sources(even, thread).unionByName(rows.join(thread.select("conversation_id").distinct(), "conversation_id", "left_anti").drop("x"))


_query("j21_thread_sources", "messages", """WITH a AS (SELECT conversation_id, pos, conv_id FROM messages WHERE role = 'assistant'), l AS (SELECT conversation_id, min(pos) AS lo, max(pos) AS hi, count(*) AS n FROM a GROUP BY 1)
    SELECT m.conversation_id, m.pos, CASE WHEN m.role = 'assistant' AND m.conv_id % 2 = 0 THEN 'x — u' || m.pos || CASE WHEN m.pos = hi THEN ',T — v' ELSE '' END WHEN m.role = 'assistant' AND m.conv_id % 2 = 1 AND m.pos = CASE WHEN m.conv_id % 3 = 0 THEN lo ELSE hi END THEN 'T — u' || lo || ',T — v' ELSE '' END AS sources FROM messages m LEFT JOIN l USING (conversation_id)""")(
    lambda m: _thread_sources(m).select("conversation_id", "pos", F.array_join("sources", ",").alias("sources"))
)
_query("c55_align_filenames", "messages", "SELECT msg_seq, 'see a' || pos || '.pdf, b.png and b.png; no x.zip ' || message_id AS value FROM messages")(
    lambda m: m.select("msg_seq", calibration.align_filenames(F.concat(F.lit("see test.PDF, one.jpg and two.png; no x.zip "), "message_id"), F.array(F.concat(F.lit("a"), F.col("pos").cast("string"), F.lit(".pdf")), F.lit("b.png"))).alias("value"))
)
_query("r4_has_code", "messages", "SELECT conversation_id, bool_or(pos % 4 = 1) AS has_code FROM messages GROUP BY conversation_id")(
    lambda m: m.withColumn("texte", F.when(F.col("pos") % 4 == 1, _made()).otherwise(F.lit("plain"))).groupBy("conversation_id").agg(F.bool_or(T.has_code(F.col("texte"))).alias("has_code"))
)
_query("r3_valid_variants", "messages", "SELECT msg_seq, pos % 3 <> 1 AS valid FROM messages")(
    lambda m: m.select("msg_seq", parsers.valid_variants(F.when(F.col("pos") % 3 != 2, F.array(F.struct(F.when(F.col("pos") % 3 == 0, "edit").otherwise("other").alias("kind"), "texte")))).alias("valid"))
)
_query("r20_image_bytes", "messages", "SELECT msg_seq, pos % 4 IN (0, 1) AS value FROM messages")(
    lambda m: m.select("msg_seq", T.looks_like_image(F.when(F.col("pos") % 4 == 0, F.unhex(F.lit("89504E470D0A1A0A0000"))).otherwise(F.col("texte").cast("binary")), F.get(F.array(F.lit(None), F.lit("image/png; q=1"), F.lit("text/html"), F.lit("")), F.col("pos") % 4)).alias("value"))
)
_query("q6_supplements", "messages", "SELECT message_id AS capability, 'own' AS prompt, 'suite' AS origin FROM messages WHERE pos % 2 = 0 UNION ALL SELECT message_id, min(m), 'supplement' FROM (SELECT message_id, unnest(['b', 'a']) AS m FROM messages WHERE pos % 2 = 1) t GROUP BY message_id")(
    lambda m: reports.apply_supplements(m.where("pos % 2 = 0").select(F.col("message_id").alias("capability"), F.lit("own").alias("prompt")), m.select(F.col("message_id").alias("capability"), F.explode(F.array(F.lit("b"), F.lit("a"))).alias("prompt")))
)
_query("a20_canaries", "conv", "SELECT platform, max(conversation_id) AS conversation_id, 2 AS n FROM conv GROUP BY platform")(
    lambda c: reports.read_canaries(c.groupBy("platform").agg(F.max("conversation_id").alias("conversation_id")).select(F.to_json(F.create_map("platform", F.struct("conversation_id", F.array(F.lit("x"), F.lit("y")).alias("expected")))).alias("config"))).select("platform", "conversation_id", F.size("expected").alias("n"))
)
_query("j9_random_indexed", "messages", None)(lambda m: search.random_indexed(m, 5, 7))
_query("q3_suite_tests", "messages", "SELECT msg_seq AS suite_id, 'Liens' AS capability, 'Partie ' || message_id AS section, 'ask ' || message_id AS prompt FROM messages")(
    lambda m: calibration.extract_tests(m.select(F.col("msg_seq").alias("suite_id"), F.concat(F.lit("# Partie "), "message_id", F.lit("\n\n## Test 3 — Liens\nsee\n```\nask "), "message_id", F.lit("\n```\n## Notes\n```\nno\n```\n## Test 4: none\n")).alias("text"))).drop("place")
)
_query("r11_backups", "conv", "SELECT platform || '-' || conversation_id AS name FROM conv WHERE platform = 'grok'")(lambda c: archive.backups(c.select(F.concat_ws("-", "platform", "conversation_id").alias("name")), "grok-"))
_query("b20_frozen_canaries", "messages conv", "SELECT c.conversation_id, md5(string_agg(replace(texte, 'the', 'THE'), chr(10) ORDER BY pos)) AS value FROM conv c JOIN messages m USING (conversation_id) WHERE c.conv_id % 6 = 1 GROUP BY c.conversation_id")(
    lambda m, c: archive.frozen(m, c.where("conv_id % 6 = 1"), lambda x: sanitize.sanitize(x, names={"the": "THE"})).groupBy("conversation_id").agg(F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "texte"))), lambda x: x["texte"]), "\n")).alias("value"))
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in Q.items() if sql}
