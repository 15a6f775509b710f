"""The registered queries: name -> (spark, folder of tables) -> DataFrame, and the SQL that gives the same rows.

The tables hold no security telemetry, so they are projected: events become alerts (value as a severity number, event_type
as the rule, user_id as the user, props as the payload), documents and pages give texts and URLs with indicators, labels
give expected bands, nations and suppliers an asset inventory, orders and line items raw events and their alerts.
"""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ioc, net, paths, scoring, severity
from ..operators import cluster, dedup, evaluate, lifecycle, normalize, queries, review, sinks, triage
from ..operators.graph import shared_folder
from ..sources import readers
from ..streaming.store import KeyedStore

QUERIES: dict = {}
ORACLES: dict = {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as alerts."""
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("replay:"), "event_id").alias("id"), F.lit("replay").alias("source"), F.col("ts").cast("timestamp").alias("event_ts"), severity.from_text_or_number(F.col("value")).alias("severity"), F.col("event_type").alias("rule_name"), F.col("user_id").cast("string").alias("user"), F.col("props").alias("payload_json"), "event_id", "value")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triage.score_alerts(alerts(spark, sf_dir))


#: SQL for the alerts and their scores; the queries' SQL starts with it.
SEVERITY_SQL = "CASE WHEN value >= 90 THEN 'critical' WHEN value >= 70 THEN 'high' WHEN value >= 40 THEN 'medium' WHEN value >= 10 THEN 'low' WHEN value IS NOT NULL THEN 'info' ELSE 'unknown' END"
SCORED_SQL = f"""
    WITH a AS (SELECT 'replay:' || event_id AS id, ts, event_id, user_id::VARCHAR AS usr, event_type, value, props, {SEVERITY_SQL} AS severity FROM events),
    s AS (SELECT *, CASE severity WHEN 'critical' THEN 8 WHEN 'high' THEN 6 WHEN 'medium' THEN 4 WHEN 'low' THEN 2 WHEN 'info' THEN 1 ELSE 3 END AS score FROM a),
    t AS (SELECT *, CASE WHEN score >= 8 THEN 'page_now' WHEN score >= 4 THEN 'queue_review' ELSE 'mark_likely_benign' END AS action,
          CASE WHEN score >= 8 THEN 'likely_true_positive_high_priority' WHEN score >= 4 THEN 'needs_analyst_review' ELSE 'likely_false_positive_or_low_priority' END AS classification FROM s)
"""


@register(SCORED_SQL + "SELECT severity, count(*) AS n FROM t GROUP BY 1")
def severity_distribution(spark, d):
    return queries.severity_counts(alerts(spark, d))


@register(SCORED_SQL + "SELECT action, count(*) AS n FROM t GROUP BY 1")
def triage_routing_breakdown(spark, d):
    return queries.count_by(triage.routed(scored(spark, d), "id"), "routed_action", "action")


@register(SCORED_SQL + "SELECT score::INT AS score, count(*) AS n FROM t GROUP BY 1")
def score_histogram(spark, d):
    return queries.score_distribution(scored(spark, d))


@register(SCORED_SQL + "SELECT id, score::INT AS score, action, classification, CASE WHEN score >= 8 THEN 'low' WHEN score >= 4 THEN 'medium' ELSE 'high' END AS fp_likelihood, 'triage-' || substr(sha256('alert:' || id || ':' || score || ':' || classification), 1, 12) AS triage_id FROM t")
def alert_triage(spark, d):
    return scored(spark, d).select("id", "score", "action", "classification", "fp_likelihood", "triage_id")


_ROUTED_SQL = SCORED_SQL + """, r AS (SELECT *, 'triage-' || substr(sha256('alert:' || id || ':' || score || ':' || classification), 1, 12) AS triage_id,
    CASE action WHEN 'page_now' THEN 'page_now' WHEN 'queue_review' THEN 'analyst_queue' ELSE 'likely_benign' END AS destination,
    'Local triage scored alert ' || id || ' as ' || score || '/10 (' || action || '): ' || coalesce(event_type, 'Unknown rule') || ' on unknown host.' AS summary FROM t) """


@register(_ROUTED_SQL + "SELECT 'route-' || substr(sha256(triage_id || ':' || id || ':' || action), 1, 12) AS routing_id, destination, CASE action WHEN 'page_now' THEN 'created' WHEN 'queue_review' THEN 'queued' ELSE 'marked_likely_benign' END AS status, 'Routed target ' || id || ' with score ' || score || '/10 as ' || action || ' to ' || destination || ': ' || summary AS message FROM r")
def routing_decisions(spark, d):
    return triage.routed(scored(spark, d), "id").select("routing_id", "destination", "status", "message")


@register(SCORED_SQL + ", h AS (SELECT date_trunc('hour', ts) AS hour FROM t WHERE action = 'mark_likely_benign') SELECT g.hour, coalesce(n, 0)::BIGINT AS n FROM (SELECT unnest(generate_series((SELECT min(hour) FROM h), (SELECT max(hour) FROM h), INTERVAL 1 HOUR)) AS hour) g LEFT JOIN (SELECT hour, count(*) AS n FROM h GROUP BY 1) c ON c.hour = g.hour")
def benign_volume_hourly(spark, d):
    return queries.hourly(scored(spark, d).where("action = 'mark_likely_benign'"))


@register(SCORED_SQL + ", h AS (SELECT date_trunc('hour', ts) AS hour, action FROM t) SELECT g.hour, x.action, coalesce(n, 0)::BIGINT AS n FROM (SELECT unnest(generate_series((SELECT min(hour) FROM h), (SELECT max(hour) FROM h), INTERVAL 1 HOUR)) AS hour) g CROSS JOIN (SELECT DISTINCT action FROM h) x LEFT JOIN (SELECT hour, action, count(*) AS n FROM h GROUP BY 1, 2) c ON c.hour = g.hour AND c.action = x.action")
def routing_volume_hourly(spark, d):
    return queries.hourly(scored(spark, d), by="action")


@register(SCORED_SQL + "SELECT date_trunc('hour', ts) AS hour, CASE WHEN score >= 8 THEN '8-10' WHEN score >= 4 THEN '4-7' ELSE '1-3' END AS band, count(*) AS n FROM t GROUP BY 1, 2")
def score_band_by_hour(spark, d):
    band = F.when(F.col("score") >= 8, "8-10").when(F.col("score") >= 4, "4-7").otherwise("1-3")
    return queries.hourly(scored(spark, d).withColumn("band", band), fill=False, by="band")


@register(SCORED_SQL + "SELECT CASE WHEN event_id % 3 = 0 THEN 'llm' ELSE 'local' END AS analysis_source, count(*) AS results, round(avg(score), 2) AS avg_score FROM t GROUP BY 1")
def source_split(spark, d):
    rows = scored(spark, d).withColumn("analysis_source", F.when(F.col("event_id") % 3 == 0, "llm").otherwise("local"))
    return queries.source_split(rows)


@register(SCORED_SQL + "SELECT event_type, count(*) AS results, count(*) FILTER (action = 'page_now') AS paged, count(*) FILTER (score <= 3) AS benign, count(DISTINCT usr) AS users FROM t GROUP BY 1")
def source_table(spark, d):
    return scored(spark, d).groupBy(F.col("rule_name").alias("event_type")).agg(F.count(F.lit(1)).alias("results"), F.count_if(F.col("action") == "page_now").alias("paged"), F.count_if(F.col("score") <= 3).alias("benign"), F.countDistinct("user").alias("users"))


@register(SCORED_SQL + "SELECT id, score::INT AS score, ts AS event_ts FROM t WHERE action = 'page_now' ORDER BY ts DESC, id DESC LIMIT 20")
def paged_recent_top20(spark, d):
    return queries.recent(scored(spark, d).where("action = 'page_now'"), 20).select("id", "score", "event_ts")


@register(SCORED_SQL + "SELECT id, ts AS event_ts, score::INT AS score FROM t WHERE action = 'page_now'")
def page_now_listing(spark, d):
    return scored(spark, d).where("action = 'page_now'").select("id", "event_ts", "score").orderBy(F.desc("event_ts"))


@register("SELECT event_id, json_extract_string(props, '$.k') AS k_text, json_extract_string(props, '$.k')::BIGINT AS k_int, list_value(json_extract_string(props, '$.k'))[1] AS k_first FROM events")
def payload_path_lookup(spark, d):
    p = F.parse_json("props")
    rows = table(spark, d, "events").withColumn("p", p)
    v = F.col("p")
    return rows.select("event_id", paths.first_string(v, ["missing.key", "k"]).alias("k_text"), paths.first_int(v, ["absent", "k"]).alias("k_int"), paths.first_list(v, ["no", "k"])[0].alias("k_first"))


@register("SELECT event_id, CASE WHEN n <= 2 THEN 'info' WHEN n <= 5 THEN 'low' WHEN n <= 8 THEN 'medium' WHEN n <= 11 THEN 'high' ELSE 'critical' END AS wazuh, CASE WHEN n <= 1 THEN 'high' WHEN n = 2 THEN 'medium' WHEN n = 3 THEN 'low' ELSE 'info' END AS inverted, CASE event_type WHEN 'error' THEN 'high' ELSE 'unknown' END AS word FROM (SELECT *, json_extract_string(props, '$.k')::BIGINT % 15 AS n FROM events)")
def severity_scales(spark, d):
    n = (paths.first_int(F.col("p"), ["k"]) % 15).alias("n")
    rows = table(spark, d, "events").withColumn("p", F.parse_json("props")).select("event_id", "event_type", n)
    return rows.select("event_id", severity.from_wazuh_level(F.col("n")).alias("wazuh"), severity.from_inverted(F.col("n")).alias("inverted"), severity.from_text_or_number(F.col("event_type")).alias("word"))


_KEYED = "SELECT *, user_id || ':' || event_type || ':' || strftime(date_trunc('hour', ts), '%Y%m%d%H') AS k FROM events"


def _keyed(spark, d):
    e = table(spark, d, "events")
    return e.withColumn("dedup_key", F.concat_ws(":", "user_id", "event_type", F.date_format("ts", "yyyyMMddHH")))


@register(f"SELECT event_id, k AS dedup_key FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts, event_id) AS r FROM ({_KEYED})) WHERE r = 1")
def dedup_first_wins(spark, d):
    return dedup.first_wins(_keyed(spark, d), ["dedup_key"], ["ts", "event_id"]).select("event_id", "dedup_key")


@register(f"WITH e AS ({_KEYED}) SELECT event_id FROM e WHERE event_id % 2 = 1 AND k NOT IN (SELECT k FROM e WHERE event_id % 2 = 0 AND ts + INTERVAL 240 HOUR > TIMESTAMP '2024-01-25')")
def dedup_ttl_anti_join(spark, d):
    rows = _keyed(spark, d)
    seen = rows.where("event_id % 2 = 0").select("dedup_key", (F.col("ts").cast("timestamp") + F.expr("interval 240 hours")).alias("expires_at"))
    return dedup.unseen(rows.where("event_id % 2 = 1"), seen, datetime(2024, 1, 25)).select("event_id")


def _gap_sql(minutes: int) -> str:
    return f"""WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > {minutes * 60_000_000} THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    c AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g) """


@register(_gap_sql(30) + "SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS alerts FROM c GROUP BY user_id, session")
def cluster_by_user_30m(spark, d):
    rows = cluster.sessions(table(spark, d, "events"), ["user_id"], 30, "ts", "event_id")
    return rows.groupBy("user_id", "session").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("alerts")).drop("session")


@register(_gap_sql(30) + "SELECT 'replay:' || event_id AS id, 'replay:' || first_value(event_id) OVER (PARTITION BY user_id, session ORDER BY ts, 'replay:' || event_id) AS cluster FROM c")
def cluster_greedy(spark, d):
    a = alerts(spark, d)
    return cluster.cluster(a.select("id", "event_ts", F.array(F.concat(F.lit("user:"), "user")).alias("entities")))


#: The rule as it is stated, a row at a time: it joins the newest group that is near, not full and shares an entity.
_GREEDY_SQL = """WITH RECURSIVE e AS MATERIALIZED (
        SELECT 'replay:' || event_id AS id, ts, ['user:' || user_id, 'host:host-' || (event_id % 997)] AS names, row_number() OVER (ORDER BY ts, 'replay:' || event_id) AS k FROM events
    ), s AS (
        SELECT 0::BIGINT AS k, NULL::VARCHAR AS id, NULL::VARCHAR AS cluster, []::STRUCT(made BIGINT, n INT, last TIMESTAMP, names VARCHAR[], own VARCHAR)[] AS g
        UNION ALL
        SELECT e.k, e.id, coalesce(j.hit.own, e.id),
               CASE WHEN j.hit IS NULL THEN list_append(j.live, {'made': e.k, 'n': 1, 'last': e.ts, 'names': e.names, 'own': e.id})
                    ELSE list_transform(j.live, lambda x: CASE WHEN x.made = j.hit.made THEN {'made': x.made, 'n': x.n + 1, 'last': e.ts, 'names': list_distinct(list_concat(x.names, e.names)), 'own': x.own} ELSE x END) END
        FROM s JOIN e ON e.k = s.k + 1,
        LATERAL (SELECT live, list_filter(live, lambda x: list_has_any(x.names, e.names))[-1] AS hit FROM (SELECT list_filter(s.g, lambda x: x.n < 50 AND x.last >= e.ts - INTERVAL 30 MINUTE) AS live)) j
    ) """


@register(_GREEDY_SQL + "SELECT id, cluster FROM s WHERE k > 0")
def cluster_multi_entity(spark, d):
    a = alerts(spark, d)
    host = F.concat(F.lit("host-"), F.col("event_id") % 997)
    return cluster.cluster(a.select("id", "event_ts", F.array(F.concat(F.lit("user:"), "user"), F.concat(F.lit("host:"), host)).alias("entities")))


@register(_gap_sql(120) + "SELECT user_id, count(*) AS alerts, max(value) AS worst FROM c GROUP BY user_id, session")
def incident_by_user_120m(spark, d):
    rows = cluster.sessions(table(spark, d, "events"), ["user_id"], 120, "ts", "event_id")
    return rows.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("alerts"), F.max("value").alias("worst")).drop("session")


_CANDIDATE_SQL = _gap_sql(30) + f""", a AS (SELECT *, 'replay:' || event_id AS id, {SEVERITY_SQL} AS severity FROM c),
    f AS (SELECT user_id, session, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS alert_count, string_agg(id, ':' ORDER BY id) AS ids, arg_min(id, (ts, id)) AS first_id,
          max(CASE severity WHEN 'critical' THEN 8 WHEN 'high' THEN 6 WHEN 'medium' THEN 4 WHEN 'low' THEN 2 WHEN 'info' THEN 1 ELSE 3 END) AS best, count(DISTINCT event_type) AS detections FROM a GROUP BY 1, 2),
    n AS (SELECT *, 'CAND-' || strftime(first_seen, '%Y%m%d') || '-' || CASE WHEN r < 1000 THEN lpad(r::VARCHAR, 3, '0') ELSE r::VARCHAR END || '-' || substr(sha256(ids), 1, 10) AS candidate_id,
          least(10, best + CASE WHEN detections >= 3 THEN 1 ELSE 0 END + 1)::INT AS score FROM (SELECT *, row_number() OVER (ORDER BY first_seen, first_id) AS r FROM f)) """


def _candidates(spark, d):
    a = alerts(spark, d).select("*", *(F.lit(None).cast("string").alias(c) for c in ("hostname", "src_ip", "dst_ip")))
    clusters = cluster.sessions(a, ["user"], 30).select("id", F.concat_ws("/", "user", "session").alias("cluster"))
    return cluster.candidates(a, clusters), a, clusters


@register(_CANDIDATE_SQL + "SELECT candidate_id, user_id::VARCHAR AS primary_user, alert_count, first_seen, last_seen FROM n")
def candidate_ids(spark, d):
    return _candidates(spark, d)[0].select("candidate_id", "primary_user", "alert_count", "first_seen", "last_seen")


@register(_CANDIDATE_SQL + "SELECT candidate_id, score, CASE WHEN score >= 8 THEN 'page_now' WHEN score >= 4 THEN 'queue_review' ELSE 'mark_likely_benign' END AS action FROM n")
def candidate_score(spark, d):
    return triage.score_candidates(*_candidates(spark, d)).select("candidate_id", "score", "action")


def _incidents(spark, d):
    return cluster.incidents(cluster.promoted(triage.score_candidates(*_candidates(spark, d))))


_INCIDENT_SQL = _CANDIDATE_SQL + """, q AS (SELECT *, CASE WHEN epoch_us(first_seen) > max(epoch_us(last_seen)) OVER (PARTITION BY user_id ORDER BY first_seen, candidate_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 7200000000 THEN 1 ELSE 0 END AS apart FROM n WHERE score >= 8),
    i AS (SELECT *, sum(apart) OVER (PARTITION BY user_id ORDER BY first_seen, candidate_id) AS part FROM q),
    inc AS (SELECT user_id::VARCHAR AS primary_user, count(*) AS candidates, max(score) AS max_score, sum(alert_count)::BIGINT AS alert_count, min(first_seen) AS first_seen, max(last_seen) AS last_seen FROM i GROUP BY user_id, part) """


@register(_INCIDENT_SQL + "SELECT * FROM inc")
def incident_promotion(spark, d):
    return _incidents(spark, d).select("primary_user", F.size("candidate_ids").cast("bigint").alias("candidates"), "max_score", "alert_count", "first_seen", "last_seen")


@register(_INCIDENT_SQL + "SELECT primary_user, count(*) AS incidents, max(max_score) AS worst_score, primary_user AS users, max(last_seen) AS last_activity FROM inc GROUP BY 1")
def repeated_entities(spark, d):
    return queries.repeated_entities(_incidents(spark, d).withColumn("u", F.col("primary_user")), "primary_user", "u")


@register(_INCIDENT_SQL + "SELECT primary_user AS primary_host, count(*) AS incidents, sum(alert_count)::BIGINT AS alerts FROM inc GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def incidents_by_host(spark, d):
    return queries.incidents_by_host(_incidents(spark, d).drop("primary_host").withColumnRenamed("primary_user", "primary_host"))


_ALNUM = "[A-Za-z0-9]"
_IP_SQL = r"regexp_extract_all(text, '\b(?:\d{1,3}\.){3}\d{1,3}\b')"
_VALID_SQL = r"regexp_full_match(v, '(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}')"
_SUFFIXES = "|".join(ioc.FILE_SUFFIXES)
_IOC_SQL = rf"""
    WITH x AS (
        SELECT doc_id, 'url' AS type, regexp_replace(unnest(regexp_extract_all(text, '(?i)\bhttps?://[^\s"''<>]+')), '[.,;)]+$', '') AS value FROM documents
        UNION ALL SELECT doc_id, 'email', regexp_replace(unnest(regexp_extract_all(text, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{{2,}}\b')), '[.,;)]+$', '') FROM documents
        UNION ALL SELECT doc_id, 'ip', v FROM (SELECT doc_id, unnest({_IP_SQL}) AS v FROM documents) WHERE {_VALID_SQL}
        UNION ALL SELECT doc_id, 'hash', lower(unnest(regexp_extract_all(text, '\b(?:[a-fA-F0-9]{{64}}|[a-fA-F0-9]{{40}}|[a-fA-F0-9]{{32}})\b'))) FROM documents
        UNION ALL SELECT doc_id, 'domain', v FROM (SELECT doc_id, lower(regexp_replace(unnest(regexp_extract_all(text, '\b(?:{_ALNUM}(?:[a-zA-Z0-9-]{{0,61}}{_ALNUM})?\.)+[A-Za-z]{{2,63}}\b')), '[.,;)]+$', '')) AS v FROM documents) WHERE NOT regexp_matches(v, '\.({_SUFFIXES})$')
    ), i AS (SELECT doc_id, type, lower(value) AS value FROM x GROUP BY ALL) """


def _doc_iocs(spark, d):
    docs = table(spark, d, "documents").select("doc_id", ioc.from_text(F.col("text")).alias("indicators"))
    return docs.select("doc_id", F.explode("indicators").alias("i")).select("doc_id", "i.type", F.lower("i.value").alias("value"))


@register(_IOC_SQL + "SELECT * FROM i")
def ioc_extract(spark, d):
    return _doc_iocs(spark, d)


@register(_IOC_SQL + "SELECT type, count(*) AS n, count(DISTINCT value) AS distinct_values FROM i GROUP BY 1")
def ioc_counts_by_type(spark, d):
    return _doc_iocs(spark, d).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("value").alias("distinct_values"))


@register(_IOC_SQL + "SELECT type, string_agg(value, ',' ORDER BY value) AS \"values\" FROM (SELECT DISTINCT type, value FROM i) GROUP BY 1")
def ioc_table(spark, d):
    return queries.ioc_table(_doc_iocs(spark, d))


@register(_IOC_SQL + "SELECT value AS address, count(*) AS mentions, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id::VARCHAR) AS targets FROM i WHERE type = 'ip' GROUP BY 1 HAVING count(*) > 1")
def repeated_addresses(spark, d):
    rows = _doc_iocs(spark, d).where("type = 'ip'").select("doc_id", "value", F.lit(1).alias("score"))
    return queries.repeated_addresses(rows, "value", "doc_id").drop("worst_score")


def _in_sql(blocks) -> str:
    return "(" + " OR ".join(f"n BETWEEN {a} AND {b}" for a, b in map(net._range, blocks)) + ")"


_PRIVATE_SQL = f"({_in_sql(net.PRIVATE)} AND NOT {_in_sql(net.NOT_PRIVATE)})"
_CLASS_SQL = _IOC_SQL + ", c AS (SELECT DISTINCT value AS ip, list_reduce(list_transform(string_split(value, '.'), lambda o: o::BIGINT), lambda a, o: a * 256 + o) AS n FROM i WHERE type = 'ip') "


@register(_CLASS_SQL + f"SELECT ip, {_PRIVATE_SQL} AS is_private, NOT {_PRIVATE_SQL} AND NOT {_in_sql(net.SHARED)} AS is_global, {_in_sql(net.LOOPBACK)} AS is_loopback, {_in_sql(net.LINK_LOCAL)} AS is_link_local, {_in_sql(net.MULTICAST)} AS is_multicast, {_in_sql(net.RESERVED)} AS is_reserved, n = 0 AS is_unspecified FROM c")
def ip_classification(spark, d):
    ips = _doc_iocs(spark, d).where("type = 'ip'").select(F.col("value").alias("ip")).distinct()
    return ips.withColumn("c", net.classify(F.col("ip"))).select("ip", "c.is_private", "c.is_global", "c.is_loopback", "c.is_link_local", "c.is_multicast", "c.is_reserved", "c.is_unspecified")


@register(_CLASS_SQL + f"SELECT ip FROM c WHERE NOT {_PRIVATE_SQL} AND NOT {_in_sql(net.SHARED)}")
def global_ip_filter(spark, d):
    ips = _doc_iocs(spark, d).where("type = 'ip'").select(F.col("value").alias("ip")).distinct()
    return ips.where(net.is_global(F.col("ip")))


@register(r"SELECT page_id, concat_ws(',', CASE WHEN regexp_matches(lower(url), 'https?://(?:\d{1,3}\.){3}\d{1,3}') THEN 'url_with_ip' END, CASE WHEN starts_with(lower(url), 'http://') THEN 'cleartext_http' END, CASE WHEN regexp_matches(lower(url), '/login|/signin|/wp-admin|/admin') THEN 'credential_page_path' END) AS factors FROM pages")
def url_risk(spark, d):
    return table(spark, d, "pages").select("page_id", F.array_join(ioc.url_factors(F.col("url")), ",").alias("factors"))


_HOST_SQL = r"SELECT page_id, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS host FROM pages"


def _hosts(spark, d):
    return table(spark, d, "pages").select("page_id", F.lower(F.regexp_extract("url", r"^https?://([^/:?#]+)", 1)).alias("host"))


@register(f"SELECT host, count(*) AS pages, string_split(host, '.')[-1] IN ({', '.join(repr(t) for t in ioc.SUSPICIOUS_TLDS)}) AS suspicious, length(host) > 60 AS long FROM ({_HOST_SQL}) GROUP BY host")
def domain_risk(spark, d):
    factors = F.col("factors")
    rows = _hosts(spark, d).groupBy("host").agg(F.count(F.lit(1)).alias("pages")).withColumn("factors", ioc.domain_factors(F.col("host")))
    return rows.select("host", "pages", F.array_contains(factors, "suspicious_tld").alias("suspicious"), F.array_contains(factors, "long_domain").alias("long"))


@register(_IOC_SQL + "SELECT doc_id, value, CASE length(value) WHEN 32 THEN 'md5' WHEN 40 THEN 'sha1' WHEN 64 THEN 'sha256' ELSE 'unknown' END AS kind FROM i WHERE type = 'hash'")
def hash_type(spark, d):
    return _doc_iocs(spark, d).where("type = 'hash'").select("doc_id", "value", ioc.hash_type(F.col("value")).alias("kind"))


@register(_IOC_SQL + """SELECT doc_id, type, value, CASE type WHEN 'ip' THEN 0.95 ELSE 0.85 END AS confidence, 'enrich-' || substr(sha256(doc_id || ':' || type || ':' || value), 1, 12) AS enrichment_id FROM i""")
def enrichment_rows(spark, d):
    found = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), ioc.from_text(F.col("text")).alias("indicators"))
    rows = triage.enriched(found)
    return rows.select(F.col("target_id").cast("bigint").alias("doc_id"), "type", F.lower("value").alias("value"), F.col("confidence").cast("double").alias("confidence"), "enrichment_id")


@register(f"WITH h AS ({_HOST_SQL}), k AS (SELECT page_id, host, split_part(host, '.', 1) AS label FROM h), a AS (SELECT DISTINCT host AS name, CASE WHEN host LIKE '%.org' THEN 'critical' ELSE 'low' END AS criticality FROM h WHERE page_id % 2 = 0), s AS (SELECT split_part(name, '.', 1) AS label, arg_min(criticality, name) AS criticality FROM a GROUP BY 1) SELECT page_id, coalesce(a.criticality, s.criticality) AS asset_criticality FROM k LEFT JOIN a ON a.name = k.host LEFT JOIN s ON s.label = k.label")
def short_name_asset_join(spark, d):
    hosts = _hosts(spark, d)
    level = F.when(F.col("host").like("%.org"), "critical").otherwise("low")
    assets = hosts.where("page_id % 2 = 0").select("host").distinct().select(F.col("host").alias("hostname"), F.lit(None).cast("string").alias("ip"), level.alias("criticality"), F.col("host").alias("row"))
    return triage.with_assets(hosts, assets, "host", F.lit(None).cast("string"), ("criticality",)).select("page_id", "asset_criticality")


@register("SELECT l_orderkey, l_linenumber, o_orderstatus, p_brand, c_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey")
def recover_raw_events(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.select("l_orderkey", "l_linenumber", "o_orderstatus", "p_brand", "c_name")


@register(SCORED_SQL + "SELECT id, ts AS queued_at FROM t WHERE action = 'queue_review' ORDER BY ts, id LIMIT 50")
def queue_open_oldest(spark, d):
    queue = scored(spark, d).where("action = 'queue_review'").select("id", F.col("event_ts").alias("queued_at"), F.lit("open").alias("status"))
    return queries.open_queue(queue, 50).select("id", "queued_at")


_EVAL_SQL = """WITH c AS (SELECT doc_id, CASE WHEN quality = 0 OR toxic = 1 THEN 7 ELSE 1 END AS score_min, CASE WHEN quality = 0 OR toxic = 1 THEN 10 ELSE 3 END AS score_max, CASE WHEN quality = 0 OR toxic = 1 THEN 'page_now' ELSE 'mark_likely_benign' END AS expected,
    (1 + n_chars % 10)::INT AS score FROM labels JOIN documents USING (doc_id)), e AS (SELECT *, CASE WHEN score >= 8 THEN 'page_now' WHEN score >= 4 THEN 'queue_review' ELSE 'mark_likely_benign' END AS action, greatest(score_min - score, score - score_max, 0) AS band_error FROM c) """


def _cases(spark, d):
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    score = (1 + F.col("n_chars") % 10).cast("int")
    rows = rows.select("doc_id", F.col("doc_id").cast("string").alias("case_id"), F.when(bad, 7).otherwise(1).alias("score_min"), F.when(bad, 10).otherwise(3).alias("score_max"), F.array(F.when(bad, "page_now").otherwise("mark_likely_benign")).alias("expected_actions"), score.alias("score"), scoring.action(score).alias("action"))
    return triage.evaluated(rows)


@register(_EVAL_SQL + "SELECT count(*) AS cases, round(avg((action = expected)::INT), 4) AS action_agreement, round(avg((score BETWEEN score_min AND score_max)::INT), 4) AS in_band_rate, round(avg(band_error), 4) AS mean_score_error, round(avg((action = 'mark_likely_benign')::INT) FILTER (score_max <= 3), 4) AS benign_caught, count(*) FILTER (score_min >= 7 AND score <= 3) AS missed, count(*) FILTER (score_max <= 3 AND score >= 8) AS noise FROM e")
def evaluation_summary(spark, d):
    return triage.evaluation_summary(_cases(spark, d))


@register(_EVAL_SQL + "SELECT expected, action AS actual, count(*) AS n FROM e GROUP BY 1, 2")
def confusion_matrix(spark, d):
    return _cases(spark, d).groupBy(F.col("expected_actions")[0].alias("expected"), F.col("action").alias("actual")).agg(F.count(F.lit(1)).alias("n"))


@register(_EVAL_SQL + "SELECT doc_id, score_min >= 7 AND score <= 3 AS missed, score_max <= 3 AND score >= 8 AS noise FROM e WHERE (score_min >= 7 AND score <= 3) OR (score_max <= 3 AND score >= 8)")
def failure_modes(spark, d):
    return _cases(spark, d).where("missed or noise").select("doc_id", "missed", "noise")


@register(_EVAL_SQL + "SELECT doc_id, band_error::INT AS band_error FROM e")
def band_error(spark, d):
    return _cases(spark, d).select("doc_id", "band_error")


@register(_EVAL_SQL + "SELECT 'missed true positives ' || count(*) FILTER (score_min >= 7 AND score <= 3) AS unmet FROM e HAVING count(*) FILTER (score_min >= 7 AND score <= 3) > 0 UNION ALL SELECT 'benign caught ' || round(avg((action = 'mark_likely_benign')::INT) FILTER (score_max <= 3), 4) FROM e HAVING round(avg((action = 'mark_likely_benign')::INT) FILTER (score_max <= 3), 4) < 0.6 UNION ALL SELECT 'action agreement ' || round(avg((action = expected)::INT), 4) FROM e HAVING round(avg((action = expected)::INT), 4) < 0.7")
def threshold_check(spark, d):
    return triage.failures(triage.evaluation_summary(_cases(spark, d)))


@register("WITH x AS (SELECT doc_id, 1 + doc_id % 10 AS s, CASE WHEN quality = 0 THEN 'too_low' WHEN toxic = 1 THEN 'too_high' ELSE 'agree' END AS verdict, CASE WHEN doc_id % 4 = 0 THEN 1 + doc_id % 7 END AS a FROM labels), b AS (SELECT doc_id, greatest(1, least(10, CASE WHEN a IS NOT NULL THEN a - 1 WHEN verdict = 'too_high' THEN 1 WHEN verdict = 'too_low' THEN s + 1 ELSE s - 1 END)) AS lo, greatest(1, least(10, CASE WHEN a IS NOT NULL THEN a + 1 WHEN verdict = 'too_high' THEN s - 1 WHEN verdict = 'too_low' THEN 10 ELSE s + 1 END)) AS hi FROM x) SELECT doc_id, least(lo, hi)::INT AS band_low, greatest(lo, hi)::INT AS band_high FROM b")
def verdict_to_band(spark, d):
    verdict = F.when(F.col("quality") == 0, "too_low").when(F.col("toxic") == 1, "too_high").otherwise("agree")
    low, high = triage.verdict_band(verdict, 1 + F.col("doc_id") % 10, F.when(F.col("doc_id") % 4 == 0, 1 + F.col("doc_id") % 7))
    return table(spark, d, "labels").select("doc_id", low.alias("band_low"), high.alias("band_high"))


@register("SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice * 100000 >= 5000000000 THEN 2 WHEN l_extendedprice * 100000 >= 500000000 THEN 1 ELSE 0 END AS boost FROM lineitem")
def volume_boost(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", scoring.volume_boost(F.col("l_extendedprice") * 100000).alias("boost"))


@register(f"SELECT event_id, CASE WHEN json_extract_string(props, '$.k')::BIGINT * 25 >= 1000 AND {SEVERITY_SQL} NOT IN ('high', 'critical') THEN -1 ELSE 0 END AS damping FROM events")
def frequency_damping(spark, d):
    a = alerts(spark, d)
    return a.select("event_id", scoring.frequency_damping(paths.first_int(F.parse_json("payload_json"), ["k"]) * 25, F.col("severity")).alias("damping"))


@register("SELECT s_suppkey, least(3, CASE WHEN c > 0 AND s_acctbal > 0 THEN c + 1 ELSE c END)::INT AS boost FROM (SELECT *, CASE s_nationkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS c FROM supplier)")
def asset_boost(spark, d):
    level = F.when(F.col("s_nationkey") % 3 == 0, "critical").when(F.col("s_nationkey") % 3 == 1, "high").otherwise("medium")
    return table(spark, d, "supplier").select("s_suppkey", scoring.asset_boost(level, F.col("s_acctbal") > 0).alias("boost"))


@register("WITH e AS (SELECT *, '10.0.' || user_id % 50 || '.' || event_id % 5 AS src_ip, 'host-' || event_id % 40 AS hostname FROM events), r AS (SELECT * FROM e WHERE hostname = 'host-7') SELECT count(*) AS alerts, string_agg(DISTINCT hostname, ',') AS hosts, (SELECT string_agg(u, ',' ORDER BY u) FROM (SELECT DISTINCT user_id::VARCHAR AS u FROM r)) AS accounts, (SELECT string_agg(u, ',' ORDER BY u) FROM (SELECT DISTINCT src_ip AS u FROM r)) AS peers FROM r")
def blast_radius(spark, d):
    a = alerts(spark, d).withColumn("src_ip", F.concat_ws(".", F.lit("10.0"), F.col("user").cast("bigint") % 50, F.col("event_id") % 5)).withColumn("dst_ip", F.lit(None).cast("string")).withColumn("hostname", F.concat(F.lit("host-"), F.col("event_id") % 40))
    return queries.blast_radius(a, "HOST-7")


_BOOKS = (("block-source", "pf_block_ip", 9, ("page_now",)), ("deny-host", "wazuh_host_deny", 8, ("page_now",)), ("drop-all", "wazuh_firewall_drop", 4, ()))


@register(SCORED_SQL + """, b(name, response, need, on_action) AS (VALUES ('block-source', 'pf_block_ip', 9, 'page_now'), ('deny-host', 'wazuh_host_deny', 8, 'page_now'), ('drop-all', 'wazuh_firewall_drop', 4, NULL)),
    p AS (SELECT id, name, response, score, need, CASE WHEN event_id % 2 = 0 THEN 'llm' ELSE 'local' END AS src FROM t JOIN b ON on_action IS NULL OR on_action = action)
    SELECT name, CASE WHEN response = 'wazuh_firewall_drop' THEN 'capability' WHEN src != 'llm' THEN 'not model' WHEN score < need THEN 'confidence' WHEN response = 'pf_block_ip' THEN 'address' ELSE 'ok' END AS gate, count(*) AS n FROM p GROUP BY 1, 2""")
def response_gate(spark, d):
    books = spark.createDataFrame([(n, a, c, list(t), True) for n, a, c, t in _BOOKS], "name string, action string, required_confidence int, trigger_actions array<string>, enabled boolean")
    rows = scored(spark, d).withColumn("analysis_source", F.when(F.col("event_id") % 2 == 0, "llm").otherwise("local")).withColumn("target", F.lit("192.168.0.1"))
    out = triage.proposals(rows, books, ("pf_block_ip", "wazuh_host_deny"))
    r = F.col("denial_reason")
    gate = F.when(r.startswith("response capability"), "capability").when(r.startswith("triage score was not"), "not model").when(r.startswith("score "), "confidence").when(r.startswith("target "), "address").otherwise("ok")
    return out.groupBy("name", gate.alias("gate")).agg(F.count(F.lit(1)).alias("n"))


@register(SCORED_SQL + "SELECT shard, batch, count(*) AS events, min(event_id) AS first_event FROM (SELECT event_id, event_type AS shard, ((row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 100)::BIGINT AS batch FROM t) GROUP BY 1, 2")
def hec_batches(spark, d):
    rows = scored(spark, d)
    out = sinks.hec_batches(rows, sinks.TRIAGE_FIELDS, "event_ts", ["event_id"], 100, F.col("rule_name"))
    return out.groupBy("shard", "batch").agg(F.count(F.lit(1)).alias("events"), F.min("event_id").alias("first_event"))


@register("SELECT batch, count(*) AS events, min(event_id) AS first_event, max(event_id) AS last_event FROM (SELECT event_id, ((row_number() OVER (ORDER BY ts, event_id) - 1) // 100)::BIGINT AS batch FROM events) GROUP BY batch")
def hec_batches_unsharded(spark, d):
    out = sinks.hec_batches(scored(spark, d), sinks.TRIAGE_FIELDS, "event_ts", ["event_ts", "event_id"], 100)
    return out.groupBy("batch").agg(F.count(F.lit(1)).alias("events"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))


@register("SELECT user_id::VARCHAR AS user, 'replay:' || event_id AS id, r::INT AS position, greatest(n - 12, 0)::BIGINT AS further FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, 'replay:' || event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE r <= 12")
def timeline_head(spark, d):
    return queries.timeline(alerts(spark, d), "user").select("user", "id", "position", "further")


@register("SELECT 'events' AS \"table\", count(*) AS n FROM events UNION ALL SELECT 'labels', count(*) FROM labels UNION ALL SELECT 'pages', count(*) FROM pages")
def table_counts(spark, d):
    return queries.table_counts({n: table(spark, d, n) for n in ("events", "labels", "pages")})


@register("SELECT user_id, event_type AS last_type, value AS last_value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def latest_version(spark, d):
    log = table(spark, d, "events").select("user_id", F.col("event_type").alias("last_type"), F.col("value").alias("last_value"), F.col("event_id").alias("_version"))
    return sinks.latest(log, "user_id")


@register("SELECT user_id, event_id AS last_event, event_type AS last_type, value AS last_value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY hour(ts) // 8 DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def keyed_store(spark, d):
    """The events of each third of the day as a batch of the keyed store, the second batch twice: a later batch stands for an earlier one, a replay changes nothing."""
    e = table(spark, d, "events").select("user_id", F.col("event_id").alias("last_event"), F.col("event_type").alias("last_type"), F.col("value").alias("last_value"), F.floor(F.hour("ts") / 8).alias("third"))
    store = KeyedStore(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", "user_id", e.drop("third").schema, buckets=16)
    for batch in (0, 1, 1, 2):
        store.apply(e.where(F.col("third") == batch).drop("third"), batch, sequence=F.col("last_event"))
    return store.read()


@register("SELECT c_custkey, coalesce(o, 0)::BIGINT AS orders, c_mktsegment AS segment FROM (SELECT c_custkey, c_mktsegment FROM customer) LEFT JOIN (SELECT o_custkey, count(*) AS o FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def selective_upsert(spark, d):
    old = table(spark, d, "customer").select("c_custkey", F.lit(0).cast("bigint").alias("orders"), F.col("c_mktsegment").alias("segment"))
    new = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("orders")).withColumn("segment", F.lit("changed"))
    return sinks.merged(old, new, "c_custkey", ["orders"])


@register("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def insert_if_absent(spark, d):
    return sinks.absent(table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@register(SCORED_SQL + "SELECT coalesce(event_type, 'local') AS model, count(*) AS n, count(*) > 0 AND bool_and(score >= 1) AS all_scored FROM t GROUP BY 1")
def provenance_counts(spark, d):
    return scored(spark, d).groupBy(F.coalesce("rule_name", F.lit("local")).alias("model")).agg(F.count(F.lit(1)).alias("n"), ((F.count(F.lit(1)) > 0) & F.bool_and(F.col("score") >= 1)).alias("all_scored"))


@register("SELECT event_id, CASE WHEN m < 60 THEN m || 'm' WHEN m < 1440 THEN m // 60 || 'h' ELSE m // 1440 || 'd' END AS age FROM (SELECT event_id, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) // 60000000 AS m FROM events)")
def queue_age(spark, d):
    seconds = F.unix_micros(F.lit(datetime(2024, 2, 1)).cast("timestamp")) / 1_000_000 - F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000
    return table(spark, d, "events").select("event_id", scoring.age(F.floor(seconds)).alias("age"))


@register("SELECT user_id, count(DISTINCT event_type) AS kinds, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types, (SELECT arg_min(event_type, (-n, event_type)) FROM (SELECT event_type, count(*) AS n FROM events e WHERE e.user_id = o.user_id GROUP BY 1)) AS usual FROM events o GROUP BY 1")
def entity_profile(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.countDistinct("event_type").alias("kinds"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("types"), F.expr("mode() WITHIN GROUP (ORDER BY event_type)").alias("usual"))


@register("""WITH m AS (SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events), p AS (SELECT event_id, k, 1 + k % 10 AS score FROM m WHERE k % 4 != 0)
    SELECT event_id, 10 * score AS s, CASE WHEN k % 4 = 1 THEN 'page_now' WHEN k % 4 = 2 THEN 'mark_likely_benign' WHEN score >= 8 THEN 'page_now' WHEN score >= 4 THEN 'queue_review' ELSE 'mark_likely_benign' END AS action,
    CASE WHEN k % 4 = 1 THEN 'medium' ELSE 'unknown' END AS fp_likelihood, CASE WHEN k % 4 = 2 THEN 'beacon' WHEN score >= 8 THEN 'likely_true_positive_high_priority' WHEN score >= 4 THEN 'needs_analyst_review' ELSE 'likely_false_positive_or_low_priority' END AS classification FROM p""")
def model_response_parse(spark, d):
    k = paths.first_int(F.parse_json("props"), ["k"])
    fenced = F.concat(F.lit('```json\n{"score": '), 1 + k % 10, F.lit(', "action": "Urgent", "fp_likelihood": "Medium"}\n```'))
    plain = F.concat(F.lit('{"score": '), 1 + k % 10, F.lit(', "action": "likely_benign", "classification": " beacon "}'))
    text = F.when(k % 4 == 0, "no json here").when(k % 4 == 1, fenced).when(k % 4 == 2, plain).otherwise(F.concat(F.lit('{"score": '), 1 + k % 10, F.lit(', "action": "escalate", "fp_likelihood": "none"}')))
    recorded = table(spark, d, "events").select(F.col("event_id").alias("target_id"), text.alias("response"))
    return triage.parsed_responses(recorded).where("score is not null").select(F.col("target_id").alias("event_id"), (F.col("score") * 10).alias("s"), "action", "fp_likelihood", "classification")


_QUEUED_SQL = SCORED_SQL + """, v AS (SELECT event_id, id, ts, score, action, CASE event_id % 3 WHEN 0 THEN 'agree' WHEN 1 THEN 'too_high' ELSE 'too_low' END AS verdict, CASE WHEN event_id % 4 = 0 THEN 1 + event_id % 10 END AS analyst_score, ts + INTERVAL 1 HOUR AS reviewed_at FROM t WHERE action = 'queue_review' AND event_id % 2 = 0) """


def _reviewed(spark, d):
    rows = scored(spark, d).where("action = 'queue_review'")
    queue = rows.select(F.col("id").alias("triage_result_id"), F.col("id").alias("target_id"), F.lit("alert").alias("target_type"), "score", "action", "analysis_source", F.col("event_ts").alias("queued_at"), "event_id")
    n = F.col("event_id")
    said = queue.where(n % 2 == 0).select("triage_result_id", F.when(n % 3 == 0, "agree").when(n % 3 == 1, "too_high").otherwise("too_low").alias("verdict"), F.when(n % 4 == 0, 1 + n % 10).cast("int").alias("analyst_score"), F.lit(None).cast("string").alias("notes"), (F.col("queued_at") + F.expr("interval 1 hour")).alias("reviewed_at"))
    return review.with_verdicts(queue.drop("event_id"), said)


@register(_QUEUED_SQL + "SELECT id, verdict, analyst_score::INT AS analyst_score FROM v ORDER BY reviewed_at DESC, id LIMIT 50")
def reviewed_newest(spark, d):
    return review.reviewed(_reviewed(spark, d), 50).select(F.col("triage_result_id").alias("id"), F.col("analyst_verdict").alias("verdict"), "analyst_score")


@register(_QUEUED_SQL + """, b AS (SELECT id, CASE WHEN analyst_score IS NOT NULL THEN greatest(1, analyst_score - 1) WHEN verdict = 'too_high' THEN 1 WHEN verdict = 'too_low' THEN least(10, score + 1) ELSE greatest(1, score - 1) END AS lo,
    CASE WHEN analyst_score IS NOT NULL THEN least(10, analyst_score + 1) WHEN verdict = 'too_high' THEN greatest(1, score - 1) WHEN verdict = 'too_low' THEN 10 ELSE least(10, score + 1) END AS hi FROM v),
    c AS (SELECT *, CASE WHEN lo >= 8 THEN 'page_now' WHEN lo >= 4 THEN 'queue_review' ELSE 'mark_likely_benign' END AS a, CASE WHEN hi >= 8 THEN 'page_now' WHEN hi >= 4 THEN 'queue_review' ELSE 'mark_likely_benign' END AS z FROM b)
    SELECT 'review-' || replace(id, ':', '-') AS case_id, lo::INT AS score_min, hi::INT AS score_max, CASE WHEN a = z THEN a WHEN a < z THEN a || ',' || z ELSE z || ',' || a END AS actions FROM c""")
def reviews_to_labels(spark, d):
    raw = alerts(spark, d).select(F.col("id").alias("target_id"), "id", "source", "event_ts", "payload_json")
    cases, _ = review.labels(_reviewed(spark, d), raw)
    return cases.select("case_id", "score_min", "score_max", F.array_join("expected_actions", ",").alias("actions"))


@register(f"""WITH a AS (SELECT user_id, event_id, ts, event_type, {SEVERITY_SQL} AS severity FROM events), g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > 1800000000 THEN 1 ELSE 0 END AS new FROM a WINDOW w AS (PARTITION BY user_id ORDER BY ts, 'replay:' || event_id)),
    c AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, 'replay:' || event_id) AS part, count(*) OVER (PARTITION BY user_id) AS n FROM g),
    f AS (SELECT user_id, part, any_value(n) AS n, max(CASE severity WHEN 'critical' THEN 8 WHEN 'high' THEN 6 WHEN 'medium' THEN 4 WHEN 'low' THEN 2 WHEN 'info' THEN 1 ELSE 3 END) + CASE WHEN any_value(n) > 1 THEN 1 + CASE WHEN count(DISTINCT lower(trim(event_type))) >= 3 THEN 1 ELSE 0 END ELSE 0 END AS s FROM c GROUP BY 1, 2)
    SELECT user_id::VARCHAR AS case_id, least(10, max(s))::INT AS score, count(*) AS candidates_scored FROM f GROUP BY 1""")
def case_scores(spark, d):
    a = alerts(spark, d)
    rows = a.select("*", F.col("user").alias("case_id"), *(F.lit(None).cast("string").alias(c) for c in ("hostname", "src_ip", "dst_ip", "command_line", "process_name")))
    return evaluate.case_scores(rows, enrich=None, cap=1_000_000).select("case_id", "score", "candidates_scored")


@register("SELECT event_id FROM (SELECT event_id, " + SEVERITY_SQL + " AS s FROM events) WHERE s IN ('high', 'critical')")
def high_only(spark, d):
    return queries.high_only(alerts(spark, d)).select("event_id")


@register("SELECT o_custkey AS target, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS providers, max(o_orderdate) AS looked_up_at FROM orders GROUP BY 1")
def enrichment_provenance(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("target_id"), F.col("o_orderpriority").alias("provider"), F.col("o_orderdate").alias("looked_up_at"))
    return triage.provenance(rows).select(F.col("target_id").alias("target"), F.array_join("enrichment_providers", ",").alias("providers"), F.col("enrichment_looked_up_at").alias("looked_up_at"))


def _telemetry(spark, d):
    """Events as raw events of four sources, by event type, with the payload that each source sends."""
    k, own, user = F.get_json_object("props", "$.k").cast("int"), F.col("event_id").cast("string"), F.col("user_id").cast("string")
    ip = F.concat(F.lit("10.0.0."), F.col("user_id") % 250)
    said = lambda **fields: F.struct(*(v.alias(n) for n, v in fields.items()))
    wazuh = said(id=own, rule=said(level=k % 15, description=F.concat(F.lit("rule "), k), groups=F.array(F.lit("auth"), F.lit(" "), F.lit("ssh"))), agent=said(id=user, name=F.concat(F.lit("ws-"), user)), data=said(srcip=ip, dstuser=F.concat(F.lit(" u"), user)))
    onion = said(event=said(id=own, severity=k % 5, category=F.lit("network")), source=said(ip=ip), host=said(name=F.concat(F.lit("so-"), user)), message=F.lit("beacon"))
    firewall = said(id=own, action=F.when(k < 50, "BLOCK").otherwise("pass"), direction=F.lit("in"), interface=F.lit("em0"), src_ip=ip, firewall_hostname=F.lit("fw"))
    plain = said(severity=k, message=F.col("event_type"), user=user, tags=F.lit("one"))
    source = F.expr("CASE event_type WHEN 'error' THEN 'wazuh' WHEN 'view' THEN 'security_onion' WHEN 'click' THEN 'openbsd_pf' ELSE 'replay' END")
    json = F.when(source == "wazuh", F.to_json(wazuh)).when(source == "security_onion", F.to_json(onion)).when(source == "openbsd_pf", F.to_json(firewall)).otherwise(F.to_json(plain))
    rows = table(spark, d, "events").select(own.alias("id"), source.alias("source"), F.col("ts").cast("timestamp").alias("event_ts"), json.alias("payload_json"))
    return rows.withColumn("payload", F.parse_json("payload_json"))


@register("""
    WITH e AS (SELECT *, json_extract_string(props, '$.k')::INT AS k, '10.0.0.' || (user_id % 250) AS ip, user_id::VARCHAR AS u FROM events)
    SELECT event_id::VARCHAR AS raw_event_id, ts AS event_ts,
        CASE event_type WHEN 'error' THEN 'wazuh' WHEN 'view' THEN 'security_onion' WHEN 'click' THEN 'openbsd_pf' ELSE 'replay' END AS source,
        CASE event_type WHEN 'error' THEN 'wazuh:' || event_id WHEN 'view' THEN 'security_onion:' || event_id WHEN 'click' THEN 'openbsd_pf:' || event_id END AS own_id,
        CASE event_type
            WHEN 'error' THEN CASE WHEN k % 15 <= 2 THEN 'info' WHEN k % 15 <= 5 THEN 'low' WHEN k % 15 <= 8 THEN 'medium' WHEN k % 15 <= 11 THEN 'high' ELSE 'critical' END
            WHEN 'view' THEN CASE WHEN k % 5 <= 1 THEN 'high' WHEN k % 5 = 2 THEN 'medium' WHEN k % 5 = 3 THEN 'low' ELSE 'info' END
            WHEN 'click' THEN CASE WHEN k < 50 THEN 'low' ELSE 'info' END
            ELSE CASE WHEN k >= 90 THEN 'critical' WHEN k >= 70 THEN 'high' WHEN k >= 40 THEN 'medium' WHEN k >= 10 THEN 'low' ELSE 'info' END END AS severity,
        CASE event_type WHEN 'error' THEN (k % 15)::VARCHAR WHEN 'view' THEN (k % 5)::VARCHAR WHEN 'click' THEN CASE WHEN k < 50 THEN 'BLOCK' ELSE 'pass' END ELSE k::VARCHAR END AS source_severity,
        CASE event_type WHEN 'error' THEN 'rule ' || k WHEN 'view' THEN 'beacon' WHEN 'click' THEN 'pf ' || CASE WHEN k < 50 THEN 'block' ELSE 'pass' END || ' in on em0' ELSE event_type END AS rule_name,
        CASE event_type WHEN 'error' THEN 'auth,ssh' WHEN 'view' THEN 'network' WHEN 'click' THEN 'firewall,pf,' || CASE WHEN k < 50 THEN 'block' ELSE 'pass' END ELSE 'one' END AS rule_groups,
        CASE event_type WHEN 'error' THEN 'ws-' || u WHEN 'view' THEN 'so-' || u WHEN 'click' THEN 'fw' END AS hostname,
        CASE event_type WHEN 'error' THEN u END AS agent_id,
        CASE WHEN event_type IN ('error', 'view', 'click') THEN ip END AS src_ip,
        CASE event_type WHEN 'error' THEN 'u' || u WHEN 'view' THEN NULL WHEN 'click' THEN NULL ELSE u END AS usr
    FROM e""")
def normalized_alerts(spark, d):
    rows = normalize.normalize(_telemetry(spark, d))
    own = F.when(F.col("source") != "replay", F.col("id"))  # the others' ids hash the payload's text
    return rows.select("raw_event_id", "event_ts", "source", own.alias("own_id"), "severity", "source_severity", "rule_name", F.array_join("rule_groups", ",").alias("rule_groups"), "hostname", "agent_id", "src_ip", F.col("user").alias("usr"))


@register("""
    WITH e AS (SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events WHERE event_type != 'signup')
    SELECT date_trunc('second', ts) AS event_ts, CASE WHEN k < 50 THEN 'block' ELSE 'pass' END AS action, k::VARCHAR AS rule_number, '10.0.0.' || (user_id % 250) AS src_ip, 1024 + k AS src_port,
        CASE event_type WHEN 'view' THEN '2001:db8::1' ELSE '192.0.2.1' END AS dst_ip, 443 AS dst_port, CASE event_type WHEN 'view' THEN 'udp' ELSE 'tcp' END AS protocol
    FROM e""")
def firewall_lines(spark, d):
    """Events as lines of a firewall log, sign-ups as lines that don't match, and the fields read back."""
    k = F.get_json_object("props", "$.k").cast("int")
    detail = F.expr("CASE event_type WHEN 'view' THEN ' udp 40' WHEN 'click' THEN ' S 1:1(0) win 5' ELSE '' END")
    to = F.when(F.col("event_type") == "view", "2001:db8::1.443").otherwise("192.0.2.1.443")
    line = F.concat(F.date_format("ts", "MMM dd HH:mm:ss"), F.lit(" rule "), k, F.lit("/(match) "), F.when(k < 50, "block").otherwise("pass"), F.lit(" in on em0: 10.0.0."), F.col("user_id") % 250, F.lit("."), 1024 + k, F.lit(" > "), to, F.lit(":"), detail)
    rows = readers.pf_lines(table(spark, d, "events").select(F.when(F.col("event_type") == "signup", "no such line").otherwise(line).alias("value")), 2024, "fw")
    read = lambda p, kind: F.try_variant_get("payload", f"$.{p}", kind).alias(p)
    return rows.select("event_ts", read("action", "string"), read("rule_number", "string"), read("src_ip", "string"), read("src_port", "int"), read("dst_ip", "string"), read("dst_port", "int"), read("protocol", "string"))


_STEP_NAMES = (*lifecycle.ACTS, "suggested", "approved", "denied", "nonsense")
_LEGAL = ", ".join(f"'{a}>{s}'" for a, s in lifecycle.STEPS)


@register(f"""WITH e AS (SELECT user_id, list([{", ".join(f"'{s}'" for s in _STEP_NAMES)}][event_id % 8 + 1] ORDER BY ts, event_id) AS steps FROM events GROUP BY 1),
    f AS (SELECT user_id, len(steps) AS n, list_reduce(list_prepend('none|0', steps), lambda s, x: CASE WHEN list_contains([{_LEGAL}], split_part(s, '|', 1) || '>' || x) THEN CASE x WHEN 'rollback_failed' THEN 'executed' ELSE x END || '|' || (split_part(s, '|', 2)::INT + 1) ELSE s END) AS folded FROM e)
    SELECT user_id::VARCHAR AS proposal_id, split_part(folded, '|', 1) AS status, split_part(folded, '|', 2)::BIGINT AS taken, n - split_part(folded, '|', 2)::BIGINT AS refused FROM f""")
def response_lifecycle(spark, d):
    step = F.array(*map(F.lit, _STEP_NAMES))[(F.col("event_id") % 8).cast("int")]
    log = table(spark, d, "events").select(F.col("user_id").cast("string").alias("proposal_id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), step.alias("step"))
    return lifecycle.current(lifecycle.stepped(log))


@register("""WITH a AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, 'replay:' || event_id) AS k FROM events)
    SELECT user_id::VARCHAR AS candidate_id, count(*) AS alert_count, count(*) > 20 AS alerts_truncated, string_agg(event_type, ',' ORDER BY k) FILTER (WHERE k <= 20) AS shown FROM a GROUP BY 1""")
def candidate_contexts(spark, d):
    rows = alerts(spark, d).withColumn("candidate_id", F.col("user")).withColumn("payload", F.parse_json("payload_json"))
    out = normalize.candidate_context(rows.select("candidate_id").distinct(), rows)
    return out.select("candidate_id", "alert_count", "alerts_truncated", F.array_join(F.transform("alerts", lambda a: a.rule_name), ",").alias("shown"))
