"""Readers of recorded telemetry: every one gives raw events (id, source, event_ts, payload VARIANT, payload_json) or a dimension."""

from __future__ import annotations

from datetime import datetime
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.canonical import canonical_items, content_id

#: Names of sources, markers of them, and what a packet's detail may start with.
SOURCE_ALIASES = {"wazuh": "wazuh", "security_onion": "security_onion", "security-onion": "security_onion", "so": "security_onion", "openbsd_pf": "openbsd_pf", "openbsd-pf": "openbsd_pf", "pf": "openbsd_pf", "splunk": "splunk", "replay": "replay", "unknown": "unknown"}
WAZUH_MARKERS = "wazuh|ossec"
SECURITY_ONION_MARKERS = "securityonion|security_onion|security-onion|suricata|zeek|so-"
PROTOCOLS = ("tcp", "udp", "icmp", "icmp6", "igmp", "esp", "ah", "gre", "ipv6", "ospf", "pim")
PF_LINE = r"^([A-Za-z]{3}\s+\d{1,2}\s+\d{1,2}:\d{2}:\d{2}(?:\.\d+)?)\s+rule\s+([^/\s]+)/\(([^)]*)\)\s+(block|pass|match|rdr|nat)\s+(in|out)\s+on\s+([^\s:]+):\s+(\S+)\s+>\s+(\S+?):(?:\s+(.*))?$"

RAW = ("id", "source", "event_ts", "payload", "payload_json")


def content_hash(json: Column, n: int = 16) -> Column:
    """The first characters of a payload's SHA-256, over its JSON text as this engine writes it (stable here, not across engines)."""
    return F.substring(F.sha2(json, 256), 1, n)


def _whole_files(spark: SparkSession, path: str) -> DataFrame:
    read = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(path)
    return read.select(F.col("value").alias("text"), F.col("_metadata.file_name").alias("file"))


def _items(df: DataFrame, text: str, envelopes: tuple[str, ...], beside: Column | None = None) -> DataFrame:
    """One row an item of a JSON document: of the list, of the list under the first envelope that it has, or the document; ``beside`` is an array with a value for each item."""
    doc = df.withColumn("doc", F.try_parse_json(text))
    lists = [F.try_variant_get("doc", e, "array<variant>") for e in ("$", *envelopes)]
    doc = doc.withColumn("items", F.coalesce(*lists, F.array("doc")))
    if beside is None:
        return doc.select("*", F.posexplode("items").alias("pos", "item")).drop("items", "doc")
    # zipped before the explode, which would else copy the array to every item
    both = F.zip_with("items", F.coalesce(beside, F.array().cast("array<string>")), lambda i, b: F.struct(i.alias("item"), b.alias("beside")))
    return doc.withColumn("items", both).select("*", F.posexplode("items").alias("pos", "both")).select("*", "both.item", "both.beside").drop("items", "doc", "both")


def replay(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Raw events of a replay file or of all *.json files of a folder; ``file`` and ``pos`` give their order of arrival.

    A file is a list, {"events": [...]} or one event. An event without id gets replay-<source>-<stem>-<number>. Unknown sources,
    payloads that are no objects and malformed timestamps raise when ``strict``, else give a row with an ``error``.
    """
    rows = _items(_whole_files(spark, path), "text", ("$.events",))
    text = lambda p: F.try_variant_get("item", p, "string")
    named = F.coalesce(F.nullif(F.lower(F.trim(text("$.source"))), F.lit("")), F.lit("replay"))
    source = F.create_map(*(F.lit(x) for kv in SOURCE_ALIASES.items() for x in kv))[named]
    payload = F.try_variant_get("item", "$.payload", "variant")
    stamp = F.nullif(F.trim(text("$.timestamp")), F.lit(""))
    ts = stamp.try_cast("timestamp")
    error = F.when(source.isNull(), F.concat(F.lit("unknown source: "), named)).when(payload.isNull() | ~F.schema_of_variant(payload).startswith("OBJECT"), "payload is not an object").when(stamp.isNotNull() & ts.isNull(), F.concat(F.lit("malformed timestamp: "), stamp))
    stem = F.regexp_replace("file", r"\.json$", "")
    own = F.coalesce(F.nullif(F.trim(text("$.id")), F.lit("")), F.format_string("replay-%s-%s-%04d", source, stem, F.col("pos") + 1))
    out = rows.select(own.alias("id"), source.alias("source"), ts.alias("event_ts"), payload.alias("payload"), F.to_json(payload).alias("payload_json"), error.alias("error"), "file", "pos")
    if strict:
        out = out.withColumn("id", F.when(F.col("error").isNotNull(), F.raise_error(F.col("error"))).otherwise(F.col("id")))
    return out


def skipped_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of a replay folder that are no JSON files."""
    return spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_name").alias("file")).where(~F.col("file").endswith(".json"))


def newest(rows: DataFrame, limit: int | None) -> DataFrame:
    """The newest ``limit`` rows (all if None), oldest first."""
    if limit is not None:
        rows = rows.orderBy(F.desc("event_ts"), F.desc("id")).limit(limit)
    return rows.orderBy("event_ts", "id")


def wazuh_alerts(spark: SparkSession, path: str, now: datetime, lookback_minutes: int, least_level: int = 0, limit: int | None = 100, agents: DataFrame | None = None) -> DataFrame:
    """Raw events of an NDJSON alert log: malformed and non-object lines are dropped (see ``malformed_lines``), then old and minor ones.

    ``agents`` (agent_id, ...) is joined into payload_json's neighbour ``agent_context`` by agent id.
    """
    lines = spark.read.text(path).where("trim(value) != ''").withColumn("payload", F.try_parse_json("value")).where(F.col("payload").isNotNull() & F.schema_of_variant("payload").startswith("OBJECT"))
    p = F.col("payload")
    ts = paths.first_timestamp(p, ["timestamp", "@timestamp"], F.lit(now).cast("timestamp"))
    level = F.coalesce(paths.first_int(p, ["rule.level"]), F.lit(0))
    agent, rule = paths.first_string(p, ["agent.id"]), paths.first_string(p, ["rule.id"])
    own = F.coalesce(paths.first_string(p, ["id"]), paths.first_string(p, ["event_id"]), paths.first_string(p, ["_id"]), F.concat_ws("-", F.lit("wazuh"), paths.first_string(p, ["timestamp"]), agent, rule))
    rows = lines.select(own.alias("id"), F.lit("wazuh").alias("source"), ts.alias("event_ts"), p, F.to_json(p).alias("payload_json"), agent.alias("agent_id"), level.alias("level"))
    rows = rows.where((F.col("event_ts") >= F.lit(now) - F.expr(f"interval {int(lookback_minutes)} minutes")) & (F.col("level") >= least_level))
    if agents is not None:
        context = agents.groupBy("agent_id").agg(F.first(F.struct(*agents.columns)).alias("agent_context"))
        rows = rows.join(context, "agent_id", "left")
    return newest(rows, limit)


def malformed_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row: how many non-blank lines are no JSON objects."""
    v = F.try_parse_json("value")
    return spark.read.text(path).where("trim(value) != ''").agg(F.count_if(v.isNull() | ~F.schema_of_variant(v).startswith("OBJECT")).alias("malformed"))


def hits(df: DataFrame, text: str, prefix: str, source: str) -> DataFrame:
    """Raw events of search responses {"hits": {"hits": [{"_source": {...}}]}}, or of {"events"}, {"data": {"events"}}; unusable hits are counted by ``usable`` (see ``hit_counts``).

    A hit without an id of its own gets the hash of its canonical JSON text, as written in the document.
    """
    envelopes = ("$.hits.hits", "$.data.events", "$.events")
    rows = _items(df, text, envelopes, canonical_items(F.col(text), envelopes, "_source"))
    wrapped = F.try_variant_get("item", "$._source", "variant")
    payload = F.coalesce(wrapped, F.col("item"))
    rows = rows.withColumn("payload", payload).withColumn("usable", F.coalesce(F.schema_of_variant("payload").startswith("OBJECT"), F.lit(False)))
    json = F.to_json("payload")
    ids = F.coalesce(F.nullif(F.trim(F.try_variant_get("item", "$._id", "string")), F.lit("")), *(paths.first_string(F.col("payload"), [k]) for k in ("event.id", "id", "log.id.uid", "uid")), content_id(prefix, F.col("beside")))
    return rows.select(F.when(F.col("usable"), ids).alias("id"), F.lit(source).alias("source"), paths.first_timestamp(F.col("payload"), ["@timestamp", "timestamp"], F.lit(None).cast("timestamp")).alias("event_ts"), "payload", json.alias("payload_json"), "usable")


def hit_counts(rows: DataFrame) -> DataFrame:
    """How many hits are usable and how many are not."""
    return rows.groupBy("usable").agg(F.count(F.lit(1)).alias("n"))


def wazuh_indexer(spark: SparkSession, path: str, now: datetime, lookback_minutes: int, least_level: int = 0, limit: int | None = 100) -> DataFrame:
    """Raw events of saved indexer responses; the floor and the lookback are applied again here, whatever the server did."""
    rows = hits(_whole_files(spark, path), "text", "wazuh-indexer", "wazuh").where("usable")
    level = F.coalesce(paths.first_int(F.col("payload"), ["rule.level"]), F.lit(0))
    return newest(rows.where((F.col("event_ts") >= F.lit(now) - F.expr(f"interval {int(lookback_minutes)} minutes")) & (level >= least_level)), limit).select(*RAW)


SEVERITY_RANK = {"info": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}


def security_onion(spark: SparkSession, path: str, now: datetime, lookback_minutes: int, least: str | None = None, limit: int | None = 100, mirror: bool = False) -> DataFrame:
    """Raw events of saved responses: old ones and those under the severity floor go, those of unknown severity stay. ``mirror``: retagged as wazuh."""
    from ..functions import severity

    rows = hits(_whole_files(spark, path), "text", "security-onion", "security_onion").where("usable").where(F.col("event_ts") >= F.lit(now) - F.expr(f"interval {int(lookback_minutes)} minutes"))
    if least is not None:
        level = severity.from_inverted(paths.first_string(F.col("payload"), ["event.severity", "suricata.eve.alert.severity"]))
        rank = F.create_map(*(F.lit(x) for kv in SEVERITY_RANK.items() for x in kv))[level]
        rows = rows.where(rank.isNull() | (rank >= SEVERITY_RANK[least]))
    if mirror:
        rows = rows.withColumn("source", F.lit("wazuh")).withColumn("id", F.concat(F.lit("so-mirror-"), "id"))
    return newest(rows, limit).select(*RAW)


def zeek(events: DataFrame, dataset: str, ip: str | None = None) -> DataFrame:
    """Raw events of one Zeek dataset (conn, dns, http), of one address in either direction if given."""
    p = F.col("payload")
    rows = events.where(paths.first_string(p, ["event.dataset"]) == f"zeek.{dataset}")
    if ip is not None:
        rows = rows.where((paths.first_string(p, ["source.ip"]) == ip) | (paths.first_string(p, ["destination.ip"]) == ip))
    return rows


def splunk_results(df: DataFrame) -> DataFrame:
    """Raw events of saved search results, a row each: a JSON object in _raw is the payload, else the row itself."""
    row = F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)))
    raw = F.try_parse_json("_raw") if "_raw" in df.columns else F.parse_json(F.lit("null"))
    is_object = raw.isNotNull() & F.schema_of_variant(raw).startswith("OBJECT")
    rest = F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns if c != "_raw")))
    merged = F.concat(F.expr("substring(to_json(try_parse_json(_raw)), 1, length(to_json(try_parse_json(_raw))) - 1)"), F.when(F.to_json(raw) == "{}", "").otherwise(","), F.lit('"splunk":'), rest, F.lit("}")) if "_raw" in df.columns else row
    json = F.when(is_object, merged).otherwise(row)
    hint = F.lower(F.concat_ws(" ", *(F.col(f"`{c}`").cast("string") for c in ("sourcetype", "source", "index", "_sourcetype") if c in df.columns)))
    source = F.when(hint.rlike(WAZUH_MARKERS), "wazuh").when(hint.rlike(SECURITY_ONION_MARKERS), "security_onion").otherwise("splunk")
    times = [c for c in ("_time", "_indextime", "@timestamp", "timestamp") if c in df.columns]
    stamp = F.coalesce(*(F.nullif(F.col(f"`{c}`").cast("string"), F.lit("")) for c in times)) if times else F.lit(None).cast("string")
    ts = F.coalesce(F.timestamp_seconds(stamp.try_cast("double")), stamp.try_cast("timestamp"))
    return df.select(json.alias("payload_json"), source.alias("source"), ts.alias("event_ts")).select(F.concat(F.lit("splunk-"), content_hash(F.col("payload_json"))).alias("id"), "source", "event_ts", F.parse_json("payload_json").alias("payload"), "payload_json")


#: Fields and states that tell that a search job is done or failed.
JOB_DONE_FIELDS, JOB_DONE, JOB_FAILED = ("isDone", "is_done", "done"), "DONE", "FAILED"


def search_job(spark: SparkSession, status: str, results: str, limit: int | None = None) -> DataFrame:
    """Result rows (pos, row VARIANT, usable) of a saved search job: its status response and its results response, a JSON file or folder each.

    A job that failed, that is not done or whose status is missing raises: partial results look like a quiet period. Rows that
    are no objects are kept as not ``usable``, so that they can be counted; ``limit`` is the job's own result count.
    """
    doc = F.try_parse_json("text")
    content = F.coalesce(F.try_variant_get("doc", "$.entry[0].content", "variant"), F.try_variant_get("doc", "$.content", "variant"))
    get = lambda k: F.lower(F.trim(F.try_variant_get("content", f"$.{k}", "string")))
    state = F.upper(F.coalesce(get("dispatchState"), F.lit("")))
    done = reduce(or_, (F.coalesce(get(k), F.lit("")).isin("true", "1") for k in JOB_DONE_FIELDS)) | (state == JOB_DONE)
    bad = F.when(state == JOB_FAILED, "the search job failed").when(~done, "the search job is not done; no partial results are read")
    jobs = _whole_files(spark, status).withColumn("doc", doc).withColumn("content", content).agg(F.max(bad).alias("bad"), F.count(F.lit(1)).alias("jobs"))
    told = jobs.select(F.when(F.col("jobs") == 0, "the search job has no status").otherwise(F.col("bad")).alias("bad"), F.lit(1).alias("one"))
    rows = _items(_whole_files(spark, results), "text", ("$.results",)).select("file", "pos", F.col("item").alias("row"), F.schema_of_variant("item").startswith("OBJECT").alias("usable"), F.lit(1).alias("one"))
    if limit is not None:
        rows = rows.orderBy("file", "pos").limit(limit)
    # one row by construction
    checked = told.select("one", F.when(F.col("bad").isNotNull(), F.raise_error(F.col("bad"))).otherwise(F.lit(True)).cast("boolean").alias("_good"))
    return rows.join(F.broadcast(checked), "one").where("_good").select("pos", "row", "usable")


def agents(spark: SparkSession, path: str) -> DataFrame:
    """The agent inventory of saved manager responses, a row an agent_id: agents without an id are dropped, of repeated ids the last one stays."""
    rows = _items(_whole_files(spark, path), "text", ("$.data.affected_items", "$.affected_items")).where(F.schema_of_variant("item").startswith("OBJECT"))
    get = lambda *ps: F.coalesce(*(F.nullif(F.trim(F.try_variant_get("item", p, "string")), F.lit("")) for p in ps))
    fields = {"hostname": get("$.name", "$.hostname"), "ip": get("$.ip"), "os_name": get("$.os.name"), "os_version": get("$.os.version"), "status": get("$.status"), "last_seen": get("$.lastKeepAlive").try_cast("timestamp"), "groups": F.coalesce(F.try_variant_get("item", "$.group", "array<string>"), F.array().cast("array<string>")), "raw_json": F.to_json("item")}
    named = rows.select("file", "pos", get("$.id").alias("agent_id"), *(v.alias(k) for k, v in fields.items())).where("agent_id is not null")
    return named.groupBy("agent_id").agg(F.max_by(F.struct(*fields), F.struct("file", "pos")).alias("a")).select("agent_id", "a.*")


def _endpoint(token: Column) -> tuple[Column, Column]:
    """Address and port of a packet endpoint: four dotted numbers and maybe a fifth, else what precedes a last dot and digits."""
    four = r"^(\d{1,3}(?:\.\d{1,3}){3})(?:\.(\d+))?$"
    last = r"^(.*)\.(\d+)$"
    v4 = token.rlike(four)
    ip = F.when(v4, F.regexp_extract(token, four, 1)).when(token.rlike(last), F.regexp_extract(token, last, 1)).otherwise(token)
    port = F.when(v4, F.regexp_extract(token, four, 2)).when(token.rlike(last), F.regexp_extract(token, last, 2))
    return ip, port.try_cast("int")


def pf_lines(lines: DataFrame, year: int, hostname: str | None = None) -> DataFrame:
    """Raw events of firewall log lines (value); lines that don't match are dropped, see ``pf_malformed``."""
    part = lambda i: F.nullif(F.regexp_extract("value", PF_LINE, i), F.lit(""))
    src_ip, src_port = _endpoint(part(7))
    dst_ip, dst_port = _endpoint(part(8))
    token = F.lower(F.regexp_extract(F.coalesce(part(9), F.lit("")), r"^([A-Za-z0-9]+)", 1))
    protocol = F.when(token.isin(*PROTOCOLS), token).when(src_port.isNotNull() | dst_port.isNotNull(), "tcp")
    stamp = F.concat(F.lit(f"{year} "), F.regexp_replace(part(1), r"\s+", " "))
    ts = F.coalesce(F.try_to_timestamp(stamp, F.lit("yyyy MMM d HH:mm:ss.SSSSSS")), F.try_to_timestamp(stamp, F.lit("yyyy MMM d HH:mm:ss")))
    fields = F.struct(ts.cast("string").alias("timestamp"), part(4).alias("action"), part(5).alias("direction"), part(6).alias("interface"), protocol.alias("protocol"), part(2).alias("rule_number"), src_ip.alias("src_ip"), src_port.alias("src_port"), dst_ip.alias("dst_ip"), dst_port.alias("dst_port"), F.lit(hostname).cast("string").alias("hostname"), F.col("value").alias("raw_line"))
    rows = lines.where(F.col("value").rlike(PF_LINE)).select(ts.alias("event_ts"), F.to_json(fields).alias("payload_json"))
    return rows.select(F.concat(F.lit("pf-"), content_hash(F.col("payload_json"))).alias("id"), F.lit("openbsd_pf").alias("source"), "event_ts", F.parse_json("payload_json").alias("payload"), "payload_json")


def pf_malformed(lines: DataFrame) -> DataFrame:
    return lines.agg(F.count_if((F.trim("value") != "") & ~F.col("value").rlike(PF_LINE)).alias("malformed"))


CRITICALITIES = ("critical", "high", "medium", "low")


def assets(spark: SparkSession, path: str) -> DataFrame:
    """The asset inventory of a CSV file: header names in any case, only hostname needed, unknown columns and blank hosts dropped; ``row`` is the order of rows: file, block, line in it."""
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").option("encoding", "UTF-8").csv(path)
    names = {c.lstrip("﻿").strip().lower(): c for c in raw.columns}
    if "hostname" not in names:
        raise ValueError("the asset inventory has no hostname column")
    cell = lambda c: F.nullif(F.trim(F.col(f"`{names[c]}`")), F.lit("")) if c in names else F.lit(None).cast("string")
    level = F.lower(cell("criticality"))
    facing = F.coalesce(F.lower(cell("internet_facing")).isin("true", "yes", "y", "1"), F.lit(False))
    out = raw.select(cell("hostname").alias("hostname"), cell("ip").alias("ip"), cell("owner").alias("owner"), F.when(level.isin(*CRITICALITIES), level).otherwise("unknown").alias("criticality"), facing.alias("internet_facing"), cell("department").alias("department"), F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("row"))
    return out.where("hostname is not null")


def labelled_cases(spark: SparkSession, path: str) -> DataFrame:
    """Labelled cases of a JSON file or folder, sorted by id; a case out of bounds raises."""
    rows = _items(_whole_files(spark, path), "text", ("$.cases",))
    get = lambda p, t="string": F.try_variant_get("item", p, t)
    actions = F.coalesce(get("$.expected_actions", "array<string>"), F.array(get("$.expected_actions")))
    low, high = get("$.expected_score_min", "int"), get("$.expected_score_max", "int")
    good = get("$.id").isNotNull() & get("$.fixture").isNotNull() & low.between(1, 10) & high.between(1, 10) & (low <= high) & (F.size(F.array_compact(actions)) > 0)
    checked = F.when(F.coalesce(good, F.lit(False)), get("$.id")).otherwise(F.raise_error(F.concat(F.lit("invalid labelled case: "), F.to_json("item"))))
    return rows.select(checked.alias("case_id"), get("$.provenance").alias("provenance"), get("$.fixture").alias("fixture"), low.alias("score_min"), high.alias("score_max"), actions.alias("expected_actions"), get("$.expected_classification").alias("expected_classification"), get("$.rationale").alias("rationale")).orderBy("case_id")


PLAYBOOK_ACTIONS = ("pf_block_ip", "wazuh_firewall_drop", "wazuh_host_deny")


def playbooks(spark: SparkSession, path: str) -> DataFrame:
    """Response playbooks of a JSON file or folder, sorted by name; a name that occurs twice or an unknown action raises."""
    rows = _items(_whole_files(spark, path), "text", ("$.playbooks",))
    get = lambda p, t="string": F.try_variant_get("item", p, t)
    out = rows.select(get("$.name").alias("name"), get("$.action").alias("action"), get("$.required_confidence", "int").alias("required_confidence"), F.coalesce(get("$.requires_confirmation", "boolean"), F.lit(True)).alias("requires_confirmation"), F.coalesce(get("$.enabled", "boolean"), F.lit(True)).alias("enabled"), F.coalesce(get("$.trigger_actions", "array<string>"), F.array().cast("array<string>")).alias("trigger_actions"), get("$.description").alias("description"))
    times = F.count(F.lit(1)).over(Window.partitionBy("name"))
    bad = (times > 1) | ~F.col("action").isin(*PLAYBOOK_ACTIONS) | ~F.col("required_confidence").between(1, 10)
    return out.withColumn("name", F.when(bad, F.raise_error(F.concat(F.lit("invalid or repeated playbook: "), F.col("name")))).otherwise(F.col("name"))).orderBy("name")
