"""Raw events to alerts: one projection over one scan, a CASE on the source for each column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructType

from ..functions import paths, severity

#: The ordered paths of each field, by source.
PATHS: dict[str, dict[str, list[str]]] = {
    "wazuh": {
        "source_severity": ["rule.level", "rule_level", "data.rule.level", "_source.rule.level"],
        "timestamp": ["timestamp", "@timestamp", "_source.@timestamp"],
        "rule_name": ["rule.description", "rule.name", "rule_description", "description", "_source.rule.description"],
        "rule_groups": ["rule.groups", "rule.groups_json", "groups", "_source.rule.groups"],
        "agent_id": ["agent.id", "agent_id", "_source.agent.id"],
        "hostname": ["agent.name", "agent.hostname", "hostname", "host.name", "_source.agent.name"],
        "agent_os": ["agent.os.name", "agent.os.full", "host.os.name", "os.name", "_source.agent.os.name"],
        "id": ["id", "alert.id", "_id"],
        "src_ip": ["data.srcip", "data.src_ip", "srcip", "src_ip", "source.ip", "_source.data.srcip"],
        "dst_ip": ["data.dstip", "data.dst_ip", "dstip", "dst_ip", "destination.ip", "_source.data.dstip"],
        "user": ["data.dstuser", "data.srcuser", "data.user", "user.name", "data.win.eventdata.targetUserName", "data.win.eventdata.subjectUserName", "win.eventdata.targetUserName", "win.eventdata.subjectUserName", "_source.data.user"],
        "process_name": ["data.process.name", "process.name", "data.win.eventdata.image", "data.win.eventdata.newProcessName", "win.eventdata.image", "win.eventdata.newProcessName", "syscheck.path"],
        "command_line": ["data.command", "data.command_line", "process.command_line", "data.win.eventdata.commandLine", "win.eventdata.commandLine"],
        "logon_type": ["data.win.eventdata.logonType", "win.eventdata.logonType", "data.logon_type"],
        "fired_times": ["rule.firedtimes", "_source.rule.firedtimes"],
        "bytes_transferred": ["network.bytes", "data.bytes", "zeek.conn.orig_bytes", "source.bytes"],
    },
    "security_onion": {
        "source_severity": ["event.severity", "severity", "suricata.eve.alert.severity", "suricata.alert.severity", "alert.severity", "_source.event.severity"],
        "timestamp": ["@timestamp", "timestamp", "event.created", "_source.@timestamp"],
        "rule_name": ["suricata.eve.alert.signature", "suricata.alert.signature", "alert.signature", "rule.name", "event.reason", "message", "_source.suricata.alert.signature"],
        "rule_groups": ["suricata.eve.alert.category", "suricata.alert.category", "alert.category", "event.category", "event.type", "tags", "_source.event.category"],
        "id": ["event.id", "_id", "id"],
        "src_ip": ["source.ip", "src_ip", "srcip", "id.orig_h", "zeek.id.orig_h", "_source.source.ip"],
        "dst_ip": ["destination.ip", "dst_ip", "dstip", "id.resp_h", "zeek.id.resp_h", "_source.destination.ip"],
        "hostname": ["host.name", "hostname", "observer.hostname", "agent.name", "_source.host.name"],
        "agent_id": ["agent.id", "_source.agent.id"],
        "agent_os": ["host.os.name", "host.os.full", "_source.host.os.name"],
        "user": ["user.name", "source.user.name", "destination.user.name"],
        "process_name": ["process.name", "process.executable"],
        "command_line": ["process.command_line"],
        "bytes_transferred": ["network.bytes", "zeek.conn.orig_bytes", "source.bytes", "_source.network.bytes"],
    },
    "openbsd_pf": {
        "id": ["id", "event_id"],
        "timestamp": ["timestamp", "@timestamp"],
        "src_ip": ["src_ip", "source.ip", "srcip"],
        "dst_ip": ["dst_ip", "destination.ip", "dstip"],
        "hostname": ["hostname", "host.name", "firewall_hostname"],
        "agent_id": ["agent_id", "agent.id"],
        "agent_os": ["agent_os", "host.os.name"],
        "action": ["action"],
        "direction": ["direction"],
        "interface": ["interface"],
    },
    "generic": {
        "source_severity": ["severity", "level", "event.severity"],
        "timestamp": ["timestamp", "@timestamp", "event.timestamp"],
        "id": ["id", "alert_id", "event.id"],
        "rule_name": ["rule_name", "rule.name", "signature", "message", "description"],
        "rule_groups": ["rule_groups", "groups", "tags", "event.category"],
        "src_ip": ["src_ip", "srcip", "source.ip"],
        "dst_ip": ["dst_ip", "dstip", "destination.ip"],
        "hostname": ["hostname", "host.name", "agent.name"],
        "agent_id": ["agent_id", "agent.id"],
        "agent_os": ["agent_os", "host.os.name", "os.name"],
        "user": ["user", "user.name"],
        "process_name": ["process_name", "process.name"],
        "command_line": ["command_line", "process.command_line", "command"],
    },
}
STRINGS = ("rule_name", "src_ip", "dst_ip", "hostname", "agent_id", "agent_os", "user", "process_name", "command_line", "logon_type")
NUMBERS = ("fired_times", "bytes_transferred")
OWN = ("wazuh", "security_onion", "openbsd_pf")


def _by_source(choices: dict[str, Column], kind: str) -> Column:
    source = F.col("source")
    out = None
    for name in OWN:
        value = choices.get(name, F.lit(None).cast(kind))
        out = F.when(source == name, value) if out is None else out.when(source == name, value)
    return out.otherwise(choices.get("generic", F.lit(None).cast(kind)))


def normalize(raw: DataFrame) -> DataFrame:
    """Alerts of raw events (id, source, event_ts, payload VARIANT, payload_json): one row each, with the promoted fields."""
    p = F.col("payload")

    def field(name: str, read, kind: str) -> Column:
        return _by_source({s: read(p, fields[name]) for s, fields in PATHS.items() if name in fields}, kind)

    strings = {n: field(n, paths.first_string, "string") for n in STRINGS}
    pf = F.when(F.col("source") == "openbsd_pf", F.struct(*(paths.first_string(p, PATHS["openbsd_pf"][k]).alias(k) for k in ("action", "direction", "interface"))))
    read = raw.select(
        "id", "source", "payload", "payload_json", *(v.alias(k) for k, v in strings.items()), *(field(n, paths.first_int, "bigint").alias(n) for n in NUMBERS),
        _by_source({s: paths.first_timestamp(p, f["timestamp"], F.col("event_ts")) for s, f in PATHS.items()}, "timestamp").alias("event_ts"),
        field("rule_groups", paths.first_list, "array<string>").alias("rule_groups"), field("source_severity", paths.first_string, "string").alias("level"), field("id", paths.first_string, "string").alias("own"), pf.alias("pf"),
    )
    # a second projection: what is read once is named often
    firewall = F.col("source") == "openbsd_pf"
    pf_name = F.concat_ws(" ", F.lit("pf"), F.lower("pf.action"), F.lower("pf.direction"), F.when(F.col("pf.interface").isNotNull(), F.concat(F.lit("on "), F.col("pf.interface"))))
    level = F.col("level")
    name = F.when(F.col("source") == "wazuh", severity.from_wazuh_level(level)).when(F.col("source") == "security_onion", severity.from_inverted(level)).when(firewall, severity.from_pf_action(F.col("pf.action"))).otherwise(severity.from_text_or_number(level))
    fallback = F.concat_ws(":", "source", "id", F.substring(F.sha2("payload_json", 256), 1, 16))
    groups = F.when(firewall, F.array_compact(F.array(F.lit("firewall"), F.lit("pf"), F.lower("pf.action")))).otherwise(F.col("rule_groups"))
    return read.select(
        F.when(F.col("own").isNotNull(), F.concat_ws(":", "source", "own")).otherwise(fallback).alias("id"), "source", "event_ts", name.alias("severity"), F.when(firewall, F.col("pf.action")).otherwise(level).alias("source_severity"),
        F.coalesce(groups, F.array().cast("array<string>")).alias("rule_groups"), F.when(firewall, F.when(pf_name == "pf", "pf firewall event").otherwise(pf_name)).otherwise(F.col("rule_name")).alias("rule_name"),
        *(c for c in STRINGS if c != "rule_name"), *NUMBERS, F.col("id").alias("raw_event_id"), "payload", "payload_json",
    )


#: What a reader outside may see of alerts, of their payloads, of candidates and of enrichments.
ALERT_FIELDS = ("id", "source", "event_ts", "severity", "source_severity", "rule_name", "rule_groups", "src_ip", "dst_ip", "hostname", "agent_id", "agent_os", "user", "process_name", "command_line", "logon_type", "fired_times", "bytes_transferred")
RAW_FIELDS = ("full_log",)
CANDIDATE_FIELDS = ("first_seen", "last_seen", "primary_host", "primary_user", "src_ips", "dst_ips", "asset_context")
ENRICHMENT_FIELDS = ("indicator", "indicator_type", "provider", "summary", "looked_up_at")
TRUNCATED = "...[truncated]"


def _shown(rows: DataFrame, names: tuple[str, ...], longest: int) -> list[Column]:
    """The named columns that ``rows`` has, long texts cut and marked, in lists and structs as well; a column that it lacks is a null text."""
    def cut(c: Column, kind: DataType) -> Column:
        if isinstance(kind, StringType):
            return F.when(F.length(c) > longest, F.concat(F.substring(c, 1, longest), F.lit(TRUNCATED))).otherwise(c)
        if isinstance(kind, ArrayType):
            return F.transform(c, lambda x: cut(x, kind.elementType))
        if isinstance(kind, StructType):
            return F.when(c.isNotNull(), F.struct(*(cut(c[f.name], f.dataType).alias(f.name) for f in kind.fields)))
        return c

    return [(cut(F.col(f"`{n}`"), rows.schema[n].dataType) if n in rows.columns else F.lit(None).cast("string")).alias(n) for n in names]


def context(alerts: DataFrame, longest: int = 512, *also: str) -> DataFrame:
    """The allowlisted columns of alerts for a reader outside, and ``raw_excerpt`` of the payload's allowlisted fields (null without any).

    Texts over ``longest`` characters are cut and marked. Nothing else of the payload leaves. Columns named in ``also`` stay as they are.
    """
    field = lambda n: F.nullif(F.coalesce(F.try_variant_get("payload", f"$.{n}", "string"), F.lit("")), F.lit(""))
    cut = lambda c: F.when(F.length(c) > longest, F.concat(F.substring(c, 1, longest), F.lit(TRUNCATED))).otherwise(c)
    held = F.coalesce(*(field(n) for n in RAW_FIELDS)).isNotNull()
    excerpt = F.when(held, F.struct(*(cut(field(n)).alias(n) for n in RAW_FIELDS)))
    return alerts.select(*also, *_shown(alerts, ALERT_FIELDS, longest), excerpt.alias("raw_excerpt"))


def enrichment_context(enrichments: DataFrame, longest: int = 512, *also: str) -> DataFrame:
    """The allowlisted columns of enrichments; a provider's raw answer never leaves."""
    return enrichments.select(*also, *_shown(enrichments, ENRICHMENT_FIELDS, longest))


def candidate_context(candidates: DataFrame, members: DataFrame, longest: int = 512, most: int = 20) -> DataFrame:
    """The allowlisted columns of candidates with ``alert_count``, ``alerts_truncated`` and ``alerts``, the contexts of the first ``most`` members.

    ``members`` are alerts with a candidate_id, first by (event_ts, id), nulls last. The bound is the feature: Spark keeps ``most`` rows of a
    candidate in each task before they are shuffled, and counts are summed before the shuffle, so no candidate is collected as a whole.
    """
    # one payload field is all that a context needs of it, so it is read before rows are sorted
    shown = context(members.where("candidate_id is not null"), longest, "candidate_id")
    own = candidates.select("candidate_id", *_shown(candidates, CANDIDATE_FIELDS, longest))
    return _with_first(own, shown, "candidate_id", "alert", ("event_ts", "id"), most)


#: What a report's writer may see of incidents, triage results and routing decisions.
INCIDENT_FIELDS = ("first_seen", "last_seen", "primary_host", "primary_user", "src_ips", "dst_ips", "max_score", "asset_context", "candidate_ids")
TRIAGE_FIELDS = ("id", "target_id", "target_type", "score", "fp_likelihood", "classification", "action", "summary", "analysis_source", "model", "prompt_version")
ROUTING_FIELDS = ("id", "target_id", "action", "status", "destination", "message")


def triage_context(triage: DataFrame, longest: int = 512, *also: str) -> DataFrame:
    return triage.select(*also, *_shown(triage, TRIAGE_FIELDS, longest))


def routing_context(routed: DataFrame, longest: int = 512, *also: str) -> DataFrame:
    return routed.select(*also, *_shown(routed, ROUTING_FIELDS, longest))


def incident_context(incidents: DataFrame, candidates: DataFrame, longest: int = 512, most: int = 20) -> DataFrame:
    """The allowlisted columns of incidents (incident_id) with ``candidate_count``, ``candidates_truncated`` and ``candidates``: the first ``most`` contexts.

    ``candidates`` are rows of ``candidate_context`` with an incident_id, first by (first_seen, candidate_id), nulls last.
    """
    own = incidents.select("incident_id", *_shown(incidents, INCIDENT_FIELDS, longest))
    return _with_first(own, candidates.where("incident_id is not null"), "incident_id", "candidate", ("first_seen", "candidate_id"), most)


def _with_first(own: DataFrame, rows: DataFrame, key: str, name: str, order: tuple[str, ...], most: int) -> DataFrame:
    """``own`` with the count of its ``rows`` by ``key``, whether they are more than ``most``, and a list of the first ``most`` in ``order``."""
    first = Window.partitionBy(key).orderBy(*(F.asc_nulls_last(c) for c in order))
    names = [c for c in rows.columns if c != key]
    bounded = rows.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= most)
    listed = bounded.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_n", F.struct(*names).alias("v")))).alias("_a")).select(key, F.transform("_a", lambda x: x.v).alias("_list"))
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_count"))
    out = own.join(counts, key, "left").join(listed, key, "left")
    count = F.coalesce("_count", F.lit(0))
    return out.select(*own.columns, count.alias(f"{name}_count"), (count > most).alias(f"{name}s_truncated"), F.coalesce("_list", F.array().cast(listed.schema["_list"].dataType)).alias(f"{name}s"))
