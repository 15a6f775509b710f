"""Deterministic scoring, routing and evaluation expressions."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import net

#: Base scores, keywords, boosts and bounds.
BASE = {"critical": 8, "high": 6, "medium": 4, "low": 2, "info": 1}
UNKNOWN_BASE = 3
HIGH_TERMS = ("mimikatz", "sekurlsa", "lsass", "credential", "c2", "trojan", "ransom")
MEDIUM_TERMS = ("encodedcommand", "-enc", "rundll32", "regsvr32", "mshta")
LOGON = {"10": 2, "2": 1}
VOLUME = ((5_000_000_000, 2), (500_000_000, 1))
ROUTINE_FIRED = 1000
NOT_ESCALATING = ("private_ip", "loopback_ip", "link_local_ip", "public_ip", "reserved_ip", "hash_observable")
PAGE_AT, QUEUE_AT = 8, 4


def base(severity: Column) -> Column:
    out = None
    for name, score in BASE.items():
        out = F.when(severity == name, score) if out is None else out.when(severity == name, score)
    return out.otherwise(UNKNOWN_BASE)


def _mentions(text: Column, terms: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(t) for t in terms))


def keyword_boost(*fields: Column) -> Column:
    """2 for any high term and 1 for any medium term in the lower-cased fields."""
    text = F.lower(F.concat_ws(" ", *fields))
    return F.when(_mentions(text, HIGH_TERMS), 2).otherwise(0) + F.when(_mentions(text, MEDIUM_TERMS), 1).otherwise(0)


def external_boost(dst_ip: Column) -> Column:
    return F.when(dst_ip.isNotNull() & (F.trim(dst_ip) != "") & ~net.is_private(dst_ip), 1).otherwise(0)


def logon_boost(logon_type: Column) -> Column:
    text = F.trim(logon_type.cast("string"))
    return reduce(lambda c, kv: c.when(text == kv[0], kv[1]), list(LOGON.items())[1:], F.when(text == "10", LOGON["10"])).otherwise(0)


def volume_boost(n_bytes: Column, steps: tuple = VOLUME) -> Column:
    out = F.when(n_bytes >= steps[0][0], steps[0][1])
    for least, boost in steps[1:]:
        out = out.when(n_bytes >= least, boost)
    return out.otherwise(0)


def frequency_damping(fired: Column, severity: Column, routine: int = ROUTINE_FIRED) -> Column:
    return F.when((fired >= routine) & ~severity.isin("high", "critical"), -1).otherwise(0)


def enrichment_boost(hint: Column, factors: Column, text: Column) -> Column:
    """What one enrichment adds; a target's sum counts 3 at most."""
    strong = (hint == "high") | F.arrays_overlap(factors, F.array(F.lit("encoded_powershell"), F.lit("credential_dumping_hint"))) | _mentions(F.lower(text), ("encoded_powershell", "credential_dumping_hint", "encodedcommand"))
    weak = (F.size(F.array_except(factors, F.array(*map(F.lit, NOT_ESCALATING)))) > 0) | ((hint == "medium") & (F.size(factors) == 0))
    return F.when(strong, 2).when(weak, 1).otherwise(0)


def asset_boost(criticality: Column, internet_facing: Column) -> Column:
    own = F.when(F.lower(criticality) == "critical", 2).when(F.lower(criticality) == "high", 1).otherwise(0)
    return F.least(F.when((own > 0) & F.coalesce(internet_facing, F.lit(False)), own + 1).otherwise(own), F.lit(3))


def clamp(score: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(10), score)).cast("int")


def alert_score(row) -> Column:
    """The local score of an alert; ``row`` gives a column by name, ``enrichment`` what enrichments add."""
    parts = [base(row("severity")), keyword_boost(row("rule_name"), row("command_line"), row("process_name"), row("user"), row("src_ip"), row("dst_ip")), external_boost(row("dst_ip")), logon_boost(row("logon_type")), volume_boost(row("bytes_transferred")), frequency_damping(row("fired_times"), row("severity")), F.least(F.coalesce(row("enrichment"), F.lit(0)), F.lit(3))]
    return clamp(reduce(add, parts))


def action(score: Column, page_at: int = PAGE_AT, queue_at: int = QUEUE_AT) -> Column:
    """The routing action: the score is the only authority."""
    if not 1 <= queue_at <= page_at <= 10:
        raise ValueError("thresholds must satisfy 1 <= queue_at <= page_at <= 10")
    return F.when(score >= page_at, "page_now").when(score >= queue_at, "queue_review").otherwise("mark_likely_benign")


def fp_likelihood(score: Column) -> Column:
    return F.when(score >= 8, "low").when(score >= 4, "medium").otherwise("high")


def classification(score: Column) -> Column:
    return F.when(score >= 8, "likely_true_positive_high_priority").when(score >= 4, "needs_analyst_review").otherwise("likely_false_positive_or_low_priority")


def triage_id(kind: Column, target: Column, score: Column, label: Column) -> Column:
    return F.concat(F.lit("triage-"), F.substring(F.sha2(F.concat_ws(":", kind, target, score.cast("string"), label), 256), 1, 12))


def band_error(score: Column, low: Column, high: Column) -> Column:
    return F.greatest(low - score, score - high, F.lit(0))


def age(seconds: Column) -> Column:
    """An age as minutes, hours or days; 0m if it lies ahead, - if there is none."""
    minutes = F.floor(F.greatest(seconds, F.lit(0)) / 60)
    return F.when(seconds.isNull(), "-").when(minutes < 60, F.concat(minutes, F.lit("m"))).when(minutes < 1440, F.concat(F.floor(minutes / 60), F.lit("h"))).otherwise(F.concat(F.floor(minutes / 1440), F.lit("d")))
