"""Indicator extraction and local risk hints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import net, paths

#: The indicator patterns.
URL = r"(?i)\bhttps?://[^\s\"'<>]+"
EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
IP = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
HASH = r"\b(?:[a-fA-F0-9]{32}|[a-fA-F0-9]{40}|[a-fA-F0-9]{64})\b"
DOMAIN = r"\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)+[A-Za-z]{2,63}\b"
#: File names and local names that read like domains, and what marks risks.
FILE_SUFFIXES = ("local", "bak", "bat", "cfg", "cmd", "conf", "dll", "evtx", "exe", "ini", "jar", "js", "json", "log", "msi", "pcap", "ps1", "py", "sqlite", "sys", "tmp", "txt", "xml", "yaml", "yml")
SUSPICIOUS_TLDS = ("zip", "mov", "top", "xyz", "click", "country", "gq", "tk")
CREDENTIAL_PATHS = ("/login", "/signin", "/wp-admin", "/admin")
CRADLES = ("downloadstring", "invoke-webrequest", "curl ", "wget ")
DUMPERS = ("mimikatz", "sekurlsa", "lsass", "procdump")
LIVING_OFF_THE_LAND = ("powershell.exe", "rundll32.exe", "regsvr32.exe", "mshta.exe", "wscript.exe")
HIGH_FACTORS = ("encoded_powershell", "download_cradle", "credential_dumping_hint")
MEDIUM_FACTORS = ("suspicious_tld", "url_with_ip")


def _any(text: Column, words: tuple[str, ...]) -> Column:
    out = text.contains(words[0])
    for w in words[1:]:
        out = out | text.contains(w)
    return out


def _found(text: Column, pattern: str, kind: str, shape) -> Column:
    hits = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), shape)
    return F.transform(hits, lambda v: F.struct(F.lit(kind).alias("type"), F.trim(v).alias("value")))


def _bare(v: Column) -> Column:
    return F.regexp_replace(v, r"[.,;)]+$", "")


def false_domain(v: Column) -> Column:
    """Whether a lower-case domain is a file name or a local one."""
    return v.rlike(r"\.(" + "|".join(FILE_SUFFIXES) + ")$")


def dedupe(indicators: Column) -> Column:
    """The first of indicators with one type and value (case aside), in order, blanks dropped."""
    key = lambda x: F.concat(F.lower(x.type), F.lit("\x1f"), F.lower(F.trim(x.value)))
    kept = F.filter(indicators, lambda x: x.value.isNotNull() & (F.trim(x.value) != ""))
    # sorted by key and place, an indicator stays if the one before has another key; then in order again: no search for each
    keyed = F.array_sort(F.transform(kept, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x"))))
    once = paths.let(keyed, lambda a: F.filter(a, lambda y, i: (i == 0) | (F.get(a, F.greatest(i - 1, F.lit(0))).k != y.k)))
    return F.transform(F.array_sort(F.transform(once, lambda y: F.struct(y.i.alias("i"), y.x.alias("x")))), lambda y: y.x)


def from_text(text: Column) -> Column:
    """Array of (type, value) in a text: URLs, then e-mail addresses, IPv4 addresses, hashes and domains, each once."""
    ips = F.filter(_found(text, IP, "ip", lambda v: v), lambda x: net.is_valid(x.value))
    domains = F.filter(_found(text, DOMAIN, "domain", lambda v: F.lower(_bare(v))), lambda x: ~false_domain(x.value))
    return dedupe(F.concat(_found(text, URL, "url", _bare), _found(text, EMAIL, "email", _bare), ips, _found(text, HASH, "hash", F.lower), domains))


def hash_type(v: Column) -> Column:
    return F.when(F.length(v) == 32, "md5").when(F.length(v) == 40, "sha1").when(F.length(v) == 64, "sha256").otherwise("unknown")


def _factors(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for c, n in pairs)))


def url_factors(v: Column) -> Column:
    v = F.lower(v)
    return _factors((v.rlike(r"https?://(?:\d{1,3}\.){3}\d{1,3}"), "url_with_ip"), (v.startswith("http://"), "cleartext_http"), (_any(v, CREDENTIAL_PATHS), "credential_page_path"))


def domain_factors(v: Column) -> Column:
    v = F.lower(v)
    return _factors((F.substring_index(v, ".", -1).isin(*SUSPICIOUS_TLDS), "suspicious_tld"), (F.length(v) > 60, "long_domain"))


def command_factors(v: Column) -> Column:
    v = F.lower(v)
    return _factors((v.contains("powershell") & _any(v, ("-enc", "encodedcommand")), "encoded_powershell"), (_any(v, CRADLES), "download_cradle"), (_any(v, DUMPERS), "credential_dumping_hint"))


def process_factors(v: Column) -> Column:
    return _factors((_any(F.lower(v), LIVING_OFF_THE_LAND), "living_off_the_land_process"))


def ip_factors(v: Column) -> Column:
    return _factors((net.is_global(v), "public_ip"), (net.is_private(v), "private_ip"), (net.is_loopback(v), "loopback_ip"), (net.is_link_local(v), "link_local_ip"), (net.is_reserved(v), "reserved_ip"))


def risk_factors(kind: Column, value: Column) -> Column:
    """The local risk factors of an indicator."""
    by = {"ip": ip_factors(value), "url": url_factors(value), "domain": domain_factors(value), "command": command_factors(value), "process": process_factors(value), "hash": F.array(F.lit("hash_observable"))}
    out = None
    for k, v in by.items():
        out = F.when(kind == k, v) if out is None else out.when(kind == k, v)
    return out.otherwise(F.array().cast("array<string>"))


def severity_hint(factors: Column) -> Column:
    has = lambda names: F.arrays_overlap(factors, F.array(*map(F.lit, names)))
    return F.when(has(HIGH_FACTORS), "high").when(has(MEDIUM_FACTORS), "medium").when(F.size(factors) > 0, "low").otherwise("info")


def confidence(kind: Column) -> Column:
    return F.when(kind == "ip", 0.95).when(kind.isin("hash", "url", "domain", "email"), 0.85).otherwise(0.7)


def summary(kind: Column, value: Column, factors: Column) -> Column:
    start = F.lit("Local enrichment: ")
    ip = F.when(net.is_private(value), F.concat(start, value, F.lit(" is a private/internal IP address."))).when(net.is_global(value), F.concat(start, value, F.lit(" is a public/global IP address."))).otherwise(F.concat(start, value, F.lit(" is a non-global IP address.")))
    hints = F.concat(start, kind, F.lit(" "), value, F.lit(" has hints: "), F.array_join(factors, ", "), F.lit("."))
    return F.when(kind == "ip", ip).when(F.size(factors) > 0, hints).otherwise(F.concat(start, F.lit("observed "), kind, F.lit(" "), value, F.lit(".")))


def enrichment_id(target: Column, kind: Column, value: Column) -> Column:
    return F.concat(F.lit("enrich-"), F.substring(F.sha2(F.concat_ws(":", F.coalesce(target, F.lit("global")), kind, F.lower(value)), 256), 1, 12))
