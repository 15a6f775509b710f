"""Boundary tables of the expression libraries."""

import ipaddress
import random
import time

import pytest
from pyspark.sql import functions as F

from alertloom.functions import ioc, net, paths, scoring, severity


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("value", "want"), [("90", "critical"), ("89.9", "high"), ("70", "high"), ("40", "medium"), ("10", "low"), ("9", "info"), (" WARN ", "medium"), ("fatal", "critical"), ("notice", "low"), ("what", "unknown"), ("", "unknown"), (None, "unknown")])
def test_text_or_number(spark, value, want):
    assert one(spark, severity.from_text_or_number(F.lit(value).cast("string"))) == want


@pytest.mark.parametrize(("value", "want"), [("2", "info"), ("3", "low"), ("5", "low"), ("8", "medium"), ("9", "high"), ("11", "high"), ("12", "critical"), ("7.9", "medium"), ("high", "high"), (None, "unknown")])
def test_rule_level(spark, value, want):
    assert one(spark, severity.from_wazuh_level(F.lit(value).cast("string"))) == want


@pytest.mark.parametrize(("value", "want"), [("0", "high"), ("1", "high"), ("2", "medium"), ("3", "low"), ("4", "info"), ("major", "high")])
def test_inverted(spark, value, want):
    assert one(spark, severity.from_inverted(F.lit(value).cast("string"))) == want


def test_addresses_against_the_standard_library(spark):
    rng = random.Random(4)
    ips = [".".join(str(rng.randrange(256)) for _ in range(4)) for _ in range(800)]
    ips += ["10.1.2.3", "100.64.0.1", "192.0.0.9", "192.0.0.8", "198.51.100.25", "203.0.113.1", "224.0.0.5", "233.233.171.252", "240.0.0.1", "255.255.255.255", "0.0.0.0", "127.0.0.1", "169.254.1.1", "172.31.0.1", "172.32.0.1"]
    rows = spark.createDataFrame([(x,) for x in ips], "ip string").withColumn("c", net.classify(F.col("ip"))).collect()
    for r in rows:
        a = ipaddress.ip_address(r["ip"])
        got = r["c"]
        assert (got.is_private, got.is_global, got.is_loopback, got.is_link_local, got.is_multicast, got.is_reserved, got.is_unspecified) == (a.is_private, a.is_global, a.is_loopback, a.is_link_local, a.is_multicast, a.is_reserved, a.is_unspecified), r["ip"]


def test_ipv6_against_the_standard_library(spark):
    rng = random.Random(5)
    texts = ["::", "::1", "::ffff:10.0.0.1", "::ffff:8.8.8.8", "::ffff:127.0.0.1", "::FFFF:0808:0808", "::1.2.3.4", "fe80::1%eth0", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1::8", "64:ff9b::1.2.3.4"]
    for block in net.PRIVATE_6 + net.NOT_PRIVATE_6 + net.RESERVED_6 + ("ff00::/8", "2000::/3"):
        low, high = (int(x, 16) for x in net._range_6(block))
        for n in (low, high, max(0, low - 1), min(2**128 - 1, high + 1), rng.randint(low, high)):
            a = ipaddress.IPv6Address(n)
            texts += [str(a), a.exploded.upper()]
    bad = ["1:2:3:4:5:6:7:8:9", "1::2::3", ":::", "1:2:3:4:5:6:7", "1::2:3:4:5:6:7:8", "12345::", "g::1", "::1.2.3", "::1.2.3.400", "::01.2.3.4", "1.2.3.4::", "fe80::1%", "::%a%b", ":1", "1:", "::1\n", "host:80"]
    rows = spark.createDataFrame([(x,) for x in texts + bad], "ip string").withColumn("c", net.classify(F.col("ip"))).withColumn("factors", ioc.risk_factors(F.lit("ip"), F.col("ip"))).collect()
    for r in rows[: len(texts)]:
        a = ipaddress.ip_address(r["ip"])
        assert tuple(r["c"]) == (6, a.is_private, a.is_global, a.is_loopback, a.is_link_local, a.is_multicast, a.is_reserved, a.is_unspecified), r["ip"]
        assert r["factors"] == [name for name, on in (("public_ip", a.is_global), ("private_ip", a.is_private), ("loopback_ip", a.is_loopback), ("link_local_ip", a.is_link_local), ("reserved_ip", a.is_reserved)) if on]
    for r in rows[len(texts) :]:
        with pytest.raises(ValueError):
            ipaddress.ip_address(r["ip"])
        assert r["c"] is None and r["factors"] == [], r["ip"]


@pytest.mark.parametrize("text", ["256.1.1.1", "01.2.3.4", "1.2.3", "", "a.b.c.d", None])
def test_no_address(spark, text):
    value = F.lit(text).cast("string")
    assert one(spark, net.is_valid(value)) is False
    assert one(spark, net.is_private(value)) is False


def test_indicators_in_order_and_once(spark):
    text = "Visit http://evil.example.zip/login. mail Bob@Corp.example.com, from 10.0.0.1 and 10.0.0.1 999.1.1.1 hash D41D8CD98F00B204E9800998ECF8427E ran powershell.exe notes.txt bad.example.top"
    got = [(x.type, x.value) for x in one(spark, ioc.from_text(F.lit(text)))]
    assert got[:4] == [("url", "http://evil.example.zip/login"), ("email", "Bob@Corp.example.com"), ("ip", "10.0.0.1"), ("hash", "d41d8cd98f00b204e9800998ecf8427e")]
    domains = [v for k, v in got if k == "domain"]
    assert "bad.example.top" in domains and "powershell.exe" not in domains and "notes.txt" not in domains


@pytest.mark.parametrize(("kind", "value", "factors", "hint"), [
    ("ip", "10.0.0.1", ["private_ip"], "low"), ("ip", "8.8.8.8", ["public_ip"], "low"), ("url", "http://1.2.3.4/admin", ["url_with_ip", "cleartext_http", "credential_page_path"], "medium"),
    ("domain", "a.zip", ["suspicious_tld"], "medium"), ("command", "PowerShell -enc AAA", ["encoded_powershell"], "high"), ("command", "curl x", ["download_cradle"], "high"),
    ("process", "C:\\mshta.exe", ["living_off_the_land_process"], "low"), ("hash", "d41d", ["hash_observable"], "low"), ("user", "bob", [], "info"),
])
def test_risk(spark, kind, value, factors, hint):
    got = one(spark, ioc.risk_factors(F.lit(kind), F.lit(value)))
    assert got == factors
    assert one(spark, ioc.severity_hint(F.lit(got).cast("array<string>"))) == hint


def test_many_indicators_in_one_text(spark):
    text = " ".join(f"http://h{i}.example.net/a{i}" for i in range(800))
    rows = spark.createDataFrame([(text,)], "t string").select(ioc.from_text(F.col("t")).alias("v"))
    rows.collect()
    began = time.time()
    assert len(rows.first()["v"]) == 1600 and time.time() - began < 3


def test_paths(spark):
    payload = F.parse_json(F.lit('{"a": {"b": " x "}, "a.c": "flat", "n": {"m": "12", "neg": -3, "t": true, "f": "1.5", "k": 7}, "l": ["p", "", " q "], "e": "", "z": null, "o": {"w": 1}}'))
    assert one(spark, paths.first_string(payload, ["e", "z", "a.b"])) == "x"
    assert one(spark, paths.first_string(payload, ["a.c"])) == "flat"
    assert one(spark, paths.first_string(payload, ["o", "a.b"])) is None  # the first present value decides
    assert one(spark, paths.first_int(payload, ["n.t", "n.neg", "n.f", "n.m"])) == 12
    assert one(spark, paths.first_int(payload, ["n.k"])) == 7
    assert one(spark, paths.first_list(payload, ["l"])) == ["p", "q"]
    assert one(spark, paths.first_list(payload, ["a.c"])) == ["flat"]
    assert one(spark, paths.first_list(payload, ["none"])) == []


@pytest.mark.parametrize(("score", "action"), [(1, "mark_likely_benign"), (3, "mark_likely_benign"), (4, "queue_review"), (7, "queue_review"), (8, "page_now"), (10, "page_now")])
def test_actions(spark, score, action):
    assert one(spark, scoring.action(F.lit(score))) == action


def test_bad_thresholds(spark):
    assert one(spark, scoring.action(F.lit(5), 5, 5)) == "page_now"
    with pytest.raises(ValueError):
        scoring.action(F.lit(1), 4, 8)


@pytest.mark.parametrize(("seconds", "text"), [(None, "-"), (-120, "0m"), (0, "0m"), (3599, "59m"), (3600, "1h"), (86399, "23h"), (86400, "1d")])
def test_age(spark, seconds, text):
    assert one(spark, scoring.age(F.lit(seconds).cast("bigint"))) == text
