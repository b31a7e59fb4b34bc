"""Numeric addresses and hosts against the standard library, and verdicts by rule."""

from __future__ import annotations

import ipaddress
import random

from pyspark.sql import functions as F

from lexoria.functions.addresses import CLOSED, OPEN, host_parts, ipv4, ipv6, not_public
from lexoria.operators.web_policy import check_destinations


def closed(text):
    """As the standard library's properties tell."""
    try:
        x = ipaddress.ip_address(text)
    except ValueError:
        return None
    x = getattr(x, "ipv4_mapped", None) or x
    return not x.is_global or x.is_private or x.is_loopback or x.is_link_local or x.is_multicast or x.is_reserved or x.is_unspecified


def test_public_addresses_are_those_of_the_standard_library(spark):
    rng = random.Random(2)
    texts = {"", "a.b", "1.2.3.4.5", "256.1.1.1", "1::2::3", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "::g", "::ffff:10.0.0.1", "::ffff:8.8.8.8", "64:ff9b::8.8.8.8", "::1.2.3.256", "12345::"}
    for net in map(ipaddress.ip_network, CLOSED + OPEN):
        kind = ipaddress.IPv4Address if net.version == 4 else ipaddress.IPv6Address
        ends = (int(net.network_address), int(net.broadcast_address))
        texts |= {str(kind(x)) for e in ends for x in (e - 1, e, e + 1) if 0 <= x < 1 << (32 if net.version == 4 else 128)}
    texts |= {str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(200)} | {str(ipaddress.IPv6Address(rng.getrandbits(128))) for _ in range(100)} | {ipaddress.IPv6Address(rng.getrandbits(64)).exploded.upper() for _ in range(20)}
    # The standard library of some versions does not know 3fff::/20 yet.
    texts = {t for t in texts if not t.lower().startswith(("3fff:", "4000:")) and not t.startswith("3ffe:ffff")}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", not_public(F.col("t")).alias("c"), ipv4(F.col("t")).alias("four"), ipv6(F.col("t")).alias("six")).collect()
    for r in rows:
        assert r.c == closed(r.t), r
        if r.c is not None:
            x = ipaddress.ip_address(r.t)
            assert (r.four if x.version == 4 else int(r.six, 16)) == int(x)


def test_numeric_forms_of_one_address(spark):
    texts = ["127.0.0.1", "127.1", "127.0.1", "0x7f.1", "0177.0.0.1", "017700000001", "2130706433", "0x7F000001", "0x7f.0x0.0x0.0x1"]
    assert {r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(ipv4(F.col("t"))).collect()} == {2130706433}
    none = ["08.1.1.1", "4294967296", "1.2.65536", "0x1ffffffff", "1..2", ".", "-1", "1.2.3.4.", None]
    assert {r[0] for r in spark.createDataFrame([(t,) for t in none], "t string").select(ipv4(F.col("t"))).collect()} == {None}


def test_hosts(spark):
    want = {
        "https://Ex.com:8080/a": ("ex.com", 8080, None), "http://bücher.example./x": ("bücher.example".encode("idna").decode(), 80, None), "http://u:p@h/": (None, None, "credentials"),
        "ftp://h/": (None, None, "invalid_url"), "http:///x": (None, None, "invalid_url"), "http://h:99999/": (None, None, "invalid_url"), "http://[::1]:80/": ("::1", 80, None), "http://[::1/": (None, None, "invalid_url"),
        "http://a..b/": (None, None, "no_host"), f"http://{'a' * 64}/": (None, None, "no_host"), "HTTPS://A?x": ("a", 443, None), "x": (None, None, "invalid_url"), None: (None, None, "invalid_url"), "": (None, None, "invalid_url"),
    }
    got = {r.u: (r.host, r.port, r.problem) for r in spark.createDataFrame([(u,) for u in want], "u string").select("u", host_parts(F.col("u")).alias("p")).select("u", "p.*").collect()}
    assert got == want


def test_verdicts(spark):
    urls = ["http://a.com/", "http://b.com/", "http://c.com/", "http://d.com/", "http://e.org/", "http://0x7f.1/", "http://8.8.8.8/", "http://me@a.com/", None, "http://A.com./x"]
    answers = [("a.com", "8.8.8.8"), ("b.com", "8.8.8.8"), ("b.com", "10.0.0.1"), ("c.com", "what"), ("a.com", "2606:4700::1"), (None, "8.8.8.8"), ("e.org", "::1%eth0")]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    resolved = spark.createDataFrame(answers, "host string, address string")
    judge = lambda allowed: [r.verdict for r in check_destinations(df, resolved, allowed).orderBy("page_id").collect()]
    assert judge([]) == ["ok", "blocked", "invalid_address", "unresolved", "blocked", "blocked", "ok", "credentials", "invalid_url", "ok"]
    assert judge(["*.com", "a.com"]) == ["ok", "blocked", "invalid_address", "unresolved", "not_allowed", "not_allowed", "not_allowed", "credentials", "invalid_url", "ok"]
    assert check_destinations(df.limit(0), resolved.limit(0)).count() == 0
