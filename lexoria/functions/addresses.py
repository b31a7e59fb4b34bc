"""Hosts of urls and numeric addresses, as column expressions.

An IPv4 address is a long. An IPv6 address is its 32 hexadecimal digits, which compare like numbers.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

# Networks that are not public, of the special-purpose registries, and public ones inside.
CLOSED = """0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.2.0/24
192.168.0.0/16 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 224.0.0.0/4 240.0.0.0/4
::/8 100::/8 200::/7 400::/6 800::/5 1000::/4 2001::/23 2001:db8::/32 2002::/16 3fff::/20 4000::/3 6000::/3 8000::/3
a000::/3 c000::/3 e000::/4 f000::/5 f800::/6 fc00::/7 fe00::/9 fe80::/10 ff00::/8""".split()
OPEN = """192.0.0.9/32 192.0.0.10/32 2001:1::1/128 2001:1::2/128 2001:3::/32 2001:4:112::/48 2001:20::/28 2001:30::/28""".split()


def closed_ranges(version: int) -> list[tuple[int, int]]:
    """(first, last) of the addresses that are not public, apart and ascending: at each address the
    longest network decides."""
    nets = [(n, closed) for names, closed in ((CLOSED, True), (OPEN, False)) for n in map(ipaddress.ip_network, names) if n.version == version]
    nets.sort(key=lambda n: n[0].prefixlen)
    edges = sorted({int(n.network_address) for n, _ in nets} | {int(n.broadcast_address) + 1 for n, _ in nets})
    out: list[tuple[int, int]] = []
    for a, b in zip(edges, edges[1:], strict=False):
        inside = [closed for n, closed in nets if int(n.network_address) <= a <= int(n.broadcast_address)]
        if inside and inside[-1]:
            out = [*out[:-1], (out[-1][0], b - 1)] if out and out[-1][1] == a - 1 else [*out, (a, b - 1)]
    return out


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def host_parts(url: Column) -> Column:
    """(host, port, problem) of an http or https url. The host is lower-cased, in ASCII (other scripts
    by IDNA) and without dots at its end; brackets of IPv6 are gone. The port is the scheme's where
    none is given. Problems: invalid_url, credentials, no_host; host and port are null then."""
    pattern = r"(?s)^\s*([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)"
    scheme, authority = F.lower(F.regexp_extract(url, pattern, 1)), F.regexp_extract(url, pattern, 2)
    place = r"^(?:\[([^\[\]]*)\]|([^:\[\]]*))(?::([0-9]*))?$"
    raw = F.concat(F.regexp_extract(authority, place, 1), F.regexp_extract(authority, place, 2))
    given = F.nullif(F.regexp_extract(authority, place, 3), F.lit("")).try_cast("long")
    plain = F.lower(F.when(raw.rlike(r"^[\x00-\x7F]*$"), raw).otherwise(F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), raw)))
    labels = lambda x: F.split(F.regexp_replace(x, r"\.$", ""), r"\.")
    host = _let(plain, lambda x: F.when(F.forall(labels(x), lambda y: F.length(y).between(1, 63)), F.regexp_replace(x, r"\.+$", "")))
    bad = ~scheme.isin("http", "https") | (authority == "") | (~authority.contains("@") & (~authority.rlike(place) | (given > 65535)))
    problem = F.when(url.isNull() | bad, "invalid_url").when(authority.contains("@"), "credentials").when(F.coalesce(host, F.lit("")) == "", "no_host")
    port = F.coalesce(given, F.when(scheme == "https", 443).otherwise(80)).cast("int")
    return F.struct(F.when(problem.isNull(), host).alias("host"), F.when(problem.isNull(), port).alias("port"), problem.alias("problem"))


def ipv4(host: Column) -> Column:
    """The number of an IPv4 address in any of the numeric forms that resolvers take: one to four parts
    in decimal, octal (0...) or hexadecimal (0x...), the last one filling what is left; else null."""
    def number(x: Column) -> Column:
        return (
            F.when(x.rlike("^0[xX][0-9a-fA-F]{1,8}$"), F.conv(F.substr(x, F.lit(3)), 16, 10).cast("long"))
            .when(x.rlike("^0[0-7]{1,11}$"), F.conv(x, 8, 10).cast("long"))
            .when(x.rlike("^(0|[1-9][0-9]{0,9})$"), x.try_cast("long"))
        )

    def joined(v: Column) -> Column:
        n = F.size(v)
        total = F.aggregate(F.slice(v, 1, F.greatest(n - 1, F.lit(0))), F.lit(0).cast("long"), lambda a, x: F.when(x <= 255, a * 256 + x))
        left = F.element_at(F.array(*[F.lit(1 << 8 * (5 - k)) for k in range(1, 5)]), F.least(n, F.lit(4)))
        return F.when((n <= 4) & (F.element_at(v, -1) < left), total * left + F.element_at(v, -1))

    return _let(F.transform(F.split(host, r"\."), number), joined)


def ipv6(host: Column) -> Column:
    """The 32 hexadecimal digits of an IPv6 address, with ``::`` and a dotted end resolved and a zone
    left out; else null."""
    low = F.lower(F.regexp_replace(host, "%.*$", ""))
    dotted = r"^(.*:)((?:[0-9]{1,3}\.){3}[0-9]{1,3})$"
    tail = F.lpad(F.lower(F.hex(ipv4(F.regexp_replace(F.regexp_extract(low, dotted, 2), r"(^|\.)0+(?=[0-9])", "$1")))), 8, "0")
    text = F.when(low.rlike(dotted), _let(tail, lambda t: F.concat(F.regexp_extract(low, dotted, 1), F.left(t, F.lit(4)), F.lit(":"), F.right(t, F.lit(4))))).otherwise(low)
    groups = lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, ":"))

    def filled(h: Column) -> Column:
        """The eight groups of the halves around ``::``; null where they are not as many."""
        first, second = groups(h[0]), groups(F.coalesce(F.get(h, F.lit(1)), F.lit("")))
        n = F.size(first) + F.size(second)
        fits = F.when(F.size(h) == 1, n == 8).otherwise((F.size(h) == 2) & (n <= 7))
        return F.when(fits, F.concat(first, F.array_repeat(F.lit("0"), F.greatest(8 - n, F.lit(0))), second))

    every = lambda t: F.when(t.contains(":"), _let(F.split(t, "::"), filled))
    digits = lambda g: F.when(F.forall(g, lambda x: x.rlike("^[0-9a-f]{1,4}$")), F.array_join(F.transform(g, lambda x: F.lpad(x, 4, "0")), ""))
    return _let(_let(text, every), digits)


def not_public(address: Column) -> Column:
    """Whether a numeric address may not be fetched from; null where it is none. An IPv4 address inside
    an IPv6 one counts as itself."""
    any_of = lambda x, ranges, kind: _some([x.between(kind(a), kind(b)) for a, b in ranges])

    def judged(x: Column) -> Column:
        closed4 = any_of(x["four"], closed_ranges(4), F.lit)
        closed6 = any_of(x["six"], closed_ranges(6), lambda n: F.lit(f"{n:032x}"))
        return F.when(x["four"].isNotNull(), closed4).when(x["six"].isNotNull(), closed6)

    inner = lambda six: F.when(six.startswith("0" * 20 + "ffff"), F.conv(F.right(six, F.lit(8)), 16, 10).cast("long"))
    both = lambda six: F.struct(F.coalesce(inner(six), ipv4(address)).alias("four"), six.alias("six"))
    return _let(_let(ipv6(address), both), judged)


def _some(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out
