"""IP addresses as columns."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def ipv4_number(ip: Column) -> Column:
    """The address as a number; null if it isn't four numbers up to 255, without leading zeros, between dots."""
    return let(F.split(ip, "[.]"), _number_of)


def _number_of(parts: Column) -> Column:
    number = F.lit(0).cast("long")
    for i in range(4):
        part = F.get(parts, F.lit(i))
        value = F.when(F.length(part) <= 3, part).try_cast("int")
        number = number * 256 + F.when((value.cast("string") == part) & value.between(0, 255), value).cast("long")
    return F.when(F.size(parts) == 4, number)


def canonical_ipv6(ip: Column) -> Column:
    """An IPv6 address in lower case, without leading zeros, its first longest run of zero groups as ::; null if it is none."""
    return let(F.split(ip, "::"), lambda sides: let(_groups(sides), lambda every: let(_plain(every), _shortened)))


def _groups(sides: Column) -> Column:
    groups = lambda i: F.when(F.get(sides, F.lit(i)) == "", F.array().cast("array<string>")).otherwise(F.split(F.get(sides, F.lit(i)), ":"))
    left, right = groups(0), groups(1)
    filled = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(left) - F.size(right))), right)
    return F.when(F.size(sides) == 1, left).when((F.size(sides) == 2) & (F.size(left) + F.size(right) <= 7), filled)


def _plain(every: Column) -> Column:
    valid = (F.size(every) == 8) & F.forall(every, lambda g: g.rlike("^[0-9A-Fa-f]{1,4}$"))
    return F.when(valid, F.array_join(F.transform(every, lambda g: F.regexp_replace(F.lower(g), "^0+(?=.)", "")), ":"))


def _shortened(plain: Column) -> Column:
    out = plain
    for n in range(2, 9):
        run = rf"^(.*?)(?:^|:)0(?::0){{{n - 1}}}(?::|$)(.*)$"
        out = F.when(plain.rlike(run), F.concat(F.regexp_extract(plain, run, 1), F.lit("::"), F.regexp_extract(plain, run, 2))).otherwise(out)
    return out


# Fixed value: the texts of which ipv4_number gives a number.
IPV4 = r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?!\z)|\z)){4}\z"


def canonical_ip(text: Column) -> Column:
    """An IPv4 or IPv6 address without a port or brackets; null if the text is none."""
    return let(let(F.trim(text), _bare), lambda bare: F.when(bare.contains(":"), canonical_ipv6(bare)).when(bare.rlike(IPV4), bare))


def _bare(text: Column) -> Column:
    return F.when(text.startswith("["), F.substring_index(F.substring(text, 2, 100), "]", 1)).when(F.size(F.split(text, ":")) == 2, F.substring_index(text, ":", 1)).otherwise(text)


def in_network(ip: Column, network: str) -> Column:
    """Whether ip lies in an IPv4 or IPv6 network; false if it is no address."""
    net = ipaddress.ip_network(network, strict=False)
    if net.version == 4:
        number = ipv4_number(ip)
        return F.coalesce(number.between(int(net.network_address), int(net.broadcast_address)), F.lit(False))

    @F.pandas_udf("boolean")
    def inside(values):
        def one(v):
            try:
                return ipaddress.ip_address(v) in net
            except ValueError:
                return False

        return values.map(one)

    return F.coalesce(inside(ip), F.lit(False))


# IPv4 networks that aren't routed globally.
NOT_GLOBAL = ["0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4"]


def _in(number: Column, *networks: str) -> Column:
    out = F.lit(False)
    for net in map(ipaddress.ip_network, networks):
        out = out | number.between(int(net.network_address), int(net.broadcast_address))
    return out


def is_usable(ip: Column) -> Column:
    """Of a canonical address: neither loopback nor unspecified nor multicast."""
    return F.coalesce(let(ipv4_number(ip), lambda number: ~_in(number, "127.0.0.0/8", "0.0.0.0/32", "224.0.0.0/4")), ip.contains(":") & ~ip.isin("::", "::1") & ~ip.startswith("ff"))


def is_public(ip: Column) -> Column:
    """Of a canonical address, IPv4 or IPv6: whether it is routed globally; false if it is no address."""
    local6 = ip.rlike("^(?:::1?$|f[cd]|fe[89ab]|2001:db8:|2001:(?:[0-9a-f]{1,2}|1[0-9a-f]{2}):|64:ff9b:1:|100::|2002:)")
    return F.coalesce(is_global(ip), ip.contains(":") & ~local6, F.lit(False))


def is_global(ip: Column) -> Column:
    """Whether an IPv4 address is routed globally; null if it is no IPv4 address."""
    return let(ipv4_number(ip), lambda number: ~_in(number, *NOT_GLOBAL))
