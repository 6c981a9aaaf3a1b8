"""Addresses, sockets and directions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


DOTTED = r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"


def ip_to_long(ip: Column) -> Column:
    """Dotted IPv4 text as a number; null when it is not one."""
    value = F.aggregate(F.split(ip, r"\."), F.lit(0).cast("long"), lambda acc, part: acc * 256 + part.try_cast("long"))
    return F.when(ip.rlike(DOTTED), value)


def long_to_ip(value: Column) -> Column:
    """Number as dotted IPv4 text."""
    return F.concat_ws(".", *[F.shiftright(value, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)])


def socket(src_ip: Column, src_port: Column, dst_ip: Column, dst_port: Column) -> Column:
    """Directed socket as a nested struct."""
    return F.struct(
        F.struct(src_ip.alias("ip"), src_port.alias("port")).alias("source"),
        F.struct(dst_ip.alias("ip"), dst_port.alias("port")).alias("dest"),
    )


def endpoint(ip: Column, port: Column) -> Column:
    """Address and port as one number."""
    return ip_to_long(ip) * 65536 + port.cast("long")


def has_socket(ip1: Column, port1: Column, ip2: Column, port2: Column) -> Column:
    """True when both ends are complete; a cheap test to filter by before the key is built."""
    return ip1.rlike(DOTTED) & ip2.rlike(DOTTED) & port1.isNotNull() & port2.isNotNull()


def undirected_socket(ip1: Column, port1: Column, ip2: Column, port2: Column) -> Column:
    """Both ends in address order, as one text key; null when an address or port is missing."""
    both = F.array_join(F.sort_array(F.array(endpoint(ip1, port1), endpoint(ip2, port2))), "-")
    return F.when(has_socket(ip1, port1, ip2, port2), both)


def local_side_ip(src: Column, dst: Column, prefix: str = "111.186") -> Column:
    """Destination when only it holds the local prefix, else source."""
    return F.when(~src.contains(prefix) & dst.contains(prefix), dst).otherwise(src)


def in_networks(ip: Column, networks: list[str]) -> Column:
    """Membership of an address in any CIDR block."""
    value = ip_to_long(ip)
    tests = []
    for block in networks:
        net, bits = block.split("/")
        size = 1 << (32 - int(bits))
        low = reduce(lambda acc, o: acc * 256 + int(o), net.split("."), 0) // size * size
        tests.append(value.between(low, low + size - 1))
    return F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False)) if tests else F.lit(False)


def direction(src: Column, dst: Column, clients: list[str], servers: list[str]) -> Column:
    """Side a packet or flow comes from; client blocks are tried in order before server blocks."""
    out = F.lit(None).cast("string")
    rules = [(b, "client", "server") for b in clients] + [(b, "server", "client") for b in servers]
    for block, from_src, from_dst in reversed(rules):
        out = F.when(in_networks(src, [block]), F.lit(from_src)).when(
            in_networks(dst, [block]), F.lit(from_dst)
        ).otherwise(out)
    return out


def is_local(ip: Column, pattern: str = r"^111\.186.*") -> Column:
    """Local-address test by pattern; null counts as not local."""
    return F.coalesce(ip.rlike(pattern), F.lit(False))


def mac_plain(mac: Column) -> Column:
    """Hardware address without colons."""
    return F.replace(mac, F.lit(":"), F.lit(""))
