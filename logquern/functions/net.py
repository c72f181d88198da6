"""IPv4 addresses and networks as native arithmetic; the network is folded while the plan is built."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import EngineError

OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"


def parse_cidr(text: str) -> tuple[int, int]:
    """Network and prefix length."""
    m = re.fullmatch(r"(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})/(\d{1,2})", text.strip())
    if not m or any(int(x) > 255 for x in m.groups()[:4]) or int(m[5]) > 32:
        raise EngineError(f"not an IPv4 network: {text!r}")
    a, b, c, d, bits = map(int, m.groups())
    address = a << 24 | b << 16 | c << 8 | d
    return address >> (32 - bits) << (32 - bits) if bits else 0, bits


def to_number(ip: Column) -> Column:
    """The address as a number; null for what isn't one."""
    parts = F.split(ip, r"\.")
    octet = lambda i: F.get(parts, F.lit(i)).try_cast("long")
    number = octet(0) * 16777216 + octet(1) * 65536 + octet(2) * 256 + octet(3)
    return F.when(ip.rlike(IPV4), number)


def in_network(ip: Column, cidr: str) -> Column:
    """False, never null, for what is no IPv4 address."""
    network, bits = parse_cidr(cidr)
    low, high = network, network + (1 << (32 - bits)) - 1
    return F.coalesce(to_number(ip).between(low, high), F.lit(False))
