"""Tests on IP addresses given as text (v4, or v6 in full or short form)."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, functions as F

# Address blocks that are not globally routable.
NOT_GLOBAL_V4 = (
    "0.0.0.0/8",
    "10.0.0.0/8",
    "100.64.0.0/10",
    "127.0.0.0/8",
    "169.254.0.0/16",
    "172.16.0.0/12",
    "192.0.0.0/29",
    "192.0.0.170/31",
    "192.0.2.0/24",
    "192.168.0.0/16",
    "198.18.0.0/15",
    "198.51.100.0/24",
    "203.0.113.0/24",
    "240.0.0.0/4",
    "255.255.255.255/32",
)
NOT_GLOBAL_V6 = (
    "::1/128",
    "::/128",
    "::ffff:0:0/96",
    "100::/64",
    "2001::/23",
    "2001:2::/48",
    "2001:db8::/32",
    "2001:10::/28",
    "fc00::/7",
    "fe80::/10",
)

#: Four decimal numbers of up to 255.
OCTETS = r"^((25[0-5]|2[0-4]\d|1\d\d|\d?\d)(\.(?=\d)|$)){4}$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def v4_number(ip: Column | str) -> Column:
    """Dotted address as a number; null when it is not a v4 address."""
    parts = F.split(_col(ip), r"\.")
    number = F.aggregate(parts, F.lit(0).cast("bigint"), lambda total, part: total * 256 + part.try_cast("bigint"))
    return F.when(_col(ip).rlike(OCTETS), number)


def v6_digits(ip: Column | str) -> Column:
    """The 32 hex digits of a v6 address; null when it is not one."""
    text = F.lower(_col(ip))
    # a dotted tail stands for the last two groups
    tail = F.regexp_extract(text, r"^.*:(\d+\.\d+\.\d+\.\d+)$", 1)
    hexed = F.lpad(F.lower(F.hex(v4_number(tail))), 8, "0")
    head = F.regexp_extract(text, r"^(.*:)\d+\.\d+\.\d+\.\d+$", 1)
    text = F.when(tail != "", F.concat(head, hexed.substr(1, 4), F.lit(":"), hexed.substr(5, 4))).otherwise(text)
    sides = F.split(text, "::")

    def groups(side: Column) -> Column:
        return F.filter(F.split(F.coalesce(side, F.lit("")), ":"), lambda g: g != "")

    left, right = groups(F.get(sides, F.lit(0))), groups(F.get(sides, F.lit(1)))
    missing = F.greatest(F.lit(8) - F.size(left) - F.size(right), F.lit(0))
    full = F.concat(left, F.array_repeat(F.lit("0000"), missing), right)
    digits = F.array_join(F.transform(full, lambda g: F.lpad(g, 4, "0")), "")
    return F.when(text.contains(":") & (F.length(digits) == 32), digits)


def intervals(blocks: Iterable[str]) -> list[tuple[int, int]]:
    """First and last address of the blocks as sorted, disjoint intervals; nested and touching blocks are one."""
    merged: list[tuple[int, int]] = []
    for net in sorted(map(ipaddress.ip_network, blocks)):
        lo, hi = int(net.network_address), int(net.broadcast_address)
        if merged and lo <= merged[-1][1] + 1:
            merged[-1] = (merged[-1][0], max(hi, merged[-1][1]))
        else:
            merged.append((lo, hi))
    return merged


def inside(value: Column, spans: list[tuple[int, int]], bound: Callable) -> Column:
    """Whether a value lies in one of sorted, disjoint intervals: a search tree of comparisons, not a test per interval."""
    if not spans:
        return F.when(value.isNotNull(), F.lit(False))
    if len(spans) == 1:
        return value.between(F.lit(bound(spans[0][0])), F.lit(bound(spans[0][1])))
    middle = len(spans) // 2
    left, right = inside(value, spans[:middle], bound), inside(value, spans[middle:], bound)
    return F.when(value < F.lit(bound(spans[middle][0])), left).when(value.isNotNull(), right)


def mark_local(df: DataFrame, ip: str = "dest_ip", out: str = "local") -> DataFrame:
    """Add whether an address is not globally routable.

    The address is turned into a number (v4) or 32 hex digits (v6) once, as a column of its
    own, and then looked up in the sorted intervals of the blocks. A text that is no address is not
    local, a null neither.
    """
    address = F.col(ip)
    is_v6 = address.contains(":")
    parsed = df.withColumns(
        {"_v4": F.when(~is_v6, v4_number(address)), "_v6": F.when(is_v6, v6_digits(address))}
    )
    in_v4 = inside(F.col("_v4"), intervals(NOT_GLOBAL_V4), int)
    in_v6 = inside(F.col("_v6"), intervals(NOT_GLOBAL_V6), lambda a: f"{a:032x}")
    return parsed.withColumn(out, F.coalesce(in_v4, in_v6, F.lit(False))).drop("_v4", "_v6")
