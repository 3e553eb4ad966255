"""Scalar functions of the insights dialect as column expressions."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakelogs.functions.times import epoch_millis, floor_to

_BIN = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}
_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"^{_OCTET}(\.{_OCTET}){{3}}$"
_H = r"[0-9a-fA-F]{1,4}"
IPV6 = (
    rf"^(({_H}:){{7}}{_H}|({_H}:){{1,7}}:|({_H}:){{1,6}}:{_H}|({_H}:){{1,5}}(:{_H}){{1,2}}|({_H}:){{1,4}}(:{_H}){{1,3}}"
    rf"|({_H}:){{1,3}}(:{_H}){{1,4}}|({_H}:){{1,2}}(:{_H}){{1,5}}|{_H}:(:{_H}){{1,6}}|:((:{_H}){{1,7}}|:))$"
)


def number(col: Column) -> Column:
    return col.try_cast("double")


def substr(col: Column, start: int, length: int | None = None) -> Column:
    """Zero-based."""
    return F.substring(col, start + 1, length if length is not None else 2**31 - 1)


def strcontains(col: Column, text: str) -> Column:
    return F.when(col.contains(text), 1).otherwise(0)


def isempty(col: Column) -> Column:
    return F.coalesce(col, F.lit("")) == ""


def isblank(col: Column) -> Column:
    return F.trim(F.coalesce(col, F.lit(""))) == ""


def from_millis(col: Column) -> Column:
    return F.timestamp_millis(col.cast("long")).cast("timestamp_ntz")


def bin_millis(ts: Column, n: int, unit: str = "h") -> Column:
    """Start of the bin as epoch milliseconds."""
    return floor_to(epoch_millis(ts), n * _BIN[unit])


def json_parse(col: Column) -> Column:
    return F.try_parse_json(col)


def is_ipv4(col: Column) -> Column:
    return F.coalesce(col.rlike(IPV4), F.lit(False))


def is_ipv6(col: Column) -> Column:
    return F.coalesce(col.rlike(IPV6), F.lit(False))


def is_ip(col: Column) -> Column:
    return is_ipv4(col) | is_ipv6(col)


def ipv4_number(col: Column) -> Column:
    """The address as a number, null if it isn't one."""
    part = F.split(col, r"\.")
    value = sum((F.element_at(part, i + 1).cast("long") * 256 ** (3 - i) for i in range(1, 4)), F.element_at(part, 1).cast("long") * 256**3)
    return F.when(is_ipv4(col), value)


def in_ipv4_subnet(col: Column, subnet: str) -> Column:
    net = ipaddress.IPv4Network(subnet, strict=False)
    low = int(net.network_address)
    return F.coalesce(ipv4_number(col).between(low, low + net.num_addresses - 1), F.lit(False))


def in_ipv6_subnet(col: Column, subnet: str) -> Column:
    """The one function without a built-in form: addresses are compared by the standard library, in Arrow batches."""

    @F.pandas_udf(T.BooleanType())
    def inside(addresses: pd.Series) -> pd.Series:
        net = ipaddress.IPv6Network(subnet, strict=False)

        def one(a: str | None) -> bool:
            try:
                return ipaddress.IPv6Address(a) in net
            except ValueError:
                return False

        return addresses.map(one).astype(bool)

    return inside(col)


#: name -> column function of (first argument, further literals)
FUNCTIONS = {
    "abs": lambda c: F.abs(number(c)), "ceil": lambda c: F.ceil(number(c)), "floor": lambda c: F.floor(number(c)), "log": lambda c: F.ln(number(c)), "sqrt": lambda c: F.sqrt(number(c)),
    "strlen": F.length, "toupper": F.upper, "tolower": F.lower, "substr": substr, "replace": lambda c, a, b: F.replace(c, F.lit(a), F.lit(b)), "concat": lambda c, *more: F.concat(c, *map(F.lit, more)),
    "trim": F.trim, "ltrim": F.ltrim, "rtrim": F.rtrim, "strcontains": strcontains, "ispresent": lambda c: c.isNotNull(), "isempty": isempty, "isblank": isblank,
    "coalesce": lambda c, *more: F.coalesce(c, *map(F.lit, more)), "fromMillis": from_millis, "toMillis": epoch_millis, "bin": bin_millis, "jsonParse": json_parse,
    "isValidIpV4": is_ipv4, "isValidIpV6": is_ipv6, "isValidIp": is_ip, "isIpv4InSubnet": in_ipv4_subnet, "isIpInSubnet": in_ipv4_subnet, "isIpv6InSubnet": in_ipv6_subnet,
    "now": lambda *_: F.current_timestamp().cast("timestamp_ntz"),
}
