"""Addresses and network errors: which addresses are not public, and what kind an error is."""

from __future__ import annotations

import socket

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

# fixed values: reserved IPv4 ranges
RESERVED_V4 = [
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24),
    ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
]
# fixed values: codes by kind
DNS_CODES = ["ENOTFOUND", "EAI_AGAIN"]
CONNECTION_CODES = ["ECONNREFUSED", "ECONNRESET", "ETIMEDOUT", "EHOSTUNREACH", "ENETUNREACH", "EPIPE", "ECONNABORTED"]
TLS_CODES = ["DEPTH_ZERO_SELF_SIGNED_CERT", "UNABLE_TO_VERIFY_LEAF_SIGNATURE", "SELF_SIGNED_CERT_IN_CHAIN", "UNABLE_TO_GET_ISSUER_CERT_LOCALLY", "HOSTNAME_MISMATCH"]
MAX_CAUSES = 5
_V4 = r"\A(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?!\z)|\z)){4}\z"


def _number(address: str) -> int:
    return int.from_bytes(socket.inet_aton(address), "big")


V4_BOUNDS = [(_number(a), _number(a) + (1 << 32 - n) - 1) for a, n in RESERVED_V4]


def ipv4_number(address: Column) -> Column:
    """As a long; null unless it is four octets without leading zeros."""
    octets = F.split(address, r"\.")
    n = F.lit(0).cast("long")
    for i in range(4):
        n = n * 256 + F.try_element_at(octets, F.lit(i + 1)).try_cast("long")
    return F.when(address.rlike(_V4), n)


def ipv4_reserved(address: Column) -> Column:
    """Not public, or no address at all."""
    n = ipv4_number(address)
    found = F.lit(False)
    for low, high in V4_BOUNDS:
        found = found | n.between(low, high)
    return F.coalesce(found, F.lit(True))


def address_reserved(address: str | None) -> bool:
    """The same of IPv4 and IPv6; an IPv6 address that embeds an IPv4 one is judged by that."""
    if not address:
        return True
    v4 = lambda n: any(low <= n <= high for low, high in V4_BOUNDS)
    try:
        return v4(int.from_bytes(socket.inet_pton(socket.AF_INET, address), "big"))
    except (OSError, ValueError):
        pass
    try:
        n = int.from_bytes(socket.inet_pton(socket.AF_INET6, address.split("%")[0]), "big")
    except (OSError, ValueError):
        return True
    if n < 2 or n >> 121 == 0xFC >> 1 or n >> 118 == 0xFE80 >> 6:
        return True
    return n >> 32 in (0, 0xFFFF, 0x64FF9B << 64) and v4(n & 0xFFFFFFFF)


@F.pandas_udf(BooleanType())
def ip_reserved(address: pd.Series) -> pd.Series:
    return address.map(address_reserved).astype(bool)


def error_kind(code: Column) -> Column:
    """dns, tls, connection or null."""
    return (
        F.when(code.isin(DNS_CODES), "dns")
        .when(code.startswith("CERT_") | code.startswith("ERR_TLS_") | code.isin(TLS_CODES), "tls")
        .when(code.isin(CONNECTION_CODES) | code.startswith("ERR_HTTP2_"), "connection")
    )


def classify_causes(causes: Column) -> Column:
    """causes: array<struct<code, message>>, outermost first -> struct(kind, detail). The first cause of a
    known kind decides, of the first MAX_CAUSES; else it is unknown, with the innermost message."""
    near = F.slice(causes, 1, MAX_CAUSES)
    known = F.filter(near, lambda c: error_kind(c["code"]).isNotNull())
    first = F.try_element_at(known, F.lit(1))["code"]
    messages = F.filter(near, lambda c: c["message"].isNotNull())
    kind = F.coalesce(error_kind(first), F.lit("unknown"))
    return F.struct(kind.alias("kind"), F.when(kind == "unknown", F.try_element_at(messages, F.lit(-1))["message"]).otherwise(first).alias("detail"))
