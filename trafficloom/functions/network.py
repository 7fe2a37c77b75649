"""IP literals and host names as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficloom.functions.once import compute_once

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_V4 = f"{_OCTET}(?:\\.{_OCTET}){{3}}"
_HEX = "[0-9A-Fa-f]{1,4}"


def _groups(n: int) -> str:
    return "" if n == 0 else f"{_HEX}(?::{_HEX}){{{n - 1}}}"


def _v6_pattern() -> str:
    """Eight groups, or up to seven around one ``::`` (RFC 4291, section 2.2)."""
    shapes = [_groups(8)]
    for high in range(8):
        low = f"{_HEX}(?::{_HEX}){{0,{6 - high}}}" if high < 7 else ""
        shapes.append(f"{_groups(high)}::" + (f"(?:{low})?" if low else ""))
    return "(?:" + "|".join(shapes) + ")"


V4_PATTERN = f"^{_V4}$"
V6_PATTERN = f"^{_v6_pattern()}(?:%[^%/]+)?$"
HOST_PATTERN = "^[A-Za-z0-9](?:[A-Za-z0-9.\\-:_\\[\\]]*[A-Za-z0-9\\]])?$"


def is_ipv4(value: Column) -> Column:
    return value.rlike(V4_PATTERN)


def is_ipv6(value: Column) -> Column:
    # A dotted tail stands for the last two groups.
    plain = F.regexp_replace(value, f"(?<=:){_V4}(?=$|%)", "0:0")
    return plain.rlike(V6_PATTERN)


def is_ip(value: Column) -> Column:
    return F.when(is_ipv4(value), F.lit(True)).when(value.contains(":"), is_ipv6(value)).otherwise(F.lit(False))


def is_host_like(value: Column) -> Column:
    return value.rlike(HOST_PATTERN)


def tunnel_host(target: Column) -> Column:
    """Host of a ``host:port`` target: what precedes the last colon, case kept."""
    port = F.substring_index(target, ":", -1)
    before = F.substring(target, F.lit(1), F.length(target) - F.length(port) - 1)
    return F.when(target.contains(":"), before).otherwise(target)


def _authority_host(authority: Column) -> Column:
    """Host part of a URL authority, NULL when its brackets are malformed."""
    host_port = F.when(authority.contains("@"), F.substring_index(authority, "@", -1)).otherwise(authority)
    inner = F.regexp_extract(host_port, "^\\[([^\\]]*)\\](?::.*)?$", 1)
    bracketed = F.when(is_ipv6(inner) | inner.rlike("^v[0-9A-Fa-f]+\\..+$"), inner)
    has_brackets = authority.contains("[") | authority.contains("]")
    return F.when(has_brackets, bracketed).otherwise(F.substring_index(host_port, ":", 1))


def add_domain(df: DataFrame, url: str, method: str, out: str = "domain") -> DataFrame:
    """Adds the domain of a request, NULL when its target is not host-like.

    Absolute URLs give their host in lower case; CONNECT and scheme-less
    targets keep theirs. Steps are separate columns, so that each costly
    expression runs once per row, also when the result is filtered on.
    """
    url_authority = F.regexp_extract(url, "^[\\x00-\\x20]*[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)", 1)
    tunnel = (F.col(method) == "CONNECT") | ~F.col(url).contains("://")
    found = df.withColumn("__tunnel", tunnel).withColumn("__authority", F.when(~F.col("__tunnel"), url_authority))
    host = F.when(F.col("__tunnel"), tunnel_host(F.col(url))).otherwise(F.lower(_authority_host(F.col("__authority"))))
    named = compute_once(found, "__host", host)
    return named.withColumn(out, F.when(is_host_like(F.col("__host")), F.col("__host"))).drop(
        "__tunnel", "__authority", "__host"
    )


def last_labels(host: Column, n: int) -> Column:
    return F.substring_index(host, ".", -n)
