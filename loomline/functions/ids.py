"""Deterministic identities: uuid5 of a message, shortened md5 ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the DNS namespace of RFC 4122.
NAMESPACE_DNS = "6ba7b8109dad11d180b400c04fd430c8"


def ts_repr(ts: Column) -> Column:
    """An epoch string as Python prints its float: trailing zeros go, one digit stays."""
    return F.regexp_replace(F.regexp_replace(ts, r"0+$", ""), r"\.$", ".0")


def ts_micros(ts: Column) -> Column:
    """An epoch string as a timestamp, exactly: never through a double."""
    return F.timestamp_micros((ts.cast("decimal(20,6)") * F.lit(1000000)).cast("bigint"))


def uuid5(name: Column, namespace: str = NAMESPACE_DNS) -> Column:
    """uuid5 in built-in functions: SHA-1 of namespace and name, with version and variant set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    part = lambda a, n: F.substring(h, a, n)
    nibble = F.element_at(F.array(*map(F.lit, "89ab")), (F.conv(part(17, 1), 16, 10).cast("int") % 4) + 1)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), nibble, part(18, 3), F.lit("-"), part(21, 12))


def message_id(text: Column, ts: Column) -> Column:
    return uuid5(F.concat(text, F.lit(":"), ts_repr(ts)))


def short_md5(prefix: str, text: Column, digits: int = 10) -> Column:
    """``prefix`` and the first digits of the text's md5. 40 bits collide; see export.collisions."""
    return F.concat(F.lit(prefix), F.substring(F.md5(text), 1, digits))
