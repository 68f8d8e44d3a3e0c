"""Text forms of packet fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bits of the TCP flags in the order in which they are named, protocols, and TLS versions.
FLAGS = [(0x02, "SYN"), (0x10, "ACK"), (0x01, "FIN"), (0x04, "RST"), (0x08, "PSH"), (0x20, "URG")]
PROTOCOLS = {1: "ICMP", 6: "TCP", 17: "UDP"}
TLS_VERSIONS = {0x0304: "TLS1.3", 0x0303: "TLS1.2", 0x0302: "TLS1.1", 0x0301: "TLS1.0", 0x0300: "SSL3.0"}


def _named(value: Column, names: dict[int, str], other: Column) -> Column:
    out = F
    for k, name in names.items():
        out = out.when(value == k, name)
    return out.otherwise(other)


def tcp_flags_text(flags: Column) -> Column:
    named = F.concat_ws(" ", *[F.when(flags.bitwiseAND(F.lit(bit)) != 0, name) for bit, name in FLAGS])
    return F.coalesce(F.nullif(named, F.lit("")), F.lit("none"))


def protocol_text(protocol: Column) -> Column:
    return _named(protocol, PROTOCOLS, F.format_string("Unknown(%d)", protocol))


def tls_version_text(version: Column) -> Column:
    return _named(version, TLS_VERSIONS, F.lit("?"))


def flow_text(src_ip: Column, src_port: Column, dst_ip: Column, dst_port: Column, protocol: Column) -> Column:
    known = _named(protocol, {6: "TCP", 17: "UDP"}, F.lit("?"))
    return F.format_string("%s:%d -> %s:%d (%s)", src_ip, src_port, dst_ip, dst_port, known)


def payload_preview(payload: Column, n: int = 32) -> Column:
    """The first bytes in hexadecimal, spaced."""
    return F.regexp_replace(F.lower(F.hex(F.substring(payload, 1, n))), "(..)(?!$)", "$1 ")


def hex_bytes(text: Column) -> Column:
    """Bytes written in hexadecimal; other characters and a last odd digit are left out."""
    digits = F.regexp_replace(text, "[^0-9A-Fa-f]", "")
    return F.unhex(F.substring(digits, F.lit(1), (F.length(digits) - F.length(digits) % 2).cast("int")))
