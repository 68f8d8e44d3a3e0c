"""Ethernet, IPv4, TCP and UDP headers of frames.

All numbers of a batch's headers are read in one vectorised pass over its joined bytes, which hands back a struct of a
few numbers for each frame; texts, the payload and everything else are JVM expressions over these. Frames stay where
they are: only their bytes go to the pass, and nothing comes back but numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ETHERNET, IPV4, TCP_LEAST, UDP = 14, 0x0800, 20, 8
TCP_PROTOCOL, UDP_PROTOCOL = 6, 17

#: What orders packets as they arrived, as far as the columns are there: the latest time in a capture up to the frame, so
#: that a capture's own order always holds, then the capture and the number of the frame in it.
ARRIVAL = ["arrived", "source", "frame_no"]

_INTS = ["ether_type", "_version", "ttl", "_protocol", "_header_end", "src_port", "dst_port", "_total", "_tcp_word"]
_LONGS = ["src_ip_le", "dst_ip_le", "seq", "ack"]
_HEADER = pa.struct([*[(c, pa.int32()) for c in _INTS], *[(c, pa.int64()) for c in _LONGS]])
_HEADER_DDL = ", ".join([*[f"{c} int" for c in _INTS], *[f"{c} long" for c in _LONGS]])
#: Bytes of a frame that headers can take up: Ethernet, IPv4 and the fixed part of TCP.
_READ = ETHERNET + 60 + TCP_LEAST


def _headers(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The numbers that stand where headers would have them; what lies beyond a frame's end is 0, and decode() ignores it."""
    for frames in batches:
        frames = frames.cast(pa.large_binary())
        offsets = np.frombuffer(frames.buffers()[1], np.int64)[frames.offset : frames.offset + len(frames) + 1]
        sizes = np.where(np.asarray(frames.is_null()), 0, np.diff(offsets))
        data = np.frombuffer(frames.buffers()[2] or b"", np.uint8)
        head = np.zeros((len(frames), _READ), np.int64)
        at = np.arange(_READ)
        inside = at < sizes[:, None]
        head[inside] = data[(offsets[:-1, None] + at)[inside]]
        rows = np.arange(len(frames))
        end = ETHERNET + (head[:, 14] & 15) * 4

        def big(start: np.ndarray | int, n: int) -> np.ndarray:
            out = np.zeros(len(head), np.int64)
            for k in range(n):
                out = out << 8 | head[rows, start + k]
            return out

        address = lambda start: sum(head[:, start + k] << 8 * k for k in range(4))
        ints = [big(12, 2), head[:, 14], head[:, 22], head[:, 23], end, big(end, 2), big(end + 2, 2), big(16, 2), big(end + 12, 2)]
        longs = [address(26), address(30), big(end + 4, 4), big(end + 8, 4)]
        yield pa.StructArray.from_arrays([*[pa.array(x.astype(np.int32)) for x in ints], *[pa.array(np.asarray(x, np.int64)) for x in longs]], fields=list(_HEADER))


def header_numbers(data: Column) -> Column:
    return F.arrow_udf(_headers, _HEADER_DDL)(data)


def arrival(packets: DataFrame) -> Column:
    """A packet's place in the order of arrival."""
    return F.struct(*[c for c in ARRIVAL if c in packets.columns])


def mac_text(data: Column, at: int) -> Column:
    return F.regexp_replace(F.lower(F.hex(F.substring(data, at + 1, 6))), "(..)(?!$)", "$1:")


def ip_text(address: Column) -> Column:
    """The dotted form of an address whose lowest byte is the first octet."""
    return F.concat_ws(".", *[F.shiftright(address, 8 * k).bitwiseAND(F.lit(255)).cast("string") for k in range(4)])


def decode(frames: DataFrame, trim_padding: bool = False) -> DataFrame:
    """frames with decoded headers; nothing is dropped, parse_ok tells what could be read.

    Bytes after the headers are payload up to the frame's end, Ethernet padding included; trim_padding ends it where the
    IPv4 header says.
    """
    h, n = (lambda c: F.col(f"_h.{c}")), F.col("frame_bytes")
    out = frames.withColumns({"frame_bytes": F.octet_length("data"), "_h": header_numbers(F.col("data"))})
    no = F.lit(False)
    ethernet, ipv4, end = n >= ETHERNET, h("ether_type") == IPV4, h("_header_end")
    has_ip = ethernet & ipv4 & (F.shiftright(h("_version"), 4) == 4) & (n >= ETHERNET + 20) & (end >= ETHERNET + 20) & (n >= end)
    out = out.withColumn("has_ip", F.coalesce(has_ip, no))
    is_tcp, is_udp = F.col("has_ip") & (h("_protocol") == TCP_PROTOCOL), F.col("has_ip") & (h("_protocol") == UDP_PROTOCOL)
    tcp_end = end + F.shiftright(h("_tcp_word"), 12) * 4
    out = out.withColumns({"has_tcp": is_tcp & (n >= end + TCP_LEAST) & (tcp_end >= end + TCP_LEAST) & (n >= tcp_end), "has_udp": is_udp & (n >= end + UDP)})
    transport = F.when(is_tcp, F.col("has_tcp")).when(is_udp, F.col("has_udp")).otherwise(True)
    parse_ok = ethernet & F.when(ipv4, F.col("has_ip") & transport).otherwise(True)
    offset = F.when(F.col("has_tcp"), tcp_end).when(F.col("has_udp"), end + UDP).when(F.col("has_ip"), end).otherwise(ETHERNET)
    out = out.withColumns({"parse_ok": F.coalesce(parse_ok, no), "payload_offset": offset})
    last = F.when(F.col("has_ip"), F.least(n, ETHERNET + h("_total"))).otherwise(n) if trim_padding else n
    out = out.withColumn("payload_length", F.when(F.col("parse_ok"), F.greatest(last - F.col("payload_offset"), F.lit(0))))
    ip = lambda c: F.when(F.col("has_ip"), c)
    moved, tcp = F.col("has_tcp") | F.col("has_udp"), F.col("has_tcp")
    length = F.col("payload_length")
    out = out.withColumns({
        "ether_type": F.when(ethernet, h("ether_type").cast("long")),
        "protocol": ip(h("_protocol")),
        "dst_mac": F.when(ethernet, mac_text(F.col("data"), 0)),
        "src_mac": F.when(ethernet, mac_text(F.col("data"), 6)),
        "ip_version": F.when(ethernet & ipv4 & (n > ETHERNET), F.shiftright(h("_version"), 4)),
        "ttl": ip(h("ttl")),
        "src_ip": ip(ip_text(h("src_ip_le"))),
        "dst_ip": ip(ip_text(h("dst_ip_le"))),
        "src_ip_le": ip(h("src_ip_le")),
        "dst_ip_le": ip(h("dst_ip_le")),
        "src_port": F.when(moved, h("src_port")),
        "dst_port": F.when(moved, h("dst_port")),
        "seq": F.when(tcp, h("seq")),
        "ack": F.when(tcp, h("ack")),
        "tcp_flags": F.when(tcp, h("_tcp_word").bitwiseAND(F.lit(255))),
        "payload": F.when(length > 0, F.substring(F.col("data"), F.col("payload_offset") + 1, length)),
    })
    if {"ts_sec", "ts_usec"} <= set(frames.columns):
        out = out.withColumn("ts", F.timestamp_micros(F.col("ts_sec") * 1_000_000 + F.col("ts_usec")))
    return out.drop("_h")


def transport_only(packets: DataFrame) -> DataFrame:
    """Packets that the engines look at: IPv4 with TCP or UDP."""
    return packets.filter("parse_ok and has_ip and (has_tcp or has_udp)")
