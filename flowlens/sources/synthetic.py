"""Frames made to order: for tests, and from table rows as column expressions."""

from __future__ import annotations

import random
import struct
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

SYN, ACK, PSH, FIN, RST = 0x02, 0x10, 0x08, 0x01, 0x04
_MACS = bytes.fromhex("020000000002020000000001")
_OWN_HEADER = "User-Agent: flowlens"


def _vector(data: bytes, width: int) -> bytes:
    return len(data).to_bytes(width, "big") + data


def _numbers(values: Iterable[int]) -> bytes:
    return b"".join(struct.pack(">H", v) for v in values)


def extension(kind: int, body: bytes) -> bytes:
    return struct.pack(">H", kind) + _vector(body, 2)


def sni_extension(name: str) -> bytes:
    return extension(0, _vector(b"\0" + _vector(name.encode("latin-1"), 2), 2))


def client_hello(name: str | None, ciphers: Iterable[int] = (0x1301, 0x1302), extensions: bytes | None = None) -> bytes:
    """A TLS record with a hello; without extensions given, those for the name and TLS 1.3."""
    if extensions is None:
        extensions = (sni_extension(name) if name is not None else b"") + extension(0x2B, b"\x02\x03\x04")
    body = b"\x03\x03" + bytes(32) + b"\0" + _vector(_numbers(ciphers), 2) + b"\x01\0" + _vector(extensions, 2)
    return b"\x16\x03\x01" + _vector(b"\x01" + _vector(body, 3), 2)


def http_get(host: str, path: str = "/") -> bytes:
    return f"GET {path} HTTP/1.1\r\nHost: {host}\r\n{_OWN_HEADER}\r\n\r\n".encode("latin-1")


def dns_query(name: str) -> bytes:
    labels = b"".join(_vector(x.encode("latin-1"), 1) for x in name.split("."))
    return struct.pack(">6H", 1, 0x0100, 1, 0, 0, 0) + labels + b"\0" + struct.pack(">2H", 1, 1)


def frame(src: str, dst: str, src_port: int, dst_port: int, payload: bytes = b"", flags: int | None = ACK, seq: int = 1000, ack: int = 0, ttl: int = 64) -> bytes:
    """An Ethernet frame with TCP, or with UDP where flags is None."""
    if flags is None:
        body = struct.pack(">4H", src_port, dst_port, 8 + len(payload), 0) + payload
    else:
        body = struct.pack(">2H2I2B3H", src_port, dst_port, seq % 2**32, ack, 0x50, flags, 65535, 0, 0) + payload
    address = lambda a: bytes(map(int, a.split(".")))
    head = struct.pack(">2B3H2BH", 0x45, 0, 20 + len(body), 0, 0x4000, ttl, 17 if flags is None else 6, 0) + address(src) + address(dst)
    return _MACS + b"\x08\x00" + head + body


# Names and services of the sample capture.
SAMPLE_TLS = ["www.google.com", "www.youtube.com", "www.facebook.com", "www.instagram.com", "twitter.com", "www.amazon.com", "www.netflix.com", "github.com", "discord.com", "zoom.us", "web.telegram.org", "www.tiktok.com", "open.spotify.com", "www.cloudflare.com", "www.microsoft.com", "www.apple.com"]
SAMPLE_HTTP = ["example.com", "httpbin.org"]
SAMPLE_DNS = ["www.google.com", "www.youtube.com", "www.facebook.com", "api.twitter.com"]
SAMPLE_CLIENT, SAMPLE_BLOCKED = "192.168.1.100", "192.168.1.50"


def sample_frames(seed: int = 7) -> list[bytes]:
    """A capture with 16 TLS flows, 2 HTTP requests, 4 DNS queries and 5 connection attempts from one more client."""
    rng = random.Random(seed)
    out = []
    for k, name in enumerate(SAMPLE_TLS):
        port, server, seq = rng.randint(49152, 65000), f"142.250.{k}.10", rng.randrange(2**32)
        out += [
            frame(SAMPLE_CLIENT, server, port, 443, flags=SYN, seq=seq),
            frame(server, SAMPLE_CLIENT, 443, port, flags=SYN | ACK, seq=5000, ack=(seq + 1) % 2**32),
            frame(SAMPLE_CLIENT, server, port, 443, flags=ACK, seq=seq + 1, ack=5001),
            frame(SAMPLE_CLIENT, server, port, 443, client_hello(name), PSH | ACK, seq + 1, 5001),
        ]
    for name in SAMPLE_HTTP:
        port = rng.randint(49152, 65000)
        out += [frame(SAMPLE_CLIENT, "93.184.216.34", port, 80, flags=SYN, seq=1000), frame(SAMPLE_CLIENT, "93.184.216.34", port, 80, http_get(name), PSH | ACK, 1001, 5001)]
    out += [frame(SAMPLE_CLIENT, "8.8.8.8", rng.randint(49152, 65000), 53, dns_query(name), None) for name in SAMPLE_DNS]
    return out + [frame(SAMPLE_BLOCKED, "172.217.0.100", 40000 + k, 443, flags=SYN, seq=1000) for k in range(5)]


def frame_rows(frames: Iterable[bytes], source: str = "memory") -> list[tuple]:
    """Rows with the schema of a capture; a frame each millisecond."""
    return [(source, k, 1_700_000_000 + k // 1000, k % 1000 * 1000, len(f), len(f), 1, f) for k, f in enumerate(frames)]


def _hex(value: Column, n: int) -> Column:
    return F.lpad(F.hex(value.cast("long")), 2 * n, "0")


def address_hex(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, r"\."), lambda x: _hex(x.cast("int"), 1)), "")


def _sized(hexed: Column, n: int) -> Column:
    return F.concat(_hex(F.length(hexed) / 2, n), hexed)


def client_hello_hex(name: Column, ciphers_hex: Column | None = None) -> Column:
    """The bytes of client_hello, in hexadecimal."""
    listed = F.concat(F.lit("00"), _sized(F.hex(name.cast("binary")), 2))
    extensions = F.concat(F.lit("0000"), _sized(_sized(listed, 2), 2), F.lit("002B0003020304"))
    body = F.concat(F.lit("0303" + "00" * 33), _sized(F.lit("13011302") if ciphers_hex is None else ciphers_hex, 2), F.lit("0100"), _sized(extensions, 2))
    return F.concat(F.lit("160301"), _sized(F.concat(F.lit("01"), _sized(body, 3)), 2))


def http_get_hex(host: Column) -> Column:
    return F.hex(F.concat(F.lit("GET / HTTP/1.1\r\nHost: "), host, F.lit(f"\r\n{_OWN_HEADER}\r\n\r\n")).cast("binary"))


def dns_query_hex(name: Column) -> Column:
    labels = F.array_join(F.transform(F.split(name, r"\."), lambda x: _sized(F.hex(x.cast("binary")), 1)), "")
    return F.concat(F.lit("000101000001000000000000"), labels, F.lit("0000010001"))


def frame_bytes(src: Column, dst: Column, src_port: Column, dst_port: Column, protocol: Column, flags: Column, seq: Column, payload_hex: Column) -> Column:
    """The bytes of frame()."""
    ports = F.concat(_hex(src_port, 2), _hex(dst_port, 2))
    size = F.length(payload_hex) / 2
    tcp = F.concat(ports, _hex(seq, 4), F.lit("0000000050"), _hex(flags, 1), F.lit("FFFF00000000"), payload_hex)
    udp = F.concat(ports, _hex(size + 8, 2), F.lit("0000"), payload_hex)
    total = size + F.when(protocol == 6, 40).otherwise(28)
    head = F.concat(F.lit("4500"), _hex(total, 2), F.lit("0000400040"), _hex(protocol, 1), F.lit("0000"), address_hex(src), address_hex(dst))
    return F.unhex(F.concat(F.lit(_MACS.hex().upper() + "0800"), head, F.when(protocol == 6, tcp).otherwise(udp)))
