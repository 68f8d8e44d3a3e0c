"""Decoding, extractors, fingerprints and text forms."""

import hashlib
import random
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowlens.functions import fingerprint, l7, text
from flowlens.functions.decode import decode, transport_only
from flowlens.schemas import FRAMES
from flowlens.sources import synthetic as syn


def frames(spark, items):
    return spark.createDataFrame(syn.frame_rows(items), FRAMES)


def one(spark, expression, value, kind="binary"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v")).alias("r")).first()["r"]


GREASE_EXTENSIONS = syn.sni_extension("example.com") + syn.extension(0x0A, bytes.fromhex("00060a0a001d0017")) + syn.extension(0x0B, b"\x01\x00") + syn.extension(0x2B, bytes.fromhex("0403040303")) + syn.extension(0x10, bytes.fromhex("0003026832"))


def test_tcp_frame(spark):
    f = syn.frame("192.168.0.1", "8.8.8.8", 54321, 443, b"hello", syn.PSH | syn.ACK, 0xFFFFFFF0, 7)
    r = decode(frames(spark, [f])).first()
    assert (r.parse_ok, r.src_ip, r.dst_ip, r.src_port, r.dst_port, r.ttl, r.protocol) == (True, "192.168.0.1", "8.8.8.8", 54321, 443, 64, 6)
    assert (r.seq, r.ack, r.tcp_flags, r.payload_offset, r.payload_length, bytes(r.payload)) == (0xFFFFFFF0, 7, 0x18, 54, 5, b"hello")
    assert (r.src_mac, r.dst_mac, r.ether_type, r.ip_version) == ("02:00:00:00:00:01", "02:00:00:00:00:02", 0x0800, 4)
    assert r.src_ip_le == 192 + (168 << 8) + (1 << 24)


def test_frames_that_do_not_parse(spark):
    whole = syn.frame("1.2.3.4", "5.6.7.8", 1, 2, b"xyz")
    cases = [b"", b"\1\2\3", whole[:24], whole[:42], whole[:14] + b"\x65" + whole[15:], whole[:14] + b"\x44" + whole[15:], whole[:46] + b"\x40" + whole[47:], whole[:46] + b"\xf0" + whole[47:]]
    assert [r.parse_ok for r in decode(frames(spark, cases)).orderBy("frame_no").collect()] == [False] * len(cases)


def test_frames_without_transport(spark):
    whole = syn.frame("1.2.3.4", "5.6.7.8", 1, 2, b"xyz")
    icmp, v6 = whole[:23] + b"\x01" + whole[24:], whole[:12] + b"\x86\xdd" + whole[14:]
    got = decode(frames(spark, [icmp, v6, whole])).orderBy("frame_no")
    rows = got.collect()
    assert [(r.parse_ok, r.has_ip, r.has_tcp or r.has_udp) for r in rows] == [(True, True, False), (True, False, False), (True, True, True)]
    assert [(r.payload_offset, r.payload_length) for r in rows] == [(34, 23), (14, 43), (54, 3)]
    assert [r.frame_no for r in transport_only(got).collect()] == [2]


def test_padding_is_payload_unless_trimmed(spark):
    padded = syn.frame("1.2.3.4", "5.6.7.8", 1, 2) + b"\0" * 6
    assert decode(frames(spark, [padded])).first().payload_length == 6
    assert decode(frames(spark, [padded]), trim_padding=True).first().payload_length == 0


def _plain(f):
    """An independent reading of a frame: (parse_ok, has_ip, transport, payload)."""
    if len(f) < 14:
        return False, False, None, None
    if f[12:14] != b"\x08\x00":
        return True, False, None, f[14:]
    end = 14 + (f[14] & 15) * 4 if len(f) > 14 else 0
    if len(f) < 34 or f[14] >> 4 != 4 or end < 34 or len(f) < end:
        return False, False, None, None
    if f[23] == 6:
        if len(f) < end + 20 or f[end + 12] >> 4 < 5 or len(f) < end + (f[end + 12] >> 4) * 4:
            return False, True, None, None
        return True, True, struct.unpack_from(">HHI", f, end), f[end + (f[end + 12] >> 4) * 4 :]
    if f[23] == 17:
        return (True, True, struct.unpack_from(">HH", f, end), f[end + 8 :]) if len(f) >= end + 8 else (False, True, None, None)
    return True, True, None, f[end:]


def test_decoder_against_a_plain_one(spark):
    rng = random.Random(1)
    items = []
    for _ in range(400):
        f = bytearray(syn.frame("10.1.2.3", "10.4.5.6", rng.randrange(65536), rng.randrange(65536), rng.randbytes(rng.randrange(30)), rng.choice([2, 24, None])))
        for _ in range(rng.randrange(3)):
            f[rng.randrange(12, len(f))] = rng.randrange(256)
        items.append(bytes(f[: rng.randrange(len(f) + 1)] if rng.random() < 0.4 else f))
    for r, f in zip(decode(frames(spark, items)).orderBy("frame_no").collect(), items):
        ok, has_ip, transport, payload = _plain(f)
        assert (r.parse_ok, r.has_ip) == (ok, has_ip), f
        if ok:
            assert bytes(r.payload or b"") == payload
        if transport:
            assert (r.src_port, r.dst_port) == transport[:2] and (len(transport) < 3 or r.seq == transport[2])


def test_text_forms(spark):
    row = spark.createDataFrame([(0x12, 0, 0x3F, 6, 1, 99, 0x0303)], "a int, b int, c int, p int, q int, u int, v int").select(
        text.tcp_flags_text(F.col("a")), text.tcp_flags_text(F.col("b")), text.tcp_flags_text(F.col("c")), text.protocol_text(F.col("p")), text.protocol_text(F.col("q")), text.protocol_text(F.col("u")), text.tls_version_text(F.col("v")), text.tls_version_text(F.col("u")), text.flow_text(F.lit("1.2.3.4"), F.lit(5), F.lit("6.7.8.9"), F.lit(80), F.col("p"))
    )
    assert tuple(row.first()) == ("SYN ACK", "none", "SYN ACK FIN RST PSH URG", "TCP", "ICMP", "Unknown(99)", "TLS1.2", "?", "1.2.3.4:5 -> 6.7.8.9:80 (TCP)")
    assert bytes(one(spark, text.hex_bytes, "de:ad be-e", "string")) == b"\xde\xad\xbe"
    assert one(spark, text.payload_preview, b"\x01\xff") == "01 ff"


@pytest.mark.parametrize(
    "payload, host",
    [
        (b"GET / HTTP/1.1\r\nHost: www.example.org:8080\r\n\r\n", "www.example.org"),
        (b"POST /x HTTP/1.1\r\nhOsT:\t a.b \r\n", "a.b "),
        (b"GET /?host:inpath HTTP/1.1\r\n\r\n", "inpath HTTP/1.1"),
        (b"GET / HTTP/1.1\r\nHost:  \r\nhost: second\r\n", "second"),
        (b"GET / HTTP/1.1\r\nHost: :80\r\n", ""),
        (b"GET / HTTP/1.1\r\nHost: cut.off", "cut.off"),
        (b"GET Host:a", None),
        (b"GET Host:ab", "ab"),
        (b"FETCH / HTTP/1.1\r\nHost: a\r\n", None),
        (b"GET", None),
        (b"", None),
    ],
)
def test_http_host(spark, payload, host):
    assert one(spark, l7.http_host, payload) == host == l7.host_of_request(payload)


def test_dns_and_quic_names():
    assert l7.dns_qname(syn.dns_query("www.example.com")) == "www.example.com"
    answer = bytearray(syn.dns_query("www.example.com"))
    answer[2] |= 0x80
    assert l7.dns_qname(bytes(answer)) is None and l7.dns_qname(b"\0\1\2") is None and l7.dns_qname(None) is None
    assert l7.dns_qname(syn.dns_query("www.example.com")[:18]) == "www" and l7.dns_qname(syn.dns_query("a")[:12] + b"\xc0\x0c") is None
    blob = b"\xc0\0\0\0\1" + bytes(8) + syn.client_hello("quic.example.com")
    assert l7.quic_sni(blob) == "quic.example.com" and l7.quic_sni(b"\x40" + blob[1:]) is None and l7.quic_sni(b"\x16" * 80) is None


def test_sni_needs_a_complete_record():
    hello = syn.client_hello("www.example.com")
    assert l7.tls_sni(hello) == "www.example.com"
    assert all(l7.tls_sni(hello[:n]) is None for n in range(len(hello)))
    assert l7.tls_sni(hello[:1] + b"\x03\x05" + hello[3:]) is None
    assert l7.tls_sni(b"\x16" * 64) is None


@given(st.binary(max_size=200) | st.integers(0, 200).map(lambda n: syn.client_hello("a.b", extensions=GREASE_EXTENSIONS)[:n]))
@settings(max_examples=300, deadline=None)
def test_walkers_never_raise(data):
    for walk in (l7.parse_client_hello, l7.tls_sni, l7.quic_sni, l7.dns_qname, l7.host_of_request):
        walk(data)


def test_a_cut_hello_still_counts():
    hello = syn.client_hello("www.example.com", extensions=GREASE_EXTENSIONS)
    whole = l7.parse_client_hello(hello)
    assert (whole.sni, whole.negotiated_version, whole.alpn, whole.groups) == ("www.example.com" and "example.com", 0x0304, [b"h2"], [0x0A0A, 0x1D, 0x17])
    part = l7.parse_client_hello(hello[:60])
    assert part and part.ciphers == [0x1301, 0x1302] and not part.has_sni
    assert l7.parse_client_hello(hello[:45]) is None


GOLDEN = [
    (syn.client_hello("www.example.com"), "771,4865-4866,0-43,,", "c1ef87234d1f4958b95c016a1a7100df", "t13d020200_62ed6f6ca7ad_9b00d4eb1ff0"),
    (syn.client_hello("x", (0x1301,), syn.sni_extension("x")), "771,4865,0,,", "1e7c622032b0cb79401b0f7be3793a1a", "t12d010100_0f2cb44170f4_d2e2adf7177b"),
    (syn.client_hello(None, (0x0A0A, 0x1301, 0x1302), syn.sni_extension("example.com") + syn.extension(0x0A, bytes.fromhex("00060a0a001d0017")) + syn.extension(0x0B, b"\x01\x00") + syn.extension(0x2B, bytes.fromhex("0403040303")) + syn.extension(0x10, bytes.fromhex("0003026832"))), "771,4865-4866,0-10-11-43-16,29-23,0", "26effd700a2192fb1f8524bd18622ed8", None),
]


def test_fingerprints(spark):
    df = spark.createDataFrame([(k, g[0]) for k, g in enumerate(GOLDEN)], "k int, v binary")
    h = l7.client_hello_column(F.col("v")).alias("h")
    rows = df.select("k", h).select("k", fingerprint.ja3_string(F.col("h")).alias("s"), fingerprint.ja3(F.col("h")).alias("m"), fingerprint.ja4(F.col("h")).alias("j"), fingerprint.ja4(F.col("h"), True).alias("q")).orderBy("k").collect()
    for r, (data, string, digest, ja4) in zip(rows, GOLDEN):
        hello = l7.parse_client_hello(data)
        assert r.s == string == fingerprint.ja3_string_of(hello)
        assert r.m == digest == hashlib.md5(string.encode()).hexdigest() == fingerprint.ja3_of(hello)
        assert r.j == fingerprint.ja4_of(hello) and (ja4 is None or r.j == ja4)
        assert r.q == fingerprint.ja4_of(hello, True) and r.q[0] == "q"
    assert rows[2].j.startswith("t13d0205h2_62ed6f6ca7ad_")


def test_hello_without_extensions(spark):
    bare = l7.Hello(legacy_version=0x0303, negotiated_version=0x0303)
    assert fingerprint.ja4_of(bare) == f"t12i000000_{'0' * 12}_{'0' * 12}"


def test_expressions_make_the_same_bytes(spark):
    row = spark.createDataFrame([("a.example.com",)], "h string").select(
        F.unhex(syn.client_hello_hex(F.col("h"))).alias("c"), F.unhex(syn.http_get_hex(F.col("h"))).alias("g"), F.unhex(syn.dns_query_hex(F.col("h"))).alias("d"),
        syn.frame_bytes(F.lit("1.2.3.4"), F.lit("5.6.7.8"), F.lit(9), F.lit(53), F.lit(17), F.lit(0), F.lit(0), syn.dns_query_hex(F.col("h"))).alias("u"),
        syn.frame_bytes(F.lit("1.2.3.4"), F.lit("5.6.7.8"), F.lit(9), F.lit(80), F.lit(6), F.lit(24), F.lit(4294967295), syn.http_get_hex(F.col("h"))).alias("t"),
    ).first()
    assert [bytes(x) for x in row] == [syn.client_hello("a.example.com"), syn.http_get("a.example.com"), syn.dns_query("a.example.com"), syn.frame("1.2.3.4", "5.6.7.8", 9, 53, syn.dns_query("a.example.com"), None), syn.frame("1.2.3.4", "5.6.7.8", 9, 80, syn.http_get("a.example.com"), 24, 4294967295)]


def test_registered_functions(spark):
    l7.register(spark)
    spark.createDataFrame([(syn.client_hello("a.b"), syn.dns_query("c.d"), syn.http_get("e.f"))], "t binary, d binary, h binary").createOrReplaceTempView("payloads")
    assert tuple(spark.sql("select tls_sni(t), dns_qname(d), http_host(h) from payloads").first()) == ("a.b", "c.d", "e.f")
