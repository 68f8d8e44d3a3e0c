"""JA3 and JA4 of a client hello, as column expressions over its arrays and, for single hellos, as plain functions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from .l7 import Hello, is_grease

# Version characters of JA4.
JA4_VERSIONS = {0x0304: "13", 0x0303: "12", 0x0302: "11", 0x0301: "10", 0x0300: "s3"}
_SNI, _ALPN = 0x00, 0x10


def _plain(values: Column) -> Column:
    return F.filter(values, lambda v: ~((v.bitwiseAND(F.lit(0x0F0F)) == 0x0A0A) & (F.shiftright(v, 8) == v.bitwiseAND(F.lit(0xFF)))))


def _dashed(values: Column) -> Column:
    return F.array_join(values, "-")


def _hex4(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda v: F.lower(F.lpad(F.hex(v), 4, "0"))), ",")


def ja3_string(hello: Column) -> Column:
    parts = [_dashed(_plain(hello[c])) for c in ("ciphers", "extensions", "groups")]
    return F.concat_ws(",", hello["legacy_version"].cast("string"), *parts, _dashed(hello["ec_formats"]))


def ja3(hello: Column) -> Column:
    return F.md5(ja3_string(hello).cast("binary"))


def ja4(hello: Column, over_quic: bool = False) -> Column:
    version = F
    for k, v in JA4_VERSIONS.items():
        version = version.when(hello["negotiated_version"] == k, v)
    count = lambda c: F.lpad(F.least(F.size(_plain(hello[c])), F.lit(99)).cast("string"), 2, "0")
    first = F.get(hello["alpn"], 0)
    ends = F.concat(F.substring(first, 1, 1), F.substring(first, -1, 1))
    alpn = F.when(F.octet_length(first) > 0, F.decode(ends, "ISO-8859-1")).otherwise("00")
    a = F.concat(F.lit("q" if over_quic else "t"), version.otherwise("00"), F.when(hello["has_sni"], "d").otherwise("i"), count("ciphers"), count("extensions"), alpn)
    digest = lambda text: F.substring(F.sha2(text, 256), 1, 12)
    none = F.lit("0" * 12)
    b = F.when(F.size(hello["ciphers"]) > 0, digest(_hex4(F.array_sort(_plain(hello["ciphers"]))))).otherwise(none)
    listed = F.filter(_plain(hello["extensions"]), lambda v: ~v.isin(_SNI, _ALPN))
    c = F.concat(_hex4(F.array_sort(listed)), F.lit("_"), _hex4(_plain(hello["sig_algs"])))
    return F.when(hello.isNotNull(), F.concat_ws("_", a, b, F.when(F.size(hello["extensions"]) > 0, digest(c)).otherwise(none)))


def ja3_string_of(h: Hello) -> str:
    kept = lambda values: "-".join(str(v) for v in values if not is_grease(v))
    return ",".join([str(h.legacy_version), kept(h.ciphers), kept(h.extensions), kept(h.groups), "-".join(map(str, h.ec_formats))])


def ja3_of(h: Hello) -> str:
    return hashlib.md5(ja3_string_of(h).encode()).hexdigest()


def ja4_of(h: Hello, over_quic: bool = False) -> str:
    ciphers, extensions = ([v for v in x if not is_grease(v)] for x in (h.ciphers, h.extensions))
    first = h.alpn[0].decode("latin-1") if h.alpn and h.alpn[0] else ""
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()[:12]
    hex4 = lambda values: ",".join(f"{v:04x}" for v in values)
    a = f"{'q' if over_quic else 't'}{JA4_VERSIONS.get(h.negotiated_version, '00')}{'d' if h.has_sni else 'i'}{min(len(ciphers), 99):02d}{min(len(extensions), 99):02d}{first[0] + first[-1] if first else '00'}"
    b = digest(hex4(sorted(ciphers))) if h.ciphers else "0" * 12
    listed = sorted(v for v in extensions if v not in (_SNI, _ALPN))
    algorithms = [v for v in h.sig_algs if not is_grease(v)]
    c = digest(f"{hex4(listed)}_{hex4(algorithms)}") if h.extensions else "0" * 12
    return f"{a}_{b}_{c}"
