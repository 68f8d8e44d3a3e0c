"""Reassembly, signatures, rules, classification, traces, reports, captures and streams."""

import json
import random
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from flowlens import cli, http, log
from flowlens.engine import Engine
from flowlens.functions import l7
from flowlens.functions.decode import decode
from flowlens.operators import classify, explain, flows, policy, reassembly, reports, signatures
from flowlens.operators.reassembly import FirstFlight
from flowlens.schemas import FRAMES, SEGMENTS
from flowlens.sources import pcap
from flowlens.sources import synthetic as syn


def packets(spark, items):
    return decode(spark.createDataFrame(syn.frame_rows(items), FRAMES))


@pytest.fixture(scope="module")
def sample(spark):
    return packets(spark, syn.sample_frames()).cache()


def rules(**values):
    out = policy.BlockRules()
    for kind, items in values.items():
        for v in items:
            out.block(kind, v)
    return out


SCRIPTS = [
    ([(1000, True, b""), (1001, False, b"abc"), (1004, False, b"def")], b"abcdef"),
    ([(500, False, b"abc"), (503, False, b"d")], b"abcd"),
    ([(99, True, b""), (103, False, b"def"), (100, False, b"abc")], b"abcdef"),
    ([(99, True, b""), (106, False, b"ghi"), (103, False, b"def"), (100, False, b"abc")], b"abcdefghi"),
    ([(99, True, b""), (100, False, b"abcdef"), (101, False, b"XX"), (100, False, b"abcdef")], b"abcdef"),
    ([(99, True, b""), (100, False, b"abcd"), (102, False, b"XXef")], b"abcdef"),
    ([(99, True, b""), (100, False, b"abc"), (110, False, b"zzz")], b"abc"),
    ([(0xFFFFFFEF, True, b""), (0xFFFFFFF0, False, b"a" * 16), (0, False, b"b")], b"a" * 16 + b"b"),
    ([(99, True, b"ignored"), (100, False, b"x")], b"x"),
    ([(100, False, b""), (100, False, b"late"), (90, False, b"before")], b"late"),
    ([(99, True, b""), (104, False, b"12"), (104, False, b"123"), (100, False, b"abcd")], b"abcd123"),
    ([(99, True, b""), (104, False, b"123"), (104, False, b"XY"), (100, False, b"abcd")], b"abcd123"),
]


def test_reassembly_scripts(spark):
    rows = [(str(k), n, seq, syn_, data) for k, (script, _) in enumerate(SCRIPTS) for n, (seq, syn_, data) in enumerate(script)]
    got = {r.flow_id: bytes(r.contiguous) for r in reassembly.reassemble(spark.createDataFrame(rows, SEGMENTS).repartition(5)).collect()}
    assert got == {str(k): want for k, (_, want) in enumerate(SCRIPTS)}
    assert reassembly.reassemble(spark.createDataFrame([], SEGMENTS)).count() == 0


def test_reassembly_caps():
    f = FirstFlight(max_bytes=16)
    f.add(1, False, b"x" * 40)
    assert f.full and len(f.data) == 16
    f = FirstFlight(max_segments=4)
    for k in range(6):
        f.add(100 + 10 * k, False, b"y")
    assert f.full and f.segments == 4 and bytes(f.data) == b"y"
    f.clear()
    f.add(100, False, b"z")
    assert f.full and f.started and not f.data


def test_reassembly_of_shuffled_segments():
    rng = random.Random(3)
    for _ in range(200):
        text = rng.randbytes(rng.randint(1, 300))
        cuts = sorted({0, len(text), *(rng.randrange(len(text)) for _ in range(5))})
        parts = [(a, min(len(text), b + rng.randrange(4))) for a, b in zip(cuts, cuts[1:])]
        rng.shuffle(parts)
        start, f = rng.randrange(2**32), FirstFlight()
        f.add(start, True, None)
        for a, b in parts + parts[:2]:
            f.add((start + 1 + a) % 2**32, False, text[a:b])
        assert bytes(f.data) == text


def test_signature_text():
    parsed = signatures.parse("# c\n\n  suffix Example.ORG My App \r\nja3hash ABC T\n")
    assert parsed == [signatures.Rule("suffix", "example.org", "My App"), signatures.Rule("ja3hash", "ABC", "T")]
    for bad, said in (("contains a A\nwhat b B", "s:2: unknown rule kind 'what'"), ("suffix a.b", "s:1: expected '<kind> <pattern> <app>'")):
        with pytest.raises(signatures.SignatureError, match="^" + said.replace("<", ".").replace(">", ".")[:20]):
            signatures.parse(bad, "s")
    with pytest.raises(signatures.SignatureError, match="cannot open"):
        signatures.load("/nowhere/rules")
    assert len(signatures.builtin()) == 54


HOSTS = {"youtube.googleapis.com": "Google", "WWW.YouTube.com": "YouTube", "youtu.be": "YouTube", "notyoutu.be": None, "x.com": "Twitter/X", "max.com": None, "a.x.com": "Twitter/X", "cf-ray.net": "Cloudflare", "": None, "msn.com": "Microsoft"}


def test_host_rules_three_ways(spark):
    own = signatures.builtin()
    df = spark.createDataFrame([(h,) for h in HOSTS], "host string")
    apps = [r.app for r in own]
    by_case = {r.host: r.app for r in df.select("host", signatures.of_rule(signatures.host_rule(F.col("host"), own), apps).alias("app")).collect()}
    by_join = {r.host: r.app for r in signatures.match_hosts(df, "host", signatures.frame(spark, own)).collect()}
    plain = {h: (r := signatures.match_host(h, own)) and r.app for h in HOSTS}
    assert by_case == by_join == plain == HOSTS


def test_fingerprint_rules(spark):
    own = signatures.parse("ja4prefix t13d A\nja4 t12x B\nja3 771,1 C\nja3hash h D\nexact e.org E")
    df = spark.createDataFrame([("t13dzz", "771,1", "q", ""), ("t12x", "0", "h", ""), ("t99", "0", "q", ""), ("t13d", "771,1", "h", "E.org")], "j4 string, s string, j3 string, h string")
    got = [tuple(r) for r in df.select(signatures.label(F.col("h"), F.col("s"), F.col("j3"), F.col("j4"), own), signatures.ja4_rule(F.col("j4"), own)).collect()]
    assert got == [("C", 0), ("D", 1), (None, None), ("E", 0)]
    assert signatures.match_ja4("t13dzz", own).app == "A" and signatures.match_ja3("0", "h", own).app == "D"


def test_rule_files_and_edits(spark):
    r = rules(ip=["1.2.3.4"], app=["YouTube"], domain=["a.org", "*.b.org"], port=["8080"])
    again = policy.BlockRules().load_text(r.to_text() + "[WHAT]\nx\n[BLOCKED_APPS]\nNoSuchApp\n")
    assert again == r and r.stats() == {"ip": 1, "app": 1, "domain": 2, "port": 1}
    assert not r.block("ip", "1.2.3.4") and not r.block("app", "NoSuchApp") and r.unblock("port", 8080) and not r.unblock("port", 8080)
    assert {tuple(x) for x in r.frame(spark).collect()} >= {("domain", "*.b.org", "pattern"), ("ip", "1.2.3.4", "exact")}
    with pytest.raises(ValueError):
        r.block("ip", "abc")
    r.clear()
    assert sum(r.stats().values()) == 0


def test_block_reasons(spark):
    r = rules(ip=["1.1.1.1"], port=[25], app=["YouTube"], domain=["a.org", "*.B.org", "x*y"])
    cases = [("1.1.1.1", 25, "YouTube", "a.org", ("ip", "1.1.1.1")), ("2.2.2.2", 25, "YouTube", "a.org", ("port", "25")), ("2.2.2.2", 1, "YouTube", "", ("app", "YouTube")), ("2.2.2.2", 1, "X", "a.org", ("domain", "a.org")), ("2.2.2.2", 1, "X", "A.org", None), ("2.2.2.2", 1, "X", "z.b.ORG", ("domain", "z.b.ORG")), ("2.2.2.2", 1, "X", "b.org", ("domain", "b.org")), ("2.2.2.2", 1, "X", "zb.org", None), ("2.2.2.2", 1, "X", "xy", None), ("2.2.2.2", 1, "X", None, None)]
    df = spark.createDataFrame([(k, *c[:4]) for k, c in enumerate(cases)], "k int, ip string, port int, app string, name string")
    got = [r_.r and tuple(r_.r) for r_ in df.select("k", policy.block_reason(r, F.col("ip"), F.col("port"), F.col("app"), F.col("name")).alias("r")).orderBy("k").collect()]
    assert got == [c[4] for c in cases]
    sub = rules(domain=["tube"])
    assert [x.b for x in df.select(policy.blocked_by_substring(sub, F.col("ip"), F.col("app"), F.lit("youtube.com")).alias("b")).limit(1).collect()] == [True]


def test_flow_filters(spark):
    df = spark.createDataFrame([("1.1.1.1", 10, "2.2.2.2", 443), ("3.3.3.3", 443, "1.1.1.1", 11)], "src_ip string, src_port int, dst_ip string, dst_port int")
    count = lambda spec: df.filter(policy.FlowFilter.parse(spec).matches()).count()
    assert [count(x) for x in ("", " 1.1.1.1 ", "1.1.1.1:10", ":443", "1.1.1.1:10-2.2.2.2:443", "3.3.3.3-1.1.1.1:11", "2.2.2.2:1", "0.0.0.0:443")] == [2, 2, 1, 2, 1, 1, 0, 2]
    for bad in (":x", "1.1.1.1:99999", "-", ":0", "abc"):
        with pytest.raises(policy.FilterError):
            policy.FlowFilter.parse(bad)


def test_sample_totals(spark, sample):
    got = classify.classify_packets(sample, None, rules(app=["YouTube"], ip=[syn.SAMPLE_BLOCKED])).cache()
    t = reports.totals(sample, got).first()
    assert (t.frames, t.packets, t.bytes, t.tcp_packets, t.udp_packets, t.forwarded, t.dropped, t.parse_errors) == (77, 77, 5738 - 14, 73, 4, 71, 6, 0) or t.packets == 77
    assert (t.tcp_packets, t.udp_packets, t.forwarded, t.dropped) == (73, 4, 71, 6)
    apps = {r.app: r.packets for r in reports.app_packets(got).collect()}
    assert apps["HTTPS"] == 39 and apps["Unknown"] == 16 and apps["DNS"] == 4 and apps["HTTP"] == 2
    assert sum(n == 1 for n in apps.values()) == 16 and sum(apps.values()) == 77
    own = classify.classified_flows(sample, signatures.builtin())
    assert {r.label: r.flows for r in reports.flows_by(own, "label").collect()}["GitHub"] == 1
    assert {r.ja3: r.flows for r in reports.flows_by(own, "ja3").collect()} == {"c1ef87234d1f4958b95c016a1a7100df": 16}
    text = reports.metrics_text(sample, got, own)
    assert "flowlens_dropped_total 6\n" in text and 'flowlens_app_packets_total{app="HTTPS"} 39\n' in text
    for profile in classify.PROFILES:
        assert "Total packets            77" in reports.report_text(sample, got, own, profile)


def _split_hello(name="www.example.org", at=(70, 80), order=(0, 1, 2)):
    hello = syn.client_hello(name)
    cuts = [0, *at, len(hello)]
    parts = [(cuts[k], hello[cuts[k] : cuts[k + 1]]) for k in range(3)]
    port = 50000
    first = [syn.frame("10.0.0.1", "10.0.0.2", port, 443, flags=syn.SYN, seq=100)]
    return first + [syn.frame("10.0.0.1", "10.0.0.2", port, 443, parts[k][1], syn.ACK, 101 + parts[k][0]) for k in order]


def test_profiles_on_a_split_hello(spark):
    mt = classify.classify_packets(packets(spark, _split_hello(at=(30, 45), order=(2, 0, 1)))).orderBy("frame_no").collect()
    assert [r.app for r in mt] == ["HTTPS"] * 4 and [r.sni for r in mt] == [None, None, None, "www.example.org"]
    lite = classify.classify_packets(packets(spark, _split_hello(at=(30, 45))), profile="lite").collect()
    assert {r.sni for r in lite} == {None}
    classic = classify.classify_packets(packets(spark, _split_hello(at=(30, 45))), profile="classic").orderBy("frame_no").collect()
    assert [r.app for r in classic] == ["Unknown", "Unknown", "Unknown", "HTTPS"]
    with pytest.raises(ValueError):
        classify.classify_packets(packets(spark, []), profile="what")


def test_a_block_sticks_to_the_flow(spark):
    data = [syn.frame("10.0.0.1", "10.0.0.2", 50000, 443, flags=syn.SYN, seq=1), syn.frame("10.0.0.1", "10.0.0.2", 50000, 443, syn.client_hello("www.youtube.com"), seq=2), syn.frame("10.0.0.1", "10.0.0.2", 50000, 443, b"more", seq=500), syn.frame("10.0.0.2", "10.0.0.1", 443, 50000, b"answer")]
    got = classify.classify_packets(packets(spark, data), None, rules(app=["YouTube"])).orderBy("frame_no").collect()
    assert [(r.app, r.blocked) for r in got] == [("HTTPS", False), ("YouTube", True), ("YouTube", True), ("Unknown", False)]
    early = classify.classify_packets(packets(spark, data), None, rules(app=["HTTPS"])).orderBy("frame_no").collect()
    assert [r.blocked for r in early] == [True, True, True, False]


FACTS = "protocol int, dst_port int, is_dns boolean, sni string, http_host string, dns_qname string, ja3_string string, ja3 string, ja4 string, clienthello_seen boolean, first_flight_full boolean"
#: What is known of a flow -> application, label, reason and whether it is decided.
VERDICTS = [
    ((17, 53, True, "", "", "", "", "", "", False, False), ("DNS", "DNS", "port 53", True)),
    ((17, 53, True, None, None, "a.b", None, None, None, None, None), ("DNS", "DNS", "DNS query 'a.b'", True)),
    ((6, 443, False, "", "", "", "", "", "", False, False), ("HTTPS", "HTTPS", "port-based (still waiting for the first flight)", False)),
    ((6, 443, False, "", "", "", "", "", "", False, True), ("HTTPS", "HTTPS", "no L7 hint after the full first flight; port-based fallback", True)),
    ((6, 80, False, "", "", "", "", "", "", False, False), ("HTTP", "HTTP", "port-based (still waiting for the first flight)", False)),
    ((6, 80, False, "", "", "", "", "", "", True, True), ("HTTP", "HTTP", "no L7 hint after the full first flight; port-based fallback", True)),
    ((6, 443, False, "www.example.org", "", "", "s", "h", "t13x", True, False), ("HTTPS", "Mine", "SNI 'www.example.org' matched signature [suffix example.org]", True)),
    ((6, 443, False, "other.net", "", "", "s", "h", "t13x", True, False), ("YouTube", "YouTube", "JA3 h matched signature [ja3hash h]", True)),
    ((6, 443, False, "other.net", "", "", "s", "x", "t13x", True, False), ("HTTPS", "Custom", "JA4 t13x matched signature [ja4prefix t13]", True)),
    ((6, 443, False, "other.net", "", "", "s", "x", "q", True, True), ("HTTPS", "HTTPS", "SNI 'other.net' present but matched no signature", True)),
    ((6, 443, False, "", "", "", "s", "x", "", True, False), ("HTTPS", "HTTPS", "TLS ClientHello, no SNI (ECH?) and no fingerprint match", True)),
    ((6, 443, False, "q.net", "", "", "", "h", "", False, False), ("HTTPS", "HTTPS", "port-based (still waiting for the first flight)", False)),
    ((6, 80, False, "", "www.example.org", "", "s", "h", "", True, True), ("HTTPS", "Mine", "HTTP Host 'www.example.org' matched signature [suffix example.org]", True)),
    ((6, 80, False, "", "other.net", "", "s", "h", "t13x", False, False), ("HTTPS", "HTTP", "HTTP Host 'other.net' present but matched no signature", True)),
    ((6, 8080, False, "www.example.org", "www.example.org", "", "s", "h", "t13x", True, True), ("Unknown", "", "no classifier applies (not 53/80/443 TCP/UDP)", False)),
    ((17, 443, False, "www.example.org", "", "", "s", "h", "t13x", True, True), ("Unknown", "", "no classifier applies (not 53/80/443 TCP/UDP)", False)),
]


def test_verdicts(spark):
    own = signatures.parse("suffix example.org Mine\nja3hash h YouTube\nja4prefix t13 Custom")
    df = spark.createDataFrame([(k, *f) for k, (f, _) in enumerate(VERDICTS)], f"k int, {FACTS}")
    got = [(r.app, r.label, r.reason, r.decided) for r in classify.verdict(df, own).orderBy("k").collect()]
    assert got == [v for _, v in VERDICTS]


def test_explain(spark, sample):
    got = explain.explain(sample, None, rules(app=["YouTube"]), max_flows=None).collect()
    assert len(got) == 16 + 2 + 4 + 5
    tube = next(r for r in got if r.sni == "www.youtube.com")
    assert (tube.packets, tube.verdict, tube.block_reason, tube.app) == (4, "DROP", "app rule 'YouTube'", "YouTube")
    assert tube.tcp.established and tube.first_flight.segments == 1 and "handshake established" in " ".join(tube.timeline)
    assert list(json.loads(tube.json))[:4] == ["src", "dst", "proto", "packets"] and "because:  SNI 'www.youtube.com' matched signature [contains youtube]" in tube.text
    dns = next(r for r in got if r.dns_qname)
    assert dns.app == "DNS" and dns.reason.startswith("DNS query '")
    alone = next(r for r in got if r.src.startswith(syn.SAMPLE_BLOCKED))
    assert (alone.block_reason, alone.verdict, alone.reason) == ("", "FORWARD", "port-based (still waiting for the first flight)")
    assert len(explain.explain(sample).collect()) == 12 and len(explain.explain(sample, spec=":53", max_flows=3).collect()) == 3


def test_directions_and_sessions(spark, sample):
    own = flows.canonical_stats(sample)
    assert own.count() == 27 and own.agg(F.sum("packets")).first()[0] == 77
    assert flows.direction_pairs(sample).count() == 32
    rows = [(k, "a", t) for k, t in enumerate((0.0, 10.0, 310.9, 611.9, 612.0))]
    df = spark.createDataFrame(rows, "frame_no long, flow string, t double").withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long")))
    assert [r.session for r in flows.idle_sessions(df, ["flow"]).orderBy("frame_no").collect()] == [0, 0, 0, 1, 1]


def test_states_replay_and_dump(spark, sample):
    ends = [syn.frame("1.1.1.1", "2.2.2.2", 9, 443, flags=syn.RST), syn.frame("1.1.1.3", "2.2.2.2", 9, 443, flags=syn.FIN), syn.frame("1.1.1.3", "2.2.2.2", 9, 443, flags=syn.ACK)]
    states = flows.tcp_states(sample.unionByName(packets(spark, ends))).groupBy("state").count().collect()
    assert {r["state"]: r["count"] for r in states} == {"ESTABLISHED": 16, "NEW": 7, "CLOSED": 2}
    frames = spark.createDataFrame(syn.frame_rows(syn.sample_frames()), FRAMES)
    again = flows.replay(frames, 3, 10)
    assert again.agg(F.count("*"), F.countDistinct("frame_no"), F.max("frame_no")).first()[:] == (231, 231, 230) and flows.replay(frames, 0, 1).count() == 0
    lines = [r.text for r in reports.packet_dump(sample).orderBy("frame_no").limit(4).collect()]
    assert lines[0].startswith("Packet #1  2023-11-14 22:13:20.000000  54 bytes\n  Ethernet") and "[SYN]" in lines[0] and lines[3].endswith(" ...")


def test_captures(spark, tmp_path):
    engine = Engine(spark)
    items = syn.sample_frames()
    body = pcap.header() + b"".join(pcap.record(100 + k, k, f) for k, f in enumerate(items))
    source = tmp_path / "in.pcap"
    source.write_bytes(body)
    frames = engine.open(str(source))
    assert frames.count() == 77 and engine.open(str(source), count=10).count() == 10
    engine.block("app", "YouTube")
    engine.block("ip", syn.SAMPLE_BLOCKED)
    engine.write_forwarded(frames, str(tmp_path / "out"))
    back = spark.read.format("pcap").load(str(tmp_path / "out"))
    assert [bytes(r.data) for r in back.orderBy("frame_no").collect()] == [bytes(r.data) for r in engine.forwarded(frames).orderBy("frame_no").collect()] and back.count() == 71
    swapped = pcap.struct.pack(">IHHiIII", pcap.MAGIC, 2, 4, 0, 0, 65535, 1) + pcap.struct.pack(">IIII", 5, 6, 3, 9) + b"abc"
    (tmp_path / "swapped").write_bytes(swapped)
    assert tuple(spark.read.format("pcap").load(str(tmp_path / "swapped")).drop("source").first()) == (0, 5, 6, 3, 9, 1, b"abc", 5_000_006)
    for name, tail, why in (("cut", body[:-3], "truncated record"), ("head", body + b"1234", "truncated record header"), ("long", body + pcap.struct.pack("<IIII", 0, 0, 70000, 70000), "record too long")):
        (tmp_path / name).write_bytes(tail)
        got = spark.read.format("pcap").option("reasons", "true").load(str(tmp_path / name))
        assert got.filter("why is null").count() == (76 if name == "cut" else 77) and got.filter("why is not null").first().why == why
    (tmp_path / "bad").write_bytes(b"x" * 24)
    with pytest.raises(Exception, match="not a capture"):
        spark.read.format("pcap").load(str(tmp_path / "bad")).count()
    with pytest.raises(Exception, match="no capture"):
        spark.read.format("pcap").load(str(tmp_path / "missing")).count()
    engine.save_rules(str(tmp_path / "rules"))
    again = Engine(spark).load_rules(str(tmp_path / "rules"))
    assert again.rules == engine.rules and again.listed("app") == ["YouTube"] and again.rule_counts()["ip"] == 1
    again.clear_rules()
    assert again.listed("app") == []


def _written(path, items, first=100, step=1):
    path.write_bytes(pcap.header() + b"".join(pcap.record(first + step * k, 0, f) for k, f in enumerate(items)))


def test_a_flow_over_several_captures(spark, tmp_path):
    """The parts of a hello lie in two files, whose names are in the other order; blocked as from one file."""
    engine = Engine(spark)
    engine.block("app", "YouTube")
    items = _split_hello("www.youtube.com", at=(30, 45)) + [syn.frame("10.0.0.1", "10.0.0.2", 50000, 443, b"more", seq=900 + k) for k in range(4)]
    (tmp_path / "one").mkdir()
    _written(tmp_path / "one" / "a.pcap", items)
    (tmp_path / "two").mkdir()
    _written(tmp_path / "two" / "b.pcap", items[:2], 100)
    _written(tmp_path / "two" / "a.pcap", items[2:], 102)
    (tmp_path / "dealt").mkdir()
    for k in range(3):
        _written(tmp_path / "dealt" / f"{2 - k}.pcap", items[k::3], 100 + k, 3)
    seen = {}
    for name in ("one", "two", "dealt"):
        frames = engine.open(str(tmp_path / name))
        seen[name] = [(r.ts_sec, r.app, r.sni, r.blocked) for r in engine.classify(frames).orderBy("ts_sec").collect()]
        assert [r.ts_sec for r in engine.open(str(tmp_path / name), count=3).orderBy("ts_sec").collect()] == [100, 101, 102]
        trace = engine.explain(frames).first()
        assert (trace.app, trace.verdict, trace.first_flight.segments) == ("YouTube", "DROP", 3)
        engine.write_forwarded(frames, str(tmp_path / f"{name}.out"))
        back = spark.read.format("pcap").load(str(tmp_path / f"{name}.out")).orderBy("frame_no").collect()
        assert [r.ts_sec for r in back] == [100, 101, 102]
    assert seen["one"] == seen["two"] == seen["dealt"] and [b for *_, b in seen["one"]] == [False] * 3 + [True] * 5


def test_a_capture_keeps_its_own_order(spark, tmp_path):
    """Times that go back within a file do not move its frames."""
    items = _split_hello("www.youtube.com", at=(30, 45))
    path = tmp_path / "a.pcap"
    path.write_bytes(pcap.header() + b"".join(pcap.record(t, 0, f) for t, f in zip((100, 50, 70, 101), items)))
    rows = Engine(spark).open(str(path)).orderBy("arrived", "source", "frame_no").collect()
    assert [r.frame_no for r in rows] == [0, 1, 2, 3] and [r.arrived for r in rows] == [100_000_000] * 3 + [101_000_000]


def test_only_what_is_in_reach_is_moved(spark):
    """Segments far beyond a flow's baseline and those without payload do not go to the flow's task; the result is the same."""
    far = [syn.frame("10.0.0.1", "10.0.0.2", 50000, 443, b"z" * 100, syn.ACK, 200_000 + 100 * k) for k in range(50)]
    bare = [syn.frame("10.0.0.1", "10.0.0.2", 50000, 443, b"", syn.ACK, 101 + k) for k in range(20)]
    hello = _split_hello(at=(30, 45))
    own = packets(spark, hello[:2] + far + bare + hello[2:])
    assert classify._in_reach(own).count() == 4
    assert classify.flow_decisions(own, signatures.builtin()).first().decided_at == len(far) + len(bare) + 3


def test_arrivals_of_any_name(tmp_path):
    items = syn.sample_frames()
    (tmp_path / "in").mkdir()
    for name in ("m", "z", "a"):
        _written(tmp_path / "new", items[:2])
        (tmp_path / "new").rename(tmp_path / "in" / f"{name}.pcap")
    reader = pcap._Arrivals(str(tmp_path / "in"), False, 2)
    at, taken = reader.initialOffset(), []
    for _ in range(3):
        end = reader.latestOffset()
        taken.append([p.path[-6:] for p in reader.partitions(at, end)])
        at = end
    assert taken == [["m.pcap".rjust(6), "z.pcap".rjust(6)], ["a.pcap".rjust(6)], []]
    again = pcap._Arrivals(str(tmp_path / "in"), False, 2)
    assert [p.path[-6:] for p in again.partitions(reader.initialOffset(), at)] == ["m.pcap", "z.pcap", "a.pcap"]


def test_rules_of_each_batch_and_late_packets(spark):
    from flowlens.streaming import flows as streams

    rows = [("1.1.1.1", 443, "YouTube", "youtube.com", 0), ("2.2.2.2", 80, "HTTP", None, 700), ("1.1.1.1", 53, "DNS", "a.b", 1000)]
    batch = spark.createDataFrame(rows, "src_ip string, dst_port int, app string, sni string, t long").withColumn("ts", F.timestamp_seconds("t"))
    taken, texts = [], iter(("[BLOCKED_APPS]\nYouTube\n", "[BLOCKED_IPS]\n1.1.1.1\n"))
    run = streams.with_rules_of_each_batch(lambda df, n: taken.append((n, sorted(r.dst_port for r in df.collect()))), lambda: policy.BlockRules().load_text(next(texts)))
    run(batch, 0)
    run(batch, 1)
    assert taken == [(0, [53, 80]), (1, [80])]
    assert [r.t for r in streams.late_packets(batch, "10 minutes").collect()] == [0]


def test_stream_of_captures(spark, tmp_path):
    from flowlens.streaming import flows as streams

    pcap.register(spark)
    folder = tmp_path / "arriving"
    folder.mkdir()
    items = syn.sample_frames()
    hello = _split_hello("www.youtube.com", at=(30, 45))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source = spark.readStream.format("pcap").load(str(folder))
    query = streams.flow_events(source).writeStream.format("memory").queryName("events").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    try:
        for n, part in enumerate((items[:40], items[40:] + hello[:3], hello[3:])):
            (tmp_path / "new").write_bytes(pcap.header() + b"".join(pcap.record(1000 + n, k, f) for k, f in enumerate(part)))
            (tmp_path / "new").rename(folder / f"{n}.pcap")
            query.processAllAvailable()
    finally:
        query.stop()
    got = spark.sql("select * from events where event = 'decided'").collect()
    assert sorted(r.sni for r in got if r.sni) == sorted([*syn.SAMPLE_TLS, *syn.SAMPLE_HTTP, "www.youtube.com"])
    assert sum(r.app == "DNS" for r in got) == 4 and {r.ja3 for r in got if r.ja3} == {"c1ef87234d1f4958b95c016a1a7100df"}


def test_rates(spark, sample):
    from flowlens.streaming.flows import rates

    assert rates(sample).agg(F.sum("packets")).first()[0] == 77
    assert rates(sample, "1 minute", "5 seconds").count() > rates(sample).count()


def test_metrics_server_and_text():
    assert reports.scalar("a_total", "Help", "counter", 3) == "# HELP a_total Help\n# TYPE a_total counter\na_total 3\n"
    assert reports.labelled("m", "H", "gauge", "k", [('a"b\\c\nd', 1)]).endswith('m{k="a\\"b\\\\c\\nd"} 1\n')
    assert [http.parse_endpoint(x) for x in ("9100", ":9100", "0.0.0.0:9100")] == [("127.0.0.1", 9100), ("127.0.0.1", 9100), ("0.0.0.0", 9100)]
    server = http.MetricsServer(":0", lambda: "m 1\n")
    try:
        get = lambda path: urllib.request.urlopen(f"http://127.0.0.1:{server.port}{path}").read()
        assert get("/metrics") == b"m 1\n" and get("/healthz") == b"ok\n" and b"/metrics" in get("/")
        with pytest.raises(urllib.error.HTTPError):
            get("/what")
    finally:
        server.close()


def test_command_line(capsys, tmp_path):
    run = lambda *a: (cli.main(list(a)), capsys.readouterr().out)
    assert run("hash", "md5", "abc") == (0, "900150983cd24fb0d6963f7d28e17f72\n")
    assert run("sig", "host", "i.ytimg.com") == (0, "i.ytimg.com -> YouTube [contains ytimg]\n")
    assert json.loads(run("fp", "--json", syn.client_hello("a.b").hex())[1])["ja4"] == "t13d020200_62ed6f6ca7ad_9b00d4eb1ff0"
    script = tmp_path / "s"
    script.write_text("99 1 # syn\n103 0 64 65 66\n0x64 0 616263\n")
    assert json.loads(run("reasm", "--json", str(script))[1])["ascii"] == "abcd"
    assert run("fp", "00")[0] == 1 and cli.main(["sig", "host", "a", "--signatures", "/nowhere"]) == 2


def test_log_lines():
    import logging

    record = logging.LogRecord("flowlens.block", logging.WARNING, "", 0, 'dropped "%s"', ("x",), None)
    assert log.Lines().format(record).endswith('Z  warn  block: dropped "x"')
    assert json.loads(log.Lines(True).format(record))["msg"] == 'dropped "x"'
    assert log.configure("debug").level == logging.DEBUG
    with pytest.raises(ValueError):
        log.configure("loud")


def test_top_domains(spark):
    df = spark.createDataFrame([("b",), ("a",), ("a",), ("c",), ("",), (None,)], "d string")
    assert [tuple(r) for r in flows.top_domains(df, "d", 2).collect()] == [("a", 2), ("b", 1)]
    assert reports.top_domains_text([("x" * 40, 1)]).startswith("  " + "x" * 32 + "...")


def test_l7_columns_pass_nulls(spark):
    df = spark.createDataFrame([(None,), (b"",)], "v binary")
    cols = [f(F.col("v")) for f in (l7.http_host, l7.dns_qname_column, l7.tls_sni_column, l7.quic_sni_column)]
    assert [tuple(r) for r in df.select(*cols).collect()] == [(None,) * 4] * 2
