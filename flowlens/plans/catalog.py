"""Registered queries over the driver's tables and the SQL that gives the same rows.

Packet queries build real frames from table rows and run the decoder and the engine on their bytes; their SQL computes
the result from the columns that the frames were made from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowlens.functions import fingerprint, l7, text
from flowlens.functions.decode import decode, transport_only
from flowlens.operators import classify, explain, flows, policy, reassembly, reports, signatures
from flowlens.schemas import FLIGHT_BYTES, FLIGHT_SEGMENTS, FLOW_KEY
from flowlens.sources import synthetic
from flowlens.streaming.flows import rates

from . import tables

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _rules() -> policy.BlockRules:
    rules = policy.BlockRules()
    for kind, value in (("ip", "10.0.0.7"), ("app", "YouTube"), ("domain", "discord")):
        rules.block(kind, value)
    return rules


def _classified(spark: SparkSession, sf_dir: str, profile: str = "mt") -> DataFrame:
    return classify.classify_packets(tables.event_packets(spark, sf_dir), None, _rules(), profile)


P = f"WITH {tables.PACKETS_SQL}"
#: A packet's own reason to be blocked, then the flow's from its first such packet on.
HIT = "(src_ip = '10.0.0.7' OR app = 'YouTube' OR contains(coalesce(sni, ''), 'discord'))"
B = f"{P}, blocked AS (SELECT *, max(CASE WHEN {HIT} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, k, protocol, dst_port ORDER BY event_id ROWS UNBOUNDED PRECEDING) = 1 AS blocked FROM packets)"


@query(f"{P} SELECT protocol, count(*) AS packets, CAST(sum(len) AS BIGINT) AS bytes, CAST(sum(payload) AS BIGINT) AS payload_bytes, count(*) FILTER (WHERE syn) AS syns FROM packets GROUP BY protocol")
def decode_transport_counts(spark, sf_dir):
    """Headers decoded from bytes: packets, bytes and payload by protocol."""
    own = transport_only(tables.event_packets(spark, sf_dir))
    return own.groupBy(F.col("protocol")).agg(F.count(F.lit(1)).alias("packets"), F.sum("frame_bytes").alias("bytes"), F.sum("payload_length").cast("long").alias("payload_bytes"), F.count_if(F.col("tcp_flags") == synthetic.SYN).alias("syns"))


@query(f"{P} SELECT event_id AS frame_no, src_ip, dst_ip, src_port, dst_port, protocol, len AS frame_bytes, payload AS payload_length, CASE WHEN protocol = 6 THEN CASE WHEN syn THEN 'SYN' ELSE 'ACK PSH' END ELSE 'none' END AS flags, CASE WHEN protocol = 6 THEN 'TCP' ELSE 'UDP' END AS protocol_name, src_ip || ':' || src_port || ' -> ' || dst_ip || ':' || dst_port || ' (' || CASE WHEN protocol = 6 THEN 'TCP' ELSE 'UDP' END || ')' AS flow FROM packets")
def packet_fields(spark, sf_dir):
    """Fields and text forms of every decoded packet."""
    own = tables.event_packets(spark, sf_dir)
    c = F.col
    flags = text.tcp_flags_text(F.coalesce(c("tcp_flags"), F.lit(0)))
    return own.select("frame_no", "src_ip", "dst_ip", c("src_port").cast("long").alias("src_port"), "dst_port", "protocol", c("frame_bytes").cast("long").alias("frame_bytes"), c("payload_length").cast("long").alias("payload_length"), flags.alias("flags"), text.protocol_text(c("protocol")).alias("protocol_name"), text.flow_text(c("src_ip"), c("src_port"), c("dst_ip"), c("dst_port"), c("protocol")).alias("flow"))


@query(f"{P} SELECT app, count(*) AS packets, CAST(sum(len) AS BIGINT) AS bytes, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS share, repeat('#', CAST(floor(100.0 * count(*) / sum(count(*)) OVER () / 5) AS BIGINT)) AS bar FROM packets GROUP BY app")
def app_packets(spark, sf_dir):
    """Packets and bytes of each application, with share and bar."""
    return reports.app_packets(_classified(spark, sf_dir)).withColumn("share", F.round("share", 4))


@query(f"{P} SELECT event_id AS frame_no, app, sni, final_app FROM packets")
def classified_packets(spark, sf_dir):
    """Application and name of every packet at its time, and its flow's application in the end."""
    return _classified(spark, sf_dir).select("frame_no", "app", "sni", "final_app")


@query(f"{P} SELECT final_app AS app, count(*) AS flows FROM (SELECT DISTINCT user_id, k, protocol, dst_port, final_app FROM packets) GROUP BY final_app")
def app_flows(spark, sf_dir):
    """Flows of each application."""
    return reports.app_flows(classify.classified_flows(tables.event_packets(spark, sf_dir), signatures.builtin())).select("app", "flows")


@query(f"{P} SELECT count(*) AS flows, count(*) FILTER (WHERE final_app <> 'Unknown') AS classified, count(*) FILTER (WHERE final_app = 'Unknown') AS \"unknown\", count(*) FILTER (WHERE decided IS NOT NULL AND dst_port = 443) AS hellos, count(*) FILTER (WHERE decided IS NOT NULL) AS decided FROM (SELECT DISTINCT user_id, k, protocol, dst_port, final_app, decided FROM packets)")
def classification_totals(spark, sf_dir):
    """Flows with and without an application."""
    return reports.classification_totals(classify.classified_flows(tables.event_packets(spark, sf_dir), signatures.builtin()))


@query(f"{P} SELECT final_app AS label, count(*) AS flows FROM (SELECT DISTINCT user_id, k, protocol, dst_port, final_app, decided FROM packets) WHERE decided IS NOT NULL AND dst_port = 443 AND final_app <> 'HTTPS' GROUP BY final_app")
def label_flows(spark, sf_dir):
    """Flows of each signature label."""
    return reports.flows_by(classify.classified_flows(tables.event_packets(spark, sf_dir), signatures.builtin()), "label")


@query(f"{P} SELECT md5('771,4865-4866,0-43,,') AS ja3, 't13d0202' || '00_' || substr(sha256('1301,1302'), 1, 12) || '_' || substr(sha256('002b_'), 1, 12) AS ja4, count(*) AS flows FROM (SELECT DISTINCT user_id, k FROM packets WHERE decided IS NOT NULL AND dst_port = 443) HAVING count(*) > 0")
def fingerprint_flows(spark, sf_dir):
    """Flows of each JA3 and JA4."""
    own = classify.classified_flows(tables.event_packets(spark, sf_dir), signatures.builtin()).filter("ja3 is not null")
    return own.groupBy("ja3", "ja4").agg(F.count(F.lit(1)).alias("flows"))


@query(f"{B} SELECT event_id AS frame_no, blocked FROM blocked")
def sticky_block(spark, sf_dir):
    """Whether each packet is dropped: from the first packet that a rule hits to the flow's end."""
    return _classified(spark, sf_dir).select("frame_no", "blocked")


@query(f"{B} SELECT count(*) FILTER (WHERE NOT blocked) AS forwarded, count(*) FILTER (WHERE blocked) AS dropped, round(100.0 * count(*) FILTER (WHERE blocked) / count(*), 4) AS drop_rate FROM blocked")
def forward_drop(spark, sf_dir):
    """Packets forwarded and dropped."""
    return reports.forward_drop(_classified(spark, sf_dir)).withColumn("drop_rate", F.round("drop_rate", 4))


@query(f"{P} SELECT sni, arg_max(app, event_id) AS app, count(*) AS packets FROM packets WHERE sni <> '' GROUP BY sni")
def names_seen(spark, sf_dir):
    """Names with the application of their last packet."""
    return reports.names_seen(_classified(spark, sf_dir))


_LITE_APP = f"CASE WHEN decided IS NOT NULL AND event_id >= decided THEN {tables.HOST_APP_SQL} WHEN dst_port = 53 THEN 'DNS' WHEN dst_port = 443 THEN 'HTTPS' WHEN dst_port = 80 THEN 'HTTP' ELSE 'Unknown' END"


@query(f"{P} SELECT event_id AS frame_no, {_LITE_APP} AS app, sni FROM packets")
def classified_packets_lite(spark, sf_dir):
    """The single-packet profile: no reassembly, and ports count for UDP too."""
    return _classified(spark, sf_dir, "lite").select("frame_no", "app", "sni")


_CLASSIC = f"""{P}, c AS (
    SELECT *, min(CASE WHEN NOT syn AND (protocol = 6 AND dst_port IN (443, 80) OR dst_port = 53) THEN event_id END) OVER (PARTITION BY user_id, k, protocol, dst_port) AS named_at FROM packets
), d AS (
    SELECT *, CASE WHEN dst_port = 53 THEN 'DNS' ELSE {tables.HOST_APP_SQL} END AS late_app FROM c
), f AS (SELECT *, src_ip = '10.0.0.7' AS early, src_ip = '10.0.0.7' OR late_app = 'YouTube' AS late FROM d)
SELECT event_id AS frame_no,
    CASE WHEN event_id >= named_at AND NOT (early AND first < named_at) THEN late_app ELSE 'Unknown' END AS app,
    CASE WHEN event_id >= named_at THEN late OR (early AND first < named_at) ELSE early END AS blocked
FROM f"""


@query(_CLASSIC)
def classified_packets_classic(spark, sf_dir):
    """The component profile: rules in order, names of DNS queries, exact domains."""
    return _classified(spark, sf_dir, "classic").select("frame_no", "app", "blocked")


@query(f"{P} SELECT src_ip, dst_ip, src_port, dst_port, protocol, count(*) AS packets, CAST(sum(len) AS BIGINT) AS bytes, min(event_id) AS first_packet FROM packets GROUP BY ALL")
def flow_stats(spark, sf_dir):
    """Packets, bytes and first packet of each directional flow."""
    own = flows.flow_stats(transport_only(tables.event_packets(spark, sf_dir)))
    return own.withColumn("src_port", F.col("src_port").cast("long"))


#: Flows of both directions: a well-known port makes the server, else the smaller address, its first octet counting least, the client.
C = f"""{P}, w AS (
    SELECT *, dst_port NOT IN (443, 80, 53) AND 10 + (user_id // 256) * 65536 + (user_id % 256) * 16777216 > 172 + 16 * 256 + k * 16777216::BIGINT AS back FROM packets
), c AS (
    SELECT *, CASE WHEN back THEN dst_ip ELSE src_ip END AS client_ip, CASE WHEN back THEN dst_port ELSE src_port END AS client_port, CASE WHEN back THEN src_ip ELSE dst_ip END AS server_ip, CASE WHEN back THEN src_port ELSE dst_port END AS server_port FROM w
)"""


@query(f"{C} SELECT client_ip, client_port, server_ip, server_port, protocol, count(*) AS packets, CAST(sum(len) AS BIGINT) AS bytes, CAST(sum(CASE WHEN back THEN 0 ELSE payload END) AS BIGINT) AS client_bytes, CAST(sum(CASE WHEN back THEN payload ELSE 0 END) AS BIGINT) AS server_bytes, arg_min(epoch_us(ts) // 1000000, event_id) AS ts_first, arg_max(epoch_us(ts) // 1000000, event_id) AS ts_last, min(event_id) AS first_packet FROM c GROUP BY client_ip, client_port, server_ip, server_port, protocol")
def canonical_flow_stats(spark, sf_dir):
    """Flows of both directions together: packets, bytes of either side, first and last time."""
    out = flows.canonical_stats(transport_only(tables.event_packets(spark, sf_dir))).drop("duration", "first_arrival")
    return out.withColumns({c: F.col(c).cast("long") for c in ("client_port", "server_port")})


@query(f"{P}, fl AS (SELECT src_ip, dst_ip, src_port, dst_port, protocol, count(*) AS packets FROM packets GROUP BY ALL), rv AS (SELECT dst_ip AS src_ip, src_ip AS dst_ip, dst_port AS src_port, src_port AS dst_port, protocol, packets + 1 AS reverse_packets FROM fl WHERE packets > 1), al AS (SELECT * FROM fl UNION ALL SELECT src_ip, dst_ip, src_port, dst_port, protocol, reverse_packets FROM rv) SELECT a.src_ip, a.dst_ip, a.src_port, a.dst_port, a.protocol, a.packets, b.packets AS reverse_packets FROM al a JOIN al b ON a.src_ip = b.dst_ip AND a.dst_ip = b.src_ip AND a.src_port = b.dst_port AND a.dst_port = b.src_port AND a.protocol = b.protocol")
def direction_pairs(spark, sf_dir):
    """Flows met with those the other way; answers are made for flows of several packets, one packet longer."""
    own = transport_only(tables.event_packets(spark, sf_dir)).select(*FLOW_KEY, "frame_no", "frame_bytes")
    stats = flows.flow_stats(own).filter("packets > 1")
    answers = stats.select(*flows.reversed_key(), F.explode(F.sequence(F.lit(0).cast("long"), F.col("packets"))).alias("frame_no"), F.lit(60).alias("frame_bytes"))
    out = flows.direction_pairs(own.unionByName(answers)).select(*FLOW_KEY, "packets", "reverse_packets")
    return out.withColumns({c: F.col(c).cast("long") for c in ("src_port", "dst_port")})


@query(f"{P}, g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w >= (3600 + 1) * 1000000::BIGINT THEN 1 ELSE 0 END AS fresh FROM packets WINDOW w AS (PARTITION BY src_ip ORDER BY ts, event_id)) SELECT event_id AS frame_no, CAST(sum(fresh) OVER (PARTITION BY src_ip ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM g")
def flow_sessions_idle(spark, sf_dir):
    """A client's sessions: a new one after more than an hour, in whole seconds, without a packet."""
    own = tables.event_packets(spark, sf_dir)
    return flows.idle_sessions(own, ["src_ip"], idle=3600).select("frame_no", "session")


@query(f"{P} SELECT time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS packets, CAST(sum(len) AS BIGINT) AS bytes, round(count(*) / 3600.0, 6) AS packets_per_s FROM packets GROUP BY 1")
def rate_per_window(spark, sf_dir):
    """Packets and bytes per hour."""
    own = rates(transport_only(tables.event_packets(spark, sf_dir)), "1 hour")
    return own.select(F.to_timestamp_ntz(F.date_format("start", "yyyy-MM-dd HH:mm:ss")).alias("start"), "packets", "bytes", F.round("packets_per_s", 6).alias("packets_per_s"))


@query(f"{P} SELECT event_id AS frame_no FROM packets WHERE (src_ip = '10.0.0.5' OR dst_ip = '10.0.0.5') AND (src_port = 443 OR dst_port = 443)")
def flow_filter(spark, sf_dir):
    """Packets of a flow specification."""
    return transport_only(tables.event_packets(spark, sf_dir)).filter(policy.FlowFilter.parse("10.0.0.5-:443").matches()).select("frame_no")


@query(f"{P}, fst AS (SELECT user_id, k, protocol, dst_port FROM packets GROUP BY ALL ORDER BY min(event_id) LIMIT 12) SELECT event_id AS frame_no FROM packets SEMI JOIN fst USING (user_id, k, protocol, dst_port)")
def first_n_flows(spark, sf_dir):
    """Packets of the twelve flows seen first."""
    return flows.first_flows(transport_only(tables.event_packets(spark, sf_dir)), FLOW_KEY, 12).select("frame_no")


#: Rules over the hosts of pages; the first that matches counts.
PAGE_RULES = "contains blog. Blogs\nsuffix example.org Organisation\nsuffix example.com Company\ncontains example Example\nexact www.example.net Network\n"
_PAGE = "WITH h AS (SELECT page_id, split_part(url, '/', 3) AS host FROM pages)"
_PAGE_ORD = "CASE WHEN contains(lower(host), 'blog.') THEN 0 WHEN lower(host) = 'example.org' OR ends_with(lower(host), '.example.org') THEN 1 WHEN lower(host) = 'example.com' OR ends_with(lower(host), '.example.com') THEN 2 WHEN contains(lower(host), 'example') THEN 3 WHEN lower(host) = 'www.example.net' THEN 4 END"


@query(f"{_PAGE}, o AS (SELECT *, {_PAGE_ORD} AS ord FROM h) SELECT page_id, host, CASE ord WHEN 0 THEN 'Blogs' WHEN 1 THEN 'Organisation' WHEN 2 THEN 'Company' WHEN 3 THEN 'Example' WHEN 4 THEN 'Network' END AS app FROM o")
def host_signature_match(spark, sf_dir):
    """The label of each page's host by the first rule that matches, as an expression."""
    rules = signatures.parse(PAGE_RULES)
    own = tables.page_hosts(spark, sf_dir)
    return own.select("page_id", "host", signatures.of_rule(signatures.host_rule(F.col("host"), rules), [r.app for r in rules]).alias("app"))


@query(f"{_PAGE}, o AS (SELECT *, {_PAGE_ORD} AS ord FROM h) SELECT ord, count(*) AS pages FROM o WHERE ord IS NOT NULL GROUP BY ord")
def signature_rule_hits(spark, sf_dir):
    """Pages of each rule, rules as a table."""
    rules = signatures.frame(spark, signatures.parse(PAGE_RULES))
    found = signatures.match_hosts(tables.page_hosts(spark, sf_dir), "host", rules)
    return found.filter("ord is not null").groupBy("ord").agg(F.count(F.lit(1)).alias("pages"))


@query(f"{_PAGE} SELECT host, count(*) AS n FROM h WHERE host <> '' GROUP BY host ORDER BY n DESC, host LIMIT 20")
def top_domains(spark, sf_dir):
    """The twenty most frequent hosts."""
    return flows.top_domains(tables.page_hosts(spark, sf_dir), "host", 20)


@query(f"{_PAGE} SELECT page_id, split_part(host, ':', 1) AS host FROM h")
def http_host_extract(spark, sf_dir):
    """Hosts found in requests made of them."""
    own = tables.page_hosts(spark, sf_dir)
    return own.select("page_id", l7.http_host(F.unhex(synthetic.http_get_hex(F.col("host")))).alias("host"))


@query(f"{_PAGE} SELECT page_id, host AS qname FROM h")
def dns_qname_extract(spark, sf_dir):
    """Names found in DNS queries made of them."""
    own = tables.page_hosts(spark, sf_dir)
    return own.select("page_id", l7.dns_qname_column(F.unhex(synthetic.dns_query_hex(F.col("host")))).alias("qname"))


@query(f"{_PAGE} SELECT page_id, host AS sni, host AS quic_sni FROM h")
def tls_sni_extract(spark, sf_dir):
    """Names found in hellos made of them, and in packets with a long header around these."""
    hello = F.unhex(synthetic.client_hello_hex(F.col("host")))
    quic = F.concat(F.unhex(F.lit("C0000000010000000000000000")), hello)
    return tables.page_hosts(spark, sf_dir).select("page_id", l7.tls_sni_column(hello).alias("sni"), l7.quic_sni_column(quic).alias("quic_sni"))


_CIPHERS = "list_filter([CAST(p_size AS INTEGER) * 257, 4865, 2570, 49195 + CAST(p_size AS INTEGER) % 7], lambda x: x <> 2570)"


_JA_SQL = f"""WITH c AS (SELECT p_partkey, {_CIPHERS} AS own FROM part), g AS (SELECT p_partkey, list_filter(own, lambda x: NOT ((x & 3855) = 2570 AND (x >> 8) = (x & 255))) AS own FROM c)
    SELECT p_partkey, '771,' || list_aggregate(own, 'string_agg', '-') || ',0-43,,' AS ja3_string, md5('771,' || list_aggregate(own, 'string_agg', '-') || ',0-43,,') AS ja3,
        't13d' || lpad(CAST(len(own) AS VARCHAR), 2, '0') || '0200_' || substr(sha256(list_aggregate(list_transform(list_sort(own), lambda x: lpad(lower(to_hex(x)), 4, '0')), 'string_agg', ',')), 1, 12) || '_' || substr(sha256('002b_'), 1, 12) AS ja4
    FROM g"""


@query(_JA_SQL)
def tls_ja3_ja4(spark, sf_dir):
    """Fingerprints of hellos whose cipher lists come from parts; GREASE values do not count."""
    size = F.col("p_size").cast("int")
    listed = F.array(size * 257, F.lit(4865), F.lit(2570), 49195 + size % 7)
    ciphers = F.array_join(F.transform(listed, lambda v: F.lpad(F.hex(v), 4, "0")), "")
    hello = l7.client_hello_column(F.unhex(synthetic.client_hello_hex(F.lit("part.example.com"), ciphers)))
    own = tables.table(spark, sf_dir, "part").select("p_partkey", hello.alias("hello"))
    h = F.col("hello")
    return own.select("p_partkey", fingerprint.ja3_string(h).alias("ja3_string"), fingerprint.ja3(h).alias("ja3"), fingerprint.ja4(h).alias("ja4"))


@query("SELECT doc_id AS id, md5(text) AS md5, sha256(text) AS sha256 FROM documents UNION ALL SELECT item_id, md5(text), sha256(text) FROM benchmark")
def hash_digests(spark, sf_dir):
    """MD5 and SHA-256 of texts."""
    own = tables.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text").unionByName(tables.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text"))
    return own.select("id", F.md5(F.col("text").cast("binary")).alias("md5"), F.sha2("text", 256).alias("sha256"))


_REASON = "CASE WHEN src_ip = '10.0.0.7' THEN 'ip' WHEN dst_port = 8080 THEN 'port' WHEN final_app = 'YouTube' THEN 'app' WHEN host = 'api.github.com' OR host = 'spotify.com' OR ends_with(host, '.spotify.com') THEN 'domain' END"


@query(f"{P}, w AS (SELECT *, {_REASON} AS kind FROM packets) SELECT event_id AS frame_no, kind, CASE kind WHEN 'ip' THEN src_ip WHEN 'port' THEN '8080' WHEN 'app' THEN final_app WHEN 'domain' THEN host END AS detail FROM w")
def block_reason(spark, sf_dir):
    """The first rule that holds, in the order address, port, application, domain."""
    rules = policy.BlockRules()
    for kind, value in (("ip", "10.0.0.7"), ("port", 8080), ("app", "YouTube"), ("domain", "api.github.com"), ("domain", "*.Spotify.com")):
        rules.block(kind, value)
    own = classify.classify_packets(tables.event_packets(spark, sf_dir))
    digits = F.regexp_extract("dst_ip", r"(\d+)$", 1).cast("int") % 10
    host = F.get(F.lit(tables.HOSTS), digits)
    found = own.withColumn("r", policy.block_reason(rules, F.col("src_ip"), F.col("dst_port"), F.col("final_app"), host))
    return found.select("frame_no", "r.kind", "r.detail")


@query(f"{P} SELECT event_id AS frame_no, EXISTS (SELECT 1 FROM supplier WHERE '10.0.0.' || s_suppkey = src_ip) AS listed FROM packets")
def listed_addresses(spark, sf_dir):
    """Semi and anti lookups of addresses in a rule table."""
    own = transport_only(tables.event_packets(spark, sf_dir))
    suppliers = tables.table(spark, sf_dir, "supplier")
    rules = suppliers.select(F.lit("ip").alias("kind"), F.concat(F.lit("10.0.0."), F.col("s_suppkey").cast("string")).alias("value"))
    both = [policy.blocked_rows(own, rules, "ip", "src_ip", keep).select("frame_no", F.lit(keep).alias("listed")) for keep in (True, False)]
    return both[0].unionByName(both[1])


@query("WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), n AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS rn FROM d), a AS (SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY 1), r AS (SELECT l_orderkey, count(*) FILTER (WHERE l_linenumber = rn) AS run FROM n GROUP BY 1) SELECT CAST(l_orderkey AS VARCHAR) AS flow_id, CAST(lines AS INTEGER) AS segments, 10 * run AS contiguous_bytes, run > 0 AS any_bytes FROM a JOIN r USING (l_orderkey)")
def first_flight_contiguous(spark, sf_dir):
    """Reassembly of an order's lines as segments with gaps and repeats, after a SYN."""
    lines = tables.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("flow_id"), "l_linenumber", "l_partkey", "l_suppkey")
    body = F.lpad(F.col("l_linenumber").cast("string"), 10, "0").cast("binary")
    order = F.xxhash64("l_partkey", "l_suppkey").bitwiseAND(F.lit(2**62 - 1)) + 1
    segments = lines.select("flow_id", order.alias("ord"), (4294967291 + (F.col("l_linenumber") - 1) * 10).alias("seq"), F.lit(False).alias("syn"), body.alias("data"))
    syns = lines.select("flow_id").distinct().select("flow_id", F.lit(0).cast("long").alias("ord"), F.lit(4294967290).alias("seq"), F.lit(True).alias("syn"), F.lit(None).cast("binary").alias("data"))
    wrapped = segments.withColumn("seq", F.col("seq") % 4294967296).unionByName(syns)
    out = reassembly.reassemble(wrapped)
    size = F.octet_length("contiguous").cast("long")
    return out.select("flow_id", "segments", size.alias("contiguous_bytes"), (size > 0).alias("any_bytes"))


def _flight_sql(max_bytes: int, max_segments: int, whole: str = "", more: str = "") -> str:
    """What the caps leave of a conversation whose turns arrive last first: nothing if the first turn comes too late."""
    return f"""
    WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations),
    p AS (SELECT *, sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) - strlen(text) AS place FROM t),
    n AS (SELECT conv_id, count(*) FILTER (WHERE strlen(text) > 0 AND place < {max_bytes}) AS segments, substr(hex(encode(string_agg(text, '' ORDER BY turn))), 1, {2 * max_bytes}) AS taken{whole} FROM p GROUP BY conv_id)
    SELECT CAST(conv_id AS VARCHAR) AS flow_id, CASE WHEN segments > {max_segments} THEN md5('') ELSE md5(unhex(taken)) END AS digest{more} FROM n"""


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as segments that arrive last first, after a SYN."""
    turns = tables.table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("flow_id"), "turn", F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    before = Window.partitionBy("flow_id").orderBy(F.asc_nulls_last("turn"), "data").rowsBetween(Window.unboundedPreceding, -1)
    placed = turns.withColumn("seq", 1001 + F.coalesce(F.sum(F.octet_length("data")).over(before), F.lit(0)))
    segments = placed.select("flow_id", (F.lit(1 << 40) - F.col("turn")).alias("ord"), "seq", F.lit(False).alias("syn"), "data")
    syns = turns.select("flow_id").distinct()
    whole = syns.select("flow_id", F.lit(0).cast("long").alias("ord"), F.lit(1000).cast("long").alias("seq"), F.lit(True).alias("syn"), F.lit(None).cast("binary").alias("data"))
    return segments.unionByName(whole)


def _flight_of_turns(spark: SparkSession, sf_dir: str, **caps: int) -> DataFrame:
    out = reassembly.reassemble(_turns(spark, sf_dir), **caps)
    return out.select("flow_id", F.md5("contiguous").alias("digest"))


@query(_flight_sql(FLIGHT_BYTES, FLIGHT_SEGMENTS, ", string_agg(text, '' ORDER BY turn NULLS LAST, text) AS every, sum(strlen(text)) AS size", ", CAST(size AS BIGINT) AS whole_bytes, md5(every) AS whole_digest"))
def first_flight_text(spark, sf_dir):
    """Reassembly of conversations whose turns arrive last first: each one's first flight, and its whole text beyond the caps."""
    whole = reassembly.whole_streams(_turns(spark, sf_dir)).select(F.col("flow_id").alias("id"), F.col("bytes").alias("whole_bytes"), F.col("digest").alias("whole_digest"))
    flights = _flight_of_turns(spark, sf_dir)
    return flights.join(whole, F.col("flow_id").eqNullSafe(F.col("id"))).drop("id")


@query(_flight_sql(300, 3))
def first_flight_capped(spark, sf_dir):
    """The same with caps that most conversations meet: 300 bytes and three segments."""
    return _flight_of_turns(spark, sf_dir, max_bytes=300, max_segments=3)


@query(f"{P} SELECT event_id AS frame_no, CASE WHEN dst_port = 53 THEN 'DNS' WHEN protocol = 6 AND dst_port IN (443, 80) AND NOT syn THEN {tables.HOST_APP_SQL} WHEN protocol = 6 AND dst_port = 443 THEN 'HTTPS' WHEN protocol = 6 AND dst_port = 80 THEN 'HTTP' ELSE 'Unknown' END AS app, dst_port = 53 OR (protocol = 6 AND dst_port IN (443, 80) AND NOT syn) AS decided, CASE WHEN dst_port = 53 THEN 'DNS query ''' || host || '''' WHEN protocol = 6 AND dst_port IN (443, 80) AND syn THEN 'port-based (still waiting for the first flight)' WHEN protocol = 6 AND dst_port IN (443, 80) THEN CASE dst_port WHEN 443 THEN 'SNI' ELSE 'HTTP Host' END || ' ''' || host || ''' ' || CASE WHEN host = 'x.com' THEN 'matched signature [suffix x.com]' WHEN {tables.HOST_APP_SQL} <> 'HTTPS' THEN 'matched signature [contains ' || CASE host WHEN 'cdn.discordapp.com' THEN 'discord' WHEN 'login.microsoftonline.com' THEN 'microsoft' ELSE lower({tables.HOST_APP_SQL}) END || ']' ELSE 'present but matched no signature' END ELSE 'no classifier applies (not 53/80/443 TCP/UDP)' END AS reason FROM packets")
def flow_verdicts(spark, sf_dir):
    """The verdict on the facts of each single packet, with its reason."""
    own = transport_only(tables.event_packets(spark, sf_dir))
    tls, dns = (F.col("protocol") == 6) & (F.col("dst_port") == 443), F.col("dst_port") == 53
    hello = l7.client_hello_column(F.when(tls, F.col("payload")))
    facts = own.withColumn("hello", hello).select("frame_no", "protocol", "dst_port", dns.alias("is_dns"), F.col("hello.sni").alias("sni"), F.when(F.col("dst_port") == 80, l7.http_host(F.col("payload"))).alias("http_host"), l7.dns_qname_column(F.when(dns, F.col("payload"))).alias("dns_qname"), F.col("hello").isNotNull().alias("clienthello_seen"), F.lit(False).alias("first_flight_full"), F.when(F.col("hello").isNotNull(), fingerprint.ja3_string(F.col("hello"))).alias("ja3_string"), F.when(F.col("hello").isNotNull(), fingerprint.ja3(F.col("hello"))).alias("ja3"), fingerprint.ja4(F.col("hello")).alias("ja4"))
    return classify.verdict(facts, signatures.builtin()).select("frame_no", "app", "decided", "reason")


_TRACED = f"""{C}, d AS (
    SELECT *, protocol = 6 AND server_port IN (443, 80) AND NOT back AS flight, 53 IN (src_port, dst_port) AS dns FROM c
), f AS (
    SELECT client_ip, client_port, server_ip, server_port, protocol, count(*) AS packets, CAST(sum(len) AS BIGINT) AS bytes, CAST(sum(CASE WHEN back THEN 0 ELSE payload END) AS BIGINT) AS client_bytes,
        min(event_id) AS first_packet, bool_or(syn) AS syn, bool_or(dns) AS dns, bool_or(flight) AS flight, bool_or(flight AND NOT syn) AS found, any_value(host) AS host, any_value({tables.HOST_APP_SQL}) AS app
    FROM d GROUP BY client_ip, client_port, server_ip, server_port, protocol
), v AS (
    SELECT *, CASE WHEN dns THEN 'DNS' WHEN found AND app = 'HTTPS' AND server_port = 80 THEN 'HTTP' WHEN found THEN app WHEN flight AND server_port = 443 THEN 'HTTPS' WHEN flight THEN 'HTTP' ELSE 'Unknown' END AS label, dns OR found AS decided,
        client_ip = '10.0.0.7' AS by_ip, found AND app = 'YouTube' AS by_app FROM f
)
SELECT client_ip || ':' || client_port AS src, server_ip || ':' || server_port AS dst, protocol AS proto, packets, bytes, client_bytes, first_packet, syn,
    CASE WHEN found AND server_port = 443 THEN host ELSE '' END AS sni, CASE WHEN found AND server_port = 80 THEN host ELSE '' END AS http_host, CASE WHEN dns THEN host ELSE '' END AS dns_qname, label AS app,
    CASE WHEN decided AND (by_ip OR by_app) THEN 'DROP' ELSE 'FORWARD' END AS verdict,
    CASE WHEN NOT decided THEN '' WHEN by_ip THEN 'ip rule ''10.0.0.7''' WHEN by_app THEN 'app rule ''YouTube''' ELSE 'no block rule matched' END AS block_reason
FROM v"""


@query(_TRACED)
def explain_verdicts(spark, sf_dir):
    """What the traces of all flows say in the end."""
    out = explain.explain(tables.event_packets(spark, sf_dir), None, _rules(), max_flows=None)
    return out.select("src", "dst", "proto", "packets", "bytes", "client_bytes", "first_packet", F.col("tcp.syn").alias("syn"), "sni", "http_host", "dns_qname", "app", "verdict", "block_reason")


@query()
def explain_trace(spark, sf_dir):
    """Traces of the twelve flows seen first."""
    return explain.explain(tables.event_packets(spark, sf_dir), None, _rules()).drop("text")


_FLOWS_ONCE = "SELECT DISTINCT user_id, k, protocol, dst_port, final_app, decided FROM packets"


def _metrics_sql() -> str:
    single = [
        ("packets", "Packets past the transport gate", "count(*)"),
        ("bytes", "Bytes of these packets", "CAST(sum(len) AS BIGINT)"),
        ("tcp_packets", "TCP packets", "count(*) FILTER (WHERE protocol = 6)"),
        ("udp_packets", "UDP packets", "count(*) FILTER (WHERE protocol = 17)"),
        ("forwarded", "Packets forwarded", "count(*) FILTER (WHERE NOT blocked)"),
        ("dropped", "Packets dropped by a rule", "count(*) FILTER (WHERE blocked)"),
    ]
    several = [
        ("app_packets_total", "Packets per application", "counter", "app", "SELECT app AS label, count(*) AS n FROM packets GROUP BY app"),
        ("signature_label_flows", "Flows per signature label", "counter", "label", f"SELECT final_app AS label, count(*) AS n FROM ({_FLOWS_ONCE}) WHERE decided IS NOT NULL AND dst_port = 443 AND final_app <> 'HTTPS' GROUP BY final_app"),
        ("ja4_flows", "Flows per JA4 fingerprint", "counter", "ja4", f"SELECT 't13d0202' || '00_' || substr(sha256('1301,1302'), 1, 12) || '_' || substr(sha256('002b_'), 1, 12) AS label, count(*) AS n FROM ({_FLOWS_ONCE}) WHERE decided IS NOT NULL AND dst_port = 443 HAVING count(*) > 0"),
    ]
    named = [(f"{n}_total", t, "counter") for n, t, _ in single] + [x[:3] for x in several]
    parts = [f"SELECT {k} AS family, 0 AS part, {m}::BIGINT AS n, '' AS label, '# {word} flowlens_{name} {said}' AS text" for k, (name, help_, kind) in enumerate(named) for m, (word, said) in enumerate((("HELP", help_), ("TYPE", kind)))]
    parts += [f"SELECT {k}, 1, 0, '', 'flowlens_{n}_total ' || {count} FROM blocked" for k, (n, _, count) in enumerate(single)]
    parts += [f"SELECT {len(single) + k}, 1, -n, label, 'flowlens_{name}{{{key}=\"' || label || '\"}} ' || n FROM ({rows})" for k, (name, _, _, key, rows) in enumerate(several)]
    return f"{B}, l AS ({' UNION ALL '.join(parts)}) SELECT CAST(family AS INTEGER) AS family, CAST(row_number() OVER (PARTITION BY family ORDER BY part, n, label) - 1 AS INTEGER) AS line, text FROM l"


@query(_metrics_sql())
def prometheus_text(spark, sf_dir):
    """Metrics of the events, a row for each line."""
    packets = tables.event_packets(spark, sf_dir)
    return reports.metrics_lines(packets, _classified(spark, sf_dir), classify.classified_flows(packets, signatures.builtin()))


@query(f"{B} SELECT event_id, app, sni, final_app, blocked FROM blocked")
def captures_in_parts(spark, sf_dir):
    """The events dealt into three captures, each with numbers of its own: the same results as from one."""
    frames = tables.event_frames(spark, sf_dir).withColumn("event_id", F.col("frame_no"))
    dealt = frames.withColumns({"source": F.concat(F.lit("part "), (2 - F.col("event_id") % 3).cast("string")), "frame_no": F.floor(F.col("event_id") / 3), "arrived": F.col("event_id")})
    return classify.classify_packets(decode(dealt), None, _rules()).select("event_id", "app", "sni", "final_app", "blocked")


def _cut_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth frame cut short."""
    short = F.when(F.col("frame_no") % 4 == 0, F.substring("data", F.lit(1), (F.col("frame_no") % 61).cast("int"))).otherwise(F.col("data"))
    return decode(tables.event_frames(spark, sf_dir).withColumn("data", short))


_CUT = f"""{tables.EVENTS_SQL.strip()}, cut AS (SELECT *, CASE event_id % 4 WHEN 0 THEN least(len, event_id % 61) ELSE len END AS n FROM r),
    seen AS (SELECT *, n >= 34 AS has_ip, CASE protocol WHEN 6 THEN 54 ELSE 42 END AS need FROM cut)"""


@query(f"WITH {_CUT} SELECT event_id AS frame_no, CAST(n AS BIGINT) AS frame_bytes, has_ip, n >= need AS parse_ok, CASE WHEN n >= need THEN CAST(n - need AS BIGINT) ELSE -1 END AS payload_length, CASE WHEN n >= need THEN dst_port ELSE -1 END AS dst_port FROM seen")
def malformed_frames(spark, sf_dir):
    """What can be decoded of frames, every fourth of which is cut short."""
    return _cut_frames(spark, sf_dir).select("frame_no", "has_ip", "parse_ok", F.col("frame_bytes").cast("long").alias("frame_bytes"), F.coalesce("payload_length", F.lit(-1)).cast("long").alias("payload_length"), F.coalesce("dst_port", F.lit(-1)).alias("dst_port"))


@query(f"WITH {_CUT} SELECT count(*) AS frames, CAST(sum(n) AS BIGINT) AS frame_bytes, count(*) FILTER (WHERE n < need) AS parse_errors, count(*) FILTER (WHERE n >= need) AS packets, count(*) FILTER (WHERE n >= need AND protocol = 6) AS tcp_packets, count(*) FILTER (WHERE n >= need AND protocol = 17) AS udp_packets FROM seen")
def frame_totals(spark, sf_dir):
    """Totals of these frames, with parse errors."""
    return reports.frame_totals(_cut_frames(spark, sf_dir)).drop("bytes")


@query(f"WITH {tables.EVENTS_SQL} SELECT event_id AS frame_no, '02:00:00:00:00:01' AS src_mac, '02:00:00:00:00:02' AS dst_mac, 2048::BIGINT AS ether_type, 4 AS ip_version, 64 AS ttl, CAST(10 + (user_id // 256) * 65536 + (user_id % 256) * 16777216 AS BIGINT) AS src_ip_le FROM r")
def link_fields(spark, sf_dir):
    """Link and network fields of every frame."""
    return tables.event_packets(spark, sf_dir).select("frame_no", "src_mac", "dst_mac", "ether_type", "ip_version", "ttl", "src_ip_le")


#: Flags of an event's packet, by its number.
_FLAGS = [0x02, 0x12, 0x10, 0x18, 0x11, 0x14, 0x02]
_FLAGS_SQL = f"CASE (event_id // 3) % 7 {' '.join(f'WHEN {k} THEN {v}' for k, v in enumerate(_FLAGS))} END"


@query(f"""WITH e AS (SELECT event_id, user_id, {_FLAGS_SQL} AS f FROM events), g AS (
    SELECT user_id, min(event_id) FILTER (WHERE f & 18 = 2) AS s, min(event_id) FILTER (WHERE f & 18 = 18) AS a, min(event_id) FILTER (WHERE f & 1 = 1) AS fin, min(event_id) FILTER (WHERE f & 4 = 4) AS rst, max(event_id) FILTER (WHERE f & 16 = 16) AS ack FROM e GROUP BY user_id
), h AS (SELECT *, s IS NOT NULL AND a IS NOT NULL AND coalesce(ack >= greatest(s, a), false) AS established FROM g)
SELECT user_id, s IS NOT NULL AS syn, a IS NOT NULL AS syn_ack, fin IS NOT NULL AS fin, rst IS NOT NULL AS rst, established, CASE WHEN rst IS NOT NULL OR coalesce(ack >= fin, false) THEN 'CLOSED' WHEN established THEN 'ESTABLISHED' ELSE 'NEW' END AS state FROM h""")  # fmt: skip
def tcp_state_flows(spark, sf_dir):
    """The state each user's connection ends in, packets in both directions."""
    user, back = F.col("user_id"), F.col("event_id") % 2 == 1
    ends = {
        "ip": (F.format_string("10.0.%d.%d", F.floor(user / 256), user % 256), F.lit("172.16.0.1")),
        "ip_le": (10 + F.floor(user / 256) * 65536 + user % 256 * 16777216, F.lit(172 + 16 * 256 + (1 << 24)).cast("long")),
        "port": (F.lit(50000), F.lit(443)),
    }
    flags = F.get(F.lit(_FLAGS), (F.floor(F.col("event_id") / 3) % 7).cast("int"))
    sides = [F.when(back, pair[1 - k]).otherwise(pair[k]).alias(f"{side}_{name}") for name, pair in ends.items() for k, side in enumerate(("src", "dst"))]
    packets = tables.table(spark, sf_dir, "events").select(F.col("event_id").alias("frame_no"), F.lit(True).alias("has_tcp"), flags.alias("tcp_flags"), F.lit(6).alias("protocol"), *sides)
    octet = lambda k: F.split_part("client_ip", F.lit("."), F.lit(k)).cast("long")
    return flows.tcp_states(packets).select((octet(3) * 256 + octet(4)).alias("user_id"), "syn", "syn_ack", "fin", "rst", "established", "state")


#: Rules over the fingerprints of parts' hellos.
PART_RULES = "ja3 771,257-4865-49196,0-43,, One\nja4prefix t13d0302 Three\nja4prefix t13d0402 Four\nja4prefix t13 Other\n"


@query(f"""WITH f AS ({_JA_SQL})
    SELECT p_partkey, CASE WHEN ja3_string = '771,257-4865-49196,0-43,,' THEN 'One' WHEN starts_with(ja4, 't13d0302') THEN 'Three' WHEN starts_with(ja4, 't13d0402') THEN 'Four' ELSE 'Other' END AS label FROM f""")  # fmt: skip
def fingerprint_rules(spark, sf_dir):
    """Labels of hellos by rules over JA3 and JA4; a rule over JA3 comes before any over JA4."""
    prints = tls_ja3_ja4(spark, sf_dir)
    return prints.select("p_partkey", signatures.label(None, F.col("ja3_string"), F.col("ja3"), F.col("ja4"), signatures.parse(PART_RULES)).alias("label"))


@query("SELECT p_partkey, CASE p_size % 6 WHEN 4 THEN 'TLS1.3' WHEN 3 THEN 'TLS1.2' WHEN 2 THEN 'TLS1.1' WHEN 1 THEN 'TLS1.0' WHEN 0 THEN 'SSL3.0' ELSE '?' END AS version, CASE p_size WHEN 1 THEN 'ICMP' WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' ELSE 'Unknown(' || p_size || ')' END AS protocol FROM part")
def text_forms(spark, sf_dir):
    """Names of TLS versions and protocols."""
    size = F.col("p_size").cast("int")
    return tables.table(spark, sf_dir, "part").select("p_partkey", text.tls_version_text(0x0300 + size % 6).alias("version"), text.protocol_text(size).alias("protocol"))


@query()
def sample_capture(spark, sf_dir):
    """The sample capture's packets with application and verdict."""
    frames = spark.createDataFrame(synthetic.frame_rows(synthetic.sample_frames()), "source string, frame_no long, ts_sec long, ts_usec int, incl_len long, orig_len long, link_type int, data binary")
    rules = policy.BlockRules()
    rules.block("ip", synthetic.SAMPLE_BLOCKED)
    rules.block("app", "YouTube")
    return classify.classify_packets(decode(frames), None, rules).select("frame_no", "src_ip", "dst_ip", "app", "sni", "ja3", "ja4", "blocked")
