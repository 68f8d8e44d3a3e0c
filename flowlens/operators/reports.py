"""Aggregates of classified packets and flows, and their text forms."""

from __future__ import annotations

import functools
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowlens.functions import text
from flowlens.functions.decode import arrival, transport_only

PREFIX = "flowlens"


def frame_totals(frames: DataFrame) -> DataFrame:
    """One row: all frames and their bytes, parse errors; packets past the gate and their bytes, by transport."""
    gate = F.col("parse_ok") & F.col("has_ip") & (F.col("has_tcp") | F.col("has_udp"))
    return frames.agg(
        F.count(F.lit(1)).alias("frames"),
        F.coalesce(F.sum("frame_bytes"), F.lit(0)).alias("frame_bytes"),
        F.count_if(~F.col("parse_ok")).alias("parse_errors"),
        F.count_if(gate).alias("packets"),
        F.coalesce(F.sum(F.when(gate, F.col("frame_bytes"))), F.lit(0)).alias("bytes"),
        F.count_if(gate & F.col("has_tcp")).alias("tcp_packets"),
        F.count_if(gate & F.col("has_udp")).alias("udp_packets"),
    )


def totals(frames: DataFrame, classified: DataFrame) -> DataFrame:
    """One row: totals of the frames, and packets forwarded and dropped."""
    return frame_totals(frames).crossJoin(forward_drop(classified))  # one row each


def transport_totals(packets: DataFrame) -> DataFrame:
    own = transport_only(packets)
    return own.agg(F.count(F.lit(1)).alias("packets"), F.coalesce(F.sum("frame_bytes"), F.lit(0)).alias("bytes"), F.count_if("has_tcp").alias("tcp_packets"), F.count_if("has_udp").alias("udp_packets"))


def forward_drop(classified: DataFrame) -> DataFrame:
    rate = F.when(F.count(F.lit(1)) > 0, 100.0 * F.count_if("blocked") / F.count(F.lit(1))).otherwise(0.0)
    return classified.agg(F.count_if(~F.col("blocked")).alias("forwarded"), F.count_if("blocked").alias("dropped"), rate.alias("drop_rate"))


def app_packets(classified: DataFrame) -> DataFrame:
    """Packets and bytes of each application, at the packets' time, with share of all and a bar of # for each 5 %."""
    out = classified.groupBy("app").agg(F.count(F.lit(1)).alias("packets"), F.sum("frame_bytes").alias("bytes"))
    share = 100.0 * F.col("packets") / _all("packets")
    return out.select("app", "packets", "bytes", share.alias("share"), F.repeat(F.lit("#"), F.floor(share / 5).cast("int")).alias("bar"))


def _all(column: str):
    """The sum over all rows: one for each application, so few."""
    return F.sum(column).over(Window.partitionBy(F.lit(0)))


def names_seen(classified: DataFrame) -> DataFrame:
    """Each name with the application of the last packet that had it."""
    return classified.filter("sni != ''").groupBy("sni").agg(F.max_by("app", arrival(classified)).alias("app"), F.count(F.lit(1)).alias("packets"))


def flows_by(flows: DataFrame, column: str) -> DataFrame:
    """Flows per label, JA3 or JA4."""
    return flows.filter(F.coalesce(F.col(column), F.lit("")) != "").groupBy(column).agg(F.count(F.lit(1)).alias("flows"))


def app_flows(flows: DataFrame) -> DataFrame:
    """Flows of each application with their share."""
    out = flows.groupBy("app").agg(F.count(F.lit(1)).alias("flows"))
    return out.select("app", "flows", (100.0 * F.col("flows") / _all("flows")).alias("share"))


def classification_totals(flows: DataFrame) -> DataFrame:
    """One row: flows, and those with and without an application."""
    known = F.col("app") != "Unknown"
    return flows.agg(F.count(F.lit(1)).alias("flows"), F.count_if(known).alias("classified"), F.count_if(~known).alias("unknown"), F.count_if(F.col("via") == "tls").alias("hellos"), F.count_if(F.col("decided_at").isNotNull()).alias("decided"))


def worker_counts(classified: DataFrame) -> DataFrame:
    """Packets of each partition: where the work went."""
    return classified.groupBy(F.spark_partition_id().alias("worker")).agg(F.count(F.lit(1)).alias("packets"), F.count_if("blocked").alias("dropped"))


def packet_dump(packets: DataFrame) -> DataFrame:
    """frame_no and a text of several lines for each packet: time, link, addresses, transport and the payload's first bytes."""
    c, line = F.col, F.format_string
    head = line("Packet #%d  %s.%06d  %d bytes", c("frame_no") + 1, F.date_format(F.timestamp_seconds("ts_sec"), "yyyy-MM-dd HH:mm:ss"), c("ts_usec"), c("frame_bytes"))
    link = F.when(c("dst_mac").isNotNull(), line("  Ethernet  %s -> %s  type 0x%04x", c("src_mac"), c("dst_mac"), c("ether_type")))
    ip = F.when(c("has_ip"), line("  IPv4      %s -> %s  ttl %d  %s", c("src_ip"), c("dst_ip"), c("ttl"), text.protocol_text(c("protocol"))))
    tcp = F.when(c("has_tcp"), line("  TCP       %d -> %d  seq %d  ack %d  [%s]", c("src_port"), c("dst_port"), c("seq"), c("ack"), text.tcp_flags_text(c("tcp_flags"))))
    udp = F.when(c("has_udp"), line("  UDP       %d -> %d", c("src_port"), c("dst_port")))
    body = F.when(c("payload_length") > 0, line("  Payload   %d bytes  %s%s", c("payload_length"), text.payload_preview(c("payload")), F.when(c("payload_length") > 32, " ...").otherwise("")))
    bad = F.when(~c("parse_ok"), "  (not decoded)")
    return packets.select("frame_no", F.concat_ws("\n", head, link, ip, tcp, udp, body, bad).alias("text"))


def escaped_label(text: str) -> str:
    return text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")


def scalar(name: str, help_: str, kind: str, value: int) -> str:
    return f"# HELP {name} {help_}\n# TYPE {name} {kind}\n{name} {value}\n"


def labelled(name: str, help_: str, kind: str, key: str, series: Iterable[tuple[str, int]]) -> str:
    return f"# HELP {name} {help_}\n# TYPE {name} {kind}\n" + "".join(f'{name}{{{key}="{escaped_label(label)}"}} {n}\n' for label, n in series)


def _family(place: int, name: str, help_: str, kind: str, rows: DataFrame) -> DataFrame:
    """A family's lines; rows (n, label, text) are its samples, the largest number first."""
    name = f"{PREFIX}_{name}"
    head = rows.sparkSession.createDataFrame([(0, 0, "", f"# HELP {name} {help_}"), (0, 1, "", f"# TYPE {name} {kind}")], "part int, n long, label string, text string")
    samples = rows.select(F.lit(1).alias("part"), (-F.col("n")).alias("n"), "label", F.concat(F.lit(name), "text").alias("text"))
    return head.unionByName(samples).withColumn("family", F.lit(place))


def _labels(rows: DataFrame, key: str, n: str) -> DataFrame:
    escaped = F.col(key)
    for raw, written in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(written))
    return rows.select(F.col(n).alias("n"), F.col(key).alias("label"), F.concat(F.lit(f'{{{key}="'), escaped, F.lit('"} '), F.col(n).cast("string")).alias("text"))


def metrics_lines(frames: DataFrame, classified: DataFrame, flows: DataFrame, per_flow_apps: bool = False) -> DataFrame:
    """(family, line, text): metrics in the Prometheus text format, every sample of every family.

    per_flow_apps counts connections, not packets, per application. Lines of a family are in order of number and label.
    """
    single = [("packets", "Packets past the transport gate"), ("bytes", "Bytes of these packets"), ("tcp_packets", "TCP packets"), ("udp_packets", "UDP packets"), ("forwarded", "Packets forwarded"), ("dropped", "Packets dropped by a rule")]
    t = totals(frames, classified).first()  # one row
    one = lambda n: classified.sparkSession.createDataFrame([(0, "", f" {n}")], "n long, label string, text string")
    families = [(f"{name}_total", text, "counter", one(t[name])) for name, text in single]
    if per_flow_apps:
        active = flows.agg(F.lit(0).cast("long").alias("n"), F.lit("").alias("label"), F.format_string(" %d", F.count(F.lit(1))).alias("text"))
        families += [("active_connections", "Flows seen", "gauge", active), ("app_connections", "Flows per application", "gauge", _labels(app_flows(flows), "app", "flows"))]
    else:
        families += [
            ("app_packets_total", "Packets per application", "counter", _labels(app_packets(classified), "app", "packets")),
            ("signature_label_flows", "Flows per signature label", "counter", _labels(flows_by(flows, "label"), "label", "flows")),
            ("ja4_flows", "Flows per JA4 fingerprint", "counter", _labels(flows_by(flows, "ja4"), "ja4", "flows")),
        ]
    lines = functools.reduce(DataFrame.unionByName, [_family(k, *f) for k, f in enumerate(families)])
    line = F.row_number().over(Window.partitionBy("family").orderBy("part", "n", "label")) - 1
    return lines.select("family", line.alias("line"), "text")


def metrics_text(frames: DataFrame, classified: DataFrame, flows: DataFrame, per_flow_apps: bool = False) -> str:
    """The lines as one text for a scraper, which holds all it is sent."""
    return "".join(f"{r.text}\n" for r in metrics_lines(frames, classified, flows, per_flow_apps).orderBy("family", "line").toLocalIterator())


def _series(df: DataFrame, key: str, n: str) -> list[tuple[str, int]]:
    return [(r[key], r[n]) for r in df.orderBy(F.desc(n), key).toLocalIterator()]


def report_text(frames: DataFrame, classified: DataFrame, flows: DataFrame, profile: str = "mt") -> str:
    """Totals, verdicts, applications with share and bar, names, labels and fingerprints."""
    t = totals(frames, classified).first()
    packets, size = (t["frames"], t["frame_bytes"]) if profile == "lite" else (t["packets"], t["bytes"])
    lines = ["PROCESSING REPORT", f"  Total packets  {packets:>12}", f"  Total bytes    {size:>12}", f"  TCP packets    {t['tcp_packets']:>12}", f"  UDP packets    {t['udp_packets']:>12}", f"  Parse errors   {t['parse_errors']:>12}", f"  Forwarded      {t['forwarded']:>12}", f"  Dropped        {t['dropped']:>12}"]
    if profile == "classic":
        c = classification_totals(flows).first()
        lines += [f"  Drop rate      {t['drop_rate']:>11.2f}%", f"  Connections    {c['flows']:>12}", f"  Classified     {c['classified']:>12}", f"  Unidentified   {c['unknown']:>12}"]
    if profile == "lite":
        lines.append(f"  Active flows   {flows.count():>12}")
    lines += ["", "APPLICATION BREAKDOWN"]
    lines += [f"  {r['app']:<15}{r['packets']:>8} {100.0 * r['packets'] / packets if packets else 0:>5.1f}% {r['bar']}" for r in app_packets(classified).orderBy(F.desc("packets"), "app").collect()]
    shown = [("DETECTED NAMES", [f"  {r['sni']} -> {r['app']}" for r in names_seen(classified).orderBy("sni").toLocalIterator()])]
    shown += [(title, [f"  {label}  x{n}" for label, n in _series(flows_by(flows, c), c, "flows")]) for title, c in (("SIGNATURE LABELS", "label"), ("JA3", "ja3"), ("JA4", "ja4"))]
    for title, rows in shown:
        if rows:
            lines += ["", title, *rows]
    return "\n".join(lines) + "\n"


def top_domains_text(domains: Iterable[tuple[str, int]]) -> str:
    """Names and counts, long names cut short."""
    return "".join(f"  {name if len(name) <= 35 else name[:32] + '...':<40}{n:>8}\n" for name, n in domains)
