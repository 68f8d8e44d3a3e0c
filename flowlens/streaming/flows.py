"""Classification and rates over streams of frames."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flowlens.functions.decode import ARRIVAL, decode, transport_only
from flowlens.operators import classify, policy, signatures
from flowlens.operators.reassembly import FirstFlight
from flowlens.schemas import APPS, FLOW_KEY, IDLE_SECONDS

EVENTS_DDL = "src_ip string, dst_ip string, src_port int, dst_port int, protocol int, event string, frame_no long, app string, sni string, label string, ja3 string, ja4 string, packets long, bytes long"


def _app(rule: signatures.Rule | None) -> str:
    return rule.app if rule and rule.app in APPS[1:] else "HTTPS"


class FlowProcessor(StatefulProcessor):
    """A flow's state: counters and first flight. Emits one row when a packet decides the flow, one when it ends idle."""

    def __init__(self, rules: list[signatures.Rule], idle: int = IDLE_SECONDS):
        self.rules, self.idle = rules, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("flow", "body binary")

    def close(self) -> None:
        pass

    def _load(self) -> dict:
        if self.state.exists():
            return pickle.loads(self.state.get()[0])
        return {"flight": FirstFlight(), "decided": None, "packets": 0, "bytes": 0, "last": 0, "timer": None}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s, out = self._load(), []
        arrived = pd.concat(list(rows))
        for r in arrived.sort_values([c for c in ARRIVAL if c in arrived.columns], kind="stable").to_dict("records"):
            s["packets"] += 1
            s["bytes"] += r["frame_bytes"]
            s["last"] = max(s["last"], int(pd.Timestamp(r["ts"]).timestamp() * 1000))
            if s["decided"] is None and (found := self._decide(s, key, r)):
                s["decided"], s["flight"] = found, None
                out.append(self._row(key, "decided", r["frame_no"], s))
        if s["timer"] is not None:
            self.handle.deleteTimer(s["timer"])
        s["timer"] = s["last"] + (self.idle + 1) * 1000
        self.handle.registerTimer(s["timer"])
        self.state.update((pickle.dumps(s),))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in EVENTS_DDL.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        s = self._load()
        self.state.clear()
        yield pd.DataFrame([self._row(key, "idle", None, s)], columns=[c.split()[0] for c in EVENTS_DDL.split(", ")])

    def _decide(self, s: dict, key: tuple, r: dict) -> dict | None:
        _, _, src_port, dst_port, protocol = key
        if protocol == 6 and dst_port in (443, 80):
            row = {"seq": int(r["seq"]), "tcp_flags": int(r["tcp_flags"]), "payload": r["payload"] if isinstance(r["payload"], (bytes, bytearray)) else None, "dst_port": dst_port}
            found = classify._mt_step(s["flight"], row)
            return found and self._named(*found, dst_port)
        return {"app": "DNS"} if 53 in (src_port, dst_port) else None

    def _named(self, via: str, host: str | None, hello, dst_port: int) -> dict:
        from flowlens.functions import fingerprint

        if via == "full":
            return {"app": "HTTPS" if dst_port == 443 else "HTTP"}
        rule = signatures.match_host(host, self.rules) if host else None
        if via == "http":
            return {"app": _app(rule) if host else "Unknown", "sni": host}
        text, ja3, ja4 = fingerprint.ja3_string_of(hello), fingerprint.ja3_of(hello), fingerprint.ja4_of(hello)
        rule = rule or signatures.match_ja3(text, ja3, self.rules) or signatures.match_ja4(ja4, self.rules)
        return {"app": _app(rule), "sni": host, "label": rule and rule.app, "ja3": ja3, "ja4": ja4}

    def _row(self, key: tuple, event: str, frame_no: int | None, s: dict) -> tuple:
        found = s["decided"] or {"app": {443: "HTTPS", 80: "HTTP"}.get(key[3], "Unknown") if key[4] == 6 else "Unknown"}
        return (*key, event, frame_no, *(found.get(c) for c in ("app", "sni", "label", "ja3", "ja4")), s["packets"], s["bytes"])


def flow_events(frames: DataFrame, rules: list[signatures.Rule] | None = None, idle: int = IDLE_SECONDS, late: str = "10 minutes") -> DataFrame:
    """A stream of frames -> a stream of flow events; state is dropped once a flow is idle in event time.

    Needs the RocksDB state store provider. Within a batch frames are taken in order of arrival.
    """
    packets = transport_only(decode(frames)).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    own = packets.select(*FLOW_KEY, "ts", *[c for c in ARRIVAL if c in packets.columns], "frame_bytes", "seq", "tcp_flags", "payload")
    processor = FlowProcessor(signatures.builtin() if rules is None else rules, idle)
    return own.groupBy(*FLOW_KEY).transformWithStateInPandas(statefulProcessor=processor, outputStructType=EVENTS_DDL, outputMode="Append", timeMode="EventTime")


def rates(packets: DataFrame, width: str = "1 minute", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Packets and bytes per second in windows of event time, tumbling or sliding; for streams and for tables."""
    seconds = F.unix_timestamp("window.end") - F.unix_timestamp("window.start")
    own = packets.withColumn("ts", F.col("ts").cast("timestamp"))
    own = own.withWatermark("ts", late) if packets.isStreaming else own
    out = own.groupBy(F.window("ts", width, slide)).agg(F.count(F.lit(1)).alias("packets"), F.sum("frame_bytes").alias("bytes"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "packets", "bytes", (F.col("packets") / seconds).alias("packets_per_s"))


def live_totals(frames: DataFrame) -> DataFrame:
    """Running counters over a stream, for the complete output mode."""
    own = transport_only(decode(frames))
    return own.groupBy().agg(F.count(F.lit(1)).alias("packets"), F.sum("frame_bytes").alias("bytes"), F.count_if("has_tcp").alias("tcp_packets"), F.count_if("has_udp").alias("udp_packets"))


def late_packets(packets: DataFrame, behind: str = "10 minutes") -> DataFrame:
    """Packets of a batch that are further behind its latest one than a watermark allows: the side output of foreachBatch."""
    own = packets.withColumn("ts", F.col("ts").cast("timestamp"))
    latest = own.agg(F.max("ts").alias("_latest"))  # one row
    return own.join(F.broadcast(latest), F.col("ts") < F.col("_latest") - F.expr(f"INTERVAL {behind}")).drop("_latest")


def with_rules_of_each_batch(sink: Callable[[DataFrame, int], None], load_rules: Callable[[], policy.BlockRules]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that reads the rules anew for every batch, then hands on what they let pass.

    Rows have src_ip, dst_port, app and sni, as classified packets and flow events have; a rule added while the stream
    runs holds from the next batch on.
    """

    def run(batch: DataFrame, number: int) -> None:
        hit = policy.block_reason(load_rules(), F.col("src_ip"), F.col("dst_port"), F.col("app"), F.col("sni"))
        sink(batch.filter(hit.isNull()), number)

    return run
