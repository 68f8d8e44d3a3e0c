"""Flow keys and aggregates of flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowlens.functions.decode import ARRIVAL, arrival
from flowlens.schemas import FLOW_KEY, IDLE_SECONDS

_WELL_KNOWN = (443, 80, 53)


def canonical(packets: DataFrame) -> DataFrame:
    """packets with client_ip, client_port, server_ip, server_port and to_server: the direction that both ways share.

    A well-known port on one side alone makes that side the server; else the smaller (address, port) is the client,
    addresses compared as numbers whose lowest byte is the first octet.
    """
    known = lambda c: F.col(c).isin(*_WELL_KNOWN)
    smaller = (F.col("src_ip_le") < F.col("dst_ip_le")) | ((F.col("src_ip_le") == F.col("dst_ip_le")) & (F.col("src_port") <= F.col("dst_port")))
    forward = F.when(known("dst_port") & ~known("src_port"), True).when(known("src_port") & ~known("dst_port"), False).otherwise(smaller)
    out = packets.withColumn("to_server", forward)
    pick = lambda a, b: F.when(F.col("to_server"), F.col(a)).otherwise(F.col(b))
    out = out.withColumns({"client_ip": pick("src_ip", "dst_ip"), "client_port": pick("src_port", "dst_port"), "server_ip": pick("dst_ip", "src_ip"), "server_port": pick("dst_port", "src_port")})
    # a packet from an endpoint to itself goes the client's way
    return out.withColumn("to_server", F.col("to_server") | ((F.col("src_ip") == F.col("dst_ip")) & (F.col("src_port") == F.col("dst_port"))))


CANONICAL_KEY = ["client_ip", "client_port", "server_ip", "server_port", "protocol"]


def reversed_key(prefix: str = "") -> list[Column]:
    """The five-tuple of the other direction."""
    return [F.col(f"{prefix}{a}").alias(b) for a, b in (("dst_ip", "src_ip"), ("src_ip", "dst_ip"), ("dst_port", "src_port"), ("src_port", "dst_port"), ("protocol", "protocol"))]


def flow_stats(packets: DataFrame) -> DataFrame:
    """Packets, bytes and the number of the first packet of each directional flow."""
    return packets.groupBy(*FLOW_KEY).agg(F.count(F.lit(1)).alias("packets"), F.sum("frame_bytes").alias("bytes"), F.min(arrival(packets))["frame_no"].alias("first_packet"))


def canonical_stats(packets: DataFrame, ts: str = "ts_sec") -> DataFrame:
    """Both directions of a flow together; first and last time are those of the first and last packet to arrive."""
    own, order = canonical(packets), arrival(packets)
    way = lambda to: F.sum(F.when(F.col("to_server") == to, F.col("payload_length")).otherwise(0))
    out = own.groupBy(*CANONICAL_KEY).agg(
        F.count(F.lit(1)).alias("packets"),
        F.sum("frame_bytes").alias("bytes"),
        way(True).alias("client_bytes"),
        way(False).alias("server_bytes"),
        F.min_by(ts, order).alias("ts_first"),
        F.max_by(ts, order).alias("ts_last"),
        F.min(order).alias("first_arrival"),
        F.min(order)["frame_no"].alias("first_packet"),
    )
    return out.withColumn("duration", F.when(F.col("ts_last") >= F.col("ts_first"), F.col("ts_last") - F.col("ts_first")))


def direction_pairs(packets: DataFrame) -> DataFrame:
    """Directional flows that have a flow the other way, with the packets of both."""
    own = flow_stats(packets)
    other = own.select(*reversed_key(), F.col("packets").alias("reverse_packets"))
    return own.join(other, FLOW_KEY)


def idle_sessions(packets: DataFrame, key: list[str], ts: str = "ts", idle: int = IDLE_SECONDS) -> DataFrame:
    """packets with session (from 0): a flow begins anew after more than `idle` whole seconds without a packet."""
    by = Window.partitionBy(*key).orderBy(ts, *[c for c in ARRIVAL if c in packets.columns])
    gap = F.floor((F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(by).cast("timestamp"))) / 1_000_000)
    out = packets.withColumn("_new", F.when(gap > idle, 1).otherwise(0))
    return out.withColumn("session", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


#: Flows whose keys are surely few enough to be sent to every task.
_FEW = 10_000


def first_flows(packets: DataFrame, key: list[str], n: int) -> DataFrame:
    """Packets of the n flows seen first."""
    first = packets.groupBy(*key).agg(F.min(arrival(packets)).alias("_first")).orderBy("_first").limit(n).select(*key)
    # keys hold no nulls after the transport gate
    return packets.join(F.broadcast(first) if n <= _FEW else first, key, "left_semi")


def top_domains(rows: DataFrame, column: str, n: int = 20) -> DataFrame:
    """The n most frequent names, ties in order of name."""
    return rows.filter(F.coalesce(F.col(column), F.lit("")) != "").groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(n)


def _flag(bit: int) -> Column:
    return F.col("tcp_flags").bitwiseAND(F.lit(bit)) != 0


def handshakes(packets: DataFrame) -> DataFrame:
    """Of each bidirectional TCP flow: where its first SYN, answer to it, FIN and reset, and its last acknowledgement arrived."""
    own, order = canonical(packets.filter("has_tcp")), arrival(packets)
    first = lambda test: F.min(F.when(test, order))
    tests = {"syn_at": _flag(0x02) & ~_flag(0x10), "answer_at": _flag(0x02) & _flag(0x10), "fin_at": _flag(0x01), "rst_at": _flag(0x04)}
    return own.groupBy(*CANONICAL_KEY).agg(*[first(t).alias(c) for c, t in tests.items()], F.max(F.when(_flag(0x10), order)).alias("ack_at"))


def tcp_states(packets: DataFrame) -> DataFrame:
    """The state that each bidirectional TCP flow ends in, with its flags.

    Established needs a SYN, an answer to it, and an acknowledgement from then on; closed a reset, or an
    acknowledgement with or after a FIN.
    """
    seen = lambda c: F.col(c).isNotNull()
    yes = lambda c: F.coalesce(c, F.lit(False))
    established = yes(F.col("ack_at") >= F.greatest("syn_at", "answer_at")) & seen("syn_at") & seen("answer_at")
    closed = seen("rst_at") | yes(F.col("ack_at") >= F.col("fin_at"))
    return handshakes(packets).select(
        *CANONICAL_KEY,
        seen("syn_at").alias("syn"),
        seen("answer_at").alias("syn_ack"),
        seen("fin_at").alias("fin"),
        seen("rst_at").alias("rst"),
        established.alias("established"),
        F.when(closed, "CLOSED").when(established, "ESTABLISHED").otherwise("NEW").alias("state"),
    )


def replay(frames: DataFrame, times: int, seconds: int) -> DataFrame:
    """Frames again and again, each round `seconds` later and numbered on from the one before."""
    count = frames.agg(F.coalesce(F.max("frame_no") + 1, F.lit(0)).alias("n")).first()["n"]
    rounds = frames.withColumn("_round", F.explode(F.sequence(F.lit(0), F.lit(times - 1))) if times > 0 else F.explode(F.array().cast("array<int>")))
    later = {"frame_no": F.col("frame_no") + F.col("_round") * F.lit(count), "ts_sec": F.col("ts_sec") + F.col("_round") * seconds}
    if "arrived" in frames.columns:
        later["arrived"] = F.col("arrived") + F.col("_round") * seconds * 1_000_000
    return rounds.withColumns(later).drop("_round")
