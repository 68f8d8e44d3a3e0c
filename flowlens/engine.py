"""One object for a run: source, signatures, rules and results."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions import l7
from flowlens.functions.decode import ARRIVAL, arrival, decode, transport_only
from flowlens.operators import classify, explain, policy, reports, signatures
from flowlens.sources import pcap


class Engine:
    """Signatures and block rules, applied to captures in one of the profiles mt, lite and classic."""

    def __init__(self, spark: SparkSession, profile: str = "mt"):
        if profile not in classify.PROFILES:
            raise ValueError(f"no profile: {profile}")
        self.spark, self.profile = spark, profile
        self.signatures, self.rules = signatures.builtin(), policy.BlockRules()
        pcap.register(spark)
        l7.register(spark)

    def load_signatures(self, path: str) -> Engine:
        self.signatures = signatures.load(path)
        return self

    def load_rules(self, path: str) -> Engine:
        self.rules.load_text(Path(path).read_text())
        return self

    def save_rules(self, path: str) -> None:
        Path(path).write_text(self.rules.to_text())

    def block(self, kind: str, value: str | int) -> bool:
        return self.rules.block(kind, value)

    def unblock(self, kind: str, value: str | int) -> bool:
        return self.rules.unblock(kind, value)

    def listed(self, kind: str) -> list:
        """The rules of a kind, in the order they were added."""
        return list(getattr(self.rules, kind))

    def clear_rules(self) -> None:
        self.rules.clear()

    def rule_counts(self) -> dict[str, int]:
        return self.rules.stats()

    def open(self, path: str, count: int | None = None) -> DataFrame:
        """Decoded frames of captures; count keeps the first frames past the transport gate, in order of arrival."""
        frames = decode(self.spark.read.format("pcap").load(path))
        if count is None:
            return frames
        own = transport_only(frames).select(arrival(frames).alias("_at")).orderBy("_at").limit(count)
        last = own.agg(F.max("_at").alias("last"))  # one row
        return frames.join(F.broadcast(last), arrival(frames) <= F.col("last")).drop("last")

    def classify(self, frames: DataFrame) -> DataFrame:
        return classify.classify_packets(frames, self.signatures, self.rules, self.profile)

    def flows(self, frames: DataFrame) -> DataFrame:
        return classify.classified_flows(frames, self.signatures, self.profile)

    def forwarded(self, frames: DataFrame) -> DataFrame:
        """Frames that no rule drops, with the columns that a capture needs."""
        return self.classify(frames).filter("not blocked").select("arrived", "source", "frame_no", "ts_sec", "ts_usec", "link_type", "data")

    def write_forwarded(self, frames: DataFrame, folder: str, one_file: bool = True) -> None:
        """Captures of the forwarded frames. One file holds them all in order; several are ranges of them in order."""
        own = self.forwarded(frames)
        own = own.repartition(1) if one_file else own.repartitionByRange(*ARRIVAL)
        own.sortWithinPartitions(*ARRIVAL).write.format("pcap").mode("append").save(folder)

    def explain(self, frames: DataFrame, spec: str = "", max_flows: int | None = explain.MOST_FLOWS) -> DataFrame:
        return explain.explain(frames, self.signatures, self.rules, spec, max_flows)

    def report(self, frames: DataFrame) -> str:
        return reports.report_text(frames, self.classify(frames), self.flows(frames), self.profile)

    def metrics(self, frames: DataFrame) -> str:
        return reports.metrics_text(frames, self.classify(frames), self.flows(frames), self.profile == "classic")
