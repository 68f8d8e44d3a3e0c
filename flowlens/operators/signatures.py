"""Ordered application signatures: their text form, and matching as expressions or as a join."""

from __future__ import annotations

import string
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.schemas import APPS

HOST_KINDS = ("suffix", "contains", "exact")
KINDS = (*HOST_KINDS, "ja3", "ja3hash", "ja4", "ja4prefix")
_FOLDED = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)

# The built-in rules, in the order in which they are tried.
BUILTIN = """
contains google Google
contains gstatic Google
contains googleapis Google
contains ggpht Google
contains gvt1 Google
contains youtube YouTube
contains ytimg YouTube
suffix youtu.be YouTube
contains facebook Facebook
contains fbcdn Facebook
contains fbsbx Facebook
suffix fb.com Facebook
suffix meta.com Facebook
contains instagram Instagram
contains cdninstagram Instagram
contains whatsapp WhatsApp
suffix wa.me WhatsApp
contains twitter Twitter/X
contains twimg Twitter/X
suffix x.com Twitter/X
suffix t.co Twitter/X
contains netflix Netflix
contains nflxvideo Netflix
contains nflximg Netflix
contains amazon Amazon
contains amazonaws Amazon
contains cloudfront Amazon
contains aws Amazon
contains microsoft Microsoft
contains msn.com Microsoft
contains office Microsoft
contains azure Microsoft
contains live.com Microsoft
contains outlook Microsoft
contains bing Microsoft
contains apple Apple
contains icloud Apple
contains mzstatic Apple
contains itunes Apple
contains telegram Telegram
suffix t.me Telegram
contains tiktok TikTok
contains tiktokcdn TikTok
contains musical.ly TikTok
contains bytedance TikTok
contains spotify Spotify
contains scdn.co Spotify
contains zoom Zoom
contains discord Discord
contains discordapp Discord
contains github GitHub
contains githubusercontent GitHub
contains cloudflare Cloudflare
contains cf- Cloudflare
"""


class SignatureError(ValueError):
    """A line that is no rule; the message names the source and the line."""


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    app: str

    def __str__(self) -> str:
        return f"{self.kind} {self.pattern}"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def parse(text: str, source: str = "<text>") -> list[Rule]:
    """Rules of a text, all or none: one bad line raises SignatureError."""
    rules = []
    for k, line in enumerate(text.split("\n"), 1):
        line = line.strip(" \t\r\n")
        if not line or line.startswith("#"):
            continue
        kind, pattern, app = (*line.split(None, 2), "", "")[:3]
        if kind not in KINDS:
            raise SignatureError(f"{source}:{k}: unknown rule kind '{kind}'")
        if not pattern or not app:
            raise SignatureError(f"{source}:{k}: expected '<kind> <pattern> <app>'")
        rules.append(Rule(kind, pattern.translate(_FOLDED) if kind in HOST_KINDS else pattern, app))
    return rules


def load(path: str) -> list[Rule]:
    try:
        text = Path(path).read_bytes().decode("latin-1")
    except OSError as e:
        raise SignatureError(f"cannot open signatures file: {path}") from e
    return parse(text, path)


def builtin() -> list[Rule]:
    return parse(BUILTIN, "<builtin>")


def frame(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    return spark.createDataFrame([(k, r.kind, r.pattern, r.app) for k, r in enumerate(rules)], "ord int, kind string, pattern string, app string")


def _first(rules: list[Rule], tests: dict) -> Column:
    """The number of the first rule whose test holds; null if none does."""
    out = None
    for k, r in enumerate(rules):
        if r.kind in tests:
            out = (F if out is None else out).when(tests[r.kind](r.pattern), k)
    return F.lit(None).cast("int") if out is None else out.cast("int")


def host_rule(host: Column, rules: list[Rule]) -> Column:
    h = ascii_lower(host)
    return _first(rules, {"suffix": lambda p: (h == p) | h.endswith(f".{p}"), "contains": lambda p: h.contains(p), "exact": lambda p: h == p})


def ja3_rule(ja3_string: Column, ja3: Column, rules: list[Rule]) -> Column:
    return _first(rules, {"ja3": lambda p: ja3_string == p, "ja3hash": lambda p: ja3 == p})


def ja4_rule(ja4: Column, rules: list[Rule]) -> Column:
    return _first(rules, {"ja4": lambda p: ja4 == p, "ja4prefix": lambda p: ja4.startswith(p)})


def of_rule(number: Column, values: list[str]) -> Column:
    """The value that belongs to a rule's number."""
    return F.get(F.lit(values), number) if values else F.lit(None).cast("string")


def label(host: Column | None, ja3_string: Column | None, ja3: Column | None, ja4: Column | None, rules: list[Rule]) -> Column:
    """The label by host, else by JA3, else by JA4; null if no rule matches."""
    apps, found = [r.app for r in rules], []
    if host is not None:
        found.append(F.when(host != "", host_rule(host, rules)))
    if ja3 is not None:
        found.append(ja3_rule(ja3_string, ja3, rules))
    if ja4 is not None:
        found.append(ja4_rule(ja4, rules))
    return of_rule(F.coalesce(*found), apps)


def app_of_label(name: Column, unknown: str = "HTTPS") -> Column:
    """A label that is an application's name, or `unknown`."""
    return F.when(name.isin(APPS[1:]), name).otherwise(unknown)


def app_of_host(host: Column, rules: list[Rule]) -> Column:
    """Unknown without a host; the label's application; HTTPS where no rule matches or the label is a name of its own."""
    return F.when(F.coalesce(host, F.lit("")) == "", "Unknown").otherwise(app_of_label(of_rule(host_rule(host, rules), [r.app for r in rules])))


#: Rules of a table that hosts are matched with.
MOST_RULES = 100_000


def match_hosts(df: DataFrame, host_col: str, rules: DataFrame) -> DataFrame:
    """df with ord and app of the first matching rule; rules is a table as frame() makes it, for rule sets too long for an expression.

    Distinct hosts meet the rules once each. The rules go to every task, so there may be MOST_RULES of them at most.
    """
    if rules.limit(MOST_RULES + 1).count() > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    hosts = df.select(F.col(host_col).alias("_host")).filter("_host is not null").distinct().withColumn("_h", ascii_lower(F.col("_host")))
    own = rules.filter(F.col("kind").isin(*HOST_KINDS))
    hit = ((F.col("kind") == "suffix") & ((F.col("_h") == F.col("pattern")) | F.endswith("_h", F.concat(F.lit("."), "pattern")))) | ((F.col("kind") == "contains") & F.contains("_h", F.col("pattern"))) | ((F.col("kind") == "exact") & (F.col("_h") == F.col("pattern")))
    best = hosts.join(F.broadcast(own), hit).groupBy("_host").agg(F.min(F.struct("ord", "app")).alias("_r"))
    return df.join(best, df[host_col] == best["_host"], "left").select(*[df[c] for c in df.columns], F.col("_r.ord").alias("ord"), F.col("_r.app").alias("app"))


def match_host(host: str, rules: list[Rule]) -> Rule | None:
    """The first rule for one host."""
    h = host.translate(_FOLDED)
    test = {"suffix": lambda p: h == p or h.endswith("." + p), "contains": lambda p: p in h, "exact": lambda p: h == p}
    return next((r for r in rules if r.kind in test and test[r.kind](r.pattern)), None)


def match_ja3(text: str, digest: str, rules: list[Rule]) -> Rule | None:
    return next((r for r in rules if (r.kind, r.pattern) in {("ja3", text), ("ja3hash", digest)}), None)


def match_ja4(value: str, rules: list[Rule]) -> Rule | None:
    return next((r for r in rules if r.kind == "ja4" and value == r.pattern or r.kind == "ja4prefix" and value.startswith(r.pattern)), None)
