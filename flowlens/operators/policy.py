"""Block rules: their text form, and verdicts as expressions."""

from __future__ import annotations

import ipaddress
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.schemas import APPS

from .signatures import ascii_lower

#: Section of a rule file -> kind of its rules.
SECTIONS = {"[BLOCKED_IPS]": "ip", "[BLOCKED_APPS]": "app", "[BLOCKED_DOMAINS]": "domain", "[BLOCKED_PORTS]": "port"}


def checked_ip(text: str) -> str:
    """The address, or ValueError: rules are not guessed from text that is none."""
    return str(ipaddress.IPv4Address(text.strip()))


@dataclass
class BlockRules:
    """Sets of blocked addresses, applications, domains and ports, in the order they were added.

    Two readings of domains exist: `substring` (anywhere in the name, case matters) and `pattern` (the name itself, or
    `*.suffix`, which also holds for the bare name and ignores case; a star elsewhere matches nothing).
    """

    ip: list[str] = field(default_factory=list)
    app: list[str] = field(default_factory=list)
    domain: list[str] = field(default_factory=list)
    port: list[int] = field(default_factory=list)

    def block(self, kind: str, value: str | int) -> bool:
        """Add a rule; False if the application is not known or the rule is there."""
        value = {"ip": lambda v: checked_ip(str(v)), "port": _checked_port}.get(kind, str)(value)
        own = getattr(self, kind)
        if value in own or kind == "app" and value not in APPS:
            return False
        own.append(value)
        return True

    def unblock(self, kind: str, value: str | int) -> bool:
        own, value = getattr(self, kind), int(value) if kind == "port" else str(value)
        if value not in own:
            return False
        own.remove(value)
        return True

    def clear(self) -> None:
        for kind in SECTIONS.values():
            getattr(self, kind).clear()

    def stats(self) -> dict[str, int]:
        return {kind: len(getattr(self, kind)) for kind in SECTIONS.values()}

    def load_text(self, text: str) -> BlockRules:
        """Add the rules of a file's text; unknown applications and sections are passed over."""
        section = None
        for line in text.splitlines():
            if line.startswith("["):
                section = SECTIONS.get(line)
            elif line and section:
                self.block(section, line)
        return self

    def to_text(self) -> str:
        return "\n".join(name + "\n" + "".join(f"{v}\n" for v in getattr(self, kind)) for name, kind in SECTIONS.items())

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(kind, str(v), "pattern" if kind == "domain" and "*" in str(v) else "exact") for kind in SECTIONS.values() for v in getattr(self, kind)]
        return spark.createDataFrame(rows, "kind string, value string, mode string")


def _checked_port(value: str | int) -> int:
    port = int(value)
    if not 0 <= port <= 65535:
        raise ValueError(f"no port: {value}")
    return port


def _any(tests: Iterable[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def _in(column: Column, values: list) -> Column:
    return F.coalesce(column.isin(values), F.lit(False)) if values else F.lit(False)


def blocked_by_substring(rules: BlockRules, src_ip: Column, app: Column, name: Column) -> Column:
    """Whether an address, an application or a part of the name is blocked."""
    text = F.coalesce(name, F.lit(""))
    return _in(src_ip, rules.ip) | _in(app, rules.app) | _any(F.contains(text, F.lit(d)) for d in rules.domain)


def domain_blocked(rules: BlockRules, name: Column) -> Column:
    exact = [d for d in rules.domain if "*" not in d]
    tails = [d[2:] for d in rules.domain if d.startswith("*.")]
    low = ascii_lower(name)
    return _in(name, exact) | _any((low == ascii_lower(F.lit(t))) | F.endswith(low, ascii_lower(F.lit("." + t))) for t in tails)


def block_reason(rules: BlockRules, src_ip: Column, dst_port: Column, app: Column, name: Column) -> Column:
    """struct(kind, detail) of the first rule that holds, in the order ip, port, app, domain; null if none does."""
    named = F.coalesce(name, F.lit("")) != ""
    as_struct = lambda kind, detail: F.struct(F.lit(kind).alias("kind"), detail.cast("string").alias("detail"))
    return (
        F.when(_in(src_ip, rules.ip), as_struct("ip", src_ip))
        .when(_in(dst_port, rules.port), as_struct("port", dst_port))
        .when(_in(app, rules.app), as_struct("app", app))
        .when(named & F.coalesce(domain_blocked(rules, name), F.lit(False)), as_struct("domain", name))
    )


def blocked_rows(df: DataFrame, rules: DataFrame, kind: str, column: str, keep: bool = True) -> DataFrame:
    """Rows whose value is (keep) or is not in a rule table; a table of any size, sent to every task only if it is small."""
    own = rules.filter(F.col("kind") == kind).select(F.col("value").alias("_value")).distinct()
    return df.join(own, df[column].cast("string") == F.col("_value"), "left_semi" if keep else "left_anti")


class FilterError(ValueError):
    """A flow specification that cannot be read."""


@dataclass(frozen=True)
class FlowFilter:
    """Endpoints that a packet must have, each on either side; a missing address or port matches any."""

    endpoints: tuple[tuple[str | None, int | None], ...] = ()

    @staticmethod
    def parse(spec: str) -> FlowFilter:
        """`ip:port-ip:port`, `ip:port`, `ip`, `:port`, or nothing for all packets."""
        spec = spec.strip(" \t")
        if not spec:
            return FlowFilter()
        return FlowFilter(tuple(_endpoint(part, spec) for part in spec.split("-", 1)))

    def matches(self) -> Column:
        def side(ip: str | None, port: int | None, which: str) -> Column:
            return (F.lit(True) if ip is None else F.col(f"{which}_ip") == ip) & (F.lit(True) if port is None else F.col(f"{which}_port") == port)

        out = F.lit(True)
        for ip, port in self.endpoints:
            out = out & (side(ip, port, "src") | side(ip, port, "dst"))
        return out


def _endpoint(text: str, spec: str) -> tuple[str | None, int | None]:
    ip, colon, port = text.rpartition(":") if ":" in text else (text, "", "")
    try:
        found = (checked_ip(ip) if ip else None, _checked_port(port) if port else None)
    except ValueError as e:
        raise FilterError(f"bad flow spec '{spec}' (want ip:port-ip:port | ip:port | ip | :port)") from e
    found = (None if found[0] == "0.0.0.0" else found[0], found[1] or None)
    if found == (None, None):
        raise FilterError(f"bad flow spec '{spec}'")
    return found
