"""Command line: `python -m flowlens.cli run|explain|sig|fp|reasm|hash ...`."""

from __future__ import annotations

import argparse
import hashlib
import json
import sys
from pathlib import Path

from flowlens import http, log
from flowlens.functions import fingerprint, l7
from flowlens.functions.text import TLS_VERSIONS
from flowlens.operators import classify, signatures
from flowlens.operators.reassembly import FirstFlight, parse_script


def _read(path: str) -> str:
    return sys.stdin.read() if path == "-" else Path(path).read_text()


def _rules(path: str | None) -> list[signatures.Rule]:
    return signatures.load(path) if path else signatures.builtin()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="flowlens")
    commands = p.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", help="classify a capture, write what is forwarded, print a report")
    run.add_argument("capture")
    run.add_argument("-o", "-w", "--output", help="folder for the forwarded frames")
    run.add_argument("-c", "--count", type=int)
    run.add_argument("--profile", choices=classify.PROFILES, default="mt")
    run.add_argument("--rules")
    run.add_argument("--metrics", help="serve the metrics at host:port after the run")
    run.add_argument("--workers", type=int, help="shuffle partitions")
    traced = commands.add_parser("explain", help="why flows were classified and forwarded or dropped")
    traced.add_argument("capture")
    traced.add_argument("flow", nargs="?", default="")
    traced.add_argument("--max-flows", type=int, default=12)
    for q in (run, traced):
        for kind in ("ip", "app", "domain", "port"):
            q.add_argument(f"--block-{kind}", action="append", default=[])
        q.add_argument("--log-level", choices=log.LEVELS, default="info")
        q.add_argument("--log-json", action="store_true")
    named = commands.add_parser("sig", help="match a value against the signatures")
    named.add_argument("kind", choices=("host", "ja3", "ja3hash", "ja4"))
    named.add_argument("value")
    printed = commands.add_parser("fp", help="fingerprints of a hello in hexadecimal")
    printed.add_argument("--quic", action="store_true")
    printed.add_argument("hex")
    joined = commands.add_parser("reasm", help="reassemble the segments of a script")
    joined.add_argument("script", nargs="?", default="-")
    hashed = commands.add_parser("hash")
    hashed.add_argument("algorithm", choices=("md5", "sha256"))
    hashed.add_argument("text", nargs="?")
    for q in (run, traced, named):
        q.add_argument("--signatures")
    for q in (traced, named, printed, joined, hashed):
        q.add_argument("--json", action="store_true")
    return p


def _engine(args):
    from pyspark.sql import SparkSession

    from flowlens.engine import Engine

    builder = SparkSession.builder.appName("flowlens")
    if getattr(args, "workers", None):
        builder = builder.config("spark.sql.shuffle.partitions", str(args.workers))
    engine = Engine(builder.getOrCreate(), getattr(args, "profile", "mt"))
    logger = log.configure(args.log_level, args.log_json)
    if args.signatures:
        engine.load_signatures(args.signatures)
    if getattr(args, "rules", None):
        engine.load_rules(args.rules)
    for kind in ("ip", "app", "domain", "port"):
        for value in getattr(args, f"block_{kind}"):
            if not engine.block(kind, value):
                logger.warning("not blocked: %s %s", kind, value)
    return engine


def _run(args) -> int:
    engine = _engine(args)
    frames = engine.open(args.capture, args.count)
    if args.output:
        engine.write_forwarded(frames, args.output)
    print(engine.report(frames), end="")
    if args.metrics:
        text = engine.metrics(frames)
        server = http.MetricsServer(args.metrics, lambda: text)
        try:
            input("serving metrics; press return to end\n")
        finally:
            server.close()
    return 0


def _explain(args) -> int:
    engine = _engine(args)
    column = "json" if args.json else "text"
    rows = [r[column] for r in engine.explain(engine.open(args.capture), args.flow, args.max_flows).select(column).collect()]
    print("[" + ",\n".join(rows) + "]" if args.json else "\n".join(rows))
    return 0


def _sig(args) -> int:
    rules = _rules(args.signatures)
    found = {"host": lambda: signatures.match_host(args.value, rules), "ja3": lambda: signatures.match_ja3(args.value, "", rules), "ja3hash": lambda: signatures.match_ja3("", args.value, rules), "ja4": lambda: signatures.match_ja4(args.value, rules)}[args.kind]()
    if args.json:
        print(json.dumps({"kind": args.kind, "value": args.value, "app": found.app if found else "", "rule": str(found) if found else ""}))
    else:
        print(f"{args.value} -> {found.app} [{found}]" if found else f"{args.value} -> no match")
    return 0


def _fp(args) -> int:
    digits = "".join(c for c in args.hex if c in "0123456789abcdefABCDEF")
    hello = l7.parse_client_hello(bytes.fromhex(digits[: len(digits) // 2 * 2]))
    if not hello:
        print("no ClientHello", file=sys.stderr)
        return 1
    shown = {"sni": hello.sni, "version": TLS_VERSIONS.get(hello.negotiated_version, "?"), "ja3_string": fingerprint.ja3_string_of(hello), "ja3": fingerprint.ja3_of(hello), "ja4": fingerprint.ja4_of(hello, args.quic)}
    print(json.dumps(shown) if args.json else "\n".join(f"{k:<12}{v}" for k, v in shown.items()))
    return 0


def _reasm(args) -> int:
    flight, script = FirstFlight(), parse_script(_read(args.script))
    for segment in script:
        flight.add(*segment)
    data = bytes(flight.data)
    shown = {"segments_applied": len(script), "contiguous_bytes": len(data), "full": flight.full, "started": flight.started, "hex": data.hex(), "ascii": "".join(chr(c) if 0x20 <= c < 0x7F else "." for c in data)}
    print(json.dumps(shown) if args.json else "\n".join(f"{k:<18}{v}" for k, v in shown.items()))
    return 0


def _hash(args) -> int:
    data = (args.text if args.text is not None else _read("-")).encode()
    digest = hashlib.new(args.algorithm, data).hexdigest()
    print(json.dumps({"alg": args.algorithm, "len": len(data), "digest": digest}) if args.json else digest)
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return {"run": _run, "explain": _explain, "sig": _sig, "fp": _fp, "reasm": _reasm, "hash": _hash}[args.command](args)
    except ValueError as e:
        print(f"flowlens: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
