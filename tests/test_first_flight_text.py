"""first_flight_text on conversations at and beyond the caps of a first flight."""

import hashlib

from flowlens.plans import catalog
from flowlens.schemas import FLIGHT_BYTES, FLIGHT_SEGMENTS


def _plain(texts):
    """Digest of the bytes from the first turn on that the caps leave, turns taken last first."""
    data = [(t or "").encode() for t in texts]
    starts = [sum(map(len, data[:k])) for k in range(len(data))]
    taken = [(at, own) for at, own in reversed(list(zip(starts, data))) if own and at < FLIGHT_BYTES][:FLIGHT_SEGMENTS]
    held = {at: own[: FLIGHT_BYTES - at] for at, own in taken}
    out = b""
    while len(out) in held:
        out += held[len(out)]
    return hashlib.md5(out).hexdigest()


def test_long_conversations_stay(spark, tmp_path):
    made = {1: ["ab", "cd"], 2: ["x" * 5000, "y" * 5000, "z" * 7000], 3: ["q" * 20000, "r"], 4: [f"turn {k} " for k in range(64)], 5: [f"turn {k} " for k in range(70)], 6: ["a" * 16384], 7: [None, "", "s"]}
    rows = [(c, k, "user", t) for c, texts in made.items() for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {int(r.flow_id): r.digest for r in catalog.QUERIES["first_flight_text"](spark, f"file://{tmp_path}").collect()}
    assert got == {c: _plain(texts) for c, texts in made.items()}
