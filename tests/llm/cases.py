"""Documents with the awkward cases that every operator has to bear."""

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def awkward(seed=1, n=60):
    """(doc_id, text, lang, source, n_chars): nulls, empty and long texts, copies, repeated rows, odd white space."""
    rng = random.Random(seed)
    body = [" ".join(rng.choices(WORDS, k=rng.randint(1, 60))) for _ in range(n)]
    texts = body + [None, "", " ", "\t\n\x0b\x0c\r", " ", body[0], body[0], body[1].replace(" ", "  "), body[2].replace(" ", "\n"), "Éa ΣΑΣ 漢字 🙂 ﬁ", " ".join(rng.choices(WORDS, k=9000)), "x" * 5000]
    texts += [body[5]] * 30
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", None]), len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, body[7], None, None, 0), (10_000_000_000, None, None, None, None)]
    rng.shuffle(rows)
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema).repartition(3)


def with_clashes(df):
    """Extra columns whose names an operator might use for itself."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("x") for c in ("id", "h", "key", "size", "part", "shard", "kept", "sha", "n", "rank", "keep_id", "component_id")})
