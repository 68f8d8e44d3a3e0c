"""What tasks and workers hold at once: buckets of like size, few shards, bounded stores, one vocabulary for a task."""

import random

import __spark_entry__
import numpy as np

from flowlens.llm import substring_dedup, tokens
from flowlens.llm.queries import vocabulary


def test_anchors_fill_buckets_alike():
    rng = random.Random(3)
    texts = [" ".join(rng.choices([f"w{k}" for k in range(3000)], k=20_000)).encode() for _ in range(3)]
    anchors = np.unique(np.concatenate([found[4] for found in substring_dedup.snippets(texts)]))
    sizes = np.diff(substring_dedup._bucket_cuts(anchors, 50))
    assert len(anchors) > 10_000 and sizes.max() < 1.3 * sizes.mean()


def test_blocks_of_few_snippets_are_one_shard(monkeypatch):
    monkeypatch.setattr(substring_dedup, "SHARD", 10)
    blocks, sizes = np.array([0, 0, 3, 4, 4, 4, 9]), np.array([4, 4, 3, 30, 2, 2, 5])
    assert substring_dedup._joined_shards(blocks, sizes).tolist() == [0, 0, 0, 1, 1, 1, 4]


def test_store_of_parts_keeps_what_comes_again(monkeypatch):
    monkeypatch.setattr(tokens, "MOST_PARTS", 400)
    own = tokens.WordEncoder(vocabulary("byte_bpe_50k.json"))
    often, learned, learn = [f"often{k}" for k in range(50)], [], own._learn
    monkeypatch.setattr(own, "_learn", lambda parts: learned.extend(parts) or learn(parts))
    for k in range(40):
        text = " ".join(["x", *often, *(f"once{k}n{j}" for j in range(30))])
        assert own.encode([text]) == [own._alone(text)]
        assert len(own.parts) + len(own.older) <= tokens.MOST_PARTS
    assert sorted(x for x in learned if x.startswith("often")) == sorted(often)


def test_pieces_are_not_encoded_and_decoded_in_one_task(spark):
    plan = __spark_entry__.queries()["op10_sentencepiece"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
