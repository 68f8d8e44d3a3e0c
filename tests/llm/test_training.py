"""The toxicity machine's training: against plain steps over dense tables, and what it holds at once."""

import tracemalloc

import numpy as np
from flowlens.llm import toxicity


def _plain(held, labels, steps):
    """The same steps with every pair of a text's terms written out by dense products."""
    n, size = held.shape
    p = [np.array([np.log((labels.sum() + 1) / (n - labels.sum() + 1))]), np.zeros(size), np.random.default_rng(0).normal(0, 0.05, (size, toxicity.FACTORS))]
    first, second = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    for step in range(1, steps + 1):
        products = (p[2] @ p[2].T) * (1 - np.eye(size))
        wrong = 1 / (1 + np.exp(-(p[0] + held @ p[1] + 0.5 * ((held @ products) * held).sum(axis=1)))) - labels
        together = (held.T * wrong) @ held * (1 - np.eye(size))
        slopes = [np.array([wrong.mean()]), held.T @ wrong / n + toxicity.WEIGHT_RIDGE * p[1], together @ p[2] / n + toxicity.VECTOR_RIDGE * p[2]]
        for k, g in enumerate(slopes):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            p[k] = p[k] - toxicity.RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return p


def test_steps_equal_plain_ones(monkeypatch):
    """Also with texts without a term, pairs in any order, and a term that no text has."""
    monkeypatch.setattr(toxicity, "STEPS", 30)
    rng = np.random.default_rng(3)
    held = (rng.random((50, 12)) < 0.3).astype(float)
    held[[0, 20, 49]], held[:, 5] = 0, 0
    labels = ((held[:, 1] * held[:, 2] > 0) | (held[:, 3] > 0)).astype(float)
    rows, own = np.nonzero(held)
    mixed = rng.permutation(len(rows))
    found, plain = toxicity.train(rows[mixed], own[mixed], labels, 12), _plain(held, labels, 30)
    assert all(np.allclose(x, y, rtol=0, atol=1e-9) for x, y in zip(found, plain))


def test_steps_hold_less_than_a_vector_for_each_pair(monkeypatch):
    """The driver trains: fresh tables of pairs by factors in each step took most of its time."""
    monkeypatch.setattr(toxicity, "STEPS", 2)
    rng = np.random.default_rng(4)
    n, size, pairs = 2000, 500, 200_000
    rows, own, labels = np.sort(rng.integers(0, n, pairs)), rng.integers(0, size, pairs), (rng.random(n) < 0.1).astype(float)
    tracemalloc.start()
    try:
        toxicity.train(rows, own, labels, size)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < pairs * toxicity.FACTORS * 8
