"""Evidence reaches repetitions however far away."""

import numpy as np

from feedloom.llm import pii


def test_messages_cross_a_long_chain_of_repetitions():
    n = 150
    unary = np.zeros((n, pii.LABELS))
    unary[0, 3] = 12.0
    K = 9.0 * np.eye(pii.LABELS)
    skip = np.array([(i, i + 1) for i in range(n - 1)])
    got = pii.marginals(unary, np.zeros((0, 2), int), skip, (None, np.zeros_like(K), K))
    step = np.exp(K) / np.exp(K).sum(1, keepdims=True)
    p = np.exp(unary[0]) / np.exp(unary[0]).sum()
    for i in range(n):
        assert np.allclose(got[i], p, atol=1e-2), i
        p = p @ step
    assert got[-1, 3] > 0.9


def slow_marginals(unary, edges, rounds=400):
    """Sum-product one message at a time, in products rather than logarithms."""
    n, labels = unary.shape
    msgs = {(i, j): np.ones(labels) for i, j, _ in edges} | {(j, i): np.ones(labels) for i, j, _ in edges}
    pot = {(i, j): np.exp(m) for i, j, m in edges} | {(j, i): np.exp(m).T for i, j, m in edges}
    for _ in range(rounds):
        new = {}
        for i, j in msgs:
            b = np.exp(unary[i])
            for (a, c), m in msgs.items():
                if c == i and a != j:
                    b = b * m
            x = b @ pot[i, j]
            new[i, j] = x / x.sum()
        msgs = new
    out = np.exp(unary)
    for (_, j), m in msgs.items():
        out[j] = out[j] * m
    return out / out.sum(1, keepdims=True)


def test_loops_equal_plain_messages(monkeypatch):
    rng = np.random.default_rng(6)
    monkeypatch.setattr(pii, "EDGES", 3)
    for _ in range(3):
        n = 6
        unary, T, K = rng.normal(size=(n, pii.LABELS)), 0.6 * rng.normal(size=(pii.LABELS, pii.LABELS)), 0.6 * rng.normal(size=(pii.LABELS, pii.LABELS))
        chain, skip = [(0, 1), (1, 2), (3, 4), (4, 5)], [(0, 3), (2, 5), (1, 4)]
        got = pii.marginals(unary, np.array(chain), np.array(skip), (None, T, K))
        want = slow_marginals(unary, [(i, j, T) for i, j in chain] + [(i, j, K) for i, j in skip])
        assert np.allclose(got, want, atol=2e-3)
        # and these are near to the field's own marginals, by enumeration
        exact = np.zeros_like(want)
        for y in np.ndindex(*[pii.LABELS] * n):
            e = sum(unary[i, y[i]] for i in range(n)) + sum(T[y[i], y[j]] for i, j in chain) + sum(K[y[i], y[j]] for i, j in skip)
            exact[np.arange(n), y] += np.exp(e)
        assert np.abs(exact / exact.sum(1, keepdims=True) - want).max() < 0.15


def test_a_long_run_of_numbers_settles():
    n = 400
    unary = np.zeros((n, pii.LABELS))
    unary[0, 2] = 15.0
    T = 9.0 * np.eye(pii.LABELS)
    got = pii.marginals(unary, np.array([(i, i + 1) for i in range(n - 1)]), np.zeros((0, 2), int), (None, T, T))
    assert got[-1, 2] > 0.8


def test_many_spans_are_linear():
    import time

    model = pii.weights()
    took = []
    for k in (2000, 8000):
        t = " ".join(f"a{i}@b{i}.org" for i in range(k))
        begin = time.process_time()
        base, every = pii.all_spans(t, model)
        took.append(time.process_time() - begin)
        assert len(base) == k and len(every) == k
    assert took[1] < 12 * max(took[0], 0.05)
