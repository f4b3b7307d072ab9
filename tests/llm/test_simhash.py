"""Fingerprints, tiles and classes against plain versions."""

import random

import numpy as np
import pytest
import xxhash

from feedloom.llm import simhash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hs = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def plain_classes(rows, radius=4):
    """doc index -> (lowest doc_id of the component, links), by all pairs."""
    fps = [plain_fingerprint(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                links[i] += 1
                links[j] += 1
                up[top(i)] = top(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[top(i)] = min(d, low.get(top(i), d))
    return [(d, f"{f:016x}", low.get(top(i)), n) for i, ((d, _), f, n) in enumerate(zip(rows, fps, links, strict=True))]


def same(got, want):
    key = lambda r: tuple((x is None, x) for x in r)
    return sorted(map(tuple, got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("window", [1 << 20, 40])
def test_fingerprint(monkeypatch, window):
    monkeypatch.setattr(simhash, "WINDOW", window)
    monkeypatch.setattr(simhash, "HASHES", 7 if window == 40 else 1 << 16)
    rng = random.Random(1)
    texts = [None, "", " \t\n\x0b\x0c\r", "A", "a b", "One two THREE", "É Ü x y \x1c\x85 z", "a" * 500, "a b c d " * 300]
    texts += ["".join(rng.choice("ab C\n é漢") for _ in range(rng.randrange(400))) for _ in range(100)]
    for t in texts:
        assert simhash.fingerprint((t or "").encode()) == plain_fingerprint(t), t


@pytest.mark.parametrize("small", [256, 8])
def test_tile_pair_equals_all_pairs(monkeypatch, small):
    monkeypatch.setattr(simhash, "SMALL", small)
    monkeypatch.setattr(simhash, "LINKS", 50 if small == 8 else 1 << 20)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = np.unique(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 12, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 12, dtype=np.uint64)) for _ in range(30)] + [rng.integers(0, 1 << 63, 200, dtype=np.uint64)]))
    fps = fps[np.lexsort(simhash.counts(fps).T[::-1])]
    n = rng.integers(1, 5, len(fps))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    np.fill_diagonal(near, False)
    root, links = simhash.compared(fps, fps, n, n, True, 4)
    assert (links[: len(fps)] == near @ n).all()
    cut = 150
    r2, l2 = simhash.compared(fps[:cut], fps[cut:], n[:cut], n[cut:], False, 4)
    assert (l2[:cut] == near[:cut, cut:] @ n[cut:]).all() and (l2[cut:] == near[cut:, :cut] @ n[:cut]).all()
    reach = near | np.eye(len(fps), dtype=bool)
    for _ in range(10):
        reach = (reach.astype(int) @ reach.astype(int)) > 0
    assert (root[: len(fps)] == reach.argmax(1)).all()


@pytest.fixture(scope="module")
def rows(spark):
    """Texts of the table, near copies by a word, odd rows, and null and repeated ids."""
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rng, more = random.Random(5), []
    for k, (_, t) in enumerate(docs[:60]):
        words = t.split(" ")
        words[rng.randrange(len(words))] = "other"
        more.append((1000 + k, " ".join(words)))
    more += [(2000, None), (2001, ""), (None, "\n"), (None, docs[3][1]), (2002, "a b"), (2002, "a b"), (None, "alone with no id here"), (2003, "x " * 20_000), (2004, "y" * 300_000)]
    return docs + more


@pytest.mark.parametrize("tile", [None, 16])
def test_scan_equals_all_pairs(spark, rows, tile):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = simhash.scan(df, tile=tile)
    assert [f"{c} {t}" for c, t in out.dtypes] == ["doc_id bigint", "fingerprint string", "component_id bigint", "n_links bigint"]
    want = plain_classes(rows)
    assert same(out.collect(), want)
    assert any(n > 0 and c != d for d, _, c, n in want if d is not None and d < 2000)


def test_many_classes_are_not_sent_to_all(spark, rows, monkeypatch):
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", 0)
    assert same(simhash.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect(), plain_classes(rows))


def test_string_ids_and_a_chain(spark):
    """A chain of fingerprints four bits apart is one class."""
    fps = [(1 << (4 * k)) - 1 for k in range(16)]
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, 1) for f in fps], "fp long, n long")
    made = []
    edges = simhash.linked(df, len(fps), made, size=3).where("fp <> root").selectExpr("fp AS a", "root AS b")
    labels = simhash.components(edges).collect()
    assert len(labels) == 16 and len({r["label"] for r in labels}) == 1
    out = simhash.scan(spark.createDataFrame([("b", "same text"), ("a", "same text"), ("c", "quite another text of some words")], "doc_id string, text string"))
    assert {r["doc_id"]: r["component_id"] for r in out.collect()} == {"a": "a", "b": "a", "c": "c"}
