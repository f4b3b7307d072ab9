"""Removed bytes against a plain count of all 400-byte strings: groups over the limit, texts of several segments, repeated and null ids."""

import collections
import hashlib
import random

import numpy as np
import pytest

from feedloom.llm import substring_dedup as S


def plain(rows):
    raw = [(i, (t or "").encode()) for i, t in rows]
    n = collections.Counter(hash(r[k : k + S.LENGTH]) for _, r in raw for k in range(len(r) - S.LENGTH + 1))
    out = []
    for i, r in raw:
        gone = bytearray(len(r))
        for k in range(len(r) - S.LENGTH + 1):
            if n[hash(r[k : k + S.LENGTH])] > 1:
                gone[k : k + S.LENGTH] = b"\1" * S.LENGTH
        kept = bytes(c for c, g in zip(r, gone, strict=True) if not g)
        out.append((i, len(r), sum(gone), sum(1 for x in bytes(gone).split(b"\0") if x), hashlib.sha256(kept).hexdigest()))
    return out


def texts():
    rng = random.Random(3)
    words = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    passage = words(75)
    rows = [(i, f"{words(90)} {passage} {words(rng.randint(0, 80))}") for i in range(60)]
    rows += [(100, None), (101, ""), (102, "é" * 400), (103, "ab" * 3000), (None, "x" * 500), (None, "x" * 450), (5, words(200)), (5, words(210))]
    long = "".join(rng.choice("abcdefgh ") for _ in range(2 * S.SEGMENT + 100_000))
    rows += [(200, long), (201, long[:300_000] + "Q" + long[300_001:]), (202, long[S.SEGMENT - 300 : S.SEGMENT + 500]), (203, long[250_000:])]
    return rows + rows[:7] + rows[-3:-2]


@pytest.mark.parametrize("hot", [S.HOT, 30, 1])
def test_equal_plain_count(spark, hot):
    rows = texts()
    got = S.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), hot=hot)
    assert got.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("kept_sha256", "string")]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(plain(rows), key=repr)


def test_multikey_quicksort():
    rng = np.random.default_rng(5)
    keys = rng.integers(0, 3, (500, 4)).astype(np.uint64)
    order = S.multikey_quicksort(keys, np.arange(500), np.array([0, 100, 101]), np.array([100, 101, 500]))
    for a, b in ((0, 100), (100, 101), (101, 500)):
        assert sorted(order[a:b].tolist()) == list(range(a, b))
        assert keys[order[a:b]].tolist() == sorted(keys[a:b].tolist())
