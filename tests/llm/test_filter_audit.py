"""The scan against plain counts, and the audit against every document sent through every order."""

import collections
import random
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from feedloom.llm import filter_audit as fa

RNG = random.Random(2)
TEXTS = ["", " ", "\n\t\x0b\x0c\r", "a", "A a A", "#", "x" * 200 + " " + "x" * 200 + " " + "y" * 200, "é漢😀 é漢😀", "12345678 12345678 123456781 12345678", "\x1c \x85 \xa0b", "end "]
TEXTS += ["".join(RNG.choice("aB #é漢\n") for _ in range(RNG.randrange(300))) for _ in range(200)]


def plain(t):
    words = t.encode().split()
    return {"words": len(words), "distinct": len(set(words)), "capitals": sum("A" <= c <= "Z" for c in t), "symbols": sum(c in "#$%&*|" for c in t), "points": len(t)}


def plain_mask(t):
    m = plain(t)
    return (m["words"] < 200) | (100 * m["distinct"] < 50 * m["words"]) << 1 | (100 * m["capitals"] > 3 * m["points"]) << 2 | (m["symbols"] > 0) << 3


@pytest.mark.parametrize("chunk", [1 << 20, 7])
def test_counts(monkeypatch, chunk):
    monkeypatch.setattr(fa, "CHUNK", chunk)
    column = pa.array(["out", *TEXTS, "side"]).slice(1, len(TEXTS))
    got = fa.measured(column)
    for k in got:
        assert got[k].tolist() == [plain(t)[k] for t in TEXTS], k
    assert all(len(v) == 0 for v in fa.measured(pa.array([], pa.string())).values())
    assert {k: v.tolist() for k, v in fa.measured(pa.array(["", ""])).items()} == dict.fromkeys(got, [0, 0])


def test_words_with_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(fa.Words, "hashes", lambda self: (self.lengths % 2).astype(np.uint64))
    assert fa.measured(pa.array(TEXTS))["distinct"].tolist() == [plain(t)["distinct"] for t in TEXTS]


def plain_audit(docs, labels):
    """docs: (doc_id, text, lang); labels: (doc_id, quality, toxic)."""
    low = {}
    for d, t, _ in docs:
        if d is not None:
            low[t or ""] = min(d, low.get(t or "", d))
    yes = lambda d, k: d is not None and any(x[0] == d and x[k] == 1 for x in labels)
    rows = [(p or "", plain_mask(t or "") | (d is not None and low[t or ""] < d) << 4, yes(d, 1), yes(d, 2)) for d, t, p in docs]
    out, shapley = {}, collections.Counter()
    for o in map("".join, permutations("ABCDE")):
        for p in {r[0] for r in rows}:
            left = [r for r in rows if r[0] == p]
            gone = []
            for step, f in enumerate(o, 1):
                bit = 1 << "ABCDE".index(f)
                hit, left = [r for r in left if r[1] & bit], [r for r in left if not r[1] & bit]
                only = sum(r[0] == p and r[1] == bit for r in rows)
                out[p, o, step] = [len(left), len(hit), sum(r[1] & bit > 0 for r in gone), only, sum(r[2] for r in hit), sum(r[3] for r in hit)]
                shapley[p, f] += len(hit)
                gone += hit
    return {(p, o, s, *v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


ROWS = [(1, "w " * 300, "en"), (2, "w " * 300, "de"), (2, "w " * 300, "de"), (2, "A # b", None), (3, None, ""), (4, "", "en"), (None, "", "en"), (None, "w " * 300, None), (0, " ".join(map(str, range(250))), "en"), (9, " ".join(map(str, range(250))), "en")]
ROWS += [(100 + i, t, ["en", "de", None][i % 3]) for i, t in enumerate(TEXTS)] + [(1000 + i, t, "en") for i, t in enumerate(TEXTS[:30])]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, None), (None, 1, 1), (9, None, 1), (9, 1, 0), (5000, 1, 1)] + [(100 + i, i % 2, i % 5 == 0) for i in range(0, 200, 3)]


def test_audit(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string").selectExpr("*", "'z' AS part", "1 AS mask", "doc_id AS digest", "2 AS n").repartition(3)
    labels = spark.createDataFrame([(a, b, None if c is None else int(c)) for a, b, c in LABELS], "doc_id long, quality int, toxic int")
    out = fa.scan(docs, labels)
    assert ", ".join(f"{c} {t}" for c, t in out.dtypes) == "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) == 3 * 600 and set(got) == plain_audit(ROWS, LABELS)
    assert fa.scan(docs.limit(0), labels).collect() == [] and fa.scan(docs, labels.limit(0)).count() == 1800
    named = fa.scan(docs.selectExpr("CAST(doc_id AS string) AS k", "text AS t", "lang AS p"), labels.selectExpr("CAST(doc_id AS string) AS doc_id", "quality", "toxic"), id_col="k", text_col="t", part_col="p")
    assert named.count() == 1800
