"""Near-duplicate classes by row: null, repeated and string ids, clashing columns, words across pieces; against all pairs."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from feedloom.llm import near_dedup as N


def shingles(t):
    w = re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())
    return Counter([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def plain(rows):
    c, label = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if c[i] and c[j] and sum((c[i] & c[j]).values()) >= 0.8 * sum((c[i] | c[j]).values()):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    lowest = {}
    for x, (i, _) in zip(label, rows, strict=True):
        if i is not None:
            lowest[x] = min(lowest.get(x, i), i)
    return label, [(i, lowest.get(x)) for x, (i, _) in zip(label, rows, strict=True)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    word = lambda: f"w{rng.randint(0, 10**6)}"
    base, out = [word() for _ in range(300)], []
    for i in range(45):  # around one text, some near to others of them but not to it
        w = list(base)
        for _ in range(rng.randint(0, 25)):
            w[rng.randrange(len(w))] = word()
        out.append((i, " ".join(w)))
    out += [(100 + i, " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(20)]
    out += [(None, "no id at all " * 30), (None, "no id at all " * 30), (None, "another without one " * 20)]
    out += [(5, "other text under five " * 20), (5, "other text under five " * 20), (5, "a third text under five, " * 20), (6, None), (6, ""), (7, " .,"), (3000, out[3][1]), (None, out[60][1])]
    return out


@pytest.mark.parametrize("kind", ["long", "string"])
def test_classes(spark, rows, kind):
    given = rows if kind == "long" else [(None if i is None else f"d{i:05d}", t) for i, t in rows]
    df = spark.createDataFrame(given, f"doc_id {kind}, text string").repartition(4)
    got = N.classes(df.withColumn("row", F.lit(1)).withColumn("class_id", F.lit("x")))
    assert got.columns == ["doc_id", "class_id", "class_size", "n_links"]
    label, want = plain(given)
    got = got.collect()
    assert sorted(((r["doc_id"], r["class_id"]) for r in got), key=repr) == sorted(want, key=repr)
    sizes = Counter(label)
    assert sorted(((r["doc_id"], r["class_size"]) for r in got), key=repr) == sorted(((i, sizes[x]) for (i, _), x in zip(given, label, strict=True)), key=repr)
    texts = {x: {tuple(sorted(shingles(t).items())) for (_, t), y in zip(given, label, strict=True) if y == x} for x in sizes}
    several = {i for (i, _), x in zip(given, label, strict=True) if len(texts[x]) > 1}
    assert {r["doc_id"] for r in got if r["n_links"]} - {None} == several - {None}


def test_one_of_each_class_stays(spark, rows, tmp_path):
    label, want = plain(rows)
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, lost int")
    df = df.withColumn("row", F.lit("a")).withColumn("row_", F.lit(2)).withColumn("node", F.lit(3)).withColumn("place", F.lit(4))
    df.repartition(3).write.parquet(str(tmp_path / "t"))
    for x in (df, spark.read.parquet(str(tmp_path / "t"))):
        got = N.keep_one(x)
        assert got.columns == df.columns
        kept = got.collect()
        assert sorted(label[r["lost"]] for r in kept) == sorted(set(label))
        assert all(r["doc_id"] == want[r["lost"]][1] for r in kept)
    nothing = df.limit(0)
    assert N.keep_one(nothing).collect() == [] and N.keep_one(nothing).dtypes == df.dtypes and N.classes(nothing).collect() == []


def test_words_across_pieces(monkeypatch):
    rng = random.Random(1)
    column = pa.array([" ".join("".join(rng.choice("abcé,") for _ in range(rng.randint(1, 30))) for _ in range(100)) for _ in range(10)] + ["x" * 3000, "", None, "a"])
    want = N.shingles(column)
    for chunk in (7, 64, 1000):
        monkeypatch.setattr(N, "CHUNK", chunk)
        assert all(np.array_equal(a, b) for a, b in zip(N.shingles(column), want, strict=True))


def test_long_words_with_one_sum_are_told_apart():
    """Words that differ as a sequence and its complement do have one polynomial sum modulo 2 to the 64."""
    t = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    u = t.translate(str.maketrans("ab", "ba"))
    d, s, _, _ = N.shingles(pa.array([t, u]))
    assert len(d) == 2 and s[0] != s[1]


def test_recall_against_all_pairs_of_a_whole_table(spark):
    """Every pair at the similarity shares a class, over all 1,000 documents; and no class joins texts that no chain of such pairs does."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    owners, sets = {}, [shingles(t) for _, t in rows]
    label, pairs = list(range(len(rows))), 0

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, c in enumerate(sets):
        met = {j for x in c for j in owners.get(x, ())}
        for j in met:
            if sum((c & sets[j]).values()) >= 0.8 * sum((c | sets[j]).values()):
                pairs += 1
                label[max(top(i), top(j))] = min(top(i), top(j))
        for x in c:
            owners.setdefault(x, []).append(i)
    got = {r["doc_id"]: r["class_id"] for r in N.classes(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    want = {d: rows[top(i)][0] for i, (d, _) in enumerate(rows)}
    assert pairs > 50 and len(set(got.values())) == len(set(want.values()))
    assert {d: min(e for e in want if want[e] == want[d]) for d in want} == got
