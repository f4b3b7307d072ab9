"""Decontamination by row: null and repeated ids, clashing columns, long texts, shared windows; against plain words."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from feedloom.llm import decontam as D


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def plain(docs, items):
    wins = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9)) if w else ():
            wins.setdefault(tuple(w[k : k + 10]), set()).add("null" if i is None else str(i))
    sizes, out = {len(x) for x in wins}, []
    for i, t in docs:
        w, hit, met = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in wins:
                    hit |= set(range(k, k + n))
                    met |= wins[x]
        out.append((i, len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit)))
    return out


def tables():
    rng = random.Random(4)
    some = lambda n: " ".join(rng.choice(("Alpha", "beta", "Gamma", "dÉlta", "epsilon", "zeta", "été", "x1")) + str(rng.randint(0, 40)) for _ in range(n))
    items = [(k, some(rng.randint(1, 40))) for k in range(25)] + [(None, some(12)), (30, None), (31, " .,"), (32, "A, é漢😀"), (33, "x")]
    items += [(40, items[3][1]), (41, items[3][1].upper().replace("É", "É")), (42, items[5][1] + " " + some(5))]
    docs = [(k, some(rng.randint(0, 90)) + " " + (items[k % 25][1] or "") + " " + some(20)) for k in range(40)]
    docs += [(None, items[3][1] + " " + some(9)), (None, "totally clean text"), (None, None), (5, items[4][1]), (5, "nothing to see"), (6, ""), (7, "a é漢😀 x y")]
    docs += [(8, some(20_000) + " " + items[7][1] + " " + " ".join([items[9][1]] * 50)), (9, "x " * 3000)]
    return docs, items


def test_equals_plain_words(spark):
    docs, items = tables()
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string")
    got = D.scan(d.withColumn("n_words", F.lit("x")).withColumn("row", F.lit(1)), i)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(plain(docs, items), key=repr)


def test_blocks_of_the_benchmark(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_BYTES", 20_000)
    docs, items = tables()
    got = D.scan(spark.createDataFrame(docs[:20], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(plain(docs[:20], items), key=repr)


def test_clean_rows_stay(spark):
    docs, items = tables()
    rows = [(*d, k) for k, d in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id long, text string, bad_id int").withColumn("row", F.lit("r")).withColumn("w", F.lit(1))
    i = spark.createDataFrame(items, "item_id long, text string")
    got = D.keep_clean(df, i)
    assert got.dtypes == df.dtypes
    assert sorted(r["bad_id"] for r in got.collect()) == [k for k, p in enumerate(plain(docs, items)) if not p[5]]
    assert D.keep_clean(df, i.limit(0)).count() == len(docs) and D.keep_clean(df.limit(0), i).count() == 0
    empty = D.scan(df, i.limit(0)).collect()
    assert len(empty) == len(docs) and not any(r["contaminated"] for r in empty) and sorted(r["n_words"] for r in empty) == sorted(p[1] for p in plain(docs, []))
