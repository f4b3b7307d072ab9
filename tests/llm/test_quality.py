"""Chosen levels: the guarantee by simulation, the verdict against a plain version."""

import collections
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.llm import quality as Q


def below(k, n, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def test_bound_is_exact():
    for k, n, e in ((0, 50, 0.05), (3, 200, 0.0125), (7, 90, 0.2)):
        assert below(k, n, Q.binomial_upper(k, n, e)) == pytest.approx(e, rel=1e-6)


def test_false_rejections_stay_below_alpha():
    rng = np.random.default_rng(8)
    strata = {"a": 400, "b": 900, "c": 3000, "d": 30}
    # true shares rejected at each level, near the limit, where errors are likeliest
    true = {s: np.array([0.002, 0.008, 0.016, 0.0202, 0.03, 0.04, 0.05, 0.06]) + i * 0.001 for i, s in enumerate(strata)}
    wrong, some, runs = 0, 0, 1500
    for _ in range(runs):
        counts = {}
        for s, n in strata.items():
            p = np.diff(np.concatenate([[0], true[s], [1]]))
            counts[s] = rng.multinomial(n, p).tolist()
        got = Q.choose(counts)
        wrong += any(k and true[s][k - 1] > Q.ALPHA for s, k in got.items())
        some += got["c"] > 0
        assert got["d"] == 0
    assert wrong / runs <= Q.DELTA and some / runs > 0.9


def test_shares_are_handed_on():
    clean = [0] * Q.DEPTH + [5000]
    n = math.ceil(math.log(2 / Q.DELTA) / -math.log1p(-Q.ALPHA))
    few = [0] * Q.DEPTH + [n]
    assert Q.choose({"x": few, "y": few}) == {"x": Q.DEPTH, "y": Q.DEPTH}
    bad = [n] + [0] * Q.DEPTH
    assert Q.choose({"x": few, "y": bad, "z": bad}) == {"x": 0, "y": 0, "z": 0}  # a third of the error is too little for x
    assert Q.choose({"x": few, "y": bad, "z": clean}) == {"x": Q.DEPTH, "y": 0, "z": Q.DEPTH}  # half of it is enough
    small = {"y": [0] * Q.DEPTH + [10], "z": [0] * Q.DEPTH + [10], "none": [0] * (Q.DEPTH + 1)}
    assert Q.choose({"x": few, **small}) == {"x": Q.DEPTH, "y": 0, "z": 0, "none": 0}  # strata that can't pass take little
    assert Q.choose({}) == {} and Q.choose({"none": [0] * (Q.DEPTH + 1)}) == {"none": 0}
    assert Q.choose({"x": few, "y": [0] * Q.DEPTH + [10], "z": clean})["x"] == Q.DEPTH


def plain(rows, labels):
    quality = {}
    for i, q in labels:
        if i is not None and q is not None:
            quality[i] = min(q, quality.get(i, 1))

    def numbers(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        c = collections.Counter(grams)
        cover = {j for i, g in enumerate(grams) if c[g] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        chars = max(1, sum(map(len, w)))
        bare = sum(1 for x in w if len(x) <= 4 and x.isascii() and not re.search("[0-9A-Za-z]", x))
        share = {"symbols_per_char": sum(ch in "#*$%&|<>" for ch in t or "") / chars, "repeated_share": len(cover) / max(1, len(w)), "dup_line_share": (len(lines) - len(set(lines))) / max(1, len(lines)), "upper_share": sum("A" <= ch <= "Z" for ch in t or "") / chars, "mark_share": bare / max(1, len(w))}
        return len(w) < 50 or 2 * len(cover) > len(w), share

    def hits(share, level):
        return [r for r in Q.LEVELS if share[r] > Q.LEVELS[r][level]]

    trials = {}
    for i, t, lang in rows:
        if i in quality:
            trials.setdefault(t, []).append((quality[i], lang, *numbers(t)))
    good = collections.defaultdict(list)
    for many in trials.values():
        if all(q for q, *_ in many) and not many[0][2]:
            good[min((x[1] for x in many), key=lambda s: (s is None, s))].append(many[0][3])
    counts = {s: [0] * (Q.DEPTH + 1) for s in sorted(good, key=lambda s: (s is None, s or ""))}
    for s, many in good.items():
        for share in many:
            counts[s][next((k for k in range(Q.DEPTH) if hits(share, k)), Q.DEPTH)] += 1
    passed = Q.choose(counts)
    out = []
    for i, t, lang in rows:
        failed, share = numbers(t)
        why = hits(share, passed[lang] - 1) if passed.get(lang) else []
        out.append((i, failed, not failed and not why, ",".join(why)))
    return out, passed


def test_verdict_equals_a_plain_one(spark):
    rng = np.random.default_rng(3)
    words = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrstuvw"]
    rows, labels = [], []
    for i in range(900):
        w = list(rng.choice(words, 80))
        bad = i % 6 == 0
        for j in rng.choice(80, 25, replace=False) if bad else ():
            w[j] = ("###", "LOUDLY", "|")[i % 3]
        rows.append((i, " ".join(w), ("en", "fr", None)[i % 3]))
        labels.append((i, int(not bad)))
    rows += [(None, rows[0][1], "en"), (3, rows[3][1], "en"), (3, rows[6][1], "en"), (5000, None, "en"), (5001, "", None), (5002, rows[12][1], "zz")]
    rows += [(6000 + i, rows[1][1], "en") for i in range(300)]
    labels += [(6000 + i, 1) for i in range(300)] + [(4, 0), (None, 1), (8, None), (99999, 1)]
    want, passed = plain(rows, labels)
    assert max(passed.values()) > 0
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("stratum", F.lit(1)).withColumn("kept", F.lit("x"))
    got = Q.judge(df, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert sorted((repr(r["doc_id"]), r["base_failed"], r["kept"], r["rejected_by"]) for r in got.collect()) == sorted((repr(w[0]), *w[1:]) for w in want)
    assert any(w[3] for w in want)
    # without labels all that pass the base rule stay
    assert all(r["kept"] != r["base_failed"] for r in Q.judge(df, spark.createDataFrame([], "doc_id long, quality int")).collect())


def test_rejects_on_the_tables(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = Q.judge(docs, labels).join(labels.groupBy("doc_id").agg(F.min("quality").alias("q")), "doc_id", "left").toPandas()
    by = got[got["rejected_by"] != ""]
    assert len(by) > 100
    good = got[(got["q"] == 1) & ~got["base_failed"]]
    assert (good["rejected_by"] != "").mean() <= Q.ALPHA
