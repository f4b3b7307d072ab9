"""License labels: notices and names give their own label, phrases as the contract counts them, blocks against all blocks."""

import random
import re

import pytest

from feedloom.llm import licenses as L

SF = "/root/testdata/sf0.001"
NOTICE = {label: t for label, t in L.TEMPLATES if len(t) > 100}


@pytest.fixture(scope="module")
def join():
    return L.Join({})


def labels(join, text):
    w = L.words_of(text)
    return sorted({x for _, _, x in join.base(w)} | set(join.blocks(w)))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Licensed under CC BY 4.0.", ["cc-by"]),
        ("Licensed under CC BY-SA 4.0.", ["cc-by", "cc-by-sa"]),
        ("Released under the license", []),
        ("released under the BSD license", ["bsd"]),
        ("licensed under the mozilla license version 2.0", ["mpl"]),
        ("Licensed under the Apache License, Version 2.0", ["apache"]),
        ("the license of this text is not known, free software it is not", []),
        ("Dual licensed: MIT License or BSD license.", ["bsd", "mit"]),
        *((t, [label]) for label, t in NOTICE.items()),
    ],
)
def test_own_label(join, text, want):
    assert labels(join, text) == want
    assert labels(join, f"We say: {text} And so on. " * 2) == want


def test_whole_notice_scores_one(join):
    for label, t in NOTICE.items():
        assert join.blocks(L.words_of("x y " + t + " z"))[label] == 1.0
        w = t.split()
        w[len(w) // 2] = "other"
        assert 0.8 <= join.blocks(L.words_of(" ".join(w)))[label] < 1.0 or label == "bsd"  # its clauses repeat each other


def plain(text):
    """All blocks of all templates, the best of overlapping ones first."""
    w, found = L.words_of(text), []
    for k, (label, t) in enumerate(L.TEMPLATES):
        runs = L.runs_of(L.words_of(t))
        n, size = len(set(runs)), len(runs[0])
        at = [i for i in range(len(w) - size + 1) if tuple(w[i : i + size]) in set(runs)]
        for end in at:
            inside = [i for i in at if end - len(runs) < i <= end]
            met = len({tuple(w[i : i + size]) for i in inside})
            if met >= 0.8 * n - 1e-9:
                found.append((-met, -met / n, k, inside[0], end + size, label))
    taken, best = [], {}
    for met, share, _, a, b, label in sorted(found):
        if all(b <= x or y <= a for x, y in taken):
            taken.append((a, b))
            best[label] = max(best.get(label, 0), -share)
    return best


def test_blocks_equal_all_blocks(spark):
    rng = random.Random(9)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = [r["text"] for r in docs.limit(60).collect()]
    for _ in range(60):
        parts = [rng.choice(L.TEMPLATES)[1] for _ in range(rng.randint(1, 4))]
        w = " and ".join(parts).split()
        for _ in range(rng.randint(0, len(w) // 8)):
            w[rng.randrange(len(w))] = rng.choice(("the", "license", "zz", "software", ""))
        some.append(" ".join(w))
    freq = L.frequencies(spark.createDataFrame([(i, t) for i, t in enumerate(some)], "doc_id long, text string"))
    runs = [r for t in some for r in (tuple(w[i : i + k]) for w in [L.words_of(t)] for k in (1, 2, 3) for i in range(len(w) - k + 1))]
    known = {r for _, t in L.TEMPLATES for r in L.runs_of(L.words_of(t))}
    assert freq == {r: n for r in known if (n := runs.count(r))}
    for join in (L.Join({}), L.Join(freq)):
        for t in some:
            assert join.blocks(L.words_of(t)) == pytest.approx(plain(t))


def test_query_equals_plain_phrases(spark):
    from feedloom.llm.queries import op10_licenses

    got = op10_licenses(spark, SF)
    assert got.columns[:8] == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    rows = {r["doc_id"]: r for r in got.collect()}
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), d["text"] or ""))
        at = [(i, label) for p, label in L.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        r = rows[d["doc_id"]]
        starts = [i for i, _ in at]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(at), min(starts, default=None), max(starts, default=None))
        base = sorted({x for _, x in at})
        assert r["base_labels"] == ",".join(base) and r["labels"] == ",".join(sorted({*base, *plain(d["text"] or "")})) and 0 <= r["score"] <= 1
