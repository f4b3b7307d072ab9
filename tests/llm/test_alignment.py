"""Alignment of two tokenizers against whole texts, token by token."""

import collections
import hashlib
import random
import re

import pytest

from feedloom.llm import alignment

SPECIAL = ["<|endoftext|> a <s> b</s> <unk>", "a<0x41>b", "▁ a▁b", "x ▁y"]
ODD = [None, "", " ", "  ", "a", " a", "a ", "a  b c", "a b", "\n a\n b", "é漢😀 x 漢 y", "'s 't 1 2 12 a1 b_2", "x" * 3000, "tab\tand nbsp b ​ c 　 d", "\x00 a \x1c b \x7f c", "﷽ ﬁ ① a", "﻿a b", "a ́b c", "ａ b"]


@pytest.fixture(scope="module")
def plain():
    """A text -> (A's tokens as (id, end), B's), or None; over whole texts."""
    import sentencepiece
    from tokenizers import Tokenizer, decoders

    a = Tokenizer.from_file(alignment.VOCABULARY_A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=alignment.VOCABULARY_B)
    table = {}
    for byte in range(256):  # what the public decoder writes a byte's character as
        ch = chr(byte) if chr(byte).isprintable() and byte != 32 and byte != 173 else None
        table[byte] = ch
    others = iter(range(256, 400))
    to_byte = {(ch or chr(next(others))): byte for byte, ch in table.items()}
    assert decoders.ByteLevel().decode(["Ġa"]) == " a"

    def tokens(text):
        own = b" " + text.encode()
        out = []
        for ids, raw in ((ia := a.encode(" " + text, add_special_tokens=False).ids, [bytes(to_byte[c] for c in a.id_to_token(i)) for i in ia]), (ib := b.encode(text), [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) and b.is_byte(i) else p.replace("▁", " ").encode() for i in ib for p in [b.id_to_piece(i)]])):
            if b"".join(raw) != own:
                return None
            ends, n = [], 0
            for r in raw:
                n += len(r)
                ends.append(n)
            out.append(list(zip(ids, ends, strict=True)))
        return out

    return tokens


def expected(rows, tokens):
    docs = []
    for d, t in rows:
        found = tokens(t) if t else None
        if found is None:
            docs.append((d, 0, 0, [], [], ""))
            continue
        a, b = found
        common = {e for _, e in a} & {e for _, e in b}
        groups, x, y = [], [], []
        ia, ib = iter(a), iter(b)
        for end in sorted(common):
            x, y = [], []
            while True:
                i, e = next(ia)
                x.append(i)
                if e == end:
                    break
            while True:
                i, e = next(ib)
                y.append(i)
                if e == end:
                    break
            groups.append((x, y))
        links = [(i, j) for i, e in a for j, f in b if e == f] if len(a) < 300 else [(x[-1], y[-1]) for x, y in groups]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        docs.append((d, len(a), len(b), groups, links, hashlib.sha256(text.encode()).hexdigest()))
    count = collections.Counter(x for *_, links, _ in docs for x in links)
    top = collections.Counter()
    for (_, j), n in count.items():
        top[j] = max(top[j], n)
    return [(d, na, nb, len(g), len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links), h) for d, na, nb, g, links, h in docs]


@pytest.fixture(scope="module")
def rows(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rng = random.Random(4)
    made = ["".join(rng.choice(["a", "the", " ", " ", "  ", "é", "漢", "\n", "'s", "1", "▁", "\x00", "​", "-"]) for _ in range(60)) for _ in range(150)]
    return docs[:120] + [(1000 + i, t) for i, t in enumerate(ODD + SPECIAL + made)] + [(None, "no id"), (1, "the id of another"), (1, "the id of another")]


KEY = lambda r: tuple((x is None, x) for x in r)


@pytest.mark.parametrize("few", [False, True])
def test_scan_equals_whole_texts(spark, rows, plain, monkeypatch, few):
    if few:  # counts are joined by a shuffle
        monkeypatch.setattr(alignment, "BROADCAST_ROWS", 0)
    out = alignment.scan(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS n_a", "'z' AS pairs").repartition(3))
    assert ", ".join(f"{c} {t}" for c, t in out.dtypes) == "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    assert sorted(map(tuple, out.collect()), key=KEY) == sorted(expected(rows, plain), key=KEY)


def test_kept_segments_do_not_matter(rows, plain, monkeypatch):
    monkeypatch.setattr(alignment, "KEPT", 50)
    monkeypatch.setattr(alignment, "LONG", 5)
    monkeypatch.setattr(alignment, "AT_ONCE", 3)
    files = [open(p, "rb").read() for p in (alignment.VOCABULARY_A, alignment.VOCABULARY_B)]
    aligner = alignment.Aligner(*files)
    texts = [t or "" for _, t in rows]
    for at in range(0, len(texts), 20):
        for t, found in zip(texts[at : at + 20], aligner.texts(texts[at : at + 20]), strict=True):
            want = plain(t) if t else None
            assert (found is None) == (want is None)
            if found is not None:
                assert (sum(x[0] for x in found), sum(x[1] for x in found)) == (len(want[0]), len(want[1]))
    assert len(aligner.known) <= 200 and all(len(s) <= 5 for s in aligner.known)


def test_labels_and_spans():
    import numpy as np

    label = alignment.labels(np.array([2, 5, 6]), np.array([1, 5, 6]), 6)
    assert label == bytes([2, 1, 0, 0, 3, 3]) and [x.tolist() for x in alignment.groups_of(label)] == [[2, 1], [2, 1]]


def test_empty_table(spark):
    assert alignment.scan(spark.createDataFrame([], "doc_id string, text string")).collect() == []
