"""Toxic spans and document scores by a linear-chain conditional random field with two labels.

Document labels are turned into token labels: a form (a word, or its first 3 to 6 letters) counts as toxic when documents
labelled toxic hold it far more often than the others (a test over all forms at once), and in toxic documents the tokens of such forms
are labelled 1. The field learns weights of those forms and the transitions by maximum likelihood. Forward-backward gives
each token's marginal; a text's marginals are brought together in a logistic score, and tokens with a marginal of one half
or more are the offending offsets.

Tokens without any learnt form all have the same potential, so a run of g of them is one 2 x 2 matrix to the power g:
the chain is exact, and only tokens with a learnt form cost arithmetic.

The fit takes at most SAMPLE labelled documents of each class, by the hash of doc_id and up to SAMPLE_BYTES of text, whole
texts; nothing else is bounded: all forms that pass the test are learnt, from all their sequences. Labels, language, source and
doc_id are never inputs of a score.

Edge cases: null or empty text is scored as a text without any learnt form. Rows labelled both ways count as toxic; null
labels and labels of unknown rows count nowhere. Of texts repeated under one labelled doc_id the first in byte order is learnt
from. Without labelled rows of both classes every score is the toxic share. Repeated rows are each answered. Other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, map_pieces, stored, texts

#: Labelled documents that the fit reads at most, clean and toxic; and bytes of their texts, each (of one text a 32nd of it).
SAMPLE, SAMPLE_BYTES = (2400, 1200), 32 << 20
#: The least number of toxic documents that hold a learnt form.
SUPPORT = 4
#: Tokens of a training sequence.
SEQUENCE = 40
WORD = re.compile(r"[^\W\d_]+")
KEPT = 1_000_000


def forms(word: str) -> set[str]:
    """The word, and its beginnings (marked by a hyphen)."""
    w = word.lower()
    return {w, *(w[:k] + "-" for k in (3, 4, 5, 6) if len(w) > k)}


@dataclass
class Model:
    weight: dict[str, float] = field(default_factory=dict)  # log potential of label 1 against 0
    bias: float = -5.0
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    score: np.ndarray = field(default_factory=lambda: np.zeros(3))  # constant, log(1 + sum of marginals), largest marginal

    def emission(self, word: str) -> float:
        w = self.weight
        return sum(w[f] for f in forms(word) if f in w)


class Tagger(dict):
    """Word -> emission, kept up to a bound; and the exact chain over the words with one."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.heads = {f[:3].rstrip("-") for f in model.weight}
        step = np.exp(model.trans) * np.exp([0.0, model.bias])
        self.powers = [np.eye(2)]
        for _ in range(64):
            nxt = self.powers[-1] @ step
            self.powers.append(nxt / nxt.sum())
        self.step = self.powers[1]

    def __missing__(self, word: str) -> float:
        if len(self) >= KEPT:
            self.clear()
        v = self[word] = self.model.emission(word) if word[:3].lower() in self.heads else 0.0
        return v

    def power(self, g: int) -> np.ndarray:
        if g <= 64:
            return self.powers[g]
        half = self.power(g // 2)
        out = half @ half
        out = out @ self.step if g % 2 else out
        return out / out.sum()

    def marginals(self, emissions: list[tuple[int, float]], n: int) -> np.ndarray:
        """P(label 1) of the tokens at the given places of a text of n tokens."""
        m = self.model
        k = len(emissions)
        local = [np.exp(np.array([0.0, min(50.0, m.bias + e)])) for _, e in emissions]
        trans = np.exp(m.trans)
        fore, back = np.zeros((k, 2)), np.zeros((k, 2))
        start = np.array([1.0, np.exp(m.bias)])
        at = -1
        v = None
        for i, (p, _) in enumerate(emissions):
            gap = p - at - 1
            if v is None:
                v = local[i] if gap == 0 else (start @ self.power(gap - 1)) @ trans * local[i]
            else:
                v = (v @ self.power(gap)) @ trans * local[i]
            v = fore[i] = v / v.sum()
            at = p
        v = self.power(n - 1 - at) @ np.ones(2)
        for i in range(k - 1, -1, -1):
            back[i] = v / v.sum()
            if i:
                v = self.power(emissions[i][0] - emissions[i - 1][0] - 1) @ (trans @ (local[i] * back[i]))
        p = fore * back
        return p[:, 1] / p.sum(1)

    def read(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """Score of a text, and (start, end, marginal) of its offending words."""
        values = list(map(self.__getitem__, WORD.findall(text)))
        found = [(i, v) for i, v in enumerate(values) if v] if any(values) else []
        if not found:
            return self.final(np.zeros(0)), []
        p = self.marginals(found, len(values))
        bad = {i: q for (i, _), q in zip(found, p, strict=True) if q >= 0.5}
        spans = [(m.start(), m.end(), float(bad[i])) for i, m in enumerate(WORD.finditer(text)) if i in bad] if bad else []
        return self.final(p), spans

    def final(self, p: np.ndarray) -> float:
        z = float(self.model.score @ [1.0, np.log1p(p.sum()), p.max(initial=0.0)])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def one_of_each(many: list[str]) -> list[str]:
    """Without most copies and near copies: they are no further evidence. Two minima of three-word runs each stand for a text."""
    seen: set = set()
    out = []
    for t in many:
        w = t.lower().split()
        runs = [zlib.crc32(" ".join(w[i : i + 3]).encode("utf-8", "surrogatepass")) for i in range(max(1, len(w) - 2))]
        keys = {("a", min(runs)), ("b", min(x * 2654435761 % 4294967296 for x in runs))}
        if not keys & seen:
            out.append(t)
        seen |= keys
    return out


def fit(toxic: list[str], clean: list[str]) -> Model:
    model = Model()
    n1, n0 = len(toxic), len(clean)
    if not n1 or not n0:
        model.score = np.array([np.log((n1 + 0.5) / (n0 + 0.5)), 0.0, 0.0])
        return model
    toxic, clean = one_of_each(toxic), one_of_each(clean)
    n1, n0 = len(toxic), len(clean)
    held = [Counter(), Counter()]
    for y, many in ((0, clean), (1, toxic)):
        for t in many:
            words = {w.lower() for w in WORD.findall(t)}
            held[y].update(words)
            for k in (3, 4, 5, 6):
                held[y].update({w[:k] + "-" for w in words if len(w) > k})
    # a form is learnt if its share of toxic documents is above the toxic share of all forms, tested over all forms at once
    mass = [sum(c.values()) for c in held]
    share = max(n1 / (n1 + n0), mass[1] / max(1, sum(mass)))
    need = np.log(len(held[1]) + len(held[0]) + 1) + np.log(100)
    evidence = {}
    for f, c in held[1].items():
        n = c + held[0][f]
        if c >= SUPPORT and c > share * n:
            x = c / n
            evidence[f] = n * (x * np.log(x / share) + (0 if x == 1 else (1 - x) * np.log((1 - x) / (1 - share))))
    learnt = sorted((f for f, v in evidence.items() if v > need), key=lambda f: (-evidence[f], f))
    strong = {f for f in learnt if held[0][f] <= 0.1 * held[1][f]}
    number = {f: i for i, f in enumerate(learnt)}
    strong &= set(learnt)
    cache: dict[str, tuple[tuple[int, ...], bool]] = {}

    def look(w: str):
        if w not in cache:
            fs = forms(w)
            cache[w] = tuple(number[f] for f in fs if f in number), bool(fs & strong)
        return cache[w]

    # sequences without any learnt form differ by their length alone: one stands for all of a length, with their number
    seqs, plain = [], Counter()
    for y, many in ((1, toxic), (0, clean)):
        for t in many:
            words = WORD.findall(t)
            for i in range(0, len(words), SEQUENCE):
                part = [look(w) for w in words[i : i + SEQUENCE]]
                if any(f for f, _ in part):
                    seqs.append(([f for f, _ in part], [int(s and y) for _, s in part]))
                else:
                    plain[len(part)] += 1
    times = np.array([1.0] * len(seqs) + [float(n) for _, n in sorted(plain.items())])
    seqs += [([()] * k, [0] * k) for k, _ in sorted(plain.items())]
    B, L = len(seqs), SEQUENCE
    rows, cols, which = [], [], []
    size = np.array([len(f) for f, _ in seqs])
    Y = np.zeros((B, L), int)
    for b, (fs, ys) in enumerate(seqs):
        Y[b, : len(ys)] = ys
        for t, f in enumerate(fs):
            rows += [b] * len(f)
            cols += [t] * len(f)
            which += f
    rows, cols, which = np.array(rows, int), np.array(cols, int), np.array(which, int)
    mask = np.arange(L)[None] < size[:, None]
    w, bias, trans = np.zeros(len(learnt)), -4.0, np.zeros((2, 2))
    g_w, g_b, g_t = np.full(len(learnt), 1e-6), 1e-6, np.full((2, 2), 1e-6)
    pair_true = np.zeros((2, 2))
    np.add.at(pair_true, (Y[:, :-1][mask[:, 1:]], Y[:, 1:][mask[:, 1:]]), np.broadcast_to(times[:, None], (B, L - 1))[mask[:, 1:]])
    for _ in range(60):
        e = np.zeros((B, L))
        np.add.at(e, (rows, cols), w[which])
        e += bias
        local = np.stack([np.ones_like(e), np.exp(np.clip(e, -30, 30))], 2)
        A = np.exp(trans)
        fore, back = np.zeros((B, L, 2)), np.zeros((B, L, 2))
        v = local[:, 0]
        fore[:, 0] = v / v.sum(1, keepdims=True)
        for t in range(1, L):
            v = (fore[:, t - 1] @ A) * local[:, t]
            fore[:, t] = v / v.sum(1, keepdims=True)
        back[:, L - 1] = 0.5
        for t in range(L - 2, -1, -1):
            v = (local[:, t + 1] * back[:, t + 1]) @ A.T
            v = np.where(mask[:, t + 1, None], v, 1.0)
            back[:, t] = v / v.sum(1, keepdims=True)
        p = fore * back
        p = p[:, :, 1] / p.sum(2)
        pair = fore[:, :-1, :, None] * A * (local * back)[:, 1:, None, :]
        pair /= pair.sum((2, 3), keepdims=True)
        diff = np.where(mask, Y - p, 0.0) * times[:, None]
        dw = np.bincount(which, diff[rows, cols], len(learnt)) - 0.02 * w
        db, dt = diff.sum(), pair_true - (pair * (mask[:, 1:] * times[:, None])[:, :, None, None]).sum((0, 1)) - 0.02 * trans
        g_w, g_b, g_t = g_w + dw * dw, g_b + db * db, g_t + dt * dt
        w, bias, trans = w + 0.8 * dw / np.sqrt(g_w), bias + 0.8 * db / np.sqrt(g_b), trans + 0.3 * dt / np.sqrt(g_t)
    model.weight = {f: float(w[i]) for f, i in number.items() if abs(w[i]) > 1e-3}
    model.bias, model.trans = float(bias), trans
    tagger = Tagger(model)
    X = []
    for t in toxic + clean:
        values = [tagger[x] for x in WORD.findall(t)]
        found = [(i, v) for i, v in enumerate(values) if v]
        p = tagger.marginals(found, len(values)) if found else np.zeros(0)
        X.append((1.0, np.log1p(p.sum()), p.max(initial=0.0)))
    X, y = np.array(X), np.r_[np.ones(n1), np.zeros(n0)]
    s = np.zeros(3)
    for _ in range(50):  # Newton's steps of a ridge logistic regression
        q = 1 / (1 + np.exp(-X @ s))
        s = s + np.linalg.solve((X * (q * (1 - q))[:, None]).T @ X + 0.05 * np.eye(3), X.T @ (y - q) - 0.05 * s)
    model.score = s
    return model


def held_out(ids) -> F.Column:
    """Rows whose crc32 of doc_id, written as text, is divisible by 5. A null id is not held out."""
    return F.coalesce(F.crc32(F.encode(ids.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits on a bounded sample of labelled rows that are not held out."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(~held_out(F.col("doc_id")))
    first = lambda y: known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE[y])
    few = first(1).unionByName(first(0))
    made: list[str] = []
    rows = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").where(F.col("text").isNotNull())  # the sample has a fixed bound
    rows = stored(rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), made)
    so_far = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    chosen = rows.select("doc_id", "toxic", F.octet_length("text").alias("n")).where(F.col("n") <= SAMPLE_BYTES // 32).withColumn("all", F.sum("n").over(so_far)).where(F.col("all") <= SAMPLE_BYTES)
    rows = sorted(rows.join(F.broadcast(chosen.select("doc_id")), "doc_id").collect(), key=lambda r: r["doc_id"])
    discard(docs.sparkSession, made)
    return fit([r["text"] for r in rows if r["toxic"] == 1], [r["text"] for r in rows if r["toxic"] == 0])


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted and spans (start:end of offending words, code points, comma-joined)."""

    def make():
        tagger = Tagger(model)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            read = [tagger.read(t) for t in batch.column("text").to_pylist()]
            score = pa.array([s for s, _ in read], pa.float64())
            marks = pa.array([",".join(f"{a}:{b}" for a, b, _ in x) for _, x in read], pa.string())
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), score, pa.array([int(s >= 0.5) for s, _ in read], pa.int32()), marks], ["doc_id", "score", "predicted", "toxic_spans"])

        return one

    return map_pieces(texts(docs, id_col=id_col, text_col=text_col), make, f"doc_id {dict(docs.dtypes)[id_col]}, score double, predicted int, toxic_spans string")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The documents, all their columns, whose score is below one half."""
    def make_flag():
        taggers: list = []

        def flag(s: pd.Series) -> pd.Series:
            if not taggers:
                taggers.append(Tagger(model))
            return s.map(lambda t: taggers[0].read(t or "")[0] < 0.5).astype(bool)

        return flag

    return docs.where(F.pandas_udf(make_flag(), "boolean")("text"))
