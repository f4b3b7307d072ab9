"""Quality rules whose cutoffs are chosen under risk control.

Every rule is a number of a text of which large values speak against it. The rules' cutoffs are fixed in LEVELS, from the laxest to
the strictest; at a level a text is rejected if any rule's number is over its cutoff there. For each stratum (language) the levels
are tested one after another on a labelled holdout: of the different texts labelled good that pass the base rule, how many
would be rejected? The exact binomial (Clopper-Pearson) upper bound of that rate must not exceed ALPHA; the first level that fails
ends the stratum's sequence, and the last that passed is taken. All rules are tested together, so ALPHA bounds what they reject
together, and no share of it is spent on each.

Correction for multiple tests: in a fixed sequence no correction is due. Over strata, each begins with a share of DELTA in
proportion to its number of different good texts, which is known before it is looked at what would be rejected, so no error is
spent on strata that are too small to pass; a stratum whose whole sequence passed hands its share on to those still open, in the same
proportions (weighted Holm). So with probability 1 - DELTA no stratum's level rejects more than ALPHA of its good texts. A stratum
with too few labels for even the laxest level keeps its rows (with all of DELTA 149 good texts are needed if none is rejected, with a
third of it 203).

Edge cases: null or empty text has no words, all counts 0, and fails the base rule (fewer than 50 words). Null strata are
a stratum of their own. Labels that are null or for unknown rows count nowhere; a row labelled both good and bad counts as bad.
Copies of a text, under one id or several, are one trial: good if all their labels are, rejected if any of them is. Repeated rows are
each answered. Empty tables give empty results. What has one row a stratum comes to the driver, as counts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_pieces, stored, texts

ALPHA, DELTA = 0.02, 0.05
#: Rules, and their cutoffs from the laxest level on.
LEVELS = {
    "symbols_per_char": (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05),
    "repeated_share": (0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15),
    "dup_line_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25),
    "upper_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2),
    "mark_share": (0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1),
}
DEPTH = 8
SYMBOLS = frozenset(b"#*$%&|<>")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def numbers(text: str) -> tuple:
    """The counts of the contract, then code points in upper case, words without a letter or digit, and lines with a word."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split on ASCII white space alone, which is what the contract names
    n = len(words)
    flat = np.frombuffer(raw, np.uint8)
    points = int(np.count_nonzero((flat & 0xC0) != 0x80))
    tally = np.bincount(flat, minlength=256)
    blank = int(tally[9:14].sum() + tally[32])
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    repeated = 0
    if n >= 3:
        ids: dict[bytes, int] = {}
        w = np.fromiter([ids.setdefault(x, len(ids)) for x in words], np.int64, n)
        m = len(ids)
        pairs = w[:-1] * m + w[1:]
        if m < 1 << 20:
            key = pairs[:-1] * m + w[2:]
        else:
            key = np.unique(pairs, return_inverse=True)[1][:-1] * m + w[2:]
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        if same.any():
            twice = np.zeros(n - 2, bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            cover = np.zeros(n, bool)
            for k in range(3):
                cover[k : n - 2 + k] |= twice
            repeated = int(cover.sum())
    bare = int(sum(1 for x in words if len(x) <= 4 and not x.isalnum() and x.isascii() and not any(48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 for c in x)))
    return n, points - blank, int(sum(tally[c] for c in SYMBOLS)), len(lines) - len(set(lines)), repeated, int(tally[65:91].sum()), bare, len(lines)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """doc_id, stratum, copy (a hash of the text) and the counts of every whole text."""

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [numbers(t) for t in batch.column("text").to_pylist()]
            cols = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pc.cast(batch.column("stratum"), pa.string()), batch.column("copy"), *(pa.array(c, pa.int64()) for c in cols)], ["doc_id", "stratum", "copy", *COUNTS, "n_upper", "n_bare", "n_lines"])

        return one

    df = texts(docs, F.col(stratum_col).cast("string").alias("stratum"), F.xxhash64(text_col).alias("copy"), id_col=id_col, text_col=text_col)
    return map_pieces(df, make, f"doc_id {dict(docs.dtypes)[id_col]}, stratum string, copy long, " + ", ".join(f"{c} long" for c in (*COUNTS, "n_upper", "n_bare", "n_lines")))


def rules() -> dict:
    """Rule -> column expression over measure()."""
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "symbols_per_char": share("n_symbols", "word_chars"),
        "repeated_share": share("n_repeat_words", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "upper_share": share("n_upper", "word_chars"),
        "mark_share": share("n_bare", "n_words"),
    }


def base_failed() -> F.Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def first_levels() -> dict:
    """Rule -> the laxest level (from 0) at which it rejects; DEPTH if none does."""
    return {r: F.lit(DEPTH) - sum((F.when(expr > c, 1).otherwise(0) for c in LEVELS[r]), F.lit(0)) for r, expr in rules().items()}


def binomial_upper(k: int, n: int, error: float) -> float:
    """Clopper-Pearson upper bound: the p at which at most k of n has probability `error`."""
    if k >= n:
        return 1.0

    def below(p: float) -> float:
        if p <= 0:
            return 1.0
        if p >= 1:
            return 0.0
        term = n * math.log1p(-p)
        total, step = [term], math.log(p) - math.log1p(-p)
        for i in range(1, k + 1):
            term += math.log((n - i + 1) / i) + step
            total.append(term)
        top = max(total)
        return math.exp(top) * math.fsum(math.exp(x - top) for x in total)

    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) > error else (low, mid)
    return high


def choose(counts: dict, alpha: float = ALPHA, delta: float = DELTA) -> dict:
    """Stratum -> number of levels that passed. counts: stratum -> texts by the first level that rejects them (DEPTH: none does)."""
    passed = {s: 0 for s in counts}
    size = {s: sum(c) for s, c in counts.items()}
    still = [s for s in counts if size[s]]
    while still:
        whole = sum(size[s] for s in still)
        for s in still:
            rejected = np.cumsum(counts[s]).tolist()
            while passed[s] < DEPTH and binomial_upper(rejected[passed[s]], size[s], delta * size[s] / whole) <= alpha:
                passed[s] += 1
        left = [s for s in still if passed[s] < DEPTH]
        if len(left) == len(still):
            break
        still = left
    return passed


def holdout(measured: DataFrame, labels: DataFrame) -> dict:
    """Stratum -> numbers of different good texts by the first level that rejects them."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = measured.withColumn("level", F.least(*first_levels().values())).join(known, "doc_id")
    trials = rows.groupBy("copy").agg(F.min("quality").alias("quality"), F.min("level").alias("level"), F.min(F.struct(F.col("stratum").isNull(), "stratum")).alias("s"), F.bool_or(base_failed()).alias("failed"))
    out: dict = {}
    for r in trials.where("quality = 1 AND NOT failed").groupBy(F.col("s.stratum").alias("stratum"), "level").count().collect():
        out.setdefault(r["stratum"], [0] * (DEPTH + 1))[r["level"]] = r["count"]
    return dict(sorted(out.items(), key=lambda x: (x[0] is None, x[0] or "")))


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """doc_id, the counts, base_failed, kept, and the rules that rejected the row."""
    measured = stored(measure(docs))
    passed = choose(holdout(measured, labels), alpha, delta)
    levels = docs.sparkSession.createDataFrame([(s, n) for s, n in passed.items() if n], "s string, passed int")
    out = measured.join(F.broadcast(levels), F.col("stratum").eqNullSafe(F.col("s")), "left")  # one row a language
    hits = [F.when(level < F.coalesce("passed", F.lit(0)), F.lit(r)) for r, level in first_levels().items()]
    out = out.withColumn("base_failed", base_failed()).withColumn("rejected_by", F.concat_ws(",", *hits))
    return out.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & (F.col("rejected_by") == "")).alias("kept"), "rejected_by")
