"""Personal data: fixed patterns, completed by a skip-chain conditional random field.

Nodes of the field are the tokens that carry a digit, "@" or "+"; every other token is certainly outside an entity, so
leaving it out changes no marginal. Chain edges join neighbouring tokens. Skip edges join a token to the next one of
the same document with the same letters and digits, however far away, or with the same digits written with other
separators. Sum-product messages run over this graph until they settle, so a token that is plain in one place makes its
repetitions elsewhere take the same label. No path is longer than the number of tokens, so that many rounds reach everything;
messages that still swing then (which loops can cause, damping and learnt weights notwithstanding) are taken as they are.
Weights are learnt by maximum pseudo-likelihood from generated examples.

Edge cases: null or empty text has no spans. Offsets are code points, the end is exclusive. Repeated rows are each
answered. The number of skip edges is linear in the number of tokens, also when one token fills a document; messages are made
for EDGES edges at a time, so that memory is a few doubles a token.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_pieces, texts

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
SIGNAL = re.compile(r"[0-9@]")
EDGE = re.compile(r"^[^A-Za-z0-9+(]+|[^A-Za-z0-9)]+$")


def luhn(digits: str) -> bool:
    d = [int(c) for c in digits]
    return (sum(d[-1::-2]) + sum(x * 2 - 9 * (x > 4) for x in d[-2::-2])) % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def is_card(s: str) -> bool:
    d = digits_of(s)
    return 12 <= len(d) <= 19 and luhn(d)


def is_ip(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:3] or 0) <= 255 for p in s.split("."))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind's place, end) of the fixed patterns, sorted. Linear in the text, whatever its runs are."""
    found = []
    last = 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in LOCAL:
            begin -= 1
        if begin < at and (m := DOMAIN.match(text, at)):
            found.append((begin, 0, m.end()))
            last = m.end()
        else:
            last = max(last, at + 1)
        at = text.find("@", max(at + 1, last))
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if is_ip(m[0])]
    found += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if is_card(m[0])]
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return sorted(found)


# ---- the field ---------------------------------------------------------------------------------------------------

N_FEATURES = 22
LABELS = 1 + len(KINDS)


def nodes(text: str) -> list[tuple[int, int, bool]]:
    """Tokens with a digit, "@" or "+" as (start, end, follows the token before it at once)."""
    out: list[tuple[int, int, bool]] = []
    done, end_before = 0, -9
    for m in SIGNAL.finditer(text):
        if m.start() < done:
            continue
        begin, end = m.start(), m.end()
        while begin > done and not text[begin - 1].isspace():
            begin -= 1
        while end < len(text) and not text[end].isspace():
            end += 1
        done = end
        token = text[begin:end]
        s = EDGE.sub("", token)
        at = begin + token.find(s) if s else begin
        if s:
            out.append((at, at + len(s), 0 <= begin - end_before <= 1))
            end_before = end
    return out


def features(s: str) -> list[int]:
    """Indexes of the features of a token's form."""
    d = digits_of(s)
    n, letters, parts = len(d), sum(c.isalpha() for c in s), s.split(".")
    f = [0]
    f.append(1 + (0 if n == 0 else 1 if n <= 3 else 2 if n <= 6 else 3 if n <= 8 else 4 if n <= 11 else 5 if n <= 19 else 6))
    f += [8] * ("@" in s) + [9] * bool(DOMAIN.search(s) and s[0] != "@") + [10] * (12 <= n <= 19 and luhn(d) and letters == 0)
    f += [11] * (len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts) and is_ip(s)) + [12] * s.startswith("+") + [13] * (s.startswith("(") and s.endswith(")"))
    f += [14] * (n == len(s)) + [15] * (letters > 0) + [16] * bool(re.fullmatch(r"[0-9]{3}[-.][0-9]{4}", s)) + [17] * bool(re.fullmatch(r"\(?[0-9]{3}\)?[-. ]?[0-9]{3}[-.][0-9]{4}", s))
    f += [18] * (len(parts) in (2, 3)) + [19] * (letters > 0 and n > 0 and "@" not in s) + [20] * (len(set(d)) == 1 and n > 3) + [21] * (len(s) > 40)
    return f


def edges(text: str, tokens: list[tuple[int, int, bool]]) -> tuple[list, list]:
    chain = [(i - 1, i) for i, t in enumerate(tokens) if i and t[2]]
    skip, seen = [], {}
    for i, (a, b, _) in enumerate(tokens):
        s = text[a:b]
        d = digits_of(s)
        key = ("d", d) if len(d) >= 7 and not any(c.isalpha() for c in s) else ("t", s.lower())
        if key in seen:
            skip.append((seen[key], i))
        seen[key] = i
    return chain, skip


def examples(seed: int = 7, documents: int = 400):
    """Generated texts with their true label of each node: forms of each kind, and number-like tokens that are none."""
    rng = random.Random(seed)
    word = lambda n=4: "".join(rng.choice("abcdefghilmnoprstuv") for _ in range(rng.randint(2, n + 4)))
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card() -> str:
        s = num(rng.choice((13, 15, 15, 15, 16, 18)))
        return next(s + c for c in "0123456789" if luhn(s + c))

    def plain() -> str:
        other = rng.choice(("year", "version", "count", "price", "hex", "long", "time", "ratio"))
        return {"year": str(rng.randint(1900, 2030)), "version": f"{rng.randint(0, 9)}.{rng.randint(0, 20)}" + f".{rng.randint(0, 9)}" * rng.randint(0, 1), "count": num(rng.randint(1, 6)), "price": f"{num(2)}.{num(2)}", "hex": f"{word()}{num(5)}{word()}", "long": num(rng.choice((20, 24, 9, 11, 8))), "time": f"{num(2)}:{num(2)}", "ratio": f"{num(1)}/{num(2)}"}[other]

    for _ in range(documents):
        parts: list[tuple[str, int]] = []
        kept: list[list[tuple[str, int]]] = []
        for _ in range(rng.randint(3, 12)):
            r = rng.random()
            if kept and r < 0.25:
                new = rng.choice(kept)
            elif r < 0.4:
                new = [(f"{word()}.{num(2)}@{word()}.{rng.choice(('com', 'org', 'example.net'))}", 1)]
            elif r < 0.52:
                new = [(".".join(str(rng.randint(0, 255)) for _ in range(4)), 2)]
            elif r < 0.66:
                new = [(card(), 3)]
            elif r < 0.8:
                new = rng.choice(([(f"+{rng.randint(1, 99)}", 4), (f"({num(3)})", 4), (f"{num(3)}-{num(4)}", 4)], [(f"{num(3)}-{num(3)}-{num(4)}", 4)], [(f"({num(3)})", 4), (f"{num(3)}-{num(4)}", 4)]))
            else:
                new = [(plain(), 0)]
            kept.append(new)
            parts += [*[("", 0)] * rng.randint(0, 2), *new]
        text, truth = "", []
        for s, y in parts:
            s = s or word()
            truth += [(len(text), y)]
            text += s + rng.choice((" ", " ", ". ", ", ")) if y == 0 else s + " "
        yield text, truth


@lru_cache(maxsize=1)
def weights() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token, chain and skip weights by maximum pseudo-likelihood. Deterministic; the generated sample is bounded."""
    X, Y, C, S = [], [], [], []
    for text, truth in examples():
        tokens = nodes(text)
        label = dict(truth)
        off = len(Y)
        for a, b, _ in tokens:
            x = np.zeros(N_FEATURES)
            x[features(text[a:b])] = 1
            X.append(x)
            Y.append(label.get(a, 0))
        c, s = edges(text, tokens)
        C += [(off + i, off + j) for i, j in c]
        S += [(off + i, off + j) for i, j in s]
    X, Y = np.array(X), np.array(Y)
    C, S = np.array(C).reshape(-1, 2), np.array(S).reshape(-1, 2)
    hot = np.eye(LABELS)[Y]
    W, T, K = np.zeros((N_FEATURES, LABELS)), np.zeros((LABELS, LABELS)), np.zeros((LABELS, LABELS))
    for step in range(300):
        z = X @ W
        for E, M in ((C, T), (S, K)):
            np.add.at(z, E[:, 1], M[Y[E[:, 0]]])
            np.add.at(z, E[:, 0], M.T[Y[E[:, 1]]])
        p = np.exp(z - z.max(1, keepdims=True))
        g = hot - p / p.sum(1, keepdims=True)
        rate = 6.0 / (1 + step / 60)
        W += rate * (X.T @ g / len(Y) - 1e-3 * W)
        for E, M in ((C, T), (S, K)):
            d = np.zeros_like(M)
            np.add.at(d, Y[E[:, 0]], g[E[:, 1]])
            d2 = np.zeros_like(M)
            np.add.at(d2, Y[E[:, 1]], g[E[:, 0]])
            M += rate * ((d + d2.T) / len(Y) - 1e-3 * M)
    return W, T, K


#: Edges whose messages are made together.
EDGES = 1 << 14
SETTLED = 1e-4


def marginals(unary: np.ndarray, chain: np.ndarray, skip: np.ndarray, model) -> np.ndarray:
    """Loopy sum-product in the log domain over all edges at once, damped, until messages settle; exact on trees."""
    E = np.concatenate([chain, skip]).astype(int).reshape(-1, 2)
    _, T, K = model
    b = unary
    if len(E):
        src, dst = np.concatenate([E[:, 0], E[:, 1]]), np.concatenate([E[:, 1], E[:, 0]])
        kinds = np.stack([T, K, T.T, K.T])
        kind = np.concatenate([np.zeros(len(chain), int), np.ones(len(skip), int)])
        kind = np.concatenate([kind, kind + 2])
        back = np.concatenate([np.arange(len(E)) + len(E), np.arange(len(E))])
        msg = np.zeros((len(src), LABELS))
        for _ in range(30 + 2 * len(unary)):
            b = unary.copy()
            np.add.at(b, dst, msg)
            made, change = np.empty_like(msg), 0.0
            for i in range(0, len(src), EDGES):
                part = slice(i, i + EDGES)
                x = (b[src[part]] - msg[back[part]])[:, :, None] + kinds[kind[part]]
                top = x.max(1)
                new = top + np.log(np.exp(x - top[:, None, :]).sum(1))
                new -= new.max(1, keepdims=True)
                change = max(change, float(np.abs(new - msg[part]).max()))
                made[part] = new
            msg = 0.5 * msg + 0.5 * made
            if change < SETTLED:
                break
        b = unary.copy()
        np.add.at(b, dst, msg)
    p = np.exp(b - b.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def field_spans(text: str, model, least: float = 0.9) -> list[tuple[int, int, str]]:
    """Spans that the field adds: tokens of one label side by side, marginals of at least `least`, and a complete form."""
    tokens = nodes(text)
    if not tokens:
        return []
    rows = [features(text[a:b]) for a, b, _ in tokens]
    unary = np.array([model[0][f].sum(0) for f in rows])
    chain, skip = edges(text, tokens)
    p = marginals(unary, np.array(chain).reshape(-1, 2), np.array(skip).reshape(-1, 2), model)
    y = np.where(p.max(1) >= least, p.argmax(1), 0)
    out, run = [], None
    for i, (a, b, joined) in enumerate(tokens):
        if run and joined and y[i] == run[2] == 4 and y[i]:
            run[1] = b
            continue
        if run:
            out.append(tuple(run))
        run = [a, b, int(y[i])] if y[i] else None
    if run:
        out.append(tuple(run))
    whole = {1: lambda s: bool(DOMAIN.search(s)), 2: lambda s: s.count(".") == 3 and is_ip(s), 3: is_card, 4: lambda s: 9 <= len(digits_of(s)) <= 15}
    return [(a, k - 1, b) for a, b, k in out if whole[k](text[a:b])]


def all_spans(text: str, model) -> tuple[list, list]:
    """(base spans, base and added spans); an added span that touches a base span of its kind is left out."""
    if not SIGNAL.search(text):
        return [], []
    base = base_spans(text)
    begins = [[a for a, kind, _ in base if kind == k] for k in range(len(KINDS))]
    ends = [[b for _, kind, b in base if kind == k] for k in range(len(KINDS))]

    def apart(a: int, k: int, b: int) -> bool:
        i = bisect_left(begins[k], b) - 1  # spans of a kind do not overlap: the last that begins before the end
        return i < 0 or ends[k][i] <= a

    return base, sorted(base + [x for x in field_spans(text, model) if apart(*x)])


def written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, all spans, and n_added (those of the field)."""
    model = weights()

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            cols: list[list] = [[] for _ in range(7)]
            for t in batch.column("text").to_pylist():
                base, every = all_spans(t, model)
                for k in range(4):
                    cols[k].append(sum(x[1] == k for x in base))
                cols[4].append(hashlib.sha256(written(base).encode()).hexdigest())
                cols[5].append(written(every))
                cols[6].append(len(every) - len(base))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

        return one

    ids = dict(docs.dtypes)[id_col]
    return map_pieces(texts(docs, id_col=id_col, text_col=text_col), make, f"doc_id {ids}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redact_text(text: str, model) -> str:
    """The text with every span replaced by its kind in brackets; of overlapping spans one replacement is made."""
    _, every = all_spans(text, model)
    out, at, end = [], 0, 0
    for a, k, b in every:
        if a >= end:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        end = at = max(end, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """The documents, row by row, with personal data replaced and n_chars (if there is one) made anew. Other columns and nulls stay."""
    model = weights()

    def clean_all(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t if t is None or not SIGNAL.search(t) else redact_text(t, model))

    clean = F.pandas_udf(clean_all, "string")
    out = docs.withColumn("text", clean("text"))
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out
