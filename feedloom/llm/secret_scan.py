"""Secrets: fixed patterns, completed by a token-efficiency test.

A byte-pair vocabulary covers language and ordinary identifiers with few tokens and random strings with many. Every string of
LEAST or more characters whose characters per token fall below a cutoff counts as a secret, unless it is a known digest (a
hexadecimal string of a digest's length behind a word that names a digest or a commit), a UUID, or part of a path, an address or
an e-mail. Strings in capitals are judged in lower case, as vocabularies hold few words in capitals.
A string with slashes or behind a full stop is part of a path or address only by a scheme before it, a usual root, or if each of
its parts is short or reads as words: keys hold slashes too, and the parts of a signed token follow full stops.

Edge cases: null or empty text has no spans. Offsets are code points, the end is exclusive. Repeated rows are each
answered. Patterns are linear in the text, and long strings are encoded in parts of PART characters.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_pieces, shipped, texts

KINDS = ("assign", "access", "hex", "random")
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern by which texts are split before the merges of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters per token. English words take over 4, base-62 noise takes 1.2 to 1.7.
CUTOFF = 2.0
#: Shorter strings say too little.
LEAST = 20
PART = 256


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = re.compile("(" + "|".join([_any_case(w) for w in ("password", "passwd", "secret", "token")] + [_any_case("api") + "_?" + _any_case("key")]) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
DIGEST = re.compile(r"(md5|sha-?\d+|sha|blake\w*|crc\d*|digest|checksum|hash|fingerprint|etag|commit|revision|integrity)\W{0,4}\Z", re.IGNORECASE)
DIGEST_LENGTHS = {32, 40, 48, 56, 64, 96, 128}
#: An address behind its scheme, up to the query.
ADDRESS = re.compile(r"""://[^\s"'<>?#]+""")
ROOT = re.compile(r"/(bin|boot|dev|etc|home|lib|lib64|media|mnt|opt|proc|root|run|sbin|srv|sys|tmp|usr|var|Users|Library|Applications)/")
#: Parts of a path of up to so many characters say nothing.
SHORT_PART = 3


@lru_cache(maxsize=4)
def encoding(file: bytes, pattern: str = PATTERN):
    """The encoder of a rank file's bytes."""
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file.splitlines())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    return sorted(found + [(m.start(), 2, m.end()) for m in HEX.finditer(text)])


def known(text: str, a: int, b: int) -> bool:
    s = text[a:b]
    if re.fullmatch(r"[0-9a-fA-F]+", s) and len(s) in DIGEST_LENGTHS and DIGEST.search(text[max(0, a - 24) : a]):
        return True
    return bool(UUID.fullmatch(s)) or text[b : b + 1] == "@" or text[a - 1 : a] == "@" and a > 0 or text[max(0, a - 3) : a] == "://"


def placed(text: str, a: int, b: int, addresses: list[tuple[int, int]], enc, cutoff: float) -> bool:
    """Part of a path or an address."""
    s = text[a:b]
    if s.count("/") < 3 and not (a > 0 and text[a - 1] == "."):
        return False
    i = bisect_right(addresses, (a, b)) - 1
    return i >= 0 and a < addresses[i][1] or bool(ROOT.match(s)) or all(len(p) <= SHORT_PART or efficiency(p, enc) >= cutoff for p in s.split("/"))


def efficiency(s: str, enc) -> float:
    """Characters per token."""
    if s.isupper():
        s = s.lower()
    return len(s) / max(1, sum(len(enc.encode_ordinary(s[i : i + PART])) for i in range(0, len(s), PART)))


def united(spans) -> tuple[list[int], list[int]]:
    """Begins and ends of spans, those that overlap put together; spans come by start."""
    begins: list[int] = []
    ends: list[int] = []
    for a, _, b in spans:
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            begins.append(a)
            ends.append(b)
    return begins, ends


def all_spans(text: str, enc, cutoff: float = CUTOFF) -> tuple[list, list]:
    base = base_spans(text)
    add = []
    addresses = [m.span() for m in ADDRESS.finditer(text)] if "://" in text else []
    begins, ends = united(base)
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        i = bisect_left(begins, b) - 1  # the last base span that begins before the end
        if (i < 0 or ends[i] <= a) and not known(text, a, b) and efficiency(m[0], enc) < cutoff and not placed(text, a, b, addresses, enc, cutoff):
            add.append((a, 3, b))
    return base, sorted(base + add)


def written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, vocabulary: str = VOCABULARY, cutoff: float = CUTOFF, id_col: str = "doc_id", text_col: str = "text", pattern: str = PATTERN) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, all spans, n_added (those of the token-efficiency test)."""
    file = shipped(docs.sparkSession, vocabulary)

    def make():
        enc = encoding(file.value, pattern)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            cols: list[list] = [[] for _ in range(6)]
            for t in batch.column("text").to_pylist():
                base, every = all_spans(t, enc, cutoff)
                for k in range(3):
                    cols[k].append(sum(x[1] == k for x in base))
                cols[3].append(hashlib.sha256(written(base).encode()).hexdigest())
                cols[4].append(written(every))
                cols[5].append(len(every) - len(base))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added"])

        return one

    ids = dict(docs.dtypes)[id_col]
    return map_pieces(texts(docs, id_col=id_col, text_col=text_col), make, f"doc_id {ids}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long")
