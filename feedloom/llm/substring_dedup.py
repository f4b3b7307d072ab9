"""Removal of repeated byte strings, by sorted suffixes at sampled anchors; the sort is deep-shallow.

Each window of LENGTH bytes has an anchor, the least hash among its GRAM-byte strings (the leftmost of equals). Equal
windows have their anchors at the same offset, so the offset and the anchor's content part all windows. Windows in a row
with one anchor form a bundle: a string and the anchor's place in it. Bundles that occur twice are repeated as a whole.
Bundles that share only the anchor are compared in their group: the suffixes that begin at the anchor, and the reversed
strings before it, are sorted deep-shallow: multikey quicksort by eight-byte characters down to SHALLOW bytes, then a blind
trie orders each remaining group of long common prefix. The common prefixes of neighbours give, for every offset at once,
which windows are equal on both sides: two windows with the anchor at offset l are equal if they share l bytes before it
and LENGTH - l from it on. So work follows the number of windows, not of pairs.

A group of over HOT different bundles (a passage that stands in very many texts) is split before it is sorted: the offsets
fall into ranges, all windows of a range share a core of bytes around the anchor, and what differs in the core is apart.
Groups that are still too large are split into finer ranges, down to single offsets, where a piece is one window.

Only different texts are read (identical ones share a 128-bit key, and are gathered with map-side aggregation); texts longer
than SEGMENT are read in segments that overlap by LENGTH - 1 bytes, so that memory is bounded by a text, not a multiple of it.
The table of texts is written in buckets, so texts are shuffled once.

Edge cases: null or empty text keeps nothing and removes nothing; texts shorter than LENGTH keep everything; strings that
repeat inside one text count, overlapping or not; UTF-8 bytes decide, not characters. Repeated rows, whatever their ids, are
copies of each other and are each answered. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, discard, map_pieces, stored, texts
from .near_dedup import U, mix, powers

LENGTH, GRAM, SHALLOW, HOT = 400, 32, 64, 512
WIDTH = LENGTH - GRAM + 1
#: Windows of a text that are looked at together; about 120 bytes of memory each.
SEGMENT = 1 << 17
#: Offsets to a range, as a large group is split again and again.
STEPS = (46, 6, 1)
#: Bytes of bundles that a task sorts at once; an anchor's group is never cut.
TOGETHER = 3 << 20
PLACE = 28  # bits of a place in a segment


def raw_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts laid end to end, and where each begins; no copy."""
    column = pc.cast(column, pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def sums(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, U)
    np.multiply(raw.astype(U) + U(1), up[:-1], out=total[1:])
    return np.add.accumulate(total, out=total), down


def bundles(raw: np.ndarray, offsets: np.ndarray):
    """text number, first window, windows, anchor's offset, hash of the anchor, hash of the bundle; of texts laid end to end."""
    n = len(raw)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, none, none, none
    total, down = sums(raw)
    key = mix((total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1])
    key >>= U(PLACE)
    key <<= U(PLACE)
    key |= np.arange(len(key), dtype=U)
    m = len(key)
    blocks = np.concatenate([key, np.full(-m % WIDTH, U((1 << 64) - 1))]).reshape(-1, WIDTH)
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    ahead = np.minimum.accumulate(blocks, 1, out=blocks).ravel()
    anchor = (np.minimum(behind[: m - WIDTH + 1], ahead[WIDTH - 1 : m]) & U((1 << PLACE) - 1)).astype(np.int32)
    del key, blocks, ahead, behind
    p = np.arange(len(anchor))
    doc = np.searchsorted(offsets, p, "right") - 1
    ok = p + LENGTH <= offsets[doc + 1]
    change = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(ok & np.concatenate([[True], change | ~ok[:-1]]))
    last = np.flatnonzero(ok & np.concatenate([change | ~ok[1:], [True]]))
    part = lambda a, b: mix((total[b] - total[a]) * down[a])
    at = anchor[first].astype(np.int64)
    a = part(at, at + GRAM)
    s = mix(part(first, last + LENGTH) + (at - first).astype(U) + ((last - first).astype(U) << U(20)))
    return doc[first], first - offsets[doc[first]], last - first + 1, at - first, a.view(np.int64), s.view(np.int64)


def segments(offsets: np.ndarray):
    """(first text, last text + 1, begin) of the pieces that are looked at together: many short texts, or a part of a long one. A text's own cuts depend on it alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        size = offsets[i + 1] - offsets[i]
        if size > SEGMENT + LENGTH:
            yield from ((i, i + 1, int(b)) for b in range(0, int(size) - LENGTH + 1, SEGMENT))
            i += 1
            continue
        j = i + 1
        while j < n and offsets[j + 1] - offsets[i] <= SEGMENT + LENGTH:
            j += 1
        yield i, j, 0
        i = j


# ---- deep-shallow sort -------------------------------------------------------------------------------------------


def common(a: bytes, b: bytes, low: int) -> int:
    """Length of the longest common prefix, known to be at least low."""
    high = min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


def blind_trie(strings: list[bytes], depth: int) -> tuple[list[int], list[int]]:
    """Sorted order of strings that share `depth` bytes, and each one's common prefix with the one before it.

    A node is [length of its prefix, children by next byte (-1: the string ends)], a leaf a list of equal strings' numbers.
    The search down the trie looks at branching bytes only; one comparison with the leaf found corrects it.
    """
    root: list = [depth, {}]
    for i, s in enumerate(strings):
        path, node = [], root
        while node[0] >= 0:  # leaves have -1 in front
            path.append(node)
            kids = node[1]
            c = s[node[0]] if node[0] < len(s) else -1
            if (nxt := kids.get(c)) is None:
                nxt = next(iter(kids.values()), None)
                if nxt is None:
                    break
            node = nxt
        if node[0] >= 0:
            node[1][s[node[0]] if node[0] < len(s) else -1] = [-1, [i]]
            continue
        other = strings[node[1][0]]
        n = common(s, other, depth)
        if n == len(s) == len(other):
            node[1].append(i)
            continue
        k = next((j for j, x in enumerate(path) if x[0] > n), len(path))
        above = path[k - 1]
        mine = s[n] if n < len(s) else -1
        if above[0] == n:
            above[1][mine] = [-1, [i]]
        else:
            c = other[above[0]]
            above[1][c] = [n, {(other[n] if n < len(other) else -1): above[1][c], mine: [-1, [i]]}]
    order: list[int] = []
    lcp: list[int] = []
    stack: list = [(root, depth)]
    while stack:
        node, shared = stack.pop()
        if node[0] < 0:
            for j, i in enumerate(node[1]):
                order.append(i)
                lcp.append(shared if not j else len(strings[i]))
            continue
        kids = sorted(node[1])
        stack += [(node[1][c], shared if c == kids[0] else node[0]) for c in reversed(kids)]
    return order, lcp


def multikey_quicksort(keys: np.ndarray, order: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Sorts order[begin:stop] of every part by the rows of `keys`, in place: each open part is split in three by the character of its pivot at its depth; the middle goes on one character deeper. The parts of a round are split together."""
    depth = np.zeros(len(begin), np.int64)
    while True:
        open_ = (stop - begin > 1) & (depth < keys.shape[1])
        begin, stop, depth = begin[open_], stop[open_], depth[open_]
        parts = len(begin)
        if not parts:
            return order
        size = stop - begin
        part = np.repeat(np.arange(parts), size)
        before = np.cumsum(size) - size
        row = order[np.repeat(begin - before, size) + np.arange(len(part))]
        c = keys[row, depth[part]]
        pivot = np.sort(np.stack([c[before], c[before + size // 2], c[before + size - 1]]), 0)[1][part]  # the median of three
        where = part * 3 + (c >= pivot).astype(np.int64) + (c > pivot)
        count = np.bincount(where, minlength=3 * parts).reshape(-1, 3)
        starts = begin[:, None] + np.concatenate([np.zeros((parts, 1), np.int64), np.cumsum(count, 1)[:, :2]], 1)
        for k in range(3):
            i = np.flatnonzero(where % 3 == k)
            inside = np.arange(len(i)) - (np.cumsum(count[:, k]) - count[:, k])[part[i]]
            order[starts[:, k][part[i]] + inside] = row[i]
        begin, stop = starts.ravel(), (starts + count).ravel()
        depth = (depth[:, None] + np.array([0, 1, 0])).ravel()


def sort_suffixes(strings: list[bytes], group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (group, string), and common prefixes with the one before (-1 at a group's start)."""
    n = len(strings)
    lengths = np.minimum(np.fromiter(map(len, strings), np.int64, n), SHALLOW)
    head = np.frombuffer(b"".join(s[:SHALLOW].ljust(SHALLOW, b"\0") for s in strings), np.uint8).reshape(n, SHALLOW)
    # a string that ends before SHALLOW comes before one that goes on with zero bytes: its length is the last character
    keys = np.concatenate([head.view(">u8").astype(U), lengths[:, None].astype(U)], 1)
    order = np.argsort(group, kind="stable")
    g = group[order]
    edge = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if n else np.zeros(0, np.int64)
    order = multikey_quicksort(keys, order, edge, np.append(edge[1:], n))
    hw, ln = head[order], lengths[order]
    lcp = np.full(n, -1, np.int64)
    if n > 1:
        differ = hw[1:] != hw[:-1]
        short = np.where(differ.any(1), differ.argmax(1), SHALLOW)
        lcp[1:] = np.where(g[1:] == g[:-1], np.minimum(short, np.minimum(ln[1:], ln[:-1])), -1)
    # groups that agree down to the shallow depth go to blind tries
    begin = np.flatnonzero(np.concatenate([[True], lcp[1:] < SHALLOW])) if n else np.zeros(0, int)
    stop = np.append(begin[1:], n)
    for a, b in zip(begin[stop - begin > 1], stop[stop - begin > 1], strict=True):
        rows = order[a:b]
        inner, shared = blind_trie([strings[i] for i in rows], SHALLOW)
        order[a:b] = rows[inner]
        lcp[a + 1 : b] = shared[1:]
    return order, lcp


def repeated(strings: list[bytes], at: np.ndarray, n: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Boolean rows by bundle, columns by the anchor's offset: the windows that equal one of another bundle of their group."""
    N = len(strings)
    right, r_lcp = sort_suffixes([s[a:] for s, a in zip(strings, at, strict=True)], group)
    left, l_lcp = sort_suffixes([s[:a][::-1] for s, a in zip(strings, at, strict=True)], group)
    cover = np.zeros((N, WIDTH), bool)
    rc, lc = np.empty(N, np.int64), np.empty(N, np.int64)
    low = at - n + 1
    for off in range(WIDTH):
        i = np.flatnonzero((low <= off) & (off <= at))
        if len(i) < 2:
            continue
        rc[right] = np.cumsum(r_lcp < LENGTH - off)
        lc[left] = np.cumsum(l_lcp < off)
        key = rc[i] * (N + 1) + lc[i]
        o = np.argsort(key, kind="stable")
        same = np.flatnonzero(key[o][1:] == key[o][:-1])
        cover[i[o[same]], off] = True
        cover[i[o[same + 1]], off] = True
    return cover


# ---- the distributed plan ----------------------------------------------------------------------------------------

KEY = ["t1", "t2"]
PLACES = "t1 long, t2 long, p int, n int, at int"
PIECE = PLACES + ", ak long, sk long, c long, s binary"
SPAN = "t1 long, t2 long, start int, end int"
NAMES = ["t1", "t2", "p", "n", "at", "ak", "sk", "c"]
KINDS = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]


def _column(batch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _batch(cols, kinds, names) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def bundle_rows(uniq: DataFrame) -> DataFrame:
    """The bundles of every text; c is the number of the text's copies."""

    def run(batches):
        for b in batches:
            raw, offsets = raw_of(b.column("text"))
            t1, t2, c = _column(b, "t1"), _column(b, "t2"), _column(b, "c")
            for i, j, begin in segments(offsets):
                a = offsets[i] + begin
                z = offsets[j] if j - i > 1 or not begin and offsets[j] - a <= SEGMENT + LENGTH else min(offsets[j], a + SEGMENT + LENGTH - 1)
                d, p, n, at, ak, sk = bundles(raw[a:z], np.append(offsets[i:j], z) - a if j - i > 1 else np.array([0, z - a]))
                yield _batch([t1[i:j][d], t2[i:j][d], p + begin, n, at, ak, sk, c[i:j][d]], KINDS, NAMES)

    return uniq.select("text", *KEY, "c").mapInArrow(run, PIECE.removesuffix(", s binary"))


def bundle_strings(uniq: DataFrame, need: DataFrame) -> DataFrame:
    """The strings of the bundles in need, cut from their texts."""
    lists = need.groupBy(*KEY).agg(F.collect_list(F.struct("p", "n", "at", "ak", "sk", "c", "hot")).alias("of"))
    joined = uniq.join(lists, KEY).select("text", *KEY, "of")

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            raw, offsets = raw_of(batch.column("text"))
            data = memoryview(raw)
            lists = batch.column("of")
            text = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            x = lists.flatten()
            p, n = x.field("p").to_numpy(), x.field("n").to_numpy()
            a = offsets[text] + p
            strings = [bytes(data[i:j]) for i, j in zip(a.tolist(), (a + n - 1 + LENGTH).tolist(), strict=True)]
            keys = [pa.array(_column(batch, k)[text], pa.int64()) for k in KEY]
            return pa.RecordBatch.from_arrays([*keys, *(x.field(k) for k in NAMES[2:]), x.field("hot"), pa.array(strings, pa.binary())], [*NAMES, "hot", "s"])

        return one

    return map_pieces(joined, make, PIECE.replace(", s ", ", hot boolean, s "), 1 << 20)


def spans_of_groups(strings: DataFrame) -> DataFrame:
    """Covered runs of the bundles that occur once. Rows come sorted by anchor; whole groups are sorted in bounded bites."""

    def solve(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        col = {c: t.column(c).to_numpy() for c in NAMES}
        _, group = np.unique(col["ak"], return_inverse=True)
        at = col["at"].astype(np.int64)
        cover = repeated(t.column("s").to_pylist(), at, col["n"].astype(np.int64), group)
        cover[col["c"] > 1] = False  # these are repeated as a whole anyway
        edge = np.diff(np.pad(cover, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        r, lo = np.nonzero(edge == 1)
        _, hi = np.nonzero(edge == -1)  # offsets lo .. hi - 1
        anchor = col["p"][r] + at[r]
        return _batch([col["t1"][r], col["t2"][r], anchor - hi + 1, anchor - lo + LENGTH], [pa.int64(), pa.int64(), pa.int32(), pa.int32()], [*KEY, "start", "end"])

    def run(batches):
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.nbytes
            if size > TOGETHER:
                t = pa.Table.from_batches(held)
                ak = t.column("ak").to_numpy()
                k = int(np.searchsorted(ak, ak[-1], "left"))  # the last group may go on
                if k:
                    yield solve(t.slice(0, k))
                    held = t.slice(k).combine_chunks().to_batches()
                    size = sum(x.nbytes for x in held)
        if held:
            yield solve(pa.Table.from_batches(held))

    return strings.select(*NAMES, "s").repartition("ak").sortWithinPartitions("ak").mapInArrow(run, SPAN)


def split_by_core(strings: DataFrame, step: int) -> DataFrame:
    """Bundles cut into ranges of `step` offsets. The new group is the old with the range and the bytes that all windows of the range share."""

    def cut_up(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[] for _ in range(9)]
        col = {c: _column(batch, c).tolist() for c in NAMES}
        for t1, t2, p, n, at, ak, c, s in zip(*(col[k] for k in ("t1", "t2", "p", "n", "at", "ak", "c")), batch.column("s").to_pylist(), strict=True):
            for lo in range((at - n + 1) // step * step, at + 1, step):
                top = min(lo + step - 1, at)
                begin, count = at - top, top - max(lo, at - n + 1) + 1
                piece = s[begin : begin + count - 1 + LENGTH]
                core = s[at - lo : at - (lo + step - 1) + LENGTH]
                group = hashlib.blake2b(core, digest_size=8, key=f"{ak}:{lo}:{step}".encode()).digest()
                whole = hashlib.blake2b(piece, digest_size=8, key=f"{top}:{count}".encode()).digest()
                for o, v in zip(out, (t1, t2, p + begin, count, top, int.from_bytes(group, "big", signed=True), int.from_bytes(whole, "big", signed=True), c, piece), strict=True):
                    o.append(v)
        return _batch(out, [*KINDS, pa.binary()], [*NAMES, "s"])

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 256):
                yield cut_up(b.slice(k, 256))

    return strings.select(*NAMES, "s").mapInArrow(run, PIECE)


def grouped(rows: DataFrame, hot: int, made: list[str]) -> tuple[DataFrame, DataFrame, bool]:
    """(the pieces that occur twice or more; one row for each different piece of a group with several, `hot` where these are over the limit; whether there are hot ones). The place of a piece is that of one occurrence."""
    per = stored(rows.groupBy("ak", "sk").agg(F.sum("c").alias("c"), F.min(F.struct(*NAMES[:5])).alias("r")), made)
    many = stored(per.groupBy("ak").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), made)
    need = per.join(many, "ak").select("r.*", "ak", "sk", "c", (F.col("m") > hot).alias("hot"))
    return per.where("c > 1").select("ak", "sk"), need, bool(many.where(F.col("m") > hot).limit(1).count())


def whole_spans(rows: DataFrame, twice: DataFrame) -> DataFrame:
    return rows.join(twice, ["ak", "sk"]).select(*KEY, F.col("p").alias("start"), (F.col("p") + F.col("n") - 1 + LENGTH).alias("end"))


def removed(uniq: DataFrame, hot: int, made: list[str]) -> DataFrame:
    """t1, t2 and the list of covered byte runs (start, end) of every text with any. uniq: text, t1, t2, c (copies)."""
    old: list[str] = []
    rows = stored(bundle_rows(uniq), old)
    twice, need, any_hot = grouped(rows, hot, old)
    parts = [stored(whole_spans(rows, twice), spans := [])]
    strings = stored(bundle_strings(uniq, need), now := [])
    discard(uniq.sparkSession, old)
    parts.append(stored(spans_of_groups(strings.where("NOT hot")), spans))
    pieces = strings.where("hot")
    for step in STEPS if any_hot else ():
        # a piece of a bundle that occurs twice counts as often, but only bundles that occur once still ask
        pieces = stored(split_by_core(pieces, step), new := [])
        twice, need, any_hot = grouped(pieces, hot, old)
        parts.append(stored(whole_spans(pieces.where("c = 1"), twice), spans))
        each = stored(pieces.drop("c").join(need, [*KEY, "p", "n", "at", "ak", "sk"]).select(*NAMES, "hot", "s"), new_strings := [])
        discard(uniq.sparkSession, [*now, *old, *new])
        old, now = [], new_strings
        parts.append(stored(spans_of_groups(each.where("NOT hot")), spans))
        pieces = each.where("hot")
        if not any_hot:
            break
    every = parts[0]
    for x in parts[1:]:
        every = every.union(x)
    out = stored(every.distinct().groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans")), made)
    discard(uniq.sparkSession, [*now, *spans])
    return out


def digests(uniq: DataFrame, spans: DataFrame) -> DataFrame:
    """t1, t2, n_removed, n_spans and kept_sha256 of every text."""
    joined = uniq.join(spans, KEY, "left").select("text", *KEY, "spans")

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            raw, offsets = raw_of(batch.column("text"))
            data = memoryview(raw)
            out = []
            for i, spans in enumerate(batch.column("spans").to_pylist()):
                begin = at = int(offsets[i])
                gone, runs, end, kept = 0, 0, -1, hashlib.sha256()
                for x in spans or ():
                    a, b = begin + x["start"], begin + x["end"]
                    if a > end:
                        kept.update(data[at:a])
                        runs += 1
                        gone += b - a
                        at = end = b
                    elif b > end:
                        gone += b - end
                        at = end = b
                kept.update(data[at : int(offsets[i + 1])])
                out.append((gone, runs, kept.hexdigest()))
            return pa.RecordBatch.from_arrays([*(batch.column(k) for k in KEY), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True))], [*KEY, "n_removed", "n_spans", "kept_sha256"])

        return one

    return map_pieces(joined, make, "t1 long, t2 long, n_removed long, n_spans long, kept_sha256 string", 1 << 20)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every text."""
    spark, made, later = docs.sparkSession, [], []
    t = texts(docs, id_col=id_col, text_col=text_col).withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(7), "text"), "n_bytes": F.octet_length("text").cast("long")})
    long = t.where(F.col("n_bytes") >= LENGTH)
    uniq = bucketed(long.groupBy(*KEY).agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("c")), KEY, made)
    answers = stored(digests(uniq, removed(uniq, hot, made)), later)
    discard(spark, made)
    short = F.when(F.col("n_bytes") < LENGTH, F.sha2(F.col("text").cast("binary"), 256))
    out = t.select("doc_id", "n_bytes", *KEY, short.alias("short")).join(answers, KEY, "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("doc_id", "n_bytes", zero("n_removed"), zero("n_spans"), F.coalesce("kept_sha256", "short").alias("kept_sha256"))
