"""Suffix-array dedup (operator 10): longest-previous-factor arrays over the places where the corpus repeats itself.

Texts are UTF-8 bytes. A byte goes if a string of LENGTH bytes that covers it also starts earlier: in a document with a
smaller doc_id, or before in the same one. Strings are judged on the input.

Each string of LENGTH bytes picks the anchor in it: of its GRAM-byte grams, the one with the least hash. Equal strings
pick equal anchors at the same place, so only strings with one anchor can be equal. Runs of strings with one anchor are
what the corpus is asked about (blocks.py): a run whose anchor no other run has is kept as it is; runs that are equal
as a whole leave the earliest of them; if an anchor has different runs, one of each kind sends its bytes to the
anchor's bucket. There the suffixes that start those strings are sorted, to LENGTH bytes, with their longest common
prefixes; for each suffix, the nearest suffixes in that order that start earlier (previous and next smaller values of
the position) give the longest previous factor, and LENGTH or more marks a later copy. Exact copies thus never reach a
suffix array, nor does text that repeats nowhere, and a block sends each kind of run once however many copies it has.

A gram in a line that very many documents have would anchor as many kinds of runs, one for each surrounding. Such grams
are counted first; they are anchors only of strings that hold no other gram, which lie within the common text and are
alike. The grams are at most four a bucket, so every worker can have them.

Edge cases: a null or empty text has no bytes and no spans; a text shorter than LENGTH is kept whole; doc_ids lie below
2 ** 62, null ones come after all others in order of a hash of their text; rows with equal doc_id count as one document
whose texts come one after the other, in byte order; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silt.llm import blocks as bl
from silt.llm.common import as_bytes, cut, slices
from silt.llm.textops import BYTE_KEY, U, batches, mix, rolled

LENGTH = 100
GRAM = 36
#: Suffixes that one suffix array holds, about; an anchor's strings are never parted.
SUFFIXES = 100_000
#: Strings of a long text that are looked at in one go; below 2 ** 28, the width of a place.
SEGMENT = 1 << 22
#: Kinds of runs up to which an anchor isn't common whatever its share.
COMMON = 200

OUT = "doc_id bigint, n_bytes bigint, n_removed bigint, spans array<struct<start: bigint, end: bigint>>, kept binary"

_STEP = U(0x9E3779B97F4A7C15)
_BACK = U(pow(int(_STEP), -1, 1 << 64))
_PLACE, _LOW = U((1 << 28) - 1), U((1 << 16) - 1)
_up = _down = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _up, _down
    if _up.size <= n:
        _up = np.multiply.accumulate(np.concatenate([[U(1)], np.full(n + (n >> 2), _STEP)]))
        _down = np.multiply.accumulate(np.concatenate([[U(1)], np.full(n + (n >> 2), _BACK)]))
    return _up, _down


class Runs:
    """Runs of strings with one anchor in consecutive texts, in order: text, first and last start, anchor, hashes."""

    def __init__(self, texts: list[bytes], length: int, gram: int, common: np.ndarray) -> None:
        parts: list[list[np.ndarray]] = []
        maybe = np.zeros(1 << 16, bool)
        maybe[(common & _LOW).astype(np.int64)] = True
        for a, b in batches(texts, 1 << 18):
            if b - a > 1 or len(texts[a]) <= SEGMENT:
                parts.append(self._of(texts[a:b], a, length, gram, common, maybe))
                continue
            # A long text piece by piece: a run over a cut becomes two, whose strings are judged alike.
            for at in range(0, len(texts[a]) - length + 1, SEGMENT):
                part = self._of([texts[a][at : at + SEGMENT + length - 1]], a, length, gram, common, maybe)
                parts.append([part[0], part[1] + at, part[2] + at, part[3] + at, *part[4:]])
        cols = [np.concatenate(c) for c in zip(*parts)] if parts else [np.empty(0, np.int64)] * 4 + [np.empty(0, np.uint64)] * 2
        self.doc, self.first, self.last, self.anchor, self.plain, self.whole = cols
        # Anchors have small hashes, being the least of their strings: mixed again, they spread over all buckets.
        self.gram = mix(self.plain + U(1))

    @staticmethod
    def _of(texts: list[bytes], base: int, length: int, gram: int, common: np.ndarray, maybe: np.ndarray) -> list[np.ndarray]:
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        end = np.cumsum(sizes)
        n, width = int(end[-1]) - length + 1, length - gram + 1
        empty = [np.empty(0, np.int64)] * 4 + [np.empty(0, np.uint64)] * 2
        if n <= 0:
            return empty
        value = BYTE_KEY[np.frombuffer(b"".join(texts), np.uint8)]
        h = rolled(value, gram)
        rank = h >> U(1)
        if common.size:
            at = np.flatnonzero(maybe[(h & _LOW).astype(np.int64)])
            rank[at[np.isin(h[at], common)]] |= U(1 << 63)
        low = (rank & ~_PLACE) | np.arange(h.size, dtype=np.uint64)
        span = 1
        while span * 2 <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < width:
            low = np.minimum(low[: n], low[width - span :][: n])
        anchor = (low[:n] & _PLACE).astype(np.int64)
        doc = np.repeat(np.arange(sizes.size), sizes)[:n]
        valid = np.arange(n) <= end[doc] - length
        at = np.flatnonzero(valid)
        if not at.size:
            return empty
        new = np.concatenate([[True], (np.diff(at) > 1) | (np.diff(anchor[at]) != 0) | (np.diff(doc[at]) != 0)])
        first = at[new]
        last = at[np.append(np.flatnonzero(new)[1:], at.size) - 1]
        up, down = _powers(value.size)
        total = np.concatenate([[U(0)], np.cumsum(value * up[: value.size], dtype=np.uint64)])
        whole = (total[last + length] - total[first]) * down[first]
        p = anchor[first]
        whole = mix(whole ^ mix(((last - first) * 256 + (p - first)).astype(np.uint64)))
        d, start = doc[first], (end - sizes)[doc[first]]
        return [d + base, first - start, last - start, p - start, h[p], whole]


class _Kinds:
    """The distinct runs of a block, sorted by anchor; which run is the first of each kind, and each run's kind."""

    def __init__(self, runs: Runs) -> None:
        _, first, place = np.unique(runs.whole, return_index=True, return_inverse=True)
        order = np.lexsort((first, runs.gram[first]))
        self.first = first[order]
        at = np.empty(order.size, np.int64)
        at[order] = np.arange(order.size)
        self.of = at[place]
        self.gram = runs.gram[self.first]


_KIND = np.dtype([("gram", "<u4"), ("whole", "<u8"), ("order", "<i8")])
_SEGMENT = np.dtype([("gram", "<u4"), ("order", "<i8"), ("row", "<u4"), ("start", "<u8"), ("n", "<u2")])


def _many(length: int, gram: int, share: int, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kinds of runs by anchor for each slice: anchors with more than 1/share of the slice's, and all kinds as anchor null."""
    for batch in parts:
        for part in slices(batch, ["text"]):
            runs = Runs(as_bytes(part.column(0)), length, gram, np.empty(0, np.uint64))
            _, first = np.unique(runs.whole, return_index=True)
            anchor, n = np.unique(runs.plain[first], return_counts=True)
            much = n > max(2, first.size // share)
            yield pa.RecordBatch.from_arrays(
                [pa.array([None, *anchor[much].view(np.int64).tolist()], pa.int64()), pa.array([first.size, *n[much].tolist()], pa.int64())],
                names=["anchor", "n"],
            )


def common_anchors(docs: DataFrame, length: int, gram: int, share: int) -> np.ndarray:
    """Hashes of grams that anchor about 1/share or more of all kinds of runs: 2 * share of them at most.

    A gram with 2/share of all has 1/share of some slices, which hold half of its runs or more, so it is among them.
    """
    found = docs.select("text").mapInArrow(partial(_many, length, gram, share), "anchor bigint, n bigint")
    found = cut(found.groupBy("anchor").agg(F.sum("n").alias("n")))
    total = found.where("anchor is null").agg(F.max("n")).first()[0] or 0
    rows = found.where(F.col("anchor").isNotNull() & (F.col("n") > max(COMMON, total // (2 * share)))).select("anchor").collect()
    return np.sort(np.array([r["anchor"] for r in rows], np.int64).view(np.uint64))


def _ask_kinds(length: int, gram: int, common: np.ndarray, buckets: int, docs: pa.Table) -> pa.Table:
    block = bl.Block(docs)
    runs = Runs(block.texts, length, gram, common)
    kinds = _Kinds(runs)
    data = np.empty(kinds.first.size, _KIND)
    data["gram"], data["whole"] = kinds.gram.astype(np.uint32), runs.whole[kinds.first]
    data["order"] = block.order[runs.doc[kinds.first]]
    return bl.asked(block.number, 0, buckets, kinds.gram, lambda a, b: data[a:b].tobytes())


def _judge_kinds(data: list[bytes]) -> list[np.ndarray]:
    """Two bits for each run: an equal one is earlier elsewhere; it is the earliest of its kind and its anchor has others."""
    parts = [np.frombuffer(x, _KIND) for x in data]
    x = np.concatenate(parts)
    order = np.lexsort((x["order"], x["whole"], x["gram"]))
    g, w = x["gram"][order], x["whole"][order]
    new_gram = np.concatenate([[True], g[1:] != g[:-1]])
    new_kind = new_gram | np.concatenate([[True], w[1:] != w[:-1]])
    kinds = np.add.reduceat(new_kind.astype(np.int64), np.flatnonzero(new_gram))
    bits = np.zeros((2, x.size), bool)
    bits[0, order] = ~new_kind
    bits[1, order] = new_kind & (kinds[np.cumsum(new_gram) - 1] > 1)
    return np.split(bits, np.cumsum([p.size for p in parts])[:-1], axis=1)


def _ask_segments(length: int, gram: int, common: np.ndarray, buckets: int, docs: pa.Table, replies: pa.Table) -> pa.Table:
    block = bl.Block(docs)
    runs = Runs(block.texts, length, gram, common)
    kinds = _Kinds(runs)
    _, unlike = bl.answers(replies, 0, kinds.gram, buckets, 2)
    run = kinds.first[unlike]
    head = np.empty(run.size, _SEGMENT)
    head["gram"], head["order"] = runs.gram[run].astype(np.uint32), block.order[runs.doc[run]]
    head["row"], head["start"], head["n"] = runs.doc[run], runs.first[run], runs.last[run] - runs.first[run] + 1
    texts = [block.texts[d][a : b + length] for d, a, b in zip(runs.doc[run], runs.first[run], runs.last[run])]

    def pack(a: int, b: int) -> bytes:
        return struct.pack("<q", b - a) + head[a:b].tobytes() + b"".join(texts[a:b])

    return bl.asked(block.number, 1, buckets, kinds.gram[unlike], pack)


def suffix_order(buf: np.ndarray, start: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at start in the order of their first `depth` bytes (ties as given), and common prefixes.

    lcp[k] is the length of the common prefix of the k-th and the one before it, depth at most; lcp[0] is 0. Eight bytes
    are compared a round, and only suffixes that are still tied go to the next.
    """
    words = np.zeros(buf.size + depth + 8, np.uint8)
    words[: buf.size] = buf
    word = np.zeros(buf.size + depth, np.uint64)
    for i in range(8):
        word |= words[i : i + word.size].astype(np.uint64) << U(56 - 8 * i)
    n = start.size
    order, lcp = np.arange(n), np.zeros(n, np.int64)
    if not n:
        return order, lcp
    tied = np.arange(n)  # places in the order that are still open
    group = np.zeros(n, np.int64)
    for at in range(0, depth, 8):
        key = word[start[order[tied]] + at]
        if depth - at < 8:
            key &= ~U((1 << 8 * (8 - depth + at)) - 1)
        by = np.lexsort((key, group))
        order[tied] = order[tied][by]
        key, group = key[by], group[by]
        differ = key[1:] ^ key[:-1]
        inside = group[1:] == group[:-1]
        apart = inside & (differ != 0)
        high = differ[apart]
        lcp[tied[1:][apart]] = at + sum((high < U(1 << 64 - 8 * i)).astype(np.int64) for i in range(1, 8))
        joined = inside & (differ == 0)
        lcp[tied[1:][joined]] = min(depth, at + 8)
        keep = np.concatenate([[False], joined]) | np.concatenate([joined, [False]])
        group = np.cumsum(np.concatenate([[True], ~joined]))[keep]
        tied = tied[keep]
        if not tied.size:
            break
    return order, lcp


def _smaller_before(pos: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each place k of a suffix order: the common prefix with the nearest place before it that has a smaller pos.

    All places step back together, over what is known to be larger, and take the least prefix on the way along.
    """
    n = pos.size
    to, least = np.arange(-1, n - 1), lcp.copy()
    going = np.arange(n)
    while True:
        going = going[to[going] >= 0]
        going = going[pos[to[going]] > pos[going]]
        if not going.size:
            break
        via = to[going]
        least[going] = np.minimum(least[going], least[via])
        to[going] = to[via]
    return np.where(to >= 0, least, 0)


def longest_previous(order: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """LPF array: for each suffix i, the longest common prefix with a suffix j < i (as far as lcp is known)."""
    before = _smaller_before(order, lcp)
    after = _smaller_before(order[::-1], np.concatenate([[0], lcp[1:][::-1]]) if lcp.size else lcp)[::-1]
    out = np.zeros(order.size, np.int64)
    out[order] = np.maximum(before, after)
    return out


def _judge_segments(length: int, data: list[bytes]) -> list[np.ndarray]:
    """A bit for each string of each segment: whether it starts earlier too."""
    heads, texts = [], []
    for x in data:
        (n,) = struct.unpack_from("<q", x)
        heads.append(np.frombuffer(x, _SEGMENT, n, 8))
        texts.append(np.frombuffer(x, np.uint8, offset=8 + n * _SEGMENT.itemsize))
    head = np.concatenate(heads)
    buf = np.concatenate(texts)
    count = head["n"].astype(np.int64)
    size = count + length - 1
    at = np.cumsum(size) - size
    out_at = np.cumsum(count) - count
    bits = np.zeros(int(count.sum()), bool)
    # In order of anchor, then of the corpus; a suffix array takes whole anchors.
    ranked = np.lexsort((head["start"], head["row"], head["order"], head["gram"]))
    gram = head["gram"][ranked]
    ends = np.append(np.flatnonzero(gram[1:] != gram[:-1]) + 1, gram.size)
    totals = np.cumsum(count[ranked])[ends - 1]
    i = 0
    while i < ends.size:
        j = max(i + 1, int(np.searchsorted(totals, (totals[i - 1] if i else 0) + SUFFIXES, "right")))
        part = ranked[ends[i - 1] if i else 0 : ends[j - 1]]
        n, bytes_ = count[part], size[part]
        to = np.cumsum(bytes_) - bytes_
        own = buf[np.arange(int(bytes_.sum())) + np.repeat(at[part] - to, bytes_)]
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        order, lcp = suffix_order(own, np.repeat(to, n) + within, length)
        bits[np.repeat(out_at[part], n) + within] = longest_previous(order, lcp) >= length
        i = j
    return np.split(bits, np.cumsum([int(h["n"].sum()) for h in heads])[:-1])


def _remove(length: int, gram: int, common: np.ndarray, buckets: int, docs: pa.Table, replies: pa.Table) -> pa.Table:
    block = bl.Block(docs)
    runs = Runs(block.texts, length, gram, common)
    kinds = _Kinds(runs)
    later, unlike = bl.answers(replies, 0, kinds.gram, buckets, 2)
    gone = later[kinds.of]
    whole = np.ones(kinds.of.size, bool)
    whole[kinds.first] = False
    gone |= whole  # all but the first run of a kind in this block
    doc, first, last = [runs.doc[gone]], [runs.first[gone]], [runs.last[gone]]
    # Strings of the runs that went to a suffix array, in the order sent.
    run = kinds.first[unlike]
    if run.size:
        n = runs.last[run] - runs.first[run] + 1
        cuts = np.searchsorted(bl.bucket_of(kinds.gram[unlike], buckets), np.arange(buckets + 1))
        ends = np.concatenate([[0], np.cumsum(n)])
        bits = np.zeros(int(ends[-1]), bool)
        for b, level, data in zip(*(replies[c].to_pylist() for c in ("bucket", "level", "data"))):
            if level == 1:
                i, j = ends[cuts[b]], ends[cuts[b + 1]]
                bits[i:j] = np.unpackbits(np.frombuffer(data, np.uint8), count=int(j - i))
        start = (np.repeat(runs.first[run] - ends[:-1], n) + np.arange(bits.size))[bits]
        doc.append(np.repeat(runs.doc[run], n)[bits])
        first.append(start)
        last.append(start)
    doc, first, last = map(np.concatenate, (doc, first, last))
    order = np.lexsort((first, doc))
    doc, first, last = doc[order], first[order], last[order]
    cuts = np.searchsorted(doc, np.arange(len(block.texts) + 1))
    rows = []
    for i, text in enumerate(block.texts):
        a, b = cuts[i], cuts[i + 1]
        if a == b:
            rows.append((block.ids[i], len(text), 0, [], text))
            continue
        start, end = first[a:b], np.maximum.accumulate(last[a:b] + length)
        new = np.concatenate([[True], start[1:] > end[:-1]])
        starts = start[new]
        stops = end[np.append(np.flatnonzero(new)[1:], end.size) - 1]
        kept, at = [], 0
        for x, y in zip(starts.tolist(), stops.tolist()):
            kept.append(text[at:x])
            at = y
        kept.append(text[at:])
        spans = [{"start": x, "end": y} for x, y in zip(starts.tolist(), stops.tolist())]
        rows.append((block.ids[i], len(text), int((stops - starts).sum()), spans, b"".join(kept)))
    types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
    cols = list(zip(*rows)) or [()] * 5
    names = ["doc_id", "n_bytes", "n_removed", "spans", "kept"]
    return pa.table({n: pa.array(c, t) for n, c, t in zip(names, cols, types)})


def dedup_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (removed, maximal) and kept (bytes) for each row of docs (doc_id, text)."""
    base, buckets = bl.deal(docs)
    common = common_anchors(docs, length, gram, 2 * buckets)
    known = (length, gram, common, buckets)
    kinds = base.groupBy("block").applyInArrow(bl.one(partial(_ask_kinds, *known)), bl.ASK)
    judged = kinds.groupBy("bucket").applyInArrow(bl.one(partial(bl.answer, decide=_judge_kinds)), bl.ASK)
    segments = base.groupBy("block").cogroup(judged.groupBy("block")).applyInArrow(bl.two(partial(_ask_segments, *known)), bl.ASK)
    decide = partial(_judge_segments, length)
    found = segments.groupBy("bucket").applyInArrow(bl.one(partial(bl.answer, decide=decide)), bl.ASK)
    replies = judged.unionByName(found)
    return base.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(bl.two(partial(_remove, *known)), OUT)
