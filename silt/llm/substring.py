"""Substring dedup (operator 7): level-wise doubling over word windows.

Windows of half the target length are looked for in the whole corpus first; only where those at both ends repeat is the
window of twice the length (less the overlap that an odd target needs) extended and asked about; so on with twice the
length until no candidates survive, or up to the target alone. The level below the target only sorts out candidates, by
32 hash bits within a bucket; the target's windows are compared by 64-bit hashes and the smallest doc_id that has them.
See blocks.py for how the corpus is asked; a window that a third of the documents have costs one entry a block.

A word goes if a window that covers it also starts in a document with a smaller doc_id. Windows are judged on the
input. Edge cases: a null or word-less text has no words and keeps none; a text shorter than a window is kept whole; a
null doc_id counts as larger than all others; rows with equal doc_ids don't remove each other's words (none is
smaller); other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import itertools
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silt.llm import blocks as bl
from silt.llm.common import cut
from silt.llm.textops import batches, covered, per_doc, rolled, words_of

WINDOW = 13

OUT = "doc_id bigint, n_words bigint, n_removed bigint, longest int, text string"


def lengths(target: int, longest: int | None = None) -> list[int]:
    """Window lengths of the levels: half the target, the target, and its doubles up to `longest`."""
    out = [-(-target // 2), target] if target > 1 else [1]
    while longest and out[-1] * 2 <= longest:
        out.append(out[-1] * 2)
    return out


class _Level:
    """Candidates of one level in a block: first words, their distinct hashes and each one's place among those."""

    def __init__(self, start: np.ndarray, h: np.ndarray, doc: np.ndarray) -> None:
        self.start = start
        self.distinct, first, self.place = np.unique(h, return_index=True, return_inverse=True)
        self.doc = doc[start]
        self.first_doc = self.doc[first]  # the smallest: windows come in order of documents


def _levels(block: bl.Block, replies: pa.Table | None, of: list[int], target: int, buckets: int):
    """Words of the block, and its levels as far as replies go, each with the verdicts on its candidates but the last."""
    parts = [words_of(block.texts[a:b]) for a, b in batches(block.texts)]
    h = np.concatenate([p.hash for p in parts]) if parts else np.empty(0, np.uint64)
    count = np.concatenate([p.count for p in parts]) if parts else np.empty(0, np.int64)
    first = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(count.size), count)
    left = np.repeat(first[1:], count) - np.arange(h.size)  # words from here to the text's end
    known = 0 if replies is None or not replies.num_rows else 1 + max(replies["level"].to_pylist())
    levels, verdicts, good, before = [], [], None, 0
    for n, width in enumerate(of[: known + 1]):
        roll = rolled(h, width)
        may = (left >= width)[: roll.size] & (np.repeat(count, count)[: roll.size] >= target)
        if good is not None:
            may &= good[: roll.size] & good[width - before :][: roll.size]
        start = np.flatnonzero(may)
        level = _Level(start, roll[start], doc)
        levels.append(level)
        if n < known:
            said = bl.answers(replies, n, level.distinct, buckets, 1 if width < target else 2)
            elsewhere = said if width < target else said[1]
            # Repeated in another block, or in two documents of this one: the first holder goes on too.
            last = np.zeros(level.distinct.size, np.int64)
            np.maximum.at(last, level.place, level.doc)
            repeated = (elsewhere | (last != level.first_doc))[level.place]
            if width < target:
                verdicts.append(None)
            else:
                order = block.order
                verdicts.append(said[0][level.place] | (order[level.doc] > order[level.first_doc][level.place]))
            good, before = np.zeros(h.size, bool), width
            good[start[repeated]] = True
    return count, first, levels, verdicts


def _ask(of: list[int], target: int, buckets: int, level: int, docs: pa.Table, replies: pa.Table | None = None) -> pa.Table:
    block = bl.Block(docs)
    _, _, levels, _ = _levels(block, replies, of, target, buckets)
    if len(levels) <= level:
        return bl.asked(block.number, level, buckets, np.empty(0, np.uint64), lambda a, b: b"")
    at = levels[level]
    if of[level] < target:
        low = at.distinct.astype(np.uint32)
        return bl.asked(block.number, level, buckets, at.distinct, lambda a, b: low[a:b].tobytes())
    both = np.stack([at.distinct.view(np.int64), block.order[at.first_doc]])
    return bl.asked(block.number, level, buckets, at.distinct, lambda a, b: both[:, a:b].tobytes())


def _remove(of: list[int], target: int, buckets: int, docs: pa.Table, replies: pa.Table) -> pa.Table:
    block = bl.Block(docs)
    count, first, levels, verdicts = _levels(block, replies, of, target, buckets)
    gone, longest = np.zeros(int(first[-1]), bool), np.zeros(count.size, np.int64)
    for width, level, met in zip(of, levels, verdicts):
        if met is not None:
            longest[level.doc[met]] = width
            if width == target:
                gone = covered(gone.size, level.start[met], width)
    removed = per_doc(first, gone)
    texts = []
    for i, text in enumerate(block.texts):
        words = text.split()
        if removed[i]:
            words = itertools.compress(words, ~gone[first[i] : first[i + 1]])
        texts.append(b" ".join(words))
    return pa.table(
        {
            "doc_id": pa.array(block.ids, pa.int64()),
            "n_words": pa.array(count, pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "longest": pa.array(longest, pa.int32()),
            "text": pa.array(texts, pa.binary()).cast(pa.string()),
        }
    )


def _decide(width_is_target: bool, table: pa.Table) -> pa.Table:
    return bl.answer(table, bl.earlier_elsewhere if width_is_target else bl.repeated_in_blocks)


def dedup_substrings(docs: DataFrame, target: int = WINDOW, longest: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, longest and text (kept words, one space between) for each row of docs (doc_id, text).

    longest: the length of the longest level with a window of the document that an earlier one has, 0 if none. Without
    the parameter of that name the levels end at the target; with it they double on, up to that length or until no
    candidates survive.
    """
    base, buckets = bl.deal(docs)
    of, replies = lengths(target, longest), None
    for level, width in enumerate(of):
        ask = partial(_ask, of, target, buckets, level)
        if replies is None:
            questions = base.groupBy("block").applyInArrow(bl.one(ask), bl.ASK)
        else:
            questions = base.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(bl.two(ask), bl.ASK)
        if width > target:  # a level of its own job, to see whether any candidate survives
            questions = cut(questions)
            if questions.isEmpty():
                of = of[:level]
                break
        said = questions.groupBy("bucket").applyInArrow(bl.one(partial(_decide, width >= target)), bl.ASK)
        replies = said if replies is None else replies.unionByName(said)
    remove = partial(_remove, of, target, buckets)
    return base.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(bl.two(remove), OUT)
