"""Questions to the whole corpus, asked and answered in packed arrays.

Documents are dealt into blocks of bounded size by a hash. A block asks about its distinct hashes: for each bucket (a
range of hash values) it sends one row with a packed, sorted array, so rows between blocks and buckets number as many
as both multiplied; see deal() for how these grow. A bucket sees the arrays of all blocks and answers
each with as many bits, in the order asked. Blocks then get their documents and the answers together. A hash that a
third of the corpus has costs one entry a block, so no bucket is hot; a bucket holds about 1/buckets of the entries.

Blocks sort their documents before they ask, so a block that is computed again (an executor was lost) asks the same in
the same order. The shuffle that deals documents into blocks is written once and read by every pass.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from silt.llm.common import text_bytes
from silt.llm.textops import U

LAST = (1 << 63) - 1
#: Text bytes of a block: their square is GROWTH times the corpus, between the least and a share of an executor's memory.
LEAST_BLOCK, GROWTH = 1 << 20, 22_500
#: A block's share of the memory that an executor has for each core; a worker holds a hundred bytes or so a word.
MEMORY_SHARE, MOST_BLOCK = 56, 8 << 20
#: Blocks that a bucket is as large as.
BUCKET_BLOCKS = 2
#: Blocks of a small input, at least.
LEAST_BLOCKS = 4

ASK = "bucket int, block int, level int, data binary"


def block_bytes(corpus: int, most: int = MOST_BLOCK) -> int:
    return int(min(most, max(LEAST_BLOCK, (corpus * GROWTH) ** 0.5)))


def most_block(spark: SparkSession) -> int:
    """The largest block that a worker should hold."""
    sc = spark.sparkContext._jsc.sc()
    cores = int(spark.conf.get("spark.executor.cores", "4"))
    return max(MOST_BLOCK, (sc.executorMemory() << 20) // cores // MEMORY_SHARE)


def deal(docs: DataFrame) -> tuple[DataFrame, int]:
    """docs (doc_id, text) with their block, and the number of buckets to ask.

    Both numbers come from the text's bytes, not from files, partitions or layout. While blocks grow with the square root
    of the corpus, so do the numbers of blocks and of buckets, and the rows between them grow as the corpus does.
    """
    corpus = text_bytes(docs)
    size = block_bytes(corpus, most_block(docs.sparkSession))
    n, buckets = (max(LEAST_BLOCKS, -(-corpus // x)) for x in (size, BUCKET_BLOCKS * size))
    return docs.select(block_of(n).alias("block"), F.col("doc_id").cast("bigint").alias("doc_id"), "text"), buckets


def block_of(n: int) -> Column:
    """The block of a document among n, by a hash of its doc_id, or of its text where that is null."""
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("bigint"), F.xxhash64("text")))
    return F.pmod(key, F.lit(n)).cast("int")


def one(fn: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """fn, which may be a partial, with the type hints that applyInArrow looks for."""

    def run(table: pa.Table) -> pa.Table:
        return fn(table)

    return run


def two(fn: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The same for cogrouped tables."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return fn(left, right)

    return run


class Block:
    """The documents of a block in order of doc_id (null last), then text."""

    def __init__(self, table: pa.Table) -> None:
        ids = table["doc_id"].to_pylist()
        texts = [x or b"" for x in table["text"].cast(pa.binary()).to_pylist()]
        rank = sorted(range(len(ids)), key=lambda i: (LAST if ids[i] is None else ids[i], texts[i]))
        self.ids = [ids[i] for i in rank]
        self.texts = [texts[i] for i in rank]
        self.order = np.array([LAST if i is None else i for i in self.ids], np.int64)
        self.number = table["block"][0].as_py() if len(ids) else 0


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each hash: ranges of equal width, so sorted hashes come bucket by bucket."""
    return ((h >> U(32)) * U(buckets) >> U(32)).astype(np.int64)


def asked(number: int, level: int, buckets: int, h: np.ndarray, pack: Callable[[int, int], bytes]) -> pa.Table:
    """The rows by which a block asks about its sorted hashes h; pack(a, b) gives the bytes of h[a:b]."""
    cuts = np.searchsorted(bucket_of(h, buckets), np.arange(buckets + 1))
    full = [b for b in range(buckets) if cuts[b + 1] > cuts[b]]
    return pa.table(
        {
            "bucket": pa.array(full, pa.int32()),
            "block": pa.array([number] * len(full), pa.int32()),
            "level": pa.array([level] * len(full), pa.int32()),
            "data": pa.array([pack(cuts[b], cuts[b + 1]) for b in full], pa.binary()),
        }
    )


def answers(table: pa.Table, level: int, h: np.ndarray, buckets: int, width: int = 1) -> np.ndarray:
    """Bits answered to a block's sorted hashes h at a level: an array of bool, (width, len(h)) if width > 1."""
    cuts = np.searchsorted(bucket_of(h, buckets), np.arange(buckets + 1))
    out = np.zeros((width, h.size), bool)
    for b, at, data in zip(*(table[c].to_pylist() for c in ("bucket", "level", "data"))):
        if at == level:
            n = cuts[b + 1] - cuts[b]
            bits = np.unpackbits(np.frombuffer(data, np.uint8).reshape(width, -1), axis=1, count=n)
            out[:, cuts[b] : cuts[b + 1]] = bits
    return out if width > 1 else out[0]


def answer(table: pa.Table, decide: Callable[[list[bytes]], list[np.ndarray]]) -> pa.Table:
    """What a bucket replies: decide gets the blocks' arrays, ordered by block, and gives their bits."""
    table = table.sort_by("block")
    bits = decide(table["data"].to_pylist())
    return table.select(["bucket", "block", "level"]).append_column(
        "data", pa.array([np.packbits(x, axis=-1).tobytes() for x in bits], pa.binary())
    )


def repeated_in_blocks(data: list[bytes]) -> list[np.ndarray]:
    """For arrays of uint32, each of distinct hashes: whether another array has the value too."""
    parts = [np.frombuffer(x, np.uint32) for x in data]
    whole = np.concatenate(parts)
    order = np.argsort(whole, kind="stable")
    same = whole[order][1:] == whole[order][:-1]
    flag = np.zeros(whole.size, bool)
    flag[order[1:][same]] = True
    flag[order[:-1][same]] = True
    return np.split(flag, np.cumsum([p.size for p in parts])[:-1])


def earlier_elsewhere(data: list[bytes]) -> list[np.ndarray]:
    """For arrays of (hash, order) as int64 halves, two bits: another array has the hash with a smaller order; at all."""
    parts = [np.frombuffer(x, np.int64).reshape(2, -1) for x in data]
    whole = np.concatenate(parts, axis=1)
    order = np.lexsort((whole[1], whole[0]))
    h, at = whole[0][order], whole[1][order]
    start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    many = np.diff(np.append(start, h.size))
    flag = np.empty((2, h.size), bool)
    flag[0, order] = np.repeat(at[start], many) < at
    flag[1, order] = np.repeat(many, many) > 1
    return np.split(flag, np.cumsum([p.shape[1] for p in parts])[:-1], axis=1)
