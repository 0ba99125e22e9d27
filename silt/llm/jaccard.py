"""N-gram Jaccard join (operator 2): MinHash banding, with every candidate verified on full n-gram sets.

Texts become sets of hashed five-word shingles (a text of one to four words is one shingle). Texts with equal sets are
one class; the join is between classes, so exact copies cost one row each. BANDS x ROWS minima find two sets of
similarity s with probability 1 - (1 - s ** ROWS) ** BANDS: 0.9996 at 0.8. Classes that share a band hash are a bucket;
in each bucket every two members of like size are verified against each other on their full sets, in the first bucket
that they share. A bucket of more than BLOCK_ROWS members is cut into blocks by a hash, and each two of its blocks meet
in a task of their own, so no task grows with a bucket. The work does grow with the square of a bucket, as the number of
its pairs does; but no row is made for a pair: a task returns how many links each member has, and edges that span them.

Every document gets class_id, the smallest doc_id of its connected component, and n_links, the number of other sets that
are similar to its set. Sets travel only for classes that share a bucket; hot buckets are joined by broadcast (joins.py).

Edge cases: a null or word-less text has no shingles, no link and is its own class; a null doc_id never is the smallest
unless all are null; repeated rows are copies; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silt.llm.common import as_bytes, cut, slices
from silt.llm.joins import join_unique
from silt.llm.textops import U, batches, mix, rolled, windows, words_of

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 20, 5
#: Members of a bucket's block, about, and their shingles.
BLOCK_ROWS, BLOCK_GRAMS = 512, 400_000

_A = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | U(1)
_B = mix(np.arange(1001, BANDS * ROWS + 1001, dtype=np.uint64))


def shingles(texts: list[bytes], k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(sets, first): text i has the sorted distinct shingle hashes sets[first[i]:first[i + 1]]."""
    w = words_of(texts)
    start, h = windows(w, k)
    doc = np.repeat(np.arange(len(texts)), w.count)[start]
    short = [(i, rolled(w.hash[w.first[i] : w.first[i + 1]], int(n))[0]) for i, n in enumerate(w.count) if 0 < n < k]
    if short:
        doc = np.concatenate([doc, [i for i, _ in short]]).astype(np.int64)
        h = np.concatenate([h, np.array([x for _, x in short], np.uint64)])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]) if h.size else np.empty(0, bool)
    doc, h = doc[new], h[new]
    return h, np.searchsorted(doc, np.arange(len(texts) + 1))


def _signature(texts: list[bytes]) -> list[tuple]:
    """(n_grams, set hash, band hashes) of each text."""
    out = []
    for a, b in batches(texts, 1 << 19):
        h, first = shingles(texts[a:b])
        size = np.diff(first)
        full = np.flatnonzero(size)
        at = first[full]
        if full.size:
            node = mix(np.add.reduceat(mix(h), at) + mix(size[full].astype(np.uint64)))
            bands = np.zeros((full.size, BANDS), np.uint64)
            for i in range(BANDS * ROWS):
                low = np.minimum.reduceat((h * _A[i] + _B[i]) >> U(24), at)
                bands[:, i // ROWS] = mix(bands[:, i // ROWS] * U(31) + low + U(i // ROWS + 1))
            node, bands = node.view(np.int64), bands.view(np.int64)
        k = 0
        for n in size:
            out.append((int(n), node[k], bands[k]) if n else (0, None, None))
            k += bool(n)
    return out


def _signatures(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts:
        for part in slices(batch, ["text"]):
            rows = _signature(as_bytes(part.column(2)))
            cols = list(zip(*rows)) or [(), (), ()]
            types = (pa.int32(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1)] + [pa.array(c, t) for c, t in zip(cols, types)],
                names=["doc_id", "silt_doc", "n_grams", "node", "bands"],
            )


def _packed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node and its shingles, 40 bits of each."""
    for batch in parts:
        for part in slices(batch, ["text"]):
            texts, sets = as_bytes(part.column(1)), []
            for a, b in batches(texts):
                h, first = shingles(texts[a:b])
                for i in range(b - a):
                    g = np.unique(h[first[i] : first[i + 1]] >> U(24))
                    sets.append(g.astype(np.uint32).tobytes() + (g >> U(32)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["node", "grams"])


def _unpacked(data: bytes) -> np.ndarray:
    n = len(data) // 5
    return np.frombuffer(data, np.uint32, n).astype(np.uint64) + (np.frombuffer(data, np.uint8, n, 4 * n).astype(np.uint64) << U(32))


def _links(sets: list[np.ndarray], near: np.ndarray, threshold: float) -> np.ndarray:
    """The pairs of `near` (a matrix, upper half) whose sets are similar enough, as a symmetric matrix."""
    i, j = np.nonzero(near)
    size = np.array([x.size for x in sets])
    used = np.unique(np.concatenate([i, j]))
    owner = np.repeat(used, size[used])
    _, column, count = np.unique(np.concatenate([sets[k] for k in used]), return_inverse=True, return_counts=True)
    shared = count > 1
    width, n = int(shared.sum()), len(sets)
    # Few pairs are compared one by one, many by products of the members' bit rows.
    if i.size * 5e-5 < n * n * width * 1e-10:
        both = np.array([np.intersect1d(sets[x], sets[y], assume_unique=True).size for x, y in zip(i, j)], np.int64)
    else:
        keep = shared[column]
        owner, column = owner[keep], (np.cumsum(shared) - 1)[column[keep]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        common, step = np.zeros((n, n), np.float32), 2048
        for at in range(0, width, step):
            a, b = np.searchsorted(column, [at, at + step])
            bits = np.zeros((n, step), np.float32)
            bits[owner[a:b], column[a:b] - at] = 1
            common += bits @ bits.T
        both = common[i, j].astype(np.int64)
    ok = both >= threshold * (size[i] + size[j] - both) - 1e-9
    out = np.zeros(near.shape, bool)
    out[i[ok], j[ok]] = out[j[ok], i[ok]] = True
    return out


def _spanning(linked: np.ndarray) -> Iterator[tuple[int, int]]:
    """Edges that connect what `linked` connects: each component's first member with the others."""
    left = linked.any(axis=1)
    for first in range(len(linked)):
        if left[first]:
            new = np.zeros(len(linked), bool)
            new[first] = True
            left[first] = False
            while new.any():
                new = linked[new].any(axis=0) & left
                left &= ~new
                yield from ((first, int(x)) for x in np.flatnonzero(new))


def _met(members: list[tuple], band: int, apart: bool, threshold: float) -> tuple[list, list, list]:
    """(node, centre, n_links) of a task's members (node, block, bands, grams): counts have no centre, edges no links."""
    node = [m[0] for m in members]
    size = np.array([len(m[3]) // 5 for m in members])
    least, most = np.minimum(size[:, None], size), np.maximum(size[:, None], size)
    # Sets whose sizes differ too much can't be similar enough; pairs that an earlier band has were met there.
    near = np.triu(least >= most * threshold - 1e-9, 1)
    if apart:
        block = np.array([m[1] for m in members])
        near &= block[:, None] != block
    bands = np.array([m[2] for m in members], np.int64)
    for k in range(band):
        near &= bands[:, None, k] != bands[:, k]
    if not near.any():
        return [], [], []
    wanted = near.any(axis=0) | near.any(axis=1)
    linked = _links([_unpacked(m[3]) if w else np.empty(0, U) for m, w in zip(members, wanted)], near, threshold)
    degree = linked.sum(axis=1)
    rows = [(node[i], None, int(degree[i])) for i in np.flatnonzero(degree)]
    rows += [(node[i], node[j], 0) for i, j in _spanning(linked)]
    return tuple(map(list, zip(*rows))) if rows else ([], [], [])


def _compared(threshold: float):
    """Rows (band, key, low, high, node, block, bands, grams), those of a task one after another."""
    names = ["node", "centre", "n_links"]

    def out(task, members):
        cols = _met(members, task[0], task[2] != task[3], threshold) if len(members) > 1 else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, members = None, []
        for batch in parts:
            cols = [batch.column(i).to_pylist() for i in range(8)]
            for band, key, low, high, *member in zip(*cols):
                if task != (band, key, low, high):
                    if len(members) > 1:
                        yield out(task, members)
                    task, members = (band, key, low, high), []
                members.append(member)
        if len(members) > 1:
            yield out(task, members)

    return run


def _compare(docs: DataFrame, classes: DataFrame, n_classes: int, threshold: float) -> DataFrame:
    """node, centre and n_links: how many sets are similar to a node's in parts to be added up, and edges that span them."""
    keys = classes.select("node", "n_grams", F.posexplode("bands").alias("band", "key"))
    buckets = keys.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.sum("n_grams").alias("grams")).where("rows > 1")
    buckets = cut(buckets)
    met = cut(join_unique(keys.select("node", "band", "key"), buckets, "key", "rows", n_classes * BANDS, "inner"))
    wanted = classes.join(met.select("node").distinct(), "node", "left_semi").select("silt_doc", "node", "bands")
    texts = docs.select("silt_doc", "text").join(wanted.select("silt_doc", "node"), "silt_doc").select("node", "text")
    # A class's text may stand in several rows with one doc_id: any of them gives its set.
    sets = texts.mapInArrow(_packed, "node bigint, grams binary").dropDuplicates(["node"])
    sets = sets.join(wanted.select("node", "bands"), "node")
    n_blocks = F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("grams") / BLOCK_GRAMS)).cast("int")
    met = met.withColumn("n_blocks", n_blocks).withColumn("block", F.pmod(F.xxhash64("node"), "n_blocks").cast("int"))
    met = met.select("band", "key", "node", "block", F.explode(F.expr("sequence(0, n_blocks - 1)")).alias("other"))
    task = ["band", "key", "low", "high"]
    met = met.select("band", "key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "node", "block")
    rows = met.join(sets, "node").select(*task, "node", "block", "bands", "grams")
    rows = rows.repartition(*task).sortWithinPartitions(*task)
    return cut(rows.mapInArrow(_compared(threshold), "node bigint, centre bigint, n_links bigint"))


def components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and label, the same for all nodes that links (node, centre) connect; nodes (node) without a link are left out.

    Labels are the smallest node of the component: each round takes the smallest label among neighbours, then the label
    of that label, until nothing changes.
    """
    both = links.select("node", F.col("centre").alias("other"))
    both = both.union(links.select(F.col("centre").alias("node"), F.col("node").alias("other"))).distinct()
    both = cut(both)
    n_links = both.count()
    degree = both.groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    labels = cut(degree.select("node", F.col("node").alias("label"), "n_links"))
    while n_links:
        of = labels.select(F.col("node").alias("other"), F.col("label").alias("near"), F.col("n_links").alias("rows"))
        near = join_unique(both, of, "other", "rows", n_links, "inner").groupBy("node").agg(F.min("near").alias("near"))
        new = labels.join(near, "node").select("node", "label", "n_links", F.least("label", "near").alias("next"))
        new = cut(new)
        owner = new.groupBy("next").agg(F.count(F.lit(1)).alias("rows"))
        jump = owner.join(new.select(F.col("node").alias("next"), F.col("next").alias("jump")), "next")
        jump = cut(jump)
        new = join_unique(new, jump, "next", "rows", n_links, "left")
        new = new.select("node", "n_links", F.coalesce("jump", "next").alias("next"), F.col("label").alias("was"))
        new = cut(new)
        changed = new.where("next <> was").limit(1).count()
        labels = new.select("node", F.col("next").alias("label"), "n_links")
        if not changed:
            break
    return labels


def join(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, rep_id, n_copies, n_links and n_grams for each row of docs (doc_id, text), and silt_doc.

    rep_id: the smallest doc_id with the same shingle set; n_copies: rows with that set; silt_doc: a hash of doc_id
    and text.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("doc_id", "text").alias("silt_doc"), "text")
    signed = cut(docs.mapInArrow(_signatures, "doc_id bigint, silt_doc bigint, n_grams int, node bigint, bands array<bigint>"))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "silt_doc")
    classes = cut(
        signed.where("node is not null")
        .groupBy("node")
        .agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("rows"), F.first("n_grams").alias("n_grams"),
             F.first("bands").alias("bands"))
        .select("node", "first", "first.silt_doc", "rows", "n_grams", "bands")
    )
    n_classes = classes.count()
    met = _compare(docs, classes, n_classes, threshold)
    labels = components(met.where("centre is not null").select("node", "centre"), classes.select("node"))
    counts = met.where("centre is null").groupBy("node").agg(F.sum("n_links").alias("n_links"))
    labels = labels.select("node", "label").join(counts, "node")
    labelled = classes.select("node", "first", "rows").join(labels, "node", "left")
    label = F.coalesce("label", "node")
    labelled = cut(labelled.select("node", "first", "rows", F.coalesce("n_links", F.lit(0)).alias("n_links"), label.alias("label")))
    heads = labelled.groupBy("label").agg(F.min("first").alias("head"), F.count(F.lit(1)).alias("members"))
    members = join_unique(labelled, cut(heads), "label", "members", n_classes, "left")
    members = cut(members.select(
        "node", "rows", F.col("head.doc_id").alias("class_id"), F.col("first.doc_id").alias("rep_id"), "n_links",
        F.col("head.silt_doc").alias("head_doc")))
    out = join_unique(signed.select("doc_id", "silt_doc", "n_grams", "node"), members, "node", "rows", signed.count(), "left")
    return out.select(
        "doc_id",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("rep_id")).alias("rep_id"),
        F.coalesce("rows", F.lit(1)).alias("n_copies"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.col("n_grams").cast("bigint").alias("n_grams"),
        "silt_doc",
        F.coalesce("head_doc", "silt_doc").alias("head_doc"),
    )


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one document of each class, its head: the one with the smallest doc_id (one row of repeated rows)."""
    heads = join(docs, threshold).where("silt_doc = head_doc").select(F.col("silt_doc").alias("silt_head")).distinct()
    rows = docs.withColumn("silt_head", F.xxhash64(F.col("doc_id").cast("bigint"), "text")).join(heads, "silt_head", "left_semi")
    return rows.dropDuplicates(["silt_head"]).drop("silt_head")
