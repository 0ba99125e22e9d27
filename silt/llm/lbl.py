"""LM scoring (operator 8): a log-bilinear neural model, trained in numpy with noise-contrastive estimation.

Tokens are the words, A-Z lower-cased, and one end of text. All training tokens are counted, exactly, in buckets of the
word hash. The model predicts a class from the two classes before it: the `frequent` most frequent words and the end are
classes of their own, all other words fall into RARE classes by their last two bytes, known or not. A context is
q = c1 * R[before] + c2 * R[two before]; the class scores are q . T[class] + b[class]. Training texts are dealt into pieces
by a hash of the doc_id and pieces into rounds, more of them the larger the corpus (see rounds_of). In a round, each of
its pieces trains the model of the round before over all its tokens, on the difference between a token's class and noise
from the unigram of classes; the pieces' models and step sizes are averaged, weighted by tokens, in a reduction tree.
Scores are normalised over all classes by batched matrix products, and over the words of a rare class by their counts:
(c + 1) / (n + v + 1) for a word counted c times in a class of n tokens and v words, the one more standing for all
unknown words. So probabilities over known words, end and unknown words sum to one.

Pieces, rounds, random draws and the order of sums follow from the texts and doc_ids alone, so scores are the same
however the table is split into files, partitions or batches. The vocabulary (`frequent` words) and the model are of
fixed size; counts, training and scores cover the whole corpus, and no statistics of it are gathered on the driver
beyond that vocabulary and the model.

Edge cases: a null or empty text is its end alone; a null doc_id counts as the empty text in the fold, so it trains;
repeated rows train as often as they stand and score alike; without a training document all words are unknown and the
model is its start, a uniform one; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silt.llm import blocks as bl
from silt.llm.common import as_bytes, cut, slices, text_bytes
from silt.llm.textops import U, Words, batches, mix, words_of

FREQUENT, RARE = 383, 128
DIM = 16
BATCH, NOISE, RATE = 1024, 64, 0.15
FOLDS, HELD_OUT = 7, 2
FAN = 16
#: Text bytes of a piece that is trained on in one go.
PIECE_BYTES = 2 << 20

OUT = (
    "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
)
_COUNT = np.dtype([("hash", "<u8"), ("count", "<i8"), ("rare", "u1")])


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def _rare(w: Words) -> np.ndarray:
    """The rare class of each word, by its last two bytes."""
    last = w.buf[w.end - 1].astype(np.uint64)
    before = np.where(w.end - w.start > 1, w.buf[np.maximum(w.end - 2, 0)], 0).astype(np.uint64)
    return (mix(last * U(256) + before) % U(RARE)).astype(np.uint8)


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and rare class of all words, and words of each text."""
    parts = [words_of([t.lower() for t in texts[a:b]]) for a, b in batches(texts)]
    none = np.empty(0, np.int64)
    cat = lambda x, kind: np.concatenate(x) if x else none.astype(kind)
    return (
        cat([p.hash for p in parts], np.uint64),
        cat([_rare(p) for p in parts], np.uint8),
        cat([p.count for p in parts], np.int64),
    )


# Counts.


def _counted(buckets: int, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed counts of the training words of each slice, by bucket."""
    for batch in parts:
        for part in slices(batch, ["text"]):
            ids, texts = part.column(0).to_pylist(), as_bytes(part.column(1))
            texts = [t for i, t in zip(ids, texts) if not held_out(i)]
            h, rare, _ = _words(texts)
            distinct, first, count = np.unique(h, return_index=True, return_counts=True)
            data = np.empty(distinct.size, _COUNT)
            data["hash"], data["count"], data["rare"] = distinct, count, rare[first]
            cuts = np.searchsorted(bl.bucket_of(distinct, buckets), np.arange(buckets + 1))
            full = [b for b in range(buckets) if cuts[b + 1] > cuts[b]]
            rows = [data[cuts[b] : cuts[b + 1]].tobytes() for b in full]
            yield pa.RecordBatch.from_arrays(
                [pa.array(full, pa.int32()), pa.array(rows, pa.binary())],
                names=["bucket", "data"],
            )


def _summed(data: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(data), _COUNT)
    distinct, first, place = np.unique(x["hash"], return_index=True, return_inverse=True)
    out = np.empty(distinct.size, _COUNT)
    out["hash"], out["rare"] = distinct, x["rare"][first]
    total = np.zeros(distinct.size, np.int64)
    np.add.at(total, place, x["count"])
    out["count"] = total
    return out


def _sum_bucket(table: pa.Table) -> pa.Table:
    out = _summed(table["data"].to_pylist()).tobytes()
    return pa.table({"bucket": table["bucket"][:1], "data": pa.array([out], pa.binary())})


def _top(frequent: int, x: np.ndarray) -> np.ndarray:
    return x[np.lexsort((x["hash"], -x["count"]))][:frequent]


def _about(frequent: int, table: pa.Table) -> pa.Table:
    """A bucket's figures: tokens and words of each rare class, and its most frequent words."""
    x = np.frombuffer(table["data"][0].as_py(), _COUNT)
    n = np.bincount(x["rare"], x["count"], RARE).astype(np.int64)
    v = np.bincount(x["rare"], minlength=RARE).astype(np.int64)
    return pa.table(
        {"node": table["bucket"][:1].cast(pa.int64()), "data": pa.array([n.tobytes() + v.tobytes() + _top(frequent, x).tobytes()], pa.binary())}
    )


def _merge_about(frequent: int, data: list[bytes]) -> bytes:
    size = 16 * RARE
    total = sum(np.frombuffer(x[:size], np.int64) for x in data)
    return total.tobytes() + _top(frequent, np.frombuffer(b"".join(x[size:] for x in data), _COUNT)).tobytes()


def _reduced(df: DataFrame, nodes: int, merge: Callable[[list[bytes]], bytes]) -> bytes | None:
    """All data of df (node, data), node in 0..nodes - 1, merged by a tree: FAN rows at most meet in a task."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        return pa.table(
            {"node": pa.array([table["node"][0].as_py() // FAN], pa.int64()), "data": pa.array([merge(table["data"].to_pylist())], pa.binary())}
        )

    while True:
        df = df.groupBy(F.expr(f"node div {FAN}").alias("up")).applyInArrow(bl.one(run), "node bigint, data binary")
        if nodes <= FAN:
            break
        nodes = -(-nodes // FAN)
    row = df.first()
    return row and bytes(row["data"])


class Vocabulary:
    """Hashes of the frequent words, class counts, and what the rare classes hold; the last class is the end."""

    def __init__(self, about: bytes | None, texts: int, frequent: int = FREQUENT) -> None:
        size = 8 * RARE
        about = about or bytes(2 * size)
        n, v = np.frombuffer(about[:size], np.int64), np.frombuffer(about[size : 2 * size], np.int64)
        top = np.frombuffer(about[2 * size :], _COUNT)
        self.frequent, self.end = frequent, frequent + RARE
        self.tokens = int(n.sum()) + texts
        self.words = int(v.sum()) + (texts > 0)
        self.texts = texts
        order = np.argsort(top["hash"])
        self.hash, self.id = top["hash"][order], order
        inside, each = np.bincount(top["rare"], top["count"], RARE), np.bincount(top["rare"], minlength=RARE)
        self.rare_n, self.rare_v = n - inside.astype(np.int64), v - each
        self.count = np.zeros(self.end + 1)
        self.count[: top.size] = top["count"]
        self.count[frequent : self.end] = self.rare_n
        self.count[self.end] = texts

    def classes(self, h: np.ndarray, rare: np.ndarray) -> np.ndarray:
        out = self.frequent + rare.astype(np.int64)
        if self.hash.size:
            at = np.minimum(np.searchsorted(self.hash, h), self.hash.size - 1)
            known = self.hash[at] == h
            out[known] = self.id[at[known]]
        return out


# The model: one float32 vector holding R, T, b, c1 and c2; R has one row more, for what is before a text's start.


def _size(classes: int) -> int:
    return classes * (2 * DIM + 1) + 3 * DIM


def _views(flat: np.ndarray) -> list[np.ndarray]:
    classes = (flat.size - 3 * DIM) // (2 * DIM + 1)
    out, at = [], 0
    for s in ((classes + 1, DIM), (classes, DIM), (classes,), (DIM,), (DIM,)):
        n = int(np.prod(s))
        out.append(flat[at : at + n].reshape(s))
        at += n
    return out


def start_model(count: np.ndarray, seed: int = 0) -> np.ndarray:
    """The model before the first round: random vectors, and the unigram of classes as biases."""
    flat = np.zeros(_size(count.size), np.float32)
    r, t, b, c1, c2 = _views(flat)
    rng = np.random.default_rng(seed)
    r[:] = rng.normal(0, 0.3, r.shape)
    t[:] = rng.normal(0, 0.1, t.shape)
    b[:] = np.log((count + 1) / (count.sum() + count.size))
    c1[:], c2[:] = 1, 0.5
    return flat


def rounds_of(pieces: int) -> int:
    """Rounds that the pieces are dealt into: two, and one more whenever their number has grown fourfold."""
    return min(pieces, 2 + int(math.log2(pieces)) // 2) if pieces else 0


def contexts(classes: np.ndarray, count: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens (classes and each text's end), and the classes one and two before each; end + 1 stands before a text."""
    total = classes.size + count.size
    ends = np.cumsum(count + 1) - 1
    token = np.full(total, end)
    inner = np.ones(total, bool)
    inner[ends] = False
    token[inner] = classes
    one, two = np.full(total, end + 1), np.full(total, end + 1)
    one[1:], two[2:] = token[:-1], token[:-2]
    first = ends - count
    one[first] = end + 1
    two[first] = end + 1
    two[np.minimum(first + 1, ends)] = end + 1
    return token, one, two


def _scattered(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(rows, values[:, j], n) for j in range(values.shape[1])], axis=1)


def train(
    flat: np.ndarray, seen: np.ndarray, count: np.ndarray, token: np.ndarray, one: np.ndarray, two: np.ndarray, seed: int
) -> tuple[np.ndarray, np.ndarray]:
    """flat and seen after one pass over the tokens in random order: NCE with NOISE shared noise classes a batch, AdaGrad.

    seen: the sum of squared gradients so far, which sets the steps' sizes.
    """
    flat, seen = flat.copy(), seen.copy()
    r, t, b, c1, c2 = _views(flat)
    rng, classes = np.random.default_rng(seed), count.size
    noise_p = (count + 1) / (count.sum() + count.size)
    log_kp = np.log(NOISE * noise_p).astype(np.float32)
    cumulative = np.cumsum(noise_p)
    seen_r, seen_t, seen_b, seen_c1, seen_c2 = _views(seen)
    order = rng.permutation(token.size)

    def step(x: np.ndarray, total: np.ndarray, g: np.ndarray) -> None:
        total += g * g
        x += RATE * g / np.sqrt(total)

    for at in range(0, token.size, BATCH):
        i = order[at : at + BATCH]
        w, w1, w2 = token[i], one[i], two[i]
        noise = np.minimum(np.searchsorted(cumulative, rng.random(NOISE)), classes - 1)
        r1, r2 = r[w1], r[w2]
        q = c1 * r1 + c2 * r2
        tw, tn = t[w], t[noise]
        real = (q * tw).sum(1) + b[w] - log_kp[w]
        fake = q @ tn.T + (b[noise] - log_kp[noise])
        up = 1 / (1 + np.exp(np.clip(real, -30, 30))) / i.size
        down = -1 / (1 + np.exp(np.clip(-fake, -30, 30))) / i.size
        dq = up[:, None] * tw + down @ tn
        dt = _scattered(np.concatenate([w, noise]), np.concatenate([up[:, None] * q, down.T @ q]), classes)
        db = np.bincount(np.concatenate([w, noise]), np.concatenate([up, down.sum(0)]), classes)
        dr = _scattered(np.concatenate([w1, w2]), np.concatenate([dq * c1, dq * c2]), classes + 1)
        step(c1, seen_c1, (dq * r1).sum(0))
        step(c2, seen_c2, (dq * r2).sum(0))
        step(t, seen_t, dt)
        step(b, seen_b, db)
        step(r, seen_r, dr)
    return flat, seen


def _trained(words: Vocabulary, model: np.ndarray, rounds: int, piece: pa.Table) -> pa.Table:
    """A piece of the corpus: the model and its step sizes trained on it, times its tokens, and its tokens."""
    block = bl.Block(piece)
    h, rare, count = _words(block.texts)
    token, one, two = contexts(words.classes(h, rare), count, words.end)
    new = np.concatenate(train(*np.split(model, 2), words.count, token, one, two, seed=block.number))
    data = np.concatenate([[1], new.astype(np.float64)]) * token.size
    return pa.table({"node": pa.array([block.number // rounds], pa.int64()), "data": pa.array([data.tobytes()], pa.binary())})


def _add(data: list[bytes]) -> bytes:
    return sum(np.frombuffer(x, np.float64) for x in data).tobytes()


def log_probabilities(flat: np.ndarray, token: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Natural log of each token's class probability; each distinct context is normalised once, in batches."""
    r, t, b, c1, c2 = _views(flat)
    before = r.shape[0]
    pair, place = np.unique(one * before + two, return_inverse=True)
    norm = np.empty(pair.size, np.float32)
    q = c1 * r[pair // before] + c2 * r[pair % before]
    for at in range(0, pair.size, 2048):
        s = q[at : at + 2048] @ t.T + b
        top = s.max(1, keepdims=True)
        norm[at : at + 2048] = np.log(np.exp(s - top).sum(1)) + top[:, 0]
    out = np.empty(token.size)
    for at in range(0, token.size, 1 << 16):
        k = place[at : at + (1 << 16)]
        w = token[at : at + (1 << 16)]
        out[at : at + (1 << 16)] = (q[k] * t[w]).sum(1) + b[w] - norm[k]
    return out


# Scores.


def _ask(buckets: int, docs: pa.Table) -> pa.Table:
    block = bl.Block(docs)
    h, _, _ = _words(block.texts)
    distinct = np.unique(h)
    return bl.asked(block.number, 0, buckets, distinct, lambda a, b: distinct[a:b].tobytes())


def _tell(asked: pa.Table, counts: pa.Table) -> pa.Table:
    """The counts of the hashes that blocks ask about."""
    x = np.frombuffer(counts["data"][0].as_py(), _COUNT) if counts.num_rows else np.empty(0, _COUNT)
    known, count = np.ascontiguousarray(x["hash"]), x["count"]
    out = []
    for data in asked["data"].to_pylist():
        h = np.frombuffer(data, np.uint64)
        c = np.zeros(h.size, np.int64)
        if known.size:
            at = np.minimum(np.searchsorted(known, h), known.size - 1)
            c = np.where(known[at] == h, count[at], 0)
        out.append(c.tobytes())
    return asked.select(["bucket", "block", "level"]).append_column("data", pa.array(out, pa.binary()))


def _score(words: Vocabulary, flat: np.ndarray, buckets: int, docs: pa.Table, told: pa.Table) -> pa.Table:
    block = bl.Block(docs)
    h, rare, count = _words(block.texts)
    distinct, place = np.unique(h, return_inverse=True)
    cuts = np.searchsorted(bl.bucket_of(distinct, buckets), np.arange(buckets + 1))
    c = np.zeros(distinct.size, np.int64)
    for b, data in zip(told["bucket"].to_pylist(), told["data"].to_pylist()):
        c[cuts[b] : cuts[b + 1]] = np.frombuffer(data, np.int64)
    c = c[place]
    classes = words.classes(h, rare)
    token, one, two = contexts(classes, count, words.end)
    inner = token != words.end
    log_p = log_probabilities(flat, token, one, two)
    within = np.log((c + 1) / (words.rare_n[rare] + words.rare_v[rare] + 1))
    log_p[inner] += np.where(classes >= words.frequent, within, 0)
    all_c = np.full(token.size, words.texts, np.int64)
    all_c[inner] = c
    base = np.log10((all_c + 1) / (words.tokens + words.words + 1))
    first = np.cumsum(count + 1) - (count + 1)
    add = lambda x: np.add.reduceat(x, first) if first.size else np.empty(0)
    return pa.table(
        {
            "doc_id": pa.array(block.ids, pa.int64()),
            "held_out": pa.array([held_out(i) for i in block.ids], pa.bool_()),
            "n_tokens": pa.array(count + 1, pa.int64()),
            "n_known": pa.array(add((all_c > 0).astype(np.int64)).astype(np.int64), pa.int64()),
            "train_tokens": pa.array([words.tokens] * count.size, pa.int64()),
            "base_score": pa.array(add(base), pa.float64()),
            "score": pa.array(add(log_p) / np.log(10), pa.float64()),
        }
    )


def _training(plain: DataFrame) -> DataFrame:
    """The rows that are not held out."""
    return plain.where(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS != HELD_OUT)


def _model(plain: DataFrame, words: Vocabulary, seed: int) -> np.ndarray:
    """The model after all rounds over the training texts of plain (doc_id, text)."""
    flat = start_model(words.count, seed)
    texts = _training(plain)
    pieces = -(-text_bytes(texts) // PIECE_BYTES) or int(words.texts > 0)
    rounds = rounds_of(pieces)
    texts = texts.select(bl.block_of(max(1, pieces)).alias("block"), "doc_id", "text")
    model = np.concatenate([flat, np.full(flat.size, 1e-3, np.float32)])
    for k in range(rounds):
        part = texts.where(F.col("block") % rounds == k)
        trained = part.groupBy("block").applyInArrow(bl.one(partial(_trained, words, model, rounds)), "node bigint, data binary")
        total = _reduced(trained, -(-pieces // rounds), _add)
        if total:
            total = np.frombuffer(total, np.float64)
            model = (total[1:] / total[0]).astype(np.float32)
    return np.split(model, 2)[0]


def score(docs: DataFrame, seed: int = 0, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of docs (doc_id, text)."""
    base, buckets = bl.deal(docs)
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = cut(plain.mapInArrow(partial(_counted, buckets), "bucket int, data binary"))
    counts = rows.groupBy("bucket").applyInArrow(bl.one(_sum_bucket), "bucket int, data binary")
    counts = cut(counts)
    about = counts.groupBy("bucket").applyInArrow(bl.one(partial(_about, frequent)), "node bigint, data binary")
    words = Vocabulary(_reduced(about, buckets, partial(_merge_about, frequent)), _training(plain).count(), frequent)
    flat = _model(plain, words, seed)
    asked = base.groupBy("block").applyInArrow(bl.one(partial(_ask, buckets)), bl.ASK)
    told = asked.groupBy("bucket").cogroup(counts.groupBy("bucket")).applyInArrow(bl.two(_tell), bl.ASK)
    say = bl.two(partial(_score, words, flat, buckets))
    return base.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(say, OUT)
