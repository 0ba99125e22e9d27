import hashlib
import itertools
import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from silt.llm import blocks, jaccard, lines, lpf, substring


def ordered(df):
    return sorted(df.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or ""))


# Line dedup.


def near(a, b):
    """Word edit distance of 1 at most."""
    if abs(len(a) - len(b)) > 1:
        return False
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    return max(len(a), len(b)) - head - tail <= 1


def lines_left(rows):
    seen, out, done = [], [], {}
    for r in rows:
        key = (r["doc_id"], r["text"])
        if key in done:
            out.append(done[key])
            continue
        if r["text"] is None:
            out.append(None)
            continue
        kept = []
        for line in r["text"].split("\n"):
            w = line.encode().split()
            if w:
                if any(w == x or (max(len(w), len(x)) >= lines.MIN_NEAR and near(w, x)) for x in seen):
                    seen.append(w)
                    continue
                seen.append(w)
            kept.append(line)
        out.append("\n".join(kept))
        done[key] = out[-1]
    return out


@pytest.mark.parametrize("which", ["docs", "odd_docs"])
def test_line_dedup(which, request):
    df = request.getfixturevalue(which).where("doc_id is not null")
    want = lines_left(ordered(df))
    got = [r["text"] for r in sorted(lines.dedup_lines(df).collect(), key=lambda r: (r["doc_id"]))]
    assert got == want


def test_line_dedup_small_vocabulary(spark):
    rng = random.Random(3)
    texts = ["\n".join(" ".join(rng.choice("abc") for _ in range(rng.randint(2, 8))) for _ in range(4)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = lines_left(ordered(df))
    assert [r["text"] for r in sorted(lines.dedup_lines(df).collect())] == want


def test_keys_that_collide_remove_no_line(spark, docs, monkeypatch):
    want = {r["doc_id"]: set((r["text"] or "").split("\n")) for r in lines.dedup_lines(docs).collect()}
    monkeypatch.setattr(lines, "KEY_BITS", 15)
    out = {r["doc_id"]: set((r["text"] or "").split("\n")) for r in lines.dedup_lines(docs).collect()}
    assert all(want[i] <= out[i] for i in want)


def test_lines_of_chunk_lengths(spark):
    rng = random.Random(4)
    texts = []
    for n in (63, 64, 65, 127, 128, 129, 200):
        w = [rng.choice("abcdefgh") for _ in range(n)]
        i = rng.randrange(n)
        texts += [" ".join(w), " ".join(w[:i] + w[i + 1 :]), " ".join(w[:i] + ["x"] + w[i + 1 :]), " ".join([*w[:i], "x", "y", *w[i + 1 :]])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["text"] for r in sorted(lines.dedup_lines(df).collect())] == lines_left(ordered(df))


def test_very_long_lines(spark):
    rng = random.Random(5)
    w = [str(rng.randrange(1000)) for _ in range(300_000)]
    rows = [(1, " ".join(w)), (2, " ".join(w[:70_000] + w[70_001:])), (3, " ".join(w[:70_000] + w[70_003:])), (4, " ".join([*w[:9], "x", *w[10:]]))]
    began = time.perf_counter()
    out = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["n_removed"] for r in out} == {1: 0, 2: 1, 3: 0, 4: 1}
    assert time.perf_counter() - began < 60


def test_line_dedup_keeps_columns_and_null_ids_last(spark):
    df = spark.createDataFrame([(None, "same words here", 1), (5, "same words here", 2)], "doc_id long, text string, N_removed int")
    out = {r["doc_id"]: r for r in lines.dedup_lines(df).collect()}
    assert out[5]["text"] == "same words here" and out[None]["text"] == "" and out[None]["n_removed"] == 1


# Substring dedup.


def substrings_left(rows, k=13):
    first, out = {}, []
    for r in rows:
        w = (r["text"] or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if first.setdefault(tuple(w[i : i + k]), r["doc_id"]) < r["doc_id"]:
                gone[i : i + k] = [True] * k
        out.append((r["doc_id"], len(w), sum(gone), b" ".join(itertools.compress(w, [not g for g in gone])).decode()))
    return out


@pytest.mark.parametrize("which", ["docs", "odd_docs"])
def test_substring_dedup(which, request):
    df = request.getfixturevalue(which).where("doc_id is not null")
    got = sorted(tuple(r[c] for c in ("doc_id", "n_words", "n_removed", "text")) for r in substring.dedup_substrings(df).collect())
    assert got == sorted(substrings_left(ordered(df)))


def test_substring_doubling_goes_on(docs):
    rows = substring.dedup_substrings(docs, longest=4096).collect()
    plain = {r["doc_id"]: r["n_removed"] for r in substring.dedup_substrings(docs).collect()}
    assert {r["doc_id"]: r["n_removed"] for r in rows} == plain
    words = {r["doc_id"]: (r["text"] or "").split() for r in docs.collect()}
    for r in rows:
        if n := r["longest"]:
            here = {tuple(words[r["doc_id"]][i : i + n]) for i in range(len(words[r["doc_id"]]) - n + 1)}
            assert any(tuple(w[i : i + n]) in here for d, w in words.items() if d < r["doc_id"] for i in range(len(w) - n + 1))
        else:
            assert not plain[r["doc_id"]]


def test_substring_null_ids_come_last(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text), (9, text), (9, text)]
    out = substring.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in out) == [(0, 30), (9, 0), (9, 0)]


# Suffix-array dedup.


@given(st.binary(max_size=60), st.integers(1, 12))
@settings(max_examples=150, deadline=None)
def test_longest_previous_factor(data, depth):
    data = bytes(b % 3 for b in data)
    buf, start = np.frombuffer(data, np.uint8), np.arange(len(data))
    # A mark that differs ends each suffix, so that none runs past the end.
    order, lcp = lpf.suffix_order(np.concatenate([buf + 1, np.zeros(1, np.uint8)]), start, depth)
    assert sorted(order) == list(range(len(data)))
    pad = bytes(b + 1 for b in data) + bytes(depth + 1)
    assert [pad[i : i + depth] for i in order] == sorted(pad[i : i + depth] for i in range(len(data)))
    got = lpf.longest_previous(order, lcp)
    for i in range(len(data)):
        best = 0
        for j in range(i):
            n = 0
            while n < depth and pad[i + n] == pad[j + n]:
                n += 1
            best = max(best, n)
        assert got[i] == best


def bytes_left(rows, length):
    seen, out = set(), []
    for r in rows:
        b = (r["text"] or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            x = b[i : i + length]
            if x in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(x)
        spans = sum(1 for i in range(len(b)) if gone[i] and (not i or not gone[i - 1]))
        out.append((r["doc_id"], len(b), sum(gone), spans, bytes(itertools.compress(b, [not g for g in gone]))))
    return out


@pytest.mark.parametrize("which, length, gram", [("docs", 100, 36), ("odd_docs", 100, 36), ("docs", 20, 8)])
def test_suffix_array_dedup(which, length, gram, request):
    df = request.getfixturevalue(which).where("doc_id is not null")
    rows = lpf.dedup_bytes(df, length, gram).collect()
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in rows)
    assert got == sorted(bytes_left(ordered(df), length))


def test_suffix_array_dedup_with_common_grams(spark, monkeypatch):
    monkeypatch.setattr(lpf, "COMMON", 3)
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    line, passage = text(30), text(90)
    rows = [(i, text(rng.randint(5, 60)) + rng.choice([line, passage, line + passage]) + text(rng.randint(5, 60))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert lpf.common_anchors(df, 40, 12, 64).size
    got = sorted((r["doc_id"], r["n_removed"], hashlib.sha256(r["kept"]).hexdigest()) for r in lpf.dedup_bytes(df, 40, 12).collect())
    assert got == sorted((i, n, hashlib.sha256(k).hexdigest()) for i, _, n, _, k in bytes_left(ordered(df), 40))


def test_suffix_array_dedup_of_few_letters(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randint(0, 400)))) for i in range(40)] + [(50, "ab" * 300), (51, "a" * 500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_removed"], hashlib.sha256(r["kept"]).hexdigest()) for r in lpf.dedup_bytes(df, 16, 6).collect())
    want = [(i, n, hashlib.sha256(k).hexdigest()) for i, _, n, _, k in bytes_left(ordered(df), 16)]
    assert got == sorted(want)


# Jaccard join.


def sets(text):
    w = (text or "").encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())


@pytest.mark.parametrize("which", ["docs", "odd_docs"])
def test_jaccard_classes(which, request):
    df = request.getfixturevalue(which).where("doc_id is not null")
    rows = ordered(df)
    s = [sets(r["text"]) for r in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if s[i] and s[j] and len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j]):
            up[max(root(i), root(j))] = min(root(i), root(j))
    want = sorted((r["doc_id"], rows[root(i)]["doc_id"]) for i, r in enumerate(rows))
    assert sorted((r["doc_id"], r["class_id"]) for r in jaccard.join(df).collect()) == want
    heads = {rows[root(i)]["doc_id"] for i in range(len(rows))}
    assert sorted(r["doc_id"] for r in jaccard.one_of_each(df).collect()) == sorted(heads)


def test_jaccard_null_ids_and_copies(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(None, text), (7, text), (7, text), (8, text + " more"), (9, None)], "doc_id long, text string")
    out = {r["doc_id"]: r for r in jaccard.join(df).collect()}
    assert out[None]["class_id"] == out[8]["class_id"] == 7 and out[7]["n_copies"] == 3 and out[9]["class_id"] == 9
    assert out[8]["n_links"] == 1 and jaccard.one_of_each(df).count() == 2


def all_pairs(texts):
    """class_id and n_links of each text by brute force."""
    s = [sets(t) for t in texts]
    links, up = [0] * len(s), list(range(len(s)))
    for i, j in itertools.combinations(range(len(s)), 2):
        if len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j]):
            links[i] += 1
            links[j] += 1
            a, b = up[i], up[j]
            up = [min(a, b) if x in (a, b) else x for x in up]
    return up, links


def some_words(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def test_jaccard_hot_passage_in_texts_of_unlike_length(spark):
    rng = random.Random(3)
    passage = some_words(rng, 180)
    texts = [passage + some_words(rng, 100) for _ in range(800)] + [passage + some_words(rng, 10) for _ in range(2)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    out = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    up, _ = all_pairs([t for _, t in rows])
    assert up[800:] == [800] * 2 and sorted((r["doc_id"], r["class_id"]) for r in out) == list(enumerate(up))


@pytest.mark.parametrize("block_rows", [512, 16])
def test_jaccard_links_of_groups(spark, monkeypatch, block_rows):
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", block_rows)
    rng, texts = random.Random(3), []
    for size, length in ((3, 60), (7, 120), (45, 200)):
        base = some_words(rng, length)
        for _ in range(size):
            texts.append(list(base))
            texts[-1][rng.randrange(length)] = "other" + str(len(texts))
    rows = [(i, " ".join(t)) for i, t in enumerate(texts + [some_words(rng, 80) for _ in range(5)])]
    out = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    want = [(i, c, n) for i, (c, n) in enumerate(zip(*all_pairs([t for _, t in rows])))]
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in out) == want and max(n for *_, n in want) > 30


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101)]
    links = spark.createDataFrame(edges, "node long, centre long")
    labels = {r["node"]: r["label"] for r in jaccard.components(links, links).collect()}
    assert set(labels.values()) == {0, 100} and labels[40] == 0 and labels[101] == 100


def test_empty_tables(no_docs):
    assert lines.dedup_lines(no_docs).count() == 0
    assert substring.dedup_substrings(no_docs).count() == 0
    assert lpf.dedup_bytes(no_docs).count() == 0
    assert jaccard.join(no_docs).count() == 0


def test_blocks_grow_with_the_root_of_the_corpus():
    for corpus in (10**8, 5 * 10**8):
        rows = [-(-n // (s := blocks.block_bytes(n))) * -(-n // (blocks.BUCKET_BLOCKS * s)) for n in (corpus, 5 * corpus)]
        assert 4.5 < rows[1] / rows[0] < 5.5
    assert blocks.block_bytes(10**14) == blocks.MOST_BLOCK and blocks.block_bytes(0) == blocks.LEAST_BLOCK


def test_long_texts_are_looked_at_in_segments(spark, docs, monkeypatch):
    want = sorted(tuple(r) for r in lpf.dedup_bytes(docs).collect())
    monkeypatch.setattr(lpf, "SEGMENT", 700)
    assert sorted(tuple(r) for r in lpf.dedup_bytes(docs).collect()) == want


def test_windows_double_until_no_candidate_survives(spark):
    rng = random.Random(8)
    shared = [str(rng.randrange(10**6)) for _ in range(500)]
    own = lambda: [str(rng.randrange(10**6)) for _ in range(40)]
    rows = [(1, " ".join([*own(), *shared, *own()]))]
    rows += [(i, " ".join([*own(), *shared[:n], *own()])) for i, n in ((2, 13), (3, 26), (4, 60), (5, 415), (6, 12), (7, 500))]
    out = substring.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), longest=1 << 20).collect()
    assert {r["doc_id"]: r["longest"] for r in out} == {1: 0, 2: 13, 3: 26, 4: 52, 5: 208, 6: 0, 7: 416}
    assert {r["doc_id"]: r["n_removed"] for r in out} == {1: 0, 2: 13, 3: 26, 4: 60, 5: 415, 6: 0, 7: 500}
