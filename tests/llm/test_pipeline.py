import itertools
import random

import pytest
from test_dedup import lines_left, ordered, sets
from test_pages_lm import _brute_leaks
from test_quality_mixing import base, targets

import __spark_entry__ as entry
import corpus_pipeline
from silt.llm import quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "source_mixing"]


def test_stages_keep_columns_and_survive_odd_rows(spark, odd_docs, no_docs, tmp_path):
    spark.createDataFrame([(1, "a benchmark text of some words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for df in (odd_docs, no_docs):
        docs, columns = df, []
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            columns.append(out.columns)
            path = f"{tmp_path}/{name}"
            out.write.mode("overwrite").parquet(path)
            docs = spark.read.parquet(path)
        assert columns == [df.columns] * 4
        assert set(df.columns) <= set(corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).columns)


def test_run(spark):
    sf = "/root/testdata/sf0.001"
    rows = corpus_pipeline.run(spark, sf).collect()
    assert rows and {"doc_id", "text", "source", "copy"} <= set(rows[0].asDict())
    assert "pipeline" in entry.queries() and len([q for q in entry.queries() if q.startswith("op")]) == 10


def test_queries_run_on_a_small_table(spark):
    for name, q in entry.queries().items():
        if name.startswith("op"):
            assert q(spark, "/root/testdata/sf0.001").count() >= 0


def _corpus(seed):
    """Documents of unlike length around a hot passage, near copies, repeated and edited lines, leaks and junk; and items."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("aeioubdlmnrst") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)).capitalize() + "."
    items = [(1, "If Alice buys 12 apples and each apple costs 3 dollars, how much money does Alice pay in total at the market?"),
             (2, "A 12 kg box costs 30 dollars and a 5 kg box costs 14 dollars what is the difference"), (3, line(25)), (4, None)]
    hot, stock, texts = line(60), line(9), []
    for i in range(150):
        kind, own = i % 10, [line(rng.randint(5, 30)) for _ in range(rng.randint(2, 6))]
        if kind in (1, 2) and texts:
            words = rng.choice(texts).split(" ")
            for _ in range(kind - 1):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words))
            continue
        if kind in (3, 4):
            own = [hot, *own[: 1 + 4 * (kind == 4)]]
        elif kind == 5:
            words = stock.split(" ")
            words[rng.randrange(1, 8)] = rng.choice(vocabulary)
            own.append(" ".join(words))
        elif kind == 6:
            own.insert(1, "So " + items[i % 3][1].replace("12", str(i)) + " Then it ends.")
        elif kind == 7:
            own = [x.replace(".", " ### ***") for x in own]
        texts.append("\n".join(own))
    rows = [(i, t, "en", rng.choice(["a", "a", "a", "b", "c", None]), len(t)) for i, t in enumerate(texts)]
    return rows + [(500, None, None, "b", None), (501, "", "en", "c", 0)], items


def _copies_left(rows):
    """The first row of each class of similar texts."""
    grams, up = [sets(r["text"]) for r in rows], list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if grams[i] and grams[j] and len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j]):
            up[max(root(i), root(j))] = min(root(i), root(j))
    return [r for i, r in enumerate(rows) if root(i) == i]


@pytest.mark.parametrize("seed", [1, 2])
def test_run_against_brute_force(spark, tmp_path, seed):
    docs, items = _corpus(seed)
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows, sizes = ordered(spark.createDataFrame(docs, DOCS)), []

    def lost(text):
        n_words = quality.clean(text)[2]
        return 100 * n_words > 50 * len(text.split())

    rows = [r for r in rows if not base(r["text"])[-1] and not lost(r["text"] or "")]
    sizes.append(len(rows))
    left = [(r, t) for r, t in zip(rows, lines_left(rows)) if t == r["text"] or t.split()]
    sizes.append(len(left))
    rows = [r.asDict() | {"text": t, "n_chars": len(t)} for r, t in left]
    rows = _copies_left(rows)
    sizes.append(len(rows))
    leaked = {i for i, _ in _brute_leaks(spark, [(r["doc_id"], r["text"]) for r in rows], items)}
    rows = [r for r in rows if r["doc_id"] not in leaked]
    sizes.append(len(rows))
    assert len(docs) > sizes[0] > sizes[2] > sizes[3] > 40 and sizes[0] >= sizes[1]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    by = {r["doc_id"]: r for r in rows}
    copies = {i: 0 for i in by}
    for r in out:
        assert {c: r[c] for c in by[r["doc_id"]]} == by[r["doc_id"]]
        copies[r["doc_id"]] += 1
    words = {}
    for r in rows:
        words[r["source"]] = words.get(r["source"], 0) + len(r["text"].split())
    want = targets(words)
    for source, n in words.items():
        own = [r for r in rows if r["source"] == source]
        rate = want[source] / n
        assert all(int(rate + 1e-9) <= copies[r["doc_id"]] <= -int(-rate // 1 - 1e-9) + 1 and copies[r["doc_id"]] <= 3 for r in own)
        taken = sum(copies[r["doc_id"]] * len(r["text"].split()) for r in own)
        assert abs(taken - want[source]) <= max(len(r["text"].split()) for r in own)


def test_stages_leave_columns_of_any_name_alone(spark, tmp_path):
    names = ("KEPT", "n_words", "n_removed", "n_lines", "clean_text", "copies", "target", "whole", "up", "size", "row", "node", "item", "piece", "pairs")
    docs, items = _corpus(3)
    wide = spark.createDataFrame([(*r, *[f"{n} of {r[0]}" for n in names]) for r in docs], DOCS + "".join(f", {n} string" for n in names))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, wide, str(tmp_path))
        rows = out.collect()
        assert rows and out.columns[: len(wide.columns)] == wide.columns, name
        assert all(r[n] == f"{n} of {r['doc_id']}" for r in rows for n in names), name
